import html as stdlib_html
import re
import time

import pytest

from leaguelens.llm import htmlmain as H


def slow(source):
    """For pages of the tables' own plain shape: paragraphs and headings of <article>, read with patterns."""
    body = re.search(r"<article>(.*?)</article>", source, re.DOTALL)[1]
    parts = re.split(r"</?(?:p|h1)>", body)
    texts = [" ".join(stdlib_html.unescape(re.sub(r"<[^>]*>", " " if "<br" in p else "", p)).split()) for p in parts]
    return "\n\n".join(t for t in texts if t)


def test_tables_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = {r.page_id: slow(r.html) for r in pages.collect()}
    got = {r.page_id: r for r in H.op10_html_main_text(spark, "/root/testdata/sf0.01").collect()}
    assert len(got) == len(want)
    assert {k: r.text for k, r in got.items()} == want
    assert all(r.n_chars == len(r.text) for r in got.values())


def test_what_is_dropped_and_kept():
    page = """<!doctype html><html><head><title>T</title><style>p{}</style></head><body class="post">
    <header>Site</header><nav>Home</nav><div class="cookie-notice">We use cookies</div><div id="sideBar">Side</div>
    <main><article><header><h1>Title &amp; more</h1><span>by X</span></header><p>One <b>bold</b>
    and&nbsp;two<br>three<p>Next <a href='x>y'>link</a> if 1 < 2<div class="ad-slot">Buy</div><ul><li>a<li>b</ul>
    <form>Mail <input></form><section class="comments"><p>Nice!</p></section><script>if (a<b) "</p>"</script><!-- <p>no</p> -->
    <table><tr><td>1<td>2<tr><td>3</table><p hidden>secret</p></article></main><footer>Foot</footer></body></html>"""
    assert H.main_text(page).split("\n\n") == ["Title & more", "One bold and two three", "Next link if 1 < 2", "a", "b", "1 2", "3"]
    assert H.main_text("<p>No article here <p class=menu>Menu") == "No article here"
    assert H.main_text("") == "" and H.main_text("plain &lt; text") == "plain < text"
    assert H.main_text("<div>" * 5000 + "deep") == "deep"
    assert H.main_text("<p title=\"broken>x</p><p>y") != ""


def test_text_in_several_containers():
    assert H.main_text("<article>One</article><div><article>Two, longer</article></div><div class=text>Three</div>").split("\n\n") == ["One", "Two, longer", "Three"]
    card = "<main><p>First</p><article><p>Card</p></article><p>Last</p></main><p>Beside</p>"
    assert H.main_text(card).split("\n\n") == ["First", "Card", "Last", "Beside"]
    noisy = f"<div class=post><p>Text</p></div><div class=post><div class=comments>{'Chat. ' * 50}</div><p>More</p></div>"
    assert H.main_text(noisy).split("\n\n") == ["Text", "More"]


@pytest.mark.parametrize("limit", [H.BROADCAST_BYTES, 0])
def test_templates_by_host(spark, monkeypatch, limit):
    monkeypatch.setattr(H, "BROADCAST_BYTES", limit)
    notice = "<div><p>Sign up and get the best of our site</p></div>"
    rows = [(i, "https://A.example/x", f"<body><article><h1>T{i}</h1>{notice if i != 3 else ''}<p>{'Own text %d. ' % i * 9}</p></article>") for i in range(6)]
    rows += [(10 + i, "https://b.example/x", f"<body><article><p>{'Same article, copied. ' * 9}</p></article>") for i in range(6)]
    rows += [(20, "https://c.example", f"<body>{notice}<p>{'Another host. ' * 9}</p>"), (21, None, None), (22, "no host", "<p>x"), (23, "https://A.example/x", "")]
    pages = spark.createDataFrame([(*r, 1, "z") for r in rows], "page_id long, url string, html string, n_chars int, text string")
    got = {r.page_id: r.text for r in H.extract(pages).collect()}
    assert len(got) == len(rows)
    assert all("Sign up" not in got[i] and f"Own text {i}." in got[i] and f"T{i}" in got[i] for i in range(6))
    assert all(got[10 + i].startswith("Same article") for i in range(6))
    assert "Sign up" in got[20] and got[21] == got[23] == "" and got[22] == "x"
    assert H.extract(pages.limit(0)).count() == 0
    twice = H.extract(pages.where("page_id = 22").union(pages.where("page_id = 22")))
    assert twice.count() == 2


def test_template_of_one_layout_among_many(spark):
    notice = "<div><p>Sign up and get the best of our site</p></div>"
    small = "<h2>Summary of it all</h2><p><b>Note, and read it well:</b> NR</p><table><tr><td>0</td><td>a longer cell text</td></tr></table>"
    page = lambda i: f"<body>{notice if i % 6 == 0 else ''}<article>{small}<p>{'Own text %d. ' % i * 9}</p></article>"
    rows = [(i, "https://a.example/x", page(i).replace("NR", f"{i}").replace("</table>", f"<tr><td>{i}</td></tr></table>")) for i in range(60)]
    got = {r.page_id: r.text for r in H.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all("Sign up" not in t for t in got.values())  # on 10 of 60 pages
    assert all(w in t for t in got.values() for w in ("Summary of it all", "Note, and read it well:", "0 a longer cell text"))


def rest_of(source):
    """What is left of a page of the tables without its menu, advert and footer, wherever it stands."""
    body = re.sub(r"<!--.*?-->|<head>.*?</head>|<nav>.*?</nav>|<div class=\"ad\">.*?</div>|<footer>.*?</footer>", "", source, flags=re.DOTALL)
    parts = re.split(r"</?(?:p|h1|article|body|html|!DOCTYPE)\b[^>]*>", body)
    texts = [" ".join(stdlib_html.unescape(re.sub(r"<[^>]*>", " " if "<br" in p else "", p)).split()) for p in parts]
    return "\n\n".join(t for t in texts if t)


def test_templates_alone_delete_menus_and_footers(spark):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    want = {r.page_id: rest_of(r.html) for r in pages.collect()}
    assert {r.page_id: r.text for r in H.extract(pages).collect()} == want
    plain = {r.page_id: H.main_text(r.html, names=False) for r in pages.collect()}
    alone = {r.page_id: r.text for r in H.extract(pages, names=False).collect()}
    assert sum(alone[k] != plain[k] for k in want) > 0.6 * len(want)  # pages that templates change
    assert sum(alone[k] == want[k] for k in want) > 0.6 * len(want)  # pages that need nothing else
    kept = lambda k: set(want[k].split("\n\n")) <= set(alone[k].split("\n\n"))
    assert all(kept(k) for k in want)  # and no text of an article goes


def test_rotating_texts_of_a_slot(spark):
    menu = lambda i: f"<div class='m'><a href=/{i % 4}>Offer {i % 4} of the day</a></div>"
    lead = lambda i: f"<div class='lead'>What page {i} is about</div>"
    rows = [(i, "https://a.example/x", f"<body>{menu(i)}<div class=post-{i}>{lead(i)}<p>{'Own text %d. ' % i * 9}</p></div>") for i in range(30)]
    got = {r.page_id: r.text for r in H.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all("Offer" not in t for t in got.values())
    assert all(got[i].startswith(f"What page {i} is about") and f"Own text {i}." in got[i] for i in got)


def test_ordinary_pages():
    assert H.main_text('<div class="content has-sidebar"><p>Real text</p></div>') == "Real text"
    assert H.main_text("<article><header><h1>T</h1><p>Standfirst</p></header><p>Body</p></article>").split("\n\n") == ["T", "Standfirst", "Body"]
    assert H.main_text('<script>var s="<!--";</script><article><p>Text</p></article><script>x="-->"</script>') == "Text"
    assert H.main_text("<form><div><article><p>In a form</p></article></div><input></form><form>Search</form>") == "In a form"
    assert H.main_text("<div class='modal overlay'><p>All there is</p></div>") == "All there is"
    assert H.main_text("<div class='comments'><p>A very long comment, longer than all else</p></div><div><p>Short</p></div>") == "Short"
    assert H.main_text("<div class='post-header'><h1>Head</h1></div><p>Body</p><div class='site-header'>Site</div><div class='nav-bar'>N</div>") == "Head\n\nBody"


def test_very_long_page():
    body = "".join(f"<p>Part {i} of a long text</p>" for i in range(40000))
    began = time.time()
    text = H.main_text(f"<nav>Menu</nav><article>{body}</article>")
    assert text.count("\n\n") == 39999 and time.time() - began < 20


def test_open_elements_take_linear_time():
    import time

    for tag in ("span", "a", "b", "font"):
        source = "<body><article><p>Start.</p>" + f"<{tag}>x" * ((1 << 20) // (len(tag) + 3)) + "</article>"
        began = time.time()
        assert H.main_text(source).startswith("Start.\n\nxxx")
        assert time.time() - began < 6
    began = time.time()
    H.parse("<p>" + "</b><i>x" * 130_000)  # end tags that end nothing
    assert time.time() - began < 6


def test_deep_pages_keep_their_main_block():
    for depth in (5, 250, 10_000):
        source = "<body>" + "<div>" * depth + '<div class="banner"><article><p>Deep text.</p></article></div>' + "</div>" * depth
        assert H.main_text(source) == "Deep text.", depth
        H.subtrees(source)


def test_words_of_furniture_may_be_an_articles_subject():
    page = """<article><p><label>Term</label> means this.</p><div class="menu-items"><p>The menu had soup and fish.</p></div>
    <section id="cookies"><h2>Cookies</h2><p>Bake them.</p></section><div class="menu"><a href="/">Home</a> <a href="/b">More</a></div>
    <div class="cookie-banner"><p>We use them here.</p></div><form><label>Name</label><input></form></article>"""
    assert H.main_text(page) == "Term means this.\n\nThe menu had soup and fish.\n\nCookies\n\nBake them."
    assert H.main_text('<div class="menu-items"><p>The menu had soup and fish.</p></div><article><p>Text.</p></article>') == "Text."
    page = """<article><header><h1>T</h1><div class="standfirst">Stand first.</div><ul class="key-points"><li>One</li><li>Two</li></ul>
    <div class="byline">By someone</div><nav><p>Away</p></nav></header><p>Body.</p></article>"""
    assert H.main_text(page) == "T\n\nStand first.\n\nOne\n\nTwo\n\nBody."
