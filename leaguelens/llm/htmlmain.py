"""Main text of web pages: site templates are removed by counting element subtrees for each host.

A page is read into a tree of elements. Each block-level subtree has a hash of its tags and texts, and a slot: the tags
and classes on the way to it. Spark counts for each host in how many different pages a subtree occurs; pages whose longest
text is the same count as one, so copies of an article don't look like a template. Two things are template and deleted:

* a subtree found on many pages of the host;
* a region (an element that stands once on a page) whose slot holds recurring subtrees: menus, adverts and footers often
  rotate, so that each text is on few pages, while the texts of a slot of articles don't come again.

Then elements go whose tag, role or class says that they hold no article text (reader comments, say, differ from page to
page and recur nowhere), but never one that holds the page's main block for its class alone. All that remains is put out
block by block, in however many <article>, <main> or other elements it stands.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leaguelens.llm.common import bounded_batches, checkpointed

#: A subtree is a template if it is in at least so many different pages of the host, and in at least the square root of
#: their number: 4 of 16 pages, 100 of 10,000. Only elements of _COUNTED with at least so many characters are counted.
TEMPLATE_PAGES, TEMPLATE_CHARS = 4, 12
#: Paragraphs, items and the like repeat in articles, too, so that such a share of the host's pages must hold one.
TEXT_SHARE = 0.5
#: A slot is template if at least so many different subtrees of it, and such a share of all of them, are on several pages.
SLOT_RECURRING, SLOT_SHARE = 3, 0.1
#: Measured size up to which all templates are broadcast, and the tasks over which a host is spread beyond it.
BROADCAST_BYTES, SALTS = 48 << 20, 32

# Fixed values of the HTML standard.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split()
)
#: Elements that can be a template by their number: blocks, without headings and parts of tables.
_COUNTED = _BLOCK - frozenset("article body caption dt h1 h2 h3 h4 h5 h6 hgroup html legend main summary tbody tfoot thead tr".split())
#: Elements that can be a region.
_REGIONS = frozenset("address aside details div dl footer form header menu nav ol section table td ul".split())
#: Elements that mostly hold a piece of an article's text.
_TEXTS = frozenset("blockquote dd figcaption figure li p pre".split())
_CLOSES_P = _BLOCK - frozenset("caption dd dt legend li tbody tfoot thead tr body html".split())
#: An element of the first name ends when one of these begins.
_ENDED_BY = {
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "tbody", "tfoot", "thead"]),
    "td": frozenset(["td", "th", "tr", "tbody", "tfoot", "thead"]),
    "th": frozenset(["td", "th", "tr", "tbody", "tfoot", "thead"]),
    "option": frozenset(["option", "optgroup"]),
    "p": _CLOSES_P,
}
#: What an end tag may not reach over.
_SCOPE = frozenset("table td th caption button html".split())
#: Beyond what a start tag ends nothing.
_BARRIERS = frozenset("ul ol dl select table div section article td th body main blockquote".split())

_DROPPED = frozenset("head nav header footer aside form menu button select input dialog svg math canvas object embed audio video map datalist".split()) | _RAW
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
_NAMES = frozenset(
    "nav navbar navigation menu submenu header masthead footer foot sidebar aside rail ad ads adv advert adverts advertisement advertising sponsor sponsored promo promoted promotion banner cookie cookies consent gdpr notice notices notification alert popup modal overlay comment comments commentlist respond disqus reply replies share sharing social related recommended recommendations newsletter subscribe subscription signup login breadcrumb breadcrumbs pagination pager widget toolbar skip".split()
)

#: Names that an article may use of its own subject.
_AMBIGUOUS = frozenset("menu submenu cookie cookies item items".split())
_TOLD = frozenset("p h1 h2 h3 h4 h5 h6 li dd dt blockquote".split())
#: Parts of an article's header that are text of the article.
_LEADS = frozenset("standfirst lead lede summary intro deck dek abstract subtitle subhead highlights keypoints key points".split())

#: Words before or after one of _NAMES that leave its sense ("ad-slot", "site-header"), and those that change it.
_CONTAINERS = frozenset("area bar block body box button buttons container content form holder inner item items links list module outer panel row section slot space text top unit wrap wrapper zone".split())
_OTHERS = frozenset("has with without no not is show hide article post entry story content body page".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<data>.*?)\]\]>|<[!?/](?![a-zA-Z])[^>]*>|<![^>]*>"
    r"|</(?P<end>[a-zA-Z][^\s>/]*)[^>]*>"
    r"|<(?P<start>[a-zA-Z][^\s>/]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(?P<odd>[a-zA-Z][^\s>/]*)(?P<rest>[^>]*)>",
    re.DOTALL,
)
_ATTR = re.compile(r"([a-zA-Z_:][-\w:.]*)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_PART = re.compile(r"[a-z]+")
_DIGITS = re.compile(r"[0-9]+")
_HEADS = frozenset("h1 h2 h3 h4 h5 h6 p".split())
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_SPACE = re.compile(r"\s+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)
_RAW_END = {t: re.compile(rf"</{t}(?=[\s>/])[^>]*>|\Z", re.IGNORECASE) for t in _RAW}


class Node:
    __slots__ = ("attrs", "children", "hash", "size", "slot", "tag")

    def __init__(self, tag: str, attrs: str = "") -> None:
        self.tag, self.attrs, self.children, self.hash, self.size, self.slot = tag, attrs, [], 0, 0, 0

    def attributes(self) -> dict[str, str]:
        return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(self.attrs)} if "=" in self.attrs or self.attrs.strip(" /") else {}


def parse(source: str) -> Node:
    """The page's elements. Missing end tags are supplied; text of scripts and the like is left out."""
    root = Node("#root")
    stack, at = [root], 0
    # Places in the stack: of each tag, of tags that a start tag may end or that keep it from looking further, and of those
    # that keep an end tag from it. So no tag looks through the stack, however many elements are open.
    places: dict[str, list[int]] = {}
    ending, scopes = [], []

    def cut(k: int) -> None:
        while len(stack) > k:
            places[stack.pop().tag].pop()
            for held in (ending, scopes):
                if held and held[-1] == len(stack):
                    held.pop()

    for_text = lambda s: stack[-1].children.append(html.unescape(s) if "&" in s else s)
    while m := _TOKEN.search(source, at):
        if m.start() > at:
            for_text(source[at : m.start()])
        at = m.end()
        if m["data"] is not None:
            stack[-1].children.append(m["data"])
        elif m["end"]:
            name = m["end"].lower()
            own = places.get(name)
            if own and (name in _SCOPE or name == "body" or not scopes or scopes[-1] < own[-1]):
                cut(own[-1])
        elif m["start"] or m["odd"]:
            name, attrs = (m["start"] or m["odd"]).lower(), m["attrs"] or m["rest"] or ""
            ends = True
            while ends:  # li and the like end the one before; block elements end a paragraph
                ends = False
                for k in reversed(ending):  # a kind is there once at most before the next barrier, as each ends its own kind
                    tag = stack[k].tag
                    if name in _ENDED_BY.get(tag, ()):
                        cut(k)
                        ends = True
                        break
                    if tag in _BARRIERS:
                        break
            node = Node(name, attrs)
            stack[-1].children.append(node)
            if name in _RAW:
                end = _RAW_END[name].search(source, at)
                at = end.end()
            elif name not in _VOID and not attrs.endswith("/"):
                places.setdefault(name, []).append(len(stack))
                if name in _ENDED_BY or name in _BARRIERS:
                    ending.append(len(stack))
                if name in _SCOPE:
                    scopes.append(len(stack))
                stack.append(node)
    if at < len(source):
        for_text(source[at:])
    return root


def walk(root: Node):
    """Every node, children before parents; without recursion, as pages may be nested deeply."""
    todo = [(root, False)]
    while todo:
        node, seen = todo.pop()
        if seen:
            yield node
        else:
            todo.append((node, True))
            todo.extend((c, False) for c in node.children if isinstance(c, Node))


def measure(root: Node) -> int:
    """Sets each node's hash and text length; returns the hash of the page's longest text."""
    longest, signature = 0, 0
    for node in walk(root):
        digest, size = xxhash.xxh64(node.tag), 0
        for c in node.children:
            if isinstance(c, Node):
                if c.size:
                    digest.update(c.hash.to_bytes(8, "big"))
                    size += c.size
            else:
                text = _SPACE.sub(" ", c).strip()
                if text:
                    raw = text.encode("utf-8", "surrogatepass")
                    digest.update(raw)
                    size += len(text)
                    if len(text) > longest:
                        longest, signature = len(text), xxhash.xxh64_intdigest(raw)
        node.hash, node.size = digest.intdigest(), size
    return signature


def signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def regions(root: Node) -> list[Node]:
    """The page's regions with enough text, their slots set: those of which the page has one only. Numbers in classes
    don't count, as they often tell pages apart."""
    found: dict[int, list[Node]] = {}
    todo = [(root, b"")]
    while todo:
        node, path = todo.pop()  # path: a hash of the tags and names on the way
        for c in node.children:
            if isinstance(c, Node) and c.size:
                a = c.attributes() if c.attrs else {}
                names = sorted(_DIGITS.sub("", f"{a.get('class', '')} {a.get('id', '')}".lower()).split())
                own = xxhash.xxh3_128_digest(path + f"/{c.tag} {' '.join(names)}".encode("utf-8", "surrogatepass"))
                todo.append((c, own))
                if c.tag in _REGIONS and c.size >= TEMPLATE_CHARS:
                    c.slot = signed(int.from_bytes(own[:8], "big"))
                    found.setdefault(c.slot, []).append(c)
    return [nodes[0] for nodes in found.values() if len(nodes) == 1]


def subtrees(source: str) -> tuple[int, set[tuple[int | None, int]]]:
    """The page's signature, and (slot, hash) of its block-level subtrees with enough text, but for the page as a whole:
    the slot is None, or 0 for pieces of text; regions come again with their own slot."""
    root = parse(source)
    signature = measure(root)
    found = {(0 if n.tag in _TEXTS else None, signed(n.hash)) for n in walk(root) if n.size >= TEMPLATE_CHARS and n.tag in _COUNTED}
    return signed(signature), found | {(n.slot, signed(n.hash)) for n in regions(root)}


def unwanted(node: Node) -> bool:
    """Whether tag, role or style tell that the element holds no article text."""
    if node.tag in _DROPPED:
        return True
    if not node.attrs:
        return False
    a = node.attributes()
    return "hidden" in a or a.get("aria-hidden") == "true" or a.get("role", "").lower() in _ROLES or bool(_HIDDEN.search(a.get("style", "")))


def named(node: Node) -> bool:
    """Whether a class or the id names a part of a page that holds no article text."""
    if not node.attrs or node.tag in ("html", "body", "main"):
        return False
    a = node.attributes()
    for token in f"{a.get('class', '')} {a.get('id', '')}".split():
        parts = _PART.findall(_CAMEL.sub(" ", token).lower())
        whole = "".join(parts)
        if node.tag == "article":
            if {"comment", "comments", "reply"} & {whole, *parts[:1]}:
                return True
        elif whole in _NAMES or parts and (
            (parts[-1] in _NAMES and parts[0] not in _OTHERS) or (parts[0] in _NAMES and all(p in _CONTAINERS or p in _NAMES for p in parts[1:]))
        ):
            return True
    return False


def main_block(root: Node, anywhere: bool = False) -> set[int]:
    """The elements that hold the page's main block, by id(): its largest <article> or <main>; without any, the element
    with most text in paragraphs of its own. Parts with an unwanted tag or class are looked at only if there is no other
    text."""
    best, found, todo, parents = (0, 0), None, [(root, None)], {}
    while todo:
        node, parent = todo.pop()
        if node.tag in _DROPPED and node.tag != "form" or named(node) and not anywhere:
            continue
        parents[id(node)] = parent
        marked = node.tag in ("article", "main")
        own = node.size if marked else sum(c.size for c in node.children if isinstance(c, Node) and c.tag == "p")
        if own and (int(marked), own) >= best:  # of equal ones the inner one
            best, found = (int(marked), own), id(node)
        todo.extend((c, id(node)) for c in node.children if isinstance(c, Node) and c.size)
    if found is None and not anywhere:
        return main_block(root, True)
    out = set()
    while found is not None:
        out.add(found)
        found = parents[found]
    return out


def meant(node: Node) -> bool:
    """Whether an element of the main block that has one of _AMBIGUOUS as name is text of the article about such a thing: at
    least half of it is in paragraphs, headings and items, and less than half in links."""
    a = node.attributes()
    parts = {p for token in f"{a.get('class', '')} {a.get('id', '')}".split() for p in _PART.findall(_CAMEL.sub(" ", token).lower())}
    if (parts & _NAMES) - _AMBIGUOUS - _CONTAINERS:
        return False
    told, links, todo = 0, 0, [(node, False, False)]
    while todo:
        n, text, link = todo.pop()
        if n.tag == "a" and not link:
            links, link = links + n.size, True
        if n.tag in _TOLD and not text:
            told, text = told + n.size, True
        todo.extend((c, text, link) for c in n.children if isinstance(c, Node))
    return 2 * told >= node.size and 2 * links < node.size


def main_text(source: str, templates: frozenset[int] | set[int] = frozenset(), slots: frozenset[int] | set[int] = frozenset(), names: bool = True) -> str:
    """Blocks of all that is neither template nor unwanted, in page order, joined by two line feeds.

    templates: subtree hashes of the host's templates; slots: its slots that are template; names: whether tags, roles and
    classes count besides scripts and the like.
    """
    root = parse(source)
    measure(root)
    if slots:
        regions(root)
    main, gone = main_block(root), set()
    todo = [(root, False)]
    while todo:  # parents first: what is in a dropped element is not looked at
        node, inside = todo.pop()
        template = node.size and (signed(node.hash) in templates or node.slot in slots)
        if node.tag == "header" and inside and not template:  # an article's own header: headings and paragraphs stay
            heads = leads(node)
            if heads and not any(signed(n.hash) in templates for n in heads):
                node.tag, node.children = "section", heads
                continue
        if template or (node.tag in _RAW or node.tag == "head" if not names else unwanted(node) and not (node.tag == "form" and id(node) in main) or named(node) and id(node) not in main and not (inside and meant(node))):
            gone.add(id(node))
            continue
        todo.extend((c, inside or node.tag in ("article", "main")) for c in node.children if isinstance(c, Node))
    return blocks(root, gone)


def leads(header: Node) -> list[Node]:
    """The outermost headings, paragraphs, lists and named leads of an article's header, in page order."""
    out, todo = [], [header]
    while todo:
        node = todo.pop()
        if node is not header and (unwanted(node) or named(node)):
            continue
        names = _PART.findall(f"{node.attributes().get('class', '')}".lower()) if node.attrs and node is not header else ()
        if node.tag in _HEADS or node is not header and _LEADS & set(names):
            out.append(node)
        else:
            todo.extend(c for c in reversed(node.children) if isinstance(c, Node))
    return out


def blocks(root: Node, gone: set[int]) -> str:
    out, part, todo = [], [], [root]

    def flush() -> None:
        text = _SPACE.sub(" ", "".join(part)).strip()
        if text:
            out.append(text)
        part.clear()

    while todo:
        item = todo.pop()
        if isinstance(item, str):
            part.append(item)
        elif item is None:
            flush()
        elif id(item) not in gone:
            if item.tag in _BLOCK:
                flush()
                todo.append(None)
            elif item.tag in ("br", "td", "th"):
                part.append(" ")
            todo.extend(reversed(item.children))
    flush()
    return "\n\n".join(out)


def with_host(pages: DataFrame) -> DataFrame:
    """pages with the host of url; a null url, or one without a host, has the empty host."""
    host = F.regexp_extract(F.lower(F.coalesce("url", F.lit(""))), r"^\s*(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/:?#\s]+)", 1)
    return pages.select("page_id", "url", "html", host.alias("host"))


def templates(pages: DataFrame) -> DataFrame:
    """host, templates (array of subtree hashes), slots (array) of hosts that have any; pages: those of with_host."""
    bounded_batches(pages.sparkSession)

    def run(batches):
        for batch in batches:
            rows = set()
            for host, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                signature, found = subtrees(source or "")
                rows.add((host, signature, None, None))
                rows.update((host, signature, s, h) for s, h in found)
            columns = zip(*rows, strict=True) if rows else [()] * 4
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["host", "signature", "slot", "subtree"])

    seen = pages.where("host <> ''").select("host", "html").mapInArrow(run, "host string, signature long, slot long, subtree long")
    # The first grouping spreads a large host over its subtrees and pages; the counts that follow are pre-aggregated.
    counted = seen.distinct().groupBy("host", "slot", "subtree").agg(F.count("*").alias("pages"))
    counted = checkpointed(counted.where(F.col("subtree").isNull() | (F.col("slot") != 0) | (F.col("pages") >= TEMPLATE_PAGES)))
    own = counted.where("subtree is null").select("host", F.col("pages").alias("of"))
    many = F.col("pages") >= F.greatest(F.sqrt("of"), F.lit(TEMPLATE_PAGES))
    texts = counted.where("subtree is not null and coalesce(slot, 0) = 0").join(own, "host").where(many & (F.col("slot").isNull() | (F.col("pages") >= F.col("of") * TEXT_SHARE)))
    slots = counted.where("slot <> 0").groupBy("host", "slot").agg(F.sum("pages").alias("pages"), F.count("*").alias("different"), F.count_if(F.col("pages") > 1).alias("recurring"))
    slots = slots.join(own, "host").where(many & (F.col("recurring") >= SLOT_RECURRING) & (F.col("recurring") >= F.col("different") * SLOT_SHARE))
    both = texts.select("host", "subtree", F.lit(None).cast("long").alias("slot")).unionByName(slots.select("host", F.lit(None).cast("long").alias("subtree"), "slot"))
    return both.groupBy("host").agg(F.collect_set("subtree").alias("templates"), F.collect_set("slot").alias("slots"))


def with_templates(hosted: DataFrame, found: DataFrame) -> DataFrame:
    """Each page with its host's templates. Their size is measured: up to BROADCAST_BYTES they are broadcast, and no page
    is shuffled; beyond it pages are shuffled by host and salt, so that a large host is spread over SALTS tasks."""
    found = checkpointed(found)
    size = found.agg(F.sum((F.size("templates") + F.size("slots")) * 8 + F.length("host") + 64)).first()[0] or 0
    if size <= BROADCAST_BYTES:
        return hosted.join(F.broadcast(found), "host", "left")
    salted = found.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return hosted.withColumn("_salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS))).join(salted, ["host", "_salt"], "left")


def extract(pages: DataFrame, names: bool = True) -> DataFrame:
    """page_id, url, text, n_chars of each row of pages (page_id, url, html); names as in main_text.

    A null html is empty and has the empty text; so has a page all of whose text is template. Character references are
    decoded, white space inside a block becomes one space, nothing is capped. A page without a host meets no templates.
    Repeated rows are answered one by one; further columns of pages are ignored; an empty table gives no rows.
    """
    hosted = with_host(pages)

    def run(batches):
        for batch in batches:
            known, slots = ([frozenset(t or ()) for t in batch.column(k).to_pylist()] for k in (3, 4))
            text = [main_text(s or "", t, p, names) for s, t, p in zip(batch.column(2).to_pylist(), known, slots, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], ["page_id", "url", "text", "n_chars"])

    joined = with_templates(hosted, templates(hosted)).select("page_id", "url", "html", "templates", "slots")
    return joined.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op10_html_main_text(spark, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
