import random
from collections import Counter

from leaguelens.llm import packing as P


def plain_best_fit(lengths, capacities):
    """The rules of the module's docstring, with every open bin looked at for every piece."""
    cost = lambda c: P.OVERHEAD + c + c * c / P.BALANCE
    bins, of, positions = [], [], []  # a bin is [capacity, used]
    for i, n in enumerate(lengths):
        room = [(cap - used, b) for b, (cap, used) in enumerate(bins) if cap - used >= n]
        if room:
            b = min(room)[1]
        else:
            best = None
            for c in sorted(c for c in capacities if c >= n):
                later = sum(x for x in lengths[i + 1 :] if x <= c - n)  # shorter pieces that may fill it up
                value = cost(c) / max(1, n + min(c - n, later))
                best = (value, c) if best is None or value < best[0] else best
            b = len(bins)
            bins.append([best[1], 0])
        of.append(b)
        positions.append(bins[b][1])
        bins[b][1] += n
    return of, positions, [min(c for c in capacities if c >= used) for _, used in bins]


def test_best_fit_equals_a_plain_one():
    rng = random.Random(8)
    for sizes in ((100,), (8, 20, 64), P.CAPACITIES):
        for n in (0, 1, 2, 30, 200):
            lengths = sorted((min(max(sizes), int(rng.paretovariate(0.7) * max(sizes) / 300) + 1) for _ in range(n)), reverse=True)
            assert P.best_fit(lengths, sizes) == plain_best_fit(lengths, sizes), (sizes, n)


def test_best_fit_keeps_the_rules():
    rng = random.Random(1)
    lengths = sorted((rng.choice((3, 50, 900, 1500, 5000, 20000, 32768)) + rng.randint(0, 300) for _ in range(800)), reverse=True)
    lengths = [min(n, 32768) for n in lengths]
    bins, positions, caps = P.best_fit(lengths)
    for b, cap in enumerate(caps):
        own = sorted((p, n) for x, p, n in zip(bins, positions, lengths, strict=True) if x == b)
        end = 0
        for p, n in own:
            assert p == end
            end += n
        assert cap in P.CAPACITIES and end <= cap and not any(end <= c < cap for c in P.CAPACITIES)
    assert sum(lengths) / sum(caps) > 0.9


def test_each_goes_to_the_bin_it_fills_best():
    bins, positions, caps = P.best_fit([90, 80, 20, 10], (100,))
    assert bins == [0, 1, 1, 0] and positions == [0, 0, 80, 90] and caps == [100, 100]
    assert P.best_fit([5], (100, 10, 50))[2] == [10]
    assert P.best_fit([], (10,)) == ([], [], [])


def test_every_token_is_packed_once(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = {r.doc_id: len(r.text.encode()) + 1 for r in docs.select("doc_id", "text").collect()}
    rows = P.pack(docs).collect()
    parts, bins = {}, {}
    for r in rows:
        parts.setdefault(r.doc_id, []).append((r.start, r.n_tokens, r.piece))
        bins.setdefault((r.bin_id, r.capacity), []).append((r.position, r.n_tokens))
    assert set(parts) == set(want)
    for doc, own in parts.items():
        end = 0
        for k, (start, n, piece) in enumerate(sorted(own)):
            assert start == end and piece == k
            end += n
        assert end == want[doc]
    assert len({b for b, _ in bins}) == len(bins)
    for (_, cap), own in bins.items():
        assert sum(n for _, n in own) <= cap
        own.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(own, own[1:]))  # noqa: B905


def test_edge_rows(spark):
    docs = spark.createDataFrame([(1, None, 5), (2, "", 5), (None, "é" * 40000, 5), (2, "", 5)], "doc_id long, text string, capacity int")
    got = sorted((str(r.doc_id), r.piece, r.n_tokens) for r in P.pack(docs).collect())
    assert got == [("1", 0, 1), ("2", 0, 1), ("2", 0, 1), ("None", 0, 32768), ("None", 1, 32768), ("None", 2, 14465)]
    assert P.pack(docs.limit(0)).count() == 0


def test_equal_rows_without_doc_id_are_split(spark):
    """A third of the rows are equal and have no doc_id: each is packed once, and no group gets all of them."""
    n = 6000
    docs = spark.range(3 * n).selectExpr(f"if(id < {n}, null, id) doc_id", f"if(id < {n}, 'same text', repeat('x', int(id % 900))) text")
    rows = P.pack(docs).collect()
    assert len(rows) == 3 * n and all(r.start == 0 and r.piece == 0 for r in rows)
    per = Counter(r.bin_id >> 32 for r in rows)
    assert len(per) == -(-3 * n // P.GROUP_PIECES) and max(Counter(r.bin_id >> 32 for r in rows if r.doc_id is None).values()) < n / 2
    ends = {}
    for r in sorted(rows, key=lambda r: (r.bin_id, r.position)):
        assert r.position == ends.get(r.bin_id, 0)
        ends[r.bin_id] = r.position + r.n_tokens
        assert ends[r.bin_id] <= r.capacity
    assert sum(ends.values()) == sum(len(r.text) + 1 for r in docs.select("text").collect())
