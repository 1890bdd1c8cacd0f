import hashlib
import random
import re

from leaguelens.llm import mixing as M
from leaguelens.llm.common import sums_before

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_targets(sizes, weights=M.WEIGHTS, share=M.SHARE, repeats=M.REPEATS):
    """sizes: by source. The excess of capped sources is shared again until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    budget, capped = share * sum(sizes.values()), {}
    while True:
        rest = [s for s in order if s not in capped]
        if not rest:
            return capped, order
        level = (budget - sum(capped.values())) / sum(weight[s] for s in rest)
        above = [s for s in rest if level * weight[s] > repeats * sizes[s]]
        if not above:
            return capped | {s: level * weight[s] for s in rest}, order
        capped |= {s: repeats * sizes[s] for s in above}


def plain_mix(rows):
    """(doc_id, size, source_size, target, taken) of rows (doc_id, source, text), packet by packet."""
    docs = [(d, s, len(WORD.findall(t or ""))) for d, s, t in rows]
    sizes = {}
    for _, s, n in docs:
        sizes[s] = sizes.get(s, 0) + n
    targets, order = plain_targets(sizes)
    packets, taken = [], [0] * len(docs)
    for rank, s in enumerate(order):
        own = sorted((hashlib.md5(f"mix:{'' if docs[i][0] is None else docs[i][0]}".encode()).hexdigest(), docs[i][2], i) for i in range(len(docs)) if docs[i][1] == s)
        end = 0
        for _ in range(M.REPEATS):
            for _, n, i in own:
                for at in range(0, n, M.PACKET):
                    words = min(M.PACKET, n - at)
                    end += words
                    packets.append((end / targets[s], rank, end, words, i))
    left = int(M.SHARE * sum(sizes.values()))
    for *_, words, i in sorted(packets):
        taken[i] += min(words, left)
        left -= min(words, left)
    return sorted(((d, n, sizes[s], targets[s], t) for (d, s, n), t in zip(docs, taken, strict=True)), key=str)


def mixed(spark, rows, parts=3, schema="doc_id long, source string, text string"):
    return sorted((tuple(r) for r in M.taken(*M.mix(spark.createDataFrame(rows, schema).repartition(parts))).collect()), key=str)


def close(got, want):
    assert [(*a[:3], a[4]) for a in got] == [(*b[:3], b[4]) for b in want]
    assert all(abs(a[3] - b[3]) <= 1e-9 * max(1, b[3]) for a, b in zip(got, want, strict=True))


def made(seed, n, longest):
    rng = random.Random(seed)
    names = ["a", "Z", "", None, "é", "hot"]
    return [(i, rng.choice(names) if rng.random() < 0.6 else "hot", "w\t\n" * int(longest * rng.random() ** 4)) for i in range(n)]


def test_equals_a_plain_queue(spark):
    for seed, n, longest in ((1, 60, 50), (2, 40, 3000)):
        close(mixed(spark, made(seed, n, longest)), plain_mix(made(seed, n, longest)))


def test_reruns_and_order_of_rows(spark):
    rows = made(5, 80, 900)
    first = mixed(spark, rows)
    assert first == mixed(spark, rows[::-1], 5)


def test_shares_hold_at_any_place_and_repeats_end_at_two(spark):
    rows = made(3, 120, 4000)
    queue, served = M.mix(spark.createDataFrame(rows, "doc_id long, source string, text string"))
    taken = M.taken(queue, served).collect()
    assert all(0 <= r.taken <= 2 * r.size for r in taken)
    target = {r["rank"]: r.target for r in queue.select("rank", "target").distinct().collect()}
    packets = sorted(served.collect(), key=lambda r: r.place)
    total = sum(r.words for r in packets)
    assert total == int(1.5 * sum(r.size for r in taken))
    had = dict.fromkeys(target, 0)
    place = 0
    for r in packets:
        assert r.place == place
        place += r.words
        had[r["rank"]] += r.words
        if place > total / 4:
            for s, n in had.items():
                assert abs(n / target[s] - place / total) <= (len(had) + 1) * M.PACKET / min(target[s], place) or target[s] < 500


def test_targets_of_many_sources(spark):
    rng = random.Random(4)
    sizes = {f"s{i:03}": int(10000 * rng.random() ** 6) for i in range(80)}
    rows = [(i, s, None, n) for i, (s, n) in enumerate(sizes.items())]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, n long")
    sources, budget = M.targets(M.sized(docs, docs.n))
    want = plain_targets(sizes)[0]
    got = {r.key[1:]: r.target for r in sources.collect()}
    assert budget == int(1.5 * sum(sizes.values())) and len(got) == 80
    assert all(abs(got[s] - want[s]) < 1e-6 for s in want)


def test_edge_rows(spark):
    rows = [(1, "a", None), (2, "a", ""), (None, None, "x y"), (None, None, "x y"), (3, "a", "x " * 5000), (3, "a", "x " * 5000), (4, "b", " \n")]
    close(mixed(spark, rows), plain_mix(rows))
    wide = spark.createDataFrame([(*r, 7, 8.5, "k") for r in rows], "doc_id long, source string, text string, size int, target double, key string")
    close(sorted((tuple(r) for r in M.taken(*M.mix(wide)).collect()), key=str), plain_mix(rows))
    assert mixed(spark, []) == []
    assert mixed(spark, [(1, "a", None), (2, None, "")]) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]


def test_running_sums_over_ranges(spark):
    rng = random.Random(0)
    rows = [(rng.choice([None, 1, 2, 3]), i, rng.choice([None, 0, 5, 7])) for i in range(500)]
    df = spark.createDataFrame(rows, "a int, b int, n long").repartition(7)
    so_far, want = 0, []
    for a, b, n in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        want.append((b, so_far))
        so_far += n or 0
    got = sums_before(df, [df.a.asc_nulls_first(), df.b], before="n").select("b", "before").collect()
    assert [tuple(r) for r in got] == want
