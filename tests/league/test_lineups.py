import itertools
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from leaguelens.operators import lineups as L


def win(w, d, lineup, order):
    """Win, tie, loss by all 243 outcomes of five boards."""
    out = [0.0, 0.0, 0.0]
    for o in itertools.product((0, 1, 2), repeat=5):
        share = 1.0
        for s, k in enumerate(o):
            a, b = w[lineup[s]][order[s]][s], d[lineup[s]][order[s]][s]
            share *= (1 - a - b, b, a)[k]
        out[0 if sum(o) > 5 else 1 if sum(o) == 5 else 2] += share
    return out


@pytest.fixture()
def case(spark):
    rng = random.Random(3)
    ids, opp = [f"a{i}" for i in range(6)], [f"z{i}" for i in range(5)]
    w = [[[rng.random() * 0.7 for _ in range(5)] for _ in range(5)] for _ in range(6)]
    d = [[[rng.random() * 0.2 for _ in range(5)] for _ in range(5)] for _ in range(6)]
    orders, shares = [tuple(rng.sample(opp, 5)) for _ in range(3)], [0.5, 0.3, 0.1]
    ratings = [1000.0 + 10 * i for i in range(6)]
    flat = lambda x: [v for a in x for b in a for v in b]
    row = (1, 2, ids, ratings, opp, [900.0, 950.0, 800.0, 990.0, 1010.0], [list(o) for o in orders], shares, flat(w), flat(d))
    schema = "hall_id long, opp_hall_id long, ids array<string>, ratings array<double>, opp_ids array<string>, opp_ratings array<double>, orders array<array<string>>, shares array<double>, p_win array<double>, p_draw array<double>"
    return spark.createDataFrame([row], schema), ids, opp, w, d, orders, shares, ratings


@pytest.mark.parametrize("small", [8, 0])
def test_search_equals_trying_all(case, small, monkeypatch):
    monkeypatch.setattr(L, "SMALL_POOL", small)
    frame, ids, opp, w, d, orders, shares, ratings = case
    got = L.search(frame).first()
    tried = []
    for lineup in itertools.permutations(range(6), 5):
        each = [win(w, d, lineup, [opp.index(p) for p in o]) for o in orders]
        expected = [sum(s * e[k] for s, e in zip(shares, each, strict=True)) / sum(shares) for k in range(3)]
        tried.append(([ids[i] for i in lineup], [round(x, 9) for x in expected], round(min(e[0] for e in each), 9)))
    best = min(tried, key=lambda t: (-t[1][0], t[0]))
    safe = min(tried, key=lambda t: (-t[2], t[0]))
    assert got.n_candidates == 720 == len(tried)
    assert (got.best.lineup, [got.best.win, got.best.tie, got.best.loss], got.best.worst) == (best[0], pytest.approx(best[1], abs=1e-8), pytest.approx(best[2], abs=1e-8))
    assert (got.safe.lineup, got.safe.worst) == (safe[0], pytest.approx(safe[2], abs=1e-8))
    assert got.safe.win <= got.best.win + 1e-9 and got.safe.worst >= got.best.worst - 1e-9
    lineup, top = [ids.index(p) for p in best[0]], [opp.index(p) for p in orders[0]]
    assert got.boards == pytest.approx([w[lineup[s]][top[s]][s] for s in range(5)])


def test_patterns_set_ranks_against_ranks(case):
    frame, ids, opp, _, _, orders, _, ratings = case
    got = {p.name: p for p in L.search(frame).first().patterns}
    strong = [f"a{i}" for i in (5, 4, 3, 2, 1)]
    rank = [opp[i] for i in (4, 3, 1, 0, 2)]  # theirs by rating
    assert got["strength order"].lineup == strong
    for name, against in L.ARCHETYPES:
        faced = dict(zip(got[name].lineup, orders[0], strict=True))
        assert [faced[p] for p in strong] == [rank[k] for k in against]
    assert got["free optimum"].win >= max(p.win for p in got.values()) - 1e-9


def test_sacrifice_beats_strength_order(spark):
    """Each of ours but the weakest narrowly beats the next weaker of theirs."""
    ours, theirs = [100.0, 80.0, 60.0, 40.0, 20.0], [101.0, 81.0, 61.0, 41.0, 21.0]
    row = (1, 2, [f"a{i}" for i in range(5)], ours, [f"z{i}" for i in range(5)], theirs, [[f"z{i}" for i in range(5)]], [1.0], [0.9 if a > b else 0.05 for a in ours for b in theirs], [0.05] * 25)
    schema = "hall_id long, opp_hall_id long, ids array<string>, ratings array<double>, opp_ids array<string>, opp_ratings array<double>, orders array<array<string>>, shares array<double>, p_win array<double>, p_draw array<double>"
    got = L.search(spark.createDataFrame([row], schema)).first()
    by = {p.name: p.win for p in got.patterns}
    assert by["single sacrifice"] > by["strength order"] + 0.5 and abs(by["single sacrifice"] - got.best.win) < 1e-9


def test_a_pool_of_twelve_within_two_seconds():
    rng = np.random.default_rng(1)
    w, d = rng.random((12, 5, 5)) * 0.7, rng.random((12, 5, 5)) * 0.2
    orders = np.array([rng.permutation(5) for _ in range(24)])
    tree, began = L.Search(12), time.time()
    won = tree.wins(w, d, orders)
    assert won.shape == (95040, 24) and time.time() - began < 4
    for k in (0, 777, 95039):
        assert won[k] == pytest.approx(L.team_results(w, d, tree.lineups[k], orders)[:, 0])


def test_candidates_and_pool(spark):
    players = spark.createDataFrame([(h, f"p{i:02d}", float(i % 7)) for h, n in ((1, 4), (2, 6), (3, 18)) for i in range(n)], "hall_id long, player_id string, rating double")
    got = {r.hall_id: r.n for r in L.candidates(players).groupBy("hall_id").agg(F.count_distinct("lineup").alias("n")).collect()}
    assert got == {2: 720, 3: 95040}
    assert L.pool(players).where("hall_id = 3").count() == 12
    assert L.candidates(players.limit(0)).count() == 0


def test_explained(spark):
    rows = [(1, [0.6, 0.2, 0.5, 0.4, 0.7]), (2, [0.5, 0.6, 0.7, 0.8, 0.9]), (3, [0.3, 0.3, 0.3, 0.3, 0.3])]
    got = {r.k: r.x for r in spark.createDataFrame(rows, "k int, b array<double>").select("k", L.explained(F.col("b")).alias("x")).collect()}
    assert (got[1].sacrifice, got[1].favoured) == (2, [1, 3, 5]) and (got[2].sacrifice, got[2].favoured) == (None, [2, 3, 4, 5])
    assert (got[3].sacrifice, got[3].favoured) == (1, [])


def test_bounded_search_equals_all_lineups_in_little_memory(monkeypatch):
    import tracemalloc

    rng = np.random.default_rng(4)
    for n, k, case in ((5, 1, "any"), (6, 24, "any"), (9, 5, "ties"), (9, 7, "ranked"), (12, 24, "any"), (12, 24, "ranked")):
        w, d = rng.random((n, 5, 5)) * 0.7, rng.random((n, 5, 5)) * 0.3
        if case == "ties":
            w, d = w.round(1), np.zeros_like(d)
        if case == "ranked":
            w = np.clip(0.45 + np.sort(rng.normal(0, 0.2, n))[:, None, None] - np.sort(rng.normal(0, 0.2, 5))[None, :, None] + np.zeros((1, 1, 5)), 0.05, 0.9)
            d = np.full_like(w, 0.05)
        orders, share = np.array([rng.permutation(5) for _ in range(k)]), rng.dirichlet(np.ones(k))
        tree = L.Search(n)
        won = tree.wins(w, d, orders)
        for size in (7, 256):
            monkeypatch.setattr(L, "PREFIXES", size)
            best, safe = L.Bounded(w, d, orders, share).run([list(range(5))])
            for lineup, value in ((best, np.round(won @ share, 9)), (safe, np.round(won.min(axis=1), 9))):
                at = int(np.flatnonzero((tree.lineups == lineup).all(axis=1))[0])
                assert value[at] == pytest.approx(value.max(), abs=1.1e-9), (n, case)
                if case == "ties":
                    assert at == int(value.argmax())
    monkeypatch.undo()
    w, d, orders = rng.random((16, 5, 5)) * 0.7, rng.random((16, 5, 5)) * 0.3, np.array([rng.permutation(5) for _ in range(24)])
    tracemalloc.start()
    L.Bounded(w, d, orders, np.full(24, 1 / 24)).run([list(range(5))])
    assert tracemalloc.get_traced_memory()[1] < 100e6
    tracemalloc.stop()
