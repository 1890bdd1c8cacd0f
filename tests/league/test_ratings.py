import math
import random

import numpy as np

from leaguelens.operators import ratings as R

Q = 173.7178


def one(player, opponent, outcome):
    """A literal single update, with a plain bisection for the volatility."""
    r, rd, s = player
    g = 1 / math.sqrt(1 + 3 * (opponent[1] / Q) ** 2 / math.pi**2)
    e = 1 / (1 + math.exp(-g * (r - opponent[0]) / Q))
    v = 1 / (g * g * e * (1 - e))
    delta = v * g * (outcome - e)
    phi, a = rd / Q, math.log(s * s)
    f = lambda x: math.exp(x) * (delta**2 - phi**2 - v - math.exp(x)) / (2 * (phi**2 + v + math.exp(x)) ** 2) - (x - a) / 1.44
    low, high = a - 30, a + 30
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) > 0 else (low, mid)
    sigma = math.exp(low / 2)
    star = math.sqrt(phi * phi + sigma * sigma)
    new = 1 / math.sqrt(1 / star**2 + 1 / v)
    return r + new * new * g * (outcome - e) * Q, new * Q, sigma


def literal(games, players, rounds, passes):
    before = None
    for _ in range(passes):
        state, out = {p: (1000.0, 350.0, 0.06) for p in players}, {}
        for q in range(rounds):
            entry = dict(state)
            now = [g for g in games if g[0] == q]
            busy = {p for g in now for p in g[1:3]}
            state = {p: s if p in busy else (s[0], min(math.sqrt((s[1] / Q) ** 2 + s[2] ** 2) * Q, 350.0), s[2]) for p, s in entry.items()}
            source = state if before is None else before[q]
            for _ in range(3 if before is None else 1):
                new = dict(state)
                for _, a, b, w in now:
                    new[a], new[b] = one(entry[a], source[b], w), one(entry[b], source[a], 1 - w)
                state = new
                if before is None:
                    source = state
            out[q] = dict(state)
        before = out
    return before


def test_whole_history_equals_the_literal_algorithm(spark):
    rng = random.Random(3)
    players, rounds = [f"p{i:02d}" for i in range(12)], 7
    games = []
    for q in range(rounds):
        pool = rng.sample(players, rng.choice((6, 8, 10)))
        games += [(q, pool[i], pool[i + 1], rng.choice((0.0, 0.5, 1.0))) for i in range(0, len(pool), 2)]
    rows = [(q, k, a, b, w) for q, *g in games for k, (a, b, w) in enumerate(((g[0], g[1], g[2]), (g[1], g[0], 1 - g[2])))]
    played = spark.createDataFrame(rows, "seq long, side int, player_id string, opp_player_id string, outcome double")
    for passes in (1, 3):
        want = literal(games, players, rounds, passes)
        got = R.whole_history(played, list(range(rounds)), passes).collect()
        assert len(got) == 2 * len(games)
        for r in got:
            np.testing.assert_allclose((r.rating, r.rd, r.volatility), want[r.seq][r.player_id], rtol=0, atol=2e-4)
    idle = R.at_rounds(spark.createDataFrame([(p, rounds - 1) for p in players], "player_id string, seq long"), R.whole_history(played, list(range(rounds)), 3)).collect()
    for r in idle:
        np.testing.assert_allclose((r.rating, r.rd), want[rounds - 1][r.player_id][:2], atol=2e-4)


def test_symmetric_draw_changes_nothing_but_the_deviation():
    a = tuple(np.array([x]) for x in (1000.0, 350.0, 0.06))
    x, y = R.solved(a, a, np.array([0.5]))
    assert x[0] == y[0] == 1000.0 and x[1] == y[1] < 350
    up, down = R.solved(a, a, np.array([1.0]))
    assert up[0] > 1000 > down[0] and abs(up[0] + down[0] - 2000) < 1e-9


def test_a_round_takes_few_jobs(spark):
    n, rounds = 40, 6
    games = [(q, f"p{(7 * q + 2 * i) % n:02d}", f"p{(7 * q + 2 * i + 1) % n:02d}") for q in range(rounds) for i in range(n // 2)]
    played = spark.createDataFrame([(q, k, x, y, float(k)) for q, a, b in games for k, (x, y) in enumerate(((a, b), (b, a)))], "seq long, side int, player_id string, opp_player_id string, outcome double")
    context = spark.sparkContext
    context.setJobGroup("rounds", "")
    try:
        assert R.forward_pass(played, list(range(rounds))).count() == n * rounds
        assert len(context.statusTracker().getJobIdsForGroup("rounds")) <= 3 * rounds + 6
    finally:
        context.setJobGroup("", "")
