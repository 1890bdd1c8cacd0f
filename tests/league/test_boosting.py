import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from leaguelens.operators import boosting as B
from leaguelens.operators import features as X
from leaguelens.operators import folds
from leaguelens.operators import models as M

SIDE = [c for c in X.SIDE if c not in ("seat", "trajectory", "missed", "seat_trend")]


def boards(spark, n, rounds, outcome, seed=1, draws=0.0, few=None):
    """Boards whose sides differ in seat, trajectory, missed and seat_trend alone; outcome: of a, by those differences."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        x = (np.where(rng.random(4) < (few or 0.5), 1.0, -1.0) * rng.choice((1.0, 2.0), 4)).tolist()
        a, b = (dict.fromkeys(SIDE, 0.0) | {"rating": 1000.0, "rd": 100.0, "seat_prior": 1000.0} for _ in range(2))
        a |= {"seat": 3.0 + x[0], "trajectory": x[1], "missed": x[2], "seat_trend": x[3]}
        b |= {"seat": 3.0, "trajectory": 0.0, "missed": 0.0, "seat_trend": 0.0}
        y = 0.5 if rng.random() < draws else float(bool(outcome(x, rng)))
        rows.append((i, i % rounds, 1, 37.0, tuple(a[c] for c in X.SIDE) + ("p1", 1), tuple(b[c] for c in X.SIDE) + ("p2", 2), y))
    kind = ", ".join(f"{c}: double" for c in X.SIDE) + ", player_id: string, hall_id: long"
    return spark.createDataFrame(rows, f"match_id long, seq long, round_order int, max_score_norm double, a struct<{kind}>, b struct<{kind}>, outcome_a double")


@pytest.fixture(autouse=True)
def few_trees(monkeypatch):
    monkeypatch.setattr(B, "MAX_TREES", 25)


def quality(p):
    return {r.model: r for r in M.scores(p, ["model"]).collect()}


def test_split_gains_equal_a_plain_search(spark):
    rng = np.random.default_rng(2)
    x, y = rng.integers(0, 5, (60, 2)).astype(float), rng.random(60).round(2)
    rows = spark.createDataFrame([(r.tolist(), float(g), 0.25) for r, g in zip(x, y - 0.5, strict=True)], "x array<double>, g double, h double")
    got = {(r.feature, r.threshold): (r.gain, r.left, r.right) for r in B.split_gains(rows, 1.0).collect()}
    want, part = {}, lambda g, h: g * g / (h + 1)
    for f in range(2):
        for a, b in zip(sorted(set(x[:, f])), sorted(set(x[:, f]))[1:], strict=False):
            left = x[:, f] < (a + b) / 2
            gl, gr, hl, hr = (y[left] - 0.5).sum(), (y[~left] - 0.5).sum(), 0.25 * left.sum(), 0.25 * (~left).sum()
            if min(hl, hr) >= 4:
                want[f, (a + b) / 2] = (0.5 * (part(gl, hl) + part(gr, hr) - part(gl + gr, hl + hr)), -gl / (hl + 1), -gr / (hr + 1))
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_known_step_leaf_values_and_missing_direction():
    g, h = np.zeros((2, B.BINS)), np.zeros((2, B.BINS))
    g[0, :4], h[0, :4] = (-5, -5, 5, 5), 5  # a step between the second and the third bin
    g[1, 0], h[1, 0], g[1, -1], h[1, -1] = 0, 10, 0, 10
    gain, feature, cut, _ = B.best_split(g, h, 1.0)
    assert (feature, cut) == (0, 1) and gain == pytest.approx(0.5 * (100 / 11 + 100 / 11) - B.LEAST_GAIN)
    g, h = np.zeros((1, B.BINS)), np.zeros((1, B.BINS))
    g[0, :2], h[0, :2], g[0, -1], h[0, -1] = (-6, 6), 6, -6, 6  # missing values are like the left
    assert B.best_split(g, h, 1.0)[1:] == (0, 0, True)
    f = B.Fit(B.WIN, 6.0, 1.0, 1, 1)
    B._split(f, np.stack([g, h])[:, None], 0)
    assert f.grown.value[1] == pytest.approx(12 / 13) and f.grown.value[2] == pytest.approx(-6 / 7)
    bins = np.array([[0], [1], [B.MISSING]], np.uint8)
    assert f.grown.nodes(bins).tolist() == [1, 2, 1]
    assert B.best_split(np.zeros((1, B.BINS)), np.ones((1, B.BINS)), 1.0)[0] == 0


def test_an_interaction_that_defeats_logistic(spark):
    b = boards(spark, 2400, 12, lambda x, rng: x[1] * x[2] * x[3] > 0, few=0.7)
    grid = (M.Candidate("baseline", M.BASELINE), M.Candidate("l", M.LOGISTIC, 6.0, 1.0), M.Candidate("g", M.BOOSTED, 6.0, 1.0))
    q = quality(M.walk_forward(b, grid, [11]))
    assert q["g"].accuracy > 0.9 and q["l"].accuracy < 0.8 and q["g"].brier < 0.6 * q["l"].brier
    best = M.champion(M.scores(M.walk_forward(b, grid, [11]), ["model"]), "baseline").collect()
    assert [r.model for r in best] == ["g"]


def test_boosting_is_swap_symmetric(spark):
    b = boards(spark, 600, 8, lambda x, rng: rng.random() < (0.8 if x[0] > 0 else 0.2), draws=0.1)
    _, models = B.fit_rounds(b, [("g", 6.0, 1.0)], [8])
    m = {"g": models["g", 8]}
    assert m["g"].win.trees
    one = {r.match_id: r for r in B.predict(b, m, ["match_id"]).collect()}
    for r in B.predict(X.swapped(b), m, ["match_id"]).collect():
        o = one[r.match_id]
        assert abs(o.p_win - r.p_loss) < 1e-9 and abs(o.p_draw - r.p_draw) < 1e-9 and abs(o.p_win + o.p_draw + o.p_loss - 1) < 1e-9
    assert B.predict(b.limit(0), m, ["match_id"]).count() == 0


def test_noise_crowns_no_one_by_far_and_signal_is_found(spark):
    noise = boards(spark, 900, 14, lambda x, rng: rng.random() < 0.5)
    grid = (M.Candidate("baseline", M.BASELINE), M.Candidate("l", M.LOGISTIC, 6.0, 3.0))
    q = quality(M.walk_forward(noise, grid, list(range(M.burn_in(noise.withColumn("year", F.lit(1))), 14))))
    assert q["l"].brier > q["baseline"].brier - 0.01
    signal = boards(spark, 900, 14, lambda x, rng: rng.random() < (0.85 if x[0] > 0 else 0.15))
    q = quality(M.walk_forward(signal, grid, list(range(10, 14))))
    assert q["l"].brier < q["baseline"].brier - 0.05


def test_folds_equal_single_fits_and_see_no_later_round(spark):
    b = boards(spark, 500, 12, lambda x, rng: rng.random() < (0.8 if x[0] > 0 else 0.3), draws=0.1).cache()
    rows = folds.table(b, (3.0, 6.0))
    many = folds.fit_rounds(rows, [("p", 3.0, 1.0), ("q", 6.0, 0.3)], [10, 11])
    for (name, r), m in many.items():
        one = M.fit_logistic(b.where(F.col("seq") < r), *{"p": (3.0, 1.0), "q": (6.0, 0.3)}[name])
        assert np.allclose(one.win, m.win, atol=1e-8) and np.allclose(one.draw, m.draw, atol=1e-8)
        got = {x.match_id: x.p_win for x in folds.predict_rounds(rows, {(name, r): m}).collect()}
        want = {x.match_id: x.p_win for x in M.predict_logistic(b.where(F.col("seq") == r), one).collect()}
        assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], abs_tol=1e-8) for k in got)
    later = b.withColumn("outcome_a", F.when(F.col("seq") >= 11, 1 - F.col("outcome_a")).otherwise(F.col("outcome_a")))
    grid = (M.Candidate("l", M.LOGISTIC, 6.0, 1.0), M.Candidate("g", M.BOOSTED, 6.0, 1.0), M.Candidate("baseline", M.BASELINE))
    p, q = ({(x.model, x.match_id): x.p_win for x in M.walk_forward(d, grid, [10, 11]).collect()} for d in (b, later))
    assert p.keys() == q.keys() and all(math.isclose(p[k], q[k], abs_tol=1e-9) for k in p)


def test_champion_needs_boards_and_a_better_score(spark):
    rows = [("baseline", 60, 0.5), ("a", 49, 0.1), ("b", 60, 0.5), ("c", 60, 0.4), ("d", 60, 0.4)]
    q = spark.createDataFrame(rows, "model string, boards long, brier double")
    assert [r.model for r in M.champion(q, "baseline").collect()] == ["c"]
    assert M.champion(q.where("model in ('baseline', 'a', 'b')"), "baseline").count() == 0 == M.champion(q.limit(0), "baseline").count()


def test_reliability(spark):
    rows = [(100.0, 20, 0.2, 0.0, 10.0), (260.0, 2, 0.8, 151.0, 101.0), (200.0, 5, 0.6, -200.0, 0.0)]
    d = spark.createDataFrame(rows, "rd double, n int, i double, q double, s double").select(M.reliability("rd", "n", "i", "q", "s").alias("r"))
    got = [(r.r.score, r.r.tier, len(r.r.flags)) for r in d.collect()]
    assert got == [(100, "High", 0), (0, "Low", 5), (50, "Low", 4)]
