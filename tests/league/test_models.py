import itertools
import random

import pytest
from pyspark.sql import functions as F

from leaguelens.operators import features as X
from leaguelens.operators import lineups as L
from leaguelens.operators import models as M
from leaguelens.plans.features import features
from leaguelens.sources.league_view import league


@pytest.fixture(scope="module")
def boards(spark):
    return X.boards(features(league(spark, "/root/testdata/sf0.001"))).cache()


def test_vectors_are_antisymmetric_and_symmetric(boards):
    a = {r.match_id: r for r in X.vectors(boards, 6.0).collect()}
    b = {r.match_id: r for r in X.vectors(X.swapped(boards), 6.0).collect()}
    assert len(a) > 300
    for k, r in a.items():
        assert len(r.anti) == X.ANTI and len(r.sym) == X.SYM
        assert all(abs(x + y) < 1e-9 for x, y in zip(r.anti, b[k].anti, strict=True))
        assert all(abs(x - y) < 1e-9 for x, y in zip(r.sym, b[k].sym, strict=True))


def test_models_are_swap_symmetric_and_sum_to_one(boards):
    m = M.fit_logistic(boards, 6.0, 1.0)
    for predict in (lambda b: M.baseline(b, 0.05), lambda b: M.predict_logistic(b, m)):
        a = {r.match_id: r for r in predict(boards).collect()}
        for r in predict(X.swapped(boards)).collect():
            assert abs(r.p_win - a[r.match_id].p_loss) < 1e-9 and abs(r.p_draw - a[r.match_id].p_draw) < 1e-9
            assert abs(r.p_win + r.p_draw + r.p_loss - 1) < 1e-9


def test_later_results_do_not_change_earlier_features(spark):
    from leaguelens.operators import ratings as R

    lg = league(spark, "/root/testdata/sf0.001")
    cut = lg.sides.where("seq < 12")
    short = X.side_features(cut, R.forward_pass(cut.where("rated"), list(range(12))))
    whole = features(lg).where("seq < 12").select(*short.columns)
    same = [F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in short.dtypes]
    assert short.select(*same).exceptAll(whole.select(*same)).count() == 0


def test_team_result_equals_enumeration(spark):
    rng = random.Random(1)
    p = [(rng.random() * 0.6, rng.random() * 0.3) for _ in range(5)]
    want = [0.0, 0.0, 0.0]
    for o in itertools.product((0, 1, 2), repeat=5):
        share = 1.0
        for k, (w, d) in zip(o, p, strict=True):
            share *= (1 - w - d, d, w)[k]
        want[0 if sum(o) > 5 else 1 if sum(o) == 5 else 2] += share
    got = spark.createDataFrame([(p,)], "b array<struct<p_win:double,p_draw:double>>").select(L.team_result(F.col("b")).alias("r")).first().r
    assert all(abs(a - b) < 1e-12 for a, b in zip((got.win, got.tie, got.loss), want, strict=True))


def test_best_response_equals_trying_all(spark):
    ours = [("a", 1100.0), ("b", 1050.0), ("c", 1000.0), ("d", 950.0), ("e", 900.0)]
    theirs = [[("v", 1100.0), ("w", 1050.0), ("x", 1000.0), ("y", 950.0), ("z", 900.0)], [("z", 900.0), ("v", 1100.0), ("w", 1050.0), ("x", 1000.0), ("y", 950.0)]]
    kind = "array<struct<player_id:string,rating:double>>"
    prob = lambda a, b, seat: F.struct(F.least(F.lit(0.9), F.greatest(F.lit(0.05), 0.475 + (a["rating"] - b["rating"]) / 400)).alias("p_win"), F.lit(0.05).alias("p_draw"))
    got = L.best_response(
        spark.createDataFrame([(1, 2)], "hall_id long, opp_hall_id long"),
        spark.createDataFrame([(1, ours)], f"hall_id long, team {kind}"),
        spark.createDataFrame([(2, theirs[0], 0.75), (2, theirs[1], 0.25)], f"hall_id long, ordering {kind}, probability double"),
        prob,
    ).first()

    def win(a, b):
        state = [1.0] + [0.0] * 10
        for (_, x), (_, y) in zip(a, b, strict=True):
            w = min(0.9, max(0.05, 0.475 + (x - y) / 400))
            state = [state[i] * (0.95 - w) + (state[i - 1] * 0.05 if i else 0) + (state[i - 2] * w if i > 1 else 0) for i in range(11)]
        return sum(state[6:])

    tried = sorted((-round(0.75 * win(o, theirs[0]) + 0.25 * win(o, theirs[1]), 9), [i for i, _ in o]) for o in itertools.permutations(ours))
    safe = sorted((-round(min(win(o, t) for t in theirs), 9), [i for i, _ in o]) for o in itertools.permutations(ours))
    assert (round(got.expected_win, 9), got.best_lineup) == (-tried[0][0], tried[0][1])
    assert (round(got.safe_win, 9), got.safe_lineup) == (-safe[0][0], safe[0][1])
