import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from leaguelens.operators import embedding as E
from leaguelens.operators import families as FM
from leaguelens.operators import models as M
from leaguelens.operators import ratings as R
from leaguelens.operators import registry as G
from leaguelens.streaming import files as T
from leaguelens.streaming import lifecycle as L
from tests.league.test_boosting import boards as plain_boards

GRID = (M.Candidate("baseline", M.BASELINE), M.Candidate("l", M.LOGISTIC, 6.0, 1.0))


def send(src, year, order, shift=0):
    """A round of twelve players, six boards, as a new file; `shift` changes who plays whom."""
    rng = random.Random(year * 100 + order * 7 + shift)
    who = list(range(12))
    rng.shuffle(who)
    rows = [f"P{a:02},{a % 3},{200 + (11 - a) * 5 + rng.randrange(30)},P{b:02},{b % 3},{200 + (11 - b) * 5 + rng.randrange(30)}" for a, b in zip(who[::2], who[1::2], strict=True)]
    rows[-1] = f"P{who[-2]:02},{who[-2] % 3},,WALKOVER,,"
    folder = src / f"year={year}" / f"round_order={order}"
    folder.mkdir(parents=True, exist_ok=True)
    (folder / f"f{len(list(folder.iterdir()))}.csv").write_text("name1,hall1,score1,name2,hall2,score2\n" + "\n".join(rows) + "\n")


def numbers(df, *columns):
    return {(r.player_id, r.seq): tuple(r[c] for c in columns) for r in df.collect()}


def close(a, b):
    assert a.keys() == b.keys()
    assert all(math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9) for k in a for x, y in zip(a[k], b[k], strict=True))


def test_a_stream_of_rounds_ends_as_a_full_recalculation(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    life = L.Lifecycle(spark, out, str(tmp_path / "life"), L.sides_of_files, GRID, burn_in=3, least=5, passes=2)

    def drain():
        T.load_rounds(T.stream_rounds(spark, str(src), 1000), out, str(tmp_path / "state"), life.steps()).awaitTermination()
        return T.last_batch(spark, out)

    for order in range(1, 7):
        send(src, 2001, order)
    n = drain()
    assert life.registry.predictions().count() == 0  # no champion yet
    before = life.registry.champion()
    assert before.version and before.number == 0
    send(src, 2001, 7)
    n = drain()
    log = life.registry.predictions().collect()
    assert len(log) == 5 and {r.model_version for r in log} == {before.version} and {r.seq for r in log} == {6}
    send(src, 2001, 5, shift=1)  # again, with other boards: the sixth and seventh go
    n = drain()
    assert life.history(n).count() == 5
    send(src, 2001, 6)
    send(src, 2002, 1)
    n = drain()
    assert {(r.step, r.ok) for r in T.steps_done(spark, out).collect()} == {(s, True) for s, _ in life.steps()}
    assert life.registry.champion().number == 3 and life.registry.models().count() == 8

    order = {(r.year, r.round_order): r.seq for r in life.history(n).collect()}
    assert sorted(order) == [(2001, r) for r in range(1, 7)] + [(2002, 1)]
    rows = T.loaded_rounds(spark, out).join(spark.createDataFrame([(*k, v) for k, v in order.items()], "year int, round_order int, seq long"), ["year", "round_order"])
    sides = L.sides_of_files(rows).cache()
    full = R.whole_history(sides.where("rated"), list(range(7)), 2)
    close(numbers(life.ratings(n), "rating", "rd", "volatility"), numbers(full, "rating", "rd", "volatility"))
    exp = life.distilled(n)
    assert numbers(exp, "rating", "rd", "volatility").keys() == numbers(full, "rating").keys()
    twice = L.Lifecycle(spark, out, str(tmp_path / "life"), L.sides_of_files, GRID, burn_in=3, least=5, passes=2)
    for name, step in twice.steps():  # the same batch again, after a restart
        if name != "retrain":
            step(None, n)
    close(numbers(twice.ratings(n), "rating"), numbers(full, "rating"))
    assert twice.cache(n).count() == 12


def test_codecs_keep_every_bit(spark, tmp_path):
    b = plain_boards(spark, 300, 8, lambda x, rng: rng.random() < (0.8 if x[0] > 0 else 0.2), draws=0.1).cache()
    for k, c in enumerate((GRID[0], GRID[1], M.Candidate("g", M.BOOSTED, 6.0, 1.0), M.Candidate("v", M.EMBEDDED, 6.0, 1.0, 4))):
        f = FM.family(c.family)
        model = f.fit(b, c)
        tables = str(tmp_path / f"t{k}")
        text = f.encode(model, tables)
        again = f.decode(spark, text, tables)
        assert f.encode(again, str(tmp_path / f"u{k}")) == text
        p, q = ({r.match_id: (r.p_win, r.p_draw) for r in f.predict(b, m, ["match_id"]).collect()} for m in (model, again))
        assert p == q


def test_one_of_two_writers_names_the_champion(spark, tmp_path):
    one, other = G.Registry(spark, str(tmp_path)), G.Registry(spark, str(tmp_path))
    assert one.pointer() == (-1, None) and one.champion().version is None
    seen = [one.pointer()[0], other.pointer()[0]]
    assert [one.swap(seen[0], {"version": "a", "cycle": "x"}), other.swap(seen[1], {"version": "b", "cycle": "y"})] == [True, False]
    assert other.pointer() == (0, {"version": "a", "cycle": "x"})
    assert other.swap(0, {"version": "b", "cycle": "y"}) and one.pointer()[1]["version"] == "b"


def test_retraining_needs_boards_and_rounds_and_exports_vectors(spark, tmp_path):
    b = plain_boards(spark, 240, 12, lambda x, rng: x[0] > 0).withColumn("year", F.lit(2001)).cache()
    r = G.Registry(spark, str(tmp_path))
    assert not r.retrain(b.limit(19), GRID).trained and not r.retrain(b.where("seq < 9"), GRID).trained and r.models().count() == 0
    out = r.retrain(b, (*GRID, M.Candidate("v", M.EMBEDDED, 6.0, 1.0, 4)), burn_in=10, least=10)
    rows = r.models().collect()
    assert out.trained and [x.name for x in rows if x.is_champion] == [out.name] != ["baseline"] and len(rows) == 3
    assert out.version.startswith({"l": "logistic", "v": "gbm_emb"}[out.name] + ".r12.") and r.champion().version == out.version
    version = next(x.model_version for x in rows if x.family == M.EMBEDDED)
    first = sorted((x.player_id, x.year, tuple(x.vector)) for x in r.vectors(version).collect())
    assert [x[:2] for x in first] == [("p1", 2001), ("p2", 2001)]
    again = r.retrain(b.where("seq < 11"), (GRID[0], M.Candidate("v", M.EMBEDDED, 6.0, 1.0, 4)), burn_in=10, least=1000)
    assert again.name == "baseline" and r.champion().number == 1
    assert sorted((x.player_id, x.year, tuple(x.vector)) for x in r.vectors(version).collect()) == first  # older versions stay
    assert r.vectors().select("model_version").distinct().count() == 2


def test_distilled_ratings_say_what_the_champion_says(spark):
    b = plain_boards(spark, 12, 12, lambda x, rng: x[0] > 0)
    best = G.Champion(0, "v", "baseline", M.BASELINE, 0.1)
    rated = spark.createDataFrame([("p1", 3, 50.0, 0.06), ("p1", 11, 51.0, 0.05), ("idle", 3, 350.0, 0.06)], "player_id string, seq long, rd double, volatility double")
    got = {(r.player_id, r.seq): r for r in G.distilled_rows(b, best, rated, list(range(12))).collect()}
    e = G.expected(b, best).where("seq = 11").first().expected
    gap = R.S.SCALE * math.log(e / (1 - e))
    assert got["idle", 3].exp_rating == 1000.0 and got["p1", 11].rd == 51.0 and len(got) == 3
    assert got["p1", 11].exp_rating == pytest.approx(1000 + gap / 2)  # both began at 1000 and have met alone


def test_live_round_carries_the_halls_other_players(spark):
    played = spark.createDataFrame([(1, 5, 2001, 0, "a", 1, 1.0), (1, 5, 2001, 1, "b", 2, 0.0)], "match_id long, seq long, year int, side int, player_id string, hall_id long, outcome double")
    status = spark.createDataFrame([("a", 2001, 1), ("c", 2001, 1), ("d", 2001, 3), ("e", 2000, 1)], "player_id string, year int, hall_id long")
    states = spark.createDataFrame([("c", 3, 1100.0, 100.0, 0.06), ("a", 3, 1000.0, 350.0, 0.06)], L._STATES)
    got = {r.player_id: r for r in R.live_round(played, status, states, 5).collect()}
    assert set(got) == {"a", "b", "c"} and got["c"].carried and not got["a"].carried
    assert got["c"].rating == 1100.0 and got["c"].rd == pytest.approx(float(R.idle(np.array([100.0]), np.array([0.06]), 2)[0]))
    assert got["a"].rating > 1000 > got["b"].rating
    assert E.HALL_DIM == 2


def test_a_cycle_predicts_only_new_rounds_anew(spark, tmp_path, monkeypatch):
    fitted, real = [], FM.folds.fit_rounds
    monkeypatch.setattr(FM.folds, "fit_rounds", lambda rows, configs, before: fitted.append(before) or real(rows, configs, before))
    b = plain_boards(spark, 240, 12, lambda x, rng: rng.random() < (0.7 if x[0] > 0 else 0.3)).withColumn("year", F.lit(2001)).cache()
    grid = (*GRID, M.Candidate("v", M.EMBEDDED, 6.0, 1.0, 4))
    r, fresh = G.Registry(spark, str(tmp_path / "one")), G.Registry(spark, str(tmp_path / "two"))
    r.retrain(b.where("seq < 11"), grid, burn_in=8, least=10)
    r.retrain(b, grid, burn_in=8, least=10)
    assert fitted == [[8, 9, 10, 11], [11, 12]]  # the last one of each is the fit to all boards
    fresh.retrain(b, grid, burn_in=8, least=10)
    near = lambda g: {x.name: {k: round(v, 9) if isinstance(v, float) else v for k, v in json.loads(x.metrics).items()} for x in g.models().where("trained_rounds = 12").collect()}
    assert near(r) == near(fresh) and len(near(r)) == 3
    changed = b.withColumn("outcome_a", F.when(F.col("match_id") == 9, 1 - F.col("outcome_a")).otherwise(F.col("outcome_a")))  # of round 9
    r.retrain(changed, grid, burn_in=8, least=10)
    assert fitted[-1] == [9, 10, 11, 12]
