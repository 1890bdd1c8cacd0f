from pyspark.sql import functions as F

from leaguelens.operators import models as M
from leaguelens.plans import registry
from leaguelens.sources.league_view import league

DIR = "/root/testdata/sf0.001"


def test_lineups_and_streams_have_all_seasons(spark):
    seasons = [r.year for r in registry.QUERIES["agg_1"](spark, DIR).collect()]
    sides = league(spark, DIR).sides.where("side = 0 and hall_id <> -1 and opp_hall_id <> -1")
    five = sides.groupBy("year", "round_order", "hall_id", "opp_hall_id").count().where("count = 5").select("year", "round_order", "hall_id", "opp_hall_id")
    got = registry.QUERIES["lin_7"](spark, DIR).select(*five.columns)
    assert got.exceptAll(five).count() == five.exceptAll(got).count() == 0 and five.select("year").distinct().count() > 5
    loaded = registry.QUERIES["str_1_all"](spark, DIR)
    assert {r.year for r in loaded.collect()} == set(seasons)


def test_every_round_is_solved(spark):
    a, b = (registry.QUERIES[k](spark, DIR).select("player_id", "seq", *(F.round(c, 7).alias(c) for c in ("rating", "rd", "volatility"))) for k in ("rat_6", "rat_7"))
    assert a.select("seq").distinct().count() > 20
    assert a.exceptAll(b).count() == b.exceptAll(a).count() == 0


def test_dump_and_snapshot_have_all_tables(spark):
    for k in ("snk_1_tables", "snk_2_tables"):
        n = {r.table_name: r.n for r in registry.QUERIES[k](spark, DIR).collect()}
        assert set(n) == {"rounds", "boards", "participants", "status", "names", "ratings"}
        assert n["participants"] == 2 * n["boards"] and all(n.values())


def test_prediction_log_has_every_board(spark):
    log = registry.QUERIES["mdl_14_all"](spark, DIR)
    n = league(spark, DIR).boards.where("not is_walkover").count()
    assert {r.model: r["count"] for r in log.groupBy("model").count().collect()} == {"elo": n, "flat": n}
    p = spark.createDataFrame([(1, "m", 0.475 - 1e-15, 0.05, 0.475), (2, "m", 0.4, 0.2, 0.4000001), (3, "m", 0.2, 0.4, 0.4)], "match_id long, model string, p_win double, p_draw double, p_loss double")
    assert {r.match_id: r.predicted for r in M.prediction_log(p).collect()} == {1: "a", 2: "b", 3: "draw"}
