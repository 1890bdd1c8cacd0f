"""Round files, validation and sinks, over files that Spark writes from the league."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leaguelens.operators import validation as V
from leaguelens.plans.basics import RAW
from leaguelens.plans.base import query
from leaguelens.sources import round_files as R
from leaguelens.sources import sinks

CELLS = "name1, hall1, score1, name2, hall2, score2"


def files(lg):
    folder = R.shared_folder(lg.spark, "rounds")
    R.write_round_files(R.raw_rows(lg), folder)
    return folder


@query("src_1", RAW + f"SELECT year, round_order, CAST(row_number() OVER (PARTITION BY year, round_order ORDER BY row_no) AS INTEGER) AS row_no, {CELLS} FROM raw")
def src_1(lg):
    """Written round files read back, with the rows' places."""
    return R.read_rounds(lg.spark, files(lg)).drop("_corrupt", "file")


@query("src_2", "SELECT CAST(year AS INTEGER) AS year, 'Player ' || player_id AS name, CAST(hall_id AS VARCHAR) AS hall FROM status WHERE capped")
def src_2(lg):
    folder = R.shared_folder(lg.spark, "lists")
    s = lg.status.where("capped").select("year", F.concat(F.lit("Player "), F.col("player_id")).alias("name"), F.col("hall_id").cast("string").alias("hall"))
    s.write.partitionBy("year").option("header", True).csv(folder)
    return R.read_capped_lists(lg.spark, folder)


@query("src_3", "SELECT DISTINCT year, round_order, CASE WHEN round_order = 1 THEN 1990 ELSE year END AS file_year FROM boards")
def src_3(lg):
    """Year and round out of file names; a name without a year takes the default, here 1990."""
    name = F.when(F.col("round_order") == 1, F.lit("ROUND_1.CSV")).otherwise(F.concat(F.col("year").cast("string"), F.lit("_round_"), F.col("round_order").cast("string"), F.lit(".csv")))
    d = lg.boards.select("year", "round_order").distinct().withColumn("_n", name)
    part = lambda k: F.regexp_extract("_n", R.ROUND_FILE, k).try_cast("int")
    return d.select("year", part(2).alias("round_order"), F.coalesce(part(1), F.lit(1990)).alias("file_year"))


@query("src_4", "SELECT DISTINCT hall_id, CASE WHEN hall_id = -1 THEN 'ZZ' ELSE 'H' || hall_id END AS hall_code FROM sides UNION SELECT -1, 'ZZ'")
def src_4(lg):
    """Halls with the unknown one added, twice."""
    halls = lg.status.select("hall_id").distinct().withColumn("hall_code", F.concat(F.lit("H"), F.col("hall_id").cast("string")))
    unknown = lg.rounds.select(F.lit(-1).cast("long").alias("hall_id"), F.lit("ZZ").alias("hall_code")).distinct()
    return R.with_defaults(R.with_defaults(halls, unknown, ["hall_id"]), unknown, ["hall_id"])


# Rows spoiled by rules on their match_id, the same in SQL.
SPOILED = RAW + """, bad AS (SELECT match_id, CASE WHEN match_id % 97 = 1 THEN '' WHEN match_id % 97 IN (2, 3) THEN 'WALKOVER' ELSE name1 END AS name1, CASE WHEN match_id % 97 IN (6, 7) THEN '' ELSE hall1 END AS hall1, CASE WHEN match_id % 97 IN (4, 8) THEN 'timeout' WHEN match_id % 97 = 5 THEN 'NaN' WHEN match_id % 97 = 9 THEN '-1' ELSE score1 END AS score1,
  CASE WHEN match_id % 97 = 3 THEN 'WALKOVER' ELSE name2 END AS name2, hall2, CASE WHEN match_id % 97 = 4 THEN 'TIMEOUT' WHEN match_id % 97 = 10 THEN 'abc' WHEN match_id % 97 = 8 THEN '1e400' ELSE score2 END AS score2 FROM raw),
 nn AS (SELECT *, name1 = 'WALKOVER' AS w1, name2 = 'WALKOVER' AS w2, upper(score1) = 'TIMEOUT' AS t1, upper(score2) = 'TIMEOUT' AS t2, coalesce(try_cast(score1 AS DOUBLE) >= 0 AND isfinite(try_cast(score1 AS DOUBLE)), false) AS s1, coalesce(try_cast(score2 AS DOUBLE) >= 0 AND isfinite(try_cast(score2 AS DOUBLE)), false) AS s2 FROM bad),
 ruled AS (SELECT match_id, CASE WHEN name1 = '' OR name2 = '' THEN 'VAL-2' WHEN w1 OR w2 THEN CASE WHEN (w1 AND w2) OR (w1 AND hall2 = '') OR (w2 AND hall1 = '') OR t1 OR t2 THEN 'VAL-3' END
  WHEN t1 OR t2 THEN CASE WHEN hall1 = '' OR hall2 = '' OR (t1 AND t2) OR (t1 AND score2 <> '' AND NOT s2) OR (t2 AND score1 <> '' AND NOT s1) THEN 'VAL-4' END WHEN hall1 = '' OR hall2 = '' OR NOT s1 OR NOT s2 THEN 'VAL-5' END AS rule FROM nn)
"""


def spoiled(lg):
    k = F.col("match_id") % 97
    r = R.raw_rows(lg)
    return r.withColumns(
        {
            "name1": F.when(k == 1, "").when(k.isin(2, 3), "WALKOVER").otherwise(F.col("name1")),
            "hall1": F.when(k.isin(6, 7), "").otherwise(F.col("hall1")),
            "score1": F.when(k.isin(4, 8), "timeout").when(k == 5, "NaN").when(k == 9, "-1").otherwise(F.col("score1")),
            "name2": F.when(k == 3, "WALKOVER").otherwise(F.col("name2")),
            "score2": F.when(k == 4, "TIMEOUT").when(k == 10, "abc").when(k == 8, "1e400").otherwise(F.col("score2")),
        }
    )


@query("val_1")
def val_1(lg):
    """Headers of the written round files."""
    return V.headers(lg.spark, files(lg)).groupBy("ok").agg(F.count("*").alias("files"))


for _k in (2, 3, 4, 5):

    @query(f"val_{_k}", SPOILED + f"SELECT match_id, rule FROM ruled WHERE rule = 'VAL-{_k}'")
    def _val(lg, rule=f"VAL-{_k}"):
        return V.split_rows(spoiled(lg))[1].where(F.col("rule") == rule).select("match_id", "rule")


@query("val_6", "SELECT year, round_order FROM rounds WHERE round_order = 3")
def val_6(lg):
    """Rounds without rows, after the rows of every third one are taken away."""
    name = F.concat_ws("-", "year", "round_order")
    every = lg.rounds.select("year", "round_order", name.alias("file"))
    return V.empty_files(every, lg.boards.where("round_order <> 3").select(name.alias("file"))).select("year", "round_order")


@query("val_7", "SELECT year, round_order, (round_order = 1 OR year % 2 = 0) AS ok FROM rounds WHERE year % 2 = 0 OR round_order <> 2")
def val_7(lg):
    return V.round_order(lg.boards.where("year % 2 = 0 or round_order <> 2"))


@query("val_8", "SELECT match_id, side, CAST(hall_id AS VARCHAR) AS hall FROM sides WHERE player_id <> 'WLKOVR' AND hall_id % 10 = 3")
def val_8(lg):
    s = lg.sides.where("player_id <> 'WLKOVR'").select("match_id", "side", F.col("hall_id").cast("string").alias("hall"))
    return V.unknown_halls(s, lg.status.where("hall_id % 10 <> 3").select(F.col("hall_id").cast("string").alias("hall_name")))


@query("val_9", "SELECT year, round_order, player_id, CAST(2 AS BIGINT) AS places FROM sides WHERE player_id <> 'WLKOVR' AND match_id % 31 = 0")
def val_9(lg):
    s = lg.sides.select("year", "round_order", "player_id", "match_id")
    return V.twice_in_round(s.unionByName(s.where("match_id % 31 = 0")))


@query("val_10", "SELECT DISTINCT year, round_order FROM boards WHERE NOT rated AND round_order = 4")
def val_10(lg):
    return V.walkover_without_type(lg.sides, lg.rounds.where("round_order <> 4").select("year", "round_order"))


@query("val_11", "SELECT match_id, side, score FROM sides WHERE score > 350")
def val_11(lg):
    return V.score_warnings(lg.sides, 350.0).select("match_id", "side", "score")


@query("val_12", "SELECT year, round_order, hall_id, count(*) AS fielded FROM sides WHERE player_id <> 'WLKOVR' GROUP BY 1, 2, 3 HAVING count(*) > 4")
def val_12(lg):
    return V.fielded_warnings(lg.sides, 4)


@query("val_13", "SELECT match_id, player_id, hall_id + 1 AS hall_id, hall_id AS own_hall FROM sides WHERE player_id <> 'WLKOVR' AND match_id % 53 = 0")
def val_13(lg):
    moved = lg.sides.withColumn("hall_id", F.when(F.col("match_id") % 53 == 0, F.col("hall_id") + 1).otherwise(F.col("hall_id")))
    return V.hall_conflicts(moved, lg.status).select("match_id", "player_id", "hall_id", "own_hall")


@query("val_14", "SELECT match_id, side FROM sides WHERE match_id % 101 = 0 AND outcome = 0.5")
def val_14(lg):
    odd = lg.sides.withColumn("outcome", F.when((F.col("match_id") % 101 == 0) & (F.col("outcome") == 0.5), 0.25).otherwise(F.col("outcome")))
    return V.bad_outcomes(odd).select("match_id", "side")


@query("val_15", "SELECT 'known round' AS rule, count(*) AS n FROM sides WHERE round_id = 19981")
def val_15(lg):
    """The battery over tables from which one round is missing."""
    return V.violations(lg.participants, lg.rounds.where("round_id <> 19981"), lg.status, lg.ratings)


COUNTS = " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n FROM {t}" for t in ("rounds", "boards", "participants", "status", "names", "ratings")).replace("FROM participants", "FROM sides")


def tables(lg):
    """All tables of the league."""
    return {"rounds": lg.rounds, "boards": lg.boards, "participants": lg.participants, "status": lg.status, "names": lg.names, "ratings": lg.ratings}


def counted(read):
    """table_name and rows of each table that was read back."""
    return reduce(DataFrame.unionByName, (df.groupBy().agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n") for name, df in read.items()))


#: Of each table the key of a row, a number that places it, and a value.
ROW_COLUMNS = {
    "rounds": ("round_label", "seq", "round_id"),
    "boards": ("player_id0", "match_id", "score0"),
    "participants": ("player_id", "match_id", "outcome"),
    "status": ("player_id", "year", "hall_id"),
    "names": ("name", "first_seen_year", "last_seen_year"),
    "ratings": ("player_id", "seq", "rating_value"),
}
ROWS = " UNION ALL ".join(f"SELECT '{t}' AS table_name, {k} AS row_key, CAST({n} AS BIGINT) AS place, CAST({v} AS DOUBLE) AS value FROM {'sides' if t == 'participants' else t}" for t, (k, n, v) in ROW_COLUMNS.items())


def rows_of(read):
    """Every row of every table that was read back, by ROW_COLUMNS."""
    return reduce(DataFrame.unionByName, (read[t].select(F.lit(t).alias("table_name"), F.col(k).alias("row_key"), F.col(n).cast("long").alias("place"), F.col(v).cast("double").alias("value")) for t, (k, n, v) in ROW_COLUMNS.items()))


def dumped(lg):
    """All tables of the league and an empty one, which is skipped, dumped and read back."""
    given = {**tables(lg), "none": lg.rounds.where("seq < 0")}
    kept = sinks.dump_tables(given, R.shared_folder(lg.spark, "dump"))
    return {name: lg.spark.read.schema(given[name].schema).option("header", True).option("escape", '"').csv(path) for name, path in kept.items()}


def snapshot(lg):
    """All tables of the league written as one snapshot and read back."""
    given = tables(lg)
    root = sinks.write_snapshot(given, R.shared_folder(lg.spark, "snapshots"), "1")
    return sinks.read_snapshot(lg.spark, root, {name: df.schema for name, df in given.items()})


@query("snk_1", ROWS)
def snk_1(lg):
    """Every row of every table of a dump."""
    return rows_of(dumped(lg))


@query("snk_1_tables", COUNTS)
def snk_1_tables(lg):
    """Rows of each table of a dump."""
    return counted(dumped(lg))


@query("snk_2", ROWS)
def snk_2(lg):
    """Every row of every table of a snapshot."""
    return rows_of(snapshot(lg))


@query("snk_2_tables", COUNTS)
def snk_2_tables(lg):
    """Rows of each table of a snapshot."""
    return counted(snapshot(lg))


@query("snk_3", "SELECT player_id, round_id, CASE WHEN year = 1999 THEN rating_value + 5 ELSE rating_value END AS rating_value FROM ratings")
def snk_3(lg):
    old = lg.ratings.select("player_id", "round_id", "rating_value")
    new = lg.ratings.where("year = 1999").select("player_id", "round_id", (F.col("rating_value") + 5).alias("rating_value"))
    return sinks.upsert(old, new, ["player_id", "round_id"])


@query("snk_3_partitions", "SELECT player_id, year, round_order, CASE WHEN year = 1999 THEN rating_value + 5 ELSE rating_value END AS rating_value FROM ratings")
def snk_3_partitions(lg):
    """Rounds of one year overwritten in a partitioned table."""
    path = R.shared_folder(lg.spark, "ratings")
    rows = lg.ratings.select("player_id", F.lit("TrueElo").alias("rating_type"), "year", "round_order", "rating_value")
    sinks.replace_rounds(rows, path)
    sinks.replace_rounds(rows.where("year = 1999").withColumn("rating_value", F.col("rating_value") + 5), path)
    return lg.spark.read.schema(rows.schema).parquet(path).select("player_id", "year", "round_order", "rating_value")


@query("snk_4", "SELECT match_id, side FROM sides WHERE year <> 1998 OR round_order <= 2")
def snk_4(lg):
    return sinks.drop_later_rounds(lg.rounds, {"p": lg.participants}, 1998, 2)[1]["p"].select("match_id", "side")


@query("rep_13", "SELECT match_id, CASE WHEN round_order = 2 THEN 7 ELSE 1 END AS match_type_id FROM boards")
def rep_13(lg):
    """Match types of whole rounds assigned anew."""
    given = lg.rounds.where("round_order = 2").select("round_id", F.lit(7).alias("_new"))
    return lg.boards.select("match_id", "round_id", F.lit(1).alias("_old")).join(F.broadcast(given), "round_id", "left").select("match_id", F.coalesce("_new", "_old").alias("match_type_id"))


@query("rep_14", "SELECT round_id, CASE WHEN round_order = 3 THEN 'Derby' ELSE round_label END AS round_label FROM rounds")
def rep_14(lg):
    """Round labels edited; null leaves a label as it is."""
    edits = lg.rounds.select("round_id", F.when(F.col("round_order") == 3, "Derby").alias("_new"))
    return lg.rounds.join(edits, "round_id").select("round_id", F.coalesce("_new", "round_label").alias("round_label"))
