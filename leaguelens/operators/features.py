"""Matchup features: what is known of a side before a round, as windows over its own, its hall's and the league's past."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leaguelens.functions import scalars as S
from leaguelens.operators import ratings, running
from leaguelens.operators.checkpoints import written

#: Share of the largest score that makes a clear win, and the scale where a match type has no largest score.
BLOWOUT, NO_SCORE = 0.75, 10.0
ANTI, SYM = 20, 6
#: Columns of a side besides its keys.
SIDE = (
    "seat rating rd career_boards career_timeouts sum_last5 count_last5 seat_prior trajectory stability hall_bias season_boards opp_quality_bias insularity missed seat_trend margin_form blowout_rate walkovers_received forced_timeout_rate vs_hall_rate"
).split()


def margin_scale(max_score):
    """FEA-3: what margins are divided by: the match type's largest score, or NO_SCORE where it has none."""
    c = S.col(max_score)
    return F.when(c > 0, c).otherwise(F.lit(NO_SCORE)).cast("double")


def side_features(sides: DataFrame, trajectory: DataFrame, max_score: float | str = 370.0) -> DataFrame:
    """FEA-1 and FEA-2: one row per side of a rated board with the features before its round.

    max_score: the match type's largest score, a number or a column of sides. Walkover boards count for the seat, hall and league means of entry ratings and for the walkovers received only.
    """
    scale = margin_scale(max_score if isinstance(max_score, str) else F.lit(max_score))
    sides = sides.withColumn("max_score_norm", scale / 10)
    keys = ["match_id", "max_score_norm", "side", "player_id", "hall_id", "seat", "year", "round_order", "seq", "rated", "participation_type", "score", "outcome", "opp_player_id", "opp_hall_id", "opp_score", "opp_participation_type"]
    real = sides.where("player_id <> 'WLKOVR'").select(*keys)
    entry = written(ratings.entry_states(real, trajectory))  # read by four windows
    seat = running.running_over_rounds(entry.where("seat is not null"), ["hall_id", "seat"], "rating", ("_ss", "_sn"))
    hall = running.running_over_rounds(entry, ["hall_id"], "rating", ("_hs", "_hn"))
    league = running.running_over_rounds(entry, [], "rating", ("_ls", "_ln"))
    before = lambda *k: Window.partitionBy(*k).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    frame = lambda n: Window.partitionBy("player_id").orderBy("seq").rowsBetween(-n, -1)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    counted = entry.withColumn("walkovers_received", F.count_if(~F.col("rated")).over(before("player_id")))
    r = counted.where("rated").withColumn("_m", (F.col("score") - F.col("opp_score")) / (F.col("max_score_norm") * 10))
    opp = r.select("match_id", F.col("player_id").alias("opp_player_id"), F.col("rating").alias("_opp_rating"))
    r = r.join(opp, ["match_id", "opp_player_id"])
    r = r.withColumn("_met", F.count("*").over(Window.partitionBy("player_id", "opp_hall_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)))
    slope = lambda c: F.when(F.count(c).over(frame(3)) >= 2, (F.lag(c, 1).over(Window.partitionBy("player_id").orderBy("seq")) - F.first(c).over(frame(3))) / (F.count(c).over(frame(3)) - 1)).otherwise(0.0)
    me = before("player_id")
    r = r.select(
        *keys, "rating", "rd", "walkovers_received",
        F.count("*").over(me).alias("career_boards"),
        F.count_if(F.col("participation_type") == "TIMEOUT").over(me).alias("career_timeouts"),
        zero(F.sum("outcome").over(frame(5))).alias("sum_last5"),
        F.count("outcome").over(frame(5)).alias("count_last5"),
        slope("rating").alias("trajectory"),
        zero(F.stddev_pop("rating").over(frame(5))).alias("stability"),
        F.count("*").over(before("player_id", "year")).alias("season_boards"),
        F.avg("_opp_rating").over(me).alias("_opp_mean"),
        zero(F.max("_met").over(me) / F.count("*").over(me)).alias("insularity"),
        F.greatest(F.lit(0), F.coalesce(F.col("round_order") - F.lag("round_order").over(Window.partitionBy("player_id", "year").orderBy("seq")) - 1, F.lit(0))).alias("missed"),
        slope("seat").alias("seat_trend"),
        zero(F.avg("_m").over(frame(5))).alias("margin_form"),
        zero(F.avg((F.abs("_m") >= BLOWOUT).cast("double")).over(frame(5))).alias("blowout_rate"),
        ((F.count_if((F.col("outcome") == 1.0) & (F.col("opp_participation_type") == "TIMEOUT")).over(me) + 1.0) / (F.count("*").over(me) + 10.0)).alias("forced_timeout_rate"),
        ((zero(F.sum("outcome").over(before("player_id", "opp_hall_id"))) + 1.5) / (F.count("*").over(before("player_id", "opp_hall_id")) + 3.0)).alias("vs_hall_rate"),
    )
    r = r.join(seat, ["hall_id", "seat", "seq"], "left").join(hall, ["hall_id", "seq"], "left").join(F.broadcast(league), "seq", "left")  # league: a row per round
    mean = lambda s, n: F.when(F.col(n) > 0, F.col(s) / F.col(n))
    everyone = F.coalesce(mean("_ls", "_ln"), F.lit(ratings.BASE_RATING))
    return r.withColumns(
        {
            "seat_prior": F.coalesce(mean("_ss", "_sn"), mean("_hs", "_hn"), everyone),
            "hall_bias": F.col("rating") - F.coalesce(mean("_hs", "_hn"), F.col("rating")),
            "opp_quality_bias": F.coalesce(F.col("_opp_mean") - everyone, F.lit(0.0)),
        }
    ).drop("_ss", "_sn", "_hs", "_hn", "_ls", "_ln", "_opp_mean")


def boards(features: DataFrame) -> DataFrame:
    """FEA-1 and FEA-3: one row per rated board with both sides as structs a and b, a being the smaller player_id."""
    s = F.struct("player_id", "hall_id", "outcome", "participation_type", *SIDE)
    two = features.groupBy("match_id", "year", "round_order", "seq", "max_score_norm").agg(F.array_sort(F.collect_list(s)).alias("two")).where(F.size("two") == 2)
    return two.select("match_id", "year", "round_order", "seq", F.col("two")[0].alias("a"), F.col("two")[1].alias("b"), F.col("two")[0]["outcome"].alias("outcome_a"), "max_score_norm")


def effective(side: str, n0: float):
    """FEA-4: own rating and seat prior, weighted by experience."""
    w = F.col(f"{side}.career_boards") / (F.col(f"{side}.career_boards") + n0)
    return w * F.col(f"{side}.rating") + (1 - w) * F.col(f"{side}.seat_prior")


def vectors(b: DataFrame, n0: float, missing_seat: bool = False) -> DataFrame:
    """FEA-5: the boards with arrays anti (changes sign when the sides are swapped) and sym (does not change)."""
    of = lambda name: (F.col(f"a.{name}"), F.col(f"b.{name}"))
    diff = lambda name: of(name)[0] - of(name)[1]
    log = lambda name: F.log1p(of(name)[0].cast("double")) - F.log1p(of(name)[1].cast("double"))
    rate = lambda top, add, bottom, more: (F.col(f"a.{top}") + add) / (F.col(f"a.{bottom}") + more) - (F.col(f"b.{top}") + add) / (F.col(f"b.{bottom}") + more)
    gap = effective("a", n0) - effective("b", n0)
    seat = S.seat_or_default("a.seat") - S.seat_or_default("b.seat")
    if missing_seat:
        seat = F.when(F.col("a.seat").isNull() | F.col("b.seat").isNull(), float("nan")).otherwise(seat)
    damp = 1 / (1 + (F.col("a.rd") + F.col("b.rd")) / 350)
    anti = [
        S.combined_g("a.rd", "b.rd") * gap / S.SCALE, gap / 400, seat, log("career_boards"), rate("career_timeouts", 1.0, "career_boards", 10.0), rate("sum_last5", 1.5, "count_last5", 3.0),
        gap / 400 * damp, diff("trajectory"), diff("hall_bias"), log("season_boards"), diff("opp_quality_bias"), diff("insularity"), diff("missed"), diff("seat_trend"), diff("margin_form"), diff("blowout_rate"),
        log("walkovers_received"), diff("forced_timeout_rate"), diff("vs_hall_rate"), diff("stability"),
    ]
    sym = [
        F.abs(gap) / 400, (F.col("a.rd") + F.col("b.rd")) / 700, (F.log1p(F.col("a.career_boards").cast("double")) + F.log1p(F.col("b.career_boards").cast("double"))) / 2,
        F.col("round_order") / 10, (F.col("a.hall_id") == F.col("b.hall_id")).cast("double"), F.col("max_score_norm"),
    ]
    return b.withColumns({"anti": F.array(*(x.cast("double") for x in anti)), "sym": F.array(*(x.cast("double") for x in sym))})


def swapped(b: DataFrame) -> DataFrame:
    """FEA-6: the boards with their sides exchanged."""
    return b.withColumns({"a": F.col("b"), "b": F.col("a"), "outcome_a": 1 - F.col("outcome_a")})


def with_seat(b: DataFrame, side: str, seat) -> DataFrame:
    """FEA-6: the boards with one side's seat replaced."""
    return b.withColumn(side, F.col(side).withField("seat", S.col(seat)))


def latest_sides(features: DataFrame) -> DataFrame:
    """FEA-7: each player's side as it entered the last round played."""
    s = F.struct("player_id", "hall_id", "outcome", "participation_type", *SIDE)
    return features.groupBy("player_id").agg(F.max_by(s, "seq").alias("s"))


def hypothetical(pairs: DataFrame, latest: DataFrame, round_order: int, max_score: float = 370.0) -> DataFrame:
    """FEA-7: a board for any two players of pairs (player_a, player_b), each as it entered its last round."""
    one = lambda k: latest.select(F.col("player_id").alias(f"player_{k}"), F.col("s").alias(k))
    both = pairs.join(one("a"), "player_a").join(one("b"), "player_b")
    return both.withColumns({"round_order": F.lit(round_order), "max_score_norm": F.lit(max_score / 10)})
