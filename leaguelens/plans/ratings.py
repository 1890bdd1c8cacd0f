"""Ratings of the league."""

from pyspark.sql import functions as F

from leaguelens.operators import asof, setops
from leaguelens.operators import ratings as R
from leaguelens.operators.checkpoints import written
from leaguelens.plans.base import query

_KEPT: dict[tuple, object] = {}


def round_list(lg) -> list[int]:
    """The league's rounds in order: a handful of numbers."""
    return [r.seq for r in lg.rounds.select("seq").orderBy("seq").collect()]


def last_round(lg) -> int:
    return lg.rounds.agg(F.max("seq")).first()[0] or 0


def sides(lg):
    """The league's sides, written once in an application and table folder: passes and features read them several times."""
    key = (lg.spark.sparkContext.applicationId, lg.sf_dir, "sides")
    if key not in _KEPT:
        _KEPT[key] = written(lg.sides)
    return _KEPT[key]


def trajectory(lg, passes: int = R.PASSES):
    """Computed once in an application and table folder; every later query reads the checkpoint."""
    key = (lg.spark.sparkContext.applicationId, lg.sf_dir, passes)
    if key not in _KEPT:
        played = sides(lg).where("rated")
        if passes == 1:
            _KEPT[key] = written(R.forward_pass(played, round_list(lg)))
        else:
            _KEPT[key] = R.whole_history(played, round_list(lg), passes, trajectory(lg, 1))
    return _KEPT[key]


def paired(lg):
    """Boards with the stand-in ratings of both sides before the round."""
    entry = asof.seed_ratings(lg.played.select("match_id", "player_id", "opp_player_id", "seq", "outcome"), lg.ratings)
    mine = entry.select("match_id", "player_id", "opp_player_id", "seq", "outcome", F.col("rating_value").alias("rating"), F.col("rating_deviation").alias("rd"), "volatility")
    theirs = entry.select("match_id", F.col("player_id").alias("opp_player_id"), F.col("rating_value").alias("opp_rating"), F.col("rating_deviation").alias("opp_rd"))
    return mine.join(theirs, ["match_id", "opp_player_id"])


PAIRED = """, en AS (SELECT match_id, player_id, coalesce(lag(rating_value) OVER w, 1000) AS rating, coalesce(lag(rating_deviation) OVER w, 350) AS rd FROM ratings JOIN played USING (player_id, seq) WINDOW w AS (PARTITION BY player_id ORDER BY seq)),
 pb AS (SELECT p.match_id, p.player_id, p.seq, p.year, p.outcome, a.rating, 1 / sqrt(1 + 3 * (b.rd / 173.7178) * (b.rd / 173.7178) / (pi() * pi())) AS g, b.rating AS opp_rating FROM played p JOIN en a ON a.match_id = p.match_id AND a.player_id = p.player_id JOIN en b ON b.match_id = p.match_id AND b.player_id = p.opp_player_id),
 te AS (SELECT *, 1 / (1 + exp(-g * (rating - opp_rating) / 173.7178)) AS e FROM pb)
"""


@query("rat_1", PAIRED + "SELECT match_id, player_id, round(g * g * e * (1 - e), 9) AS information, round(g * (outcome - e), 9) AS surprise FROM te")
def rat_1(lg):
    t = paired(lg).select("match_id", "player_id", R.board_terms("rating", "opp_rating", "opp_rd", "outcome").alias("t"))
    return t.select("match_id", "player_id", F.round("t.information", 9).alias("information"), F.round("t.surprise", 9).alias("surprise"))


@query("rat_2", PAIRED + "SELECT player_id, round(1 / sum(g * g * e * (1 - e)), 7) AS variance, round(sum(g * (outcome - e)) / sum(g * g * e * (1 - e)), 7) AS delta FROM te GROUP BY 1")
def rat_2(lg):
    out = R.variance_and_delta(paired(lg), ["player_id"])
    return out.select("player_id", F.round("variance", 7).alias("variance"), F.round("delta", 7).alias("delta"))


@query("rat_3")
def rat_3(lg):
    """New volatility of every side of a board, from the stand-in ratings."""
    b = paired(lg)

    def run(batches):
        for batch in batches:
            v = {n: batch.column(i).to_numpy(zero_copy_only=False) for i, n in enumerate(batch.schema.names)}
            yield _one(batch, R.updated(*(v[c].astype(float) for c in ("rating", "rd", "volatility", "opp_rating", "opp_rd", "outcome")))[2:], ["new_volatility"])

    return b.mapInArrow(run, "match_id long, player_id string, new_volatility double")


def _one(batch, arrays, names):
    import pyarrow as pa

    keep = [batch.column(batch.schema.get_field_index(c)) for c in ("match_id", "player_id")]
    return pa.RecordBatch.from_arrays([*keep, *(pa.array(a) for a in arrays)], ["match_id", "player_id", *names])


@query("rat_4")
def rat_4(lg):
    """State of every side after its board, against the opponent's stand-in rating."""

    def run(batches):
        for batch in batches:
            v = {n: batch.column(i).to_numpy(zero_copy_only=False) for i, n in enumerate(batch.schema.names)}
            yield _one(batch, R.updated(*(v[c].astype(float) for c in ("rating", "rd", "volatility", "opp_rating", "opp_rd", "outcome"))), ["rating", "rd", "volatility"])

    return paired(lg).mapInArrow(run, "match_id long, player_id string, rating double, rd double, volatility double")


@query("rat_5", "SELECT player_id, round(least(sqrt((rating_deviation / 173.7178) ** 2 + ((SELECT max(seq) FROM rounds) - seq) * volatility * volatility) * 173.7178, 350), 8) AS rd FROM ratings QUALIFY row_number() OVER (PARTITION BY player_id ORDER BY seq DESC) = 1")
def rat_5(lg):
    last = setops.latest(lg.ratings, ["player_id"], "seq", {"seq": "seq", "rating_deviation": "rating_deviation", "volatility": "volatility"})
    return last.select("player_id", F.round(R.idle_rd("rating_deviation", "volatility", last_round(lg) - F.col("seq")), 8).alias("rd"))


def solved_rounds(played, states):
    """Both players' states after each board of played, from those of the trajectory `states` before its round."""
    entry = R.entry_states(played.select("player_id", "seq", "match_id", "opp_player_id", "outcome", "side"), states)
    side = lambda k, s: entry.where(F.col("side") == k).select("match_id", *([F.col("seq"), F.col("outcome")] if k == 0 else []), *(F.col(c).alias(f"{s}_{c}") for c in ("player_id", "rating", "rd", "volatility")))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            v = {n: batch.column(i).to_numpy(zero_copy_only=False) for i, n in enumerate(batch.schema.names)}
            state = lambda s: tuple(v[f"{s}_{c}"].astype(float) for c in ("rating", "rd", "volatility"))  # noqa: B023, E731
            for s, new in zip("ab", R.solved(state("a"), state("b"), v["outcome"].astype(float)), strict=True):
                yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(f"{s}_player_id")), batch.column(batch.schema.get_field_index("seq")), *(pa.array(x) for x in new)], ["player_id", "seq", "rating", "rd", "volatility"])

    return side(0, "a").join(side(1, "b"), "match_id").mapInArrow(run, "player_id string, seq long, rating double, rd double, volatility double")


@query("rat_6")
def rat_6(lg):
    """Every round solved on its own from the states at its start; newcomers have the defaults."""
    return solved_rounds(lg.played, trajectory(lg, 1))


@query("rat_7")
def rat_7(lg):
    return trajectory(lg, 1)


@query("rat_8")
def rat_8(lg):
    return trajectory(lg)


@query("rat_9")
def rat_9(lg):
    """Rows of every rated player and round, carried players with their grown deviation."""
    points = setops.rated_set(lg.played, lg.status).join(F.broadcast(lg.rounds.select("year", "round_order", "seq")), ["year", "round_order"])
    return R.at_rounds(points, trajectory(lg))


@query("rat_10")
def rat_10(lg):
    """The latest round rated live, carried players included, as its snapshot keeps it: written once, by round."""
    from leaguelens.sources.round_files import shared_folder

    path = shared_folder(lg.spark, "snapshot")
    R.live_round(lg.played, lg.status, trajectory(lg), last_round(lg)).write.partitionBy("seq").parquet(path)
    return lg.spark.read.schema("player_id string, rating double, rd double, volatility double, carried boolean, seq long").parquet(path)


@query("rat_11", "SELECT player_id, round_id, rating_value FROM ratings WHERE round_id % 10 <> 2")
def rat_11(lg):
    """Current rows copied for rounds that have no snapshot."""
    rows = lg.ratings.select("player_id", "round_id", "rating_value")
    return asof.orphans(rows, rows.where("round_id % 10 = 2"), ["round_id"]).select("player_id", "round_id", "rating_value")


@query("rat_12")
def rat_12(lg):
    """Ratings distilled from the champion for every rated row, carried players included; without a champion no rows."""
    from leaguelens.operators import registry as G
    from leaguelens.plans.models import trained

    b, r = trained(lg)
    points = setops.rated_set(lg.played, lg.status).join(F.broadcast(lg.rounds.select("year", "round_order", "seq")), ["year", "round_order"])
    rated = R.at_rounds(points, trajectory(lg)).select("player_id", "seq", "rd", "volatility")
    best = r.champion()
    if best.version is None:
        return rated.limit(0).withColumn("exp_rating", F.lit(None).cast("double"))
    return G.distilled_rows(b, best, rated, round_list(lg))


@query("rat_13", "SELECT player_id, seq, rating_value, rating_deviation FROM ratings WHERE player_id = '000000100' ORDER BY seq")
def rat_13(lg):
    return lg.ratings.where("player_id = '000000100'").select("player_id", "seq", "rating_value", "rating_deviation").orderBy("seq")
