"""Win, draw and loss models of boards: the rating baseline and the two-stage logistic model, fitted on Spark."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leaguelens.functions import scalars as S
from leaguelens.operators import features as X
from leaguelens.operators import standings

DRAW_RATE = 0.05


def draw_rate(b: DataFrame) -> float:
    """AGG-12: the share of draws among the training boards; a default without any."""
    r = b.agg(F.avg((F.col("outcome_a") == 0.5).cast("double")).alias("d")).first().d
    return DRAW_RATE if r is None else r


def baseline(b: DataFrame, draws: float) -> DataFrame:
    """MDL-1: p_win, p_draw, p_loss from the ratings alone."""
    return baseline_by(b, F.lit(draws))


def baseline_by(b: DataFrame, draws: Column) -> DataFrame:
    """MDL-1 with a share of draws of each board's own."""
    e = S.sigmoid(S.combined_g("a.rd", "b.rd") * (F.col("a.rating") - F.col("b.rating")) / S.SCALE)
    win = F.greatest(F.lit(0.0), F.least(1 - draws, e - draws / 2))
    return b.withColumns({"p_win": win, "p_draw": draws, "p_loss": 1 - draws - win})


@dataclass
class Logistic:
    """MDL-2: a draw stage on standardised sym with an intercept, a win stage on scaled anti without one."""

    n0: float
    ridge: float
    sym_mean: np.ndarray
    sym_scale: np.ndarray
    anti_scale: np.ndarray
    draw: np.ndarray
    win: np.ndarray


def _newton(rows: DataFrame, ridge: float, free: int, steps: int = 25) -> np.ndarray:
    """Weights of least penalised log loss over rows (x array, y double); `free` first weights aren't penalised.

    Each step is one job: every batch adds up its gradient and Hessian, which are of the size of x, and the driver solves
    the small system. The data never leave the executors.
    """
    size = rows.select(F.size("x").alias("n")).first()
    if size is None:
        return np.zeros(0)
    size = size.n
    rows = rows.cache()
    penalty = np.where(np.arange(size) < free, 0.0, ridge)
    w = np.zeros(size)
    for _ in range(steps):
        now = w.copy()

        def part(batches, now=now):
            g, h = np.zeros(size), np.zeros((size, size))
            for batch in batches:
                if batch.num_rows:
                    x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                    y = batch.column(1).to_numpy(zero_copy_only=False)
                    p = 1 / (1 + np.exp(-np.clip(x @ now, -30, 30)))
                    g += x.T @ (p - y)
                    h += (x * (p * (1 - p))[:, None]).T @ x
            yield pa.RecordBatch.from_arrays([pa.array([i for i in range(size + size * size)]), pa.array(np.concatenate([g, h.ravel()]))], ["i", "v"])

        sums = rows.select("x", "y").mapInArrow(part, "i long, v double").groupBy("i").agg(F.sum("v").alias("v"))
        total = np.zeros(size + size * size)
        for r in sums.collect():  # a gradient and a Hessian: some hundred numbers
            total[r.i] = r.v
        g, h = total[:size] + penalty * w, total[size:].reshape(size, size) + np.diag(penalty + 1e-9)
        step = np.linalg.solve(h, g)
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    rows.unpersist()
    return w


def fit_logistic(b: DataFrame, n0: float, ridge: float) -> Logistic:
    """MDL-2: fits both stages to boards (FEA-1)."""
    v = X.vectors(b, n0)
    stats = v.agg(*(f(F.col("sym")[i]).alias(f"{n}{i}") for i in range(X.SYM) for n, f in (("m", F.avg), ("s", F.stddev_pop))), *(F.sqrt(F.avg(F.col("anti")[i] * F.col("anti")[i])).alias(f"a{i}") for i in range(X.ANTI))).first()
    number = lambda x: 1.0 if x is None or x < 1e-9 else x
    mean = np.array([stats[f"m{i}"] or 0.0 for i in range(X.SYM)])
    scale, anti = np.array([number(stats[f"s{i}"]) for i in range(X.SYM)]), np.array([number(stats[f"a{i}"]) for i in range(X.ANTI)])
    drawn = v.select(F.array(F.lit(1.0), *((F.col("sym")[i] - float(mean[i])) / float(scale[i]) for i in range(X.SYM))).alias("x"), (F.col("outcome_a") == 0.5).cast("double").alias("y"))
    won = v.where("outcome_a <> 0.5").select(F.array(*(F.col("anti")[i] / float(anti[i]) for i in range(X.ANTI))).alias("x"), F.col("outcome_a").alias("y"))
    return Logistic(n0, ridge, mean, scale, anti, _newton(drawn, ridge / 100, 1), _newton(won, ridge, 0))


def predict_logistic(b: DataFrame, m: Logistic) -> DataFrame:
    """MDL-3: p_win, p_draw, p_loss by column expressions; swapping the sides swaps p_win and p_loss."""
    v = X.vectors(b, m.n0)
    dot = lambda terms: sum(terms, F.lit(0.0))
    drawn: Column = S.sigmoid(F.lit(float(m.draw[0])) + dot([(F.col("sym")[i] - float(m.sym_mean[i])) / float(m.sym_scale[i]) * float(m.draw[i + 1]) for i in range(X.SYM)])) if len(m.draw) else F.lit(DRAW_RATE)
    won = S.sigmoid(dot([F.col("anti")[i] / float(m.anti_scale[i]) * float(m.win[i]) for i in range(X.ANTI)])) if len(m.win) else F.lit(0.5)
    return v.withColumns({"p_win": (1 - drawn) * won, "p_draw": drawn, "p_loss": (1 - drawn) * (1 - won)})


def burn_in(b: DataFrame) -> int:
    """MDL-10: rounds before the first prediction: ten, or those of the first season if there are more and other seasons."""
    rounds = b.select("year", "seq").distinct().groupBy("year").agg(F.count("*").alias("n")).orderBy("year").collect()  # seasons
    return max(10, rounds[0].n) if len(rounds) > 1 else 10


@dataclass(frozen=True)
class Candidate:
    """MDL-11 and EXT-2: a configuration of a family; further ones may be added to a grid."""

    name: str
    family: str
    n0: float = 0.0
    ridge: float = 0.0
    dim: int = 0


BASELINE, LOGISTIC, BOOSTED, EMBEDDED = "baseline", "logistic", "gbm", "gbm_emb"
# The weights and ridges that are tried.
GRID = (
    Candidate("baseline", BASELINE),
    *(Candidate(f"logistic n0={n0:g} ridge={ridge:g}", LOGISTIC, float(n0), float(ridge)) for n0 in (3, 6, 12) for ridge in (0.3, 1, 3)),
    *(Candidate(f"gbm n0={n0:g} ridge={ridge:g}", BOOSTED, float(n0), float(ridge)) for n0 in (6, 12) for ridge in (1, 3)),
    *(Candidate(f"gbm+vectors dim={dim}", EMBEDDED, 6.0, 1.0, dim) for dim in (4, 8)),
)


def walk_forward(b: DataFrame, grid: tuple[Candidate, ...], rounds: list[int]) -> DataFrame:
    """MDL-10 and MDL-11: predictions of each of `rounds` by every candidate, fitted anew on all rounds before it:
    model, match_id, seq, outcome, p_win, p_draw, p_loss. All fits of a family share their jobs."""
    from leaguelens.operators.families import family

    out, named = None, {}
    for c in grid:
        named.setdefault(c.family, []).append(c)
    for f in named:
        family(f)  # an unknown family is an error before any work is done
    for f, own in named.items():
        p = family(f).predict_rounds(b, own, rounds)
        out = p if out is None else out.unionByName(p)
    return no_predictions(b.sparkSession) if out is None else out


def no_predictions(spark) -> DataFrame:
    return spark.createDataFrame([], "model string, match_id long, seq long, outcome double, p_win double, p_draw double, p_loss double")


def prediction_log(p: DataFrame) -> DataFrame:
    """MDL-14: the likeliest outcome of each board and its probability; those equal to nine
    places go to a win, then to a draw."""
    most = F.greatest("p_win", "p_draw", "p_loss")
    nine = lambda c: F.round(c, 9)
    said = F.when(nine("p_win") == nine(most), "a").when(nine("p_draw") == nine(most), "draw").otherwise("b")
    return p.select("match_id", "model", said.alias("predicted"), most.alias("probability"))


def champion(quality: DataFrame, base: str, least: int = 50, grid: tuple[Candidate, ...] = GRID) -> DataFrame:
    """MDL-12: of the models with at least `least` predicted boards and a Brier score strictly below the baseline's the
    best; no row if there is none. Player vectors must pay: a model of that family must also be strictly better than every
    plain boosted one. Ties go to the earlier candidate of the grid. Quality has a row for each model of a grid."""
    rows = quality.sparkSession.createDataFrame([(c.name, c.family, k) for k, c in enumerate(grid)], "model string, _family string, _place int")
    q = quality.join(F.broadcast(rows), "model", "left")  # candidates
    bars = q.agg(F.min(F.when(F.col("model") == base, F.col("brier"))).alias("_base"), F.min(F.when((F.col("_family") == BOOSTED) & ~F.isnan("brier"), F.col("brier"))).alias("_plain"))
    better = q.where(F.col("model") != base).join(F.broadcast(bars), (F.col("boards") >= least) & (F.col("brier") < F.col("_base")))  # one row
    kept = better.where((F.coalesce("_family", F.lit("")) != EMBEDDED) | F.col("_plain").isNull() | (F.col("brier") < F.col("_plain")))
    return kept.orderBy("brier", F.col("_place").asc_nulls_last(), "model").limit(1).drop("_base", "_plain", "_family", "_place")


def version(family: str, rounds: Column, params: Column) -> Column:
    """MDL-13: family.r{rounds}.{first eight hex digits of the parameters' SHA-256}."""
    return F.concat(F.lit(f"{family}.r"), rounds.cast("string"), F.lit("."), F.substring(F.sha2(params, 256), 1, 8))


def top_factors(v: DataFrame, k: int = 3) -> DataFrame:
    """MDL-15: the k largest entries of anti of each board with the side they favour."""
    e = v.select("match_id", F.posexplode("anti").alias("factor", "value"))
    n = F.row_number().over(Window.partitionBy("match_id").orderBy(F.abs("value").desc(), "factor"))
    return e.withColumn("place", n).where(F.col("place") <= k).withColumn("favours", F.when(F.col("value") > 0, "a").when(F.col("value") < 0, "b").otherwise("none"))


def reliability_note(rd, career, insularity) -> Column:
    """MDL-17: what makes a prediction for a side unsure."""
    return F.array_compact(F.array(F.when(S.col(rd) > 200, "rating unsure"), F.when(S.col(career) < 5, "few boards"), F.when(S.col(insularity) > 0.6, "narrow schedule")))


def reliability(rd, career, insularity, opp_quality_bias, stability) -> Column:
    """MDL-16: struct (score 0 to 100, tier, flags) of how far a side's rating can be trusted: points are taken off for an
    unsure rating, a short history, a narrow schedule, opponents unlike the rest and a rating that swings."""
    rd, career, insularity, bias, swing = (S.col(c) for c in (rd, career, insularity, opp_quality_bias, stability))
    # Bounds, points and flags, the worst first.
    rules = (
        ((rd > 250, 30, "high rating uncertainty"), (rd > 150, 15, "moderate rating uncertainty")),
        ((career < 3, 25, "almost no history"), (career < 8, 10, "limited history")),
        ((insularity > 0.75, 20, "mostly one hall"), (insularity > 0.5, 10, "somewhat insular")),
        ((bias > 150, 15, "stronger opponents than average"), (bias < -150, 15, "weaker opponents than average")),
        ((swing > 100, 10, "rating has swung"),),
    )

    def first(rule, k, other):
        out = F.when(rule[0][0], rule[0][k])
        for r in rule[1:]:
            out = out.when(r[0], r[k])
        return out.otherwise(other)

    score = F.greatest(F.lit(0), 100 - sum((first(r, 1, 0) for r in rules), F.lit(0))).cast("int")
    tier = F.when(score >= 80, "High").when(score >= 55, "Medium").otherwise("Low")
    return F.struct(score.alias("score"), tier.alias("tier"), F.array_compact(F.array(*(first(r, 2, None) for r in rules))).alias("flags"))


scores = standings.quality
