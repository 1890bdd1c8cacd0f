"""Stored models: training cycles, versions, one champion, its predictions and the ratings distilled from it.

A registry is a folder: `models`, one row for each candidate of each cycle, only ever added to; `tables`, the parts of models
that grow with the players; `vectors`, player vectors by model version; `champion`, numbered files of which the last one
names the champion; `predictions`, the champion's log, a partition for each round; `folds`, back-test predictions by a digest
of the boards that they depend on, so that a cycle predicts anew only rounds whose boards, or those before them, have
changed. A new champion is a file of the next
number, created only if it isn't there: of two writers that have seen the same champion one fails and must look again.
"""

from __future__ import annotations

import dataclasses
import functools
import hashlib
import json
import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leaguelens.operators import models as M
from leaguelens.operators import ratings as R
from leaguelens.operators.checkpoints import written
from leaguelens.operators.families import family

#: Boards below which nothing is trained, and predicted boards that a champion needs.
LEAST_BOARDS, LEAST_PREDICTED = 20, 50
_MODELS = "cycle string, model_version string, family string, name string, params string, tables string, metrics string, trained_boards long, trained_rounds long, is_champion boolean"
_FOLDS = "fold string, candidate string, cycle string, model string, match_id long, seq long, outcome double, p_win double, p_draw double, p_loss double"
#: To be raised when a family's method changes, so that what was said before isn't taken again.
METHOD = 1
_PREDICTIONS = "match_id long, predicted_winner string, probability double, model_version string, seq long"


def _read(spark: SparkSession, schema: str, path: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as absent:
        if absent.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _digests(b: DataFrame) -> dict[int, str]:
    """A digest of all boards up to each round: of sums of their rows' hashes, which don't depend on the order of the rows."""
    h = F.xxhash64(*b.columns)
    each = b.groupBy("seq").agg(F.count("*").alias("n"), F.bit_xor(h).alias("x"), F.sum(h.cast("decimal(38,0)")).alias("s")).collect()  # rounds
    out, upto = {}, hashlib.sha256(json.dumps(b.schema.jsonValue()).encode())
    for r in sorted(each, key=lambda r: r.seq):
        upto.update(f"{r.seq}:{r.n}:{r.x}:{r.s};".encode())
        out[r.seq] = upto.copy().hexdigest()
    return out


@dataclass(frozen=True)
class Champion:
    """The number of the file that names it (-1: none yet), its version and name, family and model."""

    number: int
    version: str | None = None
    name: str | None = None
    family: str | None = None
    model: object = None


@dataclass(frozen=True)
class Outcome:
    """What a training cycle did."""

    trained: bool
    note: str
    version: str | None = None
    name: str | None = None


class Registry:
    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def models(self) -> DataFrame:
        return _read(self.spark, _MODELS, f"{self.folder}/models")

    def predictions(self) -> DataFrame:
        """MDL-14: match_id, predicted_winner (null: a draw), probability, model_version, seq."""
        return _read(self.spark, _PREDICTIONS, f"{self.folder}/predictions")

    def vectors(self, version: str | None = None) -> DataFrame:
        """MDL-9: player_id, year, model_version, vector: as of a version, or of all."""
        held = _read(self.spark, "player_id string, year int, vector array<double>, model_version string", f"{self.folder}/vectors")
        return held if version is None else held.where(F.col("model_version") == version)

    # --- the champion -------------------------------------------------------------------------------------------------

    def _path(self, number: int):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/champion/{number:012d}")

    def _fs(self):
        return self._path(0).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def pointer(self) -> tuple[int, dict | None]:
        """(number, content) of the last file that names a champion; (-1, None) if there is none."""
        fs, folder = self._fs(), self._path(0).getParent()
        if not fs.exists(folder):
            return -1, None
        numbers = sorted((int(s.getPath().getName()) for s in fs.listStatus(folder) if s.getPath().getName().isdigit()), reverse=True)
        for n in numbers:
            rows = self.spark.read.text(f"{self.folder}/champion/{n:012d}").collect()
            if rows:  # one that is just being written is still empty
                return n, json.loads(rows[0].value)
        return -1, None

    def swap(self, seen: int, content: dict) -> bool:
        """Names a champion if `seen` is still the last file's number; False if another writer was first."""
        from py4j.protocol import Py4JJavaError

        try:
            out = self._fs().create(self._path(seen + 1), False)
        except Py4JJavaError as failure:
            if "AlreadyExists" in failure.java_exception.getClass().getName():
                return False
            raise
        try:
            out.write(bytearray((json.dumps(content) + "\n").encode()))
        finally:
            out.close()
        return True

    def champion(self) -> Champion:
        number, content = self.pointer()
        if content is None:
            return Champion(number)
        row = self.models().where((F.col("cycle") == content["cycle"]) & (F.col("model_version") == content["version"])).limit(1).collect()[0]
        return Champion(number, row.model_version, row.name, row.family, family(row.family).decode(self.spark, row.params, row.tables))

    # --- a cycle --------------------------------------------------------------------------------------------------------

    def retrain(self, b: DataFrame, grid: tuple[M.Candidate, ...] = M.GRID, burn_in: int | None = None, least: int = LEAST_PREDICTED) -> Outcome:
        """MDL-10 to 13 and MDL-9: back-tests the grid, fits every candidate to all boards b, stores them and names the champion: the
        one that the rule picks, or the baseline. Too few boards, or none after the first rounds, change nothing.

        A cycle's rows are written before the champion's file, so a failure in between leaves the old champion."""
        seen, _ = self.pointer()
        b = written(b)
        boards = b.count()
        if boards < LEAST_BOARDS:
            return Outcome(False, f"{boards} boards, fewer than {LEAST_BOARDS}")
        rounds = [r.seq for r in b.select("seq").distinct().orderBy("seq").collect()]  # rounds
        after = rounds[M.burn_in(b) if burn_in is None else burn_in :]
        if not after:
            return Outcome(False, f"no rounds after the first {len(rounds)}")
        cycle = uuid.uuid4().hex
        p, fitted = self._walked(b, grid, after, cycle)
        quality = M.scores(p, ["model"])
        base = next(c.name for c in grid if c.family == M.BASELINE)
        q = {r.model: r.asDict() for r in quality.collect()}  # candidates
        best = M.champion(quality, base, least, grid).collect()
        name = best[0].model if best else base
        by_round = {(r.model, r.seq): r.brier for r in M.scores(p, ["model", "seq"]).select("model", "seq", "brier").collect()}  # candidates x rounds
        rows, year = [], b.agg(F.max_by("year", F.struct("seq", "match_id"))).first()[0]
        exported = None
        for k, c in enumerate(grid):
            tables = f"{self.folder}/tables/{cycle}-{k}"
            model = fitted[c.name]
            params = family(c.family).encode(model, tables)
            version = f"{c.family}.r{len(rounds)}.{hashlib.sha256(params.encode()).hexdigest()[:8]}"
            gaps = [by_round[c.name, r] - by_round[base, r] for r in after if (c.name, r) in by_round]
            metrics = q.get(c.name, {}) | {"baseline_brier": q[base]["brier"], "brier_delta": q[c.name]["brier"] - q[base]["brier"] if c.name in q else None, "rounds_better": sum(g < 0 for g in gaps), "rounds_worse": sum(g > 0 for g in gaps)}
            rows.append((cycle, version, c.family, c.name, params, tables, json.dumps(metrics, default=str), boards, len(rounds), c.name == name))
            if c.family == M.EMBEDDED:  # the last one, of the longest vectors
                exported = version, model[1]
        if exported:
            version, net = exported
            own = net.vectors.where("kind = 'player'").select(F.col("key").alias("player_id"), F.lit(year).cast("int").alias("year"), "vector", F.lit(version).alias("model_version"))
            own.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("model_version").parquet(f"{self.folder}/vectors")
        self.spark.createDataFrame(rows, _MODELS).coalesce(1).write.mode("append").parquet(f"{self.folder}/models")
        version = next(r[1] for r in rows if r[3] == name)
        if not self.swap(seen, {"cycle": cycle, "version": version}):
            raise RuntimeError("another cycle has named a champion meanwhile; look again and retrain")
        return Outcome(True, f"{boards} boards, {len(rounds)} rounds, champion {name}", version, name)

    def _walked(self, b: DataFrame, grid: tuple[M.Candidate, ...], rounds: list[int], cycle: str) -> tuple[DataFrame, dict[str, object]]:
        """(walk_forward, the model of each candidate on all boards). Predictions of repeatable families are kept by a digest of the
        boards up to their round, and taken again where it is the same."""
        for c in grid:
            family(c.family)  # an unknown family is an error before any work is done
        fold = _digests(b)
        path, asked = f"{self.folder}/folds", {json.dumps([METHOD, dataclasses.asdict(c)]): c for c in grid}
        held = _read(self.spark, _FOLDS, path).where(F.col("fold").isin([fold[r] for r in rounds]) & F.col("candidate").isin(list(asked)))
        first = held.groupBy("fold", "candidate").agg(F.min("cycle").alias("cycle")).collect()  # candidates x rounds
        known = {(r.fold, r.candidate) for r in first if family(asked[r.candidate].family).repeatable}
        parts, fitted, of = [], {}, {c.name: text for text, c in asked.items()}
        for f in dict.fromkeys(c.family for c in grid):
            own = [c for c in grid if c.family == f]
            missing = [r for r in rounds if any((fold[r], of[c.name]) not in known for c in own)]
            said, models = family(f).walk(b, own, missing)
            parts.append(said)
            fitted |= dict(zip((c.name for c in own), models, strict=True))
            known -= {(fold[r], of[c.name]) for r in missing for c in own}
        names = self.spark.createDataFrame([(c.name, text) for text, c in asked.items()], "model string, candidate string")
        digests = self.spark.createDataFrame([(r, fold[r]) for r in rounds], "seq long, fold string")
        new = functools.reduce(DataFrame.unionByName, parts).join(F.broadcast(names), "model").join(F.broadcast(digests), "seq")  # candidates, rounds
        new = written(new.withColumn("cycle", F.lit(cycle)).select(*(c.split()[0] for c in _FOLDS.split(", "))))
        out = new.select(*M.no_predictions(self.spark).columns)
        if known:
            again = self.spark.createDataFrame([(r.fold, r.candidate, r.cycle) for r in first if (r.fold, r.candidate) in known], "fold string, candidate string, cycle string")
            kept = held.join(F.broadcast(again), ["fold", "candidate", "cycle"], "left_semi")  # candidates x rounds
            out = written(out.unionByName(kept.select(*out.columns)))
        keep = [text for text, c in asked.items() if family(c.family).repeatable]
        new.where(F.col("candidate").isin(keep)).write.mode("append").partitionBy("cycle").parquet(path)
        return out, fitted

    def log(self, b: DataFrame) -> None:
        """MDL-14: the champion's likeliest outcome of each board of b; nothing without a champion. A round that is logged again
        replaces its entries. Equal probabilities go to the first side, then to the second, then to a draw."""
        best = self.champion()
        if best.version is None:
            return
        p = family(best.family).predict(b, best.model, ["match_id", "seq", "a", "b"])
        top = F.greatest("p_win", "p_draw", "p_loss")
        winner = F.when(F.col("p_win") == top, F.col("a.player_id")).when(F.col("p_loss") == top, F.col("b.player_id"))
        out = p.select("match_id", winner.alias("predicted_winner"), top.alias("probability"), F.lit(best.version).alias("model_version"), "seq")
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("seq").parquet(f"{self.folder}/predictions")


def expected(b: DataFrame, best: Champion) -> DataFrame:
    """seq, player_a, player_b, outcome_a and expected, the champion's score of side a."""
    p = family(best.family).predict(b, best.model, ["match_id", "seq", "a", "b", "outcome_a"])
    return p.select("seq", F.col("a.player_id").alias("player_a"), F.col("b.player_id").alias("player_b"), "outcome_a", (F.col("p_win") + F.col("p_draw") / 2).alias("expected"))


def distilled_rows(b: DataFrame, best: Champion, rated: DataFrame, rounds: list[int]) -> DataFrame:
    """RAT-12: rated (player_id, seq, rd, volatility, others) with `exp_rating`, the rating that says what the champion says: after
    the player's last board up to that round, or the default. Exactly the rated rows; deviation and volatility stay."""
    steps = R.distilled(expected(b, best), rounds).select("player_id", "seq", F.col("rating").alias("_r"), F.lit(0).alias("_turn"))
    marks = F.struct(*rated.columns).alias("_p")
    points = rated.select("player_id", "seq", marks, F.lit(1).alias("_turn"))
    line = points.unionByName(steps, allowMissingColumns=True)
    upto = Window.partitionBy("player_id").orderBy("seq", "_turn").rowsBetween(Window.unboundedPreceding, 0)
    line = line.withColumn("_v", F.last("_r", ignorenulls=True).over(upto)).where(F.col("_p").isNotNull())
    return line.select("_p.*", F.coalesce("_v", F.lit(R.BASE_RATING)).alias("exp_rating"))


def scorecard(log: DataFrame, boards: DataFrame) -> DataFrame:
    """REP-11: model_version, boards, hits, accuracy, mean probability of what the champions said before the rounds."""
    real = boards.select("match_id", F.when(F.col("outcome_a") == 1.0, F.col("a.player_id")).when(F.col("outcome_a") == 0.0, F.col("b.player_id")).alias("_winner"))
    hit = F.col("predicted_winner").eqNullSafe(F.col("_winner"))
    return log.join(real, "match_id").groupBy("model_version").agg(F.count("*").alias("boards"), F.count_if(hit).alias("hits"), F.avg(hit.cast("double")).alias("accuracy"), F.avg("probability").alias("mean_probability"))
