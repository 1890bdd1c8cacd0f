"""A training-corpus pipeline out of the operators of leaguelens.llm.

Each stage is (name, function); the function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the docs of the next one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from leaguelens.llm import langid, packing, pii, simhash, suffixdedup

STAGES = [
    ("language_id", langid.keep_identified),
    ("simhash_near_dedup", simhash.keep_one),
    ("suffix_array_dedup", suffixdedup.without_repeats),
    ("pii", pii.redact),
    ("best_fit_packing", packing.packed),
]

#: SQL can't express the stages (a trained model, Golay decoding, boosted trees); tests/llm has brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. Stage results go to the folder of spark.checkpoint.dir, which all executors share."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        import tempfile

        folder = tempfile.mkdtemp(prefix="corpus-pipeline-")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{folder.rstrip('/')}/corpus-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k + 1 == len(STAGES):
            return out
        out.write.parquet(f"{base}/{k}-{name}")
        docs = spark.read.parquet(f"{base}/{k}-{name}")
    return docs
