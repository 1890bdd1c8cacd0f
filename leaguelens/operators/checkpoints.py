"""Cutting lineage where a loop on the driver would let it grow."""

from pyspark.sql import DataFrame, SparkSession


def checkpointed(df: DataFrame) -> DataFrame:
    """df, computed now and written to the folder of spark.checkpoint.dir, which all executors share and which survives
    the loss of one. Only where that setting is missing, as in tests, a temporary folder is chosen."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder:
            if not context.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            import tempfile

            folder = tempfile.mkdtemp(prefix="league-checkpoint-")
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def new_table(spark: SparkSession) -> str:
    """The path of a table to be written to that folder."""
    import uuid

    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        import tempfile

        folder = tempfile.mkdtemp(prefix="league-table-")
    return f"{folder.rstrip('/')}/table-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df as a table just written to that folder and read again, so that its plan is a plain scan: a checkpoint keeps the
    constraints of the plan it replaces, which grow from round to round of a loop."""
    path = new_table(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
