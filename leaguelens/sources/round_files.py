"""Round files and capped lists: reading them as DataFrames, and writing a league's own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leaguelens.sources.league_view import SENTINEL, League

# Fixed values of the file formats.
ROUND_HEADER = ("name1", "hall1", "score1", "name2", "hall2", "score2")
LIST_HEADER = ("name", "hall")
ROUND_FILE = r"(?i)^(?:(\d{4})_)?round_(\d+)\.csv$"
LIST_FILE = r"(?i)^(?:(\d{4})_)?cappedlist\.csv$"


def raw_rows(lg: League) -> DataFrame:
    """The league's boards as rows of round files: year, round_order, row_no, the six text columns and match_id."""
    b = lg.boards

    def texts(k):
        name = F.when(F.col(f"player_id{k}") == SENTINEL, "WALKOVER").otherwise(F.concat(F.lit("Player "), F.col(f"player_id{k}")))
        hall = F.when(F.col(f"hall_id{k}") == -1, "").otherwise(F.col(f"hall_id{k}").cast("string"))
        score = F.when(F.col("is_walkover"), "").when(F.col(f"kind{k}") == "TIMEOUT", "TIMEOUT").otherwise(F.col(f"score{k}").cast("long").cast("string"))
        return [name.alias(f"name{k + 1}"), hall.alias(f"hall{k + 1}"), score.alias(f"score{k + 1}")]

    return b.select("year", "round_order", (F.col("pair") * 10 + F.col("seat")).alias("row_no"), *texts(0), *texts(1), "match_id")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below that of spark.checkpoint.dir, which all executors share; a temporary one only if it is unset."""
    import tempfile
    import uuid

    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{(base or tempfile.mkdtemp(prefix='league-')).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def write_round_files(rows: DataFrame, folder: str) -> None:
    """Rows as CSV, a directory for each round; row_no is kept as an order only, so a round is written by one task."""
    one = rows.repartition("year", "round_order").sortWithinPartitions("year", "round_order", "row_no")
    one.select("year", "round_order", *ROUND_HEADER).write.partitionBy("year", "round_order").option("header", True).option("escape", '"').option("emptyValue", "").csv(folder)


def read_rounds(spark: SparkSession, paths, default_year: int | None = None) -> DataFrame:
    """SRC-1 and SRC-3: round files, all columns as text.

    Year and round come from the file's name, or from partition directories year= and round_order=; a name without a
    year takes the default. Cells are trimmed, blank lines skipped. row_no is the row's place in its file.
    """
    schema = T.StructType([T.StructField(c, T.StringType()) for c in (*ROUND_HEADER, "_corrupt")])
    read = spark.read.schema(schema).option("header", True).option("escape", '"').option("columnNameOfCorruptRecord", "_corrupt").option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True)
    rows = read.csv(paths).withColumn("_file", F.col("_metadata.file_path")).withColumn("_at", F.monotonically_increasing_id())
    name = F.element_at(F.split("_file", "/"), -1)
    number = lambda pattern, k, text: F.regexp_extract(text, pattern, k).try_cast("int")
    year = F.coalesce(number(ROUND_FILE, 1, name), number(r"/year=(\d{4})/", 1, F.col("_file")), F.lit(default_year).cast("int"))
    order = F.coalesce(number(ROUND_FILE, 2, name), number(r"/round_order=(\d+)/", 1, F.col("_file")))
    row_no = F.row_number().over(Window.partitionBy("_file").orderBy("_at"))
    cells = [F.coalesce(F.trim(c), F.lit("")).alias(c) for c in ROUND_HEADER]
    return rows.select(year.alias("year"), order.alias("round_order"), row_no.alias("row_no"), *cells, "_corrupt", F.col("_file").alias("file"))


def read_capped_lists(spark: SparkSession, paths, default_year: int | None = None) -> DataFrame:
    """SRC-2: capped lists (name, hall), with the year of the file's name or partition directory."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in LIST_HEADER])
    rows = spark.read.schema(schema).option("header", True).option("escape", '"').csv(paths).withColumn("_file", F.col("_metadata.file_path"))
    name = F.element_at(F.split("_file", "/"), -1)
    year = F.coalesce(F.regexp_extract(name, LIST_FILE, 1).try_cast("int"), F.regexp_extract("_file", r"/year=(\d{4})/", 1).try_cast("int"), F.lit(default_year).cast("int"))
    return rows.select(year.alias("year"), F.trim("name").alias("name"), F.trim("hall").alias("hall"))


def with_defaults(table: DataFrame, defaults: DataFrame, keys: list[str]) -> DataFrame:
    """SRC-4: the table and those of the default rows whose key it doesn't have; doing it twice changes nothing."""
    return table.unionByName(defaults.join(table.select(*keys), keys, "left_anti").select(*table.columns))
