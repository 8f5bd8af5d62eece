"""A bucketed layout of papers: attempts, questions and answers of one test lie together, so that their joins move nothing.

Rows go by cell: a test, and a slot of it where the test has very many attempts. A test's questions are repeated in each of
its slots (a paper is short), so no cell holds more than about ``limit`` attempts however popular the test is. All three
tables are bucketed by cell alike. Joins by cell and more columns then find both sides in place.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.sources.files import folder

CELL = ("test_id", "slot")
SLOT_ATTEMPTS = 100_000


@dataclass(frozen=True)
class Papers:
    """attempts (test_id, slot, attempt_id, ...), questions (test_id, slot, question_id, ...), answers (test_id, slot,
    attempt_id, question_id, ...)."""

    attempts: DataFrame
    questions: DataFrame
    answers: DataFrame


def write_bucketed(df: DataFrame, path: str, buckets: int, keys: tuple[str, ...] = CELL) -> DataFrame:
    """``df`` as Parquet with one file a bucket, known to the session's catalog by its path; beside it how it was written."""
    spark = df.sparkSession
    df.repartition(buckets, *keys).write.format("parquet").bucketBy(buckets, *keys).sortBy(*keys).option("path", path).saveAsTable(_name(path))
    columns = ", ".join(f"`{c}` {kind}" for c, kind in df.dtypes)
    spark.createDataFrame([(columns, buckets, list(keys))], "columns string, buckets int, keys array<string>").coalesce(1).write.json(f"{path}-layout")
    return spark.table(_name(path))


def open_bucketed(spark: SparkSession, path: str) -> DataFrame:
    """A table that ``write_bucketed`` has left at a path, in whatever session."""
    if not spark.catalog.tableExists(_name(path)):
        own = spark.read.schema("columns string, buckets int, keys array<string>").json(f"{path}-layout").first()
        by = ", ".join(f"`{k}`" for k in own["keys"])
        spark.sql(f"CREATE TABLE {_name(path)} ({own['columns']}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) INTO {own['buckets']} BUCKETS LOCATION '{path}'")
    return spark.table(_name(path))


def _name(path: str) -> str:
    return "gradeloom_" + "".join(c if c.isalnum() else "_" for c in "_".join(path.rstrip("/").split("/")[-2:])).lower()


def joins_by_cell(spark: SparkSession) -> None:
    """Lets joins by (test_id, slot, ...) use tables that are dealt by (test_id, slot); without it Spark deals both anew."""
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")


def write_papers(attempts: DataFrame, questions: DataFrame, tests: DataFrame, answers: DataFrame, path: str, buckets: int | None = None, limit: int = SLOT_ATTEMPTS) -> Papers:
    """Writes the layout below ``path``. Attempts of no test stay (their cell has no questions); answers of no attempt don't.
    Questions carry their test's penalty and the paper's address. ``buckets``: the session's shuffle partitions, unless given."""
    spark = attempts.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    slots = attempts.groupBy("test_id").agg(F.ceil(F.count("*") / limit).alias("slots"))
    sat = attempts.withColumnRenamed("id", "attempt_id").join(slots, "test_id", "left").withColumn("slot", F.pmod(F.xxhash64("attempt_id"), F.coalesce("slots", F.lit(1))).cast("int")).drop("slots")
    of_test = tests.select(F.col("id").alias("test_id"), F.col("negative_marks").alias("test_negative"), "question_paper_url")
    asked = questions.withColumnRenamed("id", "question_id").join(of_test, "test_id").join(slots, "test_id", "left")
    asked = asked.withColumn("slot", F.explode(F.sequence(F.lit(0), F.coalesce("slots", F.lit(1)).cast("int") - 1))).drop("slots")
    given = answers.join(sat.select("attempt_id", "test_id", "slot"), "attempt_id")
    for name, df in (("attempts", sat), ("questions", asked), ("answers", given)):
        write_bucketed(df, f"{path}/{name}", buckets)
    return open_papers(spark, path)


def open_papers(spark: SparkSession, path: str) -> Papers:
    joins_by_cell(spark)
    return Papers(*(open_bucketed(spark, f"{path}/{name}") for name in ("attempts", "questions", "answers")))


_KEPT: dict[tuple, str] = {}
_SPREAD: dict[tuple, int] = {}
#: Bytes of stored tables for each partition that a shuffle begins with.
PART_BYTES = 4 << 20
STAR = ("customer", "supplier", "part", "orders", "lineitem", "events", "documents")


def spread(spark: SparkSession, sf_dir: str) -> int:
    """Lets shuffles begin with partitions in proportion to a folder's tables, at least the session's number; Spark then joins
    small ones (AQE). So a task's share stays the same however the tables grow, and sorts don't spill for its size."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _SPREAD:
        _SPREAD[key] = -(-(table_state(spark, sf_dir, STAR)[1] or 0) // PART_BYTES)
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), _SPREAD[key])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", n)
    return n


def table_state(spark: SparkSession, sf_dir: str, names: tuple[str, ...]) -> tuple:
    """What tells one state of some tables' files from another: their number, bytes, and a sum over paths and times. Only
    the folders are listed, no file is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load([f"{sf_dir}/{n}.parquet" for n in names])
    mark = F.sum(F.xxhash64("path", "modificationTime").cast("decimal(30,0)"))
    return tuple(files.agg(F.count("*"), F.sum("length"), mark).first())


def kept_papers(spark: SparkSession, sf_dir: str, build) -> Papers:
    """The layout of a folder's tables: written by ``build(path)`` where this application has none of their present state,
    else the one that is there."""
    key = (spark.sparkContext.applicationId, sf_dir, *table_state(spark, sf_dir, ("lineitem", "orders", "part")))
    if key not in _KEPT:
        build(path := folder(spark, "papers"))
        _KEPT[key] = path
    return open_papers(spark, _KEPT[key])
