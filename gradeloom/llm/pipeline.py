"""A training corpus from ``documents`` in five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.llm.common import scratch
from gradeloom.llm.decontam import without_leaks
from gradeloom.llm.jaccard import jaccard_components
from gradeloom.llm.language import UNKNOWN, train_language
from gradeloom.llm.mixing import mix_sources
from gradeloom.llm.sharding import kd_shards

#: Rows in an Arrow batch: some MB of text, so that Python workers of all stages fit beside an executor's heap.
BATCH_ROWS = "1000"
LEAST_SCORE = 0.3  # of a text's language; one with letters has far more unless its words are of no language


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def names_apart(name: str, docs: DataFrame) -> str:
    """``name``, with as many underscores as it takes to be no column of ``docs``."""
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    return name


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of no language: without letters, or without a likely one. Without labelled rows it knows none, and
    drops all."""
    small_batches(spark)
    found = train_language(docs).column()
    return docs.where((found["lang"] != UNKNOWN) & (found["score"] >= LEAST_SCORE))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near copies the document of least doc_id. Rows without doc_id, or in no group, stay, and a
    row that goes takes no other text of its doc_id along."""
    small_batches(spark)
    gone = jaccard_components(docs).where(F.col("component_id") != F.col("doc_id")).select(F.struct(F.col("doc_id").alias("id"), "text_key").alias("gone")).distinct()
    own = F.struct(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("text_key"))
    return docs.join(gone.withColumnRenamed("gone", names_apart("gone", docs)), own == F.col(names_apart("gone", docs)), "left_anti")


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a passage of the benchmark; null and empty texts hold none and stay."""
    small_batches(spark)
    return without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents of small sources as far as the mix asks for; every document stays. A null source is a source like
    others, a null or empty text counts as one token, and rows that repeat are drawn together, each as a row."""
    return mix_sources(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The corpus: each row with its text and the other columns, its size, and its place in 40 shards of near equal bytes.

    The columns that this adds keep their names; a column of ``docs`` of such a name comes out with underscores after it.
    Null texts have the size of a row alone; rows that repeat each have a place of their own; an empty table has none."""
    small_batches(spark)
    own = kd_shards(docs, carry=docs.columns)
    new = [c for c in own.columns if c not in ("carried", "doc_id")]
    apart = {c: c for c in docs.columns if c.lower() not in new}
    for c in docs.columns:
        if c not in apart:
            apart[c] = next(x for x in (c + "_" * i for i in range(1, 99)) if x.lower() not in {y.lower() for y in (*new, *docs.columns, *apart.values())})
    return own.select(*(F.col("carried")[c].alias(apart[c]) for c in docs.columns), *new)


STAGES = [("language_id", language_id), ("ngram_jaccard", near_duplicates), ("decontamination", benchmark_leaks), ("source_mixing", source_mix), ("kd_sharding", shards)]

#: The stages learn, align and split by rules that SQL doesn't express; tests hold them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
