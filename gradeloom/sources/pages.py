"""A page index: rows in order, in ranges, with the number of rows before each range, so that any page reads one range.

A plain offset brings offset + limit rows to one task; here the ranges that hold a page are looked up, and only they are
read and sorted."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class PageIndex:
    spark: SparkSession
    path: str
    order: tuple[Column, ...]
    schema: str

    def _ranges(self) -> DataFrame:
        return self.spark.read.schema("part int, n long, before long").parquet(f"{self.path}/ranges")

    def total(self) -> DataFrame:
        """One row: total."""
        return self._ranges().agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))

    def page(self, number: int, size: int) -> DataFrame:
        """Page ``number``, from 0, of ``size`` rows in order; beyond the end there are none."""
        lo = number * size
        found = self._ranges().where((F.col("before") < lo + size) & (F.col("before") + F.col("n") > lo)).orderBy("part").collect()  # ranges that the page touches
        if not found:
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(f"{self.schema}, part int").parquet(f"{self.path}/rows")
        own = rows.where(F.col("part").isin([r["part"] for r in found]))  # prunes folders
        return own.orderBy(*self.order).offset(lo - found[0]["before"]).limit(size).drop("part")


def write_pages(rows: DataFrame, order: tuple[Column, ...], path: str, ranges: int) -> PageIndex:
    """Writes ``rows`` in so many ranges of near equal size. ``order`` must tell any two rows apart; Spark samples the rows
    for its bounds, so each range is one shuffle partition however the values lie."""
    spark = rows.sparkSession
    dealt = rows.repartitionByRange(ranges, *order).withColumn("part", F.spark_partition_id())
    dealt.sortWithinPartitions("part", *order).write.partitionBy("part").parquet(f"{path}/rows")
    schema = ", ".join(f"`{c}` {kind}" for c, kind in rows.dtypes)
    counts = spark.read.schema(f"{schema}, part int").parquet(f"{path}/rows").groupBy("part").agg(F.count("*").alias("n"))  # a row for each range
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts.withColumn("before", before).coalesce(1).write.parquet(f"{path}/ranges")
    return PageIndex(spark, path, order, schema)


def page_bounds(total: DataFrame, pages: DataFrame, size: int) -> DataFrame:
    """For each page (column page, from 0): the number of pages, its first and last row from 1, and the total."""
    both = pages.join(total)  # one row
    return both.select("page", F.ceil(F.col("total") / size).alias("pages"), (F.col("page") * size + 1).alias("from_row"), F.least((F.col("page") + 1) * size, F.col("total")).alias("to_row"), "total")
