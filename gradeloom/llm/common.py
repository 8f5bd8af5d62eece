"""Pieces that several operators share: scratch tables, bit filters, connected components."""

from __future__ import annotations

import re
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BITS_PER_BUCKET = 32768  # what bitmap_construct_agg packs into one binary


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only where all run in one process does the
    warehouse serve in its place."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return folder or spark.conf.get("spark.sql.warehouse.dir")


def scratch(df: DataFrame, name: str, partition_by: list[str] | None = None, **options: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/gradeloom/{name}-{uuid.uuid4().hex}"
    writer = df.write.options(**options)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


LEAST_BITS, MOST_BITS = 1 << 22, 1 << 28


def filter_bits(keys: int) -> int:
    """Bits for so many keys: 16 to 32 each, as far as 2^28. A filter is broadcast, in 8,192 rows of 4 KB at most; beyond
    some 100 million keys it fills up, which lets more rows through and never fewer."""
    return min(MOST_BITS, max(LEAST_BITS, 1 << (16 * keys - 1).bit_length()))


def bit_filter(keys: DataFrame, key: str, bits: int) -> DataFrame:
    """A one-hash filter of ``key`` as at most ``bits / 32768`` rows (bucket, bitmap) of 4 KB."""
    return positions_filter(keys.select(F.pmod(F.xxhash64(key), F.lit(bits)).alias("at")))


def positions_filter(taken: DataFrame) -> DataFrame:
    """The filter whose bits ``at`` are set."""
    return taken.groupBy((F.col("at") / BITS_PER_BUCKET).cast("long").alias("bf_bucket")).agg(F.bitmap_construct_agg(F.col("at") % BITS_PER_BUCKET).alias("bf_bits"))


def maybe_in(df: DataFrame, key: str, bitmap: DataFrame, flag: str, bits: int) -> DataFrame:
    """Adds the boolean ``flag``: false if ``key`` is surely not in the filter. The filter's bounded rows are broadcast."""
    at = F.pmod(F.xxhash64(key), F.lit(bits))
    joined = df.withColumn("bf_at", at).join(
        F.broadcast(bitmap), (F.col("bf_at") / BITS_PER_BUCKET).cast("long") == F.col("bf_bucket"), "left"
    )
    byte = F.conv(F.hex(F.substring("bf_bits", ((F.col("bf_at") % BITS_PER_BUCKET) / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    bit = F.call_function("getbit", byte, (F.col("bf_at") % 8).cast("int"))
    return joined.withColumn(flag, F.coalesce(bit == 1, F.lit(False))).drop("bf_at", "bf_bucket", "bf_bits")


def _changed(before: DataFrame, after: DataFrame) -> bool:
    mark = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1000003)).first()
    return tuple(mark(before)) != tuple(mark(after))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) for every id on an edge; component is the least id that edges reach.

    Alternates large-star and small-star rounds: each joins edges to the least neighbour of a node, so no node's
    neighbours are gathered in one place. Every round is written to the shared folder.
    """
    e = scratch(
        edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "cc"
    )
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v")))
        small = scratch(small.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc")
        if not _changed(e, small):
            break
        e = small
    star = e.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("id"), "component")
    return star.union(star.select(F.col("component").alias("id"), "component").distinct())


class Links:
    """Union-find over 0..n-1 with the least index as root; a small helper inside tasks."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return int(i)

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        if i != j:
            self.up[max(i, j)] = min(i, j)
        return i != j

    def roots(self) -> np.ndarray:
        while True:
            up = self.up[self.up]
            if (up == self.up).all():
                return up
            self.up = up


def text_or_empty(c: str | Column = "text") -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def let(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once, however often it is named."""
    return F.transform(F.array(value), use)[0]


def sums_before(values: Column) -> Column:
    """For each item of an array<int> the sum of the items before it.

    Items are summed in blocks of about the root of their number, and the blocks' sums likewise: an array that grows item
    by item is copied for each, which long arrays can't bear."""

    def running(a: Column) -> Column:
        zero = F.array(F.lit(0)).cast("array<int>")
        return F.aggregate(a, zero, lambda sums, x: F.array_append(sums, F.element_at(sums, -1) + x).cast("array<int>"))

    def of(a: Column) -> Column:
        width = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(a)))).cast("int")
        last = F.greatest(F.lit(0), F.floor((F.size(a) - 1) / width)).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), last), lambda i: running(F.slice(a, i * width + 1, width)))
        return let(blocks, joined)

    def joined(blocks: Column) -> Column:
        starts = running(F.transform(blocks, lambda b: F.element_at(b, -1)))
        own = F.zip_with(blocks, F.slice(starts, F.lit(1), F.size(blocks)), lambda b, at: F.transform(F.slice(b, F.lit(1), F.size(b) - 1), lambda x: at + x))
        return F.flatten(own)

    return let(values, of)
