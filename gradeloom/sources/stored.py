"""Stored tables that change by copy on write: only the partitions that hold touched keys are read and written anew.

A table is a folder of partitions (rows by a hash of their key) and a log that says which folder a partition's rows are in.
A change writes new folders for the partitions that it touches and then one log entry for all of them, so readers see all of
a change or nothing; the files of other partitions stay as they are, under their names. Rows without a key are in a
partition of their own."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.operators import maintenance
from gradeloom.sources.files import written

LOG = "version int, part int, path string"
NO_KEY = -1


@dataclass(frozen=True)
class StoredTable:
    spark: SparkSession
    path: str
    key: str
    parts: int
    schema: str

    def part(self):
        return F.when(F.col(self.key).isNull(), NO_KEY).otherwise(F.pmod(F.xxhash64(self.key), F.lit(self.parts))).cast("int")

    def folders(self) -> dict[int, str]:
        """The newest folder of each partition that has ever had rows: at most parts + 1."""
        log = self.spark.read.schema(LOG).parquet(f"{self.path}/log").groupBy("part").agg(F.max_by("path", "version").alias("path"))
        return {r["part"]: r["path"] for r in log.collect()}

    def version(self) -> int:
        return self.spark.read.schema(LOG).parquet(f"{self.path}/log").agg(F.coalesce(F.max("version"), F.lit(-1))).first()[0]

    def read(self, parts: set[int] | None = None) -> DataFrame:
        """The rows, of the given partitions only if some are given."""
        paths = [p for k, p in self.folders().items() if parts is None or k in parts]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def _commit(self, rows: DataFrame, parts: set[int], version: int) -> None:
        """``rows`` are all that the given partitions hold from now on."""
        folder = f"{self.path}/rows/{version}-{uuid.uuid4().hex}"
        rows.withColumn("part", self.part()).repartition("part").write.partitionBy("part").parquet(folder)
        empty = f"{folder}-none"
        there = {r["part"] for r in self.spark.read.schema(f"{self.schema}, part int").parquet(folder).select("part").distinct().collect()} if parts else set()
        if parts - there:
            self.spark.createDataFrame([], self.schema).write.parquet(empty)
        entries = [(version, p, f"{folder}/part={p}" if p in there else empty) for p in sorted(parts)]
        self.spark.createDataFrame(entries, LOG).coalesce(1).write.mode("append").parquet(f"{self.path}/log")

    def change(self, keys: DataFrame, new_rows: Callable[[DataFrame], DataFrame]) -> set[int]:
        """Replaces the partitions of ``keys`` (column of the key's name) by ``new_rows`` of what they held, which must
        stay in these partitions. Returns the partitions."""
        touched = {r["part"] for r in keys.select(self.part().alias("part")).distinct().collect()}  # at most parts + 1
        if touched:
            self._commit(new_rows(self.read(touched)).select(*(c.split()[0] for c in self.schema.split(", "))), touched, self.version() + 1)
        return touched

    def patch(self, patches: DataFrame, fields: list[str], seq: str = "seq") -> set[int]:
        """Partial updates: for every field the last patch that sets it counts; patches of absent keys do nothing."""
        return self.change(patches, lambda old: maintenance.patch(old, patches, self.key, fields, seq))

    def upsert(self, new: DataFrame) -> set[int]:
        """Inserts rows whose key is absent; else their non-null fields overwrite."""
        return self.change(new, lambda old: maintenance.upsert(old, new, self.key))

    def replace(self, rows: DataFrame) -> set[int]:
        """Puts ``rows`` in the place of all rows of their keys; other keys stay."""
        return self.change(rows, lambda old: maintenance.without(old, self.key, rows, self.key).unionByName(rows))

    def delete(self, keys: DataFrame) -> set[int]:
        """Takes away the rows of ``keys``."""
        return self.change(keys, lambda old: maintenance.without(old, self.key, keys, self.key))


def store(df: DataFrame, path: str, key: str, parts: int) -> StoredTable:
    """Writes ``df`` as a stored table's first version."""
    own = StoredTable(df.sparkSession, path, key, parts, ", ".join(f"{c} {kind}" for c, kind in df.dtypes))
    own._commit(df, {NO_KEY, *range(parts)}, 0)
    return own


@dataclass(frozen=True)
class Exam:
    """The stored tables that hang together: each child is partitioned by the parent's key, so a cascade prunes as well."""

    tests: StoredTable  # by id
    configs: StoredTable  # by test_id
    questions: StoredTable  # by test_id
    attempts: StoredTable  # by test_id
    answers: StoredTable  # by attempt_id
    activity: StoredTable  # by attempt_id

    def delete_tests(self, gone: DataFrame) -> dict[str, set[int]]:
        """Deletes tests (id) with all that hangs on them, tab activity included, children first, so that what broke off can
        be done again. Returns the partitions touched of each table."""
        by_test = gone.select(F.col("id").alias("test_id"))
        held = {r["part"] for r in by_test.select(self.attempts.part().alias("part")).distinct().collect()}  # at most parts + 1
        lost = written(self.attempts.read(held).join(by_test, "test_id", "left_semi").select(F.col("id").alias("attempt_id")), "lost")
        out = {"activity": self.activity.delete(lost), "answers": self.answers.delete(lost)}
        for name in ("attempts", "questions", "configs"):
            out[name] = getattr(self, name).delete(by_test)
        return out | {"tests": self.tests.delete(gone.select("id"))}
