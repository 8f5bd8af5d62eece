"""Keyed tables that batches, of streams or not, merge into: each batch counts once, and only what it changes is written.

A table is a folder of partial rows and a log. A batch adds its own partial rows (one for each key that it touches) to a
new folder and then one line to the log, which makes them visible; a batch that the log has is left out when it is tried
again. Readers combine the partial rows by key, so they never meet a half-written folder. ``compact`` folds the folders into
one, and there keys whose time is over can go: the stream itself keeps no state.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LOG = "batch long, base boolean, path string"


@dataclass(frozen=True)
class MergeTable:
    """``combine`` makes one row a key of partial rows, or of rows combined before, in whatever order and grouping."""

    spark: SparkSession
    path: str
    schema: str
    combine: Callable[[DataFrame], DataFrame]

    def _log(self) -> DataFrame:
        try:
            return self.spark.read.schema(LOG).parquet(f"{self.path}/log")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], LOG)  # no batch yet

    def _write(self, rows: DataFrame, batch: int, base: bool) -> None:
        path = f"{self.path}/rows/{'base' if base else 'batch'}-{batch}-{uuid.uuid4().hex}"
        rows.write.parquet(path)
        self.spark.createDataFrame([(batch, base, path)], LOG).coalesce(1).write.mode("append").parquet(f"{self.path}/log")

    def add(self, rows: DataFrame, batch: int) -> bool:
        """Merges a batch's partial rows unless the table has that batch; says whether it did."""
        if not self._log().where(F.col("batch") >= batch).isEmpty():  # batches come in order
            return False
        self._write(self.combine(rows), batch, base=False)
        return True

    def _folders(self) -> tuple[int, list[str]]:
        """The last batch, and the folders that hold the table: the newest base and the batches after it."""
        log = self._log()
        last, base = log.agg(F.max("batch"), F.max(F.when(F.col("base"), F.col("batch")))).first()
        base = -1 if base is None else base
        found = log.where((F.col("batch") > base) | (F.col("base") & (F.col("batch") == base))).select("path").collect()  # as many as batches since compaction
        return -1 if last is None else last, [r["path"] for r in found]

    def read(self) -> DataFrame:
        _, folders = self._folders()
        if not folders:
            return self.combine(self.spark.createDataFrame([], self.schema))
        return self.combine(self.spark.read.schema(self.schema).parquet(*folders))

    def compact(self, keep: Column | None = None) -> None:
        """Folds all batches into one folder; without ``keep`` every key stays. A key that goes starts anew if it comes again."""
        last, folders = self._folders()
        if folders:
            rows = self.read()
            self._write(rows if keep is None else rows.where(keep), last, base=True)

    def drain(self, stream: DataFrame, prepare: Callable[[DataFrame, int], DataFrame] | None = None) -> DataFrame:
        """Merges what a stream's source holds now, going on from its checkpoint, and reads the table. ``prepare`` makes
        partial rows of a batch."""
        each = prepare or (lambda rows, _: rows)
        writer = stream.writeStream.outputMode("append").option("checkpointLocation", f"{self.path}/checkpoint").trigger(availableNow=True)
        writer.foreachBatch(lambda rows, batch: self.add(each(rows, batch), batch)).start().awaitTermination()
        return self.read()
