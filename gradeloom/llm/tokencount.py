"""Token counts by a separator scan of flat token streams that have no index.

A stream is a flat file of token ids in which an end-of-document id follows each document, and nothing says where. It is
read by byte ranges of a fixed number of ids. Every such block is searched by itself, vectorised; a prefix scan over the
blocks' summaries stitches the documents that blocks cut.
"""

from __future__ import annotations

import base64
import os
import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gradeloom.llm.common import scratch, shared_folder

#: A public byte-level vocabulary, its free id, and ids in a block.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
END_OF_DOCUMENT = 50256
BLOCK = 1 << 18


@lru_cache(maxsize=2)
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def write_streams(docs: DataFrame, vocabulary: str = VOCABULARY, end: int = END_OF_DOCUMENT, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Tokenises whole texts into flat files of little-endian uint16 ids, one for each input partition, in the shared folder.

    Returns the files (stream, path, length) and the manifest (stream, ordinal, doc_id), which the scan doesn't read. The
    end-of-document id never comes from a text. A file's name is its attempt's own and counts only if Spark has committed
    that attempt's rows, so a task that is tried again, or twice at once, leaves the result as it is. The vocabulary goes to
    the executors with the job."""
    spark = docs.sparkSession
    spark.sparkContext.addFile(vocabulary)
    name, folder = os.path.basename(vocabulary), f"{shared_folder(spark)}/gradeloom/flat-{uuid.uuid4().hex}"

    def encode(batches):
        from pyarrow import fs

        coder, stream = _encoding(SparkFiles.get(name)), TaskContext.get().partitionId()
        store, at = fs.FileSystem.from_uri(folder)
        store.create_dir(at, recursive=True)
        path = f"stream-{stream}-{TaskContext.get().taskAttemptId()}-{uuid.uuid4().hex}.ids"
        held, ordinal, ready, length = [], 0, 0, 0

        def rows(kind, numbers, doc, path=None):
            n = len(numbers)
            return pa.RecordBatch.from_arrays([pa.array([kind] * n, pa.int32()), pa.array([stream] * n, pa.int64()), pa.array(numbers, pa.int64()), pa.array([path] * n, pa.string()), doc], ["kind", "stream", "number", "path", "doc_id"])

        with store.open_output_stream(f"{at}/{path}") as f:
            for batch in batches:
                n = batch.num_rows
                yield rows(1, np.arange(ordinal, ordinal + n), batch.column(0))
                ordinal += n
                for text in batch.column(1):
                    ids = coder.encode_ordinary(text.as_py() or "")
                    ids.append(end)
                    held.append(np.array(ids, np.uint16))
                    ready += len(ids)
                    if ready >= block:
                        f.write(np.concatenate(held).tobytes())
                        held, length, ready = [], length + 2 * ready, 0
            if ready:
                f.write(np.concatenate(held).tobytes())
        yield rows(0, [length + 2 * ready], pa.nulls(1, pa.int64()), f"{folder}/{path}")

    both = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(encode, "kind int, stream long, number long, path string, doc_id long")
    both = scratch(both, "streams", ["kind"])
    return both.where("kind = 0").select("stream", "path", F.col("number").alias("length")), both.where("kind = 1").select("stream", F.col("number").alias("ordinal"), "doc_id")


def flat_files(spark: SparkSession, path: str) -> DataFrame:
    """(stream: a file's path, path, length) of the flat files of a folder; Spark lists them, without their contents."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("stream"), "path", "length")


def read_flat(files: DataFrame, block: int = BLOCK) -> DataFrame:
    """Blocks (stream, block, ids) of flat files (stream, path, length) of uint16 ids, however large.

    Every block is a byte range that one task reads by itself through Arrow's file systems, so a file is as parallel as its
    blocks are many. The last block is as long as what is left."""
    ranges = files.where("length > 0").select("stream", "path", F.explode(F.sequence(F.lit(0), F.expr(f"(length - 1) div {2 * block}"))).alias("block"))
    kind = ranges.schema["stream"].dataType.simpleString()

    def read(batches):
        from pyarrow import fs

        for batch in batches:
            for i, (name, number) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                store, at = fs.FileSystem.from_uri(name)
                with store.open_input_file(at) as f:
                    ids = f.read_at(min(2 * block, f.size() - 2 * block * number), 2 * block * number)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.array([number], pa.int64()), pa.array([ids], pa.binary())], ["stream", "block", "ids"])

    spread = ranges.repartition(max(1, files.sparkSession.sparkContext.defaultParallelism * 4), "stream", "block")
    return spread.mapInArrow(read, f"stream {kind}, block long, ids binary")


def scan_separators(blocks: DataFrame, end: int = END_OF_DOCUMENT) -> DataFrame:
    """(stream, ordinal, n_tokens, closed) for each document of ``blocks`` (stream, block, ids), in the streams' order.

    Ids after a stream's last separator are a document with closed false. A null or empty block has no ids; blocks come
    in any order, and a (stream, block) is expected once. The prefix scan sees one short row for each block.
    """
    kind = blocks.schema["stream"].dataType.simpleString()

    def search(batches):
        for batch in batches:
            size, first, last, lengths = [], [], [], []
            for ids in batch.column(2):
                flat = np.frombuffer(ids.as_py() or b"", np.uint16)
                at = np.flatnonzero(flat == end)
                size.append(len(flat))
                first.append(int(at[0]) if len(at) else None)
                last.append(int(at[-1]) if len(at) else None)
                lengths.append(np.diff(at) - 1 if len(at) else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(size, pa.int64()), pa.array(first, pa.int64()), pa.array(last, pa.int64()), pa.array(lengths, pa.list_(pa.int64()))], ["stream", "block", "size", "first", "last", "inner"])

    found = blocks.select("stream", "block", "ids").mapInArrow(search, f"stream {kind}, block long, size long, first long, last long, inner array<long>")
    before = Window.partitionBy("stream").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    begin = F.coalesce(F.sum("size").over(before), F.lit(0))
    prior = F.coalesce(F.sum(F.when(F.col("first").isNull(), 0).otherwise(F.size("inner") + 1)).over(before), F.lit(0))
    scanned = found.withColumn("begin", begin).withColumn("ordinal", prior).withColumn("sep", F.col("begin") + F.col("last"))
    scanned = scanned.withColumn("since", F.coalesce(F.max("sep").over(before), F.lit(-1)))
    cut = F.array(F.col("begin") + F.col("first") - F.col("since") - 1)
    closed = scanned.where("first is not null").select("stream", "ordinal", F.posexplode(F.concat(cut, "inner")).alias("i", "n_tokens"))
    closed = closed.select("stream", (F.col("ordinal") + F.col("i")).alias("ordinal"), "n_tokens", F.lit(True).alias("closed"))
    ends = found.groupBy("stream").agg(F.sum("size").alias("size"), F.sum(F.when(F.col("first").isNull(), 0).otherwise(F.size("inner") + 1)).alias("ordinal"))
    tail = ends.join(closed.groupBy("stream").agg(F.sum(F.col("n_tokens") + 1).alias("used")), "stream", "left")
    tail = tail.select("stream", F.col("ordinal").cast("long"), (F.col("size") - F.coalesce("used", F.lit(0))).alias("n_tokens"), F.lit(False).alias("closed"))
    return closed.union(tail.where("n_tokens > 0"))


def count_tokens(docs: DataFrame, vocabulary: str = VOCABULARY, block: int = BLOCK) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_tokens, stream, ordinal; a null or empty text has 0."""
    files, manifest = write_streams(docs, vocabulary, block=block)
    counts = scan_separators(read_flat(files, block))
    return manifest.join(counts, ["stream", "ordinal"]).select("doc_id", "n_tokens", "stream", "ordinal")
