"""Exact dedup over a log-structured merge index of digests, with DataFrame functions only.

Every text is normalised and digested once; what follows moves digests. Rows are dealt to memtables, and each memtable
flushes one run: its digests in order, each with its best row so far and a count, and the run's own filter. A run's digests
are probed in the filters of the other runs; those that none may hold skip compaction, which merges the rest and keeps for
each digest the best identifier (longest original text, then smallest doc_id). Digests of more than one row are hits. The texts of hits are
read again and compared byte by byte: where two texts share a digest, their rows are grouped by the text itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeloom.llm.common import BITS_PER_BUCKET, bit_filter, filter_bits, maybe_in, scratch, text_or_empty

SPACE = r"[\x20\x09-\x0D]+"
MEMTABLES, MEMTABLE_ROWS = 16, 1_000_000  # at least so many memtables, of about so many rows at most
HASHES = 4  # bits of a digest in a filter of 16 to 32 bits a digest: one in 400 to 5,000 is found in a run that lacks it
FILTER_BYTES = 1 << 26  # of all runs' filters together, beyond which they aren't broadcast


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, SPACE, "")


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def best_first() -> Column:
    """Least for the row that stays: most code points, then smallest doc_id, a null doc_id last, then the row's number."""
    return F.struct((-F.col("chars")).alias("less"), F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("row").alias("row"))


def _keyed(docs: DataFrame, digest) -> DataFrame:
    """row, doc_id, chars, text_sha256 and digest of every row."""
    text = text_or_empty()
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.length(text).cast("long").alias("chars"), normalised(text).alias("norm"))
    return rows.select("row", "doc_id", "chars", sha256(F.col("norm")).alias("text_sha256"), digest(F.col("norm")).alias("digest"))


def flush(keyed: DataFrame, memtables: int = MEMTABLES, memtable_rows: int = MEMTABLE_ROWS) -> DataFrame:
    """Sorted runs: run, digest, best, rows."""
    n = max(memtables, -(-keyed.count() // memtable_rows))  # Parquet's own row counts
    rows = keyed.select(F.pmod(F.xxhash64("row"), F.lit(n)).cast("int").alias("run"), "digest", best_first().alias("best"))
    run = rows.repartition(n, "run").groupBy("run", "digest").agg(F.min("best").alias("best"), F.count("*").alias("rows"))
    return scratch(run.sortWithinPartitions("run", "digest"), "run", ["run"])


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("digest"), F.lit(buckets))


def _places() -> list[Column]:
    """Where a digest's bits are inside its bucket."""
    h = F.xxhash64("digest", F.lit(HASHES))
    return [F.shiftright(h, 15 * i).bitwiseAND(F.lit(BITS_PER_BUCKET - 1)) for i in range(HASHES)]


def run_filters(runs: DataFrame, buckets: int) -> DataFrame:
    """The filter of each run, as rows (run, bucket, bits) of 4 KB: a Bloom filter whose keys keep their bits in one bucket."""
    places = runs.select("run", _bucket(buckets).alias("bucket"), F.explode(F.array(*_places())).alias("at"))
    return scratch(places.groupBy("run", "bucket").agg(F.bitmap_construct_agg("at").alias("bits")), "filters")


def _has(bits: Column, at: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bits, (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    return F.call_function("getbit", byte, (at % 8).cast("int")) == 1


def shared_by_runs(runs: DataFrame) -> DataFrame:
    """The runs' entries that another run may have too, or that stand for several rows: each entry is probed in the filters
    of the runs beside its own. Filters of more than ``FILTER_BYTES`` in all aren't broadcast; then runs are merged whole."""
    sizes = runs.groupBy("run").count().agg(F.count("*"), F.max("count")).first()
    buckets = max(1, (1 << (16 * (sizes[1] or 1) - 1).bit_length()) // BITS_PER_BUCKET)
    if sizes[0] * buckets * BITS_PER_BUCKET // 8 > FILTER_BYTES:
        return runs
    filters = run_filters(runs, buckets).groupBy("bucket").agg(F.collect_list(F.struct("run", "bits")).alias("filters"))
    probes = runs.withColumns({"at": _bucket(buckets), **{f"p{i}": p for i, p in enumerate(_places())}})

    def may_hold(f: Column) -> Column:
        test = f["run"] != F.col("run")
        for i in range(HASHES):
            test = test & _has(f["bits"], F.col(f"p{i}"))
        return test

    met = probes.join(F.broadcast(filters), F.col("at") == F.col("bucket")).where((F.col("rows") > 1) | F.exists("filters", may_hold))
    return met.select("run", "digest", "best", "rows")


def compact(runs: DataFrame) -> DataFrame:
    """Merges runs: per digest the best row and the number of rows."""
    level = runs.groupBy("digest").agg(F.min("best").alias("best"), F.sum("rows").alias("rows"))
    return scratch(level.sortWithinPartitions("digest"), "level")


def _texts_of(hits: DataFrame, keyed: DataFrame, docs: DataFrame, digest) -> DataFrame:
    """row, doc_id, chars, norm, text_sha256, digest of at least the rows whose digest is a hit: read again by doc_id."""
    bits = filter_bits(hits.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0])
    ids = keyed.join(hits.select("digest"), "digest", "left_semi").select("doc_id")
    again = maybe_in(docs, "doc_id", scratch(bit_filter(ids, "doc_id", bits), "filter"), "hit", bits).where("hit")
    text = text_or_empty()
    rows = again.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.length(text).cast("long").alias("chars"), normalised(text).alias("norm"))
    return rows.select("*", sha256(F.col("norm")).alias("text_sha256"), digest(F.col("norm")).alias("digest"))


def _decided(rows: DataFrame, groups: DataFrame, key: str) -> DataFrame:
    """What becomes of ``rows`` by the groups (key, best, rows) of more than one row."""
    g = groups.select(F.col(key).alias("g_key"), F.col("best.id").alias("keep"), F.col("best.row").alias("keep_row"), F.col("rows").alias("size"))
    joined = rows.join(g, rows[key] == g["g_key"], "left")
    alone = F.col("size").isNull()
    return joined.select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("keep")).alias("keep_id"), F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("row") == F.col("keep_row"))).alias("kept"), "text_sha256",
    )


def exact_dedup(docs: DataFrame, digest=sha256, memtables: int = MEMTABLES) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical without the characters of [\\x20\\x09-\\x0D]; null counts as empty, and empty texts
    are one group. Of equal texts one row stays: that with the most code points, then the smallest doc_id, null ids
    last; of rows that are equal in all of that, any one. ``digest`` maps a normalised text to its key; a weak one costs
    time but never merges different texts. Other columns are not read; an empty table gives no rows.
    """
    docs = docs.select("doc_id", "text")
    keyed = scratch(_keyed(docs, digest), "keyed")
    hits = scratch(compact(shared_by_runs(flush(keyed, memtables))).where("rows > 1"), "hits")
    texts = _texts_of(hits, keyed, docs, digest)
    # byte verification: the digests that two texts share; copies combine before they are shuffled
    shared = scratch(texts.select("digest", "norm").distinct().groupBy("digest").agg(F.count("*").alias("texts")).where("texts > 1").select("digest"), "shared")
    if shared.isEmpty():
        return _decided(keyed, hits, "digest")
    own = scratch(texts.join(shared, "digest", "left_semi"), "texts")
    groups = scratch(own.groupBy("norm").agg(F.min(best_first()).alias("best"), F.count("*").alias("rows")).where("rows > 1"), "groups")
    return _decided(keyed.join(shared, "digest", "left_anti"), hits, "digest").union(_decided(own, groups, "norm"))
