"""Sharding by a k-d tree: recursive splits at weighted medians along the widest metadata dimension.

Equal texts are one point, of the sum of their sizes, so that they share a shard; a group that exceeds a shard is dealt
into pieces first. A dimension has up to 256 levels, and points of equal level are parted by a hash. A node that must
become k shards is cut where ceil(k/2) of its k shares of bytes lie below. All nodes of a level are cut together: one
pass sums the bytes of each level of every dimension, and where the cut falls inside a level, a pass sums the level by
its points' hashes, in 1,024 bins and again inside a bin that is still too coarse.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradeloom.llm.common import scratch

SHARDS = 40
LEVELS = (256, 64, 64)  # of size (by logarithm), source and lang (by hash: rows of one value lie together)
TIE_BITS, BIN_BITS = 30, 10
COARSE = 0.004  # of a shard's bytes: a bin of more than that is looked into
PIECES = 64  # of a shard's size, that a larger group is dealt into
SLOT_BUCKETS = 256


@dataclass
class Tree:
    """Inner nodes by number: dimension, first key of the right child, children; leaves carry a shard."""

    dim: list[int] = field(default_factory=list)
    cut: list[int] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)
    shard: list[int] = field(default_factory=list)

    def add(self, depth: int) -> int:
        for a, x in ((self.dim, 0), (self.cut, 0), (self.left, -1), (self.right, -1), (self.depth, depth), (self.shard, -1)):
            a.append(x)
        return len(self.dim) - 1

    def placed(self, points: DataFrame, keys: list[str]) -> DataFrame:
        """``points`` with the node that they are in as far as the tree has grown. Each level is a small table of at most
        ``shards`` nodes, which is broadcast."""
        rows = points.withColumn("node", F.lit(0))
        for d in range(max(self.depth)):
            inner = [(n, self.dim[n] + 1, self.cut[n], self.left[n], self.right[n]) for n in range(len(self.dim)) if self.depth[n] == d and self.left[n] >= 0]
            step = points.sparkSession.createDataFrame(inner, "node int, dim int, cut long, left int, right int")
            to = F.when(F.element_at(F.array(*keys), F.col("dim")) >= F.col("cut"), F.col("right")).otherwise(F.col("left"))
            rows = rows.join(F.broadcast(step), "node", "left").withColumn("node", F.coalesce(to, "node")).drop("dim", "cut", "left", "right")
        return rows


def sized(docs: DataFrame, carry: list[str]) -> DataFrame:
    """row, doc_id, size, text_crc32, a hash of the text, the metadata, and what is to be carried."""
    text = F.encode(F.coalesce("text", F.lit("")), "utf-8")
    return docs.select(
        F.monotonically_increasing_id().alias("row"),
        "doc_id",
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.xxhash64(text).alias("same"),
        F.coalesce("source", F.lit("")).alias("source"),
        F.coalesce("lang", F.lit("")).alias("lang"),
        *([F.struct(*carry).alias("carried")] if carry else []),
    )


TEXT = ["same", "size", "text_crc32"]


def _points(rows: DataFrame, target: float) -> tuple[DataFrame, DataFrame]:
    """Rows with the piece of their group that they are in, and the points: one for each piece, with its metadata.

    A group is dealt into pieces if it exceeds ``target`` bytes, so fewer groups than shards are: their rows are
    broadcast. All others are one piece. Rows are dealt by their number, so that equal ones and those without an id
    spread as well."""
    large = rows.groupBy(*TEXT).agg(F.sum("size").alias("all")).where(F.col("all") > target)
    large = F.broadcast(large.select(*TEXT, F.ceil(F.col("all") / (target / PIECES)).alias("pieces")))
    piece = F.coalesce(F.pmod(F.xxhash64("row"), F.col("pieces")), F.lit(0))
    rows = rows.join(large, TEXT, "left").select("row", "doc_id", *TEXT, "source", "lang", piece.cast("long").alias("piece"))
    return rows, rows.groupBy(*TEXT, "piece").agg(F.sum("size").alias("bytes"), F.min("source").alias("g_source"), F.min("lang").alias("g_lang"))


def _keys() -> list[Column]:
    """Keys along size, source and lang: the level, and below it the hash that parts points of one level."""
    tie = F.pmod(F.xxhash64("same", "piece"), F.lit(1 << TIE_BITS))
    size = F.least(F.log2(F.col("size").cast("double")) * 8, F.lit(LEVELS[0] - 1.0)).cast("long")
    level = [size, F.crc32("g_source") % LEVELS[1], F.crc32("g_lang") % LEVELS[2]]
    return [(v.cast("long") * (1 << TIE_BITS) + tie).alias(f"k{i}") for i, v in enumerate(level)]


KEYS = [f"k{i}" for i in range(len(LEVELS))]


def _split(bins: list[tuple], below: int, want: float) -> tuple[tuple, int]:
    """The bin (start, bytes, points) that the wanted bytes end in, and the bytes below it."""
    for b in bins:
        if below + b[1] >= want or b is bins[-1]:
            return b, below
        below += b[1]
    raise ValueError("no bins")


def grow(points: DataFrame, shards: int) -> Tree:
    """The tree over points (k0.., bytes). Only sums come to the driver: of a pass at most 384 for each of at most
    ``shards`` nodes, or 1,024 for each node that is cut inside a level."""
    tree, share = Tree(), {}
    share[tree.add(0)] = shards
    spread: list[int] | None = None
    while open_nodes := [n for n, k in share.items() if k > 1]:
        placed = tree.placed(points, KEYS).where(F.col("node").isin(open_nodes))
        levels = [F.shiftright(k, TIE_BITS).cast("int") for k in KEYS]
        each = placed.groupBy("node", *(v.alias(f"v{i}") for i, v in enumerate(levels))).agg(F.sum("bytes").alias("b"))
        lines = each.select("node", F.posexplode(F.array(*(f"v{i}" for i in range(len(KEYS))))).alias("d", "v"), "b").groupBy("node", "d", "v").agg(F.sum("b").alias("b"))
        sums: dict[int, dict[int, list]] = defaultdict(lambda: defaultdict(list))
        for r in lines.collect():
            sums[r["node"]][r["d"]].append((r["v"], r["b"], 2))
        for own in sums.values():
            for bins in own.values():
                bins.sort()
        spread = spread or [max(1, own[d][-1][0] - own[d][0][0]) for own in [sums[0]] for d in own] if sums else spread
        cuts = {}  # node: dimension, first key on the right
        busy = {}  # node: dimension, lowest key of the range that the cut is in, its bits, bytes below it, bytes wanted
        for n in open_nodes:
            if n not in sums:  # nothing to part: its shards stay empty but one
                cuts[n] = (0, 0)
                continue
            own = sums[n]
            d = max(range(len(KEYS)), key=lambda i, own=own: ((own[i][-1][0] - own[i][0][0]) / spread[i], -i))
            want = sum(b for _, b, _ in own[d]) * ((share[n] + 1) // 2) / share[n]
            at, below = _split(own[d], 0, want)
            busy[n] = (d, at[0] << TIE_BITS, TIE_BITS, below, want)
        coarse = {n: COARSE * c[4] / ((share[n] + 1) // 2) for n, c in busy.items()}
        while busy:
            # nodes of a round look at the same bits, as ranges shrink alike
            bits = max(0, next(iter(busy.values()))[2] - BIN_BITS)
            asked = points.sparkSession.createDataFrame([(n, c[0] + 1, c[1]) for n, c in busy.items()], "node int, dim int, low long")
            own = placed.join(F.broadcast(asked), "node").select("node", "bytes", F.element_at(F.array(*KEYS), F.col("dim")).alias("key"), "low")
            own = own.where((F.col("key") >= F.col("low")) & (F.col("key") < F.col("low") + (1 << (bits + BIN_BITS))))
            bins: dict[int, list] = defaultdict(list)
            for r in own.groupBy("node", F.shiftright("key", bits).alias("bin")).agg(F.sum("bytes").alias("b"), F.count("*").alias("points")).collect():
                bins[r["node"]].append((r["bin"], r["b"], r["points"]))
            left = {}
            for n, (d, _, _, below, want) in busy.items():
                at, below = _split(sorted(bins[n]), below, want)
                if bits == 0 or at[2] == 1 or at[1] <= coarse[n]:  # the bin goes to the side that it overfills less
                    cuts[n] = (d, (at[0] + (below + at[1] - want <= want - below)) << bits)
                else:
                    left[n] = (d, at[0] << bits, bits, below, want)
            busy = left
        for n in open_nodes:
            k = share.pop(n)
            tree.dim[n], tree.cut[n] = cuts[n]
            tree.left[n], tree.right[n] = tree.add(tree.depth[n] + 1), tree.add(tree.depth[n] + 1)
            share[tree.left[n]], share[tree.right[n]] = (k + 1) // 2, k // 2
    for i, n in enumerate(sorted(share)):
        tree.shard[n] = i
    return tree


def kd_shards(docs: DataFrame, shards: int = SHARDS, carry: list[str] | None = None) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, source, lang): doc_id, size, text_crc32, law, shard, slot, grown_shard,
    and the columns that ``carry`` names, as a struct ``carried``.

    size is the text's UTF-8 bytes and 16 (null: none); the law is ``bytes``. Equal texts share a shard unless their
    group is larger than a shard; rows of such a group are dealt by their place in the table. slot counts rows of a shard
    from 0, in no particular order. Nulls in metadata count as empty; rows that repeat, and rows without doc_id, are rows
    of their own. Fewer points than shards leave some empty; an empty table gives no rows. Other columns are not read.
    """
    all_rows = scratch(sized(docs, carry or []), "sized")
    rows = all_rows.drop("carried")
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    rows, points = _points(rows, max(1.0, total / shards))
    points = scratch(points.select(*TEXT, "piece", "bytes", *_keys()), "points")
    tree = grow(points, shards)
    where = tree.placed(points, KEYS).select(*TEXT, "piece", F.element_at(F.array(*map(F.lit, tree.shard)), F.col("node") + 1).alias("shard"))
    bucket = F.pmod(F.xxhash64("row", F.lit("slot")), F.lit(SLOT_BUCKETS)).cast("int")
    placed = scratch(rows.join(where, [*TEXT, "piece"]).select("row", "doc_id", "size", "text_crc32", "shard", bucket.alias("bucket")), "placed")
    out = with_slots(placed)
    if carry:
        out = out.drop("doc_id", "size", "text_crc32").join(all_rows.select("row", "doc_id", "size", "text_crc32", "carried"), "row")
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), *(["carried"] if carry else [])
    )


def with_slots(placed: DataFrame) -> DataFrame:
    """Adds slot, gapless from 0 in each shard: a prefix sum over the shard's buckets, then a count inside a bucket."""
    counts = placed.groupBy("shard", "bucket").agg(F.count("*").alias("n"))  # at most shards x 256 rows
    before = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("shard", "bucket", before.alias("before"))
    inside = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("row")) - 1
    return placed.withColumn("inside", inside).join(F.broadcast(offsets), ["shard", "bucket"]).withColumn("slot", (F.col("before") + F.col("inside")).cast("long"))
