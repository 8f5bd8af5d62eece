"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked exactly by vantage-point trees.

Each node of a tree has a vantage point and a radius: fingerprints within the radius of it are inside, the others
outside. By the triangle inequality a pair of at most k differing bits that a node parts has its inner end within k of the
boundary, so inner ones near it go outside as well; then every such pair meets in a leaf. The upper tree is fitted on a
bounded sample and its leaves are the shards; every fingerprint goes to its own shard and those whose boundary is near.
A shard is linked in one task by the same partition, going on until few are left; branches that are one component are
left out, so a dense group of near copies isn't compared pair by pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeloom.llm.common import Links, components, scratch

SEED = 42
SHARD, LEAST_SHARDS, MOST_SHARDS = 4096, 256, 1 << 14  # fingerprints a shard; beyond 2^14 shards they grow
SAMPLE = 16  # fingerprints a shard on which the upper tree is fitted
LEAF = 4096  # pairs that are compared at once
BITS = 1 << 16  # shingles whose bits are counted at once


def simhash(text: bytes, n: int = 3) -> int:
    """The fingerprint of a text: bits set in over half of its shingles' hashes, repeats included."""
    words = text.lower().split()
    if not words:
        return 0
    whole = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    spans = zip(starts.tolist(), ends[n - 1 :].tolist()) if len(words) >= n else [(0, len(whole))]
    h = np.fromiter((xxhash.xxh64_intdigest(whole[a:b], SEED) for a, b in spans), np.uint64)
    count = sum(np.unpackbits(h[lo : lo + BITS].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64) for lo in range(0, len(h), BITS))
    return int(np.packbits(2 * count > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, n: int = 3) -> DataFrame:
    """(doc_id, fp) for each row of (doc_id long, text); a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            fp = np.array([simhash(t.as_py() or b"", n) for t in texts], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


def distances(x: np.ndarray, y) -> np.ndarray:
    return np.bitwise_count(x ^ y).astype(np.int64)


def radius(d: np.ndarray, k: int) -> int:
    """A radius near the median with as few distances as possible just inside it; -1 if it can't part them."""
    low, high = int(d.min()), int(d.max())
    if low == high:
        return -1
    inside = np.cumsum(np.bincount(d, minlength=high + 1))
    r = np.arange(low, high)
    uneven = np.abs(2 * inside[r] - len(d)) / len(d)
    band = (inside[r] - np.where(r - k >= 0, inside[np.maximum(r - k, 0)], 0)) / len(d)
    return int(r[np.argmin(band + uneven)])


class VantageTree:
    """A vantage-point tree whose leaves are shards, fitted on a sample of fingerprints."""

    def __init__(self, sample: np.ndarray, shards: int, k: int):
        self.k, self.nodes, self.shards = k, [], 0  # a node: (vantage, radius, inside, outside), or (shard,)
        self._grow(np.sort(sample), max(1, len(sample) // shards))

    def _grow(self, own: np.ndarray, leaf: int) -> int:
        at = len(self.nodes)
        self.nodes.append(())
        r = -1
        if len(own) > leaf:
            some = own[:: max(1, len(own) // 8)][:8]  # of a few vantage points the one that spreads the others most
            v = max(some, key=lambda x: distances(own, x).std())
            d = distances(own, v)
            r = radius(d, self.k)
        if r < 0:
            self.nodes[at] = (self.shards,)
            self.shards += 1
        else:
            self.nodes[at] = (v, r, self._grow(own[d <= r], leaf), self._grow(own[d > r], leaf))
        return at

    def route(self, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of a fingerprint, shard): its own shard, and those beyond a boundary within k of it."""
        out, stack = [], [(0, np.arange(len(fp)))]
        while stack:
            at, own = stack.pop()
            if not len(own):
                continue
            if len(self.nodes[at]) == 1:
                out.append((own, np.full(len(own), self.nodes[at][0])))
                continue
            v, r, inside, outside = self.nodes[at]
            d = distances(fp[own], v)
            stack += [(inside, own[d <= r]), (outside, own[d > r - self.k])]
        return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def link_near(fp: np.ndarray, k: int) -> np.ndarray:
    """The least index of each fingerprint's component under links of at most ``k`` differing bits."""
    links = Links(len(fp))

    def roots(own: np.ndarray) -> np.ndarray:
        at = links.up[own]
        while not np.array_equal(up := links.up[at], at):
            at = up
        return at

    def compare(a: np.ndarray, b: np.ndarray) -> None:
        step = max(1, LEAF // len(b))
        for lo in range(0, len(a), step):
            x, y = np.nonzero(distances(fp[a[lo : lo + step]][:, None], fp[b]) <= k)
            for i, j in zip(a[lo + x].tolist(), b[y].tolist()):
                links.join(i, j)

    stack = [(np.arange(len(fp)), None)]  # a set with itself, or with another
    while stack:
        a, b = stack.pop()
        both = a if b is None else np.concatenate((a, b))
        if len(a) < 1 or b is not None and len(b) < 1 or len(both) < 2:
            continue
        joined = roots(both)
        if (joined == joined[0]).all():
            continue
        if len(a) * len(a if b is None else b) <= LEAF:
            compare(a, a if b is None else b)
            continue
        v = both[len(both) // 2]
        d = distances(fp[both], fp[v])
        for i in both[d <= k].tolist():
            links.join(int(v), i)
        r = radius(d, k)
        if r < 0:
            compare(a, a if b is None else b)
            continue
        da = d[: len(a)]
        if b is None:
            stack += [(a[(da > r - k) & (da <= r)], a[(da > r) & (da <= r + k)]), (a[da <= r], None), (a[da > r], None)]
        else:
            db = d[len(a) :]
            stack += [(a[(da > r - k) & (da <= r)], b[(db > r) & (db <= r + k)]), (a[(da > r) & (da <= r + k)], b[(db > r - k) & (db <= r)]), (a[da <= r], b[db <= r]), (a[da > r], b[db > r])]
    return links.roots()


def _linked(table):
    """Links of a shard as a forest, to the least index."""
    fp = np.unique(table["fp"].to_numpy().view(np.uint64))
    up = link_near(fp, int(table["k"][0].as_py()))
    moved = np.flatnonzero(up != np.arange(len(fp)))
    return pa.table({"a": fp[moved].view(np.int64), "b": fp[up[moved]].view(np.int64)})


def near_links(prints: DataFrame, k: int = 3) -> DataFrame:
    """Links (a, b) of ``prints`` (fp, different ones, written) that join whatever differs by ``k`` bits or fewer."""
    n = prints.count()
    shards = min(MOST_SHARDS, 1 << (max(n // SHARD, min(LEAST_SHARDS, n // SAMPLE // 2), 1) - 1).bit_length())
    sample = prints.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE * shards).collect()  # at most 2^18 numbers
    tree = prints.sparkSession.sparkContext.broadcast(VantageTree(np.array([r["fp"] for r in sample], np.int64).view(np.uint64), shards, k))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy()
            at, shard = tree.value.route(fp.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(fp[at]), pa.array(shard)], ["fp", "shard"])

    placed = prints.select("fp").mapInArrow(place, "fp long, shard long").withColumn("k", F.lit(k))
    return placed.groupBy("shard").applyInArrow(_linked, "a long, b long")


def simhash_components(docs: DataFrame, shingle_words: int = 3, bits: int = 3) -> DataFrame:
    """One row per row of ``docs`` (doc_id long, text string): doc_id, fp (the 64-bit fingerprint as a long), component_id.

    Two documents link if their fingerprints differ in ``bits`` bits or fewer; component_id is the least doc_id that links
    reach. A text without words (null, empty, blank) has fingerprint 0 and is linked like any other. Rows that repeat a
    doc_id are documents of their own with that id. A row without doc_id is linked, but its component is the least doc_id of
    the others; it is null if there is none. Other columns are not read.
    """
    own = scratch(fingerprints(docs, shingle_words), "fingerprints")
    prints = scratch(own.groupBy("fp").agg(F.min("doc_id").alias("cid")), "prints")
    labels = components(near_links(prints, bits)).withColumnRenamed("id", "fp")
    named = scratch(prints.join(labels, "fp", "left").withColumn("component", F.coalesce("component", "fp")), "named")
    least = scratch(named.groupBy("component").agg(F.min("cid").alias("component_id")), "least")
    named = scratch(named.select("fp", "component").join(least, "component").select("fp", "component_id"), "classes")
    return own.join(named, "fp").select("doc_id", "fp", "component_id")
