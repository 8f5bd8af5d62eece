"""Ranked lexical search: each item's best documents by integer BM25, found by presence masks.

Documents are read once and become short rows of the query terms that they hold. A block of items then meets every such
row: bitmap operations give each document the mask of the item's terms that it has, documents of one mask are a group, and
a group's score is at most the sum of its terms' greatest impacts. Groups are scored by descending bound until the bound is
below the tenth score so far, so the rest can't matter. A task keeps ten rows an item; those of all tasks are ranked once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gradeloom.llm.common import BITS_PER_BUCKET, filter_bits, positions_filter, scratch
from gradeloom.llm.textscan import chunks, raw, words

BLOCK_TERMS = 1 << 18  # terms of items in a block, which is collected and goes to every task: some MB
DOCS = 4096  # documents whose masks are made at once
ABSENT = np.iinfo(np.int64).max  # the place of a document without doc_id: after all others of its score


def _counted(batches: Iterator[pa.RecordBatch], may: np.ndarray | None, shift: int):
    """Of (key, text) batches: keys, all terms, and each row's different terms that may be wanted, with their numbers."""
    for batch in batches:
        data, off = raw(batch.column(1))
        for lo, hi in chunks(off):
            h, first, _, _ = words(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], loose=True, latin=False)
            row = np.repeat(np.arange(hi - lo), np.diff(first))
            if may is not None:
                at = h >> np.uint64(shift)
                kept = np.flatnonzero((may[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1)
                h, row = h[kept], row[kept]
            order = np.lexsort((h, row))
            h, row = h[order], row[order]
            new = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (row[1:] != row[:-1]))) if len(h) else np.zeros(0, bool))
            tf = np.diff(np.concatenate((new, [len(h)]))).astype(np.int32) if len(new) else np.zeros(0, np.int32)
            cut = np.searchsorted(row[new], np.arange(hi - lo + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(cut), pa.array(x)) for x in (h[new].view(np.int64), tf)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(np.diff(first)), *lists], ["key", "n", "terms", "tfs"])


def _terms(rows: DataFrame, may: np.ndarray | None = None, shift: int = 0) -> DataFrame:
    """(key, n, terms, tfs) of ``rows`` (key long, text): the number of all terms, and the wanted ones with their counts."""
    shared = rows.sparkSession.sparkContext.broadcast(may)
    return rows.mapInArrow(lambda batches: _counted(batches, shared.value, shift), "key long, n long, terms array<long>, tfs array<int>")


def _wanted(item_terms: DataFrame) -> tuple[np.ndarray, int]:
    """A bit filter of the items' terms, of at most 32 MB, and the shift that gives a hash its bit."""
    bits = filter_bits(item_terms.count())
    shift = 64 - (bits - 1).bit_length()
    out = np.zeros((bits // BITS_PER_BUCKET, BITS_PER_BUCKET // 8), np.uint8)
    for r in positions_filter(item_terms.select(F.shiftrightunsigned("term", shift).alias("at"))).collect():  # at most 8,192 rows of 4 KB
        out[r["bf_bucket"]] = np.frombuffer(r["bf_bits"], np.uint8)
    return out.reshape(-1), shift


class Best:
    """An item's ten best documents so far: scores and ids, best first."""

    def __init__(self, top: int):
        self.top, self.score, self.doc = top, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def least(self) -> int:
        """What a document must score at least to come in."""
        return int(self.score[-1]) if len(self.score) == self.top else 1

    def add(self, score: np.ndarray, doc: np.ndarray) -> None:
        score, doc = np.concatenate((self.score, score)), np.concatenate((self.doc, doc))
        order = np.lexsort((doc, -score))
        order = order[score[order] > 0][: self.top]
        self.score, self.doc = score[order], doc[order]


def presence_masks(postings: list[np.ndarray], docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents with any of the terms, their group, and each group's mask as a row of booleans.

    A mask has a bit for each term, in words of 64."""
    mask = np.zeros(((len(postings) + 63) // 64, docs), np.uint64)
    for i, rows in enumerate(postings):
        mask[i // 64, rows] |= np.uint64(1 << i % 64)
    held = np.flatnonzero(mask.any(axis=0))
    mask = mask[:, held]
    group = np.unique(mask[0], return_inverse=True)[1]
    for word in mask[1:]:
        _, own = np.unique(word, return_inverse=True)
        group = np.unique(group * (own.max(initial=0) + 1) + own, return_inverse=True)[1]
    _, one = np.unique(group, return_index=True)
    bit = np.arange(len(postings))
    return held, group, (mask[bit // 64][:, one].T >> (bit % 64).astype(np.uint64)) & np.uint64(1) > 0


def _search(postings: list[tuple[np.ndarray, np.ndarray]], weight: np.ndarray, ids: np.ndarray, best: Best) -> None:
    """Adds to ``best`` what a block of documents has for an item: ``postings`` are (rows, impacts) of its terms."""
    held, group, mask = presence_masks([rows for rows, _ in postings], len(ids))
    bound = mask @ (weight * np.array([impact.max() for _, impact in postings]))
    order = np.argsort(-bound, kind="stable")
    members = np.argsort(group, kind="stable")
    start = np.searchsorted(group[members], np.arange(len(bound) + 1))
    at, step = 0, 8
    while at < len(order) and bound[order[at]] >= best.least():
        part = order[at : at + step]
        part = part[bound[part] >= best.least()]
        docs = np.sort(np.concatenate([held[members[start[g] : start[g + 1]]] for g in part]))
        score = np.zeros(len(docs), np.int64)
        for (rows, impact), w in zip(postings, weight):
            k = np.minimum(np.searchsorted(rows, docs), len(rows) - 1)
            score += np.where(rows[k] == docs, w * impact[k], 0)
        best.add(score, ids[docs])
        at, step = at + step, step * 2


def _ranked(items: list[tuple[int, np.ndarray, np.ndarray]], n_docs: int, n_terms: int, top: int):
    """The best documents of a task for every item of a block: ``items`` are (item, terms, weights)."""
    vocabulary = np.unique(np.concatenate([t for _, t, _ in items]))
    owned = [(item, np.searchsorted(vocabulary, t), w) for item, t, w in items]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(top) for _ in owned]
        for whole in batches:
            for lo in range(0, whole.num_rows, DOCS):
                batch = whole.slice(lo, DOCS)
                ids, n, terms, tfs = (batch.column(i) for i in range(4))
                off = terms.offsets.to_numpy()
                flat, tf = (x.values.to_numpy()[off[0] : off[-1]] for x in (terms, tfs))
                k = np.minimum(np.searchsorted(vocabulary, flat), len(vocabulary) - 1)
                kept = np.flatnonzero(vocabulary[k] == flat)
                row, k, tf = np.repeat(np.arange(batch.num_rows), np.diff(off))[kept], k[kept], tf[kept].astype(np.int64)
                m = 25 + 75 * n.to_numpy() * n_docs // n_terms
                impact = 1_000_000_000 * tf // (1000 * tf + 8 * m[row])
                order = np.argsort(k, kind="stable")
                row, k, impact = row[order], k[order], impact[order]
                at = np.searchsorted(k, np.arange(len(vocabulary) + 1))
                doc = ids.fill_null(ABSENT).to_numpy()
                for own, (_, t, w) in zip(best, owned):
                    here = np.flatnonzero(at[t + 1] > at[t])
                    if len(here):
                        _search([(row[at[x] : at[x + 1]], impact[at[x] : at[x + 1]]) for x in t[here]], w[here], doc, own)
        item = np.repeat([x for x, _, _ in owned], [len(b.score) for b in best]).astype(np.int64)
        score, doc = (np.concatenate([getattr(b, name) for b in best]) for name in ("score", "doc"))
        yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(doc, mask=doc == ABSENT), pa.array(score)], ["item", "doc_id", "score"])

    return run


def search_lexical(docs: DataFrame, items: DataFrame, top: int = 10) -> DataFrame:
    """The ``top`` best documents of each item: item_id, rank (int, from 1), doc_id, score (long, above 0).

    ``docs`` has doc_id long and text, ``items`` item_id long and text; other columns are not read. Terms are runs of ASCII
    letters and digits and of all other non-ASCII characters, A-Z lower-cased. A term weighs floor(1000 ln((2N+2)/(2df+1))),
    its impact on a document of n terms is 10^9 tf div (1000 tf + 8 m), m = 25 + 75 n N div L. Equal scores are ranked by
    doc_id, a row without one last. Null, empty and blank texts have no term, so they neither count nor match. Each row of
    ``docs`` is a document, repeated ones too; items that repeat whole count once, items that share only their id are
    ranked each by itself. Terms are compared by 64-bit hashes.
    """
    spark = docs.sparkSession
    items = items.select(F.col("item_id").cast("long"), "text").distinct().withColumn("key", F.monotonically_increasing_id())
    items = scratch(items, "items")
    item_terms = scratch(_terms(items.select("key", "text")).select("key", F.explode(F.arrays_zip("terms", "tfs")).alias("x")).select("key", F.col("x.terms").alias("term"), F.col("x.tfs").alias("times")), "item-terms")
    own = scratch(_terms(docs.select(F.col("doc_id").cast("long").alias("key"), "text"), *_wanted(item_terms)), "doc-terms")
    n_docs, n_terms = own.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = own.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    # 1,000 times the logarithm, cut to an integer
    weight = F.floor(1000 * F.log(F.lit(2.0 * n_docs + 2) / (2 * F.col("df") + 1).cast("double"))) * F.col("times")
    weighed = item_terms.join(df, "term").select("key", "term", weight.alias("weight"))
    queries = scratch(weighed.groupBy("key").agg(F.collect_list(F.struct("term", "weight")).alias("terms")), "queries")
    blocks = 1 + int(queries.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()[0]) // BLOCK_TERMS
    found = []
    for i in range(blocks):  # the stated items against all documents, block by block: the driver holds one block at a time
        block = [(r["key"], np.array([x["term"] for x in r["terms"]]), np.array([x["weight"] for x in r["terms"]])) for r in queries.where(F.pmod(F.xxhash64("key"), F.lit(blocks)) == i).collect()]
        if block:
            shared = spark.sparkContext.broadcast(block)
            run = lambda batches, shared=shared: _ranked(shared.value, n_docs, n_terms, top)(batches)
            found.append(scratch(own.where("size(terms) > 0").mapInArrow(run, "item long, doc_id long, score long"), "found"))
            shared.unpersist()
    if not found:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    every = found[0]
    for more in found[1:]:
        every = every.union(more)
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    ranked = every.withColumn("rank", place).where(F.col("rank") <= top)
    return ranked.join(items.select(F.col("key").alias("item"), "item_id"), "item").select("item_id", "rank", "doc_id", "score")
