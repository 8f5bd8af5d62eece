"""Periodic runs of words, found by internal pattern matching.

Texts are sequences of word numbers. Prefix doubling names every block of 2^k words by where its interval of the suffix
array begins, and a wavelet tree over that array answers which position of an interval follows or precedes another. A run
of period q and of at least 4 q words holds an aligned block of b words, b the power of two with q < b <= 2 q, and an
occurrence of that block q words before or after it; occurrences in the windows beside a block form a progression, so the
nearest ones give the candidate period. The names of all levels extend a candidate to both sides as far as its period holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeloom.llm.textscan import chunks, raw

TIMES, LEAST = 4, 6  # a run has at least so many periods, and so many words
RUNS = "array<struct<start:long,length:long,period:long>>"


def block_names(s: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """For each k the start of the suffix array's interval of the block of 2^k numbers at each place, until all are
    different; and the suffix array. A block that goes beyond the end is different from all others."""
    n = len(s)
    count = np.bincount(s)
    name = (np.cumsum(count) - count)[s].astype(np.int32)
    names, open_, step = [name], np.flatnonzero(count[s] > 1), 1
    while len(open_):
        after = np.where(open_ + step < n, name[np.minimum(open_ + step, n - 1)], -1).astype(np.int64)
        key = name[open_].astype(np.int64) * (n + 1) + after + 1
        order = np.argsort(key, kind="stable")
        open_, key = open_[order], key[order]
        old, at = name[open_], np.arange(len(open_))
        first = np.concatenate(([True], old[1:] != old[:-1]))
        new = np.concatenate(([True], key[1:] != key[:-1]))
        place = old + at - at[first][np.cumsum(first) - 1]
        name = name.copy()
        name[open_] = place[new][np.cumsum(new) - 1]
        names.append(name)
        open_, step = open_[~(new & np.concatenate((new[1:], [True])))], 2 * step
    suffixes = np.empty(n, np.int32)
    suffixes[name] = np.arange(n, dtype=np.int32)
    return names, suffixes


class WaveletTree:
    """The bits of ``values`` from the highest on, each level ordered by the bits above, as numbers of ones before."""

    def __init__(self, values: np.ndarray):
        self.bits = max(1, int(values.max(initial=0)).bit_length())
        self.ones, self.zeros = [], []
        for b in reversed(range(self.bits)):
            bit = (values >> b) & 1 > 0
            ones = np.zeros(len(values) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones), self.zeros.append(len(values) - int(ones[-1]))
            values = np.concatenate((values[~bit], values[bit]))

    def below(self, lo: np.ndarray, hi: np.ndarray, x: np.ndarray) -> np.ndarray:
        """How many values in places lo to hi (exclusive) are smaller than x."""
        total = np.zeros(len(x), np.int64)
        for level, (ones, zeros) in enumerate(zip(self.ones, self.zeros)):
            bit = (x >> (self.bits - 1 - level)) & 1 > 0
            a, b = ones[lo], ones[hi]
            total += np.where(bit, (hi - b) - (lo - a), 0)
            lo, hi = np.where(bit, zeros + a, lo - a), np.where(bit, zeros + b, hi - b)
        return total

    def kth(self, lo: np.ndarray, hi: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The k-th smallest value, from 0, in places lo to hi."""
        value = np.zeros(len(k), np.int64)
        for ones, zeros in zip(self.ones, self.zeros):
            a, b = ones[lo], ones[hi]
            small = (hi - b) - (lo - a)
            up = k >= small
            value = 2 * value + up
            k = np.where(up, k - small, k)
            lo, hi = np.where(up, zeros + a, lo - a), np.where(up, zeros + b, hi - b)
        return value


def _common(names: list[np.ndarray], i: np.ndarray, j: np.ndarray, ahead: bool) -> np.ndarray:
    """How far the sequence goes on alike from i and j (i < j) on, or back from before them."""
    n, total = len(names[0]), np.zeros(len(i), np.int64)
    for k in reversed(range(len(names))):
        step = 1 << k
        x, y = (i, j) if ahead else (i - step, j - step)
        same = (x >= 0) & (y < n)
        same &= names[k][np.where(same, x, 0)] == names[k][np.where(same, y, 0)]
        move = np.where(same, step, 0)
        total += move
        i, j = (i + move, j + move) if ahead else (i - move, j - move)
    return total


def periodic_runs(s: np.ndarray, first: np.ndarray) -> np.ndarray:
    """All runs as rows (start, length, period), by start, then period, of sequences laid end to end.

    Sequences begin at ``first`` (one more at the end) and share no number."""
    names, suffixes = block_names(s)
    tree, found = None, []
    for k in range(1, len(names)):
        b, name = 1 << k, names[k]
        at = np.concatenate([np.arange(x, y - b + 1, b) for x, y in zip(first[:-1], first[1:])] or [np.zeros(0, np.int64)])
        size = np.bincount(name, minlength=len(s))[name[at]]
        at, size = at[size > 1], size[size > 1]
        if not len(at):
            continue
        tree = tree or WaveletTree(suffixes)
        lo = name[at].astype(np.int64)
        before = tree.below(lo, lo + size, at)
        for beside, there in ((before + 1, before + 1 < size), (before - 1, before > 0)):
            x, other = at[there], tree.kth(lo[there], (lo + size)[there], beside[there])
            d = np.abs(other - x)
            near = (2 * d >= b) & (d < b)
            found.append(np.stack((np.minimum(x, other)[near], d[near])))
    if not found:
        return np.zeros((0, 3), np.int64)
    at, d = np.unique(np.concatenate(found, axis=1), axis=1)
    back = _common(names, at, at + d, ahead=False)
    rows = np.stack((at - back, back + d + _common(names, at, at + d, ahead=True), d), axis=1)
    rows = np.unique(rows, axis=0)
    rows = rows[(rows[:, 1] >= LEAST) & (rows[:, 1] >= TIMES * rows[:, 2])]
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def _found(texts: list[bytes]) -> tuple[list[list[bytes]], list[list[dict]], list[bytes]]:
    """Words, runs and collapsed text of each text."""
    split, numbers, used = [t.split() for t in texts], [], 0
    for own in split:
        index: dict[bytes, int] = {}
        numbers += [used + index.setdefault(w, len(index)) for w in own]
        used += len(index)
    at = np.cumsum([0, *map(len, split)])
    runs: list[list[dict]] = [[] for _ in texts]
    if not numbers:
        return split, runs, [b""] * len(texts)
    s = np.array(numbers)
    rows = periodic_runs(s, at)
    row = np.searchsorted(at, rows[:, 0], "right") - 1
    edge = np.zeros(len(s) + 1, np.int64)
    np.add.at(edge, rows[:, 0] + rows[:, 2], 1), np.add.at(edge, rows[:, 0] + rows[:, 1], -1)
    kept = np.cumsum(edge)[:-1] == 0
    for r, (start, length, period) in zip(row.tolist(), (rows - np.stack((at[row], 0 * row, 0 * row), axis=1)).tolist()):
        runs[r].append({"start": start, "length": length, "period": period})
    out = []
    for r, own in enumerate(split):
        if runs[r]:
            own = [w for w, stays in zip(own, kept[at[r] : at[r + 1]].tolist()) if stays]
        out.append(b" ".join(own))
    return split, runs, out


def find_runs(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id long, text string): doc_id, n_words, runs, collapsed.

    Words are `[^\\x20\\x09-\\x0D]+`, numbered from 0. A run is a stretch of words of smallest period q, at least 6 words and
    4 q words long, that no neighbour extends; ``runs`` has them as (start, length, period) by start, then period.
    ``collapsed`` is the text without the words that a run repeats after its first period, joined by single spaces. A
    null, empty or blank text has no words, no runs and an empty collapsed text. Rows that repeat, or have no doc_id, are
    rows like others. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for batch in batches:
            _, off = raw(batch.column(1))
            for lo, hi in chunks(off):
                part = batch.slice(lo, hi - lo)
                texts = [x or b"" for x in part.column(1).cast(pa.binary()).to_pylist()]
                split, runs, collapsed = _found(texts)
                words = pa.array([len(x) for x in split], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), words, pa.array(runs, kind), pa.array(collapsed, pa.binary()).view(pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, f"doc_id long, n_words long, runs {RUNS}, collapsed string")
