"""Vectorised scans of Arrow text columns: word hashes and word n-gram hashes of whole texts, chunk by chunk."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

CHUNK = 1 << 18  # bytes worked on at once, at some 100 bytes of memory each; a longer text is a chunk of its own
_BASE = 0x9E3779B97F4A7C15
_MULT = np.array([_BASE, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _BASE, np.uint64), np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_NOT_WORD = np.array([not (chr(i).isalnum() or i >= 128) for i in range(256)])


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string column; null rows are empty."""
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        kind = np.int32
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    n = len(column)
    off = np.frombuffer(offsets, kind, n + 1 + column.offset)[column.offset :].astype(np.int64) if n else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), off


def chunks(off: np.ndarray) -> Iterator[tuple[int, int]]:
    """Row ranges of about CHUNK bytes."""
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + CHUNK, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def words(b: np.ndarray, off: np.ndarray, loose: bool = False, latin: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, first word of each row (rows + 1), and byte ranges of the words.

    b: bytes of some rows, off: their offsets from 0. Words are runs without [\\x20\\x09-\\x0D], A-Z lower-cased;
    loose: runs of ASCII letters and digits and other characters, with ``latin`` Latin-1 capitals lower-cased as well.
    """
    n = len(b)
    low = _LOWER[b]
    if loose and latin and n > 1:
        cap = np.flatnonzero((b[:-1] == 0xC3) & (b[1:] >= 0x80) & (b[1:] <= 0x9E)) + 1
        low[cap] += 0x20
    inside = ~(_NOT_WORD if loose else _SPACE)[b]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    edge = off[1:-1][(off[1:-1] > 0) & (off[1:-1] < n)]
    begins[edge] |= inside[edge]
    ends[edge - 1] |= inside[edge - 1]
    st, en = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    up, down = _powers(max(CHUNK, 1 << int(n).bit_length()))
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((low.astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
    h = mix((total[en] - total[st]) * down[st] + (en - st).astype(np.uint64))
    return h, np.searchsorted(st, off).astype(np.int64), st, en


def grams(h: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-word windows inside rows, and the word at which each begins."""
    k = len(h) - n + 1
    if k <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    g = h[:k] * _MULT[0]
    for i in range(1, n):
        g += h[i : k + i] * _MULT[i % len(_MULT)]
    last = np.repeat(first[1:], np.diff(first))[:k]
    at = np.flatnonzero(np.arange(k) + n <= last)
    return mix(g[at]), at


def shingles(b: np.ndarray, off: np.ndarray, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """n-word shingle hashes (repeats included) and each row's range in them; fewer words: the sequence as one."""
    h, first, _, _ = words(b, off)
    g, at = grams(h, first, n)
    count = np.diff(first)
    short = np.flatnonzero((count > 0) & (count < n))
    if not len(short):
        return g, np.searchsorted(at, first)
    extra = np.array(
        [sum(int(x) * int(m) for x, m in zip(h[first[r] : first[r + 1]], _MULT)) + int(count[r]) & ((1 << 64) - 1) for r in short],
        np.uint64,
    )
    at = np.concatenate((at, first[short]))
    order = np.argsort(at, kind="stable")
    return np.concatenate((g, mix(extra)))[order], np.searchsorted(at[order], first)


def vector_sum(df: DataFrame, count: Callable[[Iterator[pa.RecordBatch]], np.ndarray], width: int, finish: Callable[[np.ndarray], np.ndarray], slices: int = 64) -> np.ndarray:
    """The sum over all partitions of a vector of fixed width: partitions count, slices are added up on executors, and
    only the finished vector comes to the driver."""
    part, kind = width // slices, finish(np.zeros(1, np.int64)).dtype

    def partial(batches):
        total = count(batches).reshape(slices, part)
        used = np.flatnonzero(total.any(axis=1))
        small = np.uint16 if total.max(initial=0) < 65536 else np.int64
        yield pa.RecordBatch.from_arrays(
            [pa.array(used.astype(np.int32)), pa.array([np.dtype(small).itemsize] * len(used), pa.int32()), pa.array([zlib.compress(total[s].astype(small).tobytes(), 1) for s in used], pa.binary())],
            ["slice", "bytes", "part"],
        )

    def add(key, table):
        total = np.zeros(part, np.int64)
        for n, x in zip(table["bytes"].to_pylist(), table["part"].to_pylist()):
            total += np.frombuffer(zlib.decompress(x), np.uint16 if n == 2 else np.int64)
        return pa.table({"slice": pa.array([key[0].as_py()], pa.int32()), "part": pa.array([finish(total).tobytes()], pa.binary())})

    out = np.tile(finish(np.zeros(part, np.int64)), (slices, 1))
    for r in df.mapInArrow(partial, "slice int, bytes int, part binary").groupBy("slice").applyInArrow(add, "slice int, part binary").collect():
        out[r["slice"]] = np.frombuffer(r["part"], kind)
    return out.reshape(-1)


def ragged(rows: list[np.ndarray]) -> pa.ListArray:
    """A list column of numpy rows."""
    ends = np.concatenate(([0], np.cumsum([len(x) for x in rows]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int32)))


def pieces(column: pa.ChunkedArray) -> list[np.ndarray]:
    """The numpy rows of a list column."""
    out = []
    for c in column.chunks:
        flat, off = c.values.to_numpy(zero_copy_only=False), c.offsets.to_numpy()
        out += [flat[lo:hi] for lo, hi in zip(off[:-1], off[1:])]
    return out
