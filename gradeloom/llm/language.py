"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

Trained with follow-the-regularised-leader steps and elastic-net penalties: shards of a bounded labelled sample learn
side by side; executors average their states after each round, slice by slice, and the slices go on to the next round as a
table, so the driver never holds a state. It gets the weights that aren't zero at the end. A temperature, fitted on sample
rows that no shard learns from, calibrates the probabilities; executors sum its loss. Document frequencies come from every
training row.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeloom.llm.common import scratch
from gradeloom.llm.textscan import chunks, pieces, ragged, raw, vector_sum

BITS, ORDERS = 14, (1, 2, 3)
UNKNOWN = "und"
#: The bound of the labelled sample: about so many rows for each language.
PER_LANGUAGE = 1500
SLICES, SLICE = 64, 1 << BITS - 6  # in which a state goes from round to round, and the features of each
LEAST = 1e-5  # a class of less probability than that takes no step
MANY = 64  # languages from which a batch of rows is scored by one matrix product
SHARDS, ROUNDS = 8, 4
ROWS = 32
ALPHA, BETA, L1, L2 = 4.0, 0.5, 2e-3, 1e-3


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For every code point its lower-case letter, or a space."""
    table = np.full(0x110000, 32, np.uint32)
    for i in range(0x110000):
        if 0xD800 <= i < 0xE000:
            continue
        c = chr(i)
        if c.isalpha():
            table[i] = ord(c.lower()[0])
    return table


def ngram_counts(column: pa.Array):
    """Chunks of rows in order, each as (rows, row, at, count): how many rows, and for each hashed character n-gram of a
    row's whole text its number, sorted by row and n-gram. A row without letters has none."""
    data, offsets = raw(column)
    for lo, hi in chunks(offsets):
        b, off = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        code = _letters()[np.frombuffer(b.tobytes().decode().encode("utf-32-le"), np.uint32)]
        begin = np.concatenate(([0], np.cumsum((b & 0xC0) != 0x80)))[off]
        code = np.concatenate((code, np.full(2, 32, np.uint32)))
        keep = np.concatenate(([True], (code[1:] != 32) | (code[:-1] != 32)))  # runs of other characters are one space
        keep[begin[:-1]] = True  # whatever the row before ends with
        begin = np.concatenate(([0], np.cumsum(keep)))[begin]
        code = code[keep]
        if len(code) < 3:
            code = np.concatenate((code, np.full(3, 32, np.uint32)))
        hashed, h = [], np.zeros(len(code), np.uint32)
        for n in ORDERS:
            shifted = code[n - 1 :]
            h = h[: len(shifted)] * np.uint32(0x01000193) + shifted * np.uint32(0x9E3779B1) + np.uint32(n)
            x = h ^ (h >> np.uint32(15))
            hashed.append(((x * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BITS)).astype(np.int64))
        letters = np.concatenate(([0], np.cumsum(code != 32)))[begin]
        real = np.diff(letters) > 0
        size = np.diff(begin)
        for first in range(0, hi - lo, ROWS):  # so many dense rows of counts at once
            rows = np.arange(first, min(first + ROWS, hi - lo))
            cells = []
            for n, x in zip(ORDERS, hashed):
                width = np.where(real[rows], np.maximum(size[rows] - n + 1, 0), 0)
                row = np.repeat(rows - first, width)
                at = np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width) + np.repeat(begin[rows], width)
                cells.append(row << BITS | x[at])
            total = np.bincount(np.concatenate(cells), minlength=len(rows) << BITS)
            used = np.flatnonzero(total)
            yield len(rows), used >> BITS, used & ((1 << BITS) - 1), total[used]


def _weighted(n: int, row: np.ndarray, at: np.ndarray, count: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF weights, each row of unit length."""
    x = (1 + np.log(count)) * idf[at]
    return x / np.sqrt(np.maximum(np.bincount(row, x * x, minlength=n), 1e-300))[row]


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The leader: zero inside the L1 band, shrunk by L2 outside it."""
    return np.where(np.abs(z) <= L1, 0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def ftrl(z: np.ndarray, n: np.ndarray, rows: list[tuple[int, np.ndarray, np.ndarray]]) -> None:
    """One pass of follow-the-regularised-leader; z, n: classes x features, changed in place. A row moves the classes that
    its probabilities call for, few once they part."""
    w = weights(z, n)
    for label, at, x in rows:
        p = _softmax(w[:, at] @ x)
        p[label] -= 1
        moved = np.flatnonzero(np.abs(p) >= LEAST)
        cell = np.ix_(moved, at)
        g = p[moved, None] * x
        more = n[cell] + g * g
        new = z[cell] + g - (np.sqrt(more) - np.sqrt(n[cell])) / ALPHA * w[cell]
        z[cell], n[cell], w[cell] = new, more, weights(new, more)


@dataclass
class LanguageModel:
    labels: list[str]
    idf: np.ndarray
    w: np.ndarray
    temperature: float

    def column(self, text: str | Column = "text") -> Column:
        """struct<lang, score> for a text column, Arrow batch by batch."""
        labels, idf, w, t = self.labels, self.idf, self.w.astype(np.float32), self.temperature

        def predict(texts: pa.Array) -> pa.Array:
            lang, score = [], []
            for n, row, at, count in ngram_counts(texts):
                x = _weighted(n, row, at, count, idf)
                if labels:
                    p = _softmax(logits_of(w, n, row, at, x) / t)
                    best, top = p.argmax(axis=1), p.max(axis=1)
                known = np.bincount(row, minlength=n) > 0
                lang += [labels[best[i]] if labels and known[i] else UNKNOWN for i in range(n)]
                score += [float(top[i]) if labels and known[i] else 0.0 for i in range(n)]
            return pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["lang", "score"])

        return F.arrow_udf(predict, "lang string, score double")(text)


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a row is kept from training; a row without doc_id isn't held out, and isn't learnt from either."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def logits_of(w: np.ndarray, n: int, row: np.ndarray, at: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Scores of n rows, given as (row, feature, weight) cells, for all classes of w."""
    if len(w) < MANY:
        return np.stack([np.bincount(row, x * own[at], minlength=n) for own in w], 1)
    used, column = np.unique(at, return_inverse=True)
    dense = np.zeros((n, len(used)), w.dtype)
    dense[row, column] = x
    return (dense @ w[:, used].T).astype(np.float64)


def _packed(a: np.ndarray) -> bytes:
    return zlib.compress(np.ascontiguousarray(a).tobytes(), 1)


def _whole(state: pa.Table, c: int) -> tuple[np.ndarray, np.ndarray]:
    """z and n of a state's slices; zero where there are none yet."""
    z, n = np.zeros((c, 1 << BITS)), np.zeros((c, 1 << BITS))
    for i, own_z, own_n in zip(state["slice"].to_pylist(), state["z"].to_pylist(), state["n"].to_pylist()):
        part = slice(i * SLICE, (i + 1) * SLICE)
        z[:, part], n[:, part] = (np.frombuffer(zlib.decompress(x)).reshape(c, SLICE) for x in (own_z, own_n))
    return z, n


def _shard_round(turn: int, c: int):
    """What a shard does in a round: one pass over its rows from the common state, which it gives back in slices."""

    def step(table, state):
        if not table.num_rows:
            return pa.table({"slice": pa.array([], pa.int32()), "shard": pa.array([], pa.int32()), "z": pa.array([], pa.binary()), "n": pa.array([], pa.binary())})
        z, n = _whole(state, c)
        table = table.sort_by("rank")  # the same model however the rows arrive
        rows = list(zip(table["label"].to_pylist(), pieces(table["at"]), pieces(table["x"])))
        ftrl(z, n, [rows[i] for i in np.random.default_rng(turn).permutation(len(rows))])
        cut = [slice(i * SLICE, (i + 1) * SLICE) for i in range(SLICES)]
        return pa.table({"slice": pa.array(range(SLICES), pa.int32()), "shard": pa.array([table["shard"][0].as_py()] * SLICES, pa.int32()), "z": pa.array([_packed(z[:, x]) for x in cut], pa.binary()), "n": pa.array([_packed(n[:, x]) for x in cut], pa.binary())})

    return step


def _mean(table):
    """The mean of the shards' states of a slice."""
    table = table.sort_by("shard")
    z, n = (np.mean([np.frombuffer(zlib.decompress(x)) for x in table[c].to_pylist()], axis=0) for c in ("z", "n"))
    return pa.table({"slice": table["slice"].slice(0, 1), "z": pa.array([_packed(z)], pa.binary()), "n": pa.array([_packed(n)], pa.binary())})


def _sparse(c: int):
    """The weights of a state's slices that aren't zero."""

    def run(batches):
        for batch in batches:
            for i, z, n in zip(*(batch.column(x).to_pylist() for x in range(3))):
                w = weights(*(np.frombuffer(zlib.decompress(x)).reshape(c, SLICE) for x in (z, n)))
                label, at = np.nonzero(w)
                yield pa.RecordBatch.from_arrays([pa.array(label.astype(np.int32)), pa.array((at + i * SLICE).astype(np.int32)), pa.array(w[label, at])], ["label", "at", "w"])

    return run


def _log_loss(logits: np.ndarray, label: np.ndarray, rows: int, temperatures: np.ndarray) -> np.ndarray:
    """Summed log loss at each temperature. Targets are smoothed by 1 / (rows + 2), so that rows without a mistake don't ask
    for certainty."""
    c = logits.shape[1]
    target = np.full(logits.shape, 1 / (rows + 2) / max(1, c - 1))
    target[np.arange(len(label)), label] = 1 - 1 / (rows + 2)
    return np.array([-(target * np.log(np.maximum(_softmax(logits / t), 1e-12))).sum() for t in temperatures])


def _search(loss) -> float:
    """The temperature of least loss: a grid of its logarithm, then a finer one about the best."""
    lo, hi = np.log(0.05), np.log(20)
    for _ in range(2):
        grid = np.linspace(lo, hi, 41)
        best = int(np.argmin(loss(np.exp(grid))))
        lo, hi = grid[max(0, best - 1)], grid[min(40, best + 1)]
    return float(np.exp(grid[best]))


def fit_temperature(logits: np.ndarray, label: np.ndarray) -> float:
    """The temperature of least log loss; 1 without rows."""
    return _search(lambda t: _log_loss(logits, label, len(label), t)) if len(label) else 1.0


def _temperature(kept: DataFrame, w: np.ndarray) -> float:
    """The same for rows (label, at, x) that executors hold: only sums come to the driver."""
    rows = kept.count()
    if not rows:
        return 1.0
    shared = kept.sparkSession.sparkContext.broadcast(w)

    def loss(temperatures: np.ndarray) -> np.ndarray:
        def part(batches):
            total = np.zeros(len(temperatures))
            for whole in batches:
                for lo in range(0, whole.num_rows, ROWS):
                    batch = pa.Table.from_batches([whole.slice(lo, ROWS)])
                    at, x = pieces(batch["at"]), pieces(batch["x"])
                    row = np.repeat(np.arange(len(at)), [len(a) for a in at])
                    total += _log_loss(logits_of(shared.value, len(at), row, np.concatenate(at), np.concatenate(x)), batch["label"].to_numpy(), rows, temperatures)
            yield pa.RecordBatch.from_arrays([pa.array(range(len(temperatures)), pa.int32()), pa.array(total)], ["i", "loss"])

        sums = kept.select("label", "at", "x").mapInArrow(part, "i int, loss double").groupBy("i").agg(F.sum("loss").alias("loss"))
        return np.array([r["loss"] for r in sums.orderBy("i").collect()])

    return _search(loss)


def train_language(docs: DataFrame, per_language: int = PER_LANGUAGE) -> LanguageModel:
    """Learns from ``docs`` (doc_id, text, lang): rows that are not held out and have a text and a lang.

    The sample has about ``per_language`` rows of each lang, picked by a hash of doc_id; document frequencies are
    counted over all training rows. Every lang is learnt; a shard's task holds 400 KB for each. The model holds for any
    table; without rows it knows no language.
    """
    spark = docs.sparkSession
    known = docs.where(~held_out() & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    counted = known.groupBy("lang").agg(F.count("*").alias("n"))
    counts = {r["lang"]: r["n"] for r in counted.collect()}  # a row for each language
    rows, labels = sum(counts.values()), sorted(counts)
    if not labels:
        return LanguageModel([], np.ones(1 << BITS), np.zeros((0, 1 << BITS)), 1.0)

    def frequencies(batches):
        total = np.zeros(1 << BITS, np.int64)
        for batch in batches:
            for _, _, at, _ in ngram_counts(batch.column(0)):
                total += np.bincount(at, minlength=1 << BITS)
        return total

    df = vector_sum(known.select("text"), frequencies, 1 << BITS, lambda total: total, slices=8)
    idf = np.log((1 + rows) / (1 + df)) + 1

    number = spark.createDataFrame([(k, i, min(1.0, per_language / counts[k])) for i, k in enumerate(labels)], "lang string, label int, share double")
    drawn = known.join(F.broadcast(number), "lang").where(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30)) < F.col("share") * float(1 << 30))  # a row for each language
    deal = F.pmod(F.xxhash64("doc_id", F.lit("deal")), F.lit(5 * SHARDS)).cast("int")
    schema = "label int, shard int, rank long, at array<int>, x array<float>"

    def features(batches):
        for batch in batches:
            got, base = [], 0
            for n, row, at, count in ngram_counts(batch.column(3)):
                x, ends = _weighted(n, row, at, count, idf), np.searchsorted(row, np.arange(n + 1))
                got += [(base + i, at[s:e], x[s:e]) for i, (s, e) in enumerate(zip(ends[:-1], ends[1:])) if e > s]
                base += n
            rows = pa.array([i for i, _, _ in got], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(rows) for c in range(3)), ragged([at.astype(np.int32) for _, at, _ in got]), ragged([x.astype(np.float32) for _, _, x in got])], ["label", "shard", "rank", "at", "x"])

    sample = scratch(drawn.select("label", deal.alias("shard"), F.xxhash64("doc_id", "text").alias("rank"), "text").mapInArrow(features, schema), "lid-sample")
    c = len(labels)
    learn = sample.where(f"shard < {4 * SHARDS}").withColumn("shard", F.col("shard") % SHARDS)
    kind = "slice int, shard int, z binary, n binary"
    state = spark.createDataFrame([], kind).drop("shard")
    for turn in range(ROUNDS):
        every = state.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(SHARDS - 1))))
        states = learn.groupBy("shard").cogroup(every.groupBy("shard")).applyInArrow(_shard_round(turn, c), kind)
        state = scratch(states.groupBy("slice").applyInArrow(_mean, "slice int, z binary, n binary"), "lid-state")
    cells = state.mapInArrow(_sparse(c), "label int, at int, w double").toArrow()  # weights that aren't zero
    w = np.zeros((c, 1 << BITS))
    w[cells["label"].to_numpy(), cells["at"].to_numpy()] = cells["w"].to_numpy()
    return LanguageModel(labels, idf, w, _temperature(sample.where(f"shard >= {4 * SHARDS}"), w))


def identify_language(docs: DataFrame, model: LanguageModel | None = None) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, and lang to train): doc_id, held_out, lang_pred, score.

    A null text, or one without letters, is ``und`` with score 0, as is every row if there is nothing to learn from;
    any other text gets a learnt lang and its calibrated probability. Other columns are not read.
    """
    model = model or train_language(docs)
    out = docs.select("doc_id", held_out().alias("held_out"), model.column().alias("p"))
    return out.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))
