"""Quality classifier: ordinal cumulative-link regression on graded ratings.

P(grade <= k) = logistic(threshold_k - w.x): one weight vector over hashed words and text shapes for all grades, and
ordered thresholds. Learnt by AdaGrad on shards of a bounded labelled sample, averaged after each round.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeloom.llm.common import scratch
from gradeloom.llm.textscan import chunks, mix, pieces, ragged, raw, words

BITS = 20
GRADES = 3  # 0 toxic, 1 poor, 2 good
#: The bound of the labelled sample, picked by a hash of doc_id.
SAMPLE = 20_000
#: A hashed feature is learnt if at least so many, and such a share, of the sample's rows have it.
ROWS, SHARE = 5, 0.002
SHARDS, ROUNDS, RATE, L1, WORD, SHAPE = 8, 12, 1.0, 2e-2, 0.5, 0.5


def _shape(b: np.ndarray, h: np.ndarray) -> list[int]:
    """Buckets of what a text looks like: shares of capitals, signs, digits and repeated words, and length."""
    n = max(1, len(b))
    capital = int(((b >= 65) & (b <= 90)).sum() * 20 // n)
    sign = int((((b >= 33) & (b <= 47)) | ((b >= 58) & (b <= 64)) | ((b >= 91) & (b <= 96)) | ((b >= 123) & (b <= 126))).sum() * 40 // n)
    digit = int(((b >= 48) & (b <= 57)).sum() * 20 // n)
    repeat = int(20 - 20 * len(np.unique(h)) // max(1, len(h)))
    return [0 << 8 | capital, 1 << 8 | sign, 2 << 8 | digit, 3 << 8 | repeat, 4 << 8 | int(np.log2(len(h) + 1)), 5 << 8 | int(len(b) / max(1, len(h)))]


def features(column: pa.Array):
    """For every row: hashed features of the whole text and their values; words by presence, shapes one by one."""
    data, offsets = raw(column)
    for lo, hi in chunks(offsets):
        b, off = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        h, first, _, _ = words(b, off, loose=True)
        at = (h >> np.uint64(64 - BITS)).astype(np.int64)
        for r, (s, e) in enumerate(zip(first[:-1], first[1:])):
            shape = mix(np.array(_shape(b[off[r] : off[r + 1]], at[s:e]), np.uint64) + np.uint64(0x5BF03635)) >> np.uint64(64 - BITS)
            word = np.unique(at[s:e])
            x = np.concatenate((np.full(len(word), WORD), np.full(len(shape), SHAPE)))
            yield np.concatenate((word, shape.astype(np.int64))), x


def _tail(score, threshold):
    """P(grade > k) for each k."""
    return 1 / (1 + np.exp(np.clip(threshold - score, -40, 40)))


def ordinal_pass(w, g2, cut, cut_g2, rows) -> None:
    """One AdaGrad pass over (grade, at, x); cut: first threshold and logarithms of the gaps above it."""
    for grade, at, x in rows:
        gap = np.exp(cut[1:])
        threshold = cut[0] + np.concatenate(([0], np.cumsum(gap)))
        above = np.concatenate(([1.0], _tail(w[at] @ x, threshold), [0.0]))
        p = max(above[grade] - above[grade + 1], 1e-9)
        slope = above * (1 - above)  # of P(grade > k) by score
        d_score = (slope[grade] - slope[grade + 1]) / p
        d_threshold = np.zeros(len(threshold))
        if grade < len(threshold):
            d_threshold[grade] += slope[grade + 1] / p
        if grade:
            d_threshold[grade - 1] -= slope[grade] / p
        g = -d_score * x
        g2[at] += g * g
        rate = RATE / np.sqrt(g2[at])
        step = w[at] - rate * g
        w[at] = np.sign(step) * np.maximum(np.abs(step) - rate * L1, 0)
        d_cut = -np.concatenate(([d_threshold.sum()], [d_threshold[k + 1 :].sum() * gap[k] for k in range(len(gap))]))
        cut_g2 += d_cut * d_cut
        cut -= 0.1 * d_cut / (np.sqrt(cut_g2) + 1e-6)


@dataclass
class QualityModel:
    known: np.ndarray  # hashed features in order, one weight each
    w: np.ndarray
    threshold: np.ndarray

    def column(self, text: str | Column = "text") -> Column:
        """array<double> of P(grade >= 1), P(grade >= 2), ..."""
        known, w, threshold = self.known, self.w, self.threshold

        def predict(texts: pa.Array) -> pa.Array:
            tails = [_tail(float(w[at] @ x), threshold) for at, x in (_known(known, *f) for f in features(texts))]
            return ragged(tails) if tails else pa.array([], pa.list_(pa.float64()))

        return F.arrow_udf(predict, "array<double>")(text)


def _known(known: np.ndarray, at: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    i = np.searchsorted(known, at)
    own = np.flatnonzero((i < len(known)) & (known[np.minimum(i, len(known) - 1)] == at)) if len(known) else np.zeros(0, np.int64)
    return i[own], x[own]


def graded(labels: DataFrame) -> DataFrame:
    """(doc_id, grade): 0 toxic, 1 of low quality, 2 good; unrated rows and rows without doc_id are left out, and of
    several ratings the least counts."""
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2)
    return labels.select("doc_id", grade.alias("grade")).where("doc_id is not null and grade is not null").groupBy("doc_id").agg(F.min("grade").alias("grade"))


def _shard_round(state, turn: int):
    """What a shard does in a round: one pass over its rows from the common state."""

    def step(key, table):
        known, *own = state.value
        table = table.sort_by("rank")  # the same model however the rows arrive
        own = [a.copy() for a in own]
        rows = [(k, *_known(known, a, x)) for k, a, x in zip(table["grade"].to_pylist(), pieces(table["at"]), pieces(table["x"]))]
        ordinal_pass(*own, [rows[i] for i in np.random.default_rng(turn).permutation(len(rows))])
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "state": pa.array([np.concatenate(own).tobytes()], pa.binary())})

    return step


def train_quality(docs: DataFrame, ratings: DataFrame, sample: int = SAMPLE, grades: int = GRADES) -> QualityModel:
    """Learns from ``docs`` (doc_id, text) with ``ratings`` (doc_id, grade), of which at most ``sample`` are used, those
    of least hash. Without ratings every document counts as of the top grade."""
    spark = docs.sparkSession
    drawn = ratings.withColumn("deal", F.xxhash64("doc_id", F.lit("rating"))).orderBy("deal", "doc_id").limit(sample)

    def extract(batches):
        for batch in batches:
            got = list(features(batch.column(3)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in range(3)), ragged([a.astype(np.int32) for a, _ in got]), ragged([x.astype(np.float32) for _, x in got])], ["grade", "shard", "rank", "at", "x"])

    rows = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id")  # at most ``sample`` small rows
    rows = rows.select(F.col("grade").cast("int").alias("grade"), F.pmod("deal", F.lit(SHARDS)).cast("int").alias("shard"), F.col("deal").alias("rank"), "text")
    held = scratch(rows.mapInArrow(extract, "grade int, shard int, rank long, at array<int>, x array<float>"), "rated")
    least = max(ROWS, SHARE * held.count())
    common = held.select(F.explode("at").alias("at")).groupBy("at").count().where(F.col("count") >= least)
    known = np.sort(np.array([r["at"] for r in common.collect()], np.int64))  # at most (features of a row) / SHARE
    k = len(known)
    w, cut = np.zeros(k), np.concatenate(([-2.0], np.zeros(grades - 2)))
    g2, cut_g2 = np.full(k, 1.0), np.full(grades - 1, 1e-2)
    for turn in range(ROUNDS):
        step = _shard_round(spark.sparkContext.broadcast((known, w, g2, cut, cut_g2)), turn)
        states = [np.frombuffer(r["state"]) for r in held.groupBy("shard").applyInArrow(step, "shard int, state binary").orderBy("shard").collect()]  # SHARDS of fixed size
        if not states:
            return QualityModel(known, w, np.full(grades - 1, -40.0))
        m = np.mean(states, axis=0)
        w, g2, cut, cut_g2 = m[:k], m[k : 2 * k], m[2 * k : 2 * k + grades - 1], m[2 * k + grades - 1 :]
    return QualityModel(known, w, cut[0] + np.concatenate(([0], np.cumsum(np.exp(cut[1:])))))


def score_quality(docs: DataFrame, model: QualityModel, least: int = 2, chance: float = 0.5) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, expected_grade, tail_prob, kept.

    tail_prob is P(grade >= ``least``); kept says that it is at least ``chance``. A null or empty text is scored by its
    shape alone; rows that repeat are scored alike. Other columns are not read.
    """
    p = docs.select("doc_id", model.column().alias("tails"))
    total = F.aggregate("tails", F.lit(0.0), lambda a, x: a + x)
    tail = F.element_at("tails", least)
    return p.select("doc_id", total.alias("expected_grade"), tail.alias("tail_prob"), (tail >= chance).alias("kept"))
