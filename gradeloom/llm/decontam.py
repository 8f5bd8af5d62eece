"""Benchmark decontamination: rare n-gram seeds join training passages to test items, Smith-Waterman scores them.

An item's seeds are its 3-word n-grams; an item of fewer than 20 words has its pairs of words instead, adjacent ones and
such with one word between. Documents' n-grams that may be seeds are a table, and so are seeds and items: joins bring them
together, so a benchmark may have any size. In every stretch of an item the seed that corpus and benchmark use least is
rare: one hit of it is enough. The frequent ones take a second route: two of them must hit in line, as far apart in the text
as in the item, give or take what edits shift. The window around hits is aligned with the item, so copies with words
replaced, added or left out score as well; windows with too few of the item's words for the score that counts are left out
before, which loses nothing. Items of fewer than four words are found by their whole word sequence. Equal texts are one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gradeloom.llm.common import BITS_PER_BUCKET, filter_bits, maybe_in, positions_filter, scratch
from gradeloom.llm.textscan import chunks, grams, mix, ragged, raw, words

MATCH, MISMATCH, GAP = 2, -1, -1
#: Contaminated: an alignment of so large a share of the best score of the item's words, or of so many words of score.
SHARE, WORDS = 0.4, 25
SHORTEST, PAIRS = 4, 20  # words from which an item is aligned, and from which its seeds have three words
STRETCH = 4  # places of an item of which the rarest seed is rare
CANDIDATES = 256  # windows of a text that are aligned in one row, about
KINDS = ("whole1", "whole2", "whole3", "adjacent", "apart", "triple")


def gram_kind(h: np.ndarray, first: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a kind's n-grams inside rows, different for each kind, and the word at which each begins."""
    salt = np.uint64(KINDS.index(kind) * 0x9E3779B97F4A7C15 & ((1 << 64) - 1))
    if kind == "apart":
        g, at = grams(h, first, 3)
        g = mix(h[at] * np.uint64(0xC2B2AE3D27D4EB4F) + h[at + 2] * np.uint64(0x165667B19E3779F9)) if len(at) else g
    else:
        g, at = grams(h, first, {"adjacent": 2, "triple": 3}.get(kind) or int(kind[-1]))
    return mix(g ^ salt) if len(g) else g, at


def item_kinds(n: int) -> tuple[str, ...]:
    """The kinds of seeds of an item of so many words."""
    if n < SHORTEST:
        return (f"whole{n}",) if n else ()
    return ("triple",) if n >= PAIRS else ("adjacent", "apart")


def needed(n, share: float = SHARE, least: int = WORDS):
    """The score that counts for an item of so many words."""
    return np.minimum(share * MATCH * n, MATCH * least)


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word hashes and seeds of (key, text) rows."""
    for batch in batches:
        data, off = raw(batch.column(1))
        h, first, _, _ = words(data[off[0] : off[-1]], off - off[0], loose=True)
        own = [h[a:b] for a, b in zip(first[:-1], first[1:])]
        seeds, places = [], []
        for w in own:
            found = [gram_kind(w, np.array([0, len(w)]), k) for k in item_kinds(len(w))]
            seeds.append(np.concatenate([np.zeros(0, np.uint64), *(g for g, _ in found)]).view(np.int64))
            places.append(np.concatenate([np.zeros(0, np.int64), *(at for _, at in found)]))
        yield pa.RecordBatch.from_arrays([batch.column(0), ragged([w.view(np.int64) for w in own]), ragged(seeds), ragged(places)], ["key", "words", "seeds", "places"])


def _hits(docs: DataFrame, seeds: DataFrame, kinds: list[str]) -> DataFrame:
    """(text_key, seed, at) for the n-grams of ``docs`` (text_key, text) that are seeds, and few that aren't."""
    bits = filter_bits(seeds.count())
    shift = np.uint64(64 - (bits - 1).bit_length())
    may = np.zeros((bits // BITS_PER_BUCKET, BITS_PER_BUCKET // 8), np.uint8)
    for r in positions_filter(seeds.select(F.shiftrightunsigned("seed", int(shift)).alias("at"))).collect():  # at most 8,192 rows of 4 KB
        may[r["bf_bucket"]] = np.frombuffer(r["bf_bits"], np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(may.reshape(-1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = shared.value
        for batch in batches:
            data, off = raw(batch.column(1))
            for lo, hi in chunks(off):
                h, first, _, _ = words(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], loose=True)
                for kind in kinds:
                    g, at = gram_kind(h, first, kind)
                    bit = g >> shift
                    kept = np.flatnonzero((have[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1)
                    row = np.searchsorted(first, at[kept], "right") - 1
                    key = batch.column(0).slice(lo, hi - lo).take(pa.array(row))
                    yield pa.RecordBatch.from_arrays([key, pa.array(g[kept].view(np.int64)), pa.array(at[kept] - first[row])], ["text_key", "seed", "at"])

    return docs.mapInArrow(run, "text_key binary, seed long, at long")


def _ranked(seeds: DataFrame, hits: DataFrame) -> DataFrame:
    """Seeds with whether they are rare: of a stretch of their item the one that corpus and benchmark have least."""
    used = hits.groupBy("seed").agg(F.count("*").alias("corpus"))
    shared = seeds.groupBy("seed").agg(F.count("*").alias("items"))
    counted = seeds.join(shared, "seed").join(used, "seed", "left")
    order = Window.partitionBy("key", F.expr(f"place div {STRETCH}")).orderBy(F.coalesce("corpus", F.lit(0)) + F.col("items"), "place", "seed")
    return counted.where("corpus > 0").select("key", "n", "seed", "place", (F.row_number().over(order) == 1).alias("rare"))


def _windows(hits: DataFrame, seeds: DataFrame) -> DataFrame:
    """(text_key, key, lo, hi): word ranges around hits in line, one rare one or two at different places of the item. A hit's
    start is where its item would begin; two grids of cells, as long as a short item or half a long one, hold starts that
    lie together."""
    start = F.col("at") - F.col("place")
    width = F.when(F.col("n") < PAIRS, F.col("n")).otherwise(F.floor(F.col("n") / 2))
    cell = lambda shift: F.floor((F.col("start") + shift) / width)
    grids = F.explode(F.array(F.struct(F.lit(0).alias("grid"), cell(F.lit(0)).alias("i")), F.struct(F.lit(1).alias("grid"), cell(F.floor(width / 2)).alias("i")))).alias("cell")
    rows = hits.join(seeds, "seed").withColumn("start", start)
    whole = rows.where(F.col("n") < SHORTEST).select("text_key", "key", F.col("start").alias("lo"), (F.col("start") + F.col("n")).alias("hi"))
    found = rows.where(F.col("n") >= SHORTEST).select("text_key", "key", "n", "start", "place", "rare", grids)
    found = found.groupBy("text_key", "key", "n", "cell").agg(F.min("place").alias("low"), F.max("place").alias("high"), F.max("rare").alias("rare"), F.min("start").alias("first"), F.max("start").alias("last")).where("low < high OR rare")
    slack = F.floor(F.col("n") / 3) + SHORTEST
    return found.select("text_key", "key", F.greatest(F.lit(0), F.col("first") - slack).alias("lo"), (F.col("last") + F.col("n") + slack).alias("hi")).union(whole).distinct()


def enough(item_words: list[np.ndarray], window: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Whether the words of each item that occur in a window could make its score if all of them matched in order."""
    size = np.array([len(w) for w in item_words])
    there = np.isin(np.concatenate(item_words), window)
    return MATCH * np.add.reduceat(there.astype(np.int64), np.cumsum(size) - size) >= least


def align(pairs: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[int, int, int]]:
    """Smith-Waterman with linear gaps for many (item, window) pairs at once: best score, and the window's range.

    A row of the table is worked out for all pairs together; gaps along a row are a running maximum."""
    if not pairs:
        return []
    rows, width = max(len(a) for a, _ in pairs), max(len(b) for _, b in pairs)
    a = np.zeros((len(pairs), rows), np.uint64)
    b = np.ones((len(pairs), width), np.uint64)
    real = np.zeros((len(pairs), rows), bool)
    for i, (x, y) in enumerate(pairs):
        a[i, : len(x)], b[i, : len(y)], real[i, : len(x)] = x, y, True
    ramp = -GAP * np.arange(width + 1, dtype=np.int32)
    h = np.zeros((len(pairs), width + 1), np.int32)
    origin = np.tile(np.arange(width + 1, dtype=np.int32), (len(pairs), 1))
    best, begin, end = (np.zeros(len(pairs), np.int32) for _ in range(3))
    each = np.arange(len(pairs))
    for r in range(rows):
        diagonal = h[:, :-1] + np.where(a[:, r : r + 1] == b, MATCH, MISMATCH).astype(np.int32)
        above = h[:, 1:] + GAP
        new, start = np.zeros_like(h), np.tile(np.arange(width + 1, dtype=np.int32), (len(pairs), 1))
        take = np.maximum(diagonal, above)
        came = np.where(diagonal >= above, origin[:, :-1], origin[:, 1:])
        start[:, 1:] = np.where(take > 0, came, start[:, 1:])
        new[:, 1:] = np.maximum(take, 0)
        lifted = new + ramp  # the best cell to the left, paid for by gaps
        run = np.maximum.accumulate(lifted, axis=1)
        at = np.maximum.accumulate(np.where(lifted == run, np.arange(width + 1, dtype=np.int32), 0), axis=1)
        gapped = run - ramp > new
        start = np.where(gapped, np.take_along_axis(start, at, axis=1), start)
        new = run - ramp
        new[~real[:, r]], start[~real[:, r]] = 0, np.arange(width + 1)
        h, origin = new, start
        top = h.argmax(axis=1)
        score = h[each, top]
        better = score > best
        best[better], begin[better], end[better] = score[better], origin[each, top][better], top[better]
    return list(zip(best.tolist(), begin.tolist(), end.tolist()))


def best_passages(h: np.ndarray, own: list[np.ndarray], key: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(candidate, score, first word, last word) of a text ``h``: candidate k aligns the words ``own[k]`` of item ``key[k]``
    with the window lo[k] to hi[k]. Windows are aligned, passages taken best first, and what they leave of a window is aligned
    again; those of one item never overlap. An item of few words is its window, taken from the left."""
    out: list[tuple[int, int, int, int]] = []
    taken: dict[int, list[tuple[int, int]]] = {}
    short = np.flatnonzero([len(w) < SHORTEST for w in own])
    for k in short[np.argsort(lo[short], kind="stable")].tolist():
        ranges = taken.setdefault(int(key[k]), [(-1, -1)])
        if lo[k] >= ranges[-1][1]:
            ranges.append((int(lo[k]), int(hi[k])))
            out.append((k, MATCH * len(own[k]), int(lo[k]), int(hi[k])))
    least = needed(np.array([len(w) for w in own], np.float64))
    work = [(k, int(lo[k]), min(int(hi[k]), len(h))) for k in range(len(own)) if len(own[k]) >= SHORTEST]
    while work:
        can = []
        work.sort(key=lambda x: x[1:])
        at = 0
        while at < len(work):  # the items of one window at once
            end = at
            while end < len(work) and work[end][1:] == work[at][1:]:
                end += 1
            part = work[at:end]
            fit = enough([own[k] for k, _, _ in part], h[part[0][1] : part[0][2]], least[[k for k, _, _ in part]])
            can += [x for x, fits in zip(part, fit) if fits]
            at = end
        can.sort(key=lambda x: (x[2] - x[1], len(own[x[0]])))  # alike sizes together
        found = []
        for i in range(0, len(can), 64):
            part = can[i : i + 64]
            for (k, a, b), (score, begin, end) in zip(part, align([(own[k], h[a:b]) for k, a, b in part])):
                if score >= least[k]:
                    found.append((-score, k, a + begin, a + end, a, b))
        for less, k, begin, end, _, _ in sorted(found):
            ranges = taken.setdefault(int(key[k]), [])
            if all(end <= x or y <= begin for x, y in ranges):
                ranges.append((begin, end))
                out.append((k, -less, begin, end))
        rest = {}
        for _, k, _, _, at, stop in found:
            for x, y in [*sorted(x for x in taken[int(key[k])] if x[0] < stop and x[1] > at), (stop, stop)]:
                if MATCH * (x - at) >= least[k]:
                    rest[int(key[k]), at, x] = k
                at = max(at, y)
        work = [(k, a, b) for (_, a, b), k in rest.items()]
    return out


def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Passages of (text_key, text, candidates) rows."""
    kind = pa.schema([("text_key", pa.binary()), ("item_id", pa.int64()), ("score", pa.int32()), ("share", pa.float64()), ("first_word", pa.int64()), ("last_word", pa.int64())])
    for batch in batches:
        data, off = raw(batch.column(1))
        lists = batch.column(2)
        cut, flat = lists.offsets.to_numpy(), lists.values
        item, key, lo, hi = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("item_id", "key", "lo", "hi"))
        word_lists = flat.field("words")
        at, w = word_lists.offsets.to_numpy(), word_lists.values.to_numpy().view(np.uint64)
        rows = []
        for first_row, last_row in chunks(off):
            every, first, _, _ = words(data[off[first_row] : off[last_row]], off[first_row : last_row + 1] - off[first_row], loose=True)
            for r in range(first_row, last_row):
                h = every[first[r - first_row] : first[r - first_row + 1]]
                c = slice(cut[r], cut[r + 1])
                own = [w[a:b] for a, b in zip(at[c.start : c.stop], at[c.start + 1 : c.stop + 1])]
                for k, score, begin, end in best_passages(h, own, key[c], lo[c], hi[c]):
                    rows.append((batch.column(0)[r].as_py(), int(item[c][k]), score, score / (MATCH * len(own[k])), begin, end))
        columns = list(zip(*rows)) if rows else [[]] * len(kind)
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, kind)], schema=kind)


def passages(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Contaminated passages of the different texts of ``docs``: text_key (binary, md5), item_id, score, share, first_word,
    last_word."""
    texts = docs.where(F.length("text") > 0).select(text_key(), "text")
    known = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long"), "text")
    known = scratch(known.withColumn("key", F.monotonically_increasing_id()), "items")
    items = known.select("key", "text").mapInArrow(_items, "key long, words array<long>, seeds array<long>, places array<long>")
    items = scratch(items.join(known.select("key", "item_id"), "key").withColumn("n", F.size("words")), "item-words")
    seeds = items.select("key", "n", F.explode(F.arrays_zip("seeds", "places")).alias("x")).select("key", "n", F.col("x.seeds").alias("seed"), F.col("x.places").alias("place"))
    kinds = sorted({k for r in items.select(F.least("n", F.lit(PAIRS)).alias("n")).distinct().collect() for k in item_kinds(r["n"])})  # at most six
    hits = scratch(_hits(texts, seeds, kinds).distinct(), "hits")
    found = scratch(_windows(hits, _ranked(seeds, hits)), "windows")
    each = found.groupBy("text_key").agg(F.ceil(F.count("*") / CANDIDATES).alias("parts"))
    part = F.pmod(F.xxhash64("key"), F.col("parts"))
    rows = found.join(each, "text_key").join(items.select("key", "item_id", "words"), "key")
    candidates = rows.groupBy("text_key", part.alias("part")).agg(F.collect_list(F.struct("key", "item_id", "words", "lo", "hi")).alias("candidates"))
    keys = each.select("text_key")
    bits = filter_bits(n_keys := keys.count())
    wanted = positions_filter(keys.select(F.pmod(F.xxhash64("text_key"), F.lit(bits)).alias("at"))) if n_keys else None
    own = maybe_in(texts, "text_key", wanted, "may", bits).where("may").drop("may") if n_keys else texts.limit(0)
    own = own.groupBy("text_key").agg(F.any_value("text").alias("text"))
    return own.join(candidates.drop("part"), "text_key").select("text_key", "text", "candidates").mapInArrow(_aligned, "text_key binary, item_id long, score int, share double, first_word long, last_word long")


def text_key():
    return F.unhex(F.md5(F.col("text").cast("binary"))).alias("text_key")


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per contaminated passage: doc_id, item_id, score, share, first_word, last_word (end exclusive).

    ``docs`` has doc_id and text, ``benchmark`` item_id and text. Words are runs of letters and digits, case ignored. A
    passage counts from a score of 0.4 times its item's best one, or of 25 words that match. Items of fewer than four words
    are found where their whole sequence stands; those without a word never. Null and empty texts have no passage; items and
    documents that repeat each have their own. Other columns are not read.
    """
    found = passages(docs, benchmark)
    return docs.select("doc_id", text_key()).join(found, "text_key").select("doc_id", "item_id", "score", "share", "first_word", "last_word")


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows whose text has a contaminated passage, all their columns kept. Rows that can't be among
    them, by a bit filter, stay where they are."""
    gone = scratch(passages(docs, benchmark).select(F.col("text_key").alias("leaked_text_key")).distinct(), "leaked")
    n = gone.count()
    if not n:
        return docs
    bits = filter_bits(n)
    wanted = positions_filter(gone.select(F.pmod(F.xxhash64("leaked_text_key"), F.lit(bits)).alias("at")))
    names = docs.columns
    marked = docs.select(F.struct(*names).alias("row"), text_key())
    marked = maybe_in(marked, "text_key", wanted, "may", bits)
    clear = marked.where("NOT may").select("row.*")
    rest = marked.where("may").join(gone, F.col("text_key") == F.col("leaked_text_key"), "left_anti").select("row.*")
    return clear.union(rest)
