"""N-gram Jaccard join: signature trees over prefix cells, then over candidate components with the sets themselves.

Exact for every pair of different texts. Two sets with |x & y| / |x | y| >= t share a shingle among the first
|x| - ceil(t|x|) + 1 of each, in any one global order, and in the smaller set among the first |x| - ceil(2t|x| / (1 + t)) + 1,
its lead. That order puts frequent shingles last, by a fixed-size count
sketch of the whole corpus, so common passages rarely meet. Sets that are equal are one class first. Within a cell
(classes that share a prefix shingle) a signature tree prunes node pairs by their greatest possible overlap; what is
left joins candidate components. Each component's sets are then brought together, and a signature tree with exact
verification links them. A large cell or component is dealt into blocks: each is linked by itself first, and then only
blocks meet that hold different components of near enough sizes, so a large group of near copies costs no pairs of blocks.

Texts of one form share its frequent shingles, and that alone may not suffice to link them. Let f be how many shingles of
a set are frequent: of sketch counts that a large cell needs. A pair shares min(f) of those at most, so where that is less
than the overlap it needs, it shares a rare shingle too; as the order puts rare ones first, that one is in both prefixes,
and its cell is small. So a set with f below the overlap that two sets of its own size need isn't the smaller one of any
pair that a large cell has to find: a large cell is led by its other sets only, and one without any is left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeloom.llm.common import BITS_PER_BUCKET, Links, bit_filter, components, filter_bits, scratch
from gradeloom.llm.textscan import chunks, mix, raw, shingles, vector_sum

SKETCH_BITS = 21
SIGNATURE, LONGEST = 1024, 1 << 15  # bits of a signature: a power of two, the set's size at least as far as that goes
LEAF, FANOUT = 64, 8
CELL, BLOCK_TOKENS, BLOCK_SETS = 1024, 1_000_000, 2048  # classes in a block of a cell; shingles and sets in one of a component


def _need(n: np.ndarray, percent: int) -> np.ndarray:
    """Least overlap of a set of n with any set that it links to."""
    return (percent * n + 99) // 100


def _frequent_code() -> int:
    """The least code of a frequent shingle; whatever is below has at most ``CELL`` occurrences, so its cell is small."""
    return int(2 * math.log2(1 + CELL))


def _lead_sql(n: str, percent: int):
    """How many of a set's first shingles a larger or equal partner must meet."""
    return F.expr(f"{n} - ({2 * percent} * {n} + {99 + percent}) div {100 + percent} + 1")


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows, bytes and offsets of chunks of (doc_id, text, ...) batches."""
    for batch in batches:
        data, off = raw(batch.column(1))
        for lo, hi in chunks(off):
            yield batch.slice(lo, hi - lo), data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]


def _sketch(docs: DataFrame, n: int) -> np.ndarray:
    """A code for each of 2^21 shingle cells, larger for cells that the whole corpus uses more; 2 MB at any size."""

    def count(batches):
        total = np.zeros(1 << SKETCH_BITS, np.int64)
        for _, b, off in _batches(batches):
            g, _ = shingles(b, off, n)
            np.add.at(total, (g >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), 1)
        return total

    return vector_sum(docs, count, 1 << SKETCH_BITS, lambda total: np.minimum(np.floor(2 * np.log2(1 + total)), 255).astype(np.uint8))


def _profiles(docs: DataFrame, code: np.ndarray, n: int, percent: int) -> DataFrame:
    """Per document: set size, a 128-bit digest of the set, its prefix in the global order, its signature, and whether its
    frequent shingles are as many as a pair of its size must share."""
    shared, frequent = docs.sparkSession.sparkContext.broadcast(code), _frequent_code()
    kind = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("n", pa.int64()), ("wide", pa.bool_()), ("d1", pa.int64()), ("d2", pa.int64()), ("prefix", pa.list_(pa.int64())), ("sig", pa.binary())])

    def profile(batches):
        rank = shared.value
        for part, b, off in _batches(batches):
            g, at = shingles(b, off, n)
            size, wide, d1, d2, prefix, sig = [], [], [], [], [], []
            for lo, hi in zip(at[:-1], at[1:]):
                u = np.unique(g[lo:hi])
                k = len(u)
                size.append(k)
                if not k:
                    wide.append(False), d1.append(0), d2.append(0), prefix.append(np.zeros(0, np.int64)), sig.append(b"")
                    continue
                m = mix(u + np.uint64(0x51ED270B))
                d1.append(int(m.sum(dtype=np.uint64).view(np.int64)))
                d2.append(int(mix(m ^ np.uint64(0x2545F4914F6CDD1D)).sum(dtype=np.uint64).view(np.int64)))
                uses = rank[u >> np.uint64(64 - SKETCH_BITS)]
                wide.append(bool(np.count_nonzero(uses >= frequent) * (100 + percent) >= 2 * percent * k))
                order = (uses.astype(np.uint64) << np.uint64(56)) | (m >> np.uint64(8))
                p = k - int(_need(k, percent)) + 1
                first = np.argpartition(order, p - 1)[:p]
                prefix.append(u[first[np.argsort(order[first])]].view(np.int64))
                bits = np.zeros(min(LONGEST, max(SIGNATURE, 1 << (k - 1).bit_length())), np.uint8)
                bits[m & np.uint64(len(bits) - 1)] = 1
                sig.append(np.packbits(bits).tobytes())
            flat = np.concatenate(prefix) if prefix else np.zeros(0, np.int64)
            ends = np.concatenate(([0], np.cumsum([len(x) for x in prefix]))).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(2), pa.array(size, pa.int64()), pa.array(wide, pa.bool_()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), pa.array(sig, pa.binary())], schema=kind
            )

    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_key")).mapInArrow(profile, "doc_id long, text_key long, n long, wide boolean, d1 long, d2 long, prefix array<long>, sig binary")


def _runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables that hold whole runs of equal ``key`` values of a sorted partition."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        k = batch.column(batch.schema.get_field_index(key)).to_numpy()
        cut = int(np.searchsorted(k, k[-1]))
        if held and k[0] != held[-1].column(batch.schema.get_field_index(key))[-1].as_py() or cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = [batch.slice(cut)]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).sum(axis=-1, dtype=np.int64)


class SignatureTree:
    """Records in order of size; every node holds the OR of its records' bitmaps, their size range, and the most
    tokens that fell on a bit already set in one of its records."""

    def __init__(self, size: np.ndarray, sig: np.ndarray, percent: int):
        self.size, self.sig, self.percent = size, sig, percent
        self.over = size - _popcount(sig)
        self.low, self.high, self.bits, self.most = [], [], [], []
        n, at = len(size), np.arange(0, len(size), LEAF)
        low, high, bits, most = size[at], size[np.minimum(at + LEAF, n) - 1], np.bitwise_or.reduceat(sig, at), np.maximum.reduceat(self.over, at)
        while True:
            self.low.append(low), self.high.append(high), self.bits.append(bits), self.most.append(most)
            if len(low) == 1:
                break
            at = np.arange(0, len(low), FANOUT)
            low, high, bits, most = np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.bitwise_or.reduceat(bits, at), np.maximum.reduceat(most, at)

    def _possible(self, level: int, i: int, j: np.ndarray) -> np.ndarray:
        """Node pairs whose greatest possible overlap reaches what their least sizes need."""
        low, high, most = self.low[level], self.high[level], self.most[level]
        overlap = np.minimum(_popcount(self.bits[level][i] & self.bits[level][j]) + np.minimum(most[i], most[j]), np.minimum(high[i], high[j]))
        need = -(-self.percent * (low[i] + low[j]) // (100 + self.percent))
        return (overlap >= need) & (high[j] * 100 >= low[i] * self.percent) & (high[i] * 100 >= low[j] * self.percent)

    def link(self, linked, links: Links) -> None:
        """Dual traversal from (root, root): joins in ``links`` every pair for which ``linked(i, j)`` holds, apart from
        pairs that are joined already."""
        n, top = len(self.size), len(self.low) - 1
        stack = [(top, 0, 0)]
        while stack:
            level, i, j = stack.pop()
            span = LEAF * FANOUT**level
            a, b = slice(i * span, min(n, (i + 1) * span)), slice(j * span, min(n, (j + 1) * span))
            roots = links.up = links.roots()
            if a.stop - a.start + b.stop - b.start > 2 and (roots[a] == roots[a.start]).all() and (roots[b] == roots[a.start]).all():
                continue
            if level:
                left = range(i * FANOUT, min(len(self.low[level - 1]), (i + 1) * FANOUT))
                for x in left:
                    right = np.arange(max(x, j * FANOUT) if i == j else j * FANOUT, min(len(self.low[level - 1]), (j + 1) * FANOUT))
                    stack += [(level - 1, x, int(y)) for y in right[self._possible(level - 1, x, right)][::-1]]
                continue
            x, y = self._leaf(a, b)
            for p, q in zip(x.tolist(), y.tolist()):
                if links.root(p) != links.root(q) and linked(p, q):
                    links.join(p, q)

    def _leaf(self, a: slice, b: slice) -> tuple[np.ndarray, np.ndarray]:
        x, y = np.meshgrid(np.arange(a.start, a.stop), np.arange(b.start, b.stop), indexing="ij")
        x, y = x.ravel(), y.ravel()
        keep = (x < y) & (self.size[x] * 100 >= self.size[y] * self.percent)
        return possible_pairs(self.size, self.sig, self.over, x[keep], y[keep], self.percent)


def possible_pairs(size, sig, over, x, y, percent):
    """Pairs that sizes and bitmaps don't rule out: |x & y| is at most the common bits and the tokens that share one."""
    overlap = _popcount(sig[x] & sig[y]) + np.minimum(over[x], over[y])
    keep = (100 + percent) * np.minimum(overlap, np.minimum(size[x], size[y])) >= percent * (size[x] + size[y])
    return x[keep], y[keep]


def _signatures(column: list[bytes]) -> np.ndarray:
    """Signatures of any lengths, folded to the shortest one."""
    out = np.zeros((len(column), SIGNATURE // 64), np.uint64)
    for i, x in enumerate(column):
        flat = np.frombuffer(x, np.uint64).reshape(-1, SIGNATURE // 64)
        out[i] = flat[0] if len(flat) == 1 else np.bitwise_or.reduce(flat)
    return out


def _long_enough(size: np.ndarray, full: list[bytes], percent: int):
    """Whether the unfolded signatures of a pair leave it possible too."""

    def possible(i: int, j: int) -> bool:
        x, y = np.frombuffer(full[i], np.uint64), np.frombuffer(full[j], np.uint64)
        if len(x) == len(y) == SIGNATURE // 64:
            return True
        n = min(len(x), len(y))
        x, y = (v if len(v) == n else np.bitwise_or.reduce(v.reshape(-1, n)) for v in (x, y))
        over = min(int(size[i]) - int(_popcount(x)), int(size[j]) - int(_popcount(y)))
        overlap = min(int(_popcount(x & y)) + over, int(size[i]), int(size[j]))
        return (100 + percent) * overlap >= percent * int(size[i] + size[j])

    return possible


def _cells(percent: int):
    """Candidate links of each cell as a forest, small cells all at once."""

    def run(batches):
        for table in _runs(batches, "cell"):
            token, cid, size, lead = (table[c].to_numpy() for c in ("cell", "cid", "n", "lead"))
            full = table["sig"].to_pylist()
            sig = _signatures(full)
            possible = _long_enough(size, full, percent)
            over = size - _popcount(sig)
            start = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
            count = np.diff(np.concatenate((start, [len(token)])))
            left, right = [], []
            for k in np.unique(count[(count > 1) & (count <= LEAF)]):
                at = start[count == k]
                i, j = np.triu_indices(int(k), 1)
                for lo in range(0, len(at), max(1, 200_000 // len(i))):
                    part = at[lo : lo + max(1, 200_000 // len(i))]
                    x, y = (part[:, None] + i).ravel(), (part[:, None] + j).ravel()
                    fits = (size[x] * 100 >= size[y] * percent) & lead[x]  # sorted by size, so y is the larger
                    x, y = possible_pairs(size, sig, over, x[fits], y[fits], percent)
                    left.append(x), right.append(y)
            trees = [np.zeros((0, 2), np.int64)]
            for at, k in zip(start[count > LEAF].tolist(), count[count > LEAF].tolist()):
                own = slice(at, at + k)
                links = Links(k)
                SignatureTree(size[own], sig[own], percent).link(lambda i, j, at=at: bool(lead[at + i]) and possible(at + i, at + j), links)
                roots = links.roots()
                moved = np.flatnonzero(roots != np.arange(k))
                trees.append(np.stack((cid[at + moved], cid[at + roots[moved]]), 1))
            if left or len(trees) > 1:
                x, y = (np.concatenate(side) if side else np.zeros(0, np.int64) for side in (left, right))
                pair, at = np.unique(np.stack((cid[x], cid[y]), 1), axis=0, return_index=True)
                far = np.maximum(size[x[at]], size[y[at]]) > SIGNATURE // 2
                keep = ~far
                keep[far] = [possible(i, j) for i, j in zip(x[at[far]].tolist(), y[at[far]].tolist())]
                # an edge to a tree's root stands for links that were possible, and its own ends needn't be
                pair = np.concatenate((pair[keep], *trees))
                ids, at = np.unique(pair, return_inverse=True)
                links = Links(len(ids))
                for p, q in at.reshape(-1, 2).tolist():
                    links.join(p, q)
                roots = links.roots()
                moved = np.flatnonzero(roots != np.arange(len(ids)))
                yield pa.RecordBatch.from_arrays([pa.array(ids[moved]), pa.array(ids[roots[moved]])], ["a", "b"])

    return run


def _meetings(rows: DataFrame, group: str, percent: int) -> DataFrame:
    """``rows`` (group, cid, label, n, w) once for each ``place`` where they meet others of their group.

    A row is in a block, of a total of about 1 in w: a large label's rows of a size level have blocks of their own, those
    of small labels share some. Two blocks meet unless they hold one label only, or sizes too far apart to link, or no row
    that leads (a boolean, if ``rows`` has it) at the lesser size. A group of one label has no place."""
    level = F.floor(F.log(F.col("n").cast("double")) / (math.log(100 / percent) * (1 + 1e-9))).cast("int")
    rows = rows.withColumns({"level": level, "leads": F.col("lead") if "lead" in rows.columns else F.lit(True)})
    own = scratch(rows.groupBy(group, "label", "level", "leads").agg(F.sum("w").alias("weight")), "labels")
    several = own.groupBy(group).agg(F.min("label").alias("one"), F.max("label").alias("two")).where("one < two").select(group)
    own = own.join(several, group)
    pool = own.where("weight <= 0.5").groupBy(group, "level", "leads").agg(F.ceil(F.sum("weight")).alias("pool"))
    rows = rows.join(own, [group, "label", "level", "leads"]).join(pool, [group, "level", "leads"], "left")
    pure = F.col("weight") > 0.5
    block = F.struct(
        F.col("level"), F.col("leads"), F.when(pure, F.col("label")).otherwise(-1).alias("of"),
        F.when(pure, F.pmod(F.xxhash64("cid"), F.ceil("weight"))).otherwise(F.pmod(F.xxhash64("label"), F.col("pool"))).alias("i"),
    )
    rows = scratch(rows.withColumn("block", block).drop("level", "leads", "weight", "pool"), "blocks")
    blocks = rows.select(group, "block").distinct()
    pairs = blocks.join(blocks.select(group, F.col("block").alias("other")), group).where("block <= other AND other.level - block.level <= 1 AND (block.of <> other.of OR block.of = -1)")
    pairs = pairs.where("block.leads OR (other.leads AND block.level = other.level)")
    pairs = pairs.withColumn("place", F.xxhash64(group, "block", "other"))
    ends = pairs.select(group, "block", "place").union(pairs.where("block <> other").select(group, "other", "place"))
    return rows.join(ends, [group, "block"]).drop("block")


def _candidates(shared: DataFrame, percent: int) -> DataFrame:
    """Candidate links (a, b) of all cells, from ``shared`` (token, cid, n, lead, sig, m: classes in the cell)."""

    def link(cells: DataFrame) -> DataFrame:
        cells = cells.select("cell", "cid", "n", "lead", "sig").repartition("cell").sortWithinPartitions("cell", "n", "cid")
        return scratch(cells.mapInArrow(_cells(percent), "a long, b long"), "links")

    blocks = F.ceil(F.col("m") / CELL)
    first = link(shared.withColumn("cell", F.when(F.col("m") > CELL, F.xxhash64("token", F.pmod(F.xxhash64("token", "cid"), blocks))).otherwise(F.col("token"))))
    large = shared.where(F.col("m") > CELL)
    if large.isEmpty():
        return first
    labels = components(first).select(F.col("id").alias("cid"), F.col("component").alias("label"))
    large = large.join(labels, "cid", "left").withColumn("label", F.coalesce("label", "cid")).withColumn("w", F.lit(1.0 / CELL))
    return first.union(link(_meetings(large, "token", percent).withColumnRenamed("place", "cell")))


def _verify(percent: int):
    """Exact links inside each candidate component of a group, by a signature tree over the sets."""

    def run(table: pa.Table) -> pa.Table:
        order = np.lexsort((table["cid"].to_numpy(), table["n"].to_numpy(), table["comp"].to_numpy()))
        table = table.take(pa.array(order))
        cid, comp, size = (table[c].to_numpy() for c in ("cid", "comp", "n"))
        sig = _signatures(table["sig"].to_pylist())
        sets = table["tokens"].combine_chunks()
        flat, off = sets.values.to_numpy(), sets.offsets.to_numpy()
        start = np.flatnonzero(np.concatenate(([True], comp[1:] != comp[:-1])))
        left, right = [], []
        for lo, hi in zip(start, [*start[1:], len(comp)]):
            if hi - lo < 2:
                continue
            links = Links(hi - lo)

            def linked(i, j, lo=lo):
                x, y = flat[off[lo + i] : off[lo + i + 1]], flat[off[lo + j] : off[lo + j + 1]]
                both = len(np.intersect1d(x, y, assume_unique=True))
                return 100 * both >= percent * (len(x) + len(y) - both)

            SignatureTree(size[lo:hi], sig[lo:hi], percent).link(linked, links)
            roots = links.roots()
            moved = np.flatnonzero(roots != np.arange(hi - lo))
            left.append(cid[lo:hi][moved]), right.append(cid[lo:hi][roots[moved]])
        return pa.table({"a": np.concatenate(left) if left else np.zeros(0, np.int64), "b": np.concatenate(right) if right else np.zeros(0, np.int64)})

    return run


def _sets(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """Shingle sets of the documents in ``wanted`` (column cid, a written table); a bit filter spares most others the work."""
    n_bits = filter_bits(wanted.count())
    bits = np.zeros((n_bits // BITS_PER_BUCKET, BITS_PER_BUCKET // 8), np.uint8)
    for r in bit_filter(wanted, "cid", n_bits).collect():  # at most 8,192 rows of 4 KB
        bits[r["bf_bucket"]] = np.frombuffer(r["bf_bits"], np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(bits.reshape(-1))
    at = F.pmod(F.xxhash64("doc_id"), F.lit(n_bits))

    def sets(batches):
        have = shared.value
        for batch in batches:
            h = batch.column(2).to_numpy()
            keep = (have[h >> 3] >> (h & 7).astype(np.uint8)) & 1 > 0
            for part, b, off in _batches([batch.filter(pa.array(keep))]):
                g, span = shingles(b, off, n)
                each = [np.unique(g[lo:hi]).view(np.int64) for lo, hi in zip(span[:-1], span[1:])]
                ends = np.concatenate(([0], np.cumsum([len(x) for x in each]))).astype(np.int32)
                flat = np.concatenate(each) if each else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["cid", "tokens"])

    return docs.where("doc_id is not null").select("doc_id", "text", at.alias("at")).mapInArrow(sets, "cid long, tokens array<long>")


def _linked(docs: DataFrame, members: DataFrame, n: int, percent: int) -> DataFrame:
    """Exact links (a, b) inside candidate components, from ``members`` (cid, comp, n, sig)."""

    def verify(placed: DataFrame) -> DataFrame:
        placed = scratch(placed.select("cid", "comp", "n", "sig", "place"), "placed")
        sets = placed.join(_sets(docs, placed.select("cid").distinct(), n), "cid")
        # a doc_id that repeats with another text brings more sets than its class has: only the class's own counts
        sets = sets.where(F.size("tokens") == F.col("n"))
        return scratch(sets.groupBy("place").applyInArrow(_verify(percent), "a long, b long"), "links")

    members = members.withColumn("w", F.greatest(F.col("n") / BLOCK_TOKENS, F.lit(1.0 / BLOCK_SETS)))
    weight = scratch(members.groupBy("comp").agg(F.ceil(F.sum("w")).alias("blocks"), F.sum("n").alias("tokens")), "weight")
    packs = F.pmod(F.xxhash64("comp"), F.lit(1 + int(weight.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]) // BLOCK_TOKENS))
    rows = members.join(weight, "comp")
    first = verify(rows.withColumn("place", F.when(F.col("blocks") == 1, packs).otherwise(F.xxhash64("comp", F.pmod(F.xxhash64("cid"), F.col("blocks"))))))
    large = weight.where("blocks > 1").select("comp")
    if large.isEmpty():
        return first
    labels = components(first).select(F.col("id").alias("cid"), F.col("component").alias("label"))
    split = members.join(large, "comp").join(labels, "cid", "left").withColumn("label", F.coalesce("label", "cid"))
    return first.union(verify(_meetings(split, "comp", percent)))


def jaccard_components(docs: DataFrame, shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of ``docs`` (doc_id long, text string): doc_id, n_shingles, component_id, text_key.

    Sets are of distinct ``shingle_words``-word shingles; two documents link at a Jaccard similarity of ``percent``
    hundredths or more; component_id is the least doc_id that links reach. A null, empty or blank text has an empty set
    and is linked with nothing. Rows that repeat a doc_id with another text have a component each, unless theirs is the
    least doc_id of both: then they count as one document that has both texts' links. A row without doc_id gets its size
    and a null component. text_key is xxhash64 of the text, to join by beside doc_id. Other columns are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text"))
    profiles = scratch(_profiles(docs, _sketch(docs, shingle_words), shingle_words, percent), "profiles")
    known = profiles.where("n > 0 and doc_id is not null")
    # written, so that joins with it deal both sides anew and Spark can split a class of many copies
    classes = scratch(known.groupBy("d1", "d2").agg(F.min("doc_id").alias("cid"), F.max("n").alias("n")), "classes")
    postings = known.groupBy("d1", "d2").agg(F.min("doc_id").alias("cid"), F.max("n").alias("n"), F.any_value("wide").alias("wide"), F.any_value("prefix").alias("prefix"))
    postings = postings.select(F.posexplode("prefix").alias("pos", "token"), "cid", "n", "wide")
    postings = scratch(postings.select("token", "cid", "n", (F.col("pos") < _lead_sql("n", percent)).alias("lead"), "wide"), "postings")
    # a cell counts if its token is in several classes, and leads one of their sets at least: in a large cell, a wide one
    cells = postings.groupBy("token").agg(F.count("*").alias("m"), F.max("lead").alias("led"), F.max(F.expr("lead AND wide")).alias("led_wide"))
    cells = cells.where(f"m > 1 AND if(m > {CELL}, led_wide, led)").select("token", "m")
    postings = postings.join(cells, "token").withColumn("lead", F.expr(f"lead AND (m <= {CELL} OR wide)")).drop("wide")
    signed = known.groupBy("d1", "d2").agg(F.min("doc_id").alias("cid"), F.any_value("sig").alias("sig"))
    shared = scratch(postings.join(signed.select("cid", "sig"), "cid"), "shared")
    labels = components(_candidates(shared, percent)).withColumnsRenamed({"id": "cid", "component": "comp"})
    members = scratch(labels.join(signed.select("cid", "sig"), "cid").join(classes.select("cid", "n"), "cid"), "members")
    labels = components(_linked(docs, members, shingle_words, percent))
    return (
        profiles.select("doc_id", "text_key", "n", "d1", "d2")
        .join(classes.select("d1", "d2", "cid"), ["d1", "d2"], "left")
        .join(labels.select(F.col("id").alias("cid"), "component"), "cid", "left")
        .select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", F.when(F.col("n") > 0, F.col("cid")), "doc_id")).alias("component_id"), "text_key")
    )
