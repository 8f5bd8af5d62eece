"""Lexical search, periodic runs and fingerprints against plain versions: on the driver's tables, random rows and edge cases."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from conftest import DATA
from pyspark.sql import functions as F
from test_operators import CLASHES, EDGE, SCHEMA

from gradeloom.llm import lexical, queries, runs, simhash

WORD = r"[^\x20\x09-\x0D]+"


def lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(EDGE, SCHEMA).withColumns({c: F.lit(1) for c in (*CLASHES, "item", "terms", "tfs", "fp", "runs", "collapsed", "g", "h", "rank", "score")}).repartition(4)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# ---- 11


def plain_search(docs, items, top=10):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower(t))
    own = [(i, collections.Counter(terms(t))) for i, t in docs]
    own = [(i, c, sum(c.values())) for i, c in own if c]
    n_docs, n_terms = len(own), sum(n for _, _, n in own)
    df = collections.Counter(t for _, c, _ in own for t in c)
    out = []
    for item, text in dict.fromkeys(items):
        scores = []
        for doc, c, n in own:
            m = 25 + 75 * n * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms(text) if c[t])
            if s > 0:
                scores.append((-s, doc is None, doc or 0, doc))
        out += [(item, i, doc, -s) for i, (s, _, _, doc) in enumerate(sorted(scores)[:top], 1)]
    return sorted(out, key=repr)


def test_lexical_search_edges(spark, edge, empty):
    items = [(1, "one TWO tail"), (2, None), (3, ""), (4, "?! .."), (5, "É abcdef token token"), (6, EDGE[4][1]), (6, "one"), (7, "one"), (7, "one"), (None, "words"), (8, " ".join(EDGE[11][1].split()[:300])), (9, "nowhere0")]
    given = spark.createDataFrame(items, "item_id long, text string").withColumns({"key": F.lit(1), "score": F.lit(2)})
    got = sorted(map(tuple, lexical.search_lexical(edge, given).collect()), key=repr)
    assert got == plain_search([(r[0], r[1]) for r in EDGE], items)
    assert lexical.search_lexical(empty, given).collect() == []
    assert lexical.search_lexical(edge, given.limit(0)).collect() == []


def test_lexical_search_of_many_blocks_and_ties(spark, monkeypatch):
    r = random.Random(3)
    names = [f"w{i}" for i in range(60)]
    docs = [(i, " ".join(r.choices(names, weights=[1 / (1 + k) for k in range(60)], k=r.randint(0, 40)))) for i in range(900)]
    docs += [(i + 2000, docs[i % 7][1]) for i in range(60)]  # copies: equal scores
    items = [(i, " ".join(r.choices(names, k=r.randint(1, 90)))) for i in range(40)]
    monkeypatch.setattr(lexical, "BLOCK_TERMS", 300)
    got = lexical.search_lexical(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(map(tuple, got.collect()), key=repr) == plain_search(docs, items)


def test_search_leaves_low_masks_out():
    """Groups whose bound is below the tenth score aren't scored."""
    scored = []

    class Seen(lexical.Best):
        def add(self, score, doc):
            scored.extend(doc.tolist())
            super().add(score, doc)

    ids = np.arange(1000)
    rare, common = np.arange(20), np.arange(1000)
    best = Seen(10)
    lexical._search([(rare, np.full(20, 900)), (common, np.full(1000, 10))], np.array([50, 1]), ids, best)
    assert best.doc.tolist() == list(range(10))
    assert set(scored) <= set(range(1000))
    scored.clear()
    lexical._search([(common, np.full(1000, 10))], np.array([1]), ids + 5000, best)
    assert scored == []


# ---- 12


def plain_runs(words):
    _, w = np.unique(np.array(words, dtype=object).astype(str), return_inverse=True) if words else (None, np.zeros(0))
    out, n = {}, len(w)
    for q in range(1, n // 4 + 1):
        same = np.concatenate(([False], w[:-q] == w[q:], [False]))
        change = np.flatnonzero(same[1:] != same[:-1])
        for a, b in zip(change[::2].tolist(), change[1::2].tolist()):
            if b - a + q >= max(6, 4 * q) and (a, b - a + q) not in out:  # a smaller period has the same stretch
                out[a, b - a + q] = q
    return sorted((a, size, q) for (a, size), q in out.items())


def plain_collapse(words, found):
    gone = {i for a, size, q in found for i in range(a + q, a + size)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def plain_op12(doc_id, text):
    words = re.findall(WORD, text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    g = h // 10
    if doc_id is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]
    found = plain_runs(words)
    best = (None,) * 3
    for x in found:
        if best[0] is None or x[1] * best[2] > best[1] * x[2]:
            best = x
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None, sha("".join(f"{a},{b},{c}\n" for a, b, c in found)), sha(plain_collapse(words, found)))


def test_op12_on_the_tables(spark):
    got = {r["doc_id"]: tuple(r) for r in queries.op12_periodic_runs(spark, DATA).collect()}
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    assert sum(x[1] > 0 for x in got.values()) > 5
    for d in docs:
        assert got[d["doc_id"]] == plain_op12(*d)


def test_runs_of_random_words():
    r = random.Random(5)
    for _ in range(150):
        texts = []
        for _ in range(8):
            w = [str(r.randrange(r.choice([1, 2, 3, 50]))) for _ in range(r.choice([0, 1, 5, 30, 90]))]
            for _ in range(r.randrange(4)):
                at = r.randrange(len(w) + 1)
                w[at:at] = [str(r.randrange(4)) for _ in range(r.randint(1, 12))] * r.randint(2, 7)
            texts.append(w)
        _, found, collapsed = runs._found([" ".join(w).encode() for w in texts])
        for w, x, c in zip(texts, found, collapsed):
            wanted = plain_runs(w)
            assert [(y["start"], y["length"], y["period"]) for y in x] == wanted
            assert c.decode() == plain_collapse(w, wanted)


def test_wavelet_tree():
    r = np.random.default_rng(2)
    values = r.permutation(500)
    tree = runs.WaveletTree(values)
    lo = r.integers(0, 499, 300)
    hi = lo + 1 + r.integers(0, 500 - lo)
    x, k = r.integers(0, 500, 300), (r.random(300) * (hi - lo)).astype(int)
    assert tree.below(lo, hi, x).tolist() == [int((values[a:b] < v).sum()) for a, b, v in zip(lo, hi, x)]
    assert tree.kth(lo, hi, k).tolist() == [int(np.sort(values[a:b])[i]) for a, b, i in zip(lo, hi, k)]


def test_runs_edges(spark, edge, empty):
    long = [(20, "ab " * 200_000, "en", "s0", 1), (21, None, "en", "s0", 1), (None, "x y " * 9 + "  z", None, None, None)]
    docs = edge.select(SCHEMA.replace(" long", "").replace(" string", "").split(", ")).union(spark.createDataFrame(long, SCHEMA)).withColumn("runs", F.lit(1))
    got = sorted(((r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in runs.find_runs(docs).collect()), key=repr)
    wanted = []
    for i, text, *_ in [*EDGE, *long]:
        words = re.findall(WORD, text or "")
        found = [(0, 200_000, 1)] if i == 20 else plain_runs(words) if len(words) < 1000 else []
        wanted.append((i, len(words), found, plain_collapse(words, found)))
    assert got == sorted(wanted, key=repr)
    assert runs.find_runs(empty).collect() == []


# ---- 13


def plain_print(text):
    words = re.findall(WORD, lower(text))
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]), 42) for i in range(len(words) - 2)] or ([xxhash.xxh64_intdigest(" ".join(words), 42)] if words else [])
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(rows, k=3):
    prints = np.array(sorted({fp for _, fp in rows}), np.uint64)
    near = np.bitwise_count(prints[:, None] ^ prints) <= k
    up = np.arange(len(prints))
    while True:
        new = np.array([up[row].min() for row in near])
        if (new == up).all():
            break
        up = new
    root = dict(zip(prints.tolist(), up.tolist()))
    least = {}
    for i, fp in rows:
        if i is not None:
            least[root[fp]] = min(i, least.get(root[fp], i))
    return sorted(((i, fp, least.get(root[fp])) for i, fp in rows), key=repr)


def test_op13_on_the_tables(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    wanted = [(i, f"{fp:016x}", c) for i, fp, c in plain_components([(d["doc_id"], plain_print(d["text"])) for d in docs])]
    assert sorted(map(tuple, queries.op13_simhash(spark, DATA).collect()), key=repr) == sorted(wanted, key=repr)


def test_simhash_edges(spark, edge, empty):
    got = [(r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in simhash.simhash_components(edge).collect()]
    assert sorted(got, key=repr) == plain_components([(i, plain_print(t)) for i, t, *_ in EDGE])
    assert simhash.simhash_components(empty).collect() == []


def dense(seed, n, centres, flips):
    """Fingerprints around a few centres, so that many differ by a few bits only."""
    g = np.random.default_rng(seed)
    fp = g.choice(g.integers(0, 1 << 63, centres, dtype=np.uint64), n)
    for _ in range(flips):
        fp = fp ^ np.where(g.random(n) < 0.5, np.uint64(1) << g.integers(0, 64, n, dtype=np.uint64), np.uint64(0))
    return np.unique(fp)


@pytest.mark.parametrize(("n", "centres", "flips"), [(2, 1, 1), (300, 5, 3), (700, 500, 2), (900, 1, 6), (900, 40, 9)])
def test_near_fingerprints(n, centres, flips):
    fp = dense(n + flips, n, centres, flips)
    wanted = {x: c for x, _, c in ((i, f, c) for i, f, c in plain_components(list(enumerate(fp.tolist()))))}
    assert simhash.link_near(fp, 3).tolist() == [wanted[i] for i in range(len(fp))]
    tree = simhash.VantageTree(fp[::9], 8, 3)
    at, shard = tree.route(fp)
    met = np.zeros((len(fp), len(fp)), bool)
    for s in range(tree.shards):
        met[np.ix_(at[shard == s], at[shard == s])] = True
    assert (met | (np.bitwise_count(fp[:, None] ^ fp) > 3)).all()


def test_shards_of_fingerprints_join_up(spark):
    fp = dense(11, 6000, 900, 5)
    prints = spark.createDataFrame([(int(x),) for x in fp.view(np.int64)], "fp long")
    got = {r["id"] % (1 << 64): r["component"] for r in simhash.components(simhash.near_links(prints)).collect()}
    up = simhash.link_near(fp, 3)
    alike = collections.defaultdict(set)
    for x, u in zip(fp.tolist(), up.tolist()):
        alike[u].add(got.get(x, x))
    assert all(len(x) == 1 for x in alike.values())
    assert len({c for x in alike.values() for c in x}) == len(alike)


def test_a_large_group_of_near_fingerprints_is_linked_without_its_pairs():
    """Some 40,000 fingerprints within three bits of one: joined by their vantage point, not by 800 million pairs."""
    bit = np.uint64(1) << np.arange(64, dtype=np.uint64)
    i, j, k = np.array([(a, b, c) for a in range(64) for b in range(a) for c in range(b)]).T
    fp = np.unique(np.uint64(0x0123456789ABCDEF) ^ bit[i] ^ bit[j] ^ bit[k])
    assert (simhash.link_near(fp, 3) == 0).all()
