"""Each operator against a plain version, on hand-made rows with nulls, blanks, long texts, ties and clashing columns."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradeloom.llm import chat, common, decontam, dedup, jaccard, language, mixing, quality, secrets, sharding, tokencount
from gradeloom.llm.common import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside; extra columns may have them.
CLASHES = ("key", "digest", "n", "shard", "kinds", "at", "hit", "pass", "block", "component", "size", "token", "low", "norm", "best", "bucket", "cid", "tokens", "row", "r", "d", "drawn_key", "may", "met", "chars", "perspective", "turns", "entry", "alone", "parts", "keep", "stream", "ordinal", "ids", "own", "place", "label", "level", "text_key", "carried", "law", "slot")
rng = random.Random(7)
VOCABULARY = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 8))) for _ in range(3000)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCABULARY) for _ in range(n))


BASE = prose(120, 1)
EDGE = [
    (1, None, None, None, None), (2, "", "en", "s0", 0), (3, " \t\n", "en", "s0", 3), (4, "12345 !!", None, "s1", 8), (5, BASE, "en", "s0", 1), (6, BASE.upper(), "en", "s0", 1),
    (7, BASE + " tail", "en", None, 1), (8, BASE.replace(" ", "  "), "de", "s0", 1), (8, BASE.replace(" ", "  "), "de", "s0", 1), (None, BASE, "en", "s0", 1), (None, "lonely words without an id here", "en", "s2", 1),
    (9, prose(30000, 2), "en", "s0", 1), (10, "one two", "fr", "s3", 1), (11, "One  TWO", "fr", "s3", 1), (12, "É è ñ token: abcdef", "fr", "s3", 1),
]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(EDGE, SCHEMA).withColumns({c: F.lit(1) for c in CLASHES}).repartition(4)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(40, 41), (41, 40), (50, 50)], "a long, b long")
    got = {r["id"]: r["component"] for r in components(edges).collect()}
    assert got == {**dict.fromkeys(range(31), 0), 40: 40, 41: 40}


# ---- 1


def test_language(spark, empty):
    sounds = {"xx": "bababebibo", "yy": "kuzukizoka"}
    rows = [(i, " ".join("".join(random.Random(i * 50 + w).sample(sounds[k], 5)) for w in range(40)), k, "s", 1) for i, k in enumerate(["xx", "yy"] * 60)]
    rows += [(1000, None, "xx", "s", 1), (1001, "", "xx", "s", 1), (1002, "12 !!", "yy", "s", 1), (1003, rows[0][1], None, "s", 1), (None, rows[1][1], "yy", "s", 1), (1004, rows[1][1] * 50, "yy", "s", 1)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({"label": F.lit(1), "p": F.lit(2)})
    got = language.identify_language(docs).collect()
    assert len(got) == len(rows)
    by_id = {r["doc_id"]: r for r in got}
    for i, _, k, *_ in rows[:120]:
        assert by_id[i]["lang_pred"] == k
        assert by_id[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1)
        assert 0.5 < by_id[i]["score"] <= 1
    assert [by_id[i]["lang_pred"] for i in (1000, 1001, 1002, 1003, None, 1004)] == ["und", "und", "und", "xx", "yy", "yy"]
    assert by_id[1000]["score"] == 0
    assert language.identify_language(empty).collect() == []


def test_language_without_labels_knows_none(spark):
    docs = spark.createDataFrame([(1, "some words", None, "s", 1)], SCHEMA)
    assert language.identify_language(docs).first()["lang_pred"] == "und"


def test_ngram_counts_match_a_plain_count():
    import pyarrow as pa

    texts = ["Ab, cd", None, "", "12 !!", " x", "é" * 5, prose(200, 5), "a", "ab"] * 9
    got, base = {}, 0
    for n, row, at, count in language.ngram_counts(pa.array(texts)):
        for r, a, c in zip(row.tolist(), at.tolist(), count.tolist()):
            got.setdefault(base + r, {})[a] = c
        base += n
    assert base == len(texts)
    m = (1 << 32) - 1

    def plain(text):
        code = [ord(c.lower()[0]) if c.isalpha() else 32 for c in text]
        whole = [c for i, c in enumerate(code) if c != 32 or i == 0 or code[i - 1] != 32]
        out = collections.Counter()
        for n in language.ORDERS:
            for i in range(len(whole) - n + 1):
                h = 0
                for k in range(n):
                    h = (h * 0x01000193 + whole[i + k] * 0x9E3779B1 + k + 1) & m
                h ^= h >> 15
                out[((h * 0x85EBCA6B) & m) >> (32 - language.BITS)] += 1
        return dict(out) if any(c != 32 for c in code) else None

    for i, x in enumerate(texts):
        assert got.get(i) == plain(x or "")


def test_ftrl_matches_a_plain_pass():
    """Steps on one feature after the other, as the update is written in papers."""
    r = np.random.default_rng(6)
    rows = [(int(r.integers(3)), np.sort(r.choice(20, 5, replace=False)), r.random(5)) for _ in range(60)]
    z, n = np.zeros((3, 20)), np.zeros((3, 20))
    language.ftrl(z, n, rows)
    a, b, l1, l2 = language.ALPHA, language.BETA, language.L1, language.L2
    pz, pn = [[0.0] * 20 for _ in range(3)], [[0.0] * 20 for _ in range(3)]

    def w(k, i):
        return 0.0 if abs(pz[k][i]) <= l1 else -(pz[k][i] - (l1 if pz[k][i] > 0 else -l1)) / ((b + pn[k][i] ** 0.5) / a + l2)

    for label, at, x in rows:
        own = [[w(k, i) for i in at] for k in range(3)]
        e = [np.exp(sum(u * v for u, v in zip(own[k], x))) for k in range(3)]
        for k in range(3):
            for j, i in enumerate(at):
                g = (e[k] / sum(e) - (k == label)) * x[j]
                s = ((pn[k][i] + g * g) ** 0.5 - pn[k][i] ** 0.5) / a
                pz[k][i] += g - s * own[k][j]
                pn[k][i] += g * g
    assert np.allclose(z, pz)
    assert np.allclose(n, pn)


def test_four_hundred_languages_are_learnt(spark):
    """Each has 12 words of its own; no cap leaves one out."""
    r = random.Random(8)
    own = [["".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=4)) for _ in range(12)] for _ in range(400)]
    rows = [(k * 10 + i, " ".join(r.choices(own[k], k=12)), f"l{k:03d}", "s", 1) for k in range(400) for i in range(10)]
    docs = spark.createDataFrame(rows, SCHEMA)
    model = language.train_language(docs)
    assert len(model.labels) == 400
    got = language.identify_language(docs, model).where("held_out").collect()
    right = sum(x["lang_pred"] == f"l{x['doc_id'] // 10:03d}" for x in got)
    print(f"400 languages: {right} of {len(got)} held-out rows right, {np.count_nonzero(model.w)} weights")
    assert right >= 0.9 * len(got)
    assert 12 * np.count_nonzero(model.w) < 20_000_000


def test_scores_are_the_same_by_either_way(monkeypatch):
    r = np.random.default_rng(3)
    w, row = r.normal(size=(70, 1 << language.BITS)), np.sort(r.integers(0, 9, 200))
    at, x = r.permutation(1 << language.BITS)[:200], r.random(200)
    many = language.logits_of(w, 9, row, at, x)
    monkeypatch.setattr(language, "MANY", 100)
    assert np.allclose(many, language.logits_of(w, 9, row, at, x))


def test_temperature_and_ftrl():
    r = np.random.default_rng(0)
    label = r.integers(0, 3, 2000)
    logits = r.normal(size=(2000, 3)) + 2 * np.eye(3)[label]
    assert 3.0 < language.fit_temperature(logits * 5, label) / language.fit_temperature(logits, label) < 7.0
    z, n = np.zeros((2, 4)), np.zeros((2, 4))
    for _ in range(20):
        language.ftrl(z, n, [(0, np.array([0]), np.array([1.0])), (1, np.array([1]), np.array([1.0])), (0, np.array([2]), np.array([1e-9]))])
    w = language.weights(z, n)
    assert w[0, 0] > 0 > w[0, 1]
    assert (w[:, 2:] == 0).all()  # inside the L1 band


def test_sums_before(spark):
    r = random.Random(3)
    arrays = [[r.randrange(50) for _ in range(n)] for n in (0, 1, 2, 3, 4, 5, 15, 16, 17, 1000)] + [None]
    rows = spark.createDataFrame([(i, a) for i, a in enumerate(arrays)], "i int, a array<int>")
    got = {x["i"]: x["s"] for x in rows.select("i", common.sums_before(F.col("a")).alias("s")).collect()}
    assert got == {i: None if a is None else list(itertools.accumulate(a[:-1], initial=0)) if a else [] for i, a in enumerate(arrays)}


# ---- 2


def spans(text):
    found = []
    for k, rule in enumerate(secrets.RULES):
        for m in re.finditer(rule.pattern, text or "", re.ASCII):
            if len(m.group(rule.group)) >= rule.least:
                found.append((m.start(), k, m.end()))
    return sorted(found)


def test_secrets(spark, edge, empty):
    texts = [
        'é token = "abcdef12" x', "password:short", "passwd = token = secret = abcdefg", "AKIA" + "A1" * 9, "AKIA" + "B" * 15, "0123456789abcdef01234567", "API_KEY='zzzzzz' apikey=yyyyyy", "sEcReT : x.y/z+w=-" * 3,
        "ghp_" + "a" * 36, "xoxb-" + "1" * 12, "AIza" + "x" * 35, "-----BEGIN RSA PRIVATE KEY-----", "deadbeef" * 5 + " token=" + "f00d" * 8, "token=" + "a" * 70000, None, "",
    ]
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(texts)] + [(0, texts[0]), (None, texts[3])], "doc_id long, text string").withColumns({c: F.lit(1) for c in CLASHES})
    got = secrets.scan_secrets(docs).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        own = spans(texts[3 if r["doc_id"] is None else r["doc_id"]])
        line = lambda s: ",".join(f"{secrets.RULES[k].kind}:{a}:{b}" for a, k, b in s)
        assert r["spans"] == line(own)
        assert r["base_sha256"] == hashlib.sha256(line([s for s in own if s[1] < 3]).encode()).hexdigest()
        assert r["n_hex"] == sum(k == 2 for _, k, _ in own)
    many = " ".join(f"{i:024x}" for i in range(20_000))  # as many spans in one text
    found = secrets.scan_secrets(spark.createDataFrame([(1, many)], "doc_id long, text string")).first()
    assert found["n_hex"] == 20_000 and found["spans"] == ",".join(f"hex:{25 * i}:{25 * i + 24}" for i in range(20_000))
    assert secrets.scan_secrets(edge).count() == len(EDGE)
    assert secrets.scan_secrets(empty).count() == 0


def test_trigram_queries():
    assert secrets.trigram_query("[0-9a-f]+") == [[]]
    assert secrets.trigram_query("abc|x") == [[]]
    assert sorted(secrets.trigram_query("ab?cde")) == [["abc", "bcd", "cde"], ["acd", "cde"]]
    assert sorted(secrets.trigram_query("tok(en|a)xyz")) == [["axy", "kax", "oka", "tok", "xyz"], ["enx", "ken", "nxy", "oke", "tok", "xyz"]]


# ---- 3


def test_quality(spark, empty, edge):
    r = random.Random(3)
    word = lambda: r.choice(VOCABULARY[:200])
    rows, labels = [], []
    for i in range(600):
        grade = i % 3
        own = [word() for _ in range(60)]
        if grade == 0:
            own[5:8] = ["vile", "rotten", "vile"]
        if grade == 1:
            own = [w.upper() + "!!" for w in own]
        rows.append((i, " ".join(own), "en", "s", 1))
        labels.append((i, int(grade == 2), int(grade == 0)))
    labels += [(0, 1, 0), (None, 1, 1), (5, None, None)]
    docs, rated = spark.createDataFrame(rows, SCHEMA), quality.graded(spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    model = quality.train_quality(docs, rated.where("doc_id < 450"))
    assert model.threshold[0] < model.threshold[1]
    got = {x["doc_id"]: x for x in quality.score_quality(docs, model).collect()}
    held = [got[i] for i in range(450, 600)]
    assert sum(x["kept"] == (x["doc_id"] % 3 == 2) for x in held) >= 145
    mean = [np.mean([x["expected_grade"] for x in held if x["doc_id"] % 3 == g]) for g in range(3)]
    assert mean[0] < mean[1] < mean[2]
    by_grade = [[x["expected_grade"] for x in held if x["doc_id"] % 3 == g] for g in range(3)]
    for g in (0, 1):  # both thresholds part their grades: share of pairs in order
        assert np.mean([a < b for a in by_grade[g] for b in by_grade[g + 1]]) > 0.9
    assert quality.score_quality(edge, model).count() == len(EDGE)
    assert quality.score_quality(empty, model).count() == 0
    bare = quality.train_quality(docs, rated.limit(0))
    assert quality.score_quality(docs, bare).where("NOT kept").count() == 0


def test_ordinal_step_follows_the_likelihood(monkeypatch):
    """The step of one row against slopes of its log likelihood, found by small differences."""
    monkeypatch.setattr(quality, "L1", 0.0)
    r = np.random.default_rng(8)
    for grade in range(4):
        w, cut = r.normal(size=6), np.array([-1.0, 0.2, -0.4])
        at, x = np.array([0, 2, 5]), r.random(3)

        def loss(w, cut, grade=grade, at=at, x=x):
            threshold = cut[0] + np.concatenate(([0], np.cumsum(np.exp(cut[1:]))))
            above = np.concatenate(([1.0], 1 / (1 + np.exp(threshold - w[at] @ x)), [0.0]))
            return -np.log(above[grade] - above[grade + 1])

        slope = lambda f, v: np.array([(f(v + e) - f(v - e)) / 2e-6 for e in 1e-6 * np.eye(len(v))])
        own = w.copy(), np.ones(6), cut.copy(), np.full(3, 1e-2)
        quality.ordinal_pass(*own, [(grade, at, x)])
        g, d = slope(lambda v: loss(v, cut), w), slope(lambda v: loss(w, v), cut)
        assert np.allclose(own[0], w - quality.RATE * g / np.sqrt(1 + g * g), atol=1e-5)
        assert np.allclose(own[2], cut - 0.1 * d / (np.sqrt(1e-2 + d * d) + 1e-6), atol=1e-5)


# ---- 4


def test_chat(spark):
    rows = [
        (1, 0, "system", "be kind"), (1, 1, "user", "hi <|assistant|>"), (1, 2, "bot", "é!"), (1, 3, "guide", None), (1, 3, "guide", "tie"), (1, None, "bot", "late"),
        (2, 0, None, ""), (2, 1, "unknown", "x"), (3, 0, "system", "alone"), (None, 0, "user", "no id"), (None, 0, "user", "no id too"),
    ]
    schema = "conv_id long, turn long, role string, text string"
    docs = spark.createDataFrame(rows, schema).withColumns({c: F.lit(1) for c in ("mask", *CLASHES)})
    got = chat.rotate_perspectives(docs).collect()
    assert sorted((r["conv_id"] or 0, r["perspective"] or "", r["n_turns"], r["n_spoken"]) for r in got) == [(0, "user", 1, 1), (0, "user", 1, 1), (1, "bot", 6, 2), (1, "guide", 6, 2), (1, "user", 6, 1), (2, "", 2, 1), (2, "unknown", 2, 1)]
    bot = next(r for r in got if r["perspective"] == "bot")
    parts = [tuple(map(int, s.split(":"))) for s in bot["mask"].split(",")]
    assert [bot["text"][a:b] for a, b in parts] == ["é!<|end|>\n", "late<|end|>\n"]
    assert all(bot["text"][:a].endswith("<|assistant|>\n") for a, _ in parts)
    assert "hi <\\|assistant|>" in bot["text"]
    assert "<|user name=guide|>\n<|end|>" in bot["text"]
    assert bot["masked_chars"] == sum(b - a for a, b in parts)
    assert [r["text"] for r in got if r["perspective"] == "unknown"] == ["<|user|>\n<|end|>\n<|assistant|>\nx<|end|>\n"]
    assert chat.rotate_perspectives(spark.createDataFrame([], schema)).count() == 0


def parsed(text):
    """(header, content) of each turn of a rendered dialogue."""
    turns = re.findall(r"<\|(system|assistant|user|user name=[^|<\n]*)\|>\n(.*?)<\|end\|>\n", text, re.DOTALL)
    assert "".join(f"<|{h}|>\n{b}<|end|>\n" for h, b in turns) == text
    return turns


def unescaped(text, marks):
    return re.sub(r"\\(.)", lambda m: marks[m[1]], text, flags=re.DOTALL)


def test_hostile_dialogues_come_back(spark):
    r = random.Random(11)
    odd = lambda: "".join(r.choice(["<", "|", ">", "\\", "\n", "\r", "a", "<|end|>\n", "<|assistant|>\n", "|>", "p", "l", "é"]) for _ in range(r.randint(0, 12)))
    rows = [(c, i, odd() or "z", odd()) for c in range(40) for i in range(6)] + [(100, i, f"s{i % 3}", "x" * 500) for i in range(3000)]
    talks = collections.defaultdict(list)
    for c, i, role, text in rows:
        talks[c].append((i, role, text))
    got = chat.rotate_perspectives(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert len(got) == sum(len({x[1] for x in t}) for t in talks.values())
    names = {i[1]: m for m, i in chat.NAME_MARKS}
    for x in got:
        turns = parsed(x["text"])
        assert [unescaped(b, {"\\": "\\", "|": "|"}) for _, b in turns] == [t for _, _, t in talks[x["conv_id"]]]
        said = [x["perspective"] if h == "assistant" else unescaped(h.removeprefix("user name="), names) for h, _ in turns]
        assert said == [role for _, role, _ in talks[x["conv_id"]]]


# ---- 5


@pytest.mark.parametrize("digest", [dedup.sha256, lambda c: F.crc32(c) % 3])
def test_exact_dedup(spark, edge, empty, digest):
    rows = [r[:2] for r in EDGE] + [(20, "a b"), (21, "ab"), (22, "a\x0bb "), (23, "a b"), (24, "aB")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in CLASHES}).repartition(3)
    groups = collections.defaultdict(list)
    norm = lambda x: re.sub(r"[\x20\x09-\x0d]", "", x or "")
    for i, x in rows:
        groups[norm(x)].append((-len(x or ""), i is None, i or 0, i))
    expected, kept = [], set()  # of equal texts one row is kept: the best, and of equal best rows any one
    for i, x in rows:
        own = groups[norm(x)]
        best = (-len(x or ""), i is None, i or 0, i) == min(own) and norm(x) not in kept
        kept |= {norm(x)} if best else set()
        expected.append((repr(i), repr(min(own)[3]), len(own), best, hashlib.sha256(norm(x).encode()).hexdigest()))
    expected.sort()
    got = sorted((repr(r["doc_id"]), repr(r["keep_id"]), r["group_size"], r["kept"], r["text_sha256"]) for r in dedup.exact_dedup(docs, digest).collect())
    assert got == expected
    assert dedup.exact_dedup(empty, digest).count() == 0


@pytest.mark.parametrize("least_bytes", [None, 0])
def test_filters_of_runs(spark, monkeypatch, least_bytes):
    """Entries that several runs hold are met, few others are, and merging without filters gives the same level."""
    own = [(r, f"{r}-{i}", 1) for r in range(5) for i in range(4000)]
    both = [(r, f"copy {i}", 1) for i in range(300) for r in (i % 5, (i + 1 + i % 3) % 5)]
    rows = [*own, *both, (2, "twice in one run", 2)]
    runs = common.scratch(spark.createDataFrame(rows, "run int, digest string, rows long").withColumn("best", F.struct(F.col("run").alias("less"))), "run", ["run"])
    if least_bytes is not None:
        monkeypatch.setattr(dedup, "FILTER_BYTES", least_bytes)
    entries = dedup.shared_by_runs(runs)
    met = {(r["run"], r["digest"]) for r in entries.collect()}
    assert met >= {(r, d) for r, d, _ in both} | {(2, "twice in one run")}
    assert len(met) == len(rows) if least_bytes == 0 else len(met) < 601 + 0.02 * len(own)
    level = {r["digest"]: (r["best"]["less"], r["rows"]) for r in dedup.compact(entries).where("rows > 1").collect()}
    assert level == {f"copy {i}": (min(i % 5, (i + 1 + i % 3) % 5), 2) for i in range(300)} | {"twice in one run": (2, 2)}


# ---- 6


def classes(rows, percent=80):
    def sets(x):
        w = re.findall(r"[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in x or ""))
        return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    s = [(i, sets(x)) for i, x in rows]
    up = {i: i for i, _ in s}

    def root(i):
        return i if up[i] == i else root(up[i])

    for a, (i, x) in enumerate(s):
        for j, y in s[:a]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((root(i), root(j)))
                up[q] = p
    return {i: (len(x), root(i)) for i, x in s}


def test_jaccard(spark, edge, empty):
    rows = [(i, x) for i, x, *_ in EDGE if i is not None and i != 8] + [(8, EDGE[7][1])]
    for g in range(12):  # groups of near copies at and around the bound
        own = prose(60 + 25 * g, 100 + g).split()
        for c in range(7):
            r = random.Random(g * 100 + c)
            w = list(own)
            for _ in range(r.randint(0, len(w) // 25)):
                w[r.randrange(len(w))] = r.choice(VOCABULARY)
            rows.append((1000 + g * 10 + c, " ".join(w[r.randint(0, 3) :])))
    passage = prose(60, 999)
    rows += [(2000 + i, prose(40, 3000 + i) + " " + passage + " " + prose(40, 4000 + i)) for i in range(150)]  # one passage, no links
    rows += [(3000 + i, " ".join(prose(900, 55).split()[: 880 + i % 20])) for i in range(30)]
    expected = classes(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(docs).collect()}
    assert got == expected
    assert len({c for _, c in expected.values()}) < len(rows) - 50
    odd = jaccard.jaccard_components(edge).collect()
    assert len(odd) == len(EDGE)
    assert {r["component_id"] for r in odd if r["doc_id"] is None} == {None}
    assert {r["doc_id"]: r["component_id"] for r in odd if r["doc_id"] in (1, 2, 3, 8)} == {1: 1, 2: 2, 3: 3, 8: 5}
    assert jaccard.jaccard_components(empty).count() == 0


def test_long_versions_of_spread_sizes(spark):
    own = [prose(40, 600 + i) for i in range(40)]
    rows = [(0, " ".join(own))]
    for i in range(1, 150):  # each leaves out up to 12 paragraphs: all meet in the same cells, the shortest is far from the whole
        gone = random.Random(i).sample(range(40), 1 + i % 12)
        rows.append((i, " ".join(x for k, x in enumerate(own) if k not in gone)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(docs).collect()}
    assert got == classes(rows)


def test_large_component_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 8)
    own = prose(200, 77).split()
    rows = []
    for i in range(60):  # a chain: neighbours link, ends don't
        w = list(own)
        w[: 3 * i] = prose(3 * i, 500).split()
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(docs).collect()}
    assert got == classes(rows)


def test_large_cells_in_blocks(spark, monkeypatch):
    """Near copies, a passage that most texts are made of, and a few others, in cells of many blocks."""
    monkeypatch.setattr(jaccard, "CELL", 16)
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 16)
    own, passage, rows = prose(80, 71).split(), prose(60, 72), []
    for i in range(120):
        w = list(own)
        w[random.Random(i).randrange(80)] = f"edit{i}"
        rows.append((i, " ".join(w)))
    rows += [(200 + i, passage + " " + prose(12 + i % 9, 7300 + i // 2)) for i in range(120)]  # by twos alike, around the bound
    rows += [(400 + i, " ".join(own[: 60 + i])) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(docs).collect()}
    assert got == classes(rows)


def test_unlike_texts_of_one_form(spark, monkeypatch):
    """Texts that share most of a form and aren't alike for it are no candidates; those that are alike beside it are found."""
    monkeypatch.setattr(jaccard, "CELL", 16)
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 16)
    form, rows, members = prose(80, 81), [], []
    for i in range(300):
        rows.append((i, form + " " + prose(11 + i % 4, 8200 + i)))
    rows += [(400 + i, form + " " + prose(10, 8900 + i // 2) + f" end{i}") for i in range(40)]  # alike by twos
    rows += [(500 + i, prose(80, 82) + " " + prose(1 + i % 6, 9100 + i)) for i in range(40)]  # a form that suffices
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    plain = jaccard._linked
    monkeypatch.setattr(jaccard, "_linked", lambda docs, own, *rest: (members.append(own.count()), plain(docs, own, *rest))[1])
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(docs).collect()}
    assert got == classes(rows)
    assert len({c for _, c in got.values()}) > 300
    assert members[0] < 200


def test_signature_tree_matches_all_pairs():
    r = np.random.default_rng(5)
    sets = []
    for _ in range(60):
        own = r.integers(0, 1 << 62, 80)
        sets += [np.unique(np.where(r.random(80) < 0.06, r.integers(0, 1 << 62, 80), own)) for _ in range(6)]
    sets.sort(key=len)
    size = np.array([len(s) for s in sets])
    sig = np.zeros((len(sets), jaccard.SIGNATURE), np.uint8)
    for i, s in enumerate(sets):
        sig[i, s % jaccard.SIGNATURE] = 1
    packed = np.packbits(sig, axis=1).view(np.uint64)
    linked = lambda i, j: 100 * len(both := np.intersect1d(sets[i], sets[j])) >= 80 * (size[i] + size[j] - len(both))
    tree, plain = jaccard.Links(len(sets)), jaccard.Links(len(sets))
    jaccard.SignatureTree(size, packed, 80).link(linked, tree)
    for i in range(len(sets)):
        for j in range(i + 1, len(sets)):
            if linked(i, j):
                plain.join(i, j)
    assert (tree.roots() == plain.roots()).all()


# ---- 7


def shards_of(spark, rows, **options):
    """Rows by shard, after the promises that hold for any table."""
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in CLASHES}).repartition(4)
    got = sharding.kd_shards(docs, **options).collect()
    assert len(got) == len(rows)
    by_shard = collections.defaultdict(list)
    for x in got:
        by_shard[x["shard"]].append(x)
    assert all(sorted(x["slot"] for x in own) == list(range(len(own))) for own in by_shard.values())
    raw = lambda x: (x or "").encode()
    assert sorted((repr(x["doc_id"]), x["size"], x["text_crc32"]) for x in got) == sorted((repr(i), len(raw(x)) + 16, zlib.crc32(raw(x))) for i, x, *_ in rows)
    return by_shard


def balance(by_shard):
    total = [sum(x["size"] for x in own) for own in by_shard.values()]
    return len(total), min(total) * 40 / sum(total), max(total) * 40 / sum(total)


def test_sharding(spark, edge, empty):
    r = random.Random(1)
    some = [(i, "x" * r.randint(0, 400), r.choice(["en", "de", None]), r.choice(["a", "a", "b", None]), 1) for i in range(3000)]
    hot = [(5000 + i, "hot text " * 20, "en", "a", 1) for i in range(1500)]
    by_shard = shards_of(spark, some + hot + [(None, None, None, None, None)])
    n, least, most = balance(by_shard)
    assert (n, least > 0.85, most < 1.15) == (40, True, True)  # a point is up to an eighth of a shard here
    small = {x["text_crc32"]: s for s, own in by_shard.items() for x in own if x["doc_id"] is None or x["doc_id"] < 3000}
    assert all(small[x["text_crc32"]] == s for s, own in by_shard.items() for x in own if x["doc_id"] is not None and x["doc_id"] < 3000 and x["size"] < 300)
    for rows in ([(None, "hot text " * 20, "en", "a", 1)] * 1500 + some, [(7, "hot text " * 20, "en", "a", 1)] * 1500 + some, [(None, "same", None, None, None)] * 2000, [(i, prose(6, i), "en", "a", 1) for i in range(2000)]):
        n, least, most = balance(shards_of(spark, rows))
        assert n == 40
        assert least > 0.85
        assert most < 1.15
    assert sharding.kd_shards(edge).count() == len(EDGE)
    assert sharding.kd_shards(empty).count() == 0
    carried = sharding.kd_shards(edge, carry=edge.columns).select("carried.*")
    assert sorted(map(repr, carried.collect())) == sorted(map(repr, edge.collect()))


def test_tree_matches_a_plain_one(spark):
    """Cuts of the plain tree, over all points in memory, to within the share that a bin may be off by."""
    r = np.random.default_rng(3)
    keys = np.stack([(r.integers(0, m, 4000) << sharding.TIE_BITS) + r.integers(0, 1 << sharding.TIE_BITS, 4000) for m in (200, 5, 2)], 1)
    weight = r.integers(1, 100, 4000)
    points = spark.createDataFrame([(*map(int, k), int(w)) for k, w in zip(keys, weight)], "k0 long, k1 long, k2 long, bytes long")
    tree = sharding.grow(points, 8)
    level = keys >> sharding.TIE_BITS
    spread = np.maximum(1, np.ptp(level, axis=0))

    def walk(n, own, k):
        if k == 1:
            assert tree.left[n] < 0
            return
        wide = np.ptp(level[own], axis=0) / spread
        assert tree.dim[n] == int(np.argmax(wide))
        goes = keys[own, tree.dim[n]] >= tree.cut[n]
        want = weight[own].sum() * ((k + 1) // 2) / k
        assert abs(weight[own[~goes]].sum() - want) <= max(100, sharding.COARSE * want)
        walk(tree.left[n], own[~goes], (k + 1) // 2)
        walk(tree.right[n], own[goes], k // 2)

    walk(0, np.arange(4000), 8)
    assert sorted(s for s in tree.shard if s >= 0) == list(range(8))


# ---- 8


def test_token_counts(spark, edge, empty):
    docs = edge.repartition(3)
    coder = tokencount._encoding(tokencount.VOCABULARY)
    expected = sorted((repr(i), len(coder.encode_ordinary(x or ""))) for i, x, *_ in EDGE)
    for block in (1, 7, 1 << 18):
        if block == 1:
            docs = edge.where("doc_id <> 9 OR doc_id IS NULL")
            want = sorted((repr(i), len(coder.encode_ordinary(x or ""))) for i, x, *_ in EDGE if i != 9)
        else:
            docs, want = edge, expected
        assert sorted((repr(r["doc_id"]), r["n_tokens"]) for r in tokencount.count_tokens(docs, block=block).collect()) == want
    assert tokencount.count_tokens(empty).count() == 0


def test_separator_scan_of_flat_files(spark, tmp_path):
    r = np.random.default_rng(2)
    flat = r.integers(0, 50, 5000).astype(np.uint16)  # 0 separates
    flat[1000:1600] = 9
    flat.tofile(tmp_path / "a.bin")
    r.integers(1, 50, 300).astype(np.uint16).tofile(tmp_path / "b.bin")
    got = collections.defaultdict(list)
    for x in tokencount.scan_separators(tokencount.read_flat(tokencount.flat_files(spark, str(tmp_path)), block=64), end=0).orderBy("ordinal").collect():
        got[x["stream"][-5:]].append((x["n_tokens"], x["closed"]))
    at = np.flatnonzero(flat == 0)
    lengths = np.diff(np.concatenate(([-1], at))) - 1
    assert got["a.bin"] == [(int(n), True) for n in lengths] + ([(int(len(flat) - at[-1] - 1), False)] if at[-1] < len(flat) - 1 else [])
    assert got["b.bin"] == [(300, False)]


def test_long_texts_and_clashing_names_of_streams(spark):
    docs = spark.createDataFrame([(1, prose(40000, 3)), (2, "x")], "doc_id long, text string").withColumns({c: F.lit(1) for c in CLASHES})
    coder = tokencount._encoding(tokencount.VOCABULARY)
    got = {r["doc_id"]: r["n_tokens"] for r in tokencount.count_tokens(docs, block=16).collect()}
    assert got == {1: len(coder.encode_ordinary(prose(40000, 3))), 2: 1}


# ---- 9


def edited(text, seed, share):
    r, out = random.Random(seed), []
    for w in text.split():
        x = r.random()
        if x < share / 3:
            continue
        out.append(r.choice(VOCABULARY) if x < 2 * share / 3 else w)
        if x > 1 - share / 3:
            out.append(r.choice(VOCABULARY))
    return " ".join(out)


def test_decontamination(spark, edge, empty):
    items = [(i, prose(50, 7000 + i)) for i in range(20)] + [(100, None), (101, "two such words"), (None, "no id for this item at all"), (3, prose(50, 7003))]
    rows = []
    for i in range(20):
        clean = prose(300, 8000 + i)
        rows.append((i, clean, 0))
        words = clean.split()
        rows.append((100 + i, " ".join(words[:100]) + ". " + items[i][1].upper() + "! " + " ".join(words[100:]), 1))
        rows.append((200 + i, " ".join(words[:100] + edited(items[i][1], i, 0.2).split() + words[100:]), 1))
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").withColumns({c: F.lit(1) for c in CLASHES})
    got = decontam.decontaminate(docs, bench).collect()
    assert {r["doc_id"] for r in got} == {i for i, _, leak in rows if leak}
    text = {i: re.findall(r"\w+", x) for i, x, _ in rows}
    for r in got:
        if r["doc_id"] < 200:
            assert (r["item_id"], r["share"]) == (r["doc_id"] - 100, 1.0)
            assert " ".join(text[r["doc_id"]][r["first_word"] : r["last_word"]]).lower() == items[r["item_id"]][1]
    assert decontam.decontaminate(edge, bench).count() == 0
    assert decontam.decontaminate(empty, bench).count() == 0
    assert decontam.decontaminate(docs, bench.limit(0)).count() == 0


def test_decontamination_of_a_passage_in_hundreds_of_documents(spark):
    items = [(1, prose(50, 7100)), (2, prose(50, 7101))]
    parts = edited(items[0][1], 3, 0.2), " ".join(items[1][1].split()[:22])  # less than half of the 4-grams of each
    rows = [(i, prose(60, 8100 + i) + " " + parts[i % 2] + " " + prose(60, 8600 + i)) for i in range(400)]
    rows += [(1000 + i, prose(60, 9100 + i) + " " + " ".join(items[0][1].split()[10:15]) + " " + prose(60, 9400 + i)) for i in range(200)]  # too little
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = decontam.decontaminate(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in got) == [(i, 1 + i % 2) for i in range(400)]


def test_decontamination_by_a_passage_that_items_share(spark):
    text = prose(60, 7200)
    items = [(i, text + " " + prose(20, 7201 + i)) for i in range(5)] + [(9, prose(50, 7299))]
    rows = [(i, prose(60, 9800 + i) + " " + text + " " + prose(60, 9900 + i)) for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = decontam.decontaminate(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in got) == [(d, i) for d in range(3) for i in range(5)]


def test_decontamination_of_adjacent_repeats(spark):
    item = prose(50, 7300)
    docs = spark.createDataFrame([(r, " ".join([prose(60, 7301), *[item] * r, prose(60, 7302)])) for r in (1, 2, 7, 300)], "doc_id long, text string")
    got = decontam.decontaminate(docs, spark.createDataFrame([(1, item), (2, prose(50, 7303))], "item_id long, text string")).collect()
    found = sorted((r["doc_id"], r["first_word"], r["last_word"], r["share"]) for r in got)
    assert found == [(r, 60 + 50 * k, 110 + 50 * k, 1.0) for r in (1, 2, 7, 300) for k in range(r)]


def test_short_items_are_found_whole(spark):
    items = spark.createDataFrame([(1, "Two words"), (2, "solo"), (3, "..."), (4, "one two three"), (5, "two words")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "has two, WORDS two words here"), (2, "solo solo sol o"), (3, "two three words"), (4, "one two three two words"), (5, None)], "doc_id long, text string")
    got = sorted((r["doc_id"], r["item_id"], r["first_word"], r["last_word"], r["share"]) for r in decontam.decontaminate(docs, items).collect())
    assert got == [(1, 1, 1, 3, 1.0), (1, 1, 3, 5, 1.0), (1, 5, 1, 3, 1.0), (1, 5, 3, 5, 1.0), (2, 2, 0, 1, 1.0), (2, 2, 1, 2, 1.0), (4, 1, 3, 5, 1.0), (4, 4, 0, 3, 1.0), (4, 5, 3, 5, 1.0)]


def aligned(a, b):
    """Best local score of two word lists, by the plain table."""
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            h[i + 1][j + 1] = max(0, h[i][j] + (2 if x == y else -1), h[i][j + 1] - 1, h[i + 1][j] - 1)
    return max(map(max, h))


def test_decontamination_matches_aligning_everything(spark):
    """Every item against every text: all flagged have the score, and none is missed that has it with four words in a row."""
    items = [(i, prose(12 + 3 * i, 7600 + i)) for i in range(8)]
    rows = []
    for i in range(60):
        w = prose(80, 7700 + i).split()
        part = edited(items[i % 8][1], i, 0.1 * (i % 6)).split()
        rows.append((i, " ".join(w[:30] + part[: len(part) * (i % 5 + 1) // 5] + w[30:])))
    expected, score = set(), {}
    for d, text in rows:
        b = text.split()
        runs = {tuple(b[k : k + 4]) for k in range(len(b) - 3)}
        for i, item in items:
            a = item.split()
            score[d, i] = aligned(a, b)
            if any(tuple(a[k : k + 4]) in runs for k in range(len(a) - 3)) and score[d, i] >= min(0.4 * 2 * len(a), 50):
                expected.add((d, i))
    counts = {(d, i) for (d, i), x in score.items() if x >= min(0.4 * 2 * len(items[i][1].split()), 50)}
    got = decontam.decontaminate(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    found = {(r["doc_id"], r["item_id"]) for r in got}
    assert expected <= found <= counts
    assert len(found) >= 0.97 * len(counts)
    best = {k: max(r["score"] for r in got if (r["doc_id"], r["item_id"]) == k) for k in found}
    assert all(best[k] == score[k] for k in found)
    assert 20 < len(expected) < 60


@pytest.mark.parametrize("share", [0.2, 0.3])
def test_recall_of_edited_copies_of_short_and_long_items(spark, share):
    """200 items each of 8, 12, 20 and 40 words, edited inside other text: of the copies whose score counts, nearly all are
    found, and of all copies nine in ten."""
    sizes = {n: [(n * 1000 + i, prose(n, 1_000_000 + n * 1000 + i)) for i in range(200)] for n in (8, 12, 20, 40)}
    items = [x for own in sizes.values() for x in own]
    rows = [(i, prose(40, 60_000 + i) + " " + edited(x, 70_000 + i, share) + " " + prose(40, 80_000 + i)) for i, x in items]
    got = decontam.decontaminate(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    found = {(r["doc_id"], r["item_id"]) for r in got.collect()}
    text = dict(rows)
    for n, own in sizes.items():
        counts = [i for i, x in own if aligned(x.split(), text[i].split()) >= decontam.needed(n)]
        recall, all_copies = len([i for i in counts if (i, i) in found]) / len(counts), len([i for i, _ in own if (i, i) in found]) / 200
        print(f"{n} words, {share}: {recall:.3f} of {len(counts)} that count, {all_copies:.3f} of all copies")
        assert recall >= 0.97
        assert all_copies >= 0.9
    assert all(d == i for d, i in found)


def test_many_items_of_one_stem(spark):
    """Items that share a stem of half their words: a text with the stem alone, at 0.5 of their score, is a passage of each;
    one with a third of it of none. Two items are found by their own words, beside the stem's."""
    stem = prose(10, 7900)
    items = [(i, stem + " " + prose(10, 20_000 + i)) for i in range(300)]
    third = " ".join(stem.split()[:4])
    rows = [(1, prose(50, 7901) + " " + third + " " + prose(50, 7902)), (2, prose(50, 7903) + " " + stem + " " + prose(50, 7904)), (3, prose(50, 7905) + " " + third + " " + " ".join(items[7][1].split()[11:]) + " " + prose(30, 7906))]
    got = decontam.decontaminate(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == {(2, i) for i in range(300)} | {(3, 7)}


def test_the_benchmark_is_joined_not_sent(spark):
    """No part of the plan holds items: the query over written tables is joins and one alignment, whatever their number."""
    items = spark.createDataFrame([(i, prose(30, 30_000 + i)) for i in range(50)], "item_id long, text string")
    docs = spark.createDataFrame([(1, prose(50, 1)), (2, prose(30, 30_001))], "doc_id long, text string")
    got = decontam.decontaminate(docs, items)
    assert len(re.findall("MapInArrow", got._jdf.queryExecution().optimizedPlan().toString())) == 1
    assert [(r["doc_id"], r["item_id"]) for r in got.collect()] == [(2, 1)]


@pytest.mark.parametrize(("share", "least"), [(0.1, 1.0), (0.2, 0.95), (0.3, 0.9), (0.4, 0.5)])
def test_recall_of_edited_copies(spark, share, least):
    """Items of 40 words with so many words left out, replaced or added, inside other text."""
    items = [(i, prose(40, 7800 + i)) for i in range(150)]
    rows = [(i, prose(50, 8900 + i) + " " + edited(x, 900 + i, share) + " " + prose(50, 9300 + i)) for i, x in items]
    got = decontam.decontaminate(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    found = {(r["doc_id"], r["item_id"]) for r in got.collect()}
    recall = len([i for i in range(150) if (i, i) in found]) / 150
    print(f"recall at {share}: {recall:.3f}")
    assert recall >= least
    assert all(d == i for d, i in found)


def test_alignment_matches_a_plain_table():
    r = np.random.default_rng(4)
    pairs = [(r.integers(0, 6, r.integers(1, 20)).astype(np.uint64) + 2, r.integers(0, 6, r.integers(1, 30)).astype(np.uint64) + 2) for _ in range(50)]

    def plain(a, b):
        h = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                h[i + 1, j + 1] = max(0, h[i, j] + (2 if a[i] == b[j] else -1), h[i, j + 1] - 1, h[i + 1, j] - 1)
        return h.max()

    for (a, b), (score, begin, end) in zip(pairs, decontam.align(pairs)):
        assert score == plain(a, b)
        assert score == plain(a, b[begin:end])


# ---- 10


def test_mixing(spark, edge, empty):
    rows = [(i, prose(5 + i % 30, i), "en", "big" if i % 4 else f"s{i % 12}", 1) for i in range(800)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in CLASHES})
    tokens = collections.Counter()
    for _, x, _, s, _ in rows:
        tokens[s] += len(x.split())
    share = {s: n / sum(tokens.values()) for s, n in tokens.items()}

    def entropy(e):
        w = np.array([v**e for v in share.values()])
        w /= w.sum()
        return -(w * np.log(w)).sum()

    shares = spark.createDataFrame([(s, v) for s, v in share.items()], "source string, share double")
    e = mixing.find_exponent(shares, 0.9, 1e9)
    assert entropy(e) >= 0.9 * np.log(len(share)) - 1e-9
    assert entropy(e + 1e-4) < 0.9 * np.log(len(share))
    limited = mixing.find_exponent(shares, 0.9, 1.2)
    assert (max(share.values()) / min(share.values())) ** (1 - limited) == pytest.approx(1.2)
    draws = mixing.draw_mix(docs, 0.9, 3.0, block_tokens=200).collect()
    e = mixing.find_exponent(shares, 0.9, 3.0)
    weight = {s: v**e for s, v in share.items()}
    got, seen = collections.Counter(), collections.Counter()
    for r in draws:
        got[r["source"]] += r["n_tokens"]
        seen[r["doc_id"], r["pass"]] += 1
    assert max(seen.values()) == 1
    assert {i for i, _ in seen} == set(range(800))  # every row is shown
    assert mixing.mix_sources(docs, entropy=0.9, repeats=3.0).columns == docs.columns
    for s in share:
        assert got[s] / got["big"] == pytest.approx(weight[s] / weight["big"], rel=0.06)
    again = mixing.draw_mix(docs, 0.9, 3.0, block_tokens=200).collect()
    assert sorted(map(tuple, draws), key=repr) == sorted(map(tuple, again), key=repr)
    assert mixing.mix_sources(docs, entropy=0.9, repeats=3.0, block_tokens=200).count() == len(draws)
    half = sum(r["n_tokens"] for r in mixing.draw_mix(docs, budget=sum(tokens.values()) / 2).collect())
    assert half == pytest.approx(sum(tokens.values()) / 2, rel=0.1)
    assert mixing.mix_sources(edge).select("doc_id").distinct().count() == len({r[0] for r in EDGE})
    assert mixing.draw_mix(empty).count() == 0


def test_drawn_blocks_match_a_plain_pass(spark):
    rows = [(i if i % 50 else None, prose(3 + i % 9, i % 290), "en", (None, "s", "tt", "tt", "tt", "u", "u")[i % 7], 1) for i in range(600)]
    docs = spark.createDataFrame(rows, SCHEMA)
    for budget in (None, 1500.0):
        drawn = mixing.draw_mix(docs, 0.97, 4.0, block_tokens=100, budget=budget).collect()
        groups, size = collections.Counter(), {}
        for x in docs.select(mixing.row_key().alias("key"), "doc_id", "source", "text").collect():
            groups[x["key"], x["doc_id"], x["source"]] += 1
            size[x["key"]] = max(1, len(x["text"].split()))
        tokens = collections.Counter()
        for (key, _, source), copies in groups.items():
            tokens[source] += copies * size[key]
        total = sum(tokens.values())
        share = {s: n / total for s, n in tokens.items()}
        e = mixing.find_exponent(spark.createDataFrame(list(share.items()), "source string, share double"), 0.97, 4.0)
        norm = sum(v**e for v in share.values())
        spend = budget or max(v ** (1 - e) for v in share.values()) * norm * total
        want = []
        for source, n in tokens.items():
            passes = share[source] ** e / norm * spend / n
            passes = round(passes) if abs(passes - round(passes)) < 1e-9 else passes
            own = spark.createDataFrame([(k,) for (k, _, s) in groups if s == source], "key long").distinct()
            for p in range(math.ceil(passes)):
                order = own.select("key", F.pmod(F.xxhash64("key", F.lit(p).cast("long"), F.lit("block")), F.lit(-(-n // 100))).alias("block"), F.xxhash64("key", F.lit(p).cast("long")).alias("rank")).collect()
                spent, place = 0, collections.Counter()
                for x in sorted(order, key=lambda x: (x["block"], x["rank"], x["key"])):
                    if spent < (passes - p) * n:
                        want.append((x["key"], source, p, x["block"], place[x["block"]]))
                    place[x["block"]] += 1
                    spent += size[x["key"]] * sum(c for (k, _, s), c in groups.items() if (k, s) == (x["key"], source))
        assert sorted(want, key=repr) == sorted(((x["key"], x["source"], x["pass"], x["block"], x["pos"]) for x in drawn), key=repr)


def test_spending_by_bands(spark):
    r = random.Random(5)
    rows = [(s, p, b, r.randrange(100)) for s in (None, "a") for p in range(2) for b in r.sample(range(60), 40)]
    got = mixing.spent_before(spark.createDataFrame(rows, "source string, pass int, block long, spent long"), band_blocks=7).collect()
    assert len(got) == len(rows)
    for x in got:
        assert x["before"] == sum(n for s, p, b, n in rows if (s, p) == (x["source"], x["pass"]) and b < x["block"])
