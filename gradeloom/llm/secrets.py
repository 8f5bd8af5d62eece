"""Secret scan over a trigram inverted index, with DataFrame functions only.

A Boolean trigram query is derived from each rule's regular expression: an OR of alternatives, each an AND of the
trigrams that every match of it must hold. The index has the postings of the trigrams that the queries ask for, over
texts with letters in lower case. Postings are intersected per alternative, and the rows that a rule is left with are
verified by its expression. A rule with an alternative that has no trigram scans every row. Candidates are looked up by
a bit filter, so that texts stay where they are read.
"""

from __future__ import annotations

import re._parser as parser
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeloom.llm.common import bit_filter, filter_bits, let, maybe_in, scratch, sums_before, text_or_empty


@dataclass(frozen=True)
class Rule:
    """A span is a match of ``pattern`` whose ``group`` has at least ``least`` code points."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


# The three base kinds, in the order in which spans that start together are listed. Runs of the second and
# third kind are as long as they can be, so asking for their least length within the expression gives the same spans.
BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
)
# Further kinds.
MORE = (
    Rule("pem", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("cloud", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
RULES = BASE + MORE
SPANS = "array<struct<start:int,kind:int,end:int>>"
SMALL_CLASS = 8  # a character class up to this size is written out


def _strings(items) -> list[list[str | None]]:
    """Alternatives of an expression, each a list of literal pieces; None is a gap of unknown text."""
    ways: list[list[str | None]] = [[]]
    for op, arg in items:
        name = str(op)
        if name == "LITERAL":
            own = [[chr(arg)]]
        elif name == "IN" and all(str(o) == "LITERAL" for o, _ in arg) and len(arg) <= SMALL_CLASS:
            own = [[chr(c)] for _, c in arg]
        elif name == "SUBPATTERN":
            own = _strings(arg[3])
        elif name == "BRANCH":
            own = [w for branch in arg[1] for w in _strings(branch)]
        elif name == "MAX_REPEAT" and arg[:2] == (0, 1):
            own = [[], *_strings(arg[2])]
        elif name == "MAX_REPEAT" and arg[0]:
            own = [[*w * arg[0], None] for w in _strings(arg[2])]
        else:
            own = [[None]]
        ways = [[*a, *b] for a, b in product(ways, own)]
    return ways


def trigram_query(pattern: str) -> list[list[str]]:
    """OR of ANDs of lower-case trigrams; an alternative without any means that the rule must scan fully."""
    found = []
    for way in _strings(parser.parse(pattern)):
        pieces = "".join("\0" if x is None else x for x in way).lower().split("\0")
        found.append(sorted({p[i : i + 3] for p in pieces for i in range(len(p) - 2)}))
    found = [list(x) for x in dict.fromkeys(map(tuple, found))]
    return [x for x in found if not any(set(y) < set(x) for y in found)] if all(found) else [[]]


def row_key() -> Column:
    """Of equal rows the same, and never null; rows that happen to share one are verified for each other's sake."""
    return F.xxhash64("doc_id", "text")


def postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """(trigram, key) for the given trigrams, which a list of rules bounds."""
    low = F.lower(F.col("text"))
    held = F.filter(F.array(*map(F.lit, trigrams)), lambda t: F.contains(F.col("low"), t))
    return docs.select(row_key().alias("key"), low.alias("low")).select(F.explode(held).alias("trigram"), "key")


def candidates(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame | None:
    """(key, kind): which rows may match which rules, by intersected postings; None if no rule has a query."""
    parts = [(r.kind, i, t, len(way)) for r in rules for i, way in enumerate(trigram_query(r.pattern)) for t in way]
    if not parts:
        return None
    need = docs.sparkSession.createDataFrame(parts, "kind string, way int, trigram string, need int")
    posted = postings(docs, sorted({p[2] for p in parts})).distinct()
    hit = posted.join(F.broadcast(need), "trigram").groupBy("key", "kind", "way").agg(F.count("*").alias("n"), F.first("need").alias("need"))
    return hit.where("n = need").select("key", "kind").distinct()


def _matches(rule: Rule, order: int) -> Column:
    """array<struct(start, kind order, end)> of the rule's spans in column ``text``, from the pieces between matches."""
    whole = F.regexp_extract_all("text", F.lit(f"({rule.pattern})" if not rule.pattern.startswith("(?i)") else f"(?i)({rule.pattern[4:]})"), F.lit(1)).alias("w")
    group = [F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(rule.group)).alias("g")] if rule.group else []
    between = F.transform(F.split("text", rule.pattern), F.length).alias("gap")  # and a last one, after all matches

    def span(x: Column, before: Column) -> Column:
        start = before + x["gap"]
        own = F.struct(start.alias("start"), F.lit(order).alias("kind"), (start + F.length(x["w"])).alias("end"))
        return F.when(F.length(x["g" if group else "w"]) >= rule.least, own)

    def spans(each: Column) -> Column:
        return F.array_compact(F.zip_with(each, sums_before(F.transform(each, lambda x: x["gap"] + F.length(x["w"]))), span))

    matches = F.filter(F.arrays_zip(whole, *group, between), lambda x: x["w"].isNotNull())
    return F.when(F.regexp_like("text", F.lit(rule.pattern)), let(matches, spans).cast(SPANS)).otherwise(F.array().cast(SPANS))


def _joined(spans: Column, rules: tuple[Rule, ...]) -> Column:
    kinds = F.array(*(F.lit(r.kind) for r in rules))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"], s["end"])), ",")


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, base: int = len(BASE)) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, a count n_<kind> for each rule, base_sha256, spans.

    Spans are kind:start:end by start, then in the rules' order; code points, end exclusive. Matches of one kind are
    leftmost and don't overlap; those of different kinds may. base_sha256 hashes the spans of the first ``base`` rules.
    A null text is empty; rows that repeat, or have no doc_id, are each scanned. Other columns are not read.
    """
    docs = docs.select("doc_id", text_or_empty().alias("text"))
    full = [r.kind for r in rules if trigram_query(r.pattern) == [[]]]
    asked = candidates(docs, tuple(r for r in rules if r.kind not in full))
    rows = docs.withColumn("key", row_key())
    if asked is None:
        rows = rows.withColumn("may", F.lit(False))
    else:
        asked = scratch(asked, "candidates")
        bits = filter_bits(asked.count())
        rows = maybe_in(rows, "key", scratch(bit_filter(asked, "key", bits), "filter"), "may", bits)
    none = F.array().cast(SPANS)
    for i, r in enumerate(rules):
        found = _matches(r, i)
        rows = rows.withColumn(f"s_{r.kind}", found if r.kind in full else F.when(F.col("may"), found).otherwise(none))
    every = [F.col(f"s_{r.kind}") for r in rules]
    return rows.select(
        "doc_id",
        *(F.size(c).cast("long").alias(f"n_{r.kind}") for r, c in zip(rules, every)),
        F.sha2(_joined(F.concat(*every[:base]), rules), 256).alias("base_sha256"),
        _joined(F.concat(*every), rules).alias("spans"),
    )
