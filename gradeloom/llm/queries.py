"""The operators' queries over the driver's tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.llm import pipeline
from gradeloom.llm.chat import rotate_perspectives
from gradeloom.llm.common import let
from gradeloom.llm.decontam import decontaminate
from gradeloom.llm.dedup import exact_dedup
from gradeloom.llm.jaccard import jaccard_components
from gradeloom.llm.language import identify_language
from gradeloom.llm.lexical import search_lexical
from gradeloom.llm.mixing import draw_mix
from gradeloom.llm.quality import graded, score_quality, train_quality
from gradeloom.llm.runs import find_runs
from gradeloom.llm.secrets import RULES, scan_secrets
from gradeloom.llm.sharding import kd_shards
from gradeloom.llm.simhash import simhash_components
from gradeloom.llm.tokencount import count_tokens


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_language(_table(spark, sf_dir, "documents"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(_table(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return score_quality(docs, train_quality(docs, graded(_table(spark, sf_dir, "labels"))))


def op4_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotate_perspectives(_table(spark, sf_dir, "conversations"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_table(spark, sf_dir, "documents"))


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(_table(spark, sf_dir, "documents")).drop("text_key")


def op7_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kd_shards(_table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(_table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return draw_mix(_table(spark, sf_dir, "documents")).drop("key")


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search_lexical(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def periodic_tails(docs: DataFrame) -> DataFrame:
    """(doc_id, text) where one text in ten goes on periodically from a word on: h = crc32 of the decimal doc_id, g = h div
    10; if h % 10 = 0, each word i >= a is the original word a + (i - a) % p. A text without doc_id stays as it is."""

    def tail(words: Column) -> Column:
        n = F.size(words)
        a = (F.col("g") % n).cast("int")
        p = 1 + F.floor((n - a) / (3 + F.col("g") % 8)).cast("int")
        turned = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(words, F.when(i >= a, a + (i - a) % p).otherwise(i)))
        return F.when(n > 0, F.array_join(turned, " ")).otherwise("")

    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    turned = F.when(F.col("text").isNotNull() & (F.col("h") % 10 == 0), let(words, tail)).otherwise(F.col("text"))
    return docs.select(F.col("doc_id").cast("long"), "text").withColumn("h", h).withColumn("g", F.floor(F.col("h") / 10)).select("doc_id", turned.alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_runs(periodic_tails(_table(spark, sf_dir, "documents")))
    none = F.lit(None).cast("struct<start:long,length:long,period:long>")
    best = F.aggregate("runs", none, lambda top, x: F.when(top.isNull() | (x["length"] * top["period"] > top["length"] * x["period"]), x).otherwise(top))
    lines = F.array_join(F.transform("runs", lambda x: F.concat_ws(",", x["start"], x["length"], x["period"])), "\n")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), *(F.col("best")[c].alias(c) for c in ("start", "length", "period")), F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.concat(lines, F.when(F.size("runs") > 0, "\n").otherwise("")).cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_components(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_language_id, op2_secret_scan, op3_quality, op4_chat_rotation, op5_exact_dedup, op6_ngram_jaccard, op7_kd_sharding, op8_token_counts, op9_decontamination, op10_mixing, op11_lexical_search, op12_periodic_runs, op13_simhash)
    return {f.__name__: f for f in own} | {"pipeline": pipeline.run}


def _spans_sql() -> tuple[str, str]:
    """A list of {start, kind, end} for each rule, as SELECT items, and the items' names."""
    items = []
    for i, r in enumerate(RULES):
        pattern = r.pattern.replace("'", "''")
        whole = f"({pattern})" if not pattern.startswith("(?i)") else f"(?i)({pattern[4:]})"
        group = f"regexp_extract_all(t, '{pattern}', {r.group})" if r.group else f"regexp_extract_all(t, '{whole}', 1)"
        items.append(
            f"""(SELECT coalesce(list({{'s': a.s, 'k': {i}, 'e': a.s + length(a.w)}} ORDER BY a.s), []) FROM (
              SELECT w, g, sum(length(gap)) OVER (ORDER BY i) + coalesce(sum(length(w)) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s
              FROM (SELECT unnest(regexp_extract_all(t, '{whole}', 1)) AS w, unnest({group}) AS g,
                           unnest((string_split_regex(t, '{pattern}'))[1:len(regexp_extract_all(t, '{whole}', 1))]) AS gap,
                           generate_subscripts(regexp_extract_all(t, '{whole}', 1), 1) AS i)) a
              WHERE length(a.g) >= {r.least}) AS s_{r.kind}"""
        )
    return ",\n".join(items), "s_" + ", s_".join(r.kind for r in RULES)


def _secrets_sql() -> str:
    items, _ = _spans_sql()
    kinds = "[" + ", ".join(f"'{r.kind}'" for r in RULES) + "]"
    text = lambda lists: f"array_to_string(list_transform(list_sort({lists}), lambda x: {kinds}[x.k + 1] || ':' || x.s || ':' || x.e), ',')"
    base, every = (" || ".join(f"s_{r.kind}" for r in rules) for rules in (RULES[:3], RULES))
    counts = ", ".join(f"len(s_{r.kind}) AS n_{r.kind}" for r in RULES)
    return f"""SELECT doc_id, {counts}, sha256({text(base)}) AS base_sha256, {text(every)} AS spans
        FROM (SELECT doc_id, {items} FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents))"""


_DEDUP = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm FROM documents),
g AS (SELECT norm, count(*) AS n, first(doc_id ORDER BY chars DESC, doc_id) AS keep FROM d GROUP BY norm)
SELECT doc_id, keep AS keep_id, n AS group_size, doc_id = keep AS kept, sha256(norm) AS text_sha256 FROM d JOIN g USING (norm)
"""

_JACCARD = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * c >= 80 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(b) AS c FROM r GROUP BY a) m ON m.a = d.doc_id
"""

_CHAT = r"""
WITH t AS (SELECT conv_id, role, turn, coalesce(text, '') AS text FROM conversations),
p AS (SELECT DISTINCT conv_id, role AS perspective FROM t WHERE role IS DISTINCT FROM 'system'),
x AS (SELECT p.conv_id, perspective, row_number() OVER (PARTITION BY p.conv_id, perspective ORDER BY turn NULLS LAST, role NULLS FIRST, text) AS i, role IS NOT DISTINCT FROM perspective AS own,
        CASE WHEN role = 'system' THEN '<|system|>' WHEN role IS NOT DISTINCT FROM perspective THEN '<|assistant|>' WHEN role IS NULL THEN '<|user|>'
          ELSE '<|user name=' || replace(replace(replace(replace(replace(role, '\', '\\'), '|', '\p'), '<', '\l'), chr(10), '\n'), chr(13), '\r') || '|>' END || chr(10) AS tag,
        replace(replace(text, '\', '\\'), '<|', '<\|') || '<|end|>' || chr(10) AS body FROM p JOIN t ON p.conv_id = t.conv_id),
y AS (SELECT *, coalesce(sum(length(tag) + length(body)) OVER (PARTITION BY conv_id, perspective ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(tag) AS s FROM x)
SELECT conv_id, perspective, count(*) AS n_turns, count(*) FILTER (own) AS n_spoken, string_agg(tag || body, '' ORDER BY i) AS text,
  coalesce(string_agg(CAST(s AS BIGINT) || ':' || CAST(s + length(body) AS BIGINT), ',' ORDER BY i) FILTER (own), '') AS mask,
  CAST(sum(CASE WHEN own THEN length(body) ELSE 0 END) AS BIGINT) AS masked_chars
FROM y GROUP BY conv_id, perspective
"""

_LEXICAL = r"""
WITH t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
s AS (SELECT count(*) FILTER (len(w) > 0) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_terms FROM t),
d AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n, unnest(w) AS term FROM t),
p AS (SELECT doc_id, term, any_value(n) AS n, count(*) AS tf FROM d GROUP BY doc_id, term),
v AS (SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * n_docs + 2) / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM p, s GROUP BY term, n_docs),
q AS (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
k AS (SELECT item_id, term, count(*) AS times FROM q GROUP BY item_id, term),
x AS (SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * n_docs) // n_terms)))) AS BIGINT) AS score
      FROM k JOIN v USING (term) JOIN p USING (term), s GROUP BY item_id, doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS i FROM x WHERE score > 0)
SELECT item_id, CAST(i AS INTEGER) AS rank, doc_id, score FROM r WHERE i <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_secret_scan": _secrets_sql(), "op4_chat_rotation": _CHAT, "op5_exact_dedup": _DEDUP, "op6_ngram_jaccard": _JACCARD, "op11_lexical_search": _LEXICAL}
