"""Temperature mixing of sources.

A source's weight is its token share to an exponent, normalised. The exponent is bisected to the largest one whose
weights reach a target entropy, and raised again where the most repeated source would exceed the repetition limit. The
weights are realised as budgeted block permutations: each pass over a source deals its rows into blocks anew, in a new
order, and the budget is spent block by block, the last block row by row.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gradeloom.llm.common import scratch, text_or_empty

#: Share of the greatest possible entropy, most passes over a source, tokens in a block.
ENTROPY, REPEATS, BLOCK_TOKENS = 0.9, 1.5, 1_000_000
GRID = 33
BAND_BLOCKS = 1024  # that one window sums up
WORD = r"[^\x20\x09-\x0D]+"


def _entropies(shares: DataFrame, exponents: list[float]) -> list[float]:
    """Entropy of the weights for each exponent, from sums over the sources."""
    log = F.log("share")
    sums = [f for e in exponents for f in (F.sum(F.exp(e * log)), F.sum(F.exp(e * log) * log))]
    row = shares.agg(*(s.alias(str(i)) for i, s in enumerate(sums))).first()
    return [math.log(row[2 * i]) - e * row[2 * i + 1] / row[2 * i] for i, e in enumerate(exponents)]


def find_exponent(shares: DataFrame, entropy: float = ENTROPY, repeats: float = REPEATS) -> float:
    """The exponent for ``shares`` (one row per source: share > 0), to 1/32,768: each pass over them tries 33 at once.

    0 gives equal weights, 1 the shares themselves. With a budget that shows every row, the most repeated source is seen
    (largest share / smallest share) ^ (1 - exponent) times."""
    n, low, high = shares.agg(F.count("*"), F.min("share"), F.max("share")).first()
    if n < 2:
        return 1.0
    lo, hi = 0.0, 1.0
    for _ in range(3):
        tried = [lo + (hi - lo) * i / (GRID - 1) for i in range(GRID)]
        reached = [e for e, h in zip(tried, _entropies(shares, tried)) if h >= entropy * math.log(n) - 1e-12]
        best = max(reached, default=tried[0])
        lo, hi = best, min(hi, best + (hi - lo) / (GRID - 1))
    spread = math.log(high / low)
    limit = 1 - math.log(repeats) / spread if spread > 0 else 0.0
    return min(1.0, max(lo, limit))


def spent_before(per_block: DataFrame, band_blocks: int = BAND_BLOCKS) -> DataFrame:
    """Adds ``before``, what a pass spends on the blocks before: summed by bands of blocks and then inside a band, so that no
    window holds all blocks of a large source."""
    banded = per_block.withColumn("band", F.floor(F.col("block") / band_blocks))
    earlier = lambda w: F.coalesce(F.sum("spent").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bands = banded.groupBy("source", "pass", "band").agg(F.sum("spent").alias("spent"))
    bands = bands.select(F.struct("source", "pass", "band").alias("at"), earlier(Window.partitionBy("source", "pass").orderBy("band")).alias("in_bands"))
    inside = banded.withColumn("inside", earlier(Window.partitionBy("source", "pass", "band").orderBy("block")))
    found = inside.join(bands, F.struct("source", "pass", "band") == F.col("at"))
    return found.withColumn("before", F.col("in_bands") + F.col("inside")).drop("at", "in_bands", "inside", "band")


def draw_mix(docs: DataFrame, entropy: float = ENTROPY, repeats: float = REPEATS, block_tokens: int = BLOCK_TOKENS, budget: float | None = None) -> DataFrame:
    """One row per drawn row: key, doc_id, source, n_tokens, copies, pass, block, pos.

    ``docs`` has doc_id, text, source; tokens are runs without white space, and a row counts as one at least. ``budget``
    is in tokens; without one it is the least that shows every row of every source. key is ``row_key`` of the row; rows
    that repeat exactly are drawn together, ``copies`` says how many. pos counts from 0 in a block. A null source is a
    source, a null text is empty, an empty table draws nothing.
    """
    tokens = F.greatest(F.regexp_count(text_or_empty(), F.lit(WORD)), F.lit(1)).cast("long")
    rows = docs.select(row_key().alias("key"), "doc_id", "source", tokens.alias("n_tokens"))
    rows = scratch(rows.groupBy("key", "doc_id", "source", "n_tokens").agg(F.count("*").alias("copies")), "mix-rows")
    cost = F.col("n_tokens") * F.col("copies")
    sources = rows.groupBy("source").agg(F.sum(cost).alias("tokens"))
    total = sources.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    shares = scratch(sources.withColumn("share", F.col("tokens") / F.lit(max(1, total))), "mix-shares")
    exponent = find_exponent(shares, entropy, repeats)
    norm, cover = shares.agg(F.sum(F.pow("share", F.lit(exponent))), F.max(F.pow("share", F.lit(1 - exponent)))).first()
    spend = budget if budget is not None else (norm or 0) * (cover or 0) * total
    passes = F.col("weight") * spend / F.col("tokens")
    plan = shares.withColumn("weight", F.pow("share", F.lit(exponent)) / F.lit(norm or 1.0)).withColumn("passes", F.when(F.abs(passes - F.round(passes)) < 1e-9, F.round(passes)).otherwise(passes))
    plan = plan.select(F.col("source").alias("s"), "tokens", "passes", F.ceil(F.col("tokens") / block_tokens).alias("blocks"))
    seen = rows.join(plan, F.col("source").eqNullSafe(F.col("s"))).where("passes > 0")
    seen = seen.withColumn("pass", F.explode(F.sequence(F.lit(0), F.ceil("passes") - 1)))
    block = F.pmod(F.xxhash64("key", "pass", F.lit("block")), F.col("blocks"))
    dealt = seen.select("key", "doc_id", "source", "n_tokens", "copies", "pass", block.alias("block"), F.xxhash64("key", "pass").alias("rank"), ((F.col("passes") - F.col("pass")) * F.col("tokens")).alias("left"))
    # blocks of a source come in the order of their number, which the hash of a pass deals anew
    per_block = scratch(dealt.groupBy("source", "pass", "block").agg(F.sum(cost).alias("spent"), F.first("left").alias("left")), "mix-blocks")
    per_block = spent_before(per_block).where(F.col("before") < F.col("left"))
    own = Window.partitionBy("source", "pass", "block").orderBy("rank", "key")
    paid = F.coalesce(F.sum(cost).over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = dealt.drop("left").withColumn("paid", paid).withColumn("pos", F.row_number().over(own) - 1)
    same = placed["source"].eqNullSafe(per_block["source"]) & (placed["pass"] == per_block["pass"]) & (placed["block"] == per_block["block"])
    kept = placed.join(per_block.select("source", "pass", "block", "before", "left"), same).where(F.col("before") + F.col("paid") < F.col("left"))
    return kept.select("key", "doc_id", placed["source"], "n_tokens", "copies", placed["pass"], placed["block"], F.col("pos").cast("long").alias("pos"))


def row_key():
    return F.xxhash64("doc_id", "source", "text")


def mix_sources(docs: DataFrame, **options) -> DataFrame:
    """``docs`` as drawn: each row as often as its source's passes show it, with all its columns, whatever their names."""
    rows = docs.select(row_key().alias("key"), "doc_id", "source", F.struct("*").alias("row")).alias("r")
    draws = draw_mix(docs, **options).select("key", "doc_id", "source").alias("d")
    same = (F.col("r.key") == F.col("d.key")) & F.col("r.doc_id").eqNullSafe(F.col("d.doc_id")) & F.col("r.source").eqNullSafe(F.col("d.source"))
    return rows.join(draws, same).select("r.row").select("row.*")
