"""Multi-party perspective rotation of dialogues, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeloom.llm.common import sums_before

END = "<|end|>\n"


def escaped(text: Column) -> Column:
    """Text in which no control token can begin. Reversible: a backslash is two of them, and ``<|`` has one inside."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


# What a name in a header must not hold, and what stands for it; the backslash comes first.
NAME_MARKS = (("\\", "\\\\"), ("|", "\\p"), ("<", "\\l"), ("\n", "\\n"), ("\r", "\\r"))


def escaped_name(name: Column) -> Column:
    """A name that can neither end its header nor begin another token; reversible as well."""
    for mark, instead in NAME_MARKS:
        name = F.replace(name, F.lit(mark), F.lit(instead))
    return name


def rotate_perspectives(turns: DataFrame, system_roles: tuple[str, ...] = ("system",)) -> DataFrame:
    """One row per (conversation, participant): conv_id, perspective, n_turns, n_spoken, text, mask, masked_chars.

    ``turns`` has conv_id, turn, role, text. A participant is a role of the conversation that is not in
    ``system_roles``. In a perspective the participant's turns are the assistant's, other participants' are
    ``user`` turns that carry their name, and system turns stay. Texts and names are escaped, reversibly. mask lists start:end of what is learnt (code points of
    text, end exclusive): the assistant's contents with their end tokens.

    Turns are in order of (turn, role, text), a null turn last and a null role first; a null role is a participant without
    a name (its perspective is null, its header ``<|user|>``), a null text empty; rows that
    repeat are turns of their own. Rows without conv_id are conversations of one turn each, and identical ones are one
    conversation. A conversation of system turns only has no row. A conversation is gathered as one row, as the result
    that it becomes; conversations share nothing, however many rows they have together.
    """
    alone = F.when(F.col("conv_id").isNull(), F.xxhash64("turn", "role", "text"))
    entry = F.struct(F.col("turn").isNull().alias("late"), F.col("turn").alias("turn"), F.col("role").alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    talks = turns.select("conv_id", alone.alias("alone"), entry.alias("entry")).groupBy("conv_id", "alone").agg(F.array_sort(F.collect_list("entry")).alias("turns"))
    system = lambda r: F.coalesce(r.isin(*system_roles), F.lit(False))
    names = F.array_sort(F.array_distinct(F.filter(F.transform("turns", lambda t: t["role"]), lambda r: ~system(r))))
    seen = talks.withColumn("perspective", F.explode(names))

    def tag(t: Column) -> Column:
        return (
            F.when(system(t["role"]), F.lit("<|system|>\n"))
            .when(t["role"].eqNullSafe(F.col("perspective")), F.lit("<|assistant|>\n"))
            .when(t["role"].isNull(), F.lit("<|user|>\n"))
            .otherwise(F.concat(F.lit("<|user name="), escaped_name(t["role"]), F.lit("|>\n")))
        )

    parts = F.transform("turns", lambda t: F.struct(tag(t).alias("tag"), F.concat(escaped(t["text"]), F.lit(END)).alias("body"), t["role"].eqNullSafe(F.col("perspective")).alias("own")))
    before = sums_before(F.transform("parts", lambda p: F.length(p["tag"]) + F.length(p["body"])))

    def span(p: Column, at: Column) -> Column:
        start = at + F.length(p["tag"])
        return F.when(p["own"], F.concat_ws(":", start, start + F.length(p["body"])))

    learnt = F.aggregate("parts", F.lit(0).cast("long"), lambda n, p: n + F.when(p["own"], F.length(p["body"])).otherwise(0))
    done = seen.withColumn("parts", parts).withColumn("spans", F.array_compact(F.zip_with("parts", before, span)))
    return done.select(
        "conv_id",
        "perspective",
        F.size("parts").cast("long").alias("n_turns"),
        F.size("spans").cast("long").alias("n_spoken"),
        F.array_join(F.transform("parts", lambda p: F.concat(p["tag"], p["body"])), "").alias("text"),
        F.array_join("spans", ",").alias("mask"),
        learnt.alias("masked_chars"),
    )
