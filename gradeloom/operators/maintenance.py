"""Row writes as batch operators: upserts, patches, cascades, key audits and schema changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``new`` are inserted where their key is absent; else their non-null fields overwrite."""
    fields = [c for c in old.columns if c != key]
    n = new.select(key, *(F.col(c).alias(f"new_{c}") for c in fields))
    return old.join(n, key, "full").select(key, *(F.coalesce(f"new_{c}", c).alias(c) for c in fields))


def patch(rows: DataFrame, patches: DataFrame, key: str, fields: list[str], seq: str = "seq") -> DataFrame:
    """Partial updates: for every field the last patch that sets it counts. Patches combine before they are shuffled."""
    last = patches.groupBy(key).agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), F.col(seq))).alias(f"new_{c}") for c in fields))
    return rows.join(last, key, "left").select(*(F.coalesce(f"new_{c}", c).alias(c) if c in fields else F.col(c) for c in rows.columns))


def promote_teachers(users: DataFrame) -> DataFrame:
    teacher = F.coalesce(F.col("role") == "teacher", F.lit(False))
    return users.withColumns({c: F.when(teacher, F.lit(True)).otherwise(F.col(c)) for c in ("is_premium", "is_paid")})


def without(children: DataFrame, key: str, gone: DataFrame, gone_key: str = "id") -> DataFrame:
    """Children whose parent is not among the ``gone``; a null key has no parent and stays."""
    return children.join(gone.select(F.col(gone_key).alias(key)), key, "left_anti")


def cascade_delete(gone: DataFrame, tests: DataFrame, configs: DataFrame, questions: DataFrame, attempts: DataFrame, answers: DataFrame) -> dict[str, DataFrame]:
    """What is left of each table when the ``gone`` tests (id) and all that hangs on them go."""
    lost = attempts.join(gone.select(F.col("id").alias("test_id")), "test_id", "left_semi").select("id")
    return {
        "tests": without(tests, "id", gone), "configs": without(configs, "test_id", gone), "questions": without(questions, "test_id", gone),
        "attempts": without(attempts, "test_id", gone), "answers": without(answers, "attempt_id", lost),
    }


def delete_users(gone: DataFrame, users: DataFrame, items: DataFrame, tests: DataFrame, attempts: DataFrame) -> dict[str, DataFrame]:
    """The same for users; superusers can't delete themselves and stay. Attempts of their tests go with the tests."""
    who = users.join(gone.select("id"), "id", "left_semi").where("NOT is_superuser").select("id")
    lost = tests.join(who.select(F.col("id").alias("created_by")), "created_by", "left_semi").select("id")
    return {"users": without(users, "id", who), "items": without(items, "owner_id", who), "tests": without(tests, "created_by", who), "attempts": without(without(attempts, "student_id", who), "test_id", lost)}


def unique_violations(rows: DataFrame, key: str) -> DataFrame:
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def orphans(children: DataFrame, key: str, parents: DataFrame) -> DataFrame:
    return children.where(F.col(key).isNotNull()).join(parents.select(F.col("id").alias(key)), key, "left_anti")


def evolve(old: DataFrame, new: DataFrame, defaults: dict) -> DataFrame:
    """Old rows under the new schema: absent columns get defaults, numbers widen to the new types."""
    kinds = dict(new.dtypes)
    wide = old.select(*(F.col(c).cast(kinds[c]) if c in kinds else F.col(c) for c in old.columns))
    return wide.withColumns({c: F.lit(v).cast(kinds[c]) for c, v in defaults.items() if c not in old.columns}).unionByName(new, allowMissingColumns=True)
