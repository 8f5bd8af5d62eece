"""Statistics kept as sums by key, refreshed by what is new: attempts and graded answers that came since touch the rows of
their own tests and students only, and means are worked out when a table is read."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.functions.text import half_up, percent
from gradeloom.operators import aggregates
from gradeloom.sources.merged import MergeTable


def _sums(spark: SparkSession, path: str, keys: str, sums: str) -> MergeTable:
    """``keys`` and ``sums``: names and types of columns; partial rows of a key add up."""
    by, values = ([c.split()[0] for c in x.split(", ")] for x in (keys, sums))
    return MergeTable(spark, path, f"{keys}, {sums}", lambda rows: rows.groupBy(*by).agg(*(F.sum(v).alias(v) for v in values)))


@dataclass(frozen=True)
class Rollups:
    """Three keyed tables below ``path``: by test, by student, by student and subject."""

    spark: SparkSession
    path: str

    @property
    def tests(self) -> MergeTable:
        return _sums(self.spark, f"{self.path}/tests", "test_id long", "n long, score double")

    @property
    def students(self) -> MergeTable:
        return _sums(self.spark, f"{self.path}/students", "student_id long", "completed long, attempted long, score double")

    @property
    def subjects(self) -> MergeTable:
        return _sums(self.spark, f"{self.path}/subjects", "student_id long, subject string", "correct long, total long")

    def refresh(self, attempts: DataFrame, graded: DataFrame, batch: int) -> None:
        """Adds new attempts and their graded answers (student_id, subject, is_correct). A batch counts once, however often
        it is tried; each table is asked for itself, so a refresh that broke off half-way goes on with the others."""
        self.refresh_tests(attempts, batch)
        self.refresh_students(attempts, graded, batch)

    def refresh_tests(self, attempts: DataFrame, batch: int) -> None:
        """The table by test alone, which needs no answers."""
        self.tests.add(attempts.select("test_id", F.lit(1).cast("long").alias("n"), F.coalesce("score", F.lit(0.0)).alias("score")), batch)

    def refresh_students(self, attempts: DataFrame, graded: DataFrame, batch: int) -> None:
        score = F.coalesce("score", F.lit(0.0)).alias("score")
        self.students.add(attempts.select("student_id", (F.col("status") == "submitted").cast("long").alias("completed"), F.lit(1).cast("long").alias("attempted"), score), batch)
        self.subjects.add(graded.select("student_id", F.coalesce("subject", F.lit("General")).alias("subject"), F.col("is_correct").cast("long").alias("correct"), F.lit(1).cast("long").alias("total")), batch)

    def compact(self) -> None:
        for t in (self.tests, self.students, self.subjects):
            t.compact()

    def test_stats(self) -> DataFrame:
        return self.tests.read().select("test_id", F.col("n").alias("submission_count"), F.round(F.col("score") / F.col("n"), 4).alias("average_score"))

    def teacher_kpis(self, tests: DataFrame) -> DataFrame:
        return aggregates.teacher_kpis(tests, self.test_stats())

    def accuracy(self, students: DataFrame) -> DataFrame:
        """Accuracy by student and subject, for subjects of the student's stream and General."""
        own = students.select(F.col("id").alias("student_id"), aggregates.relevant_subjects(F.col("stream")).alias("relevant"))
        kept = self.subjects.read().join(own, "student_id").where(F.array_contains("relevant", F.col("subject")) | (F.col("subject") == "General"))
        return kept.select("student_id", "subject", percent(F.col("correct"), F.col("total")).alias("accuracy"))

    def student_kpis(self, students: DataFrame) -> DataFrame:
        own = self.students.read().select("student_id", "completed", "attempted", half_up(F.col("score") / F.col("attempted")).alias("avg_score"))
        rate = aggregates.with_zero_subjects(self.accuracy(students), students).groupBy("student_id").agg(half_up(F.avg("accuracy")).alias("accuracy_rate"))
        return own.join(rate, "student_id", "left").withColumn("accuracy_rate", F.coalesce("accuracy_rate", F.lit(0)))
