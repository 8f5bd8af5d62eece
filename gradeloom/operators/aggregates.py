"""Statistics of attempts, tests, students, teachers and the platform. Aggregates combine before they shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradeloom.functions.text import filled_or, half_up, percent
from gradeloom.operators.grading import filled


def count_per(rows: DataFrame, key: str, name: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias(name))


def attempts_per_student(attempts: DataFrame, students: DataFrame) -> DataFrame:
    counts = attempts.groupBy("student_id").agg(F.count("*").alias("attempt_count"))
    return students.select("id", "is_premium").join(counts, F.col("id") == F.col("student_id"), "left").select("id", F.coalesce("attempt_count", F.lit(0)).alias("attempt_count"), "is_premium")


def platform_counts(tests: DataFrame, attempts: DataFrame, users: DataFrame, now: Column) -> DataFrame:
    """One row: tests, attempts and users active in the last five minutes."""
    one = lambda df, name: df.agg(F.count("*").alias(name))
    active = users.where(F.col("last_active_at") >= now - F.expr("INTERVAL 5 MINUTES"))
    return one(tests, "total_tests").crossJoin(one(attempts, "total_attempts")).crossJoin(one(active, "active_users"))


def question_stats(questions: DataFrame) -> DataFrame:
    """Rows by subject, and the total over all rows beside each; an empty subject counts in the total only."""
    total = questions.agg(F.count("*").alias("total"))
    return questions.where(filled(F.col("subject"))).groupBy("subject").agg(F.count("*").alias("n")).crossJoin(total)


def test_stats(attempts: DataFrame) -> DataFrame:
    return attempts.groupBy("test_id").agg(F.count("*").alias("submission_count"), F.round(F.avg(F.coalesce("score", F.lit(0.0))), 4).alias("average_score"))


def test_total_marks(questions: DataFrame) -> DataFrame:
    return questions.groupBy("test_id").agg(F.sum("marks").alias("total_marks"), F.sum("marks").cast("int").alias("total_int"))


def section_scores(graded: DataFrame) -> DataFrame:
    """Net marks by attempt, subject and section, defaults General and Section A."""
    return graded.groupBy("attempt_id", filled_or(F.col("subject"), "General").alias("subject"), filled_or(F.col("section"), "Section A").alias("section")).agg(F.round(F.sum("net"), 4).alias("score"))


def section_score_map(graded: DataFrame) -> DataFrame:
    """The same as one map<subject, map<section, score>> for each attempt, both in order of their names."""
    flat = section_scores(graded)
    sections = flat.groupBy("attempt_id", "subject").agg(F.array_sort(F.collect_list(F.struct("section", "score"))).alias("sections"))
    subjects = sections.groupBy("attempt_id").agg(F.array_sort(F.collect_list(F.struct("subject", "sections"))).alias("subjects"))
    nested = F.map_from_entries(F.transform("subjects", lambda s: F.struct(s["subject"], F.map_from_entries(s["sections"]))))
    return subjects.select("attempt_id", nested.alias("section_results"))


def subject_scores(graded: DataFrame, attempts: DataFrame, questions: DataFrame) -> DataFrame:
    """Net marks of each attempt in every subject of its test, 0 without answers.

    A test's subjects, and an attempt's sums by subject, are few: they meet as one row for each attempt and are unfolded
    after, so what is shuffled is attempts, not attempts times subjects."""
    subject = filled_or(F.col("subject"), "General")
    domain = questions.select("test_id", subject.alias("subject")).groupBy("test_id").agg(F.collect_set("subject").alias("subjects"))
    got = graded.groupBy("attempt_id", subject.alias("subject")).agg(F.sum("marks_obtained").alias("got"))
    got = got.groupBy("attempt_id").agg(F.map_from_entries(F.collect_list(F.struct("subject", "got"))).alias("got"))
    every = attempts.select(F.col("id").alias("attempt_id"), "test_id").join(domain, "test_id").join(got, "attempt_id", "left")
    rows = every.select("attempt_id", "test_id", F.explode("subjects").alias("subject"), "got")
    return rows.select("attempt_id", "test_id", "subject", F.round(F.coalesce(F.try_element_at("got", F.col("subject")), F.lit(0.0)), 4).alias("score"))


def subject_scores_pivot(scores: DataFrame, subjects: list[str]) -> DataFrame:
    """One column for each of the given subjects; the list is fixed, so no pass over the data looks for it."""
    wide = scores.groupBy("attempt_id").pivot("subject", subjects).agg(F.sum("score"))
    return wide.select("attempt_id", *(F.coalesce(F.col(f"`{s}`"), F.lit(0.0)).alias(f"{s}_score") for s in subjects))


def subject_summary(graded: DataFrame) -> DataFrame:
    return graded.groupBy("attempt_id", F.coalesce("subject", F.lit("General")).alias("subject")).agg(F.count_if("is_correct").alias("correct"), F.count("*").alias("total"))


def subject_summary_text(summary: DataFrame) -> DataFrame:
    line = F.format_string("- %s: %d/%d correct\n", "subject", "correct", "total")
    return summary.groupBy("attempt_id").agg(F.array_join(F.array_sort(F.collect_list(line)), "").alias("summary"))


def attempt_summary(answers: DataFrame) -> DataFrame:
    """Questions, correct, incorrect and attempted ones, and accuracy; an empty answer is none here."""
    given = filled(F.col("selected_option")) | filled(F.col("answer_text"))
    sums = answers.groupBy("attempt_id").agg(F.count("*").alias("total"), F.count_if("is_correct").alias("correct"), F.count_if(~F.col("is_correct") & given).alias("incorrect"))
    tried = F.col("correct") + F.col("incorrect")
    return sums.withColumn("attempted", tried).withColumn("accuracy", percent(F.col("correct"), tried))


# Subjects by stream.
SUBJECTS_BY_STREAM = {"medical": ("Physics", "Chemistry", "Biology"), "engineering": ("Physics", "Chemistry", "Maths")}
ALL_SUBJECTS = ("Physics", "Chemistry", "Maths", "Biology")


def relevant_subjects(stream: Column) -> Column:
    out = F.when(F.lit(False), F.array(F.lit("")))
    for name, own in SUBJECTS_BY_STREAM.items():
        out = out.when(F.lower(stream) == name, F.array(*map(F.lit, own)))
    return out.otherwise(F.array(*map(F.lit, ALL_SUBJECTS)))


def student_subject_accuracy(graded: DataFrame, attempts: DataFrame, students: DataFrame) -> DataFrame:
    """Accuracy by student and subject, for subjects of the student's stream and General."""
    return accuracy_of(graded.join(attempts.select(F.col("id").alias("attempt_id"), "student_id"), "attempt_id"), students)


def accuracy_of(rows: DataFrame, students: DataFrame) -> DataFrame:
    """The same for graded answers that have their student_id."""
    sums = rows.groupBy("student_id", F.coalesce("subject", F.lit("General")).alias("subject")).agg(F.count_if("is_correct").alias("correct"), F.count("*").alias("total"))
    own = students.select(F.col("id").alias("student_id"), relevant_subjects(F.col("stream")).alias("relevant"))
    kept = sums.join(own, "student_id").where(F.array_contains("relevant", F.col("subject")) | (F.col("subject") == "General"))
    return kept.select("student_id", "subject", percent(F.col("correct"), F.col("total")).alias("accuracy"))


def with_zero_subjects(accuracy: DataFrame, students: DataFrame) -> DataFrame:
    """Students without a row get one of 0 % for each relevant subject."""
    none = students.join(accuracy.select(F.col("student_id").alias("id")).distinct(), "id", "left_anti")
    empty = none.select(F.col("id").alias("student_id"), F.explode(relevant_subjects(F.col("stream"))).alias("subject"), F.lit(0).cast("long").alias("accuracy"))
    return accuracy.unionByName(empty)


def student_kpis(attempts: DataFrame, accuracy: DataFrame) -> DataFrame:
    own = attempts.groupBy("student_id").agg(F.count_if(F.col("status") == "submitted").alias("completed"), F.count("*").alias("attempted"), half_up(F.avg(F.coalesce("score", F.lit(0.0)))).alias("avg_score"))
    rate = accuracy.groupBy("student_id").agg(half_up(F.avg("accuracy")).alias("accuracy_rate"))
    return own.join(rate, "student_id", "left").withColumn("accuracy_rate", F.coalesce("accuracy_rate", F.lit(0)))


def teacher_kpis(tests: DataFrame, stats: DataFrame) -> DataFrame:
    """By creator: tests, published ones, submissions, and the mean of the tests' means."""
    rows = tests.join(stats, tests["id"] == stats["test_id"], "left")
    return rows.groupBy("created_by").agg(
        F.count("*").alias("total_tests"), F.count_if("is_published").alias("published"), F.sum(F.coalesce("submission_count", F.lit(0))).alias("submissions"),
        half_up(F.avg(F.coalesce("average_score", F.lit(0.0)))).alias("avg_performance"),
    )


def role_counts(users: DataFrame) -> DataFrame:
    return users.agg(F.count("*").alias("total"), F.count_if(F.col("role") == "student").alias("students"), F.count_if(F.col("role") == "teacher").alias("teachers"))


def counts_with_zero(parents: DataFrame, children: DataFrame, key: str, name: str) -> DataFrame:
    """Children of each parent, 0 kept."""
    n = children.groupBy(F.col(key).alias("id")).agg(F.count("*").alias(name))
    return parents.select("id").join(n, "id", "left").select("id", F.coalesce(name, F.lit(0)).alias(name))


def subject_section_rollup(questions: DataFrame) -> DataFrame:
    """Count and marks by test and subject (level 1) and by section of it (level 0)."""
    rows = questions.select("test_id", filled_or(F.col("subject"), "General").alias("subject"), filled_or(F.col("section"), "Section A").alias("section"), "marks")
    out = rows.rollup("test_id", "subject", "section").agg(F.grouping_id().alias("g"), F.count("*").alias("n"), F.sum("marks").alias("marks"))
    return out.where("g < 3").select("test_id", "subject", "section", F.col("g").cast("int").alias("level"), "n", "marks")


def intra_test_duplicates(rows: DataFrame) -> DataFrame:
    """Rows whose hash occurred before in their test (by id), with the first such row; an empty hash counts."""
    first = F.min("id").over(Window.partitionBy("test_id", "content_hash"))
    return rows.withColumn("first_id", first).where("id > first_id").select("test_id", "id", "first_id")


def distinct_subjects_sorted(questions: DataFrame) -> DataFrame:
    return questions.groupBy("test_id").agg(F.array_sort(F.collect_set(filled_or(F.col("subject"), "General"))).alias("subjects"))


def submission_chart(tests: DataFrame, stats: DataFrame, k: int = 5) -> DataFrame:
    newest = tests.orderBy(F.col("created_at").desc(), "id").limit(k)
    label = F.when(F.length("title") > 15, F.concat(F.substring("title", 1, 15), F.lit("..."))).otherwise(F.col("title"))
    return newest.join(stats, newest["id"] == stats["test_id"], "left").select("id", label.alias("name"), F.coalesce("submission_count", F.lit(0)).alias("submissions"))
