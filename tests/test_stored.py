"""Stored statistics, page indexes, copy-on-write tables and files of several schemas, on hand-made rows."""

import glob
import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from test_edges import found, table

from gradeloom.operators import aggregates, joins, papers
from gradeloom.operators.rollups import Rollups
from gradeloom.sources import evolving, pages, stored

# ---- sums by key, refreshed


def attempts_of(spark, *rows):
    return table(spark, "id long, student_id long, test_id long, status string, score double", *rows)


def test_refreshed_statistics_equal_recomputed_ones(spark, tmp_path):
    students = table(spark, "id long, stream string", (1, "medical"), (2, None), (3, "engineering"))
    old = [(10, 1, 7, "submitted", 50.0), (11, 1, 8, "ongoing", None), (12, 2, 7, "submitted", 30.0), (13, None, 7, "ongoing", 1.0)]
    new = [(14, 1, 7, "submitted", 45.5), (15, 3, 9, "submitted", None)]
    marks_old = [(10, "Physics", True), (10, "Maths", True), (10, None, False), (12, "Biology", False)]
    marks_new = [(14, "Physics", False), (14, "Physics", False), (15, "Chemistry", True)]
    graded = lambda rows, own: table(spark, "attempt_id long, subject string, is_correct boolean", *rows).join(attempts_of(spark, *own).select(F.col("id").alias("attempt_id"), "student_id"), "attempt_id")
    own = Rollups(spark, str(tmp_path / "r"))
    own.refresh(attempts_of(spark, *old), graded(marks_old, old), 0)
    own.refresh(attempts_of(spark, *new), graded(marks_new, new), 1)
    own.refresh(attempts_of(spark, *new), graded(marks_new, new), 1)  # tried again
    whole, every = attempts_of(spark, *old, *new), table(spark, "attempt_id long, subject string, is_correct boolean", *marks_old, *marks_new)
    accuracy = aggregates.student_subject_accuracy(every, whole, students)
    for _ in range(2):
        assert found(own.test_stats()) == found(aggregates.test_stats(whole))
        assert found(own.accuracy(students)) == found(accuracy)
        assert found(own.student_kpis(students)) == found(aggregates.student_kpis(whole, aggregates.with_zero_subjects(accuracy, students)))
        own.compact()


def test_a_refresh_writes_the_new_attempts_keys_only(spark, tmp_path):
    own = Rollups(spark, str(tmp_path / "r"))
    none = table(spark, "student_id long, subject string, is_correct boolean")
    own.refresh(attempts_of(spark, *((i, i % 50, i % 20, "submitted", 1.0) for i in range(400))), none, 0)
    own.refresh(attempts_of(spark, (900, 7, 3, "submitted", 5.0), (901, 7, 3, "ongoing", 5.0)), none, 1)
    _, folders = own.tests._folders()
    assert sorted(spark.read.parquet(f).count() for f in folders) == [1, 20]
    assert found(own.test_stats().where("test_id = 3"), "submission_count") == {(22,)}


def test_a_refresh_that_broke_off_goes_on(spark, tmp_path):
    own = Rollups(spark, str(tmp_path / "r"))
    rows = attempts_of(spark, (1, 1, 1, "submitted", 4.0))
    own.tests.add(rows.select("test_id", F.lit(1).cast("long").alias("n"), "score"), 0)  # the first of three tables
    own.refresh(rows, table(spark, "student_id long, subject string, is_correct boolean", (1, "Physics", True)), 0)
    assert found(own.test_stats()) == {(1, 1, 4.0)}
    assert own.students.read().count() == own.subjects.read().count() == 1


# ---- pages


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    rows = table(spark, "id long, created_at long", *((i, i // 7) for i in range(1000)))
    return pages.write_pages(rows, (F.col("created_at").desc(), F.col("id")), str(tmp_path_factory.mktemp("pages") / "p"), 9)


def test_any_page_is_the_plain_one(spark, index):
    every = sorted(((i, i // 7) for i in range(1000)), key=lambda r: (-r[1], r[0]))
    for number, size in ((0, 25), (3, 25), (39, 25), (40, 25), (7, 130), (0, 2000), (999, 1)):
        assert [tuple(r) for r in index.page(number, size).collect()] == every[number * size :][:size]
    assert index.total().first()["total"] == 1000


def test_a_page_reads_the_ranges_that_hold_it(spark, index):
    plan = index.page(20, 10)._jdf.queryExecution().executedPlan().toString()
    ranges = {r["part"]: (r["before"], r["n"]) for r in index._ranges().collect()}
    held = [p for p, (before, n) in ranges.items() if before < 210 and before + n > 200]
    assert len(held) <= 2 < len(ranges)
    assert re.search(r"PartitionFilters: \[[^\]]*part#", plan)


def test_pages_of_nothing(spark, tmp_path):
    empty = pages.write_pages(table(spark, "id long"), (F.col("id"),), str(tmp_path / "p"), 4)
    assert empty.page(0, 10).collect() == []
    assert empty.total().first()["total"] == 0


# ---- copy on write


def files(own):
    return {f for path in own.folders().values() for f in glob.glob(f"{path.removeprefix('file:')}/*.parquet")}


def test_a_patch_leaves_the_files_of_other_partitions(spark, tmp_path):
    rows = table(spark, "id long, name string, paid boolean", *((i, f"n{i}", False) for i in range(200)), (None, "nobody", None))
    own = stored.store(rows, str(tmp_path / "t"), "id", 16)
    before = files(own)
    patches = table(spark, "id long, seq int, name string, paid boolean", (5, 1, "a", True), (5, 2, "b", None), (900, 1, "absent", True))
    touched = own.patch(patches, ["name", "paid"])
    assert len(touched) <= 2
    after = files(own)
    assert len(before & after) >= len(before) - len(touched)
    assert found(own.read().where("id = 5")) == {(5, "b", True)}
    assert found(own.read()) == {(i, f"n{i}", False) for i in range(200) if i != 5} | {(5, "b", True), (None, "nobody", None)}


def test_upserts_and_deletes_of_stored_rows(spark, tmp_path):
    own = stored.store(table(spark, "key string, value string, note string", ("a", "1", "x"), ("b", None, None), ("c", "3", "z")), str(tmp_path / "t"), "key", 4)
    own.upsert(table(spark, "key string, value string, note string", ("a", "2", None), ("d", "4", None)))
    assert found(own.read()) == {("a", "2", "x"), ("b", None, None), ("c", "3", "z"), ("d", "4", None)}
    own.delete(table(spark, "key string", ("a",), ("c",), ("nowhere",), (None,)))
    assert found(own.read()) == {("b", None, None), ("d", "4", None)}
    own.delete(own.read().select("key"))
    assert own.read().count() == 0
    own.upsert(table(spark, "key string, value string, note string", ("e", "5", None)))
    assert found(own.read()) == {("e", "5", None)}


def test_a_change_that_broke_off_is_not_seen(spark, tmp_path):
    own = stored.store(table(spark, "id long, v long", (1, 1), (2, 2)), str(tmp_path / "t"), "id", 2)
    table(spark, "id long, v long", (1, 99)).write.parquet(f"{own.path}/rows/1-lost")
    assert found(own.read()) == {(1, 1), (2, 2)}
    assert own.version() == 0


def test_tests_go_with_all_that_hangs_on_them(spark, tmp_path):
    put = lambda name, schema, key, *rows: stored.store(table(spark, schema, *rows), str(tmp_path / name), key, 8)
    exam = stored.Exam(
        put("tests", "id long", "id", (1,), (2,), (3,)), put("configs", "id long, test_id long", "test_id", (1, 1), (2, 2), (3, None)), put("questions", "id long, test_id long", "test_id", (1, 1), (2, 3)),
        put("attempts", "id long, test_id long", "test_id", (10, 1), (11, 2), (12, 1), (13, None)), put("answers", "attempt_id long, question_id long", "attempt_id", (10, 1), (11, 1), (12, 1), (13, 1)),
        put("activity", "attempt_id long, n long", "attempt_id", (10, 5), (11, 6), (None, 7)),
    )
    before = files(exam.answers)
    touched = exam.delete_tests(table(spark, "id long", (1,), (99,)))
    assert found(exam.tests.read()) == {(2,), (3,)}
    assert found(exam.configs.read()) == {(2, 2), (3, None)}
    assert found(exam.questions.read()) == {(2, 3)}
    assert found(exam.attempts.read()) == {(11, 2), (13, None)}
    assert found(exam.answers.read()) == {(11, 1), (13, 1)}
    assert found(exam.activity.read()) == {(11, 6), (None, 7)}
    assert len(touched["answers"]) <= 2
    assert len(before & files(exam.answers)) >= len(before) - len(touched["answers"])
    assert exam.delete_tests(table(spark, "id long", (1,)))["answers"] == set()


# ---- schemas


def test_files_of_three_versions_are_one_table(spark, tmp_path):
    path = str(tmp_path / "v")
    spark.sql("SELECT 1L AS id, 4 AS marks, 'x' AS gone").write.parquet(f"{path}/1")
    spark.sql("SELECT 2L AS id, 5 AS marks, true AS is_premium").write.parquet(f"{path}/2")
    spark.sql("SELECT 3L AS id, 0.5D AS marks, CAST(NULL AS boolean) AS is_premium, -0.25D AS negative_marks").write.parquet(f"{path}/3")
    schema = StructType.fromDDL("id long, marks double, is_premium boolean, negative_marks double, note string, level int")
    got = evolving.read_versions(spark, path, schema, {"is_premium": False, "negative_marks": -1.0, "note": "it's \\ new"})
    assert got.columns == ["id", "marks", "is_premium", "negative_marks", "note", "level"]
    assert found(got) == {(1, 4.0, False, -1.0, "it's \\ new", None), (2, 5.0, True, -1.0, "it's \\ new", None), (3, 0.5, None, -0.25, "it's \\ new", None)}
    assert found(got.where("marks > 4.5 AND negative_marks = -1.0"), "id") == {(2,)}
    assert "PushedFilters: [IsNotNull(marks)" in got.where("marks > 4.5")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<id:bigint>" in got.select("id")._jdf.queryExecution().executedPlan().toString()


# ---- one pass of conformance


PLAN = "test_id long, subject string, section_name string, start_q int, end_q int, pos int, q_count int"


def test_a_range_goes_before_a_name(spark):
    plan = table(spark, PLAN, (1, "physics", "A", 1, 5, 0, 2), (1, "Physics", "B", 3, 9, 1, 2), (1, "Physics", "C", 50, 60, 2, 2), (2, "Physics", "A", 1, 5, 0, 2))
    questions = table(spark, "id long, test_id long, subject string, section string, question_number int", (1, 1, "PHYSICS", "C", 4), (2, 1, "Physics", " c ", 40), (3, 1, "Physics", "none", 99), (4, 1, "Art", "A", 4), (5, 1, "Physics", "A", None))
    assert found(joins.matched_sections(questions, plan), "id", "section_name", "how") == {(1, "A", "range"), (2, "C", "name"), (5, "A", "name")}
    assert found(joins.range_match(questions, plan), "id") == {(1,)}


def test_reports_count_sections_outside_of_the_plan_for_their_subject(spark):
    plan = table(spark, PLAN, (1, "Physics", "A", 1, 5, 0, 2), (1, "Chemistry", "A", 1, 5, 1, 1), (2, "Maths", "A", 1, 5, 0, 1))
    saved = table(spark, "test_id long, subject string, section string", (1, "Physics", "A"), (1, "Physics", "Other"), (1, "Chemistry", "A"), (3, "Physics", "A"))
    got = found(papers.conformance(plan, saved), "test_id", "subject", "section", "expected", "actual", "subject_actual")
    assert got == {(1, "Physics", "a", 2, 1, 2), (1, "Chemistry", "a", 1, 1, 1), (2, "Maths", "a", 1, 0, 0)}
    report = {r["test_id"]: r["report"] for r in papers.parsing_report(plan, saved, saved).collect()}
    assert set(report) == {1, 2}
    assert '"subject_counts":{"Chemistry":1,"Physics":2}' in report[1]
    assert '"total_saved":0' in report[2] and "subject_counts" not in report[2]
    assert papers.symmetry_report(plan.limit(0), saved).count() == 0


def test_a_report_shuffles_once_for_all_its_counts(spark, tmp_path):
    plan = table(spark, PLAN, (1, "Physics", "A", 1, 5, 0, 2))
    saved = table(spark, "test_id long, subject string, section string", (1, "Physics", "A"))
    shown = papers.symmetry_report(plan, saved)._jdf.queryExecution().executedPlan().toString()
    assert shown.count("Exchange") == 1


# ---- near duplicates where an intent's texts share their words


def test_pairs_are_the_same_whether_tokens_are_hot_or_not(spark):
    import random

    r = random.Random(4)
    rows = []
    for i in range(300):
        base = random.Random(i // 3).sample([f"t{k}" for k in range(40)], random.Random(i // 3).randint(1, 24))
        tokens = [w for w in base if r.random() > 0.03] + ["common"] * (i % 5 > 0)
        rows.append((i, "i", float(i % 2) / 100, f"h{i}", tokens))
    signed = table(spark, "id long, intent string, confidence double, anchor_hash string, tokens array<string>", *rows)
    plain = set()
    for i, _, _, _, x in rows:
        for j, _, _, _, y in rows[:i]:
            if x and y and len(set(x) & set(y)) >= 0.9 * len(set(x) | set(y)) - 1e-9:
                plain.add((i, j))
    assert len(plain) > 50
    assert found(papers.near_duplicate_pairs(signed, hot=1)) == found(papers.near_duplicate_pairs(signed, hot=10_000)) == plain
