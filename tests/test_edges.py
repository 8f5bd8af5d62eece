"""Nulls, ties, empty tables and late rows of the exam platform's operators, on hand-made rows."""

import datetime
import os
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from gradeloom.functions import text as t
from gradeloom.operators import grading, joins, maintenance, papers
from gradeloom.operators.aggregates import test_stats as stats_by_test
from gradeloom.sources import files
from gradeloom.streaming import activity


def table(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


def found(df, *columns):
    return {tuple(r) for r in (df.select(*columns) if columns else df).collect()}


def at(text):
    return datetime.datetime.fromisoformat(f"2024-01-01 {text}")


@pytest.mark.parametrize(("text", "expected"), [("life-science", "Life-Science"), (" COMPUTER science 2b", "Computer Science 2B"), ("o'neil", "O'Neil"), ("", "General"), (None, "General"), ("éCOLE", "École"), ("x_y(z)1q", "X_Y(Z)1Q")])
def test_subject_key_is_title_case(spark, text, expected):
    assert table(spark, "x string", (text,)).select(t.subject_key(F.col("x"))).first()[0] == expected


def test_sheets_rank_ties_by_id_and_missing_numbers_first(spark):
    questions = table(spark, "id long, test_id long, question_number int, question_type string, correct_option string, marks double, negative_marks double", (5, 1, 2, "SCQ", "A", 4.0, -1.0), (3, 1, 2, "SCQ", "B", 4.0, -0.5), (9, 1, None, "ESSAY", "A", 4.0, -1.0), (7, 1, 3, "MCQ", None, 4.0, -1.0))
    attempts = table(spark, "id long, test_id long", (10, 1), (11, 2))
    marks = table(spark, "attempt_id long, question_index int, marked string", (10, 0, "A"), (10, 1, "A"), (10, 2, "A"), (10, 3, "A"), (10, 4, "A"), (11, 0, "A"), (12, 0, "A"))
    got = found(grading.grade_sheet(marks, attempts, questions), "attempt_id", "id", "net")
    assert got == {(10, 9, 0.0), (10, 3, -0.5), (10, 5, 4.0), (10, 7, 0.0)}
    assert grading.grade_sheet(marks, attempts, questions.limit(0)).count() == 0


def test_marks_of_equal_fill_and_cut_rows(spark):
    box = lambda i, x, y, fill, w=20: (1, x, y, w, 20, fill, i)
    boxes = table(spark, "sheet_id long, x long, y long, w int, h int, filled double, id long", box(1, 40, 1, 9.0), box(2, 10, 1, 9.0), box(3, 20, 2, 1.0), box(4, 30, 2, 2.0), box(5, 0, 0, 99.0, 23), box(6, 1, 50, 1.0), box(7, 2, 50, 1.0), box(8, 3, 50, 1.0))
    assert found(grading.select_marks(boxes, ["x", "id"])) == {(1, 0, "A")}
    assert grading.select_marks(boxes.limit(0), ["x", "id"]).count() == 0


def test_quota_trim_orders_missing_pages_first(spark):
    matched = table(spark, "id long, test_id long, subject string, section_name string, q_count int", *((i, 1, "Physics", "A", 2) for i in range(4)), (8, 1, "Physics", "B", 0))
    questions = table(spark, "id long, page_number int, question_number int", (0, 2, 1), (1, None, 9), (2, 1, None), (3, 1, 4), (8, 1, 1))
    assert found(papers.quota_trim(matched, questions), "id", "rank") == {(1, 1), (2, 2)}


def test_chronology_goes_on_from_section_to_section(spark):
    plan = table(spark, "test_id long, subject string, section_name string, start_q int, end_q int, pos int", (1, "P", "B", 11, 20, 1), (1, "P", "A", 5, 9, 0), (2, "P", "A", 3, 3, 0))
    assert found(papers.chronology(plan)) == {(1, "P", "A", 1, 5), (1, "P", "B", 6, 15), (2, "P", "A", 1, 1)}
    assert papers.chronology(plan.limit(0)).count() == 0


def test_loose_sections_take_the_first_name_that_holds_the_other(spark):
    questions = table(spark, "id long, test_id long, subject string, section string", (1, 1, "phy", "Part Section B"), (2, 1, "Physics ", "sec"), (3, 1, "physics", None), (4, 2, "physics", "Section A"), (5, 1, None, "Section A"))
    plan = table(spark, "test_id long, subject string, section_name string, pos int", (1, "Physics", "Section A", 1), (1, "Physics", "Section B", 0), (1, "Chemistry", "Section A", 2))
    assert found(joins.loose_sections(questions, plan)) == {(1, 1, "Physics", "Section B"), (2, 1, "Physics", "Section B")}


def test_tests_without_attempts_have_zero_stats(spark):
    tests, attempts = table(spark, "id long", (1,), (2,)), table(spark, "test_id long, score double", (1, None), (1, 3.0), (None, 5.0))
    assert found(joins.tests_with_stats(tests, stats_by_test(attempts)), "id", "submission_count", "average_score") == {(1, 2, 1.5), (2, 0, 0.0)}


def test_cascades_keep_rows_without_a_parent(spark):
    tests, other = table(spark, "id long, created_by long", (1, 7), (2, 8), (3, None)), "id long, test_id long"
    attempts = table(spark, "id long, test_id long, student_id long", (10, 1, 50), (11, 2, 51), (12, None, None))
    left = maintenance.cascade_delete(tests.where("id = 1").select("id"), tests, table(spark, other, (1, 1)), table(spark, other, (1, 1), (2, 2), (3, None)), attempts, table(spark, "attempt_id long", (10,), (11,), (None,)))
    assert {k: len(found(v)) for k, v in left.items()} == {"tests": 2, "configs": 0, "questions": 2, "attempts": 2, "answers": 2}
    users = table(spark, "id long, is_superuser boolean", (7, False), (8, True), (50, False))
    gone = maintenance.delete_users(users, users, table(spark, "owner_id long", (7,), (8,), (None,)), tests, attempts)
    assert {k: len(found(v)) for k, v in gone.items()} == {"users": 1, "items": 2, "tests": 2, "attempts": 2}


def test_evolve_fills_and_widens(spark):
    old, new = table(spark, "id long, marks int, gone string", (1, 4, "x"), (2, None, None)), table(spark, "id long, marks double, is_premium boolean", (3, 0.5, True))
    got = maintenance.evolve(old, new, {"is_premium": False})
    assert found(got, "id", "marks", "is_premium", "gone") == {(1, 4.0, False, "x"), (2, None, False, None), (3, 0.5, True, None)}
    assert maintenance.evolve(old.limit(0), new.limit(0), {"is_premium": False}).count() == 0


def test_captured_payments_take_the_first_and_need_an_unpaid_user(spark):
    events = table(spark, "user_id long, ts timestamp_ntz, event_id long, grade int", (1, at("10:00"), 5, 12), (1, at("09:00"), 6, None), (1, at("09:00"), 4, None), (2, at("09:00"), 7, 11), (9, at("09:00"), 8, 11))
    users = table(spark, "id long, grade int, is_paid boolean", (1, 11, False), (2, 12, True), (3, 11, False))
    got = activity.captured_payments(events, users, F.lit("2024-04-01").cast("timestamp_ntz")).collect()
    assert [(r["id"], r["payment_id"], r["grade"], r["standard"], r["premium_expiry"].isoformat()) for r in got] == [(1, 4, 11, "11th", "2025-03-31T23:59:59")]


def test_job_status_changes_only_what_is_set(spark):
    updates = table(spark, "job_id long, ts timestamp_ntz, event_id long, progress int, message string, status string", (1, at("09:00"), 1, 10, "a", None), (1, at("09:01"), 2, None, None, "running"), (1, at("09:01"), 3, 20, None, None), (2, at("09:00"), 4, None, None, None))
    assert found(activity.job_status(updates), "job_id", "progress", "message", "status") == {(1, 20, "a", "running"), (2, None, None, None)}


# ---- streams: files arrive one after the other


def arrive(spark, path, schema, *batches):
    os.makedirs(path, exist_ok=True)
    for i, rows in enumerate(batches):
        table(spark, schema, *rows).coalesce(1).write.parquet(f"{path}/{i}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(path)


def test_alerts_come_once_however_late(spark, tmp_path):
    schema = "student_id long, test_id long, at string"
    stream = arrive(spark, str(tmp_path / "in"), schema, [(1, 1, "a"), (1, 1, "b"), (2, 1, "c")], [(1, 1, "d"), (1, 2, "e")], [(2, 1, "f"), (None, 2, "g")])
    got = activity.alert_once(stream, str(tmp_path / "out")).collect()
    assert sorted((r["student_id"] or 0, r["test_id"]) for r in got) == [(0, 2), (1, 1), (1, 2), (2, 1)]


def test_attempts_close_when_their_time_is_over(spark, tmp_path):
    schema = "attempt_id long, ts timestamp, duration_minutes int"
    stream = arrive(spark, str(tmp_path / "in"), schema, [(1, at("09:00"), 60), (2, at("09:30"), 600)], [(1, at("09:10"), 20), (3, at("10:00"), 5)], [(4, at("10:20"), 5)]).withWatermark("ts", "10 minutes")
    got = activity.run_to_table(activity.auto_submit_stream(stream), str(tmp_path / "out")).collect()
    utc = lambda x: int(at(x).replace(tzinfo=datetime.UTC).timestamp() * 1000)
    assert {(r["attempt_id"], r["closed_ms"]) for r in got} == {(1, utc("09:30")), (3, utc("10:05"))}


def test_jobs_expire_after_an_hour_of_silence(spark, tmp_path):
    schema = "job_id long, ts timestamp"
    stream = arrive(spark, str(tmp_path / "in"), schema, [(1, at("09:00")), (1, at("09:50")), (2, at("09:00"))], [(2, at("10:00")), (3, at("11:05"))], [(4, at("11:20"))]).withWatermark("ts", "10 minutes")
    got = activity.run_to_table(activity.expired_jobs(stream), str(tmp_path / "out")).collect()
    assert {(r["job_id"], r["updated_at"].strftime("%H:%M")) for r in got} == {(1, "09:50"), (2, "10:00")}


def test_active_users_count_once_a_minute(spark, tmp_path):
    schema = "user_id long, ts timestamp"
    stream = arrive(spark, str(tmp_path / "in"), schema, [(1, at("09:00:10")), (1, at("09:00:50")), (2, at("09:02:00"))], [(1, at("09:01:30"))]).withWatermark("ts", "10 minutes")
    seen = activity.run_to_table(activity.active_users(stream), str(tmp_path / "out"))
    got = {r["until"].strftime("%H:%M"): r["active"] for r in activity.active_now(seen).collect()}
    assert got == {"09:01": 1, "09:02": 1, "09:03": 2, "09:04": 2, "09:05": 2, "09:06": 2, "09:07": 1}


def test_jdbc_reads_rows_without_a_key_and_beyond_the_bounds(spark):
    url, options = "jdbc:derby:memory:exam;create=true", {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    rows = table(spark, "ID long, NAME string", *((i, f"n{i}") for i in range(-3, 30)), (None, "none"))
    rows.write.jdbc(url, "USERS", mode="overwrite", properties=options)
    got = files.read_jdbc(spark, url, "USERS", "ID", 0, 20, 4, **options)
    assert got.rdd.getNumPartitions() == 4
    assert found(got) == found(rows)


def test_text_functions_against_plain_python(spark):
    """Strip, both question hashes' bodies and anchor tokens over white space of several kinds, letters of several scripts."""
    texts = ["", " ", " a ", " É  A-1 ", "(12)  Of\nWhat?", "[3] x_y", "7.  z", "1 ) e", "ß 漢字 ٣", "a a b", "\t12) 12) c\r\n"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(texts)], "i int, v string")
    label = r"(?U)^[\(\[]?\d+[\)\.\]]\s*"
    got = df.select("v", t.python_strip(F.col("v")).alias("s"), t.letters(F.col("v")).alias("l"), t._loose(F.col("v"), label).alias("g")).collect()
    for r in got:
        low = r["v"].lower().strip()
        assert r["s"] == r["v"].strip()
        assert r["l"] == "".join(c for c in r["v"].lower() if unicodedata.category(c)[0] in "LN")
        assert r["g"] == re.sub("[^a-z0-9]+", "", re.sub(r"^[\(\[]?\d+[\)\.\]]\s*", "", low))
    none = F.lit(None).cast("array<string>")
    prints = df.select(F.col("i").alias("id"), *(F.lit("").alias(c) for c in ("content_hash", "guard_hash", "intent")), F.lit(0.5).alias("confidence"), t.anchor_text(F.col("v"), none).alias("anchor"))
    for r in papers.signatures(prints).collect():
        assert r["tokens"] == list(dict.fromkeys(re.findall("[a-z0-9]+", texts[r["id"]].lower())))


def test_a_long_run_of_white_space_is_stripped_in_one_pass(spark):
    inner = F.concat(F.lit(" a"), F.repeat(F.lit(" "), F.lit(1_000_000)), F.lit("b "))
    assert spark.range(1).select(F.length(t.python_strip(inner)).alias("n")).first()["n"] == 1_000_002
