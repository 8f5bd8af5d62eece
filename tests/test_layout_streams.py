"""The bucketed layout's plans, and keyed tables over batches, restarts and replays."""

import re

import pytest
from pyspark.sql import functions as F
from test_edges import arrive, at, found, table

from gradeloom.operators import aggregates, grading, joins
from gradeloom.plans import grading as plans
from gradeloom.sources import layout
from gradeloom.streaming import activity

SEQ = "struct<n:int>"


def exam(spark, attempts_of_hot_test=500):
    """Test 1 is taken far more often than the others; attempt 9000 has no test, answer 1 of attempt 9999 no attempt."""
    questions = table(spark, "id long, test_id long, question_number int, question_type string, correct_option string, marks double, subject string, section string", *((t * 10 + i, t, i, "SCQ", "A", 4.0, "Physics", None) for t in (1, 2, 3) for i in range(5)))
    tests = table(spark, "id long, negative_marks double, question_paper_url string", (1, -1.0, "/1"), (2, None, "/2"), (3, -0.5, "/3"))
    rows = [(i, 1 if i < attempts_of_hot_test else 2) for i in range(attempts_of_hot_test + 20)] + [(9000, 77), (9001, None)]
    attempts = table(spark, "id long, test_id long", *rows)
    given = [(a, (t or 1) * 10 + q, "a" if (a + q) % 3 else "b", None, 5) for a, t in rows for q in (0, 2, 7)] + [(9999, 11, "a", None, 1)]
    return questions, tests, attempts, table(spark, "attempt_id long, question_id long, selected_option string, answer_text string, time_spent_seconds int", *given)


def exchanges(df):
    return len(re.findall(r"\bExchange\b", df._jdf.queryExecution().executedPlan().toString()))


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_a_layout_by_cell_moves_nothing_and_splits_a_hot_test(spark, tmp_path, no_broadcast):
    questions, tests, attempts, answers = exam(spark)
    own = layout.write_papers(attempts, questions, tests, answers, str(tmp_path / "papers"), 8, limit=50)
    by_slot = {tuple(r) for r in own.attempts.groupBy("test_id", "slot").count().where("test_id = 1").select("slot", "count").collect()}
    assert len(by_slot) == 10
    assert max(n for _, n in by_slot) < 100
    graded = grading.grade_in_place(own.answers, own.questions)
    plain = grading.grade_answers(answers, questions, attempts, tests)
    assert exchanges(graded) == 0
    assert found(graded, "attempt_id", "question_id", "is_correct", "net", "marks_obtained") == found(plain, "attempt_id", "question_id", "is_correct", "net", "marks_obtained")
    scores = grading.attempt_scores(graded, "test_id", "slot")
    assert exchanges(scores) == 0
    assert found(scores) == found(grading.attempt_scores(plain))
    rest = joins.unattempted_in_place(own.attempts, own.questions, own.answers)
    assert exchanges(rest) == 0
    assert found(rest) == found(joins.unattempted(attempts, questions, answers))
    every = joins.questions_left_answers_in_place(own.attempts, own.questions, graded)
    assert exchanges(every) == 0
    assert found(every) == found(joins.questions_left_answers(attempts, questions, plain, tests))


def test_a_layout_opens_in_a_session_that_does_not_know_it(spark, tmp_path):
    questions, tests, attempts, answers = exam(spark, 30)
    path = str(tmp_path / "kept")
    before = found(layout.write_papers(attempts, questions, tests, answers, path, 4).answers)
    for name in ("attempts", "questions", "answers"):
        spark.sql(f"DROP TABLE {layout._name(f'{path}/{name}')}")
    own = layout.open_papers(spark, path)
    assert found(own.answers) == before
    assert own.answers.count() == 30 * 3 + 20 * 3 + 6


def test_an_empty_layout(spark, tmp_path):
    questions, tests, attempts, answers = (df.limit(0) for df in exam(spark, 1))
    own = layout.write_papers(attempts, questions, tests, answers, str(tmp_path / "none"), 4)
    assert grading.grade_in_place(own.answers, own.questions).count() == 0


def test_a_layout_is_written_once_for_a_state_of_its_tables(spark, tmp_path):
    built = []
    for name in ("lineitem", "orders", "part"):
        spark.range(3).write.parquet(str(tmp_path / f"{name}.parquet"))
    questions, tests, attempts, answers = exam(spark, 5)

    def build(path):
        built.append(path)
        layout.write_papers(attempts, questions, tests, answers, path)

    first = layout.kept_papers(spark, str(tmp_path), build)
    assert found(layout.kept_papers(spark, str(tmp_path), build).answers) == found(first.answers)
    assert len(built) == 1
    spark.range(1).write.mode("append").parquet(str(tmp_path / "orders.parquet"))
    layout.kept_papers(spark, str(tmp_path), build)
    assert len(built) == 2


def test_registered_joins_move_no_answers(spark, no_broadcast):
    from conftest import DATA

    from gradeloom.plans import catalog

    plans.papers(spark, DATA)
    for name in ("grade_attempt", "join_questions_left_answers", "unattempted_questions"):
        assert exchanges(catalog.queries()[name](spark, DATA)) == 0


def test_section_results_nest_by_subject(spark):
    graded = table(spark, "attempt_id long, subject string, section string, net double", (1, "Physics", "B", 4.0), (1, "Physics", "A", -1.0), (1, None, "", 2.0), (1, "", None, 1.0), (2, "Art", "A", 0.0))
    got = {r["attempt_id"]: r["section_results"] for r in aggregates.section_score_map(graded).collect()}
    assert got == {1: {"General": {"Section A": 3.0}, "Physics": {"A": -1.0, "B": 4.0}}, 2: {"Art": {"A": 0.0}}}
    assert aggregates.section_score_map(graded.limit(0)).count() == 0


def test_subject_names_of_attempts(spark):
    attempts = table(spark, "id long, student_id long, test_id long", (1, 5, 1), (2, 5, 2), (3, 6, 3), (4, 6, None))
    tests = table(spark, "id long, title string, subject_id long", (1, "T1", 7), (2, "T2", None), (3, "T3", 99))
    got = found(joins.attempt_subject(attempts, tests, table(spark, "id long, name string", (7, "Physics"))), "attempt_id", "title", "subject_name")
    assert got == {(1, "T1", "Physics"), (2, "T2", "General"), (3, "T3", "General"), (4, None, "General")}


# ---- keyed tables


HEARTBEAT = "user_id long, last_active_at timestamp, event_id long, current_path string"


def heart(spark, *rows):
    return table(spark, HEARTBEAT, *rows)


def test_batches_merge_once_each_and_only_what_they_change(spark, tmp_path):
    own = activity.heartbeats(spark, str(tmp_path / "t"))
    assert own.read().count() == 0
    assert own.add(heart(spark, (1, at("09:00"), 1, "a"), (1, at("09:05"), 2, "b"), (2, at("09:01"), 3, "c")), 0)
    assert own.add(heart(spark, (2, at("08:00"), 4, "late"), (3, at("09:02"), 5, "d")), 1)
    assert not own.add(heart(spark, (3, at("10:00"), 6, "again")), 1)
    assert found(own.read(), "user_id", "current_path") == {(1, "b"), (2, "c"), (3, "d")}
    _, folders = own._folders()
    assert sorted(spark.read.parquet(f).count() for f in folders) == [2, 2]
    own.compact(F.col("last_active_at") >= F.lit(at("09:02")).cast("timestamp"))
    assert found(own.read(), "user_id", "current_path") == {(1, "b"), (3, "d")}
    assert len(own._folders()[1]) == 1
    assert not own.add(heart(spark, (1, at("11:00"), 7, "old batch")), 1)
    assert own.add(heart(spark, (1, at("11:00"), 7, "new"), (4, None, None, None)), 2)
    assert found(own.read(), "user_id", "current_path") == {(1, "new"), (3, "d"), (4, None)}


def test_a_batch_that_failed_half_way_is_not_seen(spark, tmp_path):
    own = activity.counters(spark, str(tmp_path / "t"), "attempt_id long", "switches")
    ones = table(spark, "attempt_id long, switches long", (1, 1), (1, 1), (2, 1))
    own.add(ones, 0)
    ones.write.parquet(f"{own.path}/rows/batch-1-lost")  # written, but the log never came
    assert found(own.read()) == {(1, 2), (2, 1)}
    assert own.add(ones, 1)
    assert found(own.read()) == {(1, 4), (2, 2)}


def test_a_stream_goes_on_after_a_restart(spark, tmp_path):
    schema = "event_id long, ts timestamp, user_id long, event_type string, k int"
    first, second = [(1, at("09:00"), 1, "view", 1), (2, at("09:01"), 1, "view", 2), (3, at("09:01"), 2, "click", 7)], [(4, at("08:59"), 1, "view", 1), (5, at("09:02"), 2, "click", 7)]
    inbox = str(tmp_path / "in")
    tabs = activity.counters(spark, str(tmp_path / "tabs"), "attempt_id long", "switches")
    ticks = activity.counters(spark, str(tmp_path / "ticks"), "attempt_id long, question int", "seconds")
    stream = arrive(spark, inbox, schema, first)
    assert found(tabs.drain(activity.tab_switches(stream))) == {(1, 2)}
    assert found(ticks.drain(activity.ticks_per_question(stream))) == {(2, 7, 1)}
    table(spark, schema, *second).coalesce(1).write.parquet(f"{inbox}/next")
    again = activity.counters(spark, str(tmp_path / "tabs"), "attempt_id long", "switches")
    assert found(again.drain(activity.tab_switches(stream))) == {(1, 3)}
    assert found(ticks.drain(activity.ticks_per_question(stream))) == {(2, 7, 2)}
    assert found(again.drain(activity.tab_switches(stream))) == {(1, 3)}


def test_job_updates_merge_by_field(spark, tmp_path):
    schema = "job_id long, ts timestamp, event_id long, progress int, message string, status string"
    stream = arrive(spark, str(tmp_path / "in"), schema, [(1, at("09:00"), 1, 10, "a", None), (2, at("09:00"), 4, None, None, None)], [(1, at("09:01"), 2, None, None, "running"), (1, at("08:00"), 9, 99, "old", "old")], [(1, at("09:01"), 3, 20, None, None)])
    own = activity.jobs(spark, str(tmp_path / "jobs"))
    got = activity.job_values(own.drain(activity.job_rows(stream)))
    assert found(got, "job_id", "progress", "message", "status") == {(1, 20, "a", "running"), (2, None, None, None)}


def test_nobody_is_paid_twice(spark, tmp_path):
    users = table(spark, "id long, grade int, is_paid boolean, is_premium boolean, standard string, premium_expiry timestamp_ntz, payment_id string, payment_status string", (1, 11, False, False, "11th", None, None, None), (2, 12, True, True, "12th", None, "old", "success"), (3, None, False, True, None, None, None, None))
    schema = "event_id long, user_id long, ts timestamp, grade int"
    now = F.lit("2024-04-01").cast("timestamp_ntz")
    stream = arrive(spark, str(tmp_path / "in"), schema, [(5, 1, at("10:00"), 12), (6, 1, at("09:30"), None), (7, 2, at("09:00"), 11)], [(4, 1, at("08:00"), 12), (8, 3, at("11:00"), None), (9, 99, at("11:00"), 11)])
    own = activity.payments(spark, str(tmp_path / "paid"))
    prepare = lambda rows, batch: activity.payment_rows(rows, users, batch)
    changes = activity.paid_users(own.drain(stream, prepare), users, now)
    assert found(changes, "id", "payment_id", "grade", "standard") == {(1, 6, 11, "11th"), (3, 8, None, None)}
    assert not own.add(prepare(table(spark, schema, (1, 3, at("07:00"), 12)), 1), 1)  # the batch comes again
    own.add(prepare(table(spark, schema, (10, 1, at("06:00"), 12)), 2), 2)  # another payment of one who is paid
    changes = activity.paid_users(own.read(), users, now)
    after = activity.with_payments(users, changes)
    assert after.columns == users.columns
    assert found(after, "id", "is_paid", "payment_id", "grade") == {(1, True, "6", 11), (2, True, "old", 12), (3, True, "8", None)}


def test_answers_are_graded_as_they_come_and_the_last_counts(spark, tmp_path):
    questions, tests, _, _ = exam(spark, 1)
    attempts = arrive(spark, str(tmp_path / "attempts"), "id long, test_id long, started_at timestamp", [(1, 1, at("09:00")), (2, 2, at("09:00"))], [(3, 1, at("12:00"))], [(4, 1, at("15:00"))])
    row = lambda a, q, n, picked, t: (a, q, (n,), picked, None, 1, at(t))
    answers = arrive(
        spark, str(tmp_path / "answers"), f"attempt_id long, question_id long, seq {SEQ}, selected_option string, answer_text string, time_spent_seconds int, answered_at timestamp",
        [row(1, 10, 1, "b", "09:05"), row(1, 11, 1, "a", "09:06"), row(2, 20, 1, "a", "08:00"), row(2, 10, 1, "a", "09:10"), row(77, 10, 1, "a", "09:00")],
        [row(1, 10, 2, "a", "09:20"), row(3, 12, 1, None, "12:10"), row(1, 11, 0, "b", "09:07")],
        [row(3, 12, 2, "a", "12:20"), row(4, 12, 1, "b", "15:01")],
        [row(1, 10, 3, "b", "09:30"), row(4, 12, 2, "a", "15:05")],
    )
    own = activity.graded_answers(spark, str(tmp_path / "graded"), SEQ)
    submitted = activity.submitted_answers(answers, attempts, most="3 hours", early="10 minutes")
    got = own.drain(submitted, lambda rows, _: activity.grade_batch(rows, questions, tests))
    # attempt 1's last word on question 10 came hours after the watermark, that on 20 before its attempt began
    assert found(got, "attempt_id", "question_id", "is_correct", "net") == {(1, 10, True, 4.0), (1, 11, True, 4.0), (3, 12, True, 4.0), (4, 12, True, 4.0)}


def test_alert_state_is_on_disk_and_goes_on_after_a_restart(spark, tmp_path):
    schema = "student_id long, test_id long"
    inbox, out = str(tmp_path / "in"), str(tmp_path / "out")
    stream = arrive(spark, inbox, schema, [(1, 1), (1, 1), (2, 1)])
    assert found(activity.alert_once(stream, out)) == {(1, 1), (2, 1)}
    table(spark, schema, (1, 1), (2, 2)).coalesce(1).write.parquet(f"{inbox}/next")
    got = activity.alert_once(stream, out)
    assert sorted(map(tuple, got.collect())) == [(1, 1), (2, 1), (2, 2)]
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("HDFSBackedStateStoreProvider")
    import os

    state = [f for d, _, names in os.walk(f"{out}/checkpoint/state") for f in names]
    assert any(f.endswith((".changelog", ".zip")) for f in state)
