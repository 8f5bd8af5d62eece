"""What keeps a query's cost in proportion to its input: no state in executors, no copies of products, enough partitions."""

import glob

import pytest
from conftest import DATA
from pyspark.sql import functions as F
from test_edges import arrive, at, found, table
from test_layout_streams import SEQ, exam, exchanges, no_broadcast  # noqa: F401

from gradeloom.operators import joins
from gradeloom.plans import catalog
from gradeloom.sources import layout
from gradeloom.streaming import activity


def states(spark):
    return glob.glob(f"{spark.conf.get('spark.checkpoint.dir')}/gradeloom/**/state", recursive=True)


@pytest.mark.parametrize("name", ["stream_grade", "stream_auto_submit"])
def test_streams_that_merge_into_tables_leave_no_state_in_executors(spark, name):
    before = len(states(spark))
    assert catalog.queries()[name](spark, DATA).count() > 0
    assert len(states(spark)) == before


def test_answers_wait_for_their_attempt_in_a_table(spark, tmp_path):
    begun = activity.begun_attempts(spark, str(tmp_path / "begun"))
    given = activity.last_answers(spark, str(tmp_path / "given"), SEQ)
    schema = f"attempt_id long, question_id long, seq {SEQ}, selected_option string, answer_text string"
    stream = arrive(spark, str(tmp_path / "in"), schema, [(1, 10, (2,), "b", None), (2, 10, (1,), "a", None)], [(1, 10, (1,), "a", None), (1, 11, (1,), None, "4"), (9, 10, (1,), "a", None)])
    assert given.drain(stream).join(begun.read(), "attempt_id").count() == 0
    begun.add(table(spark, "attempt_id long, test_id long", (1, 1), (1, 1), (2, 1), (3, 2)), 0)
    questions = table(spark, "id long, test_id long, question_type string, correct_option string, marks double", (10, 1, "SCQ", "A", 4.0), (11, 1, "NUMERIC", "4.0", 2.0))
    rows = activity.grade_batch(given.read().join(begun.read(), "attempt_id"), questions, table(spark, "id long, negative_marks double", (1, -0.5)))
    assert found(rows, "attempt_id", "question_id", "is_correct", "net") == {(1, 10, False, -0.5), (1, 11, True, 2.0), (2, 10, True, 4.0)}


def test_attempts_close_once_by_a_table(spark, tmp_path):
    own = activity.open_attempts(spark, str(tmp_path / "open"))
    schema = "attempt_id long, ts timestamp, duration_minutes int"
    stream = arrive(spark, str(tmp_path / "in"), schema, [(1, at("09:00"), 60), (2, at("09:30"), 600)], [(1, at("09:10"), 20), (3, at("10:00"), 5)], [(4, at("10:20"), 5), (5, at("09:50"), 20)])
    got = activity.closed_attempts(own.drain(stream, lambda rows, _: activity.start_rows(rows)))
    # attempt 5 ends at the mark itself and stays open
    assert {(r["attempt_id"], r["closed_ms"] // 60_000 % 1440) for r in got.collect()} == {(1, 9 * 60 + 30), (3, 10 * 60 + 5)}
    assert activity.closed_attempts(activity.open_attempts(spark, str(tmp_path / "none")).read()).count() == 0


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_shuffles_begin_with_partitions_by_the_size_of_the_tables(spark, tmp_path, monkeypatch):
    from gradeloom.sources import layout

    for name in layout.STAR:
        spark.range(1000).write.parquet(str(tmp_path / f"{name}.parquet"))
    monkeypatch.setattr(layout, "PART_BYTES", 100)
    n = layout.spread(spark, str(tmp_path))
    assert n > 100
    assert spark.range(10).repartition("id").rdd.getNumPartitions() <= n
    assert spark.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum") == str(n)
    monkeypatch.setattr(layout, "PART_BYTES", 1 << 40)
    catalog.queries()["test_stats"](spark, DATA)
    assert spark.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum") == "8"


def test_the_product_of_users_and_tests_is_not_shuffled(spark):
    from gradeloom.plans.grading import now
    from gradeloom.operators import joins

    users = table(spark, "id long, role string, is_superuser boolean, standard string, stream string, premium_expiry timestamp_ntz", (1, "student", False, "12th", "medical", None), (2, "student", False, "12th", "medical", at("09:00").replace(year=1999)), (3, "student", True, None, None, None), (4, "teacher", False, None, None, None))
    tests = table(spark, "id long, created_by long, is_published boolean, standard string, category string", (10, 4, True, "12th", "NEET"), (11, 9, True, "12th", "Medical"), (12, 4, False, "12th", "NEET"), (13, 9, True, "12th", "JEE"))
    attempts = table(spark, "student_id long, test_id long", (2, 11), (2, 11), (2, 13), (1, 10))
    got = joins.visible_tests(users, tests, attempts, now())
    assert sorted(map(tuple, got.collect())) == [(1, 10), (1, 11), (2, 11), (3, 10), (3, 11), (3, 12), (3, 13), (4, 10), (4, 12)]
    for line in plan_of(got).splitlines():
        assert not ("hashpartitioning(user_id" in line and "test_id" in line and "ENSURE" in line and "standard" in line)
    assert "hashpartitioning(standard" not in plan_of(got)


def test_a_key_meets_sheets_without_moving_their_product(spark):
    from gradeloom.operators import grading

    answers = table(spark, "sheet long, question int, answer string", (1, 0, "A"), (1, 1, "R"), (1, 2, None), (2, 1, "A"), (2, 9, "A"))
    key, scheme = table(spark, "question int, correct_answer string", (0, "A"), (1, "A"), (2, None), (3, "A")), table(spark, "question int, positive double, negative double", (0, 4.0, 1.0), (1, 5.0, 2.0), (2, 4.0, 3.0))
    got = grading.grade_by_key(answers, key, scheme)
    every = answers.select("sheet").distinct().crossJoin(key)
    assert found(got, "sheet", "question", "status", "points") == found(grading.grade_key(every, answers, scheme), "sheet", "question", "status", "points")
    assert len([x for x in plan_of(catalog.queries()["key_left_join_sheet"](spark, DATA)).splitlines() if "hashpartitioning" in x]) == 1


def test_statistics_by_test_read_no_answers(spark):
    assert "is_correct" not in plan_of(catalog.queries()["test_stats_refreshed"](spark, DATA))
    left = glob.glob(f"{spark.conf.get('spark.checkpoint.dir')}/gradeloom/rollups-*")
    catalog.queries()["teacher_kpis_refreshed"](spark, DATA)
    new = set(glob.glob(f"{spark.conf.get('spark.checkpoint.dir')}/gradeloom/rollups-*/*")) - {f for x in left for f in glob.glob(f"{x}/*")}
    assert {f.rsplit("/", 1)[1] for f in new} == {"tests"}


@pytest.mark.parametrize(("name", "kind"), [("sink_results_csv", "results"), ("sink_overwrite_children", "questions")])
def test_folders_of_a_sink_do_not_grow_with_tests(spark, name, kind, monkeypatch):
    from gradeloom.plans import scalars

    here = lambda: set(glob.glob(f"{spark.conf.get('spark.checkpoint.dir')}/gradeloom/{kind}-*"))
    before = here()
    assert catalog.queries()[name](spark, DATA).count() > 1
    (new,) = here() - before
    assert len(glob.glob(f"{new}/**/*test_id=*", recursive=True)) == 0


def test_stored_children_are_replaced_for_the_parents_that_come(spark, tmp_path):
    from gradeloom.sources import stored

    own = stored.store(table(spark, "id long, test_id long", (1, 1), (2, 1), (3, 2), (4, None)), str(tmp_path / "q"), "test_id", 4)
    own.replace(table(spark, "id long, test_id long", (9, 1), (10, 5)))
    assert found(own.read()) == {(9, 1), (10, 5), (3, 2), (4, None)}


def test_answers_carry_their_attempts_student(spark):
    line = [x for x in plan_of(catalog.queries()["student_subject_accuracy"](spark, DATA)).splitlines() if "orders.parquet" in x and "o_custkey" in x]
    assert len(line) == 1


def above_products(df):
    """What a plan does to rows after it has unfolded them."""
    head, unfolded, _ = plan_of(df).partition("Generate ")
    assert unfolded
    return [x for x in head.splitlines() if "Sort" in x or "Join" in x or "Aggregate" in x or "Exchange" in x]


def test_unattempted_questions_are_unfolded_last(spark, tmp_path, no_broadcast):
    questions, tests, attempts, answers = exam(spark, 30)
    more = table(spark, "attempt_id long, question_id long, selected_option string, answer_text string, time_spent_seconds int", (0, 10, "b", None, 9), (1, None, "a", None, 1), (2, 20, "a", None, 1))
    own = layout.write_papers(attempts.union(table(spark, "id long, test_id long", (8000, 3))), questions, tests, answers.union(more), str(tmp_path / "left_out"), 4, limit=10)
    rest = joins.unattempted_in_place(own.attempts, own.questions, own.answers)
    assert above_products(rest) == [] and exchanges(rest) == 0
    flat = [own.attempts.withColumnRenamed("attempt_id", "id"), questions, own.answers]
    assert sorted(map(tuple, rest.collect())) == sorted(map(tuple, joins.unattempted(*flat).collect()))
    assert {q for a, q in map(tuple, rest.collect()) if a == 8000} == {30, 31, 32, 33, 34}
    assert above_products(catalog.queries()["unattempted_questions"](spark, DATA)) == []


def test_questions_with_their_answers_are_unfolded_last(spark, tmp_path, no_broadcast):
    from gradeloom.operators import grading, reports

    questions, tests, attempts, answers = exam(spark, 30)
    more = table(spark, "attempt_id long, question_id long, selected_option string, answer_text string, time_spent_seconds int", (0, 10, "b", None, 9), (1, None, "a", None, 1), (2, 20, "a", None, 1))
    own = layout.write_papers(attempts.union(table(spark, "id long, test_id long", (8000, 3))), questions, tests, answers.union(more), str(tmp_path / "answer_rows"), 4, limit=10)
    graded = grading.grade_in_place(own.answers, own.questions)
    every = joins.questions_left_answers_in_place(own.attempts, own.questions, graded)
    assert above_products(every) == [] and exchanges(every) == 0
    plain = joins.questions_left_answers(own.attempts.withColumnRenamed("attempt_id", "id"), questions, graded, tests)
    rows = lambda df: sorted(map(repr, df.select(plain.columns).collect()))
    # a second answer to question 10 is a row of its own
    assert rows(every) == rows(plain) and every.where("attempt_id = 0 AND question_id = 10").count() == 2
    by_attempt = joins.answers_by_attempt_in_place(own.attempts, own.questions, graded)
    assert rows(by_attempt.select("attempt_id", F.inline("rows"))) == rows(plain)
    report = reports.attempt_report(by_attempt)
    assert "question_id" not in "".join(x for x in plan_of(report).splitlines() if "Generate" in x)
    assert {(r["attempt_id"], r["n"]) for r in report.collect()} == {(r[0], r[1]) for r in plain.groupBy("attempt_id").count().collect()}
    assert all([x["question_number"] for x in r["answers"]] == sorted(x["question_number"] for x in r["answers"]) for r in report.collect())
    for name in ("join_questions_left_answers", "attempt_report"):
        assert exchanges(catalog.queries()[name](spark, DATA)) == 0
    assert above_products(catalog.queries()["join_questions_left_answers"](spark, DATA)) == []


ODD = ("12) Of the Ärger, x1", " (3]\n THE  end", "[٣. 4 a", "é" * 310 + " a b c d e f g h i j k", "x" * 39, " " + "x" * 40 + "\n", "x" + " " * 38 + "y", "", "word " * 20 + "a" * 190 + " b1 c1 d1 e1 f1 g1 h1 i1", " ".join(f"w{i}" for i in range(99)))


def test_one_search_of_a_text_serves_its_hashes_and_anchor(spark):
    import hashlib
    import re

    from gradeloom.functions import text as t
    from gradeloom.operators import papers

    schema = "id long, question_text string, options map<string,string>, subject string, section string, question_type string, question_number int, has_visual boolean, has_bbox boolean"
    prints = papers.fingerprints(table(spark, schema, *((i, x, {"A": "(a) Über 5"}, "s", None, "SCQ", None, False, False) for i, x in enumerate(ODD))))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for r in prints.collect():
        x = r["question_text"]
        tokens = re.findall("[a-z0-9]+", x.lower())
        assert r["anchor"] == " ".join([*tokens, "a", "ber", "5"])
        assert r["content_hash"] == (sha("".join(c for c in x.lower() if c.isalnum()) + "#aüber5") if x else "")
        assert r["guard_hash"] == (sha(re.sub("[^a-z0-9]", "", re.sub(r"^[(\[]?\d+[).\]]", "", x.lower().strip())) + "#ber5") if x else "")
        core = [w for w in tokens if w not in t.STOP_WORDS and not w.isdigit()][:8]
        assert r["intent"] == f"s|scq|{' '.join(core)}"
        assert r["confidence"] == (0.55 if len(x.strip()) >= 40 else 0.35)
    shown = plan_of(prints.select("content_hash", "guard_hash", "anchor"))
    assert len(re.findall(r"regexp_replace\(lower\(question_text#\d+\), \[\^a-z0-9\]\+", shown)) == 1
    assert "regexp_extract_all" not in shown


def test_near_duplicates_need_no_hashes_of_contents(spark):
    here = lambda name: set(glob.glob(f"{spark.conf.get('spark.checkpoint.dir')}/gradeloom/{name}-*"))
    before = {name: here(name) for name in ("signatures", "classes")}
    assert catalog.queries()["near_duplicate_pairs"](spark, DATA).count() > 0
    columns = {name: spark.read.parquet(*(here(name) - before[name])).columns for name in before}
    assert "content_hash" not in columns["signatures"] and "guard_hash" not in columns["signatures"]
    assert "intent" not in columns["classes"]  # a number stands for it in the shuffles that follow
