"""Hand-made rows for the branches that the tables don't reach."""

import collections
import random

import pytest
from conftest import DATA
from pyspark.sql import functions as F

from gradeloom.functions import text as t
from gradeloom.operators import extraction as ex
from gradeloom.operators import grading, joins, maintenance, papers
from gradeloom.operators.aggregates import attempt_summary
from gradeloom.plans import catalog
from gradeloom.plans import papers as plans
from gradeloom.sources import roles


@pytest.mark.parametrize(
    ("kind", "selected", "answer", "key", "expected"),
    [
        ("MCQ", " a", None, "A ", True), ("SCQ", "", None, "", False), ("MCQ", None, None, "A", False), ("SCQ", "B", None, "A", False),
        ("NUMERIC", None, "4", "4.0", True), ("NUMERIC", None, "4d", "4", False), ("INTEGER", None, "4d", "4d", True), ("NUMERIC", None, "nan", "NaN", False),
        ("NUMERIC", None, "", "0", False), ("INTEGER", None, " 7 ", "7", True), ("NUMERIC", None, "1e2", "100", True), ("ESSAY", "A", "A", "A", False), ("NUMERIC", None, None, "1", False), ("MCQ", "A", None, None, False),
    ],
)
def test_is_correct(spark, kind, selected, answer, key, expected):
    row = spark.createDataFrame([(kind, selected, answer, key)], "kind string, s string, a string, k string")
    assert row.select(grading.is_correct(*map(F.col, ("kind", "s", "a", "k")))).first()[0] is expected


def graded(spark, negative, answers):
    questions = spark.createDataFrame([(1, 1, "SCQ", "A", 4.0, "Physics", None), (2, 1, "NUMERIC", "2", 3.0, None, None), (3, 1, "ESSAY", "x", 5.0, "", None), (9, 2, "SCQ", "A", 4.0, None, None)], "id long, test_id long, question_type string, correct_option string, marks double, subject string, section string")
    attempts = spark.createDataFrame([(10, 1)], "id long, test_id long")
    tests = spark.createDataFrame([(1, negative)], "id long, negative_marks double")
    rows = spark.createDataFrame([(10, *a) for a in answers], "attempt_id long, question_id long, selected_option string, answer_text string")
    return grading.grade_answers(rows, questions, attempts, tests)


@pytest.mark.parametrize(("negative", "net", "shown"), [(0.0, -1.0, -1.0), (None, -1.0, -1.0), (-0.5, -0.5, 0.0), (-1.75, -1.75, -1.0)])
def test_penalty_is_truncated_in_the_row_only(spark, negative, net, shown):
    row = graded(spark, negative, [(1, "B", None)]).first()
    assert (row["net"], row["marks_obtained"]) == (net, shown)


def test_unknown_questions_are_skipped_and_scores_truncate_toward_zero(spark):
    rows = graded(spark, -1.75, [(1, "B", None), (9, "A", None), (77, "A", None), (3, None, ""), (2, None, None)])
    assert {r["question_id"]: r["attempted"] for r in rows.collect()} == {1: True, 3: True, 2: False}
    assert grading.attempt_scores(rows).first()["score"] == -3
    summary = attempt_summary(rows).first()
    assert (summary["correct"], summary["incorrect"], summary["accuracy"]) == (0, 1, 0)  # an empty answer is reported as none


def hashes(spark, rows):
    df = spark.createDataFrame(rows, "id long, text string, options map<string,string>")
    return [tuple(r) for r in df.select(t.content_hash(F.col("text"), F.map_values("options")), t.guard_hash(F.col("text"), F.map_values("options"))).collect()]


def test_hashes(spark):
    a, b, c, d = hashes(spark, [(1, "What is É?", {"A": "(a) One", "B": "two"}), (2, "what  is é", {"A": "TWO", "B": "a one"}), (3, "12) What is É?", {"A": "one", "B": "b. two"}), (4, "", None)])
    assert a[0] == b[0]
    assert a[1] == c[1]
    assert a[0] != c[0]
    assert d == ("", "")


def prints(spark, rows):
    df = spark.createDataFrame(rows, "id long, test_id long, question_text string, page_number int, question_number int")
    df = df.selectExpr("*", "'Physics' AS subject", "'Section A' AS section", "CAST(NULL AS map<string,string>) AS options", "'SCQ' AS question_type", "false AS has_visual", "false AS has_bbox")
    return papers.fingerprints(df)


WORDS = "alpha beta gamma delta epsilon zeta eta theta " + " ".join(f"word{i}" for i in range(32))


def test_staging_compares_with_rows_that_stayed_only(spark):
    b, c = WORDS + " extra1 extra2", WORDS.replace("word31", "other") + " extra1 extra2 extra3"  # near b, not near the first
    rows = prints(spark, [(1, 1, WORDS, 1, 1), (2, 1, b, 1, 2), (3, 1, c + " extra4", 1, 3), (4, 1, "Quite different", 2, 4), (5, 1, "Over the quota", 2, 5), (6, 2, WORDS, 1, 1)])
    plan = spark.createDataFrame([(1, "Physics", "section a", 0, 3), (2, "physics", "Section A", 0, 1)], "test_id long, subject string, section_name string, pos int, q_count int")
    kept = {(r["test_id"], r["id"]) for r in papers.stage(rows, plan).collect()}
    assert kept == {(1, 1), (1, 3), (1, 4), (2, 6)}


def test_trim_by_hashes_and_quota(spark):
    texts = [("Copy one", 1), ("copy ONE!", 2), *((f"Copy number {i % 3}", 3) for i in range(40)), ("Other text", 4), ("One too many", 5)]
    rows = prints(spark, [(i, 1, x, page, i) for i, (x, page) in enumerate(texts)])
    plan = spark.createDataFrame([(1, "Physics", "Section A", 0, 5)], "test_id long, subject string, section_name string, pos int, q_count int")
    assert {r["id"] for r in papers.trim(rows, plan).collect()} == {0, 2, 3, 4, 42}


def test_trim_matches_a_plain_pass(spark):
    r = random.Random(3)
    rows = prints(spark, [(i, i % 5, r.choice(["({0}) {1}", "{0}{1}", "{0}. {1}", "{1}", ""]).format(r.randint(1, 6), r.choice(["foo", "bar", "baz"])), 1, i) for i in range(400)])
    plan = spark.createDataFrame([(i, "Physics", "Section A", 0, 2 + 2 * i) for i in range(5)], "test_id long, subject string, section_name string, pos int, q_count int")
    kept, taken = collections.defaultdict(list), collections.defaultdict(set)
    for x in rows.orderBy("id").collect():
        h = {("c", x["content_hash"]), ("g", x["guard_hash"])} - {("c", ""), ("g", "")}
        if len(kept[x["test_id"]]) < 2 + 2 * x["test_id"] and not h & taken[x["test_id"]]:
            kept[x["test_id"]].append(x["id"])
            taken[x["test_id"]] |= h
    assert {x["id"] for x in papers.trim(rows, plan).collect()} == {i for own in kept.values() for i in own}


@pytest.mark.parametrize("name", ["stage_questions", "greedy_dedup_quota"])
def test_staging_by_whole_tests_and_their_blueprint(spark, name):
    got = catalog.queries()[name](spark, DATA).collect()
    room = {(r["test_id"], r["section_name"]): r["q_count"] for r in roles.blueprint(spark, DATA).collect()}
    names = {s.lower(): s for _, s in room}
    count = collections.Counter((r["test_id"], r["place"]) for r in got)
    assert {t for t, _ in count} <= {t for t, _ in room}
    assert all(n <= room[t, names[place.split("/")[1]]] for (t, place), n in count.items())
    hashes = {r["id"]: r["content_hash"] for r in plans.prints(spark, DATA).select("id", "content_hash").collect()} if name == "greedy_dedup_quota" else {}
    seen = [(r["test_id"], hashes[r["id"]]) for r in got if hashes.get(r["id"])]
    assert len(seen) == len(set(seen))


def test_near_duplicates(spark):
    rows = prints(spark, [(1, 1, WORDS, 1, 1), (2, 1, WORDS, 1, 2), (3, 1, WORDS + " more", 1, 3), (4, 1, "alpha beta", 1, 4)])
    assert {tuple(r) for r in papers.near_duplicate_pairs(papers.signatures(rows)).collect()} == {(2, 1), (3, 1)}


@pytest.mark.parametrize(
    ("text", "parses", "first"),
    [
        ('[{"a": 1,},{"a": 2}]', True, 1), ('see ```json\n[{"a": 3}]\n```', True, 3), ('{"questions": [{"a": 4}]}', True, 4), ('{"data": [{"a": 5}]}', True, 5), ('{"a": 6}', True, 6),
        ('[{"a": 7}', True, 7), (r'[{"a": 8, "b": "\dot"}]', True, 8), ("plain prose", False, None), (None, False, None), ("", False, None),
    ],
)
def test_repair_and_unwrap(spark, text, parses, first):
    rows = spark.createDataFrame([(1, text)], "id long, response_text string")
    got = ex.elements(rows).select(F.try_variant_get("item", "$.a", "int")).collect()
    assert bool(got) is parses
    assert (got[0][0] if got else None) == first


@pytest.mark.parametrize(("box", "expected"), [('{"x0":1,"y0":2,"x1":3,"y1":4}', (1, 2, 3, 4)), ('{"bbox":{"x0":1,"y0":2,"x1":3,"y1":4}}', (1, 2, 3, 4)), ("[1,2,3,4]", (1, 2, 3, 4)), ("[1,2,3]", None), ('{"x0":"a","y0":2,"x1":3,"y1":4}', None), (None, None)])
def test_bbox(spark, box, expected):
    got = spark.createDataFrame([(box,)], "b string").select(ex.normalize_bbox(F.col("b")).alias("b")).first()["b"]
    assert (tuple(got) if got else None) == expected


def test_visibility(spark):
    users = spark.createDataFrame(
        [(1, "student", False, None, "medical", None), (2, "student", False, "11th", None, None), (3, "student", False, "11th", "arts", None), (4, "student", False, "11th", "Medical", "2000-01-01"), (5, "student", False, "11th", "medical", "2000-01-01"), (6, "teacher", False, None, None, None), (7, "student", True, None, None, None)],
        "id long, role string, is_superuser boolean, standard string, stream string, premium_expiry string",
    ).withColumn("premium_expiry", F.col("premium_expiry").cast("timestamp_ntz"))
    tests = spark.createDataFrame([(1, 6, True, "11th", "NEET"), (2, 8, False, "11th", "NEET")], "id long, created_by long, is_published boolean, standard string, category string")
    attempts = spark.createDataFrame([(5, 1)], "student_id long, test_id long")
    seen = {tuple(r) for r in joins.visible_tests(users, tests, attempts, F.lit("2000-06-01").cast("timestamp_ntz")).collect()}
    assert seen == {(5, 1), (6, 1), (7, 1), (7, 2)}


def test_symmetry(spark):
    plan = spark.createDataFrame([(1, "Physics", "A", 0, 2), (1, "Biology", "A", 1, 1), (2, "Physics", "A", 0, 1)], "test_id long, subject string, section_name string, pos int, q_count int")
    saved = spark.createDataFrame([(1, "physics", "a"), (1, "Physics", "A"), (1, "Biology", "a"), (2, "Physics", "A")], "test_id long, subject string, section string")
    got = {r["test_id"]: (r["is_symmetrical"], r["symmetry_message"]) for r in papers.symmetry_report(plan, saved).collect()}
    assert got == {1: (False, "Imbalance: Biology(1) != 2"), 2: (True, "Success")}


def test_upsert_keeps_what_is_not_given(spark):
    schema = "key string, value string, description string"
    got = maintenance.upsert(spark.createDataFrame([("a", "1", "x"), ("b", "2", None)], schema), spark.createDataFrame([("a", None, "y"), ("c", "3", None)], schema), "key")
    assert {tuple(r) for r in got.collect()} == {("a", "1", "y"), ("b", "2", None), ("c", "3", None)}


def test_clean_page_text(spark):
    raw = "a\u0007b c  \n\n\n\nd​ \n"
    assert spark.createDataFrame([(raw,)], "x string").select(t.clean_page_text(F.col("x"))).first()[0] == "a b c\n\nd"
