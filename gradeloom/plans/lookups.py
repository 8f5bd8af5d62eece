"""Queries: scans, filters and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradeloom.operators import aggregates as agg
from gradeloom.operators import joins as op
from gradeloom.operators.grading import grade_in_place
from gradeloom.plans.grading import GRADED, RELEVANT, now, papers
from gradeloom.plans.registry import query
from gradeloom.sources import roles

STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
TITLE = r"array_to_string(list_transform(regexp_extract_all({0}, '[\p{{Lu}}\p{{Ll}}\p{{Lt}}]+|[^\p{{Lu}}\p{{Ll}}\p{{Lt}}]+'), lambda w: upper(w[1]) || lower(w[2:])), '')"


def sql_subject_key(c: str) -> str:
    """Subjects with every run of letters capitalised."""
    x = STRIP.format(f"coalesce(nullif({c}, ''), 'General')")
    return TITLE.format(f"({x})")


def sql_section_key(c: str) -> str:
    return f"lower({STRIP.format(f'''coalesce(nullif({c}, ''), 'Section A')''')})"


CANONICAL = "CASE WHEN {0} IN ('PHY','PHYY','PH') THEN 'PHYSICS' WHEN {0} IN ('CHEM','CHM','CH') THEN 'CHEMISTRY' WHEN {0} IN ('MATH','MATHS','MAT','MA') THEN 'MATHEMATICS' WHEN {0} IN ('BIO','BIOL','BI') THEN 'BIOLOGY' ELSE {0} END"


def sql_canonical(c: str) -> str:
    return CANONICAL.format(f"upper({STRIP.format(f'''coalesce({c}, '')''')})")


@query("SELECT * FROM tests")
def scan_entity(spark, d):
    return roles.tests(spark, d)


@query("SELECT id, student_id, test_id, status, score FROM attempts WHERE id = 77")
def lookup_by_key(spark, d):
    return roles.attempts(spark, d).where("id = 77").select("id", "student_id", "test_id", "status", "score")


@query("SELECT id, question_text, subject FROM questions WHERE subject = 'Physics' AND contains(question_text, 'ing') ORDER BY id LIMIT 20 OFFSET 1")
def filter_questions(spark, d):
    return op.filter_questions(roles.questions(spark, d), subject="Physics", search="ing").orderBy("id").offset(1).limit(20).select("id", "question_text", "subject")


@query("SELECT id, question_text FROM questions WHERE id IN (3, 14, 15, 92, 65, 35)")
def filter_id_list(spark, d):
    return roles.questions(spark, d).where(F.col("id").isin(3, 14, 15, 92, 65, 35)).select("id", "question_text")


@query("SELECT id, title FROM items WHERE owner_id = 7")
def filter_owned(spark, d):
    return op.owned(roles.items(spark, d), "owner_id", 7, False).select("id", "title")


VISIBLE = """SELECT u.id AS user_id, t.id AS test_id FROM users u, tests t WHERE CASE WHEN u.is_superuser OR u.role = 'admin' THEN true WHEN u.role = 'teacher' THEN t.created_by = u.id
  ELSE t.is_published AND t.standard = u.standard AND CASE lower(u.stream) WHEN 'engineering' THEN t.category IN ('JEE', 'JEE Mains', 'JEE Advanced') WHEN 'medical' THEN t.category IN ('NEET', 'Medical', 'NEET (Medical)') WHEN 'foundation' THEN t.category = 'Foundation' ELSE false END
    AND (NOT coalesce(u.premium_expiry < TIMESTAMP '2000-06-30 12:00:00', false) OR EXISTS (SELECT 1 FROM attempts a WHERE a.student_id = u.id AND a.test_id = t.id)) END"""


def visible(spark, d):
    return op.visible_tests(roles.users(spark, d), roles.tests(spark, d), roles.attempts(spark, d), now())


@query(VISIBLE)
def visible_tests(spark, d):
    return visible(spark, d)


@query("SELECT DISTINCT a.student_id, a.test_id FROM attempts a JOIN users u ON u.id = a.student_id WHERE u.role = 'student' AND u.premium_expiry < TIMESTAMP '2000-06-30 12:00:00'")
def visible_tests_expired(spark, d):
    return op.expired_tests(roles.users(spark, d), roles.attempts(spark, d), now())


@query("SELECT id, email, role FROM users WHERE role IN ('student', 'teacher') AND NOT is_superuser")
def visible_users(spark, d):
    return op.visible_users(roles.users(spark, d)).select("id", "email", "role")


@query("SELECT id, last_active_at FROM users WHERE last_active_at >= TIMESTAMP '2000-06-30 11:55:00'")
def active_since(spark, d):
    return roles.users(spark, d).where(F.col("last_active_at") >= now() - F.expr("INTERVAL 5 MINUTES")).select("id", "last_active_at")


@query("SELECT s.id, count(a.id) AS n, NOT is_premium AND NOT is_superuser AND count(a.id) >= 3 AS blocked FROM students s LEFT JOIN attempts a ON a.student_id = s.id GROUP BY s.id, is_premium, is_superuser")
def quota_gate(spark, d):
    return op.quota_gate(roles.students(spark, d), roles.attempts(spark, d)).select("id", "n", "blocked")


@query("SELECT id, scheduled_at FROM tests WHERE scheduled_at > TIMESTAMP '2000-06-30 12:00:00'")
def scheduled_pending(spark, d):
    return roles.tests(spark, d).where(F.col("scheduled_at") > now()).select("id", "scheduled_at")


@query("SELECT id, CASE WHEN is_published THEN 'Published' ELSE 'Draft' END AS label FROM tests")
def published_flag_split(spark, d):
    return roles.tests(spark, d).select("id", F.when(F.col("is_published"), "Published").otherwise("Draft").alias("label"))


@query("SELECT id FROM tests WHERE is_symmetrical IS DISTINCT FROM false")
def publish_eligibility(spark, d):
    return roles.tests(spark, d).where(~F.col("is_symmetrical").eqNullSafe(False)).select("id")


@query("SELECT id, test_id FROM configs WHERE test_id = 3 OR json_extract_string(parsing_report, '$.job_id') = 'job7'")
def config_by_json_key(spark, d):
    return roles.configs(spark, d).where((F.col("test_id") == 3) | (F.get_json_object("parsing_report", "$.job_id") == "job7")).select("id", "test_id")


@query(f"SELECT s.id, q.subject FROM students s JOIN (SELECT DISTINCT coalesce(subject, 'General') AS subject FROM questions) q ON list_contains({RELEVANT}, q.subject) OR q.subject = 'General'")
def relevant_subjects(spark, d):
    own = roles.students(spark, d).select("id", F.explode(F.concat(agg.relevant_subjects(F.col("stream")), F.array(F.lit("General")))).alias("subject"))
    there = roles.questions(spark, d).select(F.coalesce("subject", F.lit("General")).alias("subject")).distinct()
    return own.join(there, "subject", "left_semi").select("id", "subject")


@query("SELECT a.attempt_id, a.question_id, q.subject, q.marks FROM answers a JOIN questions q ON q.id = a.question_id")
def join_answers_questions(spark, d):
    q = roles.questions(spark, d).select(F.col("id").alias("question_id"), "subject", "marks")
    return roles.answers(spark, d).join(q, "question_id").select("attempt_id", "question_id", "subject", "marks")


LEFT_ANSWERS = f"""WITH {GRADED} SELECT a.id AS attempt_id, q.id AS question_id, q.question_number, coalesce(g.is_correct, false) AS is_correct, coalesce(g.marks_obtained, 0.0) AS marks_obtained, coalesce(g.time_spent_seconds, 0) AS time_spent_seconds,
  g.selected_option, g.answer_text, q.correct_option, CASE WHEN q.question_type IN ('NUMERIC', 'INTEGER') THEN q.correct_option END AS correct_answer_text, q.marks, t.question_paper_url
  FROM attempts a JOIN tests t ON t.id = a.test_id JOIN questions q ON q.test_id = a.test_id LEFT JOIN graded g ON g.attempt_id = a.id AND g.question_id = q.id"""


def graded_papers(spark, d):
    """Attempts, questions and graded answers of the layout."""
    own = papers(spark, d)
    return own.attempts, own.questions, grade_in_place(own.answers, own.questions)


@query(LEFT_ANSWERS)
def join_questions_left_answers(spark, d):
    return op.questions_left_answers_in_place(*graded_papers(spark, d))


@query("SELECT a.id, a.student_id, CASE WHEN u.id IS NULL THEN 'Unknown' ELSE u.full_name END AS student_name, CASE WHEN u.id IS NULL THEN 'Unknown' ELSE u.email END AS student_email FROM attempts a LEFT JOIN users u ON u.id = a.student_id")
def join_attempt_student(spark, d):
    return op.attempt_student(roles.attempts(spark, d), roles.users(spark, d)).select("id", "student_id", "student_name", "student_email")


@query("SELECT t.id, t.title, coalesce(n, 0) AS submission_count, coalesce(m, 0.0) AS average_score FROM tests t LEFT JOIN (SELECT test_id, count(*) AS n, round(avg(coalesce(score, 0)), 4) AS m FROM attempts GROUP BY 1) s ON s.test_id = t.id")
def join_test_stats(spark, d):
    stats = agg.test_stats(roles.attempts(spark, d))
    return op.tests_with_stats(roles.tests(spark, d), stats).select("id", "title", "submission_count", "average_score")


@query("""SELECT t.id, CAST(json_extract_string(c.r, '$.is_symmetrical') AS BOOLEAN) AS is_symmetrical, json_extract_string(c.r, '$.symmetry_message') AS symmetry_message FROM tests t LEFT JOIN (SELECT DISTINCT ON (test_id) test_id, parsing_report AS r FROM configs ORDER BY test_id, created_at, id) c ON c.test_id = t.id""")
def join_test_config_first(spark, d):
    return op.tests_with_config(roles.tests(spark, d), roles.configs(spark, d)).select("id", "is_symmetrical", "symmetry_message")


@query("SELECT id, title FROM tests WHERE id IN (SELECT test_id FROM attempts WHERE student_id = 5)")
def semi_attempted_tests(spark, d):
    own = roles.attempts(spark, d).where("student_id = 5").select(F.col("test_id").alias("id"))
    return roles.tests(spark, d).join(own, "id", "left_semi").select("id", "title")


@query("SELECT q.id, c.name AS chapter, coalesce(s.name, 'General') AS subject_name FROM questions q LEFT JOIN chapters c ON c.id = q.chapter_id LEFT JOIN subjects s ON s.id = c.subject_id")
def join_hierarchy(spark, d):
    return op.question_hierarchy(roles.questions(spark, d), roles.chapters(spark, d), roles.subjects(spark, d))


@query("""SELECT a.id AS attempt_id, a.student_id, a.test_id, t.title, coalesce(s.name, 'General') AS subject_name FROM attempts a LEFT JOIN tests t ON t.id = a.test_id LEFT JOIN subjects s ON s.id = t.subject_id""")
def join_attempt_subject(spark, d):
    return op.attempt_subject(roles.attempts(spark, d), roles.tests(spark, d), roles.subjects(spark, d))


MATCH = f"""bp AS (SELECT *, {sql_subject_key('subject')} AS s, {sql_section_key('section_name')} AS bk FROM blueprint),
qk AS (SELECT id, test_id, {sql_subject_key('subject')} AS s, coalesce(question_number, 0) AS no, {sql_section_key('section')} AS k FROM questions),
rm AS (SELECT DISTINCT ON (qk.id) qk.id, qk.test_id, qk.s AS subject, section_name, q_count, 'range' AS how FROM qk JOIN bp ON bp.test_id = qk.test_id AND bp.s = qk.s AND no BETWEEN start_q AND end_q ORDER BY qk.id, start_q, end_q, pos),
nm AS (SELECT DISTINCT ON (qk.id) qk.id, qk.test_id, qk.s AS subject, section_name, q_count, 'name' AS how FROM qk JOIN bp ON bp.test_id = qk.test_id AND bp.s = qk.s AND bp.bk = qk.k WHERE qk.id NOT IN (SELECT id FROM rm) ORDER BY qk.id, start_q, end_q, pos),
matched AS (SELECT * FROM rm UNION ALL SELECT * FROM nm)"""


@query(f"WITH {MATCH} SELECT id, test_id, subject, section_name, q_count FROM rm")
def range_join_blueprint(spark, d):
    return op.range_match(roles.questions(spark, d), roles.blueprint(spark, d)).drop("how")


@query(f"WITH {MATCH} SELECT * FROM matched")
def fallback_join_section(spark, d):
    return op.matched_sections(roles.questions(spark, d), roles.blueprint(spark, d))


NAME = f"upper({STRIP.format('''coalesce({}, 'None')''')})"


@query(f"""SELECT DISTINCT ON (q.id) q.id, q.test_id, b.subject, b.section_name FROM questions q JOIN blueprint b ON b.test_id = q.test_id AND {sql_canonical('q.subject')} = {sql_canonical('b.subject')}
  AND (contains({NAME.format('q.section')}, {NAME.format('b.section_name')}) OR contains({NAME.format('b.section_name')}, {NAME.format('q.section')})) ORDER BY q.id, b.pos""")
def loose_join_section(spark, d):
    return op.loose_sections(roles.questions(spark, d), roles.blueprint(spark, d))


@query(f"""SELECT q.id, q.test_id, {sql_subject_key('q.subject')} AS subject, {sql_section_key('q.section')} AS section, b.q_count FROM questions q JOIN blueprint b ON b.test_id = q.test_id AND {sql_subject_key('q.subject')} = {sql_subject_key('b.subject')} AND {sql_section_key('q.section')} = {sql_section_key('b.section_name')}""")
def blueprint_membership(spark, d):
    return op.in_blueprint(roles.questions(spark, d), roles.blueprint(spark, d))


@query("SELECT a.id AS attempt_id, q.id AS question_id FROM attempts a JOIN questions q ON q.test_id = a.test_id WHERE NOT EXISTS (SELECT 1 FROM answers x WHERE x.attempt_id = a.id AND x.question_id = q.id)")
def unattempted_questions(spark, d):
    own = papers(spark, d)
    return op.unattempted_in_place(own.attempts, own.questions, own.answers)


@query("""SELECT a.id AS attempt_id, a.student_id, a.test_id, coalesce(nullif(u.full_name, ''), u.email) AS student_name, t.title AS test_title, coalesce(w.email, '') AS teacher_email, a.started_at
  FROM (SELECT DISTINCT ON (student_id, test_id) * FROM attempts ORDER BY student_id, test_id, started_at, id) a JOIN tests t ON t.id = a.test_id LEFT JOIN users u ON u.id = a.student_id LEFT JOIN users w ON w.id = t.created_by""")
def first_attempt(spark, d):
    return op.first_attempts(roles.attempts(spark, d), roles.tests(spark, d), roles.users(spark, d))
