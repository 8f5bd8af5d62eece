"""Queries: blueprints, ranking, duplicates and reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gradeloom.functions import text as t
from gradeloom.operators import aggregates as agg
from gradeloom.operators import joins, reports
from gradeloom.operators import papers as op
from gradeloom.plans.grading import FIVE, GRADED, SUBJECT_SCORES, graded
from gradeloom.plans.lookups import LEFT_ANSWERS, MATCH, VISIBLE, graded_papers, sql_section_key, sql_subject_key, visible
from gradeloom.plans.registry import query
from gradeloom.sources import pages, roles
from gradeloom.sources.files import folder, written


def plan(spark, d):
    return roles.blueprint(spark, d)


TARGETS = f"""bk AS (SELECT test_id, {sql_subject_key('subject')} AS subject, {sql_section_key('section_name')} AS section, section_name, q_count, pos FROM blueprint),
tg AS (SELECT *, sum(expected) OVER (PARTITION BY test_id, subject) AS subject_expected, min(pos) OVER (PARTITION BY test_id, subject) AS subject_pos
  FROM (SELECT test_id, subject, section, arg_max(q_count, pos) AS expected, arg_min(section_name, pos) AS label, min(pos) AS pos FROM bk GROUP BY ALL))"""


@query(f"WITH {TARGETS} SELECT test_id, subject, section, expected, CAST(subject_expected AS BIGINT) AS subject_expected FROM tg")
def blueprint_targets(spark, d):
    return op.blueprint_targets(plan(spark, d)).select("test_id", "subject", "section", "expected", "subject_expected")


def saved(spark, d):
    """The questions that the quotas keep, under their sections' names, worked out once."""
    return written(kept(spark, d), "saved")


def kept(spark, d):
    trimmed = op.quota_trim(joins.matched_sections(roles.questions(spark, d), plan(spark, d)), roles.questions(spark, d))
    return trimmed.select("test_id", "id", "subject", F.col("section_name").alias("section"), "rank")


SAVED = f"""{MATCH}, saved AS (SELECT * FROM (SELECT m.test_id, m.id, m.subject, m.section_name AS section, m.q_count, row_number() OVER (PARTITION BY m.test_id, m.subject, m.section_name ORDER BY coalesce(q.page_number, 0), coalesce(q.question_number, 0), q.id) AS rank
  FROM matched m JOIN questions q ON q.id = m.id) WHERE rank <= q_count)"""
CONFORM = f"""{SAVED}, {TARGETS}, cf AS (SELECT tg.*, (SELECT count(*) FROM saved x WHERE x.test_id = tg.test_id AND x.subject = tg.subject AND {sql_section_key('x.section')} = tg.section) AS actual,
  (SELECT count(*) FROM saved x WHERE x.test_id = tg.test_id AND x.subject = tg.subject) AS subject_actual FROM tg),
cm AS (SELECT *, subject || ' / ' || label || ': ' || CASE WHEN actual < expected THEN 'Under' WHEN actual > expected THEN 'Over' END || '-extracted (' || actual || '/' || expected || ')' AS message,
  subject || ': ' || CASE WHEN subject_actual < subject_expected THEN 'Under' WHEN subject_actual > subject_expected THEN 'Over' END || '-extracted (' || subject_actual || '/' || CAST(subject_expected AS BIGINT) || ')' AS subject_message FROM cf)"""


@query(f"WITH {CONFORM} SELECT test_id, subject, section, expected, actual, message FROM cm")
def section_conformance(spark, d):
    return op.conformance(plan(spark, d), saved(spark, d)).select("test_id", "subject", "section", "expected", "actual", "message")


@query(f"WITH {CONFORM} SELECT DISTINCT test_id, subject, CAST(subject_expected AS BIGINT) AS expected, subject_actual AS actual, subject_message AS message FROM cm")
def subject_conformance(spark, d):
    return op.conformance(plan(spark, d), saved(spark, d)).select("test_id", "subject", F.col("subject_expected").alias("expected"), F.col("subject_actual").alias("actual"), F.col("subject_message").alias("message")).distinct()


BALANCE = f"""{CONFORM}, told AS (SELECT test_id, coalesce(list(message ORDER BY pos) FILTER (message IS NOT NULL), []) || coalesce((SELECT list(m ORDER BY p) FROM (SELECT DISTINCT subject_message AS m, subject_pos AS p FROM cm y WHERE y.test_id = cm.test_id AND subject_message IS NOT NULL)), []) AS errors FROM cm GROUP BY test_id),
n AS (SELECT b.test_id, (SELECT count(*) FROM saved s WHERE s.test_id = b.test_id AND s.subject = 'Physics') AS p, (SELECT count(*) FROM saved s WHERE s.test_id = b.test_id AND s.subject = 'Chemistry') AS c, (SELECT count(*) FROM saved s WHERE s.test_id = b.test_id AND s.subject = 'Biology') AS b,
  bool_or(b.subject = 'Physics') AS hp, bool_or(b.subject = 'Chemistry') AS hc, bool_or(b.subject = 'Biology') AS hb FROM blueprint b GROUP BY b.test_id),
b0 AS (SELECT n.*, errors, hp AND hc AND p <> c AS off_pc, hb AND (hp OR hc) AND b <> CASE WHEN hp THEN p ELSE c END AS off_b FROM n JOIN told USING (test_id)),
b1 AS (SELECT *, CASE WHEN off_pc AND NOT contains(array_to_string(errors, chr(10)), 'Physics') AND NOT contains(array_to_string(errors, chr(10)), 'Chemistry') THEN 'Imbalance: Physics(' || p || ') != Chemistry(' || c || ')' END AS pc_message,
  CASE WHEN off_b AND NOT contains(array_to_string(errors, chr(10)), 'Biology') THEN 'Imbalance: Biology(' || b || ') != ' || CASE WHEN hp THEN p ELSE c END END AS b_message FROM b0)"""


@query(f"WITH {BALANCE} SELECT test_id, off_pc, off_b, pc_message, b_message FROM b1")
def subject_balance(spark, d):
    return op.subject_balance(plan(spark, d), saved(spark, d)).select("test_id", "off_pc", "off_b", "pc_message", "b_message")


SYMMETRY = f"""{BALANCE}, sy AS (SELECT test_id, len(errors) = 0 AND NOT off_pc AND NOT off_b AS ok, array_to_string(errors || CASE WHEN pc_message IS NULL THEN [] ELSE [pc_message] END || CASE WHEN b_message IS NULL THEN [] ELSE [b_message] END, ' | ') AS m FROM b1)"""


@query(f"WITH {SYMMETRY} SELECT test_id, ok AS is_symmetrical, CASE WHEN ok THEN 'Success' ELSE m END AS symmetry_message FROM sy")
def symmetry_report(spark, d):
    return op.symmetry_report(plan(spark, d), saved(spark, d))


@query(f"""WITH {SYMMETRY}, sc AS (SELECT test_id, string_agg('"' || subject || '":' || n, ',' ORDER BY subject) AS j, sum(n) AS total FROM (SELECT test_id, subject, count(*) AS n FROM saved GROUP BY 1, 2) GROUP BY 1)
  SELECT sy.test_id, '{{"total_extracted":' || (SELECT count(*) FROM questions q WHERE q.test_id = sy.test_id) || ',"total_saved":' || CAST(coalesce(total, 0) AS BIGINT) || CASE WHEN j IS NULL THEN '' ELSE ',"subject_counts":{{' || j || '}}' END || ',"is_symmetrical":' || CASE WHEN ok THEN 'true' ELSE 'false' END
   || ',"symmetry_message":"' || CASE WHEN ok THEN 'Success' ELSE m END || '","status":"' || CASE WHEN ok THEN 'Balanced' ELSE 'Invalid' END || '"}}' AS report FROM sy LEFT JOIN sc ON sc.test_id = sy.test_id""")
def parsing_report(spark, d):
    return op.parsing_report(plan(spark, d), roles.questions(spark, d), saved(spark, d))


@query(f"WITH {CONFORM} SELECT test_id, subject, section, expected, actual FROM cm WHERE actual < expected")
def missing_sections(spark, d):
    return op.conformance(plan(spark, d), saved(spark, d)).where("actual < expected").select("test_id", "subject", "section", "expected", "actual")


@query(f"WITH {SAVED} SELECT test_id, id, subject, section, rank FROM saved")
def quota_trim(spark, d):
    return kept(spark, d)


# A bank's hashes as SQL; options are a list of their values there.
ALNUM = r"regexp_replace(lower({}), '[^\p{{L}}\p{{N}}]', '', 'g')"
LOOSE = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower({0}), '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g'), '{1}', ''), '[^a-z0-9]+', '', 'g')"
PRINTS = rf"""fp0 AS (SELECT *, list_filter(options, lambda v: length(v) > 0) AS o FROM bank),
fp AS (SELECT *, CASE WHEN length(question_text) > 0 THEN sha256({ALNUM.format('question_text')} || '#' || coalesce(array_to_string(list_sort(list_transform(o, lambda v: {ALNUM.format('v')})), '|'), '')) ELSE '' END AS content_hash,
  CASE WHEN length(question_text) > 0 THEN sha256({LOOSE.format('question_text', r'^[\(\[]?\d+[\)\.\]]\s*')} || '#' || coalesce(array_to_string(list_sort(list_filter(list_transform(o, lambda v: {LOOSE.format('v', r'^[\(\[]?[a-z][\)\.\]]\s*')}), lambda v: length(v) > 0)), '|'), '')) ELSE '' END AS guard_hash,
  array_to_string(regexp_extract_all(lower(coalesce(question_text, '') || ' ' || coalesce(array_to_string(o, ' '), '')), '[a-z0-9]+'), ' ') AS anchor,
  lower(coalesce(subject, '')) || '|' || lower(coalesce(question_type, '')) || '|' || array_to_string(list_filter(regexp_extract_all(lower(coalesce(question_text, '')), '[a-z0-9]+'), lambda w: NOT list_contains({list(t.STOP_WORDS)}, w) AND NOT regexp_full_match(w, '[0-9]+'))[1:8], ' ') AS intent,
  least(1.0, round(CAST(0.35 AS DOUBLE) + CASE WHEN length(regexp_replace(question_text, '^\s+|\s+$', '', 'g')) >= 40 THEN 0.2 ELSE 0 END + CASE WHEN length(subject) > 0 AND length(section) > 0 THEN 0.1 ELSE 0 END + CASE WHEN question_number IS NOT NULL THEN 0.1 ELSE 0 END
   + CASE WHEN len(options) >= 2 THEN 0.1 ELSE 0 END + CASE WHEN has_visual THEN 0.05 ELSE 0 END + CASE WHEN has_bbox THEN 0.1 ELSE 0 END, 3)) AS confidence FROM fp0)"""


def prints(spark, d):
    return op.fingerprints(roles.bank(spark, d))


def signed(spark, d, *without):
    return written(op.signatures(prints(spark, d)).drop(*without), "signatures")


for _name, _column in (("content_hash", "content_hash"), ("guard_hash", "guard_hash"), ("anchor_text", "anchor"), ("intent_signature", "intent"), ("confidence_score", "confidence")):
    query(f"WITH {PRINTS} SELECT id, {_column} FROM fp", _name)(lambda spark, d, c=_column: prints(spark, d).select("id", c))


@query(f"WITH {PRINTS} SELECT test_id, id, f AS first_id FROM (SELECT test_id, id, min(id) OVER (PARTITION BY test_id, content_hash) AS f FROM fp) WHERE id > f")
def intra_test_duplicates(spark, d):
    return agg.intra_test_duplicates(prints(spark, d))


NEAR = f"""{PRINTS}, w AS (SELECT intent, confidence, anchor, min(id) AS id, list_distinct(string_split(anchor, ' ')) AS tk FROM fp WHERE length(anchor) > 0 GROUP BY 1, 2, 3),
near AS (SELECT b.id, a.id AS other_id FROM w a JOIN w b ON a.intent = b.intent AND a.id < b.id AND abs(a.confidence - b.confidence) <= 0.08 + 1e-12 AND len(list_intersect(a.tk, b.tk)) >= 0.9 * len(list_distinct(a.tk || b.tk))
  UNION ALL SELECT f.id, w.id FROM fp f JOIN w USING (intent, confidence, anchor) WHERE f.id > w.id)"""


@query(f"WITH {NEAR} SELECT * FROM near")
def near_duplicate_pairs(spark, d):
    return op.near_duplicate_pairs(signed(spark, d, "content_hash", "guard_hash"))


@query(f"""WITH {NEAR} SELECT * FROM near UNION SELECT id, f FROM (SELECT id, min(id) OVER (PARTITION BY content_hash) AS f FROM fp WHERE content_hash <> '') WHERE id > f
  UNION SELECT id, f FROM (SELECT id, min(id) OVER (PARTITION BY guard_hash) AS f FROM fp WHERE guard_hash <> '') WHERE id > f""")
def same_question_pairs(spark, d):
    return op.same_question_pairs(signed(spark, d))


def ordered_pass(rows, near, name):
    """SQL of one ordered pass over each test's ``rows``, as a recursive table of what is kept after each row."""
    same = "(y.c <> '' AND y.c = o.content_hash) OR (y.g <> '' AND y.g = o.guard_hash)"
    if near:
        same += " OR (y.intent = o.intent AND abs(y.confidence - o.confidence) <= 0.08 + 1e-12 AND len(y.tk) > 0 AND len(o.tk) > 0 AND len(list_intersect(y.tk, o.tk)) >= 0.9 * len(list_distinct(y.tk || o.tk)))"
    tk = "string_split(anchor, ' ')" if near else "['']"
    return f"""{name}_o AS (SELECT *, list_filter(list_distinct({tk}), lambda v: v <> '') AS tk, row_number() OVER (PARTITION BY test_id ORDER BY coalesce(page_number, 0), coalesce(question_number, 0), id) AS n FROM {rows}),
{name}_p AS (SELECT DISTINCT test_id, CAST(0 AS BIGINT) AS n, CAST([] AS STRUCT(id BIGINT, place VARCHAR, c VARCHAR, g VARCHAR, intent VARCHAR, confidence DOUBLE, tk VARCHAR[])[]) AS kept FROM {name}_o
  UNION ALL SELECT p.test_id, o.n, CASE WHEN len(list_filter(p.kept, lambda y: y.place = o.place)) >= o.quota OR len(list_filter(p.kept, lambda y: {same})) > 0 THEN p.kept
    ELSE list_append(p.kept, {{'id': o.id, 'place': o.place, 'c': o.content_hash, 'g': o.guard_hash, 'intent': o.intent, 'confidence': o.confidence, 'tk': o.tk}}) END
  FROM {name}_p p JOIN {name}_o o ON o.test_id = p.test_id AND o.n = p.n + 1),
{name} AS (SELECT test_id, x.id AS id, x.place AS place FROM (SELECT test_id, unnest(kept) AS x FROM (SELECT DISTINCT ON (test_id) * FROM {name}_p ORDER BY test_id, n DESC)))"""


#: The blueprint's quota of each row's section, by the keys of both; the last of equal sections counts.
QUOTA = f"qt AS (SELECT test_id, {sql_subject_key('subject')} || '/' || {sql_section_key('section_name')} AS place, arg_max(q_count, pos) AS quota FROM blueprint GROUP BY 1, 2)"
STAGED = f"{ordered_pass('placed', False, 'trimmed')}, left_over AS (SELECT * FROM placed WHERE id IN (SELECT id FROM trimmed)), {ordered_pass('left_over', True, 'staged')}"
#: The prints of a bank by another name: of questions that a section takes.
MATCHED = PRINTS.replace("fp0 AS", "mp0 AS").replace("fp AS", "mp AS").replace("FROM fp0", "FROM mp0").replace("FROM bank", "FROM mb")
PAPER = """mb AS (SELECT q.id, q.test_id, q.question_text || ' ' || q.brand AS question_text, m.subject, m.section_name AS section, CAST(NULL AS VARCHAR[]) AS options, q.question_number, q.page_number, q.question_type, false AS has_visual, false AS has_bbox FROM questions q JOIN matched m ON m.id = q.id)"""


def staged(rows, own):
    """Trim by hashes and quota, then the ordered pass over what is left."""
    return op.stage(rows.join(op.trim(rows, own).select("id"), "id", "left_semi"), own)


@query(f"WITH RECURSIVE {PRINTS}, placed AS (SELECT fp.*, {sql_subject_key('subject')} || '/section a' AS place, r.quota FROM fp JOIN (SELECT test_id, max(q_count) AS quota FROM blueprint WHERE section_name = 'Section A' GROUP BY 1) r USING (test_id)), {STAGED} SELECT * FROM staged")
def greedy_dedup_quota(spark, d):
    """The bank's tests: a section for each subject, with the q_count of the blueprint's Section A."""
    rows = written(prints(spark, d).drop("options").withColumn("section", F.lit("Section A")), "prints")
    room = plan(spark, d).where("section_name = 'Section A'").groupBy("test_id").agg(F.max("q_count").alias("q_count"))
    own = rows.groupBy("test_id", "subject", F.col("section").alias("section_name")).agg(F.min("id").alias("pos"))
    return staged(rows, own.join(room, "test_id"))


@query(f"WITH RECURSIVE {MATCH}, {PAPER}, {MATCHED}, {QUOTA}, placed AS (SELECT k.*, qt.quota FROM (SELECT *, {sql_subject_key('subject')} || '/' || {sql_section_key('section')} AS place FROM mp) k JOIN qt USING (test_id, place)), {STAGED} SELECT * FROM staged")
def stage_questions(spark, d):
    """Blueprint trim, hashes and quota of the role's questions, then the ordered pass."""
    q = roles.questions(spark, d)
    matched = joins.matched_sections(q, plan(spark, d)).select("id", F.col("subject").alias("m_subject"), F.col("section_name").alias("m_section"))
    rows = q.join(matched, "id").selectExpr("id", "test_id", "question_text || ' ' || brand AS question_text", "m_subject AS subject", "m_section AS section", "CAST(NULL AS map<string,string>) AS options", "question_number", "page_number", "question_type", "false AS has_visual", "false AS has_bbox")
    return staged(written(op.fingerprints(rows).drop("options"), "prints"), plan(spark, d))


@query(f"WITH {PRINTS} SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY test_id, content_hash ORDER BY coalesce(question_number, 0), id) AS r, content_hash FROM fp) WHERE r = 1 OR content_hash = ''")
def dedup_by_hash(spark, d):
    return op.dedup_by_hash(prints(spark, d)).select("id")


@query(r"""SELECT min(id) AS id, h FROM (SELECT id, sha256(coalesce(nullif(subject, ''), 'General') || coalesce(nullif(section, ''), 'Main') || regexp_replace(coalesce(question_text, ''), '[\s\x0B\x1C-\x1F\x85]+', '', 'g')) AS h FROM bank) GROUP BY h""")
def dedup_page_hash(spark, d):
    rows = roles.bank(spark, d).select("id", t.page_hash(F.col("subject"), F.col("section"), F.col("question_text")).alias("h"))
    return rows.groupBy("h").agg(F.min("id").alias("id"))


@query("SELECT test_id, subject, section_name, CAST(s + 1 AS BIGINT) AS start_q, CAST(s + n AS BIGINT) AS end_q FROM (SELECT *, end_q - start_q + 1 AS n, coalesce(sum(end_q - start_q + 1) OVER (PARTITION BY test_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM blueprint)")
def chronology_ranges(spark, d):
    return op.chronology(plan(spark, d))


INDEXED = "ix AS (SELECT *, row_number() OVER (PARTITION BY test_id, sub ORDER BY g) AS s FROM (SELECT id, test_id, coalesce(subject, 'General') AS sub, row_number() OVER (PARTITION BY test_id ORDER BY coalesce(page_number, 0), coalesce(question_number, 0), id) AS g FROM questions))"


@query(f"WITH {INDEXED} SELECT id, test_id, sub AS subject, g AS global_index, s AS subject_index FROM ix")
def global_and_subject_index(spark, d):
    return op.indexed(roles.questions(spark, d)).select("id", "test_id", "subject", "global_index", "subject_index")


@query(f"WITH {INDEXED} SELECT id, test_id, g AS position FROM ix")
def order_questions(spark, d):
    return op.indexed(roles.questions(spark, d)).select("id", "test_id", F.col("global_index").alias("position"))


@query(f"WITH {INDEXED} SELECT test_id, sub AS subject, min(g) AS first_index FROM ix GROUP BY 1, 2")
def first_index_of_subject(spark, d):
    return op.indexed(roles.questions(spark, d)).groupBy("test_id", "subject").agg(F.min("global_index").alias("first_index"))


@query(f"WITH {INDEXED}, m AS (SELECT test_id, sub, min(g) AS g FROM ix GROUP BY 1, 2) SELECT test_id, list(sub ORDER BY g) AS subjects FROM m GROUP BY 1")
def distinct_subjects_first_seen(spark, d):
    first = op.indexed(roles.questions(spark, d)).groupBy("test_id", "subject").agg(F.min("global_index").alias("first"))
    return first.groupBy("test_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "subject"))), lambda x: x["subject"]).alias("subjects"))


@query("SELECT subject, count(*) AS n FROM questions WHERE test_id = 4 AND subject IS NOT NULL GROUP BY 1")
def subject_question_counts(spark, d):
    return agg.count_per(roles.questions(spark, d).where("test_id = 4 AND subject IS NOT NULL"), "subject", "n")


@query("SELECT DISTINCT ON (page) page, area, x, y, box_id, box_line FROM (SELECT sheet_id AS page, w * h AS area, x, y, box_id, box_line FROM bubble_boxes) ORDER BY page, area DESC, x, y, box_id, box_line")
def largest_box_per_page(spark, d):
    rows = roles.bubble_boxes(spark, d).selectExpr("sheet_id AS page", "w * h AS area", "x", "y", "box_id", "box_line")
    return op.largest_boxes(rows, ["x", "y", "box_id", "box_line"])


@query("SELECT id, title, created_at, (SELECT count(*) FROM items) AS total FROM items ORDER BY created_at DESC, id LIMIT 25 OFFSET 50")
def page_by_created(spark, d):
    rows = roles.items(spark, d)
    return rows.orderBy(F.col("created_at").desc(), "id").offset(50).limit(25).select("id", "title", "created_at").crossJoin(rows.agg(F.count("*").alias("total")))


@query("SELECT p.p AS page, CAST(ceil(n / 25) AS BIGINT) AS pages, p.p * 25 + 1 AS from_row, least((p.p + 1) * 25, n) AS to_row, n AS total FROM (SELECT count(*) AS n FROM items) c, range(3) p(p)")
def page_bounds(spark, d):
    n = roles.items(spark, d).agg(F.count("*").alias("total"))
    pages = n.withColumn("page", F.explode(F.array(*(F.lit(i).cast("long") for i in range(3)))))
    return pages.select("page", F.ceil(F.col("total") / 25).alias("pages"), (F.col("page") * 25 + 1).alias("from_row"), F.least((F.col("page") + 1) * 25, F.col("total")).alias("to_row"), "total")


def item_pages(spark, d):
    """The page index of the items, newest first, in as many ranges as the session has shuffle partitions."""
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return pages.write_pages(roles.items(spark, d).select("id", "title", "created_at"), (F.col("created_at").desc(), F.col("id")), folder(spark, "pages"), ranges)


@query("SELECT id, title, created_at, (SELECT count(*) FROM items) AS total FROM items ORDER BY created_at DESC, id LIMIT 25 OFFSET 25 * 5")
def page_by_index(spark, d):
    """Page 5 of the items: the ranges that hold it are read, however far in it lies."""
    index = item_pages(spark, d)
    return index.page(5, 25).crossJoin(index.total())


@query("SELECT p.p AS page, CAST(ceil(n / 25) AS BIGINT) AS pages, p.p * 25 + 1 AS from_row, least((p.p + 1) * 25, n) AS to_row, n AS total FROM (SELECT count(*) AS n FROM items) c, range(3) p(p)")
def page_bounds_by_index(spark, d):
    return pages.page_bounds(item_pages(spark, d).total(), spark.range(3).withColumnRenamed("id", "page"), 25)


@query("SELECT id, title, created_at, total_marks FROM tests ORDER BY created_at DESC, id LIMIT 5")
def top_recent_tests(spark, d):
    return roles.tests(spark, d).orderBy(F.col("created_at").desc(), "id").limit(5).select("id", "title", "created_at", "total_marks")


@query("SELECT student_id, id, r AS rank FROM (SELECT student_id, id, row_number() OVER (PARTITION BY student_id ORDER BY started_at DESC, id) AS r FROM attempts) WHERE r <= 3")
def top_recent_attempts(spark, d):
    rank = F.row_number().over(Window.partitionBy("student_id").orderBy(F.col("started_at").desc(), "id"))
    return roles.attempts(spark, d).withColumn("rank", rank).where("rank <= 3").select("student_id", "id", "rank")


@query("SELECT id, test_id, CAST(json_extract_string(parsing_report, '$.total_saved') AS INT) AS total_saved, json_extract_string(parsing_report, '$.symmetry_message') AS symmetry_message FROM configs ORDER BY created_at DESC, id LIMIT 10")
def top_recent_configs(spark, d):
    rows = roles.configs(spark, d).orderBy(F.col("created_at").desc(), "id").limit(10)
    return rows.select("id", "test_id", F.get_json_object("parsing_report", "$.total_saved").cast("int").alias("total_saved"), F.get_json_object("parsing_report", "$.symmetry_message").alias("symmetry_message"))


EXPORT = f"""{GRADED}, {SUBJECT_SCORES}, pv AS (SELECT attempt_id, {', '.join(f"coalesce(sum(score) FILTER (subject = '{s}'), 0.0) AS {s}_score" for s in FIVE)} FROM ss GROUP BY 1),
ex AS (SELECT a.id AS attempt_id, a.test_id, CASE WHEN u.id IS NULL THEN 'Unknown' ELSE u.full_name END AS student_name, CASE WHEN u.id IS NULL THEN 'Unknown' ELSE u.email END AS student_email, a.status, a.score, greatest(t.total_marks, 0.0) AS max_marks,
  CASE WHEN t.total_marks > 0 THEN round(coalesce(a.score, 0.0) / t.total_marks * 100, 2) ELSE CAST(0 AS DOUBLE) END || '%' AS percentage, coalesce(round((epoch_us(a.submitted_at) - epoch_us(a.started_at)) / 6e7, 2), CAST(0 AS DOUBLE)) AS minutes,
  a.tab_switch_count AS switches, coalesce(strftime(a.submitted_at, '%Y-%m-%d %H:%M:%S'), 'Not Submitted') AS submission, {', '.join(f"coalesce({s}_score, 0.0) AS {s}_score" for s in FIVE)}
  FROM attempts a JOIN tests t ON t.id = a.test_id LEFT JOIN users u ON u.id = a.student_id LEFT JOIN pv ON pv.attempt_id = a.id)"""


def export(spark, d):
    return reports.results_export(roles.attempts(spark, d), roles.tests(spark, d), roles.users(spark, d), roles.questions(spark, d), graded(spark, d), FIVE)


@query(f"WITH {EXPORT} SELECT * FROM ex")
def results_export(spark, d):
    return export(spark, d)


@query(LEFT_ANSWERS.replace("SELECT a.id AS attempt_id, q.id", "SELECT attempt_id, count(*) AS n, sum(marks) AS marks, count(*) FILTER (is_correct) AS correct FROM (SELECT a.id AS attempt_id, q.id", 1) + ") GROUP BY 1")
def attempt_report(spark, d):
    """The reports' arrays summed up again, so that SQL can be held against them."""
    r = reports.attempt_report(joins.answers_by_attempt_in_place(*graded_papers(spark, d)))
    marks = F.aggregate("answers", F.lit(0.0), lambda a, x: a + x["marks"])
    return r.select("attempt_id", "n", marks.alias("marks"), F.size(F.filter("answers", lambda x: x["is_correct"])).cast("long").alias("correct"))


@query(f"""WITH v AS ({VISIBLE}), p AS (SELECT * FROM tests WHERE id IN (SELECT test_id FROM v WHERE user_id = 10000001 OR user_id = 31) ORDER BY created_at DESC, id LIMIT 8)
  SELECT p.id, p.title, p.created_at, coalesce(n, 0) AS submission_count, coalesce(m, 0.0) AS average_score, CAST(json_extract_string(c.r, '$.is_symmetrical') AS BOOLEAN) AS is_symmetrical, json_extract_string(c.r, '$.symmetry_message') AS symmetry_message FROM p
  LEFT JOIN (SELECT test_id, count(*) AS n, round(avg(coalesce(score, 0)), 4) AS m FROM attempts GROUP BY 1) s ON s.test_id = p.id LEFT JOIN (SELECT DISTINCT ON (test_id) test_id, parsing_report AS r FROM configs ORDER BY test_id, created_at, id) c ON c.test_id = p.id""")
def test_listing(spark, d):
    seen = visible(spark, d).where("user_id = 10000001 OR user_id = 31")
    return reports.test_listing(seen, roles.tests(spark, d), agg.test_stats(roles.attempts(spark, d)), roles.configs(spark, d), 0, 8)


@query(f"""WITH {PRINTS}, u AS (SELECT id, test_id, question_number FROM (SELECT *, row_number() OVER (PARTITION BY test_id, content_hash ORDER BY coalesce(question_number, 0), id) AS r FROM fp) WHERE (r = 1 OR content_hash = '') AND test_id = 3)
  SELECT u.id, u.question_number, (SELECT count(*) FROM attempts WHERE test_id = 3) AS submission_count, (SELECT round(avg(coalesce(score, 0)), 4) FROM attempts WHERE test_id = 3) AS average_score FROM u""")
def test_detail(spark, d):
    rows = op.dedup_by_hash(prints(spark, d).where("test_id = 3")).select("id", "question_number", F.lit(3).alias("t"))
    stats = agg.test_stats(roles.attempts(spark, d).where("test_id = 3"))
    return rows.join(stats, rows["t"] == stats["test_id"]).select("id", "question_number", "submission_count", "average_score")
