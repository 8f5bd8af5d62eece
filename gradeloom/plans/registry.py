"""Where queries and their SQL are registered, and the role views as SQL for the oracle."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from gradeloom.sources import layout

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def spread_first(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        layout.spread(spark, sf_dir)
        return f(spark, sf_dir)

    return run


def query(sql: str | None = None, name: str | None = None):
    """Registers a query under its function's name, with the SQL that must give the same rows."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        key = name or f.__name__
        QUERIES[key] = spread_first(f)
        if sql is not None:
            body = sql.strip()
            head = re.match(r"WITH (RECURSIVE )?", body)
            ORACLE[key] = f"{head[0]}{ROLES}, {body[head.end() :]}" if head else f"WITH {ROLES} {body}"
        return f

    return add


ROLES = r"""
students AS (SELECT c_custkey AS id,
  CASE WHEN c_custkey % 19 <> 0 THEN replace(c_name, '#', ' ') END AS full_name,
  CASE WHEN c_custkey % 53 = 5 THEN 'shared@exam.test' ELSE lower(c_name) || '@exam.test' END AS email,
  CASE WHEN c_custkey % 211 = 7 THEN 'admin' ELSE 'student' END AS role,
  c_custkey % 97 = 3 AS is_superuser, c_acctbal > 0 AS is_premium, c_acctbal > 5000 AS is_paid,
  CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 2 = 1 THEN '11th' ELSE '12th' END AS standard,
  CASE c_mktsegment WHEN 'BUILDING' THEN 'Engineering' WHEN 'AUTOMOBILE' THEN 'medical' WHEN 'MACHINERY' THEN 'foundation' WHEN 'HOUSEHOLD' THEN 'arts' END AS stream,
  CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 2 = 1 THEN 11 ELSE 12 END AS grade,
  c_acctbal AS fee_override, c_custkey % 11 = 0 AS is_fee_exempt,
  CASE WHEN c_acctbal > 5000 THEN 'pay_' || c_custkey END AS payment_id,
  CASE WHEN c_acctbal > 5000 THEN 'success' END AS payment_status,
  CASE WHEN c_custkey % 5 <> 0 THEN TIMESTAMP '2000-01-01' + to_days(CAST(c_custkey % 400 AS INT)) END AS premium_expiry,
  TIMESTAMP '1999-01-01 08:30:00' + to_days(CAST(c_custkey % 300 AS INT)) AS created_at,
  CASE WHEN c_custkey % 3 <> 0 THEN TIMESTAMP '2000-06-30 12:00:00' - to_minutes(c_custkey % 60) END AS last_active_at FROM customer),
teachers AS (SELECT s_suppkey + 10000000 AS id, replace(s_name, '#', ' ') AS full_name, lower(s_name) || '@exam.test' AS email, 'teacher' AS role,
  s_suppkey % 20 = 0 AS is_superuser, s_acctbal > 0 AS is_premium, s_acctbal > 0 AS is_paid, TIMESTAMP '1998-01-01' + to_days(CAST(s_suppkey % 300 AS INT)) AS created_at FROM supplier),
users AS (SELECT * FROM students UNION ALL BY NAME SELECT * FROM teachers),
subjects AS (SELECT r_regionkey AS id, r_name AS name FROM region),
chapters AS (SELECT n_nationkey AS id, n_name AS name, CASE WHEN n_nationkey % 6 <> 5 THEN n_regionkey END AS subject_id FROM nation),
settings AS (SELECT CASE n_nationkey WHEN 3 THEN 'fee_grade_11' WHEN 4 THEN 'fee_grade_12' ELSE lower(n_name) END AS key,
  CASE WHEN n_nationkey = 3 THEN '650' WHEN n_nationkey = 4 THEN 'free' WHEN n_nationkey % 4 = 1 THEN '' WHEN n_nationkey % 5 = 2 THEN NULL ELSE n_nationkey || '' END AS value,
  'about ' || n_name AS description FROM nation),
questions AS (SELECT p_partkey AS id, p_partkey // 60 AS test_id, p_name AS question_text,
  CASE p_partkey % 9 WHEN 0 THEN 'Physics' WHEN 1 THEN 'Physics' WHEN 2 THEN 'Chemistry' WHEN 3 THEN 'Chemistry' WHEN 4 THEN 'Biology' WHEN 5 THEN 'Maths' WHEN 6 THEN 'Maths' WHEN 7 THEN 'Art' END AS subject,
  CASE p_type WHEN 'ECONOMY' THEN 'Section A' WHEN 'STANDARD' THEN 'section a ' WHEN 'MEDIUM' THEN 'Section B' WHEN 'PROMO' THEN 'Part Section B' WHEN 'LARGE' THEN 'Extra' END AS section,
  CASE WHEN p_partkey % 23 <> 4 THEN p_size END AS question_number,
  CASE WHEN p_partkey % 29 <> 4 THEN p_partkey % 17 + 1 END AS page_number,
  CAST(p_partkey % 4 + 1 AS DOUBLE) AS marks, CAST(-0.25 AS DOUBLE) * (p_partkey % 3) AS negative_marks,
  CASE p_partkey % 7 WHEN 0 THEN 'MCQ' WHEN 1 THEN 'SCQ' WHEN 2 THEN 'NUMERIC' WHEN 3 THEN 'INTEGER' WHEN 4 THEN 'SCQ' WHEN 5 THEN 'NUMERIC' ELSE 'ESSAY' END AS question_type,
  CASE WHEN p_partkey % 31 = 1 THEN NULL WHEN p_partkey % 7 IN (2, 3, 5) THEN CASE p_partkey % 4 WHEN 0 THEN (p_size || '') WHEN 1 THEN p_size || '.0' WHEN 2 THEN ' ' || p_size || ' ' ELSE p_size || 'd' END WHEN p_partkey % 2 = 0 THEN 'A' ELSE ' r ' END AS correct_option,
  p_partkey % 25 AS chapter_id, p_brand AS brand, p_retailprice AS price FROM part),
tests AS (SELECT m.id, CASE WHEN m.id % 8 = 2 THEN 'Short' ELSE 'Mock examination number ' || m.id END AS title,
  coalesce(first_date, TIMESTAMP '1992-01-01') + to_days(CAST(m.id % 1000 AS INT)) + to_hours(1) AS created_at, m.id % 97 + 10000000 AS created_by, m.id % 4 <> 3 AS is_published,
  CASE WHEN m.id % 2 = 0 THEN '12th' WHEN m.id % 5 = 1 THEN NULL ELSE '11th' END AS standard,
  CASE m.id % 6 WHEN 0 THEN 'JEE' WHEN 1 THEN 'NEET' WHEN 2 THEN 'JEE Mains' WHEN 3 THEN 'Foundation' WHEN 4 THEN 'Medical' ELSE 'Other' END AS category,
  CASE WHEN m.id % 3 = 0 THEN TIMESTAMP '2000-06-01' + to_days(CAST(m.id % 50 * 10 AS INT)) END AS scheduled_at,
  60 + m.id % 10 * 15 AS duration_minutes,
  CAST(CASE m.id % 5 WHEN 0 THEN 0.0 WHEN 1 THEN NULL WHEN 2 THEN -0.5 WHEN 3 THEN -1.0 ELSE -1.75 END AS DOUBLE) AS negative_marks,
  CASE WHEN m.id % 9 = 3 THEN 0.0 ELSE coalesce(total, 0.0) END AS total_marks,
  CASE m.id % 3 WHEN 0 THEN true WHEN 1 THEN false END AS is_symmetrical, CASE WHEN m.id % 2 = 0 THEN m.id % 5 END AS subject_id, '/papers/' || m.id || '.pdf' AS question_paper_url
  FROM (SELECT test_id AS id, sum(marks) AS total FROM questions GROUP BY 1) m LEFT JOIN (SELECT o_orderkey // 480 AS id, min(o_orderdate) AS first_date FROM orders GROUP BY 1) d ON d.id = m.id),
attempts AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 101 = 0 THEN o_custkey + 5000000 ELSE o_custkey END AS student_id, o_orderkey // 480 AS test_id,
  CASE WHEN o_orderstatus = 'O' THEN 'ongoing' ELSE 'submitted' END AS status, CASE WHEN o_orderkey % 37 <> 2 THEN CAST(floor(o_totalprice / 5000) AS DOUBLE) END AS score,
  o_orderdate AS started_at, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderdate + to_minutes(o_orderkey % 180) + to_seconds(o_orderkey % 60) END AS submitted_at,
  o_orderkey % 4 AS tab_switch_count FROM orders),
answers AS (SELECT l_orderkey AS attempt_id, CASE WHEN l_partkey % 10 = 9 THEN l_partkey ELSE l_orderkey // 480 * 60 + l_partkey % 60 END AS question_id, CASE l_returnflag WHEN 'A' THEN 'a' WHEN 'R' THEN ' R' END AS selected_option,
  CASE WHEN l_linestatus = 'O' THEN CASE l_linenumber % 5 WHEN 0 THEN '' WHEN 1 THEN CAST(l_quantity AS BIGINT) || 'd' WHEN 2 THEN ' ' || CAST(l_quantity AS BIGINT) WHEN 3 THEN CAST(l_quantity AS BIGINT) || '.0' ELSE CAST(l_quantity AS BIGINT) || '' END END AS answer_text,
  CAST(l_quantity AS INT) AS time_spent_seconds, l_linenumber AS line FROM lineitem
  QUALIFY row_number() OVER (PARTITION BY l_orderkey, question_id ORDER BY l_linenumber DESC, l_suppkey DESC, l_quantity DESC, l_returnflag DESC, l_linestatus DESC, l_extendedprice DESC) = 1),
sheet_marks AS (SELECT l_orderkey AS attempt_id, l_linenumber - 1 AS question_index, max(l_returnflag) AS marked FROM lineitem GROUP BY ALL),
bubble_boxes AS (SELECT l_orderkey // 50 AS sheet_id, l_partkey * 1000 + l_suppkey AS x, l_linenumber * 100 + CAST(l_quantity AS INT) AS y, 18 + CAST(l_quantity AS INT) % 20 AS w,
  18 + CAST(trunc(l_extendedprice) AS INT) % 20 AS h, l_extendedprice AS filled, l_orderkey AS box_id, l_linenumber AS box_line, l_quantity AS box_quantity FROM lineitem),
ev AS (SELECT event_id, ts, user_id, event_type, value, props, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events),
items AS (SELECT p_partkey AS id, p_name AS title, p_brand AS description, p_partkey % 50 AS owner_id, TIMESTAMP '1999-01-01' + to_days(p_size) AS created_at FROM part),
bank AS (SELECT doc_id AS id, doc_id // 60 AS test_id, CASE WHEN doc_id % 41 = 5 THEN '' ELSE text END AS question_text, lang AS subject, source AS section,
  CASE WHEN doc_id % 3 = 0 THEN NULL ELSE ['(a) ' || source, lang || '.', '', n_chars || ' m'] END AS options, doc_id % 90 AS question_number, doc_id % 30 AS page_number,
  CASE WHEN doc_id % 3 = 0 THEN 'NUMERIC' ELSE 'SCQ' END AS question_type, doc_id % 4 = 0 AS has_visual, doc_id % 8 = 0 AS has_bbox FROM documents),
blueprint AS (SELECT t.test_id, s.subject, p.section_name, CASE s.subject WHEN 'Physics' THEN 0 WHEN 'Chemistry' THEN 10 WHEN 'Biology' THEN 20 ELSE 30 END + p.p AS pos,
  CAST(1 + p.p * 15 AS INT) AS start_q, CAST(1 + p.p * 15 + 12 + t.test_id % 5 AS INT) AS end_q, CAST(2 + (t.test_id + p.p) % 5 AS INT) AS q_count,
  CASE p.p WHEN 0 THEN 'single choice' WHEN 1 THEN 'numerical' END AS question_type, CAST(4.0 AS DOUBLE) AS pos_mark, CAST(-1.0 AS DOUBLE) AS neg_mark
  FROM (SELECT DISTINCT test_id FROM questions) t, (VALUES ('Physics'), ('Chemistry'), ('Biology'), ('Maths')) s(subject), (VALUES (0, 'Section A'), (1, 'Section B'), (2, 'Extra')) p(p, section_name)
  WHERE NOT (s.subject = 'Biology' AND t.test_id % 3 = 0)),
configs AS (SELECT event_id AS id, event_id // 300 AS test_id, ts AS created_at, k,
  '{"title":"Paper ' || event_id || '","standard":"11th","subjects":{"Physics":{"sections":{"Section A":{"start_q":' || (k % 10 - 3) || ',"end_q":' || (k % 30) || ',"marks":4,"type":"single choice"},"Section B":{"negative_marks":-2}}}," chemistry ":{"sections":{"Section A":{"start_q":5,"end_q":3}}}}}' AS config_data,
  CASE WHEN k % 6 = 0 THEN NULL ELSE '{"job_id":"job' || k || '","is_symmetrical":' || CASE WHEN k % 2 = 0 THEN 'true' ELSE 'false' END || ',"symmetry_message":"m' || k || '","total_saved":' || k || '}' END AS parsing_report
  FROM ev),
patches AS (SELECT user_id AS id, ts AS seq, CASE WHEN event_type = 'click' THEN 'Name ' || event_id END AS full_name, CASE WHEN event_type = 'view' THEN value > 50 END AS is_premium,
  CASE WHEN event_type = 'purchase' THEN value END AS fee_override, CASE WHEN event_type = 'signup' THEN event_id % 2 = 0 END AS is_fee_exempt FROM events)
"""
