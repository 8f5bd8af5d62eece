"""Role views: the exam platform's tables as fixed projections of the star schema that tests and queries run on.

Each view reads only the columns that it names. ``REFERENCE_NOW`` stands for the current time in every rule that has one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REFERENCE_NOW = "2000-06-30 12:00:00"
#: A test is a paper of so many questions, taken by so many attempts; so tests grow with the data and papers don't.
QUESTIONS, ATTEMPTS, SHEET_ORDERS, TEST_EVENTS = 60, 480, 50, 300


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def students(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS id",
        "CASE WHEN c_custkey % 19 <> 0 THEN replace(c_name, '#', ' ') END AS full_name",
        "CASE WHEN c_custkey % 53 = 5 THEN 'shared@exam.test' ELSE lower(c_name) || '@exam.test' END AS email",
        "CASE WHEN c_custkey % 211 = 7 THEN 'admin' ELSE 'student' END AS role",
        "c_custkey % 97 = 3 AS is_superuser",
        "c_acctbal > 0 AS is_premium",
        "c_acctbal > 5000 AS is_paid",
        "CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 2 = 1 THEN '11th' ELSE '12th' END AS standard",
        "CASE c_mktsegment WHEN 'BUILDING' THEN 'Engineering' WHEN 'AUTOMOBILE' THEN 'medical' WHEN 'MACHINERY' THEN 'foundation' WHEN 'HOUSEHOLD' THEN 'arts' END AS stream",
        "CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 2 = 1 THEN 11 ELSE 12 END AS grade",
        "c_acctbal AS fee_override",
        "c_custkey % 11 = 0 AS is_fee_exempt",
        "CASE WHEN c_acctbal > 5000 THEN 'pay_' || c_custkey END AS payment_id",
        "CASE WHEN c_acctbal > 5000 THEN 'success' END AS payment_status",
        "CASE WHEN c_custkey % 5 <> 0 THEN timestamp_ntz'2000-01-01 00:00:00' + make_dt_interval(CAST(c_custkey % 400 AS INT)) END AS premium_expiry",
        "timestamp_ntz'1999-01-01 08:30:00' + make_dt_interval(CAST(c_custkey % 300 AS INT)) AS created_at",
        "CASE WHEN c_custkey % 3 <> 0 THEN timestamp_ntz'2000-06-30 12:00:00' - make_dt_interval(0, 0, CAST(c_custkey % 60 AS INT), 0) END AS last_active_at",
    )


def teachers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").selectExpr(
        "s_suppkey + 10000000 AS id", "replace(s_name, '#', ' ') AS full_name", "lower(s_name) || '@exam.test' AS email", "'teacher' AS role",
        "s_suppkey % 20 = 0 AS is_superuser", "s_acctbal > 0 AS is_premium", "s_acctbal > 0 AS is_paid", "timestamp_ntz'1998-01-01 00:00:00' + make_dt_interval(CAST(s_suppkey % 300 AS INT)) AS created_at",
    )


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return students(spark, sf_dir).unionByName(teachers(spark, sf_dir), allowMissingColumns=True)


def subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "region").selectExpr("r_regionkey AS id", "r_name AS name")


def chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").selectExpr("n_nationkey AS id", "n_name AS name", "CASE WHEN n_nationkey % 6 <> 5 THEN n_regionkey END AS subject_id")


def settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").selectExpr(
        "CASE n_nationkey WHEN 3 THEN 'fee_grade_11' WHEN 4 THEN 'fee_grade_12' ELSE lower(n_name) END AS key",
        "CASE WHEN n_nationkey = 3 THEN '650' WHEN n_nationkey = 4 THEN 'free' WHEN n_nationkey % 4 = 1 THEN '' WHEN n_nationkey % 5 = 2 THEN NULL ELSE n_nationkey || '' END AS value",
        "'about ' || n_name AS description",
    )


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(
        "p_partkey AS id",
        f"p_partkey div {QUESTIONS} AS test_id",
        "p_name AS question_text",
        "CASE p_partkey % 9 WHEN 0 THEN 'Physics' WHEN 1 THEN 'Physics' WHEN 2 THEN 'Chemistry' WHEN 3 THEN 'Chemistry' WHEN 4 THEN 'Biology' WHEN 5 THEN 'Maths' WHEN 6 THEN 'Maths' WHEN 7 THEN 'Art' END AS subject",
        "CASE p_type WHEN 'ECONOMY' THEN 'Section A' WHEN 'STANDARD' THEN 'section a ' WHEN 'MEDIUM' THEN 'Section B' WHEN 'PROMO' THEN 'Part Section B' WHEN 'LARGE' THEN 'Extra' END AS section",
        "CASE WHEN p_partkey % 23 <> 4 THEN p_size END AS question_number",
        "CASE WHEN p_partkey % 29 <> 4 THEN CAST(p_partkey % 17 AS INT) + 1 END AS page_number",
        "CAST(p_partkey % 4 + 1 AS DOUBLE) AS marks",
        "-0.25 * CAST(p_partkey % 3 AS DOUBLE) AS negative_marks",
        "CASE p_partkey % 7 WHEN 0 THEN 'MCQ' WHEN 1 THEN 'SCQ' WHEN 2 THEN 'NUMERIC' WHEN 3 THEN 'INTEGER' WHEN 4 THEN 'SCQ' WHEN 5 THEN 'NUMERIC' ELSE 'ESSAY' END AS question_type",
        "CASE WHEN p_partkey % 31 = 1 THEN NULL WHEN p_partkey % 7 IN (2, 3, 5) THEN CASE p_partkey % 4 WHEN 0 THEN (p_size || '') WHEN 1 THEN p_size || '.0' WHEN 2 THEN ' ' || p_size || ' ' ELSE p_size || 'd' END WHEN p_partkey % 2 = 0 THEN 'A' ELSE ' r ' END AS correct_option",
        "CAST(p_partkey % 25 AS INT) AS chapter_id",
        "p_brand AS brand",
        "p_retailprice AS price",
    )


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of all tests."""
    return questions(spark, sf_dir).select("test_id").distinct()


def tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per test, dated by its first attempt; some have none."""
    dates = table(spark, sf_dir, "orders").selectExpr(f"o_orderkey div {ATTEMPTS} AS id", "o_orderdate").groupBy("id").agg(F.min("o_orderdate").alias("first_date"))
    marks = questions(spark, sf_dir).groupBy(F.col("test_id").alias("id")).agg(F.sum("marks").alias("total"))
    return marks.join(dates, "id", "left").selectExpr(
        "id",
        "CASE WHEN id % 8 = 2 THEN 'Short' ELSE 'Mock examination number ' || id END AS title",
        "coalesce(first_date, timestamp_ntz'1992-01-01 00:00:00') + make_dt_interval(CAST(id % 1000 AS INT), 1) AS created_at",
        "id % 97 + 10000000 AS created_by",
        "id % 4 <> 3 AS is_published",
        "CASE WHEN id % 2 = 0 THEN '12th' WHEN id % 5 = 1 THEN NULL ELSE '11th' END AS standard",
        "CASE id % 6 WHEN 0 THEN 'JEE' WHEN 1 THEN 'NEET' WHEN 2 THEN 'JEE Mains' WHEN 3 THEN 'Foundation' WHEN 4 THEN 'Medical' ELSE 'Other' END AS category",
        "CASE WHEN id % 3 = 0 THEN timestamp_ntz'2000-06-01 00:00:00' + make_dt_interval(CAST(id % 50 AS INT) * 10) END AS scheduled_at",
        "CAST(60 + id % 10 * 15 AS INT) AS duration_minutes",
        "CAST(CASE id % 5 WHEN 0 THEN 0.0 WHEN 1 THEN NULL WHEN 2 THEN -0.5 WHEN 3 THEN -1.0 ELSE -1.75 END AS DOUBLE) AS negative_marks",
        "CASE WHEN id % 9 = 3 THEN 0.0 ELSE coalesce(total, 0.0) END AS total_marks",
        "CASE id % 3 WHEN 0 THEN true WHEN 1 THEN false END AS is_symmetrical",
        "CASE WHEN id % 2 = 0 THEN CAST(id % 5 AS INT) END AS subject_id",
        "'/papers/' || id || '.pdf' AS question_paper_url",
    )


ORDER = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz"
LINE = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"
#: What settles which of several answers to a question is the last: all columns of the line in this order.
LINE_ORDER = "struct<l_linenumber:int,l_suppkey:long,l_quantity:double,l_returnflag:string,l_linestatus:string,l_extendedprice:double>"
_LAST = ("l_linenumber", "l_suppkey", "l_quantity", "l_returnflag", "l_linestatus", "l_extendedprice")
_QUESTION = f"CASE WHEN l_partkey % 10 = 9 THEN l_partkey ELSE l_orderkey div {ATTEMPTS} * {QUESTIONS} + l_partkey % {QUESTIONS} END"
_ANSWER = (
    "CASE x.l_returnflag WHEN 'A' THEN 'a' WHEN 'R' THEN ' R' END AS selected_option",
    "CASE WHEN x.l_linestatus = 'O' THEN CASE x.l_linenumber % 5 WHEN 0 THEN '' WHEN 1 THEN CAST(x.l_quantity AS BIGINT) || 'd' WHEN 2 THEN ' ' || CAST(x.l_quantity AS BIGINT) WHEN 3 THEN CAST(x.l_quantity AS BIGINT) || '.0' ELSE CAST(x.l_quantity AS BIGINT) || '' END END AS answer_text",
    "CAST(x.l_quantity AS INT) AS time_spent_seconds",
)


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_attempts(table(spark, sf_dir, "orders"))


def as_attempts(orders: DataFrame) -> DataFrame:
    return orders.selectExpr(
        "o_orderkey AS id",
        "CASE WHEN o_orderkey % 101 = 0 THEN o_custkey + 5000000 ELSE o_custkey END AS student_id",
        f"o_orderkey div {ATTEMPTS} AS test_id",
        "CASE WHEN o_orderstatus = 'O' THEN 'ongoing' ELSE 'submitted' END AS status",
        "CASE WHEN o_orderkey % 37 <> 2 THEN CAST(floor(o_totalprice / 5000) AS DOUBLE) END AS score",
        "o_orderdate AS started_at",
        "CASE WHEN o_orderkey % 7 <> 0 THEN o_orderdate + make_dt_interval(0, 0, CAST(o_orderkey % 180 AS INT), CAST(o_orderkey % 60 AS INT)) END AS submitted_at",
        "CAST(o_orderkey % 4 AS INT) AS tab_switch_count",
    )


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One answer per (attempt, question): the greatest line in order of all its columns. Lines go by their attempt, so the
    joins with attempts and the sums by attempt that follow find them in place; an attempt has few lines for a question, so
    combining them before would spare no shuffle. One line in ten names a question of any paper, the others one of the
    attempt's."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.expr(_QUESTION).alias("question_id"), F.struct(*_LAST).alias("x")).repartition("l_orderkey")
    rows = lines.groupBy("l_orderkey", "question_id").agg(F.max("x").alias("x"))
    return rows.selectExpr("l_orderkey AS attempt_id", "question_id", *_ANSWER, "x.l_linenumber AS line")


def raw_answers(lines: DataFrame) -> DataFrame:
    """An answer for each line as it comes, several for a question among them, given on the line's own date. That date may be
    years before or after the attempt's."""
    rows = lines.select("l_orderkey", F.expr(_QUESTION).alias("question_id"), F.struct(*_LAST).alias("x"), F.col("l_shipdate").alias("answered_at"))
    return rows.selectExpr("l_orderkey AS attempt_id", "question_id", "x AS seq", *_ANSWER, "answered_at")


def sheet_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marks read from scanned sheets: attempt, index of the question on the sheet, letter; the greatest letter counts."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag").repartition("l_orderkey")  # what goes by attempt follows in place
    return lines.groupBy(F.col("l_orderkey").alias("attempt_id"), (F.col("l_linenumber") - 1).alias("question_index")).agg(F.max("l_returnflag").alias("marked"))


def bubble_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(
        f"l_orderkey div {SHEET_ORDERS} AS sheet_id", "l_partkey * 1000 + l_suppkey AS x", "l_linenumber * 100 + CAST(l_quantity AS INT) AS y", "18 + CAST(l_quantity AS INT) % 20 AS w",
        "18 + CAST(l_extendedprice AS INT) % 20 AS h", "l_extendedprice AS filled", "l_orderkey AS box_id", "l_linenumber AS box_line", "l_quantity AS box_quantity",
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr("event_id", "ts", "user_id", "event_type", "value", "props", "CAST(get_json_object(props, '$.k') AS INT) AS k")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr("p_partkey AS id", "p_name AS title", "p_brand AS description", "p_partkey % 50 AS owner_id", "timestamp_ntz'1999-01-01 00:00:00' + make_dt_interval(p_size) AS created_at")


def bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question bank of prose: subject by language, section by source, options from the text's own length."""
    return table(spark, sf_dir, "documents").selectExpr(
        "doc_id AS id", f"doc_id div {QUESTIONS} AS test_id", "CASE WHEN doc_id % 41 = 5 THEN '' ELSE text END AS question_text",
        "lang AS subject", "source AS section", "CASE WHEN doc_id % 3 = 0 THEN NULL ELSE map('A', '(a) ' || source, 'B', lang || '.', 'C', '', 'D', n_chars || ' m') END AS options",
        "CAST(doc_id % 90 AS INT) AS question_number", "CAST(doc_id % 30 AS INT) AS page_number", "CASE WHEN doc_id % 3 = 0 THEN 'NUMERIC' ELSE 'SCQ' END AS question_type",
        "doc_id % 4 = 0 AS has_visual", "doc_id % 8 = 0 AS has_bbox",
    )


def blueprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three sections for each test and subject, in a fixed order."""
    n = papers(spark, sf_dir).selectExpr("test_id", "explode(array('Physics', 'Chemistry', 'Biology', 'Maths')) AS subject", "0 AS one")
    n = n.selectExpr("test_id", "subject", "posexplode(array('Section A', 'Section B', 'Extra')) AS (p, section_name)")
    return n.where("NOT (subject = 'Biology' AND test_id % 3 = 0)").selectExpr(
        "test_id", "subject", "section_name",
        "CASE subject WHEN 'Physics' THEN 0 WHEN 'Chemistry' THEN 10 WHEN 'Biology' THEN 20 ELSE 30 END + p AS pos",
        "CAST(1 + p * 15 AS INT) AS start_q", "CAST(1 + p * 15 + 12 + test_id % 5 AS INT) AS end_q", "CAST(2 + (test_id + p) % 5 AS INT) AS q_count",
        "CASE p WHEN 0 THEN 'single choice' WHEN 1 THEN 'numerical' END AS question_type", "4.0D AS pos_mark", "-1.0D AS neg_mark",
    )


def configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generation configs with JSON documents, one from each event."""
    rows = table(spark, sf_dir, "events").selectExpr("event_id AS id", f"event_id div {TEST_EVENTS} AS test_id", "ts AS created_at", "CAST(get_json_object(props, '$.k') AS INT) AS k")
    return rows.selectExpr(
        "id", "test_id", "created_at",
        "'{\"title\":\"Paper ' || id || '\",\"standard\":\"11th\",\"subjects\":{\"Physics\":{\"sections\":{\"Section A\":{\"start_q\":' || (k % 10 - 3) || ',\"end_q\":' || (k % 30) || ',\"marks\":4,\"type\":\"single choice\"},\"Section B\":{\"negative_marks\":-2}}},\" chemistry \":{\"sections\":{\"Section A\":{\"start_q\":5,\"end_q\":3}}}}}' AS config_data",
        "CASE WHEN k % 6 = 0 THEN NULL ELSE '{\"job_id\":\"job' || k || '\",\"is_symmetrical\":' || CASE WHEN k % 2 = 0 THEN 'true' ELSE 'false' END || ',\"symmetry_message\":\"m' || k || '\",\"total_saved\":' || k || '}' END AS parsing_report",
    )


def raw_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model responses, one from each event: JSON text with fences, aliases, trailing commas, prose and cut ends, or none."""
    return table(spark, sf_dir, "events").selectExpr(
        "event_id AS id", "CAST(event_id % 12 AS INT) * 2 + 1 AS first_page", f"event_id div {TEST_EVENTS} AS test_id",
        "CASE event_id % 8 WHEN 0 THEN '```json' || chr(10) || '[{\"q_no\": ' || value || ', \"sub\": \"phy\", \"text\": \"What is ' || user_id || '?\", \"answer\": \"A\",},]' || chr(10) || '```'"
        " WHEN 1 THEN '{\"questions\": [{\"number\": 3, \"section\": \"Sec' || user_id || '\", \"subject\": \"Chem\", \"question_text\": \"Name ' || event_type || '\", \"page_number\": \"p. 12\"}]}'"
        " WHEN 2 THEN 'Sure: [ {\"question_number\": 7, \"q_text\": \"a\\\\dot ' || user_id || '\", \"type\": \"nat\", \"page_number\": 4}, {\"error\": \"QUESTION_COUNT_MISMATCH\", \"expected\": 3} ] done'"
        " WHEN 3 THEN '[{\"no\": 1, \"text\": \"open\", \"page_number\": \"none\"}'"
        " WHEN 4 THEN 'nothing here'"
        " WHEN 5 THEN '{\"data\": [{\"no\": 2, \"subject\": \"\", \"question_text\": \"d' || user_id || '\"}, 5]}'"
        " WHEN 6 THEN '{\"q_no\": 9, \"section_name\": \"Section A\", \"subject\": \"BIO\", \"question_text\": \"one ' || event_type || '\", \"correct_option\": \"B\"}'"
        " ELSE NULL END AS response_text",
    )


def patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "user_id AS id", "ts AS seq", "CASE WHEN event_type = 'click' THEN 'Name ' || event_id END AS full_name", "CASE WHEN event_type = 'view' THEN value > 50 END AS is_premium",
        "CASE WHEN event_type = 'purchase' THEN value END AS fee_override", "CASE WHEN event_type = 'signup' THEN event_id % 2 = 0 END AS is_fee_exempt",
    )
