"""Activity, payment and job events: each rule as a streaming query and as the batch query of the same result.

Transformations take a DataFrame that may be streaming. ``run_to_table`` drains a source into a Parquet table with
checkpoints in the given folder, so a restarted query goes on where it stopped. Results by key that later events change are
``MergeTable``s: their rules are a partial row for each event, and how partial rows combine.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gradeloom.functions.text import premium_expiry
from gradeloom.operators.grading import marked, penalty
from gradeloom.sources.merged import MergeTable

EVENT_SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, folder: str, name: str = "events.parquet", late: str = "10 minutes") -> DataFrame:
    """The event files of a folder as a stream, with a watermark on ``ts``."""
    raw = spark.readStream.schema(EVENT_SCHEMA).option("pathGlobFilter", name).parquet(folder)
    return raw.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("k", F.get_json_object("props", "$.k").cast("int")).withWatermark("ts", late)


def heartbeats(spark: SparkSession, path: str) -> MergeTable:
    """Last activity and path of each user; equal times are settled by event."""

    def latest(rows: DataFrame) -> DataFrame:
        return rows.groupBy("user_id").agg(F.max(F.struct("last_active_at", "event_id", "current_path")).alias("x")).select("user_id", "x.*")

    return MergeTable(spark, path, "user_id long, last_active_at timestamp, event_id long, current_path string", latest)


def heartbeat_rows(events: DataFrame) -> DataFrame:
    return events.select("user_id", F.col("ts").alias("last_active_at"), "event_id", F.col("event_type").alias("current_path"))


def counters(spark: SparkSession, path: str, keys: str, name: str) -> MergeTable:
    """Numbers by key, from rows that each add theirs. ``keys``: their names and types."""
    by = [k.split()[0] for k in keys.split(", ")]
    return MergeTable(spark, path, f"{keys}, {name} long", lambda rows: rows.groupBy(*by).agg(F.sum(name).alias(name)))


def active_users(events: DataFrame) -> DataFrame:
    """(until, user_id), once for each user and minute with the user active in the five minutes before it. On a stream
    the state is one entry for each of them, and goes once the watermark has passed the minute."""
    seen = events.select(F.window("ts", "5 minutes", "1 minute").alias("w"), "user_id").dropDuplicates(["w", "user_id"])
    return seen.select(F.col("w.end").cast("timestamp_ntz").alias("until"), "user_id")


def active_now(seen: DataFrame) -> DataFrame:
    """Users active in the last five minutes, for every minute that has any."""
    return seen.groupBy("until").agg(F.count("*").alias("active"))


def tab_switches(events: DataFrame) -> DataFrame:
    """A hidden-tab event of an attempt counts one."""
    return events.where("event_type = 'view'").select(F.col("user_id").alias("attempt_id"), F.lit(1).cast("long").alias("switches"))


def switch_warnings(events: DataFrame) -> DataFrame:
    """Batch: the running count beside each hidden-tab event, with its warning."""
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    rows = events.where("event_type = 'view'").select("event_id", F.col("user_id").alias("attempt_id"), n.alias("n"))
    return rows.select("event_id", "attempt_id", "n", F.format_string("Tab switch %d recorded", "n").alias("warning"))


def ticks_per_question(events: DataFrame) -> DataFrame:
    """A tick on a question counts one second."""
    return events.where("event_type = 'click'").select(F.col("user_id").alias("attempt_id"), F.col("k").alias("question"), F.lit(1).cast("long").alias("seconds"))


def time_on_question(events: DataFrame) -> DataFrame:
    """Batch: from the moves between questions, the time until the next one; a last question has none."""
    after = F.lead("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    spent = F.coalesce(F.timestamp_diff("SECOND", F.col("ts"), after), F.lit(0))
    return events.withColumn("s", spent).groupBy(F.col("user_id").alias("attempt_id"), F.col("k").alias("question")).agg(F.sum("s").alias("seconds"))


def auto_submit(attempts: DataFrame, tests: DataFrame) -> DataFrame:
    """Batch: when each attempt that is under way closes."""
    length = tests.select(F.col("id").alias("test_id"), "duration_minutes")
    rows = attempts.where("status = 'ongoing'").join(length, "test_id")
    return rows.select("id", "test_id", (F.col("started_at") + F.make_dt_interval(F.lit(0), F.lit(0), F.col("duration_minutes"))).alias("closes_at"))


def auto_submit_stream(starts: DataFrame) -> DataFrame:
    """Stream of (attempt_id, ts, duration_minutes) with a watermark: one row for each attempt once its time is over; of
    several starts of one attempt the first to end counts.

    State is one end time for each open attempt and goes when the timer fires."""

    def close(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (ends,) = state.get
            state.remove()
            yield pd.DataFrame({"attempt_id": [key[0]], "closed_ms": [ends]})
            return
        ends = min(int((f["ts"].astype("int64") // 1_000_000 + f["duration_minutes"] * 60_000).min()) for f in frames)
        ends = min(ends, state.get[0]) if state.exists else ends
        state.update((ends,))
        state.setTimeoutTimestamp(max(ends, state.getCurrentWatermarkMs() + 1))

    return starts.groupBy("attempt_id").applyInPandasWithState(close, "attempt_id long, closed_ms long", "ends long", "append", GroupStateTimeout.EventTimeTimeout)


def open_attempts(spark: SparkSession, path: str) -> MergeTable:
    """When each attempt that has begun is over (of several starts the first to end counts), and the last start seen of it.
    The table is the state: a batch adds a row for each attempt that it starts, and ``compact`` can let closed ones go."""

    def first(rows: DataFrame) -> DataFrame:
        return rows.groupBy("attempt_id").agg(F.min("ends").alias("ends"), F.max("seen").alias("seen"))

    return MergeTable(spark, path, "attempt_id long, ends timestamp, seen timestamp", first)


def start_rows(starts: DataFrame) -> DataFrame:
    """Partial rows of ``open_attempts`` from starts (attempt_id, ts, duration_minutes)."""
    return starts.select("attempt_id", (F.col("ts") + F.make_dt_interval(F.lit(0), F.lit(0), F.col("duration_minutes"))).alias("ends"), F.col("ts").alias("seen"))


def closed_attempts(table: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Attempts whose time was over ``late`` before the newest start."""
    last = table.agg((F.max("seen") - F.expr(f"INTERVAL {late}")).alias("mark"))
    return table.crossJoin(F.broadcast(last)).where("ends < mark").select("attempt_id", F.unix_millis("ends").alias("closed_ms"))


def captured_payments(events: DataFrame, users: DataFrame, now: Column) -> DataFrame:
    """The first captured payment of each unpaid user (user_id, ts, event_id, grade): paid once, grade from the notes else
    the user's, standard and expiry after it."""
    first = events.groupBy(F.col("user_id").alias("id")).agg(F.min_by(F.struct("event_id", "grade"), F.struct("ts", "event_id")).alias("p"))
    grade = F.coalesce("p.grade", "grade")
    rows = users.where("NOT is_paid").select("id", "grade").join(first, "id")
    return rows.select("id", F.col("p.event_id").alias("payment_id"), grade.alias("grade"), F.concat(grade.cast("string"), F.lit("th")).alias("standard"), premium_expiry(grade, now).alias("premium_expiry"))


def payments(spark: SparkSession, path: str) -> MergeTable:
    """The captured payment that paid each user: the first of the first batch that had one. Whoever is paid stays so, and
    a batch that comes twice pays nobody twice."""

    def first(rows: DataFrame) -> DataFrame:
        return rows.groupBy("id").agg(F.min(F.struct("batch", "ts", "event_id", "grade")).alias("p")).select("id", "p.*")

    return MergeTable(spark, path, "id long, batch long, ts timestamp, event_id long, grade int", first)


def payment_rows(paid: DataFrame, users: DataFrame, batch: int) -> DataFrame:
    """A batch's captured payments (event_id, user_id, ts, grade) of users that weren't paid before the stream."""
    rows = paid.select(F.col("user_id").alias("id"), F.lit(batch).cast("long").alias("batch"), F.col("ts").cast("timestamp").alias("ts"), "event_id", "grade")
    return rows.join(users.where("NOT is_paid").select("id"), "id", "left_semi")


def paid_users(table: DataFrame, users: DataFrame, now: Column) -> DataFrame:
    """What a payment changes of its user: grade from the notes, else the user's own; standard and expiry after it."""
    grade = F.coalesce("noted", "grade")
    rows = table.select("id", "event_id", F.col("grade").alias("noted")).join(users.select("id", "grade"), "id")
    return rows.select("id", F.col("event_id").alias("payment_id"), grade.alias("grade"), F.concat(grade.cast("string"), F.lit("th")).alias("standard"), premium_expiry(grade, now).alias("premium_expiry"))


def with_payments(users: DataFrame, changes: DataFrame) -> DataFrame:
    """The users table after the payments: paid, premium and with their new grade, standard and expiry."""
    new = changes.select("id", F.col("payment_id").cast("string").alias("new_payment"), *(F.col(c).alias(f"new_{c}") for c in ("grade", "standard", "premium_expiry")))
    rows = users.join(new, "id", "left")
    got = F.col("new_payment").isNotNull()
    rows = rows.withColumns({c: F.when(got, F.col(f"new_{c}")).otherwise(F.col(c)) for c in ("grade", "standard", "premium_expiry")} | {"is_paid": got | F.col("is_paid"), "is_premium": got | F.col("is_premium"), "payment_id": F.when(got, F.col("new_payment")).otherwise(F.col("payment_id")), "payment_status": F.when(got, "success").otherwise(F.col("payment_status"))})
    return rows.select(*users.columns)


JOB_FIELDS = {"progress": "int", "message": "string", "status": "string"}


def jobs(spark: SparkSession, path: str) -> MergeTable:
    """Latest progress, message and status of each job with when they were set: an update changes only what it sets."""

    def latest(rows: DataFrame) -> DataFrame:
        return rows.groupBy("job_id").agg(*(F.max(c).alias(c) for c in JOB_FIELDS), F.max("updated_at").alias("updated_at"))

    fields = ", ".join(f"{c} struct<ts:timestamp,event_id:long,value:{kind}>" for c, kind in JOB_FIELDS.items())
    return MergeTable(spark, path, f"job_id long, {fields}, updated_at timestamp", latest)


def job_rows(updates: DataFrame) -> DataFrame:
    field = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.col("ts").cast("timestamp").alias("ts"), "event_id", F.col(c).alias("value")))
    return updates.select(F.col("job_id").cast("long").alias("job_id"), *(field(c).alias(c) for c in JOB_FIELDS), F.col("ts").cast("timestamp").alias("updated_at"))


def job_values(table: DataFrame) -> DataFrame:
    return table.select("job_id", *(F.col(c)["value"].alias(c) for c in JOB_FIELDS), "updated_at")


def job_status(updates: DataFrame) -> DataFrame:
    """Batch: latest progress, message and status of each job."""
    at = F.struct("ts", "event_id")
    return updates.groupBy("job_id").agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(c) for c in JOB_FIELDS), F.max("ts").alias("updated_at"))


def expired_jobs(updates: DataFrame, hours: int = 1) -> DataFrame:
    """Stream of (job_id, ts) with a watermark: a job goes, with its last time, once nothing came for so many hours. State
    is one session for each live job; an update after that starts the job anew."""
    live = updates.groupBy(F.session_window("ts", f"{hours} hours").alias("w"), "job_id").agg(F.max("ts").alias("updated_at"))
    return live.select("job_id", F.col("updated_at").cast("timestamp_ntz").alias("updated_at"))


def expire_jobs(jobs: DataFrame, now: Column, hours: int = 1) -> DataFrame:
    return jobs.where(F.col("updated_at") >= now - F.expr(f"INTERVAL {hours} HOURS"))


def run_to_table(stream: DataFrame, path: str) -> DataFrame:
    """Drains what a stream's source holds into Parquet and reads it back."""
    writer = stream.writeStream.option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True)
    writer.format("parquet").option("path", f"{path}/rows").outputMode("append").start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/rows")


ON_DISK = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


@contextmanager
def state_on_disk(spark: SparkSession) -> Iterator[None]:
    """Queries that start inside keep their state in RocksDB, on the executors' disks; a batch checkpoints only what it
    changes, however much the state holds."""
    before = {k: spark.conf.get(k, None) for k in ON_DISK}
    for k, v in ON_DISK.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def alert_once(attempts: DataFrame, path: str) -> DataFrame:
    """One alert for each (student, test) of a stream, however late it comes again. What was told is keyed state on disk, so
    a batch costs what it holds and not what was told before; the file sink writes each batch once."""
    with state_on_disk(attempts.sparkSession):
        return run_to_table(attempts.select("student_id", "test_id").dropDuplicates(["student_id", "test_id"]), path)


def submitted_answers(answers: DataFrame, attempts: DataFrame, most: str = "1 day", early: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Stream-stream join: answers (attempt_id, question_id, answered_at, ...) of attempts (id, test_id, started_at).

    An answer counts for ``most`` after its attempt's start, and for ``early`` before it, as clocks differ. Both sides have
    watermarks, so an attempt's state goes once no answer can come for it, and an answer's once its attempt would have come.
    What comes after the watermark is dropped."""
    a = attempts.select(F.col("id").alias("sat_id"), "test_id", F.col("started_at").cast("timestamp").alias("started_at")).withWatermark("started_at", late)
    rows = answers.withColumn("answered_at", F.col("answered_at").cast("timestamp")).withWatermark("answered_at", late)
    span = F.expr(f"attempt_id = sat_id AND answered_at >= started_at - INTERVAL {early} AND answered_at <= started_at + INTERVAL {most}")
    return rows.join(a, span).drop("sat_id")


def graded_answers(spark: SparkSession, path: str, order: str) -> MergeTable:
    """The graded last answer of each (attempt, question). ``order``: the type of column ``seq`` that settles which is last."""
    schema = f"attempt_id long, question_id long, seq {order}, is_correct boolean, marks_obtained double, net double"

    def last(rows: DataFrame) -> DataFrame:
        return rows.groupBy("attempt_id", "question_id").agg(F.max(F.struct("seq", "is_correct", "marks_obtained", "net")).alias("x")).select("attempt_id", "question_id", "x.*")

    return MergeTable(spark, path, schema, last)


def last_answers(spark: SparkSession, path: str, order: str) -> MergeTable:
    """The last answer of each (attempt, question) that was submitted, whether its attempt has come or not. ``order``: the type
    of column ``seq`` that settles which is last."""

    def last(rows: DataFrame) -> DataFrame:
        return rows.groupBy("attempt_id", "question_id").agg(F.max(F.struct("seq", "selected_option", "answer_text")).alias("x")).select("attempt_id", "question_id", "x.*")

    return MergeTable(spark, path, f"attempt_id long, question_id long, seq {order}, selected_option string, answer_text string", last)


def begun_attempts(spark: SparkSession, path: str) -> MergeTable:
    """The test of each attempt that has begun."""
    return MergeTable(spark, path, "attempt_id long, test_id long", lambda rows: rows.groupBy("attempt_id").agg(F.max("test_id").alias("test_id")))


def grade_batch(submitted: DataFrame, questions: DataFrame, tests: DataFrame) -> DataFrame:
    """Partial rows of ``graded_answers`` from a batch of answers that have their attempt's test: the batch rules."""
    key = questions.select(F.col("id").alias("question_id"), "test_id", "question_type", "correct_option", "marks")
    cost = tests.select(F.col("id").alias("test_id"), penalty(F.col("negative_marks")).alias("penalty"))
    rows = marked(submitted.join(key, ["question_id", "test_id"]).join(cost, "test_id"))
    return rows.select("attempt_id", "question_id", "seq", "is_correct", "marks_obtained", "net")
