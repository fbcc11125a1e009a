"""Operation log, usage and streaming queries over events read as calls."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tabscry.functions.numeric import rounded
from tabscry.functions.temporal import stamp as stamp_col
from tabscry.operators import oplog
from tabscry.queries.quality_queries import shared_folder
from tabscry.queries.registry import BLANKED, query, rnd, stamp, table
from tabscry.streaming import checks

c = F.col


def succeeded():
    return c("event_type") != "error"


def runs(spark, d):
    return table(spark, d, "events").withColumn("table_id", c("user_id") % 10)


@query(
    "execution_stats",
    f"""SELECT user_id % 10 AS table_id, count(*) AS total_executions, count(*) FILTER (event_type <> 'error') AS successful_executions,
          count(*) FILTER (event_type = 'error') AS failed_executions, {rnd("count(*) FILTER (event_type <> 'error') * 100 / count(*)", 2)} AS success_rate,
          {rnd('avg(value)', 2)} AS avg_duration_seconds, {stamp('max(ts)')} AS last_execution FROM events GROUP BY 1""",
)
def execution_stats(spark, d):
    return oplog.execution_stats(runs(spark, d), "table_id", succeeded(), "value", "ts")


@query(
    "execution_history",
    """SELECT table_id, event_id, event_type, CAST(run_no AS INTEGER) AS run_no FROM
         (SELECT user_id % 10 AS table_id, event_id, event_type, row_number() OVER (PARTITION BY user_id % 10 ORDER BY ts DESC, event_id DESC) AS run_no FROM events)
       WHERE run_no <= 10""",
)
def execution_history(spark, d):
    return oplog.execution_history(runs(spark, d).select("table_id", "event_id", "event_type", "ts"), "table_id", "ts", "event_id").drop("ts")


@query(
    "task_metrics",
    f"""SELECT user_id, count(*) AS tasks, count(*) FILTER (event_type <> 'error') AS succeeded, count(*) FILTER (event_type = 'error') AS failed,
          {rnd('sum(value)', 2)} AS duration, CAST(floor(count(*) FILTER (event_type <> 'error') * 100 / count(*)) AS BIGINT) AS progress_pct
        FROM events GROUP BY 1""",
)
def task_metrics(spark, d):
    return oplog.task_metrics(table(spark, d, "events"), ["user_id"], succeeded(), "value")


CALLS = """calls AS (SELECT event_id, user_id, ts, ts + to_minutes(CAST(floor(value * 10) + 1 AS INTEGER)) AS ended FROM events),
   flagged AS (SELECT *, CASE WHEN max(ended) OVER w IS NULL OR max(ended) OVER w < ts THEN 1 ELSE 0 END AS opens FROM calls
     WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
   batched AS (SELECT *, CAST(sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS batch_no FROM flagged)"""
GAP = "make_dt_interval(0, 0, int(floor(value * 10) + 1), 0)"
SESSION_GAP = "make_interval(0, 0, 0, 0, 0, int(floor(value * 10) + 1), 0)"


@query("call_batches", f"WITH {CALLS} SELECT event_id, user_id, batch_no FROM batched")
def call_batches(spark, d):
    calls = table(spark, d, "events").withColumn("ended", c("ts") + F.expr(GAP))
    return oplog.call_batches(calls, ["user_id"], "ts", "ended", "event_id").select("event_id", "user_id", "batch_no")


@query(
    "call_batches_holes",
    """WITH calls AS (SELECT event_id, user_id, ts, ts + to_minutes(CAST(floor(value * 10) + 1 AS INTEGER)) AS ended
          FROM (SELECT event_id, value, CASE WHEN event_id % 13 <> 0 THEN user_id END AS user_id, CASE WHEN event_id % 17 <> 0 THEN ts END AS ts FROM events)),
        f AS (SELECT *, CASE WHEN ts IS NULL THEN NULL WHEN max(ended) OVER w IS NULL OR max(ended) OVER w < ts THEN 1 ELSE 0 END AS opens FROM calls
          WINDOW w AS (PARTITION BY user_id, ts IS NULL ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
        SELECT event_id, user_id, CASE WHEN ts IS NOT NULL THEN CAST(sum(opens) OVER (PARTITION BY user_id, ts IS NULL ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) END AS batch_no FROM f""",
)
def call_batches_holes(spark, d):
    """Call batches over null agents and starts: no call is lost."""
    calls = table(spark, d, "events").withColumn("user_id", F.when(c("event_id") % 13 != 0, c("user_id")))
    calls = calls.withColumn("ts", F.when(c("event_id") % 17 != 0, c("ts"))).withColumn("ended", c("ts") + F.expr(GAP))
    return oplog.call_batches(calls, ["user_id"], "ts", "ended", "event_id").select("event_id", "user_id", "batch_no")


@query(
    "usage_by_day",
    f"""WITH u AS (SELECT date_trunc('day', ts) AS day, sum(value) AS used FROM events GROUP BY 1),
        k AS (SELECT * FROM u WHERE day > (SELECT max(day) FROM u) - INTERVAL 14 DAY)
        SELECT strftime(day, '%Y-%m-%d') AS day, {rnd('used', 2)} AS used, {rnd('(SELECT sum(used) FROM k)', 2)} AS total_used FROM k""",
)
def usage_by_day(spark, d):
    return oplog.usage_by_day(table(spark, d, "events"), "ts", "value", 14)


RATES = """SELECT CAST(floor(epoch(ts)) AS BIGINT) - CAST(floor(epoch(ts)) AS BIGINT) % 86400 AS window_start, user_id, event_type, count(*) AS calls,
   count(*) - 2 AS rejected FROM events GROUP BY ALL HAVING count(*) > 2"""


@query("rate_violations", RATES)
def rate_violations(spark, d):
    return oplog.rate_violations(table(spark, d, "events"), "user_id", "event_type", "ts", limit=2, period_seconds=86400)


def event_stream(spark, d):
    schema = table(spark, d, "events").schema
    return checks.timed(checks.read_stream(spark, f"{d.rstrip('/')}/events.parquet", schema), "ts")


def fresh(spark, name):
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("stream_rate_violations", RATES)
def stream_rate_violations(spark, d):
    found = checks.rate_violations(event_stream(spark, d), "user_id", "event_type", "ts", 2, "1 day")
    target = checks.to_versions(found, fresh(spark, "rates"))
    return checks.newest_versions(spark, target, ["window_start", "user_id", "event_type"])


@query(
    "stream_quality",
    f"""WITH {BLANKED}, w AS (SELECT time_bucket(INTERVAL 15 MINUTE, ts) - to_minutes(CAST(15 * k AS INTEGER)) AS window_start, value FROM blanked, range(4) AS r(k))
        SELECT {stamp('window_start')} AS window_start, count(*) AS total_count, count(*) - count(value) AS null_count,
               {rnd('(count(*) - count(value)) / count(*)')} AS null_rate, {rnd('avg(value)', 8)} AS mean_value FROM w GROUP BY window_start""",
)
def stream_quality(spark, d):
    blanked = event_stream(spark, d).withColumn("value", F.when(c("event_id") % 7 != 0, c("value")))
    target = checks.to_versions(checks.quality_windows(blanked, "ts", "value"), fresh(spark, "quality"))
    rows = checks.newest_versions(spark, target, ["window_start"])
    return rows.select(
        stamp_col(c("window_start")).alias("window_start"), "total_count", "null_count",
        rounded(c("null_rate")).alias("null_rate"), rounded(c("mean_value"), 8).alias("mean_value"),
    )


@query(
    "stream_sessions",
    f"""WITH {CALLS} SELECT user_id, {stamp('min(ts)')} AS batch_start, {stamp('max(ended)')} AS batch_end, count(*) AS calls FROM batched GROUP BY user_id, batch_no""",
)
def stream_sessions(spark, d):
    sessions = checks.call_sessions(event_stream(spark, d), "user_id", "ts", SESSION_GAP)
    rows = checks.last_batch(spark, checks.to_versions(sessions, fresh(spark, "sessions"), mode="complete"))
    return rows.select("user_id", stamp_col(c("batch_start")).alias("batch_start"), stamp_col(c("batch_end")).alias("batch_end"), "calls")


@query(
    "stream_sessions_closed",
    f"""WITH {CALLS} SELECT user_id, {stamp('min(ts)')} AS batch_start, {stamp('max(ended)')} AS batch_end, count(*) AS calls FROM batched GROUP BY user_id, batch_no
        HAVING max(ended) <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""",
)
def stream_sessions_closed(spark, d):
    rows = checks.closed_sessions(spark, event_stream(spark, d), "user_id", "ts", SESSION_GAP, fresh(spark, "closed"))
    return rows.select("user_id", stamp_col(c("batch_start")).alias("batch_start"), stamp_col(c("batch_end")).alias("batch_end"), "calls")


@query("stream_reservoir")
def stream_reservoir(spark, d):
    schema = table(spark, d, "events").schema
    stream = checks.read_stream(spark, f"{d.rstrip('/')}/events.parquet", schema)
    return checks.reservoir(spark, stream, ["event_id"], 100, fresh(spark, "reservoir"))
