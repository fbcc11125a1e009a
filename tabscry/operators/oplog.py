"""Statistics over operation logs and usage tables."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabscry.functions.numeric import ratio, rounded
from tabscry.functions.temporal import stamp
from tabscry.operators import running

c = F.col


def execution_stats(runs: DataFrame, table: str, success: Column, duration: str, finished: str) -> DataFrame:
    """Runs, successes, failures, success %, mean duration and last run per table."""
    return (
        runs.groupBy(table)
        .agg(
            F.count(F.lit(1)).alias("total_executions"),
            F.count_if(success).alias("successful_executions"),
            F.avg(duration).alias("avg_duration"),
            F.max(finished).alias("last_execution"),
        )
        .select(
            table,
            "total_executions",
            "successful_executions",
            (c("total_executions") - c("successful_executions")).alias("failed_executions"),
            ratio(c("successful_executions") * 100, c("total_executions"), 2).alias("success_rate"),
            rounded(c("avg_duration"), 2).alias("avg_duration_seconds"),
            stamp(c("last_execution")).alias("last_execution"),
        )
    )


def execution_history(runs: DataFrame, table: str, started: str, run_id: str, n: int = 10) -> DataFrame:
    """Latest n runs per table. Spark keeps n rows per table and partition before the shuffle."""
    newest = Window.partitionBy(table).orderBy(F.desc(started), F.desc(run_id))
    return runs.withColumn("run_no", F.row_number().over(newest)).filter(c("run_no") <= n)


def task_metrics(log: DataFrame, keys: Sequence[str], success: Column, duration: str) -> DataFrame:
    """Count, successes, failures, total duration and progress % per key."""
    return (
        log.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("tasks"), F.count_if(success).alias("succeeded"), F.sum(duration).alias("duration"))
        .select(
            *keys,
            "tasks",
            "succeeded",
            (c("tasks") - c("succeeded")).alias("failed"),
            rounded(c("duration"), 2).alias("duration"),
            F.floor(c("succeeded") * 100 / c("tasks")).alias("progress_pct"),
        )
    )


def call_batches(
    calls: DataFrame, agent: Sequence[str], start: str, end: str, call_id: str, grain: str = "day"
) -> DataFrame:
    """Number the batches of overlapping calls of each agent."""
    return running.overlap_batches(
        calls, agent, start, end, [start, call_id], F.date_trunc(grain, c(start)), output="batch_no", strict=False
    )


def usage_by_day(log: DataFrame, time: str, amount: str, days: int) -> DataFrame:
    """Sum per day within ``days`` of the newest day, newest first, with the total.

    The newest day is read first, so that the window is a constant the scan can prune by.
    """
    newest = log.agg(F.date_trunc("day", F.max(time))).first()[0]
    if newest is not None:
        since, kind = F.lit(newest - timedelta(days=days - 1)), log.schema[time].dataType
        log = log.filter(c(time) >= (since if kind.simpleString() == "string" else since.cast(kind)))
    # From here on there is one row per day; rows without a time have none.
    recent = log.groupBy(F.date_trunc("day", c(time)).alias("day")).agg(F.sum(amount).alias("used")).filter("day IS NOT NULL")
    total = recent.agg(F.sum("used").alias("total_used"))
    return (
        recent.join(F.broadcast(total), F.lit(True))
        .orderBy(F.desc("day"))
        .select(F.date_format("day", "yyyy-MM-dd").alias("day"), rounded(c("used"), 2).alias("used"), rounded(c("total_used"), 2).alias("total_used"))
    )


def window_start(time: Column, period_seconds: int) -> Column:
    """Start of the fixed window: ts - ts mod period, in epoch seconds."""
    seconds = F.unix_timestamp(time.cast("timestamp"))
    return seconds - F.pmod(seconds, F.lit(period_seconds))


def rate_violations(calls: DataFrame, user: str, path: str, time: str, limit: int, period_seconds: int) -> DataFrame:
    """Windows with more than ``limit`` calls of one user on one path."""
    return (
        calls.groupBy(user, path, window_start(c(time), period_seconds).alias("window_start"))
        .agg(F.count(F.lit(1)).alias("calls"))
        .filter(c("calls") > limit)
        .withColumn("rejected", c("calls") - limit)
    )
