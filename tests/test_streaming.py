"""Streams against the batch result, over several files and micro-batches."""

import pytest
from pyspark.sql import functions as F

from tabscry.operators import oplog, sampling
from tabscry.queries.registry import table
from tabscry.streaming import checks


@pytest.fixture(scope="module")
def parts(spark, sf_dir, tmp_path_factory):
    """events cut into files by time, so later micro-batches hold later rows."""
    folder = str(tmp_path_factory.mktemp("events"))
    events = table(spark, sf_dir, "events")
    bounds = [i * 250 for i in range(5)]
    for low in bounds:
        events.filter(F.col("event_id").between(low, low + 249)).coalesce(1).write.mode("append").parquet(folder)
    return folder, events


def stream_of(spark, parts):
    return checks.read_stream(spark, parts[0], parts[1].schema, files_per_batch=1)


def test_rate_violations_over_micro_batches(spark, parts, tmp_path):
    stream = checks.timed(stream_of(spark, parts), "ts", "40 days")
    target = checks.to_versions(checks.rate_violations(stream, "user_id", "event_type", "ts", 1, "1 day"), str(tmp_path))
    assert spark.read.parquet(target).select("batch").distinct().count() > 1
    got = checks.newest_versions(spark, target, ["window_start", "user_id", "event_type"])
    seen = parts[1].filter("event_id < 1250")
    want = oplog.rate_violations(seen, "user_id", "event_type", "ts", 1, 86400)
    key = lambda df: sorted((x["window_start"], x["user_id"], x["event_type"], x["calls"]) for x in df.collect())
    assert key(got) == key(want) and got.count() > 0


def test_append_mode_holds_back_open_windows(spark, parts, tmp_path):
    stream = checks.timed(stream_of(spark, parts), "ts", "0 seconds")
    target = checks.to_versions(checks.quality_windows(stream, "ts", "value", "1 hour", "1 hour"), str(tmp_path), mode="append")
    got = {x["window_start"]: x["total_count"] for x in spark.read.parquet(target).collect()}
    batch = parts[1].filter("event_id < 1250").groupBy(F.window("ts", "1 hour").start.alias("w")).count()
    want = {x["w"]: x["count"] for x in batch.collect()}
    assert got and all(want[w] >= n for w, n in got.items())
    assert max(want) not in got


def test_reservoir_over_micro_batches_equals_batch_sample(spark, parts, tmp_path):
    got = checks.reservoir(spark, stream_of(spark, parts), ["event_id"], 40, str(tmp_path))
    want = sampling.random_rows(parts[1].filter("event_id < 1250"), ["event_id"], 40)
    assert sorted(x["event_id"] for x in got.collect()) == sorted(x["event_id"] for x in want.collect())


def test_reservoir_survives_a_restart_without_new_input(spark, parts, tmp_path):
    run = lambda: sorted(x["event_id"] for x in checks.reservoir(spark, stream_of(spark, parts), ["event_id"], 10, str(tmp_path)).collect())
    first = run()
    assert len(first) == 10 and run() == first


@pytest.mark.parametrize("name", ["stream_rate_violations", "stream_quality", "stream_sessions", "stream_reservoir"])
def test_stream_queries_read_a_table_of_several_files(spark, sf_dir, tmp_path, name):
    from tabscry.queries import QUERIES

    table(spark, sf_dir, "events").repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    rows = lambda d: sorted(map(repr, QUERIES[name](spark, d).collect()))
    assert rows(str(tmp_path)) == rows(sf_dir)


def test_closed_sessions_are_written_once_over_restarts(spark, sf_dir, tmp_path):
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    source, gap = str(tmp_path / "in [1]{a}*"), "make_interval(0, 0, 0, 0, 2, 0, 0)"
    days = [r["d"] for r in events.select(F.to_date("ts").alias("d")).distinct().orderBy("d").collect()]
    run = lambda: checks.closed_sessions(
        spark, checks.timed(checks.read_stream(spark, source, events.schema, files_per_batch=1), "ts"), "user_id", "ts", gap, str(tmp_path / "out")
    )
    seen = 0
    for first in range(0, len(days), 10):
        for day in days[first : first + 10]:
            events.filter(F.to_date("ts") == day).coalesce(1).write.mode("append").parquet(source)
        got = [(r["user_id"], r["batch_start"], r["batch_end"], r["calls"]) for r in run().collect()]
        assert len(got) == len(set(got)) >= seen
        seen = len(got)
    whole = checks.call_sessions(events, "user_id", "ts", gap).select("user_id", "batch_start", "batch_end", "calls")
    passed = events.agg(F.expr("max(ts) - interval 1 hour")).first()[0]
    assert sorted(got) == sorted(tuple(r) for r in whole.filter(F.col("batch_end") <= F.lit(passed)).collect()) and got
