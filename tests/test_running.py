from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import functions as F

from tabscry.operators.positions import with_position
from tabscry.operators.running import forward_fill, order_breaks, overlap_batches

START = datetime(2024, 1, 1)


def calls(n=3000, seed=3):
    """A third of the rows belongs to entity 0; many equal times; a third of the values missing."""
    rng = np.random.default_rng(seed)
    entity = np.where(rng.uniform(size=n) < 0.34, 0, rng.integers(1, 40, n))
    minute = rng.integers(0, 4000, n)
    value = [None if rng.uniform() < 0.33 else float(v) for v in rng.normal(size=n)]
    length = rng.integers(1, 90, n)
    return [
        (i, int(entity[i]), START + timedelta(minutes=int(minute[i])), value[i], START + timedelta(minutes=int(minute[i] + length[i])))
        for i in range(n)
    ]


SCHEMA = "id long, entity int, ts timestamp, value double, ended timestamp"


def test_forward_fill_equals_a_plain_loop(spark):
    rows = calls()
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r["id"]: r["value"] for r in forward_fill(df, "value", ["entity"], ["ts", "id"], F.date_trunc("hour", "ts")).collect()}
    last, want = {}, {}
    for i, e, _, v, _ in sorted(rows, key=lambda r: (r[2], r[0])):
        if v is not None:
            last[e] = v
        want[i] = last.get(e)
    assert got == want


def test_forward_fill_without_entity(spark):
    rows = calls(400)
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r["id"]: r["value"] for r in forward_fill(df, "value", [], ["ts", "id"], F.date_trunc("hour", "ts")).collect()}
    last, want = None, {}
    for i, _, _, v, _ in sorted(rows, key=lambda r: (r[2], r[0])):
        last = v if v is not None else last
        want[i] = last
    assert got == want


def test_overlap_batches_equal_a_plain_loop(spark):
    rows = calls()
    df = spark.createDataFrame(rows, SCHEMA)
    for strict in (True, False):
        out = overlap_batches(df, ["entity"], "ts", "ended", ["ts", "id"], F.date_trunc("hour", "ts"), strict=strict)
        got = {r["id"]: r["batch_no"] for r in out.collect()}
        reach, number, want = {}, {}, {}
        for i, e, ts, _, end in sorted(rows, key=lambda r: (r[2], r[0])):
            free = e not in reach or (reach[e] <= ts if strict else reach[e] < ts)
            if free:
                number[e] = number.get(e, 0) + 1
            reach[e] = max(end, reach.get(e, end))
            want[i] = number[e]
        assert got == want


def test_order_breaks_across_slices(spark):
    values = [1, 2, 3, 2, 5, 6, 4, 4, 9, 1]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "k long, v int")
    for width in (1, 3, 100):
        row = order_breaks(df, "v", "k", slice_rows=width).first()
        assert (row["n_rows"], row["breaks"]) == (10, 3)
    empty = order_breaks(df.limit(0), "v", "k").first()
    assert (empty["n_rows"], empty["breaks"]) == (0, 0)


def test_positions_with_a_hot_leading_value(spark):
    rows = [(1 if i % 3 else i, i) for i in range(5000)]
    df = spark.createDataFrame(rows, "a long, b long").repartition(7)
    got = {r["b"]: r["position"] for r in with_position(df, ["a", "b"]).collect()}
    want = {b: n + 1 for n, (_, b) in enumerate(sorted(rows))}
    assert got == want


def test_order_breaks_takes_no_task_per_slice(spark):
    df = spark.range(40_000).select(F.col("id").alias("k"), (F.col("id") % 1000).alias("v"))
    before = len(spark.sparkContext.statusTracker().getJobIdsForGroup("breaks"))
    spark.sparkContext.setJobGroup("breaks", "")
    try:
        row = order_breaks(df, "v", "k", slice_rows=100).first()
        tracker = spark.sparkContext.statusTracker()
        stages = {s for j in tracker.getJobIdsForGroup("breaks")[before:] for s in tracker.getJobInfo(j).stageIds}
        tasks = [info.numTasks for info in map(tracker.getStageInfo, stages) if info]
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert (row["n_rows"], row["breaks"]) == (40_000, 39)
    assert tasks and max(tasks) <= 100
