"""Stored profiles against exact facts: ranges, bounds of the sketches, and merging without a second read."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabscry.operators import sketches as sk

BIG = 2**53 + 1


@pytest.fixture(scope="module")
def df(spark):
    rng = random.Random(5)
    rows = []
    for i in range(6000):
        # A third of the rows in one part, some without a part, one column of nulls.
        part = "a" if rng.random() < 0.33 else None if rng.random() < 0.1 else rng.choice("bcd")
        rows.append((part, BIG + i, rng.choice(["x", "y", None]), rng.gauss(0, 1) if rng.random() < 0.9 else None, None))
    return spark.createDataFrame(rows, "part string, id long, kind string, score double, gone double").repartition(5).cache()


def exact(rows, name):
    values = [r[name] for r in rows]
    held = sorted(v for v in values if v is not None)
    return len(values), len(values) - len(held), len(set(held)), held


COLUMNS = ["id", "kind", "score", "gone"]


def test_profile_from_stored_parts(spark, df, tmp_path):
    path = sk.store_sketches(df, "part", COLUMNS, str(tmp_path / "p"))
    got = {r["column_name"]: r for r in sk.sketch_profile(sk.stored_sketches(spark, path, "part", T.StringType())).collect()}
    rows = df.collect()
    for name in COLUMNS:
        total, nulls, distinct, held = exact(rows, name)
        r = got[name]
        assert (r["total_rows"], r["null_count"], r["distinct_count"]) == (total, nulls, distinct)
        if name == "score":
            assert (r["min_value"], r["max_value"]) == (held[0], held[-1])
            for q, at in (("p25", 0.25), ("p50", 0.5), ("p75", 0.75)):
                assert abs(sum(v <= r[q] for v in held) / len(held) - at) < 0.03
    # Whole numbers above 2 ** 53 keep their last digit.
    assert (int(got["id"]["min_whole"]), int(got["id"]["max_whole"])) == (BIG, BIG + 5999)
    assert (got["gone"]["min_value"], got["gone"]["p50"], got["kind"]["p50"]) == (None, None, None)


def test_small_sketch_keeps_its_error_bound(df):
    got = sk.sketch_profile(sk.column_sketches(df, "part", ["id"], lg=9), lg=9).first()["distinct_count"]
    assert abs(got - 6000) < 6000 * 4 / 2 ** (9 / 2) and got != 0


def test_drift_reads_stored_rows_alone(spark, df, tmp_path):
    path = sk.store_sketches(df, "part", COLUMNS, str(tmp_path / "p"))
    stored = sk.stored_sketches(spark, path, "part", T.StringType())
    drift = sk.sketch_drift(stored.filter("part = 'a'"), stored.filter("part IN ('b', 'c')"))
    assert all("sketch" in f or "/p/" in f for f in drift.inputFiles())
    got = {r["column_name"]: r for r in drift.collect()}
    rows = df.collect()
    a, b = [r for r in rows if r["part"] == "a"], [r for r in rows if r["part"] in ("b", "c")]
    for name in COLUMNS:
        x, y = exact(a, name), exact(b, name)
        assert got[name]["total_rows_delta"] == y[0] - x[0] and got[name]["null_count_delta"] == y[1] - x[1]
        assert got[name]["unique_count_delta"] == y[2] - x[2]
        assert got[name]["shared_count"] == len(set(x[3]) & set(y[3]))
    assert got["gone"]["min_value_delta"] is None


def test_a_later_run_writes_its_parts_alone(spark, df, tmp_path):
    path = sk.store_sketches(df, "part", ["kind"], str(tmp_path / "p"))
    files = lambda: {p.name: p.stat().st_mtime_ns for p in (tmp_path / "p").rglob("*.parquet") if "part=b" not in str(p)}
    before = files()
    changed = df.filter("part = 'b'").limit(7).withColumn("kind", F.lit("new"))
    sk.store_sketches(changed, "part", ["kind"], path)
    assert files() == before
    got = {r["part"]: r for r in sk.stored_sketches(spark, path, "part", T.StringType()).collect()}
    assert got["b"]["total_rows"] == 7 and got["a"]["total_rows"] == df.filter("part = 'a'").count()
    assert got[None]["total_rows"] == df.filter("part IS NULL").count()


def test_empty_table_and_one_sided_columns(spark, df):
    empty = sk.column_sketches(df.limit(0), "part", COLUMNS)
    assert empty.count() == 0 and sk.sketch_profile(empty).count() == 0
    drift = sk.sketch_drift(sk.column_sketches(df, "part", ["kind"]), empty).collect()
    assert [(r["column_name"], r["total_rows_delta"]) for r in drift] == [("kind", None)]
