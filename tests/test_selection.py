"""Rows by rank: positions against a plain sort, and how little is left to order."""

import random

import pytest

from tabscry.operators.sampling import head_middle_tail
from tabscry.operators.selection import narrowed, rows_between
from tabscry.sources.relation import catalog_inventory


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    # A third of the rows share one leading value, some have none.
    lead = [5 if rng.random() < 0.33 else None if rng.random() < 0.05 else rng.randrange(1000) for _ in range(4000)]
    return [(a, f"k{i:05d}", i) for i, a in enumerate(lead)]


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, "a int, b string, position_of long").repartition(7).cache()


def in_order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))


@pytest.mark.parametrize("first, last", [(0, 10), (1900, 1950), (60, 400), (3990, 4000), (0, 4000), (-5, 3), (3999, 9000)])
def test_rows_between(df, rows, first, last):
    got = rows_between(df, ["a", "b"], first, last, bounds=8, enough=100).collect()
    want = list(enumerate(in_order(rows), 1))[max(first, 0) : last]
    assert sorted((r["position"], r["position_of"]) for r in got) == [(p, r[2]) for p, r in want]


def test_only_a_small_part_is_left(df):
    part, before, size = narrowed(df, ["a", "b"], 700, 720, 4000, bounds=16, enough=100)
    assert size <= 100 and part.count() == size and before <= 700 and before + size >= 720
    assert part.columns == df.columns


def test_equal_keys_end_the_search(spark):
    same = spark.createDataFrame([(1, i) for i in range(500)], "a int, v int")
    got = rows_between(same, ["a"], 100, 110, bounds=8, enough=20).collect()
    assert sorted(r["position"] for r in got) == list(range(101, 111)) and len({r["v"] for r in got}) == 10


def test_empty_ranges(df):
    assert rows_between(df.limit(0), ["a", "b"], 0, 5).count() == 0
    assert rows_between(df, ["a", "b"], 50, 50).columns == [*df.columns, "position"]


@pytest.mark.parametrize("n, target", [(4000, 90), (40, 90), (0, 90), (31, 90)])
def test_head_middle_tail(spark, rows, n, target):
    some = rows[:n]
    got = head_middle_tail(spark.createDataFrame(some, "a int, b string, v long"), ["a", "b"], target, bounds=8, enough=100)
    third, ordered = target // 3, list(enumerate(in_order(some), 1))
    middle = (n - third) // 2
    want = [(p, r[2], "head") for p, r in ordered if p <= third]
    want += [(p, r[2], "middle") for p, r in ordered if middle < p <= middle + third]
    want += [(p, r[2], "tail") for p, r in ordered if p > n - third]
    assert sorted((r["position"], r["v"], r["part"]) for r in got.collect()) == sorted(want)


def test_catalog_inventory_of_one_schema(spark, tmp_path):
    spark.sql(f"CREATE DATABASE inventory_test LOCATION '{tmp_path}'")
    try:
        for name, n in (("one", 3), ("none", 0)):
            spark.range(n).write.saveAsTable(f"inventory_test.{name}")
        got = [tuple(r) for r in catalog_inventory(spark, "inventory_test").collect()]
        assert [(name.rsplit(".", 1)[-1], n) for name, n in got] == [("none", 0), ("one", 3)]
        # Counting needs no column: the scan reads Parquet footers alone.
        assert "ReadSchema: struct<>" in spark.table("inventory_test.one").groupBy().count()._jdf.queryExecution().toString()
    finally:
        spark.sql("DROP DATABASE inventory_test CASCADE")
