"""Physical plans: pruned scans, no products of tables, bounded one-task windows."""

import pytest

from tabscry.operators import oplog, profiling, sampling, typing_rules
from tabscry.operators import scans as s
from tabscry.operators.positions import with_position
from tabscry.queries import QUERIES
from tabscry.queries.registry import table


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_null_scan_reads_one_column_in_one_scan(spark, sf_dir):
    text = plan(s.scan_nulls(table(spark, sf_dir, "lineitem"), ["l_tax"]))
    assert text.count("FileScan parquet") == 1
    assert "ReadSchema: struct<l_tax:double>" in text


def test_correlations_take_one_scan(spark, sf_dir):
    assert plan(profiling.correlations(table(spark, sf_dir, "lineitem"), "l_tax")).count("FileScan parquet") == 1


def test_filter_reaches_the_scan(spark, sf_dir):
    text = plan(table(spark, sf_dir, "orders").filter("o_totalprice > 1000").select("o_orderkey"))
    assert "GreaterThan(o_totalprice,1000.0)" in text


def test_sample_is_a_top_k(spark, sf_dir):
    assert "TakeOrderedAndProject" in plan(sampling.random_rows(table(spark, sf_dir, "orders"), ["o_orderkey"], 10))


def test_look_back_reaches_the_scan(spark, sf_dir):
    text = plan(oplog.usage_by_day(table(spark, sf_dir, "events"), "ts", "value", 7))
    assert "GreaterThanOrEqual(ts," in text


def test_positions_move_the_rows_once(spark, sf_dir):
    text = plan(with_position(table(spark, sf_dir, "orders"), ["o_orderdate", "o_orderkey"]))
    # After the written placement only the counts per partition are exchanged.
    assert "hashpartitioning(_part" in text and text.count("Exchange hashpartitioning") == 1
    assert "SortMergeJoin" not in text and "o_orderkey" not in text.split("Exchange hashpartitioning")[1].split("Scan")[0]


def test_top_rows_per_group_are_pruned_before_the_shuffle(spark, sf_dir):
    runs = table(spark, sf_dir, "events")
    assert "WindowGroupLimit" in plan(oplog.execution_history(runs, "user_id", "ts", "event_id", 3))


@pytest.mark.parametrize(
    "name", ["conflict_rows", "scan_conflicts", "fill_group_median", "repair_conflict_mode", "cooccurrence_edges", "summarize_groups", "repair_audit"]
)
def test_no_product_of_tables(spark, sf_dir, name):
    text = plan(QUERIES[name](spark, sf_dir))
    assert "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text


@pytest.mark.parametrize("name", ["fill_forward", "call_batches", "summarize_rows", "repair_conflict_mean"])
def test_no_window_over_the_whole_table(spark, sf_dir, name):
    text = plan(QUERIES[name](spark, sf_dir))
    assert "Exchange SinglePartition" not in text


def test_evidence_takes_one_scan_and_shuffles_digests(spark, sf_dir):
    text = plan(typing_rules.evidence(table(spark, sf_dir, "pages")))
    assert text.count("FileScan parquet") == 1
    keys = [line for line in text.splitlines() if "Exchange hashpartitioning" in line]
    assert keys and all("html" not in k and "url" not in k and "raw_" not in k for k in keys)


def test_facts_and_flags_share_their_scans(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    assert plan(profiling.numeric_flags(lines)).count("FileScan parquet") == 2
    assert plan(s.scan_conflicts(lines, ["l_tax", "l_discount"], ["l_orderkey"])).count("FileScan parquet") == 1
