"""Metamorphic checks of scan, plan, approve, apply, audit and rollback."""

import os
import uuid

import pytest
from pyspark.sql import functions as F

from tabscry.operators import repair as r
from tabscry.operators import scans as s
from tabscry.plans import repair_plan as rp
from tabscry.queries.quality_queries import approvals_of
from tabscry.queries.registry import events_blanked, table
from tabscry.sources import relation as rel
from tabscry.sources import versions


@pytest.fixture(scope="module")
def blanked(spark, sf_dir):
    return events_blanked(spark, sf_dir).cache()


def as_rows(df):
    return sorted(tuple(map(repr, x)) for x in df.select(*sorted(df.columns)).collect())


@pytest.mark.parametrize("strategy", ["mean", "median", "min", "max", "zero", "mode"])
def test_fill_then_scan_finds_no_null(blanked, strategy):
    out = r.fill(blanked, "value", strategy)
    assert s.scan_nulls(out, ["value"]).first()["null_count"] == 0
    assert out.count() == blanked.count()
    assert out.columns == blanked.columns


@pytest.mark.parametrize("strategy", ["mean", "median", "mode"])
def test_conflict_repair_then_scan_finds_no_conflict(spark, sf_dir, strategy):
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    keys = ["l_orderkey", "l_linenumber"]
    assert s.scan_conflicts(line, "l_quantity", keys).first()["conflict_groups"] > 0
    fixed = r.repair_conflicts(line, "l_quantity", keys, strategy)
    assert s.scan_conflicts(fixed, "l_quantity", keys).first()["conflict_groups"] == 0
    assert fixed.count() == line.count()


def test_rollback_undoes_apply(blanked):
    request = rp.RepairRequest(column="event_type", null_strategy="mode", row_id="event_id", table_ref="events")
    new = rp.repaired(blanked, request)
    changes = r.audit(blanked, new, "event_id", "event_type", "p", "null_repair")
    impact = {x["step"]: x["affected_rows"] for x in r.repair_impact(blanked, "event_type").collect()}
    assert changes.count() == impact["null_repair"]
    assert as_rows(r.rollback(new, changes, "event_id", "event_type")) == as_rows(blanked)


def test_one_pass_audit_equals_the_join_of_two_versions(blanked):
    request = rp.RepairRequest(
        column="value", null_strategy="group_median", fill_group_by=("event_type",), group_by=("user_id",),
        conflict_strategy="median", row_id="event_id",
    )
    joined = r.audit(blanked, rp.repaired(blanked, request), "event_id", "value", "p", "x", with_time=False)
    assert as_rows(rp.repair_audit(blanked, request, "p", "x", with_time=False)) == as_rows(joined)


def test_rollback_without_changes_is_identity(blanked):
    nothing = r.audit(blanked, blanked, "event_id", "value", "p", "null_repair")
    assert nothing.count() == 0
    assert as_rows(r.rollback(blanked, nothing, "event_id", "value")) == as_rows(blanked)


REQUEST = rp.RepairRequest(column="value", null_strategy="median", row_id="event_id", table_ref="events")


def test_same_data_and_strategies_give_the_same_plan(blanked):
    first, again = rp.repair_plan(blanked, REQUEST).first(), rp.repair_plan(blanked.repartition(5), REQUEST).first()
    assert (first["plan_id"], first["plan_hash"], first["signature"]) == (again["plan_id"], again["plan_hash"], again["signature"])
    other = rp.repair_plan(blanked, rp.RepairRequest(column="value", null_strategy="mean", row_id="event_id", table_ref="events")).first()
    assert other["plan_hash"] != first["plan_hash"] and other["signature"] == first["signature"]
    changed = rp.repair_plan(blanked.filter("event_id > 3"), REQUEST).first()
    assert changed["signature"] != first["signature"]


def test_plan_flags(spark, blanked):
    clean = rp.repair_plan(r.fill(blanked, "value", "median"), REQUEST).collect()
    assert len(clean) == 1 and clean[0]["step"] is None and clean[0]["summary"] == "nothing to repair"
    small = s.snapshot(blanked.filter("event_id < 20"), "value")
    unsure = rp.repair_plan(blanked, REQUEST, sample=small).first()
    assert unsure["forbidden"] and not unsure["apply_ready"]
    assert "total_count_mismatch" in unsure["inconsistency_reasons"]
    empty = spark.createDataFrame([(1, None)], "event_id long, value double")
    step = rp.repair_plan(empty, REQUEST).first()
    assert step["requires_manual_default"] and step["fill_value"] is None
    grouped = rp.repair_plan(empty, rp.RepairRequest(column="value", null_strategy="median", fill_group_by=("event_id",), table_ref="t")).first()
    assert grouped["strategy"] == "group_median_impute" and not grouped["requires_manual_default"]


def test_in_place_needs_a_row_id(blanked):
    request = rp.RepairRequest(column="value", null_strategy="median", table_ref="events", apply_mode="source_table")
    assert not rp.repair_plan(blanked, request).first()["apply_ready"]


def test_apply_to_source(spark, blanked, tmp_path):
    view = f"v_{uuid.uuid4().hex[:8]}"
    blanked.createOrReplaceTempView(view)
    plan = rp.repair_plan(blanked, REQUEST)
    audit = str(tmp_path / "audit")
    stale = rp.repair_plan(blanked.filter("event_id > 3"), REQUEST)
    refusals = {
        "approval_required": approvals_of(plan).limit(0),
        "approval_missing_plan_info": approvals_of(plan).withColumn("approved_plan_id", F.lit(None).cast("string")),
        "approval_plan_mismatch": approvals_of(plan).withColumn("approved_plan_hash", F.lit("other")),
    }
    for status, approvals in refusals.items():
        with pytest.raises(PermissionError, match=status):
            rp.apply_to_source(spark, view, REQUEST, str(tmp_path), plan, approvals, audit)
        with pytest.raises(PermissionError, match=status):
            rp.apply_to_copy(blanked, REQUEST, str(tmp_path / "refused"), plan, approvals)
    with pytest.raises(PermissionError, match="snapshot_mismatch"):
        rp.apply_to_source(spark, view, REQUEST, str(tmp_path), stale, approvals_of(stale), audit)
    assert s.scan_nulls(spark.table(view), ["value"]).first()["null_count"] > 0
    path = rp.apply_to_source(spark, view, REQUEST, str(tmp_path), plan, approvals_of(plan), audit)
    changes = spark.read.parquet(audit)
    assert {x["plan_id"] for x in changes.select("plan_id").distinct().collect()} == {plan.first()["plan_id"]}
    assert as_rows(r.rollback(spark.read.parquet(path), changes, "event_id", "value")) == as_rows(blanked)
    assert s.scan_nulls(spark.table(view), ["value"]).first()["null_count"] == 0
    assert changes.count() == s.scan_nulls(blanked, ["value"]).first()["null_count"]
    assert spark.read.parquet(path).count() == blanked.count()


def test_copy_is_never_overwritten(spark, blanked, tmp_path):
    target = str(tmp_path / "copy")
    plan = rp.repair_plan(blanked, REQUEST)
    rp.apply_to_copy(blanked, REQUEST, target, plan, approvals_of(plan))
    with pytest.raises(Exception, match="(?i)already exists"):
        rp.apply_to_copy(blanked, REQUEST, target, plan, approvals_of(plan))


def test_the_planned_strategy_runs(spark, tmp_path):
    rows = [(1, "a", None), (2, "a", None), (3, "b", None)]
    df = spark.createDataFrame(rows, "event_id long, g string, value double")
    manual = rp.RepairRequest(column="value", null_strategy="median", row_id="event_id", table_ref="t")
    plan = rp.repair_plan(df, manual)
    assert not plan.first()["apply_ready"]
    with pytest.raises(PermissionError, match="not_apply_ready"):
        rp.apply_to_copy(df, manual, str(tmp_path / "x"), plan, approvals_of(plan))
    grouped = rp.RepairRequest(column="value", null_strategy="median", fill_group_by=("g",), row_id="event_id", table_ref="t")
    plan = rp.repair_plan(df, grouped)
    assert plan.first()["strategy"] == "group_median_impute"
    assert rp.repaired_by_plan(df, grouped, plan).filter("value IS NULL").count() == 3
    twice = rp.repair_plan(df.union(df), grouped)
    assert not twice.first()["apply_ready"]


def test_audit_has_a_type_per_step_and_rollback_restores(spark, blanked, tmp_path):
    request = rp.RepairRequest(
        column="value", null_strategy="median", group_by=("user_id",), conflict_strategy="median", row_id="event_id", table_ref="events"
    )
    plan = rp.repair_plan(blanked, request)
    path = rp.apply_to_copy(blanked, request, str(tmp_path / "t"), plan, approvals_of(plan), str(tmp_path / "a"))
    audit = spark.read.parquet(str(tmp_path / "a"))
    assert {x["repair_type"] for x in audit.select("repair_type").distinct().collect()} == {"null_repair", "conflict_repair"}
    assert as_rows(r.rollback(spark.read.parquet(path), audit, "event_id", "value")) == as_rows(blanked)


@pytest.mark.parametrize("strategy", ["mean", "median", "min", "zero", "mode", "ffill", "group_median"])
def test_no_strategy_loses_rows(spark, strategy):
    rows = [(i, None if i % 3 == 0 else i % 4, None if i % 5 == 0 else f"2024-01-0{1 + i % 7} 10:00:00", None if i % 2 else float(i)) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, k long, t string, v double").withColumn("t", F.col("t").cast("timestamp"))
    out = r.repair_nulls(df, "v", strategy, order_by=["t", "id"], entity=["k"], group_by=["k"])
    assert out.count() == 60 and sorted(x["id"] for x in out.collect()) == list(range(60))


def test_whole_number_columns_take_the_nearest_number(spark):
    df = spark.createDataFrame([(1, 1), (2, 2), (3, None)], "id long, n int")
    assert r.fill(df, "n", "mean").filter("id = 3").first()["n"] == 2


def test_formats_and_relations(spark, sf_dir, tmp_path):
    nation = table(spark, sf_dir, "nation")
    for kind in ("json", "orc", "csv", "parquet"):
        path = rel.publish(nation, str(tmp_path / kind), kind, **({"header": "true"} if kind == "csv" else {}))
        assert as_rows(rel.ingest(spark, path, nation.schema, kind)) == as_rows(nation)
    nation.createOrReplaceTempView("nation_view")
    assert rel.relation(spark, "nation_view").count() == 25
    assert rel.relation(spark, "SELECT * FROM nation_view WHERE n_regionkey = 1;").count() == 5
    assert rel.relation(spark, f"{sf_dir}/nation.parquet").count() == 25
    bad = tmp_path / "bad"
    spark.createDataFrame([("x", "name", "y")], nation.columns).write.option("header", "true").csv(str(bad))
    with pytest.raises(Exception):
        rel.ingest(spark, str(bad), nation.schema).collect()


def test_head_and_tail_make_the_total(spark, sf_dir):
    from tabscry.operators.profiling import category_groups

    groups = category_groups(table(spark, sf_dir, "part"), "p_type", 2).collect()
    assert sum(g["category_count"] for g in groups) + groups[0]["tail_count"] == table(spark, sf_dir, "part").count()


def test_histogram_counts_every_value(spark, blanked):
    from tabscry.operators.series import histogram

    total = histogram(blanked, "value").agg(F.sum("n")).first()[0]
    assert total == blanked.filter("value IS NOT NULL").count()


def test_column_workflow(spark, sf_dir):
    from tabscry.plans.column_workflow import analyze_column, semantic_type_of

    events = events_blanked(spark, sf_dir)
    assert semantic_type_of(events, "value") == "numeric"
    found = analyze_column(events, "value", "numeric", time="ts", group_by=["user_id"], numerics=["user_id", "value"])
    assert set(found) == {"nulls", "conflicts", "distribution", "correlations", "periodicity", "time_series", "histogram", "facts"}
    assert all(df.count() > 0 for df in found.values())
    kinds = {"event_type": "categorical", "ts": "temporal", "props": "text", "event_id": "id"}
    for column, kind in kinds.items():
        assert all(df.count() > 0 for df in analyze_column(events, column, kind, numerics=["value"]).values())


def test_signature_follows_the_content(spark):
    rows = [(1, "a", 1.0, None), (2, "a", 2.0, "x"), (3, "b", None, "y"), (3, "b", None, "y")]
    sign = lambda data, n=1: s.snapshot(spark.createDataFrame(data, "id long, g string, v double, t string").repartition(n), "v", ["g"]).first()["signature"]
    first = sign(rows)
    assert first == sign(rows[::-1], 3)
    others = [
        [(1, "a", 2.0, None), (2, "a", 1.0, "x"), *rows[2:]],  # two values changed places
        [(1, "a", 1.0, "x"), (2, "a", 2.0, None), *rows[2:]],
        [*rows[:2], (3, "b", None, "z"), (3, "b", None, "z")],  # a pair of equal rows changed alike
        rows[:3], [*rows, rows[0]], [*rows[:2], (3, None, None, "b"), (3, "b", None, "y")],
    ]
    assert len({first, *map(sign, others)}) == 7
    nested = spark.createDataFrame([(1, [1, None], {"a": 1})], "id long, v array<int>, m map<string,int>")
    other = spark.createDataFrame([(1, [None, 1], {"a": 1})], nested.schema)
    assert s.snapshot(nested, "id").first()["signature"] != s.snapshot(other, "id").first()["signature"]
    assert s.snapshot(nested.limit(0), "id").first()["signature"]


def test_an_edit_after_the_plan_is_refused(spark, tmp_path):
    df = spark.createDataFrame([(1, 1.0), (2, None), (3, 5.0)], "event_id long, value double")
    request = rp.RepairRequest(column="value", null_strategy="mean", row_id="event_id", table_ref="t")
    plan = rp.repair_plan(df, request)
    edited = df.withColumn("value", F.when(F.col("event_id") == 1, 5.0).when(F.col("event_id") == 3, 1.0))
    with pytest.raises(PermissionError, match="snapshot_mismatch"):
        rp.apply_to_copy(edited, request, str(tmp_path / "t"), plan, approvals_of(plan))


def test_the_exact_fill_is_written(spark, tmp_path):
    df = spark.createDataFrame([(1, 1.2e-5), (2, None), (3, 1.6e-5)], "event_id long, value double")
    request = rp.RepairRequest(column="value", null_strategy="mean", row_id="event_id", table_ref="t")
    plan = rp.repair_plan(df, request)
    path = rp.apply_to_copy(df, request, str(tmp_path / "t"), plan, approvals_of(plan))
    want = df.agg(F.avg("value")).first()[0]
    assert spark.read.parquet(path).filter("event_id = 2").first()["value"] == want != 0


def test_conflicts_are_those_of_the_plan(spark, tmp_path):
    rows = [(1, "A", 5.0), (2, "A", None), (3, "B", 7.0), (4, "B", 9.0), (5, "B", None), (6, "C", 7.0)]
    df = spark.createDataFrame(rows, "event_id long, g string, value double")
    request = rp.RepairRequest(column="value", null_strategy="median", conflict_strategy="median", group_by=("g",), row_id="event_id", table_ref="t")
    plan = rp.repair_plan(df, request)
    assert {x["step"]: x["estimated_groups"] for x in plan.collect()}["conflict_repair"] == 1
    path = rp.apply_to_copy(df, request, str(tmp_path / "t"), plan, approvals_of(plan), str(tmp_path / "a"))
    got = {x["event_id"]: x["value"] for x in spark.read.parquet(path).collect()}
    assert got == {1: 5.0, 2: 7.0, 3: 8.0, 4: 8.0, 5: 8.0, 6: 7.0}
    audit = spark.read.parquet(str(tmp_path / "a"))
    assert sorted(map(tuple, audit.select("row_id", "repair_type", "before", "after").collect()), key=repr) == sorted(
        [("2", "null_repair", None, "7.0"), ("5", "null_repair", None, "7.0"), ("3", "conflict_repair", "7.0", "8.0"),
         ("4", "conflict_repair", "9.0", "8.0"), ("5", "conflict_repair", "7.0", "8.0")], key=repr)
    assert as_rows(r.rollback(spark.read.parquet(path), audit, "event_id", "value")) == as_rows(df)


def test_only_files_with_changed_rows_are_rewritten(spark, tmp_path):
    root, source = str(tmp_path / "table"), str(tmp_path / "source")
    rows = [(i, f"g{i // 10}", None if i in (31, 35, 72) else float(i)) for i in range(100)]
    df = spark.createDataFrame(rows, "event_id long, g string, value double")
    df.repartitionByRange(10, "event_id").write.parquet(source)
    versions.start(spark, root, source)
    before = {f: os.stat(f.removeprefix("file://")).st_mtime_ns for f in versions.files_of(spark, root)}
    request = rp.RepairRequest(column="value", null_strategy="zero", row_id="event_id", table_ref="t")
    plan = rp.repair_plan(versions.read(spark, root), request)
    with pytest.raises(PermissionError, match="approval_required"):
        rp.apply_to_files(spark, root, request, plan, approvals_of(plan).limit(0), str(tmp_path / "a"))
    assert rp.apply_to_files(spark, root, request, plan, approvals_of(plan), str(tmp_path / "a")) == 1
    kept = set(versions.files_of(spark, root)) & set(before)
    assert len(before) - len(kept) == 2
    assert all(os.stat(f.removeprefix("file://")).st_mtime_ns == t for f, t in before.items())
    want = [(i, g, 0.0 if v is None else v) for i, g, v in rows]
    assert sorted(map(tuple, versions.read(spark, root).collect())) == want
    assert spark.read.parquet(str(tmp_path / "a")).count() == 3
    again = rp.repair_plan(versions.read(spark, root), request)
    assert again.filter("step IS NOT NULL").isEmpty()
    assert versions.restore(spark, root, 0) == 2
    assert as_rows(versions.read(spark, root)) == as_rows(df) and sorted(map(tuple, versions.read(spark, root, 1).collect())) == want
