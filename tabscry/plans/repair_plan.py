"""Repair plans bound to a data snapshot, their approval and their execution."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabscry.operators import repair as r
from tabscry.operators.scans import plan_consistency, scan_conflicts, snapshot
from tabscry.session import broadcast_if_small, cut
from tabscry.sources import versions
from tabscry.sources.relation import publish, version_path

c = F.col

SINGLE_VALUE = ("zero_impute", "empty_string", "mean_impute", "median_impute", "mode_impute", "min_impute", "max_impute")


@dataclass(frozen=True)
class RepairRequest:
    """What to repair in one column, and with which context."""

    column: str
    null_strategy: str
    conflict_strategy: str = "mode_per_group"
    group_by: Sequence[str] = field(default_factory=tuple)
    fill_group_by: Sequence[str] = field(default_factory=tuple)
    order_by: Sequence[str] = field(default_factory=tuple)
    entity: Sequence[str] = field(default_factory=tuple)
    time: str | None = None
    row_id: str | None = None
    grain: str = "day"
    table_ref: str | None = None
    apply_mode: str = "fixing_table"
    audit_table: str | None = None


def _fill_facts(df: DataFrame, req: RepairRequest) -> DataFrame:
    """One row: the strategy that will be used, its fill value and the reason."""
    strategy = r.strategy_name(req.null_strategy)
    grouped = f"{r.NULL_REASON['group_median_impute']}{', '.join(req.fill_group_by)}."
    if strategy == "forward_fill" or strategy == "group_median_impute":
        reason = grouped if strategy == "group_median_impute" else r.NULL_REASON[strategy]
        return df.sparkSession.range(1).select(
            F.lit(strategy).alias("strategy"),
            F.lit(None).cast("string").alias("fill_value"),
            F.lit(reason).alias("reason"),
            F.lit("group_similarity" if strategy == "group_median_impute" else "analysis_rows_in_time_order").alias("basis"),
            F.lit(False).alias("requires_manual_default"),
        )
    value = r.fill_value(df, req.column, strategy)
    missing = c("fill_value").isNull()
    if req.fill_group_by:
        fallback, why, basis = "group_median_impute", grouped, "group_similarity"
    else:
        fallback, basis = strategy, "analysis_rows_non_null"
        why = "The column holds no value to fill from; name group columns or give a default."
    return value.select(
        F.when(missing, fallback).otherwise(strategy).alias("strategy"),
        c("fill_value").cast("string").alias("fill_value"),  # exact: what is approved is what is written
        F.when(missing, why).otherwise(r.NULL_REASON.get(strategy, "")).alias("reason"),
        F.when(missing, basis).otherwise("analysis_rows_non_null").alias("basis"),
        (missing & F.lit(not req.fill_group_by)).alias("requires_manual_default"),
    )


def _row_id_facts(df: DataFrame, req: RepairRequest) -> DataFrame:
    """One row: whether the row id names each row once, which audit and rollback rest on."""
    if not req.row_id:
        return df.sparkSession.range(1).select(F.lit(True).alias("row_ids_unique"))
    sizes = df.groupBy(req.row_id).agg(F.count(F.lit(1)).alias("_n"))
    bad = (c("_n") > 1) | c(req.row_id).isNull()
    return sizes.agg((F.count_if(bad) == 0).alias("row_ids_unique"))


def repair_plan(df: DataFrame, req: RepairRequest, sample: DataFrame | None = None) -> DataFrame:
    """Steps of the plan, one row each, with the plan's header beside them.

    The plan id and hash are digests of the snapshot signature and the steps:
    the same data and the same strategies give the same plan again. ``sample``
    is a snapshot row of an earlier scan to be held against the full one.
    """
    facts = snapshot(df, req.column, req.group_by, req.time)
    if req.group_by:
        conflicts = scan_conflicts(df, req.column, req.group_by).select("conflict_groups")
    else:
        conflicts = df.sparkSession.range(1).select(F.lit(0).cast("long").alias("conflict_groups"))
    checked = plan_consistency(facts, sample if sample is not None else facts).select("reasons", "inconsistent")
    sample_nulls = (sample if sample is not None else facts).select(c("null_count").alias("sample_nulls"))
    head = facts
    for one_row in (conflicts, checked, sample_nulls, _fill_facts(df, req), _row_id_facts(df, req)):
        head = head.join(F.broadcast(one_row), F.lit(True))

    null_step = F.when(
        c("null_count") > 0,
        F.struct(
            F.lit(1).alias("step_no"), F.lit("null_repair").alias("step"), c("strategy").alias("strategy"),
            c("null_count").alias("estimated_rows"), F.lit(None).cast("long").alias("estimated_groups"),
            c("fill_value").alias("fill_value"), c("reason").alias("reason"), c("basis").alias("basis"),
            c("requires_manual_default").alias("requires_manual_default"),
        ),
    )
    conflict_step = F.when(
        c("conflict_groups") > 0,
        F.struct(
            F.lit(2).alias("step_no"), F.lit("conflict_repair").alias("step"),
            F.lit(r.CONFLICT_NAMES.get(req.conflict_strategy, req.conflict_strategy)).alias("strategy"),
            c("conflict_rows").alias("estimated_rows"), c("conflict_groups").alias("estimated_groups"),
            F.lit(None).cast("string").alias("fill_value"),
            F.lit(f"Groups by {', '.join(req.group_by)} hold more than one value.").alias("reason"),
            F.lit("conflict_groups").alias("basis"), F.lit(False).alias("requires_manual_default"),
        ),
    )
    unsure = c("inconsistent") | ((c("null_count") == 0) & (c("sample_nulls") > 0)) | (c("null_count") > c("total_count"))
    can_apply = bool(req.table_ref) and (req.apply_mode == "fixing_table" or bool(req.row_id))
    settled = ~unsure & ~((c("null_count") > 0) & c("requires_manual_default")) & c("row_ids_unique")
    parts = F.array_compact(
        F.array(
            F.when(c("inconsistent"), "the figures contradict each other, please review by hand"),
            F.when(c("null_count") > 0, F.format_string("fill %d nulls by %s", c("null_count"), c("strategy"))),
            F.when(
                c("conflict_groups") > 0,
                F.format_string(f"settle %d groups by {req.conflict_strategy}", c("conflict_groups")),
            ),
        )
    )
    rollback = f"audit_table:{req.audit_table}" if req.audit_table else ("time_travel" if req.table_ref else "none")
    plan = head.select(
        c("column_name"),
        F.array_compact(F.array(null_step, conflict_step)).alias("steps"),
        c("signature"),
        c("total_count"),
        unsure.alias("requires_manual_review"),
        unsure.alias("forbidden"),
        (F.lit(can_apply) & settled).alias("apply_ready"),
        c("reasons").alias("inconsistency_reasons"),
        F.when(F.size(parts) > 0, F.array_join(parts, "; ")).otherwise("nothing to repair").alias("summary"),
        F.lit(rollback).alias("rollback"),
        F.lit(req.apply_mode).alias("apply_mode"),
        F.lit(req.table_ref).alias("table_ref"),
        F.lit(req.row_id).alias("row_id_column"),
    )
    body = F.to_json(F.struct("column_name", "steps", "signature", "apply_mode", "table_ref", "row_id_column", "rollback"))
    plan = plan.withColumn("plan_hash", F.sha2(body, 256)).withColumn(
        "plan_id", F.substring(F.sha2(F.concat_ws("|", "column_name", "plan_hash"), 256), 1, 32)
    )
    rest = [x for x in plan.columns if x != "steps"]
    return plan.select(*rest, F.inline_outer("steps"))


def check_approvals(plans: DataFrame, approvals: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Status of each plan: approved, or the first reason to refuse it.

    plans: keys, plan_id, plan_hash, signature, current_signature, forbidden,
    table_ref; approvals: keys, approved, approved_plan_id, approved_plan_hash,
    approved_signature.
    """
    given = c("approved_plan_id").isNotNull() & c("approved_plan_hash").isNotNull() & c("approved_signature").isNotNull()
    match = (
        (c("approved_plan_id") == c("plan_id"))
        & (c("approved_plan_hash") == c("plan_hash"))
        & (c("approved_signature") == c("signature"))
    )
    status = (
        F.when(c("forbidden"), "plan_inconsistent")
        .when(~F.coalesce("approved", F.lit(False)), "approval_required")
        .when(c("table_ref").isNull(), "table_ref_missing")
        .when(c("plan_id").isNull() | c("plan_hash").isNull(), "plan_missing")
        .when(~given, "approval_missing_plan_info")
        .when(~match, "approval_plan_mismatch")
        .when(~c("current_signature").eqNullSafe(c("approved_signature")), "snapshot_mismatch")
        .otherwise("approved")
    )
    return plans.join(approvals, list(keys), "left").withColumn("status", status)


def approved_plans(statuses: DataFrame, table: str) -> DataFrame:
    """Number of plans and of approved plans per table."""
    return statuses.groupBy(table).agg(
        F.count(F.lit(1)).alias("plans"), F.count_if(c("status") == "approved").alias("approved_plans")
    )


def repaired(df: DataFrame, req: RepairRequest) -> DataFrame:
    """The full table after the null repair and, with group columns, the conflict repair."""
    out = r.repair_nulls(
        df, req.column, req.null_strategy, order_by=req.order_by, entity=req.entity, group_by=req.fill_group_by, grain=req.grain
    )
    if req.group_by:
        out = r.repair_conflicts(out, req.column, req.group_by, req.conflict_strategy, basis=df)
    return out


def repair_audit(
    df: DataFrame, req: RepairRequest, plan_id: str, repair_type: str = "repair_apply", with_time: bool = True
) -> DataFrame:
    """Audit rows of a repair from one pass: the old value rides along, nothing is joined."""
    if not req.row_id:
        raise ValueError("row_id_missing")
    tracked = repaired(df.withColumn("_before", c(req.column)), req)
    changed = tracked.filter(~c("_before").eqNullSafe(c(req.column)))
    out = changed.select(
        F.lit(plan_id).alias("plan_id"),
        F.lit(req.column).alias("column_name"),
        F.lit(repair_type).alias("repair_type"),
        c(req.row_id).cast("string").alias("row_id"),
        c("_before").cast("string").alias("before"),
        c(req.column).cast("string").alias("after"),
    )
    return out.withColumn("created_at", F.current_timestamp()) if with_time else out


def approval_status(df: DataFrame, req: RepairRequest, plan: DataFrame, approvals: DataFrame) -> str:
    """``approved``, or the first reason to refuse the plan on the table as it is now.

    The snapshot is taken again. Approvals are rows (column_name, approved, approved_plan_id, approved_plan_hash,
    approved_signature); with several for the column, one that fits is enough.
    """
    head = plan.select("column_name", "plan_id", "plan_hash", "signature", "forbidden", "apply_ready", "table_ref").distinct()
    now = snapshot(df, req.column, req.group_by, req.time).select(c("signature").alias("current_signature"))
    checked = check_approvals(head.join(F.broadcast(now), F.lit(True)), approvals, ["column_name"])
    ready = F.when((c("status") == "approved") & ~c("apply_ready"), "not_apply_ready").otherwise(c("status"))
    best = checked.agg(F.min_by(ready, F.when(ready == "approved", 0).otherwise(1)).alias("status")).first()
    return best["status"] or "plan_missing"


def repaired_by_plan(df: DataFrame, req: RepairRequest, plan: DataFrame) -> DataFrame:
    """The full table after the steps of the plan: its strategies and its stored fill value, nothing read anew.

    ``_before`` and ``_between`` hold the column before the repair and between the two steps.
    """
    steps = {row["step"]: row for row in plan.filter(c("step").isNotNull()).collect()}  # at most two rows
    out = df.withColumn("_before", c(req.column))
    if step := steps.get("null_repair"):
        if step["strategy"] in ("forward_fill", "group_median_impute"):
            out = r.repair_nulls(
                out, req.column, step["strategy"], order_by=req.order_by, entity=req.entity, group_by=req.fill_group_by, grain=req.grain
            )
        else:
            out = r.fill(out, req.column, step["strategy"], df.sparkSession.range(1).select(F.lit(step["fill_value"]).alias("fill_value")))
    out = out.withColumn("_between", c(req.column))
    if step := steps.get("conflict_repair"):
        out = r.repair_conflicts(out, req.column, req.group_by, step["strategy"], basis=df)
    return out


def plan_audit(tracked: DataFrame, req: RepairRequest, plan: DataFrame) -> DataFrame:
    """One row per changed cell and step, with the plan's id, from the columns ``repaired_by_plan`` keeps."""
    if not req.row_id:
        raise ValueError("row_id_missing")
    stages = F.array(
        F.struct(F.lit("null_repair").alias("repair_type"), c("_before").cast("string").alias("before"), c("_between").cast("string").alias("after")),
        F.struct(F.lit("conflict_repair").alias("repair_type"), c("_between").cast("string").alias("before"), c(req.column).cast("string").alias("after")),
    )
    changed = F.filter(stages, lambda x: ~x["before"].eqNullSafe(x["after"]))
    plan_id = plan.select("plan_id").first()["plan_id"]
    rows = tracked.select(c(req.row_id).cast("string").alias("row_id"), F.explode(changed).alias("x"))
    return rows.select(
        F.lit(plan_id).alias("plan_id"), F.lit(req.column).alias("column_name"), "x.repair_type", "row_id", "x.before", "x.after",
        F.current_timestamp().alias("created_at"),
    )


def _apply(df: DataFrame, req: RepairRequest, plan: DataFrame, approvals: DataFrame, target: str, audit_path: str | None) -> str:
    """Check, write the audit, write the table; nothing is written for a refused plan.

    The audit comes first: a failure after it leaves rows of a plan whose table does not exist, never a repaired
    table without its audit.
    """
    status = approval_status(df, req, plan, approvals)
    if status != "approved":
        raise PermissionError(status)
    tracked = repaired_by_plan(df, req, plan)
    if not audit_path:
        return publish(tracked.drop("_before", "_between"), target)
    changes = changed_rows(tracked, req)
    plan_audit(changes, req, plan).write.mode("append").parquet(audit_path)
    return publish(with_changes(df, changes, req), target)


def changed_rows(tracked: DataFrame, req: RepairRequest, *also: str) -> DataFrame:
    """The rows that a repair changes, computed once and kept: audit and table are both made from them."""
    if not req.row_id:
        raise ValueError("row_id_missing")
    touched = ~c("_before").eqNullSafe(c("_between")) | ~c("_between").eqNullSafe(c(req.column))
    return cut(tracked.filter(touched).select(req.row_id, req.column, "_before", "_between", *also))


def with_changes(df: DataFrame, changes: DataFrame, req: RepairRequest) -> DataFrame:
    """The table with the changed values put in by row id, which an approved plan has found to be unique."""
    new = changes.select(c(req.row_id).alias("_changed_id"), c(req.column).alias("_changed"), F.lit(True).alias("_hit"))
    joined = df.join(broadcast_if_small(new), c(req.row_id) == c("_changed_id"), "left")
    value = F.when(F.coalesce("_hit", F.lit(False)), c("_changed")).otherwise(c(req.column))
    return joined.withColumn(req.column, value).select(*df.columns)


def apply_to_copy(df: DataFrame, req: RepairRequest, target: str, plan: DataFrame, approvals: DataFrame, audit_path: str | None = None) -> str:
    """Write the table repaired by an approved plan to a new place; the source is not touched."""
    return _apply(df, req, plan, approvals, target, audit_path)


def apply_to_source(spark: SparkSession, view: str, req: RepairRequest, root: str, plan: DataFrame, approvals: DataFrame, audit_path: str) -> str:
    """Write the next version of the source by an approved plan and point the view at it.

    The version being read stays in place, so a failed write changes nothing. The audit rows are stored under
    ``audit_path``. Returns the new path.
    """
    if not req.row_id:
        raise ValueError("row_id_missing")
    path = _apply(spark.table(view), req, plan, approvals, version_path(root), audit_path)
    spark.read.parquet(path).createOrReplaceTempView(view)
    return path


def apply_to_files(spark: SparkSession, root: str, req: RepairRequest, plan: DataFrame, approvals: DataFrame, audit_path: str) -> int:
    """Apply an approved plan to the newest version of a table of files (``sources.versions``); the new version's number.

    Only the files that hold changed rows are read again and rewritten; all others stay in place and belong to both
    versions. Going back is ``versions.restore``.
    """
    base = versions.newest(spark, root)
    df = versions.read(spark, root, base)
    status = approval_status(df, req, plan, approvals)
    if status != "approved":
        raise PermissionError(status)
    changes = changed_rows(repaired_by_plan(df.withColumn("_file", F.input_file_name()), req, plan), req, "_file")
    plan_audit(changes, req, plan).write.mode("append").parquet(audit_path)
    touched = [row["_file"] for row in changes.select("_file").distinct().collect()]  # at most one a file
    rows = with_changes(spark.read.schema(df.schema).parquet(*touched), changes, req) if touched else df.limit(0)
    return versions.replace_files(spark, root, base, touched, rows)
