"""Null and conflict repairs as full-table projections and joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabscry.functions.numeric import as_number, greatest_or_null
from tabscry.operators import running
from tabscry.operators.profiling import value_counts
from tabscry.operators.quantiles import percentiles
from tabscry.operators.scans import check_group_columns, conflict_row_count
from tabscry.session import broadcast_if_small

# Default null strategy by semantic type, and the accepted spellings.
NULL_STRATEGY = {
    "numeric": "median_impute",
    "temporal": "forward_fill",
    "categorical": "mode_impute",
    "text": "empty_string",
}
STRATEGY_NAMES = {
    "zero": "zero_impute",
    "empty": "empty_string",
    "mean": "mean_impute",
    "median": "median_impute",
    "mode": "mode_impute",
    "min": "min_impute",
    "max": "max_impute",
    "max_fill": "max_impute",
    "ffill": "forward_fill",
    "group_median": "group_median_impute",
}
CONFLICT_NAMES = {"mean": "mean_per_group", "median": "median_per_group", "mode": "mode_per_group"}
# Why a strategy fills what it fills.
NULL_REASON = {
    "median_impute": "Median of non-null values (robust to outliers).",
    "mean_impute": "Mean of non-null values.",
    "mode_impute": "Most frequent non-null value.",
    "min_impute": "Smallest non-null value.",
    "max_impute": "Largest non-null value.",
    "zero_impute": "Rule-based fill with zero.",
    "empty_string": "Rule-based fill with empty string.",
    "forward_fill": "Forward-fill using the last observed value in time order.",
    "group_median_impute": "Contextual imputation using similar rows grouped by ",
}

c = F.col


def strategy_name(name: str) -> str:
    key = name.lower()
    return STRATEGY_NAMES.get(key, key)


def null_strategy(rows: DataFrame) -> DataFrame:
    """Add the default null strategy to typed columns."""
    chosen = F.lit("manual_review")
    for semantic, strategy in NULL_STRATEGY.items():
        chosen = F.when(c("semantic_type") == semantic, strategy).otherwise(chosen)
    return rows.withColumn("null_strategy", chosen)


def fill_value(df: DataFrame, column: str, strategy: str) -> DataFrame:
    """One row with the value a strategy fills with; NULL when there is no basis."""
    strategy = strategy_name(strategy)
    if strategy == "zero_impute":
        return df.sparkSession.range(1).select(F.lit(0).alias("fill_value"))
    if strategy == "empty_string":
        return df.sparkSession.range(1).select(F.lit("").alias("fill_value"))
    if strategy == "mean_impute":
        return df.agg(F.avg(as_number(column)).alias("fill_value"))
    if strategy == "median_impute":
        middle = percentiles(df, [column], [0.5])
        return middle.agg(F.max(c("q")[0]).alias("fill_value"))
    if strategy == "mode_impute":
        best = F.min_by("category", F.struct(-c("n"), c("category")))
        return value_counts(df, column).agg(best.alias("fill_value"))
    if strategy in ("min_impute", "max_impute"):
        end = F.min if strategy == "min_impute" else F.max
        return df.agg(end(column).alias("fill_value"))
    raise ValueError(f"no single fill value for strategy {strategy}")


def as_kind(value: Column, kind: T.DataType) -> Column:
    """A repair value in the column's type: whole-number columns take the nearest number, halves away from zero."""
    if isinstance(kind, T.IntegralType):
        return F.round(value.cast("decimal(38,6)"), 0).cast(kind)
    return value.cast(kind)


def fill(df: DataFrame, column: str, strategy: str, value: DataFrame | None = None) -> DataFrame:
    """Replace nulls by the one value of the strategy (or a stored one), in the column's own type (see as_kind)."""
    kind = df.schema[column].dataType
    value = fill_value(df, column, strategy) if value is None else value
    return (
        df.join(F.broadcast(value), F.lit(True))
        .withColumn(column, F.coalesce(c(column), as_kind(c("fill_value"), kind)))
        .drop("fill_value")
    )


def fill_forward(
    df: DataFrame, column: str, order_by: Sequence[str], entity: Sequence[str] = (), grain: str = "day"
) -> DataFrame:
    """Last observed value in time order, per entity when given.

    ``order_by`` starts with the time column; ``grain`` is the slice one task
    works on, to be chosen finer when one entity holds most of the rows.
    """
    return running.forward_fill(df, column, entity, order_by, F.date_trunc(grain, c(order_by[0])))


def fill_group_median(
    df: DataFrame, column: str, group_by: Sequence[str], segments: Sequence[str] = ()
) -> DataFrame:
    """Median of the rows with the same group values (and segment count).

    Groups without a value, and rows with a null key, stay null.
    """
    keys = list(group_by)
    work = df
    if segments:
        work = df.withColumn("_segments", segment_count(segments))
        keys.append("_segments")
    kind = df.schema[column].dataType
    known = work
    for k in keys:
        known = known.filter(c(k).isNotNull())
    medians = percentiles(known, [column], [0.5], keys=keys).select(*keys, c("q")[0].alias("_median"))
    filled = work.join(broadcast_if_small(medians), keys, "left")
    return filled.withColumn(column, F.coalesce(c(column), as_kind(c("_median"), kind))).select(*df.columns)


def segment_count(columns: Sequence[str]) -> Column:
    """Largest number of double-bar separated segments; NULL if a column is NULL."""
    counts = [F.regexp_count(c(name).cast("string"), F.lit(r"\|\|")) + 1 for name in columns]
    return greatest_or_null(counts)


def conflict_targets(
    df: DataFrame, column: str, group_by: Sequence[str], strategy: str, only_conflicting: bool = True
) -> DataFrame:
    """Replacement value per group, for groups with more than one value."""
    keys = check_group_columns(df, group_by)
    strategy = CONFLICT_NAMES.get(strategy.lower(), strategy.lower())
    known = df.filter(c(column).isNotNull())
    for k in keys:
        known = known.filter(c(k).isNotNull())
    pairs = known.groupBy(*keys, column).agg(F.count(F.lit(1)).alias("n"))
    several = F.count(F.lit(1)).alias("values")
    if strategy == "mean_per_group":
        x = as_number(column)
        targets = pairs.groupBy(*keys).agg(several, (F.sum(x * c("n")) / F.sum(F.when(x.isNotNull(), c("n")))).alias("target"))
    elif strategy == "median_per_group":
        sizes = pairs.groupBy(*keys).agg(several)
        medians = percentiles(known, [column], [0.5], keys=keys).select(*keys, c("q")[0].alias("target"))
        targets = sizes.join(medians, keys)
    elif strategy == "mode_per_group":
        targets = pairs.groupBy(*keys).agg(several, F.min_by(column, F.struct(-c("n"), c(column))).alias("target"))
    else:
        raise ValueError(f"unknown conflict strategy {strategy}")
    if only_conflicting:
        targets = targets.filter(c("values") > 1)
    return targets.select(*keys, "target")


def repair_conflicts(
    df: DataFrame,
    column: str,
    group_by: Sequence[str],
    strategy: str,
    only_conflicting: bool = True,
    fill_nulls: bool = False,
    basis: DataFrame | None = None,
) -> DataFrame:
    """Give every conflicting group one value; nulls are left to the null repair.

    Groups and values come from ``basis``, the table itself unless given: a plan's conflicts are those before its fill.
    """
    kind = df.schema[column].dataType
    targets = conflict_targets(df if basis is None else basis, column, group_by, strategy, only_conflicting)
    hit = c("target").isNotNull() & (F.lit(fill_nulls) | c(column).isNotNull())
    return (
        df.join(targets, list(group_by), "left")
        .withColumn(column, F.when(hit, as_kind(c("target"), kind)).otherwise(c(column)))
        .select(*df.columns)
    )


def repair_nulls(
    df: DataFrame,
    column: str,
    strategy: str,
    order_by: Sequence[str] = (),
    entity: Sequence[str] = (),
    group_by: Sequence[str] = (),
    segments: Sequence[str] = (),
    grain: str = "day",
) -> DataFrame:
    """One entry point over all null strategies."""
    strategy = strategy_name(strategy)
    if strategy == "forward_fill":
        return fill_forward(df, column, order_by, entity, grain)
    if strategy == "group_median_impute":
        return fill_group_median(df, column, group_by, segments)
    return fill(df, column, strategy)


def repair_impact(
    df: DataFrame, column: str, group_by: Sequence[str] = ()
) -> DataFrame:
    """Rows each repair step would touch. Reads only; this is the dry run."""
    nulls = df.agg(F.count_if(c(column).isNull()).alias("affected_rows"))
    out = nulls.select(F.lit("null_repair").alias("step"), "affected_rows")
    if group_by:
        rows = conflict_row_count(df, column, group_by)
        out = out.unionByName(rows.select(F.lit("conflict_repair").alias("step"), c("conflict_rows").alias("affected_rows")))
    return out


def audit(
    old: DataFrame, new: DataFrame, row_id: str, column: str, plan_id: str, repair_type: str, with_time: bool = True
) -> DataFrame:
    """Before and after of every changed cell, matched on the row id."""
    a = old.select(c(row_id).cast("string").alias("row_id"), c(column).cast("string").alias("before"))
    b = new.select(c(row_id).cast("string").alias("row_id"), c(column).cast("string").alias("after"))
    changed = a.join(b, "row_id").filter(~c("before").eqNullSafe(c("after")))
    out = changed.select(
        F.lit(plan_id).alias("plan_id"),
        F.lit(column).alias("column_name"),
        F.lit(repair_type).alias("repair_type"),
        "row_id",
        "before",
        "after",
    )
    return out.withColumn("created_at", F.current_timestamp()) if with_time else out


def rollback(repaired: DataFrame, audit_rows: DataFrame, row_id: str, column: str) -> DataFrame:
    """Restore the value before the repair for every audited row.

    A row that several steps changed goes back to the value before the first: one undo per row id, whatever the audit holds.
    """
    kind = repaired.schema[column].dataType
    own = audit_rows.filter(c("column_name") == column)
    order = F.when(c("repair_type") == "conflict_repair", 2).otherwise(1)
    undo = own.groupBy(c("row_id").cast(repaired.schema[row_id].dataType).alias(row_id)).agg(
        F.min_by(F.struct("before"), order)["before"].alias("before"), F.lit(True).alias("_audited")
    )
    joined = repaired.join(broadcast_if_small(undo), row_id, "left")
    restored = F.when(F.coalesce("_audited", F.lit(False)), c("before").cast(kind)).otherwise(c(column))
    return joined.withColumn(column, restored).select(*repaired.columns)
