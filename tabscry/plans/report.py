"""Issue report and column facts over the scans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabscry.functions.numeric import ratio
from tabscry.operators import profiling as p
from tabscry.operators import scans as s

# Share of affected rows from which an issue is medium or high.
MEDIUM_SHARE, HIGH_SHARE = 0.05, 0.3
MAX_FACTS = 4

c = F.col


def severity(share: Column) -> Column:
    return F.when(share > HIGH_SHARE, "high").when(share > MEDIUM_SHARE, "medium").otherwise("low")


def quality_report(
    df: DataFrame,
    null_columns: Sequence[str] | None = None,
    conflicts: Sequence[tuple[str, Sequence[str]]] = (),
    keys: Sequence[Sequence[str]] = (),
    outliers: Sequence[str] = (),
    bounds: dict[str, tuple[float | None, float | None]] | None = None,
    categories: Sequence[str] = (),
    numbers_as_text: Sequence[str] = (),
) -> DataFrame:
    """Issues found, with the affected column, rows and a severity by share of rows."""
    found = [
        s.scan_nulls(df, null_columns).select(F.lit("null_values").alias("issue"), "column_name", c("null_count").alias("affected_rows"))
    ]
    for column, group_by in conflicts:
        rows = s.conflict_row_count(df, column, group_by)
        found.append(rows.select(F.lit("conflicting_values").alias("issue"), F.lit(column).alias("column_name"), c("conflict_rows").alias("affected_rows")))
    for key in keys:
        rows = s.duplicate_keys(df, key).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("affected_rows"))
        found.append(rows.select(F.lit("duplicate_keys").alias("issue"), F.lit(",".join(key)).alias("column_name"), "affected_rows"))
    if outliers:
        rows = p.iqr_outliers(df, outliers)
        found.append(rows.select(F.lit("outliers").alias("issue"), "column_name", c("outlier_count").alias("affected_rows")))
    if bounds:
        rows = s.range_violations(df, bounds)
        found.append(rows.select(F.lit("out_of_range").alias("issue"), "column_name", (c("below") + c("above")).alias("affected_rows")))
    for column in categories:
        rows = s.rare_categories(df, column).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("affected_rows"))
        found.append(rows.select(F.lit("rare_categories").alias("issue"), F.lit(column).alias("column_name"), "affected_rows"))
    if numbers_as_text:
        rows = s.type_mismatch(df, numbers=numbers_as_text)
        found.append(rows.select(F.lit("type_mismatch").alias("issue"), "column_name", c("invalid_count").alias("affected_rows")))
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    total = df.agg(F.count(F.lit(1)).alias("total_rows"))
    share = ratio(c("affected_rows"), c("total_rows"), 6)
    return (
        out.filter(c("affected_rows") > 0)
        .join(F.broadcast(total), F.lit(True))
        .select("issue", "column_name", "affected_rows", share.alias("share"), severity(share).alias("severity"))
    )


def column_facts(df: DataFrame, columns: Sequence[str], group_by: Sequence[str] = (), max_facts: int = MAX_FACTS) -> DataFrame:
    """Up to ``max_facts`` short facts per column, the most severe first, no fact twice.

    Facts come from the full-table statistics, null and conflict scans.
    """
    shaped = p.distribution_shape(p.distribution(df, columns))
    parts = []
    parts.append(
        shaped.filter(c("null_count") > 0).select(
            "column_name", F.lit(1).alias("weight"), F.format_string("%d of %d values are missing", c("null_count"), c("total_count")).alias("fact")
        )
    )
    if group_by and not set(columns) <= set(group_by):
        conflicts = s.scan_conflicts(df, [n for n in columns if n not in group_by], group_by).filter(c("conflict_groups") > 0)
        parts.append(
            conflicts.select(
                "column_name", F.lit(2).alias("weight"),
                F.format_string("%d of %d groups hold more than one value", c("conflict_groups"), c("total_groups")).alias("fact"),
            )
        )
    parts.append(
        shaped.select("column_name", F.lit(3).alias("weight"), F.concat(F.lit("shape is "), F.replace("shape", F.lit("_"), F.lit(" "))).alias("fact"))
    )
    parts.append(
        shaped.select(
            "column_name", F.lit(4).alias("weight"),
            F.concat(F.lit("values run from "), F.round("min_value", 2).cast("string"), F.lit(" to "), F.round("max_value", 2).cast("string")).alias("fact"),
        )
    )
    parts.append(
        shaped.select(
            "column_name", F.lit(5).alias("weight"),
            F.concat(F.lit("median is "), F.round("p50", 2).cast("string")).alias("fact"),
        )
    )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    by_weight = Window.partitionBy("column_name").orderBy("weight", "fact")
    unique = out.filter(F.trim("fact") != "").dropDuplicates(["column_name", "fact"])
    return (
        unique.withColumn("fact_no", F.row_number().over(by_weight))
        .filter(c("fact_no") <= max_facts)
        .select("column_name", "fact_no", "fact")
    )
