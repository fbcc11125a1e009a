"""Profiles that are stored per part of a table and merged instead of read again.

A stored profile has one row per part and column: rows, nulls, range and two
sketches of fixed size, one of the distinct values and one of the quantiles.
Two snapshots are compared from these rows alone. Whole numbers keep their
range as exact decimals beside the doubles.

Distinct counts are exact up to about ``2 ** lg`` values a column; beyond,
their relative standard error is about ``1 / sqrt(2 ** lg)``. A quantile's rank
is off by about 1 %. An empty table has no parts and merges to no rows; a
column of nulls has zero distinct values and no range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabscry.functions.numeric import as_number, rounded
from tabscry.session import broadcast_if_small, spread

LG_ENTRIES = 14

c = F.col

PROFILE_FIELDS = (
    "total_rows long, null_count long, min_value double, max_value double, min_whole decimal(20,0), max_whole decimal(20,0), "
    "distinct_sketch binary, quantile_sketch binary"
)


def stored_schema(part: str, part_type: T.DataType) -> T.StructType:
    """Schema of a stored profile; the part column comes last, as in its folders."""
    facts = T.StructType.fromDDL(f"column_name string, {PROFILE_FIELDS}")
    return T.StructType([*facts.fields, T.StructField(part, part_type)])


def column_sketches(df: DataFrame, part: str, columns: Sequence[str], lg: int = LG_ENTRIES) -> DataFrame:
    """One row per part and column, from one aggregation without Expand."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    flat = [F.count(F.lit(1)).alias("_rows")]
    entries = []
    for i, name in enumerate(columns):
        numeric, whole = isinstance(kinds[name], T.NumericType), isinstance(kinds[name], T.IntegralType)
        number = as_number(name)
        hashed = c(name) if isinstance(kinds[name], (T.StringType, T.BinaryType, T.IntegralType)) else c(name).cast("string")
        facts = {
            "null_count": F.count_if(c(name).isNull()),
            "min_value": F.min(number) if numeric else F.max(F.lit(None).cast("double")),
            "max_value": F.max(number) if numeric else F.max(F.lit(None).cast("double")),
            "min_whole": (F.min(name) if whole else F.max(F.lit(None))).cast("decimal(20,0)"),
            "max_whole": (F.max(name) if whole else F.max(F.lit(None))).cast("decimal(20,0)"),
            "distinct_sketch": F.theta_sketch_agg(hashed, lg),
            "quantile_sketch": F.kll_sketch_agg_double(number) if numeric else F.max(F.lit(None).cast("binary")),
        }
        flat += [expr.alias(f"f{i}_{fact}") for fact, expr in facts.items()]
        entries.append(F.struct(F.lit(name).alias("column_name"), c("_rows").alias("total_rows"), *[c(f"f{i}_{fact}").alias(fact) for fact in facts]))
    base = spread(df.select(c(part).alias("_part"), *[c(n) for n in dict.fromkeys(columns)]))
    parts = base.groupBy("_part").agg(*flat)
    return parts.select(F.inline(F.array(*entries)), c("_part").alias(part))


def store_sketches(df: DataFrame, part: str, columns: Sequence[str], path: str, lg: int = LG_ENTRIES) -> str:
    """Write the profiles of the parts in ``df``; other parts stored there stay as they are."""
    rows = column_sketches(df, part, columns, lg)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(part).parquet(path)
    return path


def stored_sketches(spark: SparkSession, path: str, part: str, part_type: T.DataType) -> DataFrame:
    return spark.read.schema(stored_schema(part, part_type)).parquet(path)


def merged(profiles: DataFrame, lg: int = LG_ENTRIES) -> DataFrame:
    """One row per column over all its parts."""
    return profiles.groupBy("column_name").agg(
        F.sum("total_rows").alias("total_rows"),
        F.sum("null_count").alias("null_count"),
        *[f(x).alias(x) for x in ("value", "whole") for f, x in ((F.min, f"min_{x}"), (F.max, f"max_{x}"))],
        F.theta_union_agg("distinct_sketch", lg).alias("distinct_sketch"),
        F.kll_merge_agg_double("quantile_sketch").alias("quantile_sketch"),
    )


def quantile(at: float, sketch: str = "quantile_sketch") -> Column:
    """The value at a rank share; null for a column without numbers."""
    held = F.kll_sketch_get_n_double(c(sketch)) > 0
    return F.when(held, F.kll_sketch_get_quantile_double(c(sketch), F.lit(at)))


def sketch_profile(profiles: DataFrame, lg: int = LG_ENTRIES) -> DataFrame:
    """Rows, nulls, distinct values, range and quartiles per column, from stored rows."""
    return merged(profiles, lg).select(
        "column_name",
        "total_rows",
        "null_count",
        F.theta_sketch_estimate("distinct_sketch").alias("distinct_count"),
        "min_value",
        "max_value",
        "min_whole",
        "max_whole",
        *[quantile(q).alias(name) for name, q in (("p25", 0.25), ("p50", 0.5), ("p75", 0.75))],
    )


def sketch_drift(before: DataFrame, after: DataFrame, lg: int = LG_ENTRIES) -> DataFrame:
    """What changed between two snapshots, and how many values both hold.

    The inputs are stored rows of the parts of each snapshot. A column in one
    snapshot only stays, with null changes.
    """
    a, b = (merged(x, lg).select("column_name", F.struct("*").alias(side)) for x, side in ((before, "a"), (after, "b")))
    both = a.join(broadcast_if_small(b), "column_name", "full")
    shared = F.theta_sketch_estimate(F.theta_intersection(c("a.distinct_sketch"), c("b.distinct_sketch")))
    unique = F.theta_sketch_estimate(c("b.distinct_sketch")) - F.theta_sketch_estimate(c("a.distinct_sketch"))
    return both.select(
        "column_name",
        (c("b.total_rows") - c("a.total_rows")).alias("total_rows_delta"),
        (c("b.null_count") - c("a.null_count")).alias("null_count_delta"),
        unique.alias("unique_count_delta"),
        shared.alias("shared_count"),
        *[rounded(c(f"b.{m}_value") - c(f"a.{m}_value"), 4).alias(f"{m}_value_delta") for m in ("min", "max")],
    )
