"""Quality scans over full tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabscry.functions.numeric import as_number, ratio, rounded
from tabscry.functions.temporal import parse_temporal, stamp
from tabscry.operators.profiling import summarize, value_counts

# Scan thresholds.
RARE_SHARE = 0.01
Z_LIMIT = 3.0
COUNT_GAP = 0.1

c = F.col


def scan_nulls(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Total, nulls and null rate of all columns in one pass."""
    metrics = {
        name: {"total_count": F.count(F.lit(1)), "null_count": F.count_if(c(name).isNull())}
        for name in (columns or df.columns)
    }
    return summarize(df, metrics).withColumn("null_rate", ratio(c("null_count"), c("total_count"), 6))


def check_group_columns(df: DataFrame, group_by: Sequence[str]) -> list[str]:
    """The group columns, refused with a reason when missing or unknown."""
    if not group_by:
        raise ValueError("group_columns_missing")
    unknown = [g for g in group_by if g not in df.columns]
    if unknown:
        raise ValueError(f"group_columns_unknown: {', '.join(unknown)}")
    return list(group_by)


def _grouped(df: DataFrame, column: str, group_by: Sequence[str]) -> DataFrame:
    """Distinct non-null values per group with no null key.

    Values are made distinct per (group, value) before the group is formed,
    so a group with most of the rows arrives as its distinct values' counts.
    """
    keep = c(column).isNotNull()
    for g in group_by:
        keep = keep & c(g).isNotNull()
    pairs = df.filter(keep).groupBy(*group_by, column).agg(F.count(F.lit(1)).alias("n"))
    return pairs.groupBy(*group_by).agg(F.count(F.lit(1)).alias("distinct_values"))


def conflict_groups(df: DataFrame, column: str, group_by: Sequence[str]) -> DataFrame:
    """Keys of the groups with more than one distinct value."""
    return _grouped(df, column, check_group_columns(df, group_by)).filter(c("distinct_values") > 1)


def scan_conflicts(df: DataFrame, column: str | Sequence[str], group_by: Sequence[str]) -> DataFrame:
    """Groups, conflicting groups, their share and the most values in one group, of one column or of many in one scan."""
    columns = [column] if isinstance(column, str) else list(column)
    keys = check_group_columns(df, group_by)
    present = F.lit(True)
    for g in keys:
        present = present & c(g).isNotNull()
    # Values of several types travel as digests, one per distinct value of a group; a hash skips nulls inside nested values.
    nested = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType))}
    hashed = {n: F.to_json(c(n), {"ignoreNullFields": "false"}) if n in nested else c(n) for n in columns}
    cells = F.array(*[F.struct(F.lit(n).alias("column_name"), F.xxhash64(v).alias("h1"), F.xxhash64(F.lit(1), v).alias("h2"), c(n).isNotNull().alias("known")) for n, v in hashed.items()])
    values = df.filter(present).select(*[c(g).alias(f"g{i}") for i, g in enumerate(keys)], F.inline(cells)).filter("known")
    grouped = [f"g{i}" for i in range(len(keys))]
    groups = (
        values.groupBy(*grouped, "column_name", "h1", "h2").agg(F.count(F.lit(1)).alias("n"))
        .groupBy(*grouped, "column_name").agg(F.count(F.lit(1)).alias("distinct_values"))
    )
    found = groups.groupBy("column_name").agg(
        F.count(F.lit(1)).alias("total_groups"),
        F.count_if(c("distinct_values") > 1).alias("conflict_groups"),
        F.max("distinct_values").alias("max_distinct"),
    )
    listed = df.sparkSession.range(1).select(F.explode(F.array(*[F.lit(n) for n in columns])).alias("column_name"))
    found = listed.join(F.broadcast(found), "column_name", "left").fillna(0, ["total_groups", "conflict_groups"])
    return found.select(
        "column_name",
        "total_groups",
        "conflict_groups",
        ratio(c("conflict_groups"), c("total_groups"), 6).alias("conflict_rate"),
        "max_distinct",
    )


def conflict_rows(df: DataFrame, column: str, group_by: Sequence[str]) -> DataFrame:
    """All rows of conflicting groups, null values included.

    An equi semi-join; a hot group is split by the adaptive skew join.
    """
    keys = conflict_groups(df, column, group_by).select(*group_by)
    return df.join(keys, list(group_by), "left_semi")


def conflict_row_count(df: DataFrame, column: str, group_by: Sequence[str]) -> DataFrame:
    """How many rows sit in conflicting groups, from group sizes instead of a row join."""
    keep = F.lit(True)
    for g in group_by:
        keep = keep & c(g).isNotNull()
    pairs = df.filter(keep).groupBy(*group_by, column).agg(F.count(F.lit(1)).alias("n"))
    groups = pairs.groupBy(*group_by).agg(F.sum("n").alias("n"), F.count(column).alias("distinct_values"))
    return groups.agg(F.coalesce(F.sum(F.when(c("distinct_values") > 1, c("n"))), F.lit(0)).alias("conflict_rows"))


def row_digests(df: DataFrame) -> tuple[Column, Column]:
    """Two 64-bit hashes of a whole row. Columns count in the order of their names; a null differs from every value."""
    nested = (T.ArrayType, T.StructType, T.MapType, T.VariantType)
    parts: list[Column] = []
    for f in sorted(df.schema.fields, key=lambda f: f.name):
        cell = c(f"`{f.name}`")
        parts += [cell.isNull(), F.to_json(F.struct(cell), {"ignoreNullFields": "false"}) if isinstance(f.dataType, nested) else cell]
    return F.xxhash64(*parts), F.xxhash64(F.lit(1), *parts)


def content_digest(df: DataFrame) -> Column:
    """An aggregate over all rows that any edit, insert or delete changes, whatever the order and the files of the rows.

    A multiset digest: sums of two 64-bit row hashes (repeats count, which an exclusive or alone would cancel) and their
    exclusive ors.
    """
    one, two = row_digests(df)
    total = lambda h: F.coalesce(F.sum(h.cast("decimal(28,0)")), F.lit(0)).cast("string")
    mixed = lambda h: F.coalesce(F.bit_xor(h), F.lit(0)).cast("string")
    return F.concat_ws(":", total(one), total(two), mixed(one), mixed(two))


def snapshot(
    df: DataFrame, column: str, group_by: Sequence[str] = (), time: str | None = None
) -> DataFrame:
    """The facts a plan is bound to, with a signature over these facts and the content of all rows."""
    none = F.max(F.lit(None).cast("string"))
    facts = df.agg(
        content_digest(df).alias("_content"),
        F.count(F.lit(1)).alias("total_count"),
        F.count_if(c(column).isNull()).alias("null_count"),
        (stamp(F.min(time)) if time else none).alias("min_time"),
        (stamp(F.max(time)) if time else none).alias("max_time"),
    )
    if group_by:
        rows = conflict_row_count(df, column, check_group_columns(df, group_by))
        facts = facts.join(F.broadcast(rows), F.lit(True))
    else:
        facts = facts.withColumn("conflict_rows", F.lit(None).cast("long"))
    facts = facts.withColumn("group_by", F.lit(",".join(group_by))).withColumn("column_name", F.lit(column))
    signed = ["column_name", "group_by", "total_count", "null_count", "min_time", "max_time", "conflict_rows"]
    return facts.select(*signed, F.sha2(F.to_json(F.struct(*signed, "_content")), 256).alias("signature"))


def plan_consistency(full: DataFrame, sample: DataFrame) -> DataFrame:
    """Reasons why a sample scan and the full snapshot do not fit together."""
    f = full.select("column_name", c("total_count").alias("full_total"), c("null_count").alias("full_nulls"), c("signature").alias("full_sig"))
    s = sample.select("column_name", c("total_count").alias("sample_total"), c("null_count").alias("sample_nulls"), c("signature").alias("sample_sig"))
    gap = F.abs(c("full_total") - c("sample_total")) / F.greatest("full_total", "sample_total")
    reasons = F.array_compact(
        F.array(
            F.when((F.coalesce("full_total", F.lit(0)) == 0) & (c("sample_total") > 0), "full_snapshot_missing"),
            F.when(c("sample_sig").isNotNull() & ~c("sample_sig").eqNullSafe(c("full_sig")), "snapshot_mismatch_nulls"),
            F.when((c("full_nulls") == 0) & (c("sample_nulls") > 0), "full_null_zero_sample_nonzero"),
            F.when((c("full_total") > 0) & (c("sample_total") > 0), F.when(gap > COUNT_GAP, "total_count_mismatch")),
        )
    )
    return f.join(s, "column_name", "left").select(
        "column_name", "full_total", "sample_total", F.array_join(reasons, "|").alias("reasons"), (F.size(reasons) > 0).alias("inconsistent")
    )


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key values held by more than one row."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(c("n") > 1)


def range_violations(df: DataFrame, bounds: dict[str, tuple[float | None, float | None]]) -> DataFrame:
    """Rows below or above the allowed range of each column."""
    metrics = {}
    for name, (low, high) in bounds.items():
        x, no = as_number(name), F.lit(False)
        metrics[name] = {
            "below": F.count_if(x < low if low is not None else no),
            "above": F.count_if(x > high if high is not None else no),
            "worst_low": F.min(x),
            "worst_high": F.max(x),
        }
    return summarize(df, metrics)


def type_mismatch(df: DataFrame, numbers: Sequence[str] = (), times: Sequence[str] = ()) -> DataFrame:
    """Text cells that read as numbers, and cells that read as no time."""
    metrics = {}
    for name in numbers:
        text = c(name).cast("string")
        metrics[name] = {
            "expected": F.max(F.lit("number")),
            "non_null_count": F.count(name),
            "invalid_count": F.count_if(c(name).isNotNull() & text.try_cast("double").isNull()),
        }
    for name in times:
        metrics[name] = {
            "expected": F.max(F.lit("time")),
            "non_null_count": F.count(name),
            "invalid_count": F.count_if(c(name).isNotNull() & parse_temporal(c(name)).isNull()),
        }
    return summarize(df, metrics).withColumn("invalid_rate", ratio(c("invalid_count"), c("non_null_count"), 6))


def rare_categories(df: DataFrame, column: str, below: float = RARE_SHARE) -> DataFrame:
    counts = value_counts(df, column)
    total = counts.agg(F.sum("n").alias("total"))
    return (
        counts.join(F.broadcast(total), F.lit(True))
        .select("category", "n", ratio(c("n"), c("total")).alias("share"))
        .filter(c("share") < below)
        .withColumn("share", rounded(c("share")))
    )


def merge_key(col: Column) -> Column:
    """Trimmed, lower-cased, inner blanks and ASCII punctuation folded; NULL when nothing else is left."""
    return F.nullif(F.trim(F.regexp_replace(F.lower(col), r"[^0-9a-z\x{80}-\x{10ffff}]+", " ")), F.lit(""))


def merge_suggestions(df: DataFrame, column: str) -> DataFrame:
    """Spellings that fall together after normalising, with the most frequent one.

    Works on the distinct spellings, not on rows.
    """
    spelled = value_counts(df, column).withColumn("merge_key", merge_key(c("category"))).filter(c("merge_key").isNotNull())
    sized = spelled.groupBy("merge_key").agg(
        F.count(F.lit(1)).alias("variants"),
        F.min_by("category", F.struct(-c("n"), c("category"))).alias("suggested"),
        F.sum("n").alias("rows"),
    )
    return sized.filter(c("variants") > 1)


def zscore_outliers(df: DataFrame, columns: Sequence[str], limit: float = Z_LIMIT) -> DataFrame:
    """Rows further than ``limit`` sample deviations from the mean."""
    facts = df.agg(
        *[F.avg(as_number(n)).alias(f"mean_{n}") for n in columns],
        *[F.stddev_samp(as_number(n)).alias(f"sd_{n}") for n in columns],
    )
    metrics = {
        n: {
            "mean_value": F.max(c(f"mean_{n}")),
            "stddev_value": F.max(c(f"sd_{n}")),
            "outlier_count": F.count_if(F.abs(as_number(n) - c(f"mean_{n}")) > c(f"sd_{n}") * limit),
        }
        for n in columns
    }
    return summarize(df.select(*columns).join(F.broadcast(facts), F.lit(True)), metrics).select(
        "column_name", rounded(c("mean_value"), 4).alias("mean_value"), rounded(c("stddev_value"), 4).alias("stddev_value"), "outlier_count"
    )
