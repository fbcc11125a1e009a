"""Chart-ready series. Every series is long: one row per point."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabscry.functions.numeric import as_number, ratio, rounded
from tabscry.functions.temporal import bucket, stamp
from tabscry.operators.profiling import value_counts
from tabscry.operators.sampling import random_rows

# Chart limits and thresholds.
BIN_BOUNDS = (20, 60)
MIN_BINS = 5
MIN_LINE_POINTS = 3
CATEGORY_LIMIT = 12
FULL_CATEGORY_LIMIT = 50
PIE_LIMIT = 8
LOG_SCALE_RATIO = 1000
DOMAIN_PADDING = 0.12
FLAT_DOMAIN_PADDING = 0.05
EDGE_BASE, EDGE_STEP = 0.4, 0.2

c = F.col


def histogram(df: DataFrame, column: str, bins: int | None = None) -> DataFrame:
    """Counts per equal-width bin; only the maximum falls in bin n + 1.

    Without ``bins`` the number is the square root of the row count, kept
    within 20 and 60. A constant column has no histogram.
    """
    x = as_number(column)
    present = df.select(x.alias("x")).filter(c("x").isNotNull())
    ends = present.agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count(F.lit(1)).alias("total"))
    if bins is None:
        n = F.greatest(F.lit(BIN_BOUNDS[0]), F.least(F.lit(BIN_BOUNDS[1]), F.floor(F.sqrt("total"))))
    else:
        n = F.lit(max(MIN_BINS, bins))
    ends = ends.filter(c("lo") < c("hi")).select("lo", "hi", n.cast("long").alias("bins"))
    return (
        present.join(F.broadcast(ends), F.lit(True))
        .groupBy(F.width_bucket("x", "lo", "hi", "bins").alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _point(value: str | None, how: str) -> Column:
    if value is None:
        return F.count(F.lit(1)).cast("double")
    return {"avg": F.avg, "sum": F.sum}[how](as_number(value))


def time_series(
    df: DataFrame, time: str, value: str | None = None, grain: str = "day", how: str = "avg", limit: int | None = None
) -> DataFrame:
    """Count, mean or sum per time bucket in time order."""
    keep = c(time).isNotNull()
    if value is not None:
        keep = keep & as_number(value).isNotNull()
    points = (
        df.filter(keep)
        .groupBy(bucket(grain, c(time)).alias("bucket"))
        .agg(_point(value, how).alias("y"), F.count(F.lit(1)).alias("n"))
    )
    points = points.orderBy("bucket")
    return points if limit is None else points.limit(limit)


def _same_series(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Equi-join in which a null key is a series like any other."""
    named = right.select(*[c(k).alias(f"_on_{k}") for k in keys], *[x for x in right.columns if x not in keys])
    same = F.lit(True)
    for k in keys:
        same = same & c(k).eqNullSafe(c(f"_on_{k}"))
    out = left.join(named, same, how)
    return out.drop(*[f"_on_{k}" for k in keys])


def time_series_adaptive(
    df: DataFrame,
    time: str,
    value: str | None = None,
    grain: str = "day",
    min_points: int = MIN_LINE_POINTS,
    series: Sequence[str] = (),
) -> DataFrame:
    """Time series at the first grain that gives more than one point.

    The wanted grain is tried first, then hour, then the raw times. A grain
    gives more than one point exactly when the first and last time fall in
    different buckets, so one small aggregate picks the grain and the rows are
    bucketed once. Series with too few points are dropped.
    """
    grains = [grain] + [g for g in ("hour", "raw") if g != grain and grain != "raw"]
    keep = c(time).isNotNull()
    if value is not None:
        keep = keep & as_number(value).isNotNull()
    rows = df.filter(keep).select(*series, time, *([value] if value else []))
    ends = rows.groupBy(*series).agg(F.min(time).alias("_first"), F.max(time).alias("_last"))
    chosen = F.lit(grain)
    for g in reversed(grains):
        chosen = F.when(bucket(g, c("_first")) != bucket(g, c("_last")), g).otherwise(chosen)
    picked = ends.select(*series, chosen.alias("grain"))
    joined = _same_series(rows, picked, series, "inner") if series else rows.join(F.broadcast(picked), F.lit(True))
    start = c(time).cast("timestamp")
    for g in grains:
        if g != "raw":
            start = F.when(c("grain") == g, bucket(g, c(time)).cast("timestamp")).otherwise(start)
    points = joined.groupBy(*series, "grain", start.alias("bucket")).agg(_point(value, "avg").alias("y"))
    enough = points.groupBy(*series, "grain").agg(F.count(F.lit(1)).alias("_points")).filter(c("_points") >= min_points)
    return _same_series(points, enough.select(*series, "grain"), [*series, "grain"], "left_semi").select(*series, "grain", "bucket", "y")


def time_series_multi(df: DataFrame, times: Sequence[str], value: str, grain: str = "month") -> DataFrame:
    """Mean of a value along each of several time columns (every one that is named)."""
    axes = F.explode(
        F.array(*[F.struct(F.lit(t).alias("time_column"), bucket(grain, c(t)).cast("timestamp").alias("bucket")) for t in times])
    )
    return (
        df.filter(as_number(value).isNotNull())
        .select(axes.alias("a"), as_number(value).alias("v"))
        .select("a.time_column", "a.bucket", "v")
        .filter(c("bucket").isNotNull())
        .groupBy("time_column", "bucket")
        .agg(F.avg("v").alias("y"), F.count(F.lit(1)).alias("n"))
    )


def category_mean(df: DataFrame, category: str, value: str, limit: int = CATEGORY_LIMIT) -> DataFrame:
    """Mean and count per category; all of them up to 50 categories, else the top ones."""
    x = as_number(value)
    groups = (
        df.filter(c(category).isNotNull() & x.isNotNull())
        .groupBy(c(category).alias("category"))
        .agg(F.avg(x).alias("avg_value"), F.count(F.lit(1)).alias("n"))
    )
    # The few first rows by count are found without ranking every category in one task.
    top = groups.orderBy(F.desc("n"), F.asc("category")).limit(max(limit, FULL_CATEGORY_LIMIT + 1))
    total = groups.agg(F.count(F.lit(1)).alias("categories"))
    in_top = Window.orderBy(F.desc("n"), F.asc("category"))
    return (
        top.join(F.broadcast(total), F.lit(True))
        .withColumn("rank", F.row_number().over(in_top))
        .filter((c("categories") <= FULL_CATEGORY_LIMIT) | (c("rank") <= limit))
        .select("category", "avg_value", "n")
    )


def top_with_other(df: DataFrame, category: str, limit: int | None = None, pie: bool = False) -> DataFrame:
    """Top categories by count (blanks never count), the remainder as "Other".

    As a bar series "Other" appears when a limit was applied and leaves rows
    out. As a pie the list is cut to the limit and "Other" is what is left of
    the total.
    """
    counts = value_counts(df, category, skip_blank=True)
    if pie and limit is None:
        limit = PIE_LIMIT
    if limit is None:
        return counts
    totals = counts.agg(F.sum("n").alias("total"))
    head = counts.orderBy(F.desc("n"), F.asc("category")).limit(limit)
    rest = (
        head.agg(F.sum("n").alias("shown"))
        .join(F.broadcast(totals), F.lit(True))
        .filter(c("total") > c("shown"))
        .select(F.lit("Other").alias("category"), (c("total") - c("shown")).alias("n"))
    )
    return head.withColumn("category", c("category").cast("string")).unionByName(rest)


def share_series(df: DataFrame, category: str, limit: int = PIE_LIMIT) -> DataFrame:
    """Positive pie slices with their share of the total."""
    slices = top_with_other(df, category, limit, pie=True).filter(c("n") > 0)
    total = slices.agg(F.sum("n").alias("total"))
    return slices.join(F.broadcast(total), F.lit(True)).select("category", "n", ratio(c("n"), c("total"), 6).alias("share"))


def presence_series(df: DataFrame, column: str, time: str, grain: str = "day") -> DataFrame:
    """How many rows carry a value, per time bucket."""
    return time_series(df.filter(c(column).isNotNull()), time, None, grain)


def mean_over_top(df: DataFrame, category: str, value: str, limit: int) -> DataFrame:
    """Mean of a value over the most frequent categories.

    The categories are aggregated before the pick, so no second scan and no
    join with the rows is needed.
    """
    x = as_number(value)
    groups = (
        df.filter(c(category).isNotNull() & (F.trim(c(category).cast("string")) != ""))
        .groupBy(c(category).alias("category"))
        .agg(F.count(F.lit(1)).alias("n"), F.avg(x).alias("avg_value"))
    )
    return groups.orderBy(F.desc("n"), F.asc("category")).limit(limit).filter(c("avg_value").isNotNull())


def raw_value_top(df: DataFrame, column: str, limit: int = PIE_LIMIT) -> DataFrame:
    return value_counts(df, column).orderBy(F.desc("n"), F.asc("category")).limit(limit)


def scatter_sample(df: DataFrame, x: str, y: str, keys: Sequence[str], n: int = 1000) -> DataFrame:
    """Hash-ordered sample of the pairs with both values present."""
    pairs = df.filter(as_number(x).isNotNull() & as_number(y).isNotNull())
    return random_rows(pairs, keys, n).select(as_number(x).alias("x"), as_number(y).alias("y"))


def axis_scale(points: DataFrame) -> DataFrame:
    """Log axis for wide positive ranges, otherwise a padded linear domain, per series."""
    ends = points.filter(c("y").isNotNull()).groupBy("series").agg(F.min("y").alias("lo"), F.max("y").alias("hi"))
    span = c("hi") - c("lo")
    pad = F.when(span == 0, F.greatest(F.abs(c("hi")) * FLAT_DOMAIN_PADDING, F.lit(1.0))).otherwise(span * DOMAIN_PADDING)
    log = (c("lo") > 0) & (c("hi") >= c("lo") * LOG_SCALE_RATIO)
    return ends.select(
        "series",
        F.when(log, "log").otherwise("linear").alias("y_scale"),
        rounded(F.when(log, c("lo")).otherwise(c("lo") - pad), 4).alias("domain_from"),
        rounded(F.when(~log, c("hi") + pad), 4).alias("domain_to"),
    )


def series_keep(points: DataFrame) -> DataFrame:
    """Points, distinct x and y range of each (series, chart); short ones are not kept."""
    keep = ~(
        ((c("chart") == "line") & (c("point_count") < MIN_LINE_POINTS)) | ((c("chart") == "bar") & (c("point_count") <= 1))
    )
    return (
        points.groupBy("series", "chart")
        .agg(
            F.count(F.lit(1)).alias("point_count"),
            F.count_distinct("x").alias("x_unique"),
            F.min("y").alias("y_min"),
            F.max("y").alias("y_max"),
        )
        .select(
            "series", "chart", "point_count", "x_unique",
            rounded(c("y_min"), 4).alias("y_min"), rounded(c("y_max"), 4).alias("y_max"), keep.alias("keep"),
        )
    )


def cooccurrence_edges(df: DataFrame, holder: str, item: str) -> DataFrame:
    """Edges between the two items of every holder that has exactly two.

    Holders are folded to (smallest item, largest item, number of items), all
    combined map-side, so no pairs are formed within a holder.
    """
    held = df.filter(c(holder).isNotNull() & c(item).isNotNull()).groupBy(holder).agg(
        F.min(item).alias("source"), F.max(item).alias("target"), F.count_distinct(item).alias("items")
    )
    strength = F.least(F.lit(1.0), F.lit(EDGE_BASE) + c("n") * EDGE_STEP)
    return (
        held.filter(c("items") == 2)
        .groupBy("source", "target")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("strength", rounded(strength, 4))
    )


def as_points(df: DataFrame, series: str, chart: str, x: str | Column, y: str | Column) -> DataFrame:
    """Bring a series into the long form (series, chart, x, y)."""
    to_col = lambda v: c(v) if isinstance(v, str) else v
    return df.select(
        F.lit(series).alias("series"), F.lit(chart).alias("chart"),
        to_col(x).cast("string").alias("x"), to_col(y).cast("double").alias("y"),
    )


def stamped(points: DataFrame) -> DataFrame:
    return points.withColumn("bucket", stamp(c("bucket")))
