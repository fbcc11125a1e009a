"""Table and column statistics. One aggregation pass per table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabscry.functions.numeric import as_number, numbers, pearson, ratio, rounded
from tabscry.functions.temporal import bucket
from tabscry.operators.quantiles import percentiles
from tabscry.session import estimated_bytes, spread

# Thresholds of the statistics.
POSITIVE_CORRELATION = 0.3
WEAK_CORRELATION = 0.1
PERIODICITY_THRESHOLD = 0.4
SKEW_FACTOR = 1.5
IQR_FACTOR = 1.5
# Stored bytes of a table that one task counts distinct values of, and the pieces at most.
PIECE_BYTES = 1024 * 1024
MOST_PIECES = 10_000
PERIODICITY_LAGS = {
    "hour": (1, 6, 12, 24),
    "day": (1, 7, 30),
    "week": (1, 4, 12),
    "month": (1, 3, 6, 12),
}


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def type_family(data_type: T.DataType) -> str:
    """numeric, text, time, boolean or other."""
    if isinstance(data_type, T.NumericType):
        return "numeric"
    if isinstance(data_type, (T.StringType, T.VarcharType, T.CharType)):
        return "text"
    if isinstance(data_type, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "time"
    return "boolean" if isinstance(data_type, T.BooleanType) else "other"


def unpack(one_row: DataFrame, per_column: dict[str, dict[str, Column]], label: str = "column_name") -> DataFrame:
    """Turn a one-row aggregate into one row per column.

    ``per_column`` maps a column name to its output fields, given as
    expressions over the aggregate.
    """
    entries = [
        F.struct(F.lit(name).alias(label), *[expr.alias(field) for field, expr in fields.items()])
        for name, fields in per_column.items()
    ]
    return one_row.select(F.inline(F.array(*entries)))


def summarize(df: DataFrame, metrics: dict[str, dict[str, Column]]) -> DataFrame:
    """Evaluate per-column aggregates in one pass and unpack them to rows."""
    flat = [expr.alias(f"{c}__{m}") for c, ms in metrics.items() for m, expr in ms.items()]
    refs = {c: {m: F.col(f"`{c}__{m}`") for m in ms} for c, ms in metrics.items()}
    return unpack(df.agg(*flat), refs)


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("row_count"))


def table_profile(df: DataFrame) -> DataFrame:
    """Rows, distinct whole rows (rows with nulls included) and column count.

    Equal rows are combined before the shuffle, so a row repeated many times
    does not pile up in one task.
    """
    return (
        df.groupBy(*df.columns)
        .agg(F.count(F.lit(1)).alias("copies"))
        .agg(
            F.coalesce(F.sum("copies"), F.lit(0)).alias("row_count"),
            F.count(F.lit(1)).alias("unique_rows"),
        )
        .withColumn("column_count", F.lit(len(df.columns)).cast("long"))
    )


def distinct_of(column: str, approx: bool = False) -> Column:
    """Distinct non-null values; the sketch has a fixed size per column."""
    return F.approx_count_distinct(column) if approx else F.count_distinct(F.col(column))


def _pieces(df: DataFrame) -> DataFrame:
    """Rows in pieces of about PIECE_BYTES: a file may be one row group, and the values of one task are held in memory."""
    size = estimated_bytes(df)
    if size is None or size <= PIECE_BYTES:
        return df
    return df.repartition(min(MOST_PIECES, max(df.sparkSession.sparkContext.defaultParallelism, -(-size // PIECE_BYTES))))


def distinct_counts(df: DataFrame, columns: Sequence[str], name: str = "distinct_count") -> DataFrame:
    """Exact distinct non-null values of each column with any.

    Values are counted as column number and 128-bit digest, so a row that is counted is narrow whatever the table's
    other statistics, and a task sees one piece of the table at a time.
    """
    cells = []
    for i, column in enumerate(columns):
        nested = isinstance(df.schema[column].dataType, (T.ArrayType, T.StructType, T.MapType))
        raw = F.col(f"`{column}`")
        value = F.to_json(F.struct(raw), {"ignoreNullFields": "false"}) if nested else raw
        cells.append(F.struct(F.lit(i).alias("ordinal"), raw.isNotNull().alias("known"), F.xxhash64(value).alias("h1"), F.xxhash64(F.lit(1), value).alias("h2")))
    rows = _pieces(df.select(*[F.col(f"`{column}`") for column in columns]))
    seen = rows.select(F.inline(F.array(*cells))).filter("known").select("ordinal", "h1", "h2").distinct()
    counts = seen.groupBy("ordinal").agg(F.count(F.lit(1)).alias(name))
    label = F.element_at(F.array(*[F.lit(column) for column in columns]), F.col("ordinal") + 1)
    return counts.select(label.alias("column_name"), name)


def _with_distinct(df: DataFrame, metrics: dict[str, dict[str, Column]], name: str, approx: bool) -> DataFrame:
    """Per-column aggregates beside the distinct count ``name``; sketches fit the same pass, exact counts take their own."""
    if approx:
        return summarize(df, {c: {**of, name: distinct_of(c, True)} for c, of in metrics.items()})
    both = summarize(df, metrics).join(F.broadcast(distinct_counts(df, list(metrics), name)), "column_name", "left")
    return both.withColumn(name, F.coalesce(name, F.lit(0).cast("long")))


def column_profile(df: DataFrame, columns: Sequence[str] | None = None, approx: bool = False) -> DataFrame:
    """total, non-null, distinct, null rate and cardinality of each column."""
    metrics = {
        c: {
            "total_count": F.count(F.lit(1)),
            "non_null_count": F.count(c),
            "distinct_count": distinct_of(c, approx),
        }
        for c in (columns or df.columns)
    }
    df = spread(df.select(*metrics))
    total, present, distinct = F.col("total_count"), F.col("non_null_count"), F.col("distinct_count")
    return summarize(df, metrics).select(
        "column_name",
        total,
        present,
        distinct,
        ratio(total - present, total, 6).alias("null_rate"),
        ratio(distinct, total, 6).alias("cardinality"),
    )


def _with_percentiles(df: DataFrame, columns: Sequence[str], metrics: dict, probs: Sequence[float]) -> DataFrame:
    """Per-column aggregates plus exact percentiles ``q``.

    The plain aggregates keep to generated hash aggregation; percentile
    buffers would take them off it, so they are computed beside it.
    """
    return summarize(df, metrics).join(F.broadcast(percentiles(df, columns, probs)), "column_name", "left")


def numeric_stats(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """min, max, mean, median and sample standard deviation."""
    columns = list(columns or numeric_columns(df))
    metrics = {
        c: {
            "min_value": F.min(c),
            "max_value": F.max(c),
            "mean_value": F.avg(c),
            "stddev_value": F.stddev_samp(c),
        }
        for c in columns
    }
    return _with_percentiles(numbers(df, columns), columns, metrics, [0.5]).select(
        "column_name",
        rounded(F.col("min_value"), 4).alias("min_value"),
        rounded(F.col("max_value"), 4).alias("max_value"),
        rounded(F.col("mean_value"), 4).alias("mean_value"),
        rounded(F.col("q")[0], 4).alias("median_value"),
        rounded(F.col("stddev_value"), 4).alias("stddev_value"),
    )


def wide_profile(df: DataFrame, approx: bool = False) -> DataFrame:
    """Distinct and null counts of all columns, range and mean of the numeric ones."""
    numerics = set(numeric_columns(df))
    nothing = F.lit(None).cast("double")
    metrics = {
        c: {
            "null_count": F.count_if(F.col(c).isNull()),
            "min_value": F.min(as_number(c)) if c in numerics else F.max(nothing),
            "max_value": F.max(as_number(c)) if c in numerics else F.max(nothing),
            "mean_value": F.avg(as_number(c)) if c in numerics else F.max(nothing),
        }
        for c in df.columns
    }
    profile = _with_distinct(df, metrics, "distinct_count", approx)
    medians = percentiles(df, sorted(numerics), [0.5]).select("column_name", F.col("q")[0].alias("median_value"))
    return profile.join(F.broadcast(medians), "column_name", "left").select(
        "column_name",
        "distinct_count",
        "null_count",
        *[rounded(F.col(c), 4).alias(c) for c in ("min_value", "max_value", "mean_value", "median_value")],
    )


def basic_stats(df: DataFrame, column: str) -> DataFrame:
    return summarize(
        df,
        {
            column: {
                "total_count": F.count(F.lit(1)),
                "distinct_count": distinct_of(column),
                "null_count": F.count_if(F.col(column).isNull()),
            }
        },
    )


def distribution(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """count, nulls, range, mean, spread and the 10/50/90 percentiles."""
    columns = list(columns or numeric_columns(df))
    metrics = {
        c: {
            "total_count": F.count(F.lit(1)),
            "null_count": F.count_if(F.col(c).isNull()),
            "min_value": F.min(c),
            "max_value": F.max(c),
            "mean_value": F.avg(c),
            "stddev_value": F.stddev_samp(c),
        }
        for c in columns
    }
    q = F.col("q")
    return _with_percentiles(numbers(df, columns), columns, metrics, [0.1, 0.5, 0.9]).select(
        "column_name",
        "total_count",
        "null_count",
        *[rounded(F.col(m), 4).alias(m) for m in ("min_value", "max_value", "mean_value", "stddev_value")],
        *[rounded(q[i], 4).alias(name) for i, name in enumerate(("p10", "p50", "p90"))],
    )


def distribution_shape(stats: DataFrame) -> DataFrame:
    """Name the shape from the distance of the tails to the median."""
    lower, upper = F.col("p50") - F.col("p10"), F.col("p90") - F.col("p50")
    shape = (
        F.when(lower.isNull() | upper.isNull(), F.lit(None).cast("string"))
        .when(lower > upper * SKEW_FACTOR, "left_skewed")
        .when(upper > lower * SKEW_FACTOR, "right_skewed")
        .otherwise("roughly_symmetric")
    )
    return stats.withColumn("shape", shape)


def correlation_group(value: Column) -> Column:
    return (
        F.when(value.isNull(), "unknown")
        .when(value >= POSITIVE_CORRELATION, "positive")
        .when(value <= -POSITIVE_CORRELATION, "negative")
        .when(F.abs(value) <= WEAK_CORRELATION, "weak")
        .otherwise("mixed")
    )


def correlations(df: DataFrame, target: str, others: Sequence[str] | None = None) -> DataFrame:
    """Correlation of one column with many, all pairs in one aggregation."""
    others = list(others or [c for c in numeric_columns(df) if c != target])
    x = F.col(target)
    base = numbers(df, [target, *others]).filter(x.isNotNull())
    metrics = {c: {"correlation": pearson(x, F.col(c)), "sample_count": F.count(F.lit(1))} for c in others}
    return (
        summarize(base, metrics)
        .select("column_name", rounded(F.col("correlation")).alias("correlation"), "sample_count")
        .withColumn("correlation_group", correlation_group(F.col("correlation")))
        .orderBy(F.abs("correlation").desc_nulls_last(), "column_name")
    )


def correlation_agreement(first: DataFrame, second: DataFrame) -> DataFrame:
    """Share of columns put in the same group by two correlation results."""
    a = first.select("column_name", F.col("correlation").alias("a"))
    b = second.select("column_name", F.col("correlation").alias("b"))
    shared = a.filter("a IS NOT NULL").join(b.filter("b IS NOT NULL"), "column_name")
    same = (correlation_group(F.col("a")) == correlation_group(F.col("b"))).cast("double")
    return shared.agg(
        F.count(F.lit(1)).alias("shared_columns"),
        rounded(F.avg(same), 4).alias("agreement_rate"),
    )


def periodicity(
    df: DataFrame, time: str, value: str, grain: str = "day", fill_gaps: bool = False
) -> DataFrame:
    """Correlation of the bucket means with themselves at fixed lags.

    The lag window runs over one row per time bucket, never over raw rows. A
    lag counts present buckets; ``fill_gaps`` inserts the missing ones first.
    """
    lags = PERIODICITY_LAGS[grain]
    number = as_number(value)
    series = (
        df.filter(F.col(time).isNotNull() & number.isNotNull())
        .groupBy(bucket(grain, F.col(time)).alias("bucket"))
        .agg(F.avg(number).alias("value"))
    )
    if fill_gaps:
        span = series.agg(F.min("bucket").alias("a"), F.max("bucket").alias("b"))
        every = span.select(F.explode(F.expr(f"sequence(a, b, interval 1 {grain})")).alias("bucket"))
        series = every.join(series, "bucket", "left")
    in_time = Window.orderBy("bucket")
    lagged = series.select("value", *[F.lag("value", k).over(in_time).alias(f"lag_{k}") for k in lags])
    one = lagged.agg(*[pearson(F.col("value"), F.col(f"lag_{k}")).alias(f"c_{k}") for k in lags])
    return one.select(
        F.inline(F.array(*[F.struct(F.lit(k).alias("lag"), rounded(F.col(f"c_{k}")).alias("correlation")) for k in lags]))
    )


def dominant_period(lag_rows: DataFrame) -> DataFrame:
    """The lag of the largest absolute correlation; the smaller lag wins a tie."""
    strength = F.coalesce(F.abs("correlation"), F.lit(0.0))
    best = lag_rows.agg(F.max_by(F.struct("lag", "correlation"), F.struct(strength, -F.col("lag"))).alias("b"))
    return best.select(
        F.col("b.lag").alias("dominant_period"),
        F.col("b.correlation").alias("strength"),
        F.coalesce(F.abs("b.correlation") >= PERIODICITY_THRESHOLD, F.lit(False)).alias("detected"),
    )


def periodicity_agreement(first: DataFrame, second: DataFrame) -> DataFrame:
    a = first.select(*[F.col(c).alias(f"primary_{c}") for c in first.columns])
    b = second.select(*[F.col(c).alias(f"secondary_{c}") for c in second.columns])
    joined = a.join(F.broadcast(b), F.lit(True))
    same = F.col("primary_detected").eqNullSafe(F.col("secondary_detected")) & F.col(
        "primary_dominant_period"
    ).eqNullSafe(F.col("secondary_dominant_period"))
    return joined.withColumn("agreement", same)


def value_counts(df: DataFrame, column: str, skip_blank: bool = False) -> DataFrame:
    """Non-null values with their counts, combined map-side."""
    keep = F.col(column).isNotNull()
    if skip_blank:
        keep = keep & (F.trim(F.col(column).cast("string")) != "")
    return df.filter(keep).groupBy(F.col(column).alias("category")).agg(F.count(F.lit(1)).alias("n"))


def category_groups(df: DataFrame, column: str, top_n: int = 10) -> DataFrame:
    """Head categories with the size of the tail, distinct count and coverage."""
    counts = value_counts(df, column)
    totals = counts.agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("distinct_count"))
    head = counts.orderBy(F.desc("n"), F.asc("category")).limit(top_n)
    covered = head.agg(F.sum("n").alias("head_total"))
    return (
        head.join(F.broadcast(totals), F.lit(True))
        .join(F.broadcast(covered), F.lit(True))
        .select(
            "category",
            F.col("n").alias("category_count"),
            F.greatest(F.lit(0), F.col("total") - F.col("head_total")).alias("tail_count"),
            "distinct_count",
            ratio(F.col("head_total"), F.col("total"), 4).alias("coverage"),
        )
    )


def iqr_outliers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows strictly outside q1 - 1.5 iqr and q3 + 1.5 iqr, per column."""
    fences = percentiles(df, columns, [0.25, 0.75]).select(
        "column_name",
        F.col("q")[0].alias("q1"),
        F.col("q")[1].alias("q3"),
    )
    iqr = F.col("q3") - F.col("q1")
    fences = fences.withColumn("lower_fence", F.col("q1") - iqr * IQR_FACTOR).withColumn(
        "upper_fence", F.col("q3") + iqr * IQR_FACTOR
    )
    # One fence row per column, folded to a map that rides along with the scan.
    table = fences.agg(
        F.map_from_entries(F.collect_list(F.struct("column_name", F.struct("lower_fence", "upper_fence")))).alias("f")
    )
    outside = {
        c: {
            "outlier_count": F.count_if(
                (as_number(c) < F.col("f")[c]["lower_fence"]) | (as_number(c) > F.col("f")[c]["upper_fence"])
            )
        }
        for c in columns
    }
    counted = summarize(df.select(*columns).join(F.broadcast(table), F.lit(True)), outside)
    return counted.join(F.broadcast(fences), "column_name").select(
        "column_name",
        rounded(F.col("lower_fence"), 4).alias("lower_fence"),
        rounded(F.col("upper_fence"), 4).alias("upper_fence"),
        "outlier_count",
    )


def text_length_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    metrics = {
        c: {
            "avg_length": F.avg(F.length(c)),
            "min_length": F.min(F.length(c)).cast("long"),
            "max_length": F.max(F.length(c)).cast("long"),
            "length_variance": F.var_pop(F.length(c)),
        }
        for c in columns
    }
    return summarize(df, metrics).select(
        "column_name",
        rounded(F.col("avg_length"), 4).alias("avg_length"),
        "min_length",
        "max_length",
        rounded(F.col("length_variance"), 2).alias("length_variance"),
    )


# Value patterns that tell a date, an identifier, a place or a number.
DATETIME_PATTERN = r"\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}"
ID_PATTERN = (
    r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$|^[A-Z]{2,5}\d{6,}$"
)
GEO_PATTERN = r"^-?\d{1,3}\.\d+,\s*-?\d{1,3}\.\d+$"
NUMBER_LIKE_PATTERN = r"^[\d\s\-+().,%$eE]+$"


def cleaned_number(text: Column) -> Column:
    """Read '1,200', '$5', '12%' and '(3.5)' as numbers; NULL otherwise."""
    raw = F.trim(text)
    bare = F.regexp_replace(raw, "[,$%()]", "")
    value = F.when(raw.rlike(NUMBER_LIKE_PATTERN), F.trim(bare)).try_cast("double")
    negative = raw.startswith("(") & raw.endswith(")")
    return F.when(negative, -value).otherwise(value)


def _share(flag: Column) -> Column:
    return F.avg(flag.cast("double"))


def pattern_metrics(column: str, family: str) -> dict[str, Column]:
    """Shares of the non-null values that look like dates, ids, places, numbers."""
    text = F.col(column).cast("string")
    number = as_number(column) if family == "numeric" else cleaned_number(text)
    present = F.col(column).isNotNull()
    return {
        "datetime_ratio": _share(text.rlike(DATETIME_PATTERN)),
        "id_ratio": _share(text.rlike(ID_PATTERN)),
        "geo_ratio": _share(text.rlike(GEO_PATTERN)),
        "numeric_ratio": _share(F.when(present, number.isNotNull())),
    }


def pattern_ratios(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    families = {f.name: type_family(f.dataType) for f in df.schema.fields}
    columns = list(columns or df.columns)
    names = ("datetime_ratio", "id_ratio", "geo_ratio", "numeric_ratio")
    rows = summarize(spread(df.select(*columns)), {c: pattern_metrics(c, families[c]) for c in columns})
    return rows.select("column_name", *[rounded(F.col(n)).alias(n) for n in names])


def range_flag_metrics(x: Column) -> dict[str, Column]:
    return {
        "all_integers": F.bool_and(x == F.floor(x)),
        "all_positive": F.bool_and(x >= 0),
        "in_0_1": F.bool_and(x.between(0, 1)),
        "in_0_100": F.bool_and(x.between(0, 100)),
    }


def numeric_flags(df: DataFrame, columns: Sequence[str] | None = None, approx: bool = False) -> DataFrame:
    """Integer, sign and range flags, and whether the values are equally spaced.

    Equal spacing needs no sort: n distinct values of which each lies on the
    grid min + k * (max - min) / (n - 1) fill that grid completely. Distinct
    values are counted for the columns alone whose values all lie on it, which
    is known once two scans have run. With ``approx`` the distinct count is a
    sketch's and may be off by a tenth.
    """
    columns = list(columns or numeric_columns(df))
    values = spread(numbers(df, columns))
    facts = {f"{prefix}_{c}": of(c) for c in columns for prefix, of in (("n", F.count), ("lo", F.min), ("hi", F.max))}
    ends = values.agg(*[expr.alias(name) for name, expr in facts.items()])
    metrics = {}
    for c in columns:
        n, lo, hi = F.col(f"n_{c}"), F.col(f"lo_{c}"), F.col(f"hi_{c}")
        steps = F.try_divide((F.col(c) - lo) * (n - 1), hi - lo)
        metrics[c] = {
            **range_flag_metrics(F.col(c)),
            # A double's error grows with the position it counts.
            "on_grid": F.bool_and(F.abs(steps - F.round(steps)) < F.greatest(F.lit(1e-6), n * 1e-15)),
            "n": F.count(c),
            "constant": F.bool_and(lo == hi),
        }
    seen = summarize(values.join(F.broadcast(ends), F.lit(True)), metrics)
    flags = seen
    open_columns = [r["column_name"] for r in seen.filter("n >= 2 AND NOT constant AND on_grid").select("column_name").collect()]
    if open_columns:
        distinct = summarize(values.select(*open_columns), {c: {"d": distinct_of(c, approx)} for c in open_columns})
        flags = flags.join(F.broadcast(distinct), "column_name", "left")
    else:
        flags = flags.withColumn("d", F.lit(None).cast("long"))
    same = (F.abs(F.col("n") - F.col("d")) <= F.col("n") * 0.1) if approx else F.col("n") == F.col("d")
    spaced = F.when(F.col("n") < 2, False).when(F.col("constant"), True).otherwise(F.coalesce(same, F.lit(False)))
    return flags.select(
        "column_name", "all_integers", "all_positive", "in_0_1", "in_0_100", spaced.alias("equally_spaced")
    )


def non_numeric_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Values present that do not parse as a number."""
    metrics = {
        c: {
            "non_null_count": F.count(c),
            "non_numeric_count": F.count_if(
                F.col(c).isNotNull() & F.col(c).cast("string").try_cast("double").isNull()
            ),
        }
        for c in columns
    }
    return summarize(df, metrics)


def top_values(df: DataFrame, columns: Sequence[str], k: int = 5) -> DataFrame:
    """The k most frequent values of each column as text, rank from 1.

    Values are counted per column first, so the ranking sees one row per
    distinct value and Spark prunes it to k rows before its shuffle.
    """
    cells = F.explode(
        F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in columns])
    )
    counts = (
        df.select(cells.alias("cell"))
        .select("cell.column_name", "cell.value")
        .filter(F.col("value").isNotNull())
        .groupBy("column_name", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    by_count = Window.partitionBy("column_name").orderBy(F.desc("n"), F.asc("value"))
    return counts.withColumn("rank", F.row_number().over(by_count)).filter(F.col("rank") <= k)


def display_stats(df: DataFrame, columns: Sequence[str] | None = None, k: int = 5, approx: bool = False) -> DataFrame:
    """Null %, unique %, range, mean and the top values as one text."""
    columns = list(columns or df.columns)
    numerics = set(numeric_columns(df))
    nothing = F.max(F.lit(None).cast("double"))
    metrics = {
        c: {
            "total": F.count(F.lit(1)),
            "present": F.count(c),
            "min_value": F.min(as_number(c)) if c in numerics else nothing,
            "max_value": F.max(as_number(c)) if c in numerics else nothing,
            "mean_value": F.avg(as_number(c)) if c in numerics else nothing,
        }
        for c in columns
    }
    # At most k entries per column reach this list.
    best = F.array_sort(F.collect_list(F.struct("rank", F.concat_ws("=", "value", F.col("n").cast("string")).alias("v"))))
    tops = (
        top_values(_pieces(df.select(*columns)), columns, k)
        .groupBy("column_name")
        .agg(F.array_join(F.transform(best, lambda s: s.v), "|").alias("top_values"))
    )
    total = F.col("total")
    return _with_distinct(df, metrics, "unique", approx).join(F.broadcast(tops), "column_name", "left").select(
        "column_name",
        ratio((total - F.col("present")) * 100, total, 4).alias("null_pct"),
        ratio(F.col("unique") * 100, total, 4).alias("unique_pct"),
        *[rounded(F.col(m), 4).alias(m) for m in ("min_value", "max_value", "mean_value")],
        "top_values",
    )


def column_importance(profile: DataFrame) -> DataFrame:
    """min(100, 100 * unique / total + 20 when nothing is missing)."""
    total, present, distinct = F.col("total_count"), F.col("non_null_count"), F.col("distinct_count")
    score = ratio(distinct * 100, total) + F.when(total == present, 20.0).otherwise(0.0)
    return profile.select("column_name", rounded(F.least(F.lit(100.0), score), 4).alias("importance"))


def null_traffic_light(profile: DataFrame) -> DataFrame:
    """ok, warn (to 10 %) or bad per column, with the table totals beside it."""
    total, present, distinct = F.col("total_count"), F.col("non_null_count"), F.col("distinct_count")
    missing = total - present
    pct = ratio(missing * 100, total)
    light = F.when(missing == 0, "ok").when(pct <= 10, "warn").otherwise("bad")
    everything = Window.partitionBy()
    return profile.select(
        "column_name",
        missing.alias("null_count"),
        light.alias("light"),
        F.count_if(missing > 0).over(everything).alias("columns_with_nulls"),
        F.count_if((distinct == total) & (total > 0)).over(everything).alias("all_unique_columns"),
    )


def drift_profile(df: DataFrame, columns: Sequence[str], approx: bool = False) -> DataFrame:
    """The facts two snapshots are compared by."""
    metrics = {
        c: {
            "total_rows": F.count(F.lit(1)),
            "unique_count": distinct_of(c, approx),
            "null_count": F.count_if(F.col(c).isNull()),
            "min_value": F.min(as_number(c)),
            "max_value": F.max(as_number(c)),
        }
        for c in columns
    }
    return summarize(df, metrics)


def profile_drift(before: DataFrame, after: DataFrame) -> DataFrame:
    """after minus before for each fact; a column in one snapshot only stays."""
    facts = ("total_rows", "unique_count", "null_count", "min_value", "max_value")
    a = before.select("column_name", *[F.col(f).alias(f"a_{f}") for f in facts])
    b = after.select("column_name", *[F.col(f).alias(f"b_{f}") for f in facts])

    def delta(fact: str) -> Column:
        gap = F.col(f"b_{fact}") - F.col(f"a_{fact}")
        return (rounded(gap, 4) if fact.endswith("_value") else gap).alias(f"{fact}_delta")

    return a.join(b, "column_name", "full").select("column_name", *[delta(f) for f in facts])
