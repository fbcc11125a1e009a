"""Samples and windowed bases. Every pick is repeatable: hash order, not row order."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabscry.functions.numeric import as_number
from tabscry.operators.positions import with_position
from tabscry.operators.profiling import type_family
from tabscry.operators.quantiles import percentiles
from tabscry.operators.selection import rows_between

# Sample sizes and bounds.
TARGET_ROWS = 1000
SYSTEMATIC_FROM_ROWS = 1_000_000
PANEL_ENTITIES = (5, 20)
PANEL_MIN_ROWS = 2


def windowed(
    df: DataFrame,
    time: str | None = None,
    days: int | None = None,
    n: int | None = None,
    order_by: Sequence[str] = (),
    as_of: datetime | None = None,
) -> DataFrame:
    """Rows of the last ``days`` before ``as_of``, then at most ``n`` of them.

    ``as_of`` defaults to the newest time, one value read first, so that the
    window is a constant the scan can prune files and row groups by.
    """
    out = df
    if time and days:
        as_of = as_of or df.agg(F.max(time)).first()[0]
        if as_of is None:
            return df.limit(0)
        since = F.lit(as_of - timedelta(days=days)).cast(df.schema[time].dataType)
        out = df.filter(F.col(time) >= since)
    if n is not None:
        out = out.orderBy(*order_by).limit(n)
    return out


# Fixed value: the largest preview.
PREVIEW_ROWS = 1000


def preview(df: DataFrame, order_by: Sequence[str], n: int = 50) -> DataFrame:
    """First n rows in key order; planned as a top-k, not a sort. More than PREVIEW_ROWS are refused."""
    if not 1 <= n <= PREVIEW_ROWS:
        raise ValueError(f"a preview has 1 to {PREVIEW_ROWS} rows, not {n}; read the relation for more")
    return df.orderBy(*order_by).limit(n)


def time_head(df: DataFrame, time: str, n: int, tie: Sequence[str] = ()) -> DataFrame:
    return df.orderBy(time, *tie).limit(n)


def hash_order(keys: Sequence[str], seed: int = 42) -> Column:
    return F.xxhash64(*[F.col(k) for k in keys], F.lit(seed))


def random_rows(df: DataFrame, keys: Sequence[str], n: int, seed: int = 42) -> DataFrame:
    """Uniform sample of n rows: the n smallest key hashes, kept per partition first."""
    return df.orderBy(hash_order(keys, seed), *keys).limit(n)


def head_middle_tail(df: DataFrame, order_by: Sequence[str], target: int = TARGET_ROWS, **how: int) -> DataFrame:
    """First, middle and last third of the target size, labelled by part.

    Both ends are top-k plans; the middle is selected by rank. Only rows near a wanted place are moved.
    """
    third = target // 3
    total = df.count()
    middle_from = (total - third) // 2
    head = with_position(df.orderBy(*order_by).limit(third), order_by)
    middle = rows_between(df, order_by, middle_from, middle_from + third, total, **how)
    tail = with_position(df.orderBy(*[F.col(c).desc() for c in order_by]).limit(third), order_by)
    tail = tail.withColumn("position", F.col("position") + max(total - third, 0))
    parts = {"head": head, "middle": middle, "tail": tail}
    return reduce(DataFrame.unionByName, [rows.withColumn("part", F.lit(name)) for name, rows in parts.items()])


def systematic(df: DataFrame, order_by: Sequence[str], every: int, n: int | None = None) -> DataFrame:
    """Every ``every``-th row in order, at most n of them."""
    hit = F.pmod("position", F.lit(every)) == 0
    if n is not None:
        hit = hit & (F.col("position") <= every * n)
    return with_position(df, order_by).filter(hit)


def panel(
    df: DataFrame, entity: str, order_by: Sequence[str], size: int, by_hash: bool = True, seed: int = 42
) -> DataFrame:
    """The first rows in time of a few entities.

    ``size`` fixes both counts: a fifth of it, between 5 and 20, entities, and
    size / entities rows (at least 2) of each. Spark keeps only the first rows
    of an entity per partition before the ranking shuffle.
    """
    k = max(PANEL_ENTITIES[0], min(PANEL_ENTITIES[1], size // 5))
    m = max(PANEL_MIN_ROWS, size // k)
    order = [hash_order([entity], seed), entity] if by_hash else [entity]
    picked = df.filter(F.col(entity).isNotNull()).select(entity).distinct().orderBy(*order).limit(k)
    in_time = Window.partitionBy(entity).orderBy(*order_by)
    return (
        df.join(F.broadcast(picked), entity, "left_semi")
        .withColumn("entity_row", F.row_number().over(in_time))
        .filter(F.col("entity_row") <= m)
    )


def stratified(df: DataFrame, stratum: str, keys: Sequence[str], per_stratum: int, seed: int = 42) -> DataFrame:
    """At most ``per_stratum`` rows of each stratum, by key hash."""
    by_hash = Window.partitionBy(stratum).orderBy(hash_order(keys, seed), *keys)
    return df.withColumn("_rank", F.row_number().over(by_hash)).filter(F.col("_rank") <= per_stratum).drop("_rank")


def strategy(n_rows: Column, has_time: bool, target: int = TARGET_ROWS) -> Column:
    """Name of the sampling strategy for a table of ``n_rows`` rows."""
    by_size = F.when(n_rows > SYSTEMATIC_FROM_ROWS, "systematic").otherwise("random")
    large = F.lit("head_tail") if has_time else by_size
    return F.when(n_rows <= target, "full_scan").otherwise(large)


def sampling_choice(df: DataFrame, has_time: bool, target: int = TARGET_ROWS) -> DataFrame:
    n = F.col("row_count")
    chosen = strategy(n, has_time, target)
    return df.agg(F.count(F.lit(1)).alias("row_count")).select(
        "row_count",
        chosen.alias("strategy"),
        F.when(chosen == "full_scan", n).otherwise(F.lit(target).cast("long")).alias("sample_size"),
        F.when(chosen == "systematic", F.floor(n / target)).alias("sample_every_n"),
    )


def smart_sample(
    df: DataFrame, order_by: Sequence[str], has_time: bool, target: int = TARGET_ROWS
) -> DataFrame:
    """Sample by the chosen strategy; the one row read back names the branch."""
    choice = sampling_choice(df, has_time, target).first()
    if choice["strategy"] == "full_scan":
        return df
    if choice["strategy"] == "head_tail":
        return head_middle_tail(df, order_by, target).drop("position", "part")
    if choice["strategy"] == "systematic":
        return systematic(df, order_by, choice["sample_every_n"], target).drop("position")
    return random_rows(df, order_by, target)


def first_values(df: DataFrame, columns: Sequence[str], order_by: Sequence[str], n: int = 10) -> DataFrame:
    """The first n non-null values of each column, as text, in key order.

    A top-k per column reads the key and that column only.
    """
    numbered = Window.orderBy(*[f"_key{i}" for i in range(len(order_by))])  # over n rows
    keys = [F.col(k).alias(f"_key{i}") for i, k in enumerate(order_by)]
    parts = []
    for name in columns:
        cells = df.filter(F.col(name).isNotNull()).select(*keys, F.col(name).cast("string").alias("value"))
        head = cells.orderBy(*[f"_key{i}" for i in range(len(order_by))]).limit(n)
        parts.append(
            head.select(F.lit(name).alias("column_name"), F.row_number().over(numbered).alias("value_no"), "value")
        )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def column_examples(df: DataFrame, order_by: Sequence[str]) -> DataFrame:
    """Up to five typical values per column, by type.

    numeric: smallest, largest, middle value; time: first and last; text: the
    three most frequent, then the first distinct ones in key order.
    """
    families = {f.name: type_family(f.dataType) for f in df.schema.fields}
    numbers = [c for c, fam in families.items() if fam == "numeric"]
    times = [c for c, fam in families.items() if fam == "time"]
    texts = [c for c, fam in families.items() if fam == "text"]
    parts: list[DataFrame] = []
    if numbers:
        middle = percentiles(df, numbers, [0.5])
        ends = df.agg(
            *[F.min(as_number(c)).alias(f"lo_{c}") for c in numbers],
            *[F.max(as_number(c)).alias(f"hi_{c}") for c in numbers],
        ).select(
            F.inline(
                F.array(
                    *[
                        F.struct(F.lit(c).alias("column_name"), F.col(f"lo_{c}").alias("lo"), F.col(f"hi_{c}").alias("hi"))
                        for c in numbers
                    ]
                )
            )
        )
        values = F.array_distinct(F.transform(F.array("lo", "hi", F.col("q")[0]), lambda v: F.round(v, 2).cast("string")))
        parts.append(ends.join(F.broadcast(middle), "column_name").select("column_name", values.alias("examples")))
    for c in times:
        ends = df.agg(F.min(c).alias("lo"), F.max(c).alias("hi"))
        texts_of = F.array_distinct(F.array(F.col("lo").cast("string"), F.col("hi").cast("string")))
        parts.append(ends.select(F.lit(c).alias("column_name"), texts_of.alias("examples")))
    if texts:
        cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("value")) for c in texts]))
        seen = (
            df.select(F.struct(*order_by).alias("key"), cells.alias("cell"))
            .select("key", "cell.column_name", "cell.value")
            .filter(F.col("value").isNotNull())
            .groupBy("column_name", "value")
            .agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("first_key"))
        )
        by_count = Window.partitionBy("column_name").orderBy(F.desc("n"), F.asc("value"))
        by_first = Window.partitionBy("column_name").orderBy("first_key", "value")
        top = seen.withColumn("r", F.row_number().over(by_count)).filter("r <= 3").select("column_name", "value", "r")
        early = (
            seen.withColumn("r", F.row_number().over(by_first)).filter("r <= 5").select("column_name", "value", F.expr("r + 3 AS r"))
        )
        # At most eight entries per column reach this list.
        listed = F.transform(F.array_sort(F.collect_list(F.struct("r", "value"))), lambda s: s.value)
        parts.append(
            top.unionByName(early)
            .groupBy("column_name")
            .agg(F.slice(F.array_distinct(listed), 1, 5).alias("examples"))
        )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select("column_name", F.array_join("examples", "|").alias("examples"))
