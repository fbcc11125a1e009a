"""Exact percentiles that never gather an unbounded group in one task.

A plan under a known size, and every group under a row bound, is ranked from
its value counts. Larger groups are narrowed first: a sketch brackets
each wanted rank, the bracket is cut into equal-width slots whose counts are
combined map-side, and only the slot holding the rank is looked at value by
value. Slots below and above the bracket are counted too, so the result is
exact whatever the error of the sketch.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabscry.functions.numeric import as_number
from tabscry.session import is_small, spread

HOT_GROUP_ROWS = 5_000_000
# Stored bytes of a table up to which one task ranks a whole column.
RANKED_BYTES = 8 * 1024 * 1024
SKETCH_ACCURACY = 10_000
BRACKET = 0.001
SLOTS = 1024


def _long(df: DataFrame, columns: Sequence[str], keys: Sequence[str]) -> DataFrame:
    pairs = F.explode(
        F.array(*[F.struct(F.lit(c).alias("column_name"), as_number(c).alias("value")) for c in columns])
    )
    return (
        df.select(*keys, pairs.alias("cell"))
        .select(*keys, "cell.column_name", "cell.value")
        .filter(F.col("value").isNotNull())
    )


def _ranked(long: DataFrame, keys: list[str], probs: Sequence[float]) -> DataFrame:
    """Percentiles of bounded groups from value counts in value order.

    Equal values are combined map-side; the window sorts distinct values only
    and can spill, where the built-in percentile holds a map per group.
    """
    in_value = Window.partitionBy(*keys).orderBy("value")
    whole = Window.partitionBy(*keys)
    ranked = (
        long.groupBy(*keys, "value")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(*keys, "value", F.sum("n").over(in_value).alias("upto"), (F.sum("n").over(whole) - 1).alias("last"))
    )
    wanted = []
    for i, p in enumerate(probs):
        rank = F.col("last") * F.lit(float(p))
        wanted.append(F.min(F.when(F.col("upto") > F.floor(rank), F.col("value"))).alias(f"a{i}"))
        wanted.append(F.min(F.when(F.col("upto") > F.ceil(rank), F.col("value"))).alias(f"b{i}"))
    ends = ranked.groupBy(*keys).agg(F.first("last").alias("last"), *wanted)
    exact = []
    for i, p in enumerate(probs):
        rank = F.col("last") * F.lit(float(p))
        exact.append(F.col(f"a{i}") + (rank - F.floor(rank)) * (F.col(f"b{i}") - F.col(f"a{i}")))
    return ends.select(*keys, F.array(*exact).alias("q"))


def _narrowed(long: DataFrame, keys: list[str], probs: Sequence[float]) -> DataFrame:
    """Exact percentiles for a bounded number of groups of any size."""
    edges = [F.lit(x) for p in probs for x in (max(p - BRACKET, 0.0), min(p + BRACKET, 1.0))]
    sketch = long.groupBy(*keys).agg(
        F.count("value").alias("n"),
        F.percentile_approx("value", F.array(*edges), SKETCH_ACCURACY).alias("edge"),
    )
    brackets = sketch.select(
        *keys,
        F.array(
            *[
                F.struct(
                    F.lit(i).alias("i"),
                    F.col("edge")[2 * i].alias("lo"),
                    F.col("edge")[2 * i + 1].alias("hi"),
                    ((F.col("n") - 1) * F.lit(float(p))).alias("rank"),
                )
                for i, p in enumerate(probs)
            ]
        ).alias("brackets"),
    )
    cell = F.col("b")
    slot = (
        F.when(F.col("value") < cell.lo, F.lit(0))
        .when(F.col("value") > cell.hi, F.lit(SLOTS + 2))
        .when(cell.lo == cell.hi, F.lit(1))
        .otherwise(F.width_bucket("value", cell.lo, cell.hi, F.lit(SLOTS)))
    )
    placed = (
        long.join(F.broadcast(brackets), keys)
        .select(*keys, "value", F.explode("brackets").alias("b"))
        .select(*keys, "value", cell.i.alias("i"), cell.rank.alias("rank"), slot.cast("int").alias("slot"))
    )
    by_slot = Window.partitionBy(*keys, "i").orderBy("slot")
    counts = placed.groupBy(*keys, "i", "rank", "slot").agg(F.count(F.lit(1)).alias("n"))
    low, high = F.floor("rank"), F.ceil("rank")
    targets = (
        counts.withColumn("upto", F.sum("n").over(by_slot))
        .withColumn("before", F.col("upto") - F.col("n"))
        .filter(((F.col("before") <= low) & (low < F.col("upto"))) | ((F.col("before") <= high) & (high < F.col("upto"))))
        .select(*keys, "i", "slot", "before")
    )
    in_slot = Window.partitionBy(*keys, "i", "slot").orderBy("value")
    values = (
        placed.join(F.broadcast(targets), [*keys, "i", "slot"])
        .groupBy(*keys, "i", "slot", "rank", "before", "value")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("upto", F.col("before") + F.sum("n").over(in_slot))
    )
    picked = values.groupBy(*keys, "i").agg(
        F.min(F.when(F.col("upto") > low, F.col("value"))).alias("v0"),
        F.min(F.when(F.col("upto") > high, F.col("value"))).alias("v1"),
        F.first("rank").alias("rank"),
    )
    exact = F.col("v0") + (F.col("rank") - F.floor("rank")) * (F.col("v1") - F.col("v0"))
    # One row per wanted percentile: the list below holds len(probs) entries.
    ordered = F.array_sort(F.collect_list(F.struct("i", exact.alias("v"))))
    return picked.groupBy(*keys).agg(F.transform(ordered, lambda s: s.v).alias("q"))


def percentiles(
    df: DataFrame,
    columns: Sequence[str],
    probs: Sequence[float],
    keys: Sequence[str] = (),
    small: bool | None = None,
    hot_rows: int = HOT_GROUP_ROWS,
) -> DataFrame:
    """Interpolated percentiles: one row per (keys, column_name), ``q`` as array.

    ``small`` overrides the size check (tests force both ways through it).
    """
    long = _long(df, columns, keys)
    group = [*keys, "column_name"]
    if small is None:
        # Without keys a column is one group, ranked by one task.
        small = is_small(df.select(*keys, *columns)) if keys else is_small(df.select(*columns), RANKED_BYTES)
    if small:
        return _ranked(_long(spread(df.select(*keys, *columns)), columns, keys), group, probs)
    if not keys:
        return _narrowed(long, group, probs)
    # Groups above the bound number at most rows / hot_rows, so they can be sent out.
    hot = long.groupBy(*group).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > hot_rows).select(*group)
    cold_part = _ranked(long.join(F.broadcast(hot), group, "left_anti"), group, probs)
    hot_part = _narrowed(long.join(F.broadcast(hot), group, "left_semi"), group, probs)
    return cold_part.unionByName(hot_part)
