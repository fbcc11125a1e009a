"""Running values per entity, computed slice by slice.

A window over one whole entity puts all its rows in one task. Here the window
runs inside (entity, slice of the order column); what a slice hands to the
next is a small table with one row per (entity, slice), and a second window
over that table gives the carry-in of each slice.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabscry.operators.positions import PLACE_BITS
from tabscry.session import cut


def _carried(rows: DataFrame, carry: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join on the keys in which null equals null, so that no row is lost."""
    named = carry.select(*[F.col(k).alias(f"_on_{k}") for k in keys], *[x for x in carry.columns if x not in keys])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_on_{k}")) for k in keys])
    return rows.join(named, same, "left").drop(*[f"_on_{k}" for k in keys])


def forward_fill(
    df: DataFrame,
    column: str,
    entity: Sequence[str],
    order_by: Sequence[str],
    slice_by: Column,
    output: str | None = None,
) -> DataFrame:
    """Last non-null value at or before each row in the order of ``order_by``.

    Every row comes back. Rows without an entity form one entity of their own; rows without a time (the first
    column of ``order_by``) have no place in the order: they keep what they have and fill nobody.
    """
    output = output or column
    keys = [*entity, "_slice"]
    timed = F.col(order_by[0]).isNotNull()
    sliced = df.withColumn("_slice", slice_by)
    local = Window.partitionBy(*entity, "_slice").orderBy(*order_by).rowsBetween(Window.unboundedPreceding, 0)
    rows = sliced.withColumn("_local", F.last(column, ignorenulls=True).over(local))
    ends = (
        sliced.filter(timed).groupBy(*keys)
        .agg(F.max_by(column, F.when(F.col(column).isNotNull(), F.struct(*order_by))).alias("_end"))
    )
    earlier = Window.partitionBy(*entity).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select(*entity, "_slice", F.last("_end", ignorenulls=True).over(earlier).alias("_carry"))
    return (
        _carried(rows, carry, keys)
        .withColumn(output, F.when(timed, F.coalesce("_local", "_carry")).otherwise(F.col(column)))
        .drop("_slice", "_local", "_carry")
    )


def overlap_batches(
    df: DataFrame,
    entity: Sequence[str],
    start: str,
    end: str,
    order_by: Sequence[str],
    slice_by: Column,
    output: str = "batch_no",
    strict: bool = True,
) -> DataFrame:
    """Number the runs of overlapping [start, end) calls of each entity from 1.

    A call opens a new batch when no earlier call of the entity is still
    running: every earlier end lies at or before its start (before it when
    ``strict`` is False). Every row comes back: calls without an entity form one
    entity of their own, calls without a start get no number.
    """
    keys = [*entity, "_slice"]
    sliced = df.withColumn("_slice", slice_by)
    timed = F.col(start).isNotNull()
    prior = Window.partitionBy(*keys).orderBy(*order_by).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*entity).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    reach = sliced.filter(timed).groupBy(*keys).agg(F.max(end).alias("_reach"))
    carried = reach.select(*keys, F.max("_reach").over(earlier).alias("_carry"))
    running_to = F.greatest(F.max(end).over(prior), F.col("_carry"))
    opens = running_to.isNull() | ((running_to <= F.col(start)) if strict else (running_to < F.col(start)))
    flagged = _carried(sliced, carried, keys).withColumn("_open", opens.cast("long"))
    opened = flagged.filter(timed).groupBy(*keys).agg(F.sum("_open").alias("_opened"))
    base = opened.select(*keys, F.coalesce(F.sum("_opened").over(earlier), F.lit(0)).alias("_base"))
    upto = Window.partitionBy(*keys).orderBy(*order_by).rowsBetween(Window.unboundedPreceding, 0)
    return (
        _carried(flagged, base, keys)
        .withColumn(output, F.when(timed, F.col("_base") + F.sum("_open").over(upto)))
        .drop("_slice", "_carry", "_open", "_base")
    )


def order_breaks(df: DataFrame, value: str, key: str, slice_rows: int = 1_000_000) -> DataFrame:
    """One row: how often ``value`` falls when rows are read in ``key`` order.

    Rows are range-partitioned by key, sorted and numbered; a slice is a run of at most ``slice_rows`` rows of one
    partition, so small slices cost no further tasks. Breaks inside a slice come from a window over that slice,
    breaks between slices from the last value of one and the first of the next.
    """
    placed = cut(df.select(value, key).repartitionByRange(key).sortWithinPartitions(key).withColumn("_at", F.monotonically_increasing_id()))
    # The upper bits of that number are the partition, the lower ones the place in it.
    place = F.col("_at").bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    slices = ["_part", "_slice"]
    sliced = placed.select(value, "_at", F.shiftright("_at", PLACE_BITS).alias("_part"), F.floor(place / slice_rows).alias("_slice"))
    local = Window.partitionBy(*slices).orderBy("_at")
    marked = sliced.withColumn("_fall", (F.col(value) < F.lag(value).over(local)).cast("long"))
    ends = marked.groupBy(*slices).agg(
        F.coalesce(F.sum("_fall"), F.lit(0)).alias("_falls"),
        F.count(F.lit(1)).alias("_rows"),
        F.min_by(value, "_at").alias("_first"),
        F.max_by(value, "_at").alias("_last"),
    )
    # One row per slice.
    across = Window.orderBy(*slices)
    steps = ends.withColumn("_step", (F.col("_first") < F.lag("_last").over(across)).cast("long"))
    return steps.agg(
        F.coalesce(F.sum("_rows"), F.lit(0)).alias("n_rows"),
        F.coalesce(F.sum(F.col("_falls") + F.coalesce("_step", F.lit(0))), F.lit(0)).alias("breaks"),
    )
