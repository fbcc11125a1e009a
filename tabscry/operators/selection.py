"""Rows by rank without moving the table: ranges are counted, and only the range that holds the ranks is ordered.

A pass takes a few order keys as bounds, counts the rows of every range between them (one small aggregate over the order
columns) and keeps the ranges that hold the wanted ranks. The bounds only decide how fast the ranges shrink; positions come
from exact counts. Each pass divides the rows left by about ``bounds``, so a table of 10^11 rows takes four of them.

Nulls come first, as in ``orderBy``. The order should end in a unique column; rows with equal keys keep together, and which of
them gets which position is then open.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabscry.operators.positions import with_position
from tabscry.session import cut

BOUNDS = 64
ENOUGH_ROWS = 50_000


def _bounds(df: DataFrame, order_by: Sequence[str], bounds: int) -> DataFrame:
    """One row: the keys with the smallest hashes, in order; written, so that all passes see the same ones."""
    keys = df.select(F.struct(*order_by).alias("key")).orderBy(F.xxhash64("key"), "key").limit(bounds)
    return cut(keys.agg(F.array_sort(F.array_distinct(F.collect_list("key"))).alias("_bounds")))


def narrowed(
    df: DataFrame, order_by: Sequence[str], first: int, last: int, total: int, bounds: int = BOUNDS, enough: int = ENOUGH_ROWS
) -> tuple[DataFrame, int, int]:
    """A part of the table in order that holds the positions first + 1 to last, the rows before it, and its size."""
    part, before, rows = df, 0, total
    while rows > max(enough, 2 * (last - first)):
        split = _bounds(part, order_by, bounds)
        # The number of bounds up to the key names its range.
        placed = part.join(F.broadcast(split), F.lit(True)).withColumn("_key", F.struct(*order_by))
        placed = placed.withColumn("_range", F.expr("size(filter(_bounds, b -> b <= _key))"))
        counts = {r["_range"]: r["count"] for r in placed.groupBy("_range").count().collect()}  # at most bounds + 1 rows
        begin, held, size = before, [], 0
        start = before
        for number in sorted(counts):
            if begin < last and begin + counts[number] > first:
                start = begin if not held else start
                held.append(number)
                size += counts[number]
            begin += counts[number]
        if size == rows:
            break  # equal keys, or ranks from all ranges
        # In terms of the bounds themselves, which a row is held against once.
        low, high = F.get("_bounds", F.lit(held[0] - 1)), F.get("_bounds", F.lit(held[-1]))
        edge = split.select(low.alias("_low"), high.alias("_high")) if held[0] else split.select(F.lit(None).cast(split.schema["_bounds"].dataType.elementType).alias("_low"), high.alias("_high"))
        key = F.struct(*order_by)
        inside = (F.col("_low").isNull() | (key >= F.col("_low"))) & (F.col("_high").isNull() | (key < F.col("_high")))
        part = part.join(F.broadcast(edge), inside).drop("_low", "_high")
        before, rows = start, size
    return part, before, rows


def rows_between(df: DataFrame, order_by: Sequence[str], first: int, last: int, total: int | None = None, **how: int) -> DataFrame:
    """The rows at the positions first + 1 to last in the order of ``order_by``, with ``position``."""
    total = df.count() if total is None else total
    first, last = max(first, 0), min(last, total)
    if first >= last:
        return df.limit(0).withColumn("position", F.lit(0).cast("long"))
    part, before, _ = narrowed(df, order_by, first, last, total, **how)
    at = F.col("position") + before
    return with_position(part, order_by).withColumn("position", at).filter((F.col("position") > first) & (F.col("position") <= last))
