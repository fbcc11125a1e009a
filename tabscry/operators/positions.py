"""Global row positions without a one-partition window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabscry.session import cut

PLACE_BITS = 33  # of monotonically_increasing_id

def with_position(df: DataFrame, order_by: Sequence[str], name: str = "position") -> DataFrame:
    """Add the 1-based position of every row in the order of ``order_by``.

    Rows are range-partitioned on all order columns (a unique last column
    splits a hot leading value), sorted inside their partition, numbered and
    written once, so that the partition offsets and the rows come from the
    same placement even after a lost executor. The offset table has one row
    per partition; the rows themselves move once.
    """
    order = [F.col(c) for c in order_by]
    placed = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    # The upper bits of that number are the partition, the lower ones the place in it.
    placed = placed.withColumn("_part", F.shiftright("_at", PLACE_BITS))
    per_part = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_part.select("_part", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_before"))
    place = F.col("_at").bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    return placed.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_before") + place + 1).drop("_part", "_before", "_at")
