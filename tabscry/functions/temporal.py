"""Time parsing and time buckets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

GRAINS = ("hour", "day", "week", "month")


def parse_temporal(col: Column) -> Column:
    """Read text time in four spellings: ISO text, yyyyMMdd, epoch ms, epoch s.

    The digit count decides the spelling, so a compact date is never read as
    an epoch. Anything else is NULL.
    """
    text = F.trim(col.cast("string"))
    digits = text.rlike("^[0-9]+$")
    n_digits = F.length(text)
    number = text.try_cast("bigint")
    return (
        F.when(digits & (n_digits == 8), F.try_to_timestamp(text, F.lit("yyyyMMdd")))
        .when(digits & (n_digits == 13), F.timestamp_millis(number))
        .when(digits & n_digits.between(9, 10), F.timestamp_seconds(number))
        .when(~digits, F.try_to_timestamp(text))
    )


def bucket(grain: str, col: Column) -> Column:
    """Start of the bucket; ``raw`` keeps the time as it is."""
    return col if grain == "raw" else F.date_trunc(grain, col)


def stamp(col: Column) -> Column:
    """Fixed text form of a time for reports and checks."""
    return F.date_format(col, "yyyy-MM-dd HH:mm:ss")
