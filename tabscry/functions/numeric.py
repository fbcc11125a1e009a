"""Null-safe numeric expressions that hold under ANSI mode."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def as_number(col: Column | str) -> Column:
    """The value as a double, NULL when it does not parse or is not finite."""
    number = F.expr(f"try_cast(`{col}` AS double)") if isinstance(col, str) else col.try_cast("double")
    return F.when(F.abs(number) < float("inf"), number)  # NaN counts as larger


def numbers(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """The columns as doubles under their names, each converted once by its type.

    Aggregates over the result read plain columns, which keeps the generated
    code of wide aggregations small.
    """
    out = []
    for name in columns:
        kind = df.schema[name].dataType
        if isinstance(kind, (T.IntegralType, T.DecimalType)):
            out.append(F.col(name).cast("double").alias(name))
        elif isinstance(kind, (T.DoubleType, T.FloatType)):
            number = F.col(name).cast("double")
            out.append(F.when(F.abs(number) < float("inf"), number).alias(name))
        else:
            out.append(as_number(name).alias(name))
    return df.select(*keep, *out)


def rounded(col: Column, digits: int = 6) -> Column:
    """Rounded double without a negative zero."""
    return F.round(col.cast("double"), digits) + F.lit(0.0)


def ratio(part: Column, whole: Column, digits: int | None = None) -> Column:
    """part / whole, NULL for an empty whole."""
    value = F.try_divide(part.cast("double"), whole.cast("double"))
    return value if digits is None else rounded(value, digits)


def pearson(x: Column, y: Column) -> Column:
    """Correlation over the rows where both sides are present.

    NULL when either side is constant, where the built-in raises under ANSI.
    """
    both = x.isNotNull() & y.isNotNull()
    xs, ys = F.when(both, x), F.when(both, y)
    spread = F.stddev_pop(xs) * F.stddev_pop(ys)
    return F.try_divide(F.covar_pop(xs, ys), F.when(spread > 0, spread))


def greatest_or_null(cols: list[Column]) -> Column:
    """Greatest value, NULL as soon as one argument is NULL."""
    if len(cols) == 1:
        return cols[0]
    missing = cols[0].isNull()
    for col in cols[1:]:
        missing = missing | col.isNull()
    return F.when(~missing, F.greatest(*cols))
