"""What is run for one column, by its semantic type. Every result is a lazy DataFrame."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from tabscry.operators import profiling as p
from tabscry.operators import scans as s
from tabscry.operators import series as ser
from tabscry.operators import textops as to
from tabscry.operators import typing_rules as t
from tabscry.plans.report import column_facts


def semantic_type_of(df: DataFrame, column: str) -> str:
    """Semantic type by the rules over the column's evidence; one row is read back."""
    return t.understand(df.select(column)).first()["semantic_type"]


def analyze_column(
    df: DataFrame,
    column: str,
    semantic_type: str,
    time: str | None = None,
    group_by: Sequence[str] = (),
    numerics: Sequence[str] = (),
) -> dict[str, DataFrame]:
    """The analyses of a column: statistics, scans, series and facts by type."""
    found: dict[str, DataFrame] = {"nulls": s.scan_nulls(df, [column])}
    if group_by:
        found["conflicts"] = s.scan_conflicts(df, column, group_by)
    if semantic_type == "numeric":
        found["distribution"] = p.distribution_shape(p.distribution(df, [column]))
        others = [n for n in numerics if n != column]
        if others:
            found["correlations"] = p.correlations(df, column, others)
        if time:
            found["periodicity"] = p.periodicity(df, time, column)
            found["time_series"] = ser.time_series_adaptive(df, time, column)
        found["histogram"] = ser.histogram(df, column)
        found["facts"] = column_facts(df, [column], group_by)
    elif semantic_type == "temporal":
        found["time_series"] = ser.time_series_adaptive(df, column)
        found["stats"] = p.basic_stats(df, column)
    elif semantic_type == "categorical":
        found["groups"] = p.category_groups(df, column)
        found["top"] = ser.top_with_other(df, column, 12)
        found["share"] = ser.share_series(df, column)
        for number in [n for n in numerics if n != column]:
            found[f"mean_{number}"] = ser.mean_over_top(df, column, number, 12)
    elif semantic_type == "text":
        found["lengths"] = p.text_length_stats(df, [column])
        found["tokens"] = to.count_tokens(df, [column])
    else:
        found["stats"] = p.basic_stats(df, column)
    return found
