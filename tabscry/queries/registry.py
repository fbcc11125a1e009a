"""The registry of queries and the helpers their SQL checks share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabscry.session import SETTINGS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()


def query(name: str, sql: str | None = None):
    """Register a query under ``name`` with an optional SQL check."""

    def wrap(fn: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            for key, value in SETTINGS.items():
                spark.conf.set(key, value)
            return fn(spark, sf_dir)

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def events_blanked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events with value and event_type blanked by rule; the given tables hold no nulls."""
    return (
        table(spark, sf_dir, "events")
        .withColumn("value", F.when(F.col("event_id") % 7 != 0, F.col("value")))
        .withColumn("event_type", F.when(F.col("event_id") % 11 != 0, F.col("event_type")))
    )


BLANKED = """blanked AS (
  SELECT event_id, ts, user_id,
         CASE WHEN event_id % 11 <> 0 THEN event_type END AS event_type,
         CASE WHEN event_id % 7 <> 0 THEN value END AS value,
         props
  FROM events)"""


def rnd(expr: str, digits: int = 6) -> str:
    return f"(round(CAST({expr} AS DOUBLE), {digits}) + 0.0)"


def stamp(expr: str) -> str:
    return f"strftime({expr}, '%Y-%m-%d %H:%M:%S')"


def union(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)
