"""Continuous forms of the scans.

Results go to a folder with one sub-folder per micro-batch, overwritten when
a batch is retried, so a restart repeats no rows. State is bounded by the
watermark: in update mode a window that changes is written again and the
reader takes its newest version.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabscry.operators.sampling import hash_order

c = F.col


def read_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int | None = None) -> DataFrame:
    """A parquet table, one file or a folder of them, as a stream of its files."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", str(files_per_batch))
    # As a pattern the path may name a file; a plain one must name a folder.
    path = path.rstrip("/")
    start = re.sub(r"([\\\[\]{}*?])", r"\\\1", path[:-1])
    return reader.parquet(f"{start}[{path[-1]}]")


def timed(stream: DataFrame, time: str, delay: str = "1 hour") -> DataFrame:
    """Watermark the time column; zone-less times are read as session-zone times first."""
    return stream.withColumn(time, c(time).cast("timestamp")).withWatermark(time, delay)


def rate_violations(stream: DataFrame, user: str, path: str, time: str, limit: int, period: str) -> DataFrame:
    """Calls per (user, path, tumbling window) above the limit."""
    return (
        stream.groupBy(F.window(time, period).alias("w"), user, path)
        .agg(F.count(F.lit(1)).alias("calls"))
        .filter(c("calls") > limit)
        .select(F.unix_timestamp("w.start").alias("window_start"), user, path, "calls", (c("calls") - limit).alias("rejected"))
    )


def quality_windows(stream: DataFrame, time: str, value: str, length: str = "1 hour", step: str = "15 minutes") -> DataFrame:
    """Rows, nulls, null rate and mean of a value per sliding window."""
    return (
        stream.groupBy(F.window(time, length, step).alias("w"))
        .agg(
            F.count(F.lit(1)).alias("total_count"),
            F.count_if(c(value).isNull()).alias("null_count"),
            F.avg(value).alias("mean_value"),
        )
        .select(
            c("w.start").alias("window_start"), "total_count", "null_count", (c("null_count") / c("total_count")).alias("null_rate"), "mean_value"
        )
    )


def call_sessions(stream: DataFrame, agent: str, time: str, gap: str) -> DataFrame:
    """Overlapping calls of an agent as sessions; ``gap`` is SQL giving each call's duration."""
    return (
        stream.groupBy(F.session_window(c(time), F.expr(gap)).alias("w"), agent)
        .agg(F.count(F.lit(1)).alias("calls"))
        .select(agent, c("w.start").alias("batch_start"), c("w.end").alias("batch_end"), "calls")
    )


def run_to_end(stream: DataFrame, each_batch: Callable[[DataFrame, int], None], checkpoint: str, mode: str) -> None:
    """Process all available input, then stop."""
    query = (
        stream.writeStream.outputMode(mode)
        .foreachBatch(each_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def to_versions(stream: DataFrame, folder: str, mode: str = "update") -> str:
    """Write each micro-batch to its own sub-folder; returns the result folder."""
    target = f"{folder.rstrip('/')}/result"

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    run_to_end(stream, write, f"{folder.rstrip('/')}/checkpoint", mode)
    return target


def newest_versions(spark: SparkSession, target: str, keys: Sequence[str]) -> DataFrame:
    """The last written row of every key over all micro-batches."""
    rows = spark.read.parquet(target)
    values = [x for x in rows.columns if x not in keys and x != "batch"]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("v"))
    return newest.select(*keys, "v.*")


def closed_sessions(spark: SparkSession, stream: DataFrame, agent: str, time: str, gap: str, folder: str) -> DataFrame:
    """The sessions the watermark has passed, each written once when it closes.

    Open sessions stay in the state store, which drops them as they close, so
    its size follows the sessions of the watermark's delay and not the length
    of the stream. A later run on the same folder goes on from that state.
    """
    target = to_versions(call_sessions(stream, agent, time, gap), folder, mode="append")
    return spark.read.parquet(target).drop("batch")


def last_batch(spark: SparkSession, target: str) -> DataFrame:
    """The whole result as of the last micro-batch (complete mode)."""
    rows = spark.read.parquet(target)
    newest = rows.agg(F.max("batch").alias("batch"))
    return rows.join(F.broadcast(newest), "batch").drop("batch")


def reservoir(spark: SparkSession, stream: DataFrame, keys: Sequence[str], n: int, folder: str, seed: int = 42) -> DataFrame:
    """Uniform sample of n rows of a stream: the n smallest key hashes seen so far.

    Each micro-batch merges its own n smallest with the n kept before and
    writes the outcome as the next version. A retried batch starts again from
    the version before it; a restart goes on from the newest version in the
    folder, with or without new input.
    """
    target = f"{folder.rstrip('/')}/reservoir"
    schema = stream.schema

    def keep(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        best = batch.orderBy(hash_order(keys, seed), *keys).limit(n)
        if batch_id > 0:
            before = session.read.schema(schema).parquet(f"{target}/batch={batch_id - 1}")
            best = before.unionByName(best).orderBy(hash_order(keys, seed), *keys).limit(n)
        best.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    run_to_end(stream, keep, f"{folder.rstrip('/')}/checkpoint", "append")
    try:
        return last_batch(spark, target)
    except AnalysisException as missing:  # no batch was ever written
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return spark.createDataFrame([], schema)
