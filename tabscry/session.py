"""Session set-up and the few session facts that steer an operator."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Below this plan size a value-to-count buffer of one group fits in any executor.
SMALL_INPUT_BYTES = 64 * 1024 * 1024
SPREAD_BYTES = 128 * 1024
# A side with at most this many bytes may be sent to every executor.
BROADCAST_BYTES = 32 * 1024 * 1024


# Session settings the operators are written for. HotSpot does not compile
# methods over 8000 bytes: wide aggregates run faster split than fused.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def build_session(app: str = "tabscry", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are written for.

    Master, memory and shuffle partitions come from the cluster unless given.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        **SETTINGS,
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    }
    settings.update({k.replace("__", "."): v for k, v in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def estimated_bytes(df: DataFrame) -> int | None:
    """Catalyst's size estimate of the optimized plan, without running a job."""
    try:
        plan = df._jdf.queryExecution().optimizedPlan()
    except AttributeError:  # no JVM at hand, as with a remote session
        return None
    return int(str(plan.stats().sizeInBytes()))


def is_small(df: DataFrame, limit: int = SMALL_INPUT_BYTES) -> bool:
    """True only when the plan is known to stay under ``limit`` bytes."""
    size = estimated_bytes(df)
    return size is not None and size <= limit


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast behind a size check; otherwise leave the choice to AQE."""
    return F.broadcast(df) if is_small(df, limit) else df


def spread(df: DataFrame) -> DataFrame:
    """Spread a small input over the cores, a piece of at least SPREAD_BYTES to each.

    A small file is often one row group, read by one task. Larger inputs have
    splits enough and are left as they are.
    """
    size = estimated_bytes(df)
    if size is None or size > SMALL_INPUT_BYTES:
        return df
    pieces = min(df.sparkSession.sparkContext.defaultParallelism, size // SPREAD_BYTES)
    return df.repartition(pieces) if pieces > 1 else df


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder named in ``spark.checkpoint.dir``.

    Only a local master without that setting gets a folder of its own.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tabscry-checkpoint-"))
    else:
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")


def cut(df: DataFrame) -> DataFrame:
    """Write the rows to the checkpoint folder and go on from there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
