"""Small helpers the training-data operators share."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tabscry.session import ensure_checkpoint_dir

ROWS_PER_BATCH = 512  # so that a batch of very long texts still fits a Python worker


def ascii_words(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased, as UTF-8."""
    return plain_words(text.lower() if text and text.isascii() else text, lower=True)


def plain_words(text: str | None, lower: bool = False) -> list[bytes]:
    """Words between the characters 0x20 and 0x09-0x0D, as UTF-8; null has none."""
    if not text:
        return []
    raw = text.encode("utf-8", "surrogatepass")
    return (raw.lower() if lower else raw).split()


def id_crc(column: Column) -> Column:
    """crc32 of an id written as text; null stays null."""
    return F.crc32(column.cast("string").cast("binary"))


def ship_code(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application."""
    sc = spark.sparkContext
    if not hasattr(sc, "_tabscry_shipped"):
        import tabscry

        root = os.path.dirname(os.path.dirname(os.path.abspath(tabscry.__file__)))
        if not root.endswith(".zip"):
            sc.addPyFile(shutil.make_archive(os.path.join(tempfile.mkdtemp(), "tabscry_code"), "zip", root, "tabscry"))
        sc._tabscry_shipped = True


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterable[dict]], schema: str) -> DataFrame:
    """mapInArrow for functions that yield dicts of lists in the order of ``schema``."""
    struct = T._parse_datatype_string(schema)
    arrow = to_arrow_schema(struct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in fn(batches):
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)

    ship_code(df.sparkSession)
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_PER_BATCH))
    return df.mapInArrow(run, struct)


def map_batches(df: DataFrame, change: Callable[[pa.RecordBatch], pa.RecordBatch]) -> DataFrame:
    """Change each Arrow batch; the schema stays."""
    ship_code(df.sparkSession)
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_PER_BATCH))
    return df.mapInArrow(lambda batches: map(change, batches), df.schema)


def shared_folder(spark: SparkSession) -> str:
    """A new folder name under the checkpoint folder that all executors share."""
    ensure_checkpoint_dir(spark)
    base = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return f"{base}/llm-{uuid.uuid4().hex}"


def written(df: DataFrame, **options: str) -> DataFrame:
    """Write the rows as a table in the shared folder and read them back: cuts lineage, survives lost executors."""
    path = shared_folder(df.sparkSession)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sample_by_id(df: DataFrame, rows: int, bound: int, share: Column | None = None, doc_id: str = "id", text: str = "text") -> DataFrame:
    """About ``bound`` of the ``rows`` rows of ``df``, the same ones on every run; all of them up to the bound.

    Rows are drawn by a hash of their id, rows without id by one of their text. Of the drawn rows with one id, or without id and
    with one text, the smallest stays, so neither a repeated id nor missing ids exceed the bound. ``share`` may raise the drawn
    share of some rows.
    """
    if rows <= bound:
        return df
    part = F.lit(bound / rows) if share is None else F.greatest(share, F.lit(bound / rows))
    own = F.when(F.col(doc_id).isNull(), F.xxhash64(text))
    drawn = df.filter(F.pmod(F.coalesce(own, F.xxhash64(doc_id)), F.lit(1 << 30)) < part * (1 << 30))
    one = drawn.groupBy(F.col(doc_id).alias("_of"), own.alias("_own")).agg(F.min(F.struct(*df.columns)).alias("_row"))
    return one.select("_row.*")


def prefilter_joins(spark: SparkSession) -> None:
    """Let Spark send a Bloom filter of a join's small side to the scan of its large side, at any table size.

    The filter's size is fixed (2 MB), so it is bounded however large the tables are; a full one lets more rows pass, never
    fewer. Spark builds it from a side that has a filter of its own over a scan.
    """
    prefix = "spark.sql.optimizer.runtime.bloomFilter."
    for key, value in {"applicationSideScanSizeThreshold": "1b", "creationSideThreshold": "1t", "numBits": "16777216", "expectedNumItems": "2000000"}.items():
        spark.conf.set(prefix + key, value)
