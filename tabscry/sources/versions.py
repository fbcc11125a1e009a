"""A table as a list of files per version, so that a change rewrites only the files that hold changed rows.

``<root>/manifests/v=<number>`` lists the files of a version; data files are never overwritten or moved. A new version keeps the
untouched files of the one before it and adds new ones; going back means reading an older list.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "path string"


def _manifest(spark: SparkSession, root: str, version: int, files: Sequence[str]) -> int:
    """Written under its number; a second writer of the same number fails."""
    rows = spark.createDataFrame([(f,) for f in files], MANIFEST).coalesce(1)
    rows.write.mode("errorifexists").parquet(f"{root.rstrip('/')}/manifests/v={version}")
    return version


def start(spark: SparkSession, root: str, path: str) -> int:
    """Version 0 of the table: the Parquet files at ``path``, where they are."""
    return _manifest(spark, root, 0, spark.read.parquet(path).inputFiles())


def versions(spark: SparkSession, root: str) -> DataFrame:
    """(v, path): the files of all versions."""
    return spark.read.schema(f"{MANIFEST}, v int").parquet(f"{root.rstrip('/')}/manifests")


def newest(spark: SparkSession, root: str) -> int:
    return versions(spark, root).agg(F.max("v")).first()[0]


def files_of(spark: SparkSession, root: str, version: int | None = None) -> list[str]:
    """The files of a version, the newest unless named."""
    version = newest(spark, root) if version is None else version
    return sorted(r["path"] for r in versions(spark, root).filter(F.col("v") == version).collect())


def read(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    files = files_of(spark, root, version)
    if not files:
        raise ValueError(f"no version {version} of {root}")
    return spark.read.parquet(*files)


def replace_files(spark: SparkSession, root: str, base: int, touched: Sequence[str], rows: DataFrame) -> int:
    """The version after ``base``: ``rows`` instead of the touched files; all other files stay as they are."""
    files = files_of(spark, root, base)
    unknown = set(touched) - set(files)
    if unknown:
        raise ValueError(f"not files of version {base}: {', '.join(sorted(unknown))}")
    if not touched:
        return base
    path = f"{root.rstrip('/')}/data/{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return _manifest(spark, root, base + 1, [*(f for f in files if f not in set(touched)), *spark.read.parquet(path).inputFiles()])


def restore(spark: SparkSession, root: str, version: int) -> int:
    """A new version with the files of an older one."""
    return _manifest(spark, root, newest(spark, root) + 1, files_of(spark, root, version))
