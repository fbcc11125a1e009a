"""Base relations, listings, previews, file ingest and publishing."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FILE_FORMATS = ("parquet", "orc", "json", "csv")


def relation(spark: SparkSession, source: str, file_format: str | None = None) -> DataFrame:
    """The full relation behind a path, a SELECT or a table name, still lazy."""
    text = source.strip()
    if text.lower().startswith(("select ", "with ")):
        return spark.sql(text.rstrip(";"))
    suffix = text.rsplit(".", 1)[-1].lower()
    if file_format or "/" in text:
        return spark.read.format(file_format or (suffix if suffix in FILE_FORMATS else "parquet")).load(text)
    return spark.table(text)


def table_inventory(relations: dict[str, DataFrame]) -> DataFrame:
    """Name and row count of each relation, sorted by name."""
    counts = [
        df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        for name, df in relations.items()
    ]
    out = counts[0]
    for other in counts[1:]:
        out = out.unionByName(other)
    return out.orderBy("table_name")


def catalog_inventory(spark: SparkSession, schema: str | None = None) -> DataFrame:
    """Row counts of the catalog's tables, of one schema when given."""
    names = [t for t in spark.catalog.listTables(schema) if not t.isTemporary]
    return table_inventory({".".join([*(t.namespace or []), t.name]): spark.table(".".join([*(t.namespace or []), t.name])) for t in names})


def row_json(df: DataFrame, name: str = "row_json") -> DataFrame:
    """Each row as a JSON object; null fields are left out."""
    return df.select(F.to_json(F.struct(*df.columns)).alias(name))


def ingest(
    spark: SparkSession, path: str, schema: T.StructType, file_format: str = "csv", **options: str
) -> DataFrame:
    """Read files with a declared schema; a bad record fails the job instead of turning NULL."""
    reader = spark.read.schema(schema).option("mode", "FAILFAST")
    if file_format == "csv":
        reader = reader.option("header", "true")
    return reader.options(**options).format(file_format).load(path)


def publish(df: DataFrame, path: str, file_format: str = "parquet", replace: bool = False, **options: str) -> str:
    """Write a relation; an existing target is kept unless ``replace`` is set."""
    df.write.mode("overwrite" if replace else "errorifexists").options(**options).format(file_format).save(path)
    return path


def version_path(root: str) -> str:
    """A new version folder below ``root``."""
    return f"{root.rstrip('/')}/v-{uuid.uuid4().hex}"


def publish_version(df: DataFrame, root: str, file_format: str = "parquet") -> str:
    """Write a new version folder below ``root``; the version read so far stays whole."""
    return publish(df, version_path(root), file_format)


def asset_page(
    assets: DataFrame,
    name: str,
    updated: str,
    page: int = 1,
    page_size: int = 10,
    contains: str | None = None,
    owner: tuple[str, object] | None = None,
    deleted: str | None = None,
) -> DataFrame:
    """One page of an asset listing, newest first, with the total beside each row.

    The total comes from its own aggregate and the page from a top-k over
    page * page_size rows, so no window spans the listing.
    """
    kept = assets
    if deleted:
        kept = kept.filter(~F.col(deleted))
    if contains:
        kept = kept.filter(F.col(name).ilike(f"%{contains}%"))
    if owner:
        kept = kept.filter(F.col(owner[0]) == owner[1])
    total = kept.agg(F.count(F.lit(1)).alias("total"))
    rows = kept.orderBy(F.desc(updated), F.asc(name)).offset((page - 1) * page_size).limit(page_size)
    return rows.join(F.broadcast(total), F.lit(True))


def upsert_metadata(
    stored: DataFrame, incoming: DataFrame, keys: Sequence[str], keep: str, overrides: str
) -> DataFrame:
    """Incoming rows replace stored ones except the ``keep`` field and non-null overrides.

    A stored ``keep`` value survives the replacement; an incoming override of
    NULL leaves the stored override in place. Rows on one side only stay.
    """
    s, i = stored.alias("s"), incoming.alias("i")
    same = F.lit(True)
    for k in keys:
        same = same & (F.col(f"s.{k}") == F.col(f"i.{k}"))
    arrived = F.col(f"i.{keys[0]}").isNotNull()
    out = [F.coalesce(f"i.{k}", f"s.{k}").alias(k) for k in keys]
    for c in stored.columns:
        if c in keys:
            continue
        if c == keep:
            out.append(F.coalesce(f"s.{c}", f"i.{c}").alias(c))
        elif c == overrides:
            out.append(F.coalesce(f"i.{c}", f"s.{c}").alias(c))
        else:
            out.append(F.when(arrived, F.col(f"i.{c}")).otherwise(F.col(f"s.{c}")).alias(c))
    return s.join(i, same, "full").select(*out)
