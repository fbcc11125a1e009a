"""JSON replies read without a given schema.

The schema is the common type of all values of the column, found in one
aggregation over variants; the rows are then read with it in one pass. Text
that is no JSON is kept beside the result, never dropped.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_FIELDS = 1000

c = F.col


def as_ddl(found: str) -> str:
    """A variant schema as a column type; a field that is always null reads as text."""
    parts = re.split(r"(`(?:[^`]|``)*`)", found)
    parts[::2] = [re.sub(r"\bVOID\b", "STRING", re.sub(r"\bOBJECT<", "STRUCT<", p)) for p in parts[::2]]
    return "".join(parts)


def reply_type(df: DataFrame, column: str, max_fields: int = MAX_FIELDS) -> str:
    """The common type of all JSON values of a column.

    Values that do not agree on a field's type leave that field a VARIANT. An
    empty column, or one of nulls and broken text, reads as STRING. Objects
    whose keys are data would make a type as wide as the table: above
    ``max_fields`` top-level keys (a sketch's count) the column is refused.
    """
    keys = df.select(F.explode(F.json_object_keys(column)).alias("k")).agg(F.approx_count_distinct("k")).first()[0]
    if keys > max_fields:
        raise ValueError(f"{column} holds about {keys} different keys, above {max_fields}; read it as a map")
    found = df.agg(F.schema_of_variant_agg(F.try_parse_json(c(column)))).first()[0]
    return as_ddl(found or "VOID")


def read_replies(df: DataFrame, column: str, kind: str | None = None, name: str = "reply", bad: str = "bad_reply") -> DataFrame:
    """The column as typed values under ``name``, broken text under ``bad``.

    ``kind`` is a type from ``reply_type`` or a caller's own; without one it is
    found first. A field that is missing, or does not fit its type, is null; a
    null text is null in both.
    """
    kind = kind or reply_type(df, column)
    value = F.try_parse_json(c(column))
    typed = value if kind == "VARIANT" else F.try_variant_get(value, "$", kind)
    return df.withColumn(name, typed).withColumn(bad, F.when(value.isNull(), c(column)))
