"""Typing and structure queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabscry.functions import names
from tabscry.operators import profiling as p
from tabscry.operators import typing_rules as t
from tabscry.operators.running import order_breaks
from tabscry.queries.registry import query, rnd, table, union

SCHEMAS = {
    "orders": dict(o_orderkey="numeric", o_custkey="numeric", o_orderstatus="text", o_totalprice="numeric", o_orderdate="time", o_orderpriority="text"),
    "lineitem": dict(l_orderkey="numeric", l_partkey="numeric", l_suppkey="numeric", l_linenumber="numeric", l_quantity="numeric",
                     l_extendedprice="numeric", l_discount="numeric", l_tax="numeric", l_returnflag="text", l_linestatus="text", l_shipdate="time"),
    "customer": dict(c_custkey="numeric", c_name="text", c_nationkey="numeric", c_acctbal="numeric", c_mktsegment="text"),
    "part": dict(p_partkey="numeric", p_name="text", p_brand="text", p_type="text", p_size="numeric", p_retailprice="numeric"),
    "events": dict(event_id="numeric", ts="time", user_id="numeric", event_type="text", value="numeric", props="text"),
    "nation": dict(n_nationkey="numeric", n_name="text", n_regionkey="numeric"),
    "pages": dict(page_id="numeric", url="text", html="text"),
}


def share(cond: str) -> str:
    return f"avg(CASE WHEN {cond} THEN 1.0 ELSE 0.0 END)"


def evidence_sql(name: str) -> str:
    rows = []
    for i, (col, family) in enumerate(SCHEMAS[name].items()):
        text = f"CAST({col} AS VARCHAR)"
        zero = "0.0"
        ratios = dict(datetime_ratio=zero, id_ratio=zero, geo_ratio=zero, numeric_ratio=zero, image_ratio=zero, avg_length=zero,
                      all_integers="CAST(NULL AS BOOLEAN)", in_0_1="CAST(NULL AS BOOLEAN)")
        if family == "numeric":
            ratios.update(numeric_ratio="1.0", all_integers=f"bool_and({col} = floor({col}))", in_0_1=f"bool_and({col} BETWEEN 0 AND 1)")
        else:
            bare = f"trim(regexp_replace(trim({text}), '[,$%()]', '', 'g'))"
            ratios.update(
                datetime_ratio=share(f"regexp_matches({text}, '{p.DATETIME_PATTERN}')"),
                id_ratio=share(f"regexp_matches({text}, '{p.ID_PATTERN}')"),
                geo_ratio=share(f"regexp_matches({text}, '{p.GEO_PATTERN}')"),
                numeric_ratio=share(f"regexp_matches(trim({text}), '{p.NUMBER_LIKE_PATTERN}') AND TRY_CAST({bare} AS DOUBLE) IS NOT NULL"),
            )
        if family == "text":
            ratios.update(image_ratio=share(f"regexp_matches({text}, '{names.IMAGE_FILE_PATTERN}')"), avg_length=f"avg(length({col}))")
        cells = ", ".join(f"{e} AS {n}" for n, e in ratios.items())
        rows.append(
            f"""SELECT '{col}' AS column_name, {i} AS ordinal, '{family}' AS family, count(*) AS total_count,
                count(*) - count({col}) AS null_count, count(DISTINCT {col}) AS distinct_count, {cells} FROM {name}"""
        )
    hints = ", ".join(f"regexp_matches(lower(column_name), '{pat}') AS hint_{h}" for h, pat in names.HINT_PATTERNS.items())
    return f"""(SELECT *, null_count / total_count AS null_rate, distinct_count / total_count AS cardinality, {hints}
        FROM ({union(rows)}))"""


FINE = """CASE
  WHEN (hint_temporal AND NOT (family = 'text' AND datetime_ratio = 0)) OR datetime_ratio > 0.8 THEN 'datetime'
  WHEN hint_id OR id_ratio > 0.8 OR (cardinality > 0.95 AND distinct_count = total_count) THEN 'identifier'
  WHEN hint_geo OR geo_ratio > 0.8 THEN 'geospatial'
  WHEN distinct_count = 2 THEN 'binary'
  WHEN family = 'numeric' OR numeric_ratio >= 0.6 OR (numeric_ratio >= 0.4 AND (hint_count OR hint_ratio)) THEN
    CASE WHEN hint_ratio OR coalesce(in_0_1, FALSE) THEN 'ratio_percentage'
         WHEN coalesce(all_integers, FALSE) AND (hint_count OR cardinality < 0.1) THEN 'discrete_numeric'
         ELSE 'continuous_numeric' END
  WHEN cardinality < 0.05 OR distinct_count < 20 THEN
    CASE WHEN hint_categorical THEN 'ordinal_categorical' ELSE 'nominal_categorical' END
  WHEN family = 'text' THEN CASE WHEN avg_length > 100 THEN 'text_long' ELSE 'text_short' END
  ELSE 'unknown' END"""

CONF = f"""{rnd('''greatest(0.0, least(1.0, 0.5 - CASE WHEN null_rate > 0.5 THEN 0.2 ELSE 0.0 END + CASE
  WHEN fine_type = 'datetime' THEN CASE WHEN datetime_ratio > 0.9 THEN 0.4 ELSE 0 END + CASE WHEN hint_temporal THEN 0.1 ELSE 0 END
  WHEN fine_type = 'identifier' THEN CASE WHEN cardinality > 0.99 THEN 0.3 ELSE 0 END + CASE WHEN hint_id THEN 0.2 ELSE 0 END
  WHEN fine_type LIKE '%categorical' THEN CASE WHEN cardinality < 0.01 THEN 0.3 ELSE 0 END + CASE WHEN hint_categorical THEN 0.2 ELSE 0 END
  WHEN fine_type = 'binary' THEN 0.4 ELSE 0.0 END))''', 4)}"""

SEMANTIC = f"""CASE WHEN regexp_matches(lower(column_name), '{names.IMAGE_PATTERN}') OR image_ratio > 0.5 THEN 'image'
  WHEN fine_type = 'datetime' THEN 'temporal' WHEN fine_type = 'identifier' THEN 'id' WHEN fine_type = 'geospatial' THEN 'spatial'
  WHEN fine_type = 'binary' THEN 'binary' WHEN fine_type LIKE '%numeric' OR fine_type = 'ratio_percentage' THEN 'numeric'
  WHEN fine_type LIKE '%categorical' THEN 'categorical' WHEN fine_type LIKE 'text%' THEN 'text'
  WHEN family = 'time' THEN 'temporal' WHEN family IN ('numeric', 'text') THEN family ELSE 'unknown' END"""

ROLE = """CASE semantic_type WHEN 'numeric' THEN 'metric' WHEN 'temporal' THEN 'time' WHEN 'id' THEN 'id'
  WHEN 'unknown' THEN NULL ELSE 'dimension' END"""


def typed_sql(name: str) -> str:
    return f"(SELECT *, {CONF} AS confidence FROM (SELECT *, {FINE} AS fine_type FROM {evidence_sql(name)}))"


def understood_sql(name: str) -> str:
    return f"""(SELECT * EXCLUDE (confidence), {ROLE} AS role,
        CASE WHEN semantic_type = 'image' THEN greatest(confidence, 0.7) ELSE confidence END AS confidence
        FROM (SELECT *, {SEMANTIC} AS semantic_type FROM {typed_sql(name)}))"""


def either(names_: list[str], fn) -> str:
    return union([fn(n) for n in names_])


HINTS = [f"hint_{h}" for h in names.HINT_PATTERNS]


@query("name_hints", f"SELECT column_name, total_count, {', '.join(HINTS)} FROM {evidence_sql('orders')}")
def name_hints(spark, d):
    return t.name_hints(t.evidence(table(spark, d, "orders"))).select("column_name", "total_count", *HINTS)


@query(
    "column_types",
    either(["lineitem", "customer", "part", "events", "pages"], lambda n: f"SELECT '{n}' AS table_name, column_name, fine_type, distinct_count FROM {typed_sql(n)}"),
)
def column_types(spark, d):
    out = None
    for n in ("lineitem", "customer", "part", "events", "pages"):
        rows = t.column_types(t.name_hints(t.evidence(table(spark, d, n)))).select(
            F.lit(n).alias("table_name"), "column_name", "fine_type", "distinct_count"
        )
        out = rows if out is None else out.unionByName(rows)
    return out


@query("type_confidence", f"SELECT column_name, fine_type, confidence FROM {typed_sql('lineitem')}")
def type_confidence(spark, d):
    rows = t.type_confidence(t.column_types(t.name_hints(t.evidence(table(spark, d, "lineitem")))))
    return rows.select("column_name", "fine_type", "confidence")


def advice_sql() -> str:
    cases = "\n".join(
        "WHEN '" + fine + "' THEN '" + "|".join(texts).replace("'", "''") + "'" for fine, texts in t.ADVICE.items()
    )
    return f"SELECT column_name, CASE fine_type {cases} ELSE '' END AS recommendations FROM {typed_sql('customer')}"


@query("type_recommendations", advice_sql())
def type_recommendations(spark, d):
    rows = t.type_recommendations(t.column_types(t.name_hints(t.evidence(table(spark, d, "customer")))))
    return rows.select("column_name", F.array_join("recommendations", "|").alias("recommendations"))


@query("semantic_types", f"SELECT column_name, semantic_type, confidence FROM {understood_sql('part')}")
def semantic_types(spark, d):
    return t.understand(table(spark, d, "part")).select("column_name", "semantic_type", "confidence")


@query("column_roles", f"SELECT column_name, semantic_type, role FROM {understood_sql('orders')}")
def column_roles(spark, d):
    return t.understand(table(spark, d, "orders")).select("column_name", "semantic_type", "role")


def structure_sql(name: str) -> str:
    is_time = f"(column_name LIKE '%\\_at' ESCAPE '\\' OR regexp_matches(lower(column_name), '{names.HINT_PATTERNS['temporal']}') OR family = 'time')"
    is_entity = f"(regexp_matches(lower(column_name), '{names.ENTITY_PATTERN}') AND NOT {is_time} AND distinct_count < total_count)"
    return f"""SELECT '{name}' AS table_name, row_count, time_column, entity_column,
          CASE WHEN time_column IS NOT NULL AND entity_column IS NOT NULL THEN 'panel' WHEN time_column IS NOT NULL THEN 'time_series' ELSE 'iid' END AS structure_type,
          CASE WHEN time_column IS NOT NULL AND entity_column IS NOT NULL THEN 120 ELSE 50 END AS sample_size,
          CASE WHEN time_column IS NOT NULL AND entity_column IS NOT NULL THEN 'entity_time_stratified' WHEN time_column IS NOT NULL THEN 'time_window' ELSE 'random' END AS sampling_strategy
        FROM (SELECT max(total_count) AS row_count, arg_min(column_name, ordinal) FILTER ({is_time}) AS time_column,
                     arg_min(column_name, ordinal) FILTER ({is_entity}) AS entity_column FROM {evidence_sql(name)})"""


@query("table_structure", either(["events", "nation", "orders"], structure_sql))
def table_structure(spark, d):
    out = None
    for n in ("events", "nation", "orders"):
        row = t.table_structure(t.evidence(table(spark, d, n))).withColumn("table_name", F.lit(n))
        out = row if out is None else out.unionByName(row)
    return out


@query(
    "sorted_by_time",
    """SELECT count(*) AS n_rows, count(*) FILTER (ts < prev) AS breaks, count(*) FILTER (ts < prev) = 0 AS sorted_by_time,
              'panel' AS structure_type FROM (SELECT ts, lag(ts) OVER (ORDER BY event_id) AS prev FROM events)
       UNION ALL
       SELECT count(*), count(*) FILTER (v < prev), count(*) FILTER (v < prev) = 0,
              'time_series' FROM (SELECT o_orderdate AS v, lag(o_orderdate) OVER (ORDER BY o_orderkey) AS prev FROM orders)""",
)
def sorted_by_time(spark, d):
    events = order_breaks(table(spark, d, "events"), "ts", "event_id", slice_rows=1000)
    orders = order_breaks(table(spark, d, "orders"), "o_orderdate", "o_orderkey", slice_rows=1000)
    return t.sorted_structure(events, True, True).unionByName(t.sorted_structure(orders, True, False))


@query(
    "type_summary",
    f"""WITH e AS {typed_sql('lineitem')}, f AS (
          SELECT 'type:' || fine_type AS fact, column_name FROM e
          UNION ALL SELECT 'high_null', column_name FROM e WHERE null_rate > 0.3
          UNION ALL SELECT 'identifier', column_name FROM e WHERE fine_type = 'identifier'
          UNION ALL SELECT 'categorical', column_name FROM e WHERE fine_type LIKE '%categorical%'
          UNION ALL SELECT 'numeric', column_name FROM e WHERE fine_type LIKE '%numeric%'
          UNION ALL SELECT 'high_cardinality', column_name FROM e WHERE cardinality > 0.9
          UNION ALL SELECT 'low_cardinality', column_name FROM e WHERE cardinality > 0 AND cardinality < 0.05)
        SELECT fact, count(*) AS n_columns, string_agg(column_name, '|' ORDER BY column_name) AS columns FROM f GROUP BY fact""",
)
def type_summary(spark, d):
    return t.type_summary(t.column_types(t.name_hints(t.evidence(table(spark, d, "lineitem")))))


@query(
    "numeric_ranking",
    f"""SELECT column_name, {rnd('null_rate')} AS null_rate, confidence,
           CAST(row_number() OVER (ORDER BY null_rate, confidence DESC, lower(column_name)) AS INTEGER) AS rank
        FROM {understood_sql('lineitem')} WHERE semantic_type = 'numeric'""",
)
def numeric_ranking(spark, d):
    return t.numeric_ranking(t.understand(table(spark, d, "lineitem")))


@query(
    "categorical_candidates",
    f"""WITH e AS {understood_sql('orders')}
        SELECT 'categorical' AS kind, column_name, distinct_count, CAST(rank AS INTEGER) AS rank FROM
          (SELECT *, row_number() OVER (ORDER BY cardinality, ordinal) AS rank FROM e
           WHERE (semantic_type IN ('categorical', 'text') OR family = 'text') AND (distinct_count <= 50 OR cardinality <= 0.2)) WHERE rank <= 5
        UNION ALL SELECT 'temporal', column_name, distinct_count, CAST(row_number() OVER (ORDER BY ordinal) AS INTEGER) FROM e
           WHERE semantic_type = 'temporal' OR family = 'time' OR regexp_matches(lower(column_name), '(^|_)[a-z]*(date|time|timestamp|epoch)(_|$)')""",
)
def categorical_candidates(spark, d):
    return t.categorical_candidates(t.understand(table(spark, d, "orders")))


@query(
    "dims_and_metrics",
    f"""SELECT column_name, CASE WHEN family = 'numeric' THEN 'metric' ELSE 'dimension' END AS use,
          CASE family WHEN 'text' THEN 'categorical' WHEN 'time' THEN 'temporal' ELSE 'numeric' END AS kind
        FROM {evidence_sql('orders')} WHERE family <> 'text' OR cardinality < 0.1""",
)
def dims_and_metrics(spark, d):
    return t.dims_and_metrics(t.evidence(table(spark, d, "orders")))
