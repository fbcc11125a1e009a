"""Scans, listings and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabscry.operators import sampling
from tabscry.operators.profiling import row_count
from tabscry.queries.registry import TABLES, query, stamp, table, union
from tabscry.session import ensure_checkpoint_dir
from tabscry.sources import relation as rel


@query(
    "table_inventory",
    union([f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in sorted(TABLES)]),
)
def table_inventory(spark, d):
    return rel.table_inventory({t: table(spark, d, t) for t in TABLES})


@query(
    "preview_rows",
    "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 50",
)
def preview_rows(spark, d):
    return sampling.preview(
        table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"), ["o_orderkey"]
    )


@query("row_count", "SELECT count(*) AS row_count FROM lineitem")
def row_count_(spark, d):
    return row_count(table(spark, d, "lineitem"))


@query(
    "row_json",
    """SELECT '{"r_regionkey":' || r_regionkey || CASE WHEN r_regionkey % 2 = 0 THEN '' ELSE ',"r_name":"' || r_name || '"' END || '}'
       AS row_json FROM region""",
)
def row_json(spark, d):
    region = table(spark, d, "region")
    return rel.row_json(region.withColumn("r_name", F.when(F.col("r_regionkey") % 2 != 0, F.col("r_name"))))


@query("ingest_roundtrip", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def ingest_roundtrip(spark, d):
    """Publish a relation as CSV with replace, read it back with its schema."""
    nation = table(spark, d, "nation")
    ensure_checkpoint_dir(spark)
    shared = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    path = rel.publish(nation, f"{shared}/ingest_roundtrip", "csv", replace=True, header="true")
    return rel.ingest(spark, path, nation.schema, "csv")


@query(
    "asset_page",
    """WITH kept AS (SELECT * FROM customer WHERE c_name ILIKE '%customer%' AND c_mktsegment = 'BUILDING')
       SELECT c_custkey, c_name, (SELECT count(*) FROM kept) AS total
       FROM kept ORDER BY c_custkey DESC, c_name LIMIT 10 OFFSET 10""",
)
def asset_page(spark, d):
    return rel.asset_page(
        table(spark, d, "customer"),
        "c_name",
        "c_custkey",
        page=2,
        page_size=10,
        contains="customer",
        owner=("c_mktsegment", "BUILDING"),
    ).select("c_custkey", "c_name", "total")


@query(
    "metadata_upsert",
    """WITH stored AS (
         SELECT p_partkey, p_brand AS semantic_type, CASE WHEN p_partkey % 2 = 0 THEN p_type END AS analysis,
                CASE WHEN p_partkey % 5 = 0 THEN p_name END AS overrides FROM part),
       incoming AS (
         SELECT p_partkey, 'new ' || p_brand AS semantic_type, 'fresh' AS analysis,
                CASE WHEN p_partkey % 2 = 0 THEN 'override' END AS overrides FROM part WHERE p_partkey % 3 = 0
         UNION ALL
         SELECT -p_partkey - 1, 'added', 'fresh', NULL FROM part WHERE p_partkey % 100 = 0)
       SELECT coalesce(i.p_partkey, s.p_partkey) AS p_partkey,
              CASE WHEN i.p_partkey IS NOT NULL THEN i.semantic_type ELSE s.semantic_type END AS semantic_type,
              coalesce(s.analysis, i.analysis) AS analysis,
              coalesce(i.overrides, s.overrides) AS overrides
       FROM stored s FULL JOIN incoming i ON s.p_partkey = i.p_partkey""",
)
def metadata_upsert(spark, d):
    part, key = table(spark, d, "part"), F.col("p_partkey")
    stored = part.select(
        key,
        F.col("p_brand").alias("semantic_type"),
        F.when(key % 2 == 0, F.col("p_type")).alias("analysis"),
        F.when(key % 5 == 0, F.col("p_name")).alias("overrides"),
    )
    changed = part.filter(key % 3 == 0).select(
        key,
        F.concat(F.lit("new "), "p_brand").alias("semantic_type"),
        F.lit("fresh").alias("analysis"),
        F.when(key % 2 == 0, F.lit("override")).alias("overrides"),
    )
    added = part.filter(key % 100 == 0).select(
        (-key - 1).alias("p_partkey"),
        F.lit("added").alias("semantic_type"),
        F.lit("fresh").alias("analysis"),
        F.lit(None).cast("string").alias("overrides"),
    )
    return rel.upsert_metadata(stored, changed.unionByName(added), ["p_partkey"], "analysis", "overrides")


@query(
    "windowed_base",
    f"""SELECT event_id, {stamp('ts')} AS ts_text, user_id, value FROM events
        WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY ORDER BY ts, event_id LIMIT 1000""",
)
def windowed_base(spark, d):
    base = sampling.windowed(table(spark, d, "events"), "ts", days=7, n=1000, order_by=["ts", "event_id"])
    return base.select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts_text"), "user_id", "value")


@query(
    "sampling_choice",
    """SELECT count(*) AS row_count,
              CASE WHEN count(*) <= 1000 THEN 'full_scan' WHEN count(*) > 1000000 THEN 'systematic' ELSE 'random' END AS strategy,
              least(count(*), 1000) AS sample_size,
              CASE WHEN count(*) > 1000000 THEN count(*) // 1000 END AS sample_every_n
       FROM lineitem""",
)
def sampling_choice(spark, d):
    return sampling.sampling_choice(table(spark, d, "lineitem"), has_time=False)


@query(
    "sample_head_mid_tail",
    """WITH r AS (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS position,
                         count(*) OVER () AS n FROM events)
       SELECT event_id, position, 'head' AS part FROM r WHERE position <= 333
       UNION ALL SELECT event_id, position, 'middle' FROM r
         WHERE position > (n - 333) // 2 AND position <= (n - 333) // 2 + 333
       UNION ALL SELECT event_id, position, 'tail' FROM r WHERE position > n - 333""",
)
def sample_head_mid_tail(spark, d):
    return sampling.head_middle_tail(table(spark, d, "events").select("ts", "event_id"), ["ts", "event_id"]).select(
        "event_id", "position", "part"
    )


@query(
    "sample_systematic",
    """WITH r AS (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS position FROM orders)
       SELECT * FROM r WHERE position % 15 = 0""",
)
def sample_systematic(spark, d):
    orders = table(spark, d, "orders").select("o_orderdate", "o_orderkey", "o_totalprice")
    return sampling.systematic(orders, ["o_orderdate", "o_orderkey"], every=15).drop("o_orderdate")


@query("sample_random")
def sample_random(spark, d):
    return sampling.random_rows(
        table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity"),
        ["l_orderkey", "l_linenumber", "l_partkey"],
        1000,
    )


@query(
    "sample_panel",
    """WITH e AS (SELECT DISTINCT user_id FROM events ORDER BY user_id LIMIT 20),
       r AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS entity_row
             FROM events WHERE user_id IN (SELECT user_id FROM e))
       SELECT event_id, user_id, CAST(entity_row AS INTEGER) AS entity_row FROM r WHERE entity_row <= 6""",
)
def sample_panel(spark, d):
    events = table(spark, d, "events").select("event_id", "user_id", "ts")
    return sampling.panel(events, "user_id", ["ts", "event_id"], 120, by_hash=False).drop("ts")


@query(
    "sample_time_head",
    f"SELECT event_id, {stamp('ts')} AS ts_text, value FROM events ORDER BY ts, event_id LIMIT 50",
)
def sample_time_head(spark, d):
    return sampling.time_head(table(spark, d, "events"), "ts", 50, ["event_id"]).select(
        "event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts_text"), "value"
    )


@query("sample_stratified")
def sample_stratified(spark, d):
    return sampling.stratified(table(spark, d, "events"), "event_type", ["event_id"], 100).select(
        "event_id", "event_type", "value"
    )


@query(
    "column_examples",
    """WITH num AS (
         SELECT 'p_partkey' AS column_name, CAST(p_partkey AS DOUBLE) AS v FROM part
         UNION ALL SELECT 'p_size', p_size FROM part UNION ALL SELECT 'p_retailprice', p_retailprice FROM part),
       ns AS (SELECT column_name, round(min(v), 2) AS lo, round(max(v), 2) AS hi, round(quantile_cont(v, 0.5), 2) AS mid
              FROM num GROUP BY 1),
       txt AS (
         SELECT 'p_name' AS column_name, p_name AS v, p_partkey AS k FROM part
         UNION ALL SELECT 'p_brand', p_brand, p_partkey FROM part UNION ALL SELECT 'p_type', p_type, p_partkey FROM part),
       seen AS (SELECT column_name, v, count(*) AS n, min(k) AS k FROM txt GROUP BY 1, 2),
       rk AS (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY n DESC, v) AS a,
                        row_number() OVER (PARTITION BY column_name ORDER BY k, v) AS b FROM seen),
       picked AS (SELECT column_name, v, min(r) AS r FROM (
           SELECT column_name, v, a AS r FROM rk WHERE a <= 3 UNION ALL SELECT column_name, v, b + 3 FROM rk WHERE b <= 5)
         GROUP BY 1, 2),
       five AS (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY r) AS o FROM picked)
       SELECT column_name, lo || '|' || hi || CASE WHEN mid IN (lo, hi) THEN '' ELSE '|' || mid END AS examples FROM ns
       UNION ALL SELECT column_name, string_agg(v, '|' ORDER BY o) FROM five WHERE o <= 5 GROUP BY 1""",
)
def column_examples(spark, d):
    return sampling.column_examples(table(spark, d, "part"), ["p_partkey"])


@query(
    "column_samples",
    union(
        [
            f"""SELECT * FROM (SELECT '{c}' AS column_name, CAST(row_number() OVER (ORDER BY c_custkey) AS INTEGER) AS value_no,
                CAST({c} AS VARCHAR) AS value FROM customer WHERE {c} IS NOT NULL) WHERE value_no <= 10"""
            for c in ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
        ]
    ),
)
def column_samples(spark, d):
    customer = table(spark, d, "customer")
    return sampling.first_values(customer, customer.columns, ["c_custkey"])
