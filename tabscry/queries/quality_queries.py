"""Scan, plan and repair queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tabscry.functions.numeric import rounded
from tabscry.functions.temporal import parse_temporal, stamp as stamp_col
from tabscry.operators import repair as r
from tabscry.operators import scans as s
from tabscry.operators import sketches as sk
from tabscry.operators import typing_rules as t
from tabscry.plans import repair_plan as rp
from tabscry.sources import versions
from tabscry.plans.report import column_facts, quality_report
from tabscry.queries.profile import distribution_sql
from tabscry.queries.registry import BLANKED, events_blanked, query, rnd, stamp, table, union
from tabscry.queries.typing_queries import understood_sql
from tabscry.session import ensure_checkpoint_dir

c = F.col
EVENT_COLUMNS = ("event_id", "ts", "user_id", "event_type", "value", "props")


def shared_folder(spark) -> str:
    ensure_checkpoint_dir(spark)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def null_sql(source: str, columns) -> str:
    return union(
        [
            f"SELECT '{n}' AS column_name, count(*) AS total_count, count(*) - count({n}) AS null_count, {rnd(f'(count(*) - count({n})) / count(*)')} AS null_rate FROM {source}"
            for n in columns
        ]
    )


@query("scan_nulls", f"WITH {BLANKED} {null_sql('blanked', EVENT_COLUMNS)}")
def scan_nulls(spark, d):
    return s.scan_nulls(events_blanked(spark, d))


def conflict_sql(name: str, column: str, keys: str) -> str:
    return f"""SELECT '{column}' AS column_name, count(*) AS total_groups, count(*) FILTER (v > 1) AS conflict_groups,
        {rnd('count(*) FILTER (v > 1) / count(*)')} AS conflict_rate, max(v) AS max_distinct
        FROM (SELECT {keys}, count(DISTINCT {column}) AS v FROM {name} WHERE {column} IS NOT NULL GROUP BY {keys})"""


@query("scan_conflicts", union([conflict_sql("part", "p_brand", "p_name"), conflict_sql("lineitem", "l_quantity", "l_orderkey, l_linenumber")]))
def scan_conflicts(spark, d):
    return s.scan_conflicts(table(spark, d, "part"), "p_brand", ["p_name"]).unionByName(
        s.scan_conflicts(table(spark, d, "lineitem"), "l_quantity", ["l_orderkey", "l_linenumber"])
    )


LINE_GROUPS = "(SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY 1, 2 HAVING count(DISTINCT l_quantity) > 1)"


@query(
    "conflict_rows",
    f"SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem SEMI JOIN {LINE_GROUPS} USING (l_orderkey, l_linenumber)",
)
def conflict_rows(spark, d):
    line = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return s.conflict_rows(line, "l_quantity", ["l_orderkey", "l_linenumber"])


@query(
    "snapshot",
    f"""SELECT 'o_orderstatus' AS column_name, 'o_custkey' AS group_by, count(*) AS total_count, count(*) - count(o_orderstatus) AS null_count,
          {stamp('min(o_orderdate)')} AS min_time, {stamp('max(o_orderdate)')} AS max_time,
          (SELECT count(*) FROM orders SEMI JOIN (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderstatus) > 1) USING (o_custkey)) AS conflict_rows
        FROM orders""",
)
def snapshot(spark, d):
    return s.snapshot(table(spark, d, "orders"), "o_orderstatus", ["o_custkey"], "o_orderdate").drop("signature")


@query("snapshot_signature")
def snapshot_signature(spark, d):
    return s.snapshot(table(spark, d, "orders"), "o_orderstatus", ["o_custkey"], "o_orderdate").select("column_name", "signature")


@query(
    "plan_consistency",
    f"""WITH {BLANKED}, f AS (SELECT count(*) AS ft, count(*) - count(value) AS fn FROM blanked),
        p AS (SELECT count(*) AS st, count(*) - count(value) AS sn FROM blanked WHERE ts >= (SELECT max(ts) FROM blanked) - INTERVAL 10 DAY)
        SELECT 'value' AS column_name, ft AS full_total, st AS sample_total,
               concat_ws('|', CASE WHEN ft = 0 AND st > 0 THEN 'full_snapshot_missing' END, CASE WHEN ft <> st OR fn <> sn THEN 'snapshot_mismatch_nulls' END,
                 CASE WHEN fn = 0 AND sn > 0 THEN 'full_null_zero_sample_nonzero' END,
                 CASE WHEN ft > 0 AND st > 0 AND abs(ft - st) / greatest(ft, st) > 0.1 THEN 'total_count_mismatch' END) AS reasons,
               TRUE AS inconsistent FROM f, p""",
)
def plan_consistency(spark, d):
    from tabscry.operators.sampling import windowed

    blanked = events_blanked(spark, d)
    return s.plan_consistency(s.snapshot(blanked, "value"), s.snapshot(windowed(blanked, "ts", days=10), "value"))


@query("duplicate_keys", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_keys(spark, d):
    return s.duplicate_keys(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(
    "range_violations",
    f"""SELECT 'c_acctbal' AS column_name, count(*) FILTER (c_acctbal < 0) AS below, count(*) FILTER (c_acctbal > 9000) AS above,
          min(c_acctbal) AS worst_low, max(c_acctbal) AS worst_high FROM customer
        UNION ALL SELECT 'c_nationkey', 0, count(*) FILTER (c_nationkey > 20), min(c_nationkey), max(c_nationkey) FROM customer""",
)
def range_violations(spark, d):
    return s.range_violations(table(spark, d, "customer"), {"c_acctbal": (0, 9000), "c_nationkey": (None, 20)})


TEXT_TIME = """text_time AS (SELECT event_id, value, CASE
   WHEN event_id % 97 = 0 THEN 'not a time'
   WHEN event_id % 4 = 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S')
   WHEN event_id % 4 = 1 THEN strftime(ts, '%Y%m%d')
   WHEN event_id % 4 = 2 THEN CAST(CAST(floor(epoch(ts)) AS BIGINT) AS VARCHAR)
   ELSE CAST(epoch_us(ts) // 1000 AS VARCHAR) END AS time_text,
   CASE WHEN event_id % 13 = 0 THEN 'n/a' ELSE CAST(value AS VARCHAR) END AS value_text FROM events)"""


def events_text_time(spark, d):
    """events with its time in four spellings, some of it garbage, and numbers as text."""
    e, ts = c("event_id"), c("ts").cast("timestamp")
    text = (
        F.when(e % 97 == 0, "not a time")
        .when(e % 4 == 0, F.date_format(ts, "yyyy-MM-dd HH:mm:ss"))
        .when(e % 4 == 1, F.date_format(ts, "yyyyMMdd"))
        .when(e % 4 == 2, F.unix_timestamp(ts).cast("string"))
        .otherwise(F.unix_millis(ts).cast("string"))
    )
    number = F.when(e % 13 == 0, "n/a").otherwise(c("value").cast("string"))
    return table(spark, d, "events").select(e, "value", text.alias("time_text"), number.alias("value_text"))


@query(
    "parse_temporal",
    f"""WITH {TEXT_TIME} SELECT event_id, time_text, {stamp('''CASE
          WHEN regexp_matches(time_text, '^[0-9]{8}$') THEN try_strptime(time_text, '%Y%m%d')
          WHEN regexp_matches(time_text, '^[0-9]{13}$') THEN make_timestamp(TRY_CAST(time_text AS BIGINT) * 1000)
          WHEN regexp_matches(time_text, '^[0-9]{9,10}$') THEN make_timestamp(TRY_CAST(time_text AS BIGINT) * 1000000)
          ELSE TRY_CAST(time_text AS TIMESTAMP) END''')} AS parsed FROM text_time""",
)
def parse_temporal_(spark, d):
    return events_text_time(spark, d).select("event_id", "time_text", stamp_col(parse_temporal(c("time_text"))).alias("parsed"))


@query(
    "type_mismatch",
    f"""WITH {TEXT_TIME} SELECT 'value_text' AS column_name, 'number' AS expected, count(value_text) AS non_null_count,
          count(*) FILTER (TRY_CAST(value_text AS DOUBLE) IS NULL) AS invalid_count, {rnd('count(*) FILTER (TRY_CAST(value_text AS DOUBLE) IS NULL) / count(*)')} AS invalid_rate FROM text_time
        UNION ALL SELECT 'time_text', 'time', count(*), count(*) FILTER (time_text = 'not a time'), {rnd("count(*) FILTER (time_text = 'not a time') / count(*)")} FROM text_time""",
)
def type_mismatch(spark, d):
    return s.type_mismatch(events_text_time(spark, d), numbers=["value_text"], times=["time_text"])


@query(
    "rare_categories",
    f"""WITH k AS (SELECT l_suppkey AS category, count(*) AS n FROM lineitem GROUP BY 1), w AS (SELECT category, n, n / (SELECT sum(n) FROM k) AS share FROM k)
        SELECT category, n, {rnd('share')} AS share FROM w WHERE share < 0.01""",
)
def rare_categories(spark, d):
    return s.rare_categories(table(spark, d, "lineitem"), "l_suppkey")


@query(
    "merge_suggestions",
    """WITH v AS (SELECT CASE WHEN p_partkey % 5 = 0 THEN upper(p_name) WHEN p_partkey % 7 = 0 THEN '  ' || p_name || ' '
                              WHEN p_partkey % 11 = 0 THEN replace(p_name, ' ', '-') ELSE p_name END AS category FROM part),
       k AS (SELECT category, count(*) AS n, trim(regexp_replace(lower(category), '[^0-9a-z\\x{80}-\\x{10FFFF}]+', ' ', 'g')) AS merge_key FROM v GROUP BY 1),
       r AS (SELECT *, row_number() OVER (PARTITION BY merge_key ORDER BY n DESC, category) AS pos FROM k)
       SELECT merge_key, count(*) AS variants, max(category) FILTER (pos = 1) AS suggested, CAST(sum(n) AS BIGINT) AS rows
       FROM r GROUP BY 1 HAVING count(*) > 1""",
)
def merge_suggestions(spark, d):
    key = c("p_partkey")
    spelled = (
        F.when(key % 5 == 0, F.upper("p_name"))
        .when(key % 7 == 0, F.concat(F.lit("  "), "p_name", F.lit(" ")))
        .when(key % 11 == 0, F.replace("p_name", F.lit(" "), F.lit("-")))
        .otherwise(c("p_name"))
    )
    return s.merge_suggestions(table(spark, d, "part").select(spelled.alias("name")), "name")


@query(
    "zscore_outliers",
    f"""WITH f AS (SELECT avg(value) AS m, stddev_samp(value) AS sd FROM events)
        SELECT 'value' AS column_name, {rnd('m', 4)} AS mean_value, {rnd('sd', 4)} AS stddev_value,
               (SELECT count(*) FROM events WHERE abs(value - m) > 3 * sd) AS outlier_count FROM f""",
)
def zscore_outliers(spark, d):
    return s.zscore_outliers(table(spark, d, "events"), ["value"])


def graded(rows: str, total: str) -> str:
    share = rnd("affected_rows / total_rows")
    return f"""SELECT issue, column_name, affected_rows, {share} AS share,
        CASE WHEN {share} > 0.3 THEN 'high' WHEN {share} > 0.05 THEN 'medium' ELSE 'low' END AS severity
        FROM ({rows}), (SELECT count(*) AS total_rows FROM {total}) WHERE affected_rows > 0"""


def outlier_count_sql(source: str, col: str) -> str:
    return f"""SELECT 'outliers' AS issue, '{col}' AS column_name, (SELECT count(*) FROM {source},
        (SELECT quantile_cont({col}, 0.25) AS q1, quantile_cont({col}, 0.75) AS q3 FROM {source}) WHERE {col} < q1 - 1.5 * (q3 - q1) OR {col} > q3 + 1.5 * (q3 - q1)) AS affected_rows"""


@query(
    "quality_report",
    graded(
        union(
            [
                f"SELECT 'conflicting_values' AS issue, 'l_quantity' AS column_name, (SELECT count(*) FROM lineitem SEMI JOIN {LINE_GROUPS} USING (l_orderkey, l_linenumber)) AS affected_rows",
                "SELECT 'duplicate_keys', 'l_orderkey,l_linenumber', (SELECT CAST(sum(n) AS BIGINT) FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1))",
                outlier_count_sql("lineitem", "l_extendedprice"),
                "SELECT 'out_of_range', 'l_discount', (SELECT count(*) FROM lineitem WHERE l_discount > 0.08)",
                "SELECT 'rare_categories', 'l_suppkey', (SELECT CAST(sum(n) AS BIGINT) FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_suppkey) WHERE n / (SELECT count(*) FROM lineitem) < 0.01)",
            ]
        ),
        "lineitem",
    ),
)
def quality_report_(spark, d):
    return quality_report(
        table(spark, d, "lineitem"),
        conflicts=[("l_quantity", ["l_orderkey", "l_linenumber"])],
        keys=[["l_orderkey", "l_linenumber"]],
        outliers=["l_extendedprice"],
        bounds={"l_discount": (0, 0.08)},
        categories=["l_suppkey"],
    )


@query(
    "quality_report_blanked",
    f"""WITH {BLANKED} """
    + graded(
        union(
            [
                "SELECT 'null_values' AS issue, 'value' AS column_name, (SELECT count(*) FROM blanked WHERE value IS NULL) AS affected_rows",
                "SELECT 'null_values', 'event_type', (SELECT count(*) FROM blanked WHERE event_type IS NULL)",
                outlier_count_sql("blanked", "value"),
                "SELECT 'type_mismatch', 'props', (SELECT count(*) FROM blanked WHERE TRY_CAST(props AS DOUBLE) IS NULL)",
            ]
        ),
        "blanked",
    ),
)
def quality_report_blanked(spark, d):
    return quality_report(events_blanked(spark, d), outliers=["value"], numbers_as_text=["props"])


FACT_COLUMNS = ("l_quantity", "l_extendedprice", "l_discount")


@query(
    "column_facts",
    f"""WITH st AS ({distribution_sql('lineitem', FACT_COLUMNS)}),
        sh AS (SELECT *, CASE WHEN p50 - p10 > (p90 - p50) * 1.5 THEN 'left skewed' WHEN p90 - p50 > (p50 - p10) * 1.5 THEN 'right skewed' ELSE 'roughly symmetric' END AS shape FROM st),
        cf AS ({union([conflict_sql('lineitem', n, 'l_orderkey, l_linenumber') for n in FACT_COLUMNS])}),
        f AS (SELECT column_name, 1 AS weight, null_count || ' of ' || total_count || ' values are missing' AS fact FROM sh WHERE null_count > 0
          UNION ALL SELECT column_name, 2, conflict_groups || ' of ' || total_groups || ' groups hold more than one value' FROM cf WHERE conflict_groups > 0
          UNION ALL SELECT column_name, 3, 'shape is ' || shape FROM sh
          UNION ALL SELECT column_name, 4, 'values run from ' || round(min_value, 2) || ' to ' || round(max_value, 2) FROM sh
          UNION ALL SELECT column_name, 5, 'median is ' || round(p50, 2) FROM sh)
        SELECT column_name, CAST(fact_no AS INTEGER) AS fact_no, fact FROM
          (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY weight, fact) AS fact_no FROM f) WHERE fact_no <= 4""",
)
def column_facts_(spark, d):
    return column_facts(table(spark, d, "lineitem"), FACT_COLUMNS, ["l_orderkey", "l_linenumber"])


# Repairs


@query(
    "null_strategy",
    f"""SELECT column_name, semantic_type, CASE semantic_type WHEN 'numeric' THEN 'median_impute' WHEN 'temporal' THEN 'forward_fill'
          WHEN 'categorical' THEN 'mode_impute' WHEN 'text' THEN 'empty_string' ELSE 'manual_review' END AS null_strategy FROM {understood_sql('orders')}""",
)
def null_strategy(spark, d):
    return r.null_strategy(t.understand(table(spark, d, "orders"))).select("column_name", "semantic_type", "null_strategy")


def filled(spark, d, strategy: str, column: str = "value"):
    out = r.fill(events_blanked(spark, d), column, strategy).select("event_id", column)
    return out.withColumn(column, rounded(c(column))) if column == "value" else out


@query("fill_constant", f"WITH {BLANKED} SELECT event_id, coalesce(value, 0) AS value, coalesce(event_type, '') AS event_type FROM blanked")
def fill_constant(spark, d):
    blanked = events_blanked(spark, d)
    return r.fill(r.fill(blanked, "value", "zero"), "event_type", "empty").select("event_id", "value", "event_type")


@query("fill_mean", f"WITH {BLANKED} SELECT event_id, {rnd('coalesce(value, (SELECT avg(value) FROM blanked))')} AS value FROM blanked")
def fill_mean(spark, d):
    return filled(spark, d, "mean")


@query("fill_median", f"WITH {BLANKED} SELECT event_id, {rnd('coalesce(value, (SELECT quantile_cont(value, 0.5) FROM blanked))')} AS value FROM blanked")
def fill_median(spark, d):
    return filled(spark, d, "median")


@query(
    "fill_mode",
    f"""WITH {BLANKED} SELECT event_id, coalesce(event_type, (SELECT event_type FROM blanked WHERE event_type IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, event_type LIMIT 1)) AS event_type FROM blanked""",
)
def fill_mode(spark, d):
    return filled(spark, d, "mode", "event_type")


@query(
    "fill_min_max",
    f"""WITH {BLANKED} SELECT event_id, coalesce(value, (SELECT min(value) FROM blanked)) AS value, coalesce(event_type, (SELECT max(event_type) FROM blanked)) AS event_type FROM blanked""",
)
def fill_min_max(spark, d):
    return r.fill(r.fill(events_blanked(spark, d), "value", "min"), "event_type", "max").select("event_id", "value", "event_type")


FORWARD = """last_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""


@query("fill_forward", f"WITH {BLANKED} SELECT event_id, user_id, {FORWARD} AS value FROM blanked")
def fill_forward(spark, d):
    return r.fill_forward(events_blanked(spark, d), "value", ["ts", "event_id"], ["user_id"]).select("event_id", "user_id", "value")


@query(
    "fill_group_median",
    f"""WITH {BLANKED}, m AS (SELECT event_type, quantile_cont(value, 0.5) AS median FROM blanked WHERE event_type IS NOT NULL GROUP BY 1)
        SELECT event_id, blanked.event_type, {rnd('coalesce(value, median)')} AS value FROM blanked LEFT JOIN m ON blanked.event_type = m.event_type""",
)
def fill_group_median(spark, d):
    out = r.fill_group_median(events_blanked(spark, d), "value", ["event_type"]).select("event_id", "event_type", "value")
    return out.withColumn("value", rounded(c("value")))


@query(
    "segment_count",
    """SELECT p_partkey, CASE WHEN p_partkey % 9 <> 0 THEN greatest(len(string_split(replace(p_name, ' ', '||'), '||')), len(string_split(replace(p_brand, '#', '||'), '||'))) END AS segments
       FROM part""",
)
def segment_count(spark, d):
    part = table(spark, d, "part").select(
        "p_partkey",
        F.replace("p_name", F.lit(" "), F.lit("||")).alias("name_segment"),
        F.when(c("p_partkey") % 9 != 0, F.replace("p_brand", F.lit("#"), F.lit("||"))).alias("brand_segment"),
    )
    return part.select("p_partkey", r.segment_count(["name_segment", "brand_segment"]).cast("long").alias("segments"))


LINE_OUT = "l_orderkey, l_linenumber, l_partkey"


def conflict_fix_sql(agg: str) -> str:
    return f"""WITH g AS (SELECT l_orderkey, l_linenumber, {agg} AS target FROM lineitem GROUP BY 1, 2 HAVING count(DISTINCT l_quantity) > 1)
        SELECT {LINE_OUT}, {rnd('coalesce(target, l_quantity)')} AS l_quantity FROM lineitem LEFT JOIN g USING (l_orderkey, l_linenumber)"""


def conflict_fix(spark, d, strategy):
    line = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    out = r.repair_conflicts(line, "l_quantity", ["l_orderkey", "l_linenumber"], strategy)
    return out.withColumn("l_quantity", rounded(c("l_quantity")))


@query("repair_conflict_mean", conflict_fix_sql("avg(l_quantity)"))
def repair_conflict_mean(spark, d):
    return conflict_fix(spark, d, "mean")


@query("repair_conflict_median", conflict_fix_sql("quantile_cont(l_quantity, 0.5)"))
def repair_conflict_median(spark, d):
    return conflict_fix(spark, d, "median")


@query(
    "repair_conflict_mode",
    """WITH k AS (SELECT p_name, p_brand, count(*) AS n FROM part GROUP BY 1, 2),
       r AS (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY n DESC, p_brand) AS pos, count(*) OVER (PARTITION BY p_name) AS v FROM k)
       SELECT p_partkey, part.p_name, coalesce(r.p_brand, part.p_brand) AS p_brand FROM part LEFT JOIN r ON part.p_name = r.p_name AND pos = 1 AND v > 1""",
)
def repair_conflict_mode(spark, d):
    part = table(spark, d, "part").select("p_partkey", "p_name", "p_brand")
    return r.repair_conflicts(part, "p_brand", ["p_name"], "mode")


def impact_sql() -> str:
    return f"""WITH {BLANKED} SELECT 'null_repair' AS step, count(*) AS affected_rows FROM blanked WHERE value IS NULL
        UNION ALL SELECT 'conflict_repair', count(*) FROM blanked SEMI JOIN
          (SELECT user_id FROM blanked WHERE value IS NOT NULL GROUP BY 1 HAVING count(DISTINCT value) > 1) USING (user_id)"""


@query("repair_impact", impact_sql())
def repair_impact(spark, d):
    return r.repair_impact(events_blanked(spark, d), "value", ["user_id"])


@query("repair_dry_run", f"WITH {BLANKED} SELECT 'null_repair' AS step, count(*) AS affected_rows FROM blanked WHERE event_type IS NULL")
def repair_dry_run(spark, d):
    return r.repair_impact(events_blanked(spark, d), "event_type")


REQUEST = rp.RepairRequest(
    column="value", null_strategy="median", conflict_strategy="median_per_group", group_by=("user_id", "event_type"), time="ts",
    row_id="event_id", table_ref="events", order_by=("ts", "event_id"), entity=("user_id",),
)
PLAN_GROUPS = "(SELECT user_id, event_type, count(DISTINCT value) AS v FROM blanked WHERE value IS NOT NULL AND event_type IS NOT NULL GROUP BY 1, 2)"
PLAN = f"""{BLANKED}, a AS (SELECT count(*) AS total, count(*) - count(value) AS nulls, round(quantile_cont(value, 0.5), 4) AS med FROM blanked),
   g AS (SELECT count(*) FILTER (v > 1) AS groups FROM {PLAN_GROUPS}),
   cr AS (SELECT count(*) AS crows FROM blanked SEMI JOIN (SELECT user_id, event_type FROM {PLAN_GROUPS} WHERE v > 1) USING (user_id, event_type))"""


def shown(plan):
    """A plan for reading: the fill value to four decimals. The plan itself holds it exactly."""
    return plan.withColumn("fill_value", F.round(c("fill_value").cast("double"), 4).cast("string"))


@query(
    "repair_plan",
    f"""WITH {PLAN}, s AS (
          SELECT 1 AS step_no, 'null_repair' AS step, 'median_impute' AS strategy, nulls AS estimated_rows, CAST(NULL AS BIGINT) AS estimated_groups, CAST(med AS VARCHAR) AS fill_value FROM a
          UNION ALL SELECT 2, 'conflict_repair', 'median_per_group', crows, groups, NULL FROM g, cr)
        SELECT 'value' AS column_name, step_no, step, strategy, estimated_rows, estimated_groups, fill_value, total AS total_count, FALSE AS requires_manual_review, FALSE AS forbidden,
               TRUE AS apply_ready, 'fill ' || nulls || ' nulls by median_impute; settle ' || groups || ' groups by median_per_group' AS summary,
               'time_travel' AS rollback FROM s, a, g""",
)
def repair_plan(spark, d):
    plan = shown(rp.repair_plan(events_blanked(spark, d), REQUEST))
    return plan.select(
        "column_name", "step_no", "step", "strategy", "estimated_rows", "estimated_groups", "fill_value", "total_count",
        "requires_manual_review", "forbidden", "apply_ready", "summary", "rollback",
    )


@query(
    "repair_rationale",
    f"""WITH {PLAN} SELECT 'null_repair' AS step, 'Median of non-null values (robust to outliers).' AS reason, 'analysis_rows_non_null' AS basis,
          CAST(med AS VARCHAR) AS fill_value, FALSE AS requires_manual_default FROM a
        UNION ALL SELECT 'conflict_repair', 'Groups by user_id, event_type hold more than one value.', 'conflict_groups', NULL, FALSE FROM a""",
)
def repair_rationale(spark, d):
    return shown(rp.repair_plan(events_blanked(spark, d), REQUEST)).select("step", "reason", "basis", "fill_value", "requires_manual_default")


def plan_rows(spark, d):
    """Plans and approvals derived per user: matching, wrong, stale, missing, forbidden."""
    u = c("user_id")
    facts = table(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("last_id"))
    signature = F.concat(F.lit("s"), c("last_id").cast("string"))
    plans = facts.select(
        u,
        F.concat(F.lit("t"), (u % 10).cast("string")).alias("table_name"),
        F.when(u % 8 != 6, F.concat(F.lit("p"), u.cast("string"))).alias("plan_id"),
        F.concat(F.lit("h"), c("n").cast("string")).alias("plan_hash"),
        signature.alias("signature"),
        F.when(u % 8 == 3, F.lit("changed")).otherwise(signature).alias("current_signature"),
        (u % 8 == 4).alias("forbidden"),
        F.when(u % 8 != 7, F.lit("events")).alias("table_ref"),
    )
    approvals = facts.filter(u % 8 != 5).select(
        u,
        F.lit(True).alias("approved"),
        F.concat(F.lit("p"), u.cast("string")).alias("approved_plan_id"),
        F.when(u % 8 == 1, F.lit("wrong")).otherwise(F.concat(F.lit("h"), c("n").cast("string"))).alias("approved_plan_hash"),
        F.when(u % 8 != 2, signature).alias("approved_signature"),
    )
    return rp.check_approvals(plans, approvals, ["user_id"])


STATUS = """(SELECT DISTINCT user_id, 't' || (user_id % 10) AS table_name, CASE user_id % 8 WHEN 0 THEN 'approved' WHEN 1 THEN 'approval_plan_mismatch' WHEN 2 THEN 'approval_missing_plan_info'
   WHEN 3 THEN 'snapshot_mismatch' WHEN 4 THEN 'plan_inconsistent' WHEN 5 THEN 'approval_required' WHEN 6 THEN 'plan_missing' ELSE 'table_ref_missing' END AS status FROM events)"""


@query("plan_approval", f"SELECT user_id, status FROM {STATUS}")
def plan_approval(spark, d):
    return plan_rows(spark, d).select("user_id", "status")


@query("approved_plans", f"SELECT table_name, count(*) AS plans, count(*) FILTER (status = 'approved') AS approved_plans FROM {STATUS} GROUP BY 1")
def approved_plans(spark, d):
    return rp.approved_plans(plan_rows(spark, d), "table_name")


FORWARD_REQUEST = rp.RepairRequest(
    column="value", null_strategy="forward_fill", order_by=("ts", "event_id"), entity=("user_id",), row_id="event_id", table_ref="events"
)


def approvals_of(plan):
    """An approval that fits the plan, as a reviewer would store it."""
    named = [c(x).alias(f"approved_{x}") for x in ("plan_id", "plan_hash", "signature")]
    return plan.select("column_name", F.lit(True).alias("approved"), *named).distinct()


def applied(spark, d, request, name):
    """Plan, approve and apply to a copy; the paths of the new table and its stored audit."""
    source = events_blanked(spark, d)
    plan = rp.repair_plan(source, request)
    root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    return rp.apply_to_copy(source, request, f"{root}/table", plan, approvals_of(plan), f"{root}/audit"), f"{root}/audit"


@query("repaired_table", f"WITH {BLANKED} SELECT event_id, user_id, event_type, props, {FORWARD} AS value FROM blanked")
def repaired_table(spark, d):
    """Apply to a copy: written to a new place in the shared folder, then read back."""
    path, _ = applied(spark, d, FORWARD_REQUEST, "repaired")
    return spark.read.parquet(path).select("event_id", "user_id", "event_type", "props", "value")


@query(
    "repaired_source",
    f"""WITH {BLANKED}, f AS (SELECT event_id, {rnd('coalesce(value, (SELECT round(quantile_cont(value, 0.5), 4) FROM blanked))')} AS value FROM blanked)
        SELECT event_id, value FROM f""",
)
def repaired_source(spark, d):
    """Apply to the source behind a view after approval: new version, then re-pointed."""
    view = f"events_source_{uuid.uuid4().hex[:8]}"
    events_blanked(spark, d).createOrReplaceTempView(view)
    request = rp.RepairRequest(column="value", null_strategy="median", row_id="event_id", table_ref=view)
    plan = rp.repair_plan(spark.table(view), request)
    root = f"{shared_folder(spark)}/{view}"
    rp.apply_to_source(spark, view, request, root, plan, approvals_of(plan), f"{root}-audit")
    return spark.table(view).select("event_id", rounded(c("value")).alias("value"))


@query(
    "repaired_files",
    f"""WITH {BLANKED}, f AS (SELECT event_id, {FORWARD} AS value FROM blanked)
        SELECT event_id, value FROM f""",
)
def repaired_files(spark, d):
    """Apply to a table of files: only files with changed rows are rewritten."""
    root = f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"
    events_blanked(spark, d).write.parquet(f"{root}/source")
    versions.start(spark, root, f"{root}/source")
    plan = rp.repair_plan(versions.read(spark, root), FORWARD_REQUEST)
    rp.apply_to_files(spark, root, FORWARD_REQUEST, plan, approvals_of(plan), f"{root}/audit")
    return versions.read(spark, root).select("event_id", "value")


@query(
    "repair_audit",
    f"""WITH {BLANKED}, f AS (SELECT event_id, value AS old, {FORWARD} AS new FROM blanked)
        SELECT 'value' AS column_name, 'null_repair' AS repair_type, CAST(event_id AS VARCHAR) AS row_id, CAST(old AS VARCHAR) AS before, CAST(new AS VARCHAR) AS after
        FROM f WHERE old IS DISTINCT FROM new""",
)
def repair_audit(spark, d):
    """The stored audit rows of an approved apply."""
    _, audit = applied(spark, d, FORWARD_REQUEST, "audited")
    return spark.read.parquet(audit).select("column_name", "repair_type", "row_id", "before", "after")


@query("repair_rollback", f"WITH {BLANKED} SELECT event_id, value FROM blanked")
def repair_rollback(spark, d):
    """The repaired table taken back by its stored audit."""
    path, audit = applied(spark, d, FORWARD_REQUEST, "undone")
    return r.rollback(spark.read.parquet(path), spark.read.parquet(audit), "event_id", "value").select("event_id", "value")


HOLES = f"""{BLANKED}, holes AS (SELECT event_id, value, CASE WHEN event_id % 13 <> 0 THEN user_id END AS user_id,
   CASE WHEN event_id % 17 <> 0 THEN ts END AS ts FROM blanked)"""


def events_with_holes(spark, d):
    """Blanked events that also lack some users and some times."""
    rows = events_blanked(spark, d).withColumn("user_id", F.when(c("event_id") % 13 != 0, c("user_id")))
    return rows.withColumn("ts", F.when(c("event_id") % 17 != 0, c("ts")))


@query(
    "fill_forward_holes",
    f"""WITH {HOLES} SELECT event_id, user_id, CASE WHEN ts IS NULL THEN value ELSE
          last_value(value IGNORE NULLS) OVER (PARTITION BY user_id, ts IS NULL ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) END AS value FROM holes""",
)
def fill_forward_holes(spark, d):
    """Forward fill over null entities and times: no row is lost."""
    return r.fill_forward(events_with_holes(spark, d), "value", ["ts", "event_id"], ["user_id"]).select("event_id", "user_id", "value")


def sketch_drift_sql(column: str, numeric: bool) -> str:
    a, b = "lang = 'en'", "lang <> 'en'"
    shared = f"(SELECT count(*) FROM (SELECT {column} FROM documents WHERE {a} AND {column} IS NOT NULL INTERSECT SELECT {column} FROM documents WHERE {b}))"
    ends = [rnd(f"{f}({column}) FILTER ({b}) - {f}({column}) FILTER ({a})", 4) if numeric else "CAST(NULL AS DOUBLE)" for f in ("min", "max")]
    return f"""SELECT '{column}' AS column_name, count(*) FILTER ({b}) - count(*) FILTER ({a}) AS total_rows_delta,
        count(*) FILTER ({b} AND {column} IS NULL) - count(*) FILTER ({a} AND {column} IS NULL) AS null_count_delta,
        count(DISTINCT {column}) FILTER ({b}) - count(DISTINCT {column}) FILTER ({a}) AS unique_count_delta, {shared} AS shared_count,
        {ends[0]} AS min_value_delta, {ends[1]} AS max_value_delta FROM documents"""


@query("sketch_drift", union([sketch_drift_sql("source", False), sketch_drift_sql("n_chars", True)]))
def sketch_drift(spark, d):
    docs = table(spark, d, "documents")
    path = sk.store_sketches(docs, "lang", ["source", "n_chars"], f"{shared_folder(spark)}/sketches-{uuid.uuid4().hex}")
    stored = sk.stored_sketches(spark, path, "lang", docs.schema["lang"].dataType)
    return sk.sketch_drift(stored.filter("lang = 'en'"), stored.filter("lang <> 'en'"))
