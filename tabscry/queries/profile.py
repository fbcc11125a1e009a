"""Profiling queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabscry.operators import profiling as p
from tabscry.queries.registry import BLANKED, events_blanked, query, rnd, table, union

ORDERS = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
LINE_NUMBERS = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
CUSTOMER = ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
CUSTOMER_NUMBERS = ("c_custkey", "c_nationkey", "c_acctbal")


@query(
    "table_profile",
    """SELECT (SELECT count(*) FROM lineitem) AS row_count,
              (SELECT count(*) FROM (SELECT DISTINCT * FROM lineitem)) AS unique_rows,
              CAST(11 AS BIGINT) AS column_count""",
)
def table_profile(spark, d):
    return p.table_profile(table(spark, d, "lineitem"))


def profile_sql(name: str, columns, where: str = "") -> str:
    return union(
        [
            f"""SELECT '{c}' AS column_name, count(*) AS total_count, count({c}) AS non_null_count,
                       count(DISTINCT {c}) AS distinct_count,
                       {rnd(f"(count(*) - count({c})) / nullif(count(*), 0)")} AS null_rate,
                       {rnd(f"count(DISTINCT {c}) / nullif(count(*), 0)")} AS cardinality
                FROM {name} {where}"""
            for c in columns
        ]
    )


@query("column_profile", profile_sql("orders", ORDERS))
def column_profile(spark, d):
    return p.column_profile(table(spark, d, "orders"))


@query(
    "numeric_stats",
    union(
        [
            f"""SELECT '{c}' AS column_name, {rnd(f'min({c})', 4)} AS min_value, {rnd(f'max({c})', 4)} AS max_value,
                       {rnd(f'avg({c})', 4)} AS mean_value, {rnd(f'quantile_cont({c}, 0.5)', 4)} AS median_value,
                       {rnd(f'stddev_samp({c})', 4)} AS stddev_value FROM lineitem"""
            for c in LINE_NUMBERS
        ]
    ),
)
def numeric_stats(spark, d):
    return p.numeric_stats(table(spark, d, "lineitem"))


@query(
    "wide_profile",
    union(
        [
            f"""SELECT '{c}' AS column_name, count(DISTINCT {c}) AS distinct_count, count(*) - count({c}) AS null_count, """
            + (
                ", ".join(
                    f"{rnd(e.format(c=c), 4)} AS {n}"
                    for n, e in {
                        "min_value": "min({c})",
                        "max_value": "max({c})",
                        "mean_value": "avg({c})",
                        "median_value": "quantile_cont({c}, 0.5)",
                    }.items()
                )
                if c in CUSTOMER_NUMBERS
                else ", ".join(f"CAST(NULL AS DOUBLE) AS {n}" for n in ("min_value", "max_value", "mean_value", "median_value"))
            )
            + " FROM customer"
            for c in CUSTOMER
        ]
    ),
)
def wide_profile(spark, d):
    return p.wide_profile(table(spark, d, "customer"))


@query(
    "basic_stats",
    """SELECT 'p_brand' AS column_name, count(*) AS total_count, count(DISTINCT p_brand) AS distinct_count,
              count(*) - count(p_brand) AS null_count FROM part""",
)
def basic_stats(spark, d):
    return p.basic_stats(table(spark, d, "part"), "p_brand")


def distribution_sql(name: str, columns, cte: str = "") -> str:
    return cte + union(
        [
            f"""SELECT '{c}' AS column_name, count(*) AS total_count, count(*) - count({c}) AS null_count,
                {rnd(f'min({c})', 4)} AS min_value, {rnd(f'max({c})', 4)} AS max_value, {rnd(f'avg({c})', 4)} AS mean_value,
                {rnd(f'stddev_samp({c})', 4)} AS stddev_value, {rnd(f'quantile_cont({c}, 0.1)', 4)} AS p10,
                {rnd(f'quantile_cont({c}, 0.5)', 4)} AS p50, {rnd(f'quantile_cont({c}, 0.9)', 4)} AS p90 FROM {name}"""
            for c in columns
        ]
    )


@query("distribution", distribution_sql("lineitem", LINE_NUMBERS))
def distribution(spark, d):
    return p.distribution(table(spark, d, "lineitem"))


@query(
    "distribution_shape",
    f"""WITH {BLANKED}, s AS ({distribution_sql('orders', ['o_totalprice'])}
        UNION ALL {distribution_sql('lineitem', ['l_quantity', 'l_extendedprice'])}
        UNION ALL {distribution_sql('blanked', ['value'])})
        SELECT column_name, p10, p50, p90, null_count,
               CASE WHEN p50 - p10 > (p90 - p50) * 1.5 THEN 'left_skewed'
                    WHEN p90 - p50 > (p50 - p10) * 1.5 THEN 'right_skewed' ELSE 'roughly_symmetric' END AS shape FROM s""",
)
def distribution_shape(spark, d):
    stats = (
        p.distribution(table(spark, d, "orders"), ["o_totalprice"])
        .unionByName(p.distribution(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice"]))
        .unionByName(p.distribution(events_blanked(spark, d), ["value"]))
    )
    return p.distribution_shape(stats).select("column_name", "p10", "p50", "p90", "null_count", "shape")


def corr_value(x: str, y: str) -> str:
    return rnd(f"CASE WHEN isnan(corr({x}, {y})) THEN NULL ELSE corr({x}, {y}) END")


def corr_group(c: str) -> str:
    return f"""CASE WHEN {c} IS NULL THEN 'unknown' WHEN {c} >= 0.3 THEN 'positive' WHEN {c} <= -0.3 THEN 'negative'
               WHEN abs({c}) <= 0.1 THEN 'weak' ELSE 'mixed' END"""


def corr_rows(target: str, others, source: str) -> str:
    return union(
        [f"SELECT '{c}' AS column_name, {corr_value(target, c)} AS correlation, count({target}) AS sample_count FROM {source}" for c in others]
    )


CORR_OTHERS = [c for c in LINE_NUMBERS if c != "l_extendedprice"]


@query(
    "correlations",
    f"SELECT *, {corr_group('correlation')} AS correlation_group FROM ({corr_rows('l_extendedprice', CORR_OTHERS, 'lineitem')})",
)
def correlations(spark, d):
    return p.correlations(table(spark, d, "lineitem"), "l_extendedprice")


@query(
    "correlation_agreement",
    f"""WITH a AS ({corr_rows('l_extendedprice', CORR_OTHERS, "(SELECT * FROM lineitem WHERE l_shipdate < TIMESTAMP '1998-01-01')")}),
        b AS ({corr_rows('l_extendedprice', CORR_OTHERS, "(SELECT * FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01')")})
        SELECT count(*) AS shared_columns,
               {rnd(f"avg(CASE WHEN {corr_group('a.correlation')} = {corr_group('b.correlation')} THEN 1.0 ELSE 0.0 END)", 4)} AS agreement_rate
        FROM a JOIN b USING (column_name) WHERE a.correlation IS NOT NULL AND b.correlation IS NOT NULL""",
)
def correlation_agreement(spark, d):
    line = table(spark, d, "lineitem")
    split = F.lit("1998-01-01").cast("timestamp_ntz")
    early, late = line.filter(F.col("l_shipdate") < split), line.filter(F.col("l_shipdate") >= split)
    return p.correlation_agreement(p.correlations(early, "l_extendedprice"), p.correlations(late, "l_extendedprice"))


def lag_sql(source: str, grain: str, lags) -> str:
    cols = ", ".join(f"lag(value, {k}) OVER (ORDER BY bucket) AS lag_{k}" for k in lags)
    return f"""(WITH series AS (SELECT date_trunc('{grain}', ts) AS bucket, avg(value) AS value FROM {source}
                 WHERE ts IS NOT NULL AND value IS NOT NULL GROUP BY 1),
        lagged AS (SELECT value, {cols} FROM series)
        """ + union([f"SELECT {k} AS lag, {corr_value('value', f'lag_{k}')} AS correlation FROM lagged" for k in lags]) + ")"


def dominant_sql(lags: str) -> str:
    return f"""(SELECT lag AS dominant_period, correlation AS strength, coalesce(abs(correlation) >= 0.4, FALSE) AS detected
        FROM {lags} ORDER BY coalesce(abs(correlation), 0) DESC, lag LIMIT 1)"""


@query("periodicity", f"SELECT * FROM {lag_sql('events', 'hour', p.PERIODICITY_LAGS['hour'])}")
def periodicity(spark, d):
    return p.periodicity(table(spark, d, "events"), "ts", "value", "hour")


@query("periodicity_dominant", f"SELECT * FROM {dominant_sql(lag_sql('events', 'day', p.PERIODICITY_LAGS['day']))}")
def periodicity_dominant(spark, d):
    return p.dominant_period(p.periodicity(table(spark, d, "events"), "ts", "value", "day"))


@query(
    "periodicity_agreement",
    f"""WITH a AS {dominant_sql(lag_sql('events', 'hour', p.PERIODICITY_LAGS['hour']))},
        b AS {dominant_sql(lag_sql("(SELECT * FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 15 DAY)", 'hour', p.PERIODICITY_LAGS['hour']))}
        SELECT a.dominant_period AS primary_dominant_period, a.strength AS primary_strength, a.detected AS primary_detected,
               b.dominant_period AS secondary_dominant_period, b.strength AS secondary_strength, b.detected AS secondary_detected,
               a.dominant_period IS NOT DISTINCT FROM b.dominant_period AND a.detected = b.detected AS agreement
        FROM a, b""",
)
def periodicity_agreement(spark, d):
    from tabscry.operators.sampling import windowed

    events = table(spark, d, "events")
    rows = [p.dominant_period(p.periodicity(e, "ts", "value", "hour")) for e in (events, windowed(events, "ts", days=15))]
    return p.periodicity_agreement(*rows)


@query(
    "category_groups",
    f"""WITH c AS (SELECT p_type AS category, count(*) AS n FROM part WHERE p_type IS NOT NULL GROUP BY 1),
        h AS (SELECT * FROM c ORDER BY n DESC, category LIMIT 3)
        SELECT category, n AS category_count, CAST((SELECT sum(n) FROM c) - (SELECT sum(n) FROM h) AS BIGINT) AS tail_count,
               (SELECT count(*) FROM c) AS distinct_count,
               {rnd('(SELECT sum(n) FROM h) / (SELECT sum(n) FROM c)', 4)} AS coverage FROM h""",
)
def category_groups(spark, d):
    return p.category_groups(table(spark, d, "part"), "p_type", top_n=3)


@query(
    "iqr_outliers",
    f"""WITH s AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events),
        f AS (SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM s)
        SELECT 'value' AS column_name, {rnd('lo', 4)} AS lower_fence, {rnd('hi', 4)} AS upper_fence,
               (SELECT count(*) FROM events WHERE value < lo OR value > hi) AS outlier_count FROM f""",
)
def iqr_outliers(spark, d):
    return p.iqr_outliers(table(spark, d, "events"), ["value"])


@query(
    "text_length_stats",
    union(
        [
            f"""SELECT '{c}' AS column_name, {rnd(f'avg(length({c}))', 4)} AS avg_length, min(length({c})) AS min_length,
                max(length({c})) AS max_length, {rnd(f'var_pop(length({c}))', 2)} AS length_variance FROM documents"""
            for c in ("text", "source")
        ]
    ),
)
def text_length_stats(spark, d):
    return p.text_length_stats(table(spark, d, "documents"), ["text", "source"])


def share(cond: str) -> str:
    return rnd(f"avg(CASE WHEN {cond} THEN 1.0 ELSE 0.0 END)")


def pattern_sql(name: str, column: str, numeric: bool = False) -> str:
    text = f"CAST({column} AS VARCHAR)"
    bare = f"trim(regexp_replace(trim({text}), '[,$%()]', '', 'g'))"
    number = "TRUE" if numeric else f"regexp_matches(trim({text}), '{p.NUMBER_LIKE_PATTERN}') AND TRY_CAST({bare} AS DOUBLE) IS NOT NULL"
    return f"""SELECT '{column}' AS column_name, {share(f"regexp_matches({text}, '{p.DATETIME_PATTERN}')")} AS datetime_ratio,
        {share(f"regexp_matches({text}, '{p.ID_PATTERN}')")} AS id_ratio,
        {share(f"regexp_matches({text}, '{p.GEO_PATTERN}')")} AS geo_ratio, {share(number)} AS numeric_ratio
        FROM {name} WHERE {column} IS NOT NULL"""


@query(
    "pattern_ratios",
    union(
        [pattern_sql("documents", "text"), pattern_sql("documents", "lang"), pattern_sql("customer", "c_name"),
         pattern_sql("customer", "c_acctbal", True), pattern_sql("events", "ts"), pattern_sql("events", "props")]
    ),
)
def pattern_ratios(spark, d):
    return (
        p.pattern_ratios(table(spark, d, "documents"), ["text", "lang"])
        .unionByName(p.pattern_ratios(table(spark, d, "customer"), ["c_name", "c_acctbal"]))
        .unionByName(p.pattern_ratios(table(spark, d, "events"), ["ts", "props"]))
    )


def flag_sql(name: str, c: str) -> str:
    return f"""SELECT '{c}' AS column_name, bool_and({c} = floor({c})) AS all_integers, bool_and({c} >= 0) AS all_positive,
        bool_and({c} BETWEEN 0 AND 1) AS in_0_1, bool_and({c} BETWEEN 0 AND 100) AS in_0_100,
        coalesce((SELECT count(DISTINCT gap) = 1 FROM (SELECT {c} - lag({c}) OVER (ORDER BY {c}) AS gap FROM {name})), FALSE)
          AS equally_spaced FROM {name}"""


@query(
    "numeric_flags",
    union([flag_sql("lineitem", c) for c in LINE_NUMBERS] + [flag_sql("events", c) for c in ("event_id", "user_id", "value")]),
)
def numeric_flags(spark, d):
    return p.numeric_flags(table(spark, d, "lineitem")).unionByName(p.numeric_flags(table(spark, d, "events")))


@query(
    "non_numeric_counts",
    union(
        [
            f"""SELECT '{c}' AS column_name, count({c}) AS non_null_count,
                count(*) FILTER ({c} IS NOT NULL AND TRY_CAST(CAST({c} AS VARCHAR) AS DOUBLE) IS NULL) AS non_numeric_count FROM {t}"""
            for t, c in (("events", "props"), ("events", "value"), ("customer", "c_name"), ("customer", "c_acctbal"))
        ]
    ),
)
def non_numeric_counts(spark, d):
    return p.non_numeric_counts(table(spark, d, "events"), ["props", "value"]).unionByName(
        p.non_numeric_counts(table(spark, d, "customer"), ["c_name", "c_acctbal"])
    )


def display_sql(c: str) -> str:
    stats = (
        f"{rnd(f'min({c})', 4)} AS min_value, {rnd(f'max({c})', 4)} AS max_value, {rnd(f'avg({c})', 4)} AS mean_value"
        if c in CUSTOMER_NUMBERS
        else "CAST(NULL AS DOUBLE) AS min_value, CAST(NULL AS DOUBLE) AS max_value, CAST(NULL AS DOUBLE) AS mean_value"
    )
    return f"""SELECT '{c}' AS column_name, {rnd(f'(count(*) - count({c})) * 100 / count(*)', 4)} AS null_pct,
        {rnd(f'count(DISTINCT {c}) * 100 / count(*)', 4)} AS unique_pct, {stats},
        (SELECT string_agg(v || '=' || n, '|' ORDER BY n DESC, v) FROM
           (SELECT CAST({c} AS VARCHAR) AS v, count(*) AS n FROM customer WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY n DESC, v LIMIT 5)) AS top_values
        FROM customer"""


@query("display_stats", union([display_sql(c) for c in CUSTOMER]))
def display_stats(spark, d):
    return p.display_stats(table(spark, d, "customer"))


@query(
    "column_importance",
    union(
        [
            f"""SELECT '{c}' AS column_name, {rnd(f'least(100.0, count(DISTINCT {c}) * 100 / count(*) + CASE WHEN count({c}) = count(*) THEN 20 ELSE 0 END)', 4)}
                AS importance FROM orders"""
            for c in ORDERS
        ]
    ),
)
def column_importance(spark, d):
    return p.column_importance(p.column_profile(table(spark, d, "orders")))


EVENT_COLUMNS = ("event_id", "ts", "user_id", "event_type", "value", "props")


@query(
    "null_traffic_light",
    f"""WITH {BLANKED}, f AS ("""
    + union(
        [f"SELECT '{c}' AS column_name, count(*) AS total, count(*) - count({c}) AS nulls, count(DISTINCT {c}) AS d FROM blanked" for c in EVENT_COLUMNS]
    )
    + """) SELECT column_name, nulls AS null_count,
            CASE WHEN nulls = 0 THEN 'ok' WHEN nulls * 100.0 / total <= 10 THEN 'warn' ELSE 'bad' END AS light,
            (SELECT count(*) FROM f WHERE nulls > 0) AS columns_with_nulls,
            (SELECT count(*) FROM f WHERE d = total) AS all_unique_columns FROM f""",
)
def null_traffic_light(spark, d):
    return p.null_traffic_light(p.column_profile(events_blanked(spark, d)))


def drift_sql(c: str, number: bool) -> str:
    early, late = "o_orderdate < TIMESTAMP '1998-01-01'", "o_orderdate >= TIMESTAMP '1998-01-01'"

    def gap(agg: str) -> str:
        return f"(SELECT {agg} FROM orders WHERE {late}) - (SELECT {agg} FROM orders WHERE {early})"

    low = rnd(gap(f"min({c})"), 4) if number else "CAST(NULL AS DOUBLE)"
    high = rnd(gap(f"max({c})"), 4) if number else "CAST(NULL AS DOUBLE)"
    return f"""SELECT '{c}' AS column_name, {gap('count(*)')} AS total_rows_delta, {gap(f'count(DISTINCT {c})')} AS unique_count_delta,
        {gap(f'count(*) - count({c})')} AS null_count_delta, {low} AS min_value_delta, {high} AS max_value_delta"""


DRIFT = {"o_orderkey": True, "o_custkey": True, "o_totalprice": True, "o_orderstatus": False, "o_orderpriority": False}


@query("profile_drift", union([drift_sql(c, n) for c, n in DRIFT.items()]))
def profile_drift(spark, d):
    orders = table(spark, d, "orders")
    split = F.lit("1998-01-01").cast("timestamp_ntz")
    early, late = orders.filter(F.col("o_orderdate") < split), orders.filter(F.col("o_orderdate") >= split)
    return p.profile_drift(p.drift_profile(early, list(DRIFT)), p.drift_profile(late, list(DRIFT)))
