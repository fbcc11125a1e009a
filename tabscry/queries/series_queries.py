"""Chart series queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabscry.functions.numeric import rounded
from tabscry.operators import series as s
from tabscry.queries.registry import BLANKED, events_blanked, query, rnd, stamp, table, union

c = F.col


def y8(df):
    return s.stamped(df).withColumn("y", rounded(c("y"), 8))


HIST = """WITH m AS (SELECT min({c}) AS lo, max({c}) AS hi, greatest(20, least(60, CAST(floor(sqrt(count({c}))) AS BIGINT))) AS k FROM {t})
  SELECT {label}CAST(CASE WHEN {c} = hi THEN k + 1 ELSE floor(k * ({c} - lo) / (hi - lo)) + 1 END AS BIGINT) AS bin, count(*) AS n
  FROM {t}, m WHERE {c} IS NOT NULL AND lo < hi GROUP BY ALL"""


@query("histogram", HIST.format(c="l_extendedprice", t="lineitem", label=""))
def histogram(spark, d):
    return s.histogram(table(spark, d, "lineitem"), "l_extendedprice")


@query(
    "histogram_twelve_bins",
    """WITH m AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders)
       SELECT CAST(CASE WHEN o_totalprice = hi THEN 13 ELSE floor(12 * (o_totalprice - lo) / (hi - lo)) + 1 END AS BIGINT) AS bin,
              count(*) AS n FROM orders, m GROUP BY 1""",
)
def histogram_twelve_bins(spark, d):
    return s.histogram(table(spark, d, "orders"), "o_totalprice", bins=12)


@query(
    "time_series",
    union(
        [
            f"""SELECT '{g}' AS grain, {stamp(f"CAST(date_trunc('{g}', ts) AS TIMESTAMP)")} AS bucket, {rnd('avg(value)', 8)} AS y, count(*) AS n
                FROM events GROUP BY ALL"""
            for g in ("hour", "day", "week", "month")
        ]
    ),
)
def time_series(spark, d):
    events, out = table(spark, d, "events"), None
    for g in ("hour", "day", "week", "month"):
        part = y8(s.time_series(events, "ts", "value", g)).withColumn("grain", F.lit(g))
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "time_series_count",
    f"SELECT {stamp('CAST(date_trunc(' + chr(39) + 'day' + chr(39) + ', ts) AS TIMESTAMP)')} AS bucket, CAST(count(*) AS DOUBLE) AS y, count(*) AS n FROM events GROUP BY 1",
)
def time_series_count(spark, d):
    return y8(s.time_series(table(spark, d, "events"), "ts"))


def grain_points(g: str, level: int) -> str:
    b = "ts" if g == "raw" else f"CAST(date_trunc('{g}', ts) AS TIMESTAMP)"
    return f"SELECT event_type, {level} AS level, '{g}' AS grain, {b} AS bucket, avg(value) AS y FROM events GROUP BY ALL"


@query(
    "time_series_adaptive",
    f"""WITH p AS ({union([grain_points('month', 0), grain_points('hour', 1), grain_points('raw', 2)])}),
        z AS (SELECT event_type, level, count(*) AS points FROM p GROUP BY ALL),
        w AS (SELECT event_type, coalesce(min(level) FILTER (points > 1), min(level)) AS level FROM z GROUP BY 1)
        SELECT event_type, grain, {stamp('bucket')} AS bucket, {rnd('y', 8)} AS y FROM p JOIN w USING (event_type, level) JOIN z USING (event_type, level)
        WHERE points >= 3""",
)
def time_series_adaptive(spark, d):
    return y8(s.time_series_adaptive(table(spark, d, "events"), "ts", "value", "month", series=["event_type"]))


@query(
    "time_series_multi",
    f"""WITH j AS (SELECT o_orderdate, l_shipdate, l_quantity AS v FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
        SELECT 'o_orderdate' AS time_column, {stamp("CAST(date_trunc('month', o_orderdate) AS TIMESTAMP)")} AS bucket, {rnd('avg(v)', 8)} AS y, count(*) AS n FROM j GROUP BY ALL
        UNION ALL
        SELECT 'l_shipdate', {stamp("CAST(date_trunc('month', l_shipdate) AS TIMESTAMP)")}, {rnd('avg(v)', 8)}, count(*) FROM j GROUP BY ALL""",
)
def time_series_multi(spark, d):
    line = table(spark, d, "lineitem").select("l_orderkey", "l_shipdate", "l_quantity")
    orders = table(spark, d, "orders").select(c("o_orderkey").alias("l_orderkey"), "o_orderdate")
    return y8(s.time_series_multi(line.join(orders, "l_orderkey"), ["o_orderdate", "l_shipdate"], "l_quantity"))


@query(
    "category_mean",
    f"""SELECT 'l_returnflag' AS by_column, CAST(l_returnflag AS VARCHAR) AS category, {rnd('avg(l_extendedprice)', 4)} AS avg_value, count(*) AS n FROM lineitem GROUP BY ALL
        UNION ALL
        SELECT * FROM (SELECT 'l_suppkey', CAST(l_suppkey AS VARCHAR), {rnd('avg(l_extendedprice)', 4)}, count(*) AS n FROM lineitem
          GROUP BY l_suppkey ORDER BY n DESC, l_suppkey LIMIT 12)""",
)
def category_mean(spark, d):
    line, out = table(spark, d, "lineitem"), None
    for by in ("l_returnflag", "l_suppkey"):
        part = s.category_mean(line, by, "l_extendedprice").select(
            F.lit(by).alias("by_column"), c("category").cast("string").alias("category"), rounded(c("avg_value"), 4).alias("avg_value"), "n"
        )
        out = part if out is None else out.unionByName(part)
    return out


def top_sql(limit: int) -> str:
    return f"""(WITH k AS (SELECT p_brand AS category, count(*) AS n FROM part WHERE trim(p_brand) <> '' GROUP BY 1),
        h AS (SELECT * FROM k ORDER BY n DESC, category LIMIT {limit})
        SELECT * FROM h UNION ALL
        SELECT 'Other', CAST((SELECT sum(n) FROM k) - (SELECT sum(n) FROM h) AS BIGINT) WHERE (SELECT sum(n) FROM k) > (SELECT sum(n) FROM h))"""


@query("top_with_other", f"SELECT * FROM {top_sql(5)}")
def top_with_other(spark, d):
    return s.top_with_other(table(spark, d, "part"), "p_brand", 5)


@query("share_series", f"SELECT category, n, {rnd('n / sum(n) OVER ()')} AS share FROM {top_sql(8)}")
def share_series(spark, d):
    return s.share_series(table(spark, d, "part"), "p_brand")


@query(
    "presence_series",
    f"""WITH {BLANKED} SELECT {stamp("CAST(date_trunc('day', ts) AS TIMESTAMP)")} AS bucket, CAST(count(*) AS DOUBLE) AS y, count(*) AS n
        FROM blanked WHERE event_type IS NOT NULL GROUP BY 1""",
)
def presence_series(spark, d):
    return y8(s.presence_series(events_blanked(spark, d), "event_type", "ts"))


@query(
    "mean_over_top",
    f"""SELECT p_brand AS category, count(*) AS n, {rnd('avg(l_quantity)', 4)} AS avg_value FROM lineitem JOIN part ON l_partkey = p_partkey
        WHERE trim(p_brand) <> '' GROUP BY 1 ORDER BY n DESC, category LIMIT 10""",
)
def mean_over_top(spark, d):
    part = table(spark, d, "part").select(c("p_partkey").alias("l_partkey"), "p_brand")
    joined = table(spark, d, "lineitem").select("l_partkey", "l_quantity").join(part, "l_partkey")
    return s.mean_over_top(joined, "p_brand", "l_quantity", 10).withColumn("avg_value", rounded(c("avg_value"), 4))


@query("raw_value_top", "SELECT props AS category, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, category LIMIT 8")
def raw_value_top(spark, d):
    return s.raw_value_top(table(spark, d, "events"), "props")


@query(
    "sum_by_time",
    f"""SELECT {stamp("CAST(date_trunc('month', o_orderdate) AS TIMESTAMP)")} AS bucket, {rnd('sum(o_totalprice)', 2)} AS y, count(*) AS n FROM orders GROUP BY 1""",
)
def sum_by_time(spark, d):
    points = s.time_series(table(spark, d, "orders"), "o_orderdate", "o_totalprice", "month", how="sum")
    return s.stamped(points).withColumn("y", rounded(c("y"), 2))


@query("scatter_sample")
def scatter_sample(spark, d):
    return s.scatter_sample(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice", ["l_orderkey", "l_linenumber", "l_partkey"])


def all_points(spark, d):
    """Several series of different tables in the long form."""
    hist = s.as_points(s.histogram(table(spark, d, "lineitem"), "l_extendedprice"), "price_hist", "bar", "bin", "n")
    daily = s.as_points(s.time_series(table(spark, d, "events"), "ts", "value"), "value_by_day", "line", "bucket", "y")
    month = s.as_points(s.time_series(table(spark, d, "events"), "ts", "value", "month"), "value_by_month", "line", "bucket", "y")
    brand = s.as_points(s.top_with_other(table(spark, d, "part"), "p_brand", 5), "brands", "bar", "category", "n")
    price = s.as_points(table(spark, d, "orders"), "order_totals", "line", "o_orderkey", "o_totalprice")
    return hist.unionByName(daily).unionByName(month).unionByName(brand).unionByName(price)


POINTS = f"""points AS (
  SELECT 'price_hist' AS series, 'bar' AS chart, CAST(bin AS VARCHAR) AS x, CAST(n AS DOUBLE) AS y FROM ({HIST.format(c='l_extendedprice', t='lineitem', label='')})
  UNION ALL SELECT 'value_by_day', 'line', CAST(date_trunc('day', ts) AS VARCHAR), avg(value) FROM events GROUP BY ALL
  UNION ALL SELECT 'value_by_month', 'line', CAST(date_trunc('month', ts) AS VARCHAR), avg(value) FROM events GROUP BY ALL
  UNION ALL SELECT 'brands', 'bar', category, CAST(n AS DOUBLE) FROM {top_sql(5)}
  UNION ALL SELECT 'order_totals', 'line', CAST(o_orderkey AS VARCHAR), o_totalprice FROM orders)"""


@query(
    "axis_scale",
    f"""WITH {POINTS}, e AS (SELECT series, min(y) AS lo, max(y) AS hi FROM points GROUP BY 1),
        p AS (SELECT *, CASE WHEN hi = lo THEN greatest(abs(hi) * 0.05, 1) ELSE (hi - lo) * 0.12 END AS pad, lo > 0 AND hi >= lo * 1000 AS wide FROM e)
        SELECT series, CASE WHEN wide THEN 'log' ELSE 'linear' END AS y_scale,
               {rnd('CASE WHEN wide THEN lo ELSE lo - pad END', 4)} AS domain_from, {rnd('CASE WHEN NOT wide THEN hi + pad END', 4)} AS domain_to FROM p""",
)
def axis_scale(spark, d):
    return s.axis_scale(all_points(spark, d))


@query(
    "series_keep",
    f"""WITH {POINTS} SELECT series, chart, count(*) AS point_count, count(DISTINCT x) AS x_unique, {rnd('min(y)', 4)} AS y_min, {rnd('max(y)', 4)} AS y_max,
          NOT ((chart = 'line' AND count(*) < 3) OR (chart = 'bar' AND count(*) <= 1)) AS keep FROM points GROUP BY series, chart""",
)
def series_keep(spark, d):
    return s.series_keep(all_points(spark, d))


@query(
    "cooccurrence_edges",
    f"""WITH h AS (SELECT l_orderkey, min(l_returnflag || l_linestatus) AS source, max(l_returnflag || l_linestatus) AS target,
                          count(DISTINCT l_returnflag || l_linestatus) AS items FROM lineitem GROUP BY 1)
        SELECT source, target, count(*) AS n, {rnd('least(1.0, 0.4 + 0.2 * count(*))', 4)} AS strength FROM h WHERE items = 2 GROUP BY 1, 2""",
)
def cooccurrence_edges(spark, d):
    line = table(spark, d, "lineitem").select("l_orderkey", F.concat("l_returnflag", "l_linestatus").alias("item"))
    return s.cooccurrence_edges(line, "l_orderkey", "item")
