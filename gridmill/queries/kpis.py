"""Queries on headline numbers, grouped totals and ordered rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridmill.functions.joins import small_side
from gridmill.operators import analytics, kpi, timeagg
from gridmill.queries import register
from gridmill.queries import tables as t
from gridmill.queries.tables import load

ROLES = {"value": "l_extendedprice", "qty": "l_quantity", "date": "l_shipdate", "category": "l_returnflag"}
ORDER_ROLES = {"value": "o_totalprice", "date": "o_orderdate", "category": "o_orderstatus"}


def growth_sql(view: str, date: str, value: str, key: str) -> str:
    return (
        f"SELECT count(*) AS n_rows, round(coalesce(sum(v) FILTER (WHERE rn <= n // 2), 0)::DOUBLE, 2) AS first_half, "
        f"round(coalesce(sum(v) FILTER (WHERE rn > n // 2), 0)::DOUBLE, 2) AS second_half, "
        f"CASE WHEN sum(v) FILTER (WHERE rn <= n // 2) > 0 THEN round((sum(v) FILTER (WHERE rn > n // 2)::DOUBLE - "
        f"sum(v) FILTER (WHERE rn <= n // 2)::DOUBLE) / sum(v) FILTER (WHERE rn <= n // 2)::DOUBLE * 100, 2) END AS growth_pct "
        f"FROM (SELECT {value} AS v, row_number() OVER (ORDER BY {date}, {key}) AS rn, count(*) OVER () AS n FROM ({view}) WHERE {date} IS NOT NULL)"
    )


def kpi_sql(view: str, value: str, n_cols: int, qty: str | None, cat: str, growth: str | None = None) -> str:
    title = lambda c: c.replace("_", " ").title()
    parts = [
        f"SELECT 'total_value' AS kpi, 'Total {title(value)}' AS label, round(sum({value})::DOUBLE, 2) AS value, 'currency' AS fmt FROM ({view})",
        f"SELECT 'avg_value', 'Avg {title(value)}', round(sum({value})::DOUBLE / count({value}), 2), 'currency' FROM ({view})",
        f"SELECT 'max_value', 'Peak {title(value)}', round(max({value})::DOUBLE, 2), 'currency' FROM ({view})",
        f"SELECT 'min_value', 'Min {title(value)}', round(min({value})::DOUBLE, 2), 'number' FROM ({view})",
        f"SELECT 'total_records', 'Total Records', count(*)::DOUBLE, 'number' FROM ({view})",
        f"SELECT 'total_columns', 'Features', {n_cols}::DOUBLE, 'number'",
        f"SELECT 'unique_categories', 'Unique {title(cat)}', count(DISTINCT {cat})::DOUBLE, 'number' FROM ({view})",
    ]
    if qty:
        parts.append(f"SELECT 'total_qty', 'Total {title(qty)}', floor(sum({qty})::DOUBLE), 'number' FROM ({view})")
    if growth:
        parts.append(f"SELECT 'growth_rate', 'Period Growth', growth_pct, 'percent' FROM ({growth})")
    return " UNION ALL ".join(parts)


@register(
    "a01_value_kpis",
    "SELECT * FROM (" + kpi_sql(t.LINEITEM_NULLS, "l_extendedprice", 11, "l_quantity", "l_returnflag") + ") "
    "WHERE kpi IN ('total_value', 'avg_value', 'max_value', 'min_value')",
)
def _(spark, sf):
    names = ["total_value", "avg_value", "max_value", "min_value"]
    return kpi.kpis(t.lineitem_nulls(spark, sf), ROLES).filter(F.col("kpi").isin(names))


@register("a02_period_growth", growth_sql(t.ORDERS, "o_orderdate", "o_totalprice", "o_orderkey"))
def _(spark, sf):
    return kpi.period_growth(t.orders(spark, sf), "o_orderdate", "o_totalprice", "o_orderkey")


@register("a03_count_kpis", kpi_sql(t.LINEITEM_NULLS, "l_extendedprice", 11, "l_quantity", "l_returnflag"))
def _(spark, sf):
    return kpi.kpis(t.lineitem_nulls(spark, sf), ROLES)


_GROWTH = growth_sql(t.ORDERS, "o_orderdate", "o_totalprice", "o_orderkey")
_REFRESH = kpi_sql(t.ORDERS, "o_totalprice", 6, None, "o_orderstatus", _GROWTH)
_DASHBOARD = (
    "SELECT 'total_rows' AS kpi, 'Total Records' AS label, count(*)::DOUBLE AS value, 'number' AS fmt FROM orders "
    "UNION ALL SELECT 'total_cols', 'Total Columns', 6.0::DOUBLE, 'number' "
    "UNION ALL SELECT 'completeness', 'Completeness', 100.0::DOUBLE, 'percent' "
    "UNION ALL SELECT 'duplicates', 'Duplicate Rows', (count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM orders)))::DOUBLE, 'number' FROM orders "
    "UNION ALL " + _REFRESH
)


@register("a04_dashboard_kpis", _DASHBOARD)
def _(spark, sf):
    return kpi.dashboard_kpis(t.orders(spark, sf), ORDER_ROLES, "o_orderkey")


@register("a13_refresh_kpis", _REFRESH)
def _(spark, sf):
    return kpi.refresh_kpis(t.orders(spark, sf), ORDER_ROLES, "o_orderkey")


AGG_SQL = {
    "sum": "coalesce(sum({y}), 0)::DOUBLE",
    "mean": "sum({y})::DOUBLE / count({y})",
    "median": "quantile_cont({y}::DOUBLE, 0.5)",
    "max": "max({y})::DOUBLE",
    "min": "min({y})::DOUBLE",
    "count": "count({y})::DOUBLE",
}


def group_sql(view: str, x: str, y: str, agg: str = "sum", n: int = 15, keep_null: bool = True, digits: int = 4) -> str:
    e = AGG_SQL[agg].format(y=y)
    where = "" if keep_null else f" WHERE {x} IS NOT NULL"
    return (
        f"SELECT row_number() OVER (ORDER BY value DESC NULLS LAST, label) AS ord, label, value FROM (SELECT coalesce({x}::VARCHAR, 'nan') AS label, "
        f"round({e}, {digits}) AS value FROM ({view}){where} GROUP BY {x} ORDER BY value DESC NULLS LAST, label LIMIT {n})"
    )


@register("a05_group_agg", group_sql(t.LINEITEM_NULLS, "l_returnflag", "l_extendedprice"))
def _(spark, sf):
    return kpi.group_agg(t.lineitem_nulls(spark, sf), "l_returnflag", "l_extendedprice")


@register(
    "a05_group_agg_every_function",
    " UNION ALL ".join(f"SELECT '{a}' AS agg, * FROM ({group_sql(t.LINEITEM_NULLS, 'l_suppkey', 'l_quantity', a, 10)})" for a in AGG_SQL),
)
def _(spark, sf):
    df, out = t.lineitem_nulls(spark, sf), None
    for a in AGG_SQL:
        one = kpi.group_agg(df, "l_suppkey", "l_quantity", a, 10).select(F.lit(a).alias("agg"), "*")
        out = one if out is None else out.unionByName(one)
    return out


@register(
    "a06_group_agg2",
    f"SELECT l_returnflag AS label, l_linestatus AS series, round(sum(l_extendedprice)::DOUBLE, 2) AS value FROM ({t.LINEITEM_NULLS}) "
    "WHERE l_returnflag IS NOT NULL GROUP BY 1, 2",
)
def _(spark, sf):
    return kpi.group_agg2(t.lineitem_nulls(spark, sf), "l_returnflag", "l_linestatus", "l_extendedprice")


def hierarchy_sql(view: str, parent: str, child: str, value: str) -> str:
    return (
        f"SELECT CASE g WHEN 3 THEN 'All' WHEN 1 THEN p ELSE c END AS label, CASE g WHEN 3 THEN '' WHEN 1 THEN 'All' ELSE p END AS parent, "
        f"round(v, 2) AS value FROM (SELECT {parent}::VARCHAR AS p, {child}::VARCHAR AS c, grouping({parent}, {child}) AS g, "
        f"sum({value})::DOUBLE AS v FROM ({view}) GROUP BY ROLLUP ({parent}, {child}))"
    )


_NATIONS = "SELECT r_name, n_name, c_acctbal::DECIMAL(18,2) AS c_acctbal FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"


def nations(spark, sf):
    """Customer balances with their nation and region."""
    n = load(spark, sf, "nation").join(small_side(load(spark, sf, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    c = load(spark, sf, "customer").withColumn("c_acctbal", F.col("c_acctbal").cast("decimal(18,2)"))
    return c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("r_name", "n_name", "c_acctbal")


@register("a10_hierarchy", hierarchy_sql(_NATIONS, "r_name", "n_name", "c_acctbal"))
def _(spark, sf):
    return kpi.hierarchy(nations(spark, sf), "r_name", "n_name", "c_acctbal")


@register(
    "a11_value_summary",
    f"SELECT round(sum(l_extendedprice)::DOUBLE, 2) AS total, count(*) AS records, round(sum(l_extendedprice)::DOUBLE / count(l_extendedprice), 2) AS avg, "
    f"round(max(l_extendedprice)::DOUBLE, 2) AS max, 11::INTEGER AS columns, floor(sum(l_quantity))::BIGINT AS qty_total FROM ({t.LINEITEM_NULLS})",
)
def _(spark, sf):
    return kpi.value_summary(t.lineitem_nulls(spark, sf), "l_extendedprice", "l_quantity")


# --- ordered rows -----------------------------------------------------------

@register(
    "w01_lag_features",
    "SELECT o_orderkey, " + ", ".join(f"lag(o_totalprice, {i}) OVER w AS o_totalprice_lag_{i}" for i in range(1, 8))
    + " FROM orders WINDOW w AS (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey)",
)
def _(spark, sf):
    out = timeagg.lag_features(load(spark, sf, "orders"), "o_orderdate", "o_totalprice", 7, ["o_orderpriority"], "o_orderkey")
    return out.select("o_orderkey", *[f"o_totalprice_lag_{i}" for i in range(1, 8)])


_FRAME = "ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING"
_W = "WINDOW w AS (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey {f})"


@register(
    "w02_rolling_mean",
    "SELECT o_orderkey, CASE WHEN count(o_totalprice) OVER w = 7 THEN round(avg(o_totalprice) OVER w, 4) END AS roll_mean FROM orders "
    + _W.format(f=_FRAME),
)
def _(spark, sf):
    out = timeagg.rolling_features(load(spark, sf, "orders"), "o_orderdate", "o_totalprice", 7, ["o_orderpriority"], "o_orderkey")
    return out.select("o_orderkey", F.round("o_totalprice_roll_mean_7", 4).alias("roll_mean"))


@register(
    "w03_rolling_std",
    "SELECT o_orderkey, CASE WHEN count(o_totalprice) OVER w = 7 THEN round(stddev_samp(o_totalprice) OVER w, 3) END AS roll_std FROM orders "
    + _W.format(f=_FRAME),
)
def _(spark, sf):
    out = timeagg.rolling_features(load(spark, sf, "orders"), "o_orderdate", "o_totalprice", 7, ["o_orderpriority"], "o_orderkey")
    return out.select("o_orderkey", F.round("o_totalprice_roll_std_7", 3).alias("roll_std"))


_CAL = (
    "month(o_orderdate)::INTEGER AS month, (isodow(o_orderdate) - 1)::INTEGER AS dayofweek, quarter(o_orderdate)::INTEGER AS quarter, "
    "dayofyear(o_orderdate)::INTEGER AS dayofyear, year(o_orderdate)::INTEGER AS year"
)


@register("w04_calendar_features", f"SELECT o_orderkey, {_CAL} FROM orders")
def _(spark, sf):
    return timeagg.calendar_features(load(spark, sf, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate").drop("o_orderdate")


@register(
    "w05_prepare_time_series",
    "SELECT * FROM (SELECT o_orderkey, o_totalprice, "
    + ", ".join(f"lag(o_totalprice, {i}) OVER o AS lag_{i}" for i in (1, 3, 7))
    + ", CASE WHEN count(o_totalprice) OVER w = 7 THEN round(avg(o_totalprice) OVER w, 4) END AS roll_mean, "
    f"{_CAL} FROM orders WINDOW o AS (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey), "
    f"w AS (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey {_FRAME})) WHERE lag_7 IS NOT NULL",
)
def _(spark, sf):
    out = timeagg.prepare_time_series(load(spark, sf, "orders"), "o_orderdate", "o_totalprice", 7, ["o_orderpriority"], "o_orderkey")
    return out.select(
        "o_orderkey", "o_totalprice", *[F.col(f"o_totalprice_lag_{i}").alias(f"lag_{i}") for i in (1, 3, 7)],
        F.round("o_totalprice_roll_mean_7", 4).alias("roll_mean"), "month", "dayofweek", "quarter", "dayofyear", "year",
    )


@register(
    "w06_cumulative",
    f"WITH g AS (SELECT o_orderdate AS key, sum(o_totalprice)::DOUBLE AS v FROM ({t.ORDERS}) GROUP BY 1) "
    "SELECT key, round(v, 2) AS value, round(sum(v) OVER (ORDER BY key), 2) AS running, "
    "round(sum(v) OVER (ORDER BY key) / sum(v) OVER () * 100, 2) AS running_pct FROM g",
)
def _(spark, sf):
    return timeagg.cumulative(t.orders(spark, sf), "o_orderdate", "o_totalprice")


@register(
    "w07_top_k_per_group",
    "SELECT * FROM (SELECT o_orderpriority, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_orderpriority "
    "ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 5",
)
def _(spark, sf):
    o = load(spark, sf, "orders").select("o_orderpriority", "o_orderkey", "o_totalprice")
    return timeagg.top_k_per_group(o, ["o_orderpriority"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 5)


# --- anomalies and trend ----------------------------------------------------

_TAXED = "SELECT o_orderkey, CASE WHEN o_orderkey % 50 = 0 THEN o_totalprice * 10 ELSE o_totalprice END AS price FROM orders"
_FENCE = "(SELECT quantile_cont(price, 0.25) AS q1, quantile_cont(price, 0.75) AS q3 FROM v)"


def spiked(spark, sf):
    """Orders with every fiftieth price ten times too high."""
    return load(spark, sf, "orders").selectExpr(
        "o_orderkey", "CASE WHEN o_orderkey % 50 = 0 THEN o_totalprice * 10 ELSE o_totalprice END AS price"
    )


@register(
    "g03_iqr_anomalies",
    f"WITH v AS ({_TAXED}), f AS (SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM {_FENCE}) "
    "SELECT count(*) FILTER (WHERE price < lo OR price > hi) AS total_anomalies, "
    "round(count(*) FILTER (WHERE price < lo OR price > hi) / count(*) * 100, 2) AS anomaly_pct, "
    "round(any_value(lo), 2) AS lower_bound, round(any_value(hi), 2) AS upper_bound FROM v, f",
)
def _(spark, sf):
    return analytics.iqr_anomalies(spiked(spark, sf), "price")


@register(
    "g03_anomaly_rows",
    f"WITH v AS ({_TAXED}), f AS (SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM {_FENCE}) "
    "(SELECT 'outlier' AS kind, o_orderkey AS key, round(price, 2) AS value FROM v, f WHERE price < lo OR price > hi ORDER BY key LIMIT 50) "
    "UNION ALL (SELECT 'normal', o_orderkey, round(price, 2) FROM v, f WHERE NOT (price < lo OR price > hi) "
    "ORDER BY md5('42|' || o_orderkey::VARCHAR), o_orderkey LIMIT 100)",
)
def _(spark, sf):
    return analytics.anomaly_rows(spiked(spark, sf), "price", "o_orderkey")


@register(
    "g04_trend_forecast",
    f"""
    WITH m AS (SELECT date_trunc('month', o_orderdate)::DATE AS p, sum(o_totalprice)::DOUBLE / count(o_totalprice) AS v FROM ({t.ORDERS_GAPS}) GROUP BY 1),
    e AS (SELECT min(p) AS first, max(p) AS last FROM m),
    x AS (SELECT p, v, ((year(p) - year(first)) * 12 + month(p) - month(first))::DOUBLE AS i FROM m, e),
    fit AS (SELECT regr_slope(v, i) AS s, regr_intercept(v, i) AS b FROM x),
    n AS (SELECT (year(last) - year(first)) * 12 + month(last) - month(first) + 1 AS n, first FROM e)
    SELECT 'history' AS kind, strftime(p, '%Y-%m') AS label, round(v, 2) AS value, round(s, 4) AS slope FROM x, fit
    UNION ALL
    SELECT 'forecast', strftime(first + to_months((n + k)::INTEGER), '%Y-%m'), round(b + s * (n + k), 2), round(s, 4)
    FROM n, fit, range(12) r(k)
    """,
)
def _(spark, sf):
    return analytics.trend_forecast(t.orders_gaps(spark, sf), "o_orderdate", "o_totalprice")
