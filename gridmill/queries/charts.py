"""Queries on chart tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridmill.operators import charts
from gridmill.queries import register
from gridmill.queries import tables as t
from gridmill.queries.columns import corr_sql
from gridmill.queries.kpis import ROLES, group_sql, hierarchy_sql, nations, _NATIONS
from gridmill.queries.series import auto_sql
from gridmill.queries.tables import load


def _bars(view: str, x: str, y: str, agg: str = "sum", n: int = 15, keep_null: bool = True, digits: int = 4) -> str:
    return f"SELECT ord, label, '{y}' AS series, value FROM ({group_sql(view, x, y, agg, n, keep_null, digits)})"


def _melt(source: str, pairs: dict[str, str], digits: int = 4) -> str:
    values = ", ".join(f"('{s}', round(({e})::DOUBLE, {digits}))" for s, e in pairs.items())
    return f"SELECT ord, label, series, value FROM ({source}), LATERAL (VALUES {values}) v(series, value)"


def _chart(name: str, view, chart_id: str, spec: dict, sql: str | None, n_rows_only: bool = False):
    register(name, sql)(lambda spark, sf: charts.build_chart(view(spark, sf), chart_id, spec))


# --- groups -----------------------------------------------------------------

_XY = {"x": "l_returnflag", "y": "l_extendedprice"}
_chart("c01_bar", t.lineitem_nulls, "bar", _XY, _bars(t.LINEITEM_NULLS, "l_returnflag", "l_extendedprice"))
_chart(
    "c02_hbar", t.lineitem_nulls, "hbar", {"x": "l_suppkey", "y": "l_extendedprice", "agg": "mean"},
    _bars(t.LINEITEM_NULLS, "l_suppkey", "l_extendedprice", "mean"),
)


def _pivot_sql(view: str, x: str, y: str, group: str, n_groups: int, expr: str, pick: str, label: str) -> str:
    """Dense (x, group) cells over the most frequent groups, gaps as 0."""
    return f"""
    WITH v AS ({view}),
    top AS (SELECT coalesce({group}::VARCHAR, 'nan') AS g FROM v GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT {n_groups}),
    c AS (SELECT {x} AS x, {group}::VARCHAR AS g, {expr.format(y=y)} AS v FROM v
          WHERE {x} IS NOT NULL AND {group}::VARCHAR IN (SELECT g FROM top) GROUP BY 1, 2),
    xs AS (SELECT x, row_number() OVER (ORDER BY {pick}) AS ord FROM (SELECT x, sum(v) AS h FROM c GROUP BY x)),
    gs AS (SELECT DISTINCT g FROM c)
    SELECT ord, {label} AS label, gs.g AS series, round(coalesce(c.v, 0)::DOUBLE, 4) AS value
    FROM xs CROSS JOIN gs LEFT JOIN c ON c.x = xs.x AND c.g = gs.g
    """


_STACK = _pivot_sql(
    t.ORDERS, "o_custkey", "o_totalprice", "o_orderpriority", 6, "coalesce(sum({y}), 0)::DOUBLE", "round(h, 4) DESC, x::VARCHAR",
    "xs.x::VARCHAR",
) + " WHERE ord <= 12"
_STACK_SPEC = {"x": "o_custkey", "y": "o_totalprice", "group": "o_orderpriority"}
_chart("c03_stacked_bar", t.orders, "stacked_bar", _STACK_SPEC, _STACK)
_chart(
    "c04_grouped_bar", t.lineitem_nulls, "grouped_bar",
    {"x": "l_linenumber", "y": "l_quantity", "group": "l_returnflag", "agg": "mean"},
    _pivot_sql(t.LINEITEM_NULLS, "l_linenumber", "l_quantity", "l_returnflag", 6, "sum({y})::DOUBLE / count({y})",
               "round(h, 4) DESC, x::VARCHAR", "xs.x::VARCHAR") + " WHERE ord <= 12",
)


def _line_sql(view: str, x: str, y: str, expr: str) -> str:
    return (
        f"SELECT row_number() OVER (ORDER BY x) AS ord, x::VARCHAR AS label, '{y}' AS series, round(v, 4) AS value FROM "
        f"(SELECT {x} AS x, {expr.format(y=y)} AS v FROM ({view}) WHERE {x} IS NOT NULL AND {y} IS NOT NULL GROUP BY 1)"
    )


_DAY = "strftime(o_orderdate, '%Y-%m-%d')"
_chart("c05_line", t.orders, "line", {"x": "o_orderdate", "y": "o_totalprice"}, _line_sql(t.ORDERS, _DAY, "o_totalprice", "sum({y})::DOUBLE"))
_chart(
    "c06_area", t.lineitem_nulls, "area", {"x": "l_linenumber", "y": "l_quantity", "agg": "mean"},
    _line_sql(t.LINEITEM_NULLS, "l_linenumber", "l_quantity", "sum({y})::DOUBLE / count({y})"),
)


def _series_rows(sql: str) -> str:
    return f"SELECT ord, label, level AS series, value FROM ({sql})"


_chart(
    "c07_time_series", t.orders_gaps, "time_series", {"x": "o_orderdate", "y": "o_totalprice"},
    _series_rows(auto_sql(t.ORDERS_GAPS, "o_orderdate", "o_totalprice", "yearly", "coalesce(sum({y}), 0)::DOUBLE", True)),
)
_chart(
    "c08_multi_line", t.orders, "multi_line", {"x": "o_orderdate", "y": "o_totalprice", "group": "o_orderpriority"},
    _pivot_sql(t.ORDERS, _DAY, "o_totalprice", "o_orderpriority", 5, "coalesce(sum({y}), 0)::DOUBLE", "x", "xs.x")
    + " WHERE ord <= 40",
)
_chart("c09_pie", t.lineitem, "pie", {"x": "l_suppkey", "y": "l_extendedprice"}, _bars(t.LINEITEM, "l_suppkey", "l_extendedprice", "sum", 8))


def _counts_sql(view: str, x: str, n: int) -> str:
    return (
        f"SELECT row_number() OVER (ORDER BY value DESC, label) AS ord, label, 'count' AS series, value FROM "
        f"(SELECT coalesce({x}::VARCHAR, 'nan') AS label, count(*)::DOUBLE AS value FROM ({view}) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT {n})"
    )


_chart("c10_donut", t.lineitem_nulls, "donut", {"x": "l_returnflag"}, _counts_sql(t.LINEITEM_NULLS, "l_returnflag", 8))
_chart("c11_polar", t.lineitem_nulls, "polar", {"x": "l_quantity"}, _counts_sql(t.LINEITEM_NULLS, "l_quantity", 8))


# --- distributions ----------------------------------------------------------

def hist_sql(view: str, c: str, bins: int, digits: int = 4) -> str:
    return f"""
    WITH v AS (SELECT {c}::DOUBLE AS x FROM ({view}) WHERE {c} IS NOT NULL),
    m AS (SELECT CASE WHEN min(x) = max(x) THEN min(x) - 0.5 ELSE min(x) END AS lo,
                 CASE WHEN min(x) = max(x) THEN max(x) + 0.5 ELSE max(x) END AS hi, count(*) AS n FROM v),
    b AS (SELECT lo, (hi - lo) / {bins} AS w, n FROM m),
    h AS (SELECT least(floor((x - lo) / w), {bins} - 1)::BIGINT AS k, count(*) AS c FROM v, b GROUP BY 1)
    SELECT r.k + 1 AS ord, round(lo + (r.k + 0.5) * w, {digits})::VARCHAR AS label, coalesce(h.c, 0) AS c, n, w
    FROM range({bins}) r(k) CROSS JOIN b LEFT JOIN h ON h.k = r.k
    """


def _hist(view: str, c: str, bins: int, digits: int = 4) -> str:
    return f"SELECT ord, label, 'frequency' AS series, c::DOUBLE AS value FROM ({hist_sql(view, c, bins, digits)})"


_chart("c12_histogram", t.lineitem_nulls, "histogram", {"x": "l_extendedprice"}, _hist(t.LINEITEM_NULLS, "l_extendedprice", 20))
register("c12_histogram_constant", _hist("SELECT 5.0::DOUBLE AS k FROM customer", "k", 20))(
    lambda spark, sf: charts.build_chart(load(spark, sf, "customer").select(F.lit(5.0).alias("k")), "histogram", {"x": "k"})
)


def box_sql(view: str, names) -> str:
    parts = []
    for c in names:
        parts.append(f"""
        SELECT ord::BIGINT + {len(parts) * 9} AS ord, label, '{c}' AS series, round(value, 4) AS value FROM (
          WITH v AS (SELECT {c}::DOUBLE AS x FROM ({view}) WHERE {c} IS NOT NULL),
          q AS (SELECT quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS q2, quantile_cont(x, 0.75) AS q3, min(x) AS lo, max(x) AS hi,
                       avg(x) AS mu FROM v),
          f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS fl, q3 + 1.5 * (q3 - q1) AS fh FROM q),
          o AS (SELECT count(*) FILTER (WHERE x < fl OR x > fh) AS n FROM v, f)
          SELECT ord, label, value FROM f, o, LATERAL (VALUES (1, 'min', lo), (2, 'q1', q1), (3, 'median', q2), (4, 'mean', mu), (5, 'q3', q3),
            (6, 'max', hi), (7, 'outliers_low', fl), (8, 'outliers_high', fh), (9, 'n_outliers', n::DOUBLE)) t(ord, label, value))""")
    return " UNION ALL ".join(parts)


_chart("c13_box", t.lineitem_nulls, "box", {"x": "l_quantity"}, box_sql(t.LINEITEM_NULLS, ["l_quantity"]))


def _points_sql(view: str, key: str, columns: list[str], n: int) -> str:
    full = " AND ".join(f"{c} IS NOT NULL" for c in columns)
    return (
        f"SELECT row_number() OVER (ORDER BY h, {key}) AS ord, row_number() OVER (ORDER BY h, {key})::VARCHAR AS label, * FROM "
        f"(SELECT md5('42|' || {key}::VARCHAR) AS h, * FROM ({view}) WHERE {full} ORDER BY h, {key} LIMIT {n})"
    )


_chart(
    "c14_scatter", lambda s, f: load(s, f, "part"), "scatter", {"x": "p_size", "y": "p_retailprice", "key": "p_partkey"},
    _melt(_points_sql("SELECT * FROM part", "p_partkey", ["p_size", "p_retailprice"], 500), {"x": "p_size", "y": "p_retailprice"}),
)
_chart(
    "c15_bubble", lambda s, f: load(s, f, "orders"), "bubble",
    {"x": "o_custkey", "y": "o_totalprice", "r": "o_orderkey", "key": "o_orderkey"},
    _melt(
        "SELECT *, round(4 + 20 * (o_orderkey - min(o_orderkey) OVER ()) / (max(o_orderkey) OVER () - min(o_orderkey) OVER ()), 2) AS radius FROM ("
        + _points_sql("SELECT * FROM orders", "o_orderkey", ["o_custkey", "o_totalprice"], 300) + ")",
        {"x": "o_custkey", "y": "o_totalprice", "r": "radius"},
    ),
)


def _facts_sql(view: str, items: list[tuple[str, str, str]], digits: int = 4) -> str:
    values = ", ".join(f"({i + 1}, '{label}', '{series}', round(({e})::DOUBLE, {digits}))" for i, (label, series, e) in enumerate(items))
    names = ", ".join(f"({e}) AS e{i}" for i, (_, _, e) in enumerate(items))
    values = ", ".join(f"({i + 1}, '{label}', '{series}', round(e{i}::DOUBLE, {digits}))" for i, (label, series, _) in enumerate(items))
    return f"SELECT ord::BIGINT AS ord, label, series, value FROM (SELECT {names} FROM ({view})), LATERAL (VALUES {values}) v(ord, label, series, value)"


_NUM8 = list(t.LINEITEM_NUMBERS)
_chart(
    "c16_radar", t.lineitem_nulls, "radar", {},
    _facts_sql(
        t.LINEITEM_NULLS,
        [
            (c, s, e.format(c=c) + f" / CASE WHEN max(abs({c}::DOUBLE)) = 0 THEN 1 ELSE max(abs({c}::DOUBLE)) END")
            for c in _NUM8
            for s, e in (("mean", "sum({c})::DOUBLE / count({c})"), ("median", "quantile_cont({c}::DOUBLE, 0.5)"))
        ],
    ),
)


def heat_sql(view: str, names, digits: int) -> str:
    place = " ".join(f"WHEN '{c}' THEN {i + 1}" for i, c in enumerate(names))
    return (
        f"SELECT ((CASE x {place} END) * 100 + (CASE y {place} END))::BIGINT AS ord, x AS label, y AS series, r AS value "
        f"FROM ({corr_sql(view, names, digits)})"
    )


_chart("c17_heatmap", t.lineitem_nulls, "heatmap", {}, heat_sql(t.LINEITEM_NULLS, _NUM8, 3))
_TREE = group_sql(t.LINEITEM, "l_suppkey", "l_extendedprice", "sum", 20)
_chart(
    "c18_treemap", t.lineitem, "treemap", {"x": "l_suppkey", "y": "l_extendedprice"},
    _melt(f"SELECT *, round(value / sum(value) OVER () * 100, 1) AS pct FROM ({_TREE})".replace("SELECT *, round(value", "SELECT ord, label, value AS v0, round(value"),
          {"value": "v0", "pct": "pct"}),
)
_chart("c19_funnel", t.lineitem_nulls, "funnel", _XY, _bars(t.LINEITEM_NULLS, "l_returnflag", "l_extendedprice", "sum", 8))
_chart("c19_funnel_counts", lambda s, f: load(s, f, "part"), "funnel", {"x": "p_name"}, _counts_sql("SELECT * FROM part", "p_name", 8))
_Q = "l_quantity"
_chart(
    "c20_gauge", t.lineitem_nulls, "gauge", {"x": _Q},
    _facts_sql(t.LINEITEM_NULLS, [("value", _Q, f"avg({_Q})"), ("min", _Q, f"min({_Q})"), ("max", _Q, f"max({_Q})"),
                                  ("median", _Q, f"quantile_cont({_Q}, 0.5)")]),
)
_chart(
    "c21_kpi_tile", t.lineitem_nulls, "kpi_tile", {"x": "l_extendedprice", "agg": "mean"},
    _facts_sql(t.LINEITEM_NULLS, [("l_extendedprice", "mean", "sum(l_extendedprice)::DOUBLE / count(l_extendedprice)")]),
)
_STEPS = (
    f"SELECT row_number() OVER (ORDER BY l_returnflag NULLS LAST) AS ord, coalesce(l_returnflag, 'nan') AS label, "
    f"sum(l_extendedprice)::DOUBLE AS v, sum(sum(l_extendedprice)::DOUBLE) OVER (ORDER BY l_returnflag NULLS LAST) AS e "
    f"FROM ({t.LINEITEM_NULLS}) GROUP BY l_returnflag ORDER BY l_returnflag NULLS LAST LIMIT 10"
)
_chart("c22_waterfall", t.lineitem_nulls, "waterfall", _XY, _melt(_STEPS, {"start": "e - v", "end": "e", "delta": "v"}))
_PARETO = group_sql(t.ORDERS, "o_custkey", "o_totalprice", "sum", 15, keep_null=False)
_chart(
    "c23_pareto", t.orders, "pareto", {"x": "o_custkey", "y": "o_totalprice"},
    _melt(f"SELECT ord, label, value AS v0, round(sum(value) OVER (ORDER BY ord) / sum(value) OVER () * 100, 2) AS pct FROM ({_PARETO})",
          {"value": "v0", "cumulative_pct": "pct"}),
)
_chart(
    "c24_density", t.lineitem_nulls, "density", {"x": "l_quantity"},
    "SELECT ord, label, 'density' AS series, round((coalesce(lag(h) OVER (ORDER BY ord), 0) + h + coalesce(lead(h) OVER (ORDER BY ord), 0)) / 3, 4) AS value "
    f"FROM (SELECT ord, label, c / (n * w) AS h FROM ({hist_sql(t.LINEITEM_NULLS, 'l_quantity', 30)}))",
)
_chart("c25_cat_counts", lambda s, f: load(s, f, "part"), "cat_counts", {"x": "p_name"}, _counts_sql("SELECT * FROM part", "p_name", 12))


def stats_items(c: str) -> list[tuple[str, str, str]]:
    med, half = f"quantile_cont({c}::DOUBLE, 0.5)", f"stddev_samp({c}::DOUBLE) * 0.5"
    return [
        ("Min", c, f"min({c})"), ("Q1≈", c, f"{med} - {half}"), ("Median", c, med), ("Mean", c, f"sum({c})::DOUBLE / count({c})"),
        ("Q3≈", c, f"{med} + {half}"), ("Max", c, f"max({c})"),
    ]


_chart("c26_stats_bar", t.lineitem_nulls, "stats_bar", {"x": "l_extendedprice"}, _facts_sql(t.LINEITEM_NULLS, stats_items("l_extendedprice")))
_chart(
    "c27_dual_axis", t.orders, "dual_axis", {"x": "o_orderdate", "y": "o_totalprice", "y2": "o_custkey"},
    _melt(
        f"SELECT row_number() OVER (ORDER BY {_DAY}) AS ord, {_DAY} AS label, sum(o_totalprice)::DOUBLE AS a, sum(o_custkey)::DOUBLE AS b "
        f"FROM ({t.ORDERS}) GROUP BY {_DAY} ORDER BY 2 LIMIT 30",
        {"o_totalprice": "a", "o_custkey": "b"},
    ),
)


# --- report charts ----------------------------------------------------------

register(
    "c29_bi_bar_coloured",
    "SELECT row_number() OVER (ORDER BY label, series) AS ord, * FROM (SELECT l_returnflag AS label, l_linestatus AS series, "
    f"round(sum(l_extendedprice)::DOUBLE, 2) AS value FROM ({t.LINEITEM_NULLS}) WHERE l_returnflag IS NOT NULL GROUP BY 1, 2)",
)(lambda spark, sf: charts.bi_chart(t.lineitem_nulls(spark, sf), "bar", "l_returnflag", "l_extendedprice", "l_linestatus"))
register("c29_bi_bar", _bars(t.LINEITEM, "l_suppkey", "l_extendedprice", "mean", 20, False, 2))(
    lambda spark, sf: charts.bi_chart(t.lineitem(spark, sf), "bar", "l_suppkey", "l_extendedprice", agg="mean")
)
register("c30_bi_pie", _bars(t.LINEITEM, "l_suppkey", "l_extendedprice", "sum", 8, False, 2))(
    lambda spark, sf: charts.bi_chart(t.lineitem(spark, sf), "pie", "l_suppkey", "l_extendedprice")
)
register(
    "c30_bi_scatter",
    _melt(_points_sql("SELECT * FROM part", "p_partkey", ["p_size", "p_retailprice"], 500), {"x": "p_size", "y": "p_retailprice"}, 2),
)(lambda spark, sf: charts.bi_chart(load(spark, sf, "part"), "scatter", "p_size", "p_retailprice", key="p_partkey"))
register("c30_bi_histogram", _hist(t.LINEITEM, "l_extendedprice", 20, 2))(
    lambda spark, sf: charts.bi_chart(t.lineitem(spark, sf), "histogram", "l_returnflag", "l_extendedprice")
)
register("c30_bi_heatmap", heat_sql(t.LINEITEM, _NUM8, 2))(
    lambda spark, sf: charts.bi_chart(t.lineitem(spark, sf), "heatmap", "l_tax", "l_discount")
)


# --- chart pack -------------------------------------------------------------

PACK = {**ROLES, "rate": "l_discount"}
_PACK_PARTS = {
    "time_series": "SELECT ord, label, 'l_extendedprice' AS series, value FROM ("
    + auto_sql(t.LINEITEM_NULLS, "l_shipdate", "l_extendedprice", "yearly", "coalesce(sum({y}), 0)::DOUBLE", True, 2) + ")",
    "bar_chart": _bars(t.LINEITEM_NULLS, "l_returnflag", "l_extendedprice", "sum", 15, False, 2),
    "pie_chart": _bars(t.LINEITEM_NULLS, "l_returnflag", "l_extendedprice", "sum", 8, False, 2),
    "histogram": _hist(t.LINEITEM_NULLS, "l_extendedprice", 20, 2),
}
register("c31_chart_pack", " UNION ALL ".join(f"SELECT '{n}' AS chart, * FROM ({q})" for n, q in _PACK_PARTS.items()))(
    lambda spark, sf: charts.chart_pack_long(t.lineitem_nulls(spark, sf), PACK, list(_PACK_PARTS))
)
register(
    "c32_pack_scatter",
    "SELECT p_size::DOUBLE AS x, round(p_retailprice, 2) AS y, (p_partkey % 10)::DOUBLE AS color, p_type AS label FROM part "
    "ORDER BY md5('42|' || p_partkey::VARCHAR), p_partkey LIMIT 500",
)(
    lambda spark, sf: charts.pack_scatter(
        load(spark, sf, "part").withColumn("rate", F.col("p_partkey") % 10),
        {"qty": "p_size", "value": "p_retailprice", "rate": "rate", "category": "p_type"}, "p_partkey",
    )
)
register(
    "c33_pack_treemap",
    f"SELECT row_number() OVER (ORDER BY parent, label) AS ord, label, parent AS series, value FROM ({hierarchy_sql(_NATIONS, 'r_name', 'n_name', 'c_acctbal')})",
)(
    lambda spark, sf: charts.chart_pack(
        nations(spark, sf), {"value": "c_acctbal", "region": "r_name", "person": "n_name"}
    )["treemap"]
)
register("c33_pack_heatmap", heat_sql(t.LINEITEM, _NUM8, 2))(
    lambda spark, sf: charts.chart_pack(t.lineitem(spark, sf), {})["heatmap"]
)
register("c34_pack_box", box_sql(t.LINEITEM_NULLS, _NUM8))(
    lambda spark, sf: charts.chart_pack(t.lineitem_nulls(spark, sf), {})["box_plot"]
)
register("c35_stats_panel", _facts_sql(t.LINEITEM_NULLS, [i for c in _NUM8 for i in stats_items(c)]))(
    lambda spark, sf: charts.stats_panel(t.lineitem_nulls(spark, sf))
)
register(
    "c35_counts_panel",
    "SELECT ord, label, series, value FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY value DESC, label) AS ord FROM ("
    + t.union_all("SELECT '{c}' AS series, {c} AS label, count(*)::DOUBLE AS value FROM part GROUP BY 2", ["p_name", "p_brand", "p_type"])
    + ")) WHERE ord <= 8",
)(lambda spark, sf: charts.counts_panel(load(spark, sf, "part")))
register(
    "c35_category_totals",
    t.union_all(
        "SELECT '{c}' AS \"column\", coalesce({c}::VARCHAR, 'nan') AS label, round(sum(l_extendedprice)::DOUBLE, 2) AS value FROM ("
        + t.LINEITEM_NULLS + ") GROUP BY 2", ["l_returnflag", "l_linestatus", "l_linenumber"],
    ),
)(
    lambda spark, sf: charts.category_totals(
        t.lineitem_nulls(spark, sf), "l_extendedprice", ["l_returnflag", "l_linestatus", "l_linenumber"]
    )
)
