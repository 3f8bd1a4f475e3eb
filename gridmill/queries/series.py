"""Queries on calendar rollups."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridmill.operators import timeagg
from gridmill.queries import register
from gridmill.queries import tables as t

# how each level names a period, and steps to the next
PERIOD = {
    "daily": ("date_trunc('day', {d})::DATE", "%Y-%m-%d", "INTERVAL 1 DAY"),
    "weekly": ("(date_trunc('week', {d}) + INTERVAL 6 DAY)::DATE", "%Y-W%W", "INTERVAL 7 DAY"),
    "monthly": ("date_trunc('month', {d})::DATE", "%Y-%m", "INTERVAL 1 MONTH"),
    "quarterly": ("date_trunc('quarter', {d})::DATE", None, "INTERVAL 3 MONTH"),
    "yearly": ("date_trunc('year', {d})::DATE", "%Y", "INTERVAL 1 YEAR"),
}


def label_sql(level: str, p: str) -> str:
    fmt = PERIOD[level][1]
    return f"strftime({p}, '{fmt}')" if fmt else f"(year({p}) || '-Q' || quarter({p}))"


def resample_sql(view: str, date: str, value: str, level: str, expr: str, fill: bool) -> str:
    """(p, v) per period; with ``fill`` empty periods count 0."""
    period, _, step = PERIOD[level]
    g = f"SELECT {period.format(d=date)} AS p, {expr.format(y=value)} AS v FROM ({view}) WHERE {date} IS NOT NULL GROUP BY 1"
    if not fill:
        return f"SELECT * FROM ({g}) WHERE v IS NOT NULL"
    return (
        f"SELECT s.p, coalesce(g.v, 0) AS v FROM (SELECT unnest(generate_series(min(p)::TIMESTAMP, max(p)::TIMESTAMP, {step}))::DATE AS p FROM ({g})) s "
        f"LEFT JOIN ({g}) g ON s.p = g.p"
    )


def rollup_sql(view: str, date: str, value: str, level: str) -> str:
    rows = resample_sql(view, date, value, level, "sum({y})::DOUBLE", True)
    return f"SELECT '{level}' AS level, {label_sql(level, 'p')} AS label, round(v, 2) AS value FROM ({rows})"


@register("a07_time_rollups", " UNION ALL ".join(rollup_sql(t.ORDERS_GAPS, "o_orderdate", "o_totalprice", lv) for lv in PERIOD))
def _(spark, sf):
    return timeagg.time_rollups(t.orders_gaps(spark, sf), "o_orderdate", "o_totalprice")


def auto_sql(view: str, date: str, value: str, level: str, expr: str, fill: bool, digits: int = 4, label: str | None = None) -> str:
    rows = resample_sql(view, date, value, level, expr, fill)
    return (
        f"SELECT row_number() OVER (ORDER BY p) AS ord, {label or label_sql(level, 'p')} AS label, round(v, {digits}) AS value, "
        f"'{level}' AS level FROM ({rows})"
    )


# the standard orders span more than 1460 days, the events about 30
@register("a08_auto_rollup", auto_sql(t.EVENTS, "ts", "value", "weekly", "coalesce(sum({y}), 0)::DOUBLE", True))
def _(spark, sf):
    return timeagg.auto_rollup(t.events(spark, sf), "ts", "value")


@register(
    "a08_auto_rollup_median",
    auto_sql(t.ORDERS_GAPS, "o_orderdate", "o_totalprice", "yearly", "quantile_cont({y}::DOUBLE, 0.5)", False),
)
def _(spark, sf):
    return timeagg.auto_rollup(t.orders_gaps(spark, sf), "o_orderdate", "o_totalprice", "median")


@register(
    "a09_auto_rollup_legacy",
    auto_sql(t.EVENTS, "ts", "value", "weekly", "coalesce(sum({y}), 0)::DOUBLE", True, 2, "strftime(p, '%Y-%m-%d')"),
)
def _(spark, sf):
    return timeagg.auto_rollup(t.events(spark, sf), "ts", "value", rule="legacy")


@register(
    "a07_resample_counts",
    f"SELECT p AS period, v AS value FROM ({resample_sql(t.ORDERS_GAPS, 'o_orderdate', 'o_totalprice', 'monthly', 'count({y})::DOUBLE', True)})",
)
def _(spark, sf):
    out = timeagg.resample(t.orders_gaps(spark, sf), "o_orderdate", "o_totalprice", "monthly", "count")
    return out.select(F.col("period"), "value")
