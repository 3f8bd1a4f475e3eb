"""Chart tables: ``build_chart(df, chart_id, spec)`` gives bounded long rows.

Every builder returns ``ord, label, series, value`` with ``ord`` as the display
order. Totals always use the full data; only point clouds are sampled.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridmill.functions import semantics as S
from gridmill.functions.positions import with_position
from gridmill.functions.quantiles import column_quantiles
from gridmill.functions.semantics import col
from gridmill.operators import kpi, profile, timeagg
from gridmill.operators.clean import sample_n
from gridmill.operators.typing import sniff_dates

SCATTER_POINTS, BUBBLE_POINTS = 500, 300


class ChartSpecError(ValueError):
    """A chart specification that does not fit the table."""


def _need_numeric(df: DataFrame, *names: str | None) -> None:
    for n in names:
        if not S.is_numeric(df, n):
            raise ChartSpecError(f"column {n!r} is missing or not numeric")


def _need(df: DataFrame, *names: str | None) -> None:
    for n in names:
        if not n or n not in df.columns:
            raise ChartSpecError(f"column {n!r} is missing")


def _long(df: DataFrame, series: dict[str, Column], label: Column | None = None, digits: int = 4) -> DataFrame:
    """Melt named value columns of (ord, label, …) rows into the long form."""
    label = F.col("label") if label is None else label
    entries = F.array(
        *[F.struct(F.lit(s).alias("series"), F.round(v.cast("double"), digits).alias("value")) for s, v in series.items()]
    )
    return df.select("ord", label.alias("label"), F.inline(entries))


def _facts(df: DataFrame, items: Sequence[tuple[str, str, Column]], digits: int = 4) -> DataFrame:
    """Long rows from one aggregated row: (label, series, column) triples."""
    entries = F.array(
        *[
            F.struct(
                F.lit(i + 1).cast("bigint").alias("ord"),
                F.lit(label).alias("label"),
                F.lit(series).alias("series"),
                F.round(v.cast("double"), digits).alias("value"),
            )
            for i, (label, series, v) in enumerate(items)
        ]
    )
    return df.select(F.inline(entries))


def _is_dated(df: DataFrame, x: str) -> bool:
    if S.is_time_type(df.schema[x].dataType):
        return True
    if df.schema[x].dataType.typeName() != "string":
        return False
    return bool(sniff_dates(df, "sample", [x]).first()["is_date"])


def _axis(df: DataFrame, x: str) -> Column:
    """x as shown on an axis: days for dates, the value itself otherwise."""
    return F.date_format(S.time_col(df, x), "yyyy-MM-dd") if _is_dated(df, x) else col(x)


def _placed(df: DataFrame, *order: str) -> DataFrame:
    """Number result rows that may be many, without a one-task sort."""
    placed = with_position(df, [], [F.col(c).asc_nulls_last() for c in order], name="ord")
    return placed.withColumn("ord", F.col("ord") + 1)


# --- groups -----------------------------------------------------------------

def bar(df: DataFrame, spec: dict) -> DataFrame:
    x, y, agg = spec.get("x"), spec.get("y"), spec.get("agg", "sum")
    _need(df, x)
    _need_numeric(df, y)
    rows = kpi.group_agg(df, x, y, agg, int(spec.get("top_n", 15)))
    return rows.select("ord", "label", F.lit(y).alias("series"), "value")


def top_groups(df: DataFrame, group: str, n: int) -> list[str]:
    """The ``n`` most frequent values as text; a missing value takes a place too."""
    counts = profile.value_counts_long(df, [group], missing_as_text=True)
    return [row["value"] for row in counts.orderBy(F.desc("count"), "value").limit(n).collect()]


def _pivot(df: DataFrame, x: Column, y: str, group: str, groups: list[str], agg: str) -> tuple[DataFrame, list[str]]:
    """(label, g0, g1, …): one column per listed group, gaps as 0.

    The short group list is a literal filter (pushed to the scan) and a fixed
    pivot list, so no join and no extra distinct job is needed.
    """
    groups = sorted(g for g in groups if g != S.NULL_LABEL)
    sub = df.filter(col(group).cast("string").isin(groups)).select(
        x.alias("__x"), col(group).cast("string").alias("__g"), col(y).alias("__y")
    )
    cells = kpi.aggregate(sub.filter(F.col("__x").isNotNull()), ["__x", "__g"], "__y", agg)
    wide = cells.groupBy("__x").agg(
        *[F.coalesce(F.max(F.when(F.col("__g") == g, F.col("value"))), F.lit(0.0)).alias(f"g{i}") for i, g in enumerate(groups)]
    )
    return wide, groups


def stacked_bar(df: DataFrame, spec: dict) -> DataFrame:
    x, y, group = spec.get("x"), spec.get("y"), spec.get("group")
    _need(df, x, group)
    _need_numeric(df, y)
    wide, groups = _pivot(df, col(x), y, group, top_groups(df, group, 6), spec.get("agg", "sum"))
    height = sum((F.col(f"g{i}") for i in range(len(groups))), F.lit(0.0))
    rows = wide.select(F.col("__x").cast("string").alias("label"), height.alias("__h"), *[f"g{i}" for i in range(len(groups))])
    best = S.top_rows(rows, 12, F.round("__h", 4).desc(), F.col("label"))
    return _long(best, {g: F.col(f"g{i}") for i, g in enumerate(groups)})


def multi_line(df: DataFrame, spec: dict) -> DataFrame:
    x, y, group = spec.get("x"), spec.get("y"), spec.get("group")
    _need(df, x, group)
    _need_numeric(df, y)
    present = df.filter(col(x).isNotNull() & col(y).isNotNull())
    wide, groups = _pivot(present, _axis(df, x), y, group, top_groups(df, group, 5), "sum")
    first = S.top_rows(wide, 40, F.col("__x"))
    return _long(first, {g: F.col(f"g{i}") for i, g in enumerate(groups)}, F.col("__x").cast("string"))


def line(df: DataFrame, spec: dict) -> DataFrame:
    x, y = spec.get("x"), spec.get("y")
    _need(df, x)
    _need_numeric(df, y)
    flat = df.select(_axis(df, x).alias("__x"), col(y).alias("__y")).dropna()
    grouped = kpi.aggregate(flat, ["__x"], "__y", spec.get("agg", "sum"))
    return _placed(grouped, "__x").select(
        "ord", F.col("__x").cast("string").alias("label"), F.lit(y).alias("series"),
        F.round("value", 4).alias("value"),
    )


def time_series(df: DataFrame, spec: dict) -> DataFrame:
    x, y = spec.get("x"), spec.get("y")
    _need(df, x)
    _need_numeric(df, y)
    rows = timeagg.auto_rollup(df, x, y, spec.get("agg", "sum"))
    return rows.select("ord", "label", F.col("level").alias("series"), "value")


def _counted(df: DataFrame, x: str, n: int) -> DataFrame:
    counts = profile.value_counts_long(df, [x], missing_as_text=True)
    best = S.top_rows(counts, n, F.desc("count"), F.asc("value"))
    return best.select("ord", F.col("value").alias("label"), F.lit("count").alias("series"), F.col("count").cast("double").alias("value"))


def pie(df: DataFrame, spec: dict) -> DataFrame:
    x, y, n = spec.get("x"), spec.get("y"), int(spec.get("top_n", 8))
    _need(df, x)
    if S.is_numeric(df, y):
        return bar(df, {**spec, "top_n": n})
    return _counted(df, x, n)


def treemap(df: DataFrame, spec: dict) -> DataFrame:
    x, y = spec.get("x"), spec.get("y")
    _need(df, x)
    _need_numeric(df, y)
    best = kpi.group_agg(df, x, y, "sum", 20)
    kept = F.sum("value").over(Window.partitionBy())
    share = F.round(F.col("value") / F.when(kept == 0, 1.0).otherwise(kept) * 100, 1)
    return _long(best.withColumn("pct", share), {"value": F.col("value"), "pct": F.col("pct")})


def funnel(df: DataFrame, spec: dict) -> DataFrame:
    _need(df, spec.get("x"))
    if S.is_numeric(df, spec.get("y")):
        return bar(df, {"x": spec["x"], "y": spec["y"], "top_n": 8})
    return _counted(df, spec["x"], 8)


def cat_counts(df: DataFrame, spec: dict) -> DataFrame:
    x = spec.get("x") or spec.get("col")
    _need(df, x)
    return _counted(df, x, int(spec.get("top_n", 12)))


def waterfall(df: DataFrame, spec: dict) -> DataFrame:
    x, y = spec.get("x"), spec.get("y")
    _need(df, x)
    _need_numeric(df, y)
    first = S.top_rows(kpi.aggregate(df, [x], y), 10, col(x).asc_nulls_last())
    end = F.sum("value").over(Window.orderBy("ord").rowsBetween(Window.unboundedPreceding, 0))
    steps = first.withColumn("end", end).withColumn("start", F.col("end") - F.col("value"))
    return _long(
        steps, {"start": F.col("start"), "end": F.col("end"), "delta": F.col("value")}, S.label_of(col(x))
    )


def pareto(df: DataFrame, spec: dict) -> DataFrame:
    x, y = spec.get("x"), spec.get("y")
    _need(df, x)
    _need_numeric(df, y)
    best = kpi.group_agg(df, x, y, spec.get("agg", "sum"), 15, keep_null=False)
    kept = F.sum("value").over(Window.partitionBy())
    run = F.sum("value").over(Window.orderBy("ord").rowsBetween(Window.unboundedPreceding, 0))
    pct = F.round(run / F.when(kept == 0, 1.0).otherwise(kept) * 100, 2)
    return _long(best.withColumn("pct", pct), {"value": F.col("value"), "cumulative_pct": F.col("pct")})


def dual_axis(df: DataFrame, spec: dict) -> DataFrame:
    x, y1, y2 = spec.get("x"), spec.get("y"), spec.get("y2")
    _need(df, x)
    _need_numeric(df, y1, y2)
    flat = df.select(_axis(df, x).alias("__x"), col(y1).alias("a"), col(y2).alias("b")).dropna()
    sums = flat.groupBy("__x").agg(S.total(F.col("a")).alias("a"), S.total(F.col("b")).alias("b"))
    first = S.top_rows(sums, 30, F.col("__x"))
    return _long(first, {y1: F.col("a"), y2: F.col("b")}, F.col("__x").cast("string"))


# --- distributions ----------------------------------------------------------

def binned(df: DataFrame, name: str, bins: int, fit_to_rows: bool = True) -> DataFrame:
    """(ord, center, count, n, width): equal-width bins, the last one closed.

    A column without spread is widened by half a unit on both sides; empty bins
    are kept. Only the bin counts are shuffled.
    """
    _need_numeric(df, name)
    v = col(name).cast("double")
    row = df.agg(F.count(v).alias("n"), F.min(v).alias("lo"), F.max(v).alias("hi")).first()
    if not row["n"]:
        raise ChartSpecError(f"no data in {name!r}")
    n, lo, hi = row["n"], row["lo"], row["hi"]
    if fit_to_rows:
        bins = min(bins, max(5, n // 5 or 5))
    if lo == hi:
        lo, hi = lo - 0.5, hi + 0.5
    width = (hi - lo) / bins
    place = F.least(F.floor((v - F.lit(lo)) / F.lit(width)), F.lit(bins - 1)).cast("bigint")
    counts = df.filter(col(name).isNotNull()).groupBy(place.alias("id")).agg(F.count(F.lit(1)).alias("count"))
    spine = df.sparkSession.range(bins)
    center = F.lit(lo) + (F.col("id") + 0.5) * F.lit(width)
    return spine.join(counts, "id", "left").select(
        (F.col("id") + 1).alias("ord"), center.alias("center"),
        F.coalesce("count", F.lit(0).cast("bigint")).alias("count"), F.lit(n).alias("n"), F.lit(width).alias("width"),
    )


def histogram(df: DataFrame, spec: dict) -> DataFrame:
    name = spec.get("x") or spec.get("col")
    rows = binned(df, name, int(spec.get("bins", 20)), spec.get("fit_to_rows", True))
    digits = int(spec.get("digits", 4))
    return rows.select(
        "ord", F.round("center", digits).cast("string").alias("label"), F.lit("frequency").alias("series"),
        F.col("count").cast("double").alias("value"),
    )


def density(df: DataFrame, spec: dict) -> DataFrame:
    name = spec.get("x") or spec.get("col")
    rows = binned(df, name, int(spec.get("bins", 30)), fit_to_rows=False)
    height = rows.withColumn("h", F.col("count") / (F.col("n") * F.col("width")))
    w = Window.orderBy("ord")
    zero = F.lit(0.0)
    smooth = (F.coalesce(F.lag("h").over(w), zero) + F.col("h") + F.coalesce(F.lead("h").over(w), zero)) / 3
    return height.select(
        "ord", F.round("center", 4).cast("string").alias("label"), F.lit("density").alias("series"),
        F.round(smooth, 4).alias("value"),
    )


def box(df: DataFrame, spec: dict) -> DataFrame:
    name = spec.get("x") or spec.get("col")
    _need_numeric(df, name)
    return box_stats(df, [name])


def box_stats(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Box rows for several columns: two passes over the table in all."""
    q = column_quantiles(df, names, [0.25, 0.5, 0.75])
    items, aggs = [], []
    for i, c in enumerate(names):
        q1, q2, q3 = q[c]
        if q1 is None:
            if len(names) == 1:
                raise ChartSpecError(f"no data in {c!r}")
            continue
        v = col(c).cast("double")
        aggs += [
            F.min(v).alias(f"lo{i}"), S.mean(col(c)).alias(f"mu{i}"), F.max(v).alias(f"hi{i}"),
            F.count(F.when(profile.outside(col(c), q1, q3), 1)).alias(f"out{i}"),
        ]
        spread = profile.IQR_FENCE * (q3 - q1)
        items += [
            ("min", c, F.col(f"lo{i}")), ("q1", c, F.lit(q1)), ("median", c, F.lit(q2)), ("mean", c, F.col(f"mu{i}")),
            ("q3", c, F.lit(q3)), ("max", c, F.col(f"hi{i}")), ("outliers_low", c, F.lit(q1 - spread)),
            ("outliers_high", c, F.lit(q3 + spread)), ("n_outliers", c, F.col(f"out{i}")),
        ]
    if not items:
        raise ChartSpecError("no data in the chosen columns")
    return _facts(df.agg(*aggs), items)


def gauge(df: DataFrame, spec: dict) -> DataFrame:
    name = spec.get("x") or spec.get("col")
    _need_numeric(df, name)
    median = column_quantiles(df, [name], [0.5])[name][0]
    if median is None:
        raise ChartSpecError(f"no data in {name!r}")
    row = df.agg(S.mean(col(name)).alias("mu"), F.min(col(name)).alias("lo"), F.max(col(name)).alias("hi"))
    return _facts(
        row,
        [("value", name, F.col("mu")), ("min", name, F.col("lo")), ("max", name, F.col("hi")), ("median", name, F.lit(median))],
    )


def kpi_tile(df: DataFrame, spec: dict) -> DataFrame:
    name, agg = spec.get("x") or spec.get("col"), (spec.get("agg") or "sum").lower()
    _need_numeric(df, name)
    if agg == "median":
        return _facts(df.agg(F.count(F.lit(1))), [(name, agg, F.lit(column_quantiles(df, [name], [0.5])[name][0]))])
    f = S.AGGREGATES.get(agg, S.total)
    return _facts(df.agg(f(col(name)).alias("v")), [(name, agg, F.col("v"))])


def stats_bar(df: DataFrame, spec: dict) -> DataFrame:
    name = spec.get("x") or spec.get("col")
    _need_numeric(df, name)
    return stats_bars(df, [name])


def stats_bars(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Min, median and mean with half a deviation around the median, and max."""
    q = column_quantiles(df, names, [0.5])
    items, aggs = [], []
    for i, c in enumerate(names):
        v = col(c).cast("double")
        aggs += [
            F.min(v).alias(f"lo{i}"), S.mean(col(c)).alias(f"mu{i}"), F.max(v).alias(f"hi{i}"),
            (F.coalesce(S.sample_std(col(c)), F.lit(0.0)) * 0.5).alias(f"half{i}"),
        ]
        mid, half = F.lit(q[c][0]).cast("double"), F.col(f"half{i}")
        items += [
            ("Min", c, F.col(f"lo{i}")), ("Q1≈", c, mid - half), ("Median", c, mid), ("Mean", c, F.col(f"mu{i}")),
            ("Q3≈", c, mid + half), ("Max", c, F.col(f"hi{i}")),
        ]
    return _facts(df.agg(*aggs), items)


def radar(df: DataFrame, spec: dict) -> DataFrame:
    names = [c for c in (spec.get("cols") or S.numeric_columns(df)[: spec.get("max_cols")]) if S.is_numeric(df, c)]
    if len(names) < 3:
        raise ChartSpecError("need at least 3 numeric columns")
    q = column_quantiles(df, names, [0.5])
    aggs, items = [], []
    for i, c in enumerate(names):
        peak = F.max(F.abs(col(c).cast("double")))
        aggs += [S.mean(col(c)).alias(f"mu{i}"), F.when(peak == 0, 1.0).otherwise(peak).alias(f"peak{i}")]
        items += [
            (c, "mean", F.col(f"mu{i}") / F.col(f"peak{i}")),
            (c, "median", F.lit(q[c][0]).cast("double") / F.col(f"peak{i}")),
        ]
    return _facts(df.agg(*aggs), items)


def heatmap(df: DataFrame, spec: dict) -> DataFrame:
    limit, digits = int(spec.get("max_cols", 10)), int(spec.get("digits", 3))
    names = [c for c in (spec.get("cols") or S.numeric_columns(df)) if S.is_numeric(df, c)][:limit]
    if len(names) < 2:
        raise ChartSpecError("need at least 2 numeric columns")
    cells = profile.corr_matrix(df, names, digits, limit)
    place = F.array_position(F.array(*[F.lit(c) for c in names]), F.col("x")) * 100 + F.array_position(
        F.array(*[F.lit(c) for c in names]), F.col("y")
    )
    return cells.select(place.alias("ord"), F.col("x").alias("label"), F.col("y").alias("series"), F.col("r").alias("value"))


# --- point clouds -----------------------------------------------------------

def _points(df: DataFrame, spec: dict, names: list[str], n: int) -> DataFrame:
    """Seeded sample of complete points, numbered in sample order."""
    _need_numeric(df, *names)
    key = col(spec["key"]) if spec.get("key") else S.row_digest(df)
    flat = df.select(key.alias("__key"), *[col(c).cast("double").alias(f"v{i}") for i, c in enumerate(names)])
    full = flat.dropna(subset=[f"v{i}" for i in range(len(names))])
    sample = sample_n(full, n, "__key")
    return S.numbered(sample, S.seeded_hash(F.col("__key")), F.col("__key")).withColumn("label", F.col("ord").cast("string"))


def scatter(df: DataFrame, spec: dict) -> DataFrame:
    x, y = spec.get("x"), spec.get("y")
    rows = _points(df, spec, [x, y], int(spec.get("max_points", SCATTER_POINTS)))
    return _long(rows, {"x": F.col("v0"), "y": F.col("v1")})


def bubble(df: DataFrame, spec: dict) -> DataFrame:
    x, y, size = spec.get("x"), spec.get("y"), spec.get("r")
    rows = _points(df, spec, [x, y, size], int(spec.get("max_points", BUBBLE_POINTS)))
    all_points = Window.partitionBy()
    lo, hi = F.min("v2").over(all_points), F.max("v2").over(all_points)
    radius = F.round(4 + 20 * (F.col("v2") - lo) / F.when(hi == lo, 1.0).otherwise(hi - lo), 2)
    return _long(rows.withColumn("radius", radius), {"x": F.col("v0"), "y": F.col("v1"), "r": F.col("radius")})


# --- dispatch ---------------------------------------------------------------

BUILDERS: dict[str, Callable[[DataFrame, dict], DataFrame]] = {
    "bar": bar,
    "hbar": bar,
    "stacked_bar": stacked_bar,
    "grouped_bar": stacked_bar,
    "line": line,
    "area": line,
    "time_series": time_series,
    "multi_line": multi_line,
    "pie": pie,
    "donut": pie,
    "polar": pie,
    "histogram": histogram,
    "density": density,
    "box": box,
    "stats_bar": stats_bar,
    "scatter": scatter,
    "bubble": bubble,
    "radar": radar,
    "heatmap": heatmap,
    "treemap": treemap,
    "funnel": funnel,
    "gauge": gauge,
    "kpi_tile": kpi_tile,
    "waterfall": waterfall,
    "pareto": pareto,
    "cat_counts": cat_counts,
    "dual_axis": dual_axis,
}


def build_chart(df: DataFrame, chart_id: str, spec: dict) -> DataFrame:
    """Chart rows ``ord, label, series, value``; a bad request raises ChartSpecError."""
    if chart_id not in BUILDERS:
        raise ChartSpecError(f"unknown chart {chart_id!r}")
    try:
        return BUILDERS[chart_id](df, dict(spec))
    except (S.ColumnError, timeagg.SeriesError) as problem:
        raise ChartSpecError(str(problem)) from problem


def bi_chart(
    df: DataFrame, chart: str, x: str, y: str, color: str | None = None, agg: str = "sum", key: str | None = None
) -> DataFrame:
    """The report page's charts: top 20 bars, coloured series, pie 8, scatter,
    20-bin histogram and an 8-column heatmap, all rounded to 2 places."""
    agg = agg if agg in S.AGGREGATES else "sum"
    present = df.filter(col(x).isNotNull() & col(y).isNotNull()) if chart != "heatmap" else df
    if chart in ("bar", "line", "area"):
        _need_numeric(df, y)
        if color:
            rows = kpi.group_agg2(present, x, color, y, agg)
            return _placed(rows, "label", "series").select("ord", "label", "series", "value")
        return bar(present, {"x": x, "y": y, "agg": agg, "top_n": 20}).withColumn("value", F.round("value", 2))
    if chart == "pie":
        return bar(present, {"x": x, "y": y, "agg": agg, "top_n": 8}).withColumn("value", F.round("value", 2))
    if chart == "scatter":
        return scatter(present, {"x": x, "y": y, "key": key}).withColumn("value", F.round("value", 2))
    if chart == "histogram":
        return histogram(present, {"x": y, "bins": 20, "fit_to_rows": False, "digits": 2})
    if chart == "heatmap":
        return heatmap(df, {"max_cols": 8, "digits": 2})
    raise ChartSpecError(f"unknown chart type {chart!r}")


# --- chart pack -------------------------------------------------------------

def pack_scatter(df: DataFrame, roles: dict[str, str], key: str | None = None, n: int = SCATTER_POINTS) -> DataFrame:
    """(x, y, color, label): quantity against value, coloured by rate."""
    x, y = roles["qty"], roles["value"]
    rate, cat = roles.get("rate"), roles.get("category")
    needed = [c for c in (x, y, rate, cat) if c]
    order_key = col(key) if key else S.row_digest(df)
    sample = sample_n(df.withColumn("__key", order_key).dropna(subset=needed), n, "__key")
    return sample.select(
        col(x).cast("double").alias("x"),
        F.round(col(y).cast("double"), 2).alias("y"),
        (col(rate).cast("double") if rate else F.lit(0.0)).alias("color"),
        (col(cat).cast("string") if cat else F.lit("")).alias("label"),
    )


def chart_pack(df: DataFrame, roles: dict[str, str], heat_columns: int | None = None, box_columns: int | None = None) -> dict[str, DataFrame]:
    """All charts that the detected roles allow, by name, each a lazy frame.

    The heat map and the boxes show all numbers, or the first ``heat_columns`` and ``box_columns``.
    """
    value, date, cat = roles.get("value"), roles.get("date"), roles.get("category")
    region, person = roles.get("region"), roles.get("person")
    numbers = S.numeric_columns(df)
    out: dict[str, DataFrame] = {}
    if date and value:
        try:
            out["time_series"] = timeagg.auto_rollup(df, date, value, rule="legacy").select(
                "ord", "label", F.lit(value).alias("series"), "value"
            )
        except timeagg.SeriesError:
            pass  # a date role without one valid date draws no series
    if cat and value:
        named = df.filter(col(cat).isNotNull())
        out["bar_chart"] = bar(named, {"x": cat, "y": value}).withColumn("value", F.round("value", 2))
        out["pie_chart"] = bar(named, {"x": cat, "y": value, "top_n": 8}).withColumn("value", F.round("value", 2))
    if value:
        out["histogram"] = histogram(df, {"x": value, "bins": 20, "fit_to_rows": False, "digits": 2})
    if region and value:
        rows = kpi.hierarchy(df, region, person, value)
        out["treemap"] = _placed(rows, "parent", "label").select(
            "ord", "label", F.col("parent").alias("series"), "value"
        )
    if len(numbers) >= 3:
        shown = numbers[:heat_columns]
        out["heatmap"] = heatmap(df, {"cols": shown, "max_cols": len(shown), "digits": 2})
    if len(numbers) >= 2:
        out["box_plot"] = box_stats(df, numbers[:box_columns])
    return out


def chart_pack_long(df: DataFrame, roles: dict[str, str], parts: Sequence[str] | None = None) -> DataFrame:
    """The pack as one frame ``chart, ord, label, series, value``."""
    frames = [
        rows.select(F.lit(name).alias("chart"), "ord", "label", "series", "value")
        for name, rows in chart_pack(df, roles).items()
        if parts is None or name in parts
    ]
    if not frames:
        raise ChartSpecError("the detected roles allow no chart")
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


# --- extra panels -----------------------------------------------------------

def stats_panel(df: DataFrame, max_columns: int | None = None) -> DataFrame:
    return stats_bars(df, S.numeric_columns(df)[:max_columns])


def counts_panel(df: DataFrame, max_columns: int | None = None, k: int = 8) -> DataFrame:
    """Top values of each text column, from one shared value count."""
    rows = profile.category_distributions(df, S.text_columns(df)[:max_columns], k)
    return rows.select(F.col("rank").alias("ord"), F.col("value").alias("label"), F.col("column").alias("series"), F.col("count").cast("double").alias("value"))


def category_totals(df: DataFrame, value: str, categories: Sequence[str]) -> DataFrame:
    """(column, label, value): the value by each category, in one pass.

    Each row is unpivoted once per category and summed map-side.
    """
    entries = F.array(*[F.struct(F.lit(c).alias("column"), S.label_of(col(c)).alias("label")) for c in categories])
    tall = df.select(F.inline(entries), col(value).alias("v"))
    return tall.groupBy("column", "label").agg(F.round(S.total(F.col("v")), 2).alias("value"))
