"""Headline numbers, grouped totals, hierarchies and period growth."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridmill.functions import semantics as S
from gridmill.functions.quantiles import grouped_quantile, value_at_rank
from gridmill.functions.semantics import col
from gridmill.operators.clean import duplicate_count
from gridmill.operators.profile import completeness, distinct_counts
from gridmill.operators.typing import detect_kpi_roles

SMALL_ROWS = 1_000_000  # rows that one window may number


# --- grouped aggregates -----------------------------------------------------

def aggregate(df: DataFrame, keys: Sequence[str], value: str, agg: str = "sum", name: str = "value") -> DataFrame:
    """(keys…, value) with one of sum, mean, median, max, min, count."""
    S.require_numeric(df, value)
    S.require(df, *keys)
    agg = (agg or "sum").lower()
    if agg == "median":
        return grouped_quantile(df, keys, value, 0.5, name)
    f = S.AGGREGATES.get(agg, S.total)
    return df.groupBy(*[col(k) for k in keys]).agg(f(col(value)).alias(name))


def group_agg(df: DataFrame, x: str, y: str, agg: str = "sum", n: int = 15, keep_null: bool = True) -> DataFrame:
    """(ord, label, value): the ``n`` largest groups, ties by label."""
    if not keep_null:
        df = df.filter(col(x).isNotNull())
    grouped = aggregate(df, [x], y, agg).select(S.label_of(col(x)).alias("label"), F.round("value", 4).alias("value"))
    return S.top_rows(grouped, n, F.col("value").desc_nulls_last(), F.col("label")).select("ord", "label", "value")


def group_agg2(df: DataFrame, x: str, color: str, y: str, agg: str = "sum") -> DataFrame:
    """(label, series, value): one series per colour value.

    Rows carry their own label, so a series with gaps stays aligned.
    """
    present = df.filter(col(x).isNotNull() & col(y).isNotNull() & col(color).isNotNull())
    return aggregate(present, [x, color], y, agg).select(
        S.label_of(col(x)).alias("label"), S.label_of(col(color)).alias("series"), F.round("value", 2).alias("value")
    )


def hierarchy(df: DataFrame, parent: str, child: str | None, value: str) -> DataFrame:
    """(label, parent, value) totals: All, each parent, each (parent, child)."""
    present = df.filter(col(parent).isNotNull())
    if child is None:
        rolled = present.rollup(col(parent).alias("__p")).agg(S.total(col(value)).alias("v"), F.grouping_id().alias("g"))
        top = F.col("g") == 1
        return rolled.select(
            F.when(top, "All").otherwise(F.col("__p").cast("string")).alias("label"),
            F.when(top, "").otherwise("All").alias("parent"),
            F.round("v", 2).alias("value"),
        )
    present = present.filter(col(child).isNotNull())
    rolled = present.rollup(col(parent).alias("__p"), col(child).alias("__c")).agg(
        S.total(col(value)).alias("v"), F.grouping_id().alias("g")
    )
    p, c = F.col("__p").cast("string"), F.col("__c").cast("string")
    return rolled.select(
        F.when(F.col("g") == 3, "All").when(F.col("g") == 1, p).otherwise(c).alias("label"),
        F.when(F.col("g") == 3, "").when(F.col("g") == 1, "All").otherwise(p).alias("parent"),
        F.round("v", 2).alias("value"),
    )


# --- KPIs -------------------------------------------------------------------

def kpis(df: DataFrame, roles: dict[str, str] | None = None, growth: float | None = None) -> DataFrame:
    """(kpi, label, value, fmt) from one aggregation.

    ``growth`` adds the period growth computed by ``period_growth``.
    """
    roles = detect_kpi_roles(df) if roles is None else roles
    value, qty, cat = roles.get("value"), roles.get("qty"), roles.get("category")
    entries: list[tuple[str, str, Column, str]] = []
    if value:
        v, name = col(value), S.titled(value)
        entries += [
            ("total_value", f"Total {name}", S.total(v), "currency"),
            ("avg_value", f"Avg {name}", S.mean(v), "currency"),
            ("max_value", f"Peak {name}", F.max(v).cast("double"), "currency"),
            ("min_value", f"Min {name}", F.min(v).cast("double"), "number"),
        ]
    if growth is not None:
        entries.append(("growth_rate", "Period Growth", F.lit(float(growth)), "percent"))
    entries += [
        ("total_records", "Total Records", F.count(F.lit(1)).cast("double"), "number"),
        ("total_columns", "Features", F.lit(float(len(df.columns))), "number"),
    ]
    if qty:
        entries.append(("total_qty", f"Total {S.titled(qty)}", F.floor(S.total(col(qty))).cast("double"), "number"))
    wide = df.agg(*[e[2].alias(e[0]) for e in entries])
    if cat:
        entries.append(("unique_categories", f"Unique {S.titled(cat)}", None, "number"))
        n = distinct_counts(df, [cat]).select(F.col("n_unique").cast("double")).scalar()
        wide = wide.withColumn("unique_categories", n)
    rows = F.array(
        *[
            F.struct(
                F.lit(k).alias("kpi"), F.lit(label).alias("label"), F.round(F.col(k), 2).alias("value"), F.lit(fmt).alias("fmt")
            )
            for k, label, _, fmt in entries
        ]
    )
    return wide.select(F.inline(rows))


def period_growth(df: DataFrame, date: str, value: str, tiebreak: str | None = None) -> DataFrame:
    """One row (n_rows, first_half, second_half, growth_pct).

    Rows are cut in two halves in the total order (date, tie-break, value), nulls first. Rows that are
    equal in all three are interchangeable, so the answer does not depend on how the cut is found: by position in
    small inputs, else one key at a time, which orders only the rows that the keys before leave on the cut.
    """
    if tiebreak:
        S.require_numeric(df, tiebreak)
    flat = df.select(
        S.time_col(df, date).alias("d"),
        _nan_as_null(df, value).alias("v"),
        (_nan_as_null(df, tiebreak) if tiebreak else S.row_digest(df)).alias("t"),
    ).filter(F.col("d").isNotNull())
    rows = flat.count()
    half = rows // 2
    if rows <= SMALL_ROWS:
        place = F.row_number().over(Window.orderBy("d", "t", "v"))
        return _halves(flat, place <= half, None, 0)
    before, cut, left = _day_cut(flat, half)
    for name in ("d", "t", "v"):
        key = F.unix_micros("d") if name == "d" else F.col(name)
        here = flat.filter(cut).select(key.alias("k"))
        nulls = here.filter("k IS NULL").count()
        if left < nulls:
            cut = cut & key.isNull()
            continue
        known = here.filter("k IS NOT NULL")
        at = value_at_rank(known, "k", left - nulls, known.count())
        less = key.isNull() | (key < F.lit(at))
        left -= nulls + known.filter(F.col("k") < F.lit(at)).count()
        before, cut = before | (cut & less), cut & (key == F.lit(at))
    # null comparisons count as false
    return _halves(flat, F.coalesce(before, F.lit(False)), F.coalesce(cut, F.lit(False)), left)


def _nan_as_null(df: DataFrame, name: str) -> Column:
    kind = dict(df.dtypes)[name]
    return F.when(~F.isnan(col(name)), col(name)) if kind in ("double", "float") else col(name)


def _day_cut(flat: DataFrame, half: int) -> tuple[Column, Column, int]:
    """Rows before the day on the cut, rows of that day, and how many of the latter belong to the first half."""
    day = F.date_trunc("day", "d")
    per_day = flat.groupBy(day.alias("day")).agg(F.count(F.lit(1)).alias("n"))
    # one row per calendar day, so the running count stays small
    upto = F.sum("n").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0))
    found = per_day.withColumn("end", upto).filter((F.col("end") > half) & (F.col("end") - F.col("n") <= half)).first()
    if found is None:
        return F.lit(False), F.lit(False), 0
    return day < F.lit(found["day"]), day == F.lit(found["day"]), half - (found["end"] - found["n"])


def _halves(flat: DataFrame, first: Column, cut: Column | None, of_cut: int) -> DataFrame:
    """Sums of both halves; of the equal rows in ``cut``, ``of_cut`` belong to the first."""
    on_cut = F.lit(False) if cut is None else cut
    marked = flat.withColumns({"first": first, "cut": on_cut})
    sums = marked.agg(
        F.count(F.lit(1)).alias("n_rows"),
        S.total(F.when(F.col("first"), F.col("v"))).alias("a"),
        S.total(F.when(~F.col("first") & ~F.col("cut"), F.col("v"))).alias("b"),
        F.count(F.when(F.col("cut"), 1)).alias("on_cut"),
        F.max(F.when(F.col("cut"), F.col("v"))).cast("double").alias("each"),
    )
    share = lambda n: F.coalesce(F.col("each"), F.lit(0.0)) * n
    halves = sums.withColumns({"a": F.col("a") + share(F.lit(of_cut)), "b": F.col("b") + share(F.col("on_cut") - of_cut)})
    change = F.when(F.col("a") > 0, F.round((F.col("b") - F.col("a")) / F.col("a") * 100, 2))
    return halves.select(
        "n_rows", F.round("a", 2).alias("first_half"), F.round("b", 2).alias("second_half"), change.alias("growth_pct")
    )


def refresh_kpis(df: DataFrame, roles: dict[str, str] | None = None, tiebreak: str | None = None) -> DataFrame:
    """All KPIs again on the current table, growth included when there is a date."""
    roles = detect_kpi_roles(df) if roles is None else roles
    growth = None
    if roles.get("value") and roles.get("date"):
        growth = period_growth(df, roles["date"], roles["value"], tiebreak).first()["growth_pct"]
    return kpis(df, roles, growth)


def dashboard_kpis(df: DataFrame, roles: dict[str, str] | None = None, tiebreak: str | None = None) -> DataFrame:
    """Rows, columns, completeness and duplicates, then the value KPIs, on full data."""
    facts = completeness(df).withColumn("duplicates", duplicate_count(df).scalar())
    missing_pct = F.round(F.coalesce(F.try_divide(F.col("total_missing"), F.col("total_cells")), F.lit(0.0)) * 100, 1)
    head = [
        ("total_rows", "Total Records", F.col("n_rows"), "number"),
        ("total_cols", "Total Columns", F.col("n_cols"), "number"),
        ("completeness", "Completeness", F.round(F.lit(100.0) - missing_pct, 1), "percent"),
        ("duplicates", "Duplicate Rows", F.col("duplicates"), "number"),
    ]
    rows = F.array(
        *[
            F.struct(F.lit(k).alias("kpi"), F.lit(l).alias("label"), v.cast("double").alias("value"), F.lit(f).alias("fmt"))
            for k, l, v, f in head
        ]
    )
    return facts.select(F.inline(rows)).unionByName(refresh_kpis(df, roles, tiebreak))


def value_summary(df: DataFrame, value: str, qty: str | None = None) -> DataFrame:
    """One row: total, records, avg, max, columns, qty_total."""
    return df.agg(
        F.round(S.total(col(value)), 2).alias("total"),
        F.count(F.lit(1)).alias("records"),
        F.round(S.mean(col(value)), 2).alias("avg"),
        F.round(F.max(col(value)).cast("double"), 2).alias("max"),
        F.lit(len(df.columns)).alias("columns"),
        (F.floor(S.total(col(qty))).cast("bigint") if qty else F.lit(0).cast("bigint")).alias("qty_total"),
    )


def share_of_total(df: DataFrame, x: str, y: str) -> DataFrame:
    """(label, value, pct): every group's sum and its share of all groups."""
    grouped = aggregate(df.filter(col(x).isNotNull()), [x], y).select(S.label_of(col(x)).alias("label"), "value")
    whole = grouped.agg(F.sum("value")).scalar()
    return grouped.withColumn("pct", F.round(F.try_divide(F.col("value"), whole) * 100, 1))
