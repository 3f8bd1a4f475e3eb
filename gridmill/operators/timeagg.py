"""Calendar rollups with empty periods, and features from ordered rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridmill.functions import semantics as S
from gridmill.functions.positions import look_back
from gridmill.functions.semantics import col
from gridmill.operators.kpi import aggregate

LEVELS = ("daily", "weekly", "monthly", "quarterly", "yearly")
_STEP = {
    "daily": "interval 1 day",
    "weekly": "interval 7 days",
    "monthly": "interval 1 month",
    "quarterly": "interval 3 months",
    "yearly": "interval 1 year",
}


class SeriesError(ValueError):
    """A time column without usable dates."""


def period_of(d: Column, level: str) -> Column:
    """The calendar day that names the period: its first day, or the closing
    Sunday of a week."""
    if level == "daily":
        return d.cast("date")
    if level == "weekly":
        return S.week_end(d)
    return F.trunc(d.cast("date"), {"monthly": "month", "quarterly": "quarter", "yearly": "year"}[level])


def period_label(period: Column, level: str) -> Column:
    if level == "weekly":
        return S.week_label(period)
    pattern = {"daily": "yyyy-MM-dd", "monthly": "yyyy-MM", "quarterly": "yyyy-'Q'q", "yearly": "yyyy"}[level]
    return F.date_format(period, pattern)


def dated(df: DataFrame, date: str, value: str, drop_null_value: bool = False) -> DataFrame:
    """(d, v): parsed time and number, rows without a date dropped."""
    S.require_numeric(df, value)
    flat = df.select(S.time_col(df, date).alias("d"), col(value).alias("v")).filter(F.col("d").isNotNull())
    return flat.filter(F.col("v").isNotNull()) if drop_null_value else flat


def time_rollups(df: DataFrame, date: str, value: str) -> DataFrame:
    """(level, label, value) sums for five calendar levels, empty periods as 0.

    The table is read and shuffled once, into one row per day; every coarser
    level and the calendar spine come from that small table.
    """
    flat = dated(df, date, value)
    daily = flat.groupBy(F.col("d").cast("date").alias("day")).agg(F.sum("v").alias("v"))
    ends = daily.agg(F.min("day").alias("lo"), F.max("day").alias("hi")).filter(F.col("lo").isNotNull())
    spine = None
    sums = None
    for level in LEVELS:
        s = ends.select(
            F.lit(level).alias("level"),
            F.explode(
                F.sequence(period_of(F.col("lo"), level), period_of(F.col("hi"), level), F.expr(_STEP[level]))
            ).alias("period"),
        )
        g = daily.groupBy(period_of(F.col("day"), level).alias("period")).agg(F.sum("v").alias("v"))
        g = g.withColumn("level", F.lit(level))
        spine = s if spine is None else spine.unionByName(s)
        sums = g if sums is None else sums.unionByName(g)
    label = F.lit(None).cast("string")
    for level in LEVELS:
        label = F.when(F.col("level") == level, period_label(F.col("period"), level)).otherwise(label)
    return spine.join(sums, ["level", "period"], "left").select(
        "level", label.alias("label"), F.round(F.coalesce(F.col("v").cast("double"), F.lit(0.0)), 2).alias("value")
    )


def resample(df: DataFrame, date: str, value: str, level: str, agg: str = "sum") -> DataFrame:
    """(period, value): one row per period from first to last.

    Sums and counts of empty periods are 0; other aggregates leave them out.
    """
    flat = dated(df, date, value).withColumn("period", period_of(F.col("d"), level))
    grouped = aggregate(flat, ["period"], "v", agg)
    if agg not in ("sum", "count"):
        return grouped.filter(F.col("value").isNotNull())
    ends = grouped.agg(F.min("period").alias("lo"), F.max("period").alias("hi")).filter(F.col("lo").isNotNull())
    spine = ends.select(F.explode(F.sequence("lo", "hi", F.expr(_STEP[level]))).alias("period"))
    return spine.join(grouped, "period", "left").select("period", F.coalesce("value", F.lit(0.0)).alias("value"))


def auto_level(df: DataFrame, date: str, value: str, rule: str = "chart") -> str:
    """The calendar level that suits the span of the dates."""
    ends = dated(df, date, value, drop_null_value=rule == "chart").agg(
        F.floor((F.unix_micros(F.max("d")) - F.unix_micros(F.min("d"))) / 86_400_000_000).alias("days")
    )
    days = ends.first()["days"]
    if days is None:
        raise SeriesError(f"no valid dates in {date!r}")
    if rule == "legacy":
        return "yearly" if days > 730 else "monthly" if days > 60 else "weekly"
    return "yearly" if days > 1460 else "monthly" if days > 90 else "weekly" if days > 14 else "daily"


def auto_rollup(df: DataFrame, date: str, value: str, agg: str = "sum", rule: str = "chart") -> DataFrame:
    """(ord, label, value, level) at the level chosen from the date span."""
    level = auto_level(df, date, value, rule)
    kept = df.filter(col(value).isNotNull()) if rule == "chart" else df
    rows = resample(kept, date, value, level, agg)
    label = period_label(F.col("period"), level)
    if rule == "legacy" and level == "weekly":
        label = F.date_format("period", "yyyy-MM-dd")
    digits = 2 if rule == "legacy" else 4
    return S.numbered(rows, F.col("period")).select(
        "ord", label.alias("label"), F.round("value", digits).alias("value"), F.lit(level).alias("level")
    )


# --- features from ordered rows ---------------------------------------------

def _order(df: DataFrame, date: str, tiebreak: str | None) -> list[Column]:
    tie = col(tiebreak) if tiebreak else S.row_digest(df)
    return [S.time_col(df, date).asc_nulls_last(), tie]


def lag_features(
    df: DataFrame, date: str, target: str, lags: int = 7, by: Sequence[str] = (), tiebreak: str | None = None
) -> DataFrame:
    """Add ``<target>_lag_1 … _lag_k`` in date order, per series when ``by`` is given."""
    S.require_numeric(df, target)
    return look_back(
        df, by, _order(df, date, tiebreak), lags,
        lambda w: {f"{target}_lag_{i}": F.lag(col(target), i).over(w) for i in range(1, lags + 1)},
    )


def _rolling(target: str, w, width: int) -> dict[str, Column]:
    frame = w.rowsBetween(-width, -1)
    full = F.count(col(target)).over(frame) == width
    value = col(target).cast("double")
    return {
        f"{target}_roll_mean_{width}": F.when(full, F.avg(value).over(frame)),
        f"{target}_roll_std_{width}": F.when(full, F.stddev_samp(value).over(frame)),
    }


def rolling_features(
    df: DataFrame, date: str, target: str, width: int = 7, by: Sequence[str] = (), tiebreak: str | None = None
) -> DataFrame:
    """Add mean and sample deviation of the ``width`` rows before each row."""
    S.require_numeric(df, target)
    return look_back(df, by, _order(df, date, tiebreak), width, lambda w: _rolling(target, w, width))


def calendar_features(df: DataFrame, date: str) -> DataFrame:
    t = S.time_col(df, date)
    return df.withColumns(
        {
            "month": F.month(t),
            "dayofweek": F.weekday(t),
            "quarter": F.quarter(t),
            "dayofyear": F.dayofyear(t),
            "year": F.year(t),
        }
    )


def prepare_time_series(
    df: DataFrame, date: str, target: str, lags: int = 7, by: Sequence[str] = (), tiebreak: str | None = None
) -> DataFrame:
    """Lags, rolling mean and deviation, calendar parts; incomplete rows dropped.

    All windows share one ordering, so the rows are sorted once.
    """
    S.require_numeric(df, target)

    def build(w) -> dict[str, Column]:
        cols = {f"{target}_lag_{i}": F.lag(col(target), i).over(w) for i in range(1, lags + 1)}
        return {**cols, **_rolling(target, w, 7)}

    featured = look_back(df, by, _order(df, date, tiebreak), max(lags, 7), build)
    return calendar_features(featured, date).dropna("any")


def cumulative(df: DataFrame, order: str, value: str) -> DataFrame:
    """(key, value, running, running_pct) over sums per key, in key order.

    Keys are summed before the running total; many keys go through positions
    and blocks rather than one window.
    """
    from gridmill.functions.positions import running_total

    grouped = aggregate(df.filter(col(order).isNotNull()), [order], value).withColumnRenamed(order, "key")
    out = running_total(grouped, F.col("key"), "value")
    whole = grouped.agg(F.sum("value")).scalar()
    return out.select(
        "key", F.round("value", 2).alias("value"), F.round("running", 2).alias("running"),
        F.round(F.try_divide(F.col("running"), whole) * 100, 2).alias("running_pct"),
    )


def top_k_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each key. Spark keeps only ``k`` per key and task
    before the shuffle, so a dominant key does not pile up."""
    from pyspark.sql import Window

    w = Window.partitionBy(*[col(c) for c in keys]).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w).cast("bigint")).filter(F.col("rank") <= k)
