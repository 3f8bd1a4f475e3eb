"""Anomaly bounds and trend forecasts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridmill.functions import semantics as S
from gridmill.functions.quantiles import column_quantiles
from gridmill.functions.semantics import col
from gridmill.operators import timeagg
from gridmill.operators.clean import sample_n
from gridmill.operators.profile import IQR_FENCE, outside


def iqr_bounds(df: DataFrame, name: str) -> tuple[float, float]:
    """Lower and upper fence of one column, from exact quartiles."""
    S.require_numeric(df, name)
    q1, q3 = column_quantiles(df, [name], [0.25, 0.75])[name]
    if q1 is None:
        raise S.ColumnError(f"no data in {name!r}")
    spread = IQR_FENCE * (q3 - q1)
    return q1 - spread, q3 + spread


def iqr_anomalies(df: DataFrame, name: str) -> DataFrame:
    """One row: total_anomalies, anomaly_pct, lower_bound, upper_bound."""
    lower, upper = iqr_bounds(df, name)
    v = col(name).cast("double")
    beyond = F.count(F.when((v < F.lit(lower)) | (v > F.lit(upper)), 1))
    return df.agg(
        beyond.alias("total_anomalies"),
        F.round(F.try_divide(beyond, F.count(F.lit(1))) * 100, 2).alias("anomaly_pct"),
        F.lit(round(lower, 2)).alias("lower_bound"),
        F.lit(round(upper, 2)).alias("upper_bound"),
    )


def anomaly_rows(df: DataFrame, name: str, key: str, outliers: int = 50, normal: int = 100) -> DataFrame:
    """(kind, key, value): the first outliers by key and a seeded normal sample.

    The fences are literals, so the outlier search is a pushed-down filter.
    """
    lower, upper = iqr_bounds(df, name)
    v = col(name).cast("double")
    beyond = (v < F.lit(lower)) | (v > F.lit(upper))
    shown = [col(key).alias("key"), F.round(v, 2).alias("value")]
    far = df.filter(beyond).select(F.lit("outlier").alias("kind"), *shown).orderBy("key").limit(outliers)
    near = df.filter(~beyond).select(F.lit("normal").alias("kind"), *shown)
    return far.unionByName(sample_n(near, normal, "key"))


def flag_anomalies(df: DataFrame, name: str) -> DataFrame:
    """Every row with an ``is_anomaly`` flag."""
    q1, q3 = column_quantiles(df, [name], [0.25, 0.75])[name]
    return df.withColumn("is_anomaly", F.coalesce(outside(col(name), q1, q3), F.lit(False)))


def trend_forecast(df: DataFrame, date: str, value: str, periods: int = 12) -> DataFrame:
    """(kind, label, value, slope): monthly means and the straight line beyond them.

    A month without rows is left out of the fit but keeps its place on the
    month axis.
    """
    months = timeagg.resample(df.filter(col(value).isNotNull()), date, value, "monthly", "mean")
    ends = months.agg(F.min("period").alias("first"), F.max("period").alias("last")).first()
    if ends["first"] is None:
        raise timeagg.SeriesError(f"no valid dates in {date!r}")
    first, last = ends["first"], ends["last"]
    n = (last.year - first.year) * 12 + last.month - first.month + 1
    if n < 4:
        raise timeagg.SeriesError("need at least 4 months for a forecast")
    place = (F.year("period") - first.year) * 12 + F.month("period") - first.month
    placed = months.withColumn("x", place.cast("double"))
    fit = placed.agg(
        F.regr_slope("value", "x").alias("slope"), F.regr_intercept("value", "x").alias("intercept")
    ).first()
    slope, intercept = fit["slope"], fit["intercept"]
    history = placed.select(
        F.lit("history").alias("kind"), F.date_format("period", "yyyy-MM").alias("label"), F.round("value", 2).alias("value")
    )
    ahead = df.sparkSession.range(n, n + periods).select(
        F.lit("forecast").alias("kind"),
        F.date_format(F.add_months(F.lit(first), F.col("id").cast("int")), "yyyy-MM").alias("label"),
        F.round(F.lit(intercept) + F.lit(slope) * F.col("id"), 2).alias("value"),
    )
    return history.unionByName(ahead).withColumn("slope", F.lit(round(slope, 4)))
