"""Forecasts for many series at once.

Rows are first summed to one value per series and calendar period, so the
length of a series is bounded by the calendar and not by the number of rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridmill.functions import semantics as S
from gridmill.functions.semantics import col
from gridmill.operators.timeagg import period_of
from gridmill.session import stored


def series_table(df: DataFrame, by: str, date: str, value: str, level: str = "monthly", agg: str = "mean") -> DataFrame:
    """(series, ds, y): one value per series and period; empty periods are absent."""
    flat = df.select(S.label_of(col(by)).alias("series"), period_of(S.time_col(df, date), level).alias("ds"), col(value).alias("v"))
    return flat.filter(F.col("ds").isNotNull() & F.col("v").isNotNull()).groupBy("series", "ds").agg(
        S.AGGREGATES[agg](F.col("v")).alias("y")
    )


def _ahead(last: Column, step: Column, level: str) -> Column:
    if level in ("daily", "weekly"):
        return F.date_add(last, (step * (7 if level == "weekly" else 1)).cast("int"))
    months = {"monthly": 1, "quarterly": 3, "yearly": 12}[level]
    return F.add_months(last, (step * months).cast("int"))


_STEPS = {"daily": "1 day", "weekly": "7 days", "monthly": "1 month", "quarterly": "3 months", "yearly": "12 months"}


def spine(series: DataFrame, level: str = "monthly") -> DataFrame:
    """(series, ds, y, at): every calendar period from a series' first to its last, numbered from 0; y is null in a gap."""
    ends = series.groupBy("series").agg(F.min("ds").alias("first"), F.max("ds").alias("last"))
    step = F.expr(f"INTERVAL {_STEPS[level]}")
    every = ends.select("series", F.posexplode(F.sequence("first", "last", step)).alias("at", "ds"))
    known = series.select(F.col("series").alias("__s"), F.col("ds").alias("__d"), "y")
    return every.join(known, F.col("series").eqNullSafe(F.col("__s")) & (F.col("ds") == F.col("__d")), "left").select("series", "ds", "y", "at")


def naive_last(series: DataFrame, horizon: int, level: str = "monthly") -> DataFrame:
    """(series, ds, forecast): the last value, repeated."""
    last = series.groupBy("series").agg(F.max("ds").alias("last"), F.max_by("y", "ds").alias("forecast"))
    steps = last.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    return steps.select("series", _ahead(F.col("last"), F.col("step"), level).alias("ds"), "forecast")


def seasonal_naive(series: DataFrame, horizon: int, season: int = 12, level: str = "monthly") -> DataFrame:
    """(series, ds, forecast): the latest known value of the same place in the season; a series that is shorter than a
    season, or has no value for that place, repeats its last value."""
    placed = spine(series, level)
    known = placed.filter("y IS NOT NULL")
    whole = known.groupBy("series").agg(F.max("ds").alias("last"), F.max("at").alias("end"), F.max_by("y", "ds").alias("y_last"))
    by_place = known.groupBy(F.col("series").alias("s2"), (F.col("at") % season).alias("p2")).agg(F.max_by("y", "at").alias("y"))
    steps = whole.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon)))).withColumn("place", (F.col("end") + F.col("step")) % season)
    joined = steps.join(by_place, F.col("series").eqNullSafe(F.col("s2")) & (F.col("place") == F.col("p2")), "left")
    return joined.select(
        "series", _ahead(F.col("last"), F.col("step"), level).alias("ds"),
        F.when(F.col("end") + 1 >= season, F.coalesce("y", "y_last")).otherwise(F.col("y_last")).alias("forecast"),
    )


def arima(series: DataFrame, horizon: int, lags: int = 5, level: str = "monthly") -> DataFrame:
    """(series, ds, forecast): differences regressed on their own lags.

    Only differences of neighbouring periods count: a gap leaves out the rows whose lags reach it. Where the last periods have a
    gap, it is bridged by a straight line to roll forward from. The normal equations of every series are plain grouped sums; solving and
    rolling forward works on one small row per series.
    """
    order = Window.partitionBy("series").orderBy("ds")
    placed = spine(series, level)
    diff = placed.withColumn("d0", F.col("y") - F.lag("y").over(order))
    lagged = diff.withColumns({f"d{i}": F.lag("d0", i).over(order) for i in range(1, lags + 1)})
    full = F.col("d0").isNotNull()
    for i in range(1, lags + 1):
        full = full & F.col(f"d{i}").isNotNull()
    sums = [F.sum(F.when(full, F.col(f"d{i}") * F.col(f"d{j}"))).alias(f"s{i}_{j}") for i in range(lags + 1) for j in range(i, lags + 1)]
    back = Window.partitionBy("series").orderBy(F.desc("ds"))
    # the last known value before the window, for a line to start from
    back_to = F.last("y", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    recent = placed.withColumn("y", F.coalesce("y", F.when(F.row_number().over(back) == lags + 1, back_to))).withColumn("r", F.row_number().over(back)).filter(F.col("r") <= lags + 1)
    tails = recent.groupBy("series").agg(F.array_sort(F.collect_list(F.struct("ds", "y"))).alias("t")).select(
        "series", F.transform("t", lambda p: p["y"]).alias("tail"), F.element_at("t", -1)["ds"].alias("last")
    )
    rows = lagged.groupBy("series").agg(*sums).join(tails, "series")

    def roll(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                m = np.zeros((lags + 1, lags + 1))
                for i in range(lags + 1):
                    for j in range(i, lags + 1):
                        m[i, j] = m[j, i] = row[f"s{i}_{j}"]
                tail = np.asarray(row["tail"], dtype=float)
                held = np.isfinite(tail)
                tail = np.interp(np.arange(len(tail)), np.flatnonzero(held), tail[held])
                known = np.isfinite(m).all() and len(tail) == lags + 1
                w = np.linalg.lstsq(m[1:, 1:], m[1:, 0], rcond=None)[0] if known else np.zeros(lags)
                d, y = (list(np.diff(tail)[::-1]) if known else [0.0] * lags), tail[-1]
                for step in range(1, horizon + 1):
                    nxt = float(np.dot(w, d))
                    y, d = y + nxt, [nxt, *d[:-1]]
                    out.append((row["series"], row["last"], step, y))
            yield pd.DataFrame(out, columns=["series", "last", "step", "forecast"])

    done = rows.mapInPandas(roll, "series string, last date, step int, forecast double")
    return done.select("series", _ahead(F.col("last"), F.col("step"), level).alias("ds"), "forecast")


def holt_winters(series: DataFrame, horizon: int, season: int = 0, level: str = "monthly") -> DataFrame:
    """(series, ds, forecast): additive trend and, if asked, additive season.

    The smoothing weights are the best of a small grid by one-step error. In a gap the level follows the trend and nothing is learned.
    """
    grid = (0.1, 0.3, 0.5, 0.8)

    def smooth(y: np.ndarray, a: float, b: float, g: float) -> tuple[float, np.ndarray]:
        known = np.isfinite(y)
        m = season if season and len(y) >= 2 * season and known[:season].any() and known[season : 2 * season].any() else 0
        if m:
            lev = np.nanmean(y[:m])
            trend = (np.nanmean(y[m : 2 * m]) - lev) / m
            s = [v - lev if np.isfinite(v) else 0.0 for v in y[:m]]
        else:
            lev, trend, s = y[0], 0.0, [0.0]
            if known[1:].any():
                nearest = 1 + int(known[1:].argmax())
                trend = (y[nearest] - y[0]) / nearest
        sse = 0.0
        for t in range(m or 1, len(y)):
            base = s[t % m] if m else 0.0
            if not known[t]:
                lev += trend
                continue
            sse += (y[t] - lev - trend - base) ** 2
            new = a * (y[t] - base) + (1 - a) * (lev + trend)
            trend = b * (new - lev) + (1 - b) * trend
            if m:
                s[t % m] = g * (y[t] - new) + (1 - g) * base
            lev = new
        steps = np.arange(1, horizon + 1)
        add = np.array([s[(len(y) + h - 1) % m] for h in steps]) if m else 0.0
        return sse, lev + trend * steps + add

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ds")
        y = pdf["y"].to_numpy(dtype=float)
        tries = [smooth(y, a, b, g) for a in grid for b in grid for g in (grid if season else (0.0,))]
        best = min(tries, key=lambda r: r[0])[1]
        return pd.DataFrame(
            {"series": pdf["series"].iloc[0], "last": pdf["ds"].iloc[-1], "step": np.arange(1, horizon + 1), "forecast": best}
        )

    done = spine(series, level).select("series", "ds", "y").groupBy("series").applyInPandas(one, "series string, last date, step int, forecast double")
    return done.select("series", _ahead(F.col("last"), F.col("step"), level).alias("ds"), "forecast")


# --- stored forecasters -----------------------------------------------------

SEASONS = {"daily": 7, "weekly": 52, "monthly": 12, "quarterly": 4, "yearly": 1}
ALGORITHMS = ("naive_last", "seasonal_naive", "arima", "holt_winters")


@dataclass
class Forecaster:
    """A method, its settings, and the series it goes on from."""

    algo_id: str
    level: str
    series: DataFrame
    params: dict = field(default_factory=dict)

    def predict(self, horizon: int) -> DataFrame:
        """(series, ds, forecast) for the next ``horizon`` periods of each series."""
        season = self.params.get("season", SEASONS[self.level])
        if self.algo_id == "naive_last":
            return naive_last(self.series, horizon, self.level)
        if self.algo_id == "seasonal_naive":
            return seasonal_naive(self.series, horizon, season, self.level)
        if self.algo_id == "arima":
            return arima(self.series, horizon, self.params.get("lags", 5), self.level)
        return holt_winters(self.series, horizon, season if season > 1 else 0, self.level)

    def save(self, spark: SparkSession, path: str) -> None:
        state = {"algo_id": self.algo_id, "level": self.level, "params": self.params}
        S.small_frame(spark, [(json.dumps(state),)], "value string").write.text(f"{path}/forecaster")
        self.series.write.parquet(f"{path}/series")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "Forecaster":
        return Forecaster(series=spark.read.parquet(f"{path}/series"), **json.loads(spark.read.text(f"{path}/forecaster").first()[0]))


def level_of(df: DataFrame, date: str) -> str:
    """daily for up to 120 days, weekly for up to two years, else monthly."""
    t = S.time_col(df, date)
    days = df.agg(F.datediff(F.max(t), F.min(t))).first()[0] or 0
    return "daily" if days <= 120 else "weekly" if days <= 730 else "monthly"


def fit_forecaster(
    df: DataFrame, target: str, algo_id: str, date: str, by: Sequence[str] = (), params: dict | None = None, test_size: float = 0.2
) -> tuple[Forecaster, dict[str, float], DataFrame]:
    """(forecaster, scores, tested): values are averaged by series and period; the last share of the periods of the whole
    time axis is forecast from what comes before it and held against the actual values (series, ds, y, forecast).

    Options in ``params``: ``level``, ``agg``, and the method's own.
    """
    p = dict(params or {})
    level, agg = p.pop("level", None) or level_of(df, date), p.pop("agg", "mean")
    name = F.concat_ws(" / ", *[S.label_of(col(c)) for c in by]) if by else F.lit("all")
    named = df.select(name.alias("__series"), col(date).alias("__date"), col(target).alias("__value"))
    series = stored(series_table(named, "__series", "__date", "__value", level, agg), "series")
    periods = [r["ds"] for r in series.select("ds").distinct().orderBy("ds").collect()]  # as many as the calendar has
    if len(periods) < 2:
        raise S.ColumnError("need at least 2 periods")
    held = max(1, int(len(periods) * test_size))
    cut = periods[-held - 1]
    before, after = series.filter(F.col("ds") <= F.lit(cut)), series.filter(F.col("ds") > F.lit(cut))
    # a series that ends early is forecast up to the end of the axis
    reach = len(spine(series.agg(F.lit("all").alias("series"), F.min("ds").alias("a"), F.max("ds").alias("b")).selectExpr("series", "explode(array(a, b)) AS ds", "1.0D AS y"), level).collect())
    guess = Forecaster(algo_id, level, before, p).predict(reach)
    tested = after.join(guess.select(F.col("series").alias("__s"), F.col("ds").alias("__d"), "forecast"), F.col("series").eqNullSafe(F.col("__s")) & (F.col("ds") == F.col("__d"))).select("series", "ds", "y", "forecast")
    tested = stored(tested, "forecast-test")
    off = F.col("y") - F.col("forecast")
    row = tested.agg(
        F.avg(F.abs(off)).alias("mae"), F.sqrt(F.avg(off * off)).alias("rmse"), (F.avg(F.abs(F.try_divide(off, F.col("y")))) * 100).alias("mape"),
        (1 - F.try_divide(F.avg(off * off), F.var_pop("y"))).alias("r2"), F.count(F.lit(1)).alias("n_test"),
    ).first()
    scores = {k: round(float(row[k]), 4) for k in ("mae", "rmse", "mape", "r2") if row[k] is not None}
    return Forecaster(algo_id, level, series, p), {**scores, "n_train": float(before.count()), "n_test": float(row["n_test"])}, tested
