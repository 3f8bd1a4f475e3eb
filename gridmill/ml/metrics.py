"""Scores of predictions, each from one small aggregation."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridmill.functions import semantics as S
from gridmill.functions.pairs import correlations_from, pair_sums
from gridmill.functions.positions import running_total
from gridmill.functions.semantics import col

_EPS = 2.220446049250313e-16


def regression_exprs(y: Column, yhat: Column) -> dict[str, Column]:
    """rmse, mae, r2 and mape (in percent) as aggregate expressions."""
    y, yhat = y.cast("double"), yhat.cast("double")
    e = y - yhat
    r2 = 1 - F.try_divide(F.avg(e * e), F.var_pop(y))
    return {
        "rmse": F.sqrt(F.avg(e * e)),
        "mae": F.avg(F.abs(e)),
        "r2": r2,
        "mape": F.avg(F.abs(e) / F.greatest(F.abs(y), F.lit(_EPS))) * 100,
    }


def _items(row: DataFrame, items: Sequence[str], digits: dict[str, int] | None = None) -> DataFrame:
    pairs = [
        F.struct(F.lit(i).alias("metric"), F.round(F.col(i).cast("double"), (digits or {}).get(i, 4)).alias("value")) for i in items
    ]
    return row.select(F.inline(F.array(*pairs)))


def regression_metrics(df: DataFrame, y: str, yhat: str) -> DataFrame:
    """(metric, value)"""
    exprs = regression_exprs(col(y), col(yhat))
    row = df.agg(*[e.alias(k) for k, e in exprs.items()])
    return _items(row, list(exprs), {"mape": 2})


def confusion(df: DataFrame, y: str, yhat: str) -> DataFrame:
    """(actual, predicted, n, row_pct)"""
    cells = df.groupBy(col(y).cast("string").alias("actual"), col(yhat).cast("string").alias("predicted")).agg(
        F.count(F.lit(1)).alias("n")
    )
    totals = cells.groupBy(F.col("actual").alias("__a")).agg(F.sum("n").alias("__t"))
    return cells.join(totals, F.col("actual").eqNullSafe(F.col("__a"))).select(
        "actual", "predicted", "n", F.round(F.col("n") / F.col("__t") * 100, 2).alias("row_pct")
    )


def _per_class(cells: DataFrame) -> DataFrame:
    """(label, actual, predicted, hits, f1, …) from (y, yhat, n) cells."""
    both = F.array(
        F.struct(F.col("y").alias("label"), F.col("n").alias("actual"), F.lit(0).cast("bigint").alias("predicted"),
                 F.when(F.col("y") == F.col("yhat"), F.col("n")).otherwise(0).cast("bigint").alias("hits")),
        F.struct(F.col("yhat").alias("label"), F.lit(0).cast("bigint").alias("actual"), F.col("n").alias("predicted"),
                 F.lit(0).cast("bigint").alias("hits")),
    )
    sums = cells.select(F.inline(both)).groupBy("label").agg(
        F.sum("actual").alias("actual"), F.sum("predicted").alias("predicted"), F.sum("hits").alias("hits")
    )
    zero = F.lit(0.0)
    return sums.withColumns(
        {
            "precision": F.coalesce(F.try_divide(F.col("hits"), F.col("predicted")), zero),
            "recall": F.coalesce(F.try_divide(F.col("hits"), F.col("actual")), zero),
            "f1": F.coalesce(F.try_divide(2 * F.col("hits"), F.col("actual") + F.col("predicted")), zero),
        }
    )


CLASS_METRICS = ("accuracy", "balanced_accuracy", "precision", "recall", "f1", "f1_macro", "f1_weighted", "n_classes")


def class_scores(df: DataFrame, y: str, yhat: str) -> DataFrame:
    """One row of class metrics. With two classes precision, recall and f1 are
    those of the larger label; otherwise they are weighted by class size."""
    cells = df.groupBy(col(y).alias("y"), col(yhat).alias("yhat")).agg(F.count(F.lit(1)).alias("n"))
    per = _per_class(cells)
    seen = F.col("actual") > 0
    n = F.sum("actual")
    weighted = lambda c: F.try_divide(F.sum(F.col(c) * F.col("actual")), n)
    top = lambda c: F.max_by(F.when(seen, F.col(c)), F.when(seen, F.col("label")))
    two = F.count(F.when(seen, 1)) == 2
    return per.agg(
        F.try_divide(F.sum("hits"), n).alias("accuracy"),
        F.avg(F.when(seen, F.col("recall"))).alias("balanced_accuracy"),
        *[F.when(two, top(c)).otherwise(weighted(c)).alias(c) for c in ("precision", "recall", "f1")],
        F.avg("f1").alias("f1_macro"),
        weighted("f1").alias("f1_weighted"),
        F.count(F.when(seen, 1)).cast("double").alias("n_classes"),
    )


def classification_metrics(df: DataFrame, y: str, yhat: str) -> DataFrame:
    """(metric, value)"""
    return _items(class_scores(df, y, yhat), [m for m in CLASS_METRICS if m != "f1_weighted"])


def roc_auc(df: DataFrame, y: str, score: str) -> DataFrame:
    """One row (n_positive, n_negative, roc_auc); equal scores count half.

    Rows are folded to one row per distinct score before the running sum.
    """
    label = col(y).cast("double")
    per = df.filter(col(score).isNotNull()).groupBy(col(score).cast("double").alias("s")).agg(
        F.count(F.when(label > 0, 1)).alias("pos"), F.count(F.when(label <= 0, 1)).alias("neg")
    )
    run = running_total(per, F.col("s"), "neg", "upto")
    p, n = F.sum("pos"), F.sum("neg")
    wins = F.sum(F.col("pos") * (F.col("upto") - F.col("neg") / 2))
    return run.agg(
        p.alias("n_positive"), n.alias("n_negative"), F.round(F.try_divide(wins, p * n), 4).alias("roc_auc")
    )


def univariate_scores(df: DataFrame, target: str, classification: bool, k: int | None = None) -> DataFrame:
    """(feature, score): the F statistic of each number column, or the ``k`` best, best first."""
    names = [c for c in S.numeric_columns(df) if c != target]
    if classification:
        scores = _anova(df, target, names)
    else:
        n, *_ = pair = pair_sums(df, [*names, target])
        r = correlations_from(pair)[:-1, -1]
        f = r * r / (1 - r * r) * (n[:-1, -1] - 2)
        rows = [(c, None if np.isnan(v) else float(v)) for c, v in zip(names, f)]
        scores = S.small_frame(df.sparkSession, rows, "feature string, score double")
    best = scores.select("feature", F.round("score", 4).alias("score"))
    ordered = best.orderBy(F.desc_nulls_last("score"), "feature")
    return ordered if k is None else ordered.limit(k)


def _anova(df: DataFrame, target: str, names: Sequence[str]) -> DataFrame:
    flat = df.filter(col(target).isNotNull())
    stats = flat.groupBy(col(target).alias("label")).agg(
        *[
            f(col(c).cast("double")).alias(f"{k}{i}")
            for i, c in enumerate(names)
            for k, f in (("n", F.count), ("m", F.avg), ("v", F.var_pop))
        ]
    )
    tall = stats.select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(c).alias("feature"), F.col(f"n{i}").alias("n"), F.col(f"m{i}").alias("m"), F.col(f"v{i}").alias("v"))
                    for i, c in enumerate(names)
                ]
            )
        )
    ).filter("n > 0")
    whole = F.sum(F.col("n") * F.col("m")) / F.sum("n")
    between = F.sum(F.col("n") * F.col("m") * F.col("m")) - F.sum("n") * whole * whole
    within = F.sum(F.col("n") * F.col("v"))
    k = F.count(F.lit(1))
    return tall.groupBy("feature").agg(
        F.try_divide(F.try_divide(between, k - 1), F.try_divide(within, F.sum("n") - k)).alias("score")
    )


def residuals(df: DataFrame, y: str, yhat: str, key: str, n: int | None = None) -> DataFrame:
    """(key, actual, predicted, residual) of all rows, or of the first ``n`` by key."""
    a, p = col(y).cast("double"), col(yhat).cast("double")
    rows = df.select(col(key).alias("key"), a.alias("actual"), p.alias("predicted"), F.round(a - p, 4).alias("residual"))
    return rows if n is None else rows.orderBy("key").limit(n)


def error_rates(df: DataFrame, y: str, yhat: str) -> DataFrame:
    """(label, n, error_rate) per actual class."""
    wrong = F.when(col(y).cast("string") != col(yhat).cast("string"), 1.0).otherwise(0.0)
    return df.groupBy(col(y).cast("string").alias("label")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(wrong), 4).alias("error_rate")
    )
