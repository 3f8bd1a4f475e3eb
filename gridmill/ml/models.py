"""Models that MLlib lacks, as sums over the table and column expressions.

Each ``fit_*`` reads the ``features`` vector and a numeric ``label`` column and
returns a model with ``transform`` (adds ``prediction``) and JSON state.
"""

from __future__ import annotations

import json
import threading
from collections.abc import Callable

import numpy as np
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridmill.functions import semantics as S
from gridmill.ml import neighbours
from gridmill.ml.moments import as_array, dot, gram, grouped_gram, mean_cov, quadratic
from gridmill.session import pinned


def _solve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    try:
        return np.linalg.solve(a, b)
    except np.linalg.LinAlgError:
        return np.linalg.lstsq(a, b, rcond=None)[0]


class ExpressionModel:
    """A model whose scores are literal column expressions over ``features``."""

    def __init__(self, kind: str, state: dict):
        self.kind, self.state = kind, state

    def transform(self, df: DataFrame) -> DataFrame:
        return _SCORERS[self.kind](self.state, df)

    def save(self, path: str) -> None:
        spark = SparkSession.getActiveSession()
        S.small_frame(spark, [(json.dumps({"kind": self.kind, "state": self.state}),)], "value string").write.text(path)

    @staticmethod
    def load(path: str) -> "ExpressionModel":
        spark = SparkSession.getActiveSession()
        return ExpressionModel(**json.loads(spark.read.text(path).first()[0]))


def _with_array(df: DataFrame, build: Callable[[Column], dict[str, Column]]) -> DataFrame:
    arr = df.withColumn("__x", as_array("features"))
    return arr.withColumns(build(F.col("__x"))).drop("__x")


def _score_linear(state: dict, df: DataFrame) -> DataFrame:
    return _with_array(df, lambda x: {"prediction": dot(x, state["coef"]) + F.lit(state["intercept"])})


def _decided(df: DataFrame, classes: list[float], scores: Column, probability: bool) -> DataFrame:
    """Prediction (the smaller class wins a tie) and probability from an array of
    scores, which is computed once as a column of its own."""
    out = df.withColumn("__s", scores)
    best = F.array_position("__s", F.array_max("__s")).cast("int")
    new = {"prediction": F.get(F.array(*[F.lit(float(c)) for c in classes]), best - 1)}
    if probability:
        top = F.array_max("__s")
        new["__e"] = F.transform("__s", lambda s: F.exp(s - top))
    out = out.withColumns(new)
    if probability:
        total = F.aggregate("__e", F.lit(0.0), lambda a, v: a + v)
        out = out.withColumn("probability", F.transform("__e", lambda v: v / total)).drop("__e")
    return out.drop("__s")


def _score_classes(state: dict, df: DataFrame) -> DataFrame:
    x = F.col("__x")
    if state.get("floor") is not None:
        floor = F.array(*[F.lit(float(v)) for v in state["floor"]])
        array = F.zip_with(as_array("features"), floor, lambda v, m: F.greatest(v - m, F.lit(0.0)))
    else:
        array = as_array("features")
    scores = []
    for w, b, center, m in zip(state["coef"], state["intercept"], state["center"], state["matrix"]):
        s = F.lit(b)
        if w is not None:
            s = s + dot(x, w)
        if m is not None:
            s = s - quadratic(x, center, np.array(m)) / 2
        scores.append(s)
    return _decided(df.withColumn("__x", array), state["classes"], F.array(*scores), state["probabilistic"]).drop("__x")


# --- linear regression variants ---------------------------------------------

def fit_ridge(df: DataFrame, alpha: float = 1.0) -> ExpressionModel:
    """Least squares with ``alpha`` times the squared coefficients, from one moment pass; the intercept is free."""
    m = gram(df, F.concat(as_array("features"), F.array(F.col("label").cast("double"))))
    n, mu, cov = mean_cov(m)
    w = _solve(cov[:-1, :-1] * n + alpha * np.eye(len(mu) - 1), cov[:-1, -1] * n)
    return ExpressionModel("linear", {"coef": w.tolist(), "intercept": float(mu[-1] - mu[:-1] @ w)})


def fit_bayesian_ridge(df: DataFrame, rounds: int = 300, tol: float = 1e-3) -> ExpressionModel:
    """Evidence maximisation on the moment matrix: the table is read once."""
    m = gram(df, F.concat(as_array("features"), F.array(F.col("label").cast("double"))))
    n, mu, cov = mean_cov(m)
    xx, xy, yy = cov[:-1, :-1] * n, cov[:-1, -1] * n, cov[-1, -1] * n
    values, vectors = np.linalg.eigh(xx)
    values = np.clip(values, 0, None)
    proj = vectors.T @ xy
    alpha, lam, w = 1.0 / max(yy / n, 1e-12), 1.0, np.zeros(len(xy))
    for _ in range(rounds):
        new = vectors @ (proj / (values + lam / alpha))
        rss = max(yy - 2 * new @ xy + new @ xx @ new, 0.0)
        gamma = float((alpha * values / (lam + alpha * values)).sum())
        lam = (gamma + 2e-6) / (float(new @ new) + 2e-6)
        alpha = (n - gamma + 2e-6) / (rss + 2e-6)
        done = np.abs(new - w).sum() < tol
        w = new
        if done:
            break
    return ExpressionModel(
        "linear", {"coef": w.tolist(), "intercept": float(mu[-1] - mu[:-1] @ w), "alpha": alpha, "lambda": lam}
    )


def fit_linear_svr(df: DataFrame, c: float = 1.0, epsilon: float = 0.0, rounds: int = 15, tol: float = 1e-4) -> ExpressionModel:
    """Linear support vector regression by reweighted least squares.

    Each round is one weighted moment pass: a row outside the tube counts with
    the inverse of its distance to the tube, a row inside not at all.
    """
    x, y = as_array("features"), F.col("label").cast("double")
    flat = df.select(x.alias("x"), y.alias("y"))
    m = gram(flat, F.concat("x", F.array("y")))
    d = len(m) - 2
    scale = max(float(np.sqrt(max(m[d, d] / m[-1, -1], 1e-12))), 1e-9)
    beta = _ridge_from(m, 1e-6)
    for _ in range(rounds):
        r = F.col("y") - dot(F.col("x"), beta[:-1]) - F.lit(float(beta[-1]))
        over = F.abs(r) - F.lit(epsilon)
        weight = F.when(over > 0, F.lit(c) / F.greatest(over, F.lit(1e-6 * scale))).otherwise(0.0)
        target = F.col("y") - F.lit(epsilon) * F.signum(r)
        m = gram(flat, F.concat("x", F.array(target)), weight)
        new = _ridge_from(m, 1.0)
        done = np.abs(new - beta).max() <= tol * max(1.0, np.abs(beta).max())
        beta = new
        if done:
            break
    return ExpressionModel("linear", {"coef": beta[:-1].tolist(), "intercept": float(beta[-1])})


def _ridge_from(m: np.ndarray, penalty: float) -> np.ndarray:
    """Weighted ridge [w…, intercept] from a moment matrix over [x…, y, 1]."""
    d = len(m) - 2
    keep = [*range(d), d + 1]
    a, b = m[np.ix_(keep, keep)].copy(), m[keep, d]
    a[np.arange(d), np.arange(d)] += penalty
    return _solve(a + 1e-12 * np.eye(d + 1), b)


# --- linear and quadratic classifiers ---------------------------------------

def _class_moments(df: DataFrame) -> dict[float, np.ndarray]:
    found = grouped_gram(df, as_array("features"), F.col("label"), F.col("weight") if "weight" in df.columns else None)
    return dict(sorted(found.items()))


def _class_state(classes, coef, intercept, center=None, matrix=None, probabilistic=True, floor=None) -> ExpressionModel:
    k = len(classes)
    return ExpressionModel(
        "classes",
        {
            "classes": [float(c) for c in classes],
            "coef": coef or [None] * k,
            "intercept": [float(b) for b in intercept],
            "center": center or [None] * k,
            "matrix": matrix or [None] * k,
            "probabilistic": probabilistic,
            "floor": floor,
        },
    )


def fit_ridge_classifier(df: DataFrame, alpha: float = 1.0) -> ExpressionModel:
    """Ridge on ±1 targets per class, all from the class moments."""
    moments = _class_moments(df)
    total = sum(moments.values())
    n, mu, cov = mean_cov(total)
    a = cov * n + alpha * np.eye(len(mu))
    coef, intercept = [], []
    for m in moments.values():
        share = m[-1, -1] / n
        ybar = 2 * share - 1
        xy = 2 * m[-1, :-1] - total[-1, :-1] - n * mu * ybar
        w = _solve(a, xy)
        coef.append(w.tolist())
        intercept.append(ybar - mu @ w)
    return _class_state(list(moments), coef, intercept, probabilistic=False)


def fit_lda(df: DataFrame) -> ExpressionModel:
    """Linear discriminant: class means with one pooled covariance."""
    moments = _class_moments(df)
    stats = {c: mean_cov(m) for c, m in moments.items()}
    n = sum(s[0] for s in stats.values())
    pooled = sum(s[0] * s[2] for s in stats.values()) / n
    inv = np.linalg.pinv(pooled)
    coef = [(inv @ s[1]).tolist() for s in stats.values()]
    intercept = [-0.5 * s[1] @ inv @ s[1] + np.log(s[0] / n) for s in stats.values()]
    return _class_state(list(moments), coef, intercept)


def fit_qda(df: DataFrame, floor: float = 1e-6) -> ExpressionModel:
    """Quadratic discriminant: a mean and covariance per class."""
    moments = _class_moments(df)
    stats = {c: mean_cov(m, ddof=1) for c, m in moments.items()}
    n = sum(s[0] for s in stats.values())
    center, matrix, intercept = [], [], []
    for size, mu, cov in stats.values():
        values, vectors = np.linalg.eigh(cov)
        values = np.maximum(values, floor * max(values.max(), 1e-12))
        center.append(mu.tolist())
        matrix.append((vectors / values @ vectors.T).tolist())
        intercept.append(np.log(size / n) - 0.5 * np.log(values).sum())
    return _class_state(list(moments), None, intercept, center, matrix)


def fit_multinomial_nb(df: DataFrame, alpha: float = 1.0) -> ExpressionModel:
    """Multinomial naive Bayes on features moved to start at 0.

    Counts cannot be negative, so each feature is taken relative to its smallest
    training value; a smaller value met later counts as 0.
    """
    floor = df.select(Summarizer.min(F.col("features")).alias("m")).first()["m"].toArray()
    moments = _class_moments(df)
    n = sum(m[-1, -1] for m in moments.values())
    coef, intercept = [], []
    for m in moments.values():
        counts = np.maximum(m[-1, :-1] - m[-1, -1] * floor, 0.0) + alpha
        coef.append(np.log(counts / counts.sum()).tolist())
        intercept.append(np.log(m[-1, -1] / n))
    return _class_state(list(moments), coef, intercept, floor=floor.tolist())


# --- nearest neighbours -----------------------------------------------------

class NeighbourModel:
    """The training rows themselves; a row is scored by its k nearest."""

    def __init__(self, train: DataFrame, k: int, classification: bool):
        self.train, self.k, self.classification = train, k, classification
        self._index, self._made = None, threading.Lock()

    def index(self) -> neighbours.Index:
        """Made once for all tables that are scored, also side by side."""
        with self._made:
            if self._index is None:
                self._index = neighbours.Index(self.train.select("id", "v"), self.k)
            return self._index

    def transform(self, df: DataFrame) -> DataFrame:
        keyed = pinned(df.withColumn("__id", F.monotonically_increasing_id()))
        found = self.index().search(keyed.select(F.col("__id").alias("id"), as_array("features").alias("v")))
        labels = self.train.select(F.col("id").alias("__nid"), "label")
        voted = found.join(labels, F.col("neighbour") == F.col("__nid")).select(F.col("id").alias("__qid"), "label")
        if self.classification:
            counts = voted.groupBy("__qid", "label").agg(F.count(F.lit(1)).alias("n"))
            best = counts.groupBy("__qid").agg(
                F.min_by("label", F.struct((-F.col("n")).alias("n"), F.col("label").alias("l"))).alias("prediction")
            )
        else:
            best = voted.groupBy("__qid").agg(F.avg("label").alias("prediction"))
        return keyed.join(best, F.col("__id") == F.col("__qid"), "left").drop("__id", "__qid")

    def save(self, path: str) -> None:
        spark = SparkSession.getActiveSession()
        state = {"k": self.k, "classification": self.classification}
        S.small_frame(spark, [(json.dumps(state),)], "value string").write.text(f"{path}/state")
        self.train.write.parquet(f"{path}/rows")

    @staticmethod
    def load(path: str) -> "NeighbourModel":
        spark = SparkSession.getActiveSession()
        state = json.loads(spark.read.text(f"{path}/state").first()[0])
        return NeighbourModel(spark.read.parquet(f"{path}/rows"), **state)


def fit_neighbours(df: DataFrame, k: int = 5, classification: bool = True) -> NeighbourModel:
    rows = df.select(F.monotonically_increasing_id().alias("id"), as_array("features").alias("v"), F.col("label").cast("double").alias("label"))
    return NeighbourModel(pinned(rows), k, classification)


_SCORERS = {"linear": _score_linear, "classes": _score_classes}
