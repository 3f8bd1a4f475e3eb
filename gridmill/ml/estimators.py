"""Algorithm ids mapped to estimators over ``features`` and ``label``.

A factory takes the user's parameters and a ``Context`` and returns something
with ``fit(df)``; boosted-tree ids share one operator.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml import Pipeline
from pyspark.ml import classification as C
from pyspark.ml import regression as R
from pyspark.ml.feature import Binarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridmill.functions.semantics import SEED
from gridmill.ml import histtrees, models

MAX_DEPTH = 10  # grown trees stop here unless the caller asks for another depth
DEEPEST = 30  # what MLlib's trees allow


@dataclass(frozen=True)
class Context:
    n_rows: int
    n_features: int
    n_classes: int = 0
    weighted: bool = False


class Fitter:
    """A plain function as an estimator; ``fit_many`` fits several tables together."""

    def __init__(self, fit: Callable[[DataFrame], object] | None = None, fit_many: Callable[[list[DataFrame]], list] | None = None):
        self.fit = fit or (lambda df: fit_many([df])[0])
        self.fit_many = fit_many


def _weights(ctx: Context) -> dict:
    return {"weightCol": "weight"} if ctx.weighted else {}


def _linear(alpha: float = 0.0, l1: float = 0.0, **more) -> Callable:
    return R.LinearRegression(regParam=alpha, elasticNetParam=l1, standardization=False, **more)


def _elastic(alpha: float, share: float) -> Fitter:
    """Squares / 2n + alpha * (share * sum |w| + (1 - share) / 2 * sum w²).

    MLlib divides the whole penalty by the label's deviation where only the absolute part should be, so the squared part is given times that.
    """

    def fit(df: DataFrame):
        spread = df.agg(F.stddev_pop("label")).first()[0] or 1.0
        first, second = alpha * share, alpha * (1 - share) * spread
        return Pipeline(stages=[_linear(first + second, first / (first + second) if first + second else 0.0)]).fit(df)

    return Fitter(fit)


def _depth(p: dict, default: int = MAX_DEPTH) -> int:
    depth = p.get("max_depth") or default
    if depth > DEEPEST:
        raise ValueError(f"max_depth may be {DEEPEST} at most, not {depth}")
    return depth


def _min_split(p: dict) -> dict:
    """A node with s rows to split keeps at least s // 2 in its smaller child."""
    return {"minInstancesPerNode": max(1, p.get("min_samples_split", 2) // 2)}


def _forest(kind: str, p: dict, ctx: Context, n: int = 200, **more):
    cls = C.RandomForestClassifier if kind == "clf" else R.RandomForestRegressor
    # rows remember the node they have reached in each tree; without that every level walks all trees from their roots again
    return cls(numTrees=p.get("n_estimators", n), maxDepth=_depth(p), seed=SEED, cacheNodeIds=True, **_min_split(p), **_weights(ctx), **more)


def _boosted(kind: str, p: dict, ctx: Context, depth: int = 5, n: int = 100):
    if kind == "clf" and ctx.n_classes > 2:
        return _histogram(kind, p, ctx, depth, n, min_rows=1)
    shared = dict(
        maxIter=p.get("n_estimators", n), stepSize=p.get("learning_rate", 0.1), maxDepth=_depth(p, depth),
        subsamplingRate=p.get("subsample", 1.0), seed=SEED,
    )
    return R.GBTRegressor(**shared) if kind == "reg" else C.GBTClassifier(**shared, **_weights(ctx))


def _histogram(kind: str, p: dict, ctx: Context, depth: int = 5, n: int = 100, min_rows: int = 20):
    """Boosting on binned features: one booster for all classes, and missing values have a bin."""
    options = dict(
        rounds=p.get("n_estimators", p.get("max_iter", n)), depth=_depth(p, depth), rate=p.get("learning_rate", 0.1),
        subsample=p.get("subsample", 1.0), min_rows=p.get("min_samples_leaf", min_rows), l2=p.get("l2_regularization", 0.0),
    )
    classes = max(2, ctx.n_classes) if kind == "clf" else 0
    return Fitter(fit_many=lambda tables: histtrees.fit_boosted(tables, classes, **options))


def _adaboost(kind: str, p: dict, ctx: Context):
    rounds, rate = p.get("n_estimators", 50), p.get("learning_rate", 1.0)
    if kind == "reg":
        return Fitter(fit_many=lambda tables: histtrees.fit_adaboost_regressor(tables, rounds, _depth(p, 3), rate))
    return Fitter(fit_many=lambda tables: histtrees.fit_adaboost_classifier(tables, max(2, ctx.n_classes), rounds, _depth(p, 1), rate))


def _svc(p: dict, ctx: Context):
    base = C.LinearSVC(regParam=1.0 / (p.get("C", 1.0) * ctx.n_rows), maxIter=p.get("max_iter", 50))
    if ctx.n_classes <= 2:
        return base.setWeightCol("weight") if ctx.weighted else base
    return C.OneVsRest(classifier=base, **_weights(ctx))


def _bernoulli_nb(p: dict, ctx: Context):
    bits = Binarizer(inputCol="features", outputCol="bits", threshold=0.0)
    return Pipeline(stages=[bits, C.NaiveBayes(featuresCol="bits", modelType="bernoulli", smoothing=p.get("alpha", 1.0), **_weights(ctx))])


def _mlp(p: dict, ctx: Context):
    hidden = list(p.get("hidden_layer_sizes", (64, 32)))
    return C.MultilayerPerceptronClassifier(
        layers=[ctx.n_features, *hidden, max(2, ctx.n_classes)], maxIter=p.get("max_iter", 300), seed=SEED
    )


Factory = Callable[[dict, Context], object]
FACTORIES: dict[str, Factory] = {
    "linear_regression": lambda p, c: _linear(),
    "ridge": lambda p, c: Fitter(lambda df: models.fit_ridge(df, p.get("alpha", 1.0))),
    "lasso": lambda p, c: _linear(p.get("alpha", 0.1), 1.0),
    "elasticnet": lambda p, c: _elastic(p.get("alpha", 0.1), p.get("l1_ratio", 0.5)),
    "bayesian_ridge": lambda p, c: Fitter(models.fit_bayesian_ridge),
    "huber": lambda p, c: R.LinearRegression(loss="huber", epsilon=p.get("epsilon", 1.35), regParam=p.get("alpha", 1e-4), maxIter=p.get("max_iter", 100)),
    "sgd_regressor": lambda p, c: _linear(p.get("alpha", 1e-4), solver="l-bfgs"),
    "svr_linear": lambda p, c: Fitter(lambda df: models.fit_linear_svr(df, p.get("C", 1.0), p.get("epsilon", 0.0), p.get("max_iter", 15))),
    "decision_tree_reg": lambda p, c: R.DecisionTreeRegressor(maxDepth=_depth(p), seed=SEED, **_min_split(p)),
    "random_forest_reg": lambda p, c: _forest("reg", p, c),
    "extra_trees_reg": lambda p, c: _forest("reg", p, c, bootstrap=False, maxBins=8),
    "bagging_reg": lambda p, c: _forest("reg", p, c, n=50, featureSubsetStrategy="all"),
    "gradient_boosting_reg": lambda p, c: _boosted("reg", p, c, depth=3),
    "adaboost_reg": lambda p, c: _adaboost("reg", p, c),
    "knn_reg": lambda p, c: Fitter(lambda df: models.fit_neighbours(df, p.get("n_neighbors", 5), False)),
    "logistic_regression": lambda p, c: C.LogisticRegression(
        regParam=1.0 / (p.get("C", 1.0) * c.n_rows), maxIter=p.get("max_iter", 100), standardization=False, **_weights(c)
    ),
    "ridge_classifier": lambda p, c: Fitter(lambda df: models.fit_ridge_classifier(df, p.get("alpha", 1.0))),
    "sgd_classifier": lambda p, c: C.LogisticRegression(regParam=p.get("alpha", 1e-4), maxIter=p.get("max_iter", 100), **_weights(c)),
    "knn_clf": lambda p, c: Fitter(lambda df: models.fit_neighbours(df, p.get("n_neighbors", 5), True)),
    "gaussian_nb": lambda p, c: C.NaiveBayes(modelType="gaussian", **_weights(c)),
    "multinomial_nb": lambda p, c: Fitter(lambda df: models.fit_multinomial_nb(df, p.get("alpha", 1.0))),
    "bernoulli_nb": _bernoulli_nb,
    "linear_svc": _svc,
    "decision_tree_clf": lambda p, c: C.DecisionTreeClassifier(maxDepth=_depth(p), seed=SEED, **_min_split(p), **_weights(c)),
    "random_forest_clf": lambda p, c: _forest("clf", p, c),
    "extra_trees_clf": lambda p, c: _forest("clf", p, c, bootstrap=False, maxBins=8),
    "bagging_clf": lambda p, c: _forest("clf", p, c, n=50, featureSubsetStrategy="all"),
    "gradient_boosting_clf": lambda p, c: _boosted("clf", p, c, depth=3),
    "adaboost_clf": lambda p, c: _adaboost("clf", p, c),
    "lda": lambda p, c: Fitter(models.fit_lda),
    "qda": lambda p, c: Fitter(models.fit_qda),
    "mlp_clf": _mlp,
    "ml_lag_rf": lambda p, c: _forest("reg", p, c),
    "hist_gb_reg": lambda p, c: _histogram("reg", p, c),
    "hist_gb_clf": lambda p, c: _histogram("clf", p, c),
}
TAKES_MISSING = ("hist_gb_reg", "hist_gb_clf")  # their features are not imputed
# Other boosted-tree ids share the boosted operator.
for _id in ("xgboost", "lightgbm", "catboost"):
    FACTORIES[f"{_id}_reg"] = lambda p, c: _boosted("reg", p, c)
    FACTORIES[f"{_id}_clf"] = lambda p, c: _boosted("clf", p, c)
for _id in ("ml_lag_xgb", "ml_lag_lgb"):
    FACTORIES[_id] = lambda p, c: _boosted("reg", p, c)

# The parameter grids that tuning searches.
GRIDS: dict[str, dict[str, list]] = {
    "ridge": {"alpha": [0.01, 0.1, 1.0, 10.0, 100.0]},
    "lasso": {"alpha": [0.001, 0.01, 0.1, 1.0]},
    "decision_tree_reg": {"max_depth": [None, 5, 10, 20], "min_samples_split": [2, 5, 10]},
    "random_forest_reg": {"n_estimators": [100, 200, 400], "max_depth": [None, 10, 20], "min_samples_split": [2, 5, 10]},
    "gradient_boosting_reg": {"n_estimators": [100, 200], "learning_rate": [0.05, 0.1], "max_depth": [3, 5, 7]},
    "xgboost_reg": {"n_estimators": [100, 300], "learning_rate": [0.05, 0.1], "max_depth": [3, 5, 7], "subsample": [0.8, 1.0]},
    "logistic_regression": {"C": [0.01, 0.1, 1, 10]},
    "knn_clf": {"n_neighbors": [3, 5, 7, 9, 11]},
    "random_forest_clf": {"n_estimators": [100, 200, 400], "max_depth": [None, 10, 20]},
    "kmeans": {"n_clusters": [2, 3, 4, 5, 6, 8, 10]},
}


def distinct_settings(algo_id: str, settings: list[dict]) -> list[dict]:
    """Settings without those that stand for the same model as one before: no depth and ``MAX_DEPTH`` are one for trees that MLlib grows."""
    seen, out = [], []
    for s in settings:
        meant = {**s, "max_depth": s["max_depth"] or MAX_DEPTH} if "max_depth" in s else s
        if meant not in seen:
            seen.append(meant)
            out.append(s)
    return out


def build(algo_id: str, params: dict | None, ctx: Context):
    """An estimator for ``algo_id``; MLlib ones come wrapped in a Pipeline."""
    if algo_id not in FACTORIES:
        raise KeyError(f"no trainable algorithm {algo_id!r}")
    est = FACTORIES[algo_id](params or {}, ctx)
    return est if isinstance(est, (Fitter, Pipeline)) else Pipeline(stages=[est])
