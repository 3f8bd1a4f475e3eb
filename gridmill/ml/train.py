"""Train, tune, compare, store and apply predictive models on tables."""

from __future__ import annotations

import itertools
import json
import time
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridmill.functions import semantics as S
from gridmill.functions.positions import with_position
from gridmill.functions.semantics import col
from gridmill.ml import estimators, forecast, forests, metrics, prep, unlabelled
from gridmill.ml.histtrees import HistModel
from gridmill.ml.models import ExpressionModel, NeighbourModel
from gridmill.ml.moments import as_array
from gridmill.operators import timeagg, typing
from gridmill.operators.registry import rank_runs
from gridmill.plans.catalog import algorithm
from gridmill.session import pinned, scratch_path, stored

MAX_CLASSES = 1_000
LAGS = 7  # of a time series' target, and the gap between the rows a fold trains and tests on
WORKERS = 6  # folds, or repeats, whose jobs run side by side
TASK_ROWS = 250_000  # of stored training rows in a task: boosting runs thousands of short jobs, for which fewer are not worth another task
TREE_ROWS = 2_000_000  # row times tree in a task of a forest, as long as there are cores
BATCH_SCORES = 10_000_000  # row times tree that a forest has learned from before its rows are scored by batches
FOREST_VALUES = 1_000_000_000  # row times tree, which MLlib holds four bytes each for, of forests that grow side by side
IMPORTANCE_BLOCK = 10  # shuffled columns that one search for neighbours scores
IMPORTANCE_ROWS = 20_000  # row times column that a task scores, as long as there are cores
_LOADERS = {c.__name__: c for c in (PipelineModel, ExpressionModel, HistModel, NeighbourModel)}


class TrainingError(ValueError):
    """Training input that the checks reject."""


@dataclass
class Fitted:
    """A preprocessor, a model and the classes its labels stand for."""

    algo_id: str
    target: str
    problem_type: str
    preprocessor: prep.Preprocessor
    model: object
    classes: list | None
    scorer: forests.Scorer | None = field(default=None, repr=False)

    def answers(self, df: DataFrame) -> DataFrame:
        """``df`` with ``features``, plus what the model says."""
        return (self.scorer or self.model).transform(df)

    def score(self, df: DataFrame) -> DataFrame:
        """``df`` plus ``prediction`` and, where known, ``probability`` as an array."""
        wanted = [c for c in df.columns if c not in ("features", "prediction", "probability")]
        scored = self.answers(self.preprocessor.transform(df.select(*[col(c) for c in wanted])))
        out = [col(c) for c in wanted] + [F.col("prediction").cast("double").alias("prediction")]
        if "probability" in scored.columns and self.problem_type == "classification":
            p = scored.schema["probability"].dataType
            out.append((F.col("probability") if isinstance(p, T.ArrayType) else vector_to_array("probability")).alias("probability"))
        return scored.select(*out)

    def save(self, spark: SparkSession, path: str) -> None:
        self.preprocessor.save(spark, path)
        meta = {
            "algo_id": self.algo_id, "target": self.target, "problem_type": self.problem_type,
            "classes": self.classes, "loader": type(self.model).__name__,
        }
        S.small_frame(spark, [(json.dumps(meta, default=str),)], "value string").write.text(f"{path}/meta")
        self.model.save(f"{path}/model")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "Fitted":
        meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
        model = _LOADERS[meta.pop("loader")].load(f"{path}/model")
        return Fitted(preprocessor=prep.Preprocessor.load(spark, path), model=model, **meta)


@dataclass
class Result:
    """What one training run reports."""

    algo_id: str
    task: str
    problem_type: str
    metrics: dict[str, float] = field(default_factory=dict)
    cv: dict = field(default_factory=dict)
    importance: list[tuple[str, float]] = field(default_factory=list)
    class_distribution: dict[str, int] = field(default_factory=dict)
    is_imbalanced: bool = False
    n_train: int = 0
    n_test: int = 0
    seconds: float = 0.0
    path: str | None = None
    params: dict = field(default_factory=dict)
    error: str | None = None
    fitted: Fitted | None = None
    rows: DataFrame | None = None


def _class_counts(df: DataFrame, target: str) -> dict:
    """Rows by class; more than ``MAX_CLASSES`` classes are an error, never cut."""
    found = prep.class_distribution(df, target).limit(MAX_CLASSES + 1).collect()
    if len(found) > MAX_CLASSES:
        raise TrainingError(f"more than {MAX_CLASSES} classes")
    return {r["label"]: r["n"] for r in found}


def _labelled(df: DataFrame, target: str, classes: list | None) -> DataFrame:
    if classes is None:
        return df.withColumn("label", col(target).cast("double"))
    place = F.array_position(F.array(*[F.lit(str(c)) for c in classes]), col(target).cast("string"))
    return df.withColumn("label", (place - 1).cast("double"))


def _side_by_side(work, items, workers: int = WORKERS) -> list:
    """``work`` for each item, a few at a time. The threads only submit jobs; all work runs on the cluster."""
    items = list(items)
    with ThreadPoolExecutor(max_workers=max(1, min(workers, len(items)))) as pool:
        return list(pool.map(work, items))


def _forest_size(build) -> int:
    """Trees that a forest grows together; 0 for other estimators."""
    stage = build.getStages()[-1] if isinstance(build, Pipeline) else build
    return stage.getNumTrees() if hasattr(stage, "getNumTrees") else 0


def _fits_at_once(build, n_rows: int) -> int:
    """Forests hold a count for each row and tree while they grow, so on many rows fewer grow side by side."""
    return max(1, min(WORKERS, FOREST_VALUES // max(1, _forest_size(build) * n_rows)))


def _forest_tasks(build, n_rows: int, cores: int) -> int:
    """Tasks worth their start for a level of all trees; 1 for other estimators."""
    return max(1, min(cores, -(-n_rows * _forest_size(build) // TREE_ROWS)))


def _shares(sizes: Sequence[int], at_once: int, cores: int) -> list[int]:
    """Cores for each of some fits, by their rows, when ``at_once`` of them run side by side."""
    whole = max(1, min(sum(sizes), at_once * max(sizes)))
    return [max(1, min(cores, -(-n * cores // whole))) for n in sizes]


def _fit_all(tables: Sequence[DataFrame], target: str, algo_id: str, params: dict | None, problem: str, classes, weights: list | None, dates) -> list[Fitted]:
    """For each table a preprocessor and an estimator that know its rows only. Jobs run side by side; boosted trees share their passes."""

    def prepared(train: DataFrame) -> tuple[prep.Preprocessor, DataFrame, estimators.Context, object]:
        p = prep.build_preprocessor(train, target, dates=dates, impute=algo_id not in estimators.TAKES_MISSING)
        rows = _labelled(p.transform(train), target, classes).filter(F.col("label").isNotNull())
        keep = ["features", "label"]
        if weights:
            w = F.coalesce(*[F.when(F.col("label") == float(i), F.lit(x)) for i, x in enumerate(weights)], F.lit(1.0))
            rows, keep = rows.withColumn("weight", w), [*keep, "weight"]
        data = rows.select(*keep).persist(StorageLevel.MEMORY_AND_DISK)
        ctx = estimators.Context(data.count(), len(p.feature_names), len(classes or ()), bool(weights))
        return p, data, ctx, estimators.build(algo_id, params, ctx)

    def dealt(one: tuple) -> tuple:
        """The rows of a forest in as many tasks as its share of the cores; each task counts for all nodes, and sends its counts."""
        p, data, ctx, build = one
        tasks = _forest_tasks(build, ctx.n_rows, cores[ctx.n_rows])
        if tasks > -(-ctx.n_rows // TASK_ROWS):
            narrow, data = data, data.repartition(tasks).persist(StorageLevel.MEMORY_AND_DISK)
            data.count()
            narrow.unpersist()
        return p, data, ctx, build

    ready = _side_by_side(prepared, tables)
    builds, sizes = [build for *_, build in ready], [ctx.n_rows for _, _, ctx, _ in ready]
    cores = dict(zip(sizes, _shares(sizes, _fits_at_once(builds[0], max(sizes)), tables[0].sparkSession.sparkContext.defaultParallelism), strict=True))
    ready = _side_by_side(dealt, ready)
    try:
        if getattr(builds[0], "fit_many", None):
            models = builds[0].fit_many([data for _, data, _, _ in ready])
        else:
            models = _side_by_side(lambda i: builds[i].fit(ready[i][1]), range(len(ready)), _fits_at_once(builds[0], max(sizes)))
    finally:
        for _, data, _, _ in ready:
            data.unpersist()
    many = [n * _forest_size(builds[0]) > BATCH_SCORES for n in sizes]  # else the way to the arrays costs more than it saves
    return [Fitted(algo_id, target, problem, p, model, classes, forests.scorer(model) if m else None) for (p, *_), model, m in zip(ready, models, many, strict=True)]


def _scores(fitted: Fitted, rows: DataFrame, binary_auc: bool = False) -> dict[str, float]:
    scored = fitted.score(rows)
    truth = _labelled(scored, fitted.target, fitted.classes).filter(F.col("label").isNotNull())
    if fitted.problem_type != "classification":
        exprs = metrics.regression_exprs(F.col("label"), F.col("prediction"))
        row = truth.agg(*[e.alias(k) for k, e in exprs.items()]).first()
        return {k: row[k] for k in exprs}
    row = metrics.class_scores(truth, "label", "prediction").first().asDict()
    if binary_auc and len(fitted.classes) == 2 and "probability" in truth.columns:
        with_score = truth.withColumn("__s", F.get("probability", F.lit(1)))
        row["roc_auc"] = metrics.roc_auc(with_score, "label", "__s").first()["roc_auc"]
    return row


def _rounded(values: dict[str, float | None]) -> dict[str, float]:
    return {k: round(float(v), 2 if k == "mape" else 4) for k, v in values.items() if v is not None and k != "f1_weighted"}


def _held(df: DataFrame) -> DataFrame:
    """``df`` written once, so that fits and scores do not repeat the work behind it, and dealt evenly to tasks.

    A narrow table of a million rows is one small file, which Spark reads in one task however many cores are free.
    """
    if any(f.dataType.typeName() == "void" for f in df.schema.fields):
        return pinned(df)
    rows = stored(df, "training-rows")
    tasks = -(-rows.count() // TASK_ROWS)
    return stored(rows.repartition(tasks), "training-rows") if tasks > 1 else rows


def _fold_rows(marked: DataFrame, folds: int) -> list[tuple[DataFrame, DataFrame]]:
    """(rows to fit on, rows to score) of each fold, by the columns ``fold`` and, for folds in time, ``ready``."""
    rolling = "ready" in marked.columns
    fits = lambda i: F.col("ready") <= i if rolling else F.col("fold") != i
    numbers = range(1, folds + 1) if rolling else range(folds)
    return [(marked.filter(fits(i)).drop("fold", "ready"), marked.filter(F.col("fold") == i).drop("fold", "ready")) for i in numbers]


def _cv_report(fitted: Sequence[Fitted], held: Sequence[DataFrame], problem: str) -> dict:
    scoring = "f1_weighted" if problem == "classification" else "r2"
    values = _side_by_side(lambda i: _scores(fitted[i], held[i])[scoring], range(len(held)))
    got = np.array([v for v in values if v is not None], dtype=float)
    if not len(got):
        return {}
    return {
        "scoring": scoring, "mean": round(float(got.mean()), 4), "std": round(float(got.std()), 4),
        "folds": [round(float(v), 4) for v in got],
    }


def cross_validate(
    train: DataFrame, target: str, algo_id: str, params: dict | None, problem: str, classes: list | None,
    weights=None, folds: int = 5, key: str | Column | None = None, dates: Sequence[str] = (),
) -> dict:
    """{scoring, mean, std, folds}: every fold refits preprocessing and model.

    ``train`` may bring its folds: a column ``fold`` (see ``prep.kfold``), for time series with ``ready`` (see ``prep.rolling_folds``). Else rows are
    dealt to folds by a hash of ``key``, evenly by class.
    """
    marked = train if "fold" in train.columns else _held(prep.kfold(train, folds, key, label=target if classes else None))
    rows = _fold_rows(marked, folds)
    return _cv_report(_fit_all([r for r, _ in rows], target, algo_id, params, problem, classes, weights, dates), [h for _, h in rows], problem)


def permutation_importance(
    fitted: Fitted, df: DataFrame, repeats: int = 5, k: int | None = None, key: str | Column | None = None
) -> DataFrame:
    """(feature, importance): how much the score drops when a column is shuffled, for all columns, or the ``k`` first.

    Rows are put in one seeded order; a shuffle pairs each row with the one a seeded number of positions on. One job scores every paired row
    once for each column, with only that column's features taken from the partner; these rows are made and scored inside a task, and only sums
    leave it. The plan holds the model once, however many columns there are, and a row is preprocessed once.
    """
    spark, names = df.sparkSession, fitted.preprocessor.inputs
    row_key = col(key) if isinstance(key, str) else (key if key is not None else S.row_digest(df))
    base = df.select(row_key.alias("__key"), col(fitted.target), *[col(c) for c in names])
    hashed = base.withColumn("__h", S.seeded_hash(F.col("__key"), S.SEED))
    placed = _held(with_position(hashed, [], [F.col("__h").asc(), F.col("__key").asc()], name="__pos").drop("__h", "__key"))
    n = placed.count()
    if not n:
        return S.small_frame(spark, [], "feature string, importance double")

    def score(prediction: str) -> Column:
        label, found = F.col("label"), F.col(prediction)
        if fitted.problem_type == "classification":
            return F.avg(F.when(found == label, 1.0).otherwise(0.0))
        return metrics.regression_exprs(label, found)["r2"]

    def vectors(rows: DataFrame) -> DataFrame:
        """The features of the rows and of their partners, as arrays."""
        own = fitted.preprocessor.transform(rows, "__own").select(col(fitted.target), "__own", *[F.col(f"__r{i}").alias(c) for i, c in enumerate(names)])
        both = fitted.preprocessor.transform(own, "__other")
        return both.select(col(fitted.target), as_array("__own").alias("__own"), as_array("__other").alias("__other"))

    def scored(rows: DataFrame, columns: list[int]) -> list[float]:
        """The scores of ``vectors`` with the features of each of the columns taken from the partner."""
        spans = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(spanned[i][0]).alias("lo"), F.lit(spanned[i][1]).alias("n")) for i in columns])
        every = rows.withColumn("__swap", F.explode(spans))
        lo, width = F.col("__swap.lo"), F.col("__swap.n")
        mixed = F.concat(F.slice("__own", F.lit(1), lo), F.slice("__other", lo + 1, width), F.slice("__own", lo + width + 1, F.size("__own")))
        answers = fitted.answers(every.select(col(fitted.target), "__swap.i", array_to_vector(mixed).alias("features")).withColumnRenamed("i", "__swap"))
        found = _labelled(answers.withColumn("prediction", F.col("prediction").cast("double")), fitted.target, fitted.classes).groupBy("__swap").agg(score("prediction").alias("s")).collect()
        by_column = {r["__swap"]: r["s"] for r in found}
        return [by_column[i] for i in columns]

    spanned = fitted.preprocessor.spans()
    # a search for neighbours holds the rows it looks up for, so it takes some columns at a time
    block = IMPORTANCE_BLOCK if isinstance(fitted.model, NeighbourModel) else len(names)
    blocks = [list(range(len(names)))[i : i + block] for i in range(0, len(names), block)]
    tasks = max(1, min(spark.sparkContext.defaultParallelism, -(-n * len(names) // IMPORTANCE_ROWS)))
    shifts = np.random.RandomState(S.SEED).randint(1, max(2, n), repeats).tolist()

    def drops(shift: int) -> list[float]:
        partner = placed.select(F.pmod(F.col("__pos") - F.lit(shift), F.lit(n)).alias("__pos"), *[col(c).alias(f"__r{i}") for i, c in enumerate(names)])
        paired = placed.join(partner, "__pos").drop("__pos")
        if tasks > -(-n // TASK_ROWS):  # few rows, but each is scored once for every column
            paired = paired.repartition(tasks)
        both = vectors(paired)
        if len(blocks) > 1:
            both = _held(both)
        return [s for block in blocks for s in scored(both, block)]

    whole = _labelled(fitted.score(placed.drop("__pos")), fitted.target, fitted.classes).agg(score("prediction").alias("s")).first()["s"]
    each = np.array(_side_by_side(drops, shifts), dtype=float)
    found = [(c, round(float(whole - s), 4) + 0.0) for c, s in zip(names, each.mean(axis=0))] if whole is not None else []
    rows = sorted(found, key=lambda r: (-r[1], r[0]))
    return S.small_frame(spark, rows[:k], "feature string, importance double")


def _task(df: DataFrame, target: str, algo: dict, date: str | None) -> tuple[str, str]:
    if algo["task"] == "time_series":
        return "time_series", "regression"
    if date is None and algo["task"] in ("regression", "classification"):
        return algo["task"], algo["task"]
    row = typing.infer_task(df, target, date).first()
    if algo["task"] in ("regression", "classification"):
        return algo["task"] if row["task"] != "time_series" else row["task"], algo["task"]
    return row["task"], row["problem_type"]


def train(
    df: DataFrame,
    target: str | None,
    algo_id: str,
    params: dict | None = None,
    key: str | Column | None = None,
    date: str | None = None,
    by: Sequence[str] = (),
    folds: int = 5,
    repeats: int = 5,
    test_size: float = 0.2,
    save: bool = True,
) -> Result:
    """Check, split, cross-validate, fit, score, explain and store one model.

    Clusters, outliers and projections take no target (give null): their result has a report and ``rows`` with the answers. Forecasts of
    whole series (naive, ARIMA, Holt-Winters) need ``date``; ``by`` names the series, and ``rows`` are the tested periods.
    """
    start = time.time()
    algo = algorithm(algo_id)
    if algo_id in unlabelled.ALGORITHMS or algo_id in forecast.ALGORITHMS:
        return _without_folds(df, target, algo, params, key, date, by, test_size, save, start)
    if target is None:
        raise TrainingError(f"{algo_id} needs a target")
    findings = prep.validate_training(df, target, algo_id).filter("level = 'error'").collect()
    if findings:
        raise TrainingError("; ".join(f["message"] for f in findings))
    df = df.filter(col(target).isNotNull())
    task, problem = _task(df, target, algo, date)
    classes = None
    if problem == "classification":
        counts = _class_counts(df, target)
        classes = sorted(counts)
    in_time = task == "time_series" and date is not None
    if in_time:
        df = timeagg.prepare_time_series(df, date, target, lags=LAGS, by=by, tiebreak=key if isinstance(key, str) else None)
    dates = [c for c in typing.date_columns(df.drop(target)) if c in df.columns]
    result = Result(algo_id, task, problem, params=params or {})
    weights = None
    if classes:
        result.class_distribution = {str(c): counts[c] for c in classes}
        if max(counts.values()) / max(min(counts.values()), 1) > prep.IMBALANCE_LIMIT:
            result.is_imbalanced = True
            n = sum(counts.values())
            weights = [n / (len(classes) * counts[c]) for c in classes]
        marked = prep.stratified_split(df, target, test_size, key)
    elif in_time:
        marked = prep.chrono_split(df, date, test_size)
    else:
        marked = prep.split(df, test_size, key)
    marked = _held(marked)
    fit_rows, test_rows = marked.filter(~F.col("is_test")).drop("is_test"), marked.filter("is_test").drop("is_test")
    if isinstance(key, str) and key not in dates:
        dates = [*dates, key]  # the row key is an identifier, not a feature
    parts: list[tuple[DataFrame, DataFrame]] = []
    k = min(folds, *counts.values()) if classes else folds
    if k > 1:
        if in_time:
            folded = prep.rolling_folds(fit_rows, date, k, LAGS, by, key if isinstance(key, str) else None)
        else:
            folded = prep.kfold(fit_rows, k, key, label=target if classes else None)
        parts = _fold_rows(_held(folded), k)
    *by_fold, fitted = _fit_all([*(r for r, _ in parts), fit_rows], target, algo_id, params, problem, classes, weights, dates)
    if parts:
        result.cv = _cv_report(by_fold, [h for _, h in parts], problem)
    result.fitted = fitted
    result.metrics = _rounded(_scores(fitted, test_rows, binary_auc=True))
    sizes = {r["is_test"]: r["count"] for r in marked.groupBy("is_test").count().collect()}
    result.n_train, result.n_test = sizes.get(False, 0), sizes.get(True, 0)
    if repeats:
        rows = permutation_importance(fitted, test_rows, repeats, key=key).collect()
        result.importance = [(r["feature"], r["importance"]) for r in rows]
    if save:
        spark = df.sparkSession
        result.path = scratch_path(spark, f"model-{algo_id}")
        fitted.save(spark, result.path)
    result.seconds = round(time.time() - start, 2)
    return result


def _without_folds(df, target, algo, params, key, date, by, test_size, save, start) -> Result:
    """A run of an algorithm that has no target, or that forecasts whole series."""
    algo_id, spark = algo["id"], df.sparkSession
    result = Result(algo_id, algo["task"], algo["task"], params=params or {})
    if algo_id in forecast.ALGORITHMS:
        if date is None or target is None:
            raise TrainingError(f"{algo_id} needs a target and a date column")
        model, scores, result.rows = forecast.fit_forecaster(df, target, algo_id, date, by, params, test_size)
        result.problem_type = "regression"
        result.n_train, result.n_test = int(scores.pop("n_train")), int(scores.pop("n_test"))
    else:
        skip = [c for c in (key if isinstance(key, str) else None, target) if c]
        model, result.rows, scores = unlabelled.fit(df, algo_id, params, skip=skip)
        result.n_train = int(scores.pop("n_rows"))
    result.metrics = scores
    if save:
        result.path = scratch_path(spark, f"model-{algo_id}")
        model.save(spark, result.path)
    result.seconds = round(time.time() - start, 2)
    return result


def tune(
    df: DataFrame, target: str, algo_id: str, method: str = "random", draws: int = 20, folds: int = 5,
    key: str | Column | None = None, grid: dict[str, list] | None = None, save: bool = True,
) -> tuple[DataFrame, Result]:
    """Every tried setting with its cross-validated score, and the best model
    scored on rows that tuning never saw."""
    grid = grid or estimators.GRIDS.get(algo_id)
    if not grid:
        raise TrainingError(f"no parameter grid for {algo_id!r}")
    algo = algorithm(algo_id)
    problem = algo["task"]
    names = sorted(grid)
    if algo_id in unlabelled.ALGORITHMS:
        return _tune_unlabelled(df, algo_id, [dict(zip(names, v)) for v in itertools.product(*[grid[n] for n in names])], key, save)
    df = df.filter(col(target).isNotNull())
    settings = estimators.distinct_settings(algo_id, [dict(zip(names, v)) for v in itertools.product(*[grid[n] for n in names])])
    if method == "random" and len(settings) > draws:
        pick = np.random.RandomState(S.SEED).permutation(len(settings))[:draws]
        settings = [settings[i] for i in sorted(pick)]
    classes = sorted(_class_counts(df, target)) if problem == "classification" else None
    marked = _held(prep.stratified_split(df, target, key=key) if classes else prep.split(df, key=key))
    fit_rows, test_rows = marked.filter(~F.col("is_test")).drop("is_test"), marked.filter("is_test").drop("is_test")
    dates = typing.date_columns(df.drop(target)) + ([key] if isinstance(key, str) else [])
    tried, folded = [], _held(prep.kfold(fit_rows, folds, key, label=target if classes else None))
    for s in settings:
        cv = cross_validate(folded, target, algo_id, s, problem, classes, None, folds, key, dates)
        tried.append((json.dumps(s, sort_keys=True), cv["mean"], cv["std"]))
    best = max(range(len(tried)), key=lambda i: tried[i][1])
    (fitted,) = _fit_all([fit_rows], target, algo_id, settings[best], problem, classes, None, dates)
    result = Result(f"{algo_id}_tuned", problem, problem, params=settings[best], fitted=fitted)
    result.metrics = _rounded(_scores(fitted, test_rows, binary_auc=True))
    result.cv = {"mean": tried[best][1], "std": tried[best][2]}
    spark = df.sparkSession
    if save:
        result.path = scratch_path(spark, f"model-{algo_id}-tuned")
        fitted.save(spark, result.path)
    rows = [(p, m, sd, i == best) for i, (p, m, sd) in enumerate(tried)]
    return S.small_frame(spark, rows, "params string, cv_mean double, cv_std double, best boolean"), result


def _tune_unlabelled(df: DataFrame, algo_id: str, settings: list[dict], key, save: bool) -> tuple[DataFrame, Result]:
    """Settings by their silhouette; the best one's run."""
    runs = [train(df, None, algo_id, s, key, save=False) for s in settings]
    scores = [r.metrics.get("silhouette") for r in runs]
    best = max(range(len(runs)), key=lambda i: -2.0 if scores[i] is None else scores[i])
    if save:
        runs[best] = train(df, None, algo_id, settings[best], key)
    rows = [(json.dumps(s, sort_keys=True), score, None, i == best) for i, (s, score) in enumerate(zip(settings, scores))]
    return S.small_frame(df.sparkSession, rows, "params string, cv_mean double, cv_std double, best boolean"), runs[best]


def automl(
    df: DataFrame, target: str | None, algo_ids: Sequence[str], workers: int = 4, **options
) -> tuple[DataFrame, list[Result]]:
    """Train several algorithms side by side and rank them; a failure is a row.

    The threads only submit jobs; all work runs on the cluster.
    """

    def one(algo_id: str) -> Result:
        try:
            return train(df, target, algo_id, **options)
        except Exception as problem:  # noqa: BLE001 - a failed run is part of the report
            return Result(algo_id, "", "", error=f"{type(problem).__name__}: {str(problem)[:200]}")

    with ThreadPoolExecutor(max_workers=workers) as pool:
        results = list(pool.map(one, algo_ids))
    rows = []
    for r in results:
        info = algorithm(r.algo_id) or {}
        headline = {"classification": "f1_macro", "clustering": "silhouette", "anomaly": "anomaly_share", "dim_reduction": "explained_1"}
        score = None if r.error else r.metrics.get(headline.get(r.problem_type, "r2"))
        rows.append((r.algo_id, info.get("name"), info.get("family"), score, r.error, r.seconds))
    frame = S.small_frame(
        df.sparkSession, rows, "algo_id string, algo_name string, family string, score double, error string, seconds double"
    )
    return rank_runs(frame), results


def run_row(spark: SparkSession, r: Result, dataset: str, user: str = "anonymous") -> DataFrame:
    """The run as one registry row (see ``registry.append_runs``)."""
    info = algorithm(r.algo_id.removesuffix("_tuned")) or {}
    metric = next((m for m in (("f1_macro", "f1", "accuracy") if r.problem_type == "classification" else ("r2", "rmse", "mae")) if m in r.metrics), "score")
    values = {
        "id": (r.path or r.algo_id).rsplit("/", 1)[-1], "user_id": user, "dataset_name": dataset, "n_rows": r.n_train + r.n_test,
        "task": r.task, "problem_type": r.problem_type, "algo_id": r.algo_id, "algo_name": info.get("name"),
        "algo_family": info.get("family"), "primary_metric": metric, "primary_score": r.metrics.get(metric),
        "metrics_json": json.dumps(r.metrics), "cv_metrics_json": json.dumps(r.cv), "params_json": json.dumps(r.params),
        "feat_imp_json": json.dumps([{"feature": f, "score": s} for f, s in r.importance]), "model_path": r.path,
        "training_time_s": r.seconds, "is_imbalanced": r.is_imbalanced, "target_col": r.fitted.target if r.fitted else None,
    }
    schema = (
        "id string, user_id string, dataset_name string, n_rows bigint, task string, problem_type string, algo_id string, "
        "algo_name string, algo_family string, primary_metric string, primary_score double, metrics_json string, "
        "cv_metrics_json string, params_json string, feat_imp_json string, model_path string, training_time_s double, "
        "is_imbalanced boolean, target_col string"
    )
    names = [f.split()[0] for f in schema.split(", ")]
    return S.small_frame(spark, [tuple(values[n] for n in names)], schema).withColumn("created_at", F.current_timestamp())


def predict(df: DataFrame, path: str) -> DataFrame:
    """Score a whole table with a stored model: prediction (class or number),
    probabilities by class and confidence in percent. Missing feature columns
    count as missing values. Models without a target add their answer to the complete rows."""
    try:
        fitted = Fitted.load(df.sparkSession, path)
    except AnalysisException:  # no such folder: not a model with a target
        return unlabelled.Unlabelled.load(df.sparkSession, path).apply(df)
    scored = fitted.score(df)
    if fitted.classes is None:
        return scored
    names = F.array(*[F.lit(str(c)) for c in fitted.classes])
    out = scored.withColumn("prediction", F.get(names, F.col("prediction").cast("int")))
    if "probability" in scored.columns:
        out = out.withColumn("confidence", F.round(F.array_max("probability") * 100, 2)).withColumn(
            "probability", F.map_from_arrays(names, F.transform("probability", lambda p: F.round(p, 4)))
        )
    return out


def model_importances(fitted: Fitted) -> DataFrame:
    """(feature, importance) as the model itself reports it, largest first."""
    stage = fitted.model.stages[-1] if isinstance(fitted.model, PipelineModel) else fitted.model
    names = fitted.preprocessor.feature_names
    if hasattr(stage, "featureImportances"):
        values = stage.featureImportances.toArray()
    elif isinstance(stage, ExpressionModel) and stage.kind == "linear":
        values = np.abs(stage.state["coef"])
    elif hasattr(stage, "coefficients") and not getattr(stage, "numClasses", 2) > 2:
        values = np.abs(stage.coefficients.toArray())
    elif hasattr(stage, "coefficientMatrix"):
        values = np.abs(stage.coefficientMatrix.toArray()).mean(axis=0)
    else:
        raise TrainingError(f"{fitted.algo_id} reports no importances")
    rows = sorted(zip(names, (round(float(v), 4) for v in values)), key=lambda r: (-r[1], r[0]))
    return S.small_frame(SparkSession.getActiveSession(), rows, "feature string, importance double")


def export_predictions(df: DataFrame, actual: str, predicted: str, path: str) -> None:
    """Write (actual, predicted) as CSV with a header."""
    df.select(col(actual).alias("actual"), col(predicted).alias("predicted")).write.mode("errorifexists").csv(path, header=True)
