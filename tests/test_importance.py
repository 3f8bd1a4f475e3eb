"""Permutation importances: one plan for all columns, and the scores of columns shuffled one by one."""

import numpy as np
from pyspark.sql import functions as F

from gridmill.functions import semantics as S
from gridmill.functions.positions import with_position
from gridmill.ml import metrics, train


def _fitted(rows, target, algo, classes=None):
    problem = "classification" if classes else "regression"
    return train._fit_all([rows], target, algo, None, problem, classes, None, ["id"])[0]


def _by_hand(fitted, rows, repeats, score):
    """The drops with each shuffled column put in its place by itself."""
    names = fitted.preprocessor.inputs
    placed = with_position(rows.withColumn("__h", S.seeded_hash(F.col("id"), S.SEED)), [], [F.col("__h").asc(), F.col("id").asc()], name="__pos").drop("__h").orderBy("__pos").toPandas().drop(columns="__pos")
    spark, schema = rows.sparkSession, rows.schema
    value = lambda table: score(fitted.score(spark.createDataFrame(table, schema)))
    shifts = np.random.RandomState(S.SEED).randint(1, max(2, len(placed)), repeats)
    whole = value(placed)
    return {c: np.mean([whole - value(placed.assign(**{c: np.roll(placed[c].to_numpy(), -s)})) for s in shifts]) for c in names}


def test_importances_are_those_of_single_columns(spark):
    rows = spark.range(0, 300, 1, 2).selectExpr("id", "id * 1.0D AS a", "(id * 37) % 101 * 1.0D AS b", "concat('g', id % 4) AS g", "id * 2.0D + (id % 4) * 50 + (id * 37) % 101 AS y")
    r2 = lambda s: s.agg(metrics.regression_exprs(F.col("y"), F.col("prediction"))["r2"]).first()[0]
    for algo in ("ridge", "knn_reg"):
        fitted = _fitted(rows, "y", algo)
        got = {r[0]: r[1] for r in train.permutation_importance(fitted, rows, 2, key="id").collect()}
        want = _by_hand(fitted, rows, 2, r2)
        assert set(got) == {"a", "b", "g"} and all(abs(got[c] - want[c]) < 1e-3 for c in want), (algo, got, want)


def test_the_plan_holds_the_model_once(spark, monkeypatch):
    """Each column used to add the preprocessor and the model to the plan, which cost the driver minutes for 64 columns."""
    rows = spark.range(0, 200, 1, 1).selectExpr("id", *[f"((id * {2 * i + 3}) % 97) * 1.0D AS e{i}" for i in range(12)], "id * 1.0D AS y")
    fitted, calls, real = _fitted(rows, "y", "ridge"), [], train.ExpressionModel.transform
    monkeypatch.setattr(train.ExpressionModel, "transform", lambda self, df: calls.append(1) or real(self, df))
    found = train.permutation_importance(fitted, rows, 2, key="id").collect()
    assert len(found) == 12 and len(calls) == 3  # the whole rows, and each repeat


def test_few_rows_are_dealt_for_their_columns(spark, monkeypatch):
    monkeypatch.setattr(train, "IMPORTANCE_ROWS", 300)
    rows = spark.range(0, 300, 1, 1).selectExpr("id", "id * 1.0D AS a", "id % 7 * 1.0D AS b", "id % 5 * 1.0D AS c", "id * 3.0D AS y")
    fitted, tasks, real = _fitted(rows, "y", "ridge"), [], train.ExpressionModel.transform

    def seen(self, df):
        tasks.append(df.rdd.getNumPartitions())
        return real(self, df)

    monkeypatch.setattr(train.ExpressionModel, "transform", seen)
    train.permutation_importance(fitted, rows, 1, key="id").collect()
    assert 3 in tasks
