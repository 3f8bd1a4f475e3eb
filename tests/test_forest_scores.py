"""Regression forests scored by batches give MLlib's own predictions; forests share the cores by their rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from gridmill.ml import estimators, forests, train


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.RandomState(2)
    x = np.column_stack([rng.normal(size=400), rng.randint(0, 2, 400), rng.uniform(size=400)])
    df = spark.createDataFrame(pd.DataFrame({"x": list(x), "label": x[:, 0] * 3 + x[:, 1] + rng.normal(size=400)}))
    return df.select(array_to_vector("x").alias("features"), "label").repartition(3).cache()


@pytest.mark.parametrize("depth", [0, 3, 8])
def test_batches_score_as_mllib_does(rows, depth):
    from pyspark.ml import Pipeline
    from pyspark.ml.regression import RandomForestRegressor

    model = Pipeline(stages=[RandomForestRegressor(numTrees=7, maxDepth=depth, seed=1)]).fit(rows)
    odd = rows.limit(3).select(array_to_vector(F.array(F.lit(float("nan")), F.lit(-0.0), F.lit(float("inf")))).alias("features"), "label")
    asked = rows.unionByName(odd)
    own = forests.scorer(model).transform(asked).withColumnRenamed("prediction", "ours")
    both = model.transform(own)
    assert both.filter("ours = prediction").count() == 403


def test_only_regression_forests_are_scored_by_batches(rows):
    line = estimators.build("linear_regression", None, estimators.Context(400, 3)).fit(rows)
    assert forests.scorer(line) is None and forests.scorer(object()) is None


def test_a_large_forest_brings_its_scorer(spark, monkeypatch):
    df = spark.range(300).selectExpr("id", "id * 1.0D AS a", "id % 5 AS b", "id * 2.0D + id % 5 AS y")
    assert train.train(df, "y", "random_forest_reg", {"n_estimators": 5}, "id", repeats=0, save=False).fitted.scorer is None
    monkeypatch.setattr(train, "BATCH_SCORES", 100)
    fitted = train.train(df, "y", "random_forest_reg", {"n_estimators": 5}, "id", save=False).fitted
    ours = [r["prediction"] for r in fitted.score(df).orderBy("id").collect()]
    fitted.scorer = None
    assert ours == [r["prediction"] for r in fitted.score(df).orderBy("id").collect()]


def test_forests_share_the_cores_by_their_rows():
    assert train._shares([64, 64, 64, 64, 64, 80], 6, 12) == [2, 2, 2, 2, 2, 3]
    assert train._shares([10, 50], 1, 12) == [3, 12]  # one after the other
    assert train._shares([5], 6, 8) == [8] and train._shares([0, 0], 6, 8) == [1, 1]
