"""Scores of MLlib's regression forests, batch by batch instead of row by row.

MLlib walks all trees for one row and then for the next, so that each step waits for memory. Here the nodes of all trees are
a few arrays, and a batch of rows goes down one tree after the other. Sums are taken in the order of the trees, as MLlib takes them, so the
predictions are the same numbers.
"""

from __future__ import annotations

import threading

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.regression import RandomForestRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridmill.ml.moments import as_array
from gridmill.session import scratch_path


class Nodes:
    """The nodes of all trees: what a node asks, the two that follow it (a leaf follows itself), and its value."""

    def __init__(self, tree: np.ndarray, node: np.ndarray, left: np.ndarray, right: np.ndarray, feature: np.ndarray, cut: np.ndarray, value: np.ndarray):
        order = np.lexsort((node, tree))
        tree, node, left, right, feature, cut, self.value = (c[order] for c in (tree, node, left, right, feature, cut, value))
        self.roots = np.flatnonzero(np.r_[True, np.diff(tree) != 0])
        root = np.repeat(self.roots, np.diff(np.r_[self.roots, len(tree)]))
        leaf, here = left < 0, np.arange(len(tree))
        if (here - root != node).any():
            raise ValueError("the nodes of a tree are not numbered from 0")
        self.next = np.column_stack([np.where(leaf, here, root + left), np.where(leaf, here, root + right)]).ravel()
        self.feature, self.cut = np.where(leaf, 0, feature), np.where(leaf, np.inf, cut)
        below = np.zeros(len(tree), np.int64)
        for i in range(len(tree) - 1, -1, -1):  # children come after their parents
            if not leaf[i]:
                below[i] = 1 + max(below[self.next[2 * i]], below[self.next[2 * i + 1]])
        self.levels = below[self.roots]

    def predict(self, x: np.ndarray) -> np.ndarray:
        flat, first, total = np.ascontiguousarray(x).ravel(), np.arange(len(x)) * x.shape[1], np.zeros(len(x))
        for root, levels in zip(self.roots.tolist(), self.levels.tolist(), strict=True):
            node = np.full(len(x), root)
            for _ in range(levels):
                right = ~(flat.take(first + self.feature.take(node)) <= self.cut.take(node))
                node = self.next.take(2 * node + right)
            total += self.value.take(node)
        return total / len(self.roots)


def nodes_of(spark: SparkSession, stage: RandomForestRegressionModel) -> Nodes | None:
    """The nodes of a stored copy of the forest; none where a node asks for categories. They grow with trees and depth, not with the rows."""
    path = scratch_path(spark, "forest")
    stage.save(path)
    n = F.col("nodeData")
    rows = spark.read.parquet(f"{path}/data").select(
        "treeID", n["id"].alias("id"), n["leftChild"].alias("left"), n["rightChild"].alias("right"), n["split"]["featureIndex"].alias("feature"),
        n["split"]["numCategories"].alias("categories"), F.get(n["split"]["leftCategoriesOrThreshold"], F.lit(0)).alias("cut"), n["prediction"].alias("value"),
    ).toPandas()
    if (rows["categories"] >= 0).any():
        return None
    return Nodes(*(rows[c].to_numpy() for c in ("treeID", "id", "left", "right", "feature", "cut", "value")))


class Scorer:
    """A model's answers; those of a regression forest by batches."""

    def __init__(self, model: PipelineModel):
        self.model, self._shared, self._made = model, None, threading.Lock()

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with ``features``, plus ``prediction``."""
        with self._made:
            if self._shared is None:
                found = nodes_of(df.sparkSession, self.model.stages[-1])
                self._shared = df.sparkSession.sparkContext.broadcast(found) if found else False
        if not self._shared:
            return self.model.transform(df)
        shared, width = self._shared, self.model.stages[-1].numFeatures

        @F.arrow_udf("double")
        def predicted(x: pa.Array) -> pa.Array:
            return pa.array(shared.value.predict(x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), width)))

        return df.withColumn("prediction", predicted(as_array("features")))


def scorer(model) -> Scorer | None:
    """For a pipeline that is a regression forest only."""
    if isinstance(model, PipelineModel) and len(model.stages) == 1 and isinstance(model.stages[0], RandomForestRegressionModel):
        return Scorer(model)
    return None
