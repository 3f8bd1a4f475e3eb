"""How training rows are laid out, and how many fits share the cluster."""

from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from gridmill.ml import estimators, train


def test_training_rows_are_dealt_to_tasks(spark):
    n = 3 * train.TASK_ROWS
    held = train._held(spark.range(0, n, 1, 1).select("id", (F.col("id") % 11).alias("y")))
    sizes = [r["count"] for r in held.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 3 and max(sizes) < 1.1 * train.TASK_ROWS
    assert held.select("id").distinct().count() == held.count() == n


def test_few_rows_stay_in_one_task(spark):
    held = train._held(spark.range(0, 5_000, 1, 1))
    assert held.count() == 5_000 and len({r[0] for r in held.select(F.spark_partition_id()).collect()}) == 1


def test_large_forests_grow_in_turn(spark):
    forest = estimators.build("random_forest_reg", None, estimators.Context(10, 3))
    assert [train._fits_at_once(forest, n) for n in (1_000, 2_000_000, 50_000_000)] == [train.WORKERS, 2, 1]
    assert train._fits_at_once(estimators.build("lasso", None, estimators.Context(10, 3)), 50_000_000) == train.WORKERS
    assert isinstance(forest, Pipeline)


def test_forests_use_the_cores(spark):
    forest, line = (estimators.build(a, None, estimators.Context(10, 3)) for a in ("extra_trees_clf", "lasso"))
    assert [train._forest_tasks(forest, n, 12) for n in (2_000, 16_000, 960_000)] == [1, 2, 12]
    assert train._forest_tasks(line, 50_000_000, 12) == 1


def test_forests_remember_the_nodes_of_rows(spark):
    """Without it every level walks all trees from their roots."""
    for algo in ("random_forest_reg", "extra_trees_clf", "bagging_reg", "ml_lag_rf"):
        assert estimators.build(algo, None, estimators.Context(10, 3)).getStages()[-1].getCacheNodeIds()
