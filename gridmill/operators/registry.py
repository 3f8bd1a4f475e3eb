"""The run registry: append-only tables.

Nothing is updated in place. A run is one appended row; stars, notes and
deletions are appended marks, and the current state is one aggregation of the
marks (partial sums, so a run with very many marks costs no more than others).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridmill.functions import semantics as S
from gridmill.functions.positions import with_position

RUN_SCHEMA = (
    "id string, user_id string, created_at timestamp, dataset_name string, n_rows bigint, n_cols bigint, "
    "target_col string, task string, problem_type string, algo_id string, algo_name string, algo_family string, "
    "primary_metric string, primary_score double, metrics_json string, cv_metrics_json string, "
    "feat_imp_json string, params_json string, logs_json string, model_path string, training_time_s double, "
    "is_imbalanced boolean, source string, y_true_json string, y_pred_json string"
)
MARK_SCHEMA = "run_id string, user_id string, kind string, value string, marked_at timestamp"
# Which metric ranks a run, in order of preference.
PRIMARY_METRICS = {"classification": ("f1_macro", "f1", "balanced_accuracy", "accuracy"), "other": ("r2", "rmse", "mae")}


def with_primary_metric(runs: DataFrame, metrics: str = "metrics", problem_type: str = "problem_type") -> DataFrame:
    """Add ``primary_metric`` and ``primary_score`` from a metrics map column."""
    is_class = F.col(problem_type) == "classification"
    name = lambda keys: F.coalesce(
        *[F.when(F.map_contains_key(F.col(metrics), k), F.lit(k)) for k in keys], F.lit("score")
    )
    key = F.when(is_class, name(PRIMARY_METRICS["classification"])).otherwise(name(PRIMARY_METRICS["other"]))
    return runs.withColumn("primary_metric", key).withColumn(
        "primary_score", F.try_element_at(F.col(metrics), F.col("primary_metric")).cast("double")
    )


def append_runs(runs: DataFrame, path: str) -> None:
    """Append run rows, with all their predictions.

    Files are sorted by user, so a reader of one user skips most row groups.
    """
    schema = T.StructType.fromDDL(RUN_SCHEMA)
    cols = []
    for f in schema:
        value = F.col(f.name) if f.name in runs.columns else F.lit(None)
        cols.append(value.cast(f.dataType).alias(f.name))
    runs.select(*cols).sortWithinPartitions("user_id", "created_at").write.mode("append").parquet(path)


def append_marks(marks: DataFrame, path: str) -> None:
    """Append star, note or delete marks."""
    marks.select("run_id", "user_id", "kind", "value", "marked_at").write.mode("append").parquet(path)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RUN_SCHEMA).parquet(path)


def current_runs(runs: DataFrame, marks: DataFrame) -> DataFrame:
    """Runs that are not deleted, with ``starred`` and ``notes`` as of now.

    A star mark flips the star, the latest note wins, a delete mark removes.
    """
    when = F.struct("marked_at", "value")
    state = marks.groupBy(F.col("run_id").alias("__run"), F.col("user_id").alias("__user")).agg(
        (F.count(F.when(F.col("kind") == "star", 1)) % 2 == 1).alias("__starred"),
        F.max_by(F.when(F.col("kind") == "note", F.col("value")), F.when(F.col("kind") == "note", when)).alias("__notes"),
        F.max(F.col("kind") == "delete").alias("__deleted"),
    )
    gone = state.filter("__deleted")
    same = (F.col("id") == F.col("__run")) & (F.col("user_id") == F.col("__user"))
    kept = runs.join(gone.select("__run", "__user"), same, "left_anti")
    live = state.filter(~F.col("__deleted")).select("__run", "__user", "__starred", "__notes")
    return kept.join(live, same, "left").select(
        *[S.col(c) for c in runs.columns],
        F.coalesce("__starred", F.lit(False)).alias("starred"),
        F.coalesce("__notes", F.lit("")).alias("notes"),
    )


def list_runs(
    runs: DataFrame,
    user: str,
    task: str | None = None,
    algo_id: str | None = None,
    starred_only: bool = False,
    search: str | None = None,
    limit: int = 50,
    offset: int = 0,
) -> DataFrame:
    """One page of a user's runs, newest first."""
    kept = runs.filter(F.col("user_id") == user)
    if task:
        kept = kept.filter(F.col("task") == task)
    if algo_id:
        kept = kept.filter(F.col("algo_id") == algo_id)
    if starred_only:
        kept = kept.filter("starred")
    if search:
        needle = F.lit(search.lower())
        hits = [F.coalesce(F.contains(F.lower(c), needle), F.lit(False)) for c in ("dataset_name", "algo_name", "target_col")]
        kept = kept.filter(hits[0] | hits[1] | hits[2])
    return kept.orderBy(F.desc("created_at"), F.desc("id")).offset(offset).limit(limit)


def get_run(runs: DataFrame, run_id: str, user: str) -> DataFrame:
    """One run with its JSON columns opened."""
    one = runs.filter((F.col("id") == run_id) & (F.col("user_id") == user))
    return one.withColumns(
        {
            "metrics": F.from_json("metrics_json", "map<string,double>"),
            "params": F.from_json("params_json", "map<string,string>"),
            "feature_importance": F.from_json("feat_imp_json", "array<struct<feature:string,score:double>>"),
            "logs": F.from_json("logs_json", "array<string>"),
        }
    ).drop("metrics_json", "params_json", "feat_imp_json", "logs_json")


def compare_runs(runs: DataFrame, ids: Sequence[str], user: str) -> DataFrame:
    """The named runs in the caller's order; unknown ids are left out."""
    wanted = S.small_frame(runs.sparkSession, [(i + 1, str(x)) for i, x in enumerate(ids)], "position bigint, __id string")
    return (
        runs.filter(F.col("user_id") == user)
        .join(F.broadcast(wanted), F.col("id").cast("string") == F.col("__id"))
        .drop("__id")
        .orderBy("position")
    )


def runs_summary(runs: DataFrame, user: str) -> DataFrame:
    """One row: total, starred, best_algo, best_metric, best_score."""
    mine = runs.filter(F.col("user_id") == user)
    best = F.struct(F.col("primary_score").alias("s"), F.col("id").alias("i"))
    scored = F.when(F.col("primary_score").isNotNull(), best)
    return mine.agg(
        F.count(F.lit(1)).alias("total"),
        F.count(F.when(F.col("starred"), 1)).alias("starred"),
        F.max_by("algo_name", scored).alias("best_algo"),
        F.max_by("primary_metric", scored).alias("best_metric"),
        F.max("primary_score").alias("best_score"),
    )


def recent_algorithms(runs: DataFrame, user: str, n: int = 5) -> DataFrame:
    """(algo_name, last_used): the latest distinct algorithms."""
    used = runs.filter(F.col("user_id") == user).groupBy("algo_name").agg(F.max("created_at").alias("last_used"))
    return used.orderBy(F.desc("last_used"), "algo_name").limit(n)


def list_models(runs: DataFrame, n: int = 50) -> DataFrame:
    """The latest saved models, newest first."""
    saved = runs.filter(F.col("model_path").isNotNull())
    return saved.orderBy(F.desc("created_at"), F.desc("id")).limit(n)


def rank_runs(runs: DataFrame, score: str = "score", tie: str = "algo_id", by: Sequence[str] = ()) -> DataFrame:
    """Leaderboard rank per group, failed runs (no score) last."""
    placed = with_position(runs, by, [F.desc_nulls_last(score), F.asc(tie)], name="rank")
    return placed.withColumn("rank", F.col("rank") + 1)
