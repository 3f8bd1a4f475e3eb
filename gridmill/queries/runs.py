"""Queries on the run registry and the event log, fed from the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridmill.operators import eventlog, registry
from gridmill.queries import register
from gridmill.queries.tables import load
from gridmill.session import scratch_path


def _stored(spark, sf):
    """The events table as run rows, appended to a registry and read back."""
    e = load(spark, sf, "events")
    metrics = F.when(
        F.col("event_type") == "error", F.create_map(F.lit("rmse"), F.col("value"), F.lit("mae"), F.col("value") / 2)
    ).when(
        F.col("event_type") == "click", F.create_map(F.lit("accuracy"), F.col("value"), F.lit("f1_macro"), F.col("value") / 4)
    ).otherwise(F.create_map(F.lit("r2"), F.col("value")))
    runs = e.select(
        F.col("event_id").cast("string").alias("id"),
        F.concat(F.lit("u"), F.col("user_id") % 3).alias("user_id"),
        F.col("ts").cast("timestamp").alias("created_at"),
        F.concat(F.lit("set_"), F.col("user_id") % 7).alias("dataset_name"),
        F.col("event_type").alias("algo_id"),
        F.initcap("event_type").alias("algo_name"),
        F.lit("value").alias("target_col"),
        F.when(F.col("event_type") == "click", "classification").otherwise("regression").alias("problem_type"),
        F.col("event_type").alias("task"),
        metrics.alias("metrics"),
        F.to_json(metrics).alias("metrics_json"),
        F.col("props").alias("params_json"),
        F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("models/"), F.col("event_id"))).alias("model_path"),
    )
    path = scratch_path(spark, "runs")
    registry.append_runs(registry.with_primary_metric(runs), path)
    return registry.read_runs(spark, path)


def _marks(spark, sf):
    """Star marks on every second run (twice on every fourth), notes, deletions."""
    e = load(spark, sf, "events")

    def mark(cond, kind, value, seconds):
        return e.filter(cond).select(
            F.col("event_id").cast("string").alias("run_id"), F.concat(F.lit("u"), F.col("user_id") % 3).alias("user_id"),
            F.lit(kind).alias("kind"), F.lit(value).alias("value"),
            (F.col("ts").cast("timestamp") + F.expr(f"INTERVAL {seconds} SECONDS")).alias("marked_at"),
        )

    path = scratch_path(spark, "marks")
    for part in (
        mark("event_id % 2 = 0", "star", "", 1), mark("event_id % 4 = 0", "star", "", 2), mark("event_id % 5 = 0", "note", "first", 1),
        mark("event_id % 10 = 0", "note", "second", 2), mark("event_id % 11 = 0", "delete", "", 3),
    ):
        registry.append_marks(part, path)
    return spark.read.schema(registry.MARK_SCHEMA).parquet(path)


def _current(spark, sf):
    return registry.current_runs(_stored(spark, sf), _marks(spark, sf))


_RUNS = """
    SELECT event_id::VARCHAR AS id, 'u' || (user_id % 3) AS user_id, ts AS created_at, 'set_' || (user_id % 7) AS dataset_name,
      event_type AS algo_id, upper(event_type[1]) || event_type[2:] AS algo_name, event_type AS task, event_id AS n,
      CASE event_type WHEN 'click' THEN 'f1_macro' WHEN 'error' THEN 'rmse' ELSE 'r2' END AS primary_metric,
      CASE event_type WHEN 'click' THEN value / 4 ELSE value END AS primary_score,
      CASE WHEN event_id % 3 = 0 THEN 'models/' || event_id END AS model_path,
      event_id % 2 = 0 AND event_id % 4 <> 0 AS starred,
      CASE WHEN event_id % 10 = 0 THEN 'second' WHEN event_id % 5 = 0 THEN 'first' ELSE '' END AS notes FROM events
"""
_LIVE = f"SELECT * FROM ({_RUNS}) WHERE n % 11 <> 0"
_SHOWN = "id, user_id, created_at::TIMESTAMP AS created_at, algo_name, primary_metric, primary_score"


def _shown(df):
    return df.select(
        "id", "user_id", F.col("created_at").cast("timestamp_ntz").alias("created_at"), "algo_name", "primary_metric", "primary_score"
    )


@register("x01_append_runs", f"SELECT {_SHOWN} FROM ({_RUNS})")
def _(spark, sf):
    return _shown(_stored(spark, sf))


@register(
    "x02_list_runs",
    f"SELECT {_SHOWN} FROM ({_LIVE}) WHERE user_id = 'u1' AND starred AND (contains(lower(dataset_name), 'set_1') OR contains(lower(algo_name), 'set_1')) "
    "ORDER BY created_at DESC, id DESC LIMIT 50 OFFSET 5",
)
def _(spark, sf):
    return _shown(registry.list_runs(_current(spark, sf), "u1", starred_only=True, search="SET_1", limit=50, offset=5))


@register(
    "x03_get_run",
    f"SELECT id, primary_score AS f1_macro, primary_score * 4 AS accuracy FROM ({_LIVE}) WHERE algo_id = 'click' AND user_id = 'u1' "
    "ORDER BY created_at DESC LIMIT 1",
)
def _(spark, sf):
    runs = _current(spark, sf)
    newest = registry.list_runs(runs, "u1", algo_id="click", limit=1).first()["id"]
    one = registry.get_run(runs, newest, "u1")
    return one.select("id", F.col("metrics")["f1_macro"].alias("f1_macro"), F.col("metrics")["accuracy"].alias("accuracy"))


@register("x04_delete_runs", f"SELECT user_id, count(*) AS n_live FROM ({_LIVE}) GROUP BY 1")
def _(spark, sf):
    return _current(spark, sf).groupBy("user_id").agg(F.count(F.lit(1)).alias("n_live"))


@register("x05_star_and_note", f"SELECT id, starred, notes FROM ({_LIVE})")
def _(spark, sf):
    return _current(spark, sf).select("id", "starred", "notes")


@register(
    "x06_compare_runs",
    f"""
    WITH best AS (SELECT id, row_number() OVER (ORDER BY primary_score DESC, id DESC) AS k FROM ({_LIVE}) WHERE user_id = 'u2')
    SELECT k AS position, {_SHOWN.replace('id,', 'r.id,', 1)} FROM ({_LIVE}) r JOIN best b ON r.id = b.id WHERE k <= 3
    """,
)
def _(spark, sf):
    runs = _current(spark, sf)
    top = runs.filter("user_id = 'u2'").orderBy(F.desc("primary_score"), F.desc("id")).limit(3).select("id").collect()
    out = registry.compare_runs(runs, [r["id"] for r in top] + ["no such run"], "u2")
    return out.select("position", "id", "user_id", F.col("created_at").cast("timestamp_ntz").alias("created_at"), "algo_name",
                      "primary_metric", "primary_score")


@register(
    "x07_runs_summary",
    f"SELECT count(*) AS total, count(*) FILTER (WHERE starred) AS starred, arg_max(algo_name, (primary_score, id)) AS best_algo, "
    f"arg_max(primary_metric, (primary_score, id)) AS best_metric, max(primary_score) AS best_score FROM ({_LIVE}) WHERE user_id = 'u1'",
)
def _(spark, sf):
    return registry.runs_summary(_current(spark, sf), "u1")


@register(
    "x07_recent_algorithms",
    f"SELECT algo_name, max(created_at)::TIMESTAMP AS last_used FROM ({_LIVE}) WHERE user_id = 'u1' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5",
)
def _(spark, sf):
    out = registry.recent_algorithms(_current(spark, sf), "u1")
    return out.withColumn("last_used", F.col("last_used").cast("timestamp_ntz"))


@register(
    "w08_rank_runs",
    f"SELECT dataset_name, id, score, row_number() OVER (PARTITION BY dataset_name ORDER BY score DESC NULLS LAST, id) AS rank FROM "
    f"(SELECT dataset_name, id, CASE WHEN n % 13 = 0 THEN NULL ELSE primary_score END AS score FROM ({_RUNS}))",
)
def _(spark, sf):
    runs = _stored(spark, sf).select(
        "dataset_name", "id", F.when(F.col("id").cast("bigint") % 13 != 0, F.col("primary_score")).alias("score")
    )
    return registry.rank_runs(runs, "score", "id", ["dataset_name"])


@register(
    "m24_list_models",
    f"SELECT id, model_path, created_at::TIMESTAMP AS created_at FROM ({_RUNS}) WHERE model_path IS NOT NULL ORDER BY created_at DESC, id DESC LIMIT 50",
)
def _(spark, sf):
    out = registry.list_models(_stored(spark, sf))
    return out.select("id", "model_path", F.col("created_at").cast("timestamp_ntz").alias("created_at"))


@register("k06_event_log", "SELECT event_id, ts, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 500")
def _(spark, sf):
    """Two appends, then a purge: what is left on disk."""
    log = eventlog.EventLog(spark, scratch_path(spark, "log"))
    e = load(spark, sf, "events").select("event_id", "ts", "event_type")
    log.append(e.filter("event_id % 2 = 0"))
    log.append(e.filter("event_id % 2 = 1"))
    log.purge(tie=F.col("event_id"))
    return log.read()
