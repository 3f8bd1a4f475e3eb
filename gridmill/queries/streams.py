"""Queries on streaming jobs, run over what is there and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridmill.queries import register
from gridmill.queries.tables import load
from gridmill.session import scratch_path
from gridmill.streaming import jobs


def _events(spark, sf):
    schema = load(spark, sf, "events").schema
    return jobs.read_stream(spark, sf, schema, "events.parquet")


def _run(spark, stream, label: str) -> str:
    path = scratch_path(spark, label)
    jobs.run_available(stream, path, f"{path}-checkpoint")
    return path


@register(
    "z01_kpi_stream",
    """
    WITH w AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS records,
                      sum(value::DECIMAL(18,2))::DOUBLE AS total, max(value) AS peak, min(value) AS low FROM events GROUP BY 1, 2)
    SELECT * FROM w WHERE start + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)
    """,
)
def _(spark, sf):
    events = _events(spark, sf).withColumn("exact", F.col("value").cast("decimal(18,2)"))
    path = _run(spark, jobs.kpi_stream(events, "ts", "exact", ["event_type"]), "kpis")
    out = spark.read.parquet(path)
    return out.select(
        F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "records",
        *[F.col(c).cast("double").alias(c) for c in ("total", "peak", "low")],
    )


@register(
    "z02_clean_stream",
    "SELECT event_id, user_id, CASE WHEN event_id % 9 = 0 THEN 0.0 ELSE value END AS value, event_type FROM events WHERE event_type <> 'error'",
)
def _(spark, sf):
    raw = _events(spark, sf).withColumn("value", F.when(F.col("event_id") % 9 == 0, F.lit("bad")).otherwise(F.col("value").cast("string")))
    clean = jobs.clean_stream(raw, {"value": "double"}, {"value": 0.0}, F.col("event_type") != "error", "event_id", "ts")
    return spark.read.parquet(_run(spark, clean.select("event_id", "user_id", "value", "event_type"), "clean"))


@register(
    "z03_flag_stream",
    """
    WITH q AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events)
    SELECT event_id, value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a) AS is_anomaly FROM events, q
    """,
)
def _(spark, sf):
    flagged = jobs.flag_stream(_events(spark, sf), load(spark, sf, "events"), "value")
    return spark.read.parquet(_run(spark, flagged.select("event_id", "is_anomaly"), "flags"))


@register("z04_score_stream")
def _(spark, sf):
    from gridmill.ml.train import train

    history = load(spark, sf, "events").select("event_id", "user_id", "event_type", "value")
    model = train(history, "value", "decision_tree_reg", None, key="event_id")
    rows = _events(spark, sf).select("event_id", "user_id", "event_type", "value")
    scored = jobs.score_stream(rows, model.path)
    return spark.read.parquet(_run(spark, scored.select("event_id", "prediction"), "scores"))


@register("z05_event_log_sink", "SELECT ts, event_type AS type, user_id FROM events")
def _(spark, sf):
    path = scratch_path(spark, "log")
    jobs.event_log_sink(_events(spark, sf), path, f"{path}-checkpoint")
    out = spark.read.parquet(path)
    return out.select("ts", "type", F.from_json("payload", "user_id bigint")["user_id"].alias("user_id"))
