"""Structured Streaming jobs over a growing folder of files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridmill.functions import semantics as S
from gridmill.functions.semantics import col
from gridmill.ml.train import Fitted
from gridmill.operators.analytics import iqr_bounds


def read_stream(spark: SparkSession, folder: str, schema: T.StructType, pattern: str | None = None, fmt: str = "parquet") -> DataFrame:
    """Files that arrive in a folder; ``pattern`` limits the names."""
    reader = spark.readStream.schema(schema).format(fmt)
    return (reader.option("pathGlobFilter", pattern) if pattern else reader).load(folder)


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process what is there now and stop; a restart goes on where it stopped."""
    query = (
        stream.writeStream.format("parquet").outputMode(mode).option("path", path)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()


def kpi_stream(events: DataFrame, ts: str, value: str, keys: Sequence[str] = (), width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """KPIs per closed time window (and key); rows later than ``delay`` are dropped."""
    timed = events.withColumn("__ts", col(ts).cast("timestamp")).withWatermark("__ts", delay)
    grouped = timed.groupBy(F.window("__ts", width), *[col(k) for k in keys]).agg(
        F.count(F.lit(1)).alias("records"),
        F.sum(col(value)).alias("total"),
        F.max(col(value)).alias("peak"),
        F.min(col(value)).alias("low"),
    )
    return grouped.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "records", "total", "peak", "low")


def clean_stream(
    events: DataFrame, casts: dict[str, str], fills: dict[str, object], valid: Column | None = None,
    key: str | None = None, ts: str | None = None, delay: str = "10 minutes",
) -> DataFrame:
    """Coerce, fill and filter row by row; with a key, drop repeats that arrive
    within the delay."""
    out = events.select(
        *[
            F.coalesce(c, F.lit(fills[n])).alias(n) if n in fills else c.alias(n)
            for n, c in ((n, col(n).try_cast(casts[n]) if n in casts else col(n)) for n in events.columns)
        ]
    )
    out = S.fold_missing(out)
    if valid is not None:
        out = out.filter(valid)
    if key and ts:
        out = out.withColumn(ts, col(ts).cast("timestamp")).withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])
    return out


def flag_stream(events: DataFrame, history: DataFrame, value: str) -> DataFrame:
    """Mark values outside the fences of the history; the two numbers are read
    once, when the job starts."""
    lower, upper = iqr_bounds(history, value)
    v = col(value).cast("double")
    return events.withColumn("is_anomaly", F.coalesce((v < F.lit(lower)) | (v > F.lit(upper)), F.lit(False)))


def score_stream(rows: DataFrame, model_path: str) -> DataFrame:
    """Predictions of a stored model for every arriving row."""
    return Fitted.load(rows.sparkSession, model_path).score(rows)


def event_log_sink(events: DataFrame, path: str, checkpoint: str, ts: str = "ts", kind: str = "event_type") -> None:
    """Append (ts, type, payload) of every arriving row to the event log."""
    rest = [c for c in events.columns if c not in (ts, kind)]
    rows = events.select(col(ts).alias("ts"), col(kind).alias("type"), F.to_json(F.struct(*[col(c) for c in rest])).alias("payload"))
    run_available(rows, path, checkpoint)
