"""Late rows, restarts and duplicate suppression in the streaming jobs."""

from conftest import rows
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridmill.streaming import jobs

SCHEMA = T.StructType(
    [T.StructField("id", T.LongType()), T.StructField("ts", T.TimestampType()), T.StructField("kind", T.StringType()), T.StructField("value", T.DoubleType())]
)


def _write(spark, folder, data):
    spark.createDataFrame(data, "id bigint, ts string, kind string, value double").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(
        1
    ).write.mode("append").parquet(str(folder))


def test_late_rows_are_dropped_and_restarts_add_nothing(spark, tmp_path):
    src, out, ck = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "ck")

    def run():
        stream = jobs.kpi_stream(jobs.read_stream(spark, str(src), SCHEMA), "ts", "value", ["kind"])
        jobs.run_available(stream, out, ck)
        got = spark.read.parquet(out).select(F.date_format("start", "HH:mm"), "kind", "records", "total")
        return rows(got)

    _write(spark, src, [(1, "2024-01-01 00:05:00", "a", 2.0), (2, "2024-01-01 00:50:00", "a", 3.0), (3, "2024-01-01 01:30:00", "a", 4.0)])
    assert run() == [("00:00", "a", 2, 5.0)]
    assert run() == [("00:00", "a", 2, 5.0)]
    _write(spark, src, [(4, "2024-01-01 00:10:00", "a", 100.0), (5, "2024-01-01 03:00:00", "a", 1.0)])
    assert run() == [("00:00", "a", 2, 5.0), ("01:00", "a", 1, 4.0)]


def test_clean_stream_drops_repeats_and_bad_rows(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    _write(spark, src, [(1, "2024-01-01 00:00:00", "ok", 2.0), (1, "2024-01-01 00:01:00", "ok", 2.0), (2, "2024-01-01 00:02:00", "bad", 1.0),
                        (3, "2024-01-01 00:03:00", "ok", float("nan"))])
    stream = jobs.read_stream(spark, str(src), SCHEMA)
    clean = jobs.clean_stream(stream, {}, {"value": 0.0}, F.col("kind") == "ok", "id", "ts")
    jobs.run_available(clean.select("id", "kind", "value"), out, str(tmp_path / "ck"))
    assert rows(spark.read.parquet(out)) == [(1, "ok", 2.0), (3, "ok", None)]


def test_event_log_keeps_every_field(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    _write(spark, src, [(1, "2024-01-01 00:00:00", "extract", 2.0)])
    jobs.event_log_sink(jobs.read_stream(spark, str(src), SCHEMA), out, str(tmp_path / "ck"), "ts", "kind")
    row = spark.read.parquet(out).first()
    assert row["type"] == "extract" and row["payload"] == '{"id":1,"value":2.0}'
