"""The event log: atomic manifests, purges, and files that go."""

import datetime as dt
import glob

import pytest
from pyspark.sql import functions as F

from gridmill.operators.eventlog import EventLog


def events(spark, first, n):
    day = dt.datetime(2024, 3, 1)
    rows = [(i, day + dt.timedelta(hours=i), f"kind {i % 3}") for i in range(first, first + n)]
    return spark.createDataFrame(rows, "event_id long, ts timestamp, kind string")


def ids(df):
    return sorted(r.event_id for r in df.select("event_id").collect())


def files(path):
    return glob.glob(f"{path}/data/*/*/*.parquet")


def test_purge_deletes_files_once_readers_had_time(spark, tmp_path):
    log = EventLog(spark, str(tmp_path / "log"))
    log.append(events(spark, 0, 60))
    log.append(events(spark, 60, 60))
    assert ids(log.read()) == list(range(120))
    reader, before = log.read(), set(files(log.path))
    assert log.purge(30, F.col("event_id")) > 0
    assert ids(log.read()) == list(range(90, 120))
    assert ids(reader) == list(range(120))  # a query from before the purge still ends
    log.append(events(spark, 120, 5))
    log.vacuum()
    assert ids(log.read()) == list(range(90, 125))
    left = set(files(log.path))
    assert left and not (before - left) & left and len(before & left) < len(before) / 2
    assert len(log.manifests()) == 2
    with pytest.raises(Exception):
        reader.collect()  # its files are gone


def test_edges(spark, tmp_path):
    log = EventLog(spark, str(tmp_path / "log"))
    assert log.purge() == 0
    with pytest.raises(ValueError):
        log.read()
    log.append(events(spark, 0, 10))
    assert log.purge(50) == 0 and ids(log.read()) == list(range(10))
    log.append(spark.createDataFrame([(100, None, "untimed")], "event_id long, ts timestamp, kind string"))
    assert len(ids(log.read())) == 11
    log.purge(11)
    assert len(ids(log.read())) == 11
    log.purge(4, F.col("event_id"))
    assert ids(log.read()) == [6, 7, 8, 9]
    log.purge(0)
    assert ids(log.read()) == []


def test_two_writers_do_not_overwrite_each_other(spark, tmp_path):
    log = EventLog(spark, str(tmp_path / "log"))
    log.append(events(spark, 0, 3))
    stale = log.manifest()
    log.append(events(spark, 3, 3))
    with pytest.raises(RuntimeError):
        log._commit(stale["version"], stale["folders"], log.read().schema)
    assert ids(log.read()) == list(range(6))
