"""An event log whose old events are deleted from disk, while readers go on reading.

Events lie in folders, one for each append and day. A manifest lists the folders that are live; each change writes a new manifest under the next
number, put in place by one rename, so a reader sees all of a change or none of it. ``purge`` leaves out the days that hold
no event to keep, and writes the day on the edge anew without the others. Folders that no recent manifest
lists are deleted, one change later than they were dropped, so that a query that began before a purge can end.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVENT_RETENTION = 500
KEPT_MANIFESTS = 2  # folders that one of the newest so many list stay


class EventLog:
    """The log below ``path``; rows have a time column ``ts`` and ``schema`` is that of the first append."""

    def __init__(self, spark: SparkSession, path: str, ts: str = "ts"):
        self.spark, self.path, self.ts = spark, path.rstrip("/"), ts

    def _at(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def _children(self, path: str) -> list[str]:
        fs, where = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []

    def manifests(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in self._children(f"{self.path}/manifests") if n.endswith(".json") and not n.startswith("."))

    def manifest(self, version: int | None = None) -> dict:
        """``folders`` and ``schema`` of a version, the newest unless named; an empty log has neither."""
        found = self.manifests()
        if not found:
            return {"version": 0, "folders": [], "schema": None}
        number = found[-1] if version is None else version
        text = "".join(r[0] for r in self.spark.read.option("wholetext", "true").text(f"{self.path}/manifests/{number:012d}.json").collect())
        return {"version": number, **json.loads(text)}

    def _commit(self, seen: int, folders: list[str], schema: T.StructType) -> None:
        """Put the next manifest in place; fails if another change came first."""
        name = f"{self.path}/manifests/{seen + 1:012d}.json"
        fs, target = self._at(name)
        _, draft = self._at(f"{self.path}/manifests/.{uuid.uuid4().hex}")
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps({"folders": folders, "schema": schema.json()}).encode()))
        out.close()
        if fs.exists(target) or not fs.rename(draft, target):
            fs.delete(draft, False)
            raise RuntimeError(f"the log at {self.path} was changed by another writer")

    def _written(self, rows: DataFrame) -> list[str]:
        """Write rows by day and return their folders."""
        batch = f"data/{uuid.uuid4().hex}"
        day = F.date_format(F.col(f"`{self.ts}`"), "yyyy-MM-dd")
        rows.withColumn("__day", F.coalesce(day, F.lit("none"))).write.partitionBy("__day").parquet(f"{self.path}/{batch}")
        return [f"{batch}/{n}" for n in self._children(f"{self.path}/{batch}") if n.startswith("__day=")]

    def append(self, rows: DataFrame) -> None:
        """Add events. Columns must be those of the first append."""
        now = self.manifest()
        if now["schema"] is not None:
            schema = T.StructType.fromJson(json.loads(now["schema"]))
            rows = rows.select(*[F.col(f"`{f.name}`").cast(f.dataType) for f in schema.fields])
        self._commit(now["version"], now["folders"] + self._written(rows), rows.schema)

    def _read(self, folders: list[str], schema: T.StructType) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{f}" for f in folders])

    def read(self) -> DataFrame:
        """All live events, as of now."""
        now = self.manifest()
        if now["schema"] is None:
            raise ValueError(f"nothing was ever logged at {self.path}")
        return self._read(now["folders"], T.StructType.fromJson(json.loads(now["schema"])))

    def purge(self, keep: int = EVENT_RETENTION, tie: Column | None = None) -> int:
        """Drop all but the latest ``keep`` events, by time and then ``tie``, and return how many folders left the log. Events without a time go first."""
        now = self.manifest()
        if now["schema"] is None:
            return 0
        events = self.read()
        ts = F.col(f"`{self.ts}`")
        order = [ts.desc_nulls_last()] + ([tie.desc_nulls_last()] if tie is not None else [])
        kept = events.orderBy(*order).limit(keep)
        first = kept.agg(F.date_format(F.min(ts), "yyyy-MM-dd"), F.count(F.lit(1)), F.count(ts)).first()
        if first[1] < keep:  # all events are kept
            return 0
        # a kept event without a time: nothing with a time goes; nothing kept: every day goes
        edge = "none" if first[1] > first[2] else first[0] or "~"
        day_of = lambda folder: folder.rsplit("=", 1)[-1]
        timed = [f for f in now["folders"] if day_of(f) != "none"]
        late = timed if edge == "none" else [f for f in timed if day_of(f) > edge]
        on_edge = [f for f in now["folders"] if day_of(f) == edge]
        schema = events.schema
        rest = keep - (self._read(late, schema).count() if late else 0)
        new = self._written(self._read(on_edge, schema).orderBy(*order).limit(rest)) if on_edge and rest > 0 else []
        self._commit(now["version"], late + new, schema)
        self.vacuum()
        return len(set(now["folders"]) - set(late))

    def vacuum(self, kept: int = KEPT_MANIFESTS) -> int:
        """Delete the folders that none of the newest ``kept`` manifests lists, and older manifests; returns how many folders went."""
        versions = self.manifests()
        live = reduce(set.union, (set(self.manifest(v)["folders"]) for v in versions[-kept:]), set())
        gone = 0
        for batch in self._children(f"{self.path}/data"):
            days = [n for n in self._children(f"{self.path}/data/{batch}") if n.startswith("__day=")]
            dead = [n for n in days if f"data/{batch}/{n}" not in live]
            for name in dead if len(dead) < len(days) else [""]:
                if days:
                    fs, where = self._at(f"{self.path}/data/{batch}/{name}".rstrip("/"))
                    fs.delete(where, True)
            gone += len(dead)
        for v in versions[:-kept]:
            fs, where = self._at(f"{self.path}/manifests/{v:012d}.json")
            fs.delete(where, False)
        return gone
