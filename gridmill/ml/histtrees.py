"""Boosted trees grown from histograms of binned features.

Features are binned once, to one byte each: up to 255 bins by quantiles, and one for missing values, so nothing is imputed. A tree grows level by
level. One aggregate a level sums, for each open node, feature and bin, the rows' weight H, their number and their targets G; the best cut
of a feature maximises the sum of G² / H over both sides, and missing values go to the side where they do better. This one rule is

* least squares, with H the weight and G the weighted label;
* Gini impurity, with G the weights by class;
* a Newton step on any loss, with H the second and G the negative first derivative; all classes' trees grow in the same pass.

Partial histograms leave a task as one row for each (tree, node, feature), are summed by key, and only best cuts reach the driver: as many rows as
trees x open nodes x features, whatever the table. ``PASS_BYTES`` bounds the histograms that a task holds; more nodes than that take another pass.

What boosting knows of a row (raw scores, or the log of its weight) is kept with the binned rows. Each round adds its own trees to it once, and
the levels of the next round read it. Some thousand rows of a fit are one row of that table, as bytes. Every ``HOLD`` rounds it is stored in the shared folder, which ends the lineage.

Several fits, such as the folds of a cross-validation, are boosted together: their rows are stacked with the number of the fit, each
with its own bins, and one aggregate a level serves them all.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.linalg import DenseVector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridmill.functions import semantics as S
from gridmill.ml.moments import as_array
from gridmill.session import stored

BINS = 255
MISSING = BINS  # the bin of missing values
HOLD = 10
PASS_BYTES = 64 * 1024 * 1024
LEAST_GAIN = 1e-12
CUTS_IN_TASK = 250  # tables of a node and feature that a task finds the best cut of, as long as there are cores
ROWS_IN_TASK = 20_000  # binned rows in a task, as long as there are cores
ROWS_IN_BLOCK = 10_000  # binned rows that are one row of the table that a level reads
BLOCK = "fit int, n int, bins binary, label binary, weight binary, state binary, row binary"
ACCURACY = 10_000  # of the quantiles that cut the bins


@dataclass
class Tree:
    """Nodes as parallel lists; a leaf has feature -1. ``value`` is G / H of the node, one number for each target."""

    feature: list[int] = field(default_factory=list)
    cut: list[int] = field(default_factory=list)
    missing_left: list[bool] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[list[float]] = field(default_factory=list)
    weight: list[float] = field(default_factory=list)
    gain: list[float] = field(default_factory=list)

    def add(self, value: list[float], weight: float) -> int:
        for column, v in ((self.feature, -1), (self.cut, 0), (self.missing_left, False), (self.left, 0), (self.right, 0), (self.gain, 0.0)):
            column.append(v)
        self.value.append(value)
        self.weight.append(weight)
        return len(self.feature) - 1

    def nodes_of(self, bins: np.ndarray) -> np.ndarray:
        """The leaf, or open node, that each row of binned features reaches."""
        feature, step = self._steps()
        node, cells = np.zeros(len(bins), np.int32), np.ascontiguousarray(bins).ravel()
        first = np.arange(len(bins)) * bins.shape[1]
        for _ in range(self._levels()):
            node = step[node * (BINS + 1) + cells[first + feature[node]]]
        return node

    def _steps(self) -> tuple[np.ndarray, np.ndarray]:
        """The feature each node asks for, and the node that follows for each node and bin: a leaf follows itself."""
        n = len(self.feature)
        step = np.repeat(np.arange(n, dtype=np.int32), BINS + 1).reshape(n, -1)
        for i, f in enumerate(self.feature):
            if f >= 0:
                step[i, : self.cut[i] + 1], step[i, self.cut[i] + 1 :] = self.left[i], self.right[i]
                step[i, MISSING] = self.left[i] if self.missing_left[i] else self.right[i]
        return np.maximum(np.array(self.feature), 0), step.ravel()

    def _levels(self) -> int:
        """Cuts on the longest way down; children come after their parents."""
        below = [0] * len(self.feature)
        for i in range(len(below) - 1, -1, -1):
            if self.feature[i] >= 0:
                below[i] = 1 + max(below[self.left[i]], below[self.right[i]])
        return below[0]

    def values_of(self, bins: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.nodes_of(bins)]


# --- bins --------------------------------------------------------------------

def bin_edges(df: DataFrame, n_features: int) -> list[list[float]]:
    """Cuts by feature, from quantiles of the values that are not missing; a value up to the k-th cut is in bin k."""
    x = F.col("__x")
    # one expression for all features: a literal for each share of each feature costs the driver a minute
    shares = F.expr(f"array({', '.join(f'{k / BINS!r}D' for k in range(1, BINS))})")
    value = lambda i: F.when(~F.isnan(F.get(x, F.lit(i))), F.get(x, F.lit(i)))
    row = df.select(as_array("features").alias("__x")).agg(*[F.percentile_approx(value(i), shares, ACCURACY).alias(f"q{i}") for i in range(n_features)]).first()
    return [sorted(set(q or [])) for q in row]


def binned_matrix(values: np.ndarray, edges: list[list[float]]) -> np.ndarray:
    """Bytes for a matrix of feature values, NaN for missing ones."""
    out = np.empty(values.shape, np.uint8)
    for i, cuts in enumerate(edges):
        column = values[:, i]
        out[:, i] = np.where(np.isnan(column), MISSING, np.searchsorted(np.array(cuts), column, "left"))
    return out


def stacked(tables: list[DataFrame], edges: list[list[list[float]]], starts: list[list[float]]) -> DataFrame:
    """(fit, row, bins, label, weight, state): the rows of all fits with binned features and their first state, stored."""
    parts = []
    for fit, (df, cuts, start) in enumerate(zip(tables, edges, starts, strict=True)):
        weight = F.col("weight").cast("double") if "weight" in df.columns else F.lit(1.0)
        rows = df.select(as_array("features").alias("x"), F.col("label").cast("double").alias("label"), weight.alias("weight"))

        def run(batches: Iterator[pa.RecordBatch], cuts=cuts, start=start, fit=fit) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if n := batch.num_rows:
                    cells = binned_matrix(_matrix(batch.column("x"), len(cuts)), cuts)
                    first = np.array(start).tobytes()
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([fit] * n, pa.int32()), pa.array([c.tobytes() for c in cells], pa.binary()), batch.column("label"), batch.column("weight"), pa.array([first] * n, pa.binary())],
                        names=["fit", "bins", "label", "weight", "state"],
                    )

        parts.append(rows.mapInArrow(run, "fit int, bins binary, label double, weight double, state binary"))
    whole = functools.reduce(DataFrame.unionByName, parts)
    return stored(whole.withColumn("row", F.monotonically_increasing_id()), "binned-rows")


def _joined(column: pa.Array, kind: type) -> np.ndarray:
    """The bytes of a binary column without nulls, as rows of numbers."""
    ends = np.frombuffer(column.buffers()[1], np.int64 if pa.types.is_large_binary(column.type) else np.int32)
    ends = ends[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(kind).reshape(len(column), -1)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)


def _rows_by_fit(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(fit, cells, label, weight, state, row) for each fit that a batch of ``stacked`` has rows of."""
    for batch in batches:
        number = batch.column("fit").to_numpy()
        for fit in np.unique(number).tolist():
            own = batch if (number == fit).all() else batch.filter(pa.array(number == fit))
            cells, state = _joined(own.column("bins"), np.uint8), _joined(own.column("state"), np.float64)
            yield fit, cells, own.column("label").to_numpy(), own.column("weight").to_numpy(), state, own.column("row").to_numpy()


def _block(fit: int, *parts: np.ndarray) -> pa.RecordBatch:
    """Rows of a fit as one row: every level of every round hands on bytes, not rows."""
    columns = [pa.array([fit], pa.int32()), pa.array([len(parts[0])], pa.int32()), *(pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()) for x in parts)]
    return pa.RecordBatch.from_arrays(columns, names=["fit", "n", "bins", "label", "weight", "state", "row"])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, list] = {}
    for fit, *parts in _rows_by_fit(batches):
        held.setdefault(fit, []).append(parts)
        if sum(len(p[0]) for p in held[fit]) >= ROWS_IN_BLOCK:
            yield _block(fit, *(np.concatenate(c) for c in zip(*held.pop(fit), strict=True)))
    for fit, parts in held.items():
        yield _block(fit, *(np.concatenate(c) for c in zip(*parts, strict=True)))


def _by_fit(batches: Iterator[pa.RecordBatch], fits=None) -> Iterator[tuple]:
    """(fit, cells, label, weight, state, row) for each block of one of the ``fits``."""
    kinds = {"bins": np.uint8, "label": np.float64, "weight": np.float64, "state": np.float64, "row": np.int64}
    for batch in batches:
        for i, (fit, n) in enumerate(zip(batch.column("fit").to_pylist(), batch.column("n").to_pylist(), strict=True)):
            if fits is None or fit in fits:
                cells, label, weight, state, row = (np.frombuffer(batch.column(c)[i].as_buffer(), kind) for c, kind in kinds.items())
                yield fit, cells.reshape(n, -1), label, weight, state.reshape(n, -1), row


# --- one tree, or one for each class -----------------------------------------

def _best_cut(total: np.ndarray, min_rows: int, l2: float) -> tuple[float, int, bool, np.ndarray]:
    """(gain, cut, missing_left, sums of the left side) for the sums by bin of one feature: H, rows, then targets."""
    score = lambda s: (s[..., 2:] ** 2).sum(axis=-1) / np.maximum(s[..., 0] + l2, 1e-300)
    whole, missing = total.sum(axis=0), total[MISSING]
    left = np.cumsum(total[:MISSING], axis=0)
    best = (0.0, 0, False, whole)
    for with_missing in ((True, False) if missing[1] else (False,)):
        low = left + missing if with_missing else left
        high = whole - low
        gain = np.where((low[:, 1] >= min_rows) & (high[:, 1] >= min_rows), score(low) + score(high) - score(whole), -np.inf)
        at = int(np.argmax(gain))
        if gain[at] > best[0]:
            # values that were never missing in training go where more rows go
            best = (float(gain[at]), at, bool(with_missing if missing[1] else low[at, 1] >= high[at, 1]), low[at])
    return best


def grow(rows: DataFrame, stats: Callable, widths: dict[int, int], targets: int, trees: int, depth: int, min_rows: int = 1, l2: float = 0.0) -> dict[int, list[Tree]]:
    """``trees`` trees of ``depth`` levels at most for each fit, whose number of features ``widths`` has.

    ``stats(fit, cells, label, weight, state, row)`` gives H (rows x trees) and G (rows x trees x targets).
    """
    grown = {fit: [Tree() for _ in range(trees)] for fit in widths}
    # the root's sums come with its histogram
    open_nodes = [(fit, t, grown[fit][t].add([0.0] * targets, 0.0)) for fit in widths for t in range(trees)]
    sums = 2 + targets
    at_once = max(1, PASS_BYTES // (max(widths.values()) * (BINS + 1) * 8 * sums))
    for _ in range(depth):
        ahead = []
        for start in range(0, len(open_nodes), at_once):
            part = open_nodes[start : start + at_once]
            for n, cuts in _cuts(rows, stats, widths, grown, part, sums, min_rows, l2).items():
                fit, t, node = part[n]
                tree, whole = grown[fit][t], np.array(cuts[0]["whole"])
                tree.value[node], tree.weight[node] = (whole[2:] / max(whole[0] + l2, 1e-300)).tolist(), float(whole[0])
                top = min(cuts, key=lambda r: (-r["gain"], r["feature"]))
                if top["gain"] <= LEAST_GAIN * max(1.0, abs(whole[0])):
                    continue
                low = np.array(top["low"])
                tree.feature[node], tree.cut[node], tree.missing_left[node], tree.gain[node] = top["feature"], top["cut"], top["missing_left"], top["gain"]
                for side, name in ((low, "left"), (whole - low, "right")):
                    child = tree.add((side[2:] / max(side[0] + l2, 1e-300)).tolist(), float(side[0]))
                    getattr(tree, name)[node] = child
                    if side[1] >= 2 * min_rows:
                        ahead.append((fit, t, child))
        open_nodes = ahead
        if not open_nodes:
            break
    return grown


def _cuts(rows: DataFrame, stats: Callable, widths: dict[int, int], grown: dict[int, list[Tree]], part: list, sums: int, min_rows: int, l2: float) -> dict[int, list]:
    """The best cut of each feature, by the number of the node in ``part``: one aggregate."""
    own = {fit: [(n, t, node) for n, (f, t, node) in enumerate(part) if f == fit] for fit in {f for f, _, _ in part}}

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {n: np.zeros((widths[fit], sums, BINS + 1)) for n, (fit, _, _) in enumerate(part)}
        for fit, cells, label, weight, state, row in _by_fit(batches, own):
            h, g = stats(fit, cells, label, weight, state, row)
            for t in sorted({t for _, t, _ in own[fit]}):
                nodes = [(n, node) for n, tree, node in own[fit] if tree == t]
                lookup = np.full(len(grown[fit][t].feature), -1)
                lookup[[node for _, node in nodes]] = np.arange(len(nodes))
                place = lookup[grown[fit][t].nodes_of(cells)]
                here = np.flatnonzero((place >= 0) & (h[:, t] > 0))
                place, columns = place[here], [h[here, t], None, *g[here, t].T]
                for f in range(cells.shape[1]):
                    cell = place * (BINS + 1) + cells[here, f]
                    for k, w in enumerate(columns):
                        found = np.bincount(cell, w, len(nodes) * (BINS + 1)).reshape(len(nodes), -1)
                        for (n, _), bins in zip(nodes, found, strict=True):
                            held[n][f, k] += bins
        keys = [(n, f) for n, table in held.items() if table[0, 1].any() for f in range(len(table))]
        if keys:
            yield pa.RecordBatch.from_arrays(
                [pa.array([n for n, _ in keys], pa.int32()), pa.array([f for _, f in keys], pa.int32()), pa.array([held[n][f].tobytes() for n, f in keys], pa.binary())],
                names=["node", "feature", "sums"],
            )

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for n, f, b in zip(*(batch.column(c).to_pylist() for c in ("node", "feature", "sums")), strict=True):
                totals[n, f] = totals.get((n, f), 0.0) + np.frombuffer(b, float)
        found = []
        for (n, f), flat in totals.items():
            total = flat.reshape(sums, BINS + 1).T
            gain, cut, missing_left, low = _best_cut(total, min_rows, l2)
            found.append((n, f, gain, cut, missing_left, low.tolist(), total.sum(axis=0).tolist()))
        if found:
            kinds = (pa.int32(), pa.int32(), pa.float64(), pa.int32(), pa.bool_(), pa.list_(pa.float64()), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], names=["node", "feature", "gain", "cut", "missing_left", "low", "whole"])

    found: dict[int, list] = {}
    # all partial sums of a node and feature meet in one task, which holds one table for each
    tasks = _tasks(rows, sum(widths[fit] for fit, _, _ in part), CUTS_IN_TASK)
    met = rows.mapInArrow(partial, "node int, feature int, sums binary").repartition(tasks, "node", "feature")
    for r in met.mapInArrow(best, "node int, feature int, gain double, cut int, missing_left boolean, low array<double>, whole array<double>").collect():
        found.setdefault(r["node"], []).append(r)
    return found


def _tasks(df: DataFrame, n: int, each: int) -> int:
    """Tasks for ``n`` pieces of work, ``each`` of them in one as long as there are cores."""
    return max(1, min(df.sparkSession.sparkContext.defaultParallelism, -(-n // each)))


class _Rows:
    """The binned rows with their state, held for the levels of a round and stored anew every ``HOLD`` rounds."""

    def __init__(self, table: DataFrame):
        self.tasks = _tasks(table, table.count(), ROWS_IN_TASK)
        table = self._dealt(table)
        self.table = (table.mapInArrow(_blocks, BLOCK) if "bins" in table.columns else table).persist(StorageLevel.MEMORY_AND_DISK)
        self.old: DataFrame | None = None
        self.rounds = 0

    def move(self, moved: Callable) -> None:
        """The state becomes ``moved(fit, cells, label, state)``."""
        self.rounds += 1

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for fit, cells, label, weight, state, row in _by_fit(batches):
                yield _block(fit, cells, label, weight, moved(fit, cells, label, state), row)

        after = self.table.mapInArrow(run, BLOCK)
        if self.rounds % HOLD == 0:
            after = self._dealt(stored(after, "binned-rows"))
        self._drop()  # the table before this one is not read any more, now that this one is held
        self.old, self.table = self.table, after.persist(StorageLevel.MEMORY_AND_DISK)

    def _dealt(self, table: DataFrame) -> DataFrame:
        """Small files are read by few tasks, but every level of every round goes through all rows."""
        return table.repartition(self.tasks) if self.tasks > table.rdd.getNumPartitions() else table

    def _drop(self) -> None:
        if self.old is not None:
            self.old.unpersist()
            self.old = None

    def close(self) -> None:
        self.table.unpersist()
        self._drop()


# --- the model ---------------------------------------------------------------

def _softmax(raw: np.ndarray) -> np.ndarray:
    e = np.exp(raw - raw.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _weighted_median(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    order = np.argsort(values, axis=1, kind="stable")
    reached = np.cumsum(weights[order], axis=1) >= weights.sum() / 2
    return values[np.arange(len(values)), order[np.arange(len(values)), reached.argmax(axis=1)]]


class HistModel:
    """Rounds of trees. ``kind``: sum (of leaf values, a number), chance (sums through softmax or the logistic), vote (by class), median."""

    def __init__(self, kind: str, edges: list, start: list[float], rounds: list[list[Tree]], weights: list[float], classes: list[float] | None):
        self.kind, self.edges, self.start, self.rounds, self.weights, self.classes = kind, edges, start, rounds, weights, classes

    def scores(self, values: np.ndarray) -> np.ndarray:
        """Rows x classes of probabilities, or one column of predictions."""
        cells = binned_matrix(values, self.edges)
        if self.kind == "vote":
            out = np.zeros((len(cells), len(self.classes)))
            for (tree,), w in zip(self.rounds, self.weights, strict=True):
                out[np.arange(len(cells)), tree.values_of(cells).argmax(axis=1)] += w
            return out / (sum(self.weights) or 1.0)
        if self.kind == "median":
            each = np.column_stack([tree.values_of(cells)[:, 0] for (tree,) in self.rounds])
            return _weighted_median(each, np.array(self.weights))[:, None]
        raw = np.tile(np.array(self.start), (len(cells), 1))
        for trees, w in zip(self.rounds, self.weights, strict=True):
            raw += w * np.column_stack([t.values_of(cells)[:, 0] for t in trees])
        if self.kind == "sum":
            return raw
        if raw.shape[1] == 1:
            p = 1 / (1 + np.exp(-raw[:, 0]))
            return np.column_stack([1 - p, p])
        return _softmax(raw)

    def transform(self, df: DataFrame) -> DataFrame:
        width, scores = len(self.edges), self.scores

        @F.pandas_udf("array<double>")
        def scored(x: pd.Series) -> pd.Series:
            return pd.Series(list(scores(np.array(x.tolist(), float).reshape(-1, width))))

        out = df.withColumn("__s", scored(as_array("features")))
        if self.classes is None:
            return out.withColumn("prediction", F.get("__s", F.lit(0))).drop("__s")
        best = F.array_position("__s", F.array_max("__s")).cast("int")
        return out.withColumns({"prediction": F.get(F.array(*[F.lit(float(c)) for c in self.classes]), best - 1), "probability": F.col("__s")}).drop("__s")

    @property
    def featureImportances(self) -> DenseVector:
        """Shares of the gain, by feature."""
        total = np.zeros(len(self.edges))
        for trees, w in zip(self.rounds, self.weights, strict=True):
            for t in trees:
                for f, g in zip(t.feature, t.gain, strict=True):
                    if f >= 0:
                        total[f] += g * (w if self.kind in ("vote", "median") else 1.0)
        return DenseVector(total / (total.sum() or 1.0))

    def save(self, path: str) -> None:
        state = {**self.__dict__, "rounds": [[asdict(t) for t in trees] for trees in self.rounds]}
        S.small_frame(SparkSession.getActiveSession(), [(json.dumps(state),)], "value string").write.text(path)

    @staticmethod
    def load(path: str) -> "HistModel":
        state = json.loads(SparkSession.getActiveSession().read.text(path).first()[0])
        state["rounds"] = [[Tree(**t) for t in trees] for trees in state["rounds"]]
        return HistModel(**state)


# --- boosting ----------------------------------------------------------------

def _edges(tables: list[DataFrame]) -> list[list[list[float]]]:
    def one(df: DataFrame) -> list[list[float]]:
        return bin_edges(df, len(df.select("features").first()["features"]))

    with ThreadPoolExecutor(max_workers=len(tables)) as pool:
        return list(pool.map(one, tables))


def _first_scores(df: DataFrame, n_classes: int) -> list[float]:
    weight = F.col("weight").cast("double") if "weight" in df.columns else F.lit(1.0)
    if n_classes > 2:
        counts = {int(r["label"]): r["w"] for r in df.groupBy("label").agg(F.sum(weight).alias("w")).collect()}
        whole = sum(counts.values())
        return [float(np.log(max(counts.get(k, 0.0), 1e-12) / whole)) for k in range(n_classes)]
    mean = df.agg(F.sum(weight * F.col("label")) / F.sum(weight)).first()[0]
    return [float(np.log(max(mean, 1e-12) / max(1 - mean, 1e-12)))] if n_classes else [float(mean)]


def fit_boosted(
    tables: list[DataFrame], n_classes: int = 0, rounds: int = 100, depth: int = 5, rate: float = 0.1, subsample: float = 1.0, min_rows: int = 20, l2: float = 0.0,
) -> list[HistModel]:
    """Gradient boosting of each table: squares for numbers (``n_classes`` 0), the logistic loss for two classes, softmax for more.

    Labels of classes are 0, 1, … A round's trees, one a class, share their passes. With ``subsample``, a round sees the rows that a
    seeded hash of their number picks.
    """
    edges = _edges(tables)
    starts = [_first_scores(df, n_classes) for df in tables]
    rows = _Rows(stacked(tables, edges, starts))
    done: list[list[list[Tree]]] = [[] for _ in tables]
    widths = {fit: len(e) for fit, e in enumerate(edges)}

    try:
        for r in range(rounds):
            def stats(fit, cells, label, weight, raw, row, r=r):
                if subsample < 1:
                    mixed = (row.astype(np.uint64) + np.uint64(r * 2 + 1)) * np.uint64(0x9E3779B97F4A7C15)
                    weight = np.where((mixed >> np.uint64(40)) < subsample * (1 << 24), weight, 0.0)
                w = weight[:, None]
                if n_classes == 0:
                    return np.broadcast_to(w, raw.shape), (w * (label[:, None] - raw))[..., None]
                p = _softmax(raw) if n_classes > 2 else 1 / (1 + np.exp(-raw))
                y = (label[:, None] == np.arange(n_classes)) if n_classes > 2 else label[:, None]
                return w * np.maximum(p * (1 - p), 1e-12), (w * (y - p))[..., None]

            grown = grow(rows.table, stats, widths, 1, len(starts[0]), depth, min_rows, l2)
            for fit, trees in grown.items():
                done[fit].append(trees)
            if r + 1 < rounds:
                rows.move(lambda fit, cells, label, state, grown=grown: state + rate * np.column_stack([t.values_of(cells)[:, 0] for t in grown[fit]]))
    finally:
        rows.close()
    kind, classes = ("chance", [float(k) for k in range(n_classes)]) if n_classes else ("sum", None)
    return [HistModel(kind, e, s, d, [rate] * len(d), classes) for e, s, d in zip(edges, starts, done, strict=True)]


def fit_adaboost_classifier(tables: list[DataFrame], n_classes: int, rounds: int = 50, depth: int = 1, rate: float = 1.0) -> list[HistModel]:
    """SAMME for each table. A row's weight is its first one times exp of the votes of the trees that got it wrong.

    A tree's error follows from its leaves' sums, and the total weight after a round from the error and the vote, so a round of stumps is one aggregate.
    """
    edges = _edges(tables)
    rows = _Rows(stacked(tables, edges, [[0.0]] * len(tables)))
    trees: list[list[Tree]] = [[] for _ in tables]
    votes: list[list[float]] = [[] for _ in tables]
    widths, log_total = {fit: len(e) for fit, e in enumerate(edges)}, [0.0] * len(tables)
    one = np.arange(n_classes)

    try:
        for r in range(rounds):
            def stats(fit, cells, label, weight, state, row, shift=tuple(log_total)):
                w = weight * np.exp(state[:, 0] - shift[fit])
                return w[:, None], (w[:, None] * (label[:, None] == one))[:, None, :]

            for fit, (tree,) in grow(rows.table, stats, widths, n_classes, 1, depth).items():
                leaves = [(w, max(v)) for f, w, v in zip(tree.feature, tree.weight, tree.value, strict=True) if f < 0]
                err = sum(w * (1 - top) for w, top in leaves) / (sum(w for w, _ in leaves) or 1.0)
                worse = err >= 1 - 1 / n_classes
                if not (worse and trees[fit]):
                    trees[fit].append(tree)
                    votes[fit].append(1.0 if worse or err <= 1e-15 else float(rate * (np.log((1 - err) / err) + np.log(n_classes - 1))))
                    log_total[fit] += float(np.log(1 - err + err * np.exp(votes[fit][-1])))
                if worse or err <= 1e-15:
                    del widths[fit]  # this fit is done
            if not widths:
                break
            if r + 1 < rounds:
                last = {fit: (trees[fit][-1], votes[fit][-1]) for fit in widths}

                def raised(fit, cells, label, state, last=last):
                    if fit not in last:
                        return state
                    tree, vote = last[fit]
                    return state + vote * (tree.values_of(cells).argmax(axis=1) != label)[:, None]

                rows.move(raised)
    finally:
        rows.close()
    return [HistModel("vote", e, [], [[t] for t in own], v, one.astype(float).tolist()) for e, own, v in zip(edges, trees, votes, strict=True)]


def fit_adaboost_regressor(tables: list[DataFrame], rounds: int = 50, depth: int = 3, rate: float = 1.0) -> list[HistModel]:
    """AdaBoost.R2 with linear loss for each table, by weights instead of resampling: one more aggregate a round for the largest and the mean error."""
    edges = _edges(tables)
    rows = _Rows(stacked(tables, edges, [[0.0]] * len(tables)))
    trees: list[list[Tree]] = [[] for _ in tables]
    votes: list[list[float]] = [[] for _ in tables]
    widths = {fit: len(e) for fit, e in enumerate(edges)}

    try:
        for r in range(rounds):
            steps: dict[int, tuple[Tree, float, float]] = {}  # this round's tree, log of beta times rate, largest error

            def stats(fit, cells, label, weight, state, row):
                w = weight * np.exp(state[:, 0])
                return w[:, None], (w * label)[:, None, None]

            grown = grow(rows.table, stats, widths, 1, 1, depth)

            def errors(batches: Iterator[pa.RecordBatch], grown=grown) -> Iterator[pa.RecordBatch]:
                for fit, cells, label, weight, state, _ in _by_fit(batches, grown):
                    w, e = weight * np.exp(state[:, 0]), np.abs(grown[fit][0].values_of(cells)[:, 0] - label)
                    yield pa.RecordBatch.from_arrays([pa.array([fit], pa.int32()), *(pa.array([float(x)]) for x in (e.max(), (w * e).sum(), w.sum()))], names=["fit", "top", "we", "w"])

            found = rows.table.mapInArrow(errors, "fit int, top double, we double, w double").groupBy("fit").agg(F.max("top").alias("top"), F.sum("we").alias("we"), F.sum("w").alias("w")).collect()
            for row in found:
                fit, top = row["fit"], row["top"]
                mean = row["we"] / row["w"] / top if top else 0.0
                over = not top or mean <= 1e-15 or mean >= 0.5
                if not (mean >= 0.5 and trees[fit]):
                    trees[fit].append(grown[fit][0])
                    votes[fit].append(1.0 if over else float(rate * np.log((1 - mean) / mean)))
                if over:
                    del widths[fit]  # this fit is done
                else:
                    steps[fit] = (grown[fit][0], float(rate * np.log(mean / (1 - mean))), float(top))
            if not widths:
                break
            if r + 1 < rounds:
                def lowered(fit, cells, label, state, steps=steps):
                    if fit not in steps:
                        return state
                    tree, log_beta, top = steps[fit]
                    return state + log_beta * (1 - np.abs(tree.values_of(cells)[:, 0] - label) / top)[:, None]

                rows.move(lowered)
    finally:
        rows.close()
    return [HistModel("median", e, [], [[t] for t in own], v, None) for e, own, v in zip(edges, trees, votes, strict=True)]
