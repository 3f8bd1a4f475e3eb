"""Clusters, outliers and projections of number columns."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.ml.clustering import GaussianMixture, KMeans, PowerIterationClustering
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridmill.functions import semantics as S
from gridmill.functions.quantiles import column_quantiles
from gridmill.functions.semantics import col
from gridmill.ml import neighbours
from gridmill.ml.moments import as_array, gram, grouped_gram, mean_cov, quadratic
from gridmill.operators.clean import sample_n, standardize
from gridmill.session import pinned, stored


def vectors(df: DataFrame, columns: Sequence[str], scale: bool = True) -> DataFrame:
    """Complete rows of ``columns`` plus a standard-scaled ``features`` vector."""
    rows = df.dropna(subset=list(columns))
    scaled = rows.select("*", *[col(c).cast("double").alias(f"__s{i}") for i, c in enumerate(columns)])
    names = [f"__s{i}" for i in range(len(columns))]
    if scale:
        scaled = standardize(scaled, names)
    return scaled.withColumn("features", array_to_vector(F.array(*names))).drop(*names)


def embedded(df: DataFrame, column: str) -> DataFrame:
    """``df`` with an array column as the ``features`` vector."""
    return df.withColumn("features", array_to_vector(col(column).cast("array<double>")))


# --- clusters ---------------------------------------------------------------

def kmeans(df: DataFrame, k: int = 4, restarts: int = 10, max_iter: int = 20) -> DataFrame:
    """Add ``cluster``: the best of several seeded starts by total cost. The vectors are held once, starts run side by side."""
    held = df.select("features").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        held.count()
        with ThreadPoolExecutor(max_workers=min(4, restarts)) as pool:
            models = list(pool.map(lambda i: KMeans(k=k, seed=S.SEED + i, maxIter=max_iter).fit(held), range(restarts)))
    finally:
        held.unpersist()
    best = min(models, key=lambda m: m.summary.trainingCost)
    return best.transform(df).withColumnRenamed("prediction", "cluster")


BATCH_ROWS = 10_000


def _first_centres(x: np.ndarray, k: int, rng: np.random.RandomState) -> np.ndarray:
    """k rows, each drawn with a chance that grows with the square of its distance to those before it."""
    found = [x[rng.randint(len(x))]]
    near = ((x - found[0]) ** 2).sum(axis=1)
    while len(found) < k:
        total = near.sum()
        found.append(x[rng.choice(len(x), p=near / total) if total > 0 else rng.randint(len(x))])
        near = np.minimum(near, ((x - found[-1]) ** 2).sum(axis=1))
    return np.stack(found)


def closest(centres: np.ndarray):
    """An expression for the number of the centre nearest to ``features``; the smaller number among equals."""

    @F.pandas_udf("int")
    def cluster(x: pd.Series) -> pd.Series:
        rows = np.stack(x.to_numpy()) if len(x) else np.empty((0, centres.shape[1]))
        return pd.Series(neighbours.distances(rows, centres).argmin(axis=1).astype(np.int32))

    return cluster(as_array("features"))


def minibatch_centres(df: DataFrame, k: int = 4, steps: int = 100, batch: int = BATCH_ROWS, tol: float = 1e-4) -> np.ndarray:
    """Centres from seeded batches of rows.

    A step touches one batch, about ``batch`` rows picked by a hash of the vector; a centre moves towards its new rows' mean by their number
    over all that it has had. Rows outside the batches are not read again: they are laid down by batch once. It stops when a
    step moves no centre by more than ``tol``.
    """
    n = df.count()
    if not n:
        raise S.ColumnError("no complete rows")
    batches = max(1, min(steps, n // batch))
    unit = S.seeded_bucket(F.xxhash64("x", "turn"), S.SEED, 1_000_000_000)
    flat = df.select(as_array("features").alias("x"), F.monotonically_increasing_id().alias("turn"))
    share = batches * batch / n if n > batch else 1.0
    picked = flat.withColumn("u", unit / 1_000_000_000).filter(F.col("u") < min(1.0, share))
    number = F.least(F.lit(batches - 1), F.floor(F.col("u") / min(1.0, share) * batches)).cast("int")
    laid = stored(picked.select("x", number.alias("batch")).repartitionByRange(batches, "batch"), "mini-batches")
    rng = np.random.RandomState(S.SEED)
    first = np.stack([r["x"] for r in laid.filter("batch = 0").orderBy("x").limit(batch).collect()] or [r["x"] for r in laid.limit(batch).collect()])
    centres, counts = _first_centres(first, k, rng), np.zeros(k)
    for step in range(steps):
        def sums(frames: Iterator[pd.DataFrame], centres=centres) -> Iterator[pd.DataFrame]:
            total, seen = np.zeros_like(centres), np.zeros(len(centres))
            for pdf in frames:
                if not pdf.empty:
                    x = np.stack(pdf["x"].to_numpy())
                    home = neighbours.distances(x, centres).argmin(axis=1)
                    np.add.at(total, home, x)
                    seen += np.bincount(home, minlength=len(centres))
            if seen.any():
                yield pd.DataFrame({"cluster": np.flatnonzero(seen), "n": seen[seen > 0], "total": list(total[seen > 0])})

        found = laid.filter(F.col("batch") == step % batches).mapInPandas(sums, "cluster int, n double, total array<double>").collect()
        moved = centres.copy()
        for c in range(k):
            own = [r for r in found if r["cluster"] == c]
            if own:
                m, total = sum(r["n"] for r in own), np.sum([r["total"] for r in own], axis=0)
                counts[c] += m
                moved[c] += (total - m * centres[c]) / counts[c]
        shift, centres = float(np.abs(moved - centres).max()), moved
        if shift < tol:
            break
    return centres


def minibatch_kmeans(df: DataFrame, k: int = 4, steps: int = 100, batch: int = BATCH_ROWS) -> DataFrame:
    """Add ``cluster`` by the centres of ``minibatch_centres``."""
    return df.withColumn("cluster", closest(minibatch_centres(df, k, steps, batch)))


def cluster_quality(df: DataFrame) -> dict[str, float]:
    """Cost (squared distances to the clusters' means) and silhouette of rows with ``features`` and ``cluster``, from sums by cluster; noise (-1) is left out."""
    rows = df.filter("cluster >= 0").withColumn("__x", as_array("features"))
    moments = grouped_gram(rows, F.col("__x"), F.col("cluster"))
    cost = sum(float(np.trace(m[:-1, :-1]) - (m[-1, :-1] ** 2).sum() / m[-1, -1]) for m in moments.values())
    out = {"clusters": float(len(moments)), "cost": cost}
    if 1 < len(moments) < sum(m[-1, -1] for m in moments.values()):
        judge = ClusteringEvaluator(featuresCol="features", predictionCol="cluster", metricName="silhouette")
        out["silhouette"] = float(judge.evaluate(rows.select("features", "cluster")))
    return out


def gaussian_mixture(df: DataFrame, k: int = 4, max_iter: int = 50) -> DataFrame:
    """Add ``cluster`` and ``probability`` (one share per cluster)."""
    model = GaussianMixture(k=k, seed=S.SEED, maxIter=max_iter).fit(df.select("features"))
    out = model.transform(df).withColumn("probability", vector_to_array("probability"))
    return out.withColumnRenamed("prediction", "cluster")


def dbscan(df: DataFrame, key: str, eps: float = 0.5, min_points: int = 5) -> DataFrame:
    """(id, cluster, is_core) by density."""
    return neighbours.dbscan(neighbours.points(df, key, as_array("features")), eps, min_points)


def spectral(df: DataFrame, key: str, k: int = 4, near: int = 10, max_iter: int = 15) -> DataFrame:
    """(id, cluster): power iteration on the graph of nearest neighbours.

    Only ``near`` links per point are kept, weighted by closeness, so the graph
    grows with the rows and not with their square.
    """
    pts = neighbours.points(df, key, as_array("features"))
    found = neighbours.nearest(pts, pts, near, exclude_self=True)
    links = (
        found.select(F.least("id", "neighbour").alias("src"), F.greatest("id", "neighbour").alias("dst"), "distance")
        .groupBy("src", "dst")
        .agg(F.min("distance").alias("d"))
    )
    scale = links.agg(F.avg("d")).first()[0] or 1.0
    graph = links.select("src", "dst", F.greatest(F.exp(-F.pow(F.col("d") / F.lit(scale), 2)), F.lit(1e-6)).alias("weight"))
    model = PowerIterationClustering(k=k, maxIter=max_iter, weightCol="weight", initMode="degree")
    return model.assignClusters(graph).select("id", F.col("cluster").cast("int").alias("cluster"))


def cluster_summary(df: DataFrame, columns: Sequence[str], shown: int | None = None) -> DataFrame:
    """(cluster, size, pct, <column>_mean …), of all columns or the first ``shown``."""
    n = df.agg(F.count(F.lit(1))).scalar()
    sums = df.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("size"), *[F.round(S.mean(col(c)), 2).alias(f"{c}_mean") for c in list(columns)[:shown]]
    )
    return sums.withColumn("pct", F.round(F.col("size") / n * 100, 1))


def segment(df: DataFrame, k: int = 4, columns: Sequence[str] | None = None, restarts: int = 10, most: int | None = None) -> DataFrame:
    """Complete rows with ``features`` and ``cluster`` from all numbers, or the first ``most``, or ``columns``."""
    names = list(columns or S.numeric_columns(df)[:most])
    if len(names) < 2:
        raise S.ColumnError("need at least 2 numeric columns")
    return kmeans(vectors(df, names), k, restarts)


def projected(df: DataFrame, key: str, n: int | None = None) -> DataFrame:
    """(key, x, y, cluster, explained_pct): all rows on two axes, or a seeded sample of ``n``."""
    model = PCA(k=2, inputCol="features", outputCol="axes").fit(df.select("features"))
    share = round(float(sum(model.explainedVariance)) * 100, 1)
    axes = vector_to_array("axes")
    placed = model.transform(df).select(
        col(key).alias("key"), F.round(axes[0], 3).alias("x"), F.round(axes[1], 3).alias("y"), "cluster",
        F.lit(share).alias("explained_pct"),
    )
    return placed if n is None else sample_n(placed, n, "key")


# --- projections ------------------------------------------------------------

def _axes(df: DataFrame, basis: np.ndarray, center: np.ndarray | None = None) -> DataFrame:
    from gridmill.ml.moments import dot

    x = F.col("__x")
    shift = np.zeros(basis.shape[1]) if center is None else center @ basis
    out = df.withColumn("__x", as_array("features"))
    return out.withColumns({f"axis_{j + 1}": dot(x, basis[:, j]) - F.lit(float(shift[j])) for j in range(basis.shape[1])}).drop("__x")


def _signed(basis: np.ndarray) -> np.ndarray:
    """Fix the sign of each axis: its largest entry is positive."""
    top = np.abs(basis).argmax(axis=0)
    return basis * np.sign(basis[top, np.arange(basis.shape[1])])


def pca(df: DataFrame, k: int = 2) -> tuple[DataFrame, list[float]]:
    """Add ``axis_1 …`` of centred rows; also the share of variance per axis."""
    _, mu, cov = mean_cov(gram(df, as_array("features")))
    values, vecs = np.linalg.eigh(cov)
    order = np.argsort(values)[::-1]
    total = max(float(values.sum()), 1e-300)
    return _axes(df, _signed(vecs[:, order[:k]]), mu), [float(values[i] / total) for i in order[:k]]


def truncated_svd(df: DataFrame, k: int = 2) -> tuple[DataFrame, list[float]]:
    """Add ``axis_1 …`` without centring; also the singular values."""
    m = gram(df, as_array("features"))[:-1, :-1]
    values, vecs = np.linalg.eigh(m)
    order = np.argsort(values)[::-1][:k]
    return _axes(df, _signed(vecs[:, order])), [float(np.sqrt(max(values[i], 0.0))) for i in order]


# --- outliers ---------------------------------------------------------------

TREE_ROWS = 256


def _grow(x: np.ndarray, rng: np.random.RandomState, limit: int) -> list[list[float]]:
    """One isolation tree as rows [feature, threshold, left, right, path credit]."""
    nodes: list[list[float]] = []

    def build(rows: np.ndarray, depth: int) -> int:
        here = len(nodes)
        nodes.append([-1, 0.0, -1, -1, depth + average_path(len(rows))])
        spread = np.flatnonzero(rows.max(axis=0) > rows.min(axis=0)) if len(rows) > 1 else []
        if depth >= limit or not len(spread):
            return here
        f = int(rng.choice(spread))
        cut = rng.uniform(rows[:, f].min(), rows[:, f].max())
        left = rows[:, f] <= cut
        nodes[here][:2] = [f, cut]
        nodes[here][2] = build(rows[left], depth + 1)
        nodes[here][3] = build(rows[~left], depth + 1)
        return here

    build(x, 0)
    return nodes


def average_path(n: int) -> float:
    """Expected path length of an unsuccessful search among ``n`` rows."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (np.log(n - 1) + 0.5772156649015329) - 2.0 * (n - 1) / n


def isolation_forest(df: DataFrame, key: str, trees: int = 100, seed: int = S.SEED) -> DataFrame:
    """Add ``anomaly_score`` (0..1) and ``is_anomaly`` (above 0.5).

    Trees grow in parallel, each from at most 256 rows picked by a seeded hash;
    the forest (a few hundred nodes per tree) is broadcast to score all rows.
    """
    n = df.count()
    flat = df.select(col(key).alias("k"), as_array("features").alias("x"))
    copies = TREE_ROWS * trees / max(n, 1)
    unit = lambda salt: S.seeded_bucket(F.concat(F.col("k").cast("string"), salt), seed, 1_000_000) / 1_000_000
    if copies <= 1:
        # plenty of rows: a row goes to one tree at most
        picked = flat.filter(unit(F.lit("|row")) < min(1.0, 1.2 * copies)).withColumn("tree", F.pmod(F.xxhash64("k", F.lit(seed)), F.lit(trees)))
    else:
        spread = flat.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))
        picked = spread.filter(unit(F.concat(F.lit("|"), F.col("tree").cast("string"))) < min(1.0, 1.2 * TREE_ROWS / max(n, 1)))

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        pdf = pdf.sort_values(["turn", "k"]).head(TREE_ROWS)
        x = np.stack(pdf["x"].to_numpy())
        nodes = _grow(x, np.random.RandomState(seed + tree), int(np.ceil(np.log2(max(len(x), 2)))))
        return pd.DataFrame({"tree": [tree], "rows": [len(x)], "nodes": [json.dumps(nodes)]})

    # the sample per tree is bounded by the pick rate; a slight surplus is cut inside
    picked = picked.withColumn("turn", F.xxhash64("k", "tree", F.lit(seed)))  # a surplus row goes by hash, not by key
    grown = picked.groupBy("tree").applyInPandas(grow, "tree bigint, rows bigint, nodes string").collect()
    forest = [(np.array(json.loads(r["nodes"])), r["rows"]) for r in grown]
    shared = df.sparkSession.sparkContext.broadcast(forest)

    @F.pandas_udf("double")
    def score(x: pd.Series) -> pd.Series:
        rows = np.stack(x.to_numpy())
        depth = np.zeros(len(rows))
        norm = 0.0
        for nodes, used in shared.value:
            at = np.zeros(len(rows), dtype=int)
            while True:
                f = nodes[at, 0].astype(int)
                inner = f >= 0
                if not inner.any():
                    break
                i = np.flatnonzero(inner)
                left = rows[i, f[i]] <= nodes[at[i], 1]
                at[i] = np.where(left, nodes[at[i], 2], nodes[at[i], 3]).astype(int)
            depth += nodes[at, 4]
            norm += average_path(used)
        return pd.Series(np.power(2.0, -depth / max(norm, 1e-12)))

    out = df.withColumn("anomaly_score", F.round(score(as_array("features")), 4))
    return out.withColumn("is_anomaly", F.col("anomaly_score") > 0.5)


def local_outlier_factor(df: DataFrame, key: str, k: int = 20) -> DataFrame:
    """(id, lof, is_anomaly) from the exact k nearest neighbours."""
    pts = neighbours.points(df, key, as_array("features"))
    near = pinned(neighbours.nearest(pts, pts, k, exclude_self=True))
    reach = near.groupBy(F.col("id").alias("nid")).agg(F.max("distance").alias("kd"))
    density = (
        near.join(reach, F.col("neighbour") == F.col("nid"))
        .groupBy("id")
        .agg((1 / (F.avg(F.greatest("kd", "distance")) + 1e-10)).alias("lrd"))
    )
    density = pinned(density)
    theirs = density.select(F.col("id").alias("nid"), F.col("lrd").alias("their"))
    ratio = near.join(theirs, F.col("neighbour") == F.col("nid")).groupBy("id").agg(F.avg("their").alias("their"))
    return ratio.join(density, "id").select(
        "id", F.round(F.col("their") / F.col("lrd"), 4).alias("lof"), (F.col("their") / F.col("lrd") > 1.5).alias("is_anomaly")
    )


def robust_moments(df: DataFrame, rounds: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(mean, inverse covariance) of ``features``, refitted on the closest half of the rows a few times, so that outliers do not shape the ellipse."""
    x = as_array("features")
    n, mu, cov = mean_cov(gram(df, x))
    keep = min(1.0, (n + len(mu) + 1) / (2 * n))
    work, inv = df.select(x.alias("__x")), np.linalg.pinv(cov)
    for _ in range(rounds):
        dist = work.withColumn("__d", quadratic(F.col("__x"), mu, inv))
        cut = column_quantiles(dist, ["__d"], [keep], int(n))["__d"][0]
        _, new_mu, new_cov = mean_cov(gram(dist.filter(F.col("__d") <= F.lit(cut)), F.col("__x")))
        moved = float(np.abs(new_mu - mu).max())
        mu, inv = new_mu, np.linalg.pinv(new_cov)
        if moved < 1e-9:
            break
    return mu, inv


def elliptic_envelope(df: DataFrame, contamination: float = 0.05, rounds: int = 5) -> DataFrame:
    """Add ``mahalanobis`` (squared, by ``robust_moments``) and ``is_anomaly``: the farthest share ``contamination``."""
    mu, inv = robust_moments(df, rounds)
    dist = df.withColumn("__d", quadratic(as_array("features"), mu, inv))
    cut = column_quantiles(dist, ["__d"], [1 - contamination])["__d"][0]
    return dist.withColumns({"mahalanobis": F.round("__d", 4), "is_anomaly": F.col("__d") > F.lit(cut)}).drop("__d")
