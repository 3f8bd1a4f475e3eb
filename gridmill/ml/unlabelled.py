"""Training without a target: clusters, outliers and projections, with a report and a stored model.

Complete rows of the number columns are standard-scaled, an operator of ``groups`` answers for each row, and sums over the answers make
the report. Models that know a rule for new rows are stored with it; the others (dbscan, spectral, local outlier factor) are
about the rows they saw, and only their answers are stored.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.ml.clustering import GaussianMixture, GaussianMixtureModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridmill.functions import semantics as S
from gridmill.functions.quantiles import column_quantiles
from gridmill.functions.semantics import col
from gridmill.ml import groups
from gridmill.ml.moments import as_array, dot, gram, mean_cov, quadratic
from gridmill.session import stored

CLUSTERING = ("kmeans", "minibatch_kmeans", "dbscan", "spectral", "gmm")
OUTLIERS = ("isolation_forest", "local_outlier_factor", "elliptic_envelope")
PROJECTIONS = ("pca", "truncated_svd")
ALGORITHMS = (*CLUSTERING, *OUTLIERS, *PROJECTIONS)
ID = "__row"


@dataclass
class Unlabelled:
    """A scaler and, where the algorithm has one, its rule for new rows."""

    algo_id: str
    columns: list[str]
    means: list[float]
    deviations: list[float]
    rule: dict = field(default_factory=dict)
    mixture: object = None

    def prepared(self, df: DataFrame) -> DataFrame:
        """Complete rows of ``df`` with the scaled ``features``; an infinite or NaN number counts as missing."""
        known = [S.finite(col(c).cast("double")) for c in self.columns]
        scaled = [(v - F.lit(m)) / F.lit(d) for v, m, d in zip(known, self.means, self.deviations, strict=True)]
        array = F.array(*scaled)
        return df.withColumn("features", F.when(~F.exists(array, lambda v: v.isNull()), array)).filter("features IS NOT NULL").withColumn("features", array_to_vector("features"))

    def apply(self, df: DataFrame) -> DataFrame:
        """Complete rows of ``df`` with the answer of the stored rule."""
        rows, rule = self.prepared(df), self.rule
        if "centres" in rule:
            out = rows.withColumn("cluster", groups.closest(np.array(rule["centres"])))
        elif self.mixture is not None:
            out = self.mixture.transform(rows).withColumnRenamed("prediction", "cluster").withColumn("probability", vector_to_array("probability"))
        elif "basis" in rule:
            basis, centre = np.array(rule["basis"]), np.array(rule["centre"])
            shift = centre @ basis
            x = as_array("features")
            out = rows.withColumns({f"axis_{j + 1}": dot(x, basis[:, j]) - F.lit(float(shift[j])) for j in range(basis.shape[1])})
        elif "inverse" in rule:
            out = rows.withColumn("mahalanobis", quadratic(as_array("features"), np.array(rule["centre"]), np.array(rule["inverse"])))
            out = out.withColumn("is_anomaly", F.col("mahalanobis") > F.lit(rule["cut"]))
        else:
            raise ValueError(f"{self.algo_id} has no rule for new rows")
        return out.drop("features")

    def save(self, spark: SparkSession, path: str) -> None:
        plain = {k: v for k, v in self.__dict__.items() if k != "mixture"}
        S.small_frame(spark, [(json.dumps({**plain, "has_mixture": self.mixture is not None}),)], "value string").write.text(f"{path}/unlabelled")
        if self.mixture is not None:
            self.mixture.save(f"{path}/mixture")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "Unlabelled":
        state = json.loads(spark.read.text(f"{path}/unlabelled").first()[0])
        mixture = GaussianMixtureModel.load(f"{path}/mixture") if state.pop("has_mixture") else None
        return Unlabelled(**state, mixture=mixture)


def _scaler(df: DataFrame, columns: Sequence[str]) -> tuple[list[float], list[float]]:
    known = [S.finite(col(c).cast("double")) for c in columns]
    whole = ~F.exists(F.array(*known), lambda v: v.isNull())
    row = df.filter(whole).agg(*[f(v) for v in known for f in (F.avg, F.stddev_pop)]).first()
    return [row[2 * i] or 0.0 for i in range(len(known))], [row[2 * i + 1] or 1.0 for i in range(len(known))]


def fit(
    df: DataFrame, algo_id: str, params: dict | None = None, columns: Sequence[str] | None = None, skip: Sequence[str] = ()
) -> tuple[Unlabelled, DataFrame, dict[str, float]]:
    """(model, rows with their answers, report).

    Works on ``columns``, or all number columns but for ``skip``. The report has n_rows and, for clusters, their number, cost and silhouette; for outliers,
    their number and share; for projections, the share of variance or the singular value of each axis.
    """
    p = params or {}
    names = list(columns or [c for c in S.numeric_columns(df) if c not in set(skip)])
    if not names:
        raise S.ColumnError("no number columns")
    means, deviations = _scaler(df, names)
    model = Unlabelled(algo_id, names, means, deviations)
    kept = [c for c in df.columns if c.lower() not in ("features", "cluster", ID)]
    numbered = df.select(*[col(c) for c in kept]).withColumn(ID, F.monotonically_increasing_id())
    rows = model.prepared(stored(numbered, "unlabelled-rows"))
    n = rows.count()
    if not n:
        raise S.ColumnError("no complete rows")
    report: dict[str, float] = {"n_rows": float(n)}
    k = p.get("n_clusters", p.get("n_components", 4 if algo_id in CLUSTERING else 2))
    if algo_id in CLUSTERING:
        if algo_id == "kmeans":
            out = groups.kmeans(rows, k, p.get("n_init", 10), p.get("max_iter", 20))
            centres = {r["cluster"]: r["m"] for r in _middles(out)}
            model.rule = {"centres": [centres[c] for c in sorted(centres)]}
        elif algo_id == "minibatch_kmeans":
            centres = groups.minibatch_centres(rows, k, p.get("max_iter", 100), p.get("batch_size", groups.BATCH_ROWS))
            model.rule = {"centres": centres.tolist()}
            out = rows.withColumn("cluster", groups.closest(centres))
        elif algo_id == "gmm":
            model.mixture = GaussianMixture(k=k, seed=S.SEED, maxIter=p.get("max_iter", 50)).fit(rows.select("features"))
            out = model.mixture.transform(rows).withColumnRenamed("prediction", "cluster").drop("probability")
        else:
            if algo_id == "dbscan":
                found = groups.dbscan(rows, ID, p.get("eps", 0.5), p.get("min_samples", 5))
            else:
                found = groups.spectral(rows, ID, k, p.get("n_neighbors", 10))
            out = rows.join(found.withColumnRenamed("id", "__id"), F.col(ID) == F.col("__id"), "left").drop("__id")
            out = out.withColumn("cluster", F.coalesce("cluster", F.lit(-1)))
        out = stored(out, "unlabelled-answers")
        report |= groups.cluster_quality(out)
        report["noise"] = float(out.filter("cluster < 0").count())
    elif algo_id in OUTLIERS:
        if algo_id == "isolation_forest":
            out = groups.isolation_forest(rows, ID, p.get("n_estimators", 100))
        elif algo_id == "local_outlier_factor":
            found = groups.local_outlier_factor(rows, ID, p.get("n_neighbors", 20)).withColumnRenamed("id", "__id")
            out = rows.join(found, F.col(ID) == F.col("__id")).drop("__id")
        else:
            share = p.get("contamination", 0.05)
            mu, inverse = groups.robust_moments(rows)
            cut = column_quantiles(rows.select(quadratic(as_array("features"), mu, inverse).alias("d")), ["d"], [1 - share])["d"][0]
            model.rule = {"centre": mu.tolist(), "inverse": inverse.tolist(), "cut": cut}
            distance = quadratic(as_array("features"), mu, inverse)
            out = rows.withColumn("mahalanobis", distance).withColumn("is_anomaly", F.col("mahalanobis") > F.lit(cut))
        out = stored(out, "unlabelled-answers")
        found = out.filter("is_anomaly").count()
        report |= {"anomalies": float(found), "anomaly_share": found / n}
    elif algo_id in PROJECTIONS:
        m = gram(rows, as_array("features"))
        if algo_id == "pca":
            _, mu, square = mean_cov(m)
        else:
            mu, square = np.zeros(len(m) - 1), m[:-1, :-1]
        values, vectors = np.linalg.eigh(square)
        order = np.argsort(values)[::-1][:k]
        model.rule = {"basis": groups._signed(vectors[:, order]).tolist(), "centre": mu.tolist()}
        name = "explained" if algo_id == "pca" else "singular_value"
        for j, i in enumerate(order):
            report[f"{name}_{j + 1}"] = float(values[i] / max(values.sum(), 1e-300)) if algo_id == "pca" else float(np.sqrt(max(values[i], 0.0)))
        out = model.apply(rows.drop("features"))
    else:
        raise ValueError(f"no unlabelled algorithm {algo_id!r}")
    return model, out.drop(ID, "features"), {k: round(v, 4) for k, v in report.items()}


def _middles(rows: DataFrame) -> list:
    """The mean vector of each cluster."""
    width = len(rows.select("features").first()["features"])
    each = rows.select("cluster", as_array("features").alias("x"))
    means = F.array(*[F.avg(F.get("x", F.lit(i))) for i in range(width)])
    return each.groupBy("cluster").agg(means.alias("m")).collect()
