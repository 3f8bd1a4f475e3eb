"""Estimators by closed forms and known structure; stored models; neighbours."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from gridmill.functions import semantics as S
from gridmill.ml import forecast, groups, metrics, models, neighbours, prep, train, unlabelled
from gridmill.ml.moments import as_array, dot, grouped_gram, mean_cov, quadratic


@pytest.fixture(scope="module")
def blobs(spark):
    """Three Gaussian classes in four dimensions."""
    rng = np.random.RandomState(3)
    y = rng.randint(0, 3, 600)
    x = rng.normal(size=(600, 4)) + np.array([[0, 0, 0, 0], [3, 0, 1, 0], [0, 3, 0, 1]])[y]
    pdf = pd.DataFrame(x, columns=list("abcd")).assign(label=y.astype(float), id=np.arange(600))
    df = spark.createDataFrame(pdf).withColumn("features", array_to_vector(F.array("a", "b", "c", "d")))
    return x, y, df


def _accuracy(model, df):
    return model.transform(df).agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0]


def test_moments(blobs):
    x, y, df = blobs
    found = grouped_gram(df, as_array("features"), F.col("label"))
    for c in range(3):
        n, mu, cov = mean_cov(found[float(c)], ddof=1)
        assert n == (y == c).sum()
        assert np.allclose(mu, x[y == c].mean(axis=0)) and np.allclose(cov, np.cov(x[y == c].T))


def test_dot_and_quadratic(blobs):
    x, _, df = blobs
    m = np.diag([1.0, 2.0, 3.0, 4.0])
    got = df.select("id", dot(as_array("features"), [1, 2, 3, 4]).alias("d"), quadratic(as_array("features"), np.ones(4), m).alias("q")).toPandas()
    got = got.sort_values("id")
    assert np.allclose(got["d"], x @ [1, 2, 3, 4]) and np.allclose(got["q"], ((x - 1) ** 2 @ [1, 2, 3, 4]))


def test_discriminants_match_their_formulas(blobs):
    x, y, df = blobs
    mu = np.stack([x[y == c].mean(axis=0) for c in range(3)])
    cov = sum((y == c).sum() * np.cov(x[y == c].T, ddof=0) for c in range(3)) / len(y)
    inv, prior = np.linalg.inv(cov), np.array([(y == c).mean() for c in range(3)])
    score = x @ inv @ mu.T - 0.5 * np.einsum("ij,jk,ik->i", mu, inv, mu) + np.log(prior)
    got = models.fit_lda(df).transform(df).orderBy("id").select("prediction", "probability").toPandas()
    assert (got["prediction"].to_numpy() == score.argmax(axis=1)).all()
    p = np.exp(score - score.max(axis=1, keepdims=True))
    assert np.allclose(np.stack(got["probability"]), p / p.sum(axis=1, keepdims=True))
    assert _accuracy(models.fit_qda(df), df) > 0.9


def test_ridge_classifier_matches_the_normal_equations(blobs):
    x, y, df = blobs
    t = np.where(np.arange(3)[None, :] == y[:, None], 1.0, -1.0)
    xc = x - x.mean(axis=0)
    w = np.linalg.solve(xc.T @ xc + np.eye(4), xc.T @ (t - t.mean(axis=0)))
    want = (xc @ w + t.mean(axis=0)).argmax(axis=1)
    got = models.fit_ridge_classifier(df).transform(df).orderBy("id").toPandas()["prediction"]
    assert (got.to_numpy() == want).all()


def test_multinomial_bayes(blobs):
    _, _, df = blobs
    assert _accuracy(models.fit_multinomial_nb(df), df) > 0.6


@pytest.fixture(scope="module")
def line(spark):
    rng = np.random.RandomState(5)
    x = rng.normal(size=(400, 3))
    y = x @ [2.0, -1.0, 0.5] + 3 + rng.normal(scale=0.1, size=400)
    pdf = pd.DataFrame(x, columns=list("abc")).assign(label=y, id=np.arange(400))
    return x, y, spark.createDataFrame(pdf).withColumn("features", array_to_vector(F.array("a", "b", "c")))


def test_bayesian_ridge_is_close_to_least_squares(line):
    x, y, df = line
    beta = np.linalg.lstsq(np.hstack([x, np.ones((len(x), 1))]), y, rcond=None)[0]
    m = models.fit_bayesian_ridge(df).state
    assert np.allclose([*m["coef"], m["intercept"]], beta, atol=1e-2)


def test_linear_svr_resists_outliers(line):
    x, y, df = line
    spoiled = df.withColumn("label", F.when(F.col("id") % 10 == 0, F.col("label") + 50).otherwise(F.col("label")))
    m = models.fit_linear_svr(spoiled).state
    assert np.allclose(m["coef"], [2.0, -1.0, 0.5], atol=0.1) and abs(m["intercept"] - 3) < 0.1


# --- neighbours -------------------------------------------------------------

@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.RandomState(9)
    v = np.vstack([rng.normal(size=(300, 2)) * 0.3, rng.normal(size=(200, 2)) * 0.3 + 4, rng.uniform(-2, 6, (60, 2)), np.zeros((40, 2))])
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(len(v)), "v": list(v)}), "id bigint, v array<double>")
    return v, df


@pytest.mark.parametrize("path", ["broadcast", "cells"])
def test_nearest_is_exact(cloud, monkeypatch, path):
    v, df = cloud
    if path == "cells":
        monkeypatch.setattr(neighbours, "SMALL_CORPUS_VALUES", 0)
        monkeypatch.setattr(neighbours, "BLOCK_ROWS", 40)
        monkeypatch.setattr(neighbours, "FAN", 5)
    got = neighbours.nearest(df, df, 4, exclude_self=True).orderBy("id", "place").toPandas()
    d = neighbours.distances(v, v)
    np.fill_diagonal(d, np.inf)
    ids = np.broadcast_to(np.arange(len(v)), d.shape)
    want = np.lexsort((ids, d), axis=1)[:, :4]
    assert (got["neighbour"].to_numpy().reshape(-1, 4) == want).all()


def _brute_dbscan(v, eps, m):
    near = neighbours.distances(v, v) <= eps
    core = near.sum(axis=1) >= m
    label = np.where(core, np.arange(len(v)), -1)
    while True:
        new = label.copy()
        for i in np.flatnonzero(core):
            new[i] = label[near[i] & core].min()
        if (new == label).all():
            break
        label = new
    for i in np.flatnonzero(~core):
        hit = np.flatnonzero(near[i] & core)
        if len(hit):
            label[i] = label[hit.min()]
    return label


def test_dbscan_matches_brute_force(cloud, monkeypatch):
    v, df = cloud
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 50)
    monkeypatch.setattr(neighbours, "FAN", 4)
    got = neighbours.dbscan(df, 0.35, 6).orderBy("id").toPandas()
    assert (got["cluster"].to_numpy() == _brute_dbscan(v, 0.35, 6)).all()


def _density(spark, v, eps, m):
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(len(v)), "v": list(v)}), "id bigint, v array<double>")
    return neighbours.dbscan(df, eps, m).orderBy("id").toPandas()


def test_dbscan_on_a_grid(spark):
    rng = np.random.RandomState(9)
    apart = rng.uniform(0, 1, (250, 2)) * [0.5, 3]
    v = np.vstack([apart, rng.uniform(0, 1, (250, 2)) * [0.5, 3] + [0.69, 0], np.round(rng.uniform(5, 8, (150, 2)), 1)])
    got = _density(spark, v, 0.2, 4)
    assert (got["cluster"].to_numpy() == _brute_dbscan(v, 0.2, 4)).all()
    assert (got["is_core"].to_numpy() == ((neighbours.distances(v, v) <= 0.2).sum(axis=1) >= 4)).all()


@pytest.mark.parametrize("widest", [3, 0])
def test_dbscan_in_space(spark, monkeypatch, widest):
    monkeypatch.setattr(neighbours, "GRID_WIDTH", widest)
    v = np.random.RandomState(5).uniform(0, 3, (400, 3))
    assert (_density(spark, v, 0.4, 5)["cluster"].to_numpy() == _brute_dbscan(v, 0.4, 5)).all()


def test_density_of_a_crowd_compares_no_pairs(spark, monkeypatch):
    """Cells with enough points need no distances: neither their points nor the links between them."""
    monkeypatch.setattr(neighbours, "distances", None)
    v = np.random.RandomState(5).uniform(0, 1, (5000, 2))
    got = _density(spark, v, 0.3, 5)
    assert (got["cluster"] == 0).all() and got["is_core"].all()


def test_search_holds_one_block_of_distances(monkeypatch):
    """The matrix of distances is a block of queries by a block of points, and only likely neighbours are measured exactly."""
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 100)
    rng = np.random.RandomState(8)
    v, seen = rng.normal(size=(1000, 4)), []
    real = neighbours._within

    def within(a, b, *more):
        found = real(a, b, *more)
        seen.append((len(a), len(b), len(found[0])))
        return found

    monkeypatch.setattr(neighbours, "_within", within)
    ids = np.arange(1000)
    row, near, dist = neighbours._Blocks(ids, v).search(v, ids, 5)
    assert max(a for a, _, _ in seen) <= 100 and max(b for _, b, _ in seen) <= 100 and sum(n for _, _, n in seen) < 100 * 1000
    d = neighbours.distances(v, v)
    np.fill_diagonal(d, np.inf)
    order = np.lexsort((near, dist, row))
    assert (near[order].reshape(-1, 5) == np.argsort(d, axis=1)[:, :5]).all()


@pytest.mark.parametrize("width", [2, 40])
def test_neighbours_across_groups(spark, monkeypatch, width):
    for name, value in (("SMALL_CORPUS_VALUES", 0), ("BLOCK_ROWS", 50), ("GROUP_VALUES", 150 * width), ("FAN", 6)):
        monkeypatch.setattr(neighbours, name, value)
    v = np.vstack([np.random.RandomState(1).normal(size=(500, width)), np.ones((260, width))])
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(760), "v": list(v)}), "id bigint, v array<double>").repartition(3)
    got = neighbours.nearest(df, df, 6, exclude_self=True).orderBy("id", "place").toPandas()
    d = neighbours.distances(v, v)
    np.fill_diagonal(d, np.inf)
    want = np.lexsort((np.broadcast_to(np.arange(760), d.shape), d), axis=1)[:, :6]
    assert (got["neighbour"].to_numpy().reshape(-1, 6) == want).all()


def test_rounds_of_components_carry_no_constraints(spark, monkeypatch):
    """A round reads a plain table; a checkpoint would hand on the constraints of every round before."""
    monkeypatch.setattr(neighbours, "pinned", None)
    got = neighbours.connected_components(spark.range(40), spark.range(39).selectExpr("id AS a", "id + 1 AS b"))
    assert {r["component"] for r in got.collect()} == {0}


def test_compared_pairs_grow_slower_than_the_square(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 50)
    rng = np.random.RandomState(4)
    seen = []
    for n in (500, 1000, 4000):
        middles = rng.uniform(0, 1000, (n // 50, 3))  # clusters of 50
        v = middles[rng.randint(0, len(middles), n)] + rng.normal(size=(n, 3))
        df = spark.createDataFrame(pd.DataFrame({"id": np.arange(n), "v": list(v)}), "id bigint, v array<double>")
        cells = neighbours.Cells(df, 6)
        seen.append(neighbours.compared(*cells.blocks(cells.visits(df))))
    assert seen[2] < 6 * seen[1] < 20 * seen[0]  # the square would be 16 times, and 4 times
    assert seen[2] < 4000**2 / 10


def test_equal_points_are_cut_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 30)
    monkeypatch.setattr(neighbours, "SMALL_CORPUS_VALUES", 0)
    df = spark.range(200).select("id", F.when(F.col("id") < 150, F.array(F.lit(1.0), F.lit(2.0))).otherwise(F.array(F.col("id") * 1.0, F.lit(0.0))).alias("v"))
    got = neighbours.nearest(df, df, 3, exclude_self=True).filter("id < 3").orderBy("id", "place").collect()
    assert [(r.id, r.neighbour, r.distance) for r in got] == [(0, 1, 0), (0, 2, 0), (0, 3, 0), (1, 0, 0), (1, 2, 0), (1, 3, 0), (2, 0, 0), (2, 1, 0), (2, 3, 0)]


def test_moments_of_many_columns(spark, monkeypatch):
    from gridmill.ml import moments

    x = np.random.RandomState(6).normal(size=(60, 300))
    df = spark.createDataFrame(pd.DataFrame({"v": list(x), "g": np.arange(60) % 2.0})).repartition(4)
    monkeypatch.setattr(moments, "BLOCK_VALUES", 1000)
    for g, m in grouped_gram(df, F.col("v"), F.col("g")).items():
        z = np.hstack([x[int(g) :: 2], np.ones((30, 1))])
        assert np.allclose(m, z.T @ z)


def test_components_of_a_long_chain(spark):
    nodes = spark.range(60)
    edges = spark.range(59).filter("id <> 30").selectExpr("id AS a", "id + 1 AS b")
    got = {r["component"] for r in neighbours.connected_components(nodes, edges).collect()}
    assert got == {0, 31}


def test_outliers_are_found(spark):
    rng = np.random.RandomState(2)
    v = np.vstack([rng.normal(size=(400, 2)), [[9, 9], [-8, 9]]])
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(402), "x": v[:, 0], "y": v[:, 1]}))
    rows = groups.vectors(df, ["x", "y"], scale=False)
    forest = groups.isolation_forest(rows, "id", 40).orderBy(F.desc("anomaly_score")).limit(2).toPandas()
    assert set(forest["id"]) == {400, 401}
    ellipse = groups.elliptic_envelope(rows, 0.01).filter("is_anomaly").toPandas()
    assert {400, 401} <= set(ellipse["id"])
    lof = groups.local_outlier_factor(rows, "id", 10).filter("is_anomaly").toPandas()
    assert {400, 401} <= set(lof["id"])


def test_projections(blobs):
    x, _, df = blobs
    out, share = groups.pca(df, 2)
    _, s, vt = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    got = out.orderBy("id").select("axis_1", "axis_2").toPandas().to_numpy()
    assert np.allclose(np.abs(got), np.abs((x - x.mean(axis=0)) @ vt[:2].T), atol=1e-6)
    assert share[0] == pytest.approx(s[0] ** 2 / (s**2).sum())
    _, sigma = groups.truncated_svd(df, 2)
    assert sigma == pytest.approx(np.linalg.svd(x, compute_uv=False)[:2])


def test_clusters_recover_blobs(blobs):
    _, _, df = blobs
    out = groups.kmeans(df, 3, restarts=3)
    cells = out.groupBy("label", "cluster").count().toPandas()
    assert cells.sort_values("count").groupby("label")["count"].last().sum() > 540


def test_minibatch_kmeans(spark, blobs, monkeypatch):
    x, _, df = blobs
    out = groups.minibatch_kmeans(df, 3, steps=40, batch=120)
    cells = out.groupBy("label", "cluster").count().toPandas()
    assert cells.sort_values("count").groupby("label")["count"].last().sum() > 520
    # the cost from sums by cluster is that of the stored labels
    held = out.select("id", "cluster", "features").toPandas()
    want = sum(((x[held.loc[held.cluster == c, "id"]] - x[held.loc[held.cluster == c, "id"]].mean(axis=0)) ** 2).sum() for c in held.cluster.unique())
    found = groups.cluster_quality(out)
    assert found["cost"] == pytest.approx(want) and found["silhouette"] > 0.2
    best = groups.cluster_quality(groups.kmeans(df, 3, restarts=3))
    assert found["cost"] < 1.15 * best["cost"]


def test_runs_without_a_target(spark, tmp_path):
    rng = np.random.RandomState(3)
    v = np.vstack([rng.normal(size=(120, 2)), rng.normal(size=(120, 2)) + 6, [[40.0, -40.0], [np.nan, 1.0]]])
    df = spark.createDataFrame(pd.DataFrame({"key": [f"k{i}" for i in range(len(v))], "x": v[:, 0], "y": v[:, 1]}))
    for algo in unlabelled.ALGORITHMS:
        r = train.train(df, None, algo, {"n_clusters": 2} if algo in ("kmeans", "minibatch_kmeans", "spectral") else {"n_components": 2}, "key")
        assert r.n_train == 241 and r.metrics and r.rows.count() == 241 and r.path, algo
        if algo in ("kmeans", "minibatch_kmeans", "gmm", "pca", "truncated_svd", "elliptic_envelope"):
            again = train.predict(df, r.path)
            name = next(c for c in ("cluster", "axis_1", "is_anomaly") if c in again.columns)
            both = again.select("key", F.col(name).alias("a")).join(r.rows.select("key", F.col(name).alias("b")), "key")
            assert both.count() == 241 and both.filter("a <> b").count() <= 1, algo
    tried, best = train.tune(df, None, "kmeans", grid={"n_clusters": [2, 5]}, key="key", save=False)
    assert best.params == {"n_clusters": 2} and tried.count() == 2
    board, runs = train.automl(df, None, ["kmeans", "gmm"], key="key", save=False)
    assert board.filter("error IS NULL").count() == 2
    with pytest.raises(train.TrainingError):
        train.train(df, None, "ridge")


def test_series_runs_and_gaps(spark, tmp_path):
    months = pd.date_range("2020-01-01", periods=40, freq="MS")
    rows = [("up", m.date(), 100.0 + 2 * i) for i, m in enumerate(months) if i not in (20, 38)]
    rows += [("season", m.date(), float([5, 9, 1, 7, 3, 8, 2, 6, 4, 11, 12, 10][m.month - 1])) for i, m in enumerate(months) if i not in (3, 30, 31)]
    s = spark.createDataFrame(rows, "series string, ds date, y double")
    assert forecast.spine(s).filter("y IS NULL").count() == 5
    line = lambda f: [r["forecast"] for r in f.filter("series = 'up'").orderBy("ds").collect()]
    assert line(forecast.arima(s, 3)) == pytest.approx([180, 182, 184]) and line(forecast.holt_winters(s, 3)) == pytest.approx([180, 182, 184], abs=1e-6)
    wave = {(r.ds.month): r.forecast for r in forecast.seasonal_naive(s, 12).filter("series = 'season'").collect()}
    assert wave == {m: float([5, 9, 1, 7, 3, 8, 2, 6, 4, 11, 12, 10][m - 1]) for m in range(1, 13)}
    named = s.withColumnRenamed("series", "name")
    for algo in forecast.ALGORITHMS:
        r = train.train(named, "y", algo, {"level": "monthly"}, date="ds", by=["name"])
        assert r.metrics["mae"] >= 0 and r.n_test > 0 and r.rows.columns == ["series", "ds", "y", "forecast"]
        assert forecast.Forecaster.load(spark, r.path).predict(2).count() == 4


def test_importances_of_all_columns(spark):
    rng = np.random.RandomState(8)
    x = rng.normal(size=(300, 25))
    pdf = pd.DataFrame(x, columns=[f"c{i}" for i in range(25)]).assign(id=np.arange(300), y=3 * x[:, 0] - x[:, 7])
    df = spark.createDataFrame(pdf)
    r = train.train(df, "y", "ridge", None, "id", folds=0, save=False)
    names = [f for f, _ in r.importance]
    assert len(names) == 25 and names[:2] == ["c0", "c7"] and all(v < 0.01 for _, v in r.importance[2:])


# --- training ---------------------------------------------------------------

@pytest.fixture(scope="module")
def sales(spark):
    rng = np.random.RandomState(11)
    n = 300
    region = rng.choice(["north", "south", None], n)
    units = rng.randint(1, 20, n).astype(float)
    units[::17] = np.nan
    price = np.where(region == "north", 10.0, 6.0)
    pdf = pd.DataFrame({"order_id": np.arange(n), "region": region, "units": units, "noise": rng.rand(n),
                        "sku": [f"sku{i % 70:03d}" for i in range(n)]})
    pdf["total"] = np.nan_to_num(units, nan=9) * price
    pdf["big"] = np.where(pdf["total"] > 80, "yes", "no")
    return S.fold_missing(spark.createDataFrame(pdf))


def test_preprocessor_shapes(sales):
    p = prep.build_preprocessor(sales.filter("sku < 'sku060'"), "total", ["region", "units", "sku"])
    assert p.feature_names == ["units", "region=north", "region=south", "sku"]
    out = p.transform(sales).select("sku", as_array("features").alias("x")).toPandas()
    x = np.stack(out["x"])
    assert np.isfinite(x).all()
    assert (x[out["sku"] >= "sku060", 3] == -1).all()
    fresh = sales.limit(1).withColumn("region", F.lit("west")).drop("units")
    row = p.transform(fresh).select(as_array("features").alias("x")).first()["x"]
    assert row[1] == row[2] == 0.0


def test_train_store_and_predict(sales, spark):
    r = train.train(sales.drop("total"), "big", "random_forest_clf", {"n_estimators": 10, "max_depth": 5}, "order_id", folds=2, repeats=1)
    assert r.metrics["accuracy"] > 0.8 and 0 < r.cv["mean"] <= 1 and r.n_train + r.n_test == 300
    assert dict(r.importance)["units"] > dict(r.importance)["noise"]
    again = train.predict(sales, r.path).orderBy("order_id").select("prediction", "confidence", "probability").toPandas()
    live = r.fitted.score(sales.drop("total", "big")).orderBy("order_id").toPandas()
    assert (again["prediction"] == live["prediction"].map({0.0: "no", 1.0: "yes"})).all()
    assert again["confidence"].between(50, 100).all() and set(again["probability"][0]) == {"no", "yes"}


@pytest.mark.parametrize("algo,params", [("ridge", None), ("knn_reg", None), ("adaboost_reg", {"n_estimators": 3}), ("svr_linear", None)])
def test_regressors_survive_storage(sales, algo, params):
    r = train.train(sales.drop("big"), "total", algo, params, "order_id", folds=0, repeats=0)
    a = r.fitted.score(sales).orderBy("order_id").toPandas()["prediction"]
    b = train.predict(sales, r.path).orderBy("order_id").toPandas()["prediction"]
    assert np.allclose(a, b) and r.metrics["r2"] > 0.3


def test_failures_become_leaderboard_rows(sales):
    board, _ = train.automl(sales.drop("big"), "total", ["ridge", "svr_rbf", "linear_regression"], key="order_id", folds=0, repeats=0, save=False)
    got = board.orderBy("rank").toPandas()
    assert got["algo_id"].iloc[-1] == "svr_rbf" and got["error"].notna().sum() == 1
    assert got["score"].iloc[0] >= got["score"].iloc[1] > 0.5


def test_checks_stop_training(sales):
    with pytest.raises(train.TrainingError, match="1 class"):
        train.train(sales.withColumn("k", F.lit(1.5)), "k", "ridge", key="order_id")
    few = sales.limit(20).withColumn("k", F.lit(1.5))
    assert prep.constant_check(few, "k").first()["code"] == "constant_target"
    with pytest.raises(train.TrainingError, match="not found"):
        train.train(sales, "nothing", "ridge")


def test_auc_counts_ties_half(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.9), (1, 0.5), (0, 0.1)], "y int, s double")
    assert metrics.roc_auc(df, "y", "s").first()["roc_auc"] == 0.625


def test_forecasts(spark):
    months = pd.date_range("2020-01-01", periods=48, freq="MS")
    t = np.arange(48)
    pdf = pd.concat(
        [pd.DataFrame({"series": "up", "ds": months.date, "y": 100 + 2.0 * t}),
         pd.DataFrame({"series": "season", "ds": months.date, "y": 50 + 10 * np.sin(2 * np.pi * t / 12)})]
    )
    s = spark.createDataFrame(pdf, "series string, ds date, y double")
    up = lambda f: [r["forecast"] for r in f.filter("series = 'up'").orderBy("ds").collect()]
    wave = lambda f: [r["forecast"] for r in f.filter("series = 'season'").orderBy("ds").collect()]
    assert up(forecast.naive_last(s, 2)) == [194.0, 194.0]
    assert up(forecast.arima(s, 3)) == pytest.approx([196, 198, 200])
    assert up(forecast.holt_winters(s, 3)) == pytest.approx([196, 198, 200], abs=1e-6)
    want = 50 + 10 * np.sin(2 * np.pi * np.arange(48, 60) / 12)
    assert wave(forecast.seasonal_naive(s, 12)) == pytest.approx(want)
    assert wave(forecast.holt_winters(s, 12, 12)) == pytest.approx(want, abs=0.5)
