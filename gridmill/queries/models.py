"""Queries on training checks, evaluation, estimators and forecasts."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridmill.functions import semantics as S
from gridmill.functions.joins import small_side
from gridmill.ml import estimators, forecast, groups, metrics, neighbours, prep, train
from gridmill.ml.moments import as_array
from gridmill.plans import catalog, shortlist
from gridmill.queries import register
from gridmill.queries import tables as t
from gridmill.queries.tables import load
from gridmill.session import pinned

# --- checks -----------------------------------------------------------------


def _gappy_orders(spark, sf):
    """Orders with half the prices missing and a column that copies the price."""
    return load(spark, sf, "orders").selectExpr(
        "o_orderkey", "o_orderstatus", "o_orderpriority", "CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice END AS price",
        "o_totalprice * 2 + 1 AS copied", "o_custkey", "5.0D AS k",
    )


@register(
    "m01_target_checks",
    "SELECT 'warning' AS level, 'some_missing' AS code, 'Target has ' || round((1 - count(*) FILTER (WHERE o_orderkey % 2 = 0) / count(*)) * 100, 1) "
    "|| '% missing values' AS message FROM orders",
)
def _(spark, sf):
    return prep.target_checks(_gappy_orders(spark, sf), "price")


@register(
    "m02_class_checks",
    "SELECT 'warning' AS level, 'many_classes' AS code, 'Target has ' || count(DISTINCT l_suppkey * 100 + l_linenumber) || ' classes' AS message "
    "FROM lineitem HAVING count(DISTINCT l_suppkey * 100 + l_linenumber) > 100",
)
def _(spark, sf):
    li = load(spark, sf, "lineitem").withColumn("cls", F.col("l_suppkey") * 100 + F.col("l_linenumber"))
    return prep.class_checks(li, "cls").filter("code = 'many_classes'")


@register(
    "m03_constant_check",
    "SELECT 'error' AS level, 'constant_target' AS code, 'Target has zero variance' AS message FROM (SELECT min(5.0) AS a, max(5.0) AS b FROM orders) WHERE a = b",
)
def _(spark, sf):
    return prep.constant_check(_gappy_orders(spark, sf), "k")


@register(
    "m04_leakage",
    "SELECT 'warning' AS level, 'leakage' AS code, 'Column ''copied'' has ' || printf('%.3f', abs(corr(o_totalprice * 2 + 1, o_totalprice))) || "
    "' correlation with the target' AS message FROM orders WHERE o_orderkey % 2 = 0",
)
def _(spark, sf):
    return prep.leakage_checks(_gappy_orders(spark, sf), "price")


@register(
    "m05_id_like",
    """
    SELECT 'warning' AS level, 'id_like' AS code, 'Column ''' || c || ''' looks like an ID' AS message FROM (
      SELECT 'o_orderkey' AS c, count(DISTINCT o_orderkey) AS u, count(*) AS n FROM orders UNION ALL
      SELECT 'copied', count(DISTINCT o_totalprice * 2 + 1), count(*) FROM orders UNION ALL
      SELECT 'o_custkey', count(DISTINCT o_custkey), count(*) FROM orders) WHERE u = n AND n > 50
    """,
)
def _(spark, sf):
    return prep.id_checks(_gappy_orders(spark, sf), "price")


@register("m01_m05_validate_training")
def _(spark, sf):
    return prep.validate_training(_gappy_orders(spark, sf), "price", "ridge")


# --- preprocessing and splits -----------------------------------------------

@register(
    "m06_preprocessor",
    """
    WITH s AS (SELECT avg(coalesce(p_size, m)) AS mu, stddev_pop(coalesce(p_size, m)) AS sd, any_value(m) AS m FROM part, (SELECT quantile_cont(p_size, 0.5) AS m FROM part))
    SELECT p_partkey, round((coalesce(p_size, m) - mu) / sd, 4) AS size_z, (p_type = 'ECONOMY')::INTEGER::DOUBLE AS economy,
           (dense_rank() OVER (ORDER BY p_name) - 1)::DOUBLE AS name_code FROM part, s
    """,
)
def _(spark, sf):
    part = load(spark, sf, "part")
    p = prep.build_preprocessor(part, "p_retailprice", ["p_size", "p_type", "p_name"])
    x = vector_to_array("features")
    names = p.feature_names
    return p.transform(part).select(
        "p_partkey", F.round(x[0], 4).alias("size_z"), x[names.index("p_type=ECONOMY")].alias("economy"), x[len(names) - 1].alias("name_code")
    )


@register(
    "m07_legacy_matrix",
    f"""
    WITH v AS ({t.LINEITEM_NULLS})
    SELECT dense_rank() OVER (ORDER BY coalesce(l_returnflag, 'nan')) - 1 AS l_returnflag, dense_rank() OVER (ORDER BY l_linestatus) - 1 AS l_linestatus,
           coalesce(l_quantity, (SELECT quantile_cont(l_quantity, 0.5) FROM v)) AS l_quantity, l_partkey::DOUBLE AS l_partkey FROM v
    """,
)
def _(spark, sf):
    out = prep.legacy_matrix(t.lineitem_nulls(spark, sf), "l_linestatus", True)
    return out.select("l_returnflag", "l_linestatus", "l_quantity", "l_partkey")


_BUCKET = "('0x' || substr(md5('42|' || {k}::VARCHAR), 1, 8))::BIGINT % 10000"


@register("m08_split", f"SELECT o_orderkey, {_BUCKET.format(k='o_orderkey')} < 2000 AS is_test FROM orders")
def _(spark, sf):
    return prep.split(load(spark, sf, "orders"), 0.2, "o_orderkey").select("o_orderkey", "is_test")


@register(
    "m09_stratified_split",
    "SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5('42|' || o_orderkey::VARCHAR), o_orderkey) "
    "<= round(count(*) OVER (PARTITION BY o_orderstatus) * 0.2) AS is_test FROM orders",
)
def _(spark, sf):
    return prep.stratified_split(load(spark, sf, "orders"), "o_orderstatus", 0.2, "o_orderkey").select("o_orderkey", "o_orderstatus", "is_test")


@register(
    "m10_kfold",
    f"SELECT o_orderkey, ({_BUCKET.format(k='o_orderkey')} % 5)::INTEGER AS fold, ((row_number() OVER (PARTITION BY o_orderstatus "
    "ORDER BY md5('42|' || o_orderkey::VARCHAR), o_orderkey) - 1) % 5)::INTEGER AS class_fold FROM orders",
)
def _(spark, sf):
    o = prep.kfold(load(spark, sf, "orders"), 5, "o_orderkey")
    strat = prep.kfold(o.withColumnRenamed("fold", "plain"), 5, "o_orderkey", label="o_orderstatus")
    return strat.select("o_orderkey", F.col("plain").alias("fold"), F.col("fold").alias("class_fold"))


_UNEVEN = "CASE WHEN o_orderkey % 20 = 0 THEN 'rare' ELSE 'common' END"


@register(
    "m12_class_weights",
    f"WITH c AS (SELECT {_UNEVEN} AS label, count(*) AS n FROM orders GROUP BY 1) SELECT label, n, "
    "CASE WHEN max(n) OVER () / min(n) OVER () > 5 THEN round(sum(n) OVER () / (count(*) OVER () * n), 6) ELSE 1.0 END::DOUBLE AS weight FROM c",
)
def _(spark, sf):
    o = load(spark, sf, "orders").select(F.expr(_UNEVEN).alias("cls"))
    return prep.class_weights(o, "cls").withColumn("weight", F.round("weight", 6))


@register("m13_class_distribution", "SELECT o_orderpriority AS label, count(*) AS n FROM orders GROUP BY 1")
def _(spark, sf):
    return prep.class_distribution(load(spark, sf, "orders"), "o_orderpriority")


# --- metrics ----------------------------------------------------------------

def baseline(spark, sf) -> DataFrame:
    """Price predicted by the mean price of its quantity."""
    li = t.lineitem(spark, sf).select(F.col("l_quantity"), F.col("l_extendedprice").alias("y"))
    means = li.groupBy(F.col("l_quantity").alias("q")).agg(S.mean(F.col("y")).alias("yhat"))
    return li.join(small_side(means), F.col("l_quantity") == F.col("q")).select(F.col("y").cast("double").alias("y"), "yhat")


_BASE = (
    f"SELECT l_extendedprice::DOUBLE AS y, sum(l_extendedprice) OVER (PARTITION BY l_quantity)::DOUBLE / count(*) OVER (PARTITION BY l_quantity) AS yhat FROM ({t.LINEITEM})"
)


@register(
    "m14_regression_metrics",
    f"""
    WITH m AS (SELECT sqrt(avg((y - yhat) ** 2)) AS rmse, avg(abs(y - yhat)) AS mae, 1 - avg((y - yhat) ** 2) / var_pop(y) AS r2,
                      avg(abs(y - yhat) / abs(y)) * 100 AS mape FROM ({_BASE}))
    SELECT metric, value FROM m, LATERAL (VALUES ('rmse', round(rmse, 4)), ('mae', round(mae, 4)), ('r2', round(r2, 4)), ('mape', round(mape, 2))) v(metric, value)
    """,
)
def _(spark, sf):
    return metrics.regression_metrics(baseline(spark, sf), "y", "yhat")


_CLASS = """
    WITH p AS (SELECT quality AS y, toxic AS h FROM labels),
    c AS (SELECT label, (SELECT count(*) FROM p WHERE y = label) AS a, (SELECT count(*) FROM p WHERE h = label) AS b,
                 (SELECT count(*) FROM p WHERE y = label AND h = label) AS t FROM (SELECT y AS label FROM p UNION SELECT h FROM p)),
    s AS (SELECT *, CASE WHEN b = 0 THEN 0 ELSE t / b END AS pr, CASE WHEN a = 0 THEN 0 ELSE t / a END AS re, 2 * t / (a + b) AS f FROM c)
"""


@register(
    "m15_classification_metrics",
    _CLASS
    + """
    SELECT metric, round(value, 4) AS value FROM (SELECT sum(t) / sum(a) AS acc, avg(re) FILTER (WHERE a > 0) AS bal, arg_max(pr, label) AS p1, arg_max(re, label) AS r1,
      arg_max(f, label) AS f1, avg(f) AS fm, count(*) FILTER (WHERE a > 0)::DOUBLE AS k FROM s),
      LATERAL (VALUES ('accuracy', acc), ('balanced_accuracy', bal), ('precision', p1), ('recall', r1), ('f1', f1), ('f1_macro', fm), ('n_classes', k)) v(metric, value)
    """,
)
def _(spark, sf):
    return metrics.classification_metrics(load(spark, sf, "labels"), "quality", "toxic")


@register(
    "m15_classification_metrics_multiclass",
    """
    WITH p AS (SELECT l_linenumber AS y, l_linenumber % 3 + 1 AS h FROM lineitem),
    c AS (SELECT label, (SELECT count(*) FROM p WHERE y = label) AS a, (SELECT count(*) FROM p WHERE h = label) AS b,
                 (SELECT count(*) FROM p WHERE y = label AND h = label) AS t FROM (SELECT y AS label FROM p UNION SELECT h FROM p)),
    s AS (SELECT *, CASE WHEN b = 0 THEN 0 ELSE t / b END AS pr, CASE WHEN a = 0 THEN 0 ELSE t / a END AS re, 2 * t / (a + b) AS f FROM c)
    SELECT metric, round(value, 4) AS value FROM (SELECT sum(t) / sum(a) AS acc, avg(re) FILTER (WHERE a > 0) AS bal, sum(pr * a) / sum(a) AS p1, sum(re * a) / sum(a) AS r1,
      sum(f * a) / sum(a) AS f1, avg(f) AS fm, count(*) FILTER (WHERE a > 0)::DOUBLE AS k FROM s),
      LATERAL (VALUES ('accuracy', acc), ('balanced_accuracy', bal), ('precision', p1), ('recall', r1), ('f1', f1), ('f1_macro', fm), ('n_classes', k)) v(metric, value)
    """,
)
def _(spark, sf):
    li = load(spark, sf, "lineitem").select("l_linenumber", (F.col("l_linenumber") % 3 + 1).alias("guess"))
    return metrics.classification_metrics(li, "l_linenumber", "guess")


@register(
    "m16_confusion",
    "SELECT quality::VARCHAR AS actual, toxic::VARCHAR AS predicted, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY quality) * 100, 2) AS row_pct "
    "FROM labels GROUP BY quality, toxic",
)
def _(spark, sf):
    return metrics.confusion(load(spark, sf, "labels"), "quality", "toxic")


@register(
    "m17_roc_auc",
    """
    WITH g AS (SELECT n_chars AS s, count(*) FILTER (WHERE quality > 0) AS p, count(*) FILTER (WHERE quality <= 0) AS n FROM labels JOIN documents USING (doc_id) GROUP BY 1),
    c AS (SELECT *, sum(n) OVER (ORDER BY s) - n / 2 AS below FROM g)
    SELECT sum(p)::BIGINT AS n_positive, sum(n)::BIGINT AS n_negative, round(sum(p * below) / (sum(p) * sum(n)), 4) AS roc_auc FROM c
    """,
)
def _(spark, sf):
    rows = load(spark, sf, "labels").join(load(spark, sf, "documents"), "doc_id")
    return metrics.roc_auc(rows, "quality", "n_chars")


@register(
    "m19_univariate_regression",
    f"WITH v AS ({t.LINEITEM}) "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, round(corr({c}::DOUBLE, l_extendedprice::DOUBLE) ** 2 / (1 - corr({c}::DOUBLE, l_extendedprice::DOUBLE) ** 2) * (count(*) - 2), 4) AS score FROM v"
        for c in t.LINEITEM_NUMBERS
        if c != "l_extendedprice"
    ),
)
def _(spark, sf):
    return metrics.univariate_scores(t.lineitem(spark, sf), "l_extendedprice", False)


@register(
    "m19_univariate_classification",
    " UNION ALL ".join(
        f"SELECT '{c}' AS feature, round((sum(n * m * m) - sum(n) * (sum(n * m) / sum(n)) ** 2) / (count(*) - 1) / (sum(n * v) / (sum(n) - count(*))), 4) AS score "
        f"FROM (SELECT count({c}) AS n, avg({c}) AS m, var_pop({c}) AS v FROM orders GROUP BY o_orderstatus)"
        for c in ("o_orderkey", "o_custkey", "o_totalprice")
    ),
)
def _(spark, sf):
    return metrics.univariate_scores(load(spark, sf, "orders"), "o_orderstatus", True)


@register(
    "m25_residuals",
    "SELECT p_partkey AS key, p_retailprice AS actual, m AS predicted, round(p_retailprice - m, 4) AS residual FROM "
    "(SELECT *, round(sum(p_retailprice::DECIMAL(18,2)) OVER (PARTITION BY p_brand)::DOUBLE / count(*) OVER (PARTITION BY p_brand), 4) AS m FROM part)",
)
def _(spark, sf):
    part = load(spark, sf, "part")
    means = part.groupBy(F.col("p_brand").alias("b")).agg(F.round(S.mean(F.col("p_retailprice").cast("decimal(18,2)")), 4).alias("m"))
    return metrics.residuals(part.join(small_side(means), F.col("p_brand") == F.col("b")), "p_retailprice", "m", "p_partkey")


@register(
    "m25_error_rates",
    "SELECT quality::VARCHAR AS label, count(*) AS n, round(avg((quality <> toxic)::INTEGER), 4) AS error_rate FROM labels GROUP BY 1",
)
def _(spark, sf):
    return metrics.error_rates(load(spark, sf, "labels"), "quality", "toxic")


# --- training ---------------------------------------------------------------

def parts(spark, sf) -> DataFrame:
    """Part prices follow the part number; brand and type are noise."""
    return load(spark, sf, "part").selectExpr("p_partkey AS id", "p_partkey * 1.0D AS place", "p_size", "p_brand", "p_type", "p_retailprice")


def labelled_documents(spark, sf) -> DataFrame:
    """Document quality with plain features of the whole text."""
    d = load(spark, sf, "documents").join(load(spark, sf, "labels"), "doc_id")
    # the texts are read once; training then works on this narrow table
    return pinned(d.select(
        "doc_id", "lang", "source", "n_chars", F.size(F.split("text", r"\s+")).alias("words"),
        F.length(F.regexp_replace("text", "[^0-9]", "")).alias("digits"),
        F.length(F.regexp_replace("text", r"[^.!?]", "")).alias("stops"), "quality",
    ))


def vectors_of(spark, sf) -> DataFrame:
    """Embeddings as plain feature columns, one for each element, with their label."""
    e = load(spark, sf, "embeddings")
    width = e.agg(F.max(F.size("embedding"))).first()[0] or 0
    return e.select("vec_id", *[F.get("embedding", F.lit(i)).cast("double").alias(f"e{i}") for i in range(width)], F.col("label"))


def _report(result: train.Result, spark) -> DataFrame:
    rows = [(result.algo_id, k, float(v)) for k, v in sorted(result.metrics.items())]
    rows += [(result.algo_id, f"cv_{k}", float(result.cv[k])) for k in ("mean", "std") if k in (result.cv or {})]
    rows += [(result.algo_id, f"importance_{name}", float(v)) for name, v in result.importance or []]
    rows += [(result.algo_id, "n_train", float(result.n_train)), (result.algo_id, "n_test", float(result.n_test))]
    return S.small_frame(spark, rows, "algo_id string, metric string, value double")


def _regression(name: str, algo: str, params: dict | None = None):
    def run(spark, sf):
        return _report(train.train(parts(spark, sf), "p_retailprice", algo, params, "id", save=False), spark)

    register(name)(run)


def _classification(name: str, algo: str, params: dict | None = None):
    def run(spark, sf):
        return _report(train.train(labelled_documents(spark, sf), "quality", algo, params, "doc_id", save=False), spark)

    register(name)(run)


def order_status(spark, sf) -> DataFrame:
    return load(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_custkey", "o_orderpriority", "o_orderstatus")


def _status(name: str, algo: str, params: dict | None = None):
    """Algorithms that want at least some hundred rows run on the orders."""

    def run(spark, sf):
        return _report(train.train(order_status(spark, sf), "o_orderstatus", algo, params, "o_orderkey", save=False), spark)

    register(name)(run)


for _name, _algo, _params in (
    ("l02_ridge", "ridge", None), ("l03_lasso", "lasso", None), ("l04_elasticnet", "elasticnet", None),
    ("l05_bayesian_ridge", "bayesian_ridge", None), ("l06_huber", "huber", None), ("l07_sgd_regressor", "sgd_regressor", None),
    ("l08_decision_tree_reg", "decision_tree_reg", None), ("l09_random_forest_reg", "random_forest_reg", None),
    ("l10_extra_trees_reg", "extra_trees_reg", None),
    ("l11_gradient_boosting_reg", "gradient_boosting_reg", None), ("l11_lightgbm_reg", "lightgbm_reg", None),
    ("l12_adaboost_reg", "adaboost_reg", None), ("l13_bagging_reg", "bagging_reg", None),
    ("l14_knn_reg", "knn_reg", None), ("l15_svr_linear", "svr_linear", None),
):
    _regression(_name, _algo, _params)
for _name, _algo, _params in (
    ("l08_decision_tree_clf", "decision_tree_clf", None),
    ("l09_random_forest_clf", "random_forest_clf", None), ("l10_extra_trees_clf", "extra_trees_clf", None),
    ("l11_gradient_boosting_clf", "gradient_boosting_clf", None),
    ("l12_adaboost_clf", "adaboost_clf", None), ("l13_bagging_clf", "bagging_clf", None),
    ("l14_knn_clf", "knn_clf", None), ("l16_logistic_regression", "logistic_regression", None), ("l17_ridge_classifier", "ridge_classifier", None),
    ("l18_gaussian_nb", "gaussian_nb", None), ("l18_multinomial_nb", "multinomial_nb", None), ("l18_bernoulli_nb", "bernoulli_nb", None),
    ("l19_linear_svc", "linear_svc", None), ("l20_lda", "lda", None), ("l21_qda", "qda", None),
):
    _classification(_name, _algo, _params)
for _name, _algo, _params in (
    ("l07_sgd_classifier", "sgd_classifier", None), ("l11_hist_gb_clf", "hist_gb_clf", None),
    ("l22_mlp_clf", "mlp_clf", None),
):
    _status(_name, _algo, _params)


@register(
    "l01_linear_regression",
    "SELECT round(regr_slope(p_retailprice, p_partkey), 4) AS slope, round(regr_intercept(p_retailprice, p_partkey), 2) AS intercept FROM part",
)
def _(spark, sf):
    rows = load(spark, sf, "part").select(array_to_vector(F.array(F.col("p_partkey").cast("double"))).alias("features"), F.col("p_retailprice").alias("label"))
    model = estimators.build("linear_regression", None, estimators.Context(rows.count(), 1)).fit(rows)
    # the fitted line read back through predictions at 0 and 1
    line = spark.range(2).select(array_to_vector(F.array(F.col("id").cast("double"))).alias("features"), "id")
    at = model.transform(line).groupBy().pivot("id", [0, 1]).agg(F.first("prediction"))
    return at.select(F.round(F.col("1") - F.col("0"), 4).alias("slope"), F.round("0", 2).alias("intercept"))


@register("l16_logistic_regression_multiclass")
def _(spark, sf):
    r = train.train(vectors_of(spark, sf), "label", "logistic_regression", None, "vec_id", save=False)
    return _report(r, spark)


@register("m11_cross_validation")
def _(spark, sf):
    cv = train.cross_validate(labelled_documents(spark, sf), "quality", "lda", None, "classification", [0, 1], None, key="doc_id", dates=["doc_id"])
    rows = [(i, float(v)) for i, v in enumerate(cv["folds"])] + [(-1, cv["mean"]), (-2, cv["std"])]
    return S.small_frame(spark, rows, "fold int, score double")


@register("m18_permutation_importance")
def _(spark, sf):
    r = train.train(parts(spark, sf), "p_retailprice", "ridge", None, "id", save=False)
    return train.permutation_importance(r.fitted, parts(spark, sf), key="id")


@register("m20_train")
def _(spark, sf):
    r = train.train(labelled_documents(spark, sf), "quality", "random_forest_clf", None, "doc_id")
    return train.run_row(spark, r, "documents").drop("created_at", "id", "model_path", "training_time_s")


@register("m21_tune")
def _(spark, sf):
    tried, _ = train.tune(parts(spark, sf), "p_retailprice", "ridge", "grid", key="id", save=False)
    return tried


@register("m22_automl")
def _(spark, sf):
    p = parts(spark, sf)
    profiles = S.small_frame(spark, [("part", "regression", p.count(), 0.0, 0, False, 1.0)],
                             "dataset string, task string, n_rows bigint, total_missing_pct double, n_text int, high_cardinality boolean, imbalance_ratio double")
    listed = shortlist.shortlist(catalog.algorithm_catalog(spark, trainable_only=True), profiles)
    ids = [r["id"] for r in listed.orderBy("rank").limit(3).collect()]
    board, _ = train.automl(p, "p_retailprice", [*ids, "svr_rbf"], key="id", save=False)
    return board.drop("seconds")


@register("m23_predict")
def _(spark, sf):
    rows = labelled_documents(spark, sf)
    r = train.train(rows, "quality", "gaussian_nb", None, "doc_id")
    return train.predict(rows.drop("words"), r.path).select("doc_id", "prediction", "confidence")


@register("m26_model_importances")
def _(spark, sf):
    r = train.train(parts(spark, sf), "p_retailprice", "random_forest_reg", None, "id", save=False)
    return train.model_importances(r.fitted)


# --- neighbours, clusters, outliers -----------------------------------------

def _points(spark, sf):
    return neighbours.points(load(spark, sf, "embeddings"), "vec_id", F.col("embedding"))


_NEAR = """
    WITH p AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings),
    d AS (SELECT a.id, b.id AS neighbour, list_distance(a.v, b.v) AS distance FROM p a JOIN p b ON a.id <> b.id),
    n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, neighbour) AS place FROM d),
"""


@register("l14_nearest_neighbours", _NEAR + "k AS (SELECT * FROM n WHERE place <= 5) SELECT id, neighbour, round(distance, 6) AS distance, place FROM k")
def _(spark, sf):
    pts = _points(spark, sf)
    return neighbours.nearest(pts, pts, 5, exclude_self=True).withColumn("distance", F.round("distance", 6))


@register(
    "l33_local_outlier_factor",
    _NEAR
    + """
    k AS (SELECT * FROM n WHERE place <= 20), r AS (SELECT id, max(distance) AS kd FROM k GROUP BY 1),
    l AS (SELECT k.id, 1 / (avg(greatest(kd, distance)) + 1e-10) AS lrd FROM k JOIN r ON k.neighbour = r.id GROUP BY 1)
    SELECT k.id, round(avg(o.lrd) / any_value(l.lrd), 4) AS lof, avg(o.lrd) / any_value(l.lrd) > 1.5 AS is_anomaly
    FROM k JOIN l o ON k.neighbour = o.id JOIN l ON l.id = k.id GROUP BY 1
    """,
)
def _(spark, sf):
    return groups.local_outlier_factor(groups.embedded(load(spark, sf, "embeddings"), "embedding"), "vec_id", 20)


def _customers(spark, sf):
    return load(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_acctbal")


@register("l28_kmeans")
def _(spark, sf):
    rows = groups.vectors(_customers(spark, sf), ["c_nationkey", "c_acctbal"])
    return groups.cluster_summary(groups.kmeans(rows, 4), ["c_nationkey", "c_acctbal"])


@register("l29_dbscan")
def _(spark, sf):
    rows = groups.vectors(_customers(spark, sf), ["c_nationkey", "c_acctbal"])
    return groups.dbscan(rows, "c_custkey", 0.2, 5)


@register("l30_spectral")
def _(spark, sf):
    return groups.spectral(groups.embedded(load(spark, sf, "embeddings"), "embedding"), "vec_id", 4)


@register("l31_gaussian_mixture")
def _(spark, sf):
    rows = groups.vectors(_customers(spark, sf), ["c_nationkey", "c_acctbal"])
    return groups.gaussian_mixture(rows, 3).select("c_custkey", "cluster")


@register("l32_isolation_forest")
def _(spark, sf):
    rows = groups.vectors(_customers(spark, sf), ["c_nationkey", "c_acctbal"])
    return groups.isolation_forest(rows, "c_custkey").select("c_custkey", "anomaly_score", "is_anomaly")


@register("l34_elliptic_envelope")
def _(spark, sf):
    rows = groups.vectors(_customers(spark, sf), ["c_nationkey", "c_acctbal"])
    return groups.elliptic_envelope(rows).select("c_custkey", "mahalanobis", "is_anomaly")


@register(
    "l35_pca",
    # two standardised columns: the first axis is their sum or difference
    """
    WITH s AS (SELECT avg(c_nationkey) a, stddev_pop(c_nationkey) b, avg(c_acctbal) c, stddev_pop(c_acctbal) d, corr(c_nationkey, c_acctbal) r FROM customer)
    SELECT c_custkey, round(abs((c_nationkey - a) / b + CASE WHEN r > 0 THEN 1 ELSE -1 END * (c_acctbal - c) / d) / sqrt(2), 3) AS axis_1 FROM customer, s
    """,
)
def _(spark, sf):
    rows = groups.vectors(_customers(spark, sf), ["c_nationkey", "c_acctbal"])
    out, _ = groups.pca(rows, 2)
    return out.select("c_custkey", F.round(F.abs("axis_1"), 3).alias("axis_1"))


@register("l36_truncated_svd")
def _(spark, sf):
    out, _ = groups.truncated_svd(groups.embedded(load(spark, sf, "embeddings"), "embedding"), 2)
    return out.select("vec_id", F.round("axis_1", 4).alias("axis_1"), F.round("axis_2", 4).alias("axis_2"))


@register("g01_segment")
def _(spark, sf):
    names = ["c_custkey", "c_nationkey", "c_acctbal"]
    return groups.cluster_summary(groups.segment(load(spark, sf, "customer"), 4, names), names)


@register("g02_segment_projection")
def _(spark, sf):
    seg = groups.segment(load(spark, sf, "customer"), 4, ["c_custkey", "c_nationkey", "c_acctbal"])
    return groups.projected(seg, "c_custkey")


# --- forecasts --------------------------------------------------------------

def _series(spark, sf):
    return forecast.series_table(t.orders(spark, sf), "o_orderpriority", "o_orderdate", "o_totalprice", "monthly", "sum")


_SERIES = f"SELECT o_orderpriority AS series, date_trunc('month', o_orderdate)::DATE AS ds, sum(o_totalprice)::DOUBLE AS y FROM ({t.ORDERS}) GROUP BY 1, 2"


def _rounded(df):
    return df.withColumn("forecast", F.round("forecast", 2))


@register(
    "l23_naive_last",
    f"WITH s AS ({_SERIES}), l AS (SELECT series, max(ds) AS last, arg_max(y, ds) AS y FROM s GROUP BY 1) "
    "SELECT series, (last + to_months(k::INTEGER))::DATE AS ds, round(y, 2) AS forecast FROM l, range(1, 7) r(k)",
)
def _(spark, sf):
    return _rounded(forecast.naive_last(_series(spark, sf), 6))


@register(
    "l24_seasonal_naive",
    f"WITH s AS ({_SERIES}), n AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY ds DESC) AS r, max(ds) OVER (PARTITION BY series) AS last FROM s) "
    "SELECT series, (last + to_months(k::INTEGER))::DATE AS ds, round(y, 2) AS forecast FROM n JOIN range(1, 19) q(k) ON n.r = 12 - (q.k - 1) % 12",
)
def _(spark, sf):
    return _rounded(forecast.seasonal_naive(_series(spark, sf), 18, 12))


@register("l25_ml_lags")
def _(spark, sf):
    events = load(spark, sf, "events").select("event_id", "ts", "value", "event_type")
    r = train.train(events, "value", "ml_lag_rf", None, "event_id", "ts", ["event_type"], save=False)
    return _report(r, spark)


@register("l26_arima")
def _(spark, sf):
    return _rounded(forecast.arima(_series(spark, sf), 6))


@register("l27_holt_winters")
def _(spark, sf):
    return _rounded(forecast.holt_winters(_series(spark, sf), 6, 12))
