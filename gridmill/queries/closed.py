"""Estimators on one or two columns, where SQL can work out the same model; folds in time; runs without a target."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridmill.functions import semantics as S
from gridmill.ml import estimators, forecast, groups, prep, train
from gridmill.queries import register
from gridmill.queries import tables as t
from gridmill.queries.tables import load


def _line(df: DataFrame, x: list[str], y: str) -> DataFrame:
    return df.select(array_to_vector(F.array(*[F.expr(c).cast("double") for c in x])).alias("features"), F.expr(y).cast("double").alias("label"))


def _model(algo: str, rows: DataFrame, params: dict | None = None, classes: int = 0):
    """The registry's estimator, fitted on all rows."""
    rows = rows.persist()
    model = estimators.build(algo, params, estimators.Context(rows.count(), 1, classes)).fit(rows)
    rows.unpersist()
    return model.stages[-1] if hasattr(model, "stages") else model


def _prices(spark, sf) -> DataFrame:
    return _line(load(spark, sf, "part"), ["p_size"], "p_retailprice")


def _large(spark, sf) -> DataFrame:
    """Two classes that mostly follow the size of a part."""
    return _line(load(spark, sf, "part"), ["p_size"], "CASE WHEN p_size + p_partkey % 17 > 30 THEN 1 ELSE 0 END")


_P = "WITH p AS (SELECT p_size::DOUBLE AS x, p_retailprice::DOUBLE AS y FROM part), s AS (SELECT count(*) AS n, avg(x) AS mx, avg(y) AS my, sum(x * x) - count(*) * avg(x) ** 2 AS xx, sum(x * y) - count(*) * avg(x) * avg(y) AS xy, sum(y * y) - count(*) * avg(y) ** 2 AS yy FROM p)"


@register("l02_ridge_line", f"{_P} SELECT round(xy / (xx + 5000), 4) AS slope, round(my - xy / (xx + 5000) * mx, 2) AS intercept FROM s")
def _(spark, sf):
    m = _model("ridge", _prices(spark, sf), {"alpha": 5000.0}).state
    return S.small_frame(spark, [(round(m["coef"][0], 4), round(m["intercept"], 2))], "slope double, intercept double")


@register(
    "l04_elasticnet_line",
    # the soft threshold on the covariance, then the quadratic penalty
    f"{_P.replace('p_size::DOUBLE', 'p_partkey * 0.01')}, w AS (SELECT sign(xy) * greatest(abs(xy) / n - 0.2, 0) / (xx / n + 0.3) AS w FROM s) SELECT round(w, 3) AS slope, round(my - w * mx, 2) AS intercept FROM w, s",
)
def _(spark, sf):
    rows = _line(load(spark, sf, "part"), ["p_partkey * 0.01D"], "p_retailprice")
    m = _model("elasticnet", rows, {"alpha": 0.5, "l1_ratio": 0.4})
    return S.small_frame(spark, [(round(float(m.coefficients[0]), 3), round(float(m.intercept), 2))], "slope double, intercept double")


@register(
    "l05_bayesian_ridge_line",
    f"""{_P.replace("WITH", "WITH RECURSIVE")},
    it AS (
      SELECT 0 AS step, 1 / greatest(yy / n, 1e-12) AS alpha, 1.0::DOUBLE AS lam, 0.0::DOUBLE AS w, 1.0::DOUBLE AS moved FROM s
      UNION ALL
      SELECT step + 1, (n - g + 2e-6) / (rss + 2e-6), (g + 2e-6) / (w2 * w2 + 2e-6), w2, abs(w2 - w)
      FROM (SELECT *, alpha * xx / (lam + alpha * xx) AS g, greatest(yy - 2 * w2 * xy + w2 * w2 * xx, 0) AS rss
            FROM (SELECT it.*, s.*, xy / (xx + lam / alpha) AS w2 FROM it, s WHERE moved >= 1e-3 AND step < 300))
    )
    SELECT round(w, 3) AS slope, round(my - mx * w, 1) AS intercept FROM it, s ORDER BY step DESC LIMIT 1""",
)
def _(spark, sf):
    m = _model("bayesian_ridge", _prices(spark, sf)).state
    return S.small_frame(spark, [(round(m["coef"][0], 3), round(m["intercept"], 1))], "slope double, intercept double")


_C = "WITH p AS (SELECT p_size::DOUBLE AS x, (p_size + p_partkey % 17 > 30)::INTEGER AS k FROM part), g AS (SELECT k, count(*) AS n, avg(x) AS m, var_pop(x) AS v, var_samp(x) AS vs FROM p GROUP BY k), a AS (SELECT count(*) AS n, avg(x) AS m, var_pop(x) AS v FROM p)"
_STATE = "class int, coef double, intercept double"


def _states(spark, m) -> DataFrame:
    rows = [(int(c), round(w[0], 5), round(b, 4)) for c, w, b in zip(m["classes"], m["coef"], m["intercept"], strict=True)]
    return S.small_frame(spark, rows, _STATE)


@register(
    "l17_ridge_classifier_line",
    # the targets are 1 for the class and -1 for the other: their covariance with x is 2 n_k (m_k - m)
    f"{_C}, w AS (SELECT g.k, 2 * g.n * (g.m - a.m) / (a.v * a.n + 1) AS w, 2 * g.n / a.n - 1 AS y, a.m FROM g, a) SELECT k AS class, round(w, 5) AS coef, round(y - m * w, 4) AS intercept FROM w",
)
def _(spark, sf):
    return _states(spark, _model("ridge_classifier", _large(spark, sf), classes=2).state)


@register(
    "l20_lda_line",
    f"{_C}, q AS (SELECT sum(n * v) / sum(n) AS v FROM g) SELECT g.k AS class, round(g.m / q.v, 5) AS coef, round(-g.m * g.m / q.v / 2 + ln(g.n / a.n), 4) AS intercept FROM g, q, a",
)
def _(spark, sf):
    return _states(spark, _model("lda", _large(spark, sf), classes=2).state)


@register("l21_qda_line", f"{_C} SELECT g.k AS class, round(g.m, 5) AS center, round(1 / g.vs, 7) AS precision, round(ln(g.n / a.n) - ln(g.vs) / 2, 4) AS intercept FROM g, a")
def _(spark, sf):
    m = _model("qda", _large(spark, sf), classes=2).state
    rows = [(int(c), round(x[0], 5), round(q[0][0], 7), round(b, 4)) for c, x, q, b in zip(m["classes"], m["center"], m["matrix"], m["intercept"], strict=True)]
    return S.small_frame(spark, rows, "class int, center double, precision double, intercept double")


@register("l18_gaussian_nb_line", f"{_C} SELECT g.k AS class, round(g.m, 5) AS mean, round(g.v, 4) AS variance, round(ln(g.n / a.n), 5) AS prior FROM g, a")
def _(spark, sf):
    m = _model("gaussian_nb", _large(spark, sf), classes=2)
    rows = [(k, round(float(m.theta.toArray()[k, 0]), 5), round(float(m.sigma.toArray()[k, 0]), 4), round(float(m.pi.toArray()[k]), 5)) for k in range(2)]
    return S.small_frame(spark, rows, "class int, mean double, variance double, prior double")


def _stump(model) -> tuple:
    """(cut, value of the left leaf, value of the right leaf) of the first tree."""
    tree = model.rounds[0][0]
    return model.edges[tree.feature[0]][tree.cut[0]], tree.value[tree.left[0]], tree.value[tree.right[0]]


# cuts lie after each size; the best has the largest sum of squared class counts over side sizes, the smallest cut among equals
_CUTS = """, f AS (SELECT x, count(*) AS n, sum(t) AS t, sum(1 - t) AS u FROM p GROUP BY x),
    c AS (SELECT x, sum(n) OVER w AS n, sum(t) OVER w AS t, sum(u) OVER w AS u, sum(n) OVER () AS an, sum(t) OVER () AS at_, sum(u) OVER () AS au FROM f WINDOW w AS (ORDER BY x)),
    b AS (SELECT * FROM c WHERE n < an ORDER BY round(score, 9) DESC, x LIMIT 1)"""


@register(
    "l12_adaboost_stump",
    "WITH p AS (SELECT p_size::DOUBLE AS x, (p_size + p_partkey % 17 > 30)::INTEGER AS t FROM part)"
    + _CUTS.replace("SELECT * FROM c WHERE", "SELECT *, (t * t + u * u) / n + ((at_ - t) ** 2 + (au - u) ** 2) / (an - n) AS score FROM c WHERE")
    + ", e AS (SELECT *, (least(t, u) + least(at_ - t, au - u)) / an AS err FROM b)"
    + " SELECT x AS cut, round(t / n, 6) AS low, round((at_ - t) / (an - n), 6) AS high, round(ln((1 - err) / err), 6) AS vote FROM e",
)
def _(spark, sf):
    m = _model("adaboost_clf", _large(spark, sf), {"n_estimators": 1}, 2)
    cut, low, high = _stump(m)
    return S.small_frame(spark, [(cut, round(low[1], 6), round(high[1], 6), round(m.weights[0], 6))], "cut double, low double, high double, vote double")


@register(
    "l11_hist_gb_stump",
    # one round: the leaves are the mean residuals, at the cut that leaves the least squares
    "WITH q AS (SELECT p_size::DOUBLE AS x, p_retailprice - avg(p_retailprice) OVER () AS r, avg(p_retailprice) OVER () AS m FROM part), "
    "f AS (SELECT x, count(*) AS n, sum(r) AS s, any_value(m) AS m FROM q GROUP BY x), "
    "c AS (SELECT x, m, sum(n) OVER w AS n, sum(s) OVER w AS s, sum(n) OVER () AS an, sum(s) OVER () AS als FROM f WINDOW w AS (ORDER BY x)), "
    "b AS (SELECT * FROM c WHERE n >= 20 AND an - n >= 20 ORDER BY round(s * s / n + (als - s) ** 2 / (an - n), 6) DESC, x LIMIT 1) "
    "SELECT x AS cut, round(m, 4) AS start, round(s / n, 4) AS low, round((als - s) / (an - n), 4) AS high FROM b",
)
def _(spark, sf):
    m = _model("hist_gb_reg", _prices(spark, sf), {"n_estimators": 1, "max_depth": 1})
    cut, low, high = _stump(m)
    return S.small_frame(spark, [(cut, round(m.start[0], 4), round(low[0], 4), round(high[0], 4))], "cut double, start double, low double, high double")


@register(
    "l36_singular_values",
    "WITH m AS (SELECT sum(c_nationkey * c_nationkey)::DOUBLE AS a, sum(c_nationkey * c_acctbal / 1000) AS b, sum((c_acctbal / 1000) ** 2) AS c FROM customer), "
    "r AS (SELECT (a + c) / 2 AS mid, sqrt(((a - c) / 2) ** 2 + b * b) AS arm FROM m) "
    "SELECT 1 AS axis, round(sqrt(mid + arm), 4) AS value FROM r UNION ALL SELECT 2, round(sqrt(mid - arm), 4) FROM r",
)
def _(spark, sf):
    rows = load(spark, sf, "customer").selectExpr("c_nationkey", "c_acctbal / 1000 AS balance")
    _, values = groups.truncated_svd(groups.vectors(rows, ["c_nationkey", "balance"], scale=False), 2)
    return S.small_frame(spark, [(i + 1, round(v, 4)) for i, v in enumerate(values)], "axis int, value double")


# --- folds in time ------------------------------------------------------------

@register(
    "m11_rolling_folds",
    """
    WITH e AS (SELECT event_id, epoch_us(ts) AS u, lead(epoch_us(ts), 7) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS later FROM events),
    c AS (SELECT quantile_cont(u::DOUBLE, [1.0 / 6, 2.0 / 6, 3.0 / 6, 4.0 / 6, 5.0 / 6]) AS q FROM e)
    SELECT event_id, len(list_filter(q, lambda x: u > x))::INTEGER AS fold, CASE WHEN later IS NOT NULL THEN (len(list_filter(q, lambda x: later > x)) + 1)::INTEGER END AS ready FROM e, c
    """,
)
def _(spark, sf):
    events = load(spark, sf, "events").select("event_id", "ts", "event_type")
    return prep.rolling_folds(events, "ts", 5, 7, ["event_type"], "event_id").select("event_id", "fold", "ready")


# --- forecasts with gaps ------------------------------------------------------

_GAP = "o_orderdate >= DATE '2000-10-01' AND o_orderdate < DATE '2000-12-01' AND o_orderpriority <> '5-LOW'"


@register(
    "l24_seasonal_naive_gap",
    f"""
    WITH s AS (SELECT o_orderpriority AS series, date_trunc('month', o_orderdate)::DATE AS ds, sum(o_totalprice)::DOUBLE AS y FROM ({t.ORDERS}) WHERE NOT ({_GAP}) GROUP BY 1, 2),
    l AS (SELECT series, max(ds) AS last FROM s GROUP BY 1),
    f AS (SELECT series, (last + to_months(k::INTEGER))::DATE AS ds FROM l, range(1, 13) r(k))
    SELECT f.series, f.ds, round(arg_max(s.y, s.ds), 2) AS forecast FROM f JOIN s ON s.series = f.series AND s.ds < f.ds AND month(s.ds) = month(f.ds) GROUP BY 1, 2
    """,
)
def _(spark, sf):
    kept = t.orders(spark, sf).filter(f"NOT ({_GAP})")
    series = forecast.series_table(kept, "o_orderpriority", "o_orderdate", "o_totalprice", "monthly", "sum")
    return forecast.seasonal_naive(series, 12, 12).withColumn("forecast", F.round("forecast", 2))


# --- runs without a target, and of whole series ---------------------------------

def _report(result: train.Result, spark) -> DataFrame:
    rows = [(k, float(v)) for k, v in sorted(result.metrics.items())]
    return S.small_frame(spark, [*rows, ("n_train", float(result.n_train))], "metric string, value double")


def _customers(spark, sf) -> DataFrame:
    return load(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_acctbal")


_R = "WITH r AS (SELECT count(*) AS n, abs(corr(c_nationkey, c_acctbal)) AS r FROM customer) "
_UNLABELLED = {
    "kmeans": None, "minibatch_kmeans": None, "gmm": None, "spectral": None, "dbscan": None, "isolation_forest": None, "local_outlier_factor": None,
    "elliptic_envelope": (
        "WITH c AS (SELECT count(*) AS n FROM customer), f AS (SELECT n, n - 1 - floor((n - 1) * 0.95) AS a FROM c) "
        "SELECT 'anomalies' AS metric, a AS value FROM f UNION ALL SELECT 'anomaly_share', round(a / n, 4) FROM f UNION ALL SELECT 'n_train', n FROM f"
    ),
    "pca": _R + "SELECT 'explained_1' AS metric, round((1 + r) / 2, 4) AS value FROM r UNION ALL SELECT 'explained_2', round((1 - r) / 2, 4) FROM r UNION ALL SELECT 'n_train', n FROM r",
    "truncated_svd": _R + "SELECT 'singular_value_1' AS metric, round(sqrt(n * (1 + r)), 4) AS value FROM r UNION ALL SELECT 'singular_value_2', round(sqrt(n * (1 - r)), 4) FROM r UNION ALL SELECT 'n_train', n FROM r",
}
for _algo, _sql in _UNLABELLED.items():
    def _run(spark, sf, algo=_algo):
        return _report(train.train(_customers(spark, sf), None, algo, None, "c_custkey", save=False), spark)

    register(f"m20_{_algo}", _sql)(_run)


def _scores_sql(guess: str) -> str:
    """Scores over the last six of 30 days; ``guess`` gives (series, ds, forecast) from the days before, ``b``."""
    return f"""
    WITH s AS (SELECT event_type AS series, ts::DATE AS ds, avg(value) AS y FROM events GROUP BY 1, 2),
    d AS (SELECT DISTINCT ds FROM s), n AS (SELECT count(*) AS n FROM d),
    cut AS (SELECT ds AS c FROM (SELECT ds, row_number() OVER (ORDER BY ds DESC) AS r FROM d), n WHERE r = greatest(1, floor(n * 0.2)) + 1),
    b AS (SELECT s.* FROM s, cut WHERE ds <= c), a AS (SELECT s.* FROM s, cut WHERE ds > c),
    g AS ({guess}), x AS (SELECT a.y, g.forecast AS f FROM a JOIN g ON a.series = g.series AND a.ds = g.ds)
    SELECT 'mae' AS metric, round(avg(abs(y - f)), 4) AS value FROM x UNION ALL SELECT 'rmse', round(sqrt(avg((y - f) ** 2)), 4) FROM x
    UNION ALL SELECT 'mape', round(avg(abs((y - f) / nullif(y, 0))) * 100, 4) FROM x UNION ALL SELECT 'r2', round(1 - avg((y - f) ** 2) / var_pop(y), 4) FROM x
    UNION ALL SELECT 'n_train', count(*) FROM b
    """


_SERIES = {
    "naive_last": _scores_sql("SELECT a.series, a.ds, l.forecast FROM a JOIN (SELECT series, arg_max(y, ds) AS forecast FROM b GROUP BY 1) l USING (series)"),
    "seasonal_naive": _scores_sql(
        "SELECT a.series, a.ds, arg_max(b.y, b.ds) AS forecast FROM a JOIN b ON a.series = b.series AND datediff('day', b.ds, a.ds) % 7 = 0 GROUP BY 1, 2"
    ),
    "arima": None, "holt_winters": None,
}
for _algo, _sql in _SERIES.items():
    def _run(spark, sf, algo=_algo):
        events = load(spark, sf, "events").select("event_id", "ts", "event_type", "value")
        return _report(train.train(events, "value", algo, None, "event_id", "ts", ["event_type"], save=False), spark)

    register(f"m20_{_algo}", _sql)(_run)
