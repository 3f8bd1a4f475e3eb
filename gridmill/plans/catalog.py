"""Lookup tables: the charts and the algorithms that rules may choose from."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

from gridmill.functions.semantics import small_frame


class Chart(NamedTuple):
    id: str
    title: str
    needs: list[str]  # required spec keys


class Algorithm(NamedTuple):
    id: str
    name: str
    family: str
    task: str
    min_rows: int
    max_rows: int | None
    speed: str
    handles_missing: bool
    handles_high_cardinality: bool
    interpretable: bool


# Fixed values.
CHARTS = [
    Chart(id="bar", title="Bar Chart", needs=["x", "y"]),
    Chart(id="hbar", title="Horizontal Bar", needs=["x", "y"]),
    Chart(id="stacked_bar", title="Stacked Bar", needs=["x", "y", "group"]),
    Chart(id="grouped_bar", title="Grouped Bar", needs=["x", "y", "group"]),
    Chart(id="line", title="Line Chart", needs=["x", "y"]),
    Chart(id="area", title="Area Chart", needs=["x", "y"]),
    Chart(id="time_series", title="Time Series", needs=["x", "y"]),
    Chart(id="multi_line", title="Multi-Line", needs=["x", "y", "group"]),
    Chart(id="pie", title="Pie Chart", needs=["x"]),
    Chart(id="donut", title="Donut Chart", needs=["x"]),
    Chart(id="polar", title="Polar Area", needs=["x"]),
    Chart(id="histogram", title="Histogram", needs=["x"]),
    Chart(id="density", title="Density Plot", needs=["x"]),
    Chart(id="box", title="Box Plot", needs=["x"]),
    Chart(id="stats_bar", title="Statistics Bar", needs=["x"]),
    Chart(id="scatter", title="Scatter Plot", needs=["x", "y"]),
    Chart(id="bubble", title="Bubble Chart", needs=["x", "y", "r"]),
    Chart(id="radar", title="Radar Chart", needs=["cols"]),
    Chart(id="heatmap", title="Correlation Heatmap", needs=["cols"]),
    Chart(id="treemap", title="Treemap", needs=["x", "y"]),
    Chart(id="funnel", title="Funnel Chart", needs=["x"]),
    Chart(id="gauge", title="Gauge", needs=["x"]),
    Chart(id="kpi_tile", title="KPI Tile", needs=["x"]),
    Chart(id="waterfall", title="Waterfall Chart", needs=["x", "y"]),
    Chart(id="pareto", title="Pareto Chart", needs=["x", "y"]),
    Chart(id="cat_counts", title="Category Counts", needs=["x"]),
    Chart(id="dual_axis", title="Dual-Axis Line", needs=["x", "y", "y2"]),
]

# Fixed values.
ALGORITHMS = [
    Algorithm(
        id="linear_regression", name="Linear Regression", family="Linear", task="regression", min_rows=10, max_rows=None, speed="fast",
        handles_missing=False, handles_high_cardinality=False, interpretable=True,
    ),
    Algorithm(
        id="ridge", name="Ridge Regression", family="Linear", task="regression", min_rows=10, max_rows=None, speed="fast",
        handles_missing=False, handles_high_cardinality=False, interpretable=True,
    ),
    Algorithm(
        id="lasso", name="Lasso Regression", family="Linear", task="regression", min_rows=10, max_rows=None, speed="fast",
        handles_missing=False, handles_high_cardinality=False, interpretable=True,
    ),
    Algorithm(
        id="elasticnet", name="ElasticNet", family="Linear", task="regression", min_rows=10, max_rows=None, speed="fast",
        handles_missing=False, handles_high_cardinality=False, interpretable=True,
    ),
    Algorithm(
        id="bayesian_ridge", name="Bayesian Ridge", family="Linear", task="regression", min_rows=10, max_rows=None, speed="fast",
        handles_missing=False, handles_high_cardinality=False, interpretable=True,
    ),
    Algorithm(
        id="huber", name="Huber Regressor", family="Linear", task="regression", min_rows=10, max_rows=None, speed="fast",
        handles_missing=False, handles_high_cardinality=False, interpretable=True,
    ),
    Algorithm(
        id="sgd_regressor", name="SGD Regressor", family="Linear", task="regression", min_rows=1000, max_rows=None, speed="fast",
        handles_missing=False, handles_high_cardinality=False, interpretable=False,
    ),
    Algorithm(
        id="decision_tree_reg", name="Decision Tree", family="Tree", task="regression", min_rows=10, max_rows=None, speed="fast",
        handles_missing=False, handles_high_cardinality=False, interpretable=True,
    ),
    Algorithm(
        id="random_forest_reg", name="Random Forest", family="Ensemble", task="regression", min_rows=10, max_rows=None, speed="medium",
        handles_missing=False, handles_high_cardinality=False, interpretable=False,
    ),
    Algorithm(
        id="extra_trees_reg", name="Extra Trees", family="Ensemble", task="regression", min_rows=10, max_rows=None, speed="medium",
        handles_missing=False, handles_high_cardinality=False, interpretable=False,
    ),
    Algorithm(
        id="gradient_boosting_reg", name="Gradient Boosting", family="Boosting", task="regression", min_rows=10, max_rows=None, speed="slow",
        handles_missing=False, handles_high_cardinality=False, interpretable=False,
    ),
    Algorithm(
        id="hist_gb_reg", name="HistGradientBoosting", family="Boosting", task="regression", min_rows=1000, max_rows=None, speed="medium",
        handles_missing=True, handles_high_cardinality=False, interpretable=False,
    ),
    Algorithm(
        id="adaboost_reg", name="AdaBoost", family="Boosting", task="regression", min_rows=10, max_rows=None, speed="medium",
        handles_missing=False, handles_high_cardinality=False, interpretable=False,
    ),
    Algorithm(
        id="bagging_reg", name="Bagging Regressor", family="Ensemble", task="regression", min_rows=10, max_rows=None, speed="medium",
        handles_missing=False, handles_high_cardinality=False, interpretable=False,
    ),
    Algorithm(
        id="knn_reg", name="KNN Regressor", family="Instance", task="regression", min_rows=10, max_rows=50000, speed="fast",
        handles_missing=False, handles_high_cardinality=False, interpretable=False,
    ),
    Algorithm(
        id="svr_rbf", name="SVR (RBF kernel)", family="SVM", task="regression", min_rows=10, max_rows=20000, speed="slow",
        handles_missing=False, handles_high_cardinality=False, interpretable=False,
    ),
    Algorithm(
        id="svr_linear", name="Linear SVR", family="SVM", task="regression", min_rows=10, max_rows=None, speed="fast",
        handles_missing=False, handles_high_cardinality=False, interpretable=False,
    ),
    Algorithm(
        id="mlp_reg", name="Neural Net (MLP)", family="Neural", task="regression", min_rows=500, max_rows=None, speed="slow",
        handles_missing=False, handles_high_cardinality=False, interpretable=False,
    ),
    Algorithm(
        id="xgboost_reg", name="XGBoost", family="Boosting", task="regression", min_rows=10, max_rows=None, speed="medium",
        handles_missing=True, handles_high_cardinality=False, interpretable=False,
    ),
    Algorithm(
        id="lightgbm_reg", name="LightGBM", family="Boosting", task="regression", min_rows=10, max_rows=None, speed="fast",
        handles_missing=True, handles_high_cardinality=True, interpretable=False,
    ),
    Algorithm(
        id="catboost_reg", name="CatBoost", family="Boosting", task="regression", min_rows=10, max_rows=None, speed="medium",
        handles_missing=True, handles_high_cardinality=True, interpretable=False,
    ),
    Algorithm(
        id="logistic_regression", name="Logistic Regression", family="Linear", task="classification", min_rows=10, max_rows=None, speed="fast",
        handles_missing=False, handles_high_cardinality=False, interpretable=True,
    ),
    Algorithm(
        id="ridge_classifier", name="Ridge Classifier", family="Linear", task="classification", min_rows=10, max_rows=None, speed="fast",
        handles_missing=False, handles_high_cardinality=False, interpretable=True,
    ),
    Algorithm(
        id="sgd_classifier", name="SGD Classifier", family="Linear", task="classification", min_rows=1000, max_rows=None, speed="fast",
        handles_missing=False, handles_high_cardinality=False, interpretable=False,
    ),
    Algorithm(
        id="knn_clf", name="KNN Classifier", family="Instance", task="classification", min_rows=10, max_rows=50000, speed="fast",
        handles_missing=False, handles_high_cardinality=False, interpretable=False,
    ),
    Algorithm(
        id="gaussian_nb", name="Gaussian Naive Bayes", family="Probabilistic", task="classification", min_rows=10, max_rows=None, speed="fast",
        handles_missing=False, handles_high_cardinality=False, interpretable=False,
    ),
    Algorithm(
        id="multinomial_nb", name="Multinomial Naive Bayes", family="Probabilistic", task="classification", min_rows=10, max_rows=None, speed="fast",
        handles_missing=False, handles_high_cardinality=False, interpretable=False,
    ),
    Algorithm(
        id="bernoulli_nb", name="Bernoulli Naive Bayes", family="Probabilistic", task="classification", min_rows=10, max_rows=None, speed="fast",
        handles_missing=False, handles_high_cardinality=False, interpretable=False,
    ),
    Algorithm(
        id="linear_svc", name="Linear SVC", family="SVM", task="classification", min_rows=10, max_rows=None, speed="fast",
        handles_missing=False, handles_high_cardinality=False, interpretable=False,
    ),
    Algorithm(
        id="svc_rbf", name="SVM (RBF kernel)", family="SVM", task="classification", min_rows=10, max_rows=20000, speed="slow",
        handles_missing=False, handles_high_cardinality=False, interpretable=False,
    ),
    Algorithm(
        id="decision_tree_clf", name="Decision Tree", family="Tree", task="classification", min_rows=10, max_rows=None, speed="fast",
        handles_missing=False, handles_high_cardinality=False, interpretable=True,
    ),
    Algorithm(
        id="random_forest_clf", name="Random Forest", family="Ensemble", task="classification", min_rows=10, max_rows=None, speed="medium",
        handles_missing=False, handles_high_cardinality=False, interpretable=False,
    ),
    Algorithm(
        id="extra_trees_clf", name="Extra Trees", family="Ensemble", task="classification", min_rows=10, max_rows=None, speed="medium",
        handles_missing=False, handles_high_cardinality=False, interpretable=False,
    ),
    Algorithm(
        id="gradient_boosting_clf", name="Gradient Boosting", family="Boosting", task="classification", min_rows=10, max_rows=None, speed="slow",
        handles_missing=False, handles_high_cardinality=False, interpretable=False,
    ),
    Algorithm(
        id="hist_gb_clf", name="HistGradientBoosting", family="Boosting", task="classification", min_rows=1000, max_rows=None, speed="medium",
        handles_missing=True, handles_high_cardinality=False, interpretable=False,
    ),
    Algorithm(
        id="adaboost_clf", name="AdaBoost", family="Boosting", task="classification", min_rows=10, max_rows=None, speed="medium",
        handles_missing=False, handles_high_cardinality=False, interpretable=False,
    ),
    Algorithm(
        id="bagging_clf", name="Bagging Classifier", family="Ensemble", task="classification", min_rows=10, max_rows=None, speed="medium",
        handles_missing=False, handles_high_cardinality=False, interpretable=False,
    ),
    Algorithm(
        id="lda", name="Linear Discriminant Analysis", family="Discriminant", task="classification", min_rows=10, max_rows=None, speed="fast",
        handles_missing=False, handles_high_cardinality=False, interpretable=False,
    ),
    Algorithm(
        id="qda", name="Quadratic Discriminant Analysis", family="Discriminant", task="classification", min_rows=10, max_rows=None, speed="fast",
        handles_missing=False, handles_high_cardinality=False, interpretable=False,
    ),
    Algorithm(
        id="mlp_clf", name="Neural Net (MLP)", family="Neural", task="classification", min_rows=500, max_rows=None, speed="slow",
        handles_missing=False, handles_high_cardinality=False, interpretable=False,
    ),
    Algorithm(
        id="xgboost_clf", name="XGBoost", family="Boosting", task="classification", min_rows=10, max_rows=None, speed="medium",
        handles_missing=True, handles_high_cardinality=False, interpretable=False,
    ),
    Algorithm(
        id="lightgbm_clf", name="LightGBM", family="Boosting", task="classification", min_rows=10, max_rows=None, speed="fast",
        handles_missing=True, handles_high_cardinality=True, interpretable=False,
    ),
    Algorithm(
        id="catboost_clf", name="CatBoost", family="Boosting", task="classification", min_rows=10, max_rows=None, speed="medium",
        handles_missing=True, handles_high_cardinality=True, interpretable=False,
    ),
    Algorithm(
        id="naive_last", name="Naive (last value)", family="Baseline", task="time_series", min_rows=10, max_rows=None, speed="fast",
        handles_missing=False, handles_high_cardinality=False, interpretable=True,
    ),
    Algorithm(
        id="seasonal_naive", name="Seasonal Naive", family="Baseline", task="time_series", min_rows=10, max_rows=None, speed="fast",
        handles_missing=False, handles_high_cardinality=False, interpretable=True,
    ),
    Algorithm(
        id="ml_lag_rf", name="Random Forest on Lags", family="ML", task="time_series", min_rows=10, max_rows=None, speed="medium",
        handles_missing=False, handles_high_cardinality=False, interpretable=False,
    ),
    Algorithm(
        id="ml_lag_xgb", name="XGBoost on Lags", family="ML", task="time_series", min_rows=10, max_rows=None, speed="medium",
        handles_missing=False, handles_high_cardinality=False, interpretable=False,
    ),
    Algorithm(
        id="ml_lag_lgb", name="LightGBM on Lags", family="ML", task="time_series", min_rows=10, max_rows=None, speed="fast",
        handles_missing=False, handles_high_cardinality=False, interpretable=False,
    ),
    Algorithm(
        id="arima", name="ARIMA", family="Statistical", task="time_series", min_rows=10, max_rows=None, speed="medium",
        handles_missing=False, handles_high_cardinality=False, interpretable=True,
    ),
    Algorithm(
        id="sarima", name="SARIMA", family="Statistical", task="time_series", min_rows=10, max_rows=None, speed="slow",
        handles_missing=False, handles_high_cardinality=False, interpretable=True,
    ),
    Algorithm(
        id="holt_winters", name="Holt-Winters", family="Statistical", task="time_series", min_rows=10, max_rows=None, speed="fast",
        handles_missing=False, handles_high_cardinality=False, interpretable=True,
    ),
    Algorithm(
        id="prophet", name="Prophet", family="Statistical", task="time_series", min_rows=10, max_rows=None, speed="slow",
        handles_missing=True, handles_high_cardinality=False, interpretable=False,
    ),
    Algorithm(
        id="kmeans", name="K-Means", family="Partition", task="clustering", min_rows=10, max_rows=None, speed="fast",
        handles_missing=False, handles_high_cardinality=False, interpretable=False,
    ),
    Algorithm(
        id="minibatch_kmeans", name="MiniBatch KMeans", family="Partition", task="clustering", min_rows=5000, max_rows=None, speed="fast",
        handles_missing=False, handles_high_cardinality=False, interpretable=False,
    ),
    Algorithm(
        id="dbscan", name="DBSCAN", family="Density", task="clustering", min_rows=10, max_rows=50000, speed="medium",
        handles_missing=False, handles_high_cardinality=False, interpretable=False,
    ),
    Algorithm(
        id="agglomerative", name="Agglomerative Clustering", family="Hierarchical", task="clustering", min_rows=10, max_rows=10000, speed="slow",
        handles_missing=False, handles_high_cardinality=False, interpretable=False,
    ),
    Algorithm(
        id="spectral", name="Spectral Clustering", family="Graph", task="clustering", min_rows=10, max_rows=5000, speed="slow",
        handles_missing=False, handles_high_cardinality=False, interpretable=False,
    ),
    Algorithm(
        id="gmm", name="Gaussian Mixture", family="Probabilistic", task="clustering", min_rows=10, max_rows=None, speed="medium",
        handles_missing=False, handles_high_cardinality=False, interpretable=False,
    ),
    Algorithm(
        id="hdbscan", name="HDBSCAN", family="Density", task="clustering", min_rows=10, max_rows=None, speed="medium",
        handles_missing=False, handles_high_cardinality=False, interpretable=False,
    ),
    Algorithm(
        id="isolation_forest", name="Isolation Forest", family="Ensemble", task="anomaly", min_rows=10, max_rows=None, speed="fast",
        handles_missing=False, handles_high_cardinality=False, interpretable=False,
    ),
    Algorithm(
        id="local_outlier_factor", name="Local Outlier Factor", family="Density", task="anomaly", min_rows=10, max_rows=50000, speed="medium",
        handles_missing=False, handles_high_cardinality=False, interpretable=False,
    ),
    Algorithm(
        id="one_class_svm", name="One-Class SVM", family="SVM", task="anomaly", min_rows=10, max_rows=10000, speed="slow",
        handles_missing=False, handles_high_cardinality=False, interpretable=False,
    ),
    Algorithm(
        id="elliptic_envelope", name="Elliptic Envelope", family="Statistical", task="anomaly", min_rows=10, max_rows=None, speed="fast",
        handles_missing=False, handles_high_cardinality=False, interpretable=False,
    ),
    Algorithm(
        id="pca", name="PCA", family="Linear", task="dim_reduction", min_rows=10, max_rows=None, speed="fast",
        handles_missing=False, handles_high_cardinality=False, interpretable=True,
    ),
    Algorithm(
        id="truncated_svd", name="Truncated SVD", family="Linear", task="dim_reduction", min_rows=10, max_rows=None, speed="fast",
        handles_missing=False, handles_high_cardinality=False, interpretable=False,
    ),
]

# Listed for rules and rankings, but not trainable here.
NOT_TRAINABLE = ["svr_rbf", "svc_rbf", "one_class_svm", "agglomerative", "hdbscan", "mlp_reg", "sarima", "prophet"]

# Tree ensembles that start with a bonus, and linear text models.
CHAMPIONS = [
    "xgboost_clf",
    "xgboost_reg",
    "lightgbm_clf",
    "lightgbm_reg",
    "catboost_clf",
    "catboost_reg",
    "hist_gb_clf",
    "hist_gb_reg",
    "random_forest_clf",
    "random_forest_reg",
]
TEXT_FRIENDLY = ["multinomial_nb", "linear_svc", "logistic_regression"]


def algorithm(algo_id: str) -> dict | None:
    return next((a._asdict() for a in ALGORITHMS if a.id == algo_id), None)


def chart_catalog(spark: SparkSession) -> DataFrame:
    """(chart_id, chart_title, needs): ``needs`` is an array of spec keys."""
    return small_frame(spark, [tuple(c) for c in CHARTS], "chart_id string, chart_title string, needs array<string>")


def algorithm_catalog(spark: SparkSession, trainable_only: bool = False) -> DataFrame:
    """One row per algorithm in listing order (``place``)."""
    rows = [(i, *a) for i, a in enumerate(ALGORITHMS) if not (trainable_only and a.id in NOT_TRAINABLE)]
    return small_frame(
        spark,
        rows,
        "place int, id string, name string, family string, task string, min_rows bigint, max_rows bigint, "
        "speed string, handles_missing boolean, handles_high_cardinality boolean, interpretable boolean",
    )
