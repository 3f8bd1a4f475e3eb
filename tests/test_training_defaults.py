"""Training queries do the whole job: default parameters, folds and repeats."""

import inspect

import pytest

from gridmill.ml import train
from gridmill.queries import models
from gridmill.queries.models import groups


class Called(Exception):
    pass


def caught(monkeypatch, where, name):
    real = getattr(where, name)

    def stop(*args, **options):
        bound = inspect.signature(real).bind(*args, **options)
        bound.apply_defaults()
        raise Called(bound.arguments)

    monkeypatch.setattr(where, name, stop)
    return {k: p.default for k, p in inspect.signature(real).parameters.items()}


@pytest.mark.parametrize("name", ["l02_ridge", "l09_random_forest_clf", "l11_hist_gb_clf", "l25_ml_lags", "l16_logistic_regression_multiclass", "m18_permutation_importance", "m20_train", "m23_predict", "m26_model_importances", "z04_score_stream"])
def test_training_uses_defaults(spark, sf, monkeypatch, name):
    import __spark_entry__ as entry

    default = caught(monkeypatch, train, "train")
    for rows in ("labelled_documents", "parts", "order_status", "vectors_of"):
        monkeypatch.setattr(models, rows, lambda *a: None)
    with pytest.raises(Called) as call:
        entry.queries()[name](spark, sf)
    used = call.value.args[0]
    assert {k: used[k] for k in ("folds", "repeats", "test_size", "params")} == {k: default[k] for k in ("folds", "repeats", "test_size", "params")}


@pytest.mark.parametrize("query, name, of", [("l31_gaussian_mixture", "gaussian_mixture", "max_iter"), ("l32_isolation_forest", "isolation_forest", "trees")])
def test_groups_use_defaults(spark, sf, monkeypatch, query, name, of):
    import __spark_entry__ as entry

    default = caught(monkeypatch, groups, name)
    with pytest.raises(Called) as call:
        entry.queries()[query](spark, sf)
    assert call.value.args[0][of] == default[of]


@pytest.mark.parametrize("name", ["l12_adaboost_reg", "l12_adaboost_clf", "l11_hist_gb_clf", "l22_mlp_clf", "l25_ml_lags"])
def test_training_ends(spark, sf, name):
    """Default rounds, layers, trees, folds and repeats, on the smallest tables."""
    import __spark_entry__ as entry

    rows = {r.metric: r.value for r in entry.queries()[name](spark, sf).collect()}
    assert {"cv_mean", "cv_std", "n_train", "n_test"} <= set(rows) and any(m.startswith("importance_") for m in rows)
    score = rows.get("f1_weighted", rows.get("accuracy", rows.get("r2")))
    assert score is not None and score > -1
