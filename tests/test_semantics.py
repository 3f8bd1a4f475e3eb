"""Meaning of aggregates and labels, against pandas."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from conftest import rows
from pyspark.sql import functions as F

from gridmill.functions import semantics as S
from gridmill.operators import clean, kpi, profile, timeagg


@pytest.fixture(scope="module")
def numbers(spark):
    rng = np.random.RandomState(0)
    pdf = pd.DataFrame({"a": rng.gamma(2.0, 3.0, 500), "b": rng.normal(size=500), "k": 5.0})
    pdf.loc[pdf.index % 7 == 0, "a"] = np.nan
    pdf.loc[pdf.index % 11 == 0, "b"] = np.nan
    return pdf, S.fold_missing(spark.createDataFrame(pdf))


def test_moments_match_pandas(numbers):
    pdf, df = numbers
    got = {r["column"]: r for r in profile.eda_stats(df).collect()}
    for c in ("a", "b"):
        s = pdf[c].dropna()
        assert got[c]["mean"] == pytest.approx(s.mean(), abs=1e-4)
        assert got[c]["std"] == pytest.approx(s.std(), abs=1e-4)
        assert got[c]["skew"] == pytest.approx(s.skew(), abs=1e-4)
        assert got[c]["kurtosis"] == pytest.approx(s.kurtosis(), abs=1e-4)
        assert got[c]["median"] == pytest.approx(s.median(), abs=1e-4)
        assert got[c]["q1"] == pytest.approx(s.quantile(0.25), abs=1e-4)
        assert got[c]["missing"] == pdf[c].isna().sum()
        iqr = s.quantile(0.75) - s.quantile(0.25)
        out = ((s < s.quantile(0.25) - 1.5 * iqr) | (s > s.quantile(0.75) + 1.5 * iqr)).sum()
        assert got[c]["outliers"] == out


def test_correlation_over_complete_pairs(numbers):
    pdf, df = numbers
    want = pdf.corr()
    for r in profile.corr_matrix(df, ["a", "b", "k"], 6).collect():
        if "k" in (r["x"], r["y"]):
            assert r["r"] is None
        else:
            assert r["r"] == pytest.approx(want.loc[r["x"], r["y"]], abs=1e-6)


def test_pearson_expression_handles_constant_side(numbers):
    _, df = numbers
    row = df.agg(S.pearson(F.col("a"), F.col("b")).alias("ab"), S.pearson(F.col("a"), F.col("k")).alias("ak")).first()
    assert row["ak"] is None and math.isfinite(row["ab"])


def test_small_groups_have_no_shape(spark):
    df = spark.createDataFrame([(1.0,), (2.0,)], "v double")
    row = df.agg(S.skew(F.col("v")).alias("s"), S.kurt(F.col("v")).alias("k"), S.total(F.lit(None).cast("double")).alias("t")).first()
    assert row["s"] is None and row["k"] is None and row["t"] == 0.0


def test_nan_and_infinity_are_missing(spark):
    df = S.fold_missing(spark.createDataFrame([(float("nan"),), (float("inf"),), (1.0,)], "v double"))
    assert sorted((r[0] for r in df.collect()), key=str) == [1.0, None, None]


def test_week_labels_match_pandas(spark):
    days = pd.date_range("2018-12-20", "2021-01-20", freq="D")
    df = spark.createDataFrame([(d.date(), 1.0) for d in days], "d date, v double")
    got = [r["label"] for r in timeagg.time_rollups(df, "d", "v").filter("level = 'weekly'").collect()]
    want = pd.Series(1.0, index=days).resample("W").sum().index.strftime("%Y-W%W").tolist()
    assert sorted(got) == sorted(want)


def test_rollups_fill_empty_periods(spark):
    df = spark.createDataFrame([(dt.date(2024, 1, 5), 2.0), (dt.date(2024, 4, 5), 3.0), (None, 9.0)], "d date, v double")
    got = {r["label"]: r["value"] for r in timeagg.time_rollups(df, "d", "v").filter("level = 'monthly'").collect()}
    assert got == {"2024-01": 2.0, "2024-02": 0.0, "2024-03": 0.0, "2024-04": 3.0}
    means = timeagg.resample(df, "d", "v", "monthly", "mean").collect()
    assert len(means) == 2


def test_group_agg_keeps_null_key_and_breaks_ties_by_label(spark):
    df = spark.createDataFrame([("b", 1.0), ("a", 1.0), (None, 5.0), ("c", None)], "k string, v double")
    assert [tuple(r) for r in kpi.group_agg(df, "k", "v").collect()] == [(1, "nan", 5.0), (2, "a", 1.0), (3, "b", 1.0), (4, "c", 0.0)]


def test_clean_fixture(spark):
    df = spark.createDataFrame([(1.0, "x"), (None, "y"), (3.0, None)], "a double, b string")
    assert rows(clean.clean(df)) == [(1.0, "x"), (2.0, "y"), (3.0, "x")]


def test_encode_fixture(spark):
    df = spark.createDataFrame([("a",), ("b",), ("a",)], "cat string")
    assert [r[0] for r in clean.label_encode(df).collect()] == [0, 1, 0]


def test_summary_fixture(spark):
    df = spark.createDataFrame([(1.0, "a"), (2.0, "b"), (None, "c")], "x double, y string")
    assert [(r["column"], r["n_rows"], r["missing"]) for r in profile.summary(df).orderBy("ordinal").collect()] == [("x", 3, 1), ("y", 3, 0)]


def test_odd_names_and_empty_tables(spark):
    df = spark.createDataFrame([(1.0, "é"), (2.0, None)], "`Discount (%)` double, `a.b` string")
    got = {r["column"]: r for r in profile.profile_columns(df).collect()}
    assert got["Discount (%)"]["mean"] == 1.5 and got["a.b"]["top"] == "é" and got["a.b"]["missing"] == 1
    empty = df.limit(0)
    assert profile.completeness(empty).first()["completeness"] == 100.0
    assert profile.profile_columns(empty).count() == 2
    assert kpi.period_growth(spark.createDataFrame([], "d date, v double"), "d", "v").first()["growth_pct"] is None


def test_filter_accepts_only_simple_predicates(spark):
    df = spark.createDataFrame([(1, "x"), (5, "it's")], "n int, t string")
    assert clean.filter_rows(df, "n", ">= 5").count() == 1
    assert clean.filter_rows(df, "t", "== 'x'").count() == 1
    assert clean.filter_rows(df, "t", "not in ['x', 'y']").count() == 1
    assert clean.filter_rows(df, "n", "between 1 and 4").count() == 1
    for bad in ("> 1 or 1=1", "= (select 1)", "; drop", "> n"):
        with pytest.raises(clean.EditError):
            clean.filter_rows(df, "n", bad)


def test_sort_puts_nulls_last_both_ways(spark):
    df = spark.createDataFrame([(None,), (2,), (1,)], "n int")
    assert [r[0] for r in clean.sort_rows(df, "n", True).collect()] == [1, 2, None]
    assert [r[0] for r in clean.sort_rows(df, "n", False).collect()] == [2, 1, None]


def test_transform_zero_fill_extends_the_range(spark):
    df = spark.createDataFrame([(4.0,), (8.0,), (None,)], "v double")
    out = clean.transform(df, fill="zero", normalize=True)
    assert sorted(r[0] for r in out.collect()) == [0.0, 0.5, 1.0]
    constant = spark.createDataFrame([(5.0, 1), (5.0, 2)], "k double, n int")
    assert {r["k"] for r in clean.minmax(constant).collect()} == {5.0}
    assert {r["k"] for r in clean.standardize(constant).collect()} == {0.0}


def test_brackets_inside_literals_stay(spark):
    from gridmill.operators import clean

    df = spark.createDataFrame([("min[1]",), ("a[1]",), ("x",)], "s string")
    assert [r[0] for r in clean.filter_rows(df, "s", "== 'min[1]'").collect()] == ["min[1]"]
    assert {r[0] for r in clean.filter_rows(df, "s", "in ['a[1]', 'x']").collect()} == {"a[1]", "x"}


def test_roles_by_whole_words(spark):
    from gridmill.operators import typing

    catalog = typing.column_catalog(spark, {"t": spark.createDataFrame([(1.0, 2.0, "x", "y")], "wage double, discount double, updated string, stage string")})
    found = {r["role"]: r["column"] for r in typing.roles_table(catalog, whole_token=True).collect()}
    assert (found["value"], found["rate"], found["date"], found["category"]) == ("wage", "discount", "updated", "stage")
