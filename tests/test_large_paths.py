"""The paths that large inputs take, forced on small ones, against the plain ones."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from gridmill.functions import positions, quantiles
from gridmill.operators import kpi, timeagg


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.RandomState(1)
    n = 6000
    pdf = pd.DataFrame(
        {
            "id": np.arange(n),
            "g": np.where(rng.rand(n) < 0.4, "hot", rng.choice(list("abcdef"), n)),
            "v": np.where(rng.rand(n) < 0.35, 7.0, np.round(rng.gamma(2, 5, n), 2)),
            "d": pd.Timestamp("2024-01-01") + pd.to_timedelta(np.where(rng.rand(n) < 0.4, 3, rng.randint(0, 90, n)), unit="D"),
        }
    )
    return pdf, spark.createDataFrame(pdf).repartition(4)


def test_column_quantiles(skewed, monkeypatch):
    pdf, df = skewed
    monkeypatch.setattr(quantiles, "SMALL_ROWS", 0)
    probs = [0.0, 0.01, 0.25, 0.5, 0.75, 0.999, 1.0]
    got = quantiles.column_quantiles(df, ["v", "id"], probs)
    for c in ("v", "id"):
        assert got[c] == pytest.approx(pdf[c].quantile(probs).tolist())


def test_grouped_quantile_with_a_hot_group(skewed, monkeypatch):
    pdf, df = skewed
    monkeypatch.setattr(quantiles, "SMALL_GROUP_ROWS", 0)
    got = {r["g"]: r["quantile"] for r in quantiles.grouped_quantile(df, ["g"], "v", 0.9).collect()}
    assert got == pytest.approx(pdf.groupby("g")["v"].quantile(0.9).to_dict())


def test_a_poor_sketch_changes_nothing(skewed, monkeypatch):
    """Brackets of a sketch that is far worse than thought miss their ranks and are opened."""
    pdf, df = skewed
    monkeypatch.setattr(quantiles, "SMALL_ROWS", 0)
    monkeypatch.setattr(quantiles, "SKETCH_SIZE", 8)
    opened = []
    reopen = quantiles._Bracket.reopen
    monkeypatch.setattr(quantiles._Bracket, "reopen", lambda self: (opened.append(self), reopen(self)))
    probs = [0.1, 0.25, 0.5, 0.75, 0.9]
    got = quantiles.column_quantiles(df, ["v", "id"], probs)
    for c in ("v", "id"):
        assert got[c] == pytest.approx(pdf[c].quantile(probs).tolist())
    assert opened


def test_wide_brackets_are_narrowed(skewed, monkeypatch):
    pdf, df = skewed
    monkeypatch.setattr(quantiles, "SMALL_ROWS", 0)
    monkeypatch.setattr(quantiles, "SKETCH_SIZE", 200)
    monkeypatch.setattr(quantiles, "SLACK", 0.06)
    monkeypatch.setattr(quantiles, "BRACKET_ROWS", 300)
    got = quantiles.column_quantiles(df, ["v", "id"], [0.1, 0.5, 0.9])
    for c in ("v", "id"):
        assert got[c] == pytest.approx(pdf[c].quantile([0.1, 0.5, 0.9]).tolist())


def test_quantiles_take_two_passes(skewed, monkeypatch):
    """No rows reach the driver or Python, and the table is read twice."""
    _, df = skewed
    monkeypatch.setattr(quantiles, "SMALL_ROWS", 0)
    seen = []
    monkeypatch.setattr(type(df), "toPandas", lambda self: pytest.fail("rows were collected"))
    monkeypatch.setattr(type(df), "mapInPandas", lambda self, *a, **k: pytest.fail("rows went to Python"))
    first, collect = type(df).first, type(df).collect
    monkeypatch.setattr(type(df), "first", lambda self: (seen.append("first"), first(self))[1])
    monkeypatch.setattr(type(df), "collect", lambda self: (seen.append("collect"), collect(self))[1])
    quantiles.column_quantiles(df, ["v", "id"], [0.25, 0.5, 0.75])
    assert seen[0] == "first" and seen.count("collect") - seen.count("first") in (0, 1) and len(seen) <= 4


def test_grouped_quantile_with_a_poor_sketch(skewed, monkeypatch):
    pdf, df = skewed
    monkeypatch.setattr(quantiles, "SMALL_GROUP_ROWS", 0)
    monkeypatch.setattr(quantiles, "GROUP_SKETCH_ACCURACY", 3)
    got = {r["g"]: r["quantile"] for r in quantiles.grouped_quantile(df, ["g"], "v", 0.3).collect()}
    assert got == pytest.approx(pdf.groupby("g")["v"].quantile(0.3).to_dict())


def test_positions_with_a_hot_key(skewed, monkeypatch):
    pdf, df = skewed
    monkeypatch.setattr(positions, "SMALL_GROUP_ROWS", 0)
    got = positions.with_position(df, ["g"], [F.col("v").asc(), F.col("id").asc()])
    want = pdf.sort_values(["v", "id"]).assign(pos=lambda x: x.groupby("g").cumcount()).set_index("id")["pos"]
    have = {r["id"]: r["pos"] for r in got.select("id", "pos").collect()}
    assert have == want.to_dict()


def test_global_positions(skewed, monkeypatch):
    pdf, df = skewed
    monkeypatch.setattr(positions, "SMALL_GROUP_ROWS", 0)
    got = positions.with_position(df, [], [F.col("d").asc(), F.col("id").desc()])
    want = pdf.sort_values(["d", "id"], ascending=[True, False])["id"].tolist()
    assert [r["id"] for r in got.orderBy("pos").collect()] == want


def test_look_back_in_blocks_equals_one_window(skewed, monkeypatch):
    _, df = skewed
    build = lambda w: {
        "lag3": F.lag("v", 3).over(w), "mean5": F.avg("v").over(w.rowsBetween(-5, -1)), "n5": F.count("v").over(w.rowsBetween(-5, -1)),
    }
    order = [F.col("d").asc(), F.col("id").asc()]
    w = Window.partitionBy("g").orderBy(*order)
    want = {r["id"]: (r["lag3"], r["mean5"], r["n5"]) for r in df.withColumns(build(w)).collect()}
    monkeypatch.setattr(positions, "SMALL_GROUP_ROWS", 0)
    monkeypatch.setattr(positions, "BLOCK_ROWS", 50)
    got = positions.look_back(df, ["g"], order, 5, build)
    for r in got.collect():
        a, b, n = want[r["id"]]
        assert (r["lag3"], r["n5"]) == (a, n) and (r["mean5"] == pytest.approx(b) if b is not None else r["mean5"] is None)


def test_running_total_in_blocks(skewed, monkeypatch):
    pdf, df = skewed
    monkeypatch.setattr(positions, "SMALL_GROUP_ROWS", 0)
    monkeypatch.setattr(positions, "BLOCK_ROWS", 100)
    got = {r["id"]: r["running"] for r in positions.running_total(df.select("id", "v"), F.col("id"), "v").collect()}
    assert got == pytest.approx(pdf.set_index("id")["v"].cumsum().to_dict())


@pytest.mark.parametrize("small", [10**9, 0])
def test_period_growth_with_a_hot_date(skewed, monkeypatch, small):
    pdf, df = skewed
    monkeypatch.setattr(kpi, "SMALL_ROWS", small)
    ordered = pdf.sort_values(["d", "id"])
    mid = len(ordered) // 2
    a, b = ordered.iloc[:mid]["v"].sum(), ordered.iloc[mid:]["v"].sum()
    got = kpi.period_growth(df, "d", "v", "id").first()
    assert (got["first_half"], got["second_half"]) == pytest.approx((a, b))
    assert got["growth_pct"] == pytest.approx(round((b - a) / a * 100, 2))


def test_prepare_time_series_large(skewed, monkeypatch):
    _, df = skewed
    want = timeagg.prepare_time_series(df, "d", "v", by=["g"], tiebreak="id").orderBy("id").toPandas()
    monkeypatch.setattr(positions, "SMALL_GROUP_ROWS", 0)
    monkeypatch.setattr(positions, "BLOCK_ROWS", 64)
    got = timeagg.prepare_time_series(df, "d", "v", by=["g"], tiebreak="id").orderBy("id").toPandas()
    pd.testing.assert_frame_equal(got[want.columns], want)


@pytest.mark.parametrize("tiebreak", [True, False])
@pytest.mark.parametrize("case", ["one date", "two dates", "nulls", "empty"])
def test_period_growth_is_the_same_at_every_size(spark, monkeypatch, case, tiebreak):
    rng = np.random.RandomState(5)
    n = 0 if case == "empty" else 401
    days = np.where(rng.rand(n) < 0.6, 1, 2) if case == "two dates" else np.ones(n)
    values = rng.choice([1.0, 2.0, 5.0, np.nan], n)
    rows = [
        (f"2024-01-0{int(d)}", None if case == "nulls" and rng.rand() < 0.3 else float(v), None if case == "nulls" and rng.rand() < 0.5 else int(rng.randint(3)))
        for d, v in zip(days, values)
    ]
    df = spark.createDataFrame(rows, "d string, v double, t int").withColumn("d", F.to_date("d"))
    got = []
    for small in (10**9, 0):
        monkeypatch.setattr(kpi, "SMALL_ROWS", small)
        got.append(tuple(kpi.period_growth(df, "d", "v", "t" if tiebreak else None).first()))
    assert got[0] == got[1]


def test_quantiles_pass_over_nan_at_every_size(spark, monkeypatch):
    values = [float("nan") if i % 7 == 0 else None if i % 11 == 0 else float(i % 50) for i in range(900)]
    df = spark.createDataFrame([("hot", v) for v in values], "g string, v double")
    want = pd.Series([v for v in values if v is not None]).quantile([0.1, 0.5, 0.99, 1.0]).tolist()
    for small in (10**9, 0):
        monkeypatch.setattr(quantiles, "SMALL_ROWS", small)
        monkeypatch.setattr(quantiles, "SMALL_GROUP_ROWS", small)
        assert quantiles.column_quantiles(df, ["v"], [0.1, 0.5, 0.99, 1.0])["v"] == pytest.approx(want)
        assert quantiles.grouped_quantile(df, ["g"], "v", 0.5).first()["quantile"] == pytest.approx(want[1])
