"""Histogram trees against plain recursion on the same bins."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from gridmill.ml import histtrees as ht


def data(n=240, classes=3, seed=1):
    rng = np.random.RandomState(seed)
    y = rng.randint(0, classes, n)
    x = np.round(rng.normal(size=(n, 3)) + 1.5 * np.array([y, -y, y % 2]).T, 1)
    x[rng.rand(n, 3) < 0.1] = np.nan
    return x, y.astype(float)


def frame(spark, x, y):
    pdf = pd.DataFrame({"v": list(x), "label": y, "id": np.arange(len(y))})
    known = F.transform("v", lambda v: F.coalesce(v, F.lit(float("nan"))))  # a missing value arrives as null
    return spark.createDataFrame(pdf).select("id", "label", array_to_vector(known).alias("features")).repartition(3)


def plain_tree(cells, h, g, depth, min_rows=1):
    """Leaf value of each row; ``g`` has one column for each target."""
    def score(rows):
        return (g[rows].sum(axis=0) ** 2).sum() / max(h[rows].sum(), 1e-300)

    def walk(rows, left):
        best, parts = (1e-12 * max(1.0, h[rows].sum()), 0, 0), None
        if left:
            for f in range(cells.shape[1]):
                column = cells[rows, f]
                gone = column == ht.MISSING
                for with_missing in ((True, False) if gone.any() else (False,)):
                    for cut in range(ht.BINS):
                        low = np.where(gone, with_missing, column <= cut)
                        if min(low.sum(), (~low).sum()) < min_rows:
                            continue
                        gain = score(rows[low]) + score(rows[~low]) - score(rows)
                        if gain > best[0] + 1e-9:
                            best, parts = (gain, f, cut), (rows[low], rows[~low])
        if parts is None:
            out[rows] = g[rows].sum(axis=0) / max(h[rows].sum(), 1e-300)
            return
        for p in parts:
            walk(p, left - 1)

    out = np.zeros((len(cells), g.shape[1]))
    walk(np.arange(len(cells)), depth)
    return out


def predictions(model, df):
    rows = model.transform(df).orderBy("id")
    return np.array([r["prediction"] for r in rows.select("prediction").collect()])


def test_boosting_of_numbers(spark):
    x, _ = data()
    y = np.nan_to_num(x[:, 0]) * 2 - np.nan_to_num(x[:, 1], nan=3.0)
    df = frame(spark, x, y)
    (model,) = ht.fit_boosted([df], 0, rounds=4, depth=3, rate=0.5, min_rows=5)
    cells, raw = ht.binned_matrix(x, model.edges), np.full(len(y), y.mean())
    for _ in range(4):
        raw = raw + 0.5 * plain_tree(cells, np.ones(len(y)), (y - raw)[:, None], 3, 5)[:, 0]
    assert np.allclose(predictions(model, df), raw)


@pytest.mark.parametrize("classes", [2, 3])
def test_boosting_of_classes(spark, classes):
    x, y = data(classes=classes, seed=classes)
    df = frame(spark, x, y)
    (model,) = ht.fit_boosted([df], classes, rounds=3, depth=2, rate=0.3, min_rows=3)
    cells = ht.binned_matrix(x, model.edges)
    if classes == 2:
        raw = np.full(len(y), np.log(y.mean() / (1 - y.mean())))
        for _ in range(3):
            p = 1 / (1 + np.exp(-raw))
            raw = raw + 0.3 * plain_tree(cells, p * (1 - p), (y - p)[:, None], 2, 3)[:, 0]
        chances = np.column_stack([1 - 1 / (1 + np.exp(-raw)), 1 / (1 + np.exp(-raw))])
    else:
        raw = np.tile(np.log([(y == k).mean() for k in range(classes)]), (len(y), 1))
        for _ in range(3):
            p = ht._softmax(raw)
            raw = raw + 0.3 * np.column_stack([plain_tree(cells, p[:, k] * (1 - p[:, k]), ((y == k) - p[:, k])[:, None], 2, 3)[:, 0] for k in range(classes)])
        chances = ht._softmax(raw)
    rows = model.transform(df).orderBy("id").select("prediction", "probability").collect()
    assert np.allclose(np.array([r["probability"] for r in rows]), chances)
    assert [r["prediction"] for r in rows] == chances.argmax(axis=1).tolist()


def samme(cells, y, classes, rounds, depth):
    w, score = np.ones(len(y)), np.zeros((len(y), classes))
    for _ in range(rounds):
        found = plain_tree(cells, w, w[:, None] * (y[:, None] == np.arange(classes)), depth).argmax(axis=1)
        err = w[found != y].sum() / w.sum()
        if err >= 1 - 1 / classes:
            break
        vote = np.log((1 - err) / err) + np.log(classes - 1) if err > 0 else 1.0
        score[np.arange(len(y)), found] += vote
        if err <= 0:
            break
        w = w * np.exp(vote * (found != y))
    return score


def test_adaboost(spark, monkeypatch):
    x, y = data(n=150)
    df = frame(spark, x, y)
    monkeypatch.setattr(ht, "HOLD", 3)  # states are stored twice on the way
    (model,) = ht.fit_adaboost_classifier([df], 3, rounds=8)
    want = samme(ht.binned_matrix(x, model.edges), y, 3, 8, 1)
    assert np.allclose(model.scores(x), want / want.sum(axis=1, keepdims=True))
    number = np.nan_to_num(x[:, 0]) + np.arange(len(y)) % 7
    rows = frame(spark, x, number)
    (model,) = ht.fit_adaboost_regressor([rows], rounds=8, depth=2)
    cells, w, each, votes = ht.binned_matrix(x, model.edges), np.ones(len(y)), [], []
    for _ in range(8):
        p = plain_tree(cells, w, (w * number)[:, None], 2)[:, 0]
        loss = np.abs(p - number) / np.abs(p - number).max()
        mean = (w * loss).sum() / w.sum()
        if mean >= 0.5:
            break
        each.append(p)
        votes.append(np.log((1 - mean) / mean))
        w = w * (mean / (1 - mean)) ** (1 - loss)
    assert np.allclose(predictions(model, rows), ht._weighted_median(np.column_stack(each), np.array(votes)))


def test_fits_together_are_fits_alone(spark, monkeypatch):
    parts = [data(seed=s, n=80 + 20 * s) for s in (1, 2, 3)]
    tables = [frame(spark, *p) for p in parts]
    monkeypatch.setattr(ht, "PASS_BYTES", 1)  # one node a pass
    for fit in (lambda t: ht.fit_boosted(t, 3, 3, 2, min_rows=2), lambda t: ht.fit_adaboost_classifier(t, 3, 4), lambda t: ht.fit_adaboost_regressor(t, 3, 2)):
        together = fit(tables)
        for model, table, (x, _) in zip(together, tables, parts, strict=True):
            assert np.allclose(model.scores(x), fit([table])[0].scores(x))


def test_stored_models_and_importances(spark, tmp_path):
    x, y = data()
    df = frame(spark, x, y)
    for i, model in enumerate((ht.fit_boosted([df], 3, 2, 2)[0], ht.fit_adaboost_classifier([df], 3, 2)[0], ht.fit_adaboost_regressor([df], 2)[0])):
        model.save(f"{tmp_path}/{i}")
        assert np.allclose(ht.HistModel.load(f"{tmp_path}/{i}").scores(x), model.scores(x))
        assert model.featureImportances.toArray().sum() == pytest.approx(1)


def test_perfect_and_useless_features(spark):
    x = np.array([[0.0, 5.0], [0.0, 5.0], [1.0, 5.0], [np.nan, 5.0]] * 10)
    y = np.array([0.0, 0.0, 1.0, 1.0] * 10)
    df = frame(spark, x, y)
    (model,) = ht.fit_adaboost_classifier([df], 2, rounds=5)
    assert len(model.rounds) == 1 and predictions(model, df).tolist() == y.tolist()
    same = frame(spark, x[:, 1:], y)
    for model in (ht.fit_adaboost_classifier([same], 2, 5)[0], ht.fit_boosted([same], 2, 3)[0], ht.fit_adaboost_regressor([same], 5)[0]):
        assert len(set(predictions(model, same))) == 1


def test_bin_edges_share_one_list_of_quantiles(spark, monkeypatch):
    """Bins of many features are cut without a literal for each quantile of each feature."""
    df = spark.range(600).select(array_to_vector(F.array(*[(F.col("id") * (i + 1)).cast("double") for i in range(6)])).alias("features"))
    made, real = [], F.lit
    monkeypatch.setattr(F, "lit", lambda v: made.append(v) or real(v))
    given, quantiles = [], F.percentile_approx
    monkeypatch.setattr(F, "percentile_approx", lambda c, p, a: given.append(p) or quantiles(c, p, a))
    edges = ht.bin_edges(df, 6)
    assert len({id(p) for p in given}) == 1 and not isinstance(given[0], list) and len(made) < 50
    assert edges[1] == [2 * v for v in edges[0]] and len(edges[0]) == ht.BINS - 1


def test_tree_walks_like_its_nodes():
    """A tree with branches of unequal depth, missing values to either side, and cuts at the ends of a byte."""
    t = ht.Tree()
    for _ in range(7):
        t.add([0.0], 1.0)
    t.feature[0], t.cut[0], t.missing_left[0], t.left[0], t.right[0] = 1, 0, False, 1, 2
    t.feature[2], t.cut[2], t.missing_left[2], t.left[2], t.right[2] = 0, 254, True, 3, 4
    t.feature[3], t.cut[3], t.missing_left[3], t.left[3], t.right[3] = 2, 7, False, 5, 6
    cells = np.array([[a, b, c] for a in (0, 254, 255) for b in (0, 1, 255) for c in (7, 8, 255)], np.uint8)

    def walked(row, node=0):
        while (f := t.feature[node]) >= 0:
            left = t.missing_left[node] if row[f] == ht.MISSING else row[f] <= t.cut[node]
            node = t.left[node] if left else t.right[node]
        return node

    assert t.nodes_of(cells).tolist() == [walked(r) for r in cells.tolist()]


def test_a_round_reads_only_its_own_trees(spark, monkeypatch):
    """What earlier rounds found is read from the rows, so a level does not walk their trees again."""
    walked, real = [], ht.grow

    def grow(rows, stats, *args, **options):
        seen = [c.cell_contents for c in stats.__closure__ or ()] + list(stats.__defaults__ or ())
        walked.append("Tree(" in repr(seen))
        return real(rows, stats, *args, **options)

    monkeypatch.setattr(ht, "grow", grow)
    df = spark.range(60).select(array_to_vector(F.array(F.col("id").cast("double"))).alias("features"), (F.col("id") % 7).cast("double").alias("label"))
    (model,) = ht.fit_boosted([df], 0, rounds=3, depth=2, min_rows=1)
    assert len(model.rounds) == 3 and not any(walked)
    x = np.arange(60.0)[:, None]
    assert ((model.scores(x)[:, 0] - x[:, 0] % 7) ** 2).mean() < ((x[:, 0] % 7 - (x[:, 0] % 7).mean()) ** 2).mean()


def test_passes_use_the_cores(spark, monkeypatch):
    """All rows in one small file, and the cuts of many nodes, used to be one task each."""
    monkeypatch.setattr(ht, "ROWS_IN_TASK", 100)
    assert [ht._tasks(spark.range(1), n, 250) for n in (10, 251, 10**6)] == [1, 2, spark.sparkContext.defaultParallelism]
    table = ht.stored(spark.range(0, 350, 1, 1).withColumn("fit", F.lit(0)), "binned-rows")
    assert table.rdd.getNumPartitions() == 1
    rows = ht._Rows(table)
    assert rows.table.rdd.getNumPartitions() == 4 and rows.table.distinct().count() == 350
    rows.close()


def test_levels_read_blocks_of_rows(spark, monkeypatch):
    """A level hands blocks of bytes to its tasks, not a row for each row and fit."""
    monkeypatch.setattr(ht, "ROWS_IN_BLOCK", 70)
    x, y = data(n=300)
    tables = [frame(spark, x, y).coalesce(1), frame(spark, x[:90], y[:90]).coalesce(1)]
    rows = ht._Rows(ht.stacked(tables, ht._edges(tables), [[0.0], [1.0]]))
    rows.move(lambda fit, cells, label, state: state + label[:, None])
    found = rows.table.collect()
    assert len(found) <= 10 and {f: sum(r["n"] for r in found if r["fit"] == f) for f in (0, 1)} == {0: 300, 1: 90}
    for r in found:
        assert np.allclose(np.frombuffer(r["state"]), r["fit"] + np.frombuffer(r["label"]))
        assert len(r["bins"]) == r["n"] * x.shape[1] and len(set(np.frombuffer(r["row"], np.int64))) == r["n"]
    rows.close()
