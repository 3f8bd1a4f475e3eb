"""Quality rules, language identification and toxicity: learned from labels, tested on rows held out."""

import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridmill.llm import language_id as li
from gridmill.llm import quality_rules as qr
from gridmill.llm import toxicity as tx
from gridmill.llm.common import KEY_TEXTS, WORD
from gridmill.llm.queries import op1, op2, op4

WIDE = "/root/testdata/sf0.01"


# --- quality rules ------------------------------------------------------------

def base_by_hand(text):
    words = re.findall(WORD, text or "")
    windows = {}
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {j for at in windows.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(WORD, line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), dup, len(covered)


def test_statistics_by_hand(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in op1(spark, sf).collect():
        n, chars, symbols, dup, rep = base_by_hand(docs[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, rep)
        assert r.base_failed == (n < 20 or 100 * rep > 30 * n) and not (r.base_failed and r.kept)


@pytest.mark.parametrize("text", ["a " * 40, "x y z " * 5 + "q " * 9, "\n".join(["a a a a a a a a b"] * 3), "one", "a\x85b c\xa0d　e"])
def test_repeated_windows(text):
    assert qr.statistics(text)[:5] == base_by_hand(text)


def test_rules_separate_what_conditions_can():
    rng = np.random.default_rng(1)
    x = rng.random((3000, 3))
    bad = ((x[:, 0] > 0.7) & (x[:, 1] <= 0.4)) | (x[:, 2] > 0.95)
    found = qr.learn(x, bad, ["a", "b", "c"])
    test = rng.random((2000, 3))
    truth = ((test[:, 0] > 0.7) & (test[:, 1] <= 0.4)) | (test[:, 2] > 0.95)
    called = np.zeros(2000, bool)
    for rule in found.rules:
        called |= rule.covers(test, ["a", "b", "c"])
    assert (called == truth).mean() > 0.97 and 2 <= len(found.rules) <= 8
    assert qr.learn(x, np.zeros(3000, bool), ["a", "b", "c"]).rules == ()
    assert qr.learn(np.empty((0, 3)), np.empty(0, bool), ["a", "b", "c"]).rules == ()


def test_expression_agrees_with_the_rules(spark):
    rules = qr.DecisionList((qr.Rule((qr.Condition("words", False, 30.0), qr.Condition("symbols_per_word", True, 0.5))), qr.Rule((qr.Condition("upper_word_share", True, 0.9),))))
    df = spark.createDataFrame([(1, "a# " * 25), (2, "A " * 10 + "Bc " * 3 + "D " * 40), (3, "A B C " * 0 + "Z" * 9 + " Q" * 60), (4, "plain words " * 1)], "doc_id long, text string")
    got = {r.doc_id: r.rule for r in qr.judged(df, rules).collect()}
    assert got[1] == str(rules.rules[0]) and got[2] == str(rules.rules[1]) and got[3] == str(rules.rules[1]) and got[4] is None


def test_quality_edges(spark):
    rows = [(1, None, 5), (2, "", 5), (2, "", 5), (3, " ".join(map(str, range(30_000))), 5), (None, "few words", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words int")
    labels = spark.createDataFrame([(1, None), (None, 0), (3, 1), (3, 0)], "doc_id long, quality int")
    rules = qr.fit(df, labels)
    out = {(r.doc_id, r.n_words, r.base_failed, r.kept) for r in qr.judged(df, rules).collect()}
    assert out == {(1, 0, True, False), (2, 0, True, False), (3, 30_000, False, True), (None, 2, True, False)}
    left = qr.passing(df, rules)
    assert left.columns == df.columns and [tuple(r)[0::2] for r in left.collect()] == [(3, 5)]
    assert qr.judged(df.limit(0), rules).count() == 0 and qr.fit(df.limit(0), labels.limit(0)).rules == ()


def test_quality_on_labelled_documents(spark):
    labels = spark.read.parquet(f"{WIDE}/labels.parquet")
    half = labels.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0)
    docs = spark.read.parquet(f"{WIDE}/documents.parquet")
    rules = qr.fit(docs, half)
    held = qr.judged(docs, rules, keep_text=False).join(labels.join(half, "doc_id", "left_anti"), "doc_id").filter("NOT base_failed").collect()
    good = [r for r in held if r.quality == 1]
    bad = [r for r in held if r.quality == 0]
    assert sum(r.kept for r in good) >= 0.98 * len(good) and sum(not r.kept for r in bad) >= 0.8 * len(bad)


# --- language ----------------------------------------------------------------

def test_held_out_languages(spark):
    rows = op2(spark, WIDE).join(spark.read.parquet(f"{WIDE}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert len(held) > 100 and sum(r.lang_pred == r.lang for r in held) >= 0.97 * len(held)


def test_blocks_do_not_change_the_counts(monkeypatch):
    text = "Äbc  déf, 12 ghi!\n" * 30
    whole = np.sort(np.concatenate(list(li.buckets(text))))
    monkeypatch.setattr(li, "BLOCK", 7)
    assert (np.sort(np.concatenate(list(li.buckets(text)))) == whole).all()


def test_language_edges(spark):
    rows = [(1, "le chat noir", "fr", 0.0), (2, "the black cat", "en", 0.0), (3, None, "en", 0.0), (4, "123 !", None, 0.0), (5, "THE cat", None, 0.0), (5, "THE cat", None, 0.0), (6, "", "fr", 0.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    model = li.fit(df)
    assert model.languages == ("en", "fr")
    got = sorted((r.doc_id, r.lang_pred) for r in li.predict(df, model).collect())
    assert got == [(1, "fr"), (2, "en"), (3, "und"), (4, "und"), (5, "en"), (5, "en"), (6, "und")]
    assert model.predict("le chat " * 200_000)[0] == "fr"
    empty = li.fit(df.filter("lang = 'x'"))
    assert empty.languages == () and {tuple(r)[-2:] for r in li.predict(df, empty).select("lang_pred", "score").collect()} == {("und", 0.0)}
    assert li.predict(df.limit(0), model).columns == ["doc_id", "text", "lang", "lang_pred", "score"]


def bayes_by_hand(train, texts, bits=li.BITS):
    """(language, probability) of each text by counting n-grams in plain loops over the same buckets."""
    counts, docs = {}, {}
    for text, lang in train:
        if lang is not None and li.has_letter(text):
            docs[lang] = docs.get(lang, 0) + 1
            own = counts.setdefault(lang, {})
            for g in (int(g) for grams in li.buckets(text, bits) for g in grams):
                own[g] = own.get(g, 0) + 1
    names, out = sorted(docs), []
    for text in texts:
        if not li.has_letter(text) or not names:
            out.append(("und", 0.0))
            continue
        grams = [int(g) for grams in li.buckets(text, bits) for g in grams]
        logs = []
        for lang in names:
            whole = sum(counts[lang].values()) + li.SMOOTHING * (1 << bits)
            logs.append(np.log(docs[lang] / sum(docs.values())) + sum(np.log((counts[lang].get(g, 0) + li.SMOOTHING) / whole) for g in grams))
        best = int(np.argmax(logs))
        out.append((names[best], float(1 / np.exp(np.array(logs) - logs[best]).sum())))
    return out


def test_languages_against_plain_counting(spark, sf, monkeypatch):
    rows = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    taught = [(t, lang) for i, t, lang in rows if zlib.crc32(str(i).encode()) % 4 != 2]
    tried = [(i, (t or "")[:400]) for i, t, _ in rows] + [(-1, None), (-2, "1 2 3"), (-3, "le")]
    want = dict(zip([i for i, _ in tried], bayes_by_hand(taught, [t for _, t in tried])))
    model = li.fit(spark.createDataFrame(taught, "text string, lang string").repartition(3))
    df = spark.createDataFrame(tried, "doc_id long, text string")
    for gathered in (li.GATHERED, 300):  # batches that end within a text
        monkeypatch.setattr(li, "GATHERED", gathered)
        names, chances = model.predict_all([t for _, t in tried])
        for (i, _), name, chance in zip(tried, names, chances, strict=True):
            assert name == want[i][0] and chance == pytest.approx(want[i][1], abs=1e-6)
    got = {r.doc_id: (r.lang_pred, r.score) for r in li.predict(df, model).collect()}
    assert {i: g[0] for i, g in got.items()} == {i: w[0] for i, w in want.items()}


# --- toxicity ----------------------------------------------------------------

def test_regression_against_plain_descent():
    rng = np.random.default_rng(2)
    dense = (rng.random((400, 12)) < 0.3).astype(float)
    y = (dense @ rng.normal(size=12) + rng.normal(size=400) * 0.3 > 0).astype(float)
    tokens, ends = np.nonzero(dense)[1], np.cumsum(dense.sum(axis=1)).astype(int)
    found = tx.regression(tx.Design(tokens, ends, [], 12), y, 0.01, rounds=200).weights
    x, w = np.column_stack([dense, np.ones(400)]), np.zeros(13)
    for _ in range(20_000):
        w -= 0.5 * (x.T @ (1 / (1 + np.exp(-x @ w)) - y) / 400 + 0.01 * np.append(w[:-1], 0))
    assert found == pytest.approx(w, abs=2e-3)


def test_a_later_category_learns_from_an_earlier_one(spark):
    rng = np.random.default_rng(3)
    rows, labels = [], []
    for i in range(900):
        rude = rng.random() < 0.3
        threat = rude and rng.random() < 0.5
        words = [f"w{k}" for k in rng.integers(0, 60, 12)] + ["rudeword"] * rude + ["threatword"] * threat
        rows.append((i, " ".join(words)))
        labels.append((i, int(rude), int(threat)))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, rude int, threat int")
    chain = tx.fit(docs, marks.filter("doc_id < 700"), {"rude": F.col("rude") == 1, "threat": F.col("threat") == 1})
    out = {r.doc_id: r for r in tx.predict(docs, chain).filter("doc_id >= 700").collect()}
    assert all((out[i].is_rude, out[i].is_threat) == (bool(a), bool(b)) for i, a, b in labels if i >= 700)
    assert chain.models[1].weights[-2] > 0  # the log-odds of the first category


def test_tokens_are_chosen_without_the_fold_that_is_scored(spark, monkeypatch):
    """Labels that follow nothing: out-of-fold probabilities must not tell them, though a token chosen with them would."""
    rng = np.random.default_rng(6)
    rows = [(i, " ".join(f"w{k}" for k in rng.integers(0, 400, 40))) for i in range(300)]
    labels = [(i, int(rng.random() < 0.5)) for i in range(300)]
    seen = []
    best = tx.best_threshold
    monkeypatch.setattr(tx, "best_threshold", lambda p, y: (seen.append((p, y)), best(p, y))[1])
    monkeypatch.setattr(tx, "MIN_CHI", 1.0)  # chance tokens get in
    tx.fit(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, odd int"), {"odd": F.col("odd") == 1})
    p, y = seen[0]
    assert abs(np.corrcoef(p, y)[0, 1]) < 0.15


def test_toxicity_edges(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "bad word " * 20_000, "x"), (3, "bad word " * 20_000, "x"), (None, "word", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, p_toxic string")
    category = {"toxic": F.col("toxic") == 1}
    for labels in ([], [(1, None)], [(3, 1)], [(1, 0), (3, 1), (3, 0), (None, 1)]):
        chain = tx.fit(df, spark.createDataFrame(labels, "doc_id long, toxic int"), category)
        out = tx.predict(df, chain)
        assert out.columns == ["doc_id", "text", "p_toxic", "is_toxic"] and out.count() == 5
        assert all(0 <= r.p_toxic <= 1 and r.is_toxic is not None for r in out.collect())
    assert tx.predict(df.limit(0), chain).count() == 0


def test_toxic_documents_held_out(spark):
    labels = spark.read.parquet(f"{WIDE}/labels.parquet")
    rows = op4(spark, WIDE).join(labels.withColumnRenamed("toxic", "truth"), "doc_id").collect()
    assert len(rows) == labels.count() and sum(r.toxic == (r.truth == 1) for r in rows) > 0.95 * len(rows)
    toxic = [r for r in rows if r.truth == 1]
    assert sum(r.toxic for r in toxic) > 0.75 * len(toxic)  # with 400 labels; README has the recall by number of labels
    half = labels.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0)
    docs = spark.read.parquet(f"{WIDE}/documents.parquet")
    chain = tx.fit(docs, half, {"low_quality": F.col("quality") == 0, "toxic": F.col("toxic") == 1})
    held = tx.predict(docs.join(labels, "doc_id").join(half, "doc_id", "left_anti"), chain).select("toxic", "is_toxic").collect()
    assert sum(bool(r.toxic) == r.is_toxic for r in held) > 0.9 * len(held)


# --- one key with many documents ----------------------------------------------

def test_a_hot_key_does_not_fill_the_sample(spark, monkeypatch):
    words = lambda i: " ".join(f"w{i}x{j}" for j in range(30))
    rows = [(i, words(i)) for i in range(200)] + [(7, words(1000 + i)) for i in range(2000)] + [(8, "same " + words(8))] * 50
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    labels = spark.createDataFrame([(i, i % 2, (i + 1) % 2) for i in range(200)], "doc_id long, quality int, toxic int")
    seen = {}
    learn, collected = qr.learn, tx.collected
    monkeypatch.setattr(qr, "learn", lambda x, *rest: (seen.update(quality=len(x)), learn(x, *rest))[1])
    monkeypatch.setattr(tx, "collected", lambda *a: seen.setdefault("toxic", collected(*a)))
    qr.fit(docs, labels)
    tx.fit(docs, labels, {"toxic": F.col("toxic") == 1})
    assert seen["quality"] == len(seen["toxic"]) == 198 + KEY_TEXTS + 2
    assert seen["toxic"]["_id"].value_counts().to_dict() == {**{i: 1 for i in range(200)}, 7: KEY_TEXTS, 8: 2}
