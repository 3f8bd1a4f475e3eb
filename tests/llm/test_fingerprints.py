"""Multiset hashes: order, insertion, deletion, likeness, and the ring of next documents."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from gridmill.llm import fingerprints as fp


def vectors(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    return {r.i: r for r in fp.fingerprint(df).collect()}


def test_order_does_not_matter_and_content_does(spark):
    got = vectors(spark, ["one two three four\nfive six\nfive six", "five six\none two three four\n\nfive six\n", "five six\none two three four", "one two three", None, "", " \n"])
    assert got[0].fingerprint == got[1].fingerprint != got[2].fingerprint
    assert len(got[0].fingerprint) == 8 * (fp.EXACT + 1 + fp.SIGNS)
    assert got[4].fingerprint == got[5].fingerprint == got[6].fingerprint == "0" * len(got[0].fingerprint)


def test_insertion_and_deletion(spark):
    rnd = random.Random(1)
    paragraphs = [" ".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 40))) for _ in range(12)]
    got = vectors(spark, ["\n".join(paragraphs), "\n".join(paragraphs[:7]), "\n".join(paragraphs[7:])])
    row = spark.createDataFrame([(got[0].vector, got[1].vector, got[2].vector)], "a array<long>, b array<long>, c array<long>")
    same = row.select(fp.added(F.col("b"), F.col("c")) == F.col("a"), fp.removed(F.col("a"), F.col("c")) == F.col("b")).first()
    assert tuple(same) == (True, True)


def test_slices_do_not_change_the_sum(spark, monkeypatch):
    text = " ".join(str(i % 97) for i in range(1000))
    whole = vectors(spark, [text])[0].fingerprint
    monkeypatch.setattr(fp, "SLICE", 17)
    assert vectors(spark, [text])[0].fingerprint == whole


def test_likeness_follows_what_is_shared(spark):
    rnd = random.Random(5)
    words = lambda n: [f"w{rnd.randint(0, 10**6)}" for _ in range(n)]
    base = words(2000)
    got = vectors(spark, [" ".join(base), " ".join(base[:1000] + words(1000)), " ".join(words(2000)), " ".join(base[:1900] + words(100))])
    rows = spark.createDataFrame([(i, got[0].vector, got[i].vector) for i in range(4)], "i int, a array<long>, b array<long>")
    near = {r.i: r.n for r in rows.select("i", fp.likeness(F.col("a"), F.col("b")).alias("n")).collect()}
    assert near[0] == 1 and near[1] == pytest.approx(0.5, abs=0.3) and near[2] < 0.35 and near[3] > 0.8


def test_a_line_repeated_often_does_not_wrap_a_lane(spark):
    line = "one two three"
    got = vectors(spark, ["\n".join([line] * n) for n in (20_000, 40_000, 60_000)] + ["four five six"])
    assert {min(x, (1 << 32) - x) for x in got[2].vector[-fp.SIGNS :]} == {60_000}
    rows = spark.createDataFrame([(i, got[0].vector, got[i].vector) for i in (1, 2, 3)], "i int, a array<long>, b array<long>")
    near = {r.i: r.n for r in rows.select("i", fp.likeness(F.col("a"), F.col("b")).alias("n")).collect()}
    assert near[1] == pytest.approx(1) and near[2] == pytest.approx(1) and near[3] < 0.5
    summed = rows.filter("i = 1").select(fp.added(F.col("a"), F.col("b")).alias("s"), fp.removed(F.col("b"), F.col("a")).alias("d")).first()
    assert (summed.s, summed.d) == (got[2].vector, got[0].vector)


def lanes(fingerprint):
    return [int(fingerprint[i : i + 8], 16) for i in range(0, len(fingerprint), 8)]


def likeness_by_hand(a, b):
    """From the printed forms alone."""
    if a == b:
        return 1.0
    u, v = ([x - (1 << 32) if x >= 1 << 31 else x for x in lanes(f)[-fp.SIGNS :]] for f in (a, b))
    dot = lambda x, y: float(sum(p * q for p, q in zip(x, y, strict=True)))
    scale = (dot(u, u) * dot(v, v)) ** 0.5
    return max(0.0, min(1.0, dot(u, v) / scale)) if scale else 0.0


def test_printed_forms_give_the_likeness(spark):
    rnd = random.Random(9)
    docs = [(i, "\n".join(" ".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(1, 30))) for _ in range(rnd.randint(0, 9)))) for i in range(40)]
    docs += [(100, "again " * 100_000), (101, "again " * 70_000 + "and then some words"), (102, "other " * 100_000), (103, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r for r in fp.edited_fingerprints(df).collect()}
    order = sorted(got)
    for i, key in enumerate(order):
        r, after = got[key], got[order[(i + 1) % len(order)]]
        assert r.near_edited == pytest.approx(likeness_by_hand(r.fingerprint, r.edited_fingerprint), abs=1e-9)
        assert r.near_next == pytest.approx(likeness_by_hand(r.fingerprint, after.fingerprint), abs=1e-9)
    assert got[100].near_next > 0.95 and got[101].near_next < 0.5
    assert {min(x, (1 << 32) - x) for x in lanes(got[100].fingerprint)[-fp.SIGNS :]} == {99_998}
    forms = spark.createDataFrame([(r.fingerprint,) for r in got.values()], "f string")
    assert forms.select((fp.printed(fp.parsed(F.col("f"))) == F.col("f")).alias("same")).distinct().collect() == [(True,)]


def by_hand(docs):
    """(n_chars, sha256 of the edited text) by document, for distinct non-null ids."""
    order = sorted(docs, key=lambda d: (d[0] is None, d[0] or 0))
    out = {}
    for i, (key, text) in enumerate(order):
        text, after = text or "", order[(i + 1) % len(order)][1] or ""
        half = len(text) // 2
        out[key] = (len(text), hashlib.sha256((text[: len(text) - half] + after[:half]).encode()).hexdigest())
    return out


def test_edited_texts(spark):
    rnd = random.Random(2)
    docs = [(rnd.randint(-(10**12), 10**12), "".join(rnd.choice("ab é😀\n") for _ in range(rnd.randint(0, 50)))) for _ in range(300)]
    docs += [(5, None), (6, ""), (7, "x" * 200_001), (None, "no key")]
    df = spark.createDataFrame([(*d, 1, "v") for d in docs], "doc_id long, text string, k1 int, vector string")
    out = fp.edited_fingerprints(df.repartition(6)).collect()
    assert {r.doc_id: (r.n_chars, r.edited_sha256) for r in out} == by_hand(docs)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in out)


def test_equal_texts_repeated_rows_and_edges(spark):
    df = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (2, "a b c d"), (2, "other")], "doc_id long, text string")
    out = fp.edited_fingerprints(df).collect()
    assert len(out) == 4 and len({r.fingerprint for r in out if r.n_chars == 7}) == 1
    lone = fp.edited_fingerprints(spark.createDataFrame([(1, "abcd")], "doc_id long, text string")).first()
    assert lone.edited_sha256 == hashlib.sha256(b"abab").hexdigest() and lone.near_next == 1
    assert fp.edited_fingerprints(df.limit(0)).count() == 0
    named = fp.fingerprint(spark.createDataFrame([("t", 1, 2)], "text string, vector int, _hashes int"))
    assert named.columns == ["text", "_hashes", "vector", "fingerprint"]


def test_no_python_in_the_plan(spark, sf):
    df = fp.edited_fingerprints(spark.read.parquet(f"{sf}/documents.parquet"))
    plan = df._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
