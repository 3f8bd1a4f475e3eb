"""Mixing against plain apportionment and water filling."""

import random
import re
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from gridmill.llm import mixing
from gridmill.llm.common import WORD
from gridmill.llm.queries import op6


def seats_by_hand(votes, seats):
    won = [0] * len(votes)
    for _ in range(seats):
        best = max((i for i in range(len(votes)) if votes[i]), key=lambda i: (Fraction(votes[i]) / (2 * won[i] + 1), -i), default=None)
        if best is None:
            break
        won[best] += 1
    return won


def targets_by_hand(sizes, weights, share, times):
    left, pool, out = set(range(len(sizes))), share * sum(sizes), [0.0] * len(sizes)
    while left:
        each = pool / sum(weights[i] for i in left)
        over = [i for i in left if weights[i] * each > times * sizes[i]]
        if not over:
            for i in left:
                out[i] = weights[i] * each
            break
        for i in over:
            out[i] = times * sizes[i]
            pool -= out[i]
            left.remove(i)
    return out


def test_highest_quotients(spark):
    rnd = random.Random(2)
    rows, want = [], {}
    for g in range(60):
        votes = [rnd.choice([0, 1, 7, 7, 100, rnd.randint(1, 10_000)]) for _ in range(rnd.randint(1, 9))]
        seats = rnd.choice([0, 1, 2, 5, 40, 333])
        for i, (v, w) in enumerate(zip(votes, seats_by_hand(votes, seats))):
            rows.append((g, i, v, seats))
            want[g, i] = w
    df = spark.createDataFrame(rows, "g int, i int, votes long, seats long")
    got = {(r.g, r.i): r.quota for r in mixing.apportion(df, ["g"], "votes", "seats", ["i"]).collect()}
    assert got == want


def test_targets(spark):
    rnd = random.Random(4)
    for _ in range(6):
        sizes = {rnd.choice(["é", "z", "B", "a"]) + str(i): rnd.choice([0, 1, 50, rnd.randint(1, 5000)]) for i in range(rnd.randint(1, 9))}
        names = [*sorted(sizes), None]
        sizes[None] = 40
        weights = [mixing.WEIGHTS[i % 3] for i in range(len(names))]
        want = dict(zip(names, targets_by_hand([sizes[n] for n in names], weights, 1.5, 2)))
        df = spark.createDataFrame([(n, sizes[n]) for n in names], "source string, source_size long")
        got = {r.source: r.target for r in mixing.targets(df, "source").collect()}
        assert got == pytest.approx(want)


@pytest.fixture(scope="module")
def docs(spark):
    rnd = random.Random(1)
    rows = [(i, " ".join(["w"] * rnd.choice([0, 1, 5, 60, 300])), rnd.choice(["a", "a", "a", "b", "c", None]), "x") for i in range(400)]
    rows += [(7, "one two\nthree", "b", "x")] * 3 + [(None, "no key here", "c", "x"), (500, None, "b", "x"), (501, "word " * 9000, "d", "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, _cell string")


def test_invariants(docs):
    out = mixing.mix(docs, shard_words=2000).cache()
    assert out.count() == docs.count() and "_cell" in out.columns
    for r in out.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.sum("size").alias("size"), F.first("source_size").alias("known"), F.count("*").alias("n")).collect():
        assert abs(r.taken - r.target) <= mixing.BLOCK_WORDS and r.size == r.known
    assert out.filter("taken > 2 * size OR taken < 0").count() == 0
    again = mixing.mix(docs.repartition(7), shard_words=2000)
    key = lambda df: sorted(map(str, df.select("doc_id", "text", "taken").collect()))
    assert key(out) == key(again)


def test_rows_hold_the_words_taken(docs):
    mixed = mixing.mix(docs).cache()
    rows = mixing.mixed_rows(mixed)
    count = lambda t: len(re.findall(WORD, t or ""))
    assert sum(count(r.text) for r in rows.collect()) == mixed.agg(F.sum("taken")).first()[0]
    whole = {(r.doc_id, r.text) for r in docs.collect()}
    assert all((r.doc_id, r.text) in whole or any(d == r.doc_id and (t or "").startswith(r.text) for d, t in whole) for r in rows.collect())


def test_a_repeated_row_is_taken_row_by_row(spark):
    """Its copies are numbered part by part: whole ones first, one in part, the rest not at all."""
    rows = [(i, f"some words {i} " * 7, "a") for i in range(300)] + [(1000, "one two three four five", "a")] * 600 + [(2000, "x y", None)] * 40
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(9)
    out = mixing.mix(df, shard_words=1500).cache()
    assert out.count() == len(rows)
    copies = sorted(r.taken for r in out.filter("doc_id = 1000").collect())
    low = min(copies) // 5 * 5
    assert sum(x not in (low, low + 5) for x in copies) <= 1 and len(copies) == 600
    for r in out.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect():
        assert abs(r.taken - r.target) <= mixing.BLOCK_WORDS
    again = mixing.mix(df.repartition(2), shard_words=1500)
    key = lambda d: sorted(map(str, d.select("doc_id", "text", "taken").collect()))
    assert key(out) == key(again)


def test_many_sources_need_no_single_task(spark, monkeypatch):
    from gridmill.functions import positions

    monkeypatch.setattr(positions, "SMALL_GROUP_ROWS", 10)
    monkeypatch.setattr(positions, "BLOCK_ROWS", 7)
    rnd = random.Random(3)
    sizes = {f"s{i:03d}": rnd.randint(0, 900) for i in range(90)}
    rows = [(i, " ".join(["w"] * n), s) for i, (s, n) in enumerate(sizes.items())]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), shard_words=100).collect()
    names = sorted(sizes)
    want = dict(zip(names, targets_by_hand([sizes[n] for n in names], [mixing.WEIGHTS[i % 3] for i in range(len(names))], 1.5, 2)))
    assert {r.source: r.target for r in out} == pytest.approx(want)
    block = max(1, min(mixing.BLOCK_WORDS, int(min(v for v in want.values() if v > 0) // 50)))
    seats = round(sum(want.values()) / block)
    quota = dict(zip(names, seats_by_hand([want[n] for n in names], seats)))
    assert all(r.taken == min(quota[r.source] * block, 2 * r.size) for r in out)


def test_rows_of_a_mix_with_nulls(spark):
    df = spark.createDataFrame([(1, None, 0, 0), (2, "a b c", 3, None), (3, "a  b c", 3, 5), (4, "d", 1, 0), (5, None, None, 4)], "doc_id long, text string, size long, taken long")
    assert sorted((r.doc_id, r.text) for r in mixing.mixed_rows(df).collect()) == [(3, "a  b"), (3, "a  b c")]
    assert mixing.mixed_rows(df.limit(0)).count() == 0


def test_empty_and_clashing(spark, docs):
    assert mixing.mix(docs.limit(0)).count() == 0
    named = docs.limit(5).selectExpr("doc_id", "text", "source", "'s' AS size", "'t' AS taken", "1 AS _n", "2 AS _quota", "3 AS source_no")
    out = mixing.mix(named)
    assert out.columns == ["doc_id", "text", "source", "_n", "_quota", "source_no", "size", "source_size", "target", "taken"] and out.count() == 5
    bare = mixing.mix(spark.createDataFrame([(1, None, None), (2, "", None)], "doc_id long, text string, source string"))
    assert [(r.size, r.target, r.taken) for r in bare.collect()] == [(0, 0.0, 0)] * 2


def test_query_by_hand(spark, sf):
    sizes = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        sizes[r.source] = sizes.get(r.source, 0) + len(re.findall(WORD, r.text or ""))
    names = sorted(sizes)
    want = dict(zip(names, targets_by_hand([sizes[n] for n in names], [mixing.WEIGHTS[i % 3] for i in range(len(names))], 1.5, 2)))
    got = op6(spark, sf).collect()
    assert {r.source: r.target for r in got} == pytest.approx(want)
    assert {r.source: r.source_size for r in got} == sizes
