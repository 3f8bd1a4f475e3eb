"""The similarity join against all pairs, on small inputs."""

import random
import re

import numpy as np
import pytest

from gridmill.llm import jaccard_join as jj
from gridmill.llm.common import WORD
from gridmill.llm.queries import op5


def gram_set(text, n=5):
    words = re.findall(WORD, text or "")
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else {tuple(words)} if words else set()


def by_hand(docs, threshold=0.8):
    """(id, class, copies, links, linked sets) for each row of (id, text)."""
    grams = [gram_set(t) for _, t in docs]
    links = [[j for j in range(len(docs)) if j != i and grams[i] and grams[j] and len(grams[i] & grams[j]) >= threshold * len(grams[i] | grams[j])] for i in range(len(docs))]
    out = []
    for i, (key, _) in enumerate(docs):
        reach, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in reach:
                    reach.add(j)
                    todo.append(j)
        ids = [docs[j][0] for j in reach if docs[j][0] is not None]
        same = [docs[j][0] for j in reach if (grams[j] == grams[i] and grams[i]) or j == i]
        same = [x for x in same if x is not None]
        others = {frozenset(grams[j]) for j in links[i]} - {frozenset(grams[i])}
        out.append((key, min(ids, default=None), min(same, default=None), len(links[i]), len(others)))
    return sorted(out, key=str)


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def docs():
    rnd = random.Random(11)
    out, number = [], 0
    for _ in range(25):
        base = [rnd.choice("abcdefghijklmnop") + str(rnd.randint(0, 30)) for _ in range(rnd.choice([3, 8, 40, 120]))]
        for _ in range(rnd.randint(1, 9)):
            words = list(base)
            for _ in range(rnd.choice([0, 0, 1, 2, 6])):
                words[rnd.randrange(len(words))] = "z" + str(rnd.randint(0, 99))
            out.append((number, " ".join(words)))
            number += 1
    out += [(9000, None), (9001, ""), (9002, " \n"), (9003, "four words are here"), (9004, "four  words\nare here"), (9003, "four words are here"), (None, out[0][1])]
    return out


def test_all_links(spark, docs):
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, set_id string").repartition(5)
    assert result(jj.join(df)) == by_hand(docs)


def test_blocks_give_the_same_links(spark, docs, monkeypatch):
    monkeypatch.setattr(jj, "BLOCK_SETS", 3)
    assert result(jj.join(spark.createDataFrame(docs, "doc_id long, text string"))) == by_hand(docs)
    monkeypatch.setattr(jj, "BLOCK_GRAMS", 50)
    assert result(jj.join(spark.createDataFrame(docs, "doc_id long, text string"))) == by_hand(docs)


def test_first_of_group(spark, docs):
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, _text_hash string")
    left = jj.first_of_group(df)
    assert left.columns == df.columns
    classes = by_hand(docs)
    want = sorted({c for i, c, *_ in classes if c is not None and c < 9000} | {9000, 9001, 9002, 9003})
    assert sorted(r.doc_id for r in left.collect()) == want


def test_posterior(monkeypatch):
    for n, fewest in jj.least_matches(0.8, 1e-7):
        grid = np.linspace(0, 1, 20_001)[1:-1]
        for m in {fewest, max(0, fewest - 1)}:
            density = np.exp(m * np.log(grid) + (n - m) * np.log(1 - grid))
            tail = density[grid >= 0.8].sum() / density.sum()
            assert (tail >= 0.9e-7) == (m >= fewest) or m == fewest


def test_components(spark):
    rnd = random.Random(4)
    edges = [(str(rnd.randint(0, 60)).zfill(3).encode(), str(rnd.randint(0, 60)).zfill(3).encode()) for _ in range(45)] + [(f"{900 + i}".encode(), f"{901 + i}".encode()) for i in range(30)]
    df = spark.createDataFrame([(bytearray(a), bytearray(b)) for a, b in edges], "a binary, b binary")
    got = {bytes(r.node): bytes(r.root) for r in jj.components(df, "a", "b").collect()}
    root = {n: n for e in edges for n in e}
    for _ in range(80):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {n: r for n, r in root.items() if n != r}


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert jj.join(none).count() == 0 and jj.first_of_group(none).count() == 0


def test_query_against_all_pairs(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert result(op5(spark, sf)) == by_hand(docs)
