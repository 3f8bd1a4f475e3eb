"""Periodic runs against a plain search."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from gridmill.llm import periodic_runs as pr
from gridmill.llm.common import WORD
from gridmill.llm.queries import op11


def by_hand(words, least=24, times=3):
    """(start, length, period) of each run, by start and then period."""
    out, n = {}, len(words)
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            stretch = (i, j + q - i)
            if stretch[1] >= max(least, times * q) and stretch not in out:
                out[stretch] = q  # periods ascend, so the first is the smallest
            i = j
    return sorted((s, n, q) for (s, n), q in out.items())


def numbers(words):
    seen = {}
    return [seen.setdefault(w, len(seen)) for w in words]


def test_random_texts():
    rnd = random.Random(3)
    texts = []
    for _ in range(400):
        words, kinds = [], rnd.choice([1, 2, 3, 8, 200])
        while len(words) < rnd.choice([0, 5, 30, 90, 260]):
            part = [rnd.randrange(kinds) for _ in range(rnd.randint(1, 12))]
            words += part * rnd.choice([1, 1, 1, 3, 4, 7, 25])
        texts.append(words)
    codes = np.array([w for t in texts for w in t], np.int64)
    starts = np.cumsum([0, *map(len, texts)])
    for least, times in ((24, 3), (6, 3), (10, 4)):
        want = [(k, *r) for k, t in enumerate(texts) for r in by_hand(t, least, times)]
        assert [tuple(x) for x in pr.runs(codes, starts, least, times).tolist()] == want and want
    assert pr.runs(np.array([], np.int64), np.array([0])).shape == (0, 4)
    with pytest.raises(ValueError):
        pr.runs(codes, starts, 24, 2)


def test_rows(spark):
    period = [f"w{i}" for i in range(10)]
    docs = [
        (1, " ".join(["a"] + period * 4 + ["z"])), (2, None), (3, ""), (4, " \n\t "), (5, "one two three\nfour"), (1, " ".join(["a"] + period * 4 + ["z"])),
        (None, "x " * 23), (6, "x " * 24), (7, "hm " * 200_000), (8, " ".join(["p", "q", "r"] * 8 + ["p", "q", "s"] * 8)),
    ]
    df = spark.createDataFrame([(*d, "r", 9) for d in docs], "doc_id long, text string, runs string, N_words int").repartition(3)
    out = pr.with_runs(df)
    assert out.columns == ["doc_id", "text", "n_words", "runs", "collapsed"]
    got = {r.doc_id: r for r in out.collect()}
    assert out.count() == len(docs)
    assert [tuple(x) for x in got[1].runs] == [(1, 40, 10)] and got[1].collapsed == " ".join(["a", *period, "z"])
    for i in (2, 3, 4):
        assert (got[i].n_words, got[i].runs, got[i].collapsed) == (0, [], "")
    assert (got[5].n_words, got[5].runs, got[5].collapsed) == (3, [], "one two three four")
    assert got[None].runs == [] and got[6].collapsed == "x"
    assert [tuple(x) for x in got[7].runs] == [(0, 200_000, 1)] and got[7].collapsed == "hm"
    words = docs[9][1].split()
    assert [tuple(x) for x in got[8].runs] == by_hand(words)
    assert pr.with_runs(df.limit(0)).count() == 0


def test_query(spark, sf):
    want = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        words = re.findall(WORD, r.text or "")
        h = zlib.crc32(str(r.doc_id).encode())
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
        found = by_hand(numbers(words))
        best = min(found, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=(None,) * 3)
        gone = {i for s, m, q in found for i in range(s + q, s + m)}
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        want[r.doc_id] = (
            len(found), *best, best[1] and 1000 * best[1] // best[2], sha("".join(f"{s},{m},{q}\n" for s, m, q in found)),
            sha(" ".join(w for i, w in enumerate(words) if i not in gone)),
        )
    columns = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    got = op11(spark, sf)
    assert {k for c, k in got.dtypes if c in columns[:5]} == {"bigint"}
    assert {r.doc_id: tuple(r[c] for c in columns) for r in got.collect()} == want
    assert sum(v[0] > 0 for v in want.values()) > 3
