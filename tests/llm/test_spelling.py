"""Spelling variants against a plain search."""

import random
import re
import zlib
from collections import Counter

from gridmill.llm import spelling as sp
from gridmill.llm.queries import op12


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def grouped_by_hand(counts, near=None):
    near = near or {w: [x for x in counts if one_edit(w, x)] for w in counts}
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * n else None
    out = []
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), counts[form[w]] if form[w] else None))
    return sorted(out, key=str)


def result(df):
    return sorted(((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()), key=str)


def test_random_vocabulary(spark):
    rnd = random.Random(8)
    counts = {}
    for letters, lengths, n in (("ab", (1, 7), 300), ("abcdefgé", (3, 6), 400), ("xyÿ", (8, 9), 150)):
        for _ in range(n):
            counts["".join(rnd.choice(letters) for _ in range(rnd.randint(*lengths)))] = rnd.choice([1, 2, 3, 5, 8, 13, 40, 100])
    df = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(6)
    assert result(sp.grouped(df)) == grouped_by_hand(counts)


def test_long_words(spark, monkeypatch):
    rnd = random.Random(2)
    bases = ["".join(rnd.choice("abc") for _ in range(n)) for n in (6, 7, 8, 8, 9, 30)]
    counts = {}
    for base in bases:
        for _ in range(25):
            w, at = base, rnd.randrange(len(base))
            w = rnd.choice([w, w[:at] + w[at + 1 :], w[:at] + rnd.choice("abc") + w[at + 1 :], w[:at] + rnd.choice("abc") + w[at:]])
            counts[w] = rnd.choice([1, 3, 7, 20])
    counts |= {"z" * 30_000: 4, "z" * 30_001: 9, "z" * 29_999 + "y": 2}
    monkeypatch.setattr(sp, "LEVELS", 7)
    assert result(sp.grouped(spark.createDataFrame(list(counts.items()), "word string, n long"))) == grouped_by_hand(counts)


def test_chains_and_edges(spark):
    counts = {"aaaaa": 1, "aaaab": 2, "aaabb": 4, "aabbb": 8, "abbbb": 16, "bbbbb": 32, "lonely": 5}
    rows = [*counts.items(), ("aaaaa", 0), (None, 7)]
    df = spark.createDataFrame([(w, n, "r") for w, n in rows], "word string, n long, root string")
    assert result(sp.grouped(df)) == grouped_by_hand(counts)
    assert {r.word: r.root for r in sp.grouped(df).collect()}["aaaaa"] == "bbbbb"
    assert sp.grouped(df.limit(0)).count() == 0


def words_by_hand(docs, slip=97, least=5, often=3):
    found = Counter()
    for key, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if slip and h % slip == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            if len(run) >= least:
                found[run] += 1
    return {w: n for w, n in found.items() if n >= often}


def test_counts(spark, monkeypatch):
    docs = [(1, "Straße ÀÉÎ× straße_Straße STRASSE"), (2, None), (3, ""), (None, "three words here three three"), (2, "here, again: three"), (4, "x" * 200_000), (0, "zeroth " * 4)]
    docs += [(i, "colour color-colouring naïveté\n" * (i % 4)) for i in range(300)]
    df = spark.createDataFrame([(*d, "w") for d in docs], "doc_id long, text string, word string").repartition(4)
    for held in (200_000, 2):
        monkeypatch.setattr(sp, "HELD", held)
        for slip in (None, 5):
            got = {r.word: r.n for r in sp.counts(df, slip=slip).collect() if r.n >= 3}
            assert got == words_by_hand(docs, slip)
    assert sp.variants(df.limit(0)).count() == 0


def test_query(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    counts = words_by_hand(docs)
    without = {}
    for w in counts:
        for i in range(len(w)):
            without.setdefault(w[:i] + w[i + 1 :], set()).add(w)
    near = {w: [] for w in counts}
    for rest, words in without.items():
        group = words | ({rest} & counts.keys())
        for a in group:
            near[a] += [b for b in group if one_edit(a, b) and b not in near[a]]
    assert result(op12(spark, sf)) == grouped_by_hand(counts, near)
