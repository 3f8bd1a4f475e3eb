"""Exact duplicates against a plain search."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from gridmill.llm import exact_index as ei


def flat(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def by_hand(docs):
    """Rows of (key, keep_id, group_size, sha256), and how many rows each group keeps: one."""
    groups = {}
    for key, text in docs:
        groups.setdefault(flat(text), []).append(key)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    least = lambda keys: min((k for k in keys if k is not None), default=None)
    return sorted(((k, least(groups[flat(t)]), len(groups[flat(t)]), sha(flat(t))) for k, t in docs), key=str)


def check(out, docs):
    rows = out.collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in rows), key=str) == by_hand(docs)
    kept = [r for r in rows if r.kept]
    assert len(kept) == len({r.text_sha256 for r in rows}) == len({r.text_sha256 for r in kept})
    assert all(r.doc_id == r.keep_id for r in kept)


def random_docs(n=600):
    rnd = random.Random(5)
    docs = [(i, rnd.choice([" ", "\n", " \t"]).join(rnd.choice("abc") for _ in range(rnd.randint(1, 5)))) for i in range(n)]
    rnd.shuffle(docs)
    return docs


def test_random_documents(spark):
    docs = random_docs()
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    check(ei.dedup(df), docs)


def test_overfull_buckets_and_chains(spark):
    docs = random_docs()
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    check(ei.dedup(df, capacity=3), docs)
    check(ei.dedup(df, capacity=3, bits=4), docs)  # 16 keys: most texts are in chains
    index = ei.build(df, capacity=3)
    cells = index.directory.collect()
    assert index.depth > 6 and len({c.cell for c in cells}) == len(cells) <= 2**index.depth
    assert all(c.links <= 3 for c in cells)
    held = index.links.groupBy("bucket").count().collect()
    assert {r["bucket"]: r["count"] for r in held} == {c.bucket: c.links for c in cells}
    for c in cells:  # a bucket has one cell for each key prefix that its own depth leaves open
        assert sum(x.bucket == c.bucket for x in cells) == 2 ** (index.depth - c.depth)
    chains = ei.build(df, capacity=3, bits=2).buckets.groupBy("_key").agg(F.sort_array(F.collect_list("link")).alias("at")).collect()
    assert max(len(r["at"]) for r in chains) > 3 and all(r["at"] == list(range(len(r["at"]))) for r in chains)


def test_edges(spark):
    docs = [
        (7, None), (8, ""), (9, " "), (10, "\n\t "), (None, "a b"), (3, "a  b"), (5, "a\nb"), (3, "a  b"), (11, "a b "), (12, "a b"),
        (None, "only null"), (None, "only null"), (13, "x " * 300_000), (14, "x\t" * 300_000), (15, "x " * 300_000 + "y"), (-4, "é"), (2, "é"),
    ]
    df = spark.createDataFrame([(*d, "k", 1, True) for d in docs], "doc_id long, text string, Keep_id string, _key int, kept boolean").repartition(4)
    check(ei.dedup(df), docs)
    left = ei.unique(df)
    assert left.columns == df.columns
    got = sorted(((r.doc_id, r.text, r._key) for r in left.collect()), key=str)
    assert len(got) == len({flat(t) for _, t in docs}) and {flat(t) for _, t, _ in got} == {flat(t) for _, t in docs}
    assert ei.dedup(df.limit(0)).count() == 0 and ei.unique(df.limit(0)).count() == 0


def test_hot_text(spark):
    docs = [(i, "the same text" if i % 3 else f"text {i}") for i in range(3000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(8)
    check(ei.dedup(df), docs)


def test_native(spark, sf):
    plan = ei.dedup(spark.read.parquet(f"{sf}/documents.parquet"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
