"""The stages one after another, each against a plain version on its own input."""

import hashlib
import re

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gridmill.llm import mixing, pieces, quality_rules
from gridmill.llm.common import WORD
from tests_by_hand import base_by_hand, group_heads, lines_by_hand


@pytest.fixture(scope="module")
def staged(spark, sf, tmp_path_factory):
    """The input and output of each stage, written and read again."""
    folder, docs, out = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{sf}/documents.parquet"), {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(f"{folder}/{i}")
        after = spark.read.parquet(f"{folder}/{i}")
        out[name], docs = (docs, after), after
    return out


def test_columns_stay(staged, spark, sf):
    columns = spark.read.parquet(f"{sf}/documents.parquet").dtypes
    assert all(after.dtypes == columns for name, (_, after) in staged.items() if name != "sentencepiece")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "near copies", "mixing", "sentencepiece"]


def test_quality(staged, spark, sf):
    before, after = staged["quality rules"]
    kept = {r.doc_id for r in after.collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rules = quality_rules.fit(before, spark.read.parquet(f"{sf}/labels.parquet"))
    fails = {r.doc_id for r in before.collect() if base_by_hand(r.text)}
    ruled = {r.doc_id for r in quality_rules.judged(before, rules).filter("rule IS NOT NULL").collect()}
    assert kept == {r.doc_id for r in before.collect()} - fails - ruled
    clean = [d for d, q in labels.items() if q == 1 and d not in fails]
    assert sum(d in kept for d in clean) >= 0.97 * len(clean)


def test_lines(staged):
    before, after = staged["line dedup"]
    want = lines_by_hand([(r.doc_id, r.text) for r in before.collect()])
    assert sorted((r.doc_id, r.text) for r in after.collect()) == sorted(want)
    assert all(r.n_chars == len(r.text) for r in after.collect())


def test_near_copies(staged):
    before, after = staged["near copies"]
    assert sorted(r.doc_id for r in after.collect()) == group_heads([(r.doc_id, r.text) for r in before.collect()])


def test_mixture(staged):
    before, after = staged["mixing"]
    count = lambda t: len(re.findall(WORD, t))
    words = {}
    for r in after.collect():
        words[r.doc_id] = words.get(r.doc_id, 0) + count(r.text)
        assert r.n_chars == len(r.text)
    taken = {r.doc_id: r.taken for r in mixing.mix(before).filter("taken > 0").collect()}
    assert words == taken
    total = sum(count(r.text) for r in before.collect())
    assert abs(sum(words.values()) - 1.5 * total) <= 0.02 * total


def test_encoding(staged, spark, sf):
    before, after = staged["sentencepiece"]
    library = pieces.loaded(pieces.read_model(public_tokenizers.path("piece_bpe_32k.model"))).library
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = sorted((r.doc_id, sha(",".join(map(str, library.encode(r.text)))), sha(library.decode(library.encode(r.text)))) for r in before.collect())
    assert sorted((r.doc_id, r.ids_sha256, r.decoded_sha256) for r in after.collect()) == want
    whole = corpus_pipeline.run(spark, sf)
    assert sorted((r.doc_id, r.ids_sha256, r.decoded_sha256) for r in whole.collect()) == want


def test_edges(spark, sf):
    rows = [(1, None, None, None, None), (None, "word " * 50, "en", None, 250), (2, "", "en", "s", 0), (3, "a b\nc d\ne f\n" * 10, "en", "s", 120), (3, "a b\nc d\ne f\n" * 10, "en", "s", 120)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        for docs in (df, df.limit(0), df.withColumns({"taken": F.lit("x"), "n_words": F.lit(1), "ids": F.lit(2)})):
            out = stage(spark, docs, sf)
            assert name == "sentencepiece" or out.columns == docs.columns
            out.collect()
