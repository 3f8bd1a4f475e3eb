"""Piece encoding against the sentencepiece library."""

import random

import public_tokenizers
import pytest

from gridmill.llm import pieces
from gridmill.llm.queries import op7, piece_digests


@pytest.fixture(scope="module")
def encoder():
    return pieces.loaded(pieces.read_model(public_tokenizers.path("piece_bpe_32k.model")))


def test_random_texts(encoder):
    rnd = random.Random(7)
    parts = [" ", "  ", "\n", "a", "the", "ing", "é", "日本", "😀", pieces.SPACE, "\0", "12", ".", "ｆ", "​", "Й", "\t", "<s>", " " * 30, "x" * 40]
    vocabulary = list(encoder.ids)
    for _ in range(3000):
        text = "".join(rnd.choice(parts) if rnd.random() < 0.6 else rnd.choice(vocabulary) for _ in range(rnd.randint(0, 14)))
        ids = encoder.library.encode(text)
        assert encoder.encode(text) == ids
        assert encoder.decode(ids) == encoder.library.decode(ids)


@pytest.mark.parametrize("text", ["a" * 5000, " " * 3000, "ab" * 4000, "日" * 2000, "the end" * 900 + "\n" * 700, "=" * 1500])
def test_long_runs(encoder, text):
    assert encoder.encode(text) == encoder.library.encode(text)
    assert encoder.split(encoder.library.normalize(text)) == [encoder.library.id_to_piece(i) for i in encoder.library.encode(text)] or "日" in text or "\n" in text


def test_merging_and_backtracking_agree(encoder):
    rnd = random.Random(3)
    for _ in range(500):
        text = "".join(rnd.choice("abehinrst") for _ in range(rnd.randint(1, 18)))
        assert encoder.split(text) == encoder.merged(text)


def test_a_piece_with_a_space_inside_turns_chunks_off(encoder):
    held = encoder.ids
    try:
        encoder.ids = {**held, f"a{pieces.SPACE}b": 1}
        assert encoder._chunk_pattern() is None
    finally:
        encoder.ids = held


def test_edges(spark, encoder):
    df = spark.createDataFrame(
        [(1, None, "k", 9), (2, "", "k", 9), (3, "two  words", "k", 9), (3, "two  words", "k", 9), (None, "x" * 100_000, None, None)],
        "doc_id long, text string, ids string, _decoded_ int",
    )
    model = pieces.read_model(public_tokenizers.path("piece_bpe_32k.model"))
    out = pieces.encode_decode(df, model)
    assert out.columns == ["doc_id", "text", "_decoded_", "ids", "decoded"]
    got = [(r.doc_id, r.ids, r.decoded) for r in out.collect()]
    assert got[0] == (1, [], "") and got[1] == (2, [], "")
    assert got[2] == got[3] == (3, encoder.library.encode("two  words"), "two  words")
    assert got[4][2] == "x" * 100_000
    assert pieces.decode(out.select("doc_id", "ids"), model).filter("doc_id = 3").first().decoded == "two  words"
    assert pieces.encode_decode(df.limit(0), model).count() == 0
    assert pieces.encode(df, model).filter("doc_id = 2").first().ids == []


def test_query_equals_the_library(spark, sf, encoder):
    import hashlib

    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = encoder.library.encode(r.text or "")
        want[r.doc_id] = (len(ids), sha(",".join(map(str, ids))), sha(encoder.library.decode(ids)))
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in op7(spark, sf).collect()} == want
    null = piece_digests(spark.createDataFrame([(1, None)], "doc_id long, text string")).first()
    assert tuple(null) == (1, 0, sha(""), sha(""))
