"""Language identification by multinomial naive Bayes over hashed character n-grams.

Letters are lower-cased, everything else counts as one space, and n-grams of one to three characters are
hashed into a fixed number of buckets. Training adds up buckets by language in each task, then over tasks. The
matrix of log-probabilities (buckets x languages, of fixed height) is broadcast. Texts are scored by the batch: a batch is a sparse
matrix of n-gram counts, kept as the buckets of its texts one after another, and its product with the broadcast matrix is a sum of
matrix rows over each text's stretch, in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridmill.functions.semantics import require
from gridmill.llm.common import without
from gridmill.llm.pieces import slices

BITS = 16
ORDERS = 3
BLOCK = 1_000_000  # characters of a text that are hashed at a time
SMOOTHING = 0.5
UNKNOWN = "und"
MAX_LANGUAGES = 200  # more mean that the label column is no language; the matrix stays under 0.1 GB
GATHERED = 4_000_000  # numbers that a batch gathers from the matrix at a time

_LETTERS: list[np.ndarray] = []


def letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def buckets(text: str | None, bits: int = BITS) -> Iterator[np.ndarray]:
    """The buckets of all n-grams of a text, block by block; nothing if it has no letter."""
    if not text:
        return
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = letters()
    tail = np.full(1, 32, np.uint64)  # a space before the first letter
    for start in range(0, len(points), BLOCK):
        block = points[start : start + BLOCK]
        plain = np.where(is_letter[block], block, 32).astype(np.uint64)
        if start + BLOCK >= len(points):
            plain = np.append(plain, np.uint64(32))
        run = np.concatenate([tail, plain])
        new = len(tail)
        keep = np.ones(len(run), bool)
        keep[new:] = (run[new:] != 32) | (run[new - 1 : -1] != 32)  # one space between words
        run = run[keep]
        fresh_from = int(keep[:new].sum())
        if len(run) == fresh_from:
            continue
        code = np.zeros(len(run), np.uint64)
        for n in range(1, ORDERS + 1):
            code = code[:-1] * np.uint64(0x9E3779B97F4A7C15) + run[n - 1 :] if n > 1 else run * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)
            mixed = (code ^ (code >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9 + 2 * n)
            first = max(0, fresh_from - n + 1)  # n-grams that end in this block
            grams = mixed[first:] >> np.uint64(64 - bits)
            if n == 1:
                grams = grams[run[first:] != 32]
            if len(grams):
                yield grams.astype(np.int64)
        tail = run[-(ORDERS - 1) :]


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


@dataclass(frozen=True)
class Model:
    """Languages, and log-probabilities by bucket and language; the last row holds the priors."""

    languages: tuple[str, ...]
    matrix: np.ndarray

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Log-probabilities up to a constant: texts x languages, NaN for a text without a letter."""
        known = np.array([has_letter(t) for t in texts], bool)
        out = np.where(known[:, None], self.matrix[-1][None, :], np.nan)
        limit, held, owners, size = max(1, GATHERED // max(1, len(self.languages))), [], [], 0

        def add_up() -> None:
            starts = np.cumsum([0, *map(len, held[:-1])])
            np.add.at(out, owners, np.add.reduceat(self.matrix[np.concatenate(held)], starts, axis=0))
            held.clear()
            owners.clear()

        for i in np.flatnonzero(known).tolist():
            for grams in buckets(texts[i]):
                for k in range(0, len(grams), limit):
                    held.append(grams[k : k + limit])
                    owners.append(i)
                    size += len(held[-1])
                    if size >= limit:
                        add_up()
                        size = 0
        if held:
            add_up()
        return out

    def predict_all(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """The likeliest language of each text and its posterior probability; ``und`` and 0 without a letter or without a model."""
        if not self.languages or not texts:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        total = self.scores(texts)
        known = ~np.isnan(total[:, 0])
        best = np.argmax(np.where(known[:, None], total, 0.0), axis=1)
        spread = np.exp(total - total[np.arange(len(texts)), best][:, None]).sum(axis=1)
        return [self.languages[b] if k else UNKNOWN for b, k in zip(best.tolist(), known.tolist(), strict=True)], np.where(known, 1.0 / spread, 0.0)

    def predict(self, text: str | None) -> tuple[str, float]:
        names, chances = self.predict_all([text])
        return names[0], float(chances[0])


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", bits: int = BITS) -> Model:
    """Learn from all rows with a language; rows without one, and texts without a letter, teach nothing.

    Without any row the model is empty and predicts ``und``.
    """
    require(docs, text, lang)
    rows = docs.select(F.col(lang).alias("lang"), F.col(text).alias("text")).filter("lang IS NOT NULL AND text IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        parts = (part for batch in batches for part in slices(batch, "text"))
        for part in parts:
            for name, words in zip(part.column("lang").to_pylist(), part.column("text").to_pylist(), strict=True):
                if not has_letter(words):
                    continue
                counts = held.setdefault(name, np.zeros((1 << bits) + 1, np.int64))
                counts[-1] += 1  # documents
                for grams in buckets(words, bits):
                    counts[:-1] += np.bincount(grams, minlength=1 << bits)
                if len(held) > MAX_LANGUAGES:
                    raise ValueError(f"more than {MAX_LANGUAGES} languages")
        for name, counts in held.items():
            used = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(used), pa.string()), pa.array(used.astype(np.int32)), pa.array(counts[used])], names=["lang", "bucket", "n"]
            )

    counted = rows.mapInArrow(run, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    found = counted.toPandas()  # at most languages x buckets
    names = sorted(found["lang"].unique())
    if len(names) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    counts = np.zeros(((1 << bits) + 1, len(names)))
    counts[found["bucket"].to_numpy(), np.searchsorted(names, found["lang"].to_numpy()) if names else []] = found["n"].to_numpy()
    grams = counts[:-1] + SMOOTHING
    likely = np.log(grams) - np.log(grams.sum(axis=0))
    prior = np.log(counts[-1]) - np.log(max(1.0, counts[-1].sum()))
    return Model(tuple(names), np.vstack([likely, prior]))


def predict(docs: DataFrame, model: Model, text: str = "text", lang_pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """Add the predicted language and its probability for each whole text; only the text is looked at.

    ``und`` and 0 for a null text, one without a letter, or an empty model; among equals the first language by name.
    Long texts are hashed in blocks, whole. Repeated rows fare alike, an empty table gives an empty result,
    and columns of the new names are replaced.
    """
    require(docs, text)
    kept = docs.select(*without(docs, [lang_pred, score]))
    require(kept, text)
    schema = T.StructType([*kept.schema.fields, T.StructField(lang_pred, T.StringType()), T.StructField(score, T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.matrix))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Model(*shared.value)
        for batch in batches:
            for part in slices(batch, text):
                names, chances = held.predict_all(part.column(text).to_pylist())
                arrays = [*part.columns, pa.array(names, pa.string()), pa.array(chances, pa.float64())]
                yield pa.RecordBatch.from_arrays(arrays, names=[*part.schema.names, lang_pred, score])

    return kept.mapInArrow(run, schema)
