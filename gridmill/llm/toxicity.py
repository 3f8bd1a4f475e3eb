"""Toxicity by a classifier chain.

Categories stand in a fixed order, each with a linear model (logistic regression). A model sees the words of
a text and the probabilities of the categories before its own. In training these are out-of-fold: every
labelled row's earlier probabilities come from models that were fitted without its fold, as the
corpus will be scored by models that have not seen its rows. A fold's model also chooses its tokens without that fold.

A text's features are its distinct words, and their first three to five letters, hashed. Of them, those that
tell the categories apart best (by chi square over the labelled rows) enter the models.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridmill.functions.joins import small_side
from gridmill.functions.semantics import SEED, col, require
from gridmill.llm.common import distinct_texts, fresh, without, written

MAX_LABELLED = 20_000  # labelled keys that the chain is fitted on, at most about
HASHES = 1 << 20
TOKENS = 1024  # for each category
MIN_CHI = 20.0  # what a few chance rows among thousands of tokens stay below
MIN_DOCUMENTS = 3
FOLDS = 3
STEMS = (3, 4, 5)
LEAST = 1e-6  # probabilities stay off 0 and 1 by this, so log-odds are finite


def tokens_of(text: Column) -> Column:
    """Distinct hashed words and word beginnings of a text, as numbers; empty for null.

    A word is a run of letters of any alphabet, lower-cased.
    """
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{M}]+)"), F.lit(1)))
    hashed = lambda kind, value: F.pmod(F.xxhash64(F.lit(kind), value), F.lit(HASHES)).cast("int")
    whole = F.transform(words, lambda w: hashed(0, w))
    stems = [F.transform(F.filter(words, lambda w, n=n: F.length(w) > n), lambda w, n=n: hashed(n, F.substring(w, 1, n))) for n in STEMS]
    return F.array_distinct(F.concat(whole, *stems))


@dataclass(frozen=True)
class Linear:
    """A logistic regression over the chosen tokens, then the log-odds of earlier categories, then 1."""

    weights: np.ndarray

    def probability(self, tokens: np.ndarray, ends: np.ndarray, earlier: list[np.ndarray]) -> np.ndarray:
        """``tokens`` holds each row's token numbers one after another, up to its end."""
        x = Design(tokens, ends, earlier, len(self.weights) - len(earlier) - 1)
        return np.clip(1 / (1 + np.exp(-np.clip(x.times(self.weights), -30, 30))), LEAST, 1 - LEAST)


@dataclass(frozen=True)
class Design:
    """Rows of token numbers and of a few dense columns, as a matrix to multiply with."""

    tokens: np.ndarray
    ends: np.ndarray
    earlier: list[np.ndarray]
    width: int

    def dense(self) -> np.ndarray:
        odds = [np.log(p / (1 - p)) for p in self.earlier]
        return np.column_stack([*odds, np.ones(len(self.ends))])

    def times(self, weights: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0.0], np.cumsum(weights[: self.width][self.tokens])])[np.concatenate([[0], self.ends])]
        return np.diff(sums) + self.dense() @ weights[self.width :]

    def transposed_times(self, rows: np.ndarray) -> np.ndarray:
        counts = np.diff(np.concatenate([[0], self.ends]))
        sparse = np.bincount(self.tokens, np.repeat(rows, counts), self.width)
        return np.concatenate([sparse, self.dense().T @ rows])


def regression(x: Design, y: np.ndarray, regularization: float, rounds: int = 60, memory: int = 8) -> Linear:
    """L2-regularized logistic regression, by L-BFGS with a backtracking line search; the last weight is not penalized."""
    n = len(y)
    penalty = np.full(x.width + len(x.earlier) + 1, regularization)
    penalty[-1] = 0.0

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        z = x.times(w)
        value = np.logaddexp(0, z).sum() / n - (y @ z) / n + 0.5 * (penalty * w) @ w
        return value, x.transposed_times(1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / n + penalty * w

    w = np.zeros(len(penalty))
    value, slope = loss(w)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        q, kept = slope.copy(), []
        for s, g in reversed(steps):
            a = (s @ q) / (s @ g)
            kept.append(a)
            q -= a * g
        if steps:
            s, g = steps[-1]
            q *= (s @ g) / (g @ g)
        for (s, g), a in zip(steps, reversed(kept), strict=True):
            q += s * (a - (g @ q) / (s @ g))
        size, down = 1.0 if steps else 1.0 / max(1e-12, np.abs(slope).max()), slope @ q
        while size > 1e-10:
            new, new_slope = loss(w - size * q)
            if new <= value - 1e-4 * size * down:
                break
            size /= 2
        else:
            break
        s, g = -size * q, new_slope - slope
        if s @ g > 1e-12:
            steps = [*steps, (s, g)][-memory:]
        small = abs(value - new) <= 1e-9 * max(1.0, abs(value))
        w, value, slope = w + s, new, new_slope
        if small:
            break
    return Linear(w)


@dataclass(frozen=True)
class Chain:
    categories: tuple[str, ...]
    vocabulary: np.ndarray  # the chosen tokens, ascending
    models: tuple[Linear | float, ...]  # a number: the category has one class only
    thresholds: tuple[float, ...]

    def probabilities(self, tokens: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for model in self.models:
            out.append(np.full(len(ends), model) if isinstance(model, float) else model.probability(tokens, ends, out))
        return out


def chosen(lists: pa.Array, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lists of tokens as numbers in the vocabulary, others left out, and where each list ends."""
    values = lists.flatten().to_numpy(zero_copy_only=False)
    lengths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    if not len(vocabulary):
        return np.empty(0, np.int64), np.zeros(len(lengths), np.int64)
    at = np.minimum(np.searchsorted(vocabulary, values), len(vocabulary) - 1)
    known = vocabulary[at] == values
    upto = np.concatenate([[0], np.cumsum(known)])
    return at[known], upto[np.cumsum(lengths)]


def fit(
    docs: DataFrame, labels: DataFrame, categories: dict[str, Column], key: str = "doc_id", text: str = "text",
    max_labelled: int = MAX_LABELLED, tokens: int = TOKENS, folds: int = FOLDS, regularization: float = 1e-3,
) -> Chain:
    """Fit the chain; ``categories`` names the conditions on ``labels`` in chain order.

    Above ``max_labelled`` labelled keys a share of them by hash is used: their chosen tokens come to the
    driver, where the small regressions are solved. Rows whose condition is null teach that category's model nothing
    but take part in the others. A category of one class gets that class (0 or 1) as a constant, as it does
    without any row (0). Several labels of one key count once, as true if any is true; of a key with
    several documents at most ``KEY_TEXTS`` distinct texts are used, so the sample does not grow with a key's share.
    """
    require(docs, key, text)
    require(labels, key)
    names = [f"_y{i}" for i in range(len(categories))]
    truth = labels.filter(col(key).isNotNull()).groupBy(col(key).alias("_k")).agg(
        *[F.max(c.cast("double")).alias(n) for n, c in zip(names, categories.values(), strict=True)]
    )
    every = max(1, -(-truth.count() // max_labelled))
    some = truth.filter(F.pmod(F.xxhash64(F.lit(SEED), "_k"), F.lit(every)) == 0)
    rows = docs.select(col(key).alias("_id"), col(text).alias("_text")).join(small_side(some), F.col("_id") == F.col("_k"))
    rows = distinct_texts(rows, "_id", "_text", "_hash")
    fold = F.pmod(F.xxhash64(F.lit(SEED + 1), "_text"), F.lit(folds)).cast("int").alias("_fold")  # copies share a fold
    rows = written(rows.select("_id", "_hash", fold, tokens_of(F.col("_text")).alias("_tokens"), *names), "toxicity-sample")
    # a fold's labels must not choose the tokens of the model that scores it
    own = [np.array(sorted(telling(rows.filter(F.col("_fold") != k), names, tokens)), np.int64) for k in range(folds)]
    chosen_by_all = np.array(sorted(telling(rows, names, tokens)), np.int64)
    vocabulary = np.unique(np.concatenate([chosen_by_all, *own]))
    sample = collected(rows, vocabulary, names)
    lists = sample["_chosen"].tolist()
    x, ends = np.concatenate([np.empty(0, np.int64), *lists]).astype(np.int64), np.cumsum([len(v) for v in lists], dtype=np.int64)
    views = [narrowed(x, ends, vocabulary, v) for v in own]
    x, ends = narrowed(x, ends, vocabulary, chosen_by_all)
    part = sample["_fold"].to_numpy()
    models: list[Linear | float] = []
    thresholds: list[float] = []
    known: list[np.ndarray] = []  # out-of-fold probabilities
    for name in names:
        y = sample[name].to_numpy(float)
        model = fitted(x, ends, known, y, np.ones(len(y), bool), len(chosen_by_all), regularization)
        out = np.zeros(len(y))
        for k, (fold_x, fold_ends) in enumerate(views):
            inside = part == k
            apart = fitted(fold_x, fold_ends, known, y, ~inside, len(own[k]), regularization)
            out[inside] = apart if isinstance(apart, float) else apart.probability(fold_x, fold_ends, known)[inside]
        known.append(np.clip(out, LEAST, 1 - LEAST))
        models.append(model)
        thresholds.append(best_threshold(known[-1], y))
    return Chain(tuple(categories), chosen_by_all, tuple(models), tuple(thresholds))


def narrowed(x: np.ndarray, ends: np.ndarray, vocabulary: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of numbers in ``vocabulary``, as numbers in ``part`` of it; the other tokens are left out."""
    at = np.full(len(vocabulary), -1)
    at[np.searchsorted(vocabulary, part)] = np.arange(len(part))
    new = at[x]
    return new[new >= 0], np.concatenate([[0], np.cumsum(new >= 0)])[ends]


def collected(rows: DataFrame, vocabulary: np.ndarray, names: list[str]) -> pd.DataFrame:
    """The sample with its chosen tokens, in the order of ids and of the texts' hashes."""
    schema = T.StructType([rows.schema["_id"], rows.schema["_hash"], rows.schema["_fold"], *[rows.schema[n] for n in names], T.StructField("_chosen", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, ends = chosen(batch.column("_tokens"), vocabulary)
            lists = pa.ListArray.from_arrays(np.concatenate([[0], ends]).astype(np.int32), at.astype(np.int32))
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in schema.fields[:-1]], lists], names=schema.names)

    return rows.mapInArrow(run, schema).toPandas().sort_values(["_id", "_hash"], kind="stable").reset_index(drop=True)


def fitted(x, ends, earlier: list[np.ndarray], y: np.ndarray, use: np.ndarray, width: int, regularization: float) -> Linear | float:
    """A model of the rows in ``use`` that have a label; a constant if those are of one class."""
    use = use & ~np.isnan(y)
    if not use.any() or (y[use] == y[use][0]).all():
        return float(y[use][0]) if use.any() else 0.0
    counts = np.diff(np.concatenate([[0], ends]))
    rows = Design(x[np.repeat(use, counts)], np.cumsum(counts[use]), [p[use] for p in earlier], width)
    return regression(rows, y[use], regularization)


def telling(rows: DataFrame, names: list[str], most: int) -> list[int]:
    """The tokens of highest chi square for each label, at most ``most`` a label, that occur in enough rows and tell enough."""
    totals = rows.agg(F.count(F.lit(1)).alias("n"), *[F.sum(n).alias(n) for n in names]).first()
    if not totals["n"]:
        return []
    seen = (
        rows.select(F.explode("_tokens").alias("token"), *names)
        .groupBy("token").agg(F.count(F.lit(1)).alias("n"), *[F.sum(n).alias(n) for n in names])
        .filter(F.col("n") >= MIN_DOCUMENTS)
    )
    seen = written(seen, "toxicity-tokens")
    found: dict[int, None] = {}
    for name in names:
        yes, n = float(totals[name] or 0), float(totals["n"])
        if not 0 < yes < n:
            continue
        expected = F.col("n") * yes / n
        off = F.coalesce(F.col(name), F.lit(0.0)) - expected
        chi = off * off * (1 / expected + 1 / (F.col("n") - expected))
        for r in seen.select("token", chi.alias("chi")).filter(F.col("chi") >= MIN_CHI).orderBy(F.col("chi").desc(), "token").limit(most).collect():
            found[r.token] = None
    return list(found)


def best_threshold(p: np.ndarray, y: np.ndarray, steps: int = 20) -> float:
    """The probability from which calling a row positive gives the best F1 on out-of-fold predictions; the nearest to 0.5 among equals."""
    best, chosen_ = -1.0, 0.5
    for t in sorted(np.arange(1, steps) / steps, key=lambda t: abs(t - 0.5)):
        called = (p >= t) & ~np.isnan(y)
        f1 = 2 * (called & (y == 1)).sum() / max(1, called.sum() + (y == 1).sum())
        if f1 > best and not math.isclose(f1, best):
            best, chosen_ = f1, float(t)
    return chosen_


def predict(docs: DataFrame, chain: Chain, text: str = "text") -> DataFrame:
    """Add for each category of the chain its probability ``p_<category>`` and the decision ``is_<category>``.

    Whole texts, row by row. A null or empty text has no token; its probabilities are those of an
    empty text. Repeated rows fare alike, an empty table gives an empty result, columns of the new names are replaced.
    """
    require(docs, text)
    new = [f"{kind}_{c}" for c in chain.categories for kind in ("p", "is")]
    kept = docs.select(*without(docs, new))
    require(kept, text)
    mark = fresh([*kept.columns, *new], "_tokens")
    types = [T.DoubleType(), T.BooleanType()] * len(chain.categories)
    schema = T.StructType([*kept.schema.fields, *[T.StructField(n, t) for n, t in zip(new, types, strict=True)]])
    shared = docs.sparkSession.sparkContext.broadcast(chain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        for batch in batches:
            found = held.probabilities(*chosen(batch.column(mark), held.vocabulary))
            arrays = [batch.column(f.name) for f in schema.fields[: -len(new)]]
            for p, threshold in zip(found, held.thresholds, strict=True):
                arrays += [pa.array(p), pa.array(p >= threshold)]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return kept.withColumn(mark, tokens_of(col(text))).mapInArrow(run, schema)
