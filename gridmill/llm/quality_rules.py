"""Quality rules: an ordered decision list, learned from labelled statistics of texts.

Each text is reduced to a few statistics. Sequential covering learns rules for the rejected class: a rule
grows by the threshold condition with the best information gain, on two thirds of the labelled rows, until
it covers no kept row; it is pruned from the end on the other third; if it is precise enough there it
joins the list, its rows are set aside, and the next one is grown. What comes out is text that one can read and one
Spark expression, ``when(rule 1).when(rule 2)...otherwise(keep)``, so the whole corpus is judged on
the executors. Only the statistics of a bounded sample of labelled rows come to the driver.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridmill.functions.joins import small_side
from gridmill.functions.semantics import SEED, col, require
from gridmill.llm.common import WORD, distinct_texts, without
from gridmill.llm.pieces import slices

MAX_LABELLED = 50_000  # labelled keys that the rules are learned from, at most about
WINDOW = 8
SYMBOLS = "#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_upper", "n_punctuated")
_WORD = re.compile(WORD)


def repeated(words: list[str], span: int = WINDOW) -> int:
    """How many words lie in windows of ``span`` (a power of two) words that the text holds twice or more.

    Windows are numbered by doubling: equal numbers stand for equal runs of 1, 2, 4, ... words.
    """
    n = len(words)
    number: dict[str, int] = {}
    codes = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    if n <= span or len(number) == n:
        return 0
    width = 1
    while width < span:
        _, codes = np.unique(codes[:-width] * (codes.max() + 1) + codes[width:], return_inverse=True)
        width *= 2
    twice = np.bincount(codes)[codes] > 1
    steps = np.zeros(n + 1, np.int64)
    starts = np.flatnonzero(twice)
    np.add.at(steps, starts, 1)
    np.add.at(steps, starts + span, -1)
    return int((np.cumsum(steps[:-1]) > 0).sum())


def statistics(text: str | None) -> tuple[int, ...]:
    """The counts named in ``COUNTS``; all zero for a null text."""
    if not text:
        return (0,) * len(COUNTS)
    words = _WORD.findall(text)
    lines = [x for x in text.split("\n") if _WORD.search(x)]
    return (
        len(words),
        sum(map(len, words)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated(words),
        len(lines),
        len(set(words)),
        sum(map(str.isupper, words)),
        sum(1 for w in words if w[-1] in ".,;:!?"),
    )


def with_statistics(docs: DataFrame, text: str = "text", keep_text: bool = True) -> DataFrame:
    """Add the counts of ``COUNTS`` (bigint) for each whole text; columns of these names are replaced."""
    require(docs, text)
    kept = docs.select(*without(docs, COUNTS))
    require(kept, text)
    fields = [f for f in kept.schema.fields if keep_text or f.name != text]
    schema = T.StructType([*fields, *[T.StructField(c, T.LongType()) for c in COUNTS]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                found = np.array([statistics(t) for t in part.column(text).to_pylist()], np.int64).reshape(-1, len(COUNTS))
                arrays = [part.column(f.name) for f in fields] + [pa.array(found[:, i]) for i in range(len(COUNTS))]
                yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in schema.fields])

    return kept.mapInArrow(run, schema)


def features() -> dict[str, Column]:
    """What conditions are about: the statistics, made comparable between texts of any length."""
    share = lambda a, b: F.coalesce(F.col(a) / F.nullif(F.col(b), F.lit(0)), F.lit(0.0)).cast("double")
    return {
        "words": F.col("n_words").cast("double"),
        "chars_per_word": share("word_chars", "n_words"),
        "symbols_per_word": share("n_symbols", "n_words"),
        "repeated_line_share": share("n_dup_lines", "n_lines"),
        "repeated_word_share": share("n_repeat_words", "n_words"),
        "words_per_line": share("n_words", "n_lines"),
        "distinct_word_share": share("n_distinct", "n_words"),
        "upper_word_share": share("n_upper", "n_words"),
        "punctuated_word_share": share("n_punctuated", "n_words"),
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, x: np.ndarray, names: list[str]) -> np.ndarray:
        v = x[:, names.index(self.feature)]
        return v > self.threshold if self.above else v <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold!r}"


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]
    rejected: int = 0  # labelled rows it covered when it was learned
    kept: int = 0

    def covers(self, x: np.ndarray, names: list[str]) -> np.ndarray:
        out = np.ones(len(x), bool)
        for c in self.conditions:
            out &= c.holds(x, names)
        return out

    def expression(self, columns: dict[str, Column]) -> Column:
        out = F.lit(True)
        for c in self.conditions:
            v = columns[c.feature]
            out = out & ((v > c.threshold) if c.above else (v <= c.threshold))
        return out

    def __str__(self) -> str:
        return " and ".join(map(str, self.conditions))


@dataclass(frozen=True)
class DecisionList:
    rules: tuple[Rule, ...]

    def expression(self) -> Column:
        """The first rule that holds, as text; null if none does and the text is kept."""
        columns, out = features(), F.lit(None).cast("string")
        for rule in reversed(self.rules):
            out = F.when(rule.expression(columns), F.lit(str(rule))).otherwise(out)
        return out


def learn(
    x: np.ndarray, rejected: np.ndarray, names: list[str], seed: int = SEED, min_precision: float = 0.9,
    min_cover: int = 3, max_rules: int = 24, max_conditions: int = 4, cuts: int = 64,
) -> DecisionList:
    """Sequential covering over the rows of ``x``; without any rejected or kept rows the list is empty."""
    order = np.random.default_rng(seed).permutation(len(x))
    x, bad = x[order], rejected[order].astype(bool)
    growing = np.arange(len(x)) % 3 != 2
    rules: list[Rule] = []
    left = np.ones(len(x), bool)
    while len(rules) < max_rules:
        rule = _grown(x[left & growing], bad[left & growing], names, max_conditions, cuts)
        if rule is None:
            break
        rule = _pruned(rule, x[left & ~growing], bad[left & ~growing], names)
        covered = rule.covers(x, names) & left
        right, wrong = int((covered & bad).sum()), int((covered & ~bad).sum())
        if right < min_cover or right < min_precision * (right + wrong):
            break
        rules.append(Rule(rule.conditions, right, wrong))
        left &= ~covered
    return DecisionList(tuple(rules))


def _grown(x: np.ndarray, bad: np.ndarray, names: list[str], most: int, cuts: int) -> Rule | None:
    """Conditions by highest FOIL gain, until no kept row is covered or nothing is gained."""
    conditions: list[Condition] = []
    while len(conditions) < most:
        p, n = int(bad.sum()), int((~bad).sum())
        if not p or not n:
            break
        before, best = np.log2(p / (p + n)), (1e-9, None)
        for i, name in enumerate(names):
            v = x[:, i]
            values = np.unique(v)
            below = np.unique(np.searchsorted(values, np.quantile(v, np.linspace(0, 1, cuts + 1)[1:-1], method="lower")))
            for t in (values[below[below + 1 < len(values)]] + values[below[below + 1 < len(values)] + 1]) / 2:  # midway
                high = v > t
                p1, n1 = int((bad & high).sum()), int((~bad & high).sum())
                for above, p2, n2 in ((True, p1, n1), (False, p - p1, n - n1)):
                    if p2 and p2 + n2 < p + n:
                        gain = p2 * (np.log2(p2 / (p2 + n2)) - before)
                        if gain > best[0]:
                            best = (gain, Condition(name, above, float(t)))
        if best[1] is None:
            break
        conditions.append(best[1])
        covered = best[1].holds(x, names)
        x, bad = x[covered], bad[covered]
    return Rule(tuple(conditions)) if conditions else None


def _pruned(rule: Rule, x: np.ndarray, bad: np.ndarray, names: list[str]) -> Rule:
    """The first conditions of a rule for which (right - wrong) / covered is highest on other rows; the shortest among equals."""
    best, chosen = -2.0, rule
    for k in range(1, len(rule.conditions) + 1):
        some = Rule(rule.conditions[:k])
        covered = some.covers(x, names)
        right, wrong = int((covered & bad).sum()), int((covered & ~bad).sum())
        worth = (right - wrong) / (right + wrong) if right + wrong else -1.0
        if worth > best:
            best, chosen = worth, some
    return chosen


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", quality: str = "quality", max_labelled: int = MAX_LABELLED) -> DecisionList:
    """Learn the list from documents with a label (quality 0: rejected, 1: kept; null labels are passed over).

    Rows that ``base_failed`` rejects anyway teach nothing. Above ``max_labelled`` labelled keys, a share of them
    by hash is used. Several labels of one key count once, as the lowest; of a key with several documents at most
    ``KEY_TEXTS`` distinct texts teach, so neither the driver's rows nor the rules depend on how often a key occurs.
    """
    require(docs, key, text)
    require(labels, key, quality)
    clean = labels.filter(col(key).isNotNull() & col(quality).isNotNull()).groupBy(col(key).alias("_k")).agg(F.min(col(quality)).alias("_quality"))
    every = max(1, -(-clean.count() // max_labelled))
    some = clean.filter(F.pmod(F.xxhash64(F.lit(SEED), "_k"), F.lit(every)) == 0)
    rows = docs.select(col(key).alias("_id"), col(text).alias("_text")).join(small_side(some), F.col("_id") == F.col("_k"))
    rows = distinct_texts(rows, "_id", "_text", "_hash")
    counted = with_statistics(rows.select("_id", "_quality", "_text"), "_text", keep_text=False).filter(~base_failed())
    names = list(features())
    found = counted.select("_id", (F.col("_quality") == 0).cast("double").alias("_bad"), *[c.alias(n) for n, c in features().items()])
    sample = found.toPandas().sort_values(["_id", *names], kind="stable")
    return learn(sample[names].to_numpy(float).reshape(-1, len(names)), sample["_bad"].to_numpy() > 0, names)


def judged(docs: DataFrame, rules: DecisionList, text: str = "text", keep_text: bool = True) -> DataFrame:
    """Add the statistics, ``base_failed``, ``rule`` (the rule that rejects, else null) and ``kept``.

    A null or empty text has zero counts and fails the base. Long texts are read whole. Repeated rows fare alike,
    an empty table gives an empty result, and columns of the new names are replaced.
    """
    kept = docs.select(*without(docs, ["base_failed", "rule", "kept"]))
    counted = with_statistics(kept, text, keep_text)
    return counted.withColumns({"base_failed": base_failed(), "rule": rules.expression()}).withColumn(
        "kept", ~F.col("base_failed") & F.col("rule").isNull()
    )


def passing(docs: DataFrame, rules: DecisionList, text: str = "text") -> DataFrame:
    """The documents that are kept, with their own columns only (also where a name is one of the statistics)."""
    others = F.struct(F.lit(True).alias("_"), *[col(c).alias(f"c{i}") for i, c in enumerate(docs.columns) if c != text])
    done = judged(docs.select(others.alias("_row"), col(text).alias("_text")), rules, "_text").filter("kept")
    return done.select(*[(F.col("_text") if c == text else F.col("_row")[f"c{i}"]).alias(c) for i, c in enumerate(docs.columns)])
