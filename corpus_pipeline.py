"""From raw documents to encoded training text, in five stages.

Each stage takes what the one before it kept, as written and read again, and returns the columns of
``documents``; the last returns digests of the encoded texts. ``labels`` is read for the quality rules only.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridmill.llm import jaccard_join, line_dedup, mixing, quality_rules
from gridmill.llm.common import written
from gridmill.llm.queries import piece_digests
from gridmill.llm.registry import table


def _as_before(done: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs``, with ``n_chars`` for the text as it is now; null stays null."""
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return done.select(*docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that fail the base or a learned rule. Texts without 20 words, null ones too, fail."""
    rules = quality_rules.fit(docs, table(spark, sf_dir, "labels"))
    return quality_rules.passing(docs, rules)


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts later occurrences of repeated three-line windows; every document stays, if with an empty text."""
    return _as_before(line_dedup.dedup_lines(docs), docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first document of each group of similar ones, and all that have no word."""
    return jaccard_join.first_of_group(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for each time that a document is taken, cut where a quota ends; texts without words are not taken."""
    return _as_before(mixing.mixed_rows(mixing.mix(docs)), docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids and decoded text of each row, as digests."""
    return piece_digests(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality),
    ("line dedup", repeated_lines),
    ("near copies", near_copies),
    ("mixing", mixture),
    ("sentencepiece", encoded),
]
#: The first stage is learned and the last is a library's encoding, so no SQL gives these rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    def step(docs: DataFrame, at: int) -> DataFrame:
        name, stage = STAGES[at]
        out = stage(spark, docs, sf_dir)
        return out if at == len(STAGES) - 1 else written(out, name.replace(" ", "-"))

    return functools.reduce(step, range(len(STAGES)), table(spark, sf_dir, "documents"))
