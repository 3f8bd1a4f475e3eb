"""Small helpers that the text operators share."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridmill.functions.semantics import col
from gridmill.session import scratch_path

#: A word: a run of characters other than the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
KEY_TEXTS = 4  # texts of one labelled key that models learn from, at most


def fresh(taken: Iterable[str], base: str) -> str:
    """``base``, with underscores put before it until no column has that name (case is ignored)."""
    names = {t.lower() for t in taken}
    while base.lower() in names:
        base = "_" + base
    return base


def without(df: DataFrame, names: Sequence[str]) -> list[Column]:
    """The columns of ``df`` but for ``names``: results replace columns of the same name."""
    gone = {n.lower() for n in names}
    return [col(c) for c in df.columns if c.lower() not in gone]


def words_of(text: Column) -> Column:
    """The words of a text, null taken as empty."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({WORD})"), F.lit(1))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def distinct_texts(rows: DataFrame, key: str, text: str, mark: str, most: int = KEY_TEXTS) -> DataFrame:
    """Rows of distinct key and text, at most ``most`` a key, the first by the hash of the text, which is added as ``mark``.

    Each task keeps at most ``most`` rows of a key before they meet, so a key may have any share of the rows.
    """
    once = rows.withColumn(mark, F.xxhash64(col(text))).dropDuplicates([key, mark])
    nth = fresh(once.columns, "_nth")
    numbered = once.withColumn(nth, F.row_number().over(Window.partitionBy(col(key)).orderBy(col(mark))))
    return numbered.filter(col(nth) <= most).drop(nth)


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a Parquet table below ``spark.checkpoint.dir``.

    It cuts lineage like ``checkpoint()`` and lets later stages read single columns.
    """
    spark: SparkSession = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
