"""Passages that repeat, found by overlapping windows of three lines.

Every three consecutive lines of a document that hold a word are one window; lines without a word
are passed over. A window's two 64-bit hashes stand for it. Windows found more than once in the
whole corpus keep their first occurrence, by document id and then position; each later one
covers its three lines, and the covered lines of a document go together. A line outside any
repeated window stays, however often it occurs alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridmill.functions.semantics import col, require
from gridmill.llm.common import WORD, fresh, without

SPAN = 3


def windows(docs: DataFrame, key: str, text: str, span: int = SPAN) -> DataFrame:
    """One row for each window: key, ``_text`` (hash of the document's text), ``_at`` (number of its first line among those with a word), ``_a``, ``_b``."""
    lines = F.filter(F.split(col(text), "\n"), lambda line: line.rlike(WORD))
    pairs = F.transform(lines, lambda line: F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit(1), line).alias("b")))
    part = lambda i, side: [F.get(F.col("_lines"), i + n)[side] for n in range(span)]
    starts = F.when(F.size("_lines") >= span, F.sequence(F.lit(0), F.size("_lines") - span))
    return (
        docs.select(col(key).alias("_key"), F.xxhash64(col(text)).alias("_text"), pairs.alias("_lines"))
        .select(
            "_key", "_text",
            F.explode(F.transform(starts, lambda i: F.struct(
                i.alias("_at"), F.xxhash64(*part(i, "a")).alias("_a"), F.xxhash64(*part(i, "b")).alias("_b")
            ))).alias("_w"),
        )
        .select("_key", "_text", "_w.*")
    )


def repeats(found: DataFrame, span: int = SPAN) -> DataFrame:
    """Covered lines by document, as arrays of first and last line of each later occurrence.

    Occurrences are counted per task before the shuffle. The join has one row a window on one side,
    so a window that fills a third of the rows is split by adaptive execution.
    """
    place = F.struct(F.col("_key").isNull().alias("none"), F.col("_key").alias("key"), F.col("_text").alias("text"), F.col("_at").alias("at"))
    first = (
        found.groupBy("_a", "_b").agg(F.count(F.lit(1)).alias("_n"), F.min(place).alias("_first")).filter("_n > 1").drop("_n")
    )
    own = F.col("_first.key").eqNullSafe(F.col("_key")) & (F.col("_first.text") == F.col("_text"))
    past = F.when(own, F.greatest(F.col("_at"), F.col("_first.at") + span)).otherwise(F.col("_at"))
    return (
        found.join(first, ["_a", "_b"])
        .filter(~(own & (F.col("_first.at") == F.col("_at"))))
        .groupBy("_key", "_text")
        .agg(F.collect_set(F.struct(past.alias("from"), (F.col("_at") + span - 1).alias("to"))).alias("_covered"))
    )


def dedup_lines(
    docs: DataFrame, key: str = "doc_id", text: str = "text", span: int = SPAN,
    removed: str = "removed_lines", counted: str = "n_lines",
) -> DataFrame:
    """The documents without later occurrences of repeated windows of ``span`` lines.

    ``text`` loses the covered lines; ``removed`` lists their numbers (from 0, lines without a word
    included in the count) and ``counted`` is the number of lines before. Where two occurrences overlap in one
    document, the first keeps its lines. Rows with equal key and text are one document and fare alike. A null text stays
    null with 0 lines; a text of fewer than ``span`` lines with a word is unchanged; a document that loses
    every line keeps an empty text. Null keys come last among first occurrences. An empty table gives an empty
    result, and columns of the new names are replaced.
    """
    require(docs, key, text)
    kept = docs.select(*without(docs, [removed, counted]))
    require(kept, key, text)
    names = list(kept.columns)
    hashed, id_, text_, covered, cut = (fresh(names, n) for n in ("_hash", "_key", "_text", "_covered", "_cut"))
    later = repeats(windows(kept, key, text, span), span).select(
        F.col("_key").alias(id_), F.col("_text").alias(text_), F.col("_covered").alias(covered)
    )
    marked = kept.withColumn(hashed, F.xxhash64(col(text)))
    joined = marked.join(later, col(key).eqNullSafe(col(id_)) & (col(hashed) == col(text_)), "left")
    touched = col(covered).isNotNull()
    joined = joined.withColumn(cut, without_lines(F.when(touched, col(text)), col(covered)["from"], col(covered)["to"]))
    lines = F.coalesce(F.size(F.split(col(text), "\n")), F.lit(0))
    return joined.select(
        *[F.when(touched, col(cut)["text"]).otherwise(col(text)).alias(c) if c == text else col(c) for c in names],
        F.when(touched, col(cut)["gone"]).otherwise(F.array().cast("array<int>")).alias(removed),
        F.when(col(text).isNull(), 0).otherwise(lines).cast("bigint").alias(counted),
    )


@F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("gone", T.ArrayType(T.IntegerType()))]))
def without_lines(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    """The text without the lines of the given ranges, and the numbers of those lines; null text where nothing is to be cut."""
    for texts, firsts, lasts in parts:
        out = [(None, None) if t is None else cut_lines(t, f, z) for t, f, z in zip(texts, firsts, lasts, strict=True)]
        yield pd.DataFrame(out, columns=["text", "gone"])


def cut_lines(text: str, firsts, lasts) -> tuple[str, list[int]]:
    import re

    word = re.compile(WORD)
    covered = {n for a, z in zip(firsts, lasts, strict=True) for n in range(a, z + 1)}
    keep, gone, at = [], [], 0
    for number, line in enumerate(text.split("\n")):
        if word.search(line):
            if at in covered:
                gone.append(number)
            else:
                keep.append(line)
            at += 1
        else:
            keep.append(line)
    return "\n".join(keep), gone


SQL = r"""
WITH texts AS (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL),
lines AS (
  SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS number FROM texts
),
worded AS (
  SELECT doc_id, text, line, number, row_number() OVER (PARTITION BY doc_id, text ORDER BY number) - 1 AS pos
  FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
),
three AS (
  SELECT doc_id, text, pos, line AS a, lead(line) OVER w AS b, lead(line, 2) OVER w AS c
  FROM worded WINDOW w AS (PARTITION BY doc_id, text ORDER BY pos)
),
ranked AS (
  SELECT doc_id, text, pos, row_number() OVER w AS nth, first_value(doc_id) OVER w AS d1, first_value(text) OVER w AS t1, first_value(pos) OVER w AS pos1
  FROM three WHERE c IS NOT NULL WINDOW w AS (PARTITION BY a, b, c ORDER BY doc_id, text, pos)
),
covered AS (
  SELECT DISTINCT doc_id, text, unnest(range(CASE WHEN doc_id = d1 AND text = t1 THEN greatest(pos, pos1 + 3) ELSE pos END, pos + 3)) AS pos
  FROM ranked WHERE nth > 1
),
marked AS (
  SELECT l.doc_id, l.text, l.line, l.number, c.pos IS NOT NULL AS gone
  FROM lines l LEFT JOIN worded w ON l.doc_id = w.doc_id AND l.text = w.text AND l.number = w.number
  LEFT JOIN covered c ON w.doc_id = c.doc_id AND w.text = c.text AND w.pos = c.pos
),
done AS (
  SELECT doc_id, text, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed,
    coalesce(string_agg(number::VARCHAR, ',' ORDER BY number) FILTER (gone), '') AS removed,
    coalesce(string_agg(line, chr(10) ORDER BY number) FILTER (NOT gone), '') AS kept
  FROM marked GROUP BY doc_id, text
)
SELECT d.doc_id, coalesce(x.n_lines, 0) AS n_lines, coalesce(x.n_removed, 0) AS n_removed, coalesce(x.removed, '') AS removed, sha256(x.kept) AS text_sha256
FROM documents d LEFT JOIN done x ON d.doc_id = x.doc_id AND d.text = x.text
"""


def digests(done: DataFrame, key: str = "doc_id", text: str = "text") -> list[Column]:
    """The columns of ``SQL`` from the result of ``dedup_lines``."""
    return [
        col(key), F.col("n_lines"), F.size("removed_lines").cast("bigint").alias("n_removed"),
        F.concat_ws(",", F.col("removed_lines").cast("array<string>")).alias("removed"), F.sha2(col(text), 256).alias("text_sha256"),
    ]
