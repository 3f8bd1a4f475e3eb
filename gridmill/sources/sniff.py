"""Delimiter, encoding and type inference as jobs over whole files."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridmill.functions import semantics as S
from gridmill.functions.semantics import col

# Separators that a delimited text file may use.
DELIMITERS = (",", ";", "\t", "|", ":")


def _lines(spark: SparkSession, path: str, first: int | None) -> DataFrame:
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value")
    return lines.limit(first) if first else lines


def files_of(spark: SparkSession, path: str) -> DataFrame:
    """(file): the files below a path that have a line."""
    return _lines(spark, path, None).select("file").distinct()


def sniff_delimiter(spark: SparkSession, path: str, first: int | None = None) -> DataFrame:
    """(file, delimiter, fields, share): the most consistent separator per file.

    Every line votes with its field count per candidate; text inside quotes does
    not count. ``first`` limits the look to that many lines, for one file.
    """
    bare = F.regexp_replace("value", '"[^"]*"', "")
    votes = F.array(
        *[F.struct(F.lit(i).alias("place"), F.lit(d).alias("delimiter"), F.size(F.split(bare, f"\\Q{d}\\E", -1)).alias("fields"))
          for i, d in enumerate(DELIMITERS)]
    )
    lines = _lines(spark, path, first).filter(F.length("value") > 0)
    counted = lines.select("file", F.inline(votes)).groupBy("file", "place", "delimiter", "fields").agg(F.count(F.lit(1)).alias("n"))
    per = counted.groupBy("file", "place", "delimiter").agg(
        F.max_by("fields", F.struct("n", "fields")).alias("fields"), (F.max("n") / F.sum("n")).alias("share")
    )
    # a separator that splits nothing is no candidate; then consistency, width, list order
    rank = F.struct((F.col("fields") > 1).alias("a"), F.col("share").alias("b"), F.col("fields").alias("c"), (-F.col("place")).alias("d"))
    return per.groupBy("file").agg(
        F.max_by(F.when(F.col("fields") > 1, F.col("delimiter")).otherwise(","), rank).alias("delimiter"),
        F.max_by("fields", rank).alias("fields"),
        F.round(F.max_by("share", rank), 4).alias("share"),
    )


# Single-byte code pages, the likelier first among equals.
CODE_PAGES = ("latin-1", "cp1252", "cp1250", "mac_roman", "cp437")
# Letters beyond a to z that written languages use often; the others count less.
_COMMON = frozenset("àáâãäåæçèéêëìíîïñòóôõöøùúûüýßœ" "ąćęłńśźż" "čďěňřšťůž" "őű" "ăâîșț" "đ")


def _page(name: str) -> str:
    """The characters of bytes 128 to 255; U+FFFD where a page has none."""
    return bytes(range(128, 256)).decode(name, "replace")


def _fitness(c: str, before: int) -> float:
    """How well a character fits after a small letter (``before`` 0), a capital (1) or anything else (2)."""
    kind = unicodedata.category(c)
    if c == "\ufffd":
        return -5.0
    if kind == "Cc":
        return -3.0
    if kind == "Ll":
        return (1.0 if before < 2 else 0.6) + (1.0 if c in _COMMON else -0.8)
    if kind == "Lu":
        return (-1.0 if before == 0 else 0.6) + (0.3 if c.lower() in _COMMON else -0.8)
    if kind == "Pi":
        return 1.5 if before == 2 else -0.5
    if kind == "Pf":
        return 1.5 if before < 2 else 0.4
    if kind == "Pd" or c in "…€°§":
        return 0.4
    return 0.0 if c == "\xa0" else -1.0


def _scores() -> np.ndarray:
    """Fitness by page, class of the byte before, and byte."""
    return np.array([[[_fitness(c, before) for c in _page(name)] for before in range(3)] for name in CODE_PAGES])


def _pairs(lines: DataFrame) -> DataFrame:
    """(file, counts): how often each byte from 128 on follows a small letter, a capital, or anything else, as 384 numbers a file."""
    kind = np.full(257, 2)  # 256: the beginning of a line
    kind[97:123], kind[65:91] = 0, 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            for file, line in zip(batch.column("file").to_pylist(), batch.column("raw").to_pylist(), strict=True):
                codes = np.frombuffer(line, np.uint8).astype(np.int64)
                before = np.append(256, codes[:-1])
                high = codes >= 128
                # a letter beyond ASCII is a letter too, whatever its case
                kinds = np.where(before >= 128, np.where(before == 256, 2, 0), kind[before])
                held[file] = held.get(file, 0) + np.bincount(kinds[high] * 128 + codes[high] - 128, minlength=384)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array([v.tolist() for v in held.values()], pa.list_(pa.int64()))], names=["file", "counts"])

    found = lines.select("file", F.col("value").cast("binary").alias("raw")).mapInArrow(count, "file string, counts array<bigint>")
    each = found.select("file", F.posexplode("counts").alias("at", "n")).filter("n > 0").groupBy("file", "at").agg(F.sum("n").alias("n"))
    return each.groupBy("file").agg(F.collect_list(F.struct("at", "n")).alias("pairs"))


def code_pages(lines: DataFrame) -> DataFrame:
    """(file, page) for files of (file, value) lines in a single-byte code page, told by what its high bytes would be in each page and what they follow.

    Tasks count pairs of byte classes and bytes; a file's sums are scored against a table for each page.
    """
    table = _scores().reshape(len(CODE_PAGES), -1)

    @F.pandas_udf("string")
    def best(pairs: pd.Series) -> pd.Series:
        names = []
        for own in pairs:
            score = sum(p["n"] * table[:, p["at"]] for p in own)
            names.append(CODE_PAGES[int(np.argmax(np.round(score, 6)))])
        return pd.Series(names)

    return _pairs(lines).select("file", best("pairs").alias("page"))


def sniff_encoding(spark: SparkSession, path: str, first: int | None = None) -> DataFrame:
    """(file, encoding) from the bytes of every line, in a splittable scan.

    A UTF-16 mark wins; then zero bytes mean UTF-16; plain or valid UTF-8 is UTF-8 (the line reader skips its
    mark); the others are in a single-byte code page (see ``code_pages``).
    """
    raw = F.col("value").cast("binary")
    hexed = F.hex(raw)
    lines = _lines(spark, path, first)
    facts = lines.select(
        "file",
        (hexed.startswith("FFFE") | hexed.startswith("FEFF")).alias("bom16"),
        # in little-endian text the second byte of a plain letter is zero
        F.regexp_like(hexed, F.lit("^(....)*..00")).alias("odd_zero"),
        F.regexp_like(hexed, F.lit("^(....)*00")).alias("even_zero"),
        F.is_valid_utf8("value").alias("utf8"),
    )
    seen = facts.groupBy("file").agg(
        F.max("bom16").alias("bom16"),
        F.count(F.when(F.col("odd_zero") & ~F.col("even_zero"), 1)).alias("le"),
        F.max(F.col("odd_zero") | F.col("even_zero")).alias("zeros"),
        F.min("utf8").alias("utf8"),
    )
    name = (
        F.when(F.col("bom16"), "utf-16")
        # a line break cuts a little-endian pair in two, so only some lines show
        # the zero in second place; big-endian text never does
        .when(F.col("zeros"), F.when(F.col("le") > 0, "utf-16-le").otherwise("utf-16-be"))
        .when(F.col("utf8"), "utf-8")
        .otherwise(F.coalesce("page", F.lit("latin-1")))
    )
    pages = code_pages(lines.filter(~F.is_valid_utf8("value"))).withColumnRenamed("file", "__f")
    return seen.join(pages, F.col("file") == F.col("__f"), "left").select("file", name.alias("encoding"))


def decoded(c: Column, page: str) -> Column:
    """Text that was read as Latin-1, as it is in another single-byte page; a byte that the page lacks stays as it is."""
    there = [(chr(128 + i), x) for i, x in enumerate(_page(page)) if x not in ("\ufffd", chr(128 + i))]
    return F.translate(c, "".join(a for a, _ in there), "".join(b for _, b in there))


def decoded_name(name: str, page: str) -> str:
    return "".join(x if x != "\ufffd" else c for c, x in ((c, _page(page)[ord(c) - 128] if 128 <= ord(c) < 256 else c) for c in name))


def typed(df: DataFrame) -> DataFrame:
    """Text columns cast to the narrowest type that fits all their values."""
    names = S.text_columns(df)
    if not names:
        return df
    kinds = ("bigint", "double", "boolean")
    # Spark also casts t, y, 1 and the like to boolean; only the two words are one
    fits = lambda c, k: F.lower(F.trim(col(c))).isin("true", "false") if k == "boolean" else col(c).try_cast(k).isNotNull()
    row = df.agg(
        *[F.count(col(c)).alias(f"n{i}") for i, c in enumerate(names)],
        *[F.count(F.when(fits(c, k), 1)).alias(f"{k}{i}") for i, c in enumerate(names) for k in kinds],
    ).first()
    chosen = {}
    for i, c in enumerate(names):
        for k in kinds:
            if row[f"n{i}"] and row[f"{k}{i}"] == row[f"n{i}"]:
                chosen[c] = k
                break
    return df.select(*[col(c).try_cast(chosen[c]).alias(c) if c in chosen else col(c) for c in df.columns])
