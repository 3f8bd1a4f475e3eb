"""Fingerprints of documents as homomorphic multiset hashes.

A paragraph (a line with a word) is hashed to a wide vector, and a document's vector is the sum of its
paragraphs' vectors, each lane modulo 2^32. So the order of paragraphs does not matter, equal
multisets of paragraphs have equal sums, and a paragraph is put in or taken out by one addition or
subtraction (``added``, ``removed``) without the rest of the text.

Lanes, in this order:

* ``EXACT`` lanes, hashed from the paragraph as a whole. They tell multisets apart.
* one lane with the number of word windows.
* ``SIGNS`` lanes, in which every window of three words of the paragraph adds +1 or -1 by one
  bit of its hash. The scalar product of two such vectors estimates the number of windows shared, so
  ``likeness`` is near the cosine of the two texts' windows, with an error of about 1 / sqrt(SIGNS).
  A text has fewer than 2^31 windows, so no lane wraps, also if one window is repeated throughout.

Everything is a DataFrame expression. Bits of the windows' hashes are counted seven at a time, in fields
of 9 bits of one long, over slices of 511 windows, so no field can run over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridmill.functions.semantics import col, require
from gridmill.llm.common import WORD, fresh, without
from gridmill.session import pinned

EXACT = 16
FIELD, FIELDS = 9, 7
SIGNS = FIELDS * FIELD
WINDOW = 3
SLICE = (1 << FIELD) - 1  # windows at most
_WIDE = 1 << 32
PART_ROWS = 500_000  # ids that one task puts in order
_BLANKS = " \t\n\x0b\x0c\r"  # what separates words
_FIRST_BITS = sum(1 << f * FIELD for f in range(FIELDS))


def _paragraphs(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda p: p.rlike(WORD))


def _windows(paragraph: Column) -> Column:
    """Hashes of a paragraph's windows of three words; a shorter paragraph is one window."""
    return F.transform(
        F.sequence(F.lit(0), F.greatest(F.size(paragraph) - WINDOW, F.lit(0))),
        lambda i: F.xxhash64(*[F.get(paragraph, i + n) for n in range(WINDOW)]),
    )


def _total(values: Column, of) -> Column:
    return F.aggregate(values, F.lit(0).cast("bigint"), lambda a, x: a + of(x))


def with_vector(df: DataFrame, text: Column, name: str) -> DataFrame:
    """Add the vector of a text (null: empty) as an array of bigint."""
    parts, worded, hashes, slices = (fresh(df.columns, n) for n in ("_paragraphs", "_worded", "_hashes", "_slices"))
    step = df.withColumn(parts, _paragraphs(text))
    # words in a column of their own: inside the lambda they would be looked for again at each window
    step = step.withColumn(worded, F.transform(col(parts), lambda p: F.split(F.btrim(p, F.lit(_BLANKS)), f"[{_BLANKS}]+")))
    step = step.withColumn(hashes, F.flatten(F.transform(col(worded), _windows)))
    step = step.withColumn(
        slices,
        F.transform(F.sequence(F.lit(0), F.floor(F.size(hashes) / SLICE).cast("int")), lambda s: F.slice(col(hashes), s * SLICE + 1, SLICE)),
    )
    exact = [
        _total(col(parts), lambda p, n=n, up=up: F.shiftrightunsigned(F.xxhash64(F.lit(n), p), up).bitwiseAND(F.lit(_WIDE - 1)))
        for n in range(EXACT // 2)
        for up in (0, 32)
    ]
    ones = F.transform(  # by slice, for each bit of a field: the counts in all fields
        col(slices),
        lambda s: F.transform(
            F.array(*[F.lit(b) for b in range(FIELD)]),
            lambda bit: F.aggregate(
                s, F.lit(0).cast("bigint"), lambda a, x: a + F.call_function("shiftright", x, bit).bitwiseAND(F.lit(_FIRST_BITS))
            ),
        ),
    )
    counted = fresh(df.columns, "_ones")
    step = step.withColumn(counted, ones)
    count = F.size(hashes).cast("bigint")
    signs = [
        F.pmod(2 * _total(col(counted), lambda o, f=f, b=b: F.shiftright(F.get(o, F.lit(b)), f * FIELD).bitwiseAND(F.lit((1 << FIELD) - 1))) - count, F.lit(_WIDE))
        for f in range(FIELDS)
        for b in range(FIELD)
    ]
    vector = F.array(*[F.pmod(e, F.lit(_WIDE)) for e in exact], F.pmod(count, F.lit(_WIDE)), *signs)
    return step.withColumn(name, vector).drop(parts, worded, hashes, slices, counted)


def added(vector: Column, other: Column) -> Column:
    """The vector of both multisets together."""
    return F.zip_with(vector, other, lambda a, b: F.pmod(a + b, F.lit(_WIDE)))


def removed(vector: Column, other: Column) -> Column:
    """The vector without the paragraphs of ``other``."""
    return F.zip_with(vector, other, lambda a, b: F.pmod(a - b, F.lit(_WIDE)))


def printed(vector: Column) -> Column:
    """A vector as hexadecimal text, 8 digits a lane: all that ``added``, ``removed`` and ``likeness`` need."""
    return F.array_join(F.transform(vector, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")


def parsed(fingerprint: Column) -> Column:
    """The vector that a printed form stands for."""
    lanes = F.sequence(F.lit(0), F.lit(EXACT + SIGNS))
    return F.transform(lanes, lambda i: F.conv(F.substring(fingerprint, 8 * i + 1, F.lit(8)), 16, 10).cast("bigint"))


def likeness(vector: Column, other: Column) -> Column:
    """From 0 to 1: the estimated cosine of two texts' word windows; 1 for equal vectors."""
    # as doubles: squares of long texts' lanes do not add up in a bigint
    signed = lambda v: F.transform(
        F.slice(v, EXACT + 2, SIGNS), lambda x: F.when(x >= _WIDE // 2, x - _WIDE).otherwise(x).cast("double")
    )
    dot = lambda u, v: F.aggregate(F.zip_with(signed(u), signed(v), lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    scale = F.sqrt(dot(vector, vector) * dot(other, other))
    cosine = F.when(scale > 0, dot(vector, other) / scale).otherwise(F.lit(0.0))
    return F.when(vector == other, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), cosine)))


def fingerprint(docs: DataFrame, text: str = "text", vector: str = "vector", printed_as: str = "fingerprint") -> DataFrame:
    """Add the vector of each whole text and its printed form, row by row.

    A null or empty text, or one without a word, has the zero vector. Very long texts are summed whole.
    Repeated rows fare alike, an empty table gives an empty result, columns of the new names are replaced.
    """
    require(docs, text)
    kept = docs.select(*without(docs, [vector, printed_as]))
    require(kept, text)
    return with_vector(kept, col(text), vector).withColumn(printed_as, printed(col(vector)))


def followers(keys: DataFrame, order: list[Column], names: list[str]) -> DataFrame:
    """Each distinct row of ``keys`` with the columns ``names`` of the next one in ``order`` as ``next_<name>``.

    After the last comes the first. Rows are range-partitioned and pinned; a partition's last row gets the
    first one of the next partition that has rows, of which there is one for each partition.
    """
    part = fresh(keys.columns, "_part")
    once = pinned(keys.distinct())
    n = 1 + once.count() // PART_ROWS
    laid = pinned(once.repartitionByRange(n, *order).withColumn(part, F.spark_partition_id()))
    row = F.struct(*[col(c) for c in names])
    inside = Window.partitionBy(part).orderBy(*order)
    heads = laid.withColumn("_nth", F.row_number().over(inside)).filter("_nth = 1").select(col(part).alias("_p"), row.alias("_head"))
    by_part = Window.orderBy("_p")
    ring = heads.select("_p", F.coalesce(F.lead("_head").over(by_part), F.first("_head").over(by_part)).alias("_next_head"))
    led = laid.withColumn("_led", F.lead(row).over(inside)).join(F.broadcast(ring), col(part) == F.col("_p"))
    following = F.coalesce(F.col("_led"), F.col("_next_head"))
    return led.select(*[col(c) for c in keys.columns], *[following[c].alias(f"next_{c}") for c in names])


def edited_fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text, and likenesses; one row for each document.

    The edited text has the last floor(n/2) code points replaced by the first as many (or all) of the
    next document's, by rising key, null keys last; rows with equal key and text are one document, and
    documents of equal key stand in the order of a hash. After the last comes the first; a lone document follows
    itself. Null texts count as empty.

    Only ids and lengths are sorted. The texts move twice: once by key, with their vectors, which both
    joins use, and once as the halves that the documents before them ask for.
    """
    require(docs, key, text)
    whole = F.coalesce(col(text), F.lit(""))
    rows = docs.select(
        col(key).alias("id"), whole.alias("text"), F.xxhash64(col(key), whole).alias("k1"), F.xxhash64(F.lit(1), col(key), whole).alias("k2")
    )
    ids = rows.select("id", "k1", "k2", F.floor(F.length("text") / 2).cast("int").alias("half"))
    ring = followers(ids, [F.col("id").asc_nulls_last(), F.col("k1"), F.col("k2")], ["k1", "k2"])
    asked = ring.select("half", F.col("k1").alias("a1"), F.col("k2").alias("a2"), F.col("next_k1").alias("k1"), F.col("next_k2").alias("k2"))
    known = with_vector(rows, F.col("text"), "vector")
    given = (
        known.join(asked, ["k1", "k2"])
        .groupBy(F.col("a1").alias("k1"), F.col("a2").alias("k2"))
        .agg(F.first(F.struct(F.substring(F.col("text"), F.lit(1), F.col("half")).alias("half"), "vector", "id")).alias("following"))
    )
    n = F.length("text")
    both = known.join(given, ["k1", "k2"]).withColumn(
        "edited", F.concat(F.substring(F.col("text"), F.lit(1), n - F.floor(n / 2).cast("int")), F.col("following.half"))
    )
    done = with_vector(both, F.col("edited"), "edited_vector")
    return done.select(
        F.col("id").alias(key),
        n.cast("bigint").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        printed(F.col("vector")).alias("fingerprint"),
        printed(F.col("edited_vector")).alias("edited_fingerprint"),
        likeness(F.col("vector"), F.col("edited_vector")).alias("near_edited"),
        likeness(F.col("vector"), F.col("following.vector")).alias("near_next"),
        F.col("following.id").alias("next_id"),  # also keeps both joins on one exchange of the same columns
    )
