"""Exact duplicates, through an extendible-hash index on shared files.

Texts are equal when they are identical after each run of ASCII white space became one space. A text's key is its 64-bit
hash; the leading bits of the key choose a cell of the directory, and the cell names a bucket. While a bucket
holds more links than it may, it is split by one more bit of its keys, and the directory doubles where its depth does
not reach that far. Directory, links and bucket contents are tables in the shared folder.

A link is a key with the sha256 of a text; links of one key are chained. For each key with more than one row, the rows' texts
are counted by their bytes: copies collapse in each task before they meet, so a text may fill any share of the table. Tasks own ranges
of buckets and keys; they chain the texts of each key, and hold their counts against those of the links.

Only DataFrame functions are used. ``dedup`` and ``unique`` are the entry points.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil, log2

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridmill.functions.joins import small_side
from gridmill.functions.semantics import col, require
from gridmill.llm.common import written

SPACE = r"[\x20\x09-\x0D]+"
CAPACITY = 100_000  # links in a bucket
HOT_SHARE = 1000  # a key with more than this part of all rows is hot: there are fewer than 1000 of them


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def key_of(text: Column, bits: int = 64) -> Column:
    """The key of a text that is already normalised; fewer ``bits`` leave the last ones 0."""
    return F.xxhash64(text) if bits == 64 else F.shiftleft(F.shiftrightunsigned(F.xxhash64(text), 64 - bits), 64 - bits)


def _cell(key: Column, depth: int) -> Column:
    """The number that the first ``depth`` bits of a key make."""
    return F.shiftrightunsigned(key, 64 - depth) if depth else F.lit(0).cast("bigint")


@dataclass(frozen=True)
class Index:
    """The tables of an index.

    * ``rows``: one row for each document: ``_id``, ``_row``, ``_key``, ``_sha`` and, in ``_doc``, the columns carried along.
    * ``links``: ``_key``, ``_sha``, ``n`` (rows), ``first`` (none, id, row of the first one), ``bucket``.
    * ``directory``: ``cell`` -> ``bucket`` (its first cell), ``depth`` (of the bucket), ``links``; cells of empty buckets are left out.
    * ``buckets``: the links with more than one row, by bucket and key: ``bucket``, ``_key``, ``link`` (place in the chain), ``_sha``, ``n``, ``first``, ``text``.
    """

    rows: DataFrame
    links: DataFrame
    directory: DataFrame
    buckets: DataFrame
    depth: int
    total: int


def split(links: DataFrame, capacity: int) -> tuple[DataFrame, int]:
    """(directory, its depth) for links with a column ``_key``.

    It begins with as many cells as buckets are needed. Buckets above ``capacity`` are split bit by bit; one
    whose links all have the same key is not, it is a longer chain.
    """
    least = max(1, ceil(links.count() / capacity))
    depth, left, done = ceil(log2(least)), links.select("_key"), []
    while True:
        sizes = left.groupBy(_cell(F.col("_key"), depth).alias("cell")).agg(
            F.count(F.lit(1)).alias("links"), F.min("_key").alias("low"), F.max("_key").alias("high")
        )
        sizes = written(sizes.withColumn("depth", F.lit(depth)), "index-sizes")
        full = (F.col("links") > capacity) & (F.col("low") != F.col("high"))
        done.append(sizes.filter(~full).select("cell", "depth", "links"))
        over = sizes.filter(full).select("cell")
        if over.isEmpty():
            break
        left = left.join(small_side(over), _cell(F.col("_key"), depth) == F.col("cell"), "left_semi")
        depth += 1
    buckets = done[0]
    for more in done[1:]:
        buckets = buckets.unionByName(more)
    first = F.col("cell") * F.pow(F.lit(2), depth - F.col("depth")).cast("bigint")
    last = first + F.pow(F.lit(2), depth - F.col("depth")).cast("bigint") - 1
    cells = buckets.select(F.explode(F.sequence(first, last)).alias("cell"), first.alias("bucket"), "depth", "links")
    return written(cells, "index-directory"), depth


def build(docs: DataFrame, key: str = "doc_id", text: str = "text", carry: bool = False, capacity: int = CAPACITY, bits: int = 64) -> Index:
    """The index of all rows; ``carry`` takes the columns of ``docs`` along."""
    require(docs, key, text)
    flat = normalised(col(text))
    carried = [F.struct(*[col(c) for c in docs.columns]).alias("_doc")] if carry else []
    named = docs.select(col(key).alias("_id"), flat.alias("_text"), *carried)
    # the numbers hold because the table is written before anything is read from it
    rows = named.select(
        "_id", F.monotonically_increasing_id().alias("_row"), key_of(F.col("_text"), bits).alias("_key"), F.sha2("_text", 256).alias("_sha"), *(["_doc"] if carry else []),
    )
    rows = written(rows, "index-rows")
    first = F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("_row").alias("row"))
    links = written(rows.groupBy("_key", "_sha").agg(F.count(F.lit(1)).alias("n"), F.min(first).alias("first")), "index-links")
    directory, depth = split(links, capacity)
    home = links.withColumn("cell", _cell(F.col("_key"), depth)).join(small_side(directory.select("cell", "bucket")), "cell").drop("cell")
    home = written(home, "index-places")
    total = rows.count()

    # the keys whose rows have to be compared; the hot ones are fewer than HOT_SHARE, whatever the table
    many = home.groupBy("_key", "bucket").agg(F.sum("n").alias("n")).filter("n > 1")
    hot = F.col("n") * HOT_SHARE > total
    texts = docs.select(flat.alias("text")).withColumn("_key", key_of(F.col("text"), bits))
    hot_keys = F.broadcast(many.filter(hot).select("_key", "bucket"))
    met = texts.join(hot_keys, "_key").unionByName(texts.join(small_side(many.filter(~hot).select("_key", "bucket")), "_key"))
    same = met.groupBy("bucket", "_key", "text").agg(F.count(F.lit(1)).alias("found"))
    named = same.withColumn("_sha", F.sha2("text", 256)).join(small_side(home.filter("n > 1").drop("bucket")), ["_key", "_sha"])
    owned = named.repartitionByRange("bucket", "_key")
    place = F.row_number().over(Window.partitionBy("bucket", "_key").orderBy("first")) - 1
    wrong = F.raise_error(F.concat(F.lit("texts with equal key and sha256 differ: "), F.col("_sha"))).cast("bigint")
    chained = owned.select(
        "bucket", "_key", place.alias("link"), "_sha", F.when(F.col("found") == F.col("n"), F.col("n")).otherwise(wrong).alias("n"), "first", "text"
    )
    buckets = written(chained.sortWithinPartitions("bucket", "_key", "link"), "index-buckets")
    return Index(rows, home, directory, buckets, depth, total)


def placed(index: Index) -> DataFrame:
    """The rows of an index with ``keep_id``, ``group_size`` and ``kept``."""
    copies = index.buckets.select(F.col("_key").alias("_k"), F.col("_sha").alias("_s"), "n", "first")
    hot = F.col("n") * HOT_SHARE > index.total
    same = (F.col("_key") == F.col("_k")) & (F.col("_sha") == F.col("_s"))
    few = F.broadcast(copies.filter(hot))
    rest = copies.filter(~hot)
    # rows of hot texts are answered by the broadcast, so the other join has no hot key
    held = index.rows.join(few, same, "left")
    answered = held.filter("_k IS NOT NULL")
    open_rows = held.filter("_k IS NULL").drop("_k", "_s", "n", "first")
    found = answered.unionByName(open_rows.join(small_side(rest), same, "left"))
    alone = F.col("n").isNull()
    return found.withColumns({
        "keep_id": F.when(alone, F.col("_id")).otherwise(F.col("first.id")),
        "group_size": F.coalesce("n", F.lit(1)).cast("bigint"),
        "kept": F.when(alone, True).otherwise(F.col("first.row") == F.col("_row")),
    }).drop("_k", "_s", "n", "first")


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, bits: int = 64) -> DataFrame:
    """One row for each row: its key, ``keep_id`` (key of the row that stays), ``group_size``, ``kept`` and ``text_sha256`` (of the normalised text).

    Of equal texts the row with the smallest key stays, null keys come last; of repeated rows with that key exactly one stays. A null text
    counts as empty, and all empty texts are equal; texts of white space only are equal to a single space. Very long
    texts are compared whole. An empty table gives an empty result. Other columns of ``docs`` play no part. Should two different texts
    have one key and one sha256, the job stops.
    """
    done = placed(build(docs, key, text, capacity=capacity, bits=bits))
    return done.select(F.col("_id").alias(key), "keep_id", "group_size", "kept", F.col("_sha").alias("text_sha256"))


def unique(docs: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """The rows of ``docs`` that ``dedup`` keeps, with all their columns as they are."""
    done = placed(build(docs, key, text, carry=True, capacity=capacity))
    return done.filter("kept").select(*[F.col("_doc")[c].alias(c) for c in docs.columns])


#: The same rows in DuckDB.
SQL = """
WITH flat AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS t FROM documents
)
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = min(doc_id) OVER same AS kept, sha256(t) AS text_sha256
FROM flat
WINDOW same AS (PARTITION BY t)
"""
