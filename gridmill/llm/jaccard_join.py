"""Joining documents whose sets of word n-grams are similar, with Bayesian pruning of candidates.

A text's set holds the hashes of its runs of five words. Documents with equal sets form a copy class,
which goes on as one set. MinHash values, in bands, bring sets into buckets; sets that share a bucket are
candidates. In a bucket the values of two sets are compared a few at a time. After n comparisons with m
matches, similarity has the posterior Beta(m + 1, n - m + 1); a pair whose posterior probability of reaching
the threshold is below the tolerance is dropped. The rest is verified on the whole sets.

A pair is never a row. Buckets are worked on as blocks against blocks of bounded size, in numpy, in two passes: the first sees
signatures only and names the sets with a partner left; the second gets the grams of those, in smaller blocks. A pair
belongs to the first band that both sets share, so it counts once, and a set's grams go to few of its buckets. A block returns for
each of its sets the number of its links and one link of a spanning forest. What moves grows with the sets, not with pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridmill.functions.joins import small_side
from gridmill.functions.semantics import col, require
from gridmill.llm.common import WORD, fresh, without, written
from gridmill.llm.pieces import slices

WORDS = 5
THRESHOLD = 0.8
BANDS, ROWS = 21, 3  # a pair at 0.8 shares no band with probability 3e-7
HASHES = BANDS * ROWS
STEP = 9  # values compared between two looks at the posterior
TOLERANCE = 1e-7
BLOCK_SETS = 2000
BLOCK_GRAMS = 500_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _coefficients() -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(20240)
    odd = draw.integers(0, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return odd, draw.integers(0, 2**63, HASHES, dtype=np.uint64)


def grams(text: str | None, n: int = WORDS) -> np.ndarray:
    """The sorted distinct hashes of a text's runs of ``n`` words; a shorter text is one run; none without a word."""
    import re

    import xxhash

    words = re.findall(WORD, text) if text else []
    if not words:
        return np.empty(0, np.uint64)
    hashed = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    width = min(n, len(words))
    code = np.full(len(words) - width + 1, width, np.uint64)
    for i in range(width):
        code = code * _MIX + hashed[i : len(hashed) - width + 1 + i]
        code ^= code >> np.uint64(32)
    return np.unique(code)


def signature(codes: np.ndarray, odd: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """The MinHash values of a set, as 32-bit numbers."""
    least = np.full(len(odd), np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(codes), 2048):
        part = codes[start : start + 2048, None] * odd + shift
        np.minimum(least, part.min(axis=0), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def sets(docs: DataFrame, text: str, n: int = WORDS, with_grams: bool = False) -> DataFrame:
    """The columns but ``text``, and ``set_id`` (128 bits, null without a word), ``n_grams``, ``signature``; with ``grams`` if asked for."""
    fields = [f for f in docs.schema.fields if f.name != text]
    added = [
        T.StructField("set_id", T.BinaryType()), T.StructField("n_grams", T.IntegerType()), T.StructField("signature", T.BinaryType()),
    ] + [T.StructField("grams", T.BinaryType())] * with_grams

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        odd, shift = _coefficients()
        for batch in batches:
            for part in slices(batch, text):
                found = [grams(t, n) for t in part.column(text).to_pylist()]
                arrays = [part.column(f.name) for f in fields]
                arrays.append(pa.array([xxhash.xxh128_digest(c.tobytes()) if len(c) else None for c in found], pa.binary()))
                arrays.append(pa.array([len(c) for c in found], pa.int32()))
                arrays.append(pa.array([signature(c, odd, shift).tobytes() if len(c) else None for c in found], pa.binary()))
                if with_grams:
                    arrays.append(pa.array([c.tobytes() for c in found], pa.binary()))
                yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in [*fields, *added]])

    return docs.mapInArrow(run, T.StructType([*fields, *added]))


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> list[tuple[int, int]]:
    """For each number n of compared values, the fewest matches m with which a pair goes on.

    With a uniform prior, the posterior probability of a similarity of at least t is that of at most m
    successes in n + 1 draws of probability t.
    """
    out = []
    for n in [*range(STEP, HASHES, STEP), HASHES]:
        tail, m = 0.0, 0
        while m <= n:
            tail += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if tail >= tolerance:
                break
            m += 1
        out.append((n, m))
    return out


class Partners:
    """The sets of one block, or of two blocks, of a bucket, by their signatures."""

    def __init__(self, signatures: pa.ChunkedArray, sizes: np.ndarray, blocks: np.ndarray, pair: tuple[int, int], band: int, threshold: float):
        self.values = np.frombuffer(b"".join(signatures.to_pylist()), np.uint32).reshape(-1, HASHES)
        self.keys = self.values.reshape(-1, BANDS, ROWS)
        self.sizes, self.blocks, self.pair, self.band, self.threshold = sizes.astype(np.int64), blocks, pair, band, threshold
        self.checks = least_matches(threshold)

    def __iter__(self) -> Iterator[tuple[int, np.ndarray]]:
        """(a, others) for each set with candidates left, each pair once: those that the posterior keeps and that this band owns."""
        low, high = self.pair
        everyone, sizes, values = np.arange(len(self.sizes)), self.sizes, self.values
        far = everyone[self.blocks == high]
        for a in everyone[self.blocks == low].tolist():
            others = everyone[a + 1 :] if low == high else far
            # a set's share of the larger set bounds the similarity
            others = others[np.minimum(sizes[others], sizes[a]) >= self.threshold * np.maximum(sizes[others], sizes[a]) - 1e-9]
            matches, done = np.zeros(len(others), np.int64), 0
            for n, fewest in self.checks:
                if not len(others):
                    break
                matches = matches + (values[others, done:n] == values[a, done:n]).sum(axis=1)
                others, matches, done = others[matches >= fewest], matches[matches >= fewest], n
            if len(others):
                same = (self.keys[others] == self.keys[a]).all(axis=2)
                others = others[same.argmax(axis=1) == self.band]  # the first shared band owns the pair
            if len(others):
                yield a, others


def compare(ids: list, gram_sets: pa.ChunkedArray, copies: np.ndarray, partners: Partners) -> tuple[list, list, list, list]:
    """The links among ``partners``.

    Returns for each linked set: its id, the documents and the sets it is linked with here, and the smallest id of
    those that it is connected with here.
    """
    m, sizes, threshold = len(ids), partners.sizes, partners.threshold
    starts = np.concatenate([[0], np.cumsum(sizes)])
    codes, held = None, None
    docs_linked, sets_linked, root = np.zeros(m, np.int64), np.zeros(m, np.int64), list(range(m))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a, others in partners:
        if codes is None:
            whole = pa.chunked_array(gram_sets.chunks, pa.binary()).combine_chunks()
            first, last = np.frombuffer(whole.buffers()[1], np.int32)[[whole.offset, whole.offset + m]].tolist()
            distinct, codes = np.unique(np.frombuffer(whole.buffers()[2], np.uint64, (last - first) // 8, first), return_inverse=True)
            codes, held = codes.astype(np.int32), np.zeros(len(distinct), bool)
            del distinct, whole
        own = codes[starts[a] : starts[a + 1]]
        held[own] = True
        rows = np.concatenate([codes[starts[j] : starts[j + 1]] for j in others])
        common = np.add.reduceat(held[rows], np.concatenate([[0], np.cumsum(sizes[others])[:-1]]), dtype=np.int64)
        held[own] = False
        linked = others[common >= threshold * (sizes[a] + sizes[others] - common) - 1e-9]
        docs_linked[a] += copies[linked].sum()
        sets_linked[a] += len(linked)
        docs_linked[linked] += copies[a]
        sets_linked[linked] += 1
        for j in linked:
            x, y = top(a), top(j)
            if x != y:
                x, y = (x, y) if ids[x] < ids[y] else (y, x)
                root[y] = x
    some = np.flatnonzero(sets_linked)
    return [ids[i] for i in some], docs_linked[some].tolist(), sets_linked[some].tolist(), [ids[top(i)] for i in some]


def classes_of(members: DataFrame) -> DataFrame:
    """One row for each set: its first document (``first``), number of documents, size and signature."""
    first = F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("hash"))
    return (
        members.filter("set_id IS NOT NULL")
        .groupBy("set_id")
        .agg(F.min(first).alias("first"), F.count(F.lit(1)).alias("copies"), F.first("n_grams").alias("n_grams"), F.first("signature").alias("signature"))
    )


def buckets_of(classes: DataFrame) -> DataFrame:
    """(bucket, band, set_id, n_grams): the sets that share a bucket; of buckets with the same sets only that of the first band stays."""
    cut = F.transform(
        F.sequence(F.lit(0), F.lit(BANDS - 1)),
        lambda b: F.struct(b.cast("tinyint").alias("band"), F.xxhash64(b, F.substring(F.col("signature"), b * (4 * ROWS) + 1, F.lit(4 * ROWS))).alias("bucket")),
    )
    bands = classes.select("set_id", "n_grams", F.explode(cut).alias("_b")).select("set_id", "n_grams", "_b.*")
    shared = bands.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("bucket")
    met = written(bands.join(shared, "bucket"), "jaccard-buckets")
    alike = met.groupBy("bucket").agg(
        F.min("band").alias("band"), F.count(F.lit(1)).alias("n"),
        F.bit_xor(F.xxhash64("set_id")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "set_id")).alias("y"),
    )
    first = alike.groupBy("n", "x", "y").agg(F.min(F.struct("band", "bucket"))["bucket"].alias("bucket"))
    return met.join(first.select("bucket"), "bucket").select("bucket", "band", "set_id", "n_grams")


def in_blocks(rows: DataFrame, by_grams: bool) -> DataFrame:
    """(bucket, band, set_id, n_grams, block, low, high): a bucket of n sets is cut in g blocks, and a set goes to the g pairs of blocks that its own is part of."""
    n, w = F.count(F.lit(1)), F.sum(F.col("n_grams").cast("bigint"))
    parts = F.greatest(F.ceil(n / BLOCK_SETS), F.ceil(w / BLOCK_GRAMS)) if by_grams else F.ceil(n / BLOCK_SETS)
    sizes = rows.groupBy("bucket").agg(parts.cast("int").alias("parts"))
    block = F.pmod(F.xxhash64(F.lit(2), "set_id"), F.col("parts")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.struct(F.least(F.col("block"), j).alias("low"), F.greatest(F.col("block"), j).alias("high")))
    cut = rows.join(sizes, "bucket").withColumn("block", block).withColumn("pair", F.explode(pairs))
    return cut.select("bucket", "band", "set_id", "n_grams", "block", "pair.low", "pair.high")


def _partners(group: pa.Table, threshold: float) -> Partners:
    pair = (group["low"][0].as_py(), group["high"][0].as_py())
    return Partners(group["signature"], group["n_grams"].to_numpy(), group["block"].to_numpy(), pair, group["band"][0].as_py(), threshold)


def candidates_of(rows: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(bucket, band, set_id, n_grams): the sets that still have a partner in their bucket when signatures are compared. No grams are moved for this."""

    def run(group: pa.Table) -> pa.Table:
        left = np.zeros(group.num_rows, bool)
        for a, others in _partners(group, threshold):
            left[a] = True
            left[others] = True
        return group.select(["bucket", "band", "set_id", "n_grams"]).filter(pa.array(left))

    found = rows.groupBy("bucket", "low", "high").applyInArrow(run, "bucket bigint, band tinyint, set_id binary, n_grams int")
    return found.dropDuplicates(["bucket", "set_id"])


def links_of(rows: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Compare the whole sets of each pair of blocks: (set_id, docs, sets, root) for each linked set."""

    def run(group: pa.Table) -> pa.Table:
        out = compare(group["set_id"].to_pylist(), group["grams"], group["copies"].to_numpy(), _partners(group, threshold))
        types = (pa.binary(), pa.int64(), pa.int64(), pa.binary())
        return pa.table([pa.array(v, t) for v, t in zip(out, types, strict=True)], names=["set_id", "docs", "sets", "root"])

    return rows.groupBy("bucket", "low", "high").applyInArrow(run, "set_id binary, docs bigint, sets bigint, root binary")


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for each node of a connected component but its smallest, the root.

    Rounds of large-star and small-star, each written to the shared folder, until nothing changes.
    """
    high, low = F.greatest(col(a), col(b)).alias("high"), F.least(col(a), col(b)).alias("low")
    now = written(edges.select(high, low).filter("high != low").distinct(), "jaccard-edges")
    state = _state(now)
    while state[0]:
        both = now.select(F.col("high").alias("u"), F.col("low").alias("v")).unionByName(now.select(F.col("low").alias("u"), F.col("high").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("high"), F.col("m").alias("low")).distinct()
        smallest = large.groupBy("high").agg(F.min("low").alias("m"))
        small = large.join(smallest, "high").select(F.explode(F.array(F.struct("high", F.col("m").alias("low")), F.struct(F.col("low").alias("high"), F.col("m").alias("low")))).alias("e"))
        now = written(small.select("e.*").filter("high != low").distinct(), "jaccard-edges")
        before, state = state, _state(now)
        if before == state:
            break
    return now.select(F.col("high").alias("node"), F.col("low").alias("root"))


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("high", "low"))).first())


def grouped(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = WORDS, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(members, classes): the documents as (id, hash of the text, set_id), and each set with its links and group.

    ``classes`` has set_id, first (its first document: none, id, hash), copies, ``docs`` and ``sets`` linked with it,
    and ``head``, the first document of its group.
    """
    require(docs, key, text)
    rows = docs.select(col(key).alias("id"), F.xxhash64(col(text)).alias("hash"), col(text).alias("text"))
    members = written(sets(rows, "text", n), "jaccard-members")
    classes = written(classes_of(members), "jaccard-classes")
    met = in_blocks(written(buckets_of(classes), "jaccard-met"), by_grams=False)
    left = written(candidates_of(met.join(classes.select("set_id", "signature"), "set_id"), threshold), "jaccard-candidates")
    wanted = classes.join(left.select("set_id").distinct(), "set_id", "left_semi")
    firsts = small_side(wanted.select(F.col("first.id").alias("_id"), F.col("first.hash").alias("_hash")))
    texts = rows.join(firsts, rows["id"].eqNullSafe(F.col("_id")) & (rows["hash"] == F.col("_hash")), "left_semi")
    whole = sets(texts.select("text"), "text", n, with_grams=True).dropDuplicates(["set_id"]).select("set_id", "signature", "grams")
    whole = written(whole.join(classes.select("set_id", "copies"), "set_id"), "jaccard-grams")
    found = links_of(in_blocks(left, by_grams=True).join(whole, "set_id"), threshold)
    found = written(found, "jaccard-links")
    counts = found.groupBy("set_id").agg(F.sum("docs").alias("docs"), F.sum("sets").alias("sets"))
    groups = components(found, "set_id", "root")
    known = (
        classes.drop("signature", "n_grams")
        .join(counts, "set_id", "left")
        .join(groups.withColumnRenamed("node", "set_id"), "set_id", "left")
        .withColumn("root", F.coalesce("root", "set_id"))
    )
    known = written(known, "jaccard-known")
    heads = known.groupBy("root").agg(F.min("first").alias("head"))
    return members.select("id", "hash", "set_id"), known.join(heads, "root")


def join(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each document: its group, its copy class, and its links.

    * ``class_id``: the smallest key in its group of documents connected by links.
    * ``copy_id``: the smallest key among the documents with the same set.
    * ``n_links``: other documents with a similarity of ``threshold`` or more, copies included.
    * ``n_set_links``: other sets among them.

    A null or empty text, or one without a word, has no set: it is alone, its ids are its own key. A text shorter
    than ``n`` words is one run. Repeated rows are copies of each other. Documents with a null key come last among a group's,
    so an id is null only if all keys of the group are. An empty table gives an empty result. Other columns of ``docs`` play no part.
    """
    members, classes = grouped(docs, key, text, n, threshold)
    known = classes.select(
        F.col("set_id").alias("_set"), F.col("head.id").alias("class_id"), F.col("first.id").alias("copy_id"),
        (F.col("copies") - 1 + F.coalesce("docs", F.lit(0))).alias("n_links"), F.coalesce("sets", F.lit(0)).alias("n_set_links"),
    )
    alone = F.col("set_id").isNull()
    return members.join(known, F.col("set_id") == F.col("_set"), "left").select(
        F.col("id").alias(key),
        F.when(alone, F.col("id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(alone, F.col("id")).otherwise(F.col("copy_id")).alias("copy_id"),
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        F.coalesce("n_set_links", F.lit(0)).cast("bigint").alias("n_set_links"),
    )


def first_of_group(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """The documents without all but the first, by key, of each group of ``join``; null keys come last.

    Documents without a word all stay; rows with equal key and text stay once.
    """
    members, classes = grouped(docs, key, text, n, threshold)
    heads = classes.select(F.col("set_id").alias("_set"), F.col("head.id").alias("_head"), F.col("head.hash").alias("_head_hash"))
    follows = ~(F.col("id").eqNullSafe(F.col("_head")) & F.col("hash").eqNullSafe(F.col("_head_hash")))
    dropped = members.join(heads, F.col("set_id") == F.col("_set")).filter(follows).select(F.col("id").alias("_id"), F.col("hash").alias("_hash")).distinct()
    dropped = small_side(written(dropped, "jaccard-dropped"))
    mark = fresh(docs.columns, "_text_hash")
    marked = docs.withColumn(mark, F.xxhash64(col(text)))
    left = marked.join(dropped, col(key).eqNullSafe(F.col("_id")) & (col(mark) == F.col("_hash")), "left_anti")
    if not members.groupBy("id", "hash").count().filter("count > 1").isEmpty():
        left = left.dropDuplicates([key, mark])
    return left.select(*without(docs, [mark]))
