"""Mixing sources to target weights by Sainte-Laguë apportionment.

The mix is made of blocks of equally many words. Blocks are seats: a source with target t gets
its next seat by the quotient t / (2k + 1), k being the seats it has, and the highest quotients
win. The seats of a source are dealt in the same way to its shards, by their sizes. A shard then
fills its own seats: its documents stand in a seeded order, and the blocks from the front of
that order are taken, over and over if the quota is above the shard's size.

Sources of any size and number work. Equal rows are counted before anything is ordered, and then only hashes and sizes of
distinct records move: those of one shard of one source meet in a task, and a shard has about ``SHARD_WORDS`` words. Sources, and
the shards of a source, are ranked by positions that large groups get from range partitions. Texts stay where they are unless
the records are too many to broadcast. Quotients are not listed from the first seat on. A seat count lies within m / (2n) of its
exact share for m takers and n seats in all, so only the quotients near the share are ranked, about four for each taker.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridmill.functions.joins import small_side
from gridmill.functions.positions import running_total, with_position
from gridmill.functions.semantics import SEED, col, require
from gridmill.llm.common import WORD, fresh, without, word_count, written

WEIGHTS = (5, 2, 1)
SHARE = 1.5
TIMES = 2
SHARD_WORDS = 500_000
BLOCK_WORDS = 64
BROADCAST_BYTES = 16 * 1024 * 1024  # of what is known of the records; beyond that texts are shuffled to it


def apportion(takers: DataFrame, group: Sequence[str], votes: str, seats: str, tie: Sequence[str], quota: str = "quota") -> DataFrame:
    """Add each taker's seats by highest quotients among the takers of its ``group``, whose columns hold no null.

    ``seats`` holds the group's number of seats on each of its rows; ``tie`` orders equal quotients and
    must identify a taker within its group. Takers without votes get no seat.
    """
    def by_group(rows: DataFrame, **sums: Column) -> DataFrame:
        found = rows.groupBy(*group).agg(*[c.alias(n) for n, c in sums.items()])
        return rows.join(small_side(found), list(group))

    x = F.col(votes) * F.col(seats) / F.col("_votes")
    slack = F.col("_takers") / (2 * F.col(seats))
    some = (F.col(votes) > 0) & (F.col(seats) > 0)
    bounds = (
        by_group(takers, _votes=F.sum(votes), _takers=F.count_if(F.col(votes) > 0))
        .withColumn("_low", F.when(some, F.greatest(F.lit(0), F.floor(x * (1 - slack) + 0.5) - 1)).otherwise(0).cast("bigint"))
        .withColumn("_high", F.when(some, F.floor(x * (1 + slack) + 0.5) + 2).otherwise(0).cast("bigint"))
    )
    bounds = by_group(bounds, _given=F.sum("_low"))
    near = bounds.withColumn("_k", F.explode_outer(F.when(F.col("_high") > F.col("_low"), F.sequence(F.col("_low"), F.col("_high") - 1))))
    near = near.withColumn("_quotient", F.col(votes) / (2 * F.col("_k") + 1))
    ranked = with_position(near, group, [F.col("_quotient").desc_nulls_last(), *[col(t) for t in tie], F.col("_k")], name="_rank")
    won = (F.col("_k").isNotNull() & (F.col("_rank") < F.col(seats) - F.col("_given"))).cast("bigint")
    return ranked.groupBy(*[col(c) for c in takers.columns]).agg((F.first("_low") + F.sum(won)).alias(quota))


def targets(sizes: DataFrame, source: str, weights: Sequence[float] = WEIGHTS, share: float = SHARE, times: float = TIMES) -> DataFrame:
    """Each source's number, weight and target words, from its ``source_size``.

    Sources stand by code point, null last, and weigh ``weights`` in turn. They share ``share`` times all
    words by weight; a target stops at ``times`` its source's size and the others share what is over. The
    sources that stop are those of the smallest size for their weight, so one sorted pass finds them.
    """
    cap = F.col("source_size") * F.lit(float(times))
    numbered = with_position(sizes, [], [col(source).isNull(), col(source)], name="_at").withColumn("source_no", (F.col("_at") + 1).cast("int")).drop("_at")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("source_no") - 1) % len(weights) + 1)
    known = written(numbered.withColumn("weight", weight).withColumn("_room", cap / F.col("weight")), "mix-sources")
    whole = known.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    pool, all_weights = float(whole["size"] or 0) * share, float(whole["weight"] or 0)
    order = F.struct("_room", "source_no")
    capped = running_total(running_total(known.withColumn("_cap", cap), order, "_cap", "_caps"), order, "weight", "_weights")
    # what is left for this source and those with more room, by weight
    each = (F.lit(pool) - F.col("_caps") + F.col("_cap")) / (F.lit(all_weights) - F.col("_weights") + F.col("weight"))
    shared = written(capped.withColumn("_each", each).withColumn("_stops", F.col("_room") <= F.col("_each")), "mix-levels")
    level = shared.agg(F.max(F.when(~F.col("_stops"), F.col("_each")))).first()[0]
    target = F.when(F.col("_stops"), cap).otherwise(F.col("weight") * F.lit(level).cast("double"))
    return shared.withColumn("target", target).drop("_room", "_cap", "_caps", "_weights", "_each", "_stops")


def mix(
    docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
    weights: Sequence[float] = WEIGHTS, share: float = SHARE, times: int = TIMES,
    shard_words: int = SHARD_WORDS, block_words: int = BLOCK_WORDS, seed: int = SEED,
) -> DataFrame:
    """Add ``size`` (words), ``source_size``, ``target`` (its source's) and ``taken`` (words the mix takes, repeats counted).

    ``taken`` is a multiple of the size but for the one document at the end of a shard's quota, which is
    taken in part. A null or empty text has size 0 and nothing is taken of it; a very long text is one document like any, taken whole or up to
    the quota's end. A null source is a source of its own, the last. Null keys are allowed. Repeated rows, equal in all columns (maps aside), are taken one by
    one; which of them comes first cannot be told. Documents are ordered by a 128-bit hash, so no two differ and tie. An empty table gives an empty
    result, and columns of the new names are replaced. The same rows give the same mix, in any order.
    Blocks are made smaller than ``block_words`` if the smallest target would have under 50 of them.
    """
    require(docs, key, text, source)
    new = ("size", "source_size", "target", "taken")
    kept = docs.select(*without(docs, new))
    require(kept, key, text, source)
    names = list(kept.columns)
    a, b = (fresh([*names, *new], n) for n in ("_record_a", "_record_b"))  # 128 bits that name a record: rows that are equal in all columns
    told = [e for f in kept.schema.fields if not isinstance(f.dataType, T.MapType) for e in (col(f.name), col(f.name).isNull())]
    sized = kept.withColumns({"size": word_count(col(text)), a: F.xxhash64(F.lit(seed), *told), b: F.xxhash64(F.lit(seed + 1), *told)})
    records = sized.groupBy(col(source).alias("source"), "size", col(a).alias("a"), col(b).alias("b")).agg(F.count(F.lit(1)).alias("times"))
    records = written(records, "mix-records")
    by_source = records.groupBy("source").agg(F.sum(F.col("size") * F.col("times")).alias("source_size"))
    planned = targets(by_source, "source", weights, share, times)
    cells_of = F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words)).cast("bigint")
    planned = written(planned.withColumn("_cells", cells_of), "mix-targets")
    found = planned.agg(F.sum("target").alias("all"), F.min(F.when(F.col("target") > 0, F.col("target"))).alias("least")).first()
    block = max(1, min(block_words, int((found["least"] or 0) // 50)))
    seats = F.lit(round((found["all"] or 0) / block)).cast("bigint")
    sources = apportion(planned.withColumns({"_one": F.lit(1), "_seats": seats}), ["_one"], "target", "_seats", ["source_no"])
    sources = small_side(written(sources.select(F.col("source").alias("name"), "source_no", "source_size", "target", "_cells", "quota"), "mix-quotas"))

    homed = records.join(sources, F.col("source").eqNullSafe(F.col("name"))).withColumn("_cell", F.pmod(F.col("a"), F.col("_cells")))
    cells = homed.groupBy("source_no", "_cell").agg(F.sum(F.col("size") * F.col("times")).alias("_words"), F.first("quota").alias("_seats"))
    cells = apportion(cells, ["source_no"], "_words", "_seats", ["_cell"]).select(
        "source_no", "_cell", "_words", F.least(F.col("quota") * block, F.col("_words") * times).alias("_quota")
    )
    order = Window.partitionBy("source_no", "_cell").orderBy("a", "b").rowsBetween(Window.unboundedPreceding, 0)
    words = F.col("size") * F.col("times")
    ahead = homed.withColumn("_from", F.sum(words).over(order) - words).join(small_side(cells), ["source_no", "_cell"])
    whole = F.when(F.col("_words") > 0, F.floor(F.col("_quota") / F.col("_words"))).otherwise(0)
    # of what the last round takes, the words that fall on this record's rows, the first of them first
    rest = F.greatest(F.lit(0), F.least(words, F.col("_quota") - whole * F.col("_words") - F.col("_from")))
    taken = ahead.select(
        F.col("a").alias("_a"), F.col("b").alias("_b"), "times", F.col("source_size").alias("_all"), F.col("target").alias("_target"), whole.alias("_whole"), rest.alias("_rest")
    )
    joined = sized.join(small_side(written(taken, "mix-taken"), size=BROADCAST_BYTES), (col(a) == F.col("_a")) & (col(b) == F.col("_b")))
    result = lambda rows, nth: rows.select(
        *[col(c) for c in names], "size", F.col("_all").alias("source_size"), F.col("_target").alias("target"),
        (F.col("_whole") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), F.col("_rest") - nth * F.col("size")))).cast("bigint").alias("taken"),
    )
    once = result(joined.filter("times = 1"), F.lit(0))
    if records.filter("times > 1").isEmpty():
        return once
    return once.unionByName(result(_numbered(joined.filter("times > 1")), F.col("_nth")))


def _numbered(rows: DataFrame) -> DataFrame:
    """Rows with ``_nth`` (0, 1 …) among those of the same record, counted by part of the table first, so that no record's rows meet in one task."""
    held = written(rows.withColumn("_part", F.spark_partition_id()), "mix-copies")
    inside = Window.partitionBy("_a", "_b", "_part").orderBy(F.lit(0))
    parts = held.groupBy("_a", "_b", "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_a", "_b").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select(F.col("_a").alias("_sa"), F.col("_b").alias("_sb"), F.col("_part").alias("_sp"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    local = held.withColumn("_here", F.row_number().over(inside) - 1)
    same = (F.col("_a") == F.col("_sa")) & (F.col("_b") == F.col("_sb")) & (F.col("_part") == F.col("_sp"))
    return local.join(small_side(starts), same).withColumn("_nth", F.col("_start") + F.col("_here"))


def mixed_rows(mixed: DataFrame, text: str = "text") -> DataFrame:
    """The mix itself: a row for each time that a document of ``mix`` is taken, cut after the words taken of it.

    The text of a whole copy is unchanged; of a part, it ends with the last word taken. A row with a null ``taken``, ``size`` or text, or of
    which nothing is taken, gives no row; nor does an empty table. Other columns stay as they are.
    """
    mixed = mixed.filter((F.col("taken") > 0) & col(text).isNotNull())
    copies = F.floor(F.col("taken") / F.greatest(F.col("size"), F.lit(1)))
    parts = F.col("taken") % F.greatest(F.col("size"), F.lit(1))
    with_space = F.regexp_extract_all(col(text), F.lit(rf"([\x20\x09-\x0D]*{WORD})"), F.lit(1))
    first = F.array_join(F.slice(with_space, F.lit(1), parts.cast("int")), "")
    rows = F.concat(
        F.array_repeat(col(text), copies.cast("int")), F.when(parts > 0, F.array(first)).otherwise(F.array().cast("array<string>"))
    )
    return mixed.withColumn(text, F.explode(rows))
