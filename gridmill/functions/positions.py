"""Row positions and look-back windows without a one-task sort.

A plain ``row_number`` or ``lag`` puts a whole group in one task. Here rows are
range-partitioned by (keys, order), pinned to the shared folder so that the
partition layout cannot change between the two passes, counted per partition
and numbered locally with an offset.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridmill.functions.semantics import col
from gridmill.session import pinned

SMALL_GROUP_ROWS = 1_000_000
BLOCK_ROWS = 200_000


def largest_group(df: DataFrame, keys: Sequence[str]) -> int:
    if not keys:
        return df.count()
    return df.groupBy(*[col(k) for k in keys]).count().agg(F.max("count")).first()[0] or 0


def with_position(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "pos", spread: Column | None = None
) -> DataFrame:
    """Add the 0-based position of each row within its key, in ``order``.

    ``order`` must be total. Groups below ``SMALL_GROUP_ROWS`` use one window;
    larger ones use range partitions and offsets.
    """
    key_cols = [col(k) for k in keys]
    if largest_group(df, keys) <= SMALL_GROUP_ROWS:
        w = Window.partitionBy(*key_cols).orderBy(*order) if keys else Window.orderBy(*order)
        return df.withColumn(name, (F.row_number().over(w) - 1).cast("bigint"))
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = pinned(
        df.repartitionByRange(n, *key_cols, *order).withColumn("__part", F.spark_partition_id())
    )
    sizes = laid.groupBy(*key_cols, "__part").agg(F.count(F.lit(1)).alias("__size"))
    before = Window.partitionBy(*key_cols).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *[col(k).alias(f"__k{i}") for i, k in enumerate(keys)],
        F.col("__part").alias("__op"),
        F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__offset"),
    )
    same = [col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)] + [F.col("__part") == F.col("__op")]
    local = Window.partitionBy(*key_cols, "__part").orderBy(*order)
    numbered = laid.withColumn("__rn", F.row_number().over(local))
    return numbered.join(offsets, same, "inner").select(
        *[col(c) for c in df.columns], (F.col("__offset") + F.col("__rn") - 1).cast("bigint").alias(name)
    )


def look_back(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    reach: int,
    build: Callable[[object], dict[str, Column]],
) -> DataFrame:
    """Add columns computed over the current row and up to ``reach`` rows before it.

    ``build`` receives a window spec and returns the new columns. Small groups
    use the plain window; large ones are cut in blocks, each given the last
    ``reach`` rows of the block before it.
    """
    key_cols = [col(k) for k in keys]
    if largest_group(df, keys) <= SMALL_GROUP_ROWS:
        w = Window.partitionBy(*key_cols).orderBy(*order) if keys else Window.orderBy(*order)
        return df.withColumns(build(w))
    placed = with_position(df, keys, order, name="__pos").withColumn("__block", F.floor(F.col("__pos") / BLOCK_ROWS))
    in_tail = (F.col("__pos") % BLOCK_ROWS) >= BLOCK_ROWS - reach
    copies = F.when(in_tail, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    spread = placed.withColumn("__ahead", F.explode(copies)).withColumn("__b", F.col("__block") + F.col("__ahead"))
    w = Window.partitionBy(*key_cols, "__b").orderBy("__pos")
    new = build(w)
    return (
        spread.withColumns(new)
        .filter(F.col("__ahead") == 0)
        .select(*[col(c) for c in df.columns if c not in new], *[col(c) for c in new])
    )


def running_total(df: DataFrame, order: Column, value: str, name: str = "running") -> DataFrame:
    """Add the running sum of ``value`` in the total order ``order``.

    Large inputs are summed per block of positions, and each block starts from
    the sum of the blocks before it.
    """
    if df.count() <= SMALL_GROUP_ROWS:
        w = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumn(name, F.sum(col(value)).over(w))
    placed = with_position(df, [], [order], name="__pos").withColumn("__block", F.floor(F.col("__pos") / BLOCK_ROWS))
    sums = placed.groupBy("__block").agg(F.sum(col(value)).alias("__sum"))
    before = Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(F.col("__block").alias("__b"), F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__start"))
    inside = Window.partitionBy("__block").orderBy("__pos").rowsBetween(Window.unboundedPreceding, 0)
    return (
        placed.join(starts, F.col("__block") == F.col("__b"), "inner")
        .withColumn(name, F.col("__start") + F.sum(col(value)).over(inside))
        .select(*[col(c) for c in df.columns], col(name))
    )
