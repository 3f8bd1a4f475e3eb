"""Broadcasts that are backed by a measured size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 64 * 1024 * 1024


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` marked for broadcast if it is measured to be small.

    At most ``rows + 1`` rows are looked at. A larger side is returned as it is:
    the join then shuffles, and adaptive execution splits skewed keys.
    """
    return F.broadcast(df) if is_small(df, rows, size) else df


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    width = F.sum(F.length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))))
    found = df.limit(rows + 1).agg(F.count(F.lit(1)).alias("n"), F.coalesce(width, F.lit(0)).alias("w")).first()
    return found["n"] <= rows and found["w"] <= size
