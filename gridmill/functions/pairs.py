"""Correlations of many column pairs in one pass.

A pair counts the rows where both sides are present, so every pair has its own
count, sums and products. Over Arrow batches these are four small matrix
products; as single aggregates they would be hundreds of columns and outgrow
generated code.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridmill.functions.semantics import col


def pair_sums(df: DataFrame, columns: Sequence[str]) -> np.ndarray:
    """Four k-by-k matrices: count, sum of x, sum of x², sum of xy, each over
    the rows where both columns of the cell are present.

    Columns are shifted by their means first, so the plain sums stay accurate.
    Each task emits one folded row; ``4 k²`` numbers reach the driver.
    """
    k = len(columns)
    numbers = [col(c).cast("double") for c in columns]
    head = df.agg(*[F.avg(v).alias(f"m{i}") for i, v in enumerate(numbers)]).first()
    center = np.array([head[i] if head[i] is not None else 0.0 for i in range(k)], dtype=float)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((4, k, k))
        for pdf in batches:
            x = pdf.to_numpy(dtype=float) - center
            here = np.isfinite(x)
            x = np.where(here, x, 0.0)
            m = here.astype(float)
            sums += np.stack([m.T @ m, x.T @ m, (x * x).T @ m, x.T @ x])
        yield pd.DataFrame({"s": [sums.ravel()]})

    parts = df.select(*[v.alias(f"v{i}") for i, v in enumerate(numbers)]).mapInPandas(fold, "s array<double>")
    total = parts.select(F.posexplode("s").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(4 * k * k)
    for r in total:
        out[r["i"]] = r["v"]
    return out.reshape(4, k, k)


def correlations(df: DataFrame, columns: Sequence[str]) -> np.ndarray:
    """Pearson correlations of all pairs; NaN where a side does not vary."""
    return correlations_from(pair_sums(df, columns))


def correlations_from(sums: np.ndarray) -> np.ndarray:
    n, sx, sxx, sxy = sums
    with np.errstate(divide="ignore", invalid="ignore"):
        spread = sxx - sx * sx / n
        varies = spread > 1e-12 * sxx
        r = (sxy - sx * sx.T / n) / np.sqrt(spread * spread.T)
    return np.where((n > 1) & varies & varies.T, r, np.nan)
