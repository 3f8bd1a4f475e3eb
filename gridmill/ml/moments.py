"""Second moments of a vector column in one distributed pass.

Every task folds its Arrow batches into one small matrix per group and emits its upper triangle in
blocks; blocks are summed by key, and only ``groups * d * d / 2`` numbers are brought to the driver.
Linear models, discriminants, covariances and SVD all start from these.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_WIDTH = 2_000  # a d-by-d matrix must fit the driver comfortably
BLOCK_VALUES = 32_768  # of the matrix in one row


def as_array(c: Column | str = "features") -> Column:
    return vector_to_array(c if isinstance(c, Column) else F.col(c))


def grouped_gram(
    df: DataFrame, vector: Column, group: Column | None = None, weight: Column | None = None
) -> dict[object, np.ndarray]:
    """``{group: sum of w * z z'}`` with ``z = [vector…, 1]``.

    The last row and column therefore hold the weighted sums and the count.
    The number of groups (classes) is expected to be small.
    """
    flat = df.select(
        (group if group is not None else F.lit(0)).cast("double").alias("g"),
        (weight if weight is not None else F.lit(1.0)).cast("double").alias("w"),
        vector.alias("z"),
    )

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[float, np.ndarray] = {}
        for pdf in batches:
            if pdf.empty:
                continue
            z = np.stack(pdf["z"].to_numpy())
            if z.shape[1] > MAX_WIDTH:
                raise ValueError(f"{z.shape[1]} features exceed the limit of {MAX_WIDTH}")
            z = np.hstack([z, np.ones((len(z), 1))])
            w, g = pdf["w"].to_numpy(), pdf["g"].to_numpy()
            for value in np.unique(g):
                hit = g == value
                part = (z[hit] * w[hit, None]).T @ z[hit]
                sums[value] = sums[value] + part if value in sums else part
        for value, m in sums.items():
            flat = m[np.triu_indices(len(m))]
            for k in range(0, len(flat), BLOCK_VALUES):
                yield pd.DataFrame({"g": [value], "block": [k // BLOCK_VALUES], "m": [flat[k : k + BLOCK_VALUES].tobytes()]})

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple[float, int], np.ndarray] = {}
        for pdf in batches:
            for g, block, m in zip(pdf["g"], pdf["block"], pdf["m"], strict=True):
                sums[g, block] = sums.get((g, block), 0.0) + np.frombuffer(m)
        if sums:
            yield pd.DataFrame([(g, block, m.tobytes()) for (g, block), m in sums.items()], columns=["g", "block", "m"])

    # the matrix is symmetric: its upper triangle is summed, cut in blocks, which tasks add up side by side
    schema = "g double, block int, m binary"
    found = flat.mapInPandas(fold, schema).repartition("g", "block").mapInPandas(add, schema).collect()
    out: dict[object, np.ndarray] = {}
    for g in sorted({r["g"] for r in found}):
        values = np.concatenate([np.frombuffer(r["m"]) for r in sorted((r for r in found if r["g"] == g), key=lambda r: r["block"])])
        size = int((np.sqrt(8 * len(values) + 1) - 1) / 2)
        m = np.zeros((size, size))
        m[np.triu_indices(size)] = values
        out[g] = m + np.triu(m, 1).T
    return out


def gram(df: DataFrame, vector: Column, weight: Column | None = None) -> np.ndarray:
    found = grouped_gram(df, vector, None, weight)
    if not found:
        raise ValueError("no rows")
    return next(iter(found.values()))


def mean_cov(m: np.ndarray, ddof: int = 0) -> tuple[float, np.ndarray, np.ndarray]:
    """(count, mean, covariance) from one moment matrix."""
    n = m[-1, -1]
    mu = m[-1, :-1] / n
    cov = (m[:-1, :-1] - n * np.outer(mu, mu)) / max(n - ddof, 1.0)
    return n, mu, (cov + cov.T) / 2


def dot(vector: Column, weights) -> Column:
    """Inner product with a literal vector, evaluated inside the JVM."""
    w = F.array(*[F.lit(float(x)) for x in weights])
    return F.aggregate(F.zip_with(vector, w, lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v)


def quadratic(vector: Column, center, matrix: np.ndarray) -> Column:
    """``(x - c)' M (x - c)`` per row, as one matrix product per Arrow batch."""
    c, m = np.asarray(center, dtype=float), np.asarray(matrix, dtype=float)

    @F.pandas_udf("double")
    def form(x: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype=float)
        d = np.stack(x.to_numpy()) - c
        return pd.Series(np.einsum("ij,jk,ik->i", d, m, d))

    return form(vector)
