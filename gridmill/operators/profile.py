"""Table and column profiles.

Two shapes of work cover everything: one wide aggregation (a single scan, one
row out) and one unpivoted value count (a single shuffle for the distinct
values of all columns together).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridmill.functions import semantics as S
from gridmill.functions.pairs import correlations
from gridmill.functions.quantiles import column_quantiles
from gridmill.functions.semantics import col

IQR_FENCE = 1.5


# --- shared primitives ------------------------------------------------------

def value_counts_long(df: DataFrame, columns: Sequence[str], missing_as_text: bool = False) -> DataFrame:
    """(column, value, count) for several columns in one shuffle."""
    entries = F.array(
        *[F.struct(F.lit(c).alias("column"), col(c).cast("string").alias("value")) for c in columns]
    )
    tall = df.select(F.inline(entries))
    tall = tall.fillna(S.NULL_LABEL, ["value"]) if missing_as_text else tall.filter(F.col("value").isNotNull())
    return tall.groupBy("column", "value").agg(F.count(F.lit(1)).alias("count"))


def distinct_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, n_unique); a column without values counts 0.

    Columns are counted together in their own kind: whole numbers and floats
    are shuffled as numbers, everything else as text. Of a long text only its
    128-bit digest travels.
    """
    if not columns:
        return S.small_frame(df.sparkSession, [], "column string, n_unique bigint")
    kinds: dict[str, list[str]] = {}
    for c in columns:
        dt = df.schema[c].dataType
        whole = isinstance(dt, T.IntegralType)
        kinds.setdefault("bigint" if whole else "double" if isinstance(dt, T.FractionalType) and not isinstance(dt, T.DecimalType) else "string", []).append(c)
    found = None
    for kind, names in kinds.items():
        value = _brief if kind == "string" else (lambda v: v)
        entries = F.array(*[F.struct(F.lit(c).alias("column"), value(col(c).cast(kind)).alias("value")) for c in names])
        tall = df.select(F.inline(entries)).filter(F.col("value").isNotNull()).distinct()
        part = tall.groupBy("column").agg(F.count(F.lit(1)).alias("n"))
        found = part if found is None else found.unionByName(part)
    names = _names(df, columns)
    return names.join(found, "column", "left").select("column", F.coalesce("n", F.lit(0).cast("bigint")).alias("n_unique"))


def _brief(text: Column) -> Column:
    return F.when(F.length(text) > 64, F.concat(F.lit("#"), F.md5(text))).otherwise(text)


def top_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value, count, n_unique): the most frequent value, smallest on ties."""
    if not columns:
        return S.small_frame(df.sparkSession, [], "column string, value string, count bigint, n_unique bigint")
    return (
        value_counts_long(df, columns)
        .groupBy("column")
        .agg(
            S.most_frequent(F.col("value"), F.col("count")).alias("value"),
            F.max("count").alias("count"),
            F.count(F.lit(1)).alias("n_unique"),
        )
    )


def _names(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(ordinal, column): a frame as small as the schema."""
    rows = [(df.columns.index(c), c) for c in columns]
    return F.broadcast(S.small_frame(df.sparkSession, rows, "ordinal int, column string"))


def _tall_stats(df: DataFrame, columns: Sequence[str], stats: dict[str, object]) -> DataFrame:
    """(column, <stat>…) from ONE wide aggregation; ``stats`` maps a name to ``f(column)``."""
    aggs = [f(c).alias(f"s{i}_{name}") for i, c in enumerate(columns) for name, f in stats.items()]
    entries = F.array(
        *[
            F.struct(F.lit(c).alias("column"), *[F.col(f"s{i}_{name}").alias(name) for name in stats])
            for i, c in enumerate(columns)
        ]
    )
    return df.agg(*aggs).select(F.inline(entries))


def _n_rows(_: str) -> Column:
    return F.count(F.lit(1))


def _missing(c: str) -> Column:
    return S.count_missing(col(c))


def _share_missing(digits: int):
    return lambda c: F.round(F.try_divide(S.count_missing(col(c)), F.count(F.lit(1))) * 100, digits)


def _number(f, df: DataFrame, digits: int):
    """``f`` over numeric columns, null for the rest, rounded."""
    return lambda c: S.r(f(col(c)), digits) if S.is_numeric(df, c) else F.lit(None).cast("double")


# --- table level ------------------------------------------------------------

def summary(df: DataFrame) -> DataFrame:
    """(ordinal, column, dtype, n_rows, missing) per column; see ``safe_head`` for rows."""
    tall = _tall_stats(df, df.columns, {"n_rows": _n_rows, "missing": _missing})
    rows = [(i, c, df.schema[c].dataType.simpleString()) for i, c in enumerate(df.columns)]
    types = F.broadcast(S.small_frame(df.sparkSession, rows, "ordinal int, column string, dtype string"))
    return tall.join(types, "column").select("ordinal", "column", "dtype", "n_rows", "missing")


def completeness(df: DataFrame) -> DataFrame:
    """One row (n_rows, n_cols, total_cells, total_missing, completeness)."""
    n = len(df.columns)
    missing = sum((S.count_missing(col(c)) for c in df.columns), F.lit(0))
    facts = df.agg(F.count(F.lit(1)).alias("n_rows"), missing.cast("bigint").alias("total_missing"))
    cells = F.col("n_rows") * n
    share = F.coalesce(F.try_divide(F.col("total_missing"), cells), F.lit(0.0))
    return facts.select(
        "n_rows",
        F.lit(n).alias("n_cols"),
        cells.alias("total_cells"),
        "total_missing",
        F.round((1 - share) * 100, 1).alias("completeness"),
    )


# --- column level -----------------------------------------------------------

def profile_columns(df: DataFrame, style: str = "preview", max_columns: int | None = None) -> DataFrame:
    """One row per column: missing, distinct, number statistics or top value.

    ``preview`` rounds to 2 places over all columns; ``dashboard`` to 3 places
    over the first 30.
    """
    digits, columns = (2, df.columns) if style == "preview" else (3, df.columns[:max_columns])
    numeric = [c for c in columns if S.is_numeric(df, c)]
    tall = _tall_stats(
        df,
        columns,
        {
            "missing": _missing,
            "missing_pct": _share_missing(1),
            "min": _number(F.min, df, digits),
            "max": _number(F.max, df, digits),
            "mean": _number(S.mean, df, digits),
            "std": _number(S.sample_std, df, digits),
        },
    )
    medians = column_quantiles(df, numeric, [0.5])
    others = [c for c in columns if c not in numeric]
    tops = top_values(df, others)
    if numeric:
        blank = [F.lit(None).cast("string").alias("value"), F.lit(None).cast("bigint").alias("count")]
        tops = tops.unionByName(distinct_counts(df, numeric).select("column", *blank, "n_unique"))
    median = F.lit(None).cast("double")
    for c in numeric:
        median = F.when(F.col("column") == c, F.lit(medians[c][0]).cast("double")).otherwise(median)
    is_number = F.col("column").isin(numeric) if numeric else F.lit(False)
    return (
        _names(df, columns)
        .join(tall, "column")
        .join(tops, "column", "left")
        .select(
            "ordinal",
            "column",
            F.when(is_number, "number").otherwise("text").alias("dtype"),
            "missing",
            "missing_pct",
            F.coalesce("n_unique", F.lit(0).cast("bigint")).alias("n_unique"),
            "min",
            "max",
            "mean",
            F.round(median, digits).alias("median"),
            "std",
            F.when(~is_number, F.col("value")).alias("top"),
            F.when(~is_number, F.coalesce("count", F.lit(0).cast("bigint"))).alias("top_count"),
        )
    )


def planner_profile(df: DataFrame, dataset: str = "table", dates: Sequence[str] | None = None) -> DataFrame:
    """Rows (dataset, ordinal, column, kind, …) that the chart planner reads.

    Kinds: ``numeric`` (those with a value), ``category`` (text columns) and
    ``date``; a column may be both a category and a date.
    """
    from gridmill.operators.typing import cardinality_class, date_columns

    numeric, text = S.numeric_columns(df), S.text_columns(df)
    dated = list(dates) if dates is not None else date_columns(df, "planner")
    blank, no_text = F.lit(None).cast("double"), F.lit(None).cast("string")
    parts: list[DataFrame] = []
    if numeric:
        tall = _tall_stats(
            df,
            numeric,
            {
                "min": _number(F.min, df, 3),
                "max": _number(F.max, df, 3),
                "mean": _number(S.mean, df, 3),
                "missing_pct": _share_missing(1),
            },
        )
        parts.append(
            tall.filter(F.col("mean").isNotNull()).select(
                "column", F.lit("numeric").alias("kind"), "min", "max", "mean", "missing_pct",
                F.lit(None).cast("bigint").alias("n_unique"), no_text.alias("cardinality"), no_text.alias("top"),
            )
        )
    if text:
        known = _names(df, text).join(top_values(df, text), "column", "left")
        unique = F.coalesce("n_unique", F.lit(0).cast("bigint"))
        parts.append(
            known.select(
                "column", F.lit("category").alias("kind"), blank.alias("min"), blank.alias("max"),
                blank.alias("mean"), blank.alias("missing_pct"), unique.alias("n_unique"),
                cardinality_class(unique).alias("cardinality"), F.col("value").alias("top"),
            )
        )
    if dated:
        parts.append(
            _names(df, dated).select(
                "column", F.lit("date").alias("kind"), blank.alias("min"), blank.alias("max"), blank.alias("mean"),
                blank.alias("missing_pct"), F.lit(None).cast("bigint").alias("n_unique"),
                no_text.alias("cardinality"), no_text.alias("top"),
            )
        )
    if not parts:
        raise S.ColumnError("no numeric, text or date column to profile")
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return _names(df, df.columns).join(rows, "column").select(F.lit(dataset).alias("dataset"), "ordinal", *rows.columns)


def ml_numeric_profile(df: DataFrame, max_columns: int | None = None) -> DataFrame:
    """(column, min, max, mean, std, missing_pct, skew, outlier_rate) of numbers."""
    names = S.numeric_columns(df)[:max_columns]
    facts = shape_facts(df, names, column_quantiles(df, names, [0.25, 0.5, 0.75]))
    rate = F.when(F.col("q3") > F.col("q1"), F.try_divide(F.col("outliers"), F.col("n"))).otherwise(0.0)
    return facts.filter("n > 0").select(
        "column", *[F.round(c, 3).alias(c) for c in ("min", "max", "mean", "std")],
        F.round(F.try_divide(F.col("missing"), F.col("n") + F.col("missing")) * 100, 1).alias("missing_pct"),
        F.round(F.coalesce("skew", F.lit(0.0)), 2).alias("skew"), F.round(rate, 3).alias("outlier_rate"),
    )


def shape_facts(df: DataFrame, columns: Sequence[str], quartiles: dict[str, list[float | None]]) -> DataFrame:
    """(column, n, missing, min, max, mean, std, skew, kurtosis, q1, median, q3,
    outliers) from one scan.

    Powers are summed around the median, which lies within one deviation of the
    mean, so plain sums are accurate and stay inside generated code where four
    separate moment aggregates per column would not.
    """
    numbers = df.select(
        *[(col(c).cast("double") - F.lit(quartiles[c][1] or 0.0)).alias(f"x{i}") for i, c in enumerate(columns)]
    )
    aggs, entries = [F.count(F.lit(1)).alias("rows")], []
    for i, c in enumerate(columns):
        x = F.col(f"x{i}")
        q1, q2, q3 = quartiles[c]
        shift = q2 or 0.0
        fences = (None, None) if q1 is None else (q1 - shift, q3 - shift)
        parts = {
            "n": F.count(x), "s1": F.sum(x), "s2": F.sum(x * x), "s3": F.sum(x * x * x), "s4": F.sum(x * x * x * x),
            "lo": F.min(x), "hi": F.max(x), "outliers": F.count(F.when(outside(x, *fences), 1)),
        }
        aggs += [a.alias(f"{k}_{i}") for k, a in parts.items()]
        entries.append(
            F.struct(
                F.lit(c).alias("column"), F.lit(shift).alias("c"), *[F.lit(v).cast("double").alias(k) for k, v in zip(("q1", "median", "q3"), quartiles[c])],
                *[F.col(f"{k}_{i}").alias(k) for k in parts],
            )
        )
    tall = numbers.agg(*aggs).select("rows", F.inline(F.array(*entries)))
    n = F.col("n").cast("double")
    a, b, c3, d = [F.try_divide(F.col(k), n) for k in ("s1", "s2", "s3", "s4")]
    m2 = b - a * a
    m3 = c3 - 3 * a * b + 2 * a * a * a
    m4 = d - 4 * a * c3 + 6 * a * a * b - 3 * a * a * a * a
    flat = F.col("lo") == F.col("hi")
    zero = F.lit(0.0)
    moments = tall.withColumns({"m1": a, "m2": F.when(flat, zero).otherwise(m2), "m3": m3, "m4": m4})
    skew = F.try_divide(F.col("m3"), F.pow("m2", F.lit(1.5))) * F.try_divide(F.sqrt(n * (n - 1)), n - 2)
    excess = F.try_divide(F.col("m4"), F.col("m2") * F.col("m2")) - 3
    kurtosis = F.try_divide(n - 1, (n - 2) * (n - 3)) * ((n + 1) * excess + 6)
    return moments.select(
        "column", "n", (F.col("rows") - F.col("n")).alias("missing"),
        (F.col("lo") + F.col("c")).alias("min"), (F.col("hi") + F.col("c")).alias("max"), (F.col("m1") + F.col("c")).alias("mean"),
        F.sqrt(F.col("m2") * F.try_divide(n, n - 1)).alias("std"),
        F.when(n > 2, F.when(flat, zero).otherwise(skew)).alias("skew"),
        F.when(n > 3, F.when(flat, zero).otherwise(kurtosis)).alias("kurtosis"),
        "q1", "median", "q3", "outliers",
    )


def outside(c: Column, q1: float | None, q3: float | None) -> Column:
    """True beyond the 1.5 IQR fences; both fences are plain literals, so the
    test can be pushed to the scan."""
    if q1 is None or q3 is None:
        return F.lit(False)
    spread = IQR_FENCE * (q3 - q1)
    return (c.cast("double") < F.lit(q1 - spread)) | (c.cast("double") > F.lit(q3 + spread))


def ml_categorical_profile(df: DataFrame, skip: Sequence[str] = (), max_columns: int | None = None) -> DataFrame:
    """(column, n_unique, cardinality, missing_pct, top_value) of text and booleans.

    ``skip`` names the date and long-text columns found by the typing job.
    """
    from gridmill.operators.typing import cardinality_class

    names = [c for c in S.text_columns(df) + S.bool_columns(df) if c not in set(skip)][:max_columns]
    tall = _tall_stats(df, names, {"missing_pct": _share_missing(1)})
    tops = top_values(df, names)
    n = F.coalesce("n_unique", F.lit(0).cast("bigint"))
    return tall.join(F.broadcast(tops), "column", "left").select(
        "column", n.alias("n_unique"), cardinality_class(n).alias("cardinality"), "missing_pct",
        F.col("value").alias("top_value"),
    )


def ml_table_profile(df: DataFrame, dates: Sequence[str] = (), long_text: Sequence[str] = ()) -> DataFrame:
    """One row of counts by kind and the mean share of missing cells."""
    special = set(dates) | set(long_text)
    categorical = [c for c in S.text_columns(df) + S.bool_columns(df) if c not in special]
    shares = sum((F.try_divide(S.count_missing(col(c)), F.count(F.lit(1))) for c in df.columns), F.lit(0.0))
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.lit(len(df.columns)).alias("n_cols"),
        F.lit(len(S.numeric_columns(df))).alias("n_numeric"),
        F.lit(len(categorical)).alias("n_categorical"),
        F.lit(len(list(dates))).alias("n_date"),
        F.lit(len(list(long_text))).alias("n_text"),
        F.round(shares / len(df.columns) * 100, 1).alias("total_missing_pct"),
    )


def target_profile(df: DataFrame, target: str) -> DataFrame:
    """(item, value) facts of the target: number statistics or class balance."""
    S.require(df, target)
    c = col(target)
    missing = F.round(F.try_divide(S.count_missing(c), F.count(F.lit(1))) * 100, 1)
    if S.is_numeric(df, target):
        n_unique = df.select(c).filter(c.isNotNull()).distinct().agg(F.count(F.lit(1)).alias("n")).scalar()
        row = df.agg(
            F.round(F.min(c).cast("double"), 3).alias("min"),
            F.round(F.max(c).cast("double"), 3).alias("max"),
            F.round(S.mean(c), 3).alias("mean"),
            F.round(S.sample_std(c), 3).alias("std"),
            missing.alias("missing_pct"),
            F.round(F.coalesce(S.skew(c), F.lit(0.0)), 2).alias("skew"),
        ).withColumn("n_unique", n_unique.cast("double"))
        items = ["n_unique", "min", "max", "mean", "std", "missing_pct", "skew"]
        return row.select(F.inline(F.array(*[F.struct(F.lit(i).alias("item"), F.col(i).alias("value")) for i in items])))
    counts = df.groupBy(c.cast("string").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    present = counts.filter(F.col("label").isNotNull())
    facts = counts.agg(
        F.count(F.when(F.col("label").isNotNull(), 1)).cast("double").alias("n_classes"),
        F.round(
            F.max(F.when(F.col("label").isNotNull(), F.col("n")))
            / F.greatest(F.min(F.when(F.col("label").isNotNull(), F.col("n"))), F.lit(1)), 2
        ).alias("imbalance_ratio"),
        F.round(F.try_divide(F.coalesce(F.sum(F.when(F.col("label").isNull(), F.col("n"))), F.lit(0)), F.sum("n")) * 100, 1)
        .alias("missing_pct"),
    )
    items = ["n_classes", "imbalance_ratio", "missing_pct"]
    head = facts.select(F.inline(F.array(*[F.struct(F.lit(i).alias("item"), F.col(i).alias("value")) for i in items])))
    top = present.orderBy(F.desc("n"), "label").limit(10)
    return head.unionByName(top.select(F.concat(F.lit("class:"), "label").alias("item"), F.col("n").cast("double").alias("value")))


# --- EDA --------------------------------------------------------------------

def eda_stats(df: DataFrame, columns: Sequence[str] | None = None, max_columns: int | None = None) -> DataFrame:
    """One row per number column: centre, spread, quartiles, shape, outliers."""
    names = list(columns or S.numeric_columns(df)[:max_columns])
    facts = shape_facts(df, names, column_quantiles(df, names, [0.25, 0.5, 0.75]))
    shown = ("mean", "median", "std", "min", "max", "q1", "q3", "skew", "kurtosis")
    return facts.select("column", *[F.round(c, 4).alias(c) for c in shown], "missing", "outliers")


def corr_matrix(
    df: DataFrame, columns: Sequence[str] | None = None, digits: int = 4, max_columns: int | None = None
) -> DataFrame:
    """(x, y, r) for every ordered pair of columns, null without variation."""
    names = list(columns or S.numeric_columns(df))[:max_columns]
    r = correlations(df, names)
    rows = [
        (x, y, None if np.isnan(r[i, j]) else float(r[i, j])) for i, x in enumerate(names) for j, y in enumerate(names)
    ]
    cells = S.small_frame(df.sparkSession, rows, "x string, y string, r double")
    return cells.withColumn("r", F.round("r", digits))


def category_distributions(df: DataFrame, columns: Sequence[str] | None = None, k: int = 10, max_columns: int | None = None) -> DataFrame:
    """(column, rank, value, count): the most frequent values of each text column."""
    names = list(columns or S.text_columns(df)[:max_columns])
    w = Window.partitionBy("column").orderBy(F.desc("count"), F.asc("value"))
    ranked = value_counts_long(df, names).withColumn("rank", F.row_number().over(w).cast("bigint"))
    return ranked.filter(F.col("rank") <= k).select("column", "rank", "value", "count")


def describe_all(df: DataFrame) -> DataFrame:
    """One row per column: count, unique, top, freq, mean, std, min, quartiles, max, nulls."""
    numeric = S.numeric_columns(df)
    others = [c for c in df.columns if c not in numeric]
    q = column_quantiles(df, numeric, [0.25, 0.5, 0.75])

    def quartile(i: int):
        return lambda c: F.round(F.lit(q[c][i] if c in q else None).cast("double"), 4)

    stats = {
        "count": lambda c: F.count(col(c)),
        "nulls": _missing,
        "mean": _number(S.mean, df, 4),
        "std": _number(S.sample_std, df, 4),
        "min": _number(F.min, df, 4),
        "q25": quartile(0),
        "q50": quartile(1),
        "q75": quartile(2),
        "max": _number(F.max, df, 4),
    }
    tall = _tall_stats(df, df.columns, stats)
    tops = top_values(df, others).select("column", "n_unique", F.col("value").alias("top"), F.col("count").alias("freq"))
    return _names(df, df.columns).join(tall, "column").join(tops, "column", "left").select(
        "ordinal", "column", "count", F.col("n_unique").alias("unique"), "top", "freq", "mean", "std", "min",
        "q25", "q50", "q75", "max", "nulls",
    )


def column_means(df: DataFrame) -> DataFrame:
    """(column, mean) of the number columns."""
    return _tall_stats(df, S.numeric_columns(df), {"mean": _number(S.mean, df, 4)})
