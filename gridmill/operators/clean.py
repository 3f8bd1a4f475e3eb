"""Row edits, imputation, scaling, encoding, samples, search and cell edits."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridmill.functions import semantics as S
from gridmill.functions.joins import small_side
from gridmill.functions.positions import with_position
from gridmill.functions.quantiles import column_quantiles
from gridmill.functions.semantics import col
from gridmill.operators.profile import top_values
from gridmill.session import pinned

# Name parts of columns that the ETL step parses as dates.
ETL_DATE_WORDS = ("date", "time", "created", "updated", "timestamp")
UNKNOWN = "Unknown"


class EditError(ValueError):
    """An edit that names an unknown action, column or predicate."""


# --- single-column edits ----------------------------------------------------

def edit(df: DataFrame, action: str, column: str = "", value: str = "") -> DataFrame:
    """One user edit: rename, drop-col, fill-missing, drop-duplicates, sort, filter-rows."""
    if action == "drop-duplicates":
        return df.dropDuplicates()
    if column not in df.columns:
        raise EditError(f"column {column!r} not found")
    if action == "rename":
        if not value:
            raise EditError("a new name is required")
        return df.withColumnRenamed(column, value)
    if action == "drop-col":
        return df.drop(col(column))
    if action == "fill-missing":
        return fill_missing(df, column, value)
    if action == "sort":
        return sort_rows(df, column, ascending=value == "asc")
    if action == "filter-rows":
        return filter_rows(df, column, value)
    raise EditError(f"unknown action {action!r}")


def fill_missing(df: DataFrame, column: str, value: str) -> DataFrame:
    """Replace nulls by the mean, median, most frequent value, 0 or a literal."""
    S.require(df, column)
    dtype = df.schema[column].dataType
    if value in ("mean", "median"):
        S.require_numeric(df, column)
        fill = (
            df.agg(S.mean(col(column))).first()[0]
            if value == "mean"
            else column_quantiles(df, [column], [0.5])[column][0]
        )
        c = F.coalesce(col(column).cast("double"), F.lit(fill).cast("double"))
    elif value == "mode":
        fill = _modes(df, [column])[column]
        c = F.coalesce(col(column), F.lit(fill).cast(dtype))
    else:
        c = F.coalesce(col(column), F.lit(value).try_cast(dtype))
    return df.select(*[c.alias(x) if x == column else col(x) for x in df.columns])


def sort_rows(df: DataFrame, column: str, ascending: bool = True) -> DataFrame:
    """Global sort, nulls last both ways. The row digest breaks ties, so that a
    value held by many rows is still spread over several range partitions."""
    key = col(column).asc_nulls_last() if ascending else col(column).desc_nulls_last()
    return df.orderBy(key, S.row_digest(df))


_LITERAL = r"(?:-?\d+(?:\.\d+)?|'(?:[^'\\]|'')*'|\"(?:[^\"\\])*\"|true|false)"
_PREDICATES = tuple(
    re.compile(p, re.IGNORECASE)
    for p in (
        rf"\s*(?:==|=|!=|<>|<=|>=|<|>)\s*{_LITERAL}\s*",
        rf"\s*(?:not\s+)?in\s*[(\[]\s*{_LITERAL}(?:\s*,\s*{_LITERAL})*\s*[)\]]\s*",
        rf"\s*(?:not\s+)?like\s+{_LITERAL}\s*",
        rf"\s*(?:not\s+)?between\s+{_LITERAL}\s+and\s+{_LITERAL}\s*",
        r"\s*is\s+(?:not\s+)?null\s*",
    )
)


def filter_rows(df: DataFrame, column: str, predicate: str) -> DataFrame:
    """Keep rows where ``column <predicate>`` holds; only simple tests on that one
    column are accepted. The test stays a plain expression and is pushed to the scan."""
    S.require(df, column)
    if not any(p.fullmatch(predicate) for p in _PREDICATES):
        raise EditError(f"predicate not understood: {predicate!r}")
    listed = re.fullmatch(r"(\s*(?:not\s+)?in\s*)\[(.*)\](\s*)", predicate, re.IGNORECASE | re.DOTALL)
    text = f"{listed[1]}({listed[2]}){listed[3]}" if listed else predicate
    return df.filter(F.expr(f"{S.ident(column)} {text}"))


# --- whole-table cleaning ---------------------------------------------------

def _modes(df: DataFrame, columns: Sequence[str]) -> dict[str, object]:
    if not columns:
        return {}
    return {row["column"]: row["value"] for row in top_values(df, columns).select("column", "value").collect()}


def _fill_values(df: DataFrame, numeric: Sequence[str], text: Sequence[str], strategy: str) -> dict[str, object]:
    """One number or text per column, read in two passes over the table."""
    if strategy == "zero":
        numbers: dict[str, object] = {c: 0.0 for c in numeric}
    elif strategy == "mean":
        row = df.agg(*[S.mean(col(c)).alias(f"m{i}") for i, c in enumerate(numeric)]).first() if numeric else []
        numbers = {c: row[i] for i, c in enumerate(numeric)}
    elif strategy in ("auto", "median"):
        numbers = {c: q[0] for c, q in column_quantiles(df, numeric, [0.5]).items()}
    else:
        raise EditError(f"unknown fill strategy {strategy!r}")
    modes = _modes(df, text)
    return {**numbers, **{c: modes.get(c, UNKNOWN) for c in text}}


def transform(
    df: DataFrame,
    drop_duplicates: bool = True,
    fill: str = "auto",
    normalize: bool = False,
    parse: bool = True,
) -> DataFrame:
    """The ETL step: drop duplicate rows, impute, optionally scale, parse dates.

    Columns without nulls keep their type; imputed numbers become double. Null
    counts and ranges do not change when equal rows go, so they come from one
    pass over the input; the distinct rows are pinned only if values must be
    imputed from them.
    """
    numeric, text = S.numeric_columns(df), S.text_columns(df)
    ends = [f(col(c).cast("double")) for c in numeric for f in (F.min, F.max)]
    nulls = [S.count_missing(col(c)) for c in df.columns]
    row = df.agg(*[a.alias(f"a{i}") for i, a in enumerate([*ends, *nulls])]).first()
    span = {c: (row[2 * i], row[2 * i + 1]) for i, c in enumerate(numeric)}
    gaps = [c for i, c in enumerate(df.columns) if row[len(ends) + i] and (c in numeric or c in text)]
    if drop_duplicates:
        df = pinned(df.dropDuplicates()) if gaps else df.dropDuplicates()
    values = _fill_values(df, [c for c in gaps if c in numeric], [c for c in gaps if c in text], fill)
    out = {c: _filled(c, values, numeric) for c in gaps}
    if normalize:
        for c, (lo, hi) in span.items():
            if c in values and values[c] is not None:
                lo = values[c] if lo is None else min(lo, values[c])
                hi = values[c] if hi is None else max(hi, values[c])
            if lo is not None and hi > lo:
                out[c] = (out.get(c, col(c).cast("double")) - F.lit(lo)) / F.lit(hi - lo)
    df = df.select(*[out[c].alias(c) if c in out else col(c) for c in df.columns])
    return parse_dates(df) if parse else df


def _filled(name: str, values: dict[str, object], numeric: Sequence[str]) -> Column:
    c = col(name).cast("double") if name in numeric else col(name)
    return F.coalesce(c, F.lit(values[name]))


def clean(df: DataFrame) -> DataFrame:
    """Drop duplicate rows, then median for numbers and most frequent text."""
    return transform(df, fill="median", parse=False)


def transform_log(df: DataFrame, **options) -> DataFrame:
    """(step, detail, rows) lines describing what ``transform`` does to ``df``."""
    before = df.count()
    removed = duplicate_count(df).first()[0] if options.get("drop_duplicates", True) else 0
    dated = [c for c in df.columns if any(w in c.lower() for w in ETL_DATE_WORDS)]
    lines = [("duplicates", f"Removed {removed} duplicate rows", removed)] if removed else []
    if options.get("normalize"):
        lines.append(("normalize", "Normalized numeric columns to [0,1]", before - removed))
    if dated:
        lines.append(("dates", f"Parsed date columns: {dated}", before - removed))
    lines.append(("done", f"Transformation complete: {before - removed} rows remaining (removed {removed})", before - removed))
    return S.small_frame(df.sparkSession, lines, "step string, detail string, rows bigint")


def minmax(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Scale to [0, 1]; constant columns are left as they are."""
    columns = list(columns if columns is not None else S.numeric_columns(df))
    if not columns:
        return df
    aggs = [f(col(c).cast("double")) for c in columns for f in (F.min, F.max)]
    row = df.agg(*[a.alias(f"a{i}") for i, a in enumerate(aggs)]).first()
    scaled = {}
    for i, c in enumerate(columns):
        lo, hi = row[2 * i], row[2 * i + 1]
        if lo is not None and hi > lo:
            scaled[c] = (col(c).cast("double") - F.lit(lo)) / F.lit(hi - lo)
    return df.select(*[scaled[c].alias(c) if c in scaled else col(c) for c in df.columns])


def standardize(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Subtract the mean and divide by the population deviation; a constant
    column becomes 0 and nulls stay null."""
    columns = list(columns if columns is not None else S.numeric_columns(df))
    if not columns:
        return df
    aggs = [f(col(c).cast("double")) for c in columns for f in (F.avg, F.stddev_pop)]
    row = df.agg(*[a.alias(f"a{i}") for i, a in enumerate(aggs)]).first()
    out = {}
    for i, c in enumerate(columns):
        mu, sd = row[2 * i], row[2 * i + 1]
        if mu is not None:
            out[c] = (col(c).cast("double") - F.lit(mu)) / F.lit(sd if sd else 1.0)
    return df.select(*[out[c].alias(c) if c in out else col(c) for c in df.columns])


def parse_dates(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Text columns with a date-like name become timestamps; bad text becomes null."""
    chosen = set(columns) if columns is not None else {
        c for c in S.text_columns(df) if any(w in c.lower() for w in ETL_DATE_WORDS)
    }
    return df.select(*[S.time_col(df, c).alias(c) if c in chosen else col(c) for c in df.columns])


# --- encoding and features --------------------------------------------------

def code_table(df: DataFrame, column: str) -> DataFrame:
    """(value, code): the distinct text of a column numbered in sorted order."""
    values = df.select(S.label_of(col(column)).alias("value")).distinct()
    return with_position(values, [], [F.col("value").asc()], name="code")


def label_encode(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Replace text by integer codes in sorted order.

    Each code table is broadcast only when it is small; otherwise the join is
    left to the optimizer, which splits skewed keys at run time.
    """
    columns = list(columns if columns is not None else S.text_columns(df))
    out = df
    for c in columns:
        codes = code_table(df, c).select(F.col("value").alias("__value"), F.col("code").alias("__code"))
        joined = out.join(small_side(codes), S.label_of(col(c)) == F.col("__value"), "left")
        out = joined.select(*[F.col("__code").alias(x) if x == c else col(x) for x in df.columns])
    return out


def datetime_features(df: DataFrame, column: str) -> DataFrame:
    t = S.time_col(df, column)
    parts = {"year": F.year, "month": F.month, "day": F.day, "dayofweek": F.weekday}
    return df.withColumns({f"{column}_{name}": f(t) for name, f in parts.items()})


def ratio_feature(df: DataFrame, a: str, b: str) -> DataFrame:
    S.require_numeric(df, a, b)
    return df.withColumn(f"{a}_to_{b}_ratio", F.try_divide(col(a).cast("double"), col(b).cast("double") + F.lit(1e-9)))


# --- samples, search, cell edits --------------------------------------------

def sample_n(df: DataFrame, n: int, key: str | Column, seed: int = S.SEED) -> DataFrame:
    """Exactly ``n`` rows (or all), the same ones on every run and cluster.

    Runs as a per-task top-n by a seeded hash of the key, not as a full sort.
    """
    k = col(key) if isinstance(key, str) else key
    return df.orderBy(S.seeded_hash(k, seed), k).limit(n)


def duplicate_count(df: DataFrame) -> DataFrame:
    """One row (duplicates): rows beyond the first of each equal row."""
    groups = df.groupBy(*[col(c) for c in df.columns]).agg(F.count(F.lit(1)).alias("__n"))
    return groups.agg(F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)).cast("bigint").alias("duplicates"))


def safe_head(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """First ``n`` rows in the stated order, NaN and infinities as null."""
    return S.fold_missing(df.orderBy(*order).limit(n))


def search_rows(
    df: DataFrame, text: str, order: Sequence[Column], page: int = 1, size: int = 50, columns: Sequence[str] | None = None
) -> DataFrame:
    """One page of the rows where any column contains ``text`` (any letter case)."""
    names = list(columns or df.columns)
    needle = F.lit(text.lower())
    hit = F.lit(False)
    for c in names:
        hit = hit | F.coalesce(F.contains(F.lower(col(c).cast("string")), needle), F.lit(False))
    return df.filter(hit).orderBy(*order).offset((page - 1) * size).limit(size)


def apply_edits(df: DataFrame, edits: DataFrame, key: str) -> DataFrame:
    """Apply an edits table (key, column, value, seq); the latest edit of a cell wins.

    Edits are folded to one row per key before the join, so the table itself is
    shuffled at most once; text that does not fit the column type is ignored.
    """
    names = [c for c in df.columns if c != key]
    latest = edits.groupBy(F.col("key").alias("__key")).agg(
        *[F.max_by(F.when(F.col("column") == c, F.col("value")), F.when(F.col("column") == c, F.col("seq"))).alias(f"__e{i}")
          for i, c in enumerate(names)]
    )
    joined = df.join(latest, col(key) == F.col("__key").cast(df.schema[key].dataType), "left")
    new = {
        c: F.coalesce(F.col(f"__e{i}").try_cast(df.schema[c].dataType), col(c)) for i, c in enumerate(names)
    }
    return joined.select(*[new[c].alias(c) if c in new else col(c) for c in df.columns])
