"""The meaning of nulls, moments, ties, labels and samples, fixed in one place.

All helpers return Spark columns or DataFrames; nothing here starts a job.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEED = 42
HASH_BUCKETS = 10_000
NULL_LABEL = "nan"  # text shown for a missing group key

_DATE_PATTERNS = (
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy/MM/dd",
    "MM/dd/yyyy",
    "dd-MM-yyyy",
    "dd.MM.yyyy",
    "d MMM yyyy",
    "MMM d, yyyy",
    "yyyy-MM",
)


class ColumnError(ValueError):
    """A column is missing or has the wrong kind for the operation."""


# --- naming -----------------------------------------------------------------

def ident(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    """Reference by exact name, also for names with dots, spaces or brackets."""
    return F.col(ident(name))


def require(df: DataFrame, *names: str | None) -> None:
    missing = [n for n in names if not n or n not in df.columns]
    if missing:
        raise ColumnError(f"column(s) not found: {missing}; have {df.columns}")


# --- column classes ---------------------------------------------------------

def is_numeric_type(dt: T.DataType) -> bool:
    return isinstance(dt, T.NumericType)


def is_time_type(dt: T.DataType) -> bool:
    return isinstance(dt, (T.DateType, T.TimestampType, T.TimestampNTZType))


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if is_numeric_type(f.dataType)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def bool_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.BooleanType)]


def time_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if is_time_type(f.dataType)]


def is_numeric(df: DataFrame, name: str | None) -> bool:
    return bool(name) and name in df.columns and is_numeric_type(df.schema[name].dataType)


def require_numeric(df: DataFrame, *names: str | None) -> None:
    require(df, *names)
    bad = [n for n in names if not is_numeric(df, n)]
    if bad:
        raise ColumnError(f"column(s) not numeric: {bad}")


# --- missing values ---------------------------------------------------------

def finite(c: Column) -> Column:
    """NaN and both infinities become null (floating columns only)."""
    inf = F.lit(float("inf"))
    return F.when(~F.isnan(c) & (F.abs(c) != inf), c)


def fold_missing(df: DataFrame) -> DataFrame:
    """NaN and infinities of every floating column become null."""
    floating = {f.name for f in df.schema if isinstance(f.dataType, (T.FloatType, T.DoubleType))}
    if not floating:
        return df
    return df.select(*[finite(col(c)).alias(c) if c in floating else col(c) for c in df.columns])


def count_missing(c: Column) -> Column:
    return F.count(F.when(c.isNull(), 1))


# --- aggregates -------------------------------------------------------------

def total(c: Column) -> Column:
    """Sum as double; 0 when nothing is there to add. Decimals add exactly."""
    return F.coalesce(F.sum(c).cast("double"), F.lit(0.0))


def mean(c: Column) -> Column:
    return F.try_divide(F.sum(c).cast("double"), F.count(c))


def sample_std(c: Column) -> Column:
    return F.stddev_samp(c.cast("double"))


def skew(c: Column) -> Column:
    """Bias-adjusted skewness; null below three values, 0 without spread."""
    n = F.count(c).cast("double")
    flat = F.min(c) == F.max(c)
    g1 = F.when(flat, F.lit(0.0)).otherwise(F.skewness(c.cast("double")))
    return F.when(n > 2, g1 * F.try_divide(F.sqrt(n * (n - 1)), n - 2))


def kurt(c: Column) -> Column:
    """Bias-adjusted excess kurtosis; null below four values, 0 without spread."""
    n = F.count(c).cast("double")
    flat = F.min(c) == F.max(c)
    adjusted = F.try_divide(n - 1, (n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(c.cast("double")) + 6)
    return F.when(n > 3, F.when(flat, F.lit(0.0)).otherwise(adjusted))


def pearson(x: Column, y: Column) -> Column:
    """Correlation over rows where both are present; null for a constant side."""
    dx = F.when(y.isNotNull(), x.cast("double"))
    dy = F.when(x.isNotNull(), y.cast("double"))
    return F.try_divide(F.covar_pop(dx, dy), F.stddev_pop(dx) * F.stddev_pop(dy))


AGGREGATES = {
    "sum": total,
    "mean": mean,
    "max": lambda c: F.max(c).cast("double"),
    "min": lambda c: F.min(c).cast("double"),
    "count": lambda c: F.count(c).cast("double"),
}


def most_frequent(value: Column, count: Column) -> Column:
    """Over (value, count) rows: the value seen most, the smallest on ties."""
    return F.min_by(value, F.struct((-count).alias("n"), value.alias("v")))


# --- rounding and text ------------------------------------------------------

def r(c: Column, digits: int) -> Column:
    return F.round(c.cast("double"), digits)


def label_of(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(NULL_LABEL))


def titled(name: str) -> str:
    return name.replace("_", " ").title()


# --- dates ------------------------------------------------------------------

def parsed_time(c: Column, dtype: T.DataType) -> Column:
    """Value as timestamp; text that fits no known form becomes null."""
    if isinstance(dtype, T.TimestampType):
        return c
    if is_time_type(dtype):
        return c.cast("timestamp")
    if isinstance(dtype, T.StringType):
        s = F.trim(c)
        tries = [s.try_cast("timestamp")] + [F.try_to_timestamp(s, F.lit(p)) for p in _DATE_PATTERNS]
        return F.coalesce(*tries)
    return F.lit(None).cast("timestamp")


def time_col(df: DataFrame, name: str) -> Column:
    return parsed_time(col(name), df.schema[name].dataType)


def week_end(d: Column) -> Column:
    """The Sunday that closes the Monday-to-Sunday week of ``d``."""
    return F.date_add(F.date_trunc("week", d).cast("date"), 6)


def week_label(sunday: Column) -> Column:
    number = F.floor((F.dayofyear(sunday) - 1 + 7 - F.weekday(sunday)) / 7)
    return F.concat(F.date_format(sunday, "yyyy"), F.lit("-W"), F.lpad(number.cast("string"), 2, "0"))


# --- seeded order -----------------------------------------------------------

def seeded_hash(key: Column, seed: int = SEED) -> Column:
    """Stable pseudo-random text per key: the same rows on any cluster layout."""
    return F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string")))


def seeded_bucket(key: Column, seed: int = SEED, buckets: int = HASH_BUCKETS) -> Column:
    return F.conv(F.substring(seeded_hash(key, seed), 1, 8), 16, 10).cast("bigint") % buckets


def row_digest(df: DataFrame) -> Column:
    """One hash per whole row, used to break ties."""
    return F.xxhash64(*[col(c) for c in df.columns])


# --- small results ----------------------------------------------------------

def small_frame(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A literal frame of a few known rows, held in the plan itself."""
    from pyspark.sql.pandas.types import to_arrow_schema

    fields = T.StructType.fromDDL(schema)
    names = fields.fieldNames()
    table = pa.Table.from_pylist([dict(zip(names, row)) for row in rows], schema=to_arrow_schema(fields))
    return spark.createDataFrame(table, schema=fields)



def numbered(df: DataFrame, *order: Column, name: str = "ord") -> DataFrame:
    """Number the rows of an already small result 1, 2, 3 …"""
    return df.withColumn(name, F.row_number().over(Window.orderBy(*order)).cast("bigint"))


def top_rows(df: DataFrame, n: int, *order: Column, name: str = "ord") -> DataFrame:
    """First ``n`` rows in the given order, numbered. Runs as a per-task top-n."""
    return numbered(df.orderBy(*order).limit(n), *order, name=name)
