"""Tables of a relational database over JDBC.

The functions only build Spark's JDBC source and sink; the database and its
driver jar are the caller's.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridmill.functions import semantics as S

BATCH_ROWS = 1_000
MODES = {"replace": "overwrite", "append": "append", "fail": "errorifexists"}


def _reader(spark: SparkSession, url: str, options: dict[str, str]):
    return spark.read.format("jdbc").option("url", url).options(**options)


def read_jdbc(
    spark: SparkSession, url: str, table: str, partition_column: str | None = None, partitions: int = 8, **options: str
) -> DataFrame:
    """Read a table; with a partition column in parallel ranges.

    The range ends are asked from the database with one small query.
    """
    reader = _reader(spark, url, options)
    if partition_column is None:
        return reader.option("dbtable", table).load()
    ends = reader.option("query", f"SELECT MIN({partition_column}) AS lo, MAX({partition_column}) AS hi FROM {table}").load().first()
    if ends is None or ends[0] is None:
        return _reader(spark, url, options).option("dbtable", table).load()
    return (
        _reader(spark, url, options).option("dbtable", table).option("partitionColumn", partition_column)
        .option("lowerBound", str(ends[0])).option("upperBound", str(ends[1])).option("numPartitions", str(partitions)).load()
    )


def jdbc_describe(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """(ordinal, field, type, nullable, n_rows): the count runs in the database."""
    df = _reader(spark, url, options).option("dbtable", table).load()
    n = _reader(spark, url, options).option("query", f"SELECT COUNT(*) AS n FROM {table}").load().first()[0]
    rows = [(i, f.name, f.dataType.simpleString(), f.nullable, int(n)) for i, f in enumerate(df.schema)]
    return S.small_frame(spark, rows, "ordinal int, field string, type string, nullable boolean, n_rows bigint")


def jdbc_catalog(spark: SparkSession, url: str, query: str, **options: str) -> DataFrame:
    """The tables and columns a database lists, by its own catalog query."""
    return _reader(spark, url, options).option("query", query).load()


def load_jdbc(df: DataFrame, url: str, table: str, if_exists: str = "replace", **options: str) -> None:
    """Write a table in batches; ``if_exists`` is replace, append or fail."""
    if if_exists not in MODES:
        raise ValueError(f"if_exists must be one of {sorted(MODES)}")
    (
        df.write.format("jdbc").option("url", url).option("dbtable", table).option("batchsize", str(BATCH_ROWS))
        .options(**options).mode(MODES[if_exists]).save()
    )


def describe_all_tables(spark: SparkSession, url: str, tables: list[str], **options: str) -> DataFrame:
    """``jdbc_describe`` of several tables in one frame."""
    parts = [jdbc_describe(spark, url, t, **options).withColumn("table", F.lit(t)) for t in tables]
    return reduce(DataFrame.unionByName, parts)
