"""The input tables and the derived views that several queries share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def lineitem(spark: SparkSession, sf: str) -> DataFrame:
    """lineitem with an exact price, so that sums do not depend on row order."""
    li = load(spark, sf, "lineitem")
    return li.withColumn("l_extendedprice", F.col("l_extendedprice").cast("decimal(18,2)"))


def lineitem_nulls(spark: SparkSession, sf: str) -> DataFrame:
    li = lineitem(spark, sf)
    return li.withColumns(
        {"l_quantity": F.expr("nullif(l_quantity, 7)"), "l_returnflag": F.expr("nullif(l_returnflag, 'N')")}
    )


def lineitem_dups(spark: SparkSession, sf: str) -> DataFrame:
    li = load(spark, sf, "lineitem")
    return li.unionByName(li.filter("l_orderkey % 10 = 0"))


def orders(spark: SparkSession, sf: str) -> DataFrame:
    o = load(spark, sf, "orders")
    return o.withColumn("o_totalprice", F.col("o_totalprice").cast("decimal(18,2)"))


def orders_gaps(spark: SparkSession, sf: str) -> DataFrame:
    return orders(spark, sf).filter("month(o_orderdate) NOT IN (3, 4)")


def events(spark: SparkSession, sf: str) -> DataFrame:
    e = load(spark, sf, "events")
    return e.withColumn("value", F.col("value").cast("decimal(18,2)"))


LINEITEM = "SELECT * REPLACE (CAST(l_extendedprice AS DECIMAL(18,2)) AS l_extendedprice) FROM lineitem"
LINEITEM_NULLS = (
    "SELECT * REPLACE (CAST(l_extendedprice AS DECIMAL(18,2)) AS l_extendedprice, "
    "nullif(l_quantity, 7) AS l_quantity, nullif(l_returnflag, 'N') AS l_returnflag) FROM lineitem"
)
LINEITEM_DUPS = "SELECT * FROM lineitem UNION ALL SELECT * FROM lineitem WHERE l_orderkey % 10 = 0"
ORDERS = "SELECT * REPLACE (CAST(o_totalprice AS DECIMAL(18,2)) AS o_totalprice) FROM orders"
ORDERS_GAPS = ORDERS + " WHERE month(o_orderdate) NOT IN (3, 4)"
EVENTS = "SELECT * REPLACE (CAST(value AS DECIMAL(18,2)) AS value) FROM events"

LINEITEM_NUMBERS = (
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
)


def union_all(template: str, names) -> str:
    """One SELECT per column name, with {c} and {i} filled in."""
    return " UNION ALL ".join(template.format(c=c, i=i) for i, c in enumerate(names))
