"""Views that the registered queries share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Register a query under its own name, with its SQL if there is any."""

    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def orders(spark: SparkSession, d: str) -> DataFrame:
    """Orders as dated ratings of customers."""
    return t(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", F.to_date("o_orderdate").alias("day"), "o_orderpriority")


def races(spark: SparkSession, d: str) -> DataFrame:
    """Line items as race results: an order is a race, a supplier a boat, and the highest price of an entry its score."""
    e = t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("race"), F.col("l_suppkey").alias("boat")).agg(
        F.min("l_quantity").alias("rating"), F.max("l_extendedprice").alias("score"), F.min(F.to_date("l_shipdate")).alias("day"), F.min("l_returnflag").alias("flag")
    )
    w = Window.partitionBy("race")
    return e.withColumn("place", F.rank().over(w.orderBy(F.desc("score")))).withColumn("fleet", F.count("*").over(w))


def r6(c: str | Column, digits: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


ORDERS = "o AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, CAST(o_orderdate AS DATE) AS day, o_orderpriority FROM orders)"
LATEST = ORDERS + ", l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY day DESC, o_orderkey DESC) AS n FROM o) WHERE n = 1)"
RACES = """e AS (SELECT l_orderkey AS race, l_suppkey AS boat, min(l_quantity) AS rating, max(l_extendedprice) AS score, min(CAST(l_shipdate AS DATE)) AS day, min(l_returnflag) AS flag
  FROM lineitem GROUP BY 1, 2),
r AS (SELECT *, CAST(rank() OVER (PARTITION BY race ORDER BY score DESC) AS INTEGER) AS place, count(*) OVER (PARTITION BY race) AS fleet FROM e)"""
