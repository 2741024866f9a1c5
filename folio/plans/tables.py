"""The driver's tables as the engine's relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def items(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as scored items: the score is the priority's digit, pending orders have no signal, a customer's orders replicate."""
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    signal = F.col("o_orderstatus") != "P"
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("item_id"), F.to_date("o_orderdate").alias("day"), F.col("c_nationkey").alias("outlet"), F.col("c_mktsegment").alias("kind"), F.col("o_custkey").alias("wire"),
        F.when(signal, F.substring("o_orderpriority", 1, 1).cast("int")).alias("d1"), (~signal).alias("no_signal"), F.col("o_totalprice").alias("price"),
    )


ITEMS = """items AS (
  SELECT o_orderkey AS item_id, o_orderdate::DATE AS day, c_nationkey AS outlet, c_mktsegment AS kind, o_custkey AS wire,
         CASE WHEN o_orderstatus <> 'P' THEN substr(o_orderpriority, 1, 1)::INT END AS d1, o_orderstatus = 'P' AS no_signal, o_totalprice AS price
  FROM orders JOIN customer ON o_custkey = c_custkey)"""


def daily_value(spark: SparkSession, sf: str) -> DataFrame:
    """(day, n, value) of events."""
    return table(spark, sf, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.sum("value").alias("value"))


DAILY = "daily AS (SELECT ts::DATE AS day, count(*) AS n, sum(value) AS value FROM events GROUP BY 1)"


def monthly_price(spark: SparkSession, sf: str) -> DataFrame:
    """(month, x) mean price of orders in thousands."""
    return table(spark, sf, "orders").groupBy(F.to_date(F.trunc("o_orderdate", "MONTH")).alias("month")).agg((F.avg("o_totalprice") / 1000).alias("x"))


MONTHLY = "monthly AS (SELECT date_trunc('month', o_orderdate)::DATE AS month, avg(o_totalprice) / 1000 AS x FROM orders GROUP BY 1)"


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c, t in df.dtypes if t == "double"})
