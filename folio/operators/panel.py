"""Monthly panels: lags, leads, compounding, targets ahead."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def shifted(rows: DataFrame, key: str, value: str, lags: list[int], keys: list[str] = ()) -> DataFrame:
    """rows with lag_k (negative: lead) by calendar months, whatever months are missing: an equality, not a position."""
    out = rows
    for k in lags:
        side = rows.select(*keys, F.add_months(key, k).alias(key), F.col(value).alias(f"{value}_lag{k}" if k > 0 else f"{value}_lead{-k}"))
        out = out.join(side, [*keys, key], "left")
    return out


def compounded(rows: DataFrame, key: str, rate: str, months: int = 12, keys: list[str] = ()) -> DataFrame:
    """rows with the compounded rate in percent of the last `months` months; null before there are as many."""
    w = W.partitionBy(*keys).orderBy(key).rowsBetween(-(months - 1), 0)
    product = F.exp(F.sum(F.log(1 + F.col(rate) / 100)).over(w))
    return rows.withColumn(f"{rate}_compounded", F.when(F.count(rate).over(w) == months, (product - 1) * 100))


def target_ahead(months: DataFrame, targets: DataFrame, month: str = "month", year: str = "year", value: str = "target", name: str = "target_ahead") -> DataFrame:
    """The target for the twelve months that begin with each month: this year's and the next's, weighted by their months.

    Later years without a target have the last one; earlier ones none. A row for each year: broadcast is bounded."""
    last = targets.agg(F.max(year).alias("ly"), F.max_by(value, year).alias("lv"))
    own = F.broadcast(targets.select(F.col(year).alias("y__"), F.col(value).alias("v0")))
    nxt = F.broadcast(targets.select((F.col(year) - 1).alias("y__"), F.col(value).alias("v1")))
    rows = months.withColumn("y__", F.year(month)).crossJoin(F.broadcast(last)).join(own, "y__", "left").join(nxt, "y__", "left")
    v0 = F.coalesce("v0", F.when(F.col("y__") > F.col("ly"), F.col("lv")))
    v1 = F.coalesce("v1", F.when(F.col("y__") + 1 > F.col("ly"), F.col("lv")))
    return rows.withColumn(name, (12 - F.month(month)) / 12.0 * v0 + F.month(month) / 12.0 * v1).drop("y__", "v0", "v1", "ly", "lv")


def last_of_month(rows: DataFrame, day: str, value: str) -> DataFrame:
    """Monthly mean, last non-null value, and number of values."""
    known = F.when(F.col(value).isNotNull(), F.col(day))
    return rows.groupBy(F.trunc(day, "MONTH").alias("month")).agg(F.avg(value).alias("mean"), F.max_by(value, known).alias("last"), F.count(value).alias("n"))
