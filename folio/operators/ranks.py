"""Numbers and running sums in an order over all rows, without a task that sees them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def _in_ranges(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with range__: ranges of the order (nulls first), bounded by the keys of least hash, as many as the session has shuffle
    partitions. The driver holds a key for each."""
    key = F.struct(*order)
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = rows.select(*order).orderBy(F.xxhash64(*order), *order).limit(n).collect()
    types = [rows.schema[c].dataType for c in order]
    literals = [F.struct(*(F.lit(v).cast(t).alias(c) for v, t, c in zip(b, types, order, strict=True))) for b in bounds]
    return rows.withColumn("range__", F.size(F.filter(F.array(*literals), lambda b: b <= key)) if bounds else F.lit(0))


def _summed(rows: DataFrame, order: list[str], amount: Column, name: str) -> DataFrame:
    ranged = _in_ranges(rows, order)
    sums = ranged.groupBy("range__").agg(F.sum(amount).alias("n__"))  # a row for each range
    before = sums.select("range__", F.coalesce(F.sum("n__").over(W.orderBy("range__").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before__"))
    own = F.sum(amount).over(W.partitionBy("range__").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return ranged.withColumn("own__", own).join(F.broadcast(before), "range__").withColumn(name, F.col("before__") + F.col("own__")).drop("range__", "own__", "before__")


def with_row_number(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """rows with their number from 0 in the given order (nulls first); equal keys in any order."""
    return _summed(rows, order, F.lit(1), name).withColumn(name, F.col(name) - 1)


def running_total(rows: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """rows with the sum of a value over all rows up to and including theirs in the given order, which tells rows apart."""
    return _summed(rows, order, F.col(value), name)


def with_standard_score(rows: DataFrame, value: str, name: str, ddof: int = 0) -> DataFrame:
    """rows with the distance of a value from the mean of all, in standard deviations; null without spread. One row is broadcast."""
    sd = F.stddev_pop(value) if ddof == 0 else F.stddev_samp(value)
    one = rows.agg(F.avg(value).alias("mean__"), sd.alias("sd__"))
    return rows.crossJoin(F.broadcast(one)).withColumn(name, F.try_divide(F.col(value) - F.col("mean__"), F.col("sd__"))).drop("mean__", "sd__")
