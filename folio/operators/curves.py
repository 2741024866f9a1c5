"""Yield curves as point sets: interpolation by brackets, durations, wide daily curves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .calendar import business_days


def _bracketed(points: DataFrame, targets: DataFrame, keys: list[str], x: str, y: str, at: str) -> DataFrame:
    """keys and target with (x, y) of the last point at or below and the first at or above it.

    All in one ordered array a curve: no pairs of points and targets are made before the lookup."""
    curve = points.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*keys, x).agg(F.avg(y).alias(y)).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")))).alias("ps"))
    wide = curve.crossJoin(F.broadcast(targets.select(at)))  # tenors: a handful
    low = F.try_element_at(F.filter("ps", lambda p: p["x"] <= F.col(at)), F.lit(-1))
    return wide.withColumns({"low": low, "high": F.get(F.filter("ps", lambda p: p["x"] >= F.col(at)), 0)}).drop("ps")


def flat_forward(points: DataFrame, targets: DataFrame, keys: list[str], days: str = "du", rate: str = "rate", base: float = 252.0) -> DataFrame:
    """Rates in percent at the targets' business days: the accrual factor is log-linear between points; null outside them.

    Points of the same days count once, by their mean."""
    b = _bracketed(points, targets, keys, days, rate, "at")
    log = lambda p: F.log(1 + p["y"] / 100) * p["x"] / base
    low, high = F.col("low"), F.col("high")
    share = (F.col("at") - low["x"]) / (high["x"] - low["x"])
    value = F.when(low["x"] == high["x"], low["y"]).otherwise((F.exp((log(low) + share * (log(high) - log(low))) * base / F.col("at")) - 1) * 100)
    return b.select(*keys, "at", F.when(low.isNotNull() & high.isNotNull(), value).alias("rate"))


def linear(points: DataFrame, targets: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Linear between points, null outside them."""
    b = _bracketed(points, targets, keys, x, y, "at")
    low, high = F.col("low"), F.col("high")
    value = F.when(low["x"] == high["x"], low["y"]).otherwise(low["y"] + (F.col("at") - low["x"]) / (high["x"] - low["x"]) * (high["y"] - low["y"]))
    return b.select(*keys, "at", F.when(low.isNotNull() & high.isNotNull(), value).alias("value"))


def vertices(points: DataFrame, targets: DataFrame, keys: list[str], days: str = "du", rate: str = "rate") -> DataFrame:
    """The curve at standard days, and its longest point as the vertex -1."""
    real = points.where(F.col(days) > 0)
    longest = real.groupBy(*keys).agg(F.max(days).cast("double").alias("rate")).select(*keys, F.lit(-1).alias("at"), "rate")
    return flat_forward(real, targets, keys, days, rate).unionByName(longest)


def coupon_days(day: Column, maturity: Column) -> Column:
    """Every six months back from maturity, while after the day; at least maturity itself."""
    n = F.greatest(F.floor(F.months_between(maturity, day) / 6).cast("int"), F.lit(0)) + 1
    return F.filter(F.transform(F.sequence(F.lit(0), n), lambda k: F.add_months(maturity, -6 * k)), lambda d: (d > day) | (d == maturity))


def durations(bonds: DataFrame, calendar: DataFrame, key: str) -> DataFrame:
    """(key, duration) in years of bonds (day, maturity, rate in percent, coupon a year as a share): half-yearly coupons."""
    flows = bonds.select(key, "day", "maturity", "rate", "coupon", F.explode(coupon_days(F.col("day"), F.col("maturity"))).alias("paid"))
    flows = business_days(flows, calendar, "day", "paid", "du").withColumn("t", F.col("du") / 252.0)
    amount = F.sqrt(1 + F.col("coupon")) - 1 + F.when(F.col("paid") == F.col("maturity"), 1.0).otherwise(0.0)
    value = amount / F.pow(1 + F.col("rate") / 100, F.col("t"))
    return flows.groupBy(key).agg((F.sum(F.col("t") * value) / F.sum(value)).alias("duration"))


def wide_curves(points: DataFrame, targets: DataFrame, day: str, kinds: tuple[str, str] = ("nominal", "real")) -> DataFrame:
    """Each day's curves of two kinds at the targets (years), and the breakeven between them, a row for each day and target."""
    from ..functions.formulas import fisher

    at = linear(points, targets, [day, "kind"], "years", "rate")
    wide = at.groupBy(day, "at").pivot("kind", list(kinds)).agg(F.max("value"))
    return wide.withColumn("breakeven", fisher(F.col(kinds[0]), F.col(kinds[1])))
