"""Formulas of rates, curves and indices as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: letters of contract months, January to December.
MONTH_LETTERS = "FGHJKMNQUVXZ"


def logistic(x: Column, most: float = 40.0) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.lit(-most), F.least(F.lit(most), x))))


def logit(p: Column, least: float = 1e-6) -> Column:
    q = F.greatest(F.lit(least), F.least(F.lit(1 - least), p))
    return F.log(q / (1 - q))


def svensson(t: Column, b1, b2, b3, b4, l1, l2) -> Column:
    """Yield at t years; as t goes to 0, b1 + b2."""
    f = lambda x: (1 - F.exp(-x)) / x
    x, y = l1 * t, l2 * t
    return F.when(t == 0, b1 + b2).otherwise(b1 + b2 * f(x) + b3 * (f(x) - F.exp(-x)) + b4 * (f(y) - F.exp(-y)))


def fisher(nominal: Column, real: Column) -> Column:
    """Breakeven inflation in percent."""
    return ((1 + nominal / 100) / (1 + real / 100) - 1) * 100


def contract_code(day: Column, prefix: str = "DI1") -> Column:
    return F.concat(F.lit(prefix), F.substring(F.lit(MONTH_LETTERS), F.month(day), F.lit(1)), F.lpad((F.year(day) % 100).cast("string"), 2, "0"))


def credibility_distance(expected: Column, target: Column, limit: float = 20.0) -> Column:
    """1 on the target, falling on both sides to 0 at the limit's distance; 0 for expectations below 0 or from the limit on."""
    share = 1 - F.abs(expected - target) / (F.lit(limit) - target)
    return F.when((expected >= limit) | (expected < 0), target * 0).when(share.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), share)))


def credibility_band(expected: Column, target: Column, band: Column, limit: float = 20.0) -> Column:
    """1 within the band; above it falling to 0 at the limit, below it to 0 at 0; null if any input is null."""
    high, low = target + band, target - band
    above, below = 1 - (expected - high) / (F.lit(limit) - high), 1 - F.try_divide(low - expected, F.when(low > 0, low))
    inside = F.when((expected >= limit) | (expected < 0), 0.0).when(expected > high, above).when(expected < low, below).otherwise(1.0)
    known = expected.isNotNull() & target.isNotNull() & band.isNotNull()
    return F.when(known & inside.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), inside)))


def fisher_z_interval(r: Column, n: Column, z: float = 1.959963984540054) -> Column:
    """struct(low, high) for a correlation."""
    half = z / F.sqrt(n - 3)
    return F.struct(F.tanh(F.atanh(r) - half).alias("low"), F.tanh(F.atanh(r) + half).alias("high"))


def ordinal_targets(y: Column, k: int = 5) -> Column:
    """k - 1 flags: whether y is above 1, 2, ..."""
    return F.transform(F.sequence(F.lit(1), F.lit(k - 1)), lambda j: (y > j).cast("int"))


def ordinal_label(p: Column) -> Column:
    """1 and the number of thresholds passed with a probability over 0.5."""
    return F.size(F.filter(p, lambda x: x > 0.5)) + 1


def ordinal_mean(p: Column) -> Column:
    return F.aggregate(p, F.lit(1.0), lambda s, x: s + x)


def row_mean(*cols: Column) -> Column:
    """Mean of the non-null ones."""
    n = sum((c.isNotNull().cast("int") for c in cols), F.lit(0))
    return F.try_divide(sum((F.coalesce(c, F.lit(0.0)) for c in cols), F.lit(0.0)), n)
