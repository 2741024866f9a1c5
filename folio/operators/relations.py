"""Small relational operators: joins with defaults and suffixes, coverage, summaries, allow-lists, sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def left_with_default(left: DataFrame, right: DataFrame, key: str, column: str, default) -> DataFrame:
    """left with a column of right, a default where right has no such key or a null."""
    found = right.select(F.col(key), F.col(column).alias("right__"))
    return left.join(found, key, "left").withColumn(column, F.coalesce("right__", F.lit(default))).drop("right__")


def variant_changes(base: DataFrame, other: DataFrame, key: str, values: list[str]) -> DataFrame:
    """Rows of both variants: key, each value of both (suffixes _base, _other) and its change. Rows without a value are kept as null."""
    a = base.select(key, *(F.col(v).alias(f"{v}_base") for v in values))
    b = other.select(key, *(F.col(v).alias(f"{v}_other") for v in values))
    return a.join(b, key).withColumns({f"{v}_change": F.col(f"{v}_other") - F.col(f"{v}_base") for v in values})


def change_summary(changes: DataFrame, values: list[str], keys: list[str] = ()) -> DataFrame:
    """n, mean, mean absolute change and share changed of each value's change; a row for each value."""
    stacked = changes.select(*keys, F.explode(F.create_map(*(x for v in values for x in (F.lit(v), F.col(f"{v}_change").cast("double"))))).alias("value", "change")).where("change is not null")
    return stacked.groupBy(*keys, "value").agg(F.count("*").alias("n"), F.avg("change").alias("mean_change"), F.avg(F.abs("change")).alias("mean_abs_change"), F.avg((F.col("change") != 0).cast("int")).alias("share_changed"))


def with_series(panel: DataFrame, series: dict[str, DataFrame], key: str, suffix: str = "_right") -> DataFrame:
    """panel with the columns of each series at its key; a column that is there already gets the suffix.

    The series are stacked first, so there is one exchange for all and one for the panel."""
    taken, kinds, parts = {c.lower() for c in panel.columns}, {}, []
    for s in series.values():
        names = {}
        for c in s.columns:
            if c != key:
                name = c
                while name.lower() in taken:
                    name += suffix
                taken.add(name.lower())
                names[c] = name
                kinds[name] = s.schema[c].dataType
        parts.append(s.select(key, *(F.col(c).alias(n) for c, n in names.items())))
    if not kinds:
        return panel
    full = [p.select(key, *((F.col(n) if n in p.columns else F.lit(None).cast(t)).alias(n) for n, t in kinds.items())) for p in parts]
    wide = reduce(DataFrame.union, full).groupBy(key).agg(*(F.max(n).alias(n) for n in kinds))
    return panel.join(wide, key, "left")


def groups_of_at_least(rows: DataFrame, keys: list[str], n: int, name: str = "n") -> DataFrame:
    """Groups of at least n rows, with their number."""
    return rows.groupBy(*keys).agg(F.count("*").alias(name)).where(F.col(name) >= n)


def first_mean_size(rows: DataFrame, keys: list[str], order: str, first: str, value: str) -> DataFrame:
    """By key: the first row's column in the given order, the mean of a value, and the number of rows."""
    return rows.groupBy(*keys).agg(F.min_by(first, order).alias("first"), F.avg(value).alias("mean"), F.count("*").alias("size"))


def pivot_mean(rows: DataFrame, row: str, column: str, values: list, value: str) -> DataFrame:
    """Means of a value by row and, side by side, by the given values of a column."""
    return rows.groupBy(row).agg(*(F.avg(F.when(F.col(column) == v, F.col(value))).alias(str(v)) for v in values))


def column_coverage(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(column, share): how much of each column isn't null. One pass."""
    one = rows.agg(*(F.avg(F.col(c).isNotNull().cast("int")).alias(c) for c in columns))
    return one.select(F.explode(F.create_map(*(x for c in columns for x in (F.lit(c), F.col(c))))).alias("column", "share"))


def run_summary(log: DataFrame, by: str, n: str) -> DataFrame:
    """By outlet: sum of what its work units found, and their number."""
    return log.groupBy(by).agg(F.sum(n).alias("found"), F.count("*").alias("units"))


def monthly_coverage(rows: DataFrame, outlet: str, day: str) -> DataFrame:
    """By outlet: months from the first to the last of all rows, how many of them it has no row in, and its rows."""
    months = rows.groupBy(outlet, F.trunc(day, "MONTH").alias("m")).agg(F.count("*").alias("n"))
    ends = months.agg((F.floor(F.months_between(F.max("m"), F.min("m"))) + 1).cast("long").alias("months"))
    return months.groupBy(outlet).agg(F.count("*").alias("has"), F.sum("n").alias("n")).crossJoin(F.broadcast(ends)).select(outlet, "months", (F.col("months") - F.col("has")).alias("empty"), "n")  # one row


def yearly_completeness(rows: DataFrame, outlet: str, day: str, complete: Column) -> DataFrame:
    """By outlet and year: rows, how many are complete, and their share."""
    ok = F.coalesce(complete, F.lit(False)).cast("int")
    return rows.groupBy(outlet, F.year(day).alias("year")).agg(F.sum(ok).alias("complete"), F.avg(ok).alias("share"), F.count("*").alias("n"))


def allowed(rows: DataFrame, column: str, values: list) -> tuple[DataFrame, DataFrame]:
    """(rows with a value of the list, (value, n) of the others)."""
    inside = F.coalesce(F.col(column).isin(values), F.lit(False))
    return rows.where(inside), rows.where(~inside).groupBy(column).agg(F.count("*").alias("n"))


def of_species(rows: DataFrame, column: str, kinds: list[str]) -> DataFrame:
    """Rows of one of the kinds, or of none."""
    return rows.where(F.col(column).isNull() | F.col(column).isin(kinds))


def without_holdout(rows: DataFrame, manifest: DataFrame, key: str, share: float = 0.10) -> DataFrame:
    """Rows that neither the manifest nor the hash rule holds out: what was ever held out stays out as data grows."""
    from ..functions.ids import in_holdout

    return rows.where(~in_holdout(F.col(key), share)).join(manifest.select(key).distinct(), key, "left_anti")


def curve_points(bonds: DataFrame, years: str, rate: str, least: float = 0.5) -> DataFrame:
    """Points of a curve: maturities from `least` years on, rates that aren't positive as null."""
    return bonds.where(F.col(years) >= least).withColumn(rate, F.when(F.col(rate) > 0, F.col(rate)))


def ends_of(rows: DataFrame, order: str, value: str, keys: list[str] = ()) -> DataFrame:
    """First and last value in the given order, by key."""
    return rows.groupBy(*keys).agg(F.min_by(value, order).alias("first"), F.max_by(value, order).alias("last"))


def filled_forward(rows: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """rows whose nulls have the last known value before them, within the keys."""
    from pyspark.sql import Window as W

    w = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn(value, F.last(value, ignorenulls=True).over(w))


def unique_in_order(items: Column) -> Column:
    """A list without what it has had before."""
    return F.array_distinct(items)


def has_all(items: Column, needed: list) -> Column:
    """Whether all of the needed values are in a list."""
    return F.size(F.array_except(F.array(*map(F.lit, needed)), items)) == 0


def gaps_and_flags(rows: DataFrame, expected: str, target: str, band: str) -> DataFrame:
    """rows with gap, its sign turned, and flags (0 or 1, null if an input is) for an expectation above or below the band."""
    e, t, b = F.col(expected), F.col(target), F.col(band)
    return rows.withColumns({"gap": e - t, "gap_turned": t - e, "above_band": (e > t + b).cast("double"), "below_band": (e < t - b).cast("double")})


def slopes(curves: DataFrame, keys: list[str], at: str, value: str, pairs: list[tuple[float, float]]) -> DataFrame:
    """By key: the value at the longer tenor less that at the shorter, a column for each pair; null if either is missing."""
    v = lambda x: F.max(F.when(F.col(at) == x, F.col(value)))
    return curves.groupBy(*keys).agg(*((v(b) - v(a)).alias(f"slope_{a:g}_{b:g}") for a, b in pairs))


def band_years(months: DataFrame, day: str, value: str, target: str, band: str, run: int = 6) -> DataFrame:
    """By year: whether its last month is in the band, months outside of it, and the longest run of such months that reaches into
    the year, with the rule that `run` of them in a row break the target. Months are few."""
    from .calendar import run_lengths

    out = F.coalesce(F.abs(F.col(value) - F.col(target)) > F.col(band), F.lit(False))
    rows = run_lengths(months.withColumns({"outside": out, "all__": F.lit(1)}), ["all__"], day, "outside")
    g = rows.groupBy(F.year(day).alias("year")).agg((~F.max_by("outside", day)).alias("met"), F.sum(F.col("outside").cast("int")).alias("outside"), F.max("run").alias("longest"))
    return g.withColumn("broken", F.col("longest") >= run)
