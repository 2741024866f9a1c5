"""Business days as a table: each day with the number of business days before it, so that spans are differences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

# Holidays of fixed date (month, day, first year), and days from Easter of the movable ones.
FIXED = [(1, 1, 0), (4, 21, 0), (5, 1, 0), (9, 7, 0), (10, 12, 0), (11, 2, 0), (11, 15, 0), (11, 20, 2024), (12, 25, 0)]
MOVABLE = [-48, -47, -2, 60]


def easter(year: str) -> str:
    """SQL for Easter Sunday of a year's expression: the Gregorian computus from golden number and epact."""
    century = f"({year} div 100)"
    epact = f"pmod({century} - {century} div 4 - (8 * {century} + 13) div 25 + 19 * pmod({year}, 19) + 15, 30)"
    full = f"({epact} - ({epact} div 28) * (1 - (29 div ({epact} + 1)) * ((21 - pmod({year}, 19)) div 11)))"
    weekday = f"pmod({year} + {year} div 4 + {full} + 2 - {century} + {century} div 4, 7)"
    return f"date_add(make_date({year}, 3, 28), cast({full} - {weekday} as int))"


def holidays(spark: SparkSession, first: int, last: int) -> DataFrame:
    years = spark.range(first, last + 1).select(F.col("id").cast("int").alias("y")).withColumn("easter", F.expr(easter("y")))
    fixed = years.select(F.explode(F.expr("array(" + ", ".join(f"if(y >= {since}, make_date(y, {m}, {d}), null)" for m, d, since in FIXED) + ")")).alias("day"))
    movable = years.select(F.explode(F.array(*(F.date_add("easter", k) for k in MOVABLE))).alias("day"))
    return fixed.union(movable).where("day is not null").distinct()


def business_calendar(spark: SparkSession, first: int, last: int, extra: DataFrame | None = None) -> DataFrame:
    """day, is_business, n (business days before it), previous, next and same_or_next business day, of all days of the years.

    One row a day: a few thousand rows for any data, so its ordered windows and broadcasts are bounded by the years."""
    free = holidays(spark, first, last) if extra is None else holidays(spark, first, last).union(extra.select("day")).distinct()
    days = spark.sql(f"select explode(sequence(make_date({first}, 1, 1), make_date({last}, 12, 31))) as day")
    marked = days.join(F.broadcast(free.withColumn("free", F.lit(True))), "day", "left").withColumn("is_business", F.col("free").isNull() & F.weekday("day").between(0, 4)).drop("free")
    w = W.orderBy("day")
    own = F.when(F.col("is_business"), F.col("day"))
    return marked.select(
        "day", "is_business", F.coalesce(F.count_if("is_business").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("n"),
        F.last(own, True).over(w.rowsBetween(W.unboundedPreceding, -1)).alias("previous"), F.first(own, True).over(w.rowsBetween(1, W.unboundedFollowing)).alias("next"),
        F.first(own, True).over(w.rowsBetween(0, W.unboundedFollowing)).alias("same_or_next"),
    )


def business_days(rows: DataFrame, calendar: DataFrame, start: str, end: str, name: str = "business_days") -> DataFrame:
    """rows with the number of business days from start (included) to end (excluded); negative if end is before."""
    index = lambda d: F.broadcast(calendar.select(F.col("day").alias(d), F.col("n").alias(f"n_{d}")))
    return rows.join(index(start), start, "left").join(index(end), end, "left").withColumn(name, F.col(f"n_{end}") - F.col(f"n_{start}")).drop(f"n_{end}", f"n_{start}")


def maturities(calendar: DataFrame) -> DataFrame:
    """(maturity, code): the first business day of each month."""
    from ..functions.formulas import contract_code

    first = calendar.where("is_business").groupBy(F.trunc("day", "MONTH").alias("month")).agg(F.min("day").alias("maturity"))
    return first.select("maturity", contract_code(F.col("maturity")).alias("code"))


def next_maturities(days: DataFrame, calendar: DataFrame, day: str, k: int) -> DataFrame:
    """A row for each of the first k maturities strictly after the day: rank, maturity, code.

    Each day looks at the k + 2 months from its own on, by equality."""
    table = maturities(calendar).withColumn("month__", F.trunc("maturity", "MONTH"))
    wide = days.select("*", F.explode(F.sequence(F.lit(0), F.lit(k + 1))).alias("k__")).withColumn("month__", F.add_months(F.trunc(day, "MONTH"), F.col("k__")))
    found = wide.join(F.broadcast(table), "month__").where(F.col("maturity") > F.col(day))
    ranked = found.withColumn("rank", F.row_number().over(W.partitionBy(*days.columns).orderBy("maturity")))
    return ranked.where(F.col("rank") <= k).drop("k__", "month__")


def meeting_calendar(meetings: DataFrame, calendar: DataFrame, schedule: DataFrame | None = None) -> DataFrame:
    """Meetings (number, day, rate, effective, extraordinary) with sessions around, next meeting, change in basis points, code
    within the year, and the short contract: the first maturity after the rate takes effect, its factor and the meetings before it.

    Meetings are a few hundred rows."""
    cal = F.broadcast(calendar.select(F.col("day"), "is_business", "previous", "next"))
    w = W.orderBy("day")
    rows = meetings.withColumns({"previous_rate": F.lag("rate").over(w), "own_next": F.lead("day").over(w)}).join(cal, "day")
    later = schedule if schedule is not None else meetings
    nexts = rows.select("number", "day").join(later.select(F.col("day").alias("d2")).distinct(), F.col("d2") > F.col("day"), "left").groupBy("number").agg(F.min("d2").alias("next_meeting"))
    rows = rows.drop("own_next").join(nexts, "number").withColumns({
        "session_before": F.col("previous"), "session_day": F.when(F.col("is_business"), F.col("day")).otherwise(F.col("previous")), "session_after": F.col("next"),
        "effective": F.coalesce("effective", "next"), "change_bps": F.round(100 * (F.col("rate") - F.col("previous_rate")), 1),
    }).drop("previous", "next")
    ordinary = W.partitionBy(F.year("day"), "extraordinary").orderBy("day")
    rows = rows.withColumn("code", F.when(F.col("extraordinary"), "").otherwise(F.concat(F.lit("R"), F.row_number().over(ordinary), F.lit("/"), F.year("day"))))
    short = next_maturities(rows.select("number", "effective"), calendar, "effective", 1).select("number", F.col("maturity").alias("short_maturity"), F.col("code").alias("short_code"))
    rows = rows.join(short, "number", "left")
    rows = business_days(rows, calendar, "session_after", "short_maturity", "days_after")
    rows = business_days(rows, calendar, "effective", "short_maturity", "days_effective")
    before = rows.select("number", "day", "short_maturity").join(later.select(F.col("day").alias("d2")).distinct(), (F.col("d2") > F.col("day")) & (F.col("d2") < F.col("short_maturity")), "left").groupBy("number").agg(F.count("d2").alias("meetings_before_maturity"))
    rows = rows.join(before, "number")
    factor = F.when(F.col("days_effective") > 0, F.col("days_after") / F.col("days_effective"))
    return rows.withColumns({"factor": factor, "crosses_next": F.col("next_meeting") < F.col("short_maturity"), "too_short": F.col("days_effective") < 5})


def islands(rows: DataFrame, keys: list[str], day: str, gap: int) -> DataFrame:
    """rows with island: a new one where the day before, within the keys, is more than `gap` days earlier."""
    w = W.partitionBy(*keys).orderBy(day)
    new = F.coalesce((F.datediff(F.col(day), F.lag(day).over(w)) > gap).cast("int"), F.lit(1))
    return rows.withColumn("new__", new).withColumn("island", F.sum("new__").over(w)).drop("new__")


def run_lengths(rows: DataFrame, keys: list[str], day: str, flag: str) -> DataFrame:
    """rows with run: how many rows in a row, up to this one, have the flag."""
    w = W.partitionBy(*keys).orderBy(day)
    off = F.sum((~F.coalesce(F.col(flag), F.lit(False))).cast("int")).over(w)
    return rows.withColumn("off__", off).withColumn("run", F.sum(F.coalesce(F.col(flag), F.lit(False)).cast("int")).over(W.partitionBy(*keys, "off__").orderBy(day))).drop("off__")
