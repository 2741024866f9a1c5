"""Dates, periods and local formats as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The local zone, and the first day of the targets' regime.
ZONE, REGIME = "America/Sao_Paulo", "1999-07-01"


def local_time(text: Column, zone: str = ZONE) -> Column:
    """The local wall time of a date and time in text; one without an offset is local already. Null if it isn't a time."""
    known = F.try_to_timestamp(text)
    offset = text.rlike(r"(Z|[+-]\d{2}:?\d{2})\s*$") & text.rlike(r"\d:\d{2}")
    return F.when(offset, F.convert_timezone(F.current_timezone(), F.lit(zone), known.cast("timestamp_ntz"))).otherwise(text.try_cast("timestamp_ntz"))


def period_number(day: Column, unit: str = "MONTH") -> Column:
    """Months or quarters since year 0, so that differences count periods."""
    months = F.year(day) * 12 + F.month(day) - 1
    return months if unit == "MONTH" else F.floor(months / 3).cast("int")


def period_from(day: Column, k: int, unit: str = "MONTH") -> Column:
    """First day of the period k after that of the day."""
    return F.add_months(F.trunc(day, unit), k * (1 if unit == "MONTH" else 3))


def months_in_window(period: Column, first: Column, back: int) -> Column:
    """How many of the `back` months that end with the period the series has: fewer at its start."""
    return F.least(F.lit(back), period_number(period) - period_number(first) + 1)


def shifted_date(day: Column, forward: Column, today: Column, years: int = 5, first: str = REGIME, margin: int = 30) -> Column:
    """The day moved by some years, forward or back; the other way if that leaves [first, today - margin]; cut to it if both do."""
    low, high = F.to_date(F.lit(first)), F.date_sub(today, margin)
    there, back = F.add_months(day, 12 * years), F.add_months(day, -12 * years)
    one, other = F.when(forward, there).otherwise(back), F.when(forward, back).otherwise(there)
    return F.when(one.between(low, high), one).when(other.between(low, high), other).otherwise(F.least(F.greatest(other, low), high))


def year_slice(year: Column, first: Column, end: Column) -> Column:
    """struct(first, end, whole): the part of [first, end) in the year, and whether it is all of it."""
    a, b = F.greatest(F.make_date(year, F.lit(1), F.lit(1)), first), F.least(F.make_date(year + 1, F.lit(1), F.lit(1)), end)
    return F.struct(a.alias("first"), b.alias("end"), ((F.make_date(year, F.lit(1), F.lit(1)) >= first) & (F.make_date(year + 1, F.lit(1), F.lit(1)) <= end)).alias("whole"))


def midpoint(period: Column, unit: str = "MONTH") -> Column:
    """Where a period is plotted: 14 days into a month, 45 into a quarter."""
    return F.date_add(period, 14 if unit == "MONTH" else 45)


def number_label(value: Column, digits: int = 2) -> Column:
    """Points for thousands, a comma for decimals."""
    return F.translate(F.format_number(value, digits), ",.", ".,")


def query_string(**parts: Column) -> Column:
    """name=value pairs of a url's query, spaces as %20; null values are left out."""
    code = lambda c: F.replace(F.url_encode(c.cast("string")), F.lit("+"), F.lit("%20"))
    return F.concat_ws("&", *(F.concat(F.lit(f"{k}="), code(c)) for k, c in parts.items()))
