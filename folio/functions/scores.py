"""Parsers of model answers, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DIMS = ("d1", "d2", "d3")


def _score(raw: Column) -> Column:
    """1 to 5 from a JSON number or a string of one, 4.0 being 4; booleans, fractions and others are null."""
    value = F.trim(raw).try_cast("double")
    return F.when(value.between(1, 5) & (value == F.floor(value)), value.cast("int"))


def parsed_answer(text: Column, neutral_null: bool = False) -> Column:
    """struct(d1, d1_no_signal, d2, d3, valid) of an answer that holds a JSON object, fenced or not, or one with doubled quotes.

    Without the key d1 it is invalid. A null d1 means no signal (neutral_null: score 3 instead); any other d1 must be 1 to 5."""
    body = F.regexp_replace(F.regexp_extract(text, r"(?s)\{.*\}", 0), '""', '"')
    raw = {d: F.get_json_object(body, f"$.{d}") for d in DIMS}
    loose = {d: F.nullif(F.regexp_extract(body, rf"(?i)[\"']?{d}[\"']?\s*[:=]\s*[\"']?(null|true|false|-?[0-9.]+)", 1), F.lit("")) for d in DIMS}
    is_json = F.json_object_keys(body).isNotNull()
    got = {d: F.when(is_json, raw[d]).otherwise(F.nullif(loose[d], F.lit("null"))) for d in DIMS}
    has_key = F.when(is_json, F.array_contains(F.json_object_keys(body), "d1")).otherwise(loose["d1"].isNotNull())
    d1 = _score(got["d1"])
    empty = got["d1"].isNull()
    valid = has_key & (empty | d1.isNotNull())
    return F.struct(
        F.when(valid & empty & F.lit(neutral_null), 3).otherwise(d1).alias("d1"), (valid & empty & F.lit(not neutral_null)).alias("d1_no_signal"),
        F.when(valid, _score(got["d2"])).alias("d2"), F.when(valid, _score(got["d3"])).alias("d3"), F.coalesce(valid, F.lit(False)).alias("valid"),
    )


def parsed_batch(text: Column, n: Column) -> Column:
    """array of struct(place, d1, d2, d3, no_signal) from lines `place|d1|d2|d3`; S or - is no signal; the first line of a place
    counts, places beyond n and scores beyond 1 to 5 don't."""
    pattern = r"^\s*\[?(\d+)\]?\s*\|\s*([1-9S-])\s*\|\s*([1-9S-])\s*\|\s*([1-9S-])\s*$"
    lines = F.filter(F.split(text, "\n"), lambda s: s.rlike("(?i)" + pattern))
    part = lambda s, k: F.regexp_extract(s, "(?i)" + pattern, k)
    rows = F.transform(lines, lambda s: F.struct(part(s, 1).try_cast("int").alias("place"), *(part(s, k + 2).try_cast("int").alias(d) for k, d in enumerate(DIMS)), part(s, 2).rlike("[Ss-]").alias("no_signal")))
    fits = F.filter(rows, lambda r: r["place"].between(1, n) & (r["no_signal"] | r["d1"].between(1, 5)) & F.coalesce(r["d2"] <= 5, F.lit(True)) & F.coalesce(r["d3"] <= 5, F.lit(True)))
    none = F.array().cast("array<struct<place:int,d1:int,d2:int,d3:int,no_signal:boolean>>")
    return F.aggregate(fits, none, lambda acc, r: F.when(F.exists(acc, lambda x: x["place"] == r["place"]), acc).otherwise(F.array_append(acc, r)))


def parsed_year(text: Column) -> Column:
    """The guessed year from {"ano_estimado": ...}, or the first year of the text; 1900 to 2100."""
    body = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    year = F.coalesce(F.get_json_object(body, "$.ano_estimado").try_cast("double").cast("int"), F.regexp_extract(text, r"\b((?:19|20)\d{2})\b", 1).try_cast("int"))
    return F.when(year.between(1900, 2100), year)


def score_message(**blocks: Column) -> Column:
    """Named blocks, one a line, without the empty ones."""
    return F.concat_ws("\n", *(F.when(F.trim(c) != "", F.concat(F.lit(f"{k}: "), c)) for k, c in blocks.items()))
