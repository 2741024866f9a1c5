"""Readers of logs and of text formats, and cumulative writes. Schemas are always given."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import number


def json_lines(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows, broken): the records of a folder of JSON lines, and the text of the lines that aren't records."""
    lines = spark.read.text(path).where("trim(value) <> ''")
    parsed = lines.select("value", F.from_json("value", schema + ", _broken string", {"columnNameOfCorruptRecord": "_broken", "mode": "PERMISSIVE"}).alias("r"))
    return parsed.where("r._broken is null").select("r.*").drop("_broken"), parsed.where("r._broken is not null").select("value")


def fixed_width(lines: DataFrame, fields: dict[str, tuple[int, int]], line: str = "value") -> DataFrame:
    """Trimmed fields (first character from 1, length) of each line, null where the line is too short or blank."""
    cut = {n: F.nullif(F.trim(F.substring(F.col(line), a, k)), F.lit("")) for n, (a, k) in fields.items()}
    return lines.select(*(c.alias(n) for n, c in cut.items()))


def signed_fixed(sign: Column, digits: Column, scale: float) -> Column:
    """A number of digits with its sign in another field."""
    return F.when(sign == "-", -1.0).otherwise(1.0) * digits.try_cast("double") * scale


def sections(texts: DataFrame, text: str, headers: dict[str, str], sep: str = ";") -> DataFrame:
    """(section, place, fields) of the lines of each text, by the last header line above them; headers: start of line -> section.

    One fold over the lines of a text; lines above all headers, headers and blank lines are left out."""
    name = F.lit(None).cast("string")
    is_header = lambda s: [(s.startswith(h), n) for h, n in headers.items()]

    def step(acc, s):
        found = name
        for hit, n in is_header(s):
            found = F.when(hit, n).otherwise(found)
        row = F.struct(acc["at"].alias("section"), s.alias("line"))
        return F.struct(F.coalesce(found, acc["at"]).alias("at"), F.when(found.isNotNull() | acc["at"].isNull() | (F.trim(s) == ""), acc["rows"]).otherwise(F.array_append(acc["rows"], row)).alias("rows"))

    start = F.struct(name.alias("at"), F.array().cast("array<struct<section:string,line:string>>").alias("rows"))
    rows = F.aggregate(F.split(F.col(text), "\r?\n"), start, step, lambda acc: acc["rows"])
    return texts.select(F.posexplode(rows).alias("place", "r")).select("r.section", "place", F.split("r.line", re.escape(sep)).alias("fields"))


def separated(lines: DataFrame, names: list[str], sep: str, line: str = "value") -> DataFrame:
    """Lines with as many fields as names, each once; a preamble and repeated lines fall out."""
    parts = F.split(F.col(line), re.escape(sep))
    return lines.where(F.size(parts) == len(names)).distinct().select(*(F.trim(parts[i]).alias(n) for i, n in enumerate(names)))


def series(rows: DataFrame, day: str, value: str, low: float | None = None, high: float | None = None) -> DataFrame:
    """(day, value) of text columns: local numbers, what doesn't parse or lies outside (low, high) left out."""
    out = rows.select(F.coalesce(F.try_to_timestamp(F.col(day), F.lit("yyyy-MM-dd")), F.try_to_timestamp(F.col(day), F.lit("dd/MM/yyyy"))).cast("date").alias("day"), F.coalesce(F.col(value).try_cast("double"), number(F.col(value))).alias("value"))
    out = out.where("day is not null and value is not null")
    return out if low is None else out.where((F.col("value") > low) & (F.col("value") < high))


def scored(spark: SparkSession, rows: DataFrame, message: str, complete, schema: str = "answer string, error string") -> DataFrame:
    """rows with the answer of a provider, `complete(text) -> str`, called in each task; a failure is an error, not the job's end."""
    names = rows.columns

    def run(batches):
        for pdf in batches:
            got = []
            for m in pdf[message]:
                try:
                    got.append((complete(m), None))
                except Exception as e:  # noqa: BLE001  the row says what went wrong
                    got.append((None, f"{type(e).__name__}: {e}"))
            pdf["answer"], pdf["error"] = zip(*got, strict=True) if got else ((), ())
            yield pdf[[*names, "answer", "error"]]

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInPandas(run, f"{kept}, {schema}")
