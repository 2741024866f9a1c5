"""Readers of files by their form: suffixes, delimited series, yearly tables, archives, embedded JSON. Columns are always named."""

from __future__ import annotations

import io
import json
import os
import zipfile
from collections import deque
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .logs import series


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path, or any path of a pattern, is there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at)
    return found is not None and len(found) > 0


def by_suffix(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """parquet, csv (gz too) or json lines by the path's suffix; all columns of a csv are text. Workbooks need a converter first."""
    name = path.lower().removesuffix(".gz")
    if name.endswith(".parquet"):
        out = spark.read.parquet(path)
    elif name.endswith(".csv"):
        out = spark.read.option("header", True).option("enforceSchema", False).csv(path)
    elif name.endswith((".jsonl", ".json")):
        out = spark.read.json(path)
    else:
        raise ValueError(f"no reader for {path}")
    return out.select(*columns) if columns else out


def delimited(spark: SparkSession, path: str, sep: str = ";", rename: dict[str, str] | None = None, days: dict[str, str] | None = None, numbers: list[str] = ()) -> DataFrame:
    """A table with a header, local numbers (1.234,5) and days in the given patterns; what doesn't parse is null."""
    from ..functions.text import number

    out = spark.read.option("header", True).option("sep", sep).csv(path)
    out = out.withColumnsRenamed(rename or {})
    fixed = {c: F.try_to_timestamp(F.col(c), F.lit(p)).cast("date") for c, p in (days or {}).items()} | {c: number(F.col(c)) for c in numbers}
    return out.withColumns(fixed) if fixed else out


def projected(spark: SparkSession, path: str, columns: list[str], days: list[str] = ()) -> DataFrame:
    """Some columns of a csv; others aren't parsed. Days are ISO."""
    rows = spark.read.option("header", True).csv(path).select(*columns)
    return rows.withColumns({c: F.to_date(c) for c in days}) if days else rows


def day_and_value(spark: SparkSession, path: str, day: str = "data", value: str = "valor") -> DataFrame:
    """(day, value) of a csv whose header has both names in any case; a ValueError names what is missing. Days and numbers that
    don't parse are left out."""
    rows = spark.read.option("header", True).csv(path)
    names = {c.strip().lower(): c for c in rows.columns}
    missing = [c for c in (day, value) if c not in names]
    if missing:
        raise ValueError(f"{path} has no column {', '.join(missing)}; it has {', '.join(rows.columns)}")
    return series(rows, names[day], names[value])


def plausible_rates(spark: SparkSession, path: str, column: str, day: str = "data", low: float = 0.0, high: float = 60.0) -> DataFrame:
    """(day, value) of one rate column, without what lies outside (low, high)."""
    return series(spark.read.option("header", True).csv(path).select(day, column), day, column, low, high)


def yearly_as_monthly(spark: SparkSession, months: DataFrame, path: str, month: str = "month", year: str = "ano", value: str = "valor") -> DataFrame | None:
    """months with the value of their year; None if there is no such file."""
    if not exists(spark, path):
        return None
    rows = spark.read.option("header", True).csv(path).select(F.col(year).try_cast("int").alias("y__"), F.col(value).try_cast("double").alias("value")).where("y__ is not null")
    return months.join(F.broadcast(rows), F.year(month) == F.col("y__"), "left").drop("y__")  # a row for each year


def market_series(spark: SparkSession, name: str, months: DataFrame, folders: list[str], turned: bool = False, month: str = "month") -> DataFrame | None:
    """months with the monthly mean of <name>.csv in the first of the folders that has it (a vendor's before the public one),
    its sign turned if asked; None if none has it."""
    path = next((p for p in (f"{f.rstrip('/')}/{name}.csv" for f in folders) if exists(spark, p)), None)
    if path is None:
        return None
    sign = -1.0 if turned else 1.0
    monthly = day_and_value(spark, path).groupBy(F.trunc("day", "MONTH").alias("m__")).agg((F.avg("value") * sign).alias(name))
    return months.join(monthly, F.col(month) == F.col("m__"), "left").drop("m__")


def bundle(spark: SparkSession, sources: dict[str, str]) -> dict[str, DataFrame]:
    """All series of a catalogue (name -> path) that are there, each read when it is used."""
    return {name: day_and_value(spark, path) for name, path in sources.items() if exists(spark, path)}


def meeting_history(spark: SparkSession, path: str, names: dict[str, str]) -> DataFrame:
    """The records of a history (json: a list of objects, or lines) with their columns renamed, by day; days with an offset
    lose it after the change to local time."""
    from ..functions.dates import local_time

    rows = spark.read.option("multiLine", True).json(path).select(*(F.col(a).alias(b) for a, b in names.items()))
    return rows.withColumn("day", local_time(F.col("day").cast("string")).cast("date")).where("day is not null")


def holiday_list(spark: SparkSession, path: str, column: str = "Data", pattern: str = "dd/MM/yyyy") -> DataFrame:
    """(day) of a list of holidays in csv; footnotes and blank lines don't parse and fall out. The `extra` of a business calendar."""
    rows = spark.read.option("header", True).csv(path)
    return rows.select(F.try_to_timestamp(F.col(column), F.lit(pattern)).cast("date").alias("day")).where("day is not null").distinct()


def members(spark: SparkSession, path: str, suffix: str = "") -> DataFrame:
    """(path, member, content) of all files in zip archives, also in archives within them. An empty or broken archive has none."""

    def unzip(data: bytes, prefix: str) -> Iterator[tuple[str, bytes]]:
        try:
            archive = zipfile.ZipFile(io.BytesIO(data))
        except zipfile.BadZipFile:
            return
        for info in archive.infolist():
            if not info.is_dir():
                content = archive.read(info)
                if info.filename.lower().endswith(".zip"):
                    yield from unzip(content, f"{prefix}{info.filename}/")
                elif info.filename.endswith(suffix):
                    yield prefix + info.filename, content

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = [(p, name, content) for p, data in zip(pdf["path"], pdf["content"], strict=True) for name, content in unzip(data, "")]
            yield pd.DataFrame(rows, columns=["path", "member", "content"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, member string, content binary")


def first_of(document, accept) -> object | None:
    """The first node that accept(key, value) likes, level by level, in the order of the document."""
    queue: deque = deque([(None, document)])
    while queue:
        key, value = queue.popleft()
        if accept(key, value):
            return value
        queue.extend(value.items() if isinstance(value, dict) else ((None, v) for v in value) if isinstance(value, list) else ())
    return None


def response_items(texts: DataFrame, column: str, totals: tuple[str, ...] = ("total", "totalHits", "hits")) -> DataFrame:
    """texts with items (the first list of objects anywhere in the JSON, each as JSON) and total (the first number under one of the
    names); null where the text is no JSON or has none."""
    from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

    schema = StructType([StructField("items", ArrayType(StringType())), StructField("total", LongType())])

    @F.pandas_udf(schema)
    def parse(values):
        import pandas as pd

        rows = []
        for v in values:
            try:
                doc = json.loads(v) if v is not None else None
            except ValueError:
                doc = None
            found = first_of(doc, lambda k, x: isinstance(x, list) and x and all(isinstance(i, dict) for i in x))
            total = first_of(doc, lambda k, x: k in totals and isinstance(x, int) and not isinstance(x, bool))
            rows.append(([json.dumps(i, ensure_ascii=False) for i in found] if found else None, total))
        return pd.DataFrame(rows, columns=["items", "total"]).astype({"total": "Int64"})

    return texts.withColumn("found__", parse(F.col(column))).select(*texts.columns, "found__.items", "found__.total")


def embedded_json(html: Column, id_: str, schema: str) -> Column:
    """The JSON in the script element of that id, as a struct; null if there is none."""
    body = F.regexp_extract(html, rf"""(?is)<script\b[^>]*\bid\s*=\s*["']?{id_}["']?[^>]*>(.*?)</script>""", 1)
    return F.from_json(F.nullif(F.trim(body), F.lit("")), schema)


def configuration(path: str, _held: dict = {}) -> dict:  # noqa: B006  the cache of the process
    """A JSON configuration of the driver, read again when the file has changed."""
    at = os.stat(path).st_mtime_ns
    if _held.get(path, (None,))[0] != at:
        with open(path, encoding="utf-8") as f:
            _held[path] = (at, json.load(f))
    return _held[path][1]
