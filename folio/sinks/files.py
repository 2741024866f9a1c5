"""Writers: appended lines by outlet and writer, ledgers, consolidated tables, series, results, reports. Paths are in a shared store."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def append_lines(rows: DataFrame, path: str, by: list[str] = ()) -> None:
    """JSON lines, appended under a folder for each outlet and writer: writers never share a file, and a failed job leaves none."""
    rows.write.mode("append").partitionBy(*by).json(path)


def append_ledger(lines: DataFrame, path: str) -> None:
    """Finished units or gaps with the time at which they were written. One file a job: a ledger's lines are few."""
    lines.withColumn("at", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")).coalesce(1).write.mode("append").json(path)


def consolidated(rows: DataFrame, path: str, slug: str, order: list[str], text: dict[str, str]) -> DataFrame:
    """Writes <path>/csv (header, UTF-8 with a mark of its encoding as the first column's name begins) and <path>/jsonl with an export id
    and the columns that a model reads (name -> column); returns the rows with their id."""
    from ..operators.corpus import with_export_id

    out = with_export_id(rows, F.col(slug), order, "id")
    first = out.columns[0]
    out.withColumnRenamed(first, "\ufeff" + first).write.mode("overwrite").option("header", True).option("escape", '"').csv(f"{path}/csv")
    out.select("id", *(F.col(c).alias(n) for n, c in text.items())).write.mode("overwrite").option("ignoreNullFields", False).json(f"{path}/jsonl")
    return out


def corpus_parquet(rows: DataFrame, path: str, year: str) -> None:
    """The corpus by year of a day, so that readers of some years skip the others."""
    rows.withColumn("year", F.year(year)).write.mode("overwrite").option("compression", "zstd").partitionBy("year").parquet(path)


def series_csv(rows: DataFrame, path: str, order: list[str]) -> None:
    """A series (rows of periods) in order, in one file; for what grows with periods, not with items."""
    rows.orderBy(*order).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def _put(df: DataFrame, path: str, content: str) -> None:
    spark = df.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(bytearray(content, "utf-8"))
    finally:
        out.close()


def result_document(row: DataFrame, path: str) -> dict:
    """One row of results as a JSON document."""
    found = row.limit(2).collect()
    if len(found) != 1:
        raise ValueError("a result document is one row")
    doc = found[0].asDict(recursive=True)
    _put(row, path, json.dumps(doc, ensure_ascii=False, indent=1, default=str))
    return doc


def markdown(rows: DataFrame, most: int = 1000, digits: int = 4) -> str:
    """A table of results, of at most `most` rows, in Markdown; more is an error, as a report isn't an export."""
    found = rows.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"a report's table has {most} rows at most")
    show = lambda v: "" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v).replace("|", "\\|")
    lines = [rows.columns, ["---"] * len(rows.columns), *([show(v) for v in r] for r in found)]
    return "\n".join("| " + " | ".join(x) + " |" for x in lines)


def report(sections: dict[str, DataFrame], path: str) -> str:
    """Writes a Markdown document of titled tables; returns it."""
    text = "\n\n".join(f"## {title}\n\n{markdown(rows)}" for title, rows in sections.items()) + "\n"
    _put(next(iter(sections.values())), path, text)
    return text
