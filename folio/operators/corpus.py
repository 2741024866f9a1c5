"""Corpus building: validation, deduplication by explicit order, clusters of replicated stories, latest valid scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .ranks import with_row_number


def one_of_each(rows: DataFrame, keys: list[str | Column], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    return rows.withColumn("rn__", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("rn__ = 1").drop("rn__")


def latest_valid(log: DataFrame, key: str, at: str, valid: Column) -> DataFrame:
    """The last valid record of each key; failed attempts don't hide earlier successes."""
    return one_of_each(log.where(valid), [key], [F.col(at).desc()])


def preferred_first(rows: DataFrame, known: DataFrame, id_: str, keys: list[str | Column], order: list[Column]) -> DataFrame:
    """One row for each key, ids that are already known before others: late arrivals don't displace them."""
    marked = rows.join(known.select(id_).distinct().withColumn("known__", F.lit(True)), id_, "left")
    return one_of_each(marked, keys, [F.coalesce("known__", F.lit(False)).desc(), *order]).drop("known__")


def wire_clusters(rows: DataFrame, *texts: str, name: str = "wire") -> DataFrame:
    from ..functions.text import text_hash

    return rows.withColumn(name, text_hash(*(F.col(t) for t in texts)))


def violations(rows: DataFrame, id_: str, required: list[str], kinds: dict[str, list[str]]) -> DataFrame:
    """(rule, n) of broken rules: missing or blank required values, unknown kinds, repeated ids. One pass, then one by id."""
    checks = [F.count_if(F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")).alias(f"missing {c}") for c in required]
    checks += [F.count_if(~F.coalesce(F.col(c).isin(v), F.lit(False))).alias(f"unknown {c}") for c, v in kinds.items()]
    names = [f"missing {c}" for c in required] + [f"unknown {c}" for c in kinds]
    one = rows.agg(*checks)
    stacked = one.select(F.explode(F.create_map(*(x for n in names for x in (F.lit(n), F.col(f"`{n}`"))))).alias("rule", "n"))
    repeated = rows.groupBy(id_).count().where("count > 1").agg(F.count("*").alias("n")).select(F.lit(f"repeated {id_}").alias("rule"), "n")
    return stacked.union(repeated).where("n > 0")


def validated(rows: DataFrame, id_: str, required: list[str], kinds: dict[str, list[str]]) -> DataFrame:
    broken = violations(rows, id_, required, kinds).collect()
    if broken:
        raise ValueError("; ".join(f"{r.rule}: {r.n}" for r in broken))
    return rows


def with_missing_columns(rows: DataFrame, schema: dict[str, str]) -> DataFrame:
    """rows with the columns that they lack, as nulls of the given types."""
    return rows.withColumns({c: F.lit(None).cast(t) for c, t in schema.items() if c not in rows.columns})


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both, the new one where both have a key."""
    both = old.withColumn("age__", F.lit(1)).unionByName(new.withColumn("age__", F.lit(0)), allowMissingColumns=True)
    return one_of_each(both, keys, [F.col("age__")]).drop("age__")


def with_export_id(rows: DataFrame, slug: Column, order: list[str], name: str = "id", width: int = 6) -> DataFrame:
    """rows with the first letters of the slug and the row's number in the given order (nulls first), which tells all rows apart.

    Numbers of more than `width` digits stay whole."""
    own = with_row_number(rows, order, "row__")
    number = F.col("row__").cast("string")
    padded = F.when(F.length(number) < width, F.lpad(number, width, "0")).otherwise(number)
    return own.withColumn(name, F.concat(F.substring(slug, 1, 4), F.lit("-"), padded)).drop("row__")


def labelled_by(rows: DataFrame, decisions: DataFrame, key: str) -> DataFrame:
    """rows with their decision; those that no routing has are the ones that were labelled first."""
    from .relations import left_with_default

    return left_with_default(rows, decisions, key, "decision", "labelled")


def silver_labels(log: DataFrame, key: str, item: str, at: str, score: str) -> DataFrame:
    """Scores to learn from: the last line with a score of each cache key, then of each item."""
    once = latest_valid(log, key, at, F.col(score).isNotNull())
    return one_of_each(once, [item], [F.col(at).desc(), F.col(key)])
