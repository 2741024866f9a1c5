"""Rows dealt to tasks by ranges of an id, each task also getting the row that follows its last."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import n_tasks

#: Stands for a null id in the order: nulls come first.
NULL_ID = -(1 << 63)


def _range_of(value: Column, bounds: list[int]) -> Column:
    """How many bounds are at most value, by two scans of about the root of their number."""
    if not bounds:
        return F.lit(0)
    step = math.isqrt(len(bounds)) + 1
    groups = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    longs = lambda xs: F.array(*(F.lit(x).cast("long") for x in xs))
    heads = F.size(F.filter(longs([g[0] for g in groups]), lambda b: b <= value))
    inside = F.element_at(F.array(*(longs(g) for g in groups)), F.greatest(heads, F.lit(1)))
    return F.when(heads == 0, 0).otherwise((heads - 1) * step + F.size(F.filter(inside, lambda b: b <= value)))


def by_ranges(df: DataFrame, id_: str, then: list[str], part: str, tail: str | None = None) -> DataFrame:
    """df with the number of its range of ids in `part`, one range a task, rows sorted by id and `then` (nulls first).

    The ranges' bounds are percentiles of the ids, as many as the session has shuffle partitions; the driver holds
    these and, with `tail`, the least id of each range. One exchange. With `tail` the rows of the least id of the next
    range that has rows (after the last: of the first) follow in each task, with that column true. Rows of equal id
    are in one task, whatever their number: ids are meant to tell rows apart, and so few may share one or have none.
    """
    key = F.coalesce(F.col(id_), F.lit(NULL_ID)).cast("long")
    n = n_tasks(df.sparkSession)
    found = df.select(F.percentile_approx(key, [i / n for i in range(1, n)], max(10_000, 10 * n))).first()[0] if n > 1 else None
    bounds = sorted({int(x) for x in found or []})
    of = _range_of(key, bounds)
    if tail is None:
        out = df.withColumn(part, of)
        order = [F.col(part), key, *then]
    else:
        least = dict(df.groupBy(of.alias("p")).agg(F.min(key)).collect())
        parts = sorted(least)
        before = {p: parts[i - 1] for i, p in enumerate(parts)}
        first_id = F.element_at(F.array(*(F.lit(least.get(p)).cast("long") for p in range(len(bounds) + 1))), of + 1)
        previous = F.element_at(F.array(*(F.lit(before.get(p)).cast("int") for p in range(len(bounds) + 1))), of + 1)
        own = F.struct(of.alias("part"), F.lit(False).alias("tail"))
        both = F.when(key == first_id, F.array(own, F.struct(previous.alias("part"), F.lit(True).alias("tail")))).otherwise(F.array(own))
        out = df.withColumn("to__", F.explode(both)).withColumns({part: F.col("to__.part"), tail: F.col("to__.tail")}).drop("to__")
        order = [F.col(part), F.col(tail), key, *then]
    return out.repartitionById(len(bounds) + 1, F.col(part)).sortWithinPartitions(*order)
