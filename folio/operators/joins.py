"""Ordered and interval joins without nested loops over large sides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def _merged(left: DataFrame, right: DataFrame, by: list[str], at: str, values: list[str]) -> DataFrame:
    l = left.select("*", F.lit(0).alias("side__"), *(F.lit(None).cast(right.schema[v].dataType).alias(v) for v in values))
    r = right.select(*by, at, *values, F.lit(1).alias("side__"))
    return l.unionByName(r, allowMissingColumns=True)


def asof_backward(left: DataFrame, right: DataFrame, by: list[str], at: str, values: list[str], strict: bool = False) -> DataFrame:
    """left with the values of the last right row of its keys at or before (strict: before) it.

    One exchange by the keys and an ordered window; no pairs are made. At equal times of right rows the largest values win.
    A null in the chosen row stays null."""
    # at equal times right rows come first, or last if strict
    side = F.when(F.col("side__") == 1, 1 if strict else -1).otherwise(0)
    w = W.partitionBy(*by).orderBy(F.col(at), side, *values).rowsBetween(W.unboundedPreceding, 0)
    row = F.last(F.when(F.col("side__") == 1, F.struct(*values)), ignorenulls=True).over(w)
    out = _merged(left, right, by, at, values).withColumn("row__", row).where("side__ = 0")
    return out.select(*left.columns, *(F.col(f"row__.{v}").alias(v) for v in values))


def asof_forward(left: DataFrame, right: DataFrame, by: list[str], at: str, values: list[str], strict: bool = True) -> DataFrame:
    """left with the values of the first right row of its keys after (strict) or at or after it; ties: the least values."""
    side = F.when(F.col("side__") == 1, -1 if strict else 1).otherwise(0)
    w = W.partitionBy(*by).orderBy(F.col(at), side, *values).rowsBetween(0, W.unboundedFollowing)
    row = F.first(F.when(F.col("side__") == 1, F.struct(*values)), ignorenulls=True).over(w)
    out = _merged(left, right, by, at, values).withColumn("row__", row).where("side__ = 0")
    return out.select(*left.columns, *(F.col(f"row__.{v}").alias(v) for v in values))


def around(events: DataFrame, series: DataFrame, day: str, value: str, days: int = 7) -> DataFrame:
    """events with `before`, the series' last value strictly before the day but at most `days` days, and `after`, its first from
    the next day to `days` more. Each event looks up its few days by equality."""
    near = events.withColumn("k__", F.explode(F.sequence(F.lit(-days), F.lit(days + 1)))).withColumn("d__", F.date_add(F.col(day), F.col("k__")))
    found = near.where("k__ <> 0").join(series.select(F.col(day).alias("d__"), F.col(value).alias("v__")), "d__", "left").where("v__ is not null")
    ends = found.groupBy(day).agg(F.max_by("v__", F.when(F.col("k__") < 0, F.col("k__"))).alias("before"), F.min_by("v__", F.when(F.col("k__") > 0, F.col("k__"))).alias("after"))
    return events.join(ends, day, "left")


def range_counts(points: DataFrame, grid: DataFrame, keys: list[str], point_day: str, grid_day: str, days: int) -> DataFrame:
    """grid rows with n, the points of the same keys from the grid's day to `days` days on, zero included.

    Each grid row goes to its `days` days, so the join is an equality; points are counted by day first."""
    by_day = points.groupBy(*keys, F.col(point_day).alias("d__")).count()
    wide = grid.withColumn("d__", F.explode(F.sequence(F.col(grid_day), F.date_add(F.col(grid_day), days - 1))))
    return wide.join(by_day, [*keys, "d__"], "left").groupBy(*grid.columns).agg(F.coalesce(F.sum("count"), F.lit(0)).alias("n"))


def labelled_intervals(rows: DataFrame, day: Column, strata: list[tuple[str, str, str]], name: str = "stratum") -> DataFrame:
    """rows with the name of the first (name, first day, last day) that has the day; null for none. A literal, no join."""
    label = F.lit(None).cast("string")
    for s, a, b in reversed(strata):
        label = F.when(day.between(F.to_date(F.lit(a)), F.to_date(F.lit(b))), F.lit(s)).otherwise(label)
    return rows.withColumn(name, label)


def densified(rows: DataFrame, keys: list[str], day: str, value: str, step: str = "1 day") -> DataFrame:
    """A row for each key and step from the first to the last day of all, 0 where there was none."""
    ends = rows.agg(F.min(day).alias("a"), F.max(day).alias("b")).where("a is not null")
    grid = rows.select(*keys).distinct().crossJoin(F.broadcast(ends)).select(*keys, F.explode(F.expr(f"sequence(a, b, interval {step})")).alias(day))
    return grid.join(rows, [*keys, day], "left").withColumn(value, F.coalesce(value, F.lit(0)))


def outer_first(first: DataFrame, second: DataFrame, key: str, value: str, names: tuple[str, str]) -> DataFrame:
    """Full outer join: the first's value, else the second's, and which of them it is."""
    a, b = first.select(key, F.col(value).alias("a__")), second.select(key, F.col(value).alias("b__"))
    return a.join(b, key, "full_outer").select(key, F.coalesce("a__", "b__").alias(value), F.when(F.col("a__").isNotNull(), names[0]).when(F.col("b__").isNotNull(), names[1]).alias("origin"))


def aligned(series: dict[str, DataFrame], key: str, value: str) -> DataFrame:
    """All series side by side on the union of their keys: one exchange, whatever their number."""
    stacked = None
    for name, s in series.items():
        part = s.select(key, F.lit(name).alias("s__"), F.col(value).cast("double").alias("v__"))
        stacked = part if stacked is None else stacked.union(part)
    return stacked.groupBy(key).agg(*(F.max(F.when(F.col("s__") == n, F.col("v__"))).alias(n) for n in series))


def replications(rows: DataFrame, key: str, outlet: str, day: str, id_: str, days: int = 2) -> DataFrame:
    """rows with group_first, n_copies and is_copy: of equal keys, the earliest row opens a group; rows of other outlets within
    `days` days join it; what is left opens the next. Greedy and in order.

    One exchange by key, sorted by day and id; a task holds the rows of a key's last `days` days that a group may still
    take, not the key. Null keys stay alone."""
    import numpy as np
    import pyarrow as pa

    kind = rows.schema[id_].dataType.simpleString()
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    narrow = rows.where(F.col(key).isNotNull()).select(F.col(key).alias("k"), F.unix_date(F.col(day).cast("date")).alias("d"), F.col(id_).alias("i"), F.col(outlet).alias("o"))
    ordered = narrow.repartition(n, "k").sortWithinPartitions("k", "d", "i", "o")

    def run(batches):
        at, groups, type_ = None, [], None  # open groups of a key: [day, outlet, first id, ids]; the latest group is the last
        for batch in batches:
            out: list[tuple] = []

            def close(gs):
                for _, _, first, ids in gs:
                    out.append((first, first, len(ids), False))  # noqa: B023
                    out.extend((i, first, len(ids), True) for i in ids)  # noqa: B023

            for k, d, i, o in zip(*(batch.column(c).to_pylist() for c in "kdio"), strict=True):
                if k != at:
                    close(groups)
                    at, groups = k, []
                old = [g for g in groups if d - g[0] > days]
                if old:
                    close(old)
                    groups = [g for g in groups if d - g[0] <= days]
                for g in groups:
                    if o != g[1]:  # also where one of them is null
                        g[3].append(i)
                        break
                else:
                    groups.append([d, o, i, []])
            type_ = batch.schema.field("i").type
            yield _marks(out, type_)
        out = []
        for _, _, first, ids in groups:
            out.append((first, first, len(ids), False))
            out += [(i, first, len(ids), True) for i in ids]
        if out:
            yield _marks(out, type_)

    def _marks(out, type_):
        columns = list(zip(*out, strict=True)) if out else [(), (), (), ()]
        arrays = [pa.array(columns[0], type_), pa.array(columns[1], type_), pa.array(np.array(columns[2], np.int64)), pa.array(columns[3], pa.bool_())]
        return pa.RecordBatch.from_arrays(arrays, names=["i__", "group_first", "n_copies", "is_copy"])

    marks = ordered.mapInArrow(run, f"i__ {kind}, group_first {kind}, n_copies long, is_copy boolean")
    return rows.join(marks, F.col(id_) == F.col("i__"), "left").drop("i__")
