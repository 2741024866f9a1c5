"""Index series from scored items: replicas collapsed, levels by period with day-clustered errors, weights and effects.

Items: item_id, day (date), outlet, kind, wire (cluster of replicas), d1 (1 to 5 or null), no_signal (boolean).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def rescaled(score: Column) -> Column:
    return (score - 1) / F.lit(4.0)


def in_periods(items: DataFrame, back: int = 1, unit: str = "MONTH") -> DataFrame:
    """items in each period whose window of `back` periods, ending with it, has their day; none after the last with items.

    An item goes to `back` rows: a fan-out that keeps windows a plain grouping."""
    step = {"MONTH": 1, "QUARTER": 3}[unit]
    own = items.withColumn("own", F.trunc("day", unit))
    if back == 1:
        return own.withColumnRenamed("own", "period")
    last = own.agg(F.max("own").alias("last"))
    wide = own.withColumn("period", F.explode(F.expr(f"transform(sequence(0, {back - 1}), k -> add_months(own, k * {step}))")))
    return wide.crossJoin(F.broadcast(last)).where("period <= last").drop("last")  # one row


def collapsed(items: DataFrame, *also: str) -> DataFrame:
    """One row for each period, wire cluster and kind: mean score, earliest day, of the items with a score."""
    keep = [F.avg(c).alias(c) for c in also]
    return items.where("d1 is not null").groupBy("period", "wire", "kind").agg(F.avg(rescaled(F.col("d1"))).alias("c"), F.min("day").alias("day"), *keep)


def with_day_error(rows: DataFrame, keys: list[str], value: str = "c") -> DataFrame:
    """Per key: mean, median, n, days, iid error, and error over day means (null for one day)."""
    days = rows.groupBy(*keys, "day").agg(F.avg(value).alias("m")).groupBy(*keys).agg((F.stddev_samp("m") / F.sqrt(F.count("*"))).alias("se_day"), F.count("*").alias("n_days"))
    level = rows.groupBy(*keys).agg(F.avg(value).alias("level"), F.median(value).alias("level_median"), F.count("*").alias("n_items"), (F.stddev_samp(value) / F.sqrt(F.count("*"))).alias("se_iid"))
    return level.join(days, keys)


def periodic_index(items: DataFrame, back: int = 1, unit: str = "MONTH") -> DataFrame:
    """The index by period with its errors, the share without signal, and totals before replicas are collapsed.

    Items without a score and with no_signal count in share_no_signal and n_total, never in the mean. Periods
    without any scored item don't appear."""
    wide = in_periods(items, back, unit)
    signal = wide.groupBy("period").agg(F.avg(F.col("no_signal").cast("int")).alias("share_no_signal"), F.count("*").alias("n_total"))
    out = with_day_error(collapsed(wide), ["period"]).join(signal, "period")
    return out.withColumn("level_clipped", F.least(F.greatest("level", F.lit(0.0)), F.lit(1.0)))


def levels_without(items: DataFrame, back: int = 1, unit: str = "MONTH") -> DataFrame:
    """(left_out, period, level, n_items) of periodic_index over the items of all outlets but one, for each outlet in turn.

    Items are grouped by replicas and outlet once: a series is the sum over all replicas' means, less what an outlet's own
    items change in it. Items of a null outlet are in every series. Rows are of outlets and periods."""
    outlets = items.where("outlet is not null").select(F.col("outlet").alias("left_out")).distinct()
    keys, w = ["period", "wire", "kind"], W.partitionBy("period", "wire", "kind")
    own = in_periods(items, back, unit).where("d1 is not null").groupBy(*keys, "outlet").agg(F.sum(rescaled(F.col("d1"))).alias("s"), F.count("*").alias("m"))
    own = own.withColumns({"ts": F.sum("s").over(w), "tm": F.sum("m").over(w), "parts": F.count("*").over(w)})
    mean = F.col("ts") / F.col("tm")
    whole = own.groupBy("period").agg(F.sum(mean / F.col("parts")).alias("c"), F.sum(1 / F.col("parts")).alias("k"))
    left = F.coalesce(F.try_divide(F.col("ts") - F.col("s"), F.col("tm") - F.col("m")), F.lit(0.0))
    gone = own.groupBy("period", F.col("outlet").alias("left_out")).agg(F.sum(mean - left).alias("less_c"), F.count_if(F.col("tm") == F.col("m")).alias("less_k"))
    out = whole.withColumn("k", F.round("k").cast("long")).crossJoin(outlets).join(gone, ["period", "left_out"], "left").na.fill(0, ["less_c", "less_k"])
    if back > 1:  # no series goes on after its own last period with items
        top = items.groupBy("outlet").agg(F.max(F.trunc("day", unit)).alias("last")).select(F.struct("last", "outlet").alias("t"))
        first = top.agg(F.max("t").alias("t1"))
        second = top.crossJoin(F.broadcast(first)).where("not (t.outlet <=> t1.outlet)").agg(F.max("t.last").alias("l2"))
        out = out.crossJoin(F.broadcast(first)).crossJoin(F.broadcast(second))
        out = out.where("period <= if(left_out <=> t1.outlet, l2, t1.last)")
    n = F.col("k") - F.col("less_k")
    return out.where(n > 0).select("left_out", "period", ((F.col("c") - F.col("less_c")) / n).alias("level"), n.alias("n_items"))


def kind_effects(cells: list[tuple], tol: float = 1e-10, most: int = 200) -> dict:
    """Effects of kinds from (period, kind, n, sum) cells: alternating projections on period and kind, weighted mean zero."""
    periods, kinds = (sorted({c[i] for c in cells}) for i in (0, 1))
    p = np.array([periods.index(c[0]) for c in cells])
    k = np.array([kinds.index(c[1]) for c in cells])
    n, s = (np.array([float(c[i]) for c in cells]) for i in (2, 3))
    gamma = np.zeros(len(kinds))
    for _ in range(most):
        alpha = np.bincount(p, s - n * gamma[k]) / np.bincount(p, n)
        new = np.bincount(k, s - n * alpha[p]) / np.bincount(k, n)
        new -= np.average(new, weights=np.bincount(k, n))
        moved, gamma = np.abs(new - gamma).max(), new
        if moved < tol:
            break
    return dict(zip(kinds, gamma.tolist(), strict=True))


def adjusted_index(spark: SparkSession, items: DataFrame, back: int = 1) -> DataFrame:
    """periodic_index of scores less the effect of their kind. The driver solves on one cell for each period and kind."""
    rows = collapsed(in_periods(items, back))
    cells = [tuple(r) for r in rows.groupBy("period", "kind").agg(F.count("*"), F.sum("c")).collect()]
    effects = spark.createDataFrame(list(kind_effects(cells).items()) if cells else [], "kind string, gamma double")
    return with_day_error(rows.join(F.broadcast(effects), "kind").withColumn("c", F.col("c") - F.col("gamma")), ["period"])


def dual_index(items: DataFrame, variant: str = "variant", first: str = "vmax", second: str = "vmin") -> DataFrame:
    """The index of two variants of the scores side by side, and their difference."""
    one = lambda v: periodic_index(items.where(F.col(variant) == v)).select("period", F.col("level").alias(f"level_{v}"), F.col("n_items").alias(f"n_{v}"))
    return one(first).join(one(second), "period", "full_outer").withColumn("delta", F.col(f"level_{first}") - F.col(f"level_{second}"))


def daily_with_trailing(items: DataFrame, days: int = 30) -> DataFrame:
    """Each day from the first to the last: mean, n, and the pooled mean of the `days` days that end with it.

    Days without items have n 0 and a null mean."""
    rows = collapsed(items.withColumn("period", F.trunc("day", "MONTH")))
    by_day = rows.groupBy("day").agg(F.sum("c").alias("s"), F.count("*").alias("n"))
    ends = by_day.agg(F.min("day").alias("a"), F.max("day").alias("b")).where("a is not null")
    calendar = ends.select(F.explode(F.sequence("a", "b")).alias("day"))
    # One row a day: the ordered window over all days stays small for any number of items.
    w = W.orderBy(F.unix_date("day")).rangeBetween(-(days - 1), 0)
    dense = calendar.join(by_day, "day", "left").na.fill(0, ["s", "n"])
    pooled = dense.withColumns({"ts": F.sum("s").over(w), "tn": F.sum("n").over(w)})
    return pooled.select("day", F.try_divide("s", "n").alias("level"), "n", F.try_divide("ts", "tn").alias("trailing"))


def hajek(rows: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    """Weighted mean by key with the linearised error over days: sqrt(g / (g - 1) * sum of squared day sums).

    Rows are summed by day once; a day's sum of w * (y - mean) / total needs no more than its sums of w and w * y."""
    w, y = F.col(weight), F.col(value)
    days = rows.where(y.isNotNull()).groupBy(*keys, "day").agg(F.sum(w).alias("w"), F.sum(w * y).alias("wy"), F.count("*").alias("m"))
    total = days.groupBy(*keys).agg((F.sum("wy") / F.sum("w")).alias("mean"), F.sum("w").alias("total"), F.sum("m").alias("n"), F.count("*").cast("double").alias("g"), F.collect_list(F.struct("w", "wy")).alias("days"))
    square = F.aggregate("days", F.lit(0.0), lambda s, d: s + F.pow((d["wy"] - F.col("mean") * d["w"]) / F.col("total"), F.lit(2)))
    return total.select(*keys, "mean", F.sqrt(F.try_divide(F.col("g"), F.col("g") - 1) * square).alias("se"), "total", "n")


def dimension_levels(items: DataFrame, dims: list[str], weight: str, period: Column) -> DataFrame:
    """Weighted level and attention (share with a score) of each dimension and period."""
    stacked = items.select(period.alias("period"), "day", weight, F.explode(F.create_map(*(x for d in dims for x in (F.lit(d), F.col(d).cast("double"))))).alias("dim", "score"))
    stacked = stacked.withColumns({"level": rescaled(F.col("score")), "seen": F.col("score").isNotNull().cast("double")})
    keys = ["period", "dim"]
    level = hajek(stacked, keys, "level", weight).select(*keys, "mean", "se", F.col("n").alias("n_signal"))
    seen = hajek(stacked, keys, "seen", weight).select(*keys, F.col("mean").alias("attention"), F.col("se").alias("attention_se"), F.col("total").alias("n_weighted"), "n")
    return seen.join(level, keys, "left")


def audit_weights(items: DataFrame, decision: str = "decision") -> DataFrame:
    """items with weight: of audited ones the number of discarded and audited over that of audited; else 1."""
    n = items.agg(F.count_if(F.col(decision).isin("discarded", "audited")).alias("d"), F.count_if(F.col(decision) == "audited").alias("a"))
    return items.crossJoin(F.broadcast(n)).withColumn("weight", F.when(F.col(decision) == "audited", F.col("d") / F.col("a")).otherwise(1.0)).drop("d", "a")


def routed(items: DataFrame, score: str, threshold: float, key: str, audit: float = 0.10) -> DataFrame:
    """items with decision: sent at or above the threshold; below, audited by a salted hash of the key, else discarded."""
    from ..functions.ids import salted_fraction

    return items.withColumn("decision", F.when(F.col(score) >= threshold, "sent").when(salted_fraction(F.col(key), "audit") < audit, "audited").otherwise("discarded"))


def funnel(items: DataFrame) -> DataFrame:
    """Counts by decision, found signal and the estimate of signal that was discarded, in one pass. Items: decision, d1."""
    sent, audited, discarded = (F.col("decision") == x for x in ("sent", "audited", "discarded"))
    found = F.col("d1").isNotNull()
    out = items.agg(
        F.count("*").alias("n"), F.count_if(sent).alias("n_sent"), F.count_if(audited).alias("n_audited"), F.count_if(discarded).alias("n_discarded"),
        F.count_if(sent & found).alias("sent_signal"), F.count_if(audited & found).alias("audited_signal"),
    )
    rate = F.try_divide(F.col("audited_signal"), F.col("n_audited"))
    return out.withColumns({"share_sent": F.try_divide("n_sent", "n"), "lost_signal": rate * F.col("n_discarded")}).withColumn("share_lost", F.try_divide(F.col("lost_signal"), F.col("lost_signal") + F.col("sent_signal") + F.col("audited_signal")))


def production_counts(items: DataFrame, held_out: str, answered: Column, threshold: float) -> DataFrame:
    """The counts of a production run in one pass, with the signal that the filter is estimated to have lost.

    items: decision (labelled, sent, audited, discarded), d1 (null without signal), whether held out, whether an answer came."""
    held, has = F.col(held_out), F.coalesce(answered, F.lit(False))
    of = lambda *kinds: ~held & F.col("decision").isin(*kinds)
    api, signal = of("labelled") | (of("sent", "audited") & has), F.col("d1").isNotNull()
    out = items.agg(
        F.count("*").alias("corpus"), F.count_if(held).alias("held_out"), F.count_if(~held).alias("production"), F.count_if(of("labelled")).alias("labelled"), F.count_if(of("sent")).alias("sent"),
        F.count_if(of("discarded", "audited")).alias("below"), F.count_if(of("audited")).alias("audited"), F.count_if(of("discarded")).alias("not_sent"), F.count_if(api & ~signal).alias("without_signal"),
        F.count_if(api & signal).alias("with_signal"), F.count_if(of("sent", "audited") & ~has).alias("missing"), F.avg(F.when(api & of("audited"), signal.cast("int"))).alias("audit_rate"),
    )
    lost = F.when(F.col("not_sent") == 0, 0.0).otherwise(F.col("audit_rate") * F.col("not_sent"))
    out = out.withColumns({"share_not_sent": F.try_divide("not_sent", "production"), "lost_signal": lost})
    return out.withColumns({"share_lost": F.try_divide("lost_signal", F.col("lost_signal") + F.col("with_signal")), "threshold": F.lit(float(threshold))})


def funnel_by_month(items: DataFrame, audited_weight: float = 10.0) -> DataFrame:
    """By month: counts by decision, the simple mean of scores, and the mean weighted against the audit's share."""
    w = F.when(F.col("decision") == "audited", F.lit(audited_weight)).otherwise(1.0)
    c = rescaled(F.col("d1"))
    counts = [F.count_if(F.col("decision") == x).alias(f"n_{x}") for x in ("sent", "audited", "discarded")]
    scored = F.col("decision") != "discarded"
    return items.groupBy(F.trunc("day", "MONTH").alias("period")).agg(*counts, F.avg(F.when(scored, c)).alias("simple"), F.try_divide(F.sum(F.when(scored, w * c)), F.sum(F.when(scored & c.isNotNull(), w))).alias("weighted"))
