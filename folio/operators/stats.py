"""Agreement, correlation, tests and regressions: sums in one pass over the data, distributions on the driver's few numbers."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .ranks import running_total


def correlations(rows: DataFrame, x: str, y: str, keys: list[str] = ()) -> DataFrame:
    """r, its t, n, slope and intercept of y on x, by key; null without spread."""
    ok = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    out = ok.groupBy(*keys).agg(F.count("*").alias("n"), F.corr(x, y).alias("r"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))
    r = F.nanvl("r", F.lit(None))
    return out.withColumns({"r": r}).withColumn("t", F.try_divide(F.col("r") * F.sqrt(F.col("n") - 2), F.sqrt(1 - F.col("r") * F.col("r"))))


def spearman(rows: DataFrame, x: str, y: str) -> DataFrame:
    """Rank correlation, ties sharing their mean rank. Values are counted first; ranks are running counts over distinct values, summed
    within ranges of them."""
    both = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(x, y).count()

    def ranks(c: str) -> DataFrame:
        by = running_total(both.groupBy(c).agg(F.sum("count").alias("m")), [c], "m", "upto")
        return by.select(c, (F.col("upto") - (F.col("m") - 1) / 2.0).alias(f"rank_{c}"))

    r = both.join(ranks(x), x).join(ranks(y), y)
    n, a, b = F.col("count"), F.col(f"rank_{x}"), F.col(f"rank_{y}")
    s = r.agg(F.sum(n).alias("n"), F.sum(n * a).alias("sa"), F.sum(n * b).alias("sb"), F.sum(n * a * b).alias("sab"), F.sum(n * a * a).alias("saa"), F.sum(n * b * b).alias("sbb"))
    return s.select("n", ((F.col("sab") - F.col("sa") * F.col("sb") / F.col("n")) / F.sqrt((F.col("saa") - F.col("sa") * F.col("sa") / F.col("n")) * (F.col("sbb") - F.col("sb") * F.col("sb") / F.col("n")))).alias("rho"))


def quadratic_kappa(rows: DataFrame, a: str, b: str) -> DataFrame:
    """n, raw agreement, quadratically weighted kappa; null if both raters use one category only."""
    ok = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    s = ok.agg(F.count("*").alias("n"), F.avg((x == y).cast("int")).alias("agreement"), F.avg((x - y) * (x - y)).alias("seen"), (F.var_pop(x) + F.var_pop(y) + F.pow(F.avg(x) - F.avg(y), 2)).alias("chance"))
    return s.select("n", "agreement", (1 - F.try_divide("seen", "chance")).alias("kappa"))


def paired_and_welch(rows: DataFrame, unit: str, arm: str, value: str, arms: tuple[str, str]) -> DataFrame:
    """Paired t of the second arm less the first over units that have both, and Welch's t over all values.

    Equal non-zero differences give an infinite paired t; equal zero ones 0."""
    means = rows.groupBy(unit).agg(*(F.avg(F.when(F.col(arm) == x, F.col(value))).alias(f"m{i}") for i, x in enumerate(arms))).where("m0 is not null and m1 is not null")
    d = means.select((F.col("m1") - F.col("m0")).alias("d")).agg(F.count("*").alias("n_pairs"), F.avg("d").alias("mean"), F.stddev_samp("d").alias("sd"))
    paired = F.when(F.col("sd") > 0, F.col("mean") / (F.col("sd") / F.sqrt("n_pairs"))).when(F.col("n_pairs") < 2, None).when(F.col("mean") == 0, 0.0).otherwise(F.signum("mean") * F.lit(float("inf")))
    part = lambda i, f: f(F.when(F.col(arm) == arms[i], F.col(value)))
    w = rows.agg(*(part(i, f).alias(f"{n}{i}") for i in (0, 1) for n, f in (("n", F.count), ("a", F.avg), ("v", F.var_samp))))
    q0, q1 = F.col("v0") / F.col("n0"), F.col("v1") / F.col("n1")
    welch = w.select(F.try_divide(F.col("a1") - F.col("a0"), F.sqrt(q0 + q1)).alias("t_welch"), F.try_divide(F.pow(q0 + q1, 2), q0 * q0 / (F.col("n0") - 1) + q1 * q1 / (F.col("n1") - 1)).alias("df_welch"))
    return d.select("n_pairs", F.col("mean").alias("mean_difference"), paired.alias("t_paired")).crossJoin(welch)


def with_p_values(result: DataFrame, t: str, df: str) -> DataFrame:
    """A result of few rows with the two-sided Student p-value of t."""
    from ..functions.numeric import student_tail

    @F.pandas_udf("double")
    def p(ts: pd.Series, ds: pd.Series) -> pd.Series:
        return pd.Series([student_tail(x, d) if x == x and d == d else None for x, d in zip(ts, ds, strict=True)], dtype="float64")

    return result.withColumn(f"p_{t}", p(F.col(t).cast("double"), F.col(df).cast("double")))


def hc1(rows: DataFrame, x: str, y: str) -> DataFrame:
    """OLS of y on x with an HC1 error of the slope, from sums in two passes."""
    ok = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).alias("x"), F.col(y).alias("y"))
    fit = ok.agg(F.count("*").alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"), F.regr_slope("y", "x").alias("slope"), F.regr_sxx("y", "x").alias("sxx"))
    dx = F.col("x") - F.col("mx")
    e = F.col("y") - F.col("my") - F.col("slope") * dx
    sums = ok.crossJoin(F.broadcast(fit)).groupBy("n", "mx", "my", "slope", "sxx").agg(F.sum(dx * dx * e * e).alias("q"))
    return sums.select("n", "slope", (F.col("my") - F.col("slope") * F.col("mx")).alias("intercept"), (F.sqrt(F.col("q") * F.col("n") / (F.col("n") - 2)) / F.col("sxx")).alias("se"))


def hac_ols(rows: DataFrame, order: str, y: str, xs: list[str], lags: int | None = None) -> DataFrame:
    """(term, coef, se, z, p, n, r2, lags) of a time series regression with Newey-West errors.

    A series of aggregates by period (hundreds of rows) is solved in one place."""
    names = ["const", *xs]

    def solve(pdf):
        import pandas as pd

        from ..functions.numeric import ols

        pdf = pdf.sort_values(order)
        r = ols(pdf[y].to_numpy(float), pdf[xs].to_numpy(float), lags)
        return pd.DataFrame({"term": names, "coef": r["coef"], "se": r["se"], "z": r["z"], "p": r["p"], "n": r["n"], "r2": r["r2"], "lags": r["lags"]})

    return rows.select(order, y, *xs).groupBy(F.lit(1).alias("all")).applyInPandas(solve, "term string, coef double, se double, z double, p double, n long, r2 double, lags int")


def holm(rows: DataFrame, p: str, family: list[str] = ()) -> DataFrame:
    """rows with p_holm, the step-down corrected p-value within each family."""
    w = W.partitionBy(*family)
    step = (F.count("*").over(w) - F.row_number().over(w.orderBy(p)) + 1) * F.col(p)
    return rows.withColumn("step__", step).withColumn("p_holm", F.least(F.lit(1.0), F.max("step__").over(w.orderBy(p).rowsBetween(W.unboundedPreceding, 0)))).drop("step__")


def auc(rows: DataFrame, score: str, label: str) -> DataFrame:
    """Area under the curve from counts by distinct score, summed within ranges of it; ties count half."""
    by = rows.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(score).agg(F.sum(label).alias("pos"), (F.count("*") - F.sum(label)).alias("neg"))
    upto = running_total(by, [score], "neg", "upto")
    s = upto.withColumn("wins", F.col("pos") * (F.col("upto") - F.col("neg") / 2.0)).agg(F.sum("wins").alias("w"), F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    return s.select("n_pos", "n_neg", F.try_divide("w", F.col("n_pos") * F.col("n_neg").cast("double")).alias("auc"))


def threshold(rows: DataFrame, score: str, label: str, sensitivity: float = 0.95) -> DataFrame:
    """The largest threshold that keeps the share of positives at or above it, and what it discards. The k-th least score of the
    positives is found by running counts over distinct scores."""
    by = rows.where((F.col(label) == 1) & F.col(score).isNotNull()).groupBy(score).agg(F.count("*").alias("m"))
    k = by.agg((F.floor(F.sum("m") * F.lit(1 - sensitivity) + F.lit(1e-9)) + 1).alias("k"))
    cut = running_total(by, [score], "m", "upto").crossJoin(F.broadcast(k)).where("upto >= k").agg(F.min(score).alias("threshold"))
    keep = F.col(score) >= F.col("threshold")
    return rows.crossJoin(F.broadcast(cut)).groupBy("threshold").agg(F.try_divide(F.count_if(keep & (F.col(label) == 1)), F.count_if(F.col(label) == 1)).alias("sensitivity"), F.avg((~keep).cast("int")).alias("discarded"))


def alpha(rows: DataFrame, unit: str, rating: str, k: int = 5) -> DataFrame:
    """Krippendorff's alpha (one row: alpha) for ratings 1 to k with the ordinal metric; units with one rating don't count, and without
    two ratings anywhere or without any spread it is null.

    Units are counted by category, and their coincidences summed by the tasks: k * k numbers are left."""
    c = [F.col(f"c{i}") for i in range(1, k + 1)]
    units = rows.groupBy(unit).agg(*(F.count_if(F.col(rating) == i).cast("double").alias(f"c{i}") for i in range(1, k + 1)))
    m = sum(c[1:], c[0])
    pairs = [(F.sum((c[i] * c[j] - (c[i] if i == j else 0)) / (m - 1))).alias(f"o{i}_{j}") for i in range(k) for j in range(k)]
    one = units.where(m >= 2).agg(*pairs)
    o = [[F.coalesce(F.col(f"o{i}_{j}"), F.lit(0.0)) for j in range(k)] for i in range(k)]
    one = one.select(*(x.alias(f"o{i}_{j}") for i, row in enumerate(o) for j, x in enumerate(row)))
    one = one.withColumns({f"t{i}": sum((F.col(f"o{i}_{j}") for j in range(k)), F.lit(0.0)) for i in range(k)})
    one = one.withColumns({f"mid{i}": sum((F.col(f"t{j}") for j in range(i + 1)), F.lit(0.0)) - F.col(f"t{i}") / 2 for i in range(k)})
    n = sum((F.col(f"t{i}") for i in range(k)), F.lit(0.0))
    far = lambda i, j: F.pow(F.col(f"mid{i}") - F.col(f"mid{j}"), 2)
    seen = sum((F.col(f"o{i}_{j}") * far(i, j) for i in range(k) for j in range(k)), F.lit(0.0)) / n
    chance = sum((F.col(f"t{i}") * F.col(f"t{j}") * far(i, j) for i in range(k) for j in range(k)), F.lit(0.0)) / (n * (n - 1))
    return one.withColumns({"n__": n}).select(F.when(F.col("n__") > 1, 1 - F.try_divide(seen, F.when(chance > 0, chance))).alias("alpha"))


def series_agreement(one: DataFrame, other: DataFrame, key: str, value: str, series: list[str] = (), size: str | None = None) -> DataFrame:
    """n, correlation, mean and mean absolute difference of two series on common keys; of each of several series against
    the other, and with the median of a size of theirs."""
    also = [F.col(size).alias("size__")] if size else []
    j = one.select(*series, key, F.col(value).alias("a"), *also).join(other.select(key, F.col(value).alias("b")), key)
    return j.groupBy(*series).agg(*([F.median("size__").alias("median_n")] if size else []), F.count("*").alias("n"), F.corr("a", "b").alias("r"), F.avg(F.col("a") - F.col("b")).alias("mean_diff"), F.avg(F.abs(F.col("a") - F.col("b"))).alias("mean_abs_diff"))


def window_change(events: DataFrame, daily: DataFrame, day: str, value: str, days: int, least: int = 3) -> DataFrame:
    """events with the mean of the `days` days after less that before, the day itself left out; null below `least` items a side.

    daily: (day, sum, n). Each event looks up its days by equality."""
    wide = events.withColumn("k__", F.explode(F.sequence(F.lit(-days), F.lit(days)))).where("k__ <> 0").withColumn("d__", F.date_add(F.col(day), F.col("k__")))
    j = wide.join(daily.select(F.col("day").alias("d__"), F.col(value).alias("s__"), "n"), "d__", "left")
    side = lambda c, s: F.sum(F.when(F.col("k__") * s > 0, F.col(c)))
    out = j.groupBy(*events.columns).agg(side("s__", -1).alias("sb"), F.coalesce(side("n", -1), F.lit(0)).alias("n_before"), side("s__", 1).alias("sa"), F.coalesce(side("n", 1), F.lit(0)).alias("n_after"))
    enough = (F.col("n_before") >= least) & (F.col("n_after") >= least)
    return out.withColumn("delta", F.when(enough, F.try_divide("sa", "n_after") - F.try_divide("sb", "n_before"))).drop("sa", "sb")


def placebo_share(effects: DataFrame, placebos: DataFrame, delta: str = "delta") -> DataFrame:
    """effects with the share of placebo effects that are at least as large in size. Both: a row for each event or grid day."""
    p = placebos.where(F.col(delta).isNotNull()).select(F.abs(delta).alias("p__"))
    few = p.agg(F.array_sort(F.collect_list("p__")).alias("ps"))
    return effects.crossJoin(F.broadcast(few)).withColumn("placebo_share", F.when(F.col(delta).isNotNull(), F.size(F.filter("ps", lambda x: x >= F.abs(delta))) / F.size("ps"))).drop("ps")


def latent_weight(panel: DataFrame, order: str, y: str, d: str, link: str = "logistic") -> DataFrame:
    """The latent weight of the state-space model by period; one series of periods is estimated in one place."""

    def solve(pdf):
        import pandas as pd

        from ..functions import numeric

        pdf = pdf.sort_values(order)
        e = numeric.latent_weight(pdf[y].to_numpy(float), pdf[d].to_numpy(float), link == "logistic")
        return pd.DataFrame({order: pdf[order].to_numpy(), **{k: e[k] for k in ("filtered", "smoothed", "filtered_se", "smoothed_se", "gain", "innovation", "noise", "drift", "loglik")}})

    kind = panel.schema[order].dataType.simpleString()
    return panel.select(order, y, d).groupBy(F.lit(1).alias("all")).applyInPandas(solve, f"{order} {kind}, filtered double, smoothed double, filtered_se double, smoothed_se double, gain double, innovation double, noise double, drift double, loglik double")


def identification(states: DataFrame, weight: str, least: float = 1.0) -> DataFrame:
    """How far the latent weight is identified: share of periods with a small regressor, mean gain and error in and out of them."""
    weak = F.abs(weight) < least
    return states.agg(F.avg(weak.cast("int")).alias("share_weak"), *(F.avg(F.when(c, v)).alias(f"{n}_{z}") for z, c in (("weak", weak), ("strong", ~weak)) for n, v in (("gain", F.abs("gain")), ("se", F.col("smoothed_se")))))
