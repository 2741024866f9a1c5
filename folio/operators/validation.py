"""Validation of an index: encompassing regressions, construct battery, event studies, verdicts. Series have a row for each period."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stats import holm, placebo_share, window_change

# Least observations of a regression; the share of the index's periods that a long rival covers.
LEAST_OBSERVATIONS, LONG = 36, 0.8


def _standard(x: np.ndarray) -> np.ndarray:
    return (x - x.mean(axis=0)) / x.std(axis=0)


def _regressions(panel: DataFrame, order: str, jobs: list[dict], differences: bool, standardise: bool, lags: int | None) -> DataFrame:
    """A row (job's labels, term, coef, se, p, n, r2) for each term of each job {labels, y, xs}: one task a job, of the panel's few rows."""
    from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

    spark = panel.sparkSession
    labels = list(jobs[0]["labels"]) if jobs else []
    columns = sorted({c for j in jobs for c in (j["y"], *j["xs"])})
    schema = StructType([*(StructField(x, StringType()) for x in labels), StructField("term", StringType()), *(StructField(x, DoubleType()) for x in ("coef", "se", "p")), StructField("n", LongType()), StructField("r2", DoubleType())])
    rows = panel.select(F.col(order).alias("order__"), *(F.col(c).cast("double").alias(c) for c in columns))
    dealt = rows.crossJoin(F.broadcast(spark.createDataFrame([(i,) for i in range(len(jobs))], "job__ int")))

    def solve(key, pdf):
        import pandas as pd

        from ..functions.numeric import ols

        job = jobs[key[0]]
        data = pdf.sort_values("order__")[[job["y"], *job["xs"]]].to_numpy(float)
        if differences:
            data = np.diff(data, axis=0)
        data = data[np.isfinite(data).all(axis=1)]
        own = list(job["labels"].values())
        if len(data) < LEAST_OBSERVATIONS:
            return pd.DataFrame([[*own, job["xs"][0], None, None, None, len(data), None]], columns=schema.names)
        if standardise:
            data = _standard(data)
        r = ols(data[:, 0], data[:, 1:], job.get("lags", lags))
        return pd.DataFrame([[*own, t, r["coef"][i], r["se"][i], r["p"][i], r["n"], r["r2"]] for i, t in enumerate(["const", *job["xs"]])], columns=schema.names)

    return dealt.groupBy("job__").applyInPandas(solve, schema)


def encompassing(panel: DataFrame, order: str, latent: str, variants: list[str], rivals: list[str], differences: bool = False, lags: int | None = None) -> DataFrame:
    """(variant, rival, b1, se_b1, p_b1, n, r2) of the latent weight on each variant of the index: alone (rival none), beside each rival,
    beside all that have LEAST_OBSERVATIONS, and beside the long ones of those where some are short. Standardised on the common
    periods; Newey-West errors; too few periods give a row without a coefficient."""
    counts = panel.agg(*(F.count(c).alias(c) for c in [*variants, *rivals])).first()
    jobs = []
    for v in variants:
        sets = [("none", []), *((r, [r]) for r in rivals)]
        enough = [r for r in rivals if counts[r] >= LEAST_OBSERVATIONS]
        if len(enough) > 1:
            sets.append(("all", enough))
        long_ = [r for r in enough if counts[r] >= LONG * counts[v]]
        if 1 < len(long_) < len(enough):
            sets.append(("all long", long_))
        jobs += [{"labels": {"variant": v, "rival": name}, "y": latent, "xs": [v, *some]} for name, some in sets]
    found = _regressions(panel, order, jobs, differences, True, lags)
    return found.where("term = variant").select("variant", "rival", F.col("coef").alias("b1"), F.col("se").alias("se_b1"), F.col("p").alias("p_b1"), "n", "r2")


def convergent(panel: DataFrame, order: str, indexes: list[str], targets: list[str]) -> DataFrame:
    """(index, target, n, corr, p): the standardised slope is the correlation on the common periods, its p-value is Newey-West's."""
    jobs = [{"labels": {"index": c, "target": x}, "y": x, "xs": [c]} for c in indexes for x in targets]
    return _regressions(panel, order, jobs, False, True, None).where("term = index").select("index", "target", "n", F.col("coef").alias("corr"), "p")


def predictive(panel: DataFrame, order: str, indexes: list[str], targets: list[str], horizons: list[int], control: str) -> DataFrame:
    """(index, target, h, n, b, se, p, p_holm): y(t+h) - y(t) on the standardised index, y(t), its last change and a control; lags
    by the rule plus h. p_holm: corrected over the targets of an index and horizon."""
    from pyspark.sql import Window as W

    from ..functions.numeric import newey_west_lags

    w = W.orderBy(order)  # a row for each period
    wide = panel.select(order, *indexes, *targets, control)
    wide = wide.withColumns({f"{y}_ahead{h}": F.lead(y, h).over(w) - F.col(y) for y in targets for h in horizons} | {f"{y}_change": F.col(y) - F.lag(y).over(w) for y in targets})
    n = wide.count()
    means = wide.agg(*(f(c).alias(f"{c}_{k}") for c in indexes for f, k in ((F.avg, "m"), (F.stddev_pop, "s"))))
    wide = wide.crossJoin(F.broadcast(means)).withColumns({c: (F.col(c) - F.col(f"{c}_m")) / F.col(f"{c}_s") for c in indexes})
    jobs = [{"labels": {"index": c, "target": y, "h": str(h)}, "y": f"{y}_ahead{h}", "xs": [c, y, f"{y}_change", control], "lags": newey_west_lags(n, h)} for c in indexes for y in targets for h in horizons]
    out = _regressions(wide, order, jobs, False, False, None).where("term = index")
    out = out.select("index", "target", F.col("h").cast("int").alias("h"), "n", F.col("coef").alias("b"), "se", "p")
    return holm(out, "p", ["index", "h"])


def discriminant(panel: DataFrame, order: str, indexes: list[str], anchors: list[str], controls: list[str]) -> tuple[DataFrame, DataFrame]:
    """((index, n, r2): what the controls explain of it; (index, anchor, n, c, p): what it explains of anchors beyond the controls)."""
    a = _regressions(panel, order, [{"labels": {"index": c}, "y": c, "xs": controls} for c in indexes], False, False, None)
    b = _regressions(panel, order, [{"labels": {"index": c, "anchor": x}, "y": x, "xs": [c, *controls]} for c in indexes for x in anchors], False, False, None)
    return a.where("term = 'const'").select("index", "n", "r2"), b.where("term = index").select("index", "anchor", "n", F.col("coef").alias("c"), "p")


def convergent_verdict(table: DataFrame, index: str, needed: list[list[str]], alpha: float = 0.05) -> DataFrame:
    """One row: passed if of each list of targets at least one is positive and significant."""
    ok = lambda x: F.coalesce(F.bool_or((F.col("target") == x) & (F.col("corr") > 0) & (F.col("p") < alpha)), F.lit(False))
    each = [F.greatest(*(ok(x) for x in xs), F.lit(False)) for xs in needed]
    return table.where(F.col("index") == index).agg(*(e.alias(f"has_{xs[0]}") for e, xs in zip(each, needed, strict=True)), F.least(*each, F.lit(True)).alias("passed"))


def event_study(events: DataFrame, daily: DataFrame, surprise: str, days: int = 7) -> DataFrame:
    """(regressor, n, b, se, p, const): the change around each event, on the surprise and on its size, HC1; b and se by 10 units."""
    from pyspark.sql import types as T

    changes = window_change(events, daily, "day", "value", days).where(F.col("delta").isNotNull() & F.col(surprise).isNotNull()).select("delta", F.col(surprise).cast("double").alias("x"))
    schema = T.StructType([T.StructField("regressor", T.StringType()), T.StructField("n", T.LongType()), *(T.StructField(c, T.DoubleType()) for c in ("b", "se", "p", "const"))])

    def solve(pdf):
        import pandas as pd

        from ..functions.numeric import ols

        rows = []
        for name, x in (("surprise", pdf["x"].to_numpy(float)), ("size", np.abs(pdf["x"].to_numpy(float)))):
            r = ols(pdf["delta"].to_numpy(float), x, robust="hc1")
            rows.append((name, r["n"], 10 * r["coef"][1], 10 * r["se"][1], r["p"][1], r["coef"][0]))
        return pd.DataFrame(rows, columns=schema.names)

    return changes.groupBy(F.lit(1).alias("all__")).applyInPandas(solve, schema)  # a row for each event


def placebo_study(events: DataFrame, daily: DataFrame, days: int = 30, step: int = 7) -> DataFrame:
    """events with their change and the share of changes, around days on a grid of `step` days, that are at least as large."""
    ends = daily.agg(F.min("day").alias("a"), F.max("day").alias("b"))
    grid = ends.where(f"date_add(a, {2 * days + 2}) <= b").select(F.explode(F.expr(f"sequence(date_add(a, {days + 1}), date_sub(b, {days + 1}), interval {step} days)")).alias("day"))
    return placebo_share(window_change(events, daily, "day", "value", days), window_change(grid, daily, "day", "value", days))


def rate_surprises(meetings: DataFrame, rates: DataFrame, most: int = 7) -> DataFrame:
    """meetings (day) with surprise in basis points: the first rate from the day after, less the last before the day, `most` days at most."""
    from .joins import around

    found = around(meetings.select("day").distinct(), rates, "day", "value", most)
    return meetings.join(found.select("day", (100 * (F.col("after") - F.col("before"))).alias("surprise")), "day", "left")


def discriminant_verdict(explained: DataFrame, anchors: DataFrame, index: str, market: list[str], most: float = 0.8, alpha: float = 0.05) -> DataFrame:
    """One row: what the controls explain of an index, the market anchors that it moves (positive, significant), and passed: less than
    `most` is explained and at least one anchor is moved."""
    moved = F.array_sort(F.collect_set(F.when(F.col("anchor").isin(market) & (F.col("c") > 0) & (F.col("p") < alpha), F.col("anchor"))))
    found = anchors.where(F.col("index") == index).agg(moved.alias("moved"))
    return explained.where(F.col("index") == index).select("r2").crossJoin(F.broadcast(found)).withColumn("passed", (F.col("r2") < most) & (F.size("moved") > 0))


def predictive_verdict(table: DataFrame, index: str, target: str, h: int = 6, alpha: float = 0.05) -> DataFrame:
    """One row: slope and p-value of the primary target at a horizon, and passed: positive and significant; the targets' corrected
    p-values beside it."""
    at = table.where((F.col("index") == index) & (F.col("h") == h))
    corrected = F.map_from_entries(F.array_sort(F.collect_list(F.struct("target", "p_holm")))).alias("p_holm")
    own = F.col("target") == target
    out = at.agg(F.max(F.when(own, F.col("b"))).alias("b"), F.max(F.when(own, F.col("p"))).alias("p"), corrected)
    return out.withColumn("passed", F.coalesce((F.col("b") > 0) & (F.col("p") < alpha), F.lit(False)))


def compared_curves(ours: DataFrame, official: DataFrame, keys: list[str], names: list[str], day: str = "day") -> DataFrame:
    """By curve and tenor (keys and the columns `names`): n, mean and largest absolute difference, and correlation over the days of both."""
    long_ = lambda df: df.select(day, *keys, F.explode(F.create_map(*(x for n in names for x in (F.lit(n), F.col(n))))).alias("curve", "value")).where("value is not null")
    j = long_(ours).withColumnRenamed("value", "a").join(long_(official).withColumnRenamed("value", "b"), [day, *keys, "curve"])
    gap = F.col("a") - F.col("b")
    return j.groupBy("curve", *keys).agg(F.count("*").alias("n"), F.avg(gap).alias("mean_diff"), F.max(F.abs(gap)).alias("max_abs_diff"), F.corr("a", "b").alias("r"))


def validated_index(panel: DataFrame, order: str, gap: str, surprise: str, variants: list[str], rivals: list[str]) -> dict[str, DataFrame]:
    """The whole validation of an index: the latent weight of the state-space model, what encompasses what, and the verdict by variant."""
    from .probe import survival
    from .stats import latent_weight

    latent = latent_weight(panel.where(F.col(gap).isNotNull() | F.col(surprise).isNotNull()), order, gap, surprise)
    table = encompassing(panel.join(latent.select(order, F.col("smoothed").alias("latent__")), order), order, "latent__", variants, rivals)
    return {"latent": latent, "encompassing": table, "verdict": survival(table)}
