"""Leakage probes: false dates, guesses of a text's year, blindness by level of masking, halo between dimensions, verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import shifted_date
from .joins import labelled_intervals

# From which mean error in years, and up to which accuracy of episodes, a level counts as blind; least correlation
# of a failure; margin of the halo rule.
LEAST_ERROR, MOST_ACCURACY, LEAST_RHO, HALO = 4.0, 0.25, 0.25, 0.20


def with_false_dates(rows: DataFrame, day: str, order: list[str], today: Column, years: int = 5) -> DataFrame:
    """rows with false_day: the day moved forward in every other row, back in the others, within the regime and the past.

    Rows alternate in the given order; they are numbered within ranges of it, so that no single task sees them all."""
    from .ranks import with_row_number

    numbered = with_row_number(rows, order, "row__")
    return numbered.withColumn("false_day", shifted_date(F.col(day), F.col("row__") % 2 == 0, today, years)).drop("row__")


def year_probe(guesses: DataFrame, strata: list[tuple[str, str, str]], level: str = "level", day: str = "day", guess: str = "guess") -> DataFrame:
    """By level of masking: n guesses that are years, mean absolute error, accuracy of episodes (strata of (label, first, last);
    a guessed year stands for its 1st of July; only where both have one), the share by chance, and blind.

    A level without any guess isn't blind; one whose guesses meet no episode is, if its error is large enough."""
    found = guesses.where(F.col(guess).isNotNull())
    found = labelled_intervals(found, F.col(day), strata, "real__")
    found = labelled_intervals(found, F.make_date(F.col(guess).cast("int"), F.lit(7), F.lit(1)), strata, "said__")
    both = F.col("real__").isNotNull() & F.col("said__").isNotNull()
    g = guesses.select(level).distinct().withColumnRenamed(level, "l__").join(
        found.groupBy(level).agg(F.count("*").alias("n"), F.avg(F.abs(F.col(guess) - F.year(day))).alias("mean_error"), F.avg(F.when(both, (F.col("real__") == F.col("said__")).cast("int"))).alias("accuracy")),
        F.col("l__").eqNullSafe(F.col(level)), "left",
    ).drop(level).withColumnRenamed("l__", level)
    blind = (F.col("mean_error") >= LEAST_ERROR) & (F.col("accuracy").isNull() | (F.col("accuracy") <= MOST_ACCURACY))
    return g.select(level, F.coalesce("n", F.lit(0)).alias("n"), "mean_error", "accuracy", F.lit(1 / len(strata) if strata else None).cast("double").alias("by_chance"), F.coalesce(blind, F.lit(False)).alias("blind"))


def lowest_blind_level(probes: DataFrame, level: str = "level") -> DataFrame:
    """One row: the first level, by name, that is blind; null if none is."""
    return probes.agg(F.min(F.when(F.col("blind"), F.col(level))).alias("lowest_blind"))


def rank_correlations(rows: DataFrame, columns: list[str], keys: list[str] = ()) -> DataFrame:
    """(first, second, rho): Spearman's correlation of each pair of columns over the rows that have both, by key.

    Meant for ordinal columns of few values: rows are counted by pair of values first, and ranks are windows over those."""
    from pyspark.sql import Window as W

    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    stacked = rows.select(*keys, F.explode(F.array(*(F.struct(F.lit(a).alias("first"), F.lit(b).alias("second"), F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y")) for a, b in pairs))).alias("p")).select(*keys, "p.*")
    by = [*keys, "first", "second"]
    counts = stacked.where("x is not null and y is not null").groupBy(*by, "x", "y").agg(F.count("*").alias("m"))

    def rank(c: str) -> Column:
        below = F.sum("m").over(W.partitionBy(*by).orderBy(c).rangeBetween(W.unboundedPreceding, W.currentRow))
        return below - (F.sum("m").over(W.partitionBy(*by, c)) - 1) / 2.0

    r = counts.withColumns({"a": rank("x"), "b": rank("y")})
    s = r.groupBy(*by).agg(F.sum("m").alias("n"), *(F.sum(F.col("m") * e).alias(n) for n, e in (("sa", F.col("a")), ("sb", F.col("b")), ("sab", F.col("a") * F.col("b")), ("saa", F.col("a") * F.col("a")), ("sbb", F.col("b") * F.col("b")))))
    cov, va, vb = (F.col(x) - F.col(y) * F.col(z) / F.col("n") for x, y, z in (("sab", "sa", "sb"), ("saa", "sa", "sa"), ("sbb", "sb", "sb")))
    return s.select(*by, "n", F.try_divide(cov, F.sqrt(va * vb)).alias("rho"))


def halo(model: DataFrame, people: DataFrame, margin: float = HALO) -> DataFrame:
    """Pairs of dimensions with both correlations, and alert where the model's is more than `margin` above people's."""
    a = model.select("first", "second", F.col("rho").alias("rho_model"))
    b = people.select("first", "second", F.col("rho").alias("rho_people"))
    return a.join(b, ["first", "second"]).withColumn("alert", F.coalesce(F.col("rho_model") > F.col("rho_people") + margin, F.lit(False)))


def outcome_leak(changes: DataFrame, change: str, outcome: str, alpha: float = 0.05) -> DataFrame:
    """Correlation of a change with what was realised later, its p-value, and failed: significant and not small."""
    from .stats import correlations, with_p_values

    c = correlations(changes, change, outcome).withColumn("df", F.col("n") - 2)
    return with_p_values(c, "t", "df").select("n", "r", "t", F.col("p_t").alias("p"), (F.col("p_t") < alpha).alias("significant"), ((F.col("p_t") < alpha) & (F.abs("r") >= LEAST_RHO)).alias("failed"))


def survival(table: DataFrame, variant: str = "variant", rival: str = "rival", coef: str = "b1", p: str = "p_b1", none: str = "none", alpha: float = 0.05) -> DataFrame:
    """By variant, over its regressions with a p-value: whether it is significant alone, against how many rivals it was tested and
    stays so, against all, whether the sign is the same throughout, and the range of the coefficient."""
    alone = F.col(rival) == none
    sig = F.col(p) < alpha
    return table.where(F.col(p).isNotNull()).groupBy(variant).agg(
        F.count("*").alias("n"), F.every(F.when(alone, sig)).alias("significant_alone"), F.count_if(~alone).alias("n_rivals"), F.count_if(~alone & sig).alias("n_survived"),
        F.every(F.when(~alone, sig)).alias("survives_all"), (F.min(F.signum(coef)) == F.max(F.signum(coef))).alias("same_sign"), F.min(coef).alias("least"), F.max(coef).alias("most"),
    )


def same_conclusions(table: DataFrame, first: str, second: str, variant: str = "variant", rival: str = "rival", coef: str = "b1", p: str = "p_b1", alpha: float = 0.05) -> DataFrame:
    """Two variants side by side by rival, and whether both have the sign and the significance of the other."""
    side = lambda v, n: table.where(F.col(variant) == v).select(rival, F.col(coef).alias(f"b_{n}"), F.col(p).alias(f"p_{n}"))
    j = side(first, "first").join(side(second, "second"), rival)
    return j.withColumn("same", ((F.col("p_first") < alpha) == (F.col("p_second") < alpha)) & (F.signum("b_first") == F.signum("b_second")))


def battery_sample(items: DataFrame, day: str, key: str, strata: list[tuple[str, str, str]], n: int, seed: str, today: Column) -> DataFrame:
    """n items of each stratum by least hash, with their stratum, whether their day lies in one, and a false day in the order of the key."""
    from .sampling import per_stratum

    kept = labelled_intervals(items, F.col(day), strata, "stratum").where("stratum is not null")
    return with_false_dates(per_stratum(kept, "stratum", key, n, seed), day, [key], today)


def time_probe(log: DataFrame, items: DataFrame, key: str, strata: list[tuple[str, str, str]]) -> DataFrame:
    """year_probe() of a log of answers (key, level, at, answer, error) to the question of a text's year: of each item and level the last
    answer without an error; items: key, day."""
    from ..functions.scores import parsed_year
    from .corpus import one_of_each

    last = one_of_each(log.where("error is null"), [key, "level"], [F.col("at").desc()])
    guesses = last.join(items.select(key, "day"), key).select("level", "day", parsed_year(F.col("answer")).alias("guess"))
    return year_probe(guesses, strata)
