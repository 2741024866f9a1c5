"""Operators of the engine against hand-computed values, with nulls and empty inputs."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from folio.functions import numeric as N
from folio.functions import text
from folio.operators import calendar as cal
from folio.operators import corpus, curves, panel
from folio.operators import index as ix
from folio.operators import joins as jn
from folio.operators import stats as st

D = dt.date


def items(spark, rows):
    return spark.createDataFrame(rows, "item_id int, day date, outlet int, kind string, wire int, d1 int, no_signal boolean")


def test_pooled_window_looks_back_only(spark):
    rows = [(1, D(2020, 1, 10), 1, "a", 1, 5, False), (2, D(2020, 2, 10), 1, "a", 2, 1, False), (3, D(2020, 3, 10), 1, "a", 3, 3, False), (4, D(2020, 3, 11), 1, "a", 4, 3, False)]
    got = {r.period.month: (r.n_items, r.level) for r in ix.periodic_index(items(spark, rows), back=3).collect()}
    assert got == {1: (1, 1.0), 2: (2, 0.5), 3: (4, 0.5)}


def test_no_signal_counts_in_share_only(spark):
    rows = [(1, D(2020, 1, 1), 1, "a", 1, 4, False), (2, D(2020, 1, 2), 1, "a", 1, 2, False), (3, D(2020, 1, 3), 1, "a", 2, None, True)]
    r = ix.periodic_index(items(spark, rows)).first()
    assert (r.level, r.n_items, r.n_total, r.se_day) == (0.5, 1, 3, None) and r.share_no_signal == pytest.approx(1 / 3)
    assert ix.periodic_index(items(spark, [])).collect() == []


def test_kind_effects_recover_an_unbalanced_panel():
    rng = np.random.default_rng(0)
    cells = []
    for m in range(24):
        level = 0.5 + 0.2 * (m >= 12) + rng.normal(0, 0.01)
        cells.append((m, "press", 6, 6 * level))
        if m >= 12:
            cells.append((m, "research", 6, 6 * (level - 0.1)))
    e = ix.kind_effects(cells)
    assert e["research"] - e["press"] == pytest.approx(-0.1, abs=0.02)
    assert 24 * 6 * e["press"] + 12 * 6 * e["research"] == pytest.approx(0, abs=1e-8)


def test_easter_and_business_days(spark):
    days = {r.day for r in cal.holidays(spark, 2015, 2026).collect()}
    assert {D(2015, 4, 3), D(2024, 3, 29), D(2026, 4, 3), D(2024, 11, 20)} <= days and D(2023, 11, 20) not in days
    c = cal.business_calendar(spark, 2024, 2027)
    rows = spark.createDataFrame([(D(2024, 2, 9), D(2024, 2, 15))], "a date, b date")
    assert cal.business_days(rows, c, "a", "b", "d").first().d == 2
    m = {r.maturity: r.code for r in cal.maturities(c).collect()}
    assert m[D(2027, 1, 4)] == "DI1F27" and m[D(2026, 10, 1)] == "DI1V26" and D(2026, 11, 3) in m


def test_flat_forward_is_exact_at_points_and_null_outside(spark):
    p = spark.createDataFrame([("c", 1, 14.9), ("c", 252, 12.735), ("c", 504, 12.4)], "k string, du int, rate double")
    got = {r["at"]: r["rate"] for r in curves.flat_forward(p, spark.createDataFrame([(1,), (252,), (378,), (504,), (600,)], "at int"), ["k"]).collect()}
    assert got[1] == pytest.approx(14.9) and got[252] == pytest.approx(12.735) and got[504] == pytest.approx(12.4) and got[600] is None
    ahead = 1.124**2 / 1.12735
    assert got[378] == pytest.approx(((1.12735 * ahead**0.5) ** (252 / 378) - 1) * 100)


def test_replications_are_greedy_and_in_order(spark):
    rows = [(1, "k", "a", D(2020, 1, 1)), (2, "k", "b", D(2020, 1, 2)), (3, "k", "a", D(2020, 1, 2)), (4, "k", "c", D(2020, 1, 4)), (5, None, "a", D(2020, 1, 1)), (6, "x", "a", D(2020, 1, 1))]
    got = {r.i: (r.group_first, r.is_copy) for r in jn.replications(spark.createDataFrame(rows, "i int, key string, o string, d date"), "key", "o", "d", "i").collect()}
    assert got == {1: (1, False), 2: (1, True), 3: (3, False), 4: (3, True), 5: (None, None), 6: (6, False)}


def test_asof_ties_and_empty_side(spark):
    left = spark.createDataFrame([(1, 5), (1, 7), (2, 5)], "k int, t int")
    right = spark.createDataFrame([(1, 5, "x"), (1, 6, "y")], "k int, t int, v string")
    got = lambda f, **kw: {(r.k, r.t): r.v for r in f(left, right, ["k"], "t", ["v"], **kw).collect()}
    assert got(jn.asof_backward) == {(1, 5): "x", (1, 7): "y", (2, 5): None}
    assert got(jn.asof_backward, strict=True) == {(1, 5): None, (1, 7): "y", (2, 5): None}
    assert got(jn.asof_forward) == {(1, 5): "y", (1, 7): None, (2, 5): None}
    assert got(jn.asof_forward, strict=False) == {(1, 5): "x", (1, 7): None, (2, 5): None}


def test_target_ahead_inherits_the_last(spark):
    t = spark.createDataFrame([(2018, 4.5), (2019, 4.25)], "year int, target double")
    m = spark.createDataFrame([(D(2018, 1, 1),), (D(2018, 12, 1),), (D(2020, 6, 1),), (D(2016, 6, 1),)], "month date")
    got = {r.month: r.target_ahead for r in panel.target_ahead(m, t).collect()}
    assert got[D(2018, 1, 1)] == pytest.approx(11 / 12 * 4.5 + 4.25 / 12) and got[D(2018, 12, 1)] == pytest.approx(4.25) and got[D(2020, 6, 1)] == pytest.approx(4.25) and got[D(2016, 6, 1)] is None


def test_compounding_needs_all_months(spark):
    r = spark.createDataFrame([(D(2020 + i // 12, i % 12 + 1, 1), 0.5) for i in range(24)], "month date, r double")
    got = [x.r_compounded for x in panel.compounded(r.withColumn("k", F.lit(1)), "month", "r", 12, ["k"]).orderBy("month").collect()]
    assert got[:11] == [None] * 11 and got[-1] == pytest.approx((1.005**12 - 1) * 100)


def test_agreement_values():
    assert N.student_tail(2.0, 10) == pytest.approx(0.0733880, abs=1e-6)
    assert N.student_tail(1.0, 1) == pytest.approx(0.5)
    assert N.proportion_lower(95, 100) == pytest.approx(0.887165, abs=1e-5)
    assert N.holm(np.array([0.01, 0.04, 0.03])).tolist() == pytest.approx([0.03, 0.06, 0.06])
    assert N.ordinal_alpha(np.array([[1, 1], [3, 3], [5, 5], [2, np.nan]]), 5) == 1


def test_kappa_of_equal_opposite_and_constant_raters(spark):
    k = lambda rows: st.quadratic_kappa(spark.createDataFrame(rows, "a int, b int"), "a", "b").first().kappa
    assert k([(i, i) for i in range(1, 6)]) == 1 and k([(i, 6 - i) for i in range(1, 6)]) < 0 and k([(3, 3)] * 4) is None


def test_paired_degenerate_cases(spark):
    rows = lambda d: [(u, a, float(u + (d if a == "bad" else 0))) for u in range(5) for a in ("good", "bad")]
    t = lambda d: st.paired_and_welch(spark.createDataFrame(rows(d), "u int, a string, v double"), "u", "a", "v", ("good", "bad")).first().t_paired
    assert t(0) == 0 and t(1) == math.inf and t(-1) == -math.inf


def test_newey_west_and_latent_weight():
    rng = np.random.default_rng(1)
    x = rng.normal(size=300)
    r = N.ols(1 + 2 * x + rng.normal(size=300), x)
    assert r["coef"] == pytest.approx([1, 2], abs=0.15) and r["lags"] == math.floor(4 * 3 ** (2 / 9))
    w = np.clip(0.5 + np.cumsum(rng.normal(0, 0.02, 200)), 0.1, 0.9)
    d = rng.normal(0, 3, 200)
    y = w * d + rng.normal(0, 0.3, 200)
    y[50:55] = np.nan
    e = N.latent_weight(y, d)
    assert np.mean(np.abs(e["smoothed"] - w)) < 0.12 and np.nanmean(e["smoothed_se"]) <= np.nanmean(e["filtered_se"])


def test_filter_of_a_linear_model_is_that_of_the_joint_normal():
    """With the identity, filter and smoother are conditional expectations of a joint normal distribution, and so is the likelihood."""
    y, d = np.array([1.0, np.nan, 0.4, 2.0]), np.array([1.0, 2.0, -0.5, 1.5])
    noise, drift, spread = 0.3, 0.2, 10.0
    states, loglik = N.filtered_states(y, d, noise, drift, curved=False, spread=spread)
    mean, var = N.smoothed_states(states)
    k = np.arange(1, 5)
    prior = spread + drift**2 * np.minimum.outer(k, k)
    seen = np.isfinite(y)
    h = np.diag(d)[seen]
    cov = h @ prior @ h.T + noise**2 * np.eye(seen.sum())
    gap = y[seen] - h @ np.full(4, 0.5)
    gain = prior @ h.T @ np.linalg.inv(cov)
    assert mean == pytest.approx(0.5 + gain @ gap) and var == pytest.approx(np.diag(prior - gain @ h @ prior))
    assert states[-1, 5] == pytest.approx(mean[-1])
    assert loglik == pytest.approx(-0.5 * (gap @ np.linalg.inv(cov) @ gap + np.linalg.slogdet(2 * np.pi * cov)[1]))


def test_deviations_are_found_again():
    y, d, weight = N.simulated_weight(400, 0.4, 0.15, seed=5)
    e = N.latent_weight(y, d)
    assert e["noise"] == pytest.approx(0.4, rel=0.15) and 0.05 < e["drift"] < 0.35
    assert np.mean(np.abs(e["smoothed"] - weight)) < 0.1 and e["loglik"] >= N.filtered_states(y, d, 0.4, 0.15)[1] - 1e-6


def test_text_forms(spark):
    df = spark.createDataFrame([("Ação, já!  É  isso",), (None,)], "s string")
    r = df.select(text.norm(F.col("s")).alias("n"), text.text_key(F.col("s")).alias("k"), text.slug(F.col("s")).alias("g")).collect()
    assert tuple(r[0]) == ("acao, ja!  e  isso", "acao ja e isso", "acao-ja-e-isso") and tuple(r[1]) == (None, None, None)


def test_validation_and_latest(spark):
    df = spark.createDataFrame([(1, "a", "x"), (1, " ", "y"), (2, None, "x")], "id int, title string, kind string")
    got = {r.rule: r.n for r in corpus.violations(df, "id", ["title"], {"kind": ["x"]}).collect()}
    assert got == {"missing title": 2, "unknown kind": 1, "repeated id": 1}
    with pytest.raises(ValueError, match="missing title: 2"):
        corpus.validated(df, "id", ["title"], {})
    log = spark.createDataFrame([("k", 1, 3, None), ("k", 2, None, "timeout")], "key string, t int, d1 int, error string")
    assert corpus.latest_valid(log, "key", "t", F.col("error").isNull()).first().d1 == 3
