"""Readers, paging, writers and work units on small made-up inputs."""

import datetime as dt
import io
import json
import os
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from folio.operators import probe, sampling, validation, work
from folio.operators import relations as rl
from folio.sinks import files as sink
from folio.sources import logs, paged, readers

D = dt.date


def test_windows_cover_the_span_once():
    got = paged.windows(D(2000, 3, 31), D(2020, 1, 1), 9)
    assert got[0][0] == D(2000, 3, 31) and got[-1][1] == D(2020, 1, 1) and all(a[1] == b[0] for a, b in zip(got, got[1:]))
    assert all((b - a).days <= 9 * 366 for a, b in got) and paged.windows(D(2020, 1, 1), D(2020, 1, 1), 9) == []


def test_paging_ends_with_a_short_page_or_at_the_cap():
    asked = []

    def serve(request):
        asked.append(request["$skip"])
        return list(range(25))[request["$skip"] : request["$skip"] + request["$top"]]

    assert [len(p) for p in paged.pages(serve, {}, 10)] == [10, 10, 5] and asked == [0, 10, 20]
    assert len(list(paged.pages(serve, {}, 5, most=10))) == 2


def test_a_descending_scan_ends_early():
    days = [f"2020-01-{d:02d}" for d in range(31, 0, -1)]
    seen = []

    def found():
        for i in range(0, 31, 5):
            seen.append(i)
            yield [{"day": d} for d in days[i : i + 5]]

    got = [r["day"] for r in paged.descending(found(), "day", "2020-01-20", "2020-01-25")]
    assert got == ["2020-01-24", "2020-01-23", "2020-01-22", "2020-01-21", "2020-01-20"] and seen == [0, 5, 10, 15]


def test_a_failing_page_is_asked_for_in_smaller_ones():
    def serve(request):
        a, n = request["$skip"], request["$top"]
        if a <= 137 < a + n:
            raise ValueError("bad item")
        return list(range(a, a + n))

    records, gaps = paged.in_smaller_pages(serve, {"$top": 100, "$skip": 100})
    assert sorted(records) == [i for i in range(100, 200) if i != 137] and gaps == [{"skip": 137, "error": "ValueError: bad item"}]
    with pytest.raises(OSError):
        paged.in_smaller_pages(lambda r: (_ for _ in ()).throw(ConnectionError("gone")), {"$top": 100, "$skip": 0})


def test_splitting_until_a_search_is_small_enough():
    hits = {D(2020, 1, 1) + dt.timedelta(days=i): 3000 if i == 4 else 900 for i in range(10)}
    count = lambda a, b: sum(n for d, n in hits.items() if a <= d < b)
    got = paged.split_until(count, D(2020, 1, 1), D(2020, 1, 11), 2000)
    assert got[0][0] == D(2020, 1, 1) and got[-1][1] == D(2020, 1, 11) and all(a[1] == b[0] for a, b in zip(got, got[1:]))
    assert all(count(a, b) <= 2000 or (b - a).days == 1 for a, b in got)


def test_windows_of_a_source_follow_the_filter(spark):
    rows = [{"day": f"20{y:02d}-06-01", "v": float(y)} for y in range(10, 20)]

    def serve(request):
        assert request["first"] >= "2015"  # other windows are never asked for
        return [r for r in rows if request["first"] <= r["day"] < request["end"]][request["$skip"] : request["$skip"] + request["$top"]]

    plan = [{"first": f"20{y:02d}-01-01", "end": f"20{y + 1:02d}-01-01"} for y in range(10, 20)]
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        spark.dataSource.register(paged.source_class("windows_test", "day string, v double", serve, plan, size=1, day="day"))
        df = spark.read.format("windows_test").load()
        assert sorted(r.v for r in df.where("day >= '2015-01-01' and day < '2018-01-01'").collect()) == [15.0, 16.0, 17.0]
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_members_of_nested_archives(spark, tmp_path):
    inner, outer = io.BytesIO(), io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("a.txt", "one")
        z.writestr("b.csv", "two")
    with zipfile.ZipFile(outer, "w") as z:
        z.writestr("in.zip", inner.getvalue())
        z.writestr("c.txt", "three")
    (tmp_path / "good.zip").write_bytes(outer.getvalue())
    (tmp_path / "empty.zip").write_bytes(b"")
    got = {(os.path.basename(r.path), r.member): bytes(r.content) for r in readers.members(spark, f"{tmp_path}/*.zip", ".txt").collect()}
    assert got == {("good.zip", "in.zip/a.txt"): b"one", ("good.zip", "c.txt"): b"three"}


def test_series_readers(spark, tmp_path):
    (tmp_path / "s.csv").write_text(" DATA ,Valor\n2020-01-02,1.5\n03/01/2020,\"2,5\"\nx,3\n2020-01-05,n/d\n")
    got = [tuple(r) for r in readers.day_and_value(spark, f"{tmp_path}/s.csv").orderBy("day").collect()]
    assert got == [(D(2020, 1, 2), 1.5), (D(2020, 1, 3), 2.5)]
    (tmp_path / "bad.csv").write_text("data,taxa\n2020-01-02,1\n")
    with pytest.raises(ValueError, match="valor"):
        readers.day_and_value(spark, f"{tmp_path}/bad.csv")
    (tmp_path / "r.csv").write_text("data,pre\n2020-01-02,-1\n2020-01-03,12\n2020-01-04,99\n")
    assert [r.value for r in readers.plausible_rates(spark, f"{tmp_path}/r.csv", "pre").collect()] == [12.0]
    months = spark.createDataFrame([(D(2020, 1, 1),), (D(2020, 2, 1),)], "month date")
    assert readers.market_series(spark, "none", months, [str(tmp_path)]) is None and readers.yearly_as_monthly(spark, months, f"{tmp_path}/none.csv") is None
    assert set(readers.bundle(spark, {"a": f"{tmp_path}/s.csv", "b": f"{tmp_path}/none.csv"})) == {"a"}
    with pytest.raises(ValueError, match="no reader"):
        readers.by_suffix(spark, "x.xlsx")


def test_meeting_history_is_local(spark, tmp_path):
    (tmp_path / "h.json").write_text(json.dumps([{"nro": 1, "data": "2020-01-02T01:00:00Z"}, {"nro": 2, "data": "2020-02-05"}, {"nro": 3, "data": None}]))
    got = {r.number: r.day for r in readers.meeting_history(spark, f"{tmp_path}/h.json", {"nro": "number", "data": "day"}).collect()}
    assert got == {1: D(2020, 1, 1), 2: D(2020, 2, 5)}


def test_first_list_and_total_of_any_json(spark):
    texts = [('{"a": {"total": 7, "b": [{"x": 1}, {"x": 2}]}, "c": [1, 2]}',), ('{"hits": {"total": true}}',), ("no json",), (None,)]
    got = [(r["items"], r.total) for r in readers.response_items(spark.createDataFrame(texts, "s string"), "s").collect()]
    assert got == [(['{"x": 1}', '{"x": 2}'], 7), (None, None), (None, None), (None, None)]


def test_configuration_is_read_again_when_it_changes(tmp_path):
    p = tmp_path / "c.json"
    p.write_text('{"a": 1}')
    one = readers.configuration(str(p))
    assert one == {"a": 1} and readers.configuration(str(p)) is one
    p.write_text('{"a": 2}')
    os.utime(p, ns=(1, 10**18))
    assert readers.configuration(str(p)) == {"a": 2}


def test_separators_are_text_and_sections_follow_headers(spark):
    df = spark.createDataFrame([("pre",), ("a|b",), ("a|b",), ("c|d",)], "value string")
    assert sorted(map(tuple, logs.separated(df, ["x", "y"], "|").collect())) == [("a", "b"), ("c", "d")]
    t = spark.createDataFrame([("top\nBeta;1\nPRM\nb1;2\n\nVERT\n1;3\n2;4",)], "t string")
    got = [(r.section, list(r.fields)) for r in logs.sections(t, "t", {"PRM": "params", "VERT": "vertices"}).collect()]
    assert got == [("params", ["b1", "2"]), ("vertices", ["1", "3"]), ("vertices", ["2", "4"])]
    fixed = spark.createDataFrame([("PRE0000123-4",), ("PRE",)], "value string")
    got = [tuple(r) for r in logs.fixed_width(fixed, {"curve": (1, 3), "digits": (4, 7), "sign": (11, 1)}).collect()]
    assert got == [("PRE", "0000123", "-"), ("PRE", None, None)]
    one = spark.createDataFrame([("-", "0012345")], "s string, d string").select(logs.signed_fixed(F.col("s"), F.col("d"), 0.01).alias("v")).first()
    assert one.v == pytest.approx(-123.45)


def test_scoring_keeps_errors_apart(spark):
    def complete(message):
        if message == "b":
            raise RuntimeError("refused")
        return message * 2

    rows = logs.scored(spark, spark.createDataFrame([(1, "a"), (2, "b")], "i int, m string"), "m", complete).collect()
    assert {r.i: (r.answer, r.error) for r in rows} == {1: ("aa", None), 2: (None, "RuntimeError: refused")}


def test_results_and_reports(spark, tmp_path):
    df = spark.createDataFrame([("a|b", 1.23456, None)], "k string, v double, n int")
    assert sink.result_document(df, f"{tmp_path}/r.json") == {"k": "a|b", "v": 1.23456, "n": None}
    assert json.loads((tmp_path / "r.json").read_text()) == {"k": "a|b", "v": 1.23456, "n": None}
    text = sink.report({"One": df}, f"{tmp_path}/r.md")
    assert (tmp_path / "r.md").read_text() == text == "## One\n\n| k | v | n |\n| --- | --- | --- |\n| a\\|b | 1.2346 |  |\n"
    with pytest.raises(ValueError):
        sink.result_document(df.union(df), f"{tmp_path}/x.json")
    with pytest.raises(ValueError):
        sink.markdown(spark.range(20), most=10)


def test_starts_keep_their_distance(spark):
    rng = np.random.default_rng(0)
    at = sorted(rng.integers(0, 600, 40).tolist())
    rows = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)) for i, s in enumerate(at)]
    got = {r.i: (r.admitted, r.wait) for r in work.admitted(spark.createDataFrame(rows, "i int, at timestamp").withColumn("p", F.lit("x")), "at", "p", 10, 30).collect()}
    free = -1e9
    starts = []
    for s in at[:30]:
        free = max(s, free + 6)
        starts.append(free - s)
    waits = sorted(w for ok, w in got.values() if ok)
    assert waits == pytest.approx(sorted(starts)) and sum(ok for ok, _ in got.values()) == 30


def test_holdout_and_audit_sizes(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    for share in (0, 0.001, 0.1, 0.5, 1):
        got = sampling.audit_share(df, "k", share, "s")
        assert got.count() == round(share * 1000)
    want = {r.k for r in df.orderBy(sampling.rank_key(F.col("k"), "s"), "k").limit(100).collect()}
    assert {r.k for r in sampling.audit_share(df, "k", 0.1, "s").collect()} == want
    assert sampling.audit_share(df.limit(0), "k", 0.1, "s").count() == 0


def test_blindness_without_matching_episodes(spark):
    rows = [("L1", D(2012, 6, 1), 2005), ("L1", D(2015, 6, 1), 2005), ("L2", D(2012, 6, 1), 2012), ("L3", D(2012, 6, 1), None)]
    strata = [(f"e{i}", f"20{10 + i}-01-01", f"20{10 + i}-12-31") for i in range(6)]
    got = {r.level: (r.n, r.mean_error, r.accuracy, r.blind) for r in probe.year_probe(spark.createDataFrame(rows, "level string, day date, guess int"), strata).collect()}
    assert got == {"L1": (2, 8.5, None, True), "L2": (1, 0.0, 1.0, False), "L3": (0, None, None, False)}


def test_encompassing_is_least_squares(spark):
    from folio.functions.numeric import ols

    rng = np.random.default_rng(4)
    x, r = rng.normal(size=80), rng.normal(size=80)
    y = 0.7 * x + 0.2 * r + rng.normal(size=80)
    rows = [(i, float(y[i]), float(x[i]), float(r[i]), float(r[i]) if i > 60 else None) for i in range(80)]
    panel = spark.createDataFrame(rows, "t int, latent double, v double, r double, few double")
    got = {g.rival: g for g in validation.encompassing(panel, "t", "latent", ["v"], ["r", "few"]).collect()}
    z = lambda a: (a - a.mean()) / a.std()
    want = ols(z(y), np.column_stack([z(x), z(r)]))
    assert got["r"].b1 == pytest.approx(want["coef"][1]) and got["r"].p_b1 == pytest.approx(want["p"][1]) and got["r"].n == 80
    beta = np.linalg.lstsq(np.column_stack([np.ones(80), z(x)]), z(y), rcond=None)[0]
    assert got["none"].b1 == pytest.approx(beta[1]) and got["few"].b1 is None and got["few"].n == 19 and "all" not in got


def test_series_side_by_side(spark):
    panel = spark.createDataFrame([(1, 1.0), (2, 2.0)], "k int, x double")
    a, b = spark.createDataFrame([(1, 5.0)], "k int, x double"), spark.createDataFrame([(2, 6.0)], "k int, X double")
    out = rl.with_series(panel, {"a": a, "b": b}, "k")
    assert out.columns == ["k", "x", "x_right", "X_right_right"] and sorted(map(tuple, out.collect())) == [(1, 1.0, 5.0, None), (2, 2.0, None, 6.0)]


def test_ordinal_head_finds_the_direction(spark):
    from folio.operators.ordinal_model import filter_report, fit_ordinal, ordinal_scores

    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 3))
    level = x @ np.array([2.0, -1.0, 0.0]) + rng.logistic(size=600)
    y = 1 + (level[:, None] > np.array([-2.0, -0.5, 0.5, 2.0])).sum(axis=1)
    rows = [(i, x[i].tolist(), int(y[i])) for i in range(600)] + [(600, None, 3), (601, [0.0, 0.0, 0.0], None)]
    df = spark.createDataFrame(rows, "i int, x array<double>, y int").repartition(5)
    head = fit_ordinal(df, "x", "y")
    assert head.weights == pytest.approx([2, -1, 0], abs=0.3) and head.biases == pytest.approx([2, 0.5, -0.5, -2], abs=0.4)
    assert (np.diff(head.biases) < 0).all()
    got = {r.i: r for r in ordinal_scores(df, head, "x").collect()}
    assert got[600].level is None and got[601].level == 3 and np.mean([abs(got[i].level - y[i]) for i in range(600)]) < 0.9
    with pytest.raises(ValueError):
        fit_ordinal(df.limit(0), "x", "y")
    s = spark.createDataFrame([(0.9, 1)] * 95 + [(0.1, 1)] * 5 + [(0.2, 0)] * 100, "p double, y int")
    r = filter_report(s, "p", "y", 0.5).first()
    assert (r.positives, r.kept, r.sensitivity, r.discarded) == (100, 95, 0.95, 0.525) and r.lower == pytest.approx(0.887165, abs=1e-5)


def test_a_leak_is_significant_and_not_small(spark):
    rng = np.random.default_rng(3)
    a = rng.normal(size=200)
    df = spark.createDataFrame([(float(x), float(0.5 * x + e)) for x, e in zip(a, rng.normal(size=200))], "a double, b double")
    r = probe.outcome_leak(df, "a", "b").first()
    assert r.failed and r.significant and r.p < 1e-6 and r.n == 200


def test_services(spark):
    from folio.sources import services as sv

    assert [(r["first"], r["end"]) for r in sv.series_requests(11, D(2000, 1, 1), D(2020, 1, 1), True)] == [("2000-01-01", "2009-01-01"), ("2009-01-01", "2018-01-01"), ("2018-01-01", "2020-01-01")]
    assert len(sv.series_requests(11, D(2000, 1, 1), D(2020, 1, 1), False)) == 1
    q = sv.entity_query("Rates", {"Indicador": "IPCA d'or", "baseCalculo": 0}, ["Data", "Mediana"], "Data", ("Data", "2001-11-01"))
    assert q == "Rates?%24filter=x".replace("%24filter=x", "$filter=Indicador%20eq%20%27IPCA%20d%27%27or%27%20and%20baseCalculo%20eq%200%20and%20Data%20ge%20%272001-11-01%27&$select=Data,Mediana&$orderby=Data&$format=json")
    assert list(sv.entity_rows(lambda r: list(range(7))[r["$skip"] : r["$skip"] + r["$top"]], q, 3)) == list(range(7))
    hits = [{"day": f"2020-01-{d:02d}", "kind": k} for d in range(20, 0, -1) for k in ("Matéria", "Vídeo")]
    got = list(sv.search_scan(lambda r: hits[r["$skip"] : r["$skip"] + r["$top"]], "copom", "x", "2020-01-10", "2020-01-12"))
    assert got == [{"day": d, "kind": "Matéria", "outlet": "x", "query": "copom"} for d in ("2020-01-11", "2020-01-10")]
    posts, gaps, unit = sv.posts_of_year(lambda r: list(range(r["$skip"], r["$skip"] + r["$top"])), "x", 2020, D(2019, 6, 1), D(2020, 3, 1), 200)
    assert posts == list(range(200)) and gaps == [] and unit == "x|2020|2020-01-01|2020-03-01"
    assert sv.posts_of_year(lambda r: [], "x", 2020, D(2019, 6, 1), D(2022, 3, 1), 0)[2] == "x|2020"
    index = "<loc>https://x/2020-01-02/a.xml?p=1&amp;q=2</loc><loc>https://x/2020-02-02/b.xml</loc><loc>https://x/c.xml</loc>"
    assert sv.site_map_days(index, "2020-01-01", "2020-02-01") == [("2020-01-02", "https://x/2020-01-02/a.xml?p=1&q=2")] and len(sv.site_map_urls(index)) == 3
    page = 'x; Site.data = {"a": "};", "headlines": {"basic": "T &amp; U"}, "content_elements": [{"type": "text", "content": "<b>' + "w " * 40 + '</b>"}, {"type": "text", "content": "short"}], "display_date": "2020-01-01"}; Site.x = 1'
    found = sv.script_object(page, "Site.data")
    s = sv.story(found, "x", "u")
    assert (s["title"], s["day"], s["n_paragraphs"], s["p2"], s["subtitle"]) == ("T & U", "2020-01-01", 1, None, None) and s["p1"] == ("w " * 40).strip()
    assert sv.script_object("none", "Site.data") is None and sv.script_object("Site.data = {bad", "Site.data") is None and sv.story({}, "x", "u") is None
    rows = [("IPCA", "S", 0, "2020-01-02", 4.0), ("IPCA", "N", 0, "2020-01-02", 5.0), ("IPCA", "S", 1, "2020-01-02", 6.0), ("IGP", "S", 0, "2020-01-02", 7.0)]
    df = spark.createDataFrame(rows, "Indicador string, Suavizada string, baseCalculo int, Data string, Mediana double")
    for c in ("Media", "DesvioPadrao", "Minimo", "Maximo", "numeroRespondentes"):
        df = df.withColumn(c, F.lit(1.0))
    assert [(r.day, r.median) for r in sv.expectations(df, "IPCA").collect()] == [(D(2020, 1, 2), 4.0)]
    m = spark.createDataFrame([(0, "2020-01-02", "R5/2028", 9.0), (0, "2020-01-02", "x", 1.0)], "baseCalculo int, Data string, Reuniao string, Mediana double")
    assert [(r.number, r.year, r.median) for r in sv.expectations_by_meeting(m).collect()] == [(5, 2028, 9.0)]
    links = spark.createDataFrame([('<a href="/n/1">x</a><A class=b HREF="/n/2"><a href="/n/1"><a href="/o">',)], "h string")
    assert links.select(sv.listed_links(F.col("h"), "^/n/").alias("u")).first().u == ["/n/1", "/n/2"]
    urls = spark.createDataFrame([("https://x/a/copom-eleva-juros/",), ("https://x/copom/outra",)], "u string")
    assert [r.u for r in sv.relevant_urls(urls, "u", ["copom"], []).collect()] == ["https://x/a/copom-eleva-juros/"]


def test_cut_runs_go_on(spark, tmp_path):
    from folio.operators import procedures as pr

    plan = spark.createDataFrame([(f"a|{i}", "a") for i in range(6)] + [("b|0", "b"), ("b|0", "b")], "unit string, outlet string")
    broken = lambda u: [] if u == "a|1" else [{"u": u}] if u < "a|4" else (_ for _ in ()).throw(ConnectionError("gone"))
    one = {r.outlet: (r.found, r.units) for r in pr.collected(spark, plan, broken, str(tmp_path), "ana", "u string").collect()}
    assert one == {"a": (3, 4)}
    two = {r.outlet: (r.found, r.units) for r in pr.collected(spark, plan, lambda u: [{"u": u}], str(tmp_path), "rui", "u string").collect()}
    assert two == {"a": (2, 2), "b": (1, 1)}
    assert pr.collected(spark, plan, broken, str(tmp_path), "eva", "u string").collect() == []
    lines = spark.read.schema("u string, outlet string, writer string").json(f"{tmp_path}/lines")
    assert sorted((r.u, r.writer) for r in lines.collect()) == [("a|0", "ana"), ("a|2", "ana"), ("a|3", "ana"), ("a|4", "rui"), ("a|5", "rui"), ("b|0", "rui")]


def test_verdicts(spark):
    rng = np.random.default_rng(7)
    n = 90
    c = rng.normal(size=n)
    rows = [(i, float(c[i]), float(0.9 * c[i] + rng.normal(0, 0.4)), float(rng.normal()), float(rng.normal())) for i in range(n)]
    panel = spark.createDataFrame(rows, "t int, c double, good double, noise double, control double")
    con = validation.convergent(panel, "t", ["c"], ["good", "noise"])
    r = validation.convergent_verdict(con, "c", [["good", "noise"]]).first()
    assert r.passed and r.has_good and not validation.convergent_verdict(con, "c", [["good"], ["noise"]]).first().passed
    explained, anchors = validation.discriminant(panel, "t", ["c"], ["good", "noise"], ["control"])
    r = validation.discriminant_verdict(explained, anchors, "c", ["good", "noise"]).first()
    assert r.passed and r.moved == ["good"] and r.r2 < 0.2
    table = spark.createDataFrame([("c", "a", 6, 0.3, 0.01, 0.02), ("c", "b", 6, -1.0, 0.5, 0.5), ("c", "a", 3, -9.0, 0.9, 0.9)], "index string, target string, h int, b double, p double, p_holm double")
    r = validation.predictive_verdict(table, "c", "a").first()
    assert r.passed and r.p_holm == {"a": 0.02, "b": 0.5} and not validation.predictive_verdict(table, "c", "b").first().passed
    found = validation.validated_index(panel.withColumn("y", F.col("good")), "t", "y", "control", ["c"], ["noise"])
    assert found["latent"].count() == n and {x.rival for x in found["encompassing"].collect()} == {"none", "noise"} and found["verdict"].first().n == 2


def test_holidays_from_a_list(spark, tmp_path):
    from folio.operators.calendar import business_calendar

    (tmp_path / "h.csv").write_text("Data,Dia,Nome\n09/07/2024,terca,Local\n09/07/2024,terca,Local\nFonte: x,,\n")
    days = readers.holiday_list(spark, f"{tmp_path}/h.csv")
    assert [r.day for r in days.collect()] == [D(2024, 7, 9)]
    assert not business_calendar(spark, 2024, 2024, days).where("day = '2024-07-09'").first().is_business
