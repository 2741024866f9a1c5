"""Files, work, probes, small relational operators and validation over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates as dt
from ..functions import text
from ..functions.ids import in_holdout
from ..operators import corpus, probe, ranks, sampling, validation, work
from ..operators import index as ix
from ..operators import relations as rl
from ..operators import stats as st
from ..shared import shared_folder
from ..sinks import files as sink
from ..sources import logs, paged, readers
from .index_queries import HASH32, HASH60, ROUTED, _routed
from .tables import DAILY, ITEMS, MONTHLY, daily_value, items, monthly_price, rounded, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _day(c):
    return F.to_date(c)


# Files: each query writes a whole table and reads it back


@query("SELECT event_id, user_id, event_type, round(value, 6) AS value, user_id % 3 AS writer FROM events")
def lines_round_trip(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", "event_type", "value", (F.col("user_id") % 3).alias("writer"))
    path = shared_folder(spark, "lines")
    for half in (0, 1):  # two appends by the same writers
        sink.append_lines(e.where(F.col("event_id") % 2 == half), path, ["event_type", "writer"])
    rows, _ = logs.json_lines(spark, f"{path}/*/*/*.json", "event_id long, user_id long, value double")
    held = spark.read.schema("event_id long, event_type string, writer long").json(path)  # the folders' columns
    return rounded(rows.join(held.select("event_id", "event_type", "writer"), "event_id"))


@query("SELECT event_type, count(*) AS n, count_if(event_id % 10 = 0) AS broken FROM events GROUP BY 1")
def corrupt_lines(spark, sf):
    e = table(spark, sf, "events")
    line = F.to_json(F.struct("event_id", "event_type"))
    path = shared_folder(spark, "corrupt")
    cut = F.when(F.col("event_id") % 10 == 0, F.concat(F.lit("{"), line)).otherwise(line)
    e.select(cut.alias("value")).write.text(path)
    rows, broken = logs.json_lines(spark, path, "event_id long, event_type string")
    kinds = broken.groupBy(F.regexp_extract("value", '"event_type":"([^"]*)"', 1).alias("event_type")).agg(F.count("*").alias("broken"))
    good = rows.groupBy("event_type").agg(F.count("*").alias("good"))
    return good.join(kinds, "event_type", "left").select("event_type", (F.col("good") + F.coalesce("broken", F.lit(0))).alias("n"), F.coalesce("broken", F.lit(0)).alias("broken"))


@query(f"WITH {DAILY} SELECT day, round(value, 4) AS value FROM daily")
def series_round_trip(spark, sf):
    path = shared_folder(spark, "series")
    sink.series_csv(daily_value(spark, sf).select(F.col("day").alias("Data"), F.round("value", 6).alias("VALOR")), path, ["Data"])
    return rounded(readers.day_and_value(spark, path), 4)


@query("SELECT l_orderkey AS chave, l_linenumber AS linha, l_shipdate::DATE AS embarque, round(l_extendedprice, 2) AS preco FROM lineitem")
def delimited_round_trip(spark, sf):
    l = table(spark, sf, "lineitem")
    path = shared_folder(spark, "delimited")
    out = l.select("l_orderkey", "l_linenumber", F.date_format("l_shipdate", "dd/MM/yyyy").alias("Data Base"), dt.number_label(F.col("l_extendedprice")).alias("Preço"))
    out.write.option("header", True).option("sep", ";").csv(path)
    back = readers.delimited(spark, path, rename={"l_orderkey": "chave", "l_linenumber": "linha", "Data Base": "embarque", "Preço": "preco"}, days={"embarque": "dd/MM/yyyy"}, numbers=["preco"])
    return back.select(F.col("chave").cast("long").alias("chave"), F.col("linha").cast("int").alias("linha"), "embarque", F.round("preco", 2).alias("preco"))


@query("SELECT year(o_orderdate) AS y, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def yearly_archives(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.round("o_totalprice", 2).alias("price"), F.year("o_orderdate").alias("y"))
    path = shared_folder(spark, "years")
    o.write.partitionBy("y").option("header", True).option("compression", "gzip").csv(path)
    back = readers.projected(spark, path, ["y", "price"])
    return back.groupBy(F.col("y").cast("long").alias("y")).agg(F.count("*").alias("n"), F.round(F.sum(F.col("price").cast("double")), 2).alias("total"))


@query("SELECT substr(c_mktsegment, 1, 4) || '-' || lpad((row_number() OVER (ORDER BY c_name, c_custkey) - 1)::VARCHAR, 6, '0') AS id, c_name AS title, c_mktsegment AS body, c_custkey AS chave FROM customer")
def consolidated_export(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment")
    path = shared_folder(spark, "export")
    sink.consolidated(c, path, "c_mktsegment", ["c_name", "c_custkey"], {"title": "c_name", "body": "c_mktsegment"})
    lines = readers.by_suffix(spark, f"{path}/jsonl/*.json")
    sheet = spark.read.option("header", True).csv(f"{path}/csv")
    sheet = sheet.select("id", F.col(sheet.columns[0]).cast("long").alias("chave"))
    return lines.join(sheet, "id").select("id", "title", "body", "chave")


@query("SELECT doc_id, lang, md5(text) AS h, 2000 + doc_id % 7 AS year FROM documents")
def corpus_by_year(spark, sf):
    d = table(spark, sf, "documents").withColumn("day", F.make_date((2000 + F.col("doc_id") % 7).cast("int"), F.lit(5), F.lit(1)))
    path = shared_folder(spark, "corpus")
    sink.corpus_parquet(d, path, "day")
    return spark.read.parquet(path).select("doc_id", "lang", F.md5("text").alias("h"), F.col("year").cast("long").alias("year"))


@query(f"WITH {MONTHLY}, m AS (SELECT month, x FROM monthly), y AS (SELECT year(month) AS y, round(avg(x), 6) AS v FROM monthly GROUP BY 1 HAVING y % 2 = 0) SELECT month, v AS value FROM m LEFT JOIN y ON y.y = year(month)")
def yearly_repeated(spark, sf):
    m = monthly_price(spark, sf)
    path = shared_folder(spark, "yearly")
    sink.series_csv(m.groupBy(F.year("month").alias("ano")).agg(F.round(F.avg("x"), 6).alias("valor")).where("ano % 2 = 0"), path, ["ano"])
    return readers.yearly_as_monthly(spark, m.select("month"), path)


@query(f"WITH {MONTHLY}, {DAILY} SELECT month, round(-v, 4) AS spread FROM monthly LEFT JOIN (SELECT date_trunc('month', day)::DATE AS m, avg(round(value, 6)) AS v FROM daily GROUP BY 1) ON m = month")
def market_turned(spark, sf):
    folder = shared_folder(spark, "market")
    sink.series_csv(daily_value(spark, sf).select(F.col("day").alias("data"), F.round("value", 6).alias("valor")), f"{folder}/public/spread.csv", ["data"])
    return rounded(readers.market_series(spark, "spread", monthly_price(spark, sf).select("month"), [f"{folder}/vendor", f"{folder}/public"], turned=True), 4)


@query("SELECT s_suppkey AS id, s_name AS name, s_acctbal AS balance, s_nationkey AS total FROM supplier")
def nested_responses(spark, sf):
    s = table(spark, sf, "supplier")
    body = F.to_json(F.struct(F.struct(F.struct(F.col("s_nationkey").alias("total"), F.array(F.struct(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))).alias("rows")).alias("hits")).alias("answer"), F.array(F.lit(1)).alias("codes")))
    found = readers.response_items(s.select(body.alias("body")), "body").select(F.explode("items").alias("i"), "total")
    return found.select(F.from_json("i", "id long, name string, balance double").alias("r"), "total").select("r.*", "total")


@query("SELECT page_id, '{\"id\": ' || page_id || '}' AS raw, page_id AS id FROM pages")
def embedded_records(spark, sf):
    p = table(spark, sf, "pages")
    raw = F.concat(F.lit('{"id": '), F.col("page_id"), F.lit("}"))
    html = F.concat(F.coalesce("html", F.lit("")), F.lit('<script type="application/json" id="__DATA__">\n'), raw, F.lit("</script>"))
    return p.select("page_id", raw.alias("raw"), readers.embedded_json(html, "__DATA__", "id long")["id"].alias("id"))


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def paged_source(spark, sf):
    rows = [r.asDict() for r in table(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey").orderBy("n_nationkey").collect()]  # a server's answers: 25 rows at any size

    def transport(request):
        found = [r for r in rows if r["n_regionkey"] == request["region"]]
        return found[request["$skip"] : request["$skip"] + request["$top"]]

    source = paged.source_class("folio_nations", "n_nationkey long, n_name string, n_regionkey long", transport, [{"region": k} for k in sorted({r["n_regionkey"] for r in rows})], size=2)
    spark.dataSource.register(source)
    return spark.read.format("folio_nations").load()


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_regionkey = 2")
def paged_pushdown(spark, sf):
    # the filter is what is tested: it goes into the requests
    rows = [r.asDict() for r in table(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey").orderBy("n_nationkey").collect()]

    def transport(request):
        if request.get("n_regionkey") != 2:
            raise ValueError(f"the server was asked for more than region 2: {request}")
        found = [r for r in rows if r["n_regionkey"] == 2]
        return found[request["$skip"] : request["$skip"] + request["$top"]]

    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(paged.source_class("folio_pushed", "n_nationkey long, n_name string, n_regionkey long", transport, [{}], size=3))
    return spark.read.format("folio_pushed").load().where("n_regionkey = 2")


@query("""SELECT DISTINCT trim(t || ' ' || d) AS query FROM (SELECT r_name AS t FROM region), (SELECT '' AS d UNION SELECT DISTINCT c_mktsegment FROM customer)""")
def search_plan(spark, sf):
    terms = [r[0] for r in table(spark, sf, "region").select("r_name").collect()]
    divisors = [r[0] for r in table(spark, sf, "customer").select("c_mktsegment").distinct().collect()]  # five at any size
    return paged.query_plan(spark, terms, divisors).select("query")


# Work: ledgers, retries, budgets, jobs


PLAN = "p AS (SELECT DISTINCT event_type || '|' || ts::DATE AS unit, ts::DATE AS day FROM events)"


def _plan(spark, sf):
    e = table(spark, sf, "events")
    return e.select(work.unit_key(F.col("event_type"), _day("ts")).alias("unit"), _day("ts").alias("day")).distinct()


@query(f"WITH {PLAN} SELECT unit FROM p WHERE day(day) % 3 <> 0")
def unit_ledger(spark, sf):
    plan = _plan(spark, sf)
    path = shared_folder(spark, "ledger")
    for k in (0, 1):  # two writers, each with its own files in one ledger
        sink.append_ledger(plan.where(f"day(day) % 3 = 0 and day(day) % 2 = {k}").select("unit"), path)
    return work.open_units(plan.select("unit").union(plan.select("unit")), spark.read.schema("unit string").json(path))


@query(f"""WITH {PLAN}, s AS (SELECT *, CASE WHEN day(day) % 5 = 0 THEN 'retry' WHEN day(day) % 5 = 1 THEN 'gap' ELSE 'done' END AS state FROM p)
SELECT unit, state, CASE state WHEN 'done' THEN length(unit) END AS n, CASE state WHEN 'retry' THEN 'TimeoutError: slow' WHEN 'gap' THEN 'ValueError: no page' END AS error FROM s""")
def attempted_units(spark, sf):
    def fetch(unit):
        k = int(unit[-2:]) % 5
        if k == 0:
            raise TimeoutError("slow")
        if k == 1:
            raise ValueError("no page")
        return len(unit)

    return work.attempted(_plan(spark, sf), fetch)


@query("""WITH c AS (SELECT event_type, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-10' GROUP BY 1), s AS (SELECT coalesce(sum(n * CASE event_type WHEN 'click' THEN 0.0011 WHEN 'purchase' THEN 0.002 ELSE 0 END), 0)::DOUBLE AS spent FROM c)
SELECT round(spent, 6) AS spent, 11.0::DOUBLE AS next, spent + 11 <= 15 AS fits FROM s""")
def budget_gate(spark, sf):
    calls = table(spark, sf, "events").select(F.col("event_type").alias("provider"), F.col("ts").alias("at"))
    return rounded(work.within_budget(calls, {"click": 0.0011, "purchase": 0.002}, 10_000, "click", 15.0, F.to_timestamp_ntz(F.lit("2024-01-10 00:00:00"))))


@query("""WITH r AS (SELECT event_id, event_type, ts, epoch_us(ts) / 1e6 AS t, row_number() OVER (PARTITION BY event_type, ts::DATE ORDER BY ts, event_id) - 1 AS k FROM events)
SELECT event_type, ts::DATE AS day, count_if(k < 40) AS admitted, count(*) AS n FROM r GROUP BY ALL""")
def daily_limit(spark, sf):
    e = table(spark, sf, "events").select("event_type", "ts")
    return work.admitted(e, "ts", "event_type", 2, 40).groupBy("event_type", _day("ts").alias("day")).agg(F.count_if("admitted").alias("admitted"), F.count("*").alias("n"))


@query("""WITH j AS (SELECT o_custkey AS item, o_orderkey % 97 AS job FROM orders), s AS (SELECT DISTINCT job, CASE job % 4 WHEN 0 THEN 'sent' WHEN 1 THEN 'failed' ELSE 'collected' END AS state FROM j),
t AS (SELECT item, count_if(state = 'sent') AS u, count_if(state <> 'sent') AS k FROM j JOIN s USING (job) GROUP BY 1)
SELECT c_custkey AS item FROM customer LEFT JOIN t ON item = c_custkey WHERE c_acctbal >= 0 AND coalesce(u, 0) = 0 AND coalesce(k, 0) < 2""")
def jobs_to_send(spark, sf):
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders")
    job_items = o.select(F.col("o_custkey").alias("item"), (F.col("o_orderkey") % 97).alias("job"))
    jobs = job_items.select("job").distinct()
    log = jobs.select("job", F.lit(1).alias("at"), F.lit("sent").alias("state")).union(jobs.where("job % 4 <> 0").select("job", F.lit(2), F.when(F.col("job") % 4 == 1, "failed").otherwise("collected")))
    scored = c.where("c_acctbal < 0").select(F.col("c_custkey").alias("item"))
    return work.to_send(c.select(F.col("c_custkey").alias("item")), scored, job_items, log, "item")


@query("SELECT job, count(*) AS n, min(c_custkey) AS first_key, max(c_custkey) AS last_key FROM (SELECT c_custkey, 'run-' || ((row_number() OVER (ORDER BY c_custkey) - 1) // 300) AS job FROM customer) GROUP BY job")
def items_into_jobs(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey")
    return work.into_jobs(c, "c_custkey", 300, "run").groupBy("job").agg(F.count("*").alias("n"), F.min("c_custkey").alias("first_key"), F.max("c_custkey").alias("last_key"))


# Probes


@query("""WITH r AS (SELECT o_orderkey, o_orderdate::DATE AS day, row_number() OVER (ORDER BY o_orderkey) - 1 AS k FROM orders),
c AS (SELECT *, CASE WHEN k % 2 = 0 THEN day + INTERVAL 60 MONTH ELSE day - INTERVAL 60 MONTH END AS one, CASE WHEN k % 2 = 0 THEN day - INTERVAL 60 MONTH ELSE day + INTERVAL 60 MONTH END AS two FROM r)
SELECT o_orderkey, (CASE WHEN one BETWEEN DATE '1999-07-01' AND DATE '2004-12-02' THEN one WHEN two BETWEEN DATE '1999-07-01' AND DATE '2004-12-02' THEN two ELSE least(greatest(two, DATE '1999-07-01'), DATE '2004-12-02') END)::DATE AS false_day FROM c""")
def false_dates(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", _day("o_orderdate").alias("day"))
    return probe.with_false_dates(o, "day", ["o_orderkey"], F.to_date(F.lit("2005-01-01"))).select("o_orderkey", "false_day")


EPISODES = [("first", "1995-01-01", "1996-06-30"), ("middle", "1997-01-01", "1998-12-31"), ("last", "2000-01-01", "2001-12-31")]
GUESSES = """g AS (SELECT 'L' || (o_orderkey % 5 + 1) AS level, o_orderdate::DATE AS day, CASE WHEN o_custkey % 10 <> 0 THEN year(o_orderdate) + (o_custkey % 7 - 3) * (o_orderkey % 5) END AS guess FROM orders),
e AS (SELECT *, CASE WHEN day BETWEEN DATE '1995-01-01' AND DATE '1996-06-30' THEN 1 WHEN day BETWEEN DATE '1997-01-01' AND DATE '1998-12-31' THEN 2 WHEN day BETWEEN DATE '2000-01-01' AND DATE '2001-12-31' THEN 3 END AS r,
  CASE WHEN guess BETWEEN 1995 AND 1995 THEN 1 WHEN guess BETWEEN 1997 AND 1998 THEN 2 WHEN guess BETWEEN 2000 AND 2001 THEN 3 END AS s FROM g),
pr AS (SELECT level, count(guess) AS n, avg(abs(guess - year(day))) AS mean_error, avg((r = s)::INT) AS accuracy FROM e WHERE guess IS NOT NULL GROUP BY 1),
b AS (SELECT *, 1 / 3.0::DOUBLE AS by_chance, mean_error >= 4 AND (accuracy IS NULL OR accuracy <= 0.25) AS blind FROM pr)"""


def _guesses(spark, sf):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    guess = F.when(c % 10 != 0, F.year("o_orderdate") + (c % 7 - 3) * (k % 5))
    return table(spark, sf, "orders").select(F.concat(F.lit("L"), k % 5 + 1).alias("level"), _day("o_orderdate").alias("day"), guess.alias("guess"))


# a guess of 1996 stands for July 1996, after the first episode's end
@query(f"WITH {GUESSES} SELECT level, n, round(mean_error, 6) AS mean_error, round(accuracy, 6) AS accuracy, round(by_chance, 6) AS by_chance, blind FROM b")
def year_probe(spark, sf):
    return rounded(probe.year_probe(_guesses(spark, sf), EPISODES))


@query(f"WITH {GUESSES} SELECT min(level) FILTER (blind) AS lowest_blind FROM b")
def lowest_blind_level(spark, sf):
    return probe.lowest_blind_level(probe.year_probe(_guesses(spark, sf), EPISODES))


DIMS = "d AS (SELECT o_orderstatus AS who, substr(o_orderpriority, 1, 1)::INT AS d1, (o_custkey % 5 + 1)::INT AS d2, ((o_custkey + substr(o_orderpriority, 1, 1)::INT) % 5 + 1)::INT AS d3 FROM orders)"
RHO = """
pairs AS (SELECT who, 'd1' AS first, 'd2' AS second, d1 AS x, d2 AS y FROM d UNION ALL SELECT who, 'd1', 'd3', d1, d3 FROM d UNION ALL SELECT who, 'd2', 'd3', d2, d3 FROM d),
ranks AS (SELECT who, first, second, rank() OVER (PARTITION BY who, first, second ORDER BY x) + (count(*) OVER (PARTITION BY who, first, second, x) - 1) / 2.0::DOUBLE AS a, rank() OVER (PARTITION BY who, first, second ORDER BY y) + (count(*) OVER (PARTITION BY who, first, second, y) - 1) / 2.0::DOUBLE AS b FROM pairs),
rho AS (SELECT who, first, second, count(*) AS n, corr(a, b) AS rho FROM ranks GROUP BY ALL)"""


def _dims(spark, sf):
    p = F.substring("o_orderpriority", 1, 1).cast("int")
    return table(spark, sf, "orders").select(F.col("o_orderstatus").alias("who"), p.alias("d1"), (F.col("o_custkey") % 5 + 1).cast("int").alias("d2"), ((F.col("o_custkey") + p) % 5 + 1).cast("int").alias("d3"))


@query(f"WITH {DIMS}, {RHO} SELECT who, first, second, n, round(rho, 6) AS rho FROM rho")
def rank_correlation_matrix(spark, sf):
    return rounded(probe.rank_correlations(_dims(spark, sf), ["d1", "d2", "d3"], ["who"]))


@query(f"WITH {DIMS}, {RHO} SELECT a.first, a.second, round(a.rho, 6) AS rho_model, round(b.rho, 6) AS rho_people, coalesce(a.rho > b.rho + 0.01, false) AS alert FROM rho a JOIN rho b USING (first, second) WHERE a.who = 'O' AND b.who = 'F'")
def halo_alerts(spark, sf):
    r = probe.rank_correlations(_dims(spark, sf), ["d1", "d2", "d3"], ["who"])
    return rounded(probe.halo(r.where("who = 'O'"), r.where("who = 'F'"), 0.01))


FITS = "t AS (SELECT c_mktsegment AS variant, CASE WHEN c_nationkey % 5 = 0 THEN 'none' ELSE 'rival' || c_nationkey % 5 END AS rival, avg(c_acctbal) / 1000 - 4 AS b1, (sum(c_custkey) % 100)::DOUBLE / 1000 AS p_b1 FROM customer GROUP BY ALL)"


def _fits(spark, sf):
    rival = F.when(F.col("c_nationkey") % 5 == 0, "none").otherwise(F.concat(F.lit("rival"), F.col("c_nationkey") % 5))
    return table(spark, sf, "customer").groupBy(F.col("c_mktsegment").alias("variant"), rival.alias("rival")).agg((F.avg("c_acctbal") / 1000 - 4).alias("b1"), ((F.sum("c_custkey") % 100).cast("double") / 1000).alias("p_b1"))


@query(f"""WITH {FITS} SELECT variant, count(*) AS n, bool_and(p_b1 < 0.05) FILTER (rival = 'none') AS significant_alone, count_if(rival <> 'none') AS n_rivals, count_if(rival <> 'none' AND p_b1 < 0.05) AS n_survived,
  bool_and(p_b1 < 0.05) FILTER (rival <> 'none') AS survives_all, min(sign(b1)) = max(sign(b1)) AS same_sign, round(min(b1), 6) AS least, round(max(b1), 6) AS most FROM t GROUP BY variant""")
def survival_table(spark, sf):
    return rounded(probe.survival(_fits(spark, sf)))


@query(f"WITH {FITS} SELECT a.rival, round(a.b1, 6) AS b_first, round(a.p_b1, 6) AS p_first, round(b.b1, 6) AS b_second, round(b.p_b1, 6) AS p_second, (a.p_b1 < 0.05) = (b.p_b1 < 0.05) AND sign(a.b1) = sign(b.b1) AS same FROM t a JOIN t b USING (rival) WHERE a.variant = 'BUILDING' AND b.variant = 'MACHINERY'")
def conclusions_by_variant(spark, sf):
    return rounded(probe.same_conclusions(_fits(spark, sf), "BUILDING", "MACHINERY"))


# Relations


BASE = "base AS (SELECT o_orderkey AS item, substr(o_orderpriority, 1, 1)::INT AS d1, (o_custkey % 5 + 1)::INT AS d2 FROM orders WHERE o_orderkey % 3 <> 1), alt AS (SELECT o_orderkey AS item, (o_custkey % 5 + 1)::INT AS d1, CASE WHEN o_orderkey % 7 > 0 THEN (o_custkey % 5 + 1)::INT END AS d2 FROM orders WHERE o_orderkey % 3 <> 2)"


@query(f"""WITH {BASE}, c AS (SELECT unnest([{{'value': 'd1', 'c': alt.d1 - base.d1}}, {{'value': 'd2', 'c': alt.d2 - base.d2}}], recursive := true) FROM base JOIN alt USING (item))
SELECT value, count(c) AS n, round(avg(c), 6) AS mean_change, round(avg(abs(c)), 6) AS mean_abs_change, round(avg((c <> 0)::INT), 6) AS share_changed FROM c WHERE c IS NOT NULL GROUP BY value""")
def variant_change_summary(spark, sf):
    # two variants that have scored different items of all orders
    p, c, k = F.substring("o_orderpriority", 1, 1).cast("int"), (F.col("o_custkey") % 5 + 1).cast("int"), F.col("o_orderkey")
    o = table(spark, sf, "orders")
    base = o.where(k % 3 != 1).select(k.alias("item"), p.alias("d1"), c.alias("d2"))
    alt = o.where(k % 3 != 2).select(k.alias("item"), c.alias("d1"), F.when(k % 7 > 0, c).alias("d2"))
    return rounded(rl.change_summary(rl.variant_changes(base, alt, "item", ["d1", "d2"]), ["d1", "d2"]))


@query(f"WITH {MONTHLY}, {DAILY}, l AS (SELECT date_trunc('month', l_shipdate)::DATE AS month, sum(l_quantity) AS x FROM lineitem GROUP BY 1) SELECT month, round(monthly.x, 6) AS x, round(l.x, 4) AS x_right, d.n AS n FROM monthly LEFT JOIN l USING (month) LEFT JOIN (SELECT date_trunc('month', day)::DATE AS month, sum(n)::BIGINT AS n FROM daily GROUP BY 1) d USING (month)")
def panel_with_series(spark, sf):
    m = monthly_price(spark, sf)
    l = table(spark, sf, "lineitem").groupBy(_day(F.trunc("l_shipdate", "MONTH")).alias("month")).agg(F.sum("l_quantity").alias("x"))
    d = daily_value(spark, sf).groupBy(F.trunc("day", "MONTH").alias("month")).agg(F.sum("n").alias("n"))
    out = rl.with_series(m, {"shipped": l, "events": d}, "month")
    return out.select("month", F.round("x", 6).alias("x"), F.round("x_right", 4).alias("x_right"), "n")


@query(f"WITH {ROUTED} SELECT c.c_custkey AS item_id, coalesce(any_value(r.decision), 'labelled') AS decision FROM customer c LEFT JOIN routed r ON r.item_id = c.c_custkey GROUP BY 1")
def decisions_with_default(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("item_id"))
    return corpus.labelled_by(c, _routed(spark, sf).select("item_id", "decision"), "item_id").select("item_id", "decision")


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING n >= 12")
def frequent_units(spark, sf):
    return rl.groups_of_at_least(table(spark, sf, "orders"), ["o_custkey"], 12)


@query("SELECT o_custkey, arg_min(o_orderstatus, o_orderkey) AS first, round(avg(o_totalprice), 4) AS mean, count(*) AS size FROM orders GROUP BY 1")
def first_mean_size(spark, sf):
    return rounded(rl.first_mean_size(table(spark, sf, "orders"), ["o_custkey"], "o_orderkey", "o_orderstatus", "o_totalprice"), 4)


@query("SELECT p_brand, " + ", ".join(f'round(avg(p_retailprice) FILTER (p_size % 4 = {k}), 4) AS "{k}"' for k in range(4)) + " FROM part GROUP BY 1")
def pivoted_means(spark, sf):
    return rounded(rl.pivot_mean(table(spark, sf, "part").withColumn("era", F.col("p_size") % 4), "p_brand", "era", list(range(4)), "p_retailprice"), 4)


@query("SELECT * FROM (SELECT 'text' AS \"column\", count(text) / count(*) AS share FROM documents UNION ALL SELECT 'lang', count(lang) / count(*) FROM documents UNION ALL SELECT 'short', count(CASE WHEN n_chars < 2000 THEN 1 END) / count(*) FROM documents)")
def column_coverage(spark, sf):
    d = table(spark, sf, "documents").withColumn("short", F.when(F.col("n_chars") < 2000, 1))
    return rl.column_coverage(d, ["text", "lang", "short"])


@query("SELECT event_type, sum(value::BIGINT)::BIGINT AS found, count(*) AS units FROM (SELECT event_type, floor(value)::BIGINT AS value FROM events) GROUP BY 1")
def run_summary(spark, sf):
    return rl.run_summary(table(spark, sf, "events").withColumn("v", F.floor("value")), "event_type", "v")


@query(f"WITH {ITEMS}, m AS (SELECT outlet, date_trunc('month', day) AS m, count(*) AS n FROM items GROUP BY ALL), a AS (SELECT datediff('month', min(m), max(m)) + 1 AS months FROM m) SELECT outlet, months, months - count(*) AS empty, sum(n)::BIGINT AS n FROM m, a GROUP BY outlet, months")
def empty_months(spark, sf):
    return rl.monthly_coverage(items(spark, sf), "outlet", "day")


@query(f"WITH {ITEMS} SELECT outlet, year(day) AS year, count(d1) AS complete, round(count(d1) / count(*), 6) AS share, count(*) AS n FROM items GROUP BY ALL")
def yearly_completeness(spark, sf):
    return rounded(rl.yearly_completeness(items(spark, sf), "outlet", "day", F.col("d1").isNotNull()))


@query("SELECT c_mktsegment AS kind, count(*) AS n, 'allowed' AS list FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') GROUP BY 1 UNION ALL SELECT c_mktsegment, count(*), 'excluded' FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY') GROUP BY 1")
def allow_list(spark, sf):
    kept, report = rl.allowed(table(spark, sf, "customer"), "c_mktsegment", ["BUILDING", "MACHINERY"])
    return kept.groupBy(F.col("c_mktsegment").alias("kind")).agg(F.count("*").alias("n")).withColumn("list", F.lit("allowed")).union(report.select("c_mktsegment", "n", F.lit("excluded")))


@query("SELECT p_partkey FROM part WHERE CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_brand END IS NULL OR p_brand = 'Brand#1'")
def of_species(spark, sf):
    p = table(spark, sf, "part").withColumn("species", F.when(F.col("p_size") % 3 != 0, F.col("p_brand")))
    return rl.of_species(p, "species", ["Brand#1"]).select("p_partkey")


@query(f"SELECT doc_id FROM documents WHERE {HASH32.format('doc_id::VARCHAR')} >= 0.10 AND doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)")
def without_holdout(spark, sf):
    return rl.without_holdout(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels").where("quality = 0"), "doc_id")


@query(f"WITH {DAILY}, f AS (SELECT day, CASE WHEN n % 3 > 0 THEN value END AS v, date_trunc('month', day) AS m FROM daily) SELECT day, round(last_value(v IGNORE NULLS) OVER (PARTITION BY m ORDER BY day), 6) AS v FROM f")
def filled_forward(spark, sf):
    d = daily_value(spark, sf).select("day", F.when(F.col("n") % 3 > 0, F.col("value")).alias("v"), F.trunc("day", "MONTH").alias("m"))
    return rounded(rl.filled_forward(d, ["m"], "day", "v").drop("m"))


@query("SELECT o_custkey, arg_min(o_totalprice, o_orderkey) AS first, arg_max(o_totalprice, o_orderkey) AS last FROM orders WHERE o_orderstatus = 'F' GROUP BY 1")
def ends_of_series(spark, sf):
    return rl.ends_of(table(spark, sf, "orders").where("o_orderstatus = 'F'"), "o_orderkey", "o_totalprice", ["o_custkey"])


@query("SELECT o_custkey, count(DISTINCT o_orderstatus) = 3 AS has_all, array_to_string(list_distinct(list(o_orderstatus)), '') <> '' AS some, count(DISTINCT o_orderstatus) AS n FROM orders GROUP BY 1")
def subset_tests(spark, sf):
    s = table(spark, sf, "orders").groupBy("o_custkey").agg(F.collect_list("o_orderstatus").alias("s"))
    return s.select("o_custkey", rl.has_all(F.col("s"), ["F", "O", "P"]).alias("has_all"), (F.array_join(rl.unique_in_order(F.col("s")), "") != "").alias("some"), F.size(rl.unique_in_order(F.col("s"))).cast("long").alias("n"))


@query(f"WITH {MONTHLY}, g AS (SELECT month, x / 25 AS e, CASE WHEN month(month) <> 6 THEN 9.5 END AS t FROM monthly) SELECT month, round(e - t, 6) AS gap, round(t - e, 6) AS gap_turned, (e > t + 0.3)::INT::DOUBLE AS above_band, (e < t - 0.3)::INT::DOUBLE AS below_band FROM g")
def gaps_and_flags(spark, sf):
    m = monthly_price(spark, sf).select("month", (F.col("x") / 25).alias("e"), F.when(F.month("month") != 6, 9.5).alias("t"), F.lit(0.3).alias("b"))
    return rounded(rl.gaps_and_flags(m, "e", "t", "b").drop("e", "t", "b"))


@query("SELECT p_brand, round(avg(p_retailprice) FILTER (p_size = 10) - avg(p_retailprice) FILTER (p_size = 2), 4) AS slope_2_10, round(avg(p_retailprice) FILTER (p_size = 5) - avg(p_retailprice) FILTER (p_size = 1), 4) AS slope_1_5 FROM part GROUP BY 1")
def curve_slopes(spark, sf):
    c = table(spark, sf, "part").groupBy("p_brand", "p_size").agg(F.avg("p_retailprice").alias("v"))
    return rounded(rl.slopes(c, ["p_brand"], "p_size", "v", [(2, 10), (1, 5)]), 4)


@query("SELECT p_partkey, p_size / 10.0 AS years, CASE WHEN p_retailprice > 1200 THEN p_retailprice - 1200 END AS rate FROM part WHERE p_size / 10.0 >= 0.5")
def curve_points(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", (F.col("p_size") / 10.0).alias("years"), (F.col("p_retailprice") - 1200).alias("rate"))
    return rl.curve_points(p, "years", "rate")


BANDS = f"""WITH {MONTHLY}, o AS (SELECT month, abs(x - 140) > 4 AS out FROM monthly), g AS (SELECT *, sum((NOT out)::INT) OVER (ORDER BY month) AS k FROM o),
r AS (SELECT *, sum(out::INT) OVER (PARTITION BY k ORDER BY month) AS run FROM g)
SELECT year(month) AS year, NOT arg_max(out, month) AS met, sum(out::INT)::BIGINT AS outside, max(run)::BIGINT AS longest, max(run) >= 3 AS broken FROM r GROUP BY 1"""


@query(BANDS)
def band_years(spark, sf):
    m = monthly_price(spark, sf).select("month", "x", F.lit(140.0).alias("t"), F.lit(4.0).alias("b"))
    return rl.band_years(m, "month", "x", "t", "b", 3)


@query(f"WITH {MONTHLY}, f AS (SELECT min(month) AS a FROM monthly) SELECT month, least(3, datediff('month', a, month) + 1) AS months, (month + INTERVAL 2 MONTH)::DATE AS later, (year(month) * 4 + quarter(month) - 1)::INT AS quarter, (month + INTERVAL 14 DAY)::DATE AS middle FROM monthly, f")
def window_months(spark, sf):
    m = monthly_price(spark, sf).select("month")
    c = F.col("month")
    first = m.agg(F.min("month").alias("a"))
    return m.crossJoin(F.broadcast(first)).select("month", dt.months_in_window(c, F.col("a"), 3).alias("months"), dt.period_from(c, 2).alias("later"), dt.period_number(c, "QUARTER").alias("quarter"), dt.midpoint(c).alias("middle"))


@query("SELECT o_orderkey, greatest(make_date(y, 1, 1), a) AS first, least(make_date(y + 1, 1, 1), b) AS \"end\", make_date(y, 1, 1) >= a AND make_date(y + 1, 1, 1) <= b AS whole FROM (SELECT o_orderkey, (year(o_orderdate) + o_orderkey % 3 - 1)::INT AS y, (o_orderdate::DATE - 500) AS a, (o_orderdate::DATE + 500) AS b FROM orders)")
def year_slices(spark, sf):
    d = _day("o_orderdate")
    year = (F.year("o_orderdate") + F.col("o_orderkey") % 3 - 1).cast("int")
    return table(spark, sf, "orders").select("o_orderkey", dt.year_slice(year, F.date_sub(d, 500), F.date_add(d, 500)).alias("s")).select("o_orderkey", "s.*")


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN ts - INTERVAL 3 HOUR WHEN 1 THEN ts WHEN 2 THEN ts - INTERVAL 5 HOUR END AS at FROM events")
def local_times(spark, sf):
    # as written by servers in UTC, in local time without an offset, and two hours east of UTC
    k = F.col("event_id") % 3
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    written = F.when(k == 0, F.concat(iso, F.lit("Z"))).when(k == 1, iso).otherwise(F.concat(iso, F.lit("+02:00")))
    return table(spark, sf, "events").select("event_id", dt.local_time(written).alias("at"))


@query("SELECT page_id, 'q=' || replace(url_encode(url), '+', '%20') || '&n=' || page_id || '&f=a%20b' AS query FROM pages")
def query_strings(spark, sf):
    return table(spark, sf, "pages").select("page_id", dt.query_string(q=F.col("url"), none=F.lit(None).cast("string"), n=F.col("page_id"), f=F.lit("a b")).alias("query"))


@query("SELECT l_orderkey, l_linenumber, translate(format('{:,.2f}', l_extendedprice), ',.', '.,') AS label FROM lineitem")
def number_labels(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", dt.number_label(F.col("l_extendedprice")).alias("label"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 2 END AS n FROM documents")
def without_repeated_lead(spark, sf):
    t = F.coalesce("text", F.lit(""))
    lead = F.concat(F.lit("É Início comum de um texto, "), F.substring(F.md5(t), 1, 8), F.lit(" mais de oitenta caracteres para que o prefixo conte inteiro aqui."))
    first = F.when(F.col("doc_id") % 2 == 0, F.concat(F.upper(lead), F.lit(" Segue."))).otherwise(F.concat(F.lit("Outro "), lead))
    return table(spark, sf, "documents").select("doc_id", F.size(text.without_repeated_lead(F.array(first, F.lit("Segundo.")), lead)).alias("n"))


@query(f"""
WITH {DAILY}, m AS (SELECT day, value AS x, n::DOUBLE AS y FROM daily), f AS (SELECT count(*) AS n, corr(x, y) AS r FROM m)
SELECT n, round(r, 6) AS r, round(r * sqrt(n - 2) / sqrt(1 - r * r), 4) AS t FROM f""")
def outcome_leak(spark, sf):
    d = daily_value(spark, sf).withColumn("n", F.col("n").cast("double"))
    found = probe.outcome_leak(d, "value", "n")
    return found.select("n", F.round("r", 6).alias("r"), F.round("t", 4).alias("t"))


# Production


@query(f"""WITH {ROUTED}, h AS (SELECT *, {HASH32.format('item_id::VARCHAR')} < 0.10 AS held, item_id % 11 = 0 AS lab FROM routed),
r AS (SELECT *, CASE WHEN lab THEN 'labelled' ELSE decision END AS d, price > 1000 AS answered FROM h WHERE NOT held),
a AS (SELECT *, (d = 'labelled' OR (d IN ('sent', 'audited') AND answered)) AS api FROM r),
t AS (SELECT (SELECT count(*) FROM h) AS corpus, (SELECT count_if(held) FROM h) AS held_out, count(*) AS production, count_if(d = 'labelled') AS labelled, count_if(d = 'sent') AS sent, count_if(d IN ('discarded', 'audited')) AS below, count_if(d = 'audited') AS audited,
  count_if(d = 'discarded') AS not_sent, count_if(api AND d1 IS NULL) AS without_signal, count_if(api AND d1 IS NOT NULL) AS with_signal, count_if(d IN ('sent', 'audited') AND NOT answered) AS missing,
  avg((d1 IS NOT NULL)::INT) FILTER (api AND d = 'audited') AS audit_rate FROM a)
SELECT *  REPLACE (round(audit_rate, 6) AS audit_rate), round(not_sent / production, 6) AS share_not_sent, round(audit_rate * not_sent, 6) AS lost_signal, round(audit_rate * not_sent / (audit_rate * not_sent + with_signal), 6) AS share_lost, 0.4::DOUBLE AS threshold FROM t""")
def production_counts(spark, sf):
    i = _routed(spark, sf).withColumn("held", in_holdout(F.col("item_id")))
    i = i.withColumn("decision", F.when(F.col("item_id") % 11 == 0, "labelled").otherwise(F.col("decision")))
    return rounded(ix.production_counts(i, "held", F.col("price") > 1000, 0.4))


@query(f"""WITH {ITEMS}, y AS (SELECT o_orderkey AS k, year(o_orderdate) AS y FROM orders), q AS (SELECT y, greatest(1, round(50 * count(*) / (SELECT count(*) FROM y)))::INT AS quota FROM y GROUP BY y),
s AS (SELECT k, y FROM (SELECT *, row_number() OVER (PARTITION BY y ORDER BY sha256('s9' || k), k) AS rn FROM y) JOIN q USING (y) WHERE rn <= quota) SELECT k, y FROM s ORDER BY sha256('s9' || k), k LIMIT 50""")
def sample_up_to(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.year("o_orderdate").alias("y"))
    return sampling.proportional_up_to(o, "y", "k", 50, "s9")


@query("SELECT 'ana' AS who, doc_id, lang, '' AS d1, row_number() OVER (ORDER BY sha256('ana' || doc_id), doc_id) AS place FROM documents UNION ALL SELECT 'rui', doc_id, lang, '', row_number() OVER (ORDER BY sha256('rui' || doc_id), doc_id) FROM documents")
def annotation_sheets(spark, sf):
    d, out = table(spark, sf, "documents").select("doc_id", "lang", "source"), None
    for who, sheet in sampling.annotation_sheets(d, "doc_id", ["source"], ["d1"], ["ana", "rui"]).items():
        path = shared_folder(spark, f"sheet-{who}")
        ranks.with_row_number(sheet.withColumn("o__", sampling.rank_key(F.col("doc_id"), who)), ["o__", "doc_id"], "place").drop("o__").write.option("header", True).csv(path)
        back = spark.read.option("header", True).csv(path).select(F.lit(who).alias("who"), F.col("doc_id").cast("long").alias("doc_id"), "lang", F.coalesce("d1", F.lit("")).alias("d1"), (F.col("place").cast("long") + 1).alias("place"))
        out = back if out is None else out.union(back)
    return out


# Validation


def _panel(spark, sf):
    """Monthly: mean prices by status as index variants, rivals from lines and events' users, a short rival."""
    o = table(spark, sf, "orders").withColumn("month", _day(F.trunc("o_orderdate", "MONTH")))
    price = lambda c: F.avg(F.when(c, F.col("o_totalprice"))) / 1000
    a = o.groupBy("month").agg(price(F.lit(True)).alias("x"), price(F.col("o_orderstatus") == "F").alias("vmax"), price(F.col("o_orderstatus") == "O").alias("vmin"))
    l = table(spark, sf, "lineitem").groupBy(_day(F.trunc("l_shipdate", "MONTH")).alias("month")).agg(F.avg("l_quantity").alias("quantity"), F.avg("l_discount").alias("discount"))
    return rl.with_series(a, {"lines": l}, "month").withColumn("short", F.when(F.col("month") >= "1999-01-01", F.col("quantity") - F.col("discount")))


PANEL = """a AS (SELECT date_trunc('month', o_orderdate)::DATE AS month, avg(o_totalprice) / 1000 AS x, avg(o_totalprice) FILTER (o_orderstatus = 'F') / 1000 AS vmax, avg(o_totalprice) FILTER (o_orderstatus = 'O') / 1000 AS vmin FROM orders GROUP BY 1)"""


@query(f"""WITH {PANEL}, s AS (SELECT 'vmax' AS index, x, vmax AS c FROM a UNION ALL SELECT 'vmin', x, vmin FROM a) SELECT index, 'x' AS target, count(*) AS n, round(corr(x, c), 6) AS corr FROM s WHERE c IS NOT NULL GROUP BY index""")
def convergent_correlations(spark, sf):
    return rounded(validation.convergent(_panel(spark, sf), "month", ["vmax", "vmin"], ["x"]).drop("p"))


@query()
def encompassing_grid(spark, sf):
    return rounded(validation.encompassing(_panel(spark, sf), "month", "x", ["vmax", "vmin"], ["quantity", "discount", "short"]))


@query()
def encompassing_verdict(spark, sf):
    return rounded(probe.survival(validation.encompassing(_panel(spark, sf), "month", "x", ["vmax", "vmin"], ["quantity", "discount", "short"])))


@query()
def predictive_table(spark, sf):
    return rounded(validation.predictive(_panel(spark, sf), "month", ["vmax"], ["x", "quantity"], [1, 3, 6], "discount"))


@query(f"""WITH {DAILY}, ev AS (SELECT day, (day - DATE '2024-01-01') % 11 - 5 AS s FROM daily),
c AS (SELECT ev.day, s, sum(n) FILTER (d.day < ev.day) AS nb, sum(n) FILTER (d.day > ev.day) AS na, sum(value) FILTER (d.day > ev.day) / sum(n) FILTER (d.day > ev.day) - sum(value) FILTER (d.day < ev.day) / sum(n) FILTER (d.day < ev.day) AS y FROM ev JOIN daily d ON d.day BETWEEN ev.day - 7 AND ev.day + 7 GROUP BY ALL),
k AS (SELECT y, s::DOUBLE AS s FROM c WHERE nb >= 3 AND na >= 3), p AS (SELECT 'surprise' AS regressor, y, s AS x FROM k UNION ALL SELECT 'size', y, abs(s) FROM k),
f AS (SELECT regressor, count(*) AS n, avg(x) AS mx, avg(y) AS my, regr_slope(y, x) AS b, regr_sxx(y, x) AS sxx FROM p GROUP BY 1)
SELECT regressor, n, round(10 * b, 6) AS b, round(10 * sqrt(sum((x - mx) ** 2 * (y - my - b * (x - mx)) ** 2) * n / (n - 2)) / sxx, 6) AS se, round(my - b * mx, 6) AS const FROM p JOIN f USING (regressor) GROUP BY regressor, n, mx, my, b, sxx""")
def event_study(spark, sf):
    d = daily_value(spark, sf)
    ev = d.select("day", (F.datediff("day", F.lit("2024-01-01")) % 11 - 5).alias("s"))
    return rounded(validation.event_study(ev, d, "s").drop("p"))


@query(f"""WITH {DAILY}, r AS (SELECT day, value / n AS v FROM daily) SELECT e.day, round(100 * (arg_min(r.v, r.day) FILTER (r.day > e.day) - arg_max(r.v, r.day) FILTER (r.day < e.day)), 6) AS surprise FROM daily e JOIN r ON r.day BETWEEN e.day - 7 AND e.day + 8 GROUP BY e.day""")
def rate_surprises(spark, sf):
    d = daily_value(spark, sf)
    return rounded(validation.rate_surprises(d.select("day"), d.select("day", (F.col("value") / F.col("n")).alias("value"))))


@query("""WITH c AS (SELECT l_returnflag, l_quantity AS x, l_extendedprice AS y FROM lineitem), f AS (SELECT l_returnflag, count(*) AS n, corr(x, y) AS r FROM c GROUP BY 1)
SELECT l_returnflag, n, round(tanh(atanh(r) - 1.959963984540054 / sqrt(n - 3)), 6) AS low, round(tanh(atanh(r) + 1.959963984540054 / sqrt(n - 3)), 6) AS high FROM f""")
def correlation_intervals(spark, sf):
    from ..functions.formulas import fisher_z_interval

    c = st.correlations(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice", ["l_returnflag"])
    return rounded(c.select("l_returnflag", "n", fisher_z_interval(F.col("r"), F.col("n")).alias("i")).select("l_returnflag", "n", "i.*"))


# Text, answers and formulas


@query("""SELECT page_id, regexp_matches(regexp_replace(url, '^.*/', ''), '1|doc') OR list_has_any(string_split(regexp_replace(url, '^.*/', ''), '-'), ['page', 'post']) AS relevant FROM pages""")
def slug_relevance(spark, sf):
    slug = F.regexp_replace("url", "^.*/", "")
    return table(spark, sf, "pages").select("page_id", text.slug_relevant(slug, ["1", "doc"], ["page", "post"]).alias("relevant"))


@query("""SELECT l_orderkey, l_linenumber, CASE l_orderkey % 6 WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN true ELSE false END AS flag FROM lineitem""")
def truthy_flags(spark, sf):
    said = F.element_at(F.array(*(F.lit(x) for x in (" Sim ", "TRUE", "x", "não", "0")), F.lit(None)), (F.col("l_orderkey") % 6 + 1).cast("int"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", text.truthy(said).alias("flag"))


@query(r"""SELECT doc_id, md5(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS h FROM documents""")
def clean_bodies(spark, sf):
    with_credit = F.concat(F.lit("Agência X - \nFOTO: alguém\n"), F.col("text"), F.lit("\n  crédito : outro"))
    return table(spark, sf, "documents").select("doc_id", F.md5(text.clean_body(text.without_prefix(with_credit, r"ag[êe]ncia x\s*-\s*"))).alias("h"))


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN year(o_orderdate) WHEN 1 THEN year(o_orderdate) WHEN 2 THEN NULL ELSE NULL END AS y FROM orders""")
def guessed_years(spark, sf):
    y = F.year("o_orderdate").cast("string")
    said = [F.concat(F.lit('```json {"ano_estimado": '), y, F.lit("} ```")), F.concat(F.lit("talvez em "), y, F.lit(" ou 2050")), F.lit('{"ano_estimado": 3000}'), F.lit("sem data")]
    from ..functions import scores

    return table(spark, sf, "orders").select("o_orderkey", scores.parsed_year(F.element_at(F.array(*said), (F.col("o_orderkey") % 4 + 1).cast("int"))).alias("y"))


@query("""SELECT c_custkey, 'Título: ' || c_name || CASE WHEN c_custkey % 2 = 0 THEN chr(10) || 'Texto: ' || c_mktsegment ELSE '' END AS message, sha1(c_custkey || '|' || c_name) AS key, c_name || '[SEP]' || c_mktsegment AS pair FROM customer""")
def score_messages(spark, sf):
    from ..functions import ids, scores

    c = table(spark, sf, "customer")
    body = F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).otherwise("  ")
    message = scores.score_message(**{"Título": F.col("c_name"), "Texto": body})
    return c.select("c_custkey", message.alias("message"), ids.cache_key(F.col("c_custkey"), F.col("c_name")).alias("key"), text.joined_blocks(F.col("c_name"), F.lit(None).cast("string"), F.col("c_mktsegment"), sep="[SEP]").alias("pair"))


@query("SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN p_retailprice WHEN 1 THEN (p_retailprice + p_size) / 2 ELSE p_size END AS mid, round(ln(least(greatest(p_size / 50.0, 1e-6), 1 - 1e-6) / (1 - least(greatest(p_size / 50.0, 1e-6), 1 - 1e-6))), 6) AS logit FROM part")
def bid_ask_means(spark, sf):
    from ..functions import formulas as fm

    k, bid, ask = F.col("p_size") % 3, F.col("p_retailprice"), F.col("p_size").cast("double")
    p = table(spark, sf, "part")
    return p.select("p_partkey", fm.row_mean(F.when(k < 2, bid), F.when(k > 0, ask)).alias("mid"), F.round(fm.logit(F.col("p_size") / 50.0), 6).alias("logit"))


@query("""WITH s AS (SELECT date_trunc('month', o_orderdate)::DATE AS month, sum(o_totalprice) / 1e6 AS d, avg(o_totalprice) / 1e5 AS gain, stddev_samp(o_totalprice) / 1e5 AS smoothed_se FROM orders GROUP BY 1)
SELECT round(avg((abs(d) < 25)::INT), 6) AS share_weak, round(avg(abs(gain)) FILTER (abs(d) < 25), 6) AS gain_weak, round(avg(smoothed_se) FILTER (abs(d) < 25), 6) AS se_weak, round(avg(abs(gain)) FILTER (abs(d) >= 25), 6) AS gain_strong, round(avg(smoothed_se) FILTER (abs(d) >= 25), 6) AS se_strong FROM s""")
def weak_periods(spark, sf):
    o = table(spark, sf, "orders").groupBy(F.trunc("o_orderdate", "MONTH").alias("month"))
    s = o.agg((F.sum("o_totalprice") / 1e6).alias("d"), (F.avg("o_totalprice") / 1e5).alias("gain"), (F.stddev_samp("o_totalprice") / 1e5).alias("smoothed_se"))
    return rounded(st.identification(s, "d", 25.0))


@query(f"""
WITH s AS (SELECT lang, quality AS y, 0.6 * {HASH60.format(chr(39) + 'm' + chr(39) + ' || doc_id')} + 0.4 * quality >= 0.45 AS keep FROM labels JOIN documents USING (doc_id))
SELECT lang, count_if(y = 1) AS positives, count_if(y = 1 AND keep) AS kept, round(avg((NOT keep)::INT), 6) AS discarded, round(count_if(y = 1 AND keep) / nullif(count_if(y = 1), 0), 6) AS sensitivity, CASE WHEN count_if(y = 1) > 0 THEN true END AS bounded FROM s GROUP BY 1""")
def filter_reports(spark, sf):
    from ..functions import ids
    from ..operators.ordinal_model import filter_report

    d, l = table(spark, sf, "documents").select("doc_id", "lang"), table(spark, sf, "labels")
    scored = l.join(d, "doc_id").select("lang", "quality", (0.6 * ids.salted_fraction(F.col("doc_id"), "m") + 0.4 * F.col("quality")).alias("p"))
    return rounded(filter_report(scored, "p", "quality", 0.45, ["lang"]).withColumn("bounded", F.col("lower").between(0, F.col("sensitivity"))).drop("lower"))


@query()
def ordinal_head(spark, sf):
    """Levels of all vectors by a head that is fitted on all of them."""
    from ..operators.ordinal_model import fit_ordinal, ordinal_scores

    e = table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("x"), (F.col("label") % 5 + 1).alias("y"))
    return rounded(ordinal_scores(e, fit_ordinal(e, "x", "y"), "x").select("vec_id", "y", "level", "mean"))


# Whole runs


@query("""WITH p AS (SELECT event_type AS outlet, event_type || '|' || ts::DATE AS unit, ts::DATE AS day, count(*) AS n FROM events GROUP BY ALL),
s AS (SELECT *, CASE WHEN day(day) % 7 = 3 THEN 'gap' ELSE 'done' END AS state FROM p)
SELECT outlet, sum(CASE state WHEN 'done' THEN day(day) % 4 ELSE 0 END)::BIGINT AS records, count(*) AS units, count_if(state = 'gap') AS gaps FROM s GROUP BY outlet""")
def collection_run(spark, sf):
    from ..operators import procedures as pr

    def fetch(unit):
        day = int(unit[-2:])
        if day % 7 == 3:
            raise ValueError("no such page")
        if day % 5 == 0 and first:
            raise ConnectionError("later")
        return [{"unit": unit, "k": i} for i in range(day % 4)]

    e = table(spark, sf, "events")
    plan = e.select(F.col("event_type").alias("outlet"), work.unit_key(F.col("event_type"), _day("ts")).alias("unit")).distinct()
    folder = shared_folder(spark, "collection")
    for first, writer in ((True, "ana"), (False, "rui")):  # the second run does what the first left open
        pr.collected(spark, plan, fetch, folder, writer, "unit string, k int")
    lines = spark.read.schema("outlet string, writer string, unit string, k int").json(f"{folder}/lines").groupBy("outlet").agg(F.count("*").alias("records"))
    ledger = spark.read.schema("unit string, outlet string").json(f"{folder}/ledger")
    gaps = spark.read.schema("unit string").json(f"{folder}/gaps").select("unit", F.lit(1).alias("gap"))
    units = ledger.join(gaps, "unit", "left").groupBy("outlet").agg(F.count("*").alias("units"), F.sum(F.coalesce("gap", F.lit(0))).alias("gaps"))
    return units.join(lines, "outlet").select("outlet", "records", "units", "gaps")


STORIES = """raw AS (SELECT c.c_mktsegment AS outlet, o.o_orderdate::DATE AS day, 'https://x.org/' || (o.o_orderkey // 2) || CASE WHEN o.o_orderkey % 2 = 1 THEN '/?a=1' ELSE '' END AS url, 'Título ' || (o.o_custkey % 40) || '!' AS title,
  CASE WHEN o.o_orderkey % 3 = 0 THEN 'sub' END AS subtitle, CASE WHEN o.o_orderkey % 50 > 0 THEN 'p' || o.o_orderkey END AS p1, CASE WHEN o.o_orderkey % 9 > 0 THEN 'q' END AS p2 FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey),
one AS (SELECT *, rtrim(regexp_replace(url, '[?#].*$', ''), '/') AS k FROM raw QUALIFY row_number() OVER (PARTITION BY rtrim(regexp_replace(url, '[?#].*$', ''), '/') ORDER BY day, outlet, title, url) = 1),
kept AS (SELECT * FROM one WHERE p1 IS NOT NULL AND p2 IS NOT NULL)"""


def _stories(spark, sf):
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    k = F.col("o_orderkey")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("c_mktsegment").alias("outlet"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.concat(F.lit("https://x.org/"), F.floor(k / 2), F.when(k % 2 == 1, "/?a=1").otherwise("")).alias("url"),
        F.concat(F.lit("Título "), F.col("o_custkey") % 40, F.lit("!")).alias("title"), F.when(k % 3 == 0, "sub").alias("subtitle"), F.when(k % 50 > 0, F.concat(F.lit("p"), k)).alias("p1"), F.when(k % 9 > 0, "q").alias("p2"),
    )


@query(f"""WITH RECURSIVE {STORIES}, x AS (SELECT 't' || title AS t, list_sort(list({{'d': day, 'k': k, 'o': outlet}})) AS l FROM kept GROUP BY 1),
r AS (SELECT l AS left_, NULL::STRUCT(d DATE, k VARCHAR, o VARCHAR) AS h, []::STRUCT(d DATE, k VARCHAR, o VARCHAR)[] AS g FROM x UNION ALL
  SELECT list_filter(left_[2:], lambda y: NOT (y.o <> left_[1].o AND y.d - left_[1].d <= 2)), left_[1], list_filter(left_[2:], lambda y: y.o <> left_[1].o AND y.d - left_[1].d <= 2) FROM r WHERE len(left_) > 0),
g AS (SELECT h.k AS k, len(g) + 1 AS n, false AS rep FROM r WHERE h IS NOT NULL UNION ALL SELECT (unnest(g)).k, len(g) + 1, true FROM r WHERE h IS NOT NULL)
SELECT url, outlet, day, n::BIGINT AS n_replicas, rep AS is_replica, md5('TÍTULO: ' || title || chr(10) || chr(10) || CASE WHEN subtitle IS NOT NULL THEN 'SUBTÍTULO: ' || subtitle || chr(10) || chr(10) ELSE '' END || 'TEXTO: ' || p1 || chr(10) || chr(10) || p2) AS h FROM kept JOIN g USING (k)""")
def consolidated_stories(spark, sf):
    from ..operators import procedures as pr

    return pr.consolidated(_stories(spark, sf)).select("url", "outlet", F.to_date("day").alias("day"), "n_replicas", "is_replica", F.md5("model_text").alias("h"))


@query(f"""WITH {STORIES}, i AS (SELECT DISTINCT ON (url) 'n' || substr(sha1(url), 1, 10) AS item_id, day, outlet, title, coalesce(subtitle, '') AS lead, coalesce(p1, '') AS paragraph FROM raw ORDER BY url, day, title, p1 NULLS FIRST),
p AS (SELECT *, item_id < 'n8' AS known FROM i WHERE outlet <> 'FURNITURE')
SELECT item_id, day, outlet, CASE outlet WHEN 'BUILDING' THEN 'market' ELSE 'press' END AS kind, title, lead FROM p QUALIFY row_number() OVER (PARTITION BY outlet, title, day ORDER BY known DESC, item_id) = 1""")
def corpus_of_stories(spark, sf):
    from ..operators import procedures as pr

    raw = _stories(spark, sf)
    known = raw.select(F.concat(F.lit("n"), F.substring(F.sha1("url"), 1, 10)).alias("item_id")).where("item_id < 'n8'")
    outlets = [r[0] for r in raw.select("outlet").distinct().collect() if r[0] != "FURNITURE"]  # five at any size
    return pr.built_corpus(raw, {"BUILDING": "market"}, outlets, known).select("item_id", "day", "outlet", "kind", "title", "lead")


@query(f"""WITH {ITEMS}, h AS (SELECT * FROM items WHERE {HASH32.format('item_id::VARCHAR')} >= 0.10),
r AS (SELECT *, CASE WHEN {HASH60.format("'label' || item_id")} < 0.05 THEN 'sent' WHEN price / 500000 >= 0.4 THEN 'sent' WHEN {HASH60.format("'audit' || item_id")} < 0.10 THEN 'audited' ELSE 'discarded' END AS decision, CASE WHEN item_id % 8 > 0 THEN item_id % 5 + 1 END AS s FROM h),
c AS (SELECT *, CASE WHEN decision <> 'discarded' THEN (s - 1) / 4.0::DOUBLE END AS c, CASE decision WHEN 'audited' THEN 10.0::DOUBLE ELSE 1 END AS w FROM r)
SELECT {"date_trunc('month', day)::DATE"} AS period, count_if(decision = 'sent') AS n_sent, count_if(decision = 'audited') AS n_audited, count_if(decision = 'discarded') AS n_discarded, round(avg(c), 6) AS simple, round(sum(w * c) / nullif(sum(w) FILTER (c IS NOT NULL), 0), 6) AS weighted FROM c GROUP BY 1""")
def production_run(spark, sf):
    from ..operators import procedures as pr

    def complete(message):
        k = int(message)
        if k % 6 == 0 and k not in asked:
            raise TimeoutError("busy")
        return '```json\n{"d1": ' + (str(k % 5 + 1) if k % 8 else "null") + "}\n```"

    i = items(spark, sf).select("item_id", "day", F.col("item_id").cast("string").alias("message"), (F.col("price") / 500000).alias("p"))
    folder = shared_folder(spark, "production")
    early = F.col("day") < "1998-01-01"
    asked: set = set()
    pr.production(spark, i.where(early), folder, complete, "p", 0.4)  # some answers fail, and later items haven't come
    asked = _Everything()
    return rounded(pr.production(spark, i, folder, complete, "p", 0.4))


class _Everything:
    def __contains__(self, x):
        return True


@query("""WITH l AS (SELECT o_custkey % 700 AS item, o_custkey AS key, o_orderkey AS t, CASE WHEN o_orderstatus <> 'P' THEN substr(o_orderpriority, 1, 1)::INT END AS d1 FROM orders),
k AS (SELECT * FROM l WHERE d1 IS NOT NULL QUALIFY row_number() OVER (PARTITION BY key ORDER BY t DESC) = 1) SELECT item, key, d1 FROM k QUALIFY row_number() OVER (PARTITION BY item ORDER BY t DESC, key) = 1""")
def silver_labels(spark, sf):
    score = F.when(F.col("o_orderstatus") != "P", F.substring("o_orderpriority", 1, 1).cast("int"))
    log = table(spark, sf, "orders").select((F.col("o_custkey") % 700).alias("item"), F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("at"), score.alias("d1"))
    return corpus.silver_labels(log, "key", "item", "at", "d1").select("item", "key", "d1")


STRATA_SQL = "s AS (SELECT o_orderkey, o_orderdate::DATE AS day, CASE WHEN o_orderdate::DATE BETWEEN DATE '1995-01-01' AND DATE '1996-06-30' THEN 'first' WHEN o_orderdate::DATE BETWEEN DATE '1997-01-01' AND DATE '1998-12-31' THEN 'middle' WHEN o_orderdate::DATE BETWEEN DATE '2000-01-01' AND DATE '2001-12-31' THEN 'last' END AS stratum FROM orders)"


@query(f"""WITH {STRATA_SQL}, p AS (SELECT * FROM s WHERE stratum IS NOT NULL QUALIFY row_number() OVER (PARTITION BY stratum ORDER BY sha256('b' || o_orderkey), o_orderkey) <= 40), r AS (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS k FROM p),
c AS (SELECT *, CASE WHEN k % 2 = 0 THEN day + INTERVAL 60 MONTH ELSE day - INTERVAL 60 MONTH END AS one, CASE WHEN k % 2 = 0 THEN day - INTERVAL 60 MONTH ELSE day + INTERVAL 60 MONTH END AS two FROM r)
SELECT o_orderkey, stratum, (CASE WHEN one BETWEEN DATE '1999-07-01' AND DATE '2004-12-02' THEN one WHEN two BETWEEN DATE '1999-07-01' AND DATE '2004-12-02' THEN two ELSE least(greatest(two, DATE '1999-07-01'), DATE '2004-12-02') END)::DATE AS false_day FROM c""")
def battery_sample(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", _day("o_orderdate").alias("day"))
    return probe.battery_sample(o, "day", "o_orderkey", EPISODES, 40, "b", F.to_date(F.lit("2005-01-01"))).select("o_orderkey", "stratum", "false_day")


@query("""WITH a AS (SELECT o_orderkey AS k, o_orderdate::DATE AS day, 'L' || (o_orderkey % 3 + 1) AS level, year(o_orderdate) + (o_orderkey % 3) * (o_custkey % 5 - 2) AS guess FROM orders),
e AS (SELECT *, CASE WHEN day BETWEEN DATE '1995-01-01' AND DATE '1996-06-30' THEN 1 WHEN day BETWEEN DATE '1997-01-01' AND DATE '1998-12-31' THEN 2 WHEN day BETWEEN DATE '2000-01-01' AND DATE '2001-12-31' THEN 3 END AS r,
  CASE WHEN guess = 1995 THEN 1 WHEN guess BETWEEN 1997 AND 1998 THEN 2 WHEN guess BETWEEN 2000 AND 2001 THEN 3 END AS s FROM a),
p AS (SELECT level, count(*) AS n, avg(abs(guess - year(day))) AS mean_error, avg((r = s)::INT) AS accuracy FROM e GROUP BY 1)
SELECT level, n, round(mean_error, 6) AS mean_error, round(accuracy, 6) AS accuracy, round(1 / 3.0::DOUBLE, 6) AS by_chance, mean_error >= 4 AND (accuracy IS NULL OR accuracy <= 0.25) AS blind FROM p""")
def time_probe(spark, sf):
    k, y = F.col("o_orderkey"), F.year("o_orderdate")
    o = table(spark, sf, "orders")
    answer = F.concat(F.lit('{"ano_estimado": '), y + (k % 3) * (F.col("o_custkey") % 5 - 2), F.lit("}"))
    one = o.select(k.alias("k"), F.concat(F.lit("L"), k % 3 + 1).alias("level"), answer.alias("answer"))
    log = one.select("k", "level", F.lit(1).alias("at"), F.lit("1990").alias("answer"), F.lit(None).cast("string").alias("error"))
    log = log.union(one.select("k", "level", F.lit(2), "answer", F.lit(None).cast("string"))).union(one.select("k", "level", F.lit(3), F.lit("1991"), F.lit("timeout")))
    return rounded(probe.time_probe(log, o.select(k.alias("k"), _day("o_orderdate").alias("day")), "k", EPISODES))


@query("""WITH c AS (SELECT o_orderdate::DATE AS day, (o_custkey % 3 + 1)::INT AS tenor, avg(o_totalprice) FILTER (o_orderstatus = 'F') AS nominal, avg(o_totalprice) FILTER (o_orderstatus = 'O') AS real, avg(o_totalprice) AS both_ FROM orders GROUP BY ALL),
l AS (SELECT day, tenor, 'nominal' AS curve, nominal AS a, both_ AS b FROM c UNION ALL SELECT day, tenor, 'real', real, both_ FROM c)
SELECT curve, tenor AS "at", count(*) AS n, round(avg(a - b), 4) AS mean_diff, round(max(abs(a - b)), 4) AS max_abs_diff, round(corr(a, b), 6) AS r FROM l WHERE a IS NOT NULL GROUP BY curve, tenor""")
def curve_validation(spark, sf):
    o = table(spark, sf, "orders").select(_day("o_orderdate").alias("day"), (F.col("o_custkey") % 3 + 1).cast("int").alias("at"), "o_orderstatus", "o_totalprice")
    mean = lambda c: F.avg(F.when(c, F.col("o_totalprice")))
    ours = o.groupBy("day", "at").agg(mean(F.col("o_orderstatus") == "F").alias("nominal"), mean(F.col("o_orderstatus") == "O").alias("real"))
    official = o.groupBy("day", "at").agg(F.avg("o_totalprice").alias("nominal")).withColumn("real", F.col("nominal"))
    found = validation.compared_curves(ours, official, ["at"], ["nominal", "real"])
    return found.withColumns({"mean_diff": F.round("mean_diff", 4), "max_abs_diff": F.round("max_abs_diff", 4), "r": F.round("r", 6)})


@query()
def construct_battery(spark, sf):
    """The three parts of the construct battery and their verdicts: (part, passed)."""
    p = _panel(spark, sf)
    con = validation.convergent_verdict(validation.convergent(p, "month", ["vmax"], ["x", "vmin"]), "vmax", [["x"], ["vmin"]])
    dis = validation.discriminant_verdict(*validation.discriminant(p, "month", ["vmax"], ["x", "vmin"], ["quantity"]), "vmax", ["x", "vmin"])
    pre = validation.predictive_verdict(validation.predictive(p, "month", ["vmax"], ["x", "vmin"], [6], "quantity"), "vmax", "x")
    parts = [(F.lit(n).alias("part"), df) for n, df in (("convergent", con), ("discriminant", dis), ("predictive", pre))]
    out = [df.select(n, "passed") for n, df in parts]
    return out[0].union(out[1]).union(out[2])
