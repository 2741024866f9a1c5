"""Index series, weights, funnels and samples over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.ids import hash_fraction, in_holdout, salted_fraction
from ..operators import corpus, sampling
from ..operators import index as ix
from ..operators import joins as jn
from .tables import DAILY, ITEMS, daily_value, items, rounded, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _index_sql(items_cte: str, period: str, source: str = "items", last: str = "") -> str:
    return f"""
WITH {items_cte},
wide AS (SELECT *, {period} AS period FROM {source}),
kept AS (SELECT * FROM wide {last}),
wires AS (SELECT period, wire, kind, avg((d1 - 1) / 4.0) AS c, min(day) AS day FROM kept WHERE d1 IS NOT NULL GROUP BY ALL),
days AS (SELECT period, day, avg(c) AS m FROM wires GROUP BY ALL),
err AS (SELECT period, stddev_samp(m) / sqrt(count(*)) AS se_day, count(*) AS n_days FROM days GROUP BY period),
lev AS (SELECT period, avg(c) AS level, median(c) AS level_median, count(*) AS n_items, stddev_samp(c) / sqrt(count(*)) AS se_iid FROM wires GROUP BY period),
sig AS (SELECT period, avg(no_signal::INT) AS share_no_signal, count(*) AS n_total FROM kept GROUP BY period)
SELECT period, round(level, 6) AS level, round(level_median, 6) AS level_median, n_items, round(se_iid, 6) AS se_iid, round(se_day, 6) AS se_day, n_days,
       round(share_no_signal, 6) AS share_no_signal, n_total, round(least(greatest(level, 0), 1), 6) AS level_clipped
FROM lev JOIN err USING (period) JOIN sig USING (period)"""


MONTH, QUARTER = "date_trunc('month', day)::DATE", "date_trunc('quarter', day)::DATE"


@query(_index_sql(ITEMS, MONTH))
def agg_monthly_index(spark, sf):
    return rounded(ix.periodic_index(items(spark, sf)))


POOLED = ITEMS + """,
pooled AS (SELECT i.* REPLACE ((date_trunc('month', day) + to_months(k))::DATE AS day), i.day AS real_day FROM items i, range(3) t(k))"""


@query(
    _index_sql(POOLED, "day", "pooled", f"WHERE period <= (SELECT max({MONTH}) FROM items)").replace("min(day) AS day", "min(real_day) AS day")
)
def agg_pooled_3_months(spark, sf):
    return rounded(ix.periodic_index(items(spark, sf), back=3))


@query(_index_sql(ITEMS, QUARTER))
def agg_quarterly_index(spark, sf):
    return rounded(ix.periodic_index(items(spark, sf), unit="QUARTER"))


@query(f"""
WITH RECURSIVE {ITEMS}, w AS (SELECT {MONTH} AS period, wire, kind, avg((d1 - 1) / 4.0) AS c, min(day) AS day FROM items WHERE d1 IS NOT NULL GROUP BY ALL), cells AS (SELECT period, kind, count(*)::DOUBLE AS n, sum(c) AS s FROM w GROUP BY ALL),
r AS (SELECT 0 AS it, kind, 0.0::DOUBLE AS gamma FROM (SELECT DISTINCT kind FROM cells) UNION ALL
  SELECT it + 1, kind, g - sum(g * n) OVER () / sum(n) OVER () FROM (SELECT it, kind, sum(s - n * alpha) / sum(n) AS g, sum(n) AS n FROM cells JOIN (SELECT it, period, sum(s - n * gamma) / sum(n) AS alpha FROM cells JOIN r USING (kind) WHERE it < 60 GROUP BY ALL) USING (period) GROUP BY ALL)),
a AS (SELECT w.period, w.day, c - gamma AS c FROM w JOIN r USING (kind) WHERE it = 60), days AS (SELECT period, day, avg(c) AS m FROM a GROUP BY ALL),
err AS (SELECT period, stddev_samp(m) / sqrt(count(*)) AS se_day, count(*) AS n_days FROM days GROUP BY period),
lev AS (SELECT period, avg(c) AS level, median(c) AS level_median, count(*) AS n_items, stddev_samp(c) / sqrt(count(*)) AS se_iid FROM a GROUP BY period)
SELECT period, round(level, 6) AS level, round(level_median, 6) AS level_median, n_items, round(se_iid, 6) AS se_iid, round(se_day, 6) AS se_day, n_days FROM lev JOIN err USING (period)""")
def agg_effect_adjusted(spark, sf):
    return rounded(ix.adjusted_index(spark, items(spark, sf)))


@query(f"""
WITH {ITEMS}, both_ AS (SELECT *, 'vmax' AS variant FROM items UNION ALL SELECT * REPLACE (CASE WHEN d1 IS NOT NULL THEN 1 + (floor(price / 1000)::BIGINT % 5) END AS d1), 'vmin' FROM items),
wires AS (SELECT variant, {MONTH} AS period, wire, kind, avg((d1 - 1) / 4.0) AS c FROM both_ WHERE d1 IS NOT NULL GROUP BY ALL),
l AS (SELECT variant, period, avg(c) AS level, count(*) AS n FROM wires GROUP BY ALL),
a AS (SELECT * FROM l WHERE variant = 'vmax'), b AS (SELECT * FROM l WHERE variant = 'vmin')
SELECT coalesce(a.period, b.period) AS period, round(a.level, 6) AS level_vmax, a.n AS n_vmax, round(b.level, 6) AS level_vmin, b.n AS n_vmin, round(a.level - b.level, 6) AS delta
FROM a FULL JOIN b ON a.period = b.period""")
def agg_dual_variants(spark, sf):
    one = items(spark, sf)
    low = one.withColumn("d1", F.when(F.col("d1").isNotNull(), 1 + F.expr("cast(floor(price / 1000) as bigint) % 5").cast("int")))
    return rounded(ix.dual_index(one.withColumn("variant", F.lit("vmax")).unionByName(low.withColumn("variant", F.lit("vmin")))))


@query(f"""
WITH {ITEMS}, wires AS (SELECT {MONTH} AS period, wire, kind, avg((d1 - 1) / 4.0) AS c, min(day) AS day FROM items WHERE d1 IS NOT NULL GROUP BY ALL),
d AS (SELECT day, sum(c) AS s, count(*) AS n FROM wires GROUP BY day),
cal AS (SELECT unnest(range((SELECT min(day) FROM d)::TIMESTAMP, (SELECT max(day) FROM d)::TIMESTAMP + INTERVAL 1 DAY, INTERVAL 1 DAY))::DATE AS day),
dense AS (SELECT cal.day, coalesce(s, 0) AS s, coalesce(n, 0) AS n FROM cal LEFT JOIN d USING (day))
SELECT day, round(CASE WHEN n > 0 THEN s / n END, 6) AS level, n,
       round(sum(s) OVER w / nullif(sum(n) OVER w, 0), 6) AS trailing
FROM dense WINDOW w AS (ORDER BY day RANGE BETWEEN INTERVAL 29 DAYS PRECEDING AND CURRENT ROW)""")
def agg_daily_trailing_30(spark, sf):
    return rounded(ix.daily_with_trailing(items(spark, sf)))


HASH60 = "('0x' || substr(sha256({}), 1, 15))::UBIGINT::DOUBLE / 1152921504606846976.0"
HASH32 = "('0x' || substr(sha256({}), 1, 8))::UBIGINT::DOUBLE / 4294967295.0"
ROUTED = ITEMS + f""",
routed AS (SELECT *, CASE WHEN price / 500000 >= 0.4 THEN 'sent' WHEN {HASH60.format("'audit' || item_id")} < 0.10 THEN 'audited' ELSE 'discarded' END AS decision FROM items)"""


def _routed(spark, sf):
    return ix.routed(items(spark, sf).withColumn("p", F.col("price") / 500000), "p", 0.4, "item_id")


@query(f"WITH {ROUTED} SELECT decision, kind, count(*) AS n FROM routed GROUP BY ALL")
def routing_decisions(spark, sf):
    return _routed(spark, sf).groupBy("decision", "kind").agg(F.count("*").alias("n"))


@query(f"""
WITH {ROUTED}, f AS (SELECT count(*) AS n, count_if(decision = 'sent') AS n_sent, count_if(decision = 'audited') AS n_audited, count_if(decision = 'discarded') AS n_discarded,
  count_if(decision = 'sent' AND d1 IS NOT NULL) AS sent_signal, count_if(decision = 'audited' AND d1 IS NOT NULL) AS audited_signal FROM routed),
g AS (SELECT *, n_sent / n AS share_sent, audited_signal / n_audited * n_discarded AS lost_signal FROM f)
SELECT n, n_sent, n_audited, n_discarded, sent_signal, audited_signal, round(share_sent, 6) AS share_sent, round(lost_signal, 6) AS lost_signal,
       round(lost_signal / (lost_signal + sent_signal + audited_signal), 6) AS share_lost FROM g""")
def agg_funnel(spark, sf):
    return rounded(ix.funnel(_routed(spark, sf)))


@query(f"""
WITH {ROUTED}, w AS (SELECT *, CASE WHEN decision = 'audited' THEN 10.0::DOUBLE ELSE 1 END AS w, (d1 - 1) / 4.0::DOUBLE AS c FROM routed)
SELECT {MONTH} AS period, count_if(decision = 'sent') AS n_sent, count_if(decision = 'audited') AS n_audited, count_if(decision = 'discarded') AS n_discarded,
       round(avg(c) FILTER (decision <> 'discarded'), 6) AS simple,
       round(sum(w * c) FILTER (decision <> 'discarded') / nullif(sum(w) FILTER (decision <> 'discarded' AND c IS NOT NULL), 0), 6) AS weighted
FROM w GROUP BY 1""")
def agg_funnel_by_month(spark, sf):
    return rounded(ix.funnel_by_month(_routed(spark, sf)))


@query(f"""
WITH {ROUTED}, t AS (SELECT count_if(decision <> 'sent')::DOUBLE / count_if(decision = 'audited') AS wa FROM routed),
w AS (SELECT {QUARTER} AS period, day, CASE WHEN decision = 'audited' THEN wa ELSE 1 END AS weight, d1, outlet % 5 + 1 AS d2 FROM routed, t WHERE decision <> 'discarded'),
s AS (SELECT period, day, weight, 'd1' AS dim, d1 AS score FROM w UNION ALL SELECT period, day, weight, 'd2', CASE WHEN d1 IS NOT NULL AND d2 <> 3 THEN d2 END FROM w),
v AS (SELECT *, (score - 1) / 4.0 AS level, (score IS NOT NULL)::INT::DOUBLE AS seen FROM s),
ml AS (SELECT period, dim, sum(weight * level) / sum(weight) AS m, sum(weight) AS tot, count(*) AS n FROM v WHERE level IS NOT NULL GROUP BY ALL),
zl AS (SELECT v.period, v.dim, v.day, sum(weight * (level - m) / tot) AS z FROM v JOIN ml USING (period, dim) WHERE level IS NOT NULL GROUP BY ALL),
el AS (SELECT period, dim, sqrt(CASE WHEN count(*) > 1 THEN count(*) / (count(*) - 1) END * sum(z * z)) AS se FROM zl GROUP BY ALL),
ms AS (SELECT period, dim, sum(weight * seen) / sum(weight) AS m, sum(weight) AS tot, count(*) AS n FROM v GROUP BY ALL),
zs AS (SELECT v.period, v.dim, v.day, sum(weight * (seen - m) / tot) AS z FROM v JOIN ms USING (period, dim) GROUP BY ALL),
es AS (SELECT period, dim, sqrt(CASE WHEN count(*) > 1 THEN count(*) / (count(*) - 1) END * sum(z * z)) AS se FROM zs GROUP BY ALL)
SELECT ms.period, ms.dim, round(ms.m, 6) AS attention, round(es.se, 6) AS attention_se, round(ms.tot, 6) AS n_weighted, ms.n, round(ml.m, 6) AS mean, round(el.se, 6) AS se, ml.n AS n_signal
FROM ms JOIN es USING (period, dim) LEFT JOIN ml USING (period, dim) LEFT JOIN el USING (period, dim)""")
def agg_weighted_dimensions(spark, sf):
    rows = ix.audit_weights(_routed(spark, sf)).where("decision <> 'discarded'")
    d2 = F.col("outlet") % 5 + 1
    rows = rows.withColumn("d2", F.when(F.col("d1").isNotNull() & (d2 != 3), d2))
    return rounded(ix.dimension_levels(rows, ["d1", "d2"], "weight", F.trunc("day", "QUARTER")))


@query(f"SELECT doc_id, round({HASH32.format('doc_id::VARCHAR')}, 9) AS fraction, {HASH32.format('doc_id::VARCHAR')} < 0.10 AS held_out, {HASH60.format(chr(39) + 'label' + chr(39) + ' || doc_id')} < 0.2 AS labelled FROM documents")
def holdout_split(spark, sf):
    k = F.col("doc_id")
    return table(spark, sf, "documents").select("doc_id", F.round(hash_fraction(k), 9).alias("fraction"), in_holdout(k).alias("held_out"), (salted_fraction(k, "label") < 0.2).alias("labelled"))


RANKED = "sha256('{seed}' || {key})"


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY sha256('s1' || o_orderkey), o_orderkey LIMIT 100")
def sample_simple(spark, sf):
    return sampling.simple_sample(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 100, "s1")


@query("""SELECT c_custkey, c_mktsegment FROM customer QUALIFY row_number() OVER (PARTITION BY c_mktsegment ORDER BY sha256('s2' || c_custkey), c_custkey) <= 20""")
def sample_per_stratum(spark, sf):
    return sampling.per_stratum(table(spark, sf, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", "c_custkey", 20, "s2")


@query("""
WITH o AS (SELECT o_orderkey, year(o_orderdate) AS y FROM orders), q AS (SELECT y, greatest(1, round(200 * count(*) / (SELECT count(*) FROM o)))::INT AS quota FROM o GROUP BY y)
SELECT o_orderkey, y FROM (SELECT *, row_number() OVER (PARTITION BY y ORDER BY sha256('s3' || o_orderkey), o_orderkey) AS rn FROM o) JOIN q USING (y) WHERE rn <= quota""")
def sample_proportional(spark, sf):
    return sampling.proportional(table(spark, sf, "orders").select("o_orderkey", F.year("o_orderdate").alias("y")), "y", "o_orderkey", 200, "s3")


@query(f"""
WITH {ROUTED}, d AS (SELECT item_id FROM routed WHERE decision <> 'sent')
SELECT item_id FROM (SELECT item_id, row_number() OVER (ORDER BY sha256('s4' || item_id), item_id) AS rn FROM d) WHERE rn <= (SELECT round_even(0.1::DOUBLE * count(*), 0) FROM d)""")
def sample_audit(spark, sf):
    return sampling.audit_share(_routed(spark, sf).where("decision <> 'sent'").select("item_id"), "item_id", 0.1, "s4")


@query("SELECT o_orderkey, o_orderstatus = 'P' AS near FROM orders ORDER BY o_orderstatus = 'P' DESC, sha256('s5' || o_orderkey), o_orderkey LIMIT 500")
def sample_boundary(spark, sf):
    near = F.col("o_orderstatus") == "P"
    return sampling.boundary_sample(table(spark, sf, "orders"), near, "o_orderkey", 500, "s5").select("o_orderkey", near.alias("near"))


@query("SELECT slice, count(*) AS n, sum(o_orderkey)::BIGINT AS ids FROM (SELECT o_orderkey, (('0x' || substr(sha256('s6' || o_orderkey), 1, 15))::UBIGINT % 3)::INT AS slice FROM orders) GROUP BY slice")
def worker_slices(spark, sf):
    return sampling.slices(table(spark, sf, "orders"), "o_orderkey", 3, "s6").groupBy("slice").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("ids"))


@query("""
WITH r AS (SELECT c_custkey, c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS round FROM customer),
n AS (SELECT *, row_number() OVER (PARTITION BY round ORDER BY c_custkey) - 1 AS n FROM r)
SELECT c_custkey, c_nationkey, round, n // 10 AS batch, n % 10 + 1 AS place FROM n""")
def conflict_free_batches(spark, sf):
    return sampling.batches(table(spark, sf, "customer").select("c_custkey", "c_nationkey"), "c_nationkey", "c_custkey", 10)


@query("""
WITH r AS (SELECT o_orderkey, o_orderdate::DATE AS day, row_number() OVER (ORDER BY o_orderdate::DATE, o_orderkey) - 1 AS r, count(*) OVER () AS n FROM orders),
b AS (SELECT day, greatest(ceil(r * 4.0::DOUBLE / greatest(n - 1, 1)), 1)::INT - 1 AS block FROM r)
SELECT block, count(*) AS n, min(day) AS first_day, max(day) AS last_day FROM b GROUP BY block""")
def time_blocks(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    return sampling.time_blocks(o, "day", "o_orderkey", 4).groupBy("block").agg(F.count("*").alias("n"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))


@query("SELECT n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name HAVING count(DISTINCT year(o_orderdate)) = (SELECT count(DISTINCT year(o_orderdate)) FROM orders)")
def outlets_in_all_years(spark, sf):
    o = items(spark, sf).join(table(spark, sf, "nation"), F.col("outlet") == F.col("n_nationkey"))
    years = o.agg(F.countDistinct(F.year("day")).alias("all_years"))
    return o.groupBy("n_name").agg(F.countDistinct(F.year("day")).alias("years")).crossJoin(F.broadcast(years)).where("years = all_years").select("n_name")


@query("SELECT c_nationkey AS outlet, year(o_orderdate) AS y, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY CUBE (1, 2)")
def coverage_cube(spark, sf):
    return items(spark, sf).withColumn("y", F.year("day")).cube("outlet", "y").agg(F.count("*").alias("n"))


YEARS = list(range(1995, 2002))


@query("SELECT kind, " + ", ".join(f"count_if(year(day) = {y}) AS y{y}" for y in YEARS) + f", avg((d1 IS NOT NULL)::INT) AS complete FROM (WITH {ITEMS} SELECT * FROM items) GROUP BY kind")
def coverage_pivot(spark, sf):
    i = items(spark, sf).withColumn("y", F.concat(F.lit("y"), F.year("day")))
    counts = i.groupBy("kind").pivot("y", [f"y{y}" for y in YEARS]).count().na.fill(0)
    return counts.join(i.groupBy("kind").agg(F.avg(F.col("d1").isNotNull().cast("int")).alias("complete")), "kind")


@query("""
WITH d AS (SELECT event_type, date_trunc('day', ts)::DATE AS day, count(*) AS n FROM events GROUP BY ALL),
g AS (SELECT event_type, unnest(range((SELECT min(day) FROM d)::TIMESTAMP, (SELECT max(day) FROM d)::TIMESTAMP + INTERVAL 1 DAY, INTERVAL 1 DAY))::DATE AS day FROM (SELECT DISTINCT event_type FROM d))
SELECT event_type, day, coalesce(n, 0) AS n FROM g LEFT JOIN d USING (event_type, day)""")
def coverage_zero_filled(spark, sf):
    d = table(spark, sf, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    return jn.densified(d, ["event_type"], "day", "n")


@query("""
WITH g AS (SELECT event_type, day FROM (SELECT DISTINCT event_type FROM events), (SELECT unnest(range((SELECT min(ts) FROM events)::DATE::TIMESTAMP, (SELECT max(ts) FROM events)::DATE::TIMESTAMP + INTERVAL 1 DAY, INTERVAL 5 DAY))::DATE AS day))
SELECT g.event_type, g.day, count(e.event_id) AS n FROM g LEFT JOIN events e ON e.event_type = g.event_type AND e.ts::DATE >= g.day AND e.ts::DATE < g.day + 2 GROUP BY ALL""")
def meeting_window_counts(spark, sf):
    e = table(spark, sf, "events").select("event_type", F.to_date("ts").alias("at"))
    ends = e.agg(F.min("at").alias("a"), F.max("at").alias("b")).where("a is not null")
    grid = e.select("event_type").distinct().crossJoin(F.broadcast(ends)).select("event_type", F.explode(F.expr("sequence(a, b, interval 5 days)")).alias("day"))  # one row of ends
    return jn.range_counts(e, grid, ["event_type"], "at", "day", 2)


STRATA = [("early", "1995-01-01", "1996-06-30"), ("crisis", "1996-01-01", "1997-12-31"), ("late", "1999-01-01", "2001-12-31")]


@query("""SELECT stratum, count(*) AS n FROM (SELECT CASE WHEN o_orderdate::DATE BETWEEN DATE '1995-01-01' AND DATE '1996-06-30' THEN 'early' WHEN o_orderdate::DATE BETWEEN DATE '1996-01-01' AND DATE '1997-12-31' THEN 'crisis'
  WHEN o_orderdate::DATE BETWEEN DATE '1999-01-01' AND DATE '2001-12-31' THEN 'late' END AS stratum FROM orders) GROUP BY stratum""")
def stratum_labels(spark, sf):
    return jn.labelled_intervals(table(spark, sf, "orders"), F.to_date("o_orderdate"), STRATA).groupBy("stratum").agg(F.count("*").alias("n"))


CLICKS = "c AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'click'), p AS (SELECT user_id, ts, max(value) AS v FROM events WHERE event_type = 'purchase' GROUP BY ALL)"


def _clicks(spark, sf):
    e = table(spark, sf, "events")
    clicks = e.where("event_type = 'click'").select("event_id", "user_id", "ts")
    return clicks, e.where("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("value").alias("v"))


@query(f"WITH {CLICKS} SELECT c.event_id, c.user_id, c.ts, p.v FROM c ASOF LEFT JOIN p ON c.user_id = p.user_id AND c.ts >= p.ts")
def asof_last_before(spark, sf):
    return jn.asof_backward(*_clicks(spark, sf), ["user_id"], "ts", ["v"])


@query(f"WITH {CLICKS} SELECT c.event_id, c.user_id, c.ts, p.v FROM c ASOF LEFT JOIN p ON c.user_id = p.user_id AND c.ts < p.ts")
def asof_next_after(spark, sf):
    return jn.asof_forward(*_clicks(spark, sf), ["user_id"], "ts", ["v"])


SERIES = f"{DAILY}, s AS (SELECT day, value FROM daily), ev AS (SELECT DISTINCT day FROM daily)"


@query(f"""
WITH {SERIES} SELECT ev.day, round(arg_max(s.value, s.day) FILTER (s.day < ev.day AND s.day >= ev.day - 7), 6) AS "before",
  round(arg_min(s.value, s.day) FILTER (s.day > ev.day AND s.day <= ev.day + 8), 6) AS "after" FROM ev, s GROUP BY ev.day""")
def asof_around(spark, sf):
    d = daily_value(spark, sf)
    return rounded(jn.around(d.select("day"), d, "day", "value"))


@query("""
WITH a AS (SELECT o_orderdate::DATE AS day, sum(o_totalprice) AS v FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), b AS (SELECT l_shipdate::DATE AS day, sum(l_extendedprice) AS v FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
SELECT coalesce(a.day, b.day) AS day, round(coalesce(a.v, b.v), 4) AS v, CASE WHEN a.v IS NOT NULL THEN 'orders' ELSE 'lines' END AS origin FROM a FULL JOIN b ON a.day = b.day""")
def outer_with_origin(spark, sf):
    a = table(spark, sf, "orders").where("o_orderstatus = 'F'").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.sum("o_totalprice").alias("v"))
    b = table(spark, sf, "lineitem").where("l_returnflag = 'R'").groupBy(F.to_date("l_shipdate").alias("day")).agg(F.sum("l_extendedprice").alias("v"))
    return rounded(jn.outer_first(a, b, "day", "v", ("orders", "lines")), 4)


@query("""
SELECT month, round(max(v) FILTER (s = 'F'), 4) AS f, round(max(v) FILTER (s = 'O'), 4) AS o, round(max(v) FILTER (s = 'P'), 4) AS p
FROM (SELECT date_trunc('month', o_orderdate)::DATE AS month, o_orderstatus AS s, sum(o_totalprice) AS v FROM orders GROUP BY ALL) GROUP BY month""")
def aligned_series(spark, sf):
    o = table(spark, sf, "orders").groupBy(F.to_date(F.trunc("o_orderdate", "MONTH")).alias("month"), "o_orderstatus").agg(F.sum("o_totalprice").alias("v"))
    return rounded(jn.aligned({s.lower(): o.where(F.col("o_orderstatus") == s) for s in "FOP"}, "month", "v"), 4)


@query("""
WITH RECURSIVE d AS (SELECT doc_id AS i, source AS o, sha1(text) AS k, DATE '2024-01-01' + (doc_id % 9)::INT AS d FROM documents), x AS (SELECT k, list_sort(list({'d': d, 'i': i, 'o': o})) AS l FROM d WHERE k IS NOT NULL GROUP BY k),
r AS (SELECT k, l AS left_, NULL::STRUCT(d DATE, i BIGINT, o VARCHAR) AS h, [] ::STRUCT(d DATE, i BIGINT, o VARCHAR)[] AS g FROM x UNION ALL
  SELECT k, list_filter(left_[2:], lambda y: NOT (y.o <> left_[1].o AND y.d - left_[1].d <= 2)), left_[1], list_filter(left_[2:], lambda y: y.o <> left_[1].o AND y.d - left_[1].d <= 2) FROM r WHERE len(left_) > 0),
g AS (SELECT h.i AS doc_id, h.i AS group_first, len(g)::BIGINT AS n_copies, false AS is_copy FROM r WHERE h IS NOT NULL UNION ALL SELECT (unnest(g)).i, h.i, len(g)::BIGINT, true FROM r WHERE h IS NOT NULL)
SELECT doc_id, group_first, n_copies, is_copy FROM d LEFT JOIN g ON doc_id = i""")
def replication_groups(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source", F.sha1("text").alias("key"), F.date_add(F.to_date(F.lit("2024-01-01")), F.pmod("doc_id", F.lit(9)).cast("int")).alias("day"))
    return jn.replications(d, "key", "source", "day", "doc_id").select("doc_id", "group_first", "n_copies", "is_copy")


@query("SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1")
def dedup_keep_first(spark, sf):
    # a digest instead of the text is what is sorted and compared
    d = table(spark, sf, "documents").select("doc_id", "source", F.sha2("text", 256).alias("h"))
    return corpus.one_of_each(d, ["h"], [F.col("doc_id")]).drop("h")


@query("SELECT user_id, event_id, value FROM events WHERE event_type <> 'error' AND value > 0 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def latest_valid(spark, sf):
    e = table(spark, sf, "events")
    return corpus.latest_valid(e, "user_id", "event_id", (F.col("event_type") != "error") & (F.col("value") > 0)).select("user_id", "event_id", "value")


@query("""
WITH d AS (SELECT *, doc_id % 7 = 3 AS known FROM documents) SELECT doc_id FROM d QUALIFY row_number() OVER (PARTITION BY text ORDER BY known DESC, doc_id) = 1""")
def dedup_known_first(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    return corpus.preferred_first(d, d.where("doc_id % 7 = 3"), "doc_id", ["h"], [F.col("doc_id")]).select("doc_id")


@query("""
WITH o AS (SELECT user_id, count(*) AS n FROM events WHERE event_id % 2 = 0 GROUP BY 1), w AS (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'click' GROUP BY 1)
SELECT coalesce(w.user_id, o.user_id) AS user_id, coalesce(w.n, o.n) AS n FROM o FULL JOIN w USING (user_id)""")
def upserted_counts(spark, sf):
    e = table(spark, sf, "events")
    counts = lambda c: e.where(c).groupBy("user_id").agg(F.count("*").alias("n"))
    return corpus.upserted(counts("event_id % 2 = 0"), counts("event_type = 'click'"), ["user_id"])


@query("""
SELECT * FROM (SELECT 'missing text' AS rule, count_if(trim(text) = '' OR text IS NULL) AS n FROM documents UNION ALL SELECT 'unknown lang', count_if(NOT coalesce(lang IN ('en', 'fr'), false)) FROM documents
UNION ALL SELECT 'repeated doc_id', count(*) FROM (SELECT doc_id FROM documents GROUP BY 1 HAVING count(*) > 1)) WHERE n > 0""")
def schema_violations(spark, sf):
    return corpus.violations(table(spark, sf, "documents"), "doc_id", ["text"], {"lang": ["en", "fr"]})


@query("SELECT substr(c_mktsegment, 1, 4) || '-' || lpad((row_number() OVER (ORDER BY c_name, c_custkey) - 1)::VARCHAR, 6, '0') AS id, c_custkey FROM customer")
def export_ids(spark, sf):
    return corpus.with_export_id(table(spark, sf, "customer"), F.col("c_mktsegment"), ["c_name", "c_custkey"], "id").select("id", "c_custkey")


SETS = "a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT DISTINCT c_custkey AS k FROM customer WHERE c_acctbal > 0)"


@query(f"""WITH {SETS} SELECT 'union' AS op, count(*) AS n, sum(k)::BIGINT AS s FROM (SELECT * FROM a UNION SELECT * FROM b) UNION ALL SELECT 'intersect', count(*), sum(k)::BIGINT FROM (SELECT * FROM a INTERSECT SELECT * FROM b)
UNION ALL SELECT 'except', count(*), sum(k)::BIGINT FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'symmetric', count(*), sum(k)::BIGINT FROM ((SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL (SELECT * FROM b EXCEPT SELECT * FROM a))
UNION ALL SELECT 'union all', count(*), sum(k)::BIGINT FROM (SELECT * FROM a UNION ALL SELECT * FROM b)""")
def set_operations(spark, sf):
    a = table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k")).distinct()
    b = table(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("k")).distinct()
    of = {"union": a.union(b).distinct(), "intersect": a.intersect(b), "except": a.subtract(b), "symmetric": a.subtract(b).union(b.subtract(a)), "union all": a.union(b)}
    out = None
    for name, s in of.items():
        row = s.agg(F.lit(name).alias("op"), F.count("*").alias("n"), F.sum("k").alias("s"))
        out = row if out is None else out.union(row)
    return out


@query("SELECT o_orderkey FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linestatus = 'O')")
def semi_and_anti(spark, sf):
    o, l = table(spark, sf, "orders").select("o_orderkey"), table(spark, sf, "lineitem")
    on = F.col("o_orderkey") == F.col("l_orderkey")
    return o.join(l.where("l_returnflag = 'R'"), on, "left_semi").join(l.where("l_linestatus = 'O'"), on, "left_anti")


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS discount, count(*) AS n FROM lineitem WHERE l_shipdate <= DATE '1998-09-02' GROUP BY ALL")
def lineitem_summary(spark, sf):
    l = table(spark, sf, "lineitem").where(F.col("l_shipdate") <= F.to_timestamp_ntz(F.lit("1998-09-02 00:00:00")))
    return l.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("discount"), F.count("*").alias("n"))
