"""Texts, answers, calendars, curves, panels, statistics and events over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import formulas as fm
from ..functions import ids, scores, text
from ..operators import calendar as cal
from ..operators import curves as cv
from ..operators import index as ix
from ..operators import panel as pn
from ..operators import stats as st
from ..operators.ranks import with_standard_score
from .index_queries import HASH60
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


@query(r"""
WITH n AS (SELECT doc_id, strip_accents(lower(text)) AS n, strip_accents(text) AS m FROM documents)
SELECT doc_id, md5(n) AS norm_md5, md5(regexp_replace(n, '[^a-z0-9 ]', ' ', 'g')) AS title_md5, md5(trim(regexp_replace(regexp_replace(lower(regexp_replace(m, '[^\x00-\x7F]', '', 'g')), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g'))) AS key_md5,
       substr(regexp_replace(regexp_replace(n, '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g'), 1, 80) AS slug FROM n""")
def text_normal_forms(spark, sf):
    t, n = F.col("text"), F.col("n")
    d = table(spark, sf, "documents").select("doc_id", text.norm(t).alias("n"), F.md5(text.text_key(t)).alias("key_md5"))
    return d.select("doc_id", F.md5(n).alias("norm_md5"), F.md5(text.title_key_of(n)).alias("title_md5"), "key_md5", text.slug_of(n).alias("slug"))


@query(f"""SELECT doc_id, regexp_matches(strip_accents(lower(text)), 'der die|the of|nation') AS has_term, regexp_matches(text, '(?i)the th|une? ') AND NOT regexp_matches(text, '(?i)license|http') AS relevant FROM documents""")
def text_relevance(spark, sf):
    t = F.col("text")
    return table(spark, sf, "documents").select("doc_id", text.has_term([t], ["der die", "the of", "nation"]).alias("has_term"), text.relevant(t, "the th|une? ", "license|http").alias("relevant"))


OFFICIALS, POLITICIANS, ERA = ["Ilan Goldfajn", "Ilan", "Henrique Meirelles", "Roberto Campos Neto", "Campos Neto"], ["Dilma", "Lula", "Temer"], ["pandemia", "plano real"]
MASKED = """
WITH o AS (SELECT o_orderkey AS k, o_orderkey % 8 AS c, (o_orderkey % 40 + 1)::VARCHAR AS a, lpad((o_custkey % 100)::VARCHAR, 2, '0') AS b, year(o_orderdate)::VARCHAR AS y, (o_orderkey % 28 + 1)::VARCHAR AS d FROM orders)"""


def _news(spark, sf):
    """(k, s): a sentence for each order, of eight kinds."""
    k, n = F.col("o_orderkey"), F.col("o_custkey")
    a, b, y, d = (k % 40 + 1).cast("string"), F.lpad((n % 100).cast("string"), 2, "0"), F.year("o_orderdate").cast("string"), (k % 28 + 1).cast("string")
    say = lambda *p: F.concat(*(x if not isinstance(x, str) else F.lit(x) for x in p))
    kinds = [
        say("Em ", d, " de março de ", y, " o Copom elevou a Selic para ", a, ",", b, "% ao ano."), say("PIB de R$ 1.", b, "4,56 e dólar a R$ ", a, ",", b, "; em ", y, " nada."),
        say("ILAN GOLDFAJN e Henrique Meirelles falaram em ", y, "; temer não é nome, Temer é."), say("O IPCA acumula ", a, ",", b, "% no ano, diz Campos Neto a Lula."),
        say("CÂMBIO fechou em ", a, " pontos percentuais; Ilanes fica."), say("Produto Interno Bruto sobe, ", a, "% de alta da SELIC"), F.lit(None).cast("string"), say("Sem nada a mascarar, Dilmar."),
    ]
    pick = F.element_at(F.array(*kinds), (k % 8 + 1).cast("int"))
    return table(spark, sf, "orders").select(k.alias("k"), pick.alias("s"))


@query(MASKED + """
SELECT k, CASE c WHEN 0 THEN 'Em [DATA] de [DATA] o Copom elevou a Selic para [SELIC_NIVEL] ao ano.' WHEN 1 THEN 'PIB de [PIB_NIVEL] e dólar a [CAMBIO_NIVEL]; em [DATA] nada.'
  WHEN 2 THEN '[AUTORIDADE_BC] e [AUTORIDADE_BC] falaram em [DATA]; temer não é nome, [POLITICO] é.' WHEN 3 THEN 'O IPCA acumula [IPCA_NIVEL] no ano, diz [AUTORIDADE_BC] a [POLITICO].'
  WHEN 4 THEN 'CÂMBIO fechou em [CAMBIO_NIVEL]; Ilanes fica.' WHEN 5 THEN 'Produto Interno Bruto sobe, [PIB_NIVEL] de alta da SELIC' WHEN 6 THEN '' ELSE 'Sem nada a mascarar, Dilmar.' END AS masked FROM o""")
def mask_level_4(spark, sf):
    return _news(spark, sf).select("k", text.masked(F.col("s"), 4, OFFICIALS, POLITICIANS, ERA).alias("masked"))


@query(MASKED + """
SELECT k, CASE c WHEN 0 THEN 'Em ' || d || ' de março de ' || y || ' o Copom elevou a Selic para ' || a || ',' || b || '% ao ano.' ELSE NULL END AS s, CASE c WHEN 0 THEN 'Em [DATA] de [DATA] o Copom elevou a Selic para ' || a || ',' || b || '% ao ano.' WHEN 2 THEN 'ILAN GOLDFAJN e Henrique Meirelles falaram em [DATA]; temer não é nome, Temer é.' END AS dates,
  CASE c WHEN 2 THEN '[AUTORIDADE_BC] e [AUTORIDADE_BC] falaram em [DATA]; temer não é nome, Temer é.' WHEN 3 THEN 'O IPCA acumula ' || a || ',' || b || '% no ano, diz [AUTORIDADE_BC] a Lula.' END AS officials FROM o""")
def mask_levels_1_and_2(spark, sf):
    s, kind = F.col("s"), F.col("k") % 8
    return _news(spark, sf).select("k", F.when(kind == 0, s).alias("s"), F.when(kind.isin(0, 2), text.masked(s, 1, OFFICIALS)).alias("dates"), F.when(kind.isin(2, 3), text.masked(s, 2, OFFICIALS, POLITICIANS)).alias("officials"))


@query(r"""SELECT doc_id, md5(regexp_replace(regexp_replace(text, '\b(19|20)\d{2}\b', '[DATA]', 'g'), '\d+([.,]\d+)?', '#', 'g')) AS h FROM documents""")
def mask_numbers(spark, sf):
    years = F.regexp_replace("text", r"\b(19|20)\d{2}\b", "[DATA]")
    return table(spark, sf, "documents").select("doc_id", F.md5(F.regexp_replace(years, r"\d+([.,]\d+)?", "#")).alias("h"))


@query(r"""
WITH a AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '(?i)\b(?:19|20)\d{2}\b|\b\d{1,2} de (?:janeiro|fevereiro|março|abril|maio|junho|julho|agosto|setembro|outubro|novembro|dezembro)\b', '[DATA]', 'g') AS t FROM documents),
b AS (SELECT doc_id, regexp_replace(regexp_replace(t, '\b(?:the|THE)\b', '[AUTORIDADE_BC]', 'g'), '\b(?:Lula|LULA)\b', '[POLITICO]', 'g') AS t FROM a),
c AS (SELECT doc_id, regexp_replace(regexp_replace(t, '(?i)\b(?:plano real|pandemia|nation)\b', '[EPOCA]', 'g'), '(?:R\$\s*)?\d[\d.,]*(?:\s*%|\s*pontos?(?:\s*percentuais)?|\s*p\.p\.)?', '[NUM]', 'g') AS t FROM b),
d AS (SELECT doc_id, regexp_replace(t, '([a-zà-ú0-9,;:)\]] )((?:[A-ZÀ-Ú](?:[\pL\pN\pM_]|[à-ú])+|[A-Z]{2,})(?:\s+(?:de|da|do|dos|das|e)?\s*[A-ZÀ-Ú](?:[\pL\pN\pM_]|[à-ú])+)*)', '\1[NOME]', 'g') AS t FROM c)
SELECT doc_id, md5(t) AS h FROM d""")
def mask_level_5(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(text.masked(F.col("text"), 5, ["the"], ["Lula"], ["pandemia", "plano real", "nation"])).alias("h"))


@query("""SELECT page_id, lower(rtrim(regexp_replace(url, '[?#].*$', ''), '/')) AS url, 'n' || substr(sha1(url), 1, 10) AS id FROM pages""")
def url_keys(spark, sf):
    return table(spark, sf, "pages").select("page_id", ids.normal_url(F.col("url")).alias("url"), ids.article_id(F.col("url")).alias("id"))


@query("""SELECT page_id, url AS target FROM pages""")
def url_unwrapped(spark, sf):
    once = F.url_encode(F.url_encode("url"))
    wrapped = F.concat(F.lit("https://track.example.org/r?x=1&u="), once, F.lit("&z=2"))
    return table(spark, sf, "pages").select("page_id", ids.unwrapped_url(wrapped).alias("target"))


@query(r"""
WITH p AS (SELECT page_id, unnest(regexp_extract_all(html, '<p[^>]*>((?s:.*?))</p>', 1)) AS p, generate_subscripts(regexp_extract_all(html, '<p[^>]*>((?s:.*?))</p>', 1), 1) AS k FROM pages),
q AS (SELECT page_id, k, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(p, '<[^>]*>', '', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '\s+', ' ', 'g')) AS p FROM p)
SELECT page_id, count(*) AS n, md5(string_agg(p, chr(10) ORDER BY k)) AS h FROM q WHERE length(p) >= 60 GROUP BY page_id""")
def html_paragraphs(spark, sf):
    found = table(spark, sf, "pages").select("page_id", text.html_paragraphs(F.col("html")).alias("ps")).where(F.size("ps") > 0)
    return found.select("page_id", F.size("ps").cast("long").alias("n"), F.md5(F.array_join("ps", "\n")).alias("h"))


@query(r"""WITH p AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda p: trim(p)), lambda p: length(p) >= 60) AS ps FROM documents) SELECT doc_id, len(ps) AS n, md5(array_to_string(ps, chr(10))) AS h FROM p""")
def text_paragraphs(spark, sf):
    found = table(spark, sf, "documents").select("doc_id", text.paragraphs(F.col("text")).alias("ps"))
    return found.select("doc_id", F.size("ps").cast("long").alias("n"), F.md5(F.array_join("ps", "\n")).alias("h"))


@query(r"""
WITH s AS (SELECT doc_id, string_split(regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '([.!?]) +', '\1' || chr(1), 'g'), chr(1)) AS s FROM documents),
r AS (SELECT doc_id, list_reduce(list_transform(s, lambda x: {'done': []::VARCHAR[], 'last': x}), lambda a, b: CASE WHEN length(a.last) >= 220 THEN {'done': list_append(a.done, a.last), 'last': b.last} ELSE {'done': a.done, 'last': a.last || ' ' || b.last} END) AS r FROM s),
p AS (SELECT doc_id, list_filter(list_append(r.done, r.last), lambda x: x <> '') AS ps FROM r) SELECT doc_id, len(ps) AS n, md5(array_to_string(ps, chr(10))) AS h FROM p""")
def text_regrouped(spark, sf):
    found = table(spark, sf, "documents").select("doc_id", text.regrouped_sentences(F.regexp_replace("text", r"\s+", " ")).alias("ps"))
    return found.select("doc_id", F.size("ps").cast("long").alias("n"), F.md5(F.array_join("ps", "\n")).alias("h"))


@query("""
SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS message, count(*) AS n FROM conversations WHERE role <> 'system' GROUP BY conv_id""")
def prompt_messages(spark, sf):
    turns = F.array_sort(F.collect_list(F.struct("turn", F.concat_ws(": ", "role", "text").alias("s"))))
    c = table(spark, sf, "conversations").where("role <> 'system'").groupBy("conv_id").agg(turns.alias("t"), F.count("*").alias("n"))
    return c.select("conv_id", F.concat_ws("\n", F.transform("t", lambda x: x["s"])).alias("message"), "n")


ANSWERED = """a AS (SELECT o_orderkey AS id, (o_orderkey % 10)::INT AS k, (o_custkey % 9)::INT AS v FROM orders), b AS (SELECT *, v BETWEEN 1 AND 5 AS ok FROM a)"""


def _answers(spark, sf):
    """(id, s): an answer of one of ten forms for each order, with a value of 0 to 8."""
    v = (F.col("o_custkey") % 9).cast("string")
    form = lambda t: F.concat(*(x for i, part in enumerate(t.split("@")) for x in ([v] if i else []) + [F.lit(part)]))
    forms = [form(t) for t in ('```json\n{"d1": @, "d2": null, "d3": 2}\n```', '{""d1"": ""@"", ""d2"": 5}', '{"d1": @.0}', '{"d1": @.5}', '{"d1": true, "d2": @}', 'Resposta: {"d1": @, "d2": @, "d3": @} fim', '{"d2": @}', '{"d1": null, "d2": @}', "@ no object")]
    pick = F.element_at(F.array(*forms, F.lit(None).cast("string")), (F.col("o_orderkey") % 10 + 1).cast("int"))
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), pick.alias("s"))


@query(f"""
WITH {ANSWERED} SELECT id, CASE WHEN ok AND k IN (0, 1, 2, 5) THEN v END AS d1, k = 7 AS d1_no_signal, CASE WHEN k = 1 AND ok THEN 5 WHEN k IN (5, 7) AND ok THEN v END AS d2, CASE WHEN k = 0 AND ok THEN 2 WHEN k = 5 AND ok THEN v END AS d3, (ok AND k IN (0, 1, 2, 5)) OR k = 7 AS valid FROM b""")
def parsed_answers(spark, sf):
    got = _answers(spark, sf).select("id", scores.parsed_answer(F.col("s")).alias("a")).select("id", "a.*")
    return got.withColumn("d1_no_signal", F.coalesce("d1_no_signal", F.lit(False)))


@query(f"""
WITH {ANSWERED}, s AS (SELECT id, o_orderstatus AS variant, CASE WHEN k = 7 THEN 3 WHEN ok AND k IN (0, 1, 2, 5) THEN v END AS d1 FROM b JOIN orders ON o_orderkey = id) SELECT variant, count(*) AS n, sum(d1)::BIGINT AS total FROM s WHERE d1 IS NOT NULL GROUP BY 1""")
def neutral_scores(spark, sf):
    status = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("variant"))
    got = _answers(spark, sf).select("id", scores.parsed_answer(F.col("s"), neutral_null=True)["d1"].alias("d1")).join(status, "id").where("d1 is not null")
    return got.groupBy("variant").agg(F.count("*").alias("n"), F.sum("d1").alias("total"))


@query("""WITH c AS (SELECT c_custkey AS id, (c_custkey % 5 + 1)::INT AS a, (c_nationkey % 8 + 1)::INT AS b FROM customer)
SELECT id, 1 AS place, a AS d1, 3 AS d2, NULL::INT AS d3, false AS no_signal FROM c UNION ALL SELECT id, 2, NULL, NULL, NULL, true FROM c UNION ALL SELECT id, 3, b, 2, a, false FROM c WHERE b <= 5""")
def parsed_batches(spark, sf):
    a, b = (F.col("c_custkey") % 5 + 1).cast("string"), (F.col("c_nationkey") % 8 + 1).cast("string")
    lines = F.concat(F.lit("1|"), a, F.lit("|3|-\n2|S|-|-\n[3] | "), b, F.lit(" | 2 | "), a, F.lit("\n4|7|-|-\nlixo\n2|5|5|5\n9|1|1|1"))
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.inline(scores.parsed_batch(lines, F.lit(5))))


@query("""SELECT event_id, event_type, ('{"d1": ' || (props::JSON->>'k') || '}') AS raw, CASE WHEN (props::JSON->>'k')::INT BETWEEN 1 AND 5 THEN (props::JSON->>'k')::INT END AS d1 FROM events""")
def json_scores(spark, sf):
    raw = F.concat(F.lit('{"d1": '), F.get_json_object("props", "$.k"), F.lit("}"))
    return table(spark, sf, "events").select("event_id", "event_type", raw.alias("raw")).withColumn("d1", scores.parsed_answer(F.col("raw"))["d1"])


@query("""SELECT l_orderkey, l_linenumber, round(l_extendedprice, 2) AS grouped, round(l_discount / 100, 6) AS scientific, NULL::DOUBLE AS not_a_number FROM lineitem""")
def local_numbers(spark, sf):
    l = table(spark, sf, "lineitem")
    swap = lambda c: F.translate(c, ",.", ".,")
    grouped, scientific = swap(F.format_number("l_extendedprice", 2)), F.concat(swap(F.format_number("l_discount", 4)), F.lit("E-02"))
    return l.select("l_orderkey", "l_linenumber", text.number(grouped).alias("grouped"), F.round(text.number(scientific), 6).alias("scientific"), text.number(F.concat(F.lit(" n/d "), "l_shipmode" if "l_shipmode" in l.columns else "l_returnflag")).alias("not_a_number"))


CALENDAR = """
y AS (SELECT unnest(range(1994, 2003)) AS y),
e1 AS (SELECT y, y % 19 AS a, y // 100 AS b, y % 100 AS c FROM y),
e2 AS (SELECT *, (19 * a + b - b // 4 - (b - (b + 8) // 25 + 1) // 3 + 15) % 30 AS h FROM e1),
e3 AS (SELECT *, (32 + 2 * (b % 4) + 2 * (c // 4) - h - c % 4) % 7 AS l FROM e2),
e4 AS (SELECT *, (a + 11 * h + 22 * l) // 451 AS m FROM e3),
easter AS (SELECT y, make_date(y, (h + l - 7 * m + 114) // 31, (h + l - 7 * m + 114) % 31 + 1) AS d FROM e4),
free AS (SELECT d + k AS day FROM easter, (SELECT unnest([-48, -47, -2, 60]) AS k) UNION SELECT make_date(y, mm, dd) FROM y, (VALUES (1, 1), (4, 21), (5, 1), (9, 7), (10, 12), (11, 2), (11, 15), (12, 25)) t(mm, dd)),
days AS (SELECT unnest(range(TIMESTAMP '1994-01-01', TIMESTAMP '2003-01-01', INTERVAL 1 DAY))::DATE AS day),
marked AS (SELECT day, isodow(day) < 6 AND day NOT IN (SELECT day FROM free) AS is_business FROM days),
cal AS (SELECT *, coalesce(count_if(is_business) OVER (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS n FROM marked)"""


def _calendar(spark):
    return cal.business_calendar(spark, 1994, 2002)


@query(f"""
WITH {CALENDAR} SELECT day, is_business, n, max(CASE WHEN is_business THEN day END) OVER (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous,
  min(CASE WHEN is_business THEN day END) OVER (ORDER BY day ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next, min(CASE WHEN is_business THEN day END) OVER (ORDER BY day ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS same_or_next FROM cal""")
def business_calendar(spark, sf):
    return _calendar(spark)


@query(f"""
WITH {CALENDAR}, l AS (SELECT l_returnflag, o_orderdate::DATE AS a, l_shipdate::DATE AS b FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT l_returnflag, count(*) AS n, sum(cb.n - ca.n)::BIGINT AS days, max(cb.n - ca.n) AS longest FROM l JOIN cal ca ON ca.day = a JOIN cal cb ON cb.day = b GROUP BY 1""")
def business_days_to_ship(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("a"))
    l = table(spark, sf, "lineitem").select("l_orderkey", "l_returnflag", F.to_date("l_shipdate").alias("b"))
    spans = cal.business_days(l.join(o, F.col("l_orderkey") == F.col("o_orderkey")), _calendar(spark), "a", "b", "d").where("d is not null")
    return spans.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.sum("d").alias("days"), F.max("d").alias("longest"))


@query(f"""
WITH {CALENDAR}, m AS (SELECT min(day) AS maturity FROM cal WHERE is_business GROUP BY date_trunc('month', day)), d AS (SELECT DISTINCT o_orderdate::DATE AS day FROM orders),
r AS (SELECT day, maturity, row_number() OVER (PARTITION BY day ORDER BY maturity) AS rank FROM d JOIN m ON maturity > day)
SELECT day, maturity, 'DI1' || substr('FGHJKMNQUVXZ', month(maturity), 1) || lpad((year(maturity) % 100)::VARCHAR, 2, '0') AS code, rank FROM r WHERE rank <= 4""")
def next_maturities(spark, sf):
    d = table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    return cal.next_maturities(d, _calendar(spark), "day", 4)


MEETINGS = [(1, "1999-03-04", 45.0, None, False), (2, "1999-04-14", 39.5, None, False), (3, "1999-04-28", 34.0, "1999-04-30", True), (4, "1999-05-19", 23.5, None, False), (5, "2000-01-19", 19.0, None, False)]


@query(f"""
WITH {CALENDAR}, c AS (SELECT day, is_business, n, max(CASE WHEN is_business THEN day END) OVER (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev, min(CASE WHEN is_business THEN day END) OVER (ORDER BY day ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM cal),
m AS (SELECT * FROM (VALUES (1, DATE '1999-03-04', 45.0::DOUBLE, NULL::DATE, false), (2, DATE '1999-04-14', 39.5, NULL, false), (3, DATE '1999-04-28', 34.0, DATE '1999-04-30', true), (4, DATE '1999-05-19', 23.5, NULL, false), (5, DATE '2000-01-19', 19.0, NULL, false)) t(number, day, rate, eff, extraordinary)),
k AS (SELECT m.*, coalesce(eff, nxt) AS effective, is_business, prev AS session_before, CASE WHEN is_business THEN m.day ELSE prev END AS session_day, nxt AS session_after, lag(rate) OVER (ORDER BY m.day) AS previous_rate, lead(m.day) OVER (ORDER BY m.day) AS next_meeting,
  CASE WHEN extraordinary THEN '' ELSE 'R' || row_number() OVER (PARTITION BY year(m.day), extraordinary ORDER BY m.day) || '/' || year(m.day) END AS code FROM m JOIN c USING (day)),
f AS (SELECT min(day) AS maturity FROM cal WHERE is_business GROUP BY date_trunc('month', day)),
s AS (SELECT k.*, (SELECT min(maturity) FROM f WHERE maturity > k.effective) AS short_maturity FROM k),
d AS (SELECT s.*, cm.n - ca.n AS days_after, cm.n - ce.n AS days_effective, (SELECT count(*) FROM m x WHERE x.day > s.day AND x.day < s.short_maturity) AS meetings_before_maturity FROM s JOIN cal cm ON cm.day = short_maturity JOIN cal ca ON ca.day = session_after JOIN cal ce ON ce.day = effective)
SELECT number, day, rate, extraordinary, previous_rate, is_business, next_meeting, session_before, session_day, session_after, effective, round(100 * (rate - previous_rate), 1) AS change_bps, code, short_maturity,
  'DI1' || substr('FGHJKMNQUVXZ', month(short_maturity), 1) || lpad((year(short_maturity) % 100)::VARCHAR, 2, '0') AS short_code, days_after, days_effective, meetings_before_maturity, CASE WHEN days_effective > 0 THEN days_after / days_effective END AS factor, (next_meeting < short_maturity)::INT AS crosses_next, days_effective < 5 AS too_short FROM d""")
def meeting_calendar(spark, sf):
    m = spark.createDataFrame(MEETINGS, "number int, day string, rate double, effective string, extraordinary boolean").withColumns({"day": F.to_date("day"), "effective": F.to_date("effective")})
    return cal.meeting_calendar(m, _calendar(spark)).withColumn("crosses_next", F.col("crosses_next").cast("int"))


@query(f"""
WITH {DAILY}, s AS (SELECT event_type, ts::DATE AS day FROM events GROUP BY ALL),
g AS (SELECT *, coalesce((day - lag(day) OVER w > 2)::INT, 1) AS new FROM s WINDOW w AS (PARTITION BY event_type ORDER BY day))
SELECT event_type, island, min(day) AS first_day, max(day) AS last_day, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY event_type ORDER BY day)::BIGINT AS island FROM g) GROUP BY ALL""")
def gaps_and_islands(spark, sf):
    d = table(spark, sf, "events").select("event_type", F.to_date("ts").alias("day")).distinct()
    return cal.islands(d, ["event_type"], "day", 2).groupBy("event_type", "island").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count("*").alias("n"))


@query(f"""
WITH {MONTHLY}, f AS (SELECT month, x > (SELECT avg(x) FROM monthly) AS high FROM monthly), o AS (SELECT *, sum((NOT high)::INT) OVER (ORDER BY month) AS off FROM f)
SELECT month, high, sum(high::INT) OVER (PARTITION BY off ORDER BY month)::BIGINT AS run, FROM o""")
def consecutive_runs(spark, sf):
    m = monthly_price(spark, sf)
    f = m.crossJoin(F.broadcast(m.agg(F.avg("x").alias("mx")))).select("month", (F.col("x") > F.col("mx")).alias("high"), F.lit(1).alias("k"))
    return cal.run_lengths(f, ["k"], "month", "high").select("month", "high", "run")


CURVE = "curve AS (SELECT p_brand AS c, (p_size * 21)::INT AS du, p_retailprice / 100 AS rate FROM part)"
TENORS = [1, 126, 252, 378, 504, 600, 5000]


@query(f"""
WITH {CURVE}, q AS (SELECT c, du, avg(rate)::DOUBLE AS rate FROM curve GROUP BY ALL), p AS (SELECT *, ln(1 + rate / 100) * du / 252.0::DOUBLE AS f FROM q), t AS (SELECT unnest({TENORS}) AS tenor),
b AS (SELECT c, tenor, max(du) FILTER (du <= tenor) AS lo, min(du) FILTER (du >= tenor) AS hi FROM p, t GROUP BY ALL)
SELECT b.c, tenor AS "at", round(CASE WHEN lo = hi THEN l.rate ELSE (exp((l.f + (tenor - lo) / (hi - lo)::DOUBLE * (h.f - l.f)) * 252.0::DOUBLE / tenor) - 1) * 100 END, 6) AS rate
FROM b LEFT JOIN p l ON l.c = b.c AND l.du = lo LEFT JOIN p h ON h.c = b.c AND h.du = hi
UNION ALL SELECT c, -1, max(du)::DOUBLE FROM curve GROUP BY c""")
def curve_vertices(spark, sf):
    curve = table(spark, sf, "part").select(F.col("p_brand").alias("c"), (F.col("p_size") * 21).cast("int").alias("du"), (F.col("p_retailprice") / 100).alias("rate"))
    return rounded(cv.vertices(curve, spark.createDataFrame([(t,) for t in TENORS], "at int"), ["c"]))


@query("""
WITH t AS (SELECT p_partkey, p_size / 10.0::DOUBLE AS t FROM part)
SELECT p_partkey, round(0.12 + -0.02 * (1 - exp(-0.8 * t)) / (0.8 * t) + 0.01 * ((1 - exp(-0.8 * t)) / (0.8 * t) - exp(-0.8 * t)) + 0.005 * ((1 - exp(-0.3 * t)) / (0.3 * t) - exp(-0.3 * t)), 9) AS yield FROM t""")
def svensson_yields(spark, sf):
    t = F.col("p_size") / 10.0
    return rounded(table(spark, sf, "part").select("p_partkey", fm.svensson(t, *(F.lit(x) for x in (0.12, -0.02, 0.01, 0.005, 0.8, 0.3))).alias("yield")), 9)


@query(f"""
WITH {CALENDAR}, bonds AS (SELECT * FROM (VALUES (1, DATE '1996-03-12', DATE '1999-01-02', 12.5, 0.10), (2, DATE '1996-03-12', DATE '1996-06-03', 11.0, 0.10), (3, DATE '1997-07-01', DATE '2002-07-01', 6.0, 0.06)) t(id, day, maturity, rate, coupon)),
f AS (SELECT *, (maturity - to_months((6 * k)::INT))::DATE AS paid FROM bonds, (SELECT unnest(range(0, 25)) AS k) WHERE (maturity - to_months((6 * k)::INT))::DATE > day),
v AS (SELECT f.id, (cb.n - ca.n) / 252.0::DOUBLE AS t, (sqrt(1 + coupon) - 1 + (paid = maturity)::INT) / pow(1 + rate / 100, (cb.n - ca.n) / 252.0::DOUBLE) AS pv FROM f JOIN cal ca ON ca.day = f.day JOIN cal cb ON cb.day = paid)
SELECT id, round(sum(t * pv) / sum(pv), 6) AS duration FROM v GROUP BY id""")
def bond_durations(spark, sf):
    rows = [(1, "1996-03-12", "1999-01-02", 12.5, 0.10), (2, "1996-03-12", "1996-06-03", 11.0, 0.10), (3, "1997-07-01", "2002-07-01", 6.0, 0.06)]
    b = spark.createDataFrame(rows, "id int, day string, maturity string, rate double, coupon double").withColumns({"day": F.to_date("day"), "maturity": F.to_date("maturity")})
    return rounded(cv.durations(b, _calendar(spark), "id"))


@query("""
WITH p AS (SELECT o_orderdate::DATE AS day, CASE WHEN o_orderkey % 2 = 0 THEN 'nominal' ELSE 'real' END AS kind, (o_custkey % 10 + 1)::DOUBLE AS years, avg(o_totalprice / 50000) AS rate FROM orders GROUP BY ALL),
t AS (SELECT unnest([2.0, 5.0])::DOUBLE AS tenor), b AS (SELECT day, kind, tenor, max(years) FILTER (years <= tenor) AS lo, min(years) FILTER (years >= tenor) AS hi FROM p, t GROUP BY ALL),
v AS (SELECT b.day, tenor, b.kind, CASE WHEN lo = hi THEN l.rate ELSE l.rate + (tenor - lo) / (hi - lo) * (h.rate - l.rate) END AS v FROM b LEFT JOIN p l ON l.day = b.day AND l.kind = b.kind AND l.years = lo LEFT JOIN p h ON h.day = b.day AND h.kind = b.kind AND h.years = hi),
w AS (SELECT day, tenor, max(v) FILTER (kind = 'nominal') AS nominal, max(v) FILTER (kind = 'real') AS real FROM v GROUP BY ALL)
SELECT day, tenor AS "at", round(nominal, 4) AS nominal, round(real, 4) AS "real", round(((1 + nominal / 100) / (1 + real / 100) - 1) * 100, 4) AS breakeven FROM w""")
def breakeven_curves(spark, sf):
    p = table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("day"), F.when(F.col("o_orderkey") % 2 == 0, "nominal").otherwise("real").alias("kind"), (F.col("o_custkey") % 10 + 1).cast("double").alias("years"), (F.col("o_totalprice") / 50000).alias("rate"))
    return rounded(cv.wide_curves(p, spark.createDataFrame([(2.0,), (5.0,)], "at double"), "day"), 4)


@query(f"""
WITH {MONTHLY} SELECT a.month, round(a.x, 6) AS x, round(b.x, 6) AS x_lag1, round(c.x, 6) AS x_lag12, round(d.x, 6) AS x_lead3, round(a.x - b.x, 6) AS diff
FROM monthly a LEFT JOIN monthly b ON b.month = (a.month - INTERVAL 1 MONTH)::DATE LEFT JOIN monthly c ON c.month = (a.month - INTERVAL 12 MONTH)::DATE LEFT JOIN monthly d ON d.month = (a.month + INTERVAL 3 MONTH)::DATE""")
def lags_and_leads(spark, sf):
    return rounded(pn.shifted(monthly_price(spark, sf), "month", "x", [1, 12, -3]).withColumn("diff", F.col("x") - F.col("x_lag1")))


@query(f"""
WITH {MONTHLY}, r AS (SELECT month, x / 1000 AS rate FROM monthly)
SELECT month, round(rate, 6) AS rate, round(CASE WHEN count(rate) OVER w = 12 THEN (exp(sum(ln(1 + rate / 100)) OVER w) - 1) * 100 END, 6) AS rate_compounded FROM r WINDOW w AS (ORDER BY month ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)""")
def compounded_rates(spark, sf):
    r = monthly_price(spark, sf).select("month", (F.col("x") / 1000).alias("rate"), F.lit(1).alias("k"))
    return rounded(pn.compounded(r, "month", "rate", 12, ["k"]).drop("k"))


TARGETS = [(1996, 4.5), (1997, 4.25), (1998, 4.0), (1999, 8.0), (2000, 6.0)]
INDEXES = f"""{MONTHLY}, t AS (SELECT * FROM (VALUES (1996, 4.5), (1997, 4.25), (1998, 4.0), (1999, 8.0), (2000, 6.0)) t(y, v)),
a AS (SELECT month, x / 25 AS e, (12 - month(month)) / 12.0 * coalesce(t0.v, CASE WHEN year(month) > 2000 THEN 6.0 END) + month(month) / 12.0 * coalesce(t1.v, CASE WHEN year(month) + 1 > 2000 THEN 6.0 END) AS m
  FROM monthly LEFT JOIN t t0 ON t0.y = year(month) LEFT JOIN t t1 ON t1.y = year(month) + 1)"""


@query(f"""
WITH {INDEXES}
SELECT month, round(m, 6) AS target_ahead, round(CASE WHEN m IS NULL THEN NULL WHEN e >= 20 OR e < 0 THEN 0 ELSE greatest(0, least(1, 1 - abs(e - m) / (20 - m))) END, 6) AS distance,
  round(CASE WHEN m IS NULL THEN NULL WHEN e >= 20 OR e < 0 THEN 0 ELSE greatest(0, least(1, CASE WHEN e > m + 1.5 THEN 1 - (e - m - 1.5) / (20 - m - 1.5) WHEN e < m - 1.5 THEN 1 - (m - 1.5 - e) / (m - 1.5) ELSE 1 END)) END, 6) AS banded FROM a""")
def credibility_indexes(spark, sf):
    t = spark.createDataFrame(TARGETS, "year int, target double")
    p = pn.target_ahead(monthly_price(spark, sf), t).withColumn("e", F.col("x") / 25)
    e, m = F.col("e"), F.col("target_ahead")
    return rounded(p.select("month", "target_ahead", fm.credibility_distance(e, m).alias("distance"), fm.credibility_band(e, m, F.lit(1.5)).alias("banded")))


@query(f"WITH {DAILY} SELECT date_trunc('month', day)::DATE AS month, round(avg(value), 6) AS mean, round(arg_max(value, day), 6) AS last, count(value) AS n FROM daily GROUP BY 1")
def monthly_resampled(spark, sf):
    return rounded(pn.last_of_month(daily_value(spark, sf), "day", "value"))


@query(f"WITH {MONTHLY} SELECT month, round((x - avg(x) OVER ()) / stddev_pop(x) OVER (), 6) AS z0, round((x - avg(x) OVER ()) / stddev_samp(x) OVER (), 6) AS z1 FROM monthly")
def standard_scores(spark, sf):
    both = with_standard_score(with_standard_score(monthly_price(spark, sf), "x", "z0"), "x", "z1", ddof=1)
    return rounded(both.select("month", "z0", "z1"))


@query("""
SELECT l_returnflag, count(*) AS n, round(corr(l_quantity, l_extendedprice), 6) AS r, round(regr_slope(l_extendedprice, l_quantity), 6) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept,
  round(corr(l_quantity, l_extendedprice) * sqrt(count(*) - 2) / sqrt(1 - corr(l_quantity, l_extendedprice) ** 2), 4) AS t FROM lineitem GROUP BY 1""")
def correlation_by_flag(spark, sf):
    c = st.correlations(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice", ["l_returnflag"])
    return c.withColumns({"r": F.round("r", 6), "slope": F.round("slope", 6), "intercept": F.round("intercept", 4), "t": F.round("t", 4)})


@query("""
WITH r AS (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0::DOUBLE AS a, rank() OVER (ORDER BY l_discount) + (count(*) OVER (PARTITION BY l_discount) - 1) / 2.0::DOUBLE AS b FROM lineitem)
SELECT count(*) AS n, round(corr(a, b), 6) AS rho FROM r""")
def spearman(spark, sf):
    return rounded(st.spearman(table(spark, sf, "lineitem"), "l_quantity", "l_discount"))


@query("""
WITH s AS (SELECT substr(o_orderpriority, 1, 1)::INT AS a, (floor(o_totalprice / 1000)::BIGINT % 5 + 1)::INT AS b FROM orders)
SELECT count(*) AS n, round(avg((a = b)::INT), 6) AS agreement, round(1 - avg((a - b) ** 2) / (var_pop(a) + var_pop(b) + (avg(a) - avg(b)) ** 2), 6) AS kappa FROM s""")
def rater_agreement(spark, sf):
    o = table(spark, sf, "orders").select(F.substring("o_orderpriority", 1, 1).cast("int").alias("a"), (F.floor(F.col("o_totalprice") / 1000) % 5 + 1).cast("int").alias("b"))
    return rounded(st.quadratic_kappa(o, "a", "b"))


@query("""
WITH r AS (SELECT o_custkey AS u, substr(o_orderpriority, 1, 1)::INT AS c, count(*) AS k FROM orders GROUP BY ALL), m AS (SELECT u, sum(k) AS m FROM r GROUP BY 1 HAVING m >= 2),
o AS (SELECT a.c AS i, b.c AS j, sum((a.k * b.k - CASE WHEN a.c = b.c THEN a.k ELSE 0 END)::DOUBLE / (m - 1)) AS o FROM r a JOIN r b USING (u) JOIN m USING (u) GROUP BY ALL),
t AS (SELECT i AS c, sum(o) AS n FROM o GROUP BY 1), g AS (SELECT c, n, sum(n) OVER (ORDER BY c) - n / 2 AS mid FROM t), s AS (SELECT sum(n) AS n FROM t),
d AS (SELECT a.c AS i, b.c AS j, (a.mid - b.mid) ** 2 AS d, a.n * b.n AS e FROM g a, g b)
SELECT round(1 - (sum(coalesce(o, 0) * d) / any_value(s.n)) / (sum(e * d) / (any_value(s.n) * (any_value(s.n) - 1))), 6) AS alpha FROM d LEFT JOIN o USING (i, j), s""")
def ordinal_alpha(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("unit"), F.substring("o_orderpriority", 1, 1).cast("int").alias("rating"))
    return rounded(st.alpha(o, "unit", "rating"))


PAIRS = "s AS (SELECT o_custkey AS unit, CASE WHEN o_orderstatus = 'F' THEN 'good' ELSE 'bad' END AS arm, substr(o_orderpriority, 1, 1)::INT AS v FROM orders)"


@query(f"""
WITH {PAIRS}, m AS (SELECT unit, avg(v) FILTER (arm = 'good') AS m0, avg(v) FILTER (arm = 'bad') AS m1 FROM s GROUP BY 1 HAVING m0 IS NOT NULL AND m1 IS NOT NULL),
p AS (SELECT count(*) AS n_pairs, avg(m1 - m0) AS d, stddev_samp(m1 - m0) AS sd FROM m),
w AS (SELECT count(*) FILTER (arm = 'good') AS n0, count(*) FILTER (arm = 'bad') AS n1, avg(v) FILTER (arm = 'good') AS a0, avg(v) FILTER (arm = 'bad') AS a1, var_samp(v) FILTER (arm = 'good') AS v0, var_samp(v) FILTER (arm = 'bad') AS v1 FROM s)
SELECT n_pairs, round(d, 6) AS mean_difference, round(d / (sd / sqrt(n_pairs)), 6) AS t_paired, round((a1 - a0) / sqrt(v0 / n0 + v1 / n1), 6) AS t_welch, round((v0 / n0 + v1 / n1) ** 2 / ((v0 / n0) ** 2 / (n0 - 1) + (v1 / n1) ** 2 / (n1 - 1)), 4) AS df_welch FROM p, w""")
def paired_and_welch(spark, sf):
    s = table(spark, sf, "orders").select(F.col("o_custkey").alias("unit"), F.when(F.col("o_orderstatus") == "F", "good").otherwise("bad").alias("arm"), F.substring("o_orderpriority", 1, 1).cast("int").alias("v"))
    out = st.paired_and_welch(s, "unit", "arm", "v", ("good", "bad"))
    return rounded(out).withColumn("df_welch", F.round("df_welch", 4))


@query("""
WITH s AS (SELECT l_quantity AS x, l_extendedprice AS y FROM lineitem), f AS (SELECT count(*) AS n, avg(x) AS mx, avg(y) AS my, regr_slope(y, x) AS b, regr_sxx(y, x) AS sxx FROM s)
SELECT n, round(b, 4) AS slope, round(my - b * mx, 3) AS intercept, round(sqrt(sum((x - mx) ** 2 * (y - my - b * (x - mx)) ** 2) * n / (n - 2)) / sxx, 5) AS se FROM s, f GROUP BY n, mx, my, b, sxx""")
def robust_regression(spark, sf):
    r = st.hc1(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice")
    return r.select("n", F.round("slope", 4).alias("slope"), F.round("intercept", 3).alias("intercept"), F.round("se", 5).alias("se"))


@query(f"""
WITH {MONTHLY}, s AS (SELECT month, x AS y, epoch(month) / 86400.0 / 365 AS t FROM monthly), f AS (SELECT count(*) AS n, avg(t) AS mt, avg(y) AS my, regr_slope(y, t) AS b, regr_sxx(y, t) AS sxx FROM s),
e AS (SELECT row_number() OVER (ORDER BY month) AS i, (t - mt) * (y - my - b * (t - mt)) AS u, n, b, sxx FROM s, f), l AS (SELECT floor(4 * (max(n) / 100.0) ** (2.0 / 9)) AS L FROM e),
g AS (SELECT sum(CASE WHEN p.i = q.i THEN p.u * q.u ELSE (1 - abs(p.i - q.i) / (L + 1)) * p.u * q.u END) AS meat FROM e p, e q, l WHERE abs(p.i - q.i) <= L)
SELECT 'trend' AS term, round(b, 6) AS coef, round(sqrt(meat) / sxx, 6) AS se, n FROM f, g""")
def newey_west(spark, sf):
    s = monthly_price(spark, sf).withColumn("trend", F.unix_date("month") / 365.0)
    return rounded(st.hac_ols(s, "month", "x", ["trend"]).where("term = 'trend'").select("term", "coef", "se", "n"))


@query("""WITH p AS (SELECT c_mktsegment AS f, c_nationkey AS k, (sum(c_custkey) % 997)::DOUBLE / 9970 AS p FROM customer GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY f ORDER BY p) AS i, count(*) OVER (PARTITION BY f) AS m FROM p)
SELECT a.f, a.k, round(a.p, 6) AS p, round(least(1, max((b.m - b.i + 1) * b.p)), 6) AS p_holm FROM r a JOIN r b ON a.f = b.f AND b.i <= a.i GROUP BY a.f, a.k, a.p""")
def holm_correction(spark, sf):
    p = table(spark, sf, "customer").groupBy(F.col("c_mktsegment").alias("f"), F.col("c_nationkey").alias("k")).agg(((F.sum("c_custkey") % 997).cast("double") / 9970).alias("p"))
    return rounded(st.holm(p, "p", ["f"]))


SCORED = f"s AS (SELECT quality AS y, 0.6 * {HASH60.format(chr(39) + 'm' + chr(39) + ' || doc_id')} + 0.4 * quality AS p FROM labels)"


def _scored(spark, sf):
    return table(spark, sf, "labels").select(F.col("quality").alias("y"), (0.6 * ids.salted_fraction(F.col("doc_id"), "m") + 0.4 * F.col("quality")).alias("p"))


@query(f"WITH {SCORED} SELECT sum(y)::BIGINT AS n_pos, (count(*) - sum(y))::BIGINT AS n_neg, round((sum(r) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))), 6) AS auc FROM (SELECT *, rank() OVER (ORDER BY p) AS r FROM s)")
def filter_auc(spark, sf):
    return rounded(st.auc(_scored(spark, sf), "p", "y"))


@query(f"""
WITH {SCORED}, k AS (SELECT p FROM (SELECT p, row_number() OVER (ORDER BY p) AS r, count(*) OVER () AS n FROM s WHERE y = 1) WHERE r = floor(0.05::DOUBLE * n + 1e-9) + 1)
SELECT round(k.p, 6) AS threshold, round(count_if(s.p >= k.p AND y = 1) / sum(y), 6) AS sensitivity, round(avg((s.p < k.p)::INT), 6) AS discarded FROM s, k GROUP BY k.p""")
def filter_threshold(spark, sf):
    return rounded(st.threshold(_scored(spark, sf), "p", "y"))


@query(f"""
WITH {DAILY}, ev AS (SELECT day FROM daily)
SELECT ev.day, coalesce(sum(n) FILTER (d.day < ev.day), 0)::BIGINT AS n_before, coalesce(sum(n) FILTER (d.day > ev.day), 0)::BIGINT AS n_after,
  round(CASE WHEN sum(n) FILTER (d.day < ev.day) >= 3 AND sum(n) FILTER (d.day > ev.day) >= 3 THEN sum(value) FILTER (d.day > ev.day) / sum(n) FILTER (d.day > ev.day) - sum(value) FILTER (d.day < ev.day) / sum(n) FILTER (d.day < ev.day) END, 6) AS delta
FROM ev LEFT JOIN daily d ON d.day BETWEEN ev.day - 7 AND ev.day + 7 GROUP BY ev.day""")
def event_changes(spark, sf):
    d = daily_value(spark, sf)
    return rounded(st.window_change(d.select("day"), d, "day", "value", 7))


@query(f"""
WITH {DAILY}, ch AS (SELECT e.day, sum(d.value) FILTER (d.day > e.day) / sum(d.n) FILTER (d.day > e.day) - sum(d.value) FILTER (d.day < e.day) / sum(d.n) FILTER (d.day < e.day) AS delta FROM daily e JOIN daily d ON d.day BETWEEN e.day - 7 AND e.day + 7 GROUP BY e.day)
SELECT a.day, round(a.delta, 6) AS delta, round(avg((abs(b.delta) >= abs(a.delta))::INT), 6) AS placebo_share FROM ch a, ch b WHERE b.delta IS NOT NULL GROUP BY a.day, a.delta""")
def event_placebo(spark, sf):
    d = daily_value(spark, sf)
    change = st.window_change(d.select("day"), d, "day", "value", 7, least=0)
    return rounded(st.placebo_share(change.select("day", "delta"), change))


@query()
def latent_weight(spark, sf):
    m = monthly_price(spark, sf).orderBy("month")
    p = m.withColumns({"d": F.sin(F.month("month")) * 3, "y": (F.col("x") - 250) / 100})
    return rounded(st.latent_weight(p, "month", "y", "d"))


@query("""
WITH p AS (SELECT vec_id, [1 / (1 + exp(-embedding[i]::DOUBLE * 8)) FOR i IN range(1, 5)] AS p, label % 5 + 1 AS y FROM embeddings)
SELECT vec_id, array_to_string([(y > j)::INT FOR j IN range(1, 5)], ',') AS targets, (1 + len(list_filter(p, lambda x: x > 0.5)))::INT AS label, round(1 + list_sum(p), 6) AS mean FROM p""")
def ordinal_decoding(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.transform(F.slice("embedding", 1, 4), lambda x: fm.logistic(x.cast("double") * 8)).alias("p"), (F.col("label") % 5 + 1).alias("y"))
    return rounded(e.select("vec_id", F.array_join(fm.ordinal_targets(F.col("y")).cast("array<string>"), ",").alias("targets"), fm.ordinal_label(F.col("p")).alias("label"), fm.ordinal_mean(F.col("p")).alias("mean")))


#: Periods of the windows of which robustness_table has the series.
WINDOWS = [1, 3]


@query(f"""
WITH {ITEMS}, rec AS (SELECT -1 AS left_out UNION ALL SELECT DISTINCT outlet FROM items), win AS (SELECT unnest([1, 3]) AS w),
lv AS (SELECT left_out, w, (date_trunc('month', day) + to_months(k::INT))::DATE AS period, wire, kind, avg((d1 - 1) / 4.0) AS c FROM items, rec, win, range(3) t(k) WHERE k < w AND outlet <> left_out AND d1 IS NOT NULL GROUP BY ALL),
ends AS (SELECT left_out, max(date_trunc('month', day))::DATE AS last FROM items, rec WHERE outlet <> left_out GROUP BY 1),
s AS (SELECT left_out, w, period, avg(c) AS level, count(*) AS m FROM lv JOIN ends USING (left_out) WHERE period <= last GROUP BY ALL), b AS (SELECT w, period, level AS base FROM s WHERE left_out = -1)
SELECT left_out, median(m)::DOUBLE AS median_n, count(*) AS n, round(corr(level, base), 6) AS r, round(avg(level - base), 6) AS mean_diff, round(avg(abs(level - base)), 6) AS mean_abs_diff, w AS "window"
FROM s JOIN b USING (w, period) WHERE left_out >= 0 GROUP BY left_out, w""")
def robustness_table(spark, sf):
    i, out = items(spark, sf), None
    for back in WINDOWS:
        base = ix.periodic_index(i, back).select("period", "level")
        rows = st.series_agreement(ix.levels_without(i, back), base, "period", "level", ["left_out"], "n_items").withColumn("window", F.lit(back))
        out = rows if out is None else out.unionByName(rows)
    return rounded(out)


@query(f"""
WITH {ITEMS}, w AS (SELECT date_trunc('month', day)::DATE AS period, wire, kind, avg((d1 - 1) / 4.0) AS c FROM items WHERE d1 IS NOT NULL GROUP BY ALL), a AS (SELECT period, kind, avg(c) AS level FROM w GROUP BY ALL)
SELECT period, round(max(level) - min(level), 6) AS gap FROM a GROUP BY period HAVING count(*) > 1 ORDER BY max(level) - min(level) DESC, period LIMIT 5""")
def largest_divergence(spark, sf):
    # the months in which the kinds' series lie furthest apart
    by_kind = ix.collapsed(ix.in_periods(items(spark, sf))).groupBy("period", "kind").agg(F.avg("c").alias("level"))
    gaps = by_kind.groupBy("period").agg((F.max("level") - F.min("level")).alias("gap"), F.count("*").alias("k")).where("k > 1")
    return rounded(gaps.select("period", "gap").orderBy(F.desc("gap"), "period").limit(5))


@query(f"WITH {MONTHLY} SELECT round(quantile_cont(x, 0.05), 6) AS p05, round(quantile_cont(x, 0.5), 6) AS p50, round(quantile_cont(x, 0.95), 6) AS p95, (SELECT mode(o_orderstatus) FROM orders) AS most FROM monthly")
def percentiles(spark, sf):
    p = monthly_price(spark, sf).agg(*(F.percentile("x", q).alias(n) for n, q in (("p05", 0.05), ("p50", 0.5), ("p95", 0.95))))
    return rounded(p.crossJoin(table(spark, sf, "orders").agg(F.mode("o_orderstatus").alias("most"))))
