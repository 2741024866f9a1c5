"""Normal forms, masks and numbers against expected values that don't come from the operators' tables."""

import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from folio.functions import text


def plain_norm(t):
    return "".join(c for c in unicodedata.normalize("NFKD", t.lower()) if not unicodedata.combining(c))


def plain_key(t):
    import re

    bare = unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode().lower()
    return re.sub(r"\s+", " ", re.sub(r"[^a-z0-9 ]", " ", bare)).strip()


def odd_texts():
    rnd = random.Random(3)
    alphabet = "aZ é ñ Ő ﬁ º ā Ş ½ ǅ İ ß Σς ½ ² ﬀ … — “ ” е й 한 글 ｶ ﷺ \u0301 \u0323 \n\t \u00a0 \u2003 № ™ Å K".replace(" ", "") + " "
    return ["", "Ação, já!  É  isso", "ﬁm nº 3 ½ ā", "Ő ﬁ º ā Ş"] + ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, 25))) for _ in range(300)]


def test_normal_forms_are_those_of_unicode(spark):
    rows = [(i, t) for i, t in enumerate(odd_texts())]
    s = F.col("s")
    got = spark.createDataFrame([*rows, (-1, None)], "i int, s string").select("i", text.norm(s).alias("n"), text.text_key(s).alias("k")).collect()
    got = {r.i: (r.n, r.k) for r in got}
    assert got.pop(-1) == (None, None)
    assert {i: g for i, g in got.items() if g != (plain_norm(rows[i][1]), plain_key(rows[i][1]))} == {}


def test_text_hash_is_of_title_and_lead(spark):
    import hashlib

    df = spark.createDataFrame([("Ação!", "É  isso"), ("acao", None)], "t string, l string")
    got = [r.h for r in df.select(text.text_hash(F.col("t"), F.col("l")).alias("h")).collect()]
    assert got == [hashlib.sha1(b).hexdigest()[:16] for b in (b"acao|e isso", b"acao|")]


@pytest.mark.parametrize(("level", "given", "expected"), [
    (4, "Selic sobe para 14,25% diz BC em maio de 2015. Dólar fechou a R$ 4,10 e o IPCA acumula 10,67% no ano.", "Selic sobe para [SELIC_NIVEL] diz BC em maio de [DATA]. Dólar fechou a [CAMBIO_NIVEL] e o IPCA acumula [IPCA_NIVEL] no ano."),
    (4, "Campos Neto disse em 2022 que a Selic foi a 13,75%.", "[AUTORIDADE_BC] disse em [DATA] que a Selic foi a [SELIC_NIVEL]."), (4, "PIB de R$ 1.234,56", "PIB de [PIB_NIVEL]"), (3, None, ""),
    (5, "Ontem o Copom e o BC viram o ministro João da Silva Neto, com 3,5 p.p. na pandemia", "Ontem o Copom e o BC viram o ministro [NOME], com [NUM] na [EPOCA]"), (2, "Lula e CAMPOS NETO; camposneto", "Lula e [AUTORIDADE_BC]; camposneto"), (3, "temer Temer TEMER", "temer [POLITICO] [POLITICO]"),
])
def test_masks(spark, level, given, expected):
    df = spark.createDataFrame([(given,)], "s string")
    out = text.masked(F.col("s"), level, ["Campos Neto", "Roberto Campos Neto"], ["Temer", "Lula"] if level != 2 else [], ["pandemia"])
    assert df.select(out.alias("m")).first().m == expected


def test_names_that_meet_are_masked_longest_first(spark):
    df = spark.createDataFrame([("Roberto Campos Neto Silva",)], "s string")
    got = df.select(text.masked(F.col("s"), 2, ["Roberto Campos", "Campos Neto Silva"]).alias("m")).first().m
    assert got == "Roberto [AUTORIDADE_BC]"


def test_numbers(spark):
    want = {"1.008": 1008.0, "6,2791": 6.2791, "3,58E-02": 0.0358, "1.5E3": 1500.0, "-0,5": -0.5, "x": None, "": None, " 1.234,5 ": 1234.5}
    df = spark.createDataFrame([(s,) for s in want], "s string")
    assert {r.s: r.v for r in df.select("s", text.number(F.col("s")).alias("v")).collect()} == want
