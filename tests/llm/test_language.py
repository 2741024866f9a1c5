import pytest

from folio.llm import language


def test_rare_languages_are_known_and_copies_count_once(spark):
    rows = [(f"the house number {i} of the street", "EN") for i in range(400)] + [("copies " * 5, "en")] * 300 + [(f"das haus nummer {i}", "de") for i in range(3)]
    rows += [("123 456", "zz"), (None, "fr"), ("ohne", None), ("", "es"), ("żółw", "pl")]
    model = language.fit(spark.createDataFrame(rows, "text string, lang string"), sample=20)
    assert model.languages == ("de", "en", "pl")
    assert language.fit(spark.createDataFrame(rows, "text string, lang string"), ["de"], sample=20).languages == ("de",)
    assert language.fit(spark.createDataFrame([], "text string, lang string")).languages == ()


def test_sample_is_the_least_hashes_of_distinct_texts(spark):
    texts = [f"word{i} and other{i % 7}" for i in range(300)]
    df = spark.createDataFrame([(t, x) for t in texts for x in ("en", "en", "fr")], "text string, lang string")
    hashes = {r.text: r.h for r in df.distinct().selectExpr("text", "xxhash64(text) AS h").collect()}
    taken = sorted(texts, key=hashes.get)[:50]
    plain = language.fit(spark.createDataFrame([(t, x) for t in taken for x in ("en", "fr")], "text string, lang string"))
    assert (language.fit(df, sample=50).logs == plain.logs).all()


def test_page_language_weighs_all_evidence(spark, tmp_path):
    en = "the house and the garden of the old man were green in the summer and the river was near".split()
    fr = "la maison et le jardin du vieil homme étaient verts en été et la rivière était proche".split()
    line = lambda w, i, n: " ".join(w[(i * 5 + k * (i % 3 + 1)) % len(w)] for k in range(n))
    docs = [(i, line(en, i, 40), "en", "s") for i in range(30)] + [(100 + i, line(fr, i, 40), "fr", "s") for i in range(30)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    page = lambda text, lang="": f"<html{lang}><script>var the = 'the the the'</script><body><p>{text}</p></body></html>"
    pages = [(i, f"http://www.a.fr/{i}", page(line(fr, i, 30))) for i in range(20)]
    pages += [(20, "http://b.info/", page(line(en, 3, 30))), (21, "http://b.info/x", page("la", ' lang="en-GB"')), (22, "http://www.a.fr/z", page("la")), (23, "http://c.de/", page("12 34")), (24, None, None)]
    pages += [(25, "http://b.info/y", page(line(en, 5, 60), " lang=fr"))]
    spark.createDataFrame([(*p, "mine") for p in pages], "page_id long, url string, html string, language string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: r for r in language.page_language(spark, str(tmp_path)).collect()}
    assert len(got) == len(pages) and {got[i].language for i in range(20)} == {"fr"} and got[20].language == "en"
    assert got[21].markup == "en" and got[22].language == "fr"  # host and suffix decide about a text of one word
    assert got[23].language == got[24].language == "und" and got[24].host == ""
    assert got[25].language == "en"  # sixty words outweigh a wrong declaration
    assert all(0 < r.probability <= 1 for r in got.values())


def test_host_priors_are_smoothed_by_domain_and_corpus(spark):
    model = language.TextModel.from_counts({("en", 1): 5, ("fr", 2): 5})
    rows = [("h1", "d1", [0.0, -1.0, -2.0])] * 8 + [("h1", "d1", [-1.0, 0.0, -2.0])] * 2 + [("h2", "d1", [-1.0, 0.0, -2.0])] + [(None, None, [0.0, -1.0, -2.0])]
    df = spark.createDataFrame(rows, "h string, d string, logs array<double>")
    got = {r.host: list(r.prior) for r in language.host_priors(df, model, "h", "d", "logs").collect()}
    whole = [(9 + 1) / 15, (3 + 1) / 15, 1 / 15]
    domain = [(n + 5 * w) / (11 + 5) for n, w in zip((8, 3, 0), whole)]
    assert got["h1"] == pytest.approx([(n + 5 * p) / 15 for n, p in zip((8, 2, 0), domain)])
    assert got["h2"] == pytest.approx([(n + 5 * p) / 6 for n, p in zip((0, 1, 0), domain)]) and set(got) == {"h1", "h2", None}


def test_odd_columns_and_texts(spark):
    rows = [(1, "the house of the man " * 5, "en", "s", 1), (2, "la maison de l'homme " * 5, "fr", "s", 1), (2, "la maison de l'homme " * 5, "fr", "s", 1), (3, None, None, None, 1), (4, "", "en", "s", 1), (5, "the man " * 40_000, "en", "s", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, `probability.x` int")
    out = language.with_language(df)
    got = sorted((r.doc_id, r.language, r.accepted) for r in out.collect())
    assert got == [(1, "en", True), (2, "fr", True), (2, "fr", True), (3, "und", False), (4, "und", False), (5, "en", True)] and "probability.x" in out.columns
