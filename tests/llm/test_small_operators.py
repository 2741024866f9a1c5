import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from folio.llm import decontaminate, shards, url_filter, warc
from folio.llm.files import Ranges


def test_blocks_reach_aliases_and_allow_wins(spark):
    link = '<link rel="canonical" href="{}">'
    pages = [
        (1, "http://bad.net/x", None), (2, "http://a.info/1", link.format("http://bad.net/x")), (3, "http://a.info/2#f", '<meta http-equiv="refresh" content="0; url=/1">'),
        (4, "https://s.org/fr/p", link.format("http://bad.net/x")), (5, "http://c.info/", link.format("http://d.info/")), (6, None, None), (7, "no scheme", link.format("http://bad.net/x")), (8, "HTTP://EXAMPLE.net/en/?q", ""),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.page_id: (r.host, r.rule, r.verdict) for r in url_filter.filter_urls(df, url_filter.RULES).collect()}
    assert got == {
        1: ("bad.net", "net/", "block"), 2: ("a.info", None, "block"), 3: ("a.info", None, "block"), 4: ("s.org", "org/fr/", "allow"),
        5: ("c.info", None, "allow"), 6: ("", None, "allow"), 7: ("", None, "allow"), 8: ("example.net", "example.net/en/", "allow"),
    }


def test_relative_and_repeated_links_carry_blocks(spark):
    link = '<link rel="canonical" href="{}">'
    to = {  # a page's html, and the url that it makes an alias of
        "http://a.info/a/b": (link.format("?id=3"), "http://a.info/a/b?id=3"), "http://b.info/a/b/c": (link.format("../x"), "http://b.info/a/x"),
        "http://c.info/a/b": (link.format("./x"), "http://c.info/a/x"), "http://d.info/a/b/": (link.format("../../../c/./.."), "http://d.info/"),
        "http://e.info/1": (link.format("/2") + link.format("/3"), "http://e.info/3"), "http://f.info": (link.format("?q"), "http://f.info/?q"),
        "http://g.info/1": ('<meta http-equiv="refresh" content="0; url=/2"> <META HTTP-EQUIV=refresh content="1; url=/a/../3">', "http://g.info/3"),
        "http://h.info/.x/..y/1": (link.format("2?z=/../"), "http://h.info/.x/..y/2?z=/../"),
    }
    pages = [(u, html) for u, (html, _) in to.items()] + [(v, link.format("http://bad.net/x")) for _, v in to.values()] + [("http://bad.net/x", "")]
    got = {r.url: r.verdict for r in url_filter.filter_urls(spark.createDataFrame(pages, "url string, html string"), url_filter.RULES).collect()}
    assert got == {u: "block" for u, _ in pages}


def test_warc_round_trip(spark):
    big = "é" * 600
    pages = [(1, "http://a/\r\nX: y", big), (2, None, big), (9, "http://c/", big), (4, "http://d/", "small"), (5, "http://e/", "small"), (6, "u", None)]
    index = warc.write_warc(spark.createDataFrame(pages, "page_id long, url string, html string"))
    got = {r.page_id: r for r in warc.read_warc(index).collect()}
    for i, _, html in pages:
        data = (html or "").encode()
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(data), hashlib.sha1(data).hexdigest())
        assert got[i].record_type == ("revisit" if i in (1, 2) else "response") and got[i].refers_to == (9 if i in (1, 2) else None)
        assert got[i].payload == (None if i in (1, 2) else data)
    assert got[1].url == "http://a/\r\nX: y" and got[2].url is None


def test_warc_of_odd_rows(spark):
    big = "x" * 1000
    pages = [(None, "http://a b/ü", big, 1), (None, "http://a b/ü", big, 2), (3, "u", big, 3), (3, "u", big, 4), (2, "v", big, 5), (7, "w", "short", 6), (8, "z", "y" * 300_000, 7), (None, None, None, 8)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, digest int")
    index = warc.write_warc(df)
    rows = warc.read_warc(index).collect()
    assert sorted((str(r.page_id), r.record_type, r.refers_to) for r in rows) == sorted([("None", "response", None)] * 3 + [("3", "response", None)] * 2 + [("2", "revisit", 3), ("7", "response", None), ("8", "response", None)])
    assert sorted(str(r.url) for r in rows) == sorted(str(p[1]) for p in pages) and max(len(r.payload or b"") for r in rows) == 300_000
    ids = set()
    files = Ranges()
    for r in index.collect():
        raw = zlib.decompress(files.read(r.archive, r.offset, r.length), 31)
        ids.add(re.search(rb"WARC-Record-ID: (\S+)", raw)[1])
    assert len(ids) == len(pages)
    assert warc.read_warc(warc.write_warc(df.limit(0))).collect() == []
    some = index.where("page_id = 3 or page_id = 8")
    assert sorted(r.page_id for r in warc.read_warc(some).collect()) == [3, 3, 8]


def plain_verdicts(pages):
    """(url, targets) of each page -> verdict by rules, else by aliases reached over links in either direction."""
    def rule(u):
        m = re.match(r"[a-z]+://([^/?#]*)([^?#]*)", u.lower())
        fits = [(len(h + p), a == "allow", a) for a, h, p in url_filter.RULES if m and (m[1] == h or m[1].endswith("." + h)) and m[2].startswith(p)]
        return max(fits)[2] if fits else None

    near = {}
    for u, targets in pages:
        for t in targets:
            near.setdefault(u, set()).add(t)
            near.setdefault(t, set()).add(u)
    out = []
    for u, _ in pages:
        seen, todo = {u}, [u]
        while todo:
            todo += [x for x in near.get(todo.pop(), ()) if x not in seen and not seen.add(x)]
        out.append((u, rule(u) or ("block" if any(rule(x) == "block" for x in seen) else "allow")))
    return sorted(out)


def test_aliases_against_brute_force(spark):
    rnd = random.Random(8)
    hosts = ["a.info", "b.info", "c.org", "bad.net", "example.net", "d.example.com"]
    urls = [f"http://{rnd.choice(hosts)}/{rnd.choice(['en', 'de', 'fr', 'x'])}/{i}" for i in range(60)]
    pages = [(u, [rnd.choice(urls) for _ in range(rnd.choice([0, 0, 1, 1, 2, 3]))]) for u in urls]
    pages += [("http://a.info/y/1", ["http://a.info/y/2"]), ("http://a.info/y/2", ["http://a.info/y/3"]), ("http://a.info/y/3", ["http://a.info/y/1"]), pages[0], pages[1]]
    link = lambda t, i: f'<LINK REL="canonical" class=x href="{t}">' if i % 2 else f"<meta content='0; URL={t}' http-equiv='Refresh'>"
    rows = [(u, "<p>" * (50_000 if n == 3 else 3) + "".join(link(t, i) for i, t in enumerate(ts)), "mine", "x") for n, (u, ts) in enumerate(pages)]
    df = spark.createDataFrame(rows, "url string, html string, host string, node__ string")
    out = url_filter.filter_urls(df, url_filter.RULES)
    assert sorted((r.url, r.verdict) for r in out.collect()) == plain_verdicts(pages) and out.columns.count("host") == 1 and "node__" in out.columns
    empty = url_filter.filter_urls(df.limit(0), url_filter.RULES)
    assert empty.collect() == [] and set(out.columns) == set(empty.columns)
    more = url_filter.filter_urls(spark.createDataFrame([("http://q.info/", None)], "url string, html string"), url_filter.RULES, redirects=spark.createDataFrame([("http://q.info/", "http://bad.net/")], "u string, v string"))
    assert more.first().verdict == "block"


def test_shards_of_the_query(spark, tmp_path):
    docs = [(i * 7 % 50, f"text {i} é", "s") for i in range(100)] + [(1000, None, "s"), (1001, "l" * 300_000, None), (None, "no id", "s"), (3, "text 9 é", "t"), (3, "text 9 é", "t")]
    df = spark.createDataFrame([(*d, 7, "k") for d in docs], "doc_id long, text string, source string, shard int, `place.__` string").repartition(3)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    rows = shards.op2_shards(spark, str(tmp_path)).collect()
    plain = lambda t: (len((t or "").encode()) + 8, zlib.crc32((t or "").encode()))
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in rows) == sorted((str(i), *plain(t)) for i, t, _ in docs)
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values()) and set(by) <= set(range(24)) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    again = {(r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in shards.op2_shards(spark, str(tmp_path)).collect()}
    assert again == {(r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in rows}
    wide = shards.shard_rows(spark.read.parquet(f"{tmp_path}/documents.parquet"), ["doc_id", "text"], 5)
    assert "place.__" in wide.columns and wide.count() == len(docs)


def test_short_items_and_overlaps(spark):
    item = " ".join(f"w{i}" for i in range(15))
    docs = spark.createDataFrame([(1, f"X {item.upper()} y"), (2, "one TWO, three"), (3, None), (4, ""), (5, "nothing here")], "doc_id long, text string")
    bench = spark.createDataFrame([(10, item), (2, "two three"), (3, None), (4, "...")], "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.item_ids, r.contaminated, r.clean_text) for r in decontaminate.scan_documents(docs, bench, clean=True).collect()}
    assert got[1] == (17, 15, ["10"], True, "X  y") and got[2] == (3, 2, ["2"], True, "one ")
    assert got[3] == (0, 0, [], False, None) and got[4][:4] == (0, 0, [], False) and got[5][:4] == (2, 0, [], False)


def test_permutation_and_shards(spark):
    for n in (1, 2, 5, 64, 1000):
        assert sorted(shards.permute(np.arange(n), n).tolist()) == list(range(n))
    df = spark.createDataFrame([(i % 50, i) for i in range(101)] + [(None, 7)], "doc_id long, v long")
    rows = shards.shard_rows(df, ["doc_id", "v"], 24).collect()
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
    assert len(rows) == 102 and all(sorted(s) == list(range(len(s))) for s in by.values()) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert shards.shard_rows(df.limit(0), ["doc_id", "v"], 24).collect() == []


def plain_decontamination(docs, bench, window=13):
    """docs: (doc_id, text), bench: (item_id, text) -> {doc_id: (n_words, n_hit, n_items, item_ids)}"""
    words = lambda t: re.findall(rb"[a-z0-9\x80-\xff]+", (t or "").encode().lower())
    windows = {}
    for i, t in bench:
        w = words(t)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            windows.setdefault(tuple(w[k : k + window]), set()).add(i)
    out = {}
    for d, t in docs:
        w, hit, items = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if found := windows.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    items |= found
        out[d] = (len(w), len(hit), len(items), sorted(str(i) for i in items if i is not None))
    return out


@pytest.mark.parametrize("most", [decontaminate.MOST_BYTES, 400])
def test_decontamination_whole_and_in_parts(spark, most):
    rnd = random.Random(6)
    vocabulary = ["é" if i == 0 else f"v{i}" for i in range(12)]
    text = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    shared = text(40)
    bench = [(i, text(rnd.choice([0, 1, 2, 5, 13, 14, 30]))) for i in range(25)] + [(100, shared), (101, shared), (None, shared), (None, text(3)), (102, None), (103, "...")]
    docs = [(i, text(rnd.choice([0, 1, 3, 12, 40, 200])) + (" " + shared[3 * (i % 5) :].title() if i % 3 == 0 else "")) for i in range(40)] + [(50, None), (51, "")]
    docs += [(60, ("long " * 20_000) + shared), (61, docs[3][1])]
    df = spark.createDataFrame([(*d, "x", True) for d in docs], "doc_id long, text string, `a``b` string, scan__ boolean").repartition(3)
    b = spark.createDataFrame(bench, "item_id long, text string")
    assert (decontaminate.benchmark_parts(b, most=most)[0] > 3) == (most == 400)
    got = decontaminate.scan_documents(df, b, most=most)
    assert {"a`b", "scan__"} <= set(got.columns)
    assert {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.item_ids) for r in got.collect()} == plain_decontamination(docs, bench)
    assert decontaminate.scan_documents(df.limit(0), b, most=most).collect() == []
    clean = decontaminate.scan_documents(df, b.limit(0), most=most).collect()
    assert len(clean) == len(docs) and not any(r.n_hit or r.n_items or r.contaminated for r in clean)


def test_a_window_set_is_small():
    items = [(i, " ".join(f"word{(i * 7 + k * k) % 5000}" for k in range(200))) for i in range(300)]
    size = sum(len(t) for _, t in items)
    assert decontaminate.WindowSet(items).nbytes() < 7 * size
