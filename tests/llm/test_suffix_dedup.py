import random

import numpy as np
import pyarrow as pa
import pytest

from folio.llm import suffix_dedup as S

from .brute import repeated


def rows(spark, docs, **kw):
    df = spark.createDataFrame(docs, "doc_id long, text string")
    out = {}
    for r in S.repeated_spans(df, **kw).collect():
        data = (r.text or "").encode()
        import hashlib

        spans = [(s.start, s.end) for s in r.spans]
        out[r.doc_id] = (len(data), sum(b - a for a, b in spans), len(spans), hashlib.sha256(S.without_spans(data, spans)).hexdigest())
    return out


def corpus(seed=3):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 6)))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(40) for _ in range(5)]
    docs = []
    for i in range(120):
        parts = [text(rnd.randint(0, 60))]
        for _ in range(rnd.randint(0, 3)):
            p = rnd.choice(passages)
            a = rnd.randint(0, 60)
            parts += [p[a : a + rnd.randint(60, 200)], text(rnd.randint(0, 30))]
        docs.append((i * 7 % 120, " ".join(parts)))
    docs += [(200, "a" * 400), (201, "a" * 150), (202, "ab" * 200), (203, ""), (204, None), (205, docs[3][1]), (206, docs[3][1] + "x"), (207, "z" * 99), (208, "z" * 100), (209, "z" * 101), (None, docs[5][1])]
    return docs


@pytest.mark.parametrize(("hot", "bucket"), [(S.HOT_ANCHOR, S.BUCKET), (3, 50)])
def test_against_brute_force(spark, hot, bucket, monkeypatch):
    monkeypatch.setattr(S, "MOST_BUCKETS", 4)
    monkeypatch.setattr(S, "BUCKET", bucket)
    docs = corpus()
    assert rows(spark, docs, hot=hot) == repeated(docs)


def test_windows_of_one_hash_are_told_apart_by_their_bytes(monkeypatch):
    strings = [b"a" * 100 + b"b", b"a" * 100 + b"c", b"x" * 101]
    monkeypatch.setattr(S, "_window_hash", lambda grams, at, length: np.zeros(len(at), np.uint64))
    batch = pa.RecordBatch.from_arrays([pa.array([5] * 3), pa.array([1, 2, 3]), pa.array([0, 10, 0]), pa.array([2] * 3), pa.array(strings)], names=["key", "doc", "first", "n", "data"])
    got = [tuple(r.values()) for b in S._later_windows([batch], 100) for r in b.to_pylist()]
    assert got == [(2, 10, 11), (3, 1, 2)]


def test_a_removal_that_cuts_through_a_character(spark):
    rnd = random.Random(2)
    body = "".join(rnd.choice("abcdefgh ") for _ in range(120))
    docs = [(1, "é" + body, "s"), (2, "z©" + body, None), (3, None, "s"), (4, "é" + body, "t")]  # é and © end in the same byte
    df = spark.createDataFrame(docs, "doc_id long, text string, doc__ string")
    assert sorted((r.doc_id, r.text, r.doc__) for r in S.remove_repeats(df).collect()) == [(1, "é" + body, "s"), (2, "z", None), (3, None, "s")]
    plain = [(i, t) for i, t, _ in docs]
    assert rows(spark, plain) == repeated(plain)


def test_long_text_over_many_blocks(spark, monkeypatch):
    rnd = random.Random(1)
    base = "".join(rnd.choice("abcdefgh ") for _ in range(300_000))
    docs = [(1, base), (2, base[1000:290_000] + "q" + base[:500]), (3, "x" + base[262_000:263_000])]
    assert rows(spark, docs) == repeated(docs)


def test_empty_clashing_and_repeated(spark):
    assert rows(spark, []) == {}
    df = spark.createDataFrame([(1, "k" * 300, "x", "y"), (1, "k" * 300, "x", "y")], "doc_id long, text string, spans string, doc__ string")
    got = S.repeated_spans(df).collect()
    assert [(r.doc__, [tuple(s) for s in r.spans]) for r in got] == [("y", [(1, 300)])] * 2


def test_multikey_order():
    rng = np.random.default_rng(0)
    keys = [rng.integers(0, 4, 500) for _ in range(4)]
    assert (S.multikey_order(keys) == np.lexsort(keys[::-1])).all()
