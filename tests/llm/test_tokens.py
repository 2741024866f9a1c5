import random
import zlib

import numpy as np
import pytest

from folio.llm import packing, token_files
from folio.llm.files import Ranges
from folio.llm.tokens import WordTokenizer

P = pytest.importorskip("public_tokenizers")
ODD = ["", " ", "  a", "a b.c, d.. e!* f9, g), İ. İstanbul, ﬁ. x²! ... a's, b.'t,", "\0 a\0 \0", "tail ", "a  b\n\n c", "a\x1c b \x1cc", "日本 語 é é", "<|endoftext|> x"]


def texts(n=400):
    rnd = random.Random(4)
    return ODD + ["".join(rnd.choice(" \n\tab1.,é's!​") for _ in range(rnd.randint(0, 60))) for _ in range(n)]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_same_ids_as_the_library(name):
    t = WordTokenizer(P.path(name))
    for _ in range(2):  # unknown parts, then known ones
        got = t.encode(texts(), 7)
        want = t.library.encode_batch(texts(), add_special_tokens=False)
        assert [x.tolist() for x in got] == [[*w.ids, 7] for w in want]


def test_segment_round_trip():
    rng = np.random.default_rng(0)
    docs = [rng.integers(0, top, n).astype(np.uint32) for top, n in ((100, 5), (300, 1000), (1 << 17, 3000), (1 << 32, 700), (1, 0), (256, 513))]
    s = token_files.Segment.of_bytes(token_files.encode_segment([1, None, 3, 4, 5, 6], docs))
    s.check()
    assert s.doc_ids() == [1, None, 3, 4, 5, 6]
    assert all((s.document(k) == d).all() for k, d in enumerate(docs))
    whole = np.concatenate(docs)
    assert [s.token(i) for i in range(0, len(whole), 37)] == whole[::37].tolist()
    assert all((s.tokens(a, b) == whole[a:b]).all() for a, b in ((0, 0), (3, 9), (511, 513), (1000, 4100), (len(whole) - 1, len(whole))))


def test_a_token_is_read_by_a_few_bytes(tmp_path):
    ids = np.random.default_rng(1).integers(0, 50_000, 500_000).astype(np.uint32)
    data = token_files.encode_segment([1], [ids])
    (tmp_path / "f").write_bytes(b"other" + data)
    files = Ranges()
    asked = []
    read = files.read
    files.read = lambda uri, at, n: asked.append(n) or read(uri, at, n)
    s = token_files.open_segment(files, f"{tmp_path}/f", 5)
    header = sum(asked)
    for i in (0, 1, 77_777, 499_999):
        asked.clear()
        assert s.token(i) == ids[i] and sum(asked) < 200
    assert header < 600 and len(data) > 900_000
    files.close()


def test_damaged_segment():
    data = bytearray(token_files.encode_segment([1], [np.arange(50, dtype=np.uint32)]))
    data[-1] ^= 1
    with pytest.raises(ValueError):
        token_files.Segment.of_bytes(bytes(data)).check()
    data[30] ^= 1
    with pytest.raises(ValueError):
        token_files.Segment.of_bytes(bytes(data))
    with pytest.raises(ValueError):
        token_files.Segment.of_bytes(b"x" * 40)


@pytest.mark.parametrize("lengths", [[], [1], [4096], [5000], [3000] * 3, [1] * 9000, [20_000, 1, 7]])
def test_pack_holds_each_id_once(lengths):
    pieces = packing.pack(lengths)
    by_seq, by_doc = {}, {}
    for d, start, n, s, offset in pieces:
        by_seq.setdefault(s, []).append((offset, n))
        by_doc.setdefault(d, []).append((start, n))
    for parts in (*by_seq.values(), *by_doc.values()):
        at = 0
        for a, n in sorted(parts):
            assert a == at and n > 0
            at += n
    assert {d: sum(n for _, n in x) for d, x in by_doc.items()} == {i: n for i, n in enumerate(lengths) if n}
    used = sorted(sum(n for _, n in x) for x in by_seq.values())
    assert all(u <= 4096 for u in used) and all(u == 4096 for u in used[1:])


def test_files_and_pieces_from_documents(spark):
    docs = [(i * 7 % 23, t) for i, t in enumerate(texts(10))] + [(100, None), (None, "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    t = WordTokenizer(P.path("byte_bpe_50k.json"))
    order = sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0, d[1] or ""))
    want, at = [], 0
    for i, x in order:
        ids = np.array([*t.library.encode(x or "", add_special_tokens=False).ids, 0], "<u4")
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    got = token_files.read_token_files(token_files.write_token_files(df, P.path("byte_bpe_50k.json"), 0))
    assert sorted(map(tuple, got.collect()), key=lambda r: r[1]) == want
    pieces = packing.pack_documents(df, P.path("word_bpe_49k.json"), 2, with_ids=True).collect()
    w = WordTokenizer(P.path("word_bpe_49k.json"))
    assert all(zlib.crc32(np.array(p.ids, "<u4").tobytes()) == p.ids_crc32 for p in pieces)
    whole = {i: [*w.library.encode(x or "", add_special_tokens=False).ids, 2] for i, x in docs}
    for i, x in whole.items():
        own = sorted((p for p in pieces if p.doc_id == i), key=lambda p: p.start)
        assert [t for p in own for t in p.ids] == x and all(p.doc_tokens == len(x) for p in own)


def test_long_repeated_and_clashing_documents(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(token_files, "SEGMENT_TOKENS", 500)
    long_ = " ".join(f"word{i % 700}" for i in range(9000))
    docs = [(5, long_, "p"), (3, "same", "p"), (3, "same", "q"), (3, None, None), (9, "", "r")]
    df = spark.createDataFrame(docs, "doc_id long, text string, part string").repartition(2)
    t = WordTokenizer(P.path("byte_bpe_50k.json"))
    want = sorted((i, len(x := np.array([*t.library.encode(s or "", add_special_tokens=False).ids, 0], "<u4")), zlib.crc32(x.tobytes())) for i, s, _ in docs)
    rows = token_files.read_token_files(token_files.write_token_files(df, P.path("byte_bpe_50k.json"), 0)).collect()
    assert sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in rows) == want
    at = 0
    for r in sorted(rows, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    df.write.parquet(f"{tmp_path}/documents.parquet")
    pieces = packing.op5_packing(spark, str(tmp_path)).collect()
    w = WordTokenizer(P.path("word_bpe_49k.json"))
    size = {i: sum(len(w.library.encode(s or "", add_special_tokens=False).ids) + 1 for j, s, _ in docs if i == j) for i in (3, 5, 9)}
    assert {i: sum(p.length for p in pieces if p.doc_id == i) for i in size} == size
    places = [(p.sequence_id, k) for p in pieces for k in range(p.offset, p.offset + p.length)]
    assert len(places) == len(set(places)) and max(k for _, k in places) < 4096 and len([p for p in pieces if p.doc_id == 5]) > 1


def test_no_documents(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert token_files.read_token_files(token_files.write_token_files(df, P.path("byte_bpe_50k.json"), 0)).collect() == []
    assert packing.pack_documents(df, P.path("word_bpe_49k.json"), 2).collect() == []
