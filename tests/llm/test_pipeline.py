"""run(), op4 and op7 against plain versions."""

import base64
import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

import corpus_pipeline
from folio.llm import decontaminate, suffix_dedup
from folio.llm import fingerprint as fp
from folio.llm import language as lg
from tests.llm.brute import joined, shingle_set

EN = "the old house by the river was sold to a young family from the north and its garden was green in summer".split()
DE = "das alte haus am fluss wurde von einer jungen familie aus dem norden gekauft und der garten war im sommer sehr schön".split()
FR = "la vieille maison près de la rivière fut vendue à une jeune famille du nord et son jardin était vert en été".split()


def text(words, seed, n):
    return " ".join(words[(seed * 7 + i * (seed % 5 + 1) + i * i * seed) % len(words)] + (str(seed) if i % 6 == 5 else "") for i in range(n))


def documents():
    """(doc_id, text, lang, source)"""
    out = [(i, text(w, i, 30 + i % 9), lang, f"s{i % 4}") for k, (w, lang) in enumerate(((EN, "en"), (DE, "DE"), (FR, "fr"))) for i in range(k * 20, k * 20 + 20)]
    out += [(100, text(EN, 3, 33), "en", "s1"), (101, text(EN, 4, 34) + " more", "en", None), (102, "123 456", "en", "s1"), (103, None, "fr", "s2"), (104, "", None, None)]
    out += [(105, text(DE, 25, 20), "en", "s3"), (106, "Ж" * 40, None, "s9"), (107, text(FR, 44, 22), None, "s0"), (108, text(FR, 51, 40) + " " + text(EN, 9, 30), "fr", "s2")]
    return out


def trigram_counts(t):
    b = b" " + bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in (t or "").encode()) + b" "
    at = [i for i in range(len(b) - 2) if b[i + 1] != 32]
    return Counter((((b[i] * 0x1003F + b[i + 1] * 0x3F1 + b[i + 2]) * 2654435761) % (1 << 32)) >> 17 for i in at)


def identified(docs):
    """{doc_id: (language, probability, n_trigrams, accepted)}"""
    counts = {i: trigram_counts(t) for i, t, _, _ in docs}
    declared = {i: lang and lang.lower() for i, _, lang, _ in docs}
    taken = {(declared[i], t): i for i, t, _, _ in docs if declared[i] and counts[i]}
    names = sorted({x for x, _ in taken})
    model = []
    for x in names:
        c = sum((counts[i] for (y, _), i in taken.items() if y == x), Counter())
        model.append((c, sum(c.values()) + lg.BUCKETS / 2))
    logs = {i: [sum(n * math.log((m[k] + 0.5) / total) for k, n in c.items()) / lg.WITNESS for m, total in model] + [sum(c.values()) * -math.log(lg.BUCKETS) / lg.WITNESS] for i, c in counts.items()}
    best = {i: max(range(len(names) + 1), key=lambda k: (x[k], -k)) for i, x in logs.items()}
    n = len(names) + 1
    whole = [1 + sum(b == k for b in best.values()) for k in range(n)]
    whole = [x / sum(whole) for x in whole]
    smooth = lambda bs, prior: [(sum(b == k for b in bs) + lg.BORROWED * prior[k]) / (len(bs) + lg.BORROWED) for k in range(n)]
    domain = smooth(list(best.values()), whole)  # no domains: null is the only one
    out = {}
    for i, _, _, source in docs:
        prior = smooth([best[j] for j, _, _, s in docs if s == source], domain)
        said = declared[i]
        evidence = [0.0] * n if said not in names else [math.log(lg.DECLARED_RIGHT) if x == said else math.log((1 - lg.DECLARED_RIGHT) / len(names)) for x in names] + [math.log(1 / len(names))]
        total = [a + b + math.log(p) for a, b, p in zip(logs[i], evidence, prior)]
        k, m = max(range(n), key=lambda k: (total[k], -k)), sum(counts[i].values())
        p = 1 / sum(math.exp(x - total[k]) for x in total)
        x = [*names, "und"][k] if m else "und"
        out[i] = (x, p if m else 1.0, m, x != "und" and p >= 0.5)
    return out


def test_languages_are_those_of_the_plain_version(spark):
    docs = documents()
    df = spark.createDataFrame([(*d, "x", None) for d in docs], "doc_id long, text string, lang string, source string, language string, text_logs string").repartition(3)
    got = {r.doc_id: (r.language, r.probability, r.n_trigrams, r.accepted) for r in lg.with_language(df).collect()}
    want = identified(docs)
    assert {i: (x, n, a) for i, (x, _, n, a) in got.items()} == {i: (x, n, a) for i, (x, _, n, a) in want.items()}
    assert [got[i][1] for i in want] == pytest.approx([w[1] for w in want.values()])
    assert lg.with_language(df.limit(0)).collect() == []


def plain_fingerprints(docs):
    """docs: (doc_id, text) -> rows of EDITED"""
    def sketch(t):
        return sorted({int(fp.sketches([b" ".join(s).decode()])[0][0]) for s in shingle_set(t, 5)})[: fp.K]

    def like(a, b):
        least = sorted({*a, *b})[: fp.K]
        return float(len(a) == len(b)) if not a or not b else sum(x in a and x in b for x in least) / len(least)

    order = sorted(((i, t or "") for i, t in docs), key=lambda d: (d[0] is not None, d[0] or 0, d[1]))
    out = []
    for (i, t), (_, u) in zip(order, order[1:] + order[:1]):
        half = len(t) // 2
        e = t[: len(t) - half] + u[:half]
        a, b, c = (sketch(x) for x in (t, e, u))
        out.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), *(base64.b64encode(b"".join(x.to_bytes(8, "little") for x in s)).decode() for s in (a, b)), like(a, b), like(a, c)))
    return out


def test_fingerprints_are_those_of_the_plain_version(spark, tmp_path):
    docs = [(i, t) for i, t, _, _ in documents()] + [(None, "no id at all here"), (None, None), (7, "Same id"), (200, text(EN, 8, 300) + " " + text(DE, 6, 300)), (200, text(DE, 6, 400))]
    spark.createDataFrame([(*d, "x", True) for d in docs], "doc_id long, text string, part string, tail boolean").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, fp.op4_fingerprints(spark, str(tmp_path)).collect()), key=repr)
    assert got == sorted(plain_fingerprints(docs), key=repr)
    assert fp.edited_fingerprints(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    assert sorted(map(tuple, fp.edited_fingerprints(spark.createDataFrame([(1, "a b")], "doc_id long, text string")).collect())) == plain_fingerprints([(1, "a b")])


def plain_run(docs, bench):
    """The documents that come to the last stage: {doc_id: text}"""
    found = identified(docs)
    left = {i: t for i, t, _, _ in docs if found[i][3]}
    groups = joined(list(left.items()), 5, 8, 10)
    left = {i: t for i, t in left.items() if groups[i][1] == i}
    length, seen, out = suffix_dedup.LENGTH, set(), {}
    for i in sorted(left):
        b = left[i].encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if b[p : p + length] in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(b[p : p + length])
        rest = bytes(x for x, g in zip(b, gone) if not g).decode("utf-8", "ignore")
        if rest.strip() or not any(gone):
            out[i] = rest
    words = lambda t: re.findall(rb"[a-z0-9\x80-\xff]+", (t or "").encode().lower())
    size = decontaminate.WINDOW
    windows = {tuple(w[k : k + size]) for _, t in bench if (w := words(t)) for k in range(max(1, len(w) - size + 1))}
    for i, t in list(out.items()):
        w, hit = words(t), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
        if hit and 20 * len(hit) >= len(w):
            del out[i]
    return out


@pytest.mark.parametrize("empty", [False, True])
def test_run_is_the_plain_stages(spark, tmp_path, empty):
    P = pytest.importorskip("public_tokenizers")
    tokenizers = pytest.importorskip("tokenizers")
    docs = [] if empty else documents()
    bench = [(1, text(FR, 48, 20)), (2, None), (3, " ".join(EN))]
    rows = spark.createDataFrame([(*d, 0, "x", "y", "z") for d in docs], "doc_id long, text string, lang string, source string, n_chars long, part string, spans string, id__ string")
    rows.repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    left = plain_run(docs, bench)
    library = tokenizers.Tokenizer.from_file(P.path("word_bpe_49k.json"))
    ids = {i: [*library.encode(t, add_special_tokens=False).ids, 2] for i, t in left.items()}
    assert {r.doc_id for r in got} == set(left) and (empty or 0 < len(left) < len(docs) - 8)
    for i, x in ids.items():
        pieces = sorted((r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got if r.doc_id == i)
        assert sum(p[1] for p in pieces) == len(x) and all(p[3] == len(x) for p in pieces)
        for start, n, crc, _ in pieces:
            assert crc == zlib.crc32(b"".join(k.to_bytes(4, "little") for k in x[start : start + n]))
    used = [(r.sequence_id, k) for r in got for k in range(r.offset, r.offset + r.length)]
    assert len(used) == len(set(used)) and all(k < 4096 for _, k in used)
