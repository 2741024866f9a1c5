import random

import numpy as np
import pytest

from folio.llm import jaccard_join as J

from .brute import joined, shingle_set


def corpus(seed, n=150):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    line = [rnd.choice(vocabulary) for _ in range(30)]
    docs = []
    while len(docs) < n:
        base = [rnd.choice(vocabulary) for _ in range(rnd.choice([0, 1, 2, 3, 5, 12, 20, 40, 80, 200]))] + (line if rnd.random() < 0.3 else [])
        for _ in range(rnd.choice([1, 1, 2, 6])):
            copy = list(base)
            for _ in range(rnd.choice([0, 1, 1, 2, 4])):
                if copy:
                    copy[rnd.randrange(len(copy))] = rnd.choice(vocabulary)
            docs.append((len(docs) * 37 % 1009, (" " if rnd.random() < 0.5 else "\n").join(copy).title() if rnd.random() < 0.3 else " ".join(copy)))
    return docs


@pytest.mark.parametrize(("seed", "words", "num", "den", "block"), [(1, 3, 90, 100, J.BLOCK), (2, 5, 8, 10, J.BLOCK), (3, 1, 8, 10, 1), (4, 3, 90, 100, 1000)])
def test_against_brute_force(spark, seed, words, num, den, block, monkeypatch):
    monkeypatch.setattr(J, "TREE_BLOCK", 4)
    monkeypatch.setattr(J, "BLOCK", block)
    assert J.Similarity(words, num, den).by_blocks == (seed in (1, 3))
    docs = [*corpus(seed), (2000, None), (2001, ""), (2002, " \n")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.linked_groups(df, words, num, den).collect()}
    assert got == joined(docs, words, num, den)


def test_hot_group_chain_and_line(spark):
    """A group of near copies, a chain whose ends aren't linked, and a line that all documents share."""
    rnd = random.Random(5)
    line = " ".join(f"l{i}" for i in range(25))
    base = [f"b{i}" for i in range(100)]
    docs = []
    for _ in range(60):
        copy = list(base)
        copy[rnd.randrange(100)] = f"x{rnd.random()}"
        docs.append((len(docs), " ".join(copy)))
    for i in range(20):
        docs.append((100 + i, " ".join(f"c{j}" for j in range(2 * i, 2 * i + 100))))
    docs += [(200 + i, f"{line} " + " ".join(f"r{i}-{j}" for j in range(i))) for i in range(30)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.linked_groups(df, 3, 90, 100).collect()}
    assert got == joined(docs, 3, 90, 100)


def test_nulls_repeats_and_empty(spark):
    schema = "doc_id long, text string, set string, cell string"
    assert J.linked_groups(spark.createDataFrame([], schema), 3, 90, 100).collect() == []
    docs = [(None, "a b c d", "x", "y"), (7, "A b C d", "x", "y"), (7, "A b C d", None, None), (7, "other words here", None, None), (None, "alone text", None, None)]
    got = sorted(map(tuple, J.linked_groups(spark.createDataFrame(docs, schema), 3, 90, 100).collect()), key=str)
    assert got == sorted([(None, 2, 7), (7, 2, 7), (7, 2, 7), (7, 1, 7), (None, 1, None)], key=str)


def test_tree_finds_what_the_bound_allows():
    rng = np.random.default_rng(0)
    like = J.Similarity(3, 8, 10)
    sets = [np.unique(rng.integers(0, 1 << 63, rng.integers(5, 300)).astype(np.uint64)) for _ in range(40)]
    sets += [np.unique(np.concatenate([s[: len(s) - len(s) // 12], rng.integers(0, 1 << 63, 3).astype(np.uint64)])) for s in sets]
    sets = [J.mix(s) for s in sets]
    at = J.decoded(J.points(sets))
    size = np.array([len(s) for s in sets])
    got = set(zip(*(x.tolist() for x in J.CountTree(at, size, like).search(at, size)), strict=True))
    want = {(i, j) for i in range(len(sets)) for j in range(len(sets)) if np.minimum(at[i], at[j]).sum(dtype=int) >= like.overlap(size[i] + size[j])}
    assert got == want
    linked = {(i, j) for i in range(len(sets)) for j in range(len(sets)) if 10 * len(np.intersect1d(sets[i], sets[j])) >= 8 * len(np.union1d(sets[i], sets[j]))}
    assert linked <= got and len(linked) > len(sets)


def test_linked_sets_share_a_cell():
    rng = np.random.default_rng(1)
    like = J.Similarity(3, 90, 100)
    for n in (9, 10, 19, 20, 40, 99, 300):
        for _ in range(30):
            a = rng.integers(0, 1 << 63, n).astype(np.uint64)
            cut = int(rng.integers(0, n // 9 + 1))
            b = np.concatenate([a[cut:], rng.integers(0, 1 << 63, int(rng.integers(0, n // 9 + 1))).astype(np.uint64)])
            both = len(np.intersect1d(a, b))
            hot = rng.permutation(np.concatenate([a[: n // 2], b[: n // 3]]))
            if 100 * both >= 90 * (len(a) + len(b) - both) and set(a.tolist()) != set(b.tolist()):
                of, cell = J.blocks([np.sort(a), np.sort(b)], like)
                assert set(cell[of == 0].tolist()) & set(cell[of == 1].tolist())
                for last in (np.zeros(0, np.uint64), np.unique(hot)):
                    of, cell, place = J.prefixes([np.sort(a), np.sort(b)], like, last)
                    assert set(cell[of == 0].tolist()) & set(cell[of == 1].tolist())
                    assert place[of == 0].tolist() == list(range((of == 0).sum()))


def test_frequent_shingles_come_last():
    like = J.Similarity(3, 8, 10)
    s = np.arange(1, 21, dtype=np.uint64)
    hot = np.array([3, 1, 17], np.uint64)
    _, cell, _ = J.prefixes([s], like, hot)
    assert cell.tolist() == [2, 4, 5, 6, 7]
    _, cell, _ = J.prefixes([np.array([1, 3, 5, 17], np.uint64)], J.Similarity(3, 1, 2), hot)
    assert cell.tolist() == [5, 3, 1]
    lot = {i: np.array([7, 8 + i], np.uint64) for i in range(5)}
    assert J._frequent(lot).to_pylist() == [{"id": None, "set": 7, "n": None, "seen": 5}]


def test_points_of_any_count():
    sets = [np.arange(n, dtype=np.uint64) << np.uint64(k) for n, k in ((0, 0), (20, 50), (300, 2), (40, 55))]
    got = J.decoded(J.points(sets))
    assert [row.tolist() for row in got] == [np.bincount((s >> np.uint64(55)).astype(np.int64), minlength=J.GROUPS).tolist() for s in sets]
    assert J.decoded(J.points(sets[:2])).dtype == np.uint8


def test_shingles_are_those_of_the_rule():
    from folio.llm.kernels import NOT_SPACE, Words

    texts = ["", " ", "a", "A b", "x y z", "x\ty\nz w x y z", "É é\x0bk"]
    for k in (1, 3, 5):
        got = [len(s) for s in Words([t.encode() for t in texts], NOT_SPACE).shingle_sets(k)]
        assert got == [len(shingle_set(t, k)) for t in texts]


def test_very_long_texts_and_large_cells(spark, monkeypatch):
    """Texts longer than a chunk of the kernels, with counts beyond half a byte; and a group larger than a tree."""
    monkeypatch.setattr(J, "TREE_BLOCK", 20)
    rnd = random.Random(9)
    long_ = [f"word{i}" for i in range(60_000)]
    near = list(long_)
    for _ in range(500):
        near[rnd.randrange(len(near))] = "other"
    far = long_[:40_000] + [f"new{i}" for i in range(20_000)]
    base = [f"b{i}" for i in range(60)]
    docs = [(1, " ".join(long_)), (2, " ".join(near)), (3, " ".join(far))]
    for k in range(150):
        copy = list(base)
        copy[rnd.randrange(60)] = f"x{k}"
        docs.append((10 + k, " ".join(copy)))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.linked_groups(df, 3, 90, 100).collect()}
    assert got == joined(docs, 3, 90, 100)


def test_one_document_of_each_group_stays(spark):
    text = " ".join(f"w{i}" for i in range(40))
    docs = [(5, text, "a", 1), (3, text + " more", "b", 2), (3, text + " more", "b", 2), (None, text, "c", 3), (7, "alone " * 3, None, 4), (8, None, "d", 5), (9, "", "e", 6)]
    df = spark.createDataFrame(docs, "doc_id long, text string, `set` string, id__ int")
    got = sorted((str(r.doc_id), r.id__) for r in J.one_of_each_group(df, 5, 8, 10).collect())
    assert got == [("3", 2), ("7", 4), ("8", 5), ("9", 6)]
    assert J.one_of_each_group(df.limit(0), 5, 8, 10).collect() == []
