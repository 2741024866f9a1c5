import random

import numpy as np
import pytest

from folio.llm import fingerprint as fp

from .brute import shingle_set


def text(rnd, n, words=3000):
    return " ".join(f"w{rnd.randrange(words)}" for _ in range(n))


def test_estimates_are_near_the_truth():
    rnd = random.Random(1)
    for share in (0.2, 0.5, 0.9):
        base = [f"t{i}" for i in range(2000)]
        a, b = " ".join(base), " ".join(base[: int(2000 * share)] + [f"n{rnd.random()}" for _ in range(300)])
        x, y = (fp.sketches([t])[0] for t in (a, b))
        sa, sb = shingle_set(a, 5), shingle_set(b, 5)
        assert fp.resemblance(x, y) == pytest.approx(len(sa & sb) / len(sa | sb), abs=0.13)
        assert fp.containment(y, x) == pytest.approx(len(sa & sb) / len(sb), abs=0.16)
        assert fp.distinct(x) == pytest.approx(len(sa), rel=0.3)
    few = fp.sketches(["one two three four five six"])[0]
    assert fp.distinct(few) == 2 and fp.resemblance(few, few) == fp.containment(few, few) == 1
    none = np.zeros(0, np.uint64)
    assert fp.resemblance(none, none) == 1 and fp.resemblance(none, few) == 0 and fp.containment(none, few) == 1 and fp.distinct(none) == 0


def test_merged_sketches_are_those_of_the_union(spark):
    rnd = random.Random(2)
    rows = [(i % 3 if i % 7 else None, text(rnd, rnd.choice([0, 3, 40, 400])), "x") for i in range(60)]
    df = spark.createDataFrame(rows, "part int, text string, `a.b` string").repartition(4)
    found = fp.fingerprints(df)
    assert "a.b" in found.columns
    got = {r.part: fp.decode(r.fingerprint).tolist() for r in fp.merged_fingerprints(found, "part").collect()}
    for part in {r[0] for r in rows}:
        own = [s for s in fp.sketches([t for p, t, _ in rows if p == part], k=10**9) if len(s)]
        assert got[part] == np.unique(np.concatenate(own))[: fp.K].tolist()
    assert fp.merged_fingerprints(found.limit(0), "part").collect() == []


def test_sources_against_the_whole(spark, tmp_path):
    rnd = random.Random(3)
    docs = [(i, text(rnd, 300), ["a", "b", None][i % 3]) for i in range(30)] + [(100, None, "c"), (101, "", "c")]
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.source: r for r in fp.source_fingerprints(spark, str(tmp_path)).collect()}
    sets = {s: set().union(*(shingle_set(t, 5) for _, t, x in docs if x == s)) for s in ("a", "b", "c", None)}
    whole = set().union(*sets.values())
    assert set(got) == set(sets) and got["c"].distinct == 0 and got["c"].resemblance == 0
    for s in ("a", "b", None):
        assert got[s].distinct == pytest.approx(len(sets[s]), rel=0.3) and got[s].resemblance == pytest.approx(len(sets[s]) / len(whole), abs=0.13) and got[s].containment > 0.6
