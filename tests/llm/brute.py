"""Plain versions of the operators, for small inputs."""

import hashlib


def repeated(docs, length=100):
    """docs: (doc_id, text) -> {doc_id: (n_bytes, n_removed, n_spans, kept_sha256)}"""
    seen, out = {}, {}
    order = sorted(docs, key=lambda d: (d[0] is not None, d[0]))
    data = {i: (t or "").encode() for i, t in order}
    for i, b in data.items():
        for p in range(len(b) - length + 1):
            seen.setdefault(b[p : p + length], (i, p))
    for i, b in data.items():
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] != (i, p):
                gone[p : p + length] = b"\1" * length
        spans = sum(1 for p in range(len(b)) if gone[p] and (p == 0 or not gone[p - 1]))
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest())
    return out


def words(text):
    return (text or "").encode().lower().split()


def shingle_set(text, k):
    w = words(text)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1)))


def joined(docs, k=3, num=90, den=100):
    """docs: (doc_id, text) -> {doc_id: (n_shingles, component_id)}"""
    sets = {i: shingle_set(t, k) for i, t in docs}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((root(a), root(b)))
                    parent[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}
