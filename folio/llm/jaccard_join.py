"""N-gram Jaccard join: groups of documents linked by the Jaccard similarity of their word shingles. Exact.

A document's shingles are hashed to GROUPS groups; the counts are its point. min(a, b) summed over coordinates bounds the overlap of two
documents. A packed R-tree over points, its nodes on COARSE sums of neighbouring coordinates and its leaves on all of them, finds the
pairs that the bound allows; those are verified on the texts.

One tree over everything can't prune: at similarity 0.9 a query's radius spans the whole of almost every coordinate. So documents are
routed to trees by cells that no linked pair can miss; each cell with two documents or more has a tree. Cells only route:
every pair comes out of a tree. There are two kinds.

Blocks: for documents of a size class, shingles are dealt to one block more than two linked documents can differ in (and SPARE more), so
on some block that isn't empty they agree. Equal blocks are a cell. A block is a good key if it holds several shingles, so
this is for high similarities (BLOCK).

Prefixes: in any one order of all shingles, two linked documents share one of their first n - ceil(s * n) + 1 (n: shingles, s: the
similarity). Each of those is a cell. The order puts the most frequent shingles last, so a line or passage that many
documents share is no cell of theirs as long as they have enough else.

Rounds. In the first two a tree is searched for one member at a time, and what is found is taken out of the search, so that a group of
copies costs and emits about a pair a member; the first takes a document's EARLY first cells only. A large cell is dealt to
trees at random, each time another way, which connects them. The last round searches each cell that still has several components for
all pairs between them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, n_tasks, release, written
from .components import components_of_pairs, joined
from .kernels import NOT_SPACE, Words, chunks, mix
from .suffix_dedup import id_key, multikey_order

#: Coordinates of a point, and of the nodes above the leaves.
GROUPS, COARSE = 512, 64
#: Shingles of a block, about, from which on blocks route instead of prefixes; blocks that may be empty; ratio between size classes.
BLOCK, SPARE, CLASS = 6, 2, 1.5
#: Cells by prefix of a document that the first round takes.
EARLY = 4
#: Shingles that the order puts last, at most: those that make up 1 / HOT of all shingles each, or more. What else is frequent costs
#: time, not results. They are sent to all tasks, 12 bytes each. Shingles that are counted at a time to find them.
HOT, COUNTED = 1 << 18, 1 << 21
#: Members of a cell that one tree holds, about; a cell of more has several.
TREE_BLOCK = 256
LEAF = 16
#: Members that a tree is searched for at a time in the last round: what bounds the pairs held in memory.
QUERIES = 128
#: Pairs of members of small cells that are compared at a time.
PAIRS_AT_ONCE = 4096
#: Two sets and the components that they are in so far.
PAIR = ["a", "b", "label_a", "label_b"]
PAIRS = ", ".join(f"{c} long" for c in PAIR)
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class Similarity:
    """Linked: den * intersection >= num * union."""

    def __init__(self, words: int, num: int, den: int):
        self.words, self.num, self.den = words, num, den
        self.bounds = [1]
        while self.bounds[-1] < 1 << 40:
            self.bounds.append(int(self.bounds[-1] * CLASS) + 1)
        #: Blocks of each class; 0 where only equal sets can be linked.
        self.blocks = [0 if self.apart(2 * b) == 0 else self.apart(2 * b) + 1 + SPARE for b in self.bounds]
        self.by_blocks = self.den + self.num >= 2 * BLOCK * (self.den - self.num)

    def overlap(self, total):
        """Least intersection of two linked sets whose sizes sum to total."""
        return -(-self.num * total // (self.den + self.num))

    def apart(self, total: int) -> int:
        """Most shingles in one, but not both, of two linked sets whose sizes sum to total or less."""
        return max(t - 2 * self.overlap(t) for t in range(max(0, total - 2 * self.den), total + 1))

    def classes(self, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Classes of a set's size and of the largest set that it can be linked with."""
        bounds = np.array(self.bounds)
        return np.searchsorted(bounds, n), np.searchsorted(bounds, n * self.den // self.num)

    def prefix(self, n):
        """How many of the first shingles of a set of n to look at; none where only equal sets can be linked."""
        return np.where(n * (self.den - self.num) >= self.num, n + (-self.num * n // self.den) + 1, 0)


def set_keys(sets: list[np.ndarray]) -> np.ndarray:
    """A hash of each set."""
    sums = np.array([mix(s).sum(dtype=np.uint64) for s in sets], np.uint64)
    return mix(sums * _A + np.array([len(s) for s in sets], np.uint64))


def points(sets: list[np.ndarray]) -> list[bytes]:
    """Each set's counts by group: half a byte each (those of the second half of the groups above those of the first), a byte if
    one is beyond that, or four."""
    out = []
    for s in sets:
        c = np.bincount((s >> np.uint64(55)).astype(np.int64), minlength=GROUPS)
        most = c.max()
        out.append((c[: GROUPS // 2] | c[GROUPS // 2 :] << 4).astype(np.uint8).tobytes() if most < 16 else c.astype(np.uint8 if most < 256 else "<u4").tobytes())
    return out


def decoded(found: list[bytes]) -> np.ndarray:
    """A row for each point."""
    sizes = np.array([len(x) for x in found])
    out = np.zeros((len(found), GROUPS), np.uint8 if (sizes <= GROUPS).all() else np.uint32)
    for size, kind in ((GROUPS // 2, np.uint8), (GROUPS, np.uint8), (4 * GROUPS, "<u4")):
        rows = np.flatnonzero(sizes == size)
        if len(rows):
            raw = np.frombuffer(b"".join([found[i] for i in rows.tolist()]), kind).reshape(len(rows), -1)
            out[rows] = np.concatenate([raw & 15, raw >> 4], axis=1) if size < GROUPS else raw
    return out


def coarse(at: np.ndarray) -> np.ndarray:
    return at.reshape(len(at), COARSE, GROUPS // COARSE).sum(axis=2, dtype=np.int32)


def overlap_bound(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """No two sets with the points x and y share more."""
    return np.minimum(x, y).sum(axis=-1, dtype=np.int64)


def prefixes(sets: list[np.ndarray], like: Similarity, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(set, cell, place of the cell in its set's order); hot: the shingles that come last, from the least frequent on, in an order
    that is the same for all."""
    size = np.array([len(s) for s in sets], np.int64)
    row = np.repeat(np.arange(len(sets)), size)
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    rank = np.zeros(len(flat), np.int64)
    if len(hot):
        by = np.argsort(hot)
        at = np.minimum(np.searchsorted(hot[by], flat), len(hot) - 1)
        rank = np.where(hot[by][at] == flat, by[at] + 1, 0)
    order = np.argsort(row * (2 * HOT) + rank, kind="stable")  # equal ranks stay in the order of their hashes
    place = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
    keep = place < like.prefix(size)[row]
    return row[keep], flat[order][keep], place[keep]


def blocks(sets: list[np.ndarray], like: Similarity) -> tuple[np.ndarray, np.ndarray]:
    """(set, cell) of the equal blocks."""
    size = np.array([len(s) for s in sets], np.int64)
    own, upper = like.classes(size)
    flat = mix(np.concatenate(sets) * _B) if sets else np.zeros(0, np.uint64)
    numbers = np.array(like.blocks, np.int64)
    out_set, out_cell = [], []
    for level_of in range(int((upper - own).max(initial=0)) + 1):
        level = own + level_of
        k = np.where(level <= upper, numbers[np.minimum(level, len(numbers) - 1)], 0)
        first = np.cumsum(np.concatenate(([0], k)))
        use = np.repeat(k > 0, size)
        row = np.repeat(np.arange(len(sets)), size)[use]
        h = flat[use]
        block = ((h >> np.uint64(32)) * k[row].astype(np.uint64)) >> np.uint64(32)
        at = first[row] + block.astype(np.int64)
        total = np.zeros(first[-1], np.uint64)
        np.add.at(total, at, mix(h * _A))
        count = np.bincount(at, minlength=first[-1])
        of = np.repeat(np.arange(len(sets)), k)
        empties = np.bincount(of, weights=count == 0, minlength=len(sets))
        emit = (count > 0) | (empties[of] > SPARE)
        place = np.arange(first[-1]) - first[of]
        cell = mix(mix(total + _B) + (level[of] * (1 << 40) + place).astype(np.uint64) * _A)
        out_set.append(of[emit])
        out_cell.append(cell[emit])
    return np.concatenate(out_set), np.concatenate(out_cell)


class CountTree:
    """Packed R-tree over points: leaves of LEAF neighbours in the order of size and coordinates, nodes with the maxima of
    each coarse coordinate and the least size. A search goes into the nodes whose summed minima allow an overlap that links, and
    of the points there gives those that all coordinates allow."""

    def __init__(self, at: np.ndarray, size: np.ndarray, like: Similarity):
        rough = coarse(at)
        self.at, self.size, self.rough, self.like = at, size, rough, like
        self.order = multikey_order([size // 4, *(rough[:, i] // 2 for i in range(4))])
        self.levels = [(rough[self.order], size[self.order])]
        while len(self.levels[-1][1]) > LEAF:
            top, least = self.levels[-1]
            starts = np.arange(0, len(least), LEAF)
            self.levels.append((np.maximum.reduceat(top, starts, axis=0), np.minimum.reduceat(least, starts)))

    def search(self, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, point) pairs that the bound doesn't exclude."""
        rough, top = coarse(at), len(self.levels) - 1
        query = np.repeat(np.arange(len(size)), len(self.levels[top][1]))
        node = np.tile(np.arange(len(self.levels[top][1])), len(size))
        for level in range(top, -1, -1):
            high, least = self.levels[level]
            keep = self._allowed(rough, size, high, least, query, node, 1 << 15)
            query, node = query[keep], node[keep]
            if level:
                n = len(self.levels[level - 1][1])
                query, node = np.repeat(query, LEAF), (node[:, None] * LEAF + np.arange(LEAF)).ravel()
                query, node = query[node < n], node[node < n]
        point = self.order[node]
        keep = self._allowed(at, size, self.at, self.size, query, point, 1 << 13)
        return query[keep], point[keep]

    def _allowed(self, x, size_x, y, size_y, i, j, step) -> np.ndarray:
        """Which pairs of rows i of x and j of y the bound allows."""
        keep = [overlap_bound(x[q], y[p]) >= self.like.overlap(size_x[q] + size_y[p]) for a in range(0, len(i), step) for q, p in [(i[a : a + step], j[a : a + step])]]
        return np.concatenate(keep) if keep else np.zeros(0, bool)


def _batch_sets(batch: pa.RecordBatch, words: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    for a, _, part in chunks(batch.column("text").to_pylist()):
        yield a, Words(part, NOT_SPACE).shingle_sets(words)


def _features(docs: DataFrame, like: Similarity) -> DataFrame:
    """id, set (hash of the shingles), n (their number) of each row; and rows (set: a shingle, seen: how often) of frequent shingles.

    A shingle that makes up 1 / HOT of all does so in some lot of COUNTED shingles, so in each lot those alone are counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lot: dict[int, np.ndarray] = {}  # distinct sets
        size = 0
        for batch in batches:
            for a, sets in _batch_sets(batch, like.words):
                keys = set_keys(sets).view(np.int64)
                none = pa.nulls(len(sets), pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(a, len(sets)), pa.array(keys), pa.array([len(s) for s in sets], pa.int64()), none], names=["id", "set", "n", "seen"])
                if like.by_blocks:
                    continue
                lot.update(zip(keys.tolist(), sets, strict=True))
                size += sum(map(len, sets))
                if size >= COUNTED:
                    yield _frequent(lot)
                    lot, size = {}, 0
        if lot:
            yield _frequent(lot)

    return docs.mapInArrow(run, "id long, set long, n long, seen long")


def _frequent(lot: dict[int, np.ndarray]) -> pa.RecordBatch:
    flat = np.sort(np.concatenate(list(lot.values())))
    starts = np.flatnonzero(np.concatenate(([True], flat[1:] != flat[:-1]))) if len(flat) else np.zeros(0, np.int64)
    seen = np.diff(np.append(starts, len(flat)))
    often = (seen > 1) & (seen * HOT >= len(flat))
    found, none = flat[starts][often].view(np.int64), pa.nulls(int(often.sum()), pa.int64())
    return pa.RecordBatch.from_arrays([none, pa.array(found), none, pa.array(seen[often].astype(np.int64))], names=["id", "set", "n", "seen"])


def _hot(rows: DataFrame) -> np.ndarray:
    """The shingles that come last in the order, from the least frequent on; HOT at most, as their counts sum to no more than all."""
    total = rows.where("seen is null").agg(F.sum("n")).first()[0] or 0
    counts = rows.where("seen is not null").groupBy("set").agg(F.sum("seen").alias("seen")).where(F.col("seen") * HOT >= total)
    found = counts.toArrow()
    seen, hashes = found.column("seen").to_numpy(), found.column("set").to_numpy()
    return hashes[np.lexsort((hashes, seen))].view(np.uint64)


def _members(docs: DataFrame, like: Similarity, hot: np.ndarray) -> DataFrame:
    """(cell, set, early) of the cells with two sets or more, a written table; cells of the same sets are one; early: among a set's
    EARLY first.

    Cells are counted by partial sums, and the join that drops those of one set is one that adaptive execution splits, so a cell
    that holds a large share of all sets is no single task's."""
    sent = docs.sparkSession.sparkContext.broadcast(hot)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: set[int] = set()
            for _, sets in _batch_sets(batch, like.words):
                keys = set_keys(sets)
                new = []
                for i, key in enumerate(keys.tolist()):  # of equal documents of a batch one is enough
                    if len(sets[i]) and key not in seen:
                        seen.add(key)
                        new.append(i)
                if new:
                    some = [sets[i] for i in new]
                    if like.by_blocks:
                        of, cell = blocks(some, like)
                        early = np.ones(len(of), bool)
                    else:
                        of, cell, place = prefixes(some, like, sent.value)
                        early = place < EARLY
                    yield _rows(cell.view(np.int64), keys[new][of].view(np.int64), early)

    each = written(docs.select("text").mapInArrow(emit, _MEMBERS).groupBy("cell", "set").agg(F.max("early").alias("early")), "cells")
    marks = [F.bit_xor(F.xxhash64(F.lit(i), "set")).alias(f"x{i}") for i in (1, 2)]
    shared = each.groupBy("cell").agg(F.count("*").alias("n"), *marks).where("n > 1").select(F.col("cell").alias("shared"), F.xxhash64("n", "x1", "x2").alias("name"))
    named = each.join(shared, F.col("cell") == F.col("shared")).groupBy(F.col("name").alias("cell"), "set").agg(F.max("early").alias("early"))
    out = written(named, "members")
    release(each)
    return out


_MEMBERS = "cell long, set long, early boolean"


def _then_none(batches):
    yield from batches
    yield None


def _rows(cell: np.ndarray, member: np.ndarray, early: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(cell), pa.array(member), pa.array(early)], names=["cell", "set", "early"])


def _verified(pairs: DataFrame, texts: DataFrame, like: Similarity) -> DataFrame:
    """The pairs whose texts are linked."""
    one = pairs.hint("merge").join(texts.select(F.col("set").alias("a"), F.col("text").alias("text_a")), "a")
    both = one.hint("merge").join(texts.select(F.col("set").alias("b"), F.col("text").alias("text_b")), "b").select(*PAIR, "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            seen: dict[int, np.ndarray] = {}
            ids = [batch.column(c).to_pylist() for c in ("a", "b")]
            for begin in range(0, batch.num_rows, 256):
                new: dict[int, str] = {}
                for side, c in enumerate(("text_a", "text_b")):
                    texts = batch.column(c).slice(begin, 256).to_pylist()
                    new |= {k: t for k, t in zip(ids[side][begin : begin + 256], texts, strict=True) if k not in seen}
                if len(seen) > 4096:
                    seen = {k: seen[k] for side in ids for k in side[begin : begin + 256] if k in seen}
                keys = list(new)
                for a, b, part in chunks(list(new.values())):
                    seen |= zip(keys[a:b], Words(part, NOT_SPACE).shingle_sets(like.words), strict=True)
                for i in range(begin, min(begin + 256, batch.num_rows)):
                    x, y = seen[ids[0][i]], seen[ids[1][i]]
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep[i] = like.den * both >= like.num * (len(x) + len(y) - both)
            yield batch.select(PAIR).filter(pa.array(keep))

    return both.mapInArrow(run, PAIRS)


def _labelled(members: DataFrame, parts: DataFrame | None) -> DataFrame:
    """members (cell, set) with their component so far, label, in the cells that have more than one; a written table."""
    if parts is None:
        return written(members.where("early").select("cell", "set", F.col("set").alias("label")), "open")
    named = written(members.join(parts.withColumnRenamed("node", "set"), "set", "left").select("cell", "set", F.coalesce("component", "set").alias("label")), "labelled")
    open_ = written(named.groupBy("cell").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select(F.col("cell").alias("open")), "open-cells")
    out = written(named.join(open_, F.col("cell") == F.col("open"), "left_semi"), "open")
    release(named, open_)
    return out


def _pairs(x: np.ndarray, y: np.ndarray, label_x: np.ndarray, label_y: np.ndarray) -> list[pa.Array]:
    """Columns of PAIRS, the smaller set first."""
    swap = x > y
    return [pa.array(c) for c in (np.where(swap, y, x), np.where(swap, x, y), np.where(swap, label_y, label_x), np.where(swap, label_x, label_y))]


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """(rows, where groups of equal keys begin in them and their end): whole groups, those that a batch completes together."""
    held = None
    for batch in _then_none(batches):
        if batch is not None:
            held = pa.Table.from_batches(([] if held is None else held.to_batches()) + [batch])
        if held is None or not held.num_rows:
            continue
        new = np.ones(held.num_rows, bool)
        new[1:] = np.any([(k := held.column(c).to_numpy())[1:] != k[:-1] for c in keys], axis=0)
        starts = np.append(np.flatnonzero(new), held.num_rows)
        done = starts if batch is None else starts[:-1]
        if len(done) > 1:
            yield held.slice(0, int(done[-1])), done
            held = held.slice(int(done[-1]))


def _in_small(starts: np.ndarray, at: np.ndarray, size: np.ndarray, label: np.ndarray, like: Similarity) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) by j, then i; i before j: pairs of different labels that the bound allows within groups of LEAF rows at most, each a tree
    of one leaf."""
    group = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    small = np.diff(starts)[group] <= LEAF
    rough, found = coarse(at), []
    for step in range(1, LEAF):
        i = np.flatnonzero(small[:-step] & (group[step:] == group[:-step]) & (label[step:] != label[:-step]))
        for a in range(0, len(i), PAIRS_AT_ONCE):
            x = i[a : a + PAIRS_AT_ONCE]
            least = like.overlap(size[x] + size[x + step])
            keep = overlap_bound(rough[x], rough[x + step]) >= least
            x, least = x[keep], least[keep]
            x = x[overlap_bound(at[x], at[x + step]) >= least]
            found.append((x, x + step))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    i, j = (np.concatenate(c) for c in zip(*found, strict=True))
    order = np.lexsort((i, j))
    return i[order], j[order]


def _leaders(at: np.ndarray, size: np.ndarray, label: np.ndarray, like: Similarity) -> tuple[np.ndarray, np.ndarray]:
    """(leader, member) pairs of different labels in one tree: each member that no search has found so far is searched for, and
    leads all that the search finds for the first time. Of those found before, one of each leader's is paired too."""
    tree, of = CountTree(at, size, like), np.full(len(size), -1)
    found = []
    for x in range(len(size)):
        if of[x] < 0:
            _, p = tree.search(at[x : x + 1], size[x : x + 1])
            free = of[p] < 0
            before = p[~free]
            of[p[free]] = x
            of[x] = x
            pick = np.concatenate([p[free], before[np.unique(of[before], return_index=True)[1]]])
            pick = pick[label[pick] != label[x]]
            found.append((np.full(len(pick), x), pick))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _with_points(rows: DataFrame, at: DataFrame) -> DataFrame:
    return rows.join(at, "set")


def _dealt(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows with `blocks`, the number of trees of their cell; and the cells of more than one (a written table)."""
    large = written(rows.groupBy("cell").agg(F.count("*").alias("c")).where(F.col("c") > TREE_BLOCK).select(F.col("cell").alias("large"), F.ceil(F.col("c") / TREE_BLOCK).alias("n_blocks")), "large-cells")
    return rows.join(large, F.col("cell") == F.col("large"), "left").drop("large").withColumn("blocks", F.coalesce("n_blocks", F.lit(1))).drop("n_blocks"), large


def _by_leaders(members: DataFrame, at: DataFrame, like: Similarity, one_each: bool) -> DataFrame:
    """PAIRS (a written table) that connect what the trees find similar, about a pair a member; one_each: at most one a member.

    members: (cell, set, label). A cell of more than TREE_BLOCK members is dealt to trees at random, differently in each cell."""
    spark = members.sparkSession
    dealt, large = _dealt(members)
    dealt = _with_points(dealt.withColumn("tree", F.pmod(F.xxhash64("cell", "set"), F.col("blocks"))).drop("blocks"), at)
    dealt = dealt.repartition(n_tasks(spark), "cell", "tree").sortWithinPartitions("cell", "tree", "set")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, starts in _groups(batches, ["cell", "tree"]):
            key, label, size = (rows.column(c).to_numpy() for c in ("set", "label", "n"))
            point = decoded(rows.column("point").to_pylist())
            i, j = _in_small(starts, point, size, label, like)
            first = np.unique(j, return_index=True)[1] if one_each else np.arange(len(j))
            found = [(i[first], j[first])]
            for k in np.flatnonzero(np.diff(starts) > LEAF).tolist():
                a, b = int(starts[k]), int(starts[k + 1])
                if (label[a:b] != label[a]).any():
                    leader, member = _leaders(point[a:b], size[a:b], label[a:b], like)
                    found.append((leader + a, member + a))
            x, y = (np.concatenate(c) for c in zip(*found, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(key[y]), *_pairs(key[x], key[y], label[x], label[y])], names=["of", *PAIR])

    found = dealt.mapInArrow(run, f"of long, {PAIRS}")
    if one_each:
        found = found.groupBy("of").agg(F.min(F.struct(*PAIR)).alias("p")).select("p.*")
    out = written(found.select(*PAIR).distinct(), "candidates")
    release(large)
    return out


def _by_trees(members: DataFrame, at: DataFrame, like: Similarity) -> DataFrame:
    """PAIRS (a written table): all pairs of a cell that have different labels and that the bound allows.

    Members of a cell's largest component are only searched in, in the one tree that each is dealt to; all others are also searched for, in
    all trees of their cell."""
    spark = members.sparkSession
    dealt, large = _dealt(members)
    counts = members.groupBy("cell", "label").count().groupBy("cell").agg(F.max(F.struct("count", "label"))["label"].alias("most"))
    counts = written(counts.withColumnRenamed("cell", "c"), "largest")
    rows = dealt.join(counts, F.col("cell") == F.col("c")).drop("c")
    own = F.array(F.struct(F.pmod(F.xxhash64("cell", "set"), F.col("blocks")).alias("tree"), F.lit(False).alias("asked")))
    all_ = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda k: F.struct(k.alias("tree"), F.lit(True).alias("asked")))
    to = F.when(F.col("label") == F.col("most"), own).otherwise(F.concat(own, all_))
    rows = rows.select("cell", "set", "label", F.explode(to).alias("to")).select("cell", "set", "label", "to.tree", "to.asked")
    rows = _with_points(rows, at).repartition(n_tasks(spark), "cell", "tree").sortWithinPartitions("cell", "tree", "asked", "set")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in _groups(batches, ["cell", "tree"]):
            for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                yield from _cross_pairs(table.slice(a, b - a), like)

    out = written(rows.mapInArrow(run, PAIRS).distinct(), "candidates")
    release(large, counts)
    return out


def _cross_pairs(rows: pa.Table, like: Similarity) -> Iterator[pa.RecordBatch]:
    """Rows of PAIRS for one tree, QUERIES members searched for at a time."""
    key, label, size, asked = (rows.column(c).to_numpy() for c in ("set", "label", "n", "asked"))
    within, queries = np.flatnonzero(~asked), np.flatnonzero(asked)
    if not len(within) or not len(queries):
        return
    at = decoded(rows.column("point").to_pylist())
    tree = CountTree(at[within], size[within], like)
    for begin in range(0, len(queries), QUERIES):
        some = queries[begin : begin + QUERIES]
        q, p = tree.search(at[some], size[some])
        q, p = some[q], within[p]
        apart = label[q] != label[p]
        q, p = q[apart], p[apart]
        yield pa.RecordBatch.from_arrays(_pairs(key[q], key[p], label[q], label[p]), names=PAIR)


def _points(texts: DataFrame, like: Similarity) -> DataFrame:
    """(set, n, point) of each set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, sets in _batch_sets(batch, like.words):
                sizes = pa.array([len(s) for s in sets], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(set_keys(sets).view(np.int64)), sizes, pa.array(points(sets), pa.binary())], names=["set", "n", "point"])

    return texts.mapInArrow(run, "set long, n long, point binary").dropDuplicates(["set"])


def _with_set(texts: DataFrame, like: Similarity) -> DataFrame:
    """Rows (set, text) whose text has that set: documents that share an id with another are told apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.concatenate([set_keys(sets) for _, sets in _batch_sets(batch, like.words)] or [np.zeros(0, np.uint64)]).view(np.int64)
            yield batch.filter(pa.array(keys == batch.column("set").to_numpy()))

    return texts.mapInArrow(run, "set long, text string")


def linked_groups(docs: DataFrame, words: int, num: int, den: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row: the least doc_id that links reach, itself included.

    A set: distinct shingles of `words` words (A-Z lower-cased, split at ASCII white space); of fewer words the whole
    sequence as one. Two rows are linked if den * intersection >= num * union. Rows without words have the empty set and are linked with
    nothing. Null doc_ids are in the order after all others: a group has a null component_id only if all its ids are
    null. Rows that share an id are told apart by their text. No rows give no rows.

    Sets are compared as sets of 64-bit hashes and named by one; at 10**9 distinct sets the chance that any two share a name is 3 %.
    Exchanges: (cell, set), 17 bytes, for about 0.2 of the distinct shingles (at 0.9 by blocks, at 0.8 by prefixes); the texts once, to
    keep those of documents that share a cell; points of the members of cells, 256 bytes mostly; two texts a pair to verify. Copies in a
    batch are one before the first exchange. A text is handled whole, however long: its shingles are held once by a task. Each
    round's tables are written to the shared folder and deleted after it.
    """
    like = Similarity(words, num, den)
    body = docs.select(F.col(doc_id).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    features = written(_features(body, like), "features")
    rows = features.where("seen is null").drop("seen")
    sets = written(rows.where("n > 0").groupBy("set").agg(F.min("id").alias("id")), "sets")
    members = _members(body, like, np.zeros(0, np.uint64) if like.by_blocks else _hot(features))
    inside = written(members.select("set").distinct().join(sets, "set").select(F.col("set"), id_key(F.col("id")).alias("least")), "inside")
    texts = written(_with_set(body.hint("merge").join(inside, id_key(F.col("id")) == F.col("least")).select("set", "text"), like), "texts")
    at = written(_points(texts, like), "points")
    release(inside)
    parts = None
    for step in ("first", "second", "last"):
        left = _labelled(members, parts)
        if step != "first" and left.isEmpty():
            release(left)
            break
        pairs = _by_trees(left, at, like) if step == "last" else _by_leaders(left, at, like, one_each=step == "first")
        linked = _verified(pairs, texts, like).select(F.greatest("label_a", "label_b").alias("u"), F.least("label_a", "label_b").alias("v"))
        linked = written(linked.distinct(), "links")
        release(left, pairs)
        if not linked.isEmpty():
            new = components_of_pairs(linked)
            before, parts = parts, written(new if parts is None else joined(parts, new), "parts")
            release(*new.folio_uses, *([before] if before is not None else []))
        else:
            release(linked)
    release(members, texts, at)
    if parts is None:
        named = sets.select("set", F.col("id").alias("component_id"))
        used = []
    else:
        of_set = sets.join(parts.withColumnRenamed("node", "set"), "set", "left").select("set", "id", F.coalesce("component", "set").alias("part"))
        of_set = written(of_set, "of-set")
        least = written(of_set.groupBy("part").agg(F.min("id").alias("component_id")), "least")
        named = of_set.join(least, "part").select("set", "component_id")
        used = [parts, of_set, least]
    out = rows.join(named.withColumnRenamed("set", "named"), (F.col("n") > 0) & (F.col("set") == F.col("named")), "left")
    out = out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))
    out = written(out, "groups")
    release(features, sets, *used)
    return out


def one_of_each_group(docs: DataFrame, words: int, num: int, den: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the rows that linked_groups links to a row of a smaller doc_id. Exact repeats of a row's id and text are one
    row then; rows with a null doc_id stay only in groups without any other id. Order of rows isn't kept."""
    groups = linked_groups(docs, words, num, den, doc_id, text)
    key = free_name(docs, "id__")
    keep = groups.where("doc_id <=> component_id").select(id_key(F.col("doc_id")).alias(key)).distinct()
    out = docs.hint("merge").join(keep, id_key(F.col(doc_id)) == F.col(key), "left_semi")
    if not groups.groupBy("doc_id").count().where("count > 1").isEmpty():
        out = out.dropDuplicates([doc_id, text])
    return out


def op1_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return linked_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=3, num=90, den=100)
