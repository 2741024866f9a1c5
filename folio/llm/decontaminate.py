"""Benchmark decontamination: word windows of the benchmark, looked up in every window of the documents."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StringType, StructField, StructType

from .common import ascii_lower, free_name, plain, release, written
from .kernels import ALNUM, Words, chunks

WINDOW = 13
#: Bytes of a window set that is sent to all tasks, about. A larger benchmark is scanned for in parts of that size.
MOST_BYTES = 64 << 20
#: Bytes that a window, or a word, takes in a window set beside its text.
WINDOW_BYTES = 24


class WindowSet:
    """The windows of a benchmark: for each number of words the sorted hashes, and of each window its item and its words, as a place
    in one byte string that holds every item's words once."""

    def __init__(self, items: Sequence[tuple[object, str | None]], window: int = WINDOW):
        self.items = [None if i is None else str(i) for i, _ in items]
        found: dict[int, list[tuple[np.ndarray, ...]]] = {}
        texts, size_of_all = [], 0
        for a, b, part in chunks([t for _, t in items]):
            w = Words(part, ALNUM)
            words = w.text(0, len(w.start))
            joined = b" ".join(words) + b" "
            ends = np.cumsum([len(x) + 1 for x in words]) + size_of_all  # each word's end, its space included
            begins = np.concatenate(([size_of_all], ends[:-1])) if len(ends) else ends
            of = np.repeat(np.arange(a, b), np.diff(w.first))
            n = np.diff(w.first)[of - a]
            for size in np.unique(np.minimum(n, window)).tolist():
                # items of at least `window` words have windows of it, each shorter one is a window of its own length
                first = np.flatnonzero((np.minimum(n, window) == size) & (np.arange(len(of)) + size <= w.first[of - a + 1]))
                hashes = w.shingles(size)[first]
                found.setdefault(size, []).append((hashes, of[first].astype(np.int32), begins[first], ends[first + size - 1] - 1))
            texts.append(joined)
            size_of_all += len(joined)
        self.text = b"".join(texts)
        self.by_length: dict[int, tuple[np.ndarray, ...]] = {}
        for size, parts in found.items():
            hashes, item, begin, end = (np.concatenate(c) for c in zip(*parts, strict=True))
            order = np.argsort(hashes, kind="stable")
            self.by_length[size] = tuple(x[order] for x in (hashes, item, begin, end))

    def nbytes(self) -> int:
        return len(self.text) + sum(x.nbytes for columns in self.by_length.values() for x in columns)

    def scan(self, w: Words, i: int, shingles: dict[int, tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, set[int]]:
        """Which words of text i are inside an occurrence of a window, and the items (by number) of those windows."""
        lo, hi = int(w.first[i]), int(w.first[i + 1])
        cover = np.zeros(hi - lo + 1, np.int64)
        items: set[int] = set()
        for size, (hashes, item, begin, end) in self.by_length.items():
            if hi - lo < size:
                continue
            own, places = shingles[size]
            for p in places[np.searchsorted(places, lo) : np.searchsorted(places, hi - size + 1)].tolist():
                a, b = (int(np.searchsorted(hashes, own[p], side)) for side in ("left", "right"))
                got = b" ".join(w.text(p, p + size))
                same = [j for j in range(a, b) if self.text[begin[j] : end[j]] == got]
                if same:
                    cover[p - lo] += 1
                    cover[p - lo + size] -= 1
                    items.update(item[same].tolist())
        return np.cumsum(cover[:-1]) > 0, items

    def candidates(self, w: Words) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """By number of words: the hashes at each word, and the places whose hash a window has."""
        out = {}
        for size, (hashes, *_) in self.by_length.items():
            h = w.shingles(size)
            at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            out[size] = (h, np.flatnonzero(hashes[at] == h))
        return out


def benchmark_parts(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", window: int = WINDOW, most: int = MOST_BYTES) -> tuple[int, Callable[[int], WindowSet]]:
    """(n, part): the windows of a benchmark as n sets of about `most` bytes, items whole; part(k) collects one. Words are counted by
    the tasks first."""
    rows = benchmark.select(F.col(item_id).alias("item"), F.col(text).alias("text"))
    words = F.size(F.regexp_extract_all(ascii_lower(F.col("text")), F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), 0))
    size = rows.where("text is not null").agg(F.sum(F.octet_length("text") + WINDOW_BYTES * words)).first()[0] or 0
    n = max(1, -(-size // most))

    def part(k: int) -> WindowSet:
        some = rows if n == 1 else rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k)
        return WindowSet([(r[0], r[1]) for r in some.collect()], window)

    return n, part


_SPANS = ArrayType(StructType([StructField("start", IntegerType()), StructField("end", IntegerType())]))


def _hits(docs: DataFrame, windows: WindowSet, source: str, spans: str, ids: str, nameless: str) -> DataFrame:
    """docs with the runs of words that windows of this set hit, the ids of their items, and how many items have no id."""
    sent = docs.sparkSession.sparkContext.broadcast(windows)
    schema = StructType([*docs.schema.fields, StructField(spans, _SPANS), StructField(ids, ArrayType(StringType())), StructField(nameless, LongType())])
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found_spans, found_ids, found_nameless = [], [], []
            for a, b, part in chunks(batch.column(source).to_pylist()):
                w = Words(part, ALNUM)
                hashes = sent.value.candidates(w)
                for i in range(b - a):
                    hit, items = sent.value.scan(w, i, hashes)
                    step = np.flatnonzero(np.diff(hit.astype(np.int8), prepend=np.int8(0), append=np.int8(0))).tolist()
                    names = {sent.value.items[x] for x in items}
                    found_spans.append([{"start": x, "end": y} for x, y in zip(step[::2], step[1::2], strict=True)])
                    found_ids.append(sorted(names - {None}))
                    found_nameless.append(int(None in names))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found_spans, kind), pa.array(found_ids, pa.list_(pa.string())), pa.array(found_nameless, pa.int64())], names=[*batch.schema.names, spans, ids, nameless])

    return docs.mapInArrow(scan, schema)


def scan_documents(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW, clean: bool = False, most: int = MOST_BYTES) -> DataFrame:
    """docs with n_words, n_hit (words inside a benchmark window), n_items, item_ids, items_sha256 and contaminated.

    A-Z are lower-cased; words are runs of letters, digits and non-ASCII characters. The benchmark's
    windows of `window` consecutive words (an item with fewer words is one window) are a hash set in
    every task, of about `most` bytes; every window of every document is looked up in one scan
    without a shuffle, and a hit is compared word by word. A larger benchmark is taken in parts: a scan for each,
    its hits kept in a written table, and the same result. contaminated: n_hit > 0 and 20 * n_hit >= n_words.
    clean=True adds clean_text: the text without the hit words (from the first hit word of a run to
    its last; what separates the rest stays).

    Null and empty texts have no words; items without words have no windows; with an empty benchmark
    nothing is hit. Items without an id count as one item and aren't in item_ids. Texts are scanned whole,
    however long. Repeated rows each get a row. Columns of docs with an added name are replaced.
    """
    added = ["n_words", "n_hit", "n_items", "item_ids", "items_sha256", "contaminated"] + ["clean_text"] * clean
    docs, [text], restored = plain(docs, text)
    kept = [f for f in docs.schema.fields if f.name.lower() not in added]
    source, spans, ids, nameless = (free_name(docs, x) for x in ("scan__", "spans__", "ids__", "nameless__"))
    rows = docs.select(*(f.name for f in kept), F.col(text).alias(source))
    n_parts, part_of = benchmark_parts(benchmark, window=window, most=most)
    names = [(f"{spans}{k}", f"{ids}{k}", f"{nameless}{k}") for k in range(n_parts - 1)]
    for k, columns in enumerate(names):
        before, rows = rows, written(_hits(rows, part_of(k), source, *columns), "hits")
        if k:
            release(before)
    sent = docs.sparkSession.sparkContext.broadcast(part_of(n_parts - 1))
    types = [LongType(), LongType(), LongType(), ArrayType(StringType()), StringType(), BooleanType(), StringType()]
    schema = StructType([*kept, *(StructField(c, t) for c, t in zip(added, types, strict=False))])
    arrow = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.string(), pa.bool_(), pa.string()]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {c: [] for c in added}
            texts = batch.column(source).to_pylist()
            earlier = [[batch.column(c).to_pylist() for c in part] for part in names]
            for a, b, part in chunks(texts):
                w = Words(part, ALNUM)
                hashes = sent.value.candidates(w)
                begin = 0
                for i in range(b - a):
                    n = int(w.first[i + 1] - w.first[i])
                    hit, found = sent.value.scan(w, i, hashes)
                    items = {sent.value.items[x] for x in found}
                    for spans_, ids_, nameless_ in earlier:
                        for s in spans_[a + i]:
                            hit[s["start"] : s["end"]] = True
                        items.update([*ids_[a + i], *([None] if nameless_[a + i] else [])])
                    n_hit, listed = int(hit.sum()), sorted(items - {None})
                    for c, x in zip(added, (n, n_hit, len(items), listed, hashlib.sha256(",".join(listed).encode()).hexdigest(), n_hit > 0 and 20 * n_hit >= n), strict=False):
                        out[c].append(x)
                    if clean:
                        out["clean_text"].append(None if texts[a + i] is None else _without(part[i], w, int(w.first[i]), hit, begin))
                    begin += len(part[i]) + 1
            columns = [batch.column(f.name) for f in kept]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array(out[c], t) for c, t in zip(added, arrow, strict=False))], names=schema.names)

    return restored(rows.mapInArrow(scan, schema))


def _without(text: bytes, w: Words, first: int, hit: np.ndarray, begin: int) -> str:
    keep, at = [], 0
    marks = np.flatnonzero(hit)
    for run in np.split(marks, np.flatnonzero(np.diff(marks) > 1) + 1) if len(marks) else []:
        keep.append(text[at : int(w.start[first + run[0]]) - begin])
        at = int(w.end[first + run[-1]]) - begin
    return b"".join([*keep, text[at:]]).decode("utf-8", "surrogatepass")


def op9_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = scan_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


OP9_SQL = r"""
WITH item_words AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
wins AS (
  SELECT DISTINCT item_id, len(v) AS size, array_to_string(v, ' ') AS win
  FROM (SELECT item_id, unnest([w[i:i + least(13, len(w)) - 1] FOR i IN range(1, greatest(len(w) - 12, 1) + 1)]) AS v FROM item_words WHERE len(w) > 0)),
doc_words AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents),
sizes AS (SELECT DISTINCT size FROM wins),
doc_wins AS (
  SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS win
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM doc_words, sizes WHERE len(w) >= size)),
hits AS (SELECT doc_id, i, d.size, item_id FROM doc_wins d JOIN wins b ON d.size = b.size AND d.win = b.win),
hit_words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM hits) GROUP BY doc_id),
hit_items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc_words LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
"""
