"""Removal of long strings that occur earlier, by a sparse suffix array over all documents.

Of every window of `length` bytes the gram of GRAM bytes with the least hash is its anchor, so equal windows have equal anchors at
the same offset, and a suffix has to be kept only for each anchor: about one in 35 bytes. The windows that share an
anchor are one segment. Suffixes go to buckets between splitters that are sampled from the keys: the suffix's leading text, then
what tells the rest apart. A bucket is sorted by multikey quicksort, equal segments are neighbours, and what
meets a bucket's edge is compared with the neighbouring buckets'. Equal segments are settled there; segments that share only their
anchor are compared window by window, on their bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from .common import free_name, n_tasks, plain, release, written
from .kernels import mix, runs

LENGTH, GRAM = 100, 32
#: Bytes of text whose segments are found at once; a place in them and a hash share 64 bits, so below 2**PLACE_BITS.
BLOCK, PLACE_BITS = 1 << 18, 20
#: Suffixes that a task sorts at once, about, and the most buckets that they are dealt to; of a larger bucket, whole runs of equal
#: leading text at a time.
BUCKET, MOST_BUCKETS = 1 << 20, 1 << 16
#: Distinct segments of one anchor from which their windows are compared by hash in many tasks, instead of in one.
HOT_ANCHOR = 2_000
_A, _B, _C, _D = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))
DUPLICATE, COMPARE, COMPARE_HOT, EDGE, SUMMARY = 1, 2, 3, 4, 0


def _grams(data: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes at each place."""
    words = np.ndarray((len(data) - 7,), "<u8", buffer=data, strides=(1,))
    x = words * _A
    x ^= x >> np.uint64(29)
    y = x[8:] * _B
    y += x[:-8]
    y ^= y >> np.uint64(32)
    out = y[16:] * _C
    out += y[:-16] * _D
    out ^= out >> np.uint64(31)
    out *= _A
    out ^= out >> np.uint64(29)
    return out


def _window_hash(grams: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Hash of `length` bytes from each place on."""
    out = np.zeros(len(at), np.uint64)
    for begin in [*range(0, length - GRAM, GRAM), length - GRAM]:
        out = mix(out * _B + grams[at + begin])
    return out


def segments(data: np.ndarray, begins: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """(document, first window, windows, lead, gram, digest in two halves) of each segment of the documents in data, that begin
    at begins[:-1] and end at begins[1:]. lead: the first eight bytes of the suffix from the anchor on, as a number of the same
    order; gram: a hash of all bytes of the anchor; digest: BLAKE2 of all bytes of the segment. data: fewer than 2**PLACE_BITS bytes."""
    n = len(data)
    if n < length:
        return tuple(np.zeros(0, k) for k in (np.int64,) * 3 + (np.uint64,) * 4)
    grams = _grams(data)
    low = np.uint64((1 << PLACE_BITS) - 1)
    least = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    wide, width = length - GRAM + 1, 1
    while 2 * width <= wide:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    least = np.minimum(least[: n - length + 1], least[wide - width : wide - width + n - length + 1])
    anchor = (least & low).astype(np.int64)
    whole = np.zeros(n + 1, np.int32)  # windows that end in their own document
    sized = np.diff(begins) >= length
    np.add.at(whole, begins[:-1][sized], 1)
    np.add.at(whole, begins[1:][sized] - length + 1, -1)
    whole = np.cumsum(whole)[: n - length + 1] > 0
    new = np.ones(len(anchor), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | ~whole[:-1]
    first = np.flatnonzero(whole & new)
    stops = np.append(np.flatnonzero(new | ~whole), len(anchor))
    end = stops[np.searchsorted(stops, first, side="right")]
    at = anchor[first]
    lead = np.ndarray((n - 7,), ">u8", buffer=data, strides=(1,))[at].astype(np.uint64)
    raw = data.tobytes()
    digests = b"".join([hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(first.tolist(), (end + length - 1).tolist(), strict=True)])
    halves = np.frombuffer(digests, "<u8").reshape(-1, 2)
    doc = np.searchsorted(begins, first, side="right") - 1
    return doc, first - begins[doc], end - first, lead, mix(grams[at]), halves[:, 0], halves[:, 1]


def blocks(texts: list[bytes], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, where the texts begin in them, the texts' numbers, bytes of each text before): texts in blocks of about
    BLOCK bytes; a longer text in several, that overlap so that each window is in one of them."""
    held, numbers, before, size = [], [], [], 0

    def out():
        return np.frombuffer(b"".join(held), np.uint8), np.cumsum([0, *map(len, held)]), np.array(numbers), np.array(before)

    for i, t in enumerate(texts):
        for at in range(0, max(len(t) - length + 1, 1), BLOCK):
            part = t[at : at + BLOCK + length - 1]
            if held and size + len(part) > BLOCK:
                yield out()
                held, numbers, before, size = [], [], [], 0
            held.append(part)
            numbers.append(i)
            before.append(at)
            size += len(part)
    if held:
        yield out()


def multikey_order(keys: list[np.ndarray]) -> np.ndarray:
    """Order by the first key, ties by the next, and so on: multikey quicksort, all runs of ties of a level at once."""
    order = np.argsort(keys[0], kind="stable")
    tied = _tied(keys[0][order], np.zeros(len(order), np.int64))
    for key in keys[1:]:
        rows = np.flatnonzero(tied >= 0)
        if not len(rows):
            break
        inside = order[rows]
        by = np.lexsort((key[inside], tied[rows]))
        order[rows] = inside[by]
        again = _tied(key[order[rows]], tied[rows])
        tied = np.full(len(order), -1, np.int64)
        tied[rows] = again
    return order


def _tied(sorted_key: np.ndarray, run: np.ndarray) -> np.ndarray:
    """Number of the run of ties that each row is in, -1 outside."""
    n = len(sorted_key)
    if not n:
        return run
    new = np.ones(n, bool)
    new[1:] = (sorted_key[1:] != sorted_key[:-1]) | (run[1:] != run[:-1])
    number = np.cumsum(new)
    size = np.bincount(number)
    return np.where(size[number] > 1, number, -1)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


_KEYS = ["lead", "gram", "d0", "d1"]
_SUFFIXES = ", ".join(f"{c} long" for c in [*_KEYS, "doc", "place"]) + ", known boolean"


def _suffixes(docs: DataFrame, length: int) -> DataFrame:
    """A row for each segment; place: first window << 12 ... windows. Of equal ones in a batch all but the first are known duplicates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc").to_numpy(zero_copy_only=False)
            texts = [t.encode("utf-8", "surrogatepass") for t in batch.column("text").to_pylist()]
            found = []
            for data, begins, numbers, before in blocks(texts, length):
                doc, first, n, *keys = segments(data, begins, length)
                found.append((*keys, ids[numbers[doc]], (first + before[doc]) * (1 << 12) + n))
            if not found:
                continue
            columns = [np.concatenate(c) for c in zip(*found, strict=True)]
            order = multikey_order([columns[2], columns[3], *columns[4:]])  # equal digests are equal in all keys
            columns = [c[order] for c in columns]
            # A repeated row of one document isn't earlier than itself: only another place is a duplicate.
            known = _not_first(_changes(columns[2:4]), *columns[4:])
            for c in columns[:4]:
                c[known] = 0
            yield pa.RecordBatch.from_arrays([*map(_signed, columns), pa.array(known)], names=[*_KEYS, "doc", "place", "known"])

    return docs.mapInArrow(run, _SUFFIXES)


def _changes(keys: list[np.ndarray]) -> np.ndarray:
    """Which rows differ in a key from the row before; the first does."""
    out = np.ones(len(keys[0]), bool)
    out[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    return out


def _not_first(new: np.ndarray, doc: np.ndarray, place: np.ndarray) -> np.ndarray:
    """For rows of runs that begin at `new`, sorted by doc and place: which are at another place than the first of their run."""
    if not len(new):
        return new
    head = np.flatnonzero(new)[np.cumsum(new) - 1]
    return (doc != doc[head]) | (place != place[head])


_MARKS = "state int, anchor long, doc long, place long"


def _sorted_buckets(suffixes: DataFrame, n: int, hot: int) -> DataFrame:
    """Marks of the suffixes: duplicates, those to compare, those at an edge; and a summary of each bucket's edges.

    anchor: a hash of lead and gram; if two anchors share it, more is compared, nothing else."""
    ranged = suffixes.where("not known").select(*_KEYS, "doc", "place").repartitionByRange(n, "lead", "gram", "d0").sortWithinPartitions("lead")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, before = False, None
        for table, last in _runs_of_lead(batches):
            keys = [table.column(c).to_numpy() for c in [*_KEYS, "doc", "place"]]
            order = multikey_order(keys)
            lead, gram, d0, d1, doc, place = (k[order] for k in keys)
            new_anchor = _changes([lead, gram])
            new = _changes([lead, gram, d0, d1])
            anchor = mix(lead.view(np.uint64) * _A + gram.view(np.uint64)).view(np.int64)
            group = np.cumsum(new_anchor) - 1
            distinct = np.bincount(group, weights=new).astype(np.int64)[group]
            state = np.where(distinct >= hot, COMPARE_HOT, np.where(distinct > 1, COMPARE, -1))
            edge = np.zeros(len(order), bool)
            if not opened:
                edge |= group == 0
            if last:
                edge |= group == group[-1]
            opened = True
            state[edge] = EDGE
            state[~new] = -1
            state[_not_first(new, doc, place)] = DUPLICATE
            out = state >= 0
            ends = edge & new_anchor
            yield _marks(np.full(int(ends.sum()), SUMMARY), anchor[ends], distinct[ends], np.zeros(int(ends.sum()), np.int64))
            yield _marks(state[out], anchor[out], doc[out], place[out])

    return ranged.mapInArrow(run, _MARKS)


def _marks(state: np.ndarray, anchor: np.ndarray, doc: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(state.astype(np.int32)), pa.array(anchor), pa.array(doc), pa.array(place)], names=["state", "anchor", "doc", "place"])


def _runs_of_lead(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, bool]]:
    """(rows, whether they are the last), for rows sorted by lead: about BUCKET rows at a time, whole runs of equal leads."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= BUCKET:
            table = pa.Table.from_batches(held)
            lead = table.column("lead").to_numpy()
            done = int(np.flatnonzero(lead[1:] != lead[:-1])[-1]) + 1 if (lead[1:] != lead[:-1]).any() else 0
            if done:
                yield table.slice(0, done), False
            held, size = table.slice(done).to_batches(), table.num_rows - done
    if size:
        yield pa.Table.from_batches(held), True


def _compared(docs: DataFrame, marks: DataFrame, length: int, hot: int) -> DataFrame:
    """(doc, start, end): runs of windows, of the segments to compare, that occur earlier."""
    spark = docs.sparkSession
    edges = F.broadcast(marks.where(f"state = {SUMMARY}").groupBy(F.col("anchor").alias("met")).agg(F.sum("doc").alias("total")))  # two anchors a bucket
    kind = F.when(F.col("state") != EDGE, F.col("state")).when(F.col("total") >= hot, COMPARE_HOT).otherwise(COMPARE)
    asked = marks.where(f"state in ({COMPARE}, {COMPARE_HOT}, {EDGE})").join(edges, (F.col("state") == EDGE) & (F.col("anchor") == F.col("met")), "left").where(f"state <> {EDGE} or total > 1")
    asked = asked.groupBy("doc").agg(F.collect_list(F.struct(kind.alias("state"), "anchor", "place")).alias("asked"))
    rows = docs.hint("merge").join(asked, "doc").select("doc", "text", "asked")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            windows: dict[bytes, tuple[int, int]] = {}  # of hot anchors: the first place in this batch
            for doc, text, asked in zip(*(batch.column(c).to_pylist() for c in ("doc", "text", "asked")), strict=True):
                data = text.encode("utf-8", "surrogatepass")
                for a in asked:
                    first, n = a["place"] >> 12, a["place"] & 4095
                    if first + n + length - 1 > len(data):
                        continue  # another row's segment, if rows share an id
                    if a["state"] == COMPARE:
                        out.append((a["anchor"], doc, first, n, data[first : first + n + length - 1]))
                        continue
                    for p in range(first, first + n):
                        w = data[p : p + length]
                        least = windows.setdefault(w, (doc, p))
                        if (doc, p) != least:  # the later one is known and needs no comparison: sent without its bytes
                            windows[w] = min(least, (doc, p))
                            known = max(least, (doc, p))
                            out.append((_spread(*known), *known, 0, b""))
            out += ((int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little", signed=True), doc, p, 1, w) for w, (doc, p) in windows.items())
            key, doc, first, n, data = zip(*out, strict=True) if out else ((), (), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(doc, pa.int64()), pa.array(first, pa.int64()), pa.array(n, pa.int64()), pa.array(data, pa.binary())], names=["key", "doc", "first", "n", "data"])

    strings = rows.mapInArrow(cut, "key long, doc long, first long, n long, data binary")
    grouped = strings.repartition(n_tasks(spark), "key").sortWithinPartitions("key")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            known = batch.column("n").to_numpy() == 0
            if known.any():
                found = batch.filter(pa.array(known))
                yield pa.RecordBatch.from_arrays([found.column("doc"), found.column("first"), pa.array(found.column("first").to_numpy() + 1)], names=["doc", "start", "end"])
                batch = batch.filter(pa.array(~known))
            key = batch.column("key").to_numpy()
            if not len(key):
                continue
            cut_at = int(np.searchsorted(key, key[-1]))  # the last key may go on in the next batch
            if cut_at or (held and held[-1].column("key")[-1].as_py() != int(key[0])):
                yield from _later_windows([*held, batch.slice(0, cut_at)], length)
                held = []
            held.append(batch.slice(cut_at))
        yield from _later_windows(held, length)

    return grouped.mapInArrow(compare, "doc long, start long, end long")


def _spread(doc: int, place: int) -> int:
    """A key that deals known windows out evenly."""
    return int(mix(np.array([(doc * 31 + place) & 0xFFFFFFFFFFFFFFFF], np.uint64)).view(np.int64)[0])


def _later_windows(batches: list[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Windows of the strings that another string of the same key has at an earlier place, as runs."""
    rows = [b for b in batches if b.num_rows]
    if not rows:
        return
    table = pa.Table.from_batches(rows)
    key, doc, first, n = (table.column(c).to_numpy() for c in ("key", "doc", "first", "n"))
    strings = table.column("data").to_pylist()
    group = np.cumsum(np.concatenate(([0], key[1:] != key[:-1])))
    bounds = np.append(np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1]))), len(key))
    part = 0
    while part < len(bounds) - 1:  # some groups at a time
        end, a = part + 1, bounds[part]
        while end < len(bounds) - 1 and bounds[end + 1] - a < 4096:
            end += 1
        b = bounds[end]
        part = end
        data = np.frombuffer(b"".join(strings[a:b]), np.uint8)
        begins = np.cumsum([0, *map(len, strings[a:b])])[:-1]
        if len(data) < GRAM:
            continue
        grams = _grams(data)
        count = n[a:b]
        row = np.repeat(np.arange(b - a), count)
        inside = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        at = begins[row] + inside
        hashes = _window_hash(grams, at, length)
        g, d, p = group[a:b][row], doc[a:b][row], first[a:b][row] + inside
        order = multikey_order([hashes, g, d, p])
        new = _changes([hashes[order], g[order]])
        if not _same_bytes(data, at[order], new, length):  # a hash of two strings: by the strings themselves
            raw = data.tobytes()
            numbers: dict[bytes, int] = {}
            hashes = np.array([numbers.setdefault(raw[x : x + length], len(numbers)) for x in at.tolist()])
            order = multikey_order([hashes, g, d, p])
            new = _changes([hashes[order], g[order]])
        later = np.zeros(len(order), bool)
        later[order] = _not_first(new, d[order], p[order])
        # runs of windows of one string
        joined = later & np.concatenate(([False], later[:-1] & (row[1:] == row[:-1])))
        start = np.flatnonzero(later & ~joined)
        if not len(start):
            continue
        size = np.add.reduceat(later.astype(np.int64), start) if len(start) else start
        yield pa.RecordBatch.from_arrays([pa.array(d[start]), pa.array(p[start]), pa.array(p[start] + size)], names=["doc", "start", "end"])


def _same_bytes(data: np.ndarray, at: np.ndarray, new: np.ndarray, length: int) -> bool:
    """Whether the `length` bytes from each place on are those from the place at which its run, marked by `new`, begins."""
    rest = np.flatnonzero(~new)
    head = at[np.flatnonzero(new)[np.cumsum(new)[rest] - 1]]
    for i in range(0, len(rest), 4096):
        reach = np.arange(length)
        if (data[at[rest[i : i + 4096], None] + reach] != data[head[i : i + 4096, None] + reach]).any():
            return False
    return True


def id_key(col: Column) -> Column:
    """A document's place in the order: its id, null before all."""
    return F.coalesce(col.cast("long"), F.lit(-(1 << 63)))


def repeated_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, spans: str = "spans", hot: int = HOT_ANCHOR) -> DataFrame:
    """docs with `spans`, array of (start, end): the maximal runs of bytes of each text (UTF-8) that are covered by a string of
    `length` bytes which also starts earlier: in a document of smaller doc_id, or before in the same one.

    Overlaps count, and the strings are those of the input. Null texts are empty. doc_id tells documents apart; a null one comes
    first. Rows that share a doc_id are at the same place: they don't remove each other's text, and a span found for one is
    taken from all, clipped to each. length: GRAM + 1 to 2000. Texts shorter than that have no spans; no rows give none.

    Segments are equal if 128 bits of BLAKE2 are; windows that are compared, if their bytes are. Exchanges: 48 bytes for each of
    about 1 in 35 bytes of text; twice the texts, to cut out strings and to hand out spans; strings of the segments that share only
    their anchor. A batch's equal segments, and a hot anchor's windows, are combined before they are sent. Between these, tables are
    written to the shared folder.
    """
    docs, [doc_id, text], restored = plain(docs, doc_id, text)
    kept = docs.drop(spans) if spans != text else docs
    schema = StructType([*kept.schema.fields, StructField(spans, ArrayType(StructType([StructField("start", LongType()), StructField("end", LongType())])))])
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def add(batch: pa.RecordBatch, texts: list, found: list[list[tuple[int, int]]]) -> pa.RecordBatch:
        column = pa.array([[{"start": a, "end": b} for a, b in x] for x in found], kind)
        return pa.RecordBatch.from_arrays([*batch.columns, column], names=[*batch.schema.names, spans])

    return restored(_with_spans(kept, doc_id, text, length, hot, add, schema))


def _with_spans(rows: DataFrame, doc_id: str, text: str, length: int, hot: int, finish, schema) -> DataFrame:
    """finish(batch, texts, spans of each) of all rows, of the given schema: in the task that puts the spans together."""
    if not GRAM < length <= 2000:
        raise ValueError(f"length must be over {GRAM} and at most 2000")
    spark = rows.sparkSession
    doc_key, found_key = free_name(rows, "doc__"), free_name(rows, "found__")
    body = rows.select(id_key(F.col(doc_id)).alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    suffixes = written(_suffixes(body, length), "suffixes")
    n = max(n_tasks(spark), min(MOST_BUCKETS, -(-suffixes.count() // BUCKET)))
    marks = written(_sorted_buckets(suffixes, n, hot), "marks")
    whole = F.shiftright("place", 12).alias("start"), (F.shiftright("place", 12) + F.col("place").bitwiseAND(4095)).alias("end")
    sure = marks.where(f"state = {DUPLICATE}").select("doc", *whole).union(suffixes.where("known").select("doc", *whole))
    compared = written(_compared(body, marks, length, hot), "compared")
    lists = sure.unionByName(compared).groupBy("doc").agg(F.collect_list(F.struct("start", "end")).alias(found_key)).withColumnRenamed("doc", doc_key)
    lists = written(lists, "spans")
    release(suffixes, marks, compared)
    joined = rows.hint("merge").join(lists, id_key(F.col(doc_id)) == F.col(doc_key), "left").drop(doc_key)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, out = batch.column(text).to_pylist(), []
            for t, found in zip(texts, batch.column(found_key).to_pylist(), strict=True):
                if not found or not t:
                    out.append([])
                    continue
                size = len(t.encode("utf-8", "surrogatepass"))
                cover = np.zeros(size + 1, np.int64)
                for f in found:
                    if f["start"] < size:
                        cover[f["start"]] += 1
                        cover[min(f["end"] + length - 1, size)] -= 1
                out.append(list(zip(*(x.tolist() for x in runs(np.cumsum(cover[:-1]) > 0)), strict=True)))
            yield finish(batch.drop_columns([found_key]), texts, out)

    return joined.mapInArrow(merge, schema)


def without_spans(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    keep, at = [], 0
    for a, b in spans:
        keep.append(data[at:a])
        at = b
    return b"".join([*keep, data[at:]])


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """docs with the repeated spans cut out of each text, without the rows of which nothing but white space is left by that.

    Spans are bytes: of a character that a span cuts through, the rest goes too. Null and untouched texts stay as they are.
    """
    docs, [doc_id, text], restored = plain(docs, doc_id, text)
    names, at = docs.columns, docs.columns.index(text)

    def cut(batch: pa.RecordBatch, texts: list, found: list[list[tuple[int, int]]]) -> pa.RecordBatch:
        keep = np.ones(batch.num_rows, bool)
        for i, spans in enumerate(found):
            if spans:
                texts[i] = without_spans(texts[i].encode("utf-8", "surrogatepass"), spans).decode("utf-8", "ignore")
                keep[i] = bool(texts[i].strip())
        return batch.set_column(at, names[at], pa.array(texts, batch.column(at).type)).filter(pa.array(keep))

    return restored(_with_spans(docs, doc_id, text, length, HOT_ANCHOR, cut, docs.schema))


def op3_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")

    def digest(batch: pa.RecordBatch, texts: list, found: list[list[tuple[int, int]]]) -> pa.RecordBatch:
        data = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        kept = [hashlib.sha256(without_spans(b, spans)).hexdigest() for b, spans in zip(data, found, strict=True)]
        counts = [len(b) for b in data], [sum(b - a for a, b in spans) for spans in found], [len(spans) for spans in found]
        return pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *(pa.array(c, pa.int64()) for c in counts), pa.array(kept, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return _with_spans(docs, "doc_id", "text", LENGTH, HOT_ANCHOR, digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
