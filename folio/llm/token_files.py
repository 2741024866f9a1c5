"""Token ids in files of directly addressable codes: any token can be read without decoding a block.

Ids are split into chunks of 8 bits. Level 0 holds the lowest chunk of every id, and a bitmap that tells which ids
go on; level 1 holds the next chunk of those that do, and so on. A rank directory counts the bitmap's ones
before each RANK_BITS, so the place of an id's next chunk is one lookup and one popcount away. A file is read by byte
ranges: a token costs its chunks, a few bytes of bitmap and one rank a level, whatever the segment's size.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import n_tasks, new_path, text_or_empty, written
from .files import NewFile, Ranges
from .ranges import by_ranges
from .tokens import tokenizer

MAGIC = b"DACTOK02"
RANK_BITS = 512
#: Ids after which a segment is closed; a longer document has a segment of its own.
SEGMENT_TOKENS = 1 << 21


def encode_segment(doc_ids: list[int | None], ids: list[np.ndarray]) -> bytes:
    """A segment of some documents: a header, the directory of documents, then each level's chunks, bitmap and ranks."""
    starts = np.zeros(len(ids) + 1, "<i8")
    np.cumsum([len(x) for x in ids], out=starts[1:])
    parts = [np.array([x or 0 for x in doc_ids], "<i8").tobytes(), np.packbits([x is None for x in doc_ids], bitorder="little").tobytes(), starts.tobytes()]
    rest, levels = (np.concatenate(ids) if ids else np.zeros(0, np.uint32)), []
    while True:
        parts.append((rest & np.uint32(255)).astype(np.uint8).tobytes())
        on = rest >= 256
        words = np.packbits(on, bitorder="little")
        ranks = np.zeros(len(on) // RANK_BITS + 1, "<u4")
        full = words[: (len(ranks) - 1) * RANK_BITS // 8].reshape(-1, RANK_BITS // 8)
        np.cumsum(np.bitwise_count(full).sum(axis=1, dtype=np.uint32), out=ranks[1:])
        parts += [words.tobytes(), ranks.tobytes()]
        levels.append(len(rest))
        rest = rest[on] >> np.uint32(8)
        if not len(rest):
            break
    places, at = [], 0
    for p in parts:
        places.append([at, len(p)])
        at += len(p)
    body = b"".join(parts)
    head = json.dumps({"docs": len(ids), "levels": levels, "places": places, "crc32": zlib.crc32(body)}).encode()
    return MAGIC + struct.pack("<II", len(head), zlib.crc32(head)) + head + body


class Segment:
    """Reads a segment by byte ranges: fetch(offset, length) gives bytes from where the segment begins.

    The header is checked as it is read. A whole read (documents) checks the body too; reads of single tokens don't."""

    def __init__(self, fetch: Callable[[int, int], bytes]):
        self.fetch = fetch
        start = fetch(0, len(MAGIC) + 8)
        if start[: len(MAGIC)] != MAGIC:
            raise ValueError("not a segment of token ids")
        n, check = struct.unpack_from("<II", start, len(MAGIC))
        raw = fetch(len(start), n)
        if zlib.crc32(raw) != check:
            raise ValueError("the segment's header is damaged")
        self.head = json.loads(raw)
        self.body = len(start) + n

    @classmethod
    def of_bytes(cls, data: bytes) -> Segment:
        """A segment that is in memory whole."""

        def fetch(offset: int, length: int) -> bytes:
            if offset + length > len(data):
                raise ValueError("the segment is cut off")
            return data[offset : offset + length]

        return cls(fetch)

    def _part(self, i: int, first: int = 0, count: int | None = None, kind=np.uint8) -> np.ndarray:
        """Elements first to first + count of the body's i-th part."""
        at, size = self.head["places"][i]
        width = np.dtype(kind).itemsize
        count = size // width - first if count is None else count
        return np.frombuffer(self.fetch(self.body + at + first * width, count * width), kind)

    def check(self) -> None:
        """Reads the whole body; a ValueError if it isn't what was written."""
        at, size = self.head["places"][-1]
        if zlib.crc32(self.fetch(self.body, at + size)) != self.head["crc32"]:
            raise ValueError("the segment is damaged")

    def doc_ids(self) -> list[int | None]:
        null = np.unpackbits(self._part(1), count=self.head["docs"], bitorder="little")
        return [None if m else i for i, m in zip(self._part(0, kind="<i8").tolist(), null.tolist(), strict=True)]

    def starts(self) -> np.ndarray:
        """The number of ids before each document, and of all."""
        return self._part(2, kind="<i8")

    def rank(self, level: int, i: int) -> int:
        """How many of the first i ids of a level go on to the next."""
        block, bits = i // RANK_BITS, i % RANK_BITS
        known = int(self._part(5 + 3 * level, block, 1, "<u4")[0])
        if not bits:
            return known
        some = self._part(4 + 3 * level, block * RANK_BITS // 8, (bits + 7) // 8)
        return known + int(np.unpackbits(some, count=bits, bitorder="little").sum())

    def token(self, i: int) -> int:
        """Id at place i."""
        out = 0
        for level in range(len(self.head["levels"])):
            out |= int(self._part(3 + 3 * level, i, 1)[0]) << 8 * level
            if not int(self._part(4 + 3 * level, i // 8, 1)[0]) >> i % 8 & 1:
                break
            i = self.rank(level, i)
        return out

    def tokens(self, a: int, b: int) -> np.ndarray:
        """Ids at places a to b: on each level a contiguous range."""
        out = np.zeros(b - a, np.uint32)
        where = np.arange(b - a)
        for level in range(len(self.head["levels"])):
            if a == b:
                break
            out[where] |= self._part(3 + 3 * level, a, b - a).astype(np.uint32) << np.uint32(8 * level)
            bits = self._part(4 + 3 * level, a // 8, (b + 7) // 8 - a // 8)
            on = np.unpackbits(bits, bitorder="little")[a % 8 : a % 8 + b - a].astype(bool)
            where, a = where[on], self.rank(level, a) if on.any() else 0
            b = a + len(where)
        return out

    def document(self, k: int) -> np.ndarray:
        a, b = self._part(2, k, 2, "<i8").tolist()
        return self.tokens(a, b)


def open_segment(files: Ranges, uri: str, offset: int) -> Segment:
    """A segment of a file in the shared store, for reads of single tokens and documents."""
    return Segment(lambda at, n: files.read(uri, offset + at, n))


INDEX = "part int, file string, offset long, length long, first long, n_tokens long, n_docs long"


def write_token_files(docs: DataFrame, vocabulary: str, end: int, folder: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes the ids of each text (null: empty), with the id `end` after each, by ascending doc_id (null first, equal
    ids by text); returns the index of segments, a written table (INDEX; first: the ids before it in its file).

    One exchange of the texts, by ranges of doc_id; each task writes one file, whose name holds the range's number, in
    segments, holding one. Only a finished attempt's file is in the index. No rows give no files.
    """
    folder = folder or new_path(docs.sparkSession, "tokens")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_or_empty(text).alias("text"))
    ranged = by_ranges(rows, "doc_id", ["text"], "part").select("part", "doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, out, at, index = tokenizer(vocabulary), None, None, []
        ids: list[int | None] = []
        held: list[np.ndarray] = []
        size = first = 0

        def close_segment():
            nonlocal size, first
            data = encode_segment(ids, held)
            index.append({"part": at, "file": out.uri, "offset": out.write(data), "length": len(data), "first": first, "n_tokens": size, "n_docs": len(ids)})
            first += size
            size = 0
            ids.clear()
            held.clear()

        for batch in batches:
            names, texts, parts = (batch.column(c).to_pylist() for c in ("doc_id", "text", "part"))
            for d, p, x in zip(names, parts, t.encoded(texts, end), strict=True):
                if p != at or size + len(x) > SEGMENT_TOKENS:
                    if ids:
                        close_segment()
                    if p != at:
                        if out:
                            out.close()
                        out, at, first = NewFile(folder, f"range-{p:06d}-{TaskContext.get().partitionId():06d}", ".dac"), p, 0
                ids.append(d)
                held.append(x)
                size += len(x)
            if index:
                yield pa.RecordBatch.from_pylist(index, schema=_INDEX)
                index.clear()
        if ids:
            close_segment()
            out.close()
            yield pa.RecordBatch.from_pylist(index, schema=_INDEX)

    return written(ranged.mapInArrow(write, INDEX), "token-index")


_INDEX = pa.schema([("part", pa.int32()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("first", pa.int64()), ("n_tokens", pa.int64()), ("n_docs", pa.int64())])
DOCUMENTS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def read_token_files(index: DataFrame) -> DataFrame:
    """One row for each document in the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    Takes the whole index. The driver holds a number for each file, as many as the tasks that wrote them.
    """
    totals = sorted((r[0], r[1]) for r in index.groupBy("part").agg(F.sum("n_tokens")).collect())
    base, before = {}, 0
    for p, n in totals:
        base[p] = before
        before += n
    n = n_tasks(index.sparkSession)
    segments = index.repartition(n, "file", "offset").sortWithinPartitions("file", "offset")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = Ranges()
        for batch in batches:
            for s in batch.to_pylist():
                seg = Segment.of_bytes(files.read(s["file"], s["offset"], s["length"]))  # all of it is asked for
                seg.check()
                starts = seg.starts()
                ids = seg.tokens(0, int(starts[-1])).astype("<u4")
                crcs = [zlib.crc32(ids[a:b]) for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
                columns = [pa.array(seg.doc_ids(), pa.int64()), pa.array(base[s["part"]] + s["first"] + starts[:-1]), pa.array(np.diff(starts)), pa.array(crcs, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32"])
        files.close()

    return segments.mapInArrow(read, DOCUMENTS)


def op6_token_files(spark, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    return read_token_files(write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary, end=0))
