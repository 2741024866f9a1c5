"""Packing of documents into training sequences of equal attention cost."""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty
from .tokens import tokenizer

CAPACITY = 4096
#: Cost of a piece of n ids: LINEAR * n + n * n, in units of one score; a model of width d and depth-wise MLPs spends about 6 * d a token.
LINEAR = 6 * 1024
#: Ids that a task gathers before it packs them. The last, unfilled sequence of each such window is the only padded one.
WINDOW = 1 << 21


def pack(lengths: list[int], capacity: int = CAPACITY, linear: int = LINEAR) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of each piece, for documents of the given numbers of ids.

    As few sequences as hold all ids. Documents go by descending length to the sequence of the lowest cost that has room for
    the whole; one longer than a sequence first fills empty sequences. When no sequence has room for a whole one, it is cut, and
    fills the emptiest first. So every sequence but those that no id is left for is full. Ties go to the first.
    """
    total = sum(lengths)
    n = -(-total // capacity)
    if not n:
        return []
    cost = np.zeros(n, np.int64)
    used = np.zeros(n, np.int64)
    limit = np.full(n, capacity, np.int64)
    limit[-1] = total - (n - 1) * capacity
    pieces = []

    def put(doc: int, start: int, length: int, s: int) -> None:
        pieces.append((doc, start, length, s, int(used[s])))
        used[s] += length
        cost[s] += linear * length + length * length

    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    rest, whole = [], 0
    for i in order:
        at = 0
        while lengths[i] - at >= capacity and whole < n and limit[whole] == capacity:
            put(i, at, capacity, whole)
            at += capacity
            whole += 1
        if at < lengths[i]:
            rest.append((lengths[i] - at, i, at))
    rest.sort(key=lambda x: (-x[0], x[1]))
    heap = [(0, s) for s in range(whole, n)]
    cut = []
    for length, i, at in rest:  # the cheapest sequence mostly has room, so few are looked at
        aside = []
        while heap and used[heap[0][1]] + length > limit[heap[0][1]]:
            aside.append(heapq.heappop(heap))
            if len(aside) > 64:  # then by the table of all
                break
        room = heap and used[heap[0][1]] + length <= limit[heap[0][1]]
        s = heap[0][1] if room else -1
        if not room and heap:
            fits = np.flatnonzero(used + length <= limit)
            s = int(fits[np.argmin(cost[fits])]) if len(fits) else -1
        if s < 0:
            cut.append((length, i, at))
        else:
            put(i, at, length, s)
            if room:
                heapq.heapreplace(heap, (int(cost[s]), s)) if used[s] < limit[s] else heapq.heappop(heap)
            else:
                heap = [(int(cost[x]) if x == s else c, x) for c, x in heap if used[x] < limit[x]]
                heapq.heapify(heap)
        for x in aside:
            if used[x[1]] < limit[x[1]]:
                heapq.heappush(heap, (int(cost[x[1]]), x[1]))
    for length, i, at in cut:
        while length:
            s = int(np.argmax(limit - used))
            take = min(length, int(limit[s] - used[s]))
            put(i, at, take, s)
            at, length = at + take, length - take
    return pieces


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack_documents(docs: DataFrame, vocabulary: str, end: int, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """The pieces (PIECES) of all documents in sequences of at most `capacity` ids; with_ids adds the ids themselves.

    A document: the ids of its text (null: empty), then `end`. Each task packs its own documents, WINDOW ids or one
    longer document at a time, without an exchange; each window pads one sequence at most, so padding stays below
    capacity / WINDOW beyond the last window of each task. sequence_id is unique over all tasks and the same whenever the input is
    split alike. Repeated rows are packed each; null doc_ids stay null; no rows give no pieces.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_or_empty(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, sequence = tokenizer(vocabulary), TaskContext.get().partitionId() << 40
        names: list = []
        held: list[np.ndarray] = []

        def out() -> pa.RecordBatch:
            nonlocal sequence
            pieces = pack([len(x) for x in held], capacity)
            doc, start, length, seq, offset = (np.array(c, np.int64) for c in zip(*pieces, strict=True))
            ids = [held[d][a : a + n] for d, a, n, _, _ in pieces]
            columns = [pa.array([names[d] for d in doc], pa.int64()), pa.array(start), pa.array(length), pa.array([zlib.crc32(x) for x in ids], pa.int64()), pa.array([len(held[d]) for d in doc], pa.int64()), pa.array(sequence + seq), pa.array(offset)]
            if with_ids:
                columns.append(pa.array(ids, pa.list_(pa.int32())))
            sequence += int(seq.max()) + 1
            names.clear()
            held.clear()
            return pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids)

        size = 0
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            for i, x in enumerate(t.encoded(texts, end)):
                names.append(ids[i])
                held.append(x)
                size += len(x)
                if size >= WINDOW:
                    yield out()
                    size = 0
        if held:
            yield out()

    return rows.mapInArrow(run, PIECES + ", ids array<int>" * with_ids)


def op5_packing(spark, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("word_bpe_49k.json")
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary, end=2)
