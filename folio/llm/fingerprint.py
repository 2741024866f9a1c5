"""Bottom-k sketches of word shingles: fingerprints of documents that can be compared and merged."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import plain, text_or_empty, written
from .kernels import NOT_SPACE, Words, chunks
from .ranges import by_ranges

K, SHINGLE = 128, 5


def sketches(texts: list[str | None], k: int = K, words: int = SHINGLE) -> list[np.ndarray]:
    """Of each text: the k least hashes of its distinct shingles (all of them, if it has fewer), sorted."""
    out = []
    for _, _, part in chunks(texts):
        out += [s[:k].copy() for s in Words(part, NOT_SPACE).shingle_sets(words)]
    return out


def encode(sketch: np.ndarray) -> str:
    return base64.b64encode(sketch.astype("<u8").tobytes()).decode()


def decode(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint), "<u8")


def merge(parts: Iterable[np.ndarray], k: int = K) -> np.ndarray:
    """The sketch of the union of the parts' shingles."""
    parts = list(parts)
    return np.unique(np.concatenate(parts))[:k] if parts else np.zeros(0, np.uint64)


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimate of intersection / union: the share of the union's least k hashes that both have. Two empty sets: 1."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    least = merge((a, b), k)
    return float(len(np.intersect1d(np.intersect1d(a, b, assume_unique=True), least, assume_unique=True)) / len(least))


def distinct(a: np.ndarray, k: int = K) -> float:
    """Estimate of the number of distinct shingles; exact below k."""
    return float(len(a)) if len(a) < k else (k - 1) * 2.0**64 / (float(a[k - 1]) + 1)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimate of the share of a's shingles that b has too: among those of a up to the hash to which both sketches are complete. An
    empty a is contained in all."""
    if not len(a):
        return 1.0
    upto = min((s[-1] for s in (a, b) if len(s) >= k), default=np.uint64(2**64 - 1))
    own = a[a <= upto]
    if not len(own):  # a's least hash is beyond b's sketch
        return min(1.0, resemblance(a, b, k) * distinct(merge((a, b), k), k) / distinct(a, k))
    return float(np.isin(own, b, assume_unique=True).mean())


def fingerprints(df: DataFrame, text: str = "text", name: str = "fingerprint", k: int = K, words: int = SHINGLE) -> DataFrame:
    """df with each text's fingerprint: base64 of its sketch. One scan, no exchange.

    Words: A-Z lower-cased, split at ASCII white space; a text of fewer words is one shingle; null, empty and blank texts
    have the empty sketch. Equal texts have equal fingerprints. A column of that name is replaced.
    """
    df = df.drop(name) if name != text else df
    df, [text], restored = plain(df, text)
    schema = StructType([*df.schema.fields, StructField(name, StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [encode(s) for s in sketches(batch.column(text).to_pylist(), k, words)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], names=[*batch.schema.names, name])

    return restored(df.mapInArrow(run, schema))


def merged_fingerprints(df: DataFrame, by: str, name: str = "fingerprint", k: int = K) -> DataFrame:
    """(by, fingerprint) of the union of each group's documents, from their fingerprints.

    Each task merges its own rows before the exchange, holding FLUSH groups at most, so a hot group sends
    about a row a task. Null fingerprints count as empty; null is a group of its own.
    """
    flush = 4096
    schema = df.select(by, name).schema
    types = pa.string()

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        kind = None

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(held), kind), pa.array([encode(s) for s in held.values()], types)], names=[by, name])

        for batch in batches:
            kind = batch.column(by).type
            for key, f in zip(batch.column(by).to_pylist(), batch.column(name).to_pylist(), strict=True):
                held[key] = merge([*([held[key]] if key in held else []), decode(f or "")], k)
            if len(held) >= flush:
                yield out()
                held.clear()
        if held:
            yield out()

    def final(table: pa.Table) -> pa.Table:
        sketch = merge([decode(f or "") for f in table.column(name).to_pylist()], k)
        return pa.table([table.column(by).slice(0, 1), pa.array([encode(sketch)], types)], names=[by, name])

    return df.select(by, name).mapInArrow(partial, schema).groupBy(by).applyInArrow(final, schema)


COMPARED = "distinct double, resemblance double, containment double"


def compared_fingerprints(df: DataFrame, with_: str, name: str = "fingerprint", k: int = K) -> DataFrame:
    """df with estimates from two columns of fingerprints: distinct shingles of `name`, its resemblance to the other, and the share of
    its shingles that the other has. Null fingerprints count as empty. Columns of these names are replaced."""
    df = df.drop("distinct", "resemblance", "containment")
    schema = StructType([*df.schema.fields, *(StructField(c.split()[0], DoubleType()) for c in COMPARED.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [(decode(x or ""), decode(y or "")) for x, y in zip(batch.column(name).to_pylist(), batch.column(with_).to_pylist(), strict=True)]
            columns = [pa.array([f(a, b) for a, b in pairs], pa.float64()) for f in (lambda a, b: distinct(a, k), lambda a, b: resemblance(a, b, k), lambda a, b: containment(a, b, k))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=schema.names)

    return df.mapInArrow(run, schema)


EDITED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited_fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document's fingerprint against those of an edited text and of the next document (EDITED).

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many (or all) of the next
    document's, by ascending doc_id, equal ids by text, null ids first; after the last comes the first. Null texts
    are empty. A single document is its own next. One exchange of the texts; a task holds one batch and one more text.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_or_empty(text).alias("text"))
    ranged = by_ranges(rows, "doc_id", ["text"], "part", "tail").select("doc_id", "text", "part", "tail")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        texts: list[str] = []
        at, ended = None, False

        def out(last: bool) -> pa.RecordBatch:
            """For all held rows but the last, which then is only the next document."""
            n = len(texts) - 1
            edited = [t[: len(t) - len(t) // 2] + u[: len(t) // 2] for t, u in zip(texts[:-1], texts[1:], strict=True)]
            own, other = sketches(texts), sketches(edited)
            columns = [
                pa.array(ids[:n], pa.int64()), pa.array([len(t) for t in texts[:n]], pa.int64()), pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited], pa.string()),
                pa.array([encode(s) for s in own[:n]], pa.string()), pa.array([encode(s) for s in other], pa.string()),
                pa.array([resemblance(a, b) for a, b in zip(own[:n], other, strict=True)], pa.float64()), pa.array([resemblance(a, b) for a, b in zip(own[:n], own[1:], strict=True)], pa.float64()),
            ]
            del ids[: n if not last else n + 1], texts[: n if not last else n + 1]
            return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

        for batch in batches:
            size = 0
            for i, t, p, tail in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "part", "tail")), strict=True):
                if p != at:  # a task may hold more than one range
                    at, ended = p, False
                if ended:
                    continue
                ids.append(i)
                texts.append(t)
                size += len(t)
                ended = tail
                if ended or size > 1 << 20:
                    if len(texts) > 1:
                        yield out(last=ended)
                    size = 0

    return ranged.mapInArrow(run, EDITED)


def op4_fingerprints(spark, sf_dir: str) -> DataFrame:
    return edited_fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def source_fingerprints(spark, sf_dir: str) -> DataFrame:
    """Each source's documents as one fingerprint, merged from theirs, against that of all documents: source, distinct (estimate of its
    distinct shingles), resemblance and containment (in the whole), rounded."""
    docs = fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet").select("source", "text")).select("source", "fingerprint")
    by_source = written(merged_fingerprints(docs, "source"), "sources")
    whole = merged_fingerprints(by_source.withColumn("all__", F.lit(1)), "all__").select(F.col("fingerprint").alias("whole"))
    out = compared_fingerprints(by_source.crossJoin(F.broadcast(whole)), "whole")  # one row of K hashes
    return out.select("source", F.round("distinct", 1).alias("distinct"), F.round("resemblance", 6).alias("resemblance"), F.round("containment", 6).alias("containment"))
