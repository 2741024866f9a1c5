"""Shuffled sharding: a keyed permutation of global row numbers gives each row its shard and slot."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from .common import free_name, n_tasks, plain, shared_dir, text_or_empty
from .kernels import mix

SEED, ROUNDS = 20_240_229, 4


def permute(rows: np.ndarray, n: int, seed: int = SEED, rounds: int = ROUNDS) -> np.ndarray:
    """Place of each row number under a permutation of 0 to n - 1.

    A balanced Feistel network permutes the numbers of 2 * half bits, at most 4 * n of them; a number that
    lands at n or beyond walks on along its cycle until it is below n. Any task can compute any row's place.
    """
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> shift, x & mask
        for r in range(rounds):
            left, right = right, left ^ (mix(right + np.uint64((seed * 0x9E3779B97F4A7C15 + r * 0xD1342543DE82EF95) & 0xFFFFFFFFFFFFFFFF)) & mask)
        return (left << shift) | right

    out = once(rows.astype(np.uint64))
    while len(beyond := np.flatnonzero(out >= np.uint64(n))):
        out[beyond] = once(out[beyond])
    return out.astype(np.int64)


def numbered(df: DataFrame, order: list[str], name: str = "row_number") -> tuple[DataFrame, int]:
    """df with each row's global number from 0 in the given order (nulls first), and the count of rows.

    One range exchange of df's own columns; equal keys fall in the same range, and a number per range goes
    through the driver. The sorted rows are cut off by a checkpoint, so numbers and counts agree for good.
    """
    spark = df.sparkSession
    shared_dir(spark)
    place = free_name(df, "place__")
    cut = df.repartitionByRange(n_tasks(spark), *order).sortWithinPartitions(*order).withColumn(place, F.monotonically_increasing_id()).checkpoint()
    part = F.shiftright(place, 33)
    counts = sorted((r[0], r[1]) for r in cut.groupBy(part).count().collect())
    total, offsets = 0, {}
    for p, n in counts:
        offsets[p] = total - (p << 33)
        total += n
    schema, names = StructType([*df.schema.fields, StructField(name, LongType(), False)]), [*df.columns, name]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(place).to_numpy()
            if len(at):
                yield pa.RecordBatch.from_arrays([*batch.drop_columns([place]).columns, pa.array(at + offsets[int(at[0]) >> 33])], names=names)

    return cut.mapInArrow(number, schema), total


def shard_rows(df: DataFrame, order: list[str], n_shards: int, seed: int = SEED) -> DataFrame:
    """df with row_number, shard and slot: a reproducible shuffle into shards whose counts differ by one at most.

    Rows are numbered in the given order; equal rows are interchangeable, so the order should tell others
    apart. The row at place p of the permutation goes to shard p % n_shards, slot p // n_shards; a shard's slots are
    0 to its count - 1. Null keys come first; an empty table gives an empty one; columns of these names are replaced.
    """
    df, order, restored = plain(df.drop("row_number", "shard", "slot"), *order)
    rows, n = numbered(df, order)
    schema = StructType([*rows.schema.fields, StructField("shard", IntegerType()), StructField("slot", LongType())])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = permute(batch.column("row_number").to_numpy(), n, seed)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array((p % n_shards).astype(np.int32)), pa.array(p // n_shards)], names=[*batch.schema.names, "shard", "slot"])

    return restored(rows.mapInArrow(deal, schema))


def op2_shards(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = text_or_empty()
    narrow = docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    return shard_rows(narrow, ["doc_id", "text_crc32", "size"], 24).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
