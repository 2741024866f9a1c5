"""From documents to packed sequences: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm.common import release, written
from folio.llm.decontaminate import scan_documents
from folio.llm.jaccard_join import one_of_each_group
from folio.llm.language import with_language
from folio.llm.packing import pack_documents
from folio.llm.suffix_dedup import remove_repeats


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told."""
    return with_language(docs).where("accepted").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a Jaccard similarity of five-word shingles of 0.8 or more: that of the least doc_id."""
    return one_of_each_group(docs, words=5, num=8, den=10)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of 100 bytes that start earlier in the corpus; n_chars is that of the new text."""
    return remove_repeats(docs).withColumn("n_chars", F.length("text").cast("long"))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated by the benchmark."""
    return scan_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where("not contaminated").select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 4096 tokens."""
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), end=2)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("repeats", repeats), ("benchmark", benchmark), ("packing", packing)]
#: SQL has no tokenizer and no trained language model; tests/llm/test_pipeline.py holds run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. Null texts and texts without letters go with the language; an empty table gives no rows; other columns
    are carried through all stages but the last, whatever their names."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        before, docs = docs, written(stage(spark, docs, sf_dir), name)
        if k:
            release(before)  # no later stage reads it
    return docs
