"""Language identification: text likelihoods fused with declared language, address suffix and host priors."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from .common import ascii_lower, free_name, plain, release, written
from .kernels import chunks

#: Hash buckets of byte trigrams.
BUCKETS = 1 << 15
#: Distinct texts of each language that the text model is fitted on, at most: those of the least hash.
SAMPLE = 4000
#: The background that none of the languages explains: every trigram alike.
UNKNOWN = "und"
#: Trigrams of a text depend on each other; so many of them count as one independent witness.
WITNESS = 8.0
#: Chance that a declared language, or an address suffix that names a language, is right.
DECLARED_RIGHT, SUFFIX_RIGHT = 0.9, 0.7
#: Documents' worth of belief that a host borrows from its domain, and a domain from the whole corpus.
BORROWED = 5.0
#: Languages that country suffixes speak for.
SUFFIXES = {"uk": "en", "us": "en", "ie": "en", "au": "en", "fr": "fr", "de": "de", "at": "de", "es": "es", "mx": "es", "ar": "es"}


def trigrams(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the three bytes at each place of a text, letters of A-Z lower-cased, and which places count: those
    with a letter or a non-ASCII byte in the middle."""
    b = np.frombuffer(data, np.uint8)
    low = _FOLD[b].astype(np.uint32)
    if len(b) < 3:
        return np.zeros(0, np.int64), np.zeros(0, bool)
    code = low[:-2] * np.uint32(0x1003F) + low[1:-1] * np.uint32(0x3F1) + low[2:]
    return ((code * np.uint32(2654435761)) >> np.uint32(32 - 15)).astype(np.int64), _LETTER[b[1:-1]]


#: Lower case; digits, punctuation and white space all as a space.
_FOLD = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], np.uint8)
_LETTER = np.array([65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in range(256)])


@dataclass(frozen=True)
class TextModel:
    """log P(trigram | language), a row for each language and one for UNKNOWN."""

    languages: tuple[str, ...]
    logs: np.ndarray = field(repr=False)

    @staticmethod
    def from_counts(counts: dict[tuple[str, int], int]) -> TextModel:
        languages = tuple(sorted({k[0] for k in counts}))
        table = np.full((len(languages) + 1, BUCKETS), 0.5)
        for (lang, bucket), n in counts.items():
            table[languages.index(lang), bucket] += n
        table[-1] = 1
        return TextModel(languages, np.log(table / table.sum(axis=1, keepdims=True)))

    def score(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(log P(text | language) summed over trigrams, number of trigrams) of each text."""
        sums, counts = np.zeros((len(texts), len(self.logs))), np.zeros(len(texts), np.int64)
        for a, b, part in chunks(texts):
            joined = b" " + b"  ".join(part) + b" "  # a space on each side, so no trigram that counts holds letters of two texts
            bucket, counted = trigrams(joined)
            begins = np.cumsum([0, *(len(p) + 2 for p in part)])
            bucket = bucket[counted]
            ends = np.cumsum(np.concatenate(([0], counted)))[np.minimum(begins, len(counted))]
            counts[a:b] = np.diff(ends)
            for k, row in enumerate(self.logs):
                total = np.concatenate(([0.0], np.cumsum(row[bucket])))
                sums[a:b, k] = total[ends[1:]] - total[ends[:-1]]
        return sums, counts


def fit(labelled: DataFrame, languages: Sequence[str] | None = None, text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> TextModel:
    """A text model from at most `sample` distinct texts of each language, those of the least hash.

    Its languages are all that any row with a letter in its text has, or those of them that are given: which ones doesn't
    depend on the sample. Rows with null text or language are left out; with no rows every text is of an unknown language.
    The trigrams are counted by the tasks; the driver gets some more than `sample` hashes of each language, and a number
    for each language and bucket at most. Equality of texts is that of hashes.
    """
    rows = labelled.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(text).alias("text"), ascii_lower(F.col(lang)).alias("lang"))
    rows = rows.where(F.col("text").rlike(r"[A-Za-z]|[^\x00-\x7F]"))  # others have no trigram that counts
    if languages is not None:
        rows = rows.where(F.col("lang").isin(list(languages)))
    hashed = rows.withColumn("h", F.xxhash64("text"))
    n = {r[0]: r[1] for r in hashed.groupBy("lang").agg(F.approx_count_distinct("h")).collect()}
    if not n:
        return TextModel.from_counts({})
    # First by a bound of the hash that leaves somewhat more (the count is good to some hundredths), so that few hashes are collected.
    share = {x: min(1.0, 1.25 * (sample + 4 * math.sqrt(sample)) / max(1, k)) for x, k in n.items()}
    below = lambda most: F.col("h") <= F.element_at(F.create_map(*(F.lit(v) for x, k in most.items() for v in (x, k))), F.col("lang"))
    least: dict[str, list[int]] = {x: [] for x in n}
    for r in hashed.where(below({x: int(-(1 << 63) + k * ((1 << 64) - 1)) if k < 1 else (1 << 63) - 1 for x, k in share.items()})).select("lang", "h").distinct().collect():
        least[r[0]].append(r[1])
    most = {x: max(sorted(h)[:sample], default=-(1 << 63)) for x, h in least.items()}
    hashed = hashed.where(below(most)).groupBy("lang", "h").agg(F.min("text").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for language in sorted(set(batch.column("lang").to_pylist())):
                total = np.zeros(BUCKETS, np.int64)
                for t, m in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                    if m == language:
                        bucket, counted = trigrams(b" " + t.encode("utf-8", "surrogatepass") + b" ")
                        total += np.bincount(bucket[counted], minlength=BUCKETS)
                found = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array([language] * len(found)), pa.array(found), pa.array(total[found])], names=["lang", "bucket", "n"])

    counts = hashed.select("lang", "text").mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    return TextModel.from_counts({(r[0], r[1]): r[2] for r in counts.collect()})


def text_scores(docs: DataFrame, model: TextModel, text: str = "text", scores: str = "text_logs", count: str = "n_trigrams") -> DataFrame:
    """docs with log P(text | language), tempered by WITNESS, for each language and UNKNOWN, and the number of trigrams."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop(*(c for c in (scores, count) if c != text))
    schema = StructType([*docs.schema.fields, StructField(scores, ArrayType(DoubleType())), StructField(count, LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            logs, n = sent.value.score(batch.column(text).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(logs / WITNESS), pa.list_(pa.float64())), pa.array(n)], names=[*batch.schema.names, scores, count])

    return docs.mapInArrow(run, schema)


def _evidence(declared: Column, languages: Sequence[str], right: float) -> list[Column]:
    """log P(declared | language) for each language and UNKNOWN; 0 where nothing, or no known language, is declared."""
    wrong = (1 - right) / len(languages)
    known = F.coalesce(declared.isin(list(languages)), F.lit(False))
    return [F.when(~known, 0.0).when(declared == x, math.log(right)).otherwise(math.log(wrong)) for x in languages] + [F.when(~known, 0.0).otherwise(math.log(1 / len(languages)))]


def host_priors(scored: DataFrame, model: TextModel, host: str, domain: str, scores: str = "text_logs") -> DataFrame:
    """(host, domain, prior): P(language) of each host, of the most likely language of its texts by text alone.

    Counts by grouped aggregation; a host's counts are smoothed by its domain's shares, a domain's by the whole
    corpus's, each worth BORROWED documents, and the corpus's by one document for each language. Null is a host too.
    """
    n = len(model.languages) + 1
    best = F.array_position(F.col(scores), F.array_max(F.col(scores))).cast("int")
    counts = written(scored.select(F.col(host).alias("host"), F.col(domain).alias("domain"), best.alias("best")).groupBy("host", "domain", "best").count(), "host-counts")
    of = [F.sum(F.when(F.col("best") == k + 1, F.col("count")).otherwise(0)).cast("double").alias(f"n{k}") for k in range(n)]
    total = counts.agg(*of).first()
    whole = [(total[k] or 0) + 1 for k in range(n)]
    whole = [x / sum(whole) for x in whole]
    size = sum((F.col(f"n{k}") for k in range(n)), F.lit(0.0))
    domains = counts.groupBy("domain").agg(*of).select("domain", F.array(*((F.col(f"n{k}") + BORROWED * whole[k]) / (size + BORROWED) for k in range(n))).alias("of_domain"))
    hosts = counts.groupBy("host", "domain").agg(*of).join(domains.withColumnRenamed("domain", "d"), F.col("domain").eqNullSafe(F.col("d")))
    out = written(hosts.select("host", "domain", F.array(*((F.col(f"n{k}") + BORROWED * F.col("of_domain")[k]) / (size + BORROWED) for k in range(n))).alias("prior")), "host-priors")
    release(counts)
    return out


def identify(docs: DataFrame, model: TextModel, text: str = "text", declared: Column | None = None, suffix: Column | None = None, host: Column | None = None, domain: Column | None = None) -> DataFrame:
    """docs with language, probability and n_trigrams: the most probable language, given all evidence, or `und`.

    Bayes: text likelihood (byte trigrams, tempered: WITNESS of them count as one) times that of the declared language,
    times that of the address suffix's, times the host's prior. Evidence that is null or names no language of the model
    leaves the others as they are. Texts without letters, null and empty ones are `und` with probability 1. Equal
    probabilities go to the first language by name. Repeated rows each get a row; columns of these names are replaced.
    """
    languages = list(model.languages)
    docs, [text], restored = plain(docs, text)
    if not languages:
        return restored(docs).withColumns({"language": F.lit(UNKNOWN), "probability": F.lit(1.0), "n_trigrams": F.lit(0).cast("long")})
    logs, h, d, prior = (free_name(docs, x) for x in ("text_logs", "host__", "domain__", "prior__"))
    declared_, suffix_ = free_name(docs, "declared__"), free_name(docs, "suffix__")
    null = F.lit(None).cast("string")
    rows = docs.drop(*(c for c in ("language", "probability", "n_trigrams") if c != text))
    rows = rows.withColumns({h: host if host is not None else null, d: domain if domain is not None else null, declared_: declared if declared is not None else null, suffix_: suffix if suffix is not None else null})
    scored = text_scores(rows, model, text, logs)
    if host is not None:
        # Priors come from a scan of their own that keeps no text; hosts are few against documents, but not bounded: no broadcast is forced.
        priors = host_priors(text_scores(rows.select(text, h, d), model, text, logs), model, h, d, logs).select(F.col("host").alias(f"{h}1"), F.col("domain").alias(f"{d}1"), F.col("prior").alias(prior))
        scored = scored.join(priors, F.col(h).eqNullSafe(F.col(f"{h}1")) & F.col(d).eqNullSafe(F.col(f"{d}1")), "left").drop(f"{h}1", f"{d}1")
    else:
        scored = scored.withColumn(prior, F.array(*([F.lit(1.0)] * (len(languages) + 1))))
    parts = zip(_evidence(F.col(declared_), languages, DECLARED_RIGHT), _evidence(F.col(suffix_), languages, SUFFIX_RIGHT), strict=True)
    total = F.array(*(F.col(logs)[k] + a + b + F.log(F.col(prior)[k]) for k, (a, b) in enumerate(parts)))
    top = free_name(docs, "top__")
    scored = scored.withColumn(logs, total).withColumn(top, F.array_max(logs))
    best = F.element_at(F.array(*(F.lit(x) for x in [*languages, UNKNOWN])), F.array_position(F.col(logs), F.col(top)).cast("int"))
    share = 1 / F.aggregate(F.col(logs), F.lit(0.0), lambda s, x: s + F.exp(x - F.col(top)))
    some = F.col("n_trigrams") > 0
    out = scored.withColumns({"language": F.when(some, best).otherwise(UNKNOWN), "probability": F.when(some, share).otherwise(1.0)})
    return restored(out.drop(logs, h, d, prior, top, declared_, suffix_))


#: A document stays if its language is one of the model's with at least this probability.
LEAST_PROBABILITY = 0.5


def with_language(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """A table of documents (text, lang, source) with language, probability, n_trigrams and accepted.

    The model is fitted on its own declared languages; `lang` is the declared language and `source` the host.
    """
    model = fit(docs.select("text", "lang"), sample=sample)
    out = identify(docs, model, declared=ascii_lower(F.col("lang")), host=F.col("source"))
    return out.withColumn("accepted", (F.col("language") != UNKNOWN) & (F.col("probability") >= LEAST_PROBABILITY))


def op7_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    return with_language(docs).select("doc_id", "language", F.round("probability", 6).alias("probability"), "n_trigrams", "accepted")


def page_language(spark, sf_dir: str) -> DataFrame:
    """Languages of pages: visible text, markup language, address suffix, and priors of hosts within their domains."""
    from .url_filter import host_of

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs.select("text", "lang"))
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    bare = F.regexp_replace(F.regexp_replace(F.coalesce("html", F.lit("")), r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>", " "), r"(?s)<[^>]*>|&#?\w+;", " ")
    host = host_of(F.col("url"))
    rows = pages.select("page_id", bare.alias("text"), host.alias("host"), ascii_lower(F.substring(F.regexp_extract("html", r"(?is)<html\b[^>]*\blang\s*=\s*[\"']?([a-z]{2,3})\b", 1), 1, 3)).alias("markup"))
    lookup = F.create_map(*(F.lit(x) for kv in SUFFIXES.items() for x in kv))
    suffix = F.element_at(lookup, F.substring_index("host", ".", -1))
    found = identify(rows, model, declared=F.col("markup"), suffix=suffix, host=F.col("host"), domain=F.substring_index("host", ".", -2))
    return found.select("page_id", "host", "markup", "language", F.round("probability", 6).alias("probability"))
