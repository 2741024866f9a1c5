"""Deterministic samples: by rank of a hash, so that any engine finds the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


#: Hexadecimal digits of the hash by which rows are counted before a sample is cut.
BUCKET_DIGITS = 4


def rank_key(key: Column, seed: str) -> Column:
    return F.sha2(F.concat(F.lit(seed), key.cast("string")), 256)


def simple_sample(rows: DataFrame, key: str, n: int, seed: str) -> DataFrame:
    """n rows by least hash (top-k, no full sort)."""
    return rows.orderBy(rank_key(F.col(key), seed), key).limit(n)


def per_stratum(rows: DataFrame, stratum: str, key: str, n: int, seed: str) -> DataFrame:
    """n rows of each stratum by least hash; rank-limited windows are pruned before the exchange."""
    w = W.partitionBy(stratum).orderBy(rank_key(F.col(key), seed), key)
    return rows.where(F.col(stratum).isNotNull()).withColumn("rn__", F.row_number().over(w)).where(F.col("rn__") <= n).drop("rn__")


def proportional(rows: DataFrame, stratum: str, key: str, n: int, seed: str) -> DataFrame:
    """About n rows, shared out to the strata by their size, one at least for each."""
    sizes = rows.groupBy(stratum).count()
    total = sizes.agg(F.sum("count").alias("all__"))
    quota = sizes.crossJoin(F.broadcast(total)).select(F.col(stratum).alias("s__"), F.greatest(F.lit(1), F.round(n * F.col("count") / F.col("all__"))).cast("int").alias("quota__"))
    w = W.partitionBy(stratum).orderBy(rank_key(F.col(key), seed), key)
    ranked = rows.withColumn("rn__", F.row_number().over(w))
    return ranked.join(quota, F.col(stratum).eqNullSafe(F.col("s__"))).where("rn__ <= quota__").drop("rn__", "s__", "quota__")


def audit_share(rows: DataFrame, key: str, share: float, seed: str) -> DataFrame:
    """Exactly round(share * n) rows by least hash (then least key), found without sorting them all.

    The rank of a row's hash is known but for its bucket: hashes are even, so rows are counted by its first BUCKET_DIGITS digits, whole
    buckets are taken, and only the rows of the one in which the sample ends are ranked."""
    digest = rank_key(F.col(key), seed)
    marked = rows.withColumn("bucket__", F.conv(F.substring(digest, 1, BUCKET_DIGITS), 16, 10).cast("long"))
    counts = marked.groupBy("bucket__").agg(F.count("*").alias("n__"))  # at most 16**BUCKET_DIGITS rows
    w = W.orderBy("bucket__")
    below = counts.select("bucket__", "n__", F.sum("n__").over(w).alias("upto__"))
    total = counts.agg(F.coalesce(F.bround(F.lit(share) * F.sum("n__")), F.lit(0)).cast("long").alias("k__"))
    quota = below.crossJoin(F.broadcast(total)).select(F.col("bucket__").alias("b__"), (F.col("k__") - F.col("upto__") + F.col("n__")).alias("left__"), "n__").where("left__ > 0")
    kept = marked.join(F.broadcast(quota), F.col("bucket__") == F.col("b__"))
    whole = kept.where("left__ >= n__").select(*rows.columns)
    last = kept.where("left__ < n__").withColumn("rn__", F.row_number().over(W.partitionBy("bucket__").orderBy(digest, key))).where("rn__ <= left__").select(*rows.columns)
    return whole.unionByName(last)


def boundary_sample(rows: DataFrame, near: Column, key: str, n: int, seed: str) -> DataFrame:
    """n rows, those near the boundary first."""
    return rows.orderBy(near.desc(), rank_key(F.col(key), seed), key).limit(n)


def slices(rows: DataFrame, key: str, n: int, seed: str) -> DataFrame:
    """rows with slice 0 to n - 1, by hash: stable for each key as rows come and go, without an exchange."""
    return rows.withColumn("slice", F.pmod(F.conv(F.substring(rank_key(F.col(key), seed), 1, 15), 16, 10).cast("long"), F.lit(n)).cast("int"))


def batches(rows: DataFrame, group: str, key: str, size: int) -> DataFrame:
    """rows with batch and place: at most `size` a batch, never two of one group in one.

    The k-th row of each group goes to round k; rounds are cut to batches. Rounds are shared out by an ordered window each."""
    by_group = W.partitionBy(group).orderBy(key)
    rounds = rows.withColumn("round", F.row_number().over(by_group) - 1)
    by_round = W.partitionBy("round").orderBy(key)
    return rounds.withColumn("n__", F.row_number().over(by_round) - 1).withColumns({"batch": F.floor(F.col("n__") / size), "place": F.pmod("n__", F.lit(size)) + 1}).drop("n__")


def time_blocks(rows: DataFrame, day: str, key: str, k: int) -> DataFrame:
    """rows with block 0 to k - 1: the range of ranks by day, then key, cut into k parts of equal width."""
    from .ranks import with_row_number

    n = rows.agg(F.count("*").alias("all__"))
    ranked = with_row_number(rows, [day, key], "rank__").crossJoin(F.broadcast(n))  # one row
    return ranked.withColumn("block", F.greatest(F.ceil(F.col("rank__") * F.lit(k) / F.greatest(F.col("all__") - 1, F.lit(1))), F.lit(1)).cast("int") - 1).drop("rank__", "all__")


def proportional_up_to(rows: DataFrame, stratum: str, key: str, n: int, seed: str) -> DataFrame:
    """proportional(), and never more than n rows: of what it takes, the n of least hash."""
    return simple_sample(proportional(rows, stratum, key, n, seed), key, n, seed)


def annotation_sheets(rows: DataFrame, key: str, hidden: list[str], blank: list[str], people: list[str]) -> dict[str, DataFrame]:
    """A sheet for each person: rows without what they mustn't see, blank columns to fill in, in an order of the person's own."""
    return {p: rows.drop(*hidden).withColumns({b: F.lit("") for b in blank}).orderBy(rank_key(F.col(key), p), key) for p in people}
