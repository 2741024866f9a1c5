"""Ids, url keys and reproducible random numbers from hashes, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def article_id(url: Column) -> Column:
    return F.concat(F.lit("n"), F.substring(F.sha1(url), 1, 10))


def hash_fraction(key: Column) -> Column:
    """First 32 bits of sha256 over 2**32 - 1: from 0 to 1, both included."""
    return F.conv(F.substring(F.sha2(key.cast("string"), 256), 1, 8), 16, 10).cast("double") / 4294967295.0


def salted_fraction(key: Column, salt: str) -> Column:
    """First 60 bits of sha256 of salt and key, over 2**60."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(salt), key.cast("string")), 256), 1, 15), 16, 10).cast("double") / 1152921504606846976.0


def in_holdout(key: Column, share: float = 0.10) -> Column:
    return hash_fraction(key) < share


def normal_url(url: Column) -> Column:
    """Without query and fragment, without slashes at the end, in lower case."""
    return F.lower(F.rtrim(F.regexp_replace(url, r"[?#].*$", ""), F.lit("/")))


def unwrapped_url(url: Column) -> Column:
    """The target of a tracking redirect (parameter u or url, decoded twice), else the url itself."""
    q = lambda name: F.nullif(F.regexp_extract(url, rf"[?&]{name}=([^&#]*)", 1), F.lit(""))
    target = F.try_url_decode(F.coalesce(F.try_url_decode(F.coalesce(q("u"), q("url"))), F.lit("")))
    return F.when(target.rlike("^https?://"), target).otherwise(url)


def cache_key(*parts: Column) -> Column:
    return F.sha1(F.concat_ws("|", *(p.cast("string") for p in parts)))
