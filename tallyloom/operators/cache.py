"""Exact-hash response cache: keys, duplicates, eviction and age."""

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.functions.times import instant
from tallyloom.operators.ledger import BLANKS


@F.pandas_udf(T.StringType())
def composed(texts: pd.Series) -> pd.Series:
    """Unicode normal form C."""
    return texts.map(lambda s: s if s.isascii() else unicodedata.normalize("NFC", s), na_action="ignore")


def normal(text: Column) -> Column:
    """NFC, every run of white space one space, none at the ends; a zero-width non-joiner stays. Null becomes empty."""
    return F.trim(F.regexp_replace(composed(F.coalesce(text, F.lit(""))), f"{BLANKS}+", " "))


def cache_key(model: Column, prompt: Column, system: Column | None = None, most_tokens: Column | None = None) -> Column:
    """SHA-256 over model, normalised system text, normalised prompt and the bound on tokens, divided by NULs; null is empty."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit("")) if c is not None else F.lit("")
    zero, norm = F.lit("\x00"), lambda c: normal(c) if c is not None else F.lit("")
    return F.sha2(F.concat(text(model), zero, norm(system), zero, normal(prompt), zero, text(most_tokens)), 256)


def newest(cache: DataFrame) -> DataFrame:
    """(exact_key, key, answer): of the entries with a response under each exact key the one created last; ties go to the greater key.

    answer is the digest of the response, so that texts are not shuffled.
    """
    rows = cache.where(F.col("response").isNotNull()).select(cache_key(F.col("model"), F.col("prompt")).alias("exact_key"), "key", F.coalesce("created", F.lit("")).alias("created"), F.md5("response").alias("answer"))
    return rows.groupBy("exact_key").agg(F.max(F.struct("created", "key", "answer")).alias("x")).select("exact_key", "x.key", "x.answer")


def probe(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """(request, hit, entry, answer) for every request (request, model, prompt): the newest entry under its exact key, or none.

    Entries are one row per exact key, and both sides hold digests only; many requests for one key are spread by the adaptive join.
    """
    asked = requests.select("request", cache_key(F.col("model"), F.col("prompt")).alias("exact_key"))
    found = asked.join(newest(cache).withColumnRenamed("key", "entry"), "exact_key", "left")
    return found.select("request", F.col("entry").isNotNull().alias("hit"), "entry", "answer")


def with_hits(cache: DataFrame, probed: DataFrame) -> DataFrame:
    """(key, hits): every entry's hits after those of `probed` are counted in."""
    new = probed.where("hit").groupBy(F.col("entry").alias("key")).agg(F.count("*").alias("new"))
    return cache.select("key", F.coalesce("hits", F.lit(0)).alias("hits")).join(new, "key", "left").select("key", (F.col("hits") + F.coalesce("new", F.lit(0))).cast("long").alias("hits"))


def put(cache: DataFrame, answers: DataFrame, cutoff: str, keep: int) -> DataFrame:
    """(key, hits, created): the cache after `answers` (key, created) replaced or joined its entries, without what is then evicted.

    A replaced entry begins again at no hits; of several answers under a key the one created last counts.
    """
    row = lambda df, hits, new: df.where(F.col("key").isNotNull()).select("key", hits.cast("long").alias("hits"), F.coalesce("created", F.lit("")).alias("created"), F.lit(new).alias("new"))
    both = row(cache, F.coalesce("hits", F.lit(0)), False).unionByName(row(answers, F.lit(0), True))
    latest = both.groupBy("key").agg(F.max(F.struct("new", "created", "hits")).alias("x")).select("key", "x.hits", "x.created")
    return latest.join(evicted(latest, cutoff, keep), "key", "left_anti")


def live(cache: DataFrame, as_of: str, ttl_s: int = 3600) -> DataFrame:
    """(key): entries that may still be read at the instant `as_of`: created at most `ttl_s` seconds before; unreadable times have passed."""
    age = F.unix_seconds(instant(as_of)) - F.unix_seconds(F.try_to_timestamp("created"))
    return cache.where(age.between(0, ttl_s)).select("key")


def age(created: Column, as_of: str) -> Column:
    """Age as text: minutes below an hour, hours below a day, else days; ? where the time can't be read or has no zone."""
    s = F.unix_seconds(instant(as_of)) - F.unix_seconds(F.when(created.rlike(r"(Z|[+-]\d\d:?\d\d)$"), F.try_to_timestamp(created)))
    whole = lambda n, unit: F.concat(F.floor(s / n).cast("string"), F.lit(unit))
    return F.when(s.isNull(), "?").when(s < 3600, whole(60, "m")).when(s < 86400, whole(3600, "h")).otherwise(whole(86400, "d"))


def keyed(cache: DataFrame, system: str = "", most_tokens: int | None = None) -> DataFrame:
    """(key, exact_key) of every entry, asked with a system text and a bound on tokens; aliases of a model are different models here."""
    return cache.select("key", cache_key(F.col("model"), F.col("prompt"), F.lit(system), F.lit(most_tokens)).alias("exact_key"))


def duplicates(cache: DataFrame) -> DataFrame:
    """(exact_key, entries, hits, kept): keys under which more than one entry is stored; kept is the newest entry's key."""
    rows = cache.select(cache_key(F.col("model"), F.col("prompt")).alias("exact_key"), "key", "created", F.coalesce("hits", F.lit(0)).alias("hits"))
    latest = F.max(F.struct(F.coalesce("created", F.lit("")).alias("created"), "key"))["key"]
    grouped = rows.groupBy("exact_key").agg(F.count("*").alias("entries"), F.sum("hits").cast("long").alias("hits"), latest.alias("kept"))
    return grouped.where(F.col("entries") > 1)


def evicted(cache: DataFrame, cutoff: str, keep: int) -> DataFrame:
    """(key, reason) of entries to drop: first those created before `cutoff` (compared as text), then all but the newest `keep`.

    Entries of a null `created` count as oldest. Ties are kept by key. The order is only needed up to `keep`, so no task
    sorts the whole cache.
    """
    rows = cache.where(F.col("key").isNotNull()).select("key", F.coalesce("created", F.lit("")).alias("created")).distinct()
    fresh = rows.where(F.col("created") >= cutoff)
    kept = fresh.orderBy(F.desc("created"), "key").limit(keep).select("key")
    old = rows.where(F.col("created") < cutoff).select("key", F.lit("age").alias("reason"))
    return old.unionByName(fresh.join(kept, "key", "left_anti").select("key", F.lit("size").alias("reason")))


def age_buckets(cache: DataFrame, as_of: str) -> DataFrame:
    """(age, entries, hits): entries by whole days since they were created, up to `as_of`; ? where the time can't be read."""
    days = F.floor((F.unix_seconds(instant(as_of)) - F.unix_seconds(F.try_to_timestamp("created"))) / 86400)
    age = F.when(days.isNull(), "?").when(days < 7, "week").when(days < 30, "month").when(days < 90, "quarter").otherwise("older")
    return cache.groupBy(age.alias("age")).agg(F.count("*").alias("entries"), F.coalesce(F.sum("hits"), F.lit(0)).cast("long").alias("hits"))
