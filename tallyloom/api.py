"""What a user asks of a directory of tables, as functions of a session: reports, status, receipts, lookups, indexing and identifiers.

Each gives a DataFrame and reads only the columns and rows that it needs. Tables are named as in the directory.
"""

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.operators import cache, corpus, ledger, registry, retrieval
from tallyloom.sources.tables import table

DIM = 384
COLLECTIONS = {"rules": "rules_chunks", "sessions": "session_chunks", "code": "code_chunks"}
GROUPS = ("model_asked", "model", "project", "day", "session_id", "via", "mode", "commit_sha")
INDEX_COLUMNS = ("id", "repo", "path", "chunk_sha", "repo_commit")


def _collection(spark: SparkSession, tables: str, collection: str, *columns: str) -> DataFrame:
    if collection not in COLLECTIONS:
        raise ValueError(f"collection must be one of {', '.join(COLLECTIONS)}")
    return table(spark, tables, COLLECTIONS[collection], *columns)


def cost_report(spark: SparkSession, tables: str, by: str = "model_asked", since: str | None = None) -> DataFrame:
    """Calls, cost, tokens and hit rate per group in order, the total last; `since` is a UTC day (YYYY-MM-DD)."""
    if by not in GROUPS:
        raise ValueError(f"by must be one of {', '.join(GROUPS)}")
    return ledger.ordered(ledger.report(table(spark, tables, "usage_rows"), by, since)).drop("is_total")


def spending(spark: SparkSession, tables: str, as_of: str) -> DataFrame:
    """Per project: cost of the month, of seven days and of all time, and calls of the day, up to the UTC instant `as_of`."""
    return ledger.spend(table(spark, tables, "usage_rows"), as_of)


def load_ledger(spark: SparkSession, tables: str, lines: DataFrame) -> DataFrame:
    """The usage rows of ledger lines (line) that the ledger does not hold yet, each once."""
    return ledger.new_rows(ledger.projection(lines), table(spark, tables, "usage_rows", "event_id"))


def cache_lookup(spark: SparkSession, tables: str, requests: DataFrame, as_of: str, ttl_s: int = 3600) -> DataFrame:
    """(request, hit, entry, answer) for requests (request, model, prompt), answered from entries not older than `ttl_s` seconds."""
    entries = table(spark, tables, "cache_rows", "key", "model", "prompt", "response", "created")
    return cache.probe(requests, entries.join(cache.live(entries, as_of, ttl_s), "key", "left_semi"))


def cache_prune(spark: SparkSession, tables: str, cutoff: str, keep: int) -> DataFrame:
    """(key, reason) of the entries that go: those created before `cutoff`, then all but the newest `keep`."""
    return cache.evicted(table(spark, tables, "cache_rows", "key", "created"), cutoff, keep)


def status(spark: SparkSession, tables: str) -> DataFrame:
    """Chunks, files, commits and files without one known commit (stale_files), per collection and repo."""
    every = corpus.sweep({name: table(spark, tables, t) for name, t in COLLECTIONS.items()})
    stale = corpus.stale_paths(every).where(F.col("path").isNotNull()).groupBy("collection", F.col("repo").alias("of")).agg(F.count("*").alias("stale_files"))
    counted = corpus.counts(every).alias("c")
    joined = counted.join(stale.alias("s"), (F.col("c.collection") == F.col("s.collection")) & F.col("c.repo").eqNullSafe(F.col("s.of")), "left")
    return joined.select("c.*", F.coalesce("s.stale_files", F.lit(0)).alias("stale_files"))


def receipt(spark: SparkSession, tables: str, collection: str, path: str, repo: str | None = None) -> DataFrame:
    """(repo, path, receipt, first_id, last_id, n) of one file; of each repo that has it if none is named. No rows if there is no such file."""
    rows = _collection(spark, tables, collection, "id", "repo", "path", "chunk").where(F.col("path") == path)
    return corpus.receipts(rows if repo is None else rows.where(F.col("repo") == repo))


def lookup(spark: SparkSession, tables: str, queries: DataFrame, collection: str = "rules", k: int = 5, repo: str | None = None, under: str = "", dim: int = DIM) -> DataFrame:
    """(query_id, id, similarity, repo, path, start_line, name, chunk): the k chunks most similar to each query (id, embedding).

    `repo` and `under`, the beginning of a path, narrow the chunks before they are compared. name is the symbol or heading.
    """
    if k < 1:
        raise ValueError("k must be positive")
    name = "symbol" if collection == "code" else "heading"
    chunks = _collection(spark, tables, collection, "id", "repo", "path", "start_line", F.col(name).alias("name"), "chunk", "embedding")
    if repo is not None:
        chunks = chunks.where(F.col("repo") == repo)
    if under:
        chunks = chunks.where(F.col("path").startswith(under))
    hits = retrieval.top_k(chunks, queries, k, dim)
    return chunks.drop("embedding").join(retrieval.small(retrieval.stored(hits)), "id").select("query_id", "id", "similarity", "repo", "path", "start_line", "name", "chunk")


def code_graph(spark: SparkSession, tables: str, hits: DataFrame) -> DataFrame:
    """(query_id, id, role, repo, path, start_line, end_line, symbol): hits (query_id, id) of code with their callers and callees."""
    code = _collection(spark, tables, "code")
    found = retrieval.expand(hits, retrieval.resolved(retrieval.call_sites(code), code))
    shown = code.select("id", "repo", "path", "start_line", "end_line", "symbol")
    return shown.join(retrieval.small(retrieval.stored(found)), "id").select("query_id", "id", "role", "repo", "path", "start_line", "end_line", "symbol")


class Changes(NamedTuple):
    """What an ingest does to a collection."""

    chunks: DataFrame  # repo, path, chunk_sha, id, is_new
    stale: DataFrame  # id, reason
    stats: DataFrame  # repo, seen, written, skipped, deleted


def reindex(spark: SparkSession, tables: str, collection: str, incoming: DataFrame) -> Changes:
    """What the whole corpus `incoming` (id, repo, path, chunk_sha, repo_commit) changes in a collection that has these columns."""
    if collection == "code":
        stored = _collection(spark, tables, collection, *("chunk_hash" if c == "chunk_sha" else c for c in INDEX_COLUMNS)).withColumnRenamed("chunk_hash", "chunk_sha")
    else:
        stored = _collection(spark, tables, collection, *INDEX_COLUMNS)
    return Changes(corpus.upsert(stored, incoming), corpus.stale(stored, incoming), corpus.ingest_stats(stored, incoming))


def free_ids(spark: SparkSession, tables: str, requests: DataFrame) -> DataFrame:
    """(prefix, request, ident): new identifiers for requests (prefix, request), after all that the documents mention."""
    return registry.allocated(requests, registry.mentions(table(spark, tables, "documents", "doc_id", "text")))


def missing_ids(spark: SparkSession, tables: str, most: int = 10) -> DataFrame:
    """(prefix, gaps, more): the first `most` numbers that the documents skip, and how many there are besides."""
    return registry.gap_report(registry.mentions(table(spark, tables, "documents", "doc_id", "text")), most=most)


def lost_joiners(before: DataFrame, after: DataFrame) -> DataFrame:
    """(repo, path, joiners_before, joiners_after) of files (repo, path, chunk) that lost zero-width non-joiners."""
    return corpus.joiner_losses(before, after)
