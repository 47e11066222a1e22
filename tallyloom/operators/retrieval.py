"""Exact vector retrieval for many queries under filters and output budgets, and one-hop expansion over a call graph."""

import ast
import textwrap
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.plans.lineage import stored

QUERIES_AT_ONCE = 2048
BROADCAST_ROWS = 200_000  # rows that are sent to every executor; beyond that a shuffle join takes their place
SALTS = 16
CALLEE = r"([A-Za-z_][A-Za-z0-9_]*)\("


def usable(embedding: Column, dim: int) -> Column:
    """Of `dim` finite components, not all zero."""
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return embedding.isNotNull() & (F.size(embedding) == dim) & ~bad & F.exists(embedding, lambda x: x != 0)


def _unit(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Usable vectors of a batch at length 1 in double precision, and their positions."""
    lengths = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(lengths == dim)
    x = column.take(pa.array(at)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dim)
    good = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
    x = x[good]
    return x / np.linalg.norm(x, axis=1, keepdims=True), at[good]


def _best(query_ids: np.ndarray, q: np.ndarray, dim: int, k: int):
    """Per partition, the k best rows of each query, from one matrix product for each part of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score, ids = np.full((len(q), k), -(1 << 40), np.int64), np.full((len(q), k), np.iinfo(np.int64).max)
        for batch in batches:
            x, at = _unit(batch.column("embedding"), dim)
            own = batch.column("id").to_numpy(zero_copy_only=False)[at].astype(np.int64)
            for s in range(0, len(x), 1024):
                part = np.argsort(own[s : s + 1024], kind="stable") + s
                found = np.rint(q @ x[part].T * 1e6).astype(np.int64)
                top = np.argsort(-found, axis=1, kind="stable")[:, :k]  # ids are in order, so ties go to the lesser
                both = np.concatenate([score, np.take_along_axis(found, top, 1)], axis=1), np.concatenate([ids, own[part][top]], axis=1)
                order = np.lexsort((both[1], -both[0]), axis=1)[:, :k]
                score, ids = (np.take_along_axis(c, order, 1) for c in both)
        there = score > -(1 << 40)
        rows = [np.repeat(query_ids, there.sum(axis=1)), ids[there], score[there] / 1e6]
        yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.float64())], ["query_id", "id", "similarity"])

    return run


def top_k(chunks: DataFrame, queries: DataFrame, k: int, dim: int, block: int = QUERIES_AT_ONCE) -> DataFrame:
    """(query_id, id, similarity to 6 digits): the k chunks most similar to each query (id, embedding), ties to the lesser id.

    Exact: every query meets every row. Filters on `chunks` reach the scan. Queries are sent to the tasks in blocks of about
    `block`, each a pass over the chunks; a task keeps k rows of each query, and these alone are shuffled.
    """
    asked = stored(queries.where(usable(F.col("embedding"), dim)).select(F.col("id").cast("long").alias("id"), "embedding"))
    blocks, best = max(1, -(-asked.count() // block)), None
    for b in range(blocks):
        own = asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).toArrow()
        q, at = _unit(own["embedding"].combine_chunks(), dim) if own.num_rows else (np.zeros((0, dim)), np.zeros(0, int))
        part = chunks.select("id", "embedding").mapInArrow(_best(own["id"].to_numpy()[at], q, dim, k), "query_id long, id long, similarity double")
        best = part if best is None else best.unionByName(part)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).drop("rank")


def within_budget(hits: DataFrame, sizes: DataFrame, budget: int) -> DataFrame:
    """Of each query's hits, best first, those whose sizes (id, size) add up to `budget` at most."""
    sized = sizes.join(F.broadcast(hits), "id")
    upto = F.sum("size").over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id").rowsBetween(Window.unboundedPreceding, 0))
    return sized.withColumn("upto", upto).where(F.col("upto") <= budget).select("query_id", "id", "similarity")


def mean_pooled(rows: DataFrame, dim: int) -> DataFrame:
    """(key, n, embedding): the mean, at length 1, of the usable vectors (key, embedding) of each key, to 6 digits.

    Each task adds up the vectors of a batch by key, so that only one sum per key and batch is shuffled. Null keys are left out.
    """
    kind = "key string, n long, total array<double>"

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column("embedding").value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
            at = np.flatnonzero(lengths == dim)
            x = batch.column("embedding").take(pa.array(at)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dim)
            good = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
            keys = batch.column("key").take(pa.array(at[good])).dictionary_encode()
            codes, names = keys.indices.to_numpy(zero_copy_only=False), keys.dictionary
            total = np.zeros((len(names), dim))
            np.add.at(total, codes, x[good])
            offsets = pa.array(np.arange(0, (len(names) + 1) * dim, dim).astype(np.int32))
            n = pa.array(np.bincount(codes, minlength=len(names)), pa.int64())
            yield pa.RecordBatch.from_arrays([names, n, pa.ListArray.from_arrays(offsets, pa.array(total.ravel()))], ["key", "n", "total"])

    def whole(key: tuple, part: pa.Table) -> pa.Table:
        total = part["total"].combine_chunks().flatten().to_numpy().reshape(-1, dim).sum(axis=0)
        length = max(float(np.linalg.norm(total)), 1e-9)
        n = int(part["n"].to_numpy().sum())
        return pa.table({"key": pa.array([key[0].as_py()]), "n": pa.array([n], pa.int64()), "embedding": pa.array([np.round(total / length, 6) + 0.0], pa.list_(pa.float64()))})

    parts = rows.where(F.col("key").isNotNull()).select("key", "embedding").mapInArrow(partial, kind)
    return parts.groupBy("key").applyInArrow(whole, "key string, n long, embedding array<double>")


def call_sites(chunks: DataFrame) -> DataFrame:
    """(caller_id, callee_symbol), once each: names followed by a parenthesis, besides the chunk's own name."""
    names = F.array_distinct(F.regexp_extract_all("chunk", F.lit(CALLEE), F.lit(1)))
    own = F.element_at(F.split(F.coalesce("symbol", F.lit("")), r"\."), -1)
    rows = chunks.where(F.col("chunk").isNotNull()).select(F.col("id").alias("caller_id"), own.alias("own"), F.explode(names).alias("callee_symbol"))
    return rows.where(F.col("callee_symbol") != F.col("own")).select("caller_id", "callee_symbol").distinct()


def small(df: DataFrame) -> DataFrame:
    """A stored table, marked to be sent to every executor if its count allows."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def resolved(edges: DataFrame, chunks: DataFrame) -> DataFrame:
    """(caller_id, callee_symbol, resolved_id): the chunk of the caller's repo that defines the callee, the least id if several do.

    Definitions are one row per repo and name, so of a common name only the side of the calls is large; if they are too many to be
    sent to every executor, calls of a name are spread over SALTS tasks, to each of which its one definition goes.
    """
    name = F.element_at(F.split("symbol", r"\."), -1)
    defined = stored(chunks.where(F.col("symbol").isNotNull()).groupBy("repo", name.alias("callee_symbol")).agg(F.min("id").alias("resolved_id")))
    callers = edges.join(chunks.select(F.col("id").alias("caller_id"), "repo"), "caller_id")
    if defined.count() <= BROADCAST_ROWS:
        joined = callers.join(F.broadcast(defined), ["repo", "callee_symbol"], "left")
    else:
        spread = defined.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = callers.withColumn("salt", F.pmod(F.hash("caller_id"), F.lit(SALTS))).join(spread, ["repo", "callee_symbol", "salt"], "left")
    return joined.select("caller_id", "callee_symbol", "resolved_id")


def replaced(edges: DataFrame, new: DataFrame) -> DataFrame:
    """Edges after those of every caller in `new` gave way to its new ones; (caller_id, callee_symbol) is unique."""
    kept = edges.join(new.select("caller_id").distinct(), "caller_id", "left_anti")
    return kept.unionByName(new).dropDuplicates(["caller_id", "callee_symbol"])


def expand(hits: DataFrame, edges: DataFrame) -> DataFrame:
    """(query_id, id, role): a query's hits, then their callers, then their callees; a chunk has the first role it is found in.

    hits: (query_id, id), computed once and sent to every executor if few enough; edges are resolved and read once for each direction.
    """
    hits = stored(hits.select("query_id", "id"))
    known = stored(edges.where(F.col("resolved_id").isNotNull()).select("caller_id", "resolved_id"))
    few = small(hits)
    callers = known.join(few.select("query_id", F.col("id").alias("resolved_id")), "resolved_id").select("query_id", F.col("caller_id").alias("id"), F.lit(1).alias("rank"))
    callees = known.join(few.select("query_id", F.col("id").alias("caller_id")), "caller_id").select("query_id", F.col("resolved_id").alias("id"), F.lit(2).alias("rank"))
    every = hits.withColumn("rank", F.lit(0)).unionByName(callers).unionByName(callees)
    role = F.element_at(F.array(F.lit("hit"), F.lit("caller"), F.lit("callee")), F.min("rank") + 1)
    return every.groupBy("query_id", "id").agg(role.alias("role"))


def defining_chunks(definitions: DataFrame, chunks: DataFrame) -> DataFrame:
    """(id, name, symbol_id): the chunk of the same file whose symbol is a name (id, repo, path, name) defined in a chunk, the least id of several."""
    symbols = chunks.where(F.col("symbol").isNotNull()).groupBy("repo", "path", F.col("symbol").alias("name")).agg(F.min("id").alias("symbol_id"))
    return definitions.join(symbols, ["repo", "path", "name"]).select("id", "name", "symbol_id")


def python_calls(source: str | None) -> set[tuple[str, str]]:
    """(caller, callee) of a Python source; methods as Class.name, module-level calls left out; none if it can't be parsed."""
    try:
        tree = ast.parse(textwrap.dedent(source or ""))
    except (SyntaxError, ValueError, RecursionError):
        return set()
    found: set[tuple[str, str]] = set()

    def visit(node: ast.AST, owner: str | None, caller: str | None) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, ast.ClassDef):
                visit(child, child.name, None)
            elif isinstance(child, ast.FunctionDef | ast.AsyncFunctionDef):
                visit(child, None, f"{owner}.{child.name}" if owner else child.name)
            else:
                if caller and isinstance(child, ast.Call) and isinstance(child.func, ast.Name | ast.Attribute):
                    found.add((caller, child.func.id if isinstance(child.func, ast.Name) else child.func.attr))
                visit(child, owner, caller)

    visit(tree, None, None)
    return found


def parsed_calls(chunks: DataFrame) -> DataFrame:
    """(id, caller, callee) of the Python chunks, by parsing."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(i, *call) for i, text in zip(b["id"], b["chunk"]) for call in sorted(python_calls(text))], columns=["id", "caller", "callee"])

    return chunks.where((F.col("lang") == "python") & F.col("chunk").isNotNull()).select("id", "chunk").mapInPandas(run, "id long, caller string, callee string")
