"""The k most similar vectors of every vector, by NN-descent over a neighbour graph.

Start: centroids are fitted on a bounded sample; every vector goes to the blocks of its two nearest ones, and each block,
divided if it is large, links its members. Descent: around every node its links and the nearest of the nodes that hold it are
joined with each other, over at least one link that the round before found, and each keeps the best it meets, until little
changes. The nodes of a zone, a group of near centroids, are joined in one task, so that a vector travels once to each zone that
one of its links leads to or comes from, not once for each link; where zones end has no effect on the result.
Exact copies are one node of the graph and are told apart again at the end.

A vector is usable if it has `dim` finite components, not all zero. It travels packed without loss as bytes: in 8-bit
integers with a power of two as unit if that holds it, else in half or single precision.
"""

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.plans.lineage import stored

DIM, K = 384, 5
LINKS = 8  # neighbours that a node keeps during descent
REVERSE = 16  # nearest of the nodes that hold a node, by which it is joined beside its own links
BLOCK = 512  # vectors per centroid
BLOCK_MAX = 4096  # rows of a block that are compared with each other in one task; larger blocks are divided, in two ways
TASK_BLOCKS = 16  # blocks of usual size that a task links
ZONE = 8192  # vectors of a zone
ZONE_MAX = 32768  # nodes of a zone that one task joins; larger zones are divided
CENTROIDS_MAX = 4096  # of a table; fitted on at most SAMPLE vectors
SAMPLE = 1 << 16
ROUNDS = 8  # of descent at most; it ends once a round changes less than CHANGED of all the links to the k nearest
CHANGED = 0.001
BROADCAST_IDS = 100_000  # ids (16 bytes each) that are sent to every executor; beyond that a shuffle join takes their place


# --- packing -----------------------------------------------------------------------------------------------------------


def pack(x: np.ndarray) -> list[bytes]:
    """Rows of a float32 matrix as bytes: one for the kind (or unit), then the components."""
    unit = np.full(len(x), 255, dtype=np.int64)
    largest = np.abs(x).max(axis=1, initial=0)
    for exponent in range(20, -1, -1):
        scaled = x * np.float32(2.0**exponent)
        fits = (largest * 2.0**exponent <= 127) & (scaled == np.rint(scaled)).all(axis=1)
        unit[fits & (unit == 255)] = exponent
        if (unit != 255).all():
            break
    half = x.astype(np.float16)
    out = []
    for row, u, h in zip(x, unit, half):
        if u != 255:
            out.append(bytes([u]) + np.rint(row * np.float32(2.0**u)).astype(np.int8).tobytes())
        elif (h.astype(np.float32) == row).all():
            out.append(b"\xfe" + h.tobytes())
        else:
            out.append(b"\xff" + row.tobytes())
    return out


def unpack(packed: list[bytes], dim: int) -> np.ndarray:
    """The float32 matrix of packed rows, each exactly as it was."""
    x = np.empty((len(packed), dim), dtype=np.float32)
    sizes = np.array([len(p) for p in packed])
    for size, kind in ((dim + 1, np.int8), (2 * dim + 1, np.float16), (4 * dim + 1, np.float32)):
        of = np.flatnonzero(sizes == size)
        if len(of):
            raw = np.frombuffer(b"".join(packed[i] for i in of), dtype=np.uint8).reshape(len(of), size)
            values = np.ascontiguousarray(raw[:, 1:]).view(kind).astype(np.float32)
            x[of] = values * (np.float32(0.5) ** raw[:, :1].astype(np.float32)) if kind is np.int8 else values
    return x


def _matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the usable vectors and their positions."""
    lengths = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(lengths == dim)
    x = column.take(pa.array(at)).flatten().cast(pa.float32()).to_numpy(zero_copy_only=False).reshape(-1, dim)
    good = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
    return x[good], at[good]


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True).astype(np.float32)


# --- centroids ---------------------------------------------------------------------------------------------------------


def _k_means(x: np.ndarray, wanted: int) -> np.ndarray:
    """Unit centroids of unit rows, after three rounds from evenly spaced rows."""
    centroids = x[np.linspace(0, len(x) - 1, min(wanted, len(x))).astype(int)].copy()
    for _ in range(3):
        nearest = np.concatenate([np.argmax(part @ centroids.T, axis=1) for part in np.array_split(x, -(-len(x) // 8192))])
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, x)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(length > 0, sums / np.where(length > 0, length, 1), centroids)
    return centroids


def _packed(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(pack(_matrix(batch.column("embedding"), dim)[0]), pa.binary())], ["v"])

    return run


def fit_centroids(vectors: DataFrame, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit centroids of one table (id, embedding), one per BLOCK rows, and the zone of each; fitted on a sample of at most SAMPLE rows,
    packed (25 to 100 MB)."""
    n = vectors.count()
    wanted = min(CENTROIDS_MAX, max(1, n // BLOCK))
    share = min(1.0, min(SAMPLE, 64 * wanted) / max(1, n))
    drawn = vectors.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1) if share < 1 else vectors
    sample = drawn.select("embedding").limit(SAMPLE).mapInArrow(_packed(dim), "v binary").toArrow()["v"].to_pylist()
    x = unpack(sample, dim)
    if not len(x):
        return np.zeros((1, dim), dtype=np.float32), np.zeros(1, dtype=np.int32)
    centroids = _k_means(_unit(x), wanted)
    zones = _k_means(centroids, max(1, n // ZONE))
    return centroids, np.argmax(centroids @ zones.T, axis=1).astype(np.int32)


def _assign(table: int, centroids: np.ndarray, zones: np.ndarray, dim: int):
    planes = np.random.default_rng(7).standard_normal((dim, 32)).astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, at = _matrix(batch.column("embedding"), dim)
            score = _unit(x) @ centroids.T if len(x) else np.zeros((0, len(centroids)), np.float32)
            first = np.argmax(score, axis=1) if len(x) else np.zeros(0, int)
            if len(centroids) > 1:
                score[np.arange(len(x)), first] = -9
                second = np.argmax(score, axis=1)
            else:
                second = np.full(len(x), -1)
            sides = x @ planes > 0 if len(x) else np.zeros((0, 32), bool)
            codes = [(half @ (1 << np.arange(16))).astype(np.int32) for half in (sides[:, :16], sides[:, 16:])]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(x), table, np.int32)), batch.column("id").take(pa.array(at)).cast(pa.int64()), pa.array(pack(x), pa.binary()),
                 *(pa.array(c.astype(np.int32)) for c in (first, second, *codes, zones[first]))],
                ["t", "id", "v", "first", "second", "code", "code2", "zone"],
            )

    return run


def _divided(rows: DataFrame, keys: list[str], most: int, side: str = "side", salt: tuple[str, ...] = ("id",)) -> DataFrame:
    """`rows` with (part, salt): groups of more than `most` rows are divided by direction, and parts that still are larger by id."""
    sizes = rows.groupBy(*keys).count().where(F.col("count") > most)  # at most CENTROIDS_MAX rows a table
    part = F.coalesce(F.floor(F.col(side) * F.ceil(F.col("count") / most) / 65536), F.lit(0)).cast("int")
    parted = rows.join(F.broadcast(sizes), keys, "left").withColumn("part", part).drop("count")
    still = stored(parted.groupBy(*keys, "part").count().where(F.col("count") > most))
    few = still.count() <= BROADCAST_IDS
    salted = F.coalesce(F.pmod(F.xxhash64(*salt), F.ceil(F.col("count") / most)), F.lit(0))
    return parted.join(F.broadcast(still) if few else still, [*keys, "part"], "left").withColumn("salt", salted).drop("count")


def with_homes(nodes: DataFrame) -> DataFrame:
    """`nodes` with `home`, the number of the zone, or of the part of a large zone, in which a node is joined with others."""
    rows = _divided(nodes, ["t", "zone"], ZONE_MAX, side="code")
    home = F.shiftleft(F.col("zone").cast("long"), 40) + F.shiftleft(F.col("part").cast("long"), 20) + F.col("salt")
    return rows.withColumn("home", home).drop("part", "salt", "zone")


# --- linking inside a block --------------------------------------------------------------------------------------------


def similarities(x: np.ndarray, norms: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of row pairs in double precision; the same pair always gives the same number."""
    out = np.empty(len(a))
    for s in range(0, len(a), 4096):
        i, j = a[s : s + 4096], b[s : s + 4096]
        out[s : s + 4096] = np.einsum("ij,ij->i", x[i].astype(np.float64), x[j].astype(np.float64)) / (norms[i] * norms[j])
    return out


def link_block(ids: np.ndarray, x: np.ndarray, links: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, neighbour's row, cosine) of the `links` nearest rows of every row."""
    norms = np.linalg.norm(x.astype(np.float64), axis=1)
    y = (x / norms[:, None]).astype(np.float32)
    n, k = len(x), min(links, len(x) - 1)
    if k < 1:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    near = np.empty((n, k), dtype=np.int64)
    for s in range(0, n, 512):
        score = y[s : s + 512] @ y.T
        score[np.arange(len(score)), np.arange(s, s + len(score))] = -9
        near[s : s + 512] = np.argpartition(score, n - k, axis=1)[:, n - k :]
    a, b = np.repeat(np.arange(n), k), near.ravel()
    return a, b, similarities(x, norms, np.minimum(a, b), np.maximum(a, b))


_ROW = "t int, id long, home long, links array<struct<far: double, id: bigint, home: bigint, fresh: boolean>>"


def _lists(of: np.ndarray, n: int, far: np.ndarray, ids: np.ndarray, homes: np.ndarray) -> pa.ListArray:
    """Fresh links as one list for each of n rows; `of`, the row of each link, is in order."""
    offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(of, minlength=n))]).astype(np.int32))
    fields = [pa.array(far, pa.float64()), pa.array(ids, pa.int64()), pa.array(homes, pa.int64()), pa.array(np.ones(len(ids), bool))]
    return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(fields, ["far", "id", "home", "fresh"]))


def _link(dim: int, links: int):
    def run(block: pa.Table) -> pa.Table:
        order = np.argsort(block["id"].to_numpy(), kind="stable")
        ids, homes, packed = block["id"].to_numpy()[order], block["home"].to_numpy()[order], block["v"].to_pylist()
        a, b, cosine = link_block(ids, unpack([packed[i] for i in order], dim), links)
        found = _lists(a, len(ids), -cosine, ids[b], homes[b])
        return pa.table({"t": pa.array(np.full(len(ids), block["t"][0].as_py(), np.int32)), "id": pa.array(ids), "home": pa.array(homes), "links": found})

    return run


def _blocks(nodes: DataFrame) -> DataFrame:
    """(t, id, home, v, block, way, part, salt): every node in its two blocks; in blocks of more than BLOCK_MAX rows twice, as these
    are divided by direction in two ways, so that their parts overlap."""
    spread = nodes.select("t", "id", "home", "v", "code", "code2", F.explode(F.array("first", "second")).alias("block")).where("block >= 0")
    large = spread.groupBy("t", "block").count().where(F.col("count") > BLOCK_MAX).select("t", "block", F.array(F.lit(0), F.lit(1)).alias("ways"))
    ways = spread.join(F.broadcast(large), ["t", "block"], "left").withColumn("way", F.explode(F.coalesce("ways", F.array(F.lit(0)))))
    sided = ways.withColumn("side", F.when(F.col("way") == 0, F.col("code")).otherwise(F.col("code2"))).drop("ways", "code", "code2")
    return _divided(sided, ["t", "block", "way"], BLOCK_MAX, salt=("id", "way")).drop("side")


# --- descent -----------------------------------------------------------------------------------------------------------


def _merged(rows: DataFrame, links: int) -> DataFrame:
    """One row per node with its best links; ties go to the lesser id, and a link found again is not fresh."""
    every = rows.groupBy("t", "id", "home").agg(F.array_sort(F.flatten(F.collect_list("links"))).alias("all"))
    once = F.filter("all", lambda x, i: (i == 0) | (x["id"] != F.get("all", i - 1)["id"]))
    return every.select("t", "id", "home", F.slice(once, 1, links).alias("links"))


def _changed(graph: DataFrame, k: int) -> int:
    return graph.agg(F.sum(F.size(F.filter(F.slice("links", 1, k), lambda x: x["fresh"])))).first()[0] or 0


def _active(graph: DataFrame) -> DataFrame | None:
    """(t, id) of the nodes around which a link is fresh and of those they have links with, or None if they are too many to be told
    to all executors."""
    edges = graph.select("t", "id", F.explode("links").alias("x")).select("t", "id", F.col("x.id").alias("other"), "x.fresh")
    ends = lambda e: e.select("t", F.explode(F.array("id", "other")).alias("id")).distinct()
    middles = stored(ends(edges.where("fresh")))
    if middles.count() > BROADCAST_IDS:
        return None
    either = edges.join(F.broadcast(middles), ["t", "id"], "left_semi").unionByName(edges.join(F.broadcast(middles.withColumnRenamed("id", "other")), ["t", "other"], "left_semi"))
    active = stored(ends(either))
    return active if active.count() <= BROADCAST_IDS else None


_MEMBER = "t int, home long, id long, at long, v binary, worst double, links array<struct<far: double, id: bigint, home: bigint, fresh: boolean>>"


def _members(graph: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """What the zones need: (t, home, id, at, v, worst, links), each row with a vector or with links.

    `home` is the zone that the row goes to, `at` the node's own. A zone gets its own nodes; the links of other nodes that lead
    into it; and the vectors of those and of all nodes that its own have links to.
    """
    worst = F.when(F.size("links") >= k, F.element_at("links", k)["far"]).otherwise(F.lit(2.0)).alias("worst")
    no_vector, no_links = F.lit(None).cast("binary").alias("v"), F.expr("cast(null as array<struct<far: double, id: bigint, home: bigint, fresh: boolean>>)").alias("links")
    homes = F.array_union(F.array("home"), F.array_distinct(F.transform("links", lambda x: x["home"])))
    sent = graph.select("t", "id", F.col("home").alias("at"), worst, "links", F.explode(homes).alias("home"))
    told = sent.select("t", "home", "id", "at", no_vector, "worst", F.when(F.col("home") == F.col("at"), F.col("links")).otherwise(F.filter("links", lambda x: x["home"] == F.col("home"))).alias("links"))
    own = vectors.select("t", "home", "id", F.col("home").alias("at"), "v", F.lit(None).cast("double").alias("worst"), no_links)
    foreign = F.filter("links", lambda x: x["home"] != F.col("home"))
    out = graph.select("t", "id", "home", F.explode(foreign).alias("x"))
    asked = out.select("t", "id", F.col("x.home").alias("to")).unionByName(out.select("t", F.col("x.id").alias("id"), F.col("home").alias("to"))).distinct()
    guests = asked.join(vectors, ["t", "id"]).join(graph.select("t", "id", worst), ["t", "id"]).select("t", F.col("to").alias("home"), "id", F.col("home").alias("at"), "v", "worst", no_links)
    return told.unionByName(own).unionByName(guests)


def around(source: np.ndarray, target: np.ndarray, far: np.ndarray, fresh: np.ndarray, local: np.ndarray, reverse: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(middle, other, fresh) in order of middle: for each local node the ends of its links and the nearest of the nodes that hold it."""
    own, held = local[source], local[target]
    order = np.lexsort((source[held], far[held], target[held]))
    middle, other, new = target[held][order], source[held][order], fresh[held][order]
    rank = np.arange(len(middle)) - np.searchsorted(middle, middle)
    near = rank < reverse
    middle, other = np.concatenate([source[own], middle[near]]), np.concatenate([target[own], other[near]])
    new = np.concatenate([fresh[own], new[near]])
    order = np.lexsort((~new, other, middle))  # of a link both ways the fresh one counts
    middle, other, new = middle[order], other[order], new[order]
    once = np.concatenate([[True], (middle[1:] != middle[:-1]) | (other[1:] != other[:-1])]) if len(middle) else np.zeros(0, bool)
    return middle[once], other[once], new[once]


def met(y: np.ndarray, worst: np.ndarray, middle: np.ndarray, other: np.ndarray, fresh: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, candidate), each once: pairs around a middle over a fresh link, where the candidate is among the nearest of the node so far."""
    begin = np.flatnonzero(np.concatenate([[True], middle[1:] != middle[:-1]])) if len(middle) else np.zeros(0, int)
    size = np.diff(np.concatenate([begin, [len(middle)]])).astype(int)
    some = np.logical_or.reduceat(fresh, begin) if len(begin) else np.zeros(0, bool)
    begin, size = begin[some & (size > 1)], size[some & (size > 1)]
    order = np.argsort(size, kind="stable")
    pairs = [np.zeros(0, np.int64)]
    for s in range(0, len(order), 512):
        b, n = begin[order[s : s + 512]], size[order[s : s + 512]]
        at = np.minimum(b[:, None] + np.arange(n.max()), len(middle) - 1)
        there = np.arange(n.max()) < n[:, None]
        nodes, new = other[at], fresh[at] & there
        x = y[nodes]
        good = x @ x.transpose(0, 2, 1) >= -worst[nodes][:, :, None] - np.float32(1e-5)
        good &= there[:, :, None] & there[:, None, :] & (new[:, :, None] | new[:, None, :]) & (nodes[:, :, None] != nodes[:, None, :])
        i, p, q = np.nonzero(good)
        pairs.append(np.unique(nodes[i, p] * len(y) + nodes[i, q]))
    found = np.unique(np.concatenate(pairs))
    return found // max(1, len(y)), found % max(1, len(y))


def _join_zone(dim: int, links: int, reverse: int):
    def run(zone: pa.Table) -> pa.Table:
        t, home = zone["t"][0].as_py(), zone["home"][0].as_py()
        has_vector = zone["v"].is_valid().to_numpy()
        vectors, told = zone.filter(pa.array(has_vector)), zone.filter(pa.array(~has_vector))
        ids, first = np.unique(vectors["id"].to_numpy(), return_index=True)
        at, packed = vectors["at"].to_numpy()[first], vectors["v"].to_pylist()
        x = unpack([packed[i] for i in first], dim)
        norms = np.linalg.norm(x.astype(np.float64), axis=1)
        worst = vectors["worst"].fill_null(-2.0).to_numpy()[first]
        place = lambda wanted: np.minimum(np.searchsorted(ids, wanted), max(0, len(ids) - 1))
        known = np.isin(told["id"].to_numpy(), ids)
        told = told.filter(pa.array(known))
        source = place(told["id"].to_numpy())
        worst[source] = told["worst"].to_numpy()
        lists = told["links"].combine_chunks()
        link, of = lists.flatten(), np.repeat(source, lists.value_lengths().to_numpy(zero_copy_only=False))
        far, end, fresh = (link.field(f).to_numpy(zero_copy_only=False) for f in ("far", "id", "fresh"))
        there = np.isin(end, ids)
        of, far, end, fresh = of[there], far[there], place(end[there]), fresh[there].astype(bool)
        a, b = met((x / norms[:, None]).astype(np.float32), worst, *around(of, end, far, fresh, at == home, reverse))
        new = ~np.isin(a * len(ids) + b, of * len(ids) + end)
        a, b = a[new], b[new]
        far = -similarities(x, norms, np.minimum(a, b), np.maximum(a, b))
        better = far <= worst[a]
        a, b, far = a[better], b[better], far[better]
        order = np.lexsort((ids[b], far, a))
        a, b, far = a[order], b[order], far[order]
        best = np.arange(len(a)) - np.searchsorted(a, a) < links
        a, b, far = a[best], b[best], far[best]
        nodes, of = np.unique(a, return_inverse=True)
        found = _lists(of, len(nodes), far, ids[b], at[b])
        return pa.table({"t": pa.array(np.full(len(nodes), t, np.int32)), "id": pa.array(ids[nodes]), "home": pa.array(at[nodes]), "links": found})

    return run


def neighbour_graph(nodes: DataFrame, dim: int, k: int = K, links: int = LINKS, rounds: int = ROUNDS) -> DataFrame:
    """(t, id, home, links): the graph after descent; links are (far = -cosine, id, home, fresh), best first.

    nodes: as from `with_homes`. A round joins only over links that the round before found; to the first all links are new.
    """
    n = nodes.count()
    spread = _blocks(nodes)
    of_block, tasks = ["t", "block", "way", "part", "salt"], max(1, 2 * n // (TASK_BLOCKS * BLOCK))  # tasks follow the data, whatever the session's setting
    blocks = spread.repartition(tasks, *of_block).groupBy(*of_block).applyInArrow(_link(dim, links), _ROW)
    graph = stored(_merged(blocks, links))
    vectors, least_change = nodes.select("t", "id", "home", "v"), CHANGED * k * n
    for round_ in range(rounds):
        active = _active(graph) if round_ else None
        near = lambda df: df if active is None else df.join(F.broadcast(active), ["t", "id"], "left_semi")  # noqa: E731, B023
        members = _members(near(graph), near(vectors), k)
        zones = members.repartition(max(1, n // ZONE), "t", "home") if active is None else members
        found = zones.groupBy("t", "home").applyInArrow(_join_zone(dim, links, REVERSE), _ROW)
        old = graph.withColumn("links", F.transform("links", lambda x: x.withField("fresh", F.lit(False))))
        graph = stored(_merged(old.unionByName(found), links))
        if _changed(graph, k) <= least_change:
            break
    return graph


def _both_ways(rows: DataFrame) -> DataFrame:
    return rows.unionByName(rows.select("t", F.col("other").alias("id"), "far", F.col("id").alias("other")))


def _compare(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = unpack(batch.column("va").to_pylist() + batch.column("vb").to_pylist(), dim)
            n = batch.num_rows
            cosine = similarities(x, np.linalg.norm(x.astype(np.float64), axis=1), np.arange(n), np.arange(n, 2 * n))
            yield pa.RecordBatch.from_arrays([batch.column("t"), batch.column("a"), batch.column("b"), pa.array(-cosine)], ["t", "a", "b", "far"])

    return run


def _needed(ids: DataFrame, nodes: DataFrame) -> DataFrame:
    """(t, id, v) of the nodes; only of those in ids (t, id) if they are few enough to be told to all executors."""
    vectors, named = nodes.select("t", "id", "v"), stored(ids.distinct())
    return vectors.join(F.broadcast(named), ["t", "id"], "left_semi") if named.count() <= BROADCAST_IDS else vectors


# --- copies and results ------------------------------------------------------------------------------------------------


class Index(NamedTuple):
    """The graph of some tables and what is needed to tell copies apart again."""

    names: list[str]
    placed: DataFrame  # every usable row: t, id, v, first, second, ids (of its set of copies, if it is one)
    nodes: DataFrame  # one row of each set
    sets: DataFrame  # t, copy, ids: the k + 1 least ids of each set of more than one
    few: bool  # few enough sets to be sent to every executor
    graph: DataFrame  # t, id, links


def build(tables: dict[str, DataFrame], dim: int = DIM, k: int = K, rounds: int = ROUNDS) -> Index:
    """The neighbour graph of every usable row of the tables, by name, (id, embedding); ids are unique per table."""
    placed = None
    for t, name in enumerate(tables):
        source = tables[name].select(F.col("id").cast("long").alias("id"), "embedding").where(F.col("embedding").isNotNull() & F.col("id").isNotNull())
        part = source.mapInArrow(_assign(t, *fit_centroids(source, dim), dim), "t int, id long, v binary, first int, second int, code int, code2 int, zone int")
        placed = part if placed is None else placed.unionByName(part)
    placed = stored(placed.withColumn("copy", F.unhex(F.md5("v"))))

    # Of each set of copies the k + 1 least ids say all: the least is its node, the others are each other's nearest.
    rank = Window.partitionBy("t", "copy").orderBy("id")
    least = placed.select("t", "copy", "id").withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k + 1)
    sets = stored(least.groupBy("t", "copy").agg(F.array_sort(F.collect_list("id")).alias("ids")).where(F.size("ids") > 1))
    few = sets.count() <= BROADCAST_IDS // (k + 1)
    placed = placed.join(F.broadcast(sets) if few else sets, ["t", "copy"], "left")
    nodes = with_homes(placed.where(F.col("ids").isNull() | (F.col("id") == F.element_at("ids", 1))).drop("ids", "copy"))
    return Index(list(tables), placed, nodes, sets, few, neighbour_graph(nodes, dim, k, rounds=rounds))


def _rows(graph: DataFrame) -> DataFrame:
    return graph.select("t", "id", F.explode("links").alias("x")).select("t", "id", "x.far", F.col("x.id").alias("other"))


def _with_copies(index: Index, links: DataFrame, k: int) -> DataFrame:
    """(t, id, links): links (t, id, far, other) to nodes stand for links to all copies of them."""
    by_node = index.sets.select("t", F.element_at("ids", 1).alias("other"), F.slice("ids", 1, k + 1).alias("ids"))
    wide = links.join(F.broadcast(by_node) if index.few else by_node, ["t", "other"], "left")
    each = wide.select("t", "id", "far", F.explode(F.coalesce("ids", F.array("other"))).alias("other")).where(F.col("other") != F.col("id"))
    best = F.slice(F.array_sort(F.array_distinct(F.collect_list(F.struct("far", F.col("other").alias("id"))))), 1, k)
    return each.groupBy("t", "id").agg(best.alias("links"))


def _nearest_of_nodes(index: Index, k: int) -> DataFrame:
    """(t, id, links): of every node; only where one of the k nearest stands for copies are links told apart."""
    graph = index.graph.select("t", "id", F.slice("links", 1, k).alias("links"))
    by_node = index.sets.select("t", F.element_at("ids", 1).alias("other"))
    some = stored(_rows(graph).join(F.broadcast(by_node) if index.few else by_node, ["t", "other"], "left_semi").select("t", "id").distinct())
    some = F.broadcast(some) if some.count() <= BROADCAST_IDS else some
    others = graph.join(some, ["t", "id"], "left_anti").select("t", "id", F.transform("links", lambda x: F.struct(x["far"].alias("far"), x["id"].alias("id"))).alias("links"))
    return others.unionByName(_with_copies(index, _rows(graph.join(some, ["t", "id"], "left_semi")), k))


def _named(index: Index) -> Column:
    return F.element_at(F.array(*map(F.lit, index.names)), F.col("t") + 1).alias("chunk_table")


def nearest(tables: dict[str, DataFrame], dim: int = DIM, k: int = K) -> DataFrame:
    """(chunk_table, id, near): the k most similar other rows of the same table for every usable row, as ids, best first.

    At equal similarity the smaller id comes first. Unusable rows (null, another length, a null, NaN or infinite component,
    all zeros) take no part; fewer than k other rows give a shorter list.
    """
    index = build(tables, dim, k)
    alone = _nearest_of_nodes(index, k)
    # each copy has the other copies, then the links of its node
    copies = index.placed.where(F.col("ids").isNotNull()).select("t", "id", "ids")
    of_node = copies.withColumn("node", F.element_at("ids", 1)).join(alone.select("t", F.col("id").alias("node"), "links"), ["t", "node"], "left")
    others = F.filter("ids", lambda x: x != F.col("id"))
    linked = lambda c: F.transform(c, lambda x: x["id"])
    own = of_node.select("t", "id", F.slice(F.concat(others, F.coalesce(linked("links"), F.array().cast("array<bigint>"))), 1, k).alias("near"))
    nodes_of_sets = index.sets.select("t", F.element_at("ids", 1).alias("id"))
    single = alone.join(nodes_of_sets, ["t", "id"], "left_anti").select("t", "id", linked("links").alias("near"))
    return single.unionByName(own).select(_named(index), "id", "near")


def nearest_pairs(tables: dict[str, DataFrame], dim: int = DIM, k: int = K) -> DataFrame:
    """(chunk_table, id_a, id_b), id_a < id_b: pairs of which one is among the k nearest of the other."""
    links = nearest(tables, dim, k).select("chunk_table", "id", F.explode("near").alias("other"))
    return links.select("chunk_table", F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")).distinct()


# --- search ------------------------------------------------------------------------------------------------------------

BEAM, HOPS = 24, 12
ENTRIES = 16  # nodes of each of a query's two blocks at which its search starts


def greedy_search(index: Index, queries: DataFrame, k: int = K, dim: int = DIM) -> DataFrame:
    """(t, id, links): the k nearest rows found for each query (t, id, v, first, second) by greedy search over the graph.

    A search starts at some nodes of the query's blocks, and at its own if the query is one. Each hop follows the links of the best nodes
    found so far that it has not followed yet, until there are none; all queries take a hop together, as a join.
    """
    asked = stored(queries.select("t", "id", "v", "first", "second", F.coalesce(F.element_at("ids", 1), "id").alias("own")) if "ids" in queries.columns else queries.withColumn("own", F.col("id")))
    drawn = Window.partitionBy("t", "first").orderBy(F.xxhash64("id"), "id")
    entries = index.nodes.select("t", "first", "id").withColumn("rank", F.row_number().over(drawn)).where(F.col("rank") <= ENTRIES)
    blocks = asked.select("t", "id", F.explode(F.array_distinct(F.array("first", "second"))).alias("first"))
    starts = blocks.join(entries.select("t", "first", F.col("id").alias("other")), ["t", "first"]).select("t", "id", "other")
    own = asked.select("t", "id", F.col("own").alias("other")).join(index.nodes.select("t", F.col("id").alias("other")), ["t", "other"], "left_semi")
    met = stored(starts.unionByName(own.select("t", "id", "other")).distinct())
    seen, found, followed = met, None, None
    for _ in range(HOPS):
        scored = _scored(met, asked, index.nodes, dim)
        rows = scored if found is None else found.unionByName(scored)
        rank = F.dense_rank().over(Window.partitionBy("t", "id").orderBy("far", "other"))
        found = stored(rows.withColumn("rank", rank).where(F.col("rank") <= BEAM).drop("rank"))
        open_ = found.select("t", "id", "other")
        open_ = open_ if followed is None else open_.join(followed, ["t", "id", "other"], "left_anti")
        nexts = open_.join(index.graph.select("t", F.col("id").alias("other"), "links"), ["t", "other"])
        met = stored(nexts.select("t", "id", F.explode("links").alias("x")).select("t", "id", F.col("x.id").alias("other")).distinct().join(seen, ["t", "id", "other"], "left_anti"))
        if met.isEmpty():
            break
        followed = found.select("t", "id", "other") if followed is None else followed.unionByName(open_)
        seen = seen.unionByName(met)
    return _with_copies(index, found, k)


def _scored(pairs: DataFrame, queries: DataFrame, nodes: DataFrame, dim: int) -> DataFrame:
    """(t, id, far, other) of pairs of a query (id) and a node (other)."""
    vectors = _needed(pairs.select("t", F.col("other").alias("id")), nodes)
    met = pairs.select("t", F.col("id").alias("a"), F.col("other").alias("b")).join(queries.select("t", F.col("id").alias("a"), F.col("v").alias("va")), ["t", "a"])
    met = met.join(vectors.select("t", F.col("id").alias("b"), F.col("v").alias("vb")), ["t", "b"]).select("t", "a", "b", "va", "vb")
    rows = met.mapInArrow(_compare(dim), "t int, a long, b long, far double")
    return rows.select("t", F.col("a").alias("id"), "far", F.col("b").alias("other"))


def searched(tables: dict[str, DataFrame], every: int = 50, dim: int = DIM, k: int = K) -> DataFrame:
    """(chunk_table, id, near): greedy search for every usable row whose id is divisible by `every`, against all rows."""
    index = build(tables, dim, k)
    links = greedy_search(index, index.placed.where(F.col("id") % every == 0), k, dim)
    return links.select(_named(index), "id", F.transform("links", lambda x: x["id"]).alias("near"))
