"""Approximate nearest neighbours by a robust-pruned directed graph (operator 3).

Equal vectors are one node.  Nodes are dealt at random into shards of a bounded mean size, large so that a
search meets a small share of its shard.  In
each shard a directed graph is grown: a greedy search from the entry node proposes a node's
neighbours, and pruning keeps, nearest first, only those that no kept neighbour is much nearer
to (factor ALPHA), so that edges stay few and diverse; reverse edges are added and pruned the
same way.  A beam search then answers every query on every shard, and the shards' answers are
merged by exact scores.  Queries come in bounded blocks, so tasks stay bounded on both sides.

Nearness is the largest inner product in double precision, as recomputed on the original
vectors; the graph is built on the directions of the vectors, with their norm as one more
coordinate that makes inner products distances.

Defined results: vectors that are null, zero or hold null or non-finite components, and rows
without id, take no part; ties go to the smaller id; equal vectors are all found; repeated ids
are repeated candidates; fewer than k candidates are all returned if found; an empty table
gives no rows; vectors of another length than the most common one (of ties, the shortest) take no part.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Mean nodes of a shard and queries of a block.
SHARD, BLOCK = 16_384, 2_048
DEGREE, BEAM, BUILD_BEAM, ALPHA = 32, 128, 64, 1.2
#: Edges beyond DEGREE that a node may gather while its graph grows, before it is pruned again.
SLACK = 24
#: Nodes that are inserted, and queries that are searched, side by side.
SIDE = 256

GRAPH = "shard int, node int, uid long, gid long, second long, vec array<double>, links array<int>"


def usable(vec: Column) -> Column:
    """Not null, no null or non-finite component, not all zero."""
    fine = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vec.isNotNull() & F.coalesce(fine, F.lit(False)) & F.exists(vec, lambda x: x != 0)


def of_one_length(rows: DataFrame, vec: str) -> DataFrame:
    """Rows whose vectors have the most common length; of ties the shortest."""
    sizes = rows.groupBy(F.size(vec).alias("n")).agg(F.count("*").alias("rows"))
    most = sizes.agg(F.max_by("n", F.struct("rows", -F.col("n"))).alias("n")).first().n
    return rows if most is None else rows.where(F.size(vec) == most)


def as_matrix(column: pa.ChunkedArray | pa.Array, rows: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(rows, -1)


def beam_search(points: np.ndarray, links: np.ndarray, asked: np.ndarray, entry: int, beam: int, met: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, distances) of the beam of each query, nearest first; -1 and inf where there are fewer.

    met gets the number of nodes whose distances were taken, of each query.

    All queries take a step together: each expands its nearest node not yet expanded."""
    q, n = len(asked), len(points)
    norms = (points**2).sum(axis=1)
    own = (asked**2).sum(axis=1)
    ids = np.full((q, beam), -1, np.int64)
    dist = np.full((q, beam), np.inf)
    done = np.ones((q, beam), bool)
    seen = np.zeros((q, n), bool)
    ids[:, 0], done[:, 0] = entry, False
    dist[:, 0] = norms[entry] - 2 * asked @ points[entry] + own
    seen[:, entry] = True
    active = np.arange(q)
    while len(active):
        open_dist = np.where(done[active], np.inf, dist[active])
        best = open_dist.argmin(axis=1)
        going = np.isfinite(open_dist[np.arange(len(active)), best])
        active, best = active[going], best[going]
        if not len(active):
            break
        done[active, best] = True
        near = links[ids[active, best]]
        fresh = (near >= 0) & ~seen[active[:, None], np.maximum(near, 0)]
        row, col = np.nonzero(fresh)
        node, who = near[row, col], active[row]
        seen[who, node] = True
        d = np.full(near.shape, np.inf)
        d[row, col] = norms[node] + own[who] - 2 * np.einsum("ij,ij->i", points[node], asked[who])
        all_d = np.concatenate([dist[active], d], axis=1)
        keep = np.argpartition(all_d, beam - 1, axis=1)[:, :beam]
        at = np.arange(len(active))[:, None]
        dist[active] = all_d[at, keep]
        ids[active] = np.concatenate([ids[active], np.where(fresh, near, -1)], axis=1)[at, keep]
        done[active] = np.concatenate([done[active], ~fresh], axis=1)[at, keep]
    if met is not None:
        met += seen.sum(axis=1).tolist()
    order = dist.argsort(axis=1, kind="stable")
    at = np.arange(q)[:, None]
    return np.where(np.isfinite(dist[at, order]), ids[at, order], -1), dist[at, order]


def robust_prune(points: np.ndarray, node: int, proposed: np.ndarray, alpha: float = ALPHA, degree: int = DEGREE) -> np.ndarray:
    """Nearest first, a proposed neighbour stays unless a kept one is alpha times nearer to it than the node."""
    proposed = np.unique(proposed[(proposed >= 0) & (proposed != node)])
    d = ((points[proposed] - points[node]) ** 2).sum(axis=1)
    order = d.argsort(kind="stable")
    proposed, d = proposed[order], d[order]
    p = points[proposed]
    between = (p**2).sum(axis=1)[:, None] + (p**2).sum(axis=1)[None] - 2 * p @ p.T
    live, kept = np.ones(len(proposed), bool), []
    for i in range(len(proposed)):
        if live[i]:
            kept.append(i)
            if len(kept) == degree:
                break
            live &= alpha**2 * between[i] > d
    return proposed[kept]


def build_graph(points: np.ndarray, seed: int = 3) -> tuple[np.ndarray, int]:
    """(links, entry) of a shard's graph; links are padded with -1."""
    n = len(points)
    links = np.full((n, DEGREE + SLACK), -1, np.int64)
    entry = int(((points - points.mean(axis=0)) ** 2).sum(axis=1).argmin())
    order = np.random.default_rng(seed).permutation(n)
    order = np.concatenate([[entry], order[order != entry]])
    width, at = 1, 1
    while at < n:
        some = order[at : at + width]
        found, _ = beam_search(points, links, points[some], entry, BUILD_BEAM)
        # What comes in together cannot meet in the graph yet: nodes of one batch propose each other.
        peers = ((points[some] ** 2).sum(axis=1)[None] - 2 * points[some] @ points[some].T).argsort(axis=1)[:, : BUILD_BEAM // 2]
        back: dict[int, list[int]] = {}
        for i, node in enumerate(some):
            kept = robust_prune(points, node, np.concatenate([found[i], some[peers[i]]]))
            links[node, : len(kept)], links[node, len(kept) :] = kept, -1
            for k in kept.tolist():
                back.setdefault(k, []).append(node)
        for k, more in back.items():
            have = links[k][links[k] >= 0]
            new = np.unique(np.concatenate([have, more]))
            if len(new) > DEGREE + SLACK:
                new = robust_prune(points, k, new)
            links[k, : len(new)], links[k, len(new) :] = new, -1
        at += width
        width = min(SIDE, 2 * width, max(1, at // 2))
    for node in np.flatnonzero(links[:, DEGREE] >= 0):
        kept = robust_prune(points, node, links[node])
        links[node, : len(kept)], links[node, len(kept) :] = kept, -1
    return links[:, :DEGREE], entry


def lifted(vectors: np.ndarray, most: float) -> np.ndarray:
    """One more coordinate, with which all norms are `most`: the nearest then has the largest inner product."""
    return np.concatenate([vectors, np.sqrt(np.maximum(0, most**2 - (vectors**2).sum(axis=1)))[:, None]], axis=1)


def index(nodes: DataFrame, shards: int) -> DataFrame:
    """A graph row for every node (uid, gid, second, vec)."""

    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by([("gid", "ascending"), ("uid", "ascending")])
        vectors = as_matrix(table.column("vec"), table.num_rows)
        links, entry = build_graph(lifted(vectors, float(np.sqrt((vectors**2).sum(axis=1).max()))))
        place = np.arange(table.num_rows)
        place[0], place[entry] = entry, 0  # the entry is node 0
        back = np.empty_like(place)
        back[place] = np.arange(len(place))
        rows = [back[x[x >= 0]].astype(np.int32) for x in links[place]]
        moved = table.take(pa.array(place))
        return pa.Table.from_arrays(
            [moved.column("shard"), pa.array(np.arange(len(place)), pa.int32()), *(moved.column(c) for c in ("uid", "gid", "second", "vec")), pa.array(rows, pa.list_(pa.int32()))],
            names=["shard", "node", "uid", "gid", "second", "vec", "links"],
        )

    dealt = nodes.select(F.pmod(F.xxhash64("gid", "vec", F.lit(5)), F.lit(shards)).cast("int").alias("shard"), "uid", "gid", "second", "vec")
    return dealt.groupBy("shard").applyInArrow(build, GRAPH)


def search(graph: DataFrame, queries: DataFrame, shards: int, blocks: int, k: int) -> DataFrame:
    """(query_id, found) with the k nearest nodes (score, least, uid) of every shard for every query (query_id, qvec).

    Each block of queries meets each shard once; both sides of a meeting are bounded.  least is a
    node's least id other than the query's; a node that has none is not found."""
    block = F.pmod(F.xxhash64("query_id", F.lit(9)), F.lit(blocks)).cast("int")
    left = graph.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "shard", "node", "uid", "gid", "second", "vec", "links")
    right = queries.select(block.alias("block"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), "query_id", "qvec")
    schema = "query_id long, found array<struct<neg:double,least:long,uid:long>>"

    def answer(nodes: pa.Table, asked: pa.Table) -> pa.Table:
        kind = pa.list_(pa.struct([("neg", pa.float64()), ("least", pa.int64()), ("uid", pa.int64())]))
        if not nodes.num_rows or not asked.num_rows:
            return pa.Table.from_arrays([pa.array([], pa.int64()), pa.array([], kind)], names=["query_id", "found"])
        nodes = nodes.sort_by("node")
        vectors, qs = as_matrix(nodes.column("vec"), nodes.num_rows), as_matrix(asked.column("qvec"), asked.num_rows)
        links = np.full((nodes.num_rows, DEGREE), -1, np.int64)
        for i, x in enumerate(nodes.column("links").to_pylist()):
            links[i, : len(x)] = x
        points = lifted(vectors, float(np.sqrt((vectors**2).sum(axis=1).max())))
        flat = np.concatenate([qs, np.zeros((len(qs), 1))], axis=1)
        uid, gid = nodes.column("uid").to_numpy(), nodes.column("gid").to_numpy()
        single = nodes.column("second").is_null().to_numpy()
        second = nodes.column("second").fill_null(0).to_numpy()
        names, counts = np.unique(gid[single], return_counts=True)
        alone = dict(zip(names.tolist(), counts.tolist()))  # id -> nodes that hold no other id
        who = asked.column("query_id").to_numpy()
        found = []
        for at in range(0, len(qs), SIDE):
            some = who[at : at + SIDE]
            more = max(alone.get(i, 0) for i in some.tolist())
            ids, _ = beam_search(points, links, flat[at : at + SIDE], 0, max(BEAM, 4 * k, 2 * k + more))
            for i, q, own in zip(some, qs[at : at + SIDE], ids):
                own = own[own >= 0]
                own = own[~(single[own] & (gid[own] == i))][: 2 * k]
                least = np.where(gid[own] == i, second[own], gid[own])
                scores = np.array([float(np.dot(q, v)) for v in vectors[own]])
                order = np.lexsort((least, -scores))[:k]
                found.append([{"neg": -float(scores[o]), "least": int(least[o]), "uid": int(uid[own[o]])} for o in order])
        return pa.Table.from_arrays([asked.column("query_id"), pa.array(found, kind)], names=["query_id", "found"])

    return left.groupBy("block", "shard").cogroup(right.groupBy("block", "shard")).applyInArrow(answer, schema)


def members(vectors: DataFrame, most: int) -> DataFrame:
    """(gid, second, vec, ids) of distinct vectors: ids are the `most` least ids in order, each as
    often as it occurs, up to `most` times; gid and second are the two least (second may be null).

    Large groups of equal vectors are cut down in salted steps before they meet."""
    key = F.xxhash64("vec")
    salted = vectors.withColumn("salt", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(64)))
    w = Window.partitionBy("key", "vec", "salt").orderBy("vec_id")
    again = Window.partitionBy("key", "vec", "salt", "vec_id").orderBy("vec_id")
    some = salted.withColumn("key", key).withColumn("d", F.dense_rank().over(w)).where(F.col("d") <= most)
    some = some.withColumn("r", F.row_number().over(again)).where(F.col("r") <= most)
    held = some.groupBy("key", "vec").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    held = held.withColumn("first", F.slice(F.array_distinct("ids"), 1, most))
    ids = F.filter("ids", lambda i: i <= F.element_at("first", -1))
    return held.select(F.col("first")[0].alias("gid"), F.get("first", F.lit(1)).alias("second"), "vec", ids.alias("ids"))


def nearest(vectors: DataFrame, queries: DataFrame, k: int, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): of vectors (vec_id, vec) the k nearest to each of queries (query_id, qvec).

    A row whose id is the query's own is no candidate."""
    held = common.written(members(vectors, k + 1).withColumn("uid", F.monotonically_increasing_id()), "nodes")
    shards = max(1, -(-held.count() // shard))
    blocks = max(1, -(-queries.count() // block))
    graph = common.written(index(held, shards), "graph")
    found = search(graph, queries, shards, blocks, k + 1)
    best = found.groupBy("query_id").agg(F.slice(F.sort_array(F.flatten(F.collect_list("found"))), 1, 2 * k + 2).alias("best"))
    each = best.select("query_id", F.explode("best").alias("b")).select("query_id", "b.uid", (-F.col("b.neg")).alias("score"))
    rows = each.join(held.select("uid", "ids"), "uid").select("query_id", "score", F.explode("ids").alias("vec_id")).where("vec_id <> query_id")
    first = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("neg"), "vec_id", "score"))), 1, k)
    return (
        rows.groupBy("query_id")
        .agg(first.alias("best"))
        .select("query_id", F.posexplode("best").alias("at", "b"))
        .select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), F.col("b.score").alias("score"))
    )


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, vec) of the usable rows, as doubles."""
    rows = common.table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vec"))
    return of_one_length(rows.where(F.col("vec_id").isNotNull() & usable(F.col("vec"))), "vec")


def neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: the 20 nearest of every row whose vec_id is divisible by 20."""
    rows = embeddings(spark, sf_dir)
    return nearest(rows, rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("vec").alias("qvec")), 20)
