"""Exact top-k by a Voronoi join (operator 4).

Pivots part queries and data into cells.  A cell of queries is summarised by the distance U of its
farthest query from its pivot p.  As q = p + u with |u| <= U, any of its queries has with a row x
an inner product between p x - U |x| and p x + U |x|.  From the lower ends, of which each task keeps
the k + 1 largest of different ids per cell, follows a score that the k-th best of every query of the
cell reaches at least; a row is sent to the cell only if its upper end reaches that score.  Cells that
need few rows are groups of their own; those that need most rows anyway share groups of bounded size,
so that where nothing can be pruned rows are copied once per block of queries and not once per cell.
Groups' rows are cut into parts of bounded size, each is solved with a block of queries locally, and the
parts' best are merged.  Nothing is approximate: scores are integers, and bounds leave room for rounding.

Defined results: a component x counts as floor(1024 x); rows that are null or empty, or hold null or
non-finite components, or have no id, take no part (all-zero vectors do), nor do vectors of another length
than the most common one (of ties, the shortest); ties go to the smaller id; repeated ids are repeated
candidates; fewer than k candidates are all returned; an empty table gives no rows.  Scores beyond a long
are its limits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .graph_search import as_matrix, of_one_length

#: Pivots at most (they grow with the square root of the rows): the bound of all that reaches the driver and is sent to tasks.
PIVOTS = 1024
#: Bytes of vectors in a part of a group's rows, and mean queries of a block.
PART_BYTES, QUERIES = 16_000_000, 2_048
#: Cells that need at least this share of all rows share groups.
MOST = 0.5
LONG = 2**63 - 1


def finite(vec: Column) -> Column:
    """Not null or empty, no null or non-finite component."""
    fine = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vec.isNotNull() & (F.size(vec) > 0) & F.coalesce(fine, F.lit(False))


def scaled(vec: Column) -> Column:
    return F.transform(vec, lambda x: F.floor(x * 1024).cast("long"))


@dataclass
class Cells:
    """A row per pivot that has queries: the pivot, its queries' number and largest distance."""

    pivots: np.ndarray
    queries: np.ndarray
    radius: np.ndarray

    def ends(self, v: np.ndarray, sign: int) -> np.ndarray:
        """Upper (sign 1) or lower (-1) ends of the inner products of rows with queries of each cell: (rows, cells)."""
        middle = v @ self.pivots.T
        long = np.sqrt((v**2).sum(axis=1))[:, None]
        swing = long * self.radius[None]
        # Products may cancel, so the room for rounding is taken from the vectors' lengths and not from their product.
        room = 1e-9 * long * (np.sqrt((self.pivots**2).sum(axis=1)) + self.radius)[None]
        return middle + sign * (swing + 1 + room)


def choose_pivots(data: DataFrame, most: int) -> np.ndarray:
    """At most `most` distinct vectors, of the rows with the least hash of their id."""
    rows = data.orderBy(F.xxhash64("vec_id", F.lit(3)), "vec_id").limit(most).select("vec").distinct().orderBy("vec").collect()
    return np.array([r.vec for r in rows], np.float64)


def nearest_pivot(vectors: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(pivot, distance) of each vector."""
    d = (vectors**2).sum(axis=1)[:, None] + (pivots**2).sum(axis=1)[None] - 2 * vectors @ pivots.T
    own = d.argmin(axis=1)
    return own, np.sqrt(((vectors - pivots[own]) ** 2).sum(axis=1))


def celled(queries: DataFrame, pivots: np.ndarray) -> DataFrame:
    """queries (query_id, qvec) with their cell and distance from its pivot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own, far = nearest_pivot(as_matrix(b.column("qvec"), b.num_rows), pivots) if b.num_rows else (np.zeros(0), np.zeros(0))
            yield pa.RecordBatch.from_arrays([b.column("query_id"), b.column("qvec"), pa.array(own.astype(np.int32)), pa.array(far)], ["query_id", "qvec", "cell", "far"])

    return queries.mapInArrow(run, "query_id long, qvec array<long>, cell int, far double")


def largest_of_different_ids(ids: np.ndarray, ends: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row of (ids, ends), in which an id may come twice, the `most` largest ends of different ids."""
    width = min(2 * most, ends.shape[1])
    some = np.argpartition(-ends, width - 1, axis=1)[:, :width]
    at = np.arange(len(ends))[:, None]
    some = some[at, np.argsort(-ends[at, some], axis=1, kind="stable")]
    ids, ends = ids[at, some], ends[at, some]
    again = (np.tril(np.ones((width, width), bool), -1)[None] & (ids[:, :, None] == ids[:, None, :])).any(axis=2)
    ends = np.where(again, -np.inf, ends)
    order = np.argsort(-ends, axis=1, kind="stable")[:, :most]
    return ids[at, order], ends[at, order]


def floors(data: DataFrame, cells: Cells, k: int) -> np.ndarray:
    """For each cell a score that the k-th best of each of its queries reaches; -inf where rows are too few.

    k + 1 rows of different ids hold k of other ids than the query's."""
    n, most = len(cells.pivots), k + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, best = np.zeros((n, 0), np.int64), np.zeros((n, 0))
        for b in batches:
            if not b.num_rows:
                continue
            names = b.column("vec_id").to_numpy()
            low = cells.ends(as_matrix(b.column("vec"), b.num_rows), -1)
            order = np.argsort(names, kind="stable")
            begins = np.flatnonzero(np.append(True, np.diff(names[order]) != 0))
            low, names = np.maximum.reduceat(low[order], begins, axis=0), names[order][begins]
            ids, best = largest_of_different_ids(np.concatenate([ids, np.broadcast_to(names, (n, len(names)))], axis=1), np.concatenate([best, low.T], axis=1), most)
        live = np.isfinite(best)
        yield pa.RecordBatch.from_arrays([pa.array(np.nonzero(live)[0].astype(np.int32)), pa.array(ids[live]), pa.array(best[live])], ["cell", "vec_id", "low"])

    each = data.mapInArrow(run, "cell int, vec_id long, low double").groupBy("cell", "vec_id").agg(F.max("low").alias("low"))
    top = lambda c: F.slice(F.sort_array(c, asc=False), 1, most)
    salted = each.groupBy("cell", F.pmod(F.xxhash64("vec_id"), F.lit(32)).alias("salt")).agg(top(F.collect_list("low")).alias("low"))
    out = np.full(n, -np.inf)
    for r in salted.groupBy("cell").agg(top(F.flatten(F.collect_list("low"))).alias("low")).collect():  # a row per cell
        if len(r.low) == most:
            out[r.cell] = r.low[-1]
    return out


def needs(data: DataFrame, cells: Cells, floor: np.ndarray) -> np.ndarray:
    """How many rows each cell needs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(floor), np.int64)
        for b in batches:
            total += (cells.ends(as_matrix(b.column("vec"), b.num_rows), 1) >= floor).sum(axis=0) if b.num_rows else 0
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(floor), dtype=np.int32)), pa.array(total)], ["cell", "n"])

    out = np.zeros(len(floor), np.int64)
    for r in data.mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():  # a row per cell
        out[r.cell] = r.n
    return out


def shared_groups(queries: np.ndarray, need: np.ndarray, rows: int, block: int) -> np.ndarray:
    """The group of each cell: its own where it needs few rows, else one that holds about `block` queries."""
    group, last, held = np.zeros(len(need), np.int64), -1, None
    for c in np.argsort(need, kind="stable"):
        if need[c] < MOST * rows or held is None or held + queries[c] > block:
            last, held = last + 1, 0 if need[c] >= MOST * rows else None
        if held is not None:
            held += queries[c]
        group[c] = last
    return group


def solved(mine: pa.Table, theirs: pa.Table, k: int) -> list[list[dict]]:
    """For each query of `theirs` its k best rows of `mine` as (-score, vec_id), best first."""
    ids, v = mine.column("vec_id").to_numpy(), as_matrix(mine.column("vec"), mine.num_rows)
    q_ids, q = theirs.column("query_id").to_numpy(), as_matrix(theirs.column("qvec"), theirs.num_rows)
    exact = v.shape[1] * float(np.abs(v).max()) * float(np.abs(q).max()) < 2**53  # then sums of products are exact in doubles
    if not exact:
        wide = lambda t, c: np.array(t.column(c).combine_chunks().flatten().to_pylist(), object).reshape(t.num_rows, -1)
        v, q = wide(mine, "vec"), wide(theirs, "qvec")
    best = []
    for at in range(0, len(q), 64):
        scores = q[at : at + 64] @ v.T
        scores = (np.rint(scores) if exact else np.clip(scores, -LONG, LONG)).astype(np.int64)
        for own, row in zip(q_ids[at : at + 64], scores):
            live = ids != own
            row, names = row[live], ids[live]
            if len(row) > k:
                some = np.flatnonzero(row >= np.partition(row, len(row) - k)[len(row) - k])
                row, names = row[some], names[some]
            order = np.lexsort((names, -row))[:k]
            best.append([{"neg": -int(row[o]), "vec_id": int(names[o])} for o in order])
    return best


def top_k(data: DataFrame, queries: DataFrame, k: int, pivots: int = PIVOTS, part_bytes: int = PART_BYTES, block: int = QUERIES, told: dict | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): of data (vec_id, vec) the k highest integer inner products
    with each of queries (query_id, qvec).  A row whose id is the query's own is no candidate.

    told gets the number of rows, of groups, and of rows that are sent to groups."""
    n, asked = data.count(), queries.count()
    p = choose_pivots(data, max(1, min(pivots, int(n**0.5), asked // 8)))
    if not len(p) or not asked:
        return data.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    in_cells = common.written(celled(queries, p), "cells")
    summary = in_cells.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("far")).orderBy("cell").collect()  # a row per pivot
    cells = Cells(p[[r.cell for r in summary]], np.array([r.n for r in summary]), np.array([r.far for r in summary]))
    floor = floors(data, cells, k)
    need = needs(data, cells, floor)
    group = shared_groups(cells.queries, need, n, block)
    n_groups = int(group.max()) + 1
    member = np.zeros((len(group), n_groups), bool)
    member[np.arange(len(group)), group] = True
    blocks = np.maximum(1, -(-(member.T @ cells.queries) // block))
    parts = np.maximum(1, -(-np.minimum(n, member.T @ need) * 8 * p.shape[1] // part_bytes))
    if told is not None:
        told |= {"rows": n, "groups": n_groups, "sent": int(np.minimum(n, member.T @ need).sum())}

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                some = b.slice(at, 1024)
                needed = cells.ends(as_matrix(some.column("vec"), some.num_rows), 1) >= floor
                who, to = np.nonzero(needed.astype(np.float32) @ member.astype(np.float32))
                yield pa.RecordBatch.from_arrays([*some.take(pa.array(who)).columns, pa.array(to.astype(np.int32))], ["vec_id", "vec", "grp"])

    of = lambda values, c: F.get(F.array(*(F.lit(int(x)) for x in values)), c)
    own = F.get(F.array(*(F.lit(int(group[at])) for at in np.searchsorted([r.cell for r in summary], np.arange(len(p))).clip(0, len(group) - 1))), F.col("cell")).alias("grp")
    each = lambda count, name: F.explode(F.sequence(F.lit(0), count - 1)).alias(name)
    hashed = lambda c, seed, count, name: F.pmod(F.xxhash64(*c, F.lit(seed)), count).cast("int").alias(name)
    grp = F.col("grp")
    right = in_cells.select("query_id", "qvec", own).select("grp", "query_id", "qvec", hashed(["query_id", "qvec"], 9, of(blocks, grp), "block"), each(of(parts, grp), "part"))
    sent = data.mapInArrow(route, "vec_id long, vec array<long>, grp int")
    left = sent.select("grp", "vec_id", "vec", hashed(["vec_id", "vec"], 4, of(parts, grp), "part"), each(of(blocks, grp), "block"))

    def solve(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        kind = pa.list_(pa.struct([("neg", pa.int64()), ("vec_id", pa.int64())]))
        if not mine.num_rows or not theirs.num_rows:
            return pa.Table.from_arrays([pa.array([], pa.int64()), pa.array([], kind)], names=["query_id", "best"])
        return pa.Table.from_arrays([theirs.column("query_id"), pa.array(solved(mine, theirs, k), kind)], names=["query_id", "best"])

    schema = "query_id long, best array<struct<neg:long,vec_id:long>>"
    keys = ["grp", "block", "part"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(solve, schema)
    least = lambda c: F.slice(F.sort_array(F.flatten(F.collect_list(c))), 1, k).alias("best")
    salted = found.groupBy("query_id", F.pmod(F.xxhash64("best"), F.lit(16)).alias("salt")).agg(least("best"))
    return salted.groupBy("query_id").agg(least("best")).select("query_id", F.posexplode("best").alias("at", "b")).select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), (-F.col("b.neg")).alias("score")
    )


def exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: the 10 highest of every row whose vec_id is divisible by 100."""
    rows = common.table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vec"))
    rows = of_one_length(rows.where(F.col("vec_id").isNotNull() & finite(F.col("vec"))), "vec")
    rows = common.written(rows.select("vec_id", scaled(F.col("vec")).alias("vec")), "vectors")
    return top_k(rows, rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("vec").alias("qvec")), 10)


#: DuckDB twin of op4.
EXACT_SQL = """
WITH rows AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, d.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.v, d.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM rows q JOIN rows d ON q.vec_id % 100 = 0 AND q.vec_id <> d.vec_id),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""
