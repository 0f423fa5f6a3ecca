"""Exact top-k search with a pivot table (operator 9).

Maximum inner product, made a nearest-neighbour search: with ``M`` the largest
vector norm, ``x' = (x, sqrt(M^2 - |x|^2))`` and ``q' = (q, 0)`` give
``|q' - x'|^2 = |q|^2 + M^2 - 2 q.x``.  In that metric space the triangle inequality
holds: for pivots ``p``, ``|d(q,p) - d(x,p)|`` never exceeds ``d(q,x)``, so the largest
difference over many pivots bounds every candidate's score from above.  The
candidates' distances to the pivots are computed once and stored with their block.

Together the distances say more: they place ``q'`` and ``x'`` in the span of the pivots, and
give each its height above that span.  The distance between two such points is at most
``d(q,x)`` and never below any single pivot's difference, so it is the maximum lower bound
that the pivot table can give.  It is what candidates are ordered and eliminated by.

A query visits a block's candidates in bound order and stops when the next bound is
below its k-th best score: everything behind is worse, so the result is exact.  The k-th
best score is carried from block to block of a task.  The stated query set meets all rows
block by block: queries and candidates are packed into blocks of bounded size, query
blocks are copied to each group of candidate blocks and meet there in an equi-join; only
k rows for each query and block go on.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketlens.llm.common import map_batches

#: Pivots: a bounded number of rows, drawn by a hash of the id.
PIVOTS = 48
#: Queries of a block, candidates of a block and (at most) of a group, candidates evaluated
#: at a time, queries whose bounds are computed at a time.
QUERY_ROWS, BLOCK_ROWS, GROUP_ROWS, STRIDE, BOUND_ROWS = 1024, 2048, 40_960, 128, 128
#: Products from here on are no longer exact.
EXACT = 2.0 ** 53
SCALE = 256.0


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``(vec_id, x)`` with ``floor(256 * x)`` as doubles; rows that take no part are gone."""
    x = F.transform(F.col(vec_col), lambda v: F.floor(v.cast("double") * SCALE).cast("double"))
    finite = F.forall(F.col(vec_col), lambda v: v.isNotNull() & ~F.isnan(v)
                      & (F.abs(v.cast("double")) < float("inf")))
    return vectors.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull()
                         & (F.size(vec_col) > 0) & finite) \
        .select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x"))


BLOCK = "dim int, ids binary, xs binary, ds binary"


class Pivots:
    """Pivots of one vector length, in the space with the added coordinate."""

    def __init__(self, rows: np.ndarray, norm2: float):
        self.rows, self.norm2 = rows, norm2
        self.own = np.einsum("ij,ij->i", rows, rows)
        self.more = np.sqrt(np.maximum(norm2 - self.own, 0))
        # orthonormal axes of the pivots' span; dependent pivots add none
        value, vector = np.linalg.eigh(rows @ rows.T + np.outer(self.more, self.more))
        keep = value > 1e-9 * max(value.max(initial=0), 1e-300)
        self.axes = vector[:, keep] / np.sqrt(value[keep])

    def distances(self, x: np.ndarray, is_query: bool) -> np.ndarray:
        """The pivot table's rows for some vectors (the added coordinate of a query is 0)."""
        own = np.einsum("ij,ij->i", x, x)
        more = np.zeros(len(x)) if is_query else np.sqrt(np.maximum(self.norm2 - own, 0))
        d2 = own[:, None] + self.own - 2 * x @ self.rows.T + (more[:, None] - self.more) ** 2
        return np.sqrt(np.maximum(d2, 0))

    def place(self, distances: np.ndarray, norm2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Coordinates in the span and heights above it, from the distances alone."""
        products = (norm2[:, None] + self.own + self.more ** 2 - distances ** 2) / 2
        inside = products @ self.axes
        return inside, np.sqrt(np.maximum(norm2 - np.einsum("ij,ij->i", inside, inside), 0))


def _packer(pivots: dict[int, Pivots], is_query: bool):
    """Packs Arrow batches into blocks: ids, vectors and their distances to the pivots."""
    size = QUERY_ROWS if is_query else BLOCK_ROWS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.asarray(batch.column(0))
            lists = batch.column(1)
            sizes = np.diff(np.asarray(lists.offsets))
            flat = np.asarray(lists.flatten())
            starts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
            for dim in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == dim)
                for at in range(0, len(rows) if dim in pivots else 0, size):
                    part = rows[at:at + size]
                    x = flat[starts[part][:, None] + np.arange(dim)]
                    yield pa.RecordBatch.from_pydict(
                        {"dim": [dim], "ids": [ids[part].astype("<i8").tobytes()],
                         "xs": [x.tobytes()], "ds": [pivots[dim].distances(x, is_query).tobytes()]},
                        schema=pa.schema([("dim", pa.int32()), ("ids", pa.binary()), ("xs", pa.binary()),
                                          ("ds", pa.binary())]))
    return run


def search_block(q: np.ndarray, bound: np.ndarray, own: int, ids: np.ndarray, x: np.ndarray, k: int,
                 least: float = -np.inf, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray, int]:
    """The k best ``(ids, scores)`` of a block for one query, and how many were evaluated.

    ``bound`` limits every candidate's score from above; candidates below ``least`` are not wanted.
    """
    open_ = np.flatnonzero(bound >= least)
    order = open_[np.argsort(-bound[open_], kind="stable")]
    best_ids, best = np.zeros(0, np.int64), np.zeros(0)
    for at in range(0, len(order), stride):
        if len(best) >= k and bound[order[at]] < best[-1]:
            return best_ids, best, at
        rows = order[at:at + stride]
        rows = rows[ids[rows] != own]
        all_ids = np.concatenate([best_ids, ids[rows]])
        scores = np.concatenate([best, x[rows] @ q])
        if len(scores) > 4 * k:                  # most are far from the k best
            cut = np.partition(scores, len(scores) - k)[len(scores) - k]
            near = scores >= cut
            all_ids, scores = all_ids[near], scores[near]
        top = np.lexsort((all_ids, -scores))[:k]
        best_ids, best = all_ids[top], scores[top]
    return best_ids, best, len(order)


class Search:
    """The blocks that one task compares; keeps every query's k best scores so far."""

    def __init__(self, pivots: dict[int, Pivots], k: int):
        self.pivots, self.k = pivots, k
        self.best: dict[tuple[int, int], np.ndarray] = {}
        self.evaluated = self.met = 0

    def blocks(self, row: dict) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """``(query id, ids, scores)`` of one block of candidates for a block of queries."""
        dim, pivots = row["dim"], self.pivots[row["dim"]]
        ids, x = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["xs"]).reshape(-1, dim)
        qids, q = np.frombuffer(row["qids"], "<i8"), np.frombuffer(row["qxs"]).reshape(-1, dim)
        inside, height = pivots.place(np.frombuffer(row["ds"]).reshape(len(ids), -1), np.full(len(ids), pivots.norm2))
        norm2 = np.einsum("ij,ij->i", q, q)
        q_inside, q_height = pivots.place(np.frombuffer(row["qds"]).reshape(len(qids), -1), norm2)
        for at in range(0, len(qids), BOUND_ROWS):
            part = slice(at, at + BOUND_ROWS)
            # a little slack: the bounds are rounded, the scores are whole numbers
            bounds = q_inside[part] @ inside.T + np.outer(q_height[part], height)
            bounds += 1e-6 * (1 + pivots.norm2 + norm2[part, None])
            for i, bound in enumerate(bounds, at):
                seen = self.best.get((dim, int(qids[i])), np.zeros(0))
                least = seen[-1] if len(seen) == self.k else -np.inf
                found, scores, n = search_block(q[i], bound, int(qids[i]), ids, x, self.k, least)
                self.best[dim, int(qids[i])] = -np.sort(-np.concatenate([seen, scores]))[:self.k]
                self.evaluated += n
                self.met += len(ids)
                yield int(qids[i]), found, scores


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, *, id_col: str = "vec_id",
           vec_col: str = "embedding", pivots: int = PIVOTS) -> DataFrame:
    """The ``k`` rows of ``vectors`` with the highest inner product for each query.

    ``(query_id, rank, vec_id, score)``, rank from 1, ties to the smaller ``vec_id``; a
    query with fewer candidates gets them all.  Scores are whole numbers of the
    quantised components.  Rows with a NULL id, a NULL or empty vector, or a NULL or
    non-finite component take no part; vectors of another length than the query's are
    no candidates; rows that carry the query's own id are left out; of queries with
    equal ids the smallest vector counts, and equal candidate rows all count.  Other
    columns are not read.  Vectors so long that a product could pass 2^53, and not be exact,
    are an error.
    """
    spark = vectors.sparkSession
    cand = usable(vectors, id_col, vec_col)
    wanted = usable(queries, id_col, vec_col).groupBy("vec_id").agg(F.min("x").alias("x"))
    # a row for each length of vectors
    shape = cand.groupBy(F.size("x").alias("dim")).agg(
        F.count("*").alias("n"),
        F.max(F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v)).alias("norm2")).collect()
    if not shape:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    # bounded: a fixed number of pivots for each vector length
    table = {}
    for r in shape:
        rows = cand.where(F.size("x") == r["dim"]).orderBy(F.xxhash64("vec_id"), "vec_id").limit(pivots).collect()
        table[r["dim"]] = Pivots(np.unique(np.array([p["x"] for p in rows], float), axis=0), r["norm2"])

    n_queries, longest = wanted.agg(F.count("*"), F.max(F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v))).first()
    if n_queries and longest * max(r["norm2"] for r in shape) >= EXACT ** 2:
        raise ValueError("inner products of these vectors can pass 2^53 and would not be exact")
    n = sum(r["n"] for r in shape)
    groups = max(1, math.ceil(n / GROUP_ROWS), min(n // BLOCK_ROWS, 2 * spark.sparkContext.defaultParallelism))
    # blocks are dealt out one by one, and groups to a fixed number of tasks: all get alike
    blocks = map_batches(cand, _packer(table, False), BLOCK) \
        .withColumn("group", F.pmod(F.monotonically_increasing_id() + F.shiftright(F.monotonically_increasing_id(), 33),
                                    F.lit(groups)).cast("int"))
    asked = wanted.repartition(max(1, math.ceil(n_queries / QUERY_ROWS)), "vec_id")
    asked = map_batches(asked, _packer(table, True), BLOCK) \
        .select("dim", *[F.col(c).alias("q" + c) for c in ("ids", "xs", "ds")],
                F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"))
    met = blocks.repartition(groups, "group", "dim").join(asked.repartition(groups, "group", "dim").hint("merge"), ["group", "dim"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = Search(table, k)
        for batch in batches:
            for row in batch.to_pylist():
                found = list(task.blocks(row))
                sizes = [len(ids) for _, ids, _ in found]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat([f[0] for f in found], sizes)), pa.array(np.concatenate([f[1] for f in found])),
                     pa.array(np.concatenate([f[2] for f in found]).astype(np.int64))],
                    ["query_id", "vec_id", "score"])

    near = map_batches(met, run, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k) \
        .select("query_id", "rank", "vec_id", "score")


#: DuckDB SQL of the registered query.
SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.x, c.x) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.x) = len(q.x)
  WHERE q.vec_id % 50 = 0),
r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
  FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
