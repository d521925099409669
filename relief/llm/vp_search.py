"""Nearest neighbours by cosine: vantage-point trees per shard (numpy inside grouped tasks).

On unit vectors the Euclidean distance is a metric and orders like the cosine.  A tree node has a vantage point and halves
the rest by distance from it, keeping both halves' least and greatest distance.  By the triangle inequality a half is at
least ``max(d - greatest, least - d)`` from a query at distance ``d`` of the vantage point.  A half is skipped when
``factor`` times that bound exceeds the distance of the query's k-th neighbour so far: factor one is exact, larger
factors skip more.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEAF = 64
SLACK = 1e-6  # distances near 0 are that uncertain: the root of a rounding error
QUERIES_AT_ONCE = 1024


def exact_cosine(q: np.ndarray, v: np.ndarray, qn: np.ndarray, vn: np.ndarray) -> np.ndarray:
    """Row by row, in one fixed order of summation, so that equal vectors have equal scores."""
    return (q * v).sum(1) / (qn * vn)


@dataclass
class Node:
    rows: np.ndarray  # of a leaf, else empty
    vantage: int = -1
    halves: list[tuple[Node, float, float]] = field(default_factory=list)  # nearer first: node, least, greatest distance


class VantagePointTree:
    """A tree over the rows of ``vectors`` (n x d, no zero rows)."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, seed: int = 1):
        self.ids, self.vectors = ids, vectors
        self.norms = np.sqrt((vectors * vectors).sum(1))
        self.units = vectors / self.norms[:, None]
        self.random = np.random.default_rng(seed)
        self.root = self._build(np.arange(len(ids)))

    def _distance(self, rows: np.ndarray, unit: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0, 2 - 2 * (self.units[rows] @ unit)))

    def _build(self, rows: np.ndarray) -> Node:
        if len(rows) <= LEAF:
            return Node(rows)
        # of a few candidates, the vantage point with the widest spread of distances to a sample
        tries, sample = self.random.choice(rows, 4), self.random.choice(rows, 64)
        vantage = int(max(tries, key=lambda t: self._distance(sample, self.units[t]).std()))
        distance = self._distance(rows, self.units[vantage])
        order = np.argpartition(distance, len(rows) // 2)  # by rank, so that equal vectors are halved too
        node = Node(rows[:0], vantage)
        for part in (order[: len(rows) // 2], order[len(rows) // 2 :]):
            node.halves.append((self._build(rows[part]), float(distance[part].min()), float(distance[part].max())))
        return node

    def search(self, ids: np.ndarray, vectors: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query row, candidate id, cosine) of the k nearest found of every query, its own id excepted."""
        found = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        for lo in range(0, len(ids), QUERIES_AT_ONCE):
            part = Search(self, ids[lo : lo + QUERIES_AT_ONCE], vectors[lo : lo + QUERIES_AT_ONCE], k, factor)
            found = [np.r_[a, b] for a, b in zip(found, (part.query + lo, part.id, part.score), strict=True)]
        return found[0], found[1], found[2]


class Search:
    """Queries going down a tree together; each node sees those that can't skip it."""

    def __init__(self, tree: VantagePointTree, ids: np.ndarray, vectors: np.ndarray, k: int, factor: float):
        self.tree, self.ids, self.vectors, self.k, self.factor = tree, ids, vectors, k, factor
        self.norms = np.sqrt((vectors * vectors).sum(1))
        self.units = vectors / self.norms[:, None]
        self.query, self.id, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.worst = np.full(len(ids), -np.inf)  # cosine of the k-th so far
        self.bound = np.full(len(ids), np.inf)  # its distance
        everyone = np.arange(len(ids))
        if len(ids) and len(tree.ids):
            self._descend(tree.root, everyone)
            self._visit(tree.root, everyone, np.zeros(len(ids)))

    def _from(self, node: Node, queries: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0, 2 - 2 * (self.units[queries] @ self.tree.units[node.vantage])))

    def _descend(self, node: Node, queries: np.ndarray) -> None:
        """Every query first sees the leaf that it falls into, which gives it a first bound."""
        if not node.halves:
            self._leaf(node, queries)
            return
        distance = self._from(node, queries)
        middle = (node.halves[0][2] + node.halves[1][1]) / 2
        for (half, _, _), part in zip(node.halves, (queries[distance <= middle], queries[distance > middle]), strict=True):
            if len(part):
                self._descend(half, part)

    def _visit(self, node: Node, queries: np.ndarray, least: np.ndarray) -> None:
        need = self.factor * (least - SLACK) <= self.bound[queries]
        queries, least = queries[need], least[need]
        if not len(queries):
            return
        if not node.halves:
            self._leaf(node, queries)
            return
        distance = self._from(node, queries)
        for half, low, high in node.halves:
            self._visit(half, queries, np.maximum(least, np.maximum(distance - high, low - distance)))

    def _leaf(self, node: Node, queries: np.ndarray) -> None:
        near = self.units[queries] @ self.tree.units[node.rows].T
        limit = self.worst[queries]
        if len(node.rows) > self.k + 1:  # the query itself may be among the first
            limit = np.maximum(limit, np.partition(near, -self.k - 1, axis=1)[:, -self.k - 1])
        q, c = np.nonzero(near >= limit[:, None] - 1e-9)
        q, c = queries[q], node.rows[c]
        other = self.ids[q] != self.tree.ids[c]
        q, c = q[other], c[other]
        score = exact_cosine(self.vectors[q], self.tree.vectors[c], self.norms[q], self.tree.norms[c])
        self.query, self.id, self.score = np.r_[self.query, q], np.r_[self.id, self.tree.ids[c]], np.r_[self.score, score]
        # keep the first k of each query; a leaf seen on the way down is seen again, so pairs are made distinct
        order = np.lexsort((self.id, -self.score, self.query))
        query, ident, score = self.query[order], self.id[order], self.score[order]
        new = np.ones(len(order), bool)
        new[1:] = (query[1:] != query[:-1]) | (ident[1:] != ident[:-1])
        query, ident, score = query[new], ident[new], score[new]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        last = rank == self.k - 1
        self.worst[query[last]] = score[last]
        self.bound[query[last]] = np.sqrt(np.maximum(0, 2 - 2 * score[last]))
        kept = rank < self.k
        self.query, self.id, self.score = query[kept], ident[kept], score[kept]


def _vectors(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors (of one length) in order of id; of rows that repeat an id, the one with the least vector."""
    ids = table.column("_id").to_numpy()
    flat = table.column("_vec").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    vectors = flat.reshape(len(ids), -1)
    order = np.lexsort((*vectors.T[::-1], ids)) if len(np.unique(ids)) < len(ids) else np.argsort(ids)
    ids, vectors = ids[order], vectors[order]
    first = np.ones(len(ids), bool)
    first[1:] = ids[1:] != ids[:-1]
    vectors = vectors[first]
    # the scale of a vector doesn't matter to the cosine; without it, squares could overflow or vanish
    scale = np.abs(vectors).max(1, keepdims=True)
    extreme = (scale > 1e100) | (scale < 1e-100)
    return ids[first], np.where(extreme, vectors / scale, vectors)


def usable(vector: Column) -> Column:
    """Not null, no null or non-finite component, not all zero (or empty)."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def search(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 5,
    factor: float = 1.0,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    shard_rows: int = 8192,
    block_rows: int = 8192,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: for every query row the ``k`` rows of ``vectors`` of largest cosine (all, if there
    are fewer), nearest first, ties to the smaller id; rows with the query's own id excepted.

    ``factor`` 1 is exact; larger factors prune more and may miss some.  Rows are dealt by a hash of their id to shards of
    about ``shard_rows``, queries to blocks of about ``block_rows``; a task builds the tree of one shard and searches it
    for one block.  Each shard's first ``k`` per query meet in a window that is cut to ``k`` rows before its shuffle.

    Vectors that are null, empty, all zero or hold a null or non-finite component take no part, nor do null ids.  Vectors are
    only compared with those of their length.  Of rows that repeat an id, the one with the least vector counts.  Other
    columns are ignored.
    """
    base = [t.where(F.col(id_col).isNotNull() & usable(F.col(vec_col))).select(F.col(id_col).cast("long").alias("_id"), F.col(vec_col).cast("array<double>").alias("_vec")) for t in (vectors, queries)]
    shards, blocks = (max(1, -(-t.count() // n)) for t, n in zip(base, (shard_rows, block_rows), strict=True))

    def part(n: int) -> Column:
        return F.pmod(F.xxhash64("_id"), F.lit(n)).cast("int")

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    rows = base[0].withColumns({"_query": F.lit(False), "_shard": part(shards)}).withColumn("_block", every(blocks))
    asks = base[1].withColumns({"_query": F.lit(True), "_block": part(blocks)}).withColumn("_shard", every(shards))
    work = rows.unionByName(asks).withColumn("_dim", F.size("_vec"))

    def run(table: pa.Table) -> pa.Table:
        asked = table.column("_query").to_numpy(zero_copy_only=False)
        if asked.all() or not asked.any():
            empty = pa.array([], pa.int64())
            return pa.table({"query_id": empty, "vec_id": empty, "score": pa.array([], pa.float64())})
        tree = VantagePointTree(*_vectors(table.filter(pa.array(~asked))))
        ids, wanted = _vectors(table.filter(pa.array(asked)))
        query, found, score = tree.search(ids, wanted, k, factor)
        return pa.table({"query_id": ids[query], "vec_id": found, "score": score})

    found = work.groupBy("_dim", "_shard", "_block").applyInArrow(run, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
