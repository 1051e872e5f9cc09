"""Approximate nearest neighbours by a forest of random-projection trees.

The trees are fitted on a bounded sample; then every vector is routed to its leaf of each tree. A query walks all
trees through one shared priority queue, nearest splits first, until it has ``leaves`` leaves. Queries and vectors
meet leaf by leaf, where the exact inner products of the leaf's vectors are taken; each query keeps the best.

The largest inner product is the smallest distance once every vector has one more component, sqrt(m^2 - |x|^2) with m
the largest norm, and a query has 0 there: the trees work in that space, the reranking on the original vectors.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CELL_ROWS = 20_000  # expected vectors of a leaf that meet its queries at once; larger leaves are split by a salt
ROUNDING = 4 * np.finfo(np.float64).eps  # of a product's terms, relative: what a block's products may be off
CELL_NAMES = ["tree", "leaf", "salt", "part", "candidate", "vec_id", "embedding"]
HELD_QUERIES = 20_000  # whose best a task holds before it hands them on; expected queries of a cell, too


@dataclass
class Tree:
    """Node k splits by normal[k] and offset[k] into left[k] and right[k]; a negative child -1-j is leaf j."""

    normal: np.ndarray
    offset: np.ndarray
    left: np.ndarray
    right: np.ndarray

    def route(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector."""
        node = np.zeros(len(x), np.int64)
        if not len(self.normal):
            return node
        while (open_ := np.flatnonzero(node >= 0)).size:
            k = node[open_]
            side = np.einsum("ij,ij->i", x[open_], self.normal[k]) > self.offset[k]
            node[open_] = np.where(side, self.right[k], self.left[k])
        return -1 - node


def grow(x: np.ndarray, leaf: int, rng: np.random.Generator) -> Tree:
    """Splits by the direction between two random vectors, at the median, until ``leaf`` vectors are left. Equal
    vectors can't be told apart: where all projections are equal a leaf stays larger."""
    normal, offset, left, right = [], [], [], []
    leaves = 0
    todo = [(np.arange(len(x)), -1, False)]
    while todo:
        rows, parent, is_right = todo.pop()
        me = -1 - leaves
        if len(rows) > leaf:
            for _ in range(5):
                a, b = x[rng.choice(rows, 2, replace=False)]
                way = a - b
                along = x[rows] @ way
                at = float(np.median(along))
                over = along > at
                if over.any() and not over.all():
                    me = len(normal)
                    normal.append(way / np.linalg.norm(way))
                    offset.append(at / np.linalg.norm(way))
                    left.append(0)
                    right.append(0)
                    todo += [(rows[over], me, True), (rows[~over], me, False)]
                    break
        if me < 0:
            leaves += 1
        if parent >= 0:
            (right if is_right else left)[parent] = me
    return Tree(np.array(normal, np.float64).reshape(-1, x.shape[1]), np.array(offset), np.array(left, np.int64), np.array(right, np.int64))


def search(forest: list[Tree], query: np.ndarray, leaves: int) -> list[tuple[int, int]]:
    """The first ``leaves`` (tree, leaf) of all trees by one queue. A leaf's priority is the sum of
    the margins by which its splits lie on the other side of the query (0 where none does)."""
    sides = [t.normal @ query - t.offset if len(t.normal) else np.empty(0) for t in forest]
    queue = [(0.0, k, 0 if len(t.normal) else -1) for k, t in enumerate(forest)]
    heapq.heapify(queue)
    found = []
    while queue and len(found) < leaves:
        far, k, node = heapq.heappop(queue)
        if node < 0:
            found.append((k, -1 - node))
            continue
        margin = float(sides[k][node])
        tree = forest[k]
        near, other = (tree.right[node], tree.left[node]) if margin > 0 else (tree.left[node], tree.right[node])
        heapq.heappush(queue, (far, k, int(near)))
        heapq.heappush(queue, (far + abs(margin), k, int(other)))
    return found


def vectors_of(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _leaves_of_rows(batches: Iterator[pa.RecordBatch], forest: list[Tree], scale: float, most: float, salts: int, parts: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        x = vectors_of(batch.column("embedding")) / scale
        augmented = np.column_stack([x, np.sqrt(np.maximum(most - (x * x).sum(1), 0))])
        n = len(x)
        salt, yes = pa.array(batch.column("vec_id").to_numpy() % salts), pa.array(np.ones(n, bool))
        for k, tree in enumerate(forest):
            leaf = pa.array(tree.route(augmented))
            for part in range(parts):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, k)), leaf, salt, pa.array(np.full(n, part)), yes, batch.column("vec_id"), batch.column("embedding")], CELL_NAMES)


def _leaves_of_queries(batches: Iterator[pa.RecordBatch], forest: list[Tree], leaves: int, scale: float, salts: int, parts: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = vectors_of(batch.column("embedding")) / scale if batch.num_rows else ()
        ids = batch.column("vec_id").to_pylist()
        for i in range(batch.num_rows):
            cells = search(forest, np.append(x[i], 0.0), leaves)
            tree, leaf, salt = zip(*((t, f, s) for t, f in cells for s in range(salts)), strict=True)
            at, n = pa.array(np.full(len(tree), i)), len(tree)
            part = zlib.crc32(str(ids[i]).encode()) % parts
            yield pa.RecordBatch.from_arrays([pa.array(tree, pa.int64()), pa.array(leaf, pa.int64()), pa.array(salt, pa.int64()), pa.array(np.full(n, part)), pa.array(np.zeros(n, bool)), batch.column("vec_id").take(at), batch.column("embedding").take(at)], CELL_NAMES)


class _Best:
    """The best candidates of each query so far, over the cells of a task."""

    def __init__(self, top: int) -> None:
        self.top = top
        self.found: dict[int, dict[int, float]] = {}

    def add(self, query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> None:
        scores = queries @ vectors.T
        k = min(self.top + 1, len(ids))  # one may be the query itself
        off = ROUNDING * queries.shape[1] * np.sqrt((queries**2).sum(1)) * np.sqrt((vectors**2).sum(1).max())
        floor = np.partition(scores, len(ids) - k, axis=1)[:, len(ids) - k] - 2 * off
        for i, q in enumerate(query_ids.tolist()):
            near = np.flatnonzero(scores[i] >= floor[i])
            exact = (vectors[near] * queries[i]).sum(1)  # the same for equal vectors, wherever they stand
            have = self.found.setdefault(q, {})
            have.update(zip(ids[near].tolist(), exact.tolist(), strict=True))
            have.pop(q, None)
            if len(have) > 8 * self.top:
                self.found[q] = dict(self._cut(have))

    def _cut(self, have: dict[int, float]) -> list[tuple[int, float]]:
        return heapq.nsmallest(self.top, have.items(), key=lambda x: (-x[1], x[0]))

    def batch(self) -> pa.RecordBatch:
        rows = [(q, v, s) for q, have in self.found.items() for v, s in self._cut(have)]
        q, v, s = zip(*rows, strict=True) if rows else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(v, pa.int64()), pa.array(s, pa.float64())], ["query_id", "vec_id", "score"])


def _meet(batches: Iterator[pa.RecordBatch], top: int, block: int = 4096) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by cell, the cell's queries first; its vectors then pass by in blocks."""
    best = _Best(top)
    cell: tuple | None = None
    query_ids: list[np.ndarray] = []
    queries: list[np.ndarray] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in CELL_NAMES[:5]])
        edges = np.append(np.flatnonzero(np.append(True, (key[1:] != key[:-1]).any(1))), len(key))
        ids, x = batch.column("vec_id").to_numpy(), vectors_of(batch.column("embedding"))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            here = tuple(key[a, :4].tolist())
            if here != cell:
                cell, query_ids, queries = here, [], []
            if not key[a, 4]:
                query_ids.append(ids[a:b])
                queries.append(x[a:b])
            elif query_ids:
                own, q = np.concatenate(query_ids), np.concatenate(queries)
                for i in range(0, len(own), block):
                    best.add(own[i : i + block], q[i : i + block], ids[a:b], x[a:b])
                if len(best.found) > HELD_QUERIES:
                    yield best.batch()
                    best = _Best(top)
    yield best.batch()


def valid(vector: Column) -> Column:
    """Neither null nor zero nor with null or non-finite components."""
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda v: v != 0), F.lit(False))


def nearest(rows: DataFrame, is_query: Column, top: int = 20, trees: int = 10, leaf_share: float = 0.008, leaves: int = 150, sample: int = 20_000, seed: int = 11, leaf_rows: int | None = None) -> DataFrame:
    """query_id, rank (from 1), vec_id and score (inner product, double precision) of each query's ``top`` nearest
    found among all other rows, nearest first, ties to the smaller vec_id. Fewer rows give fewer neighbours.

    Null, zero and not finite vectors, and null vec_ids, take no part, nor do vectors of another length than most have
    (of the shorter where two are as frequent); repeated rows of one vec_id are one. The trees see vectors divided by the
    largest component, so that no square leaves the range of doubles; a query whose products leave it may find fewer. The
    trees are fitted on at most ``sample`` rows (the smallest hashes of vec_id), whose number bounds what the driver
    holds; all rows are indexed. Of equal vectors only the ``top`` + 1 smallest vec_ids can be among a query's
    nearest, so the others leave before the index: a group of copies of any size is that many rows.

    A leaf holds ``leaf_share`` of the rows, so that ``leaves`` reach the same part of the table at every size; with
    ``leaf_rows`` a leaf holds about that many instead, and work no longer grows with the square of the table, nor does
    recall stay the same. The defaults give a recall of 0.98 on vectors without any structure in 64 dimensions, where
    over half of all rows have to be looked at; vectors that cluster need far fewer leaves. A leaf of many vectors is
    split by a salt, one of many queries by parts, so that a cell holds a bounded number of queries.
    """
    spark = rows.sparkSession
    schema = "tree long, leaf long, salt long, part long, candidate boolean, vec_id long, embedding array<double>"
    none = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.where(F.col("vec_id").isNotNull() & valid(F.col("embedding"))).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    largest = F.array_max(F.transform("embedding", F.abs))
    lengths = rows.groupBy(F.size("embedding").alias("length")).agg(F.count("*").alias("n"), F.max(largest).alias("scale"), F.count_if(is_query).alias("asked"))
    common = lengths.orderBy(F.desc("n"), "length").first()
    if common is None:
        return none
    rows = rows.where(F.size("embedding") == common.length)
    queries = rows.where(is_query).dropDuplicates(["vec_id"])
    copies = Window.partitionBy("embedding").orderBy("vec_id")
    indexed = rows.withColumn("nth", F.dense_rank().over(copies)).where(F.col("nth") <= top + 1).drop("nth")
    norm = F.aggregate("embedding", F.lit(0.0), lambda s, v: s + (v / common.scale) * (v / common.scale))
    most = rows.agg(F.max(norm)).first()[0]
    picked = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("embedding").toArrow().combine_chunks()
    x = np.unique(vectors_of(picked.column("embedding").combine_chunks()) / common.scale, axis=0)
    x = np.column_stack([x, np.sqrt(np.maximum(most - (x * x).sum(1), 0))])
    rng = np.random.default_rng(seed)
    share = leaf_share if leaf_rows is None else min(1.0, leaf_rows / common.n)
    forest = [grow(x, max(2, int(share * len(x))), rng) for _ in range(trees)]
    salts = max(1, -(-int(common.n * share) // CELL_ROWS))
    parts = max(1, -(-common.asked * leaves // (HELD_QUERIES * sum(len(t.normal) + 1 for t in forest))))
    options = {"forest": forest, "scale": common.scale, "salts": salts, "parts": parts}
    cells = indexed.mapInArrow(partial(_leaves_of_rows, most=float(most), **options), schema)
    asked = queries.mapInArrow(partial(_leaves_of_queries, leaves=leaves, **options), schema)
    key = ["tree", "leaf", "salt", "part"]
    met = cells.unionByName(asked).repartition(*key).sortWithinPartitions(*key, "candidate")
    found = met.mapInArrow(partial(_meet, top=top), "query_id long, vec_id long, score double").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def op10_nearest(spark, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)
