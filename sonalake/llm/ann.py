"""Approximate nearest neighbours by a forest of random-projection trees.

Each tree halves a bounded sample of the vectors by random hyperplanes at the
median, down to leaves; every vector is then routed to its leaf in each tree.
A query walks all trees through one shared priority queue, keyed by its margin
to the hyperplanes on the way: the most promising leaves of any tree come
first, until they hold VISIT * N**(2/3) vectors a tree. Only the pairs of a query
and a vector that meet in a visited leaf are candidates; each gets its exact
distance once, and nothing is computed for any other pair.

Queries travel, vectors stay: a block of queries, bounded by its bytes, is
broadcast with the leaves that each visits; each task joins it with its vectors
by (tree, leaf) and finds its best K for each query, and only these are shuffled.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import written

#: Neighbours, trees, sample vectors of a leaf, vectors and numbers that the trees are fitted on at most.
K, TREES, LEAF, SAMPLE, SAMPLE_VALUES = 10, 40, 16, 16_384, 8_000_000
#: Vectors that a query's leaves hold in each tree on average, as a multiple of N ** (2/3).
VISIT = 0.3
#: Bytes of a block of queries with their leaves; pairs that a task holds at once, and numbers of their vectors.
BLOCK_BYTES, PAIRS, VALUES = 32_000_000, 2_000_000, 4_000_000
EVERY = 100


@dataclass
class Forest:
    """normals[t, node], offsets[t, node] in heap order from 1, and held[t, leaf]: sample vectors in each leaf."""

    normals: np.ndarray
    offsets: np.ndarray
    held: np.ndarray

    @classmethod
    def fit(cls, sample: np.ndarray, trees: int = TREES, leaf: int = LEAF, seed: int = 5) -> Forest:
        """Trees as deep as the sample allows for leaves of `leaf` vectors: the depth grows with its logarithm."""
        rng = np.random.default_rng(seed)
        dims, leaves = sample.shape[1], 1 << max(1, round(math.log2(max(len(sample), 1) / leaf)) if len(sample) else 1)
        normals, offsets = np.zeros((trees, leaves, dims)), np.zeros((trees, leaves))
        held = np.zeros((trees, leaves), np.int64)
        for t in range(trees):
            groups = {1: np.arange(len(sample))}
            for node in range(1, leaves):
                rows = groups.pop(node)
                normal = rng.normal(size=dims)
                if len(rows) > 1:
                    a, b = sample[rows[rng.integers(len(rows))]], sample[rows[rng.integers(len(rows))]]
                    normal = a - b if np.any(a != b) else normal
                size = np.abs(normal).max()
                normals[t, node] = normal / size / np.linalg.norm(normal / size)
                along = sample[rows] @ normals[t, node]
                offsets[t, node] = np.median(along) if len(rows) else 0.0
                right = along > offsets[t, node]
                groups[2 * node], groups[2 * node + 1] = rows[~right], rows[right]
            for node, rows in groups.items():
                held[t, node - leaves] = len(rows)
        return cls(normals, offsets, held)

    def leaves_of(self, vectors: np.ndarray) -> np.ndarray:
        """Leaf of each vector in each tree, as tree * leaves + leaf; only the nodes on its way are looked at."""
        trees, leaves, dims = self.normals.shape
        found, step = np.empty((len(vectors), trees), np.int64), max(1, VALUES // dims)
        for start in range(0, len(vectors), step):
            part = vectors[start : start + step]
            for t in range(trees):
                node = np.ones(len(part), np.int64)
                for _ in range(leaves.bit_length() - 1):
                    along = np.einsum("ij,ij->i", part, self.normals[t, node])
                    node = 2 * node + (along > self.offsets[t, node])
                found[start : start + step, t] = t * leaves + node - leaves
        return found

    def visited(self, query: np.ndarray, share: float) -> list[int]:
        """Leaves, as tree * leaves + leaf, from one queue of all trees, the least margin first, until they hold the share of all."""
        trees, leaves, _ = self.normals.shape
        margins = (self.normals @ query - self.offsets).tolist()
        queue = [(0.0, t, 1) for t in range(trees)]
        budget, out = share * self.held.sum(), []
        while queue and budget > 0:
            miss, t, node = heapq.heappop(queue)
            own = margins[t]
            while node < leaves:
                margin = own[node]
                near = 2 * node + (margin > 0)
                heapq.heappush(queue, (max(miss, abs(margin)), t, near ^ 1))
                node = near
            out.append(t * leaves + node - leaves)
            budget -= self.held[t, node - leaves]
        return out


def share_for(rows: int, visit: float = VISIT) -> float:
    """The share of all vectors that a query's leaves hold in each tree on average."""
    return min(1.0, visit * max(rows, 1) ** (-1 / 3))


def usable(embeddings: DataFrame) -> DataFrame:
    """vec_id, v (array of doubles) of the rows that take part."""
    v = F.transform("embedding", lambda x: x.cast("double")).alias("v")
    fine = F.col("vec_id").isNotNull() & F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0), F.lit(False))
    return embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), v).where(fine)


def matrix(column: pa.Array) -> np.ndarray:
    return np.array(column.flatten()).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


@dataclass
class Block:
    """Queries, and which of them visits each leaf: askers of leaf keys[i] are asker[i], keys sorted."""

    forest: Forest
    ids: np.ndarray
    vectors: np.ndarray
    keys: np.ndarray
    asker: np.ndarray

    def pairs(self, leaf: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, row) of rows with these leaves that meet a query in one, each pair once; at most about PAIRS at a time."""
        first, last = np.searchsorted(self.keys, leaf), np.searchsorted(self.keys, leaf, side="right")
        count = last - first
        upto, start = np.cumsum(count.sum(1)), 0
        while start < len(leaf):
            done = upto[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(upto, done + PAIRS, side="right")))
            n, f = count[start:end].ravel(), first[start:end].ravel()
            at = np.repeat(f - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            row = np.repeat(np.repeat(np.arange(start, end), leaf.shape[1]), n)
            code = np.unique(self.asker[at].astype(np.int64) * len(leaf) + row)
            yield code // len(leaf), code % len(leaf)
            start = end


def best(query: np.ndarray, vec: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of each query's k best, nearest first, ties by id; a repeated id counts once, at its nearest."""
    order = np.lexsort((score, vec, query))
    new = np.ones(len(order), bool)
    new[1:] = (query[order[1:]] != query[order[:-1]]) | (vec[order[1:]] != vec[order[:-1]])
    order = order[new]
    order = order[np.lexsort((vec[order], score[order], query[order]))]
    q = query[order]
    start = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, np.int64)
    place = np.arange(len(q)) - np.repeat(start, np.diff(np.r_[start, len(q)]))
    return order[place < k]


def nearest(rows: DataFrame, block: Block, k: int) -> DataFrame:
    """Each task's best k of rows(vec_id, v) for each query of the block, by exact distances of candidates."""
    shared = rows.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = shared.value
        limit = np.full(len(b.ids), np.inf)
        query, vec, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        step = max(1, VALUES // max(1, b.vectors.shape[1]))
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, vectors = batch.column(0).to_numpy(), matrix(batch.column(1))
            for q, r in b.pairs(b.forest.leaves_of(vectors)):
                other = b.ids[q] != ids[r]
                q, r = q[other], r[other]
                dist = np.concatenate([np.zeros(0), *(np.sqrt(((b.vectors[q[i : i + step]] - vectors[r[i : i + step]]) ** 2).sum(1)) for i in range(0, len(q), step))])
                near = dist <= limit[q]
                query, vec, score = (np.concatenate(x) for x in ((query, q[near]), (vec, ids[r[near]]), (score, dist[near])))
                top = best(query, vec, score, k)
                query, vec, score = query[top], vec[top], score[top]
                full = np.bincount(query, minlength=len(limit)) >= k
                farthest = np.zeros(len(limit))
                np.maximum.at(farthest, query, score)
                limit = np.where(full, farthest, np.inf)
        yield pa.RecordBatch.from_pydict({"query_id": pa.array(b.ids[query], pa.int64()), "vec_id": pa.array(vec, pa.int64()), "score": pa.array(score, pa.float64())})

    return rows.mapInArrow(run, "query_id long, vec_id long, score double")


def search(embeddings: DataFrame, queries: DataFrame, k: int = K, visit: float = VISIT) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of embeddings(vec_id, embedding) for each of queries, the same columns.

    Rows with a null id, or a vector that is null, empty, zero or not finite,
    take no part, nor do vectors of another length than the most frequent one.
    A row isn't its own neighbour: rows of the query's id are left out. Of rows
    that repeat an id the nearest counts, and of repeated query ids the smallest
    vector asks. Ties go to the smaller vec_id. Of equal vectors only the k + 1
    smallest ids can ever be among the k nearest, so only these are searched:
    no leaf is larger for copies. Other columns don't matter; an empty table,
    or one without usable rows, gives no rows.
    """
    spark = embeddings.sparkSession
    rows, asks = usable(embeddings), usable(queries)
    shape = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if shape is None:
        return empty
    dims = shape["n"]
    copies = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    rows = written(rows.where(F.size("v") == dims).distinct().withColumn("copy", copies).where(F.col("copy") <= k + 1).drop("copy"), "vectors")
    total = rows.count()
    asks = asks.where(F.size("v") == dims).groupBy("vec_id").agg(F.min("v").alias("v"))
    place, most = F.pmod(F.xxhash64("vec_id"), F.lit(1_000_000)), max(2, min(SAMPLE, SAMPLE_VALUES // dims))
    some = rows.where(place < F.lit(max(1, round(1e6 * min(1.0, most / total))))).limit(2 * most).toArrow().sort_by("vec_id")
    if not some.num_rows:
        some = rows.limit(most).toArrow().sort_by("vec_id")
    forest = Forest.fit(matrix(some.column("v").combine_chunks()))
    shared, share = spark.sparkContext.broadcast(forest), share_for(total, visit)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                visits = [shared.value.visited(v, share) for v in matrix(batch.column(1))]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(visits, pa.list_(pa.int32()))], names=["vec_id", "v", "leaves"])

    walked = written(asks.mapInArrow(walk, "vec_id long, v array<double>, leaves array<int>"), "queries")
    size = walked.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("leaves")).alias("leaves")).first()
    blocks = -(-(size["n"] * (8 * dims + 8) + 8 * (size["leaves"] or 0)) // BLOCK_BYTES)
    parts = []
    for n in range(blocks):
        mine = walked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == n).toArrow().sort_by("vec_id")
        if mine.num_rows:
            leaves = mine.column("leaves").combine_chunks()
            keys = np.array(leaves.flatten())
            asker = np.repeat(np.arange(mine.num_rows), np.diff(leaves.offsets.to_numpy()))
            order = np.lexsort((asker, keys))
            block = Block(forest, mine.column("vec_id").to_numpy(), matrix(mine.column("v").combine_chunks()), keys[order].astype(np.int64), asker[order].astype(np.int32))
            parts.append(written(nearest(rows, block, k), f"block{n}"))
    if not parts:
        return empty
    found = parts[0]
    for part in parts[1:]:
        found = found.union(part)
    found = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns for every vec_id divisible by EVERY, against all other rows."""
    embeddings = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return search(embeddings, embeddings.where(F.col("vec_id") % EVERY == 0))
