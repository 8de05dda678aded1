"""Nearest neighbours by a hierarchical k-means tree and best-bin-first search.

The tree is fitted on a bounded sample; every row is indexed under the leaf that
greedy descent leads it to.  A query takes nodes from a priority queue, nearest
centre first, and so visits leaves in the order of promise.  How many leaves a query
visits is calibrated: for sampled queries the exact neighbours in all rows are known,
and visits are widened until the leaves visited hold the wanted share of them.
Distances are then computed exactly, in double precision, on the original vectors.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SAMPLE = 20_000
"""Vectors that the tree is fitted on at most: those with the smallest id hash."""

CALIBRATION = 200
"""Sampled vectors whose exact neighbours set the number of leaf visits."""

RECALL = 0.95
"""Share of true neighbours that calibration asks for."""

BRANCHES = 8
LEAVES = 256
"""Leaves of the tree, about: a leaf holds at most the sample's share of one, and 48 points at least."""

BLOCK = 4_096
"""Vectors of a leaf that one block holds; larger leaves are split."""


@dataclass
class Tree:
    """Nodes with centres; a node's children are ``first`` to ``first + n`` - 1, a leaf has none and a leaf number."""

    centres: np.ndarray
    first: np.ndarray
    n: np.ndarray
    leaf: np.ndarray

    @property
    def leaves(self) -> int:
        return int(self.leaf.max()) + 1


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, steps: int = 8) -> np.ndarray:
    """Cluster number of each row; clusters may be fewer than ``k``."""
    centres = x[rng.choice(len(x), k, replace=False)]
    near = np.zeros(len(x), np.int64)
    for _ in range(steps):
        near = ((x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1)).argmin(1)
        centres = np.stack([x[near == j].mean(0) if (near == j).any() else centres[j] for j in range(k)])
    return near


def build(x: np.ndarray, branches: int = BRANCHES, leaves: int = LEAVES, seed: int = 0) -> Tree:
    """A tree over the distinct rows of ``x`` (at least one)."""
    rng, x = np.random.default_rng(seed), np.unique(x, axis=0)
    leaf_points = max(48, -(-2 * len(x) // leaves))
    centres, first, n, members = [x.mean(0)], [0], [0], [np.arange(len(x))]
    at = 0
    while at < len(members):
        rows = members[at]
        if len(rows) > leaf_points:
            near = _kmeans(x[rows], branches, rng)
            parts = [rows[near == j] for j in np.unique(near)]
            if len(parts) > 1:
                first[at], n[at] = len(members), len(parts)
                for p in parts:
                    centres.append(x[p].mean(0))
                    first.append(0)
                    n.append(0)
                    members.append(p)
        at += 1
    counts = np.array(n)
    return Tree(np.array(centres), np.array(first), counts, np.where(counts == 0, np.cumsum(counts == 0) - 1, -1))


def descend(tree: Tree, x: np.ndarray) -> np.ndarray:
    """Leaf of each row by greedy descent."""
    node = np.zeros(len(x), np.int64)
    while True:
        inner = np.flatnonzero(tree.n[node])
        if not len(inner):
            return tree.leaf[node]
        order = inner[np.argsort(node[inner], kind="stable")]
        for rows in np.split(order, np.flatnonzero(np.diff(node[order])) + 1):
            at = node[rows[0]]
            c = tree.centres[tree.first[at]:tree.first[at] + tree.n[at]]
            node[rows] = tree.first[at] + ((c * c).sum(1) - 2 * x[rows] @ c.T).argmin(1)


def best_bins(tree: Tree, q: np.ndarray) -> Iterator[int]:
    """Leaves from the most promising on."""
    queue = [(0.0, 0)]
    while queue:
        _, at = heapq.heappop(queue)
        if not tree.n[at]:
            yield int(tree.leaf[at])
            continue
        a, b = tree.first[at], tree.first[at] + tree.n[at]
        d = ((tree.centres[a:b] - q) ** 2).sum(1)
        for i, x in enumerate(d.tolist()):
            heapq.heappush(queue, (x, int(a) + i))


def nearest(ids: np.ndarray, x: np.ndarray, q: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, distances) of the k rows nearest to ``q`` with distinct ids other than ``own``; ties to the smaller id."""
    d = np.sqrt(((x - q) ** 2).sum(1))
    other = ids != own
    ids, d = ids[other], d[other]
    if len(d) > 4 * k:
        # Repeated ids take places, so take more until enough distinct ones are found.
        take = 4 * k
        while take < len(d):
            edge = np.partition(d, take)[take]
            if len(np.unique(ids[d <= edge])) >= k:
                ids, d = ids[d <= edge], d[d <= edge]
                break
            take *= 4
    order = np.lexsort((ids, d))
    ids, d = ids[order], d[order]
    _, firsts = np.unique(ids, return_index=True)
    firsts = np.sort(firsts)[:k]
    return ids[firsts], d[firsts]


def usable(e: Column) -> Column:
    """Not null, not empty, all components finite, not all zero."""
    fine = F.forall(e, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    return F.coalesce(e.isNotNull() & (F.size(e) > 0) & fine & F.exists(e, lambda c: c != 0), F.lit(False))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)


def _exact_neighbours(vectors: DataFrame, dim: int, q_ids: np.ndarray, q: np.ndarray, tree: Tree, k: int) -> DataFrame:
    """Candidates (query, vec_id, score, leaf) from all rows, the k nearest of each partition."""
    def run(batches):
        best = [(np.zeros(0, np.int64), np.zeros((0, dim))) for _ in q_ids]
        for batch in batches:
            ids, x = batch.column(0).to_numpy(), _matrix(batch.column(1), dim)
            near = (x * x).sum(1)[:, None] - 2 * x @ q.T
            top = np.argpartition(near, min(k, len(ids) - 1), axis=0)[:k + 1]
            for i, own in enumerate(q_ids):
                pool_ids, pool = np.r_[best[i][0], ids[top[:, i]]], np.r_[best[i][1], x[top[:, i]]]
                kept, _ = nearest(pool_ids, pool, q[i], own, k)
                at = [np.flatnonzero(pool_ids == j)[0] for j in kept]
                best[i] = (pool_ids[at], pool[at])
        for i, (ids, x) in enumerate(best):
            if len(ids):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), i)), pa.array(ids), pa.array(np.sqrt(((x - q[i]) ** 2).sum(1))), pa.array(descend(tree, x))],
                                                 names=["query", "vec_id", "score", "leaf"])

    return vectors.mapInArrow(run, "query bigint, vec_id bigint, score double, leaf bigint")


def calibrated_visits(vectors: DataFrame, dim: int, q_ids: np.ndarray, q: np.ndarray, tree: Tree, k: int, recall: float) -> int:
    """Fewest leaf visits that reach ``recall`` on the calibration queries (at most ``CALIBRATION`` rows x k come back)."""
    w = Window.partitionBy("query").orderBy("score", "vec_id")
    found = _exact_neighbours(vectors, dim, q_ids, q, tree, k).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).collect()
    wanted: dict[int, list[int]] = {}
    for r in found:
        wanted.setdefault(r.query, []).append(r.leaf)
    reached = np.zeros(tree.leaves)
    for i, leaves in wanted.items():
        place = {leaf: n for n, leaf in enumerate(best_bins(tree, q[i]))}
        for leaf in leaves:
            reached[place[leaf]] += 1
    total = max(1, sum(map(len, wanted.values())))
    return int(np.searchsorted(np.cumsum(reached) / total, recall - 1e-12)) + 1


def search(table: DataFrame, queries: Column | None = None, k: int = 10, sample: int = SAMPLE, recall: float = RECALL) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query row.

    ``queries`` marks query rows (default: vec_id divisible by 100); candidates are
    all rows with another vec_id.  Vectors that are null, zero, or hold null or
    non-finite components take no part, nor do rows without vec_id or of another
    than the most frequent length.  Of repeated candidate ids the nearest counts; a
    repeated query id is searched with its smallest vector.  Without vectors there
    are no rows.
    """
    spark = table.sparkSession
    e = F.col("embedding")
    vectors = table.select(F.col("vec_id").cast("bigint").alias("vec_id"), e.cast("array<double>").alias("embedding")).filter(F.col("vec_id").isNotNull() & usable(e))
    sizes = vectors.groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    dim, total = sizes[0].dim, sizes[0]["count"]
    vectors = vectors.filter(F.size("embedding") == dim)
    share = min(1.0, 2 * sample / total)
    drawn = (vectors.filter(F.pmod(F.xxhash64("vec_id"), F.lit(1_000_000)) < int(share * 1_000_000) + 1)
             .orderBy(F.xxhash64("vec_id", "embedding"), "vec_id").limit(sample).toArrow().combine_chunks())
    s_ids, s = drawn.column(0).to_numpy(), _matrix(drawn.column(1).combine_chunks(), dim)
    tree = build(s)
    visits = calibrated_visits(vectors, dim, s_ids[:CALIBRATION], s[:CALIBRATION], tree, k, recall)

    def assign(batches):
        for batch in batches:
            leaf = descend(tree, _matrix(batch.column(1), dim)) if batch.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(leaf, pa.int64()), batch.column(0), batch.column(1)], names=["leaf", "id", "vector"])

    schema = "leaf bigint, id bigint, vector array<double>"
    index = vectors.mapInArrow(assign, schema)
    held = {r.leaf: r.n for r in index.groupBy("leaf").agg(F.count("*").alias("n")).collect()}
    blocks = np.array([-(-held.get(i, 0) // BLOCK) for i in range(tree.leaves)])

    def visit(batches):
        for batch in batches:
            rows, leaves, salts = [], [], []
            for i, q in enumerate(_matrix(batch.column(1), dim)):
                seen, inside = 0, 0
                for leaf in best_bins(tree, q):
                    if seen >= visits and inside > k:  # fewer rows than wanted: widen on
                        break
                    seen, inside = seen + 1, inside + held.get(leaf, 0)
                    rows += [i] * int(blocks[leaf])
                    leaves += [leaf] * int(blocks[leaf])
                    salts += range(int(blocks[leaf]))
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(leaves, pa.int64()), pa.array(salts, pa.int64()), batch.column(0).take(at), batch.column(1).take(at)], names=["leaf", "salt", "id", "vector"])

    asked = vectors.filter(F.col("vec_id") % 100 == 0 if queries is None else queries).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    probes = asked.mapInArrow(visit, "leaf bigint, salt bigint, id bigint, vector array<double>")
    n_blocks = F.element_at(F.lit(blocks.tolist() or [1]).cast("array<bigint>"), (F.col("leaf") + 1).cast("int"))
    placed = index.withColumn("salt", F.pmod(F.xxhash64("id"), n_blocks))

    def compare(batches):
        key, ids, x = None, [], []
        for batch in batches:
            columns = [batch.column(i).to_numpy() for i in range(4)]
            rows = _matrix(batch.column(4), dim)
            change = np.flatnonzero((np.diff(columns[0]) != 0) | (np.diff(columns[1]) != 0) | (np.diff(columns[2]) != 0)) + 1
            out = ([], [], [])
            for a, b in zip([0, *change], [*change, batch.num_rows]):
                if (columns[0][a], columns[1][a]) != key:
                    key, ids, x = (columns[0][a], columns[1][a]), [], []
                if columns[2][a] == 0:
                    ids.append(columns[3][a:b])
                    x.append(rows[a:b])
                elif ids:
                    ids, x = [np.concatenate(ids)], [np.concatenate(x)]
                    for own, q in zip(columns[3][a:b], rows[a:b]):
                        near, d = nearest(ids[0], x[0], q, own, k)
                        out[0].append(np.full(len(near), own))
                        out[1].append(near)
                        out[2].append(d)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], names=["query_id", "vec_id", "score"])

    columns = ["leaf", "salt", "kind", "id", "vector"]
    both = (placed.withColumn("kind", F.lit(0)).select(*columns).unionByName(probes.withColumn("kind", F.lit(1)).select(*columns))
            .repartition("leaf", "salt").sortWithinPartitions("leaf", "salt", "kind", "id"))
    found = both.mapInArrow(compare, "query_id bigint, vec_id bigint, score double").groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def exact_search(table: DataFrame, queries: DataFrame, k: int = 10) -> list[tuple[int, int]]:
    """(query, neighbour) pairs by brute force on the driver; for tests and recall figures on small tables."""
    rows = table.select("vec_id", "embedding").filter(usable(F.col("embedding"))).collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    return [(r.vec_id, int(i)) for r in queries.filter(usable(F.col("embedding"))).collect()
            for i in nearest(ids, x, np.array(r.embedding, float), r.vec_id, k)[0]]
