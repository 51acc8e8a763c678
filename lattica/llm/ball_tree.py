"""Exact top-k search by inner product: a ball tree over shards and one in each shard, searched by branch and bound.

A node's bound is q.c + |q| r for its centre c and radius r.  A query opens nodes from the highest bound down and
stops at one below its current k-th score.

The upper levels of the tree are shared by all shards: they split a bounded sample at the median of a ball's widest
axis until there is a ball for each shard, and every row goes to the ball that its place in those splits says.  A ball
of more rows than a shard should have (many copies of one vector) is dealt over several shards.  A query goes through
the balls in rounds, first the one of its highest bound, then the ``SECOND`` next, then the others; before each round
only the balls whose bound reaches its current k-th score, over all that was searched so far, are kept.  So a query's
vector is sent only to shards that may hold one of its k best, and what one shard finds bounds the search in the next.

Components are floor(scale * x); scores are exact as long as they fit into 53 bits, beyond that they are computed
as 64-bit integers.  ``vectors`` says what is defined for nulls, ties, repeated rows, empty tables and lengths that
differ.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import settled
from lattica.llm.vectors import SHARD_ROWS, asked, matrix, ranked, sampled, shard_search, top, valid

LEAF_ROWS = 128
#: Rows that the upper levels are made from, at the most about; and the balls of the second round.
SAMPLE = 20_000
SECOND = 8


@dataclass
class BallTree:
    ids: np.ndarray
    rows: np.ndarray
    centre: np.ndarray
    radius: np.ndarray
    span: np.ndarray
    children: np.ndarray
    wide: bool


def build(ids: np.ndarray, rows: np.ndarray, leaf_rows: int = LEAF_ROWS) -> BallTree:
    """Halve each ball at the median of its widest axis; a ball of equal rows is a leaf of any size."""
    order = np.argsort(ids, kind="stable")
    centre, radius, span, children = [], [], [], []
    todo = [(0, len(ids), -1, 0)]
    while todo:
        a, b, parent, side = todo.pop()
        x = rows[order[a:b]]
        c = x.mean(axis=0)
        far = np.sqrt(((x - c) ** 2).sum(axis=1).max())
        node = len(centre)
        centre.append(c)
        radius.append(far)
        span.append((a, b))
        children.append([-1, -1])
        if parent >= 0:
            children[parent][side] = node
        if b - a > leaf_rows and far > 0:
            axis = int(x.var(axis=0).argmax())
            half = np.argpartition(x[:, axis], (b - a) // 2)
            order[a:b] = order[a:b][half]
            todo += [(a, a + (b - a) // 2, node, 0), (a + (b - a) // 2, b, node, 1)]
    largest = float(np.abs(rows).max(initial=0))
    return BallTree(ids[order], rows[order], np.array(centre), np.array(radius), np.array(span), np.array(children), largest * largest * rows.shape[1] >= 2.0**52)


def search(tree: BallTree, query_ids: np.ndarray, queries: np.ndarray, floors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query_id, vec_id, score) of each query's k best rows that aren't its own and reach its floor."""
    bounds = queries @ tree.centre.T
    bounds += np.sqrt((queries**2).sum(axis=1))[:, None] * tree.radius
    bounds += 1e-9 * np.abs(bounds) + 1e-6  # for rounding
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    wide = tree.wide or float(np.abs(queries).max(initial=0)) * float(np.abs(tree.rows).max(initial=0)) * queries.shape[1] >= 2.0**52
    for i, own in enumerate(query_ids):
        floor = -np.inf if np.isnan(floors[i]) else floors[i]
        ids, scores = np.zeros(0, np.int64), np.zeros(0, np.int64 if wide else float)
        heap = [(-bounds[i, 0], 0)]
        q = queries[i].astype(np.int64) if wide else queries[i]
        while heap and -heap[0][0] >= floor:
            _, node = heapq.heappop(heap)
            left, right = tree.children[node]
            if left >= 0:
                for child in (left, right):
                    if bounds[i, child] >= floor:
                        heapq.heappush(heap, (-bounds[i, child], child))
                continue
            a, b = tree.span[node]
            found = (tree.rows[a:b].astype(np.int64) if wide else tree.rows[a:b]) @ q
            near = np.flatnonzero((found >= floor) & (tree.ids[a:b] != own))
            if len(near):
                ids, scores = np.concatenate([ids, tree.ids[a:b][near]]), np.concatenate([scores, found[near]])
                best = top(ids, scores, k)
                ids, scores = ids[best], scores[best]
                if len(ids) == k:
                    floor = max(floor, scores[-1])
        out.append((np.full(len(ids), own), ids, scores.astype(np.int64)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3


@dataclass
class Balls:
    """The shared upper levels: splits by (axis, cut, children; a child below zero is ball ~child), centres, radii, and each ball's shards."""

    splits: list[tuple[int, float, int, int]]
    centre: np.ndarray
    radius: np.ndarray | None = None
    begin: np.ndarray | None = None  # the first shard of each ball, and the end

    def of(self, rows: np.ndarray) -> np.ndarray:
        """The ball of each row."""
        at = np.zeros(len(rows), np.int64) if self.splits else np.full(len(rows), -1)
        while (inner := np.flatnonzero(at >= 0)).size:
            axis, cut, low, high = (np.array([self.splits[i][k] for i in at[inner]]) for k in range(4))
            at[inner] = np.where(rows[inner, axis] < cut, low, high)
        return ~at

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        reach = queries @ self.centre.T + np.sqrt((queries**2).sum(axis=1))[:, None] * self.radius
        return reach + 1e-9 * np.abs(reach) + 1e-6  # for rounding


def upper_levels(sample: np.ndarray, balls: int) -> Balls:
    """Split the ball of the most rows of the sample, until there are ``balls`` or no ball has different rows."""
    splits: list[tuple[int, float, int, int]] = []
    leaves: list[tuple[np.ndarray, int, int]] = [(np.arange(len(sample)), -1, 0)]  # rows, the split above, which side
    done: list[tuple[np.ndarray, int, int]] = []
    while leaves and len(leaves) + len(done) < balls:
        leaves.sort(key=lambda x: len(x[0]))
        rows, above, side = leaves.pop()
        x = sample[rows]
        axis = int(x.var(axis=0).argmax()) if len(rows) else 0
        cut = float(np.median(x[:, axis])) if len(rows) else 0.0
        low = x[:, axis] < cut
        if not len(rows) or low.all() or not low.any():
            done.append((rows, above, side))
            continue
        here = len(splits)
        splits.append((axis, cut, 0, 0))
        if above >= 0:
            splits[above] = (*splits[above][: 2 + side], here, *splits[above][3 + side :])
        leaves += [(rows[low], here, 0), (rows[~low], here, 1)]
    centre = []
    for rows, above, side in [*leaves, *done]:
        if above >= 0:
            splits[above] = (*splits[above][: 2 + side], ~len(centre), *splits[above][3 + side :])
        centre.append(sample[rows].mean(axis=0) if len(rows) else np.zeros(sample.shape[1]))
    return Balls(splits, np.array(centre))


def dealt(vectors: DataFrame, balls: Balls, dim: int, shard_rows: int) -> DataFrame:
    """The rows with their shard; fills in the balls' radii and shards, by one row per ball."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("embedding"), dim)
            ball = balls.of(x)
            far = np.sqrt(((x - balls.centre[ball]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("embedding"), pa.array(ball, pa.int32()), pa.array(far, pa.float64())], ["vec_id", "embedding", "ball", "far"])

    placed = settled(vectors.mapInArrow(place, "vec_id long, embedding array<double>, ball int, far double"), "placed")
    n, radius = np.zeros(len(balls.centre), np.int64), np.zeros(len(balls.centre))
    for r in placed.groupBy("ball").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect():  # a row per ball
        n[r["ball"]], radius[r["ball"]] = r["n"], r["far"]
    balls.radius, balls.begin = radius, np.concatenate([[0], np.cumsum(-(-n // shard_rows))])
    begin = F.array(*[F.lit(int(x)) for x in balls.begin])
    own = F.element_at(begin, F.col("ball") + 1)
    size = F.element_at(begin, F.col("ball") + 2) - own
    return placed.select("vec_id", "embedding", (own + F.pmod(F.xxhash64("vec_id"), size)).cast("int").alias("shard"))


def visits(queries: DataFrame, balls: Balls, dim: int, first: int, last: int) -> DataFrame:
    """The queries (vec_id, embedding, kth) with ``shards``: of the balls from the ``first`` to before the ``last`` by bound, those that reach kth."""

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            reach = balls.bounds(matrix(batch.column("embedding"), dim))
            kth = batch.column("kth").to_numpy(zero_copy_only=False).astype(float)
            order = np.argsort(-reach, axis=1, kind="stable")[:, first:last]
            chosen = [[int(s) for b in o if np.isnan(f) or reach[i, b] >= f for s in range(balls.begin[b], balls.begin[b + 1])] for i, (o, f) in enumerate(zip(order, kth, strict=True))]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("embedding"), batch.column("kth"), pa.array(chosen, pa.list_(pa.int32()))], ["vec_id", "embedding", "kth", "shards"])

    return queries.mapInArrow(choose, "vec_id long, embedding array<double>, kth long, shards array<int>")


def exact_top_k(embeddings: DataFrame, every: int = 100, k: int = 10, scale: int = 1024, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """query_id, rank, vec_id and score of the k best for every row whose vec_id is divisible by ``every``."""
    vectors = valid(embeddings).withColumn("embedding", F.transform("embedding", lambda x: F.floor(x * scale).cast("double")))
    n, dim = vectors.agg(F.count("*"), F.coalesce(F.max(F.size("embedding")), F.lit(1))).first()
    balls = upper_levels(sampled(vectors, n, dim, SAMPLE), max(1, min(SAMPLE // 16, -(-n // shard_rows))))
    candidates = dealt(vectors, balls, dim, shard_rows)
    queries = asked(vectors, every).withColumn("kth", F.lit(None).cast("long"))

    def answer(tree: BallTree, ids: np.ndarray, rows: np.ndarray, floors: np.ndarray) -> tuple:
        return search(tree, ids, rows, floors, k)

    many = len(balls.centre)
    found = None
    for first, last in ((0, 1), (1, 1 + SECOND), (1 + SECOND, many)):
        if found is not None and first >= many:
            break
        going = visits(queries, balls, dim, first, last)
        more = shard_search(candidates, going, F.col("shards"), dim, build, answer, "long", F.col("kth"))
        if last >= many:
            return ranked(more if found is None else found.union(more), k)
        more = settled(more, "found")
        found = more if found is None else settled(ranked(found.union(more), k).drop("rank"), "found")
        kth = found.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("floor"))
        queries = settled(queries.drop("kth").join(kth, queries.vec_id == kth.query_id, "left").select("vec_id", "embedding", F.col("floor").alias("kth")), "queries")
    return ranked(found, k)
