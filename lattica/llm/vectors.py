"""What both vector searches share: valid vectors, shards, and queries streamed past each shard.

Candidates are dealt into shards of about ``SHARD_ROWS``, as the search says.  A query visits the shards that the search
says, in batches: a shard's rows are in memory, the queries stream past them.  Each shard answers with its k best, and a window over those keeps the k best of all.

Vectors that are null, empty or hold a null or a component that isn't finite take no part.  Vectors of different
lengths count as padded with zeros.  Rows of one vec_id are candidates each by itself, are no candidates of the
query of that id, and ask once (the least of their vectors).  A null vec_id takes no part.  Ties go to the smaller
vec_id.  An empty table, or one without a query, gives an empty result; without other rows a query has none.  Columns
other than vec_id and embedding are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.llm.common import partitions

SHARD_ROWS = 1 << 14


def finite(vector: str) -> Column:
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.col("vec_id").isNotNull() & F.col(vector).isNotNull() & (F.size(vector) > 0) & whole


def valid(embeddings: DataFrame) -> DataFrame:
    chosen = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return chosen.where(finite("embedding"))


def asked(vectors: DataFrame, every: int) -> DataFrame:
    return vectors.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


def sampled(vectors: DataFrame, n: int, dim: int, most: int) -> np.ndarray:
    """About ``most`` of the rows at the most, chosen by the hash of vec_id, in a fixed order."""
    share = min(1.0, most / max(1, n))
    chosen = vectors.where(F.pmod(F.xxhash64(F.lit("sample"), "vec_id"), F.lit(1 << 40)) < int(share * (1 << 40))) if share < 1 else vectors
    rows = chosen.orderBy("vec_id", "embedding").select("embedding").toPandas()["embedding"].tolist()
    return np.array([np.pad(np.asarray(r, float), (0, dim - len(r))) for r in rows]).reshape(-1, dim)


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """List column to rows of ``dim`` doubles, padded with zeros or as long as they are."""
    offsets = np.asarray(column.offsets)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    sizes = np.diff(offsets)
    if len(sizes) and (sizes == dim).all():
        return flat.reshape(-1, dim)
    out = np.zeros((len(sizes), max(dim, int(sizes.max(initial=0)))))
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out[:, :dim]


def shard_search(candidates: DataFrame, queries: DataFrame, shards: Column, dim: int, build: Callable, answer: Callable, score: str, bound: Column | None = None) -> DataFrame:
    """(query_id, vec_id, score): ``answer(build(ids, rows), ids, rows, bounds)`` for each shard and batch of queries.

    ``candidates`` has a shard column; ``shards`` is the array of shards that a query visits.
    """
    none = F.lit(None).cast("double")
    rows = candidates.select("shard", F.lit(0).alias("role"), "vec_id", "embedding", none.alias("bound")).union(
        queries.select(F.explode(shards).alias("shard"), F.lit(1), "vec_id", "embedding", none if bound is None else bound.cast("double"))
    )
    kind = pa.int64() if score == "long" else pa.float64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, held, index = None, [], [], None
        for batch in batches:
            shard, role = batch.column("shard").to_numpy(), batch.column("role").to_numpy()
            vec, x = batch.column("vec_id").to_numpy(), matrix(batch.column("embedding"), dim)
            bounds = batch.column("bound").to_numpy(zero_copy_only=False).astype(float)
            edges = np.flatnonzero(np.concatenate([[True], (np.diff(shard) != 0) | (np.diff(role) != 0), [True]])) if len(shard) else [0]
            for a, b in zip(edges, edges[1:], strict=False):
                if shard[a] != at:
                    at, ids, held, index = shard[a], [], [], None
                if role[a] == 0:
                    ids.append(vec[a:b])
                    held.append(x[a:b])
                    continue
                if index is None and ids:
                    index = build(np.concatenate(ids), np.concatenate(held))
                    ids, held = [], []
                if index is not None:
                    q, v, s = answer(index, vec[a:b], x[a:b], bounds[a:b])
                    yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(v, pa.int64()), pa.array(s, kind)], ["query_id", "vec_id", "score"])

    dealt = rows.repartition(partitions(candidates.sparkSession), "shard").sortWithinPartitions("shard", "role")
    return dealt.mapInArrow(run, f"query_id long, vec_id long, score {score}")


def ranked(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k best: highest score, then smallest id."""
    if len(scores) > 4 * k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= edge)
        return near[np.lexsort((ids[near], -scores[near]))[:k]]
    return np.lexsort((ids, -scores))[:k]
