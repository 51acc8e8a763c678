"""Approximate nearest neighbours by inner product: multi-index hashing of learned rotated binary codes.

Vectors are scaled by the largest norm and given one more component that makes all norms equal, so that the largest
inner product is the smallest angle.  Codes are the signs after rotations learned by iterative quantisation on a
bounded sample; every row is indexed.  A code of 256 bits is split into 32 substrings with an index each.  Two codes
within a Hamming radius r differ in at most r // 32 bits in some substring (one bit fewer in all but the first
r % 32 + 1, by the pigeonhole principle), so probing those values of each index retrieves every code within the
radius; the candidates that are within it are ranked by their inner products in double precision.

The radius is the smallest that finds ``AIM`` of the true neighbours on the sample; neighbours in all rows are
nearer than those, so it errs on the side of recall.  Where a shard holds fewer than k codes within the radius it is
widened until there are k, or all rows.  Zero vectors take no part; for the rest see ``vectors``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.vectors import SHARD_ROWS, asked, ranked, sampled, shard_search, top, valid

BITS, PARTS = 256, 32
#: Bound on the rows that rotations and radius are learned from, and on the queries among them.
SAMPLE, SAMPLE_QUERIES = 12_000, 300
AIM = 0.97
ROUNDS = 20
#: The 8-bit masks by the number of bits set.
MASKS = [np.array([m for m in range(256) if m.bit_count() <= t], np.uint8) for t in range(9)]


@dataclass
class Codes:
    rotation: np.ndarray
    norm: float
    radius: int = 0

    def of(self, rows: np.ndarray, is_query: bool) -> np.ndarray:
        """(rows, PARTS) bytes."""
        scaled = rows / (np.sqrt((rows**2).sum(axis=1, keepdims=True)) if is_query else self.norm)
        last = np.zeros(len(rows)) if is_query else np.sqrt(np.maximum(0, 1 - (scaled**2).sum(axis=1)))
        return np.packbits(np.column_stack([scaled, last]) @ self.rotation > 0, axis=1)


def distances(codes: np.ndarray, query: np.ndarray) -> np.ndarray:
    return np.bitwise_count(codes.view(np.uint64) ^ query.view(np.uint64)).sum(axis=1)


def learn(sample: np.ndarray, norm: float, k: int, aim: float = AIM) -> Codes:
    """Rotations by iterative quantisation, from several random starts until there are BITS columns; then the radius."""
    random = np.random.default_rng(17)
    scaled = sample / norm
    x = np.column_stack([scaled, np.sqrt(np.maximum(0, 1 - (scaled**2).sum(axis=1)))])
    d, columns = x.shape[1], []
    while sum(c.shape[1] for c in columns) < BITS:
        r = np.linalg.qr(random.normal(size=(d, d)))[0]
        for _ in range(ROUNDS if len(x) else 0):
            u, _, vt = np.linalg.svd(x.T @ np.sign(x @ r))
            r = u @ vt
        columns.append(r)
    codes = Codes(np.concatenate(columns, axis=1)[:, :BITS], norm, BITS)
    distinct = np.unique(sample, axis=0)
    asking = distinct[random.permutation(len(distinct))[:SAMPLE_QUERIES]]
    if len(sample) > k:
        theirs, mine, need = codes.of(sample, False), codes.of(asking, True), []
        for q, code in zip(asking, mine, strict=True):
            near = top(np.arange(len(sample)), sample @ q, k + 1)
            need.append(distances(theirs[near], code))
        hits = np.bincount(np.concatenate(need), minlength=BITS + 1).cumsum()
        codes.radius = int(np.searchsorted(hits, aim * hits[-1]))
    return codes


@dataclass
class Index:
    ids: np.ndarray
    rows: np.ndarray
    codes: np.ndarray
    order: np.ndarray  # per substring, rows by its value
    starts: np.ndarray  # per substring, where each value begins

    def __post_init__(self) -> None:
        self.by_part = np.ascontiguousarray(self.codes.T)


def probed(index: Index, code: np.ndarray, radius: int) -> np.ndarray:
    """Rows whose codes are within ``radius``, by probing every substring's index."""
    seen = np.zeros(len(index.ids), bool)
    whole, more = divmod(radius, PARTS)
    for part in range(PARTS):
        bits = whole - (part > more)
        if bits < 0:
            continue
        if bits >= 8:
            seen[:] = True
            break
        values = MASKS[bits] ^ code[part]
        if len(values) > 16:  # the value's entry of each row says as much as so many lists of rows, and sooner
            wanted = np.zeros(256, bool)
            wanted[values] = True
            seen |= np.take(wanted, index.by_part[part])
            continue
        begin, end = index.starts[part, values], index.starts[part, values.astype(int) + 1]
        size = end - begin
        if size.sum():
            at = np.repeat(begin - np.cumsum(size) + size, size) + np.arange(size.sum())
            seen[index.order[part, at]] = True
    near = np.flatnonzero(seen)
    return near[distances(index.codes[near], code) <= radius]


def approximate_top_k(embeddings: DataFrame, every: int = 20, k: int = 20, shard_rows: int = SHARD_ROWS, sample_rows: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest found for every row whose vec_id is divisible by ``every``."""
    vectors = valid(embeddings).where(F.exists("embedding", lambda x: x != 0))
    squares = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)
    n, dim, norm = vectors.agg(F.count("*"), F.coalesce(F.max(F.size("embedding")), F.lit(1)), F.sqrt(F.max(squares))).first()
    sample = sampled(vectors, n, dim, sample_rows)
    learned = learn(sample, float(norm or 1.0) * (1 + 1e-12), k)
    held = embeddings.sparkSession.sparkContext.broadcast(learned)
    shards = max(1, -(-n // shard_rows))
    candidates = vectors.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int"))

    def build(ids: np.ndarray, rows: np.ndarray) -> Index:
        order = np.argsort(ids, kind="stable")
        ids, rows = ids[order], rows[order]
        codes = held.value.of(rows, False)
        by = np.argsort(codes, axis=0, kind="stable").T
        starts = np.stack([np.searchsorted(codes[by[p], p], np.arange(257)) for p in range(PARTS)])
        return Index(ids, rows, codes, by, starts)

    def answer(index: Index, query_ids: np.ndarray, queries: np.ndarray, _: np.ndarray) -> tuple:
        out = []
        for own, q, code in zip(query_ids, queries, held.value.of(queries, True), strict=True):
            radius = held.value.radius
            near = probed(index, code, radius)
            while len(near) < min(k + 1, len(index.ids)):
                radius = min(BITS, radius + 8)
                near = probed(index, code, radius)
            near = near[index.ids[near] != own]
            scores = (index.rows[near] * q).sum(axis=1)
            best = top(index.ids[near], scores, k)
            out.append((np.full(len(best), own), index.ids[near][best], scores[best]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))

    return ranked(shard_search(candidates, asked(vectors, every), F.sequence(F.lit(0), F.lit(shards - 1)), dim, build, answer, "double"), k)
