"""Connected components of an edge table by contraction, without bringing edges or labels to the driver."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import settled

#: So many edges at the most are finished by one task, in about 100 bytes each.
FINISH = 1 << 18


def components(edges: DataFrame, finish: int = FINISH) -> DataFrame:
    """(id, label) of every id that an edge (a, b) touches; label is the smallest id of its component.

    In each round every vertex goes to the first of itself and its neighbours in an order drawn anew by hash, three
    such steps are followed at once, and what has come together is one vertex from then on.  In a random order steps
    down end after a few, so even a path in the order of its ids, or a chain of drifting versions, shrinks by a
    constant factor a round: rounds grow with the logarithm of the number of vertices.  When at most ``finish`` edges
    are left, one task joins them.  A round's tables are written to the shared folder, so a lost executor costs no
    earlier round.  Edges with a null end don't count; no edges give no rows.
    """
    first = edges.select("a", "b").where("a is not null and b is not null")
    edges = first = settled(first.distinct(), "edges")
    moves: list[DataFrame] = []
    left = all_edges = edges.count()
    while left > finish:
        far = settled(steps(edges, len(moves)), "steps", 2 * left)
        moves.append(far)
        moved = edges.join(far.withColumnsRenamed({"v": "va", "to": "ta"}), F.col("a") == F.col("va")).join(far.withColumnsRenamed({"v": "vb", "to": "tb"}), F.col("b") == F.col("vb"))
        edges = settled(moved.select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).where("a <> b").distinct(), "edges", left)
        left = edges.count()
    if left:
        moves.append(settled(edges.coalesce(1).mapInArrow(joined, "v long, to long"), "steps"))
    labels = first.select(F.col("a").alias("id")).union(first.select("b")).distinct().withColumn("label", F.col("id"))
    for far in moves:  # each with fewer vertices than the one before
        labels = labels.join(far, labels.label == far.v, "left").select("id", F.coalesce("to", "label").alias("label"))
    labels = settled(labels, "labels", 2 * all_edges)
    least = labels.groupBy("label").agg(F.min("id").alias("least"))
    return labels.join(least, "label").select("id", F.col("least").alias("label"))


def steps(edges: DataFrame, turn: int) -> DataFrame:
    """(v, to): where each vertex of the edges goes in this round."""

    def drawn(c: str) -> Column:
        return F.struct(F.xxhash64(F.lit(turn), c).alias("h"), F.col(c).alias("to"))

    both = edges.union(edges.select("b", "a"))
    step = both.groupBy("a").agg(F.min(drawn("b")).alias("other")).select(F.col("a").alias("v"), F.least("other", drawn("a"))["to"].alias("to"))
    far = step
    for _ in range(2):
        on = step.withColumnsRenamed({"v": "w", "to": "next"})
        far = far.join(on, F.col("to") == F.col("w")).select("v", F.col("next").alias("to"))
    return far


def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(v, to) of a bounded number of edges, by union and find; to is the smallest vertex."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = root[up]
            x = up
        return x

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    ends = list(root)
    if ends:
        yield pa.RecordBatch.from_arrays([pa.array(ends, pa.int64()), pa.array([find(x) for x in ends], pa.int64())], ["v", "to"])
