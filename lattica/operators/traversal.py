"""Vertices within a number of hops of start vertices, start vertices included, each once.

Two physical forms give the same rows:

* ``unrolled``: one lazy plan with an inner join per hop, from the distinct vertices that the hop before came to.
  Either side of an inner join may be the small one, so a small frontier is broadcast and the edges stay where they
  are.  The levels are united as the side of a semi-join with the vertices; a level that several need is computed once
  (a reused exchange), and nothing runs until the caller asks.
* ``frontier``: a loop that expands only newly found vertices, drops those visited by an anti-join, writes each
  level to the shared folder (which cuts the lineage and survives lost executors) and ends when a level is empty.

Few hops favour the first; many hops over a graph of small diameter the second.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.operators.predicates import condition, filtered
from lattica.operators.relational import projected
from lattica.sources.store import settled

#: Hops up to which a traversal is one lazy plan if no strategy is asked for.
LAZY_HOPS = 4


@dataclass(frozen=True)
class Graph:
    """Vertices (id and attributes) and edges (src, dst, perhaps relationship)."""

    vertices: DataFrame
    edges: DataFrame

    @staticmethod
    def of(vertices: DataFrame, edges: DataFrame, default_label: str | None = None) -> Graph:
        """Tables in any of the usual spellings: ``id`` or the first column; ``src``/``dst`` or ``source``/``target``."""
        if "id" not in vertices.columns:
            vertices = vertices.withColumnRenamed(vertices.columns[0], "id")
        if {"source", "target"} <= set(edges.columns):
            edges = edges.withColumnsRenamed({"source": "src", "target": "dst"})
        if not {"src", "dst"} <= set(edges.columns):
            raise ValueError(f"edges need src and dst, or source and target, not {edges.columns}")
        if default_label is not None and "relationship" not in edges.columns:
            edges = edges.withColumn("relationship", F.lit(default_label))
        return Graph(vertices, edges)


def directed(edges: DataFrame, direction: str, label: str | None) -> DataFrame:
    """(src, dst) along which a hop goes; the label counts where edges have one."""
    if label and "relationship" in edges.columns:
        edges = edges.where(F.col("relationship") == label)
    if direction not in ("OUT", "IN", "BOTH"):
        raise ValueError(f"unknown direction '{direction}'")
    if direction == "BOTH":  # both ways from one read of the edges
        ways = F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))
        return edges.select(F.explode(ways).alias("way")).select("way.src", "way.dst")
    return edges.select("src", "dst") if direction == "OUT" else edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def unrolled(start: DataFrame, hops: DataFrame, max_hops: int) -> DataFrame:
    """Ids reached, perhaps several times: only a level that another hop goes on from is worth a distinct."""
    level = reached = start
    for hop in range(max_hops):
        level = level.join(hops, F.col("id") == F.col("src")).select(F.col("dst").alias("id"))
        if hop + 1 < max_hops:
            level = level.distinct()
        reached = reached.union(level)
    return reached


def frontier(start: DataFrame, hops: DataFrame, max_hops: int) -> DataFrame:
    level = settled(start.distinct(), "frontier")
    visited, hops = level, hops.persist()
    for _ in range(max_hops):
        found = level.join(hops, level.id == hops.src).select(F.col("dst").alias("id")).distinct()
        level = settled(found.join(visited, "id", "left_anti"), "frontier")
        if level.isEmpty():
            break
        visited = visited.union(level)
    hops.unpersist()
    return visited


def starts(graph: Graph, chosen: dict | None) -> DataFrame:
    """Ids of the vertices that the start filter takes (any comparison; without a filter, all)."""
    if not chosen:
        return graph.vertices.select("id")
    if chosen["column"] not in graph.vertices.columns:
        raise ValueError(f"no vertex column '{chosen['column']}' among {graph.vertices.columns}")
    predicate = {"operator": "IN" if isinstance(chosen["value"], list) else "="} | chosen
    return graph.vertices.where(condition(graph.vertices, predicate)).select("id")


def traversed(graph: Graph, spec: dict, strategy: str | None = None) -> DataFrame:
    """Run a traversal; ``strategy`` is "SQL" (unrolled), "GRAPH" (frontier) or None to go by the number of hops."""
    hops = directed(graph.edges, spec["direction"], spec.get("edge_label"))
    run = unrolled if strategy == "SQL" or strategy is None and spec["max_hops"] <= LAZY_HOPS else frontier
    found = run(starts(graph, spec.get("start_vertex_filter")), hops, spec["max_hops"])
    reached = graph.vertices.join(found, "id", "left_semi")
    if ending := spec.get("end_vertex_filter"):
        reached = filtered(reached, {"operator": "="} | ending)
    fields = spec.get("return_fields") or []
    there = [f for f in fields if f in reached.columns]
    kept = projected(reached, there or (["id"] if fields else reached.columns)).distinct()
    if ending := spec.get("destination_filter"):
        kept = filtered(kept, {"operator": "="} | ending)
    return kept
