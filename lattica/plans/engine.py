"""Folding a query's operations into one Spark plan."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from lattica.dsl.nodes import Node, Query, parse, parse_file
from lattica.operators.predicates import filtered
from lattica.operators.relational import aggregated, joined, projected
from lattica.operators.traversal import LAZY_HOPS, Graph, traversed
from lattica.plans.decompose import SubExpression, decompose
from lattica.sources.tables import Tables

#: A policy says for a sub-expression with a traversal whether it runs as "SQL" or as "GRAPH".
Policy = Callable[[SubExpression], str]


@dataclass
class Result:
    """A query's lazy DataFrame and what was decided on the way."""

    query_id: str
    data: DataFrame | None
    decisions: dict[str, str] = field(default_factory=dict)
    build_ms: float = 0.0
    error: str | None = None
    parse_ms: float = 0.0
    decompose_ms: float = 0.0
    sub_ms: dict[str, float] = field(default_factory=dict)


class Engine:
    """Queries over named tables and graphs.

    Every operation finds its inputs by name: an earlier operation of the query, else a table or graph.  Only the last
    operation projects its ``fields``; Catalyst prunes the columns that nothing needs.
    """

    def __init__(self, spark: SparkSession, tables: Tables, policy: Policy | None = None, force: str | None = None, strict: bool = True):
        self.spark, self.tables, self.policy, self.force, self.strict = spark, tables, policy, force, strict

    def _input(self, name: str, done: dict[str, DataFrame]) -> DataFrame:
        return done[name] if name in done else self.tables.table(name)

    def _operation(self, node: Node, done: dict[str, DataFrame], strategy: str | None) -> DataFrame:
        if node.op_type == "TRAVERSAL":
            return traversed(self.tables.graph(node.source), node.traversal, strategy)
        df = self._input(node.source, done)
        if node.op_type == "FILTER":
            return filtered(df, node.predicate, self.strict)
        if node.op_type == "MAP":
            return projected(df, node.fields)
        if node.op_type == "JOIN":
            j = node.join
            return joined(df, self._input(j["right_source"], done), j["left_key"], j["right_key"], j["join_type"])
        return aggregated(df, node.aggregate["group_by"], node.aggregate["functions"])

    def _decided(self, subs: list[SubExpression]) -> list[str]:
        if self.force:
            return [self.force] * len(subs)
        if self.policy is not None:
            batch = getattr(self.policy, "batch", None)  # a model judges all of a query's sub-expressions at once
            return batch(subs) if batch else [self.policy(s) for s in subs]
        deep = [s.primary == "TRAVERSAL" and any(n.traversal and n.traversal["max_hops"] > LAZY_HOPS for n in s.nodes) for s in subs]
        return ["GRAPH" if d else "SQL" for d in deep]

    def build(self, query: Query | dict) -> Result:
        began = time.perf_counter()
        query = query if isinstance(query, Query) else parse(query)
        parsed = time.perf_counter()
        subs = decompose(query.nodes)
        decomposed = time.perf_counter()
        decisions = dict(zip((s.sub_id for s in subs), self._decided(subs), strict=True))
        sub_of = {n.op_id: s.sub_id for s in subs for n in s.nodes}
        done: dict[str, DataFrame] = {}
        spent: dict[str, float] = dict.fromkeys(decisions, 0.0)
        leaf = query.leaf
        for node in query.nodes:
            at, sub = time.perf_counter(), sub_of[node.op_id]
            done[node.op_id] = self._operation(node, done, decisions[sub])
            spent[sub] += (time.perf_counter() - at) * 1000
        data = done[leaf.op_id]
        if leaf.op_type not in ("AGGREGATE", "TRAVERSAL"):
            data = projected(data, leaf.fields)
        return Result(query.query_id, data, decisions, (time.perf_counter() - began) * 1000, None, (parsed - began) * 1000, (decomposed - parsed) * 1000, spent)

    def run(self, query: Query | dict) -> DataFrame:
        return self.build(query).data

    def run_file(self, path: str) -> dict[str, Result]:
        return {r.query_id: r for r in self.run_batch(parse_file(path).values())}

    def run_batch(self, queries: Iterable[Query | dict]) -> list[Result]:
        """Build every query; an error is kept in its result and doesn't stop the others."""
        out = []
        for q in queries:
            try:
                out.append(self.build(q))
            except Exception as error:  # noqa: BLE001  whatever a query does wrong belongs to its own result
                out.append(Result(q.query_id if isinstance(q, Query) else str(q.get("query_id")), None, error=f"{type(error).__name__}: {error}"))
        return out


def metadata(spark: SparkSession, results: Iterable[Result]) -> DataFrame:
    """(query_id, sub_id, engine, sub_ms, build_ms, parse_ms, decompose_ms, error), a row per decision or failed query."""
    rows = [(r.query_id, s, e, r.sub_ms.get(s), r.build_ms, r.parse_ms, r.decompose_ms, r.error) for r in results for s, e in (r.decisions or {None: None}).items()]
    return spark.createDataFrame(rows, "query_id string, sub_id string, engine string, sub_ms double, build_ms double, parse_ms double, decompose_ms double, error string")


__all__ = ["Engine", "Graph", "Result", "metadata"]
