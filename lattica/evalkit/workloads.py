"""Generated query documents: variants of one query, and workloads over a dataset."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, replace
from itertools import product

#: Where a variant may differ: a traversal's depth, a join's type, the share of rows that range filters keep.
AXES: dict[str, tuple] = {"hops": (1, 2, 3, 4), "join": ("INNER", "LEFT"), "kept": (0.01, 0.05, 0.10, 0.25, 0.50)}
#: Gives the smallest and the largest value of a table's column, if known.
Extent = Callable[[str, str], tuple[float, float] | None]


def _bound(predicate: dict, source: str, share: float, extent: Extent) -> float | None:
    """The literal by which a range comparison keeps about ``share`` of evenly spread values."""
    known = extent(source, predicate["column"]) if predicate.get("operator", "=")[0] in "<>" else None
    if known is None:
        return None
    low, high = known
    return high - share * (high - low) if predicate["operator"][0] == ">" else low + share * (high - low)


def _changed(operation: dict, point: dict, extent: Extent) -> dict:
    """The operation at a point of the axes."""
    if operation["type"] == "TRAVERSAL" and "hops" in point:
        return operation | {"traversal": operation["traversal"] | {"max_hops": point["hops"]}}
    if operation["type"] == "JOIN" and "join" in point:
        return operation | {"join": operation["join"] | {"join_type": point["join"]}}
    if operation["type"] == "FILTER" and "kept" in point and operation.get("predicate"):
        value = _bound(operation["predicate"], operation["source"], point["kept"], extent)
        return operation if value is None else operation | {"predicate": operation["predicate"] | {"value": value}}
    return operation


def variants(query: dict, axes: dict[str, Sequence] | None = None, extent: Extent = lambda table, column: None) -> list[dict]:
    """The query at every point of the axes on which it differs, named by the point (``q~hops=2~join=LEFT``)."""
    axes = AXES if axes is None else axes
    free = [a for a in axes if any(_changed(op, {a: v}, extent) != op for op in query["operations"] for v in axes[a])]
    out = []
    for values in product(*(axes[a] for a in free)):
        point = dict(zip(free, values, strict=True))
        name = "~".join([query["query_id"], *(f"{a}={v}" for a, v in point.items())])
        out.append(query | {"query_id": name, "operations": [_changed(op, point, extent) for op in query["operations"]]})
    return out


@dataclass(frozen=True)
class TableSpec:
    """A table's key, a numeric column and a column to group by; ``parent`` is (table, its key, own foreign key)."""

    name: str
    key: str
    number: str
    group: str
    parent: tuple[str, str, str] | None = None


@dataclass(frozen=True)
class GraphSpec:
    name: str
    label: str
    column: str
    starts: tuple
    attach: tuple[str, str, str] | None = None  # table, its key, a column of it to count


def _op(op_id: str, kind: str, source: str, fields: Sequence[str], needs: Sequence[str] = (), **part: dict) -> dict:
    return {"op_id": op_id, "type": kind, "source": source, "fields": list(fields), "depends_on": list(needs)} | part


def relational_workload(prefix: str, tables: Sequence[TableSpec], literals: Sequence[float] = (10, 100, 1000)) -> Iterator[dict]:
    """Per table: filters, aggregates, filter then aggregate, and a join with its parent."""
    for t in tables:
        for x in literals:
            keep = _op("s1", "FILTER", t.name, (t.key, t.number), predicate={"column": t.number, "operator": ">", "value": x})
            grouped = {"group_by": [t.group], "functions": [{"func": "SUM", "column": t.number}]}
            yield {"query_id": f"{prefix}_{t.name}_filter_{x}", "operations": [keep]}
            yield {"query_id": f"{prefix}_{t.name}_filter_agg_{x}", "operations": [keep, _op("s2", "AGGREGATE", "s1", (t.group,), ("s1",), aggregate=grouped)]}
        counted = {"group_by": [t.group], "functions": [{"func": "COUNT", "column": t.key}, {"func": "AVG", "column": t.number}]}
        yield {"query_id": f"{prefix}_{t.name}_agg", "operations": [_op("s1", "AGGREGATE", t.name, (t.group,), aggregate=counted)]}
        if t.parent:
            name, key, foreign = t.parent
            for kind in ("INNER", "LEFT"):
                link = {"right_source": name, "left_key": foreign, "right_key": key, "join_type": kind}
                yield {"query_id": f"{prefix}_{t.name}_join_{name}_{kind.lower()}", "operations": [_op("s1", "JOIN", t.name, (t.key, foreign, t.number), join=link)]}


def graph_workload(prefix: str, graph: GraphSpec, hops: Sequence[int] = (1, 2, 3), directions: Sequence[str] = ("OUT", "BOTH")) -> Iterator[dict]:
    """Per start, direction and depth: a traversal, its count, and its join with the attached table's counts."""
    for start in graph.starts:
        for d in directions:
            for h in hops:
                walk = _op("s1", "TRAVERSAL", graph.name, ("id",), traversal={"start_vertex_filter": {"column": graph.column, "value": start}, "edge_label": graph.label, "direction": d, "max_hops": h, "return_fields": ["id"]})
                name = f"{prefix}_{graph.name}_{d.lower()}{h}_{start}"
                yield {"query_id": name, "operations": [walk]}
                count = _op("s2", "AGGREGATE", "s1", (), ("s1",), aggregate={"group_by": [], "functions": [{"func": "COUNT", "column": "id"}]})
                yield {"query_id": f"{name}_count", "operations": [walk, count]}
                if graph.attach:
                    table, key, column = graph.attach
                    side = _op("s2", "AGGREGATE", table, (key,), aggregate={"group_by": [key], "functions": [{"func": "COUNT", "column": column}]})
                    both = _op("s3", "JOIN", "s1", ("id", f"COUNT_{column}"), ("s1", "s2"), join={"right_source": "s2", "left_key": "id", "right_key": key, "join_type": "LEFT"})
                    yield {"query_id": f"{name}_join", "operations": [walk, side, both]}


# The datasets' tables and graphs as their loaders name them.
SNB = (TableSpec("posts", "post_id", "content_length", "creator_id", ("person", "person_id", "creator_id")), TableSpec("comments", "comment_id", "content_length", "author_id", ("person", "person_id", "author_id")))
SNB_GRAPH = GraphSpec("social_graph", "KNOWS", "id", (1, 10, 100), ("posts", "creator_id", "post_id"))
OGB_GRAPH = GraphSpec("ogbn_arxiv", "KNOWS", "id", (0, 100, 1000))
JOB = (TableSpec("cast_info", "c0", "c1", "c2", ("title", "c0", "c2")), TableSpec("movie_companies", "c0", "c1", "c2", ("title", "c0", "c1")))
JOB_GRAPH = GraphSpec("job", "CAST", "id", ("title:c0:1", "title:c0:2"))
TPCDS = (TableSpec("store_sales", "c3", "c20", "c7", ("customer", "c0", "c3")), TableSpec("web_sales", "c4", "c20", "c3", ("customer", "c0", "c4")))
TPCDS_GRAPH = GraphSpec("tpcds", "BOUGHT", "id", ("customer:c0:1", "customer:c0:2"))


@dataclass(frozen=True)
class Intensity:
    """How many literals, starts, depths and directions the workloads go through."""

    literals: tuple[float, ...]
    starts: int
    hops: int
    directions: tuple[str, ...]


INTENSITIES = {
    "balanced": Intensity((10, 100, 1000), 3, 0, ("OUT", "BOTH")),
    "dense": Intensity((10, 50, 100, 500, 1000), 6, 1, ("OUT", "BOTH")),
    "aggressive": Intensity((1, 10, 50, 100, 500, 1000, 5000), 12, 2, ("OUT", "IN", "BOTH")),
}
#: What a workload leans to: "all" is even; "graph" has deeper traversals and half of the literals; "sql" the reverse.
FOCUS = ("all", "graph", "sql")


def workloads(intensity: str = "balanced", focus: str = "all") -> dict[str, list[dict]]:
    """Every dataset's queries, relational and graph."""
    if focus not in FOCUS:
        raise ValueError(f"unknown focus '{focus}'; one of {FOCUS}")
    much = INTENSITIES[intensity]
    literals = much.literals[::2] if focus == "graph" else much.literals
    deeper = much.hops + (1 if focus == "graph" else 0)

    def starts(spec: GraphSpec) -> GraphSpec:
        more = [x for x in (5, 20, 50, 200, 500, 2000, 7, 11, 13) if isinstance(spec.starts[0], int)]
        chosen = (*spec.starts, *more)[: much.starts]
        return replace(spec, starts=chosen[: max(1, len(chosen) // 2)] if focus == "sql" else chosen)

    def walks(prefix: str, spec: GraphSpec, hops: Sequence[int], directions: Sequence[str] | None = None) -> list[dict]:
        depths = (*hops, *range(max(hops) + 1, max(hops) + 1 + deeper))
        return list(graph_workload(prefix, starts(spec), depths[:1] if focus == "sql" else depths, directions or much.directions))

    return {
        "snb": walks("snb", SNB_GRAPH, (1, 2)),
        "snb_bi": list(relational_workload("snb_bi", SNB, literals)),
        "snb_bi_graph": walks("snb_bi", SNB_GRAPH, (3,), ("BOTH",)),
        "ogb": walks("ogb", OGB_GRAPH, (1, 2, 3)),
        "job": list(relational_workload("job", JOB, literals)),
        "job_graph": walks("job", JOB_GRAPH, (1, 2)),
        "tpcds": list(relational_workload("tpcds", TPCDS, literals)),
        "tpcds_graph": walks("tpcds", TPCDS_GRAPH, (1, 2)),
    }
