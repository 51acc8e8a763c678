"""A query as a DAG of operations, read from a JSON document."""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import dataclass, field
from pathlib import Path

from lattica.dsl.validator import validate

RELATIONAL = ("FILTER", "MAP", "JOIN", "AGGREGATE")


class QueryError(ValueError):
    """A query document that cannot be read as a query."""


class CycleError(QueryError):
    """Operations that depend on one another in a circle."""


@dataclass(frozen=True)
class Node:
    op_id: str
    op_type: str
    source: str
    fields: tuple[str, ...] = ()
    predicate: dict | None = None
    join: dict | None = None
    traversal: dict | None = None
    aggregate: dict | None = None
    depends_on: tuple[str, ...] = ()


@dataclass(frozen=True)
class Query:
    query_id: str
    nodes: tuple[Node, ...]
    description: str = ""

    @property
    def leaf(self) -> Node:
        """The operation whose result is the query's: of those nothing depends on, the last in order."""
        used = {d for n in self.nodes for d in n.depends_on}
        return [n for n in self.nodes if n.op_id not in used][-1]


def node(operation: dict) -> Node:
    return Node(
        operation["op_id"],
        operation["type"],
        operation["source"],
        tuple(operation.get("fields") or ()),
        *(operation.get(k) for k in ("predicate", "join", "traversal", "aggregate")),
        tuple(operation.get("depends_on") or ()),
    )


def ordered(nodes: Iterable[Node]) -> tuple[Node, ...]:
    """Dependencies first; otherwise in the document's order."""
    left = list(nodes)
    known, done, out = {n.op_id for n in left}, set(), []
    while left:
        ready = next((n for n in left if all(d in done or d not in known for d in n.depends_on)), None)
        if ready is None:
            raise CycleError(f"circular dependency among {sorted(n.op_id for n in left)}")
        left.remove(ready)
        done.add(ready.op_id)
        out.append(ready)
    return tuple(out)


def parse(document: dict) -> Query:
    errors = validate(document)
    if errors:
        raise (CycleError if any("circular" in e for e in errors) else QueryError)("; ".join(errors))
    return Query(document["query_id"], ordered(map(node, document["operations"])), document.get("description", ""))


def parse_text(text: str) -> Query:
    return parse(json.loads(text))


def parse_file(path: str | Path) -> dict[str, Query]:
    """One query or a list of queries, by query_id."""
    loaded = json.loads(Path(path).read_text(encoding="utf-8"))
    return {q.query_id: q for q in map(parse, loaded if isinstance(loaded, list) else [loaded])}
