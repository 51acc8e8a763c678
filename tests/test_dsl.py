import json

import pytest

from lattica.dsl.nodes import CycleError, QueryError, parse, parse_file, parse_text
from lattica.dsl.validator import validate, validate_file
from lattica.evalkit import workloads
from lattica.plans.decompose import decompose, levels


def op(op_id, kind="FILTER", needs=(), **more):
    part = {
        "JOIN": {"join": {"right_source": "b", "left_key": "x", "right_key": "y", "join_type": "INNER"}},
        "TRAVERSAL": {"traversal": {"start_vertex_filter": {"column": "id", "value": 1}, "edge_label": "KNOWS", "direction": "OUT", "max_hops": 2}},
        "AGGREGATE": {"aggregate": {"group_by": [], "functions": [{"func": "COUNT", "column": "x"}]}},
    }.get(kind, {})
    return {"op_id": op_id, "type": kind, "source": "a", "depends_on": list(needs)} | part | more


def doc(*ops):
    return {"query_id": "q", "operations": list(ops)}


def test_valid_documents_have_no_messages():
    assert validate(doc(op("s1", predicate={"column": "c", "operator": "IN", "value": [1, "x"]}), op("s2", "JOIN", ["s1"]), op("s3", "AGGREGATE", ["s2"]), op("t", "TRAVERSAL"))) == []


@pytest.mark.parametrize(
    "document",
    [
        {}, {"query_id": "q", "operations": []}, {"query_id": 3, "operations": [op("s")]}, doc({"op_id": "s", "source": "a"}), doc(op("s", "SORT")), doc({"op_id": "j", "type": "JOIN", "source": "a"}),
        doc(op("s", predicate={"column": "c", "operator": "!=", "value": 1})), doc(op("s", predicate={"column": "c", "operator": "=", "value": True})), doc(op("s", predicate={"column": "c", "operator": "=", "value": None})),
        doc(op("t", "TRAVERSAL", traversal={"start_vertex_filter": {"column": "id", "value": 1}, "edge_label": "K", "direction": "OUT", "max_hops": 0})),
        doc(op("j", "JOIN", join={"right_source": "b", "left_key": "x", "right_key": "y", "join_type": "FULL"})), doc(op("g", "AGGREGATE", aggregate={"group_by": [], "functions": [{"func": "MEDIAN", "column": "x"}]})),
        doc(op("s"), op("s")), doc(op("s", needs=["nowhere"])), doc(op("a1", needs=["b1"]), op("b1", needs=["a1"])), [], None,
    ],
)
def test_invalid_documents_have_messages(document):
    assert validate(document)


def test_order_and_leaf():
    q = parse(doc(op("c", needs=["b"]), op("b", needs=["a1"]), op("a1")))
    assert [n.op_id for n in q.nodes] == ["a1", "b", "c"]
    assert q.leaf.op_id == "c"


def test_errors():
    with pytest.raises(CycleError):
        parse(doc(op("a1", needs=["b1"]), op("b1", needs=["a1"])))
    with pytest.raises(QueryError):
        parse_text(json.dumps({"query_id": "q"}))


def test_files(tmp_path):
    path = tmp_path / "queries.json"
    path.write_text(json.dumps([doc(op("s")), doc(op("s")) | {"query_id": "r"}]))
    assert set(parse_file(path)) == {"q", "r"}
    assert validate_file(path) == {"q": [], "r": []}
    path.write_text("{")
    assert list(validate_file(path).values())[0]


def groups(*ops):
    return [[n.op_id for n in s.nodes] for s in decompose(parse(doc(*ops)).nodes)]


def test_decomposition():
    assert decompose([]) == []
    assert groups(op("f"), op("j", "JOIN", ["f"]), op("g", "AGGREGATE", ["j"])) == [["f", "j", "g"]]
    assert groups(op("m", "MAP"), op("f", needs=["m"])) == [["m", "f"]]
    subs = decompose(parse(doc(op("t", "TRAVERSAL"), op("g", "AGGREGATE"), op("j", "JOIN", ["t", "g"]))).nodes)
    assert subs[0].primary == "TRAVERSAL" and subs[0].parallelizable
    assert not next(s for s in subs if any(n.op_id == "j" for n in s.nodes)).parallelizable
    assert all(s.nodes for s in subs)
    assert [len(x) for x in levels(subs)][0] >= 1


def test_join_of_two_traversals_has_no_empty_group():
    subs = decompose(parse(doc(op("t1", "TRAVERSAL"), op("t2", "TRAVERSAL"), op("j", "JOIN", ["t1", "t2"]))).nodes)
    assert [len(s.nodes) for s in subs] == [1, 1, 1]
    assert [[s.sub_id for s in level] for level in levels(subs)] == [["sub_0", "sub_1"], ["sub_2"]]


def test_groups_never_wait_for_each_other():
    # f feeds both the traversal's side and the join, which also waits for the traversal.
    subs = decompose(parse(doc(op("f"), op("t", "TRAVERSAL", ["f"]), op("j", "JOIN", ["f", "t"]))).nodes)
    levels(subs)


def test_generated_workloads_are_valid():
    for made in workloads.workloads().values():
        assert made and all(validate(q) == [] for q in made)
        assert len({q["query_id"] for q in made}) == len(made)
    base = doc(op("f", predicate={"column": "c", "operator": ">", "value": 1}), op("t", "TRAVERSAL"), op("j", "JOIN", ["f", "t"]))
    assert len(workloads.variants(base)) == 4 * 2  # no extent is known, so the filter stays
    made = workloads.variants(base, {"kept": (0.25, 0.5)}, lambda table, column: (0, 10))
    assert [q["operations"][0]["predicate"]["value"] for q in made] == [7.5, 5.0] and base["operations"][0]["predicate"]["value"] == 1
    assert [q["operations"][2]["join"]["join_type"] for q in workloads.variants(base, {"join": ("INNER", "LEFT")})] == ["INNER", "LEFT"]
    with pytest.raises(ValueError):
        workloads.workloads("balanced", "no such focus")
