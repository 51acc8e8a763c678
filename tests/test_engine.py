import pytest
from pyspark.sql import functions as F

from lattica.evalkit.compare import compared, differences, report_table, timed
from lattica.operators.predicates import ColumnError, condition, filtered
from lattica.operators.relational import aggregated, joined, projected
from lattica.operators.traversal import Graph, traversed
from lattica.plans.engine import Engine, metadata
from lattica.routing.policies import trivial
from lattica.sources.tables import MissingTable, Tables


# Rows of the fixtures and the vertices that traversals of them reach: fixed values.


@pytest.fixture(scope="module")
def customer(spark):
    rows = [(1, "Alice", 1000.0, 7), (2, "Bob", 6000.0, 7), (3, "Charlie", 3000.0, 3), (4, "Diana", 8000.0, 7), (5, "Eve", 500.0, 5)]
    return spark.createDataFrame(rows, "c_custkey long, c_name string, c_acctbal double, c_nationkey int")


@pytest.fixture(scope="module")
def orders(spark):
    rows = [(101, 1, 150.0), (102, 2, 200.0), (103, 2, 300.0), (104, 3, 50.0), (105, 4, 400.0), (106, 4, 100.0)]
    return spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_totalprice double")


@pytest.fixture(scope="module")
def graph(spark):
    v = spark.createDataFrame([(0, 10, "A"), (1, 20, "B"), (2, 30, "C"), (3, 40, "A"), (4, 50, "B")], "id long, attr1 int, label string")
    e = spark.createDataFrame([(0, 1, "KNOWS"), (0, 2, "KNOWS"), (1, 3, "KNOWS"), (2, 4, "LIKES"), (3, 4, "KNOWS")], "src long, dst long, relationship string")
    return Graph.of(v, e)


@pytest.fixture(scope="module")
def engine(spark, customer, orders, graph):
    tables = Tables(spark).put("customer", customer).put("orders", orders)
    tables.graphs["social"] = graph
    return Engine(spark, tables)


def pred(column, operator, value):
    return {"column": column, "operator": operator, "value": value}


@pytest.mark.parametrize(
    ("predicate", "n"),
    [
        (pred("c_nationkey", "=", 7), 3), (pred("c_nationkey", "=", "7"), 3), (pred("c_acctbal", ">", 5000), 2), (pred("c_custkey", "<", 3), 2), (pred("c_custkey", ">=", 3), 3), (pred("c_custkey", "<=", 2.5), 2),
        (pred("c_custkey", "IN", [1, 3, 5]), 3), (pred("c_custkey", "IN", 3), 1), (pred("c_custkey", "IN", [1, "x"]), 1), (pred("c_custkey", "IN", []), 0), (pred("c_name", "LIKE", "%li%"), 2), (pred("c_name", "LIKE", "A.*"), 0),
        (pred("c_nationkey", "!=", 7), 2), (pred("c_nationkey", "NOT IN", [7, 3]), 1), (None, 5),
    ],
)
def test_predicates(customer, predicate, n):
    assert filtered(customer, predicate).count() == n


def test_predicate_errors(customer):
    with pytest.raises(ColumnError):
        filtered(customer, pred("nowhere", "=", 1))
    assert filtered(customer, pred("nowhere", "=", 1), strict=False).count() == 5
    with pytest.raises(ColumnError):
        condition(customer, pred("c_custkey", "=", "seven"))


def test_predicates_reach_the_scan(spark, tmp_path, customer):
    customer.write.parquet(str(tmp_path / "customer"))
    df = projected(filtered(Tables(spark, str(tmp_path)).table("customer"), pred("c_nationkey", "=", 7)), ["c_name"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(c_nationkey,7)" in plan and "ReadSchema: struct<c_name:string,c_nationkey:int>" in plan


def test_projection(customer):
    assert projected(customer, ["c_name", "nope", "c_custkey"]).columns == ["c_name", "c_custkey"]
    assert projected(customer, ["nope"]).columns == customer.columns


def test_joins(spark, customer, orders):
    assert joined(orders, customer, "o_custkey", "c_custkey").count() == 6
    assert joined(customer, orders, "c_custkey", "o_custkey", "LEFT").count() == 7
    assert joined(orders, customer, "o_custkey", "c_custkey", "RIGHT").count() == 7
    both = joined(customer, customer.where("c_custkey < 3"), "c_nationkey", "c_custkey", "LEFT")
    assert both.columns[4:] == ["c_custkey_right", "c_name_right", "c_acctbal_right", "c_nationkey_right"]
    left, right = spark.createDataFrame([(1, "a"), (None, "b")], "k int, x string"), spark.createDataFrame([(1, "c"), (None, "d"), (2, "e")], "k int, y string")
    assert joined(left, right, "k", "k").collect() == [(1, "a", "c")]  # nulls don't match
    assert {r.k for r in joined(left, right, "k", "k", "RIGHT").collect()} == {1, None, 2}
    with pytest.raises(ValueError, match="join key"):
        joined(left, right, "z", "k")


def test_aggregates(spark, orders):
    per = {r.o_custkey: r for r in aggregated(orders, ["o_custkey"], [{"func": "SUM", "column": "o_totalprice"}, {"func": "COUNT", "column": "*", "alias": "n"}]).collect()}
    assert per[4].SUM_o_totalprice == 500.0 and per[2].n == 2
    assert aggregated(orders, [], [{"func": "COUNT", "column": "o_orderkey"}]).collect() == [(6,)]
    empty = orders.where("o_orderkey < 0")
    assert aggregated(empty, [], [{"func": "SUM", "column": "o_totalprice"}]).collect() == [(None,)]
    nulls = spark.createDataFrame([(None, 1), (None, None), ("a", 2)], "k string, v int")
    assert {r.k: r.COUNT_v for r in aggregated(nulls, ["k"], [{"func": "COUNT", "column": "v"}]).collect()} == {None: 1, "a": 1}
    for bad in ([{"func": "MEDIAN", "column": "o_totalprice"}], [{"func": "SUM", "column": "*"}], [{"func": "SUM", "column": "nope"}]):
        with pytest.raises(ValueError):
            aggregated(orders, [], bad)


def spec(start, direction, hops, **more):
    return {"start_vertex_filter": {"column": "id", "value": start}, "edge_label": "", "direction": direction, "max_hops": hops, "return_fields": ["id"]} | more


@pytest.mark.parametrize("strategy", ["SQL", "GRAPH", None])
@pytest.mark.parametrize(
    ("asked", "ids"),
    [
        (spec(0, "OUT", 1), {0, 1, 2}), (spec(0, "OUT", 2), {0, 1, 2, 3, 4}), (spec(2, "BOTH", 1), {0, 2, 4}), (spec(4, "IN", 1), {2, 3, 4}), (spec(9, "OUT", 3), set()), (spec([1, 2], "OUT", 1), {1, 2, 3, 4}),
        (spec(0, "OUT", 3, edge_label="KNOWS"), {0, 1, 2, 3, 4}), (spec(2, "OUT", 3, edge_label="KNOWS"), {2}), (spec(0, "OUT", 2, end_vertex_filter={"column": "label", "value": "A"}), {0, 3}),
        (spec(0, "BOTH", 9), {0, 1, 2, 3, 4}), (spec(0, "OUT", 1, start_vertex_filter=None), {0, 1, 2, 3, 4}),
    ],
)
def test_traversals(graph, strategy, asked, ids):
    rows = [r.id for r in traversed(graph, asked, strategy).collect()]
    assert set(rows) == ids and len(rows) == len(ids)


def test_traversal_fields(graph):
    assert traversed(graph, spec(0, "OUT", 1, return_fields=["label"])).count() == 3
    assert traversed(graph, spec(0, "OUT", 1, return_fields=["nope"])).columns == ["id"]
    assert {r.attr1 for r in traversed(graph, spec(0, "OUT", 2, return_fields=["id", "attr1"], destination_filter={"column": "attr1", "operator": ">", "value": 30})).collect()} == {40, 50}
    with pytest.raises(ValueError, match="vertex column"):
        traversed(graph, spec(0, "OUT", 1, start_vertex_filter={"column": "nope", "value": 1}))


def test_graph_spellings(spark):
    g = Graph.of(spark.createDataFrame([(1,)], "person long"), spark.createDataFrame([(1, 2)], "source long, target long"), "KNOWS")
    assert g.vertices.columns == ["id"] and g.edges.columns == ["src", "dst", "relationship"]
    with pytest.raises(ValueError):
        Graph.of(g.vertices, g.vertices)


def query(*ops):
    return {"query_id": "q", "operations": list(ops)}


FILTER = {"op_id": "s1", "type": "FILTER", "source": "customer", "fields": ["c_custkey"], "predicate": pred("c_nationkey", "=", 7), "depends_on": []}
JOIN = {"op_id": "s2", "type": "JOIN", "source": "orders", "fields": ["o_orderkey"], "join": {"right_source": "s1", "left_key": "o_custkey", "right_key": "c_custkey", "join_type": "INNER"}, "depends_on": ["s1"]}


def test_only_the_last_operation_projects(engine):
    total = {"op_id": "s3", "type": "AGGREGATE", "source": "s2", "fields": ["c_name", "total"], "aggregate": {"group_by": ["c_name"], "functions": [{"func": "SUM", "column": "o_totalprice"}]}, "depends_on": ["s2"]}
    assert {tuple(r) for r in engine.run(query(FILTER, JOIN, total)).collect()} == {("Alice", 150.0), ("Bob", 500.0), ("Diana", 500.0)}
    assert engine.run(query(FILTER, JOIN)).columns == ["o_orderkey"]


def test_traversal_then_relational(engine):
    walk = {"op_id": "t", "type": "TRAVERSAL", "source": "social", "traversal": spec(0, "OUT", 1), "depends_on": []}
    count = {"op_id": "g", "type": "AGGREGATE", "source": "t", "aggregate": {"group_by": [], "functions": [{"func": "COUNT", "column": "id"}]}, "depends_on": ["t"]}
    for force in (None, "SQL", "GRAPH"):
        built = Engine(engine.spark, engine.tables, trivial, force).build(query(walk, count))
        assert built.data.collect() == [(3,)]
        assert built.decisions["sub_0"] == (force or "GRAPH")


def test_batch_keeps_errors(spark, engine):
    broken = query(FILTER | {"source": "nowhere"}) | {"query_id": "broken"}
    results = engine.run_batch([query(FILTER), broken])
    assert results[0].error is None and results[1].error.startswith("MissingTable")
    assert metadata(spark, results).count() == 2


def test_tables(spark, tmp_path, customer, graph):
    customer.write.parquet(str(tmp_path / "customer.parquet"))
    graph.vertices.write.parquet(str(tmp_path / "g_vertices"))
    graph.edges.write.parquet(str(tmp_path / "g_edges.parquet"))
    tables = Tables(spark, str(tmp_path))
    assert tables.table("customer").count() == 5 and spark.table("customer").count() == 5
    assert tables.graph("g").edges.count() == 5
    with pytest.raises(MissingTable):
        tables.table("nowhere")
    with pytest.raises(MissingTable):
        tables.graph("nowhere")
    from lattica.dsl.nodes import parse

    assert tables.missing(parse(query(FILTER, JOIN))) == ["orders"]


def test_comparison(spark, customer):
    again = customer.select("c_acctbal", "c_name", "c_nationkey", "c_custkey").orderBy(F.desc("c_name"))
    assert compared("q", customer, again).passed
    other = compared("q", customer, customer.where("c_custkey <> 3"))
    assert not other.passed and report_table(spark, [other]).first().passed is False
    assert differences(customer, customer.where("c_custkey <> 3")).select("side", "c_name").collect() == [("left", "Charlie")]
    t = timed(lambda: customer, 0, 2)
    assert t.failures == 0 and t.min_ms <= t.median_ms <= t.max_ms
    assert timed(lambda: 1 / 0, 0, 1).failures == 1


def explained(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(("column", "operator", "value", "pushed"), [("f", "=", 0.1, "EqualTo(f,0.1)"), ("b", ">", "9007199254740993", "GreaterThan(b,9007199254740993)"), ("d", "<=", "12.5", "LessThanOrEqual(d,12.50)"), ("i", "IN", [1, "2"], "In(i, [1,2])")])
def test_literals_reach_the_scan_in_the_columns_type(spark, tmp_path, column, operator, value, pushed):
    rows = spark.range(5).select(F.lit(0.1).cast("float").alias("f"), (F.col("id") + 9007199254740991).alias("b"), (F.col("id") * 10).cast("decimal(10,2)").alias("d"), F.col("id").cast("int").alias("i"))
    rows.write.parquet(str(tmp_path / "t"))
    found = filtered(spark.read.parquet(str(tmp_path / "t")), {"column": column, "operator": operator, "value": value})
    assert pushed in explained(found)
    assert found.count() == {"f": 5, "b": 2, "d": 2, "i": 2}[column]


def test_a_hop_may_broadcast_its_frontier(spark, tmp_path):
    """Hops are inner joins, so that Spark may choose the frontier's side; with edges beyond the limit it never sends them."""
    spark.range(200_000).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst")).write.parquet(str(tmp_path / "e"))
    spark.range(10).write.parquet(str(tmp_path / "v"))
    graph = Graph.of(spark.read.parquet(str(tmp_path / "v")), spark.read.parquet(str(tmp_path / "e")))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "64k")
    try:
        found = traversed(graph, {"start_vertex_filter": {"column": "id", "value": 1}, "direction": "OUT", "max_hops": 3})
        assert sorted(r.id for r in found.collect()) == [1, 2, 3, 4]
        plan = explained(found)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "LeftOuter" not in plan
    final = plan.split("Initial Plan")[0]
    assert not [line for line in final.splitlines() if "BroadcastHashJoin" in line and "src" in line and "BuildRight" in line and "Inner" in line]


def test_a_small_side_is_broadcast_and_a_large_one_is_not(spark, tmp_path):
    spark.range(50_000).select(F.col("id").alias("k"), (F.col("id") % 25).cast("int").alias("n")).write.parquet(str(tmp_path / "many"))
    spark.range(25).select(F.col("id").cast("int").alias("m"), F.col("id").cast("string").alias("name")).write.parquet(str(tmp_path / "few"))
    many, few = spark.read.parquet(str(tmp_path / "many")), spark.read.parquet(str(tmp_path / "few"))
    found = joined(many, few, "n", "m", "INNER")
    assert found.count() == 50_000 and "BroadcastHashJoin" in explained(found)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1")
    try:
        assert "SortMergeJoin" in explained(joined(many, few, "n", "m", "INNER"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
