"""Registered queries of the core library, each with its SQL oracle where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.dsl.nodes import parse
from lattica.evalkit import compare, costs, curation, metrics
from lattica.functions import stats
from lattica.functions.features import feature_table
from lattica.operators.traversal import Graph
from lattica.plans.decompose import decompose
from lattica.plans.engine import Engine
from lattica.routing import policies
from lattica.sources import etl
from lattica.sources.store import settled
from lattica.sources.tables import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
OPENED: dict[tuple[str, int, str], Tables] = {}


def tables(spark: SparkSession, sf_dir: str) -> Tables:
    """The folder's tables, and tables and graphs derived from them; each is made when it is first asked for, and kept for the session."""
    key = spark.sparkContext.applicationId, id(spark), sf_dir
    if key not in OPENED:
        OPENED[key] = opened(spark, sf_dir)
    return OPENED[key]


def opened(spark: SparkSession, sf_dir: str) -> Tables:
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")

    built: dict[str, DataFrame] = {}

    def people() -> DataFrame:
        key = F.col("c_custkey")
        return read("customer").select(key.alias("id"), key.alias("person_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("city"), F.col("c_nationkey").alias("country"), F.col("c_nationkey").alias("attr1"))

    def posts() -> DataFrame:
        return read("orders").select(F.col("o_orderkey").alias("post_id"), F.col("o_custkey").alias("creator_id"), F.col("o_totalprice").cast("int").alias("content_length"))

    def comments() -> DataFrame:
        return read("orders").select(
            F.col("o_orderkey").alias("comment_id"), F.pmod(F.col("o_custkey") * 3, F.lit(1000)).alias("author_id"), F.col("o_orderkey").alias("post_id"), F.col("o_totalprice").cast("int").alias("content_length")
        )

    def works_at() -> DataFrame:
        customer, nation = read("customer"), read("nation")
        return customer.join(nation, customer.c_nationkey == nation.n_nationkey).select(F.col("c_custkey").alias("person_id"), F.col("n_name").alias("company_name"))

    def once(name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """A projection is built once, as a loader would, and then read as a table."""
        if name not in built:
            built[name] = settled(make(), name)
        return built[name]

    def supply() -> Graph:
        edges = once("supply_edges", lambda: etl.projected_edges(read("lineitem"), "l_partkey", "l_suppkey", F.col("l_returnflag"), "p", "s"))
        return Graph.of(once("supply_vertices", lambda: etl.endpoints(edges)), edges)

    def social() -> Graph:
        """Customers linked by their orders: each knows the one whose key the order's number falls on."""
        other = F.pmod(F.col("o_orderkey") * 7, F.lit(1000))
        edges = read("orders").select(F.col("o_custkey").alias("src"), other.alias("dst"), F.col("o_orderstatus").alias("relationship"))
        return Graph.of(people(), once("social_edges", lambda: edges.where("src <> dst").distinct()))

    made = {"person": people, "posts": posts, "comments": comments, "works_at": works_at, "messages": lambda: etl.messages(posts(), comments())}
    graphs = {"supply_graph": supply, "social_graph": social, "synthetic_graph": social}
    return Tables(spark, sf_dir, makers=made, graph_makers=graphs)


# The graphs' SQL, as common table expressions.
SUPPLY = "edges AS (SELECT DISTINCT 'p:l_partkey:' || l_partkey AS src, 's:l_suppkey:' || l_suppkey AS dst, l_returnflag AS relationship FROM lineitem)"
LINKS = "edges AS (SELECT DISTINCT o_custkey AS src, o_orderkey * 7 % 1000 AS dst, o_orderstatus AS relationship FROM orders WHERE o_custkey <> o_orderkey * 7 % 1000)"
PEOPLE = "people AS (SELECT c_custkey AS id, c_custkey AS person_id, c_name AS name, c_mktsegment AS city, c_nationkey AS country, c_nationkey AS attr1 FROM customer)"
WORKS = "(SELECT c_custkey AS person_id, n_name AS company_name FROM customer JOIN nation ON c_nationkey = n_nationkey)"


def reach(graph: str, start: str, direction: str, hops: int, label: str | None = None) -> str:
    """WITH clause that ends in ``reached(id)``; ``start`` is a query for ids."""
    kept = "edges" if label is None else f"(SELECT * FROM edges WHERE relationship = '{label}')"
    out, back = f"SELECT src AS a, dst AS b FROM {kept}", f"SELECT dst AS a, src AS b FROM {kept}"
    hop = {"OUT": out, "IN": back, "BOTH": f"{out} UNION {back}"}[direction]
    return f"WITH RECURSIVE {graph}, hop AS ({hop}), walk(id, d) AS ({start} UNION SELECT hop.b, walk.d + 1 FROM walk JOIN hop ON hop.a = walk.id WHERE walk.d < {hops}), reached AS (SELECT DISTINCT id FROM walk)"


def dsl(name: str, operations: list[dict], sql: str | None, rounded: dict[str, int] | None = None) -> None:
    """Register a query document; averages and sums of fractions are rounded on both sides."""
    document = {"query_id": name, "operations": operations}

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = Engine(spark, tables(spark, sf_dir)).run(document)
        return found.withColumns({c: F.round(c, d) for c, d in (rounded or {}).items()})

    QUERIES[name] = run
    if sql:
        ORACLES[name] = sql


def query(sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def op(op_id: str, kind: str, source: str, fields: str = "", needs: str = "", **part: dict) -> dict:
    return {"op_id": op_id, "type": kind, "source": source, "fields": fields.split(), "depends_on": needs.split()} | part


def where(column: str, operator: str, value: object) -> dict:
    return {"predicate": {"column": column, "operator": operator, "value": value}}


def link(right: str, left_key: str, right_key: str, kind: str = "INNER") -> dict:
    return {"join": {"right_source": right, "left_key": left_key, "right_key": right_key, "join_type": kind}}


def group(by: str, *functions: str) -> dict:
    made = [dict(zip(("func", "column", "alias"), f.split(), strict=False)) for f in functions]
    return {"aggregate": {"group_by": by.split(), "functions": made}}


def walk(column: str, value: object, direction: str, hops: int, label: str = "", returned: str = "id", **more: dict) -> dict:
    return {"traversal": {"start_vertex_filter": {"column": column, "value": value}, "edge_label": label, "direction": direction, "max_hops": hops, "return_fields": returned.split()} | more}


# Predicates, projection

CUSTOMER = "SELECT c_custkey, c_name, c_nationkey FROM customer"
for _name, _column, _operator, _value, _sql in (
    ("eq", "c_nationkey", "=", 7, "c_nationkey = 7"),
    ("gt", "c_acctbal", ">", 5000, "c_acctbal > 5000"),
    ("lt", "c_custkey", "<", 100, "c_custkey < 100"),
    ("ge", "c_acctbal", ">=", 0, "c_acctbal >= 0"),
    ("le", "c_custkey", "<=", 100, "c_custkey <= 100"),
    ("in", "c_nationkey", "IN", [1, 3, 5], "c_nationkey IN (1, 3, 5)"),
    ("in_scalar", "c_nationkey", "IN", 3, "c_nationkey IN (3)"),
    ("like", "c_name", "LIKE", "%1_", "c_name LIKE '%1_'"),
):
    dsl(f"filter_{_name}", [op("s1", "FILTER", "customer", "c_custkey c_name c_nationkey", **where(_column, _operator, _value))], f"{CUSTOMER} WHERE {_sql}")
dsl("filter_none", [op("s1", "FILTER", "customer", "c_custkey c_name c_nationkey")], CUSTOMER)
dsl(
    "filter_date", [op("s1", "FILTER", "orders", "o_orderkey o_orderdate", **where("o_orderdate", ">=", "1997-01-01"))], "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01'"
)
dsl(
    "filter_chain",
    [op("s1", "FILTER", "orders", "o_orderkey", **where("o_orderstatus", "=", "F")), op("s2", "FILTER", "s1", "o_orderkey o_totalprice", "s1", **where("o_totalprice", ">", 100000))],
    "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000",
)
dsl("map_project", [op("s1", "MAP", "customer", "c_name c_custkey nothing_of_this_name")], "SELECT c_name, c_custkey FROM customer")

# Joins

F_ORDERS = op("s1", "FILTER", "orders", "", **where("o_totalprice", ">", 150000))
for _kind in ("INNER", "LEFT", "RIGHT"):
    dsl(
        f"join_{_kind.lower()}",
        [F_ORDERS, op("s2", "JOIN", "s1", "o_orderkey o_custkey c_custkey c_name", "s1", **link("customer", "o_custkey", "c_custkey", _kind))],
        f"SELECT o_orderkey, o_custkey, c_custkey, c_name FROM (SELECT * FROM orders WHERE o_totalprice > 150000) {_kind} JOIN customer ON o_custkey = c_custkey",
    )
dsl(
    "join_small_side",
    [op("s1", "JOIN", "customer", "c_custkey n_name", **link("nation", "c_nationkey", "n_nationkey"))],
    "SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey",
)
dsl(
    "join_name_collision",
    [op("s1", "FILTER", "customer", "", **where("c_acctbal", ">", 0)), op("s2", "JOIN", "customer", "c_custkey c_name c_custkey_right c_name_right", "s1", **link("s1", "c_nationkey", "c_custkey"))],
    "SELECT a.c_custkey, a.c_name, b.c_custkey AS c_custkey_right, b.c_name AS c_name_right FROM customer a JOIN customer b ON a.c_nationkey = b.c_custkey WHERE b.c_acctbal > 0",
)
dsl(
    "join_same_key_name",
    [
        op("s1", "AGGREGATE", "orders", "", **group("o_custkey", "COUNT o_orderkey n")),
        op("s2", "AGGREGATE", "orders", "", **group("o_custkey", "MAX o_totalprice top")),
        op("s3", "JOIN", "s1", "o_custkey n top", "s1 s2", **link("s2", "o_custkey", "o_custkey", "RIGHT")),
    ],
    "SELECT o_custkey, count(o_orderkey) AS n, max(o_totalprice) AS top FROM orders GROUP BY o_custkey",
)

# Aggregates

for _f in ("SUM", "COUNT", "AVG", "MAX", "MIN"):
    dsl(
        f"agg_{_f.lower()}",
        [op("s1", "AGGREGATE", "orders", "", **group("o_orderpriority", f"{_f} o_totalprice"))],
        f"SELECT o_orderpriority, {f'round({_f.lower()}(o_totalprice), 2)' if _f in ('SUM', 'AVG') else f'{_f.lower()}(o_totalprice)'} AS {_f}_o_totalprice FROM orders GROUP BY 1",
        {f"{_f}_o_totalprice": 2} if _f in ("SUM", "AVG") else None,
    )
dsl(
    "agg_multi",
    [op("s1", "AGGREGATE", "lineitem", "", **group("l_returnflag l_linestatus", "COUNT l_orderkey n", "MIN l_quantity", "MAX l_quantity", "AVG l_discount d"))],
    "SELECT l_returnflag, l_linestatus, count(l_orderkey) AS n, min(l_quantity) AS MIN_l_quantity, max(l_quantity) AS MAX_l_quantity, round(avg(l_discount), 6) AS d FROM lineitem GROUP BY 1, 2",
    {"d": 6},
)
dsl("agg_global", [op("s1", "AGGREGATE", "orders", "", **group("", "COUNT o_orderkey", "MAX o_totalprice"))], 'SELECT count(o_orderkey) AS "COUNT_o_orderkey", max(o_totalprice) AS "MAX_o_totalprice" FROM orders')
dsl("agg_count_star", [op("s1", "AGGREGATE", "customer", "", **group("c_mktsegment", "COUNT * n"))], "SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1")
dsl(
    "agg_null_values",
    [op("s1", "JOIN", "customer", "", **link("orders", "c_custkey", "o_custkey", "LEFT")), op("s2", "AGGREGATE", "s1", "", "s1", **group("c_mktsegment", "COUNT o_orderkey n", "COUNT * all_rows"))],
    "SELECT c_mktsegment, count(o_orderkey) AS n, count(*) AS all_rows FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1",
)
dsl(
    "agg_null_key",
    [F_ORDERS, op("s2", "JOIN", "customer", "", "s1", **link("s1", "c_custkey", "o_custkey", "LEFT")), op("s3", "AGGREGATE", "s2", "", "s2", **group("o_orderstatus", "COUNT c_custkey n", "SUM o_orderkey k"))],
    "SELECT o_orderstatus, count(c_custkey) AS n, CAST(sum(o_orderkey) AS BIGINT) AS k FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 150000) ON c_custkey = o_custkey GROUP BY 1",
)
dsl(
    "agg_then_filter",
    [op("s1", "AGGREGATE", "orders", "", **group("o_custkey", "COUNT o_orderkey n")), op("s2", "FILTER", "s1", "o_custkey n", "s1", **where("n", ">", 15))],
    "SELECT o_custkey, count(o_orderkey) AS n FROM orders GROUP BY 1 HAVING count(o_orderkey) > 15",
)

# The relational sample queries; ids and documents are fixed values of the workload

ORDERS_OF = "FROM orders JOIN customer ON o_custkey = c_custkey"
dsl(
    "q_tpch_001",
    [
        op("s1", "FILTER", "customer", "c_custkey c_name c_nationkey", **where("c_nationkey", "=", 7)),
        op("s2", "JOIN", "orders", "o_orderkey o_custkey o_totalprice c_name", "s1", **link("s1", "o_custkey", "c_custkey")),
        op("s3", "AGGREGATE", "s2", "c_name total_spent", "s2", **group("c_name", "SUM o_totalprice")),
    ],
    f'SELECT c_name, round(sum(o_totalprice), 2) AS "SUM_o_totalprice" {ORDERS_OF} WHERE c_nationkey = 7 GROUP BY 1',
    {"SUM_o_totalprice": 2},
)
dsl(
    "q_tpch_002",
    [
        op("s1", "FILTER", "customer", "c_custkey c_name c_acctbal", **where("c_acctbal", ">", 5000)),
        op("s2", "JOIN", "orders", "o_orderkey o_custkey", "s1", **link("s1", "o_custkey", "c_custkey")),
        op("s3", "AGGREGATE", "s2", "c_name order_count", "s2", **group("c_name", "COUNT o_orderkey")),
    ],
    f'SELECT c_name, count(o_orderkey) AS "COUNT_o_orderkey" {ORDERS_OF} WHERE c_acctbal > 5000 GROUP BY 1',
)
for _number, _key, _call in ((3, "c_nationkey", "AVG"), (4, "c_mktsegment", "MAX")):
    dsl(
        f"q_tpch_00{_number}",
        [op("s1", "JOIN", "orders", f"o_orderkey o_totalprice {_key}", **link("customer", "o_custkey", "c_custkey")), op("s2", "AGGREGATE", "s1", _key, "s1", **group(_key, f"{_call} o_totalprice"))],
        f'SELECT {_key}, round({_call.lower()}(o_totalprice), 2) AS "{_call}_o_totalprice" {ORDERS_OF} GROUP BY 1',
        {f"{_call}_o_totalprice": 2},
    )
dsl(
    "q_tpch_005",
    [
        op("s1", "FILTER", "orders", "o_orderkey o_custkey o_orderpriority", **where("o_orderpriority", "=", "1-URGENT")),
        op("s2", "JOIN", "s1", "o_orderkey c_custkey c_name", "s1", **link("customer", "o_custkey", "c_custkey")),
        op("s3", "AGGREGATE", "s2", "c_name urgent_count", "s2", **group("c_name", "COUNT o_orderkey")),
    ],
    f"SELECT c_name, count(o_orderkey) AS \"COUNT_o_orderkey\" {ORDERS_OF} WHERE o_orderpriority = '1-URGENT' GROUP BY 1",
)
dsl(
    "q_synth_004",
    [
        op("s1", "FILTER", "customer", "c_custkey c_name", **where("c_custkey", "<", 1000)),
        op("s2", "JOIN", "orders", "o_orderkey o_custkey o_totalprice", "s1", **link("s1", "o_custkey", "c_custkey")),
    ],
    f"SELECT o_orderkey, o_custkey, o_totalprice {ORDERS_OF} WHERE c_custkey < 1000",
)
dsl(
    "q_synth_006",
    [
        op("s1", "FILTER", "orders", "", **where("o_orderstatus", "=", "F")),
        op("s2", "FILTER", "s1", "", "s1", **where("o_totalprice", ">", 100000)),
        op("s3", "AGGREGATE", "s2", "total_orders avg_price", "s2", **group("", "COUNT o_orderkey", "AVG o_totalprice")),
    ],
    "SELECT count(o_orderkey) AS \"COUNT_o_orderkey\", round(avg(o_totalprice), 2) AS \"AVG_o_totalprice\" FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000",
    {"AVG_o_totalprice": 2},
)
dsl(
    "q_synth_007",
    [op("s1", "MAP", "customer", "c_custkey c_name c_acctbal"), op("s2", "FILTER", "s1", "c_custkey c_name c_acctbal", "s1", **where("c_acctbal", ">=", 0))],
    "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_acctbal >= 0",
)

# Traversals

PART1 = "SELECT 'p:l_partkey:1' AS id, 0 AS d"
for _d in ("OUT", "IN", "BOTH"):
    for _h in (1, 2, 3):
        _from = "s:l_suppkey:1" if _d == "IN" else "p:l_partkey:1"
        dsl(f"traverse_{_d.lower()}_{_h}", [op("s1", "TRAVERSAL", "supply_graph", "id", **walk("id", _from, _d, _h))], reach(SUPPLY, f"SELECT '{_from}' AS id, 0 AS d", _d, _h) + " SELECT id FROM reached")
dsl("traverse_label", [op("s1", "TRAVERSAL", "supply_graph", "id", **walk("id", "p:l_partkey:1", "BOTH", 2, "R"))], reach(SUPPLY, PART1, "BOTH", 2, "R") + " SELECT id FROM reached")
dsl(
    "traverse_multi_start",
    [op("s1", "TRAVERSAL", "social_graph", "", **walk("country", 7, "OUT", 2, returned="person_id name"))],
    reach(f"{LINKS}, {PEOPLE}", "SELECT id, 0 AS d FROM people WHERE country = 7", "OUT", 2) + " SELECT DISTINCT person_id, name FROM people JOIN reached USING (id)",
)
dsl(
    "traverse_start_not_in",
    [op("s1", "TRAVERSAL", "social_graph", "", traversal={"start_vertex_filter": {"column": "country", "value": [7, 8, 9], "operator": "NOT IN"}, "edge_label": "", "direction": "IN", "max_hops": 1, "return_fields": ["id"]})],
    reach(f"{LINKS}, {PEOPLE}", "SELECT id, 0 AS d FROM people WHERE country NOT IN (7, 8, 9)", "IN", 1) + " SELECT id FROM people JOIN reached USING (id)",
)
dsl(
    "traverse_end_filter",
    [op("s1", "TRAVERSAL", "social_graph", "", **walk("id", 5, "BOTH", 2, returned="id", end_vertex_filter={"column": "city", "value": "BUILDING"}))],
    reach(f"{LINKS}, {PEOPLE}", "SELECT id, 0 AS d FROM people WHERE id = 5", "BOTH", 2) + " SELECT id FROM people JOIN reached USING (id) WHERE city = 'BUILDING'",
)
dsl(
    "traverse_destination_filter",
    [op("s1", "TRAVERSAL", "social_graph", "", **walk("id", 5, "BOTH", 2, returned="id country", destination_filter={"column": "country", "operator": ">=", "value": 10}))],
    reach(f"{LINKS}, {PEOPLE}", "SELECT id, 0 AS d FROM people WHERE id = 5", "BOTH", 2) + " SELECT id, country FROM people JOIN reached USING (id) WHERE country >= 10",
)
dsl(
    "traverse_return_fallback",
    [op("s1", "TRAVERSAL", "social_graph", "", **walk("id", 5, "OUT", 1, returned="no_such_field"))],
    reach(f"{LINKS}, {PEOPLE}", "SELECT id, 0 AS d FROM people WHERE id = 5", "OUT", 1) + " SELECT id FROM people JOIN reached USING (id)",
)
dsl(
    "traverse_deep",
    [op("s1", "TRAVERSAL", "social_graph", "", **walk("id", 3, "BOTH", 6, returned="id name"))],
    reach(f"{LINKS}, {PEOPLE}", "SELECT id, 0 AS d FROM people WHERE id = 3", "BOTH", 6) + " SELECT id, name FROM people JOIN reached USING (id)",
)

# Sample queries with traversals (ids and documents are fixed values of the workload), on graphs projected from the driver's tables


def social(start: str, direction: str, hops: int) -> str:
    return reach(f"{LINKS}, {PEOPLE}", f"SELECT id, 0 AS d FROM people WHERE {start}", direction, hops)


dsl("q_synth_001", [op("s1", "TRAVERSAL", "synthetic_graph", "id attr1", **walk("id", 0, "OUT", 2, returned="id attr1"))], social("id = 0", "OUT", 2) + " SELECT id, attr1 FROM people JOIN reached USING (id)")
dsl(
    "q_synth_002",
    [op("s1", "TRAVERSAL", "synthetic_graph", "id", **walk("id", 1, "BOTH", 1)), op("s2", "AGGREGATE", "s1", "neighbor_count", "s1", **group("", "COUNT id"))],
    social("id = 1", "BOTH", 1) + ' SELECT count(id) AS "COUNT_id" FROM people JOIN reached USING (id)',
)
dsl("q_synth_003", [op("s1", "TRAVERSAL", "synthetic_graph", "id attr1", **walk("id", 0, "OUT", 3, returned="id attr1"))], social("id = 0", "OUT", 3) + " SELECT id, attr1 FROM people JOIN reached USING (id)")
dsl(
    "q_synth_005",
    [
        op("s1", "TRAVERSAL", "synthetic_graph", "id", **walk("id", 5, "OUT", 2)),
        op("s2", "FILTER", "customer", "c_custkey c_name c_acctbal", **where("c_acctbal", ">", 3000)),
        op("s3", "JOIN", "s1", "id c_name c_acctbal", "s1 s2", **link("s2", "id", "c_custkey")),
        op("s4", "AGGREGATE", "s3", "total_balance", "s3", **group("", "SUM c_acctbal")),
    ],
    social("id = 5", "OUT", 2) + ' SELECT round(sum(c_acctbal), 2) AS "SUM_c_acctbal" FROM people JOIN reached USING (id) JOIN customer ON id = c_custkey WHERE c_acctbal > 3000',
    {"SUM_c_acctbal": 2},
)
dsl(
    "q_synth_008",
    [
        op("s1", "TRAVERSAL", "synthetic_graph", "id", **walk("id", 10, "BOTH", 1)),
        op("s2", "AGGREGATE", "orders", "o_custkey order_count", **group("o_custkey", "COUNT o_orderkey order_count")),
        op("s3", "JOIN", "s1", "id order_count", "s1 s2", **link("s2", "id", "o_custkey")),
    ],
    social("id = 10", "BOTH", 1) + " SELECT id, count(o_orderkey) AS order_count FROM people JOIN reached USING (id) JOIN orders ON id = o_custkey GROUP BY 1",
)
dsl(
    "q_snb_001",
    [
        op("s1", "TRAVERSAL", "social_graph", "person_id name", **walk("person_id", 123, "BOTH", 2, returned="person_id name")),
        op("s2", "AGGREGATE", "posts", "creator_id post_count", **group("creator_id", "COUNT post_id post_count")),
        op("s3", "JOIN", "s1", "person_id name post_count", "s1 s2", **link("s2", "person_id", "creator_id", "LEFT")),
    ],
    social("person_id = 123", "BOTH", 2) + " SELECT person_id, name, post_count FROM people JOIN reached USING (id) LEFT JOIN (SELECT o_custkey, count(*) AS post_count FROM orders GROUP BY 1) ON person_id = o_custkey",
)
dsl(
    "q_snb_002",
    [
        op("s1", "TRAVERSAL", "social_graph", "", **walk("person_id", 456, "OUT", 2, returned="person_id name city")),
        op("s2", "FILTER", "s1", "", "s1", **where("city", "=", "BUILDING")),
        op("s3", "JOIN", "s2", "", "s2", **link("works_at", "person_id", "person_id")),
        op("s4", "AGGREGATE", "s3", "", "s3", **group("company_name", "COUNT person_id")),
    ],
    social("person_id = 456", "OUT", 2) + f" SELECT company_name, count(person_id) AS \"COUNT_person_id\" FROM people JOIN reached USING (id) JOIN {WORKS} USING (person_id) WHERE city = 'BUILDING' GROUP BY 1",
)
dsl(
    "q_snb_003",
    [
        op("s1", "TRAVERSAL", "social_graph", "", **walk("person_id", 789, "BOTH", 1, returned="person_id name")),
        op("s2", "AGGREGATE", "comments", "", **group("author_id", "COUNT comment_id comment_count")),
        op("s3", "JOIN", "s1", "person_id name comment_count", "s1 s2", **link("s2", "person_id", "author_id", "LEFT")),
    ],
    social("person_id = 789", "BOTH", 1) + " SELECT person_id, name, comment_count FROM people JOIN reached USING (id) LEFT JOIN (SELECT o_custkey * 3 % 1000 AS a, count(*) AS comment_count FROM orders GROUP BY 1) ON person_id = a",
)
dsl(
    "q_snb_004",
    [
        op("s1", "TRAVERSAL", "social_graph", "", **walk("person_id", 100, "OUT", 3, returned="person_id")),
        op("s2", "AGGREGATE", "messages", "", **group("sender_id", "COUNT message_id msg_count", "AVG content_length avg_length")),
        op("s3", "JOIN", "s1", "person_id msg_count avg_length", "s1 s2", **link("s2", "person_id", "sender_id")),
    ],
    social("person_id = 100", "OUT", 3)
    + ", messages AS (SELECT o_custkey AS k, CAST(trunc(o_totalprice) AS INTEGER) AS n FROM orders UNION ALL SELECT o_custkey * 3 % 1000, CAST(trunc(o_totalprice) AS INTEGER) FROM orders)"
    + " SELECT person_id, count(*) AS msg_count, round(avg(n), 6) AS avg_length FROM people JOIN reached USING (id) JOIN messages ON person_id = k GROUP BY 1",
    {"avg_length": 6},
)
dsl(
    "q_snb_005",
    [
        op("s1", "FILTER", "person", "person_id", **where("country", "=", 7)),
        op("s2", "TRAVERSAL", "social_graph", "", "s1", **walk("country", 7, "BOTH", 2, returned="person_id name")),
    ],
    social("country = 7", "BOTH", 2) + " SELECT person_id, name FROM people JOIN reached USING (id)",
)

# Graph projections and statistics


@query(f"WITH {SUPPLY} SELECT * FROM edges")
def graph_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables(spark, sf_dir).graph("supply_graph").edges


@query(f"WITH {LINKS} SELECT src, dst, relationship FROM edges UNION SELECT dst, src, relationship FROM edges")
def graph_symmetrise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return etl.symmetric(tables(spark, sf_dir).graph("social_graph").edges)


@query(f"WITH {SUPPLY} SELECT src AS id FROM edges UNION SELECT dst FROM edges")
def graph_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return etl.endpoints(tables(spark, sf_dir).graph("supply_graph").edges)


@query(
    f"WITH {LINKS}, g AS (SELECT src, count(*) AS degree FROM edges GROUP BY 1) SELECT round(avg(degree), 6) AS avg_degree, CAST(max(degree) AS DOUBLE) AS max_degree, round(stddev_samp(degree), 6) AS stddev_degree, count(*) AS vertex_count, CAST(sum(degree) AS BIGINT) AS edge_count FROM g"
)
def graph_degree_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = stats.graph_stats(tables(spark, sf_dir).graph("social_graph").edges)
    return found.withColumns({c: F.round(c, 6) for c in ("avg_degree", "stddev_degree")})


@query("SELECT DISTINCT o_custkey AS src, o_orderkey AS dst, 'KNOWS' AS relationship FROM orders")
def graph_edge_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return etl.edge_list(tables(spark, sf_dir).table("orders").select("o_custkey", "o_orderkey"))


@query("SELECT o_orderkey AS message_id, o_custkey AS sender_id, CAST(trunc(o_totalprice) AS INTEGER) AS content_length FROM orders UNION ALL SELECT o_orderkey, o_custkey * 3 % 1000, CAST(trunc(o_totalprice) AS INTEGER) FROM orders")
def messages_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables(spark, sf_dir).table("messages")


_STATS = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) AS row_count, count(DISTINCT {c}) AS distinct_count, CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max FROM orders" for c in ("o_orderkey", "o_custkey", "o_totalprice")
)


@query(_STATS)
def stats_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.column_stats(tables(spark, sf_dir).table("orders"))


@query(
    "SELECT c_custkey, 'Customer#' || c_custkey AS c_name, CAST(c_custkey % 25 AS INTEGER) AS c_nationkey, CAST(c_custkey * 37 % 10000 AS DOUBLE) AS c_acctbal, "
    "list_extract(['AUTOMOBILE','BUILDING','FURNITURE','MACHINERY','HOUSEHOLD'], c_custkey % 5 + 1) AS c_mktsegment FROM customer"
)
def compat_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return etl.compatible_customer(tables(spark, sf_dir).table("customer"), "c_custkey")


# Features, fingerprints, history


@query("SELECT o_orderkey, substr(sha256('FILTER|JOIN|' || o_orderstatus), 1, 16) AS fingerprint FROM orders")
def fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = tables(spark, sf_dir).table("orders").withColumn("ops", F.array(F.lit("JOIN"), F.lit("FILTER")))
    return orders.select("o_orderkey", stats.fingerprint_column("ops", "o_orderstatus").alias("fingerprint"))


@query(
    "SELECT o_orderpriority AS fingerprint, round(avg(o_totalprice), 2) AS hist_avg_runtime_ms, round(coalesce(var_samp(o_totalprice), 0) / 1e6, 2) AS hist_runtime_variance FROM orders GROUP BY 1"
)
def history_avg_var(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = tables(spark, sf_dir).table("orders").select(F.col("o_orderpriority").alias("fingerprint"), F.col("o_totalprice").alias("runtime_ms"))
    return stats.history_lookup(runs).select("fingerprint", F.round("hist_avg_runtime_ms", 2).alias("hist_avg_runtime_ms"), F.round(F.col("hist_runtime_variance") / 1e6, 2).alias("hist_runtime_variance"))


def _selectivity_row(name: str, sql: str) -> str:
    return f"SELECT '{name}' AS query_id, round(greatest(0.001, least(1.0, {sql})), 6) AS selectivity FROM orders"


@query(
    " UNION ALL ".join(
        _selectivity_row(n, s)
        for n, s in (
            ("eq", "1.0 / count(DISTINCT o_custkey)"),
            ("gt", "greatest(0.01, (max(o_totalprice) - 100000) / (max(o_totalprice) - min(o_totalprice)))"),
            ("lt", "greatest(0.01, (500 - min(o_orderkey)) / (max(o_orderkey) - min(o_orderkey)))"),
            ("in", "3.0 / count(DISTINCT o_custkey)"),
            ("like", "0.1 + 0 * count(*)"),
        )
    )
)
def selectivity_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = stats.Statistics({"orders": stats.table_stats("orders", tables(spark, sf_dir).table("orders"))})
    wheres = {"eq": where("o_custkey", "=", 5), "gt": where("o_totalprice", ">", 100000), "lt": where("o_orderkey", "<", 500), "in": where("o_custkey", "IN", [1, 2, 3]), "like": where("o_orderstatus", "LIKE", "F%")}
    subs = [(n, decompose(parse({"query_id": n, "operations": [op("s1", "FILTER", "orders", "o_orderkey", **w)]}).nodes)[0]) for n, w in wheres.items()]
    return feature_table(spark, subs, known).select("query_id", F.round("selectivity", 6).alias("selectivity"))


# Cost model, policies, metrics: on a grid of feature rows made by rule from orders

GRID_SQL = """g AS (SELECT o_orderkey, 'd' || o_orderkey % 3 AS dataset, CAST(o_orderkey % 2 AS DOUBLE) AS has_traversal, CAST(CASE WHEN o_orderkey % 2 = 1 THEN o_orderkey // 2 % 4 + 1 ELSE 0 END AS DOUBLE) AS max_hops,
 CAST(o_orderkey % 2 AS DOUBLE) AS op_count_traversal, CAST(o_orderkey // 3 % 3 AS DOUBLE) AS op_count_join, CAST(o_orderkey // 5 % 2 AS DOUBLE) AS op_count_filter, CAST(o_orderkey // 7 % 2 AS DOUBLE) AS op_count_aggregate,
 CAST(o_orderkey // 11 % 4 * 3 AS DOUBLE) AS avg_degree, (o_orderkey // 13 % 5) / 2.0 AS degree_skew, list_extract([0.001, 0.01, 0.1, 0.5], o_orderkey // 17 % 4 + 1) AS selectivity, CAST(o_orderkey // 19 % 4 + 2 AS DOUBLE) AS input_cardinality_log FROM orders)"""
COST_SQL = """c AS (SELECT *, pow(10, input_cardinality_log) AS n, CASE WHEN avg_degree > 0 THEN pow(avg_degree, least(max_hops, 3)) ELSE 0 END AS fan FROM g),
 w AS (SELECT *, max_hops * 55 + op_count_traversal * 40 + fan * 4 + degree_skew * 15 AS walk, greatest(1, floor(n * selectivity)) AS start FROM c),
 r AS (SELECT *, greatest(1.0, 10 + n * 0.001 + op_count_filter * 3 + op_count_join * (20 + n * selectivity * 0.003) + op_count_aggregate * 10 + CASE WHEN has_traversal = 0 THEN 0 WHEN selectivity < 0.005 AND max_hops <= 1.2 THEN max_hops * 4 + op_count_traversal * 4 WHEN avg_degree < 2 THEN walk * 0.3 ELSE walk END) AS sql_runtime_ms,
  greatest(1.0, CASE WHEN has_traversal = 0 THEN 35 + n * 0.004 + op_count_join * 30 + op_count_aggregate * 18 + op_count_filter * 5 ELSE 8 + start * max_hops * 0.3 + start * fan * 0.005 + op_count_aggregate * 5 + op_count_filter * 2 + op_count_join * 12
   + CASE WHEN selectivity < 0.005 AND max_hops <= 1.2 THEN 32 ELSE 0 END + CASE WHEN avg_degree < 2 THEN 18 ELSE 0 END + CASE WHEN op_count_join >= 2 AND op_count_aggregate >= 1 THEN op_count_join * 8 + op_count_aggregate * 6 ELSE 0 END END) AS graph_runtime_ms FROM w),
 l AS (SELECT *, CASE WHEN graph_runtime_ms < sql_runtime_ms THEN 'GRAPH' ELSE 'SQL' END AS label, CASE WHEN has_traversal >= 0.5 THEN 'GRAPH' ELSE 'SQL' END AS predicted, CASE WHEN has_traversal >= 0.5 AND avg_degree > 5 AND max_hops <= 3 AND selectivity >= 0.01 THEN 'GRAPH' ELSE 'SQL' END AS by_threshold,
  (o_orderkey * 37 % 101) / 100.0 AS score FROM r)"""
LABELLED = f"WITH {GRID_SQL}, {COST_SQL}"


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    part = lambda by, n: F.pmod(F.floor(k / by).cast("long"), F.lit(n))
    odd = F.pmod(k, F.lit(2))
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        k, F.concat(F.lit("d"), F.pmod(k, F.lit(3)).cast("string")).alias("dataset"), odd.cast("double").alias("has_traversal"),
        F.when(odd == 1, part(2, 4) + 1).otherwise(0).cast("double").alias("max_hops"), odd.cast("double").alias("op_count_traversal"), part(3, 3).cast("double").alias("op_count_join"),
        part(5, 2).cast("double").alias("op_count_filter"), part(7, 2).cast("double").alias("op_count_aggregate"), (part(11, 4) * 3).cast("double").alias("avg_degree"), (part(13, 5) / 2.0).alias("degree_skew"),
        F.element_at(F.array(*map(F.lit, (0.001, 0.01, 0.1, 0.5))), (part(17, 4) + 1).cast("int")).alias("selectivity"), (part(19, 4) + 2).cast("double").alias("input_cardinality_log"),
    )


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = costs.simulated(grid(spark, sf_dir))
    return made.withColumns({"predicted": policies.trivial_column(), "by_threshold": policies.Threshold().column(), "score": F.pmod(F.col("o_orderkey") * 37, F.lit(101)) / 100.0})


@query(f"{LABELLED} SELECT o_orderkey, round(sql_runtime_ms, 4) AS sql_runtime_ms, round(graph_runtime_ms, 4) AS graph_runtime_ms, label FROM l")
def cost_model_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled(spark, sf_dir).select("o_orderkey", F.round("sql_runtime_ms", 4).alias("sql_runtime_ms"), F.round("graph_runtime_ms", 4).alias("graph_runtime_ms"), "label")


@query(f"{LABELLED} SELECT o_orderkey, predicted FROM l")
def route_trivial(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled(spark, sf_dir).select("o_orderkey", "predicted")


@query(f"{LABELLED} SELECT o_orderkey, by_threshold FROM l")
def route_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled(spark, sf_dir).select("o_orderkey", "by_threshold")


@query(
    f"{LABELLED}, t AS (SELECT CAST(d AS DOUBLE) AS t_degree, CAST(h AS DOUBLE) AS t_hops, CAST(s AS DOUBLE) AS t_selectivity FROM (SELECT unnest([2.0, 5.0, 10.0, 20.0]) AS d), (SELECT unnest([1, 2, 3, 4]) AS h), (SELECT unnest([0.001, 0.01, 0.05, 0.1]) AS s)),"
    " x AS (SELECT t.*, l.label = 'GRAPH' AS y, has_traversal >= 0.5 AND avg_degree > t_degree AND max_hops <= t_hops AND selectivity >= t_selectivity AS p FROM l, t),"
    " n AS (SELECT t_degree, t_hops, t_selectivity, count(*) FILTER (y AND p) AS tp, count(*) FILTER (NOT y AND p) AS fp, count(*) FILTER (y AND NOT p) AS fn FROM x GROUP BY 1, 2, 3)"
    " SELECT *, CASE WHEN 2 * tp + fp + fn > 0 THEN round(2.0 * tp / (2 * tp + fp + fn), 6) ELSE 0 END AS f1 FROM n"
)
def threshold_grid_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policies.threshold_grid(labelled(spark, sf_dir)).withColumn("f1", F.round("f1", 6))


_RATES = "round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, CASE WHEN tp + fp > 0 THEN round(tp / (tp + fp), 6) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN round(tp / (tp + fn), 6) ELSE 0 END AS recall, CASE WHEN 2 * tp + fp + fn > 0 THEN round(2 * tp / (2 * tp + fp + fn), 6) ELSE 0 END AS f1"


@query(
    f"{LABELLED}, n AS (SELECT dataset, count(*) FILTER (label = 'GRAPH' AND predicted = 'GRAPH') AS tp, count(*) FILTER (label <> 'GRAPH' AND predicted = 'GRAPH') AS fp, count(*) FILTER (label = 'GRAPH' AND predicted <> 'GRAPH') AS fn, count(*) FILTER (label <> 'GRAPH' AND predicted <> 'GRAPH') AS tn FROM l GROUP BY 1) SELECT *, {_RATES} FROM n"
)
def confusion_by_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = metrics.confusion(labelled(spark, sf_dir), by=("dataset",))
    return found.withColumns({c: F.round(c, 6) for c in ("accuracy", "precision", "recall", "f1")})


@query(
    f"{LABELLED}, s AS (SELECT label = 'GRAPH' AS y, score >= 0.5 AS p, greatest(score, 1 - score) AS sure FROM l), t AS (SELECT unnest([0.5, 0.6, 0.7, 0.8, 0.9]) AS threshold),"
    " n AS (SELECT CAST(threshold AS DOUBLE) AS threshold, count(*) AS total, count(*) FILTER (sure >= threshold) AS covered, count(*) FILTER (sure >= threshold AND y AND p) AS tp, count(*) FILTER (sure >= threshold AND NOT y AND p) AS fp, count(*) FILTER (sure >= threshold AND y AND NOT p) AS fn FROM s, t GROUP BY 1)"
    " SELECT threshold, round(covered / total, 6) AS coverage, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1 FROM n"
)
def confidence_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = metrics.confidence_coverage(labelled(spark, sf_dir))
    return found.withColumns({c: F.round(c, 6) for c in ("coverage", "precision", "recall", "f1")})


@query(
    f"{LABELLED}, a AS (SELECT *, CASE WHEN greatest(sql_runtime_ms, graph_runtime_ms) / least(sql_runtime_ms, graph_runtime_ms) < 2 THEN 'ambiguous' WHEN sql_runtime_ms < graph_runtime_ms THEN 'unambiguous_sql' ELSE 'unambiguous_graph' END AS ambiguity FROM l)"
    " SELECT ambiguity, count(*) AS n, round(avg(CASE WHEN label = predicted THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM a GROUP BY 1"
)
def ambiguity_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.accuracy_by_ambiguity(labelled(spark, sf_dir)).withColumn("accuracy", F.round("accuracy", 6))


@query(f"{LABELLED} SELECT round(avg(pow(score - CASE WHEN label = 'GRAPH' THEN 1 ELSE 0 END, 2)), 6) AS brier FROM l")
def brier_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.brier(labelled(spark, sf_dir)).select(F.round("brier", 6).alias("brier"))


@query(
    f"{LABELLED}, p AS (SELECT score, count(*) FILTER (label = 'GRAPH') AS pos, count(*) AS n FROM l GROUP BY 1), q AS (SELECT pos, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(n) OVER (ORDER BY score DESC) AS seen FROM p) SELECT round(sum(pos * tp / seen) / sum(pos), 6) AS pr_auc FROM q"
)
def average_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.average_precision(labelled(spark, sf_dir)).select(F.round("pr_auc", 6).alias("pr_auc"))


@query(f"{LABELLED} SELECT DISTINCT dataset, label, round(sql_runtime_ms, 4) AS sql_median_ms FROM l")
def label_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labelled(spark, sf_dir).select("dataset", "label", F.round("sql_runtime_ms", 4).alias("sql_median_ms"))
    return curation.merged(rows, rows)


@query(
    f"{LABELLED}, s AS (SELECT count(*) AS n, count(*) FILTER (label = 'GRAPH') AS g, count(*) FILTER (label = 'SQL') AS q, count(DISTINCT CASE WHEN label = 'GRAPH' THEN o_orderkey END) AS u, count(DISTINCT CASE WHEN label = 'GRAPH' THEN dataset END) AS d FROM l)"
    " SELECT 'both_labels_present' AS name, g > 0 AND q > 0 AS passed FROM s UNION ALL SELECT 'min_graph_total', g >= 50 FROM s UNION ALL SELECT 'min_graph_ratio', g / n >= 0.05 FROM s UNION ALL SELECT 'graph_across_datasets', d >= 2 FROM s UNION ALL SELECT 'graph_duplication_factor', g / u <= 3 FROM s"
)
def quality_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curation.quality_gate(labelled(spark, sf_dir).withColumn("source_row_id", F.col("o_orderkey"))).select("name", "passed")


_RUNS = "runs AS (SELECT o_orderpriority AS strategy, o_totalprice AS ms, o_orderkey % 10 <> 0 AS success FROM orders), s AS (SELECT strategy, count(*) AS total_queries, count(*) FILTER (success) AS successful_queries, quantile_cont(ms, 0.5) FILTER (success) AS med, quantile_cont(ms, 0.95) FILTER (success) AS p95, avg(ms) FILTER (success) AS mean FROM runs GROUP BY 1)"


@query(
    f"WITH {_RUNS} SELECT strategy, total_queries, successful_queries, round(med, 3) AS median_latency_ms, round(p95, 3) AS p95_latency_ms, round(mean, 3) AS mean_latency_ms, round(successful_queries / total_queries, 6) AS success_rate, round((med / (SELECT med FROM s WHERE strategy = '1-URGENT') - 1) * 100, 3) AS pct_vs_reference FROM s"
)
def latency_p95_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = tables(spark, sf_dir).table("orders")
    runs = orders.select(F.col("o_orderpriority").alias("strategy"), F.col("o_totalprice").alias("median_latency_ms"), (F.pmod(F.col("o_orderkey"), F.lit(10)) != 0).alias("success"))
    found = metrics.strategy_table(runs, "1-URGENT")
    return found.withColumns({c: F.round(c, 3) for c in ("median_latency_ms", "p95_latency_ms", "mean_latency_ms", "pct_vs_reference")} | {"success_rate": F.round("success_rate", 6)})


@query(f"{LABELLED}, m AS (SELECT o_orderkey, predicted AS a, by_threshold AS b FROM l) SELECT round(avg(CASE WHEN a = b THEN 1.0 ELSE 0.0 END), 6) AS agreement, count(*) AS n FROM m")
def engine_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labelled(spark, sf_dir)
    one, other = rows.select("o_orderkey", F.col("predicted").alias("engines_used")), rows.select("o_orderkey", F.col("by_threshold").alias("engines_used"))
    return metrics.agreement(one, other, "o_orderkey").withColumn("agreement", F.round("agreement", 6))


@query(
    "WITH c AS (SELECT md5(concat_ws(chr(31), CAST(c_custkey AS VARCHAR), c_mktsegment, c_name, CAST(c_nationkey AS VARCHAR))) AS h FROM customer) SELECT count(*) AS row_count, CAST(sum(CAST('0x' || substr(h, 1, 12) AS BIGINT)) AS VARCHAR) AS checksum FROM c"
)
def result_checksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.checksum(tables(spark, sf_dir).table("customer").select("c_name", "c_custkey", "c_nationkey", "c_mktsegment"))


@query(
    "WITH a AS (SELECT c_custkey, c_nationkey, c_mktsegment FROM customer), b AS (SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN c_nationkey + 100 ELSE c_nationkey END AS c_nationkey, c_mktsegment FROM customer WHERE c_mktsegment <> 'BUILDING' UNION ALL SELECT c_custkey, c_nationkey, c_mktsegment FROM customer WHERE c_mktsegment = 'MACHINERY') "
    "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, CAST(c_nationkey AS VARCHAR) AS c_nationkey, c_mktsegment, 'left' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT CAST(c_custkey AS VARCHAR), CAST(c_nationkey AS VARCHAR), c_mktsegment, 'right' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)"
)
def result_differences_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All customers against a version with rows changed, dropped and repeated."""
    customer = tables(spark, sf_dir).table("customer").select("c_custkey", "c_nationkey", "c_mktsegment", "c_acctbal")
    changed = customer.where("c_mktsegment <> 'BUILDING'").withColumn("c_nationkey", F.expr("CASE WHEN c_acctbal < 0 THEN c_nationkey + 100 ELSE c_nationkey END"))
    return compare.differences(customer.drop("c_acctbal"), changed.union(customer.where("c_mktsegment = 'MACHINERY'")).drop("c_acctbal"))


@query("WITH c AS (SELECT CAST(o_orderkey % 4 AS INTEGER) AS k, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_totalprice END AS s, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_totalprice * (o_orderkey % 7) / 3 END AS g, o_orderkey FROM orders), m AS (SELECT o_orderkey, s, CASE WHEN k = 0 THEN NULL ELSE g END AS g, CASE WHEN k = 0 THEN 'RELATIONAL' ELSE 'TRAVERSAL' END AS p FROM c), f AS (SELECT o_orderkey, coalesce(s, g * 3) AS s2, coalesce(g, s * 3) AS g2 FROM m WHERE s IS NOT NULL OR g IS NOT NULL) SELECT o_orderkey, CASE WHEN g2 < s2 THEN 'GRAPH' ELSE 'SQL' END AS label FROM f")
def measured_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, price = F.col("o_orderkey"), F.col("o_totalprice")
    runs = tables(spark, sf_dir).table("orders").select(
        k, F.when(k % 3 != 0, price).alias("sql_median_ms"), F.when(k % 5 != 0, price * (k % 7) / 3).alias("graph_median_ms"), F.when(k % 4 == 0, "RELATIONAL").otherwise("TRAVERSAL").alias("primary")
    )
    return costs.labelled(runs).select("o_orderkey", "label")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


from lattica import catalog_tools  # noqa: E402, F401  registers its queries
