"""Registered queries of the loaders, generators, document tools, routing and evaluation kit, with their SQL."""

from __future__ import annotations

import json
import tempfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.catalog import LABELLED, LINKS, PEOPLE, dsl, labelled, link, op, query, reach, social, tables, where, group, walk
from lattica.dsl.nodes import parse, parse_file
from lattica.evalkit import compare, costs, curation, learning, metrics, workloads
from lattica.functions import stats
from lattica.functions.features import FEATURES, feature_table
from lattica.operators.traversal import traversed
from lattica.plans.decompose import decompose, levels
from lattica.plans.engine import Engine, metadata
from lattica.routing import policies
from lattica.sources import etl
from lattica.sources.store import fresh_path


def values(columns: str, rows: Sequence[tuple]) -> str:
    """SQL for literal rows."""
    text = lambda v: "NULL" if v is None else str(v).upper() if isinstance(v, bool) else f"'{v}'" if isinstance(v, str) else str(v)
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(text, r)) + ')' for r in rows)}) AS t({columns})"


def hash_sql(salt: int | str, *columns: str) -> str:
    parts = ", ".join(f"CAST({c} AS VARCHAR)" for c in columns)
    return f"CAST('0x' || substr(md5(concat_ws(':', '{salt}', {parts})), 1, 12) AS BIGINT)"


def draw_sql(salt: int | str, *columns: str) -> str:
    return f"(({hash_sql(salt, *columns)} + 0.5::DOUBLE) / 281474976710656.0::DOUBLE)"


# Sources and sinks


def text_of(spark: SparkSession, df: DataFrame, separator: str, end: str = "") -> str:
    """``df`` as lines of text in the shared folder."""
    path = fresh_path(spark, "text")
    df.select(F.concat(F.concat_ws(separator, *[F.col(c).cast("string") for c in df.columns]), F.lit(end))).write.text(path)
    return path


@query("SELECT c_custkey, c_name FROM customer WHERE c_nationkey = 7")
def table_by_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Engine(spark, tables(spark, sf_dir)).run({"query_id": "q", "operations": [op("s1", "FILTER", f"{sf_dir}/customer.parquet", "c_custkey c_name", **where("c_nationkey", "=", 7))]})


@query("SELECT CAST(c_custkey AS INTEGER) AS c_custkey, c_name, 'road ' || c_custkey AS c_address, c_nationkey, '555' AS c_phone, c_acctbal, c_mktsegment, 'none' AS c_comment FROM customer")
def load_tbl(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = tables(spark, sf_dir).table("customer").select("c_custkey", "c_name", F.concat(F.lit("road "), "c_custkey"), "c_nationkey", F.lit("555").alias("p"), "c_acctbal", "c_mktsegment", F.lit("none").alias("n"))
    return etl.read_tbl(spark, text_of(spark, made, "|", "|"), etl.TPCH["customer"])


@query("SELECT CAST(o_orderkey AS INTEGER) AS c0, o_orderstatus AS c1, o_totalprice AS c2 FROM orders")
def load_dat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return etl.read_headerless(spark, text_of(spark, tables(spark, sf_dir).table("orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), "|", "|"), "|")


@query("SELECT CAST(o_orderkey AS INTEGER) AS c0, o_orderpriority AS c1, 'a,b' AS c2 FROM orders")
def load_sniffed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return etl.read_headerless(spark, text_of(spark, tables(spark, sf_dir).table("orders").select("o_orderkey", "o_orderpriority", F.lit("a,b").alias("t")), "\t"))


@query("WITH e AS (SELECT DISTINCT o_custkey AS a, o_orderkey * 7 % 1000 AS b FROM orders) SELECT CAST(a AS INTEGER) AS src, CAST(b AS INTEGER) AS dst, 'KNOWS' AS relationship FROM e UNION SELECT CAST(b AS INTEGER), CAST(a AS INTEGER), 'KNOWS' FROM e")
def load_network_simple(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "knows")
    etl.written_csv(tables(spark, sf_dir).table("orders").select(F.col("o_custkey").alias("Person.id"), F.expr("o_orderkey * 7 % 1000").alias("Other.id")), path)
    return etl.symmetric(etl.knows_edges(etl.read_with_header(spark, path, ",", "a int, b int")))


def _official(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The driver's tables under an official layout's names, partly as text and partly as Parquet, loaded again."""
    folder, found = fresh_path(spark, "official"), tables(spark, sf_dir)
    customer, orders = found.table("customer"), found.table("orders")
    length = F.col("o_totalprice").cast("int").alias("length")
    for entity, df in {
        "Person": customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("firstName"), F.col("c_nationkey").alias("LocationCityId")),
        "Post": orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("CreatorPersonId"), length, F.lit("2020").alias("creationDate")),
        "Person_workAt_Company": customer.select(F.col("c_custkey").alias("PersonId"), F.col("c_nationkey").alias("CompanyId")),
        "Person_knows_Person": orders.select(F.col("o_custkey").alias("Person1Id"), F.expr("o_orderkey * 7 % 1000").alias("Person2Id")),
    }.items():
        df.write.csv(f"{folder}/{entity}", sep="|", header=True)
    etl.written(orders.select(F.col("o_orderkey").alias("id"), F.expr("o_custkey * 3 % 1000").alias("CreatorPersonId"), F.col("o_orderkey").alias("ParentPostId"), length), f"{folder}/Comment")
    return etl.official_network(spark, folder)


@query("WITH e AS (SELECT DISTINCT o_custkey AS a, o_orderkey * 7 % 1000 AS b FROM orders) SELECT CAST(a AS INTEGER) AS src, CAST(b AS INTEGER) AS dst, 'KNOWS' AS relationship FROM e UNION SELECT CAST(b AS INTEGER), CAST(a AS INTEGER), 'KNOWS' FROM e")
def official_knows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _official(spark, sf_dir)["knows"]


@query("SELECT o_orderkey AS message_id, o_custkey AS sender_id, CAST(trunc(o_totalprice) AS INTEGER) AS content_length FROM orders UNION ALL SELECT o_orderkey, o_custkey * 3 % 1000, CAST(trunc(o_totalprice) AS INTEGER) FROM orders")
def official_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _official(spark, sf_dir)["messages"]


@query("SELECT CAST(c_custkey AS INTEGER) AS person_id, c_nationkey AS organisation_id, CAST(c_nationkey AS VARCHAR) AS company_name FROM customer")
def official_works_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _official(spark, sf_dir)["works_at"]


@query("SELECT DISTINCT o_custkey AS src, o_orderkey AS dst, 'KNOWS' AS relationship FROM orders UNION SELECT o_custkey, 7, 'KNOWS' FROM orders")
def graph_edge_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    pair = F.array(F.array("o_custkey", "o_custkey"), F.array("o_orderkey", F.lit(7).cast("long")))
    return etl.edge_index(tables(spark, sf_dir).table("orders").select(pair.alias("edge_index")))


_PROJECTED = "e AS (SELECT DISTINCT 'name:key:' || l_partkey AS src, 'title:key:' || l_suppkey AS dst, 'CAST' AS relationship FROM lineitem UNION SELECT 'title:key:' || o_orderkey, 'company_name:key:' || o_custkey, 'PRODUCED_BY' FROM orders)"


def _job(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    found = tables(spark, sf_dir)
    made = {"cast_info": found.table("lineitem").select(F.col("l_partkey").alias("c1"), F.col("l_suppkey").alias("c2")), "movie_companies": found.table("orders").select(F.col("o_orderkey").alias("c1"), F.col("o_custkey").alias("c2"))}
    return etl.projected_graph(made.__getitem__, etl.PROJECTIONS["job"])


@query(f"WITH {_PROJECTED} SELECT * FROM e")
def graph_of_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _job(spark, sf_dir)[1]


@query(f"WITH {_PROJECTED} SELECT src AS id FROM e UNION SELECT dst FROM e")
def vertices_of_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _job(spark, sf_dir)[0]


_UNIT = "1073741824"
_POWER = (
    f"e AS (SELECT DISTINCT src, CAST(floor(src * d * d) AS BIGINT) AS dst FROM (SELECT src, ({hash_sql('edge42', 'src', 'k')} % {_UNIT}) / {_UNIT}.0::DOUBLE AS d FROM range(1, 2000) s(src), range(1, 6) t(k))), g AS (SELECT src, count(*) AS degree FROM e GROUP BY 1)"
)


@query(f"WITH {_POWER} SELECT round(avg(degree), 6) AS avg_degree, CAST(max(degree) AS DOUBLE) AS max_degree, round(stddev_samp(degree), 6) AS stddev_degree, CAST(2000 AS BIGINT) AS vertex_count, CAST(sum(degree) AS BIGINT) AS edge_count FROM g")
def power_law_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, e = etl.power_law_graph(spark, 2000, 10)
    return stats.graph_stats(e, v).withColumns({c: F.round(c, 6) for c in ("avg_degree", "stddev_degree")})


def _listed(names: Sequence[str], salt: str) -> str:
    return f"list_extract([{', '.join(repr(n) for n in names)}], CAST({hash_sql(salt, 'i')} % {len(names)} + 1 AS INTEGER))"


@query(
    f"SELECT CAST(i AS INTEGER) AS person_id, 'Person_' || i AS name, {_listed(['Berlin', 'Paris', 'Madrid', 'Rome', 'London'], 'place42')} AS city, {_listed(['Germany', 'France', 'Spain', 'Italy', 'UK'], 'place42')} AS country, CAST(18 + {hash_sql('age42', 'i')} % 60 AS INTEGER) AS age FROM range(0, 500) t(i)"
)
def generated_persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return etl.social_network(spark, 500)["person"]


@query(
    f"SELECT CAST(i AS INTEGER) AS message_id, CAST({hash_sql('post42', 'i')} % 500 AS INTEGER) AS sender_id, CAST(10 + {hash_sql('len', 'i')} % 490 AS INTEGER) AS content_length FROM range(0, 2500) t(i) UNION ALL SELECT CAST(i AS INTEGER), CAST({hash_sql('comment42', 'i')} % 500 AS INTEGER), CAST(5 + {hash_sql('clen', 'i')} % 195 AS INTEGER) FROM range(0, 4000) t(i)"
)
def generated_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return etl.social_network(spark, 500)["messages"]


@query(f"SELECT DISTINCT CAST(a AS INTEGER) AS src, CAST(b AS INTEGER) AS dst, 'KNOWS' AS relationship FROM (SELECT {hash_sql('a42', 'i')} % 500 AS a, {hash_sql('b', 'i + 7')} % 500 AS b FROM range(0, 5000) t(i)) WHERE a <> b")
def generated_knows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return etl.social_network(spark, 500)["knows"]


@query(
    "SELECT o_orderkey, o_custkey, o_totalprice, list_extract(['1-URGENT','2-HIGH','3-MEDIUM','4-NOT SPECIFIED','5-LOW'], CAST(o_orderkey % 5 + 1 AS INTEGER)) AS o_orderpriority, list_extract(['F','O','P'], CAST(o_orderkey % 3 + 1 AS INTEGER)) AS o_orderstatus FROM orders"
)
def compat_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return etl.compatible_orders(tables(spark, sf_dir).table("orders"), "o_custkey", "o_totalprice", number="o_orderkey")


@query("SELECT c_custkey AS person_id, c_name AS name, c_nationkey AS country, CAST(c_nationkey AS VARCHAR) AS company_name FROM customer")
def enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = tables(spark, sf_dir).table("person")
    person = etl.enriched_person(people.select("person_id", "name"), people.select("id", "country"))
    works = etl.enriched_works_at(people.select("person_id", F.col("country").alias("organisation_id")))
    return person.join(works.select("person_id", "company_name"), "person_id")


@query("SELECT c_custkey, c_name FROM customer WHERE c_acctbal > 5000")
def query_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    document = {"query_id": "rich", "operations": [op("s1", "FILTER", "customer", "c_custkey c_name", **where("c_acctbal", ">", 5000))]}
    with tempfile.NamedTemporaryFile("w", suffix=".json") as f:  # a query file is the driver's own
        json.dump([document, document | {"query_id": "other"}], f)
        f.flush()
        return Engine(spark, tables(spark, sf_dir)).run(parse_file(f.name)["rich"])


@query("SELECT 'orders' AS table_name, count(*) AS row_count, CAST(6 AS BIGINT) AS column_count FROM orders")
def stats_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{fresh_path(spark, 'stats')}/orders_stats.json"
    compare.written_json(stats.table_stats("orders", tables(spark, sf_dir).table("orders")), spark, path)
    return spark.read.schema("table_name string, row_count long, column_count long").json(path)


@query(values("query_id, missing", [("good", ""), ("bad", "nowhere,nothing_graph")]))
def missing_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tables(spark, sf_dir)
    good = [op("s1", "JOIN", "orders", "o_orderkey", **link("customer", "o_custkey", "c_custkey"))]
    bad = [op("s1", "JOIN", "orders", "o_orderkey", **link("nowhere", "o_custkey", "c_custkey")), op("s2", "TRAVERSAL", "nothing_graph", "id", **walk("id", 1, "OUT", 1))]
    rows = [(n, ",".join(sorted(found.missing(parse({"query_id": n, "operations": ops})), reverse=True))) for n, ops in (("good", good), ("bad", bad))]
    return spark.createDataFrame(rows, "query_id string, missing string")


@query(reach(f"{LINKS}, {PEOPLE}", "SELECT id, 0 AS d FROM people WHERE id = 3", "OUT", 2) + " SELECT id FROM people JOIN reached USING (id)")
def graph_cached(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = tables(spark, sf_dir).graph("social_graph", cached=True)
    return traversed(graph, {"start_vertex_filter": {"column": "id", "value": 3}, "direction": "OUT", "max_hops": 2, "return_fields": ["id"]})


# Predicates of every type of column, lenient filters, traversals without a start

_MADE = "made AS (SELECT c_custkey, CAST(c_custkey % 10 / 10.0 AS FLOAT) AS x, c_custkey + 9007199254740990 AS big, CAST(c_acctbal AS DECIMAL(12, 2)) AS d, c_nationkey AS n FROM customer)"


def _typed(name: str, column: str, operator: str, value: object, sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = tables(spark, sf_dir)
        k = F.col("c_custkey")
        found.put("made", found.table("customer").select(k, (k % 10 / 10.0).cast("float").alias("x"), (k + 9007199254740990).alias("big"), F.col("c_acctbal").cast("decimal(12,2)").alias("d"), F.col("c_nationkey").alias("n")))
        return Engine(spark, found).run({"query_id": name, "operations": [op("s1", "FILTER", "made", "c_custkey", **where(column, operator, value))]})

    run.__name__ = name
    query(f"WITH {_MADE} SELECT c_custkey FROM made WHERE {sql}")(run)


_typed("filter_float", "x", "=", 0.1, "x = CAST(0.1 AS FLOAT)")
_typed("filter_float_in", "x", "IN", [0.3, "0.7", 5], "x IN (CAST(0.3 AS FLOAT), CAST(0.7 AS FLOAT))")
_typed("filter_bigint_text", "big", "=", "9007199254740993", "big = 9007199254740993")
_typed("filter_bigint_range", "big", ">", 9007199254741001, "big > 9007199254741001")
_typed("filter_decimal", "d", ">=", "1234.56", "d >= 1234.56")
_typed("filter_decimal_le", "d", "<=", 250.25, "d <= 250.25")
_typed("filter_int_fraction", "n", "<", 6.5, "n < 6.5")
_typed("filter_int_text", "n", "=", " 7 ", "n = 7")


@query("SELECT c_custkey, c_name FROM customer")
def filter_lenient(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With strict=False a filter on a column that isn't there keeps every row."""
    return Engine(spark, tables(spark, sf_dir), strict=False).run({"query_id": "q", "operations": [op("s1", "FILTER", "customer", "c_custkey c_name", **where("no_such_column", "=", 1))]})


dsl(
    "traverse_start_ne",
    [op("s1", "TRAVERSAL", "social_graph", "", traversal={"start_vertex_filter": {"column": "country", "value": 7, "operator": "!="}, "edge_label": "", "direction": "OUT", "max_hops": 1, "return_fields": ["id"]})],
    reach(f"{LINKS}, {PEOPLE}", "SELECT id, 0 AS d FROM people WHERE country <> 7", "OUT", 1) + " SELECT id FROM people JOIN reached USING (id)",
)


@query(reach(f"{LINKS}, {PEOPLE}", "SELECT id, 0 AS d FROM people", "OUT", 1) + " SELECT id, name FROM people JOIN reached USING (id)")
def traverse_no_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traversed(tables(spark, sf_dir).graph("social_graph"), {"direction": "OUT", "max_hops": 1, "return_fields": ["id", "name"]})


dsl(
    "traverse_strategies_agree",
    [op("s1", "TRAVERSAL", "social_graph", "", **walk("city", "BUILDING", "BOTH", 3, "F"))],
    reach(f"{LINKS}, {PEOPLE}", "SELECT id, 0 AS d FROM people WHERE city = 'BUILDING'", "BOTH", 3, "F") + " SELECT id FROM people JOIN reached USING (id)",
)


@query("SELECT 'big' AS column_name, count(*) AS row_count, count(DISTINCT c_custkey) AS distinct_count, CAST(min(c_custkey + 9007199254740990) AS DOUBLE) AS min, CAST(max(c_custkey + 9007199254740990) AS DOUBLE) AS max FROM customer")
def stats_of_large_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.column_stats(tables(spark, sf_dir).table("customer").select((F.col("c_custkey") + 9007199254740990).alias("big")))


@query("SELECT 'orders' AS name, count(*) AS row_count, count(DISTINCT o_custkey) AS customers, CAST(min(o_totalprice) AS DOUBLE) AS least FROM orders UNION ALL SELECT 'nowhere', 0, NULL, NULL")
def stats_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = stats.Statistics.load([("orders_stats", json.dumps(stats.table_stats("orders", tables(spark, sf_dir).table("orders"))))])
    rows = [(n, known.rows(n), known.column(n, "o_custkey").get("distinct_count"), known.column(n, "o_totalprice").get("min")) for n in ("orders", "nowhere")]
    return spark.createDataFrame(rows, "name string, row_count long, customers long, least double")


# Documents: validation, order, decomposition, features, decisions

KEEP = op("s1", "FILTER", "customer", "c_custkey", **where("c_nationkey", "=", 7))
INVALID = {
    "no_operations": [],
    "unknown_type": [op("s1", "SORT", "customer")],
    "unknown_operator": [op("s1", "FILTER", "customer", **where("c_custkey", "~", 1))],
    "unknown_function": [op("s1", "AGGREGATE", "customer", **group("", "MEDIAN c_acctbal"))],
    "unknown_join": [op("s1", "JOIN", "customer", **link("orders", "c_custkey", "o_custkey", "CROSS"))],
    "no_hops": [op("s1", "TRAVERSAL", "social_graph", **walk("id", 1, "OUT", 0))],
    "duplicate_id": [KEEP, KEEP],
    "unknown_dependency": [KEEP | {"depends_on": ["s9"]}],
    "circle": [KEEP | {"depends_on": ["s2"]}, KEEP | {"op_id": "s2", "depends_on": ["s1"]}],
    "unknown_table": [op("s1", "FILTER", "no_table", "x")],
    "no_number": [op("s1", "FILTER", "customer", "c_custkey", **where("c_custkey", "=", "seven"))],
    "good": [KEEP],
}


@query(values("query_id, error", [(n, e) for n, e in zip(INVALID, ["QueryError"] * 8 + ["CycleError", "MissingTable", "ColumnError", None], strict=True)]))
def invalid_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of a batch, each with its own query; the others run."""
    results = Engine(spark, tables(spark, sf_dir)).run_batch([{"query_id": n, "operations": ops} for n, ops in INVALID.items()])
    return metadata(spark, results).select("query_id", F.substring_index("error", ":", 1).alias("error"))


CORPUS = {
    "chain": [op("s3", "AGGREGATE", "s2", "c_name", "s2", **group("c_name", "SUM o_totalprice")), op("s2", "JOIN", "orders", "o_orderkey c_name", "s1", **link("s1", "o_custkey", "c_custkey")), KEEP],
    "walk": [op("s1", "TRAVERSAL", "social_graph", "id name", **walk("id", 1, "OUT", 2))],
    "mixed": [
        op("s1", "TRAVERSAL", "social_graph", "id", **walk("id", 1, "BOTH", 1)),
        op("s2", "FILTER", "orders", "o_custkey", **where("o_totalprice", ">", 100000)),
        op("s3", "JOIN", "s1", "id o_custkey", "s1 s2", **link("s2", "id", "o_custkey")),
        op("s4", "TRAVERSAL", "social_graph", "id", "s3", **walk("id", 2, "OUT", 5)),
    ],
    "maps": [op("s1", "MAP", "customer", "c_custkey c_nationkey c_acctbal"), op("s2", "FILTER", "s1", "c_custkey", "s1", **where("c_nationkey", "IN", [1, 2, 3]))],
}


@query(
    values(
        "query_id, sub_id, ops, primary_kind, depends_on, level, parallelizable",
        [
            ("chain", "sub_0", "s1,s2,s3", "RELATIONAL", "", 0, True),
            ("walk", "sub_0", "s1", "TRAVERSAL", "", 0, True),
            ("mixed", "sub_0", "s1", "TRAVERSAL", "", 0, True),
            ("mixed", "sub_1", "s2,s3", "RELATIONAL", "sub_0", 1, False),
            ("mixed", "sub_2", "s4", "TRAVERSAL", "sub_1", 2, False),
            ("maps", "sub_0", "s1,s2", "RELATIONAL", "", 0, True),
        ],
    )
)
def decomposed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operations in topological order, their groups, and the level at which a group can run."""
    rows = []
    for name, operations in CORPUS.items():
        subs = decompose(parse({"query_id": name, "operations": operations}).nodes)
        level = {s.sub_id: i for i, some in enumerate(levels(subs)) for s in some}
        rows += [(name, s.sub_id, ",".join(n.op_id for n in s.nodes), s.primary, ",".join(s.depends_on), level[s.sub_id], s.parallelizable) for s in subs]
    return spark.createDataFrame(rows, "query_id string, sub_id string, ops string, primary_kind string, depends_on string, level int, parallelizable boolean")


def _known(spark: SparkSession, sf_dir: str) -> stats.Statistics:
    found = tables(spark, sf_dir)
    graph = found.graph("social_graph")
    return stats.Statistics({t: stats.table_stats(t, found.table(t)) for t in ("customer", "orders")}, {"social_graph": stats.graph_stats(graph.edges, graph.vertices).first().asDict()})


def _subs() -> list[tuple[str, object]]:
    return [(n, s) for n, ops in CORPUS.items() for s in decompose(parse({"query_id": n, "operations": ops}).nodes)]


def _features_sql() -> str:
    """The 22 features of CORPUS: counts as they stand in the documents, figures from the tables by SQL."""
    # query, group, filters, joins, traversals, aggregates, maps, depth, hops, rows, kept, fields, key filter, tables, graph
    rows = (
        ("chain", "sub_0", 1, 1, 0, 1, 0, 3, 0, "customers", "1.0 / nations", 1, 1, 2, False),
        ("walk", "sub_0", 0, 0, 1, 0, 0, 1, 2, "vertices", "1.0 / vertices", 2, 0, 1, True),
        ("mixed", "sub_0", 0, 0, 1, 0, 0, 1, 1, "vertices", "1.0 / vertices", 1, 0, 1, True),
        ("mixed", "sub_1", 1, 1, 0, 0, 0, 2, 0, "n_orders", "greatest(0.01, (most - 100000) / (most - least))", 2, 0, 2, False),
        ("mixed", "sub_2", 0, 0, 1, 0, 0, 1, 5, "vertices", "1.0 / vertices", 1, 0, 1, True),
        ("maps", "sub_0", 1, 0, 0, 0, 1, 2, 0, "customers", "3.0 / nations", 1, 1, 1, False),
    )
    parts = []
    for name, sub, filters, joins, walks, groups, maps, depth, hops, n, kept, fields, key, names, graph in rows:
        share, out = f"greatest(0.001, least(1.0, {kept}))", f"greatest(1, floor({n} * greatest(0.001, least(1.0, {kept}))))"
        degree, most, skew = ("avg_degree", "max_degree", "stddev_degree / avg_degree") if graph else ("0.0", "0.0", "0.0")
        figures = (
            filters, joins, walks, groups, maps, depth, walks, hops, f"log10({n} + 1)", f"log10({out} + 1)", share, degree, most, skew, fields, key, 1.0,
            f"log10({out} * {fields} * 8 + 1)", f"{out} * pow(avg_degree, {hops})" if graph else 0, -1, -1, names,
        )
        parts.append(f"SELECT '{name}' AS query_id, '{sub}' AS sub_id, " + ", ".join(f"round(CAST({v} AS DOUBLE), 4) AS {c}" for v, c in zip(figures, FEATURES, strict=True)) + " FROM c, o, g, v")
    return (
        f"WITH {LINKS}, c AS (SELECT count(*) AS customers, count(DISTINCT c_nationkey) AS nations FROM customer), o AS (SELECT count(*) AS n_orders, min(o_totalprice) AS least, max(o_totalprice) AS most FROM orders),"
        " g AS (SELECT avg(d) AS avg_degree, max(d) AS max_degree, stddev_samp(d) AS stddev_degree FROM (SELECT count(*) AS d FROM edges GROUP BY src)), v AS (SELECT count(*) AS vertices FROM customer) " + " UNION ALL ".join(parts)
    )


@query(_features_sql())
def features_of_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feature_table(spark, _subs(), _known(spark, sf_dir)).drop("fingerprint").withColumns({c: F.round(c, 4) for c in FEATURES})


@query(values("query_id, sub_id, trivial, threshold, by_depth", [("chain", "sub_0", "SQL", "SQL", "SQL"), ("walk", "sub_0", "GRAPH", "SQL", "SQL"), ("mixed", "sub_0", "GRAPH", "SQL", "SQL"), ("mixed", "sub_1", "SQL", "SQL", "SQL"), ("mixed", "sub_2", "GRAPH", "SQL", "GRAPH"), ("maps", "sub_0", "SQL", "SQL", "SQL")]))
def routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each policy's decision for every group of operations, as the engine's metadata has them."""
    found, known = tables(spark, sf_dir), _known(spark, sf_dir)
    ways = {"trivial": policies.trivial, "threshold": policies.thresholded(known, policies.Threshold(5.0, 3, 0.01)), "by_depth": None}
    out = None
    for name, policy in ways.items():
        results = Engine(spark, found, policy).run_batch([{"query_id": q, "operations": ops} for q, ops in CORPUS.items()])
        one = metadata(spark, results).where("sub_ms >= 0 and parse_ms >= 0 and decompose_ms >= 0 and error is null").select("query_id", "sub_id", F.col("engine").alias(name))
        out = one if out is None else out.join(one, ["query_id", "sub_id"])
    return out


# Labelled rows


@query("WITH d AS (SELECT o_orderkey % 2 AS k, o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'simulated' ELSE 'real_measurement' END AS s, 'd' || o_orderkey % 4 AS dataset FROM orders) SELECT DISTINCT dataset, o_orderkey AS query_id FROM d WHERE s = 'real_measurement' AND dataset IN ('d1', 'd2')")
def validated_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    rows = tables(spark, sf_dir).table("orders").select(F.concat(F.lit("d"), (k % 4).cast("string")).alias("dataset"), k.alias("query_id"), F.when(k % 3 == 0, "simulated").otherwise("real_measurement").alias("label_source"))
    return curation.validated([rows.where("query_id % 2 = 0"), rows, rows.where("query_id % 5 = 0")], ["d1", "d2"]).select("dataset", "query_id")


@query(
    f"{LABELLED}, ranked AS (SELECT o_orderkey, label, row_number() OVER (PARTITION BY label ORDER BY {draw_sql(42, 'o_orderkey')}, o_orderkey) AS k, greatest(5, round(count(*) OVER (PARTITION BY label) * 0.2)) AS need FROM l) SELECT o_orderkey, label, CASE WHEN k <= need THEN 'eval' ELSE 'train' END AS part FROM ranked"
)
def row_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curation.split_by_row(labelled(spark, sf_dir).select("o_orderkey", "label"), ("o_orderkey",), 0.2, least=5)


@query(
    f"{LABELLED}, n AS (SELECT o_orderkey // 10 AS query_id, label, count(*) AS n, {draw_sql(42, 'query_id')} AS u FROM l GROUP BY 1, 2),"
    " x AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY label ORDER BY u, query_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 30 AS needed FROM n),"
    " gs AS (SELECT query_id, u, sum(n) AS n, max(needed) AS needed FROM x GROUP BY 1, 2),"
    " p AS (SELECT query_id, needed OR coalesce(sum(n) OVER (ORDER BY needed DESC, u, query_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < greatest(1, round((SELECT count(*) FROM l) * 0.2)) AS e FROM gs)"
    " SELECT o_orderkey, CASE WHEN e THEN 'eval' ELSE 'train' END AS part FROM l JOIN p ON query_id = o_orderkey // 10"
)
def group_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labelled(spark, sf_dir).withColumn("query_id", F.floor(F.col("o_orderkey") / 10))
    return curation.split_by_group(rows, "query_id", least=30).select("o_orderkey", "part")


@query(f"{LABELLED} SELECT o_orderkey, label, copy FROM l, (SELECT unnest([0, 1, 2]) AS copy) WHERE label = 'GRAPH' OR copy = 0")
def upsampled_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curation.upsampled(labelled(spark, sf_dir).select("o_orderkey", "label"), times=3)


@query(
    f"SELECT o_orderkey, copy, round(o_totalprice * (1 + 0.05 * sqrt(-2 * ln({draw_sql('42:o_totalprice:r', 'o_orderkey', 'copy')})) * cos(2 * 3.141592653589793 * {draw_sql('42:o_totalprice:a', 'o_orderkey', 'copy')})), 4) AS o_totalprice FROM orders, (SELECT unnest([0, 1, 2]) AS copy)"
)
def augmented_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = costs.augmented(tables(spark, sf_dir).table("orders").select("o_orderkey", "o_totalprice"), ["o_totalprice"], "o_orderkey", 3)
    return made.select("o_orderkey", "copy", F.round("o_totalprice", 4).alias("o_totalprice"))


_CUTS = [0.36787944117144233 * sum(1 / f for f in (1, 1, 2, 6, 24, 120, 720, 5040, 40320)[: k + 1]) for k in range(9)]


@query(
    f"{LABELLED}, x AS (SELECT label = 'GRAPH' AS t, predicted = 'GRAPH' AS s, replicate, {draw_sql(42, 'o_orderkey', 'replicate')} AS u FROM l, range(1, 21) r(replicate)),"
    f" weighed AS (SELECT *, {' + '.join(f'CASE WHEN u > {c!r} THEN 1 ELSE 0 END' for c in _CUTS)} AS w FROM x),"
    " n AS (SELECT replicate, sum(w) FILTER (t AND s) AS tp, sum(w) FILTER (NOT t AND s) AS fp, sum(w) FILTER (t AND NOT s) AS fn FROM weighed GROUP BY 1),"
    " f AS (SELECT 2 * coalesce(tp, 0) / (2 * coalesce(tp, 0) + coalesce(fp, 0) + coalesce(fn, 0)) AS f1 FROM n)"
    " SELECT round(quantile_cont(f1, 0.025), 6) AS f1_low, round(quantile_cont(f1, 0.5), 6) AS f1_mid, round(quantile_cont(f1, 0.975), 6) AS f1_high FROM f"
)
def bootstrap_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = metrics.bootstrap(labelled(spark, sf_dir), 20, key="o_orderkey")
    return found.select(*[F.round(c, 6).alias(c) for c in found.columns])


@query(
    f"{LABELLED}, ranked AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {draw_sql(42, 'o_orderkey')}, o_orderkey) AS k, greatest(1, round(count(*) OVER (PARTITION BY label) * 0.2)) AS need FROM l), h AS (SELECT * FROM ranked WHERE k <= need),"
    " t AS (SELECT CAST(d AS DOUBLE) AS t_degree, CAST(h AS DOUBLE) AS t_hops, CAST(s AS DOUBLE) AS t_selectivity FROM (SELECT unnest([2.0, 5.0, 10.0, 20.0]) AS d), (SELECT unnest([1, 2, 3, 4]) AS h), (SELECT unnest([0.001, 0.01, 0.05, 0.1]) AS s)),"
    " x AS (SELECT t.*, h.label = 'GRAPH' AS y, has_traversal >= 0.5 AND avg_degree > t_degree AND max_hops <= t_hops AND selectivity >= t_selectivity AS p FROM h, t),"
    " n AS (SELECT t_degree, t_hops, t_selectivity, count(*) FILTER (y AND p) AS tp, count(*) FILTER (y <> p) AS off FROM x GROUP BY 1, 2, 3)"
    " SELECT t_degree AS avg_degree, t_hops AS max_hops, t_selectivity AS selectivity FROM n ORDER BY CASE WHEN 2 * tp + off > 0 THEN 2.0 * tp / (2 * tp + off) ELSE 0 END DESC, 1, 2, 3 LIMIT 1"
)
def threshold_tuned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best thresholds on a fifth of each label's rows."""
    best = policies.tuned(labelled(spark, sf_dir), 0.2, ("o_orderkey",))
    return spark.createDataFrame([(best.avg_degree, float(best.max_hops), best.selectivity)], "avg_degree double, max_hops double, selectivity double")


@query(
    "SELECT 'q~hops=' || h || '~join=' || j || '~kept=' || k AS query_id, h AS hops, j AS join_type, round(100 - 100 * k, 6) AS bound FROM (SELECT unnest([1, 2, 3, 4]) AS h), (SELECT unnest(['INNER', 'LEFT']) AS j), (SELECT unnest([0.01, 0.05, 0.1, 0.25, 0.5]) AS k, unnest(['0.01', '0.05', '0.1', '0.25', '0.5']) AS text) WHERE k > 0"
    .replace("|| k AS query_id", "|| text AS query_id")
)
def query_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = [op("s1", "FILTER", "t", **where("a", ">", 7)), op("s2", "TRAVERSAL", "social_graph", **walk("id", 1, "OUT", 9)), op("s3", "JOIN", "s1", "", "s1 s2", **link("s2", "a", "id", "RIGHT"))]
    made = workloads.variants({"query_id": "q", "operations": base}, extent=lambda table, column: (0.0, 100.0))
    rows = [(q["query_id"], q["operations"][1]["traversal"]["max_hops"], q["operations"][2]["join"]["join_type"], round(float(q["operations"][0]["predicate"]["value"]), 6)) for q in made if parse(q)]
    return spark.createDataFrame(rows, "query_id string, hops int, join_type string, bound double")


_WALKS = {"snb": 36, "snb_bi": 18, "snb_bi_graph": 9, "ogb": 36, "job": 18, "job_graph": 16, "tpcds": 18, "tpcds_graph": 16}


@query(values("workload, queries", list(_WALKS.items())))
def workload_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each dataset's generated queries, all of them valid and of different names."""
    rows = [(name, len({parse(q).query_id for q in made})) for name, made in workloads.workloads().items()]
    return spark.createDataFrame(rows, "workload string, queries int")


@query(values("intensity, focus, grows", [(i, f, True) for i in ("dense", "aggressive") for f in ("all", "graph", "sql")]))
def workload_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A heavier intensity has more queries in every focus, and each focus its own share of traversals."""
    size = lambda i, f: sum(len([parse(q) for q in made]) for made in workloads.workloads(i, f).values())
    rows = [(i, f, size(i, f) > size("balanced", f) and size(i, "graph") > size(i, "sql")) for i in ("dense", "aggressive") for f in workloads.FOCUS]
    return spark.createDataFrame(rows, "intensity string, focus string, grows boolean")


# Learned routing: on labels that follow a rule exactly, so that what a model must find is known


def ruled(spark: SparkSession, sf_dir: str, rule: Column | None = None) -> DataFrame:
    rows = labelled(spark, sf_dir).drop("score", "predicted", "label")
    rows = rows.withColumns({c: F.lit(0.0) for c in FEATURES if c not in rows.columns})
    rows = rows.withColumns({"row_id": F.col("o_orderkey"), "query_id": F.floor(F.col("o_orderkey") / 10)})
    return rows.withColumn("label", F.when(F.col("avg_degree") > 5 if rule is None else rule, "GRAPH").otherwise("SQL"))


def halves(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    return rows.where(curation.draw(7, "o_orderkey") < 0.7), rows.where(curation.draw(7, "o_orderkey") >= 0.7)


_HELD = f"{LABELLED}, t AS (SELECT * FROM l WHERE {draw_sql(7, 'o_orderkey')} >= 0.7)"


def _learned(kind: str, rule: str, trees: int = 10) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        train, test = halves(ruled(spark, sf_dir, F.expr(rule)))
        return learning.predicted(learning.fitted(train, kind, trees=trees), test).select("o_orderkey", "predicted")

    run.__name__ = f"learned_{kind}"
    query(f"{_HELD} SELECT o_orderkey, CASE WHEN {rule} THEN 'GRAPH' ELSE 'SQL' END AS predicted FROM t")(run)


_learned("logistic", "has_traversal >= 0.5")
_learned("tree", "has_traversal >= 0.5 AND avg_degree > 5 AND max_hops <= 3 AND selectivity >= 0.01")
_learned("boosted", "has_traversal >= 0.5 AND avg_degree > 5")


@query(f"{_HELD} SELECT count(*) FILTER (avg_degree > 5) AS tp, CAST(0 AS BIGINT) AS fp, CAST(0 AS BIGINT) AS fn, 1.0::DOUBLE AS f1 FROM t")
def learned_tree_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = halves(ruled(spark, sf_dir))
    return metrics.confusion(learning.predicted(learning.fitted(train, "tree"), test)).select("tp", "fp", "fn", "f1")


@query(values("kind, f1", [("tree", 1.0)]))
def grouped_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, _, scores = learning.best_model(ruled(spark, sf_dir), "query_id", ("tree",), 3)
    return spark.createDataFrame([(kind, round(float(scores[kind]), 6))], "kind string, f1 double")


@query(values("repeat, learns_nothing", [(0, True), (1, True)]))
def permuted_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models of shuffled labels must not find the true ones."""
    train, test = halves(ruled(spark, sf_dir).withColumn("query_id", F.col("o_orderkey")))
    found = learning.permuted_label_f1(train, test, "query_id", repeats=2)
    return spark.createDataFrame([(i, f1 < 0.8) for i, f1 in enumerate(found)], "repeat int, learns_nothing boolean")


@query(values("feature, matters", [("avg_degree", True), ("op_count_join", False), ("degree_skew", False)]))
def permuted_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = halves(ruled(spark, sf_dir))
    found = learning.permutation_importance(spark, learning.fitted(train, "tree"), test, ("avg_degree", "op_count_join", "degree_skew"))
    return found.select("feature", (F.col("f1_drop") > 0.1).alias("matters"))


@query(values("train, test, f1", [(f"d{a}", f"d{b}", 1.0) for a in range(3) for b in range(3) if a != b]))
def transfer_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learning.transfer(spark, ruled(spark, sf_dir)).withColumn("f1", F.round("f1", 6))


@query(values("train, test, f1", [("all others", f"d{b}", 1.0) for b in range(3)]))
def transfer_to_left_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learning.transfer(spark, ruled(spark, sf_dir), leave_one_out=True, tuned_share=0.1).withColumn("f1", F.round("f1", 6))


@query(values("train, test, f1", [("graph", "sql", 1.0), ("sql", "graph", 1.0)]))
def transfer_between_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learning.domain_shift(spark, ruled(spark, sf_dir), {"graph": ["d0"], "sql": ["d1", "d2"]}).withColumn("f1", F.round("f1", 6))


@query(values("removed, matters", [("nothing", False), ("degree", True), ("joins", False)]))
def ablated(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = halves(ruled(spark, sf_dir))
    found = learning.ablation(spark, train, test, groups={"degree": ("avg_degree",), "joins": ("op_count_join",)})
    return found.select("removed", (F.col("f1_drop") > 0.1).alias("matters"))


@query(f"{LABELLED}, inflation AS (SELECT 1 / (1 - pow(corr(max_hops, has_traversal), 2)) AS vif FROM l) SELECT feature, round(vif, 3) AS vif, CASE WHEN vif > 10 THEN 'remove' ELSE 'keep' END AS advice FROM inflation, (SELECT unnest(['max_hops', 'has_traversal']) AS feature)")
def collinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learning.variance_inflation(spark, ruled(spark, sf_dir), ("max_hops", "has_traversal")).withColumn("vif", F.round("vif", 3))


@query(values("feature, importance", [("avg_degree", 1.0)]))
def tree_gains(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = learning.gains(spark, learning.fitted(ruled(spark, sf_dir), "tree"))
    return found.where("importance > 0").withColumn("importance", F.round("importance", 6))


@query(values("query_id, sub_id, engine", [("chain", "sub_0", "SQL"), ("walk", "sub_0", "GRAPH"), ("mixed", "sub_0", "GRAPH"), ("mixed", "sub_1", "SQL"), ("mixed", "sub_2", "GRAPH"), ("maps", "sub_0", "SQL")]))
def routed_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model of "traversals go to the graph engine" as the engine's policy; a query's groups are judged at once."""
    model = learning.fitted(ruled(spark, sf_dir, F.col("has_traversal") >= 0.5), "tree", ("has_traversal",))
    policy = policies.Learned(spark, model, _known(spark, sf_dir))
    results = Engine(spark, tables(spark, sf_dir), policy).run_batch([{"query_id": q, "operations": ops} for q, ops in CORPUS.items()])
    return metadata(spark, results).select("query_id", "sub_id", "engine")


# Timing, experiments, status


def _strategies(spark: SparkSession, folder: str) -> dict:
    found = tables(spark, folder)
    documents = {q: {"query_id": q, "operations": CORPUS[q]} for q in ("chain", "walk")} | {"broken": {"query_id": "broken", "operations": [op("s1", "FILTER", "no_table", "x")]}}
    return {name: (lambda q, force=force: lambda: Engine(spark, found, force=force).run(documents[q])) for name, force in (("always_sql", "SQL"), ("always_graph", "GRAPH"))}


@query(values("strategy, total_queries, successful_queries, timed", [("always_sql", 3, 2, True), ("always_graph", 3, 2, True)]))
def strategies_timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = compare.strategy_runs(spark, _strategies(spark, sf_dir), ("chain", "walk", "broken"), 0, 1)
    return metrics.strategy_table(runs).select("strategy", "total_queries", "successful_queries", (F.col("median_latency_ms") > 0).alias("timed"))


@query(values("scale, strategy, query_id, success", [("here", s, "chain", True) for s in ("always_sql", "always_graph")]))
def scales_timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = compare.scale_experiment(spark, {"here": sf_dir, "not_here": f"{sf_dir}/no_such_scale"}, lambda folder: _strategies(spark, folder), ("chain",))
    return found.select("scale", "strategy", "query_id", "success")


@query(values("item, passed", [("quality_gate", False), ("model_f1", True), ("results_agree", True), ("features_matter", True), ("publishable", False)]))
def status_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labelled(spark, sf_dir)
    gate = curation.quality_gate(rows.withColumn("source_row_id", F.lit("one")))  # one row repeated: refused
    customer = tables(spark, sf_dir).table("customer")
    reports = compare.report_table(spark, [compare.compared("customer", customer, customer.repartition(3))])
    drops = spark.createDataFrame([("degree", 0.2), ("joins", 0.0)], "removed string, f1_drop double")
    found = compare.status(spark, gate, 0.99, reports, drops).select("item", "passed")
    return found.union(spark.createDataFrame([("publishable", curation.publishable(gate))], "item string, passed boolean"))
