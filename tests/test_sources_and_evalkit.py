import json

import pytest
from pyspark.sql import functions as F

from lattica.dsl.nodes import parse
from lattica.evalkit import costs, curation, learning, metrics
from lattica.functions import stats
from lattica.operators.running import with_running_sums
from lattica.functions.features import FEATURES, depth, features
from lattica.plans.decompose import decompose
from lattica.routing.policies import Learned, Threshold, thresholded, tuned
from lattica.sources import etl


def test_text_files(spark, tmp_path):
    (tmp_path / "c.tbl").write_text("1|Ann|addr|7|555|10.5|BUILDING|x|\n2|Bob|addr|3|555|1.5|MACHINERY|y|\n")
    df = etl.read_tbl(spark, str(tmp_path / "c.tbl"), etl.TPCH["customer"])
    assert df.count() == 2 and df.columns[0] == "c_custkey"
    etl.written(df, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    etl.written_csv(df, str(tmp_path / "csv"))
    (tmp_path / "s.dat").write_text("1|a|\n2|b|\n")
    assert etl.read_headerless(spark, str(tmp_path / "s.dat")).columns == ["c0", "c1"]
    (tmp_path / "t.tsv").write_text("1\ta,b\n")
    assert etl.sniffed_separator(spark, str(tmp_path / "t.tsv")) == "\t"
    (tmp_path / "h.csv").write_text("a|b\n1|2\n")
    assert etl.read_with_header(spark, str(tmp_path / "h.csv")).columns == ["a", "b"]


def test_graph_shaping(spark):
    e = etl.knows_edges(spark.createDataFrame([(1, 2), (2, 1), (2, 3)], "p long, q long"))
    assert etl.symmetric(e).count() == 4 and etl.endpoints(e).count() == 3
    person = spark.createDataFrame([(1, "x"), (1, "x")], "person_id long, name string")
    assert etl.vertices_of(e, person).columns == ["person_id", "name", "id"] and etl.vertices_of(e, person).count() == 1
    rows = spark.createDataFrame([(1, 5), (1, 5), (None, 6)], "a int, b int")
    assert etl.projected_edges(rows, "a", "b", "R", "t", "u").collect() == [("t:a:1", "u:b:5", "R")]
    assert etl.renamed(person, {"name": "n", "nope": "m"}).columns == ["person_id", "n"]


def test_generators_are_deterministic(spark):
    one, other = (etl.power_law_graph(spark.newSession() if i else spark, 500, 10) for i in range(2))
    assert sorted(one[1].collect()) == sorted(other[1].collect())
    degrees = one[1].groupBy("dst").count().agg(F.max("count"), F.avg("count")).first()
    assert degrees[0] > 5 * degrees[1]  # hubs
    made = etl.social_network(spark, 50)
    assert made["person"].count() == 50 and made["messages"].count() == 250 + 400 and made["knows"].where("src = dst").isEmpty()


def test_compatibility_tables(spark):
    c = etl.compatible_customer(spark.createDataFrame([(1, 2), (None, 3)], "c0 int, c1 int"))
    assert set(c.columns) >= {"c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"} and c.count() == 1
    o = etl.compatible_orders(spark.createDataFrame([(1, 2.5), (2, None)], "c3 int, c20 double"))
    assert set(o.columns) >= {"o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority", "o_orderstatus"} and o.count() == 2
    w = etl.enriched_works_at(spark.createDataFrame([(1, 9)], "person_id int, organisation_id int"))
    assert w.first().company_name == "9"
    p = etl.enriched_person(spark.createDataFrame([(1,), (2,)], "person_id int"), spark.createDataFrame([(1, "DE"), (1, "DE")], "id int, country string"))
    assert {r.person_id: r.country for r in p.collect()} == {1: "DE", 2: None}


def test_statistics(spark):
    df = spark.createDataFrame([(1, 1.5, "x"), (2, None, "x"), (2, 3.5, None)], "a long, b double, s string")
    found = stats.table_stats("t", df)
    assert found["row_count"] == 3 and found["column_count"] == 3
    assert found["columns"] == {"a": {"distinct_count": 2, "min": 1.0, "max": 2.0}, "b": {"distinct_count": 2, "min": 1.5, "max": 3.5}}
    per = {r.column_name: r.asDict() for r in stats.column_stats(df).collect()}
    assert per["b"] == {"column_name": "b", "row_count": 3, "distinct_count": 2, "min": 1.5, "max": 3.5}
    e = spark.createDataFrame([(1, 2), (1, 3), (2, 3)], "src int, dst int")
    assert stats.graph_stats(e).first().asDict() | {"stddev_degree": 0} == {"avg_degree": 1.5, "max_degree": 2.0, "stddev_degree": 0, "vertex_count": 2, "edge_count": 3}
    assert stats.graph_stats(e, etl.endpoints(e)).first().vertex_count == 3
    known = stats.Statistics.load([("t_stats", json.dumps(found)), ("g_graph", json.dumps({"avg_degree": 2, "vertex_count": 9}))])
    assert known.rows("t") == 3 and known.rows("g") == 9 and known.is_graph("g") and known.rows("nowhere") == 0


def test_history(spark, tmp_path):
    path = str(tmp_path / "history")
    runs = spark.createDataFrame([("f", "SQL", 100.0, 1.0), ("f", "SQL", 200.0, 2.0), ("g", "SQL", 7.0, 3.0)], stats.HISTORY)
    stats.recorded(path, runs)
    found = {r[0]: r[1:] for r in stats.history_lookup(spark.read.parquet(path)).collect()}
    assert found == {"f": (150.0, 5000.0), "g": (7.0, 0.0)}
    f = spark.createDataFrame([("f",), ("h",)], "fingerprint string")
    assert {r[0]: r[1:] for r in stats.with_history(f, runs).collect()} == {"f": (150.0, 5000.0), "h": (-1.0, -1.0)}
    assert stats.fingerprint(["JOIN", "FILTER"], "t") == stats.fingerprint(["FILTER", "JOIN"], "t")


FILTER = {"op_id": "s1", "type": "FILTER", "source": "t", "fields": ["a"], "predicate": {"column": "a", "operator": "=", "value": 1}}
WALK = {"op_id": "s2", "type": "TRAVERSAL", "source": "g", "traversal": {"start_vertex_filter": {"column": "id", "value": 1}, "edge_label": "", "direction": "OUT", "max_hops": 2}}


def test_features(spark):
    known = stats.Statistics({"t": {"row_count": 1000, "columns": {"a": {"distinct_count": 50, "min": 0, "max": 100}}}}, {"g": {"avg_degree": 4.0, "max_degree": 9.0, "stddev_degree": 2.0, "vertex_count": 100}})
    one, two = decompose(parse({"query_id": "q", "operations": [FILTER, WALK]}).nodes)
    f = features(one, known)
    assert tuple(f) == FEATURES and f["selectivity"] == pytest.approx(0.02) and f["op_count_filter"] == 1 and f["hist_avg_runtime_ms"] == -1
    g = features(two, known)
    assert g["has_traversal"] == 1 and g["estimated_traversal_ops"] == 16.0 and g["degree_skew"] == 0.5 and g["selectivity"] == 0.01
    assert thresholded(known)(two) == "SQL" and Threshold(2.0, 3, 0.005).route(g) == "GRAPH"
    chain = parse({"query_id": "q", "operations": [FILTER, FILTER | {"op_id": "s3", "source": "s1", "depends_on": ["s1"]}]}).nodes
    assert depth(chain) == 2


@pytest.fixture(scope="module")
def rows(spark):
    made = spark.range(600).select(
        F.col("id").alias("row_id"), F.concat(F.lit("q"), (F.col("id") % 60).cast("string")).alias("query_id"), F.concat(F.lit("d"), (F.col("id") % 3).cast("string")).alias("dataset"),
        (F.col("id") % 2).cast("double").alias("has_traversal"), ((F.col("id") % 7) * (F.col("id") % 2)).cast("double").alias("avg_degree"), ((F.col("id") % 4 + 1) * (F.col("id") % 2)).cast("double").alias("max_hops"),
        F.lit(0.05).alias("selectivity"), (F.col("id") % 5).cast("double").alias("input_cardinality_log"), (F.col("id") % 2).cast("double").alias("op_count_traversal"),
    )
    made = made.withColumns({c: F.lit(0.0) for c in FEATURES if c not in made.columns})
    return costs.simulated(made).cache()


def test_learning(spark, rows):
    assert rows.select("label").distinct().count() == 2
    split = curation.split_by_group(rows, "query_id", 0.3, 10)
    train, test = split.where("part = 'train'").drop("part"), split.where("part = 'eval'").drop("part")
    assert train.join(test, "query_id").isEmpty()
    kind, model, scores = learning.best_model(train, "query_id", ("logistic", "tree"), 2)
    assert scores[kind] > 0.7
    judged = learning.predicted(model, test)
    assert metrics.confusion(judged).first().accuracy > 0.7
    boot = metrics.bootstrap(judged, 30, key="row_id").first()
    assert 0 <= boot.f1_low <= boot.f1_mid <= boot.f1_high <= 1
    assert learning.gains(spark, learning.fitted(train, "tree")).orderBy(F.desc("importance")).first().importance > 0
    drops = {r.feature: r.f1_drop for r in learning.permutation_importance(spark, learning.fitted(train, "tree"), test, ("avg_degree", "hist_avg_runtime_ms")).collect()}
    assert drops["hist_avg_runtime_ms"] == 0
    sub = decompose(parse({"query_id": "q", "operations": [WALK]}).nodes)[0]
    assert Learned(spark, model, stats.Statistics())(sub) in ("SQL", "GRAPH")


def test_studies(spark, rows):
    assert learning.transfer(spark, rows, "tree", leave_one_out=True).count() == 3
    assert learning.ablation(spark, rows, rows, "tree", {"shape": learning.GROUPS["shape"]}).count() == 2
    assert all(0 <= f <= 1 for f in learning.permuted_label_f1(rows, rows, "query_id", repeats=1))
    vif = {r.feature: r for r in learning.variance_inflation(spark, rows).collect()}
    assert "hist_avg_runtime_ms" not in vif and vif["has_traversal"].vif > vif["input_cardinality_log"].vif


def test_curation(spark, rows):
    assert curation.merged(rows, rows).count() == rows.select("dataset", "query_id", "label").distinct().count()
    split = curation.split_by_row(rows, ("row_id",), 0.25)
    assert {r.part for r in split.select("part").distinct().collect()} == {"train", "eval"}
    graph = rows.where("label = 'GRAPH'").count()
    assert curation.upsampled(rows, times=3).where("label = 'GRAPH'").count() == 3 * graph
    with pytest.raises(ValueError):
        curation.upsampled(rows, least_unique=10_000)
    checks = curation.quality_gate(rows.withColumn("source_row_id", F.col("row_id")), rows, rows, per_dataset={"d0": 1, "nowhere": 1})
    found = {r.name: r.passed for r in checks.collect()}
    assert found["both_labels_present"] and not found["source_nowhere_min_graph"] and not curation.publishable(checks)
    assert curation.validated([rows.withColumn("label_source", F.lit("real_measurement"))], ["d1"]).select("dataset").distinct().collect() == [("d1",)]
    assert costs.augmented(rows.limit(4), ["selectivity"], "row_id", 10).count() == 40
    assert isinstance(tuned(rows), Threshold) and isinstance(tuned(rows, 0.2, ("row_id",)), Threshold)


def test_running_sums(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") * 7 % 10).alias("k"), F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("g")).repartition(5)
    got = {r.id: r for r in with_running_sums(df, ("k", "id"), {"n": F.lit(1), "s": F.col("id")}).collect()}
    order = sorted(range(1000), key=lambda i: (i * 7 % 10, i))
    assert [got[i].n for i in order] == list(range(1, 1001)) and got[order[-1]].s == sum(range(1000))
    by = {r.id: r.n for r in with_running_sums(df, ("k", "id"), {"n": F.lit(1)}, ("g",)).collect()}
    for g in range(3):
        assert [by[i] for i in order if i % 3 == g] == list(range(1, 1 + len([i for i in order if i % 3 == g])))
    assert with_running_sums(df.limit(0), ("k",), {"n": F.lit(1)}).count() == 0


def test_shuffled_values_are_the_same_values(spark, rows):
    got = learning.shuffled(rows.select("row_id", "query_id", "label", "avg_degree"), "avg_degree", 5)
    assert sorted(r[0] for r in got.select("avg_degree").collect()) == sorted(r[0] for r in rows.select("avg_degree").collect())
    assert got.join(rows.select("row_id", F.col("avg_degree").alias("was")), "row_id").where("avg_degree <> was").count() > 100


def test_measured_labels(spark):
    runs = spark.createDataFrame([("a", "RELATIONAL", 10.0, None), ("b", "TRAVERSAL", 10.0, 5.0), ("c", "TRAVERSAL", None, 5.0), ("d", "TRAVERSAL", 9.0, None), ("e", "TRAVERSAL", None, None)], "sub_id string, primary string, sql_median_ms double, graph_median_ms double")
    got = {r.sub_id: (r.label, r.fallback_reason, r.sql_median_ms, r.graph_median_ms) for r in costs.labelled(runs).collect()}
    assert got == {"a": ("SQL", "none", 10.0, 30.0), "b": ("GRAPH", "none", 10.0, 5.0), "c": ("GRAPH", "sql_failed_or_penalized", 15.0, 5.0), "d": ("SQL", "graph_failed", 9.0, 27.0)}
