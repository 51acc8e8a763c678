"""Learned routing with MLlib: models, grouped validation, and studies of what they rest on."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Correlation
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.evalkit.curation import draw
from lattica.evalkit.metrics import confusion
from lattica.functions.features import FEATURES
from lattica.operators.running import with_running_sums

KINDS = ("logistic", "tree", "boosted")
# Feature groups of the ablation study, fixed values.
GROUPS = {
    "shape": ("op_count_filter", "op_count_join", "op_count_traversal", "op_count_aggregate", "op_count_map", "ast_depth", "has_traversal", "max_hops"),
    "statistics": ("input_cardinality_log", "output_cardinality_log", "selectivity", "avg_degree", "max_degree", "degree_skew", "num_projected_columns", "has_index", "join_fanout"),
    "costs": ("estimated_shuffle_bytes_log", "estimated_traversal_ops"),
    "history": ("hist_avg_runtime_ms", "hist_runtime_variance", "num_tables_joined"),
}


def prepared(rows: DataFrame, columns: Sequence[str] = FEATURES) -> DataFrame:
    """Rows with target (1 for GRAPH) and weight, which gives both labels equal sums."""
    n = rows.groupBy("label").agg(F.count(F.lit(1)).alias("of_label"))
    total = F.sum("of_label").over(Window.partitionBy(F.lit(1)))  # a row per label
    share = n.withColumn("weight", total / (2 * F.col("of_label"))).drop("of_label")
    return rows.join(F.broadcast(share), "label").withColumn("target", (F.col("label") == "GRAPH").cast("double")).fillna(0.0, list(columns))


def estimator(kind: str, columns: Sequence[str] = FEATURES, trees: int = 200, seed: int = 42) -> Pipeline:
    """The logistic model, a tree of depth 6 with 10 rows a leaf, or boosted trees of depth 5."""
    vector = VectorAssembler(inputCols=list(columns), outputCol="raw", handleInvalid="keep")
    scale = StandardScaler(inputCol="raw", outputCol="vector", withMean=False)
    common = {"featuresCol": "vector", "labelCol": "target", "weightCol": "weight"}
    if kind == "logistic":
        model = LogisticRegression(maxIter=50, regParam=0.01, **common)
    elif kind == "tree":
        model = DecisionTreeClassifier(maxDepth=6, minInstancesPerNode=10, seed=seed, **common)
    elif kind == "boosted":
        model = GBTClassifier(maxIter=trees, maxDepth=5, stepSize=0.05, subsamplingRate=0.8, seed=seed, **common)
    else:
        raise ValueError(f"unknown kind of model '{kind}'")
    return Pipeline(stages=[vector, scale, model])


def fitted(rows: DataFrame, kind: str = "boosted", columns: Sequence[str] = FEATURES, trees: int = 200) -> PipelineModel:
    return estimator(kind, columns, trees).fit(prepared(rows, columns))


def predicted(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """Rows with score (the probability of GRAPH) and predicted."""
    clean = rows.fillna(0.0, [c for c in FEATURES if c in rows.columns])
    scored = model.transform(clean).withColumn("score", vector_to_array("probability")[1])
    return scored.drop("raw", "vector", "rawPrediction", "probability", "prediction").withColumn("predicted", F.when(F.col("score") > 0.5, "GRAPH").otherwise("SQL"))


def f1_of(model: PipelineModel, rows: DataFrame) -> float:
    return float(confusion(predicted(model, rows)).first()["f1"])


def with_folds(rows: DataFrame, group: str, folds: int, seed: int = 42) -> DataFrame:
    """A fold per group, by hash, so that no group is in two."""
    return rows.withColumn("fold", F.floor(draw(seed, group) * folds).cast("int"))


def best_model(rows: DataFrame, group: str, kinds: Sequence[str] = KINDS, folds: int = 3, columns: Sequence[str] = FEATURES, trees: int = 10) -> tuple[str, PipelineModel, dict[str, float]]:
    """The kind of best F1 in grouped cross-validation, fitted on all rows, and each kind's mean F1."""
    data = with_folds(prepared(rows, columns), group, folds).persist()
    found: dict[str, tuple[float, PipelineModel]] = {}
    judge = MulticlassClassificationEvaluator(labelCol="target", metricName="fMeasureByLabel", metricLabel=1.0)
    for kind in kinds:
        cv = CrossValidator(estimator=estimator(kind, columns, trees), estimatorParamMaps=ParamGridBuilder().build(), evaluator=judge, numFolds=folds, foldCol="fold", parallelism=folds)
        model = cv.fit(data)
        found[kind] = model.avgMetrics[0], model.bestModel
    data.unpersist()
    best = max(kinds, key=lambda k: found[k][0])
    return best, found[best][1], {k: v[0] for k, v in found.items()}


def area_under_pr(model: PipelineModel, rows: DataFrame) -> float:
    return BinaryClassificationEvaluator(labelCol="target", metricName="areaUnderPR").evaluate(model.transform(prepared(rows)))


def shuffled(rows: DataFrame, column: str, seed: int = 42, within: str | None = None) -> DataFrame:
    """Rows with one column's values dealt anew among them, or among whole groups of ``within``.

    Keys and values are numbered in two orders drawn by hash, by running sums over ranges, and joined by number.
    """
    key = within or "row_id"
    values = rows.groupBy(within).agg(F.max(column).alias("dealt")) if within else rows.select("row_id", F.col(column).alias("dealt"))
    one = with_running_sums(values.select(key).withColumn("u", draw(seed, key)), ("u", key), {"n": F.lit(1)}).select(key, "n")
    other = with_running_sums(values.withColumn("u", draw(seed + 1, key)), ("u", key), {"n": F.lit(1)}).select("n", "dealt")
    return rows.drop(column).join(one.join(other, "n").select(key, F.col("dealt").alias(column)), key)


def permutation_importance(spark: SparkSession, model: PipelineModel, rows: DataFrame, columns: Sequence[str] = FEATURES, seed: int = 42) -> DataFrame:
    """(feature, f1_drop) when one feature's values are shuffled; ``rows`` has a unique row_id."""
    base = f1_of(model, rows)
    return spark.createDataFrame([(c, base - f1_of(model, shuffled(rows, c, seed))) for c in columns], "feature string, f1_drop double")


def permuted_label_f1(train: DataFrame, test: DataFrame, group: str, kind: str = "tree", repeats: int = 3) -> list[float]:
    """F1 of models fitted to labels that were shuffled among groups."""
    return [f1_of(fitted(shuffled(train, "label", seed, group), kind), test) for seed in range(repeats)]


def ablation(spark: SparkSession, train: DataFrame, test: DataFrame, kind: str = "tree", groups: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """(removed, f1, f1_drop) without each group of features; pass single names to study features."""
    base = f1_of(fitted(train, kind), test)
    rows = [("nothing", base, 0.0)]
    for name, gone in (GROUPS if groups is None else groups).items():
        f1 = f1_of(fitted(train, kind, [c for c in FEATURES if c not in set(gone)]), test)
        rows.append((name, f1, base - f1))
    return spark.createDataFrame(rows, "removed string, f1 double, f1_drop double")


def transfer(spark: SparkSession, rows: DataFrame, kind: str = "tree", leave_one_out: bool = False, tuned_share: float = 0.0) -> DataFrame:
    """(train, test, f1) for models that never saw the test dataset, or saw only ``tuned_share`` of it by hash."""
    names = [r[0] for r in rows.select("dataset").distinct().orderBy("dataset").collect()]  # one row per dataset
    out = []
    for test in names:
        there = rows.where(F.col("dataset") == test)
        own = there.where(draw(42, "query_id") < tuned_share)
        there = there.where(draw(42, "query_id") >= tuned_share)
        for train in ["all others"] if leave_one_out else [n for n in names if n != test]:
            seen = rows.where(F.col("dataset") != test) if leave_one_out else rows.where(F.col("dataset") == train)
            out.append((train, test, f1_of(fitted(seen.unionByName(own), kind), there)))
    return spark.createDataFrame(out, "train string, test string, f1 double")


def domain_shift(spark: SparkSession, rows: DataFrame, domains: dict[str, Sequence[str]], kind: str = "tree") -> DataFrame:
    """(train, test, f1) for models of one domain's datasets on each other domain's."""
    return transfer(spark, rows.withColumn("dataset", domain_of(domains)).where("dataset is not null"), kind)


def domain_of(domains: dict[str, Sequence[str]], dataset: str = "dataset") -> Column:
    found = F.lit(None).cast("string")
    for name, datasets in domains.items():
        found = F.when(F.col(dataset).isin(list(datasets)), F.lit(name)).otherwise(found)
    return found


def variance_inflation(spark: SparkSession, rows: DataFrame, columns: Sequence[str] = FEATURES, ceiling: float = 10.0) -> DataFrame:
    """(feature, vif, advice): the diagonal of the inverse correlation matrix; constant features have none."""
    import numpy as np

    spread = rows.agg(*[(F.stddev_pop(c) / (F.abs(F.avg(c)) + 1)).alias(c) for c in columns]).first()
    used = [c for c in columns if (spread[c] or 0) > 1e-12]
    vector = VectorAssembler(inputCols=used, outputCol="v").transform(rows.fillna(0.0, used))
    correlation = Correlation.corr(vector, "v").first()[0].toArray()  # features by features
    vif = np.diag(np.linalg.inv(correlation + 1e-9 * np.eye(len(used))))  # collinear features get a very large one
    return spark.createDataFrame([(c, float(v), "remove" if v > ceiling else "keep") for c, v in zip(used, vif, strict=True)], "feature string, vif double, advice string")


def gains(spark: SparkSession, model: PipelineModel, columns: Sequence[str] = FEATURES) -> DataFrame:
    """(feature, importance) of a tree model, or the absolute coefficients of a logistic one."""
    last = model.stages[-1]
    values = last.featureImportances.toArray() if hasattr(last, "featureImportances") else abs(last.coefficients.toArray())
    return spark.createDataFrame([(c, float(v)) for c, v in zip(columns, values, strict=True)], "feature string, importance double")
