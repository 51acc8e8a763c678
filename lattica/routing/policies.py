"""Policies that choose an engine, for one sub-expression or as columns over a feature table."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.evalkit.curation import split_by_row
from lattica.functions.features import FEATURES, features
from lattica.functions.stats import Statistics
from lattica.plans.decompose import SubExpression

# Grid of the threshold search, fixed values.
GRID = {"avg_degree": (2.0, 5.0, 10.0, 20.0), "max_hops": (1, 2, 3, 4), "selectivity": (0.001, 0.01, 0.05, 0.1)}


def trivial(sub: SubExpression) -> str:
    return "GRAPH" if sub.primary == "TRAVERSAL" else "SQL"


def trivial_column() -> Column:
    return F.when(F.col("has_traversal") >= 0.5, "GRAPH").otherwise("SQL")


@dataclass(frozen=True)
class Threshold:
    """GRAPH for traversals of few hops over dense graphs that start from enough vertices."""

    avg_degree: float = 5.0
    max_hops: float = 3
    selectivity: float = 0.01

    def route(self, f: dict[str, float]) -> str:
        graph = f["has_traversal"] >= 0.5 and f["avg_degree"] > self.avg_degree and f["max_hops"] <= self.max_hops and f["selectivity"] >= self.selectivity
        return "GRAPH" if graph else "SQL"

    def column(self) -> Column:
        return F.when(_dense(F.lit(self.avg_degree), F.lit(self.max_hops), F.lit(self.selectivity)), "GRAPH").otherwise("SQL")


def _dense(degree: Column, hops: Column, selectivity: Column) -> Column:
    return (F.col("has_traversal") >= 0.5) & (F.col("avg_degree") > degree) & (F.col("max_hops") <= hops) & (F.col("selectivity") >= selectivity)


def threshold_grid(labelled: DataFrame) -> DataFrame:
    """(t_degree, t_hops, t_selectivity, tp, fp, fn, f1) of every grid point over labelled feature rows.

    The 64 points are counted as columns of one aggregation, so no row is copied, and then unfolded.
    """
    points = [(d, h, s) for d in GRID["avg_degree"] for h in GRID["max_hops"] for s in GRID["selectivity"]]
    is_graph = F.col("label") == "GRAPH"
    sums = []
    for i, (d, h, s) in enumerate(points):
        says = _dense(F.lit(d), F.lit(h), F.lit(s))
        sums += [F.count_if(cond).alias(f"{n}{i}") for n, cond in (("tp", says & is_graph), ("fp", says & ~is_graph), ("fn", ~says & is_graph))]
    one = labelled.agg(*sums)
    point = lambda i, p: F.struct(*[F.lit(v).cast("double").alias(n) for v, n in zip(p, ("t_degree", "t_hops", "t_selectivity"), strict=True)], *[F.col(f"{n}{i}").alias(n) for n in ("tp", "fp", "fn")])
    rows = one.select(F.explode(F.array(*[point(i, p) for i, p in enumerate(points)])).alias("p")).select("p.*")
    whole = 2 * F.col("tp") + F.col("fp") + F.col("fn")
    return rows.withColumn("f1", F.when(whole > 0, 2 * F.col("tp") / whole).otherwise(0.0))


def tuned(labelled: DataFrame, share: float = 1.0, key: tuple[str, ...] = ("query_id",)) -> Threshold:
    """The grid point of the best F1; ties go to the smallest thresholds.

    With a ``share`` below 1 that share of each label's rows, drawn by the hash of ``key``, is what is judged.
    """
    if share < 1:
        labelled = split_by_row(labelled, key, share).where("part = 'eval'")
    best = threshold_grid(labelled).orderBy(F.desc("f1"), "t_degree", "t_hops", "t_selectivity").first()
    return Threshold(best["t_degree"], best["t_hops"], best["t_selectivity"])


class Learned:
    """A fitted model as a policy; GRAPH where the probability is above one half."""

    def __init__(self, spark: SparkSession, model: PipelineModel, stats: Statistics, history: dict | None = None):
        self.spark, self.model, self.stats, self.history = spark, model, stats, history

    def batch(self, subs: Sequence[SubExpression]) -> list[str]:
        """The engines of many sub-expressions, by one pass of the model."""
        rows = [(i, *features(s, self.stats, self.history).values()) for i, s in enumerate(subs)]
        if not rows:
            return []
        table = self.spark.createDataFrame(rows, "place int, " + ", ".join(f"{c} double" for c in FEATURES))
        found = self.model.transform(table).select("place", vector_to_array("probability")[1].alias("score"))
        return ["GRAPH" if r["score"] > 0.5 else "SQL" for r in found.orderBy("place").collect()]  # a row per sub-expression

    def __call__(self, sub: SubExpression) -> str:
        return self.batch([sub])[0]


def thresholded(stats: Statistics, rule: Threshold | None = None) -> Callable[[SubExpression], str]:
    rule = rule or Threshold()
    return lambda sub: rule.route(features(sub, stats))
