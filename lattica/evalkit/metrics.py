"""Metrics of routing decisions and latencies, as aggregations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.evalkit.curation import draw
from lattica.operators.running import with_running_sums

CONFIDENCES = (0.5, 0.6, 0.7, 0.8, 0.9)


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def counts(truth: Column, says: Column) -> list[Column]:
    return [F.count_if(c).alias(n) for n, c in (("tp", truth & says), ("fp", ~truth & says), ("fn", truth & ~says), ("tn", ~truth & ~says))]


def with_rates(df: DataFrame) -> DataFrame:
    """accuracy, precision, recall and f1 from tp, fp, fn and tn."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return df.withColumns({"accuracy": ratio(tp + tn, tp + fp + fn + tn), "precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn)})


def confusion(df: DataFrame, label: str = "label", predicted: str = "predicted", by: tuple[str, ...] = ()) -> DataFrame:
    """Counts and rates over all rows, or for each value of ``by``; GRAPH is the positive label."""
    sums = counts(F.col(label) == "GRAPH", F.col(predicted) == "GRAPH")
    return with_rates(df.groupBy(*by).agg(*sums) if by else df.agg(*sums))


def brier(df: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    return df.agg(F.avg(F.pow(F.col(score) - (F.col(label) == "GRAPH").cast("double"), 2)).alias("brier"))


def average_precision(df: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """pr_auc: precision at each distinct score, weighted by the recall gained there.

    Rows are counted per score first, and the running sums go over ranges of scores, so no task holds them all.
    """
    per = df.groupBy(score).agg(F.count_if(F.col(label) == "GRAPH").alias("pos"), F.count(F.lit(1)).alias("n"))
    run = with_running_sums(per, (F.desc(score),), {"tp": F.col("pos"), "seen": F.col("n")})
    return run.agg(ratio(F.sum(F.col("pos") * F.col("tp") / F.col("seen")), F.sum("pos")).alias("pr_auc"))


def confidence_coverage(df: DataFrame, score: str = "score", label: str = "label", thresholds: tuple[float, ...] = CONFIDENCES) -> DataFrame:
    """(threshold, coverage, precision, recall, f1) of the rows whose confidence reaches each threshold; one pass."""
    sure, truth, says = F.greatest(F.col(score), 1 - F.col(score)), F.col(label) == "GRAPH", F.col(score) >= 0.5
    sums = [F.count(F.lit(1)).alias("total")]
    for i, t in enumerate(thresholds):
        sums += [F.count_if((sure >= t) & c).alias(f"{n}{i}") for n, c in (("tp", truth & says), ("fp", ~truth & says), ("fn", truth & ~says), ("covered", F.lit(True)))]
    rows = df.agg(*sums).select("total", F.explode(F.array(*[F.struct(F.lit(t).alias("threshold"), *[F.col(f"{n}{i}").alias(n) for n in ("tp", "fp", "fn", "covered")]) for i, t in enumerate(thresholds)])).alias("r"))
    rows = rows.select("total", "r.*")
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return rows.select("threshold", ratio(F.col("covered"), F.col("total")).alias("coverage"), ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


def ambiguity(least_ratio: float = 2.0, sql: str = "sql_runtime_ms", graph: str = "graph_runtime_ms") -> Column:
    a, b = F.col(sql), F.col(graph)
    close = (a <= 0) | (b <= 0) | (F.greatest(a, b) / F.when(F.least(a, b) > 0, F.least(a, b)) < least_ratio)
    return F.when(close, "ambiguous").when(a < b, "unambiguous_sql").otherwise("unambiguous_graph")


def accuracy_by_ambiguity(df: DataFrame, least_ratio: float = 2.0) -> DataFrame:
    return df.withColumn("ambiguity", ambiguity(least_ratio)).groupBy("ambiguity").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("label") == F.col("predicted")).cast("double")).alias("accuracy"))


def strategy_table(runs: DataFrame, reference: str = "always_sql") -> DataFrame:
    """Per strategy: median, p95 and mean latency over queries that succeeded, success rate, and % against the reference."""
    per = runs.groupBy("strategy").agg(
        F.count(F.lit(1)).alias("total_queries"),
        F.count_if("success").alias("successful_queries"),
        F.percentile(F.when(F.col("success"), F.col("median_latency_ms")), 0.5).alias("median_latency_ms"),
        F.percentile(F.when(F.col("success"), F.col("median_latency_ms")), 0.95).alias("p95_latency_ms"),
        F.avg(F.when(F.col("success"), F.col("median_latency_ms"))).alias("mean_latency_ms"),
    )
    per = per.withColumn("success_rate", F.col("successful_queries") / F.col("total_queries"))
    base = F.max(F.when(F.col("strategy") == reference, F.col("median_latency_ms"))).over(Window.partitionBy(F.lit(1)))  # a row per strategy
    return per.withColumn("pct_vs_reference", (F.col("median_latency_ms") / base - 1) * 100)


def agreement(one: DataFrame, other: DataFrame, key: str = "query_id", engine: str = "engines_used") -> DataFrame:
    """How often two strategies used the same engines for a query."""
    both = one.select(key, F.col(engine).alias("a")).join(other.select(key, F.col(engine).alias("b")), key)
    return both.agg(F.avg((F.col("a") == F.col("b")).cast("double")).alias("agreement"), F.count(F.lit(1)).alias("n"))


def bootstrap(df: DataFrame, replicates: int = 200, seed: int = 42, label: str = "label", predicted: str = "predicted", key: str = "sub_id") -> DataFrame:
    """(f1_low, f1_mid, f1_high): percentiles of F1 over Poisson resamples, the bootstrap that needs no shuffle of rows.

    Each row's number of copies in a replicate is a Poisson(1) draw from the hash of its key.  The four kinds of
    outcome are weighed in one grouped pass.
    """
    u = draw(seed, key, "replicate")
    cuts, total, p = [], 0.0, 0.36787944117144233  # exp(-1)
    for k in range(9):
        total += p
        cuts.append(total)
        p /= k + 1
    copies = reduce(lambda a, b: a + b, [F.when(u > c, 1).otherwise(0) for c in cuts])
    truth, says = F.col(label) == "GRAPH", F.col(predicted) == "GRAPH"
    drawn = df.select(key, truth.alias("t"), says.alias("s"), F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("replicate")).withColumn("w", copies)
    t, s, w = F.col("t"), F.col("s"), F.col("w")
    sums = drawn.groupBy("replicate").agg(*[F.coalesce(F.sum(F.when(c, w)), F.lit(0)).alias(n) for n, c in (("tp", t & s), ("fp", ~t & s), ("fn", t & ~s))])
    f1 = sums.select(ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"))
    return f1.agg(*[F.percentile("f1", q).alias(n) for q, n in ((0.025, "f1_low"), (0.5, "f1_mid"), (0.975, "f1_high"))])
