"""Comparing results, and timing queries."""

from __future__ import annotations

import json
import statistics
import time
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def canonical(df: DataFrame, decimals: int = 6) -> list[Column]:
    """Columns in order of name as text, fractions rounded."""
    kinds = dict(df.dtypes)
    text = lambda c: F.format_string(f"%.{decimals}f", F.round(F.col(f"`{c}`").cast("double"), decimals)) if kinds[c] in ("double", "float") or kinds[c].startswith("decimal") else F.col(f"`{c}`").cast("string")
    return [F.coalesce(F.when(F.col(f"`{c}`").isNotNull(), text(c)), F.lit("NULL")).alias(c) for c in sorted(df.columns)]


def checksum(df: DataFrame, decimals: int = 6) -> DataFrame:
    """(row_count, checksum): a digest of a result that doesn't depend on the order of rows or columns.

    Row hashes are summed, so nothing is sorted or collected, whatever the result's size.
    """
    row = F.conv(F.substring(F.md5(F.concat_ws("\x1f", *canonical(df, decimals))), 1, 12), 16, 10).cast("decimal(38,0)")
    return df.select(row.alias("h")).agg(F.count(F.lit(1)).alias("row_count"), F.coalesce(F.sum("h"), F.lit(0).cast("decimal(38,0)")).cast("string").alias("checksum"))


def column_checksums(df: DataFrame, decimals: int = 6) -> DataFrame:
    """(column_name, checksum), a digest per column."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), k.alias("v")) for c, k in zip(sorted(df.columns), canonical(df, decimals), strict=True)]))
    long = df.select(cells.alias("c")).select("c.*")
    return long.groupBy("column_name").agg(F.sum(F.conv(F.substring(F.md5("v"), 1, 12), 16, 10).cast("decimal(38,0)")).cast("string").alias("checksum"))


def differences(one: DataFrame, other: DataFrame, decimals: int = 6) -> DataFrame:
    """Rows of either result that the other lacks, counting repeats, with ``side``."""
    a, b = one.select(canonical(one, decimals)), other.select(canonical(other, decimals))
    return a.exceptAll(b).withColumn("side", F.lit("left")).union(b.exceptAll(a).withColumn("side", F.lit("right")))


@dataclass(frozen=True)
class Report:
    query_id: str
    columns_match: bool
    left_rows: int
    right_rows: int
    left_checksum: str
    right_checksum: str

    @property
    def passed(self) -> bool:
        return self.columns_match and (self.left_rows, self.left_checksum) == (self.right_rows, self.right_checksum)


def compared(query_id: str, one: DataFrame, other: DataFrame, decimals: int = 6) -> Report:
    a, b = checksum(one, decimals).first(), checksum(other, decimals).first()
    return Report(query_id, sorted(one.columns) == sorted(other.columns), a[0], b[0], a[1], b[1])


def report_table(spark: SparkSession, reports: Iterable[Report]) -> DataFrame:
    rows = [(r.query_id, r.columns_match, r.left_rows, r.right_rows, r.left_checksum, r.right_checksum, r.passed) for r in reports]
    return spark.createDataFrame(rows, "query_id string, columns_match boolean, left_rows long, right_rows long, left_checksum string, right_checksum string, passed boolean")


@dataclass(frozen=True)
class Timing:
    median_ms: float
    std_ms: float
    mean_ms: float
    min_ms: float
    max_ms: float
    failures: int


def timed(make: Callable[[], DataFrame], warm_ups: int = 1, runs: int = 3) -> Timing:
    """Run a query to the end with a sink that drops rows; the median is the upper one of an even number."""
    times, failures = [], 0
    for i in range(warm_ups + runs):
        began = time.perf_counter()
        try:
            make().write.format("noop").mode("overwrite").save()
        except Exception:  # noqa: BLE001  a failed run is counted, and its reason is the caller's to look into
            failures += 1
            continue
        if i >= warm_ups:
            times.append((time.perf_counter() - began) * 1000)
    if not times:
        return Timing(*[float("inf")] * 5, failures)
    times.sort()
    return Timing(times[len(times) // 2], statistics.pstdev(times), statistics.fmean(times), times[0], times[-1], failures)


def strategy_runs(spark: SparkSession, strategies: dict[str, Callable[[str], Callable[[], DataFrame]]], query_ids: Iterable[str], warm_ups: int = 0, runs: int = 3) -> DataFrame:
    """(strategy, query_id, median_latency_ms, ..., success), a row per strategy and query."""
    rows = []
    for name, make in strategies.items():
        for q in query_ids:
            t = timed(make(q), warm_ups, runs)
            rows.append((name, q, t.median_ms, t.mean_ms, t.min_ms, t.max_ms, t.median_ms != float("inf")))
    return spark.createDataFrame(rows, "strategy string, query_id string, median_latency_ms double, mean_latency_ms double, min_latency_ms double, max_latency_ms double, success boolean")


def scale_experiment(spark: SparkSession, places: dict[str, str], strategies: Callable[[str], dict[str, Callable[[str], Callable[[], DataFrame]]]], query_ids: Sequence[str], warm_ups: int = 0, runs: int = 1) -> DataFrame:
    """The strategies' runs at every scale: ``places`` has a folder per scale, ``strategies`` makes them for a folder.

    A scale whose folder isn't there is left out.  (scale, strategy, query_id, latencies, success).
    """
    found = None
    for scale, folder in places.items():
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            continue
        one = strategy_runs(spark, strategies(folder), query_ids, warm_ups, runs).withColumn("scale", F.lit(scale))
        found = one if found is None else found.unionByName(one)
    if found is None:
        raise ValueError(f"none of {sorted(places.values())} is there")
    return found.select("scale", *[c for c in found.columns if c != "scale"])


def status(spark: SparkSession, gate: DataFrame | None = None, f1: float | None = None, reports: DataFrame | None = None, ablated: DataFrame | None = None, least_f1: float = 0.95, least_drop: float = 0.005) -> DataFrame:
    """(item, passed, detail): a checklist of the gate, the model's F1, results that agree, and features that matter."""
    rows: list[tuple[str, bool, str]] = []
    if gate is not None:
        failed = [r["name"] for r in gate.where("not passed").orderBy("name").collect()]  # a row per check
        rows.append(("quality_gate", not failed, ", ".join(failed) or "all passed"))
    if f1 is not None:
        rows.append(("model_f1", f1 >= least_f1, f"{f1:.4f} of {least_f1:.4f}"))
    if reports is not None:
        n, ok = reports.agg(F.count(F.lit(1)), F.count_if("passed")).first()
        rows.append(("results_agree", n == ok, f"{ok} of {n}"))
    if ablated is not None:
        drop = ablated.agg(F.max("f1_drop")).first()[0] or 0.0
        rows.append(("features_matter", drop >= least_drop, f"{drop:.4f} of {least_drop:.4f}"))
    return spark.createDataFrame(rows, "item string, passed boolean, detail string")


def written_json(document: dict, spark: SparkSession, path: str) -> None:
    """A statistics document as one JSON file of any Hadoop file system."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(hadoop, True)
    try:
        out.write(bytearray(json.dumps(document, sort_keys=True).encode()))
    finally:
        out.close()
