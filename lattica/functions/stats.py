"""Statistics of tables and graphs, each in one pass, and a query's runtime history."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.sources.etl import column_types

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def table_stats_row(df: DataFrame) -> DataFrame:
    """One row: row_count and, for each numeric column, its distinct count, minimum and maximum; one job."""
    found: list[Column] = [F.count(F.lit(1)).alias("row_count")]
    for c in column_types(df, *NUMERIC):
        found += [F.count_distinct(F.col(c)).alias(f"{c}__distinct"), F.min(c).cast("double").alias(f"{c}__min"), F.max(c).cast("double").alias(f"{c}__max")]
    return df.agg(*found)


def column_stats(df: DataFrame) -> DataFrame:
    """(column_name, row_count, distinct_count, min, max), a row per numeric column.

    Columns are turned to rows before the aggregation, so each column is deduplicated by shuffle and not in one task.
    Values are told apart in their own types (whole numbers and decimals by all their digits), not as doubles.
    """

    def exact(c: str) -> Column:
        floating = isinstance(df.schema[c].dataType, (T.FloatType, T.DoubleType))
        return (F.col(c).cast("double") + 0.0 if floating else F.col(c)).cast("string")  # -0.0 is 0.0

    numeric = column_types(df, *NUMERIC)
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), exact(c).alias("key"), F.col(c).cast("double").alias("v")) for c in numeric])
    long = df.select(F.explode(pairs).alias("p")).select("p.*")
    by_value = long.groupBy("column_name", "key").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("v"))
    return by_value.groupBy("column_name").agg(F.sum("n").alias("row_count"), F.count("key").alias("distinct_count"), F.min("v").alias("min"), F.max("v").alias("max"))


def table_stats(name: str, df: DataFrame) -> dict:
    """The statistics document of a table."""
    row = table_stats_row(df).first().asDict()
    columns = {c: {"distinct_count": row[f"{c}__distinct"], "min": row[f"{c}__min"], "max": row[f"{c}__max"]} for c in column_types(df, *NUMERIC)}
    return {"table_name": name, "row_count": row["row_count"], "column_count": len(df.columns), "columns": columns}


def out_degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src").agg(F.count(F.lit(1)).alias("degree"))


def graph_stats(edges: DataFrame, vertices: DataFrame | None = None) -> DataFrame:
    """avg_degree, max_degree, stddev_degree, vertex_count and edge_count in one row.

    Without a vertex table, vertices are those that an edge starts from.
    """
    degree = out_degrees(edges).agg(
        F.avg("degree").alias("avg_degree"), F.max("degree").cast("double").alias("max_degree"), F.coalesce(F.stddev_samp("degree"), F.lit(0.0)).alias("stddev_degree"),
        F.count(F.lit(1)).alias("sources"), F.sum("degree").alias("edge_count"),
    )
    if vertices is None:
        return degree.withColumnRenamed("sources", "vertex_count").select("avg_degree", "max_degree", "stddev_degree", "vertex_count", "edge_count")
    counted = vertices.agg(F.count(F.lit(1)).alias("vertex_count"))
    both = degree.drop("sources").unionByName(counted, allowMissingColumns=True)  # one row each
    return both.agg(*[F.max(c).alias(c) for c in ("avg_degree", "max_degree", "stddev_degree", "vertex_count", "edge_count")])


class Statistics:
    """Statistics documents by name; unknown names have none."""

    def __init__(self, tables: dict[str, dict] | None = None, graphs: dict[str, dict] | None = None):
        self.tables, self.graphs = dict(tables or {}), dict(graphs or {})

    @staticmethod
    def load(documents: Iterable[tuple[str, str]]) -> Statistics:
        """From (name, JSON) pairs; a document with degrees is a graph's."""
        found = Statistics()
        for name, text in documents:
            document = json.loads(text)
            (found.graphs if "avg_degree" in document else found.tables)[name.removesuffix("_stats")] = document
        return found

    def is_graph(self, name: str) -> bool:
        return name in self.graphs or f"{name}_graph" in self.graphs or "graph" in name.lower()

    def graph(self, name: str) -> dict:
        return self.graphs.get(name) or self.graphs.get(f"{name}_graph") or {}

    def rows(self, name: str) -> int:
        if name in self.tables:
            return int(self.tables[name].get("row_count") or 0)
        return int(self.graph(name).get("vertex_count") or 0)

    def column(self, table: str, column: str) -> dict:
        return (self.tables.get(table) or {}).get("columns", {}).get(column) or {}


def fingerprint(op_types: Sequence[str], source: str) -> str:
    """Sixteen hex digits that operations of the same kinds on the same source share."""
    return hashlib.sha256(("|".join(sorted(op_types)) + "|" + source).encode()).hexdigest()[:16]


def fingerprint_column(op_types: str, source: str) -> Column:
    """The same for a column with an array of operation types and a column with the source."""
    return F.substring(F.sha2(F.concat(F.array_join(F.array_sort(op_types), "|"), F.lit("|"), F.col(source)), 256), 1, 16)


HISTORY = "fingerprint string, engine string, runtime_ms double, timestamp double"


def history_lookup(history: DataFrame) -> DataFrame:
    """(fingerprint, hist_avg_runtime_ms, hist_runtime_variance); the sample variance of a single run is 0."""
    return history.groupBy("fingerprint").agg(F.avg("runtime_ms").alias("hist_avg_runtime_ms"), F.coalesce(F.var_samp("runtime_ms"), F.lit(0.0)).alias("hist_runtime_variance"))


def recorded(history_path: str, runs: DataFrame) -> None:
    """Append runs to the history table."""
    runs.select("fingerprint", "engine", "runtime_ms", "timestamp").write.mode("append").parquet(history_path)


def with_history(features: DataFrame, history: DataFrame) -> DataFrame:
    """Features with their history's average and variance, -1 where there is none."""
    joined = features.drop("hist_avg_runtime_ms", "hist_runtime_variance").join(history_lookup(history), "fingerprint", "left")
    return joined.fillna(-1.0, ["hist_avg_runtime_ms", "hist_runtime_variance"])
