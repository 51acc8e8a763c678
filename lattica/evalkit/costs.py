"""The cost model that simulates labels, as columns, and labels from measured runs."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.evalkit.curation import draw

# Coefficients of the simulated engines in milliseconds, fixed values of the cost model.
SQL = {"base": 10.0, "row": 0.001, "filter": 3.0, "join": 20.0, "join_row": 0.003, "aggregate": 10.0, "hop": 55.0, "traversal": 40.0, "fan": 4.0, "skew": 15.0}
POINT = {"hop": 4.0, "traversal": 4.0, "graph": 32.0}
SPARSE = {"sql": 0.30, "graph": 18.0}
GRAPH = {"base": 8.0, "hop": 0.3, "fan": 0.005, "aggregate": 5.0, "filter": 2.0, "join": 12.0, "mixed_join": 8.0, "mixed_aggregate": 6.0}
RELATIONAL = {"base": 35.0, "row": 0.004, "join": 30.0, "aggregate": 18.0, "filter": 5.0}
POINT_SELECTIVITY, POINT_HOPS, SPARSE_DEGREE, FAN_HOPS, NOISE = 0.005, 1.2, 2.0, 3, 0.15


def simulated(rows: DataFrame, noise_seed: int | None = None) -> DataFrame:
    """Feature rows with sql_runtime_ms, graph_runtime_ms and label; without a seed there is no noise.

    Three regimes favour SQL for traversals: a point start of one hop, a sparse graph, and joins with aggregates.
    """
    c = F.col
    cards = F.pow(F.lit(10.0), F.greatest(c("input_cardinality_log"), F.lit(0.0)))
    hops, degree, kept = F.greatest(c("max_hops"), F.lit(0.0)), c("avg_degree"), c("selectivity")
    joins, filters, groups, walks = c("op_count_join"), c("op_count_filter"), c("op_count_aggregate"), c("op_count_traversal")
    fan = F.when(degree > 0, F.pow(degree, F.least(hops, F.lit(FAN_HOPS)))).otherwise(0.0)
    walking, point, sparse = c("has_traversal") != 0, (kept < POINT_SELECTIVITY) & (hops <= POINT_HOPS), degree < SPARSE_DEGREE

    relational_sql = SQL["base"] + cards * SQL["row"] + filters * SQL["filter"] + joins * (SQL["join"] + cards * kept * SQL["join_row"]) + groups * SQL["aggregate"]
    walk = hops * SQL["hop"] + walks * SQL["traversal"] + fan * SQL["fan"] + c("degree_skew") * SQL["skew"]
    walk = F.when(point, hops * POINT["hop"] + walks * POINT["traversal"]).when(sparse, walk * SPARSE["sql"]).otherwise(walk)
    start = F.greatest(F.lit(1.0), F.floor(cards * kept).cast("double"))
    bfs = GRAPH["base"] + start * hops * GRAPH["hop"] + start * fan * GRAPH["fan"] + groups * GRAPH["aggregate"] + filters * GRAPH["filter"] + joins * GRAPH["join"]
    bfs += F.when(point, POINT["graph"]).otherwise(0.0) + F.when(sparse, SPARSE["graph"]).otherwise(0.0)
    bfs += F.when((joins >= 2) & (groups >= 1), joins * GRAPH["mixed_join"] + groups * GRAPH["mixed_aggregate"]).otherwise(0.0)
    flat = RELATIONAL["base"] + cards * RELATIONAL["row"] + joins * RELATIONAL["join"] + groups * RELATIONAL["aggregate"] + filters * RELATIONAL["filter"]

    def shaken(cost: Column, k: int) -> Column:
        return F.greatest(F.lit(1.0), cost if noise_seed is None else cost * (1 - NOISE + 2 * NOISE * F.rand(noise_seed + k)))

    costs = rows.withColumns({"sql_runtime_ms": shaken(relational_sql + F.when(walking, walk).otherwise(0.0), 0), "graph_runtime_ms": shaken(F.when(walking, bfs).otherwise(flat), 1)})
    return costs.withColumn("label", F.when(c("graph_runtime_ms") < c("sql_runtime_ms"), "GRAPH").otherwise("SQL"))


def augmented(rows: DataFrame, columns: list[str], key: str, copies: int = 10, spread: float = 0.05, seed: int = 42) -> DataFrame:
    """``copies`` of each row with Gaussian noise on the given columns, numbered by ``copy``.

    The noise is a Box-Muller pair of uniform draws from the key's hash, so it is the same in every run.
    """
    more = rows.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))

    def noise(column: str) -> Column:
        one, other = (draw(f"{seed}:{column}:{part}", key, "copy") for part in ("r", "a"))
        return F.sqrt(-2 * F.log(one)) * F.cos(2 * math.pi * other)

    return more.withColumns({k: F.col(k) * (1 + spread * noise(k)) for k in columns})


def labelled(runs: DataFrame, penalty: float = 3.0) -> DataFrame:
    """Measured runs with the faster engine as label.

    ``runs``: primary, sql_median_ms and graph_median_ms, null where an engine failed.  Relational rows have no graph
    run and are given ``penalty`` times the SQL time; so is an engine that failed.  Rows that both failed go.
    """
    sql, graph = F.col("sql_median_ms"), F.when(F.col("primary") == "TRAVERSAL", F.col("graph_median_ms"))
    # The reasons' words are fixed values of the format.
    rows = runs.withColumns({"fallback_reason": F.when(sql.isNull() & graph.isNotNull(), "sql_failed_or_penalized").when((F.col("primary") == "TRAVERSAL") & graph.isNull(), "graph_failed").otherwise("none")})
    rows = rows.where(sql.isNotNull() | graph.isNotNull()).withColumns({"sql_median_ms": F.coalesce(sql, graph * penalty), "graph_median_ms": F.coalesce(graph, sql * penalty)})
    return rows.withColumns(
        {
            "fallback_applied": F.col("fallback_reason") != "none",
            "label": F.when(F.col("graph_median_ms") < F.col("sql_median_ms"), "GRAPH").otherwise("SQL"),
            "speedup": F.col("sql_median_ms") / F.greatest(F.col("graph_median_ms"), F.lit(1e-6)),
        }
    )
