"""Labelled rows: merging, splitting, upsampling and the quality gate."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.operators.running import with_running_sums
from lattica.sources.etl import hashed

SIGNATURE = ("dataset", "query_id", "sub_id", "label", "sql_median_ms", "graph_median_ms", "speedup")


def signature(columns: Iterable[str]) -> Column:
    """sha256 of the columns as text, nulls as the word none."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("none")) for c in columns]), 256)


def merged(base: DataFrame, extra: DataFrame) -> DataFrame:
    """Both tables' rows, of equal signatures one."""
    both = base.unionByName(extra, allowMissingColumns=True)
    columns = [c for c in SIGNATURE if c in base.columns and c in extra.columns] or sorted(set(base.columns) & set(extra.columns))
    return both.withColumn("merge_row_id", signature(columns)).dropDuplicates(["merge_row_id"]).drop("merge_row_id")


def validated(tables: Iterable[DataFrame], datasets: Iterable[str] | None = None, label_source: str | None = "real_measurement") -> DataFrame:
    """Rows of the tables from the named datasets and of the named provenance, merged."""
    out = None
    for df in tables:
        if datasets is not None and "dataset" in df.columns:
            df = df.where(F.col("dataset").isin(list(datasets)))
        if label_source is not None and "label_source" in df.columns:
            df = df.where(F.col("label_source") == label_source)
        out = df if out is None else merged(out, df)
    if out is None:
        raise ValueError("no tables to validate")
    return out


def draw(seed: int | str, *columns: str | Column) -> Column:
    """A uniform number from the MD5 of columns as text, the same in every run and in any SQL engine."""
    return (hashed(seed, *columns) + 0.5) / float(1 << 48)


def split_by_row(df: DataFrame, key: tuple[str, ...], fraction: float = 0.2, seed: int = 42, label: str = "label", least: int = 1) -> DataFrame:
    """Rows with ``part`` "eval" for about ``fraction`` of each label, at least ``least`` of it, else "train"."""
    need = df.groupBy(F.col(label).alias("of_label")).agg(F.greatest(F.lit(least), F.round(F.count(F.lit(1)) * fraction).cast("int")).alias("need"))
    ranked = with_running_sums(df.withColumn("drawn", draw(seed, *key)), ("drawn", *key), {"rank": F.lit(1)}, (label,))
    chosen = ranked.join(need, F.col(label).eqNullSafe(F.col("of_label")))  # a row per label
    return chosen.withColumn("part", F.when(F.col("rank") <= F.col("need"), "eval").otherwise("train")).drop("drawn", "rank", "need", "of_label")


def split_by_group(df: DataFrame, group: str, fraction: float = 0.2, least: int = 1, seed: int = 42, label: str = "label") -> DataFrame:
    """Rows with ``part`` such that no group is in both parts.

    Groups in hash order go to eval for as long as their label has fewer than ``least`` rows there, then for as long
    as eval has less than ``fraction`` of all rows.  Running sums go over groups, not rows.
    """
    sizes = df.groupBy(group, label).agg(F.count(F.lit(1)).alias("n")).withColumn("u", draw(seed, group))
    sizes = with_running_sums(sizes, ("u", group), {"seen": F.col("n")}, (label,)).withColumn("needed", F.col("seen") - F.col("n") < least)
    groups = sizes.groupBy(group, "u").agg(F.sum("n").alias("n"), F.max("needed").alias("needed"))
    groups = with_running_sums(groups, (F.desc("needed"), "u", group), {"seen": F.col("n")})
    target = df.agg(F.greatest(F.lit(1), F.round(F.count(F.lit(1)) * fraction)).alias("target"))  # one row
    part = F.when(F.col("needed") | (F.col("seen") - F.col("n") < F.col("target")), "eval").otherwise("train")
    return df.join(groups.join(target, F.lit(True)).select(group, part.alias("part")), group)


def upsampled(df: DataFrame, minority: str = "GRAPH", times: int = 2, least_unique: int = 1, label: str = "label") -> DataFrame:
    """Each minority row ``times`` times, numbered by ``copy``; refused below ``least_unique`` distinct minority rows."""
    unique = df.where(F.col(label) == minority).distinct().count()
    if unique < least_unique:
        raise ValueError(f"{unique} distinct {minority} rows; {least_unique} are needed to repeat them")
    return df.withColumn("copy", F.explode(F.sequence(F.lit(0), F.when(F.col(label) == minority, times - 1).otherwise(0))))


def quality_gate(
    source: DataFrame, train: DataFrame | None = None, evaluation: DataFrame | None = None, *, least_graph: int = 50, least_graph_train: int = 30, least_graph_eval: int = 10,
    least_ratio: float = 0.05, most_duplication: float = 3.0, least_datasets: int = 2, least_real_share: float = 0.8, per_dataset: dict[str, int] | None = None,
) -> DataFrame:
    """(name, passed, detail), a row per check; each table is read once."""
    graph = F.col("label") == "GRAPH"
    sig = F.col("source_row_id").cast("string") if "source_row_id" in source.columns else signature([c for c in SIGNATURE if c in source.columns])
    real = F.avg((F.col("label_source") == "real_measurement").cast("double")) if "label_source" in source.columns else F.lit(None).cast("double")
    datasets = F.count_distinct(F.when(graph, F.col("dataset"))) if "dataset" in source.columns else F.lit(0)
    own = [F.count_if(graph & (F.col("dataset") == d)).alias(f"in_{i}") for i, d in enumerate(per_dataset or {})]
    s = source.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(graph).alias("graph"), F.count_if(F.col("label") == "SQL").alias("sql"),
        F.count_distinct(F.when(graph, sig)).alias("unique"), real.alias("real"), datasets.alias("datasets"), *own,
    ).first()
    share, again = s["graph"] / max(1, s["n"]), s["graph"] / s["unique"] if s["unique"] else float("inf")
    checks = [
        ("both_labels_present", s["sql"] > 0 and s["graph"] > 0, f"SQL={s['sql']}, GRAPH={s['graph']}"),
        ("min_graph_total", s["graph"] >= least_graph, f"{s['graph']} of {least_graph}"),
        ("min_graph_ratio", share >= least_ratio, f"{share:.4f} of {least_ratio:.4f}"),
        ("graph_across_datasets", s["datasets"] >= least_datasets, f"{s['datasets']} of {least_datasets}"),
        ("graph_duplication_factor", again <= most_duplication, f"{again:.2f}, at most {most_duplication:.2f}"),
    ]
    if s["real"] is not None:
        checks.append(("real_measurement_share", s["real"] >= least_real_share, f"{s['real']:.4f} of {least_real_share:.4f}"))
    checks += [(f"source_{d}_min_graph", s[f"in_{i}"] >= n, f"{s[f'in_{i}']} of {n}") for i, (d, n) in enumerate((per_dataset or {}).items())]
    for name, df, least in (("train", train, least_graph_train), ("eval", evaluation, least_graph_eval)):
        if df is not None:
            t = df.agg(F.count_if(graph).alias("graph"), F.count_if(F.col("label") == "SQL").alias("sql")).first()
            checks.append((f"min_graph_{name}", t["graph"] >= least, f"{t['graph']} of {least}"))
            if name == "eval":
                checks.append(("eval_both_labels_present", t["graph"] > 0 and t["sql"] > 0, f"SQL={t['sql']}, GRAPH={t['graph']}"))
    return source.sparkSession.createDataFrame([(n, bool(p), d) for n, p, d in checks], "name string, passed boolean, detail string")


def publishable(checks: DataFrame) -> bool:
    return checks.where("not passed").isEmpty()
