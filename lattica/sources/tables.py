"""Tables and graphs by name."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from lattica.operators.traversal import Graph

#: Graphs of fewer vertices may be kept by the session.
CACHED_VERTICES = 2_000_000


class MissingTable(LookupError):
    """No folder holds a table or graph of this name."""


class Tables:
    """Parquet tables of some folders (any Hadoop URI), registered frames, and registered graphs.

    A name is looked up among registered frames, then as ``folder/name`` and ``folder/name.parquet`` in the order of
    the folders, then as ``name_vertices`` and ``name_edges`` in graph folders.  A name that has a maker (derived or
    compatibility tables) is made by it when it is first asked for.
    """

    def __init__(
        self, spark: SparkSession, *folders: str, graph_folders: tuple[str, ...] = (), makers: dict[str, Callable[[], DataFrame]] | None = None, graph_makers: dict[str, Callable[[], Graph]] | None = None
    ):
        self.spark, self.folders, self.graph_folders = spark, folders, graph_folders
        self.makers, self.graph_makers = dict(makers or {}), dict(graph_makers or {})
        self.frames: dict[str, DataFrame] = {}
        self.graphs: dict[str, Graph] = {}
        self.aliases: dict[str, str] = {}

    def put(self, name: str, df: DataFrame) -> Tables:
        self.frames[name] = df
        return self

    def put_graph(self, name: str, vertices: DataFrame, edges: DataFrame, default_label: str | None = None) -> Tables:
        self.graphs[name] = Graph.of(vertices, edges, default_label)
        return self

    def _read(self, path: str) -> DataFrame | None:
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if not hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
            return None
        try:
            return self.spark.read.parquet(path)
        except AnalysisException as error:
            if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                return None
            raise

    def _find(self, folders: tuple[str, ...], *names: str) -> DataFrame | None:
        for folder in folders:
            for name in names:
                for path in (f"{folder}/{name}", f"{folder}/{name}.parquet"):
                    if (df := self._read(path)) is not None:
                        return df
        return self._read(names[0]) if "/" in names[0] else None

    def table(self, name: str) -> DataFrame:
        """A table; a graph's name gives its vertices.  The frame is kept and is a temporary view of the session."""
        name = self.aliases.get(name, name)
        if name in self.frames:
            return self.frames[name]
        found = self.makers[name]() if name in self.makers else self._find(self.folders, name)
        if found is None:
            found = self._find(self.graph_folders, name, f"{name}_vertices")
        if found is None and (name in self.graphs or name in self.graph_makers):
            found = self.graph(name).vertices
        if found is None:
            raise MissingTable(f"no table '{name}' in {[*self.folders, *self.graph_folders]}")
        self.frames[name] = found
        if re.fullmatch(r"\w+", name):
            found.createOrReplaceTempView(name)
        return found

    def graph(self, name: str, default_label: str | None = "KNOWS", cached: bool = False) -> Graph:
        """A graph by name; ``cached`` keeps one of fewer than ``CACHED_VERTICES`` vertices in memory or on disk."""
        if cached:
            found = self.graph(name, default_label)
            if found.vertices.limit(CACHED_VERTICES).count() < CACHED_VERTICES and not found.edges.is_cached:
                found.edges.persist(StorageLevel.MEMORY_AND_DISK)
            return found
        name = self.aliases.get(name, name)
        if name not in self.graphs and name in self.graph_makers:
            self.graphs[name] = self.graph_makers[name]()
        if name not in self.graphs:
            everywhere = (*self.graph_folders, *self.folders)
            vertices, edges = self._find(everywhere, f"{name}_vertices", f"{name}/vertices"), self._find(everywhere, f"{name}_edges", f"{name}/edges")
            if vertices is None or edges is None:
                raise MissingTable(f"no graph '{name}' in {list(everywhere)}")
            self.put_graph(name, vertices, edges, default_label)
        return self.graphs[name]

    def has(self, name: str) -> bool:
        for look in (self.table, self.graph):
            try:
                look(name)
            except MissingTable:
                continue
            return True
        return False

    def missing(self, query) -> list[str]:
        """Names that a query needs and nothing provides."""
        ops = {n.op_id for n in query.nodes}
        names = [n.source for n in query.nodes] + [n.join["right_source"] for n in query.nodes if n.join]
        return sorted({x for x in names if x not in ops and not self.has(x)})
