"""Making this package importable in Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent


def reachable() -> bool:
    """Whether workers find the package by PYTHONPATH or, started in this folder, by themselves."""
    listed = [Path(p).resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    return ROOT.parent in listed or Path.cwd() == ROOT.parent


def shipped(spark: SparkSession) -> SparkSession:
    """Give the session's workers a zip of the package if they wouldn't find it; once per Spark context."""
    context = spark.sparkContext
    if not reachable() and not getattr(context, "_lattica_shipped", False):
        path = Path(tempfile.mkdtemp(prefix="lattica-")) / "lattica.zip"
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            for f in sorted(ROOT.rglob("*.py")):
                z.write(f, f.relative_to(ROOT.parent))
        context.addPyFile(str(path))
        context._lattica_shipped = True
    return spark
