"""What the corpus operators share: tables, the shared folder, and Arrow helpers."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Small rows in a task and file, where their number is known.
FILE_ROWS = 1 << 14


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors and the driver share, as the session names it.

    Only where it names none and all runs on one machine (tests) is a temporary one set.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    here = spark.sparkContext.getCheckpointDir()
    if here is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        made = tempfile.mkdtemp(prefix="lattica-shared-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(f"file://{made}")
        here = spark.sparkContext.getCheckpointDir()
    return here.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


@contextmanager
def configured(spark: SparkSession, **values: str) -> Iterator[None]:
    """Settings for the jobs that are run meanwhile; dots are written as two underscores."""
    names = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def settled(df: DataFrame, label: str = "cut", rows: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts its lineage.

    Where the caller knows that there are ``rows`` small rows at the most, it is done by a task for each ``FILE_ROWS``.

    Parquet in a shared folder survives the loss of any executor and is smaller than an RDD checkpoint.  The shuffle
    files of the write are deleted when it is done.
    """
    return settled_at(df, label, rows)[0]


def settled_at(df: DataFrame, label: str = "cut", rows: int | None = None) -> tuple[DataFrame, str]:
    """As ``settled``, and where it is, for a caller that removes it before the session ends."""
    path = fresh_path(df.sparkSession, label)
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // FILE_ROWS)))
    with configured(df.sparkSession, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true"):
        df.write.parquet(path)
    atexit.register(remove_path, df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a path of any Hadoop file system; at exit a stopped session is no error."""
    if spark.sparkContext._jsc is None:
        return
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def eased(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``rows``, after which a worker gives back the Arrow memory that it doesn't need: it may stay idle for long."""
    yield from rows
    pa.default_memory_pool().release_unused()


def light(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow that ends as ``eased`` does."""
    return lambda batches: eased(run(batches))


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def fold_of(doc_id: str, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo ``modulus``: which rows are held out of training."""
    return F.crc32(F.col(doc_id).cast("string")) % modulus


def quoted(name: str) -> str:
    """A column's name as ``F.col`` takes it, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def unused(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def where(df: DataFrame, judge: Callable[[DataFrame], DataFrame], condition: str, *needs: str) -> DataFrame:
    """The rows of ``df`` that ``condition`` keeps after ``judge``, with the columns of ``df`` as they were.

    ``judge`` sees the columns ``needs`` and a struct of all; so it can't replace a column, whatever it adds.
    """
    row = F.struct(*[F.col(quoted(c)).alias(f"c{i}") for i, c in enumerate(df.columns)])
    kept = judge(df.select(*needs, row.alias("whole_row"))).where(condition)
    return kept.select(*[F.col(f"whole_row.c{i}").alias(c) for i, c in enumerate(df.columns)])


def training_labels(labels: DataFrame, label: str, training: Column) -> DataFrame:
    """(doc_id, label) of the training rows.

    Rows without a doc_id or a label take no part; of repeated labels of one document the largest counts.
    """
    return (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
        .where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & training)
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
    )


def bounded_labels(documents: DataFrame, chosen: DataFrame, most: int | None = None) -> DataFrame:
    """(doc_id, text, label) of the ``chosen`` labels, of which about ``most`` are taken at the most, by the hash of doc_id.

    Without ``most``, the caller has bounded them.
    """
    if most is not None and (n := chosen.count()) > most:
        chosen = chosen.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) < int(most / n * (1 << 40)))
    # A bounded table of two small columns, so the documents need no shuffle.
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
