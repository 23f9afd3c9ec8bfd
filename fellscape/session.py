"""Session helpers: the shared work folder, lineage cuts and checked broadcasts."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F

#: A table with more rows than this is never broadcast by the library.
BROADCAST_ROWS = 200_000


def work_dir(spark: SparkSession) -> str:
    """Shared folder named by the cluster in ``spark.checkpoint.dir``.

    Only where none is set, and only on a single machine, a folder beside the warehouse is taken.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "-work"
        if folder.startswith(("file:", "/")) and not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError(f"{folder} is local to this machine; set spark.checkpoint.dir to a folder that all executors share")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def run_path(spark: SparkSession, name: str) -> str:
    """A fresh path for a table written by this application; its folder is deleted when the application ends."""
    context = spark.sparkContext
    run = f"{work_dir(spark).rstrip('/')}/fellscape-{context.applicationId}"
    path = context._jvm.org.apache.hadoop.fs.Path(run)
    path.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(path)
    return f"{run}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it back: computed once, and safe from lost executors."""
    path = run_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Lineage cuts for one operator: a call writes a table, ``kept`` one that outlives the others."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, []

    def __call__(self, df: DataFrame) -> DataFrame:
        self.paths.append(run_path(self.spark, "scratch"))
        df.write.parquet(self.paths[-1])
        return self.spark.read.schema(df.schema).parquet(self.paths[-1])

    def kept(self, df: DataFrame) -> DataFrame:
        return cut(df)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Scratch]:
    """Deletes the tables of the block at its end, so that what the block returns must be ``kept``."""
    held = Scratch(spark)
    try:
        yield held
    finally:
        context = spark.sparkContext
        for name in held.paths:
            path = context._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def broadcast_checked(df: DataFrame, bound: int | None = None) -> DataFrame:
    """Broadcast a table whose size is proven or measured, else leave the join to Spark.

    ``bound`` is a row count known when the plan is built (repeats x labels, say). Without
    one the table is materialised and counted; above the limit the plain join is kept, and
    adaptive execution splits its skewed keys.
    """
    if bound is None:
        df = cut(df)
        bound = df.limit(BROADCAST_ROWS + 1).count()
    return F.broadcast(df) if bound <= BROADCAST_ROWS else df


def task_count(spark: SparkSession) -> int:
    """Tasks that keep every core busy a few times over."""
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def spread(df: DataFrame, *columns: str, tasks: int | None = None) -> DataFrame:
    """Deal rows with much work each over tasks, by a hash of ``columns`` (stable under retries).

    For tables read as few large splits, such as one small file; a table of many files needs none.
    """
    return df.repartition(tasks or task_count(df.sparkSession), *[F.col(f"`{c}`") for c in columns])
