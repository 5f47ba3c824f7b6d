"""Shared helpers: materialised tables, guarded broadcasts, connected components."""

from __future__ import annotations

import ctypes
import gc
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table is broadcast only when its counted rows, and its bytes on disk, are at most this many.
BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 16 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; only where that is unset, a folder in the warehouse."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return (found or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/quillon_checkpoints").rstrip("/")


def materialise(df: DataFrame) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back.

    Cuts the lineage like checkpoint() but computes the plan once, and the files outlive any
    executor. The reread carries the written schema, so empty tables work too.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quillon-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop shuffle files whose plans are no longer referenced."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def discard(*tables: DataFrame) -> None:
    """Delete materialised tables that nothing reads any more, as in the rounds of a loop."""
    for df in tables:
        for file in df.inputFiles()[:1]:
            jvm = df.sparkSession._jvm
            folder = jvm.org.apache.hadoop.fs.Path(file).getParent()
            if folder.getName().startswith("quillon-"):
                folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)


def guarded(df: DataFrame, limit: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """df, a materialised table, with a broadcast hint if it has at most limit rows and size bytes, else as it is.

    The count reads only file footers; the bytes are those of its files.
    """
    small = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= size
    return F.broadcast(df) if small and df.count() <= limit else df


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000):
    """Rows go to Python workers in Arrow batches of at most so many, for tables of whole texts."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before))) if int(before) > 0 else str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def trim() -> None:
    """Give memory that this Python worker no longer uses back to the system; workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # a C library without it
        pass


def quoted(name: str) -> str:
    """A column's name for F.col and select, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def shuffle_width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def free_name(stem: str, *frames: DataFrame) -> str:
    """A column name that no frame uses (compared without case)."""
    taken = {c.lower() for f in frames for c in f.columns}
    name = stem
    while name.lower() in taken:
        name = f"{name}_"
    return name


def components(edges: DataFrame) -> DataFrame:
    """Connected components by alternating large-star and small-star steps.

    edges: columns (a, b) of one orderable type. Returns (node, component) for every node of an
    edge; component is the smallest node reachable. Nulls and self loops are ignored. Each step
    is a partially aggregated minimum, written out, and an equi-join on the node: broadcast
    where the minima are few, else a join of two plain shuffles, which adaptive execution splits
    at a hub. Nothing reaches the driver but a few counts a round, by which convergence is seen.
    Each round only replaces a node's neighbours by smaller ones of its component, so rounds end;
    a round's table is deleted once the next is written.
    """
    e = materialise(edges.where("a is not null and b is not null and a <> b")
                    .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = None
    while True:
        large, low = _large_star(e)
        large = materialise(large)
        discard(low)
        small, low = _small_star(large)
        small = materialise(small)
        discard(e, large, low)
        e = small
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    roots = e.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _large_star(e: DataFrame) -> tuple[DataFrame, DataFrame]:
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = materialise(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
    return both.join(guarded(low), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), low


def _small_star(e: DataFrame) -> tuple[DataFrame, DataFrame]:
    low = materialise(e.groupBy("u").agg(F.min("v").alias("m")))
    moved = e.join(guarded(low), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), low


def forest(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spanning edges (node, root) of the components of pairs, one for each node that is no root."""
    nodes, flat = np.unique(pairs, return_inverse=True)
    flat = flat.reshape(-1, 2)
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[flat[:, 0]], root[flat[:, 1]])
        new = root.copy()
        np.minimum.at(new, root[flat[:, 0]], low)
        np.minimum.at(new, root[flat[:, 1]], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    away = root != np.arange(len(nodes))
    return nodes[away], nodes[root[away]]
