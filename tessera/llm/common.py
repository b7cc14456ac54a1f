"""What the corpus operators share: shared scratch tables, text batches, connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null id inside the operators: smaller than every other id.
NULL_ID = -(2**63)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share. It is ``spark.checkpoint.dir``; only where that
    is unset on a single machine (tests) a temporary one is made and set. A cluster must name one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, deleted when the session's JVM ends."""
    path = f"{shared_folder(spark)}/tessera-{label}-{uuid.uuid4().hex}"
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return path


def keep(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: it is computed once, its lineage
    is cut, and a lost executor costs no recomputation of what came before."""
    path = scratch_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def slices(batch: pa.RecordBatch, column: str, max_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about ``max_bytes`` of text each, at least one row each."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    if not len(sizes):
        return
    part = (np.cumsum(sizes) - sizes) // max_bytes
    cuts = np.flatnonzero(np.diff(part)) + 1
    for a, b in zip([0, *cuts], [*cuts, len(sizes)], strict=True):
        yield batch.slice(a, b - a)


def flat_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string column as one byte array and n + 1 offsets; null counts as empty."""
    column = pc.fill_null(column, "").cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def with_ids(df: DataFrame, *columns: str, key: str = "doc_id") -> DataFrame:
    """``key`` as long with null as :data:`NULL_ID`, and the named columns; extra columns are left out."""
    return df.select(F.coalesce(F.col(key).cast("long"), F.lit(NULL_ID)).alias(key), *columns)


def real_id(column: str = "doc_id"):
    """The id as given: :data:`NULL_ID` is null again."""
    return F.when(F.col(column) != NULL_ID, F.col(column)).alias(column)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an undirected graph of long ids: (node, component), where
    component is the smallest node reachable. Each round every node points to its smallest
    neighbour, pointers are followed to their end, and the graph is contracted; the number of
    nodes left falls fast, so rounds are few. State stays in tables of the shared folder."""
    spark = edges.sparkSession
    pairs = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x <> y")
    pairs = keep(pairs.union(pairs.select("y", "x")).distinct(), "edges")
    labels = None
    while not pairs.isEmpty():
        parent = pairs.groupBy("x").agg(F.min("y").alias("y")).select(F.col("x").alias("node"), F.least("x", "y").alias("up"))
        parent = keep(parent, "parent")
        while True:
            upper = parent.select(F.col("node").alias("up"), F.col("up").alias("top"))
            jumped = keep(parent.join(upper, "up").select("node", F.col("top").alias("up"), (F.col("top") != F.col("up")).alias("moved")), "jump")
            moved = jumped.where("moved").isEmpty()
            parent = jumped.select("node", "up")
            if moved:
                break
        if labels is None:
            labels = parent.select("node", F.col("up").alias("component"))
        else:
            step = parent.select(F.col("node").alias("component"), F.col("up"))
            labels = keep(labels.join(step, "component", "left").select("node", F.coalesce("up", "component").alias("component")), "labels")
        left = parent.select(F.col("node").alias("x"), F.col("up").alias("x2"))
        right = parent.select(F.col("node").alias("y"), F.col("up").alias("y2"))
        pairs = keep(pairs.join(left, "x").join(right, "y").where("x2 <> y2").select(F.col("x2").alias("x"), F.col("y2").alias("y")).distinct(), "edges")
    return labels if labels is not None else spark.createDataFrame([], "node long, component long")
