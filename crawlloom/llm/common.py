"""Helpers shared by the training-data operators: working folders, byte access to Arrow batches, components."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes in one Arrow batch that goes to a Python worker, but for one longer row. They bound the memory of both
#: sides when texts or lists are long.
ARROW_ROWS, ARROW_BYTES = 2000, 1 << 22


def shared_root(spark: SparkSession) -> str:
    """The folder all executors see: spark.checkpoint.dir, or a temporary one where it is unset (tests)."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not root:
        root = "file://" + tempfile.mkdtemp(prefix="crawlloom-")
        sc.setCheckpointDir(root)
        root = sc.getCheckpointDir()
    return root.rstrip("/")


#: Spark's own setting: a query's shuffle files go when it ends. If one were needed again, its stage would run again.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def once(spark: SparkSession) -> Iterator[None]:
    """Queries started here leave no shuffle files behind: for writes, whose plans nothing else runs."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


class Workspace:
    """Tables written to the shared folder: they cut lineage and survive the loss of executors.

    A result is read from the tables that are left, so a workspace stays until close(), or close_workspaces() for all of
    this process. folder: a fixed place instead, which a later process can take up again.
    """

    opened: list[Workspace] = []

    def __init__(self, spark: SparkSession, name: str, folder: str | None = None):
        self.spark = spark
        self.path = folder or f"{shared_root(spark)}/crawlloom/{name}-{uuid.uuid4().hex}"
        if folder is None:
            Workspace.opened.append(self)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))

    def at(self, name: str) -> str:
        return f"{self.path}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write df as Parquet and read it back."""
        path, schema = self.at(name), df.schema
        with once(self.spark):
            df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(schema).parquet(path)

    def _place(self, path: str):
        sc = self.spark.sparkContext
        p = sc._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(sc._jsc.hadoopConfiguration()), p

    def drop(self, *names: str) -> None:
        """Delete tables that nothing will read again."""
        for name in names:
            files, p = self._place(self.at(name))
            files.delete(p, True)

    def exists(self, name: str) -> bool:
        files, p = self._place(self.at(name))
        return files.exists(p)

    def close(self) -> None:
        """Delete all of it; results that read from it can't be read again."""
        files, p = self._place(self.path)
        files.delete(p, True)

    def release(self) -> None:
        """Let Spark delete the shuffle files of finished jobs now rather than at some later collection."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()


def close_workspaces(since: int = 0) -> None:
    """Delete the workspaces opened by this process, after the first `since`, once their results have been read."""
    while len(Workspace.opened) > since:
        Workspace.opened.pop().close()


def trimmed(run: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, after which the worker, which stays for other tasks, gives freed memory back to the system."""

    def own(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
        if trim:
            trim(0)

    return own


def text_buffer(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column without copying; a null counts as empty."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(array, pa.ChunkedArray):
        array = pa.concat_arrays(array.chunks) if array.num_chunks else pa.array([], array.type)
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    if array.null_count:
        array = array.fill_null("" if pa.types.is_string(array.type) or pa.types.is_large_string(array.type) else b"")
    _, offsets, data = array.buffers()
    n = len(array)
    if not n or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[array.offset : array.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def slices(batch: pa.RecordBatch, column: str, most_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that the texts of a piece hold about most_bytes; one long text stays whole."""
    _, offs = text_buffer(batch.column(column))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + most_bytes, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0]+1, … for each range, concatenated."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def components(ws: Workspace, edges: DataFrame, name: str = "cc") -> DataFrame:
    """Connected components of edges (a long, b long): rows (node, comp), comp the least node of its component.

    Contraction: each node takes its least neighbour as parent, parents are followed to their roots by pointer
    jumping, and the edges are rewritten between roots until none is left. Every round is written to the shared
    folder; only row counts come to the driver. Nodes that no edge names don't appear.
    """
    edges = ws.save(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{name}-e0")
    both = edges.select(F.col("a").alias("node")).union(edges.select("b"))
    labels = ws.save(both.distinct().select("node", F.col("node").alias("comp")), f"{name}-l0")
    k = 0
    while not edges.isEmpty():
        k += 1
        near = edges.select(F.col("a").alias("node"), F.col("b").alias("to")).union(edges.select("b", "a"))
        parent = near.groupBy("node").agg(F.least(F.min("to"), F.col("node")).alias("root"))
        parent = ws.save(parent, f"{name}-p{k}-0")
        jump = 0
        while True:
            above = parent.select(F.col("node").alias("root"), F.col("root").alias("up"))
            moved = parent.join(above, "root").select("node", F.col("up").alias("root"), (F.col("up") != F.col("root")).alias("moved"))
            jump += 1
            step = ws.save(moved, f"{name}-p{k}-{jump}")
            parent = step.select("node", "root")
            if step.where("moved").isEmpty():
                break
        roots = parent.withColumnRenamed("node", "comp")
        labels = ws.save(labels.join(roots, "comp", "left").select("node", F.coalesce("root", "comp").alias("comp")), f"{name}-l{k}")
        left = parent.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        right = parent.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        edges = edges.join(left, "a").join(right, "b").where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()
        edges = ws.save(edges, f"{name}-e{k}")
    return labels


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Where a public tokenizer's file is; the package that holds them is installed beside Python's libraries."""
    import public_tokenizers

    return public_tokenizers.path(name)


def local_file(path: str) -> str:
    """A file that a worker can open: the path, or the file of that name in the installed package."""
    return path if os.path.exists(path) else tokenizer_path(os.path.basename(path))
