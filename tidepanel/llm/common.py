"""What the operators of this subpackage share: reading tables, writing intermediate tables, Arrow batches."""

from __future__ import annotations

import ctypes
import gc
import os
import re
import uuid
from collections.abc import Callable, Iterator
from functools import reduce
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

REPO = str(Path(__file__).resolve().parents[2])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The setting for the bytes that go to a Python worker at once, Spark's own value of it, and ours.
BATCH, DEFAULT, BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "4m"


def importable(spark: SparkSession) -> None:
    """Python workers find this package wherever the driver was started, and get small batches unless the session says otherwise."""
    if spark.conf.get(BATCH, None) == DEFAULT:
        spark.conf.set(BATCH, BYTES)
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if REPO not in paths:
        env["PYTHONPATH"] = os.pathsep.join([REPO, *paths])


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where that is unset, one of this machine's, in local mode only."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return "/tmp/tidepanel-checkpoints"


class Scratch:
    """Intermediate tables of one query, written as Parquet under the shared checkpoint folder.

    A written table cuts the lineage and outlives lost executors. ``drop`` removes a table
    that no later step reads.
    """

    def __init__(self, spark: SparkSession):
        importable(spark)
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def keep(self, *names: str) -> None:
        """Removes all tables but these."""
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        files = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if files.exists(root):
            self.drop(*{s.getPath().getName() for s in files.listStatus(root)}.difference(names))

    def drop(self, *names: str) -> None:
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def tidied(step: Callable) -> Callable:
    """step over batches, after which the worker gives free memory back: workers live on for other tasks."""

    def run(batches):
        yield from step(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
        if trim:
            trim(0)

    return run


def chained(*steps: Callable) -> Callable:
    """Several steps over batches as one, so that a task needs one Python worker for them."""
    return lambda batches: reduce(lambda found, step: step(found), steps, batches)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n + 1 offsets; null counts as empty. No copy."""
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    if column.null_count:  # a null may own bytes, though Spark writes none
        lengths = np.where(column.is_null().to_numpy(zero_copy_only=False), 0, np.diff(offsets))
        if lengths.sum() != offsets[-1] - offsets[0]:
            return utf8(column.fill_null(""))
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def row_chunks(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes each; a longer row stands alone."""
    n, a = len(offsets) - 1, 0
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + limit, side="right")) - 1
        b = min(max(b, a + 1), n)
        yield a, b
        a = b


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def texts_of(array: pa.Array, a: int, b: int) -> list[str]:
    """Python strings of rows a to b, empty for null."""
    return [t if t is not None else "" for t in array.slice(a, b - a).to_pylist()]


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (two multiply-xorshift rounds) over a uint64 array."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
