"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: What a worker keeps for its later tasks, by the work that needs it.
_held: dict = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where that is unset, a local one in local mode (tests) only."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    sc = spark.sparkContext
    if not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if getattr(sc, "_catalogspark_shared", None) is None:
        sc._catalogspark_shared = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
    return sc._catalogspark_shared


def held(name: str, make: Callable):
    """make(), kept in the worker until `lean` turns it to other work."""
    if name not in _held:
        _held[name] = make()
    return _held[name]


def lean(run: Callable, work: str = "") -> Callable:
    """`run`, a task over Arrow batches, in a worker that holds little: what other work than `work` left is dropped
    before, and free memory goes back to the system after."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name in [n for n in _held if not work or not n.startswith(work)]:
            del _held[name]
        yield from run(batches)
        release()

    return task


def release() -> None:
    """Hand the process's free memory back to the system, where its allocators can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """`df` computed once and kept by checkpoint() in the shared folder."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint()


def staged(df: DataFrame, name: str) -> DataFrame:
    """`df` written as a Parquet table in the shared folder and read back."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded_batches(df: DataFrame, size: int = 4 << 20) -> DataFrame:
    """`df`, with the session's Arrow batches held to `size` bytes: texts are long, and a worker and its JVM hold
    each batch several times. The setting stays, as plans read it when they run; a smaller one is left alone."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(str(conf.get(key)).rstrip("bB")) <= size:
        conf.set(key, str(size))
    return df


def crc32_mod(doc_id, mod: int):
    """crc32 of the id as text, modulo `mod`."""
    return F.crc32(doc_id.cast("string").cast("binary")) % mod
