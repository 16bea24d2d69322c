"""Tables that jobs keep in the folder which driver and executors share."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where that is unset, a local one in local mode (tests) only."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    sc = spark.sparkContext
    if not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if getattr(sc, "_catalogspark_folder", None) is None:
        sc._catalogspark_folder = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
    return sc._catalogspark_folder


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """`df` written as a Parquet table in the shared folder and read back."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, keys: list[str], move: bool = True) -> DataFrame:
    """`df` written in the shared folder as a table bucketed and sorted by `keys`, so that joins on them don't move it.

    Where a join by `keys` has just dealt the rows, they needn't `move` again; other rows are then written in more, smaller files."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"{name}_{uuid.uuid4().hex}"
    rows = (df.repartition(n, *keys) if move else df).write.bucketBy(n, *keys).sortBy(*keys)
    rows.option("path", f"{shared_dir(spark)}/{table}").saveAsTable(table)
    return spark.table(table)


def built_once(df: DataFrame) -> DataFrame:
    """`df` computed once and kept by checkpoint() in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def bounded_batches(df: DataFrame, size: int = 4 << 20) -> DataFrame:
    """`df`, with the session's Arrow batches held to `size` bytes: a worker and its JVM hold each batch several times.

    The setting stays, as plans read it when they run; a smaller one is left alone."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(str(conf.get(key)).rstrip("bB")) <= size:
        conf.set(key, str(size))
    return df


def lean(run: Callable) -> Callable:
    """`run`, a task over Arrow batches, whose worker hands free memory back to the system after it."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)

    return task
