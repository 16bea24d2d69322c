"""Sources and sinks: folder listings, text documents, pixels, snapshots, activity, streams of observations."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import extension

# Folders that a listing skips, by lower-case name.
SKIP_DIRS = [
    "node_modules", "target", ".git", ".svn", ".hg", "__pycache__", ".venv", "venv", ".next", ".cache", "dist", "build", "out",
    "vendor", "pods", "deriveddata", "library", "$recycle.bin", "system volume information", ".trash", ".gradle", ".idea",
]
MAX_DEPTH = 24

OBSERVATION = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("props", T.StringType()),
    ]
)


def observe_files(spark: SparkSession, root: str, skip: list[str] = SKIP_DIRS, depth: int = MAX_DEPTH) -> DataFrame:
    """(path, name, ext, parent, bytes, modified_at) under `root`, without dot entries, skipped folders and what is too deep.

    Contents are pruned from the scan: only the listing is read.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length", "modificationTime")
    base = F.regexp_replace(F.lit(root.rstrip("/")), "^file:/*", "/")
    plain = F.regexp_replace("path", "^file:/*", "/")
    parts = F.filter(F.split(F.substring(plain, F.length(base) + 1, F.length(plain)), "/"), lambda p: p != "")
    rows = found.select(plain.alias("path"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified_at"), parts.alias("parts"))
    folders = F.slice("parts", 1, F.greatest(F.size("parts") - 1, F.lit(0)))
    fine = ~F.exists("parts", lambda p: p.startswith(".")) & ~F.exists(folders, lambda p: F.lower(p).isin(skip)) & (F.size("parts") <= depth)
    name = F.element_at("parts", -1)
    parent = F.regexp_extract("path", "([^/]*)/[^/]*$", 1)
    return rows.where(fine).select("path", name.alias("name"), extension(F.col("path")).alias("ext"), parent.alias("parent"), "bytes", "modified_at")


def decode_text(content: Column) -> Column:
    """UTF-8 if valid, else UTF-16 behind a byte-order mark, else Latin-1."""
    utf16 = F.hex(F.substring(content, 1, 2)).isin("FFFE", "FEFF")
    return (
        F.when(F.is_valid_utf8(content.cast("string")), content.cast("string"))
        .when(utf16, F.decode(content, "UTF-16"))
        .otherwise(F.decode(content, "ISO-8859-1"))
    )


def read_text_documents(spark: SparkSession, root: str, limit: int = 400_000) -> DataFrame:
    """(path, text): text files, decoded, at most `limit` characters ."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "content")
    return raw.select("path", F.substring(decode_text(F.col("content")), 1, limit).alias("text"))


def read_pixels(spark: SparkSession, root: str) -> DataFrame:
    """(path, x, y, r, g, b) of each picture, through Spark's image source."""
    images = spark.read.format("image").load(root).select("image.*").where("nChannels >= 3")
    step = F.col("nChannels")
    at = images.select("origin", "width", "nChannels", "data", F.explode(F.sequence(F.lit(0), F.col("width") * F.col("height") - 1)).alias("k"))
    byte = lambda c: F.conv(F.hex(F.substring("data", F.col("k") * step + 1 + c, F.lit(1))), 16, 10).cast("int")
    return at.select(
        F.col("origin").alias("path"), (F.col("k") % F.col("width")).cast("int").alias("x"), F.floor(F.col("k") / F.col("width")).cast("int").alias("y"),
        byte(2).alias("r"), byte(1).alias("g"), byte(0).alias("b"),
    )


_POINTER = "name string, path string, number long"


def _pointers(spark: SparkSession, folder: str, name: str) -> DataFrame | None:
    try:
        return spark.read.schema(_POINTER).parquet(f"{folder}/{name}/_pointers")
    except AnalysisException as error:  # the first version
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def write_snapshot(df: DataFrame, folder: str, name: str) -> str:
    """A new immutable version of a table; the pointer row that names it is written last."""
    version = f"{folder}/{name}/v-{uuid.uuid4().hex}"
    df.write.parquet(version)
    spark = df.sparkSession
    there = _pointers(spark, folder, name)
    number = 1 + (there.agg(F.max("number").alias("n")).first()["n"] or 0 if there is not None else 0)
    row = spark.createDataFrame([(name, version, number)], _POINTER)
    row.coalesce(1).write.mode("append").parquet(f"{folder}/{name}/_pointers")
    return version


def read_snapshot(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The version that the pointer of the highest number names; of writers that met at one number, the greatest path."""
    newest = _pointers(spark, folder, name).orderBy(F.desc("number"), F.desc("path")).first()
    return spark.read.parquet(newest["path"])


def append_activity(events: DataFrame, path: str) -> None:
    events.write.mode("append").parquet(path)


def observe_stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """An unbounded stream of event files with a fixed schema."""
    return spark.readStream.schema(OBSERVATION).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
