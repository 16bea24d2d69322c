"""Structured Streaming: bursts, de-duplication, throughput, upserts, late rows, online face assignment."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.people import assign_faces, cluster_faces
from ..operators.vectors import normalise
from ..shared import new_path as shared_path
from ..shared import written


def _micros(spark: SparkSession, duration: str) -> int:
    return spark.range(1).select(F.unix_micros(F.timestamp_seconds(F.lit(0)) + F.expr(f"interval {duration}")).alias("n")).first()["n"]


def touched_folders(observations: DataFrame, quiet: str = "1200 milliseconds", late: str = "10 seconds") -> DataFrame:
    """(folder, start, end, events): bursts of a folder with `quiet` or more between them. Works on streams and tables.

    On a stream a burst comes out, once and for all, when the watermark (the newest time less `late`) has passed its end. A folder's
    state is its open bursts; a batch's times are merged with them in one sort, so the work grows with the rows, not with the square of a folder's bursts.
    """
    gap = _micros(observations.sparkSession, quiet)
    if not observations.isStreaming:
        # a session window takes in what comes just at its end
        out = observations.groupBy("folder", F.session_window("ts", f"{gap - 1} microseconds").alias("w")).agg(F.count(F.lit(1)).alias("events"))
        return out.select("folder", F.col("w.start").alias("start"), (F.col("w.end") + F.expr("interval 1 microsecond")).alias("end"), "events")
    # a burst ends `quiet` after its last row, so the rows' own watermark waits as much longer
    rows = observations.withWatermark("ts", f"{gap + _micros(observations.sparkSession, late)} microseconds").select("folder", "ts", F.unix_micros("ts").alias("at"))
    kind = observations.schema["folder"].dataType.simpleString()
    found = rows.where("at is not null").groupBy("folder").applyInPandasWithState(
        _bursts(gap), f"folder {kind}, start long, last long, events long", "open binary", "append", GroupStateTimeout.EventTimeTimeout
    )
    return found.select("folder", F.timestamp_micros("start").alias("start"), F.timestamp_micros(F.col("last") + gap).alias("end"), "events")


def _bursts(gap: int):
    """Open bursts (start, last, events as rows of a matrix) and a batch's times to the bursts that end, and those that stay open."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = np.frombuffer(state.get[0], np.int64).reshape(3, -1) if state.exists else np.zeros((3, 0), np.int64)
        at = np.concatenate([np.zeros(0, np.int64), *(b["at"].to_numpy(np.int64) for b in batches)])
        start, last, n = np.concatenate([held, [at, at, np.ones_like(at)]], axis=1)
        order = np.argsort(start, kind="stable")
        start, last, n = start[order], np.maximum.accumulate(last[order]), n[order]
        first = np.flatnonzero(np.append(True, start[1:] - last[:-1] >= gap))[: len(start)]
        bursts = np.array([start[first], last[np.append(first[1:], len(last)) - 1], np.add.reduceat(n, first)]) if len(first) else held
        mark = state.getCurrentWatermarkMs()
        ended = bursts[1] <= mark * 1000
        if ended.all():
            state.remove()
        else:
            state.update((bursts[:, ~ended].tobytes(),))
            state.setTimeoutTimestamp(max(int(bursts[1, ~ended].min() - 1) // 1000, mark + 1))
        start, last, n = bursts[:, ended]
        yield pd.DataFrame({"folder": [key[0]] * len(n), "start": start, "last": last, "events": n})

    return run


def dedup_observations(observations: DataFrame, late: str = "10 minutes") -> DataFrame:
    """The same (path, fingerprint) once within the watermark."""
    return observations.withWatermark("ts", late).dropDuplicatesWithinWatermark(["path", "fingerprint"])


def stream_throughput(finished: DataFrame, width: str = "1 minute", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Items per tumbling window, or per sliding window."""
    rows = finished.withWatermark("ts", late) if finished.isStreaming else finished
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return rows.groupBy(w.alias("w")).agg(F.count(F.lit(1)).alias("done")).select(F.col("w.start").alias("start"), "done")


def run_available(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run what is available through foreachBatch into a table of (batch, rows), once per batch id; read it back."""
    spark = stream.sparkSession
    out = shared_path(spark, name)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    query = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", shared_path(spark, f"{name}-state"))
        .trigger(availableNow=True)
        .foreachBatch(write)
        .start()
    )
    query.awaitTermination()
    schema = T.StructType([*stream.schema.fields, T.StructField("batch_id", T.IntegerType())])
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(out)


def latest_per_key(changes: DataFrame, keys: list[str]) -> DataFrame:
    """The last state of each key of an update-mode sink."""
    w = Window.partitionBy(*keys).orderBy(F.desc("batch_id"))
    return changes.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn", "batch_id")


def apply_observations(known: DataFrame | None, batch: DataFrame) -> DataFrame:
    """Known paths (path, folder, bytes, ts, state) after a batch: the latest observation of each path wins."""
    latest = batch.groupBy("path").agg(F.max_by(F.struct("folder", "bytes", "ts", "op"), F.struct("ts", "event_id")).alias("o"))
    new = latest.select("path", "o.folder", "o.bytes", "o.ts", F.when(F.col("o.op") == "removed", "missing").otherwise("pending").alias("state"))
    if known is None:
        return new
    old = known.select("path", *[F.col(c).alias(f"k_{c}") for c in ("folder", "bytes", "ts", "state")])
    j = old.join(new, "path", "full_outer")
    keep = F.col("ts").isNull() | (F.col("k_ts") > F.col("ts"))
    same = F.col("k_bytes") == F.col("bytes")
    state = F.when(keep, F.col("k_state")).when((F.col("state") == "pending") & same & (F.col("k_state") != "missing"), F.col("k_state")).otherwise(F.col("state"))
    cols = {c: F.when(keep, F.col(f"k_{c}")).otherwise(F.col(c)) for c in ("folder", "bytes", "ts")}
    return j.select("path", *[v.alias(c) for c, v in cols.items()], state.alias("state"))


class BatchLog:
    """The last batch that a sink has finished, kept beside its tables: (batch_id, note) rows, the highest batch counts."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.path = spark, f"{root}/batches"
        self.done, self.note = -1, None
        try:
            last = spark.read.schema("batch_id long, note string").parquet(self.path).orderBy(F.desc("batch_id")).first()
        except AnalysisException as error:  # nothing is finished yet
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            last = None
        if last is not None:
            self.done, self.note = last["batch_id"], last["note"]

    def finish(self, batch_id: int, note: str | None = None) -> None:
        row = self.spark.createDataFrame([(batch_id, note)], "batch_id long, note string")
        row.coalesce(1).write.mode("append").parquet(self.path)
        self.done, self.note = batch_id, note


class UpsertSink:
    """foreachBatch target: the table of paths, partitioned by a hash of the path; a batch rewrites the partitions that it touches.

    Spark's dynamic partition overwrite replaces them when the job commits. The log of finished batches is written
    last, so a sink made anew on the same `root` goes on where the last one stopped. A finished batch is
    ignored when it comes again; one that failed on its way is applied again, which changes nothing where it
    was applied already, as the latest observation of a path wins and equal ones agree.
    """

    def __init__(self, spark: SparkSession, name: str = "observed", root: str | None = None, parts: int = 64):
        self.spark, self.root, self.parts = spark, root or shared_path(spark, name), parts
        self.log = BatchLog(spark, self.root)

    @property
    def done(self) -> int:
        return self.log.done

    def _part(self) -> Column:
        return F.pmod(F.xxhash64("path"), F.lit(self.parts)).cast("int")

    def apply(self, batch: DataFrame) -> None:
        """Fold a batch into the partitions that its paths are in."""
        rows = written(batch.withColumn("part", self._part()), "upsert-batch")
        touched = [r["part"] for r in rows.select("part").distinct().collect()]  # `parts` at most
        known = self.table.where(F.col("part").isin(touched)).drop("part") if self.started else None
        new = apply_observations(known, rows.drop("part")).withColumn("part", self._part()).repartition("part")
        new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(f"{self.root}/table")

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        if batch_id <= self.done:
            return
        self.apply(batch)
        self.log.finish(batch_id)

    @property
    def started(self) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/table")
        return path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).exists(path)

    @property
    def table(self) -> DataFrame:
        schema = "path string, folder string, bytes long, ts timestamp, state string, part int"
        return self.spark.read.schema(schema).parquet(f"{self.root}/table")


def stream_upsert(stream: DataFrame, sink: UpsertSink) -> DataFrame:
    run_sink(stream, sink)
    return sink.table


def late_observations(observations: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Rows with `is_late`: older than the newest time of an earlier batch (batch_id) less the allowance.

    The same rule as `LateRouter`, over a table; batches are numbered, and a row of each is all that meets.
    """
    newest = observations.groupBy("batch_id").agg(F.max("ts").alias("m"))
    before = Window.orderBy("batch_id").rowsBetween(Window.unboundedPreceding, -1)  # a row per batch
    marks = newest.select("batch_id", (F.max("m").over(before) - F.expr(f"interval {late}")).alias("mark"))
    joined = observations.join(F.broadcast(marks), "batch_id")
    return joined.withColumn("is_late", F.coalesce(F.col("ts") < F.col("mark"), F.lit(False))).drop("mark")


class LateRouter:
    """foreachBatch target: rows older than the newest time of all earlier batches less `late` go to a table of their own.

    Both tables hold a folder for each batch, which a batch that comes again writes again; the newest time moves on with the log of
    finished batches. Rows without a time are on time.
    """

    def __init__(self, spark: SparkSession, late: str = "10 minutes", root: str | None = None):
        self.spark, self.late, self.root = spark, late, root or shared_path(spark, "late")
        self.log, self.schema = BatchLog(spark, self.root), None

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        self.schema = batch.schema
        if batch_id <= self.log.done:
            return
        mark = F.lit(self.log.note).cast("timestamp") - F.expr(f"interval {self.late}")
        rows = written(batch.withColumn("__late", F.coalesce(F.col("ts") < mark, F.lit(False))), "late-batch")
        for name, which in (("late", F.col("__late")), ("on_time", ~F.col("__late"))):
            rows.where(which).drop("__late").write.mode("overwrite").parquet(f"{self.root}/{name}/batch={batch_id}")
        newest = rows.agg(F.greatest(F.max("ts"), F.lit(self.log.note).cast("timestamp")).cast("string").alias("t")).first()["t"]
        self.log.finish(batch_id, newest)

    def table(self, name: str) -> DataFrame:
        """The rows that were `late` or `on_time`."""
        return self.spark.read.schema(self.schema).option("recursiveFileLookup", "true").parquet(f"{self.root}/{name}")


def run_sink(stream: DataFrame, sink) -> None:
    """Send what is available to a foreachBatch target, whose `root` also names the stream's own state."""
    query = stream.writeStream.option("checkpointLocation", f"{sink.root}-state").trigger(availableNow=True).foreachBatch(sink).start()
    query.awaitTermination()


def group_sums(faces: DataFrame) -> DataFrame:
    """(person_id, sums, faces): the sum of the members' raw vectors and their number; `faces` may hold sums of earlier ones."""
    total = faces.groupBy("person_id").agg(F.sum("faces").alias("faces"))
    at = faces.select("person_id", F.posexplode("sums")).groupBy("person_id", "pos").agg(F.sum("col").alias("s"))
    sums = at.groupBy("person_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "s"))), lambda x: x["s"]).alias("sums"))
    return sums.join(total, "person_id")


class FaceAssigner:
    """foreachBatch target: faces join the nearest group of the batches before; the others are clustered
    among themselves (by `quality`, if the batch has it) and found groups; then centroids move.

    A group is kept as the sum of its members' raw vectors and their number, so a batch reads the groups and itself only,
    never the faces of earlier batches. Its faces and the new groups are folders of the batch; the log of finished batches
    comes last. A batch that comes again is ignored, or, if it didn't finish, writes its own folders again from
    the groups before it. Faces without a vector stand for themselves.
    """

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark, self.root = spark, root or shared_path(spark, "stream-faces")
        self.log = BatchLog(spark, self.root)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        if batch_id <= self.log.done:
            return
        quality = F.col("quality") if "quality" in batch.columns else F.lit(1.0)
        faces = written(batch.select("face_id", "embedding", quality.cast("double").alias("quality")), "stream-batch")
        known = self.groups
        if known is not None:
            found = assign_faces(faces, known.select("person_id", normalise(F.col("sums")).alias("centroid"))).select("face_id", "person_id")
        else:
            found = faces.select("face_id", F.lit(None).cast("long").alias("person_id"))
        seen = written(faces.join(found, "face_id"), "stream-seen")
        left = seen.where("person_id is null and size(embedding) > 0").select("face_id", "quality", normalise(F.col("embedding")).alias("embedding"))
        own = cluster_faces(left).withColumnRenamed("person_id", "founded")
        rows = seen.join(own, "face_id", "left").select("face_id", "embedding", F.coalesce("person_id", "founded", "face_id").alias("person_id"))
        rows.write.mode("overwrite").parquet(f"{self.root}/faces/batch={batch_id}")
        rows = self.spark.read.schema(rows.schema).parquet(f"{self.root}/faces/batch={batch_id}")
        grown = rows.where("size(embedding) > 0").select("person_id", F.col("embedding").alias("sums"), F.lit(1).cast("long").alias("faces"))
        grown = grown if known is None else grown.unionByName(known)
        group_sums(grown).write.mode("overwrite").parquet(f"{self.root}/groups-{batch_id}")
        self.log.finish(batch_id, f"{self.root}/groups-{batch_id}")

    @property
    def groups(self) -> DataFrame | None:
        """(person_id, sums, faces) after the last finished batch; none before the first."""
        return self.spark.read.parquet(self.log.note) if self.log.note else None

    @property
    def table(self) -> DataFrame:
        """(face_id, embedding, person_id) of all finished batches."""
        done = [f"{self.root}/faces/batch={k}" for k in range(self.log.done + 1)]
        schema = "face_id long, embedding array<double>, person_id long"
        return self.spark.read.schema(schema).parquet(*done) if done else self.spark.createDataFrame([], schema)
