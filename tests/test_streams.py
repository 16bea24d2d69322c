"""Streams against the batch answer or a sequential rule, and batches that come again."""

import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from catalogspark.operators.people import SAME
from catalogspark.plans.stream_queries import _batches
from catalogspark.streaming import streams as W

T0 = dt.datetime(2024, 1, 1)


def of(spark, *rows):
    made = [(i, T0 + dt.timedelta(seconds=s), f, p, "seen", 5) for i, s, f, p in rows]
    return spark.createDataFrame(made, "event_id long, ts timestamp, folder string, path string, op string, bytes long")


def test_bursts_close_with_the_watermark(spark):
    rows = of(spark, *[(i, s, f, "/a") for i, (s, f) in enumerate([(0, "a"), (1, "a"), (2.1, "a"), (4, "a"), (1, "b"), (60, "a"), (60.5, "b"), (61, "a"), (200, "b"), (900, "x")])])
    parts = [F.col("event_id") < 2, F.col("event_id").between(2, 5), F.col("event_id").between(6, 8), F.col("event_id") == 9]
    got = W.run_available(W.touched_folders(_batches(rows, parts)), "t").select("folder", "start", "events").collect()
    want = W.touched_folders(rows).where("folder <> 'x'").select("folder", "start", "events").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) == 6


def test_a_pause_of_just_the_quiet_time_parts_bursts(spark):
    """On tables and streams, as the SQL twin has it; over batches of several files."""
    rows = of(spark, *[(i, s, "a", "/a") for i, s in enumerate([0, 1.2, 2.399999, 50, 51.2, 51.3, 900])])
    stream = _batches(rows, [F.col("event_id") < 2, F.col("event_id").between(2, 5), F.col("event_id") == 6], file_rows=2)
    of_ = lambda found: sorted(((r.start - T0).total_seconds(), (r.end - T0).total_seconds(), r.events) for r in found.collect())
    want = [(0.0, 1.2, 1), (1.2, 3.599999, 2), (50.0, 51.2, 1), (51.2, 52.5, 2)]
    assert of_(W.run_available(W.touched_folders(stream), "t")) == want
    assert of_(W.touched_folders(rows))[:-1] == want


def test_late_rows_go_aside(spark):
    rows = of(spark, *[(i, s, "f", "/a") for i, s in enumerate([0, 7000, 10, 5000, 3300, 9000, 3399, 3400, 20000, 5399])]).withColumn("batch_id", F.floor(F.col("event_id") / 3).cast("int"))
    sink = W.LateRouter(spark, "1 hour")
    W.run_sink(_batches(rows, [F.col("batch_id") == k for k in range(4)]), sink)
    want = {r.event_id: r.is_late for r in W.late_observations(rows, "1 hour").collect()}
    here = lambda s: {r.event_id: late for name, late in (("late", True), ("on_time", False)) for r in s.table(name).collect()}
    assert here(sink) == want and set(want.values()) == {True, False}
    again = W.LateRouter(spark, "1 hour", root=sink.root)
    again(rows.where("batch_id = 1"), 1)  # a replay, to a router made anew
    assert here(again) == want and again.log.done == 3


def sequential(batches):
    """Faces by batch: nearest centroid of the batches before at SAME or more, else greedy leaders among the rest; then sums move."""
    sums, out = {}, {}
    unit = lambda v: v / np.linalg.norm(v)
    for batch in batches:
        rest, now = [], {}
        for face, quality, e in batch:
            near = [(round(float(unit(e) @ unit(s)), 9), -p) for p, s in sums.items()]
            best = max(near, default=(0, 0))
            if best[0] >= SAME:
                now[face] = -best[1]
            else:
                rest.append((-quality, face, unit(e)))
        leaders = []
        for _, face, e in sorted(rest, key=lambda x: x[:2]):
            near = [(round(float(e @ v), 9), -p) for p, v in leaders]
            best = max(near, default=(0, 0))
            now[face] = -best[1] if best[0] >= SAME else face
            if best[0] < SAME:
                leaders.append((face, e))
        for face, _, e in batch:
            sums[now[face]] = sums.get(now[face], 0) + e
        out |= now
    return out


def test_faces_on_a_stream_equal_the_sequential_rule(spark):
    r = np.random.default_rng(5)
    people = r.standard_normal((9, 16))
    made = [(i, float(i * 37 % 11), (people[i % 9] + 0.8 * r.standard_normal(16)).tolist()) for i in range(150)]
    df = spark.createDataFrame(made, "face_id long, quality double, embedding array<double>")
    sink = W.FaceAssigner(spark)
    W.run_sink(_batches(df, [F.col("face_id") % 4 == k for k in range(4)]), sink)
    want = sequential([[(i, q, np.array(e)) for i, q, e in made if i % 4 == k] for k in range(4)])
    assert {x.face_id: x.person_id for x in sink.table.collect()} == want and len(set(want.values())) < 60
    # batches that come again, to the same sink and to one made anew
    sink(df.where("face_id % 4 = 0"), 0)
    again = W.FaceAssigner(spark, root=sink.root)
    again(df.where("face_id % 4 = 3"), 3)
    assert {x.face_id: x.person_id for x in again.table.collect()} == want
    assert again.groups.agg(F.sum("faces")).first()[0] == 150
    # a batch that failed before its log was written is written again from the groups before it
    spark.range(1).write.mode("overwrite").parquet(f"{again.root}/faces/batch=4")
    again(spark.createDataFrame([(900, 1.0, made[0][2]), (901, 1.0, None)], df.schema), 4)
    got = {x.face_id: x.person_id for x in again.table.collect()}
    assert got[900] == want[0] and got[901] == 901 and len(got) == 152


def test_upserts_write_touched_partitions_only(spark):
    sink = W.UpsertSink(spark, parts=8)
    sink(of(spark, *[(i, i, "f", f"/{i}") for i in range(200)]), 0)
    before = {(r.part, r.name) for r in sink.table.select("part", F.input_file_name().alias("name")).distinct().collect()}
    sink(of(spark, (900, 900, "g", "/7")), 1)
    after = {(r.part, r.name) for r in sink.table.select("part", F.input_file_name().alias("name")).distinct().collect()}
    touched = sink.table.where("path = '/7'").first()
    assert {p for p, _ in before ^ after} == {touched.part} and touched.folder == "g" and sink.table.count() == 200
    sink.apply(of(spark, (900, 900, "g", "/7"), (5, 5, "f", "/5")))  # applied twice
    assert sink.table.count() == 200 and sink.table.where("folder = 'g'").count() == 1


def test_snapshots_of_one_moment(spark, tmp_path):
    from catalogspark.sources.files import read_snapshot, write_snapshot

    for n in (3, 1, 2):
        write_snapshot(spark.range(n), str(tmp_path), "t")
    assert read_snapshot(spark, str(tmp_path), "t").count() == 2
