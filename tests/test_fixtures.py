"""Small inline tables with results worked out by hand."""

import datetime as dt
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from catalogspark.functions import text as X
from catalogspark.operators import changes, describe, labels, neighbours, organize, people, pixels, search, vectors
from catalogspark.operators.index import SearchIndex
from catalogspark.sources import files as S
from catalogspark.streaming import streams as W


def column(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i long, v {kind}")
    return [r.o for r in df.select("i", expr(F.col("v")).alias("o")).orderBy("i").collect()]


def test_stem(spark):
    words = ["motorcycles", "classes", "analysis", "glass", "bus", "cities", "dies", "cat", "cars"]
    assert column(spark, words, X.stem) == ["motorcycle", "class", "analysis", "glass", "bus", "city", "die", "cat", "car"]


def test_tokens_fold_marks_on_the_index_side(spark):
    assert column(spark, ["Größe-É1, naïve"], lambda v: X.tokens(v, fold=True)) == [["große", "e1", "naive"]]
    assert column(spark, [None, ""], X.tokens) == [[], []]


def test_kinds_and_extensions(spark):
    names = ["Screenshot 1.png", "a.png", "CleanShot x.jpg", "b.MP4", "c.tar.gz", ".hidden", "noext"]
    exts = column(spark, names, X.extension)
    assert exts == ["png", "png", "jpg", "mp4", "gz", "", ""]
    df = spark.createDataFrame([(n, e, "capture" if n == "noext" else "x") for n, e in zip(names, exts)], "n string, e string, f string")
    got = [r.k for r in df.select(X.classify_kind(F.col("n"), F.col("e"), F.col("f")).alias("k")).collect()]
    assert got == ["screenshot", "photo", "screenshot", "video", "archive", "other", "other"]
    assert column(spark, ["png", "weird"], X.mime_for) == ["image/png", "application/octet-stream"]


def test_safe_segments(spark):
    raw = ["../../etc", 'a/b\\c:d*e?f"g<h>i|j', "CON", "con.txt", "a" * 200, "", None, "...", "IMG.v2 2019"]
    want = ["etc", "a b c d e f g h i j", "_CON", "_con.txt", "a" * 60, "Unfiled", "Unfiled", "Unfiled", "IMG.v2 2019"]
    assert column(spark, raw, X.safe_segment) == want


def test_captions_and_snippets(spark):
    assert column(spark, ["a  red bike .", "The sea.", "x", None], X.clean_caption) == ["Red bike", "Sea", None, None]
    line = "x" * 100 + " needle\n" + "y" * 200
    (got,) = column(spark, [line], lambda v: X.snippet(v, F.array(F.lit("needle")), 40))
    assert got.startswith("…") and got.endswith("…") and "needle y" in got
    parts = column(spark, ["The cat, the dog"], lambda v: X.highlight(v, ["the"]))[0]
    assert [(p.text, p.hit) for p in parts] == [("The", True), (" cat, ", False), ("the", True), (" dog", False)]


def test_interpretation(spark):
    raw = [("1", "images from yesterday"), ("2", "game screenshots"), ("3", "receipts from last month"), ("4", 'show "exact words" of #Work is:star since:9'), ("5", "")]
    got = {r.query_id: r for r in search.interpret_queries(spark.createDataFrame(raw, "query_id string, raw string")).collect()}
    assert (got["1"].terms, got["1"].since_days) == (["images"], 2)
    assert (got["2"].terms, got["2"].kinds) == (["game"], ["screenshot"])
    assert (got["3"].terms, got["3"].since_days) == (["receipts"], 30)
    assert (got["4"].terms, got["4"].tags, got["4"].favorites, got["4"].since_days) == (["exact words"], ["work"], True, 9)
    assert got["5"].terms == [] and got["5"].since_days is None


def _files(spark):
    t = dt.datetime(2024, 2, 1)
    rows = [
        (1, "red.png", "Red motorcycle", "a red motorcycle parked at night", "photo", "indexed", t, False, ["bike"], "png"),
        (2, "sofa.png", "Dog", "a dog lounging on a grey sofa", "photo", "indexed", t, True, [], "png"),
        (3, "gone.png", "Red", "red red red", "photo", "missing", t, False, [], "png"),
        (4, "bill.pdf", "Receipt", "total due 10", "document", "indexed", t, False, [], "pdf"),
    ]
    df = spark.createDataFrame(rows, "file_id long, name string, title string, description string, kind string, index_state string, created_at timestamp, favorite boolean, tags array<string>, ext string")
    df = df.withColumns({"bytes": F.lit(5 << 20), "width": F.lit(None).cast("int"), "height": F.lit(None).cast("int"), "collections": F.col("tags")})
    return df.withColumns({c: F.lit(None).cast("string") for c in ("label", "ocr_text", "project_id")}).withColumn("folder_path", F.lit("/f"))


def test_description_search(spark):
    files = _files(spark)
    docs = files.where("index_state <> 'missing'").select("file_id", "name", "title", "description", "label", "ocr_text", F.col("folder_path").alias("folder"), F.array_join("tags", " ").alias("tags"), "ext")
    q = spark.createDataFrame([("a", "the red motorbike at night"), ("b", "dogs on couches"), ("c", '"grey sofa"'), ("d", "kind:document OR #bike"), ("e", "red -night")], "query_id string, raw string")
    got = {}
    for r in describe.describe_search(q, files.where("index_state <> 'missing'"), docs, F.to_timestamp(F.lit("2024-03-01"))).orderBy("query_id", "place").collect():
        got.setdefault(r.query_id, []).append(r.file_id)
    assert got == {"a": [1], "b": [2], "c": [2], "d": [1, 4], "e": []} or got == {"a": [1], "b": [2], "c": [2], "d": [1, 4]}


def test_search_batch_end_to_end(spark):
    files = _files(spark)
    tags = files.select("file_id", F.explode("tags").alias("tag"), F.lit("user").alias("source"))
    none = spark.createDataFrame([], "file_id long, person_id long")
    who = spark.createDataFrame([], "person_id long, hidden boolean, label string")
    docs = search.build_search_docs(files, tags, none, who)
    q = spark.createDataFrame([("a", "motorcycle"), ("b", "#bike"), ("c", "kind:document"), ("d", "otorcycl"), ("e", "is:fav dog")], "query_id string, raw string")
    got = {}
    for r in search.search_batch(q, files, docs, tags, F.to_timestamp(F.lit("2024-03-01"))).collect():
        got.setdefault(r.query_id, []).append(r.file_id)
        assert 0 <= r.score <= 1
    assert got == {"a": [1], "b": [1], "c": [4], "d": [1], "e": [2]}


def test_labels(spark):
    rows = [(1, "dog", 0.40), (1, "beach", 0.06), (1, "night", 0.04), (2, "code", 0.09), (2, "ui", 0.03), (3, "code", 0.08), (3, "ui", 0.07)]
    df = spark.createDataFrame(rows, "file_id long, label string, share double")
    got = {}
    for r in labels.select_labels(df, ["scene"]).collect():
        got.setdefault(r.file_id, []).append(r.label)
    assert got == {1: ["dog"], 2: ["code"]}
    shares = labels.pool(spark.createDataFrame(rows, "file_id long, label string, score double"))
    assert all(abs(r.s - 1) < 1e-9 for r in shares.groupBy("file_id").agg(F.sum("share").alias("s")).collect())


def test_tags_and_context(spark):
    rows = [(1, "screenshot", "x.png", [], "Traceback (most recent call last): self.x"), (2, "photo", "beach.jpg", [], None), (3, "photo", "x", ["#Dog", "scene", "two words"], "")]
    df = spark.createDataFrame(rows, "file_id long, kind string, name string, labels array<string>, text string")
    d = labels.derive_tags(df)
    got = {r.file_id: [(t.name, t.source) for t in r.tags] for r in d.collect()}
    assert got[1] == [("python", "ocr"), ("error", "ocr"), ("screenshot", "kind")] and got[2] == [] and got[3] == [("dog", "vision")]
    assert {r.file_id: r.context for r in labels.infer_context(d).collect()} == {1: "Programming / Python debugging", 2: None, 3: "Photographs / Animals"}


def test_user_tags_survive(spark):
    old = spark.createDataFrame([(1, "a", "user"), (1, "b", "ocr"), (2, "c", "ocr")], "file_id long, tag string, source string")
    new = spark.createDataFrame([(1, "a", "vision"), (1, "d", "ocr")], "file_id long, tag string, source string")
    assert sorted(map(tuple, labels.replace_machine_tags(old, new).collect())) == [(1, "a", "user"), (1, "d", "ocr"), (2, "c", "ocr")]


def _face(axis, bias=0.0):
    v = [0.0] * 128
    v[axis], v[axis + 1] = 1.0, bias
    n = sum(x * x for x in v) ** 0.5
    return [x / n for x in v]


def test_faces_group_by_leaders(spark):
    rows = [(1, 9.0, _face(0)), (2, 8.0, _face(0, 0.35)), (3, 7.0, _face(0, 0.5)), (4, 6.0, _face(40)), (5, 6.0, _face(40, 0.1)), (6, 1.0, _face(80))]
    df = spark.createDataFrame(rows, "face_id long, quality double, embedding array<double>")
    got = {r.face_id: r.person_id for r in people.cluster_faces(df).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6}


def test_leaders_equal_the_sequential_rule(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet").limit(120).select(F.col("vec_id").alias("face_id"), (F.col("vec_id") * 37 % 101).cast("double").alias("quality"), F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))
    e = spark.createDataFrame(e.collect(), e.schema)
    rows = sorted(e.collect(), key=lambda r: (-r.quality, r.face_id))
    dot = lambda a, b: round(sum(x * y for x, y in zip(a, b)), 9)
    lead, want = [], {}
    for r in rows:
        near = [(dot(r.embedding, x.embedding), -x.face_id, x) for x in lead]
        near = [n for n in near if n[0] >= people.SAME]
        if near:
            want[r.face_id] = max(near, key=lambda n: n[:2])[2].face_id
        else:
            lead.append(r)
            want[r.face_id] = r.face_id
    assert {r.face_id: r.person_id for r in people.cluster_faces(e).collect()} == want


def test_merge_and_undo(spark):
    f = spark.createDataFrame([(k, k, k % 4, [float(k), 1.0 / (k + 1), 2.0]) for k in range(12)], "face_id long, file_id long, person_id long, embedding array<double>")
    p = people.centroids(f).select("person_id", "centroid", F.col("faces").alias("face_count"), F.when(F.col("person_id") > 1, "Ann").alias("label"), (F.col("person_id") == 3).alias("hidden"))
    p = spark.createDataFrame(p.collect(), p.schema)
    rows = lambda df: sorted(df.collect(), key=str)
    f1, p1, log = people.merge_people(f, p, [0, 1, 2], 0)
    assert p1.count() == 2 and f1.where("person_id = 0").count() == 9
    own = p1.where("person_id = 0").first()
    assert own.face_count == 9 and own.centroid == pytest.approx(people.centroids(f1).where("person_id = 0").first().centroid)
    assert {r.file_id for r in people.merged_files(f1, log).collect()} == {k for k in range(12) if k % 4 != 3}
    for ids, into in [([], 0), ([0], 0), ([77], 0), ([0], 77)]:
        same = people.merge_people(f1, p1, ids, into, log)
        assert [rows(x) for x in same] == [rows(f1), rows(p1), rows(log)]
    f2, p2, log = people.merge_people(f1, p1, [0], 3, log)
    assert [r.person_id for r in p2.collect()] == [3]
    f3, p3, log = people.undo_merge(f2, p2, log)
    assert rows(f3) == rows(f1) and rows(p3.select(*p1.columns)) == rows(p1)
    f4, p4, log = people.undo_merge(f3, p3, log)
    assert rows(f4.select(*f.columns)) == rows(f) and rows(p4.select(*p.columns)) == rows(p)
    again = people.undo_merge(f4, p4, log)
    assert rows(again[1]) == rows(p4) and log.where("kind = 'undo'").count() == 2


def test_pixels(spark):
    flat = [(1, x, y, 128, 128, 128) for x in range(6) for y in range(6)]
    bands = [(2, x, y, *[(255, 0, 0), (0, 255, 0), (0, 0, 255)][x // 2]) for x in range(6) for y in range(6)]
    warm = [(3, x, 0, 180, 90, 70) for x in range(2)]
    df = spark.createDataFrame(flat + bands + warm, "image_id long, x int, y int, r int, g int, b int")
    t = {r.image_id: r for r in pixels.tone(df).collect()}
    assert t[1].contrast == pytest.approx(0) and t[3].temperature == "warm"
    p = {}
    for r in pixels.palette(df).collect():
        p.setdefault(r.image_id, []).append(((r.r, r.g, r.b), round(r.share, 4)))
    assert p[1] == [((128, 128, 128), 1.0)] and sorted(s for _, s in p[2]) == [0.3333] * 3
    assert {r.image_id: r.sharpness for r in pixels.sharpness(df).collect()}[3] == 0.0
    assert {r.colour for r in pixels.colour_share(pixels.palette(df).where("image_id = 2")).collect()} == {"red", "green", "blue"}


def test_collisions_never_overwrite(spark):
    plan = spark.createDataFrame([(k, "/o/x.jpg") for k in range(4)] + [(9, "/o/x (2).jpg"), (10, "/o/y")], "file_id long, target string")
    there = spark.createDataFrame([("/o/x.jpg",), ("/o/x (3).jpg",)], "path string")
    got = {r.file_id: r.target for r in organize.resolve_collisions(plan, there).collect()}
    assert len(got) == 6 and len(set(got.values())) == 6
    assert got[9] == "/o/x (2).jpg" and got[10] == "/o/y" and not {"/o/x.jpg", "/o/x (3).jpg"} & set(got.values())


def test_replaying_a_scan_changes_nothing(spark):
    known = spark.createDataFrame([(1, "f", "/a", "h1", "indexed"), (2, "f", "/b", "h2", "missing")], "file_id long, folder_id string, path string, hash string, index_state string")
    seen = spark.createDataFrame([("f", "/a", "h1"), ("f", "/b", "h2"), ("f", "/c", "h3")], "folder_id string, path string, hash string")
    assert {r.path: r.change for r in changes.diff_scan(known, seen).collect()} == {"/a": "unchanged", "/b": "returned", "/c": "added"}


def test_vectors(spark):
    a = spark.createDataFrame([(1, [3.0, 4.0], [0.0, 0.0], [1.0])], "i long, a array<double>, z array<double>, w array<double>")
    r = a.select(vectors.normalise(F.col("a")), vectors.normalise(F.col("z")), vectors.cosine(F.col("a"), F.col("w"))).first()
    assert r[0] == [0.6, 0.8] and r[1] == [0.0, 0.0] and r[2] == 0.0


def test_approximate_neighbours_recall(spark, sf):
    ix = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))
    q = ix.where("id % 100 = 0").withColumnRenamed("id", "query_id")
    exact = {(r.query_id, r.id) for r in vectors.knn(q, ix, 5).collect()}
    found = {(r.query_id, r.id) for r in neighbours.knn_approx(q, ix, 5, 64).collect()}
    assert len(exact & found) / len(exact) >= 0.9


def test_listing_and_texts(spark, tmp_path):
    for name, data in {"a.txt": b"plain", "sub/b.md": "Grüße".encode("latin-1"), "node_modules/x.js": b"x", ".git/y": b"y", "sub/.z": b"z", "u.txt": "hé".encode("utf-16")}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    got = {r.name: (r.ext, r.bytes) for r in S.observe_files(spark, f"file://{tmp_path}").collect()}
    assert got == {"a.txt": ("txt", 5), "b.md": ("md", 5), "u.txt": ("txt", 6)}
    texts = {r.path.rsplit("/", 1)[1]: r.text for r in S.read_text_documents(spark, f"file://{tmp_path}").collect()}
    assert texts["a.txt"] == "plain" and texts["b.md"] == "Grüße" and texts["u.txt"] == "hé"


def _png(width, height, rgb):
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    raw = b"".join(b"\0" + bytes(rgb) * width for _ in range(height))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_pictures_become_pixels(spark, tmp_path):
    (tmp_path / "p.png").write_bytes(_png(3, 2, (10, 200, 30)))
    got = [(r.x, r.y, r.r, r.g, r.b) for r in S.read_pixels(spark, f"file://{tmp_path}").collect()]
    assert sorted(got) == [(x, y, 10, 200, 30) for x in range(3) for y in range(2)]


def test_snapshots_and_activity(spark, tmp_path):
    df = spark.range(5)
    S.write_snapshot(df, f"file://{tmp_path}", "t")
    S.write_snapshot(df.limit(2), f"file://{tmp_path}", "t")
    assert S.read_snapshot(spark, f"file://{tmp_path}", "t").count() == 2
    for _ in range(2):
        S.append_activity(df, f"file://{tmp_path}/log")
    assert spark.read.parquet(f"file://{tmp_path}/log").count() == 10


def test_upserts_are_idempotent(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [(1, t, "f", "/a", "seen", 5), (2, t + dt.timedelta(seconds=1), "f", "/a", "removed", 5), (3, t, "f", "/b", "seen", 7)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, folder string, path string, op string, bytes long")
    sink = W.UpsertSink(spark)
    for batch_id in (0, 0, 1):
        sink(df, batch_id)
    assert {(r.path, r.state, r.bytes) for r in sink.table.collect()} == {("/a", "missing", 5), ("/b", "pending", 7)}


def test_upserts_go_on_after_a_restart(spark):
    t = dt.datetime(2024, 1, 1)
    of = lambda *rows: spark.createDataFrame(rows, "event_id long, ts timestamp, folder string, path string, op string, bytes long")
    first = W.UpsertSink(spark)
    first(of((1, t, "f", "/a", "seen", 5)), 0)
    again = W.UpsertSink(spark, root=first.root)
    assert again.done == 0
    again(of((9, t, "f", "/z", "seen", 5)), 0)  # a replay
    # the batch was applied, but the driver went before its log
    batch = of((2, t + dt.timedelta(seconds=1), "f", "/b", "seen", 7))
    W.UpsertSink(spark, root=first.root).apply(batch)
    again = W.UpsertSink(spark, root=first.root)
    again(batch, 1)
    assert {r.path for r in W.UpsertSink(spark, root=first.root).table.collect()} == {"/a", "/b"}


def test_coverage(spark):
    docs = spark.createDataFrame([(1, "A red motorcycle parked at night in two cities", "", "", "", "")], "file_id long, description string, title string, ocr_text string, label string, tags string")
    rows = [("a", ["red", "motorcycles", "night"]), ("b", ["red", "helicopter"]), ("c", ["city"]), ("d", ["green"])]
    criteria = spark.createDataFrame(rows, "query_id string, terms array<string>")
    index = SearchIndex(docs)
    got = {r.query_id: (r.covered, r.together) for r in search.coverage(criteria, index).collect()}
    assert got == {"a": (1.0, 1), "b": (0.5, 0), "c": (1.0, 0)}
    assert {r.query_id for r in search.coverage(criteria, index, criteria.where("query_id < 'c'").withColumn("file_id", F.lit(1))).collect()} == {"a", "b"}


def test_neighbours_with_many_equal_scores():
    """The smallest ids stay of equal scores, whatever their number."""
    import numpy as np

    from catalogspark.operators.vectors import best_of

    score = np.full((2, 2000), 0.5)
    score[0, 1500], score[1, 7] = 0.9, 0.1
    ids = np.arange(2000)[::-1].copy()
    rows, at = best_of(score, ids, 5)
    assert ids[at[rows == 0]].tolist() == [499, 0, 1, 2, 3] and ids[at[rows == 1]].tolist() == [0, 1, 2, 3, 4]


def test_more_than_999_files_of_one_target(spark):
    from catalogspark.operators.organize import resolve_collisions

    plan = spark.range(1200).selectExpr("id AS file_id", "'/a/x.txt' AS target")
    listing = spark.createDataFrame([("/a/x (5).txt",)], "path string")
    got = {r.target for r in resolve_collisions(plan, listing).collect()}
    assert len(got) == 1200 and "/a/x (5).txt" not in got and "/a/x.txt" in got


def test_odd_query_vectors_find_nothing(spark):
    ix = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [1.0])], "id long, embedding array<double>")
    q = spark.createDataFrame([(1, [1.0, 0.1]), (2, None), (3, [1.0, 0.0, 0.0]), (4, []), (5, [2.0])], "query_id long, embedding array<double>")
    for l2 in (False, True):
        got = sorted((r.query_id, r.id, r.place) for r in vectors.knn(q, ix, 5, l2).collect())
        assert got == [(1, 1, 1), (1, 2, 2), (5, 4, 1)]
    assert vectors.knn(q.where("query_id = 2"), ix, 5).collect() == []


def test_files_looked_at_again(spark):
    """New detections replace a file's faces; those near no group found groups of their own; a file may lose all its faces."""
    rows = [(1, 10, 1, 5.0, _face(0)), (2, 10, 2, 5.0, _face(20)), (3, 11, 1, 4.0, _face(0, 0.2)), (4, 12, 2, 4.0, _face(20, 0.1)), (5, 13, 2, 4.0, _face(20))]
    faces = spark.createDataFrame(rows, "face_id long, file_id long, person_id long, quality double, embedding array<double>")
    who = spark.createDataFrame([(1, "Ann", False), (2, None, False)], "person_id long, label string, hidden boolean")
    new = [(101, 10, 1.0, _face(0, 0.1)), (102, 10, 2.0, _face(60)), (103, 14, 9.0, _face(60, 0.2)), (104, 10, 1.0, [])]
    detected = spark.createDataFrame(new, "face_id long, file_id long, quality double, embedding array<double>")
    seen = spark.createDataFrame([(10,), (13,), (14,)], "file_id long")
    found, groups = people.store_faces(faces, who, detected, seen)
    got = {(r.face_id, r.file_id, r.person_id) for r in found.collect()}
    assert got == {(3, 11, 1), (4, 12, 2), (101, 10, 1), (102, 10, 103), (103, 14, 103)}
    assert {(r.person_id, r.label) for r in groups.collect()} == {(1, "Ann"), (2, None), (103, None)}
