"""Queries of listing, roll-ups, change detection and versions, each with its SQL twin over the catalog's views."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import changes as C
from ..operators import listing as L
from ..sources.adapters import NOW, Catalog, oracle
from ..sources.files import read_snapshot, write_snapshot
from ..streaming.streams import UpsertSink, shared_path

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, body: str | None):
    def register(build):
        QUERIES[name] = lambda spark, sf_dir: build(Catalog(spark, sf_dir))
        if body is not None:
            SQL[name] = oracle(body)
        return build

    return register


def sec(column: str):
    return F.unix_timestamp(column).alias(column)


HERE = "index_state <> 'missing'"
T0 = f"TIMESTAMP '{NOW}'"


@query("s4_load_catalog", "SELECT file_id, name, kind, bytes, width, height, epoch(created_at)::BIGINT AS created_at, favorite, index_state, label FROM files")
def s4(c):
    return c.files.select("file_id", "name", "kind", "bytes", "width", "height", sec("created_at"), "favorite", "index_state", "label")


@query("s5_write_snapshot", "SELECT file_id, name, bytes FROM files WHERE index_state <> 'missing'")
def s5(c):
    """Two versions of the files; the newest pointer decides which one is read."""
    root = shared_path(c.spark, "snapshots")
    write_snapshot(c.files.select("file_id", "name", "bytes"), root, "files")
    write_snapshot(c.files.where(HERE).select("file_id", "name", "bytes"), root, "files")
    return read_snapshot(c.spark, root, "files")


@query("s8_upsert_sink", "SELECT path, arg_max(op, (ts, event_id)) = 'removed' AS gone FROM observations GROUP BY path")
def s8(c):
    """The observations in four batches, the second of them delivered twice, to a sink made anew before each."""
    sink = UpsertSink(c.spark)
    part = F.pmod(F.xxhash64("event_id"), F.lit(4))
    for batch_id in (0, 1, 1, 2, 3):
        sink = UpsertSink(c.spark, root=sink.root)
        sink(c.observations.where(part == batch_id), batch_id)
    return sink.table.select("path", (F.col("state") == "missing").alias("gone"))


@query("c1_fingerprint", "SELECT file_id, lower(to_hex(bytes)) || ':' || strftime(modified_at, '%Y-%m-%dT%H:%M:%S') AS hash FROM files")
def c1(c):
    return c.files.select("file_id", "hash")


@query(
    "c2_classify",
    "SELECT file_id, kind, CASE ext WHEN 'txt' THEN 'text/plain' WHEN 'md' THEN 'text/markdown' WHEN 'pdf' THEN 'application/pdf'"
    " WHEN 'png' THEN 'image/png' WHEN 'jpg' THEN 'image/jpeg' WHEN 'mp4' THEN 'video/mp4' WHEN 'json' THEN 'application/json'"
    " WHEN 'fig' THEN 'application/figma' WHEN 'zip' THEN 'application/zip' ELSE 'application/octet-stream' END AS mime,"
    " ext NOT IN ('fig', 'zip', 'xyz') AS processable, ext AS extension FROM files",
)
def c2(c):
    e = F.col("ext")
    return c.files.select("file_id", X.classify_kind(F.col("name"), e, F.col("folder_path")).alias("kind"), X.mime_for(e).alias("mime"),
                          X.is_processable(e).alias("processable"), X.extension(F.col("path")).alias("extension"))


def _observed(c):
    """A later look at the folders: some files gone, some changed, some new."""
    i = F.col("file_id")
    files = c.files.withColumn("supported", X.is_processable(F.col("ext")))
    later = F.timestamp_seconds(F.unix_timestamp("modified_at") + 60)
    altered = files.withColumns({"hash": F.concat("hash", F.lit("+")), "bytes": F.col("bytes") + 1, "modified_at": later})
    seen = files.where((i % 9 != 0) & (i % 8 != 0)).unionByName(altered.where((i % 9 != 0) & (i % 8 == 0)))
    new = files.where(i % 21 == 0).withColumn("path", F.concat("path", F.lit(".new")))
    return seen.unionByName(new).select("folder_id", "path", *C.SCANNED, "created_at", "supported")


def _scan(c):
    return C.diff_scan(c.files, _observed(c))


_SCAN = """, seen AS (
  SELECT folder_id, path, file_id % 8 = 0 AS altered FROM files WHERE file_id % 9 <> 0
  UNION ALL SELECT folder_id, path || '.new', false FROM files WHERE file_id % 21 = 0
), diff AS (
  SELECT coalesce(f.folder_id, s.folder_id) AS folder_id, coalesce(f.path, s.path) AS path, f.file_id,
         CASE WHEN f.file_id IS NULL THEN 'added' WHEN s.path IS NULL THEN 'missing' WHEN f.index_state = 'missing' THEN 'returned'
              WHEN s.altered THEN 'changed' ELSE 'unchanged' END AS change
  FROM files f FULL JOIN seen s ON f.folder_id = s.folder_id AND f.path = s.path
)
"""


@query("c3_diff_scan", _SCAN + "SELECT folder_id, path, file_id, change FROM diff")
def c3(c):
    return _scan(c).select("folder_id", "path", "file_id", "change")


@query(
    "c4_apply_scan",
    _SCAN + "SELECT coalesce(f.path, d.path) AS path, coalesce(f.bytes, n.bytes) + CASE WHEN change <> 'missing' AND f.file_id % 8 = 0 THEN 1 ELSE 0 END AS bytes,"
    " epoch(coalesce(f.created_at, n.created_at))::BIGINT AS created_at,"
    " epoch(coalesce(f.modified_at, n.modified_at))::BIGINT + CASE WHEN change <> 'missing' AND f.file_id % 8 = 0 THEN 60 ELSE 0 END AS modified_at,"
    " CASE WHEN change <> 'missing' AND f.file_id % 8 = 0 THEN epoch(f.modified_at)::BIGINT END AS previous_modified_at,"
    " CASE WHEN change = 'missing' THEN 'missing' WHEN f.file_id % 8 <> 0 AND f.index_state IN ('indexed', 'unsupported') THEN f.index_state"
    " WHEN coalesce(f.ext, n.ext) IN ('fig', 'zip', 'xyz') THEN 'unsupported' ELSE 'pending' END AS index_state,"
    " CASE WHEN change = 'missing' OR (f.file_id % 8 <> 0 AND f.index_state IN ('indexed', 'unsupported')) THEN f.ocr_state WHEN coalesce(f.ext, n.ext) IN ('fig', 'zip', 'xyz') THEN 'none' ELSE 'pending' END AS ocr_state,"
    f" epoch(coalesce(f.indexed_at, {T0}))::BIGINT AS indexed_at, CASE WHEN change <> 'missing' THEN epoch({T0})::BIGINT END AS seen_at"
    " FROM diff d LEFT JOIN files f USING (file_id) LEFT JOIN files n ON d.file_id IS NULL AND n.path || '.new' = d.path",
)
def c4(c):
    after = C.apply_scan(c.files, _scan(c), _observed(c), c.now)
    return after.select("path", "bytes", sec("created_at"), sec("modified_at"), sec("previous_modified_at"), "index_state", "ocr_state", sec("indexed_at"), sec("seen_at"))


@query("c5_mark_missing", "SELECT file_id, name FROM files WHERE file_id % 9 = 0 AND folder_id <> 'src3'")
def c5(c):
    """One folder wasn't scanned."""
    scanned = c.files.where("folder_id <> 'src3'")
    return C.mark_missing(c.files, scanned.where("file_id % 9 <> 0"), scanned).select("file_id", "name")


@query(
    "c6_scan_summary",
    _SCAN + "SELECT folder_id, " + ", ".join(f"count(*) FILTER (change = '{s}') AS {s}" for s in ("added", "changed", "unchanged", "missing", "returned"))
    + ", count(*) FILTER (change <> 'missing') AS discovered, count(*) FILTER (change IN ('added', 'changed', 'returned') AND regexp_matches(path, '[.](fig|zip|xyz)([.]new)?$')) AS unsupported FROM diff GROUP BY folder_id",
)
def c6(c):
    return C.scan_summary(_scan(c), _observed(c))


@query(
    "c6_scan_queue",
    _SCAN + "SELECT d.folder_id, d.path, coalesce(f.kind, n.kind) AS kind, d.file_id IS NULL AS is_new FROM diff d LEFT JOIN files f USING (file_id) LEFT JOIN files n ON d.file_id IS NULL AND n.path || '.new' = d.path"
    " WHERE change IN ('added', 'changed', 'returned') AND coalesce(f.ext, n.ext) NOT IN ('fig', 'zip', 'xyz')",
)
def c6b(c):
    known = c.files.select("file_id", F.lit(False).alias("is_new"))
    rows = C.scan_queue(_scan(c), _observed(c)).join(known, "file_id", "left")
    return rows.select("folder_id", "path", "kind", F.coalesce("is_new", F.lit(True)).alias("is_new"))


@query(
    "c7_work_backlog",
    "SELECT 'analysis' AS stage, file_id FROM files WHERE index_state = 'indexed' AND ((analysis_state NOT IN ('analysed', 'described') AND attempts < 3)"
    " OR (file_id % 7 = 0 AND kind IN ('photo', 'screenshot', 'video', 'document', 'design')))"
    " UNION ALL SELECT 'faces', file_id FROM files WHERE index_state = 'indexed' AND kind IN ('photo', 'screenshot', 'video') AND faces_state <> 'scanned'"
    " UNION ALL SELECT 'interrupted', file_id FROM files WHERE index_state IN ('pending', 'processing')"
    " UNION ALL SELECT 'failed', file_id FROM files WHERE index_state = 'failed'",
)
def c7(c):
    """A preview is missing where the id is a multiple of seven."""
    shown = c.files.where("file_id % 7 <> 0")
    parts = [C.work_backlog(c.files, s, shown).select(F.lit(s).alias("stage"), "file_id") for s in ("analysis", "faces", "interrupted", "failed")]
    return parts[0].unionAll(parts[1]).unionAll(parts[2]).unionAll(parts[3])


@query(
    "c7_first_of_backlog",
    "SELECT stage, file_id FROM (SELECT 'analysis' AS stage, file_id, row_number() OVER (ORDER BY created_at, file_id) AS rn FROM files WHERE index_state = 'indexed' AND analysis_state NOT IN ('analysed', 'described') AND attempts < 3"
    " UNION ALL SELECT 'faces', file_id, row_number() OVER (ORDER BY created_at DESC, file_id) FROM files WHERE index_state = 'indexed' AND kind IN ('photo', 'screenshot', 'video') AND faces_state <> 'scanned') WHERE rn <= 25",
)
def c7b(c):
    """The next 25 of two stages."""
    analysis, faces = (C.work_backlog(c.files, s, limit=25).select(F.lit(s).alias("stage"), "file_id") for s in ("analysis", "faces"))
    return analysis.unionAll(faces)


_KINDS = "kind IN ('photo', 'screenshot', 'design', 'document', 'video')"


@query(
    "c8_requeue",
    f", a AS (SELECT *, CASE index_state WHEN 'failed' THEN 'pending' ELSE index_state END AS i2, CASE analysis_state WHEN 'failed' THEN 'none' ELSE analysis_state END AS s2,"
    f" CASE analysis_state WHEN 'failed' THEN 0 ELSE attempts END AS t2 FROM files) SELECT file_id, i2 AS index_state,"
    f" CASE WHEN s2 = 'analysed' AND i2 = 'indexed' AND {_KINDS} AND engine IS NULL THEN 'none' ELSE s2 END AS analysis_state, t2 AS attempts FROM a",
)
def c8(c):
    out = c.files
    for reason in ("clear_failures", "retry_failed", "undescribed"):
        out = C.requeue(out, reason)
    return out.select("file_id", "index_state", "analysis_state", F.col("attempts").cast("long").alias("attempts"))


@query(
    "c8_models_arrived",
    f", a AS (SELECT *, index_state = 'indexed' AND {_KINDS} AND ((analysis_state IN ('analysed', 'described') AND file_id % 3 = 0) OR file_id % 5 = 0) AS again FROM files)"
    " SELECT file_id, CASE WHEN again THEN 'none' ELSE analysis_state END AS analysis_state, CASE WHEN again THEN 0 ELSE attempts END AS attempts FROM a",
)
def c8b(c):
    i = F.col("file_id")
    labels = F.when(i % 3 != 0, F.array("label")).otherwise(F.array().cast("array<string>"))
    rows = c.files.withColumns({"labels": labels, "embedding_state": F.when(i % 5 != 0, "indexed")})
    out = C.requeue(rows, "models_arrived")
    return out.select("file_id", "analysis_state", F.col("attempts").cast("long").alias("attempts"))


@query(
    "c9_analysis_progress",
    "SELECT count(*) FILTER (index_state = 'indexed' AND (analysis_state IN ('analysed', 'described') OR attempts >= 3)) AS done,"
    " count(*) FILTER (index_state = 'indexed') AS total FROM files",
)
def c9(c):
    return C.analysis_progress(c.files)


@query(
    "c10_apply_probe",
    "SELECT file_id, CASE WHEN file_id % 4 = 0 THEN file_id * 2 ELSE width END AS width,"
    " CASE WHEN file_id % 4 = 0 AND file_id % 8 <> 0 THEN 5 ELSE height END AS height FROM files",
)
def c10(c):
    i = F.col("file_id")
    probes = c.files.where("file_id % 4 = 0").select("file_id", (i * 2).alias("width"), F.when(i % 8 != 0, F.lit(5).cast("long")).alias("height"))
    return C.apply_probe(c.files, probes, ["width", "height"]).select("file_id", "width", "height")


@query("c11_fold_edits", "SELECT key, field, arg_max(seq, (ts, seq)) AS seq FROM edits GROUP BY key, field")
def c11(c):
    return C.fold_edits(c.edits.withColumn("value", F.col("seq"))).withColumnRenamed("value", "seq")


@query("c12_remove_folder", "SELECT file_id, tag FROM file_tags WHERE file_id NOT IN (SELECT file_id FROM files WHERE folder_id = 'src1')")
def c12(c):
    gone = c.files.where("folder_id = 'src1'")
    return C.remove_keys({"tags": c.file_tags}, gone, "file_id")["tags"].select("file_id", "tag")


@query("c12_delete_project", "SELECT file_id, CASE WHEN project_id <> 'p1' THEN project_id END AS project_id FROM files")
def c12b(c):
    return C.clear_project(c.files, c.spark.createDataFrame([("p1",)], "project_id string")).select("file_id", "project_id")


@query(
    "c13_ensure_dimension",
    "SELECT min(trim(regexp_replace(trim(n), '^#+', ''))) AS name FROM (SELECT '# ' || event_type || ' ' AS n FROM events"
    " UNION ALL SELECT upper(event_type) FROM events UNION ALL SELECT tag FROM file_tags) WHERE lower(trim(regexp_replace(trim(n), '^#+', '')))"
    " NOT IN (SELECT DISTINCT lower(tag) FROM file_tags) GROUP BY lower(trim(regexp_replace(trim(n), '^#+', '')))",
)
def c13(c):
    e = c.table("events")
    names = e.select(F.concat(F.lit("# "), "event_type", F.lit(" ")).alias("name")).unionAll(e.select(F.upper("event_type")))
    names = names.unionAll(c.file_tags.select("tag"))
    return C.ensure_dimension(names, c.file_tags.select(F.col("tag").alias("name")).distinct()).select("name")


_WANTED = (
    "SELECT a.c_custkey + 10 AS id, CASE a.c_custkey % 4 WHEN 0 THEN ' ' WHEN 1 THEN b.c_name"
    " WHEN 2 THEN ' ' || a.c_name || ' (old)' ELSE 'group ' || CAST(floor(a.c_custkey / 8) AS INT) END AS name"
    " FROM customer a LEFT JOIN customer b ON b.c_custkey = a.c_custkey + 1"
)


@query(
    "c13_rename_dimension",
    f", r AS (SELECT id, trim(coalesce(name, '')) AS wanted FROM ({_WANTED})),"
    " o AS (SELECT r.id, wanted, e.c_name AS old, CASE WHEN wanted = '' THEN 'empty' WHEN EXISTS (SELECT 1 FROM customer h WHERE h.c_name = wanted"
    " AND h.c_custkey <> r.id) THEN 'taken' WHEN e.c_name IS NULL THEN 'absent' ELSE 'renamed' END AS o FROM r LEFT JOIN customer e ON e.c_custkey = r.id),"
    " n AS (SELECT *, CASE WHEN o = 'renamed' AND id > min(CASE WHEN o = 'renamed' THEN id END) OVER (PARTITION BY wanted) THEN 'taken' ELSE o END AS outcome FROM o)"
    " SELECT id, CASE WHEN outcome = 'renamed' THEN wanted ELSE old END AS name, outcome FROM n",
)
def c13_rename(c):
    """Customers renamed: to nothing, to a name in use, to a free one, and two of them to one."""
    customers = c.table("customer")
    a, b = customers.alias("a"), customers.select(F.col("c_custkey").alias("k"), F.col("c_name").alias("next")).alias("b")
    key = F.col("a.c_custkey")
    wanted = (
        F.when(key % 4 == 0, F.lit(" "))
        .when(key % 4 == 1, F.col("next"))
        .when(key % 4 == 2, F.concat(F.lit(" "), "a.c_name", F.lit(" (old)")))
        .otherwise(F.concat(F.lit("group "), F.floor(key / 8).cast("int").cast("string")))
    )
    renames = a.join(b, F.col("k") == key + 1, "left").select((key + 10).alias("id"), wanted.alias("name"))
    return C.rename_dimension(customers.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")), renames)


@query(
    "c14_save_text",
    "SELECT file_id, CASE WHEN file_id % 3 <> 0 OR file_id % 7 = 0 THEN ocr_state WHEN file_id % 2 = 0 THEN 'unavailable' WHEN file_id % 5 = 0 THEN 'none' ELSE 'extracted' END AS ocr_state,"
    " length(CASE WHEN file_id % 3 = 0 AND file_id % 7 <> 0 AND file_id % 2 <> 0 AND file_id % 5 <> 0 THEN 'new' ELSE ocr_text END) AS n FROM files",
)
def c14(c):
    i = F.col("file_id")
    new = c.files.where("file_id % 3 = 0").select("file_id", F.when(i % 5 == 0, " ").otherwise("new").alias("text"), F.when(i % 7 != 0, i % 2 != 0).alias("available"))
    return C.save_text(c.files, new).select("file_id", "ocr_state", F.length("ocr_text").cast("long").alias("n"))


@query(
    "c14_save_generated",
    "SELECT file_id, CASE WHEN file_id % 6 = 0 THEN 'T' || file_id ELSE title END AS title,"
    " attempts + CASE WHEN file_id % 3 = 0 AND file_id % 6 <> 0 THEN 1 ELSE 0 END AS attempts,"
    " CASE WHEN file_id % 6 = 0 THEN 'described' WHEN file_id % 3 = 0 THEN 'failed' ELSE analysis_state END AS analysis_state, CASE WHEN file_id % 6 = 0 THEN 'e' ELSE engine END AS engine FROM files",
)
def c14b(c):
    t = F.when(F.col("file_id") % 6 == 0, F.concat(F.lit("T"), F.col("file_id").cast("string")))
    new = c.files.where("file_id % 3 = 0").select("file_id", t.alias("title"), F.lit("d").alias("description"), F.lit("e").alias("engine"))
    return C.save_generated(c.files, new).select("file_id", "title", F.col("attempts").cast("long").alias("attempts"), "analysis_state", "engine")


@query(
    "c14_save_machine_tags",
    "SELECT file_id, tag, source FROM file_tags WHERE source = 'user' OR NOT (file_id % 6 = 0) UNION ALL SELECT file_id, 'fresh', 'vision' FROM files WHERE file_id % 6 = 0 AND file_id % 4 = 0",
)
def c14c(c):
    """Of every third file asked about, every second has an answer, with one tag, none, or one that the user has already."""
    i = F.col("file_id")
    tag = lambda t: F.array(F.struct(F.lit(t).alias("tag"), F.lit("vision").alias("source")))
    tags = F.when(i % 4 == 0, tag("fresh")).otherwise(F.slice(tag("fresh"), 1, 0))
    return C.save_machine_tags(c.file_tags, c.files.where("file_id % 3 = 0").select("file_id", F.when(i % 6 == 0, "t").alias("title"), tags.alias("tags")))


def _edits(c):
    """An edit log from the events: event n edits file n % 211."""
    kinds = ["favorite", "project", "name", "folder", "trash", "tag+", "tag-", "collection+", "collection-"]
    e = F.col("event_id")
    field = F.element_at(F.array(*map(F.lit, kinds)), (F.pmod(F.floor(e / 7), F.lit(9)) + 1).cast("int"))
    n = (F.floor(e / 63) % 3).cast("string")
    value = (
        F.when(field.isin("favorite", "trash"), F.when(e % 2 == 0, "true").otherwise("False"))
        .when(field == "project", F.when(n != "0", F.concat(F.lit("p"), n)))
        .when(field == "name", F.concat(F.lit("New "), n, F.lit(".PNG")))
        .when(field == "folder", F.concat(F.lit("/f/"), n))
        .otherwise(F.when(e % 3 == 0, "quality").when(e % 3 == 1, "col-a").otherwise(n))
    )
    return c.table("events").select((e % 211).alias("file_id"), "ts", e.alias("seq"), field.alias("field"), value.alias("value"))


_EDITS = """, ed AS (
  SELECT event_id % 211 AS file_id, ts, event_id AS seq, ['favorite','project','name','folder','trash','tag+','tag-','collection+','collection-'][(event_id // 7) % 9 + 1] AS field, CAST((event_id // 63) % 3 AS VARCHAR) AS n FROM events
), e AS (
  SELECT file_id, ts, seq, field, CASE WHEN field IN ('favorite', 'trash') THEN CASE WHEN seq % 2 = 0 THEN 'true' ELSE 'False' END WHEN field = 'project' THEN CASE WHEN n <> '0' THEN 'p' || n END
    WHEN field = 'name' THEN 'New ' || n || '.PNG' WHEN field = 'folder' THEN '/f/' || n WHEN seq % 3 = 0 THEN 'quality' WHEN seq % 3 = 1 THEN 'col-a' ELSE n END AS value FROM ed SEMI JOIN files USING (file_id)
), last AS (SELECT *, row_number() OVER (PARTITION BY file_id, field ORDER BY ts DESC, seq DESC) AS rn FROM e),
member AS (SELECT *, row_number() OVER (PARTITION BY file_id, field[:-2], value ORDER BY ts DESC, seq DESC) AS rn FROM e WHERE field[-1:] IN ('+', '-'))
"""


@query(
    "c11_apply_files",
    _EDITS + ", w AS (SELECT file_id, max(value) FILTER (field = 'favorite') AS fav, max(value) FILTER (field = 'project') AS pro, count(*) FILTER (field = 'project') AS asked, max(value) FILTER (field = 'name') AS nam,"
    " max(value) FILTER (field = 'folder') AS fol, max(value) FILTER (field = 'trash') AS tra FROM last WHERE rn = 1 GROUP BY 1) SELECT file_id, CASE WHEN fav IS NOT NULL THEN fav = 'true' ELSE favorite END AS favorite,"
    " CASE WHEN asked > 0 THEN pro ELSE project_id END AS project_id, coalesce(fol, folder_path) || '/' || coalesce(nam, name) AS path, CASE WHEN nam IS NOT NULL THEN 'png' ELSE ext END AS ext,"
    " CASE WHEN tra = 'true' THEN 'missing' WHEN tra = 'False' AND index_state = 'missing' THEN 'pending' ELSE index_state END AS index_state FROM files LEFT JOIN w USING (file_id)",
)
def c11b(c):
    return C.apply_edits(c.files, c.file_tags, c.file_collections, _edits(c))["files"].select("file_id", "favorite", "project_id", "path", "ext", "index_state")


@query("c11_apply_tags", _EDITS + "SELECT file_id, tag, source FROM file_tags t WHERE NOT EXISTS (SELECT 1 FROM member m WHERE m.file_id = t.file_id AND m.value = t.tag AND field LIKE 'tag%') UNION ALL SELECT file_id, value, 'user' FROM member WHERE rn = 1 AND field = 'tag+'")
def c11c(c):
    return C.apply_edits(c.files, c.file_tags, c.file_collections, _edits(c))["file_tags"]


@query("c11_apply_collections", _EDITS + "SELECT collection_id, file_id FROM file_collections t WHERE NOT EXISTS (SELECT 1 FROM member m WHERE m.file_id = t.file_id AND m.value = t.collection_id AND field LIKE 'coll%') UNION ALL SELECT value, file_id FROM member WHERE rn = 1 AND field = 'collection+'")
def c11d(c):
    return C.apply_edits(c.files, c.file_tags, c.file_collections, _edits(c))["file_collections"]


@query("s6_activity_feed", "SELECT event_id, user_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 500")
def s6(c):
    return C.activity_feed(c.table("events"), 9999).select("event_id", "user_id")


@query(
    "f1_filter_files",
    f"SELECT file_id FROM files WHERE {HERE} AND kind IN ('photo', 'document') AND folder_id = 'src0' AND created_at >= {T0} - INTERVAL 55 DAY"
    " AND file_id IN (SELECT file_id FROM file_tags WHERE tag = 'en')",
)
def f1(c):
    return L.filter_files(c.files, ["photo", "document"], "src0", since_days=55, now=c.now, tagged=c.file_tags.where("tag = 'en'")).select("file_id")


@query("f1_filter_day", f"SELECT file_id FROM files WHERE {HERE} AND created_at >= TIMESTAMP '2024-01-05' AND created_at < TIMESTAMP '2024-01-06'")
def f1b(c):
    return L.filter_files(c.files, day="2024-01-05").select("file_id")


@query("f1_filter_person", f"SELECT file_id FROM files WHERE {HERE} AND favorite AND file_id IN (SELECT file_id FROM faces WHERE person_id = 2)")
def f1c(c):
    return L.filter_files(c.files, favorites=True, shown=c.faces.where("person_id = 2")).select("file_id")


_ORDERS = {"recent": "created_at DESC", "oldest": "created_at", "name": "lower(name)", "size": "bytes DESC", "kind": "kind, created_at DESC"}


@query("f2_sort_files", "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{k}' AS sort, file_id, row_number() OVER (ORDER BY {o}, file_id) AS place FROM files" for k, o in _ORDERS.items()) + ") WHERE place <= 50")
def f2(c):
    from pyspark.sql import Window

    parts = []
    for k in _ORDERS:
        top = L.sort_files(c.files, k).limit(50)
        parts.append(top.select(F.lit(k).alias("sort"), "file_id", F.row_number().over(Window.orderBy(*L.sort_keys(k))).cast("long").alias("place")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


@query(
    "f3_page",
    "SELECT file_id, (SELECT count(*) FROM files) AS total, (SELECT count(*) FROM files) > 150 AS has_more"
    " FROM files ORDER BY created_at DESC, file_id LIMIT 120 OFFSET 30",
)
def f3(c):
    return L.page(c.files, "recent", 120, 30).select("file_id", "total", "has_more")


@query("f4_files_by_ids", "SELECT file_id, name FROM files WHERE file_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def f4(c):
    return L.files_by_ids(c.files, c.table("labels").where("toxic = 1").select(F.col("doc_id").alias("file_id"))).select("file_id", "name")


@query(
    "f5_hydrate",
    "SELECT file_id, coalesce((SELECT string_agg(DISTINCT tag, ',' ORDER BY tag) FROM file_tags t WHERE t.file_id = f.file_id), '') AS tags,"
    " coalesce((SELECT string_agg(DISTINCT tag, ',' ORDER BY tag) FROM file_tags t WHERE t.file_id = f.file_id AND source <> 'user'), '') AS machine_tags,"
    " coalesce((SELECT string_agg(collection_id, ',' ORDER BY collection_id) FROM file_collections t WHERE t.file_id = f.file_id), '') AS collections FROM files f",
)
def f5(c):
    h = L.hydrate(c.files, c.file_tags, c.file_collections)
    return h.select("file_id", *[F.array_join(k, ",").alias(k) for k in ("tags", "machine_tags", "collections")])


RULES = [
    ("Screenshots", ["screenshot"], [], None, False), ("Documents", ["document"], [], None, False), ("Videos", ["video"], [], None, False),
    ("Languages", [], ["de", "fr"], None, False), ("Kept", [], ["quality"], None, True), ("Late", ["photo", "design"], [], 50, False),
    ("Everything", [], [], None, False),
]


def _rules(c):
    return c.spark.createDataFrame(RULES, "rule_id string, kinds array<string>, tags array<string>, days int, favorites_only boolean")


_RULE_SQL = {
    "Screenshots": "kind = 'screenshot'", "Documents": "kind = 'document'", "Videos": "kind = 'video'",
    "Languages": "file_id IN (SELECT file_id FROM file_tags WHERE tag IN ('de', 'fr'))",
    "Kept": "file_id IN (SELECT file_id FROM file_tags WHERE tag = 'quality') AND favorite",
    "Late": f"kind IN ('photo', 'design') AND created_at >= {T0} - INTERVAL 50 DAY", "Everything": "true",
}
_MEMBERS = " UNION ALL ".join(f"SELECT '{r}' AS rule_id, file_id FROM files WHERE {HERE} AND {w}" for r, w in _RULE_SQL.items())


@query("f6_resolve_rules", _MEMBERS)
def f6(c):
    return L.resolve_rules(c.files, c.file_tags, _rules(c), c.now)


_BUILT = ", ".join([f"('{n}', ['{k}'], [])" for n, k in L.BUILT_IN_KINDS.items()] + [f"('{n}', [], {t.split()})" for n, t in L.BUILT_IN_TAGS.items()])


@query(
    "f7_builtin_collections",
    f", r(name, kinds, tags) AS (VALUES {_BUILT}) SELECT name, (SELECT count(*) FROM files f WHERE {HERE} AND (list_contains(kinds, kind)"
    " OR EXISTS (SELECT 1 FROM file_tags t WHERE t.file_id = f.file_id AND list_contains(tags, t.tag)))) AS files"
    " FROM r WHERE lower(name) NOT IN (SELECT lower(kind) || 's' FROM files WHERE kind <> 'screenshot')",
)
def f7(c):
    have = c.files.where("kind <> 'screenshot'").select(F.upper(F.concat("kind", F.lit("s"))).alias("name"))
    rules = L.builtin_collections(have)
    held = L.resolve_rules(c.files, c.file_tags, rules, c.now).groupBy("rule_id").agg(F.count(F.lit(1)).alias("files"))
    return rules.join(held, "rule_id", "left").select(F.col("rule_id").alias("name"), F.coalesce("files", F.lit(0)).cast("long").alias("files"))


@query(
    "f8_hero_candidates",
    f"SELECT file_id FROM (SELECT *, min(tier) OVER () AS best FROM (SELECT *, CASE WHEN kind = 'photo' AND width >= 1200 AND height >= 800"
    f" AND width / height BETWEEN 1.15 AND 2.4 THEN 1 WHEN kind = 'photo' AND width IS NOT NULL THEN 2 WHEN kind IN ('design', 'video') THEN 3 END AS tier"
    f" FROM files WHERE {HERE})) WHERE tier = best ORDER BY CASE tier WHEN 1 THEN abs(width / height - 1.6) WHEN 2 THEN -width * height"
    " ELSE -epoch(created_at) END, file_id LIMIT 8",
)
def f8(c):
    return L.hero_candidates(c.files).select("file_id")


@query("f9_recent", "SELECT file_id FROM files ORDER BY created_at DESC, file_id LIMIT 60")
def f9(c):
    return L.sort_files(c.files).limit(60).select("file_id")


@query(
    "f10_numeric_bounds",
    "SELECT file_id FROM files WHERE coalesce(bytes, 0) >= 2 * 1024 * 1024 UNION ALL SELECT file_id FROM files WHERE coalesce(width, 0) <= 900"
    " UNION ALL SELECT file_id FROM files WHERE coalesce(height, 0) >= 1000 AND coalesce(height, 0) <= 1020",
)
def f10(c):
    crit = c.spark.createDataFrame([("bytes", ">", 2.0, "mb"), ("width", "<", 900.0, ""), ("height", "=", 1000.0, "")], "field string, op string, x double, unit string")
    low, high = L.numeric_bounds(F.col("op"), F.col("x"), F.col("unit"))
    crit = crit.select("field", low.alias("low"), high.alias("high"))
    long = c.files.select("file_id", F.expr("stack(3, 'bytes', bytes, 'width', width, 'height', height) as (field, v)"))
    v = F.coalesce("v", F.lit(0))
    fits = (F.col("low").isNull() | (v >= F.col("low"))) & (F.col("high").isNull() | (v <= F.col("high")))
    return long.join(F.broadcast(crit), "field").where(fits).select("file_id")


@query(
    "f11_date_bounds",
    f"SELECT 1 AS q, file_id FROM files WHERE created_at >= {T0} - INTERVAL 56 DAY UNION ALL SELECT 2, file_id FROM files WHERE created_at >= TIMESTAMP '2024-01-03'"
    " UNION ALL SELECT 3, file_id FROM files WHERE created_at < TIMESTAMP '2024-02-01'",
)
def f11(c):
    crit = c.spark.createDataFrame([(1, "since", "8w"), (2, "after", "2024-01-03"), (3, "before", "2024-02")], "q int, field string, value string")
    low, high = L.date_bounds(F.col("field"), F.col("value"), c.now)
    crit = crit.select("q", low.alias("low"), high.alias("high"))
    t = F.col("created_at")
    fits = (F.col("low").isNull() | (t >= F.col("low"))) & (F.col("high").isNull() | (t < F.col("high")))
    return c.files.join(F.broadcast(crit), fits).select("q", "file_id")


@query("a1_totals", f"SELECT kind, count(*) AS files, count(*) FILTER (created_at >= {T0}) AS new_today FROM files WHERE {HERE} GROUP BY ROLLUP (kind)")
def a1(c):
    return L.totals(c.files, c.now)


@query(
    "a2_storage_stats",
    "SELECT coalesce(sum(bytes) FILTER (index_state NOT IN ('missing', 'failed')), 0)::BIGINT AS bytes, count(*) FILTER (index_state NOT IN ('missing', 'failed')) AS files,"
    " count(*) FILTER (index_state = 'pending') AS pending, count(*) FILTER (index_state = 'failed') AS failed FROM files",
)
def a2(c):
    return L.storage_stats(c.files)


@query("a2_storage_by_kind", f"SELECT kind, sum(bytes)::BIGINT AS bytes FROM files WHERE {HERE} GROUP BY kind")
def a2b(c):
    return L.storage_by_kind(c.files)


def _folders(c):
    """The folders of the files, when each was last scanned, and one without files."""
    own = c.files.groupBy("folder_id").agg(F.max("indexed_at").alias("last_scan_at"))
    return own.unionAll(own.limit(1).select(F.lit("empty"), F.lit(None).cast("timestamp")))


_FOLDERS = "(SELECT folder_id, max(indexed_at) AS last_scan_at FROM files GROUP BY 1 UNION ALL SELECT 'empty', NULL)"


@query("a3_folder_stats", f"SELECT d.folder_id, epoch(last_scan_at)::BIGINT AS last_scan_at, count(file_id) AS files, coalesce(sum(bytes), 0)::BIGINT AS bytes, (SELECT epoch(max(indexed_at))::BIGINT FROM files) AS newest_scan FROM {_FOLDERS} d LEFT JOIN files f ON f.folder_id = d.folder_id GROUP BY ALL")
def a3(c):
    return L.folder_stats(_folders(c), c.files).select("folder_id", sec("last_scan_at"), "files", "bytes", sec("newest_scan"))


@query("a4_tag_counts", "SELECT tag, count(DISTINCT file_id) AS files FROM (SELECT tag, file_id FROM file_tags UNION ALL SELECT 'flag ' || l_returnflag, NULL FROM lineitem) GROUP BY tag")
def a4(c):
    """The tags of the files, and some that no file has."""
    return L.tag_counts(c.file_tags, c.table("lineitem").select(F.concat(F.lit("flag "), "l_returnflag").alias("tag")))


@query("a5_top_tags", "SELECT tag, count(DISTINCT file_id) AS files FROM file_tags GROUP BY tag ORDER BY tag IN ('quality') DESC, files DESC, tag LIMIT 3")
def a5(c):
    return L.top_tags(L.tag_counts(c.file_tags), ["quality"], 3)


@query("a6_machine_tag_names", "SELECT DISTINCT tag FROM file_tags WHERE source <> 'user'")
def a6(c):
    return L.machine_tag_names(c.file_tags)


@query(
    "a7_collection_cards",
    f", m AS (SELECT * FROM file_collections UNION ALL {_MEMBERS}), r AS (SELECT m.*, f.bytes, row_number() OVER (PARTITION BY collection_id ORDER BY created_at DESC, file_id) AS rn"
    f" FROM m JOIN files f USING (file_id) WHERE {HERE}) SELECT collection_id, count(*) AS files, sum(bytes)::BIGINT AS bytes,"
    " string_agg(file_id::VARCHAR, ',' ORDER BY rn) FILTER (rn <= 4) AS newest FROM r GROUP BY collection_id",
)
def a7(c):
    smart = L.resolve_rules(c.files, c.file_tags, _rules(c), c.now).withColumnRenamed("rule_id", "collection_id")
    cards = L.collection_cards(c.file_collections.unionByName(smart), c.files)
    return cards.withColumn("newest", F.array_join(F.transform("newest", lambda x: x.cast("string")), ","))


@query("a8_project_counts", "SELECT project_id, count(*) AS files, sum(bytes)::BIGINT AS bytes FROM files WHERE project_id IS NOT NULL GROUP BY project_id")
def a8(c):
    return L.counted(c.files.select("project_id").where("project_id is not null").distinct(), "project_id", c.files)


@query("a9_group_by_day", f"SELECT strftime(created_at + INTERVAL 2 HOUR, '%Y-%m-%d') AS day, count(*) AS files, min(file_id) AS first_file FROM files WHERE {HERE} GROUP BY 1")
def a9(c):
    return L.group_by_day(c.files, "+02:00").withColumn("day", F.col("day").cast("string"))


@query("a9_files_by_day", f"SELECT file_id, strftime(created_at - INTERVAL 3 HOUR, '%Y-%m-%d') AS day, count(*) OVER (PARTITION BY strftime(created_at - INTERVAL 3 HOUR, '%Y-%m-%d')) AS files FROM files WHERE {HERE}")
def a9b(c):
    return L.files_by_day(c.files, "-03:00").select("file_id", F.col("day").cast("string").alias("day"), "files")


@query("a10_kind_tiles", "SELECT " + ", ".join(f"count(*) FILTER (kind = '{k}') AS {k}" for k in ("photo", "screenshot", "document", "video")) + f" FROM files WHERE {HERE}")
def a10(c):
    return L.kind_tiles(c.files)


@query("a11_queue_status", "SELECT count(*) FILTER (index_state = 'pending') AS pending, count(*) FILTER (index_state = 'processing') AS processing, count(*) FILTER (index_state = 'failed') AS failed FROM files")
def a11(c):
    return L.queue_status(c.files)


@query(
    "a11_queue_state",
    ", q AS (SELECT count(*) FILTER (index_state = 'pending') AS pending, count(*) FILTER (index_state = 'processing') AS processing, count(*) FILTER (index_state = 'failed') AS failed FROM files),"
    " d AS (SELECT count(*) AS done, epoch_us(max(ts)) - epoch_us(min(ts)) AS took FROM events WHERE event_type = 'purchase'), s(state, ord) AS (VALUES ('paused', 1), ('scanning', 2), ('', 3))"
    " SELECT CASE WHEN state <> '' THEN state WHEN pending + processing > 0 THEN 'indexing' ELSE 'idle' END AS state, pending, processing, failed, done, pending + processing + done AS total, round(done / (took / 1e6) * 60, 9) AS per_minute FROM q, d, s",
)
def a11c(c):
    """The queue paused, scanned and neither."""
    done = c.table("events").where("event_type = 'purchase'")
    rows = [L.queue_state(c.files, done, paused, scanning) for paused, scanning in ((True, True), (False, True), (False, False))]
    return rows[0].unionAll(rows[1]).unionAll(rows[2]).withColumn("per_minute", F.round("per_minute", 9))


@query("a11_throughput", "SELECT (floor(epoch(ts) / 3600) * 3600)::BIGINT AS start, count(*) AS done FROM events WHERE event_type = 'purchase' GROUP BY 1")
def a11b(c):
    done = L.throughput(c.table("events").where("event_type = 'purchase'"), "ts", "1 hour")
    return done.select(F.unix_timestamp(F.col("w.start")).alias("start"), "done")


@query(
    "a12_tag_quality_audit",
    ", s AS (SELECT f.file_id, coalesce(string_agg(tag, ',' ORDER BY tag), '') AS key, count(tag) AS n FROM files f LEFT JOIN file_tags t USING (file_id) GROUP BY 1),"
    " k AS (SELECT max(c) AS most_common, count(*) AS sets FROM (SELECT count(*) AS c FROM s GROUP BY key))"
    " SELECT count(*) AS files, round(avg((n = 0)::INT), 6) AS empty_share, round(avg(n), 6) AS mean_labels, any_value(most_common) AS most_common, any_value(sets) AS sets,"
    " (SELECT count(DISTINCT tag) FROM file_tags) AS unique_labels, round(any_value(sets) / count(*), 6) AS distinct_share,"
    " count(*) FILTER (n = 0) AS empty, count(*) FILTER (n > 0 AND key IN ('quality', 'en', 'en,quality')) AS generic_only, (SELECT key FROM (SELECT key, count(*) AS c FROM s GROUP BY key) ORDER BY c DESC, key LIMIT 1) AS most_common_set,"
    " (SELECT string_agg(tag || ':' || c, ',' ORDER BY c DESC, tag) FROM (SELECT tag, count(DISTINCT file_id) AS c FROM file_tags GROUP BY tag ORDER BY c DESC, tag LIMIT 10)) AS top_tags,"
    " round(avg(file_id % 97), 6) AS ms_mean, (list_sort(list(file_id % 97))[count(*) // 2 + 1])::BIGINT AS ms_median, max(file_id % 97)::BIGINT AS ms_max,"
    " any_value(most_common) > greatest(4, count(*) // 2) OR avg((n = 0)::INT) > 0.34 OR any_value(sets) / count(*) < 0.4 AS unhealthy FROM s, k",
)
def a12(c):
    labels = L.hydrate(c.files, c.file_tags, c.file_collections).select("file_id", F.col("tags").alias("labels"), (F.col("file_id") % 97).alias("ms"))
    out = L.tag_quality_audit(labels, ["quality", "en"])
    tops = F.array_join(F.transform("top_tags", lambda t: F.concat(t["tag"], F.lit(":"), t["files"].cast("string"))), ",")
    return out.withColumns({k: F.round(k, 6) for k in ("empty_share", "mean_labels", "distinct_share", "ms_mean")}).withColumn("top_tags", tops)


@query(
    "a13_archive_snapshot",
    f", here AS (SELECT * FROM files WHERE {HERE}) SELECT 'folders' AS part, d.folder_id AS key, count(file_id)::VARCHAR AS value FROM {_FOLDERS} d LEFT JOIN files f ON f.folder_id = d.folder_id GROUP BY ALL"
    f" UNION ALL SELECT 'totals', kind, count(*) || ' ' || count(*) FILTER (created_at >= date_trunc('day', {T0})) FROM here GROUP BY ROLLUP (kind)"
    " UNION ALL SELECT 'storage', 'bytes', sum(bytes) FILTER (index_state NOT IN ('missing', 'failed')) || '' FROM files UNION ALL SELECT 'kinds', kind, sum(bytes) || '' FROM here GROUP BY kind"
    " UNION ALL SELECT 'tags', tag, count(DISTINCT file_id) || '' FROM file_tags GROUP BY tag"
    " UNION ALL SELECT 'collections', collection_id, count(*) || ' ' || sum(bytes) FROM file_collections JOIN here USING (file_id) GROUP BY collection_id"
    " UNION ALL SELECT 'projects', p.project_id, count(file_id) || '' FROM (SELECT DISTINCT project_id FROM files WHERE project_id IS NOT NULL) p LEFT JOIN files f ON f.project_id = p.project_id GROUP BY 1, 2"
    " UNION ALL SELECT * FROM (SELECT 'activity', event_id || '', event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 30) UNION ALL SELECT * FROM (SELECT 'recent', file_id || '', name FROM here ORDER BY created_at DESC, file_id LIMIT 60)"
    " UNION ALL SELECT 'index', CASE WHEN count(*) FILTER (index_state IN ('pending', 'processing')) > 0 THEN 'indexing' ELSE 'idle' END, count(*) FILTER (index_state = 'failed') || '' FROM files",
)
def a13(c):
    """All ten parts as one long table."""
    projects = c.files.where("project_id is not null").select("project_id").distinct()
    events = c.table("events")
    parts = L.archive_snapshot(c.files, _folders(c), c.file_tags, c.file_collections, projects, events, events, c.now)
    text = lambda x: F.col(x).cast("string")
    both = lambda a, b: F.concat_ws(" ", text(a), text(b))
    shown = {
        "folders": ("folder_id", text("files")), "totals": ("kind", both("files", "new_today")), "kinds": ("kind", text("bytes")),
        "tags": ("tag", text("files")), "collections": ("collection_id", both("files", "bytes")), "projects": ("project_id", text("files")),
        "activity": ("event_id", text("event_type")), "recent": ("file_id", text("name")), "index": ("state", text("failed")),
    }
    out = parts["storage"].select(F.lit("storage").alias("part"), F.lit("bytes").alias("key"), text("bytes").alias("value"))
    for name, (key, value) in shown.items():
        out = out.unionAll(parts[name].select(F.lit(name), text(key), value))
    return out


@query("a14_selection_stats", "SELECT kind, count(*) AS files, sum(bytes)::BIGINT AS bytes FROM files WHERE file_id IN (SELECT file_id FROM file_collections) GROUP BY kind")
def a14(c):
    return L.selection_stats(c.files, c.file_collections)


@query(
    "a16_suggest_tags",
    ", top AS (SELECT tag, count(DISTINCT file_id) AS n FROM file_tags GROUP BY tag ORDER BY n DESC, tag LIMIT 14), r AS ("
    "SELECT file_id, tag, row_number() OVER (PARTITION BY file_id ORDER BY n DESC, tag) AS rn FROM files, top WHERE (file_id, tag) NOT IN (SELECT file_id, tag FROM file_tags))"
    " SELECT file_id, tag, rn FROM r WHERE rn <= 4",
)
def a16(c):
    return L.suggest_tags(c.files, c.file_tags).withColumn("rn", F.col("rn").cast("long"))


@query(
    "h1_capture_changes",
    _SCAN + "SELECT f.file_id, epoch(modified_at)::BIGINT AS content_at, f.bytes + 1 AS bytes FROM files f JOIN diff USING (file_id)"
    " WHERE change <> 'missing' AND f.file_id % 8 = 0 AND f.file_id % 3 <> 0",
)
def h1(c):
    """Captured after a scan, and again once the markers are cleared, which adds nothing."""
    scanned = C.apply_scan(c.files, _scan(c), _observed(c), c.now)
    shown = c.files.where("file_id % 3 <> 0")
    both = C.capture_changes(scanned, shown).unionAll(C.capture_changes(C.clear_captured(scanned), shown))
    return both.select("file_id", sec("content_at"), "bytes")


@query("h2_capture_manual", "SELECT file_id, epoch(modified_at)::BIGINT AS content_at, 'manual' AS source FROM files WHERE file_id IN (SELECT file_id FROM file_collections)")
def h2(c):
    return C.capture_manual(c.files, c.file_collections.select("file_id")).select("file_id", sec("content_at"), "source")


@query(
    "h3_prune_versions",
    "SELECT key, seq FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts DESC, seq DESC) AS rn FROM edits) WHERE rn <= 12",
)
def h3(c):
    v = c.edits.select(F.col("key").alias("file_id"), F.col("seq").alias("version_id"), F.col("ts").alias("content_at"))
    return C.prune_versions(v).select(F.col("file_id").alias("key"), F.col("version_id").alias("seq"))


@query("h3_drop_orphans", "SELECT DISTINCT path FROM observations WHERE path IN (SELECT '/f/' || file_id || '.png' FROM files)")
def h3b(c):
    stored = c.files.select(F.concat(F.lit("/f/"), F.col("file_id").cast("string"), F.lit(".png")).alias("path"))
    return C.drop_orphans(c.observations, stored).select("path").distinct()
