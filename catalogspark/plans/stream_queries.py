"""Queries of streams and description search."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dictionaries as D
from ..operators import describe as DS
from ..operators import pixels as PX
from ..operators import search as S
from ..shared import new_path
from ..sources.adapters import Catalog, oracle
from ..sources.files import observe_stream
from ..streaming import streams as W
from .search_queries import _ASKED, _DOCS, _SYN, STEM, _asked, _docs, _in, _pixels, _search_index, toks

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, body: str | None = None):
    def register(build):
        QUERIES[name] = lambda spark, sf_dir: build(Catalog(spark, sf_dir))
        if body is not None:
            SQL[name] = oracle(body)
        return build

    return register


def _stream(c):
    """The events table as a stream of observations."""
    s = observe_stream(c.spark, f"{c.dir}/[e]vents.parquet")
    return s.select(
        "event_id", "ts", F.concat(F.lit("folder"), (F.col("user_id") % 7).cast("string")).alias("folder"),
        F.concat(F.lit("/f/"), F.col("user_id").cast("string"), F.lit(".png")).alias("path"),
        F.when(F.col("event_type") == "error", "removed").otherwise("seen").alias("op"), (F.col("event_id") % 97 * 1000).alias("bytes"),
    )


#: A file of a batch holds so many rows at least, where a batch has several.
FILE_ROWS = 100_000


def _batches(rows, parts, file_rows=FILE_ROWS):
    """A folder with files for each of `parts` (conditions), written one after the other, as a stream of one part a batch.

    Every part but the last has equally many files, dealt by a hash of the rows, so that no task writes a whole part of many rows.
    """
    spark, path = rows.sparkSession, new_path(rows.sparkSession, "batches")
    sizes = list(rows.agg(*[F.count_if(p) for p in parts]).first())
    n = max(1, min(sizes[:-1] or sizes) // file_rows)
    for part in parts:
        dealt = rows.where(part).withColumn("__file", F.pmod(F.xxhash64(*rows.columns), F.lit(n))).repartition(n, "__file")
        dealt.write.mode("append").partitionBy("__file").parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", n).option("recursiveFileLookup", "true").parquet(path)


@query(
    "w1_touched_folders",
    ", g AS (SELECT folder, ts, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w < 1200000 THEN 0 ELSE 1 END AS new FROM observations WINDOW w AS (PARTITION BY folder ORDER BY ts)),"
    " s AS (SELECT *, sum(new) OVER (PARTITION BY folder ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT folder, epoch_us(min(ts))::BIGINT AS start, count(*) AS events FROM s GROUP BY folder, k",
)
def w1(c):
    """The bursts of the observations as a stream: four files in order of time, and an observation far ahead that closes the last ones."""
    rows = c.observations.select("folder", F.col("ts").cast("timestamp").alias("ts"), "event_id")
    q = rows.agg(F.percentile_approx(F.unix_micros("ts"), [0.25, 0.5, 0.75]).alias("q"), F.max("ts").alias("end")).first()
    at = F.unix_micros("ts")
    cuts = [None, *(q["q"] or []), None]
    parts = [(F.lit(True) if a is None else at >= a) & (F.lit(True) if b is None else at < b) for a, b in zip(cuts, cuts[1:])]
    ahead = rows.limit(1).select(F.lit("").alias("folder"), F.lit(q["end"]).cast("timestamp") + F.expr("interval 1 day"), F.lit(-1).cast("long")).toDF(*rows.columns)
    closed = F.col("folder") == ""
    bursts = W.touched_folders(_batches(rows.unionByName(ahead), [p & ~closed for p in parts] + [closed]))
    return W.run_available(bursts, "bursts").select("folder", F.unix_micros("start").alias("start"), "events")


@query("w2_stream_upsert", "SELECT path, arg_max(bytes, (ts, event_id))::BIGINT AS bytes, CASE WHEN arg_max(op, (ts, event_id)) = 'removed' THEN 'missing' ELSE 'pending' END AS state FROM observations GROUP BY path")
def w2(c):
    sink = W.UpsertSink(c.spark)
    return W.stream_upsert(_stream(c), sink).select("path", "bytes", "state")


@query("w3_dedup_observations", "SELECT DISTINCT path, op FROM observations")
def w3(c):
    s = W.dedup_observations(_stream(c).withColumn("fingerprint", F.col("op")), "3650 days")
    return W.run_available(s, "dedup").select("path", "op")


@query("w4_stream_throughput", "SELECT (floor(epoch(ts) / 3600) * 3600)::BIGINT AS start, count(*) AS done FROM observations GROUP BY 1")
def w4(c):
    changes = W.run_available(W.stream_throughput(_stream(c), "1 hour", late="3650 days"), "throughput", "update")
    return W.latest_per_key(changes, ["start"]).select(F.unix_timestamp("start").alias("start"), "done")


@query("w4_sliding_throughput", ", e AS (SELECT floor(epoch(ts) / 1800) * 1800 AS h FROM observations), w AS (SELECT h AS start FROM e UNION ALL SELECT h - 1800 FROM e) SELECT start::BIGINT AS start, count(*) AS done FROM w GROUP BY 1")
def w4b(c):
    return W.stream_throughput(c.observations, "1 hour", "30 minutes").select(F.unix_timestamp("start").alias("start"), "done")


@query("w5_stream_assign_faces")
def w5(c):
    """The faces as a stream of three batches by a hash of the id."""
    faces = c.faces.select("face_id", "quality", "embedding")
    part = F.pmod(F.xxhash64("face_id"), F.lit(3))
    sink = W.FaceAssigner(c.spark)
    W.run_sink(_batches(faces, [part == k for k in range(3)]), sink)
    return sink.table.select("face_id", "person_id")


@query(
    "w6_late_observations",
    ", b AS (SELECT event_id, ts, (event_id * 7919) % 5 AS batch_id FROM events), m AS (SELECT batch_id, max(max(ts)) OVER (ORDER BY batch_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mark FROM b GROUP BY 1)"
    " SELECT event_id, coalesce(ts < mark - INTERVAL 1 HOUR, false) AS is_late FROM b JOIN m USING (batch_id)",
)
def w6(c):
    """The observations as a stream of five batches; each batch's late rows go to a table of their own."""
    sink = W.LateRouter(c.spark, "1 hour")
    part = (F.col("event_id") * 7919) % 5
    W.run_sink(_batches(c.observations, [part == k for k in range(5)]), sink)
    of = lambda name, late: sink.table(name).select("event_id", F.lit(late).alias("is_late"))
    return of("late", True).unionAll(of("on_time", False))


@query("s7_observe_stream", "SELECT count(*) AS n, count(DISTINCT event_id) AS events FROM events")
def s7(c):
    return W.run_available(_stream(c).select("event_id"), "observed").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("event_id").alias("events"))


# Description search


def _described(c):
    raw = F.concat(F.col("raw"), F.when(F.col("query_id").cast("long") % 3 == 0, " -kind:photo OR kind:video").when(F.col("query_id").cast("long") % 3 == 1, " the of").otherwise(""))
    return _asked(c).select("query_id", raw.alias("raw"))


def _sentences(c):
    """The described queries of the benchmark, in sentences: with a kind, a soft kind and a date, an exclusion, and all filler."""
    i = F.col("query_id").cast("long") % 5
    tail = F.when(i == 0, " in the videos or clips").when(i == 1, " photos from last week please").when(i == 2, " -dark -screenshot -in:Old").when(i == 3, " OR pictures")
    return _asked(c).select("query_id", F.when(i == 4, "the pictures of me").otherwise(F.concat("raw", tail)).alias("raw"))


@query(
    "d1_interpret_descriptions",
    f", a AS (SELECT item_id, item_id % 5 AS k, list_transform(list_sort(list_transform(list_distinct({toks('text')}), lambda w: {{'n': -length(w), 'w': w}}))[1:3], lambda x: x.w) AS w FROM benchmark)"
    ", b AS (SELECT item_id, k, array_to_string(w, ' ') AS w FROM a) SELECT item_id::VARCHAR AS query_id, 0 AS grp, CASE WHEN k = 4 THEN 'the of me' ELSE w END AS words,"
    " CASE k WHEN 0 THEN 'kind=video' WHEN 1 THEN 'since=7d' WHEN 2 THEN '-kind=screenshot' WHEN 4 THEN 'kind=photo' ELSE '' END AS clauses, CASE WHEN k = 2 THEN 'dark old' ELSE '' END AS excluded FROM b"
    " UNION ALL SELECT item_id::VARCHAR, 1, '', 'kind=video', '' FROM b WHERE k = 0",
)
def d1(c):
    g = DS.interpret_descriptions(_sentences(c))
    said = F.transform("clauses", lambda x: F.concat(F.when(x["negated"], "-").otherwise(""), x["field"], F.lit("="), x["value"]))
    return g.select("query_id", "grp", F.array_join("words", " ").alias("words"), F.array_join(said, " ").alias("clauses"), F.array_join("excluded", " ").alias("excluded"))


@query(
    "d2_hard_clauses",
    "SELECT 'a' AS query_id, file_id FROM files WHERE kind <> 'photo' AND file_id IN (SELECT file_id FROM file_tags WHERE tag LIKE 'qual%') AND lower(name) LIKE '%img%'"
    " UNION ALL SELECT 'b', file_id FROM files WHERE bytes >= 2097152 AND coalesce(width, 0) <= 900 AND created_at < TIMESTAMP '2024-02-01'"
    " UNION ALL SELECT 'c', file_id FROM files WHERE created_at >= TIMESTAMP '2024-03-01' - INTERVAL 56 DAY AND file_id IN (SELECT file_id FROM file_collections WHERE collection_id = 'col-a')",
)
def d2(c):
    from ..operators.listing import hydrate

    raw = [("a", "-kind:photo #qual name:IMG"), ("b", "size:>2mb w:<900 before:2024-02"), ("c", "since:8w collection:COL-A")]
    g = DS.interpret_descriptions(c.spark.createDataFrame(raw, "query_id string, raw string"))
    return DS.hard_clauses(g, hydrate(c.files, c.file_tags, c.file_collections), c.now).select("query_id", "file_id")


_STEM_OF = lambda column: f"(SELECT {STEM} FROM (SELECT {column} AS w))"
_FIELDS = list(DS.WEIGHTS)
_WORDS = _DOCS + _ASKED + f""", content AS (SELECT query_id, CASE WHEN len(list_filter(l, lambda x: x NOT IN {_in(D.DESCRIBED_STOP_WORDS)})) > 0 THEN list_filter(l, lambda x: x NOT IN {_in(D.DESCRIBED_STOP_WORDS)}) ELSE l END AS ws FROM asked),
qw AS (SELECT query_id, i, ws[i] AS word, len(ws) AS n FROM (SELECT query_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM content)), bases AS (SELECT DISTINCT word, {_STEM_OF("word")} AS base FROM qw),
lines AS ({" UNION ALL ".join(f"SELECT file_id, '{f}' AS field, {DS.WEIGHTS[f]} AS weight, {i} AS ord, {toks(f)} AS ts FROM docs" for i, f in enumerate(_FIELDS))}),
toks_ AS (SELECT DISTINCT file_id, field, weight, ord, unnest(ts) AS term FROM lines), voc AS (SELECT DISTINCT term, {_STEM_OF("term")} AS st FROM toks_),
fam AS (SELECT DISTINCT {_STEM_OF("a")} AS base, {_STEM_OF("b")} AS st FROM (VALUES {_SYN}) s(a, b)),
pairs AS (SELECT word, base, term, st, EXISTS (SELECT 1 FROM fam WHERE fam.base = bases.base AND fam.st = voc.st) AS named FROM bases JOIN voc ON contains(st, base) OR term = word OR st IN (SELECT f.st FROM fam f WHERE f.base = bases.base)),
kinds AS (SELECT word, term, CASE WHEN term = word THEN 0 WHEN st = base THEN 1 WHEN starts_with(st, base) THEN 2 WHEN length(base) >= 3 AND named THEN 3 WHEN length(base) >= 3 AND contains(st, base) THEN 4 END AS k FROM pairs),
best AS (SELECT word, file_id, field, weight, ord, min(k) AS k FROM kinds JOIN toks_ USING (term) WHERE k IS NOT NULL GROUP BY ALL),
ws AS (SELECT word, file_id, max(weight * {DS.WORTH}[k + 1])::DOUBLE AS score, arg_max(field, (weight * {DS.WORTH}[k + 1], -ord)) AS field FROM best GROUP BY word, file_id)"""


@query("d3_field_word_score", _WORDS + " SELECT query_id, 0 AS grp, word, file_id, score, field FROM qw JOIN ws USING (word)")
def d3(c):
    return DS.field_word_score(DS.interpret_descriptions(_described(c)), _search_index(c))


@query("d4_ordered_phrase", _DOCS + f", q AS (SELECT item_id::VARCHAR AS query_id, ' ' || array_to_string({toks('text')}[2:4], ' ') || ' ' AS p FROM benchmark) SELECT DISTINCT query_id, file_id FROM q JOIN docs ON "
       + " OR ".join(f"contains(' ' || array_to_string({toks(f)}, ' ') || ' ', p)" for f in ("name", "title", "description", "ocr_text", "folder")))
def d4(c):
    words = F.slice(F.filter(F.split(F.translate(F.lower("text"), "", ""), r"[^\p{L}\p{N}]+"), lambda w: w != ""), 2, 3)
    q = c.table("benchmark").select(F.col("item_id").cast("string").alias("query_id"), F.concat(F.lit('"'), F.array_join(words, " "), F.lit('"')).alias("raw"))
    return DS.ordered_phrase(DS.interpret_descriptions(q), _search_index(c)).select("query_id", "file_id").distinct()


@query("d7_exclusions", _DOCS + "SELECT file_id FROM docs WHERE NOT ("
       + " OR ".join(f"len(list_filter({toks(f)}, lambda w: contains({STEM}, '{x}'))) > 0" for f in ("name", "title", "description", "label", "ocr_text", "folder", "tags", "project", "collection", "ext") for x in ("quality", "und")) + ")")
def d7(c):
    g = DS.interpret_descriptions(c.spark.createDataFrame([("q", "anything -quality -und")], "query_id string, raw string"))
    found = _docs(c).select(F.lit("q").alias("query_id"), F.lit(0).alias("grp"), "file_id")
    return DS.exclusions(found, g, _search_index(c)).select("file_id")


@query(
    "d9_describe_search",
    _WORDS + f""", stems AS (SELECT file_id, list_transform(ts, lambda w: {STEM}) AS ss FROM lines),
near AS (SELECT a.query_id, a.i, x.file_id FROM qw a JOIN qw b ON a.query_id = b.query_id AND b.i = a.i + 1 JOIN ws x ON x.word = a.word JOIN ws y ON y.word = b.word AND x.file_id = y.file_id
  JOIN bases p ON p.word = a.word JOIN bases q ON q.word = b.word JOIN stems s ON s.file_id = x.file_id WHERE len(list_filter(range(1, len(ss)), lambda j: ss[j] = p.base AND ss[j + 1] = q.base)) > 0 GROUP BY ALL),
sums AS (SELECT query_id, file_id, any_value(n) AS n, sum(score) AS s, count(*) AS hit, list_sort(list(word) FILTER (field IN ('description', 'label'))) AS reasons FROM qw JOIN ws USING (word) GROUP BY query_id, file_id),
raw AS (SELECT query_id, 0 AS grp, file_id, (s + CASE WHEN n >= 2 THEN 5.0 * hit / n ELSE 0 END + 1.2 * coalesce((SELECT count(*) FROM near x WHERE x.query_id = sums.query_id AND x.file_id = sums.file_id), 0)) * (1 + 0.15 * greatest(hit - 1, 0)) AS score,
  coalesce(reasons, []) AS reasons FROM sums JOIN files USING (file_id) WHERE query_id::BIGINT % 3 <> 0 OR kind <> 'photo' UNION ALL SELECT query_id, 1, file_id, 1.0, [] FROM asked, files WHERE query_id::BIGINT % 3 = 0 AND kind = 'video'),
final AS (SELECT query_id, grp, file_id, reasons, created_at, round(score + greatest(0, 0.6 - (epoch(TIMESTAMP '2024-03-01') - epoch(created_at)) / (4 * 365.0 * 86400)), 6) AS score FROM raw JOIN files USING (file_id)),
one AS (SELECT query_id, file_id, max(score) AS score, arg_max(reasons, (score, -grp)) AS reasons, any_value(created_at) AS created_at FROM final GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, created_at DESC, file_id) AS place FROM one)
SELECT query_id, file_id, score::DOUBLE AS score, array_to_string(reasons, ',') AS reasons, place FROM r WHERE place <= 200""",
)
def d9(c):
    from ..operators.listing import hydrate

    files = hydrate(c.files, c.file_tags, c.file_collections)
    claims = PX.descriptors(c.files, PX.signature(_pixels(c)), c.now)
    found = DS.describe_search(_described(c), files, _search_index(c), c.now, claims)
    return found.withColumns({"reasons": F.array_join("reasons", ","), "place": F.col("place").cast("long")})
