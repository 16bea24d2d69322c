"""Queries of search, vectors, labels, people, pictures and organise plans, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dictionaries as D
from ..functions import text as X
from ..operators import labels as LB
from ..operators import listing as L
from ..operators import neighbours as N
from ..operators import organize as O
from ..operators import people as P
from ..operators import pixels as PX
from ..operators import search as S
from ..operators import vectors as V
from ..operators.index import MORE, WRITTEN, SearchIndex
from ..shared import written
from ..sources.adapters import NOW, Catalog, oracle

QUERIES: dict = {}
SQL: dict[str, str] = {}
T0 = f"TIMESTAMP '{NOW}'"


def query(name: str, body: str | None = None):
    def register(build):
        QUERIES[name] = lambda spark, sf_dir: build(Catalog(spark, sf_dir))
        if body is not None:
            SQL[name] = oracle(body)
        return build

    return register


def toks(column: str, fold: bool = True) -> str:
    low = f"lower(coalesce({column}, ''))"
    low = f"translate({low}, '{D.MARKED}', '{D.PLAIN}')" if fold else low
    return f"list_filter(regexp_split_to_array({low}, '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')"


STEM = (
    "CASE WHEN length(w) <= 3 THEN w WHEN w LIKE '%ies' AND length(w) > 4 THEN substring(w, 1, length(w) - 3) || 'y'"
    " WHEN w LIKE '%sses' THEN substring(w, 1, length(w) - 2) WHEN w LIKE '%s' AND NOT regexp_matches(w, '(ss|us|is)$') THEN substring(w, 1, length(w) - 1) ELSE w END"
)


@query("t1_tokenize", f", t AS (SELECT unnest({toks('ocr_text')}) AS term FROM files) SELECT term, count(*) AS n FROM t GROUP BY term")
def t1(c):
    return c.files.select(F.explode(X.tokens(F.col("ocr_text"), fold=True)).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))


@query("t2_stem", f", t AS (SELECT DISTINCT unnest({toks('text', False)}) AS w FROM conversations) SELECT w AS word, {STEM} AS stem FROM t")
def t2(c):
    words = c.table("conversations").select(F.explode(X.tokens(F.col("text"))).alias("word")).distinct()
    return words.select("word", X.stem(F.col("word")).alias("stem"))


_SYN = ", ".join(f"('{w}', '{o}')" for g in D.SYNONYMS for w in g.split() for o in g.split())


@query(
    "t3_expand_terms",
    f", syn(w, name) AS (VALUES {_SYN}), base AS (SELECT {STEM} AS base, name FROM syn), t AS (SELECT DISTINCT unnest({toks('text', False)}) AS w FROM conversations"
    f" UNION SELECT w FROM syn), v AS (SELECT w, {STEM} AS b FROM t)"
    " SELECT w AS term, w AS variant FROM v UNION SELECT w, b FROM v UNION SELECT w, b || 's' FROM v WHERE b NOT LIKE '%s' UNION SELECT w, name FROM v JOIN base ON b = base",
)
def t3(c):
    words = c.table("conversations").select(F.explode(X.tokens(F.col("text"))).alias("term"))
    names = c.spark.createDataFrame([(w,) for g in D.SYNONYMS for w in g.split()], "term string")
    return S.expand_terms(words.unionAll(names).distinct())


def _raw(c):
    """Every turn of every conversation as a query, with a filter in front that depends on the turn."""
    t = F.col("turn") % 4
    head = F.when(t == 0, "kind:photo, #Trip ").when(t == 1, 'last week "Two Words" is:favorite ').when(t == 2, "Screenshots since:9 ").otherwise("video today pdf ")
    turns = c.table("conversations").select("conv_id", "turn", F.concat(head, F.coalesce("text", F.lit(""))).alias("raw"))
    return turns.select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("query_id"), "raw")


_phr = "greatest(" + ", ".join(f"CASE WHEN regexp_matches(lower(rest), '(^|[^\\p{{L}}\\p{{N}}]){p}($|[^\\p{{L}}\\p{{N}}])') THEN {d} ELSE 0 END" for p, d in D.DAY_PHRASES.items()) + ")"
_kinds = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in D.KIND_WORDS.items()) + "}"
_in = lambda xs: "(" + ", ".join(f"'{x}'" for x in xs) + ")"
_TURNS = """SELECT conv_id || '-' || turn AS query_id, CASE turn % 4 WHEN 0 THEN 'kind:photo, #Trip ' WHEN 1 THEN 'last week "Two Words" is:favorite '
         WHEN 2 THEN 'Screenshots since:9 ' ELSE 'video today pdf ' END || coalesce(text, '') AS raw FROM conversations"""
_READ = f""", q AS (
  SELECT query_id, list_filter(regexp_extract_all(raw, '"([^"]*)"', 1), lambda p: trim(p) <> '') AS phrases, regexp_replace(raw, '"[^"]*"', ' ', 'g') AS rest FROM raws
), w AS (
  SELECT *, {_phr} AS said, list_filter(regexp_split_to_array(trim(rest, ' '), '\\s+'), lambda x: x <> '') AS words FROM q
), n AS (
  SELECT *, list_filter(words, lambda x: regexp_matches(lower(x), '^(since:\\d+|last:\\d+d*)$'))[-1] AS days FROM w
), crit AS (
  SELECT query_id,
    list_concat(list_filter(words, lambda x: NOT (regexp_matches(lower(x), '^(kind:|#|is:|since:\\d+$|last:\\d+d*$)') OR lower(x) IN {_in(D.KIND_WORDS)}
      OR (said > 0 AND lower(x) IN {_in(D.DATE_WORDS)}) OR lower(x) IN {_in(D.STOP_WORDS)})), phrases) AS terms,
    list_filter(list_transform(words, lambda x: CASE WHEN lower(x) LIKE 'kind:%' THEN
      CASE WHEN regexp_extract(lower(x), '^kind:([a-z]*),*$', 1) IN {_in(D.KINDS)} THEN regexp_extract(lower(x), '^kind:([a-z]*),*$', 1) END
      ELSE {_kinds}[lower(x)] END), lambda k: k IS NOT NULL) AS kinds,
    list_filter(list_transform(list_filter(words, lambda x: x LIKE '#%'), lambda x: regexp_replace(lower(x), '^#+', '')), lambda x: x <> '') AS tags,
    coalesce(CAST(regexp_extract(lower(days), '(\\d+)', 1) AS INT), CASE WHEN said > 0 THEN said END) AS since_days,
    len(list_filter(words, lambda x: regexp_matches(lower(x), '^is:(fav|star)'))) > 0 AS favorites
  FROM n
)
"""
_CRIT = f", raws AS ({_TURNS}){_READ}"


@query("t4_interpret_queries", _CRIT + "SELECT query_id, array_to_string(terms, '|') AS terms, (SELECT string_agg(DISTINCT k, '|' ORDER BY k) FROM unnest(kinds) t(k)) AS kinds,"
       " array_to_string(tags, '|') AS tags, since_days::BIGINT AS since_days, favorites FROM crit")
def t4(c):
    q = S.interpret_queries(_raw(c))
    kinds = F.when(F.size("kinds") > 0, F.array_join(F.array_sort("kinds"), "|"))
    return q.select("query_id", F.array_join("terms", "|").alias("terms"), kinds.alias("kinds"), F.array_join("tags", "|").alias("tags"), F.col("since_days").cast("long").alias("since_days"), "favorites")


@query("t19_describe_interpretation", _CRIT + "SELECT query_id, concat_ws(' · ', CASE WHEN len(terms) > 0 THEN array_to_string(terms, ', ') END,"
       " CASE WHEN len(kinds) > 0 THEN 'kind ' || array_to_string(list_sort(list_distinct(kinds)), ', ') END, CASE WHEN len(tags) > 0 THEN '#' || array_to_string(tags, ' #') END,"
       " CASE WHEN since_days IS NOT NULL THEN 'last ' || since_days || ' days' END, CASE WHEN favorites THEN 'favourites' END) AS summary FROM crit")
def t19(c):
    return S.describe_interpretation(S.interpret_queries(_raw(c)).withColumn("kinds", F.array_sort("kinds")))


@query("t5_merge_proposals", _CRIT + "SELECT query_id, len(list_distinct(list_concat(terms, ['extra']))) AS n_terms, CASE WHEN len(kinds) > 0 THEN list_sort(list_distinct(kinds))[1] ELSE 'design' END AS kind,"
       " coalesce(since_days, 30)::BIGINT AS since_days FROM crit")
def t5(c):
    q = S.interpret_queries(_raw(c))
    extra = q.select("query_id", F.array(F.lit("extra")).alias("terms"), F.array(F.lit("design")).alias("kinds"), F.lit(30).alias("since_days"), F.lit(False).alias("favorites"))
    m = S.merge_proposals(q, extra)
    return m.select("query_id", F.size(F.array_distinct("terms")).cast("long").alias("n_terms"), F.array_min("kinds").alias("kind"), F.col("since_days").cast("long").alias("since_days"))


def _docs(c):
    return S.build_search_docs(c.files, c.file_tags, c.faces, c.people, c.file_collections.withColumnRenamed("collection_id", "collection"))


_indexes: dict = {}


def _search_index(c):
    """The index of a data folder, written once for a session and the files' times of change."""
    jvm, conf = c.spark._jvm, c.spark._jsparkSession.sessionState().newHadoopConf()
    named = [f for t in ("documents", "labels", "embeddings") for f in c.table(t).inputFiles()]
    paths = [jvm.org.apache.hadoop.fs.Path(f) for f in named]
    key = (c.spark.sparkContext.applicationId, *((f, p.getFileSystem(conf).getFileStatus(p).getModificationTime()) for f, p in zip(named, paths)))
    if key not in _indexes:
        _indexes[key] = SearchIndex(_docs(c))
    return _indexes[key]


_DOCS = """, docs AS (
  SELECT f.file_id, name, title, description, label, CAST(NULL AS VARCHAR) AS context, ocr_text, folder_path AS folder,
         (SELECT string_agg(DISTINCT tag, ' ' ORDER BY tag) FROM file_tags t WHERE t.file_id = f.file_id) AS tags, project_id AS project,
         (SELECT string_agg(DISTINCT p.label, ' ' ORDER BY p.label) FROM faces a JOIN people p USING (person_id) WHERE a.file_id = f.file_id AND NOT hidden AND p.label IS NOT NULL) AS people,
         (SELECT string_agg(DISTINCT collection_id, ' ' ORDER BY collection_id) FROM file_collections m WHERE m.file_id = f.file_id) AS collection, ext
  FROM files f WHERE index_state <> 'missing'
)
"""


@query("t6_build_search_docs", _DOCS + "SELECT file_id, name, tags, project, people, folder, length(ocr_text)::BIGINT AS n FROM docs")
def t6(c):
    return _docs(c).select("file_id", "name", "tags", "project", "people", "folder", F.length("ocr_text").cast("long").alias("n"))


_POST = _DOCS + ", postings AS (SELECT term, file_id, field, count(*) AS tf FROM (" + " UNION ALL ".join(
    f"SELECT file_id, '{f}' AS field, unnest({toks(f)}) AS term FROM docs" for f in S.FIELDS) + ") GROUP BY ALL)"


@query("t7_build_postings", _POST + " SELECT field, count(*) AS rows, count(DISTINCT term) AS terms, sum(tf)::BIGINT AS tf FROM postings GROUP BY field")
def t7(c):
    p = S.build_postings(_search_index(c))
    return p.groupBy("field").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("term").alias("terms"), F.sum("tf").alias("tf"))


_ORDER = [*WRITTEN, *[f for f in [*S.FIELDS, *MORE] if f not in WRITTEN]]
_PLACED = _DOCS + ", placed AS (" + " UNION ALL ".join(
    f"SELECT file_id, '{f}' AS field, len({toks(f)}) AS n, {' + '.join(['0', *(f'len({toks(g)})' for g in _ORDER[:k])])} + {max(k - len(WRITTEN) + 1, 0)} AS first FROM docs"
    for k, f in enumerate(_ORDER)) + ")"


@query("t7_positions", _PLACED + " SELECT file_id, field, n, first, (n * first + n * (n - 1) // 2)::BIGINT AS places FROM placed WHERE n > 0")
def t7b(c):
    """Each field's words in the positional index: how many, the first place, and the sum of all places."""
    each = F.aggregate("places", F.lit(0).cast("long"), lambda a, p: a + p)
    fields = _search_index(c).places.groupBy("file_id", "field")
    return fields.agg(F.sum("tf").alias("n"), F.min(F.col("places")[0]).cast("long").alias("first"), F.sum(each).alias("places"))


def _asked(c):
    """A query per benchmark item: its three longest distinct words."""
    words = F.array_distinct(X.tokens(F.col("text"), fold=True))
    long = F.slice(F.sort_array(F.transform(words, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))), 1, 3)
    return c.table("benchmark").select(F.col("item_id").cast("string").alias("query_id"), F.array_join(F.transform(long, lambda x: x["w"]), " ").alias("raw"))


def _terms(c):
    """The same words as terms, the item's first two words as a phrase, and its longest word as a person's name."""
    words = X.tokens(F.col("text"), fold=True)
    asked = _asked(c).select("query_id", F.filter(F.split("raw", " "), lambda w: w != "").alias("long"))
    phrase = F.when(F.size(words) > 1, F.array(F.array_join(F.slice(words, 1, 2), " "))).otherwise(F.array().cast("array<string>"))
    pairs = c.table("benchmark").select(F.col("item_id").cast("string").alias("query_id"), phrase.alias("phrase"))
    named = F.transform(F.slice("long", 1, 1), lambda w: F.concat(F.lit("Person:"), w))
    return asked.join(pairs, "query_id").select("query_id", F.concat("long", "phrase", named).alias("terms"))


def _match(said: str, phrases: str) -> str:
    """CTEs up to `matches` from `said` (query_id, scope, w) and more wordings (query_id, scope, alternative)."""
    return f""", syn(w, name) AS (VALUES {_SYN}), base AS (SELECT DISTINCT {STEM} AS base, name FROM syn), said AS ({said}), spelt AS (SELECT *, {STEM} AS b FROM said
), alts AS (
  SELECT query_id, scope, w AS alternative FROM spelt UNION SELECT query_id, scope, b FROM spelt UNION SELECT query_id, scope, b || 's' FROM spelt WHERE b NOT LIKE '%s'
  UNION SELECT query_id, scope, name FROM spelt JOIN base ON b = base UNION {phrases}
), wanted AS (SELECT *, unnest(list_distinct(t)) AS token, len(list_distinct(t)) AS n FROM (SELECT *, {toks('alternative')} AS t FROM alts)
), hit AS (SELECT query_id, scope, token, file_id, sum(tf) AS tf FROM (SELECT DISTINCT query_id, scope, token FROM wanted) JOIN postings ON starts_with(term, token) WHERE scope IN ('', field) GROUP BY ALL
), good AS (SELECT query_id, scope, alternative, file_id FROM wanted JOIN hit USING (query_id, scope, token) GROUP BY query_id, scope, alternative, file_id, n HAVING count(*) = n
), matches AS (
  SELECT DISTINCT query_id, CASE WHEN scope = '' THEN token ELSE scope || ':' || token END AS token, file_id, tf
  FROM good JOIN wanted USING (query_id, scope, alternative) JOIN hit USING (query_id, scope, token, file_id)
)"""


_ASKED = f""", asked AS (
  SELECT item_id::VARCHAR AS query_id, {toks('text')} AS t, list_transform(list_sort(list_transform(list_distinct({toks('text')}), lambda w: {{'n': -length(w), 'w': w}}))[1:3], lambda x: x.w) AS l FROM benchmark
)"""
_MATCH = _POST + _ASKED + _match(
    "SELECT query_id, '' AS scope, unnest(l) AS w FROM asked UNION SELECT query_id, 'people', l[1] FROM asked WHERE len(l) > 0",
    "SELECT query_id, '', t[1] || ' ' || t[2] FROM asked WHERE len(t) > 1",
)
_BM25 = f""", dl AS (SELECT file_id, sum(tf) AS dl FROM postings GROUP BY 1), corpus AS (SELECT avg(dl) AS avgdl, count(*) AS n FROM dl),
df AS (SELECT query_id, token, count(*) AS df FROM matches GROUP BY ALL), ranked AS (
  SELECT query_id, file_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * {S.K1 + 1} / (tf + {S.K1} * ({1 - S.B} + {S.B} * dl / avgdl))), 9) AS score
  FROM matches JOIN df USING (query_id, token) JOIN dl USING (file_id), corpus GROUP BY ALL
)"""
_BASED = """, best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, file_id) AS rn FROM ranked) WHERE rn <= 400),
based AS (SELECT query_id, file_id, score, 0.45 + 0.5 * (1 - (max(score) OVER w - score) / greatest(max(score) OVER w - min(score) OVER w, 1e-6)) AS base FROM best WINDOW w AS (PARTITION BY query_id))
"""
_RANK = _MATCH + _BM25 + _BASED


def _ranked(c):
    index = _search_index(c)
    return S.bm25(S.match_terms(_terms(c), index), index)


@query("t8_match_prefix", _MATCH + " SELECT query_id, token, file_id, tf::BIGINT AS tf FROM matches")
def t8(c):
    return S.match_terms(_terms(c), _search_index(c))


@query("t9_bm25", _RANK + "SELECT query_id, file_id, round(score, 5) AS score FROM best")
def t9(c):
    return _ranked(c).withColumn("score", F.round("score", 5))


@query("t10_normalise_rank", _RANK + "SELECT query_id, file_id, round(base, 5) AS base FROM based")
def t10(c):
    return S.normalise_rank(_ranked(c)).select("query_id", "file_id", F.round("base", 5).alias("base"))


@query(
    "t11_substring_fallback",
    _DOCS + ", asked AS (SELECT item_id::VARCHAR AS query_id, substring(text, 2, 5) AS term FROM benchmark WHERE length(text) >= 6), hits AS (SELECT query_id, file_id,"
    " row_number() OVER (PARTITION BY query_id ORDER BY file_id DESC) AS place FROM asked, docs WHERE contains(lower(concat_ws(chr(10), name, folder, title, description, people)), lower(term)))"
    " SELECT query_id, file_id, round(0.5 - least((place - 1) * 0.001, 0.14), 6) AS base FROM hits WHERE place <= 120",
)
def t11(c):
    crit = c.table("benchmark").where("length(text) >= 6").select(F.col("item_id").cast("string").alias("query_id"), F.array(F.substring("text", 2, 5)).alias("terms"))
    return S.substring_fallback(crit, crit.limit(0), _search_index(c)).withColumn("base", F.round("base", 6))


@query("t12_tag_only_hits", "SELECT DISTINCT 'q' || tag AS query_id, file_id, 0.6::DOUBLE AS base FROM file_tags")
def t12(c):
    none = F.array().cast("array<string>")
    crit = c.file_tags.select("tag").distinct().select(F.concat(F.lit("q"), "tag").alias("query_id"), none.alias("terms"), F.array("tag").alias("tags"))
    return S.tag_only_hits(crit, c.file_tags)


@query(
    "t12_filter_only_hits",
    f"SELECT query_id, file_id FROM (SELECT k AS query_id, file_id, row_number() OVER (PARTITION BY k ORDER BY created_at DESC, file_id) AS p FROM files JOIN (VALUES ('photo'), ('document')) v(k) ON kind = k"
    f" WHERE index_state <> 'missing' AND created_at >= {T0} - INTERVAL 58 DAY) WHERE p <= 400",
)
def t12b(c):
    none = F.array().cast("array<string>")
    crit = c.spark.createDataFrame([("photo",), ("document",)], "query_id string").select("query_id", none.alias("terms"), none.alias("tags"), F.array("query_id").alias("kinds"), F.lit(58).alias("since_days"), F.lit(False).alias("favorites"))
    return S.filter_only_hits(crit, c.files, c.now).select("query_id", "file_id")


_RAWS = _ASKED + ", raws AS (SELECT query_id, array_to_string(l, ' ') AS raw FROM asked)"
_TITLES = ", raws AS (SELECT file_id::VARCHAR AS query_id, title AS raw FROM files WHERE file_id % 100 = 0)"
_COVER = f""", wr AS (SELECT file_id, list_transform({toks("concat_ws(' ', description, title, ocr_text, label, tags)", False)}, lambda w: {STEM}) AS line FROM docs),
ct AS (SELECT query_id, list_transform(list_filter(terms, lambda x: NOT contains(x, ':')), lambda x: list_transform([lower(x)], lambda w: {STEM})[1]) AS ts FROM crit),
others AS (SELECT {STEM} AS t, list(DISTINCT list_transform([name], lambda w: {STEM})[1]) AS names FROM (VALUES {_SYN}) s(w, name) GROUP BY 1),
ci AS (SELECT query_id, i, ts[i] AS t, ts[i + 1] AS after, len(ts) AS n FROM (SELECT query_id, ts, unnest(range(1, len(ts) + 1)) AS i FROM ct)),
ch AS (SELECT query_id, i, file_id, n, (regexp_matches(ci.t, '^[\\p{{L}}\\p{{N}}]+$') AND len(list_filter(line, lambda x: CASE WHEN strlen(ci.t) < 3 THEN x = ci.t ELSE starts_with(x, ci.t) END)) > 0)
       OR coalesce(list_has_any(line, names), false) AS hit, len(list_filter(range(1, len(line)), lambda p: line[p] = ci.t AND line[p + 1] = after)) > 0 AS beside FROM ci LEFT JOIN others USING (t), wr),
covers AS (SELECT query_id, file_id, count(*) FILTER (hit) / any_value(n) AS covered, count(*) FILTER (hit AND beside) AS together FROM ch GROUP BY ALL HAVING count(*) FILTER (hit) > 0)"""


def _search_sql(raws: str, near: str) -> str:
    """CTEs up to `results` (query_id, file_id, score, match, total, place) of whole searches; `near`: query_id, file_id, similarity."""
    pairs = f"(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, file_id)) AS place"
    return (
        _POST + raws + _READ + _match("SELECT query_id, '' AS scope, unnest(list_transform(terms, lambda x: lower(x))) AS w FROM crit", "SELECT query_id, '', '' FROM crit WHERE false") + _BM25
        + f""", passed AS (SELECT query_id, file_id FROM crit, files WHERE index_state <> 'missing' AND (len(kinds) = 0 OR list_contains(kinds, kind))
  AND (since_days IS NULL OR created_at >= {T0} - to_days(since_days)) AND (NOT favorites OR favorite)),
allowed AS (SELECT * FROM ranked SEMI JOIN passed USING (query_id, file_id))"""
        + _BASED.replace("FROM ranked", "FROM allowed")
        + f""", lost AS (SELECT query_id, list_sort(list_transform(list_filter(terms, lambda x: length(x) >= 3), lambda x: {{'n': -length(x), 't': lower(x)}}))[1].t AS t FROM crit ANTI JOIN based USING (query_id)),
found AS (SELECT query_id, file_id, row_number() OVER (PARTITION BY query_id ORDER BY file_id DESC) AS p FROM lost, docs WHERE contains(lower(concat_ws(chr(10), name, folder, title, description, people)), t)),
bare AS (SELECT query_id, file_id, row_number() OVER (PARTITION BY query_id ORDER BY created_at DESC, file_id) AS p FROM passed JOIN files USING (file_id) SEMI JOIN (SELECT query_id FROM crit WHERE len(terms) = 0 AND len(tags) = 0) USING (query_id)),
bases AS (SELECT query_id, file_id, base FROM based UNION ALL SELECT query_id, file_id, 0.5 - least((p - 1) * 0.001, 0.14) FROM found WHERE p <= 120 UNION ALL SELECT query_id, file_id, 0.5 FROM bare WHERE p <= 400),
near AS ({near}), both_ AS (SELECT * FROM (SELECT * FROM bases FULL JOIN near USING (query_id, file_id)) SEMI JOIN passed USING (query_id, file_id))"""
        + _COVER
        + f""", why AS (SELECT b.*, covered, together, created_at, CASE WHEN len(list_filter(terms, lambda x: contains(lower(d.name), lower(x)))) > 0 THEN 'filename' WHEN len(list_filter(terms, lambda x: contains(lower(d.tags), lower(x)))) > 0 THEN 'tag'
  WHEN len(list_filter(terms, lambda x: contains(lower(project), lower(x)))) > 0 THEN 'project' WHEN len(list_filter(terms, lambda x: contains(lower(folder), lower(x)))) > 0 THEN 'folder'
  WHEN len(list_filter(terms, lambda x: contains(lower(collection), lower(x)))) > 0 THEN 'collection' WHEN len(list_filter(terms, lambda x: contains(lower(d.ocr_text), lower(x)))) > 0 THEN 'text' ELSE 'semantic' END AS match
  FROM both_ b JOIN crit USING (query_id) JOIN docs d USING (file_id) JOIN files USING (file_id) LEFT JOIN covers USING (query_id, file_id)),
scores AS (SELECT query_id, file_id, match, round(least(greatest(coalesce(base, 0.35) + CASE match WHEN 'filename' THEN 0.18 WHEN 'tag' THEN 0.1 ELSE 0 END + 0.24 * coalesce(covered, 0) + 0.035 * coalesce(together, 0)
  + 0.28 * least(greatest(coalesce(similarity, 0), 0), 1) + CASE WHEN epoch({T0}) - epoch(created_at) < 86400 THEN 0.07 WHEN epoch({T0}) - epoch(created_at) < 7 * 86400 THEN 0.035 WHEN epoch({T0}) - epoch(created_at) > 365 * 86400 THEN -0.04 ELSE 0 END, 0), 1), 6) AS score FROM why),
results AS (SELECT * FROM (SELECT query_id, file_id, score, match, count(*) OVER (PARTITION BY query_id) AS total, {pairs} FROM scores) WHERE place <= 200)"""
    )


_RESULTS = " SELECT query_id, file_id, score::DOUBLE AS score, match, total, place FROM results"
_NO_VECTORS = "SELECT NULL::VARCHAR AS query_id, NULL::BIGINT AS file_id, 0.0::DOUBLE AS similarity WHERE false"
_SEARCH = _search_sql(_RAWS, _NO_VECTORS)


def _placed(found):
    return found.withColumn("place", F.col("place").cast("long"))


@query("t16_search_batch", _SEARCH + _RESULTS)
def t16(c):
    return _placed(S.search_batch(_asked(c), c.files, _search_index(c), c.file_tags, c.now))


@query(
    "t15_fuse_and_rerank",
    ", ix AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)"
    + _search_sql(_TITLES, "SELECT query_id, id AS file_id, score AS similarity FROM (SELECT q.id::VARCHAR AS query_id, x.id, round(list_inner_product(q.e, x.e), 9) AS score, row_number() OVER (PARTITION BY q.id ORDER BY round(list_inner_product(q.e, x.e), 9) DESC, x.id) AS p FROM ix q, ix x WHERE q.id % 100 = 0) WHERE p <= 60")
    + _RESULTS,
)
def t15(c):
    """Every hundredth file's title as a query, with the vectors nearest to the file's own."""
    asked = c.files.where("file_id % 100 = 0").select(F.col("file_id").cast("string").alias("query_id"), F.col("title").alias("raw"))
    own = _index(c).where("id % 100 = 0").withColumnRenamed("id", "query_id")
    near = V.knn(own, _index(c), 60).select(F.col("query_id").cast("string").alias("query_id"), F.col("id").alias("file_id"), F.col("score").alias("similarity"))
    return _placed(S.search_batch(asked, c.files, _search_index(c), c.file_tags, c.now, near))


@query("a15_hit_breakdown", _SEARCH + " SELECT query_id, count(*) AS hits, count(*) FILTER (match = 'text') AS by_text, count(*) FILTER (match = 'semantic') AS by_vector FROM results GROUP BY query_id")
def a15(c):
    return S.hit_breakdown(S.search_batch(_asked(c), c.files, _search_index(c), c.file_tags, c.now))


@query("t13_coverage", _DOCS + _RAWS + _READ + _COVER + " SELECT query_id, file_id, round(covered, 6)::DOUBLE AS covered, together FROM covers")
def t13(c):
    found = S.coverage(S.interpret_queries(_asked(c)), _search_index(c))
    return found.withColumns({"covered": F.round("covered", 6), "together": F.col("together").cast("long")})


@query(
    "t14_classify_match",
    _DOCS + ", asked AS (SELECT item_id::VARCHAR AS query_id, split_part(text, ' ', 2) AS t FROM benchmark) SELECT query_id, file_id, CASE WHEN contains(lower(name), lower(t)) THEN 'filename' WHEN contains(lower(tags), lower(t)) THEN 'tag'"
    " WHEN contains(lower(project), lower(t)) THEN 'project' WHEN contains(lower(folder), lower(t)) THEN 'folder' WHEN contains(lower(collection), lower(t)) THEN 'collection' WHEN contains(lower(ocr_text), lower(t)) THEN 'text' ELSE 'semantic' END AS match FROM asked, docs",
)
def t14(c):
    asked = c.table("benchmark").select(F.col("item_id").cast("string").alias("query_id"), F.array(F.split_part("text", F.lit(" "), F.lit(2))).alias("terms"))
    # the stated query set against all rows
    return S.classify_all(_docs(c), asked)


def _snip(text: str, term: str, width: int) -> str:
    """DuckDB's form of a snippet around one term."""
    flat = f"regexp_replace({text}, '[\\r\\n]+', ' ', 'g')"
    at = f"instr(lower({flat}), '{term}')"
    begin = f"greatest({at} - {width // 2}, 1)"
    return (
        f"CASE WHEN {at} > 0 THEN CASE WHEN {begin} > 1 THEN '…' ELSE '' END || trim(substring({flat}, {begin}, {width}), ' ')"
        f" || CASE WHEN {begin} + {width} <= length({flat}) THEN '…' ELSE '' END END"
    )


@query("t17_snippet", f"SELECT file_id, coalesce({_snip('ocr_text', 'sch', 160)}, {_snip('path', 'sch', 120)}, {_snip('ocr_text', 'img', 160)}, {_snip('path', 'img', 120)}) AS snippet FROM files")
def t17(c):
    """Around "sch" in the text, else "img" in the text or the path."""
    one = lambda t: X.hit_snippet(F.col("ocr_text"), F.col("path"), F.array(F.lit(t)))
    return c.files.select("file_id", F.coalesce(one("sch"), one("img")).alias("snippet"))


@query(
    "t18_highlight",
    ", b AS (SELECT file_id, substring(ocr_text, 1, 400) AS t FROM files), m AS (SELECT file_id, t, len(regexp_extract_all(t, '(?i)(the|der)')) AS hits, len(list_filter(regexp_split_to_array(t, '(?i)(the|der)'), lambda x: x <> '')) AS plain FROM b)"
    " SELECT file_id, hits + plain AS n, hits FROM m",
)
def t18(c):
    return c.files.select("file_id", X.highlight(F.col("ocr_text"), ["the", "der"]).alias("parts")).select("file_id", F.size("parts").cast("long").alias("n"), F.size(F.filter("parts", lambda p: p["hit"])).cast("long").alias("hits"))


@query("t20_query_history", "SELECT raw FROM (SELECT event_type || user_id AS raw, max(ts) AS last FROM events GROUP BY 1 ORDER BY last DESC, raw LIMIT 24)")
def t20(c):
    log = c.table("events").select(F.concat("event_type", F.col("user_id").cast("string")).alias("raw"), F.col("ts").alias("at"))
    return S.query_history(log).select("raw")


# Vectors


def _index(c):
    return c.table("embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))


_IX = ", ix AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)"


@query("v1_cosine", _IX + " SELECT a.id, round(list_cosine_similarity(a.e, b.e), 6) AS cosine FROM ix a JOIN ix b ON b.id = a.id + 1")
def v1(c):
    a, b = _index(c), _index(c).select((F.col("id") - 1).alias("id"), F.col("embedding").alias("e"))
    return a.join(b, "id").select("id", F.round(V.cosine(V.normalise(F.col("embedding")), F.col("e")), 6).alias("cosine"))


@query("v2_upsert_vectors", "SELECT vec_id AS id, vec_id % 3 = 0 AS new FROM embeddings WHERE vec_id % 3 = 0 OR vec_id % 2 = 0")
def v2(c):
    tagged = _index(c).withColumn("space", F.lit("clip")).withColumn("new", F.lit(False))
    fresh = tagged.where("id % 3 = 0").withColumn("new", F.lit(True)).unionAll(tagged.where("id % 5 = 1").withColumn("embedding", F.slice("embedding", 1, 7)))
    return V.upsert_vectors(tagged.where("id % 2 = 0"), fresh, "clip", 64).select("id", "new")


_KNN = _IX + """, s AS (SELECT q.id AS query_id, x.id, round(list_inner_product(q.e, x.e), 9) AS score FROM ix q, ix x WHERE q.id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS place FROM s)"""


@query("v3_knn", _KNN + " SELECT query_id, id, place FROM r WHERE place <= 10")
def v3(c):
    q = _index(c).where("id % 100 = 0").withColumnRenamed("id", "query_id")
    return V.knn(q, _index(c), 10).select("query_id", "id", F.col("place").cast("long").alias("place"))


@query("v4_knn_l2", _IX + ", s AS (SELECT q.id AS query_id, x.id, round(1 - list_distance(q.e, x.e), 9) AS score FROM ix q, ix x WHERE q.id % 100 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS place FROM s) SELECT query_id, id, place FROM r WHERE place <= 10")
def v4(c):
    q = _index(c).where("id % 100 = 0").withColumnRenamed("id", "query_id")
    return V.knn(q, _index(c), 10, l2=True).select("query_id", "id", F.col("place").cast("long").alias("place"))


@query("v5_similar_files", _KNN + ", o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS p FROM r WHERE query_id <> id AND place <= 11) SELECT query_id, id, p AS place FROM o WHERE p <= 10")
def v5(c):
    return V.similar_files(_index(c), _index(c).where("id % 100 = 0").select("id"), 10).select("query_id", "id", F.col("place").cast("long").alias("place"))


@query("v6_knn_approx")
def v6(c):
    """The ten neighbours by inverted lists, with the share of all rows that was scored and the recall against v3_knn, by query."""
    q = _index(c).where("id % 100 = 0").withColumnRenamed("id", "query_id")
    lists = N.InvertedLists(_index(c), 64)
    found = written(lists.search(q, 10), "v6-found")
    share = F.round(F.col("scored") / lists.rows, 6).alias("scored_share")
    hits = N.recall(found, V.knn(q, _index(c), 10))
    return found.join(hits, "query_id").select("query_id", "id", "score", F.col("place").cast("long").alias("place"), share, "recall")


@query("v7_zero_shot_scores", _IX + ", p AS (SELECT * FROM ix WHERE id < 5), s AS (SELECT ix.id, p.id AS prompt, 5 * list_cosine_similarity(ix.e, p.e) AS s FROM ix, p) SELECT id, prompt, round(exp(s) / sum(exp(s)) OVER (PARTITION BY id), 6) AS share FROM s")
def v7(c):
    prompts = _index(c).where("id < 5").withColumnRenamed("id", "prompt")
    return V.zero_shot_scores(_index(c), prompts, 5.0).withColumn("share", F.round("share", 6))


@query("v8_choose_modality", "SELECT file_id, CASE WHEN file_id % 2 = 0 THEN 'picture' WHEN file_id % 3 = 0 THEN 'text' END AS modality FROM files")
def v8(c):
    vec = c.files.select("file_id", F.array(F.lit(1.0)).alias("embedding"))
    return V.choose_modality(c.files, vec.where("file_id % 2 = 0"), vec.where("file_id % 3 = 0"), True).select("file_id", "modality")


_TAGSET = "coalesce((SELECT list(DISTINCT tag) FROM file_tags t WHERE t.file_id = f.file_id), []) AS tags"


@query(
    "r1_related",
    f", b AS (SELECT file_id, folder_id, project_id, created_at, list_distinct(list_filter({toks('ocr_text', False)}, lambda w: strlen(w) > 3)) AS words, {_TAGSET}"
    " FROM files f WHERE index_state <> 'missing'), m AS (SELECT t.file_id AS target, o.file_id, len(list_intersect(o.tags, t.tags)) AS shared, len(t.tags) AS n_tags,"
    " len(list_intersect(o.words, t.words)) AS common, len(o.words) + len(t.words) AS n_words, coalesce(o.folder_id = t.folder_id, false) AS folder, coalesce(o.project_id = t.project_id, false) AS project,"
    " abs(epoch(o.created_at) - epoch(t.created_at)) / 86400 AS days FROM b t JOIN b o ON t.file_id <> o.file_id WHERE t.file_id % 100 = 0),"
    " s AS (SELECT *, round(least(0.45 * shared / greatest(n_tags, 1) + 0.4 * common / greatest(n_words - common, 1) + CASE WHEN folder THEN 0.12 ELSE 0 END + CASE WHEN project THEN 0.18 ELSE 0 END"
    " + CASE WHEN days < 1 THEN 0.1 WHEN days < 7 THEN 0.04 ELSE 0 END, 1), 6) AS score FROM m),"
    " r AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY score DESC, file_id) AS place FROM s WHERE score > 0.05) SELECT target, file_id, score,"
    " CASE WHEN project THEN 'project' WHEN shared > 0 THEN 'tag' WHEN folder THEN 'folder' ELSE 'text' END AS reason FROM r WHERE place <= 12",
)
def r1(c):
    return V.related(c.files, c.file_tags, c.files.where("file_id % 100 = 0"), 12).select("target", "file_id", "score", "reason")


@query(
    "r2_related_simple",
    f", b AS (SELECT file_id, folder_id, kind, {_TAGSET}, coalesce((SELECT list(DISTINCT collection_id) FROM file_collections m WHERE m.file_id = f.file_id), []) AS groups FROM files f),"
    " k AS (SELECT t.file_id AS target, o.file_id, 2.0 * len(list_intersect(o.tags, t.tags)) + CASE WHEN len(list_intersect(o.groups, t.groups)) > 0 THEN 1.5 ELSE 0 END"
    " + CASE WHEN o.folder_id = t.folder_id THEN 0.75 ELSE 0 END + CASE WHEN o.kind = t.kind THEN 0.4 ELSE 0 END AS score FROM b t JOIN b o ON t.file_id <> o.file_id WHERE t.file_id % 100 = 0),"
    " r AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY score DESC, file_id) AS place FROM k WHERE score > 0) SELECT target, file_id, round(score, 6)::DOUBLE AS score FROM r WHERE place <= 12",
)
def r2(c):
    return V.related_simple(c.files, c.file_tags, c.file_collections, c.files.where("file_id % 100 = 0"), 12).select("target", "file_id", F.round("score", 6).alias("score"))


# Labels


def _scores(c):
    """Four labels per file, two phrasings each, with scores by formula."""
    i = F.col("file_id")
    rows = c.files.select("file_id", "kind", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("v"))
    score = ((i * 31 + F.col("v") * 17) % 97 + 1) / 100.0
    return rows.select("file_id", "kind", F.element_at(F.array(*map(F.lit, ["dog", "beach", "code", "animal"])), F.col("v") % 4 + 1).alias("label"), score.alias("score"))


_SC = ", sc AS (SELECT file_id, kind, ['dog', 'beach', 'code', 'animal'][v % 4 + 1] AS label, ((file_id * 31 + v * 17) % 97 + 1) / 100.0 AS score FROM files, range(8) t(v)), pl AS (SELECT file_id, any_value(kind) AS kind, label, max(score) AS score FROM sc GROUP BY file_id, label), sh AS (SELECT *, score / sum(score) OVER (PARTITION BY file_id) AS share FROM pl)"


@query("l1_pool", _SC + " SELECT file_id, label, round(share, 6) AS share FROM sh")
def l1(c):
    return LB.pool(_scores(c)).select("file_id", "label", F.round("share", 6).alias("share"))


@query("l2_pick_category", _SC + ", r AS (SELECT *, row_number() OVER w AS rn, lead(share) OVER w AS nxt, max(CASE WHEN label = 'code' THEN share END) OVER (PARTITION BY file_id) AS own FROM sh WINDOW w AS (PARTITION BY file_id ORDER BY share DESC, label))"
       " SELECT file_id, CASE WHEN share >= 0.34 AND share >= 1.1 * coalesce(nxt, 0) AND (own IS NULL OR share >= 1.5 * own) THEN label ELSE 'code' END AS category FROM r WHERE rn = 1")
def l2(c):
    shares = LB.pool(_scores(c)).withColumnRenamed("label", "category")
    return LB.pick_category(shares, F.lit("code"))


_SEL = _SC + ", r AS (SELECT *, row_number() OVER w AS rn, first_value(share) OVER w AS top, nth_value(share, 2) OVER (PARTITION BY file_id ORDER BY share DESC, label ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS second FROM sh WHERE label <> 'code' WINDOW w AS (PARTITION BY file_id ORDER BY share DESC, label)), sel AS (SELECT file_id, label, share, rn FROM r WHERE (top >= 0.15 OR (top >= 0.06 AND top >= 1.25 * coalesce(second, 0))) AND (rn = 1 OR (share >= 0.15 AND share >= 0.45 * top)) AND rn <= 4)"


@query("l3_select_labels", _SEL + " SELECT file_id, label, rn FROM sel")
def l3(c):
    return LB.select_labels(LB.pool(_scores(c)), ["code"]).select("file_id", "label", F.col("rn").cast("long").alias("rn"))


@query("l4_suppress_parents", _SEL + " SELECT file_id, label FROM sel s WHERE NOT (label = 'animal' AND EXISTS (SELECT 1 FROM sel x WHERE x.file_id = s.file_id AND x.label = 'dog'))")
def l4(c):
    tree = c.spark.createDataFrame([("dog", "animal")], "child string, parent string")
    return LB.suppress_parents(LB.select_labels(LB.pool(_scores(c)), ["code"]), tree).select("file_id", "label")


def _classified(c):
    tree = c.spark.createDataFrame([("dog", "animal")], "child string, parent string")
    stage1 = LB.pool(_scores(c)).select("file_id", F.col("label").alias("category"), "share")
    return LB.classify_labels(stage1, _scores(c).select("file_id", "label", "score"), F.lit("code"), ["code"], tree)


@query("l5_classify_labels")
def l5(c):
    return _classified(c)


@query("l6_describe_sentence")
def l6(c):
    heads = c.spark.createDataFrame([("code", "Source code"), ("dog", "A photograph"), ("beach", "A view")], "label string, head string")
    parts = c.spark.createDataFrame([("dog", "of a dog"), ("beach", "by the sea"), ("animal", "of an animal")], "label string, fragment string")
    return LB.describe_sentence(_classified(c), heads, parts)


@query("l7_clean_caption", ", t AS (SELECT file_id, regexp_replace(regexp_replace(trim(regexp_replace(description, '\\s+', ' ', 'g'), ' '), '^(a|an|the) ', '', 'i'), '[ .]+$', '') AS x FROM files) SELECT file_id, CASE WHEN length(x) >= 3 THEN CASE WHEN x[1] = 'ß' THEN 'SS' ELSE upper(x[1]) END || substring(x, 2) END AS caption FROM t")
def l7(c):
    return c.files.select("file_id", X.clean_caption(F.col("description")).alias("caption"))


@query("l8_merge_descriptions", "SELECT file_id, CASE WHEN file_id % 2 = 0 THEN 'said' ELSE description END AS description, CASE WHEN file_id % 2 = 0 THEN 'dog,' ELSE '' END || label AS labels FROM files")
def l8(c):
    measured = c.files.select("file_id", "description", F.array("label").alias("labels"))
    captions = c.files.where("file_id % 2 = 0").select("file_id", F.lit("said").alias("description"), F.array(F.lit(" Dog"), F.lit("dog")).alias("labels"))
    return LB.merge_descriptions(measured, captions).withColumn("labels", F.array_join("labels", ","))


def _derived(c):
    return LB.derive_tags(c.files.select("file_id", "kind", "name", F.array("label", F.lit("photo")).alias("labels"), F.col("ocr_text").alias("text")))


def _sig(column: str) -> str:
    q = lambda s: s.replace("'", "''")
    return "list_filter([" + ", ".join("CASE WHEN " + " OR ".join(f"contains(lower({column}), '{q(n)}')" for n in ns) + f" THEN '{t}' END" for t, ns in D.SIGNALS.items()) + "], lambda x: x IS NOT NULL)"


_TAGGED = f""", a AS (SELECT file_id, kind, list_concat([label], {_sig('ocr_text')}, {_sig('name')}, CASE WHEN kind IN {_in(D.KIND_TAGS)} THEN [kind] ELSE [] END) AS t FROM files),
o AS (SELECT file_id, kind, unnest(t) AS tag, generate_subscripts(t, 1) AS i FROM a), f AS (SELECT file_id, kind, tag, min(i) AS i FROM o GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY i) AS rn FROM f)"""


@query("l9_derive_tags", _TAGGED + " SELECT file_id, string_agg(tag, ',' ORDER BY rn) AS tags FROM r WHERE rn <= 8 GROUP BY file_id")
def l9(c):
    return _derived(c).select("file_id", F.array_join(F.transform("tags", lambda t: t["name"]), ",").alias("tags"))


_has = lambda *tags: "list_has_any(t, [" + ", ".join(f"'{t}'" for t in tags) + "])"
_LANGUAGES = "react typescript javascript python rust java sql css html shell".split()


@query(
    "l10_infer_context",
    _TAGGED + f", g AS (SELECT file_id, kind, list(tag) AS t FROM r WHERE rn <= 8 GROUP BY ALL), l AS (SELECT *, list_filter({_LANGUAGES}, lambda x: list_contains(t, x))[1] AS w FROM g), n AS (SELECT *, upper(w[1]) || w[2:] AS lang FROM l)"
    f" SELECT file_id, CASE WHEN {_has('code', 'terminal', 'error', *_LANGUAGES)} THEN 'Programming / ' || CASE WHEN {_has('error')} AND lang IS NOT NULL THEN lang || ' debugging' WHEN {_has('error')} THEN 'debugging'"
    f" WHEN lang IS NOT NULL THEN lang WHEN {_has('terminal')} THEN 'terminal work' ELSE 'source code' END WHEN {_has('receipt', 'invoice')} THEN 'Documents / Receipts and invoices'"
    f" WHEN {_has('design')} OR ({_has('ui')} AND {_has('screenshot')}) THEN 'Design / Interface references' WHEN {_has('presentation')} THEN 'Documents / Presentations' WHEN {_has('spreadsheet')} THEN 'Documents / Spreadsheets'"
    f" WHEN {_has('recipe')} THEN 'Reference / Recipes' WHEN {_has('ticket')} THEN 'Documents / Travel and tickets' WHEN {_has('person', 'portrait', 'selfie', 'group')} THEN 'People / Photographs'"
    f" WHEN {_has('chart', 'dashboard')} THEN 'Work / Charts and dashboards' WHEN {_has('game')} THEN CASE WHEN kind = 'screenshot' THEN 'Games / Screenshots' ELSE 'Games / Captures' END"
    f" WHEN {_has('food', 'drink')} THEN 'Photographs / Food and drink' WHEN {_has('animal', 'dog', 'cat', 'bird')} THEN 'Photographs / Animals'"
    f" WHEN {_has('outdoors', 'nature', 'beach', 'mountain', 'city', 'sky', 'night', 'plant', 'sports')} THEN 'Photographs / Outdoors and travel' WHEN {_has('vehicle', 'building', 'furniture', 'clothing', 'product')} THEN 'Photographs / Objects'"
    f" WHEN {_has('art', 'logo')} THEN 'Design / Artwork' WHEN {_has('text')} THEN 'Documents / Text' WHEN kind = 'screenshot' THEN 'Screenshots' WHEN kind = 'document' THEN 'Documents' WHEN kind = 'video' THEN 'Video'"
    " WHEN kind = 'audio' THEN 'Audio' WHEN kind = 'design' THEN 'Design / Interface references' END AS context FROM n",
)
def l10(c):
    return LB.infer_context(_derived(c))


@query("l11_replace_machine_tags", "SELECT file_id, tag, source FROM file_tags WHERE source = 'user' OR file_id % 4 <> 0 UNION ALL SELECT file_id, 'fresh', 'ocr' FROM files WHERE file_id % 8 = 0")
def l11(c):
    new = c.files.where("file_id % 4 = 0").select("file_id", F.when(F.col("file_id") % 8 == 0, "fresh").alias("tag"), F.lit("ocr").alias("source"))
    return LB.replace_machine_tags(c.file_tags, new)


# People


@query("g1_score_faces", "SELECT file_id, round(least(width, height) * 0.5 * (0.6 + 0.4 * (1 - 0.5)), 6) AS quality FROM files WHERE width >= 56 AND height >= 56")
def g1(c):
    d = c.files.where("width is not null").select("file_id", "width", "height", (F.col("width") * 0.25).alias("x"), F.lit(0.0).alias("y"), F.col("width").alias("w"), F.col("height").alias("h"), F.lit(0.5).alias("score"))
    return P.score_faces(d).select("file_id", F.round("quality", 6).alias("quality"))


_CEN = ", s AS (SELECT person_id, i, sum(embedding[i]) AS s FROM faces, range(1, 65) t(i) GROUP BY ALL), cen AS (SELECT person_id, list(s ORDER BY i) AS v FROM s GROUP BY 1), cent AS (SELECT person_id, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) AS cen FROM cen)"


@query("g4_centroids", _CEN + " SELECT c.person_id, round(cen[1], 6) AS first, round(cen[64], 6) AS last, (SELECT count(*) FROM faces f WHERE f.person_id = c.person_id) AS faces FROM cent c")
def g4(c):
    p = P.centroids(c.faces)
    return p.select("person_id", F.round(F.element_at("centroid", 1), 6).alias("first"), F.round(F.element_at("centroid", 64), 6).alias("last"), "faces")


@query("g2_assign_faces", _CEN + ", sc AS (SELECT face_id, c.person_id, round(list_cosine_similarity(embedding, cen), 9) AS score FROM faces, cent c), r AS (SELECT *, row_number() OVER (PARTITION BY face_id ORDER BY score DESC, person_id) AS rn FROM sc) SELECT face_id, CASE WHEN score >= 0.363 THEN person_id END AS person_id FROM r WHERE rn = 1")
def g2(c):
    return P.assign_faces(c.faces, P.centroids(c.faces)).select("face_id", "person_id")


@query(
    "g2_store_faces",
    ", kept AS (SELECT * FROM faces WHERE file_id NOT IN (SELECT file_id FROM faces WHERE face_id % 4 = 0)), s AS (SELECT person_id, i, sum(embedding[i]) AS s FROM kept, range(1, 65) t(i) GROUP BY ALL), cen AS (SELECT person_id, list(s ORDER BY i) AS v FROM s GROUP BY 1),"
    " new AS (SELECT face_id, file_id, CASE WHEN face_id % 8 = 0 THEN list_transform(list_zip(embedding, v), lambda x: x[1] + x[2]) ELSE v END AS e FROM faces JOIN cen USING (person_id) WHERE face_id % 4 = 0),"
    " r AS (SELECT n.face_id, n.file_id, c.person_id, row_number() OVER (PARTITION BY n.face_id ORDER BY round(list_cosine_similarity(e, v), 9) DESC, c.person_id) AS rn FROM new n, cen c)"
    " SELECT face_id, file_id, person_id FROM kept UNION ALL SELECT face_id + 1000000, file_id, person_id FROM r WHERE rn = 1",
)
def g2b(c):
    """Every fourth face's file is looked at again, and shows one face near the middle of the face's old group."""
    faces = c.faces
    again = faces.where("face_id % 4 = 0").select("face_id", "file_id", "person_id", "quality", F.col("embedding").alias("own"))
    kept = faces.join(again.select("file_id").distinct(), "file_id", "left_anti")
    sums = kept.select("person_id", F.posexplode("embedding")).groupBy("person_id", "pos").agg(F.sum("col").alias("s")).groupBy("person_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("pos", "s"))), lambda x: x["s"]).alias("v")
    )
    near = F.when(F.col("face_id") % 8 == 0, F.zip_with("own", "v", lambda a, b: a + b)).otherwise(F.col("v"))
    detected = again.join(sums, "person_id").select((F.col("face_id") + 1000000).alias("face_id"), "file_id", "quality", near.alias("embedding"))
    found, _ = P.store_faces(faces, c.people, detected, again)
    return found.select("face_id", "file_id", "person_id")


@query("g3_cluster_faces")
def g3(c):
    return P.cluster_faces(c.faces)


@query("g3_face_units")
def g3_units(c):
    """How much of all pairs of face vectors a join by blocks about pivots compares (g3_cluster_faces compares faces with leaders only): one row of figures."""
    return P.face_blocks(P.face_classes(c.faces)).work()


@query(
    "g5_carry_labels",
    _CEN + ", s2 AS (SELECT person_id // 2 + 100 AS person_id, i, sum(embedding[i]) AS s FROM faces, range(1, 65) t(i) GROUP BY ALL), c2 AS (SELECT person_id, list(s ORDER BY i) AS v FROM s2 GROUP BY 1),"
    " m AS (SELECT c2.person_id, p.label, p.person_id AS old, round(list_cosine_similarity(v, cen), 9) AS score FROM c2, cent c JOIN people p USING (person_id) WHERE p.label IS NOT NULL),"
    " b AS (SELECT person_id, arg_max(label, (score, old)) AS label FROM m WHERE score >= 0.363 GROUP BY 1) SELECT person_id, label FROM c2 LEFT JOIN b USING (person_id)",
)
def g5(c):
    """New groups, each of two old ones, take the label of the nearest old one that has any."""
    regrouped = c.faces.withColumn("person_id", F.floor(F.col("person_id") / 2) + 100)
    return P.carry_labels(P.centroids(c.faces).select("person_id", "centroid").join(c.people, "person_id"), P.centroids(regrouped).select("person_id", "centroid"))


@query("g6_merge_people", "SELECT CASE WHEN person_id IN (1, 2) THEN 0 ELSE person_id END AS person_id, count(*) AS faces FROM faces GROUP BY 1")
def g6(c):
    moved, _, _ = P.merge_people(c.faces, c.people, [0, 1, 2], 0)
    return moved.groupBy("person_id").agg(F.count(F.lit(1)).alias("faces"))


_MERGED = "SELECT person_id, label, hidden, (SELECT count(*) FROM faces f WHERE f.person_id = p.person_id) AS faces FROM people p"


@query("g6_undo_merge", _MERGED)
def g6b(c):
    """Two merges, the second into a group that the first had grown, and both undone; merges of nothing in between."""
    faces, people = c.faces, c.people
    faces, people, log = P.merge_people(faces, people, [1, 2], 0)
    faces, people, log = P.merge_people(faces, people, [0, 3, 99], 4, log)
    faces, people, log = P.merge_people(faces, people, [4], 4, log)
    for _ in range(2):
        faces, people, log = P.undo_merge(faces, people, log)
    n = faces.groupBy("person_id").agg(F.count(F.lit(1)).alias("faces"))
    return people.join(n, "person_id", "left").select("person_id", "label", "hidden", F.coalesce("faces", F.lit(0)).alias("faces"))


@query("g7_forget_people", "SELECT 'face' AS part, face_id AS id FROM faces WHERE person_id NOT IN (1, 3) UNION ALL SELECT DISTINCT 'person', person_id FROM people WHERE person_id NOT IN (1, 3)"
       " UNION ALL SELECT DISTINCT 'file', file_id FROM faces WHERE person_id IN (1, 3)")
def g7(c):
    faces, people, files = P.forget_people(c.faces, c.people, c.people.where("person_id in (1, 3)"))
    of = lambda part, df, key: df.select(F.lit(part).alias("part"), F.col(key).alias("id"))
    return of("face", faces, "face_id").unionAll(of("person", people, "person_id")).unionAll(of("file", files, "file_id"))


@query("g7_hide_people", "SELECT person_id, label, CASE WHEN person_id % 3 = 0 THEN NOT hidden ELSE hidden END AS hidden FROM people")
def g7b(c):
    return P.hide_people(c.people, c.people.where("person_id % 3 = 0").withColumn("hidden", ~F.col("hidden")))


@query("g7_rename_people", "SELECT 'person' AS part, person_id AS id, CASE WHEN person_id % 3 = 0 THEN 'New ' || person_id WHEN person_id % 3 <> 1 THEN label END AS label FROM people"
       " UNION ALL SELECT DISTINCT 'file', file_id, NULL FROM faces WHERE person_id % 3 < 2")
def g7c(c):
    new = F.when(F.col("person_id") % 3 == 0, F.concat(F.lit(" New "), F.col("person_id").cast("string"), F.lit(" "))).otherwise(" ")
    people, files = P.rename_people(c.people, c.people.where("person_id % 3 < 2").withColumn("label", new), c.faces)
    none = F.lit(None).cast("string")
    return people.select(F.lit("person").alias("part"), F.col("person_id").alias("id"), "label").unionAll(files.select(F.lit("file"), "file_id", none))


@query("g9_faces_for_file", "SELECT file_id, face_id, a.person_id, label, row_number() OVER (PARTITION BY file_id ORDER BY quality DESC, face_id) AS place FROM faces a LEFT JOIN (SELECT person_id, label FROM people WHERE NOT hidden) p USING (person_id)")
def g9b(c):
    return P.faces_for_file(c.faces, c.people, c.files).withColumn("place", F.col("place").cast("long"))


@query("g9_unnamed_groups", "SELECT p.person_id, count(face_id) AS faces FROM people p LEFT JOIN faces f USING (person_id) WHERE NOT hidden AND p.label IS NULL GROUP BY 1")
def g9c(c):
    return P.unnamed_groups(c.faces, c.people)


@query("g8_people_cards", ", j AS (SELECT a.*, p.label, f.created_at, row_number() OVER (PARTITION BY a.person_id ORDER BY a.quality DESC, face_id) AS rn FROM faces a JOIN people p USING (person_id) JOIN files f USING (file_id) WHERE NOT hidden)"
       " SELECT person_id, label, count(*) AS faces, count(DISTINCT file_id) AS files, epoch(max(created_at))::BIGINT AS last_seen, string_agg(face_id::VARCHAR, ',' ORDER BY rn) FILTER (rn <= 4) AS best FROM j GROUP BY person_id, label")
def g8(c):
    k = P.people_cards(c.faces, c.people, c.files)
    return k.withColumns({"last_seen": F.unix_timestamp("last_seen"), "best": F.array_join(F.transform("best", lambda x: x.cast("string")), ",")})


@query("g9_people_stats", "SELECT count(DISTINCT p.person_id) AS people, count(face_id) AS faces, count(DISTINCT p.person_id) FILTER (p.label IS NULL) AS unnamed, count(DISTINCT file_id) AS photos FROM people p LEFT JOIN faces f USING (person_id) WHERE NOT hidden")
def g9(c):
    return P.people_stats(c.faces, c.people)


@query("g10_people_by_month", ", j AS (SELECT person_id, max(created_at) AS t FROM faces JOIN people p USING (person_id) JOIN files USING (file_id) WHERE NOT hidden GROUP BY 1) SELECT strftime(t, '%Y-%m') AS month, count(*) AS people FROM j GROUP BY 1")
def g10(c):
    return P.people_by_month(P.people_cards(c.faces, c.people, c.files))


# Pictures: pixels by formula from every picture's id, 8 x 6 each


def _pixels(c):
    i, k = F.col("file_id"), F.col("k")
    p = c.files.where("width is not null").select("file_id", F.explode(F.sequence(F.lit(0), F.lit(47))).alias("k"))
    return p.select(i.alias("image_id"), (k % 8).alias("x"), F.floor(k / 8).cast("int").alias("y"), ((i * 37 + k * 11) % 256).cast("int").alias("r"), ((i * 53 + k * 7) % 256).cast("int").alias("g"), ((i * 17 + k * 29) % 256).cast("int").alias("b"))


_PX = ", px AS (SELECT file_id AS image_id, k % 8 AS x, k // 8 AS y, (file_id * 37 + k * 11) % 256 AS r, (file_id * 53 + k * 7) % 256 AS g, (file_id * 17 + k * 29) % 256 AS b FROM files, range(48) t(k) WHERE width IS NOT NULL), lu AS (SELECT *, 0.2126 * r + 0.7152 * g + 0.0722 * b AS l FROM px)"
_TONE = _PX + ", tn AS (SELECT image_id, avg(l) / 255 AS brightness, stddev_pop(l) / 255 AS contrast, avg(CASE WHEN greatest(r, g, b) = 0 THEN 0 ELSE (greatest(r, g, b) - least(r, g, b)) / greatest(r, g, b) END) AS saturation, avg(r - b) / 255 AS shift FROM lu GROUP BY 1)"


@query("p1_tone", _TONE + " SELECT image_id, round(brightness, 6) AS brightness, round(contrast, 6) AS contrast, round(saturation, 6) AS saturation, round(shift, 6) AS shift, CASE WHEN shift > 0.04 THEN 'warm' WHEN shift < -0.04 THEN 'cool' ELSE 'neutral' END AS temperature FROM tn")
def p1(c):
    t = PX.tone(_pixels(c))
    return t.withColumns({k: F.round(k, 6) for k in ("brightness", "contrast", "saturation", "shift")})


@query("p2_sharpness", _PX + ", n AS (SELECT image_id, lag(l) OVER h + lead(l) OVER h + lag(l) OVER v + lead(l) OVER v - 4 * l AS d FROM lu WINDOW h AS (PARTITION BY image_id, y ORDER BY x), v AS (PARTITION BY image_id, x ORDER BY y)) SELECT image_id, round(1 - exp(-var_pop(d) / 600), 6) AS sharpness FROM n GROUP BY 1")
def p2(c):
    return PX.sharpness(_pixels(c)).withColumn("sharpness", F.round("sharpness", 6))


@query("p3_palette")
def p3(c):
    return PX.palette(_pixels(c))


@query("p4_signature")
def p4(c):
    return PX.signature(_pixels(c))


@query("p4_tone_line", _TONE + " SELECT image_id, concat_ws(' · ', CASE WHEN brightness < 0.32 THEN 'Dark' WHEN brightness > 0.62 THEN 'Bright' ELSE 'Evenly lit' END, CASE WHEN contrast > 0.24 THEN 'high contrast' WHEN contrast < 0.1 THEN 'low contrast' ELSE 'soft' END) AS line FROM tn")
def p4b(c):
    return PX.tone_line(PX.tone(_pixels(c)))


@query("p5_shape", "SELECT file_id, round(width / height, 2) AS aspect, CASE WHEN width > height THEN 'landscape' WHEN width < height THEN 'portrait' WHEN width IS NOT NULL THEN 'square' END AS orientation FROM files")
def p5(c):
    return PX.shape(c.files)


@query("p6_pick_still", _TONE + ", r AS (SELECT image_id // 100 AS video_id, image_id, row_number() OVER (PARTITION BY image_id // 100 ORDER BY round(contrast, 9) DESC, image_id) AS rn FROM tn) SELECT video_id, image_id FROM r WHERE rn = 1")
def p6(c):
    t = PX.tone(_pixels(c)).select(F.floor(F.col("image_id") / 100).alias("video_id"), "image_id", F.round("contrast", 9).alias("contrast"))
    return PX.pick_still(t)


@query("d6_colour_share")
def d6(c):
    return PX.colour_share(PX.palette(_pixels(c)))


@query(
    "d5_descriptors",
    _TONE + ", s AS (SELECT f.file_id, brightness, shift, contrast, width / height AS ratio, bytes, lower(description) AS d FROM files f LEFT JOIN tn ON image_id = file_id), k AS ("
    "SELECT file_id, 'dark' AS says, CASE WHEN brightness < 0.32 THEN 1.0 WHEN brightness < 0.42 THEN 0.5 WHEN brightness IS NULL AND contains(d, 'dark') THEN 0.8 END AS c FROM s"
    " UNION ALL SELECT file_id, 'warm', CASE WHEN shift IS NOT NULL THEN least(shift / 0.08, 1) END FROM s UNION ALL SELECT file_id, 'high contrast', CASE WHEN contrast > 0.24 THEN 1 WHEN contrast > 0.16 THEN 0.5 WHEN contrast IS NULL AND contains(d, 'high contrast') THEN 0.8 END FROM s"
    " UNION ALL SELECT file_id, 'tall', CASE WHEN ratio <= 0.62 THEN 1 WHEN ratio <= 0.85 THEN 0.6 END FROM s UNION ALL SELECT file_id, 'small', CASE WHEN bytes < 153600 THEN 1 WHEN bytes < 409600 THEN 0.5 END FROM s)"
    " SELECT file_id, says, round(c, 6)::DOUBLE AS confidence FROM k WHERE c > 0",
)
def d5(c):
    d = PX.descriptors(c.files, PX.signature(_pixels(c)), c.now).where("says in ('dark', 'warm', 'high contrast', 'tall', 'small')")
    return d.withColumn("confidence", F.round("confidence", 6))


# Organise plans


@query("o1_safe_segment", "SELECT file_id, 'a b ' || file_id AS folder FROM files")
def o1(c):
    return c.files.select("file_id", X.safe_segment(F.concat(F.lit("../a/.b: "), F.col("file_id").cast("string"), F.lit(".. "))).alias("folder"))


_PLAN = ", fc AS (SELECT file_id, min(collection_id) AS first FROM file_collections GROUP BY 1), wh AS (SELECT file_id, min(p.label) AS who FROM faces JOIN people p USING (person_id) WHERE NOT hidden AND p.label IS NOT NULL GROUP BY 1 HAVING count(DISTINCT p.label) = 1), plan AS (SELECT f.file_id, bytes, '/out/' || CASE kind WHEN 'audio' THEN 'Audio' WHEN 'design' THEN 'Design' WHEN 'other' THEN 'Other' ELSE upper(kind[1]) || kind[2:] || 's' END || '/' || coalesce(first, who, 'Unfiled') || '/' || name AS target, CASE WHEN index_state = 'missing' OR f.file_id % 23 = 0 THEN 'skipped' ELSE 'move' END AS outcome, CASE WHEN index_state = 'missing' OR f.file_id % 23 = 0 THEN 'not on disk where the index last saw it' END AS reason FROM files f LEFT JOIN fc USING (file_id) LEFT JOIN wh USING (file_id))"


def _plan(c):
    """Every 23rd file isn't in the listing."""
    return O.plan_moves(c.files, c.file_collections, c.faces, c.people, "/out", c.files.where("file_id % 23 <> 0"))


@query("o2_plan_moves", _PLAN + " SELECT file_id, target, outcome, reason FROM plan")
def o2(c):
    return _plan(c).select("file_id", "target", "outcome", "reason")


@query("o3_resolve_collisions", ", p AS (SELECT file_id, '/out/' || (file_id % 50) || '.txt' AS target FROM files), r AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY file_id) + CASE WHEN file_id % 50 = 7 THEN 1 ELSE 0 END AS k FROM p) SELECT file_id, CASE WHEN k = 1 THEN target ELSE replace(target, '.txt', ' (' || k || ').txt') END AS target FROM r")
def o3(c):
    plan = c.files.select("file_id", F.concat(F.lit("/out/"), (F.col("file_id") % 50).cast("string"), F.lit(".txt")).alias("target"))
    return O.resolve_collisions(plan, c.spark.createDataFrame([("/out/7.txt",)], "path string"))


@query("o4_plan_summary", _PLAN + " SELECT count(*) FILTER (outcome = 'move') AS moves, sum(bytes) FILTER (outcome = 'move')::BIGINT AS bytes, count(DISTINCT regexp_extract(target, '^(.*)/[^/]*$', 1)) FILTER (outcome = 'move') AS folders, 0::BIGINT AS settled, count(*) FILTER (outcome = 'skipped') AS skipped FROM plan")
def o4(c):
    return O.plan_summary(_plan(c))


@query("o5_assemble_pages", ", p AS (SELECT conv_id, turn, length(trim(text, ' ')) < 48 AS scanned, trim(CASE WHEN length(trim(text, ' ')) < 48 THEN 'scan ' || text ELSE text END, ' ') AS used FROM conversations WHERE turn < 40) SELECT conv_id AS doc, string_agg(used, chr(10) || chr(10) ORDER BY turn) AS text, round(coalesce(avg(0.5) FILTER (scanned), 0.99), 6)::DOUBLE AS confidence FROM p GROUP BY 1")
def o5(c):
    t = c.table("conversations")
    pages = t.select(F.col("conv_id").alias("doc"), F.col("turn").alias("page"), F.col("text").alias("layer"), F.concat(F.lit("scan "), "text").alias("ocr"), F.lit(0.5).alias("confidence"))
    return O.assemble_pages(pages)


@query("o6_assemble_lines", "SELECT conv_id AS doc, string_agg(text, chr(10) ORDER BY turn) AS text, round(avg(turn), 6) AS confidence FROM conversations GROUP BY 1")
def o6(c):
    lines = c.table("conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("line"), "text", F.col("turn").cast("double").alias("score"))
    return O.assemble_lines(lines).withColumn("confidence", F.round("confidence", 6))
