"""Description search: clauses, field-weighted words, phrases, exclusions, one score per file."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dictionaries as D
from ..functions.text import stem, synonym_table, tokens
from ..shared import written
from .index import SearchIndex, candidates, indexed
from .listing import date_bounds, numeric_bounds
from .pixels import WORDS

# Field weights in order of precedence.
WEIGHTS = {
    "name": 6.0, "title": 4.0, "description": 3.5, "label": 3.0, "context": 2.5, "folder": 2.5, "ocr_text": 2.0, "tags": 3.0,
    "collection": 2.0, "project": 2.0, "ext": 1.0,
}
CLAUSES = ["kind", "type", "is", "tag", "ext", "name", "text", "in", "folder", "collection", "project", "since", "after", "before", "size", "w", "h"]
RESULTS = 200


def _mapped(table: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])


def interpret_descriptions(queries: DataFrame) -> DataFrame:
    """(query_id, grp, clauses array<struct<field, value, negated>>, words, phrases, excluded): one row per OR-group.

    A group holds words, phrases in quotes and clauses; several kinds are one clause that any of them meets. What has a minus counts for all
    groups of a query: kinds and tags as negated clauses, is: too, and words, phrases and the values of other clauses as excluded
    words. A date phrase anywhere gives the first group a since clause (the longest reach of several), unless it has one. Where a query
    says anything but filler, or a date, its stop words, its soft kind words and the words of its date phrases go; other
    kind words are clauses.
    """
    none = F.array().cast("array<string>")
    low = F.lower("raw")
    held = [(low.contains(p), F.array(*map(F.lit, p.split())), d) for p, d in D.DESCRIBED_DAYS.items()]
    pieces = F.regexp_extract_all("raw", F.lit(r'"[^"]*"|\S+'), F.lit(0))
    filler = [*D.DESCRIBED_STOP_WORDS, *D.SOFT_KIND_WORDS, *D.DESCRIBED_DATE_WORDS]
    plain = F.filter("pieces", lambda p: ~p.startswith('"') & ~p.startswith("#") & ~p.contains(":"))
    said = F.exists(plain, lambda p: F.exists(tokens(p, fold=True), lambda w: ~w.isin(filler)))
    pattern = rf"(?i)^-?({'|'.join(CLAUSES)}):(.+)$"
    is_clause = lambda w: w.rlike(pattern) | w.rlike("^-?#.")
    kind_of, kinds = _mapped(D.DESCRIBED_KINDS), list(D.KINDS)
    one_kind = lambda w: F.coalesce(F.try_element_at(kind_of, w), F.when(w.isin(kinds), w))
    struct = lambda f, v, n: F.struct(f.alias("field"), v.alias("value"), F.lit(n).alias("negated"))
    field = lambda w: F.when(w.rlike("^-?#"), "tag").otherwise(F.lower(F.regexp_extract(w, pattern, 1)))
    value = lambda w: F.lower(F.when(w.rlike("^-?#"), F.regexp_replace(w, "^-?#+", "")).otherwise(F.regexp_extract(w, pattern, 2)))
    kindly = lambda w: field(w).isin("kind", "type") | ((field(w) == "is") & ~value(w).rlike("^(fav|star)"))
    kinds_in = lambda w: F.filter(F.transform(F.split(value(w), ","), lambda k: F.coalesce(one_kind(F.trim(k)), F.trim(k))), lambda k: k != "")
    bare = lambda w: F.try_element_at(kind_of, F.lower(w))

    q = queries.select("query_id", "raw", pieces.alias("pieces"), F.greatest(*[F.when(h, d).otherwise(0) for h, _, d in held]).alias("days"),
                       F.flatten(F.array(*[F.when(h, ws).otherwise(none) for h, ws, _ in held])).alias("dated"))
    q = q.withColumn("descriptive", (F.col("days") > 0) | said)
    # what has a minus, over the whole query
    minus = F.filter("pieces", lambda p: p.startswith("-") & (F.length(p) > 1))
    phrased = F.transform(F.regexp_extract_all("raw", F.lit(r'(?:^|\s)-"([^"]+)"'), F.lit(1)), lambda p: tokens(p, fold=True))
    clauses = F.filter("minus", is_clause)
    loose = F.filter("minus", lambda w: ~is_clause(w) & ~w.startswith('-"'))
    body = lambda w: F.substring(w, F.lit(2), F.length(w))
    gone_kinds = F.concat(F.flatten(F.transform(F.filter(clauses, kindly), kinds_in)), F.filter(F.transform(loose, lambda w: bare(body(w))), lambda k: k.isNotNull()))
    others = F.filter(clauses, lambda w: ~kindly(w) & ~field(w).isin("tag", "is"))
    q = q.withColumn("minus", minus).withColumns(
        {
            "out": F.concat(
                F.transform(F.array_distinct(gone_kinds), lambda k: struct(F.lit("kind"), k, True)),
                F.transform(F.filter(clauses, lambda w: ~kindly(w) & field(w).isin("tag", "is")), lambda w: struct(field(w), value(w), True)),
            ),
            "excluded": F.concat(
                F.flatten(F.transform(F.filter(loose, lambda w: bare(body(w)).isNull()), lambda w: tokens(body(w), fold=True))),
                F.flatten(F.transform(others, lambda w: tokens(value(w), fold=True))), F.flatten(phrased),
            ),
        }
    )
    groups = q.select("*", F.posexplode(F.split("raw", r"(?:^|\s)(?:OR|or|\|)(?:\s|$)")).alias("grp", "part")).where(F.trim("part") != "")
    phrases = F.transform(F.regexp_extract_all("part", F.lit(r'(?:^|\s)"([^"]+)"'), F.lit(1)), lambda p: F.array_join(tokens(p, fold=True), " "))
    items = F.filter(F.split(F.trim(F.regexp_replace("part", '-?"[^"]*"', " ")), r"\s+"), lambda w: (w != "") & ~(w.startswith("-") & (F.length(w) > 1)))
    rows = groups.withColumns({"phrases": F.filter(phrases, lambda p: p != ""), "items": items})
    free = F.filter("items", lambda w: ~is_clause(w) & ~(F.col("descriptive") & F.lower(w).isin(D.SOFT_KIND_WORDS)))
    rows = rows.withColumns({"own": F.filter("items", is_clause), "free": free})
    filled = lambda w: F.col("descriptive") & (w.isin(D.DESCRIBED_STOP_WORDS) | F.array_contains("dated", w))
    words = F.flatten(F.transform(F.filter("free", lambda w: bare(w).isNull()), lambda w: F.filter(tokens(w, fold=True), lambda t: ~filled(t))))
    named = F.concat(F.flatten(F.transform(F.filter("own", kindly), kinds_in)), F.filter(F.transform("free", bare), lambda k: k.isNotNull()))
    rows = rows.withColumns({"words": F.array_distinct(words), "kinds": F.array_distinct(named)})
    rest = F.transform(F.filter("own", lambda w: ~kindly(w)), lambda w: struct(field(w), value(w), False))
    empty = F.slice(F.array(struct(F.lit("kind"), F.lit(""), False)), 1, 0)
    anyof = F.when(F.size("kinds") > 0, F.array(struct(F.lit("kind"), F.array_join("kinds", ","), False))).otherwise(empty)
    dated = (F.col("days") > 0) & (F.col("grp") == 0) & ~F.exists("rest", lambda c: c["field"] == "since")
    since = F.when(dated, F.array(struct(F.lit("since"), F.concat(F.col("days").cast("string"), F.lit("d")), False))).otherwise(empty)
    rows = rows.withColumn("rest", rest).withColumn("clauses", F.concat(anyof, "rest", since, "out"))
    some = (F.size("words") > 0) | (F.size("phrases") > 0) | (F.size("clauses") > 0) | (F.size("excluded") > 0)
    return rows.where(some).select("query_id", "grp", "clauses", "words", "phrases", "excluded")


def _size_bounds(value: Column) -> tuple[Column, Column]:
    """Bounds of a size, w or h clause; both null if it says nothing."""
    size = r"^(>=|<=|>|<|=)?\s*(\d+(?:\.\d+)?)\s*(b|kb|mb|gb|tb)?$"
    part = lambda k: F.regexp_extract(value, size, k)
    return numeric_bounds(part(1), part(2).try_cast("double"), part(3))


def _meets(x: Column, now: Column) -> Column:
    """Whether a file meets a clause, its negation left aside."""
    f, v = x["field"], x["value"]
    since, until = date_bounds(f, v, now)
    begins = lambda c: F.exists(F.coalesce(c, F.array().cast("array<string>")), lambda t: F.lower(t).startswith(v))

    def held(measured: str) -> Column:
        low, high = _size_bounds(v)
        m = F.coalesce(measured, F.lit(0))
        return (low.isNull() | (m >= low)) & (high.isNull() | (m <= high)) & (low.isNotNull() | high.isNotNull())

    return (
        F.when(f.isin("kind", "type"), F.array_contains(F.split(v, ","), F.col("kind")))
        .when(f == "is", F.when(v.rlike("^(fav|star)"), F.col("favorite")).otherwise(F.col("kind") == v))
        .when(f == "tag", begins("tags"))
        .when(f == "collection", begins("collections"))
        .when(f == "ext", F.col("ext") == v)
        .when(f == "name", F.lower("name").contains(v))
        .when(f == "text", F.lower(F.concat_ws(" ", "ocr_text", "description", "title", "name")).contains(v))
        .when(f.isin("in", "folder"), F.lower("folder_path").contains(v))
        .when(f == "project", F.lower("project_id").startswith(v))
        .when(f.isin("since", "after"), F.col("created_at") >= since)
        .when(f == "before", F.col("created_at") < until)
        .when(f == "size", held("bytes"))
        .when(f == "w", held("width"))
        .otherwise(held("height"))
    )


def clauses_hold(now: Column) -> Column:
    """Whether a file meets all of `clauses` that aren't negated and none of those that are."""
    return F.forall("clauses", lambda x: F.coalesce(_meets(x, now), F.lit(False)) != x["negated"])


#: Buckets of a measured range, a power of two; an interval is covered by 2 log2(BUCKETS) runs of buckets at most.
BUCKETS = 1024
_LEVELS = BUCKETS.bit_length()


def bucket_runs(low: Column, high: Column) -> Column:
    """The runs (level, node) that cover the buckets low..high, none twice: run (k, n) holds buckets n * 2^k to (n + 1) * 2^k - 1."""
    none = "cast(array() as array<struct<level: int, node: int>>)"
    start = F.struct(low.cast("int").alias("l"), (high + 1).cast("int").alias("r"), F.expr(none).alias("runs"))

    def step(s: Column, k: Column) -> Column:
        run = lambda n: F.array(F.struct(k.cast("int").alias("level"), n.cast("int").alias("node")))
        left = (s["l"] < s["r"]) & (s["l"] % 2 == 1)
        l2 = s["l"] + F.when(left, 1).otherwise(0)
        right = (l2 < s["r"]) & (s["r"] % 2 == 1)
        r2 = s["r"] - F.when(right, 1).otherwise(0)
        runs = F.concat(s["runs"], F.when(left, run(s["l"])).otherwise(F.expr(none)), F.when(right, run(r2)).otherwise(F.expr(none)))
        return F.struct(F.shiftright(l2, 1).cast("int").alias("l"), F.shiftright(r2, 1).cast("int").alias("r"), runs.alias("runs"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(_LEVELS - 1)), start, step, lambda s: s["runs"])


def interval_join(asked: DataFrame, points: DataFrame) -> DataFrame:
    """(measure, low, high, ...) beside (measure, x, file_id) with low <= x <= high, null bounds open: by equal runs of buckets.

    A measure's range is cut into `BUCKETS`; a point lies in one run a level, an interval in a few runs of any level.
    """
    spans = points.groupBy("measure").agg(F.min("x").alias("least"), F.max("x").alias("most"))  # a row for each measure
    spans = F.broadcast(spans)
    width = F.greatest((F.col("most") - F.col("least")) / BUCKETS, F.lit(1e-9))
    bucket = lambda x: F.least(F.greatest(F.floor((x - F.col("least")) / width), F.lit(0)), F.lit(BUCKETS - 1)).cast("int")
    levels = F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(_LEVELS - 1)), lambda k: F.call_function("shiftright", bucket(F.col("x")), k)))
    there = points.join(spans, "measure").select("measure", "x", "file_id", levels.alias("level", "node"))
    runs = bucket_runs(bucket(F.coalesce("low", "least")), bucket(F.coalesce("high", "most")))
    wide = asked.join(spans, "measure").where("coalesce(low, least) <= coalesce(high, most)").select(*asked.columns, F.inline(runs))
    fits = (F.col("low").isNull() | (F.col("x") >= F.col("low"))) & (F.col("high").isNull() | (F.col("x") <= F.col("high")))
    return wide.join(there, ["measure", "level", "node"]).where(fits).drop("level", "node")


# How well a clause narrows the files down, best first; the first that a group has leads its search.
_LEADS = ["tag", "collection", "project", "ext", "name", "folder", "text", "interval", "kind", "favorite", "any"]


def hard_clauses(groups: DataFrame, files: DataFrame, now: Column, index: SearchIndex | None = None) -> DataFrame:
    """(query_id, grp, file_id) of files that meet every clause and none of the negated ones.

    Each group is led by its most telling clause: a kind, ext or flag by equality, a tag, collection or project by the names that begin
    so, a part of a name, folder or text by its rarest trigram (given an index), a size or date by an interval join. Files that the
    lead finds are held against all clauses. Groups that nothing leads meet the files by kind. Needs tags and
    collections as arrays.
    """
    key = ["query_id", "grp"]
    asked = written(groups.select(*key, "clauses"), "clauses-asked")
    one = asked.select(*key, F.inline("clauses")).where("not negated").select(*key, F.col("field").alias("f"), F.col("value").alias("v"))
    flag = F.col("v").rlike("^(fav|star)")
    part = F.lit(index is not None) & (F.length("v") >= 3)
    run = F.array_sort(F.split("v", r"[^\p{L}\p{N}]+"), lambda a, b: F.length(b) - F.length(a))[0]
    lead = (
        F.when(F.col("f").isin("tag", "collection", "project", "ext"), F.col("f"))
        .when(F.col("f").isin("name", "in", "folder") & part, F.when(F.col("f") == "name", "name").otherwise("folder"))
        .when((F.col("f") == "text") & part & (F.length(run) >= 3), "text")
        .when(F.col("f").isin("size", "w", "h", "since", "after", "before"), "interval")
        .when(F.col("f").isin("kind", "type"), "kind")
        .when(F.col("f") == "is", F.when(flag, "favorite").otherwise("kind"))
        .otherwise("any")
    )
    rank = F.array_position(F.array(*map(F.lit, _LEADS)), F.col("lead"))
    said = one.withColumns({"lead": lead, "run": run}).groupBy(*key).agg(F.min_by(F.struct("lead", "f", "v", "run"), F.struct(rank, "f", "v")).alias("c"))
    led = asked.select(*key).join(said, key, "left").select(*key, F.coalesce("c.lead", F.lit("any")).alias("lead"), "c.f", "c.v", "c.run")
    led = written(led, "clauses-led")
    of = lambda *leads: led.where(F.col("lead").isin(*leads))

    def beginning(lead: str, members: DataFrame) -> DataFrame:
        """Groups beside the files of the names (name, file_id) that begin with their value."""
        wanted = of(lead).select(*key, "v", F.length("v").alias("n"))
        lengths = wanted.select("n").distinct()  # as many rows as values have lengths
        names = members.select("name").distinct().join(F.broadcast(lengths), F.length("name") >= F.col("n"))
        return wanted.join(names.withColumn("v", F.expr("substring(name, 1, n)")), ["v", "n"]).join(members, "name").select(*key, "file_id")

    kinds = F.explode(F.when(F.col("lead") == "any", F.array(*map(F.lit, D.KINDS))).otherwise(F.split("v", ",")))
    by_kind = of("kind", "any").select(*key, kinds.alias("kind")).distinct()
    tagged = lambda column: files.select(F.explode(column).alias("name"), "file_id").withColumn("name", F.lower("name")).distinct()
    measures = {"size": F.coalesce("bytes", F.lit(0)), "w": F.coalesce("width", F.lit(0)), "h": F.coalesce("height", F.lit(0)), "created": F.unix_micros("created_at")}
    points = files.select("file_id", F.inline(F.array(*[F.struct(F.lit(m).alias("measure"), x.cast("double").alias("x")) for m, x in measures.items()])))
    low, high = _size_bounds(F.col("v"))
    since, until = date_bounds(F.col("f"), F.col("v"), now)
    sized = F.col("f").isin(*measures)
    bounds = of("interval").select(
        *key, F.when(sized, F.col("f")).otherwise("created").alias("measure"),
        F.when(sized, low).otherwise(F.unix_micros(since).cast("double")).alias("low"), F.when(sized, high).otherwise(F.unix_micros(until).cast("double")).alias("high"),
    )
    there = {r["lead"] for r in led.select("lead").distinct().collect()}  # eleven at most
    found = [led.withColumn("file_id", F.lit(None).cast(files.schema["file_id"].dataType)).where("false").select(*key, "file_id")]
    if there & {"kind", "any"}:
        found.append(by_kind.join(files.select("kind", "file_id"), "kind").select(*key, "file_id"))
    if "ext" in there:
        found.append(of("ext").join(files.select(F.col("ext").alias("v"), "file_id"), "v").select(*key, "file_id"))
    if "favorite" in there:
        found.append(of("favorite").withColumn("favorite", F.lit(True)).join(files.select("favorite", "file_id"), "favorite").select(*key, "file_id"))
    if "tag" in there:
        found.append(beginning("tag", tagged("tags")))
    if "collection" in there:
        found.append(beginning("collection", tagged("collections")))
    if "project" in there:
        found.append(beginning("project", files.where("project_id is not null").select(F.lower("project_id").alias("name"), "file_id")))
    if "interval" in there:
        found.append(interval_join(bounds.where("low is not null or high is not null"), points.where("x is not null")).select(*key, "file_id"))
    if there & {"name", "folder"}:
        found.append(candidates(of("name", "folder").select(*key, "v"), "v", index.short_grams).select(*key, "file_id"))
    if "text" in there:
        words = candidates(of("text").select(*key, "run"), "run", index.word_grams).where("contains(word, run)")
        words = words.join(index.words.select("word", "parts"), "word").select(*key, "word", "parts")
        found.append(index.at(words, ["name", "title", "description", "ocr_text"]).select(*key, "file_id"))
    near = reduce(DataFrame.unionAll, found).distinct().join(asked, key)
    return files.join(near, "file_id").where(clauses_hold(now)).select(*key, "file_id")


#: What a match is worth by its kind: the word itself, its stem, the beginning of a stem, another name, a part of a stem.
WORTH = [2.0, 1.9, 1.0, 1.4, 0.4]


def field_word_score(groups: DataFrame, docs: DataFrame | SearchIndex) -> DataFrame:
    """(query_id, grp, word, file_id, score, field): the best field of each word and file.

    In a field the first kind of match of `WORTH` counts, names and parts for words of three letters or more. Words meet the vocabulary
    by equal term and stem, by the beginning of the stem cut to their length, by the names of a family, and by the
    rarest trigram; only then files are read, by equal word.
    """
    index = indexed(docs)
    wanted = groups.select("query_id", "grp", F.explode("words").alias("word")).distinct()
    asked = wanted.select("word").distinct().select(F.col("word").alias("asked"), stem(F.col("word")).alias("base"))
    asked = written(asked, "describe-asked")
    words = index.words.select("word", "parts", "term", "term_stem")
    kinds = F.when(F.col("asked") == F.col("term"), 0).when(F.col("base") == F.col("term_stem"), 1).otherwise(2)
    found = index.beginning(asked, "base", "term_stem").select("asked", "word", "parts", kinds.alias("k"))
    long = asked.where("length(base) >= 3")
    names = long.join(synonym_table(words.sparkSession), "base").select("asked", stem(F.col("name")).alias("term_stem"))
    other = names.join(words, "term_stem").select("asked", "word", "parts", F.lit(3).alias("k"))
    within = candidates(long, "base", index.stem_grams).where("contains(held, base)").select("asked", F.col("held").alias("term_stem"))
    part = within.join(words, "term_stem").select("asked", "word", "parts", F.lit(4).alias("k"))
    best = found.unionAll(other).unionAll(part).groupBy("asked", "word", "parts").agg(F.min("k").alias("k"))
    at = index.at(best, list(WEIGHTS)).groupBy("asked", "file_id", "field").agg(F.min("k").alias("k"))
    table = lambda pairs: F.create_map(*[F.lit(x) for p in pairs for x in p])
    weight, place = table(WEIGHTS.items())[F.col("field")], table((f, i) for i, f in enumerate(WEIGHTS))[F.col("field")]
    at = at.withColumns({"score": weight * F.element_at(F.array(*map(F.lit, WORTH)), F.col("k") + 1), "ord": place})
    fields = at.groupBy("asked", "file_id").agg(F.max("score").alias("score"), F.max_by("field", F.struct("score", -F.col("ord"))).alias("field"))
    return wanted.join(fields, F.col("word") == F.col("asked")).select("query_id", "grp", "word", "file_id", "score", "field")


def ordered_phrase(groups: DataFrame, docs: DataFrame | SearchIndex) -> DataFrame:
    """(query_id, grp, file_id, found) for groups with phrases: each stands, in order, within one field.

    The rarest word of a phrase names the places where it may begin. The other words are read once each, whatever the number of phrases, and meet
    those places only, by word, file and field.
    """
    index = indexed(docs)
    asked = groups.where(F.size("phrases") > 0).select("query_id", "grp", F.size("phrases").alias("all"), F.posexplode("phrases").alias("phrase", "said"))
    terms = asked.select("query_id", "grp", "all", "phrase", F.split("said", " ").alias("terms"))
    terms = terms.withColumn("n", F.size("terms")).select("*", F.posexplode("terms").alias("i", "term")).drop("terms")
    known = terms.select("term").distinct().join(index.words.select("word", "parts", "term", "files"), "term")
    known = written(known, "phrase-words")
    key = ["query_id", "grp", "all", "phrase"]
    rated = terms.join(known.groupBy("term").agg(F.sum("files").alias("files")), "term").groupBy(*key, "n").agg(
        F.min_by(F.struct("i", "term"), F.struct("files", "i")).alias("lead"), F.count(F.lit(1)).alias("k")
    )
    leads = written(rated.where("k = n").select(*key, "n", "lead.i", "lead.term"), "phrase-leads")  # every word of theirs is known
    begins = F.explode(F.transform("places", lambda p: p - F.col("i"))).alias("begin")
    first = leads.join(known.drop("files"), "term").drop("term")
    first = written(index.at(first, list(WEIGHTS)).select(*key, "n", F.col("i").alias("lead"), "file_id", "field", begins), "phrase-begins")
    rest = first.join(terms.drop("n"), key).where("i <> lead").select(*key, "n", "file_id", "field", "begin", "i", "term")
    there = index.at(known.drop("files"), list(WEIGHTS)).select("term", "file_id", "field", "places")
    also = rest.join(there, ["term", "file_id", "field"]).where("array_contains(places, begin + i)").select(*key, "n", "file_id", "field", "begin", "i")
    whole = also.groupBy(*key, "n", "file_id", "field", "begin").agg(F.count_distinct("i").alias("k")).where("k = n - 1")
    met = first.where("n = 1").select(*key, "file_id").unionByName(whole.select(*key, "file_id"))
    held = met.groupBy("query_id", "grp", "all", "file_id").agg(F.count_distinct("phrase").alias("k")).where("k = all")
    return held.select("query_id", "grp", "file_id", F.col("all").alias("found"))


def exclusions(found: DataFrame, groups: DataFrame, docs: DataFrame | SearchIndex, claims: DataFrame | None = None) -> DataFrame:
    """`found` without files that an excluded word matches, in any field and by any kind of match, or that a measurement
    says it of. `claims`: of descriptors()."""
    minus = written(groups.where(F.size("excluded") > 0).select("query_id", "grp", F.col("excluded").alias("words")), "describe-excluded")
    key = ["query_id", "grp", "file_id"]
    if minus.isEmpty():
        return found
    gone = field_word_score(minus, docs).select(*key)
    if claims is not None:
        gone = gone.unionByName(measured_words(minus, claims).select(*key))
    return found.join(gone.distinct(), key, "left_anti")


def measured_words(groups: DataFrame, claims: DataFrame) -> DataFrame:
    """(query_id, grp, word, file_id, says, confidence): words that a measurement answers. `claims`: of descriptors(), which
    aren't worked out where no word asks for one."""
    spark = groups.sparkSession
    meaning = spark.createDataFrame([(w, says) for says, ws in WORDS.items() for w in ws.split()], "word string, says string")
    asked = written(groups.select("query_id", "grp", F.explode("words").alias("word")).join(F.broadcast(meaning), "word"), "describe-measured")
    if asked.isEmpty():
        claims = claims.where("false")
    return asked.join(claims, "says").select("query_id", "grp", "word", "file_id", "says", "confidence")


def adjacent_pairs(groups: DataFrame, docs: DataFrame | SearchIndex, hits: DataFrame) -> DataFrame:
    """(query_id, grp, file_id, pairs): neighbouring words of a group, both found, whose stems stand side by side in a field."""
    index = indexed(docs)
    key = ["query_id", "grp"]
    asked = groups.where(F.size("words") > 1).select(*key, F.posexplode("words").alias("i", "said"))
    words = asked.withColumn("term_stem", stem(F.col("said"))).join(index.words.select("word", "parts", "term_stem"), "term_stem")
    at = index.at(words.select(*key, "i", "said", "word", "parts"), list(WEIGHTS))
    told = hits.select(*key, "file_id", F.col("word").alias("said")).distinct()
    at = at.join(told, [*key, "file_id", "said"], "left_semi")
    fields = at.groupBy(*key, "file_id", "field", "i").agg(F.flatten(F.collect_list("places")).alias("at"))
    files = fields.groupBy(*key, "file_id", "field").agg(F.map_from_entries(F.collect_list(F.struct("i", "at"))).alias("held"))
    beside = lambda i: F.arrays_overlap(F.transform(F.try_element_at("held", i), lambda p: p + 1), F.try_element_at("held", i + 1))
    pairs = files.select(*key, "file_id", F.explode(F.filter(F.map_keys("held"), beside)).alias("i"))
    return pairs.groupBy(*key, "file_id").agg(F.count_distinct("i").alias("pairs"))


def describe_search(
    queries: DataFrame, files: DataFrame, docs: DataFrame | SearchIndex, now: Column, claims: DataFrame | None = None, top: int = RESULTS
) -> DataFrame:
    """(query_id, file_id, score, reasons, place): the best OR-group of each file, newest first among equals.

    A group's score: its words by their best field, 5 a phrase, 2.4 a measured claim by its confidence, 5 by the share of
    two or more words found, 1.2 an adjacent pair; times 1 + 0.15 for each facet after the first; and up to 0.6 for being new.
    A group of clauses alone scores 1; one whose words find nothing is no answer.
    """
    key = ["query_id", "grp", "file_id"]
    none = F.array().cast("array<string>")
    index = indexed(docs)
    groups = written(interpret_descriptions(queries), "describe-groups")
    words = written(field_word_score(groups, index), "describe-words")
    parts = words.select(*key, "word", "score", F.lit(1).alias("facets"), F.when(F.col("field").isin("description", "label"), F.col("word")).alias("reason"))
    if claims is not None:
        said = written(measured_words(groups, claims), "describe-said")
        parts = parts.unionByName(said.select(*key, "word", (2.4 * F.col("confidence")).alias("score"), F.lit(1).alias("facets"), F.col("says").alias("reason")))
    sums = parts.groupBy(*key).agg(F.sum("score").alias("s"), F.sum("facets").alias("facets"), F.countDistinct("word").alias("hit"), F.sort_array(F.collect_set("reason")).alias("reasons"))
    sizes = groups.select("query_id", "grp", F.size("words").alias("n"), F.size("phrases").alias("np"), F.size("clauses").alias("nc"))
    base = sums.join(ordered_phrase(groups, index), key, "full_outer").join(sizes, ["query_id", "grp"]).join(adjacent_pairs(groups, index, parts), key, "left")
    base = base.where((F.col("np") == 0) | F.col("found").isNotNull())
    asked = groups.where(F.size("clauses") > 0).select("query_id", "grp", "clauses")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    facets = zero("facets") + zero("found")
    plus = F.when(F.col("n") >= 2, 5.0 * zero("hit") / F.col("n")).otherwise(0.0)
    raw = F.coalesce("s", F.lit(0.0)) + 5.0 * zero("found") + plus + 1.2 * zero("pairs")
    score = raw * (1 + 0.15 * F.greatest(facets - 1, F.lit(0)))
    scored = written(base.select(*key, "nc", score.alias("score"), F.coalesce("reasons", none).alias("reasons")), "describe-scored")
    bound = scored.where("nc > 0").join(asked, ["query_id", "grp"]).join(files, "file_id").where(clauses_hold(now))
    free = scored.where("nc = 0").join(files.select("file_id"), "file_id", "left_semi")
    scored = bound.select(*key, "score", "reasons").unionByName(free.drop("nc"))
    alone = groups.where((F.size("words") == 0) & (F.size("phrases") == 0)).select("query_id", "grp", "clauses")
    plain = hard_clauses(alone, files, now, index).select(*key, F.lit(1.0).alias("score"), none.alias("reasons"))
    every = exclusions(scored.unionByName(plain), groups, index, claims).join(files.select("file_id", "created_at"), "file_id")
    fresh = F.greatest(F.lit(0.0), 0.6 - (F.unix_timestamp(now) - F.unix_timestamp("created_at")) / (4 * 365.0 * 86400))
    final = every.withColumn("score", F.round(F.col("score") + fresh, 6))
    best = final.groupBy("query_id", "file_id").agg(F.max("score").alias("score"), F.max_by("reasons", F.struct("score", -F.col("grp"))).alias("reasons"), F.max("created_at").alias("created_at"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("created_at"), "file_id"))
    return best.withColumn("place", place).where(F.col("place") <= top).select("query_id", "file_id", "score", "reasons", "place")
