"""Projection, filter, sort, page and roll-up of the catalog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import written


def filter_files(
    files: DataFrame,
    kinds: list[str] | None = None,
    folder: str | None = None,
    project: str | None = None,
    favorites: bool = False,
    since_days: int | None = None,
    day: str | None = None,
    now: Column | None = None,
    tagged: DataFrame | None = None,
    shown: DataFrame | None = None,
    collected: DataFrame | None = None,
) -> DataFrame:
    """All conditions hold; missing files never pass. `tagged`, `shown` (people) and `collected` are tables of file_id."""
    out = files.where("index_state <> 'missing'")
    if kinds:
        out = out.where(F.col("kind").isin(kinds))
    if folder is not None:
        out = out.where(F.col("folder_id") == folder)
    if project is not None:
        out = out.where(F.col("project_id") == project)
    if favorites:
        out = out.where("favorite")
    if since_days is not None:
        out = out.where(F.col("created_at") >= now - F.make_interval(days=F.lit(since_days)))
    if day is not None:
        start = F.to_timestamp(F.lit(day))
        out = out.where((F.col("created_at") >= start) & (F.col("created_at") < start + F.expr("interval 1 day")))
    for wanted in (tagged, shown, collected):
        if wanted is not None:
            out = out.join(wanted.select("file_id"), "file_id", "left_semi")
    return out


def sort_keys(key: str) -> list[Column]:
    c = F.col
    keys = {
        "recent": [c("created_at").desc()],
        "oldest": [c("created_at")],
        "name": [F.lower("name")],
        "size": [c("bytes").desc()],
        "kind": [c("kind"), c("created_at").desc()],
    }
    return [*keys[key], c("file_id")]


def sort_files(files: DataFrame, key: str = "recent") -> DataFrame:
    return files.orderBy(*sort_keys(key))


def page(files: DataFrame, key: str = "recent", limit: int = 120, offset: int = 0) -> DataFrame:
    """One page, with the total of all rows and whether more follow; limits are held to 1..1000."""
    limit, offset = min(1000, max(1, limit)), max(0, offset)
    total = files.agg(F.count(F.lit(1)).alias("total"))  # one row
    rows = sort_files(files, key).offset(offset).limit(limit)
    return rows.crossJoin(F.broadcast(total)).withColumn("has_more", F.col("total") > offset + limit)


def files_by_ids(files: DataFrame, ids: DataFrame) -> DataFrame:
    return files.join(ids.select("file_id").distinct(), "file_id", "left_semi")


def hydrate(files: DataFrame, file_tags: DataFrame, file_collections: DataFrame) -> DataFrame:
    """Arrays of tags, machine tags and collections; aggregated before the join, so rows don't multiply."""
    tags = file_tags.groupBy("file_id").agg(
        F.sort_array(F.collect_set("tag")).alias("tags"),
        F.sort_array(F.collect_set(F.when(F.col("source") != "user", F.col("tag")))).alias("machine_tags"),
    )
    held = file_collections.groupBy("file_id").agg(F.sort_array(F.collect_set("collection_id")).alias("collections"))
    empty = F.array().cast("array<string>")
    joined = files.join(tags, "file_id", "left").join(held, "file_id", "left")
    return joined.withColumns({c: F.coalesce(c, empty) for c in ("tags", "machine_tags", "collections")})


def resolve_rules(files: DataFrame, file_tags: DataFrame, rules: DataFrame, now: Column) -> DataFrame:
    """(rule_id, file_id) of every smart rule (kinds, tags, days, favorites_only); an empty rule holds every file.

    The rules are a small authored table; the files are read once for all of them.
    """
    named = file_tags.groupBy("file_id").agg(F.collect_set("tag").alias("__tags"))
    rows = files.where("index_state <> 'missing'").join(named, "file_id", "left")
    match = (
        (F.coalesce(F.size("kinds"), F.lit(0)) < 1) | F.array_contains("kinds", F.col("kind"))
    ) & ((F.coalesce(F.size("tags"), F.lit(0)) < 1) | F.coalesce(F.arrays_overlap("tags", "__tags"), F.lit(False)))
    match &= F.col("days").isNull() | (F.col("created_at") >= now - F.make_interval(days=F.col("days")))
    match &= ~F.col("favorites_only") | F.col("favorite")
    return rows.join(F.broadcast(rules), match).select("rule_id", "file_id")


# The built-in smart collections, by kind or by tag.
BUILT_IN_KINDS = {"Screenshots": "screenshot", "Documents": "document", "Videos": "video"}
BUILT_IN_TAGS = {
    "Code": "code react javascript typescript python rust java sql html css shell terminal error dashboard spreadsheet",
    "UI Designs": "ui design dashboard chart logo",
    "Receipts": "receipt invoice ticket",
    "Presentations": "presentation slide",
    "Wallpapers": "wallpaper",
    "People": "person portrait selfie group baby crowd",
    "Games": "game",
    "Meme": "meme",
    "Products": "product",
}


def builtin_collections(existing: DataFrame) -> DataFrame:
    """(rule_id, kinds, tags, days, favorites_only) of the twelve built-in rules whose name, in any case, isn't in
    `existing` (name) yet; they feed `resolve_rules`."""
    rows = [(n, [k], [], None, False) for n, k in BUILT_IN_KINDS.items()] + [(n, [], t.split(), None, False) for n, t in BUILT_IN_TAGS.items()]
    schema = "rule_id string, kinds array<string>, tags array<string>, days int, favorites_only boolean"
    rules = existing.sparkSession.createDataFrame(rows, schema)
    return rules.join(existing.select(F.lower("name").alias("low")).distinct(), F.lower("rule_id") == F.col("low"), "left_anti")


def hero_candidates(files: DataFrame, n: int = 8) -> DataFrame:
    """Landscape photos nearest 1.6:1, else any photo by area, else designs and videos by date."""
    ratio = F.col("width") / F.col("height")
    wide = (F.col("kind") == "photo") & (F.col("width") >= 1200) & (F.col("height") >= 800) & ratio.between(1.15, 2.4)
    tier = F.when(wide, 1).when((F.col("kind") == "photo") & F.col("width").isNotNull(), 2).when(F.col("kind").isin("design", "video"), 3)
    rows = files.where("index_state <> 'missing'").withColumn("tier", tier).where("tier is not null")
    best = rows.agg(F.min("tier").alias("best"))
    rank = F.when(F.col("tier") == 1, F.abs(ratio - 1.6)).when(F.col("tier") == 2, -F.col("width") * F.col("height")).otherwise(
        -F.unix_timestamp("created_at")
    )
    kept = rows.join(F.broadcast(best), F.col("tier") == F.col("best")).withColumn("rank", rank.cast("double"))
    return kept.orderBy("rank", "file_id").limit(n)


def numeric_bounds(op: Column, value: Column, unit: Column) -> tuple[Column, Column]:
    """Bounds of a numeric condition: > as >=, < as <=, = as [x, 1.02 x], none as >=; units are powers of 1024."""
    power = F.when(unit == "kb", 1).when(unit == "mb", 2).when(unit == "gb", 3).when(unit == "tb", 4).otherwise(0)
    x = value * F.pow(F.lit(1024.0), power)
    low = F.when(op.isin("<", "<="), F.lit(None)).otherwise(x)
    high = F.when(op.isin("<", "<="), x).when(op == "=", x * 1.02)
    return low, high


def date_bounds(field: Column, value: Column, now: Column) -> tuple[Column, Column]:
    """Bounds of since (n d/w/m/y), after (from) and before (until), with YYYY, YYYY-MM or YYYY-MM-DD."""
    n = F.regexp_extract(value, r"^(\d+)[dwmy]?$", 1).try_cast("int")
    unit = F.regexp_extract(value, r"^\d+([dwmy])$", 1)
    days = n * F.when(unit == "w", 7).when(unit == "m", 30).when(unit == "y", 365).otherwise(1)
    full = F.when(F.length(value) == 4, F.concat(value, F.lit("-01-01"))).when(F.length(value) == 7, F.concat(value, F.lit("-01"))).otherwise(value)
    moment = F.try_to_timestamp(full, F.lit("yyyy-MM-dd"))
    back = now - F.make_interval(days=days)
    low = F.when(field == "since", back).when(field == "after", F.coalesce(moment, back))
    return low, F.when(field == "before", F.coalesce(moment, back))


# Roll-ups


def totals(files: DataFrame, now: Column) -> DataFrame:
    """Per kind and over all (kind null): files that aren't missing, and those created today."""
    today = F.col("created_at") >= F.date_trunc("day", now)
    return files.where("index_state <> 'missing'").rollup("kind").agg(
        F.count(F.lit(1)).alias("files"), F.count_if(today).alias("new_today")
    )


def storage_stats(files: DataFrame) -> DataFrame:
    here = F.col("index_state") != "missing"
    fine = here & (F.col("index_state") != "failed")
    return files.agg(
        F.coalesce(F.sum(F.when(fine, F.col("bytes"))), F.lit(0)).alias("bytes"),
        F.count_if(fine).alias("files"),
        F.count_if(F.col("index_state") == "pending").alias("pending"),
        F.count_if(F.col("index_state") == "failed").alias("failed"),
    )


def storage_by_kind(files: DataFrame) -> DataFrame:
    return files.where("index_state <> 'missing'").groupBy("kind").agg(F.sum("bytes").alias("bytes"))


def counted(dimension: DataFrame, key: str, files: DataFrame) -> DataFrame:
    """Files and bytes per row of a dimension, zero where it has none."""
    own = files.groupBy(key).agg(F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes"))
    return dimension.join(own, key, "left").withColumns(
        {"files": F.coalesce("files", F.lit(0)), "bytes": F.coalesce("bytes", F.lit(0))}
    )


def folder_stats(folders: DataFrame, files: DataFrame) -> DataFrame:
    """`folders` with the files and bytes of each, zero where it is empty, and `newest_scan`, the last scan of any folder."""
    last = folders.agg(F.max("last_scan_at").alias("newest_scan"))  # one row
    return counted(folders, "folder_id", files).crossJoin(F.broadcast(last))


def tag_counts(file_tags: DataFrame, tags: DataFrame | None = None) -> DataFrame:
    """Files per tag; with `tags` (tag), also zero for those of them that no file has."""
    own = file_tags.groupBy("tag").agg(F.countDistinct("file_id").alias("files"))
    if tags is None:
        return own
    return tags.select("tag").distinct().join(own, "tag", "full_outer").withColumn("files", F.coalesce("files", F.lit(0)))


def top_tags(counts: DataFrame, pinned: list[str], n: int = 12) -> DataFrame:
    return counts.orderBy(F.col("tag").isin(pinned).desc(), F.desc("files"), "tag").limit(n)


def machine_tag_names(file_tags: DataFrame) -> DataFrame:
    return file_tags.where("source <> 'user'").select("tag").distinct()


def collection_cards(members: DataFrame, files: DataFrame, n: int = 4) -> DataFrame:
    """Files, bytes and the n newest files of each collection. `members`: collection_id, file_id."""
    rows = members.join(files.where("index_state <> 'missing'"), "file_id")
    newest = Window.partitionBy("collection_id").orderBy(F.desc("created_at"), "file_id")
    top = (
        rows.withColumn("rn", F.row_number().over(newest))
        .where(F.col("rn") <= n)
        .groupBy("collection_id")
        .agg(F.transform(F.sort_array(F.collect_list(F.struct("rn", "file_id"))), lambda x: x["file_id"]).alias("newest"))
    )
    sums = rows.groupBy("collection_id").agg(F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes"))
    return sums.join(top, "collection_id")


def group_by_day(files: DataFrame, zone: str = "UTC") -> DataFrame:
    day = F.to_date(F.from_utc_timestamp("created_at", zone))
    return files.where("index_state <> 'missing'").groupBy(day.alias("day")).agg(
        F.count(F.lit(1)).alias("files"), F.min("file_id").alias("first_file")
    )


def files_by_day(files: DataFrame, zone: str = "UTC") -> DataFrame:
    """The members of the days: each file with its day and the day's files. Rows, as a day has no bound; sort them by day and
    created_at, newest first, to page through them."""
    day = F.to_date(F.from_utc_timestamp("created_at", zone))
    rows = files.where("index_state <> 'missing'").withColumn("day", day)
    return rows.join(rows.groupBy("day").agg(F.count(F.lit(1)).alias("files")), "day")


def kind_tiles(files: DataFrame) -> DataFrame:
    kinds = ["photo", "screenshot", "document", "video"]
    here = files.where("index_state <> 'missing'")
    return here.agg(*[F.count_if(F.col("kind") == k).alias(k) for k in kinds])


def queue_status(files: DataFrame) -> DataFrame:
    return files.agg(*[F.count_if(F.col("index_state") == s).alias(s) for s in ("pending", "processing", "failed")])


def queue_state(files: DataFrame, finished: DataFrame, paused: bool = False, scanning: bool = False) -> DataFrame:
    """One row: the state (paused before scanning before indexing before idle), the counts, what is done and how much of it a minute.

    `finished`: ts, the moment of each item done in this run; nothing or one moment has no rate.
    """
    done = finished.agg(F.count("ts").alias("done"), (F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))).alias("took"))
    rows = queue_status(files).crossJoin(F.broadcast(done))  # two single rows
    state = F.when(F.lit(paused), "paused").when(F.lit(scanning), "scanning").when(F.col("pending") + F.col("processing") > 0, "indexing").otherwise("idle")
    rate = F.coalesce(F.when(F.col("took") > 0, F.col("done") / (F.col("took") / 1e6) * 60), F.lit(0.0))
    total = F.col("pending") + F.col("processing") + F.col("done")
    return rows.select(state.alias("state"), "pending", "processing", "failed", "done", total.alias("total"), rate.alias("per_minute"))


def throughput(finished: DataFrame, ts: str = "ts", width: str = "1 minute") -> DataFrame:
    """Items finished per window."""
    return finished.groupBy(F.window(ts, width).alias("w")).agg(F.count(F.lit(1)).alias("done"))


def tag_quality_audit(labels: DataFrame, generic: list[str] | None = None, top: int = 10) -> DataFrame:
    """One row on (file_id, labels array): how varied the label sets are, and whether they look unhealthy.

    generic_only: files whose labels are all in `generic`; most_common_set: the most frequent set (of equal ones the first in
    order); top_tags: the `top` most frequent labels with their files. With a column `ms` also mean, median (the upper one) and
    greatest latency, of whole milliseconds.
    """
    keyed = labels.withColumn("key", F.array_join(F.array_sort("labels"), ","))
    sets = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("c"))
    common = sets.agg(F.max("c").alias("most_common"), F.count(F.lit(1)).alias("sets"), F.min_by("key", F.struct(-F.col("c"), "key")).alias("most_common_set"))
    only = F.size(F.array_except("labels", F.array(*map(F.lit, generic or [])).cast("array<string>"))) == 0
    base = keyed.agg(
        F.count(F.lit(1)).alias("files"),
        F.count_if(F.size("labels") == 0).alias("empty"),
        F.avg(F.when(F.size("labels") == 0, 1.0).otherwise(0.0)).alias("empty_share"),
        F.avg(F.size("labels")).alias("mean_labels"),
        F.count_if((F.size("labels") > 0) & only).alias("generic_only"),
    )
    counts = labels.select(F.explode(F.array_distinct("labels")).alias("l")).groupBy("l").agg(F.count(F.lit(1)).alias("c"))
    unique = counts.agg(F.count(F.lit(1)).alias("unique_labels"))
    best = counts.orderBy(F.desc("c"), "l").limit(top).agg(F.sort_array(F.collect_list(F.struct((-F.col("c")).alias("less"), "l"))).alias("t"))
    best = best.select(F.transform("t", lambda x: F.struct(x["l"].alias("tag"), (-x["less"]).alias("files"))).alias("top_tags"))
    out = base.crossJoin(common).crossJoin(unique).crossJoin(best)  # four single rows
    if "ms" in labels.columns:
        each = labels.select(F.round("ms").cast("long").alias("ms")).groupBy("ms").agg(F.count(F.lit(1)).alias("c"))
        before = Window.orderBy("ms").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # a row for each whole millisecond
        placed = each.withColumn("upto", F.sum("c").over(before)).crossJoin(each.agg(F.sum("c").alias("n")))
        half = F.min(F.when(F.col("upto") > F.floor(F.col("n") / 2), F.col("ms")))
        out = out.crossJoin(placed.agg((F.sum(F.col("ms") * F.col("c")) / F.sum("c")).alias("ms_mean"), half.alias("ms_median"), F.max("ms").alias("ms_max")))
    return out.withColumn("distinct_share", F.col("sets") / F.col("files")).withColumn(
        "unhealthy",
        (F.col("most_common") > F.greatest(F.lit(4), F.floor(F.col("files") / 2)))
        | (F.col("empty_share") > 0.34)
        | (F.col("distinct_share") < 0.4),
    )


def archive_snapshot(
    files: DataFrame, folders: DataFrame, file_tags: DataFrame, members: DataFrame, projects: DataFrame, activity: DataFrame, finished: DataFrame, now: Column
) -> dict[str, DataFrame]:
    """The parts of the archive's front page, all from one written version of `files`: folders, totals, storage, kinds, tags,
    collections, projects, activity (30), recent (60) and index."""
    own = written(files.drop("ocr_text"), "snapshot-files")
    return {
        "folders": folder_stats(folders, own),
        "totals": totals(own, now),
        "storage": storage_stats(own),
        "kinds": storage_by_kind(own),
        "tags": tag_counts(file_tags),
        "collections": collection_cards(members, own),
        "projects": counted(projects, "project_id", own),
        "activity": activity.orderBy(F.desc("ts"), F.desc("event_id")).limit(30),
        "recent": own.where("index_state <> 'missing'").orderBy(F.desc("created_at"), "file_id").limit(60),
        "index": queue_state(own, finished),
    }


def selection_stats(files: DataFrame, ids: DataFrame) -> DataFrame:
    return files_by_ids(files, ids).groupBy("kind").agg(F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes"))


def suggest_tags(files: DataFrame, file_tags: DataFrame, top: int = 14, n: int = 4) -> DataFrame:
    """Per file the n most used of the `top` tags that it lacks. The top tags are a table of `top` rows."""
    best = tag_counts(file_tags).orderBy(F.desc("files"), "tag").limit(top).select("tag", "files")
    pairs = files.select("file_id").join(F.broadcast(best))
    lacking = pairs.join(file_tags.select("file_id", "tag"), ["file_id", "tag"], "left_anti")
    rank = F.row_number().over(Window.partitionBy("file_id").orderBy(F.desc("files"), "tag"))
    return lacking.withColumn("rn", rank).where(F.col("rn") <= n).select("file_id", "tag", "rn")
