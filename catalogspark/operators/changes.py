"""Change detection and upkeep of the catalog, as joins of snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import extension
from .labels import replace_machine_tags

ATTEMPTS = 3


def diff_scan(known: DataFrame, observed: DataFrame) -> DataFrame:
    """(folder_id, path, file_id, change): added, changed, unchanged, missing or returned; changed keeps its id.

    Both sides: folder_id, path, hash; known also file_id and index_state.
    """
    k = known.select("folder_id", "path", "file_id", F.col("hash").alias("old_hash"), "index_state")
    o = observed.select("folder_id", "path", F.col("hash").alias("new_hash"), F.lit(True).alias("seen"))
    change = (
        F.when(F.col("file_id").isNull(), "added")
        .when(F.col("seen").isNull(), "missing")
        .when(F.col("index_state") == "missing", "returned")
        .when(F.col("old_hash") != F.col("new_hash"), "changed")
        .otherwise("unchanged")
    )
    return k.join(o, ["folder_id", "path"], "full_outer").withColumn("change", change)


#: What a scan says of a file, and what a known file takes over from it.
SCANNED = ["name", "ext", "kind", "bytes", "folder_path", "modified_at", "hash"]


def apply_scan(files: DataFrame, diff: DataFrame, observed: DataFrame, now: Column) -> DataFrame:
    """The files after a scan, one row per known or added file.

    `observed`: folder_id, path, `SCANNED`, created_at, supported; `diff`: of both. Known files take the scan's
    metadata and keep id, created_at and all else; one whose hash moved remembers the time it had (a time not yet
    captured stays). Indexed and unsupported files of equal hash keep their states, others start again. indexed_at is
    when a file was added, seen_at when a scan last met it.
    """
    key = ["folder_id", "path"]
    new = observed.select(*key, *[F.col(x).alias(f"__{x}") for x in [*SCANNED, "created_at", "supported"]], F.lit(True).alias("__seen"))
    kept = {"previous_modified_at": "timestamp", "indexed_at": "timestamp", "seen_at": "timestamp", "ocr_state": "string"}
    known = files.withColumns({c: F.lit(None).cast(kind) for c, kind in kept.items() if c not in files.columns})
    rows = known.join(diff.select(*key, "change"), key, "full_outer").join(new, key, "left")
    seen, old = F.col("__seen").isNotNull(), F.col("file_id").isNotNull()
    moved = old & seen & ~F.col("hash").eqNullSafe(F.col("__hash"))
    settled = old & ~moved & F.col("index_state").isin("indexed", "unsupported")
    fresh = F.when(F.col("__supported"), "pending").otherwise("unsupported")
    unread = F.when(F.col("__supported"), "pending").otherwise("none")
    after = {x: F.when(seen, F.col(f"__{x}")).otherwise(F.col(x)) for x in SCANNED}
    after |= {
        "file_id": F.coalesce("file_id", F.xxhash64(*key)),
        "created_at": F.coalesce("created_at", "__created_at"),
        "previous_modified_at": F.when(moved, F.col("modified_at")).otherwise(F.col("previous_modified_at")),
        "index_state": F.when(F.col("change") == "missing", "missing").when(~seen | settled, F.col("index_state")).otherwise(fresh),
        "ocr_state": F.when(~seen | settled, F.col("ocr_state")).otherwise(unread),
        "indexed_at": F.when(old, F.col("indexed_at")).otherwise(now),
        "seen_at": F.when(seen, now).otherwise(F.col("seen_at")),
    }
    return rows.select(*[after.get(x, F.col(x)).alias(x) for x in known.columns], "change")


def mark_missing(files: DataFrame, seen: DataFrame, folders: DataFrame | None = None) -> DataFrame:
    """Files of which `seen` (path) has nothing; with `folders` (folder_id) only those of the folders that were scanned."""
    own = files if folders is None else files.join(folders.select("folder_id").distinct(), "folder_id", "left_semi")
    return own.join(seen.select("path"), "path", "left_anti")


def scan_summary(diff: DataFrame, observed: DataFrame | None = None) -> DataFrame:
    """Per folder the paths by change, and all that were met; with `observed` (supported) also new or changed ones that can't be read."""
    counts = [F.count_if(F.col("change") == s).alias(s) for s in ("added", "changed", "unchanged", "missing", "returned")]
    counts.append(F.count_if(F.col("change") != "missing").alias("discovered"))
    if observed is not None:
        diff = diff.join(observed.select("folder_id", "path", "supported"), ["folder_id", "path"], "left")
        counts.append(F.count_if(~F.col("change").isin("missing", "unchanged") & ~F.col("supported")).alias("unsupported"))
    return diff.groupBy("folder_id").agg(*counts)


def scan_queue(diff: DataFrame, observed: DataFrame) -> DataFrame:
    """(folder_id, path, file_id, kind): what a scan leaves to be read, the added, changed and returned paths of a supported kind. Added
    ones have the id that `apply_scan` gives them."""
    open_ = diff.where(F.col("change").isin("added", "changed", "returned")).select("folder_id", "path", "file_id")
    rows = open_.join(observed.where("supported").select("folder_id", "path", "kind"), ["folder_id", "path"])
    return rows.withColumn("file_id", F.coalesce("file_id", F.xxhash64("folder_id", "path")))


def work_backlog(files: DataFrame, stage: str, previews: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """What is left to do: analysis (oldest first), faces (newest first), interrupted, failed; the first `limit` of it, where given,
    which spares the sort of all.

    Analysis takes what isn't analysed and under the attempts' cap, and, given `previews` (file_id), also every file of a
    visible kind without one, whatever its state.
    """
    if stage == "analysis":
        open_ = ~F.col("analysis_state").isin("analysed", "described") & (F.col("attempts") < ATTEMPTS)
        if previews is not None:
            shown = previews.select("file_id", F.lit(True).alias("__shown")).distinct()
            files = files.join(shown, "file_id", "left")
            visible = F.col("kind").isin("photo", "screenshot", "video", "document", "design")
            open_ = F.coalesce(open_, F.lit(False)) | (F.col("__shown").isNull() & visible)
        rows = files.where((F.col("index_state") == "indexed") & open_).drop("__shown").orderBy("created_at", "file_id")
    elif stage == "faces":
        kinds = F.col("kind").isin("photo", "screenshot", "video")
        open_ = (F.col("index_state") == "indexed") & kinds & (F.col("faces_state") != "scanned")
        rows = files.where(open_).orderBy(F.desc("created_at"), "file_id")
    else:
        states = ["pending", "processing"] if stage == "interrupted" else ["failed"]
        rows = files.where(F.col("index_state").isin(states)).orderBy("file_id")
    return rows if limit is None else rows.limit(limit)


def requeue(files: DataFrame, reason: str) -> DataFrame:
    """Bulk state resets: retry_failed, undescribed (a user's wish), models_arrived, clear_failures.

    models_arrived also needs labels (array) and embedding_state.
    """
    indexed, state = F.col("index_state") == "indexed", F.col("analysis_state")
    kinds = F.col("kind").isin("photo", "screenshot", "design", "document", "video")
    if reason == "clear_failures":
        return files.withColumn("index_state", F.when(F.col("index_state") == "failed", "pending").otherwise(F.col("index_state")))
    if reason == "undescribed":
        plain = ~F.coalesce(F.col("engine").startswith("ollama:"), F.lit(False))
        again = (state == "analysed") & indexed & kinds & plain
        return files.withColumn("analysis_state", F.when(again, "none").otherwise(state))
    if reason == "retry_failed":
        again = state == "failed"
    elif reason == "models_arrived":
        bare = state.isin("analysed", "described") & (F.coalesce(F.size("labels"), F.lit(0)) < 1)
        again = indexed & kinds & (bare | (F.coalesce("embedding_state", F.lit("none")) != "indexed"))
    else:
        raise ValueError(reason)
    out = files.withColumns({"__again": again})
    reset = {"analysis_state": F.when(F.col("__again"), "none").otherwise(state), "attempts": F.when(F.col("__again"), 0).otherwise(F.col("attempts"))}
    if reason == "models_arrived":
        reset["embedding_state"] = F.when(F.col("__again"), "none").otherwise(F.col("embedding_state"))
    return out.withColumns(reset).drop("__again")


def analysis_progress(files: DataFrame) -> DataFrame:
    done = F.col("analysis_state").isin("analysed", "described") | (F.col("attempts") >= ATTEMPTS)
    indexed = F.col("index_state") == "indexed"
    return files.agg(F.count_if(indexed & done).alias("done"), F.count_if(indexed).alias("total"))


def apply_probe(files: DataFrame, probes: DataFrame, columns: list[str]) -> DataFrame:
    """New measurements win where they have a value."""
    new = probes.select("file_id", *[F.col(c).alias(f"__{c}") for c in columns])
    return files.join(new, "file_id", "left").withColumns({c: F.coalesce(f"__{c}", c) for c in columns}).drop(*[f"__{c}" for c in columns])


def fold_edits(edits: DataFrame) -> DataFrame:
    """Last write wins per key and field, by time, then sequence."""
    return edits.groupBy("key", "field").agg(F.max_by("value", F.struct("ts", "seq")).alias("value"))


def remove_keys(tables: dict[str, DataFrame], keys: DataFrame, column: str) -> dict[str, DataFrame]:
    """Each table without the rows of removed keys."""
    return {name: df.join(keys.select(column), column, "left_anti") for name, df in tables.items()}


def clear_project(files: DataFrame, projects: DataFrame) -> DataFrame:
    gone = projects.select("project_id", F.lit(True).alias("__gone"))
    return files.join(gone, "project_id", "left").withColumn("project_id", F.when(F.col("__gone").isNull(), F.col("project_id"))).drop("__gone")


def ensure_dimension(names: DataFrame, existing: DataFrame) -> DataFrame:
    """(id, name) of names not there yet: trimmed, without leading #, one per lower-case name."""
    clean = names.select(F.trim(F.regexp_replace(F.trim("name"), "^#+", "")).alias("name")).where("name <> ''")
    one = clean.groupBy(F.lower("name").alias("low")).agg(F.min("name").alias("name"))
    new = one.join(existing.select(F.lower("name").alias("low")), "low", "left_anti")
    return new.select(F.xxhash64("low").alias("id"), "name")


def rename_dimension(existing: DataFrame, renames: DataFrame) -> DataFrame:
    """(id, name, outcome) of each asked name (id, name): renamed, empty, taken or absent; `name` is the one it has then.

    Names are trimmed. A name is taken if another id bears it before the batch; of several ids that ask for a free one
    the smallest gets it. One rename per id.
    """
    asked = renames.select("id", F.trim(F.coalesce("name", F.lit(""))).alias("wanted"))
    held = existing.select(F.col("name").alias("wanted"), F.col("id").alias("holder"))
    rows = asked.join(existing.select("id", "name"), "id", "left").join(held, "wanted", "left")
    outcome = (
        F.when(F.col("wanted") == "", "empty")
        .when(F.col("holder") != F.col("id"), "taken")
        .when(F.col("name").isNull(), "absent")
        .otherwise("renamed")
    )
    rows = rows.withColumn("outcome", outcome)
    winners = rows.where("outcome = 'renamed'").groupBy("wanted").agg(F.min("id").alias("winner"))
    late = (F.col("outcome") == "renamed") & (F.col("winner") != F.col("id"))
    rows = rows.join(winners, "wanted", "left").withColumn("outcome", F.when(late, "taken").otherwise(F.col("outcome")))
    return rows.select("id", F.when(F.col("outcome") == "renamed", F.col("wanted")).otherwise(F.col("name")).alias("name"), "outcome")


def save_text(files: DataFrame, extracted: DataFrame) -> DataFrame:
    """Extracted text replaces the old one and its state; a missing answer, and a file not asked about, keep both."""
    new = extracted.select("file_id", F.col("text").alias("__text"), F.col("available").alias("__available"))
    state = (
        F.when(F.col("__available").isNull(), F.col("ocr_state"))
        .when(~F.col("__available"), "unavailable")
        .when(F.trim(F.coalesce("__text", F.lit(""))) == "", "none")
        .otherwise("extracted")
    )
    got = F.coalesce(F.col("__available"), F.lit(False)) & (F.trim(F.coalesce("__text", F.lit(""))) != "")
    known = files if "ocr_state" in files.columns else files.withColumn("ocr_state", F.lit("none"))
    return known.join(new, "file_id", "left").withColumns(
        {"ocr_state": state, "ocr_text": F.when(got, F.col("__text")).otherwise(F.col("ocr_text"))}
    ).drop("__text", "__available")


#: What a model writes about a file, all of it replaced together.
GENERATED = ["title", "description", "labels", "label_scores", "context", "engine"]


def save_generated(files: DataFrame, generated: DataFrame) -> DataFrame:
    """What `generated` has of `GENERATED` is replaced together for each file with an answer (a title), and its state is described;
    files asked about without an answer keep all and count a failed attempt."""
    columns = [c for c in GENERATED if c in generated.columns and c in files.columns]
    new = generated.select("file_id", F.lit(True).alias("__asked"), *[F.col(c).alias(f"__{c}") for c in columns])
    got = F.col("__title").isNotNull()
    failed = F.coalesce(F.col("__asked"), F.lit(False)) & ~got
    after = {c: F.when(got, F.col(f"__{c}")).otherwise(F.col(c)) for c in columns}
    after["attempts"] = F.col("attempts") + F.when(failed, 1).otherwise(0)
    if "analysis_state" in files.columns:
        after["analysis_state"] = F.when(got, "described").when(failed, "failed").otherwise(F.col("analysis_state"))
    return files.join(new, "file_id", "left").withColumns(after).drop("__asked", *[f"__{c}" for c in columns])


def save_machine_tags(file_tags: DataFrame, generated: DataFrame) -> DataFrame:
    """The tags (array of tag, source) of each answer replace the machine tags of its file; a user's tags stay and win."""
    answered = generated.where("title is not null").select("file_id", F.explode_outer("tags").alias("t"))
    return replace_machine_tags(file_tags, answered.select("file_id", F.col("t.tag").alias("tag"), F.col("t.source").alias("source")))


#: Fields of an edit log that set a column of the file, and the column.
EDITED = {"favorite": "favorite", "project": "project_id", "name": "name", "folder": "folder_path", "trash": "index_state"}


def apply_edits(files: DataFrame, file_tags: DataFrame, file_collections: DataFrame, edits: DataFrame) -> dict[str, DataFrame]:
    """files, file_tags and file_collections after one log of edits (file_id, ts, seq, field, value), in order of time, then sequence.

    favorite (true or false), project (null clears it), name, folder and trash (true or false) set what the file has last been
    given; a file in the trash is missing, one taken out again is pending. A changed name or folder changes path and ext. tag+, tag-, collection+ and collection-
    attach and detach `value`, the last one of a file and value counts: a tag is attached as the user's, in place of a machine's,
    and detached whoever put it there. Edits of unknown files and fields do nothing.
    """
    when = F.struct("ts", "seq")
    known = edits.join(files.select("file_id"), "file_id", "left_semi")
    last = known.where(F.col("field").isin(*EDITED)).groupBy("file_id", "field").agg(F.max_by(F.struct("value"), when).alias("v"))
    wide = last.groupBy("file_id").pivot("field", list(EDITED)).agg(F.first("v")).toDF("file_id", *[f"__{f}" for f in EDITED])
    rows = files.join(wide, "file_id", "left")
    said = lambda f: F.col(f"__{f}.value")
    asked = lambda f: F.col(f"__{f}").isNotNull()
    rows = rows.withColumns(
        {
            "favorite": F.when(asked("favorite"), F.lower(said("favorite")) == "true").otherwise(F.col("favorite")),
            "project_id": F.when(asked("project"), said("project")).otherwise(F.col("project_id")),
            "name": F.coalesce(said("name"), "name"),
            "folder_path": F.coalesce(said("folder"), "folder_path"),
            "index_state": F.when(F.lower(said("trash")) == "true", "missing")
            .when((F.lower(said("trash")) == "false") & (F.col("index_state") == "missing"), "pending")
            .otherwise(F.col("index_state")),
        }
    )
    moved = asked("name") | asked("folder")
    rows = rows.withColumns(
        {
            "path": F.when(moved, F.concat("folder_path", F.lit("/"), "name")).otherwise(F.col("path")),
            "ext": F.when(asked("name"), extension(F.col("name"))).otherwise(F.col("ext")),
        }
    )

    def membership(kind: str, table: DataFrame, column: str, fresh: dict) -> DataFrame:
        own = known.where(F.col("field").isin(f"{kind}+", f"{kind}-") & F.col("value").isNotNull())
        own = own.groupBy("file_id", F.col("value").alias(column)).agg(F.max_by("field", when).alias("__field"))
        kept = table.join(own.select("file_id", column), ["file_id", column], "left_anti")
        new = own.where(F.col("__field") == f"{kind}+").withColumns(fresh).select(*table.columns)
        return kept.select(*table.columns).unionByName(new)

    return {
        "files": rows.select(*files.columns),
        "file_tags": membership("tag", file_tags, "tag", {"source": F.lit("user")}),
        "file_collections": membership("collection", file_collections, "collection_id", {}),
    }


def activity_feed(events: DataFrame, n: int) -> DataFrame:
    n = min(500, max(1, n))
    return events.orderBy(F.desc("ts"), F.desc("event_id")).limit(n)


# Versions


def capture_changes(files: DataFrame, previews: DataFrame) -> DataFrame:
    """A version per file whose content moved and whose preview was replaced, dated by the time it had before."""
    return files.where("previous_modified_at is not null").join(previews.select("file_id"), "file_id", "left_semi").select(
        "file_id", "path", "bytes", F.col("previous_modified_at").alias("content_at"), F.lit("change").alias("source")
    )


def clear_captured(files: DataFrame) -> DataFrame:
    """The files after their changes were captured or found without a new preview: each marker counts once."""
    return files.withColumn("previous_modified_at", F.lit(None).cast("timestamp"))


def capture_manual(files: DataFrame, ids: DataFrame) -> DataFrame:
    return files.join(ids, "file_id", "left_semi").select("file_id", "path", "bytes", F.col("modified_at").alias("content_at"), F.lit("manual").alias("source"))


def prune_versions(versions: DataFrame, n: int = 12) -> DataFrame:
    newest = Window.partitionBy("file_id").orderBy(F.desc("content_at"), F.desc("version_id"))
    return versions.withColumn("rn", F.row_number().over(newest)).where(F.col("rn") <= n)


def drop_orphans(versions: DataFrame, listing: DataFrame) -> DataFrame:
    """Versions whose stored copy still exists."""
    return versions.join(listing.select("path"), "path", "left_semi")
