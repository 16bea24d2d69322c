"""Organise plans and document text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import safe_segment


# The folder of each kind; other kinds go to Other.
KIND_FOLDERS = {
    "photo": "Photos", "screenshot": "Screenshots", "document": "Documents", "video": "Videos", "audio": "Audio", "design": "Design",
    "archive": "Archives",
}
NOT_THERE = "not on disk where the index last saw it"


def plan_moves(
    files: DataFrame, members: DataFrame, faces: DataFrame, people: DataFrame, root: str, listing: DataFrame | None = None
) -> DataFrame:
    """(file_id, path, target, outcome, reason): the kind's folder, then the first collection, else the only named person, else Unfiled.

    Files that are missing, or that `listing` (path), where given, doesn't hold, are skipped with a reason. A file keeps the name that
    its path ends in.
    """
    first = members.groupBy("file_id").agg(F.min("collection_id").alias("first"))
    named = people.where("not hidden and label is not null").select("person_id", "label")
    shown = faces.select("file_id", "person_id").join(named, "person_id").groupBy("file_id").agg(F.collect_set("label").alias("who"))
    rows = files.join(first, "file_id", "left").join(shown, "file_id", "left")
    gone = F.col("index_state") == "missing"
    if listing is not None:
        rows = rows.join(listing.select("path", F.lit(True).alias("__there")).distinct(), "path", "left")
        gone = gone | F.col("__there").isNull()
    folder = F.coalesce("first", F.when(F.size("who") == 1, F.col("who")[0]))
    kinds = F.create_map(*[F.lit(x) for pair in KIND_FOLDERS.items() for x in pair])
    name = F.coalesce(F.nullif(F.regexp_extract("path", "([^/]*)$", 1), F.lit("")), "name")
    target = F.concat_ws("/", F.lit(root), F.coalesce(F.try_element_at(kinds, F.col("kind")), F.lit("Other")), safe_segment(folder), name)
    outcome = F.when(gone, "skipped").when(F.col("path") == target, "settled").otherwise("move")
    reason = F.when(gone, NOT_THERE)
    return rows.select("file_id", "path", "bytes", "index_state", target.alias("target"), outcome.alias("outcome"), reason.alias("reason"))


def resolve_collisions(plan: DataFrame, listing: DataFrame) -> DataFrame:
    """(file_id, target): `name (2).ext` and so on, so that no target is taken or planned twice.

    Each contested target gets its free names in order; the n-th file that wants it takes the n-th free one.
    """
    stem = F.regexp_extract("target", r"^(.*?)(\.[^./]*)?$", 1)
    ext = F.regexp_extract("target", r"^(.*?)(\.[^./]*)?$", 2)
    rows = plan.withColumns({"stem": stem, "ext": ext})
    wants = rows.groupBy("target").agg(F.count(F.lit(1)).alias("n"), F.first("stem").alias("stem"), F.first("ext").alias("ext"))
    taken = listing.select(F.col("path").alias("name"))
    # a contested name needs as many candidates as files want it, and one more per taken or planned variant
    blocked = taken.unionAll(wants.select(F.col("target").alias("name"))).select(F.regexp_replace("name", r" \(\d+\)(\.[^./]*)?$", "$1").alias("target")).groupBy("target").agg(F.count(F.lit(1)).alias("t"))
    tries = wants.join(blocked, "target", "left").withColumn("k", F.explode(F.sequence(F.lit(1), (F.col("n") + F.coalesce("t", F.lit(0))).cast("int"))))
    name = F.when(F.col("k") == 1, F.col("target")).otherwise(F.concat("stem", F.lit(" ("), F.col("k").cast("string"), F.lit(")"), "ext"))
    free = tries.withColumn("name", name).join(taken, "name", "left_anti").join(wants.select(F.col("target").alias("name"), F.lit(True).alias("other")), "name", "left")
    free = free.where(F.col("other").isNull() | (F.col("k") == 1))
    slot = F.row_number().over(Window.partitionBy("target").orderBy("k"))
    turn = F.row_number().over(Window.partitionBy("target").orderBy("file_id"))
    return rows.withColumn("slot", turn).join(free.select("target", "name", slot.alias("slot")), ["target", "slot"]).select("file_id", F.col("name").alias("target"))


def plan_summary(plan: DataFrame) -> DataFrame:
    move = F.col("outcome") == "move"
    return plan.agg(
        F.count_if(move).alias("moves"), F.coalesce(F.sum(F.when(move, F.col("bytes"))), F.lit(0)).alias("bytes"),
        F.countDistinct(F.when(move, F.regexp_extract("target", "^(.*)/[^/]*$", 1))).alias("folders"),
        F.count_if(F.col("outcome") == "settled").alias("settled"), F.count_if(F.col("outcome") == "skipped").alias("skipped"),
    )


def assemble_pages(pages: DataFrame, most: int = 40, least: int = 48) -> DataFrame:
    """(doc, page, layer, ocr, confidence) -> text and confidence of each document; thin layers take the OCR text."""
    thin = F.length(F.trim(F.coalesce("layer", F.lit("")))) < least
    used = F.when(thin & F.col("ocr").isNotNull(), F.col("ocr")).otherwise(F.coalesce("layer", F.lit("")))
    rows = pages.where(F.col("page") < most).withColumns({"used": F.trim(used), "scanned": thin & F.col("ocr").isNotNull()})
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("used") != "", F.struct("page", "used")))), lambda x: x["used"]), "\n\n")
    conf = F.coalesce(F.avg(F.when(F.col("scanned"), F.col("confidence"))), F.when(F.max("used") != "", 0.99).otherwise(0.0))
    return rows.groupBy("doc").agg(text.alias("text"), conf.alias("confidence"))


def assemble_lines(lines: DataFrame) -> DataFrame:
    """(doc, line, text, score) -> lines joined in order, and their mean score."""
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n")
    return lines.groupBy("doc").agg(text.alias("text"), F.avg("score").alias("confidence"))
