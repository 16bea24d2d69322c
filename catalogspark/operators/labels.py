"""Labels from model scores, tags from evidence, and the context they suggest."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dictionaries as D

FLOOR, REL, LEAD, SHARE, LIMIT = 0.15, 0.06, 1.25, 0.45, 4
MAX_TAGS = 8


def pool(scores: DataFrame) -> DataFrame:
    """(file_id, label, score per phrasing) -> the best phrasing of each label, as shares of the file's sum."""
    best = scores.groupBy("file_id", "label").agg(F.max("score").alias("score"))
    return best.withColumn("share", F.col("score") / F.sum("score").over(Window.partitionBy("file_id")))


def pick_category(scores: DataFrame, own: Column, floor: float = 0.34, lead: float = 1.1, beat: float = 1.5) -> DataFrame:
    """One category per file of (file_id, kind, category, share): the top one if clear, the kind's own unless well beaten."""
    w = Window.partitionBy("file_id").orderBy(F.desc("share"), "category")
    rows = scores.withColumns(
        {"rn": F.row_number().over(w), "next": F.lead("share").over(w), "own": own}
    ).withColumn("own_share", F.max(F.when(F.col("category") == F.col("own"), F.col("share"))).over(Window.partitionBy("file_id")))
    top = rows.where("rn = 1")
    clear = (F.col("share") >= floor) & (F.col("share") >= lead * F.coalesce("next", F.lit(0.0)))
    beaten = F.col("own_share").isNull() | (F.col("share") >= beat * F.col("own_share"))
    return top.select("file_id", F.when(clear & beaten, F.col("category")).otherwise(F.col("own")).alias("category"))


def select_labels(
    shares: DataFrame, generic: list[str], floor: float = FLOOR, rel: float = REL, lead: float = LEAD, share: float = SHARE, limit: int = LIMIT
) -> DataFrame:
    """(file_id, label, share, rn): the top label if it clears the floor, or the low floor with a lead; others by share of it."""
    w = Window.partitionBy("file_id").orderBy(F.desc("share"), "label")
    rows = shares.where(~F.col("label").isin(generic)).withColumns(
        {"rn": F.row_number().over(w), "top": F.first("share").over(w), "second": F.nth_value("share", 2).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))}
    )
    fits = (F.col("top") >= floor) | ((F.col("top") >= rel) & (F.col("top") >= lead * F.coalesce("second", F.lit(0.0))))
    extra = (F.col("rn") == 1) | ((F.col("share") >= floor) & (F.col("share") >= share * F.col("top")))
    return rows.where(fits & extra & (F.col("rn") <= limit)).select("file_id", "label", "share", "rn")


def suppress_parents(labels: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Without labels of which a child (taxonomy: child, parent) was kept on the same file."""
    parents = labels.join(F.broadcast(taxonomy), labels.label == F.col("child")).select("file_id", F.col("parent").alias("label"))
    return labels.join(parents, ["file_id", "label"], "left_anti")


def classify_labels(stage1: DataFrame, stage2: DataFrame, own: Column, generic: list[str], taxonomy: DataFrame) -> DataFrame:
    """Category first with its own share, then the selected labels of the second stage without parents."""
    cats = stage1.select("file_id", F.col("category").alias("label"), "share")
    chosen = pick_category(stage1, own).withColumnRenamed("category", "label").join(cats, ["file_id", "label"], "left")
    kept = suppress_parents(select_labels(pool(stage2).select("file_id", "label", "share"), generic), taxonomy)
    head = chosen.select("file_id", "label", F.coalesce("share", F.lit(0.0)).alias("share"), F.lit(0).alias("rn"))
    return head.unionByName(kept.select("file_id", "label", "share", "rn"))


def describe_sentence(labels: DataFrame, heads: DataFrame, fragments: DataFrame) -> DataFrame:
    """(file_id, sentence): a head for the category and the first two distinct fragments, those with `of` first."""
    parts = labels.join(F.broadcast(fragments), "label")
    rank = F.row_number().over(Window.partitionBy("file_id").orderBy((~F.col("fragment").startswith("of ")).cast("int"), "rn"))
    one = parts.groupBy("file_id", "fragment").agg(F.min("rn").alias("rn"))
    two = one.withColumn("k", rank).where("k <= 2").groupBy("file_id").agg(F.sort_array(F.collect_list(F.struct("k", "fragment"))).alias("f"))
    head = labels.where("rn = 0").join(F.broadcast(heads), "label").select("file_id", "head")
    return head.join(two, "file_id", "left").select("file_id", F.concat_ws(" ", "head", F.array_join(F.transform("f", lambda x: x["fragment"]), " ")).alias("sentence"))


def merge_descriptions(measured: DataFrame, captions: DataFrame, limit: int = 6) -> DataFrame:
    """The caption wins, labels are the union, the caption's first, cut to `limit`, cleaned to 48 characters."""
    c = captions.select("file_id", F.col("description").alias("__d"), F.col("labels").alias("__l"))
    none = F.array().cast("array<string>")
    labels = F.array_distinct(F.transform(F.concat(F.coalesce("__l", none), "labels"), lambda x: F.lower(F.substring(F.trim(x), 1, 48))))
    return measured.join(c, "file_id", "left").select(
        "file_id", F.coalesce("__d", "description").alias("description"), F.slice(F.filter(labels, lambda x: x != ""), 1, limit).alias("labels")
    )


def _tag(raw: Column) -> Column:
    clean = F.lower(F.regexp_replace(F.trim(raw), "^#+", ""))
    return F.when(clean.rlike(r"^[\p{L}\p{N}_-]{1,24}$") & ~clean.isin(D.CONTAINER_LABELS), clean)


def _signals(text: Column) -> Column:
    # bound as the variable of a lambda, the text is lower-cased once and not again for each needle
    def found(low: Column) -> Column:
        any_of = lambda needles: reduce(lambda a, b: a | b, [low.contains(n) for n in needles])
        return F.array(*[F.when(any_of(n), F.lit(t)) for t, n in D.SIGNALS.items()])

    return F.transform(F.array(F.lower(F.coalesce(text, F.lit("")))), found)[0]


def derive_tags(files: DataFrame) -> DataFrame:
    """(file_id, tags array of (name, source)): labels, then text, then the name, then the kind; the first source wins; 8 at most.

    Needs file_id, kind, name, labels (array) and text.
    """
    made = lambda arr, source: F.transform(arr, lambda t: F.struct(t.alias("name"), F.lit(source).alias("source")))
    labels = F.transform(F.coalesce("labels", F.array().cast("array<string>")), _tag)
    kind = F.array(F.when(F.col("kind").isin(D.KIND_TAGS), F.col("kind")))
    every = F.filter(F.concat(made(labels, "vision"), made(_signals(F.col("text")), "ocr"), made(_signals(F.col("name")), "filename"), made(kind, "kind")), lambda t: t["name"].isNotNull())

    def first(tags: Column) -> Column:
        names = F.array_distinct(F.transform(tags, lambda t: t["name"]))
        return F.slice(F.transform(names, lambda n: F.element_at(F.filter(tags, lambda t: t["name"] == n), 1)), 1, MAX_TAGS)

    return files.select("file_id", "kind", F.transform(F.array(every), first)[0].alias("tags"))


def infer_context(derived: DataFrame) -> DataFrame:
    """(file_id, context) of derive_tags(): the first rung of a ladder of tags."""
    names = F.transform("tags", lambda t: t["name"])
    has = lambda *ts: F.arrays_overlap(names, F.array(*map(F.lit, ts)))
    languages = "react typescript javascript python rust java sql css html shell".split()
    language = F.initcap(F.try_element_at(F.array_intersect(F.array(*map(F.lit, languages)), names), F.lit(1)))
    detail = (
        F.when(has("error") & language.isNotNull(), F.concat(language, F.lit(" debugging")))
        .when(has("error"), "debugging")
        .when(language.isNotNull(), language)
        .when(has("terminal"), "terminal work")
        .otherwise("source code")
    )
    ladder = F.when(F.size("tags") == 0, None).when(has("code", "terminal", "error", *languages), F.concat(F.lit("Programming / "), detail))
    # The ladder's rungs below programming.
    for tags, context in [
        (["receipt", "invoice"], "Documents / Receipts and invoices"),
        (["design"], "Design / Interface references"),
        (None, "Design / Interface references"),
        (["presentation"], "Documents / Presentations"),
        (["spreadsheet"], "Documents / Spreadsheets"),
        (["recipe"], "Reference / Recipes"),
        (["ticket"], "Documents / Travel and tickets"),
        (["person", "portrait", "selfie", "group"], "People / Photographs"),
        (["chart", "dashboard"], "Work / Charts and dashboards"),
    ]:
        ladder = ladder.when(has("ui") & has("screenshot") if tags is None else has(*tags), context)
    ladder = ladder.when(has("game"), F.when(F.col("kind") == "screenshot", "Games / Screenshots").otherwise("Games / Captures"))
    for tags, context in [
        (["food", "drink"], "Photographs / Food and drink"),
        (["animal", "dog", "cat", "bird"], "Photographs / Animals"),
        (["outdoors", "nature", "beach", "mountain", "city", "sky", "night", "plant", "sports"], "Photographs / Outdoors and travel"),
        (["vehicle", "building", "furniture", "clothing", "product"], "Photographs / Objects"),
        (["art", "logo"], "Design / Artwork"),
        (["text"], "Documents / Text"),
    ]:
        ladder = ladder.when(has(*tags), context)
    for kind, context in [("screenshot", "Screenshots"), ("document", "Documents"), ("video", "Video"), ("audio", "Audio"), ("design", "Design / Interface references")]:
        ladder = ladder.when(F.col("kind") == kind, context)
    return derived.select("file_id", ladder.alias("context"))


def replace_machine_tags(file_tags: DataFrame, new: DataFrame) -> DataFrame:
    """Machine tags of the files in `new` (file_id, tag or null, source) are replaced; a user's tag wins a clash."""
    asked = new.select("file_id").distinct()
    user = file_tags.where("source = 'user'")
    others = file_tags.where("source <> 'user'").join(asked, "file_id", "left_anti")
    fresh = new.where("tag is not null").select("file_id", "tag", "source").distinct().join(user, ["file_id", "tag"], "left_anti")
    return user.unionByName(others).unionByName(fresh)
