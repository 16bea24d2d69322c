"""I-Match document fingerprints, in DataFrame operations only.

Terms are lower-case runs of letters and digits. The lexicon keeps the terms in at least LOW of the texts and with HIGH
of the votes at most, an inverse-document-frequency band of log(1/HIGH) to log(1/LOW). A group of near copies has about
one vote, so that it doesn't push its own terms out: each text has a sketch, its `SKETCH` least hashes of `WORDS` terms in a row, and
votes with 1 / n, n being the `SHARED`th largest number of texts that have one of them too (numbers below LOW of the
texts count as 1; the others are `SKETCH` / LOW at most, whatever the size).
A text's terms in the lexicon, distinct and sorted, are hashed whole, and hashed again over randomised subsets of the
lexicon: `DRAWS` random draws at each of the rates 1/4, 1/16, 1/64, 1/256 and 1/1024. Dense subsets tell near-equal
texts, sparse ones still agree after large edits, whatever the length.

The lexicon holds at most (mean distinct terms per text) / LOW terms, and is broadcast while it has `BROADCAST_TERMS`
at most; beyond that it is joined by shuffle.

Likeness of two fingerprints: 1 if the whole sets agree; else the largest share, over the rates, of draws whose
subsets agree among those that are not empty on both sides (counted as half the draws at least).

The texts are shuffled once: rows are dealt into buckets of neighbours by (id, text hash), in which a window gives each
row its follower's text and, later, its follower's fingerprint; the first row of a bucket is also put behind the last of the bucket before.

Defined results: a text without a term in the lexicon is fingerprinted over all its terms, and likeness to or of it
compares all terms of both texts; a text without any term is fingerprinted by the hash of its lower-cased self (null:
of the empty text) and is like equal texts only; equal texts have equal fingerprints; each row has a row in the result:
rows that repeat both id and text follow each other; one id with several texts orders them by hash; null ids
come last; extra columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, staged

LOW, HIGH = 0.001, 0.05
DRAWS, RATES = 6, (4, 16, 64, 256, 1024)
BROADCAST_TERMS = 2_000_000
#: Rows of a bucket, on average.
BUCKET_ROWS = 1_000
#: Near copies: shingles of a text's sketch, terms of a shingle, and how many of them two copies share.
SKETCH, WORDS, SHARED = 9, 3, 3
_ONE = 1 << 30  # a whole vote; whole numbers add up to the same in any order


def terms(text: Column) -> Column:
    """Distinct term hashes of a text."""
    words = F.split(F.lower(text), r"[^\p{L}\p{N}]+")
    return F.array_distinct(F.transform(words, lambda w: F.xxhash64(w)))


def sketches(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """`texts` with `sketch`, the `SKETCH` least shingle hashes of the text column (all of a text with fewer)."""

    # arrays are bound as variables of lambdas, so that none is computed again for each use
    def shingles(w: Column) -> Column:
        return F.transform(w, lambda x, i: F.xxhash64(x, *[F.get(w, i + j) for j in range(1, WORDS)]))

    words = F.split(F.lower(F.col(text_col)), r"[^\p{L}\p{N}]+")
    hashed = F.transform(F.array(words), shingles)[0]
    return texts.withColumn("sketch", F.slice(F.sort_array(F.array_distinct(hashed)), 1, SKETCH))


def lexicon(texts: DataFrame, text_col: str = "text", low: float = LOW, high: float = HIGH) -> DataFrame:
    """(term) in `low` of the rows of `texts` at least and with `high` of the votes at most."""
    total = texts.count()
    sketched = sketches(texts.select(text_col), text_col)
    shared = sketched.select(F.explode_outer("sketch").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    groups = cut(shared.where(F.col("n") >= max(2.0, low * total)))
    # one row; the map has SKETCH / low entries at most
    sizes = groups.agg(F.map_from_entries(F.collect_list(F.struct("key", "n"))).alias("sizes"))
    found = F.transform("sketch", lambda x: F.coalesce(F.try_element_at("sizes", x), F.lit(1)))
    nth = F.least(F.lit(SHARED), F.size("sketch")) - 1
    sized = sketched.crossJoin(F.broadcast(sizes)).withColumn("n", F.get(F.sort_array(found, asc=False), nth))
    voting = sized.select(text_col, F.floor(F.lit(_ONE) / F.col("n")).cast("long").alias("vote"))
    # the empty term is in no text: it carries the sum of all votes
    empty = F.xxhash64(F.lit(""))
    each = F.array_union(terms(F.col(text_col)), F.array(empty))
    counted = (
        voting.select("vote", F.explode_outer(each).alias("term"))
        .groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("vote").alias("votes"))
    )
    kept = cut(counted.where((F.col("df") >= low * total) | (F.col("term") == empty)))
    votes = (kept.where(F.col("term") == empty).first() or {"votes": 0})["votes"]
    return cut(kept.where((F.col("votes") <= high * votes) & (F.col("term") != empty)).select("term"))


def _drawn(j: int, rate: int):
    return lambda term: F.pmod(F.xxhash64(term, F.lit(j)), F.lit(rate)) == 0


def _few(rows: DataFrame) -> DataFrame:
    """`rows`, broadcast while they number `BROADCAST_TERMS` at most."""
    return F.broadcast(rows) if rows.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS else rows


def with_parts(rows: DataFrame, arrays: dict[str, str]) -> DataFrame:
    """`rows` with hash parts in place of sorted arrays of terms (array column: name of its parts), the whole first;
    null parts are empty subsets. No terms: null."""
    plain, made = [c for c in rows.columns if c not in arrays], {}
    for array in arrays:
        made[array] = [_short(F.col(array))]
    # the draws are nested over the rates, so that each filter reads what the one before kept
    for level, rate in enumerate(RATES):
        subsets = [
            F.filter(f"__{array}_{j}_{level - 1}" if level else array, _drawn(j, rate)).alias(f"__{array}_{j}_{level}")
            for array in arrays
            for j in range(DRAWS)
        ]
        rows = rows.select("*", *subsets)
    for array in arrays:
        for j in range(DRAWS):
            names = [f"__{array}_{j}_{level}" for level in range(len(RATES))]
            made[array] += [F.when(F.size(x) > 0, _short(F.col(x))) for x in names]
    return rows.select(*plain, *[F.when(F.size(a) > 0, F.array(*made[a])).alias(name) for a, name in arrays.items()])


def _short(terms_: Column) -> Column:
    """32 bits of the hash of an array."""
    return F.shiftright(F.xxhash64(terms_), 32).cast("int")


def all_terms(text: Column) -> Column:
    """A text's terms, sorted."""
    return F.sort_array(F.filter(terms(text), lambda t: t != F.xxhash64(F.lit(""))))


def printed(parts: Column, text: Column) -> Column:
    """A fingerprint as hex, eight digits a part, `-` for an empty subset."""
    short = F.transform(parts, lambda p: F.coalesce(F.lower(F.right(F.lpad(F.hex(p.cast("long")), 16, "0"), F.lit(8))), F.lit("-")))
    return F.coalesce(F.array_join(short, ""), F.concat(F.lit("="), F.lower(F.lpad(F.hex(text), 16, "0"))))


def likeness(a: Column, b: Column, same: Column) -> Column:
    """Of two arrays of parts; `same`: what tells equality where both texts have no term of the lexicon."""
    shares = []
    for i in range(len(RATES)):
        pairs = [(a[1 + j * len(RATES) + i], b[1 + j * len(RATES) + i]) for j in range(DRAWS)]
        equal = sum((F.when(x == y, 1).otherwise(0) for x, y in pairs), F.lit(0))
        filled = sum((F.when(x.isNotNull() | y.isNotNull(), 1).otherwise(0) for x, y in pairs), F.lit(0))
        shares.append(equal / F.greatest(filled, F.lit(DRAWS // 2)))
    return (
        F.when(a.isNull() & b.isNull(), F.when(same, 1.0).otherwise(0.0))
        .when(a.isNull() | b.isNull(), 0.0)
        .when(a[0] == b[0], 1.0)
        .otherwise(F.greatest(*shares))
    )


_KEY = ["z", "id", "k"]


def _bucketed(texts: DataFrame, narrow: DataFrame) -> DataFrame:
    """`texts` with `b`, its bucket in the order of `_KEY`, and `w`: 1 for a copy of a bucket's first row that stands
    behind the bucket before (of all rows' first one: behind the last).

    Only the least key of each bucket is looked at across buckets; there is one row of it in the plan.
    """
    n = max(1, narrow.count() // BUCKET_ROWS)
    ranged = narrow.repartitionByRange(n, *_KEY).groupBy(F.spark_partition_id()).agg(F.min(F.struct(*_KEY)).alias("least"))
    bounds = cut(ranged.agg(F.sort_array(F.collect_list("least")).alias("bounds")))
    count = len((bounds.first() or [[]])[0])
    steps = F.array(*[F.lit(1 << k) for k in range(max(1, count.bit_length()) - 1, -1, -1)])
    key = F.struct(*_KEY)
    # a binary search: the number of bounds up to the key
    behind = F.aggregate(
        steps, F.lit(0), lambda at, step: F.when(F.get("bounds", at + step - 1) <= key, at + step).otherwise(at)
    )
    placed = texts.crossJoin(F.broadcast(bounds)).withColumn("at", behind)
    first = F.get("bounds", F.col("at") - 1) == key
    own = F.struct(F.col("at").alias("b"), F.lit(0).alias("w"), F.lit(0).alias("wrapped"))
    back = F.col("at") == 1
    extra = F.struct(
        F.when(back, F.lit(count)).otherwise(F.col("at") - 1).alias("b"), F.lit(1).alias("w"), back.cast("int").alias("wrapped")
    )
    spots = F.explode_outer(F.when(first, F.array(own, extra)).otherwise(F.array(own)))
    return placed.withColumn("spot", spots).select(*texts.columns, "spot.*")


def _lexical(rows: DataFrame, words: DataFrame, carried: list[str]) -> DataFrame:
    """`rows`, dealt by `b`, with parts and edited_parts instead of text and edited; `carried`: the columns to keep."""
    none = F.xxhash64(F.lit(""))  # stands for the row itself
    both = F.struct(terms(F.col("text")).alias("own"), terms(F.col("edited")).alias("edited"))

    def marked(t: Column) -> Column:
        own = F.transform(t["own"], lambda x: F.struct(x.alias("term"), F.lit(True).alias("mine")))
        return F.concat(own, F.transform(t["edited"], lambda x: F.struct(x.alias("term"), F.lit(False).alias("mine"))))

    each = F.concat(F.array(F.struct(F.lit(None).cast("long").alias("term"), F.lit(True).alias("mine"))), F.transform(F.array(both), marked)[0])
    known = _few(words.where(F.col("term") != none).select("term", F.lit(True).alias("in")))
    c = F.col
    # what is carried stands in the row without a term; the others are narrow, as they are sorted by row
    flat = rows.withColumn("r", F.monotonically_increasing_id()).select("b", "r", F.struct(*carried).alias("own_row"), F.explode_outer(each).alias("t"))
    found = (
        flat.select("b", "r", F.when(c("t.term").isNull(), c("own_row")).alias("own_row"), "t.*")
        .join(known, "term", "left")
        .where(c("in") | c("term").isNull())
        .groupBy("b", "r")
        .agg(
            F.first("own_row", ignorenulls=True).alias("own_row"),
            F.collect_list(F.when(c("in") & c("mine"), c("term"))).alias("own"),
            F.collect_list(F.when(c("in") & ~c("mine"), c("term"))).alias("other"),
        )
    )
    found = found.select("b", "own_row.*", F.sort_array("own").alias("own"), F.sort_array("other").alias("other"))
    return with_parts(found, {"own": "parts", "other": "edited_parts"})


def compare_edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of each row."""
    kind = docs.schema[id_col].dataType
    texts = docs.select(
        F.col(id_col).isNull().cast("int").alias("z"),
        F.coalesce(F.col(id_col), F.lit(0).cast(kind)).alias("id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    words = lexicon(texts)
    texts = texts.withColumn("k", F.xxhash64("text"))
    narrow = texts.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("m"))
    narrow = staged(narrow, "imatch-keys")
    if narrow.where("m > 1").limit(1).count():
        # of equal rows, one stands for all but the last, and one for the last
        texts = texts.groupBy(*_KEY).agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("m"))
        copies = F.when(F.col("m") > 1, F.array(F.col("m") - 1, F.lit(1).cast("long"))).otherwise(F.array(F.lit(1).cast("long")))
        texts = texts.select(*_KEY, "text", F.posexplode(copies).alias("copy", "times"))
    else:
        texts = texts.withColumn("copy", F.lit(0)).withColumn("times", F.lit(1).cast("long"))
    order = Window.partitionBy("b").orderBy("wrapped", *_KEY, "copy", "w")
    keys = ["wrapped", *_KEY, "copy", "w"]
    n = F.length("text")
    head = F.expr("substring(coalesce(next, ''), 1, length(text) div 4)")
    rows = (
        _bucketed(texts, narrow)
        .withColumn("next", F.lead("text").over(order))
        .withColumn("edited", F.concat(F.expr("substring(text, 1, length(text) - length(text) div 4)"), head))
        .withColumn("n", n.cast("long"))
        .withColumn("sha", F.unhex(F.sha2("edited", 256)))
        .withColumn("low", F.xxhash64(F.lower("text")))
        .withColumn("edited_low", F.xxhash64(F.lower("edited")))
    )
    found = _lexical(rows, words, [*keys, "times", "n", "sha", "low", "edited_low"])
    found = found.withColumn("next", F.lead(F.struct(*_KEY, "low", "parts")).over(order)).where("w = 0")
    pairs = staged(
        found.select(*_KEY, "copy", "times", "n", "sha", "low", "edited_low", "parts", "edited_parts",
                     F.col("next.z").alias("next_z"), F.col("next.id").alias("next_id"), F.col("next.k").alias("next_k"),
                     F.col("next.low").alias("next_low"), F.col("next.parts").alias("next_parts")),
        "imatch-pairs",
    )
    plain = _few(_unlisted(texts, pairs))
    c = F.col

    def like(a: str, b: str, all_a: str, all_b: str, same: Column) -> Column:
        bare = c(a).isNull() | c(b).isNull()
        return F.when(bare, likeness(c(all_a), c(all_b), same)).otherwise(likeness(c(a), c(b), same))

    return (
        pairs.join(plain, [*_KEY, "copy"], "left")
        .withColumn("_", F.explode(F.sequence(F.lit(1).cast("long"), "times")))
        .select(
            F.when(c("z") == 0, c("id")).alias("id"),
            c("n").alias("n_chars"),
            F.lower(F.hex("sha")).alias("edited_sha256"),
            printed(F.coalesce("parts", "every"), c("low")).alias("fingerprint"),
            printed(F.coalesce("edited_parts", "edited_every"), c("edited_low")).alias("edited_fingerprint"),
            like("parts", "edited_parts", "every", "edited_every", c("low") == c("edited_low")).alias("near_edited"),
            like("parts", "next_parts", "every", "next_every", c("low") == c("next_low")).alias("near_next"),
        )
    )


def _unlisted(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """Where a row, its edited text or its follower has no term of the lexicon: the parts over all their terms."""
    odd = cut(
        pairs.where("parts is null or edited_parts is null or next_parts is null").select(*_KEY, "copy", "next_z", "next_id", "next_k")
    )
    followers = odd.select(F.col("next_z").alias("z"), F.col("next_id").alias("id"), F.col("next_k").alias("k"))
    needed = odd.select(*_KEY).union(followers).distinct()
    some = cut(texts.where("copy = 0").select(*_KEY, "text").join(_few(needed), _KEY, "left_semi"))
    after = some.select(*[F.col(x).alias(f"next_{x}") for x in _KEY], F.col("text").alias("next"))
    edited = F.concat(
        F.expr("substring(text, 1, length(text) - length(text) div 4)"), F.expr("substring(next, 1, length(text) div 4)")
    )
    both = odd.join(some, _KEY).join(after, ["next_z", "next_id", "next_k"]).withColumn("edited", edited)
    arrays = {"text": "every", "edited": "edited_every", "next": "next_every"}
    both = both.select(*_KEY, "copy", *[all_terms(F.col(x)).alias(x) for x in arrays])
    return cut(with_parts(both, arrays))
