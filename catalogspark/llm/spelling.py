"""Groups of spelling variants: words of a corpus one edit apart, each led to the much more frequent form it stands for.

Method: the sorted list of words is scanned once for each word with the edit matrix held to a band of three diagonals. A
row of the matrix belongs to a prefix, so going to the next word keeps the rows of their longest common prefix, and once a
row holds nothing under two edits all words with that prefix are skipped.

The list isn't scanned whole: two words one edit apart, the shorter of m characters, agree in their first half or in what
is left after it, counted from the end. So each word stands in blocks by (m, half), m its own length and one less, and each
pair meets in a block. A block over `BLOCK_WORDS` is dealt again by halving what its words don't yet share, and
so on; where one character is left free, a block holds no more words than the alphabet allows (some 8,000). A pair belongs to
the first block that it fits, so none comes twice, and none is dropped.

Defined results: null texts have no words; a null id is written as empty text; equal rows count each; an empty table has
no words; equal counts are told apart by the smaller word in code-point order; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lean, staged

#: Fixed value: what a word is made of.
LETTERS = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLOCK_WORDS = 400
#: Rows of blocks that a task scans, about.
TASK_ROWS = 50_000
_PAIRS = "word string, n long, near string, near_n long"


def count_words(docs: DataFrame, id_col: str, text_col: str, typo_every: int, min_length: int, min_count: int) -> DataFrame:
    """(word, n). Where `typo_every` divides the crc32 of `<id>:<run>`, the run's character at crc32 % length is left out."""
    runs = docs.select(
        F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"),
        F.explode(F.regexp_extract_all(F.col(text_col), F.lit(LETTERS), F.lit(0))).alias("run"),
    ).select("id", F.translate("run", UPPER, LOWER).alias("run"))
    crc = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    runs = runs.withColumn("h", crc)
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    word = F.when(F.col("h") % typo_every == 0, cut).otherwise(F.col("run"))
    words = runs.select(word.alias("word")).where(F.length("word") >= min_length)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)


def _halved(rows: DataFrame) -> DataFrame:
    """Each row (word, n, m, path, a, b) twice: by the first half of its free characters, and by the rest from the end."""
    half = F.expr("cast((m - a - b) div 2 as int)")
    sides = F.array(
        F.struct(F.lit("p").alias("side"), (F.col("a") + half).alias("a"), F.col("b")),
        F.struct(F.lit("s").alias("side"), F.col("a"), (F.col("m") - F.col("a") - half).alias("b")),
    )
    out = rows.withColumn("to", F.explode(sides))
    out = out.select("word", "n", "m", F.concat("path", "to.side").alias("path"), "to.a", "to.b")
    shared = F.concat(
        F.substring(F.col("word"), F.lit(1), F.col("a")), F.lit(" "),
        F.substring(F.col("word"), F.length("word") - F.col("b") + 1, F.col("b")),
    )
    return out.withColumn("shared", shared)


def blocked(vocabulary: DataFrame, limit: int = BLOCK_WORDS, shortest: int = 1) -> DataFrame:
    """(word, n) -> the rows of all blocks of two words or more: word, n, m, path, shared. No word is under `shortest`."""
    m = F.explode(F.array(F.length("word"), F.length("word") - 1)).alias("m")
    rows = vocabulary.select("word", "n", m).where(F.col("m") >= shortest)
    rows = rows.withColumns({"path": F.lit(""), "a": F.lit(0), "b": F.lit(0)})
    out, keys = None, ["m", "path", "shared"]
    while True:
        rows = staged(_halved(rows), "spelling-blocks")
        sizes = rows.groupBy(*keys, "a", "b").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
        sizes = staged(sizes, "spelling-sizes")
        large = (F.col("size") > limit) & (F.col("m") - F.col("a") - F.col("b") > 1)
        fit = rows.join(sizes.where(~large).select(*keys), keys, "left_semi").select("word", "n", *keys)
        out = fit if out is None else out.unionAll(fit)
        again = sizes.where(large).select(*keys)
        if again.isEmpty():
            return out
        rows = rows.join(again, keys, "left_semi").drop("shared")


def common_prefixes(words: list[str]) -> list[int]:
    """For each word the characters it shares at its beginning with the one before (0 for the first)."""
    out = [0] * len(words)
    for i in range(1, len(words)):
        a, b = words[i - 1], words[i]
        top = min(len(a), len(b))
        k = 0
        while k < top and a[k] == b[k]:
            k += 1
        out[i] = k
    return out


def near_later(words: list[str], lcp: list[int], at: int) -> Iterator[int]:
    """Places after `at` in the sorted list whose words are one edit from words[at]."""
    query = words[at]
    size = len(query)
    # rows[d]: the matrix row of the scanned word's first d characters, at query lengths d - 1, d and d + 1.
    rows: list[tuple[int, int, int]] = [(2, 0, 1)]
    i, count, shared = at + 1, len(words), 0
    while i < count:
        word = words[i]
        del rows[shared + 1 :]
        d, failed = shared, False
        p0, p1, p2 = rows[-1]
        top = len(word)
        while d < top:
            c = word[d]
            d += 1
            n0 = p1 + 1
            if 1 < d <= size + 1:
                n0 = min(n0, p0 + (c != query[d - 2]))
            if d <= size:
                n1 = min(p1 + (c != query[d - 1]), p2 + 1, n0 + 1)
            else:
                n1 = 2
            n2 = min(p2 + (c != query[d]), n1 + 1) if d < size else 2
            p0, p1, p2 = n0, n1, n2
            rows.append((p0, p1, p2))
            if p0 > 1 and p1 > 1 and p2 > 1:
                failed = True
                break
        if not failed and abs(top - size) <= 1 and (p0, p1, p2)[size - top + 1] == 1:
            yield i
        i += 1
        if failed:
            while i < count and lcp[i] >= d:
                i += 1
        shared = min(lcp[i], len(rows) - 1) if i < count else 0


def _is_first(u: str, v: str, m: int, path: str) -> bool:
    """Whether no block before this one, in the order of dealing, holds the pair too."""
    a = b = 0
    for side in path:
        half = (m - a - b) // 2
        if side == "p":
            a += half
        elif u[a : a + half] == v[a : a + half]:
            return False
        else:
            b = m - a - half
    return True


def _pairs(m: int, path: str, words: list[str], counts: list[int]) -> Iterator[tuple[str, int, str, int]]:
    lcp = common_prefixes(words)
    for i, u in enumerate(words):
        for j in near_later(words, lcp, i):
            v = words[j]
            if min(len(u), len(v)) == m and _is_first(u, v, m, path):
                yield u, counts[i], v, counts[j]
                yield v, counts[j], u, counts[i]


def near_pairs(vocabulary: DataFrame, limit: int = BLOCK_WORDS, shortest: int = 1) -> DataFrame:
    """(word, n) -> (word, n, near, near_n): each pair of words one edit apart, both ways."""
    keys = ["m", "path", "shared"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("word", pa.string()), ("n", pa.int64()), ("near", pa.string()), ("near_n", pa.int64())])
        now, words, counts, found = None, [], [], []

        def flush() -> pa.RecordBatch:
            columns = list(zip(*found)) or [[]] * 4
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

        for batch in batches:
            for m, path, shared, word, n in zip(*[batch.column(c).to_pylist() for c in [*keys, "word", "n"]]):
                if (m, path, shared) != now:
                    if len(words) > 1:
                        found.extend(_pairs(now[0], now[1], words, counts))
                    now, words, counts = (m, path, shared), [], []
                    if len(found) > 10_000:
                        yield flush()
                words.append(word)
                counts.append(n)
        if len(words) > 1:
            found.extend(_pairs(now[0], now[1], words, counts))
        yield flush()

    rows = blocked(vocabulary, limit, shortest)
    # scanning costs far more than its bytes tell, so tasks are cut by rows
    tasks = max(1, -(-rows.count() // TASK_ROWS))
    return rows.repartition(tasks, *keys).sortWithinPartitions(*keys, "word").mapInArrow(lean(scan), _PAIRS)


def _rooted(forms: DataFrame) -> DataFrame:
    """(word, form) -> (word, root). A form is several times as frequent as its word, so chains are short and end; each
    round doubles the steps that a row has taken."""
    now = forms.select("word", F.col("form").alias("root"))
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        now = staged(now.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "spelling-roots")
        if now.where("moved").isEmpty():
            return now.select("word", "root")
        now = now.select("word", "root")


def group_variants(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    typo_every: int = 199,
    min_length: int = 6,
    min_count: int = 5,
    ratio: int = 5,
    limit: int = BLOCK_WORDS,
) -> DataFrame:
    """Each word of the vocabulary: word, form (its most frequent neighbour, if `ratio` times as frequent), root, n,
    n_near (its neighbours), form_n."""
    vocabulary = staged(count_words(docs, id_col, text_col, typo_every, min_length, min_count), "spelling-words")
    best = near_pairs(vocabulary, limit, max(1, min_length)).groupBy("word", "n").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best")
    )
    is_form = -F.col("best.less") >= ratio * F.col("n")
    best = staged(
        best.select(
            "word", "n_near", F.when(is_form, F.col("best.near")).alias("form"), F.when(is_form, -F.col("best.less")).alias("form_n")
        ),
        "spelling-forms",
    )
    roots = _rooted(best.where("form is not null"))
    found = vocabulary.join(best, "word", "left").join(roots, "word", "left")
    return found.select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n"
    )
