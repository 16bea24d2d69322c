"""Column functions on text. All of them are built from Spark's own functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import dictionaries as D


def tokens(text: Column, fold: bool = False) -> Column:
    """Lower-case runs of letters and digits; `fold` reads marked letters as plain ones (the index side)."""
    low = F.lower(F.coalesce(text, F.lit("")))
    low = F.translate(low, D.MARKED, D.PLAIN) if fold else low
    return F.filter(F.split(low, r"[^\p{L}\p{N}]+"), lambda t: t != "")


def stem(word: Column) -> Column:
    """A word without its plural: `ies` to `y`, `sses` to `ss`, one final s unless ss, us or is."""
    low = F.lower(word)
    n = F.length(low)
    cut = lambda k, end="": F.concat(F.substring(low, F.lit(1), n - k), F.lit(end))
    return (
        F.when(n <= 3, low)
        .when(low.endswith("ies") & (n > 4), cut(3, "y"))
        .when(low.endswith("sses"), cut(2))
        .when(low.endswith("s") & ~low.rlike("(ss|us|is)$"), cut(1))
        .otherwise(low)
    )


def extension(path: Column) -> Column:
    """Lower-case text after the last dot of the name; none for names that only begin with a dot."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.lower(F.regexp_extract(name, r"^.+\.([^.]*)$", 1))


def classify_kind(name: Column, ext: Column, folder: Column) -> Column:
    low, where = F.lower(name), F.lower(F.coalesce(folder, F.lit("")))
    starts = reduce(lambda a, b: a | b, [low.startswith(s) for s in D.CAPTURE_STARTS])
    capture = starts | low.contains("screen capture") | where.contains("screenshot") | where.contains("capture")
    return (
        F.when(ext.isin(D.IMAGE_EXTS), F.when(capture, "screenshot").otherwise("photo"))
        .when(ext.isin(D.VIDEO_EXTS), "video")
        .when(ext.isin(D.AUDIO_EXTS), "audio")
        .when(ext.isin(D.DOC_EXTS), "document")
        .when(ext.isin(D.DESIGN_EXTS), "design")
        .when(ext.isin(D.ARCHIVE_EXTS), "archive")
        .otherwise("other")
    )


def mime_for(ext: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in D.MIME.items() for x in pair])
    return F.coalesce(F.try_element_at(known, ext), F.lit(D.MIME_OTHER))


def is_processable(ext: Column) -> Column:
    return ext.isin(D.PROCESSABLE_EXTS)


def fingerprint(size: Column, modified: Column) -> Column:
    """Size in hex and time of change; contents are never hashed."""
    return F.concat_ws(":", F.lower(F.hex(size)), F.date_format(modified, "yyyy-MM-dd'T'HH:mm:ss"))


def safe_segment(raw: Column, fallback: str = "Unfiled") -> Column:
    """A folder name that every file system takes: at most 60 characters, never empty, never reserved."""
    scrubbed = F.regexp_replace(raw, r'[<>:"/\\|?*\p{Cntrl}]', " ")
    words = F.transform(F.split(F.trim(scrubbed), r"\s+"), lambda w: F.regexp_replace(w, r"^\.+|\.+$", ""))
    clean = F.rtrim(F.substring(F.array_join(F.filter(words, lambda w: w != ""), " "), 1, 60))
    first = F.upper(F.split(clean, r"\.")[0])
    return (
        F.when(raw.isNull() | (clean == ""), F.lit(fallback))
        .when(first.isin(D.RESERVED), F.concat(F.lit("_"), clean))
        .otherwise(clean)
    )


def clean_caption(text: Column) -> Column:
    """One space between words, no article in front, no full stop behind, a capital first; null under 3 letters."""
    one = F.trim(F.regexp_replace(text, r"\s+", " "))
    one = F.regexp_replace(F.regexp_replace(one, r"(?i)^(a|an|the) ", ""), r"[ .]+$", "")
    return F.when(F.length(one) >= 3, F.concat(F.upper(F.substring(one, 1, 1)), F.substring(one, F.lit(2), F.length(one))))


def snippet(text: Column, terms: Column, width: int = 160) -> Column:
    """`width` characters around the first term of two letters or more that occurs; line breaks as spaces."""
    flat = F.regexp_replace(text, r"[\r\n]+", " ")
    low = F.lower(flat)
    at = F.array_min(
        F.filter(F.transform(F.filter(terms, lambda t: F.length(t) > 1), lambda t: F.call_function("locate", F.lower(t), low)), lambda p: p > 0)
    )
    begin = F.greatest(at - width // 2, F.lit(1))
    cut = F.substring(flat, begin, F.lit(width))
    return F.when(
        at.isNotNull(),
        F.concat(F.when(begin > 1, "…").otherwise(""), F.trim(cut), F.when(begin + width <= F.length(flat), "…").otherwise("")),
    )


def hit_snippet(text: Column, path: Column, terms: Column) -> Column:
    """What a search result shows: 160 characters of the text around a term, else 120 of the path, else nothing."""
    return F.coalesce(snippet(text, terms, 160), snippet(path, terms, 120))


def highlight(text: Column, terms: list[str], limit: int = 400) -> Column:
    """The first `limit` characters as segments (text, hit), in order."""
    import re

    body = F.substring(text, 1, limit)
    wanted = "|".join(re.escape(t) for t in sorted(terms, key=len, reverse=True) if t)
    if not wanted:
        return F.array(F.struct(body.alias("text"), F.lit(False).alias("hit")))
    marked = F.regexp_replace(body, f"(?i)({wanted})", "\x01\x02$1\x01")
    parts = F.filter(F.split(marked, "\x01"), lambda p: p != "")
    return F.transform(
        parts, lambda p: F.struct(F.regexp_replace(p, "^\x02", "").alias("text"), p.startswith("\x02").alias("hit"))
    )


def synonym_table(spark: SparkSession) -> DataFrame:
    """(base, name): the other names of a word, keyed by its stem. A fixed table of under 200 words."""
    rows = [(w, o) for group in D.SYNONYMS for w in group.split() for o in group.split()]
    table = spark.createDataFrame(rows, "word string, name string")
    return table.select(stem(F.col("word")).alias("base"), "name").distinct()
