"""Line-first cleaning: each line is judged by rules, failing lines go, and a document that loses too much text goes.

Rules of a line that holds a word (the first that fails names the loss):

* marks: more than one of `#*$%&|<>` for 10 words, or more than one `!` for 3;
* end: under 8 words and no end mark (`.`, `!`, `?`, `:`, `;`, `…`, closing quotes or brackets) at the end;
* capitals: 4 words or more, and over half of the letters are capitals;
* navigation: up to 12 words with a menu phrase;
* boilerplate: up to 40 words with a licence, cookie or copyright phrase;
* repeated: equal to an earlier line of the text, or over half of its words in 3-word windows that the line holds twice.

A document is kept if it passes the base (50 words or more; at most half of its words in 3-word windows found twice or
more in the text, the first included) and if at least `min_share` of its words is left.

Words are runs without the bytes 0x20 and 0x09 to 0x0D. Each document is judged by itself in one pass over Arrow batches of
bounded bytes, so there is no shuffle, no group, and a lost task is run again alone.

Defined results: a null text has no words and isn't kept; an empty one neither; equal rows, null and repeated ids are
judged row by row; an empty table has no rows; other columns are carried, and those that clash with a result are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .bytesops import SPACE, flatten, mix, prefix_hash, slices, spans_hash
from .common import bounded_batches, lean

U = np.uint64
# Phrases of menus, and of licences and notices.
NAVIGATION = [
    "home", "log in", "login", "sign up", "sign in", "next page", "previous page", "read more", "click here", "skip to content",
    "back to top", "site map", "menu", "subscribe", "share this",
]
BOILERPLATE = [
    "licensed under", "all rights reserved", "copyright", "cookie", "terms of use", "terms of service", "privacy policy",
    "enable javascript", "without warranty", "permission is hereby granted", "lorem ipsum",
]
#: Fixed value: what may end a line.
END = r"[.!?:;…][\"'”’»)\]]*$"
RULES = ["marks", "end", "capitals", "navigation", "boilerplate", "repeated"]
MIN_SHARE = 0.5

_GAP = " \t\n\x0b\x0c\r"
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_MARK = re.compile(r"[#*$%&|<>]")
_END = re.compile(END)
_NAVIGATION = re.compile(r"\b(?:" + "|".join(NAVIGATION) + r")\b", re.ASCII)
_BOILERPLATE = re.compile("|".join(BOILERPLATE))
_CAPITAL, _LETTER = re.compile(r"[A-ZÀ-ÖØ-Þ]"), re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]")
_MARK_BYTE = np.zeros(256, bool)
_MARK_BYTE[list(b"#*$%&|<>")] = True
_NEXT = [U(1), U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F)]


def repeated_words(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Per text (words first[i] to first[i + 1]) the words that stand in 3-word windows found twice or more in it."""
    inside = np.zeros(len(hashes) + 1, np.int64)
    if len(hashes) > 2:
        text = np.repeat(np.arange(len(first) - 1), np.diff(first))
        window = mix(hashes[:-2] * _NEXT[0] + hashes[1:-1] * _NEXT[1] + hashes[2:] * _NEXT[2])
        whole = text[:-2] == text[2:]
        keyed = np.where(whole, mix(window ^ mix(text[:-2].astype(U) + U(1))), U(0))
        _, back, times = np.unique(keyed, return_inverse=True, return_counts=True)
        begins = np.flatnonzero(whole & (times[back] > 1))
        covered = np.zeros(len(hashes), bool)
        for k in range(3):
            covered[begins + k] = True
        np.cumsum(covered, out=inside[1:])
    return inside[first[1:]] - inside[first[:-1]]


def failed_rule(line: str, n_words: int, earlier: bool) -> str:
    """The first rule that a line of `n_words` words fails; empty if none."""
    if 10 * len(_MARK.findall(line)) > n_words or 3 * line.count("!") > n_words:
        return "marks"
    if n_words < 8 and not _END.search(line.rstrip(_GAP)):
        return "end"
    if n_words >= 4 and 2 * len(_CAPITAL.findall(line)) > len(_LETTER.findall(line)):
        return "capitals"
    low = line.lower() if n_words <= 40 else ""
    if n_words <= 12 and _NAVIGATION.search(low):
        return "navigation"
    if n_words <= 40 and _BOILERPLATE.search(low):
        return "boilerplate"
    if earlier:
        return "repeated"
    return ""


def _judge(texts: list[str | None]) -> list[tuple]:
    """Per text: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, kept_words, lost lines by rule, kept text."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    buf, starts = flatten(raw)
    gap = SPACE[buf]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], gap)).astype(np.int8)))
    begin, end = edge[0::2], edge[1::2]
    hashes = spans_hash(prefix_hash(buf), begin, end)
    first = np.searchsorted(begin, starts)

    def summed(flags: np.ndarray) -> np.ndarray:
        total = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return total[starts[1:]] - total[starts[:-1]]

    chars = summed(~gap & ((buf & 0xC0) != 0x80))
    marks = summed(_MARK_BYTE[buf])
    repeats = repeated_words(hashes, first)

    # Lines: where each begins, its words, and which of its words repeat within it.
    breaks = np.flatnonzero(buf == 10)
    line_at = np.union1d(starts, breaks + 1)
    line_first = np.searchsorted(begin, line_at)
    line_repeats = repeated_words(hashes, line_first)
    line_words = np.diff(line_first)
    text_line = np.searchsorted(line_at, starts)

    out = []
    for i, text in enumerate(texts):
        seen: set[str] = set()
        kept, lost, kept_words, dup = [], dict.fromkeys(RULES, 0), 0, 0
        for k, line in enumerate((text or "").split("\n"), text_line[i]):
            n = int(line_words[k])
            if n == 0:
                kept.append(line)
                continue
            earlier = line in seen
            dup += earlier
            seen.add(line)
            rule = failed_rule(line, n, earlier or 2 * int(line_repeats[k]) > n)
            if rule:
                lost[rule] += 1
            else:
                kept.append(line)
                kept_words += n
        words = int(first[i + 1] - first[i])
        out.append((words, int(chars[i]), int(marks[i]), dup, int(repeats[i]), kept_words, lost, "\n".join(kept)))
    return out


def clean_lines(
    docs: DataFrame, text_col: str = "text", min_share: float = MIN_SHARE, with_text: bool = True
) -> DataFrame:
    """`docs` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, kept_words,
    lost_lines (rule -> lines) and, `with_text`, clean_text (null where the document isn't kept)."""
    long, flag = T.LongType(), T.BooleanType()
    new = [T.StructField(n, long) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    new += [T.StructField("base_failed", flag), T.StructField("kept", flag), T.StructField("kept_words", long)]
    new += [T.StructField("lost_lines", T.MapType(T.StringType(), T.IntegerType()))]
    new += [T.StructField("clean_text", T.StringType())] * with_text
    names = [f.name for f in new]
    carried = [c for c in docs.columns if c not in names]
    made = docs.select(*[f"`{c}`" for c in carried], docs[f"`{text_col}`"].alias("__line_text"))
    schema = docs.select(*[f"`{c}`" for c in carried]).schema
    types = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.int64(), pa.map_(pa.string(), pa.int32())] + [pa.string()] * with_text

    def judged(texts: list[str | None]) -> list[pa.Array]:
        columns: list[list] = [[] for _ in types]
        for words, chars, marks, dup, repeats, kept_words, lost, text in _judge(texts):
            failed = words < 50 or 100 * repeats > 50 * words
            kept = not failed and kept_words >= min_share * words
            row = (words, chars, marks, dup, repeats, failed, kept, kept_words, list(lost.items()), text if kept else None)
            for column, value in zip(columns, row):
                column.append(value)
        return [pa.array(c, t) for c, t in zip(columns, types)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(len(carried))), 0).to_pylist()
            for a, b in slices(sizes):
                part = batch.slice(a, b - a)
                found = judged(part.column(len(carried)).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns[: len(carried)], *found], names=[*carried, *names])

    return bounded_batches(made).mapInArrow(lean(run), T.StructType([*schema.fields, *new]))
