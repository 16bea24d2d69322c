"""Exact removal of repeated byte strings with a Burrows-Wheeler transform.

A byte goes if a string of `LENGTH` bytes that covers it also starts anywhere else, in any text.

How it runs:

1. Winnowing picks anchors: of the hashes of all `GRAM`-byte strings that start within a string of LENGTH bytes, the
   least. Two equal strings of LENGTH bytes hold a common anchor, so only surroundings of equal anchors can repeat:
   LENGTH - GRAM bytes to its left, LENGTH bytes from its start on.
2. Anchors that occur once go. Equal surroundings of an anchor are folded into one, with their number; where it is
   two or more, the whole surrounding repeats.
3. Different surroundings of one anchor are dealt into units by the anchor's hash. In a unit their concatenation's
   suffixes are sorted, and intervals are expanded breadth first by backward extension over its Burrows-Wheeler
   transform: a level derives all common prefixes of one length, from short to long, and the expansion stops at
   LENGTH. Neighbours without a boundary by then share LENGTH bytes. Levels under 8 come from the first sort's words.
   As surroundings overlap, equal strings count as a repeat if they stand at two places of the texts.
4. An anchor with more than `HOT_REGIONS` different surroundings would outgrow a unit. Its strings of LENGTH bytes are
   counted one by one in Spark instead (128-bit hashes), which gives the same answer.
5. What repeats is joined back to every place of each surrounding, merged per text and cut out.

Defined results: null text has no bytes; texts under LENGTH bytes keep everything; rows that repeat are repeats of each
other; cutting may split a character, so what is kept are bytes; extra columns are carried along; an empty table gives
an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bytesops import U, flatten, mix, prefix_hash, slices, spans_hash
from .common import bounded_batches, lean, release, staged

LENGTH, GRAM = 200, 80
#: Surroundings of a unit on average, and of one anchor at most before it is counted start by start.
UNIT_REGIONS, HOT_REGIONS = 2000, 4000
_MOST = U((1 << 64) - 1)


def _window(pick, values: np.ndarray, width: int, fill: np.uint64) -> np.ndarray:
    """pick over values[i : i + width] for each i."""
    out, span = values, 1
    while span < width:
        step = min(span, width - span)
        out = pick(out, np.concatenate((out[step:], np.full(min(step, len(out)), fill, U)))[: len(out)])
        span += step
    return out


def _thinned(at: np.ndarray, value: np.ndarray, width: int) -> np.ndarray:
    """Which anchors to keep where one hash recurs closely: no gap within a run exceeds `width`."""
    keep = np.ones(len(at), bool)
    tied = (value[1:] == value[:-1]) & (np.diff(at) <= width)
    last = -1
    for k in (np.flatnonzero(tied[1:] & tied[:-1]) + 1).tolist():  # an equal neighbour on either side
        if keep[k - 1]:
            last = k - 1
        if at[k + 1] - at[last] <= width:
            keep[k] = False
        else:
            last = k
    return keep


def anchors(texts: list[bytes], length: int = LENGTH, gram: int = GRAM):
    """(text, place, hash, left, right, surrounding's hash) of the anchors of all texts."""
    buf, starts = flatten(texts)
    n, sizes = len(buf), np.diff(starts)
    empty = np.zeros(0, np.int64)
    if n <= gram:
        return empty, empty, empty.astype(U), empty, empty, empty.astype(U)
    prefix = prefix_hash(buf)
    end = np.repeat(starts[1:] - 1, sizes)
    place = np.arange(n)
    value = np.full(n, _MOST, U)
    grams = np.arange(n - gram + 1)
    value[grams] = spans_hash(prefix, grams, grams + gram) >> U(1)
    value[place + gram > end] = _MOST
    width = length - gram + 1
    least = _window(np.minimum, value, width, _MOST)
    least[place + length > end] = 0  # no string of `length` bytes starts here
    most = _window(np.maximum, least[::-1], width, U(0))[::-1]
    at = np.flatnonzero((most == value) & (value != _MOST))
    text = np.searchsorted(starts, at, "right") - 1
    keep = _thinned(at, value[at] ^ mix(text), width)
    at, text = at[keep], text[keep]
    left = np.minimum(at - starts[text], length - gram)
    right = np.minimum(end[at] - at, length)
    around = spans_hash(prefix, at - left, at + right) ^ mix(left.astype(U))
    return text, at - starts[text], value[at], left, right, around


def _bytes(column) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def _anchor_rows(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, keys = _bytes(batch.column("text")), batch.column("key").to_numpy()
            for a, b in slices([len(t) for t in texts]):
                text, at, value, left, right, around = anchors(texts[a:b], length, gram)
                yield pa.RecordBatch.from_pydict(
                    {
                        "h": pa.array(value.view(np.int64)),
                        "r": pa.array(around.view(np.int64)),
                        "key": pa.array(keys[a:b][text]),
                        "place": pa.array(at << 16 | left << 8 | right),
                    }
                )

    return run


def suffix_array(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffixes in the order of their first `length` bytes at least, their ranks (ties equal), and which
    neighbours differ within the first 8 bytes."""
    n = len(data)
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    word = np.zeros(n, U)
    for k in range(8):
        word = (word << U(8)) | padded[k : k + n].astype(U)
    order = np.argsort(word, kind="stable").astype(np.int32)
    edge = np.concatenate(([True], word[order][1:] != word[order][:-1]))
    short = edge.copy()
    rank = np.empty(n, np.int32)
    rank[order] = np.cumsum(edge, dtype=np.int32) - 1
    del word
    span = 8
    while span < length and not edge.all():
        # only suffixes that still tie are sorted anew
        size = np.diff(np.append(np.flatnonzero(edge), n))
        tie = np.flatnonzero(np.repeat(size, size) > 1)
        own = order[tie]
        after = np.where(own + span < n, rank[np.minimum(own + span, n - 1)] + 1, 0)
        by = np.lexsort((after, rank[own]))
        own, after = own[by], after[by]
        first = rank[own]
        order[tie] = own
        edge[tie] = np.concatenate(([True], (first[1:] != first[:-1]) | (after[1:] != after[:-1])))
        rank[order] = np.flatnonzero(edge).astype(np.int32)[np.cumsum(edge, dtype=np.int32) - 1]
        span *= 2
    return order, rank, short


def equal_starts(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in an order in which equal first `length` bytes are neighbours, and where a new class begins.

    Zero bytes separate texts; suffixes with a zero byte among their first `length` bytes may be in any class.
    """
    n = len(data)
    order, _, bound = suffix_array(data, length)
    place = np.empty(n, np.int32)
    place[order] = np.arange(n, dtype=np.int32)
    before = np.where(order > 0, order - 1, n - 1)
    step = place[before]  # the last-to-first mapping of the transform
    last = data[before]  # the Burrows-Wheeler transform
    first = place[0]  # nothing stands before it, so it extends to nothing
    begin = np.flatnonzero(bound)
    end = np.append(begin[1:], n)
    for _ in range(8, length):
        if not len(begin):
            break
        size = (end - begin).astype(np.int64)
        member = np.arange(size.sum()) + np.repeat(begin - np.concatenate(([0], np.cumsum(size)[:-1])), size)
        group = np.repeat(np.arange(len(begin)), size) << 8 | last[member]
        inner = member != first
        group, member = group[inner], member[inner]
        by = np.argsort(group, kind="stable")
        group, member = group[by], member[by]
        cut = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        # extremes, not first and last: suffixes that tie over `length` bytes may stand in any order
        low = np.minimum.reduceat(step[member], cut)
        high = np.maximum.reduceat(step[member], cut) + 1
        new = high < n
        new[new] = ~bound[high[new]]
        begin, end = low[new], high[new]
        bound[end] = True
    return order, bound


def repeated_starts(data: np.ndarray, length: int, place: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Marks each start whose `length` bytes also start at another place. `place`: what tells places of the
    corpus apart, as surroundings overlap; `many`: whether the start is known to stand in several places."""
    order, bound = equal_starts(data, length)
    begin = np.flatnonzero(bound)
    low, high = np.minimum.reduceat(place[order], begin), np.maximum.reduceat(place[order], begin)
    twice = (low != high) | np.maximum.reduceat(many[order], begin)
    out = np.zeros(len(data), bool)
    out[order] = np.repeat(twice, np.diff(np.append(begin, len(data))))
    return out


def _runs(marks: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Maximal covered spans of the strings that start at `marks`."""
    at = np.flatnonzero(marks)
    if not len(at):
        return []
    cut = np.flatnonzero(np.diff(at) > length)
    return list(zip(at[np.append(0, cut + 1)].tolist(), (at[np.append(cut, len(at) - 1)] + length).tolist()))


def _expand(length: int):
    """A unit's surroundings -> (h, r, begin, end) relative to the anchor."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates(["h", "r"])
        bodies = pdf["body"].tolist()
        sizes = np.array([len(b) for b in bodies])
        start = np.concatenate(([0], np.cumsum(sizes + 1)))
        data = np.frombuffer(b"\x00".join(bodies) + b"\x00", np.uint8).copy()
        zero = np.ones(len(data), bool)
        zero[start[1:] - 1] = False
        literal = zero & (data == 0)  # zero bytes of the texts themselves get a code that UTF-8 never uses
        data[literal] = 0xFF
        place = np.repeat(pdf["origin"].to_numpy().view(U) - start[:-1].astype(U), sizes + 1) + np.arange(len(data), dtype=U)
        marks = repeated_starts(data, length, place, np.repeat(pdf["many"].to_numpy(), sizes + 1))
        rows = []
        for k, (h, r, left) in enumerate(zip(pdf["h"], pdf["r"], pdf["left"])):
            own = marks[start[k] : start[k] + max(0, sizes[k] - length + 1)]
            rows += [(h, r, a - left, b - left) for a, b in _runs(own, length)]
        del data, zero, literal, place, marks
        release()
        return pd.DataFrame(rows, columns=["h", "r", "begin", "end"]).astype("int64")

    return run


def _cut_bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, wanted surroundings) -> the surroundings' bytes; origin: the place of the first one, as a number."""
    for batch in batches:
        out = {"h": [], "r": [], "hot": [], "many": [], "left": [], "origin": [], "body": []}
        keys = mix(batch.column("__key").to_numpy().view(U)).tolist()
        columns = (keys, _bytes(batch.column("__text")), batch.column("__wanted").to_pylist())
        for key, text, wanted in zip(*columns):
            for w in wanted:
                at, left, right = w["place"] >> 16, w["place"] >> 8 & 0xFF, w["place"] & 0xFF
                out["h"].append(w["h"])
                out["r"].append(w["r"])
                out["hot"].append(w["hot"])
                out["many"].append(w["m"] > 1)
                out["origin"].append((key + at - left) & 0xFFFFFFFFFFFFFFFF)
                out["left"].append(left)
                out["body"].append(text[at - left : at + right])
        out["origin"] = np.array(out["origin"], U).view(np.int64)
        kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.int32(), pa.int64(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds)], names=list(out))


def _starts(length: int):
    """Each string of `length` bytes of a surrounding, by two hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("h", "r", "many", "left", "origin", "body"))
            for h, r, many, left, origin, body in zip(*columns):
                n = len(body) - length + 1
                if n < 1:
                    continue
                data = np.frombuffer(body, np.uint8)
                at = np.arange(n)
                one = spans_hash(prefix_hash(data), at, at + length)
                two = spans_hash(prefix_hash(data ^ 0x55), at, at + length)
                yield pa.RecordBatch.from_pydict(
                    {
                        "s1": pa.array(one.view(np.int64)),
                        "s2": pa.array(two.view(np.int64)),
                        "h": pa.array(np.full(n, h)),
                        "r": pa.array(np.full(n, r)),
                        "begin": pa.array(at - left),
                        "spot": pa.array(at + origin),
                        "many": pa.array(np.full(n, many)),
                    }
                )

    return run


def _remove(carried: list[str], as_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, removed, spans = [], [], []
            for text, found in zip(_bytes(batch.column("__text")), batch.column("__spans").to_pylist()):
                parts, at, gone, runs = [], 0, 0, 0
                for s in sorted((x["begin"], x["end"]) for x in found or ()):
                    begin, end = max(at, s[0]), s[1]
                    if end <= at:
                        continue
                    if s[0] > at or not runs:
                        runs += 1
                    parts.append(text[at:begin])
                    gone += end - begin
                    at = end
                parts.append(text[at:])
                kept.append(b"".join(parts))
                removed.append(gone)
                spans.append(runs)
            own = {c: batch.column(c) for c in carried}
            own["n_bytes"] = pa.array([len(k) + g for k, g in zip(kept, removed)], pa.int64())
            own["n_removed"] = pa.array(removed, pa.int64())
            own["n_spans"] = pa.array(spans, pa.int64())
            if as_text:
                own["kept_text"] = pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string())
            else:
                own["kept_bytes"] = pa.array(kept, pa.binary())
            yield pa.RecordBatch.from_arrays(list(own.values()), names=list(own))

    return run


def remove_repeats(
    docs: DataFrame, text_col: str = "text", length: int = LENGTH, gram: int = GRAM, as_text: bool = False
) -> DataFrame:
    """`docs` without the text, with n_bytes, n_removed, n_spans and kept_bytes (such columns of `docs` give way).

    With `as_text`, kept_text instead of kept_bytes: without the halves of characters that a cut split.
    """
    added = ["n_bytes", "n_removed", "n_spans", "kept_text" if as_text else "kept_bytes"]
    names = [c for c in docs.columns if c not in added and c != text_col]
    carried = [f"c{i}" for i in range(len(names))]  # the columns' names may clash with those used here
    rows = bounded_batches(docs).select(
        *[F.col(f"`{c}`").alias(k) for c, k in zip(names, carried)], F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__text")
    )
    # rows that repeat share a key: their places then count twice, as they should
    rows = rows.withColumn("__key", F.xxhash64(*carried, "__text"))
    found = rows.select(F.col("__key").alias("key"), F.col("__text").alias("text")).mapInArrow(
        lean(_anchor_rows(length, gram)), "h long, r long, key long, place long"
    )
    again = found.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h")
    places = staged(found.join(again, "h"), "repeat-places")
    folded = places.groupBy("h", "r").agg(F.count(F.lit(1)).alias("m"), F.min(F.struct("key", "place")).alias("one"))
    kinds = folded.groupBy("h").agg(F.count(F.lit(1)).alias("kinds"))
    regions = staged(folded.join(kinds, "h"), "repeat-regions")
    sizes = regions.where("kinds > 1").groupBy((F.col("kinds") > HOT_REGIONS).alias("hot")).count().collect()
    size = {r["hot"]: r["count"] for r in sizes}
    hot = F.col("kinds") > HOT_REGIONS
    wanted = (
        regions.where("kinds > 1")
        .select(F.col("one.key").alias("__key"), F.struct("h", "r", "m", hot.alias("hot"), "one.place").alias("w"))
        .groupBy("__key")
        .agg(F.collect_list("w").alias("__wanted"))
    )
    # all columns go into the Python stage, so that this join and the last one read one and the same shuffle
    bodies = rows.join(wanted, "__key").mapInArrow(
        lean(_cut_bodies), "h long, r long, hot boolean, many boolean, left int, origin long, body binary"
    )
    left, right = F.expr("shiftright(one.place, 8) & 255"), F.expr("one.place & 255")
    spans = regions.where(F.col("m") > 1).where(left + right >= length).select(
        "h", "r", (-left).alias("begin"), right.alias("end")
    )
    if size.get(False):
        unit = F.pmod(F.xxhash64("h"), F.lit(ceil(size[False] / UNIT_REGIONS))).cast("int")
        spans = spans.unionAll(
            bodies.where("not hot")
            .groupBy(unit.alias("unit"))
            .applyInPandas(_expand(length), "h long, r long, begin long, end long")
        )
    if size.get(True):
        each = staged(
            bodies.where("hot")
            .dropDuplicates(["h", "r"])
            .mapInArrow(lean(_starts(length)), "s1 long, s2 long, h long, r long, begin long, spot long, many boolean"),
            "repeat-starts",
        )
        twice = (
            each.groupBy("s1", "s2")
            .agg(F.min("spot").alias("low"), F.max("spot").alias("high"), F.max("many").alias("many"))
            .where("low <> high or many")
            .select("s1", "s2")
        )
        spans = spans.unionAll(
            each.join(twice, ["s1", "s2"]).select("h", "r", "begin", (F.col("begin") + length).alias("end"))
        )
    spans = spans.groupBy("h", "r").agg(F.collect_list(F.struct("begin", "end")).alias("spans"))
    at = F.expr("shiftright(place, 16)")
    covered = (
        places.join(spans, ["h", "r"])
        .select("key", F.transform("spans", lambda s: F.struct((at + s["begin"]).alias("begin"), (at + s["end"]).alias("end"))).alias("spans"))
        .groupBy(F.col("key").alias("__key"))
        .agg(F.array_distinct(F.flatten(F.collect_list("spans"))).alias("__spans"))
    )
    kept = docs.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(names, carried)]).schema
    fields = [*kept.fields, *(T.StructField(c, T.LongType()) for c in added[:3]), T.StructField(added[3], T.StringType() if as_text else T.BinaryType())]
    out = rows.join(covered, "__key", "left").mapInArrow(lean(_remove(carried, as_text)), T.StructType(fields))
    return out.toDF(*names, *added)
