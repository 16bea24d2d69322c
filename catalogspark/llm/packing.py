"""Cost-balanced packing of tokenised documents into sequences.

A document is its token ids and one end id. Its whole stretches of `length` ids are sequences of their own. What is
left of each document is packed block by block (a hash of the row picks the block, about `BLOCK_DOCS` documents
each): longest first, each goes to the open sequence of the lowest attention cost (linear + quadratic in the pieces'
lengths) that still has room for it; if none has, it is cut at the room of the lowest-cost one. A block opens just as many
sequences as its ids fill. The last of them is dealt into sequences of powers of two, which need no padding.

Tokenising is per word between white space, as the tokeniser's own rules never look across white space. A task hashes
the words of many texts at once and finds their ids in sorted arrays of the words met so far; only new words go through
the tokeniser. A full stop or comma behind a letter is looked up by itself, and A-Z as a-z, as the tokeniser does. A
tokeniser whose file states other rules encodes whole texts. Words are told apart by 64-bit hashes; the arrays keep
`CACHE_WORDS` words, those used most, which changes the time but no result.

Defined results: null and empty texts are the end id alone; rows that repeat are each packed; rows with a null id are
packed under the null id; extra columns are ignored; an empty table gives no pieces.
"""

from __future__ import annotations

import json
import unicodedata
import zlib
from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytesops import SPACE, U, flatten, prefix_hash, slices, spans_hash
from .common import bounded_batches, held, lean

LENGTH, END_ID, BLOCK_DOCS = 2048, 1, 4_000
LINEAR, QUADRATIC = 1.0, 1.0 / 4096
CACHE_WORDS = 400_000
#: Rules under which a text's ids are those of its words: what a file states under `normalizer` and `pre_tokenizer`.
_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
_PRETOKENIZERS = [
    {"type": "Split", "pattern": {"Regex": _PIECES}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[65:91] = _ASCII_LETTER[97:123] = True
#: First bytes of two-byte characters that are all letters, but for the two signs at 0xC3 0x97 and 0xC3 0xB7.
_LEAD = np.zeros(256, bool)
_LEAD[[0xC3, 0xC4, 0xC5, 0xC6, 0xC7, 0xC8, 0xC9, 0xD0, 0xD1]] = True


class Encoder:
    """texts -> the uint32 ids of each, as bytes."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            stated = json.load(f)
        rules = [(stated.get("normalizer") or {}).get("normalizers"), (stated.get("pre_tokenizer") or {}).get("pretokenizers")]
        special = [t for t in stated["added_tokens"] if t["special"] and not (t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"])]
        plain = stated.get("post_processor") is None and stated["model"]["type"] == "BPE" and not stated.get("truncation")
        self.by_word = rules == [_NORMALIZERS, _PRETOKENIZERS] and bool(special) and plain and len(special) == len(stated["added_tokens"])
        if not self.by_word:
            return
        self.marker, self.marks = special[0]["content"], [t["content"] for t in special]
        self.marker_id = special[0]["id"]
        #: For words of letters, which are one piece each: the same model without the search for pieces.
        self.light = Tokenizer(self.tokenizer.model)
        self.light.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        suffix = stated["model"].get("end_of_word_suffix") or "\x00"
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        for token, k in vocab.items():
            self.ends[k] = token.endswith(suffix)
        #: Sorted hashes of known words; their uses, places and numbers of ids in `pool`.
        self.keys, self.pool = np.zeros(0, U), np.zeros(0, np.uint32)
        self.uses, self.place, self.size = (np.zeros(0, np.int64) for _ in range(3))
        self.tail = [self._any([mark])[0] for mark in (",", ".")]

    def _lines(self, lines: list[str], light: bool = False) -> np.ndarray:
        found = (self.light if light else self.tokenizer).encode_batch_fast(lines, add_special_tokens=False)
        return np.array([i for x in found for i in x.ids], np.uint32)

    def _letters(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of letters only, and how many each has: each is one piece, whose last token closes a word."""
        lines = [unicodedata.normalize("NFC", " ".join(words[k : k + 500])) for k in range(0, len(words), 500)]
        # Python lower-cases one letter by where it stands, the tokeniser none
        light = not any("\u03a3" in line for line in lines)
        ids = self._lines([line.lower() for line in lines] if light else lines, light)
        edges = np.flatnonzero(self.ends[ids]) + 1
        return (ids, np.diff(edges, prepend=0)) if len(edges) == len(words) else self._any(words)

    def _any(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of any words, and how many each has: a special token, which is in no word, stands behind each."""
        odd = [k for k, w in enumerate(words) if any(m in w for m in self.marks)]
        part = list(words)
        for k in odd:
            part[k] = ""
        ids = self._lines([f" {self.marker} ".join([*part[k : k + 500], ""]) for k in range(0, len(part), 500)])
        edges = np.flatnonzero(ids == self.marker_id)
        ids, size = ids[ids != self.marker_id], np.diff(edges, prepend=-1) - 1
        for k in odd:
            own = np.array(self.tokenizer.encode(words[k], add_special_tokens=False).ids, np.uint32)
            ids, size[k] = np.insert(ids, int(size[:k].sum()), own), len(own)
        return ids, size

    def _learn(self, hashes: np.ndarray, words: list[str]) -> None:
        """Put new words, by ascending hash, into the arrays."""
        alpha = np.array([w.isalpha() for w in words])
        size, place = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        for own, encode in ((np.flatnonzero(alpha), self._letters), (np.flatnonzero(~alpha), self._any)):
            if len(own):
                ids, size[own] = encode([words[k] for k in own.tolist()])
                place[own] = len(self.pool) + np.cumsum(size[own]) - size[own]
                self.pool = np.concatenate([self.pool, ids])
        at = np.searchsorted(self.keys, hashes)
        self.keys, self.place = np.insert(self.keys, at, hashes), np.insert(self.place, at, place)
        self.size, self.uses = np.insert(self.size, at, size), np.insert(self.uses, at, 0)

    def _forget(self) -> None:
        """Keep the half of `CACHE_WORDS` that is used most."""
        keep = np.sort(np.argsort(-self.uses, kind="stable")[: CACHE_WORDS // 2])
        size = self.size[keep]
        self.pool = self.pool[_ragged(self.place[keep], size)]
        self.keys, self.uses, self.size, self.place = self.keys[keep], self.uses[keep] // 2, size, np.cumsum(size) - size

    def encode(self, texts: list[bytes]) -> list[bytes]:
        if not self.by_word:
            found = self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)
            return [np.array(x.ids, np.uint32).tobytes() for x in found]
        buf, starts = flatten(texts)
        edge = np.flatnonzero(np.diff(np.concatenate(([True], SPACE[buf])).astype(np.int8)))
        begin, end = edge[0::2], edge[1::2]
        first = np.searchsorted(begin, starts)
        # a closing comma or full stop behind a letter
        last, prior, lead = buf[end - 1], buf[np.maximum(end - 2, 0)], buf[np.maximum(end - 3, 0)]
        letter = (end - begin > 1) & _ASCII_LETTER[prior]
        letter |= (end - begin > 2) & _LEAD[lead] & (prior & 0xC0 == 0x80) & ~((lead == 0xC3) & ((prior == 0x97) | (prior == 0xB7)))
        tail = np.where(letter & (last == 0x2C), 1, np.where(letter & (last == 0x2E), 2, 0))
        end = end - (tail > 0)
        hashes = spans_hash(prefix_hash(buf, lower=True), begin, end)
        at = np.searchsorted(self.keys, hashes)
        new = np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] != hashes) if len(self.keys) else np.arange(len(hashes))
        if len(new):
            fresh, one = np.unique(hashes[new], return_index=True)
            data = buf.tobytes()
            self._learn(fresh, [data[a:b].decode() for a, b in zip(begin[new[one]].tolist(), end[new[one]].tolist())])
            at = at + np.searchsorted(fresh, hashes)
        self.uses += np.bincount(at, minlength=len(self.keys))
        # each word's ids and those of its tail, which stand behind the pool
        pool = np.concatenate([self.pool, *self.tail])
        place, size = np.empty(2 * len(at), np.int64), np.empty(2 * len(at), np.int64)
        place[0::2], size[0::2] = self.place[at], self.size[at]
        behind = np.array([0, len(self.tail[0]), len(self.tail[1])])
        place[1::2] = len(self.pool) + np.where(tail == 2, behind[1], 0)
        size[1::2] = behind[tail]
        ids = pool[_ragged(place, size)].tobytes()
        cuts = (4 * np.concatenate(([0], np.cumsum(size)))[2 * first]).tolist()
        if len(self.keys) > CACHE_WORDS:
            self._forget()
        return [ids[a:b] for a, b in zip(cuts, cuts[1:])]

    def __call__(self, texts: list[str]) -> list[bytes]:
        return self.encode([t.encode() for t in texts])


def _ragged(place: np.ndarray, size: np.ndarray) -> np.ndarray:
    """place[0], place[0] + 1, ... (size[0] of them), place[1], ..."""
    before = np.cumsum(size) - size
    return np.arange(int(size.sum())) + np.repeat(place - before, size)


def encoder(path: str) -> Encoder:
    """The worker's encoder, kept for its later batches."""
    return held(f"packing {path}", lambda: Encoder(path))


def _tokenise(path: str, length: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoder(path)
        end, step = np.array([end_id], "<u4").tobytes(), 4 * length
        for batch in batches:
            texts = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
            for a, b in slices([len(t) for t in texts], 1 << 21):
                part = batch.slice(a, b - a)
                ids = [x + end for x in known.encode(texts[a:b])]
                whole = [len(x) // step for x in ids]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("id"),
                        pa.array([len(x) // 4 for x in ids], pa.int64()),
                        pa.array(
                            [[zlib.crc32(x[k * step : (k + 1) * step]) for k in range(n)] for x, n in zip(ids, whole)],
                            pa.list_(pa.int64()),
                        ),
                        pa.array([x[n * step :] for x, n in zip(ids, whole)], pa.binary()),
                    ],
                    names=["id", "tokens", "whole", "rest"],
                )

    return run


def assign(sizes: np.ndarray, length: int) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, size, sequence, offset) of documents of less than `length` ids each."""
    total = int(sizes.sum())
    room = [length] * (total // length)
    left = total % length
    room += [1 << k for k in range(left.bit_length() - 1, -1, -1) if left >> k & 1]
    room_left = np.array(room, np.int64)
    cost, filled = np.zeros(len(room)), np.zeros(len(room), np.int64)
    out = []
    for doc in np.argsort(-sizes, kind="stable").tolist():
        start, need = 0, int(sizes[doc])
        while need:
            open_at = np.flatnonzero(room_left >= need)
            if not len(open_at):
                open_at = np.flatnonzero(room_left)
                # a cut: of the roomiest sequences the cheapest, so that documents fall into few pieces
                open_at = open_at[room_left[open_at] == room_left[open_at].max()]
            seq = int(open_at[cost[open_at].argmin()])
            size = min(need, int(room_left[seq]))
            out.append((doc, start, size, seq, int(filled[seq])))
            cost[seq] += LINEAR * size + QUADRATIC * size * size
            filled[seq] += size
            room_left[seq] -= size
            start, need = start + size, need - size
    return out


def _pack(length: int):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        ids, tokens = pdf["id"].to_list(), pdf["tokens"].to_numpy()
        rest = pdf["rest"].to_list()
        first = int(key[0]) << 32
        rows = []
        local = 0
        for doc, crcs in enumerate(pdf["whole"]):
            for k, crc in enumerate(crcs):
                rows.append((ids[doc], k * length, length, int(crc), tokens[doc], first + local, 0))
                local += 1
        for doc, start, size, seq, offset in assign(np.array([len(x) // 4 for x in rest]), length):
            crc = zlib.crc32(rest[doc][4 * start : 4 * (start + size)])
            at = int(tokens[doc]) // length * length + start
            rows.append((ids[doc], at, size, crc, tokens[doc], first + local + seq, offset))
        return pd.DataFrame(
            rows, columns=["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        ).astype({"id": "Int64"})

    return run


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = LENGTH,
    end_id: int = END_ID,
    block_docs: int = BLOCK_DOCS,
) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens, sequence_id, offset), one row per piece."""
    rows = bounded_batches(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    blocks = max(1, ceil(rows.count() / block_docs))
    made = rows.mapInArrow(
        lean(_tokenise(tokenizer_path, length, end_id), "packing"), "id long, tokens long, whole array<long>, rest binary"
    )
    block = F.pmod(F.xxhash64("id", "tokens", "rest"), F.lit(blocks)).cast("long")
    return (
        made.withColumn("block", block)
        .groupBy("block")
        .applyInPandas(
            _pack(length),
            "id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long",
        )
    )
