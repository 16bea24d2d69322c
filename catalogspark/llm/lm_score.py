"""Language-model scores by a weighted back-off automaton.

Tokens are words (runs without the bytes 0x20 and 0x09 to 0x0D, A-Z as a-z) and one end per text.
The model holds every n-gram of the training texts, up to `order`, however rare, so it grows with them. It interpolates,
P(w|h) = (c(hw) + M P(w|h')) / (c(h) + M) with a prior M per order, and P(w) = (c(w) - D) / N; the mass D V / N is
left to words never trained on, which a Kneser-Ney model of their bytes spells. As an automaton, each n-gram is an arc
to the state of its longest suffix that is a context; each state has a failure arc, of weight log M / (c(h) + M), to
the state of the shorter context. One left-to-right traversal per text carries the state and adds the weights.

Nothing that grows with the corpus is broadcast or held by one task. Texts are dealt into blocks of `BLOCK_BYTES`; each
block sends its distinct n-grams with their training counts to parts by ranges of a hash; each part adds them up and answers each
block with the whole corpus's counts; each block compiles the states and arcs that its texts can reach, slice by slice, and
walks them. The texts are shuffled once. Words have 64-bit hashes, longer n-grams 56-bit ones. Only the byte model is
broadcast: at most 2**24 byte trigrams, whatever the corpus.

Defined results: null and wordless texts are one end token; a null id is neither learned from nor held
out; rows that repeat are each counted and each scored (rows of equal id and text share a block); extra columns are
ignored; without training rows every word is spelled by a flat model; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytesops import U, _LOWER, flatten, mix, slices, words
from .common import bounded_batches, crc32_mod, lean, release
from .language_id import KneserNey, grams

ORDER, DISCOUNT = 3, 0.75
#: Weight of the shorter context, in counts, by order from 2 on (the last for longer ones).
PRIORS = (300.0, 30.0)
SPELL_ORDER = 3
#: Bytes of text in a block, and of all texts to a part of the hash range.
BLOCK_BYTES, PART_BYTES = 8 << 20, 16 << 20
_START, _END = U(0x5B1D2C3E4F607182), U(0xC2A19F8E7D6B5A49)
_LN10 = log(10)


class Block:
    """The n-grams of some texts. Tables: sorted distinct hashes of words and ends, and of all longer n-grams."""

    def __init__(self, texts: list[bytes], order: int = ORDER):
        self.texts, self.order = texts, order
        self.parts = []
        pieces, sizes = [], [np.zeros(1, np.int64)]
        for a, b in slices([len(t) for t in texts]):
            hashes, first, spans = words(texts[a:b])
            starts = first + 2 * np.arange(len(first))
            piece = np.empty(starts[-1], U)
            owner = np.repeat(np.arange(b - a), np.diff(first))
            piece[np.arange(len(hashes)) + 2 * owner + 1] = hashes
            piece[starts[:-1]], piece[starts[1:] - 1] = _START, _END
            self.parts.append((a, b, spans))
            pieces.append(piece)
            sizes.append(np.diff(starts))
        seq = np.concatenate(pieces)
        self.starts = np.cumsum(np.concatenate(sizes))
        self.begins = np.zeros(len(seq), bool)
        self.begins[self.starts[:-1]] = True
        #: Per order the place of the n-gram that ends at each position in its table, or -1.
        self.places = [np.full(len(seq), -1, np.int64)]
        self.words, self.places[0][~self.begins] = np.unique(seq[~self.begins], return_inverse=True)
        fits, full, found, where = ~self.begins, seq, [], []
        for k in range(2, order + 1):
            longer = np.zeros(len(seq), U)
            longer[1:] = mix(full[:-1] * U(0x9E3779B97F4A7C15) + seq[1:] + U(k))
            if k > 2:
                fits = fits & np.concatenate(([False], fits[:-1]))
            found.append(longer[fits] >> U(8))
            where.append(np.flatnonzero(fits))
            full = longer
        self.grams = np.zeros(0, U)
        if found:
            self.grams, inverse = np.unique(np.concatenate(found), return_inverse=True)
            for at, own in zip(where, np.split(inverse, np.cumsum([len(x) for x in where])[:-1])):
                self.places.append(np.full(len(seq), -1, np.int64))
                self.places[-1][at] = own

    def counts(self, trained: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How often the texts marked in `trained` hold each word and each longer n-gram."""
        on = np.repeat(trained, np.diff(self.starts))
        n = [np.bincount(x[on & (x >= 0)]) for x in self.places]
        longer = np.zeros(len(self.grams), np.int64)
        for x in n[1:]:
            longer[: len(x)] += x
        return np.append(n[0], np.zeros(len(self.words) - len(n[0]), np.int64)), longer

    def slices(self) -> Iterator[tuple[int, int, np.ndarray]]:
        yield from self.parts


class Automaton:
    """States and arcs that the texts a to b of a block can reach. `word_counts`, `gram_counts`: the corpus's, in the
    order of the block's tables; `tokens`, `distinct`: N and V."""

    def __init__(self, block: Block, a: int, b: int, word_counts, gram_counts, tokens: int, distinct: int, priors=PRIORS):
        low, high = block.starts[a], block.starts[b]
        self.begins = block.begins[low:high]
        self.starts = block.starts[a : b + 1] - low
        end = np.searchsorted(block.words, _END)
        ends = word_counts[end]
        place = [x[low:high] for x in block.places]
        tables = [word_counts] + [gram_counts] * (len(place) - 1)
        count = [np.where(x >= 0, t[x], 0) if len(t) else np.zeros(high - low) for x, t in zip(place, tables)]
        self.count = count[0]
        count[0] = np.where(self.begins, ends, count[0]).astype(float)
        with np.errstate(divide="ignore", invalid="ignore"):
            prob = (count[0] - DISCOUNT) / tokens if tokens else np.where(place[0] == end, 0.5, 0.0)
        self.rest = max(1e-12, DISCOUNT * distinct / tokens) if tokens else 0.5
        known = (self.count > 0) if tokens else (place[0] == end)
        #: Word of each position by number in the slice; -1 a word to spell.
        numbers, first, word = np.unique(place[0], return_index=True, return_inverse=True)
        self.word = np.where(known & ~self.begins, word, -1)
        with np.errstate(divide="ignore"):
            self.root_weight = np.log(np.maximum(prob[first], 1e-300)).tolist()
        # states: 0 the root, then contexts order by order; a context's state at each position, 0 where there is none
        state, used = [], 1
        self.fail, self.fail_weight = [0], [0.0]
        deep = len(place) > 1 and bool(tokens)
        for k in range(1, len(place) if deep else 1):
            on = np.flatnonzero(count[k - 1] > 0)
            _, one, own = np.unique(place[k - 1][on], return_index=True, return_inverse=True)
            mine = np.zeros(high - low, np.int64)
            mine[on] = used + own
            at = on[one]
            m = priors[min(k - 1, len(priors) - 1)]
            self.fail += (state[-1][at] if state else np.zeros(len(at), np.int64)).tolist()
            self.fail_weight += np.log(m / (count[k - 1][at] + m)).tolist()
            state.append(mine)
            used += len(at)
        self.root_next = state[0][first].tolist() if state else [0] * len(numbers)
        self.first_state = int(state[0][0]) if state and high > low else 0
        self.arcs: dict[int, tuple[float, int]] = {}
        for k in range(2, len(place) + 1 if deep else 2):
            m = priors[min(k - 2, len(priors) - 1)]
            context = np.concatenate(([0.0], count[k - 2][:-1]))
            prob = (count[k - 1] + m * prob) / (context + m)
            on = np.flatnonzero((count[k - 1] > 0) & ~self.begins)
            _, one = np.unique(place[k - 1][on], return_index=True)
            at = on[one]
            goal = state[k - 1][at] if k - 1 < len(state) else state[k - 2][at]
            key = (state[k - 2][at - 1] << 32) | word[at]
            self.arcs.update(zip(key.tolist(), zip(np.log(prob[at]).tolist(), goal.tolist())))

    def walk(self, listed: list[int], spelled: Iterator[float]) -> float:
        """One traversal from the state before a text; `spelled` gives the weights of words of -1, in turn."""
        arcs, fail, back = self.arcs, self.fail, self.fail_weight
        root_weight, root_next = self.root_weight, self.root_next
        state, total = self.first_state, 0.0
        for word in listed:
            arc = arcs.get(state << 32 | word) if word >= 0 else None
            while arc is None and state:
                total += back[state]
                state = fail[state]
                if state and word >= 0:
                    arc = arcs.get(state << 32 | word)
            if arc is not None:
                total += arc[0]
                state = arc[1]
            elif word >= 0:
                total += root_weight[word]
                state = root_next[word]
            else:
                total += next(spelled)
        return total


def spelled_bytes(texts: list[bytes], spans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words' lower-cased bytes, each word behind spaces and before one; where words begin."""
    buf, _ = flatten(texts)
    size = spans[:, 1] - spans[:, 0]
    before = SPELL_ORDER - 1
    begin = np.concatenate(([0], np.cumsum(size + before + 1)))
    code = np.full(begin[-1], 32, np.uint16)
    shift = np.repeat(begin[:-1] + before - np.concatenate(([0], np.cumsum(size)[:-1])), size)
    source = np.repeat(spans[:, 0] - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
    code[shift + np.arange(size.sum())] = _LOWER[buf[source]]
    return code, begin, size


def spell(model: KneserNey | None, texts: list[bytes], spans: np.ndarray) -> np.ndarray:
    """Log probability of the bytes of each word."""
    if not len(spans):
        return np.zeros(0)
    code, begin, _ = spelled_bytes(texts, spans)
    score = model._score(SPELL_ORDER, grams(code, SPELL_ORDER, 8))[:, 0] if model else np.full(len(code), -log(257))
    for k in range(SPELL_ORDER - 1):
        score[begin[:-1] + k] = 0
    return np.add.reduceat(score, begin[:-1], dtype=np.float64)


def _byte_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Byte n-grams of the words of training rows, and under -1 the bytes of all rows."""
    for batch in batches:
        texts = [x or b"" for x in batch.column("text").cast(pa.binary()).to_pylist()]
        keys, times = [np.array([-1])], [np.array([sum(map(len, texts))])]
        own = [t for t, h in zip(texts, batch.column("held").to_pylist()) if h is False]
        for a, b in slices([len(t) for t in own]):
            hashes, _, spans = words(own[a:b])
            if len(hashes):
                _, one, n = np.unique(hashes, return_index=True, return_counts=True)
                code, begin, _ = spelled_bytes(own[a:b], spans[one])
                keep = np.ones(len(code), bool)
                for k in range(SPELL_ORDER - 1):
                    keep[begin[:-1] + k] = False
                key, at = np.unique(grams(code, SPELL_ORDER, 8)[keep], return_inverse=True)
                keys.append(key.view(np.int64))
                times.append(np.bincount(at, np.repeat(n, np.diff(begin))[keep]).astype(np.int64))
        yield pa.RecordBatch.from_pydict({"k": pa.array(np.concatenate(keys)), "n": pa.array(np.concatenate(times))})


def pack(values: np.ndarray) -> bytes:
    """64-bit values, byte plane by byte plane, compressed."""
    planes = np.ascontiguousarray(values.astype(U).view(np.uint8).reshape(-1, 8).T)
    return pa.compress(planes.tobytes(), "zstd", asbytes=True)


def unpack(packed: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(packed, 8 * n, "zstd", asbytes=True), np.uint8).reshape(8, n)
    return np.ascontiguousarray(planes.T).reshape(-1).view(U)


def _texts(table: pa.Table) -> list[bytes]:
    return [x or b"" for x in table.column("text").cast(pa.binary()).to_pylist()]


def _cuts(keys: np.ndarray, width: int, bits: int) -> np.ndarray:
    """Where each of the 2**bits equal ranges of `width`-bit keys begins in the sorted keys, and their end."""
    ranges = np.arange(1, 1 << bits).astype(U) << U(width - bits)
    return np.concatenate(([0], np.searchsorted(keys, ranges), [len(keys)]))


_SENT = "part int, block long, n_words long, n_grams long, words binary, word_n binary, grams binary, gram_n binary"


def _send(order: int, bits: int) -> Callable[[pa.Table], pa.Table]:
    """A block of texts -> a row for each part: the block's n-grams in the part's range and their training counts."""

    def run(table: pa.Table) -> pa.Table:
        block = Block(_texts(table), order)
        word_n, gram_n = block.counts(np.array([h is False for h in table.column("held").to_pylist()]))
        by_word, by_gram = _cuts(block.words, 64, bits), _cuts(block.grams, 56, bits)
        number = table.column("block")[0].as_py()
        out: dict[str, list] = {c.split()[0]: [] for c in _SENT.split(", ")}
        for part in range(1 << bits):
            row = [part, number]
            own = slice(*by_word[part : part + 2]), slice(*by_gram[part : part + 2])
            row += [x.stop - x.start for x in own]
            for keys, n, at in ((block.words, word_n, own[0]), (block.grams, gram_n, own[1])):
                row += [pack(np.diff(keys[at], prepend=U(0))), pack(n[at])]
            for column, value in zip(out.values(), row):
                column.append(value)
        release()
        return pa.table(
            [pa.array(out["part"], pa.int32()), *(pa.array(out[c], pa.int64()) for c in ("block", "n_words", "n_grams"))]
            + [pa.array(out[c], pa.binary()) for c in ("words", "word_n", "grams", "gram_n")],
            names=list(out),
        )

    return run


_ANSWER = "block long, part int, tokens long, distinct_words long, n_words long, n_grams long, word_n binary, gram_n binary"


def _answer(table: pa.Table) -> pa.Table:
    """All blocks' n-grams of a part -> for each block the corpus's counts in its order; the part's share of N and V."""
    sent = table.to_pydict()
    answers = {}
    for keys, times, size in (("words", "word_n", "n_words"), ("grams", "gram_n", "n_grams")):
        key = np.concatenate([np.cumsum(unpack(x, n), dtype=U) for x, n in zip(sent[keys], sent[size])])
        own = np.concatenate([unpack(x, n) for x, n in zip(sent[times], sent[size])])
        _, at = np.unique(key, return_inverse=True)
        total = np.bincount(at, own).astype(np.int64)
        answers[times] = [pack(x) for x in np.split(total[at], np.cumsum(sent[size])[:-1])]
        if keys == "words":
            tokens, distinct = int(total.sum()), int((total > 0).sum())
    m = table.num_rows
    release()
    return pa.table(
        [
            table.column("block"),
            table.column("part"),
            pa.array([tokens] * m, pa.int64()),
            pa.array([distinct] * m, pa.int64()),
            table.column("n_words"),
            table.column("n_grams"),
            pa.array(answers["word_n"], pa.binary()),
            pa.array(answers["gram_n"], pa.binary()),
        ],
        names=[c.split()[0] for c in _ANSWER.split(", ")],
    )


def _score(order: int, priors: tuple[float, ...], shared) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """A block of texts and the corpus's counts of its n-grams -> the texts' scores."""

    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        texts = _texts(table)
        block = Block(texts, order)
        got = sorted(answers.to_pylist(), key=lambda r: r["part"])
        word_n = np.concatenate([unpack(r["word_n"], r["n_words"]) for r in got]).astype(np.int64)
        gram_n = np.concatenate([unpack(r["gram_n"], r["n_grams"]) for r in got]).astype(np.int64)
        tokens, distinct = sum(r["tokens"] for r in got), sum(r["distinct_words"] for r in got)
        spread = log(tokens + 0.5 * (distinct + 1)) / _LN10
        n_tokens, n_known, base, score = [], [], [], []
        for a, b, spans in block.slices():
            model = Automaton(block, a, b, word_n, gram_n, tokens, distinct, priors)
            inner = ~model.begins
            inner[model.starts[1:] - 1] = False
            weights = spell(shared.value, texts[a:b], spans[model.word[inner] < 0]) + log(model.rest)
            spelled, listed = iter(weights.tolist()), model.word.tolist()
            for x, y in zip((model.starts[:-1] + 1).tolist(), model.starts[1:].tolist()):
                own = model.count[x:y]
                n_tokens.append(y - x)
                n_known.append(int((own > 0).sum()))
                base.append(float(np.log10(own + 0.5).sum()) - (y - x) * spread)
                score.append(model.walk(listed[x:y], spelled) / _LN10)
        release()
        return pa.table(
            [
                table.column("id"),
                pa.array([bool(h) for h in table.column("held").to_pylist()]),
                pa.array(n_tokens, pa.int64()),
                pa.array(n_known, pa.int64()),
                pa.array([tokens] * len(texts), pa.int64()),
                pa.array(base, pa.float64()),
                pa.array(score, pa.float64()),
            ],
            names=["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    return run


def score_texts(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    held_out: Column | None = None,
    order: int = ORDER,
    priors: tuple[float, ...] = PRIORS,
) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score), one row per row of `docs`.

    `held_out`: rows not learned from; by default those whose crc32(id as text) mod 5 is 1.
    """
    spark = docs.sparkSession
    mark = held_out if held_out is not None else crc32_mod(F.col(id_col), 5) == 1
    rows = bounded_batches(docs).select(
        F.col(id_col).alias("id"), mark.alias("held"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    )
    # byte n-grams: at most 2**24 rows, as a key is three bytes
    table = (
        rows.select("held", "text").mapInArrow(lean(_byte_grams), "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toArrow()
    )
    key, n = table.column("k").to_numpy(), table.column("n").to_numpy().astype(float)
    size = int(n[key < 0].sum())
    by = np.argsort(key)[(key < 0).sum() :]
    spelling = KneserNey({"": (key[by].view(U), n[by])}, 257, SPELL_ORDER, 8) if len(by) else None
    shared = spark.sparkContext.broadcast(spelling)
    blocks = ceil(size / BLOCK_BYTES) or 1
    bits = max(1, ceil(size / PART_BYTES).bit_length())
    dealt = rows.withColumn("block", F.expr(f"pmod(xxhash64(id, text), {blocks}L)"))
    answers = (
        dealt.groupBy("block")
        .applyInArrow(_send(order, bits), _SENT)
        .groupBy("part")
        .applyInArrow(_answer, _ANSWER)
    )
    kind = rows.schema["id"].dataType.simpleString()
    return (
        dealt.groupBy("block")
        .cogroup(answers.groupBy("block"))
        .applyInArrow(
            _score(order, priors, shared),
            f"id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double",
        )
    )
