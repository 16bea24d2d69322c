"""Language identification by interpolated Kneser-Ney character models, one per language.

Text is lower-cased, each run of other characters than letters becomes one space, and every character
is predicted from the three before it. Counts of 4-grams come from labelled rows; their lower orders
are the usual continuation counts. A model keeps what reaches 2**-20 of its language's 4-grams, so that
it holds at most 2**20 of them at any size. Per order, the n-grams of all languages stand in one array
sorted by hash, with a column of log probabilities for each language. The language with the lowest mean
negative log probability per character wins. It is rejected when that mean is over a limit that
is calibrated on labelled rows which the counts have not seen.

Bounded sample: fitting takes `fit_rows` rows of each language in expectation (a hash of the id decides),
half a tenth of them for calibration. Every text is predicted, and read whole.

Defined results: null text and text without a letter give `und`, score 0 and rejected; a null label
is never learned; without labelled rows everything is `und`; rows with a null id are predicted,
not learned; repeated rows each get a row; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytesops import U, mix, slices
from .common import bounded_batches, crc32_mod, lean

ORDER, LEAST_SHARE, FIT_ROWS = 4, 2.0**-20, 4000
#: The limit is this many times the mean cross-entropy per character of the language's calibration rows.
REJECT_AT = 2.0
_LETTER = np.zeros(1 << 16, np.uint16)


def _letters() -> np.ndarray:
    if not _LETTER[97]:
        low = np.array([c for c in range(1 << 16) if not 0xD800 <= c < 0xE000 and chr(c).isalpha()])
        _LETTER[low] = low
        _LETTER[32] = 32
    return _LETTER


def characters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """16-bit codes of all texts after normalising, each text behind three spaces, and where texts begin.

    Letters beyond 16 bits are folded into the private-use codes.
    """
    joined = "\x00".join(texts).lower() + "\x00" if all("\x00" not in t for t in texts) else None
    if joined is None:
        joined = "\x00".join(t.replace("\x00", " ") for t in texts).lower() + "\x00"
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    table = _letters()
    wide = code >= 1 << 16
    out = table[np.where(wide, 0, code)]
    if wide.any():
        at = np.flatnonzero(wide)
        letter = np.array([chr(c).isalpha() for c in code[at]])
        out[at[letter]] = (0xE000 + code[at[letter]] % 6400).astype(np.uint16)
    end = code == 0
    out = np.where(out == 0, 32, out).astype(np.uint16)
    keep = (out != 32) | np.concatenate(([True], (out[:-1] != 32) | end[:-1])) | end
    ends = np.cumsum(keep)[end]
    out = out[keep]
    # a text's closing zero became a space; three more stand before each text
    sizes = np.diff(np.concatenate(([0], ends)))
    starts = np.concatenate(([0], np.cumsum(sizes + 3)))
    full = np.full(starts[-1], 32, np.uint16)
    full[np.arange(len(out)) + 3 * (np.repeat(np.arange(len(sizes)), sizes) + 1)] = out
    return full, starts


def grams(code: np.ndarray, order: int, bits: int = 16) -> np.ndarray:
    """The `order` codes ending at each position, packed into 64 bits (the first ones are wrong)."""
    key = code.astype(U)
    for k in range(1, order):
        key[k:] |= code[:-k].astype(U) << U(bits * k)
    return key


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) -> 4-grams counted per batch."""
    for batch in batches:
        langs = np.array(batch.column("lang").to_pylist(), object)
        texts = batch.column("text").to_pylist()
        for lang in dict.fromkeys(langs):
            own = [texts[i] for i in np.flatnonzero(langs == lang)]
            for a, b in slices([len(t) for t in own]):
                code, starts = characters(own[a:b])
                inside = np.ones(len(code), bool)
                for k in range(3):
                    inside[starts[:-1] + k] = False
                key, n = np.unique(grams(code, ORDER)[inside], return_counts=True)
                yield pa.RecordBatch.from_pydict(
                    {"lang": [lang] * len(key), "gram": pa.array(key.view(np.int64)), "n": pa.array(n, pa.int64())}
                )


def _sorted_table(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    hashes = mix(keys)
    by = np.argsort(hashes)
    return hashes[by], np.ascontiguousarray(values[by], np.float32)


def _find(hashes: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    wanted = mix(keys)
    at = np.minimum(np.searchsorted(hashes, wanted), max(0, len(hashes) - 1))
    return at, (hashes[at] == wanted if len(hashes) else np.zeros(len(keys), bool))


class KneserNey:
    """Sorted hash arrays per order: log10-free natural log probabilities, and back-off weights of contexts."""

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]], alphabet: int | None = None, order: int = ORDER, bits: int = 16):
        self.langs, self.bits, top = sorted(counts), bits, order
        per = {lang: {top: counts[lang]} for lang in self.langs}
        for lang in self.langs:
            for order in range(top - 1, 0, -1):  # continuation counts: distinct longer grams with this end
                longer = per[lang][order + 1][0]
                per[lang][order] = np.unique(longer & U((1 << bits * order) - 1), return_counts=True)
        letters = np.unique(np.concatenate([per[x][1][0] for x in self.langs]))
        self.none = np.float32(-np.log(alphabet or len(letters) + 1))
        self.probs: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.backs: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for order in range(1, top + 1):
            keys = np.unique(np.concatenate([per[x][order][0] for x in self.langs]))
            contexts = np.unique(keys >> U(bits))
            lower = self._score(order - 1, keys & U((1 << bits * (order - 1)) - 1)) if order > 1 else None
            prob = np.empty((len(keys), len(self.langs)))
            back = np.zeros((len(contexts), len(self.langs)))
            for k, lang in enumerate(self.langs):
                own, n = per[lang][order]
                n = n.astype(float)
                once, twice = (n == 1).sum(), (n == 2).sum()
                off = min(0.9, max(0.1, once / (once + 2 * twice))) if once and twice else 0.5
                own_ctx, first = np.unique(own >> U(bits), return_index=True)
                total = np.add.reduceat(n, first)
                kinds = np.diff(np.append(first, len(own)))
                weight = np.log(off * kinds / total)
                at_ctx = np.searchsorted(contexts, own_ctx)
                back[at_ctx, k] = weight
                below = lower[:, k] if lower is not None else np.full(len(keys), self.none)
                full = back[np.searchsorted(contexts, keys >> U(bits)), k] + below
                at = np.searchsorted(keys, own)
                which = np.repeat(np.arange(len(own_ctx)), kinds)
                full[at] = np.logaddexp(np.log((n - off) / total[which]), full[at])
                prob[:, k] = full
            self.probs[order] = _sorted_table(keys, prob)
            self.backs[order] = _sorted_table(contexts, back)

    def _score(self, order: int, keys: np.ndarray) -> np.ndarray:
        """Log probabilities, (grams, languages), of the last character of each gram given the others."""
        if order == 0:
            return np.full((len(keys), len(self.langs)), self.none, np.float32)
        hashes, values = self.probs[order]
        at, known = _find(hashes, keys)
        out = values[at]
        miss = np.flatnonzero(~known)
        if len(miss):
            ctx_hashes, weights = self.backs[order]
            at, known = _find(ctx_hashes, keys[miss] >> U(self.bits))
            low = self._score(order - 1, keys[miss] & U((1 << self.bits * (order - 1)) - 1))
            out[miss] = low + np.where(known[:, None], weights[at], 0)
        return out

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Per text its characters (0 without a letter), and the mean negative log probability per language."""
        size = np.zeros(len(texts), np.int64)
        mean = np.zeros((len(texts), len(self.langs)))
        for a, b in slices([len(t) for t in texts], 1 << 18):
            code, starts = characters(texts[a:b])
            score = self._score(ORDER, grams(code, ORDER))
            for k in range(3):
                score[starts[:-1] + k] = 0
            n = np.diff(starts) - 3
            sums = np.add.reduceat(score, starts[:-1], axis=0, dtype=np.float64)
            letters = np.add.reduceat((code != 32).astype(np.int64), starts[:-1])
            size[a:b] = np.where(letters > 0, n, 0)
            mean[a:b] = -sums / n[:, None]
        return size, mean


def fit(docs: DataFrame, lang_col: str, fit_rows: int = FIT_ROWS) -> KneserNey | None:
    """`docs`: text and label columns of the rows to learn from; counted on Spark, kept bounded."""
    found = (
        docs.select(F.col(lang_col).alias("lang"), "text")
        .mapInArrow(lean(_counts), "lang string, gram long, n long")
        .groupBy("lang", "gram")
        .agg(F.sum("n").alias("n"))
    )
    totals = found.groupBy("lang").agg(F.sum("n").alias("total"))
    kept = found.join(totals, "lang").where(F.col("n") >= F.col("total") * LEAST_SHARE).select("lang", "gram", "n")
    table = kept.toArrow()
    langs = np.array(table.column("lang").to_pylist(), object)
    gram = table.column("gram").to_numpy().view(U)
    n = table.column("n").to_numpy()
    counts = {}
    for lang in sorted(set(langs)):
        own = np.flatnonzero(langs == lang)
        own = own[np.argsort(gram[own])]
        counts[lang] = (gram[own], n[own])
    return KneserNey(counts) if counts else None


class Identifier:
    """A fitted model and the limits of rejection, small enough to go to every task."""

    def __init__(self, model: KneserNey | None, limits: dict[str, float]):
        self.model, self.limits = model, limits

    def predict(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Languages, scores and rejections."""
        n = len(texts)
        pred, score, out = np.full(n, "und", object), np.zeros(n), np.ones(n, bool)
        if self.model is not None and n:
            size, mean = self.model.entropies([t or "" for t in texts])
            best = mean.argmin(axis=1)
            low = mean[np.arange(n), best]
            fine = size > 0
            pred[fine] = np.array(self.model.langs, object)[best[fine]]
            sure = 1 / np.exp(-(mean - low[:, None]) * np.minimum(np.maximum(size, 1), 20)[:, None]).sum(axis=1)
            score[fine] = sure[fine]
            limit = np.array([self.limits.get(x, np.inf) for x in self.model.langs])
            out = ~fine | (low > limit[best])
        return pred, score, out


def fit_identifier(labelled: DataFrame, fit_rows: int = FIT_ROWS) -> Identifier:
    """From rows (id, text, lang), none of them null."""
    known = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not known:
        return Identifier(None, {})
    draw = F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(1 << 30)) / float(1 << 30)
    share = F.lit(None)
    for lang, n in known.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, fit_rows / n))).otherwise(share)
    drawn = labelled.withColumn("draw", draw / share).where("draw < 1")
    model = fit(drawn.where("draw < 0.95"), "lang")
    if model is None:
        return Identifier(None, {})
    shared = labelled.sparkSession.sparkContext.broadcast(model)

    def entropy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {x: k for k, x in enumerate(shared.value.langs)}
        for batch in batches:
            size, mean = shared.value.entropies(batch.column("text").to_pylist())
            own = np.array([place.get(x, -1) for x in batch.column("lang").to_pylist()], np.int64)
            fine = (size > 0) & (own >= 0)
            langs = batch.column("lang").filter(pa.array(fine))
            yield pa.RecordBatch.from_pydict({"lang": langs, "h": pa.array(mean[np.arange(len(own)), own][fine])})

    tested = drawn.where("draw >= 0.95").select("lang", "text").mapInArrow(lean(entropy), "lang string, h double")
    means = tested.groupBy("lang").agg(F.avg("h").alias("h")).collect()
    return Identifier(model, {r["lang"]: REJECT_AT * r["h"] for r in means})


def _labelled(docs: DataFrame, id_col: str, text_col: str, lang_col: str, held_out: Column) -> DataFrame:
    rows = bounded_batches(docs).where(~F.coalesce(held_out, F.lit(False))).select(
        F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")
    )
    return rows.where("id is not null and text is not null and lang is not null")


def identify_languages(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    held_out: Column | None = None,
    fit_rows: int = FIT_ROWS,
) -> DataFrame:
    """(id, held_out, lang_pred, score, rejected) of every row of `docs`.

    `held_out`: rows never learned from; by default those whose crc32(id as text) mod 5 is 0.
    """
    held_out = held_out if held_out is not None else crc32_mod(F.col(id_col), 5) == 0
    fitted = fit_identifier(_labelled(docs, id_col, text_col, lang_col, held_out), fit_rows)
    shared = docs.sparkSession.sparkContext.broadcast(fitted)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pred, score, out = shared.value.predict(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_pydict(
                {
                    "id": batch.column("id"),
                    "held_out": batch.column("held_out"),
                    "lang_pred": pa.array(pred.tolist(), pa.string()),
                    "score": pa.array(score),
                    "rejected": pa.array(out),
                }
            )

    rows = bounded_batches(docs).select(
        F.col(id_col).alias("id"),
        F.coalesce(held_out, F.lit(False)).alias("held_out"),
        F.col(text_col).cast("string").alias("text"),
    )
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(
        lean(predict), f"id {kind}, held_out boolean, lang_pred string, score double, rejected boolean"
    )


def keep_identified(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    fit_rows: int = FIT_ROWS,
) -> DataFrame:
    """The rows of `docs`, all columns, that the model doesn't reject."""
    held_out = crc32_mod(F.col(id_col), 5) == 0
    fitted = fit_identifier(_labelled(docs, id_col, text_col, lang_col, held_out), fit_rows)
    shared = docs.sparkSession.sparkContext.broadcast(fitted)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = shared.value.predict(batch.column(text_col).to_pylist())[2]
            yield batch.filter(pa.array(~out))

    return docs.mapInArrow(lean(keep), docs.schema)
