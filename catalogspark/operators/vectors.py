"""Vectors: exact and approximate neighbours, spaces, zero-shot shares."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import snippet, tokens
from ..shared import bounded_batches, lean

#: A block of an index takes so much memory, and holds so many rows at least where that leaves cores idle.
BLOCK_BYTES, LEAST_ROWS = 32 << 20, 512
#: Queries that meet a block at once, and their scores.
QUERIES_AT_ONCE, SCORES_AT_ONCE = 128, 1 << 20


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def normalise(v: Column) -> Column:
    """Unit length; a zero vector stays as it is."""
    n = norm(v)
    return F.when(n == 0, v).otherwise(F.transform(v, lambda x: x / n))


def cosine(a: Column, b: Column) -> Column:
    both = norm(a) * norm(b)
    return F.when((F.size(a) != F.size(b)) | (both == 0), 0.0).otherwise(dot(a, b) / both)


def upsert_vectors(index: DataFrame, new: DataFrame, space: str, dim: int) -> DataFrame:
    """New rows replace old ones of the same id; rows of another space or width are dropped."""
    fits = (F.col("space") == space) & (F.size("embedding") == dim)
    new = new.where(fits)
    return index.where(fits).join(new.select("id"), "id", "left_anti").unionByName(new)


def best_of(score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of each row's k best by (score to 9 places, smallest id)."""
    near = np.round(score, 9)
    k = min(k, near.shape[1])
    least = -np.partition(-near, k - 1, axis=1)[:, k - 1]
    rows, at = np.nonzero(near >= least[:, None])
    by = np.lexsort((ids[at], -near[rows, at], rows))
    rows, at = rows[by], at[by]
    place = np.arange(len(rows)) - np.searchsorted(rows, rows)
    return rows[place < k], at[place < k]


def knn(queries: DataFrame, index: DataFrame, k: int, l2: bool = False) -> DataFrame:
    """(query_id, id, score, place): the k best by inner product, or by 1 - distance. Exact.

    Null and empty vectors and those with a null find nothing, and no vector finds one of another width. The index is dealt into blocks of `BLOCK_BYTES` at
    most by a hash of its rows and moves once; queries go to every block. A task holds one block, lets the queries that are sorted
    behind it pass in batches and answers each with the block's k best, which meet per query. Nothing passes through the driver but the size of the index.
    """
    rows = _sized(index, "id")
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.max("w").alias("w")).first()
    if not size["n"]:
        return queries.select(F.col("query_id").cast("long").alias("query_id"), F.lit(0).cast("long").alias("id"), F.lit(0.0).alias("score"), F.lit(1).alias("place")).limit(0)
    cores = queries.sparkSession.sparkContext.defaultParallelism
    n = max(-(-size["n"] * size["w"] * 8 // BLOCK_BYTES), min(cores, -(-size["n"] // LEAST_ROWS)))
    dealt = rows.withColumns({"block": F.pmod(F.xxhash64("id", "embedding"), F.lit(n)).cast("int"), "side": F.lit(0)})
    asked = _sized(queries, "query_id").withColumns({"block": F.explode(F.sequence(F.lit(0), F.lit(n - 1))), "side": F.lit(1)})
    laid = dealt.unionByName(asked).repartition(n, "block").sortWithinPartitions("block", "w", "side")
    out = bounded_batches(laid).mapInArrow(lean(_best_in_blocks(k, l2)), "query_id long, id long, score double").withColumn("score", F.round("score", 9))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return out.withColumn("place", place).where(F.col("place") <= k)


def _sized(vectors: DataFrame, key: str) -> DataFrame:
    kept = vectors.where((F.size("embedding") > 0) & F.forall("embedding", lambda x: x.isNotNull()))
    return kept.select(F.col(key).cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"), F.size("embedding").alias("w"))


def _best_in_blocks(k: int, l2: bool):
    """Batches sorted by (block, w, side): rows of the index (side 0) are kept until the next block, queries (side 1) are answered from them."""

    def scores(q: np.ndarray, v: np.ndarray) -> np.ndarray:
        if not l2:
            return q @ v.T
        step = max(1, (1 << 22) // v.size)  # differences of a few queries at a time
        return 1 - np.sqrt(np.concatenate([((q[a : a + step, None, :] - v[None]) ** 2).sum(-1) for a in range(0, len(q), step)]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, held = None, [], []
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in ("block", "w", "side")], axis=1)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(keys)]):
                if a == b:
                    continue
                block, w, side = map(int, keys[a])
                own = batch.column("id").to_numpy()[a:b]
                v = batch.column("embedding").slice(a, b - a).flatten().to_numpy().reshape(-1, w)
                if at != (block, w):
                    at, ids, held = (block, w), [], []
                if side == 0:
                    ids.append(own.copy())
                    held.append(v.copy())
                    continue
                if not held:
                    continue
                if len(held) > 1:
                    ids, held = [np.concatenate(ids)], [np.concatenate(held)]
                step = min(QUERIES_AT_ONCE, max(1, SCORES_AT_ONCE // len(held[0])))
                for c in range(0, len(v), step):
                    score = scores(v[c : c + step], held[0])
                    row, col = best_of(score, ids[0], k)
                    yield pa.RecordBatch.from_arrays([pa.array(own[c + row]), pa.array(ids[0][col]), pa.array(score[row, col])], names=["query_id", "id", "score"])

    return run


def similar_files(index: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """Neighbours of stored vectors, themselves left out, scores held to 0..1."""
    asked = index.join(wanted.select("id"), "id", "left_semi").select(F.col("id").alias("query_id"), "embedding")
    found = knn(asked, index, k + 1).where("query_id <> id")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    found = found.withColumn("place", place).where(F.col("place") <= k)
    return found.withColumn("score", F.least(F.greatest("score", F.lit(0.0)), F.lit(1.0)))


def zero_shot_scores(images: DataFrame, prompts: DataFrame, scale: float = 100.0) -> DataFrame:
    """(id, prompt, share): softmax of scaled cosines over a small table of prompts."""
    s = images.join(F.broadcast(prompts.select("prompt", F.col("embedding").alias("p")))).withColumn("s", scale * cosine(F.col("embedding"), F.col("p")))
    w = Window.partitionBy("id")
    e = s.withColumn("e", F.exp(F.col("s") - F.max("s").over(w)))
    return e.select("id", "prompt", (F.col("e") / F.sum("e").over(w)).alias("share"))


def choose_modality(files: DataFrame, pictures: DataFrame, texts: DataFrame, picture_space: bool) -> DataFrame:
    """A file's picture vector if it has one and the space takes pictures, else its text vector."""
    p = pictures.select("file_id", F.col("embedding").alias("__p"))
    t = texts.select("file_id", F.col("embedding").alias("__t"))
    j = files.join(p, "file_id", "left").join(t, "file_id", "left")
    use = F.col("__p").isNotNull() & F.lit(picture_space)
    modality = F.when(use, "picture").when(F.col("__t").isNotNull() & (F.lit(picture_space) | ~F.col("kind").isin("photo", "screenshot")), "text")
    return j.select("file_id", modality.alias("modality"), F.when(use, F.col("__p")).when(modality == "text", F.col("__t")).alias("embedding"))


#: A block of files holds so many at most.
BLOCK_FILES = 32_768


def _beside(full: DataFrame, targets: DataFrame, sets: list[str], same: list[str], score: Callable[[dict], np.ndarray], k: int) -> DataFrame:
    """Each target beside the other rows of `full` that may be its k best by (score to 6 places, least file_id), by what they share with it.

    `full`: file_id, `sets` (distinct long hashes), `same` (long hashes or null) and seconds (or null). Out: target, file_id, for each of the sets s
    n_s_common, n_s and n_s_target, for each of `same` whether it is, and the seconds between them (or NaN). `score` works on such numbers.
    Files are dealt into blocks and move once, targets go to every block; a task holds a block's words by word, and counts what a
    target has in common with all its files at once. A block gives up more than k rows of a target only where rounding leaves the order open.
    """
    n = full.count()
    cores = full.sparkSession.sparkContext.defaultParallelism
    blocks = max(1, -(-n // BLOCK_FILES), min(cores, -(-n // LEAST_ROWS)))
    columns = ["file_id", *sets, *same, "seconds"]
    rows = full.select(F.pmod(F.xxhash64("file_id"), F.lit(blocks)).cast("int").alias("block"), F.lit(0).alias("side"), *columns)
    asked = full.join(targets.select("file_id").distinct(), "file_id", "left_semi")
    asked = asked.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("side"), *columns)
    numbers = [f"n_{s}_common long, n_{s} long, n_{s}_target long" for s in sets] + [f"{c} boolean" for c in same]
    laid = rows.unionByName(asked).repartition(blocks, "block").sortWithinPartitions("block", "side")
    return laid.mapInArrow(_share(sets, same, score, k), ", ".join(["target long", "file_id long", *numbers, "seconds double"]))


def _share(sets: list[str], same: list[str], score: Callable[[dict], np.ndarray], k: int):
    def columns(batches: list[pa.RecordBatch]) -> dict:
        t = pa.Table.from_batches(batches).combine_chunks()
        out = {"file_id": t["file_id"].to_numpy(), "seconds": t["seconds"].cast("float64").to_numpy()}
        for c in same:
            out[c] = (t[c].fill_null(0).to_numpy(), t[c].is_valid().to_numpy())
        for c in sets:
            n = pc.list_value_length(t[c]).to_numpy().astype(np.int64)
            out[c] = (pc.list_flatten(t[c]).to_numpy(), np.append(0, np.cumsum(n)))
        return out

    def by_value(values: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The different values, where each begins, and the rows that hold them."""
        order = np.argsort(values, kind="stable")
        each, first = np.unique(values[order], return_index=True)
        return each, np.append(first, len(order)), np.repeat(np.arange(len(ends) - 1, dtype=np.int32), np.diff(ends))[order]

    def common(held: tuple, own: np.ndarray, n: int) -> np.ndarray:
        each, first, rows = held
        at = np.searchsorted(each, own)
        at = at[(at < len(each)) & (each[np.minimum(at, len(each) - 1)] == own)] if len(each) else at[:0]
        lists = [rows[first[i] : first[i + 1]] for i in at]
        return np.bincount(np.concatenate(lists), minlength=n) if lists else np.zeros(n, np.int64)

    def best(s: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """The k best; where rounding to 6 places may go either way, all that may be."""
        low, high = np.floor((s - 1e-9) * 1e6 + 0.5), np.floor((s + 1e-9) * 1e6 + 0.5)
        if len(s) <= k:
            return np.arange(len(s))
        least = -np.partition(-low, k - 1)[k - 1]
        tied = np.flatnonzero((low == least) & (high == least))
        return np.concatenate([np.flatnonzero((high > least) | ((high == least) & (low < least))), tied[np.argsort(ids[tied], kind="stable")[:k]]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, block = None, [], None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in ("block", "side")], axis=1)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(keys)]):
                if a == b:
                    continue
                if at != keys[a, 0]:
                    at, held, block = keys[a, 0], [], None
                if keys[a, 1] == 0:
                    held.append(batch.slice(a, b - a))
                    continue
                if not held:
                    continue
                if block is None:
                    block = columns(held)
                    values = {c: by_value(*block[c]) for c in sets}
                    sizes = {c: np.diff(block[c][1]) for c in sets}
                    held = [held[0].slice(0, 0)]
                ids, asks = block["file_id"], columns([batch.slice(a, b - a)])
                for i, target in enumerate(asks["file_id"]):
                    found = {"target": np.full(len(ids), target), "file_id": ids}
                    for c in sets:
                        own = asks[c][0][asks[c][1][i] : asks[c][1][i + 1]]
                        found |= {f"n_{c}_common": common(values[c], own, len(ids)), f"n_{c}": sizes[c], f"n_{c}_target": np.full(len(ids), len(own))}
                    for c in same:
                        found[c] = (block[c][0] == asks[c][0][i]) & block[c][1] & asks[c][1][i]
                    found["seconds"] = np.abs(block["seconds"] - asks["seconds"][i])
                    s = score(found)
                    some = np.flatnonzero((s > 0) & (ids != target))
                    some = some[best(s[some], ids[some])]
                    yield pa.RecordBatch.from_pydict({c: v[some] for c, v in found.items()})

    return run


def _set_of(rows: DataFrame, column: str, name: str) -> DataFrame:
    """(file_id, name): the hashes of a file's different values."""
    return rows.groupBy("file_id").agg(F.collect_set(F.xxhash64(column)).alias(name))


def related(files: DataFrame, file_tags: DataFrame, targets: DataFrame, k: int) -> DataFrame:
    """(target, file_id, score, place, reason, snippet): shared tags, overlap of the texts' words of over three bytes,
    folder, project and nearness in time. Words and tags are compared by their 64-bit hashes."""
    none = F.array().cast("array<long>")
    words = F.array_distinct(F.transform(F.filter(tokens(F.col("ocr_text")), lambda w: F.octet_length(w) > 3), lambda w: F.xxhash64(w)))
    hashed = lambda c: F.when(F.col(c).isNotNull(), F.xxhash64(c))
    base = files.where("index_state <> 'missing'").select(
        "file_id", hashed("folder_id").alias("folder"), hashed("project_id").alias("project"), F.unix_timestamp("created_at").alias("seconds"), words.alias("words")
    )
    full = base.join(_set_of(file_tags, "tag", "tags"), "file_id", "left").withColumn("tags", F.coalesce("tags", none))

    def near(x: dict) -> np.ndarray:
        s = 0.45 * x["n_tags_common"] / np.maximum(x["n_tags_target"], 1) + 0.4 * x["n_words_common"] / np.maximum(x["n_words"] + x["n_words_target"] - x["n_words_common"], 1)
        days = x["seconds"] / 86400
        return np.minimum(s + 0.12 * x["folder"] + 0.18 * x["project"] + np.where(days < 1, 0.10, np.where(days < 7, 0.04, 0.0)), 1.0)

    met = _beside(full, targets, ["tags", "words"], ["folder", "project"], near, k).select(
        "target", "file_id", F.col("n_tags_common").alias("shared"), F.col("n_tags_target").alias("n_tags"), F.col("n_words_common").alias("common"),
        (F.col("n_words") + F.col("n_words_target")).alias("n_words"), "folder", "project", (F.col("seconds") / 86400).alias("days"),
    )
    score = (
        0.45 * F.col("shared") / F.greatest("n_tags", F.lit(1))
        + 0.4 * F.col("common") / F.greatest(F.col("n_words") - F.col("common"), F.lit(1))
        + F.when(F.col("folder"), 0.12).otherwise(0.0)
        + F.when(F.col("project"), 0.18).otherwise(0.0)
        + F.when(F.col("days") < 1, 0.10).when(F.col("days") < 7, 0.04).otherwise(0.0)
    )
    reason = F.when(F.col("project"), "project").when(F.col("shared") > 0, "tag").when(F.col("folder"), "folder").otherwise("text")
    scored = met.select("target", "file_id", F.round(F.least(score, F.lit(1.0)), 6).alias("score"), reason.alias("reason")).where("score > 0.05")
    place = F.row_number().over(Window.partitionBy("target").orderBy(F.desc("score"), "file_id"))
    best = scored.withColumn("place", place).where(F.col("place") <= k)
    texts = files.select("file_id", F.col("ocr_text").alias("text"))
    asked = F.filter(tokens(F.col("t_text")), lambda w: F.octet_length(w) > 3)
    both = best.join(texts, "file_id").join(texts.toDF("target", "t_text"), "target")
    return both.select("target", "file_id", "score", "place", "reason", snippet(F.col("text"), F.array_distinct(asked), 120).alias("snippet"))


def related_simple(files: DataFrame, file_tags: DataFrame, members: DataFrame, targets: DataFrame, k: int) -> DataFrame:
    """(target, file_id, score, place): 2 per shared tag, 1.5 for a shared collection, 0.75 folder, 0.4 kind."""
    none = F.array().cast("array<long>")
    hashed = lambda c: F.when(F.col(c).isNotNull(), F.xxhash64(c))
    full = files.select("file_id", hashed("folder_id").alias("folder"), hashed("kind").alias("kind"), F.lit(None).cast("long").alias("seconds"))
    full = full.join(_set_of(file_tags, "tag", "tags"), "file_id", "left")
    full = full.join(_set_of(members, "collection_id", "groups"), "file_id", "left").withColumns({c: F.coalesce(c, none) for c in ("tags", "groups")})
    near = lambda x: 2.0 * x["n_tags_common"] + 1.5 * (x["n_groups_common"] > 0) + 0.75 * x["folder"] + 0.4 * x["kind"]
    score = 2.0 * F.col("n_tags_common") + F.when(F.col("n_groups_common") > 0, 1.5).otherwise(0.0) + F.when(F.col("folder"), 0.75).otherwise(0.0) + F.when(F.col("kind"), 0.4).otherwise(0.0)
    met = _beside(full, targets, ["tags", "groups"], ["folder", "kind"], near, k)
    scored = met.select("target", "file_id", score.alias("score")).where("score > 0")
    place = F.row_number().over(Window.partitionBy("target").orderBy(F.desc("score"), "file_id"))
    return scored.withColumn("place", place).where(F.col("place") <= k)
