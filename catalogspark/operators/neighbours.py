"""Approximate neighbours through inverted lists: k-means centres, probing of the nearest lists, sketches, exact scores.

Each vector of the index stands in the list of its nearest centre, with a sketch: the signs of its products with orthogonal directions, 64
to a number. A query probes the lists of the centres with the largest products, compares sketches there by
their differing bits, and works out the product itself for the nearest `share` of the index only. Lists are
written once, bucketed by (list, part); a list of many rows, equal vectors among them, is split into parts by a hash of the id.

Centres are fitted by Spark's k-means on `SAMPLE` rows at most (those with the least hashes of the id); every row is
listed. A search lets the queries pass the rows of each part in one task, once to count distances and once to score, so that
what moves is the lists, the queries for each list that they probe, and the k best of each part. The centres and the directions are sent to the tasks: `lists` x width and `bits` x width numbers, whatever the index holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import bucketed, written
from .vectors import best_of

SAMPLE, PART_ROWS = 65_536, 65_536


def directions(bits: int, dim: int, seed: int) -> np.ndarray:
    """`bits` directions as columns, orthogonal in groups of `dim`."""
    r = np.random.default_rng(seed)
    groups = [np.linalg.qr(r.standard_normal((dim, dim)))[0] for _ in range(-(-bits // dim))]
    return np.concatenate(groups, axis=1)[:, :bits]


def _sketches(v: np.ndarray, sides: np.ndarray) -> np.ndarray:
    """Signs of the products, 64 to a signed number."""
    packed = np.packbits(v @ sides > 0, axis=1)
    return np.ascontiguousarray(packed).view(np.int64)


class InvertedLists:
    """The written lists of an index (id, embedding). Vectors that are null or of another width than `dim` are left out."""

    def __init__(self, index: DataFrame, dim: int, lists: int = 16, bits: int = 256, seed: int = 0, part_rows: int = PART_ROWS):
        if bits % 64:
            raise ValueError("bits must be a multiple of 64")
        self.dim, self.bits, self.seed = dim, bits, seed
        fit = index.where(F.size("embedding") == dim).select("id", F.col("embedding").cast("array<double>").alias("embedding"))
        sample = written(fit.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select(array_to_vector("embedding").alias("features")), "lists-sample")
        self.rows = fit.count()
        if self.rows > 1:
            fitted = KMeans(k=min(lists, self.rows), seed=seed, maxIter=12).fit(sample)
            self.centres = np.array(fitted.clusterCenters())
        else:
            self.centres = np.zeros((1, dim))
        own = written(self._laid(fit, "id", 1), "lists-rows").withColumn("list", F.col("lists")[0]).drop("lists")
        self.sizes = written(own.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / part_rows).cast("int").alias("parts")), "lists-sizes")
        part = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")  # a row of sizes for each list
        self.table = bucketed(own.join(F.broadcast(self.sizes), "list").withColumn("part", part).drop("parts"), "lists", ["list", "part"])

    def _laid(self, vectors: DataFrame, key: str, n: int) -> DataFrame:
        """(key, lists, sketch, embedding): the `n` best lists of each vector and its sketch. Rows of an index go to the nearest
        centre, queries (n > 1) to those with the largest products."""
        centres, sides = self.centres, directions(self.bits, self.dim, self.seed)
        less = 0.5 * (centres**2).sum(1) if n == 1 else 0.0
        n = min(n, len(centres))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                v = np.array(batch.column("embedding").to_pylist(), np.float64)
                best = np.argsort(less - v @ centres.T, axis=1, kind="stable")[:, :n].astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(key), pa.array(list(best)), pa.array(list(_sketches(v, sides))), batch.column("embedding")],
                    names=[key, "lists", "sketch", "embedding"],
                )

        kind = vectors.schema[key].dataType.simpleString()
        return vectors.mapInArrow(run, f"{key} {kind}, lists array<int>, sketch array<long>, embedding array<double>")

    def search(self, queries: DataFrame, k: int, probes: int = 12, share: float = 0.15) -> DataFrame:
        """(query_id, id, score, place, scored): the k best of what was scored, and how many rows that was.

        Vectors that are null or of another width find nothing. A cut takes in whole distances, as far as `share` of the
        index's rows goes, one distance at least.
        """
        fit = queries.where(F.size("embedding") == self.dim).select("query_id", F.col("embedding").cast("array<double>").alias("embedding"))
        asked = written(self._laid(fit, "query_id", max(2, probes)), "lists-asked")
        spread = asked.select("query_id", F.explode("lists").alias("list"), F.col("sketch").alias("q_sketch")).join(F.broadcast(self.sizes), "list")
        spread = spread.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
        kind = asked.schema["query_id"].dataType.simpleString()
        counts = self._beside(spread, ["sketch"]).mapInArrow(_distances, f"query_id {kind}, apart int, n long").groupBy("query_id", "apart").agg(F.sum("n").alias("n"))
        # at most bits + 1 rows for each query
        upto = F.sum("n").over(Window.partitionBy("query_id").orderBy("apart"))
        first = F.row_number().over(Window.partitionBy("query_id").orderBy("apart"))
        fits = counts.select("query_id", "apart", upto.alias("upto"), first.alias("first")).where((F.col("upto") <= share * self.rows) | (F.col("first") == 1))
        cut = written(fits.groupBy("query_id").agg(F.max("apart").cast("int").alias("cut"), F.max("upto").alias("scored")), "lists-cut")
        told = spread.join(asked.select("query_id", "embedding"), "query_id").join(cut.select("query_id", "cut"), "query_id")
        ids = self.table.schema["id"].dataType.simpleString()
        scored = self._beside(told, ["sketch", "embedding", "cut"]).mapInArrow(_nearest(k), f"query_id {kind}, id {ids}, score double")
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
        best = scored.withColumn("place", place).where(F.col("place") <= k)
        return best.join(cut, "query_id").select("query_id", "id", "score", "place", "scored")

    def _beside(self, spread: DataFrame, columns: list[str]) -> DataFrame:
        """The rows of each part of a list (side 0) and behind them the queries that probe it (side 1), in one partition, with the `columns` of both."""
        spread = spread.withColumnRenamed("q_sketch", "sketch")
        rows = self.table.withColumn("query_id", F.lit(None).cast(spread.schema["query_id"].dataType)).withColumn("cut", F.lit(None).cast("int"))
        asks = spread.withColumn("id", F.lit(None).cast(self.table.schema["id"].dataType))
        held = ["list", "part", "side", "id", "query_id", *columns]
        both = rows.withColumn("side", F.lit(0)).select(*held).unionByName(asks.withColumn("side", F.lit(1)).select(*held))
        return both.repartition("list", "part").sortWithinPartitions("list", "part", "side")


def _by_part(batches: Iterator[pa.RecordBatch], arrays: dict[str, str]) -> Iterator[tuple[dict, pa.RecordBatch]]:
    """The rows of a part, kept as `arrays` (name: numpy kind) with their ids, beside each batch of the queries that come behind them."""
    at, held, kept = None, [], None
    for batch in batches:
        keys = np.stack([batch.column(c).to_numpy() for c in ("list", "part", "side")], axis=1)
        cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(keys)]):
            if a == b:
                continue
            if at != tuple(keys[a, :2]):
                at, held, kept = tuple(keys[a, :2]), [], None
            own = batch.slice(a, b - a)
            if keys[a, 2] == 0:
                held.append({"id": own.column("id").to_numpy(zero_copy_only=False).copy()} | {c: _wide(own, c, t) for c, t in arrays.items()})
            elif held:
                kept = kept or {c: np.concatenate([h[c] for h in held]) for c in held[0]}
                held = [kept]
                yield kept, own


def _wide(batch: pa.RecordBatch, column: str, kind: str) -> np.ndarray:
    """A column of arrays of one length as the rows of a matrix."""
    return batch.column(column).flatten().to_numpy().astype(kind).reshape(batch.num_rows, -1)


def _apart(sketches: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """In how many bits each sketch differs from the one that is asked for."""
    return np.bitwise_count(sketches ^ asked).sum(1, dtype=np.int64)


def _distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many rows of a part stand at each distance from a query."""
    for rows, asks in _by_part(batches, {"sketch": "uint64"}):
        at, apart, n = [], [], []
        for i, sketch in enumerate(_wide(asks, "sketch", "uint64")):
            found = np.bincount(_apart(rows["sketch"], sketch))
            some = np.flatnonzero(found)
            at.append(np.full(len(some), i))
            apart.append(some.astype(np.int32))
            n.append(found[some])
        yield pa.RecordBatch.from_arrays([asks.column("query_id").take(pa.array(np.concatenate(at))), pa.array(np.concatenate(apart)), pa.array(np.concatenate(n))], names=["query_id", "apart", "n"])


def _nearest(k: int):
    """The k best products of a query in a part, worked out for the rows within its cut only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, asks in _by_part(batches, {"sketch": "uint64", "embedding": "float64"}):
            sketches, vectors, cuts = _wide(asks, "sketch", "uint64"), _wide(asks, "embedding", "float64"), asks.column("cut").to_numpy()
            for i in range(asks.num_rows):
                near = np.flatnonzero(_apart(rows["sketch"], sketches[i]) <= cuts[i])
                if len(near):
                    score = (rows["embedding"][near] @ vectors[i])[None]
                    _, best = best_of(score, rows["id"][near], k)
                    own = asks.column("query_id").take(pa.array(np.full(len(best), i)))
                    yield pa.RecordBatch.from_arrays([own, pa.array(rows["id"][near][best]), pa.array(np.round(score[0, best], 9))], names=["query_id", "id", "score"])

    return run


def knn_approx(queries: DataFrame, index: DataFrame, k: int, dim: int, lists: int = 16, probes: int = 12, bits: int = 256, share: float = 0.15) -> DataFrame:
    """The search of an index that is asked once only."""
    return InvertedLists(index, dim, lists, bits).search(queries, k, probes, share)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(query_id, recall): the share of a query's exact neighbours (query_id, id) among the found ones."""
    hits = exact.select("query_id", "id").join(found.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
    return hits.groupBy("query_id").agg((F.count("hit") / F.count(F.lit(1))).alias("recall"))
