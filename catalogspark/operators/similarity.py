"""All pairs of vectors at a least inner product: exact, with pairs of blocks that can't match never made.

Vectors are dealt into blocks by the pivot to which they turn least and by that angle, so a block is a narrow shell about a pivot. A
block knows the range of its members' angles to each pivot. The angle between two vectors is no less than the difference of
their angles to any third, so two blocks whose ranges stand further apart than the threshold allows never meet. How much this leaves out
depends on the data: tight groups far from each other, or high thresholds; evenly spread vectors leave nothing out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import written

PIVOTS, SAMPLE, RINGS = 16, 4096, 512
SLACK = 1e-6


def pivots(rows: DataFrame, dim: int, n: int = PIVOTS) -> np.ndarray:
    """At most `n` directions far from each other, of the `SAMPLE` rows with the least hashes of their id."""
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("embedding").toArrow()
    v = np.array(sample.column(0).to_pylist(), np.float64).reshape(-1, dim)
    if not len(v):
        return np.eye(1, dim)
    v = v / np.linalg.norm(v, axis=1, keepdims=True)
    chosen, near = [0], v @ v[0]
    while len(chosen) < min(n, len(v)) and near.min() < 1 - 1e-9:
        chosen.append(int(near.argmin()))
        near = np.maximum(near, v @ v[chosen[-1]])
    return v[chosen]


class PivotBlocks:
    """The blocks of `rows` (id long, embedding), written once, and the units, the pairs of blocks, that may hold a pair at `threshold` or more.

    Null and zero vectors, those with a null or NaN, and those of another width than `dim` are in no block: they are like nothing. The threshold is above 0.
    """

    def __init__(self, rows: DataFrame, dim: int, threshold: float, block: int = 2048):
        if threshold <= 0:
            raise ValueError("the threshold must be above 0")
        self.threshold = threshold
        wide = rows.where(F.size("embedding") == dim).select("id", F.col("embedding").cast("array<double>").alias("embedding"))
        wide = wide.where(F.exists("embedding", lambda x: x != 0) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x)))
        p = pivots(wide, dim, min(PIVOTS, max(1, -(-wide.count() // block))))  # no more cells than full blocks
        placed = written(wide.mapInArrow(_turns(p), "id long, embedding array<double>, cell int, ring int, turns array<double>, norm double"), "pairs-placed")
        # at most PIVOTS x RINGS rows, whatever the number of vectors
        rings = placed.groupBy("cell", "ring").agg(F.count(F.lit(1)).alias("n"))
        upto = F.sum("n").over(Window.partitionBy("cell").orderBy("ring"))
        rings = rings.withColumn("shell", F.floor((upto - F.col("n")) / block))
        held = F.sum("n").over(Window.partitionBy("cell", "shell"))
        rings = rings.select("cell", "ring", "shell", F.ceil(held / block).alias("parts"))
        part = F.pmod(F.xxhash64("id"), F.col("parts"))
        key = F.concat_ws("-", "cell", "shell", part).alias("block")
        self.rows = placed.join(F.broadcast(rings), ["cell", "ring"]).select("id", "embedding", "turns", "norm", key)
        each = range(len(p))
        ranges = [F.array(*[f(F.col("turns")[i]) for i in each]).alias(name) for f, name in ((F.min, "low"), (F.max, "high"))]
        self.blocks = written(self.rows.groupBy("block").agg(F.count(F.lit(1)).alias("n"), F.max("norm").alias("longest"), *ranges), "pairs-blocks")
        self.units = self._units(len(p))

    def _units(self, pivots: int) -> DataFrame:
        """(lo, hi, pairs): blocks whose ranges come near enough. They meet by equality on slices of the first pivot's angle."""
        longest = self.blocks.agg(F.max("longest")).first()[0] or 1.0
        limit = math.acos(min(1.0, max(0.0, self.threshold - SLACK) / longest**2)) + SLACK
        width = limit / 4 + SLACK
        slice_of = lambda x: F.floor(x / width)
        a = self.blocks.select(*[F.col(c).alias(f"a_{c}") for c in self.blocks.columns])
        a = a.withColumn("a_first", slice_of(F.col("a_low")[0])).withColumn("slice", F.explode(F.sequence("a_first", slice_of(F.col("a_high")[0]))))
        b = self.blocks.withColumn("first", slice_of(F.col("low")[0] - limit))
        b = b.withColumn("slice", F.explode(F.sequence("first", slice_of(F.col("high")[0] + limit))))
        apart = [F.greatest(F.col("a_low")[i] - F.col("high")[i], F.col("low")[i] - F.col("a_high")[i]) for i in range(pivots)]
        gap = F.least(F.greatest(F.lit(0.0), *apart), F.lit(math.pi / 2))
        best = F.col("a_longest") * F.col("longest") * F.cos(gap)
        met = a.join(b, "slice").where((F.col("slice") == F.greatest("a_first", "first")) & (F.col("a_block") <= F.col("block")) & (best >= self.threshold - SLACK))
        pairs = F.when(F.col("a_block") == F.col("block"), F.col("n") * (F.col("n") - 1) / 2).otherwise(F.col("a_n") * F.col("n"))
        return met.select(F.col("a_block").alias("lo"), F.col("block").alias("hi"), pairs.cast("long").alias("pairs"))

    def work(self) -> DataFrame:
        """One row: vectors, blocks, units made, units of all pairs of blocks, and the share of all pairs of vectors that is compared."""
        n = self.blocks.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("vectors"), F.count(F.lit(1)).alias("blocks"))
        u = self.units.agg(F.count(F.lit(1)).alias("units"), F.coalesce(F.sum("pairs"), F.lit(0)).alias("compared"))
        total = F.col("vectors") * (F.col("vectors") - 1) / 2
        share = F.when(total > 0, F.round(F.col("compared") / total, 6)).otherwise(0.0).alias("pair_share")
        every = (F.col("blocks") * (F.col("blocks") + 1) / 2).cast("long").alias("all_units")
        return n.join(u).select("vectors", "blocks", "units", every, share)  # one row beside one row

    def pairs(self) -> DataFrame:
        """(a, b, score), a < b: every pair whose product, to 9 places, is the threshold or more."""
        least = self.threshold
        sides = self.units.select("lo", "hi", F.explode(F.array_distinct(F.array("lo", "hi"))).alias("block"))
        dealt = self.rows.select("id", "embedding", "block").join(sides, "block")

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            first = (pdf["block"] == pdf["lo"].iloc[0]).to_numpy()
            ids, e = pdf["id"].to_numpy(), np.stack(pdf["embedding"].to_numpy())
            twin = pdf["lo"].iloc[0] == pdf["hi"].iloc[0]
            left, right = np.flatnonzero(first), np.flatnonzero(first if twin else ~first)
            found = []
            for at in range(0, len(left), 512):
                own = left[at : at + 512]
                score = np.round(e[own] @ e[right].T, 9)
                i, j = np.nonzero(score >= least)
                found.append((ids[own[i]], ids[right[j]], score[i, j]))
            x, y, s = (np.concatenate(c) for c in zip(*found)) if found else (ids[:0], ids[:0], np.zeros(0))
            keep = x < y if twin else x != y
            return pd.DataFrame({"a": np.minimum(x, y)[keep], "b": np.maximum(x, y)[keep], "score": s[keep]})

        return dealt.groupBy("lo", "hi").applyInPandas(run, "a long, b long, score double")


def _turns(p: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            v = np.array(batch.column("embedding").to_pylist(), np.float64)
            norm = np.linalg.norm(v, axis=1)
            turns = np.arccos(np.clip(v @ p.T / norm[:, None], -1, 1))
            ring = np.minimum(turns.min(1) / np.pi * RINGS, RINGS - 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("embedding"), pa.array(turns.argmin(1).astype(np.int32)), pa.array(ring), pa.array(list(turns)), pa.array(norm)],
                names=["id", "embedding", "cell", "ring", "turns", "norm"],
            )

    return run
