"""Exact neighbours over blocks of an index, against brute force."""

import numpy as np
import pyarrow as pa
import pytest

from catalogspark.operators import vectors


@pytest.mark.parametrize("l2", [False, True])
def test_neighbours_over_many_blocks(spark, monkeypatch, l2):
    """Two widths, a third of the rows equal (ties by the least id), repeated rows, several blocks a task and several batches a block."""
    monkeypatch.setattr(vectors, "BLOCK_BYTES", 700)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        r = np.random.default_rng(5)
        v = {i: r.standard_normal(6 if i % 5 else 3) for i in range(150)}
        v |= {i: v[1] for i in range(3, 150, 3) if i % 5}
        rows = [(i, x.tolist()) for i, x in v.items()] + [(200, None), (201, []), (202, [None] * 6)]
        ix = spark.createDataFrame(rows, "id long, embedding array<double>")
        q = ix.where("id % 10 < 6 or id > 199").withColumnRenamed("id", "query_id")
        got = {}
        for x in vectors.knn(q, ix, 4, l2).orderBy("query_id", "place").collect():
            got.setdefault(x.query_id, []).append(x.id)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    like = (lambda a, b: 1 - float(np.sqrt(((a - b) ** 2).sum()))) if l2 else (lambda a, b: float(a @ b))
    want = {a: sorted((i for i in v if len(v[i]) == len(v[a])), key=lambda i: (-round(like(v[a], v[i]), 9), i))[:4] for a in v if a % 10 < 6}
    assert got == want


def test_empty_index_and_no_queries(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0])], "id long, embedding array<float>")
    none = df.limit(0)
    assert vectors.knn(df.withColumnRenamed("id", "query_id"), none, 3).collect() == []
    assert vectors.knn(none.withColumnRenamed("id", "query_id"), df, 3).collect() == []
    found = vectors.knn(df.withColumnRenamed("id", "query_id"), df, 3).collect()
    assert [(r.query_id, r.id, r.score, r.place) for r in found] == [(1, 1, 1.0, 1)]


def test_scores_held_at_once_do_not_grow_with_a_block(spark, monkeypatch):
    """A full block of short vectors has many rows."""
    held = []
    monkeypatch.setattr(vectors, "best_of", lambda score, ids, k, real=vectors.best_of: held.append(score.size) or real(score, ids, k))
    side = lambda n, s: pa.record_batch({"id": np.arange(n), "embedding": [[float(i % 97), 1.0] for i in range(n)], "w": np.full(n, 2), "block": np.zeros(n, int), "side": np.full(n, s)})
    out = pa.Table.from_batches(vectors._best_in_blocks(3, False)(iter([side(20_000, 0), side(150, 1)])))
    assert out.num_rows == 450 and max(held) <= 1 << 20
    assert out.slice(3 * 5, 3)["id"].to_pylist() == [96, 193, 290]
