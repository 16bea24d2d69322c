"""Face groups: chains that settle a face a round, and new people within one micro-batch."""

import numpy as np

from catalogspark.operators import people
from catalogspark.streaming import streams as W


def unit(*axes):
    v = [0.0] * 128
    for a in axes:
        v[a] = len(axes) ** -0.5
    return v


def test_long_chains_lose_no_face(spark):
    # each face resembles its neighbours only
    df = spark.createDataFrame([(i, 1.0, unit(i, i + 1)) for i in range(60)], "face_id long, quality double, embedding array<double>")
    got = {r.face_id: r.person_id for r in people.cluster_faces(df).collect()}
    assert got == {i: i - i % 2 for i in range(60)}


def test_one_new_person_in_one_batch_gets_one_group(spark):
    sink = W.FaceAssigner(spark)
    kind = "face_id long, embedding array<double>"
    sink(spark.createDataFrame([(1, unit(0)), (2, unit(0)), (3, unit(9)), (4, None)], kind), 0)
    sink(spark.createDataFrame([(5, unit(0)), (6, unit(50)), (7, unit(50)), (8, unit(70))], kind), 1)
    assert {r.face_id: r.person_id for r in sink.table.collect()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 1, 6: 6, 7: 6, 8: 8}


def sequential(faces):
    """Greedy leaders one by one, then each face's most similar leader above it."""
    leaders, out = [], {}
    for i, q, e in sorted(faces, key=lambda f: (-f[1], f[0])):
        near = max(((round(float(np.dot(e, v)), 9), -p) for p, v in leaders), default=(0, 0))
        out[i] = -near[1] if near[0] >= people.SAME else i
        if out[i] == i:
            leaders.append((i, e))
    return out


def test_rounds_of_leaders_make_no_pairs_of_faces(spark, monkeypatch):
    """Small rounds, leaders sent few at a time, evenly spread vectors: as the sequential rule says, without the pairs that grow with the square of the faces."""
    monkeypatch.setattr(people.PivotBlocks, "pairs", None)
    v = np.random.default_rng(1).standard_normal((300, 12))
    rows = [(i, float(i * 31 % 17), (x / np.linalg.norm(x)).tolist()) for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "face_id long, quality double, embedding array<double>")
    want = sequential(rows)
    assert {r.face_id: r.person_id for r in people.cluster_faces(df, block=64, at_once=20).collect()} == want and len(set(want.values())) > 20


def test_every_face_is_told_its_group(spark):
    """Centroids in several parts, of two widths; faces without a centroid of their width belong to none, but stay."""
    known = spark.createDataFrame([(k, unit(k)) for k in range(9)] + [(20, unit(3)), (30, [2.0, 0.0])], "person_id long, centroid array<double>")
    rows = [(k, [3 * x for x in unit(k)]) for k in range(12)] + [(20, [1.0, 0.1]), (21, None), (22, [0.0, 0.0]), (23, [1.0])]
    new = spark.createDataFrame(rows, "face_id long, embedding array<double>")
    want = {k: k if k < 9 else None for k in range(12)} | {20: 30, 21: None, 22: None, 23: None}
    assert {r.face_id: r.person_id for r in people.assign_faces(new, known, at_once=3).collect()} == want
    assert {r.person_id for r in people.assign_faces(new, known.limit(0)).collect()} == {None}
