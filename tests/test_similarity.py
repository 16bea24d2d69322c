"""The pivot-pruned similarity join and the grouping of faces by classes, against brute force."""

import numpy as np
import pytest

from catalogspark.operators import people
from catalogspark.operators.similarity import PivotBlocks

SCHEMA = "id long, embedding array<double>"


def groups(seed, many, each, dim, spread):
    r = np.random.default_rng(seed)
    centres = np.linalg.qr(r.standard_normal((dim, dim)))[0][:many]
    v = np.repeat(centres, each, axis=0) + spread * r.standard_normal((many * each, dim))
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def brute(v, threshold):
    s = np.round(v @ v.T, 9)
    return {(i, j) for i in range(len(v)) for j in range(i + 1, len(v)) if s[i, j] >= threshold}


@pytest.mark.parametrize("spread,threshold", [(0.02, 0.8), (0.3, 0.363), (3.0, 0.2)])
def test_pairs_equal_brute_force(spark, spread, threshold):
    v = groups(1, 6, 40, 16, spread) * np.random.default_rng(2).uniform(0.5, 1.5, (240, 1))
    df = spark.createDataFrame([(i, x) for i, x in enumerate(v.tolist())], SCHEMA)
    blocks = PivotBlocks(df, 16, threshold, block=16)
    got = [(r.a, r.b) for r in blocks.pairs().collect()]
    assert len(got) == len(set(got)) and set(got) == brute(v, threshold)


def test_far_groups_never_meet(spark):
    """Tight groups far apart: units across groups aren't made, nothing is lost, and the share says so."""
    v = groups(3, 8, 50, 16, 0.01)
    df = spark.createDataFrame([(i, x) for i, x in enumerate(v.tolist())], SCHEMA)
    blocks = PivotBlocks(df, 16, 0.8, block=25)
    work = blocks.work().first()
    assert {(r.a, r.b) for r in blocks.pairs().collect()} == brute(v, 0.8)
    assert work.vectors == 400 and work.units < work.all_units / 4 and work.pair_share < 0.25


def test_odd_vectors_are_like_nothing(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [1.0]), (7, [None, 1.0]), (8, [float("nan"), 1.0])]
    blocks = PivotBlocks(spark.createDataFrame(rows, SCHEMA), 2, 0.5)
    assert [(r.a, r.b, r.score) for r in blocks.pairs().collect()] == [(1, 2, 1.0)]
    none = PivotBlocks(spark.createDataFrame([], SCHEMA), 2, 0.5)
    assert none.pairs().collect() == [] and none.work().first().pair_share == 0.0
    with pytest.raises(ValueError):
        PivotBlocks(spark.createDataFrame(rows, SCHEMA), 2, 0.0)


def sequential(rows):
    """Leaders one after the other, best quality first, then each other face with its most similar leader above it."""
    lead, out = [], {}
    for f, q, e in sorted(rows, key=lambda r: (-r[1], r[0])):
        near = [(round(float(np.dot(e, x[2])), 9), -x[0]) for x in lead if len(x[2]) == len(e)]
        near = [n for n in near if n[0] >= people.SAME]
        if near:
            out[f] = -max(near)[1]
        else:
            lead.append((f, q, e))
            out[f] = f
    return out


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_classes_of_copies_group_as_single_faces_do(spark, seed):
    """A third of all faces share one vector, with qualities high and low; short vectors aren't like themselves; small blocks."""
    r = np.random.default_rng(seed)
    v = groups(seed, 5, 48, 8, 0.45)
    v[::3] = v[7]
    v[1:40:9] *= 0.4
    rows = [(i, float(r.integers(0, 40)), x) for i, x in enumerate(v.tolist())]
    df = spark.createDataFrame(rows, "face_id long, quality double, embedding array<double>")
    got = [(x.face_id, x.person_id) for x in people.cluster_faces(df, block=20).collect()]
    assert len(got) == len(rows) and dict(got) == sequential(rows)
    assert people.face_classes(df).where("members > 1").count() == 1


def test_faces_without_vectors_lead_themselves(spark):
    rows = [(1, 1.0, None), (2, 1.0, []), (3, None, [1.0, 0.0]), (4, 2.0, [1.0, 0.1]), (5, 1.0, [1.0]), (6, 1.0, None)]
    df = spark.createDataFrame(rows, "face_id long, quality double, embedding array<double>")
    assert dict((x.face_id, x.person_id) for x in people.cluster_faces(df).collect()) == {1: 1, 2: 2, 3: 4, 4: 4, 5: 5, 6: 6}
    assert people.cluster_faces(df.limit(0)).collect() == []
