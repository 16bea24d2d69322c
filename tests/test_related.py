"""Related files by blocks, against all pairs: ties, nulls, empty texts, several blocks."""

import random

import pytest

from catalogspark.operators import vectors


@pytest.mark.parametrize("size", [7, 1000])
def test_related_equals_all_pairs(spark, monkeypatch, size):
    r = random.Random(6)
    rows = [(i, r.choice([None, "a", "b"]), r.choice([None, "p"]), r.choice(["photo", "video"]), "indexed", None if i % 9 == 0 else " ".join(r.choice(["grey", "bike", "sofa", "night", "reds", "a"]) for _ in range(i % 5)), r.choice([None, 1704067200 + i * 40000])) for i in range(60)]
    df = spark.createDataFrame(rows, "file_id long, folder_id string, project_id string, kind string, index_state string, ocr_text string, t long").selectExpr("*", "timestamp_seconds(t) as created_at")
    tags = [(i, t) for i in range(60) for t in ("sea", "sky") if r.random() < 0.4]
    held = [(i, "c") for i in range(0, 60, 4)]
    tag_table, members = spark.createDataFrame(tags, "file_id long, tag string"), spark.createDataFrame(held, "file_id long, collection_id string")
    monkeypatch.setattr(vectors, "BLOCK_FILES", size, raising=False)
    asked = df.where("file_id % 5 = 0")
    whole, simple = vectors.related(df, tag_table, asked, 4), vectors.related_simple(df, tag_table, members, asked, 4)
    of = lambda i: {t for f, t in tags if f == i}
    words = lambda t: {w for w in (t or "").split() if len(w) > 3}
    near, plain = {}, {}
    for t in rows[::5]:
        one, two = [], []
        for o in (o for o in rows if o[0] != t[0]):
            same = lambda c: t[c] is not None and t[c] == o[c]
            a, b = words(t[5]), words(o[5])
            s = 0.45 * len(of(t[0]) & of(o[0])) / max(len(of(t[0])), 1) + 0.4 * len(a & b) / max(len(a | b), 1) + 0.12 * same(1) + 0.18 * same(2)
            days = abs(t[6] - o[6]) / 86400 if t[6] and o[6] else 99
            s = round(min(s + (0.1 if days < 1 else 0.04 if days < 7 else 0), 1), 6)
            one += [(-s, o[0])] * (s > 0.05)
            s = 2.0 * len(of(t[0]) & of(o[0])) + 1.5 * ((t[0], "c") in held and (o[0], "c") in held) + 0.75 * same(1) + 0.4 * same(3)
            two += [(-s, o[0])] * (s > 0)
        near[t[0]], plain[t[0]] = sorted(one)[:4], sorted(two)[:4]
    for found, want in ((whole, near), (simple, plain)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
        got = {i: [] for i in want}
        for x in found.orderBy("target", "place").collect():
            got[x.target].append((-x.score, x.file_id))
        assert {i: [(round(s, 6), f) for s, f in g] for i, g in got.items()} == {i: [(round(s, 6), f) for s, f in w] for i, w in want.items()}


def test_all_queries_beside_all_files_lower_a_text_once(spark):
    """As row by row: the first reason that holds a term; equal terms, null terms and null fields too. No join, so no pair carries a text."""
    from catalogspark.operators import search as S

    docs = spark.createDataFrame([(1, "IMG_Tree.png", None, "A Tree"), (2, None, "x Tag", "nothing"), (3, "a", "b", None), (4, None, None, "")], "file_id long, name string, tags string, ocr_text string")
    asked = spark.createDataFrame([("p", ["TREE"]), ("q", ["tree"]), ("r", ["tag", "thing"]), ("s", [None]), ("t", ["THING"]), ("u", [""]), ("v", None)], "query_id string, terms array<string>")
    found = S.classify_all(docs, asked)
    want = S.classify_match(docs.crossJoin(asked)).select("query_id", "file_id", "match")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect())) and found.count() == 28
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
