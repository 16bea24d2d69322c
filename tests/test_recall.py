import numpy as np
from pyspark.sql import functions as F

from catalogspark.operators.neighbours import InvertedLists
from catalogspark.plans import registry


def test_approximate_neighbours_find_nine_of_ten(spark):
    """The registered query, over the whole table: recall against v3_knn, and under a fifth of all pairs scored."""
    for sf in ("sf0.001", "sf0.01", "sf0.1"):
        rows = registry.queries()["v6_knn_approx"](spark, f"/root/testdata/{sf}").collect()
        by = {r.query_id: (r.recall, r.scored_share) for r in rows}
        assert sum(x[0] for x in by.values()) / len(by) >= 0.9
        assert sum(x[1] for x in by.values()) / len(by) < 0.2


def test_lists_of_equal_vectors_and_odd_rows(spark):
    """A third of all rows equal, in several parts; null and wrong-width vectors are nowhere; all lists probed and all scored is exact."""
    r = np.random.default_rng(3)
    v = r.standard_normal((120, 8)).tolist()
    rows = [(i, v[0] if i % 3 == 0 else v[i]) for i in range(120)] + [(200, None), (201, [1.0]), (202, [])]
    df = spark.createDataFrame(rows, "id long, embedding array<double>")
    lists = InvertedLists(df, 8, lists=5, bits=64, part_rows=7)
    assert lists.table.count() == lists.rows == 120 and lists.table.where("part > 0").count() > 0
    asked = df.where("id in (1, 2, 201, 200)").withColumnRenamed("id", "query_id")
    got = {}
    for x in lists.search(asked, 5, probes=5, share=1.0).orderBy("query_id", "place").collect():
        got.setdefault(x.query_id, []).append(x.id)
        assert x.scored == 120
    e = np.array([x for _, x in rows[:120]])
    want = {q: sorted(range(120), key=lambda i: (-round(float(e[q] @ e[i]), 9), i))[:5] for q in (1, 2)}
    assert got == want
    few = lists.search(asked, 5, probes=5, share=0.1).select("query_id", "scored").distinct().collect()
    assert {x.query_id for x in few} == {1, 2}


def test_empty_index(spark):
    df = spark.createDataFrame([], "id long, embedding array<double>")
    lists = InvertedLists(df, 8, bits=64)
    asked = spark.createDataFrame([(1, [0.5] * 8)], "query_id long, embedding array<double>")
    assert lists.search(asked, 3).collect() == []
    assert InvertedLists(asked.withColumnRenamed("query_id", "id"), 8, bits=64).search(asked, 3).select("id").first()["id"] == 1
    assert asked.where(F.size("embedding") == 8).count() == 1


def test_search_moves_no_pairs(spark):
    """Of queries beside rows only counts of distances and the best of a part leave a task: no join holds pairs with their vectors."""
    r = np.random.default_rng(5)
    df = spark.createDataFrame([(i, x) for i, x in enumerate(r.standard_normal((400, 8)).tolist())], "id long, embedding array<double>")
    found = InvertedLists(df, 8, lists=4, bits=64).search(df.withColumnRenamed("id", "query_id"), 3, probes=4, share=0.5)
    joins = [x for x in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in x]
    assert joins and not any("(part#" in x for x in joins) and found.count() == 1200
