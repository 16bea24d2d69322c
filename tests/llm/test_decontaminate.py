import random
import re

import duckdb

from catalogspark.llm import queries
from catalogspark.llm.decontaminate import MASKS, leaks


def split(text):
    return [w for w in re.split(r"[^\w]+|_", (text or "").lower()) if w]


def brute(docs, items):
    out = set()
    for d, text in docs:
        w = split(text)
        for i, passage in items:
            p = split(passage)
            best = 0
            for off in range(-len(p) + 1, len(w)):
                pairs = [(j, j + off) for j in range(len(p)) if 0 <= j + off < len(w)]
                same = {j for j, k in pairs if p[j] == w[k]}
                if any(all(j + m in same for m in mask) for mask in MASKS for j in same):
                    best = max(best, len(same))
            if best and best >= min(len(p), max(8, -(-len(p) // 2))):
                out.add((d, i, len(p), best))
    return out


def test_equals_brute_force(spark):
    r = random.Random(1)
    vocab = [f"v{k}" for k in range(60)] + ["été", "ß1"]
    items = [(i, " ".join(r.choice(vocab) for _ in range(r.choice([3, 6, 9, 20, 40])))) for i in range(12)]
    items += [(50, None), (51, ""), (52, "a a a a a a a a a a"), (53, items[3][1])]
    docs = [(0, None), (1, ""), (2, "a " * 3000)]
    for k in range(60):
        words = [r.choice(vocab) for _ in range(r.randrange(0, 80))]
        passage = (r.choice(items[:12])[1]).split()
        for _ in range(r.randrange(0, 1 + len(passage) // 3)):
            passage[r.randrange(len(passage))] = "other"
        at = r.randrange(0, len(words) + 1)
        cut = r.choice([0, 0, 3])
        docs.append((len(docs), ", ".join(words[:at] + passage[cut:] + words[at:]).upper()))
    a = spark.createDataFrame([(i, t, 7) for i, t in docs], "doc_id long, text string, item int")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {(x.id, x.item, x.item_words, x.agreeing) for x in leaks(a, b).collect()}
    want = brute(docs, items)
    assert got == want and len(want) > 20
    assert leaks(a.limit(0), b).count() == 0 and leaks(a, b.limit(0)).count() == 0
    twice = leaks(a.unionAll(a), b.unionAll(b))
    assert {(x.id, x.item, x.item_words, x.agreeing) for x in twice.collect()} == want


def test_shuffled_when_the_benchmark_is_large(spark, sf, monkeypatch):
    from catalogspark.llm import decontaminate

    docs, bench = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    small = sorted(leaks(docs, bench).collect())
    monkeypatch.setattr(decontaminate, "BROADCAST_SEEDS", 1)
    assert sorted(leaks(docs, bench).collect()) == small


def test_query_equals_sql(spark, sf):
    for t in ("documents", "benchmark"):
        duckdb.sql(f"create or replace view {t} as select * from '{sf}/{t}.parquet'")
    want = duckdb.sql(queries.oracle_sql()["op8_decontaminate"]).fetchall()
    got = [tuple(x) for x in queries.op8_decontaminate(spark, sf).collect()]
    assert sorted(got) == sorted(want) and got


def test_recall_at_the_threshold(spark):
    """Items of 40 words, of which some are replaced: by how many are found."""
    r = random.Random(3)
    items = [(i, " ".join(f"w{r.randrange(10**6)}" for _ in range(40))) for i in range(200)]
    docs = []
    for share, place in ((0.3, 1), (0.4, 2), (0.5, 3), (None, 4)):
        for i, text in items:
            words = text.split()
            gone = range(1, 40, 2) if share is None else r.sample(range(40), int(40 * share))
            for k in gone:
                words[k] = f"x{r.randrange(10**6)}"
            docs.append((place * 1000 + i, "before " + " ".join(words) + " after"))
    a, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = [0] * 5
    for x in leaks(a, b).collect():
        assert x.id % 1000 == x.item
        found[x.id // 1000] += 1
    assert found[1] == 200 and found[2] >= 196 and found[3] >= 180 and found[4] == 200
