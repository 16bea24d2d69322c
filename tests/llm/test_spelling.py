import random
import zlib
from collections import Counter

import duckdb

from catalogspark.llm import queries
from catalogspark.llm.spelling import common_prefixes, group_variants, near_later, near_pairs


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def words_of(seed, n, letters="abé", longest=9):
    r = random.Random(seed)
    return sorted({"".join(r.choice(letters) for _ in range(r.randrange(1, longest))) for _ in range(n)})


def test_scan_of_a_sorted_list():
    for seed in range(5):
        words = words_of(seed, 300)
        lcp = common_prefixes(words)
        for i, u in enumerate(words):
            assert list(near_later(words, lcp, i)) == [j for j in range(i + 1, len(words)) if one_edit(u, words[j])]


def test_pairs_of_large_blocks(spark):
    """Blocks of any limit give each pair once each way; a third of the words shares all but its last characters."""
    words = words_of(7, 400) + [f"zzzzzzzz{w}" for w in words_of(8, 250, "abc", 6)]
    df = spark.createDataFrame([(w, i + 1) for i, w in enumerate(words)], "word string, n long")
    at = {w: i + 1 for i, w in enumerate(words)}
    want = sorted((u, at[u], v, at[v]) for u in words for v in words if one_edit(u, v))
    for limit in (4, 60, 5000):
        assert sorted(map(tuple, near_pairs(df, limit).collect())) == want


def brute(docs, every, shortest, least, ratio):
    count = Counter()
    for doc_id, text in docs:
        run = ""
        for c in (text or "") + " ":
            if c.isascii() and c.isalpha() or "À" <= c <= "ÿ":
                run += c.lower() if c.isascii() else c
                continue
            if run:
                h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
                count[run[: h % len(run)] + run[h % len(run) + 1 :] if h % every == 0 else run] += 1
            run = ""
    words = {w: n for w, n in count.items() if len(w) >= shortest and n >= least}
    form = {}
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    for w in words:
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= ratio * words[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return sorted((w, form[w] or "", root(w), n, len(near[w]), words.get(form[w], 0)) for w, n in words.items())


def test_equals_brute_force(spark):
    r = random.Random(2)
    base = ["Spelling", "colour", "ÀÉÿletter", "variant"]

    def typo(w):
        if r.random() < 0.6:
            return w
        i = r.randrange(len(w))
        return w[:i] + r.choice(["", "x", "é", w[i] + w[i]]) + w[i + 1 :]

    docs = [(i if i % 9 else None, " ".join(typo(r.choice(base)) for _ in range(40)) + "1a") for i in range(60)]
    docs += [(1, None), (2, ""), (3, "..."), (4, "a" * 50_000), (4, "a" * 50_000), (5, "Ǆspelling ŝpelling")] + docs[:5]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("doc_id", "text", "1 as n", "'x' as word")
    for every, shortest, least, ratio in [(7, 6, 2, 3), (2, 1, 1, 2), (199, 6, 5, 5)]:
        out = group_variants(df, typo_every=every, min_length=shortest, min_count=least, ratio=ratio, limit=9)
        got = sorted((x.word, x.form or "", x.root, x.n, x.n_near, x.form_n or 0) for x in out.collect())
        assert got == brute(docs, every, shortest, least, ratio)


def test_empty_table(spark):
    assert group_variants(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_query_equals_sql(spark, sf):
    duckdb.sql(f"create or replace view documents as select * from '{sf}/documents.parquet'")
    want = duckdb.sql(queries.oracle_sql()["op12_spelling_variants"]).fetchall()
    got = [tuple(r) for r in queries.op12_spelling_variants(spark, sf).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert any(r[1] for r in got)
