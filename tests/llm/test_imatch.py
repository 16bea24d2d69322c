import hashlib

import xxhash

from catalogspark.llm import imatch
from catalogspark.llm.imatch import compare_edited


def edited(rows):
    rows = sorted((i, t or "") for i, t in rows)
    out = {}
    for at, (i, t) in enumerate(rows):
        k = len(t) // 4
        follower = rows[(at + 1) % len(rows)][1]
        out[i] = (len(t), hashlib.sha256((t[: len(t) - k] + follower[:k]).encode()).hexdigest())
    return out


def edited_rows(rows):
    """Rows of one id follow each other by the hash of their texts; equal ones are next to each other."""
    rows = sorted((i, xxhash.xxh64_intdigest((t or "").encode(), 42) ^ 1 << 63, t or "") for i, t in rows)
    for at, (i, _, t) in enumerate(rows):
        k = len(t) // 4
        yield i, len(t), hashlib.sha256((t[: len(t) - k] + rows[(at + 1) % len(rows)][2][:k]).encode()).hexdigest()


def test_edits_by_brute_force(spark):
    rows = [(7, "é" * 9 + "abc"), (3, None), (4, ""), (90, "one two three four"), (11, "x" * 400_000), (5, "one two three four"),
            (-2, "tiny"), (10**12, "𝔘𝔫𝔦 code 𝔘𝔫𝔦")]
    df = spark.createDataFrame([(a, b, "q") for a, b in rows], "doc_id long, text string, k string").repartition(3)
    got = {r.id: r for r in compare_edited(df).collect()}
    want = edited(rows)
    assert {i: (r.n_chars, r.edited_sha256) for i, r in got.items()} == want
    assert got[90].fingerprint == got[5].fingerprint and got[3].fingerprint == got[4].fingerprint
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got.values())
    one = compare_edited(df.where("doc_id = 90")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    assert compare_edited(df.limit(0)).count() == 0
    twice = df.unionAll(df).unionAll(spark.createDataFrame([(None, "a null id here", "q"), (None, "a null id here", "q"), (None, "another", "q")], df.schema))
    all_rows = [(i if i is not None else 10**13, t) for i, t, _ in twice.collect()]
    want = sorted(edited_rows(all_rows))
    assert sorted((r.id if r.id is not None else 10**13, r.n_chars, r.edited_sha256) for r in compare_edited(twice).collect()) == want


def test_likeness_tells_edits_from_strangers(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = compare_edited(docs).collect()
    want = edited([(r.doc_id, r.text) for r in docs.collect()])
    assert {r.id: (r.n_chars, r.edited_sha256) for r in got} == want
    by_text = {}
    for r in docs.collect():
        by_text.setdefault(r.text, set()).add(r.doc_id)
    prints = {r.id: r.fingerprint for r in got}
    assert all(len({prints[i] for i in ids}) == 1 for ids in by_text.values())
    n = len(got)
    assert sum(r.near_edited for r in got) / n > 0.4
    assert sum(r.near_next for r in got) / n < 0.1
    assert sum(r.near_edited > r.near_next for r in got) / n > 0.85


def test_shuffled_lexicon_gives_the_same(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    small = sorted(compare_edited(docs).collect())
    monkeypatch.setattr(imatch, "BROADCAST_TERMS", 1)
    assert sorted(compare_edited(docs).collect()) == small


def test_a_large_group_of_near_copies_keeps_its_terms(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    body = [f"w{j}q" for j in range(200)]
    group = [(10**6 + i, " ".join([*body[: i % 200], f"own{i}", *body[i % 200 + 1 :]])) for i in range(500)]
    both = docs.unionAll(spark.createDataFrame(group, docs.schema))
    kept = {r.term for r in imatch.lexicon(both).collect()}
    one = spark.createDataFrame([(w,) for w in body], "text string").select(imatch.terms(imatch.F.col("text"))[0].alias("t"))
    assert {r.t for r in one.collect()} <= kept
    got = {r.id: r for r in compare_edited(both).collect()}
    near = [got[i].near_next for i, _ in group[:-1]]
    assert sum(x > 0 for x in near) / len(near) > 0.95 and sum(near) / len(near) > 0.5


def test_texts_without_lexicon_terms_are_compared_by_all_terms(spark):
    rows = [(i, " ".join(f"r{i % 2}x{j}" for j in range(60)) + f" end{i}") for i in range(4)]
    rows += [(4, rows[3][1] + " more")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.id: r for r in compare_edited(df).collect()}
    assert got[3].near_next > 0.5 and got[0].near_next < 0.2 and got[0].near_edited > 0
    assert not any(r.fingerprint.startswith("=") for r in got.values())
