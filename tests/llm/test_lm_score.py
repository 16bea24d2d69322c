import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from catalogspark.llm.lm_score import DISCOUNT, pack, score_texts, unpack


def tokens(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low) + [None]


def base(rows):
    train = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 != 1]
    c = Counter(t for r in train for t in tokens(r[1]))
    n, v = sum(c.values()), len(c)
    out = {}
    for i, text in rows:
        own = tokens(text)
        total = sum(math.log10((c[t] + 0.5) / (n + 0.5 * (v + 1))) for t in own)
        out[i] = (zlib.crc32(str(i).encode()) % 5 == 1, len(own), sum(c[t] > 0 for t in own), n, total)
    return out, c


ROWS = [
    (i, t)
    for i, t in enumerate(
        ["the cat sat on the mat", "The cat sat", "a dog\tsat on\nthe mat", None, "", "zebra cat", "the dog the dog", "xyzzy the cat"] * 4
    )
]


def test_base_counts_by_brute_force(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(3)
    want, _ = base(ROWS)
    got = {r.id: r for r in score_texts(df).collect()}
    assert len(got) == len(want)
    for i, (held, n, known, total, score) in want.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, total)
        assert r.base_score == pytest.approx(score, abs=1e-9)
        assert r.score < 0


def brute(rows, order, priors):
    """log10 probability of each text whose words were all trained on, by the recursive formula; None for others."""
    train = [t for i, t in rows if zlib.crc32(str(i).encode()) % 5 != 1]
    seqs = [["<start>", *tokens(t)] for t in train]
    c = Counter()
    for s in seqs:
        for k in range(1, order + 1):
            c.update(tuple(s[j - k + 1 : j + 1]) for j in range(max(1, k - 1), len(s)))
    c[("<start>",)] = len(seqs)
    total = sum(len(s) - 1 for s in seqs)

    def p(w, h):
        if not h:
            return (c[(w,)] - DISCOUNT) / total
        m = priors[len(h) - 1]
        return (c[(*h, w)] + m * p(w, h[1:])) / (c[h] + m)

    out = {}
    for i, t in rows:
        s = ["<start>", *tokens(t)]
        known = all(c[(w,)] for w in s)
        out[i] = sum(math.log10(p(s[j], tuple(s[max(0, j - order + 1) : j]))) for j in range(1, len(s))) if known else None
    mass = [sum(p(w, h) for w in {g[0] for g in c if len(g) == 1} - {"<start>"}) for h in [(), ("the",), ("the", "cat")][:order]]
    return out, mass, DISCOUNT * sum(len(g) == 1 for g in c if g != ("<start>",)) / total


@pytest.mark.parametrize("order", [1, 2, 3])
def test_traversal_equals_the_recursive_formula(spark, order, monkeypatch):
    rows = ROWS + [(100 + i, t) for i, t in enumerate(["cat the sat", "mat mat mat", "the cat sat on a dog", "on on the"] * 3)]
    want, mass, rest = brute(rows, order, (5.0, 2.0))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    monkeypatch.setattr("catalogspark.llm.lm_score.BLOCK_BYTES", 64)  # many blocks and parts
    monkeypatch.setattr("catalogspark.llm.lm_score.PART_BYTES", 128)
    got = {r.id: r.score for r in score_texts(df, order=order, priors=(5.0, 2.0)).collect()}
    assert len(got) == len(want) and sum(v is not None for v in want.values()) > 30
    for i, score in want.items():
        assert score is None or got[i] == pytest.approx(score, abs=1e-9)
    assert mass[0] + rest == pytest.approx(1)
    assert all(m + rest <= 1 + 1e-9 or m <= 1 for m in mass)


def test_blocks_do_not_change_results(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    one = {r.id: r for r in score_texts(docs).collect()}
    monkeypatch.setattr("catalogspark.llm.lm_score.BLOCK_BYTES", 30_000)
    monkeypatch.setattr("catalogspark.llm.lm_score.PART_BYTES", 50_000)
    many = {r.id: r for r in score_texts(docs).collect()}
    assert one.keys() == many.keys()
    assert any(r.n_known < r.n_tokens for r in one.values())  # spelled words too
    for i, r in one.items():
        assert r[:5] == many[i][:5] and r[5:] == pytest.approx(many[i][5:], rel=1e-9)


def test_a_count_of_one_stays_in_the_model_whatever_the_corpus(spark):
    """An n-gram seen once in training lifts its text's score, beside many other texts."""
    rows = [(i, f"plain filler text {i % 97} {i % 89}") for i in range(3000)] + [(5000, "rare quartz gleams")]
    rows += [(5003, "quartz rare gleams"), (5004, "rare quartz gleams")]
    held = {i for i, _ in rows if i >= 5003}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.id: r for r in score_texts(df, held_out=df.doc_id.isin(*held)).where("id >= 5000").collect()}
    assert got[5004].n_known == got[5003].n_known == 4
    assert got[5004].score == got[5000].score > got[5003].score


def test_packed_columns_come_back():
    for n in (0, 1, 1000):
        x = np.random.default_rng(n).integers(0, 1 << 63, n).astype(np.uint64)
        assert (unpack(pack(x), n) == x).all()


def test_beats_the_base_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    got = score_texts(docs).where("held_out").selectExpr("sum(score) s", "sum(base_score) b", "count(*) n").first()
    assert got.n > 1500 and got.s > got.b


def test_edge_tables(spark):
    odd = ROWS + [(None, "the cat"), (77, "long " * 100_000)]
    df = spark.createDataFrame([(a, b, 1) for a, b in odd], "doc_id long, text string, n_tokens int")
    twice = df.unionAll(df.where("doc_id in (5, 7)"))
    out = score_texts(twice).collect()
    assert len(out) == len(odd) + 2
    pairs = Counter((r.id, r.n_known, round(r.base_score, 9)) for r in out)
    assert all(v == (2 if k[0] in (5, 7) else 1) for k, v in pairs.items())
    assert score_texts(df.limit(0)).count() == 0
    none = score_texts(df.where("crc32(cast(cast(doc_id as string) as binary)) % 5 = 1")).collect()
    assert none and all(r.train_tokens == 0 and r.n_known == 0 and math.isfinite(r.score) for r in none)
