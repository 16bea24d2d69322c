import numpy as np
import pytest

from catalogspark.llm.language_id import KneserNey, characters, grams, identify_languages
from catalogspark.llm.bytesops import U

TRAIN = {
    "en": ["the cat sat on the mat", "then the other cat went out", "that is the thing"],
    "de": ["der hund und die katze", "das ist ein haus", "nicht der hund"],
}


def counts(texts):
    code, starts = characters(texts)
    inside = np.ones(len(code), bool)
    for k in range(3):
        inside[starts[:-1] + k] = False
    return np.unique(grams(code, 4)[inside], return_counts=True)


def test_characters():
    code, starts = characters(["Ab--C1d", "", "é  \x00x\U00020000"])
    parts = ["".join(map(chr, code[a:b])) for a, b in zip(starts, starts[1:])]
    assert parts[0] == "   ab c d " and parts[1].strip() == "" and parts[2].startswith("   é x")
    assert len(parts[2].strip()) == 4


def test_probabilities_sum_to_one():
    model = KneserNey({k: counts(v) for k, v in TRAIN.items()})
    letters = np.append(np.unique(model.probs[1][0]), 0)
    every = np.unique(np.concatenate([counts(v)[0] for v in TRAIN.values()]) & U(0xFFFF))
    assert len(letters) == len(every) + 1
    for context in ["   ", " th", "der", "xyz"]:
        ctx = sum(ord(c) << (16 * (3 - k)) for k, c in enumerate(context))
        keys = np.array([ctx | int(c) for c in every] + [ctx | 0xFFFF], U)
        np.testing.assert_allclose(np.exp(model._score(4, keys).astype(float)).sum(axis=0), 1, atol=1e-5)


def test_short_order_by_hand():
    """Order 1 is the share of distinct 2-grams that end in the letter, interpolated with a flat guess."""
    model = KneserNey({"xx": counts(["ab ab", "b"])})
    pairs = {(" ", "a"), ("a", "b"), ("b", " "), (" ", "b")}
    n = {c: sum(p[1] == c for p in pairs) for c in "ab "}
    once, twice = sum(v == 1 for v in n.values()), sum(v == 2 for v in n.values())
    off = once / (once + 2 * twice)
    for c in "ab ":
        want = (n[c] - off) / 4 + off * 3 / 4 / 4
        assert np.exp(model._score(1, np.array([ord(c)], U))[0, 0]) == pytest.approx(want, rel=1e-4)


def test_accuracy_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.id: r for r in identify_languages(docs).collect()}
    rows = docs.select("doc_id", "lang", "text").collect()
    held = [r for r in rows if got[r.doc_id].held_out]
    assert len(held) > 150
    assert sum(got[r.doc_id].lang_pred == r.lang for r in held) / len(held) > 0.97
    assert sum(r.rejected for r in got.values()) / len(got) < 0.01
    assert all(0 <= r.score <= 1 for r in got.values())


def test_edge_rows(spark):
    rows = [(i, t, lang, "x") for i, (t, lang) in enumerate((t, k) for k, v in TRAIN.items() for t in v * 5)]
    odd = [(900, None, "en", "x"), (901, "", "de", "x"), (902, "12 +-!", "en", "x"), (903, "the cat", None, "x"),
           (None, "der hund", "en", "x"), (904, "the cat " * 200_000, "en", "x"), (905, "語語語語", None, "x")]
    df = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, score string")
    got = {r.id: r for r in identify_languages(df).collect()}
    assert [got[k].lang_pred for k in (900, 901, 902)] == ["und"] * 3 and got[900].score == 0 and got[900].rejected
    assert got[903].lang_pred == "en" and got[None].lang_pred == "de"
    assert len(got) == len(rows) + len(odd)
    assert identify_languages(df.limit(0)).count() == 0
    assert {r.lang_pred for r in identify_languages(df.where("lang is null")).collect()} == {"und"}
