import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from catalogspark.llm import queries, repeats
from catalogspark.llm.repeats import remove_repeats, repeated_starts, suffix_array


def brute(rows, length):
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(t[k : k + length] for _, t in texts for k in range(len(t) - length + 1))
    out = []
    for i, t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for k in range(len(t) - length + 1):
            if seen[t[k : k + length]] > 1:
                gone[k : k + length] = True
        gone = gone[: len(t)]
        spans = int((np.diff(np.concatenate(([False], gone)).astype(int)) == 1).sum())
        kept = bytes(np.frombuffer(t, np.uint8)[~gone])
        out.append((i, len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted(
        [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept_bytes).hexdigest()) for r in df.collect()], key=str
    )


def test_suffixes_and_expansion_by_brute_force():
    r = random.Random(4)
    for _ in range(60):
        parts = ["".join(r.choice("ab") for _ in range(r.randrange(1, 40))) for _ in range(4)]
        body = "\x00".join(r.choice(parts) + r.choice(["", "x" * r.randrange(30), parts[0]]) for _ in range(8)) + "\x00"
        data = np.frombuffer(body.encode(), np.uint8)
        for length in (8, 9, 20, 33):
            order = suffix_array(data, length)[0]
            heads = [(body[i : i + length]) for i in order]
            assert heads == sorted(heads)
            marks = repeated_starts(data, length, np.arange(len(data)), np.zeros(len(data), bool))
            seen = Counter(body[k : k + length] for k in range(len(body)) if len(body[k : k + length]) == length)
            for k in range(len(body) - length + 1):
                if "\x00" not in body[k : k + length]:
                    assert marks[k] == (seen[body[k : k + length]] > 1), (body, k, length)


def made(seed, passage=260):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("aeiouéß tnr") for _ in range(6))
    common = "".join(word() for _ in range(60))[:passage]
    rows = [(0, None), (1, ""), (2, "x" * 199), (3, "x" * 5000), (4, "y" * 200), (5, "ab" * 300), (6, "abc\x00" * 90)]
    for k in range(60):
        t = "".join(word() for _ in range(r.choice([5, 60, 150])))
        kind = r.randrange(5)
        if kind == 1:
            t = t[:100] + common + t[100:]
        elif kind == 2:
            t += common[20 : 20 + r.randrange(180, 240)] + t[:50]
        elif kind == 3 and rows[-1][1]:
            t = rows[-1][1]
            at = r.randrange(len(t))
            t = t[:at] + r.choice(["", "?", "!!"]) + t[at + 1 :]
        rows.append((10 + k, t))
    rows += [(200, rows[20][1]), (201, rows[20][1]), (202, rows[30][1][:150] + "-" + rows[30][1][:220])]
    return rows


@pytest.mark.parametrize("hot", [8000, 2])
def test_whole_operator_by_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT_REGIONS", hot)
    rows = made(1)
    df = spark.createDataFrame([(i, t, "x", 3) for i, t in rows], "doc_id long, text string, source string, n_bytes int")
    out = remove_repeats(df.repartition(3))
    assert out.columns == ["doc_id", "source", "n_bytes", "n_removed", "n_spans", "kept_bytes"]
    assert got(out) == brute(rows, 200)


def test_repeated_rows_and_empty_table(spark):
    rows = [(1, "short"), (2, "z1" * 40 + "".join(chr(200 + k) for k in range(150)))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(remove_repeats(df.unionAll(df))) == brute(rows * 2, 200)
    assert remove_repeats(df.limit(0)).count() == 0


def test_query_by_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    found = sorted([tuple(r) for r in queries.op3_suffix_repeats(spark, sf).collect()], key=str)
    want = brute(rows, 200)
    assert found == want and sum(r[2] for r in want) > 10_000


def test_columns_named_like_helpers(spark):
    block = "".join(chr(97 + i % 23) + str(i) for i in range(200))
    df = spark.createDataFrame([(1, "x", 2, f"one {block}"), (2, "y", 3, f"two {block}")], "doc_id long, __key string, __text int, text string")
    out = remove_repeats(df)
    assert out.columns[:3] == ["doc_id", "__key", "__text"]
    assert {(r.doc_id, r["__key"], r["__text"], r.n_spans) for r in out.collect()} == {(1, "x", 2, 1), (2, "y", 3, 1)}
