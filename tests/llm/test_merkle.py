import hashlib

import duckdb
from pyspark.sql import functions as F

from catalogspark.llm import queries
from catalogspark.llm.merkle import digest_of, fold, merkle_proofs, proof_digest

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def climb(nodes):
    """(root, [siblings of each node, level by level])."""
    at, proofs = list(range(len(nodes))), [[] for _ in nodes]
    while len(nodes) > 1:
        runs = [nodes[i : i + 8] for i in range(0, len(nodes), 8)]
        for p, i in zip(proofs, at):
            p.append((i % 8, runs[i // 8][: i % 8] + runs[i // 8][i % 8 + 1 :]))
        at = [i // 8 for i in at]
        nodes = [h("".join(r)) for r in runs]
    return nodes[0], proofs


def brute(rows):
    by = {}
    for row in rows:
        by.setdefault(row[2], []).append((row[0] is not None, row[0] or 0, leaf_of(row), row))
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = {g: climb([x[2] for x in sorted(by[g], key=lambda x: x[:3])]) for g in langs}
    root, above = climb([trees[g][0] for g in langs])
    out = []
    for g, up in zip(langs, above):
        for x, own in zip(sorted(by[g], key=lambda x: x[:3]), trees[g][1]):
            out.append((x[3][0], x[2], trees[g][0], root, [(i, s) for i, s in own + up]))
    return sorted(out, key=str)


def made(n, lang):
    return [(i, f"s{i % 3}", lang, i * 2, f"Text {i} é") for i in range(n)]


def check(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    df = df.withColumns({"rank": F.lit(1), "hash": F.lit("x"), "grp": F.lit(2), "root": F.lit("r")}).repartition(5)
    out = merkle_proofs(df, FIELDS, "lang", "doc_id")
    got = [(r.doc_id, r.leaf, r.subroot, r.root, [(s.place, s.siblings) for s in r.proof]) for r in out.collect()]
    assert sorted(got, key=str) == brute(rows)
    return out


def test_sizes_around_runs_and_blocks(spark):
    """Groups of one, of whole and broken runs, of more than one block and of more than one block of blocks' run."""
    rows = [(i, "s", lang, None, None) for lang, n in [(None, 1), ("a", 8), ("b", 9), ("é", 64), ("z", 65), ("", 2)] for i in range(n)]
    check(spark, rows + made(513, "long") + made(1100, "zz"))


def test_one_group_and_many(spark):
    check(spark, made(1, "only"))
    check(spark, made(20, None))
    check(spark, [(7, None, f"g{i:03}", i, "x") for i in range(600)])


def test_odd_rows_and_repeats(spark):
    rows = made(30, "a") + [(None, None, None, None, None)] * 40 + [(5, "s", "a", 1, "same")] * 90 + [(5, "s", "a", 1, "y" * 100_000)]
    out = check(spark, rows)
    folded = out.withColumn("back", fold(F.col("leaf"), F.col("proof")))
    assert folded.where("back <> root").count() == 0
    wrong = out.withColumn("back", fold(F.sha2(F.col("leaf"), 256), F.col("proof")))
    assert wrong.where("back = root").count() == 0


def test_proof_digest(spark):
    out = merkle_proofs(spark.createDataFrame(made(10, "a"), "doc_id long, source string, lang string, n_chars long, text string"), FIELDS, "lang", "doc_id")
    for r in out.withColumn("d", proof_digest(F.col("proof"))).collect():
        assert r.d == h("".join(x for s in r.proof for x in s.siblings))


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, source string, lang string, n_chars long, text string")
    assert merkle_proofs(df, FIELDS, "lang", "doc_id", {"seen": digest_of([F.col("text")])}).collect() == []


def test_query_equals_sql(spark, sf):
    duckdb.sql(f"create or replace view documents as select * from '{sf}/documents.parquet'")
    want = duckdb.sql(queries.oracle_sql()["op13_merkle_manifest"]).fetchall()
    got = [tuple(r) for r in queries.op13_merkle_manifest(spark, sf).collect()]
    assert sorted(got) == sorted(want)
    assert {r[6] for r in got} == {True, False}
