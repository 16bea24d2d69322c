from collections import Counter

import corpus_pipeline
from catalogspark.llm.language_id import identify_languages

from .test_decontaminate import brute as brute_leaks
from .test_jaccard_join import brute as brute_links
from .test_packing import check as check_pieces


def cut(rows, length=200):
    texts = {i: t.encode() for i, t in rows}
    seen = Counter(t[k : k + length] for t in texts.values() for k in range(len(t) - length + 1))
    out = []
    for i, t in texts.items():
        gone = bytearray(len(t))
        for k in range(len(t) - length + 1):
            if seen[t[k : k + length]] > 1:
                gone[k : k + length] = b"\x01" * length
        kept = bytes(b for b, g in zip(t, gone) if not g).decode("utf-8", "ignore")
        if kept.strip(" "):
            out.append((i, kept))
    return out


def test_stages_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    rejected = {r.id for r in identify_languages(docs).where("rejected").collect()}
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id not in rejected]
    first = {i for i, _, comp, _ in brute_links(rows) if i == comp}
    rows = cut([r for r in rows if r[0] in first])
    leaking = {d for d, *_ in brute_leaks(rows, items)}
    rows = [r for r in rows if r[0] not in leaking]
    pieces = corpus_pipeline.run(spark, sf).withColumnRenamed("doc_id", "id").collect()
    check_pieces(rows, pieces)
    assert len(rows) > 100 and leaking


def _documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, `kept_text` string, id int")


def test_stages_on_odd_rows(spark, sf, tmp_path):
    base = [(r.doc_id, r.text, r.lang, r.source, r.n_chars, "x", 1) for r in spark.read.parquet(f"{sf}/documents.parquet").where("text is not null").collect()]
    text = next(t for _, t, *_ in base if len(t.split()) > 60)
    word = " ".join(f"solo{k}" for k in range(40))
    odd = [
        (None, None, None, None, None, None, None), (None, "", "en", "a", 0, None, 2), (10**9, text, "en", None, 1, None, 3),
        (10**9, text, "en", None, 1, None, 3), (None, text, None, None, 1, None, 3), (10**9 + 1, "12 34 56", None, None, 1, None, 3),
        (10**9 + 2, word, None, None, 1, None, 4), (10**9 + 2, word, None, None, 1, None, 4), (None, word + " tail", None, None, 1, None, 4),
        (10**9 + 3, "the long one " * 60_000, "en", None, 1, None, 5),
    ]
    folder = str(tmp_path)
    spark.read.parquet(f"{sf}/benchmark.parquet").write.parquet(f"{folder}/benchmark.parquet")
    docs = _documents(spark, base + odd).repartition(3)
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        out.write.parquet(f"{folder}/{name}.parquet")
        docs = spark.read.parquet(f"{folder}/{name}.parquet")
        assert docs.columns == names
        left = docs.collect()
        if name == "language_id":
            assert not any(r.text is None or r.doc_id == 10**9 + 1 for r in left)
        if name == "near_duplicates":  # equal rows are one document, a null id gives way to any other
            assert sum(r.text == word for r in left) <= 1 and not any(r.text == word + " tail" for r in left)
            assert sum(r.text == text for r in left) == 1 and all(r.doc_id is not None for r in left if r.text == text)
        if name == "repeated_passages":
            assert all(r.text.strip(" ") and r.n_chars == len(r.text) for r in left)
    pieces = corpus_pipeline.packing(spark, docs, folder).collect()
    assert sum(p.length for p in pieces) > len(left)


def test_empty_tables(spark, sf, tmp_path):
    folder = str(tmp_path)
    for name in ("documents", "benchmark"):
        spark.read.parquet(f"{sf}/{name}.parquet").limit(0).write.parquet(f"{folder}/{name}.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0
