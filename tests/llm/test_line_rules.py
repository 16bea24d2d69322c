import random
import re
from collections import Counter

import duckdb

from catalogspark.llm import queries
from catalogspark.llm.line_rules import clean_lines, failed_rule

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def repeats(words):
    windows = list(zip(words, words[1:], words[2:]))
    times = Counter(windows)
    return len({i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(3)})


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    lines = text.split("\n")
    seen, dup, left = set(), 0, 0
    for line in lines:
        own = WORD.findall(line)
        if own:
            dup += line in seen
            if not failed_rule(line, len(own), line in seen or 2 * repeats(own) > len(own)):
                left += len(own)
            seen.add(line)
    failed = len(words) < 50 or 100 * repeats(words) > 50 * len(words)
    kept = not failed and left >= 0.5 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, repeats(words), failed, kept, left


def texts():
    r = random.Random(5)
    line = lambda: " ".join(r.choice(["a", "b", "été", "It", "x#", "go!"]) for _ in range(r.randrange(0, 14))) + r.choice(["", ".", "\r", "!"])
    made = ["\n".join(line() for _ in range(r.randrange(1, 12))) for _ in range(200)]
    clean = " ".join(f"word{i}" for i in range(60)) + "."
    odd = [None, "", "\n", " \n\n ", "a b c", "a b c a b c", "\x0b\x0c\r", "\n\n" + clean, clean + "\n" + clean, clean * 400 + "\n", "é" * 100_000]
    return made + odd + [clean] * 20


def test_equals_brute_force(spark):
    rows = [(i, t) for i, t in enumerate(texts())]
    got = clean_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert len(got) == len(rows)
    for r in got:
        have = r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept, r.kept_words
        assert have == brute(r.text), r.text


def test_each_rule():
    for line, rule in [
        ("one two three four five six seven eight", ""), ("short one", "end"), ("A short one.", ""), ("He said “so.”", ""),
        ("a* b* c*.", "marks"), ("LA!! SE!!", "marks"), ("ALL OF THIS IS LOUD.", "capitals"), ("Skip to content now.", "navigation"),
        ("Homes are good for all people here.", ""), ("Licensed under the Apache License, Version 2.0.", "boilerplate"),
    ]:
        assert failed_rule(line, len(WORD.findall(line)), False) == rule, line
    assert failed_rule("A short one.", 3, True) == "repeated"


def test_clean_text_and_clashing_columns(spark):
    good = " ".join(f"word{i}" for i in range(60)) + "."
    df = spark.createDataFrame([(None, f"menu\n{good}\n\nSo be it.\nSo be it.", 7), (1, "menu " * 60, 8)], "doc_id long, text string, kept int")
    out = clean_lines(df)
    assert out.columns.count("kept") == 1 and dict(out.dtypes)["kept"] == "boolean"
    got = {r.doc_id: r for r in out.collect()}
    assert got[None].clean_text == f"{good}\n\nSo be it." and got[None].kept
    assert {k: v for k, v in got[None].lost_lines.items() if v} == {"end": 1, "repeated": 1}
    assert got[1].clean_text is None and not got[1].kept and got[1].base_failed


def test_empty_table(spark):
    assert clean_lines(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_query_equals_sql_and_keeps_clean_documents(spark, sf):
    duckdb.sql(f"create or replace view documents as select * from '{sf}/documents.parquet'")
    want = duckdb.sql(queries.oracle_sql()["op11_line_rules"]).fetchall()
    got = queries.op11_line_rules(spark, sf)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    said = {(r.quality, r.kept) for r in got.where("not base_failed").join(labels, "doc_id").collect()}
    assert said == {(1, True), (0, False)}
