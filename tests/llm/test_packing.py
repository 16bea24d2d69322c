import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from catalogspark.llm.packing import assign, encoder, pack_documents

PATH = public_tokenizers.path("word_bpe_49k.json")
TOKENIZER = Tokenizer.from_file(PATH)


def ids_of(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids + [1]


def check(rows, pieces):
    want = defaultdict(list)
    for i, t in rows:
        want[i].append(ids_of(t))
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.id].append(p)
        by_seq[p.sequence_id].append(p)
    assert set(by_doc) == set(want)
    for i, own in by_doc.items():
        if len(want[i]) == 1:
            at = 0
            for p in sorted(own, key=lambda p: p.start):
                ids = want[i][0][at : at + p.length]
                assert p.start == at and p.doc_tokens == len(want[i][0])
                assert p.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
                at += p.length
            assert at == len(want[i][0])
    padding = 0
    for own in by_seq.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert 0 < at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    assert padding == 0


def test_pieces_by_brute_force(spark):
    rows = [(i, "Hello wörld, it's 1st! " * n) for i, n in enumerate([0, 1, 3, 40, 200, 251, 252, 1000, 5000])]
    rows += [(20, None), (21, "<|endoftext|> a<|startoftext|>b"), (22, "a\x1cb  ć \x85 x y"), (None, "null id")]
    df = spark.createDataFrame([(a, b, 1) for a, b in rows], "doc_id long, text string, tokens int").repartition(3)
    check(rows, pack_documents(df, PATH).collect())
    check(rows, pack_documents(df, PATH, block_docs=3).collect())
    assert pack_documents(df.limit(0), PATH).count() == 0
    twice = pack_documents(df.unionAll(df), PATH)
    assert twice.groupBy().sum("length").first()[0] == 2 * sum(len(ids_of(t)) for _, t in rows)


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    check([(r.doc_id, r.text) for r in docs.collect()], pack_documents(docs, PATH).collect())


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(), max_size=4))
def test_cached_words_give_the_tokenizers_ids(texts):
    got = [np.frombuffer(x, np.uint32).tolist() for x in encoder(PATH)(texts)]
    assert got == [TOKENIZER.encode(t, add_special_tokens=False).ids for t in texts]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 2047), max_size=60))
def test_assign_is_an_exact_cover(sizes):
    pieces = assign(np.array(sizes, np.int64), 2048)
    for doc, size in enumerate(sizes):
        own = sorted((s, n) for d, s, n, _, _ in pieces if d == doc)
        assert [s for s, _ in own] == np.cumsum([0, *[n for _, n in own]])[:-1].tolist()
        assert sum(n for _, n in own) == size
