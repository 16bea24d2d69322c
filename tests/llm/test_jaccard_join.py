import random
import re

from catalogspark.llm.jaccard_join import jaccard_components


def brute(rows):
    sets = {}
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    comp, links = {i: i for i in sets}, dict.fromkeys(sets, 0)

    def find(i):
        while comp[i] != i:
            i = comp[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                x, y = find(a), find(b)
                comp[max(x, y)] = min(x, y)
    return {(i, len(sets[i]), find(i), links[i]) for i in ids}


def made(seed=0):
    r = random.Random(seed)
    vocab = [f"w{k}" for k in range(400)]
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "One two"), (4, "one TWO"), (5, "one two")]
    for base in range(12):
        words = [r.choice(vocab) for _ in range(r.choice([5, 8, 40, 200, 700]))]
        for _ in range(r.choice([1, 3, 12])):
            near = list(words)
            for _ in range(r.randrange(0, 1 + len(words) // 25)):
                near[r.randrange(len(near))] = r.choice(vocab)
            rows.append((len(rows), " ".join(near)))
    passage = " ".join(r.choice(vocab) for _ in range(30))
    rows += [(len(rows) + k, passage + " " + " ".join(r.choice(vocab) for _ in range(60))) for k in range(10)]
    r.shuffle(rows)
    return rows


def got(df):
    return {(x.id, x.n_shingles, x.component_id, x.n_links) for x in df.collect()}


def test_equals_brute_force(spark):
    for seed in (0, 1):
        rows = made(seed)
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        assert got(jaccard_components(df)) == brute(rows)


def test_blocks_give_the_same_links(spark, monkeypatch):
    from catalogspark.llm import jaccard_join

    rows = made(2)
    monkeypatch.setattr(jaccard_join, "BLOCK_SHINGLES", 300)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(jaccard_components(df)) == brute(rows)


def test_repeated_rows_extra_columns_empty_table(spark):
    rows = [(1, "a b c d e f", "x"), (1, "a b c d e f", "x"), (None, "a b c d e f", "y"), (7, "a b c d e f", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, id string")
    out = sorted(((x.id or -1), x.component_id) for x in jaccard_components(df).collect())
    assert out == [(-1, None), (1, 1), (1, 1), (7, 1)]
    assert jaccard_components(df.where("doc_id = 99")).count() == 0


def test_planted_sf(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    assert got(jaccard_components(df)) == brute([(x.doc_id, x.text) for x in df.collect()])


def test_equal_ids_of_different_texts(spark):
    """Rows of one id with different sets are told apart; each links by its own text, and components take the smallest id."""
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(1, a), (1, b), (2, a + " more"), (3, b + " more"), (5, b + " more words"), (4, "other text of its own here")]
    rows += [(9, f"{b} and {i}") for i in range(3)] + [(1, b)] * 20
    out = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(out) == len(rows)
    assert {r.id: r.component_id for r in out} == {1: 1, 2: 1, 3: 1, 5: 1, 4: 4, 9: 1}
    links = {(r.id, r.n_shingles): r.n_links for r in out}
    assert links[2, 57] == 1 and links[3, 57] == 25 and links[4, 2] == 0
