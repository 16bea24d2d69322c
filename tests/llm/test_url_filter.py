import random

import duckdb

from catalogspark.llm import queries, url_filter
from catalogspark.llm.url_filter import judge_urls

URLS = [
    None, "", "no scheme", "http://", "HTTP://EXAMPLE.Com/en/7x?y=/de/", "http://com/en/", "http://a.example.com/en/8",
    "http://xcom/en/", "http://a.net/de/1", "http://b.example.net/de/88#q", "x://y://z.org/es/", "http://q.org?/es/",
    "http://q.org/es/\n2", "http://a.com/EN/", "http://.com/en/", "http://com./en/",
]


def brute(url, rules):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min((rest.index(c) for c in "/?#" if c in rest), default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:]
        path = path[: min((path.index(c) for c in "?#" if c in path), default=len(path))]
    fits = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    best = max(fits, key=lambda r: (len(r[0].split(".")), len(r[1]), r[2] == "allow"), default=None)
    return host, path, best and best[0] + best[1], best[2] if best else "allow"


def check(spark, urls, rules):
    df = spark.createDataFrame([(i, u, "kept") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    out = judge_urls(df, spark.createDataFrame(rules, "host string, path string, verdict string"))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in out.collect()}
    assert got == {i: brute(u, rules) for i, u in enumerate(urls)}


def test_fixed_urls(spark):
    check(spark, URLS, queries.URL_RULES)


def test_random_rules_both_ways(spark, monkeypatch):
    r = random.Random(3)
    name = lambda: ".".join(r.choice(["a", "b", "example", "com"]) for _ in range(r.randrange(1, 4)))
    path = lambda: "".join(r.choice(["/", "/a", "b", "/b/", "7"]) for _ in range(r.randrange(0, 4)))
    rules = [(name(), p if p.startswith("/") or not p else "/" + p, r.choice(["allow", "block"])) for p in (path() for _ in range(40))]
    urls = [f"http://{name()}/{path()}" for _ in range(300)]
    check(spark, urls, rules)
    monkeypatch.setattr(url_filter, "MAX_TRIE_RULES", 3)
    check(spark, urls, rules)


def test_query_equals_sql(spark, sf):
    duckdb.sql(f"create or replace view pages as select * from '{sf}/pages.parquet'")
    want = duckdb.sql(queries.oracle_sql()["op7_url_filter"]).fetchall()
    got = [tuple(r) for r in queries.op7_url_filter(spark, sf).collect()]
    assert sorted(got) == sorted(want)
    assert {x[4] for x in got} == {"allow", "block"}


def test_columns_named_like_helpers(spark, monkeypatch):
    rules = spark.createDataFrame(queries.URL_RULES, "host string, path string, verdict string")
    df = spark.createDataFrame([("http://com/en/", 1, 2, 3), ("http://com/en/", 1, 2, 3), (None, 4, 5, 6)], "url string, found int, best int, __found int")
    for _ in range(2):
        out = judge_urls(df, rules)
        assert sorted(map(tuple, out.select("found", "best", "__found", "verdict").collect())) == [(1, 2, 3, "block")] * 2 + [(4, 5, 6, "allow")]
        monkeypatch.setattr(url_filter, "MAX_TRIE_RULES", 1)
    assert judge_urls(df.limit(0), rules).collect() == []


def test_rules_of_the_query_are_the_contract(spark, sf):
    """Each rule's word, and the query's own rows, against the list in the contract."""
    rules = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]
    assert sorted(queries.URL_RULES) == sorted(rules)
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url").collect()}
    got = queries.op7_url_filter(spark, sf).collect()
    assert [(r.host, r.path, r.rule, r.verdict) for r in got] == [brute(urls[r.page_id], rules) for r in got]
    assert any(r.rule == "net/de/" for r in got)
