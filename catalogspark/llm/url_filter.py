"""URL rules in a trie over reversed host labels and path segments.

A rule (host, path, verdict) fits a url if the url's host is the rule's host or a subdomain of
it, and the url's path starts with the rule's path. The deepest host that fits wins; among its rules
the longest path does; of equal rules an allow entry beats a block entry. The trie is broadcast
while the rules number `MAX_TRIE_RULES` at most; more rules are joined by host instead.

Defined results: a null url, or one without `://`, has an empty host and path; a url that no rule
fits gets the default verdict and a null rule; repeated rows each get a row; other columns are kept as
they are, unless they clash with the four that are added, which then replace them.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_TRIE_RULES = 500_000


def host_of(url: Column) -> Column:
    """Between the first `://` and the next `/`, `?`, `#` or the end, A-Z lower-cased."""
    host = F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """From the host's end up to `?`, `#` or the end."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


class RuleTrie:
    """Nodes are dicts: host labels lead down; under None a node holds its path trie. In a path trie
    whole segments lead down; under None a node holds {segment beginning: (rule, verdict)}."""

    def __init__(self, rules):
        self.root: dict = {}
        for host, path, verdict in rules:
            node = self.root
            for label in reversed(host.split(".")):
                node = node.setdefault(label, {})
            node = node.setdefault(None, {})
            *whole, last = path.split("/")
            for segment in whole:
                node = node.setdefault(segment, {})
            ends = node.setdefault(None, {})
            if ends.get(last, ("", "block"))[1] == "block":
                ends[last] = (host + path, verdict)

    @staticmethod
    def _path(node: dict, segments: list[str]):
        best = None
        for segment in segments:
            ends = node.get(None)
            if ends:
                fits = [x for x in ends if segment.startswith(x)]
                if fits:
                    best = ends[max(fits, key=len)]
            node = node.get(segment)
            if node is None:
                break
        return best

    def find(self, host: str, path: str):
        """(rule, verdict) of the longest match, or None."""
        best, node, segments = None, self.root, path.split("/")
        for label in reversed(host.split(".")):
            node = node.get(label)
            if node is None:
                break
            if None in node:
                best = self._path(node[None], segments) or best
        return best


def judge_urls(urls: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """`urls` with host, path, rule and verdict. `rules`: host, path, verdict ('allow' or 'block')."""
    rules = rules.where("host is not null and verdict is not null").select(
        F.lower("host").alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict"
    )
    parted = urls.withColumns({"host": host_of(F.col(url_col)), "path": path_of(F.col(url_col))})
    some = rules.limit(MAX_TRIE_RULES + 1).collect()
    if len(some) > MAX_TRIE_RULES:
        return _judge_by_join(parted, rules, default)
    trie = urls.sparkSession.sparkContext.broadcast(RuleTrie([tuple(r) for r in some]))

    @F.pandas_udf("rule string, verdict string")
    def judge(host: pd.Series, path: pd.Series) -> pd.DataFrame:
        found = [trie.value.find(h, p) or (None, default) for h, p in zip(host, path)]
        return pd.DataFrame(found, columns=["rule", "verdict"])

    found = _free(parted, "found")
    return parted.withColumn(found, judge("host", "path")).withColumns(
        {"rule": F.col(f"{found}.rule"), "verdict": F.col(f"{found}.verdict")}
    ).drop(found)


def _free(df: DataFrame, name: str) -> str:
    """A column name that `df` doesn't have."""
    while name in df.columns:
        name += "_"
    return name


def _judge_by_join(parted: DataFrame, rules: DataFrame, default: str) -> DataFrame:
    """The same verdicts by a join of host suffixes, for rule sets too large to broadcast."""
    pairs = parted.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    suffixes = pairs.withColumn("labels", labels).withColumn("k", F.explode(F.sequence(F.lit(1), F.size("labels"))))
    suffixes = suffixes.withColumn("suffix", F.array_join(F.slice("labels", -F.col("k"), F.col("k")), "."))
    keyed = rules.select(F.col("host").alias("suffix"), F.col("path").alias("start"), F.col("verdict").alias("said"))
    name = _free(parted, "best")
    best = (
        suffixes.join(keyed, "suffix")
        .where("startswith(path, start)")
        .groupBy("host", "path")
        .agg(
            F.max_by(
                F.struct(F.concat("suffix", "start").alias("rule"), "said"),
                F.struct("k", F.length("start"), F.when(F.col("said") == "allow", 1).otherwise(0)),
            ).alias(name)
        )
    )
    return (
        parted.join(best, ["host", "path"], "left")
        .withColumns({"rule": F.col(f"{name}.rule"), "verdict": F.coalesce(f"{name}.said", F.lit(default))})
        .drop(name)
    )
