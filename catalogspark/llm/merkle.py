"""A Merkle manifest of a table: a proof for every row, from its leaf over its group's subroot to the root.

A leaf is the digest of a row's fields. Per group, leaves ascend by id; every 8 consecutive nodes become one node, until one
is left, the subroot; the subroots, ordered by group, become the root in the same way. Digests are SHA-256 over hex text.

Method: a leaf's rank in its group is written in digits of base 8. Within blocks of 512 leaves the digits are grouped away
one after the other, each time nesting the child structs in their parent, so that a block is one row that holds its whole
tree. A transform over the nested structs and one explode then emit the proofs of all its leaves; no leaf is ever joined.
The digests of blocks are the leaves of the next, 512 times smaller table, and so on; what stands above a block comes back
to it as one row, by the block's number. No row or task holds more than a block.

Ranks come from a range sort: places within the written partitions, plus what earlier partitions hold of the group
(at most one row a partition). A group that holds most rows is spread over as many partitions as its rows need.

Defined results: null fields count as `-`, and a null group is a group, the first; null ids come first; rows of one id
stand in the order of their leaves; equal rows each get a place of their own; an empty table has no rows; other columns
of the table play no part. A group of one row has that row's leaf as its subroot, and a single group's subroot is the root.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

FAN = 8
#: Levels in a block; 8**3 leaves.
LEVELS = 3
BLOCK = FAN**LEVELS


def digest_of(fields: list[Column]) -> Column:
    """SHA-256 in hex of the fields: `-` for null, else the UTF-8 byte count, `:` and the value."""
    parts = []
    for field in fields:
        text = field.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def fold(leaf: Column, proof: Column) -> Column:
    """The root that `leaf` leads to: at each step the digest of the siblings with the node in its place."""

    def step(node: Column, at: Column) -> Column:
        before = F.slice(at["siblings"], F.lit(1), at["place"])
        after = F.slice(at["siblings"], at["place"] + 1, F.size(at["siblings"]))
        return F.sha2(F.concat(F.array_join(before, ""), node, F.array_join(after, "")), 256)

    return F.aggregate(proof, leaf, step)


def proof_digest(proof: Column) -> Column:
    """SHA-256 in hex of all siblings of a proof, in their order."""
    return F.sha2(F.array_join(F.flatten(F.transform(proof, lambda at: at["siblings"])), ""), 256)


def ranked(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """`rows` with `rank` (from 0, in the group, by `order`) and `total` (the group's rows). `group` is never null."""
    keys = [group, *order, "__salt"]
    dealt = rows.withColumn("__salt", F.monotonically_increasing_id())
    dealt = dealt.repartitionByRange(*[F.col(k) for k in keys]).sortWithinPartitions(*keys).drop("__salt")
    place = F.monotonically_increasing_id()
    written = staged(dealt.withColumn("__place", place), "merkle-sorted").withColumns(
        {"__part": F.shiftright("__place", 33), "__place": F.col("__place").bitwiseAND((1 << 33) - 1)}
    )
    runs = written.groupBy(group, "__part").agg(F.min("__place").alias("__first"), F.count(F.lit(1)).alias("__n"))
    runs = runs.selectExpr(
        group,
        "__part",
        f"coalesce(sum(__n) over (partition by {group} order by __part rows between unbounded preceding and 1 preceding), 0)"
        " - __first as __shift",
        f"sum(__n) over (partition by {group}) as total",
    )
    found = written.join(runs, [group, "__part"]).withColumn("rank", F.col("__place") + F.col("__shift"))
    return found.drop("__part", "__place", "__first", "__shift")


def _blocks(nodes: DataFrame) -> DataFrame:
    """(grp, rank, total, hash, own) -> (grp, total, block, hash, kids): one row a block, `kids` its nested tree."""
    digits = {"block": F.expr(f"rank div {BLOCK}")}
    digits |= {f"d{k}": F.expr(f"cast(rank div {FAN**k} % {FAN} as int)") for k in range(LEVELS)}
    keys = ["grp", "total", "block"]
    nodes = nodes.withColumns(digits).drop("rank").repartition("grp", "block")
    inner = "own"
    for k in range(LEVELS):
        above = [f"d{j}" for j in range(LEVELS - 1, k, -1)]
        held = nodes.groupBy(*keys, *above).agg(F.sort_array(F.collect_list(F.struct(f"d{k}", "hash", inner))).alias("kids"))
        joined = F.sha2(F.array_join(F.col("kids.hash"), ""), 256)
        # A single node that is the whole level is the end of its tree, and stays as it is.
        nodes = held.withColumn("hash", F.when(F.col("total") > FAN**k, joined).otherwise(F.col("kids")[0]["hash"]))
        inner = "kids"
    return nodes


def _steps(blocks: DataFrame) -> DataFrame:
    """Blocks with `up` (the steps above them) -> one row for each leaf: rank, own, proof, and the blocks' other columns."""

    def level(kids: Column, k: int, above: Column, base: Column) -> Column:
        def one(kid: Column, i: Column) -> Column:
            beside = F.transform(F.filter(kids, lambda _, j: j != i), lambda x: x["hash"])
            step = F.array(F.struct(i.alias("place"), beside.alias("siblings")))
            proof = F.concat(F.when(F.col("total") > FAN**k, step).otherwise(F.slice(step, 1, 0)), above)
            rank = base + kid[f"d{k}"] * FAN**k
            if k == 0:
                return F.struct(rank.alias("rank"), kid["own"].alias("own"), proof.alias("proof"))
            return level(kid["kids"], k - 1, proof, rank)

        found = F.transform(kids, one)
        return F.flatten(found) if k else found

    leaf = F.explode(level(F.col("kids"), LEVELS - 1, F.col("up"), F.col("block") * BLOCK)).alias("leaf")
    return blocks.select("grp", "root", "subroot", leaf).select("grp", "root", "subroot", "leaf.*")


_NO_STEPS = "cast(array() as array<struct<place: int, siblings: array<string>>>)"


def _climb(nodes: DataFrame) -> list[DataFrame]:
    """The written block tables, from the leaves' up to that where each group is one block."""
    levels = [staged(_blocks(nodes), "merkle-blocks")]
    while (levels[-1].agg(F.max("total")).first()[0] or 0) > BLOCK:
        last = levels[-1]
        above = last.selectExpr("grp", "block as rank", f"ceil(total / {BLOCK}) as total", "hash", "struct(block) as own")
        levels.append(staged(_blocks(above), "merkle-blocks"))
    return levels


def _descend(levels: list[DataFrame], tops: DataFrame) -> DataFrame:
    """(grp, root, subroot, up) of the top blocks -> the rows of all leaves, with their proofs."""
    found = levels[-1].join(tops, "grp")
    for below in reversed(levels[:-1]):
        up = _steps(found).select("grp", F.col("rank").alias("block"), "root", "subroot", F.col("proof").alias("up"))
        found = below.join(up, ["grp", "block"])
    return _steps(found)


def merkle_proofs(
    docs: DataFrame,
    fields: list[str],
    group: str,
    order: str,
    carry: dict[str, Column] | None = None,
) -> DataFrame:
    """One row for each row of `docs`: `order`, leaf, `carry`, subroot, root, and
    proof: array of (place, siblings), from the leaf's run up to the root's."""
    more = carry or {}
    leaves = docs.select(
        F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("-")).alias("grp"),
        F.col(order).alias("__id"),
        digest_of([F.col(c) for c in fields]).alias("hash"),
        *[column.alias(f"__{name}") for name, column in more.items()],
    )
    own = F.struct("__id", F.col("hash").alias("__leaf"), *[f"__{name}" for name in more])
    nodes = ranked(leaves, "grp", ["__id", "hash"]).select("grp", "rank", "total", "hash", own.alias("own"))
    levels = _climb(nodes)

    subroots = levels[-1].select(F.lit("").alias("all"), "grp", F.col("hash").alias("subroot"))
    tops = ranked(subroots, "all", ["grp"]).select(
        F.col("all").alias("grp"), "rank", "total", F.col("subroot").alias("hash"), F.struct("grp", "subroot").alias("own")
    )
    root_levels = _climb(tops)
    whole = root_levels[-1].selectExpr("grp", "hash as root", "hash as subroot", f"{_NO_STEPS} as up")
    above = _descend(root_levels, whole).select("own.grp", "root", "own.subroot", F.col("proof").alias("up"))
    found = _descend(levels, above)
    return found.select(
        F.col("own.__id").alias(order),
        F.col("own.__leaf").alias("leaf"),
        *[F.col(f"own.__{name}").alias(name) for name in more],
        "subroot",
        "root",
        "proof",
    )
