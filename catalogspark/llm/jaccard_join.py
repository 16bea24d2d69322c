"""N-gram Jaccard join with a prefix tree.

How it runs:

1. Each text becomes its set of word-shingle hashes (64 bits). Equal sets are folded into one
   class (a 128-bit digest), so exact copies never meet pairwise.
2. Classes that may link share one of `BANDS` keys, each made of `ROWS` minwise hashes of the set.
   Two sets with a Jaccard index of 0.8 miss all 40 keys of 3 with probability (1 - 0.8**3)**40,
   about 3e-13. A key points its classes at one centre: edges grow with the classes, not their pairs.
3. The components of those edges are the groups within which sets are compared. A group larger
   than `BLOCK_SHINGLES` shingles is dealt into blocks, and each pair of blocks is one unit.
4. In a unit the sets are ordered by one order of n-grams (common first) and stored as a trie. One
   traversal keeps, per trie node, the overlap of the node's path with every set; sets below
   a node share it. Columns whose overlap plus what remains on either side can't reach the threshold
   are pruned for the whole subtree. At a leaf the exact sizes decide.
5. Verified links go through connected components once more.

Defined results: null or wordless text has an empty set and links with nothing; repeated rows
each get a row; a null id gets a null component and is never a representative; extra columns
are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytesops import U, mix, shingles, slices
from .common import bounded_batches, cut, lean, release, staged
from .components import components

BANDS, ROWS = 40, 3
BLOCK_SHINGLES = 500_000
#: Bytes of the matrix that tells which shingles a column of sets holds.
MEMBER_BYTES = 1 << 25
_SEEDS = mix(np.arange(1, BANDS * ROWS + 1, dtype=U) * U(0x9FB21C651E98DF25)) | U(1)
_BAND = mix(np.arange(1, BANDS + 1, dtype=U) * U(0xC2B2AE3D27D4EB4F))


def _bytes(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def band_keys(items: np.ndarray) -> np.ndarray:
    """The set's BANDS keys."""
    low = np.empty(len(_SEEDS), U)
    for k in range(0, len(_SEEDS), 8):
        part = items[:, None] * _SEEDS[None, k : k + 8]
        part ^= part >> U(29)
        part *= U(0xBF58476D1CE4E5B9)
        low[k : k + 8] = part.min(axis=0)
    rows = low.reshape(BANDS, ROWS)
    key = _BAND.copy()
    for k in range(ROWS):
        key = mix(key ^ rows[:, k]) + U(k)
    return key


def _sets(n: int, keys: bool):
    """Arrow batches of (id, text[, ...]) -> digest and band keys, or the set itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = _bytes(batch.column("text"))
            for a, b in slices([len(t) for t in texts]):
                found = shingles(texts[a:b], n)
                part = batch.slice(a, b - a)
                if keys:
                    yield pa.RecordBatch.from_pydict(
                        {
                            "id": part.column("id"),
                            "mark": part.column("mark"),
                            "n": pa.array([len(s) for s in found], pa.int64()),
                            "d1": pa.array(np.array([mix(s).sum(dtype=U) for s in found], U).view(np.int64)),
                            "d2": pa.array(np.array([mix(s ^ _BAND[0]).sum(dtype=U) for s in found], U).view(np.int64)),
                            "keys": pa.array(
                                [band_keys(s).view(np.int64) if len(s) else [] for s in found], pa.list_(pa.int64())
                            ),
                        }
                    )
                else:
                    yield pa.RecordBatch.from_pydict(
                        {
                            "id": part.column("id"),
                            "grp": part.column("grp"),
                            "nb": part.column("nb"),
                            "copies": part.column("copies"),
                            "items": pa.array([s.tobytes() for s in found], pa.binary()),
                        }
                    )

    return run


def trie_links(sets: list[np.ndarray], block: np.ndarray, num: int, den: int) -> Iterator[tuple[int, np.ndarray]]:
    """Pairs (i, js) with |x & y| * den >= num * |x | y|, each j met before i, by one trie traversal.

    `block`: pairs of the same block are left out if there are two blocks.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    items = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    values, code, count = np.unique(items, return_inverse=True, return_counts=True)
    order = np.lexsort((values, -count))
    shared = int((count > 1).sum())  # common first; n-grams of a single set come last and overlap nothing
    rank = np.empty(len(values), np.int64)
    rank[order] = np.arange(len(values))
    code = rank[code]
    keep = code < shared
    code, owner = code[keep], owner[keep]
    by = np.lexsort((code, owner))
    code, owner = code[by], owner[by]
    cuts = np.searchsorted(owner, np.arange(len(sets) + 1))
    path = [code[cuts[i] : cuts[i + 1]] for i in range(len(sets))]
    turn = sorted((i for i in range(len(sets)) if len(path[i])), key=lambda i: path[i].astype(">u4").tobytes())
    longest = max((len(x) for x in path), default=0)
    two = len(set(block.tolist())) > 1
    width = max(1, MEMBER_BYTES // max(1, shared))
    at = np.empty(len(sets), np.int64)
    at[turn] = np.arange(len(turn))
    for left in range(0, len(turn), width):
        cols = np.array(turn[left : left + width])
        member = np.zeros((shared, len(cols)), np.uint8)
        for k, i in enumerate(cols):
            member[path[i], k] = 1
        # remaining[c]: shared n-grams of the column's set; its part behind a node is the rest minus the overlap
        size_c, path_c = sizes[cols], np.array([len(path[i]) for i in cols], np.int64)
        stack = [(0, np.zeros(len(cols), np.int32), np.arange(len(cols)))]
        before = None
        # sets before the columns have no partner among them
        for place, i in enumerate(turn[left:], left):
            mine = path[i]
            depth = 0
            if before is not None:
                m = min(len(before), len(mine))
                differ = np.flatnonzero(before[:m] != mine[:m])
                depth = int(differ[0]) if len(differ) else m
            before = mine
            while stack[-1][0] > depth:
                stack.pop()
            top, overlap, alive = stack[-1]
            if top < depth:
                overlap = overlap + member[mine[top:depth]][:, alive].sum(axis=0, dtype=np.int32)
                stack.append((depth, overlap, alive))
            # a link of sizes c and s needs num * (c + s) / (den + num) common n-grams; what is left behind
            # the branch on the shorter side bounds the overlap
            reach = overlap + np.minimum(path_c[alive] - overlap, len(mine) - depth)
            need = -((-num * (size_c[alive] + sizes[i])) // (den + num))
            live = reach >= need
            if two:
                live &= block[cols[alive]] != block[i]
            live &= at[cols[alive]] < place
            if live.any():
                some = alive[live]
                total = overlap[live] + member[mine[depth:]][:, some].sum(axis=0, dtype=np.int32)
                union = sizes[i] + size_c[some] - total
                hit = some[total.astype(np.int64) * den >= num * union]
                if len(hit):
                    yield i, cols[hit]
            if top < depth:  # for the whole subtree: any partner has num / den of the column's size at least
                bound = overlap + np.minimum(path_c[alive] - overlap, longest - depth)
                stay = bound * den >= num * size_c[alive]
                if not stay.all():
                    stack[-1] = (depth, overlap[stay], alive[stay])


def _compare(num: int, den: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        sets = [np.frombuffer(x, U) for x in pdf["items"]]
        ids, copies = pdf["id"].to_numpy(), pdf["copies"].to_numpy()
        if len(sets) < 2:
            return pd.DataFrame({"u": [], "v": [], "links": []}, dtype="int64")
        label, links = np.arange(len(sets)), np.zeros(len(sets), np.int64)
        for i, js in trie_links(sets, pdf["block"].to_numpy(), num, den):
            links[i] += copies[js].sum()
            links[js] += copies[i]
            old = np.unique(np.append(label[js], label[i]))
            if len(old) > 1:
                label[np.isin(label, old)] = old[0]
        some = np.flatnonzero(links)
        if len(sets) > 500:
            release()
        return pd.DataFrame({"u": ids[some], "v": ids[label[some]], "links": links[some]})

    return run


def _classes(meta: DataFrame) -> DataFrame:
    """(n, d1, d2, class_size, rep, mark, node): each distinct set, its smallest id with that row's text hash, and the number it
    goes by: the id, or, where that stands for another set too, one above all ids made from the set."""
    classes = meta.where("n > 0 and id is not null").groupBy("n", "d1", "d2").agg(
        F.min(F.struct("id", "mark")).alias("one"), F.count(F.lit(1)).alias("class_size")
    )
    classes = staged(classes.select("n", "d1", "d2", "class_size", F.col("one.id").alias("rep"), "one.mark"), "jaccard-classes")
    shared = classes.groupBy("rep").agg(F.min("mark").alias("least"), F.count(F.lit(1)).alias("sets")).where("sets > 1")
    made = F.shiftrightunsigned(F.xxhash64("rep", "mark", "n", "d1", "d2"), 2) + F.lit(1 << 62)
    node = F.when(F.col("least").isNull() | (F.col("least") == F.col("mark")), F.col("rep")).otherwise(made)
    return classes.join(shared, "rep", "left").select("n", "d1", "d2", "class_size", "rep", "mark", node.alias("node"))


def jaccard_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, num: int = 80, den: int = 100
) -> DataFrame:
    """(id, n_shingles, component_id, class_id, class_size, n_links): linked when den*|x&y| >= num*|x|y|.

    `component_id` is the smallest id reachable over links; `class_id` the smallest id with an equal
    set, of which there are `class_size`; `n_links` counts the rows that a row links with. The documented thresholds 80/100 fix BANDS and ROWS; lower ones lose recall.
    """
    text = F.col(text_col).cast("string")
    rows = bounded_batches(docs).select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("mark"), text.alias("text"))
    meta = staged(
        rows.mapInArrow(lean(_sets(n, keys=True)), "id long, mark long, n long, d1 long, d2 long, keys array<long>"), "jaccard-keys"
    )
    classes = _classes(meta)
    reps = meta.join(classes.select(F.col("rep").alias("id"), "mark", "n", "d1", "d2", "node"), ["id", "mark", "n", "d1", "d2"])
    reps = reps.select(F.col("node").alias("id"), "n", "keys").dropDuplicates(["id"])
    keyed = reps.select("id", F.explode("keys").alias("key"))
    hubs = keyed.groupBy("key").agg(F.min("id").alias("hub"), F.count(F.lit(1)).alias("c")).where("c > 1")
    near = keyed.join(hubs, "key").where("id <> hub").select(F.col("id").alias("u"), F.col("hub").alias("v"))
    groups = components(near)
    sized = groups.join(reps.select("id", "n"), "id").join(
        classes.select(F.col("node").alias("id"), "rep", "mark", F.col("class_size").alias("copies")), "id"
    )
    blocks = sized.groupBy("component").agg(
        F.ceil(F.sum("n") / F.lit(float(BLOCK_SHINGLES))).cast("int").alias("nb")
    )
    marked = sized.join(blocks, "component").select(F.col("id").alias("node"), F.col("rep").alias("id"), "mark", F.col("component").alias("grp"), "nb", "copies")
    texts = rows.join(marked, ["id", "mark"]).dropDuplicates(["node"]).select(F.col("node").alias("id"), "grp", "nb", "copies", "text")
    block = F.pmod(F.xxhash64("id"), F.col("nb").cast("long")).cast("int")
    units = (
        texts.mapInArrow(lean(_sets(n, keys=False)), "id long, grp long, nb int, copies long, items binary")
        .withColumn("block", block)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
        .withColumn("lo", F.least("block", "other"))
        .withColumn("hi", F.greatest("block", "other"))
    )
    links = cut(units.groupBy("grp", "lo", "hi").applyInPandas(_compare(num, den), "u long, v long, links long"))
    linked = components(links.select("u", "v"))
    degrees = links.groupBy(F.col("u").alias("node")).agg(F.sum("links").alias("links"))
    named = classes.join(linked, classes.node == linked.id, "left").join(degrees, "node", "left")
    # a component of a node that isn't an id: the smallest of its ids; no rows unless ids repeat over different texts
    under = classes.where("node <> rep").join(linked, classes.node == linked.id).groupBy("component").agg(F.min("rep").alias("under"))
    named = named.join(under, "component", "left").select(
        "n", "d1", "d2", "rep", "class_size", F.least(F.coalesce("component", "rep"), "under").alias("component"), "links"
    )
    return meta.join(named, ["n", "d1", "d2"], "left").select(
        F.col("id"),
        F.col("n").alias("n_shingles"),
        F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id"),
        F.coalesce("rep", "id").alias("class_id"),
        F.coalesce("class_size", F.lit(1)).alias("class_size"),
        F.when(F.col("id").isNull(), 0).otherwise(F.coalesce("links", F.lit(0)) + F.coalesce("class_size", F.lit(1)) - 1).alias("n_links"),
    )
