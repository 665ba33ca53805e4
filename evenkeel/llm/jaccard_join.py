"""N-gram Jaccard join with signature trees.

1. Every document becomes its set of word shingles, a bitmap of it and its prefix: its first shingles in a fixed
   order, so many that two sets of the wanted similarity share one of them. Equal sets become one node. The order is
   by hash, with shingles last that are frequent in a sample; any order gives the same result, this one small blocks.
2. Nodes that share a prefix shingle form a block; blocks with the same nodes are one. Within a block a signature
   tree holds OR-combined bitmaps and size ranges, and a traversal of the tree with itself drops pairs of tree
   nodes whose largest possible overlap is too small. What is left joins nodes to candidate sets.
3. The candidates' texts are read again and compared exactly, set by set, in tasks of bounded size.
Nothing is lost: prefixes, bounds and comparisons are exact up to equal 64-bit hashes of shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from evenkeel.llm.common import (
    arrow_map, chunk_pairs, components, Forest, groups, in_order, mix, narrow, shingle_set, stored, utf8, unused,
)

WORDS, PERCENT = 5, 80
LEAF, FANOUT = 32, 8
BLOCK_ROWS = 4096  # nodes of one block in a task's part
ORDER_SAMPLE, ORDER_LEAST, ORDER_MOST = 10_000, 4, 200_000  # documents; times seen; shingles put last
SET_HASHES = 1_000_000  # hashes of candidate sets in a task's part


def bitmap(hashes: np.ndarray) -> np.ndarray:
    """Bit (hash mod m) set for every hash; m is a power of two, at least 64 and twice the count."""
    bits = max(64, 1 << int(2 * max(1, len(hashes)) - 1).bit_length())
    filled = np.zeros(bits, bool)
    filled[(hashes & np.uint64(bits - 1)).astype(np.int64)] = True
    return np.packbits(filled, bitorder="little")


def prefix(hashes: np.ndarray, percent: int, last: np.ndarray) -> np.ndarray:
    """The first n - ceil(n * percent / 100) + 1 hashes, those in the sorted array ``last`` behind the others."""
    count = len(hashes) - -(-percent * len(hashes) // 100) + 1
    if len(last):
        at = np.minimum(np.searchsorted(last, hashes), len(last) - 1)
        frequent = last[at] == hashes
        hashes = np.concatenate((hashes[~frequent][:count], hashes[frequent][:count]))
    return hashes[:count].view(np.int64)


def described(batch: pa.RecordBatch, words: int, percent: int, last: np.ndarray | None) -> dict:
    """Set size, node, smallest hash, bitmap and prefix of every text; without ``last`` the whole set instead."""
    n, node, lead, sig, part = [], [], [], [], []
    for text in utf8(batch, "text"):
        hashes = shingle_set(text, words)
        count = len(hashes)
        n.append(count)
        if not count:
            node.append(None), lead.append(None), sig.append(None), part.append(None)
            continue
        mark = mix(np.array([int(mix(hashes).sum(dtype=np.uint64)) ^ count], np.uint64))
        node.append(int(mark.view(np.int64)[0]))
        signed = hashes.view(np.int64)
        lead.append(int(signed[0]))
        sig.append(bitmap(hashes).tobytes())
        part.append(signed if last is None else prefix(hashes, percent, last))
    kept = {c: batch.column(c) for c in batch.schema.names if c != "text"}
    return kept | {"n": n, "node": node, "lead": lead, "sig": sig, "hashes": part}


class Tree:
    """Signature tree over the rows of one part: leaves of 32 rows, eight children to a node."""

    def __init__(self, rows: np.ndarray, sizes: np.ndarray, bits: np.ndarray, lead: np.ndarray) -> None:
        band = np.floor(np.log(sizes[rows]) / np.log(1.25))
        rows = rows[np.lexsort((lead[rows], band))]  # like sets have near sizes and often the same smallest hash
        slack = sizes[rows] - np.bitwise_count(bits[rows]).sum(1)  # shingles that share a bit with another
        level = [
            ((), rows[i : i + LEAF], np.bitwise_or.reduce(bits[rows[i : i + LEAF]]), sizes[rows[i : i + LEAF]].min(),
             sizes[rows[i : i + LEAF]].max(), slack[i : i + LEAF].max())
            for i in range(0, len(rows), LEAF)
        ]
        while len(level) > 1:
            level = [
                (tuple(kids), np.concatenate([k[1] for k in kids]), np.bitwise_or.reduce([k[2] for k in kids]),
                 min(k[3] for k in kids), max(k[4] for k in kids), max(k[5] for k in kids))
                for kids in (level[i : i + FANOUT] for i in range(0, len(level), FANOUT))
            ]
        self.root = level[0]


def possible(x: tuple, y: tuple, percent: int) -> bool:
    """Whether some pair below two tree nodes may be similar enough, by sizes and by the bits they share."""
    if percent * max(x[3], y[3]) > 100 * min(x[4], y[4]):
        return False
    most = min(x[4], y[4], int(np.bitwise_count(x[2] & y[2]).sum()) + min(x[5], y[5]))
    return (100 + percent) * most >= percent * (x[3] + y[3])


def traverse(x: tuple, y: tuple, percent: int, forest: Forest, leaf_hits) -> None:
    """Dual traversal; a pair of nodes is left out if its bound is too small or its rows are connected already."""
    stack = [(x, y)]
    while stack:
        x, y = stack.pop()
        if (len(x[1]) > 1 or x is not y) and forest.together(x[1], y[1]):
            continue
        if x is not y and not possible(x, y, percent):
            continue
        if not x[0] and not y[0]:
            forest.link(x[1], y[1], leaf_hits(x[1], y[1]))
        elif x is y:
            stack += [(x[0][i], x[0][j]) for i in range(len(x[0])) for j in range(i, len(x[0]))]
        elif x[0] and (not y[0] or len(x[1]) >= len(y[1])):
            stack += [(kid, y) for kid in x[0]]
        else:
            stack += [(x, kid) for kid in y[0]]


def folded(cols: dict, first: int, end: int, rows: np.ndarray) -> np.ndarray:
    """The bitmaps of some rows as a matrix of 64-bit words, long ones OR-folded to the shortest length."""
    flat, offsets = cols["sig"]
    widths = np.diff(offsets[first : end + 1])
    width = int(widths[rows].min())
    out = np.zeros((end - first, width // 8), np.uint64)
    for w in np.unique(widths[rows]):
        some = rows[widths[rows] == w]
        raw = flat[offsets[first:end][some][:, None] + np.arange(w)]
        out[some] = np.bitwise_or.reduce(raw.reshape(len(some), -1, width), axis=1).view(np.uint64)
    return out


def sides(cols: dict, first: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    part, i, j = cols["part"][first:end], cols["part_i"][first], cols["part_j"][first]
    return np.flatnonzero(part == i), np.flatnonzero(part == j)


def size_runs(cols: dict, first: int, end: int) -> list[np.ndarray]:
    """Rows in overlapping ranges of bitmap length: similar sets have equal or neighbouring lengths."""
    widths = np.diff(cols["sig"][1][first : end + 1])
    found = np.unique(widths)
    return [
        np.flatnonzero((widths == w) | (widths == 2 * w)) if 2 * w in found else np.flatnonzero(widths == w)
        for w in found
    ]


def tree_links(cols: dict, first: int, end: int, percent: int, exact: bool, active: np.ndarray | None = None) -> Forest:
    """Joins the rows of one task whose bitmaps allow it (or, if ``exact``, whose sets prove it)."""
    sizes = cols["n"][first:end].astype(np.int64)
    lead = cols["lead"][first:end]
    left, right = sides(cols, first, end)
    same = cols["part_i"][first] == cols["part_j"][first]
    forest = Forest(end - first)
    for run in size_runs(cols, first, end):
        bits = folded(cols, first, end, run)

        def hits(a: np.ndarray, b: np.ndarray, bits: np.ndarray = bits) -> np.ndarray:
            small, large = np.minimum(sizes[a][:, None], sizes[b]), np.maximum(sizes[a][:, None], sizes[b])
            need = -(-percent * (small + large) // (100 + percent))
            out = percent * large <= 100 * small
            out &= a[:, None] != b
            if active is not None:
                out &= active[a][:, None] | active[b]
            out &= forest.labels[a][:, None] != forest.labels[b]
            for i in np.flatnonzero(out.any(1)).tolist():
                js = np.flatnonzero(out[i])
                common = bits[a[i]] & bits[b[js]]
                shared = np.bitwise_count(common).sum(1)
                most = np.minimum(
                    sizes[a[i]] - np.bitwise_count(bits[a[i]]).sum() + shared,
                    sizes[b[js]] - np.bitwise_count(bits[b[js]]).sum(1) + shared,
                )
                out[i, js] = most >= need[i, js]
                if exact:
                    mine = set_of(cols, first, int(a[i]))
                    for j in js[out[i, js]].tolist():
                        if forest.labels[a[i]] == forest.labels[b[j]]:
                            out[i, j] = False
                            continue
                        both = len(np.intersect1d(mine, set_of(cols, first, int(b[j])), assume_unique=True))
                        out[i, j] = 100 * both >= percent * (sizes[a[i]] + sizes[b[j]] - both)
                        if out[i, j]:
                            forest.link(a[i : i + 1], b[j : j + 1], np.ones((1, 1), bool))
            return out

        mine = np.intersect1d(left, run)
        others = mine if same else np.intersect1d(right, run)
        if len(mine) and len(others) and (not same or len(mine) > 1):
            x = Tree(mine, sizes, bits, lead).root
            traverse(x, x if same else Tree(others, sizes, bits, lead).root, percent, forest, hits)
    return forest


def set_of(cols: dict, first: int, row: int) -> np.ndarray:
    flat, offsets = cols["hashes"]
    return flat[offsets[first + row] : offsets[first + row + 1]]


def edge_batch(node: np.ndarray, links: list[tuple[int, int]]) -> pa.RecordBatch:
    pairs = np.array(links, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(node[pairs[:, 0]]), pa.array(node[pairs[:, 1]])], names=["a", "b"])


def pruned(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...], percent: int, exact: bool):
    for cols, first, end in groups(batches, keys):
        if end - first > 1:
            active = cols["loose"][first:end].astype(bool) if "loose" in cols else None
            forest = tree_links(cols, first, end, percent, exact, active)
            if forest.links:
                yield edge_batch(cols["node"][first:end], forest.links)


def exact_edges(members: DataFrame, split: bool, percent: int) -> DataFrame:
    """Exact links within candidate sets of ``members(comp, size, chunks, node, n, lead, sig, hashes)``.

    A set that is too large for one task is cut into parts; every part is joined within itself and with eight
    members that all parts get. If that leaves several pieces, the pairs of parts are compared too, but for pairs
    inside the largest piece, which is joined already.
    """
    keys = ("comp", "part_i", "part_j")
    schema = "a long, b long"
    placed = members.withColumn("own", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    placed = placed.withColumn("pivot", F.pmod(F.xxhash64("node", F.lit(1)), F.greatest(F.lit(1), F.col("size") / 8).cast("long")) == 0)
    parts = F.when(
        F.col("pivot") & (F.col("chunks") > 1), F.sequence(F.lit(0), F.col("chunks").cast("int") - 1)
    ).otherwise(F.array("own"))
    once = placed.withColumn("part", F.explode(parts)).withColumns({"part_i": F.col("part"), "part_j": F.col("part")})
    shape = ["comp", "part_i", "part_j", "part", "node", "n", "lead", "sig", "hashes"]
    edges = stored(
        in_order(once.select(*shape), keys).mapInArrow(lambda b: pruned(b, keys, percent, True), schema)
    )
    if not split:
        return edges
    wide = placed.filter("chunks > 1")
    roots = components(edges)
    pieces = wide.select("comp", "node", "n").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    count = pieces.groupBy("comp", "root").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("hashes_in"))
    main = count.groupBy("comp").agg(
        F.max_by("root", F.struct("rows", "root")).alias("main"), F.count(F.lit(1)).alias("pieces"),
        F.sum("hashes_in").alias("all_hashes"), F.max(F.struct("rows", "root", "hashes_in")).alias("top"),
    ).filter("pieces > 1").select(
        "comp", "main", F.ceil((F.col("all_hashes") - F.col("top.hashes_in")) / SET_HASHES).cast("int").alias("loose_parts")
    )
    told = pieces.join(main, "comp").select("comp", "node", (F.col("root") != F.col("main")).alias("loose"), "loose_parts")
    again = wide.join(told, ["comp", "node"])
    # a loose row is one side in its own loose part and, as any row, the other side in its part of all rows
    loose = again.filter("loose").withColumn("part_i", F.pmod(F.xxhash64("node", F.lit(2)), F.col("loose_parts")).cast("int")).withColumn(
        "part_j", F.explode(F.sequence(F.lit(0), F.col("chunks").cast("int") - 1))
    ).withColumn("part_j", F.col("part_j") + F.col("loose_parts")).withColumn("part", F.col("part_i"))
    rest = again.withColumn("part_j", (F.col("own") + F.col("loose_parts")).cast("int")).withColumn(
        "part_i", F.explode(F.sequence(F.lit(0), F.col("loose_parts") - 1))
    ).withColumn("part", F.col("part_j"))
    shape.append("loose")
    both = loose.select(*shape).unionByName(rest.select(*shape))
    more = stored(in_order(both, keys).mapInArrow(lambda b: pruned(b, keys, percent, True), schema))
    return edges.union(more)


def frequent_shingles(rows: DataFrame, words: int, percent: int) -> np.ndarray:
    """Sorted hashes of shingles that several texts of a bounded sample hold."""
    total = rows.count()
    share = min(1.0, ORDER_SAMPLE / max(1, total))
    some = rows.filter(F.pmod(F.xxhash64("mark", F.lit(7)), F.lit(1 << 20)) < int(share * (1 << 20)))
    shape = "n long, node long, lead long, sig binary, hashes array<long>"
    sets = arrow_map(some.select("text"), lambda b: described(b, words, percent, None), shape)
    once = sets.filter("node is not null").groupBy("node").agg(F.first("hashes").alias("hashes"))
    seen = once.select(F.explode("hashes").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("times"))
    kept = seen.filter(F.col("times") >= ORDER_LEAST).orderBy(F.desc("times"), "key").limit(ORDER_MOST).collect()
    return np.sort(np.array([r["key"] for r in kept], np.int64).view(np.uint64))


def labelled(docs: DataFrame, id_col: str, text_col: str, words: int, percent: int) -> DataFrame:
    """(doc_id, mark, n, node, root) of every row: hash of its text, set size, its set and its set's component."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.withColumn("mark", F.xxhash64("text")).withColumn("rid", F.coalesce("doc_id", "mark"))
    kept = "rid long, mark long, "
    shape = "n long, node long, lead long, sig binary, hashes array<long>"
    sent = docs.sparkSession.sparkContext.broadcast(frequent_shingles(rows, words, percent))  # at most ORDER_MOST
    sets = stored(arrow_map(rows, lambda b: described(b, words, percent, sent.value), f"doc_id long, {kept}{shape}"))
    same = ["mark_1", "lead", "n"]  # of equal sets; no two different ones among 10^15 are expected to agree in all
    full = sets.filter("node is not null").withColumnRenamed("node", "mark_1")
    nodes = full.groupBy(*same).agg(
        F.first("sig").alias("sig"), F.first("hashes").alias("hashes"), F.min(F.struct("rid", "mark")).alias("id")
    )
    nodes = stored(nodes.withColumn("node", F.monotonically_increasing_id()))

    # blocks: nodes that share a prefix shingle; counted map-side, so a shingle of very many sets is no one task's
    prefixes = nodes.select("node", F.explode("hashes").alias("key"))
    counted = prefixes.groupBy("key").agg(
        F.count(F.lit(1)).alias("members"), F.bit_xor(F.xxhash64("node")).alias("set_mark")
    )
    shared = prefixes.join(narrow(stored(counted.filter("members > 1"))), "key")
    blocks = stored(shared.select(F.xxhash64("members", "set_mark").alias("block"), "members", "node").distinct())
    signed = nodes.select("node", "n", "lead", "sig")
    keys = ("block", "part_i", "part_j")
    met = chunk_pairs(blocks, "block", "node", F.ceil(F.col("members") / BLOCK_ROWS)).join(signed, "node")
    met = met.select(*keys, "part", "node", "n", "lead", "sig")
    maybe = stored(in_order(met, keys).mapInArrow(lambda b: pruned(b, keys, percent, False), "a long, b long"))
    comps = components(maybe).withColumnRenamed("root", "comp")

    # the candidates' sets, from their texts
    chosen = stored(comps.join(nodes.select("node", *same, "id"), "node"))
    weigh = chosen.groupBy("comp").agg(
        F.ceil(F.sum("n") / SET_HASHES).cast("int").alias("chunks"), F.count(F.lit(1)).alias("size")
    )
    wanted = stored(
        chosen.join(weigh, "comp").select(
            "id.rid", "id.mark", F.col("node").alias("own"), F.struct(*same).alias("expected"), "comp", "size", "chunks"
        )
    )
    picked = rows.select("rid", "mark", "text").join(narrow(wanted), ["rid", "mark"])
    members = arrow_map(
        picked.select("own", "expected", "comp", "size", "chunks", "text"),
        lambda b: described(b, words, percent, None),
        f"own long, expected struct<mark_1: long, lead: long, n: long>, comp long, size long, chunks int, {shape}",
    ).filter("expected = struct(node, lead, n)")
    members = members.withColumn("node", F.col("own")).drop("own")
    edges = exact_edges(members, not wanted.filter("chunks > 1").isEmpty(), percent)
    roots = components(edges)
    named = nodes.select("node", *same).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    return (
        sets.select("doc_id", "mark", F.col("node").alias("mark_1"), "lead", "n")
        .join(named, same, "left")
        .select("doc_id", "mark", "n", "node", "root")
    )


def join_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_shingles, component_id``.

    Words are runs of characters other than U+0020 and U+0009-000D, A-Z as a-z. Two documents link when
    100 * |A and B| >= ``percent`` * |A or B| for their sets of distinct ``words``-word shingles; with fewer words
    the whole sequence is the one shingle. component_id is the smallest id reachable by links.

    Null or blank text: an empty set, linked with nothing, component is the own id. Repeated rows and rows of one
    id are separate rows; a null id stays null and names a component only if all its ids are null. Texts are read
    whole at any length. An empty table gives an empty result; other columns are ignored.
    """
    found = stored(labelled(docs, id_col, text_col, words, percent))
    least = found.filter("node is not null").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return found.join(least, "root", "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
    )


def keep_one(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT
) -> DataFrame:
    """``docs`` with one row of each component: of the smallest id, then the smallest text hash.

    Rows without words stay; null ids lose to others; of equal rows one stays. All columns are kept as they are.
    """
    found = stored(labelled(docs, id_col, text_col, words, percent).filter("node is not null"))
    best = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "mark")).alias("best"))
    own_id, own_mark = unused(docs, "own_id"), unused(docs, "own_mark")
    rid = F.coalesce("doc_id", "mark").alias(own_id)
    judged = found.join(best, "root").select(
        rid, F.col("mark").alias(own_mark), (F.xxhash64("doc_id", "mark") == F.xxhash64("best.doc_id", "best.mark")).alias("wins")
    )
    judged = stored(judged.groupBy(own_id, own_mark).agg(F.max("wins").alias("wins"), F.count(F.lit(1)).alias("times")))
    mark = F.xxhash64(F.col(text_col).cast("string"))
    own = docs.withColumn(own_mark, mark).withColumn(own_id, F.coalesce(F.col(id_col).cast("long"), F.col(own_mark)))
    left = own.join(narrow(judged.filter("not wins").select(own_id, own_mark)), [own_id, own_mark], "left_anti")
    again = judged.filter("wins and times > 1").select(own_id, own_mark)
    if not again.isEmpty():
        once = left.join(again, [own_id, own_mark], "left_semi").dropDuplicates([own_id, own_mark])
        left = left.join(again, [own_id, own_mark], "left_anti").unionByName(once)
    return left.select(docs.columns)
