"""Near-duplicate vectors by p-stable hashing: quantised random projections in several tables, exact cosines after."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from evenkeel.llm.common import chunk_pairs, columns_of, components, Forest, groups, in_order, mix, stored

TABLES, PROJECTIONS, WIDTH, SEED = 24, 12, 1.6, 20_240_601
CHUNK = 512  # vectors of one bucket that a task compares at once with as many others


def hash_keys(vectors: np.ndarray, tables: int, projections: int, width: float, seed: int) -> np.ndarray:
    """One 64-bit key per table: floor((a.v + b) / width) of Gaussian ``a`` and uniform ``b``, folded together."""
    draw = np.random.default_rng(seed)
    slopes = draw.standard_normal((vectors.shape[1], tables * projections))
    shifts = draw.uniform(0, width, tables * projections)
    cells = np.floor((vectors @ slopes + shifts) / width).astype(np.int64).view(np.uint64)
    cells = cells.reshape(len(vectors), tables, projections)
    keys = np.broadcast_to(np.arange(tables, dtype=np.uint64), cells.shape[:2]).copy()
    for p in range(projections):
        keys = mix(keys ^ cells[:, :, p])
    return keys.view(np.int64)


def unit(v: np.ndarray) -> np.ndarray:
    """Rows of length 1. A power of two, which changes no digit, first keeps squares from under- or overflowing."""
    v = np.ldexp(v, -np.frexp(np.abs(v).max(axis=1))[1][:, None])
    return v / np.linalg.norm(v, axis=1)[:, None]


def with_keys(batches: Iterator[pa.RecordBatch], tables: int, projections: int, width: float, seed: int):
    for batch in batches:
        if not batch.num_rows:
            continue
        flat, offsets = columns_of(pa.Table.from_batches([batch]))["vector"]
        sizes = np.diff(offsets)
        keys = np.zeros((batch.num_rows, tables), np.int64)
        for size in np.unique(sizes):  # vectors of several lengths may share a table; they never meet
            rows = np.flatnonzero(sizes == size)
            v = unit(flat[offsets[rows][:, None] + np.arange(size)].astype(np.float64))
            keys[rows] = hash_keys(v, tables, projections, width, seed)
        lists = pa.ListArray.from_arrays(np.arange(batch.num_rows + 1, dtype=np.int32) * tables, pa.array(keys.ravel()))
        yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*batch.schema.names, "keys"])


def compare(batches: Iterator[pa.RecordBatch], threshold: float, tables: int):
    """Links of each pair of parts: (node, null, rows linked with it) and (node, other, 0) of a spanning forest.

    Vectors of one length only are compared with each other.
    A pair counts in the first table that brings it together only, so nothing is counted twice.
    """
    for cols, first, end in groups(batches, ("bucket", "part_i", "part_j")):
        flat, offsets = cols["vector"]
        sizes = np.diff(offsets[first : end + 1])
        for size in np.unique(sizes):  # more than one only if the buckets of two lengths have one hash
            rows = first + np.flatnonzero(sizes == size)
            keys = cols["keys"][0].reshape(-1, tables)[rows]
            v = unit(flat[offsets[rows][:, None] + np.arange(size)].astype(np.float64))
            node, copies, table = cols["node"][rows], cols["copies"][rows], int(cols["t"][first])
            same = cols["part_i"][first] == cols["part_j"][first]
            left = np.flatnonzero(cols["part"][rows] == cols["part_i"][first])
            right = left if same else np.flatnonzero(cols["part"][rows] == cols["part_j"][first])
            if not len(left) or not len(right):
                continue
            hits = v[left] @ v[right].T >= threshold
            if same:
                np.fill_diagonal(hits, False)
            if not hits.any():
                continue
            for t in range(table):
                hits &= keys[left, t][:, None] != keys[right, t][None, :]
            hits &= cols["label"][rows][left][:, None] == cols["label"][rows][right][None, :]
            forest = Forest(len(rows))
            forest.link(left, right, hits)
            counts = np.zeros(len(rows), np.int64)
            np.add.at(counts, left, hits @ copies[right])
            if not same:
                np.add.at(counts, right, hits.T @ copies[left])
            some = np.flatnonzero(counts)
            links = np.array(forest.links, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate((node[some], node[links[:, 0]]))),
                    pa.array([None] * len(some) + node[links[:, 1]].tolist(), pa.int64()),
                    pa.array(np.concatenate((counts[some], np.zeros(len(links), np.int64)))),
                ],
                names=["a", "b", "n"],
            )


def near_duplicates(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    group_col: str = "label",
    threshold: float = 0.98,
    tables: int = TABLES,
    projections: int = PROJECTIONS,
    width: float = WIDTH,
    seed: int = SEED,
) -> DataFrame:
    """One row per row of ``vectors``: ``vec_id, n_links, component_id, kept``.

    Vectors of one group and one length link when their cosine (double precision) reaches ``threshold``. Equal vectors are one
    node with a count of copies, told apart by two 64-bit hashes. Finite vectors of any size link. At cosine 0.98 (distance 0.2) one projection of width 1.6 agrees with probability
    0.90, all twelve with 0.28, so a linked pair misses all 24 tables with probability 0.0004; closer pairs less.
    A random pair of a group shares a bucket with probability 0.00002. Buckets are cut into parts of at most 512
    vectors and compared part by part; a task returns counts and a spanning forest, never the pairs.

    Null group, null, empty or zero vectors, or null or non-finite components: linked with nothing, component is
    the own id. Repeated rows are copies of each other, as are rows of one id. A null id stays null and is never a
    component's name unless all its ids are null. An empty table gives an empty result; other columns are ignored.
    """
    rows = vectors.select(
        F.col(id_col).cast("long").alias("vec_id"),
        F.col(group_col).cast("string").alias("label"),
        F.transform(F.col(vector_col), lambda x: x.cast("double") + F.lit(0.0)).alias("vector"),
    )
    usable = (
        F.col("label").isNotNull()
        & F.coalesce(F.size("vector") > 0, F.lit(False))
        & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("vector", lambda x: x != 0)
    )
    same = ["hash_1", "hash_2"]  # equal groups and vectors; no two different ones among 10^15 are expected to agree in both
    rows = rows.withColumns({h: F.when(usable, F.xxhash64(F.lit(n), "label", "vector")) for n, h in enumerate(same)})
    nodes = (
        rows.filter("hash_1 is not null")
        .groupBy(*same)
        .agg(
            F.first("label").alias("label"), F.first("vector").alias("vector"),
            F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("least"),
        )
        .withColumn("node", F.monotonically_increasing_id())
    )
    schema = ", ".join(f"{c} {t}" for c, t in nodes.dtypes) + ", keys array<long>"
    nodes = stored(nodes.mapInArrow(lambda batches: with_keys(batches, tables, projections, width, seed), schema))
    cells = nodes.select("node", "label", F.size("vector").alias("size"), F.posexplode("keys").alias("t", "key")).select(
        "node", "t", F.xxhash64("label", "size", "t", "key").alias("bucket")
    )
    crowded = cells.groupBy("bucket").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    met = chunk_pairs(cells.join(crowded, "bucket"), "bucket", "node", F.ceil(F.col("members") / CHUNK))
    met = met.select("bucket", "part_i", "part_j", "part", "t", "node").join(nodes.drop(*same, "least"), "node")
    found = stored(
        in_order(met, ["bucket", "part_i", "part_j"]).mapInArrow(
            lambda batches: compare(batches, threshold, tables), "a long, b long, n long"
        )
    )
    roots = components(found.filter("b is not null"))
    linked = found.filter("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("others"))
    named = nodes.select("node", *same, "least", "copies").join(linked, "node", "left").join(roots, "node", "left")
    named = named.withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    told = named.join(least, "root").select(
        *same, (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id"
    )
    return (
        rows.select("vec_id", *same)
        .join(told, same, "left")
        .select(
            "vec_id",
            F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
            F.when(F.col("hash_1").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"),
        )
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
    )
