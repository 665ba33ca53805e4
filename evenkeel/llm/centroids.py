"""Centroid clustering in exact integers, with most centroids ruled out in a rotated space.

The vectors' covariance is summed over all rows; its leading eigenvectors are a rotation. Every vector is stored once
with its integer components, its coordinates along those axes and the norm of what is left. For a vector and a
centroid, the squared distance of the coordinates plus the squared difference of the two norms is at most their squared
distance. So the centroid of the lowest bound is measured in integers, and after it only those whose bound does not
exceed that distance. The rotation is floating point and only filters: each bound is lowered by more than its rounding
error, and the result depends on integers alone.

A round is one scan: tasks add up their vectors per centroid, and Spark sums those sums. The driver holds the centroids
(their number times the dimensions), the covariance (dimensions squared) and nothing that grows with the rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from evenkeel.llm.common import stored

DIMENSIONS = 64
CENTROIDS = 40
ROUNDS = 5
SCALE = 256
LEADING = 12  # rotated coordinates kept of each vector
BLOCK = 4096  # vectors compared at once
NARROW = 1 << 27  # up to here, sums of squared differences over 64 components stay within 64 bits
WIDEST = 1 << 62  # integers beyond are refused: neither they nor their distances are longs


@dataclass(frozen=True)
class Axes:
    """Mean and leading orthonormal directions of the vectors."""

    mean: np.ndarray
    basis: np.ndarray

    def apart(self, ints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Coordinates along the axes, and the norm of the rest."""
        centred = ints.astype(np.float64) - self.mean
        lead = centred @ self.basis
        rest = np.einsum("ij,ij->i", centred, centred) - np.einsum("ij,ij->i", lead, lead)
        return lead, np.sqrt(np.maximum(rest, 0.0))


def integers(vector: Column, scale: int) -> Column:
    """floor(scale * x) of every component, as longs; raises for a component that no long can hold."""
    def whole(x: Column) -> Column:
        wide = x.cast("double") * F.lit(float(scale))
        told = F.raise_error(F.concat(F.lit("a component is too large for integers: "), x.cast("string")))
        return F.when(F.abs(wide) < float(WIDEST), F.floor(wide)).otherwise(told.cast("long"))

    return F.transform(vector, whole)


def usable(vector: Column, dimensions: int) -> Column:
    """Whether a vector has ``dimensions`` components, none null or non-finite."""
    def bad(x: Column) -> Column:
        return x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))

    return F.coalesce((F.size(vector) == dimensions) & ~F.exists(vector, bad), F.lit(False))


def matrix(batch: pa.RecordBatch, name: str, width: int) -> np.ndarray:
    column = batch.column(name)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), width)


def cells(groups: np.ndarray, counts: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.RecordBatch:
    """(group, at, n, value) of every cell of a small table of sums."""
    width = values.shape[1]
    flat = values.reshape(-1).tolist()
    return pa.RecordBatch.from_pydict(
        {
            "group": pa.array(np.repeat(groups, width), pa.int32()),
            "at": pa.array(np.tile(np.arange(width), len(groups)), pa.int32()),
            "n": pa.array(np.repeat(counts, width), pa.int64()),
            "value": pa.array([str(x) for x in flat] if kind == pa.string() else flat, kind),
        }
    )


def summed(parts: DataFrame) -> list:
    """Cells added up over tasks: as many rows as one task makes."""
    return parts.groupBy("group", "at").agg(F.sum("n").alias("n"), F.sum("value").alias("value")).collect()


def axes_of(vectors: DataFrame, width: int, leading: int) -> Axes:
    """Rotation from the covariance of all ``vectors(ints)``: one scan, a row a task for each of its cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, square, n = np.zeros(width), np.zeros((width, width)), 0
        for batch in batches:
            ints = matrix(batch, "ints", width).astype(np.float64)
            total += ints.sum(0)
            square += ints.T @ ints
            n += len(ints)
        if n:
            yield cells(np.arange(width + 1), np.full(width + 1, n), np.vstack([square, total]), pa.float64())

    rows = summed(vectors.select("ints").mapInArrow(run, "group int, at int, n long, value double"))
    if not rows:
        return Axes(np.zeros(width), np.zeros((width, 0)))
    values = np.zeros((width + 1, width))
    for r in rows:
        values[r["group"], r["at"]] = r["value"]
    mean = values[-1] / rows[0]["n"]
    spread = values[:-1] / rows[0]["n"] - np.outer(mean, mean)
    _, directions = np.linalg.eigh(spread)
    basis, _ = np.linalg.qr(directions[:, ::-1][:, :leading])  # orthonormal to rounding, whatever the covariance was
    return Axes(mean, basis)


def squares(ints: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows; beyond 64 bits in Python's integers."""
    if max(np.abs(ints).max(initial=0), np.abs(others).max(initial=0)) > NARROW:
        apart = ints.astype(object) - others.astype(object)
        return (apart * apart).sum(1)
    apart = ints - others
    return np.einsum("ij,ij->i", apart, apart)


def nearest(
    ints: np.ndarray, lead: np.ndarray, rest: np.ndarray, centroids: np.ndarray, turned: tuple[np.ndarray, np.ndarray]
) -> tuple[np.ndarray, np.ndarray, int]:
    """(centroid, squared distance) of every row, ties to the smaller number; and how many distances were measured."""
    c_lead, c_rest = turned
    bound = (rest[:, None] - c_rest[None, :]) ** 2
    for j in range(lead.shape[1]):
        bound += (lead[:, j, None] - c_lead[None, :, j]) ** 2
    # a norm close to zero loses half the digits of its square, so a millionth of the squares involved is let go
    size = (np.einsum("ij,ij->i", lead, lead) + rest**2)[:, None] + (np.einsum("ij,ij->i", c_lead, c_lead) + c_rest**2)[None, :]
    widest = float(max(np.abs(ints).max(initial=0), np.abs(centroids).max(initial=0)))
    bound -= (size + widest * np.sqrt(size) + 1.0) * 2.0**-20
    first = bound.argmin(1)
    best = squares(ints, centroids[first])
    rows, columns = np.nonzero(bound <= best.astype(np.float64)[:, None] * (1 + 2.0**-40))
    columns, rows = columns[columns != first[rows]], rows[columns != first[rows]]
    found = squares(ints[rows], centroids[columns])
    chosen, distance = first.copy(), best.copy()
    order = np.lexsort((columns, found, rows)) if len(rows) else rows
    rows, columns, found = rows[order], columns[order], found[order]
    lead_row = np.ones(len(rows), bool)
    lead_row[1:] = rows[1:] != rows[:-1]
    r, c, d = rows[lead_row], columns[lead_row], found[lead_row]
    better = (d < distance[r]) | ((d == distance[r]) & (c < chosen[r]))
    chosen[r[better]], distance[r[better]] = c[better], d[better]
    return chosen, distance, len(ints) + len(rows)


def blocks(batches: Iterator[pa.RecordBatch], width: int, leading: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        for start in range(0, batch.num_rows, BLOCK):
            some = batch.slice(start, BLOCK)
            rest = some.column("rest").to_numpy(zero_copy_only=False)
            yield some, matrix(some, "ints", width), matrix(some, "lead", leading), rest


def turned_vectors(vectors: DataFrame, axes: Axes) -> DataFrame:
    """``vectors(vec_id, ints)`` with ``lead`` and ``rest``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                some = batch.slice(start, BLOCK)
                lead, rest = axes.apart(matrix(some, "ints", len(axes.mean)))
                ends = np.arange(len(rest) + 1, dtype=np.int32) * lead.shape[1]
                listed = pa.ListArray.from_arrays(ends, lead.reshape(-1))
                yield pa.RecordBatch.from_pydict(
                    {"vec_id": some.column("vec_id"), "ints": some.column("ints"), "lead": listed, "rest": rest}
                )

    return vectors.mapInArrow(run, "vec_id long, ints array<long>, lead array<double>, rest double")


def next_centroids(vectors: DataFrame, centroids: np.ndarray, axes: Axes) -> np.ndarray:
    """Floor of the exact mean of every centroid's vectors; a centroid without vectors stays."""
    k, width, leading = len(centroids), len(axes.mean), axes.basis.shape[1]
    turned = axes.apart(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((k, width), object), np.zeros(k, np.int64)
        for _, ints, lead, rest in blocks(batches, width, leading):
            chosen, _, _ = nearest(ints, lead, rest, centroids, turned)
            order = np.argsort(chosen, kind="stable")
            some, starts = np.unique(chosen[order], return_index=True)
            wide = np.abs(ints).max(initial=0) > NARROW
            total[some] += np.add.reduceat((ints.astype(object) if wide else ints)[order], starts)
            count += np.bincount(chosen, minlength=k)
        some = np.flatnonzero(count)
        if len(some):
            yield cells(some, count[some], total[some], pa.string())

    parts = vectors.mapInArrow(run, "group int, at int, n long, value string")
    out = centroids.copy()
    for r in summed(parts.withColumn("value", F.col("value").cast("decimal(38,0)"))):
        out[r["group"], r["at"]] = int(r["value"]) // r["n"]
    return out


def assigned(vectors: DataFrame, centroids: np.ndarray, axes: Axes) -> DataFrame:
    """``vec_id, cluster, distance`` of every vector."""
    width, leading, turned = len(axes.mean), axes.basis.shape[1], axes.apart(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some, ints, lead, rest in blocks(batches, width, leading):
            chosen, distance, _ = nearest(ints, lead, rest, centroids, turned)
            yield pa.RecordBatch.from_pydict(
                {"vec_id": some.column("vec_id"), "cluster": pa.array(chosen, pa.int32()), "distance": pa.array(distance.tolist(), pa.int64())}
            )

    return vectors.mapInArrow(run, "vec_id long, cluster int, distance long")


def cluster(
    embeddings: DataFrame,
    centroids: int = CENTROIDS,
    rounds: int = ROUNDS,
    dimensions: int = DIMENSIONS,
    scale: int = SCALE,
    leading: int = LEADING,
    seed: int = 2,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """One row per kept vector: ``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256``.

    Kept are vectors of exactly ``dimensions`` components, none null or non-finite; the rest (null vectors too) have no
    row. The first centroids are the kept vectors with the smallest sha256 of ``<seed>:<vec_id>``, in that order; rows
    of one id are ordered by their components, and a null id reads as empty. With fewer vectors than ``centroids``
    there are as many as vectors. Repeated rows count each. An empty table gives an empty result; other columns are
    ignored. A component or a squared distance that is no 64-bit integer is an error.
    """
    column = F.col(vector_col)
    rows = embeddings.filter(usable(column, dimensions)).select(F.col(id_col).cast("long").alias("vec_id"), integers(column, scale).alias("ints"))
    axes = axes_of(rows, dimensions, min(leading, dimensions))
    vectors = stored(turned_vectors(rows, axes))
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = vectors.select(drawn.alias("draw"), "ints").orderBy("draw", "ints").limit(centroids).collect()
    at = np.array([r["ints"] for r in first], np.int64).reshape(-1, dimensions)
    for _ in range(rounds if len(at) else 0):
        at = next_centroids(vectors, at, axes)
    found = stored(assigned(vectors, at, axes) if len(at) else vectors.selectExpr("vec_id", "0 as cluster", "0L as distance"))
    by_cluster = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()
    inertia = sum(int(r["d"]) for r in by_cluster)
    told = [
        (r["cluster"], int(r["d"]), inertia, hashlib.sha256(",".join(map(str, at[r["cluster"]].tolist())).encode()).hexdigest())
        for r in by_cluster
    ]
    # a row per centroid: the bound of what is broadcast
    known = embeddings.sparkSession.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
