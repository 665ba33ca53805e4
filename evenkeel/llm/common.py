"""What several of these operators share: stored tables, checked broadcasts, chunk pairs, components, text hashes."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from evenkeel.sources.stages import scratch_dir

BROADCAST_ROWS = 1_000_000  # narrow key tables of at most so many rows may be broadcast; larger ones are shuffled
SLICE = 1024  # rows that a function of arrow_map gets at once
WORD = re.compile(r"\w+")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared scratch folder and read again: cuts lineage and survives lost executors."""
    path = scratch_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# Spark's defaults hold 10,000 rows or 64 MB of text in the JVM, in its Python worker, and again on the way back
BATCHES = (("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "1000"), ("spark.sql.execution.arrow.maxBytesPerBatch", None, "4m"))


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most 1,000 rows or 4 MB from here on, unless the session was given other sizes."""
    for key, usual, wanted in BATCHES:
        if spark.conf.get(key, usual) in (usual, "67108864", "64MB", "64m"):
            spark.conf.set(key, wanted)


def unused(df: DataFrame, name: str) -> str:
    """``name``, or the first ``name_2``, ``name_3``, … that ``df`` has no column of."""
    taken, n, free = {c.lower() for c in df.columns}, 1, name
    while free.lower() in taken:
        n += 1
        free = f"{name}_{n}"
    return free


def narrow(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A stored, narrow key table with a broadcast hint if it has at most ``limit`` rows, else as it is."""
    return F.broadcast(df) if df.count() <= limit else df


def in_order(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of one key tuple follow each other in one partition; many small keys share a task."""
    return df.repartition(*keys).sortWithinPartitions(*keys)


def chunk_pairs(df: DataFrame, key: str, member: str, chunks: Column) -> DataFrame:
    """Splits every ``key`` into ``chunks`` parts by a hash of ``member`` and pairs the parts.

    A row goes to the pairs ``(part_i <= part_j)`` that hold its own part, as column ``part`` says, so any two rows
    of a key meet in exactly one pair of parts and no task holds more than two parts.
    """
    return (
        df.withColumn("parts", chunks.cast("int"))
        .withColumn("part", F.pmod(F.xxhash64(member), F.col("parts")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .withColumns({"part_i": F.least("part", "other"), "part_j": F.greatest("part", "other")})
        .drop("other", "parts")
    )


def columns_of(batch: pa.Table) -> dict[str, np.ndarray | tuple[np.ndarray, np.ndarray]]:
    """Numpy views: plain columns as arrays, lists and binaries as (flat values, offsets)."""
    out = {}
    for name in batch.column_names:
        column = batch[name].combine_chunks()
        column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
        if pa.types.is_list(column.type):
            offsets = column.offsets.to_numpy()
            flat = column.values.to_numpy(zero_copy_only=False)
            out[name] = (flat, offsets)
        elif pa.types.is_binary(column.type):
            _, offsets, data = column.buffers()
            n = len(column)
            starts = np.frombuffer(offsets, np.int32)[column.offset : column.offset + n + 1]
            out[name] = (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8), starts)
        else:
            out[name] = column.to_numpy(zero_copy_only=False)
    return out


def groups(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[tuple[dict, int, int]]:
    """(columns, first, end) of every run of equal ``keys`` in rows that come in that order."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([*held, batch])
        cols = columns_of(rows)
        changes = np.zeros(rows.num_rows - 1, bool)
        for k in keys:
            changes |= cols[k][1:] != cols[k][:-1]
        first = 0
        for end in (np.flatnonzero(changes) + 1).tolist():
            yield cols, first, end
            first = end
        held = rows.slice(first).to_batches()
    if held:
        rows = pa.Table.from_batches(held)
        yield columns_of(rows), 0, rows.num_rows


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges(a, b)``; root is the smallest node it is connected with.

    Alternating large-star and small-star rounds until the edges stand as stars. Minima are combined map-side;
    the joins are plain equi-joins that adaptive execution splits where one node has very many edges.
    """
    edges = stored(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct()
    )
    seen = None
    while True:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        moved = small.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stored(moved.union(least).distinct())
        total = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if tuple(total) == seen:
            break
        seen = tuple(total)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        edges.select("v", "v").distinct()
    )


class Forest:
    """Connected sets of the rows 0..n-1 of one task, and the links that joined them."""

    def __init__(self, n: int) -> None:
        self.labels = np.arange(n)
        self.links: list[tuple[int, int]] = []

    def link(self, left: np.ndarray, right: np.ndarray, hits: np.ndarray) -> None:
        """``hits[i, j]`` says that row left[i] is linked with row right[j]; keeps what joins two sets."""
        for i in np.flatnonzero(hits.any(1)).tolist():
            row = int(left[i])
            linked = right[hits[i]]
            for other in linked[self.labels[linked] != self.labels[row]].tolist():
                a, b = self.labels[row], self.labels[other]
                if a != b:
                    self.labels[self.labels == max(a, b)] = min(a, b)
                    self.links.append((row, other))

    def together(self, rows: np.ndarray, others: np.ndarray) -> bool:
        first = self.labels[rows[0]]
        return bool((self.labels[rows] == first).all() and (self.labels[others] == first).all())


# Text hashes. The multipliers are odd and fixed, so a text has the same hash in every task and every run.
GOLDEN = 0x9E3779B97F4A7C15
RADIX = 0xD1342543DE82EF95
RADIX_INVERSE = pow(RADIX, -1, 1 << 64)
PIECE = 1 << 20  # bytes hashed at once; a longer word is hashed whole
_POWERS = np.zeros(0, np.uint64), np.zeros(0, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (shift, xor, multiply), elementwise."""
    x = x + np.uint64(GOLDEN)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POWERS
    if len(_POWERS[0]) < n:
        ups, downs = np.full(n, RADIX, np.uint64), np.full(n, RADIX_INVERSE, np.uint64)
        ups[0] = downs[0] = 1
        _POWERS = np.cumprod(ups, dtype=np.uint64), np.cumprod(downs, dtype=np.uint64)
    return _POWERS


def word_hashes(text: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words (runs of bytes other than U+0020 and U+0009-000D) of UTF-8, A-Z as a-z.

    A word's hash is a polynomial of its bytes, cut out of running sums over the text, so there is no loop over
    words. Long texts are taken in pieces that end between words.
    """
    out, at = [], 0
    while at < len(text):
        piece = text[at : at + PIECE]
        gap = (piece == 32) | ((piece >= 9) & (piece <= 13))
        if at + PIECE < len(text) and not gap[-1]:
            cut = np.flatnonzero(gap)
            if len(cut):
                piece, gap = piece[: cut[-1] + 1], gap[: cut[-1] + 1]
            else:  # one word longer than a piece
                rest = text[at + PIECE :]
                ends = np.flatnonzero((rest == 32) | ((rest >= 9) & (rest <= 13)))
                piece = text[at : at + PIECE + (int(ends[0]) if len(ends) else len(rest))]
                gap = np.zeros(len(piece), bool)
        at += len(piece)
        edge = np.diff(np.concatenate(([True], gap, [True])).astype(np.int8))
        starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        if not len(starts):
            continue
        ups, downs = _powers(len(piece) + 1)
        low = piece + np.where((piece >= 65) & (piece <= 90), np.uint8(32), np.uint8(0))
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((low + np.uint64(1)) * ups[: len(low)], dtype=np.uint64)))
        out.append(mix((sums[ends] - sums[starts]) * downs[starts] + (ends - starts).astype(np.uint64) * np.uint64(GOLDEN)))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def shingle_set(text: np.ndarray, size: int = 5) -> np.ndarray:
    """Sorted distinct hashes of ``size``-word shingles; of the whole sequence if it has fewer words."""
    words = word_hashes(text)
    if not len(words):
        return words
    wide = min(size, len(words))
    total = np.full(len(words) - wide + 1, np.uint64(wide))
    for j in range(wide):
        total = (total + words[j : len(words) - wide + 1 + j]) * np.uint64(RADIX)
        total ^= total >> np.uint64(29)
    return np.unique(mix(total))


def utf8(batch: pa.RecordBatch, name: str) -> Iterator[np.ndarray]:
    """The bytes of every text of a batch, empty for null."""
    column = batch.column(name)
    if not pa.types.is_string(column.type):
        column = column.cast(pa.string())
    _, offsets, data = column.buffers()
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    ends = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1]
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    for i in range(len(column)):
        yield data[ends[i] : ends[i + 1]] if valid[i] else data[:0]


def texts(batch: pa.RecordBatch, name: str) -> list[str]:
    """The texts of a batch, empty for null."""
    return ["" if t is None else t for t in batch.column(name).to_pylist()]


def arrow_map(df: DataFrame, function: Callable, schema: str) -> DataFrame:
    """``function(batch) -> dict of columns`` on every Arrow batch."""
    target = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                made = function(batch.slice(start, SLICE))
                yield pa.RecordBatch.from_arrays([pa.array(made[f.name], f.type) for f in target], schema=target)

    return df.mapInArrow(run, schema)
