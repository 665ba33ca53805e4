"""Greedy token-vector matching (Zhang et al. 2020) and the encoder surface.

The encoder is the caller's: ``factory()`` is called once per task and returns ``encode(list[str])`` giving one
(tokens × dim) array per text. There are two ways to match. Vectors are made where they are used and never shuffled (a
512-token answer is about 1.5 MB as vectors and 3 kB as text), at the price of encoding a text in every task that meets
it; or a committed store holds the vectors of every distinct text by its fingerprint, and distinct pairs meet them in
joins. The store pays where the encoder is dear and several operators need the same texts, as in a whole evaluation.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from evenkeel.functions.hashing import fingerprint
from evenkeel.sources.stages import committed

Encoder = Callable[[Sequence[str]], Sequence[np.ndarray]]
MATCH_SCHEMA = "precision double, recall double, f1 double"


def _unit(vectors) -> np.ndarray:
    if not len(vectors):
        return np.zeros((0, 1))
    if isinstance(vectors, np.ndarray) and vectors.ndim == 2 and vectors.dtype != object:
        matrix = vectors.astype("float64", copy=False)
    else:
        matrix = np.stack([np.asarray(v, dtype="float64") for v in vectors])
    norm = np.linalg.norm(matrix, axis=1, keepdims=True)
    return matrix / np.where(norm == 0, 1.0, norm)


def _units(encoded: Sequence) -> list[np.ndarray]:
    """:func:`_unit` of every text; arrays of one width are scaled together and cut apart again."""
    encoded = list(encoded)
    alike = all(isinstance(v, np.ndarray) and v.ndim == 2 and v.dtype == np.float64 and v.shape[1] == encoded[0].shape[1] for v in encoded)
    if len(encoded) < 2 or not alike:
        return [_unit(v) for v in encoded]
    matrix = _unit(np.concatenate(encoded))
    ends = np.cumsum([0, *map(len, encoded)]).tolist()
    return [matrix[a:b].copy() for a, b in zip(ends, ends[1:])]  # a copy: one kept text must not hold the others


def _match(cand: np.ndarray, ref: np.ndarray) -> tuple[float, float, float]:
    if len(cand) == 0 or len(ref) == 0:
        return 0.0, 0.0, 0.0
    cosine = cand @ ref.T
    precision = float(np.add.reduce(np.maximum.reduce(cosine, 1))) / len(cand)
    recall = float(np.add.reduce(np.maximum.reduce(cosine, 0))) / len(ref)
    total = precision + recall
    return precision, recall, (2 * precision * recall / total if total else 0.0)


def _matrices(column: pa.Array) -> Iterator[np.ndarray | None]:
    """The (tokens × dim) array of every row, as a view of the batch: vectors as objects take 30 times their bytes."""
    inner = column.values
    rows, tokens = column.offsets.to_numpy(), inner.offsets.to_numpy()
    flat = inner.values.to_numpy(zero_copy_only=False)
    for i, valid in enumerate(column.is_valid().to_pylist()):
        ends = tokens[rows[i] : rows[i + 1] + 1]
        widths = np.diff(ends)
        if not valid:
            yield None
        elif not len(widths):
            yield np.zeros((0, 1))
        elif (widths != widths[0]).any():
            raise ValueError("the vectors of a text differ in length")
        else:
            yield flat[ends[0] : ends[-1]].reshape(len(widths), widths[0])


class _Memo:
    """Unit vectors of recently seen texts of one task; bounded, so a gold answer is encoded once per run."""

    def __init__(self, factory: Callable[[], Encoder], batch_size: int, capacity: int):
        self.factory, self.encode = factory, None
        self.batch_size, self.capacity = batch_size, capacity
        self.seen: OrderedDict[str, np.ndarray] = OrderedDict()

    def load(self, texts: Sequence[str]) -> dict[str, np.ndarray]:
        known = {t: self.seen[t] for t in texts if t in self.seen}
        new = [t for t in dict.fromkeys(texts) if t not in known]
        for start in range(0, len(new), self.batch_size):
            if self.encode is None:
                self.encode = self.factory()
            part = new[start : start + self.batch_size]
            known.update(zip(part, _units(self.encode(part))))
        self.seen.update(known)
        while len(self.seen) > self.capacity:
            self.seen.popitem(last=False)
        return known


def match_vectors(cand: Column, ref: Column) -> Column:
    """Precision, recall, F1 of two token-vector arrays; null when either is null."""

    def batch(a: pa.Array, b: pa.Array) -> pa.Array:
        rows = [(None, None, None) if x is None or y is None else _match(_unit(x), _unit(y)) for x, y in zip(_matrices(a), _matrices(b))]
        parts = [pa.array([r[i] for r in rows], pa.float64()) for i in range(3)]
        return pa.StructArray.from_arrays(parts, names=["precision", "recall", "f1"])

    return F.arrow_udf(batch, MATCH_SCHEMA)(cand, ref)


def match_texts(
    cand: Column, ref: Column, factory: Callable[[], Encoder], batch_size: int = 8, memo: int = 256
) -> Column:
    """As :func:`match_vectors` on raw texts, encoding ``batch_size`` new texts at a time; a pair that comes again in a batch is matched once."""

    def stream(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        vectors = _Memo(factory, batch_size, memo)
        for a, b in batches:
            pairs = list(zip(a, b))
            found = {pair: (None, None, None) for pair in dict.fromkeys(pairs)}
            todo = [pair for pair in found if None not in pair]
            for start in range(0, len(todo), batch_size):
                part = todo[start : start + batch_size]
                known = vectors.load([t for pair in part for t in pair])
                for x, y in part:
                    found[x, y] = _match(known[x], known[y])
            yield pd.DataFrame([found[pair] for pair in pairs], columns=["precision", "recall", "f1"], dtype="float64")

    stream.__annotations__ = {
        "batches": Iterator[tuple[pd.Series, pd.Series]],
        "return": Iterator[pd.DataFrame],
    }
    return F.pandas_udf(stream, MATCH_SCHEMA)(cand, ref)


def match_run_pairs(
    texts: Column, pairs: Column, factory: Callable[[], Encoder], batch_size: int = 8
) -> Column:
    """F1 of each (i, j) of ``pairs`` over the text array of one row; each distinct text is encoded once, each distinct pair of texts matched once.

    ``texts`` is bounded by the caller (at most twice the pair budget), so a row's vectors fit a task.
    """

    def stream(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        encode = None
        for all_texts, all_pairs in batches:
            sizes = pc.fill_null(pc.list_value_length(all_pairs), 0).to_numpy(zero_copy_only=False)
            ends = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64))).tolist()
            flat = all_pairs.flatten()
            left, right = (flat.field(side).to_pylist() for side in ("i", "j"))
            out = []
            for group, first, end in zip(all_texts.to_pylist(), ends, ends[1:]):
                if first == end:
                    continue
                if encode is None:
                    encode = factory()
                distinct = list(dict.fromkeys(t for t in group if t is not None))
                known: dict[str, np.ndarray] = {}
                for start in range(0, len(distinct), batch_size):
                    part = distinct[start : start + batch_size]
                    known.update(zip(part, _units(encode(part))))
                named = [(group[i], group[j]) for i, j in zip(left[first:end], right[first:end])]
                found = {pair: None if None in pair else _match(known[pair[0]], known[pair[1]])[2] for pair in set(named)}
                out += [found[pair] for pair in named]
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(out, pa.float64()))

    stream.__annotations__ = {
        "batches": Iterator[tuple[pa.Array, pa.Array]],
        "return": Iterator[pa.Array],
    }
    return F.arrow_udf(stream, "array<double>")(texts, pairs)


def encode(df: DataFrame, text_col: str, factory: Callable[[], Encoder], batch_size: int = 8) -> DataFrame:
    """Distinct non-null texts of a column with their token vectors: ``(text, vectors)``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = None
        for pdf in batches:
            for start in range(0, len(pdf), batch_size):
                if encoder is None:
                    encoder = factory()
                part = pdf["text"].iloc[start : start + batch_size].tolist()
                vectors = [[[float(x) for x in row] for row in m] for m in encoder(part)]
                yield pd.DataFrame({"text": part, "vectors": vectors})

    texts = df.select(F.col(text_col).alias("text")).filter(F.col("text").isNotNull()).distinct()
    return texts.mapInPandas(run, "text string, vectors array<array<float>>")


def store_vectors(texts: DataFrame, factory: Callable[[], Encoder], path: str, batch_size: int = 8) -> DataFrame:
    """``print, vectors`` of every distinct non-null ``texts(text)``, committed in ``path``; each text is encoded once.

    A committed store is added to: only texts it lacks are encoded, into a part of its own.
    """
    spark, part = texts.sparkSession, 0
    while committed(spark, f"{path}/part-{part}"):
        part += 1
    wanted = texts.select("text").withColumn("print", fingerprint(F.col("text")))
    paths = [f"{path}/part-{i}" for i in range(part)]
    if paths:
        wanted = wanted.join(spark.read.parquet(*paths).select("print"), "print", "left_anti")
    made = encode(wanted, "text", factory, batch_size).select(fingerprint(F.col("text")).alias("print"), "vectors")
    made.write.mode("overwrite").parquet(f"{path}/part-{part}")
    return spark.read.parquet(*paths, f"{path}/part-{part}")


def match_stored(pairs: DataFrame, store: DataFrame) -> DataFrame:
    """``cand, ref, precision, recall, f1`` of the distinct ``pairs(cand, ref)`` of text fingerprints.

    Repeated pairs are matched once, combined before the shuffle; a pair with a missing side has no row.
    """
    distinct = pairs.select("cand", "ref").dropna().distinct()
    sides = [store.select(F.col("print").alias(side), F.col("vectors").alias(f"{side}_vectors")) for side in ("cand", "ref")]
    joined = distinct.join(sides[0], "cand").join(sides[1], "ref")
    matched = joined.select("cand", "ref", match_vectors(F.col("cand_vectors"), F.col("ref_vectors")).alias("m"))
    return matched.select("cand", "ref", "m.*")
