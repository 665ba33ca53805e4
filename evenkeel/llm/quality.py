"""Quality by importance resampling: hashed n-gram models of target and raw text, rows drawn by Gumbel top-k."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from evenkeel.functions.hashing import seeded_hash
from evenkeel.llm.common import SLICE, arrow_map, stored, texts
from evenkeel.llm.toxicity import held_out
from evenkeel.operators.groups import exact_quantiles, first_k_by_hash

BUCKETS = 10_000  # hashed one- and two-token grams
MAX_TARGET = 50_000  # labelled rows that the target model is fitted on, drawn by hash if there are more
SMOOTH = 1.0
SEED = 9
TOKEN = re.compile(r"\w+|[^\w\s]+")


HASHES: dict[str, int] = {}  # of tokens; one cache per worker process
CACHED = 300_000


def token_hash(token: str) -> int:
    found = xxhash.xxh64_intdigest(token.encode("utf-8", "surrogatepass"))
    if len(HASHES) >= CACHED:
        HASHES.clear()
    if len(token) < 100:
        HASHES[token] = found
    return found


def grams(text: str, buckets: int) -> np.ndarray:
    """Buckets of a text's one- and two-token grams."""
    get = HASHES.get
    ids = np.array([get(t) or token_hash(t) for t in TOKEN.findall(text.lower())], np.uint64)
    pairs = (ids[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ (ids[1:] + np.uint64(0x517CC1B727220A95))
    both = np.concatenate((ids, pairs))
    return ((both ^ (both >> np.uint64(31))) % np.uint64(buckets)).astype(np.int64)


def count_grams(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """(bucket, count), one set of rows per task."""
    total = np.zeros(buckets, np.int64)
    for batch in batches:
        for start in range(0, batch.num_rows, SLICE):
            for text in texts(batch.slice(start, SLICE), "text"):
                total += np.bincount(grams(text, buckets), minlength=buckets)
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])


def log_model(rows: DataFrame, buckets: int) -> np.ndarray:
    """Smoothed log probabilities of the buckets; ``buckets`` numbers come to the driver at any size of input."""
    counted = rows.mapInArrow(lambda b: count_grams(b, buckets), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    total = np.full(buckets, SMOOTH)
    for r in counted.collect():
        total[r["bucket"]] += r["n"]
    return np.log(total / total.sum())


def target_rows(docs: DataFrame, labels: DataFrame, max_target: int) -> tuple[DataFrame, float]:
    """Texts of labelled good documents that are not held out, and the share of good ones among the labelled."""
    known = labels.filter("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    known = known.filter(~held_out(F.col("doc_id")))
    share = known.agg(F.avg("quality")).first()[0]
    drawn = first_k_by_hash(known.filter("quality = 1"), [], max_target, seeded_hash(SEED, F.col("doc_id")), ["doc_id"])
    drawn = stored(drawn.select("doc_id"))  # a proven bound: at most max_target ids
    return docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").select("text"), 1.0 if share is None else float(share)


def resample(
    docs: DataFrame,
    labels: DataFrame,
    share: float | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    buckets: int = BUCKETS,
    max_target: int = MAX_TARGET,
    seed: int = SEED,
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, log_weight, gumbel_key, kept``.

    ``log_weight`` is the log ratio of the target model (labelled good texts, crc32(doc_id) mod 3 not 1) to the raw
    model (all texts) over a text's hashed grams; ``gumbel_key`` adds Gumbel noise from a hash of id and text, so
    the ``k`` largest keys are a sample without replacement in proportion to the weights; ``kept`` marks them.
    ``k`` is ``share`` of the rows, by default the share of good ones among the labelled.

    Null or empty text: weight 0. Equal rows have equal keys and are kept or left together. Without labels all
    weights are 0 and all rows are kept. Empty tables give an empty result; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    target, good = target_rows(rows, labels, max_target)
    ratio = log_model(target, buckets) - log_model(rows, buckets)
    if target.isEmpty():
        ratio = np.zeros(buckets)
    sent = docs.sparkSession.sparkContext.broadcast(ratio)

    def weigh(batch: pa.RecordBatch) -> dict:
        weights = [float(sent.value[grams(t, buckets)].sum()) for t in texts(batch, "text")]
        return {"doc_id": batch.column("doc_id"), "mark": batch.column("mark"), "log_weight": weights}

    marked = rows.select("doc_id", F.xxhash64("text").alias("mark"), "text")
    weighed = arrow_map(marked, weigh, "doc_id long, mark long, log_weight double")
    uniform = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "mark"), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    weighed = stored(weighed.withColumn("gumbel_key", F.col("log_weight") - F.log(-F.log(uniform))))
    total = weighed.count()
    k = round(total * (good if share is None else share))
    if k >= total or not k:
        return weighed.select("doc_id", "log_weight", "gumbel_key", F.lit(k > 0).alias("kept"))
    # between the k-th and the next largest key
    cut = exact_quantiles(weighed, [], ["gumbel_key"], [(total - k - 0.5) / (total - 1)]).first()["value"]
    return weighed.select("doc_id", "log_weight", "gumbel_key", (F.col("gumbel_key") >= cut).alias("kept"))
