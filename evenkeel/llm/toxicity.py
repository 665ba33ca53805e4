"""Toxic passages: maximum-scoring segments over token log-odds, calibrated by extreme values.

Training: words are counted once a document in toxic and other labelled texts, and in all texts; log-odds with an
informative Dirichlet prior (the counts of all texts) give each word and each word beginning a z-score, and those above a threshold
score by their log-odds. All other words cost a little. Scoring: a linear scan finds every maximal segment of
positive total; lambda and K of the extreme-value law turn a segment's total into an expected count by chance in a
text of that length. The bits of all segments that chance does not explain are added up; a logistic curve over
that sum, fitted on the labelled rows, is the score.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from evenkeel.functions.hashing import seeded_hash
from evenkeel.llm.common import SLICE, WORD, arrow_map, stored, texts
from evenkeel.operators.groups import first_k_by_hash

MAX_LABELLED = 50_000  # labelled rows that the model is fitted on, drawn by hash if there are more
MAX_FEATURES = 50_000  # scoring words and beginnings kept, by z-score
BEGINNINGS = range(3, 9)
Z_LEAST, DRIFT, CAP = 4.0, 0.5, 6.0
SIGNIFICANT = 0.01  # expected count by chance, below which a passage is reported
NO_PASSAGE = -6.0
HELD_WEIGHTS = 100_000  # words whose weights a task remembers
HELD_WORDS = 200_000  # words that a task counts before it hands them on
SEED = 5


@dataclass(frozen=True)
class Model:
    weights: dict[str, float]  # "=word" or "beginning+" of longer words
    lam: float
    k: float
    slope: float
    intercept: float
    floor: float = 0.0  # share of toxic ones among labelled texts without any scoring word

    def word(self, word: str) -> float:
        best = self.weights.get(f"={word}", 0.0)
        for n in BEGINNINGS:
            if n >= len(word):
                break
            best = max(best, self.weights.get(f"{word[:n]}+", 0.0))
        return best

    def bits(self, total: float, words: int) -> float:
        """log of 1 / (expected count of such totals by chance among ``words`` words)."""
        return max(NO_PASSAGE + 0.1, self.lam * total - math.log(self.k * max(1, words)))

    def evidence(self, totals: list[float], words: int) -> float:
        """Sum of the bits of segments beyond chance, else the bits of the best one."""
        bits = [self.bits(s, words) for s in totals]
        return sum(b for b in bits if b > 0) or max(bits, default=NO_PASSAGE)

    def score(self, bits: float) -> float:
        if bits <= NO_PASSAGE:
            return self.floor
        z = self.slope * min(60.0, bits) + self.intercept
        return max(self.floor, 1 / (1 + math.exp(-z)) if z > -700 else 0.0)


def segments(hits: list[tuple[int, float]], drift: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first word, last word, total) in one pass.

    ``hits``: places and weights of scoring words in order; every other word costs ``drift``. The candidates are
    kept with the running totals before and after them; a new one is merged with the last earlier candidate that
    starts lower, if its own end is higher. Each candidate is pushed and popped once.
    """
    found: list[list[float]] = []  # first, last, total before, total after
    below: list[int] = []  # per candidate, the nearest earlier one that starts lower
    running, at = 0.0, 0
    for place, weight in hits:
        before = running - drift * (place - at)
        running, at = before + weight, place + 1
        new = [place, place, before, running]
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= new[2]:
                j = below[j]
            if j < 0 or found[j][3] >= new[3]:
                found.append(new)
                below.append(j)
                break
            new = [found[j][0], new[1], found[j][2], new[3]]
            del found[j:], below[j:]
    return [(int(a), int(b), after - before) for a, b, before, after in found]


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, toxic documents with it, other documents with it) of some rows."""
    for batch in batches:
        for start in range(0, batch.num_rows, SLICE):
            some = batch.slice(start, SLICE)
            counts = Counter(), Counter()
            for text, toxic in zip(texts(some, "text"), some.column("toxic").to_pylist(), strict=True):
                counts[toxic].update(set(WORD.findall(text.lower())))
            words = list(counts[0].keys() | counts[1].keys())
            columns = [words, [counts[1][w] for w in words], [counts[0][w] for w in words]]
            types = pa.string(), pa.int64(), pa.int64()
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["word", "toxic", "other"]
            )


def count_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, documents with it) of the rows of a task, in pieces of a bounded number of words."""
    counts: Counter[str] = Counter()

    def told() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    for batch in batches:
        for start in range(0, batch.num_rows, SLICE):
            for text in texts(batch.slice(start, SLICE), "text"):
                counts.update(set(WORD.findall(text.lower())))
                if len(counts) > HELD_WORDS:
                    yield told()
                    counts.clear()
    if counts:
        yield told()


def document_counts(docs: DataFrame) -> DataFrame:
    """(word, n): in how many of all ``docs``, labelled or not, each word stands; combined map-side."""
    counted = docs.select("text").mapInArrow(count_documents, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def with_features(counted: DataFrame, *columns: str) -> DataFrame:
    """A row for each word as a whole and for each of its beginnings."""
    ways = [F.concat(F.lit("="), F.col("word"))]
    ways += [F.when(F.length("word") > n, F.concat(F.substring("word", 1, n), F.lit("+"))) for n in BEGINNINGS]
    return counted.select(*columns, F.explode(F.array(*ways)).alias("feature")).filter("feature is not null")


def weights_of(counted: DataFrame, background: DataFrame) -> dict[str, float]:
    """Log-odds of words and beginnings with a Dirichlet prior as strong as the toxic sample, where z is high.

    ``background(word, n)`` has the document counts of the whole corpus, which share the prior out among the words.
    """
    totals = counted.agg(F.sum("toxic"), F.sum("other")).first()
    if not totals[0] or not totals[1]:
        return {}
    n_t, n_o = map(float, totals)
    n_all = float(background.agg(F.sum("n")).first()[0])
    both = with_features(counted, "toxic", "other").groupBy("feature")
    both = both.agg(F.sum("toxic").alias("t"), F.sum("other").alias("o")).filter("t > 2")
    spread_out = with_features(background, "n").groupBy("feature").agg(F.sum("n").alias("n"))
    both = both.join(spread_out, "feature")
    prior = n_t  # as many prior words as the toxic sample has
    alpha = F.col("n") * (prior / n_all)

    def odds(count, total: float):
        return F.log(count + alpha) - F.log(F.lit(total + prior) - count - alpha)

    delta = odds(F.col("t"), n_t) - odds(F.col("o"), n_o)
    spread = F.sqrt(1 / (F.col("t") + alpha) + 1 / (F.col("o") + alpha))
    kept = both.select("feature", delta.alias("delta"), (delta / spread).alias("z"))
    kept = kept.filter((F.col("z") >= Z_LEAST) & (F.col("delta") > 1)).orderBy(F.desc("z"), "feature").limit(MAX_FEATURES)
    return {r["feature"]: min(CAP, r["delta"]) for r in kept.collect()}


def solve_lambda(histogram: list[tuple[float, float]]) -> float:
    """The positive root of sum p * exp(lambda * score) = 1, by bisection; scores of the texts that are not toxic."""
    total = sum(n for _, n in histogram)
    gained = any(s > 0 for s, _ in histogram)
    if not total or not gained or sum(s * n for s, n in histogram) >= 0:
        return 1.0
    low, high = 0.0, 1.0
    over = lambda x: sum(n / total * math.exp(x * s) for s, n in histogram) > 1
    while not over(high) and high < 64:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (low, mid) if over(mid) else (mid, high)
    return high


def logistic(bins: list[tuple[float, int, float]], fixed: float = 0.5) -> tuple[float, float]:
    """(slope, intercept) of labels over bits, by Newton steps that are halved until the likelihood grows.

    ``bins``: (bits, label, count). A weak pull to slope ``fixed`` keeps separable samples finite.
    """
    x, y, n = (np.array(c, float) for c in zip(*bins, strict=True))
    rate = min(1 - 1e-6, max(1e-6, float((y * n).sum() / n.sum())))
    if rate in (1e-6, 1 - 1e-6):
        return 0.0, math.log(rate / (1 - rate))

    def gain(b: np.ndarray) -> float:
        z = b[0] * x + b[1]
        return float((n * (y * z - np.logaddexp(0, z))).sum()) - (b[0] - fixed) ** 2 / 2

    b = np.array([0.0, math.log(rate / (1 - rate))])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(b[0] * x + b[1], -500, 500)))
        g = np.array([((y - p) * n * x).sum() - (b[0] - fixed), ((y - p) * n).sum()])
        w = n * p * (1 - p)
        h = np.array([[(w * x * x).sum() + 1, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-9]])
        step, before = np.linalg.solve(h, g), gain(b)
        while gain(b + step) < before and np.abs(step).max() > 1e-9:
            step = step / 2
        b = b + step
        if np.abs(step).max() < 1e-7:
            break
    return max(0.0, float(b[0])), float(b[1])


def passages(text: str, model: Model, cache: dict[str, float]) -> tuple[int, list[tuple[int, int, float]]]:
    """Number of words, and the maximal segments (first word, last word, total)."""
    words = WORD.findall(text.lower())
    hits = []
    for i, word in enumerate(words):
        weight = cache.get(word)
        if weight is None:
            weight = model.word(word)
            if len(cache) > HELD_WEIGHTS:
                cache.clear()
            cache[word] = weight
        if weight:
            hits.append((i, weight))
    return len(words), segments(hits, DRIFT) if hits else []


def labelled_rows(docs: DataFrame, labels: DataFrame, max_labelled: int) -> DataFrame:
    """(text, toxic) of at most ``max_labelled`` labelled documents that are not held out, equal texts once."""
    known = labels.filter("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.filter(~held_out(F.col("doc_id")))
    drawn = first_k_by_hash(known, [], max_labelled, seeded_hash(SEED, F.col("doc_id")), ["doc_id"])
    drawn = stored(drawn)  # a proven bound: at most max_labelled rows of two numbers
    picked = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").select("text", "toxic")
    return picked.withColumn("text", F.coalesce("text", F.lit(""))).dropDuplicates(["text", "toxic"])


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Model:
    """A model from ``docs(doc_id, text)`` and ``labels(doc_id, toxic)``; labels with crc32(doc_id) mod 3 = 1 are not used.

    The texts of all ``docs`` enter the prior, by their words' document counts; those take one more scan.

    What comes to the driver is bounded: at most ``MAX_FEATURES`` weights, a score histogram, counts of bits.
    Without labels of both kinds no word scores and the score is the share of toxic labels (0 without labels).
    """
    rows = stored(labelled_rows(docs, labels, max_labelled))
    counted = rows.mapInArrow(count_words, "word string, toxic long, other long")
    counted = stored(counted.groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other")))
    weights = weights_of(counted, stored(document_counts(docs)))
    draft = Model(weights, 1.0, 0.1, 0.5, 0.0)
    scored = arrow_map(
        counted.filter("other > 0"),
        lambda b: {"gain": [round(draft.word(w), 2) for w in b.column("word").to_pylist()], "n": b.column("other")},
        "gain double, n long",
    )
    histogram = scored.groupBy("gain").agg(F.sum("n").alias("n")).collect()
    lam = solve_lambda([(r["gain"] if r["gain"] > 0 else -DRIFT, r["n"]) for r in histogram])

    def best(batch: pa.RecordBatch) -> dict:
        cache: dict[str, float] = {}
        found = [passages(t, draft, cache) for t in texts(batch, "text")]
        totals = [[s[2] for s in x] for _, x in found]
        return {"toxic": batch.column("toxic"), "words": [n for n, _ in found], "totals": totals}

    tops = stored(arrow_map(rows, best, "toxic int, words long, totals array<double>"))
    tops = tops.withColumn("total", F.coalesce(F.array_max("totals"), F.lit(0.0)))
    mean = tops.filter("toxic = 0").agg(F.avg(F.col("words") * F.exp(-lam * F.col("total")))).first()[0]
    k = min(10.0, max(1e-6, 1 / mean)) if mean else 0.1  # u = K n exp(-lambda S) is exponential with mean 1
    each = F.transform("totals", lambda s: F.greatest(lam * s - F.log(k * F.greatest("words", F.lit(1))), F.lit(NO_PASSAGE + 0.1)))
    beyond = F.aggregate(each, F.lit(0.0), lambda a, b: a + F.greatest(b, F.lit(0.0)))
    bits = F.when(beyond > 0, beyond).otherwise(F.coalesce(F.array_max(each), F.lit(NO_PASSAGE)))
    bits = F.round(F.least(bits, F.lit(60.0)), 1).alias("bits")
    counted = tops.groupBy("toxic", bits).agg(F.count(F.lit(1)).alias("n")).collect()
    bins = [(r["bits"], r["toxic"], r["n"]) for r in counted]
    without = [(y, n) for b, y, n in bins if b <= NO_PASSAGE]
    bins = [x for x in bins if x[0] > NO_PASSAGE]
    floor = sum(y * n for y, n in without) / max(1, sum(n for _, n in without))
    slope, intercept = logistic(bins) if bins else (0.0, -50.0)
    return Model(weights, lam, k, slope, intercept, floor)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, held_out, score, predicted, passages``.

    ``passages``: array of (start, end, total, expected) in code points for every significant passage. Null text is
    empty; texts are scanned whole; repeated rows are scored alike; an empty table gives an empty result.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by MAX_FEATURES
    mark = uuid.uuid4().hex

    def run(batch: pa.RecordBatch) -> dict:
        model, scores, spans = sent.value, [], []
        if OWNER[0] != mark:
            OWNER[0] = mark
            CACHE.clear()
        cache = CACHE
        for text in texts(batch, "text"):
            words, found = passages(text, model, cache)
            bits = [(a, b, s, model.bits(s, words)) for a, b, s in found]
            scores.append(model.score(model.evidence([x[2] for x in found], words)))
            told = [x for x in bits if math.exp(-x[3]) <= SIGNIFICANT]
            if told:  # places of words in the text as it is; lower-casing can change lengths
                places = [m.span() for m in WORD.finditer(text)]
                if len(places) != words:
                    places = [m.span() for m in WORD.finditer(text.lower())]
                told = [(places[a][0], places[b][1], s, math.exp(-e)) for a, b, s, e in told]
            spans.append([dict(zip(("start", "end", "total", "expected"), x, strict=True)) for x in told])
        return {"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "score": scores,
                "predicted": [int(s >= 0.7) for s in scores], "passages": spans}

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    passage = "array<struct<start: long, end: long, total: double, expected: double>>"
    return arrow_map(rows, run, f"doc_id long, held_out boolean, score double, predicted int, passages {passage}")


OWNER, CACHE = [""], {}  # weights of words that a worker met, and the scoring that they belong to


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows predicted toxic; all columns are kept as they are."""
    model = fit(docs, labels)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, float] = {}
        model = sent.value
        for batch in batches:
            flags = []
            for text in texts(batch, "text"):
                words, found = passages(text, model, cache)
                flags.append(model.score(model.evidence([s[2] for s in found], words)) < 0.7)
            yield batch.filter(pa.array(flags, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
