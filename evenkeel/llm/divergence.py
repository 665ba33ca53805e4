"""Which sources of a language use its words differently: exact counts through minimal perfect hashes.

First pass: how many documents of each language hold each term, summed in tasks before the shuffle; terms in enough
documents are kept. Their shards get a minimal perfect hash each: a term's slot is where its bucket's displacement
sends it, and the shard stores its terms in slot order, so a foreign term is told by comparing it with what stands in
its slot. Second pass: every task counts its texts into dense slots per (language, source, shard). Those blocks, not
terms, are shuffled and added up. All shares are integers.

A shard holds about ``SHARD_TERMS`` terms. What is broadcast at once is bounded by ``BROADCAST_BYTES``: shards are dealt
to as many rounds as that takes, one scan each. Pairs of sources are compared shard by shard in blocks of sources.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from evenkeel.llm.common import GOLDEN, SLICE, chunk_pairs, groups, in_order, mix, stored, utf8

LEAST_DOCUMENTS = 30
BILLION, PRIOR = 1_000_000_000, 5
TOP_TERMS = 50
SHARD_TERMS = 2048
BROADCAST_BYTES = 64 << 20  # of stored terms, in one broadcast
SOURCE_BLOCK = 256  # sources of a language compared in one task with as many others
HELD_BYTES, HELD_TERMS = 32 << 20, 200_000  # text read and terms counted before a task hands them on
HELD_BLOCKS = 2048  # dense blocks (about 16 KB each) that a task holds
LARGEST = 1 << 52  # counted occurrences up to which shares are exact in 64 bits

# letters, lower-cased in ASCII only, and all bytes beyond ASCII stand; everything else separates
TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: np.ndarray) -> list[bytes]:
    return text.tobytes().translate(TERMS).split()


def count_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, term, n): in how many rows of a language each term stands."""
    counts: dict[str, Counter[bytes]] = defaultdict(Counter)
    held = 0

    def told() -> Iterator[pa.RecordBatch]:
        for lang, counted in counts.items():
            names, n = pa.array(counted.keys(), pa.binary()), pa.array(counted.values(), pa.int64())
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(n), pa.string()), "term": names.cast(pa.string()), "n": n})
        counts.clear()

    for batch in batches:
        for start in range(0, batch.num_rows, SLICE):
            some = batch.slice(start, SLICE)
            for lang, text in zip(some.column("lang").to_pylist(), utf8(some, "text"), strict=True):
                counts[lang].update(set(terms(text)))
                held += len(text)
                if held > HELD_BYTES or len(counts[lang]) > HELD_TERMS:
                    yield from told()
                    held = 0
    yield from told()


def kept_terms(docs: DataFrame, least: int) -> DataFrame:
    """(lang, term) in at least ``least`` documents of the language."""
    counted = docs.select("lang", "text").mapInArrow(count_documents, "lang string, term string, n long")
    return counted.groupBy("lang", "term").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).select("lang", "term")


def shard_of(term: Column, shards: Column) -> Column:
    return (F.shiftrightunsigned(F.xxhash64(term), 1) % shards).cast("int")


def shard_numbers(listed: Sequence[bytes], shards: int) -> np.ndarray:
    """As :func:`shard_of`: Spark's xxhash64 of a string is XXH64 of its bytes with seed 42."""
    hashes = np.fromiter((xxhash.xxh64_intdigest(t, 42) for t in listed), np.uint64, len(listed))
    return ((hashes >> np.uint64(1)) % np.uint64(shards)).astype(np.int64)


def key_hashes(listed: Sequence[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(t) for t in listed), np.uint64, len(listed))


def sent_to(hashes: np.ndarray, displacement: np.ndarray, n: np.ndarray | int) -> np.ndarray:
    """The slot that a displacement of at least 0 sends a hash to."""
    moved = mix(hashes ^ (np.atleast_1d(displacement).astype(np.uint64) * np.uint64(GOLDEN)))
    return (moved % np.asarray(n).astype(np.uint64)).astype(np.int64)


def perfect_hash(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(displacement per bucket, slot per key) with slots 0..n-1, each taken once.

    Buckets from large to small take the least displacement that sends their keys to free slots; buckets of one key
    take what is left, written as -1 - slot.
    """
    n = len(hashes)
    if len(np.unique(hashes)) < n:
        raise ValueError("two terms of a shard share a 64-bit hash")
    buckets = max(1, n // 4)
    bucket = ((hashes >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    starts = np.searchsorted(bucket[order], np.arange(buckets + 1))
    sizes = np.diff(starts)
    taken, slot, displacement = np.zeros(n, bool), np.zeros(n, np.int64), np.zeros(buckets, np.int64)
    tries = np.arange(64)
    for b in np.argsort(-sizes, kind="stable").tolist():
        members = order[starts[b] : starts[b + 1]]
        if len(members) < 2:
            break
        first = 0
        while True:
            at = sent_to(hashes[members][None, :], (first + tries)[:, None], n)
            at.sort(axis=1)
            fits = ~taken[at].any(1) & (np.diff(at, axis=1) > 0).all(1)
            if fits.any():
                displacement[b] = first + int(fits.argmax())
                break
            first += len(tries)
        slot[members] = sent_to(hashes[members], displacement[b], n)
        taken[slot[members]] = True
    single = np.flatnonzero(sizes == 1)
    free = np.flatnonzero(~taken)
    displacement[single] = -1 - free
    slot[order[starts[single]]] = free
    return displacement, slot


def build_shard(rows: pd.DataFrame) -> pd.DataFrame:
    """One row for a shard: its displacements and its terms in slot order."""
    listed = [t.encode() for t in rows["term"]]
    displacement, slot = perfect_hash(key_hashes(listed))
    ordered: list[bytes] = [b""] * len(listed)
    for term, s in zip(listed, slot.tolist(), strict=True):
        ordered[s] = term
    return pd.DataFrame(
        {
            "lang": [rows["lang"].iloc[0]], "shard": [rows["shard"].iloc[0]], "slots": [len(listed)],
            "bytes": [sum(map(len, listed))], "moves": [displacement.astype("<i8").tobytes()], "terms": [ordered],
        }
    )


class Lookup:
    """Slots of the terms of one language, for the shards at hand."""

    def __init__(self, shards: int, rows: list[dict]) -> None:
        self.shards = shards
        self.size, self.buckets = np.zeros(shards, np.int64), np.zeros(shards, np.int64)
        self.at, self.moves_at = np.zeros(shards, np.int64), np.zeros(shards, np.int64)
        self.terms: list[bytes] = []
        moves: list[np.ndarray] = []
        for r in rows:
            move = np.frombuffer(r["moves"], "<i8")
            s = r["shard"]
            self.size[s], self.buckets[s], self.at[s], self.moves_at[s] = r["slots"], len(move), len(self.terms), sum(map(len, moves))
            self.terms += r["terms"]
            moves.append(move)
        self.moves = np.concatenate(moves) if moves else np.zeros(0, np.int64)

    def find(self, listed: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in ``listed``, shard, slot) of the terms that are stored."""
        shard = shard_numbers(listed, self.shards)
        here = np.flatnonzero(self.size[shard] > 0)
        shard = shard[here]
        hashes = key_hashes([listed[i] for i in here.tolist()])
        bucket = ((hashes >> np.uint64(32)) % np.maximum(1, self.buckets[shard]).astype(np.uint64)).astype(np.int64)
        move = self.moves[self.moves_at[shard] + bucket] if len(here) else np.zeros(0, np.int64)
        slot = np.where(move < 0, -1 - move, sent_to(hashes, np.maximum(move, 0), self.size[shard]))
        known = self.terms
        same = np.fromiter(
            (known[p] == listed[i] for p, i in zip((self.at[shard] + slot).tolist(), here.tolist(), strict=True)), bool, len(here)
        )
        return here[same], shard[same], slot[same]


def recount(docs: DataFrame, shards: DataFrame, counts: dict[str, int]) -> DataFrame:
    """(lang, source, shard, block): dense counts of a task's texts, for ``shards`` within the bound of a broadcast."""
    listed: dict[str, list[dict]] = defaultdict(list)
    for r in shards.select("lang", "shard", "slots", "moves", "terms").toArrow().to_pylist():
        listed[r["lang"]].append(r)
    sent = docs.sparkSession.sparkContext.broadcast({lang: Lookup(counts[lang], rows) for lang, rows in listed.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookups = sent.value
        counted: dict[tuple[str, str], Counter[bytes]] = defaultdict(Counter)
        dense: dict[tuple[str, str, int], np.ndarray] = {}
        held = 0

        def enter() -> Iterator[pa.RecordBatch]:
            for (lang, source), found in counted.items():
                if len(dense) > HELD_BLOCKS:
                    yield from told()
                names = list(found)
                place, shard, slot = lookups[lang].find(names)
                n = np.fromiter(found.values(), np.int64, len(names))[place]
                for s in np.unique(shard).tolist():
                    block = dense.get((lang, source, s))
                    if block is None:
                        block = dense[(lang, source, s)] = np.zeros(lookups[lang].size[s], np.int64)
                    block[slot[shard == s]] += n[shard == s]  # a slot is one term, so none stands twice
            counted.clear()

        def told() -> Iterator[pa.RecordBatch]:
            keys = list(dense)
            yield pa.RecordBatch.from_pydict(
                {"lang": pa.array([k[0] for k in keys], pa.string()), "source": pa.array([k[1] for k in keys], pa.string()),
                 "shard": pa.array([k[2] for k in keys], pa.int32()), "block": pa.array([dense[k].astype("<i8").tobytes() for k in keys], pa.binary())}
            )
            dense.clear()

        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                some = batch.slice(start, SLICE)
                for lang, source, text in zip(some.column("lang").to_pylist(), some.column("source").to_pylist(), utf8(some, "text"), strict=True):
                    if lang not in lookups:
                        continue
                    counted[(lang, source)].update(terms(text))
                    held += len(text) + 64
                    if held > HELD_BYTES or len(counted[(lang, source)]) > HELD_TERMS:
                        yield from enter()
                        held = 0
        yield from enter()
        yield from told()

    return docs.select("lang", "source", "text").mapInArrow(run, "lang string, source string, shard int, block binary")


def added(blocks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Blocks of one key added up as they come; a task holds one sum."""

    def row(key: tuple, total: np.ndarray) -> pa.RecordBatch:
        named = {k: pa.array([v], pa.int32() if k == "shard" else pa.string()) for k, v in zip(keys, key, strict=True)}
        return pa.RecordBatch.from_pydict(named | {"block": pa.array([total.tobytes()], pa.binary()), "n": pa.array([int(total.sum())], pa.int64())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total = None, None
        for batch in batches:
            listed = zip(*[batch.column(k).to_pylist() for k in keys], strict=True)
            for now, block in zip(listed, batch.column("block"), strict=True):
                part = np.frombuffer(block.as_buffer(), "<i8")
                if now != key:
                    if total is not None:
                        yield row(key, total)
                    key, total = now, part.copy()
                else:
                    total += part
        if total is not None:
            yield row(key, total)

    kinds = {"lang": "string", "source": "string", "shard": "int"}
    shape = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", block binary, n long"
    return in_order(blocks.select(*keys, "block"), keys).mapInArrow(run, shape)


def shares(counts: np.ndarray, total: int) -> np.ndarray:
    """1 + floor(10^9 (count + 5) / total), three digits at a time so that nothing leaves 64 bits."""
    if total > LARGEST:
        raise OverflowError(f"{total} occurrences are more than exact shares are made for")
    left, made = counts + PRIOR, np.zeros(len(counts), np.int64)
    for _ in range(3):
        left = left * 1000
        made = made * 1000 + left // total
        left = left % total
    return made + 1


def leading_terms(rows: DataFrame, top: int) -> DataFrame:
    """(lang, source, item, value): the first ``top`` over-used terms of every block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                one = {name: batch.column(name)[r] for name in batch.schema.names}
                own, whole = (np.frombuffer(one[c].as_buffer(), "<i8") for c in ("block", "lang_block"))
                extra = PRIOR * one["kept"].as_py()
                gain = shares(own, one["n_source"].as_py() + extra) - shares(whole, one["n_lang"].as_py() + extra)
                some = np.flatnonzero((own > 0) & (gain > 0))
                if len(some) > top:  # nothing below the value at that place can lead; ties are ordered by term
                    some = some[gain[some] >= np.partition(gain[some], len(some) - top)[len(some) - top]]
                names = one["terms"].as_py()
                best = sorted((-int(gain[s]), names[s]) for s in some.tolist())[:top]
                if best:
                    yield pa.RecordBatch.from_pydict(
                        {"lang": pa.array([one["lang"].as_py()] * len(best), pa.string()), "source": pa.array([one["source"].as_py()] * len(best), pa.string()),
                         "item": pa.array([t for _, t in best], pa.binary()).cast(pa.string()), "value": pa.array([-v for v, _ in best], pa.int64())}
                    )

    return rows.mapInArrow(run, "lang string, source string, item string, value long")


def apart(rows: DataFrame) -> DataFrame:
    """(lang, a, b, value): distances of two sources, in either order, over the slots of a shard, by blocks of sources."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols, first, end in groups(batches, ("lang", "shard", "part_i", "part_j")):
            flat, ends = cols["block"]
            names = cols["source"][first:end]
            made = []
            for r in range(first, end):
                raw = flat[ends[r] : ends[r + 1]]
                own = np.frombuffer(raw.tobytes(), "<i8") if len(raw) else np.zeros(int(cols["slots"][r]), np.int64)
                made.append(shares(own, int(cols["n_source"][r] + PRIOR * cols["kept"][r])) if len(own) else own)
            table = np.vstack(made)
            parts = cols["part"][first:end]
            left, right = np.flatnonzero(parts == cols["part_i"][first]), np.flatnonzero(parts == cols["part_j"][first])
            same = cols["part_i"][first] == cols["part_j"][first]
            for i in left.tolist():
                others = right[right > i] if same else right
                if not len(others):
                    continue
                values = np.abs(table[others] - table[i]).sum(1)
                yield pa.RecordBatch.from_pydict(
                    {"lang": pa.array([cols["lang"][first]] * len(others), pa.string()), "a": pa.array([names[i]] * len(others), pa.string()),
                     "b": pa.array(names[others], pa.string()), "value": pa.array(values, pa.int64())}
                )

    return rows.mapInArrow(run, "lang string, a string, b string, value long")


def audit(docs: DataFrame, least: int = LEAST_DOCUMENTS, top: int = TOP_TERMS, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``lang, source, part, item, value, rank``: how far each source of a language stands from the others, and its terms.

    Null text, lang and source read as empty; every row is a document, repeated rows too. ``pair`` rows name each other
    source of the language with the summed difference of shares over all kept terms (0 if none is kept); ``term`` rows
    the first ``top`` terms that the source uses more than its language. Ties are ordered by item in UTF-8. A source
    without kept terms has no term rows, a language with one source no pair rows, an empty table no rows. Other columns
    are ignored.
    """
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    kept = stored(kept_terms(rows, least))
    by_lang = {r["lang"]: r["n"] for r in kept.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per language
    number = {lang: math.ceil(n / SHARD_TERMS) for lang, n in by_lang.items()}
    spark = docs.sparkSession
    per_lang = spark.createDataFrame([(x, by_lang[x], number[x]) for x in by_lang], "lang string, kept long, shards int")
    dealt = kept.join(F.broadcast(per_lang), "lang").select("lang", "term", shard_of(F.col("term"), F.col("shards")).alias("shard"))
    shards = stored(
        dealt.groupBy("lang", "shard").applyInPandas(
            build_shard, "lang string, shard int, slots int, bytes long, moves binary, terms array<binary>"
        )
    )
    size = shards.agg(F.sum("bytes")).first()[0] or 0
    rounds = math.ceil(size / broadcast_bytes)
    found = [recount(rows, shards.filter(F.col("shard") % rounds == r), number) for r in range(rounds)]
    blocks = spark.createDataFrame([], "lang string, source string, shard int, block binary")
    for more in found:
        blocks = blocks.union(more)
    counted = stored(added(blocks, ("lang", "source", "shard")))
    whole = stored(added(counted, ("lang", "shard")))

    # a row per source and per language: what shares are divided by
    seen = rows.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("rows")).select("lang", "source")
    own = counted.groupBy("lang", "source").agg(F.sum("n").alias("n_source"))
    langs = whole.groupBy("lang").agg(F.sum("n").alias("n_lang"))
    in_lang = seen.groupBy("lang").agg(F.count(F.lit(1)).alias("sources"))
    totals = seen.join(own, ["lang", "source"], "left").join(langs, "lang", "left").join(per_lang, "lang", "left").join(in_lang, "lang")
    totals = stored(totals.na.fill(0, ["n_source", "n_lang", "kept"]).select("lang", "source", "n_source", "n_lang", "kept", "sources"))

    named = whole.select("lang", "shard", F.col("block").alias("lang_block")).join(shards.select("lang", "shard", "terms"), ["lang", "shard"])
    used = leading_terms(counted.select("lang", "source", "shard", "block").join(totals, ["lang", "source"]).join(named, ["lang", "shard"]), top)

    # every source with every shard of its language, and one empty shard where nothing is kept
    places = totals.join(shards.select("lang", "shard", "slots"), "lang", "left").na.fill(0, ["shard", "slots"])
    filled = places.join(counted.select("lang", "source", "shard", "block"), ["lang", "source", "shard"], "left")
    filled = filled.withColumn("block", F.coalesce("block", F.lit(b"")))
    paired = chunk_pairs(filled, "shard", "source", F.ceil(F.col("sources") / SOURCE_BLOCK))
    # rows of a shard come in any order, so two sources may be told as (a, b) by one shard and as (b, a) by the next
    told_apart = apart(in_order(paired, ("lang", "shard", "part_i", "part_j")))
    both = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    summed = stored(told_apart.groupBy("lang", *both).agg(F.sum("value").alias("value")))
    pairs = summed.selectExpr("lang", "a as source", "b as item", "value").union(summed.selectExpr("lang", "b", "a", "value"))

    told = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value").union(
        used.select("lang", "source", F.lit("term").alias("part"), "item", "value")
    )
    ranked = told.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")))
    return ranked.filter((F.col("part") == "pair") | (F.col("rank") <= top))
