"""Benchmark decontamination: a BM25 index of test items, block-max WAND for every passage, exact overlap checks."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from evenkeel.llm.common import SLICE, arrow_map, narrow, stored, texts, unused

K1, B = 1.2, 0.75
RETRIEVE = 0.6  # share of an item's own BM25 score that a passage must reach
QUESTION, ANSWER = 0.8, 0.5  # shares of the question's and the answer's word n-grams that the document must hold
GRAM = 5
BLOCK = 32  # postings of a block
ZONE_ITEMS = 2  # items of a range with term maxima of its own
USUAL = 0.4  # share of an item's score that terms without a passage bound may make up
EPS = 1e-6
SPACED = bytes(b if b > 127 or chr(b).isalnum() or chr(b) == "_" else 32 for b in range(256))
GATHERED_WORDS = 50_000  # words of several texts whose passages are bounded at once
MAX_ITEMS = 20_000  # items of one index, about 100 MB at 60 words; more items are searched index after index
LEAST_WINDOW = 64
LEAKS = ArrayType(StructType([StructField("item_id", LongType()), StructField("score", DoubleType())]))


@dataclass
class Whole:
    """What scores need to know of all items, whichever index an item is in."""

    count: int  # items with words
    words: int
    longest: int
    df: dict[bytes, int]  # of the terms that an index holds


@dataclass
class Index:
    """Postings by term, ordered by item, with the largest weight of each block; weights are shares of the item's own score."""

    ids: list[int]
    terms: dict[bytes, int]
    items: list[np.ndarray]  # per term
    weights: list[np.ndarray]
    block_max: list[np.ndarray]
    zone_ends: list[int]  # items of zone z: zone_ends[z] .. zone_ends[z + 1]
    zones: np.ndarray  # zones and their largest weights, term after term
    zone_max: np.ndarray
    zone_at: np.ndarray  # per term, its first place in them
    rare: dict[bytes, int]  # the terms that bound a passage
    usual: np.ndarray  # per zone, what the other terms can add up to in one item at most
    window: int
    parts: list[tuple[frozenset, frozenset]]  # n-grams of question and answer per item


def words_of(text: str) -> list[bytes]:
    """Runs of letters, digits, underscores and characters beyond ASCII, in lower case, as UTF-8."""
    return text.lower().encode("utf-8", "surrogatepass").translate(SPACED).split()


def gram_set(words: list[bytes]) -> frozenset:
    n = min(GRAM, len(words))
    return frozenset(b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)) if words else frozenset()


def split_item(words: list[bytes]) -> tuple[list[bytes], list[bytes]]:
    """Question and answer of an item that has only one text: the answer is its last quarter."""
    at = len(words) - max(1, len(words) // 4) if len(words) > 1 else len(words)
    return words[:at], words[at:]


def build(rows: list[tuple[int, str, str | None]], whole: Whole | None = None) -> Index:
    """``rows``: (item id, text or question, answer or null). Items without words are left out.

    ``whole`` describes all items where ``rows`` are some of them; scores are the same in any division.
    Items are ordered by which of the most common terms they hold, so that items of one language share zones.
    """
    taken = []
    for item, question, answer in rows:
        q = words_of(question or "")
        a = words_of(answer or "")
        if not q and not a:
            continue
        bag = Counter(q + a)
        q, a = (q, a) if answer is not None else split_item(q)
        taken.append((item, bag, (gram_set(q), gram_set(a))))
    common = [t for t, _ in Counter(t for _, bag, _ in taken for t in bag).most_common(24)]
    taken.sort(key=lambda x: ([t not in x[1] for t in common], x[0]))
    ids, bags, parts = [x[0] for x in taken], [x[1] for x in taken], [x[2] for x in taken]
    sizes = [sum(b.values()) for b in bags]
    own_df = Counter(t for b in bags for t in b)
    whole = whole or Whole(len(sizes), sum(sizes), max(sizes, default=0), own_df)
    mean = whole.words / max(1, whole.count)
    idf = {t: math.log(1 + (whole.count - whole.df[t] + 0.5) / (whole.df[t] + 0.5)) for t in own_df}
    lists: dict[bytes, list[tuple[int, float]]] = {}
    for i, bag in enumerate(bags):
        impact = {t: idf[t] * n * (K1 + 1) / (n + K1 * (1 - B + B * sizes[i] / mean)) for t, n in bag.items()}
        own = math.fsum(impact.values())
        for t, w in impact.items():
            lists.setdefault(t, []).append((i, w / own))
    terms = {t: n for n, t in enumerate(lists)}
    items = [np.array([i for i, _ in x], np.int64) for x in lists.values()]
    weights = [np.array([w for _, w in x]) for x in lists.values()]
    block_max = [np.array([w[s : s + BLOCK].max() for s in range(0, len(w), BLOCK)]) for w in weights]
    ends = [*range(0, len(ids), ZONE_ITEMS), len(ids)]
    per_term = []
    for i, w in zip(items, weights, strict=True):  # items are in order, so a zone is a run
        starts = np.flatnonzero(np.diff(i // ZONE_ITEMS, prepend=-1))
        per_term.append((i[starts] // ZONE_ITEMS, np.maximum.reduceat(w, starts)))
    zones = np.concatenate([z for z, _ in per_term]) if per_term else np.zeros(0, np.int64)
    zone_max = np.concatenate([m for _, m in per_term]) if per_term else np.zeros(0)
    zone_at = np.cumsum([0, *(len(z) for z, _ in per_term)])
    # the terms most items share are not essential: what they can add to any one item is known without a passage
    add, rare = np.zeros(len(ids)), dict(terms)
    for t in sorted(terms, key=lambda t: (-own_df[t], t)):
        n = terms[t]
        if (add[items[n]] + weights[n]).max() <= USUAL:
            add[items[n]] += weights[n]
            del rare[t]
    usual = np.array([add[a:b].max() for a, b in zip(ends[:-1], ends[1:], strict=True)])
    window = max(LEAST_WINDOW, 2 * whole.longest)
    return Index(ids, terms, items, weights, block_max, ends, zones, zone_max, zone_at, rare, usual, window, parts)


def search(index: Index, terms: list[int], zone: int, least: float) -> list[tuple[int, float]]:
    """Block-max WAND over one zone: every item whose score over the distinct ``terms`` is at least ``least``.

    Lists stand at their next item, in its order. The pivot is the first list at which the sum of zone maxima can
    reach ``least``; the blocks around the pivot item bound it again, and where their maxima cannot reach it either,
    the lists skip to the end of the nearest block. Only then are weights read.
    """
    first, end = index.zone_ends[zone], index.zone_ends[zone + 1]
    top = {}
    for t in terms:
        places = slice(index.zone_at[t], index.zone_at[t + 1])
        for m in index.zone_max[places][index.zones[places] == zone].tolist():
            top[t] = m
    terms = list(top)
    places = {t: int(np.searchsorted(index.items[t], first)) for t in terms}
    stops = {t: int(np.searchsorted(index.items[t], end)) for t in terms}
    found = []
    while True:
        order = sorted((int(index.items[t][places[t]]), t) for t in terms if places[t] < stops[t])
        total, pivot = 0.0, -1
        for i, (_, t) in enumerate(order):
            total += top[t]
            if total >= least - EPS:
                pivot = i
                break
        if pivot < 0:
            return found
        item = order[pivot][0]
        while pivot + 1 < len(order) and order[pivot + 1][0] == item:
            pivot += 1
        bound, nearest = 0.0, end
        for _, t in order[: pivot + 1]:
            place = places[t] + int(np.searchsorted(index.items[t][places[t] : stops[t]], item))
            if place < stops[t]:
                block = place // BLOCK
                bound += index.block_max[t][block]
                nearest = min(nearest, int(index.items[t][min(len(index.items[t]), (block + 1) * BLOCK) - 1]))
        if bound < least - EPS:  # no item up to the end of the nearest block, nor before the next list's item
            goal = nearest + 1
            if pivot + 1 < len(order):
                goal = min(goal, order[pivot + 1][0])
        elif order[0][0] < item:
            goal = item
        else:
            score = math.fsum(index.weights[t][places[t]] for _, t in order[: pivot + 1])  # in any order of terms
            if score >= least - EPS:
                found.append((item, float(score)))
            goal = item + 1
        for at, t in order[: pivot + 1]:
            if at < goal:
                places[t] += int(np.searchsorted(index.items[t][places[t] : stops[t]], goal))


def passages(index: Index, batch: list[list[bytes]]) -> list[tuple[int, int, int]]:
    """(text, start, zone) of the passages in which some item of the zone may reach the threshold.

    Passages are windows of twice the longest item, each starting half a window after the last, so every run of
    an item's length lies in one. The bound is the sum of zone maxima of a passage's rare terms, each counted once,
    and of all that the usual terms can add to an item of the zone. Texts lie one after the other, each at a
    multiple of half a window and two windows apart.
    """
    half = index.window // 2
    bases, end = [], 0
    for words in batch:
        bases.append(end)
        end += (len(words) // half + 5) * half
    ids = np.fromiter(map(index.rare.get, chain.from_iterable(batch), repeat(-1)), np.int64)
    sizes = [len(words) for words in batch]
    places = np.flatnonzero(ids >= 0)
    if not len(places):
        return []
    terms = ids[places]
    shift = np.array(bases) - np.concatenate(([0], np.cumsum(sizes)[:-1]))
    at = places + np.repeat(shift, sizes)[places]
    order = np.argsort(terms, kind="stable")
    before = np.full(len(at), -10 * half)
    again = terms[order][1:] == terms[order][:-1]
    before[order[1:][again]] = at[order[:-1][again]]
    own = at // half
    new = before < own * half  # not seen before in the half window, so it counts where that begins a passage
    fresh = before < (own - 1) * half  # nor in the one before, so it counts where that begins a passage
    fresh &= own > 0
    windows = np.concatenate((own[new], own[fresh] - 1))
    terms = np.concatenate((terms[new], terms[fresh]))
    firsts, counts = index.zone_at[terms], index.zone_at[terms + 1] - index.zone_at[terms]
    each = np.repeat(firsts - np.concatenate(([0], np.cumsum(counts)[:-1])), counts) + np.arange(counts.sum())
    wide = len(index.usual)
    sums = np.bincount(np.repeat(windows * wide, counts) + index.zones[each], index.zone_max[each])
    kept = np.flatnonzero(sums >= RETRIEVE - EPS - index.usual.max())
    kept = kept[sums[kept] + index.usual[kept % wide] >= RETRIEVE - EPS]
    starts = kept // wide * half
    texts_ = np.searchsorted(bases, starts, "right") - 1
    return [(t, s - bases[t], z) for t, s, z in zip(texts_.tolist(), starts.tolist(), (kept % wide).tolist(), strict=True)]


def leaks(index: Index, batch: list[str]) -> list[list[tuple[int, float]]]:
    """For each text the (item id, best passage score) of the items that it holds."""
    out: list[list[tuple[int, float]]] = []
    gathered: list[list[bytes]] = []
    size = 0
    for text in batch:
        gathered.append(words_of(text))
        size += len(gathered[-1])
        if size >= GATHERED_WORDS:
            out += gathered_leaks(index, gathered)
            gathered, size = [], 0
    return out + gathered_leaks(index, gathered)


def gathered_leaks(index: Index, batch: list[list[bytes]]) -> list[list[tuple[int, float]]]:
    best: dict[int, dict[int, float]] = {}
    for n, start, zone in passages(index, batch) if index.ids and batch else ():
        terms = {t for t in map(index.terms.get, batch[n][max(0, start) : start + index.window]) if t is not None}
        for item, score in search(index, sorted(terms), zone, RETRIEVE):
            scores = best.setdefault(n, {})
            scores[item] = max(scores.get(item, 0.0), score)
    return [verified(index, batch[n], best[n]) if n in best else [] for n in range(len(batch))]


def verified(index: Index, words: list[bytes], best: dict[int, float]) -> list[tuple[int, float]]:
    """Of retrieved items those whose question and answer the words of a text hold."""
    held: dict[int, frozenset] = {}

    def share(wanted: frozenset) -> float:
        if not wanted:
            return 1.0
        n = next(iter(wanted)).count(b" ") + 1
        if n not in held:
            held[n] = frozenset(b" ".join(words[i : i + n]) for i in range(len(words) - n + 1))
        return len(wanted & held[n]) / len(wanted)

    return sorted(
        (index.ids[i], s) for i, s in best.items()
        if share(index.parts[i][0]) >= QUESTION and share(index.parts[i][1]) >= ANSWER
    )


def item_terms(batch: pa.RecordBatch) -> dict:
    """Number of words and distinct terms of each item."""
    split = [words_of(q) + words_of(a) for q, a in zip(texts(batch, "text"), texts(batch, "answer"), strict=True)]
    return {"slice": batch.column("slice"), "size": [len(x) for x in split], "terms": [list(dict.fromkeys(x)) for x in split]}


def indexes(items: DataFrame, id_col: str, text_col: str, answer_col: str | None, max_items: int) -> Iterator[Index]:
    """One index after the other, of about ``max_items`` items at most; only the one being built is on the driver.

    How many items hold a term, the number of items and their length are counted once, in Spark, over all items.
    """
    rows = items.select(
        F.col(id_col).cast("long").alias("id"),
        F.col(text_col).cast("string").alias("text"),
        (F.col(answer_col).cast("string") if answer_col else F.lit(None).cast("string")).alias("answer"),
    ).filter("id is not null").dropDuplicates()
    rows = stored(rows)
    slices = max(1, math.ceil(1.2 * rows.count() / max_items))
    rows = rows.withColumn("slice", F.pmod(F.xxhash64("id"), F.lit(slices)).cast("int"))
    held = stored(arrow_map(rows.select("slice", "text", "answer"), item_terms, "slice int, size long, terms array<binary>"))
    count, words, longest = held.filter("size > 0").agg(F.count(F.lit(1)), F.sum("size"), F.max("size")).first()
    in_slice = held.select("slice", F.explode("terms").alias("term")).groupBy("slice", "term").agg(F.count(F.lit(1)).alias("n"))
    in_slice = stored(in_slice)
    df = in_slice.groupBy("term").agg(F.sum("n").alias("df"))
    known = stored(in_slice.select("slice", "term").join(df, "term"))
    for s in range(slices):
        counts = {bytes(r["term"]): r["df"] for r in known.filter(F.col("slice") == s).select("term", "df").collect()}
        part = rows.filter(F.col("slice") == s).orderBy("id", "text", "answer").select("id", "text", "answer")
        yield build([tuple(r) for r in part.collect()], Whole(count, words or 0, longest or 0, counts))


def searched(docs: DataFrame, text_col: str, name: str, sent) -> DataFrame:
    """``docs`` with the leaks that one index finds, as a further column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("item_id", pa.int64()), ("score", pa.float64())]))
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                some = batch.slice(start, SLICE)
                told = [[{"item_id": i, "score": s} for i, s in x] for x in leaks(sent.value, texts(some, text_col))]
                shape = some.schema.append(pa.field(name, kind))
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(told, kind)], schema=shape)

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, LEAKS)]))


def with_leaks(docs: DataFrame, text_col: str, name: str, built: Iterable[Index]) -> DataFrame:
    """``docs`` with an array ``name`` of (item_id, score) of the items that a text holds, by item.

    Each index is sent alone and released before the next; what all but the last find is stored by two 64-bit hashes
    of the text, which is little. The last is searched where the rows are read, so with one index there is no join.
    """
    spark, found, last = docs.sparkSession, None, None
    marks = [F.xxhash64(text_col), F.xxhash64(F.lit(1), text_col)]
    for index in built:
        if last is not None:
            sent = spark.sparkContext.broadcast(last)
            some = searched(docs.select(text_col), text_col, "held", sent).filter(F.size("held") > 0)
            some = stored(some.select(marks[0].alias("mark_a"), marks[1].alias("mark_b"), "held").distinct())
            sent.destroy()
            found = some if found is None else found.union(some)
        last = index
    rows = searched(docs, text_col, name, spark.sparkContext.broadcast(last))
    if found is not None:
        mark, mark_b, more = (unused(rows, c) for c in ("mark_a", "mark_b", "held"))
        found = found.groupBy(F.col("mark_a").alias(mark), F.col("mark_b").alias(mark_b))
        found = stored(found.agg(F.flatten(F.collect_list("held")).alias(more)))  # one array an index and text
        rows = rows.withColumns({mark: marks[0], mark_b: marks[1]}).join(narrow(found), [mark, mark_b], "left")
        rows = rows.withColumn(name, F.concat(name, F.coalesce(more, F.array().cast(LEAKS))))
    return rows.select(*docs.columns, F.array_sort(name).alias(name))


def find_leaks(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    item_answer_col: str | None = None,
    max_items: int = MAX_ITEMS,
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, contaminated, leaks`` with ``leaks`` an array of (item_id, score).

    Words are runs of word characters in lower case. Every passage of every document is a query; items that score
    at least 0.6 of their own BM25 score in some passage are checked: the document must hold 0.8 of the 5-word
    shingles of the question and 0.5 of those of the answer (without an answer column, the last quarter of the
    item's words). Items are searched index after index, each of about ``max_items`` items and alone in a task;
    documents are read once an index and not shuffled. Scores do not depend on ``max_items``.

    Null or empty text holds nothing; items without words or id are left out; repeated items count once; repeated
    rows give equal rows; an empty table on either side gives empty leaks or an empty result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    built = indexes(items, item_id_col, item_text_col, item_answer_col, max_items)
    found = with_leaks(rows, "text", "leaks", built)
    return found.select("doc_id", (F.size("leaks") > 0).alias("contaminated"), "leaks")


def drop_leaks(docs: DataFrame, items: DataFrame, max_items: int = MAX_ITEMS) -> DataFrame:
    """``docs`` without the rows that hold a test item; all columns are kept as they are."""
    name = unused(docs, "leaks")
    found = with_leaks(docs, "text", name, indexes(items, "item_id", "text", None, max_items))
    return found.filter(F.size(name) == 0).select(docs.columns)
