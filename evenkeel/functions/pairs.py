"""Counts over a (response, gold) pair of normalised texts, and the scores computed from them.

The counting functions are Arrow-batched and return integers only; every ratio, logarithm and null rule is a Catalyst
expression. A pair is scored where its row lies: nothing is exploded to tokens and nothing is shuffled, so the cost is
linear in the text read and a text that fills a third of the table skews nothing.

N-grams and common subsequences are counted for a whole batch at once over integer token codes: codes are places in the
batch's distinct gold texts, an n-gram is the code of its beginning and its last token, and a token outside the gold
texts has none. Characters in matching blocks are found in ``blocks``. Why not built-in functions: the same overlap as a fold over a sorted array ran 5 times slower here
because higher-order functions are interpreted per element, and exploded tokens shuffle more bytes than the texts hold.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F

from evenkeel.functions import blocks

BLEU_ORDER = 4
WORDS = 16  # 64-bit words of a gold text up to which responses are taken forward together
BLEU_EPSILON = 0.1  # fixed value: added to an empty n-gram match count


def _places(ordered: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Where the ``wanted`` numbers stand in a sorted array, -1 for those that do not."""
    if not len(ordered):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(ordered, wanted), len(ordered) - 1)
    return np.where(ordered[at] == wanted, at, -1)


def _split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The tokens of all texts, and the row of each."""
    lists = pc.utf8_split_whitespace(texts)
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    flat = lists.flatten()
    some = pc.not_equal(flat, "")
    return flat.filter(some), np.repeat(np.arange(len(texts)), sizes)[some.to_numpy(zero_copy_only=False)]


@dataclass
class _Batch:
    """Pairs as token codes. ``gold`` is the distinct gold text of a row; codes of tokens no gold has are -1."""

    known: np.ndarray
    gold: np.ndarray
    golds: int
    pred_row: np.ndarray
    pred_code: np.ndarray
    gold_row: np.ndarray
    gold_code: np.ndarray
    codes: int

    @classmethod
    def of(cls, pred: pa.Array, gold: pa.Array) -> _Batch:
        coded = gold.dictionary_encode()
        known = pc.and_(pc.is_valid(pred), pc.is_valid(gold)).to_numpy(zero_copy_only=False)
        tokens, pred_row = _split(pred)
        gold_tokens, gold_row = _split(coded.dictionary)
        words = gold_tokens.dictionary_encode()
        at = pc.fill_null(pc.index_in(tokens, value_set=words.dictionary), -1)
        return cls(
            known, pc.fill_null(coded.indices, 0).to_numpy(zero_copy_only=False).astype(np.int64), len(coded.dictionary),
            pred_row, at.to_numpy(zero_copy_only=False).astype(np.int64),
            gold_row, words.indices.to_numpy(zero_copy_only=False).astype(np.int64), len(words.dictionary),
        )

    def matches(self, order: int) -> np.ndarray:
        """Per row the n-gram matches for n = 1 … order, each counted at most as often as the gold text has it."""
        out = np.zeros((len(self.known), order), np.int32)
        pred, gold, p_row, g_row, codes = self.pred_code, self.gold_code, self.pred_row, self.gold_row, self.codes
        for n in range(order):
            if n:  # codes of the n-grams that begin at each token, from those of one token less
                p_last, g_last = self.pred_code[n:], self.gold_code[n:]
                g_whole = g_row[:-1] == self.gold_row[n:]
                keys = gold[:-1] * self.codes + g_last
                distinct = np.unique(keys[g_whole])
                gold, g_row = np.where(g_whole, _places(distinct, keys), -1), g_row[:-1]
                p_whole = (p_row[:-1] == self.pred_row[n:]) & (pred[:-1] >= 0) & (p_last >= 0)
                pred, p_row = np.where(p_whole, _places(distinct, pred[:-1] * self.codes + p_last), -1), p_row[:-1]
                codes = len(distinct)
            some = gold >= 0
            held, often = np.unique(g_row[some] * codes + gold[some], return_counts=True)
            rows = p_row[pred >= 0]
            at = _places(held, self.gold[rows] * codes + pred[pred >= 0])
            rows, at = rows[at >= 0], at[at >= 0]
            pairs, times = np.unique(rows * max(1, len(held)) + at, return_counts=True)
            clipped = np.minimum(times, often[pairs % max(1, len(held))])
            np.add.at(out[:, n], pairs // max(1, len(held)), clipped.astype(np.int32))
        return out

    def common(self) -> np.ndarray:
        """Per row the length of the longest common subsequence (bit-parallel: Hyyrö 2004).

        A gold text is a row of 64-bit words with a bit per token. All responses go forward by one token at a time;
        gold texts longer than ``WORDS`` words take one big integer each instead.
        """
        out = np.zeros(len(self.known), np.int32)
        widths = np.bincount(self.gold_row, minlength=self.golds)
        first = np.concatenate(([0], np.cumsum(widths)))
        keys, place = np.unique(self.gold_row * max(1, self.codes) + self.gold_code, return_inverse=True)
        at = np.arange(len(self.gold_row)) - first[self.gold_row]
        sizes = np.bincount(self.pred_row, minlength=len(self.known))
        starts = np.concatenate(([0], np.cumsum(sizes)))[:-1]
        wanted = self.gold[self.pred_row] * max(1, self.codes) + self.pred_code
        hit = np.where(self.pred_code >= 0, _places(keys, wanted), -1)
        words = -(-widths // 64)[self.gold] if self.golds else np.zeros(len(self.known), np.int64)
        todo = self.known & (sizes > 0) & (words > 0)
        for wide in (1, 2, 4, 8, WORDS):
            rows = np.flatnonzero(todo & (words > (wide // 2 if wide > 1 else 0)) & (words <= wide))
            if len(rows):
                rows = rows[np.argsort(-sizes[rows], kind="stable")]
                masks = np.zeros((len(keys) + 1, wide), np.uint64)
                mine = at < 64 * wide
                np.bitwise_or.at(masks, (place[mine], at[mine] // 64), np.uint64(1) << (at[mine] % 64).astype(np.uint64))
                out[rows] = self._forward(rows, starts[rows], sizes[rows], hit, masks, widths[self.gold[rows]])
        for row in np.flatnonzero(todo & (words > WORDS)).tolist():
            g = self.gold[row]
            where: dict[int, int] = {}
            for bit, key in enumerate(place[first[g] : first[g + 1]].tolist()):
                where.setdefault(key, 0)
                where[key] |= 1 << bit
            full = (1 << int(widths[g])) - 1
            state = full
            for key in hit[starts[row] : starts[row] + sizes[row]].tolist():
                both = state & where.get(key, 0)
                state = ((state + both) | (state - both)) & full
            out[row] = int(widths[g]) - state.bit_count()
        return out

    @staticmethod
    def _forward(
        rows: np.ndarray, starts: np.ndarray, sizes: np.ndarray, hit: np.ndarray, masks: np.ndarray, widths: np.ndarray
    ) -> np.ndarray:
        """``rows`` come from long to short, so those that still have tokens are a beginning of them."""
        wide = masks.shape[1]
        bits = np.clip(widths[:, None] - 64 * np.arange(wide)[None, :], 0, 64)
        full = np.where(bits == 64, ~np.uint64(0), (np.uint64(1) << np.minimum(bits, 63).astype(np.uint64)) - np.uint64(1))
        state = full.copy()
        ends = np.searchsorted(-sizes, -np.arange(int(sizes[0])), "left")  # rows with more than t tokens
        for t, n in enumerate(ends.tolist()):
            now = state[:n]
            both = now & masks[hit[starts[:n] + t]]
            carry = np.zeros(n, np.uint64)
            for w in range(wide):
                total = now[:, w] + both[:, w]
                over = total < now[:, w]
                more = total + carry
                carry = (over | (more < total)).astype(np.uint64)
                now[:, w] = more | (now[:, w] & ~both[:, w])
        return widths - np.bitwise_count(state & full).sum(1, dtype=np.int64)


def _distinct(pred: pa.Array, gold: pa.Array) -> tuple[pa.Array, pa.Array, np.ndarray]:
    """The different pairs of a batch, and for every row which of them it is: a pair that comes again is counted once."""
    codes = [
        pc.fill_null(t.dictionary_encode().indices, -1).to_numpy(zero_copy_only=False).astype(np.int64) + 1 for t in (pred, gold)
    ]
    _, first, copy = np.unique(codes[0] * (len(gold) + 1) + codes[1], return_index=True, return_inverse=True)
    return pred.take(pa.array(first)), gold.take(pa.array(first)), copy


def ngram_matches(pred: Column, gold: Column, order: int = BLEU_ORDER) -> Column:
    """Clipped n-gram match counts for n = 1 … order, as an array."""

    def batch(p: pa.Array, g: pa.Array) -> pa.Array:
        *some, copy = _distinct(p, g)
        made = _Batch.of(*some)
        ends = np.arange(len(p) + 1, dtype=np.int32) * order
        return pa.ListArray.from_arrays(ends, made.matches(order)[copy].reshape(-1), mask=pa.array(~made.known[copy]))

    return F.arrow_udf(batch, "array<int>")(pred, gold)


def lcs_length(pred: Column, gold: Column) -> Column:
    """Length of the longest common token subsequence."""

    def batch(p: pa.Array, g: pa.Array) -> pa.Array:
        *some, copy = _distinct(p, g)
        made = _Batch.of(*some)
        return pa.array(made.common()[copy], mask=~made.known[copy])

    return F.arrow_udf(batch, "int")(pred, gold)


def matched_chars(pred: Column, gold: Column) -> Column:
    """Characters in matching blocks; the order of the arguments decides ties and which text has common characters."""
    return F.arrow_udf(blocks.matched_chars, "int")(pred, gold)


def _f_measure(common: Column, n_pred: Column, n_gold: Column) -> Column:
    precision, recall = common / n_pred, common / n_gold
    return 2 * precision * recall / (precision + recall)


def token_f1(unigram_matches: Column, n_pred: Column, n_gold: Column) -> Column:
    return (
        F.when(unigram_matches.isNull(), None)
        .when((n_pred == 0) & (n_gold == 0), 1.0)
        .when(unigram_matches == 0, 0.0)
        .otherwise(_f_measure(unigram_matches, n_pred, n_gold))
    )


def rouge_l(lcs: Column, n_pred: Column, n_gold: Column) -> Column:
    return F.when(lcs.isNull(), None).when(lcs == 0, 0.0).otherwise(_f_measure(lcs, n_pred, n_gold))


def bleu(matches: Column, n_pred: Column, n_gold: Column) -> Column:
    """Sentence BLEU-4, uniform weights, smoothing method 1 (Papineni 2002; Chen & Cherry 2014)."""
    log_precision = F.lit(0.0)
    for n in range(1, BLEU_ORDER + 1):
        hits = F.get(matches, n - 1).cast("double")
        total = F.greatest(n_pred - (n - 1), F.lit(1))
        log_precision = log_precision + F.ln(F.when(hits == 0, BLEU_EPSILON).otherwise(hits) / total)
    brevity = F.when(n_pred < n_gold, F.exp(1 - n_gold / n_pred)).otherwise(1.0)
    return F.when(matches.isNull(), None).when(F.get(matches, 0) == 0, 0.0).otherwise(
        brevity * F.exp(log_precision / BLEU_ORDER)
    )


def string_similarity(chars: Column, pred: Column, gold: Column) -> Column:
    length = F.char_length(pred) + F.char_length(gold)
    return F.when(chars.isNull(), None).when(length == 0, 1.0).otherwise(2.0 * chars / length)
