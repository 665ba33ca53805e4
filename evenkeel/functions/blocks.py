"""Characters of two texts that stand in matching blocks (Ratcliff & Metzener 1988), for a whole Arrow batch at once.

A pair is a box of characters: all of the response against all of the gold text. The longest common run of a box is a
block, what lies before it in both texts is a box again, and so is what lies behind it. All boxes of all pairs are
searched together, level by level: equal characters are looked up in an index of the gold texts' places, and a run is a
stretch of them on one diagonal. They are listed ``CELLS`` at a time, in order of the response, and runs that go on in
the next list are carried over, so memory does not follow the square of a text's length.

Ties go to the run that begins first in the response, then in the gold text. In gold texts of ``JUNK_LENGTH`` characters
or more, characters that fill more than a hundredth start no run; a run found without them is then lengthened over equal
characters of any kind, and a box without any run has the beginnings of its two sides for one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

JUNK_LENGTH, JUNK_PART = 200, 100  # fixed values: where the heuristic sets in, and the part a character may fill
CELLS = 1 << 20  # equal places listed at a time
CHARS = 1 << 20  # characters searched together, at least one pair
WINDOW = 32


def _chars(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, one after another, and where each text begins."""
    sizes = pc.utf8_length(texts).to_numpy(zero_copy_only=False)
    points = np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le"), np.uint32)
    return points, np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))


def _alike(a: np.ndarray, b: np.ndarray, at_a: np.ndarray, at_b: np.ndarray, room: np.ndarray, step: int) -> np.ndarray:
    """How many characters are equal from two places on in one direction, at most ``room``."""
    out = np.zeros(len(room), np.int64)
    more = np.flatnonzero(room > 0)
    while len(more):
        reach = out[more, None] + np.arange(WINDOW)
        inside = reach < room[more, None]
        reach = np.where(inside, step * reach, 0)
        same = inside & (a[at_a[more, None] + reach] == b[at_b[more, None] + reach])
        run = np.where(same.all(1), WINDOW, np.argmin(same, 1))
        out[more] += run
        more = more[run == WINDOW]
    return out


@dataclass
class _Boxes:
    """Stretches of response and gold characters, ends exclusive, and the pair each belongs to."""

    pair: np.ndarray
    a_from: np.ndarray
    a_to: np.ndarray
    b_from: np.ndarray
    b_to: np.ndarray

    def beside(self, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> _Boxes:
        """What lies before and behind a block of each box, where both texts have characters left; none without one."""
        some = size > 0
        before = self.pair, self.a_from, a, self.b_from, b
        behind = self.pair, a + size, self.a_to, b + size, self.b_to
        return _Boxes(*[np.concatenate((x[some], y[some])) for x, y in zip(before, behind)]).filled()

    def filled(self) -> _Boxes:
        some = (self.a_from < self.a_to) & (self.b_from < self.b_to)
        return _Boxes(self.pair[some], self.a_from[some], self.a_to[some], self.b_from[some], self.b_to[some])


class _Search:
    def __init__(self, pred: pa.Array, gold: pa.Array):
        coded = gold.dictionary_encode()
        self.text = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.a, self.a_first = _chars(pred)
        self.b, self.b_first = _chars(coded.dictionary)
        sizes = np.diff(self.b_first)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        letters, code = np.unique(self.b, return_inverse=True)
        keys, kind, often = np.unique(owner * max(1, len(letters)) + code, return_inverse=True, return_counts=True)
        filled = sizes[keys // max(1, len(letters))]
        starts_run = (filled < JUNK_LENGTH) | (often <= filled // JUNK_PART + 1)
        self.span = len(self.b) + 1
        place = np.flatnonzero(starts_run[kind])
        order = np.argsort(kind[place], kind="stable")
        self.place = place[order]
        self.index = kind[self.place] * self.span + self.place  # ascending
        self.kind = np.full(len(self.a), -1)  # of each response character, among those of its gold text that start runs
        if len(keys):
            at = np.minimum(np.searchsorted(letters, self.a), len(letters) - 1)
            wanted = np.repeat(self.text, np.diff(self.a_first)) * len(letters) + at
            which = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
            known = (letters[at] == self.a) & (keys[which] == wanted) & starts_run[which]
            self.kind = np.where(known, which, -1)

    def count(self) -> np.ndarray:
        out = np.zeros(len(self.text), np.int64)
        whole = self.a_first[:-1], self.a_first[1:], self.b_first[self.text], self.b_first[self.text + 1]
        boxes = _Boxes(np.arange(len(out)), *whole).filled()
        while len(boxes.pair):
            a, b, size = self.longest(boxes)
            back = _alike(self.a, self.b, a - 1, b - 1, np.minimum(a - boxes.a_from, b - boxes.b_from), -1)
            on = _alike(self.a, self.b, a + size, b + size, np.minimum(boxes.a_to - a, boxes.b_to - b) - size, 1)
            a, b, size = a - back, b - back, size + back + on
            np.add.at(out, boxes.pair, size)
            boxes = boxes.beside(a, b, size)
        return out

    def longest(self, boxes: _Boxes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per box where its longest run begins in both texts, and its length; the box's own beginning and 0 without one."""
        a, b, size = boxes.a_from.copy(), boxes.b_from.copy(), np.zeros(len(boxes.pair), np.int64)
        for box, start_a, start_b, length in self.runs(boxes):
            heads = np.flatnonzero(np.concatenate(([True], box[1:] != box[:-1])))
            best = np.maximum.reduceat(length, heads)
            widths = np.diff(np.concatenate((heads, [len(box)])))
            first = np.where(length == np.repeat(best, widths), start_a * self.span + start_b, np.iinfo(np.int64).max)
            first = np.minimum.reduceat(first, heads)
            which = box[heads]
            held = a[which] * self.span + b[which]
            better = (best > size[which]) | ((best == size[which]) & (first < held))
            which, best, first = which[better], best[better], first[better]
            a[which], b[which], size[which] = first // self.span, first % self.span, best
        return a, b, size

    def runs(self, boxes: _Boxes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Runs (box, begin in response, begin in gold, length) by list; within one, those of a box stand together."""
        widths = boxes.a_to - boxes.a_from
        box = np.repeat(np.arange(len(widths)), widths)
        row = np.arange(len(box)) + np.repeat(boxes.a_from - (np.cumsum(widths) - widths), widths)
        kind = self.kind[row]
        box, row, kind = box[kind >= 0], row[kind >= 0], kind[kind >= 0]
        low = np.searchsorted(self.index, kind * self.span + boxes.b_from[box])
        often = np.searchsorted(self.index, kind * self.span + boxes.b_to[box]) - low
        box, row, low, often = (x[often > 0] for x in (box, row, low, often))
        ends = np.cumsum(often)
        at, carried = 0, None
        while at < len(row):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CELLS, "right")))
            n = often[at:to]
            cell = np.repeat(np.arange(at, to), n)
            inner = np.arange(len(cell)) - np.repeat(np.cumsum(n) - n, n)
            of, a, b = box[cell], row[cell], self.place[low[cell] + inner]
            diagonal = of * (len(self.a) + self.span) + (a - b + self.span)
            order = np.argsort(diagonal, kind="stable")
            of, a, b, diagonal = of[order], a[order], b[order], diagonal[order]
            fresh = np.ones(len(of), bool)
            fresh[1:] = (diagonal[1:] != diagonal[:-1]) | (a[1:] != a[:-1] + 1)
            heads = np.flatnonzero(fresh)
            length = np.diff(np.concatenate((heads, [len(of)])))
            of, a, b = of[heads], a[heads], b[heads]
            if carried and carried[0] == box[at] and carried[1] + 1 == row[at]:
                _, _, last, before = carried  # gold places of the row before, ascending, and the runs that end there
                where = np.minimum(np.searchsorted(last, b - 1), len(last) - 1)
                add = np.where((of == box[at]) & (a == row[at]) & (last[where] == b - 1), before[where], 0)
                a, b, length = a - add, b - add, length + add
            yield of, a, b, length
            end = np.flatnonzero((of == box[to - 1]) & (a + length - 1 == row[to - 1]))
            last = b[end] + length[end] - 1
            by = np.argsort(last)
            carried = box[to - 1], row[to - 1], last[by], length[end][by]
            at = to


def matched_chars(pred: pa.Array, gold: pa.Array) -> pa.Array:
    """Per pair the characters in matching blocks; null where a text is missing. Empty texts match nothing."""
    out = np.zeros(len(pred), np.int64)
    known = pc.and_(pc.is_valid(pred), pc.is_valid(gold)).to_numpy(zero_copy_only=False)
    same = pc.fill_null(pc.equal(pred, gold), False).to_numpy(zero_copy_only=False)
    sizes = pc.fill_null(pc.utf8_length(pred), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    out[same] = sizes[same]
    todo = np.flatnonzero(known & ~same)
    codes = [t.dictionary_encode().indices.take(pa.array(todo)).to_numpy(zero_copy_only=False).astype(np.int64) for t in (pred, gold)]
    pairs = codes[0] * len(gold) + codes[1]
    _, first, copy = np.unique(pairs, return_index=True, return_inverse=True)
    every, todo = todo, todo[first]  # a pair that comes again is searched once
    both = np.cumsum(sizes[todo] + pc.fill_null(pc.utf8_length(gold), 0).to_numpy(zero_copy_only=False)[todo])
    at = 0
    while at < len(todo):
        to = max(at + 1, int(np.searchsorted(both, (both[at - 1] if at else 0) + CHARS, "right")))
        rows = todo[at:to]
        out[rows] = _Search(pred.take(pa.array(rows)), gold.take(pa.array(rows))).count()
        at = to
    out[every] = out[todo][copy]
    return pa.array(out.astype(np.int32), mask=~known)
