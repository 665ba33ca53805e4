"""Sum-of-squares packing of token sequences."""

from __future__ import annotations

import json
import zlib
from array import array

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from evenkeel.llm.common import arrow_map, stored, texts

CAPACITY = 2048
GROUP_PIECES = 20_000  # pieces that one task packs; each group wastes a few sequences at its end


class Tokens:
    """Ids (as little-endian 32-bit bytes) of a text under a byte-level BPE vocabulary; one encoder a worker."""

    # fixed values: the pattern of byte-level pre-tokenisers
    PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

    def __init__(self, path: str) -> None:
        import tiktoken

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        added = spec["added_tokens"]
        for t in added:
            if t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]:
                raise ValueError(f"added token that is not matched as it is: {t['content']!r}")
        special = {t["content"]: t["id"] for t in added}
        letters = self.byte_letters()
        ranks = {
            bytes(letters[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special
        }
        encoding = tiktoken.Encoding(path, pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.ordinary = encoding.encode_ordinary
        self.with_special = lambda text: encoding.encode(text, allowed_special="all")
        self.special = list(special)

    @staticmethod
    def byte_letters() -> dict[str, int]:
        """The letter that byte-level vocabularies write for each byte: itself if printable, else the next from U+0100."""
        printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
        rest = [b for b in range(256) if b not in printable]
        return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}

    def of(self, text: str, special: bool = False) -> bytes:
        """With ``special``, added tokens written in the text are one id each, as the reference tokenizer reads them."""
        if special and any(t in text for t in self.special):
            return array("I", self.with_special(text)).tobytes()
        return array("I", self.ordinary(text)).tobytes()


LOADED: dict[str, Tokens] = {}  # one per worker process and vocabulary


def cut(batch: pa.RecordBatch, path: str, capacity: int, with_ids: bool, special: bool = False) -> dict:
    """Pieces of every document: its ids, then id 0, in lengths of ``capacity``; the first piece may be shorter."""
    if path not in LOADED:
        LOADED[path] = Tokens(path)
    tokens = LOADED[path]
    out: dict[str, list] = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32", "ids")}
    encoded = (tokens.of(t, special) for t in texts(batch, "text"))
    for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encoded, strict=True):
        ids += b"\0\0\0\0"
        total = len(ids) // 4
        start, end, piece = 0, total % capacity or capacity, 0
        while start < total:
            raw = ids[4 * start : 4 * end]
            out["doc_id"].append(doc_id)
            out["piece"].append(piece)
            out["start"].append(start)
            out["length"].append(end - start)
            out["ids_crc32"].append(zlib.crc32(raw))
            out["ids"].append(np.frombuffer(raw, "<u4").astype(np.int32) if with_ids else None)
            start, end, piece = end, end + capacity, piece + 1
    return out


def sum_of_squares(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Items in their order to bins: each goes where the sum over gaps of (open bins with that gap)^2 becomes smallest.

    Of equal sums the fullest bin is taken. A full bin is no longer open, and a new one is begun only where no open bin
    has room.
    """
    count = np.zeros(capacity + 1, np.int64)
    open_bins: list[list[list[int]]] = [[] for _ in range(capacity + 1)]
    bins: list[list[int]] = []
    for item, size in enumerate(lengths.tolist()):
        gap = capacity
        if size < capacity:
            before, after = count[size:capacity], 2 * count[: capacity - size] + 1
            after[0] = 0  # a full bin is no longer open
            change = np.where(before > 0, after - 2 * before + 1, 1 << 60)
            k = int(change.argmin())
            if before[k]:
                gap = size + k
        if gap == capacity:
            chosen: list[int] = []
            bins.append(chosen)
        else:
            count[gap] -= 1
            chosen = open_bins[gap].pop()
        chosen.append(item)
        if gap > size:
            count[gap - size] += 1
            open_bins[gap - size].append(chosen)
    return bins


def pack_group(pieces: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """Sum-of-squares packing of one group, from long pieces to short ones."""
    pieces = pieces.sort_values(["length", "draw"], ascending=[False, True], ignore_index=True)
    lengths = pieces["length"].to_numpy()
    bins = sum_of_squares(lengths, capacity)
    sequence, offset = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64)
    for number, items in enumerate(bins):
        sequence[items] = number
        offset[items] = np.cumsum([0, *lengths[items][:-1]])
    pieces["sequence_id"] = pieces["part"].to_numpy(np.int64) * (1 << 32) + sequence
    pieces["offset"] = offset
    return pieces.drop(columns=["part", "draw", "row"])


def pack(
    docs: DataFrame,
    vocabulary: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    group_pieces: int = GROUP_PIECES,
    with_ids: bool = False,
    special: bool = False,
) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` (and ``ids``).

    ``vocabulary`` is the JSON file of a byte-level BPE tokenizer. A document is its ids, then id 0; longer ones are
    cut. Pieces are numbered where they are stored and dealt by a hash of that number to groups of about
    ``group_pieces``, each packed in one task, so equal rows spread over groups; texts are not shuffled. A null text is empty: one id. Added tokens written in a text (``<|endoftext|>``) are ordinary text, or
    with ``special`` one id each, as the reference tokenizer has it by default; the queries use that. Repeated rows
    and null ids are documents of their own. An empty table gives an empty result; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    shape = "doc_id long, piece int, start long, length long, ids_crc32 long"
    shape += ", ids array<int>" if with_ids else ""
    made = arrow_map(rows, lambda b: cut(b, vocabulary, capacity, with_ids, special), shape)
    pieces = stored(made.withColumn("row", F.monotonically_increasing_id()))
    parts = max(1, round(pieces.count() / group_pieces))
    drawn = pieces.withColumn("draw", F.xxhash64("row"))
    dealt = drawn.withColumn("part", F.pmod("draw", F.lit(parts)).cast("int"))
    return dealt.groupBy("part").applyInPandas(
        lambda group: pack_group(group, capacity), f"{shape}, sequence_id long, offset long"
    )

