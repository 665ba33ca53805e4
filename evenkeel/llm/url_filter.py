"""URL rules in a sorted digest array: memory-mapped 64-bit xxhash keys, binary search, stored strings as proof."""

from __future__ import annotations

import os
import tempfile

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, functions as F

from evenkeel.llm.common import arrow_map

MAX_RULES = 5_000_000  # a rule list is a resource of bounded size: about 60 bytes a rule, shipped to every executor
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ALLOW, BLOCK = "allow", "block"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (after the first ``://``, A-Z lower-cased) and path; both empty for null or without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3))
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)([^?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, "^([^/?#]*)([^?#]*)", 2)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


class DigestArray:
    """The rule file: sorted digests, end offsets of the rules' bytes, actions, bytes; all memory-mapped."""

    def __init__(self, path: str) -> None:
        count, size, self.labels, kinds = np.memmap(path, np.int64, "r", 0, (4,)).tolist()
        at = 32
        self.lengths = np.array(np.memmap(path, np.int64, "r", at, (kinds,))) if kinds else np.zeros(0, np.int64)
        at += 8 * kinds
        self.digests = np.memmap(path, np.uint64, "r", at, (count,)) if count else np.zeros(0, np.uint64)
        at += 8 * count
        self.ends = np.memmap(path, np.int64, "r", at, (count + 1,))
        at += 8 * (count + 1)
        self.actions = np.memmap(path, np.uint8, "r", at, (count,)) if count else np.zeros(0, np.uint8)
        at += count
        self.strings = np.memmap(path, np.uint8, "r", at, (size,)) if size else np.zeros(0, np.uint8)

    @staticmethod
    def write(rules: list[tuple[str, str]], path: str) -> None:
        """``rules``: (host + path, action). Of equal rules with both actions, block holds."""
        chosen: dict[bytes, int] = {}
        for rule, action in rules:
            key = rule.encode()
            chosen[key] = max(chosen.get(key, 0), int(action == BLOCK))
        rows = sorted((xxhash.xxh64_intdigest(k), k, a) for k, a in chosen.items())
        paths = sorted({len(k.partition(b"/")[1] + k.partition(b"/")[2]) for k in chosen})
        labels = max((k.partition(b"/")[0].count(b".") + 1 for k in chosen), default=0)
        with open(path, "wb") as out:
            out.write(np.array([len(rows), sum(len(k) for _, k, _ in rows), labels, len(paths)], np.int64).tobytes())
            out.write(np.array(paths, np.int64).tobytes())
            out.write(np.array([d for d, _, _ in rows], np.uint64).tobytes())
            out.write(np.cumsum([0, *(len(k) for _, k, _ in rows)], dtype=np.int64).tobytes())
            out.write(np.array([a for _, _, a in rows], np.uint8).tobytes())
            out.write(b"".join(k for _, k, _ in rows))

    def find(self, keys: list[bytes]) -> np.ndarray:
        """Row of each key, -1 if absent: binary search for all digests at once, then the stored bytes decide."""
        probes = np.fromiter(map(xxhash.xxh64_intdigest, keys), np.uint64, len(keys))
        low, high = np.searchsorted(self.digests, probes, "left"), np.searchsorted(self.digests, probes, "right")
        found = np.full(len(keys), -1)
        for i in np.flatnonzero(low < high).tolist():
            for row in range(low[i], high[i]):  # more than one row only where digests collide
                if self.strings[self.ends[row] : self.ends[row + 1]].tobytes() == keys[i]:
                    found[i] = row
        return found


OPENED: dict[str, DigestArray] = {}  # one mapping per worker process and file


def judged(batch: pa.RecordBatch, name: str, default: str) -> dict:
    if name not in OPENED:
        OPENED[name] = DigestArray(SparkFiles.get(name))
    array = OPENED[name]
    hosts, paths = batch.column("host").to_pylist(), batch.column("path").to_pylist()
    keys: list[bytes] = []
    owner: list[int] = []
    for i, (host, path) in enumerate(zip(hosts, paths, strict=True)):
        raw = path.encode()
        starts = [raw[:n] for n in array.lengths if n <= len(raw)]
        labels = host.rsplit(".", array.labels)[-array.labels :] if array.labels else []
        for k in range(1, len(labels) + 1):
            tail = ".".join(labels[-k:])
            keys += [tail.encode() + s for s in starts]
            owner += [i] * len(starts)
    found = array.find(keys)
    best = np.full(len(hosts), -1)
    length = np.full(len(hosts), -1)
    for j in np.flatnonzero(found >= 0).tolist():
        if len(keys[j]) > length[owner[j]]:
            best[owner[j]], length[owner[j]] = found[j], len(keys[j])
    rules = [None if b < 0 else array.strings[array.ends[b] : array.ends[b + 1]].tobytes().decode() for b in best]
    verdicts = [default if b < 0 else (ALLOW, BLOCK)[array.actions[b]] for b in best]
    return {c: batch.column(c) for c in batch.schema.names} | {"rule": rules, "verdict": verdicts}


def judge_urls(
    pages: DataFrame,
    rules: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    default: str = ALLOW,
    max_rules: int = MAX_RULES,
) -> DataFrame:
    """One row per row of ``pages``: ``page_id, host, path, rule, verdict``.

    ``rules(rule, action)``: host and path as in ``net/fr/``, action ``allow`` or ``block``. A rule fits its host and
    all subdomains if the path starts with the rule's path; the longest rule wins; of equal rules with both actions
    block holds; null rules are left out. Without a rule the verdict is ``default``.

    The rules become one file of sorted digests that Spark ships to every executor once, where tasks map it into
    memory; more than ``max_rules`` rules raise an error. Nothing is shuffled. A null url, or one without ``://``,
    has an empty host and path. Repeated rows and other columns do no harm; an empty table gives an empty result.
    """
    known = rules.filter("rule is not null and rule != '' and action is not null").select(
        F.concat(
            F.translate(F.substring_index("rule", "/", 1), UPPER, LOWER),
            F.expr("substring(rule, length(substring_index(rule, '/', 1)) + 1)"),
        ).alias("rule"),
        "action",
    )
    listed = [(r["rule"], r["action"]) for r in known.limit(max_rules + 1).toLocalIterator()]
    if len(listed) > max_rules:
        raise ValueError(f"more than {max_rules} rules")
    name = f"rules-{os.urandom(6).hex()}.bin"
    path = os.path.join(tempfile.mkdtemp(), name)
    DigestArray.write(listed, path)
    pages.sparkSession.sparkContext.addFile(path)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url_text"))
    host, path_part = url_parts(F.col("url_text"))
    rows = rows.select("page_id", host.alias("host"), path_part.alias("path"))
    return arrow_map(
        rows, lambda b: judged(b, name, default), "page_id long, host string, path string, rule string, verdict string"
    )
