"""Seeded draws and text fingerprints that give the same value on every engine and every retry."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, functions as F

# md5 (RFC 1321) of texts of one block
SINES = [int(abs(np.sin(i + 1.0)) * 2**32) for i in range(64)]
TURNS = [turn for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for turn in four * 4]
WORDS = [(a * i + b) % 16 for a, b in ((1, 0), (5, 1), (3, 5), (7, 0)) for i in range(16)]
START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


def seeded_hash(seed: int, *parts: Column | str | int) -> Column:
    """32-bit unsigned draw from md5 of ``seed|part|part…``, as bigint."""
    cols = [p if isinstance(p, Column) else F.lit(p) for p in parts]
    digest = F.md5(F.concat_ws("|", F.lit(seed).cast("string"), *[c.cast("string") for c in cols]))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def fingerprint(text: Column) -> Column:
    """16-byte md5 of a text.

    Distinct counts and equality groups shuffle this instead of the text, so a row costs tens of bytes
    whatever the answer length. A chance collision among 10^11 texts has a probability near 10^-17.
    """
    return F.unhex(F.md5(text))


def number(col: Column) -> Column:
    """Numeric coercion: unreadable values and NaN become null."""
    as_double = col.try_cast("double")
    return F.when(~F.isnan(as_double), as_double)


def numbered_hashes(prefix: str, first: int, end: int) -> np.ndarray:
    """:func:`seeded_hash` of the parts ``prefix`` and each number from ``first`` to ``end``, exclusive."""
    head, out = f"{prefix}|".encode(), []
    while first < end:
        digits = len(str(first))
        to = min(end, 10**digits)
        if len(head) + digits < 56:
            out.append(_md5_starts(head, np.arange(first, to), digits))
        else:
            made = [int.from_bytes(hashlib.md5(head + b"%d" % i).digest()[:4], "big") for i in range(first, to)]
            out.append(np.array(made, np.int64))
        first = to
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def _md5_starts(head: bytes, numbers: np.ndarray, digits: int) -> np.ndarray:
    """The first four bytes, as a number, of the md5 of ``head`` and each of ``numbers``, all of so many digits."""
    size = len(head) + digits
    block = np.zeros((len(numbers), 64), np.uint8)
    block[:, : len(head)] = np.frombuffer(head, np.uint8)
    rest = numbers.copy()
    for at in range(size - 1, len(head) - 1, -1):
        block[:, at] = 48 + rest % 10
        rest //= 10
    block[:, size] = 128
    block[:, 56:58] = (size * 8) % 256, size * 8 // 256
    words = block.view("<u4")
    varied = range(len(head) // 4, (size - 1) // 4 + 1)
    word = [np.ascontiguousarray(words[:, i]) if i in varied else int(words[0, i]) for i in range(16)]
    a, b, c, d = (np.full(len(numbers), x, np.uint32) for x in START)
    f, other = np.empty_like(a), np.empty_like(a)
    for step in range(64):
        if step < 16:
            np.bitwise_xor(c, d, f)
            f &= b
            f ^= d
        elif step < 32:
            np.bitwise_xor(b, c, f)
            f &= d
            f ^= c
        elif step < 48:
            np.bitwise_xor(b, c, f)
            f ^= d
        else:
            np.invert(d, f)
            f |= b
            f ^= c
        f += a
        now = word[WORDS[step]]
        if isinstance(now, int):
            f += np.uint32((SINES[step] + now) % 2**32)
        else:
            f += np.uint32(SINES[step])
            f += now
        np.left_shift(f, np.uint32(TURNS[step]), other)
        f >>= np.uint32(32 - TURNS[step])
        f |= other
        f += b
        a, b, c, d, f = d, f, b, c, a
    return (a + np.uint32(START[0])).byteswap().astype(np.int64)
