"""Vectorised hashing of words and byte strings in numpy.

A polynomial hash modulo 2**64 over an odd base, taken from prefix sums, then mixed.
Equal strings always have equal hashes; operators that need exactness verify what hashes propose.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

U = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
#: Bytes hashed at a time, so that work stays in the cache.
PIECE = 1 << 17
#: Longer words are hashed one by one.
LONG_WORD = 4096
#: A word is a longest run of ASCII letters, digits, underscores and non-ASCII characters.
WORD = np.zeros(256, bool)
WORD[[*range(48, 58), *range(65, 91), 95, *range(97, 123), *range(128, 256)]] = True

_powers = np.ones(1, U), np.ones(1, U)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i below n."""
    global _powers
    if len(_powers[0]) < n:
        out = []
        for b in (BASE, INVERSE):
            a = np.full(n, b & (2**64 - 1), U)
            a[0] = 1
            out.append(np.multiply.accumulate(a))
        _powers = out[0], out[1]
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column without nulls, and where each row starts (and the last ends)."""
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, off, data = col.buffers()
    at = np.frombuffer(off, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def bounds(raw: np.ndarray, at: np.ndarray, word: np.ndarray = WORD) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of all rows; a row's end also ends a word."""
    inside = word[raw]
    before = np.zeros(len(raw) + 1, bool)
    before[1:] = inside
    before[at] = False
    starts = np.flatnonzero(inside & ~before[:-1])
    after = np.zeros(len(raw) + 1, bool)
    after[:-1] = inside
    after[at] = False
    ends = np.flatnonzero(inside & ~after[1:]) + 1
    return starts, ends


def hash_spans(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of the bytes of each span; spans are sorted and do not overlap."""
    out = np.zeros(len(starts), U)
    if not len(starts):
        return out
    long = np.flatnonzero(ends - starts > LONG_WORD)
    for i in long:
        out[i] = int.from_bytes(hashlib.blake2b(raw[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    keep = np.setdiff1d(np.arange(len(starts)), long) if len(long) else np.arange(len(starts))
    i = 0
    while i < len(keep):
        a = starts[keep[i]]
        j = max(i + 1, int(np.searchsorted(ends[keep], a + PIECE, "right"))) if len(long) else max(i + 1, int(np.searchsorted(ends, a + PIECE, "right")))
        k = keep[i:j]
        b = ends[k[-1]]
        p, q = powers(int(b - a) + 1)
        prefix = np.zeros(b - a + 1, U)
        np.cumsum((raw[a:b].astype(U) + U(1)) * p[:-1], out=prefix[1:])
        s, e = starts[k] - a, ends[k] - a
        out[k] = mix((prefix[e] - prefix[s]) * q[s] + (e - s).astype(U))
        i = j
    return out


def owners(positions: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The row that holds each byte position (rows may be empty)."""
    return np.searchsorted(at, positions, "right") - 1


def shingles(words: np.ndarray, row: np.ndarray, n: int, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of ``size`` words and their rows; a row of fewer words has one window of all its words.

    ``words`` and ``row`` are the word hashes and their sorted row numbers below ``n``.
    """
    many = np.bincount(row, minlength=n)
    first = np.concatenate(([0], np.cumsum(many)))
    out, own = [], []
    if len(words) >= size:
        m = len(words) - size + 1
        acc = np.zeros(m, U)
        for j in range(size):
            acc *= U(0x9DDFEA08EB382D69)
            acc += words[j : j + m]
        whole = row[:m] == row[size - 1 :]
        out.append(mix(acc[whole]))
        own.append(row[:m][whole])
    for r in np.flatnonzero((many > 0) & (many < size)):
        acc = int(many[r])
        for w in words[first[r] : first[r + 1]]:
            acc = (acc * 0x9DDFEA08EB382D69 + int(w) + 1) % 2**64
        out.append(mix(np.array([acc], U)))
        own.append(np.array([r]))
    if not out:
        return np.zeros(0, U), np.zeros(0, np.int64)
    h, o = np.concatenate(out), np.concatenate(own)
    order = np.argsort(o, kind="stable")
    return h[order], o[order]
