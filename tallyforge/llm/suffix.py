"""Suffix arrays in numpy: Larsson-Sadakane refinement, Kasai common prefixes, merging by binary search."""

from __future__ import annotations

import numpy as np

U = np.uint64


def packed(text: np.ndarray) -> np.ndarray:
    """For each position the next 8 bytes as a big-endian number (zeros past the end)."""
    n = len(text)
    pad = np.zeros(n + 8, np.uint8)
    pad[:n] = text
    out = np.zeros(n, U)
    for j in range(8):
        out |= pad[j : j + n].astype(U) << U(56 - 8 * j)
    return out


def suffix_array(text: np.ndarray, keys: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The sorted suffixes of ``text`` and the rank of each position.

    Starts from the order of 8-byte prefixes. Each round doubles the sorted depth h: only groups that still
    tie are sorted, by the rank of the suffix h further on. A suffix that ends sorts before its extensions.
    """
    n = len(text)
    keys = packed(text) if keys is None else keys
    sa = np.argsort(keys)
    rank = np.zeros(n, np.int64)
    ordered = keys[sa]
    new = np.ones(n, bool)
    new[1:] = ordered[1:] != ordered[:-1]
    if n >= 1:  # near the end, zeros stand for nothing: the shorter suffix must not tie with a longer one
        tail = np.minimum(n - sa, 8)
        same = ~new
        if (tail < 8).any() and same.any():
            sa = np.lexsort((np.minimum(n - np.arange(n), 8), keys))
            ordered, tail = keys[sa], np.minimum(n - sa, 8)
            new[1:] = (ordered[1:] != ordered[:-1]) | (tail[1:] != tail[:-1])
    start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank[sa] = start
    h = 8
    while True:
        tied = ~new
        tied[:-1] |= ~new[1:]
        at = np.flatnonzero(tied)
        if not len(at) or h >= 2 * n:
            break
        own = sa[at]
        ahead = np.zeros(len(own), np.int64)
        within = own + h < n
        ahead[within] = rank[own[within] + h] + 1
        group = start[at]
        key = group * (n + 1) + ahead
        order = np.argsort(key)
        sa[at] = own[order]
        key = key[order]
        first = np.ones(len(at), bool)
        first[1:] = key[1:] != key[:-1]
        new[at] = first
        start[at] = np.maximum.accumulate(np.where(first, at, 0))
        rank[sa[at]] = start[at]
        h *= 2
    return sa, rank


def common_prefixes(text: np.ndarray, sa: np.ndarray, wanted: np.ndarray | None = None, keys: np.ndarray | None = None, lanes: int = 8192) -> tuple[np.ndarray, np.ndarray]:
    """Kasai's common prefix of each sorted suffix with the one before it: the suffixes ``wanted`` in order, and their prefixes.

    ``wanted`` marks positions (all by default); the prefix is then with the wanted suffix before. The positions are cut into
    stretches, and Kasai's scan runs over all stretches in lock step: going one position on loses one character
    of the prefix at most (if the other suffix's next position is wanted too, else the scan starts anew), and a prefix is
    extended by 8 bytes at a time.
    """
    n = len(text)
    keys = packed(text) if keys is None else keys
    wanted = np.ones(n, bool) if wanted is None else wanted
    order = sa[wanted[sa]]
    lcp = np.zeros(len(order), np.int64)
    if len(order) < 2:
        return order, lcp
    place, before = np.empty(n, np.int64), np.full(n, n, np.int64)
    place[order] = np.arange(len(order))
    before[order[1:]] = order[:-1]
    spots = np.flatnonzero(wanted)
    size = max(32, -(-len(spots) // lanes))
    first = np.ones(len(spots), bool)
    first[1:] = spots[1:] != spots[:-1] + 1
    head = np.flatnonzero(first)
    inside = np.arange(len(spots)) - np.repeat(head, np.diff(np.append(head, len(spots))))
    head = np.flatnonzero(inside % size == 0)
    at, end = spots[head], spots[np.append(head[1:], len(spots)) - 1] + 1
    h = np.zeros(len(at), np.int64)
    follows = np.append(wanted[1:], [False, False])
    while len(at):
        j = before[at]
        most = np.maximum(n - np.maximum(at, j), 0)
        a, b = np.minimum(at + h, n - 1), np.minimum(j + h, n - 1)
        x = keys[a] ^ keys[b]
        same = (x == 0) & (h + 8 <= most)
        h[same] += 8
        done = np.flatnonzero(~same)
        y = x[done]
        more = np.zeros(len(done), np.int64)
        for shift in range(56, -1, -8):
            more += (y >> U(shift)) == 0
        h[done] = np.minimum(h[done] + more, most[done])
        p = at[done]
        lcp[place[p]] = h[done]
        h[done] = np.where(follows[j[done]], np.maximum(h[done] - 1, 0), 0)
        at[done] += 1
        if (at >= end).any():
            live = at < end
            at, end, h = at[live], end[live], h[live]
    return order, lcp


def find(keys: np.ndarray, sorted_at: np.ndarray, other: np.ndarray, query: np.ndarray, length: int) -> np.ndarray:
    """For each query position of another text the index of an equal string among sorted ones, or -1.

    ``keys`` and ``other`` are the ``packed`` forms of the two texts; strings of ``length`` >= 8 bytes are compared
    word by word during one binary search for all queries together.
    """
    steps = [*range(0, length - 7, 8)] + ([length - 8] if length % 8 else [])

    def less(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether sorted string x is less than query y, and whether they are equal."""
        lower, tie = np.zeros(len(x), bool), np.arange(len(x))
        for s in steps:
            a, b = keys[x[tie] + s], other[y[tie] + s]
            lower[tie[a < b]] = True
            tie = tie[a == b]
            if not len(tie):
                break
        equal = np.zeros(len(x), bool)
        equal[tie] = True
        return lower, equal

    low, high = np.zeros(len(query), np.int64), np.full(len(query), len(sorted_at), np.int64)
    while (live := np.flatnonzero(low < high)).size:
        mid = (low[live] + high[live]) // 2
        lower, _ = less(sorted_at[mid], query[live])
        low[live] = np.where(lower, mid + 1, low[live])
        high[live] = np.where(lower, high[live], mid)
    out = np.full(len(query), -1, np.int64)
    inside = np.flatnonzero(low < len(sorted_at))
    _, equal = less(sorted_at[low[inside]], query[inside])
    out[inside[equal]] = low[inside[equal]]
    return out
