"""SentencePiece encoding and decoding by lattice search (operator 2).

The piece lattice of a text has an edge for each piece that matches somewhere, and byte pieces for a character that is no
piece. No piece of a supported vocabulary goes on after a word's end, and some characters occur in no longer piece;
so the lattice falls into chunks (a word with the space before it, a line end, ...), which are searched once each
and put together again.

- Encoding takes the best path. Distinct chunks are searched together: a trie walk over hashed prefixes finds all
  edges, the forward Viterbi pass runs over all chunks in lock step.
- The n best segmentations come from a backward A-star search (``astar``), with the forward Viterbi scores as the exact
  heuristic, so it only expands what it returns. A second Viterbi pass from the right gives each chunk's loss for
  leaving its best path; a text's n best can leave it only in its n - 1 chunks of least loss, so A-star runs on those, and its
  paths take the places of these chunks' best ones.

The driver reads the vocabulary file and ships its pieces with the job.

Scores are whole micro-nats, so sums are exact. Of paths that tie, the best one ends with the longest pieces.
The public vocabulary file has BPE ranks and no probabilities: a piece of rank r gets Zipf's ln p = -ln(r + 1) - ln H,
a byte piece ``BYTE_LOSS`` nats less than the rarest piece.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._bytes import U, buffers, mix
from ._spark import map_arrow, only, slabs, table, texts, typed

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BEST = 3
BYTE_LOSS = 10.0
#: Bytes of text whose chunks are told apart together, and characters of distinct chunks searched together: some 60 bytes of arrays for each
#: byte of a slab, and 500 for each character of a block. They bound what a Python worker takes; larger ones are not faster.
SLAB = 1 << 20
BLOCK = 1 << 16
MARK = 0x2581
#: Added to a MARK that the text itself has: no piece matches it, and its bytes bring it back.
ESCAPE = 0x110000
MULT = 0x9E3779B97F4A7C15
SLOTS = 20


def _slot(h: np.ndarray) -> np.ndarray:
    return (h >> U(64 - SLOTS)).astype(np.int64)


@dataclass
class Vocabulary:
    """Pieces, integer scores and the tables for lattice search; built from (piece, score) and byte piece ids."""

    pieces: list[str]
    scores: np.ndarray
    byte_ids: np.ndarray
    longest: int = 0
    one: dict[str, int] = field(default_factory=dict)
    ids: dict[str, int] = field(default_factory=dict)

    def __post_init__(self) -> None:
        real = [(p, i) for i, p in enumerate(self.pieces) if p]
        if any(a != "▁" and b == "▁" for p, _ in real for a, b in zip(p, p[1:])):
            raise ValueError("a piece goes on after a word's end: the lattice has no cuts there")
        self.ids = dict(real)
        self.longest = max(map(len, self.ids), default=1)
        self.byte_score = int(self.scores[[i for _, i in real]].min() - BYTE_LOSS * 1e6) if real else int(-BYTE_LOSS * 1e6)
        joins = {c for p, _ in real if len(p) > 1 for c in p}
        self.joins = np.zeros(0x110000, bool)
        self.joins[[ord(c) for c in joins]] = True
        keys: dict[int, list[int]] = {}
        for p, i in real:
            h = 0
            for n, c in enumerate(p):
                h = (h * MULT + ord(c) + 1) % 2**64
                entry = keys.setdefault(h, [-1, 0])
                if n + 1 == len(p):
                    entry[0] = i
                else:
                    entry[1] = 1
        self.keys = np.array(list(keys), U)
        self.key_id = np.array([v[0] for v in keys.values()], np.int64)
        self.key_more = np.array([v[1] for v in keys.values()], bool)
        spread = mix(self.keys)
        self.first = np.full(1 << SLOTS, -1, np.int32)
        self.first[_slot(spread)] = np.arange(len(self.keys))
        left = np.flatnonzero(self.first[_slot(spread)] != np.arange(len(self.keys)))
        order = np.argsort(self.keys[left])
        self.left_keys, self.left_at = self.keys[left][order], left[order]
        table_ = [p.replace("▁", " ").encode() for p in self.pieces]
        for b, i in enumerate(self.byte_ids):
            table_[i] = bytes([b])
        self.out = np.frombuffer(b"".join(table_), np.uint8)
        self.out_size = np.array([len(x) for x in table_], np.int64)
        self.out_at = np.cumsum(self.out_size) - self.out_size

    @classmethod
    def load(cls, model: str = MODEL) -> Vocabulary:
        """From a SentencePiece model file with byte pieces."""
        return cls(*cls.read(model))

    @staticmethod
    def read(model: str = MODEL) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Pieces, scores and byte pieces of a model file."""
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=model)
        n = m.get_piece_size()
        pieces, bytes_, rank, ranks = [], {}, 0, np.zeros(n)
        for i in range(n):
            p = m.id_to_piece(i)
            if m.is_byte(i):
                bytes_[int(p[1:-1], 16)] = i
                p = ""
            elif m.is_control(i) or m.is_unknown(i) or m.is_unused(i):
                p = ""
            else:
                rank += 1
                ranks[i] = rank
            pieces.append(p)
        if len(bytes_) != 256:
            raise ValueError("the vocabulary needs its 256 byte pieces")
        total = sum(1 / (r + 1) for r in range(1, rank + 1))
        return pieces, np.round(-1e6 * (np.log(ranks + 1) + math.log(total))).astype(np.int64), np.array([bytes_[b] for b in range(256)])

    def find(self, h: np.ndarray) -> np.ndarray:
        """Index among the keys, or -1."""
        i = self.first[_slot(mix(h))].astype(np.int64)
        got = np.where((i >= 0) & (self.keys[i] == h), i, -1)
        if len(self.left_keys):
            rest = np.flatnonzero(got < 0)
            j = np.minimum(np.searchsorted(self.left_keys, h[rest]), len(self.left_keys) - 1)
            got[rest] = np.where(self.left_keys[j] == h[rest], self.left_at[j], -1)
        return got

    # One chunk: A-star.
    def edges(self, chunk: list[int]) -> list[list[tuple[int, int, tuple[int, ...]]]]:
        """For each position the edges (start, score, ids) that end there; a piece that is longer comes first."""
        text = "".join(chr(c) if c < ESCAPE else "\0" for c in chunk)
        into: list[list[tuple[int, int, tuple[int, ...]]]] = [[] for _ in range(len(chunk) + 1)]
        for j in range(1, len(chunk) + 1):
            for i in range(max(0, j - self.longest), j):
                if (p := self.ids.get(text[i:j])) is not None and all(c < ESCAPE for c in chunk[i:j]):
                    into[j].append((i, int(self.scores[p]), (p,)))
            if text[j - 1] not in self.ids or chunk[j - 1] >= ESCAPE:
                b = chr(chunk[j - 1] % ESCAPE).encode()
                into[j].append((j - 1, self.byte_score * len(b), tuple(int(self.byte_ids[x]) for x in b)))
        return into

    def astar(self, chunk: list[int], n: int) -> list[tuple[int, tuple[int, ...]]]:
        """The ``n`` best segmentations (score, ids) of a chunk, best first; equal ones in the order of the search, which is always the same."""
        into = self.edges(chunk)
        best = [0] + [0] * len(chunk)
        for j in range(1, len(chunk) + 1):
            best[j] = max(best[i] + s for i, s, _ in into[j])
        heap: list = [(-best[-1], 0, len(chunk), 0, None)]
        out, turn = [], 0
        while heap and len(out) < n:
            _, _, j, done, tail = heapq.heappop(heap)
            if j == 0:
                ids = []
                while tail:
                    ids += tail[0]
                    tail = tail[1]
                out.append((done, tuple(ids)))
                continue
            for i, s, ids in into[j]:
                turn -= 1  # of equals the newest first: one path is followed to its end
                heapq.heappush(heap, (-(done + s + best[i]), turn, i, done + s, (ids, tail)))
        return out

    # Many chunks: Viterbi in lock step.
    def viterbi(self, cp: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of chunks of code points that lie end to end: flat ids, ids of each chunk, best score, loss of the second best path."""
        n = len(cp)
        limit = np.repeat(end, end - start)
        us, vs, ids, sc = [], [], [], []
        at, h = np.arange(n), np.zeros(n, U)
        single = np.zeros(n, bool)
        for k in range(self.longest):
            h = h * U(MULT) + cp[at + k].astype(U) + U(1)
            key = self.find(h)
            hit = key >= 0
            at, h, key = at[hit], h[hit], key[hit]
            p = self.key_id[key]
            e = p >= 0
            us.append(at[e])
            vs.append(at[e] + k + 1)
            ids.append(p[e])
            sc.append(self.scores[p[e]])
            if k == 0:
                single[at[e]] = True
            go = self.key_more[key] & (at + k + 1 < limit[at])
            at, h = at[go], h[go]
        other = np.flatnonzero(~single)
        point = cp[other].astype(np.int64) % ESCAPE
        size = 1 + (point > 0x7F) + (point > 0x7FF) + (point > 0xFFFF)
        us.append(other)
        vs.append(other + 1)
        ids.append(-1 - point)
        sc.append(size * self.byte_score)
        u, v, i, s = map(np.concatenate, (us, vs, ids, sc))
        low = np.iinfo(np.int64).min // 4
        # where no piece spans, every path has a cut: search between those
        spans = np.zeros(n + 1, np.int64)
        wide = v - u > 1
        np.add.at(spans, u[wide] + 1, 1)
        np.add.at(spans, v[wide], -1)
        whole, start = start, np.flatnonzero((np.cumsum(spans)[:n] == 0))
        end = np.append(start[1:], n)
        m = len(start)
        limit = np.repeat(end, end - start)
        origin = np.repeat(start, end - start)

        def relax(a: np.ndarray, b: np.ndarray, local: np.ndarray, keep: bool):
            """Best score of each node from nodes ``a`` to nodes ``b``, in the order of ``local``; with keep also its edge."""
            order = np.lexsort((a, b, local))
            value = np.full(n + m, low)
            value[base] = 0
            edge = np.full(n + m, -1)
            ob = b[order]
            groups = np.flatnonzero(np.concatenate(([True], ob[1:] != ob[:-1]))) if len(ob) else np.zeros(0, np.int64)
            steps = np.searchsorted(local[order], np.arange(1, int(local.max(initial=0)) + 2))
            for x, y in zip(steps[:-1], steps[1:]):
                if x == y:
                    continue
                e = order[x:y]
                total = value[a[e]] + s[e]
                g = groups[np.searchsorted(groups, x) : np.searchsorted(groups, y)] - x
                top = np.maximum.reduceat(total, g)
                value[ob[x + g]] = top
                if keep:
                    hits = np.flatnonzero(total == np.repeat(top, np.diff(np.append(g, y - x))))
                    own = np.searchsorted(g, hits, "right") - 1
                    first = np.concatenate(([True], own[1:] != own[:-1]))
                    edge[ob[x + g]] = e[hits[first]]
            return value, edge

        shift = np.repeat(np.arange(m), end - start)  # node of position p in chunk c: p + c; a chunk's end: end + c
        nu = u + shift[u]
        nv = v + shift[u]
        base = start + np.arange(m)
        last = end + np.arange(m)
        forward, edge = relax(nu, nv, v - origin[u], True)
        home = base
        base = last
        backward, _ = relax(nv, nu, limit[u] - u, False)
        base = home
        best = forward[last]
        cur, chunk, step = last.copy(), np.arange(m), 0
        taken, own, turn = [], [], []
        while len(cur):
            e = edge[cur]
            taken.append(e)
            own.append(chunk)
            turn.append(np.full(len(e), step))
            cur = nu[e]
            live = cur > base[chunk]
            cur, chunk, step = cur[live], chunk[live], step + 1
        taken, own, turn = map(np.concatenate, (taken, own, turn))
        order = np.lexsort((-turn, own))
        taken, own = taken[order], own[order]
        off = np.ones(len(u), bool)
        off[taken] = False
        through = np.full(m, low)
        o = np.flatnonzero(off)
        if len(o):
            c = shift[u[o]]
            order = np.argsort(c, kind="stable")
            c, value = c[order], (forward[nu[o]] + s[o] + backward[nv[o]])[order]
            g = np.flatnonzero(np.concatenate(([True], c[1:] != c[:-1])))
            through[c[g]] = np.maximum.reduceat(value, g)
        loss = np.where(through > low // 2, best - through, np.iinfo(np.int64).max)
        flat = i[taken]
        byte = flat < 0
        size = np.ones(len(flat), np.int64)
        point = -1 - flat
        size[byte] = (1 + (point > 0x7F) + (point > 0x7FF) + (point > 0xFFFF))[byte]
        rep = np.repeat(np.arange(len(flat)), size)
        out = flat[rep]
        b = np.flatnonzero(byte[rep])
        if len(b):
            r = rep[b]
            k = b - (np.cumsum(size) - size)[r]
            pt, sz = point[r], size[r]
            tail = 0x80 | ((pt >> (6 * (sz - 1 - k))) & 0x3F)
            head = np.where(sz == 1, pt, np.choose(sz - 1, [pt, 0xC0 | (pt >> 6), 0xE0 | (pt >> 12), 0xF0 | (pt >> 18)]))
            out[b] = self.byte_ids[np.where(k == 0, head, tail)]
        first = np.searchsorted(start, whole)  # of the stretches of each chunk
        count = np.bincount(own[rep], minlength=m)
        return out.astype(np.int32), np.add.reduceat(count, first), np.add.reduceat(best, first), np.minimum.reduceat(loss, first)


@dataclass
class Encoded:
    """The encodings of some texts."""

    ids: np.ndarray
    at: np.ndarray
    score: np.ndarray
    #: Of each text the n best segmentations, best first: (score, what replaces tokens a to b of the best one).
    nbest: list[list[tuple[int, list[tuple[int, int, tuple[int, ...]]]]]]

    def best(self, row: int) -> list[np.ndarray]:
        """The ids of the n best segmentations of a text."""
        ids = self.ids[self.at[row] : self.at[row + 1]]
        out = []
        for _, changes in self.nbest[row]:
            parts, end = [], 0
            for a, b, new in sorted(changes):
                parts += [ids[end:a], np.array(new, np.int32)]
                end = b
            out.append(np.concatenate([*parts, ids[end:]]) if parts else ids)
        return out


def encode(vocab: Vocabulary, rows: list[str], best: int = BEST, cache: dict | None = None) -> Encoded:
    """The ``best`` best segmentations of each text (fewer if there are no more).

    A text has a space put before it, as the vocabulary expects; an empty text has no ids and no segmentation.
    """
    full = "".join("\0" + r for r in rows if r)
    cp = np.frombuffer(full.encode("utf-32-le"), np.uint32).copy()
    sizes = np.array([len(r) + 1 if r else 0 for r in rows])
    at = np.concatenate(([0], np.cumsum(sizes)))
    doc0 = at[:-1][sizes > 0]
    cp[cp == MARK] += ESCAPE
    cp[cp == 32] = MARK
    cp[doc0] = MARK
    n = len(cp)
    if not n:
        return Encoded(np.zeros(0, np.int32), np.zeros(len(rows) + 1, np.int64), np.zeros(len(rows), np.int64), [[] for _ in rows])
    space = cp == MARK
    alone = ~vocab.joins[np.minimum(cp, 0x10FFFF)] | (cp >= ESCAPE)
    cut = np.zeros(n, bool)
    cut[1:] = (space[1:] & ~space[:-1]) | alone[1:] | alone[:-1]
    cut[doc0] = True
    start = np.flatnonzero(cut)
    end = np.append(start[1:], n)
    # distinct chunks, by hash; then each is compared with the one that stands for it
    width = end - start
    h = np.zeros(len(start), U)
    g = np.zeros(len(start), U)
    live, k = np.arange(len(start)), 0
    while len(live):
        c = cp[start[live] + k].astype(U) + U(1)
        h[live] = (h[live] + c) * U(MULT)
        g[live] = (g[live] ^ c) * U(0xD6E8FEB86659FD93) + U(k)
        k += 1
        live = live[width[live] > k]
    _, first, inverse = np.unique(mix(h) ^ (g * U(0xC2B2AE3D27D4EB4F)), return_index=True, return_inverse=True)
    like = first[inverse]
    if (width[like] != width).any() or (cp[np.repeat(start[like] - start, width) + np.arange(n)] != cp).any():  # a collision: tell them apart by their letters
        seen: dict[bytes, int] = {}
        inverse = np.array([seen.setdefault(cp[a:b].tobytes(), len(seen)) for a, b in zip(start.tolist(), end.tolist())])
        _, first = np.unique(inverse, return_index=True)
    us, ue = start[first], end[first]
    w = ue - us
    flat = np.repeat(us - (np.cumsum(w) - w), w) + np.arange(w.sum())
    ustart = np.cumsum(w) - w
    parts = [vocab.viterbi(cp[flat[ustart[a] : ustart[b - 1] + w[b - 1]]], ustart[a:b] - ustart[a], ustart[a:b] - ustart[a] + w[a:b]) for a, b in slabs(w.tolist(), BLOCK)]
    ids, count, score, loss = map(np.concatenate, zip(*parts))
    where = np.cumsum(count) - count
    many = count[inverse]
    pos = np.repeat(where[inverse] - (np.cumsum(many) - many), many) + np.arange(many.sum())
    chunk_at = np.searchsorted(start, at)
    token_at = np.concatenate(([0], np.cumsum(many)))[chunk_at]
    total = np.concatenate(([0], np.cumsum(score[inverse])))
    out = Encoded(ids[pos], token_at, total[chunk_at[1:]] - total[chunk_at[:-1]], [])
    cache = {} if cache is None else cache
    chunk_loss = loss[inverse]
    tokens = np.concatenate(([0], np.cumsum(many)))
    for r in range(len(rows)):
        a, b = chunk_at[r], chunk_at[r + 1]
        if a == b:
            out.nbest.append([])
            continue
        mine = chunk_loss[a:b]
        # of equal losses the first chunks, so that rows of a text agree
        chosen = np.argsort(mine, kind="stable")[: best - 1] if b - a < 64 else _least(mine, best - 1)
        paths: list[tuple[int, list[tuple[int, int, tuple[int, ...]]]]] = [(0, [])]
        for c in np.sort(chosen).tolist():
            if mine[c] == np.iinfo(np.int64).max:
                continue
            u = first[inverse[a + c]]
            key = cp[start[u] : end[u]].tobytes()
            if key not in cache:
                if len(cache) > 100_000:
                    cache.clear()
                found = vocab.astar(cp[start[u] : end[u]].tolist(), best)
                own = tuple(out.ids[tokens[a + c] : tokens[a + c + 1]].tolist())  # of paths that tie with it, another may come first
                cache[key] = [(0, own), *((found[0][0] - s, ids) for s, ids in found if ids != own)][:best]
            x, y = int(tokens[a + c] - token_at[r]), int(tokens[a + c + 1] - token_at[r])
            more = [(loss + t, [*changes, (x, y, ids)] if i else changes) for loss, changes in paths for i, (t, ids) in enumerate(cache[key])]
            paths = sorted(more, key=lambda p: p[0])[:best]
        out.nbest.append([(int(out.score[r]) - loss, changes) for loss, changes in paths])
    return out


def _least(values: np.ndarray, n: int) -> np.ndarray:
    """Places of the ``n`` least values, the first of equals."""
    if n < 1:
        return np.zeros(0, np.int64)
    top = np.partition(values, n - 1)[n - 1]
    near = np.flatnonzero(values <= top)
    return near[np.argsort(values[near], kind="stable")[:n]]


def decode(vocab: Vocabulary, ids: np.ndarray, at: np.ndarray) -> list[bytes]:
    """The UTF-8 text of each run of ids."""
    size = vocab.out_size[ids]
    flat = np.repeat(vocab.out_at[ids] - (np.cumsum(size) - size), size) + np.arange(size.sum())
    data = vocab.out[flat].tobytes()
    edge = np.concatenate(([0], np.cumsum(size)))[at]
    return [data[a + 1 : b] if b > a else b"" for a, b in zip(edge[:-1], edge[1:])]


def nbest(vocab: Vocabulary, text: str, n: int) -> list[tuple[int, tuple[int, ...]]]:
    """The ``n`` best segmentations of a whole text by A-star over its whole lattice."""
    if not text:
        return []
    return vocab.astar([MARK] + [MARK if c == " " else ord(c) + ESCAPE if ord(c) == MARK else ord(c) for c in text], n)


_LOADED: dict[str, Vocabulary] = {}


def vocabulary(model: str = MODEL) -> Vocabulary:
    """The vocabulary of a file that this process can read, loaded once."""
    if model not in _LOADED:
        _LOADED[model] = Vocabulary.load(model)
    return _LOADED[model]


def _shipped(spark, model: str):
    """A function that gives executors the vocabulary, which travels with the job (about 1 MB)."""
    pieces = spark.sparkContext.broadcast(Vocabulary.read(model))

    def get() -> Vocabulary:
        if model not in _LOADED:
            _LOADED[model] = Vocabulary(*pieces.value)
        return _LOADED[model]

    return get


def encode_texts(docs: DataFrame, model: str = MODEL, best: int = BEST, keep_ids: bool = True) -> DataFrame:
    """doc_id, n_ids, ids_sha256 (of little-endian int32), score (nats), nbest (scores), nbest_sha256, round_trip, and ids and nbest_ids if asked.

    The whole text is encoded and decoded again; round_trip says that this gave the same bytes. nbest_ids are the ids of the n best
    segmentations, best first, and nbest_sha256 their digests. Null and empty texts have no ids, score 0, an empty nbest, and
    round_trip true. doc_id can have any type. An empty table gives no rows.
    """
    docs = only(docs, "doc_id", "text")
    more = "n_ids long, ids_sha256 string, score double, nbest array<double>, nbest_sha256 array<string>, round_trip boolean"
    more += ", ids array<int>, nbest_ids array<array<int>>" if keep_ids else ""
    get, cache = _shipped(docs.sparkSession, model), {}
    digest = lambda ids: hashlib.sha256(ids.tobytes()).hexdigest()

    def f(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        vocab = get()
        col = texts(batch)
        for i, j in slabs(np.diff(buffers(col)[1]).tolist(), SLAB):
            rows = col.slice(i, j - i).to_pylist()
            got = encode(vocab, rows, best, cache)
            back = decode(vocab, got.ids, got.at)
            every = [got.best(r) for r in range(len(rows))]
            cols = {
                "doc_id": batch.column(0).slice(i, j - i),
                "n_ids": np.diff(got.at),
                "ids_sha256": pa.array([digest(got.ids[a:b]) for a, b in zip(got.at[:-1], got.at[1:])], pa.string()),
                "score": got.score / 1e6,
                "nbest": pa.array([[x / 1e6 for x, _ in s] for s in got.nbest], pa.list_(pa.float64())),
                "nbest_sha256": pa.array([[digest(x) for x in s] for s in every], pa.list_(pa.string())),
                "round_trip": pa.array([b == r.encode() for b, r in zip(back, rows)], pa.bool_()),
            }
            if keep_ids:
                cols["ids"] = pa.ListArray.from_arrays(got.at.astype(np.int32), got.ids)
                flat = [x for s in every for x in s]
                inner = pa.ListArray.from_arrays(np.cumsum([0, *map(len, flat)]).astype(np.int32), np.concatenate([*flat, np.zeros(0, np.int32)]))
                cols["nbest_ids"] = pa.ListArray.from_arrays(np.cumsum([0, *map(len, every)]).astype(np.int32), inner)
            yield pa.record_batch(cols)

    return map_arrow(docs, typed(docs, "doc_id", more), f)


def decode_ids(encoded: DataFrame, model: str = MODEL, ids: str = "ids") -> DataFrame:
    """doc_id, text for every row of ``encoded`` (doc_id, a column of ids); null and empty ids give an empty text.

    Bytes that are no UTF-8, which only other ids than encoded ones give, become the replacement character.
    """
    get = _shipped(encoded.sparkSession, model)

    def f(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        col = batch.column(1)
        size = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(col), 0)).astype(np.int64)
        found = decode(get(), np.asarray(col.flatten()).astype(np.int64), np.concatenate(([0], np.cumsum(size))))
        yield pa.record_batch({"doc_id": batch.column(0), "text": pa.array([x.decode(errors="replace") for x in found], pa.string())})

    rows = only(encoded, "doc_id", ids)
    return map_arrow(rows, typed(rows, "doc_id", "text string"), f)


def op2_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """Operator 2 over all documents: the three best segmentations (scores, and ids as digests), and the round trip."""
    return encode_texts(table(spark, sf_dir, "documents"), keep_ids=False)
