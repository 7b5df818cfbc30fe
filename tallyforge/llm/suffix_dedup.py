"""Removal of every long byte string that starts earlier in the corpus (operator 8).

Method. Any string of ``length`` bytes holds the least k-gram hash of its own k-grams (its anchor), the same one wherever
the string occurs. So only strings whose anchor occurs twice can repeat, and equal strings meet under one anchor:

1. count the anchors of all documents (one row per anchor and batch leaves a task);
2. join the repeated anchors back to documents, and cut out the segments around them;
3. deal segments out by anchor. Each shard concatenates its distinct segments, builds their suffix array by
   Larsson-Sadakane refinement and the common prefixes by Kasai's scan; runs with prefixes of ``length`` are equal
   strings, of which the earliest stays. Segments of one anchor that exceed a shard are split over several
   shards, whose sorted strings are merged by binary search;
4. strings of anchors beyond ``hot`` occurrences are dealt out one by one, by the hash of their whole bytes.

Nothing is sampled or capped: the result is exact, and the hashes only propose what the suffix arrays decide.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bytes import INVERSE, U, buffers, mix, powers
from ._spark import cut, map_arrow, only, ordinal, slabs, table, texts, typed
from .suffix import common_prefixes, find, packed, suffix_array

LENGTH = 100
GRAM = 32
#: Occurrences from which an anchor's strings are dealt out one by one.
HOT = 100_000
#: Bytes of a shard.
SHARD = 1 << 21
#: Window starts worked on at a time; positions within fit 20 bits.
CHUNK = 1 << 17
LOW = U((1 << 20) - 1)


def anchors(raw: np.ndarray, at: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Runs of window starts that share an anchor: first start, last start, anchor's hash, row.

    A window is ``length`` bytes of one row. Its anchor is the k-gram of least hash, the last of equals.
    """
    n, out = len(raw), []
    valid = np.ones(n, bool)
    for a, b in zip(at[:-1], at[1:]):
        valid[max(a, b - length + 1) : b] = False
    span = length - gram + 1
    p, q = powers(CHUNK + length)
    for c in range(0, n - length + 1, CHUNK):
        m = min(CHUNK, n - length + 1 - c)
        ok = valid[c : c + m]
        if not ok.any():
            continue
        prefix = np.zeros(m + length, U)
        np.cumsum((raw[c : c + m + length - 1].astype(U) + U(1)) * p[: m + length - 1], out=prefix[1:])
        g = mix((prefix[gram:] - prefix[:-gram]) * q[: m + length - gram])
        best = (g & ~LOW) | (LOW - np.arange(len(g), dtype=U))
        width = 1
        while 2 * width <= span:
            best = np.minimum(best[:-width], best[width:])
            width *= 2
        if width < span:
            best = np.minimum(best[: len(best) - (span - width)], best[span - width :])
        where = (LOW - (best & LOW)).astype(np.int64)
        edge = np.ones(m, bool)
        edge[1:] = (where[1:] != where[:-1]) | (ok[1:] != ok[:-1])
        lo = np.flatnonzero(edge)
        hi = np.append(lo[1:], m) - 1
        lo, hi = lo[ok[lo]], hi[ok[lo]]
        out.append((lo + c, hi + c, g[where[lo]]))
    if not out:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(0, U), z
    lo, hi, h = (np.concatenate(x) for x in zip(*out))
    return lo, hi, h, np.searchsorted(at, lo, "right") - 1


def _slabs(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    raw, at = buffers(texts(batch))
    for i, j in slabs(np.diff(at).tolist()):
        yield i, j, raw[at[i] : at[j]], at[i : j + 1] - at[i]


def _counted(length: int, gram: int):
    def f(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        found = [anchors(raw, at, length, gram)[2] for _, _, raw, at in _slabs(batch)]
        h, n = np.unique(np.concatenate(found), return_counts=True)
        yield pa.record_batch({"h": h.view(np.int64), "n": n.astype(np.int64)})

    return f


def _listed(length: int, gram: int):
    def f(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        k, th = np.asarray(batch.column(0)), np.asarray(batch.column(1))
        for i, j, raw, at in _slabs(batch):
            _, _, h, row = anchors(raw, at, length, gram)
            yield pa.record_batch({"h": h.view(np.int64), "k": k[i:j][row], "th": th[i:j][row]})

    return f


def _segments(length: int, gram: int):
    """Segments of a batch, each different one once; for the others only the strings they cover."""

    def f(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        k, th = np.asarray(batch.column(0)), np.asarray(batch.column(1))
        lists = batch.column(batch.schema.get_field_index("anchors"))
        many = batch.column(batch.schema.get_field_index("hot"))
        seen: dict[bytes, tuple[int, int, int, int, int]] = {}
        held = 0
        twins: list[tuple[bytes, tuple[int, int, int, int, int]]] = []
        covered: list[tuple[int, int, int, int, int]] = []

        def flush() -> pa.RecordBatch:
            nonlocal held
            cols = zip(*seen.values(), *(row for _, row in twins), *covered)
            out = pa.record_batch(
                {
                    **{c: pa.array(v, pa.int64()) for c, v in zip(("k", "th", "lo", "n", "d"), cols)},
                    "segment": pa.array([*seen, *(key for key, _ in twins), *[None] * len(covered)], pa.binary()),
                }
            )
            seen.clear()
            twins.clear()
            covered.clear()
            held = 0
            return out

        def add(key: bytes, row: tuple[int, int, int, int, int]) -> None:
            """Of equal segments of this batch the earliest is judged; all strings of a later one start earlier there.

            Another text of the same id has the same place, so none is earlier, and both are judged.
            """
            nonlocal held
            old = seen.setdefault(key, row)
            if old is row:
                held += len(key)
            elif (row[0], row[2]) < (old[0], old[2]):
                covered.append((*old[:4], old[0] ^ old[1]))
                seen[key] = row
            elif (row[0], row[2]) > (old[0], old[2]):
                covered.append((*row[:4], row[0] ^ row[1]))
            elif row[1] != old[1]:
                held += len(key)
                twins.append((key, row))

        for i, j, raw, at in _slabs(batch):
            lo, hi, h, row = anchors(raw, at, length, gram)
            mine = lists.slice(i, j - i)
            values = np.asarray(mine.flatten()).view(U)
            sizes = np.asarray(pa.compute.list_value_length(mine))
            own = np.repeat(np.arange(j - i), sizes)
            salt = U(0x9E3779B97F4A7C15)
            keep = np.isin(h ^ mix(row.astype(U) * salt), values ^ mix(own.astype(U) * salt))
            hot_values = np.asarray(many.slice(i, j - i).flatten()).view(U)
            hot = np.isin(h, hot_values) if len(hot_values) else np.zeros(len(h), bool)
            data = raw.tobytes()
            docs, hashes = k[i:j].tolist(), th[i:j].tolist()
            for a, b, x, r, w in zip(lo[keep].tolist(), hi[keep].tolist(), h[keep].view(np.int64).tolist(), row[keep].tolist(), hot[keep].tolist()):
                first = int(at[r])
                if w:
                    for p in range(a, b + 1):
                        s = data[p : p + length]
                        add(s, (docs[r], hashes[r], p - first, 1, int.from_bytes(hashlib.blake2b(s, digest_size=8).digest(), "little", signed=True)))
                else:
                    add(data[a : b + length], (docs[r], hashes[r], a - first, b - a + 1, x))
            if held > 16 << 20:
                yield flush()
        if seen or covered:
            yield flush()

    return f


def judge(segments: list[bytes], k: np.ndarray, th: np.ndarray, lo: np.ndarray, n: np.ndarray, length: int = LENGTH, shard: int = SHARD) -> tuple[np.ndarray, ...]:
    """Which strings start earlier elsewhere: runs (k, th, first start, last start).

    Segment i is text from byte lo[i] of a text of hash th[i] of document k[i]; its first n[i] bytes each start a string of ``length`` bytes.
    """
    gone: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
    best: dict[bytes, int] = {}
    kept: list[int] = []
    for i in np.lexsort((th, lo, k)).tolist():
        first = best.setdefault(segments[i], i)
        if k[first] != k[i] or lo[first] != lo[i]:
            gone.append((k[i : i + 1], th[i : i + 1], lo[i : i + 1], lo[i : i + 1] + n[i] - 1))
        elif first == i or th[first] != th[i]:
            kept.append(i)
    ids = np.array(kept, np.int64)
    sizes = [len(segments[i]) for i in ids]
    shards, total = [], 0
    classes, doc, hashes, pos = [], [], [], []
    for a, b in slabs(sizes, shard):
        part = ids[a:b]
        text = np.frombuffer(b"".join(segments[i] for i in part), np.uint8)
        off = np.cumsum([0] + sizes[a:b])[:-1]
        keys = packed(text)
        sa, _ = suffix_array(text, keys)
        m = n[part]
        step = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
        start = np.repeat(off, m) + step
        heads = np.zeros(len(text), bool)
        heads[start] = True
        order, lcp = common_prefixes(text, sa, heads, keys)
        group = np.empty(len(text), np.int64)
        group[order] = np.cumsum(lcp < length)  # equal for strings with a common prefix of that length
        group = group[start]
        values, first, group = np.unique(group, return_index=True, return_inverse=True)
        heads = start[first]  # sorted as the suffixes are
        name = np.full(len(heads), -1, np.int64)
        for other_keys, other_heads, names in shards:
            open_ = np.flatnonzero(name < 0)
            hit = find(other_keys, other_heads, keys, heads[open_], length)
            name[open_[hit >= 0]] = names[hit[hit >= 0]]
        fresh = np.flatnonzero(name < 0)
        name[fresh] = total + np.arange(len(fresh))
        total += len(fresh)
        if b < len(ids):
            shards.append((keys, heads[fresh], name[fresh]))
        classes.append(name[group])
        doc.append(np.repeat(k[part], m))
        hashes.append(np.repeat(th[part], m))
        pos.append(np.repeat(lo[part], m) + step)
    if classes:
        c, d, t, p = map(np.concatenate, (classes, doc, hashes, pos))
        order = np.lexsort((p, d, c))
        oc, od, ot, op = c[order], d[order], t[order], p[order]
        head = np.ones(len(order), bool)
        head[1:] = oc[1:] != oc[:-1]
        chief = np.flatnonzero(head)[np.cumsum(head) - 1]
        later = (od != od[chief]) | (op != op[chief])
        d, t, p = od[later], ot[later], op[later]
        order = np.lexsort((p, t, d))
        d, t, p = d[order], t[order], p[order]
        if len(d):
            cutting = np.ones(len(d), bool)
            cutting[1:] = (d[1:] != d[:-1]) | (t[1:] != t[:-1]) | (p[1:] > p[:-1] + 1)
            s = np.flatnonzero(cutting)
            gone.append((d[s], t[s], p[s], p[np.append(s[1:], len(d)) - 1]))
    if not gone:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    return tuple(np.concatenate(x) for x in zip(*gone))


def _judged(length: int, shard: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by anchor; shards end between anchors unless one anchor exceeds a shard."""
        held: list[pa.RecordBatch] = []
        size = 0

        def out(*runs: np.ndarray) -> pa.RecordBatch:
            return pa.record_batch({c: x.astype(np.int64) for c, x in zip(("k", "th", "a", "b"), runs)})

        def done(t: pa.Table) -> pa.RecordBatch:
            places = (np.asarray(t.column(c).combine_chunks()) for c in ("k", "th", "lo", "n"))
            return out(*judge(t.column("segment").to_pylist(), *places, length, shard))

        for batch in batches:
            if not batch.num_rows:
                continue
            plain = pa.compute.is_null(batch.column(batch.schema.get_field_index("segment")))
            t = batch.filter(plain)
            if t.num_rows:
                k, th, lo, n = (np.asarray(t.column(t.schema.get_field_index(c))) for c in ("k", "th", "lo", "n"))
                yield out(k, th, lo, lo + n - 1)
            t = batch.filter(pa.compute.invert(plain))
            if not t.num_rows:
                continue
            held.append(t)
            size += t.nbytes
            if size > shard:
                whole = pa.Table.from_batches(held)
                d = np.asarray(whole.column("d").combine_chunks())
                last = int(np.searchsorted(d, d[-1], "left"))
                if last:
                    yield done(whole.slice(0, last))
                    rest = whole.slice(last).combine_chunks()
                    held = [pa.RecordBatch.from_arrays([pa.concat_arrays(c.chunks) for c in rest.columns], schema=rest.schema)]
                    size = held[0].nbytes
        if held:
            yield done(pa.Table.from_batches(held))

    return run


def _finished(length: int):
    def f(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids, col, cov = batch.column(0), texts(batch), batch.column(batch.schema.get_field_index("gone"))
        n_bytes, n_removed, n_spans, kept, spans = [], [], [], [], []
        raw, at = buffers(col)
        data = memoryview(raw)
        for i, runs in enumerate(cov):
            text = data[at[i] : at[i + 1]]
            merged: list[list[int]] = []
            for x in sorted((r["a"], r["b"]) for r in (runs.as_py() or [])):
                if merged and x[0] <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], x[1] + length)
                else:
                    merged.append([x[0], x[1] + length])
            digest, end = hashlib.sha256(), 0
            for a, b in merged:
                digest.update(text[end:a])
                end = b
            digest.update(text[end:])
            n_bytes.append(len(text))
            n_removed.append(sum(b - a for a, b in merged))
            n_spans.append(len(merged))
            kept.append(digest.hexdigest())
            spans.append(merged)
        yield pa.record_batch(
            {
                "doc_id": ids,
                "n_bytes": pa.array(n_bytes, pa.int64()),
                "n_removed": pa.array(n_removed, pa.int64()),
                "n_spans": pa.array(n_spans, pa.int64()),
                "kept_sha256": pa.array(kept, pa.string()),
                "spans": pa.array(spans, pa.list_(pa.list_(pa.int64()))),
            }
        )

    return f


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT, shard: int = SHARD) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (byte ranges to remove) for every row of ``docs``.

    ``docs`` needs doc_id (of any type that sorts) and text; further columns are left alone. Null text is empty. Rows with a null
    doc_id come before all others and count as one document, as do rows that repeat a doc_id: of those, text from an earlier
    byte is earlier, and none of them is earlier than another at the same byte. Texts under ``length`` bytes have no span. An empty table gives no rows.
    """
    d = ordinal(only(docs, "doc_id", "text"), "doc_id", "k").select(F.coalesce("k", F.lit(-(2**63))).alias("k"), F.xxhash64("text").alias("th"), "doc_id", "text")
    counts = map_arrow(d.select("text"), "h long, n long", _counted(length, gram)).groupBy("h").agg(F.sum("n").alias("n")).where("n > 1")
    counts = cut(counts)
    # the hash of the text in the key tells the texts of one id (or of none) apart, so that no id gathers many
    found = map_arrow(d.select("k", "th", "text"), "h long, k long, th long", _listed(length, gram)).join(counts, "h")
    lists = found.groupBy("k", "th").agg(F.collect_set("h").alias("anchors"), F.collect_set(F.expr(f"if(n > {int(hot)}, h, null)")).alias("hot"))
    lists = cut(lists)
    parts = map_arrow(d.join(lists, ["k", "th"]).select("k", "th", "text", "anchors", "hot"), "k long, th long, lo long, n long, d long, segment binary", _segments(length, gram))
    gone = parts.repartition("d").sortWithinPartitions("d").mapInArrow(_judged(length, shard), "k long, th long, a long, b long")
    gone = cut(gone.groupBy("k", "th").agg(F.collect_set(F.struct("a", "b")).alias("gone")))
    return map_arrow(
        d.join(gone, ["k", "th"], "left").select("doc_id", "text", "gone"),
        typed(d, "doc_id", "n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<array<long>>"),
        _finished(length),
    )


def op8_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """Operator 8 over all documents: strings of 100 bytes that start earlier are removed."""
    return repeated_spans(table(spark, sf_dir, "documents")).drop("spans")


#: Documents have different ids here. Every string of LENGTH bytes is a row; of equal ones the first by (doc_id, place) stays.
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, encode(coalesce(text, '')) AS b FROM documents),
w AS (SELECT rid, doc_id, p, b[p:p + {LENGTH - 1}] AS s FROM d, unnest(range(1, octet_length(b) - {LENGTH - 2})) AS u(p)),
f AS (SELECT rid, p, row_number() OVER (PARTITION BY s ORDER BY doc_id NULLS FIRST, p) AS r FROM w),
g AS (SELECT rid, p, CASE WHEN p <= lag(p) OVER (PARTITION BY rid ORDER BY p) + {LENGTH} THEN 0 ELSE 1 END AS fresh FROM f WHERE r > 1),
h AS (SELECT rid, p, sum(fresh) OVER (PARTITION BY rid ORDER BY p) AS run FROM g),
runs AS (SELECT rid, min(p) AS a, max(p) + {LENGTH} AS z FROM h GROUP BY rid, run),
gaps AS (SELECT rid, coalesce(lag(z) OVER (PARTITION BY rid ORDER BY a), 1) AS a, a - 1 AS z FROM runs UNION ALL SELECT rid, max(z), 2147483647 FROM runs GROUP BY rid),
kept AS (SELECT rid, list_reduce(list(b[gaps.a:least(gaps.z, octet_length(b))] ORDER BY gaps.a), lambda x, y: x || y) AS k FROM gaps JOIN d USING (rid) GROUP BY rid),
s AS (SELECT rid, sum(z - a)::BIGINT AS n_removed, count(*) AS n_spans FROM runs GROUP BY rid)
SELECT doc_id, octet_length(b)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(coalesce(k, b)) AS kept_sha256
FROM d LEFT JOIN s USING (rid) LEFT JOIN kept USING (rid)
"""
