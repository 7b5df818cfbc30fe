"""Toxicity by multiple-instance learning (operator 7).

A text is a bag of sentences. Sentence s has p(s) = sigmoid(b + sum of the weights of its words and their beginnings), the text 1 - prod(1 - p(s))
(noisy-or). Only texts have labels; the gradient through the noisy-or tells sentences apart, which then locates
the offending ones.

The fit takes a bounded sample of labelled rows: ``SAMPLE`` a class, expected, of texts up to ``LONGEST`` bytes, and ``SAMPLE_BYTES`` of
text in all, expected. Executors count words by class and keep those whose shares differ beyond chance (``LEAST_Z``),
``WORDS`` at most; only those come to the driver. The penalty on weights is the one of ``PENALTIES`` that predicts a
fold of the sample best, so that wrong labels are not learned by heart.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bytes import U, bounds, buffers, hash_spans, mix
from ._spark import map_arrow, only, slabs, table, texts, typed
from .language_id import held_out

SAMPLE = 5000
SAMPLE_BYTES = 64 << 20
LONGEST = 1 << 20
WORDS = 4096
#: Documents that a word must be in, and standard errors that its shares in both classes must differ by.
LEAST_DOCS, LEAST_Z = 8, 4.0
PENALTIES = (1e-5, 3e-5, 1e-4, 3e-4, 1e-3, 1e-2)
FOLDS = 5
#: Lengths of beginnings of words, in bytes.
STEMS = (5, 6, 7, 8)
STEPS = 300
_END = np.zeros(256, bool)
_END[[ord(c) for c in ".!?\n"]] = True


def features(raw: np.ndarray, s: np.ndarray, e: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and of the beginnings (``STEMS`` bytes) of longer ones, with the sentence of each, by sentence.

    Beginnings stand for words that are inflected or compounded, each form of which is rare.
    """
    found, of = [hash_spans(raw, s, e)], [own]
    for n in STEMS:
        long = np.flatnonzero(e - s > n)
        found.append(mix(hash_spans(raw, s[long], s[long] + n) + U(n)))
        of.append(own[long])
    h, of = np.concatenate(found), np.concatenate(of)
    order = np.argsort(of, kind="stable")
    return h[order], of[order]


def sentences(col: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, rows, hashes of words and their beginnings, each one's sentence, sentence's row, sentence bounds in bytes of the row).

    A sentence ends after ``.``, ``!``, ``?`` or a line end, or with the text; stretches without a word are no sentences.
    """
    raw_all, at = buffers(pc.utf8_lower(col))
    for i, j in slabs(np.diff(at).tolist()):
        raw, off = raw_all[at[i] : at[j]], at[i : j + 1] - at[i]
        s, e = bounds(raw, off)
        stop = _END[raw]
        stop[off[1:][off[1:] > off[:-1]] - 1] = True
        place = np.concatenate(([0], np.cumsum(stop)))[s]  # sentence number of each word, with gaps
        edges = np.concatenate(([0], np.flatnonzero(stop) + 1))
        number, own = np.unique(place, return_inverse=True)
        a = edges[number]
        b = np.append(edges, len(raw))[number + 1]
        row = np.searchsorted(off, a, "right") - 1
        h, of = features(raw, s, e, own)
        yield i, j - i, h, of, row, np.stack((a - off[row], b - off[row]), axis=1)


@dataclass
class Model:
    """Sorted word hashes, their weights, and the bias."""

    words: np.ndarray
    weights: np.ndarray
    bias: float

    def place(self, h: np.ndarray) -> np.ndarray:
        """Each hash's index among the words, or -1."""
        if not len(self.words):
            return np.full(len(h), -1)
        i = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
        return np.where(self.words[i] == h, i, -1)


def fit(own: np.ndarray, word: np.ndarray, bag: np.ndarray, y: np.ndarray, weight: np.ndarray, n_words: int, penalty: float = 1e-5, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Weights and bias by Adam on the noisy-or likelihood less ``penalty`` times half the weights' squares.

    Entry e is word[e] of sentence own[e], sentence s is in bag[s].
    """
    w, b = np.zeros(n_words), -4.0
    m1, m2 = np.zeros(n_words + 1), np.zeros(n_words + 1)
    total = weight.sum()
    for t in range(1, steps + 1):
        z = b + np.bincount(own, w[word], minlength=len(bag))
        soft = np.logaddexp(0, z)
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        s = np.maximum(np.bincount(bag, soft, minlength=len(y)), 1e-9)
        pull = np.where(y > 0, -1 / np.expm1(np.minimum(s, 50)), 1.0) * weight / total
        dz = p * pull[bag]
        g = np.append(np.bincount(word, dz[own], minlength=n_words) + penalty * w, dz.sum())
        m1 = 0.9 * m1 + 0.1 * g
        m2 = 0.999 * m2 + 0.001 * g * g
        step = 0.1 * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.999**t)) + 1e-10)
        w -= step[:-1]
        b -= step[-1]
    return w, float(b)


def loss(w: np.ndarray, b: float, own: np.ndarray, word: np.ndarray, bag: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The weighted mean of the noisy-or's logarithmic loss."""
    soft = np.logaddexp(0, b + np.bincount(own, w[word], minlength=len(bag)))
    s = np.maximum(np.bincount(bag, soft, minlength=len(y)), 1e-9)
    return float((np.where(y > 0, -np.log(-np.expm1(-s)), s) * weight).sum() / weight.sum())


def _part(rows: np.ndarray, own: np.ndarray, word: np.ndarray, bag: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, ...]:
    """The entries, bags and labels of some rows (a mask), numbered anew."""
    of = np.cumsum(rows) - 1
    held = rows[bag]
    number = np.cumsum(held) - 1
    keep = held[own]
    return number[own[keep]], word[keep], of[bag[held]], y[rows], weight[rows]


def tuned(own: np.ndarray, word: np.ndarray, bag: np.ndarray, y: np.ndarray, weight: np.ndarray, n_words: int, fold: np.ndarray) -> tuple[np.ndarray, float]:
    """``fit`` with the penalty that predicts fold 0 best from the others (of equals the largest)."""
    test = fold == 0
    best = PENALTIES[-1]
    if all((y[test] == c).any() and (y[~test] == c).any() for c in (0, 1)):
        rest, held = (_part(m, own, word, bag, y, weight) for m in (~test, test))
        found = {p: loss(*fit(*rest, n_words, p), *held) for p in PENALTIES}
        best = min(reversed(PENALTIES), key=lambda p: found[p])
    return fit(own, word, bag, y, weight, n_words, best)


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, n_words: int = WORDS) -> Model:
    """Fit on labelled rows that are not held out; a doc_id with several labels counts as toxic if any says so."""
    lab = only(labels, "doc_id", "toxic").where("doc_id is not null and toxic is not null").where(~held_out(5, 0))
    lab = lab.groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("y"))
    many = {r.y: r.n for r in lab.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not many.get(0) or not many.get(1):
        return Model(np.zeros(0, U), np.zeros(0), 20.0 if many.get(1) else -20.0)
    part = F.when(F.col("y") == 1, min(1.0, sample / many[1])).otherwise(min(1.0, sample / many[0]))
    chosen = lab.where(F.pmod(F.xxhash64("doc_id", F.lit("toxicity")), F.lit(1 << 30)) < part * (1 << 30))
    bags = only(docs, "doc_id", "text").join(F.broadcast(chosen), "doc_id")  # about 2 * sample rows of two numbers
    size = F.octet_length("text")
    bags = bags.select("doc_id", "text", "y", F.xxhash64("doc_id", "text", F.lit("fold")).alias("key")).where(size <= LONGEST)
    held = bags.agg(F.sum(size)).first()[0] or 0
    bags = bags.where(F.pmod("key", F.lit(1 << 30)) < min(1.0, SAMPLE_BYTES / max(held, 1)) * (1 << 30)).persist()
    seen = {r.y: r.n for r in bags.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not seen.get(0) or not seen.get(1):
        return Model(np.zeros(0, U), np.zeros(0), 20.0 if seen.get(1) else -20.0)

    def counted(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        y = np.asarray(batch.column(batch.schema.get_field_index("y")))
        for i, n, h, own, row, _ in sentences(texts(batch)):
            r = row[own]
            order = np.lexsort((h, r))
            h, r = h[order], r[order]
            first = np.ones(len(h), bool)
            first[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
            h, r = h[first], y[i + r[first]]
            v, inv = np.unique(h, return_inverse=True)
            one = np.bincount(inv, r, minlength=len(v)).astype(np.int64)
            yield pa.record_batch({"h": v.view(np.int64), "n1": one, "n0": np.bincount(inv, minlength=len(v)) - one})

    c = map_arrow(bags, "h long, n1 long, n0 long", counted).groupBy("h").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
    n1, n0 = F.lit(float(seen[1])), F.lit(float(seen[0]))
    p = (F.col("n1") + F.col("n0") + 1) / (n1 + n0 + 2)
    z = F.abs(F.col("n1") / n1 - F.col("n0") / n0) / F.sqrt(p * (1 - p) * (1 / n1 + 1 / n0))
    top = c.where(F.col("n1") + F.col("n0") >= LEAST_DOCS).select("h", z.alias("z")).where(F.col("z") >= LEAST_Z).orderBy(F.desc("z"), "h").limit(n_words).collect()
    words = np.sort(np.array([r.h for r in top], np.int64).view(U))
    model = Model(words, np.zeros(len(words)), 0.0)

    def entries(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """Of each text: label, number of sentences, and (sentence, word) of the chosen words."""
        y, key = (np.asarray(batch.column(batch.schema.get_field_index(c))) for c in ("y", "key"))
        for i, n, h, own, row, _ in sentences(texts(batch)):
            size = np.bincount(row, minlength=n)
            w = model.place(h)
            keep = w >= 0
            local = own[keep] - (np.cumsum(size) - size)[row[own[keep]]]
            edge = np.searchsorted(row[own[keep]], np.arange(n + 1)).astype(np.int32)
            yield pa.record_batch(
                {
                    "key": key[i : i + n],
                    "y": y[i : i + n].astype(np.int64),
                    "n": size.astype(np.int64),
                    "s": pa.ListArray.from_arrays(edge, local.astype(np.int32)),
                    "w": pa.ListArray.from_arrays(edge, w[keep].astype(np.int32)),
                }
            )

    rows = map_arrow(bags, "key long, y long, n long, s array<int>, w array<int>", entries).toArrow().sort_by("key")
    bags.unpersist()
    fold = np.asarray(rows["key"].combine_chunks()) // FOLDS % FOLDS
    y, n = np.asarray(rows["y"].combine_chunks()), np.asarray(rows["n"].combine_chunks())
    bag = np.repeat(np.arange(len(y)), n)
    lists = rows["s"].combine_chunks()
    size = np.asarray(pc.list_value_length(lists))
    own = np.asarray(lists.flatten()).astype(np.int64) + np.repeat(np.cumsum(n) - n, size)
    word = np.asarray(rows["w"].combine_chunks().flatten()).astype(np.int64)
    w, b = tuned(own, word, bag, y, np.where(y > 0, many[1] / seen[1], many[0] / seen[0]), len(words), fold)
    return Model(words, w, b)


def score(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """doc_id, score, predicted, and offending: the byte ranges of sentences of p >= ``threshold``, or of the worst one
    where the text is predicted toxic and none reaches it.

    Null, empty and word-less texts have no sentence: score 0. doc_id can have any type. An empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def f(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for i, n, h, own, row, span in sentences(texts(batch)):
            w = m.place(h)
            z = m.bias + np.bincount(own[w >= 0], m.weights[w[w >= 0]], minlength=len(row))
            total = -np.expm1(-np.bincount(row, np.logaddexp(0, z), minlength=n))
            edge = np.searchsorted(row, np.arange(n + 1))
            bad: list[list[list[int]]] = []
            for r in range(n):
                mine = z[edge[r] : edge[r + 1]]
                hit = np.flatnonzero(mine >= np.log(threshold / (1 - threshold)))
                if total[r] >= 0.5 and not len(hit):
                    hit = [int(mine.argmax())]
                bad.append(span[edge[r] : edge[r + 1]][hit].tolist() if len(hit) else [])
            yield pa.record_batch(
                {"doc_id": batch.column(0).slice(i, n), "score": total, "predicted": (total >= 0.5).astype(np.int32), "offending": pa.array(bad, pa.list_(pa.list_(pa.int64())))}
            )

    rows = only(docs, "doc_id", "text")
    return map_arrow(rows, typed(rows, "doc_id", "score double, predicted int, offending array<array<long>>"), f)


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    """Operator 7 over all documents."""
    docs = table(spark, sf_dir, "documents")
    got = score(docs, learn(docs, table(spark, sf_dir, "labels")))
    return got.select("doc_id", held_out(5, 0).alias("held_out"), "score", "predicted", F.size("offending").alias("n_offending"))
