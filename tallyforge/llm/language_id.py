"""Language identification with n-gram filters of language bitmasks (operator 3).

One bit-sliced Bloom filter answers for all languages at once: a slot holds a bitmask of languages, and the AND
of an n-gram's slots is the set of languages whose filter contains the n-gram. A text's counts per language are
corrected for each filter's rate of false positives; the largest wins.

The filters are learned from a bounded sample of labelled rows (``sample`` a language, expected), whose n-grams are
counted on the executors; at most ``grams`` n-grams a language come to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._bytes import U, buffers, mix
from ._spark import map_arrow, only, slabs, table, texts

SAMPLE = 1500
GRAMS = 40_000
SLOTS = 1 << 20
HASHES = 3
#: An n-gram belongs to a language if it is at least so frequent there against the language where it is most frequent.
SHARE = 0.1
SPACE = 32
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[[b for b in range(128) if not chr(b).isalpha()]] = SPACE
_ASCII = np.zeros(256, bool)
_ASCII[[b for b in range(128) if chr(b).isalpha()]] = True


def grams(col: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, 4-byte n-grams, where each row's begin) of lower-cased texts whose non-letters are single spaces."""
    padded = pc.binary_join_element_wise(" ", pc.utf8_lower(col), " ", "")
    raw, at = buffers(padded)
    for i, j in slabs(np.diff(at).tolist()):
        part, off = _FOLD[raw[at[i] : at[j]]], at[i : j + 1] - at[i]
        space = part == SPACE
        keep = np.ones(len(part), bool)
        keep[1:] = ~(space[1:] & space[:-1])
        keep[off[:-1]] = True
        off = np.concatenate(([0], np.cumsum(keep)))[off]
        part = part[keep].astype(np.uint32)
        m = max(0, len(part) - 3)
        g = (part[:m] << np.uint32(24)) | (part[1 : m + 1] << np.uint32(16)) | (part[2 : m + 2] << np.uint32(8)) | part[3 : m + 3]
        inside = np.ones(m, bool)
        for e in off[1:-1]:
            inside[max(0, e - 3) : e] = False
        first = np.concatenate(([0], np.cumsum(inside)))[np.minimum(off, m)]
        yield i, j - i, g[inside], first


@dataclass
class Filters:
    """Bit-sliced filters of all languages: ``planes[p][slot]`` has bit b for language 64 * p + b."""

    langs: list[str]
    planes: np.ndarray
    wrong: np.ndarray
    common: str

    @staticmethod
    def slots(g: np.ndarray, slots: int = SLOTS) -> Iterator[np.ndarray]:
        h = mix(g.astype(U) + U(1))
        for i in range(HASHES):
            yield ((h >> U(20 * i)) & U(slots - 1)).astype(np.int64)

    @classmethod
    def build(cls, found: list[tuple[str, int]], common: str) -> Filters:
        """From (language, n-gram) pairs."""
        langs = sorted({x for x, _ in found})
        planes = np.zeros((-(-len(langs) // 64) or 1, SLOTS), np.uint8 if len(langs) <= 8 else U)
        wrong = np.zeros(len(langs))
        for n, lang in enumerate(langs):
            g = np.array([x for y, x in found if y == lang], np.int64).astype(np.uint32)
            plane, bit = planes[n // 64], planes.dtype.type(1 << n % 64)
            for s in cls.slots(g):
                plane[s] |= bit
            wrong[n] = (np.count_nonzero(plane & bit) / SLOTS) ** HASHES
        return cls(langs, planes, wrong, common)

    def counts(self, g: np.ndarray, first: np.ndarray) -> np.ndarray:
        """For each row and language how many n-grams its filter contains."""
        out = np.zeros((len(first) - 1, len(self.langs)), np.int64)
        slots = list(self.slots(g))
        for p, plane in enumerate(self.planes):
            mask = plane[slots[0]]
            for s in slots[1:]:
                mask &= plane[s]
            for n in range(64 * p, min(len(self.langs), 64 * p + 64)):
                hit = np.concatenate(([0], np.cumsum((mask >> mask.dtype.type(n % 64)) & mask.dtype.type(1), dtype=np.int64)))
                out[:, n] = hit[first[1:]] - hit[first[:-1]]
        return out

    def predict(self, col: pa.Array) -> tuple[list[str], list[float]]:
        """Language and score of each text."""
        names, scores = [], []
        for i, n, g, first in grams(col):
            many = np.diff(first)
            got = self.counts(g, first)
            fair = (got - many[:, None] * self.wrong) / (1 - self.wrong)
            best = fair.argmax(axis=1) if len(self.langs) else np.zeros(n, np.int64)
            top = fair[np.arange(n), best] if len(self.langs) else np.zeros(n)
            score = np.clip(top / np.maximum(many, 1), 0, 1)
            raw, at = buffers(col.slice(i, n))
            letters = np.concatenate(([0], np.cumsum(_ASCII[raw])))
            plain = letters[at[1:]] > letters[at[:-1]]
            for r in range(n):
                if not self.langs or not plain[r] and not any(c.isalpha() for c in col[i + r].as_py()):
                    names.append("und")
                    scores.append(0.0)
                else:
                    names.append(self.langs[best[r]] if top[r] > 0 else self.common)
                    scores.append(float(score[r]))
        return names, scores


def held_out(mod: int, rest: int):
    """Whether crc32(doc_id as text) leaves ``rest``; a row without doc_id is not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % mod == rest, F.lit(False))


def learn(docs: DataFrame, sample: int = SAMPLE, top: int = GRAMS) -> Filters:
    """Filters from text and lang of rows that are not held out; rows without doc_id, text or lang teach nothing."""
    rows = only(docs, "doc_id", "text", "lang").where("doc_id is not null and text is not null and lang is not null").where(~held_out(4, 2))
    many = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not many:
        return Filters.build([], "und")
    part = F.lit(0)
    for lang, n in many.items():
        part = F.when(F.col("lang") == lang, F.lit(min(1.0, sample / n))).otherwise(part)
    chosen = rows.where(F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(1 << 30)) < part * (1 << 30))

    def counted(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        lang = batch.column(batch.schema.get_field_index("lang"))
        for i, n, g, first in grams(texts(batch)):
            own = np.repeat(np.arange(n), np.diff(first))
            for name in set(lang.slice(i, n).to_pylist()):
                mine = np.asarray(pc.equal(lang.slice(i, n), name))
                v, c = np.unique(g[mine[own]], return_counts=True)
                yield pa.record_batch({"lang": pa.array([name] * len(v), pa.string()), "g": v.astype(np.int64), "c": c.astype(np.int64)})

    c = map_arrow(chosen.select("text", "lang"), "lang string, g long, c long", counted).groupBy("lang", "g").agg(F.sum("c").alias("c"))
    share = c.withColumn("p", F.col("c") / F.sum("c").over(Window.partitionBy("lang")))
    share = share.withColumn("most", F.max("p").over(Window.partitionBy("g"))).where((F.col("c") > 1) & (F.col("p") >= SHARE * F.col("most")))
    best = share.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("c"), "g"))).where(F.col("r") <= top)
    found = [(r.lang, r.g) for r in best.select("lang", "g").collect()]
    return Filters.build(found, max(sorted(many), key=lambda x: many[x]))


def identify(docs: DataFrame, filters: Filters) -> DataFrame:
    """``docs`` with lang_pred and lang_score from the whole text alone; columns of these names in ``docs`` are left out.

    lang_pred is ``und`` with score 0 for a text that is null, empty or without a letter; a text with letters but
    none of the learned n-grams gets the most frequent language, with score 0. Equal counts: the first language by name.
    """
    model = docs.sparkSession.sparkContext.broadcast(filters)
    fields = [x for x in docs.schema.fields if x.name not in ("lang_pred", "lang_score")]
    names = [x.name for x in fields]

    def f(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        langs, scores = model.value.predict(texts(batch))
        cols = [batch.column(batch.schema.get_field_index(c)) for c in names]
        yield pa.RecordBatch.from_arrays([*cols, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*names, "lang_pred", "lang_score"])

    return map_arrow(docs, T.StructType(fields).add("lang_pred", "string").add("lang_score", "double"), f)


def of_known_language(docs: DataFrame, filters: Filters, least: float) -> DataFrame:
    """``docs`` without texts that ``identify`` calls ``und`` or scores under ``least``; all columns stay as they are."""
    model = docs.sparkSession.sparkContext.broadcast(filters)

    def f(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        langs, scores = model.value.predict(texts(batch))
        yield batch.filter(pa.array([x != "und" and s >= least for x, s in zip(langs, scores)], pa.bool_()))

    return map_arrow(docs, T.StructType(docs.schema.fields), f)


def op3_language_id(spark, sf_dir: str) -> DataFrame:
    """Operator 3 over all documents."""
    docs = table(spark, sf_dir, "documents")
    got = identify(only(docs, "doc_id", "text"), learn(docs))
    return got.select("doc_id", held_out(4, 2).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
