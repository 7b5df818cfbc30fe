"""N-gram Jaccard join by MinHash banding (operator 5).

1. Each text becomes its set of 64-bit hashes of word 5-grams (see ``_bytes``). Texts of equal sets are one class
   from here on, with a weight, so exact copies never meet in pairs.
2. ``choose_bands`` takes the most rows a band for which the target recall is reached; each class goes to
   one bucket a band. A bucket gives a star around its least node, not its pairs.
3. ``units`` says what is verified together. A component of the stars that fits one block is one unit. In a larger one each
   bucket is a unit (buckets of the same members once), so a chain of many classes costs what its buckets cost, and
   a pair belongs to the first band that it shares.
4. Units are verified on the full sets, in blocks bounded by classes and by bytes: block pairs are dealt over tasks, and
   a block pair is one sparse product.
5. Link counts are summed by class; the links' components are the classes of near duplicates.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bytes import U, bounds, buffers, hash_spans, mix, owners, shingles
from ._spark import cut, dealt_anew, map_arrow, only, slabs, table, texts, typed
from .components import connected_components

THRESHOLD = 0.8
SIZE = 5
RECALL = 0.9999
#: Classes that one task compares with as many others, and bytes of their sets (a larger set stands alone in expectation).
BLOCK = 128
BLOCK_BYTES = 1 << 26
#: Shared n-grams taken into one product.
COLUMNS = 4096


def choose_bands(threshold: float = THRESHOLD, recall: float = RECALL, most: int = 192) -> tuple[int, int]:
    """(bands, rows): the steepest banding that finds a pair at the threshold with the wanted probability."""
    best = None
    for rows in range(1, most + 1):
        p = threshold**rows
        bands = 1 if p >= 1 else math.ceil(math.log(1 - recall) / math.log1p(-p))
        if bands * rows <= most:
            best = bands, rows
    if best is None:
        raise ValueError("no banding of so few hashes reaches this recall")
    return best


def gram_sets(col: pa.Array, size: int = SIZE) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, sorted distinct n-gram hashes of each row) for stretches of a text column.

    Words are runs of letters, digits, underscores and non-ASCII characters in lower case; a text of fewer than
    ``size`` words has one n-gram of all its words, one without words has none.
    """
    raw, at = buffers(pc.utf8_lower(col))
    for i, j in slabs(np.diff(at).tolist()):
        part, off = raw[at[i] : at[j]], at[i : j + 1] - at[i]
        s, e = bounds(part, off)
        h, row = shingles(hash_spans(part, s, e), owners(s, off), j - i, size)
        edge = np.searchsorted(row, np.arange(j - i + 1))
        yield i, [np.unique(h[a:b]) for a, b in zip(edge[:-1], edge[1:])]


def _signed(bands: int, rows: int, size: int):
    mults = (mix(np.arange(1, bands * rows + 1, dtype=U)) >> U(32)).astype(np.uint32) | np.uint32(1)

    def f(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        col = texts(batch)
        keys, counts, found = [], [], []
        for _, sets in gram_sets(col, size):
            many = np.array([len(x) for x in sets])
            some = np.flatnonzero(many)
            key = np.zeros((len(sets), 2), U)
            band = np.zeros((len(sets), bands), U)
            if len(some):
                flat = np.concatenate([sets[i] for i in some])
                start = np.cumsum(many[some]) - many[some]
                key[some, 0] = np.add.reduceat(mix(flat), start)
                key[some, 1] = np.bitwise_xor.reduceat(mix(flat * U(0xD6E8FEB86659FD93) + U(1)), start)
                short = (flat >> U(32)).astype(np.uint32)
                for b in range(bands):
                    acc = np.full(len(some), b + 1, U)
                    for m in mults[b * rows : (b + 1) * rows]:
                        acc = mix(acc + np.minimum.reduceat(short * m, start).astype(U))
                    band[some, b] = acc
            keys.append(key)
            counts.append(many)
            found.append(band)
        key, n, band = np.concatenate(keys), np.concatenate(counts), np.concatenate(found)
        lists = pa.ListArray.from_arrays(np.arange(0, band.size + 1, bands, dtype=np.int32), band.ravel().view(np.int64))
        yield pa.record_batch(
            {"k": batch.column(0), "th": batch.column(1), "c1": key[:, 0].copy().view(np.int64), "c2": key[:, 1].copy().view(np.int64), "n": n.astype(np.int64), "bands": lists}
        )

    return f


def _with_sets(size: int):
    def f(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for i, sets in gram_sets(texts(batch), size):
            part = batch.slice(i, len(sets)).drop_columns(["text"])
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array([x.tobytes() for x in sets], pa.binary())], names=[*part.schema.names, "grams"])

    return f


def links(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, threshold: float) -> np.ndarray:
    """Which of the sets ``left`` and ``right`` (indexes) have that Jaccard similarity, as a matrix."""
    sizes = np.array([len(x) for x in sets])
    flat, own = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(flat)
    flat, own = flat[order], own[order]
    new = np.ones(len(flat), bool)
    new[1:] = flat[1:] != flat[:-1]
    col = np.cumsum(new) - 1
    shared = np.bincount(col) > 1
    col = (np.cumsum(shared) - 1)[col][keep] if (keep := shared[col]).any() else np.zeros(0, np.int64)
    own = own[keep]
    both = np.zeros((len(left), len(right)), np.float64)
    edge = np.searchsorted(col, np.arange(0, int(col[-1]) + 1 + COLUMNS, COLUMNS)) if len(col) else []
    for n, (a, b) in enumerate(zip(edge[:-1], edge[1:])):
        x = np.zeros((len(sets), COLUMNS), np.float32)
        x[own[a:b], col[a:b] - n * COLUMNS] = 1
        both += x[left] @ x[right].T
    union = sizes[left][:, None] + sizes[right][None, :] - both
    return both >= threshold * union - 1e-9


def _compared(threshold: float):
    def judged(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        """Links of one block pair: each node's linked weight, and the least node that it hangs together with here."""
        t = pa.Table.from_batches(batches)
        column = lambda c: np.asarray(t.column(c).combine_chunks())
        node, first = np.unique(column("node"), return_index=True)  # a text that is repeated comes once for each copy
        w, block = column("w")[first], column("block")[first]
        i, j, band = (t.column(c)[0].as_py() for c in ("i", "j", "b"))
        sets = [np.frombuffer(t.column("grams")[int(x)].as_buffer(), U) for x in first]
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        near = links(sets, left, right, threshold) if len(left) and len(right) else np.zeros((len(left), len(right)), bool)
        if band > 0 and near.any():  # pairs that share an earlier band belong to that one's bucket
            bands = np.array([t.column("bands")[int(x)].as_py()[:band] for x in first], np.int64)
            x, y = np.nonzero(near)
            near[x, y] = ~(bands[left[x]] == bands[right[y]]).any(axis=1)
        adj = np.zeros((len(node), len(node)), bool)
        adj[np.ix_(left, right)] = near
        adj |= adj.T
        np.fill_diagonal(adj, False)
        linked = adj @ w
        root = node.copy()
        todo = linked > 0
        while todo.any():
            group = np.zeros(len(node), bool)
            group[np.flatnonzero(todo)[0]] = True
            front = group.copy()
            while front.any():
                front = adj[front].any(axis=0) & ~group
                group |= front
            root[group] = node[group].min()
            todo &= ~group
        got = np.flatnonzero(linked > 0)
        return pa.record_batch({"node": node[got], "links": linked[got].astype(np.int64), "root": root[got]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by unit and block pair."""
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([np.asarray(batch.column(batch.schema.get_field_index(c))) for c in ("b", "unit", "i", "j")], axis=1)
            edge = np.concatenate(([0], np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1, [len(keys)]))
            for x, y in zip(edge[:-1].tolist(), edge[1:].tolist()):
                own = tuple(keys[x].tolist())
                if own != last and held:
                    yield judged(held)
                    held = []
                held.append(batch.slice(x, y - x))
                last = own
        if held:
            yield judged(held)

    return run


def units(cls: DataFrame, comp: DataFrame, block: int = BLOCK) -> DataFrame:
    """(node, b, unit, blocks): what is verified together, of classes (node, n, bands) and their components (node, component).

    A component of one block has b = -1. In a larger one, a bucket of band b is a unit; of buckets of the same members, the first.
    """
    blocks = lambda many, size: F.greatest(F.ceil(many / F.lit(block)), F.ceil(size * 8 / F.lit(BLOCK_BYTES)))
    sized = comp.join(cls.select("node", "n"), "node")
    of = dealt_anew(sized.groupBy("component").agg(blocks(F.count("*"), F.sum("n")).alias("blocks")), "component")
    sized = cut(comp.join(of, "component"))
    whole = sized.where("blocks = 1").select("node", F.lit(-1).alias("b"), F.col("component").alias("unit"), "blocks")
    dealt = cls.join(sized.where("blocks > 1").select("node"), "node").select("node", "n", F.posexplode("bands").alias("b", "band"))
    members = [F.min("node").alias("low"), F.count("*").alias("many"), F.bit_xor(F.xxhash64("node")).alias("s1"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("s2")]
    buckets = dealt.groupBy("band").agg(F.min("b").alias("b"), *members, F.sum("n").alias("size")).where("many > 1")
    buckets = buckets.groupBy("low", "many", "s1", "s2").agg(F.min(F.struct("b", "band", blocks(F.col("many"), F.col("size")).alias("blocks"))).alias("x")).select("x.band", "x.blocks")
    return whole.unionByName(dealt.join(dealt_anew(buckets, "band"), "band").select("node", "b", F.col("band").alias("unit"), "blocks"))


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, size: int = SIZE, recall: float = RECALL, block: int = BLOCK, nodes: bool = False) -> DataFrame:
    """doc_id, class_id, n_links, and th (the text's xxhash64) for every row of ``docs`` (doc_id of any type that sorts, text; others are left alone).

    n_links counts the other rows of n-gram Jaccard similarity ``threshold`` or more; class_id is the least doc_id
    that links lead to. Texts without words (null and empty ones too) have no n-grams: no links, and their own doc_id
    as class. A null doc_id sorts last; a class whose rows all lack one has a null class_id. Repeated
    rows link to each other. An empty table gives no rows. With ``nodes``, also component, which tells classes of one class_id
    apart (null for texts without words).
    """
    d = only(docs, "doc_id", "text").select(F.col("doc_id").alias("k"), F.xxhash64("text").alias("th"), "text")
    sig = cut(map_arrow(d, typed(d, "k", "th long, c1 long, c2 long, n long, bands array<long>"), _signed(*choose_bands(threshold, recall), size)))
    some = sig.where("n > 0")
    cls = some.groupBy("c1", "c2", "n").agg(F.min("k").alias("least"), F.min(F.struct("k", "th", "bands")).alias("rep"), F.count("*").alias("w"))
    cls = cut(cls.select("c1", "c2", "n", "w", "least", "rep.*").withColumn("node", F.monotonically_increasing_id()))
    dealt = cls.select("node", F.explode("bands").alias("band"))
    low = dealt.groupBy("band").agg(F.min("node").alias("low"), F.count("*").alias("many")).where("many > 1")
    stars = dealt.join(dealt_anew(low, "band"), "band").where("node > low").select(F.col("node").alias("a"), F.col("low").alias("b"))
    comp = cut(connected_components(stars))
    mine = units(cls, comp, block).groupBy("node").agg(F.collect_list(F.struct("b", "unit", "blocks")).alias("units"))  # as many as there are bands at most
    members = mine.join(cls.select("node", "k", "th", "w", "bands"), "node")
    members = members.withColumn("bands", F.when(F.exists("units", lambda u: u["b"] > 0), F.col("bands")))
    members = members.withColumnsRenamed({"k": "mk", "th": "mh"})
    sets = map_arrow(
        d.join(members, d["k"].eqNullSafe(members["mk"]) & (d["th"] == members["mh"])).select("node", "units", "w", "bands", "text"),
        "node long, units array<struct<b:int,unit:bigint,blocks:bigint>>, w long, bands array<long>, grams binary",
        _with_sets(size),
    )
    pairs = sets.select("node", "w", "bands", "grams", F.explode("units").alias("u")).select("node", "w", "bands", "grams", "u.*")
    pairs = pairs.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    pairs = pairs.select("b", "unit", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "node", "w", "bands", "block", "grams")
    dealt = ("b", "unit", "i", "j")
    near = pairs.repartition(*dealt).sortWithinPartitions(*dealt).mapInArrow(_compared(threshold), "node long, links long, root long")
    near = cut(near)
    hung = connected_components(near.select(F.col("node").alias("a"), F.col("root").alias("b")))
    counts = near.groupBy("node").agg(F.sum("links").alias("links"))
    found = cls.join(counts, "node", "left").join(hung, "node", "left").withColumn("component", F.coalesce("component", "node"))
    found = cut(found.select("c1", "c2", "n", "w", "least", "component", F.coalesce("links", F.lit(0)).alias("links")))
    least = dealt_anew(found.groupBy("component").agg(F.min("least").alias("class_id")), "component")
    found = found.join(least, "component").select("c1", "c2", "n", "component", "class_id", (F.col("w") - 1 + F.col("links")).alias("n_links"))
    out = sig.select("k", "th", "c1", "c2", "n").join(found, ["c1", "c2", "n"], "left")
    class_id = F.when(F.col("n") > 0, F.col("class_id")).otherwise(F.col("k"))
    return out.select(F.col("k").alias("doc_id"), class_id.alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), "th", *(["component"] if nodes else []))


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """``docs`` with one row of each class of near duplicates: that of the least doc_id (null last), then of the least text hash.

    Texts without words all stay. Of rows that repeat a doc_id and text one stays, if its text has words: the first by all its columns as JSON.
    """
    found = cut(near_duplicates(docs, nodes=True, **how))
    classed = found.select(F.col("doc_id").alias("k"), "th", F.col("component").alias("c"), F.col("doc_id").isNull().alias("none")).where(found["n_links"] > 0)
    chosen = classed.groupBy("c").agg(F.min(F.struct("none", "k", "th")).alias("m")).select(F.col("m.k").alias("ck"), F.col("m.th").alias("ch"))
    is_chosen = F.col("k").eqNullSafe(F.col("ck")) & (F.col("th") == F.col("ch"))
    lost = classed.select("k", "th").distinct().join(chosen, is_chosen, "left_anti")
    twice = classed.groupBy("k", "th").agg(F.count("*").alias("many")).where("many > 1")
    k, th = docs["doc_id"], F.xxhash64(docs["text"])
    out = docs.join(lost, k.eqNullSafe(lost["k"]) & th.eqNullSafe(lost["th"]), "left_anti")
    if twice.limit(1).count():
        twice = twice.join(chosen, is_chosen, "left_semi").select("k", "th")
        hit = out.join(twice, k.eqNullSafe(twice["k"]) & th.eqNullSafe(twice["th"]), "left_semi")
        rest = out.join(twice, k.eqNullSafe(twice["k"]) & th.eqNullSafe(twice["th"]), "left_anti")
        row = F.struct(*[hit[f"`{c}`"] for c in hit.columns])
        first = hit.groupBy(hit["doc_id"], hit["text"]).agg(F.min_by(row, F.to_json(row, {"ignoreNullFields": "false"})).alias("row"))
        out = rest.union(first.select("row.*"))
    return out


def op5_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """Operator 5 over all documents: class and number of links at a similarity of 0.8 on word 5-grams."""
    return near_duplicates(table(spark, sf_dir, "documents")).drop("th")


SQL = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(lower(coalesce(text, '')), '[A-Za-z0-9_\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM documents),
s AS (SELECT DISTINCT rid, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {SIZE} THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - {SIZE - 2}), lambda i: array_to_string(w[i:i + {SIZE - 1}], ' ')) END) AS g FROM d),
n AS (SELECT rid, count(*) AS n FROM s GROUP BY rid),
p AS (SELECT a.rid AS x, b.rid AS y, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.rid < b.rid GROUP BY a.rid, b.rid),
l AS (SELECT x, y FROM p JOIN n nx ON nx.rid = x JOIN n ny ON ny.rid = y WHERE shared >= {THRESHOLD} * (nx.n + ny.n - shared) - 1e-9),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
reach(rid, root) AS (SELECT rid, rid FROM d UNION SELECT e.y, reach.root FROM reach JOIN e ON reach.rid = e.x),
c AS (SELECT reach.rid, min(d.doc_id) AS class_id FROM reach JOIN d ON d.rid = reach.root GROUP BY reach.rid),
k AS (SELECT x AS rid, count(*) AS n_links FROM e GROUP BY x)
SELECT doc_id, class_id, coalesce(n_links, 0)::BIGINT AS n_links FROM d JOIN c USING (rid) LEFT JOIN k USING (rid)
"""
