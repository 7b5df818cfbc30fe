"""MinHash near-dedup by tensored banding (operator 13).

1. Each text becomes its set of 64-bit hashes of word 4-shingles. Texts of equal sets are one class (a node) from here on.
2. Two small collections of m half keys of r minhashes each are computed: 2 m r minhashes. A table key combines one half key of either
   collection, so there are m * m tables of 2 r minhashes, for which plain banding would need 2 m * m * r. Two texts of similarity s meet in
   a table if they share a half key in each collection, with probability (1 - (1 - s^r)^m)^2; ``choose_tensor`` takes m and r for a target.
   Half keys that no other text has are left out before they are combined: they cannot be part of a shared table key.
3. A bucket gives a star around its least node, not its pairs. The stars' components say which texts can be linked at all.
4. In a large component, each text is first verified against the few nodes that lead most of its buckets; in a group of copies
   this joins most of it. What is still apart is verified exactly: the texts outside of the largest joined part against all texts of
   the component, in blocks, or bucket by bucket where less travels for that. No link between the classes of a bucket is left unverified unless
   they are joined already, so components are as if every candidate were verified.
5. Links are confirmed on the full sets. Components of the links are the groups of near duplicates.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._bytes import U, bounds, buffers, hash_spans, mix, owners, shingles
from ._spark import cut, dealt_anew, map_arrow, only, slabs, table, texts
from .components import connected_components
from .jaccard_join import links

THRESHOLD, SIZE, RECALL = 0.8, 4, 0.9999
#: Texts compared with a chunk of others in one task, and bytes of their sets.
BLOCK, CHUNK, BLOCK_BYTES = 512, 1024, 1 << 26
#: Bytes that are moved to look at one table key of a text again (some seven exchanges of a row of three longs); a shingle has 8.
KEY_BYTES = 300
#: Components beyond LARGE classes begin with leaders: nodes that a text is verified against first, and orders in which a bucket's leaders are drawn.
LARGE, LEADERS, DRAWS = 4096, 4, 3
#: Words are runs of other bytes than space and \\t \\n \\v \\f \\r.
WORD = np.ones(256, bool)
WORD[[9, 10, 11, 12, 13, 32]] = False


def choose_tensor(threshold: float = THRESHOLD, recall: float = RECALL, most: int = 96) -> tuple[int, int]:
    """(half keys of each collection, minhashes of a half key): the steepest that finds a pair at the threshold with the wanted probability."""
    best = None
    for rows in range(1, most + 1):
        p = threshold**rows
        halves = 1 if p >= 1 else math.ceil(math.log(1 - math.sqrt(recall)) / math.log1p(-p))
        if 2 * halves * rows <= most:
            best = halves, rows
    if best is None:
        raise ValueError("no tensor of so few minhashes reaches this recall")
    return best


def shingle_sets(col: pa.Array, size: int = SIZE) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, sorted distinct shingle hashes of each row) for stretches of a text column; A-Z count as a-z."""
    raw, at = buffers(pc.ascii_lower(col))
    for i, j in slabs(np.diff(at).tolist()):
        part, off = raw[at[i] : at[j]], at[i : j + 1] - at[i]
        s, e = bounds(part, off, WORD)
        h, row = shingles(hash_spans(part, s, e), owners(s, off), j - i, size)
        edge = np.searchsorted(row, np.arange(j - i + 1))
        yield i, [np.unique(h[a:b]) for a, b in zip(edge[:-1], edge[1:])]


def half_keys(flat: np.ndarray, start: np.ndarray, halves: int, rows: int) -> np.ndarray:
    """(sets x 2 halves) half keys of sets that lie one after another in ``flat``; no key of one place equals one of another but by chance."""
    mults = (mix(np.arange(1, 2 * halves * rows + 1, dtype=U)) >> U(32)).astype(np.uint32) | np.uint32(1)
    short = (flat >> U(32)).astype(np.uint32)
    out = np.empty((len(start), 2 * halves), U)
    for b in range(2 * halves):
        acc = np.full(len(start), b + 1, U)
        for m in mults[b * rows : (b + 1) * rows]:
            acc = mix(acc + np.minimum.reduceat(short * m, start).astype(U))
        out[:, b] = acc
    return out


def _signed(halves: int, rows: int, size: int):
    def f(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        keys, counts, found = [np.zeros((0, 2), U)], [np.zeros(0, np.int64)], [np.zeros((0, 2 * halves), U)]
        for _, sets in shingle_sets(texts(batch), size):
            many = np.array([len(x) for x in sets])
            some = np.flatnonzero(many)
            key, half = np.zeros((len(sets), 2), U), np.zeros((len(sets), 2 * halves), U)
            if len(some):
                flat = np.concatenate([sets[i] for i in some])
                start = np.cumsum(many[some]) - many[some]
                key[some, 0] = np.add.reduceat(mix(flat), start)
                key[some, 1] = np.bitwise_xor.reduceat(mix(flat * U(0xD6E8FEB86659FD93) + U(1)), start)
                half[some] = half_keys(flat, start, halves, rows)
            keys.append(key)
            counts.append(many)
            found.append(half)
        key, n, half = np.concatenate(keys), np.concatenate(counts), np.concatenate(found)
        lists = pa.ListArray.from_arrays(np.arange(0, half.size + 1, 2 * halves, dtype=np.int32), half.ravel().view(np.int64))
        columns = [batch.column(0), batch.column(1), pa.array(key[:, 0].copy().view(np.int64)), pa.array(key[:, 1].copy().view(np.int64)), pa.array(n.astype(np.int64)), lists]
        yield pa.RecordBatch.from_arrays(columns, names=["k", "th", "c1", "c2", "n", "half"])

    return f


def shared_tables(cls: DataFrame, halves: int) -> DataFrame:
    """(node, key, low, even) for the table keys that more than one class has; low is the bucket's least node, and even says that both halves have the same place."""
    half = cls.select("node", F.posexplode("half").alias("pos", "v"))
    many = dealt_anew(half.groupBy("v").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").select("v"), "v")
    kept = half.join(many, "v", "left_semi").groupBy("node").agg(F.collect_list(F.struct("pos", "v")).alias("x"))  # 2 * halves at most
    side = lambda first: F.filter("x", lambda x: (x["pos"] < halves) if first else (x["pos"] >= halves))
    dealt = cut(kept.select("node", side(True).alias("a"), side(False).alias("b")).where((F.size("a") > 0) & (F.size("b") > 0)))
    keys = dealt.select("node", F.explode("a").alias("a"), "b").select("node", "a", F.explode("b").alias("b"))
    keys = keys.select("node", F.xxhash64("a.v", "b.v").alias("key"), (F.col("a.pos") + halves == F.col("b.pos")).alias("even"))
    low = keys.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").select("key", "low")
    return cut(keys.join(dealt_anew(low, "key"), "key"))


def _joined(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For a matrix of links (left x right): each left's and right's least left that it hangs together with (right without links: -1)."""
    far = near.shape[0]
    left = np.arange(far)
    while True:
        right = np.where(near, left[:, None], far).min(axis=0, initial=far)
        new = np.minimum(left, np.where(near, right[None, :], far).min(axis=1, initial=far))
        if (new == left).all():
            return left, np.where(right < far, right, -1)
        left = new


def _confirmed(threshold: float, size: int):
    def judged(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        """Links of one block and chunk, as a tree: (a, b) hang each linked text on one text."""
        t = pa.Table.from_batches(held)
        column = lambda c: np.asarray(t.column(c).combine_chunks())
        node, first = np.unique(column("node"), return_index=True)  # a row that is repeated comes more than once
        c, own_r = column("c")[first], column("own_r")[first]
        minor, own_m = column("minor")[first], column("own_m")[first]
        m, r = t.column("m")[0].as_py(), t.column("r")[0].as_py()
        left, right = np.flatnonzero(minor & (own_m == m)), np.flatnonzero(own_r == r)
        none = pa.array([], pa.int64())
        if not len(left) or not len(right):
            return pa.record_batch({"a": none, "b": none})
        sets = [s for _, part in shingle_sets(t.column("text").take(pa.array(first)).combine_chunks(), size) for s in part]
        near = links(sets, left, right, threshold) & (c[left][:, None] != c[right][None, :])
        of_left, of_right = _joined(near)
        got = np.flatnonzero(of_right >= 0)
        own = np.flatnonzero(of_left != np.arange(len(left)))
        a = np.concatenate([node[right[got]], node[left[own]]])
        b = np.concatenate([node[left[of_right[got]]], node[left[of_left[own]]]])
        return pa.record_batch({"a": a, "b": b})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by unit, block and chunk."""
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([np.asarray(batch.column(batch.schema.get_field_index(c))).astype(np.int64) for c in ("unit", "m", "r")], axis=1)
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


def confirmed(held: DataFrame, place: DataFrame, threshold: float, size: int) -> DataFrame:
    """Links (a, b) between the minor texts of each unit and all its texts with another ``c``, on the full sets; a tree, not all pairs.

    ``held`` has (node, text), ``place`` (node, unit, minor, c, blocks, chunks): in how many blocks and chunks the unit's minor texts and its texts
    are dealt. Every text goes to its chunk once a block, every minor text to its block once a chunk.
    """
    p = place.groupBy("node").agg(F.collect_list(F.struct("unit", "minor", "c", "blocks", "chunks")).alias("u"))  # as many as there are tables at most
    p = held.join(p, "node").select("node", "text", F.explode("u").alias("u")).select("node", "text", "u.*")
    p = p.withColumn("own_m", F.pmod(F.xxhash64("node"), "blocks").cast("int")).withColumn("own_r", F.pmod(F.xxhash64("node", F.lit(1)), "chunks").cast("int"))
    upto = lambda n: F.sequence(F.lit(0), n.cast("int") - 1)
    at = F.transform(upto(F.col("blocks")), lambda m: F.struct(m.alias("m"), F.col("own_r").alias("r")))
    also = F.transform(F.filter(upto(F.col("chunks")), lambda r: r != F.col("own_r")), lambda r: F.struct(F.col("own_m").alias("m"), r.alias("r")))
    p = p.withColumn("at", F.explode(F.when(F.col("minor"), F.concat(at, also)).otherwise(at))).select("unit", "at.m", "at.r", "node", "c", "minor", "own_m", "own_r", "text")
    dealt = ("unit", "m", "r")
    return p.repartition(*dealt).sortWithinPartitions(*dealt).mapInArrow(_confirmed(threshold, size), "a long, b long")


def _blocks(many: F.Column, bytes_: F.Column, most: int) -> F.Column:
    return F.greatest(F.ceil(many / F.lit(most)), F.ceil(bytes_ / F.lit(BLOCK_BYTES)), F.lit(1))


def led(shared: DataFrame, large: DataFrame) -> DataFrame:
    """``place`` rows that verify each node of ``large`` (node, n) against the nodes that lead most of its buckets (those of even keys are enough to tell)."""
    rows = cut(shared.where("even").join(large.select("node"), "node", "left_semi").select("node", "key"))
    drawn = rows.groupBy("key").agg(*[F.min_by("node", F.xxhash64("node", F.lit(s))).alias(f"l{s}") for s in range(DRAWS)])
    drawn = drawn.select("key", F.array_distinct(F.array(*[f"l{s}" for s in range(DRAWS)])).alias("leads"))
    pairs = rows.join(dealt_anew(drawn, "key"), "key").select("node", F.explode("leads").alias("lead")).where("node <> lead").groupBy("node", "lead").agg(F.count("*").alias("often"))
    best = pairs.groupBy("node").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("often")).alias("o"), "lead"))), 1, LEADERS).alias("x"))  # half keys times draws at most
    best = best.select("node", F.explode("x").alias("x")).select("node", F.col("x.lead").alias("unit"))
    best = cut(best.join(large, "node"))
    sized = best.groupBy("unit").agg(_blocks(F.count("*"), F.sum("n") * 8, CHUNK).alias("chunks"))
    led = best.join(dealt_anew(sized, "unit"), "unit").select("node", "unit", F.lit(False).alias("minor"), F.col("node").alias("c"), F.lit(1).cast("long").alias("blocks"), "chunks")
    return led.unionByName(sized.select(F.col("unit").alias("node"), "unit", F.lit(True).alias("minor"), F.col("unit").alias("c"), F.lit(1).cast("long").alias("blocks"), "chunks"))


def _units(rows: DataFrame, unit: str) -> DataFrame:
    """(unit, top, blocks, chunks, cost) of (unit, node, n, c): the largest part of each unit, and how the others and all are dealt. Whole units are left out."""
    parts = rows.groupBy(unit, "c").agg(F.count("*").alias("many"), F.sum("n").alias("n"))
    u = parts.groupBy(unit).agg(F.max(F.struct("many", "n", "c")).alias("top"), F.sum("many").alias("many"), F.sum("n").alias("n")).where("top.many < many")
    k, b = F.col("many") - F.col("top.many"), F.col("n") - F.col("top.n")
    u = u.select(unit, F.col("top.c").alias("top"), _blocks(k, b * 8, BLOCK).alias("blocks"), _blocks(F.col("many"), F.col("n") * 8, CHUNK).alias("chunks"), F.col("many"), k.alias("k"), F.col("n").alias("size"))
    return u.withColumn("cost", F.col("many") * F.col("blocks") + F.col("k") * (F.col("chunks") - 1))


def apart(shared: DataFrame, nodes: DataFrame) -> DataFrame:
    """``place`` rows for what is still apart in ``nodes`` (node, component, n, c, keys): by component, or by its buckets where less travels for that.

    Buckets are looked at only in components for which more bytes would travel than it takes to read their table keys again. A node's keys meet
    its component as one row, and what is then read by bucket is written once.
    """
    whole = cut(_units(nodes, "component"))
    mine = nodes.join(dealt_anew(whole, "component"), "component")
    out = ["node", "unit", (F.col("c") != F.col("top")).alias("minor"), "c", "blocks", "chunks"]
    keys = nodes.groupBy("component").agg(F.sum("keys").alias("keys"))
    dear = cut(whole.where("blocks > 1").join(keys, "component").where(F.col("size") * 8 * F.col("blocks") > F.col("keys") * KEY_BYTES).select("component", "cost"))
    if not dear.limit(1).count():
        return mine.withColumn("unit", F.col("component")).select(*out)
    keyed = shared.groupBy("node").agg(F.collect_list(F.struct("key", "low")).alias("x"))  # as many as there are tables at most
    inside = keyed.join(nodes.join(dealt_anew(dear.select("component"), "component"), "component", "left_semi"), "node")
    inside = cut(inside.select("node", "component", "n", "c", F.explode("x").alias("x")).select("x.key", "x.low", "node", "component", "n", "c"))
    prints = [F.count("*").alias("many"), F.bit_xor(F.xxhash64("node")).alias("s1"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("s2")]
    once = inside.groupBy("key", "low", "component").agg(*prints).groupBy("component", "low", "many", "s1", "s2").agg(F.min("key").alias("key")).select("key")
    inside = cut(inside.join(dealt_anew(once, "key"), "key").select("key", "node", "component", "n", "c"))  # of buckets with the same members, one
    buckets = _units(inside, "key")
    costs = inside.select("key", "component").distinct().join(buckets, "key").groupBy("component").agg(F.sum("cost").alias("by_bucket"))
    split = cut(costs.join(dear, "component").where("by_bucket < cost").select("component"))
    first = mine.join(dealt_anew(split, "component"), "component", "left_anti").withColumn("unit", F.col("component")).select(*out)
    then = inside.join(dealt_anew(split, "component"), "component", "left_semi").join(dealt_anew(buckets, "key"), "key").withColumn("unit", F.col("key")).select(*out)
    return first.unionByName(then)


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, size: int = SIZE, recall: float = RECALL, large: int = LARGE) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs`` (doc_id of any type that sorts, text); other columns are ignored.

    Rows are linked whose sets of word shingles have that Jaccard similarity; component_id is the least doc_id that links lead to, and the row of that
    doc_id is kept. Texts without words (null and empty ones too) have an empty set, no links, and their own doc_id. A text of fewer words than
    a shingle has one of all its words. A null doc_id sorts last: a component whose rows all lack one has a null component_id, and keeps them.
    Repeated rows link to each other and fare alike. An empty table gives no rows. Components beyond ``large`` classes begin with leaders; the result does not depend on it.
    """
    halves, rows = choose_tensor(threshold, recall)
    d = only(docs, "doc_id", "text").select(F.col("doc_id").alias("k"), F.xxhash64("text").alias("th"), "text")
    schema = T.StructType([d.schema["k"], *T.StructType.fromDDL("th long, c1 long, c2 long, n long, half array<long>").fields])
    sig = cut(map_arrow(d, schema, _signed(halves, rows, size)))
    cls = sig.where("n > 0").groupBy("c1", "c2", "n").agg(F.min("k").alias("least"), F.min(F.struct("k", "th", "half")).alias("rep"))
    cls = cut(cls.select("c1", "c2", "n", "least", "rep.*").withColumn("node", F.monotonically_increasing_id()))
    shared = shared_tables(cls, halves)
    stars = shared.where("node > low").select(F.col("node").alias("a"), F.col("low").alias("b"))
    comp = connected_components(stars).join(cls.select("node", "n", "k", "th"), "node")
    comp = cut(comp.join(shared.groupBy("node").agg(F.count("*").alias("keys")), "node"))
    big = cut(comp.groupBy("component").agg(F.count("*").alias("many")).where(F.col("many") > large).select("component"))
    of = comp.select(F.col("k").alias("mk"), F.col("th").alias("mh"), "node")
    held = cut(d.join(of.hint("merge"), d["k"].eqNullSafe(of["mk"]) & (d["th"] == of["mh"])).select("node", "text"))
    nodes, found = comp.select("node", "component", "n", "keys", F.col("node").alias("c")), []
    if big.limit(1).count():
        most = cut(comp.join(big, "component", "left_semi").select("node", "n"))
        found.append(cut(confirmed(held, led(shared, most), threshold, size)))
        followed = found[0].groupBy("b").agg(F.count("*").alias("many"))
        leader = found[0].join(dealt_anew(followed, "b"), "b").groupBy(F.col("a").alias("node")).agg(F.max(F.struct("many", "b")).alias("lead"))
        nodes = nodes.join(leader, "node", "left").join(followed.withColumnsRenamed({"b": "node", "many": "own"}), "node", "left")
        c = F.when(F.col("lead.many") > F.coalesce("own", F.lit(0)), F.col("lead.b")).otherwise(F.col("node"))  # texts of one c hang on one leader
        nodes = cut(nodes.select("node", "component", "n", "keys", c.alias("c")))
    found.append(cut(confirmed(held, apart(shared, nodes), threshold, size)))
    tied = found[0] if len(found) == 1 else found[0].unionByName(found[1])
    hung = connected_components(tied)
    got = cut(cls.join(hung, "node", "left").select("c1", "c2", "n", "least", F.coalesce("component", "node").alias("component")))
    least = dealt_anew(got.groupBy("component").agg(F.min("least").alias("component_id")), "component")
    got = got.join(least, "component").select("c1", "c2", "n", "component_id")
    out = sig.select("k", "c1", "c2", "n").join(got, ["c1", "c2", "n"], "left")
    root = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("k"))
    return out.select(F.col("k").alias("doc_id"), F.col("n").alias("n_shingles"), root.alias("component_id"), F.col("k").eqNullSafe(root).alias("kept"))


def op13_minhash_dedup(spark, sf_dir: str) -> DataFrame:
    """Operator 13 over all documents: components at a similarity of 0.8 on word 4-shingles."""
    return near_duplicates(table(spark, sf_dir, "documents"))


SQL = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT rid, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {SIZE} THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - {SIZE - 2}), lambda i: array_to_string(w[i:i + {SIZE - 1}], ' ')) END) AS g FROM d),
n AS (SELECT rid, count(*) AS n FROM s GROUP BY rid),
p AS (SELECT a.rid AS x, b.rid AS y, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.rid < b.rid GROUP BY a.rid, b.rid),
l AS (SELECT x, y FROM p JOIN n nx ON nx.rid = x JOIN n ny ON ny.rid = y WHERE 100 * shared >= 80 * (nx.n + ny.n - shared)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
reach(rid, root) AS (SELECT rid, rid FROM d UNION SELECT e.y, reach.root FROM reach JOIN e ON reach.rid = e.x),
c AS (SELECT reach.rid, min(d.doc_id) AS component_id FROM reach JOIN d ON d.rid = reach.root GROUP BY reach.rid)
SELECT doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, doc_id IS NOT DISTINCT FROM component_id AS kept FROM d JOIN c USING (rid) LEFT JOIN n USING (rid)
"""
