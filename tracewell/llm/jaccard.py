"""N-gram Jaccard join by parity sketches: all pairs of documents whose k-word shingle sets are similar enough, as classes.

**Sketch.** Every token of a set flips one bit of a wide bit sketch, so the Hamming distance of two sketches is at most the
size of the sets' symmetric difference. For a similarity t, sets of sizes a <= b <= a / t can be similar only if they differ in
d = floor((a + b)(1 - t) / (1 + t)) tokens at most.

**Pigeonhole, per size band.** A band's sketch is cut into d + 1 + e blocks (d the largest of the band, by ``BAND`` ratio); a pair
differs in d blocks at most, so e + 1 blocks agree. A block is known by the exclusive or of its tokens' hashes, that is, by a
hash of its bits; blocks that hold the same sets are one. A set joins its own band and the lower ones that can hold a similar smaller set.
Empty blocks say nothing and are not indexed: if a set has at most e of them, one of the e + 1
agreements is on a block that is not empty. A set with more goes on to another division of the tokens, and another; both
sets of a pair take part up to the first division at which one of them has few enough, so no pair is lost. The
last division indexes empty blocks too. Very frequent shingles (from a bounded sample; any choice is right, it
only saves work) are left out of the first divisions: leaving out the same tokens of both sets never adds a difference.

**Verify.** Sets that share a block are candidates. A block's members are tried against a few centres of it, not in all pairs:
sketches (about a bit per token) first, then the sets themselves. Members of one component need no further test: where
a block still holds several, members outside its largest component are the next centres, up to 256 at once. A
centre has then been tried against its whole block and leaves it, until no block holds two components. So the components are exact.

**Skew.** A task gives each text's keys once, so copies are collapsed before the shuffle. Centres and labels that many rows ask for are
read by :func:`lookup` in salted parts, the partners of a centre are spread by their number, and the sets to verify are fetched by a
bitmap of at most ``BITMAP`` bits (beyond that more texts are read than needed, none is missed).

Sets are known by a 64-bit hash of their tokens, tokens by 64-bit hashes; equal sets are one node of the
join. Cases: null and empty texts have no shingles and are linked with nothing; a text of fewer than k words is one shingle; repeated
rows share a component; rows without a doc_id link like others, and a component's id is the smallest doc_id there is in it (null if
there is none); an empty table gives no rows; other columns of docs are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._spark import drop_materialized, fresh, lookup, materialize, table
from ._text import mix64, shingle_hashes

BAND = 1.4
LANES = 8  # longs of the narrowest sketch
BITMAP = 1 << 26
_C1, _C2 = np.uint64(0xA0761D6478BD642F), 0xE7037ED1A0B428DB
#: Divisions of a set in turn: with frequent tokens or not, a seed, and times as many blocks as can differ (0: as few as a band's sets need).
#: The wider ones are for sets that are mostly frequent tokens.
DIVISIONS = ((False, 0, 0), (False, 1, 0), (False, 2, 2), (False, 3, 4), (True, 0, 0), (True, 1, 0), (True, 2, 0), (True, 3, 2), (True, 4, 4))


@dataclass(frozen=True)
class Threshold:
    """Similar: den * |A and B| >= num * |A or B|."""

    num: int = 80
    den: int = 100

    def differences(self, a: int, b: int) -> int:
        return (a + b) * (self.den - self.num) // (self.den + self.num)

    def largest(self, a: int) -> int:
        return a * self.den // self.num

    def similar(self, both: int, a: int, b: int) -> bool:
        return both > 0 and self.den * both >= self.num * (a + b - both)

    @cached_property
    def edges(self) -> list[int]:
        """First size of each band."""
        out = [1]
        while out[-1] < 1 << 40:
            out.append(max(out[-1] + 1, int(out[-1] * BAND)))
        return out

    def blocks(self, band: int, times: int = 0) -> tuple[int, int]:
        """Blocks of the band's sketch, and how many may be empty."""
        small, most = self.edges[band], self.edges[band + 1] - 1
        need = self.differences(most, self.largest(most)) + 1
        if times:
            return times * need, (times - 1) * need
        e = 0
        for _ in range(4):
            empty = (need + e) * np.exp(-small / (need + e))
            e = int(np.ceil(empty + np.sqrt(empty) / 2)) if need > 1 else 0
        return need + e, e

    def bands(self, n: int) -> list[int]:
        own = int(np.searchsorted(self.edges, n, side="right")) - 1
        out = [own]
        while out[-1] > 0 and self.den * (self.edges[out[-1]] - 1) >= self.num * n:
            out.append(out[-1] - 1)
        return out


def _salt(x: int) -> np.uint64:
    return np.uint64(x * _C2 & (1 << 64) - 1)


def block_keys(tokens: np.ndarray, frequent: np.ndarray, t: Threshold) -> np.ndarray:
    """The keys of a set's blocks (int64) in all its bands; tokens sorted and distinct."""
    n = len(tokens)
    if not n:
        return np.empty(0, np.int64)
    rare = tokens
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, tokens), len(frequent) - 1)
        rare = tokens[frequent[at] != tokens]
    dealt: dict[tuple, np.ndarray] = {}
    out = []
    for band in t.bands(n):
        for stage, (whole, seed, times) in enumerate(DIVISIONS):
            blocks, spare = t.blocks(band, times)
            v = dealt.get((whole, seed))
            if v is None:
                v = tokens if whole else rare
                if seed:
                    v = np.sort(mix64(v + _salt(seed)))
                dealt[whole, seed] = v
            block = ((v >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)
            first = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1]))) if len(v) else np.empty(0, np.int64)
            ids = block[first]
            if len(ids):
                out.append(mix64(np.bitwise_xor.reduceat(v, first) + ids * _C1 + _salt(band * 32 + stage)))
            if blocks - len(ids) <= spare:
                break
        else:
            rest = np.setdiff1d(np.arange(blocks, dtype=np.uint64), ids)
            out.append(mix64(rest * _C1 + _salt(band * 32 + 31)))
    return np.concatenate(out).view(np.int64)


def sketch(tokens: np.ndarray) -> np.ndarray:
    """The parity sketch of a set: LANES int64, or the power of two times as many that has a bit per token."""
    lanes = LANES
    while 64 * lanes < len(tokens):
        lanes *= 2
    bits = np.bincount((tokens & np.uint64(64 * lanes - 1)).astype(np.int64), minlength=64 * lanes) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def node_of(tokens: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(tokens.tobytes(), digest_size=8).digest(), "little", signed=True)


def _arrays(values: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(v) for v in values]))).astype(np.int32)
    flat = np.concatenate(values) if values else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, kind))


def _texts(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``doc_id, text, g``: g is a hash of both, the key of a row (and of its full repeats)."""
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).withColumn("g", F.xxhash64("doc_id", "text"))


def frequent_shingles(docs: DataFrame, k: int, sample: int = 8192, least: int = 8, most: int = 65536) -> np.ndarray:
    """Sorted hashes of shingles in at least ``least`` documents of a sample of about ``sample``; ``most`` at most."""
    n = docs.count()
    if not n:
        return np.empty(0, np.uint64)
    part = docs.select("text").sample(min(1.0, sample / n), seed=5)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                found = [shingle_hashes(t.as_py(), k) for t in whole.slice(at, 256).column(0)]
                yield pa.record_batch({"h": pa.array(np.concatenate(found).view(np.int64))})

    top = part.mapInArrow(run, "h long").groupBy("h").count().where(F.col("count") >= least).orderBy(F.desc("count"), "h").limit(most)
    return np.sort(np.array([r.h for r in top.select("h").collect()], np.int64).view(np.uint64))


_DOC = pa.struct([("doc_id", pa.int64()), ("g", pa.int64()), ("at", pa.int64()), ("n", pa.int64()), ("sketch", pa.list_(pa.int64()))])


def index(docs: DataFrame, k: int, t: Threshold, frequent: np.ndarray, remember: int = 100_000) -> DataFrame:
    """``key, node, doc``: one row per document (``doc`` tells its id, g, number in its task, size and sketch; node is null if the
    set is empty) and, with no doc, one per block key of a set. A task gives the keys of one of the last ``remember`` nodes once."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, seen, count = shared.value, set(), 0
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                sets = [shingle_hashes(x.as_py(), k) for x in batch.column(1)]
                nodes = [node_of(s) if len(s) else None for s in sets]
                keys, of = [], []
                for s, node in zip(sets, nodes, strict=True):
                    if node is not None and node not in seen:
                        seen.add(node)
                        keys.append(block_keys(s, common, t))
                        of.append(np.full(len(keys[-1]), node, np.int64))
                if len(seen) > remember:
                    seen.clear()
                numbers = np.arange(count, count + len(sets))
                count += len(sets)
                doc = pa.StructArray.from_arrays(
                    [batch.column(0), batch.column(2), pa.array(numbers), pa.array([len(s) for s in sets], pa.int64()), _arrays([sketch(s) if len(s) else np.empty(0, np.int64) for s in sets], pa.int64())], fields=list(_DOC)
                )
                spread = mix64(np.array(batch.column(2)).view(np.uint64) + numbers.astype(np.uint64)).view(np.int64)
                yield pa.record_batch({"key": pa.array(spread), "node": pa.array(nodes, pa.int64()), "doc": doc})
                if keys:
                    flat = np.concatenate(keys)
                    yield pa.record_batch({"key": pa.array(flat), "node": pa.array(np.concatenate(of)), "doc": pa.nulls(len(flat), _DOC)})

    return docs.select("doc_id", "text", "g").mapInArrow(run, "key long, node long, doc struct<doc_id:long,g:long,at:long,n:long,sketch:array<long>>")


def near(t: Threshold, n: str, sketch: str, m: str, other: str) -> str:
    """SQL: the sizes n, m and the sketches (the wider one folded) of two sets allow similarity."""
    lanes = f"least(size({sketch}), size({other}))"
    fold = "if(size({0}) = {1}, {0}, transform(sequence(0, {1} - 1), i -> aggregate(sequence(i, size({0}) - 1, {1}), 0L, (x, j) -> x ^ {0}[j])))"
    wide = f"aggregate(zip_with({fold.format(sketch, lanes)}, {fold.format(other, lanes)}, (x, y) -> bit_count(x ^ y)), 0, (x, y) -> x + y)"
    narrow = " + ".join(f"bit_count({sketch}[{i}] ^ {other}[{i}])" for i in range(LANES))
    distance = f"if(size({sketch}) = {LANES} AND size({other}) = {LANES}, {narrow}, {wide})"
    return f"if(greatest({n}, {m}) * {t.num} <= least({n}, {m}) * {t.den}, {distance} <= ({n} + {m}) * {t.den - t.num} div {t.den + t.num}, false)"


def bitmap(keys: DataFrame, column: str, n: int) -> np.ndarray:
    """A Bloom filter (two bits a key) of n 64-bit keys as packed bits, of at most ``BITMAP`` of them."""
    bits = min(BITMAP, 1 << max(10, (8 * n).bit_length()))
    both = F.explode(F.array(F.pmod(column, F.lit(bits)), F.pmod(F.shiftrightunsigned(column, 32), F.lit(bits))))
    words = keys.select(both.alias("b")).groupBy(F.shiftright("b", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b & 63 AS int))")).alias("v")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[words["w"].to_numpy()] = words["v"].to_numpy()
    return out


def _in(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    keys, most = keys.view(np.uint64), np.uint64(64 * len(bits) - 1)
    found = [bits.view(np.uint64)[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1) for at in (keys & most, keys >> np.uint64(32) & most)]
    return (found[0] & found[1]).astype(bool)


def load_sets(docs: DataFrame, k: int, bits: np.ndarray) -> DataFrame:
    """``g, node, tokens`` (packed) of the rows whose g is in the bitmap; a task gives full repeats once."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, seen = shared.value, set()
        for whole in batches:
            hits = np.flatnonzero(_in(wanted, np.array(whole.column(0))))
            for at in range(0, len(hits), 256):
                g, sets = [], []
                for row in hits[at : at + 256].tolist():
                    if (key := whole.column(0)[row].as_py()) not in seen and len(s := shingle_hashes(whole.column(1)[row].as_py(), k)):
                        seen.add(key)
                        g.append(key)
                        sets.append(s)
                if len(seen) > 100_000:
                    seen.clear()
                if sets:
                    yield pa.record_batch({"g": pa.array(g, pa.int64()), "node": pa.array([node_of(s) for s in sets], pa.int64()), "tokens": pa.array([s.tobytes() for s in sets], pa.binary())})

    return docs.select("g", "text").mapInArrow(run, "g long, node long, tokens binary")


def verify(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, k: int, t: Threshold, together: int = 64) -> DataFrame:
    """The pairs (a, b) whose sets are similar, written. About ``together`` partners of a centre a stream past its set in one task.

    ``nodes`` tells the row (g) from which a node's set is read.
    """
    n = pairs.count()
    salts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / together).alias("salts"))
    spread = lookup(pairs, "a", salts, ["b"], n).withColumn("salt", F.pmod(F.xxhash64("b"), "salts"))
    ask = spread.select(F.col("a").alias("node"), "a", "salt", F.lit(None).cast("long").alias("b")).distinct().unionByName(spread.select(F.col("b").alias("node"), "a", "salt", "b"))
    ask = materialize(ask.join(nodes.select("node", "g"), "node"), "asked")
    rows = ask.select("node", "g").distinct()
    sets = load_sets(docs, k, bitmap(rows, "g", rows.count()))
    dealt = ask.join(sets, ["node", "g"]).select("a", "salt", "b", "tokens").repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre = np.empty(0, np.uint64)
        for batch in batches:
            left, right = [], []
            for a, b, tokens in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                s = np.frombuffer(tokens.as_buffer(), np.uint64)
                if b is None:
                    centre = s.copy()
                    continue
                small, large = (s, centre) if len(s) < len(centre) else (centre, s)
                at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                if t.similar(int(np.count_nonzero(large[at] == small)), len(s), len(centre)):
                    left.append(a)
                    right.append(b)
            yield pa.record_batch({"a": pa.array(left, pa.int64()), "b": pa.array(right, pa.int64())})

    edges = materialize(dealt.mapInArrow(run, "a long, b long"), "edges")
    drop_materialized(ask)
    return edges


def components(edges: DataFrame) -> DataFrame:
    """``node, label``, written: the smallest node each node reaches. Labels spread along edges and then jump to their labels' labels."""
    both = materialize(edges.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("other"))).distinct(), "both")
    n = both.count()
    labels = materialize(both.groupBy("node").agg(F.least("node", F.min("other")).alias("label")), "labels")
    while True:
        seen = lookup(both, "other", labels.select(F.col("node").alias("other"), F.col("label").alias("seen")), ["node"], n).groupBy("node").agg(F.min("seen").alias("seen"))
        new = materialize(labels.join(seen, "node").select("node", F.least("label", "seen").alias("next"), F.col("label").alias("was")), "seen")
        jumped = lookup(new, "next", new.select(F.col("node").alias("next"), F.col("next").alias("jump")), ["node"], n)
        old, labels = labels, materialize(jumped.select("node", F.coalesce("jump", "next").alias("label"), "was"), "labels")
        changed = labels.where("label <> was").limit(1).count()
        drop_materialized(old, new)
        if not changed:
            drop_materialized(both)
            return labels


def merged(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """The labels after more edges: components of the components that they join."""
    n = edges.count()
    ends = edges
    for end in ("a", "b"):
        ends = lookup(ends, end, labels.select(F.col("node").alias(end), F.col("label").alias(f"label_{end}")), ["a" if end == "b" else "b"], n)
    ends = ends.select(F.coalesce("label_a", "a").alias("a"), F.coalesce("label_b", "b").alias("b"))
    joined = components(ends.where("a <> b"))
    moved = lookup(labels.select("node", "label"), "label", joined.select(F.col("node").alias("label"), F.col("label").alias("to")), ["node"], labels.count())
    out = materialize(moved.select("node", F.coalesce("to", "label").alias("label")).unionByName(joined.select("node", "label")).groupBy("node").agg(F.min("label").alias("label")), "labels")
    drop_materialized(joined)
    return out


def linked(docs: DataFrame, k: int, t: Threshold) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents (``doc_id, g, at, n, node``), the label of each node that is linked with another, and the written table below the first.

    docs has the columns of :func:`_texts`.
    """
    by_key = Window.partitionBy("key")
    found = index(docs, k, t, frequent_shingles(docs, k)).withColumn("low", F.min("node").over(by_key)).withColumn("high", F.max("node").over(by_key))
    members = F.xxhash64(F.count("node").over(by_key), F.bit_xor(F.xxhash64("node")).over(by_key), F.bit_xor(F.xxhash64("node", F.lit(1))).over(by_key))
    # Documents, and the blocks in which two different sets stand.
    indexed = materialize(found.withColumn("members", members).withColumn("m", F.count("node").over(by_key)).where("doc IS NOT NULL OR low < high").select("members", "m", "node", "doc"), "index")
    rows = indexed.where("doc IS NOT NULL").select("doc.*", "node")
    nodes = materialize(rows.where("node IS NOT NULL").groupBy("node").agg(F.min(F.struct("g", "n", "sketch")).alias("x")).select("node", "x.*"), "nodes")
    # Blocks of the same sets are one: all blocks that two near copies share, for example.
    shared = indexed.where("doc IS NULL").groupBy(F.col("members").alias("key"), "node", "m").count()
    # A node that shares much is typical of a group of near copies, most of which are similar to it. The weightiest node is
    # the first centre of a block, and a node is tried against the centre that most of its blocks have.
    weight = Window.partitionBy("node")
    shared = materialize(shared.select("key", "node", "count", F.sum(F.col("m") * F.col("count")).over(weight).alias("weight")), "blocks")
    centre = F.max(F.struct("weight", "node")).over(by_key)["node"]
    often = shared.withColumn("a", centre).where("a <> node").groupBy("a", "node").agg(F.sum("count").alias("n")).groupBy("node").agg(F.max(F.struct("n", "a")).alias("x")).select("x.a", F.col("node").alias("b"))
    of = {x: nodes.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"sketch_{x}")) for x in ("a", "b")}
    often = materialize(often, "pairs")
    pairs = materialize(lookup(often, "a", of["a"], ["b"], often.count()).join(of["b"], "b").where(near(t, "n_a", "sketch_a", "n_b", "sketch_b")).select("a", "b"), "near")
    edges = verify(pairs, docs, nodes, k, t)
    labels = components(edges)
    drop_materialized(often, pairs, edges)
    left, written = shared.select("key", "node", "weight"), [shared]
    for i in itertools.count(1):
        several = left.join(labels.select("node", "label"), "node", "left").withColumn("label", F.coalesce("label", "node"))
        size = F.count(F.lit(1)).over(Window.partitionBy("key", "label"))
        several = several.withColumn("size", size).withColumn("main", F.max(F.struct("size", "label")).over(by_key)["label"])
        several = several.withColumn("others", F.sum((F.col("label") != F.col("main")).cast("int")).over(by_key)).where("others > 0").withColumn("other", F.col("label") != F.col("main"))
        rank = F.row_number().over(by_key.orderBy(F.desc("other"), F.desc("weight"), "node"))
        several = materialize(several.withColumn("rank", F.when(F.col("other"), rank)).select("key", "node", "weight", "label", "rank"), "left")
        drop_materialized(*written)
        written = [several]
        if not several.limit(1).count():
            break
        most = min(8 * 4**i, 256)
        heads = F.collect_list(F.when(F.col("rank") <= most, F.struct("node", "label", "rank", "n", "sketch"))).over(by_key)
        tried = F.expr(f"filter(heads, c -> c.label <> label AND (rank IS NULL OR c.rank < rank) AND {near(t, 'n', 'sketch', 'c.n', 'c.sketch')})")
        found = several.join(nodes.select("node", "n", "sketch"), "node").withColumn("heads", heads).select("node", tried.alias("tried")).where("size(tried) > 0")
        pairs = materialize(found.select(F.explode("tried.node").alias("a"), F.col("node").alias("b")).distinct(), "pairs")
        if pairs.limit(1).count():
            edges = verify(pairs, docs, nodes, k, t)
            old, labels = labels, merged(labels, edges)
            drop_materialized(old, edges)
        drop_materialized(pairs)
        left = several.where(F.col("rank").isNull() | (F.col("rank") > most)).select("key", "node", "weight")
    drop_materialized(*written, nodes)
    return rows, labels, indexed


def classes(docs: DataFrame, k: int = 5, threshold: Threshold | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id``: per document the size of its set and the smallest doc_id its links reach."""
    rows, labels, indexed = linked(_texts(docs, doc_id, text), k, threshold or Threshold())
    first = rows.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("least")).join(labels.select("node", "label"), "node", "left").withColumn("label", F.coalesce("label", "node"))
    first = materialize(first, "first")
    named = lookup(first, "label", first.groupBy("label").agg(F.min("least").alias("component")), ["node"], first.count()).select("node", "component")
    found = lookup(rows.select("doc_id", "g", "at", "n", "node"), "node", named, ["g", "at"], rows.count())
    out = materialize(found.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component")).alias("component_id")), "classes")
    drop_materialized(first, labels, indexed)
    return out


def keep_one(docs: DataFrame, k: int = 5, threshold: Threshold | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component, with all its columns, and all rows without words, which are linked with nothing.

    It is a row of the smallest doc_id (a row without one only where all are); of rows that repeat this doc_id and its text one stays.
    """
    rows, labels, indexed = linked(_texts(docs, doc_id, text), k, threshold or Threshold())
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "g")
    first = rows.where("node IS NOT NULL").groupBy("node").agg(F.min(order).alias("x")).join(labels.select("node", "label"), "node", "left")
    kept = first.groupBy(F.coalesce("label", "node").alias("label")).agg(F.min("x").alias("x")).select("x.g")
    times = rows.where("node IS NOT NULL").groupBy("g").agg(F.count(F.lit(1)).alias("times")).where("times > 1")
    key = fresh(docs, stem="row")
    chosen = materialize(kept.join(times, "g", "left").fillna(1, ["times"]).unionByName(rows.where("node IS NULL").select("g", F.lit(0).cast("long").alias("times")).distinct()).withColumnRenamed("g", key), "chosen")
    drop_materialized(labels, indexed)
    keyed = docs.withColumn(key, F.xxhash64(docs[doc_id].cast("long"), docs[text].cast("string")))
    out = keyed.join(chosen.where("times < 2").select(key), key, "left_semi")
    if chosen.where("times > 1").limit(1).count():  # full repeats
        out = out.unionByName(keyed.join(chosen.where("times > 1").select(key), key, "left_semi").dropDuplicates([key]))
    return out.select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * shared >= 80 * (nx.n + ny.n - shared)),
l AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r(doc_id, reached) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, l.y FROM r JOIN l ON l.x = r.reached)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(reached) AS component_id FROM r GROUP BY doc_id) c USING (doc_id)
"""
