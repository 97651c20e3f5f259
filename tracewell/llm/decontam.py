"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

A pattern is a window of ``window`` consecutive words of a benchmark item (an item with fewer words
is one pattern). Patterns of one length form a searcher: a shift table over blocks of
two words tells how far the scan may jump, the hash bucket of a pattern's last block selects the
patterns to try, and comparing words confirms an occurrence.

The patterns go to the executors in blocks of at most ``block_bytes`` of benchmark text; several blocks
mean several scans, of which all but the first give the rows that they hit, so nothing grows with the benchmark. Texts of any
length and words repeated any number of times take time in proportion to the words: each different window is found once a place. Cases: null
or empty texts and items have no words; there is one row per input row, whatever the number of blocks, also of rows that
repeat a doc_id or have none; repeated items count once per item_id; a null item_id
is dropped from the id list; an empty benchmark hits nothing; other columns are not read (and kept by :func:`keep_clean`), whatever their names.
"""

from __future__ import annotations

import hashlib
import itertools
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import keep_rows, materialize, table
from ._text import fold_words

B = 2


class WuManber:
    """Search for the windows of m consecutive words of the given texts (item, words); each different window is known once.

    A window's items are a list beside it, so what is repeated, within an item or between items, costs no more to find.
    """

    def __init__(self, texts: list[tuple[object, list]], m: int) -> None:
        self.m, self.b = m, min(B, m)
        self.default = m - self.b + 1
        #: All texts' words, one after the other; a window is the first place where it stands.
        self.words: list = []
        self.items: dict[int, list] = {}
        self.shift: dict = {}
        #: Last block -> hash of the whole window -> places of windows with that hash.
        self.bucket: dict = defaultdict(dict)
        known: dict = {}
        for item, words in texts:
            base = len(self.words)
            self.words += [known.setdefault(w, w) for w in words]
            for end in range(self.b, len(words) + 1):
                at = base + end - 1
                block = self.words[at] if self.b == 1 else (self.words[at - 1], self.words[at])
                # The block ends at each place from there on of the patterns that hold it.
                jump = max(0, m - end)
                self.shift[block] = min(self.shift.get(block, self.default), jump)
                if not jump:
                    self._enter(block, at - m + 1, item)

    def _enter(self, block, place: int, item) -> None:
        window = self.words[place : place + self.m]
        same = self.bucket[block].setdefault(hash(tuple(window)), [])
        for p in same:
            if self.words[p : p + self.m] == window:
                if self.items[p][-1] != item:  # an item's windows come one after the other
                    self.items[p].append(item)
                return
        same.append(place)
        self.items[place] = [item]

    def find(self, words: list) -> Iterator[tuple[int, int]]:
        """Starts of all occurrences, overlapping ones too, in order, each with the window's place (see ``items``)."""
        m, shift, default, bucket, patterns = self.m, self.shift.get, self.default, self.bucket, self.words
        at, n = m - 1, len(words)
        single = self.b == 1
        while at < n:
            block = words[at] if single else (words[at - 1], words[at])
            jump = shift(block, default)
            if jump:
                at += jump
                continue
            start = at - m + 1
            seen = words[start : at + 1]
            for place in bucket[block].get(hash(tuple(seen)), ()):
                if patterns[place : place + m] == seen:
                    yield start, place
                    break
            at += 1


def searchers(items: list[tuple[object, str | None]], window: int) -> list[WuManber]:
    by_length: dict[int, list[tuple[object, list]]] = defaultdict(list)
    for item_id, text in sorted(items, key=lambda i: (i[0] is not None, str(i[0]))):  # rows of one item together
        words = fold_words(text)
        if words:
            by_length[min(window, len(words))].append((item_id, words))
    return [WuManber(texts, m) for m, texts in sorted(by_length.items())]


def joined(spans: Iterable[list[int]]) -> list[list[int]]:
    """Half-open spans in the order of their starts, those that touch as one."""
    out: list[list[int]] = []
    for a, b in spans:
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def hits_of(words: list, found: list[WuManber]) -> tuple[list[list[int]], set]:
    """Merged half-open word spans inside occurrences, and the items that occur."""
    spans, items = [], set()
    for s in found:
        places: set[int] = set()

        def occurrences(s=s, places=places) -> Iterator[list[int]]:
            for start, place in s.find(words):
                places.add(place)
                yield [start, start + s.m]

        spans += joined(occurrences())
        items.update(*(s.items[p] for p in places))
    return joined(sorted(spans)), items


SCHEMA = "doc_id long, n_words long, spans array<struct<start:long,stop:long>>, items array<string>"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))


def scan(docs: DataFrame, items: list[tuple[object, str | None]], window: int, doc_id: str = "doc_id", text: str = "text", row: str | None = None) -> DataFrame:
    """One row per input row with its hit spans and items (strings) for one block of the benchmark, and its key ``row`` if that is given."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), *([F.col(row).cast("long").alias("row")] if row else []))
    shared = docs.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = searchers(shared.value, window)
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                n, spans, ids = [], [], []
                for t in batch.column(1):
                    words = fold_words(t.as_py())
                    s, i = hits_of(words, found)
                    n.append(len(words))
                    spans.append([{"start": a, "stop": b} for a, b in s])
                    ids.append(sorted(str(x) for x in i if x is not None))
                found_here = {"doc_id": batch.column(0), "n_words": pa.array(n, pa.int64()), "spans": pa.array(spans, _SPANS), "items": pa.array(ids, pa.list_(pa.string()))}
                yield pa.record_batch(found_here | ({"row": batch.column(2)} if row else {}))

    return rows.mapInArrow(run, SCHEMA + (", row long" if row else ""))


def blocks_of(benchmark: DataFrame, block_bytes: int, item_id: str, item_text: str) -> Iterator[list[tuple[object, str | None]]]:
    """The different items in blocks of about ``block_bytes`` of text at most, by a hash of the item; at least one block.

    A single text of more than that is a block of its own.
    """
    bench = benchmark.select(F.col(item_id).alias("i"), F.col(item_text).cast("string").alias("t")).distinct()
    size = bench.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = -(-2 * size // block_bytes) if size > block_bytes else 1
    cut = bench.withColumn("b", F.pmod(F.xxhash64("i", "t"), F.lit(blocks)))
    for b in range(blocks):
        yield [(r.i, r.t) for r in cut.where(F.col("b") == b).collect()]


def keep_clean(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_bytes: int = 4 << 20, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, in which no pattern occurs."""
    for items in blocks_of(benchmark, block_bytes, item_id, item_text):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def build(shared=shared):
            found = searchers(shared.value, window)
            return lambda texts: [not any(next(s.find(words), None) for s in found) for words in map(fold_words, texts)]

        docs = keep_rows(docs, text, build)
    return docs


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_bytes: int = 4 << 20, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Per row of docs: doc_id, n_words, merged hit ``spans`` (words, half-open) and the sorted ``items`` that occur."""
    blocks = blocks_of(benchmark, block_bytes, item_id, item_text)
    first, second = next(blocks), next(blocks, None)
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    if second is None:
        return scan(docs, first, window)
    # The key of a row is written once, so that all blocks' scans see the same; after the first, only rows that a block hits are shuffled.
    keyed = materialize(docs.withColumn("row", F.monotonically_increasing_id()), "keyed")
    hit = [scan(keyed, items, window, row="row").where(F.size("spans") > 0).select("row", "spans", "items") for items in itertools.chain([second], blocks)]
    more = reduce(lambda a, b: a.unionByName(b), hit).groupBy("row").agg(F.flatten(F.collect_list("spans")).alias("more"), F.flatten(F.collect_list("items")).alias("others"))
    both = scan(keyed, first, window, row="row").join(more, "row", "left")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans, items = [], []
            for own, more, ids, others in zip(*(b.column(i).to_pylist() for i in range(2, 6)), strict=True):
                whole = joined(sorted([s["start"], s["stop"]] for s in own + (more or [])))
                spans.append([{"start": a, "stop": z} for a, z in whole])
                items.append(sorted({*ids, *(others or [])}))
            yield pa.record_batch({"doc_id": b.column(0), "n_words": b.column(1), "spans": pa.array(spans, _SPANS), "items": pa.array(items, pa.list_(pa.string()))})

    return both.select("doc_id", "n_words", "spans", "more", "items", "others").mapInArrow(merge, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    hit = F.expr("aggregate(spans, 0L, (acc, x) -> acc + x.stop - x.start)")
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def digest(items: list) -> str:
    return hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()


SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents),
b AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM benchmark),
lens AS (SELECT DISTINCT least(10, len(w)) AS m FROM b WHERE len(w) > 0),
pats AS (
  SELECT DISTINCT item_id, m, array_to_string(w[i:i + m - 1], ' ') AS p
  FROM (SELECT item_id, w, least(10, len(w)) AS m, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
wins AS (
  SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS p
  FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, lens WHERE len(w) >= m)),
occ AS (SELECT wins.doc_id, wins.m, wins.i, pats.item_id FROM wins JOIN pats ON wins.m = pats.m AND wins.p = pats.p),
hit AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS k FROM (SELECT DISTINCT doc_id, m, i FROM occ)) GROUP BY doc_id),
its AS (SELECT doc_id, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS ids FROM occ GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(len(ids), 0) AS BIGINT) AS n_items, sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""
