"""Mixture-controlled packing: deficit round-robin over source queues.

Documents become token ids (plus an end id), written once, and are cut into sequences of ``window`` ids. A source's ids
are one long queue, cut at even distances into a part for every cell of about ``cell_tokens`` ids (a source with fewer ids
has parts of a window, or of a cell's 256th, in some cells), so every cell has the corpus' mixture. In a cell each window
gives each source its target share plus its deficit; what a source lacks at one window it carries to the next, and
what it lacks at a cell's start against its target of all ids before it is carried in from the cells before. Targets are ``weights``,
else each source's share, so that nothing is left over; with weights that its ids can't meet a source's carry is a window at most.

The ids that remain at the end of a cell fill sequences whose lengths are powers of two, so that nothing is
padded. Cases: null text is empty (one end id); a null source is a source; rows that repeat a doc_id or have none are packed
each for itself; an empty table gives no pieces; very long documents are cut like others, over many cells; other columns
are not read, whatever their names.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from array import array
from collections import deque
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._spark import materialize, small_batches, table

_SPACE = r"\t\n\x0b\x0c\r \x85\xa0  -     　"
_WORD = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{_SPACE}\p{{L}}\p{{N}}]+")
#: The same for texts of the first 128 and 256 characters, which the standard library splits faster.
_ASCII_WORD = re.compile(r"[a-z]+|'(?:s|t|re|ve|m|ll|d)|[0-9]|[^\t\n\x0b\x0c\r a-z0-9]+")
_LATIN_WORD = re.compile(r"[a-zªµºß-öø-ÿ]+|'(?:s|t|re|ve|m|ll|d)|[0-9²³¹¼½¾]|[^\t\n\x0b\x0c\r \x85\xa0a-zªµºß-öø-ÿ0-9²³¹¼½¾]+")
_BEYOND_LATIN = re.compile("[^\x00-\xff]")
#: The letters by which byte-level vocabularies write bytes: visible ones of Latin-1 are their own, others follow from 256.
_HIDDEN = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b)]
_BYTE_LETTERS = {b: 256 + i for i, b in enumerate(_HIDDEN)}


class Words(dict):
    """The packed ids of words by word: one that is not there is encoded, or taken from ``past``, which ``age`` fills."""

    def __init__(self, encode: Callable[[str], bytes]) -> None:
        super().__init__()
        self.encode, self.past = encode, {}

    def __missing__(self, word: str) -> bytes:
        ids = self.past.get(word)
        if ids is None:
            ids = self.encode(word)
        self[word] = ids
        return ids

    def age(self) -> None:
        self.past = dict(self)
        self.clear()


class WordTokenizer:
    """``tokenizers``' ids of a lower-casing word BPE, with words cached.

    Pre-tokens do not influence each other in this vocabulary, so the ids of a text are those of its pre-tokens in order: a
    word not seen before goes to the model without the steps before it (normalizer, pre-tokenizer), as its bytes' letters. A
    text that may hold a special token is encoded whole. The cache holds the last ``most`` words, and what of the ``most``
    before has been met again.
    """

    def __init__(self, path: str, most: int = 200_000) -> None:
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.model, self.words = self.tokenizer.model, Words(self.encode)
        self.largest = max(self.tokenizer.get_vocab().values())

    def encode(self, word: str) -> bytes:
        letters = word if word.isascii() and word.isprintable() else word.encode().decode("latin1").translate(_BYTE_LETTERS)
        return array("I", [t.id for t in self.model.tokenize(letters)]).tobytes()

    def split(self, text: str) -> list[str]:
        if text.isascii():
            return _ASCII_WORD.findall(text.lower())
        text = unicodedata.normalize("NFC", text)
        if not _BEYOND_LATIN.search(text):
            return _LATIN_WORD.findall(text.lower())
        return _WORD.findall("".join(c.lower() for c in text) if "Σ" in text else text.lower())

    def many(self, texts: list[str]) -> list[bytes]:
        """The packed little-endian unsigned 32-bit ids of each text."""
        get, out = self.words.__getitem__, []
        for t in texts:
            if len(self.words) >= self.most:
                self.words.age()
            out.append(np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() if "<|" in t else b"".join(map(get, self.split(t))))
        return out

    def __call__(self, text: str) -> bytes:
        return self.many([text])[0]


@lru_cache(1)
def tokenizer_of(path: str) -> WordTokenizer:
    return WordTokenizer(path)


class Queue:
    """The documents of one source: ``take`` cuts pieces off the front."""

    def __init__(self) -> None:
        self.docs: deque = deque()
        self.at = self.size = 0

    def put(self, doc, ids: bytes) -> None:
        self.docs.append((doc, ids))
        self.size += len(ids) // 4

    def take(self, n: int) -> Iterator[tuple]:
        self.size -= n
        while n:
            doc, ids = self.docs[0]
            total = len(ids) // 4
            length = min(n, total - self.at)
            yield doc, self.at, length, zlib.crc32(memoryview(ids)[4 * self.at : 4 * (self.at + length)])
            self.at += length
            n -= length
            if self.at == total:
                self.docs.popleft()
                self.at = 0


def fill(queues: dict[str, Queue], share: dict[str, float], deficit: dict[str, float], room: int) -> list[tuple[str, int]]:
    """How many ids each source gives to one window of ``room`` ids; updates the deficits.

    Every non-empty queue earns its share of the window (shares of empty queues are split among the
    others) and serves what its deficit allows. Rounding and empty queues leave room, which goes
    to the largest deficits, as a debt.
    """
    live = [s for s, q in queues.items() if q.size]
    total = sum(share[s] for s in live) or 1.0
    want = {}
    for s in live:
        deficit[s] += room * share[s] / total
        want[s] = max(0, min(queues[s].size, int(deficit[s])))
    over = sum(want.values())
    if over > room:  # carried deficits ask for more than a window: they are served in proportion, the rest waits
        want = {s: n * room // over for s, n in want.items()}
    left = room - sum(want.values())
    for s in sorted(live, key=lambda s: (want[s] - deficit[s], s)):
        if not left:
            break
        more = min(left, queues[s].size - want[s])
        want[s] += more
        left -= more
    for s in live:
        deficit[s] -= want[s]
    return [(s, n) for s, n in want.items() if n]


def pack_cell(queues: dict[str, Queue], share: dict[str, float], deficit: dict[str, float], window: int, first: int) -> Iterator[tuple]:
    """Pieces (document, start, length, crc, sequence_id, offset, source) of one cell."""
    left, sequence = sum(q.size for q in queues.values()), first
    while left:
        room = window if left >= window else 1 << (left.bit_length() - 1)
        offset = 0
        for s, n in fill(queues, share, deficit, room):
            for piece in queues[s].take(n):
                yield *piece, sequence, offset, s
                offset += piece[2]
        left -= room
        sequence += 1


def encode(docs: DataFrame, tokenizer: str, end_id: int = 2, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``doc_id, source, n, ids, at``, written: each document's n ids, packed in 2 or 4 bytes, and a number of its row."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(source).cast("string"), F.lit("\0")).alias("source"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = tokenizer_of(tokenizer)
        kind = "<u2" if max(words.largest, end_id) < 1 << 16 else "<u4"
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                ids = [np.append(np.frombuffer(x, "<u4"), np.uint32(end_id)).astype(kind) for x in words.many(batch.column(2).to_pylist())]
                yield pa.record_batch({"doc_id": batch.column(0), "source": batch.column(1), "n": pa.array([len(x) for x in ids], pa.int64()), "ids": pa.array([x.tobytes() for x in ids], pa.binary())})

    small_batches(docs.sparkSession)
    return materialize(rows.mapInArrow(run, "doc_id long, source string, n long, ids binary").withColumn("at", F.monotonically_increasing_id()), "tokens")


def deal(tokens: DataFrame, cells: int, total: int, weights: dict[str, float] | None, window: int, part: int) -> DataFrame:
    """``cell, source, at, doc_id, n, skip, ids, share, carry``: each source's ids dealt evenly to cells in parts of about ``part`` ids or more, documents cut where parts end."""
    # Where a document starts in its source's queue: a running sum over hash buckets and one within each.
    rows = tokens.withColumn("bucket", F.pmod(F.xxhash64("at"), F.lit(cells)))
    of_source = Window.partitionBy("source")
    sums = rows.groupBy("source", "bucket").agg(F.sum("n").alias("b"))
    sums = sums.withColumn("own", F.sum("b").over(of_source)).withColumn("before", F.coalesce(F.sum("b").over(of_source.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("b")
    if weights is None:
        sums = sums.withColumn("share", F.lit(None).cast("double"))
    else:
        whole = float(sum(weights.values())) or 1.0
        given = tokens.sparkSession.createDataFrame([(s, w / whole) for s, w in weights.items()], "source string, share double")
        sums = sums.join(given, "source", "left").fillna(0.0, ["share"])
    inside = F.coalesce(F.sum("n").over(Window.partitionBy("source", "bucket").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.join(sums, ["source", "bucket"]).withColumn("start", F.col("before") + inside)
    # Part i of k of a queue of q * k + r ids starts at id q * i + r * i div k; near there the part of an id is sought.
    rows = rows.withColumn("k", F.least(F.lit(cells), F.ceil(F.col("own") / part))).withColumn("q", F.expr("own div k")).withColumn("r", F.expr("own % k"))
    rows = rows.withColumn("i", F.expr("explode(sequence(greatest(0, cast(floor(start / own * k) AS bigint) - 1), least(k - 1, cast(floor((start + n - 1) / own * k) AS bigint) + 1)))"))
    rows = rows.withColumn("lo", F.expr("q * i + r * i div k")).withColumn("hi", F.expr("q * (i + 1) + r * (i + 1) div k"))
    rows = rows.withColumn("first", F.expr("greatest(start, lo)")).withColumn("stop", F.expr("least(start + n, hi)")).where("first < stop")
    carry = F.expr("(r * i % k) / k") if weights is None else F.expr(f"least({window}D, greatest(-{window}D, share * ({total}D / k * i) - lo))")
    cell = F.expr(f"if(k = {cells}, i, pmod(xxhash64(source) % {cells} + (i * {cells}) div k, {cells}))")
    cut = F.expr("substring(ids, cast(octet_length(ids) div n * (first - start) + 1 AS int), cast(octet_length(ids) div n * (stop - first) AS int))")
    return rows.select(cell.alias("cell"), "source", "at", "doc_id", "n", (F.col("first") - F.col("start")).alias("skip"), cut.alias("ids"), (F.col("stop") - F.col("first")).alias("size"), "share", carry.alias("carry"))


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string, ids binary"
_KINDS = (pa.int64(),) * 7 + (pa.string(), pa.binary())
_NAMES = [x.split()[0] for x in SCHEMA.split(", ")]


def pack(docs: DataFrame, tokenizer: str, weights: dict[str, float] | None = None, window: int = 4096, end_id: int = 2, cell_tokens: int = 1 << 20, doc_id: str = "doc_id", text: str = "text", source: str = "source", with_ids: bool = False) -> DataFrame:
    """Pieces of ``docs`` in sequences, schema ``SCHEMA``; ``ids`` (little-endian unsigned 32-bit) is null unless with_ids.

    ``weights`` gives target proportions per source; a source that it lacks has none and only fills
    what the others leave.
    """
    tokens = encode(docs, tokenizer, end_id, doc_id, text, source)
    total = tokens.agg(F.sum("n")).first()[0] or 0
    dealt = deal(tokens, max(1, -(-total // cell_tokens)), total, weights, window, max(1, min(window, cell_tokens // 256)))
    dealt = dealt.repartition("cell").sortWithinPartitions("cell", "source", "at", "skip")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(cell: int) -> Iterator[pa.RecordBatch]:
            whole = sum(q.size for q in queues.values())
            targets = {s: q.size / whole if share[s] is None else share[s] for s, q in queues.items()}
            out: list[list] = [[] for _ in _NAMES]
            for piece in pack_cell(queues, targets, carry, window, int(cell) << 32):
                (doc, n, skip, ids), start, length, crc, sequence, offset, s = piece
                for column, value in zip(out, (doc, skip + start, length, crc, n, sequence, offset, s, ids[4 * start : 4 * (start + length)] if with_ids else None), strict=True):
                    column.append(value)
            for at in range(0, len(out[0]), 20_000):
                yield pa.record_batch([pa.array(c[at : at + 20_000], k) for c, k in zip(out, _KINDS, strict=True)], names=_NAMES)

        now, queues, share, carry = None, {}, {}, {}
        for batch in batches:
            for cell, src, _, doc, n, skip, ids, size, w, c in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if cell != now:
                    if now is not None:
                        yield from done(now)
                    now, queues, share, carry = cell, {}, {}, {}
                if src not in queues:
                    queues[src], share[src], carry[src] = Queue(), w, c
                wide = ids if len(ids) == 4 * size else np.frombuffer(ids, "<u2").astype("<u4").tobytes()
                queues[src].put((doc, n, skip, wide), wide)
        if now is not None:
            yield from done(now)

    return dealt.mapInArrow(run, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces = pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source")
