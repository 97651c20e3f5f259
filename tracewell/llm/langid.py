"""Language identification: multinomial naive Bayes over hashed character n-grams.

Characters 1- to 3-grams of the lower-cased text are hashed into ``buckets``; training counts them per language over
a bounded sample of labelled documents, and the matrix of log probabilities (buckets x languages, so of fixed
size) is broadcast. Scoring gathers the matrix' rows of a batch's n-grams and sums them per document.

Cases: a null text, or one without any letter, is ``und`` with score 0; with no labelled document at all every text is ``und``;
ties go to the language that sorts first; repeated rows give equal rows; a null doc_id stays null (and is not held out); very long
texts are scored in pieces; an empty table gives none; columns that are not named are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import table

_LETTER = regex.compile(r"\p{L}")
_SALT = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)


def ngram_buckets(code: np.ndarray, bits: int) -> list[np.ndarray]:
    """Bucket of the 1-, 2- and 3-gram that starts at each character (uint32 code points)."""
    out, h = [], np.zeros(len(code), np.uint32)
    for n in range(3):
        h = (h[: len(code) - n] * np.uint32(0x01000193)) ^ (code[n:] * _SALT[n])
        mixed = h * np.uint32(0x9E3779B1)
        out.append((mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x85EBCA6B) >> np.uint32(32 - bits))
    return out


#: Characters that are scored at once.
PIECE = 1 << 18


def codes(lower: str) -> np.ndarray:
    return np.frombuffer(lower.encode("utf-32-le", "replace"), np.uint32)


@dataclass
class Model:
    langs: list[str]
    bits: int
    log_p: np.ndarray  # (buckets, languages) float32
    prior: np.ndarray  # (languages,) float64

    def totals(self, texts: list[str]) -> np.ndarray:
        """Log joint probability (texts, languages)."""
        out = np.tile(self.prior, (len(texts), 1))
        # Pieces of at most PIECE characters; a longer text's pieces overlap by two, so that each n-gram starts in one.
        cut = [(i, t[at : at + PIECE + 2]) for i, t in enumerate(map(str.lower, texts)) for at in range(0, len(t), PIECE)]
        at = 0
        while at < len(cut):  # about PIECE characters at a time
            stop, size = at, 0
            while stop < len(cut) and (stop == at or size + len(cut[stop][1]) <= PIECE):
                size += len(cut[stop][1])
                stop += 1
            row = np.array([i for i, _ in cut[at:stop]])
            parts = [codes(t) for _, t in cut[at:stop]]
            ends = np.cumsum([len(p) for p in parts])
            starts = np.concatenate(([0], ends[:-1]))
            whole = np.concatenate(parts)
            for n, b in enumerate(ngram_buckets(whole, self.bits)):
                # n-grams that cross into the next piece end a piece's range.
                lo, hi = starts, np.maximum(np.minimum(ends - n, starts + PIECE), starts)
                keep = np.flatnonzero(hi > lo)
                if not len(keep):
                    continue
                rows = self.log_p[b]
                bounds = np.stack([lo[keep], hi[keep]], 1).ravel()
                if bounds[-1] == len(rows):
                    bounds = bounds[:-1]
                np.add.at(out, row[keep], np.add.reduceat(rows, bounds, axis=0, dtype=np.float64)[::2])
            at = stop
        return out


def learn(docs: DataFrame, lang: str = "lang", doc_id: str = "doc_id", text: str = "text", per_language: int = 4000, bits: int = 16, alpha: float = 0.1, most_languages: int = 1000) -> Model:
    """Fit on at most about ``per_language`` whole texts of each language, those with the smallest hashes of id and text.

    Rows that repeat an id and its text are one of them, and rows without an id are drawn by their texts, so the bound holds however
    ids repeat. Counting is distributed; the driver receives at most 8 partial count vectors a language. More than ``most_languages`` different languages
    are refused, since the broadcast matrix has a column for each (of 256 KiB at 16 bits).
    """
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).cast("string").alias("id"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    sizes = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}
    if len(sizes) > most_languages:
        raise ValueError(f"{len(sizes)} languages, at most {most_languages} are fitted")
    langs = sorted(sizes)
    draw = F.pmod(F.xxhash64("id", "text", F.lit(2)), F.lit(1_000_000))
    pick = F.lit(False)
    for k in langs:
        pick = pick | ((F.col("lang") == k) & (draw < int(1e6 * min(1.0, per_language / sizes[k])) + 1))
    number = {k: i for i, k in enumerate(langs)}
    width = 1 << bits

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, np.ndarray] = {}
        for batch in batches:
            some: dict[str, list] = {}
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                parts = some.setdefault(k, [0])
                parts += ngram_buckets(codes(t.lower()), bits)
                parts[0] += len(t)
                if parts[0] > PIECE:
                    found[k] = found.get(k, 0) + np.bincount(np.concatenate(parts[1:]), minlength=width)
                    some[k] = [0]
            for k, parts in some.items():
                if len(parts) > 1:
                    found[k] = found.get(k, 0) + np.bincount(np.concatenate(parts[1:]), minlength=width)
        if found:
            yield pa.record_batch({"lang": pa.array(list(found)), "counts": pa.array([v.tobytes() for v in found.values()], pa.binary())})

    total = np.zeros((width, len(langs)))
    drawn = rows.where(pick).groupBy("lang", "id", F.xxhash64("text").alias("h")).agg(F.min("text").alias("text"))
    for r in drawn.select("lang", "text").repartition(8).mapInArrow(count, "lang string, counts binary").collect():
        total[:, number[r["lang"]]] += np.frombuffer(r["counts"], np.int64)
    total += alpha
    prior = np.array([sizes[k] for k in langs], float)
    return Model(langs, bits, np.log(total / total.sum(0)).astype(np.float32) if langs else np.zeros((width, 0), np.float32), np.log(prior / prior.sum()) if langs else prior)


def identify(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score, margin``: the likeliest language, its probability, and its lead a character in nats."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                texts = [t or "" for t in batch.column(1).to_pylist()]
                known = np.array([bool(m.langs) and _LETTER.search(t) is not None for t in texts])
                lang, score, margin = np.full(len(texts), "und", object), np.zeros(len(texts)), np.zeros(len(texts))
                if known.any():
                    t = m.totals([x for x, k in zip(texts, known, strict=True) if k])
                    best = t.argmax(1)
                    top = t.max(1)
                    lang[known] = np.array(m.langs, object)[best]
                    score[known] = 1 / np.exp(t - top[:, None]).sum(1)
                    t[np.arange(len(t)), best] = -np.inf
                    second = t.max(1)
                    margin[known] = np.where(np.isfinite(second), top - second, 0) / [len(x) for x, k in zip(texts, known, strict=True) if k]
                yield pa.record_batch({"doc_id": batch.column(0), "lang_pred": pa.array(lang.tolist(), pa.string()), "score": pa.array(score), "margin": pa.array(margin)})

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double, margin double")


def held_out(doc_id: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.encode(F.col(doc_id).cast("string"), "UTF-8")), F.lit(4)) == 2


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learn(docs.where(~held_out()))
    found = identify(docs, model)
    return found.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score", "margin")
