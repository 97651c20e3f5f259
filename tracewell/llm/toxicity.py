"""Toxicity by multiple-instance learning.

A document is a bag of sentences; a sentence's probability is logistic in its distinct words (the word and its
beginnings of four to six bytes) and the document's is their noisy-or, 1 - prod(1 - p). Only document labels are known, so the gradient of the document's
likelihood trains the sentence weights. The fitted weights then score every document and locate its
offending sentences.

Cases: null and empty texts have no sentence and get the score of an empty sentence; sentences of a
document repeat as often as they stand there; documents whose labels disagree count as toxic; with no label of one of
the kinds the score is the labelled rate; an empty table gives no rows. Texts are scored whole, of any length; repeated
rows get equal rows; rows without an id are scored and never learned from, of rows that share one a single text is learned
from; extra columns are not read (and kept by :func:`keep_clean`), whatever their names.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import keep_rows, table
from ._text import FOLD, utf8

_SENTENCE = re.compile(rb"[.!?\n]+")
#: Sentence marks in another's place, so that one split finds sentences and the next their words.
_SPLIT = bytes(10 if c in b".!?\n" else FOLD[c] for c in range(256))


def sentences(text: str | None) -> list[set[bytes]]:
    """The distinct folded words of each sentence that has any; one empty sentence if none has."""
    found = [set(s.split()) for s in utf8(text).translate(_SPLIT).split(b"\n")]
    return [s for s in found if s] or [set()]


def features(word: bytes) -> list[bytes]:
    """The word itself, marked by a leading 0, and its proper beginnings of four to six bytes."""
    return [b"0" + word, *(word[:n] for n in (4, 5, 6) if len(word) > n)]


class Sums(dict):
    """The summed weights of a word's features, kept for up to 250,000 words."""

    def __init__(self, weights: dict[bytes, float]) -> None:
        super().__init__()
        self.weights = weights

    def __missing__(self, word: bytes) -> float:
        if len(self) > 250_000:
            self.clear()
        get = self.weights.get
        self[word] = found = sum([get(f, 0.0) for f in features(word)])
        return found


@dataclass
class Model:
    bias: float = -8.0
    weights: dict[bytes, float] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.sums = Sums(self.weights)

    def __reduce__(self) -> tuple:
        return Model, (self.bias, self.weights)

    def fresh(self) -> Model:
        """The same model without remembered words, for one task: workers keep broadcast values."""
        return Model(self.bias, self.weights)

    def logits(self, bag: list[set[bytes]]) -> list[float]:
        get, b = self.sums.__getitem__, self.bias
        return [b + sum(map(get, s)) for s in bag]

    def scores(self, texts: list[str | None]) -> tuple[np.ndarray, list[np.ndarray]]:
        """Noisy-or of each text, and its sentences' probabilities."""
        rows = [np.array(self.logits(sentences(t))) for t in texts]
        ps = [1 / (1 + np.exp(-np.clip(z, -40, 40))) for z in rows]
        return np.array([-np.expm1(-np.logaddexp(0, z).sum()) for z in rows]), ps


class Bags:
    """Documents as numbers of words: ``word`` in order, words per sentence, sentences per document."""

    def __init__(self, texts: Iterable[str | None] = ()) -> None:
        self.names: dict[bytes, int] = {}
        self.word, self.sentence, self.document = array("i"), array("i"), array("i")
        for t in texts:
            self.add(t)

    def add(self, text: str | None) -> None:
        found = sentences(text)
        for s in found:
            self.word.extend([self.names.setdefault(w, len(self.names)) for w in sorted(s)])
            self.sentence.append(len(s))
        self.document.append(len(found))


def _spread(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (count[0] of them), start[1], ..."""
    ends = np.cumsum(count)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - count), count)


def fit(bags: Bags, y: np.ndarray, weight: np.ndarray, most: int = 4000, steps: int = 150, decay: float = 0.02) -> Model:
    """Full-batch Adam on the noisy-or likelihood over the ``most`` features most associated with the labels."""
    rate = float((weight * y).sum() / max(weight.sum(), 1e-9)) if len(y) else 0.0
    if not len(y) or y.min() == y.max():
        p = min(max(rate, 1e-4), 1 - 1e-4)
        return Model(float(np.log(p / (1 - p))), {})
    word, sent_len, bag_len = (np.array(a, np.int64) for a in (bags.word, bags.sentence, bags.document))
    numbers: dict[bytes, int] = {}
    of_word = array("i")
    count = np.array([len(ids) for w in bags.names for ids in [[numbers.setdefault(f, len(numbers)) for f in features(w)]] if not of_word.extend(ids)], np.int64)
    of_word = np.array(of_word, np.int64)
    offset = np.cumsum(count) - count
    # In how many documents of each label a feature stands; some hundred documents at a time.
    seen = np.zeros((2, len(numbers)))
    first_word = np.concatenate(([0], np.cumsum(np.add.reduceat(sent_len, np.cumsum(bag_len) - bag_len))))
    for lo in range(0, len(y), 256):
        hi = min(lo + 256, len(y))
        w = word[first_word[lo] : first_word[hi]]
        document = np.repeat(np.arange(lo, hi), np.diff(first_word[lo : hi + 1]))
        pairs = np.unique(np.repeat(document, count[w]) * len(numbers) + of_word[_spread(offset[w], count[w])])
        for k in (0, 1):
            seen[k] += np.bincount(pairs[y[pairs // len(numbers)] == k] % len(numbers), minlength=len(numbers))
    n1, n0 = max(int(y.sum()), 1), max(int((1 - y).sum()), 1)
    total = seen.sum(0)
    score = np.abs(seen[1] / n1 - seen[0] / n0) / np.sqrt(np.maximum(total, 1) / (n1 + n0))
    names = list(numbers)
    chosen = sorted(np.flatnonzero(total >= 4).tolist(), key=lambda i: (-score[i], names[i]))[:most]
    number = {names[f]: i for i, f in enumerate(chosen)}
    place = np.full(len(names), -1)
    place[chosen] = np.arange(len(chosen))
    # Only chosen features stay: per word, then per sentence.
    kept = place[of_word] >= 0
    left = np.add.reduceat(kept.astype(np.int64), offset) if len(offset) else count
    of_word, offset = place[of_word[kept]], np.cumsum(left) - left
    per_word = left[word]
    flat = of_word[_spread(offset[word], per_word)]
    sentence_of = np.repeat(np.repeat(np.arange(len(sent_len)), sent_len), per_word)
    bag_of = np.repeat(np.arange(len(bag_len)), bag_len)
    first = np.concatenate(([0], np.cumsum(bag_len)[:-1]))
    theta = np.zeros(len(number) + 1)
    theta[-1] = -6.0
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    scale = weight / weight.sum()
    for t in range(1, steps + 1):
        z = theta[-1] + np.bincount(sentence_of, theta[flat], len(sent_len))
        p = 1 / (1 + np.exp(-z))
        log_none = -np.add.reduceat(np.logaddexp(0, z), first)
        odds_none = np.exp(log_none) / np.maximum(-np.expm1(log_none), 1e-12)  # (1 - P) / P
        per_bag = np.where(y > 0, -np.minimum(odds_none, 1e6), 1.0) * scale
        dz = p * per_bag[bag_of]
        grad = np.append(np.bincount(flat, dz[sentence_of], len(number)), dz.sum())
        grad[:-1] += decay * theta[:-1] / len(y)
        m = 0.9 * m + 0.1 * grad
        v = 0.999 * v + 0.001 * grad * grad
        theta -= 0.3 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return Model(float(theta[-1]), {w: float(theta[i]) for w, i in number.items() if abs(theta[i]) > 1e-3})


def learn(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", per_class: int = 3000) -> Model:
    """Fit on at most about ``per_class`` whole documents of each label, those with the smallest hashes of their ids.

    Each class is weighted back to its share of all labels. The chosen ids, at most that many, are broadcast; of the
    documents that share an id one is taken, by a hash of the texts, so that many are shuffled at most to the task that fits.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).cast("long").alias("id")).agg((F.max(label) > 0).cast("int").alias("y"))
    sizes = {r.y: r["count"] for r in known.groupBy("y").count().collect()}
    draw = F.pmod(F.xxhash64("id", F.lit(4)), F.lit(1_000_000))
    pick = F.lit(False)
    for k, n in sizes.items():
        pick = pick | ((F.col("y") == k) & (draw < int(1e6 * min(1.0, per_class / n)) + 1))
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text")).join(F.broadcast(known.where(pick)), "id")
    rows = rows.groupBy("id", "y").agg(F.min(F.struct(F.xxhash64("text"), "text")).alias("t")).select("id", "y", "t.text")

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bags, y = Bags(), []
        for batch in batches:
            y += batch.column(1).to_pylist()
            for t in batch.column(2):
                bags.add(t.as_py())
        seen = Counter(y)
        model = fit(bags, np.array(y, float), np.array([sizes[k] / seen[k] for k in y]))
        yield pa.record_batch({"feature": pa.array([None, *model.weights], pa.binary()), "weight": pa.array([model.bias, *model.weights.values()], pa.float64())})

    # One task fits the bounded sample, in the order of the ids; the driver receives the weights.
    found = rows.repartition(1).sortWithinPartitions("id", "text").mapInArrow(train, "feature binary, weight double").collect()
    weights = {bytes(r.feature): r.weight for r in found if r.feature is not None}
    return Model(next((r.weight for r in found if r.feature is None), -8.0), weights)


SCHEMA = "doc_id long, score double, sentences array<struct<start:long,stop:long,score:double>>"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("score", pa.float64())]))


def _spans(text: str) -> list[tuple[int, int]]:
    """Byte spans of the sentences that :func:`sentences` gives, in order."""
    data, out, at = utf8(text), [], 0
    for m in [*_SENTENCE.finditer(data), None]:
        stop = m.start() if m else len(data)
        if data[at:stop].translate(FOLD).strip():
            out.append((at, stop))
        at = m.end() if m else stop
    return out


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """Each document's score and its offending sentences (UTF-8 byte spans), those at the threshold or above."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value.fresh()
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                texts = batch.column(1).to_pylist()
                scores, ps = m.scores(texts)
                found = []
                for t, p in zip(texts, ps, strict=True):
                    bad = np.flatnonzero(p >= threshold)
                    where = _spans(t or "") if len(bad) else []
                    found.append([{"start": where[i][0], "stop": where[i][1], "score": float(p[i])} for i in bad if i < len(where)])
                yield pa.record_batch({"doc_id": batch.column(0), "score": pa.array(scores), "sentences": pa.array(found, _SPANS)})

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, SCHEMA)


def keep_clean(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of docs that score below the threshold, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def build():
        m = shared.value.fresh()
        return lambda texts: (m.scores(texts)[0] < threshold).tolist()

    return keep_rows(docs, text, build)


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(F.crc32(F.encode(F.col(doc_id).cast("string"), "UTF-8")), F.lit(5)) == 0, F.lit(False))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = learn(docs, labels.where(~held_out()))
    found = score(docs, model)
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("sentences").cast("long").alias("n_sentences"))
