"""License scans: fuzzy search for short notices.

A notice of L characters may have k = max(1, L // 12) edits. It is cut into k + 1 pieces, of which one at least is
intact in any occurrence (pigeonhole); an automaton over all pieces finds them in the folded words,
and the regex library's bounded-error matching verifies the surroundings of each piece and gives the
span and the edits. Exact phrases are found beside this by their words.

Cases: null and empty texts have no words and no labels; repeated rows give equal rows, also without a doc_id (which is
then null); texts of any length are searched whole, in time linear in length and hits; of notices that tie for a place both
stay; a table without rows gives none; other columns are not read, whatever their names.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import table
from ._text import fold_words

#: Exact phrases and their labels (fixed values).
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Short notices, as folded words, and their labels.
NOTICES = {
    "licensed under the apache license version 2 0": "apache-2.0",
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "redistribution and use in source and binary forms with or without modification": "bsd",
    "licensed under the gnu general public license": "gpl",
    "gnu general public license version 2": "gpl-2.0",
    "gnu general public license version 3": "gpl-3.0",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license version 2 0": "mpl-2.0",
    "eclipse public license": "epl",
    "licensed under cc by 4 0": "cc-by-4.0",
    "licensed under cc by sa 4 0": "cc-by-sa-4.0",
    "licensed under cc by nc 4 0": "cc-by-nc-4.0",
    "creative commons attribution": "creative-commons",
    "dedicated to the public domain": "public-domain",
    "boost software license version 1 0": "bsl-1.0",
    "all rights reserved": "reserved",
    "provided as is without warranty of any kind": "no-warranty",
}


def edits_of(notice: str) -> int:
    return max(1, len(notice) // 12)


def pieces(notice: str, k: int) -> list[tuple[int, str]]:
    """k + 1 pieces of about equal length with their offsets."""
    n = len(notice)
    cuts = [n * i // (k + 1) for i in range(k + 2)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


class Notices:
    """The automaton of all pieces, and a bounded-error expression for each notice."""

    def __init__(self, notices: dict[str, str]) -> None:
        import ahocorasick

        self.notices = list(notices.items())
        self.edits = [edits_of(n) for n, _ in self.notices]
        self.checks = [regex.compile(rf"(?b)\b(?:{regex.escape(n, literal_spaces=True)}){{e<={k}}}\b") for (n, _), k in zip(self.notices, self.edits, strict=True)]
        seeds: dict[str, list] = {}
        for i, (n, _) in enumerate(self.notices):
            for offset, piece in pieces(n, self.edits[i]):
                seeds.setdefault(piece, []).append((i, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, uses in seeds.items():
            self.automaton.add_word(piece, (len(piece), uses))
        self.automaton.make_automaton()

    def find(self, words: str) -> list[tuple[int, int, str, int, int]]:
        """(start, stop, label, edits, notice length) of occurrences in folded words; those of one notice don't overlap."""
        hits: dict[int, list[int]] = {}
        for end, (size, uses) in self.automaton.iter(words):
            for i, offset in uses:
                hits.setdefault(i, []).append(end + 1 - size - offset)
        out = []
        for i, starts in hits.items():
            notice, label = self.notices[i]
            k, done = self.edits[i], 0
            for start in sorted(set(starts)):
                lo, hi = max(start - k - 1, done, 0), start + len(notice) + k + 1
                if hi <= lo:
                    continue
                # Whole words: an edit must not be spent on the rest of a word that the window cuts. A word that goes on
                # for two lengths of the notice more is cut: no match, of its length and k at most, can reach that cut.
                while lo > done and lo > 0 and words[lo - 1] != " ":
                    lo -= 1
                    if start - lo > 2 * len(notice):
                        break
                cut = words.find(" ", hi)
                hi = len(words) if cut < 0 else min(cut, hi + 2 * len(notice))
                if m := self.checks[i].search(words, lo, hi):
                    a, b = m.span()
                    a += len(m.group()) - len(m.group().lstrip())
                    b = a + len(m.group().strip())
                    out.append((a, b, label, sum(m.fuzzy_counts), len(notice)))
                    done = b
        # Variants of one notice match each other with a few edits: where most of a span overlaps a closer one, that stays.
        out.sort()
        starts = [x[0] for x in out]
        longest = max((x[1] - x[0] for x in out), default=0)

        def closer(x: tuple) -> bool:
            near = out[bisect_left(starts, x[0] - longest) : bisect_left(starts, x[1])]
            return any(y[3] < x[3] and 2 * (min(x[1], y[1]) - max(x[0], y[0])) > x[1] - x[0] for y in near)

        return [x for x in out if not closer(x)]


def phrase_starts(words: str) -> list[tuple[int, str]]:
    """Word numbers at which an exact phrase starts, and its label."""
    padded, out = f" {words} ", []
    for phrase, label in PHRASES.items():
        at, seen, word, needle = -1, 0, 0, f" {phrase} "
        while (at := padded.find(needle, at + 1)) >= 0:
            word += padded.count(" ", seen, at)
            seen = at
            out.append((word, label))
    return sorted(out)


SCHEMA = "doc_id long, n_words long, exact array<struct<word:long,label:string>>, fuzzy array<struct<label:string,word:long,words:long,edits:int,text:string,score:double>>"
_EXACT = pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string())]))
_FUZZY = pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64()), ("words", pa.int64()), ("edits", pa.int32()), ("text", pa.string()), ("score", pa.float64())]))


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", notices: dict[str, str] | None = None) -> DataFrame:
    """Exact phrases and fuzzy notices of each document with their spans in words; schema ``SCHEMA``."""
    chosen = NOTICES if notices is None else notices

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Notices(chosen)
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                n, exact, fuzzy = [], [], []
                for t in batch.column(1):
                    split = fold_words(t.as_py())
                    words = b" ".join(split).decode("utf-8", "replace")
                    n.append(len(split))
                    exact.append([{"word": w, "label": label} for w, label in phrase_starts(words)])
                    hits = search.find(words)
                    gaps = [i for i, c in enumerate(words) if c == " "] if hits else []
                    fuzzy.append([
                        {"label": label, "word": bisect_right(gaps, a), "words": words.count(" ", a, b) + 1, "edits": edits, "text": words[a:b], "score": 1 - edits / length}
                        for a, b, label, edits, length in hits
                    ])
                yield pa.record_batch({"doc_id": batch.column(0), "n_words": pa.array(n, pa.int64()), "exact": pa.array(exact, _EXACT), "fuzzy": pa.array(fuzzy, _FUZZY)})

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    base = F.array_sort(F.array_distinct(F.col("exact.label")))
    every = F.array_sort(F.array_distinct(F.concat(F.col("exact.label"), F.col("fuzzy.label"))))
    best = F.when(F.size("exact") > 0, 1.0).otherwise(F.coalesce(F.array_max("fuzzy.score"), F.lit(0.0)))
    return found.select(
        "doc_id", "n_words", F.size("exact").cast("long").alias("n_base"), F.array_min("exact.word").alias("first_word"), F.array_max("exact.word").alias("last_word"),
        F.array_join(base, ",").alias("base_labels"), F.array_join(every, ",").alias("labels"), best.alias("score"), F.size("fuzzy").cast("long").alias("n_fuzzy"),
    )
