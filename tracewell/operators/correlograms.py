"""Cross-correlations of all pairs of a set of chunked traces in one pass: raw, demeaned and normalised.

Each channel's chunk is transformed once; pairs are products of transforms, added up over the chunks of a task, so a pair has
one row per task whatever the number of lags, and no sample is repeated for a lag. The demeaned sums are the ones that are
computed; raw sums follow from them by the means and by the few samples at the ends that a lag leaves out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bursts import with_halo

#: Pairs that are transformed back together.
TOGETHER = 64
OUT = "pop_i string, pop_j string, lag long, raw double, demeaned double, normalised double"


def correlograms(chunks: DataFrame, pairs: DataFrame, size: int, lo: int, hi: int, eps: float = 1e-12) -> DataFrame:
    """``pop_i, pop_j, lag, raw, demeaned, normalised`` for lags lo..hi, c[lag] = sum of x_i[t + lag] x_j[t].

    chunks: ``pop, chunk, values`` of ``size`` samples (the last may be shorter) on one grid, no shorter than the largest lag.
    raw and demeaned are divided by the length, normalised (demeaned) by the root of the sums of squares, NaN where that is 0.
    pairs: ``pop_i, pop_j``; the channels of one chunk meet in a task, so they are a probe's or a model's, not a corpus'.
    """
    if lo > hi:
        raise ValueError("the lag window is reversed")
    reach = max(abs(lo), abs(hi))
    if reach > size:
        raise ValueError(f"chunks of {size} samples are shorter than the largest lag, {reach}")
    wanted = [(r["pop_i"], r["pop_j"]) for r in pairs.select("pop_i", "pop_j").distinct().orderBy("pop_i", "pop_j").collect()]  # a matrix of channels
    total = F.aggregate("values", F.lit(0.0), lambda a, v: a + v)
    means = chunks.groupBy("pop").agg((F.sum(total) / F.sum(F.size("values"))).alias("mean"), F.sum(F.size("values")).alias("n"), F.max("chunk").alias("last"))
    centred = chunks.join(means, "pop").withColumn("values", F.transform("values", lambda v: v - F.col("mean")))
    squares = F.aggregate("values", F.lit(0.0), lambda a, v: a + v * v)
    # The samples that lags leave out: the first of chunk 0, the last of the last two chunks.
    tail = F.flatten(F.transform(F.sort_array(F.collect_list(F.when(F.col("chunk") >= F.col("last") - 1, F.struct("chunk", "values")))), lambda s: s["values"]))
    head = F.max(F.when(F.col("chunk") == 0, F.slice("values", 1, max(reach, 1))))
    sides = centred.groupBy("pop").agg(F.first("mean").alias("mean"), F.first("n").alias("n"), F.sum(squares).alias("ss"), head.alias("head"), tail.alias("_t"))
    sides = sides.select("pop", "mean", "n", "ss", "head", F.slice("_t", F.greatest(F.size("_t") - reach + 1, F.lit(1)), reach).alias("tail"))
    rows = with_halo(centred.select("pop", "chunk", "values"), ["pop"], reach)
    sums = rows.repartition("chunk").sortWithinPartitions("chunk").mapInPandas(_summed(wanted, size, lo, hi, reach), "pop_i string, pop_j string, c array<double>")

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.iloc[:1][["pop_i", "pop_j"]].assign(c=[np.sum(np.stack(pdf["c"]), axis=0)])

    whole = sums.groupBy("pop_i", "pop_j").applyInPandas(add, "pop_i string, pop_j string, c array<double>")
    of = lambda side: sides.select(*(F.col(c).alias(c + side if c != "pop" else "pop" + side) for c in sides.columns))
    return whole.join(of("_i"), "pop_i").join(of("_j"), "pop_j").mapInPandas(_views(lo, hi, eps), OUT)


def _summed(wanted: list[tuple[str, str]], size: int, lo: int, hi: int, reach: int):
    """A task's sums: per chunk the transforms of its channels, then the pairs' products."""
    n_fft = 1 << int(np.ceil(np.log2(size + hi - lo + 1)))

    def chunk(pdf: pd.DataFrame, acc: np.ndarray) -> None:
        at = {p: k for k, p in enumerate(pdf["pop"])}
        line = np.zeros((len(at), 2 * reach + size))
        for k, (before, values, after) in enumerate(zip(pdf["before"], pdf["values"], pdf["after"], strict=True)):
            line[k, reach - len(before) : reach] = before
            line[k, reach : reach + len(values)] = values
            line[k, reach + len(values) : reach + len(values) + len(after)] = after
        x = np.fft.rfft(line[:, reach + lo : reach + size + hi], n_fft)
        y = np.conj(np.fft.rfft(line[:, reach : reach + size], n_fft))
        own = [(m, at[i], at[j]) for m, (i, j) in enumerate(wanted) if i in at and j in at]
        for k in range(0, len(own), TOGETHER):
            m, i, j = (np.array(v) for v in zip(*own[k : k + TOGETHER], strict=True))
            acc[m] += np.fft.irfft(x[i] * y[j], n_fft)[:, : hi - lo + 1]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc, held, any_rows = np.zeros((len(wanted), hi - lo + 1)), None, False
        for pdf in batches:
            held = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            if len(held):
                any_rows = True
                last = held["chunk"].iloc[-1]
                for _, g in held[held["chunk"] != last].groupby("chunk"):
                    chunk(g, acc)
                held = held[held["chunk"] == last]
        if held is not None and len(held):
            chunk(held, acc)
        if any_rows:
            yield pd.DataFrame({"pop_i": [i for i, _ in wanted], "pop_j": [j for _, j in wanted], "c": list(acc)})

    return run


def _views(lo: int, hi: int, eps: float):
    """The three forms from the demeaned sums."""
    lags = np.arange(lo, hi + 1)

    def outside(values, k: np.ndarray, from_end: bool) -> np.ndarray:
        """Sums of the first (or last) k samples."""
        v = np.asarray(values, float)
        sums = np.concatenate(([0.0], np.cumsum(v[::-1] if from_end else v)))
        return sums[np.clip(k, 0, len(v))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                n, c = int(r.n_i), np.asarray(r.c, float)
                keep = np.abs(lags) < n
                k, c = lags[keep], c[keep]
                ahead, back = np.maximum(k, 0), np.maximum(-k, 0)
                left_i = -outside(r.head_i, ahead, False) - outside(r.tail_i, back, True)
                left_j = -outside(r.head_j, back, False) - outside(r.tail_j, ahead, True)
                raw = c + r.mean_j * left_i + r.mean_i * left_j + (n - np.abs(k)) * r.mean_i * r.mean_j
                d = np.sqrt(r.ss_i * r.ss_j)
                norm = c / d if d > eps else np.full(len(c), np.nan)
                out.append(pd.DataFrame({"pop_i": r.pop_i, "pop_j": r.pop_j, "lag": k, "raw": raw / n, "demeaned": c / n, "normalised": norm}))
            yield pd.concat(out, ignore_index=True) if out else pd.DataFrame(columns=[x.split()[0] for x in OUT.split(", ")])

    return run
