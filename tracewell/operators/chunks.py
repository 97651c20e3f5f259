"""Recordings of any length: a trace is rows of time chunks, and recursive filters run along them by a scan of states.

A filter's state after a chunk is linear in the state before it: ``A^n s + b``, where b is what the chunk leaves of a zero
state. These pairs compose, so chunks are summarised in parallel, groups of summaries are composed level by level, and each
chunk is then filtered once more from the state that it really starts with. No task holds more of a trace than some chunks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..sources import files

SIZE = 4096
#: Summaries that one group composes.
WIDTH = 256
#: Rows that a kernel takes together.
TOGETHER = 256


def to_chunks(signal: DataFrame, keys: list[str], size: int = SIZE, order: str = "i", value: str = "v") -> DataFrame:
    """Long rows to ``keys, chunk, values``: the samples of chunk * size .. in their order."""
    at = F.floor(F.col(order) / F.lit(size)).cast("long").alias("chunk")
    values = F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).cast("double").alias("v")))), lambda s: s["v"])
    return signal.groupBy(*keys, at).agg(values.alias("values"))


def to_long(chunks: DataFrame, keys: list[str], size: int = SIZE) -> DataFrame:
    rows = chunks.select(*keys, "chunk", F.posexplode("values").alias("p", "v"))
    return rows.select(*keys, (F.col("chunk") * size + F.col("p")).alias("i"), "v")


def _same(schema: str, keys: list[str], df: DataFrame) -> str:
    return ", ".join([*(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys), schema])


def _by_length(values: list[np.ndarray]) -> Iterator[tuple[list[int], np.ndarray]]:
    """Row numbers and their values stacked, of one length and no more than TOGETHER at a time."""
    of: dict[int, list[int]] = {}
    for at, v in enumerate(values):
        of.setdefault(len(v), []).append(at)
    for rows in of.values():
        for i in range(0, len(rows), TOGETHER):
            part = rows[i : i + TOGETHER]
            yield part, np.stack([values[r] for r in part])


def _flat(states: np.ndarray) -> np.ndarray:
    """(sections, rows, 2) as (rows, 2 * sections)."""
    return states.transpose(1, 0, 2).reshape(states.shape[1], -1)


def _states(flat: np.ndarray) -> np.ndarray:
    return flat.reshape(len(flat), -1, 2).transpose(1, 0, 2).copy()


def _step_matrix(sos: np.ndarray) -> np.ndarray:
    """A: the state after one zero sample, of each unit state (as a row vector's matrix)."""
    m = 2 * len(sos)
    return _flat(K.sosfilt_on(sos, np.zeros((m, 1)), _states(np.eye(m)))[1])


def scan(summaries: DataFrame, keys: list[str], step: np.ndarray, width: int = WIDTH) -> DataFrame:
    """``keys, chunk, state``: the state before each chunk, from ``keys, chunk, n, b`` whose first chunk's b is the state that it leaves.

    Groups of ``width`` neighbours are composed, their summaries scanned in the same way, and the states dealt back.
    """
    power = {}

    def after(state: np.ndarray, n: int) -> np.ndarray:
        if n not in power:
            power[n] = np.linalg.matrix_power(step, n)
        return state @ power[n]

    state = _same("chunk long, state array<double>", keys, summaries)
    lo, hi = summaries.agg(F.min("chunk"), F.max("chunk")).first()
    if lo is None:
        return summaries.select(*keys, "chunk", F.col("b").alias("state"))
    group = F.floor((F.col("chunk") - lo) / width).cast("long")
    grouped = summaries.withColumn("_g", group)

    def compose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, total, n = pdf.sort_values("chunk"), None, 0
        for m, b in zip(pdf["n"], pdf["b"], strict=True):
            total = np.asarray(b) if total is None else after(total, m) + b
            n += int(m)
        return pdf.iloc[:1][keys].assign(chunk=pdf["_g"].iloc[0], n=n, b=[total])

    def spread(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, out = pdf.sort_values("chunk"), []
        s = pdf["state"].iloc[0]
        s = np.zeros(len(step)) if s is None else np.asarray(s)
        for m, b in zip(pdf["n"], pdf["b"], strict=True):
            out.append(s)
            s = after(s, m) + b
        return pdf[[*keys, "chunk"]].assign(state=out)

    if hi - lo < width:
        return grouped.withColumn("state", F.lit(None).cast("array<double>")).groupBy(*keys, "_g").applyInPandas(spread, state)
    above = grouped.groupBy(*keys, "_g").applyInPandas(compose, _same("chunk long, n long, b array<double>", keys, summaries))
    above = files.written(above, "scan")
    before = scan(above, keys, step, width).withColumnRenamed("chunk", "_g")
    return grouped.join(before, [*keys, "_g"], "left").groupBy(*keys, "_g").applyInPandas(spread, state)


def sosfilt(chunks: DataFrame, keys: list[str], sos: np.ndarray, settled: bool = True, width: int = WIDTH) -> DataFrame:
    """Chunks filtered in their order, from the state of a long constant input equal to the first sample (or from rest)."""
    zi = K.steady_state(sos).reshape(-1)
    step = _step_matrix(sos)
    first = chunks.groupBy(*keys).agg(F.min("chunk").alias("_first"))
    marked = chunks.join(first, keys).withColumn("_first", F.col("chunk") == F.col("_first"))
    out = _same("chunk long, n long, b array<double>", keys, chunks)

    def start(pdf: pd.DataFrame, values: list[np.ndarray]) -> np.ndarray:
        s = np.zeros((len(pdf), len(zi)))
        if settled:
            for r in np.flatnonzero(pdf["_first"]):
                s[r] = zi * values[r][0]
        return s

    def left(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            values = [np.asarray(v, float) for v in pdf["values"]]
            begun, b = start(pdf, values), [None] * len(pdf)
            for rows, x in _by_length(values):
                for r, s in zip(rows, _flat(K.sosfilt_on(sos, x, _states(begun[rows]))[1]), strict=True):
                    b[r] = s
            yield pdf[[*keys, "chunk"]].assign(n=[len(v) for v in values], b=b)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            values = [np.asarray(v, float) for v in pdf["values"]]
            begun = start(pdf, values)
            for r in np.flatnonzero(~pdf["_first"].to_numpy(bool)):
                begun[r] = pdf["state"].iloc[r]
            done = [None] * len(pdf)
            for rows, x in _by_length(values):
                for r, y in zip(rows, K.sosfilt_on(sos, x, _states(begun[rows]))[0], strict=True):
                    done[r] = y
            yield pdf[[*keys, "chunk"]].assign(values=done)

    summaries = files.written(marked.mapInPandas(left, out), "states")
    states = scan(summaries, keys, step, width)
    return marked.join(states, [*keys, "chunk"]).mapInPandas(run, _same("chunk long, values array<double>", keys, chunks))


def extended(chunks: DataFrame, keys: list[str], pad: int) -> DataFrame:
    """Chunks with one more before the first and one after the last: ``pad`` samples turned about the end ones. Too short traces raise."""
    n = F.size("values")
    ends = chunks.groupBy(*keys).agg(F.min("chunk").alias("_lo"), F.max("chunk").alias("_hi"), F.max(n).alias("_size"))
    placed = chunks.join(ends, keys)
    near = F.floor((F.lit(pad) + F.col("_size")) / F.col("_size"))  # full chunks that hold pad + 1 samples; the last chunk may be shorter
    whole = F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("chunk", "values"))), lambda s: s["values"])).alias("x")
    head = placed.where(F.col("chunk") - F.col("_lo") <= near).groupBy(*keys).agg(whole, F.min("_lo").alias("chunk"))
    tail = placed.where(F.col("_hi") - F.col("chunk") <= near).groupBy(*keys).agg(whole, F.max("_hi").alias("chunk"))
    size = F.size("x")
    enough = F.when(size > pad, F.col("x")).otherwise(F.raise_error(F.lit(f"a trace must be longer than {pad} samples")).cast("array<double>"))

    def turned(x: Column, about: Column) -> Column:
        return F.transform(F.reverse(x), lambda v: 2 * about - v)

    before = head.select(*keys, (F.col("chunk") - 1).alias("chunk"), turned(F.slice(enough, 2, pad), F.element_at("x", 1)).alias("values"))
    after = tail.select(*keys, (F.col("chunk") + 1).alias("chunk"), turned(F.slice(enough, size - pad, F.lit(pad)), F.element_at("x", -1)).alias("values"))
    return chunks.select(*keys, "chunk", "values").unionByName(before).unionByName(after)


def filtered(chunks: DataFrame, keys: list[str], band, fs: float, order: int = 3, btype: str = "bandpass", width: int = WIDTH) -> DataFrame:
    """Zero-phase Butterworth filter of chunked traces, ``keys, chunk, values``; chunks may have any sizes."""
    sos = K.butter_sos(order, band, btype, fs)
    pad = K.pad_length(sos)

    def reversed_(df: DataFrame) -> DataFrame:
        return df.select(*keys, (-F.col("chunk")).alias("chunk"), F.reverse("values").alias("values"))

    there = files.written(sosfilt(files.written(extended(chunks, keys, pad), "extended"), keys, sos, width=width), "forward")
    back = reversed_(sosfilt(reversed_(there), keys, sos, width=width))
    return back.join(chunks.select(*keys, "chunk"), [*keys, "chunk"], "left_semi")
