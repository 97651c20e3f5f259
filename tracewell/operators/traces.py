"""Traces: one row per channel with its samples as an array, and the kernels that need whole traces."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import kernels as K


def to_traces(signal: DataFrame, keys: list[str], t0: float, dt: float, order: str = "i", value: str = "v") -> DataFrame:
    """Long rows to traces: ``keys, t0, dt, values`` in the order of the sample index."""
    values = F.transform(F.sort_array(F.collect_list(F.struct(order, value))), lambda s: s[value])
    return signal.groupBy(*keys).agg(values.alias("values")).select(*keys, F.lit(t0).alias("t0"), F.lit(dt).alias("dt"), "values")


def to_long(traces: DataFrame, keys: list[str]) -> DataFrame:
    return traces.select(*keys, "t0", "dt", F.posexplode("values").alias("i", "v")).select(*keys, F.col("i").cast("long").alias("i"), (F.col("t0") + F.col("i") * F.col("dt")).alias("t"), "v")


def _rows(s: pd.Series, f) -> pd.Series:
    """Apply a kernel to rows of equal length together."""
    out: list = [None] * len(s)
    by_length: dict[int, list[int]] = {}
    for at, x in enumerate(s):
        if x is not None:
            by_length.setdefault(len(x), []).append(at)
    for where in by_length.values():
        for at, y in zip(where, f(np.stack([np.asarray(s.iloc[a], float) for a in where])), strict=True):
            out[at] = y
    return pd.Series(out)


def filtered(values: Column | str, band, fs: float, order: int = 3, btype: str = "bandpass") -> Column:
    """Zero-phase Butterworth filter of array columns, rows of one length filtered together."""
    K.butter_sos(order, band, btype, fs)  # wrong arguments fail here, not in a task

    @F.pandas_udf("array<double>")
    def run(s: pd.Series) -> pd.Series:
        return _rows(s, lambda x: list(K.filtfilt(x, band, fs, order, btype)))

    return run(values)


def smoothed(values: Column | str, sigma: float) -> Column:
    @F.pandas_udf("array<double>")
    def run(s: pd.Series) -> pd.Series:
        return _rows(s, lambda x: list(K.gaussian_smooth(x, sigma)))

    return run(values)


def welch(values: Column | str, fs: float, win_len: float = 4.0, win_overlap: float = 0.75, fmin: float = 2.0, fmax: float = 30.0, average: str = "median") -> Column:
    """``array<struct<freq, psd>>`` in a closed frequency range."""
    size = round(win_len * fs)
    overlap = round(win_overlap * size)

    @F.pandas_udf("array<struct<freq:double,psd:double>>")
    def run(s: pd.Series) -> pd.Series:
        def spectra(x):
            freq, p = K.welch(x, fs, size, overlap, average)
            keep = (freq >= fmin) & (freq <= fmax)
            return [[{"freq": float(f), "psd": float(v)} for f, v in zip(freq[keep], row[keep], strict=True)] for row in p]

        return _rows(s, spectra)

    return run(values)


def cpsd(x: Column | str, y: Column | str, fs: float, win_len: float = 0.5, win_overlap: float = 0.5, fmax: float = 100.0) -> Column:
    """``array<struct<freq, re, im>>`` of two array columns of one length up to fmax."""
    size, overlap = round(win_len * fs), round(win_overlap * win_len * fs)

    @F.pandas_udf("array<struct<freq:double,re:double,im:double>>")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for p, q in zip(a, b, strict=True):
            if p is None or q is None:
                out.append(None)
                continue
            freq, w = K.cpsd(np.asarray(p, float), np.asarray(q, float), fs, size, overlap)
            out.append([{"freq": float(f), "re": float(v.real), "im": float(v.imag)} for f, v in zip(freq, w, strict=True) if f <= fmax])
        return pd.Series(out)

    return run(x, y)


def stft(values: Column | str, fs: float, win_len: float = 0.5, win_overlap: float = 0.5, fmax: float = 100.0) -> Column:
    """``array<struct<i, freq, re, im>>``: complex spectra of windows centred at sample i."""
    size, overlap = round(win_len * fs), round(win_overlap * win_len * fs)

    @F.pandas_udf("array<struct<i:long,freq:double,re:double,im:double>>")
    def run(s: pd.Series) -> pd.Series:
        out = []
        for x in s:
            if x is None:
                out.append(None)
                continue
            freq, at, z = K.stft(np.asarray(x, float), fs, size, overlap)
            out.append([{"i": int(i), "freq": float(f), "re": float(v.real), "im": float(v.imag)} for i, row in zip(at, z, strict=True) for f, v in zip(freq, row, strict=True) if f <= fmax])
        return pd.Series(out)

    return run(values)


def crosscorr(x: Column | str, y: Column | str, fs: float, window: tuple[float, float] | None = None, demean: bool = False, normalise: bool = False) -> Column:
    """``array<struct<lag, c>>`` of two array columns of one length; lags in samples."""

    @F.pandas_udf("array<struct<lag:long,c:double>>")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for p, q in zip(a, b, strict=True):
            if p is None or q is None:
                out.append(None)
                continue
            lags = K.lag_range(window, fs, len(p))
            out.append([{"lag": int(k), "c": float(c)} for k, c in zip(lags, K.crosscorr(p, q, lags, demean, normalise), strict=True)])
        return pd.Series(out)

    return run(x, y)


def difference(traces: DataFrame, by: list[str], depth: str, n: int) -> DataFrame:
    """Size-preserving difference of any order along depth: the channels of one recording are one group (its probe)."""
    schema = traces.schema

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(depth)
        x = np.stack([np.asarray(v, float) for v in pdf["values"]])
        return pdf.assign(values=list(K.diff_keep(x, n)))

    return traces.groupBy(*by).applyInPandas(run, schema)


def windows(values: Column, size: int) -> Column:
    """``array<struct<s, values>>``: an array cut into windows before they become rows, so that no row carries the whole array."""
    starts = F.sequence(F.lit(0), F.greatest(F.size(values) - 1, F.lit(0)), F.lit(size))
    return F.transform(starts, lambda s: F.struct(s.alias("s"), F.slice(values, s + 1, F.lit(size)).alias("values")))
