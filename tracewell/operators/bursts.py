"""Oscillation events of recordings cut into windows: peaks of the spectrogram, boxes around them, merged; features of each event.

A window is a row of ``channel, chunk, values`` (see ``chunks.to_chunks``), so a recording is many tasks' work. Thresholds are
fixed, or drawn from each channel's own power in a first pass. Waveforms reach past their window's ends into a halo.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels as K

EVENTS = (
    "channel string, win_idx long, band string, peakF double, minF double, maxF double, start double, stop double, absPeakT double, dur double, ncycle double, Foct double, power double, "
    "avgpow double, npeaks int, evthresh double, filtsigcor double, CSDwvf array<double>, filtsig array<double>"
)


def resolved_bands(overrides: dict[str, tuple[float, float]] | None = None) -> dict[str, tuple[float, float]]:
    """The usual bands, with some set otherwise or added; an edge pair that doesn't increase raises."""
    bands = K.BANDS | {k: (float(a), float(b)) for k, (a, b) in (overrides or {}).items()}
    if wrong := [k for k, (a, b) in bands.items() if not a < b]:
        raise ValueError(f"bands without width: {wrong}")
    return bands


def with_halo(chunks: DataFrame, keys: list[str], halo: int) -> DataFrame:
    """Adds ``before`` and ``after``: up to ``halo`` samples of the neighbouring chunks. Each chunk sends its ends to its neighbours."""
    v = F.col("values")
    near = F.least(F.lit(halo), F.size(v))
    part = lambda to, side, x: F.struct(to.alias("chunk"), F.lit(side).alias("side"), x.alias("x"))
    parts = F.array(part(F.col("chunk"), "values", v), part(F.col("chunk") + 1, "before", F.slice(v, F.size(v) - near + 1, near)), part(F.col("chunk") - 1, "after", F.slice(v, F.lit(1), near)))
    rows = chunks.select(*keys, F.explode(parts).alias("p")).select(*keys, "p.*")
    of = lambda side: F.max(F.when(F.col("side") == side, F.col("x")))
    whole = rows.groupBy(*keys, "chunk").agg(of("values").alias("values"), of("before").alias("before"), of("after").alias("after"))
    empty = F.array().cast("array<double>")
    return whole.where("values IS NOT NULL").select(*keys, "chunk", "values", F.coalesce("before", empty).alias("before"), F.coalesce("after", empty).alias("after"))


def _power(values, fs: float, freqs: np.ndarray, normop: str, noise: float | None) -> np.ndarray | None:
    """Normalised power of a window; None of a noisy, non-finite or too short one."""
    x = np.asarray(values, float)
    if len(x) < 3 or not np.isfinite(x).all() or noise is not None and np.abs(x).max() >= noise:
        return None
    return K.normalise_power(K.morlet_power(x - x.mean(), fs, freqs), normop)


def thresholds(chunks: DataFrame, fs: float, freqs: list[float], factor: float, least: float, normop: str = "mednorm", noise: float | None = None) -> DataFrame:
    """``channel, evthresh``: mean plus ``factor`` deviations of a channel's power over all its windows, ``least`` at least."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f = np.asarray(freqs, float)
        for pdf in batches:
            found = [(c, p) for c, v in zip(pdf["channel"], pdf["values"], strict=True) if (p := _power(v, fs, f, normop, noise)) is not None]
            yield pd.DataFrame([(c, p.size, p.mean(), ((p - p.mean()) ** 2).sum()) for c, p in found], columns=["channel", "n", "mean", "m2"])

    parts = chunks.select(F.col("channel").cast("string").alias("channel"), "values").mapInPandas(run, "channel string, n long, mean double, m2 double")
    whole = parts.groupBy("channel").agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("mean"), F.sum(F.col("m2") + F.col("n") * F.col("mean") * F.col("mean")).alias("s"))
    deviation = F.sqrt(F.greatest(F.col("s") / F.col("n") - F.col("mean") * F.col("mean"), F.lit(0.0)))
    return whole.select("channel", F.greatest(F.col("mean") + factor * deviation, F.lit(float(least))).alias("evthresh"))


def own_band(lo: float, hi: float, step: float, fs: float) -> tuple[float, float]:
    """The pass band of an event's own filter: half a frequency step wider at both sides, inside (0, fs / 2)."""
    return max(lo - step / 2, lo / 2), min(hi + step / 2, (hi + fs / 2) / 2)


def event_waveform(x: np.ndarray, start: int, stop: int, band: tuple[float, float], fs: float, order: int = 2) -> tuple[np.ndarray, np.ndarray, float]:
    """Samples start..stop of x, of x filtered to the band, and their correlation (NaN without variance).

    The filter runs over a slice around the event, three periods of its lowest frequency or as far as x reaches.
    """
    reach = int(np.ceil(3 * fs / band[0]))
    a, b = max(0, start - reach), min(len(x), stop + 1 + reach)
    own = x[start : stop + 1]
    need = K.pad_length(K.butter_sos(order, band, "bandpass", fs))
    if b - a <= need:
        return own, np.full(len(own), np.nan), float("nan")
    done = K.filtfilt(x[a:b] - x[a:b].mean(), band, fs, order)[0][start - a : stop + 1 - a]
    u, v = own - own.mean(), done - done.mean()
    size = np.sqrt((u @ u) * (v @ v))
    return own, done, float(u @ v / size) if size > 0 else float("nan")


def detect(
    chunks: DataFrame, fs: float, freqs: list[float], size: int, threshold: float = 4.0, normop: str = "mednorm", end: float = 0.5, overlap: float = 0.5,
    dynamic: float | None = None, bands: dict[str, tuple[float, float]] | None = None, noise: float | None = None, halo: float = 1.0,
) -> DataFrame:
    """Events of each window of ``size`` samples, schema ``EVENTS``; times in seconds from the recording's start.

    An event has a row in each band that holds its peak's frequency, as overrides may overlap; outside of all it is unknown.

    With ``dynamic`` the threshold is each channel's own, see :func:`thresholds`; ``bands`` overrides or adds bands; windows with
    a sample of ``noise`` or more in size have none. ``halo``: seconds of the neighbours that waveforms may use.
    """
    named = resolved_bands(bands)
    rows = with_halo(chunks.select(F.col("channel").cast("string").alias("channel"), "chunk", F.col("values").cast("array<double>").alias("values")), ["channel"], int(halo * fs))
    if dynamic is None:
        rows = rows.withColumn("evthresh", F.lit(float(threshold)))
    else:
        rows = rows.join(thresholds(chunks, fs, freqs, dynamic, threshold, normop, noise), "channel")
    step = float(min(np.diff(freqs))) if len(freqs) > 1 else float(freqs[0]) / 4

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f = np.asarray(freqs, float)
        for pdf in batches:
            out = []
            for name, win, values, before, after, limit in zip(*(pdf[c] for c in ("channel", "chunk", "values", "before", "after", "evthresh")), strict=True):
                power = _power(values, fs, f, normop, noise)
                if power is None:
                    continue
                around = np.concatenate([np.nan_to_num(np.asarray(p, float)) for p in (before, values, after)])
                at, lead = win * size / fs, len(before)
                for b in K.events(power, f, fs, limit, end, overlap, named):
                    wave, own, r = event_waveform(around, lead + b["t0"], lead + b["t1"], own_band(b["min_f"], b["max_f"], step, fs), fs)
                    out += [(name, win, band, b["peak_f"], b["min_f"], b["max_f"], at + b["start"], at + b["stop"], at + b["peak_t"], b["duration"], b["ncycle"], b["octaves"], b["peak_power"], b["mean_power"], b["peaks"], limit, r, wave, own) for band in b["bands"]]
            yield pd.DataFrame(out, columns=[c.split()[0] for c in EVENTS.split(", ")])

    return rows.mapInPandas(run, EVENTS)


def peaks(chunks: DataFrame, fs: float, freqs: list[float], threshold: float = 4.0, normop: str = "mednorm", noise: float | None = None) -> DataFrame:
    """``channel, win_idx, freq, i, power``: the spectrogram's local maxima at the threshold or above."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f = np.asarray(freqs, float)
        for pdf in batches:
            out = []
            for name, win, values in zip(pdf["channel"], pdf["chunk"], pdf["values"], strict=True):
                power = _power(values, fs, f, normop, noise)
                if power is not None:
                    out += [(name, win, float(f[a]), int(b), float(power[a, b])) for a, b in K.local_maxima(power, threshold)]
            yield pd.DataFrame(out, columns=["channel", "win_idx", "freq", "i", "power"])

    return chunks.select(F.col("channel").cast("string").alias("channel"), "chunk", "values").mapInPandas(run, "channel string, win_idx long, freq double, i long, power double")
