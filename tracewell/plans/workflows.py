"""Whole analyses as one plan each: rates to spectra, populations against a reference, events of a probe."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import bursts as U
from ..operators import chunks as H
from ..operators import events as E
from ..operators import masks as M
from ..operators import pairs as C
from ..operators import spikes as R
from ..operators import traces as T
from ..operators import windows as W
from ..operators.select import between


#: Samples of a reference trace that every executor may hold (128 MB).
REFERENCE = 16_000_000


def rate_spectra(spikes: DataFrame, units: DataFrame, keys: list[str], t1: float, t2: float, dt: float, tau: float | None = None, win_len: float = 4.0, overlap: float = 0.75, fmin: float = 2.0, fmax: float = 30.0, cells: str | None = None) -> DataFrame:
    """``keys, freq, psd``: spikes to binned rates, smoothed if asked, to Welch spectra; over all jobs at once if keys has the job."""
    rates = R.rate_dynamics(spikes, units, keys, t1, t2, dt, cells=cells)
    traces = T.to_traces(rates, keys, t1, dt, "bin", "rate")
    values = T.smoothed("values", tau / dt) if tau else F.col("values")
    spectra = traces.withColumn("values", values).select(*keys, F.explode(T.welch("values", round(1 / dt, 5), win_len, overlap, fmin, fmax)).alias("s"))
    return spectra.select(*keys, "s.freq", "s.psd")


def against_reference(rates: DataFrame, reference: DataFrame, n: int, dt: float, t0: float, ref_t0: float, ref_dt: float, win_len: float, overlap: float, band: tuple[float, float], mult: float = 1.0, digits: int = 6) -> DataFrame:
    """``pop, amp, phase`` of each population's cross spectrum with one reference trace.

    rates: ``pop, i, v`` on a grid of n samples; reference: ``i, v`` on its own grid, interpolated onto it. Both are demeaned; a
    population whose spectrum is not finite has NaN. The reference is one trace, so it is broadcast; a longer one than fits is refused.
    """
    if n > REFERENCE:
        raise ValueError(f"a reference of {n} samples is too long to be broadcast; cut the rates into parts of {REFERENCE}")
    grid = rates.sparkSession.range(n).select(F.col("id").alias("k"), (F.col("id") * dt + t0).alias("t"))
    ref = M.resample_linear(reference.select("i", "v"), grid, ref_t0, ref_dt).select(F.lit("ref").alias("pop"), F.col("k").alias("i"), "v").where("v IS NOT NULL")
    both = W.demean(rates.select("pop", "i", "v"), ["pop"]).join(F.broadcast(ref.select("i")), "i", "left_semi")
    x = T.to_traces(both, ["pop"], t0, dt)
    y = T.to_traces(W.demean(ref, ["pop"]), ["pop"], t0, dt).select(F.col("values").alias("ref"))
    pairs = x.join(F.broadcast(y), F.lit(True)).select("pop", F.explode(T.cpsd("values", "ref", 1 / dt, win_len, overlap, band[1])).alias("w"))
    spectrum = pairs.select(F.col("pop").alias("pop_i"), F.lit("ref").alias("pop_j"), "w.freq", "w.re", "w.im")
    out = C.summarise_cpsd(spectrum, band[0], band[1], mult)
    return out.select(F.col("pop_i").alias("pop"), F.bround("amp", digits).alias("amp"), F.bround("phase", digits).alias("phase"))


def sliding_phase(signal: DataFrame, pairs: DataFrame, size: int, step: int, n: int, k_lo: int, k_hi: int, fs: float) -> DataFrame:
    """``pop_i, pop_j, seg, phase, resultant``: phase of each window's band mean, and the mean resultant length over windows."""
    dft = C.segment_dft(signal, size, step, n, k_lo, k_hi, fs)
    a = dft.select(F.col("pop").alias("pop_i"), "seg", "k", F.col("re").alias("ar"), F.col("im").alias("ai"))
    b = dft.select(F.col("pop").alias("pop_j"), "seg", "k", F.col("re").alias("br"), F.col("im").alias("bi"))
    z = a.join(pairs, "pop_i").join(b, ["pop_j", "seg", "k"]).groupBy("pop_i", "pop_j", "seg").agg(F.avg(F.col("ar") * F.col("br") + F.col("ai") * F.col("bi")).alias("re"), F.avg(F.col("ar") * F.col("bi") - F.col("ai") * F.col("br")).alias("im"))
    size_ = F.hypot("re", "im")
    by = Window.partitionBy("pop_i", "pop_j")
    unit = z.withColumn("ur", F.try_divide("re", size_)).withColumn("ui", F.try_divide("im", size_))
    return unit.select("pop_i", "pop_j", "seg", F.atan2("im", "re").alias("phase"), F.hypot(F.avg("ur").over(by), F.avg("ui").over(by)).alias("resultant"))


def prepare(signal: DataFrame, t1: float | None, t2: float | None, repair: bool = True, current: bool = False) -> DataFrame:
    """``y, i, t, v, repaired`` of a probe: slice, repair, (second difference along depth), demean, in this order."""
    out = between(between(signal, "t", None, t2), "t", t1, None).select("y", "i", "t", "v")
    out = W.repair_outliers(out, ["y"]) if repair else out.withColumn("repaired", F.lit(False))
    if current:
        out = W.csd(out)
    return W.demean(out, ["y"])


def probe_events(
    signal: DataFrame, fs: float, freqs: list[float], bands: list[str], t1: float = 0.0, t2: float | None = None, winsz: float = 10.0, threshold: float = 4.0, ncycle_min: float | None = None, current: bool = False,
    dynamic: float | None = None, overrides: dict[str, tuple[float, float]] | None = None, filtsigcor_min: float | None = None, overlap: float = 0.5,
) -> DataFrame:
    """Canonical event rows of every depth of a probe, channels in one job, windows of a recording in many tasks."""
    ready = prepare(signal, t1, t2, current=current).withColumn("channel", F.col("y").cast("string"))
    size = int(winsz * fs)
    chunks = H.to_chunks(counted_from(ready, t1, fs), ["channel"], size)
    return raw_events(U.detect(chunks, fs, freqs, size, threshold, overlap=overlap, dynamic=dynamic, bands=overrides), bands, t1, ncycle_min, filtsigcor_min)


def counted_from(signal: DataFrame, t1: float, fs: float) -> DataFrame:
    """Sample indices that count from t1, where the first window begins."""
    return signal.withColumn("i", F.round((F.col("t") - t1) * fs).cast("long"))


def raw_events(found: DataFrame, bands: list[str], t1: float = 0.0, ncycle_min: float | None = None, filtsigcor_min: float | None = None) -> DataFrame:
    """Detected events in canonical form; times were seconds."""
    ms = lambda c, name: (F.col(c) * 1000).alias(name)
    raw = found.select(F.col("channel").cast("double").alias("chan"), "band", "peakF", "minF", "maxF", "ncycle", "Foct", ms("absPeakT", "absPeakT"), ms("start", "absminT"), ms("stop", "absmaxT"), ms("dur", "dur"), "avgpow", "filtsigcor", "CSDwvf", "filtsig")
    return E.normalise(raw, bands, t1, ncycle_min=ncycle_min, filtsigcor_min=filtsigcor_min)


def event_mask(events: DataFrame, signal: DataFrame, t0: float, dt: float, keep: tuple[str, ...] = ()) -> DataFrame:
    """``y, i, m``: samples within passed events of their depth; i counts from t0. ``keep`` names more columns of the signal."""
    spans = E.passed(events).select(F.col("chan").alias("y"), F.col("start_time_s").alias("t_start"), F.col("stop_time_s").alias("t_end"))
    return M.rasterise(spans, signal.select("y", "i", *keep), ["y"], t0, dt)


def spectrograms(traces: DataFrame, fs: float, freqs: list[float], winsz: float = 10.0, normop: str = "mednorm", cycles: float = 7.0, channel: str = "channel") -> DataFrame:
    """``channel, win_idx, i0, freq, power``: normalised Morlet power of each window, a row per frequency; noisy (non-finite) windows have none."""
    size = int(winsz * fs)
    rows = traces.select(F.col(channel).alias("channel"), F.explode(T.windows(F.col("values"), size)).alias("w"))
    return chunk_spectrograms(rows.select("channel", (F.col("w.s") / size).cast("long").alias("chunk"), "w.values"), fs, freqs, size, normop, cycles)


def chunk_spectrograms(chunks: DataFrame, fs: float, freqs: list[float], size: int, normop: str = "mednorm", cycles: float = 7.0) -> DataFrame:
    """The same of windows that are rows already (``channel, chunk, values``)."""
    import numpy as np
    import pandas as pd

    from ..functions import kernels as K

    rows = chunks.select(F.col("channel").cast("string").alias("channel"), "chunk", "values")

    def run(batches):
        f = np.asarray(freqs, float)
        for pdf in batches:
            out = []
            for name, win, v in zip(pdf["channel"], pdf["chunk"], pdf["values"], strict=True):
                x = np.asarray(v, float)
                if len(x) > 2 and np.isfinite(x).all():
                    power = K.normalise_power(K.morlet_power(x - x.mean(), fs, f, cycles), normop)
                    out += [(name, win, win * size, float(q), row) for q, row in zip(f, power, strict=True)]
            yield pd.DataFrame(out, columns=["channel", "win_idx", "i0", "freq", "power"])

    return rows.mapInPandas(run, "channel string, win_idx long, i0 long, freq double, power array<double>")


def stitched(bundle: DataFrame) -> DataFrame:
    """``channel, freq, power``: windows joined in their order; the frequency axes of channels must agree."""
    marks = bundle.select("channel", "freq").distinct().groupBy("channel").agg(F.struct(F.count(F.lit(1)), F.min("freq"), F.max("freq"), F.sum(F.xxhash64("freq").cast("decimal(20,0)"))).alias("a"))
    axes = marks.agg(F.countDistinct("a")).first()[0]
    if axes > 1:
        raise ValueError("channels differ in their frequencies")
    parts = F.sort_array(F.collect_list(F.struct("win_idx", "power")))
    return bundle.groupBy("channel", "freq").agg(F.flatten(F.transform(parts, lambda s: s["power"])).alias("power"))


def n_windows(n: int, size: int, step: int) -> int:
    return max(0, math.floor((n - size) / step) + 1)
