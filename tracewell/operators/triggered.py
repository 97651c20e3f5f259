"""Event-triggered averages of recordings of any length, from counts of events per sample.

An average over events is a sum over samples of how many events stand there times the sample that lies k further, so events
are counted per sample first, and each time chunk gives its share of all lags' sums by one correlation. Events that many share a sample
cost no more than one, no epoch becomes rows, and no task holds more than a chunk and the events whose windows touch it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .chunks import SIZE
from .sta import offsets


def lag_sums(values: Column | str, at: Column | str, times: Column | str, lo: int, hi: int) -> Column:
    """``struct<total, seen, n>``, each an array over the lags lo..hi: sums over a chunk's finite samples, how many, and how many at all.

    at: places of events relative to the chunk's first sample (from -hi on), times: how many stand there.
    """

    @F.pandas_udf("struct<total:array<double>,seen:array<long>,n:array<long>>")
    def run(v: pd.Series, p: pd.Series, w: pd.Series) -> pd.DataFrame:
        out: dict[str, list] = {"total": [], "seen": [], "n": []}
        for samples, places, counts in zip(v, p, w, strict=True):
            x = np.asarray(samples, float)
            here = np.zeros(len(x) + hi - lo)
            place = np.asarray(places, np.int64) + hi
            inside = (place >= 0) & (place < len(here))
            np.add.at(here, place[inside], np.asarray(counts, float)[inside])
            good = np.isfinite(x)
            for name, y in (("total", np.where(good, x, 0.0)), ("seen", good.astype(float)), ("n", np.ones(len(x)))):
                sums = np.correlate(here, y, "valid")[::-1]
                out[name].append(sums if name == "total" else np.rint(sums).astype(np.int64))
        return pd.DataFrame(out)

    return run(values, at, times)


def averages(triggers: DataFrame, chunks: DataFrame, by: list[str], t0: float, dt: float, n: int, window: tuple[float, float], size: int = SIZE) -> DataFrame:
    """``by, k, v, n, t_rel``: the mean over all events whose whole window lies in the n samples; samples that are not finite are skipped.

    triggers: ``by, t``; chunks: ``by, chunk, values`` of ``size`` samples (:func:`chunks.to_chunks`). Events without a time are left
    out; groups without events have no rows, lags at which no sample is finite a null.
    """
    lo, hi = offsets(window, dt)
    at = triggers.select(*by, F.rint((F.col("t") - t0) / dt).try_cast("long").alias("_c")).where((F.col("_c") + lo >= 0) & (F.col("_c") + hi <= n - 1))
    counts = at.groupBy(*by, "_c").agg(F.count(F.lit(1)).alias("_w"))
    touched = F.explode(F.sequence(F.floor((F.col("_c") + lo) / F.lit(size)), F.floor((F.col("_c") + hi) / F.lit(size)))).alias("chunk")
    places = counts.select(*by, "_c", "_w", touched).groupBy(*by, "chunk").agg(F.collect_list(F.struct((F.col("_c") - F.col("chunk") * size).alias("at"), F.col("_w").alias("w"))).alias("_e"))
    sums = places.join(chunks.select(*by, "chunk", "values"), [*by, "chunk"]).where(F.size("values") > 0).select(*by, lag_sums("values", F.col("_e.at"), F.col("_e.w"), lo, hi).alias("_s"))
    lags = sums.select(*by, F.posexplode(F.arrays_zip("_s.total", "_s.seen", "_s.n")).alias("_k", "_s")).groupBy(*by, "_k").agg(F.sum("_s.total").alias("_total"), F.sum("_s.seen").alias("_seen"), F.sum("_s.n").alias("n"))
    k = F.col("_k").cast("long") + lo
    return lags.where("n > 0").select(*by, k.alias("k"), F.try_divide("_total", "_seen").alias("v"), "n", (k * dt).alias("t_rel"))
