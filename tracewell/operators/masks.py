"""Masks and intervals: runs, rasters, re-sampling, control sampling."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.kernels import interval_stream, place_controls, sample_controls


def runs(mask: DataFrame, by: list[str], order: str = "i", time: str = "t", value: str = "m") -> DataFrame:
    """Closed intervals of runs of equal states: ``by, state, t_start, t_end, n``; a run of one sample has no length."""
    w = Window.partitionBy(*by).orderBy(order)
    island = F.sum(F.coalesce((F.col(value) != F.lag(value).over(w)).cast("int"), F.lit(0))).over(w)
    marked = mask.withColumn("_island", island)
    return marked.groupBy(*by, "_island", F.col(value).alias("state")).agg(F.min(time).alias("t_start"), F.max(time).alias("t_end"), F.count(F.lit(1)).alias("n")).drop("_island")


def channel_key(y):
    """``y_<depth>`` with the depth as C's %g prints it."""
    return F.concat(F.lit("y_"), F.regexp_replace(F.format_string("%.6f", y), r"\.?0+$", ""))


def rasterise(intervals: DataFrame, grid: DataFrame, by: list[str], t0: float, dt: float, start: str = "t_start", stop: str = "t_end") -> DataFrame:
    """The grid (by.., i, t) with ``m`` = 1 where a closed interval covers the sample: intervals become index ranges, so the join is an equi-join."""
    first, last = F.ceil((F.col(start) - t0) / dt - 1e-9), F.floor((F.col(stop) - t0) / dt + 1e-9)
    ranges = intervals.where(first <= last).select(*by, start, stop, F.explode(F.sequence(first.cast("long"), last.cast("long"))).alias("i"))
    covered = ranges.where((F.col("i") * dt + t0 >= F.col(start) - 1e-12) & (F.col("i") * dt + t0 <= F.col(stop) + 1e-12)).select(*by, "i").distinct().withColumn("m", F.lit(1))
    return grid.join(covered, [*by, "i"], "left").withColumn("m", F.coalesce("m", F.lit(0)))


def resample_linear(signal: DataFrame, grid: DataFrame, t0: float, dt: float, time: str = "t", by: list[str] | None = None) -> DataFrame:
    """The signal (``by``, i, v) at the grid's times (``by``, t) by linear interpolation; null outside. Equi-joins for all groups at once."""
    keys = [*(by or []), "i"]
    at = grid.withColumn("_x", (F.col(time) - t0) / dt).withColumn("i", F.floor("_x").cast("long"))
    left = signal.select(*keys, F.col("v").alias("_a"))
    right = signal.select(*keys[:-1], (F.col("i") - 1).alias("i"), F.col("v").alias("_b"))
    both = at.join(left, keys, "left").join(right, keys, "left")
    share = F.col("_x") - F.col("i")
    return both.withColumn("v", F.when(share == 0, F.col("_a")).otherwise(F.col("_a") + (F.col("_b") - F.col("_a")) * share)).drop("_x", "_a", "_b", "i")


def resample_nearest(signal: DataFrame, grid: DataFrame, t0: float, dt: float, time: str = "t", by: list[str] | None = None) -> DataFrame:
    """The nearest sample (the earlier one on ties) at the grid's times, of each group of ``by``; null outside."""
    at = grid.withColumn("i", F.ceil((F.col(time) - t0) / dt - 0.5).cast("long"))
    return at.join(signal.select(*(by or []), "i", "v"), [*(by or []), "i"], "left").drop("i")


def conditional_means(df: DataFrame, by: list[str], mask: str = "m", value: str = "v") -> DataFrame:
    """Means inside and outside of a mask, and the share inside."""
    inside = F.col(mask) > 0
    return df.groupBy(*by).agg(F.avg(F.when(inside, F.col(value))).alias("mean_in"), F.avg(F.when(~inside, F.col(value))).alias("mean_out"), F.avg(inside.cast("double")).alias("fraction"))


def control_intervals(intervals: DataFrame, seed: int = 0, tries: int = 100, independent: bool = False, channel: str = "channel") -> DataFrame:
    """``channel, k, t_start, t_end, seed``: for every interval of state 1 a random one of its length in state 0, without overlap.

    One generator serves all channels in the order of their names, so this is one task over the (small) interval table; with
    ``independent`` each channel is a task, and each draw a function of seed, channel, interval and try alone: other channels,
    the order of rows and lost tasks leave it as it is.
    """
    if independent:
        return _independent(intervals, seed, tries, channel)

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        units = {}
        for name, g in pdf.sort_values([channel, "t_start"]).groupby(channel, sort=True):
            cut = lambda s, g=g: [tuple(x) for x in g[g["state"] == s][["t_start", "t_end"]].to_numpy()]
            units[name] = (cut(1), cut(0))
        found, used = sample_controls(units, seed, tries)
        return pd.DataFrame([(name, k, a, b, used) for name, rows in found.items() for k, (a, b) in enumerate(rows)], columns=["channel", "k", "t_start", "t_end", "seed"])

    schema = "channel string, k long, t_start double, t_end double, seed long"
    rows = intervals.select(F.col(channel).alias("channel"), "state", "t_start", "t_end") if channel == "channel" else intervals.withColumnRenamed(channel, "channel")
    return rows.groupBy(F.lit(1).alias("_all")).applyInPandas(lambda pdf: place(pdf), schema)


def _independent(intervals: DataFrame, seed: int, tries: int, channel: str) -> DataFrame:
    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        name = pdf["channel"].iloc[0]
        of = lambda s: sorted(tuple(x) for x in pdf[pdf["state"] == s][["t_start", "t_end"]].to_numpy())
        on, off = of(1), of(0)
        for t in range(tries):
            found = place_controls([b - a for a, b in on], off, lambda k, t=t: interval_stream(seed, str(name), k, t))
            if found is not None:
                return pd.DataFrame([(name, k, a, b, seed + t) for k, (a, b) in enumerate(found)], columns=["channel", "k", "t_start", "t_end", "seed"])
        raise RuntimeError(f"no placement without overlap was found in {name}")

    rows = intervals.select(F.col(channel).cast("string").alias("channel"), "state", "t_start", "t_end")
    return rows.groupBy("channel").applyInPandas(place, "channel string, k long, t_start double, t_end double, seed long")
