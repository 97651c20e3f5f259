"""Event trains: extraction, rates, interval statistics, binned rates on a dense grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def members(spikes: DataFrame, cells: DataFrame) -> DataFrame:
    """Spikes of the given cells (semi-join on gid)."""
    return spikes.join(cells.select("gid").distinct(), "gid", "left_semi")


def extract(spikes: DataFrame, cells: DataFrame, t_limits: tuple[float | None, float | None] = (None, None), subtract_t0: bool = False, ms: bool = False, ndigits: int = 6) -> DataFrame:
    """``pop, gid, t``: spikes of cells in a closed window of seconds, shifted, scaled and rounded half to even."""
    lo, hi = t_limits
    out = spikes.drop("pop").join(cells.select("gid", "pop"), "gid")
    if lo is not None:
        out = out.where(F.col("t") >= lo)
    if hi is not None:
        out = out.where(F.col("t") <= hi)
    t = (F.col("t") - F.lit(float(lo or 0.0) if subtract_t0 else 0.0)) * (1000.0 if ms else 1.0)
    return out.select("pop", "gid", F.bround(t, ndigits).alias("t"))


def combine(spikes: DataFrame, keys: list[str]) -> DataFrame:
    """One sorted train per key: ``times`` array. Trains that are combined already raise."""
    if "times" in spikes.columns:
        raise ValueError("the trains are combined already")
    return spikes.groupBy(*keys).agg(F.sort_array(F.collect_list("t")).alias("times"))


def trains(spikes: DataFrame, cells: DataFrame) -> DataFrame:
    """A train per cell, empty ones included."""
    return cells.select("pop", "gid").join(combine(spikes, ["gid"]), "gid", "left").withColumn("times", F.coalesce("times", F.array().cast("array<double>")))


def pop_sizes(pops: DataFrame, cells: DataFrame) -> DataFrame:
    """Cells per population; empty populations have 0."""
    return pops.select("pop").join(cells.groupBy("pop").agg(F.countDistinct("gid").alias("n_cells")), "pop", "left").withColumn("n_cells", F.coalesce("n_cells", F.lit(0).cast("long")))


def rates(spikes: DataFrame, units: DataFrame, keys: list[str], t1: float, t2: float, cells: Column | None = None) -> DataFrame:
    """Spikes a second in a closed window per unit; units without spikes have 0. ``cells`` divides pooled rates."""
    if t2 <= t1:
        raise ValueError("the window is empty")
    n = F.count_if((F.col("t") >= t1) & (F.col("t") <= t2))
    found = spikes.groupBy(*keys).agg(n.alias("n"))
    rate = F.coalesce("n", F.lit(0)) / F.lit(t2 - t1)
    return units.join(found, keys, "left").withColumn("rate", rate if cells is None else F.try_divide(rate, cells)).drop("n")


def interval_cv(spikes: DataFrame, t1: float, t2: float, least: int = 3) -> DataFrame:
    """``pop, gid, cv``: population deviation over mean of a cell's intervals; cells with fewer spikes are left out."""
    past = F.lag("t").over(Window.partitionBy("pop", "gid").orderBy("t"))
    d = spikes.where(F.col("t").between(t1, t2)).select("pop", "gid", (F.col("t") - past).alias("d"))
    return d.groupBy("pop", "gid").agg(F.try_divide(F.stddev_pop("d"), F.avg("d")).alias("cv"), F.count(F.lit(1)).alias("n_spikes")).where(F.col("n_spikes") >= least)


def pop_cv(cell_cv: DataFrame) -> DataFrame:
    return cell_cv.groupBy("pop").agg(F.avg("cv").alias("cv"), F.count(F.lit(1)).alias("n_cells"))


def dense(units: DataFrame, counts: DataFrame, keys: list[str], n_bins: int) -> DataFrame:
    """Counts on the full grid of units and bins, zeros included: bins are generated per unit, not joined across."""
    grid = units.select(*keys).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_bins - 1).cast("long"))))
    return grid.join(counts, [*keys, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def rate_dynamics(spikes: DataFrame, units: DataFrame, keys: list[str], t1: float, t2: float, dt: float, epoch: float | None = None, cells: str | None = None, digits: int | None = None) -> DataFrame:
    """Binned rates of units on a dense grid: ``keys, bin, t, rate``.

    Bins are half-open, the last edge belongs to none. With ``epoch`` whole epochs are folded onto the first. ``cells`` names a
    column of units by which rates are divided; 0 cells give NaN. ``digits`` rounds times before binning.
    """
    t = F.bround("t", digits) if digits is not None else F.col("t")
    epochs = 1
    if epoch is not None:
        epochs = int((t2 - t1) // epoch)
        if epochs < 1:
            raise ValueError("the window is shorter than an epoch")
        t2 = t1 + epochs * epoch
    inside = spikes.withColumn("t", t).where((F.col("t") >= t1) & (F.col("t") <= t2))
    if epoch is not None:
        inside = inside.where(F.col("t") < t2).withColumn("t", F.pmod(F.col("t") - t1, F.lit(epoch)) + t1)
        t2 = t1 + epoch
    n_bins = int((t2 - t1) / dt)
    counts = inside.groupBy(*keys, F.floor((F.col("t") - t1) / dt).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    out = dense(units, counts, keys, n_bins)
    rate = F.col("n") / F.lit(dt * epochs)
    if cells:
        out = out.join(units.select(*keys, cells).distinct(), keys)
        rate = F.when(F.col(cells) == 0, F.lit(float("nan"))).otherwise(F.try_divide(rate, F.col(cells)))
    return out.select(*keys, "bin", (F.col("bin") * dt + t1).alias("t"), rate.alias("rate"))
