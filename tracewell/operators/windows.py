"""Stencils along time, depth and frequency over long tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quantiles import all_small, exact_quantiles


def difference(df: DataFrame, by: list[str], order: str, value: str = "v", n: int = 1) -> DataFrame:
    """Size-preserving n-th difference of neighbours along an order: n = 1 forward (0 at the end), n = 2 central with replicated edges."""
    w = Window.partitionBy(*by).orderBy(order)
    v = F.col(value)
    ahead = F.coalesce(F.lead(v).over(w), v)
    if n == 1:
        return df.withColumn(value, ahead - v)
    if n == 2:
        return df.withColumn(value, ahead - 2 * v + F.coalesce(F.lag(v).over(w), v))
    raise ValueError("long tables have differences of order 1 and 2; use traces for others")


def bipolar(df: DataFrame, time: str = "i", depth: str = "y", value: str = "v") -> DataFrame:
    return difference(df, [time], depth, value, 1)


def csd(df: DataFrame, time: str = "i", depth: str = "y", value: str = "v") -> DataFrame:
    return difference(df, [time], depth, value, 2)


def csd_traces(traces: DataFrame, depth: str = "y", by: list[str] | None = None) -> DataFrame:
    """The second difference along depth of whole traces: neighbours are array rows, so nothing is exploded."""
    w = Window.partitionBy(*(by or [])).orderBy(depth)
    up, down = F.coalesce(F.lead("values").over(w), F.col("values")), F.coalesce(F.lag("values").over(w), F.col("values"))
    return traces.withColumn("values", F.zip_with(F.zip_with(up, down, lambda a, b: a + b), "values", lambda s, v: s - 2 * v))


def finite(c: Column | str) -> Column:
    """The value, or null where it is NaN, so that aggregates skip it."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(~F.isnan(c), c)


def with_stat(df: DataFrame, by: list[str], stat: Column, name: str) -> DataFrame:
    """An aggregate of each group beside its rows: partial sums and a join with one row a group, so no group is one task's rows."""
    keys = {k: f"_k{i}" for i, k in enumerate(by)}
    stats = df.groupBy(*(F.col(k).alias(n) for k, n in keys.items())).agg(stat.alias(name))
    if not by:
        return df.crossJoin(stats)  # one row
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(n)) for k, n in keys.items()])
    return df.join(stats, same).drop(*keys.values())


def demean(df: DataFrame, by: list[str], value: str = "v") -> DataFrame:
    return with_stat(df, by, F.avg(finite(value)), "_mean").withColumn(value, F.col(value) - F.col("_mean")).drop("_mean")


def band_normalise(df: DataFrame, by: list[str], lo: float, hi: float, freq: str = "freq", value: str = "psd") -> DataFrame:
    """Divide by the mean over the closed band."""
    rows = with_stat(df, by, F.avg(F.when(F.col(freq).between(lo, hi), finite(value))), "_mean")
    return rows.withColumn(value, F.try_divide(F.col(value), F.col("_mean"))).drop("_mean")


def rolling_mean(df: DataFrame, by: list[str], order: str, width: int, value: str = "psd") -> DataFrame:
    """Centred mean of ``width`` rows, of those there are at the edges."""
    if width <= 1:
        return df
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(-(width // 2), width - 1 - width // 2)
    return df.withColumn(value, F.avg(finite(value)).over(w))


def unit_deviation(df: DataFrame, by: list[str], value: str = "v") -> DataFrame:
    return with_stat(df, by, F.stddev_pop(value), "_sd").withColumn(value, F.try_divide(F.col(value), F.col("_sd"))).drop("_sd")


def peaks(df: DataFrame, by: list[str], order: str, height: float, value: str = "v") -> DataFrame:
    """Rows above both neighbours and at least ``height``."""
    w = Window.partitionBy(*by).orderBy(order)
    around = df.withColumn("_l", F.lag(value).over(w)).withColumn("_r", F.lead(value).over(w))
    return around.where((F.col(value) > F.col("_l")) & (F.col(value) > F.col("_r")) & (F.col(value) >= height)).drop("_l", "_r")


def repair_outliers(df: DataFrame, by: list[str], order: str = "i", time: str = "t", value: str = "v", z: float = 8.0, rel: float = 5.0) -> DataFrame:
    """Replace isolated spikes by interpolation in time; adds ``repaired``.

    A sample is one if both neighbours are on one side of it, and its distance from their mean exceeds the robust spread of
    the steps (median plus z times 1.4826 times the median absolute deviation) and rel times the neighbours' distance, and
    no neighbour is one as well.
    """
    group, w = Window.partitionBy(*by), Window.partitionBy(*by).orderBy(order)
    c, left, right = F.col(value), F.lag(value).over(w), F.lead(value).over(w)
    rows = df.withColumn("_l", left).withColumn("_r", right).withColumn("_tl", F.lag(time).over(w)).withColumn("_tr", F.lead(time).over(w)).withColumn("_d", F.abs(c - F.col("_l")))
    # A sample's step is to the one before; the spread is of the steps' sizes.
    small = all_small(df, by)  # steps are no more than samples
    steps = exact_quantiles(rows, by, "_d", {"_med": 0.5}, small=small)
    spread = steps.join(exact_quantiles(rows.join(steps, by), by, F.abs(F.col("_d") - F.col("_med")), {"_mad": 0.5}, small=small), by)
    rows = rows.join(spread, by, "left")
    off = F.abs(c - (F.col("_l") + F.col("_r")) / 2)
    limit = F.greatest(F.col("_med") + z * 1.4826 * F.col("_mad"), F.lit(2.220446049250313e-16))
    flag = ((c - F.col("_l")) * (c - F.col("_r")) > 0) & (off > limit) & (off > rel * F.abs(F.col("_r") - F.col("_l")))
    rows = rows.withColumn("_f", F.coalesce(flag, F.lit(False)))
    lone = F.col("_f") & ~F.coalesce(F.lag("_f").over(w), F.lit(False)) & ~F.coalesce(F.lead("_f").over(w), F.lit(False)) & (F.count(F.lit(1)).over(group) >= 3)
    share = (F.col(time) - F.col("_tl")) / (F.col("_tr") - F.col("_tl"))
    fixed = F.col("_l") + (F.col("_r") - F.col("_l")) * share
    return rows.withColumn("repaired", lone).withColumn(value, F.when(F.col("repaired"), fixed).otherwise(c)).select(*df.columns, "repaired")


def gaussian_smooth(df: DataFrame, by: list[str], order: str, n: int, sigma: float, value: str = "v", truncate: float = 4.0) -> DataFrame:
    """Gaussian smoothing of complete rows 0..n-1; indices beyond an edge reflect. An equi-join on reflected indices."""
    import math

    radius = int(truncate * sigma + 0.5)
    weights = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-radius, radius + 1)]
    total = sum(weights)
    kernel = F.array(*[F.struct(F.lit(k).cast("long").alias("k"), F.lit(x / total).alias("w")) for k, x in zip(range(-radius, radius + 1), weights, strict=True)])
    at = F.pmod(F.col(order) + F.col("k.k"), F.lit(2 * n))
    reach = df.select(*by, order, F.explode(kernel).alias("k")).select(*by, order, F.when(at >= n, 2 * n - 1 - at).otherwise(at).alias("_at"), F.col("k.w").alias("_w"))
    near = df.select(*by, F.col(order).alias("_at"), F.col(value).alias("_v"))
    return reach.join(near, [*by, "_at"]).groupBy(*by, order).agg(F.sum(F.col("_w") * F.col("_v")).alias(value))
