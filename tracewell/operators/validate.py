"""Checks that raise ValueError; each is one aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def regular_time(df: DataFrame, by: list[str] | None = None, time: str = "t", rtol: float = 1e-5, atol: float = 1e-8) -> float:
    """The common step of strictly increasing, regular times with two samples at least."""
    w = Window.partitionBy(*(by or [F.lit(1)])).orderBy(time)
    d = df.withColumn("_d", F.col(time) - F.lag(time).over(w))
    lo, hi, n = d.agg(F.min("_d"), F.max("_d"), F.count("_d")).first()
    if not n:
        raise ValueError("time needs two samples at least")
    if lo <= 0:
        raise ValueError("time must increase strictly")
    if hi - lo > atol + rtol * abs(lo):
        raise ValueError("time is not regular")
    return (lo + hi) / 2


def sampling_rate(t0: float, t1: float, digits: int = 5) -> float:
    return round(1 / (t1 - t0), digits)


def consistent_rate(fs: float, dt: float, rtol: float = 1e-5) -> None:
    if abs(fs * dt - 1) > rtol:
        raise ValueError("fs does not fit the time step")


def binary_mask(df: DataFrame, by: list[str], order: str = "t", value: str = "m") -> None:
    w = Window.partitionBy(*by).orderBy(order)
    bad, flat = df.withColumn("_s", F.col(order) <= F.lag(order).over(w)).agg(F.count_if(~F.col(value).isin(0, 1) | F.col(value).isNull()), F.count_if("_s")).first()
    if bad:
        raise ValueError("a mask holds 0 and 1 only")
    if flat:
        raise ValueError("time must increase strictly")


def intervals(df: DataFrame, by: list[str], start: str = "t_start", stop: str = "t_end", disjoint: bool = True) -> None:
    w = Window.partitionBy(*by).orderBy(start, stop)
    reversed_, overlap = df.withColumn("_o", F.lag(stop).over(w) >= F.col(start)).agg(F.count_if(F.col(stop) < F.col(start)), F.count_if("_o")).first()
    if reversed_:
        raise ValueError("an interval ends before it starts")
    if disjoint and overlap:
        raise ValueError("intervals overlap")


def same_axes(a: DataFrame, b: DataFrame, on: list[str]) -> None:
    """Both tables have the same coordinates."""
    x, y = a.select(*on).distinct(), b.select(*on).distinct()
    if x.join(y, on, "left_anti").limit(1).count() or y.join(x, on, "left_anti").limit(1).count():
        raise ValueError("coordinates differ")


def one_file_per_job(files: DataFrame, job: str = "job_id", path: str = "path") -> None:
    bad = files.groupBy(job).agg(F.countDistinct(path).alias("n")).where("n <> 1").limit(3).collect()
    if bad:
        raise RuntimeError(f"jobs {[r[job] for r in bad]} don't have exactly one file")


def any_finite(df: DataFrame, value: str = "v") -> None:
    if not df.where(F.col(value).isNotNull() & ~F.isnan(value)).limit(1).count():
        raise ValueError("no finite value")
