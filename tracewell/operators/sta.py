"""Event-triggered averages: windows of a signal around events, as slices and as an index join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .windows import finite


#: Samples of a trace without keys that every executor may hold (128 MB).
BROADCAST = 16_000_000


def to_seconds(t: Column, unit: str) -> Column:
    if unit not in ("s", "ms"):
        raise ValueError("unit must be s or ms")
    return t / 1000.0 if unit == "ms" else t


def offsets(window: tuple[float, float], dt: float) -> tuple[int, int]:
    """Sample offsets of a window, rounded half to even, both ends included."""
    a, b = round(window[0] / dt), round(window[1] / dt)
    if b < a:
        raise ValueError("the window is reversed")
    return a, b


def epochs_long(triggers: DataFrame, signal: DataFrame, by: list[str], t0: float, dt: float, n: int, window: tuple[float, float]) -> DataFrame:
    """``by, spike, k, v`` of every event whose whole window lies in the signal's n samples: bounds first, then an equi-join on the index.

    triggers: ``by, t``; signal: ``by.., i, v``. ``spike`` numbers the kept events of a group in time order from 0.
    """
    from pyspark.sql import Window

    lo, hi = offsets(window, dt)
    at = F.rint((F.col("t") - t0) / dt).cast("long")
    kept = triggers.withColumn("_c", at).where((F.col("_c") + lo >= 0) & (F.col("_c") + hi <= n - 1))
    order = Window.partitionBy(*by).orderBy("t", "_c") if by else Window.orderBy("t", "_c")
    kept = kept.withColumn("spike", (F.row_number().over(order) - 1).cast("long"))
    wanted = kept.select(*by, "spike", "_c", F.explode(F.sequence(F.lit(lo).cast("long"), F.lit(hi).cast("long"))).alias("k")).withColumn("i", F.col("_c") + F.col("k"))
    return wanted.join(signal, [*by, "i"]).drop("_c")


def epochs_trace(triggers: DataFrame, traces: DataFrame, on: list[str], dt: float, window: tuple[float, float]) -> DataFrame:
    """The same from whole traces: one row per event with the slice of its channel, without an explode.

    With nothing to join on every event meets the one trace, which is broadcast; a longer one than ``BROADCAST`` is refused (:mod:`triggered` takes any).
    """
    lo, hi = offsets(window, dt)
    if on:
        joined = triggers.join(traces, on)
    else:
        count, samples = traces.agg(F.count(F.lit(1)), F.sum(F.size("values"))).first()
        if count > 1 or (samples or 0) > BROADCAST:
            raise ValueError(f"{count} traces of {samples} samples: name what joins them, or average from chunks")
        joined = triggers.join(F.broadcast(traces))
    c = F.rint((F.col("t") - F.col("t0")) / dt).cast("int")
    rows = joined.withColumn("_c", c).where((F.col("_c") + lo >= 0) & (F.col("_c") + hi <= F.size("values") - 1))
    return rows.withColumn("epoch", F.slice("values", F.col("_c") + lo + 1, F.lit(hi - lo + 1))).drop("values", "_c")


def average(epochs: DataFrame, by: list[str], dt: float) -> DataFrame:
    """Mean over events, NaN skipped: ``by, k, t_rel, v, n``."""
    return epochs.groupBy(*by, "k").agg(F.avg(finite("v")).alias("v"), F.count(F.lit(1)).alias("n")).withColumn("t_rel", F.col("k") * dt)


def split_by_mask(triggers: DataFrame, mask: DataFrame, by: list[str], t0: float, dt: float, n: int) -> DataFrame:
    """Triggers in the mask's time range with the state of its nearest sample (the later one on ties)."""
    inside = triggers.where((F.col("t") >= t0) & (F.col("t") <= t0 + (n - 1) * dt))
    i = F.floor((F.col("t") - t0) / dt + 0.5).cast("long")
    return inside.withColumn("i", i).join(mask.select(*by, "i", (F.col("m") >= 0.5).cast("int").alias("state")), [*by, "i"]).drop("i")


def center_states(averages: DataFrame, by: list[str]) -> DataFrame:
    """Subtract each state's mean over the window."""
    from pyspark.sql import Window

    return averages.withColumn("v", F.col("v") - F.avg(finite("v")).over(Window.partitionBy(*by)))


def shared_pops(triggers: DataFrame, signal: DataFrame, pop: str | None = None) -> DataFrame:
    """Triggers whose population the signal has. A signal without populations takes those of the named one; no overlap raises."""
    if "pop" not in signal.columns:
        if pop is None:
            raise ValueError("the signal has no populations: name that of the triggers")
        found = triggers.where(F.col("pop") == pop)
    else:
        found = triggers.join(signal.select("pop").distinct(), "pop", "left_semi")
    if found.isEmpty():
        raise ValueError("triggers and signal share no population")
    return found
