"""Tables of oscillation events: canonical columns, quality, per-band statistics, CSV form."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .quantiles import exact_quantiles

SUMMARY = ("peakF", "ncycle", "Foct", "filtsigcor")


def normalise(raw: DataFrame, bands: list[str], offset_s: float = 0.0, ncycle_min: float | None = None, foct_max: float | None = None, filtsigcor_min: float | None = None) -> DataFrame:
    """Canonical event rows of the bands: times in seconds with an offset, missing summary columns NaN, ``event_passed``."""
    have = set(raw.columns)
    out = raw.where(F.col("band").isin(bands))
    for c in SUMMARY:
        if c not in have:
            out = out.withColumn(c, F.lit(float("nan")))
    ok = F.lit(True)
    if ncycle_min is not None:
        ok = ok & (F.col("ncycle") >= ncycle_min)
    if foct_max is not None:
        ok = ok & (F.col("Foct") <= foct_max)
    if filtsigcor_min is not None:
        ok = ok & (F.col("filtsigcor") >= filtsigcor_min)
    for name, ms in (("peak_time_s", "absPeakT"), ("start_time_s", "absminT"), ("stop_time_s", "absmaxT")):
        out = out.withColumn(name, F.col(ms) / 1000 + offset_s)
    out = out.withColumn("duration_s", F.col("dur") / 1000).withColumn("event_passed", F.coalesce(ok, F.lit(False)))
    first = ["chan", "band", "peak_time_s", "start_time_s", "stop_time_s", "duration_s", *SUMMARY, "event_passed"]
    return out.select(*first, *[c for c in out.columns if c not in first])


def passed(events: DataFrame) -> DataFrame:
    return events.where("event_passed")


def csv_table(events: DataFrame, digits: int = 6, drop: tuple[str, ...] = (), ban: str = "MUA") -> DataFrame:
    """Scalar columns only, numbers rounded half to even, without the named columns and those with a banned word; a text column with line breaks goes."""
    keep = []
    for f in events.schema.fields:
        if f.name in drop or ban in f.name or isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType, T.BinaryType)):
            continue
        keep.append(F.bround(f.name, digits).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name))
    texts = [f.name for f in events.schema.fields if isinstance(f.dataType, T.StringType) and f.name not in drop and ban not in f.name]
    if texts:
        broken = events.agg(*[F.max(F.col(c).contains("\n")).alias(c) for c in texts]).first()
        bad = {c for c in texts if broken[c]}
        keep = [k for k, f in zip(keep, [f for f in events.schema.fields if f.name not in drop and ban not in f.name and not isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType, T.BinaryType))], strict=True) if f.name not in bad]
    return events.select(*keep)


def interval_stats(events: DataFrame, by: list[str], time: str = "peak_time_s") -> DataFrame:
    """Per group: events, mean interval, CV2 and LV (null with fewer than 3 or 4 events)."""
    w = Window.partitionBy(*by).orderBy(time)
    d = events.withColumn("d", F.col(time) - F.lag(time).over(w))
    d = d.withColumn("e", F.lag("d").over(w))
    s, m = F.col("d") + F.col("e"), F.col("d") - F.col("e")
    n = F.count(F.lit(1))
    return d.groupBy(*by).agg(n.alias("n"), F.avg("d").alias("mean_interval"), F.when(n >= 3, F.avg(F.try_divide(2 * F.abs(m), s))).alias("cv2"), F.when(n > 3, F.avg(3 * F.try_divide(m, s) * F.try_divide(m, s))).alias("lv"))


def fano(events: DataFrame, units: DataFrame, by: list[str], window: float, n_windows: int, time: str = "peak_time_s") -> DataFrame:
    """Variance over mean of counts in windows, empty ones included."""
    counts = events.groupBy(*by, F.floor(F.col(time) / window).cast("long").alias("win")).agg(F.count(F.lit(1)).alias("n"))
    grid = units.select(*by).distinct().withColumn("win", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_windows - 1).cast("long"))))
    full = grid.join(counts, [*by, "win"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return full.groupBy(*by).agg(F.try_divide(F.var_pop("n"), F.avg("n")).alias("fano"))


def clip_frequencies(events: DataFrame, lo: float, hi: float) -> DataFrame:
    """Frequency frames clipped to a range; a frame outside becomes the nearer edge."""
    a, b = F.greatest("minF", F.lit(lo)), F.least("maxF", F.lit(hi))
    edge = F.when(F.col("maxF") < lo, lo).otherwise(hi)
    return events.withColumn("frame_lo", F.when(a <= b, a).otherwise(edge)).withColumn("frame_hi", F.when(a <= b, b).otherwise(edge))


def ordered(events: DataFrame, by: tuple[str, ...] = ("channel",), time: str = "peak_time") -> DataFrame:
    """Events in the order of channel and time (ranges over the cluster), the order that their readers expect."""
    return events.orderBy(*by, time)


def pack(traces: DataFrame, spectrogram: DataFrame, events: DataFrame) -> dict[str, DataFrame]:
    """Traces, spectrogram and the events' scalar columns as one result of three tables.

    Traces and spectrogram must have the same channels, and as many samples as power values in each; otherwise raises.
    """
    n = traces.groupBy("channel").agg(F.max(F.size("values")).alias("n"))
    m = spectrogram.groupBy("channel").agg(F.min(F.size("power")).alias("lo"), F.max(F.size("power")).alias("hi"))
    bad = n.join(m, "channel", "full").where("n IS NULL OR lo IS NULL OR n <> lo OR n <> hi").limit(3).collect()
    if bad:
        raise ValueError(f"traces and spectrogram differ in channels {[r.channel for r in bad]}")
    plain = [f.name for f in events.schema.fields if not isinstance(f.dataType, T.ArrayType | T.StructType | T.MapType | T.BinaryType)]
    return {"traces": traces, "spectrogram": spectrogram, "events": events.select(*plain)}


def unpack(packed: dict[str, DataFrame]) -> DataFrame:
    """The event table of a packed result; a result that lacks a table raises."""
    if missing := {"traces", "spectrogram", "events"} - set(packed):
        raise ValueError(f"the result lacks {sorted(missing)}")
    return packed["events"]


def concat(tables: list[DataFrame]) -> DataFrame:
    """Event tables one after the other; columns that one lacks are null."""
    if not tables:
        raise ValueError("nothing to concatenate")
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def stacked_scale(signal: DataFrame, scale: float, spacing: float, value: str = "v", depth: str = "y") -> DataFrame:
    """Traces placed at their depths: value times scale times spacing over the 95th percentile of |value| of all, plus the depth (``x``)."""
    p95 = exact_quantiles(signal, [], F.abs(F.col(value)), {"p95": 0.95})
    return signal.crossJoin(F.broadcast(p95)).withColumn("x", F.try_divide(F.col(value) * scale * spacing, F.col("p95")) + F.col(depth)).drop("p95")  # one row


def intervals_per_channel(intervals: DataFrame) -> DataFrame:
    """``channel, y, n``: intervals of each channel, its depth from a key ``y_<depth>``."""
    return intervals.groupBy("channel").agg(F.count(F.lit(1)).alias("n")).withColumn("y", F.expr("try_cast(substring(channel, 3) AS double)")).select("channel", "y", "n")


def first_channel(intervals: DataFrame) -> DataFrame:
    """The channel of the smallest depth that has any interval."""
    return intervals_per_channel(intervals).orderBy("y", "channel").limit(1)
