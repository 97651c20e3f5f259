"""Selections by label, range and nearest value; populations, layers and groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quantiles import exact_quantiles


def between(df: DataFrame, column: str, lo: float | None, hi: float | None) -> DataFrame:
    """A closed range; None is open."""
    if lo is not None:
        df = df.where(F.col(column) >= lo)
    return df if hi is None else df.where(F.col(column) <= hi)


def populations(pops: DataFrame, requested: list[str] | str | None = None, frozen: str = "frz") -> DataFrame:
    """Populations without frozen ones, or the requested ones in that order (``ord``); unknown names raise."""
    live = pops.where(~F.col("pop").contains(frozen))
    if requested in (None, "all"):
        return live.select("pop", (F.row_number().over(Window.orderBy("pop_ord")) - 1).alias("ord"))
    names = [requested] if isinstance(requested, str) else list(requested)
    if not names or len(set(names)) != len(names) or any(not n.strip() for n in names):
        raise ValueError("requested populations must be distinct names")
    known = {r.pop for r in live.where(F.col("pop").isin(names)).select("pop").collect()}
    if missing := [n for n in names if n not in known]:
        raise ValueError(f"unknown populations: {missing}")
    order = F.array_position(F.lit(names), F.col("pop")) - 1
    return live.where(F.col("pop").isin(names)).select("pop", order.cast("int").alias("ord"))


def nearest(channels: DataFrame, targets: DataFrame, label: str = "y", tie: str = "larger") -> DataFrame:
    """For each target (``ord, y_req``) the channel nearest to it; each channel once, at its first request.

    The as-of form: targets are placed among the channels' gaps by one sorted union, so nothing is crossed.
    """
    both = channels.select(F.col(label).cast("double").alias("x"), F.lit(None).cast("long").alias("ord")).unionByName(targets.select(F.col("y_req").cast("double").alias("x"), F.col("ord").cast("long").alias("ord")))
    kind = F.col("ord").isNull().cast("int")
    own = F.when(F.col("ord").isNull(), F.col("x"))
    below = F.last(own, ignorenulls=True).over(Window.orderBy("x", F.desc(kind)).rowsBetween(Window.unboundedPreceding, 0))
    above = F.first(own, ignorenulls=True).over(Window.orderBy("x", kind).rowsBetween(0, Window.unboundedFollowing))
    found = both.withColumn("lo", below).withColumn("hi", above).where("ord IS NOT NULL")
    down, up = F.col("x") - F.col("lo"), F.col("hi") - F.col("x")
    first = down < up if tie == "larger" else down <= up
    pick = F.when(F.col("lo").isNull(), F.col("hi")).when(F.col("hi").isNull(), F.col("lo")).when(first, F.col("lo")).otherwise(F.col("hi"))
    return found.select("ord", F.col("x").alias("y_req"), pick.alias(label)).groupBy(label).agg(F.min("ord").alias("ord"), F.min_by("y_req", "ord").alias("y_req"))


def stepped(lo: float, hi: float, step: float) -> list[float]:
    """lo, lo + step, ... up to hi (included within half a step); a reversed range is swapped."""
    if step <= 0:
        raise ValueError("step must be positive")
    lo, hi = min(lo, hi), max(lo, hi)
    return [lo + k * step for k in range(int((hi + 0.5 * step - lo) / step - 1e-12) + 1)]


def requested(channels: DataFrame, values: list[float] | str | None = None, span: tuple[float, float] | None = None, step: float | None = None, label: str = "y", tie: str = "larger") -> DataFrame:
    """``y, ord, y_req``: channels as users ask for them.

    None or ``all``: every depth in order; a list: the nearest channel of each, once; a span: the depths within it, its ends
    swapped if reversed; a span with a step: the nearest channels of its steps. ``values`` goes before ``span``.
    """
    depths = channels.select(F.col(label).cast("double").alias(label)).distinct()
    if isinstance(values, str):
        if values.strip().lower() != "all":
            raise ValueError("depths are a list, None or 'all'")
        values, span = None, None
    if values is None and span is not None and step is not None:
        values = stepped(*span, step)
    if values is not None:
        targets = channels.sparkSession.createDataFrame([(k, float(v)) for k, v in enumerate(values)], "ord long, y_req double")
        return nearest(depths, targets, label, tie).select(label, "ord", "y_req")
    if span is not None:
        depths = between(depths, label, min(span), max(span))
    order = F.row_number().over(Window.orderBy(label)) - 1  # of a probe's some hundred depths
    return depths.select(label, order.cast("long").alias("ord"), F.col(label).alias("y_req"))


def in_layers(channels: DataFrame, layers: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Channels within the union of closed layer ranges (``layer, y0, y1``); unknown layers raise."""
    if names is not None:
        known = {r.layer for r in layers.select("layer").collect()}
        if missing := [n for n in names if n not in known]:
            raise KeyError(f"unknown layers: {missing}")
        layers = layers.where(F.col("layer").isin(names))
    return channels.join(F.broadcast(layers), F.col("y").between(F.col("y0"), F.col("y1")), "left_semi")


def visible_layers(layers: DataFrame, size: float, lo: float, hi: float) -> DataFrame:
    """Layer spans in depth units that overlap a range."""
    spans = layers.select("layer", (F.col("y0") * size).alias("y0"), (F.col("y1") * size).alias("y1"))
    return spans.where((F.col("y1") >= lo) & (F.col("y0") <= hi))


#: Beginnings of population names and their cell class, and endings and their layer, each in order (fixed values).
CELL_CLASSES = {"IT": "PYR", "CT": "PYR", "PT": "PYR", "PV": "PV", "SOM": "SOM", "VIP": "VIP", "NGF": "NGF", "HTC": "TC", "TC": "TC", "TI": "TI", "IRE": "IRE"}
LAYERS = {"5A": "L5A", "5B": "L5B", "6": "L6", "4": "L4", "3": "L3", "2": "L2", "1": "L1"}
THALAMIC = ("TC", "HTC", "TCM", "TI", "TIM", "IRE", "IREM")


def _bare(pop: Column) -> Column:
    return F.upper(F.regexp_replace(pop, "_frz$", ""))


def _unknown(what: str, pop: Column) -> Column:
    return F.raise_error(F.concat(F.lit(f"no {what} for population "), F.coalesce(pop, F.lit("null")))).cast("string")


def cell_type(pop: Column) -> Column:
    """Cell class by a name's beginning: IT, CT and PT are pyramidal, HTC, TCM and TC thalamic. A frozen suffix is ignored; other names raise."""
    out = F
    for start, kind in CELL_CLASSES.items():
        out = out.when(_bare(pop).startswith(start), kind)
    return out.otherwise(_unknown("cell class", pop))


def layer_of(pop: Column) -> Column:
    """Layer by a name's ending, 5A and 5B before single digits; thalamic populations have a layer of their own, other names raise."""
    out = F.when(_bare(pop).isin(*THALAMIC), "THAL")
    for end, layer in LAYERS.items():
        out = out.when(_bare(pop).endswith(end), layer)
    return out.otherwise(_unknown("layer", pop))


def numbered_channels(channels: DataFrame, y: float | None = None) -> DataFrame:
    """``channel, channel_y`` of the distinct depths in order, from 0; with y the single channel at that depth (an unknown one raises)."""
    found = channels.select(F.col("y").alias("channel_y")).distinct()
    if y is not None:
        return exact(found, "channel_y", [y]).select(F.lit(0).cast("long").alias("channel"), "channel_y")
    # The depths of a probe: some hundred rows at most.
    return found.withColumn("channel", (F.row_number().over(Window.orderBy("channel_y")) - 1).cast("long")).select("channel", "channel_y")


def exact(channels: DataFrame, column: str, labels: list) -> DataFrame:
    """The rows of exactly these labels; a label that no row has raises, naming those there are."""
    there = {r[0] for r in channels.where(F.col(column).isin(labels)).select(column).distinct().collect()}
    if missing := [x for x in labels if x not in there]:
        known = sorted(r[0] for r in channels.select(column).distinct().orderBy(column).limit(100).collect())
        raise ValueError(f"no {column} {missing}; there are {known}")
    return channels.where(F.col(column).isin(labels))


def first_pop(pops: DataFrame) -> DataFrame:
    """The first population in order that is not frozen."""
    return pops.where(~F.col("pop").endswith("_frz")).orderBy("pop_ord").limit(1)


def groups(pops: DataFrame, members: dict[str, list[str]]) -> DataFrame:
    """``group, pop`` for those members that are present."""
    rows = [(g, p) for g, ps in members.items() for p in ps]
    return pops.sparkSession.createDataFrame(rows, "group string, pop string").join(pops.select("pop"), "pop", "left_semi").select("group", "pop")


def above(pairs: DataFrame, column: str, threshold: float | None) -> DataFrame:
    """Pairs with a finite value whose size reaches the threshold; None keeps all."""
    return pairs if threshold is None else pairs.where(~F.isnan(column) & F.col(column).isNotNull() & (F.abs(column) >= threshold))


def plot_scale(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """``by, abs_max, abs_p95``: the scales a plot of each group needs."""
    size = F.abs(F.col(value))
    return df.groupBy(*by).agg(F.max(size).alias("abs_max")).join(exact_quantiles(df, by, size, {"abs_p95": 0.95}), by, "left")


def median_step(channels: DataFrame) -> DataFrame:
    """``dy``: the median distance of neighbouring depths (of a probe's some hundred)."""
    steps = channels.select("y").distinct().withColumn("dy", F.col("y") - F.lag("y").over(Window.orderBy("y")))
    return steps.agg(F.percentile("dy", F.lit(0.5)).alias("dy"))


def matrix_masks(pairs: DataFrame, value: str, threshold: float | None) -> DataFrame:
    """The pairs with ``weak`` (finite, but below the threshold in size) and ``diagonal``."""
    v = F.col(value)
    finite = v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    weak = finite & (F.abs(v) < threshold) if threshold is not None else F.lit(False)
    return pairs.withColumn("weak", F.coalesce(weak, F.lit(False))).withColumn("diagonal", F.col("pop_i") == F.col("pop_j"))
