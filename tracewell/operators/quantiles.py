"""Exact quantiles of groups of any size, by distributed selection.

``percentile`` keeps a group's different values in one task. Here a group with more than ``limit`` values is narrowed first:
a bounded sketch proposes cuts, the values on and between the cuts are counted exactly, and only the interval that holds a
wanted rank goes on, until it is one value or has few enough. Each round leaves about a 64th part, whatever the values'
distribution; many equal values end as a cut. Results are those of ``percentile``, interpolated between ranks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import files

LIMIT = 100_000
CUTS = 64


def all_small(df: DataFrame, by: list[str], limit: int = LIMIT) -> bool:
    """Whether no group has more than ``limit`` rows: one aggregation."""
    return (df.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0) <= limit


def exact_quantiles(df: DataFrame, by: list[str], value: str | Column, probs: dict[str, float], limit: int = LIMIT, cuts: int = CUTS, small: bool | None = None) -> DataFrame:
    """``by`` and a column per entry of ``probs``; nulls don't count, NaN is the largest, groups of null keys are left out. Without ``by`` one row.

    ``small`` says what :func:`all_small` found of the rows, where that is known already.
    """
    v = (F.col(value) if isinstance(value, str) else value).cast("double").alias("_v")
    rows = df.select(*by, v).where("_v IS NOT NULL")
    if not by:
        rows = rows.withColumn("_all", F.lit(0))
    keys = by or ["_all"]
    sizes = rows.groupBy(*keys).agg(F.count("_v").alias("_n"))
    if small or small is None and (sizes.agg(F.max("_n")).first()[0] or 0) <= limit:
        found = rows.groupBy(*by).agg(*(F.percentile("_v", F.lit(p)).alias(c) for c, p in probs.items()))
        return found.select(*by, *probs)
    rows, sizes = files.written(rows, "values"), files.written(sizes, "sizes")
    found = _select(rows, sizes, keys, sorted(set(probs.values())), limit, cuts)
    at = found.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("rank", "x"))).alias("_at"))
    out = sizes.join(at, keys)
    for c, p in probs.items():
        place = F.lit(p) * (F.col("_n") - 1)
        lo, hi = F.floor(place), F.ceil(place)
        x, y = F.try_element_at("_at", lo), F.try_element_at("_at", hi)
        out = out.withColumn(c, F.when(lo == hi, x).otherwise((hi - place) * x + (place - lo) * y))
    return out.select(*by, *probs)


def _select(rows: DataFrame, sizes: DataFrame, keys: list[str], probs: list[float], limit: int, cuts: int) -> DataFrame:
    """``keys, rank, x``: the values at the ranks that the probabilities need, from 0."""
    places = [F.lit(p) * (F.col("_n") - 1) for p in probs]
    ranks = F.array_distinct(F.array(*(f(x).cast("long") for x in places for f in (F.floor, F.ceil))))
    none = F.lit(None).cast("double")
    # An interval (a, b) of a group, open, null for no end; ``below`` values lie under it and ``inside`` in it; x is set where it is one value.
    spans = sizes.select(*keys, F.array_sort(ranks).alias("ranks"), F.lit(0).cast("long").alias("below"), F.col("_n").alias("inside"), none.alias("a"), none.alias("b"), none.alias("x"))
    done = []
    while True:
        spans = files.written(spans, "spans")
        done.append(spans.where(F.col("x").isNotNull()).select(*keys, F.explode("ranks").alias("rank"), "x"))
        small = spans.where(F.col("x").isNull() & (F.col("inside") <= limit))
        done.append(_read(rows, small, keys))
        large = spans.where(F.col("x").isNull() & (F.col("inside") > limit))
        if large.isEmpty():
            break
        spans = _narrow(rows, large, keys, cuts)
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def _within(rows: DataFrame, spans: DataFrame, keys: list[str]) -> DataFrame:
    """The values of each interval; an interval is known by its first rank."""
    v = F.col("_v")
    return rows.join(spans.withColumn("_id", F.col("ranks")[0]), keys).where((F.col("a").isNull() | (v > F.col("a"))) & (F.col("b").isNull() | (v < F.col("b"))))


def _read(rows: DataFrame, spans: DataFrame, keys: list[str]) -> DataFrame:
    """Ranks of intervals that have few values."""
    few = _within(rows, spans, keys).groupBy(*keys, "_id").agg(F.array_sort(F.collect_list("_v")).alias("s"), F.first("ranks").alias("ranks"), F.first("below").alias("below"))
    return few.select(*keys, F.explode("ranks").alias("rank"), "s", "below").select(*keys, "rank", F.get("s", (F.col("rank") - F.col("below")).cast("int")).alias("x"))


def _narrow(rows: DataFrame, spans: DataFrame, keys: list[str], cuts: int) -> DataFrame:
    steps = F.array(*(F.lit(k / cuts) for k in range(cuts + 1)))
    proposed = _within(rows, spans, keys).groupBy(*keys, "_id").agg(F.array_distinct(F.percentile_approx("_v", steps, F.lit(50 * cuts))).alias("cuts"), *(F.first(c).alias(c) for c in ("ranks", "below", "a", "b")))
    proposed = files.written(proposed, "cuts")
    # Bins: 2k is the open interval under cut k, 2k + 1 the cut itself.
    under = F.size(F.filter("cuts", lambda c: c < F.col("_v")))
    place = 2 * under + F.when(F.get("cuts", under) == F.col("_v"), 1).otherwise(0)
    counted = _within(rows, proposed, keys).groupBy(*keys, "_id", place.alias("bin")).agg(F.count(F.lit(1)).alias("inside"))
    before = F.coalesce(F.sum("inside").over(Window.partitionBy(*keys, "_id").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    binned = counted.withColumn("before", before).join(proposed.select(*keys, "_id", "cuts", "ranks", F.col("below").alias("_below"), "a", "b"), [*keys, "_id"])
    ours = F.filter("ranks", lambda r: (r - F.col("_below") >= F.col("before")) & (r - F.col("_below") < F.col("before") + F.col("inside")))
    k = (F.col("bin") / 2).cast("int")
    odd = F.col("bin") % 2 == 1
    cut = lambda i: F.when(i >= 0, F.get("cuts", F.greatest(i, F.lit(0))))
    return binned.select(
        *keys, ours.alias("ranks"), (F.col("_below") + F.col("before")).alias("below"), "inside", F.coalesce(cut(k - 1), "a").alias("a"), F.coalesce(cut(k), "b").alias("b"), F.when(odd, cut(k)).alias("x"),
    ).where(F.size("ranks") > 0)

