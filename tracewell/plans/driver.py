"""The driver's tables in the engine's form: events as spikes, and hourly signals over all days that have events."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import files

HOUR, DAY = 3600.0, 86400.0


def micros() -> Column:
    """Microseconds of ``ts`` since 1970."""
    return F.timestamp_diff("MICROSECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), F.col("ts"))


@lru_cache(maxsize=64)
def _span(spark: SparkSession, app: str, sf_dir: str, stamp: tuple) -> tuple[int, int]:
    first, last = table(spark, sf_dir, "events").agg(F.floor(F.min(micros()) / F.lit(DAY * 1e6)), F.floor(F.max(micros()) / F.lit(DAY * 1e6))).first()
    return (int(first * DAY * 1e6), 24 * (last - first + 1)) if first is not None else (0, 24)


def span(spark: SparkSession, sf_dir: str) -> tuple[int, int]:
    """Start of the first day with events, in microseconds since 1970, and the hours up to the last day's end (24 without events).

    One pass over one column, once a session for each state of the table (its size and time).
    """
    return _span(spark, spark.sparkContext.applicationId, sf_dir, tuple(files.stamp(spark, [f"{sf_dir}/events.parquet"])))


def hours(spark: SparkSession, sf_dir: str) -> int:
    return span(spark, sf_dir)[1]


def t_end(spark: SparkSession, sf_dir: str) -> float:
    return HOUR * hours(spark, sf_dir)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pop, gid, t``: event type, user and seconds."""
    us = micros() - F.lit(span(spark, sf_dir)[0])
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("pop"), F.col("user_id").alias("gid"), (us / F.lit(1e6)).alias("t"))


def pops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pop, pop_ord, n_cells``."""
    from pyspark.sql import Window

    found = spikes(spark, sf_dir).groupBy("pop").agg(F.countDistinct("gid").alias("n_cells"))
    return found.withColumn("pop_ord", F.row_number().over(Window.orderBy("pop")) - 1)


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pop, i, v``: events an hour on the dense grid."""
    from ..operators import spikes as S

    out = S.rate_dynamics(spikes(spark, sf_dir), pops(spark, sf_dir), ["pop"], 0.0, t_end(spark, sf_dir), HOUR)
    return out.select("pop", F.col("bin").alias("i"), F.round(F.col("rate") * HOUR).alias("v"))


def probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``y, i, t, v``: four depths (users by remainder), the value of events an hour, dense."""
    from ..operators.spikes import dense

    e = table(spark, sf_dir, "events")
    us = micros() - F.lit(span(spark, sf_dir)[0])
    rows = e.select(((F.col("user_id") % 4 + 1) * 100.0).alias("y"), F.floor(us / F.lit(3600e6)).cast("long").alias("bin"), F.round(F.col("value") * 100).cast("long").alias("c"))
    sums = rows.groupBy("y", "bin").agg(F.sum("c").alias("n"))
    return dense(rows, sums, ["y"], hours(spark, sf_dir)).select("y", F.col("bin").alias("i"), (F.col("bin") * HOUR).alias("t"), (F.col("n") / F.lit(100.0)).alias("v"))


def results(spark: SparkSession, sf_dir: str, fields: str | None = None) -> DataFrame:
    """A nested result document per customer (``job_id``): populations are order states, cells orders, spikes their lines.

    Written to JSON text and parsed again, as documents in files are. A document holds one customer's orders.
    ``fields`` is the schema of what is read of them, else all.
    """
    from ..operators.parse import schema

    line = F.struct(F.col("l_linenumber").alias("n"), F.col("l_extendedprice").alias("t"))
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sort_array(F.collect_list(line)).alias("lines"))
    o = table(spark, sf_dir, "orders").join(lines, "o_orderkey", "left")
    cell = F.struct(F.col("o_orderkey").alias("gid"), F.col("o_orderstatus").alias("pop"), F.col("o_totalprice").alias("p"), F.coalesce("lines", F.array().cast("array<struct<n:int,t:double>>")).alias("lines"))
    jobs = o.groupBy(F.col("o_custkey").alias("job_id")).agg(F.sort_array(F.collect_list(cell)).alias("c"))
    pops = F.array_sort(F.array_distinct(F.transform("c", lambda x: x["pop"])))
    y = lambda p: F.when(p == "F", F.array(F.lit(0.0), F.lit(0.25))).when(p == "O", F.array(F.lit(0.25), F.lit(0.5))).otherwise(F.array(F.lit(0.5), F.lit(1.0)))
    of = lambda p: F.filter("c", lambda x: x["pop"] == p)
    frame = lambda x: F.array(x["p"], x["p"] * 2, x["p"] * 3)
    by_pop = lambda f: F.map_from_arrays(pops, F.transform(pops, f))
    traces = F.map_from_arrays(F.transform("c", lambda x: F.concat(F.lit("cell_"), x["gid"].cast("string"))), F.transform("c", lambda x: F.array(x["p"], x["p"] + 1, x["p"] + 2)))
    doc = F.struct(
        F.struct(F.lit([[0.0, 100.0], [0.0, 200.0], [0.0, 300.0]]).alias("recordLFP"), F.lit(0.5).alias("recordStep"), F.lit(0.25).alias("dt"), (F.size("c") * 0.5).alias("duration"), F.lit(1000.0).alias("sizeY")).alias("simConfig"),
        F.struct(
            by_pop(lambda p: F.struct(F.transform(of(p), lambda x: x["gid"]).alias("cellGids"), F.struct(y(p).alias("ynormRange")).alias("tags"))).alias("pops"),
            F.transform("c", lambda x: F.struct(F.struct(x["pop"].alias("pop")).alias("tags"))).alias("cells"),
            F.struct(by_pop(lambda p: F.struct(F.concat(F.lit("type_"), p).alias("cellType"))).alias("popParams")).alias("params"),
        ).alias("net"),
        F.struct(
            F.transform("c", frame).alias("LFP"),
            by_pop(lambda p: F.transform(of(p), frame)).alias("LFPPops"),
            F.flatten(F.transform("c", lambda x: F.array_repeat(x["gid"], F.size(x["lines"])))).alias("spkid"),
            F.flatten(F.transform("c", lambda x: F.transform(x["lines"], lambda q: q["t"]))).alias("spkt"),
            F.lit([0.0, 0.5, 1.0]).alias("t"),
            traces.alias("V_soma"),
            traces.alias("V_dend"),
        ).alias("simData"),
    )
    text = jobs.select("job_id", F.to_json(doc).alias("json"))
    return text.select("job_id", "json", F.from_json("json", fields or schema("V_dend")).alias("r")).select("job_id", "json", "r.*")


#: The same in SQL, as common table expressions.
SPAN = "span AS (SELECT coalesce(CAST(floor(min(epoch_us(ts)) / 86400e6) AS BIGINT), 0) * 86400000000 AS t0, coalesce(CAST(floor(max(epoch_us(ts)) / 86400e6) - floor(min(epoch_us(ts)) / 86400e6) AS BIGINT), 0) * 24 + 24 AS hours FROM events)"
S = "s AS (SELECT event_type AS pop, user_id AS gid, (epoch_us(ts) - (SELECT t0 FROM span)) / 1e6 AS t FROM events)"
P = "p AS (SELECT pop, count(DISTINCT gid) AS n_cells, row_number() OVER (ORDER BY pop) - 1 AS pop_ord FROM s GROUP BY pop)"
X = (
    "g AS (SELECT pop, pop_ord, i FROM p, (SELECT unnest(range(hours)) AS i FROM span)), "
    "x AS (SELECT g.pop, g.pop_ord, g.i, CAST(coalesce(c.n, 0) AS DOUBLE) AS v FROM g LEFT JOIN (SELECT pop, CAST(floor(t / 3600.0) AS BIGINT) AS i, count(*) AS n FROM s GROUP BY 1, 2) c ON c.pop = g.pop AND c.i = g.i)"
)
Y = (
    "yr AS (SELECT (user_id % 4 + 1) * 100.0::DOUBLE AS y, CAST(floor((epoch_us(ts) - (SELECT t0 FROM span)) / 3600e6) AS BIGINT) AS i, CAST(round(value * 100) AS BIGINT) AS c FROM events), "
    "yg AS (SELECT y, i FROM (SELECT DISTINCT y FROM yr), (SELECT unnest(range(hours)) AS i FROM span)), "
    "y AS (SELECT yg.y, yg.i, yg.i * 3600.0::DOUBLE AS t, coalesce(k.n, 0) / 100.0::DOUBLE AS v FROM yg LEFT JOIN (SELECT y, i, sum(c) AS n FROM yr GROUP BY 1, 2) k ON k.y = yg.y AND k.i = yg.i)"
)
#: Orders as cells of their customer's result (``job_id, gid, pop, price, ord``), and as the populations of it.
CELLS = "c AS (SELECT o_custkey AS job_id, o_orderkey AS gid, o_orderstatus AS pop, o_totalprice AS price, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS ord, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey) - 1 AS cell_ord FROM orders)"
POPS = "q AS (SELECT job_id, pop, count(*) AS n_cells, row_number() OVER (PARTITION BY job_id ORDER BY pop) - 1 AS pop_ord FROM c GROUP BY 1, 2)"
