"""Queries over nested results, files of jobs, sinks, checks, caches and sweeps, with the same in SQL.

The driver's tables are written in the layouts that those operators read, to a new folder shared by driver and executors, and read back.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import query, r6
from .operators import batch as B
from .operators import events as E
from .operators import masks as M
from .operators import pairs as C
from .operators import parse as N
from .operators import select as L
from .operators import spikes as R
from .operators import sta as A
from .operators import validate as V
from .operators import windows as W
from .plans import driver as D
from .plans import sweeps as Z
from .plans import workflows as P_
from .sources import archives, cache, config, files, gridded, jobs, lineage, sinks

WITH_C, WITH_Q = f"WITH {D.CELLS}", f"WITH {D.CELLS}, {D.POPS}"
WITH_S, WITH_X, WITH_Y = f"WITH {D.SPAN}, {D.S}", f"WITH {D.SPAN}, {D.S}, {D.P}, {D.X}", f"WITH {D.SPAN}, {D.Y}"


def rows(spark: SparkSession, found: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(found, schema)


def outcome(check: Callable[[], object]) -> str:
    """``ok``, or the kind of error that a check raises."""
    try:
        check()
    except (ValueError, KeyError, TypeError, RuntimeError, FileNotFoundError) as e:
        return type(e).__name__
    return "ok"


# --- nested results -------------------------------------------------------------


@query(f"{WITH_Q} SELECT q.job_id, q.pop, q.pop_ord, q.n_cells, CASE q.pop WHEN 'F' THEN 0.0 WHEN 'O' THEN 250.0 ELSE 500.0 END::DOUBLE AS y_lo, CASE q.pop WHEN 'F' THEN 250.0 WHEN 'O' THEN 500.0 ELSE 1000.0 END::DOUBLE AS y_hi, g.gids FROM q JOIN (SELECT job_id, pop, string_agg(gid::VARCHAR, ',' ORDER BY gid) AS gids FROM c GROUP BY 1, 2) g USING (job_id, pop)")
def parse_pops(spark, d):
    return N.pops(D.results(spark, d)).withColumn("gids", F.concat_ws(",", F.col("gids").cast("array<string>"))).withColumn("pop_ord", F.col("pop_ord").cast("long"))


@query(f"{WITH_C} SELECT job_id, pop, cell_ord, gid FROM c")
def parse_cells(spark, d):
    return N.cells(D.results(spark, d)).select("job_id", "pop", F.col("cell_ord").cast("long").alias("cell_ord"), "gid")


@query(f"{WITH_Q} SELECT job_id, pop, n_cells FROM q")
def parse_net_size(spark, d):
    return N.net_size(D.results(spark, d)).select("job_id", "pop", "n_cells")


@query(f"{WITH_Q} SELECT job_id, pop, 'type_' || pop AS \"cellType\" FROM q")
def parse_pop_params(spark, d):
    return N.pop_params(D.results(spark, d))


@query(f"{WITH_C} SELECT job_id, round(count(*) * 0.0005, 6)::DOUBLE AS duration_s, 0.00025::DOUBLE AS dt_s FROM c GROUP BY 1")
def parse_duration(spark, d):
    return N.duration(D.results(spark, d)).select("job_id", r6("duration_s", "duration_s"), "dt_s")


@query(f"{WITH_C} SELECT job_id, ord AS i, ord * 0.5::DOUBLE AS t FROM c")
def parse_record_times(spark, d):
    return N.record_times(D.results(spark, d))


@query(f"{WITH_C} SELECT DISTINCT job_id, k AS ch, 0.0::DOUBLE AS x, (k + 1) * 100.0::DOUBLE AS y FROM c, (SELECT unnest(range(3)) AS k)")
def parse_lfp_coords(spark, d):
    return N.lfp_coords(D.results(spark, d)).withColumn("ch", F.col("ch").cast("long"))


@query(f"{WITH_C} SELECT job_id, gid, round(l_extendedprice / 1000, 6) AS t FROM c JOIN lineitem ON l_orderkey = gid")
def parse_spikes(spark, d):
    return N.spikes(D.results(spark, d)).select("job_id", "gid", r6("t", "t"))


@query(f"{WITH_C} SELECT job_id, k AS ch, (k + 1) * 100.0::DOUBLE AS y, ord AS i, round(ord * 0.5 / 1000, 6)::DOUBLE AS t, price * (k + 1) AS v FROM c, (SELECT unnest(range(3)) AS k)")
def parse_lfp(spark, d):
    return N.lfp(D.results(spark, d)).select("job_id", F.col("ch").cast("long").alias("ch"), "y", "i", r6("t", "t"), "v")


@query(f"{WITH_C} SELECT job_id, pop, k AS ch, (k + 1) * 100.0::DOUBLE AS y, cell_ord AS i, price * (k + 1) AS v FROM c, (SELECT unnest(range(3)) AS k)")
def parse_pop_lfps(spark, d):
    return N.pop_lfps(D.results(spark, d)).withColumn("ch", F.col("ch").cast("long"))


_VOLT = f"{WITH_C}, v AS (SELECT job_id, pop, gid, ord AS rec_ord, k AS i, k * 0.5::DOUBLE AS t, price + k AS v FROM c, (SELECT unnest(range(3)) AS k))"


@query(f"{_VOLT} SELECT * FROM v WHERE t BETWEEN 0.5 AND 1.0")
def parse_voltages(spark, d):
    return N.voltages(D.results(spark, d), limits=(0.5, 1.0)).withColumn("rec_ord", F.col("rec_ord").cast("long"))


@query(f"{_VOLT} SELECT job_id, pop, gid, rec_ord, i, t / 1000 AS t, v FROM v WHERE t <= 0.5")
def parse_trace(spark, d):
    return N.voltages(D.results(spark, d), "V_dend", (None, 0.0005), ms=False).withColumn("rec_ord", F.col("rec_ord").cast("long"))


@query(f"{WITH_C} SELECT job_id, (count(*) * 0.5)::DOUBLE AS duration, 'type_O' AS kind FROM c GROUP BY 1 HAVING count(*) FILTER (pop = 'O') > 0")
def parse_nested(spark, d):
    docs = D.results(spark, d)
    return docs.select("job_id", N.nested("simConfig.duration").alias("duration"), N.nested("net.params.popParams.O.cellType", "json").alias("kind")).where("kind IS NOT NULL")


@query(f"{WITH_Q}, g AS (SELECT q.*, i AS bin FROM q, (SELECT unnest(range(4)) AS i)), n AS (SELECT c.job_id, c.pop, floor(l_extendedprice / 1000 / 25)::BIGINT AS bin, count(*) AS n FROM c JOIN lineitem ON l_orderkey = gid WHERE l_extendedprice / 1000 BETWEEN 0 AND 100 GROUP BY 1, 2, 3) SELECT job_id, pop, bin, bin * 25.0::DOUBLE AS t, round(coalesce(n, 0) / 25.0 / n_cells, 9) AS rate FROM g LEFT JOIN n USING (job_id, pop, bin)")
def result_rates(spark, d):
    return Z.results_to_rates(D.results(spark, d, N.TRAINS), 0.0, 100.0, 25.0).select("job_id", "pop", "bin", "t", F.round("rate", 9).alias("rate"))


# --- files of jobs ----------------------------------------------------------------

_SIZE_MEANS = "m AS (SELECT p_size AS size, p_brand AS brand, avg(p_retailprice) AS v, count(*) AS n FROM part GROUP BY 1, 2)"


def _size_means(spark, d) -> DataFrame:
    return D.table(spark, d, "part").groupBy(F.col("p_size").cast("long").alias("job_id"), F.col("p_brand").alias("brand")).agg(F.avg("p_retailprice").alias("v"), F.count(F.lit(1)).cast("double").alias("n"))


def _documents(spark, d) -> DataFrame:
    """A JSON document per part size: means and counts by brand, and each brand's pair of both."""
    means = _size_means(spark, d)
    one = lambda c: F.map_from_entries(F.sort_array(F.collect_list(F.struct("brand", c))))
    return means.groupBy("job_id").agg(F.struct(one(F.col("v")).alias("mean"), one(F.col("n")).alias("n"), one(F.array("n", "v").alias("pair")).alias("pair")).alias("stats"))


def _json_folder(spark, d) -> str:
    folder = files.scratch(spark, "json")
    sinks.save_per_job(_documents(spark, d), folder, "result_{job:05d}_a.json")
    return folder


def _table_folder(spark, d) -> str:
    folder = files.scratch(spark, "tables")
    sinks.save_per_job(_size_means(spark, d), folder, "{job:05d}_means.parquet")
    return folder


def _set_folder(spark, d) -> str:
    """A file per region and market segment: balances of its customers by nation."""
    folder = files.scratch(spark, "sets")
    both = D.table(spark, d, "customer").join(D.table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    sums = both.groupBy(F.col("n_regionkey").cast("long").alias("job_id"), F.col("c_mktsegment").alias("label"), "n_name").agg(F.sum("c_acctbal").alias("v"))
    sinks.save_per_job(sums, folder, "{job:05d}_{label}.parquet", label="label")
    return folder


@query(f"WITH {_SIZE_MEANS} SELECT size AS job_id, brand, round(v, 6) AS v FROM m")
def job_json_files(spark, d):
    docs = jobs.read_job_json(spark, _json_folder(spark, d), schema="stats struct<mean:map<string,double>>")
    return docs.select("job_id", F.explode("stats.mean").alias("brand", "v")).select("job_id", "brand", r6("v", "v"))


@query(f"WITH {_SIZE_MEANS} SELECT size AS job_id, brand, round(v, 6) AS v FROM m")
def job_tables(spark, d):
    return jobs.read_job_table(spark, _table_folder(spark, d), variable="v").select("job_id", "brand", r6("v", "v"))


_SETS = "SELECT n_regionkey AS job_id, c_mktsegment AS label, n_name, round(sum(c_acctbal), 2) AS v FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2, 3"


@query(_SETS)
def job_sets(spark, d):
    return jobs.read_job_set(spark, _set_folder(spark, d)).select("job_id", "label", "n_name", F.round("v", 2).alias("v"))


@query("SELECT row_number() OVER (ORDER BY r_name) AS job_id, r_name AS name, length(r_name)::DOUBLE AS size, r_name_idx, size_idx FROM (SELECT r_name, dense_rank() OVER (ORDER BY r_name) - 1 AS r_name_idx, dense_rank() OVER (ORDER BY length(r_name)) - 1 AS size_idx FROM region)")
def param_files(spark, d):
    """Configurations by job, and the indices of their parameters on the grid."""
    from pyspark.sql import Window

    folder = files.scratch(spark, "cfg")
    regions = D.table(spark, d, "region").withColumn("job_id", F.row_number().over(Window.orderBy("r_name")).cast("long"))
    docs = regions.select("job_id", F.struct(F.struct(F.col("r_name").alias("name"), F.length("r_name").cast("double").alias("size")).alias("area")).alias("simConfig"))
    sinks.save_per_job(docs, folder, "exp_{job:05d}_cfg.json")
    grid = B.iter_jobs(B.job_grid(jobs.read_params(spark, folder, ["area.name", "area.size"]), ["name", "size"]))
    return grid.select("job_id", "name", "size", F.col("name_idx").alias("r_name_idx"), "size_idx")


_ARCHIVE_META = {"t0": 86400.0, "tmax": 864000.0, "subtract_t0": True, "ms": False, "combine": False, "ndigits": 6}


def _archive(spark, d) -> str:
    """Trains of ten days by nation of the user (jobs), shifted to 0, as an archive."""
    path = files.scratch(spark, "archive")
    c = D.table(spark, d, "customer").select(F.col("c_custkey").alias("gid"), F.col("c_nationkey").cast("long").alias("job_id"))
    spikes = D.spikes(spark, d).join(c, "gid").where(F.col("t").between(86400.0, 864000.0)).select("job_id", "pop", "gid", F.bround(F.col("t") - 86400.0, 6).alias("t"))
    cells = D.spikes(spark, d).join(c, "gid").groupBy("job_id", "pop").agg(F.countDistinct("gid").alias("n_cells"))
    sinks.save_spikes(spikes, cells, path, _ARCHIVE_META)
    return path


_TRAINS = f"{WITH_S}, k AS (SELECT c_nationkey AS job_id, pop, gid, t FROM s JOIN customer ON c_custkey = gid), u AS (SELECT job_id, pop, count(DISTINCT gid) AS n_cells FROM k GROUP BY 1, 2)"


@query(f"{_TRAINS} SELECT job_id, pop, gid, round(t - 86400, 6) AS t FROM k WHERE t BETWEEN 86400 AND 864000")
def spike_archive(spark, d):
    return sinks.load_spikes(spark, _archive(spark, d))[0].select(F.col("job_id").cast("long").alias("job_id"), "pop", "gid", r6("t", "t"))


@query(f"{WITH_X} SELECT pop, i, v FROM x")
def saved_signal(spark, d):
    """A signal written by population, its sidecar, and read back; a second save replaces the first."""
    path = files.scratch(spark, "saved") + "/signal"
    for _ in range(2):
        sinks.save(D.hourly(spark, d), path, {"dt": D.HOUR}, ["pop"])
    if sinks.load_meta(spark, path) != {"dt": D.HOUR}:
        raise ValueError("the sidecar differs")
    return sinks.load(spark, path).select("pop", "i", "v")


@query(f"{WITH_X} SELECT pop, i, v FROM x")
def built_signal(spark, d):
    """The first source that can be read: a table that is not there, then one that is built."""
    path = files.scratch(spark, "built")
    missing = lambda: sinks.load(spark, f"{path}/none")
    built = lambda: cache.load_or_run(spark, f"{path}/signal", lambda: D.hourly(spark, d), "hourly")[0]
    return jobs.first_available(missing, built).select("pop", "i", "v")


_MEANS = f"{WITH_X}, m AS (SELECT pop, avg(v) AS v FROM x GROUP BY pop)"


@query(f"{_MEANS} SELECT a.pop AS pop_i, b.pop AS pop_j, CASE WHEN a.pop = b.pop THEN 'nan' ELSE printf('%.4f', round(a.v - b.v, 4)) END AS cell FROM m a, m b")
def metric_csv(spark, d):
    """A square matrix as CSV, read back cell by cell; the diagonal is missing."""
    mean = D.hourly(spark, d).groupBy("pop").agg(F.avg("v").alias("v"))
    pairs = C.mirrored(C.unordered(D.pops(spark, d), False)).join(mean.toDF("pop_i", "vi"), "pop_i").join(mean.toDF("pop_j", "vj"), "pop_j")
    names = [r.pop for r in D.pops(spark, d).orderBy("pop_ord").collect()]
    table = sinks.matrix(pairs.select("pop_i", "pop_j", F.round(F.col("vi") - F.col("vj"), 4).alias("v")), "v", names, 4)
    path = files.scratch(spark, "csv")
    sinks.write_csv(table, path, "pop_i")
    back = spark.read.option("header", True).csv(path)
    return back.unpivot(["pop_i"], names, "pop_j", "cell")


@query(f"{WITH_Y}, m AS (SELECT y, i, v, CAST(v > 200 AS INTEGER) AS m FROM y) SELECT y, i, m FROM m")
def mask_export(spark, d):
    """Passed events as a mask table in a file: runs above a threshold are the events."""
    signal = D.probe(spark, d)
    on = M.runs(signal.withColumn("m", (F.col("v") > 200).cast("int")), ["y"]).where("state = 1")
    events = on.select(F.col("y").alias("chan"), F.col("t_start").alias("start_time_s"), F.col("t_end").alias("stop_time_s"), F.lit(True).alias("event_passed"))
    path = files.scratch(spark, "mask") + "/mask"
    sinks.save(P_.event_mask(events, signal, 0.0, D.HOUR), path, {"t0": 0.0, "dt": D.HOUR})
    mask = sinks.load(spark, path).select("y", "i", "m")
    V.binary_mask(mask, ["y"], "i")
    return mask


# --- checks --------------------------------------------------------------------------


@query(f"{WITH_Y}, k AS (SELECT 'probe' AS input, y, t FROM y UNION ALL SELECT 'gap', y, t FROM y WHERE i <> 100 UNION ALL SELECT 'repeated', y, CASE WHEN i = 100 THEN 99 * 3600.0 ELSE t END FROM y UNION ALL SELECT 'single', y, t FROM y WHERE i = 0), e AS (SELECT input, t - lag(t) OVER (PARTITION BY input, y ORDER BY t) AS e FROM k) SELECT input, CASE WHEN count(e) = 0 OR min(e) <= 0 OR max(e) - min(e) > 1e-8 + 1e-5 * min(e) THEN 'ValueError' ELSE 'ok' END AS outcome FROM e GROUP BY input")
def check_time(spark, d):
    y = D.probe(spark, d)
    inputs = {"probe": y, "gap": y.where("i <> 100"), "repeated": y.withColumn("t", F.when(F.col("i") == 100, 99 * D.HOUR).otherwise(F.col("t"))), "single": y.where("i = 0")}
    return rows(spark, [(k, outcome(lambda v=v: V.regular_time(v, ["y"]))) for k, v in inputs.items()], "input string, outcome string")


@query(f"{WITH_Y}, m AS (SELECT 'binary' AS input, CAST(v > 200 AS INTEGER) AS m FROM y UNION ALL SELECT 'counts', CAST(round(v) AS INTEGER) FROM y UNION ALL SELECT 'missing', CASE WHEN i = 5 THEN NULL ELSE 1 END FROM y) SELECT input, CASE WHEN bool_and(coalesce(m IN (0, 1), false)) THEN 'ok' ELSE 'ValueError' END AS outcome FROM m GROUP BY input")
def check_mask(spark, d):
    y = D.probe(spark, d)
    inputs = {"binary": (F.col("v") > 200).cast("int"), "counts": F.round("v").cast("int"), "missing": F.when(F.col("i") != 5, 1)}
    return rows(spark, [(k, outcome(lambda v=v: V.binary_mask(y.withColumn("m", v), ["y"]))) for k, v in inputs.items()], "input string, outcome string")


@query("WITH k AS (SELECT o_custkey AS c, epoch(o_orderdate) AS a, o_orderkey FROM orders), n AS (SELECT c, a, lead(a) OVER (PARTITION BY c ORDER BY a, o_orderkey) AS b FROM k), v AS (SELECT 'half' AS input, c, a, a + (b - a) / 2 AS b FROM n WHERE b > a UNION ALL SELECT 'touching', c, a, b FROM n WHERE b > a UNION ALL SELECT 'reversed', c, b, a FROM n WHERE b > a), o AS (SELECT *, lag(b) OVER (PARTITION BY input, c ORDER BY a, b) AS p FROM v) SELECT input, CASE WHEN bool_or(b < a) OR bool_or(coalesce(p >= a, false)) THEN 'ValueError' ELSE 'ok' END AS outcome FROM o GROUP BY input")
def check_intervals(spark, d):
    from pyspark.sql import Window

    k = D.table(spark, d, "orders").select(F.col("o_custkey").alias("c"), F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("us"), "o_orderkey")
    n = k.select("c", (F.col("us") / F.lit(1e6)).alias("a"), (F.lead("us").over(Window.partitionBy("c").orderBy("us", "o_orderkey")) / F.lit(1e6)).alias("b")).where("b > a")
    inputs = {"half": (F.col("a"), F.col("a") + (F.col("b") - F.col("a")) / 2), "touching": (F.col("a"), F.col("b")), "reversed": (F.col("b"), F.col("a"))}
    return rows(spark, [(k, outcome(lambda v=v: V.intervals(n.select("c", v[0].alias("t_start"), v[1].alias("t_end")), ["c"]))) for k, v in inputs.items()], "input string, outcome string")


@query("SELECT 'equal' AS input, 'ok' AS outcome UNION ALL SELECT 'fewer', CASE WHEN count(*) FILTER (o_orderstatus = 'P') > 0 THEN 'ValueError' ELSE 'ok' END FROM orders")
def check_axes(spark, d):
    o = D.table(spark, d, "orders").select("o_custkey", "o_orderstatus")
    inputs = {"equal": o.where(F.lit(True)), "fewer": o.where("o_orderstatus <> 'P'")}
    return rows(spark, [(k, outcome(lambda v=v: V.same_axes(o, v, ["o_custkey", "o_orderstatus"]))) for k, v in inputs.items()], "input string, outcome string")


@query(f"{WITH_Y}, n AS (SELECT 'all' AS input, y, i FROM y UNION ALL SELECT 'cut', y, i FROM y WHERE NOT (y = 200 AND i >= 700)) SELECT input, CASE WHEN count(DISTINCT n) > 1 THEN 'ValueError' ELSE 'ok' END AS outcome FROM (SELECT input, y, count(*) AS n FROM n GROUP BY 1, 2) GROUP BY input")
def check_jobs_compatible(spark, d):
    y = D.probe(spark, d)
    inputs = {"all": y, "cut": y.where("NOT (y = 200 AND i >= 700)")}
    return rows(spark, [(k, outcome(lambda v=v: B.compatible(v, ["i"], "y"))) for k, v in inputs.items()], "input string, outcome string")


@query(f"{WITH_Y} SELECT 'values' AS input, CASE WHEN count(v) > 0 THEN 'ok' ELSE 'ValueError' END AS outcome FROM y UNION ALL SELECT 'nan', 'ValueError' UNION ALL SELECT 'none', 'ValueError'")
def check_finite(spark, d):
    y = D.probe(spark, d)
    inputs = {"values": y, "nan": y.withColumn("v", F.lit(float("nan"))), "none": y.where("v < -1e300")}
    return rows(spark, [(k, outcome(lambda v=v: V.any_finite(v))) for k, v in inputs.items()], "input string, outcome string")


@query(f"WITH {_SIZE_MEANS} SELECT 'each' AS input, 'ok' AS outcome UNION ALL SELECT 'two', CASE WHEN (SELECT count(*) FROM m) > 0 THEN 'RuntimeError' ELSE 'ok' END")
def check_one_file(spark, d):
    """A job with two files raises."""
    folder, first = _table_folder(spark, d), None
    listed = lambda: spark.read.format("binaryFile").load(folder).select(F.regexp_extract("path", r"/(\d+)_[^/]*$", 1).cast("long").alias("job_id"), "path")
    first = outcome(lambda: V.one_file_per_job(listed()))
    sinks.save_per_job(_size_means(spark, d), folder, "{job:05d}_more.parquet")
    return rows(spark, [("each", first), ("two", outcome(lambda: V.one_file_per_job(listed())))], "input string, outcome string")


@query(
    """WITH e AS (SELECT event_type AS pop, round(min(value), 2) AS lo, round(max(value), 2) AS hi, round(avg(value) - 50, 6) AS off, count(*) AS n FROM events GROUP BY 1), f AS (SELECT min(pop) AS first FROM e),
c AS (SELECT unnest(['threshold', 'digits', 'window', 'window reversed', 'rate', 'rate off', 'group', 'group unnamed', 'archive', 'manifest', 'config']) AS input)
SELECT pop, input, CASE input WHEN 'threshold' THEN CASE WHEN off < 0 THEN 'ValueError' ELSE 'ok' END WHEN 'digits' THEN CASE WHEN n % 2 = 1 THEN 'ValueError' ELSE 'ok' END WHEN 'window' THEN CASE WHEN lo < hi THEN 'ok' ELSE 'ValueError' END
WHEN 'window reversed' THEN CASE WHEN hi < lo THEN 'ok' ELSE 'ValueError' END WHEN 'rate' THEN 'ok' WHEN 'rate off' THEN 'ValueError' WHEN 'group' THEN 'ok' WHEN 'group unnamed' THEN CASE WHEN pop = first THEN 'ok' ELSE 'ValueError' END
WHEN 'archive' THEN CASE WHEN n % 2 = 1 THEN 'usable' ELSE 'shifted' END WHEN 'manifest' THEN CASE WHEN pop = first THEN 'ok' ELSE 'ValueError' END ELSE CASE WHEN n % 2 = 1 THEN 'ok' ELSE 'ValueError' END END AS outcome FROM e, f, c"""
)
def check_settings(spark, d):
    """What the checks say of settings drawn from each event type's values: size, spread, mean and count."""
    path = files.scratch(spark, "config")
    e = D.table(spark, d, "events").groupBy(F.col("event_type").alias("pop")).agg(F.round(F.min("value"), 2).alias("lo"), F.round(F.max("value"), 2).alias("hi"), F.round(F.avg("value") - 50, 6).alias("off"), F.count(F.lit(1)).alias("n"))
    found = e.orderBy("pop").collect()  # a row an event type
    pops, out = [r["pop"] for r in found], []
    for r in found:
        odd = r["n"] % 2 == 1
        files.write_text(spark, f"{path}/{r['pop']}.json", '{"a": 1}' if odd else '{"a": 1, "b": 2}')
        asked = {
            "threshold": lambda r=r: config.threshold(r["off"]), "digits": lambda odd=odd: config.digits(-1 if odd else 3),
            "window": lambda r=r: config.window((r["lo"], r["hi"])), "window reversed": lambda r=r: config.window((r["hi"], r["lo"])),
            "rate": lambda r=r: V.consistent_rate(V.sampling_rate(0.0, 1.0 / r["n"]), 1.0 / r["n"]), "rate off": lambda r=r: V.consistent_rate(r["n"] * 1.01, 1.0 / r["n"]),
            "group": lambda: config.trigger_pops("all", pops, "every"), "group unnamed": lambda r=r: config.trigger_pops([pops[0], r["pop"]] if r["pop"] != pops[0] else [r["pop"]], pops),
            "manifest": lambda r=r: sinks.validate_or_write(spark, f"{path}/m.json", {"n": pops.index(r["pop"])}), "config": lambda r=r: config.load_config(spark, f"{path}/{r['pop']}.json", {"a"}),
        }
        out += [(r["pop"], k, outcome(check)) for k, check in asked.items()]
        out.append((r["pop"], "archive", "usable" if config.usable_archive({"subtract_t0": not odd}, pops, r["pop"]) else "shifted"))
    return rows(spark, out, "pop string, input string, outcome string")


# --- caches and lineage -----------------------------------------------------------------


@query(f"{WITH_X} SELECT pop_ord AS job_id, i, v FROM x WHERE i >= 24 AND i < 200")
def gridded_files(spark, d):
    """Each population's rates in a gridded file of its own, read by slabs of 50 hours; the hours' range is pruned in the slabs."""
    folder = files.scratch(spark, "gridded")
    x = D.hourly(spark, d).join(D.pops(spark, d), "pop").select(F.col("pop_ord").cast("long").alias("job_id"), "i", "v")
    gridded.save_job_gridded(x, folder, "rates_{job:05d}.nc", ["i"], "v")
    out = gridded.read_job_gridded(spark, folder, "rates_{job:05d}.nc", "v", slab=400)
    return out.where("i >= 24 AND i < 200").select("job_id", "i", "v")


@query(f"{WITH_S}, k AS (SELECT gid, c_nationkey AS job_id, pop, t FROM s JOIN customer ON gid = c_custkey) SELECT job_id, pop, gid, count(*) AS n, round(min(t), 6) AS first, round(max(t), 6) AS last FROM k GROUP BY 1, 2, 3")
def ragged_archives(spark, d):
    """Spikes by nation as archives, one a job, and read again."""
    folder = files.scratch(spark, "archives")
    c = D.table(spark, d, "customer").select(F.col("c_custkey").alias("gid"), F.col("c_nationkey").cast("long").alias("job_id"))
    sizes = {r["pop"]: r["n_cells"] for r in D.pops(spark, d).orderBy("pop_ord").collect()}  # populations of a model
    archives.save_ragged(D.spikes(spark, d).join(c, "gid"), folder, sizes)
    out = jobs.read_ragged(spark, folder).groupBy("job_id", "pop", "gid")
    return out.agg(F.count(F.lit(1)).alias("n"), F.round(F.min("t"), 6).alias("first"), F.round(F.max("t"), 6).alias("last"))


@query(f"{WITH_X}, k AS (SELECT count(*) AS n, sum(v) AS total FROM x) SELECT run, hit, n, total FROM k, (VALUES ('first', false), ('again', true), ('other engine', true), ('other bin', false)) r(run, hit)")
def cached_rates(spark, d):
    """A result that is computed once: again, with an execution-only parameter (hits), and with another parameter (a miss)."""
    path = files.scratch(spark, "cache") + "/rates"
    out = []
    for run, params in (("first", {"dt": 3600}), ("again", {"dt": 3600}), ("other engine", {"dt": 3600, "engine": "x"}), ("other bin", {"dt": 1800})):
        df, hit = cache.load_or_run(spark, path, lambda: D.hourly(spark, d), "rates", params, f"{d}/events.parquet")
        n, total = df.agg(F.count(F.lit(1)), F.sum("v")).first()
        out.append((run, hit, n, total))
    return rows(spark, out, "run string, hit boolean, n long, total double")


@query(
    """SELECT run, kind, hit, count(*) + any_value(more) AS n, round(sum(value) + 0.5 * any_value(more), 6) AS total FROM events,
(VALUES ('first', 'click', false, 0), ('other rows of the file', 'view', false, 0), ('another order', 'view', true, 0), ('a value moved', 'view', false, 0), ('one row more', 'view', false, 1), ('first again', 'click', false, 0)) r(run, kind, hit, more)
WHERE event_type = kind GROUP BY run, kind, hit"""
)
def cached_sources(spark, d):
    """Results of tables that share a file, or have none: each is known by its rows."""
    path = files.scratch(spark, "cache") + "/sums"
    events = D.table(spark, d, "events").select("event_type", "user_id", "value")
    of = lambda kind: events.where(F.col("event_type") == kind)
    moved = of("view").withColumn("user_id", F.when(F.col("user_id") == F.lit(events.agg(F.min("user_id")).first()[0]), F.col("user_id") - 1).otherwise(F.col("user_id")))
    extra = spark.createDataFrame([("view", 0, 0.5)], "event_type string, user_id long, value double").select(*(F.col(f.name).cast(f.dataType) for f in events.schema))
    runs = [("first", "click", of("click")), ("other rows of the file", "view", of("view")), ("another order", "view", of("view").repartition(7, "user_id")), ("a value moved", "view", moved), ("one row more", "view", of("view").unionByName(extra)), ("first again", "click", of("click"))]
    out = []
    for run, kind, source in runs:
        df, hit = cache.load_or_run(spark, path, lambda source=source: source.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")), "sums", None, source)
        n, total = df.first()
        out.append((run, kind, hit, n, round(total, 6)))
    return rows(spark, out, "run string, kind string, hit boolean, n long, total double")


@query("SELECT * FROM (VALUES ('same', true), ('order', true), ('execution', true), ('value', false), ('step', false), ('source', false), ('mismatch raises', true), ('upstream', true)) t(what, same)")
def cache_records(spark, d):
    """Which records have the same id, and that a mismatch raises where it is asked to."""
    a = cache.make_info("rates", {"dt": 1, "pops": ("x", "y")}, None)["cache_id"]
    one = lambda step, params, source=None: cache.make_info(step, params, source)["cache_id"] == a
    path = files.scratch(spark, "records") + "/t"
    cache.load_or_run(spark, path, lambda: D.pops(spark, d), "pops", {"k": 1})
    raised = outcome(lambda: cache.load_or_run(spark, path, lambda: D.pops(spark, d), "pops", {"k": 2}, on_mismatch="raise"))
    upstream = cache.fingerprint(spark, path) == {"cache_id": sinks.load_meta(spark, path)["cache_id"]}
    found = [("same", one("rates", {"dt": 1, "pops": ["x", "y"]})), ("order", one("rates", {"pops": ["x", "y"], "dt": 1})), ("execution", one("rates", {"dt": 1, "pops": ["x", "y"], "compute": True})), ("value", one("rates", {"dt": 2, "pops": ["x", "y"]})), ("step", one("psd", {"dt": 1, "pops": ["x", "y"]})), ("source", one("rates", {"dt": 1, "pops": ["x", "y"]}, {"f": 1})), ("mismatch raises", raised == "ValueError"), ("upstream", upstream)]
    return rows(spark, found, "what string, same boolean")


@query(f"{WITH_Y}, k AS (SELECT y, i, v - avg(v) OVER (PARTITION BY y) AS v FROM y WHERE t <= 864000) SELECT y, i, round(v, 6) AS v, 'between,demean' AS steps FROM k")
def lineage_steps(spark, d):
    """A result that lists its steps, written and read back."""
    path = files.scratch(spark, "lineage") + "/t"
    made = lineage.Result(D.probe(spark, d)).then("between", L.between, column="t", lo=None, hi=864000.0).then("demean", W.demean, by=["y"])
    made.save(path)
    back = lineage.load(spark, path)
    return back.df.select("y", "i", r6("v", "v"), F.lit(",".join(s["name"] for s in back.steps)).alias("steps"))


# --- sweeps in one call ------------------------------------------------------------------

_GRID = "SELECT DISTINCT p_size AS size FROM part"


def _size_grid(spark, d) -> DataFrame:
    """Sizes as a parameter; 99 is a combination without a job."""
    sizes = D.table(spark, d, "part").select(F.col("p_size").cast("long").alias("size")).distinct()
    return sizes.withColumn("job_id", F.col("size")).unionByName(spark.range(1).select(F.lit(99).cast("long").alias("size"), F.lit(None).cast("long").alias("job_id")))


@query(f"WITH {_SIZE_MEANS} SELECT size, brand, round(v, 6) AS v FROM m UNION ALL SELECT 99, NULL, NULL")
def sweep_tables(spark, d):
    return Z.collect_tables(spark, _size_grid(spark, d), _table_folder(spark, d), variable="v").select("size", "brand", r6("v", "v"))


def _region_grid(spark, d) -> DataFrame:
    return D.table(spark, d, "region").select(F.col("r_name").alias("region"), F.col("r_regionkey").cast("long").alias("job_id"))


@query(f"SELECT r_name AS region, label, n_name, v FROM region LEFT JOIN ({_SETS}) s ON job_id = r_regionkey")
def sweep_sets(spark, d):
    return Z.collect_sets(spark, _region_grid(spark, d), _set_folder(spark, d)).select("region", "label", "n_name", F.round("v", 2).alias("v"))


@query(f"SELECT r_name AS region, n_name, v FROM region LEFT JOIN ({_SETS}) s ON job_id = r_regionkey AND label = 'BUILDING'")
def sweep_set_selected(spark, d):
    return Z.collect_sets(spark, _region_grid(spark, d), _set_folder(spark, d), labels=["BUILDING"], combine="select", skip_missing=True).select("region", "n_name", F.round("v", 2).alias("v"))


@query(f"WITH {_SIZE_MEANS}, b AS (SELECT unnest(['Brand#11', 'Brand#12', 'none']) AS brand) SELECT z.size, var AS variable, b.brand, round(CASE WHEN var = 'mean' THEN m.v ELSE m.n END, 6) AS value FROM ({_GRID}) z CROSS JOIN b CROSS JOIN (SELECT unnest(['mean', 'n']) AS var) LEFT JOIN m ON m.size = z.size AND m.brand = b.brand UNION ALL SELECT 99, NULL, NULL, NULL")
def sweep_json(spark, d):
    """Two variables; declared brands only, one of which no document has."""
    out = Z.collect_json(spark, _size_grid(spark, d), _json_folder(spark, d), {"mean": "stats.mean", "n": "stats.n"}, ["brand"], {"brand": ["Brand#11", "Brand#12", "none"]})
    return out.select("size", "variable", "brand", r6("value", "value"))


@query(f"WITH {_SIZE_MEANS} SELECT size, brand, stat, round(CASE WHEN stat = 'n' THEN n ELSE v END, 6) AS value FROM m, (SELECT unnest(['n', 'v']) AS stat) UNION ALL SELECT 99, NULL, NULL, NULL")
def sweep_json_lists(spark, d):
    """Lists as leaves."""
    out = Z.collect_json(spark, _size_grid(spark, d), _json_folder(spark, d), {"pair": "stats.pair"}, ["brand"], last=["n", "v"], dim="stat")
    return out.select("size", "brand", "stat", r6("value", "value"))


@query(f"WITH {_SIZE_MEANS} SELECT size, brand, stat, CASE stat WHEN 'n' THEN 'parts' ELSE 'price' END AS unit, round(CASE WHEN stat = 'n' THEN n ELSE v END, 6) AS value FROM m, (SELECT unnest(['n', 'v']) AS stat) UNION ALL SELECT 99, NULL, NULL, NULL, NULL")
def sweep_json_coords(spark, d):
    """An extra coordinate along the lists."""
    out = Z.collect_json(spark, _size_grid(spark, d), _json_folder(spark, d), {"pair": "stats.pair"}, ["brand"], last=["n", "v"], dim="stat", extra={"unit": ("stat", ["parts", "price"])})
    return out.select("size", "brand", "stat", "unit", r6("value", "value"))


def _customer_grid(spark, d) -> DataFrame:
    return D.table(spark, d, "customer").select(F.col("c_name").alias("name"), F.col("c_custkey").alias("job_id"))


@query(f"{WITH_Q}, g AS (SELECT q.*, i AS bin FROM q, (SELECT unnest(range(4)) AS i)), n AS (SELECT c.job_id, c.pop, floor(l_extendedprice / 1000 / 25)::BIGINT AS bin, count(*) AS n FROM c JOIN lineitem ON l_orderkey = gid WHERE l_extendedprice / 1000 BETWEEN 0 AND 100 GROUP BY 1, 2, 3), r AS (SELECT job_id, pop, bin, round(coalesce(n, 0) / 25.0 / n_cells, 9) AS rate FROM g LEFT JOIN n USING (job_id, pop, bin)) SELECT c_name AS name, pop, bin, rate FROM customer LEFT JOIN r ON job_id = c_custkey")
def sweep_rates(spark, d):
    out = Z.collect_rates(_customer_grid(spark, d), D.results(spark, d, N.TRAINS), (0.0, 100.0), 25.0, skip_missing=True)
    return out.select("name", "pop", "bin", F.round("rate", 9).alias("rate"))


@query(f"{WITH_C} SELECT c_name AS name, y, i, v FROM customer LEFT JOIN (SELECT job_id, (k + 1) * 100.0::DOUBLE AS y, ord AS i, price * (k + 1) AS v FROM c, (SELECT unnest(range(3)) AS k)) r ON job_id = c_custkey")
def sweep_lfp(spark, d):
    return Z.collect_lfp(_customer_grid(spark, d), D.results(spark, d), skip_missing=True, same_axes=False).select("name", "y", "i", "v")


@query(f"{_TRAINS}, g AS (SELECT u.*, i AS bin FROM u, (SELECT unnest(range(9)) AS i)), n AS (SELECT job_id, pop, floor((t - 86400) / 86400)::BIGINT AS bin, count(*) AS n FROM k WHERE t BETWEEN 86400 AND 864000 GROUP BY 1, 2, 3), r AS (SELECT job_id, pop, bin, round(coalesce(n, 0) / 86400.0 / n_cells, 12) AS rate FROM g LEFT JOIN n USING (job_id, pop, bin)) SELECT n_name AS nation, pop, bin, rate FROM nation LEFT JOIN r ON job_id = n_nationkey")
def sweep_spike_rates(spark, d):
    """The archive's own window, from 0 as its times are shifted."""
    grid = D.table(spark, d, "nation").select(F.col("n_name").alias("nation"), F.col("n_nationkey").cast("long").alias("job_id"))
    return Z.collect_spike_rates(spark, grid, _archive(spark, d), 86400.0, skip_missing=True).select("nation", "pop", "bin", F.round("rate", 12).alias("rate"))


@query(f"{_TRAINS} SELECT job_id, count(*) AS n, CASE WHEN job_id < 10 THEN 1 ELSE 2 END AS made_in FROM k GROUP BY job_id")
def materialised_jobs(spark, d):
    """Two calls: the second reads only jobs that are not there yet; other settings raise."""
    path = files.scratch(spark, "jobs") + "/spikes"
    c = D.table(spark, d, "customer").select(F.col("c_custkey").alias("gid"), F.col("c_nationkey").cast("long").alias("job_id"))
    spikes = D.spikes(spark, d).join(c, "gid")
    grid = D.table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("job_id"))

    def load(run: int):
        return lambda wanted: spikes.where(F.col("job_id").isin(wanted)).select("job_id", "pop", "gid", "t", F.lit(run).alias("made_in"))

    Z.materialise_spikes(spark, grid.where("job_id < 10"), path, load(1), {"ms": False})
    out = Z.materialise_spikes(spark, grid, path, load(2), {"ms": False})
    if outcome(lambda: Z.materialise_spikes(spark, grid, path, load(3), {"ms": True})) != "ValueError":
        raise AssertionError("other settings must raise")
    return out.groupBy(F.col("job_id").cast("long").alias("job_id"), "made_in").agg(F.count(F.lit(1)).alias("n"))


# --- selections, events and triggers ---------------------------------------------------------


@query(f"WITH c AS (SELECT DISTINCT p_size * 10.0::DOUBLE AS y FROM part), q AS (SELECT unnest(range(4)) AS ord, unnest([5.0, 15.0, 203.0, 495.0])::DOUBLE AS y_req), k AS (SELECT q.ord, c.y, row_number() OVER (PARTITION BY q.ord ORDER BY abs(c.y - q.y_req), c.y) AS rn FROM q, c) SELECT y, min(ord) AS ord FROM k WHERE rn = 1 GROUP BY y")
def plot_depths(spark, d):
    channels = D.table(spark, d, "part").select((F.col("p_size") * 10.0).alias("y")).distinct()
    targets = spark.createDataFrame(list(enumerate([5.0, 15.0, 203.0, 495.0])), "ord long, y_req double")
    return L.nearest(channels, targets, tie="first").select("y", "ord")


@query(f"{WITH_Y} SELECT DISTINCT y FROM y WHERE y IN (100, 200, 300, 400)")
def stepped_depths(spark, d):
    return L.exact(D.probe(spark, d).select("y").distinct(), "y", L.stepped(400.0, 100.0, 100.0))


@query("SELECT p_brand AS layer, round(min(p_size) / 100 * 1000, 6) AS y0, round(max(p_size) / 100 * 1000, 6) AS y1 FROM part GROUP BY 1 HAVING round(max(p_size) / 100 * 1000, 6) >= 40 AND round(min(p_size) / 100 * 1000, 6) <= 60")
def visible_layers(spark, d):
    """Brands as layers over the sizes of their parts, in a layers' file, and those that a plot from 40 to 60 shows."""
    path = files.scratch(spark, "layers")
    spans = D.table(spark, d, "part").groupBy("p_brand").agg((F.min("p_size") / 100).alias("a"), (F.max("p_size") / 100).alias("b")).collect()  # some dozen layers
    files.write_text(spark, f"{path}/l.json", json.dumps({"layers": {r["p_brand"]: [r["a"], r["b"]] for r in spans}, "y_size_um": 1000}))
    ranges, size = config.load_layers(spark, f"{path}/l.json")
    layers = spark.createDataFrame([(k, a, b) for k, (a, b) in ranges.items()], "layer string, y0 double, y1 double")
    return L.visible_layers(layers, size, 40.0, 60.0).select("layer", r6("y0", "y0"), r6("y1", "y1"))


@query(
    """WITH c AS (SELECT DISTINCT p_size * 10.0::DOUBLE AS y FROM part), k AS (SELECT 'all' AS request, y, y AS y_req, row_number() OVER (ORDER BY y) - 1 AS ord FROM c
UNION ALL SELECT 'span', y, y, row_number() OVER (ORDER BY y) - 1 FROM c WHERE y BETWEEN 95 AND 305),
q AS (SELECT 'list' AS request, unnest(range(3)) AS ord, unnest([5.0, 14.9, 900.0])::DOUBLE AS y_req UNION ALL SELECT 'steps', i, 100.0 + 75 * i FROM (SELECT unnest(range(4)) AS i)),
n AS (SELECT q.*, c.y, row_number() OVER (PARTITION BY request, q.ord ORDER BY abs(c.y - q.y_req), c.y DESC) AS rn FROM q, c), m AS (SELECT request, y, arg_min(y_req, ord) AS y_req, min(ord) AS ord FROM n WHERE rn = 1 GROUP BY 1, 2)
SELECT * FROM k UNION ALL SELECT * FROM m"""
)
def depth_requests(spark, d):
    """Depths as users ask for them: all, within a reversed span, by a list and by steps."""
    channels = D.table(spark, d, "part").select((F.col("p_size") * 10.0).alias("y"))
    asks = {"all": {"values": " All "}, "span": {"span": (305.0, 95.0)}, "list": {"values": [5.0, 14.9, 900.0]}, "steps": {"span": (100.0, 325.0), "step": 75.0}}
    parts = [L.requested(channels, **how).select(F.lit(k).alias("request"), "y", "y_req", "ord") for k, how in asks.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)


@query(f"{_MEANS} SELECT a.pop AS pop_i, b.pop AS pop_j, round(a.v - b.v, 6) AS v FROM m a JOIN m b ON a.pop < b.pop WHERE abs(a.v - b.v) >= 0.01")
def pairs_above(spark, d):
    mean = D.hourly(spark, d).groupBy("pop").agg(F.avg("v").alias("v"))
    both = C.unordered(D.pops(spark, d), False).join(mean.toDF("pop_i", "vi"), "pop_i").join(mean.toDF("pop_j", "vj"), "pop_j")
    return L.above(both.select("pop_i", "pop_j", (F.col("vi") - F.col("vj")).alias("v")), "v", 0.01).withColumn("v", F.round("v", 6))


@query(f"{WITH_S} SELECT grp AS \"group\", pop FROM (VALUES ('buying', 'purchase'), ('buying', 'signup'), ('looking', 'view'), ('looking', 'none')) g(grp, pop) WHERE pop IN (SELECT pop FROM s)")
def pop_groups(spark, d):
    return L.groups(D.pops(spark, d), {"buying": ["purchase", "signup"], "looking": ["view", "none"]})


@query(f"{WITH_Y}, p AS (SELECT quantile_cont(abs(v), 0.95) AS p95 FROM y) SELECT y, i, round(v * 2 * 50 / p95 + y, 6) AS x FROM y, p")
def stacked_traces(spark, d):
    return E.stacked_scale(D.probe(spark, d), 2.0, 50.0).select("y", "i", r6("x", "x"))


_RUNS = f"{WITH_Y}, m AS (SELECT y, i, CASE WHEN v > 200 THEN 1 ELSE 0 END AS m FROM y), b AS (SELECT y, m, m = 1 AND coalesce(lag(m) OVER (PARTITION BY y ORDER BY i), 0) = 0 AS first FROM m), n AS (SELECT y, count(*) FILTER (first) AS n FROM b GROUP BY y HAVING count(*) FILTER (first) > 0)"


def _keyed_runs(spark, d) -> DataFrame:
    on = M.runs(D.probe(spark, d).withColumn("m", (F.col("v") > 200).cast("int")), ["y"]).where("state = 1")
    return on.withColumn("channel", M.channel_key(F.col("y")))


@query(f"{_RUNS} SELECT y, n FROM n")
def channel_intervals(spark, d):
    return E.intervals_per_channel(_keyed_runs(spark, d)).select("y", "n")


@query(f"{_RUNS} SELECT y, n FROM n ORDER BY y LIMIT 1")
def first_interval_channel(spark, d):
    return E.first_channel(_keyed_runs(spark, d)).select("y", "n")


@query("SELECT event_id, user_id AS channel, value, CASE WHEN event_type = 'click' THEN length(event_type) END AS extra FROM events")
def event_concat(spark, d):
    e = D.table(spark, d, "events").select("event_id", F.col("user_id").alias("channel"), "value", "event_type")
    clicks = e.where("event_type = 'click'").select("event_id", "channel", "value", F.length("event_type").cast("long").alias("extra"))
    return E.concat([clicks, e.where("event_type <> 'click'").drop("event_type")])


@query(f"{WITH_Y} SELECT y, count(*) AS n, round(sum(v), 4) AS total, (SELECT count(*) FROM events) AS events FROM y GROUP BY y")
def packed_events(spark, d):
    """Traces, a spectrogram of their length and events packed, each table written and read back, and unpacked."""
    from .operators import traces as T

    traces = T.to_traces(D.probe(spark, d), ["y"], 0.0, D.HOUR).withColumn("channel", M.channel_key(F.col("y")))
    spectrogram = traces.select("channel", F.lit(1.0).alias("freq"), F.transform("values", lambda v: v * v).alias("power"))
    events = D.table(spark, d, "events").select("event_id", F.col("value").alias("peak"), F.array("value").alias("filtsig"))
    packed, path = E.pack(traces, spectrogram, events), files.scratch(spark, "packed")
    for name, df in packed.items():
        sinks.save(df, f"{path}/{name}")
    back = {name: sinks.load(spark, f"{path}/{name}") for name in packed}
    n = E.unpack(back).agg(F.count("event_id").alias("events"))
    total = F.round(F.aggregate("values", F.lit(0.0), lambda a, v: a + v), 4)
    return back["traces"].select("y", F.size("values").cast("long").alias("n"), total.alias("total")).crossJoin(F.broadcast(n))  # one row


@query(f"{WITH_S} SELECT pop, count(*) AS n FROM s WHERE pop IN ('click', 'view') GROUP BY pop")
def shared_triggers(spark, d):
    """Only populations that triggers and signal share remain."""
    signal = D.hourly(spark, d).where(F.col("pop").isin("click", "view"))
    return A.shared_pops(D.spikes(spark, d), signal).groupBy("pop").agg(F.count(F.lit(1)).alias("n"))


@query(f"{WITH_X}, r AS (SELECT pop, CAST(round_even(t / 3600.0, 0) AS BIGINT) AS c FROM s), e AS (SELECT * FROM r WHERE c - 1 >= 0 AND c + 2 < (SELECT hours FROM span)), w AS (SELECT e.pop, k, avg(x.v) AS v FROM e, (SELECT unnest(range(-1, 3)) AS k), x WHERE x.pop = e.pop AND x.i = e.c + k GROUP BY 1, 2) SELECT pop, k, round(v - avg(v) OVER (PARTITION BY pop), 6) AS v FROM w")
def sta_centred(spark, d):
    """Triggers in milliseconds; averages less their mean."""
    triggers = D.spikes(spark, d).select("pop", A.to_seconds(F.col("t") * 1000.0, "ms").alias("t"))
    rows_ = A.epochs_long(triggers, D.hourly(spark, d), ["pop"], 0.0, D.HOUR, D.hours(spark, d), (-D.HOUR, 2 * D.HOUR))
    return A.center_states(A.average(rows_, ["pop"], D.HOUR), ["pop"]).select("pop", "k", r6("v", "v"))


@query(f"{WITH_S}, u AS (SELECT DISTINCT gid FROM s), n AS (SELECT gid, floor(t / 86400)::BIGINT AS bin, count(*) AS n FROM s WHERE t BETWEEN 0 AND 864000 GROUP BY 1, 2) SELECT u.gid, b.bin, round(coalesce(n.n, 0) / 86400.0, 12) AS rate FROM u CROSS JOIN (SELECT unnest(range(10)) AS bin) b LEFT JOIN n ON n.gid = u.gid AND n.bin = b.bin")
def rate_dynamics_cells(spark, d):
    s = D.spikes(spark, d)
    return R.rate_dynamics(s, s.select("gid").distinct(), ["gid"], 0.0, 864000.0, 86400.0).select("gid", "bin", F.round("rate", 12).alias("rate"))


@query("SELECT event_id, greatest(least(value / 10, 30.0), 4.0) AS frame_lo, greatest(least(value / 10 + 5, 30.0), 4.0) AS frame_hi FROM events")
def clipped_frames(spark, d):
    frames = D.table(spark, d, "events").select("event_id", (F.col("value") / 10).alias("minF"), (F.col("value") / 10 + 5).alias("maxF"))
    return E.clip_frequencies(frames, 4.0, 30.0).select("event_id", "frame_lo", "frame_hi")
