"""Queries over the driver's tables, one or more per operator family, with the same in SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from .catalog import QUERIES, SQL, Query, query, r6
from .functions import kernels as K
from .operators import batch as B
from .operators import bursts as U
from .operators import chunks as H
from .operators import correlograms as G
from .operators import events as E
from .operators import masks as M
from .operators import pairs as C
from .operators import select as L
from .operators import spikes as R
from .operators import sta as A
from .operators import traces as T
from .operators import triggered
from .operators import windows as W
from .plans import driver as D
from .plans import probe as J
from .plans import workflows as P_
from .sources import files
from .streaming.rates import windowed_rates

S, P, X, Y = D.S, D.P, D.X, D.Y
WITH_S, WITH_P, WITH_X, WITH_Y = f"WITH {D.SPAN}, {S}", f"WITH {D.SPAN}, {S}, {P}", f"WITH {D.SPAN}, {S}, {P}, {X}", f"WITH {D.SPAN}, {Y}"


def queries() -> dict[str, Query]:
    from . import registry_results  # noqa: F401  (adds its queries to the catalogue)

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    from . import registry_results  # noqa: F401

    return dict(SQL)


# --- spikes and rates ---------------------------------------------------------


@query(f"{WITH_X} SELECT pop, i AS bin, i * 3600.0::DOUBLE AS t, round(v / 3600.0, 9) AS rate FROM x")
def rate_dynamics(spark, d):
    out = R.rate_dynamics(D.spikes(spark, d), D.pops(spark, d), ["pop"], 0.0, D.t_end(spark, d), D.HOUR)
    return out.select("pop", "bin", "t", F.round("rate", 9).alias("rate"))


@query(f"{WITH_P} SELECT p.pop, round(count(s.t) FILTER (s.t BETWEEN 86400 AND 864000) / 777600.0 / p.n_cells, 12) AS rate FROM p LEFT JOIN s USING (pop) GROUP BY p.pop, p.n_cells")
def net_rates(spark, d):
    out = R.rates(D.spikes(spark, d), D.pops(spark, d), ["pop"], 86400.0, 864000.0, F.col("n_cells"))
    return out.select("pop", F.round("rate", 12).alias("rate"))


@query(f"{WITH_S}, u AS (SELECT DISTINCT pop, gid FROM s) SELECT u.pop, u.gid, round(count(s.t) FILTER (s.t BETWEEN 0 AND 432000) / 432000.0, 12) AS rate FROM u LEFT JOIN s USING (pop, gid) GROUP BY u.pop, u.gid")
def rate_per_cell(spark, d):
    s = D.spikes(spark, d)
    return R.rates(s, s.select("pop", "gid").distinct(), ["pop", "gid"], 0.0, 432000.0).select("pop", "gid", F.round("rate", 12).alias("rate"))


_CV = f"{WITH_S}, d AS (SELECT pop, gid, t - lag(t) OVER (PARTITION BY pop, gid ORDER BY t) AS d FROM s WHERE t BETWEEN 0 AND (SELECT hours * 3600 FROM span)), c AS (SELECT pop, gid, stddev_pop(d) / avg(d) AS cv, count(*) AS n_spikes FROM d GROUP BY pop, gid HAVING count(*) >= 3)"


@query(f"{_CV} SELECT pop, gid, round(cv, 6) AS cv, n_spikes FROM c")
def isi_cv_cell(spark, d):
    return R.interval_cv(D.spikes(spark, d), 0.0, D.t_end(spark, d)).select("pop", "gid", r6("cv", "cv"), "n_spikes")


@query(f"{_CV} SELECT pop, round(avg(cv), 6) AS cv, count(*) AS n_cells FROM c GROUP BY pop")
def isi_cv_pop(spark, d):
    return R.pop_cv(R.interval_cv(D.spikes(spark, d), 0.0, D.t_end(spark, d))).select("pop", r6("cv", "cv"), "n_cells")


@query(f"{WITH_X} SELECT pop, i % 24 AS bin, round(sum(v) / 3600.0 / (SELECT hours / 24 FROM span), 9) AS rate FROM x GROUP BY 1, 2")
def rate_epoch_fold(spark, d):
    out = R.rate_dynamics(D.spikes(spark, d), D.pops(spark, d), ["pop"], 0.0, D.t_end(spark, d), D.HOUR, epoch=86400.0)
    return out.select("pop", "bin", F.round("rate", 9).alias("rate"))


@query(f"{WITH_P}, u AS (SELECT pop, n_cells FROM p UNION ALL SELECT 'none', 0), g AS (SELECT pop, n_cells, i FROM u, (SELECT unnest(range(hours // 24)) AS i FROM span)) SELECT g.pop, g.i AS bin, CASE WHEN n_cells = 0 THEN 'NaN'::DOUBLE ELSE round(coalesce(n, 0) / 86400.0 / n_cells, 12) END AS rate FROM g LEFT JOIN (SELECT pop, CAST(floor(t / 86400.0) AS BIGINT) AS i, count(*) AS n FROM s GROUP BY 1, 2) c USING (pop, i)")
def rate_empty_pop(spark, d):
    units = D.pops(spark, d).select("pop", "n_cells").unionByName(spark.range(1).select(F.lit("none").alias("pop"), F.lit(0).cast("long").alias("n_cells")))
    return R.rate_dynamics(D.spikes(spark, d), units, ["pop"], 0.0, D.t_end(spark, d), 86400.0, cells="n_cells").select("pop", "bin", F.round("rate", 12).alias("rate"))


@query(f"{WITH_S} SELECT pop, gid, t FROM s WHERE gid IN (SELECT c_custkey FROM customer WHERE c_nationkey < 5)")
def pop_membership_semi(spark, d):
    cells = D.table(spark, d, "customer").where("c_nationkey < 5").select(F.col("c_custkey").alias("gid"))
    return R.members(D.spikes(spark, d), cells).select("pop", "gid", "t")


@query(f"{WITH_S} SELECT n_name AS pop, gid, round_even((t - 86400.0) * 1000.0, 3) AS t FROM s JOIN customer ON gid = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE t >= 86400 AND t <= 172800")
def spike_extract(spark, d):
    cells = D.table(spark, d, "customer").join(D.table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("gid"), F.col("n_name").alias("pop"))
    return R.extract(D.spikes(spark, d), cells, (86400.0, 172800.0), subtract_t0=True, ms=True, ndigits=3)


@query(f"{WITH_S} SELECT pop, gid, list_sort(list(t))::VARCHAR AS times, count(*) AS n FROM s GROUP BY pop, gid")
def combine_spikes(spark, d):
    out = R.combine(D.spikes(spark, d).withColumn("t", F.col("t")), ["pop", "gid"])
    joined = F.concat(F.lit("["), F.array_join(F.transform("times", lambda x: x.cast("decimal(20,6)").cast("string")), ", "), F.lit("]"))
    return out.select("pop", "gid", joined.alias("times"), F.size("times").cast("long").alias("n"))


SQL["combine_spikes"] = f"{WITH_S} SELECT pop, gid, '[' || string_agg(CAST(CAST(t AS DECIMAL(20,6)) AS VARCHAR), ', ' ORDER BY t) || ']' AS times, count(*) AS n FROM s GROUP BY pop, gid"


@query("SELECT n_name AS pop, count(c_custkey) AS n_cells FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_name")
def net_size(spark, d):
    pops = D.table(spark, d, "nation").select(F.col("n_name").alias("pop"), "n_nationkey")
    cells = D.table(spark, d, "customer").join(pops, F.col("c_nationkey") == F.col("n_nationkey")).select("pop", F.col("c_custkey").alias("gid"))
    return R.pop_sizes(pops, cells)


@query("SELECT event_type AS pop, date_trunc('hour', ts)::VARCHAR AS t_start, count(*) AS n FROM events GROUP BY 1, 2")
def windowed_counts(spark, d):
    out = windowed_rates(D.table(spark, d, "events"))
    return out.select("pop", F.date_format("t_start", "yyyy-MM-dd HH:mm:ss").alias("t_start"), "n")


# --- stencils -------------------------------------------------------------------


@query(f"{WITH_Y} SELECT y, i, round(coalesce(lead(v) OVER w, v) - v, 6) AS v FROM y WINDOW w AS (PARTITION BY i ORDER BY y)")
def diff_n1(spark, d):
    return W.bipolar(D.probe(spark, d)).select("y", "i", r6("v", "v"))


_CSD = f"{WITH_Y} SELECT y, i, round(coalesce(lead(v) OVER w, v) - 2 * v + coalesce(lag(v) OVER w, v), 6) AS v FROM y WINDOW w AS (PARTITION BY i ORDER BY y)"


@query(_CSD)
def diff_n2_csd(spark, d):
    return W.csd(D.probe(spark, d)).select("y", "i", r6("v", "v"))


@query(_CSD)
def csd_traces(spark, d):
    return H.to_long(W.csd_traces(H.to_chunks(D.probe(spark, d), ["y"], 64), by=["chunk"]), ["y"], 64).select("y", "i", r6("v", "v"))


@query(_CSD)
def diff_traces(spark, d):
    chunks = H.to_chunks(D.probe(spark, d), ["y"], 64)  # all depths of a chunk of time are a group
    return H.to_long(T.difference(chunks, ["chunk"], "y", 2), ["y"], 64).select("y", "i", r6("v", "v"))


@query(f"{WITH_Y} SELECT y, i, round(v - avg(v) OVER (PARTITION BY y), 6) AS v FROM y")
def demean(spark, d):
    return W.demean(D.probe(spark, d), ["y"]).select("y", "i", r6("v", "v"))


@query(f"{WITH_Y} SELECT y, i, round(v / stddev_pop(v) OVER (PARTITION BY y), 6) AS v FROM y")
def unit_deviation(spark, d):
    return W.unit_deviation(D.probe(spark, d), ["y"]).select("y", "i", r6("v", "v"))


@query(f"{WITH_Y} SELECT y, i, v FROM (SELECT *, lag(v) OVER w AS l, lead(v) OVER w AS r FROM y WINDOW w AS (PARTITION BY y ORDER BY i)) WHERE v > l AND v > r AND v >= 100")
def signal_peaks(spark, d):
    return W.peaks(D.probe(spark, d), ["y"], "i", 100.0).select("y", "i", "v")


@query(
    f"""{WITH_Y}, z AS (SELECT y, i, t, v + CASE WHEN i IN (100, 300, 301, 500) THEN 1e6 ELSE 0 END AS v FROM y),
a AS (SELECT *, lag(v) OVER w AS l, lead(v) OVER w AS r, abs(v - lag(v) OVER w) AS d FROM z WINDOW w AS (PARTITION BY y ORDER BY i)),
m AS (SELECT y, median(d) AS med FROM a GROUP BY y), n AS (SELECT y, any_value(med) AS med, median(abs(d - med)) AS mad FROM a JOIN m USING (y) GROUP BY y),
f AS (SELECT *, coalesce((v - l) * (v - r) > 0 AND abs(v - (l + r) / 2) > greatest(med + 8 * 1.4826 * mad, 2.220446049250313e-16) AND abs(v - (l + r) / 2) > 5 * abs(r - l), false) AS f FROM a JOIN n USING (y)),
k AS (SELECT *, f AND NOT coalesce(lag(f) OVER w, false) AND NOT coalesce(lead(f) OVER w, false) AS repaired FROM f WINDOW w AS (PARTITION BY y ORDER BY i))
SELECT y, i, round(CASE WHEN repaired THEN (l + r) / 2 ELSE v END, 6) AS v, repaired FROM k"""
)
def outlier_repair(spark, d):
    spoiled = D.probe(spark, d).withColumn("v", F.col("v") + F.when(F.col("i").isin(100, 300, 301, 500), 1e6).otherwise(0.0))
    return W.repair_outliers(spoiled, ["y"]).select("y", "i", r6("v", "v"), "repaired")


@query(f"{WITH_X} SELECT pop, i, round(v / avg(v) FILTER (i BETWEEN 24 AND 167) OVER (PARTITION BY pop), 6) AS v FROM x")
def band_normalise(spark, d):
    return W.band_normalise(D.hourly(spark, d), ["pop"], 24, 167, "i", "v").select("pop", "i", r6("v", "v"))


@query(f"{WITH_X} SELECT pop, i, round(avg(v) OVER (PARTITION BY pop ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS v FROM x")
def rolling_mean(spark, d):
    return W.rolling_mean(D.hourly(spark, d), ["pop"], "i", 5, "v").select("pop", "i", r6("v", "v"))


_REACH = f"""{WITH_X}, k AS (SELECT k, exp(-0.5 * (k / 2.0) * (k / 2.0)) AS w FROM (SELECT unnest(range(-8, 9)) AS k)), kn AS (SELECT k, w / (SELECT sum(w) FROM k) AS w FROM k),
j AS (SELECT pop, i, w, CASE WHEN i + k < 0 THEN -(i + k) - 1 WHEN i + k >= (SELECT hours FROM span) THEN 2 * (SELECT hours FROM span) - 1 - (i + k) ELSE i + k END AS q FROM x, kn)"""
_GAUSS = f"""{_REACH} SELECT j.pop, j.i, round(sum(j.w * x.v), 6) AS v FROM j JOIN x ON x.pop = j.pop AND x.i = j.q GROUP BY j.pop, j.i"""


@query(_GAUSS)
def gaussian_smooth(spark, d):
    return W.gaussian_smooth(D.hourly(spark, d), ["pop"], "i", D.hours(spark, d), 2.0).select("pop", "i", r6("v", "v"))


@query(_GAUSS)
def gaussian_smooth_traces(spark, d):
    traces = T.to_traces(D.hourly(spark, d), ["pop"], 0.0, D.HOUR).withColumn("values", T.smoothed("values", 2.0))
    return T.to_long(traces, ["pop"]).select("pop", "i", r6("v", "v"))


# --- masks and intervals --------------------------------------------------------

_MASK = f"{WITH_Y}, m AS (SELECT y, i, t, v, CASE WHEN v > 200 THEN 1 ELSE 0 END AS m FROM y)"


def _mask(spark, d):
    return D.probe(spark, d).withColumn("m", (F.col("v") > 200).cast("int"))


@query(f"{_MASK}, r AS (SELECT *, sum(c) OVER (PARTITION BY y ORDER BY i) AS k FROM (SELECT *, CASE WHEN m <> lag(m) OVER (PARTITION BY y ORDER BY i) THEN 1 ELSE 0 END AS c FROM m)) SELECT y, m AS state, min(t) AS t_start, max(t) AS t_end, count(*) AS n FROM r GROUP BY y, k, m")
def mask_intervals(spark, d):
    return M.runs(_mask(spark, d), ["y"]).select("y", "state", "t_start", "t_end", "n")


@query(f"{_MASK} SELECT y, i, m FROM m")
def mask_rasterise(spark, d):
    rows = _mask(spark, d)
    on = M.runs(rows, ["y"]).where("state = 1")
    return M.rasterise(on, rows.select("y", "i"), ["y"], 0.0, D.HOUR).select("y", "i", "m")


@query(f"{_MASK} SELECT y, round(avg(v) FILTER (m = 1), 6) AS mean_in, round(avg(v) FILTER (m = 0), 6) AS mean_out, round(avg(m), 6) AS fraction FROM m GROUP BY y")
def in_out_burst_mean(spark, d):
    return M.conditional_means(_mask(spark, d), ["y"]).select("y", r6("mean_in", "mean_in"), r6("mean_out", "mean_out"), r6("fraction", "fraction"))


@query(f"{_MASK}, q AS (SELECT (gid % 4 + 1) * 100.0::DOUBLE AS y, t FROM ({S[6:-1]}) WHERE t <= (SELECT hours - 1 FROM span) * 3600) SELECT q.y, m.m AS state, count(*) AS n FROM q JOIN m ON m.y = q.y AND m.i = CAST(floor(q.t / 3600.0 + 0.5) AS BIGINT) GROUP BY 1, 2")
def mask_split_counts(spark, d):
    triggers = D.spikes(spark, d).select(((F.col("gid") % 4 + 1) * 100.0).alias("y"), "t")
    return A.split_by_mask(triggers, _mask(spark, d), ["y"], 0.0, D.HOUR, D.hours(spark, d)).groupBy("y", "state").agg(F.count(F.lit(1)).alias("n"))


@query()
def control_sampling(spark, d):
    scaled = W.unit_deviation(W.demean(D.probe(spark, d), ["y"]), ["y"])
    on = M.runs(scaled.withColumn("m", (F.col("v") > 2).cast("int")), ["y"]).withColumn("channel", M.channel_key(F.col("y")))
    return M.control_intervals(on.select("channel", "state", "t_start", "t_end"))


@query(
    f"""{WITH_Y}, m AS (SELECT y, i, t, CASE WHEN v > avg(v) OVER w + stddev_pop(v) OVER w THEN 1 ELSE 0 END AS m FROM y WINDOW w AS (PARTITION BY y)),
r AS (SELECT *, sum(c) OVER (PARTITION BY y ORDER BY i) AS k FROM (SELECT *, CASE WHEN m <> lag(m) OVER (PARTITION BY y ORDER BY i) THEN 1 ELSE 0 END AS c FROM m)),
z AS (SELECT y, m, max(t) - min(t) AS d FROM r GROUP BY y, k, m) SELECT y, count(*) AS n, sum(d) AS seconds, max(d) AS longest, count(*) AS inside, 0 AS overlaps FROM z WHERE m = 1 GROUP BY y"""
)
def control_checks(spark, d):
    """Controls of each depth against their intervals: as many, as long, each inside one free interval, none over another."""
    scaled = W.unit_deviation(W.demean(D.probe(spark, d), ["y"]), ["y"])
    runs = files.written(M.runs(scaled.withColumn("m", (F.col("v") > 1).cast("int")), ["y"]), "runs")
    placed = M.control_intervals(runs.select(F.col("y").cast("string").alias("channel"), "state", "t_start", "t_end"), independent=True)
    placed = files.written(placed.withColumn("y", F.col("channel").cast("double")), "controls")
    free = runs.where("state = 0").select("y", F.col("t_start").alias("a"), F.col("t_end").alias("b"))
    inside = placed.join(free, "y").where((F.col("t_start") >= F.col("a") - 1e-6) & (F.col("t_end") <= F.col("b") + 1e-6)).groupBy("y").agg(F.count(F.lit(1)).alias("inside"))
    before = F.max("t_end").over(Window.partitionBy("y").orderBy("t_start").rowsBetween(Window.unboundedPreceding, -1))
    sums = placed.withColumn("_over", (F.col("t_start") < before).cast("int")).groupBy("y").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("t_end") - F.col("t_start")), 3).alias("seconds"), F.round(F.max(F.col("t_end") - F.col("t_start")), 3).alias("longest"), F.coalesce(F.sum("_over"), F.lit(0)).alias("overlaps"))
    return sums.join(inside, "y", "left").select("y", "n", "seconds", "longest", "inside", "overlaps")


@query(f"{WITH_X}, q AS (SELECT unnest(range(0, hours * 3600 // 1300 + 7)) * 1300.0::DOUBLE AS t FROM span), z AS (SELECT pop, t, t / 3600.0 AS f, CAST(floor(t / 3600.0) AS BIGINT) AS i FROM q, p) SELECT z.pop, z.t, round(CASE WHEN f = z.i THEN a.v ELSE a.v + (b.v - a.v) * (f - z.i) END, 6) AS v FROM z LEFT JOIN x a ON a.pop = z.pop AND a.i = z.i LEFT JOIN x b ON b.pop = z.pop AND b.i = z.i + 1")
def resample_linear(spark, d):
    grid = spark.range(D.hours(spark, d) * 3600 // 1300 + 7).select((F.col("id") * 1300.0).alias("t"))
    each = D.pops(spark, d).select("pop").crossJoin(grid)  # the grid is asked for of each population
    return M.resample_linear(D.hourly(spark, d), each, 0.0, D.HOUR, by=["pop"]).select("pop", "t", r6("v", "v"))


@query(f"{WITH_Y}, q AS (SELECT unnest(range(0, 2 * hours + 60)) * 1800.0::DOUBLE AS t FROM span) SELECT a.y, q.t, y.v FROM (SELECT DISTINCT y FROM y) a CROSS JOIN q LEFT JOIN y ON y.y = a.y AND y.i = CAST(ceil(q.t / 3600.0 - 0.5) AS BIGINT)")
def resample_nearest(spark, d):
    grid = spark.range(2 * D.hours(spark, d) + 60).select((F.col("id") * 1800.0).alias("t"))
    signal = D.probe(spark, d)
    each = signal.select("y").distinct().crossJoin(grid)  # the grid is asked for of each depth
    return M.resample_nearest(signal, each, 0.0, D.HOUR, by=["y"]).select("y", "t", "v")


@query("WITH c AS (SELECT DISTINCT p_size * 10.0::DOUBLE AS y FROM part), q AS (SELECT unnest(range(0, 8)) AS ord, unnest([5.0, 12.0, 14.9, 15.0, 203.0, 490.0, 900.0, 11.0])::DOUBLE AS y_req), k AS (SELECT q.ord, q.y_req, c.y, row_number() OVER (PARTITION BY q.ord ORDER BY abs(c.y - q.y_req), c.y DESC) AS rn FROM q, c) SELECT y, min(ord) AS ord, arg_min(y_req, ord) AS y_req FROM k WHERE rn = 1 GROUP BY y")
def nearest_select(spark, d):
    channels = D.table(spark, d, "part").select((F.col("p_size") * 10.0).alias("y")).distinct()
    targets = spark.createDataFrame(list(enumerate([5.0, 12.0, 14.9, 15.0, 203.0, 490.0, 900.0, 11.0])), "ord long, y_req double")
    return L.nearest(channels, targets).select("y", "ord", "y_req")


@query("SELECT p_partkey, p_size * 1.0::DOUBLE AS y FROM part WHERE p_size BETWEEN 3 AND 7 OR p_size BETWEEN 20 AND 25")
def layer_select(spark, d):
    channels = D.table(spark, d, "part").select("p_partkey", (F.col("p_size") * 1.0).alias("y"))
    layers = spark.createDataFrame([("L2", 3.0, 7.0), ("L4", 20.0, 25.0), ("L9", 90.0, 99.0)], "layer string, y0 double, y1 double")
    return L.in_layers(channels, layers, ["L2", "L4"])


_NAMES = ("IT2", "CT5A_frz", "PT5B", "PV4", "SOM6", "VIP1", "NGF3", "TC", "HTC", "TCM_frz", "TI", "TIM", "IRE", "IREM")


@query(
    f"""WITH n AS (SELECT c_custkey, list_extract({list(_NAMES)}, CAST(c_custkey % {len(_NAMES)} + 1 AS BIGINT)) AS pop FROM customer), k AS (SELECT *, regexp_replace(pop, '_frz$', '') AS b FROM n)
SELECT c_custkey, pop, CASE WHEN regexp_matches(b, '^[ICP]T') THEN 'PYR' WHEN b IN ('TC', 'HTC', 'TCM') THEN 'TC' ELSE regexp_extract(b, '^(PV|SOM|VIP|NGF|TI|IRE)') END AS kind, CASE WHEN regexp_matches(b, '[0-9]') THEN 'L' || regexp_extract(b, '[0-9].*$') ELSE 'THAL' END AS layer FROM k"""
)
def pop_classes(spark, d):
    pop = F.element_at(F.lit(list(_NAMES)), (F.col("c_custkey") % len(_NAMES) + 1).cast("int"))
    rows = D.table(spark, d, "customer").select("c_custkey", pop.alias("pop"))
    return rows.select("c_custkey", "pop", L.cell_type(F.col("pop")).alias("kind"), L.layer_of(F.col("pop")).alias("layer"))


@query(f"{WITH_Y} SELECT row_number() OVER (ORDER BY y) - 1 AS channel, y AS channel_y FROM (SELECT DISTINCT y FROM y)")
def numbered_channels(spark, d):
    return L.numbered_channels(D.probe(spark, d))


@query(f"{WITH_Y} SELECT y, i, v FROM y WHERE y IN (200, 400)")
def exact_channels(spark, d):
    return L.exact(D.probe(spark, d), "y", [200.0, 400.0]).select("y", "i", "v")


@query(f"{WITH_P} SELECT pop FROM p ORDER BY pop_ord LIMIT 1")
def first_pop(spark, d):
    return L.first_pop(D.pops(spark, d)).select("pop")


@query(f"{WITH_X} SELECT pop, round(max(abs(v)), 6) AS abs_max, round(quantile_cont(abs(v), 0.95), 6) AS abs_p95 FROM x GROUP BY pop")
def plot_scale(spark, d):
    return L.plot_scale(D.hourly(spark, d), "v", ["pop"]).select("pop", r6("abs_max", "abs_max"), r6("abs_p95", "abs_p95"))


@query(f"{WITH_Y}, k AS (SELECT y - lag(y) OVER (ORDER BY y) AS dy FROM (SELECT DISTINCT y FROM y)) SELECT quantile_cont(dy, 0.5) AS dy FROM k")
def median_step(spark, d):
    return L.median_step(D.probe(spark, d))


@query(f"{WITH_X}, m AS (SELECT pop, avg(v) AS v FROM x GROUP BY pop) SELECT a.pop AS pop_i, b.pop AS pop_j, round(a.v - b.v, 6) AS v, abs(a.v - b.v) < 0.05 AS weak, a.pop = b.pop AS diagonal FROM m a, m b")
def matrix_masks(spark, d):
    mean = D.hourly(spark, d).groupBy("pop").agg(F.avg("v").alias("v"))
    pairs = C.unordered(D.pops(spark, d), True)
    pairs = pairs.select("pop_i", "pop_j").union(pairs.where("pop_i <> pop_j").select("pop_j", "pop_i"))
    both = pairs.join(mean.toDF("pop_i", "vi"), "pop_i").join(mean.toDF("pop_j", "vj"), "pop_j")
    return L.matrix_masks(both.select("pop_i", "pop_j", (F.col("vi") - F.col("vj")).alias("v")), "v", 0.05).withColumn("v", F.round("v", 6))


# --- event-triggered averages ------------------------------------------------------

_TRIG = f"{WITH_X}, r AS (SELECT pop, t, CAST(round_even(t / 3600.0, 0) AS BIGINT) AS c FROM s), e AS (SELECT pop, c, row_number() OVER (PARTITION BY pop ORDER BY t, c) - 1 AS spike FROM r WHERE c - 2 >= 0 AND c + 4 < (SELECT hours FROM span)), w AS (SELECT e.pop, spike, k, x.v FROM e, (SELECT unnest(range(-2, 5)) AS k), x WHERE x.pop = e.pop AND x.i = e.c + k)"


def _epochs(spark, d):
    return A.epochs_long(D.spikes(spark, d).select("pop", "t"), D.hourly(spark, d), ["pop"], 0.0, D.HOUR, D.hours(spark, d), (-2 * D.HOUR, 4 * D.HOUR))


@query(f"{_TRIG} SELECT pop, k, round(avg(v), 6) AS v, count(*) AS n FROM w GROUP BY pop, k")
def sta_avg(spark, d):
    return A.average(_epochs(spark, d), ["pop"], D.HOUR).select("pop", "k", r6("v", "v"), "n")


@query(f"{_TRIG} SELECT pop, k, round(avg(v), 6) AS v, count(*) AS n FROM w GROUP BY pop, k")
def sta_counts(spark, d):
    """The same averages from counts of events per sample, along chunks of a day and a half."""
    chunks = H.to_chunks(D.hourly(spark, d), ["pop"], 36)
    found = triggered.averages(D.spikes(spark, d).select("pop", "t"), chunks, ["pop"], 0.0, D.HOUR, D.hours(spark, d), (-2 * D.HOUR, 4 * D.HOUR), 36)
    return found.select("pop", "k", r6("v", "v"), "n")


@query(f"{_TRIG} SELECT pop, spike, k, v FROM w")
def sta_epochs(spark, d):
    return _epochs(spark, d).select("pop", "spike", "k", "v")


@query(f"{_TRIG} SELECT pop, k, round(avg(v), 6) AS v FROM w GROUP BY pop, k")
def sta_traces(spark, d):
    traces = T.to_traces(D.hourly(spark, d), ["pop"], 0.0, D.HOUR)
    rows = A.epochs_trace(D.spikes(spark, d).select("pop", "t"), traces, ["pop"], D.HOUR, (-2 * D.HOUR, 4 * D.HOUR))
    return rows.select("pop", F.posexplode("epoch").alias("k", "v")).groupBy("pop", (F.col("k") - 2).cast("long").alias("k")).agg(r6(F.avg("v"), "v"))


@query(
    f"""{_MASK}, {S}, q AS (SELECT (gid % 4 + 1) * 100.0::DOUBLE AS y, t FROM s WHERE t <= (SELECT hours - 1 FROM span) * 3600),
z AS (SELECT q.y, q.t, m.m AS state FROM q JOIN m ON m.y = q.y AND m.i = CAST(floor(q.t / 3600.0 + 0.5) AS BIGINT)),
c AS (SELECT y, state, CAST(round_even(t / 3600.0, 0) AS BIGINT) AS c FROM z), e AS (SELECT * FROM c WHERE c - 1 >= 0 AND c + 2 < (SELECT hours FROM span)),
dm AS (SELECT y, i, v - avg(v) OVER (PARTITION BY y) AS v FROM y)
SELECT e.y, e.state, k, round(avg(dm.v), 6) AS v, count(*) AS n FROM e, (SELECT unnest(range(-1, 3)) AS k), dm WHERE dm.y = e.y AND dm.i = e.c + k GROUP BY 1, 2, 3"""
)
def sta_mask_split(spark, d):
    rows = _mask(spark, d)
    triggers = D.spikes(spark, d).select(((F.col("gid") % 4 + 1) * 100.0).alias("y"), "t")
    split = A.split_by_mask(triggers, rows, ["y"], 0.0, D.HOUR, D.hours(spark, d))
    signal = W.demean(rows, ["y"]).select("y", "i", "v")
    parts = {s: A.epochs_long(split.where(F.col("state") == s).select("y", "t"), signal, ["y"], 0.0, D.HOUR, D.hours(spark, d), (-D.HOUR, 2 * D.HOUR)) for s in (0, 1)}
    return A.average(B.concat_labels(parts, "state"), ["y", "state"], D.HOUR).select("y", "state", "k", r6("v", "v"), "n")


# --- pairs ---------------------------------------------------------------------------

_PAIRS = f"{WITH_X}, pr AS (SELECT a.pop AS pop_i, b.pop AS pop_j FROM p a JOIN p b ON a.pop_ord <= b.pop_ord), dm AS (SELECT pop, i, v - avg(v) OVER (PARTITION BY pop) AS v FROM x)"


def _corr(source: str, scale: str) -> str:
    return (
        f"{_PAIRS}, ss AS (SELECT pop, sum(v * v) AS ss FROM {source} GROUP BY pop), c AS (SELECT pop_i, pop_j, lag, sum(a.v * b.v) AS s FROM pr, (SELECT unnest(range(-6, 7)) AS lag), {source} b, {source} a "
        f"WHERE b.pop = pop_j AND a.pop = pop_i AND a.i = b.i + lag GROUP BY 1, 2, 3), cc AS (SELECT pop_i, pop_j, lag, s / {scale} AS c FROM c JOIN ss si ON si.pop = pop_i JOIN ss sj ON sj.pop = pop_j)"
    )


_NORM = _corr("dm", "sqrt(si.ss * sj.ss)")


def _xcorr(spark, d, **how):
    return C.crosscorr(D.hourly(spark, d), C.unordered(D.pops(spark, d)), -6, 6, **how)


@query(f"{_corr('x', '(SELECT hours FROM span)')} SELECT pop_i, pop_j, lag, round(c, 6) AS c FROM cc")
def xcorr_raw(spark, d):
    return _xcorr(spark, d).select("pop_i", "pop_j", "lag", r6("c", "c"))


@query(f"{_corr('dm', '(SELECT hours FROM span)')} SELECT pop_i, pop_j, lag, round(c, 6) AS c FROM cc")
def xcorr_demean(spark, d):
    return _xcorr(spark, d, demean=True).select("pop_i", "pop_j", "lag", r6("c", "c"))


@query(f"{_NORM} SELECT pop_i, pop_j, lag, round(c, 6) AS c FROM cc")
def xcorr_norm(spark, d):
    return _xcorr(spark, d, demean=True, normalise=True).select("pop_i", "pop_j", "lag", r6("c", "c"))


@query(f"SELECT pop_i, pop_j, lag, a.c AS raw, b.c AS demeaned, n.c AS normalised FROM ({SQL['xcorr_raw']}) a JOIN ({SQL['xcorr_demean']}) b USING (pop_i, pop_j, lag) JOIN ({SQL['xcorr_norm']}) n USING (pop_i, pop_j, lag)")
def xcorr_forms(spark, d):
    """The three forms from one pass over chunks of two days."""
    out = G.correlograms(H.to_chunks(D.hourly(spark, d), ["pop"], 48), C.unordered(D.pops(spark, d)), 48, -6, 6)
    return out.select("pop_i", "pop_j", "lag", r6("raw", "raw"), r6("demeaned", "demeaned"), r6("normalised", "normalised"))


@query(f"{_NORM} SELECT pop_i, pop_j, lag, round(c, 6) AS c FROM cc")
def xcorr_traces(spark, d):
    t = T.to_traces(D.hourly(spark, d), ["pop"], 0.0, D.HOUR)
    pairs = C.unordered(D.pops(spark, d)).join(t.select(F.col("pop").alias("pop_i"), F.col("values").alias("a")), "pop_i").join(t.select(F.col("pop").alias("pop_j"), F.col("values").alias("b")), "pop_j")
    out = pairs.select("pop_i", "pop_j", F.explode(T.crosscorr("a", "b", 1 / D.HOUR, (-6 * D.HOUR, 6 * D.HOUR), True, True)).alias("c"))
    return out.select("pop_i", "pop_j", F.col("c.lag").alias("lag"), r6("c.c", "c"))


@query(f"{_NORM}, b AS (SELECT pop_i, pop_j, arg_max(lag, (abs(round(c, 9)), -lag)) AS lag, max(abs(c)) AS a FROM cc GROUP BY 1, 2), m AS (SELECT * FROM b UNION ALL SELECT pop_j, pop_i, lag, a FROM b WHERE pop_i <> pop_j) SELECT pop_i, pop_j, lag, round(a, 6) AS amp FROM m")
def xcorr_peak(spark, d):
    corr = _xcorr(spark, d, demean=True, normalise=True).withColumn("c", F.round("c", 9))
    return C.mirrored(C.peak(corr)).select("pop_i", "pop_j", "lag", r6(F.abs("amp"), "amp"))


@query(
    f"""{_NORM}, t AS (SELECT pop_i, pop_j, lag, c, lead(c) OVER (PARTITION BY pop_i, pop_j, lag > 0 ORDER BY lag) AS n FROM cc WHERE lag <> 0),
q AS (SELECT pop_i, pop_j, sum((c + n) / 2 * 3600.0) FILTER (lag < 0) AS lead, sum((c + n) / 2 * 3600.0) FILTER (lag > 0) AS lag FROM t GROUP BY 1, 2),
z AS (SELECT pop_i, pop_j, lead - lag AS diff, (lead - lag) / (abs(lead) + abs(lag) + 1e-12) AS bounded FROM q), m AS (SELECT * FROM z UNION ALL SELECT pop_j, pop_i, -diff, -bounded FROM z WHERE pop_i <> pop_j)
SELECT pop_i, pop_j, round(CASE WHEN pop_i = pop_j THEN 0 ELSE diff END, 4) AS diff, round(CASE WHEN pop_i = pop_j THEN 0 ELSE bounded END, 6) AS bounded FROM m"""
)
def lead_lag_index(spark, d):
    rows = C.mirrored(C.lead_lag(_xcorr(spark, d, demean=True, normalise=True), D.HOUR, -6, 6).select("pop_i", "pop_j", "diff", "bounded"), ("diff", "bounded"))
    own = F.col("pop_i") == F.col("pop_j")
    return rows.select("pop_i", "pop_j", F.round(F.when(own, 0.0).otherwise(F.col("diff")), 4).alias("diff"), r6(F.when(own, 0.0).otherwise(F.col("bounded")), "bounded"))


# --- spectra --------------------------------------------------------------------------

_SIZE, _STEP, _KHI = 96, 48, 24
_DFT = f"""{WITH_X}, sg AS (SELECT unnest(range((hours - 96) // 48 + 1)) AS seg FROM span), r AS (SELECT x.pop, seg, x.i - seg * 48 AS j, v FROM x, sg WHERE x.i >= seg * 48 AND x.i < seg * 48 + 96),
h AS (SELECT pop, seg, j, (v - avg(v) OVER (PARTITION BY pop, seg)) * (0.5 - 0.5 * cos(2 * pi() * j / 96)) / sqrt(0.375 * 96) AS x FROM r),
f AS (SELECT pop, seg, k, sum(x * cos(-2 * pi() * ((j * k) % 96) / 96)) AS re, sum(x * sin(-2 * pi() * ((j * k) % 96) / 96)) AS im FROM h, (SELECT unnest(range(0, 25)) AS k) GROUP BY 1, 2, 3),
o AS (SELECT *, CASE WHEN k = 0 OR 2 * k = 96 THEN 1.0 ELSE 2.0 END AS d FROM f)"""
_CROSS = f"{_DFT}, pr AS (SELECT a.pop AS pop_i, b.pop AS pop_j FROM p a JOIN p b ON a.pop_ord <= b.pop_ord), cs AS (SELECT pop_i, pop_j, a.k / 96.0 AS freq, avg(a.re * b.re + a.im * b.im) * any_value(a.d) AS re, avg(a.re * b.im - a.im * b.re) * any_value(a.d) AS im FROM pr JOIN o a ON a.pop = pop_i JOIN o b ON b.pop = pop_j AND b.seg = a.seg AND b.k = a.k GROUP BY 1, 2, a.k)"
_COH = f"{_CROSS}, au AS (SELECT pop_i AS pop, freq, sqrt(re * re + im * im) AS p FROM cs WHERE pop_i = pop_j), co AS (SELECT cs.pop_i, cs.pop_j, cs.freq, cs.re / sqrt(i.p * j.p) AS re, cs.im / sqrt(i.p * j.p) AS im FROM cs JOIN au i ON i.pop = cs.pop_i AND i.freq = cs.freq JOIN au j ON j.pop = cs.pop_j AND j.freq = cs.freq WHERE i.p * j.p > 1e-12), bm AS (SELECT pop_i, pop_j, avg(re) AS re, avg(im) AS im FROM co WHERE freq BETWEEN 4 / 96.0 AND 12 / 96.0 GROUP BY 1, 2)"


def _dft(spark, d):
    return C.segment_dft(D.hourly(spark, d), _SIZE, _STEP, D.hours(spark, d), 0, _KHI, 1.0)


def _cross(spark, d):
    return C.cross_spectrum(_dft(spark, d), C.unordered(D.pops(spark, d)), _SIZE, 1.0)


def _band(spark, d):
    return C.band_mean(C.coherence(_cross(spark, d).where("freq > 0")), 4 / 96, 12 / 96)


@query(f"{_DFT} SELECT pop, k / 96.0 AS freq, round(avg((re * re + im * im) * d), 6) AS psd FROM o GROUP BY pop, k")
def psd_welch_mean(spark, d):
    return C.welch(_dft(spark, d), _SIZE, 1.0).select("pop", "freq", r6("psd", "psd"))


_MEDIAN = f"{_DFT}, b AS (SELECT 1 + coalesce(sum(1.0 / (2 * n + 1) - 1.0 / (2 * n)), 0) AS b FROM (SELECT unnest(range(1, ((SELECT count(*) FROM sg) - 1) // 2 + 1)) AS n)) SELECT pop, k / 96.0 AS freq, round(median((re * re + im * im) * d) / any_value(b.b), 6) AS psd FROM o, b GROUP BY pop, k"


@query(_MEDIAN)
def psd_welch_median(spark, d):
    return C.welch(_dft(spark, d), _SIZE, 1.0, "median").select("pop", "freq", r6("psd", "psd"))


@query(_MEDIAN)
def psd_traces(spark, d):
    t = T.to_traces(D.hourly(spark, d), ["pop"], 0.0, 1.0)
    out = t.select("pop", F.explode(T.welch("values", 1.0, 96.0, 0.5, 0.0, 0.2500001)).alias("s"))
    return out.select("pop", F.col("s.freq").alias("freq"), r6("s.psd", "psd"))


@query(f"{_CROSS} SELECT pop_i, pop_j, freq, round(re, 6) AS re, round(im, 6) AS im FROM cs WHERE freq > 0")
def cpsd(spark, d):
    return _cross(spark, d).where("freq > 0").select("pop_i", "pop_j", "freq", r6("re", "re"), r6(F.when(F.col("pop_i") == F.col("pop_j"), 0.0).otherwise(F.col("im")), "im"))


SQL["cpsd"] = f"{_CROSS} SELECT pop_i, pop_j, freq, round(re, 6) AS re, round(CASE WHEN pop_i = pop_j THEN 0 ELSE im END, 6) AS im FROM cs WHERE freq > 0"


@query(SQL["cpsd"])
def cpsd_traces(spark, d):
    t = T.to_traces(D.hourly(spark, d), ["pop"], 0.0, 1.0)
    both = C.unordered(D.pops(spark, d)).join(t.select(F.col("pop").alias("pop_i"), F.col("values").alias("a")), "pop_i").join(t.select(F.col("pop").alias("pop_j"), F.col("values").alias("b")), "pop_j")
    out = both.select("pop_i", "pop_j", F.explode(T.cpsd("a", "b", 1.0, 96.0, 0.5, 0.2500001)).alias("w")).where("w.freq > 0")
    return out.select("pop_i", "pop_j", F.col("w.freq").alias("freq"), r6("w.re", "re"), r6(F.when(F.col("pop_i") == F.col("pop_j"), 0.0).otherwise(F.col("w.im")), "im"))


@query(f"{_COH} SELECT pop_i, pop_j, round(sqrt(re * re + im * im), 6) AS coh FROM bm")
def coherence_band(spark, d):
    return _band(spark, d).select("pop_i", "pop_j", r6("coh", "coh"))


@query(f"{_COH}, hh AS (SELECT pop_i, pop_j, CASE WHEN pop_i = pop_j THEN 0 ELSE atan2(im, re) END AS phase FROM bm) SELECT pop_i, pop_j, round(phase, 6) AS phase FROM hh UNION ALL SELECT pop_j, pop_i, round(-phase, 6) FROM hh WHERE pop_i <> pop_j")
def phase_matrix(spark, d):
    return C.mirrored(_band(spark, d), ("phase",)).select("pop_i", "pop_j", r6("phase", "phase"))


@query(f"{_COH}, hh AS (SELECT pop_j AS pop, sqrt(re * re + im * im) AS coh, atan2(im, re) AS phase FROM bm WHERE pop_i = 'click') SELECT pop, round(CASE WHEN pop = 'click' THEN 1 ELSE coh * cos(phase) END, 6) AS x, round(CASE WHEN pop = 'click' THEN 0 ELSE coh * sin(phase) END, 6) AS y FROM hh WHERE pop = 'click' OR coh >= 0.05")
def basis_vectors(spark, d):
    return C.basis_vectors(_band(spark, d), "click", 0.05).select("pop", r6("x", "x"), r6("y", "y"))


@query(f"{_CROSS} SELECT pop_i, pop_j, round(avg(sqrt(re * re + im * im)), 6) AS amp FROM cs WHERE freq BETWEEN 4 / 96.0 AND 12 / 96.0 GROUP BY 1, 2")
def cpsd_summary(spark, d):
    return C.summarise_cpsd(_cross(spark, d), 4 / 96, 12 / 96).select("pop_i", "pop_j", r6("amp", "amp"))


@query(f"{_DFT}, w AS (SELECT pop, k / 96.0 AS freq, round(avg((re * re + im * im) * d), 9) AS psd FROM o WHERE k > 0 GROUP BY pop, k) SELECT pop, arg_max(freq, (psd, -freq)) AS peak_freq, round(max(psd), 6) AS peak FROM w GROUP BY pop")
def peak_freq(spark, d):
    spectra = C.welch(_dft(spark, d), _SIZE, 1.0).where("freq > 0").withColumn("psd", F.round("psd", 9))
    return B.peak_frequency(spectra, ["pop"]).select("pop", "peak_freq", r6("peak", "peak"))


@query(f"{_DFT}, w AS (SELECT pop, k, avg((re * re + im * im) * d) AS psd FROM o WHERE k > 0 GROUP BY pop, k), n AS (SELECT pop, k, psd / avg(psd) FILTER (k BETWEEN 4 AND 12) OVER (PARTITION BY pop) AS psd FROM w), m AS (SELECT pop, k, avg(psd) OVER (PARTITION BY pop ORDER BY k ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS psd FROM n) SELECT pop, k / 96.0 AS freq, round(psd, 6) AS psd FROM m WHERE k BETWEEN 2 AND 20")
def psd_postprocess(spark, d):
    spectra = C.welch(_dft(spark, d), _SIZE, 1.0).where("freq > 0")
    smooth = W.rolling_mean(W.band_normalise(spectra, ["pop"], 4 / 96, 12 / 96), ["pop"], "freq", 3)
    return L.between(smooth, "freq", 2 / 96, 20 / 96).select("pop", "freq", r6("psd", "psd"))


def _filter_sql(band: tuple[float, float], fs: float, pad: int) -> str:
    """The filter sample by sample over x, extended by pad samples at both ends, there and back: a recursion each way over the states of three sections."""
    sos = K.butter_sos(3, band, "bandpass", fs)
    n = lambda v: f"({float(v)!r})::DOUBLE"
    state = ", ".join(f"p{k}, q{k}" for k in range(3))
    steady = ", ".join(f"v * {n(a)} AS p{k}, v * {n(b)} AS q{k}" for k, (a, b) in enumerate(K.steady_state(sos)))

    def step(source: str) -> str:
        for k, row in enumerate(sos):
            source = f"(SELECT *, {n(row[0])} * {f'o{k - 1}' if k else 'v'} + p{k} AS o{k} FROM {source})"
        after = ", ".join(f"{n(b1)} * {(i := f'o{k - 1}' if k else 'v')} - {n(a1)} * o{k} + q{k} AS p{k}, {n(b2)} * {i} - {n(a2)} * o{k} AS q{k}" for k, (_, b1, b2, _, a1, a2) in enumerate(sos))
        return f"SELECT pop, i, o2 AS y, {after} FROM {source}"

    def there(name: str, source: str) -> str:
        start, following = f"(SELECT pop, i, v, {steady} FROM {source} WHERE i = 0)", f"(SELECT s.pop, s.i, s.v, {state} FROM {name} JOIN {source} s ON s.pop = {name}.pop AND s.i = {name}.i + 1)"
        return f"{name} AS ({step(start)} UNION ALL {step(following)})"

    ends = f"""e AS (SELECT pop, i + {pad} AS i, v FROM x UNION ALL SELECT x.pop, {pad} - x.i, 2 * b.v - x.v FROM x JOIN x b ON b.pop = x.pop AND b.i = 0 WHERE x.i BETWEEN 1 AND {pad}
UNION ALL SELECT x.pop, 2 * b.i - x.i + {pad}, 2 * b.v - x.v FROM x JOIN x b ON b.pop = x.pop AND b.i = (SELECT hours - 1 FROM span) WHERE x.i BETWEEN b.i - {pad} AND b.i - 1)"""
    turned = f"(SELECT hours + {2 * pad - 1} FROM span) - i"
    return f"{WITH_X.replace('WITH', 'WITH RECURSIVE', 1)}, {ends}, {there('a', 'e')}, r AS (SELECT pop, {turned} AS i, y AS v FROM a), {there('b', 'r')}, u AS (SELECT pop, {turned} - {pad} AS i, y FROM b) SELECT pop, i, round(y, 6) + 0.0 AS v FROM u WHERE i >= 0 AND i < (SELECT hours FROM span)"


@query(_filter_sql((0.05, 0.2), 1.0, 21))
def bandpass_filter(spark, d):
    t = T.to_traces(D.hourly(spark, d), ["pop"], 0.0, D.HOUR)
    return T.to_long(t.withColumn("values", T.filtered("values", (0.05, 0.2), 1.0)), ["pop"]).select("pop", "i", r6("v", "v"))


@query(_filter_sql((0.05, 0.2), 1.0, 21))
def bandpass_chunks(spark, d):
    """The same filter along chunks of 64 hours, states scanned 8 summaries at a time."""
    chunks = H.to_chunks(D.hourly(spark, d), ["pop"], 64)
    return H.to_long(H.filtered(chunks, ["pop"], (0.05, 0.2), 1.0, width=8), ["pop"], 64).select("pop", "i", r6("v", "v"))


def _dft_sql(source: str, by: str, size: int, step: int, top: int, window: str, tag: str, fs: str = "1") -> str:
    """Segment spectra ``f<tag>`` (by, seg, k, re, im) of a table (by, i, v) up to frequency top / size; window is an expression of ``j``."""
    return f"""sg{tag} AS (SELECT unnest(range((hours - {size}) // {step} + 1)) AS seg FROM span), w{tag} AS (SELECT j, {window} AS w FROM (SELECT unnest(range({size})) AS j)),
r{tag} AS (SELECT {by}, seg, i - seg * {step} AS j, v FROM {source}, sg{tag} WHERE i >= seg * {step} AND i < seg * {step} + {size}),
h{tag} AS (SELECT {by}, seg, j, (v - avg(v) OVER (PARTITION BY {by}, seg)) * w / sqrt({fs}::DOUBLE * (SELECT sum(w * w) FROM w{tag})) AS x FROM r{tag} JOIN w{tag} USING (j)),
f{tag} AS (SELECT {by}, seg, k, sum(x * cos(-2 * pi() * ((j * k) % {size}) / {size})) AS re, sum(x * sin(-2 * pi() * ((j * k) % {size}) / {size})) AS im FROM h{tag}, (SELECT unnest(range({top + 1})) AS k) GROUP BY 1, 2, 3)"""


_HANN97, _HANN96 = "0.5 - 0.5 * cos(2 * pi() * j / 97)", "0.5 - 0.5 * cos(2 * pi() * j / 96)"
_TUKEY96 = "CASE WHEN j < 12 THEN 0.5 * (1 + cos(pi() * (j / 12.0 - 1))) WHEN j >= 84 THEN 0.5 * (1 + cos(pi() * (j / 12.0 - 7))) ELSE 1.0 END"


@query(f"{WITH_X}, {_dft_sql('x', 'pop', 96, 48, 24, _TUKEY96, 't')} SELECT pop, seg * 48 + 48 AS i, k / 96.0 AS freq, round(re, 6) + 0.0 AS re, round(im, 6) + 0.0 AS im FROM ft")
def tf_stft(spark, d):
    t = T.to_traces(D.hourly(spark, d), ["pop"], 0.0, D.HOUR)
    return t.select("pop", F.explode(T.stft("values", 1.0, 96.0, 0.5, 0.25)).alias("z")).select("pop", "z.i", "z.freq", r6("z.re", "re"), r6("z.im", "im"))


@query()
def burst_detect(spark, d):
    chunks = H.to_chunks(D.hourly(spark, d).withColumnRenamed("pop", "channel"), ["channel"], 240)
    return U.detect(chunks, 100.0, [float(f) for f in range(4, 31)], 240, 3.0, dynamic=2.0, bands={"alpha": (8.0, 15.0)})


# --- events, sweeps --------------------------------------------------------------------

_EV = """WITH r AS (SELECT event_id, CASE user_id % 4 WHEN 0 THEN 'theta' WHEN 1 THEN 'alpha' WHEN 2 THEN 'beta' ELSE 'gamma' END AS band, user_id % 4 AS chan, value / 40 AS ncycle, value / 100 AS "Foct",
(epoch_us(ts) - 1704067200000000) / 1e3 AS "absPeakT", value AS dur FROM events)"""


def _raw_events(spark, d):
    us = F.timestamp_diff("MICROSECOND", F.expr("timestamp_ntz'2024-01-01 00:00:00'"), F.col("ts"))
    band = F.element_at(F.lit(["theta", "alpha", "beta", "gamma"]), (F.col("user_id") % 4 + 1).cast("int"))
    peak = us / F.lit(1e3)
    return D.table(spark, d, "events").select("event_id", band.alias("band"), (F.col("user_id") % 4).alias("chan"), (F.col("value") / 40).alias("ncycle"), (F.col("value") / 100).alias("Foct"), peak.alias("absPeakT"), (peak - F.col("value")).alias("absminT"), (peak + F.col("value")).alias("absmaxT"), F.col("value").alias("dur"), F.array("value").alias("filtsig"))


@query(f"""{_EV} SELECT event_id, band, chan, round("absPeakT" / 1000 + 5, 6) AS peak_time_s, round(dur / 1000, 6) AS duration_s, ncycle >= 2 AND "Foct" <= 1.5 AS event_passed FROM r WHERE band IN ('theta', 'alpha')""")
def event_table_normalise(spark, d):
    out = E.normalise(_raw_events(spark, d), ["theta", "alpha"], 5.0, ncycle_min=2.0, foct_max=1.5)
    return out.select("event_id", "band", "chan", r6("peak_time_s", "peak_time_s"), r6("duration_s", "duration_s"), "event_passed")


@query(f"""{_EV} SELECT event_id, band, chan, round_even(ncycle, 6) AS ncycle, round_even("Foct", 6) AS "Foct", dur FROM r""")
def event_csv(spark, d):
    raw = _raw_events(spark, d).withColumn("peakMUA", F.lit(1.0))
    return E.csv_table(raw.drop("absPeakT", "absminT", "absmaxT"), 6).select("event_id", "band", "chan", "ncycle", "Foct", "dur")


@query(
    f"""{_EV}, k AS (SELECT band, chan, "absPeakT" / 1000 AS t FROM r), d AS (SELECT *, t - lag(t) OVER (PARTITION BY band, chan ORDER BY t) AS d FROM k), e AS (SELECT *, lag(d) OVER (PARTITION BY band, chan ORDER BY t) AS e FROM d)
SELECT band, chan, count(*) AS n, round(avg(d), 6) AS mean_interval, round(avg(2 * abs(d - e) / nullif(d + e, 0)), 6) AS cv2, round(avg(3 * ((d - e) / nullif(d + e, 0)) * ((d - e) / nullif(d + e, 0))), 6) AS lv FROM e GROUP BY band, chan"""
)
def event_intervals(spark, d):
    rows = _raw_events(spark, d).select("band", "chan", (F.col("absPeakT") / 1000).alias("peak_time_s"))
    return E.interval_stats(rows, ["band", "chan"]).select("band", "chan", "n", r6("mean_interval", "mean_interval"), r6("cv2", "cv2"), r6("lv", "lv"))


@query(f"{WITH_X} SELECT pop, round(var_pop(v) / avg(v), 6) AS fano FROM x GROUP BY pop")
def event_fano(spark, d):
    rows = D.spikes(spark, d).withColumnRenamed("t", "peak_time_s")
    return E.fano(rows, rows, ["pop"], D.HOUR, D.hours(spark, d)).select("pop", r6("fano", "fano"))


_JOBS = "j AS (SELECT row_number() OVER (ORDER BY p_size, p_brand) * 7 AS job_id, p_size, p_brand FROM (SELECT DISTINCT p_size, p_brand FROM part))"


def _jobs(spark, d):
    rows = D.table(spark, d, "part").select("p_size", "p_brand").distinct()
    return rows.withColumn("job_id", (F.row_number().over(Window.orderBy("p_size", "p_brand")) * 7).cast("long"))


@query(f"WITH {_JOBS}, a AS (SELECT p_size, dense_rank() OVER (ORDER BY p_size) - 1 AS p_size_idx FROM (SELECT DISTINCT p_size FROM j)), b AS (SELECT p_brand, dense_rank() OVER (ORDER BY p_brand) - 1 AS p_brand_idx FROM (SELECT DISTINCT p_brand FROM j)) SELECT a.p_size, b.p_brand, p_size_idx, p_brand_idx, job_id FROM a CROSS JOIN b LEFT JOIN j ON j.p_size = a.p_size AND j.p_brand = b.p_brand")
def job_grid(spark, d):
    return B.job_grid(_jobs(spark, d), ["p_size", "p_brand"]).select("p_size", "p_brand", "p_size_idx", "p_brand_idx", "job_id")


@query(f"WITH {_JOBS}, a AS (SELECT DISTINCT p_size FROM j), b AS (SELECT DISTINCT p_brand FROM j), r AS (SELECT j.job_id, avg(p_retailprice) AS v FROM j JOIN part USING (p_size, p_brand) GROUP BY 1) SELECT a.p_size, b.p_brand, round(r.v, 6) AS v FROM a CROSS JOIN b LEFT JOIN j ON j.p_size = a.p_size AND j.p_brand = b.p_brand LEFT JOIN r ON r.job_id = j.job_id")
def job_stack(spark, d):
    jobs = _jobs(spark, d)
    results = jobs.join(D.table(spark, d, "part"), ["p_size", "p_brand"]).groupBy("job_id").agg(F.avg("p_retailprice").alias("v"))
    return B.stack(B.job_grid(jobs, ["p_size", "p_brand"]), results).select("p_size", "p_brand", r6("v", "v"))


@query("SELECT event_id, 'k' AS name, CAST(json_extract(props, '$.k') AS DOUBLE) AS value FROM events UNION ALL SELECT event_id, 'missing', NULL FROM events")
def json_to_long(spark, d):
    return B.json_to_long(D.table(spark, d, "events"), "props", ["name"], ["event_id"], {"name": ["k", "missing"]})


@query("SELECT label, status, n FROM (SELECT 'orders' AS label, o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'lineitem', l_linestatus, count(*) FROM lineitem GROUP BY 2)")
def set_concat(spark, d):
    a = D.table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("n"))
    b = D.table(spark, d, "lineitem").groupBy(F.col("l_linestatus").alias("status")).agg(F.count(F.lit(1)).alias("n"))
    return B.concat_labels({"orders": a, "lineitem": b}).select("label", "status", "n")


@query(f"{WITH_X} SELECT pop, round(avg(v), 6) AS mean, count(*) AS n FROM x GROUP BY pop")
def batch_means(spark, d):
    return B.batch_means(D.hourly(spark, d), ["pop"], "v").select("pop", r6("mean", "mean"), "n")


@query("SELECT p_brand AS pop, round(avg(p_retailprice), 6) AS mean FROM part GROUP BY 1 ORDER BY avg(p_retailprice) DESC, pop LIMIT 6")
def top_pops(spark, d):
    means = D.table(spark, d, "part").groupBy(F.col("p_brand").alias("pop")).agg(F.avg("p_retailprice").alias("mean"))
    return B.top(means, "mean", 6, "pop").select("pop", r6("mean", "mean"))


@query(f"{WITH_X}, d AS (SELECT abs(v - avg(v) OVER (PARTITION BY pop ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)) AS d FROM x) SELECT round(max(d), 6) AS max, round(avg(d), 6) AS mean, round(quantile_cont(d, 0.95), 6) AS p95, round(quantile_cont(d, 0.99), 6) AS p99, count(*) AS n FROM d")
def diff_stats(spark, d):
    a = D.hourly(spark, d)
    out = B.difference_stats(a, W.rolling_mean(a, ["pop"], "i", 5, "v"), ["pop", "i"], "v")
    return out.select(r6("max", "max"), r6("mean", "mean"), r6("p95", "p95"), r6("p99", "p99"), "n")


@query(f"{WITH_P}, q AS (SELECT 'view' AS pop, 0 AS ord UNION ALL SELECT 'click', 1) SELECT pop, ord FROM q WHERE pop IN (SELECT pop FROM p)")
def pop_select(spark, d):
    return L.populations(D.pops(spark, d), ["view", "click"])


@query(f"{WITH_Y} SELECT y, i, v FROM y WHERE t BETWEEN 86400 AND 172800")
def time_slice(spark, d):
    return L.between(D.probe(spark, d), "t", 86400.0, 172800.0).select("y", "i", "v")


# --- whole analyses -----------------------------------------------------------------------


@query(
    f"""{_DFT}, z AS (SELECT a.pop AS pop_i, b.pop AS pop_j, a.seg, avg(a.re * b.re + a.im * b.im) AS re, avg(a.re * b.im - a.im * b.re) AS im FROM f a JOIN f b ON a.seg = b.seg AND a.k = b.k AND a.pop < b.pop WHERE a.k BETWEEN 2 AND 8 GROUP BY 1, 2, 3)
SELECT pop_i, pop_j, round(sqrt(avg(re / sqrt(re * re + im * im)) * avg(re / sqrt(re * re + im * im)) + avg(im / sqrt(re * re + im * im)) * avg(im / sqrt(re * re + im * im))), 6) AS resultant, count(*) AS n FROM z GROUP BY 1, 2"""
)
def sliding_phase(spark, d):
    pairs = C.unordered(D.pops(spark, d), False)
    z = P_.sliding_phase(D.hourly(spark, d), pairs, _SIZE, _STEP, D.hours(spark, d), 2, 8, 1.0)
    return z.groupBy("pop_i", "pop_j").agg(r6(F.max("resultant"), "resultant"), F.count(F.lit(1)).alias("n"))


# Sampling rates are rounded to five digits, so that 96 hours are 97 samples at 0.00028.
@query(
    f"""{_REACH}, sm AS (SELECT j.pop, j.i, sum(j.w * x.v) / 3600.0 AS v FROM j JOIN x ON x.pop = j.pop AND x.i = j.q GROUP BY j.pop, j.i), {_dft_sql('sm', 'pop', 97, 49, 48, _HANN97, 's', '0.00028')},
b AS (SELECT 1 + coalesce(sum(1.0 / (2 * n + 1) - 1.0 / (2 * n)), 0) AS b FROM (SELECT unnest(range(1, ((SELECT count(*) FROM sgs) - 1) // 2 + 1)) AS n))
SELECT pop, round(k * 0.00028::DOUBLE / 97, 12) AS freq, round(median((re * re + im * im) * CASE WHEN k = 0 THEN 1.0 ELSE 2.0 END) / any_value(b.b), 12) AS psd FROM fs, b GROUP BY pop, k"""
)
def rate_spectra(spark, d):
    out = P_.rate_spectra(D.spikes(spark, d), D.pops(spark, d), ["pop"], 0.0, D.t_end(spark, d), D.HOUR, tau=2 * D.HOUR, win_len=96 * D.HOUR, overlap=0.5, fmin=0.0, fmax=1.0)
    return out.select("pop", F.round("freq", 12).alias("freq"), F.round("psd", 12).alias("psd"))


@query(
    f"""{_DFT}, {D.Y}, z AS (SELECT i, v, 'ref' AS name FROM y WHERE y = 100), {_dft_sql('z', 'name', 96, 48, 24, _HANN96, 'z')},
cz AS (SELECT o.pop, o.k, avg(o.re * q.re + o.im * q.im) * any_value(o.d) AS re, avg(o.re * q.im - o.im * q.re) * any_value(o.d) AS im FROM o JOIN fz q ON q.seg = o.seg AND q.k = o.k WHERE o.k BETWEEN 2 AND 19 GROUP BY 1, 2)
SELECT pop, round_even(avg(sqrt(re * re + im * im)), 6) AS amp, round_even(atan2(avg(im), avg(re)), 6) AS phase FROM cz GROUP BY pop"""
)
def reference_cpsd(spark, d):
    ref = D.probe(spark, d).where("y = 100").select("i", "v")
    return P_.against_reference(D.hourly(spark, d), ref, D.hours(spark, d), 1.0, 0.0, 0.0, 1.0, 96.0, 0.5, (0.02, 0.2))


@query(f"{WITH_Y}, k AS (SELECT y, i, v - avg(v) OVER (PARTITION BY y) AS v FROM y WHERE t BETWEEN 86400 AND 864000) SELECT y, i, round(v, 6) AS v FROM k")
def probe_prepared(spark, d):
    return P_.prepare(D.probe(spark, d), 86400.0, 864000.0, repair=False).select("y", "i", r6("v", "v"))


_REPAIRED = SQL["outlier_repair"].replace("SELECT y, i, round(CASE WHEN repaired THEN (l + r) / 2 ELSE v END, 6) AS v, repaired FROM k", "")


@query(f"{_REPAIRED}, c AS (SELECT y, i, CASE WHEN repaired THEN (l + r) / 2 ELSE v END AS v, repaired FROM k) SELECT y, i, round(v - avg(v) OVER (PARTITION BY y), 6) AS v, repaired FROM c")
def probe_repaired(spark, d):
    """Slice, repair and demean, with spikes put into the signal."""
    spoiled = D.probe(spark, d).withColumn("v", F.col("v") + F.when(F.col("i").isin(100, 300, 301, 500), 1e6).otherwise(0.0))
    return P_.prepare(spoiled, None, None).select("y", "i", r6("v", "v"), "repaired")


@query(
    f"""{WITH_Y}, k AS (SELECT y, count(*) AS n, sum(v) AS total FROM y WHERE t BETWEEN 86400 AND 864000 GROUP BY y), r AS (SELECT unnest(['prepared', 'spectrogram', 'mask']) AS stage)
SELECT stage, y, CASE WHEN stage = 'mask' AND y = 200 THEN 3 WHEN y > 200 THEN 2 ELSE 1 END AS built_in, CASE stage WHEN 'spectrogram' THEN n * 3 ELSE n END AS n FROM k, r"""
)
def probe_resume(spark, d):
    """A probe in three runs: two depths, all depths, and after one depth's mask is gone. ``built_in`` is the run that wrote a part."""
    path = files.scratch(spark, "probe")
    settings = J.Settings(1 / D.HOUR, [1e-5, 2e-5, 4e-5], ["theta"], 86400.0, 864000.0, winsz=64 * D.HOUR, repair=False)
    signal, written = D.probe(spark, d), {}
    for number in (1, 2, 3):
        if number == 3:
            files.delete(spark, f"{path}/mask/channel=y_200")
        tables = J.run(spark, path, signal, settings, ["y_100", "y_200"] if number == 1 else None)
        for stage, channels in J.status(spark, path).items():
            for c in channels:
                stamp = tuple(files.stamp(spark, files.glob(spark, f"{path}/{stage}/channel={c}/*.parquet")))
                if written.get((stage, c), (0, None))[1] != stamp:
                    written[stage, c] = (number, stamp)
    sizes = {"prepared": F.count(F.lit(1)), "spectrogram": F.sum(F.size("power")), "mask": F.count(F.lit(1))}
    parts = [tables[s].groupBy("channel").agg(n.alias("n")).select(F.lit(s).alias("stage"), "channel", "n") for s, n in sizes.items()]
    runs = spark.createDataFrame([(s, c, k) for (s, c), (k, _) in written.items()], "stage string, channel string, built_in int")
    counts = reduce(lambda a, b: a.unionByName(b), parts)
    return counts.join(runs, ["stage", "channel"]).select("stage", F.expr("double(substring(channel, 3))").alias("y"), "built_in", "n")


@query()
def probe_events(spark, d):
    return P_.probe_events(D.probe(spark, d).withColumn("t", F.col("i") / 100.0), 100.0, [float(f) for f in range(4, 31)], ["theta", "alpha", "beta"], winsz=2.4, threshold=3.0)


_POWER = f"""{WITH_X}, w AS (SELECT pop, i // 240 AS win, i % 240 AS i, v - avg(v) OVER (PARTITION BY pop, i // 240) AS v FROM x),
f AS (SELECT f, 7 / (2 * pi() * f) AS s FROM (SELECT unnest(range(4, 31, 2))::DOUBLE AS f)),
m AS (SELECT f, k, exp(-k * k / 1e4::DOUBLE / (2 * s * s)) / sqrt(s * sqrt(pi()) * 100) AS a, 2 * pi() * f * k / 100 AS ph FROM f, (SELECT unnest(range(-239, 240)) AS k) WHERE abs(k) <= ceil(4 * s * 100)),
c AS (SELECT a.pop, a.win, m.f, a.i, sum(b.v * m.a * cos(m.ph)) AS re, sum(b.v * m.a * sin(m.ph)) AS im FROM w a JOIN w b ON b.pop = a.pop AND b.win = a.win JOIN m ON m.k = a.i - b.i GROUP BY 1, 2, 3, 4),
q AS (SELECT pop, win, f, i, (re * re + im * im) / greatest(median(re * re + im * im) OVER (PARTITION BY pop, win, f), 1e-300) AS p FROM c)"""


@query(
    f"""{_POWER}, k AS (SELECT pop, win, f, i, p, max(p) OVER (PARTITION BY pop, win, f ORDER BY i ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS row_max FROM q),
n AS (SELECT *, max(row_max) OVER (PARTITION BY pop, win, i ORDER BY f ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS near FROM k)
SELECT pop AS channel, CASE WHEN f < 9 THEN 'theta' WHEN f < 15 THEN 'alpha' WHEN f < 29 THEN 'beta' ELSE 'gamma' END AS band, count(*) AS n, round(max(p), 6) AS strongest FROM n WHERE p >= 3 AND p = near GROUP BY 1, 2"""
)
def burst_peaks(spark, d):
    """Local maxima of the spectrogram in each band."""
    chunks = H.to_chunks(D.hourly(spark, d).withColumnRenamed("pop", "channel"), ["channel"], 240)
    found = U.peaks(chunks, 100.0, [float(f) for f in range(4, 31, 2)], 3.0)
    f = F.col("freq")
    band = F.when(f < 9, "theta").when(f < 15, "alpha").when(f < 29, "beta").otherwise("gamma")
    return found.groupBy("channel", band.alias("band")).agg(F.count(F.lit(1)).alias("n"), F.max("power").alias("p")).select("channel", "band", "n", r6("p", "strongest"))


@query(
    f"""{WITH_X}, w AS (SELECT pop, i // 240 AS win, i % 240 AS i, v - avg(v) OVER (PARTITION BY pop, i // 240) AS v FROM x),
f AS (SELECT f, 7 / (2 * pi() * f) AS s FROM (SELECT unnest(range(4, 31, 2))::DOUBLE AS f)),
m AS (SELECT f, k, exp(-k * k / 1e4::DOUBLE / (2 * s * s)) / sqrt(s * sqrt(pi()) * 100) AS a, 2 * pi() * f * k / 100 AS ph FROM f, (SELECT unnest(range(-239, 240)) AS k) WHERE abs(k) <= ceil(4 * s * 100)),
c AS (SELECT a.pop, a.win, m.f, a.i, sum(b.v * m.a * cos(m.ph)) AS re, sum(b.v * m.a * sin(m.ph)) AS im FROM w a JOIN w b ON b.pop = a.pop AND b.win = a.win JOIN m ON m.k = a.i - b.i GROUP BY 1, 2, 3, 4),
n AS (SELECT pop, win, f, count(*) AS n, max(re * re + im * im) / greatest(median(re * re + im * im), 1e-300) AS p FROM c GROUP BY 1, 2, 3)
SELECT pop AS channel, f AS freq, CAST(sum(n) AS BIGINT) AS n, round(max(p), 6) AS peak FROM n GROUP BY 1, 2"""
)
def spectrogram_stack(spark, d):
    chunks = H.to_chunks(D.hourly(spark, d).withColumnRenamed("pop", "channel"), ["channel"], 240)
    out = P_.stitched(P_.chunk_spectrograms(chunks, 100.0, [float(f) for f in range(4, 31, 2)], 240))
    return out.select("channel", "freq", F.size("power").cast("long").alias("n"), r6(F.array_max("power"), "peak"))
