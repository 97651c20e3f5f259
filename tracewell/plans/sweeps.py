"""Parameter sweeps in one call each: every job's results on the grid of parameters, all jobs in one plan.

A grid has the parameters and ``job_id`` (null where a combination has no job). Jobs without a result raise, or with
``skip_missing`` leave their cells empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import batch as B
from ..operators import parse as N
from ..operators import spikes as R
from ..sources import cache, files, jobs, sinks


def on_grid(grid: DataFrame, results: DataFrame, skip_missing: bool = False, axes: tuple[str, ...] = ()) -> DataFrame:
    """Long results on the grid. The named axes must be the same in all jobs."""
    rows = results.join(B.iter_jobs(grid).select("job_id"), "job_id", "left_semi")
    if not skip_missing:
        B.require_jobs(grid, rows)
    if axes:
        B.compatible(rows, list(axes))
    return B.stack(grid, rows)


def collect_tables(spark: SparkSession, grid: DataFrame, folder: str, template: str = "{job:05d}_*.parquet", variable: str | None = None, skip_missing: bool = False) -> DataFrame:
    """Per-job tables on the grid."""
    return on_grid(grid, jobs.read_job_table(spark, folder, template, variable), skip_missing)


def collect_sets(spark: SparkSession, grid: DataFrame, folder: str, template: str = "{job:05d}_{label}.parquet", labels: list[str] | None = None, combine: str = "concat", skip_missing: bool = False) -> DataFrame:
    """Per-job sets of labelled tables on the grid, with ``label``; ``select`` needs exactly one label and drops the column."""
    rows = jobs.read_job_set(spark, folder, template, labels)
    if combine == "select":
        if labels is None or len(labels) != 1:
            raise ValueError("name the one label to select")
        rows = rows.drop("label")
    elif combine != "concat":
        raise ValueError("combine is concat or select")
    return on_grid(grid, rows, skip_missing)


def collect_json(spark: SparkSession, grid: DataFrame, folder: str, variables: dict[str, str], dims: list[str], values: dict[str, list[str]] | None = None, last: list | None = None, template: str = "result_{job:05d}_*.json", skip_missing: bool = False, dim: str = "pos", extra: dict[str, tuple[str, list]] | None = None) -> DataFrame:
    """Nested objects of per-job JSON documents on the grid: ``variable``, a column per dimension, ``value``.

    ``variables`` maps a variable's name to its dotted path. With ``values`` a dimension has exactly those keys. With ``last``
    the leaves are lists along one more dimension (named by ``dim``) of these coordinates; a list of another length raises.
    ``extra`` adds coordinates: a name, the declared dimension that it goes along, and a value for each of that one's labels.
    """
    raw = jobs.read_job_raw(spark, folder, template)
    rows = B.concat_labels({name: raw.select("job_id", F.get_json_object("json", f"$.{path}").alias("_json")) for name, path in variables.items()}, "variable")
    if last is None:
        long = B.json_to_long(rows, "_json", dims, ["job_id", "variable"], values)
    else:
        long = B.json_lists_to_long(rows, "_json", dims, ["job_id", "variable"], last, dim, values)
    for name, (along, coords) in (extra or {}).items():
        labels = last if along == dim and last is not None else (values or {}).get(along)
        if labels is None or len(labels) != len(coords):
            raise ValueError(f"{name} needs a value for each declared label of {along}")
        long = long.withColumn(name, F.element_at(F.lit(coords), F.array_position(F.lit(labels), F.col(along)).cast("int")))
    return on_grid(grid, long, skip_missing)


def results_to_rates(results: DataFrame, t1: float, t2: float, dt: float) -> DataFrame:
    """``job_id, pop, bin, t, rate`` of nested results: spikes a second and cell, populations without cells NaN.

    Documents are read once: populations and trains are written as columns, from which cells, spikes and sizes are taken.
    """
    results = files.written(N.trains_only(results), "trains")
    cells = N.cells(results)
    spikes = N.spikes(results).join(cells.select("job_id", "pop", "gid"), ["job_id", "gid"])
    return R.rate_dynamics(spikes, N.pops(results).select("job_id", "pop", "n_cells"), ["job_id", "pop"], t1, t2, dt, cells="n_cells")


def collect_rates(grid: DataFrame, results: DataFrame, t_limits: tuple[float, float], dt: float, skip_missing: bool = False) -> DataFrame:
    """Binned rates of every job's nested result on the grid."""
    return on_grid(grid, results_to_rates(results, t_limits[0], t_limits[1], dt), skip_missing)


def collect_lfp(grid: DataFrame, results: DataFrame, skip_missing: bool = False, same_axes: bool = True) -> DataFrame:
    """Potentials of every job's nested result on the grid; channels and samples must be the same in all jobs."""
    return on_grid(grid, N.lfp(results), skip_missing, ("y", "i") if same_axes else ())


def collect_spike_rates(spark: SparkSession, grid: DataFrame, archive: str, dt: float, t_limits: tuple[float, float] | None = None, skip_missing: bool = False) -> DataFrame:
    """Binned rates from an archive of trains; without limits its own window, from 0 where its times are shifted."""
    spikes, pops, meta = sinks.load_spikes(spark, archive)
    if t_limits is None:
        if meta["tmax"] is None:
            raise ValueError("the archive has no window; set common t_limits")
        t_limits = (0.0, meta["tmax"] - meta["t0"]) if meta["subtract_t0"] else (meta["t0"], meta["tmax"])
    t = F.col("t") / 1000.0 if meta["ms"] else F.col("t")
    rates = R.rate_dynamics(spikes.withColumn("t", t), pops, ["job_id", "pop"], t_limits[0], t_limits[1], dt, cells="n_cells")
    return on_grid(grid, rates, skip_missing)


def materialise_spikes(spark: SparkSession, grid: DataFrame, path: str, load: Callable[[list[int]], DataFrame], meta: dict) -> DataFrame:
    """Trains of the grid's jobs as a table by job: jobs that are there are not read again, other settings raise."""
    wanted = [r.job_id for r in B.iter_jobs(grid).select("job_id").distinct().collect()]  # the jobs that are asked for, as many as the grid has cells
    return cache.append_missing(spark, path, wanted, load, meta)
