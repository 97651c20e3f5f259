"""Parameter sweeps: the job grid, per-job results stacked on it, nested JSON to long rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .quantiles import exact_quantiles


def job_grid(jobs: DataFrame, params: list[str], job: str = "job_id") -> DataFrame:
    """Every combination of the parameters' values with its job (null if none) and each parameter's index ``<param>_idx``.

    The axes are the distinct values of each parameter; their product is the grid that is asked for. A combination that
    two jobs share raises.
    """
    if jobs.groupBy(*params).count().where("count > 1").limit(1).count():
        raise ValueError("two jobs have the same parameters")
    axes = []
    for p in params:
        axis = jobs.select(p).distinct()
        axes.append(axis.withColumn(f"{p}_idx", (F.row_number().over(Window.orderBy(p)) - 1).cast("long")))
    grid = reduce(lambda a, b: a.crossJoin(F.broadcast(b)), axes)
    return grid.join(jobs.select(*params, job), params, "left")


def iter_jobs(grid: DataFrame, job: str = "job_id") -> DataFrame:
    return grid.where(F.col(job).isNotNull())


def stack(grid: DataFrame, results: DataFrame, job: str = "job_id") -> DataFrame:
    """Results on the grid; cells without a job or result have nulls."""
    return grid.join(results, job, "left")


def require_jobs(grid: DataFrame, results: DataFrame, job: str = "job_id") -> DataFrame:
    """The results, if every job of the grid has some; else raises."""
    missing = iter_jobs(grid, job).join(results.select(job).distinct(), job, "left_anti").limit(5).collect()
    if missing:
        raise FileNotFoundError(f"no result of jobs {[r[job] for r in missing]}")
    return results


def compatible(results: DataFrame, axes: list[str], job: str = "job_id") -> None:
    """All jobs have the same coordinates; raises otherwise and hints at a common ``t_limits``."""
    for a in axes:  # count, range and a sum of 64-bit hashes of the distinct coordinates: nothing is collected
        marks = results.select(job, a).distinct().groupBy(job).agg(F.struct(F.count(F.lit(1)), F.min(a), F.max(a), F.sum(F.xxhash64(a).cast("decimal(20,0)"))).alias("m"))
        _one_axis(marks.select("m").distinct().limit(2).count(), a)


def _one_axis(n: int, axis: str) -> None:
    if n > 1:
        raise ValueError(f"jobs differ in their coordinates ({axis}); set common t_limits")


def json_to_long(df: DataFrame, column: str, dims: list[str], keys: list[str], values: dict[str, list[str]] | None = None) -> DataFrame:
    """Nested JSON objects to rows: one dimension per level, ``value`` a double.

    With ``values`` a dimension has exactly those keys: others go, missing ones are null.
    """
    kind = "double"
    for _ in dims[:-1]:
        kind = f"map<string,{kind}>"
    out = df.select(*keys, F.from_json(column, f"map<string,{kind}>").alias("_m"))
    for i, d in enumerate(dims):
        nxt = "value" if i == len(dims) - 1 else "_m"
        out = out.select(*keys, *dims[:i], F.explode("_m").alias(d, "_n")).withColumnRenamed("_n", nxt)
    if values and len(dims) == 1 and set(values) == set(dims):  # every key is looked up in the parsed object: no shuffle
        parsed = df.select(*keys, F.from_json(column, f"map<string,{kind}>").alias("_m"), F.explode(F.lit(values[dims[0]])).alias(dims[0]))
        return parsed.select(*keys, dims[0], F.try_element_at("_m", F.col(dims[0])).alias("value"))
    if values:
        for d, vs in values.items():
            out = out.where(F.col(d).isin(vs))
        rest = [d for d in dims if d not in values]
        want = df.select(*keys).distinct() if not rest else out.select(*keys, *rest).distinct()
        for d, vs in values.items():
            want = want.withColumn(d, F.explode(F.lit(vs)))
        out = want.join(out, [*keys, *dims], "left")
    return out.select(*keys, *dims, "value")


def json_lists_to_long(df: DataFrame, column: str, dims: list[str], keys: list[str], last: list, dim: str, values: dict[str, list[str]] | None = None) -> DataFrame:
    """As ``json_to_long`` for lists as leaves: their places are the coordinates ``last`` of one more dimension; a list of another length raises."""
    kind = "array<double>"
    for _ in dims:
        kind = f"map<string,{kind}>"
    out = df.select(*keys, F.from_json(column, kind).alias("_m"))
    for d in dims:
        wanted = (values or {}).get(d)
        if wanted:  # exactly these keys, looked up in the object
            out = out.withColumn(d, F.explode(F.lit(wanted))).withColumn("_m", F.try_element_at("_m", F.col(d)))
        else:
            out = out.select(*[c for c in out.columns if c != "_m"], F.explode("_m").alias(d, "_m"))
    wrong = F.raise_error(F.lit(f"a list along {dim} must have {len(last)} values")).cast("array<double>")
    empty = F.array_repeat(F.lit(None).cast("double"), len(last))
    leaf = F.when(F.col("_m").isNull(), empty).when(F.size("_m") == len(last), F.col("_m")).otherwise(wrong)
    return out.select(*keys, *dims, F.explode(F.arrays_zip(F.lit(last).alias(dim), leaf.alias("value"))).alias("_z")).select(*keys, *dims, f"_z.{dim}", "_z.value")


def concat_labels(parts: dict[str, DataFrame], label: str = "label") -> DataFrame:
    """Tables of one schema on a new label column."""
    if not parts:
        raise ValueError("nothing to concatenate")
    return reduce(lambda a, b: a.unionByName(b), [df.withColumn(label, F.lit(k)) for k, df in parts.items()])


def select_label(parts: dict[str, DataFrame], label: str | None = None) -> DataFrame:
    """One of the tables; without a label there must be exactly one."""
    if label is None and len(parts) != 1:
        raise ValueError("several labels: name one")
    return parts[next(iter(parts)) if label is None else label]


def batch_means(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Means with NaN skipped, and of how many values."""
    v = F.when(~F.isnan(value), F.col(value))
    return df.groupBy(*by).agg(F.avg(v).alias("mean"), F.count(v).alias("n"))


def top(df: DataFrame, by: str, k: int, tie: str) -> DataFrame:
    return df.orderBy(F.desc(by), tie).limit(k)


def peak_frequency(spectra: DataFrame, by: list[str], freq: str = "freq", value: str = "psd") -> DataFrame:
    """Frequency of the largest value, the lowest on ties; NaN is skipped."""
    return spectra.where(~F.isnan(value)).groupBy(*by).agg(F.max_by(freq, F.struct(F.col(value), -F.col(freq))).alias("peak_freq"), F.max(value).alias("peak"))


def difference_stats(a: DataFrame, b: DataFrame, on: list[str], value: str) -> DataFrame:
    """Largest, mean, and 95th and 99th percentile of |a - b| over shared coordinates, finite values only."""
    d = a.join(b.withColumnRenamed(value, "_o"), on).select(F.abs(F.col(value) - F.col("_o")).alias("d")).where("NOT isnan(d) AND d < double('infinity')")
    sums = d.agg(F.max("d").alias("max"), F.avg("d").alias("mean"), F.count(F.lit(1)).alias("n"))
    return sums.crossJoin(exact_quantiles(d, [], "d", {"p95": 0.95, "p99": 0.99})).select("max", "mean", "p95", "p99", "n")  # one row each
