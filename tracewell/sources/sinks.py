"""Sinks: tables with a JSON sidecar, published by rename; matrices and event tables as CSV."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import files


def save(df: DataFrame, path: str, meta: dict | None = None, partition_by: list[str] | None = None) -> None:
    """Write Parquet beside the target, rename it into place, and publish the sidecar last; what was there is put aside until then."""
    if not isinstance(df, DataFrame):
        raise TypeError("only tables can be saved")
    spark, path = df.sparkSession, path.rstrip("/")
    tmp = f"{path}.tmp"
    files.delete(spark, tmp)
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(tmp)
    old = f"{path}.old"
    files.delete(spark, old)
    files.delete(spark, f"{path}.meta.json")
    if files.exists(spark, path):
        files.rename(spark, path, old)
    files.rename(spark, tmp, path)
    files.write_text(spark, f"{path}.meta.json", json.dumps(meta or {}, sort_keys=True))
    files.delete(spark, old)


def load(spark: SparkSession, path: str, cache: bool = False) -> DataFrame:
    df = spark.read.parquet(path)
    return df.cache() if cache else df


def load_meta(spark: SparkSession, path: str) -> dict:
    side = f"{path.rstrip('/')}.meta.json"
    return json.loads(files.read_text(spark, side)) if files.exists(spark, side) else {}


def matrix(df: DataFrame, value: str, pops: list[str], digits: int | None = None, row: str = "pop_i", column: str = "pop_j") -> DataFrame:
    """A square table of strings, one row and column per population; NaN and missing values are ``nan``."""
    v = F.col(value)
    text = F.format_number(v, digits) if digits is not None else v.cast("string")
    if digits is not None:
        text = F.regexp_replace(text, ",", "")
    cells = df.withColumn("_v", F.when(v.isNull() | F.isnan(v), "nan").otherwise(text))
    wide = cells.groupBy(row).pivot(column, pops).agg(F.first("_v"))
    return wide.fillna("nan", subset=pops).select(row, *pops)


def write_csv(df: DataFrame, path: str, order: str) -> None:
    df.orderBy(order).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def save_per_job(df: DataFrame, folder: str, template: str, job: str = "job_id", label: str | None = None) -> None:
    """One file per job (and label), named by ``{job:05d}`` and ``{label}``: JSON or Parquet by the template's ending.

    Rows are shuffled to their job once; the files that Spark wrote are then renamed, one call per job. A job's rows are one
    task's work, as a file is one job's result; tables of any size go to ``save``.
    """
    spark, keys = df.sparkSession, [job, *([label] if label else [])]
    tmp = f"{folder.rstrip('/')}/.tmp"
    writer = df.repartition(*keys).write.mode("overwrite").option("maxRecordsPerFile", 0).partitionBy(*keys)  # a job's file is whole, whatever the session says
    writer.json(tmp) if template.endswith(".json") else writer.parquet(tmp)
    for path in files.glob(spark, f"{tmp}/{'/'.join(k + '=*' for k in keys)}/part-*"):
        at = dict(part.split("=", 1) for part in path.split("/") if part.split("=", 1)[0] in keys)
        files.rename(spark, path, f"{folder.rstrip('/')}/{template.format(job=int(at[job]), label=at.get(label or '', ''))}")
    files.delete(spark, tmp)


#: Version of the archive of trains.
SPIKES_VERSION = 1


def save_spikes(spikes: DataFrame, pops: DataFrame, path: str, meta: dict) -> None:
    """Trains as an archive: tables ``spikes`` and ``pops`` (which keeps populations without spikes, in order) and a sidecar with how they were taken."""
    save(spikes, f"{path.rstrip('/')}/spikes", meta | {"format_version": SPIKES_VERSION}, ["job_id"] if "job_id" in spikes.columns else None)
    save(pops, f"{path.rstrip('/')}/pops")


def load_spikes(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, dict]:
    """``spikes, pops, meta`` of an archive; an unknown version or a sidecar without the window raises."""
    meta = load_meta(spark, f"{path.rstrip('/')}/spikes")
    if meta.get("format_version") != SPIKES_VERSION:
        raise ValueError(f"archive version {meta.get('format_version')} is unknown")
    if missing := {"t0", "tmax", "subtract_t0", "ms"} - set(meta):
        raise ValueError(f"the archive's sidecar lacks {sorted(missing)}")
    return load(spark, f"{path.rstrip('/')}/spikes"), load(spark, f"{path.rstrip('/')}/pops"), meta


def validate_or_write(spark: SparkSession, path: str, content: dict) -> bool:
    """Write a JSON file, or check that it holds the same; True if it was there."""
    text = json.dumps(content, sort_keys=True)
    if files.exists(spark, path):
        if files.read_text(spark, path) != text:
            raise ValueError(f"{path} holds other settings")
        return True
    files.write_text(spark, path, text)
    return False
