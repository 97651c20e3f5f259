"""Per-job results of a sweep: JSON, Parquet, ragged archives and (opt-in) pickles, each as one distributed read."""

from __future__ import annotations

import io
import pickle
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from ..operators.parse import RESULT
from . import archives


def _template(template: str) -> tuple[str, str]:
    """Glob and regular expression of a file name with ``{job:05d}``, and ``{label}`` perhaps."""
    parts = re.split(r"(\{job[^}]*\}|\{label\}|\*)", template)
    glob = "".join("*" if p.startswith("{") else p for p in parts)
    expr = "".join(r"(\d+)" if p.startswith("{job") else r"([^/]+?)" if p == "{label}" else r"[^/]*" if p == "*" else re.escape(p) for p in parts)
    return glob, f"/{expr}$"


def _job(expr: str, group: int = 1, path: str = "_path") -> Column:
    return F.regexp_extract(F.regexp_replace(F.col(path), r"\\\\", "/"), expr, group)


def one_each(df: DataFrame, expr: str) -> DataFrame:
    """The read, if every job (and label) has exactly one file; else raises. Uses the list of files that Spark made for the read."""
    found: dict[tuple, set[str]] = {}
    for path in df.inputFiles():
        if m := re.search(expr, path):
            found.setdefault(tuple(int(g) if g.isdigit() else g for g in m.groups()), set()).add(path)
    if bad := sorted((k for k, v in found.items() if len(v) > 1), key=str)[:3]:
        raise RuntimeError(f"jobs {bad} don't have exactly one file")
    return df


def read_job_json(spark: SparkSession, folder: str, template: str = "result_{job:05d}_*.json", schema: str | None = None) -> DataFrame:
    """One row per job's JSON document, with ``job_id``; a job with several matching files raises."""
    glob, expr = _template(template)
    reader = spark.read.option("multiLine", True).option("pathGlobFilter", glob)
    df = one_each((reader.schema(schema) if schema else reader).json(folder), expr)
    return df.withColumn("_path", F.col("_metadata.file_path")).withColumn("job_id", _job(expr).cast("long")).drop("_path")


def read_results(spark: SparkSession, folder: str, template: str = "grid_{job:05d}_data.json") -> DataFrame:
    """Nested simulation results in JSON, with the parser's schema."""
    return read_job_json(spark, folder, template, RESULT)


def read_job_raw(spark: SparkSession, folder: str, template: str, column: str = "json") -> DataFrame:
    """``job_id`` and the whole document as a string."""
    glob, expr = _template(template)
    df = one_each(spark.read.option("wholetext", True).option("pathGlobFilter", glob).text(folder), expr)
    return df.withColumn("_path", F.col("_metadata.file_path")).select(_job(expr).cast("long").alias("job_id"), F.col("value").alias(column))


def read_job_table(spark: SparkSession, folder: str, template: str = "{job:05d}_*.parquet", variable: str | None = None, coords: list[str] | None = None) -> DataFrame:
    """Per-job Parquet tables as one, with ``job_id``; ``variable`` keeps that column and the coordinates only.

    Coordinates are those named, else ``t, y, freq, lag`` and every column that is no double.
    """
    glob, expr = _template(template)
    df = one_each(spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", True).parquet(folder), expr)
    df = df.withColumn("_path", F.col("_metadata.file_path")).withColumn("job_id", _job(expr).cast("long")).drop("_path")
    if variable:
        numbers = {f.name for f in df.schema.fields if f.dataType.typeName() == "double"}
        keep = {variable, "job_id", *(coords if coords is not None else [c for c in df.columns if c not in numbers or c in ("t", "y", "freq", "lag")])}
        df = df.select([c for c in df.columns if c in keep])
    return df


def read_job_set(spark: SparkSession, folder: str, template: str = "{job:05d}_{label}.parquet", labels: list[str] | None = None) -> DataFrame:
    """Several labelled tables per job as one, with ``job_id`` and ``label``."""
    glob, expr = _template(template)
    df = one_each(spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", True).parquet(folder), expr)
    df = df.withColumn("_path", F.col("_metadata.file_path")).withColumn("job_id", _job(expr).cast("long")).withColumn("label", _job(expr, 2)).drop("_path")
    return df if labels is None else df.where(F.col("label").isin(labels))


def read_params(spark: SparkSession, folder: str, fields: list[str], glob: str = "*_cfg.json", job_pos: int = -2) -> DataFrame:
    """``job_id`` and dotted fields below ``simConfig`` of every configuration file under a folder."""
    df = spark.read.option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", glob).json(folder)
    stem = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.[^./]*$", 1)
    df = df.withColumn("_stem", stem)
    part = F.element_at(F.split("_stem", "_"), job_pos if job_pos < 0 else job_pos + 1)
    return df.select(part.cast("long").alias("job_id"), *[F.col(f"simConfig.{f}").alias(f.split(".")[-1]) for f in fields])


def _binary(spark: SparkSession, folder: str, template: str) -> DataFrame:
    glob, expr = _template(template)
    df = one_each(spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder), expr)
    return df.select(F.regexp_extract("path", expr, 1).cast("long").alias("job_id"), "content")


SPIKE_ROWS = "job_id long, pop string, cell long, gid long, t double"


def _trains(z) -> list[tuple[str, np.ndarray, np.ndarray, np.ndarray]]:
    """(population, its cells' gids, times one cell after another, offsets) of an archive."""
    names = [str(p) for p in z["pop_names"]]
    if "format_version" not in z:  # values, offsets and perhaps gids by the population's name
        return [(p, z[f"{p}__gids"] if f"{p}__gids" in z else np.full(len(z[f"{p}__offsets"]) - 1, -1), z[f"{p}__values"], z[f"{p}__offsets"]) for p in names]
    if (version := int(z["format_version"])) != archives.VERSION:
        raise ValueError(f"archive version {version} is unknown")
    out = []
    for k, p in enumerate(names):
        if bool(z["meta__combine"]):
            times = z[f"pop_{k}__combined_times"]
            out.append((p, np.array([-1]), times, np.array([0, len(times)])))
        else:
            out.append((p, z[f"pop_{k}__cell_gids"], z[f"pop_{k}__cell_times"], z[f"pop_{k}__cell_offsets"]))
    return out


def read_ragged(spark: SparkSession, folder: str, template: str = "spikes_{job:05d}.npz") -> DataFrame:
    """Archives of ragged trains to spike rows: those of ``archives``, whose version is checked, and ones by population name.

    A combined train is one cell of gid -1; cells without spikes have no rows.
    """

    def run(batches):
        for pdf in batches:
            rows = []
            for job, content in zip(pdf["job_id"], pdf["content"], strict=True):
                with np.load(io.BytesIO(content), allow_pickle=False) as z:
                    for pop, gids, values, offsets in _trains(z):
                        cell = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
                        rows.append(pd.DataFrame({"job_id": job, "pop": pop, "cell": cell, "gid": np.asarray(gids)[cell], "t": values.astype(float)}))
            yield pd.concat(rows) if rows else pd.DataFrame(columns=["job_id", "pop", "cell", "gid", "t"])

    return _binary(spark, folder, template).mapInPandas(run, SPIKE_ROWS)


#: What a pickle of plain containers, numbers and numpy arrays names (fixed values).
PLAIN_GLOBALS = frozenset((
    ("builtins", "set"), ("builtins", "frozenset"), ("builtins", "complex"), ("builtins", "bytearray"), ("builtins", "slice"), ("builtins", "range"),
    ("collections", "OrderedDict"), ("_codecs", "encode"),
    ("numpy", "ndarray"), ("numpy", "dtype"), ("numpy.core.multiarray", "_reconstruct"), ("numpy._core.multiarray", "_reconstruct"),
    ("numpy.core.multiarray", "scalar"), ("numpy._core.multiarray", "scalar"), ("numpy._core.numeric", "_frombuffer"), ("numpy.core.numeric", "_frombuffer"),
))


class PlainUnpickler(pickle.Unpickler):
    """Reads containers, numbers, texts and numpy arrays; any other name in a pickle raises before it is looked up."""

    def find_class(self, module: str, name: str):
        if (module, name) not in PLAIN_GLOBALS:
            raise pickle.UnpicklingError(f"{module}.{name} is no plain data")
        return super().find_class(module, name)


def load_plain(content: bytes):
    return PlainUnpickler(io.BytesIO(content)).load()


def _jsonable(o):
    """Containers with text keys and JSON numbers; NaN and infinities become null."""
    if isinstance(o, dict):
        return {str(k): _jsonable(v) for k, v in o.items()}
    if isinstance(o, list | tuple | set | frozenset | range):
        return [_jsonable(v) for v in o]
    if hasattr(o, "tolist"):
        return _jsonable(o.tolist())
    if isinstance(o, float):
        return o if np.isfinite(o) else None
    return o if isinstance(o, str | int | bool) or o is None else str(o)


def read_pickles(spark: SparkSession, folder: str, template: str = "grid_{job:05d}_data.pkl", allow_pickle: bool = False, schema: str | None = RESULT) -> DataFrame:
    """Results in pickles by the parser's schema, or as JSON texts (``json``) with ``schema=None``.

    Only plain containers and numpy arrays are read: a pickle that names anything else raises and runs nothing. With
    ``allow_pickle`` any pickle is loaded, and can run code: for files of your own.
    """

    def run(batches):
        import json

        load = pickle.loads if allow_pickle else load_plain
        for pdf in batches:
            yield pd.DataFrame({"job_id": pdf["job_id"], "json": [json.dumps(_jsonable(load(c))) for c in pdf["content"]]})

    raw = _binary(spark, folder, template).mapInPandas(run, "job_id long, json string")
    return raw if schema is None else raw.select("job_id", F.from_json("json", schema).alias("r")).select("job_id", "r.*")


def read_mask(spark: SparkSession, path: str, variable: str = "mask") -> DataFrame:
    """``y, t, m`` of a mask in a gridded file or a table; its dimensions must be (y, time), whatever else raises."""
    from . import gridded

    if path.endswith(".nc"):
        dims = [f.name for f in gridded.infer(path, [variable]).fields][1:-1]
        if dims != ["y", "time"]:
            raise ValueError(f"a mask has dimensions y and time, this one {dims}")
        return gridded.read_gridded(spark, path, variable).select(F.col("y").cast("double").alias("y"), F.col("time").cast("double").alias("t"), F.col(variable).cast("int").alias("m"))
    df = spark.read.parquet(path)
    if variable not in df.columns or set(df.columns) - {variable} != {"y", "time"}:
        raise ValueError(f"a mask has dimensions y and time, this table {sorted(set(df.columns) - {variable})}")
    return df.select(F.col("y").cast("double").alias("y"), F.col("time").cast("double").alias("t"), F.col(variable).cast("int").alias("m"))


def first_available(*loaders) -> DataFrame:
    """The first source that is there; the last error if none is. Any other error than a missing source is raised."""
    missing: Exception | None = None
    for load in loaders:
        try:
            return load()
        except FileNotFoundError as e:
            missing = e
        except AnalysisException as e:  # Spark's form of it; a file that is there but broken is raised
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            missing = e
    raise missing or ValueError("no source")
