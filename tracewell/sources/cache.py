"""Results that are computed once: Parquet with a sidecar that says from what and with which parameters."""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from collections.abc import Callable
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import files, sinks

#: Parameters that change how a result is computed, not what it is (fixed values).
EXECUTION_ONLY = frozenset(("compute", "store_proc_info", "load", "engine", "chunks", "open_kwargs", "save_kwargs", "cache_open_kwargs", "cache_save_kwargs"))
VERSION = 2


def normalise(params: dict | None) -> dict:
    """Plain JSON values, without execution-only keys."""

    def plain(v):
        if isinstance(v, dict):
            return {str(k): plain(x) for k, x in sorted(v.items(), key=lambda x: str(x[0])) if k not in EXECUTION_ONLY}
        if isinstance(v, list | tuple | set | frozenset):
            return [plain(x) for x in (sorted(v, key=str) if isinstance(v, set | frozenset) else v)]
        if hasattr(v, "tolist"):
            return plain(v.tolist())
        return v if isinstance(v, str | int | float | bool) or v is None else os.fspath(v) if isinstance(v, os.PathLike) else str(v)

    return plain(params or {})


def digest(df: DataFrame) -> dict:
    """What a table holds, whatever the order of its rows: schema, count, and sum and xor of two 64-bit hashes of each row's text.

    Rows are JSON texts with nulls and microseconds, so values in other columns or places differ. One pass, two numbers a task.
    """
    options = {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
    plain = df.toDF(*(f"c{i}" for i in range(len(df.columns))))  # names may repeat
    text = F.to_json(F.struct(*plain.columns), options) if plain.columns else F.lit("")
    rows = plain.select(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b"))
    n, total, folded = rows.agg(F.count(F.lit(1)), F.sum(F.col("a").cast("decimal(38,0)")), F.bit_xor("b")).first()
    return {"schema": [[f.name, f.dataType.simpleString()] for f in df.schema], "rows": n, "sum": str(total), "xor": folded}


def fingerprint(spark: SparkSession, source: str | DataFrame | dict | None) -> object:
    """What identifies an input: a path by its upstream cache id, else by its files with size and time; a table by what it holds.

    Two tables from one file, or from none, are known apart by a pass over their rows; nothing but the digest is collected.
    """
    if source is None or isinstance(source, dict):
        return source
    if isinstance(source, str):
        upstream = sinks.load_meta(spark, source).get("cache_id")
        return {"cache_id": upstream} if upstream else {"files": files.stamp(spark, files.glob(spark, source))}
    return {"digest": digest(source)}


def make_info(step: str, params: dict | None, source: object) -> dict:
    record = {"step": step, "params": normalise(params), "source": normalise({"s": source})["s"], "version": VERSION}
    text = json.dumps(record, sort_keys=True)
    return json.loads(text) | {"cache_id": hashlib.md5(text.encode(), usedforsecurity=False).hexdigest()[:12]}


def load_or_run(spark: SparkSession, path: str, fn: Callable[[], DataFrame], step: str, params: dict | None = None, source: str | DataFrame | dict | None = None, on_mismatch: str = "recompute") -> tuple[DataFrame, bool]:
    """The stored result and True, if its record matches; else compute, store and read it (or raise, if asked to)."""
    info = make_info(step, params, fingerprint(spark, source))
    if files.exists(spark, f"{path.rstrip('/')}.meta.json"):
        if {k: sinks.load_meta(spark, path).get(k) for k in info} == info:
            return sinks.load(spark, path), True
        if on_mismatch == "raise":
            raise ValueError(f"{path} was made with other parameters or inputs")
    sinks.save(fn(), path, info)
    return sinks.load(spark, path), False


def finished(spark: SparkSession, path: str, key: str = "job_id") -> set[str]:
    """Slots of a table of :func:`append_missing` that are there, or are known to have no rows, as texts.

    A table without a ledger has the slots that have a folder.
    """
    path = path.rstrip("/")
    there = {unquote(p.rsplit("=", 1)[1]) for p in files.glob(spark, f"{path}/{key}=*")}
    if not files.exists(spark, f"{path}.done"):
        return there
    records = _ledger(spark, path)
    return {j for r in records for j in r["with_rows"] if j in there} | {j for r in records for j in r["empty"]}


def _ledger(spark: SparkSession, path: str) -> list[dict]:
    """What the runs have finished, one small file a build."""
    return [json.loads(files.read_text(spark, p)) for p in files.glob(spark, f"{path}.done/*.json")]


def append_missing(spark: SparkSession, path: str, jobs: list, build: Callable[[list], DataFrame], meta: dict, key: str = "job_id", step: int | None = None) -> DataFrame:
    """A table partitioned by ``key`` with at least these slots; only missing ones are built. Other settings than the stored ones raise.

    Slots are built ``step`` at a time; each build overwrites its own partitions only, and is then entered in the ledger beside
    the table, with the slots that have no rows. A run that is killed goes on after its last finished build; a slot whose
    folder is gone is built again.
    """
    path = path.rstrip("/")
    side = f"{path}.meta.json"
    if files.exists(spark, side) and sinks.load_meta(spark, path) != normalise(meta):
        raise ValueError("the stored jobs were made with other settings")
    have = finished(spark, path, key) if files.exists(spark, side) else set()
    missing = [j for j in dict.fromkeys(jobs) if str(j) not in have]
    if missing and not files.exists(spark, side):
        files.make(spark, f"{path}.done")
        files.write_text(spark, side, json.dumps(normalise(meta), sort_keys=True))
    for at in range(0, len(missing), step or max(len(missing), 1)):
        part = missing[at : at + (step or len(missing))]
        made = build(part)
        for stray in files.glob(spark, f"{path}/{key}=*"):  # of a build that did not come to its end
            if unquote(stray.rsplit("=", 1)[1]) in set(map(str, part)):
                files.delete(spark, stray)
        made.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)
        there = {unquote(p.rsplit("=", 1)[1]) for p in files.glob(spark, f"{path}/{key}=*")}
        if not files.exists(spark, f"{path}.done"):  # a table from before there was a ledger
            _enter(spark, path, sorted(there), [], made)
        _enter(spark, path, [str(j) for j in part if str(j) in there], [str(j) for j in part if str(j) not in there], made)
    records = _ledger(spark, path)
    files.make(spark, path)
    reader = spark.read
    if records:
        reader = reader.schema(StructType.fromJson(json.loads(records[-1]["schema"])))
    return reader.parquet(path)


def _enter(spark: SparkSession, path: str, with_rows: list[str], empty: list[str], made: DataFrame) -> None:
    """One more file of the ledger, named by its number, published by rename."""
    target = f"{path}.done/{len(files.glob(spark, f'{path}.done/*.json')):09d}-{uuid.uuid4().hex[:8]}.json"
    files.make(spark, f"{path}.done")
    files.write_text(spark, f"{target}.tmp", json.dumps({"with_rows": with_rows, "empty": empty, "schema": made.schema.json()}))
    files.rename(spark, f"{target}.tmp", target)


def tag(**params) -> str:
    """A file-name part of parameters: minus is m, the point is p."""
    def one(v) -> str:
        if isinstance(v, float | int) and not isinstance(v, bool):
            return f"{v:g}".replace("-", "m").replace(".", "p")
        if isinstance(v, list | tuple):
            return "_".join(map(one, v)) if len(v) <= 4 else hashlib.sha1(json.dumps(normalise({"v": v})).encode(), usedforsecurity=False).hexdigest()[:10]
        return str(v)

    return "__".join(f"{k}_{one(v)}" for k, v in params.items())
