"""Small files through Hadoop's file systems, so that paths may be in any store Spark reads."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, what: str) -> str:
    """A new folder, shared by driver and executors and deleted when the driver ends.

    It lies in the session's ``spark.checkpoint.dir``; where that is unset, in a temporary folder (local mode) or the warehouse.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        local = spark.sparkContext.master.split("[")[0] == "local"
        base = tempfile.gettempdir() if local else spark.conf.get("spark.sql.warehouse.dir")
    path = f"{base.rstrip('/')}/tracewell-{what}-{uuid.uuid4().hex}"
    fs, p = _fs(spark, path)
    fs.mkdirs(p)
    fs.deleteOnExit(p)
    return path


def written(df: DataFrame, what: str) -> DataFrame:
    """The table written to a :func:`scratch` folder and read again: cuts lineage, and lost executors repeat no earlier work."""
    path = scratch(df.sparkSession, what) + "/t"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return bool(fs.exists(p))


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = _fs(spark, path)
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, p = _fs(spark, path)
    stream = fs.create(p, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def make(spark: SparkSession, path: str) -> None:
    """A folder and those above it."""
    fs, p = _fs(spark, path)
    fs.mkdirs(p)


def rename(spark: SparkSession, old: str, new: str) -> None:
    fs, p = _fs(spark, old)
    if not fs.rename(p, spark._jvm.org.apache.hadoop.fs.Path(new)):
        raise OSError(f"can't rename {old}")


def glob(spark: SparkSession, pattern: str) -> list[str]:
    fs, p = _fs(spark, pattern)
    return sorted(s.getPath().toString() for s in (fs.globStatus(p) or []))


def stamp(spark: SparkSession, paths: list[str]) -> list[tuple[str, int, int]]:
    """Path, size and modification time of files."""
    out = []
    for path in sorted(paths):
        fs, p = _fs(spark, path)
        s = fs.getFileStatus(p)
        out.append((path, s.getLen(), s.getModificationTime()))
    return out
