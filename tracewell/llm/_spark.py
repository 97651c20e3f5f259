"""Session helpers: the shared working folder, written intermediate tables, registered inputs."""

from __future__ import annotations

import itertools
import math
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is ``spark.checkpoint.dir`` of the session. Only where that is unset a folder is
    chosen: a temporary one in local mode, a folder in the warehouse elsewhere.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        local = spark.sparkContext.master.split("[")[0] == "local"
        found = tempfile.mkdtemp(prefix="tracewell-") if local else spark.conf.get("spark.sql.warehouse.dir") + "/_tracewell"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """At most so many rows in an Arrow batch: 10,000 texts, the default, take tens of MB in the JVM and again in the worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > rows:
        spark.conf.set(key, str(rows))


def materialize(df: DataFrame, what: str) -> DataFrame:
    """Write a table to the shared folder and read it again; cuts lineage and survives lost executors."""
    spark = df.sparkSession
    small_batches(spark)
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    df.write.option("compression", "zstd").parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    written._written_to = path
    return written


def drop_materialized(*tables: DataFrame) -> None:
    """Delete tables of :func:`materialize` that nothing reads any more; what is not dropped goes when the driver ends."""
    for df in tables:
        folder = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._written_to)
        folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)


def fresh(*taken: DataFrame, stem: str = "c") -> str:
    """A column name that none of the tables has."""
    names = {c.lower() for df in taken for c in df.columns}
    return next(n for i in itertools.count() if (n := f"_{stem}{i}") not in names)


def lookup(rows: DataFrame, key: str, values: DataFrame, by: list[str], n: int) -> DataFrame:
    """Left join of rows with ``values``, which has each key once, where one key may have a third of the n rows.

    Rows are salted by a hash of ``by``; first the distinct (key, salt) get their values, then the rows. Neither join sees
    much more than the square root of n rows of one key.
    """
    salt = fresh(rows, values, stem="salt")
    salted = rows.withColumn(salt, F.pmod(F.xxhash64(*by), F.lit(max(1, math.isqrt(n)))).cast("int"))
    found = salted.select(key, salt).distinct().join(values, key)
    return salted.join(found, [key, salt], "left").drop(salt)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keep_rows(df: DataFrame, column: str, build: Callable[[], Callable[[list], list[bool]]], rows: int = 512) -> DataFrame:
    """The rows of df, all columns, whose value in a column passes; ``build()`` makes the test once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        test = build()
        for whole in batches:
            at = whole.schema.get_field_index(column)
            for start in range(0, whole.num_rows, rows):
                batch = whole.slice(start, rows)
                kept = batch.filter(pa.array(test(batch.column(at).to_pylist()), pa.bool_()))
                if kept.num_rows:
                    yield kept

    small_batches(df.sparkSession)
    return df.mapInArrow(run, df.schema)
