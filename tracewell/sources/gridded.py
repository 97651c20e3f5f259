"""Gridded files in the classic NetCDF layout: a data source that reads them by slabs, and a writer of one file per job.

The header is parsed on the driver from the file's first bytes. A slab is a range of the first dimension of about
``slab`` bytes; each is an input partition that seeks to its own bytes. Only the columns of the asked schema are read; ``start``
and ``stop`` keep a range of the first dimension, and comparisons of its coordinate with numbers are pushed down: a slab reads its
coordinates first, and data only from the first to the last place that passes.
"""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from . import files
from .archives import place

#: Tags and types of the layout (fixed values): numpy's kind of each external type.
DIMENSION, VARIABLE, ATTRIBUTE = 10, 11, 12
KINDS = {1: ">i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8", 7: ">u1", 8: ">u2", 9: ">u4", 10: ">i8", 11: ">u8"}
SLAB = 16 << 20
#: Cells of one Arrow batch.
CELLS = 1 << 16


@dataclass
class Variable:
    name: str
    dims: list[str]
    kind: str
    begin: int
    shape: list[int]
    stride: int  # bytes from one place of the first dimension to the next
    attributes: dict = field(default_factory=dict)

    @property
    def inner(self) -> int:
        return int(np.prod(self.shape[1:], dtype=np.int64))


class _Cursor:
    def __init__(self, data: bytes) -> None:
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise EOFError
        self.at += n
        return self.data[self.at - n : self.at]

    def number(self, size: int) -> int:
        return int.from_bytes(self.take(size), "big")


def parse_header(data: bytes) -> tuple[dict[str, int], dict[str, Variable], dict]:
    """Dimensions, variables and attributes of a classic file (versions 1, 2 and 5); EOFError if ``data`` ends within the header."""
    c = _Cursor(data)
    if c.take(3) != b"CDF" or (version := c.number(1)) not in (1, 2, 5):
        raise ValueError("not a gridded file in the classic layout")
    count, offset = (8 if version == 5 else 4), (4 if version == 1 else 8)

    def name() -> str:
        n = c.number(count)
        return c.take(n + -n % 4)[:n].decode()

    def listed(tag: int) -> range:
        found, n = c.number(4), c.number(count)
        if found not in (0, tag):
            raise ValueError("broken header of a gridded file")
        return range(n)

    def attributes() -> dict:
        out = {}
        for _ in listed(ATTRIBUTE):
            key, kind, n = name(), KINDS[c.number(4)], c.number(count)
            size = n * np.dtype(kind).itemsize
            raw = c.take(size + -size % 4)[:size]
            out[key] = raw.decode("utf-8", "replace") if kind == "S1" else np.frombuffer(raw, kind).tolist()
        return out

    records = c.number(count)
    dims = [(name(), c.number(count)) for _ in listed(DIMENSION)]
    whole, found = attributes(), []
    for _ in listed(VARIABLE):
        key, ids = name(), [c.number(count) for _ in range(c.number(count))]
        own, kind = attributes(), KINDS[c.number(4)]
        c.number(count)  # its size, which follows from the shape
        found.append((key, ids, own, kind, c.number(offset)))
    sizes = lambda ids: [records if dims[i][1] == 0 else dims[i][1] for i in ids]
    each = {k: int(np.prod(sizes(ids[1:]), dtype=np.int64)) * np.dtype(kind).itemsize for k, ids, _, kind, _ in found}
    growing = [k for k, ids, *_ in found if ids and dims[ids[0]][1] == 0]
    record = each[growing[0]] if len(growing) == 1 else sum(each[k] + -each[k] % 4 for k in growing)
    variables = {k: Variable(k, [dims[i][0] for i in ids], kind, begin, sizes(ids), record if k in growing else each[k], own) for k, ids, own, kind, begin in found}
    return {n: records if size == 0 else size for n, size in dims}, variables, whole


def read_header(path: str) -> tuple[dict[str, int], dict[str, Variable], dict]:
    system, local = place(path)
    with system.open_input_file(local) as f:
        size = 1 << 16
        while True:
            f.seek(0)
            data = f.read(size)
            try:
                return parse_header(data)
            except EOFError:
                if len(data) < size:
                    raise ValueError(f"{path} ends within its header") from None
                size *= 4


def _bytes(f, v: Variable, lo: int, hi: int) -> np.ndarray:
    """Places lo..hi of a variable's first dimension, as (hi - lo, inner)."""
    kind, n = np.dtype(v.kind), max(hi - lo, 0)
    width = v.inner * kind.itemsize
    if n and v.stride == width:
        f.seek(v.begin + lo * v.stride)
        data = f.read(n * width)
    else:
        parts = []
        for k in range(lo, hi):  # records hold other variables between
            f.seek(v.begin + k * v.stride)
            parts.append(f.read(width))
        data = b"".join(parts)
    if len(data) != n * width:
        raise ValueError(f"{v.name} ends early")
    return np.frombuffer(data, kind).reshape(n, v.inner)


def _texts(chars: np.ndarray) -> np.ndarray:
    return np.array([b"".join(r.tolist()).rstrip(b"\0 ").decode("utf-8", "replace") for r in chars], object)


def _coordinate(f, variables: dict[str, Variable], dim: str, lo: int, hi: int) -> np.ndarray:
    """Labels of a dimension: its variable's values (texts from characters), else the places themselves."""
    v = variables.get(dim)
    if v is None or v.dims[0] != dim:
        return np.arange(lo, hi)
    data = _bytes(f, v, lo, hi)
    return _texts(data) if v.kind == "S1" else data[:, 0].astype(np.float64 if v.kind[1] == "f" else np.int64)


@dataclass
class Slab(InputPartition):
    path: str
    lo: int
    hi: int


class GriddedReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType) -> None:
        self.paths, self.variables = json.loads(options["paths"]), options["variables"].split(",")
        self.slab, self.start, self.stop = int(options.get("slab", SLAB)), int(options.get("start", 0)), int(options.get("stop", 1 << 62))
        self.schema, self.tests = schema, []

    def pushFilters(self, filters: list[Filter]):
        """Keeps comparisons of the first dimension's coordinate for pruning; all are checked by Spark again."""
        _, variables, _ = read_header(self.paths[0])
        first = variables[self.variables[0]].dims[:1]
        signs = {GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<=", EqualTo: "=="}
        for one in filters:
            if type(one) in signs and list(one.attribute) == first and isinstance(one.value, int | float):
                self.tests.append((signs[type(one)], one.value))
            yield one

    def partitions(self) -> list[Slab]:
        out = []
        for path in self.paths:
            _, variables, _ = read_header(path)
            v = variables[self.variables[0]]
            lo, hi = max(0, self.start), min(v.shape[0] if v.shape else 1, self.stop)
            step = max(1, self.slab // max(1, v.inner * np.dtype(v.kind).itemsize))
            out += [Slab(path, k, min(k + step, hi)) for k in range(lo, hi, step)]
        return out

    def read(self, slab: Slab | None) -> Iterator[pa.RecordBatch]:
        if slab is None:
            return
        _, variables, _ = read_header(slab.path)
        wanted = set(self.schema.fieldNames())
        main = variables[self.variables[0]]
        dims, inner = main.dims or ["place"], main.inner
        system, local = place(slab.path)
        with system.open_input_file(local) as f:
            first = _coordinate(f, variables, dims[0], slab.lo, slab.hi)
            lo, hi = slab.lo, slab.hi
            if self.tests and first.dtype != object:
                sign = {">": np.greater, ">=": np.greater_equal, "<": np.less, "<=": np.less_equal, "==": np.equal}
                good = np.flatnonzero(np.all([sign[s](first, x) for s, x in self.tests], axis=0))
                if not len(good):
                    return
                lo, hi = slab.lo + int(good[0]), slab.lo + int(good[-1]) + 1
            others = {d: _coordinate(f, variables, d, 0, n) for d, n in zip(main.dims[1:], main.shape[1:], strict=True) if d in wanted}
            step = max(1, CELLS // max(1, inner))
            for a in range(lo, hi, step):
                b = min(a + step, hi)
                columns = {}
                for name in self.schema.fieldNames():
                    if name == "_file":
                        columns[name] = pa.array([slab.path] * ((b - a) * inner), pa.string())
                    elif name == dims[0]:
                        columns[name] = pa.array(np.repeat(first[a - slab.lo : b - slab.lo], inner))
                    elif name in others:
                        k = main.dims.index(name)
                        after = int(np.prod(main.shape[k + 1 :], dtype=np.int64))
                        columns[name] = pa.array(np.tile(np.repeat(others[name], after), (b - a) * inner // max(1, after * main.shape[k])))
                    else:
                        v = variables[name]
                        data = _bytes(f, v, a, b).ravel()
                        x = data.astype(np.float64)
                        gone = [data == np.array(q, data.dtype) for q in v.attributes.get("_FillValue", [])]
                        columns[name] = pa.array(x, mask=np.any(gone, axis=0) if gone else None)
                yield pa.RecordBatch.from_arrays([columns[f.name].cast(_arrow(f)) for f in self.schema.fields], names=self.schema.fieldNames())


def _arrow(f: StructField) -> pa.DataType:
    return {"double": pa.float64(), "bigint": pa.int64(), "string": pa.string()}[f.dataType.simpleString()]


def infer(path: str, names: list[str]) -> StructType:
    """``_file``, a column per dimension and one per variable; the variables must share their dimensions."""
    _, variables, _ = read_header(path)
    if missing := [n for n in names if n not in variables]:
        raise ValueError(f"{path} has no variable {missing}; it has {sorted(variables)}")
    if any(variables[n].dims != variables[names[0]].dims or variables[n].kind == "S1" for n in names):
        raise ValueError(f"variables {names} are no numbers on one grid")
    fields = [StructField("_file", StringType())]
    for d in variables[names[0]].dims:
        v = variables.get(d)
        own = v is not None and v.dims[0] == d
        fields.append(StructField(d, (StringType() if v.kind == "S1" else DoubleType() if v.kind[1] == "f" else LongType()) if own else LongType()))
    return StructType([*fields, *(StructField(n, DoubleType()) for n in names)])


class Gridded(DataSource):
    """``spark.read.format("gridded")``; options ``paths`` (a JSON list), ``variables``, ``slab``, ``start``, ``stop``."""

    @classmethod
    def name(cls) -> str:
        return "gridded"

    def schema(self) -> StructType:
        return infer(json.loads(self.options["paths"])[0], self.options["variables"].split(","))

    def reader(self, schema: StructType) -> GriddedReader:
        return GriddedReader(dict(self.options), schema)


def read_gridded(spark: SparkSession, path: str, variables: str | list[str], columns: list[str] | None = None, start: int | None = None, stop: int | None = None, slab: int = SLAB) -> DataFrame:
    """Variables on one grid as rows: a column per dimension with its labels (else places), and one per variable; ``path`` may be a pattern."""
    names = [variables] if isinstance(variables, str) else variables
    paths = files.glob(spark, path)
    if not paths:
        raise FileNotFoundError(path)
    spark.dataSource.register(Gridded)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = spark.read.format("gridded").option("paths", json.dumps(paths)).option("variables", ",".join(names)).option("slab", slab)
    for key, v in (("start", start), ("stop", stop)):
        reader = reader if v is None else reader.option(key, v)
    schema = infer(paths[0], names)
    return reader.schema(StructType([f for f in schema.fields if (f.name in columns if columns else f.name != "_file")])).load()


def read_job_gridded(spark: SparkSession, folder: str, template: str, variables: str | list[str], slab: int = SLAB) -> DataFrame:
    """Per-job gridded files as one table with ``job_id``; a job with several files raises."""
    from .jobs import _job, _template

    glob, expr = _template(template)
    names = [variables] if isinstance(variables, str) else variables
    paths = files.glob(spark, f"{folder.rstrip('/')}/{glob}")
    found = [m[1] for p in paths if (m := re.search(expr, p))]
    if len(set(map(int, found))) < len(found):
        raise RuntimeError("a job doesn't have exactly one file")
    if not paths:
        raise FileNotFoundError(f"{folder}/{template}")
    columns = [f.name for f in infer(paths[0], names).fields]
    df = read_gridded(spark, f"{folder.rstrip('/')}/{glob}", names, columns, slab=slab)
    return df.withColumn("job_id", _job(expr, path="_file").cast("long")).drop("_file")


# --- writing -------------------------------------------------------------------------


def encode(dims: dict[str, int], variables: dict[str, tuple[list[str], np.ndarray]], attributes: dict[str, str] | None = None) -> bytes:
    """A file of version 2: fixed dimensions, numbers as doubles or ints, texts as characters in rows of one length."""
    dims, plain = dict(dims), {}
    for name, (over, x) in variables.items():
        x = np.asarray(x)
        if x.dtype.kind in "OUS":
            rows = [str(v).encode() for v in x]
            width = max([1, *map(len, rows)])
            dims[f"{name}_length"] = width
            plain[name] = ([*over, f"{name}_length"], 2, b"".join(r.ljust(width, b"\0") for r in rows))
        elif x.dtype.kind in "iub" and (not x.size or np.abs(x).max() < 1 << 31):
            plain[name] = (over, 4, x.astype(">i4").tobytes())
        else:
            plain[name] = (over, 6, x.astype(">f8").tobytes())
    u4 = lambda n: struct.pack(">I", n)
    padded = lambda b: b + b"\0" * (-len(b) % 4)
    text = lambda s: u4(len(s.encode())) + padded(s.encode())
    listed = lambda tag, items: u4(tag if items else 0) + u4(len(items)) + b"".join(items)
    order = list(dims)
    head = b"CDF\2" + u4(0) + listed(DIMENSION, [text(d) + u4(n) for d, n in dims.items()])
    head += listed(ATTRIBUTE, [text(k) + u4(2) + text(v) for k, v in (attributes or {}).items()])
    entry = lambda name, begin: text(name) + u4(len(plain[name][0])) + b"".join(u4(order.index(d)) for d in plain[name][0]) + u4(0) + u4(0) + u4(plain[name][1]) + u4(min(len(padded(plain[name][2])), (1 << 32) - 1)) + struct.pack(">q", begin)
    at = len(head) + len(listed(VARIABLE, [entry(n, 0) for n in plain]))
    entries = []
    for name in plain:
        entries.append(entry(name, at))
        at += len(padded(plain[name][2]))
    return head + listed(VARIABLE, entries) + b"".join(padded(v[2]) for v in plain.values())


def save_job_gridded(df: DataFrame, folder: str, template: str, dims: list[str], variable: str, job: str = "job_id") -> DataFrame:
    """Rows ``job, dims, variable`` as one gridded file per job; returns ``job, bytes`` of what was written.

    A job's result is one task's work and one file. Labels of each dimension are sorted; a missing cell is NaN, a double one raises.
    """

    def write(pdf: pd.DataFrame) -> pd.DataFrame:
        number = pdf[job].iloc[0]
        labels = [np.array(sorted(pdf[d].unique())) for d in dims]
        cells = np.full([len(x) for x in labels], np.nan)
        at = tuple(np.searchsorted(x, pdf[d].to_numpy()) for x, d in zip(labels, dims, strict=True))
        if len(pdf) > cells.size or len(set(zip(*at, strict=True))) < len(pdf):
            raise ValueError(f"job {number} has two values in one cell")
        cells[at] = pdf[variable].to_numpy(float)
        data = encode({d: len(x) for d, x in zip(dims, labels, strict=True)}, {d: ([d], x) for d, x in zip(dims, labels, strict=True)} | {variable: (dims, cells)})
        system, local = place(f"{folder.rstrip('/')}/{template.format(job=int(number))}")
        system.create_dir(local.rsplit("/", 1)[0], recursive=True)
        attempt = TaskContext.get().taskAttemptId()  # two attempts write apart
        with system.open_output_stream(f"{local}.tmp{attempt}") as f:
            f.write(data)
        system.move(f"{local}.tmp{attempt}", local)
        return pd.DataFrame({"job": [int(number)], "bytes": [len(data)]})

    done = df.select(job, *dims, variable).groupBy(job).applyInPandas(write, "job long, bytes long")
    return files.written(done, "gridded").withColumnRenamed("job", job)

