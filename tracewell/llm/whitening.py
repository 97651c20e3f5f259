"""Whitening of embeddings by their leading principal components, found without forming a covariance.

Block subspace iteration: each pass over the fitted vectors computes Xᵀ(XQ) on centred rows, summed by Spark a task at a
time; the driver holds d x block matrices only, orthogonalises by QR and takes Ritz pairs (Rayleigh-Ritz). Products of
earlier blocks stay in the Ritz basis, up to ``basis`` columns, then the best Ritz vectors replace it; spectra of embeddings
are flat and plain powers would take hundreds of passes. It ends when the residuals of all k pairs are certified.

Entries become integers, so sums, the centre's numerator and deviations are exact. Each distinct vector counts once.

Defined cases: rows with a null vector, a null or a non-finite entry are dropped; entries beyond a long saturate; shorter
vectors count as followed by zeros, up to the longest. A component without variance has explained 0 and null whitened; with
all vectors equal explained is null as well. A deviation beyond a long is null. Fewer dimensions than components give as many
components as dimensions; empty tables give empty results. Repeated rows, also of one id, each get their rows; a null
``vec_id`` stays null. Of equal eigenvalues any basis of their space may come out, the same for all rows. Extra columns
are ignored whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import materialize, small_batches, table

COMPONENTS = 4
BLOCK = 16
BASIS = 128
#: A Ritz pair is certified when its residual is at most so many times the largest eigenvalue; where rounding keeps it
#: above that, when it has come below the second figure and three passes have not halved it.
RESIDUAL, ROUNDING = 2e-14, 1e-11
PASSES = 500
OUT = "vec_id {id}, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whole_numbers(embeddings: DataFrame) -> DataFrame:
    """``vec_id, x``: floor(256 c) of each entry, rows with null or non-finite entries left out."""
    c = F.col("embedding").cast("array<double>")
    good = F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return embeddings.where(F.col("embedding").isNotNull() & F.coalesce(good, F.lit(False))).select("vec_id", F.transform(c, lambda v: F.floor(v * 256) + 0).alias("x"))


def matrix(column: pa.Array, d: int) -> np.ndarray:
    """Rows of a list column as an int64 matrix of d columns, short rows followed by zeros."""
    flat, ends = column.flatten().to_numpy(), np.asarray(column.offsets)
    sizes = np.diff(ends)
    if len(sizes) and (sizes == d).all():
        return flat.reshape(-1, d)
    out = np.zeros((len(sizes), d), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(ends[:-1] - ends[0], sizes)] = flat
    return out


def total(fit: DataFrame, of, d: int, width: int) -> np.ndarray:
    """The sum over all rows of ``of(x)``, an r x width matrix of floats: a partial sum per task, added up by row number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = None
        for b in batches:
            if b.num_rows:
                y = of(matrix(b.column(0), d))
                part = y if part is None else part + y
        if part is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(part)), pa.int32()), *(pa.array(c, pa.float64()) for c in part.T)], ["i", *(f"c{j}" for j in range(width))])

    names = [f"c{j}" for j in range(width)]
    parts = fit.select("x").mapInArrow(run, "i int, " + ", ".join(f"{c} double" for c in names))
    rows = parts.groupBy("i").agg(*(F.sum(c).alias(c) for c in names)).orderBy("i").collect()
    return np.array([r[1:] for r in rows], float).reshape(len(rows), width)


def centred_product(fit: DataFrame, centre: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Xᵀ(XQ) of the centred rows: one pass."""

    def of(x: np.ndarray) -> np.ndarray:
        z = x - centre
        return z.T @ (z @ q)

    return total(fit, of, len(centre), q.shape[1])


class Model(NamedTuple):
    n: int
    sums: np.ndarray  # exact, of Python's integers
    components: np.ndarray  # d x k, unit columns
    eigenvalues: np.ndarray
    trace: float
    identity_error: float | None
    passes: int


def leading(product, d: int, k: int, block: int = BLOCK, basis: int = BASIS, residual: float = RESIDUAL, passes: int = PASSES) -> tuple[np.ndarray, np.ndarray, int]:
    """The k leading eigenpairs of the symmetric operator ``product(q)``, and the passes that it took."""
    q = np.linalg.qr(np.random.default_rng(0).standard_normal((d, min(d, max(block, k)))))[0]
    v, av = np.empty((d, 0)), np.empty((d, 0))
    worst: list[float] = []
    for done in range(1, passes + 1):
        v, av = np.hstack([v, q]), np.hstack([av, product(q)])
        small = v.T @ av
        e, y = np.linalg.eigh((small + small.T) / 2)
        e, y = e[::-1], y[:, ::-1]
        ritz, image = v @ y, av @ y
        rest = image - ritz * e
        worst.append(float(np.linalg.norm(rest[:, :k], axis=0).max()))
        level = len(worst) > 3 and worst[-1] <= ROUNDING * e[0] and worst[-1] > worst[-4] / 2
        if v.shape[1] == d or worst[-1] <= residual * max(e[0], 0) or level:
            return ritz[:, :k], e[:k], done
        if v.shape[1] + block > max(basis, 3 * block):  # restart from the best pairs
            held = max(2 * block, k)
            v, av, rest = ritz[:, :held], image[:, :held], rest[:, :held]
        new = rest[:, :block]
        gone = np.linalg.norm(new, axis=0) <= residual * e[0]  # of pairs that are exact already
        new = np.where(gone, np.random.default_rng(done).standard_normal(new.shape) * e[0], new)
        for _ in range(3):  # orthogonal to the basis to the last digits
            new = np.linalg.qr(new - v @ (v.T @ new))[0]
        q = new[:, : min(new.shape[1], d - v.shape[1])]
    raise ArithmeticError(f"residuals are not certified after {passes} passes")


def fit(vectors: DataFrame, k: int = COMPONENTS) -> Model | None:
    """Fits on each distinct vector of ``x`` once; None without any."""
    distinct = materialize(vectors.select("x").distinct(), "fit")
    n, d, least = distinct.agg(F.count("x"), F.max(F.size("x")), F.min(F.size("x"))).first()
    if not n or not d:
        return None
    if least < d:
        distinct = materialize(distinct.select(F.concat("x", F.array_repeat(F.lit(0).cast("long"), d - F.size("x"))).alias("x")).distinct(), "padded")
        n = distinct.count()

    def sums_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = np.zeros((2, d), object)  # exact in Python's integers, whatever the sizes
        for b in batches:
            if b.num_rows:
                x = matrix(b.column(0), d)
                part += np.array([(x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)], object)
        yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array([str((int(a) << 32) + int(b)) for a, b in part.T])], ["i", "s"])

    sums = distinct.mapInArrow(sums_of, "i int, s string").groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).orderBy("i").collect()
    sums = np.array([int(r["s"]) for r in sums], object)
    centre = np.array([float(s) / n for s in sums])
    trace = float(total(distinct, lambda x: ((x - centre) ** 2).sum(axis=0)[:, None], d, 1).sum()) / n
    q, e, passes = leading(lambda q: centred_product(distinct, centre, q) / n, d, min(k, d))
    q = q * np.where(q[np.abs(q).argmax(axis=0), np.arange(q.shape[1])] < 0, -1, 1)
    e = np.where(e > 1e-12 * trace, e, 0)
    live = e > 0
    error = None
    if live.any():
        scale = q[:, live] / np.sqrt(e[live])

        def whitened(x: np.ndarray) -> np.ndarray:
            w = (x - centre) @ scale
            return np.hstack([w.T @ w, w.sum(axis=0)[:, None]])

        found = total(distinct, whitened, d, int(live.sum()) + 1) / n
        error = float(np.abs(found[:, :-1] - np.outer(found[:, -1], found[:, -1]) - np.eye(int(live.sum()))).max())
    return Model(n, sums, q, e, trace, error, passes)


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> list[int | None]:
    """Exact sums of squares of n x - S; None where they exceed a long."""
    near = np.square(x * float(n) - sums.astype(float)).sum(axis=1)
    small = near < 2.0**62
    out: list[int | None] = [None] * len(x)
    if small.any() and max(map(abs, sums)) < 1 << 62:
        gaps = x[small] * np.int64(n) - sums.astype(np.int64)
        for i, v in zip(np.flatnonzero(small), np.square(gaps).sum(axis=1), strict=True):
            out[i] = int(v)
    for i in [i for i, v in enumerate(out) if v is None and near[i] < 2.0**64]:
        exact = sum((n * int(a) - int(s)) ** 2 for a, s in zip(x[i], sums, strict=True))
        out[i] = exact if exact < 1 << 63 else None
    return out


def whiten(embeddings: DataFrame, k: int = COMPONENTS) -> DataFrame:
    """Each remaining row on each of the k leading components, fitted on all distinct vectors."""
    small_batches(embeddings.sparkSession)
    rows = whole_numbers(embeddings)
    kind = embeddings.schema["vec_id"].dataType.simpleString()
    model = fit(rows, k)
    out = OUT.format(id=kind)
    if model is None:
        return rows.sparkSession.createDataFrame([], out)
    n, sums, q, e, trace, error, _ = model
    d, k = q.shape
    centre = np.array([float(s) / n for s in sums])
    with np.errstate(divide="ignore", invalid="ignore"):
        scale = np.where(e > 0, q / np.sqrt(e), np.nan)
    explained = [float(v / trace) if trace > 0 else None for v in e]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = matrix(b.column(1), d)
            w = (x - centre) @ scale
            m = len(x)
            at = np.repeat(np.arange(m), k)
            yield pa.RecordBatch.from_arrays([
                b.column(0).take(pa.array(at)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)),
                pa.array(deviations(x, n, sums), pa.int64()).take(pa.array(at)), pa.array(w.ravel(), mask=np.isnan(w.ravel())), pa.array(explained * m, pa.float64()), pa.array([error] * (m * k), pa.float64()),
            ], ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, out)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
