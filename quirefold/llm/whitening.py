"""Whitening of embeddings (operator 13).

A component of a vector, times SCALE and rounded down, is a whole number; x is the vector of these. The fit list is each
different x once. Tasks add up the fit list and then its centred products, in blocks of rows of the scatter matrix, which
are summed by lanes and then as a whole. One task makes the pivoted Cholesky factor of the scatter and turns the columns
of that triangular factor by one-sided Jacobi rotations until they are at right angles: their squared norms, divided by
n, are the eigenvalues of the covariance, the columns divided by their norms its eigenvectors. That task holds a matrix
of the size of the dimension squared, whatever the number of rows; the model that reaches the driver and the workers is
of the size of the dimension times the components kept.

Defined results: vectors that are null, or hold null or non-finite components, are dropped, and so are vectors of another
length than most have (of equal shares, the longer), as they have no place in the same space; each other row gives a row
for each component, also where ids or vectors repeat or ids are null; a component without variance has explained 0 and
no whitened value; explained is null if all x are equal; an empty table gives no rows; other columns are not read.
deviation is null where it needs more than 64 bits. A component's sign makes its largest entry positive.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

SCALE = 256
KEPT = 4
#: Cells of the scatter matrix in a row that is shuffled, at most, unless one row of the matrix has more; and first sums.
BLOCK_CELLS, LANES = 1 << 15, 64

_SCHEMA = "vec_id {0}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"


def whole_numbers(vectors: DataFrame) -> DataFrame:
    """(vec_id, x) of the sound rows of (vec_id, embedding)."""
    e = F.col("embedding")
    finite = F.forall(e, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    return vectors.where(finite & (F.size(e) > 0)).select("vec_id", F.transform(e, lambda c: F.floor(c.cast("double") * SCALE)).alias("x"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, dim)


def _exact(x: np.ndarray, most: int) -> np.ndarray:
    """x as it is if results up to `most` have room in 64 bits, else as Python's numbers."""
    return x if most < 1 << 62 else x.astype(object)


def _partial_sums(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(dim, object)
        for batch in batches:
            x = _matrix(batch.column(0), dim)
            if len(x):
                n += len(x)
                total = total + _exact(x, len(x) * max(abs(int(x.max())), abs(int(x.min())))).sum(axis=0)
        if n:
            sums = pa.array([Decimal(int(s)) for s in total], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([pa.array(range(dim), pa.int32()), pa.array([n] * dim, pa.int64()), sums], ["at", "n", "s"])

    return run


def _partial_scatter(dim: int, mean: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scatter, lane = np.zeros((dim, dim)), TaskContext.get().partitionId() % LANES
        for batch in batches:
            x = _matrix(batch.column(0), dim) - mean
            scatter += x.T @ x
        rows = max(1, BLOCK_CELLS // dim)
        for at in range(0, dim, rows):
            cells = pa.array([scatter[at : at + rows].tobytes()], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([lane], pa.int32()), pa.array([at], pa.int32()), cells], ["lane", "at", "cells"])

    return run


def _added(t: pa.Table) -> pa.Table:
    parts = sorted(t["cells"].to_pylist())  # in an order of their own, so that a sum is the same each time
    total = np.zeros(len(parts[0]) // 8)
    for p in parts:
        total += np.frombuffer(p)
    return pa.table({"at": t["at"].slice(0, 1), "cells": pa.array([total.tobytes()], pa.binary())})


def pivoted_cholesky(a: np.ndarray) -> np.ndarray:
    """G of rank columns with G G' = a: the triangular factor of a with its rows put back to their places. The next pivot
    is the largest entry left on the diagonal; it ends where none is above rounding."""
    dim = len(a)
    left, order, factor = np.diag(a).astype(np.float64).copy(), np.arange(dim), np.zeros((dim, dim))
    least = dim * np.finfo(float).eps * max(left.max(), 0.0)
    for k in range(dim):
        p = k + int(np.argmax(left[order[k:]]))
        if not left[order[p]] > least:
            return factor[:, :k]
        order[[k, p]] = order[[p, k]]
        pivot, rest = order[k], order[k + 1 :]
        factor[pivot, k] = np.sqrt(left[pivot])
        factor[rest, k] = (a[rest, pivot] - factor[rest, :k] @ factor[pivot, :k]) / factor[pivot, k]
        left[rest] -= factor[rest, k] ** 2
    return factor


def rotated(factor: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """The factor with its columns turned, two at a time, until all are at right angles to double precision. A round turns
    disjoint pairs, as in a tournament, so that each pair meets once a sweep."""
    g = factor.copy()
    n = g.shape[1]
    players = np.arange(n + n % 2)  # an odd one out rests
    near = np.finfo(float).eps * np.sqrt(len(g))
    for _ in range(sweeps):
        turned = False
        for _ in range(len(players) - 1):
            p, q = players[: len(players) // 2], players[::-1][: len(players) // 2]
            here = (p < n) & (q < n)
            p, q = p[here], q[here]
            x, y = g[:, p], g[:, q]
            alpha, beta, gamma = (x * x).sum(axis=0), (y * y).sum(axis=0), (x * y).sum(axis=0)
            off = np.abs(gamma) > near * np.sqrt(alpha * beta)
            if off.any():
                turned = True
                zeta = (beta[off] - alpha[off]) / (2 * gamma[off])
                t = np.where(zeta < 0, -1.0, 1.0) / (np.abs(zeta) + np.hypot(1, zeta))
                c = 1 / np.hypot(1, t)
                s = c * t
                x, y = x[:, off], y[:, off]
                g[:, p[off]], g[:, q[off]] = c * x - s * y, s * x + c * y
            players = np.concatenate((players[:1], players[-1:], players[1:-1]))
        if not turned:
            break
    return g


def _decomposed(dim: int, n: int, kept: int):
    def run(t: pa.Table) -> pa.Table:
        blocks = sorted(zip(t["at"].to_pylist(), t["cells"].to_pylist(), strict=True))
        scatter = np.frombuffer(b"".join(b for _, b in blocks)).reshape(dim, dim)
        g = rotated(pivoted_cholesky((scatter + scatter.T) / 2))
        norms = np.linalg.norm(g, axis=0)
        order = np.argsort(-norms, kind="stable")[:kept]
        vectors = (g[:, order] / norms[order]).T
        vectors *= np.sign(vectors[np.arange(len(vectors)), np.abs(vectors).argmax(axis=1)])[:, None]
        none = [None] * (min(kept, dim) - len(order))
        e = [*(norms[order] ** 2 / n).tolist(), *(0.0 for _ in none)]
        total = [float(np.trace(scatter)) / n] * len(e)
        return pa.table({"component": pa.array(range(1, len(e) + 1), pa.int32()), "eigenvalue": pa.array(e), "total": pa.array(total), "vector": pa.array([*vectors.tolist(), *none], pa.list_(pa.float64()))})

    return run


def _whitened(x: np.ndarray, mean: np.ndarray, model: list) -> list[np.ndarray | None]:
    centred = x - mean
    return [centred @ np.array(m["vector"]) / np.sqrt(m["eigenvalue"]) if m["vector"] else None for m in model]


def _projected(dim: int, mean: np.ndarray, model: list):
    """The whitened values of the fit list, a column for each component with variance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = [v for v in _whitened(_matrix(batch.column(0), dim), mean, model) if v is not None]
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in w], [f"w{k}" for k in range(len(w))])

    return run


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum of (n * x - s) ** 2 over the dimensions, exactly; None where it needs more than 64 bits."""
    reach = n * max(abs(int(x.max())), abs(int(x.min()))) + max(map(abs, sums)) if len(x) else 0
    small = reach**2 * x.shape[1] < 1 << 62
    centred = x * n - np.array(sums, np.int64) if small else x.astype(object) * n - np.array(sums, object)
    return [d if d < 1 << 63 else None for d in (centred * centred).sum(axis=1).tolist()]


def _rows(dim: int, n: int, sums: list[int], mean: np.ndarray, model: list, error: float | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1), dim)
            deviation = pa.array(deviations(x, n, sums), pa.int64())
            for m, w in zip(model, _whitened(x, mean, model), strict=True):
                every = lambda value, kind: pa.array([value] * len(x), kind)
                explained = m["eigenvalue"] / m["total"] if m["total"] else None
                values = pa.array(w) if w is not None else every(None, pa.float64())
                columns = [batch.column(0), every(m["component"], pa.int32()), every(n, pa.int64()), deviation, values, every(explained, pa.float64()), every(error, pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return run


def whiten(vectors: DataFrame, kept: int = KEPT) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for each sound row of (vec_id, embedding) and
    each of its first `kept` components."""
    spark = vectors.sparkSession
    rows = whole_numbers(vectors)
    schema = _SCHEMA.format(rows.schema["vec_id"].dataType.simpleString())
    dims = rows.groupBy(F.size("x").alias("dim")).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), F.desc("dim")).first()
    if dims is None:
        return spark.createDataFrame([], schema)
    dim = dims["dim"]
    rows = rows.where(F.size("x") == dim)
    fit = C.written(rows.select("x").distinct(), "fit")
    found = fit.mapInArrow(_partial_sums(dim), "at int, n bigint, s decimal(38,0)").groupBy("at").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).orderBy("at").collect()  # a row a dimension
    n, sums = found[0]["n"], [int(r["s"]) for r in found]
    mean = np.array([s / n for s in sums])
    blocks = fit.mapInArrow(_partial_scatter(dim, mean), "lane int, at int, cells binary")
    for keys in (["lane", "at"], ["at"]):
        blocks = blocks.groupBy(*keys).applyInArrow(_added, "at int, cells binary")
    model = blocks.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(_decomposed(dim, n, kept), "component int, eigenvalue double, total double, vector array<double>")
    model = [r.asDict() for r in C.written(model, "model").orderBy("component").collect()]  # `kept` rows at most
    columns = [f"w{k}" for k, m in enumerate(model) if m["vector"]]
    error = None
    if columns:
        w = fit.mapInArrow(_projected(dim, mean, model), ", ".join(f"{c} double" for c in columns))
        off = [F.abs(F.covar_pop(a, b) - float(a == b)) for k, a in enumerate(columns) for b in columns[k:]]
        error = w.agg(F.array_max(F.array(*off)).alias("error")).first()["error"]
    return rows.mapInArrow(_rows(dim, n, sums, mean, model, error), schema)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(C.table(spark, sf_dir, "embeddings"))
