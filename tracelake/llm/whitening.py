"""Whitening of embeddings by the leading principal components of their covariance.

Entries are put on an integer grid, so that counts and sums are exact, and the distinct
grid vectors are the fit list. Spark sums its centred products by tasks and then by matrix
rows; the driver holds nothing but the matrix, dim x dim. That is brought to tridiagonal
form by Householder reflections; bisection on Sturm counts gives the leading eigenvalues,
inverse iteration, with reorthogonalisation inside clusters of close ones, their vectors,
and the reflections carry these back. The components, at most ``components`` x dim doubles,
are broadcast and all vectors projected on them.

Vectors of each length are a fit of their own (lengths are few; their models are held
together). Defined results: rows whose vector is null, empty, or has an entry that is null,
not finite or of magnitude 2^56 or more (which has no grid value) are left out; repeated
vectors count once in the fit and are all returned; a component without variance (as all
are where one distinct vector is there) has null for ``whitened``, and takes no part in
``identity_error``; eigenvectors of equal eigenvalues are any orthonormal ones; null and
repeated ids are kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import map_slices, materialize, quoted

#: Grid steps a unit, and the grid value of zero.
GRID, ZERO = 64, 1_000_000
COMPONENTS = 16
#: Partial sums of a matrix row go through so many groups before they meet.
FAN_IN = 64
#: Eigenvalues closer than this share of the largest are a cluster; components below this share have no variance.
CLUSTER, NO_VARIANCE = 1e-3, 1e-13


class Whitener(NamedTuple):
    """``sums`` are exact; ``rows`` (components x dim) take centred grid vectors to whitened ones."""

    n: int
    sums: list[int]
    rows: np.ndarray
    eigenvalues: np.ndarray
    trace: float


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, off-diagonal and unit Householder vectors (by column) of a symmetric matrix with entries of order 1."""
    a, n = np.array(a, np.float64), len(a)
    mirrors = []
    for k in range(n - 2):
        v = a[k + 1 :, k].copy()
        if np.abs(v[1:]).max() < 1e-290:  # beside entries of order 1 this is none
            mirrors.append(np.zeros(n - k - 1))
            continue
        v /= np.abs(v).max()
        v[0] += math.copysign(np.linalg.norm(v), v[0])
        v /= np.linalg.norm(v)
        rest = a[k + 1 :, k + 1 :]
        p = rest @ v
        p -= v * (v @ p)
        rest -= 2 * (np.outer(v, p) + np.outer(p, v))
        a[k + 1 :, k] -= 2 * v * (v @ a[k + 1 :, k])
        mirrors.append(v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), mirrors


def sturm_counts(d: np.ndarray, e: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many eigenvalues of the tridiagonal matrix lie below each of ``at``."""
    tiny = np.finfo(np.float64).tiny / np.finfo(np.float64).eps
    q, below = np.ones_like(at), np.zeros(len(at), np.int64)
    for i in range(len(d)):
        q = d[i] - at - (e[i - 1] ** 2 / q if i else 0.0)
        q = np.where(np.abs(q) < tiny, -tiny, q)
        below += q < 0
    return below


def leading_eigenvalues(d: np.ndarray, e: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` largest eigenvalues, falling, by bisection down to neighbouring doubles or the matrix's rounding."""
    reach = np.abs(d) + np.abs(np.concatenate([e, [0.0]])) + np.abs(np.concatenate([[0.0], e]))
    size = reach.max()
    low, high = np.full(k, -size * 1.01), np.full(k, size * 1.01)
    wanted = len(d) - np.arange(k)  # the j-th largest has so many at or below it
    for _ in range(200):
        mid = low + (high - low) / 2
        up = sturm_counts(d, e, mid) >= wanted
        high, low = np.where(up, mid, high), np.where(up, low, mid)
        if (high - low <= 2 * np.spacing(np.maximum(np.abs(low), np.abs(high)))).all() or size == 0:
            break
    return low + (high - low) / 2


def _solver(d: np.ndarray, e: np.ndarray, shift: float) -> Callable[[np.ndarray], np.ndarray]:
    """Solves (T - shift) x = b by elimination with row exchanges; a zero pivot counts as the smallest step."""
    n, eps = len(d), np.finfo(np.float64).eps * max(np.abs(d).max(), np.abs(e).max(initial=0.0), np.finfo(np.float64).tiny)
    main, over, over2, ops = d - shift, np.append(e, 0.0), np.zeros(n), []
    for i in range(n - 1):
        low, low_main, low_over = e[i], main[i + 1], over[i + 1] if i + 1 < n - 1 else 0.0
        if abs(low) > abs(main[i]):
            f = main[i] / low
            ops.append((True, f))
            main[i], next_main, next_over = low, over[i] - f * low_main, -f * low_over
            over[i], over2[i] = low_main, low_over
            main[i + 1] = next_main
            over[i + 1] = next_over
        else:
            f = low / (main[i] if main[i] else eps)
            ops.append((False, f))
            main[i + 1] = low_main - f * over[i]
    pivots = np.where(np.abs(main) < eps, eps, main)

    def solve(b: np.ndarray) -> np.ndarray:
        x = b.copy()
        for i, (swapped, f) in enumerate(ops):
            if swapped:
                x[i], x[i + 1] = x[i + 1], x[i]
            x[i + 1] -= f * x[i]
        for i in range(n - 1, -1, -1):
            x[i] -= (over[i] * x[i + 1] if i + 1 < n else 0.0) + (over2[i] * x[i + 2] if i + 2 < n else 0.0)
            x[i] /= pivots[i]
        return x

    return solve


def eigenvectors(d: np.ndarray, e: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors (rows) of the tridiagonal matrix by inverse iteration from seeded starts."""
    out, rng = np.zeros((len(values), len(d))), np.random.default_rng(1)
    size = np.abs(values).max(initial=0.0)
    cluster, shift = 0, math.inf
    for j, value in enumerate(values):
        if j and values[j - 1] - value > CLUSTER * size:
            cluster = j
        # equal shifts would give one vector again
        shift = min(value, shift - 4 * np.finfo(np.float64).eps * size) if j > cluster else value
        solve, x = _solver(d, e, shift), rng.standard_normal(len(d))
        for _ in range(4):
            x = solve(x / np.abs(x).max())
            for _ in range(2):
                x = x / np.abs(x).max()
                x -= out[cluster:j].T @ (out[cluster:j] @ x)
        out[j] = x / np.linalg.norm(x)
    return out


def leading_components(a: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues of a symmetric matrix, falling, and their unit eigenvectors as rows."""
    size = np.abs(a).max(initial=0.0)
    if size == 0:
        return np.zeros(k), np.eye(len(a))[:k]
    d, e, mirrors = tridiagonal(a / size)
    values = leading_eigenvalues(d, e, k)
    vectors = eigenvectors(d, e, values)
    for i in range(len(mirrors) - 1, -1, -1):
        v = mirrors[i]
        vectors[:, i + 1 :] -= 2 * np.outer(vectors[:, i + 1 :] @ v, v)
    return values * size, vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def _matrices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """By vector length: places of the usable vectors and their grid values less ZERO, as long integers."""
    lengths = np.array(pc.fill_null(pc.list_value_length(column), 0), np.int64)
    flat = np.array(pc.fill_null(pc.list_flatten(column), math.nan), np.float64)
    starts = np.cumsum(lengths) - lengths
    for dim in np.unique(lengths[lengths > 0]):
        at = np.flatnonzero(lengths == dim)
        values = flat[starts[at][:, None] + np.arange(dim)] * GRID
        usable = (np.abs(values) < 2.0**62).all(axis=1)  # false for NaN
        if usable.any():
            yield at[usable], np.floor(values[usable]).astype(np.int64)


def _pack(rows: np.ndarray) -> list[bytes]:
    """One code a vector: the narrowest integers that hold it, so that equal vectors have equal codes."""
    most = np.maximum(rows.max(axis=1), -1 - rows.min(axis=1))
    out: list[bytes] = [b""] * len(rows)
    width = np.where(most < 1 << 15, 2, np.where(most < 1 << 31, 4, 8))
    for w in np.unique(width):
        at = np.flatnonzero(width == w)
        data, size = rows[at].astype(f"<i{w}").tobytes(), int(w) * rows.shape[1]
        for k, i in enumerate(at):
            out[i] = bytes([w]) + data[k * size : (k + 1) * size]
    return out


def _unpack(codes: list[bytes]) -> Iterator[np.ndarray]:
    """Matrices of the vectors of ``codes``, one for each width and length."""
    groups: dict[tuple[int, int], list[bytes]] = {}
    for c in codes:
        groups.setdefault((c[0], len(c)), []).append(c[1:])
    for (w, _), parts in groups.items():
        yield np.frombuffer(b"".join(parts), f"<i{w}").reshape(len(parts), -1).astype(np.int64)


def fit_list(vectors: DataFrame, vector_col: str) -> DataFrame:
    """(code): each distinct grid vector once; copies are collapsed before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = [c for _, rows in _matrices(batch.column(0)) for c in set(_pack(rows))]
            yield pa.RecordBatch.from_arrays([pa.array(codes, pa.binary())], names=["code"])

    coded = map_slices(vectors.select(F.col(quoted(vector_col)).cast("array<double>").alias("vec")), run, "code binary")
    return materialize(coded.groupBy("code").agg(F.count("*")).select("code"), "fit")


def exact_sums(fit: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """By vector length: number and exact sums of the grid values of the fit list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, tuple[int, list[int]]] = {}
        for batch in batches:
            for rows in _unpack(batch.column(0).to_pylist()):
                dim = rows.shape[1]
                if np.abs(rows).max() >= (1 << 62) // len(rows):
                    rows = rows.astype(object)
                n, sums = found.get(dim, (0, [0] * dim))
                found[dim] = n + len(rows), [a + int(b) for a, b in zip(sums, rows.sum(axis=0), strict=True)]
        flat = [(dim, i, n, Decimal(s + n * ZERO)) for dim, (n, sums) in found.items() for i, s in enumerate(sums)]
        columns = zip(*flat, strict=True) if flat else [[]] * 4
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.decimal128(38, 0))
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=["dim", "i", "n", "s"])

    parts = map_slices(fit, run, "dim int, i int, n long, s decimal(38,0)")
    out: dict[int, tuple[int, list[int]]] = {}
    for r in parts.groupBy("dim", "i").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).orderBy("dim", "i").collect():
        out.setdefault(r.dim, (r.n, []))[1].append(int(r.s))
    return out


def _centred(rows: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - S/n of grid values less ZERO, each rounded once where n times the spread fits a long."""
    whole = [(s - n * ZERO) // n for s in sums]
    rest = np.array([s - n * ZERO - n * w for s, w in zip(sums, whole, strict=True)], np.int64)
    y = rows - np.array(whole, np.int64)
    if np.abs(y).max() < (1 << 61) // max(n, 1):
        return (n * y - rest) / n
    return y - rest / n


def _deviations(rows: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """Exact sums of (n x - S)^2: squares of x less the whole part of the mean, with the rest of the mean put in."""
    whole = [(s - n * ZERO) // n for s in sums]
    rest = [s - n * ZERO - n * w for s, w in zip(sums, whole, strict=True)]
    y = rows - np.array(whole, np.int64)
    most = int(np.abs(y).max())
    kind = np.int64 if most * max(most, n) * len(sums) < 1 << 62 else object
    y, r = y.astype(kind, copy=False), np.array(rest, kind)
    squares, cross, tail = (y * y).sum(axis=1), y @ r, sum(x * x for x in rest)
    return [n * n * int(a) - 2 * n * int(b) + tail for a, b in zip(squares, cross, strict=True)]


def scatter(fit: DataFrame, centre: Callable[[np.ndarray], np.ndarray | None]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By vector length: sums and summed outer products of what ``centre`` makes of the fit list's vectors.

    A task sends its matrix row by row; rows meet in FAN_IN groups, then in one each, so no
    group gets more than a share of the tasks' rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for rows in _unpack(batch.column(0).to_pylist()):
                z = centre(rows)
                if z is not None:
                    z = np.hstack([z, np.ones((len(z), 1))])
                    found[rows.shape[1]] = found.get(rows.shape[1], 0) + z.T @ z
        part = TaskContext.get().partitionId()
        for dim, m in found.items():
            k = len(m)
            yield pa.RecordBatch.from_arrays(
                [pa.array([dim] * k, pa.int32()), pa.array(range(k), pa.int32()), pa.array([part] * k, pa.int32()), pa.array([r.tobytes() for r in m], pa.binary())],
                names=["dim", "i", "part", "sums"],
            )

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("part")
        total = np.sum([np.frombuffer(x) for x in pdf["sums"]], axis=0)
        return pdf.head(1).assign(sums=[total.tobytes()])

    schema = "dim int, i int, part int, sums binary"
    rows = map_slices(fit, run, schema)
    rows = rows.groupBy("dim", "i", F.pmod("part", F.lit(FAN_IN)).alias("fan")).applyInPandas(add, schema)
    out: dict[int, list[np.ndarray]] = {}
    for r in rows.groupBy("dim", "i").applyInPandas(add, schema).orderBy("dim", "i").collect():
        out.setdefault(r.dim, []).append(np.frombuffer(r.sums))
    return {dim: (m[-1][:-1], np.array(m)[:-1, :-1]) for dim, m in out.items()}


def fit_whitening(vectors: DataFrame, vector_col: str, components: int) -> tuple[dict[int, Whitener], dict[int, float | None]]:
    """Models by vector length, and the largest entry of each one's whitened covariance less the identity."""
    fit = fit_list(vectors, vector_col)
    sums = exact_sums(fit)
    models = {}
    for dim, (_, products) in scatter(fit, lambda rows: _centred(rows, *sums[rows.shape[1]])).items():
        n, s = sums[dim]
        values, axes = leading_components(products / n, min(components, dim))
        trace = float(np.trace(products)) / n
        varies = values > NO_VARIANCE * max(values[0], trace / dim)
        models[dim] = Whitener(n, s, np.where(varies, 1 / np.sqrt(np.where(varies, values, 1)), math.nan)[:, None] * axes, values, trace)
    errors: dict[int, float | None] = dict.fromkeys(models)
    for dim, (total, products) in scatter(fit, lambda rows: _varying(_project(rows, models[rows.shape[1]]))).items():
        mean = total / models[dim].n
        errors[dim] = float(np.abs(products / models[dim].n - np.outer(mean, mean) - np.eye(len(mean))).max())
    return models, errors


def _project(rows: np.ndarray, model: Whitener) -> np.ndarray:
    return _centred(rows, model.n, model.sums) @ model.rows.T


def _varying(z: np.ndarray) -> np.ndarray | None:
    keep = ~np.isnan(z[0])
    return z[:, keep] if keep.any() else None


def whiten(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(id, n, deviation, whitened, explained, identity_error), one row per usable vector.

    ``n``: vectors of the fit list of this length; ``deviation``: exact sum of (n x - S)^2,
    a decimal; ``whitened`` and ``explained``: arrays by component.
    """
    models, errors = fit_whitening(vectors, vector_col, components)
    id_type = vectors.select(F.col(quoted(id_col))).schema[0].dataType.simpleString()
    kept = vectors.sparkSession.sparkContext.broadcast((models, errors))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models, errors = kept.value
        for batch in batches:
            for at, rows in _matrices(batch.column(1)):
                m = models[rows.shape[1]]
                white = pa.array(np.ravel(_project(rows, m)), from_pandas=True)
                share = m.eigenvalues / m.trace if m.trace > 0 else np.full(len(m.eigenvalues), math.nan)
                k, size = len(share), len(at)
                offsets = pa.array(np.arange(size + 1, dtype=np.int32) * k)
                deviations = [d if d < 10**38 else None for d in _deviations(rows, m.n, m.sums)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(at)), pa.array([m.n] * size, pa.int64()), pa.array(deviations, pa.decimal128(38, 0)),
                     pa.ListArray.from_arrays(offsets, white), pa.ListArray.from_arrays(offsets, pa.array(np.tile(share, size), from_pandas=True)),
                     pa.array([errors[rows.shape[1]]] * size, pa.float64())],
                    names=["id", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    schema = f"id {id_type}, n long, deviation decimal(38,0), whitened array<double>, explained array<double>, identity_error double"
    rows = vectors.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(vector_col)).cast("array<double>").alias("vec"))
    return map_slices(rows, run, schema).withColumnRenamed("id", id_col)
