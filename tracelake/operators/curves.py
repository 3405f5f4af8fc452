"""Curve families fitted to many groups at once, with the parameters' covariance, predictions and bands.

``df`` of a fit holds aggregated points, so a group is one curve of few points. Groups are
gathered into arrays, and all groups of an Arrow batch go through the same rounds of damped
least squares with analytic derivatives and bounds. Points with a null (or not-a-number) in
x or y are left out; a group without more points than a family has parameters isn't fitted
by it; equal fits are settled by the order of the families; empty tables give empty tables.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INF, TINY = math.inf, 1e-12
#: A damped step is tried so often; a fit has converged when a round gains less than this share of its error.
ROUNDS, GAIN = 300, 1e-13


class Family(NamedTuple):
    """``curve``: x (groups, points) and parameters (groups, n, 1) to values and their derivatives, a list by parameter."""

    size: int
    curve: Callable[[np.ndarray, list[np.ndarray]], tuple[np.ndarray, list[np.ndarray]]]
    start: Callable[[np.ndarray, np.ndarray], list[float]]
    column: Callable[[Column, Callable[[int], Column]], Column]
    bounds: Callable[[np.ndarray, np.ndarray], list[tuple[float, float]]] | None = None
    #: Values count from the least of the group's points.
    from_least: bool = False


def _logistic(u: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(u, -500, 500)))


def _sigmoid(x, p):
    x0, width, a, level = p
    w = np.abs(width) + TINY
    s = _logistic((x - x0) / w)
    bend = a * s * (1 - s) / w
    return level + a * s, [-bend, -bend * (x - x0) / w * np.sign(width), s, np.ones_like(x)]


def _plain_sigmoid(x, p):
    value, d = _sigmoid(x, [*p, np.zeros_like(p[0])])
    return value, d[:3]


def _sigmoid_decay(x, p):
    x0, k, rate, a = p
    s, fall = _logistic(k * (x - x0)), np.exp(np.clip(-rate * (x - x0), -500, 500))
    value, bend = a * s * fall, a * fall * s * (1 - s)
    return value, [rate * value - k * bend, bend * (x - x0), -(x - x0) * value, s * fall]


def _gauss(x, p):
    level, a, x0, sigma = p
    s2 = sigma * sigma + TINY / 2
    bell = np.exp(-((x - x0) ** 2) / (2 * s2))
    return level + a * bell, [np.ones_like(x), bell, a * bell * (x - x0) / s2, a * bell * (x - x0) ** 2 / s2**2 * sigma]


def _power(x, p):
    a, b = p
    x = np.maximum(x, TINY)
    y = x**b
    return a * y, [y, a * y * np.log(x)]


def _soft_threshold(x, p):
    x0, a, width, level = p
    w = np.maximum(width, 1e-9)
    u = np.clip((x - x0) / w, -700, 700)
    near = np.abs(u) < 1e-5
    e = np.exp(-np.where(near, 1.0, u))
    h = np.where(near, 1 + u / 2, u / (1 - e))
    rise = np.where(near, 0.5, (1 - e - u * e) / (1 - e) ** 2)
    return level + a * w * h, [-a * rise, w * h, a * (h - u * rise), np.ones_like(x)]


def _transient(t, p):
    a, rise, decay, level = p
    r, d = np.maximum(rise, TINY), np.maximum(decay, TINY)
    up, down = np.exp(np.clip(-t / r, -700, 700)), np.exp(np.clip(-t / d, -700, 700))
    return level + a * (down - up), [down - up, -a * up * t / r**2, a * down * t / d**2, np.ones_like(t)]


def _parabola(x, p):
    a, x1, x2 = p
    return a * (x - x1) * (x - x2), [(x - x1) * (x - x2), -a * (x - x2), -a * (x - x1)]


def _saturation(x, p):
    a, level, tau = p
    t, x = np.abs(tau) + TINY, np.maximum(x, 0)
    e = np.exp(np.clip(-x / t, -700, 700))
    return level + a * (1 - e), [1 - e, np.ones_like(x), -a * e * x / t**2 * np.sign(tau)]


def _decay(x, p):
    a, level, tau = p
    t = np.abs(tau) + TINY
    e = np.exp(np.clip(-x / t, -700, 700))
    return level + a * e, [e, np.ones_like(x), a * e * x / t**2 * np.sign(tau)]


def _threshold(x, p):
    a, level, x0 = p
    over = np.maximum(x - x0, 0)
    return level + a * over, [over, np.ones_like(x), -a * (over > 0)]


def _root(x, p):
    a, level, x0 = p
    over = np.sqrt(np.maximum(x - x0, 0))
    return level + a * over, [over, np.ones_like(x), np.where(over > 0, -a / (2 * np.maximum(over, 1e-6)), 0.0)]


def _polynomial(order: int) -> Family:
    def curve(x, p):
        d = [x ** (order - k) for k in range(order + 1)]
        return sum(c * v for c, v in zip(p, d, strict=True)), d

    def column(x: Column, p: Callable[[int], Column]) -> Column:
        out = p(0)
        for k in range(1, order + 1):
            out = out * x + p(k)
        return out

    return Family(order + 1, curve, lambda x, y: [0.0] * order + [y.mean()], column)


def _spread(x: np.ndarray) -> float:
    return float(np.ptp(x)) or 1.0


def _onset(x: np.ndarray, y: np.ndarray) -> float:
    """The last of the sorted x before y leaves its lowest twentieth."""
    return float(x[max(0, np.argmax(y > y.min() + 0.05 * np.ptp(y)) - 1)])


_up = lambda u: 1 / (1 + F.exp(-u))
#: By name; the parameters are listed with each.
FAMILIES: dict[str, Family] = {
    "linear": _polynomial(1),  # slope, level
    "origin": Family(1, lambda x, p: (p[0] * x, [x]), lambda x, y: [1.0], lambda x, p: p(0) * x),  # slope
    "poly1": _polynomial(1), "poly2": _polynomial(2), "poly3": _polynomial(3),  # highest power first
    "power": Family(2, _power, lambda x, y: [y.max() / max(x.max(), TINY), 1.0], lambda x, p: p(0) * F.pow(F.greatest(x, F.lit(TINY)), p(1))),  # factor, exponent
    "sigmoid": Family(  # middle, width, height, level
        4, _sigmoid, lambda x, y: [float(np.median(x)), _spread(x) / 8, float(np.ptp(y)), y.min()], lambda x, p: p(3) + p(2) * _up((x - p(0)) / (F.abs(p(1)) + TINY))
    ),
    "corrected_sigmoid": Family(  # middle, width, height
        3, _plain_sigmoid, lambda x, y: [x.mean(), _spread(x) / 4, y.max()], lambda x, p: p(2) * _up((x - p(0)) / (F.abs(p(1)) + TINY)), from_least=True
    ),
    "sigmoid_decay": Family(  # middle, rise rate, fall rate, height
        4, _sigmoid_decay, lambda x, y: [float(x[np.argmax(y)] - _spread(x) / 8), 8 / _spread(x), 1 / _spread(x), 1.5 * y.max()],
        lambda x, p: p(3) * _up(p(1) * (x - p(0))) * F.exp(-p(2) * (x - p(0))),
    ),
    "corrected_sigmoid_decay": Family(
        4, _sigmoid_decay, lambda x, y: [float(x[np.argmax(y)] - _spread(x) / 8), 8 / _spread(x), 1 / _spread(x), 1.5 * y.max()],
        lambda x, p: p(3) * _up(p(1) * (x - p(0))) * F.exp(-p(2) * (x - p(0))), from_least=True,
    ),
    "gauss": Family(  # level, height, middle, deviation
        4, _gauss, lambda x, y: [y.min(), float(np.ptp(y)), float(x[np.argmax(y)]), _spread(x) / 6], lambda x, p: p(0) + p(1) * F.exp(-F.pow(x - p(2), F.lit(2)) / (2 * p(3) * p(3) + TINY))
    ),
    "parabola": Family(3, _parabola, lambda x, y: [1.0, x.min(), x.max()], lambda x, p: p(0) * (x - p(1)) * (x - p(2))),  # factor, roots
    "soft_threshold": Family(  # threshold, slope, width of the corner, level
        4, _soft_threshold,
        lambda x, y: [t := float(np.interp(0.5 * y.max(), np.sort(y), x[np.argsort(y, kind="stable")])), float(np.ptp(y)) / max(x.max() - t, 1e-3 * _spread(x)), 1e-3 * _spread(x), y.min()],
        lambda x, p: p(3) + p(1) * F.when(F.abs(x - p(0)) < 1e-5 * F.greatest(p(2), F.lit(1e-9)), F.greatest(p(2), F.lit(1e-9))).otherwise((p(0) - x) / F.expm1(F.least((p(0) - x) / F.greatest(p(2), F.lit(1e-9)), F.lit(700.0)))),
        lambda x, y: [(x.min(), x.max()), (0, INF), (0, 0.01 * _spread(x)), (y.min(), y.max())],
    ),
    "biexponential": Family(  # height, rise and decay times, level
        4, _transient, lambda x, y: [1.5 * float(np.ptp(y)), t := max(float(x[np.argmax(y)]), 0.01 * _spread(x)) / 2, max(5 * t, _spread(x) / 4), y.min()],
        lambda x, p: p(3) + p(0) * (F.exp(-x / p(2)) - F.exp(-x / p(1))), lambda x, y: [(TINY, INF), (1e-6 * _spread(x), INF), (2e-6 * _spread(x), INF), (-INF, INF)],
    ),
    "saturation": Family(3, _saturation, lambda x, y: [float(np.ptp(y)), y.min(), _spread(x) / 3], lambda x, p: p(1) + p(0) * (1 - F.exp(-F.greatest(x, F.lit(0.0)) / (F.abs(p(2)) + TINY)))),  # height, level, time
    "threshold": Family(3, _threshold, lambda x, y: [float(np.ptp(y)) / _spread(x), y.min(), x.min()], lambda x, p: p(1) + p(0) * F.greatest(x - p(2), F.lit(0.0))),  # slope, level, threshold
    "root": Family(3, _root, lambda x, y: [float(np.ptp(y)) / math.sqrt(_spread(x)), y.min(), _onset(x, y)], lambda x, p: p(1) + p(0) * F.sqrt(F.greatest(x - p(2), F.lit(0.0)))),
    "decay": Family(3, _decay, lambda x, y: [float(np.ptp(y)), y.min(), _spread(x) / 3], lambda x, p: p(1) + p(0) * F.exp(-x / (F.abs(p(2)) + TINY))),  # height, level, time
}


def evaluate(kind: str, x: np.ndarray, p: np.ndarray, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Values (groups, points) and derivatives (groups, points, parameters) at ``p`` (groups, parameters)."""
    f = FAMILIES[kind]
    value, d = f.curve(x, [p[:, k : k + 1] for k in range(f.size)])
    jac = np.stack([np.broadcast_to(c, x.shape) for c in d], 2)
    if f.from_least:
        least = np.argmin(value if known is None else np.where(known, value, INF), axis=1)[:, None]
        value = value - np.take_along_axis(value, least, 1)
        jac = jac - np.take_along_axis(jac, least[:, :, None], 1)
    return value, jac


def fit_many(kind: str, xs: list[np.ndarray], ys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(parameters, covariances, r2) of one family for many groups; infinite covariances where they can't be told.

    A parameter at a bound that the error would push beyond is held there for the step.
    """
    f, g, n = FAMILIES[kind], len(xs), max(len(x) for x in xs)
    x, y, known = np.zeros((g, n)), np.zeros((g, n)), np.zeros((g, n), bool)
    for i, (a, b) in enumerate(zip(xs, ys, strict=True)):
        x[i, : len(a)], y[i, : len(a)], known[i, : len(a)] = a, b, True
        x[i, len(a) :] = a[0]
    p = np.array([f.start(a, b) for a, b in zip(xs, ys, strict=True)], float)
    limits = np.array([f.bounds(a, b) if f.bounds else [(-INF, INF)] * f.size for a, b in zip(xs, ys, strict=True)], float)
    low, high = limits[:, :, 0], limits[:, :, 1]
    p = np.clip(p, low, high)

    def state(p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        value, jac = evaluate(kind, x, p, known)
        rest = np.where(known, y - value, 0.0)
        return rest, np.where(known[:, :, None], jac, 0.0), (rest * rest).sum(1)

    with np.errstate(all="ignore"):
        rest, jac, error = state(p)
        damp, live = np.full(g, 1e-3), np.isfinite(error)
        eye = np.eye(f.size)
        for _ in range(ROUNDS):
            if not live.any():
                break
            a, slope = jac.transpose(0, 2, 1) @ jac, np.einsum("gnp,gn->gp", jac, rest)
            held = ((p <= low) & (slope < 0)) | ((p >= high) & (slope > 0))
            free = ~held[:, :, None] & ~held[:, None, :]
            size = np.maximum(np.einsum("gpp->gp", a), TINY)
            lhs = np.where(free, a, 0.0) + eye * (np.where(held, 1.0, damp[:, None] * size))[:, :, None]
            usable = np.isfinite(lhs).all((1, 2)) & np.isfinite(slope).all(1)
            move = np.zeros_like(p)
            move[usable] = np.linalg.solve(lhs[usable], np.where(held, 0.0, slope)[usable][:, :, None])[:, :, 0]
            there = np.clip(p + move, low, high)
            new_rest, new_jac, new_error = state(there)
            better = live & usable & (new_error < error)
            done = better & (error - new_error <= GAIN * error)
            p, error = np.where(better[:, None], there, p), np.where(better, new_error, error)
            rest, jac = np.where(better[:, None], new_rest, rest), np.where(better[:, None, None], new_jac, jac)
            damp = np.where(better, damp / 5, damp * 5)
            live &= usable & ~done & (damp < 1e14) & (error > 0)
        count, mean = known.sum(1), (y * known).sum(1) / known.sum(1)
        total = (np.where(known, y - mean[:, None], 0.0) ** 2).sum(1)
        r2 = np.where(total > 0, 1 - error / total, 0.0)
        cov = np.full((g, f.size, f.size), INF)
        for i in np.flatnonzero((count > f.size) & np.isfinite(error)):
            a = jac[i].T @ jac[i]
            scale = np.sqrt(np.maximum(np.diag(a), np.finfo(float).tiny))
            a = a / np.outer(scale, scale)
            if np.isfinite(a).all() and np.linalg.cond(a) < 1e14:
                cov[i] = np.linalg.inv(a) / np.outer(scale, scale) * error[i] / (count[i] - f.size)
    return p, cov, r2


def _lists(column: pa.Array) -> list[np.ndarray]:
    ends = np.cumsum(pc.list_value_length(column).to_numpy(zero_copy_only=False))
    return np.split(column.flatten().to_numpy(zero_copy_only=False), ends[:-1]) if len(ends) else []


def fit_curves(df: DataFrame, by: list[str], x: str, y: str, kinds: list[str], r2_least: float = 0.2) -> DataFrame:
    """(by, kind, parameters, covariance, r2, n): the best of the families for each group.

    ``kind`` is null where none explains ``r2_least`` of the variance with a finite
    covariance (by rows, null without one); the best one's parameters are given all the same.
    """
    types = dict(df.dtypes)
    good = F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(F.col(x).cast("double")) & ~F.isnan(F.col(y).cast("double"))
    # a group without points keeps its row
    groups = df.groupBy(*by).agg(F.array_sort(F.collect_list(F.when(good, F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))))).alias("__s"))
    rows = groups.select(*by, F.transform("__s", lambda s: s["x"]).alias("__a"), F.transform("__s", lambda s: s["y"]).alias("__b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            xs, ys = _lists(batch.column(len(by))), _lists(batch.column(len(by) + 1))
            best: list[tuple[bool, float, str | None, np.ndarray, np.ndarray | None]] = [(False, 0.0, None, np.zeros(0), None)] * len(xs)
            for kind in kinds:
                at = [i for i, a in enumerate(xs) if len(a) >= max(2, FAMILIES[kind].size)]
                if not at:
                    continue
                for i, p, cov, r2 in zip(at, *fit_many(kind, [xs[i] for i in at], [ys[i] for i in at]), strict=True):
                    told = bool(np.isfinite(cov).all())
                    if np.isfinite(p).all() and (best[i][2] is None or (told, r2) > best[i][:2]):
                        best[i] = told, float(r2), kind, p, cov if told else None
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in range(len(by))),
                 pa.array([k if told and r2 >= r2_least else None for told, r2, k, _, _ in best], pa.string()), pa.array([b[3].tolist() for b in best], pa.list_(pa.float64())),
                 pa.array([None if b[4] is None else b[4].ravel().tolist() for b in best], pa.list_(pa.float64())), pa.array([b[1] for b in best], pa.float64()), pa.array([len(a) for a in xs], pa.int64())],
                names=[*by, "kind", "parameters", "covariance", "r2", "n"],
            )

    schema = ", ".join([f"`{k}` {types[k]}" for k in by] + ["kind string, parameters array<double>, covariance array<double>, r2 double, n long"])
    return rows.mapInArrow(run, schema)


def parameter_errors(size: Column, covariance: Column) -> Column:
    """Standard errors of the parameters: roots of the covariance's diagonal."""
    return F.transform(F.sequence(F.lit(0), size - 1), lambda k: F.sqrt(F.get(covariance, k * (size + 1))))


def predict_curves(df: DataFrame, fits: DataFrame, by: list[str], x: str) -> DataFrame:
    """``df`` with ``predicted`` by the fitted curve of its group; null without one."""
    v, p = F.col(x).cast("double"), lambda i: F.get("parameters", i)
    value, corrected = None, [k for k, f in FAMILIES.items() if f.from_least]
    for name, f in FAMILIES.items():
        hit = F.col("kind") == name
        value = F.when(hit, f.column(v, p)) if value is None else value.when(hit, f.column(v, p))
    out = df.join(fits.select(*by, "kind", "parameters"), by, "left").withColumn("predicted", value)
    least = out.filter(F.col("kind").isin(corrected)).groupBy(*by).agg(F.min("predicted").alias("__least"))
    out = out.join(least, by, "left").withColumn("predicted", F.col("predicted") - F.coalesce("__least", F.lit(0.0)))
    return out.drop("kind", "parameters", "__least")


def normal_draws(count: int, size: int, seed: int) -> np.ndarray:
    """(count, size) standard normal numbers that depend on the seed and their places only."""

    def uniform(i: int, draw: int) -> float:
        return (int(hashlib.md5(f"{seed}|{i}|{draw}".encode()).hexdigest()[:7], 16) + 0.5) / (1 << 28)

    u = np.array([[[uniform(2 * k + i, draw) for i in range(2)] for k in range(size)] for draw in range(1, count + 1)]).reshape(count, size, 2)
    return np.sqrt(-2 * np.log(u[:, :, 0])) * np.cos(2 * np.pi * u[:, :, 1])


def curve_bands(points: DataFrame, fits: DataFrame, by: list[str], x: str, *, draws: int = 1000, seed: int = 0, level: float = 0.95, most_error: float = 5.0) -> DataFrame:
    """(by, x, low, high) on the points' x: the spread of each group's curve over parameters drawn about its fit.

    Parameters are drawn independently with their standard errors. Groups without a fit, or
    with a parameter whose error is above ``most_error`` of its size, or whose curve isn't
    finite for a draw, have null bands.
    """
    types = dict(points.dtypes)
    grid = points.filter(F.col(x).isNotNull()).groupBy(*by).agg(F.array_sort(F.collect_set(F.col(x).cast("double"))).alias("__x"))
    rows = grid.join(fits.select(*by, "kind", "parameters", "covariance"), by, "left").select(*by, "__x", "kind", "parameters", "covariance")
    normal = normal_draws(draws, max(f.size for f in FAMILIES.values()), seed)

    def band(at: np.ndarray, kind: str | None, p: list[float] | None, cov: list[float] | None) -> np.ndarray | None:
        if kind is None or cov is None:
            return None
        centre = np.array(p)
        errors = np.sqrt(np.diag(np.array(cov).reshape(len(p), -1)))
        with np.errstate(all="ignore"):
            if not (errors <= most_error * np.abs(centre)).all():
                return None
            drawn = centre + errors * normal[:, : len(p)]
            y = evaluate(kind, np.broadcast_to(at, (draws, len(at))), drawn)[0]
        return np.quantile(y, [(1 - level) / 2, (1 + level) / 2], axis=0) if np.isfinite(y).all() else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = len(by)
            at = [np.array(v) for v in batch.column(k).to_pylist()]
            bands = [band(a, *rest) for a, *rest in zip(at, *(batch.column(k + i).to_pylist() for i in (1, 2, 3)), strict=True)]
            index = pa.array(np.repeat(np.arange(len(at)), [len(a) for a in at]).astype(np.int64))
            ends = [np.concatenate([np.full(len(a), np.nan) if b is None else b[i] for a, b in zip(at, bands, strict=True)]) if at else np.zeros(0) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i).take(index) for i in range(k)), pa.array(np.concatenate(at) if at else np.zeros(0)), *(pa.array(e, from_pandas=True) for e in ends)], names=[*by, "__x", "low", "high"]
            )

    schema = ", ".join([f"`{c}` {types[c]}" for c in by] + ["`__x` double, low double, high double"])
    return rows.mapInArrow(run, schema).withColumnRenamed("__x", x)
