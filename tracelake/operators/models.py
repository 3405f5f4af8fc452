"""Templates, forecasts and dose-response summaries over traces and groups.

Null samples are left out of fits and means; groups without enough of them have null
results or no row; equal fits are settled by the smallest parameters. Empty tables give
empty tables.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracelake.operators import align, designs, filters, kernels, stats


def autoregression(df: DataFrame, keys: list[str], value: str, train_until: int, *, frame: str = "frame") -> DataFrame:
    """(keys, phi, mean): first-order coefficient of each trace about its mean, over frames before ``train_until``."""
    d = df.filter(F.col(frame) < train_until)
    mean = d.groupBy(*keys).agg(F.avg(value).alias("mean"))
    run = W.partitionBy(*keys).orderBy(frame)
    e = d.join(mean, keys).withColumn("__e", F.col(value) - F.col("mean")).withColumn("__p", F.lag("__e").over(run)).filter("__p is not null")
    return e.groupBy(*keys).agg((F.sum(F.col("__e") * F.col("__p")) / F.sum(F.col("__p") * F.col("__p"))).alias("phi"), F.first("mean").alias("mean"))


def forecast(df: DataFrame, keys: list[str], value: str, train_until: int, *, frame: str = "frame") -> DataFrame:
    """(keys, frame, value, predicted) from ``train_until`` on: the last trained value decays to the mean by powers of phi."""
    model = autoregression(df, keys, value, train_until, frame=frame)
    last = df.filter(F.col(frame) == train_until - 1).select(*keys, F.col(value).alias("__last"))
    ahead = F.col(frame) - (train_until - 1)
    predicted = F.col("mean") + F.pow("phi", ahead) * (F.col("__last") - F.col("mean"))
    return df.filter(F.col(frame) >= train_until).join(model, keys).join(last, keys).select(*keys, frame, value, predicted.alias("predicted"))


def pulse_template(frame: Column, start: int, width: int, amplitude: float, level: float) -> Column:
    return F.when((frame >= start) & (frame < start + width), amplitude + level).otherwise(F.lit(float(level)))


def fit_pulse(df: DataFrame, keys: list[str], value: str, starts: range, widths: range, *, frame: str = "frame") -> DataFrame:
    """(keys, start, width, amplitude, level, sse): the rectangular pulse of least squared error on a grid of starts and widths.

    For each candidate the best level and amplitude are the means outside and inside, so the
    error follows from four sums; those of all candidates of a trace are one matrix product.
    Equal errors (to ten digits) are settled by the earlier start, then the smaller width.
    """
    grid = np.array([(s, w) for s in starts for w in widths])
    names = ("start", "width", "amplitude", "level", "sse")

    def kernel(y: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
        inside = ((at >= grid[:, :1]) & (at < grid[:, :1] + grid[:, 1:])).astype(float)
        n1, s1 = inside.sum(1), inside @ y
        n0, s0 = len(y) - n1, y.sum() - s1
        with np.errstate(divide="ignore", invalid="ignore"):
            sse = np.where((n1 > 0) & (n0 > 0), (y * y).sum() - s1 * s1 / n1 - s0 * s0 / n0, np.inf)
        k = int(np.argmin(np.round(sse, 10)))
        if not np.isfinite(sse[k]):
            return {c: np.zeros(0, np.int32 if c in ("start", "width") else float) for c in names}
        found = (grid[k, 0], grid[k, 1], s1[k] / n1[k] - s0[k] / n0[k], s0[k] / n0[k], sse[k])
        return {c: np.array([v], np.int32 if c in ("start", "width") else float) for c, v in zip(names, found, strict=True)}

    return kernels.per_trace(df, keys, value, kernel, {c: "int" if c in ("start", "width") else "double" for c in names}, frame=frame)


def match_template(df: DataFrame, template: list[float], keys: list[str], value: str, max_shift: int, *, frame: str = "frame") -> DataFrame:
    """(keys, shift, corr): the shift of the template that correlates most with the trace, the smallest of several."""
    return designs.match_stretched(df, template, keys, value, max_shift, [1.0], frame=frame).drop("stretch")


def curve_by_line(df: DataFrame, line: str, x: str, value: str, grid: DataFrame) -> DataFrame:
    """(line, x, y): each line's mean curve on the points of ``grid`` (x), linear between means."""
    means = df.groupBy(line, x).agg(F.avg(value).alias(value))
    points = means.select(line).distinct().crossJoin(F.broadcast(grid.select(x)))
    return align.interpolate_at(means, points, [line], x, value)


def net_effect(curves: DataFrame, x: str, value: str, line: str, signs: dict[str, float]) -> DataFrame:
    """(x, net): the signed sum of the lines' curves."""
    sign = F.create_map(*[k for name, s in signs.items() for k in (F.lit(name), F.lit(float(s)))])[F.col(line)]
    return curves.groupBy(x).agg(F.sum(sign * F.col(value)).alias("net"))


def effect_intervals(net: DataFrame, x: str) -> DataFrame:
    """(start, end, sign) of the net effect along a plan-sized grid."""
    return filters.sign_intervals(net.withColumn("__all", F.lit(0)), "net", x, ["__all"]).drop("__all")


def sweep_prediction_error(df: DataFrame, by: list[str], x: str, value: str, reference: Column) -> DataFrame:
    """(by, error, n): mean absolute error of the other rows against the reference sweep's curve."""
    curve = df.filter(reference).groupBy(*by, x).agg(F.avg(value).alias("__y"))
    others = df.filter(~reference)
    points = others.select(*by, x).distinct()
    predicted = align.interpolate_at(curve, points, by, x, "__y")
    return others.join(predicted, [*by, x]).filter("__y is not null").groupBy(*by).agg(F.avg(F.abs(F.col(value) - F.col("__y"))).alias("error"), F.count("*").alias("n"))


def sweep_alignment_error(df: DataFrame, by: list[str], x: str, value: str, reference: Column) -> DataFrame:
    """(by, error, n): distance of the other sweeps' means from the reference sweep's curve, over their standard errors, averaged over doses.

    Doses outside the reference's range, and those of one row or without spread, have no part.
    """
    curve = df.filter(reference).groupBy(*by, x).agg(F.avg(value).alias("__y"))
    others = df.filter(~reference).groupBy(*by, x).agg(F.avg(value).alias("__m"), (F.stddev_samp(value) / F.sqrt(F.count(value))).alias("__s"))
    predicted = align.interpolate_at(curve, others.select(*by, x), by, x, "__y")
    z = F.when(F.col("__s") > 0, F.abs(F.col("__m") - F.col("__y")) / F.col("__s"))
    return others.join(predicted, [*by, x]).withColumn("__z", z).filter("__z is not null").groupBy(*by).agg(F.avg("__z").alias("error"), F.count("*").alias("n"))


def dependency(df: DataFrame, by: list[str], x: str, value: str) -> DataFrame:
    """(by, x, mean, sem, n)."""
    return df.groupBy(*by, x).agg(F.avg(value).alias("mean"), (F.stddev_samp(value) / F.sqrt(F.count(value))).alias("sem"), F.count(value).alias("n"))


def codistribution(df: DataFrame, unit: list[str], split: list[str], x: str, y: str) -> DataFrame:
    """(split, r, slope, intercept, n) over unit means."""
    means = df.groupBy(*split, *unit).agg(F.avg(x).alias("__x"), F.avg(y).alias("__y"))
    return means.groupBy(*split).agg(F.corr("__x", "__y").alias("r"), F.regr_slope("__y", "__x").alias("slope"), F.regr_intercept("__y", "__x").alias("intercept"), F.count("*").alias("n"))


def curve_band(points: DataFrame, x: str, curve: Callable[[Column, list[Column]], Column], means: list[float], deviations: list[float], draws: int, seed: int, level: float = 0.95) -> DataFrame:
    """(x, low, high): the spread of a curve whose parameters are drawn from independent normals; draws depend on the seed and their number only."""
    def normal(k: int) -> Column:
        number = lambda i: F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.lit(2 * k + i), "draw")), 1, 7), 16, 10).cast("long")
        u = [(number(i) + 0.5) / float(1 << 28) for i in range(2)]
        return F.sqrt(-2 * F.log(u[0])) * F.cos(2 * math.pi * u[1])
    wide = points.select(x).distinct().withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    y = curve(F.col(x), [m + s * normal(k) for k, (m, s) in enumerate(zip(means, deviations, strict=True))])
    tails = F.array(F.lit((1 - level) / 2), F.lit((1 + level) / 2))
    return wide.withColumn("__y", y).groupBy(x).agg(F.percentile("__y", tails).alias("q")).select(x, F.get("q", 0).alias("low"), F.get("q", 1).alias("high"))


def fit_band(points: DataFrame, x: str, slope: float, intercept: float, sd_slope: float, sd_intercept: float, draws: int, seed: int, level: float = 0.95) -> DataFrame:
    """``curve_band`` of a line."""
    return curve_band(points, x, lambda v, p: p[0] * v + p[1], [slope, intercept], [sd_slope, sd_intercept], draws, seed, level)


def cell_average(df: DataFrame, x: str, y: str, value: str, size: float) -> DataFrame:
    """(x, y, value) averaged over square cells, named by their centres."""
    cell = lambda c: (F.floor(F.col(c) / size) + 0.5) * size
    return df.groupBy(cell(x).alias(x), cell(y).alias(y)).agg(F.avg(value).alias(value))


def status_by_first_date(df: DataFrame, subject: str, date: str) -> DataFrame:
    """(subject, date, status): the first date of a subject is ``pre``, later ones ``post``."""
    days = df.select(subject, F.to_date(date).alias("day")).distinct()
    first = F.min("day").over(W.partitionBy(subject))
    return days.withColumn("status", F.when(F.col("day") == first, "pre").otherwise("post"))


def end_weights(past: int, order: int) -> np.ndarray:
    """What the ``past`` samples before a place count in the interpolating spline of ``order`` carried on to it.

    Knots are at the samples for order 1, between them for order 2 and at all but the second
    and the last but one for order 3 (no knot); order 0 repeats the last sample.
    """
    if past < max(2, order + 1) or order not in (0, 1, 2, 3):
        raise ValueError("a spline of order 0 to 3 needs more samples than its order, and two at least")
    if order == 0:
        return np.eye(past)[-1]
    x = np.arange(past, dtype=float)
    inner = {1: x[1:-1], 2: (x[1:-2] + x[2:-1]) / 2, 3: x[2:-2]}[order]
    if order == 2:
        inner = inner[: max(0, past - 3)]
    t = np.concatenate([[x[0]] * (order + 1), inner, [x[-1]] * (order + 1)])
    last = len(t) - order - 2  # the interval whose polynomials are carried on

    def basis(u: float) -> np.ndarray:
        at = last if u >= t[last] else int(np.searchsorted(t, u, "right")) - 1
        b = np.zeros(len(t) - 1)
        b[at] = 1.0
        for d in range(1, order + 1):
            b = np.array([
                ((u - t[i]) / (t[i + d] - t[i]) * b[i] if t[i + d] > t[i] else 0.0) + ((t[i + d + 1] - u) / (t[i + d + 1] - t[i + 1]) * b[i + 1] if t[i + d + 1] > t[i + 1] else 0.0)
                for i in range(len(t) - 1 - d)
            ])
        return b

    return np.linalg.solve(np.stack([basis(u) for u in x]).T, basis(float(past)))


def extrapolate(df: DataFrame, keys: list[str], value: str, frames: list[int], *, frame: str = "frame", order: int = 3, past: int = 5, fewer: bool = False) -> DataFrame:
    """(keys, frame, value) with the given frames replaced, one after another, by the spline of ``order`` through the ``past`` frames before, never below zero.

    A frame without so many frames right before it stays as it is; if ``fewer``, it is replaced
    from those that there are, one at least, by the highest order up to ``order`` that they
    allow. Replaced frames count for later ones.
    """
    wanted = sorted(set(frames))
    weights = {past: end_weights(past, order)}
    if fewer:
        weights |= {n: end_weights(n, min(order, n - 1)) if n > 1 else np.ones(1) for n in range(1, past)}

    def kernel(y: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
        y = y.copy()
        for f in wanted:
            i = int(np.searchsorted(at, f))
            if i < len(at) and at[i] == f:
                n = next((n for n in sorted(weights, reverse=True) if n <= i and at[i - n] == f - n), 0)
                if n:
                    y[i] = max(float(weights[n] @ y[i - n : i]), 0.0)
        return {frame: at, value: y}

    return kernels.per_trace(df, keys, value, kernel, {frame: dict(df.dtypes)[frame], value: "double"}, frame=frame)


def split_index(df: DataFrame, index: str, size: int, segment: str, place: str) -> DataFrame:
    """An index as (segment, place in it)."""
    return df.withColumns({segment: F.floor(F.col(index) / size).cast("int"), place: (F.col(index) % size).cast("int")})


def incomplete_segments(df: DataFrame, keys: list[str], size: int) -> DataFrame:
    """Segments that don't have ``size`` rows."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") != size)


def trigger_delay(frames: DataFrame, triggers: DataFrame, sequence: str = "sequence", index: str = "index", time: str = "time") -> DataFrame:
    """(sequence, delay): first frame's time less the trigger's."""
    first = frames.groupBy(sequence).agg(F.min_by(time, index).alias("__t"))
    return first.join(triggers.select(sequence, F.col(time).alias("__g")), sequence).select(sequence, (F.col("__t") - F.col("__g")).alias("delay"))


def inverse_distance_map(points: DataFrame, grid: DataFrame, by: list[str], x: str, y: str, value: str, power: float = 2) -> DataFrame:
    """(by, x, y, value) on ``grid`` (by, x, y): means of each place, weighted by inverse distance; a place that is on the grid keeps its mean.

    Places are few (the stimulus sites of a dataset), so each grid point meets all places of its group.
    """
    sites = points.groupBy(*by, F.col(x).alias("__x"), F.col(y).alias("__y")).agg(F.avg(value).alias("__v"))
    both = grid.join(sites, by) if by else grid.crossJoin(sites)
    d2 = F.pow(F.col(x) - F.col("__x"), F.lit(2)) + F.pow(F.col(y) - F.col("__y"), F.lit(2))
    w = 1 / F.pow(d2, F.lit(power / 2))
    far = F.sum(F.when(d2 > 0, w * F.col("__v"))) / F.sum(F.when(d2 > 0, w))
    return both.groupBy(*by, x, y).agg(F.coalesce(F.max(F.when(d2 == 0, F.col("__v"))), far).alias(value))


def average_map(df: DataFrame, dataset: str, x: str, y: str, value: str, step: float) -> DataFrame:
    """(x, y, value, n): maps of datasets, each over its largest mean, averaged on one rounded grid."""
    snap = lambda c: F.round(F.col(c) / step) * step
    cells = df.groupBy(dataset, snap(x).alias(x), snap(y).alias(y)).agg(F.avg(value).alias("__v"))
    top = cells.groupBy(dataset).agg(F.max("__v").alias("__top"))
    return cells.join(top, dataset).groupBy(x, y).agg(F.avg(F.col("__v") / F.col("__top")).alias(value), F.count("*").alias("n"))


def enriched_dependency(df: DataFrame, by: list[str], x: str, value: str) -> DataFrame:
    """``dependency`` with the one-way F over x and the slope and t of a line, by group."""
    f = stats.anova(df, by, x, value).select(*by, "f", "df_between", "df_within")
    line = stats.linear_regression(df, by, x, value).select(*by, "slope", "t")
    return dependency(df, by, x, value).join(f, by).join(line, by)
