"""Designs and fits over traces and groups: baselines, peaks, autoregression, ridge models, two-way tests, components.

Sums over rows are Spark aggregates; what is solved in Python is a matrix of a fixed, small
number of coefficients, one a group. Null samples are left out; groups without enough
samples have null results.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracelake.operators import curves, fits, kernels, signals, stats


def gaussian_weights(sigma: float) -> list[float]:
    """Normalised weights out to four standard deviations."""
    half = int(4 * sigma + 0.5)
    w = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-half, half + 1)]
    return [x / sum(w) for x in w]


def gaussian_smooth(df: DataFrame, keys: list[str], value: str, sigma: float, length: int, *, frame: str = "frame") -> DataFrame:
    """(keys, frame, value) smoothed with mirrored borders."""
    weights = gaussian_weights(sigma)
    half = len(weights) // 2
    wide = signals._mirrored(df, keys, value, half, frame, length)
    run = W.partitionBy(*keys).orderBy(frame)
    total = sum((F.lag(value, half - k).over(run) if k <= half else F.lead(value, k - half).over(run)) * w for k, w in enumerate(weights))
    return wide.withColumn("__v", total).filter(F.col(frame).between(0, length - 1)).select(*keys, frame, F.col("__v").alias(value))


def skew_to_level(skew: Column, threshold: float = 0.05, sigma: float = 1.0) -> Column:
    """The baseline quantile of a trace: it falls from 1 - ``threshold`` to ``threshold`` as the skewness rises through 0."""
    return threshold + (1 - 2 * threshold) / (1 + F.exp(skew / sigma))


def quantile_baseline(df: DataFrame, unit: list[str], run: list[str], value: str, width: int, length: int, *, q: float | None = None, sigma: float | None = None, frame: str = "frame") -> DataFrame:
    """(unit, run, frame, value): rolling quantile of each run, at ``q`` or at the quantile that the unit's skewness gives; smoothed by ``sigma`` frames if given."""
    keys = [*unit, *run]
    half = (width - 1) // 2
    wide = signals._mirrored(df, keys, value, half, frame, length)
    window = W.partitionBy(*keys).orderBy(frame).rowsBetween(-half, half)
    if q is not None:
        out = wide.withColumn("__b", F.percentile(value, F.lit(q)).over(window))
    else:
        levels = df.groupBy(*unit).agg(skew_to_level(F.skewness(value)).alias("__q"))
        sorted_values = wide.withColumn("__w", F.array_sort(F.collect_list(value).over(window))).join(levels, unit)
        at = F.col("__q") * (F.size("__w") - 1)
        low = F.floor(at).cast("int")
        a, b = F.get("__w", low), F.coalesce(F.get("__w", low + 1), F.get("__w", low))
        out = sorted_values.withColumn("__b", a + (b - a) * (at - low))
    base = out.filter(F.col(frame).between(0, length - 1)).select(*keys, frame, F.col("__b").alias(value))
    return gaussian_smooth(base, keys, value, sigma, length, frame=frame) if sigma else base


def smoothed_maximin(df: DataFrame, keys: list[str], value: str, width: int, sigma: float, length: int) -> DataFrame:
    """Rolling minimum, then rolling maximum, of the smoothed trace."""
    return signals.maximin(gaussian_smooth(df, keys, value, sigma, length), keys, value, width, length)


def response_peaks(df: DataFrame, keys: list[str], value: str, *, prominence: float = 0.0, width: float = 0.0, neighbours: int = 0, rate: float = 1.0, frame: str = "frame") -> DataFrame:
    """(keys, frame, t, value, prominence, width): the highest interior peak with the given least prominence and width.

    ``value`` is the mean over the peak and its neighbours; the width is taken at half the
    prominence, linear between samples, in seconds at ``rate``. Of equal peaks the first
    counts; a flat top counts in its middle.
    """
    def kernel(y: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
        best = None
        n, i = len(y), 1
        while i < n - 1:
            j = i
            while j < n - 1 and y[j] == y[i]:
                j += 1
            if y[i] > y[i - 1] and y[j] < y[i]:
                k = (i + j - 1) // 2
                left, right = k, k
                while left > 0 and y[left - 1] <= y[k]:
                    left -= 1
                while right < n - 1 and y[right + 1] <= y[k]:
                    right += 1
                high = y[k] - max(y[left : k + 1].min(), y[k : right + 1].min())
                level = y[k] - high / 2
                a = k
                while a > left and y[a] > level:
                    a -= 1
                b = k
                while b < right and y[b] > level:
                    b += 1
                start = a + (level - y[a]) / (y[a + 1] - y[a]) if y[a] < level else float(a)
                stop = b - (level - y[b]) / (y[b - 1] - y[b]) if y[b] < level else float(b)
                if high >= prominence and stop - start >= width and (best is None or y[k] > best[0]):
                    best = (y[k], k, high, stop - start)
            i = j
        if best is None:
            return {c: np.zeros(0, t) for c, t in ((frame, at.dtype), ("t", float), (value, float), ("prominence", float), ("width", float))}
        _, k, high, wide = best
        around = y[max(0, k - neighbours) : k + neighbours + 1].mean()
        return {frame: at[k : k + 1], "t": np.array([at[k] / rate]), value: np.array([around]), "prominence": np.array([high]), "width": np.array([wide / rate])}

    columns = {frame: dict(df.dtypes)[frame], "t": "double", value: "double", "prominence": "double", "width": "double"}
    return kernels.per_trace(df, keys, value, kernel, columns, frame=frame)


def detect_across_trials(df: DataFrame, keys: list[str], value: str, first: int, stop: int, agg, *, trial: str = "trial", frame: str = "frame") -> DataFrame:
    """(keys, trial, value): an aggregate over a half-open window of each trial."""
    return df.filter((F.col(frame) >= first) & (F.col(frame) < stop)).groupBy(*keys, trial).agg(agg(F.col(value)).alias(value))


def fourier_design(phase: Column, harmonics: int) -> list[Column]:
    """Cosines and sines of the harmonics of a phase in turns."""
    return [f(2 * math.pi * h * phase).alias(f"{n}{h}") for h in range(1, harmonics + 1) for n, f in (("c", F.cos), ("s", F.sin))]


def spline_design(x: Column, knots: list[float], degree: int = 3) -> list[Column]:
    """B-spline basis columns over the given knots, by the Cox-de Boor recursion; the last interval is closed."""
    t = [knots[0]] * degree + list(knots) + [knots[-1]] * degree
    last = max(i for i in range(len(t) - 1) if t[i] < t[i + 1])
    basis = [F.when((x >= t[i]) & ((x < t[i + 1]) | (F.lit(i == last) & (x <= t[i + 1]))) & F.lit(t[i] < t[i + 1]), 1.0).otherwise(0.0) for i in range(len(t) - 1)]
    for d in range(1, degree + 1):
        nxt = []
        for i in range(len(t) - 1 - d):
            left = (x - t[i]) / (t[i + d] - t[i]) * basis[i] if t[i + d] > t[i] else F.lit(0.0)
            right = (t[i + d + 1] - x) / (t[i + d + 1] - t[i + 1]) * basis[i + 1] if t[i + d + 1] > t[i + 1] else F.lit(0.0)
            nxt.append(left + right)
        basis = nxt
    return [b.alias(f"b{i}") for i, b in enumerate(basis)]


def ridge(df: DataFrame, by: list[str], features: list[str], value: str, penalty: float = 1e-6, *, penalize_intercept: bool = False) -> DataFrame:
    """(by, intercept, coefficients) by normal equations: their sums are one aggregate, a small matrix a group is solved."""
    d = df.filter(F.col(value).isNotNull()).withColumn("__1", F.lit(1.0))
    names = ["__1", *features]
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    sums = d.groupBy(*by).agg(*[F.sum(F.col(names[i]) * F.col(names[j])).alias(f"x{i}_{j}") for i, j in pairs], *[F.sum(F.col(n) * F.col(value)).alias(f"y{i}") for i, n in enumerate(names)])
    m = sums.select(*by, F.array(*[F.col(f"x{i}_{j}").cast("double") for i, j in pairs]).alias("__x"), F.array(*[F.col(f"y{i}").cast("double") for i in range(len(names))]).alias("__y"))

    @F.pandas_udf("array<double>")
    def solve(x: pd.Series, y: pd.Series) -> pd.Series:
        out = []
        for a, b in zip(x, y, strict=True):
            g = np.zeros((len(names), len(names)))
            for (i, j), v in zip(pairs, a, strict=True):
                g[i, j] = g[j, i] = v
            add = np.full(len(names), penalty)
            add[0] = penalty if penalize_intercept else 0.0
            out.append(np.linalg.lstsq(g + np.diag(add), np.asarray(b, float), rcond=None)[0].tolist())
        return pd.Series(out)

    s = m.withColumn("__b", solve("__x", "__y"))
    return s.select(*by, F.get("__b", 0).alias("intercept"), F.slice("__b", 2, len(features)).alias("coefficients"))


def linear_prediction(df: DataFrame, fit: DataFrame, by: list[str], features: list[str]) -> DataFrame:
    """``df`` with ``predicted`` by the coefficients of its group."""
    terms = sum((F.col(f) * F.get("coefficients", i) for i, f in enumerate(features)), F.col("intercept"))
    return df.join(fit, by).withColumn("predicted", terms).drop("intercept", "coefficients")


def autoregression(df: DataFrame, keys: list[str], value: str, order: int, train_until: int, *, frame: str = "frame") -> DataFrame:
    """(keys, intercept, coefficients): least squares of each trace on its ``order`` samples before, over frames before ``train_until``."""
    run = W.partitionBy(*keys).orderBy(frame)
    lagged = df.filter(F.col(frame) < train_until).withColumns({f"__l{k}": F.lag(value, k).over(run) for k in range(1, order + 1)}).filter(f"__l{order} is not null")
    return ridge(lagged, keys, [f"__l{k}" for k in range(1, order + 1)], value, 0.0)


def autoregressive_forecast(df: DataFrame, keys: list[str], value: str, order: int, train_until: int, length: int, *, model: DataFrame | None = None, frame: str = "frame") -> DataFrame:
    """(keys, frame, predicted) from ``train_until`` to ``length`` - 1, each sample from the ``order`` before it, measured or predicted.

    ``model`` may come from surrogates of the traces instead of the traces.
    """
    fit = autoregression(df, keys, value, order, train_until, frame=frame) if model is None else model
    tail = df.filter((F.col(frame) < train_until) & (F.col(frame) >= train_until - order)).groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct((-F.col(frame)).alias("f"), F.col(value).alias("v")))), lambda s: s["v"]).alias("__past")
    )
    def step(past: Column, _: Column) -> Column:
        new = F.col("intercept") + F.aggregate(F.zip_with(F.slice(past, 1, order), F.col("coefficients"), lambda x, c: x * c), F.lit(0.0), lambda s, x: s + x)
        return F.concat(F.array(new), past)
    ahead = F.aggregate(F.sequence(F.lit(train_until), F.lit(length - 1)), F.col("__past"), step)
    rows = fit.join(tail, keys).select(*keys, F.posexplode(F.reverse(F.slice(ahead, 1, length - train_until))).alias("__k", "predicted"))
    return rows.select(*keys, (F.col("__k") + train_until).alias(frame), "predicted")


def match_stretched(df: DataFrame, template: list[float], keys: list[str], value: str, max_shift: int, stretches: list[float], *, frame: str = "frame") -> DataFrame:
    """(keys, stretch, shift, corr): the stretched and shifted template that correlates most with the trace.

    Each trace is gathered once; its grid of stretches and shifts is one matrix product.
    Equal correlations are settled by the smaller stretch, then the smaller shift.
    """
    base = np.array(template, float)
    n = len(base)
    drawn = []
    for c in sorted(stretches):
        place = np.arange(n) / c
        y = np.interp(place, np.arange(n), base, right=np.nan)
        for s in range(-max_shift, max_shift + 1):
            moved = np.full(n, np.nan)
            moved[max(0, s) : n + min(0, s)] = y[max(0, -s) : n - max(0, s)]
            drawn.append((c, s, moved))
    table = np.stack([m for _, _, m in drawn])
    known = ~np.isnan(table)
    filled = np.where(known, table, 0.0)

    def kernel(y: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
        full, here = np.zeros(n), np.zeros(n)
        ok = (at >= 0) & (at < n)
        full[at[ok]], here[at[ok]] = y[ok], 1.0
        m = known @ here
        sx, sy, sxy = filled @ here, known @ full, filled @ full
        sxx, syy = (filled * filled) @ here, known @ (full * full)
        with np.errstate(divide="ignore", invalid="ignore"):
            r = (m * sxy - sx * sy) / np.sqrt((m * sxx - sx * sx) * (m * syy - sy * sy))
        if not np.isfinite(r).any():
            return {"stretch": np.zeros(0), "shift": np.zeros(0, np.int32), "corr": np.zeros(0)}
        r = np.where(np.isfinite(r), np.round(r, 12), -np.inf)
        k = int(np.argmax(r))
        return {"stretch": np.array([drawn[k][0]]), "shift": np.array([drawn[k][1]], np.int32), "corr": np.array([r[k]])}

    return kernels.per_trace(df, keys, value, kernel, {"stretch": "double", "shift": "int", "corr": "double"}, frame=frame)


def regression_with_p(df: DataFrame, by: list[str], x: str, y: str, *, intercept: bool = True) -> DataFrame:
    """(by, slope, intercept, r2, t, n, p)."""
    fit = stats.linear_regression(df, by, x, y, intercept=intercept)
    return fit.withColumn("p", stats.t_p_value("t", (F.col("n") - (2 if intercept else 1)).cast("double")))


def robust_regression(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """(by, slope, intercept): Huber fits of one signal on another, a group at a time, such as a unit's two traces."""
    types = dict(df.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        slope, level = kernels.huber(pdf[x].to_numpy(float), pdf[y].to_numpy(float)) if len(pdf) > 1 else (None, None)
        return pd.DataFrame({**{c: [pdf[c].iloc[0]] for c in by}, "slope": [slope], "intercept": [level]})

    known = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, x, y)
    return known.groupBy(*by).applyInPandas(run, ", ".join([f"`{k}` {types[k]}" for k in by] + ["slope double, intercept double"]))


def two_way_anova(df: DataFrame, by: list[str], a: str, b: str, value: str, *, interaction: bool = True) -> DataFrame:
    """(by, factor, ss, dof, f, p, eta2, omega2), sequential sums of squares of two factors and their interaction.

    The model without interaction is fitted on cell sums by alternating means, so unbalanced
    tables are exact too; the cells of one group are gathered, not its rows.
    """
    cells = df.filter(F.col(value).isNotNull() & F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*by, a, b).agg(
        F.count("*").alias("n"), F.avg(value).alias("m"), F.var_pop(value).alias("v")
    )
    types = dict(df.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        n, m = pdf["n"].to_numpy(float), pdf["m"].to_numpy(float)
        i, j = pd.factorize(pdf[a], sort=True)[0], pd.factorize(pdf[b], sort=True)[0]
        na, nb = i.max() + 1, j.max() + 1
        within = float((n * pdf["v"]).sum())
        design = np.zeros((len(n), na + nb - 1))
        design[np.arange(len(n)), i] = 1
        design[j > 0, na + j[j > 0] - 1] = 1
        root = np.sqrt(n)

        def explained(x: np.ndarray) -> tuple[float, int]:
            fit, *_ = np.linalg.lstsq(x * root[:, None], m * root, rcond=None)
            return float((n * (m - x @ fit) ** 2).sum()), int(np.linalg.matrix_rank(x))

        grand = float((n * (m - (n * m).sum() / n.sum()) ** 2).sum())
        only_a, rank_a = explained(design[:, :na])
        both, rank_ab = explained(design)
        rows = [(a, grand - only_a, rank_a - 1), (b, only_a - both, rank_ab - rank_a)]
        if interaction:
            rows.append((f"{a}:{b}", both, len(n) - rank_ab))
            rest, dof = within, n.sum() - len(n)
        else:
            rest, dof = within + both, n.sum() - rank_ab
        ms = rest / dof if dof > 0 else np.nan
        total = sum(ss for _, ss, _ in rows) + rest
        out = []
        for name, ss, d in rows:
            f = ss / d / ms if d > 0 and ms > 0 else np.nan
            p = float(stats.betainc(dof / 2, d / 2, dof / (dof + d * f))[0]) if np.isfinite(f) else np.nan
            out.append((name, ss, d, f, p, ss / total if total else np.nan, (ss - d * ms) / (ss + d * ms + ms)))
        out.append(("residual", rest, int(dof), np.nan, np.nan, np.nan, np.nan))
        return pd.DataFrame([(*(pdf[c].iloc[0] for c in by), *r) for r in out], columns=[*by, "factor", "ss", "dof", "f", "p", "eta2", "omega2"])

    schema = ", ".join([f"`{k}` {types[k]}" for k in by] + ["factor string, ss double, dof long, f double, p double, eta2 double, omega2 double"])
    return cells.groupBy(*by).applyInPandas(run, schema).select(*by, "factor", "ss", "dof", *[F.nanvl(c, F.lit(None).cast("double")).alias(c) for c in ("f", "p", "eta2", "omega2")])


def compare_halves(df: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """(by, t, dof, p, differ): the second half of each sequence against the first; an odd one out is in the second."""
    run = W.partitionBy(*by)
    ranked = df.withColumns({"__k": F.row_number().over(run.orderBy(order)) - 1, "__n": F.count("*").over(run)})
    w = stats.welch(ranked, by, value, F.col("__k") >= F.floor(F.col("__n") / 2))
    return w.withColumn("p", stats.t_p_value("t", "dof")).withColumn("differ", F.col("p") < 0.05)


def z_maximum_threshold(p: float, width: int) -> float:
    """The z that the largest of ``width`` samples passes with probability ``p``."""
    return normal_quantile(1 - (1 - (1 - p) ** (1 / width)))


def normal_quantile(q: float) -> float:
    """By bisection of the error function."""
    low, high = -40.0, 40.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if 0.5 * math.erfc(-mid / math.sqrt(2)) < q else (low, mid)
    return low


def gaussian_histogram(df: DataFrame, by: list[str], value: str, bins: int = 100) -> DataFrame:
    """(by, level, amplitude, x0, sigma, r2): a normal curve fitted to each group's histogram, which is counted by Spark."""
    ends = df.groupBy(*by).agg(F.min(value).alias("__a"), F.max(value).alias("__b"))
    counts = stats.histogram(df, value, bins, by).join(ends, by)
    width = (F.col("__b") - F.col("__a")) / bins
    grid = ends.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1)))).join(counts.select(*by, "bin", "n"), [*by, "bin"], "left")
    points = grid.select(*by, (F.col("__a") + (F.col("bin") + 0.5) * width).alias("x"), F.coalesce("n", F.lit(0)).cast("double").alias("y"))
    fit = curves.fit_curves(points, by, "x", "y", ["gauss"], -math.inf)
    names = ["level", "amplitude", "x0", "sigma"]
    return fit.select(*by, *[(F.abs(F.get("parameters", i)) if n == "sigma" else F.get("parameters", i)).alias(n) for i, n in enumerate(names)], "r2")


def ternary_classes(df: DataFrame, fit: DataFrame, by: list[str], value: str, k: float = 2) -> DataFrame:
    """``df`` with ``class``: 1 above x0 + k sigma of the fitted curve, -1 below x0 - k sigma, else 0."""
    z = (F.col(value) - F.col("x0")) / F.col("sigma")
    return df.join(fit.select(*by, "x0", "sigma"), by).withColumn("class", F.when(z > k, 1).when(z < -k, -1).otherwise(0)).drop("x0", "sigma")


def standardised(df: DataFrame, by: list[str], feature: str, value: str, *, mean: bool = True, norm: bool = True) -> DataFrame:
    """Features less their mean and over their deviation."""
    m = df.groupBy(*by, feature).agg(F.avg(value).alias("__m"), F.stddev_pop(value).alias("__s"))
    v = F.col(value) - (F.col("__m") if mean else 0.0)
    return df.join(m, [*by, feature]).withColumn(value, v / F.when(F.col("__s") > 0, F.col("__s")) if norm else v).drop("__m", "__s")


def shuffle_features(df: DataFrame, by: list[str], sample: list[str], feature: str, value: str, seed: int) -> DataFrame:
    """Each feature's values dealt anew over the samples, by a hash of keys and seed."""
    run = W.partitionBy(*by, feature)
    dealt = df.select(*by, feature, value, F.row_number().over(run.orderBy(F.md5(F.concat_ws("|", F.lit(seed), *by, feature, *sample)), *sample)).alias("__k"))
    places = df.drop(value).withColumn("__k", F.row_number().over(run.orderBy(*sample)))
    return places.join(dealt, [*by, feature, "__k"]).drop("__k")


def explained(components: DataFrame, by: list[str]) -> DataFrame:
    """(by, component, share, cumulative) of components (by, component, share, feature, loading)."""
    shares = components.groupBy(*by, "component").agg(F.max("share").alias("share"))
    return shares.withColumn("cumulative", F.sum("share").over(W.partitionBy(*by).orderBy("component")))


def project(df: DataFrame, components: DataFrame, by: list[str], sample: list[str], feature: str, value: str) -> DataFrame:
    """(by, sample, component, score): samples times loadings."""
    loadings = components.select(*by, "component", F.col("feature").alias(feature), "loading")
    return df.join(loadings, [*by, feature]).groupBy(*by, *sample, "component").agg(F.sum(F.col(value) * F.col("loading")).alias("score"))


def bin_summary(df: DataFrame, value: str, n: int, by: list[str], agg=F.median) -> DataFrame:
    """(by, bin, interval, level, n): quantile bins with their interval of quantiles and an aggregate of their values."""
    binned = stats.quantile_bins(df, value, n, by).filter("bin is not null")
    text = F.format_string("%.2f-%.2f", F.col("bin") / n, (F.col("bin") + 1) / n)
    return binned.groupBy(*by, "bin").agg(agg(F.col(value)).alias("level"), F.count("*").alias("n")).withColumn("interval", text)


def response_code(kinds: dict[str, Column], joiner: str = ", ") -> Column:
    """The effects (1, 0, -1) of all inputs as ``name+``, ``nameo`` and ``name-``, joined."""
    return F.concat_ws(joiner, *[F.concat(F.lit(n), F.when(k > 0, "+").when(k < 0, "-").otherwise("o")) for n, k in kinds.items()])


def circular_correlation_p(df: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """(by, rho, p): correlation of two phases with its two-sided normal p."""
    rho = stats.circular_circular(df, by, a, b)
    known = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    means = known.groupBy(*by).agg(F.atan2(F.avg(F.sin(a)), F.avg(F.cos(a))).alias("__a"), F.atan2(F.avg(F.sin(b)), F.avg(F.cos(b))).alias("__b"))
    x, y = F.pow(F.sin(F.col(a) - F.col("__a")), F.lit(2)), F.pow(F.sin(F.col(b) - F.col("__b")), F.lit(2))
    m = known.join(means, by).groupBy(*by).agg(F.count("*").alias("n"), F.avg(x).alias("l20"), F.avg(y).alias("l02"), F.avg(x * y).alias("l22"))
    ts = F.sqrt(F.col("n") * F.col("l20") * F.col("l02") / F.col("l22")) * F.col("rho")

    return rho.join(m, by).select(*by, "rho", fits.normal_p_value(ts).alias("p"))


def complex_exponential(x: Column) -> Column:
    return F.struct(F.cos(x).alias("re"), F.sin(x).alias("im"))

