"""Regression, tests, correlation, circular statistics and binning by grouped moments.

Rows with a null in a variable of a statistic have no part in it; statistics without enough
rows, or of a constant, are null; tied values share mean ranks and bins. Empty tables give
empty tables.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def linear_regression(df: DataFrame, by: list[str], x: str, y: str, *, intercept: bool = True) -> DataFrame:
    """(by, slope, intercept, r2, t, n): least squares, through the origin without an intercept."""
    d = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    if not intercept:
        s = d.groupBy(*by).agg(F.sum(F.col(x) * F.col(y)).alias("xy"), F.sum(F.col(x) * F.col(x)).alias("xx"), F.sum(F.col(y) * F.col(y)).alias("yy"), F.count("*").alias("n"))
        slope = F.col("xy") / F.col("xx")
        rest = F.col("yy") - slope * F.col("xy")
        return s.select(*by, slope.alias("slope"), F.lit(0.0).alias("intercept"), (1 - rest / F.col("yy")).alias("r2"),
                        (slope / F.sqrt(rest / (F.col("n") - 1) / F.col("xx"))).alias("t"), "n")
    s = d.groupBy(*by).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.corr(x, y).alias("r"), F.count("*").alias("n"))
    r = F.col("r")
    return s.select(*by, "slope", "intercept", (r * r).alias("r2"), r_to_t(r, F.col("n")).alias("t"), "n")


def r_to_t(r: Column, n: Column) -> Column:
    return r * F.sqrt((n - 2) / (1 - r * r))


def t_to_r(t: Column, n: Column) -> Column:
    """The size of the correlation that has the score ``t``."""
    return F.abs(t) / F.sqrt(n - 2 + t * t)


def p_per_sample(p: Column, n: Column) -> Column:
    """The level of one of ``n`` tests for a joint level ``p``."""
    return 1 - F.pow(1 - p, 1 / n)


def z_mean_threshold(z: Column, w: Column) -> Column:
    return z / F.sqrt(w)


def response_kind(z: Column, threshold: float, *, directional: bool = False) -> Column:
    """positive, weak or negative; without a direction both tails are positive."""
    if not directional:
        return F.when(F.abs(z) > threshold, "positive").otherwise("weak")
    return F.when(z > threshold, "positive").when(z < -threshold, "negative").otherwise("weak")


_log_gamma = np.vectorize(math.lgamma, otypes=[float])


def betainc(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function by its continued fraction (modified Lentz), for whole arrays."""
    a, b, x = (np.atleast_1d(np.asarray(v, float)) for v in np.broadcast_arrays(a, b, x))
    turn = x > (a + 1) / (a + b + 2)
    p, q, y = np.where(turn, b, a), np.where(turn, a, b), np.clip(np.where(turn, 1 - x, x), 1e-300, 1)
    with np.errstate(divide="ignore"):
        front = np.exp(_log_gamma(p + q) - _log_gamma(p) - _log_gamma(q) + p * np.log(y) + q * np.log1p(-np.minimum(y, 1 - 1e-16))) / p
    f, c, d = np.ones_like(y), np.ones_like(y), np.zeros_like(y)
    for i in range(400):
        m = i // 2
        if i == 0:
            step = np.ones_like(y)
        elif i % 2 == 0:
            step = m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m))
        else:
            step = -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))
        d, c = 1 + step * d, 1 + step / c
        d, c = 1 / np.where(d == 0, 1e-300, d), np.where(c == 0, 1e-300, c)
        f = f * c * d
        if (np.abs(c * d - 1) < 1e-14).all():
            break
    tail = front * (f - 1)
    return np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, np.where(turn, 1 - tail, tail)))


def _where_known(known: np.ndarray, compute) -> pd.Series:
    """``compute(known)`` where ``known`` holds, null elsewhere."""
    out = np.full(len(known), np.nan)
    if known.any():
        out[known] = compute(known)
    return pd.Series(out).astype(object).where(known, None).astype("float64")


@F.pandas_udf(DoubleType())
def t_p_value(t: pd.Series, dof: pd.Series) -> pd.Series:
    """Two-sided p of a t statistic; null without degrees of freedom."""
    t, n = t.to_numpy(float), dof.to_numpy(float)
    return _where_known(np.isfinite(t) & (n > 0), lambda k: betainc(n[k] / 2, 0.5, n[k] / (n[k] + t[k] * t[k])))


@F.pandas_udf(DoubleType())
def f_p_value(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    """Upper tail p of an F statistic."""
    f, a, b = f.to_numpy(float), d1.to_numpy(float), d2.to_numpy(float)
    return _where_known(np.isfinite(f) & (b > 0), lambda k: betainc(b[k] / 2, a[k] / 2, b[k] / (b[k] + a[k] * f[k])))


@F.pandas_udf(DoubleType())
def p_t_value(p: pd.Series, dof: pd.Series) -> pd.Series:
    """The t statistic whose upper tail is ``p``, by bisection of the distribution."""
    p, n = p.to_numpy(float), dof.to_numpy(float)

    def solve(k: np.ndarray) -> np.ndarray:
        q = np.minimum(p[k], 1 - p[k])
        low, high = np.zeros(k.sum()), np.full(k.sum(), 1e6)
        for _ in range(100):
            t = (low + high) / 2
            above = betainc(n[k] / 2, 0.5, n[k] / (n[k] + t * t)) / 2 > q
            low, high = np.where(above, t, low), np.where(above, high, t)
        return np.where(p[k] <= 0.5, low, -low)

    return _where_known((p > 0) & (p < 1) & (n > 0), solve)


def welch(df: DataFrame, by: list[str], value: str, second: Column) -> DataFrame:
    """(by, t, dof): the rows where ``second`` holds against the others, unequal variances."""
    def moments(rows: Column, name: str) -> list[Column]:
        v = F.when(rows, F.col(value))
        return [F.avg(v).alias(f"m{name}"), F.var_samp(v).alias(f"v{name}"), F.count(v).alias(f"n{name}")]
    s = df.groupBy(*by).agg(*moments(~second, "1"), *moments(second, "2"))
    a, b = F.col("v1") / F.col("n1"), F.col("v2") / F.col("n2")
    dof = (a + b) * (a + b) / (a * a / (F.col("n1") - 1) + b * b / (F.col("n2") - 1))
    return s.select(*by, ((F.col("m2") - F.col("m1")) / F.sqrt(a + b)).alias("t"), dof.alias("dof"))


def anova(df: DataFrame, by: list[str], factor: str, value: str) -> DataFrame:
    """One-way: (by, ss_between, ss_within, df_between, df_within, f, eta2, omega2)."""
    groups = df.groupBy(*by, factor).agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.var_pop(value).alias("v"))
    run = W.partitionBy(*by)
    grand = F.sum(F.col("n") * F.col("m")).over(run) / F.sum("n").over(run)
    s = groups.withColumn("g", grand).groupBy(*by).agg(
        F.sum(F.col("n") * F.pow(F.col("m") - F.col("g"), F.lit(2))).alias("ss_between"), F.sum(F.col("n") * F.col("v")).alias("ss_within"),
        (F.count("*") - 1).alias("df_between"), (F.sum("n") - F.count("*")).alias("df_within"),
    )
    ms = F.col("ss_within") / F.col("df_within")
    total = F.col("ss_between") + F.col("ss_within")
    return s.withColumns({
        "f": F.col("ss_between") / F.col("df_between") / ms, "eta2": F.col("ss_between") / total,
        "omega2": (F.col("ss_between") - F.col("df_between") * ms) / (F.col("ss_between") + F.col("df_between") * ms + ms),
    })


#: Units a side that a task correlates at once, and samples that it holds as a matrix at once.
BLOCK_UNITS, BLOCK_SAMPLES = 256, 4096
#: A group's units are dealt to so many blocks at most, each is sent once a block; more only where a block would hold more values than this.
BLOCKS, BLOCK_VALUES = 12, 1 << 24
#: All pairs: values up to which a group is one block, blocks of a larger group, and values that a block may have; more blocks only beyond that.
SMALL_GROUP, PAIR_BLOCKS, PAIR_VALUES = 1 << 17, 3, 1 << 23


def _block_moments(one: list[tuple[np.ndarray, np.ndarray]], two: list[tuple[np.ndarray, np.ndarray]], covariance: bool) -> np.ndarray:
    """Correlations of all units of two blocks over the samples that both units of a pair have; a unit is (sample numbers, values about its mean)."""
    sums = {k: np.zeros((len(one), len(two))) for k in ("n", "x", "y", "xy", "xx", "yy")}
    last = max((int(i[-1]) for i, _ in one + two if len(i)), default=-1)
    for start in range(0, last + 1, BLOCK_SAMPLES):
        width = min(BLOCK_SAMPLES, last + 1 - start)

        def dense(units: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
            v, m = np.zeros((len(units), width)), np.zeros((len(units), width))
            for k, (at, values) in enumerate(units):
                a, b = np.searchsorted(at, [start, start + width])
                v[k, at[a:b] - start], m[k, at[a:b] - start] = values[a:b], 1.0
            return v, m

        (x, mx), (y, my) = dense(one), dense(two)
        for k, left, right in (("n", mx, my), ("x", x, my), ("y", mx, y), ("xy", x, y), ("xx", x * x, my), ("yy", mx, y * y)):
            sums[k] += left @ right.T
    n = sums["n"]
    with np.errstate(divide="ignore", invalid="ignore"):
        c = sums["xy"] - sums["x"] * sums["y"] / n
        if covariance:
            return np.where(n > 1, c / (n - 1), np.nan)
        return np.where(n > 1, c / np.sqrt((sums["xx"] - sums["x"] ** 2 / n) * (sums["yy"] - sums["y"] ** 2 / n)), np.nan)


def correlation_pairs(df: DataFrame, by: list[str], sample: list[str], unit: str, value: str, *, covariance: bool = False) -> DataFrame:
    """(by, a, b, r) over unit pairs a < b, matched on the sample keys; null values are left out, pairs without a common sample too.

    Each unit's samples are gathered once, as 64-bit hashes of their keys and as values. A large
    group's units are dealt to PAIR_BLOCKS blocks, each sent once a block, and a task gets one
    pair of blocks, whose correlations are matrix products. Blocks grow with the units up to
    PAIR_VALUES, so that what is shuffled grows with the input; a task gives its rows a part of
    BLOCK_UNITS a side at a time.
    """
    kinds, v = dict(df.dtypes), F.col(value).cast("double")
    for c in {*by, *sample, unit, value}:
        df = df.filter(F.col(c).isNotNull())
    # a value is a float and what is left of it: zeros, which compress, if the values come from floats
    near = F.when(F.abs(v) < 1e38, v).otherwise(0.0).cast("float")
    rows = df.select(*by, F.col(unit).alias("__unit"), F.xxhash64(*sample).alias("__k"), near.alias("__v"), (v - near.cast("double")).alias("__w"))
    # the lists of one aggregate have their rows in the same order
    units = rows.groupBy(*by, "__unit").agg(*[F.collect_list(c).alias(c) for c in ("__k", "__v", "__w")])
    # large groups alone, so that there are few of them for the values that they have
    large = rows.groupBy(*by).agg(F.count("*").alias("__n")).filter(F.col("__n") > SMALL_GROUP)
    large = large.select(*by, F.greatest(F.lit(PAIR_BLOCKS), F.ceil(F.col("__n") / PAIR_VALUES)).cast("int").alias("__blocks"))
    units = units.withColumn("__w", F.when(F.exists("__w", lambda w: w != 0), F.col("__w")))
    dealt = units.join(F.broadcast(large), by, "left").withColumn("__blocks", F.coalesce("__blocks", F.lit(1)))
    dealt = dealt.withColumn("__block", F.pmod(F.xxhash64("__unit"), F.col("__blocks")).cast("int"))
    dealt = dealt.withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1)))
    dealt = dealt.select(*by, F.least("__block", "__other").alias("__one"), F.greatest("__block", "__other").alias("__two"), "__block", "__unit", "__k", "__v", "__w")

    def parts(groups: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        numbers: dict[bytes, int] = {}  # of the different sets of samples
        names, lists = {}, {}
        for pdf in groups:
            key, one, two = {c: pdf[c].iloc[0] for c in by}, pdf["__one"].iloc[0], pdf["__two"].iloc[0]
            for block, own in pdf.groupby("__block"):
                names.setdefault(block, []).append(own["__unit"].to_numpy())
                for k, x, rest in zip(own["__k"], own["__v"], own["__w"], strict=True):
                    k, x = np.asarray(k, np.int64), np.asarray(x, float)
                    x = x if rest is None else x + np.asarray(rest, float)
                    order = np.lexsort((x, k))
                    lists.setdefault(block, []).append((numbers.setdefault(k[order].tobytes(), len(numbers)), x[order] - x.mean()))
        sets = [np.frombuffer(k, np.int64) for k in numbers]
        known = np.unique(np.concatenate(sets))
        sets = [np.searchsorted(known, k) for k in sets]
        for block, own in lists.items():
            names[block] = np.concatenate(names[block])
            order = np.argsort(names[block], kind="stable")
            names[block], lists[block] = names[block][order], [(sets[own[i][0]], own[i][1]) for i in order]
        if one not in names or two not in names:
            return
        for p in range(0, len(names[one]), BLOCK_UNITS):
            for q in range(p if one == two else 0, len(names[two]), BLOCK_UNITS):
                left, right = names[one][p : p + BLOCK_UNITS], names[two][q : q + BLOCK_UNITS]
                r = _block_moments(lists[one][p : p + BLOCK_UNITS], lists[two][q : q + BLOCK_UNITS], covariance)
                i, j = np.nonzero(~np.isnan(r))
                keep = left[i] < right[j] if one == two else np.ones(len(i), bool)
                x, y, r = left[i][keep], right[j][keep], r[i, j][keep]
                swap = x > y
                yield pd.DataFrame({**key, "a": np.where(swap, y, x), "b": np.where(swap, x, y), "r": r})[[*by, "a", "b", "r"]]

    parts.__annotations__ = {"groups": Iterator[pd.DataFrame], "return": Iterator[pd.DataFrame]}
    schema = ", ".join([f"`{k}` {kinds[k]}" for k in by] + [f"a {kinds[unit]}, b {kinds[unit]}, r double"])
    return dealt.groupBy(*by, "__one", "__two").applyInPandas(parts, schema)


def _unit_samples(df: DataFrame, by: list[str], sample: list[str], unit: str, value: str) -> DataFrame:
    """(by, unit, __s, __m): each unit's known samples in order as (number, value), and their mean."""
    numbers = df.select(*by, *sample).distinct().withColumn("__i", F.row_number().over(W.partitionBy(*by).orderBy(*sample)) - 1)
    known = df.filter(F.col(value).isNotNull()).join(numbers, [*by, *sample])
    ordered = F.array_sort(F.collect_list(F.struct(F.col("__i").alias("i"), F.col(value).cast("double").alias("v"))))
    return known.groupBy(*by, unit).agg(ordered.alias("__s"), F.avg(value).alias("__m"))


def quantile_bins(df: DataFrame, value: str, n: int, by: list[str]) -> DataFrame:
    """Adds ``bin`` (0 to n - 1) by right-closed intervals between quantiles of the group; null for a null."""
    edges = df.groupBy(*by).agg(F.percentile(value, F.array(*[F.lit(k / n) for k in range(1, n)])).alias("__e"))
    place = F.when(F.col(value).isNotNull(), F.size(F.filter("__e", lambda e: F.col(value) > e)))
    return df.join(edges, by).withColumn("bin", place).drop("__e")


def histogram(df: DataFrame, value: str, bins: int, by: list[str]) -> DataFrame:
    """(by, bin, n) over equal bins of the group's range; the last bin is closed."""
    # two grouped aggregates and a join of one row a group: no group is gathered in a task
    ends = df.groupBy(*by).agg(F.min(value).alias("__a"), F.max(value).alias("__b"))
    width = (F.col("__b") - F.col("__a")) / bins
    place = F.when(width == 0, 0).otherwise(F.least(F.floor((F.col(value) - F.col("__a")) / F.when(width != 0, width)), F.lit(bins - 1))).cast("int")
    return df.filter(F.col(value).isNotNull()).join(ends, by).withColumn("bin", place).groupBy(*by, "bin").agg(F.count("*").alias("n"))


def circular(df: DataFrame, by: list[str], phase: str) -> DataFrame:
    """(by, mean, r, p): mean direction, phase coherence and Rayleigh's p."""
    s = df.groupBy(*by).agg(F.avg(F.cos(phase)).alias("c"), F.avg(F.sin(phase)).alias("s"), F.count(phase).alias("n"))
    r = F.sqrt(F.col("c") * F.col("c") + F.col("s") * F.col("s"))
    n = F.col("n")
    p = F.exp(F.sqrt(1 + 4 * n + 4 * (n * n - F.pow(n * r, F.lit(2)))) - (1 + 2 * n))
    return s.select(*by, F.atan2("s", "c").alias("mean"), r.alias("r"), p.alias("p"))


def circular_linear(df: DataFrame, by: list[str], phase: str, x: str) -> DataFrame:
    """(by, rho, p): circular-linear correlation."""
    s = df.filter(F.col(phase).isNotNull() & F.col(x).isNotNull()).withColumns({"__c": F.cos(phase), "__s": F.sin(phase)}).groupBy(*by).agg(
        F.corr("__s", x).alias("a"), F.corr("__c", x).alias("b"), F.corr("__s", "__c").alias("c"), F.count("*").alias("n")
    )  # rows with a null phase or x have no part in it
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    rho = F.sqrt((a * a + b * b - 2 * a * b * c) / (1 - c * c))
    return s.select(*by, rho.alias("rho"), F.exp(-F.col("n") * rho * rho / 2).alias("p"))


def circular_circular(df: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """(by, rho): sum of products of sines about the mean directions over their root sum of squares."""
    df = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    means = df.groupBy(*by).agg(F.atan2(F.avg(F.sin(a)), F.avg(F.cos(a))).alias("__ma"), F.atan2(F.avg(F.sin(b)), F.avg(F.cos(b))).alias("__mb"))
    d = df.join(means, by).withColumns({"__x": F.sin(F.col(a) - F.col("__ma")), "__y": F.sin(F.col(b) - F.col("__mb"))})
    return d.groupBy(*by).agg((F.sum(F.col("__x") * F.col("__y")) / F.sqrt(F.sum(F.col("__x") * F.col("__x")) * F.sum(F.col("__y") * F.col("__y")))).alias("rho"))


def rescale(value: str, by: list[str], method: str = "minmax") -> Column:
    run, v = W.partitionBy(*by), F.col(value)
    if method == "minmax":
        return (v - F.min(v).over(run)) / (F.max(v).over(run) - F.min(v).over(run))
    if method == "maxabs":
        return v / F.max(F.abs(v)).over(run)
    if method == "zscore":
        return (v - F.avg(v).over(run)) / F.stddev_pop(v).over(run)
    raise ValueError(method)


def fit_quality(df: DataFrame, by: list[str], y: str, predicted: str) -> DataFrame:
    """(by, r2, relative_error, symmetric_accuracy)."""
    v, p = F.col(y), F.col(predicted)
    return df.groupBy(*by).agg(
        (1 - F.sum((v - p) * (v - p)) / (F.var_pop(v) * F.count(v))).alias("r2"), F.avg(F.abs((p - v) / v)).alias("relative_error"),
        ((F.exp(F.avg(F.abs(F.log(p / v)))) - 1)).alias("symmetric_accuracy"),
    )


def best_coefficient(df: DataFrame, by: list[str], signal: str, background: str, alphas: list[float]) -> DataFrame:
    """(by, alpha, skew): the coefficient whose corrected signal is most skewed, never negative if any is not; of equal ones the first.

    A unit's two traces are gathered once; all coefficients are tried as one matrix a unit.
    """
    kinds, tried = dict(df.dtypes), np.array(alphas, float)
    known = df.filter(F.col(signal).isNotNull() & F.col(background).isNotNull())
    pairs = known.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col(signal).cast("double").alias("s"), F.col(background).cast("double").alias("n")))).alias("__p"))
    rows = pairs.select(*by, F.col("__p").getField("s").alias("__s"), F.col("__p").getField("n").alias("__n"))

    def best(s: np.ndarray, n: np.ndarray) -> tuple[float | None, float | None]:
        f = s - tried[:, None] * n
        c = f - f.mean(1, keepdims=True)
        second = (c * c).mean(1)
        with np.errstate(divide="ignore", invalid="ignore"):
            skew = (c**3).mean(1) / second**1.5
        cost = np.where(f.min(1) < 0, 1e10, -skew)
        cost = np.where(np.isnan(cost), np.inf, cost)
        k = int(np.argmin(cost))
        return (float(tried[k]), float(skew[k])) if np.isfinite(skew[k]) else (None, None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [best(np.array(s), np.array(n)) for s, n in zip(batch.column(len(by)).to_pylist(), batch.column(len(by) + 1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(by))), *(pa.array([x[i] for x in found], pa.float64()) for i in (0, 1))], names=[*by, "alpha", "skew"])

    return rows.mapInArrow(run, ", ".join([f"`{k}` {kinds[k]}" for k in by] + ["alpha double, skew double"]))


def rank_sum(df: DataFrame, by: list[str], value: str, second: Column) -> DataFrame:
    """(by, u, n1, n2): Mann-Whitney U of the rows where ``second`` holds, ties by mean rank; nulls are left out.

    Rows are counted by distinct value first; only these counts are ranked.
    """
    known = df.filter(F.col(value).isNotNull()).withColumn("__2", second)
    counts = known.groupBy(*by, value).agg(F.count_if(~F.col("__2")).alias("a"), F.count_if("__2").alias("b"))
    before = F.sum(F.col("a") + F.col("b")).over(W.partitionBy(*by).orderBy(value).rowsBetween(W.unboundedPreceding, -1))
    rank = F.coalesce(before, F.lit(0)) + (F.col("a") + F.col("b") + 1) / 2
    s = counts.withColumn("__r", rank).groupBy(*by).agg(F.sum(F.col("b") * F.col("__r")).alias("w"), F.sum("a").alias("n1"), F.sum("b").alias("n2"))
    return s.select(*by, (F.col("w") - F.col("n2") * (F.col("n2") + 1) / 2).alias("u"), "n1", "n2")


def paired_t(df: DataFrame, by: list[str], pair: str, condition: str, values: tuple, value: str) -> DataFrame:
    """(by, t, n): paired t of the second condition against the first."""
    first, second = (F.avg(F.when(F.col(condition) == v, F.col(value))) for v in values)
    d = df.groupBy(*by, pair).agg((second - first).alias("d")).filter("d is not null")
    return d.groupBy(*by).agg((F.avg("d") / (F.stddev_samp("d") / F.sqrt(F.count("d")))).alias("t"), F.count("d").alias("n"))


def one_sample_t(df: DataFrame, by: list[str], value: str, level: float = 0.0) -> DataFrame:
    """(by, stat, dof) of the mean against ``level``."""
    s = df.groupBy(*by).agg(F.avg(value).alias("__m"), F.stddev_samp(value).alias("__s"), F.count(value).alias("__n"))
    return s.select(*by, F.try_divide(F.col("__m") - level, F.col("__s") / F.sqrt("__n")).alias("stat"), (F.col("__n") - 1).cast("double").alias("dof"))


def grouped_test(tests: DataFrame, by: list[str], threshold: float = 0.05) -> DataFrame:
    """(by, stat, p, h0) of a table of t statistics (by, stat or t, dof): the hypothesis of no effect holds where p is at least the threshold; null without a p."""
    stat = "stat" if "stat" in tests.columns else "t"
    out = tests.select(*by, F.col(stat).alias("stat"), t_p_value(F.col(stat), F.col("dof").cast("double")).alias("p"))
    return out.withColumn("h0", F.col("p") >= threshold)


def condition_pairs(df: DataFrame, by: list[str], dataset: str, condition: str, value: str, *, paired: bool = True) -> DataFrame:
    """(by, a, b, n, stat, p, corrected): every two conditions compared by dataset means, with Bonferroni's correction for the pairs of the group.

    ``paired``: over the datasets that have both, the second less the first; else with equal variances over all datasets of each.
    """
    means = df.filter(F.col(condition).isNotNull()).groupBy(*by, dataset, condition).agg(F.avg(value).alias("__m")).filter("__m is not null")
    if paired:
        other = means.select(*by, dataset, F.col(condition).alias("b"), F.col("__m").alias("__b"))
        both = means.withColumnRenamed(condition, "a").join(other, [*by, dataset]).filter("a < b")
        d = both.groupBy(*by, "a", "b").agg(F.avg(F.col("__b") - F.col("__m")).alias("__d"), F.stddev_samp(F.col("__b") - F.col("__m")).alias("__s"), F.count("*").alias("n"))
        tests = d.select(*by, "a", "b", "n", F.try_divide("__d", F.col("__s") / F.sqrt("n")).alias("stat"), (F.col("n") - 1).cast("double").alias("dof"))
    else:
        s = means.groupBy(*by, condition).agg(F.avg("__m").alias("__m"), (F.var_pop("__m") * F.count("*")).alias("__ss"), F.count("*").alias("__n"))
        other = s.select(*by, F.col(condition).alias("b"), F.col("__m").alias("__mb"), F.col("__ss").alias("__ssb"), F.col("__n").alias("__nb"))
        pairs = s.withColumnRenamed(condition, "a").crossJoin(other) if not by else s.withColumnRenamed(condition, "a").join(other, by)
        dof = (F.col("__n") + F.col("__nb") - 2).cast("double")
        error = F.sqrt(F.try_divide(F.col("__ss") + F.col("__ssb"), dof) * (1 / F.col("__n") + 1 / F.col("__nb")))
        tests = pairs.filter("a < b").select(*by, "a", "b", (F.col("__n") + F.col("__nb")).alias("n"), F.try_divide(F.col("__mb") - F.col("__m"), error).alias("stat"), dof.alias("dof"))
    p = tests.withColumn("p", t_p_value("stat", "dof"))
    # pairs of conditions, which are few
    return p.withColumn("corrected", F.least(F.col("p") * F.count("p").over(W.partitionBy(*by)), F.lit(1.0))).drop("dof")


def bimodality(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, coefficient): variance over squared mean of the normal density at each value, by the group's own moments."""
    moments = df.groupBy(*by).agg(F.avg(value).alias("__m"), F.stddev_pop(value).alias("__s"))
    z = (F.col(value) - F.col("__m")) / F.col("__s")
    density = F.exp(-z * z / 2) / (F.col("__s") * math.sqrt(2 * math.pi))
    return df.join(moments, by).withColumn("__d", density).groupBy(*by).agg((F.var_pop("__d") / F.pow(F.avg("__d"), F.lit(2))).alias("coefficient"))


def hue_pairs(df: DataFrame, x: str, hue: str) -> DataFrame:
    """(x, a, b): pairs of hues that occur at one x."""
    seen = df.select(x, hue).distinct()
    other = seen.select(x, F.col(hue).alias("b"))
    return seen.withColumnRenamed(hue, "a").join(other, x).filter("a < b")


def significance(p: Column, level: float, sign: Column | None = None) -> Column:
    """0, or the sign of the effect (1 without one) where ``p`` is below the level."""
    return F.when(p < level, F.lit(1) if sign is None else F.signum(sign).cast("int")).otherwise(0)


def mean_correlations(pairs: DataFrame, by: list[str]) -> DataFrame:
    """(by, unit, r, place): each unit's mean correlation with the others of ``pairs`` (by, a, b, r), and its place by falling mean."""
    both = pairs.select(*by, F.col("a").alias("unit"), "r").unionByName(pairs.select(*by, F.col("b").alias("unit"), "r"))
    means = both.groupBy(*by, "unit").agg(F.avg("r").alias("r"))
    return means.withColumn("place", F.row_number().over(W.partitionBy(*by).orderBy(F.desc("r"), "unit")))


#: The sets of samples of a group that most units have, whose units are correlated by sums; so many at most.
SHARED_SETS = 8


def unit_mean_correlations(df: DataFrame, by: list[str], sample: list[str], unit: str, value: str) -> DataFrame:
    """(by, unit, r, place): the ``mean_correlations`` of ``correlation_pairs``, without a row a pair.

    Over given samples, a unit's correlations with others add up to the product of its
    standardised trace and the sum of theirs, so units that have the same samples, or the same
    in common with another set, take one sum a set. This holds for SHARED_SETS sets of a group;
    each unit with other samples is compared with every unit, in pairs of blocks that give one
    row a unit. A unit with a sample that is not finite correlates with none.
    """
    units = _unit_samples(df, by, sample, unit, value).filter(F.col(unit).isNotNull() & (F.abs("__m") < float("inf")))
    # of a sample's several values the last counts, as in pairs
    units = units.withColumn("__s", F.filter("__s", lambda s, k: F.coalesce(F.get("__s", k + 1)["i"] != s["i"], F.lit(True))))
    traces = units.select(*by, F.col(unit).alias("unit"), F.transform("__s", lambda s: s["i"]).alias("__at"), F.transform("__s", lambda s: s["v"] - F.col("__m")).alias("__v"))
    usual = W.partitionBy(*by).orderBy(F.desc("__n"), "__at")
    shared = traces.groupBy(*by, "__at").agg(F.count("*").alias("__n")).withColumn("__k", F.row_number().over(usual)).filter(F.col("__k") <= SHARED_SETS).drop("__n")
    traces = traces.join(shared, [*by, "__at"], "left")
    sums = _shared_sums(traces.filter("__k is not null"), shared, by).unionByName(_other_sums(traces, by, dict(df.dtypes)[unit]))
    means = sums.groupBy(*by, "unit").agg(F.sum("r").alias("r"), F.sum("n").alias("n")).filter("n > 0").select(*by, "unit", (F.col("r") / F.col("n")).alias("r"))
    return means.withColumn("place", F.row_number().over(W.partitionBy(*by).orderBy(F.desc("r"), "unit")))


def _shared_sums(traces: DataFrame, shared: DataFrame, by: list[str]) -> DataFrame:
    """(by, unit, r, n): sum and number of each unit's correlations with the others, all of sets ``shared`` (by, __at, __k)."""
    other = shared.select(*by, F.col("__at").alias("__other"), F.col("__k").alias("__l"))
    # places of the common samples of two sets within the first: numbers that come twice in both
    own, last = F.transform("__at", lambda i, p: F.struct(i.alias("i"), p.alias("p"))), F.lit(2**31 - 1)
    merged = shared.join(other, by).withColumn("__both", F.array_sort(F.concat(own, F.transform("__other", lambda i: F.struct(i.alias("i"), last.alias("p"))))))
    common = F.filter("__both", lambda s, k: F.get("__both", k + 1)["i"] == s["i"])
    pairs = merged.select(*by, "__k", "__l", common.alias("__s")).filter(F.size("__s") > 1)
    pairs = pairs.select(*by, "__k", "__l", F.transform("__s", lambda s: s["i"]).alias("__i"), F.transform("__s", lambda s: s["p"]).alias("__p"))
    # a set's equal parts are one: __c numbers those of __k, __d those of __l
    pairs = pairs.withColumns({"__c": F.min("__l").over(W.partitionBy(*by, "__k", "__i")), "__d": F.min("__k").over(W.partitionBy(*by, "__l", "__i"))})
    parts = pairs.groupBy(*by, "__k", "__c").agg(F.min("__p").alias("__p"), F.max(F.col("__k") == F.col("__l")).cast("int").alias("__own"))
    x = F.when(F.size("__p") == F.size("__v"), F.col("__v")).otherwise(F.transform("__p", lambda p: F.get("__v", p)))
    z = traces.join(parts, [*by, "__k"]).select(*by, "unit", "__k", "__c", "__own", x.alias("__z"))
    z = z.mapInArrow(_standardised, z.schema)
    total = z.select(*by, F.col("__k").alias("__l"), F.col("__c").alias("__d"), F.posexplode("__z").alias("__p", "__z"))
    total = total.groupBy(*by, "__l", "__d", "__p").agg(F.sum("__z").alias("__t"), F.count("*").alias("__n")).join(pairs.drop("__i", "__p"), [*by, "__l", "__d"])
    total = total.groupBy(*by, "__k", "__c", "__p").agg(F.sum("__t").alias("__t"), F.sum("__n").alias("__n"))
    ordered = F.array_sort(F.collect_list(F.struct(F.col("__p").alias("p"), F.col("__t").alias("t"))))
    total = total.groupBy(*by, "__k", "__c").agg(ordered.alias("__t"), F.max("__n").alias("__n"))
    product = F.aggregate(F.zip_with("__z", "__t", lambda a, b: a * b["t"]), F.lit(0.0), lambda a, b: a + b)
    return z.join(total, [*by, "__k", "__c"]).select(*by, "unit", (product - F.col("__own")).alias("r"), (F.col("__n") - F.col("__own")).alias("n"))


def _standardised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows with ``__z`` (two values or more) about its mean and of length 1; those of a constant are left out."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        column = batch.column("__z")
        v, sizes = column.flatten().to_numpy(zero_copy_only=False), column.value_lengths().to_numpy(zero_copy_only=False)
        at = np.cumsum(sizes) - sizes
        d = v - np.repeat(np.add.reduceat(v, at) / sizes, sizes)
        length = np.sqrt(np.add.reduceat(d * d, at))
        varies = (np.maximum.reduceat(v, at) > np.minimum.reduceat(v, at)) & (length > 0)
        z = pa.ListArray.from_arrays(pa.array(np.append(at, len(v)), pa.int32()), pa.array(d / np.repeat(np.where(varies, length, 1.0), sizes)))
        k = batch.schema.get_field_index("__z")
        columns = [*batch.columns[:k], z, *batch.columns[k + 1 :]]
        yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names).filter(pa.array(varies))


def _other_sums(traces: DataFrame, by: list[str], kind: str) -> DataFrame:
    """(by, unit, r, n): sum and number of the correlations of pairs of which one unit at least has no shared set (``__k`` is null)."""
    kinds, rare = dict(traces.dtypes), F.col("__k").isNull()
    blocks = lambda n, values: F.greatest(F.least(F.ceil(n / BLOCK_UNITS), F.lit(BLOCKS)), F.ceil(values / BLOCK_VALUES)).cast("int")
    size = F.size("__v")
    numbers = traces.groupBy(*by).agg(blocks(F.count("*"), F.sum(size)).alias("__all"), blocks(F.count_if(rare), F.coalesce(F.sum(F.when(rare, size)), F.lit(0))).alias("__rare")).filter("__rare > 0")
    block = lambda n: F.pmod(F.xxhash64("unit"), F.col(n)).cast("int")
    dealt = traces.join(numbers, by).withColumns({"__one": block("__all"), "__two": block("__rare")})
    task = lambda one, two, second: F.struct(one.alias("__one"), two.alias("__two"), F.lit(second).alias("__second"))
    left = F.transform(F.sequence(F.lit(0), F.col("__rare") - 1), lambda q: task(F.col("__one"), q, False))
    right = F.transform(F.sequence(F.lit(0), F.col("__all") - 1), lambda p: task(p, F.col("__two"), True))
    dealt = dealt.select(*by, "unit", "__at", "__v", rare.alias("__is_rare"), F.explode(F.when(rare, F.concat(left, right)).otherwise(left)).alias("__t")).select("*", "__t.*").drop("__t")

    def run(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
        sides = [pdf[~pdf["__second"]], pdf[pdf["__second"]]]
        names, usual = [d["unit"].to_numpy() for d in sides], ~sides[0]["__is_rare"].to_numpy(bool)
        lists = [[(np.asarray(i, np.int64), np.asarray(v, float)) for i, v in zip(d["__at"], d["__v"], strict=True)] for d in sides]
        sums, counts = [np.zeros(len(d)) for d in sides], [np.zeros(len(d), np.int64) for d in sides]
        for p in range(0, len(names[0]), BLOCK_UNITS):
            for q in range(0, len(names[1]), BLOCK_UNITS):
                one, two = slice(p, p + BLOCK_UNITS), slice(q, q + BLOCK_UNITS)
                r = _block_moments(lists[0][one], lists[1][two], False)
                known = ~np.isnan(r) & (names[0][one, None] != names[1][None, two])
                r = np.where(known, r, 0.0)
                # pairs of two rare units come in both orders
                for side, at, axis, rows in ((0, one, 1, slice(None)), (1, two, 0, usual[one])):
                    sums[side][at] += r[rows].sum(axis)
                    counts[side][at] += known[rows].sum(axis)
        for unit, r, n in zip(names, sums, counts, strict=True):
            yield pd.DataFrame({**{c: pdf[c].iloc[0] for c in by}, "unit": unit, "r": r, "n": n})[[*by, "unit", "r", "n"]]

    def parts(groups: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from run(pd.concat(list(groups), ignore_index=True))

    parts.__annotations__ = {"groups": Iterator[pd.DataFrame], "return": Iterator[pd.DataFrame]}
    schema = ", ".join([f"`{k}` {kinds[k]}" for k in by] + [f"unit {kind}, r double, n long"])
    return dealt.groupBy(*by, "__one", "__two").applyInPandas(parts, schema)


def symmetric_accuracy(df: DataFrame, by: list[str], y: str, predicted: str, agg=F.median) -> DataFrame:
    """(by, accuracy): exp of a mean or median of the size of log ratios, less one."""
    return df.groupBy(*by).agg((F.exp(agg(F.abs(F.log(F.col(predicted) / F.col(y))))) - 1).alias("accuracy"))


def centre_cost(alpha: Column, reference: float) -> Column:
    """The distance of a coefficient from the one wanted."""
    return F.abs(alpha - reference)


def normality(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, statistic, p): Jarque-Bera's test by skewness and kurtosis."""
    s, k, n = F.skewness(value), F.kurtosis(value), F.count(value)
    j = (n / 6 * (s * s + k * k / 4)).alias("statistic")
    return df.groupBy(*by).agg(j).withColumn("p", F.exp(-F.col("statistic") / 2))


def independent_comparison(df: DataFrame, by: list[str], value: str, second: Column, level: float = 0.05) -> DataFrame:
    """(by, test, statistic, p): Welch's t where both samples look normal at ``level``, else the rank sum's normal approximation."""
    marked = df.withColumn("__2", second)
    normal = normality(marked, [*by, "__2"], value).groupBy(*by).agg((F.min("p") >= level).alias("__normal"))
    t = welch(df, by, value, second).withColumn("__pt", t_p_value("t", "dof"))
    u = rank_sum(df, by, value, second)
    n1, n2 = F.col("n1"), F.col("n2")
    z = (F.col("u") - n1 * n2 / 2) / F.sqrt(n1 * n2 * (n1 + n2 + 1) / 12)
    both = normal.join(t, by).join(u, by).withColumn("__z", z)
    p_rank = t_p_value("__z", F.lit(1e9))
    return both.select(*by, F.when(F.col("__normal"), "welch").otherwise("rank sum").alias("test"), F.when(F.col("__normal"), F.col("t")).otherwise(F.col("u")).alias("statistic"), F.when(F.col("__normal"), F.col("__pt")).otherwise(p_rank).alias("p"))
