"""Fits over groups of any size: robust regression by reweighted sums, and factor tests of three types from one Gram matrix.

No group is gathered: a round of the robust fit is two aggregates with map-side sums, and the
factor tests keep moments of cells (combinations of levels), whose number doesn't grow with
the rows. Rows with a null (or not-a-number) in a variable of a fit have no part in it;
groups without enough rows, or without spread, have null results; empty tables give empty
tables. Null keys are a group of their own.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.operators import stats

#: Huber's constant, and the median of the absolute values of a standard normal variable.
HUBER, NORMAL_MEDIAN = 1.345, 0.6744897501960817
#: The residuals' median is first bounded by a sketch off by one such part of the ranks, at this share to both sides.
SKETCH, ASIDE = 10_000, 0.005


def normal_p_value(z: Column) -> Column:
    """Two-sided p of a standard normal statistic, by the error function's series of positive terms (absolute error below 1e-14)."""
    u2 = F.least(z * z, F.lit(100.0)) / 2
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def add(s: Column, k: Column) -> Column:
        term = s["term"] * 2 * u2 / (2 * k + 1)
        return F.struct(term.alias("term"), (s["sum"] + term).alias("sum"))

    series = F.aggregate(F.sequence(F.lit(1), F.lit(300)), start, add, lambda s: s["sum"])
    return F.when(z.isNotNull(), F.greatest(1 - 2 / math.sqrt(math.pi) * F.sqrt(u2) * F.exp(-u2) * series, F.lit(0.0)))


def _same(a: DataFrame, b: DataFrame, by: list[str]) -> Column:
    """Join condition on keys that may be null."""
    out = F.lit(True)
    for k in by:
        out &= a[k].eqNullSafe(b[f"__{k}"])
    return out


def robust_fit(df: DataFrame, by: list[str], x: str, y: str, *, intercept: bool = True, rounds: int = 15, tolerance: float = 1e-6) -> DataFrame:
    """(by, slope, intercept, r2, p, n, scale, converged): Huber fits by ``rounds`` of reweighted sums.

    A round weighs by the residuals of the fit before it and by their scale of the round
    before it (median absolute residual, the lower one of two), which it measures anew. The
    median is exact: a sketch bounds it, and residuals outside the bounds count as equal to
    them, so that only the distinct ones inside are held. ``p`` is the slope's, by the normal approximation, with
    the covariance of M-estimates; ``r2`` is one less the residual over the total sum of
    squares. ``converged``: the last round moved the fit by at most ``tolerance``.
    """
    xs, ys = F.col(x).cast("double"), F.col(y).cast("double")
    d = df.filter(xs.isNotNull() & ys.isNotNull() & ~F.isnan(xs) & ~F.isnan(ys)).select(*by, xs.alias("__x"), ys.alias("__y"))
    vx, vy = F.col("__x"), F.col("__y")

    def solved(w: Column) -> list[Column]:
        """Sums of a weighted fit; centred afterwards, as a group's rows have no mean yet."""
        return [F.sum(w).alias("__w"), F.sum(w * vx).alias("__wx"), F.sum(w * vy).alias("__wy"), F.sum(w * vx * vx).alias("__wxx"), F.sum(w * vx * vy).alias("__wxy")]

    def line(s: DataFrame) -> tuple[Column, Column]:
        if not intercept:
            return F.try_divide("__wxy", "__wxx"), F.lit(0.0)
        slope = F.try_divide(F.col("__w") * F.col("__wxy") - F.col("__wx") * F.col("__wy"), F.col("__w") * F.col("__wxx") - F.col("__wx") * F.col("__wx"))
        return slope, F.try_divide(F.col("__wy") - slope * F.col("__wx"), F.col("__w"))

    def fitted(fit: DataFrame, *more: str) -> DataFrame:
        k = fit.select(*[F.col(c).alias(f"__{c}") for c in by], "__slope", "__level", "__scale", *more)
        return d.join(k, _same(d, k, by)).withColumn("__r", vy - F.col("__level") - F.col("__slope") * vx)

    slope, level = line(d)
    fit = d.groupBy(*by).agg(*solved(F.lit(1.0)), F.count("*").alias("n"))
    fit = fit.select(*by, slope.alias("__slope"), level.alias("__level"), F.lit(None).cast("double").alias("__scale"), F.lit(None).cast("double").alias("__moved"))
    size = F.abs("__r")
    weight = F.when((F.col("__scale") > 0) & (size > HUBER * F.col("__scale")), HUBER * F.col("__scale") / size).otherwise(1.0)
    for _ in range(rounds):
        ends = F.percentile_approx(size, F.array(F.lit(0.5 - ASIDE), F.lit(0.5 + ASIDE)), SKETCH)
        bounded = fitted(fit).groupBy(*by).agg(ends.alias("__ends"), *[F.first(c).alias(c) for c in ("__slope", "__level", "__scale")])
        near = fitted(bounded, "__ends").withColumn("__near", F.greatest(F.get("__ends", 0), F.least(size, F.get("__ends", 1))))
        median = F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY __near)")
        s = near.groupBy(*by).agg(*solved(weight), (median / NORMAL_MEDIAN).alias("__scale"), F.first("__slope").alias("__a"), F.first("__level").alias("__b"))
        moved = F.greatest(F.abs(slope - F.col("__a")), F.abs(level - F.col("__b")))
        fit = s.select(*by, slope.alias("__slope"), level.alias("__level"), "__scale", moved.alias("__moved"))
    last = fit.select(*[F.col(c).alias(f"__{c}") for c in by], "__slope", "__level", "__scale", "__moved")
    u = F.try_divide("__r", "__scale")
    inside = F.when(F.abs(u) <= HUBER, 1.0).otherwise(0.0)
    psi = F.least(F.greatest(u, F.lit(-HUBER)), F.lit(HUBER))
    ends = d.join(last, _same(d, last, by)).withColumn("__r", vy - F.col("__level") - F.col("__slope") * vx).groupBy(*by).agg(
        F.first("__slope").alias("slope"), F.first("__level").alias("intercept"), F.first("__scale").alias("scale"), (F.first("__moved") <= tolerance).alias("converged"),
        F.count("*").alias("n"), F.sum(F.col("__r") * F.col("__r")).alias("__rest"), (F.var_pop("__y") * F.count("*")).alias("__total"),
        F.avg(inside).alias("__m"), F.var_pop(inside).alias("__mv"), F.sum(psi * psi).alias("__psi"), (F.var_pop("__x") * F.count("*")).alias("__sxx"), F.sum(vx * vx).alias("__xx"),
    )
    p = 2 if intercept else 1
    widen = 1 + p / F.col("n") * F.try_divide("__mv", F.col("__m") * F.col("__m"))
    spread = F.col("__sxx") if intercept else F.col("__xx")
    variance = widen * widen * F.try_divide(F.col("__psi") * F.col("scale") * F.col("scale"), (F.col("n") - p) * F.col("__m") * F.col("__m")) * F.try_divide(F.lit(1.0), spread)
    z = F.when((F.col("scale") > 0) & (F.col("n") > p), F.try_divide(F.col("slope"), F.sqrt(variance)))
    return ends.select(*by, "slope", "intercept", (1 - F.try_divide("__rest", "__total")).alias("r2"), normal_p_value(z).alias("p"), "n", "scale", "converged")


# tests of factors

#: A pivot below this share of its column's sum of squares is none: the column depends on those swept in.
PIVOT = 1e-10


def swept_rest(gram: np.ndarray, columns: Iterable[int]) -> tuple[float, int]:
    """Residual sum of squares and rank of the fit on ``columns`` of a Gram matrix whose last column is the response.

    The sweep operator brings one column after another into the fit.
    """
    g, rank, start = gram.copy(), 0, np.diag(gram).copy()
    for k in columns:
        if g[k, k] <= PIVOT * max(start[k], np.finfo(float).tiny):
            continue
        pivot, row = g[k, k], g[k].copy()
        g -= np.outer(row, row) / pivot
        g[k] = row / pivot
        g[:, k] = row / pivot
        g[k, k] = -1 / pivot
        rank += 1
    return max(float(g[-1, -1]), 0.0), rank


def _coded(levels: np.ndarray, coding: str) -> np.ndarray:
    """Contrast columns of a factor by row of ``levels``: the first level is the baseline, or minus one in every column."""
    n = int(levels.max()) + 1 if len(levels) else 1
    table = np.vstack([np.zeros(n - 1), np.eye(n - 1)]) if coding == "treatment" else np.vstack([np.eye(n - 1), -np.ones(n - 1)])
    return table[levels]


def factor_tests(df: DataFrame, by: list[str], factors: dict[str, bool], value: str, *, kind: int = 1, interaction: bool = False, coding: str = "treatment") -> DataFrame:
    """(by, factor, ss, dof, f, p, eta2, omega2): one row a factor, their interaction, and the residual.

    ``factors``: one or two columns; true for levels, false for a covariate. ``kind`` 1: each
    term after those before it; 2: each after all terms that don't contain it; 3: each
    after all others under the given ``coding`` of levels (``treatment`` or ``sum``), with
    a row for the intercept. eta2 is over the sum of the table's sums of squares; omega2 is
    given for the first kind alone, whose sums add up.
    """
    if kind not in (1, 2, 3) or not 1 <= len(factors) <= 2 or coding not in ("treatment", "sum"):
        raise ValueError("kind 1, 2 or 3 of one or two factors, in treatment or sum coding")
    levelled, measured = [c for c, levels in factors.items() if levels], [c for c, levels in factors.items() if not levels]
    y = F.col(value).cast("double")
    known = y.isNotNull() & ~F.isnan(y)
    for c in factors:
        known &= F.col(c).isNotNull()
    power = lambda exponents: math.prod([F.col(c).cast("double") for c, e in zip(measured, exponents, strict=True) for _ in range(e)], start=F.lit(1.0))
    grid = lambda top: [(i, j)[: len(measured)] for i in range(top + 1) for j in range(top + 1 if len(measured) > 1 else 1)] if measured else [()]
    whole, with_y = grid(2), grid(1)
    name = lambda kind, e: f"__{kind}{''.join(map(str, e))}"
    cells = df.filter(known).groupBy(*by, *levelled).agg(
        *[F.sum(power(e)).alias(name("m", e)) for e in whole], *[F.sum(power(e) * y).alias(name("y", e)) for e in with_y], F.sum(y * y).alias("__yy")
    )
    kinds, names = dict(df.dtypes), list(factors)
    terms = [(names[0],)] + [(n,) for n in names[1:]] + ([tuple(names)] if interaction and len(names) == 2 else [])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        coded = {c: _coded(pd.factorize(pdf[c], sort=True)[0], coding) for c in levelled}
        # a column of the design: a factor a cell, times a power of the covariates
        columns, power_of, members = [np.ones(len(pdf))], [(0,) * len(measured)], {(): [0]}
        for term in terms:
            parts = [np.ones((len(pdf), 1))] + [coded[c] for c in term if c in coded]
            block = parts[0]
            for more in parts[1:]:
                block = (block[:, :, None] * more[:, None, :]).reshape(len(pdf), -1)
            members[term] = list(range(len(columns), len(columns) + block.shape[1]))
            columns += list(block.T)
            power_of += [tuple(int(c in term) for c in measured)] * block.shape[1]
        d, size = np.array(columns), len(columns)
        gram = np.zeros((size + 1, size + 1))
        for e in set(power_of):
            i = [k for k in range(size) if power_of[k] == e]
            gram[i, -1] = gram[-1, i] = d[i] @ pdf[name("y", e)].to_numpy(float)
            for f in set(power_of):
                j = [k for k in range(size) if power_of[k] == f]
                gram[np.ix_(i, j)] = (d[i] * pdf[name("m", tuple(a + b for a, b in zip(e, f, strict=True)))].to_numpy(float)) @ d[j].T
        gram[-1, -1] = pdf["__yy"].sum()
        # sums of squares reach the last digits of large ones: columns of one scale
        scale = np.sqrt(np.maximum(np.diag(gram), np.finfo(float).tiny))
        scale[-1] = 1.0
        gram = gram / np.outer(scale, scale)
        n = int(round(float(pdf[name("m", (0,) * len(measured))].sum())))

        def rest(of: list[tuple[str, ...]]) -> tuple[float, int]:
            return swept_rest(gram, [k for t in of for k in members[t]])

        everything = [(), *terms]
        full, rank = rest(everything)
        rows = []
        for i, term in enumerate(everything):
            if term == () and kind != 3:
                continue
            others = everything[:i] if kind == 1 else [t for t in everything if not set(term) <= set(t)] if kind == 2 else [t for t in everything if t != term]
            less, less_rank = rest(others)
            more, more_rank = (rest([*others, term])) if kind < 3 else (full, rank)
            rows.append((":".join(term) or "intercept", max(less - more, 0.0), more_rank - less_rank))
        dof = n - rank
        ms = full / dof if dof > 0 else math.nan
        total, out = sum(ss for _, ss, _ in rows) + full, []
        for label, ss, k in rows:
            f = ss / k / ms if k > 0 and ms > 0 else math.nan
            p = float(stats.betainc(dof / 2, k / 2, dof / (dof + k * f))[0]) if math.isfinite(f) else math.nan
            out.append((label, ss, k, f, p, ss / total if total else math.nan, (ss - k * ms) / (ss + k * ms + ms) if kind == 1 else math.nan))
        out.append(("residual", full, dof, math.nan, math.nan, math.nan, math.nan))
        return pd.DataFrame([(*(pdf[c].iloc[0] for c in by), *row) for row in out], columns=[*by, "factor", "ss", "dof", "f", "p", "eta2", "omega2"])

    schema = ", ".join([f"`{k}` {kinds[k]}" for k in by] + ["factor string, ss double, dof long, f double, p double, eta2 double, omega2 double"])
    out = cells.groupBy(*by).applyInPandas(run, schema)
    return out.select(*by, "factor", "ss", "dof", *[F.nanvl(c, F.lit(None).cast("double")).alias(c) for c in ("f", "p", "eta2", "omega2")])
