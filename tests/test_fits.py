"""Robust fits, factor tests and curve fits against plain numpy versions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_operators import one
from tracelake.operators import curves, fits, frames


def plain_huber(x, y, intercept=True):
    """Reweighted least squares to the fixed point, with the lower median of the residuals' sizes."""
    a = np.stack([x, np.ones_like(x)], 1) if intercept else x[:, None]
    w = np.ones_like(y)
    for _ in range(500):
        beta = np.linalg.lstsq(a * np.sqrt(w)[:, None], y * np.sqrt(w), rcond=None)[0]
        rest = y - a @ beta
        scale = np.sort(np.abs(rest))[(len(y) - 1) // 2] / 0.6744897501960817
        w = np.minimum(1, 1.345 * scale / np.maximum(np.abs(rest), 1e-300))
    u = rest / scale
    inside = (np.abs(u) <= 1.345).astype(float)
    psi, m, n, p = np.clip(u, -1.345, 1.345), inside.mean(), len(y), a.shape[1]
    k = 1 + p / n * inside.var() / m**2
    cov = k**2 * ((psi**2).sum() * scale**2 / (n - p)) / m**2 * np.linalg.inv(a.T @ a)
    pval = math.erfc(abs(beta[0]) / math.sqrt(cov[0, 0]) / math.sqrt(2))
    return beta[0], beta[1] if intercept else 0.0, 1 - (rest**2).sum() / ((y - y.mean()) ** 2).sum(), pval, scale


@pytest.mark.parametrize("intercept", [True, False])
def test_robust_fit(spark, intercept):
    rng = np.random.default_rng(4)
    rows, want = [], {}
    for g in (None, 1, 2):
        x = rng.uniform(1, 5, 80)
        y = 0.3 * x + (2 if g else 0) + rng.standard_normal(80) + np.where(rng.random(80) < 0.1, 20, 0)
        rows += [(g, float(a), float(b)) for a, b in zip(x, y, strict=True)]
        want[g] = plain_huber(x, y, intercept)
    rows += [(1, None, 3.0), (1, 2.0, None), (1, math.nan, 1.0), (7, 1.0, 1.0), (8, 2.0, 5.0), (8, 2.0, 6.0), (9, None, None)]
    rows += [(10, float(k), 2.0 * k) for k in range(6)]
    df = spark.createDataFrame(rows, "g int, x double, y double")
    got = {r.g: r for r in fits.robust_fit(df, ["g"], "x", "y", intercept=intercept, rounds=40).collect()}
    for g, w in want.items():
        assert (got[g].slope, got[g].intercept, got[g].r2, got[g].p, got[g].scale) == pytest.approx(w, rel=1e-6, abs=1e-9) and got[g].converged and got[g].n == 80
    assert set(got) == {None, 1, 2, 7, 8, 10}
    assert got[10].slope == pytest.approx(2) and got[10].p is None  # no residuals, no scale
    if intercept:
        assert got[7].slope is None and got[8].slope is None and got[7].p is None
    assert fits.robust_fit(df.limit(0), ["g"], "x", "y", rounds=2).count() == 0


def test_normal_p(spark):
    z = [0.0, 0.1, -1.0, 1.96, 3.0, 5.5, 9.9, 30.0]
    rows = spark.createDataFrame([(v,) for v in [*z, None]], "z double").select("z", fits.normal_p_value(F.col("z")).alias("p")).collect()
    for r in rows:
        assert r.p is None if r.z is None else r.p == pytest.approx(math.erfc(abs(r.z) / math.sqrt(2)), abs=1e-13)


def test_robust_frames_and_parameters(spark):
    rng = np.random.default_rng(5)
    ref = rng.uniform(100, 200, 60)
    rows = [("s", f, k, float(ref[k] * (1 + f / 50) + 5 + rng.standard_normal() + (500 if k % 13 == 0 else 0))) for f in range(12) for k in range(60)]
    px = spark.createDataFrame(rows, "stack string, frame int, pixel int, v double")
    reference = spark.createDataFrame([("s", k, float(v)) for k, v in enumerate(ref)], "stack string, pixel int, ref double")
    fit = frames.frame_regression(px, reference, kind="robust")
    by_frame = {r.frame: r for r in fit.collect()}
    assert all(by_frame[f].slope == pytest.approx(1 + f / 50, abs=0.05) for f in range(12))
    smooth = {r.frame: r for r in frames.smoothed_parameters(fit, 4, 1).collect()}
    assert set(smooth) == set(range(12)) and all(math.isfinite(r.slope) and math.isfinite(r.intercept) for r in smooth.values())
    kept = frames.sampled_pixels(reference, 0.5, seed=2)
    assert 10 < kept.count() < 50 and kept.count() == frames.sampled_pixels(reference, 0.5, seed=2).count() and frames.sampled_pixels(reference, 1.0).count() == 60


def coded(values, coding):
    levels = sorted(set(values))
    eye = np.eye(len(levels) - 1)
    table = np.vstack([np.zeros(len(levels) - 1), eye]) if coding == "treatment" else np.vstack([eye, -np.ones(len(levels) - 1)])
    return table[[levels.index(v) for v in values]]


def plain_tests(rows, levelled, kind, interaction, coding):
    """Sums of squares from designs by row and least squares, a comparison of models a term."""
    a, b, y = (np.array(c, object) for c in zip(*rows, strict=True))
    y = y.astype(float)
    blocks = {(): np.ones((len(y), 1))}
    for name, c, levels in zip("ab", (a, b), levelled, strict=True):
        blocks[(name,)] = coded(list(c), coding) if levels else c.astype(float)[:, None]
    if interaction:
        p, q = blocks[("a",)], blocks[("b",)]
        blocks[("a", "b")] = (p[:, :, None] * q[:, None, :]).reshape(len(y), -1)

    def rest(terms):
        x = np.hstack([blocks[t] for t in terms]) if terms else np.zeros((len(y), 0))
        if not x.shape[1]:
            return float(y @ y), 0
        beta, _, rank, _ = np.linalg.lstsq(x, y, rcond=1e-10)
        return float(((y - x @ beta) ** 2).sum()), int(rank)

    names, full, out = list(blocks), rest(list(blocks)), {}
    for i, t in enumerate(names):
        if t == () and kind < 3:
            continue
        others = names[:i] if kind == 1 else [o for o in names if not set(t) <= set(o)] if kind == 2 else [o for o in names if o != t]
        less, more = rest(others), rest([*others, t]) if kind < 3 else full
        out[":".join(t) or "intercept"] = (less[0] - more[0], more[1] - less[1])
    out["residual"] = (full[0], len(y) - full[1])
    return out


@pytest.mark.parametrize("kind", [1, 2, 3])
@pytest.mark.parametrize("levelled, coding", [((True, True), "treatment"), ((True, True), "sum"), ((True, False), "treatment"), ((False, True), "sum"), ((False, False), "treatment")])
@pytest.mark.parametrize("interaction", [True, False])
def test_factor_tests(spark, kind, levelled, coding, interaction):
    rng = np.random.default_rng(9)
    rows = []
    for _ in range(90):
        a = "xyz"[rng.choice(3, p=[0.6, 0.3, 0.1])] if levelled[0] else float(rng.normal(3))
        b = int(rng.choice([1, 2, 5], p=[0.2, 0.5, 0.3])) if levelled[1] else float(rng.normal(-2))
        rows.append((a, b, float((ord(a) if levelled[0] else a) * 0.5 + b * 0.3 + rng.normal())))
    types = f"a {'string' if levelled[0] else 'double'}, b {'int' if levelled[1] else 'double'}, y double"
    df = spark.createDataFrame([*rows, (None, rows[0][1], 1.0), (rows[0][0], rows[0][1], None)], types)
    got = {r.factor: r for r in fits.factor_tests(df, [], dict(zip("ab", levelled, strict=True)), "y", kind=kind, interaction=interaction, coding=coding).collect()}
    want = plain_tests(rows, levelled, kind, interaction, coding)
    assert set(got) == set(want)
    ms = want["residual"][0] / want["residual"][1]
    for name, (ss, dof) in want.items():
        assert got[name].ss == pytest.approx(ss, rel=1e-6, abs=1e-7) and got[name].dof == dof
        if name != "residual":
            assert got[name].f == pytest.approx(ss / dof / ms, rel=1e-6, abs=1e-7) and 0 <= got[name].p <= 1
            assert (got[name].omega2 is None) == (kind != 1)


def test_factor_tests_of_odd_tables(spark):
    """Missing cells, one level, groups without residual degrees of freedom, no rows."""
    rows = [("g", "x", 1, 1.0), ("g", "x", 2, 2.0), ("g", "y", 1, 4.0), ("g", "x", 1, 1.5), ("g", "y", 1, 3.0), ("one", "x", 1, 2.0), ("one", "x", 1, 3.0), ("tiny", "x", 1, 2.0)]
    df = spark.createDataFrame(rows, "g string, a string, b int, y double")
    got = {(r.g, r.factor): r for r in fits.factor_tests(df, ["g"], {"a": True, "b": True}, "y", kind=2, interaction=True).collect()}
    want = plain_tests([(a, b, y) for g, a, b, y in rows if g == "g"], (True, True), 2, True, "treatment")
    assert {k: (pytest.approx(got["g", k].ss, abs=1e-9), got["g", k].dof) for k in want} == want
    assert got["one", "a"].dof == 0 and got["one", "a"].f is None and got["tiny", "residual"].dof == 0
    assert fits.factor_tests(df.limit(0), ["g"], {"a": True}, "y").count() == 0
    with pytest.raises(ValueError):
        fits.factor_tests(df, ["g"], {"a": True}, "y", kind=4)


PARAMETERS = {
    "linear": [2, -1], "origin": [3.0], "poly1": [2, 3], "poly2": [0.5, -2, 3], "poly3": [0.1, -1, 2, 5], "power": [2, 0.6], "sigmoid": [4, 0.7, 3, 1], "corrected_sigmoid": [4, 1, 3],
    "sigmoid_decay": [3, 2, 0.2, 4], "corrected_sigmoid_decay": [3, 2, 0.2, 4], "gauss": [1, 2, 5, 1.2], "parabola": [2, 1, 7], "soft_threshold": [4, 2, 0.05, 1], "biexponential": [3, 0.5, 2, 1],
    "saturation": [3, 1, 2], "threshold": [2, 1, 4], "root": [2, 1, 3.03], "decay": [3, 1, 2],
}


@pytest.mark.parametrize("kind", sorted(curves.FAMILIES))
def test_curve_family(spark, kind):
    """Derivatives by differences; a true curve is found again, many groups at once; columns predict what arrays do."""
    x, p = np.linspace(0.05, 10, 60), np.array([PARAMETERS[kind]], float)
    y, jac = curves.evaluate(kind, x[None], p)
    steps = np.eye(p.shape[1]) * 1e-6
    numeric = np.stack([(curves.evaluate(kind, x[None], p + d)[0] - curves.evaluate(kind, x[None], p - d)[0]) / (2 * d.sum()) for d in steps], 2)
    assert np.abs(jac - numeric).max() < 1e-4
    noise = 0.01 * np.random.default_rng(1).standard_normal(60)
    found, cov, r2 = curves.fit_many(kind, [x, x[:50], x], [y[0], y[0][:50], y[0] + noise])
    assert r2[0] > 1 - 1e-9 and r2[2] > 0.98 and np.abs(found[0]) == pytest.approx(np.abs(p[0]), rel=1e-3, abs=1e-6)
    # errors as from the derivatives at the fit
    rest = y[0] + noise - curves.evaluate(kind, x[None], found[2:])[0][0]
    j = curves.evaluate(kind, x[None], found[2:])[1][0]
    if kind != "soft_threshold":
        assert cov[2] == pytest.approx(np.linalg.inv(j.T @ j) * (rest @ rest) / (60 - p.shape[1]), rel=1e-5)
    pts = spark.createDataFrame([("k", float(a)) for a in x], "g string, x double")
    fit = spark.createDataFrame([("k", kind, p[0].tolist())], "g string, kind string, parameters array<double>")
    drawn = [r.predicted for r in curves.predict_curves(pts, fit, ["g"], "x").orderBy("x").collect()]
    assert drawn == pytest.approx(y[0].tolist(), rel=1e-8, abs=1e-8)


def test_bounds_hold():
    x = np.linspace(0, 10, 30)
    found, _, _ = curves.fit_many("soft_threshold", [x], [-x])  # a falling line: the slope stays at its bound
    assert found[0][1] == 0 and 0 <= found[0][0] <= 10


def test_curve_fits_and_bands(spark):
    x = np.linspace(0.1, 5, 30)
    rng = np.random.default_rng(2)
    rows = [("line", float(v), float(2 * v + 1 + 0.1 * e)) for v, e in zip(x, rng.standard_normal(30), strict=True)]
    rows += [("wave", float(v), float(np.sin(40 * v))) for v in x] + [("few", 1.0, 2.0), ("none", None, 1.0), ("none", 2.0, math.nan)]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    fit = curves.fit_curves(df, ["g"], "x", "y", ["poly1", "sigmoid"], 0.5)
    got = {r.g: r for r in fit.collect()}
    assert got["line"].kind is not None and got["wave"].kind is None and got["few"].kind is None and got["few"].n == 1 and got["none"].parameters == [] and got["none"].n == 0
    line = curves.fit_curves(df, ["g"], "x", "y", ["poly1"])
    bands = curves.curve_bands(df, line, ["g"], "x", draws=200, seed=3, level=0.9).collect()
    own = sorted((r.x, r.low, r.high) for r in bands if r.g == "line")
    p, cov = np.array(one(line.filter("g = 'line'")).parameters), np.array(one(line.filter("g = 'line'")).covariance).reshape(2, 2)
    drawn = p + np.sqrt(np.diag(cov)) * curves.normal_draws(200, 2, 3)
    want = np.quantile(drawn[:, :1] * x + drawn[:, 1:], [0.05, 0.95], axis=0)
    assert np.allclose([o[1] for o in own], want[0]) and np.allclose([o[2] for o in own], want[1])
    assert all(r.low is None for r in bands if r.g != "line")
    assert curves.curve_bands(df, line, ["g"], "x", draws=10, most_error=1e-9).filter("low is not null").count() == 0
    for out in (curves.fit_curves(df.limit(0), ["g"], "x", "y", ["poly1"]), curves.curve_bands(df.limit(0), line, ["g"], "x", draws=5)):
        assert out.count() == 0
