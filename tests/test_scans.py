"""Scan-line operators against plain loops."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelake.operators import kernels, scans


def recording(spark, grid, key="a"):
    return spark.createDataFrame([(key, f, k, None if v is None else float(v)) for f, row in enumerate(grid) for k, v in enumerate(row)], "k string, frame int, row int, v double")


def table(df, value="v"):
    rows = df.collect()
    out = np.full((1 + max(r.frame for r in rows), 1 + max(r.row for r in rows)), np.nan)
    for r in rows:
        out[r.frame, r.row] = np.nan if r[value] is None else r[value]
    return out


def mirrored(x, i):
    while not 0 <= i < len(x):
        i = -1 - i if i < 0 else 2 * len(x) - 1 - i
    return x[i]


def test_intraframe_in_full(spark):
    rng = np.random.default_rng(1)
    grid = rng.standard_normal((9, 12)) + np.arange(9)[:, None] + np.sin(np.arange(12))
    got = table(scans.intraframe_corrected(recording(spark, grid), ["k"], "v", 5, before=3, detrend=True, window=6))
    y = grid - np.median(grid[:6])
    knots = {0: y[0, 0], **{f * 12 + 11: y[f, 11] for f in range(9)}}
    y = y - np.interp(np.arange(108), sorted(knots), [knots[k] for k in sorted(knots)]).reshape(9, 12)
    y = y - y[2:5].mean(0)
    for f in range(9):
        top = [max(mirrored(y[f], i + d) for d in range(-3, 4)) for i in range(12)]
        w = [math.exp(-0.5 * (d / 3) ** 2) for d in range(-12, 13)]
        base = [sum(a * mirrored(top, i + d) for a, d in zip(w, range(-12, 13), strict=True)) / sum(w) for i in range(12)]
        assert got[f] == pytest.approx(y[f] - np.array(base), abs=1e-9)


def test_intraframe_of_odd_recordings(spark):
    """Missing lines, and recordings without frames before the stimulus."""
    grid = [[1.0, 2.0, None], [2.0, None, 4.0], [1.0, 1.0, 1.0], [5.0, 6.0, 7.0]]
    out = table(scans.intraframe_corrected(recording(spark, grid), ["k"], "v", 2, before=2, window=3))
    assert np.isnan(out[0, 2]) and np.isnan(out[1, 1]) and np.isfinite(out[3]).all()
    late = recording(spark, [[1.0, 2.0], [3.0, 4.0]]).withColumn("frame", F.col("frame") + 10)
    assert sorted(r.v for r in scans.intraframe_corrected(late, ["k"], "v", 2).collect()) == [1, 2, 3, 4]
    empty = recording(spark, grid).limit(0)
    assert scans.intraframe_corrected(empty, ["k"], "v", 2).count() == 0 and scans.pooled_forecast(empty, ["k"], "v", 1, 2, trial="frame", frame="row").count() == 0


@pytest.mark.parametrize("mode", ["trend", "smooth"])
def test_raster_artifact_equals_plain_fit(spark, mode):
    rng = np.random.default_rng(2)
    frames, rows, reference, before, harmonics, penalty = 14, 32, 6, 4, 3, 1e-5
    f, k = np.divmod(np.arange(frames * rows), rows)
    slow = np.sin(f / 3.0) + 0.01 * k
    shape = np.cos(2 * np.pi * k / rows) + 0.4 * np.sin(4 * np.pi * k / rows)
    y = slow + (1 + 0.5 * slow) * shape + 0.05 * rng.standard_normal(len(f))
    rows_of = [("a", int(a), int(b), float(v), float(s)) for a, b, v, s in zip(f, k, y, slow, strict=True)]
    df = spark.createDataFrame([*rows_of, ("short", 0, 0, 1.0, 1.0), ("flat", 0, 0, None, 1.0)], "k string, frame int, row int, v double, slow double")
    out = scans.raster_artifact(df, ["k"], "v", "slow", reference, before=before, harmonics=harmonics, splines=8, penalty=penalty, mode=mode)
    got = table(out.filter("k = 'a'"), "artifact").ravel()
    # the plain fit
    waves = np.stack([g(2 * np.pi * h * k / rows) for h in range(1, harmonics + 1) for g in (np.sin, np.cos)], 1)
    pre = (f >= reference - before) & (f < reference)
    t = waves @ np.linalg.lstsq(waves[pre], (y - slow)[pre], rcond=None)[0]
    t = (t - t.mean()) / (t - t.mean()).std()
    if mode == "trend":
        h = slow - np.median(slow[pre])
        x = np.stack([np.ones_like(t), t, t * h / np.quantile(np.abs(h[pre]), 0.75)], 1)
    else:
        at = np.arange(len(t)) / (len(t) - 1)
        knots = np.concatenate([[0] * 4, np.quantile(at, np.linspace(0, 1, 6)[1:-1]), [1] * 4])

        def spline(i, d, u):
            if d == 0:
                return float(knots[i] <= u < knots[i + 1] or (u == 1 and knots[i] < 1 == knots[i + 1]))
            a, b = knots[i + d] - knots[i], knots[i + d + 1] - knots[i + 1]
            return (0 if a == 0 else (u - knots[i]) / a * spline(i, d - 1, u)) + (0 if b == 0 else (knots[i + d + 1] - u) / b * spline(i + 1, d - 1, u))

        x = np.stack([np.ones_like(t)] + [t * np.array([spline(i, 3, u) for u in at]) for i in range(8)], 1)
    beta = np.linalg.solve(x.T @ x + np.diag([0] + [penalty] * (x.shape[1] - 1)), x.T @ y)
    assert got == pytest.approx(x[:, 1:] @ beta[1:], abs=1e-7)
    # amplitude and trend are one in this recording, so that the trend mode takes the artefact away
    if mode == "trend":
        assert np.abs(y - got - slow).std() < 0.2
    assert [r.artifact for r in out.filter("k <> 'a'").collect()] == [None]


def test_spline_basis_sums_to_one():
    x = np.sort(np.random.default_rng(0).random(50))
    b = scans.spline_basis(x, 9)
    assert b.shape == (50, 9) and b.sum(1) == pytest.approx(np.ones(50)) and (b >= -1e-12).all()


def plain_match(y, template, reach, relative):
    """Every stretch and shift by loops."""
    n = len(y)
    zy, zt = (y - y.mean()) / y.std(), (template - template.mean()) / template.std()
    best = None
    for i, c in enumerate(relative):
        moved = np.interp(np.arange(n), np.arange(n) * (1 + c), zy, right=np.nan)
        moved = moved[~np.isnan(moved)]
        for lag in range(-reach, reach + 1):
            s = round(sum(zt[j + lag] * moved[j] for j in range(len(moved)) if 0 <= j + lag < n) / n, 10)
            if best is None or s > best[0]:
                best = (s, lag, c)
    return best


def test_match_stimulus(spark):
    rng = np.random.default_rng(3)
    lines, fps = 60, 5
    setting = dict(onset=0.04, duration=0.1, rate=50, duty_cycle=40, fps=fps, lines=lines)
    template = scans.template_values(**setting)
    at = spark.range(lines).select(F.col("id").cast("int").alias("row"))
    assert [r.t for r in at.select("row", scans.stimulus_template(F.col("row"), 0.04, 0.1, 50, 40, fps, lines).alias("t")).orderBy("row").collect()] == template.tolist()
    pulses = [(0.04 + k / 50, 0.04 + k / 50 + 0.4 / 50) for k in range(5)]
    assert template[1:].tolist() == [-1.0 if any(a - 1e-9 <= i / (fps * lines) <= b + 1e-9 for a, b in pulses) else 0.0 for i in range(lines - 1)]
    signals = {"same": template.copy(), "late": np.roll(template, 4), "noise": rng.standard_normal(lines)}
    rows = [(k, i, float(v)) for k, y in signals.items() for i, v in enumerate(y)] + [("flat", i, 1.0) for i in range(lines)] + [("part", 0, 1.0), ("none", 0, None)]
    df = spark.createDataFrame(rows, "k string, row int, v double")
    got = {r.k: r for r in scans.match_stimulus(df, ["k"], "v", most_shift=0.03, stretch_range=0.04, stretches=9, **setting).collect()}
    assert set(got) == set(signals)
    for k, y in signals.items():
        corr, lag, c = plain_match(y, template, 9, np.linspace(-0.04, 0.04, 9))
        assert (got[k].corr, got[k].shift, got[k].stretch) == pytest.approx((corr, lag, 100 * c), abs=1e-6)
        assert got[k].effective_rate == pytest.approx(fps * lines / (1 + c)) and got[k].offset_ms == pytest.approx(1000 * lag * (1 + c) / (fps * lines))
    assert got["late"].shift == -4 and got["same"].corr == got["same"].first_corr == pytest.approx(1)
    with pytest.raises(ValueError):
        scans.match_stimulus(df, ["k"], "v", most_shift=0.1, stretches=4, **setting)


@pytest.mark.parametrize("order, surrogate", [(None, None), (2, None), (2, "phase"), (2, "amplitude")])
def test_pooled_forecast(spark, order, surrogate):
    rng = np.random.default_rng(4)
    y = np.zeros(60)
    for i in range(2, 60):
        y[i] = 0.5 + 0.8 * y[i - 1] - 0.3 * y[i - 2] + 0.1 * rng.standard_normal()
    rows = [("a", t, f, float(y[t * 10 + f])) for t in range(6) for f in range(10)] + [("b", 0, f, 1.0) for f in range(4)]
    df = spark.createDataFrame(rows, "k string, trial int, frame int, v double")
    got = {(r.k, r.trial, r.frame): r for r in scans.pooled_forecast(df, ["k"], "v", 4, 7, order=order, surrogate=surrogate, seed=5).collect()}
    p = order or 4
    series = {None: lambda s: s, "phase": lambda s: kernels.phase_randomised(s, kernels._seed(s, 5)), "amplitude": lambda s: kernels.amplitude_adjusted(s, kernels._seed(s, 5), 100)}[surrogate](y)
    x = np.array([[1, *series[i - p : i][::-1]] for i in range(p, 60)])
    beta = np.linalg.lstsq(x, series[p:], rcond=None)[0]
    for t in range(6):
        own = list(y[t * 10 : t * 10 + 4])
        for f in range(10):
            r = got["a", t, f]
            if 4 <= f <= 7:
                own.append(beta[0] + sum(b * v for b, v in zip(beta[1:], own[::-1], strict=False)))
                assert r.predicted == pytest.approx(own[-1], abs=1e-9)
            else:
                assert r.predicted == r.v
    assert all(got["b", 0, f].predicted == 1.0 for f in range(4)) and len(got) == 64
