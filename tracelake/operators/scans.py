"""Signals along the scan lines of frames: (keys, frame, row, value), with rows scanned one after another.

A recording (the lines of all frames of a group) is gathered into arrays once and worked on
as a whole; its length is that of the recording, not of the table. Missing lines are left
out of levels, profiles and fits; a recording without the frames that a step needs keeps its
values there. Empty tables give empty tables.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.operators import kernels


def _grid(frame: np.ndarray, row: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values as a matrix of frames and rows, missing ones not a number; the place of each sample in it."""
    names, at = np.unique(frame, return_inverse=True)
    out = np.full((len(names), int(row.max()) + 1), np.nan)
    out[at, row] = value
    return out, names, at


def _scanned(df: DataFrame, keys: list[str], frame: str, row: str, values: list[str], kernel: Callable, columns: dict[str, str]) -> DataFrame:
    """``kernel`` gets frames, rows and one array a signal of each recording, in scan order, and gives columns."""
    place = F.struct(F.col(frame).cast("long"), F.col(row).cast("long"))
    shift = 1 << 24
    coded = df.filter(place.isNotNull() & F.col(frame).isNotNull() & F.col(row).isNotNull()).withColumn("__at", F.col(frame).cast("long") * shift + F.col(row).cast("long"))
    return kernels.per_signals(coded, keys, "__at", values, lambda at, *signals: kernel(at // shift, at % shift, *signals), columns)


def _places(df: DataFrame, frame: str, row: str) -> dict[str, str]:
    kinds = dict(df.dtypes)
    return {frame: kinds[frame], row: kinds[row]}


def gaussian_filtered(y: np.ndarray, sigma: float) -> np.ndarray:
    """Along the last axis, out to four deviations, with mirrored borders."""
    if sigma <= 0:
        return y
    half = int(4 * sigma + 0.5)
    w = np.exp(-0.5 * (np.arange(-half, half + 1) / sigma) ** 2)
    wide = np.pad(y, [(0, 0)] * (y.ndim - 1) + [(half, half)], mode="symmetric")
    return np.lib.stride_tricks.sliding_window_view(wide, 2 * half + 1, axis=-1) @ (w / w.sum())


def rolling_maximum(y: np.ndarray, width: int) -> np.ndarray:
    """Along the last axis, over an odd centred window with mirrored borders."""
    half = width // 2
    wide = np.pad(y, [(0, 0)] * (y.ndim - 1) + [(half, half)], mode="symmetric")
    return np.lib.stride_tricks.sliding_window_view(wide, 2 * half + 1, axis=-1).max(-1)


def intraframe_corrected(
    df: DataFrame, keys: list[str], value: str, reference: int, *, before: int = 3, detrend: bool = False, window: int | None = None, frame: str = "frame", row: str = "row"
) -> DataFrame:
    """(keys, frame, row, value) less what scanning and slow changes add.

    In turn: less the median over all frames up to ``reference``; with ``detrend``, less the
    line from the last row of each frame to that of the next (from the very first sample in
    the first frame); less the mean profile over rows of the ``before`` frames before
    ``reference``; with ``window`` (in rows, made odd), less each frame's rolling maximum,
    smoothed by half that window.
    """

    def kernel(f: np.ndarray, line: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        early = f <= reference
        if early.any():
            y = y - np.median(y[early])
        rows = int(line.max()) + 1
        if detrend:
            knots = np.flatnonzero(line == rows - 1)
            at = f * rows + line
            if len(knots):
                if not (f[0] == f[knots[0]] and knots[0] == 0):
                    knots = np.concatenate([[0], knots])
                y = y - np.interp(at, at[knots], y[knots])
        grid, names, i = _grid(f, line, y)
        pre = (names >= reference - before) & (names < reference)
        if pre.any():
            known = np.isfinite(grid[pre])
            total = np.where(known, grid[pre], 0.0).sum(0)
            with np.errstate(invalid="ignore", divide="ignore"):
                profile = total / known.sum(0)
            grid = grid - np.where(np.isfinite(profile), profile, 0.0)
        if window is not None:
            width = window + 1 - window % 2
            whole = np.isfinite(grid).all(1)
            if whole.any():
                grid[whole] -= gaussian_filtered(rolling_maximum(grid[whole], width), width // 2)
            for k in np.flatnonzero(~whole):
                own = np.isfinite(grid[k])
                grid[k, own] -= gaussian_filtered(rolling_maximum(grid[k, own], width), width // 2)
        return {frame: f, row: line, value: grid[i, line]}

    return _scanned(df, keys, frame, row, [value], kernel, {**_places(df, frame, row), value: "double"})


def spline_basis(x: np.ndarray, size: int, degree: int = 3) -> np.ndarray:
    """``size`` B-splines on the range of ``x``, with inner knots at its even quantiles; their sum is one."""
    inner = np.quantile(x, np.linspace(0, 1, size - degree + 1)[1:-1])
    t = np.concatenate([[x.min()] * (degree + 1), inner, [x.max()] * (degree + 1)])
    last = np.flatnonzero(t[:-1] < t[1:]).max(initial=degree)
    basis = np.array([(x >= a) & ((x < b) | ((k == last) & (x <= b))) & (a < b) for k, (a, b) in enumerate(zip(t[:-1], t[1:], strict=True))], float).T
    for d in range(1, degree + 1):
        n = len(t) - 1 - d
        wide, far = t[d : d + n] - t[:n], t[d + 1 : d + 1 + n] - t[1 : n + 1]
        left = np.where(wide > 0, (x[:, None] - t[:n]) / np.where(wide > 0, wide, 1), 0.0)
        right = np.where(far > 0, (t[d + 1 : d + 1 + n] - x[:, None]) / np.where(far > 0, far, 1), 0.0)
        basis = left * basis[:, :n] + right * basis[:, 1 : n + 1]
    return basis


def raster_fit(
    f: np.ndarray, line: np.ndarray, y: np.ndarray, trend: np.ndarray, reference: int, before: int, harmonics: int, splines: int, penalty: float, mode: str
) -> np.ndarray | None:
    """The scanning artefact of one recording, or null where the template has no basis in the frames before ``reference``."""
    rows = int(line.max()) + 1
    pre = (f >= reference - before) & (f < reference)
    if pre.sum() < max(4 * harmonics, 20):
        return None
    turn = 2 * np.pi * np.outer(line / rows, np.arange(1, harmonics + 1))
    waves = np.hstack([np.sin(turn), np.cos(turn)])
    template = waves @ np.linalg.lstsq(waves[pre], (y - trend)[pre], rcond=None)[0]
    template -= template.mean()
    size = np.sqrt(np.mean(template**2))
    if not size > 0:
        return None
    template /= size
    if mode == "trend":
        slow = trend - np.median(trend[pre])
        scale = np.quantile(np.abs(slow[pre]), 0.75)
        if not scale > 0:
            scale = slow.std(ddof=1) if len(slow) > 1 else 0.0
        columns = np.stack([template, template * slow / (scale if scale > 0 else 1.0)], 1)
    else:
        at = f * rows + line
        span = at.max() - at.min()
        columns = spline_basis((at - at.min()) / (span or 1), splines) * template[:, None]
    x = np.hstack([np.ones((len(y), 1)), columns])
    gram = x.T @ x + np.diag([0.0] + [penalty] * columns.shape[1])
    return columns @ np.linalg.solve(gram, x.T @ y)[1:]


def raster_artifact(
    df: DataFrame, keys: list[str], value: str, trend: str, reference: int, *, before: int = 3, harmonics: int = 5, splines: int = 20, penalty: float = 1e-5, mode: str = "trend",
    frame: str = "frame", row: str = "row",
) -> DataFrame:
    """(keys, frame, row, value, artifact): the part of the signal that repeats with the scan of the rows.

    The template is a Fourier series over rows, fitted to the value less its physiological
    ``trend`` in the ``before`` frames before ``reference``, centred and of unit root mean
    square. Its amplitude is alpha + beta times the scaled trend (``mode`` trend) or a cubic
    spline over time (``smooth``), by ridge regression of the value, with a free level.
    ``artifact`` is null without enough samples before ``reference`` or without a template.
    """
    if mode not in ("trend", "smooth"):
        raise ValueError("mode is trend or smooth")

    def kernel(f: np.ndarray, line: np.ndarray, y: np.ndarray, slow: np.ndarray) -> dict[str, np.ndarray]:
        found = raster_fit(f, line, y, slow, reference, before, harmonics, splines, penalty, mode)
        return {frame: f, row: line, value: y, "artifact": np.full(len(y), np.nan) if found is None else found}

    return _scanned(df, keys, frame, row, [value, trend], kernel, {**_places(df, frame, row), value: "double", "artifact": "double"})


def pulse_envelope(t: Column, onset: float, duration: float, rate: float, duty_cycle: float) -> Column:
    """1 during the pulses of a train (both ends included), else 0: ``rate`` pulses a second, each on for ``duty_cycle`` percent of its period."""
    count = int(round(duration * rate))
    k = F.floor((t - onset) * rate + 1e-9)
    on = (k >= 0) & (k < count) & ((t - onset) * rate - k <= duty_cycle / 100 + 1e-9)
    return F.when(F.lit(duty_cycle > 0) & on, 1.0).otherwise(0.0)


def stimulus_template(line: Column, onset: float, duration: float, rate: float, duty_cycle: float, fps: float, lines: int) -> Column:
    """Minus the pulse envelope sampled at the lines of a frame, one line late; zero on the first line."""
    t = (line - 1) / F.lit(float(fps * lines))
    return F.when(line < 1, F.lit(0.0)).otherwise(-pulse_envelope(t, onset, duration, rate, duty_cycle) + F.lit(0.0))


def template_values(onset: float, duration: float, rate: float, duty_cycle: float, fps: float, lines: int) -> np.ndarray:
    """``stimulus_template`` on all lines of a frame."""
    t = np.arange(lines - 1) / (fps * lines)
    k = np.floor((t - onset) * rate + 1e-9)
    on = (k >= 0) & (k < int(round(duration * rate))) & ((t - onset) * rate - k <= duty_cycle / 100 + 1e-9) & (duty_cycle > 0)
    return np.concatenate([[0.0], -on.astype(float) + 0.0])


def matching_maps(template: np.ndarray, most_shift: int, stretches: np.ndarray) -> np.ndarray:
    """(stretch, shift, sample): what a z-scored signal is multiplied with for its correlation with the template.

    A stretched signal is linear between its moved samples and ends where they end.
    """
    n = len(template)
    size = template.std()
    z = (template - template.mean()) / size if size > 0 else np.zeros(n)
    out = np.zeros((len(stretches), 2 * most_shift + 1, n))
    for i, c in enumerate(stretches):
        place = np.arange(n) / c
        place = place[place <= n - 1 + 1e-9]
        low = np.minimum(np.floor(place + 1e-12).astype(int), n - 1)
        part = np.clip(place - low, 0, 1)
        for k in range(-most_shift, most_shift + 1):
            # sample j of the stretched signal meets sample j + k of the template
            j = np.arange(len(place))
            ok = (j + k >= 0) & (j + k < n)
            w = np.where(ok, z[np.clip(j + k, 0, n - 1)], 0.0) / n
            np.add.at(out[i, k + most_shift], low, w * (1 - part))
            np.add.at(out[i, k + most_shift], np.minimum(low + 1, n - 1), w * part)
    return out


def match_stimulus(
    df: DataFrame, keys: list[str], value: str, *, onset: float, duration: float, rate: float, duty_cycle: float, fps: float, lines: int, most_shift: float, stretch_range: float = 0.05,
    stretches: int = 101, row: str = "row",
) -> DataFrame:
    """(keys, first_corr, corr, shift, stretch, effective_rate, offset_ms) of each frame's lines against the stimulus template.

    All stretches (within ``stretch_range`` of one; their number is odd, so that one is among
    them) and shifts (up to ``most_shift`` seconds) are one matrix product; of equal
    correlations (to ten digits) the smallest stretch, then the smallest shift counts.
    ``stretch`` is relative, in percent; the effective rate is lines a second over the
    stretch, and the offset is the shift at that rate. A frame with missing lines, or of one
    value, has no row.
    """
    if stretches % 2 == 0:
        raise ValueError("the number of stretches must be odd")
    fs = fps * lines
    reach, relative = int(math.floor(most_shift * fs)), np.linspace(-stretch_range, stretch_range, stretches)
    relative[stretches // 2] = 0.0
    maps = matching_maps(template_values(onset, duration, rate, duty_cycle, fps, lines), reach, 1 + relative)
    flat = maps.reshape(-1, lines)
    names = {"first_corr": "double", "corr": "double", "shift": "int", "stretch": "double", "effective_rate": "double", "offset_ms": "double"}

    def kernel(y: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
        if len(y) != lines or (at != np.arange(lines)).any() or not y.std() > 0:
            return {c: np.zeros(0) for c in names}
        score = np.round(flat @ ((y - y.mean()) / y.std()), 10)
        k = int(np.argmax(score))
        i, shift = k // (2 * reach + 1), k % (2 * reach + 1) - reach
        effective = fs / (1 + relative[i])
        found = (score[stretches // 2 * (2 * reach + 1) + reach], score[k], shift, 100 * relative[i], effective, 1e3 * shift / effective)
        return {c: np.array([v]) for c, v in zip(names, found, strict=True)}

    return kernels.per_trace(df, keys, value, kernel, names, frame=row)


def pooled_forecast(
    df: DataFrame, keys: list[str], value: str, first: int, last: int, *, order: int | None = None, surrogate: str | None = None, seed: int = 0, trial: str = "trial", frame: str = "frame"
) -> DataFrame:
    """(keys, trial, frame, value, predicted): frames ``first`` to ``last`` of each trial from those before, by one autoregression a recording.

    The model (level and ``order`` coefficients, as many as frames before ``first`` unless
    given) is fitted by least squares to the trials put end to end, lags across their
    borders included, or to a ``surrogate`` of that series (phase, gauss or amplitude). A
    trial is forecast from its own samples before ``first``, then from predicted ones;
    other frames have their value as ``predicted``. Recordings too short for the model, and
    trials with fewer samples before ``first`` than the model's order, have null there.
    """
    order = first if order is None else order
    made = {
        None: lambda y: y, "phase": lambda y: kernels.phase_randomised(y, kernels._seed(y, seed)), "gauss": lambda y: kernels.gauss_adjusted(y, kernels._seed(y, seed)),
        "amplitude": lambda y: kernels.amplitude_adjusted(y, kernels._seed(y, seed), 100),
    }[surrogate]

    def kernel(t: np.ndarray, f: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        predicted = np.where((f >= first) & (f <= last), np.nan, y)
        series = made(y)
        if len(y) > 2 * order and order > 0:
            lags = np.lib.stride_tricks.sliding_window_view(series, order + 1)
            x = np.hstack([np.ones((len(lags), 1)), lags[:, order - 1 :: -1] if order > 1 else lags[:, :1]])
            beta = np.linalg.lstsq(x, lags[:, order], rcond=None)[0]
            for name in np.unique(t):
                own = np.flatnonzero(t == name)
                past = own[f[own] < first]
                ahead = own[(f[own] >= first) & (f[own] <= last)]
                if len(past) < order:
                    continue
                known = y[past[-order:]][::-1]  # the latest first
                for i in ahead:
                    predicted[i] = beta[0] + beta[1:] @ known
                    known = np.concatenate([[predicted[i]], known[:-1]])
        return {trial: t, frame: f, value: y, "predicted": predicted}

    return _scanned(df, keys, trial, frame, [value], kernel, {**_places(df, trial, frame), value: "double", "predicted": "double"})
