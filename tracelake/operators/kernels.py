"""Per-trace numeric kernels over Arrow batches: spectra, filters, surrogates, robust fits.

A trace is bounded by the length of a recording, and traces are independent of each other.
Null and not-a-number samples are left out of their trace; a trace without samples gives no
rows, and one shorter than a kernel's segment is one segment. Results keep the frames of
the samples they belong to.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def per_trace(df: DataFrame, keys: list[str], value: str, kernel: Callable, columns: dict[str, str], *, frame: str = "frame", batched: bool = False) -> DataFrame:
    """Rows of ``kernel`` for each trace: it gets the values and their frames in frame order and gives equally long columns.

    Traces are gathered into arrays first, so that one Arrow batch holds many of them and
    none pays for a group of its own. A ``batched`` kernel gets the lists of a batch's traces.
    """
    kinds = dict(df.dtypes)
    schema = ", ".join([f"`{k}` {kinds[k]}" for k in keys] + [f"`{c}` {t}" for c, t in columns.items()])
    types = {"int": pa.int32(), "bigint": pa.int64(), "double": pa.float64()}
    known = df.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    ordered = F.array_sort(F.collect_list(F.struct(F.col(frame).alias("f"), F.col(value).cast("double").alias("x"))))
    rows = known.groupBy(*keys).agg(ordered.alias("__s")).select(*keys, F.transform("__s", lambda s: s["x"]).alias("__v"), F.transform("__s", lambda s: s["f"]).alias("__f"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            found = batch.column(len(keys))
            flat, ends = found.flatten().to_numpy(zero_copy_only=False), np.cumsum(pc.list_value_length(found).to_numpy(zero_copy_only=False))
            frames = batch.column(len(keys) + 1).flatten().to_numpy(zero_copy_only=False)
            parts = np.split(flat, ends[:-1]), np.split(frames, ends[:-1])
            outs = kernel(*parts) if batched else [kernel(y, f) for y, f in zip(*parts, strict=True)]
            index = pa.array(np.repeat(np.arange(len(outs)), [len(next(iter(o.values()))) for o in outs]))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k).take(index) for k in range(len(keys))), *(pa.array(np.concatenate([o[c] for o in outs]), types[t]) for c, t in columns.items())],
                names=[*keys, *columns],
            )

    return rows.mapInArrow(run, schema)


def per_signals(df: DataFrame, keys: list[str], order: str, values: list[str], kernel: Callable, columns: dict[str, str]) -> DataFrame:
    """As ``per_trace`` for traces of several signals: the kernel gets the places and one array a signal, and rows where any of them is missing are left out."""
    kinds = dict(df.dtypes)
    schema = ", ".join([f"`{k}` {kinds[k]}" for k in keys] + [f"`{c}` {t}" for c, t in columns.items()])
    types = {"int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "string": pa.string()}
    known = df.filter(F.col(order).isNotNull())
    for v in values:
        known = known.filter(F.col(v).isNotNull() & ~F.isnan(F.col(v).cast("double")))
    ordered = F.array_sort(F.collect_list(F.struct(F.col(order).cast("long").alias("f"), *[F.col(v).cast("double").alias(f"x{i}") for i, v in enumerate(values)])))
    names = ["f", *[f"x{i}" for i in range(len(values))]]
    rows = known.groupBy(*keys).agg(ordered.alias("__s")).select(*keys, *[F.col("__s").getField(n).alias(f"__{n}") for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            parts = []
            for k in range(len(keys), len(keys) + len(names)):
                ends = np.cumsum(pc.list_value_length(batch.column(k)).to_numpy(zero_copy_only=False))
                parts.append(np.split(batch.column(k).flatten().to_numpy(zero_copy_only=False), ends[:-1]))
            outs = [kernel(*signals) for signals in zip(*parts, strict=True)]
            index = pa.array(np.repeat(np.arange(len(outs)), [len(next(iter(o.values()))) for o in outs]))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k).take(index) for k in range(len(keys))), *(pa.array(np.concatenate([np.asarray(o[c]) for o in outs]), types[t], from_pandas=True) for c, t in columns.items())],
                names=[*keys, *columns],
            )

    return rows.mapInArrow(run, schema)


def power_spectrum(df: DataFrame, keys: list[str], value: str, rate: float, **names) -> DataFrame:
    """(keys, freq, power): one-sided density of each trace about its mean."""

    def kernel(y: np.ndarray, _: np.ndarray) -> dict[str, np.ndarray]:
        n = len(y)
        p = np.abs(np.fft.rfft(y - y.mean())) ** 2 / (rate * n)
        p[1 : (n + 1) // 2] *= 2
        return {"freq": np.fft.rfftfreq(n, 1 / rate), "power": p}

    return per_trace(df, keys, value, kernel, {"freq": "double", "power": "double"}, **names)


def welch_spectrum(df: DataFrame, keys: list[str], value: str, rate: float, segment: int, **names) -> DataFrame:
    """Mean density of half-overlapping Hann segments."""

    def kernel(y: np.ndarray, _: np.ndarray) -> dict[str, np.ndarray]:
        size = min(segment, len(y))
        window = np.hanning(size + 1)[:-1] if size > 1 else np.ones(1)
        parts = np.array([y[s : s + size] for s in range(0, len(y) - size + 1, max(1, size // 2))])
        p = np.abs(np.fft.rfft((parts - parts.mean(1, keepdims=True)) * window, axis=1)) ** 2 / (rate * (window**2).sum())
        p[:, 1 : (size + 1) // 2] *= 2
        return {"freq": np.fft.rfftfreq(size, 1 / rate), "power": p.mean(0)}

    return per_trace(df, keys, value, kernel, {"freq": "double", "power": "double"}, **names)


def tukey(n: int, taper: float) -> np.ndarray:
    """A window of period ``n`` that is flat but for cosine slopes over ``taper`` of its length."""
    k = np.arange(n)
    if taper <= 0 or n == 1:
        return np.ones(n)
    edge = min(taper, 1.0) * n / 2
    return np.where(k < edge, 0.5 * (1 - np.cos(np.pi * k / edge)), np.where(k > n - edge, 0.5 * (1 - np.cos(np.pi * (n - k) / edge)), 1.0))


def spectrogram(
    df: DataFrame, keys: list[str], value: str, rate: float, *, span: float, resolution: float | None = None, overlap: float = 0.5, window: str = "tukey", taper: float = 0.25, start: float = 0.0,
    frame: str = "frame",
) -> DataFrame:
    """(keys, t, freq, magnitude): spectra of segments of ``span`` seconds, less their mean, under a window.

    ``resolution``: distance of the frequencies in Hz, 1 / span unless given; a finer one pads
    segments with zeros, a coarser one is refused. ``t`` is the middle of a segment from
    ``start`` on; ``magnitude`` is over the window's sum, so a sine of amplitude 1 has one half.
    Segments are cut inside the gathered trace; one shorter than a segment has no rows.
    """
    resolution = 1 / span if resolution is None else resolution
    if resolution * span > 1 + 1e-9:
        raise ValueError("resolution times span must be 1 at most")
    size, padded = int(round(span * rate)), int(round(rate / resolution))
    step = size - int(round(overlap * size))
    if size < 1 or step < 1:
        raise ValueError("segments need a sample, and an overlap below their length")
    k = np.arange(size)
    shape = {"tukey": lambda: tukey(size, taper), "hann": lambda: 0.5 - 0.5 * np.cos(2 * np.pi * k / size), "hamming": lambda: 0.54 - 0.46 * np.cos(2 * np.pi * k / size)}[window]()
    freq = np.fft.rfftfreq(max(padded, size), 1 / rate)

    def kernel(y: np.ndarray, _: np.ndarray) -> dict[str, np.ndarray]:
        if len(y) < size:
            return {c: np.zeros(0) for c in ("t", "freq", "magnitude")}
        parts = np.lib.stride_tricks.sliding_window_view(y, size)[::step]
        m = np.abs(np.fft.rfft((parts - parts.mean(1, keepdims=True)) * shape, max(padded, size), axis=1)) / shape.sum()
        t = start + (size / 2 + step * np.arange(len(parts))) / rate
        return {"t": np.repeat(t, len(freq)), "freq": np.tile(freq, len(parts)), "magnitude": m.ravel()}

    return per_trace(df, keys, value, kernel, {"t": "double", "freq": "double", "magnitude": "double"}, frame=frame)


def mean_spectrum(df: DataFrame, keys: list[str], over: list[str], value: str, rate: float, **names) -> DataFrame:
    """(keys, freq, power): squared amplitudes in frequency, averaged over the traces ``over`` that a group has, such as pixels of a stack or trials of a unit."""

    def kernel(y: np.ndarray, _: np.ndarray) -> dict[str, np.ndarray]:
        return {"freq": np.fft.rfftfreq(len(y), 1 / rate), "power": np.abs(np.fft.rfft(y)) ** 2}

    return per_trace(df, [*keys, *over], value, kernel, {"freq": "double", "power": "double"}, **names).groupBy(*keys, "freq").agg(F.avg("power").alias("power"))


def analytic(y: np.ndarray) -> np.ndarray:
    """Analytic signal by doubling the positive frequencies."""
    n = len(y)
    gain = np.zeros(n)
    gain[0] = 1
    gain[1 : (n + 1) // 2] = 2
    if n % 2 == 0:
        gain[n // 2] = 1
    return np.fft.ifft(np.fft.fft(y) * gain)


def hilbert(df: DataFrame, keys: list[str], value: str, **names) -> DataFrame:
    """(keys, frame, envelope, phase)."""

    frame = names.get("frame", "frame")

    def kernel(y: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
        z = analytic(y)
        return {frame: at, "envelope": np.abs(z), "phase": np.angle(z)}

    return per_trace(df, keys, value, kernel, {frame: dict(df.dtypes)[frame], "envelope": "double", "phase": "double"}, **names)


def butterworth(order: int, cut: float | tuple[float, float], rate: float, kind: str) -> list[np.ndarray]:
    """Second-order sections (b0 b1 b2 a1 a2) by the bilinear transform.

    ``low`` and ``high`` take one cut-off and an even order; ``band`` and ``stop`` take two
    cut-offs, and each pole of the low-pass prototype becomes a section.
    """
    if kind in ("band", "stop"):
        low, high = (np.tan(np.pi * c / rate) for c in cut)
        width, centre = high - low, low * high
        poles = np.exp(1j * np.pi * (2 * np.arange(order) + order + 1) / (2 * order))
        half = width * poles / 2 if kind == "band" else width / poles / 2
        turn = np.sqrt(half * half - centre + 0j)
        analog = np.concatenate([half + turn, half - turn])
        digital = (1 + analog) / (1 - analog)
        real, paired = digital[np.abs(digital.imag) < 1e-12].real, digital[digital.imag >= 1e-12]
        sets = [(-2 * z.real, abs(z) ** 2) for z in paired] + [(-(a + b), a * b) for a, b in np.sort(real).reshape(-1, 2)]
        mid = 2 * np.arctan(np.sqrt(centre))  # where a band passes whole; a stop passes whole at zero
        b = np.array([1.0, 0.0, -1.0]) if kind == "band" else np.array([1.0, -2 * np.cos(mid), 1.0])
        at = np.exp(-1j * (mid if kind == "band" else 0.0))
        out = []
        for a1, a2 in sets:
            gain = abs((b[0] + b[1] * at + b[2] * at * at) / (1 + a1 * at + a2 * at * at))
            out.append(np.concatenate([b / gain, [a1, a2]]))
        return out
    if order % 2 or kind not in ("low", "high"):
        raise ValueError("low and high need an even order; the other kinds are band and stop")
    k = np.tan(np.pi * cut / rate)
    out = []
    for i in range(order // 2):
        q = 1 / (2 * np.sin(np.pi * (2 * i + 1) / (2 * order)))
        norm = 1 / (1 + k / q + k * k)
        b = np.array([k * k, 2 * k * k, k * k]) if kind == "low" else np.array([1.0, -2.0, 1.0])
        out.append(np.concatenate([b * norm, [2 * (k * k - 1) * norm, (1 - k / q + k * k) * norm]]))
    return out


def filtered(sections: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Forward and backward through the sections, with odd extension at both ends: zero phase.

    ``y`` may hold several equally long traces as columns; time is stepped once for all.
    """
    n = len(y)
    pad = min(n - 1, 3 * (2 * len(sections) + 1))
    x = np.concatenate([2 * y[0] - y[pad:0:-1], y, 2 * y[-1] - y[-2 : -pad - 2 : -1]]) if pad > 0 else y
    for _ in range(2):
        for b0, b1, b2, a1, a2 in sections:
            # start in the steady state of the first sample
            gain = (b0 + b1 + b2) / (1 + a1 + a2)
            z2 = (b2 - a2 * gain) * x[0]
            z1 = (b1 - a1 * gain) * x[0] + z2
            out = np.empty_like(x)
            for i, v in enumerate(x):
                w = b0 * v + z1
                z1, z2 = b1 * v - a1 * w + z2, b2 * v - a2 * w
                out[i] = w
            x = out
        x = x[::-1]
    return x[pad : pad + n] if pad > 0 else x


def zero_phase_filter(df: DataFrame, keys: list[str], value: str, rate: float, cut: float | tuple[float, float], *, order: int = 2, kind: str = "low", frame: str = "frame") -> DataFrame:
    """(keys, frame, value): ``low``, ``high``, ``band`` or ``stop``."""
    sections = butterworth(order, cut, rate, kind)

    def many(traces: list[np.ndarray], frames: list[np.ndarray]) -> list[dict[str, np.ndarray]]:
        out: list[dict[str, np.ndarray]] = [{} for _ in traces]
        sizes = np.array([len(y) for y in traces])
        for n in np.unique(sizes):
            same = np.flatnonzero(sizes == n)
            columns = filtered(sections, np.stack([traces[i] for i in same], 1))
            for k, i in enumerate(same):
                out[i] = {frame: frames[i], value: columns[:, k]}
        return out

    return per_trace(df, keys, value, many, {frame: dict(df.dtypes)[frame], value: "double"}, frame=frame, batched=True)


def _seed(y: np.ndarray, seed: int) -> np.random.Generator:
    """Depends on the trace alone, not on its place in a partition."""
    return np.random.default_rng([seed, *np.frombuffer(y.tobytes(), np.uint32)[:64].tolist()])


def phase_randomised(y: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """A surrogate with the same amplitudes in frequency and other phases."""
    f = np.fft.rfft(y)
    turn = np.exp(2j * np.pi * rng.random(len(f)))
    turn[0] = 1
    if len(y) % 2 == 0:
        turn[-1] = 1
    return np.fft.irfft(f * turn, len(y))


def rank_ordered(y: np.ndarray, like: np.ndarray) -> np.ndarray:
    """The values of ``y`` in the rank order of ``like``."""
    out = np.empty_like(y)
    out[np.argsort(like, kind="stable")] = np.sort(y)
    return out


def gauss_adjusted(y: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """A surrogate with the same values: normal noise in the order of ``y`` is phase randomised, and ``y`` takes its order."""
    noise = rank_ordered(rng.standard_normal(len(y)), y)
    return rank_ordered(y, phase_randomised(noise, rng))


def amplitude_adjusted(y: np.ndarray, rng: np.random.Generator, iterations: int) -> np.ndarray:
    """A surrogate with the same values and nearly the same spectrum."""
    size, x = np.abs(np.fft.rfft(y)), rng.permutation(y)
    for _ in range(iterations):
        f = np.fft.rfft(x)
        new = rank_ordered(y, np.fft.irfft(size * np.exp(1j * np.angle(f)), len(y)))
        if (new == x).all():
            break
        x = new
    return x


def surrogates(df: DataFrame, keys: list[str], value: str, *, method: str = "phase", seed: int = 0, iterations: int = 100, **names) -> DataFrame:
    """(keys, frame, value): surrogates of random ``phase``, of amplitudes adjusted through a ``gauss`` series, or of iterated ``amplitude``."""

    frame = names.get("frame", "frame")
    made = {
        "phase": phase_randomised, "gauss": gauss_adjusted,
        "amplitude": lambda y, rng: amplitude_adjusted(y, rng, iterations),
    }[method]

    def kernel(y: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
        return {frame: at, value: made(y, _seed(y, seed))}

    return per_trace(df, keys, value, kernel, {frame: dict(df.dtypes)[frame], value: "double"}, **names)


def huber(x: np.ndarray, y: np.ndarray, *, k: float = 1.345, rounds: int = 50) -> tuple[float, float]:
    """(slope, intercept) by reweighted least squares with Huber weights and the MAD scale."""
    a = np.stack([x, np.ones_like(x)], 1)
    w = np.ones_like(y)
    beta = np.zeros(2)
    for _ in range(rounds):
        new = np.linalg.lstsq(a * np.sqrt(w)[:, None], y * np.sqrt(w), rcond=None)[0]
        rest = y - a @ new
        scale = np.median(np.abs(rest)) / 0.6744897501960817
        if scale == 0 or np.abs(new - beta).max() < 1e-10:
            return float(new[0]), float(new[1])
        beta, w = new, np.minimum(1, k * scale / np.maximum(np.abs(rest), 1e-300))
    return float(beta[0]), float(beta[1])


def robust_trend(df: DataFrame, keys: list[str], value: str, **names) -> DataFrame:
    """(keys, slope, intercept) of each trace against its frame number."""

    def kernel(y: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
        slope, intercept = huber(at.astype(float), y)
        return {"slope": np.array([slope]), "intercept": np.array([intercept])}

    return per_trace(df, keys, value, kernel, {"slope": "double", "intercept": "double"}, **names)


def covariance_components(cov: DataFrame, by: list[str], n: int) -> DataFrame:
    """(by, component, share, feature, loading) from covariance rows (by, a, b, r), a <= b.

    One group is a matrix over features, whose number doesn't grow with the samples. The
    sign of a component makes its largest loading positive.
    """
    kinds = dict(cov.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names = sorted(set(pdf["a"]) | set(pdf["b"]))
        at = {x: i for i, x in enumerate(names)}
        m = np.zeros((len(names), len(names)))
        i, j = pdf["a"].map(at).to_numpy(), pdf["b"].map(at).to_numpy()
        m[i, j] = m[j, i] = pdf["r"].to_numpy()
        size, vectors = np.linalg.eigh(m)
        rows = []
        for k in range(min(n, len(names))):
            v = vectors[:, -1 - k]
            v = v * np.sign(v[np.argmax(np.abs(v))])
            rows.append(pd.DataFrame({**{c: pdf[c].iloc[0] for c in by}, "component": k, "share": size[-1 - k] / size.sum(), "feature": names, "loading": v}))
        return pd.concat(rows)

    schema = ", ".join([f"`{k}` {kinds[k]}" for k in by] + ["component int, share double", f"feature {kinds['a']}", "loading double"])
    return cov.groupBy(*by).applyInPandas(run, schema)


def scaled_spectrum(spectra: DataFrame, by: list[str], *, normalize: bool = False, db: bool = False, fmax: float | None = None, freq: str = "freq", power: str = "power") -> DataFrame:
    """A spectrum table cut at ``fmax``, over its group's largest power if ``normalize``, with a ``db`` column if asked for."""
    out = spectra if fmax is None else spectra.filter(F.col(freq) <= fmax)
    if normalize:
        top = out.groupBy(*by).agg(F.max(power).alias("__top"))
        out = out.join(top, by).withColumn(power, F.col(power) / F.col("__top")).drop("__top")
    return out.withColumn("db", 10 * F.log10(power)) if db else out
