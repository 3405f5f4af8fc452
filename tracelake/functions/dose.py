"""Dose metrics and response curves as column expressions; null for null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tissue density (kg/m3), speed of sound (m/s), attenuation (Np/m/MHz^b), heat capacity (J/kg/K).
RHO, SOUND, ALPHA0, ALPHA_B, HEAT = 1046.0, 1546.3, 6.8032, 1.3, 3630.0


def intensity(pressure: Column, rho: float = RHO, c: float = SOUND) -> Column:
    """W/m2 of a peak pressure in Pa."""
    return pressure * pressure / (2 * rho * c)


def pressure(intensity: Column, rho: float = RHO, c: float = SOUND) -> Column:
    return F.sqrt(2 * rho * c * intensity)


def pulse_average_intensity(megapascal: Column) -> Column:
    """W/cm2 while a pulse is on."""
    return intensity(megapascal * 1e6) * 1e-4


def time_average_intensity(megapascal: Column, duty_cycle: Column) -> Column:
    """W/cm2 over pulses and gaps; the duty cycle is in percent."""
    return pulse_average_intensity(megapascal) * duty_cycle / 100


def decibel_amplitude(db: Column) -> Column:
    return F.pow(F.lit(10.0), db / 20)


def decibel_intensity(db: Column) -> Column:
    return F.pow(F.lit(10.0), db / 10)


def attenuation(megahertz: Column, alpha0: float = ALPHA0, b: float = ALPHA_B) -> Column:
    return alpha0 * F.pow(megahertz, F.lit(b))


def radiation_force(megahertz: Column, intensity: Column, c: float = SOUND) -> Column:
    """N/m3 of an intensity in W/cm2."""
    return 2 * attenuation(megahertz) * intensity * 1e4 / c


def heat_rate(megahertz: Column, intensity: Column, rho: float = RHO, heat: float = HEAT) -> Column:
    """K/s of an intensity in W/cm2."""
    return 2 * attenuation(megahertz) * intensity * 1e4 / (rho * heat)


def temperature_rise(megahertz: Column, intensity: Column, seconds: Column) -> Column:
    return heat_rate(megahertz, intensity) * seconds


def mechanical_index(megahertz: Column, megapascal: Column) -> Column:
    return megapascal / F.sqrt(megahertz)


def exponential_decay(x: Column, h: float, a: float, tau: float, x0: float) -> Column:
    return a * F.exp(-(x - x0) / tau) + h


def double_decay(x: Column, h: float, a1: float, a2: float, tau1: float, tau2: float, x1: float, x2: float) -> Column:
    return a1 * F.exp(-(x - x1) / tau1) + a2 * F.exp(-(x - x2) / tau2) + h


def gaussian(x: Column, h: float, a: float, x0: float, sigma: float) -> Column:
    return h + a * F.exp(-F.pow(x - x0, F.lit(2)) / (2 * sigma * sigma))


def saturation(x: Column, x0: float = 0, tau: float = 1, a: float = 1, y0: float = 0) -> Column:
    """Exponential rise from ``y0`` at ``x0``; ``y0`` before."""
    return F.when(x < x0, F.lit(float(y0))).otherwise(a * (1 - F.exp(-(x - x0) / tau)) + y0)


def saturation_inverse(y: Column, x0: float = 0, tau: float = 1, a: float = 1, y0: float = 0) -> Column:
    return x0 - tau * F.log(1 - (y - y0) / a)


def sigmoid(x: Column, x0: float = 0, sigma: float = 1, a: float = 1, y0: float = 0) -> Column:
    return a / (1 + F.exp(-(x - x0) / sigma)) + y0


def sigmoid_root(y: Column, x0: float, sigma: float) -> Column:
    return x0 + sigma * F.log(y / (1 - y))


def sigmoid_decay(x: Column, x0: float = 0, k: float = 1, r: float = 0.2, a: float = 1, y0: float = 0) -> Column:
    """A rise of rate ``k`` under a fall of rate ``r``, both about ``x0``."""
    return a / (1 + F.exp(-k * (x - x0))) * F.exp(-r * (x - x0)) + y0


def threshold_linear(x: Column, x0: float = 1, a: float = 1, sigma: float = 0, y0: float = 0) -> Column:
    """A line from ``x0`` on; ``sigma`` > 0 softens the corner."""
    if sigma > 0:
        return a * sigma * F.log1p(F.exp((x - x0) / sigma)) + y0
    return a * F.greatest(x - x0, F.lit(0.0)) + y0


def threshold_root(x: Column, a: float = 1, x0: float = 0, y0: float = 0) -> Column:
    return F.when(x < x0, F.lit(float(y0))).otherwise(a * F.sqrt(F.greatest(x - x0, F.lit(0.0))) + y0)


def scaled_power(x: Column, a: float = 1, b: float = 1) -> Column:
    return a * F.pow(x, F.lit(float(b)))


def parabola(x: Column, x1: float, x2: float, a: float = 1, y0: float = 0) -> Column:
    return a * (x - x1) * (x - x2) + y0


def transient(t: Column, a: float, rise: float, decay: float, c: float) -> Column:
    return a * (F.exp(-t / decay) - F.exp(-t / rise)) + c


def dose_metric(megapascal: Column, duty_cycle: Column, name: str) -> Column:
    """A measure of a pressure in MPa and a duty cycle in percent: ``p``, ``p_average`` and ``p_rms`` in MPa, ``dc`` as a share,
    ``isppa``, ``ispta`` and ``i_rms`` in W/cm2."""
    share = duty_cycle / 100
    known = {
        "p": lambda: megapascal, "dc": lambda: share, "p_average": lambda: megapascal * share, "p_rms": lambda: megapascal * F.sqrt(share / 2),
        "isppa": lambda: pulse_average_intensity(megapascal), "ispta": lambda: time_average_intensity(megapascal, duty_cycle),
        "i_rms": lambda: pulse_average_intensity(megapascal) * F.sqrt(3 * share) / 2,
    }
    if name not in known:
        raise ValueError(f"no dose metric {name}")
    return known[name]()


def linear_origin(x: Column, a: float = 1) -> Column:
    return a * x


def mesh_edges(values: Column, scale: str = "lin") -> Column:
    """One more edge than values, evenly spaced from half a first step before the first to half a step past the last; ``log``: in logarithms."""
    v = F.transform(values, lambda x: F.log10(x)) if scale == "log" else values
    n, half = F.size(v), (F.get(v, 1) - F.get(v, 0)) / 2
    first, last = F.get(v, 0) - half, F.element_at(v, -1) + half
    edges = F.transform(F.sequence(F.lit(0), n), lambda i: first + (last - first) * i / n)
    return F.transform(edges, lambda x: F.pow(F.lit(10.0), x)) if scale == "log" else edges


def round_to_base(x: Column, precision: int = 1, base: float = 0.5) -> Column:
    """To the nearest multiple of ``base``, halves to even."""
    return F.bround(base * F.rint(x / base), precision)
