"""Pixel tables of image stacks: (stack, frame, pixel, value) rows.

Null pixels are left out of projections, levels and fits and stay null when values are
corrected; a stack of one value has null slopes. Empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracelake.operators import fits, kernels

#: A frame that changes along the reference by less than this share of its values doesn't change.
FLAT = 1e-9


def frame_levels(df: DataFrame, agg=F.avg, *, stack: str = "stack", frame: str = "frame", value: str = "v") -> DataFrame:
    return df.groupBy(stack, frame).agg(agg(F.col(value)).alias("level"))


def projection(df: DataFrame, agg=F.median, *, first: int | None = None, last: int | None = None, stack: str = "stack", frame: str = "frame", pixel: str = "pixel", value: str = "v") -> DataFrame:
    """(stack, pixel, ref): each pixel over a range of frames, the median unless said otherwise."""
    if first is not None:
        df = df.filter(F.col(frame) >= first)
    if last is not None:
        df = df.filter(F.col(frame) <= last)
    return df.groupBy(stack, pixel).agg(agg(F.col(value)).alias("ref"))


def quantile_mask(reference: DataFrame, q_min: float, q_max: float, *, stack: str = "stack") -> DataFrame:
    """Pixels of the reference between two of its quantiles."""
    edges = reference.groupBy(stack).agg(F.percentile("ref", F.lit(q_min)).alias("__a"), F.percentile("ref", F.lit(q_max)).alias("__b"))
    return reference.join(edges, stack).filter(F.col("ref").between(F.col("__a"), F.col("__b"))).drop("__a", "__b")


def frame_regression(df: DataFrame, reference: DataFrame, *, kind: str = "ols", stack: str = "stack", frame: str = "frame", pixel: str = "pixel", value: str = "v") -> DataFrame:
    """(stack, frame, slope, intercept) of each frame on the reference: ``ols``, ``origin``, ``robust`` (Huber) or ``moments`` (ratio of deviations).

    A slope of ``ols`` that moves a frame by less than FLAT of its values is the rounding of
    zero, and is zero.
    """
    both = df.join(reference, [stack, pixel])
    v = F.col(value)
    if kind == "robust":
        return fits.robust_fit(both, [stack, frame], "ref", value).select(stack, frame, "slope", "intercept")
    if kind == "origin":
        parts = ((F.sum(v * F.col("ref")) / F.sum(F.col("ref") * F.col("ref"))), F.lit(0.0))
    elif kind == "moments":
        parts = (F.stddev_pop(v) / F.stddev_pop("ref"), F.avg(v) - F.avg("ref"))
    else:
        flat = F.abs(F.regr_slope(value, "ref")) * F.stddev_pop("ref") <= FLAT * F.max(F.abs(v))
        parts = (F.when(flat, F.lit(0.0)).otherwise(F.regr_slope(value, "ref")), F.when(flat, F.avg(v)).otherwise(F.regr_intercept(value, "ref")))
    return both.groupBy(stack, frame).agg(parts[0].alias("slope"), parts[1].alias("intercept"))


def sampled_pixels(reference: DataFrame, share: float, *, seed: int = 0, stack: str = "stack", pixel: str = "pixel") -> DataFrame:
    """A share of each stack's pixels, the same in every frame, by a hash of stack, pixel and seed."""
    return reference.filter(F.pmod(F.xxhash64(F.lit(seed), stack, pixel), F.lit(1 << 30)) < int(share * (1 << 30)))


def smoothed_parameters(parameters: DataFrame, rate: float, cut: float, *, stack: str = "stack", frame: str = "frame") -> DataFrame:
    """(stack, frame, slope, intercept) low-passed along the frames of each stack."""
    slope, intercept = (kernels.zero_phase_filter(parameters, [stack], c, rate, cut, frame=frame) for c in ("slope", "intercept"))
    return slope.join(intercept, [stack, frame])


def correct_frames(df: DataFrame, parameters: DataFrame, *, stack: str = "stack", frame: str = "frame", value: str = "v") -> DataFrame:
    """(value - intercept) / slope, shifted up by stack if anything falls below zero."""
    fixed = df.join(parameters, [stack, frame]).withColumn(value, (F.col(value) - F.col("intercept")) / F.col("slope")).drop("slope", "intercept")
    low = fixed.groupBy(stack).agg(F.least(F.min(value), F.lit(0.0)).alias("__low"))
    return fixed.join(low, stack).withColumn(value, F.col(value) - F.col("__low")).drop("__low")


def fit_range(df: DataFrame, low: float, high: float, *, stack: str = "stack", value: str = "v") -> DataFrame:
    """Shift a stack that falls below ``low``, then halve one above ``high`` into its lower half range."""
    ends = df.groupBy(stack).agg(F.min(value).alias("__a"), F.max(value).alias("__b"))
    shift = F.when(F.col("__a") < low, low - F.col("__a")).otherwise(0.0)
    top = F.col("__b") + shift
    scale = F.when(top > high, 0.5 * high / top).otherwise(1.0)
    return df.join(ends, stack).withColumn(value, (F.col(value) + shift) * scale).drop("__a", "__b")


def out_of_range(df: DataFrame, low: float, high: float, *, stack: str = "stack", value: str = "v") -> DataFrame:
    """Stacks with a value outside [low, high]."""
    return df.groupBy(stack).agg(F.min(value).alias("low"), F.max(value).alias("high")).filter((F.col("low") < low) | (F.col("high") > high))


def skew_to_quantile(skew: Column, *, z: float = 2, q0: float = 0.01, q_inf: float = 0.99, sigma: float = 1) -> Column:
    """The largest quantile of pixels to use: it rises from ``q0`` to ``q_inf`` as the skewness passes ``z``."""
    return q0 + (q_inf - q0) / (1 + F.exp(-(skew - z) / sigma))


def adaptive_mask(reference: DataFrame, q_min: float, *, stack: str = "stack", **shape) -> DataFrame:
    """Pixels of the reference between ``q_min`` and the quantile that its own skewness gives."""
    skews = reference.groupBy(stack).agg(F.skewness("ref").alias("__skew"))
    ranked = reference.withColumn("__r", F.percent_rank().over(W.partitionBy(stack).orderBy("ref")))
    return ranked.join(skews, stack).filter((F.col("__r") >= q_min) & (F.col("__r") <= skew_to_quantile(F.col("__skew"), **shape))).drop("__r", "__skew")


def align_files(df: DataFrame, *, file: str = "file", value: str = "v") -> DataFrame:
    """Take each file's mean, less the mean of file means, off its values; rounded half to even."""
    means = df.groupBy(file).agg(F.avg(value).alias("__m"))
    shifted = means.withColumn("__d", F.col("__m") - F.avg("__m").over(W.partitionBy()))  # one row a file
    return df.join(shifted, file).withColumn(value, F.rint(F.col(value) - F.col("__d"))).drop("__m", "__d")


def resampled_values(values: Column, n_in: int, ratio: float) -> Column:
    """An array on ceil(n * ratio) evenly spaced points from its first to its last sample, linear between samples."""
    n = max(1, -(-int(n_in * ratio * 1e9) // 10**9))
    step = (n_in - 1) / (n - 1) if n > 1 else 0.0

    def at(i: Column) -> Column:
        place = F.least(i * F.lit(float(step)), F.lit(float(n_in - 1)))
        low = F.floor(place).cast("int")
        y0, y1 = F.get(values, low), F.coalesce(F.get(values, low + 1), F.get(values, low))
        return y0 + (y1 - y0) * (place - low)

    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), at)


def frame_order(df: DataFrame, run: str, file: str) -> DataFrame:
    """Frame numbers from the order of file names in each run; run sizes differ only if the caller lets them."""
    return df.withColumn("frame", F.row_number().over(W.partitionBy(run).orderBy(file)) - 1)


def background(df: DataFrame, masks: DataFrame, *, stack: str = "stack", frame: str = "frame", pixel: str = "pixel", value: str = "v") -> DataFrame:
    """(stack, frame, level) over the pixels that no unit covers."""
    return df.join(masks.select(stack, pixel).distinct(), [stack, pixel], "left_anti").groupBy(stack, frame).agg(F.avg(value).alias("level"))
