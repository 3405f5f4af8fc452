"""Operators along the frames of a trace.

Frames are unique in a trace. Null samples are left out of rolling and grouped aggregates
and stay null under shifts and differences; borders are null unless mirrored. Ties go to the
first frame. Empty tables give empty tables.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _mirrored(df: DataFrame, keys: list[str], value: str, half: int, frame: str, length: int) -> DataFrame:
    """Rows plus copies of the border rows reflected outside, so that rolling windows are complete."""
    own = F.array(F.col(frame))
    low = F.when(F.col(frame) < half, F.array(-1 - F.col(frame))).otherwise(F.array().cast("array<int>"))
    high = F.when(F.col(frame) >= length - half, F.array(2 * length - 1 - F.col(frame))).otherwise(F.array().cast("array<int>"))
    return df.select(*keys, value, F.explode(F.concat(own, low, high)).alias(frame))


def rolling(df: DataFrame, keys: list[str], value: str, width: int, agg, length: int, *, frame: str = "frame", out: str | None = None) -> DataFrame:
    """``agg`` over a centred window with symmetric borders; an even ``width`` counts as one less; frames run from 0 to ``length`` - 1."""
    half = (width - 1) // 2
    run = W.partitionBy(*keys).orderBy(frame).rowsBetween(-half, half)
    wide = _mirrored(df, keys, value, half, frame, length).withColumn("__out", agg(F.col(value)).over(run))
    return wide.filter(F.col(frame).between(0, length - 1)).select(*keys, frame, *([value] if out and out != value else []), F.col("__out").alias(out or value))


def rolling_quantile(df: DataFrame, keys: list[str], value: str, width: int, q: float, length: int, **names) -> DataFrame:
    return rolling(df, keys, value, width, lambda v: F.percentile(v, F.lit(q)), length, **names)


def maximin(df: DataFrame, keys: list[str], value: str, width: int, length: int) -> DataFrame:
    """Rolling minimum, then rolling maximum of it."""
    return rolling(rolling(df, keys, value, width, F.min, length), keys, value, width, F.max, length)


def relative_change(df: DataFrame, value: str, baseline: str, out: str = "dff") -> DataFrame:
    return df.withColumn(out, (F.col(value) - F.col(baseline)) / F.col(baseline))


def z_score(value: str, by: list[str]) -> Column:
    run = W.partitionBy(*by)
    return (F.col(value) - F.avg(value).over(run)) / F.stddev_samp(value).over(run)


def velocity(df: DataFrame, keys: list[str], x: str, y: str, rate: float, scale: float = 1.0, *, frame: str = "frame", substituted: Column | None = None) -> DataFrame:
    """Absolute change of the distance from the origin per second; substituted frames take the value before, a first frame has none."""
    run = W.partitionBy(*keys).orderBy(frame)
    moved = df.withColumn("__d", F.hypot(x, y) * scale)
    step = F.abs(F.col("__d") - F.lag("__d").over(run))
    moved = moved.withColumn("__s", step if substituted is None else F.when(~substituted, step))
    return moved.withColumn("velocity", F.last("__s", True).over(run) * rate).drop("__d", "__s")


def cross_correlation(a: DataFrame, b: DataFrame, keys: list[str], value: str, max_lag: int, *, frame: str = "frame") -> DataFrame:
    """(keys, lag, corr): products of ``a`` at a frame and ``b`` ``lag`` frames before, summed and divided by the length of ``a``.

    A positive lag says that ``a`` comes after ``b``. Null values count as zeros. Each pair
    of traces is gathered once; a lag is one product of two arrays.
    """
    def gathered(df: DataFrame, name: str) -> DataFrame:
        ordered = F.array_sort(F.collect_list(F.struct(F.col(frame).cast("long").alias("f"), F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("v"))))
        return df.filter(F.col(frame).isNotNull()).groupBy(*keys).agg(ordered.alias(name))

    both = gathered(a, "__a").join(gathered(b, "__b"), keys)
    rows = both.select(*keys, *[F.col(f"__{n}").getField(c).alias(f"__{n}{c}") for n in "ab" for c in "fv"])
    kinds, lags = dict(both.dtypes), np.arange(-max_lag, max_lag + 1, dtype=np.int32)

    def lagged(fa: list[int], va: list[float], fb: list[int], vb: list[float]) -> np.ndarray:
        first, n = min(fa[0], fb[0]), max(fa[-1], fb[-1]) - min(fa[0], fb[0]) + 1
        x, y = np.zeros(n + 2 * max_lag), np.zeros(n)
        np.add.at(x, np.array(fa) - first + max_lag, va)
        y[np.array(fb) - first] = vb
        return np.correlate(x, y, "valid") / len(fa)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [lagged(*row) for row in zip(*(batch.column(len(keys) + k).to_pylist() for k in range(4)), strict=True)]
            index = pa.array(np.repeat(np.arange(len(found)), len(lags)))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k).take(index) for k in range(len(keys))), pa.array(np.tile(lags, len(found))), pa.array(np.concatenate(found) if found else np.zeros(0))], names=[*keys, "lag", "corr"]
            )

    return rows.mapInArrow(run, ", ".join([f"`{k}` {kinds[k]}" for k in keys] + ["lag int, corr double"]))


def best_lag(correlations: DataFrame, keys: list[str]) -> DataFrame:
    """The lag of the largest correlation, the smallest of several."""
    return correlations.groupBy(*keys).agg(F.max(F.struct("corr", (-F.col("lag")).alias("l"))).alias("__b")).select(*keys, (-F.col("__b.l")).alias("lag"), F.col("__b.corr").alias("corr"))


def cyclic_shift(df: DataFrame, keys: list[str], n: int, length: int, *, frame: str = "frame") -> DataFrame:
    return df.withColumn(frame, F.pmod(F.col(frame) + n, F.lit(length)).cast("int"))


def seeded_shuffle(df: DataFrame, keys: list[str], value: str, seed: int, *, frame: str = "frame") -> DataFrame:
    """A permutation of each trace's values that only depends on the keys and the seed."""
    dealt = df.withColumn("__r", F.row_number().over(W.partitionBy(*keys).orderBy(F.md5(F.concat_ws("|", F.lit(seed), *keys, frame)), frame)))
    places = df.select(*keys, frame).withColumn("__r", F.row_number().over(W.partitionBy(*keys).orderBy(frame)))
    return places.join(dealt.select(*keys, "__r", value), [*keys, "__r"]).select(*keys, frame, value)


def align_ranks(df: DataFrame, reference: DataFrame, keys: list[str], value: str, *, frame: str = "frame") -> DataFrame:
    """The reference's values in the rank order of ``df``."""
    run = W.partitionBy(*keys)
    ranked = df.withColumn("__r", F.row_number().over(run.orderBy(value, frame))).drop(value)
    given = reference.select(*keys, value, F.row_number().over(run.orderBy(value, frame)).alias("__r"))
    return ranked.join(given, [*keys, "__r"]).drop("__r")


def substitute(df: DataFrame, keys: list[str], value: str, moves: dict[int, int], *, frame: str = "frame") -> DataFrame:
    """Frames take the value of their source (destination: source); all reads come before the writes."""
    source = F.create_map(*[F.lit(x) for pair in moves.items() for x in pair])[F.col(frame)]
    given = df.select(*keys, F.col(frame).alias("__source"), F.col(value).alias("__value"))
    wanted = df.withColumn("__source", F.coalesce(source, F.col(frame)))
    return wanted.join(given, [*keys, "__source"], "left").withColumn(value, F.col("__value")).drop("__value", "__source")


def denoise(df: DataFrame, keys: list[str], value: str, gain: float, *, frame: str = "frame", keep_gaps: bool = False) -> DataFrame:
    """(keys, frame, value): recursive denoiser, x <- G x + (1 - G) y + (y - x) / (t + 1) from the second sample on.

    Null samples are left out; if ``keep_gaps``, they keep their rows and count for t, and the
    estimate is carried over them.
    """
    from tracelake.operators.kernels import per_trace

    def kernel(y: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
        out, x = np.empty(len(y)), 0.0
        for t, v in enumerate(y.tolist()):
            x = v if t == 0 else gain * x + (1 - gain) * v + (v - x) / (t + 1)
            out[t] = x
        return {frame: at, value: out}

    def gapped(y: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
        out, x = np.full(len(y), np.nan), None
        for t, v in enumerate(y.tolist()):
            if v != math.inf:
                x = v if x is None else gain * x + (1 - gain) * v + (v - x) / (t + 1)
                out[t] = x
        return {frame: at, value: out}

    columns = {frame: dict(df.dtypes)[frame], value: "double"}
    if not keep_gaps:
        return per_trace(df, keys, value, kernel, columns, frame=frame)
    marked = df.withColumn(value, F.when(F.col(value).isNull() | F.isnan(value), math.inf).otherwise(F.col(value)))
    return per_trace(marked, keys, value, gapped, columns, frame=frame).withColumn(value, F.nanvl(value, F.lit(None).cast("double")))


def peaks(df: DataFrame, keys: list[str], value: str, *, frame: str = "frame") -> DataFrame:
    """The highest interior local maximum of each trace, the first of several."""
    run = W.partitionBy(*keys).orderBy(frame)
    tops = df.withColumns({"__a": F.lag(value).over(run), "__b": F.lead(value).over(run)}).filter((F.col(value) > F.col("__a")) & (F.col(value) > F.col("__b")))
    return tops.groupBy(*keys).agg(F.max(F.struct(F.col(value).alias("v"), (-F.col(frame)).alias("f"))).alias("__p")).select(*keys, (-F.col("__p.f")).alias(frame), F.col("__p.v").alias(value))


def trajectory_angles(df: DataFrame, keys: list[str], point: str, *, frame: str = "frame") -> DataFrame:
    """Angle between successive difference vectors of an array-valued trajectory."""
    run = W.partitionBy(*keys).orderBy(frame)
    steps = df.withColumn("__d", F.zip_with(point, F.lag(point).over(run), lambda a, b: a - b))
    pair = steps.withColumn("__e", F.lag("__d").over(run)).filter(F.col("__d").isNotNull() & F.col("__e").isNotNull())
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    cos = dot("__d", "__e") / F.sqrt(dot("__d", "__d") * dot("__e", "__e"))
    return pair.select(*keys, frame, F.acos(F.greatest(F.least(cos, F.lit(1.0)), F.lit(-1.0))).alias("angle"))


def centre_frames(df: DataFrame, stack: str, frame: str, value: str, agg) -> DataFrame:
    """Take each frame's ``agg`` (less the mean over frames) off its values."""
    levels = df.groupBy(stack, frame).agg(agg(F.col(value)).alias("__level"))
    mean = levels.groupBy(stack).agg(F.avg("__level").alias("__mean"))
    return df.join(levels, [stack, frame]).join(mean, stack).withColumn(value, F.col(value) - (F.col("__level") - F.col("__mean"))).drop("__level", "__mean")


def energy(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, energy): sum of squares."""
    return df.groupBy(*keys).agg(F.sum(F.col(value) * F.col(value)).alias("energy"))


def profile(df: DataFrame, keys: list[str], value: str, pre: tuple[int, int], *, frame: str = "frame", relative: bool = True) -> DataFrame:
    """(keys, frame, value, z): change from the mean over a half-open frame window, over that mean if ``relative``, and its z-score."""
    run = W.partitionBy(*keys)
    base = F.avg(F.when((F.col(frame) >= pre[0]) & (F.col(frame) < pre[1]), F.col(value))).over(run)
    change = (F.col(value) - base) / (base if relative else F.lit(1.0))
    out = df.select(*keys, frame, change.alias(value))
    return out.withColumn("z", (F.col(value) - F.avg(value).over(run)) / F.stddev_pop(value).over(run))


def segments(df: DataFrame, keys: list[str], value: str, width: int, hop: int, length: int, *, frame: str = "frame") -> DataFrame:
    """(keys, segment, place, value): overlapping segments of a trace, a row dealt to each segment that holds it."""
    first = F.greatest(F.ceil((F.col(frame) - width + 1) / hop), F.lit(0)).cast("int")
    last = F.least(F.floor(F.col(frame) / hop), F.lit((length - width) // hop)).cast("int")
    wide = df.filter(first <= last).withColumn("segment", F.explode(F.sequence(first, last)))
    return wide.select(*keys, "segment", (F.col(frame) - F.col("segment") * hop).cast("int").alias("place"), value)


def tapered(df: DataFrame, value: str, width: int, taper: float = 0.25, *, place: str = "place") -> DataFrame:
    """Segment values under a window that is flat but for cosine slopes over ``taper`` of its length."""
    edge = taper * (width - 1) / 2
    k = F.least(F.col(place), F.lit(width - 1) - F.col(place))
    weight = F.when(k < edge, 0.5 * (1 - F.cos(math.pi * k / edge))).otherwise(1.0) if edge > 0 else F.lit(1.0)
    return df.withColumn(value, F.col(value) * weight)
