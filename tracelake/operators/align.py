"""Joins of tables of different grain, alignment and interpolation along an index.

Keys that are null match nothing; null samples are left out of interpolation and means; x
values outside the data give null. Empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def expand(fine: DataFrame, coarse: DataFrame, on: list[str], prefix: str = "", *, strict: bool = False) -> DataFrame:
    """``fine`` with the columns of ``coarse``; which side is sent round is left to the optimizer.

    ``strict``: a key that ``coarse`` has twice, or not at all for a row of ``fine``, raises as
    the plan runs, so that each coarse row stands for whole groups of fine ones.
    """
    named = coarse.select(*on, *[F.col(c).alias(prefix + c) for c in coarse.columns if c not in on])
    if not strict:
        return fine.join(named, on, "left")
    own = [c for c in named.columns if c not in on]
    once = named.groupBy(*on).agg(F.count("*").alias("__n"), F.first(F.struct(*own) if own else F.lit(0)).alias("__row"))
    met = fine.join(once, on, "left").withColumn("__ok", F.when(F.coalesce("__n", F.lit(0)) == 1, True).otherwise(F.raise_error(F.lit("a key of the fine table is not in the coarse one, or several times")).cast("boolean")))
    return met.filter("__ok").select(*fine.columns, *[F.col("__row").getField(c).alias(c) for c in own])


def align_at(df: DataFrame, keys: list[str], value: str, first: int, stop: int, *, frame: str = "frame") -> DataFrame:
    """Traces less their mean over frames [first, stop)."""
    reference = F.avg(F.when((F.col(frame) >= first) & (F.col(frame) < stop), F.col(value)))
    return df.withColumn(value, F.col(value) - reference.over(W.partitionBy(*keys)))


def category_offsets(df: DataFrame, by: str, value: str, gap: float = 0.2, *, ascending: bool = True) -> DataFrame:
    """(by, offset): stacks categories by the range of each and a share of the mean range, the first or else the last one at the bottom."""
    # one row a category from here on
    ranges = df.groupBy(by).agg((F.max(value) - F.min(value)).alias("r"))
    step = F.col("r") + gap * F.avg("r").over(W.partitionBy())
    before = W.orderBy(by if ascending else F.desc(by)).rowsBetween(W.unboundedPreceding, -1)
    return ranges.withColumn("step", step).select(by, F.coalesce(F.sum("step").over(before), F.lit(0.0)).alias("offset"))


def interpolate_at(df: DataFrame, points: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """``y`` at the x of ``points`` (keys, x), linear between neighbours; null outside the data."""
    both = df.select(*keys, x, F.col(y).alias("__y"), F.lit(False).alias("__point")).unionByName(points.select(*keys, x, F.lit(None).cast("double").alias("__y"), F.lit(True).alias("__point")))
    run = W.partitionBy(*keys).orderBy(x)
    known = F.when(F.col("__y").isNotNull(), F.struct(F.col(x).alias("x"), F.col("__y").alias("y")))
    left = F.last(known, True).over(run.rangeBetween(W.unboundedPreceding, 0))
    right = F.first(known, True).over(run.rangeBetween(0, W.unboundedFollowing))
    marked = both.withColumns({"__l": left, "__r": right}).filter("__point")
    span = F.col("__r.x") - F.col("__l.x")
    blend = F.col("__l.y") + (F.col("__r.y") - F.col("__l.y")) * (F.col(x) - F.col("__l.x")) / F.when(span != 0, span)
    return marked.select(*keys, x, F.when(F.col("__l").isNull() | F.col("__r").isNull(), None).when(span == 0, F.col("__l.y")).otherwise(blend).alias(y))


def grid(df: DataFrame, keys: list[str], x: str, step: float) -> DataFrame:
    """(keys, x): a uniform grid over each group's range."""
    ends = df.groupBy(*keys).agg(F.min(x).alias("a"), F.max(x).alias("b"))
    n = F.floor((F.col("b") - F.col("a")) / step + 1e-9).cast("int")
    return ends.select(*keys, F.explode(F.transform(F.sequence(F.lit(0), n), lambda i: F.col("a") + i * step)).alias(x))


def shared_grid(df: DataFrame, keys: list[str], x: str, n: int) -> DataFrame:
    """(keys, x): the same ``n`` even points over the range of all groups for each group; outside a group's own data its values are null."""
    ends = df.agg(F.min(x).alias("a"), F.max(x).alias("b")).filter("a is not null")  # one row
    points = ends.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.col("a") + (F.col("b") - F.col("a")) * i / max(1, n - 1))).alias(x))
    return df.select(*keys).distinct().crossJoin(F.broadcast(points))


def resample(df: DataFrame, keys: list[str], x: str, y: str, step: float) -> DataFrame:
    return interpolate_at(df, grid(df, keys, x, step), keys, x, y)


def shift(value: str, by: int, keys: list[str], order: str) -> Column:
    """The value ``by`` rows earlier, null at the border."""
    return F.lag(value, by).over(W.partitionBy(*keys).orderBy(order))


def stretch(values: Column, factor: float) -> Column:
    """An array stretched about its start, linear between samples, null past the end."""
    def at(_: Column, i: Column) -> Column:
        place = i / factor
        low = F.floor(place).cast("int")
        y0, y1 = F.get(values, low), F.get(values, low + 1)
        return F.when(place == low, y0).otherwise(y0 + (y1 - y0) * (place - low))
    return F.transform(values, at)


def pairwise(df: DataFrame, index: list[str], category: str, value: str, metric) -> DataFrame:
    """(a, b, metric) over all ordered pairs of categories; ``metric(x, y)`` aggregates shared index rows and is antisymmetric."""
    a = df.select(*index, F.col(category).alias("a"), F.col(value).alias("__x"))
    b = df.select(*index, F.col(category).alias("b"), F.col(value).alias("__y"))
    half = a.join(b, index).filter("a < b").groupBy("a", "b").agg(metric(F.col("__x"), F.col("__y")).alias("metric"))
    return half.unionByName(half.select(F.col("b").alias("a"), F.col("a").alias("b"), (-F.col("metric")).alias("metric")))


def nearest(df: DataFrame, wanted: list[float], keys: list[str], x: str) -> DataFrame:
    """(keys, wanted, x): the element next to each wanted value, the smaller of two; nulls are left out."""
    return df.filter(F.col(x).isNotNull()).withColumn("wanted", F.explode(F.array(*[F.lit(float(w)) for w in wanted]))).groupBy(*keys, "wanted").agg(
        F.min(F.struct(F.abs(F.col(x) - F.col("wanted")).alias("d"), F.col(x).alias("x"))).alias("__b")
    ).select(*keys, "wanted", F.col("__b.x").alias(x))
