"""Row selection: bounds, validity, exclusion, quantiles.

Null values match no condition, so their rows go; null flags count as not set; quantiles and
medians leave nulls out. Repeated rows are selected alike; ties go to the smallest key.
Empty tables give empty tables.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MIN_VALID_TRIALS = 5


def filter_data(df: DataFrame, *, bounds: dict[str, tuple] | None = None, **values) -> DataFrame:
    """Rows with the given value, or one of the given values, per column and within inclusive ``bounds``."""
    for name, wanted in values.items():
        df = df.filter(F.col(name).isin(*wanted) if isinstance(wanted, (list, tuple, set)) else F.col(name) == wanted)
    for name, (low, high) in (bounds or {}).items():
        df = df.filter(F.col(name).between(low, high))
    return df


def missing_values(df: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Requested key values that ``df`` doesn't have."""
    return wanted.select(key).distinct().join(df.select(key).distinct(), key, "left_anti")


def discard(df: DataFrame, key: str, values: list) -> DataFrame:
    return df.filter(~F.col(key).isin(*values)) if values else df


def sweep(df: DataFrame, x: str, *, p: str, dc: str, p_ref: float, dc_ref: float, add_zero_dc: bool = False) -> DataFrame:
    """The rows of a parameter sweep: ``x`` varies, the other parameter stays at its reference."""
    if x == p:
        return df.filter(F.col(dc) == dc_ref)
    out = df.filter(F.col(p) == p_ref)
    if add_zero_dc:
        zero = df.filter(F.col(p) == 0).withColumns({p: F.lit(p_ref), dc: F.lit(0.0)})
        out = out.unionByName(zero.select(out.columns))
    return out


def exclude_matching(df: DataFrame, patterns: list[str], key: str = "dataset") -> DataFrame:
    """Without the rows whose key contains one of ``patterns``."""
    if not patterns:
        return df
    return df.filter(~reduce(lambda a, b: a | b, [F.coalesce(F.contains(F.col(key), F.lit(x)), F.lit(False)) for x in patterns]))


def with_validity(df: DataFrame, flags: list[str], condition: list[str], min_trials: int = MIN_VALID_TRIALS) -> DataFrame:
    """Adds ``valid``: no exclusion flag is set, and the condition has ``min_trials`` such rows."""
    clean = ~reduce(lambda a, b: a | b, [F.coalesce(F.col(f), F.lit(False)) for f in flags])
    n = F.sum(clean.cast("int")).over(W.partitionBy(*condition))
    return df.withColumn("valid", clean & (n >= min_trials))


def valid_rows(df: DataFrame, flags: list[str], condition: list[str], min_trials: int = MIN_VALID_TRIALS) -> DataFrame:
    return with_validity(df, flags, condition, min_trials).filter("valid").drop("valid", *flags)


def subset(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """The rows of ``df`` whose keys are in ``keys``."""
    return df.join(keys.select(on).distinct(), on, "left_semi")


def remove_frames(df: DataFrame, first: int, last: int, frame: str = "frame") -> DataFrame:
    return df.filter(~F.col(frame).between(first, last))


def quantile_slice(df: DataFrame, value: str, q_min: float, q_max: float, by: list[str]) -> DataFrame:
    """Rows between two quantiles of their group, both included."""
    edges = df.groupBy(*by).agg(F.percentile(value, F.lit(q_min)).alias("__low"), F.percentile(value, F.lit(q_max)).alias("__high"))
    return df.join(edges, by).filter(F.col(value).between(F.col("__low"), F.col("__high"))).drop("__low", "__high")


def closest_to_median(df: DataFrame, value: str, key: str, by: list[str]) -> DataFrame:
    """Each group's key with the value next to the median, the smallest of several; nulls are left out."""
    df = df.filter(F.col(value).isNotNull())
    median = df.groupBy(*by).agg(F.median(value).alias("__median"))
    return df.join(median, by).groupBy(*by).agg(F.min(F.struct(F.abs(F.col(value) - F.col("__median")).alias("d"), F.col(key).alias("k"))).alias("__best")).select(
        *by, F.col("__best.k").alias(key)
    )


def exclude_outliers(df: DataFrame, value: str, k: float, by: list[str]) -> DataFrame:
    """Rows less than ``k`` standard deviations from their group's median."""
    stats = df.groupBy(*by).agg(F.median(value).alias("__m"), F.stddev_samp(value).alias("__s"))
    near = F.abs(F.col(value) - F.col("__m")) < k * F.col("__s")
    return df.join(stats, by).filter(near).drop("__m", "__s")


def above_group_quantile(df: DataFrame, value: str, q: float, by: list[str]) -> DataFrame:
    edge = df.groupBy(*by).agg(F.percentile(value, F.lit(q)).alias("__q"))
    return df.join(edge, by).filter(F.col(value) > F.col("__q")).drop("__q")


def sign_intervals(df: DataFrame, value: str, order: str, by: list[str]) -> DataFrame:
    """(by, start, end, sign) of runs of two or more rows of one sign."""
    run = W.partitionBy(*by).orderBy(order)
    marked = df.withColumn("sign", F.signum(value).cast("int"))
    marked = marked.withColumn("__turn", F.coalesce((F.col("sign") != F.lag("sign").over(run)).cast("int"), F.lit(0)))
    islands = marked.withColumn("__island", F.sum("__turn").over(run))
    return islands.groupBy(*by, "__island", "sign").agg(F.min(order).alias("start"), F.max(order).alias("end"), F.count("*").alias("n")).filter("n > 1").select(
        *by, "start", "end", "sign"
    )


def unstable_groups(df: DataFrame, value: str, group: str, run: str, order: Column, limit: float = 0.5) -> DataFrame:
    """Groups whose run medians, relative to the first run's, stray from their mean by more than ``limit``.

    The first run's median cancels out, so that medians are compared with their own sum: one
    division, which no order of adding whole or half numbers changes, decides at the limit.
    Groups whose first median or sum is zero have no deviation.
    """
    medians = df.groupBy(group, run).agg(F.median(value).alias("m"), F.min(order).alias("o"))
    first = medians.groupBy(group).agg(F.min_by("m", F.struct("o", run)).alias("m0"), F.sum("m").alias("s"), F.count("m").alias("n"))
    strays = medians.join(first.filter((F.col("m0") != 0) & (F.col("s") != 0)), group)
    return strays.groupBy(group).agg(F.max(F.abs(F.col("n") * F.col("m") - F.col("s")) / F.abs("s")).alias("deviation")).filter(F.col("deviation") > limit)
