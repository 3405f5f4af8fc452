"""Index arithmetic, densifying, pulse timing and pivots.

Nulls stay null; null keys are keys of their own in groups and match nothing in joins.
Empty tables give empty tables, or one row of zeros where a table is described as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def time_of(frame: Column, reference: int, rate: float) -> Column:
    return (frame - reference) / F.lit(float(rate))


def experiment_index(frame: Column, trial: Column, n_frames: int, n_trials: int | None = None, run: Column | None = None) -> Column:
    """Frame counted along the run, or along the experiment if runs are given."""
    index = trial * n_frames + frame
    return index if run is None else index + run * n_frames * n_trials


def densify(df: DataFrame, keys: list[str], within: list[str], values: list[str]) -> DataFrame:
    """Every combination of the keys that occur, with nulls where ``df`` has no row; combinations stay inside ``within``."""
    axes = [k for k in keys if k not in within]
    full = df.select(*within, axes[0]).distinct()
    for axis in axes[1:]:
        full = full.join(df.select(*within, axis).distinct(), within)
    return full.join(df.select(*keys, *values), keys, "left")


def is_rectilinear(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row: do the rows fill the product of their key values?"""
    product = F.count_distinct(keys[0])
    for k in keys[1:]:
        product = product * F.count_distinct(k)
    return df.agg((product == F.count("*")).alias("rectilinear"))


def describe_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.agg(*[F.count_distinct(k).alias(k) for k in keys])


def repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def repeat(df: DataFrame, name: str, values: list) -> DataFrame:
    return df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))


def pulse_times(duration: float, rate: float, duty_cycle: float, onset: float = 0.0) -> Column:
    """Array of (on, off) times; the duty cycle is in percent."""
    n = max(1, round(duration * rate))
    return F.array(*[F.struct(F.lit(onset + k / rate).alias("on"), F.lit(onset + (k + duty_cycle / 100) / rate).alias("off")) for k in range(n)])


def in_pulse(t: Column, duration: float, rate: float, duty_cycle: float, onset: float = 0.0) -> Column:
    """Is the stimulus on at ``t``?"""
    since = t - onset
    return (since >= 0) & (since < duration) & (F.pmod(since, F.lit(1 / rate)) <= duty_cycle / 100 / rate)


def split_pulses(df: DataFrame, keys: list[str], value: str, t: str, duration: float, rate: float, *, onset: float | str = 0.0) -> DataFrame:
    """Samples inside the stimulus with their pulse, the time since its start, and the value under the pulse's maximum.

    ``onset``: the stimulus' start, or the column that has it, such as a dataset's trigger
    delay; samples without one are outside.
    """
    since = F.col(t) - (F.col(onset) if isinstance(onset, str) else F.lit(float(onset)))
    inside = df.withColumn("__t", since).filter((F.col("__t") >= 0) & (F.col("__t") < duration)).withColumn("pulse", F.floor(F.col("__t") * rate).cast("int"))
    top = F.max(value).over(W.partitionBy(*keys, "pulse"))
    return inside.withColumns({"since": F.col("__t") - F.col("pulse") / rate, value: F.col(value) - top}).drop("__t")


def stat_table(df: DataFrame, row: str, column: str, value: str) -> DataFrame:
    """(row, column, mean) with the marginal means as rows of null keys."""
    return df.cube(row, column).agg(F.avg(value).alias("mean"))


def sorted_stat_table(df: DataFrame, row: str, column: str, value: str, *, agg=F.median, spread: bool = False) -> DataFrame:
    """(row, column, level, row_place, column_place): an aggregate by two keys, or with ``spread`` its coefficient of variation, and places by falling aggregates of rows and columns.

    Places count from 0; keys of equal aggregates are in their own order.
    """
    of = (lambda c: F.try_divide(F.stddev_samp(c), F.avg(c))) if spread else (lambda c: agg(F.col(c)))
    table = df.groupBy(row, column).agg(of(value).alias("level"))
    for key, place in ((row, "row_place"), (column, "column_place")):
        margin = df.groupBy(key).agg(of(value).alias("__m"))  # one row a key
        ranked = margin.withColumn(place, F.row_number().over(W.orderBy(F.desc_nulls_last("__m"), key)) - 1).drop("__m")
        table = table.join(ranked, key)
    return table.select(row, column, "level", "row_place", "column_place")


def matrix_rows(df: DataFrame, row: str, position: str, value: str) -> DataFrame:
    """A row's values as an array in order of ``position``."""
    return df.groupBy(row).agg(F.transform(F.array_sort(F.collect_list(F.struct(position, value))), lambda s: s[value]).alias(value))


def long_rows(df: DataFrame, keys: list[str], values: str, position: str = "frame") -> DataFrame:
    return df.select(*keys, F.posexplode(values).alias(position, "value"))
