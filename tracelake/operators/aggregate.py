"""Windowed, trial, population and cross-dataset aggregates.

Nulls are left out of all aggregates, and a group of nulls has a null result; deviations of
one value are null; ties are settled by the stated order, else by the smallest key. Empty
tables give empty tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

Aggregate = Callable[[Column], Column]


def in_window(df: DataFrame, keys: list[str], value: str, first: int, stop: int, agg: Aggregate = F.avg, *, frame: str = "frame", inclusive_stop: bool = False) -> DataFrame:
    """``agg`` of ``value`` over frames [first, stop) of each trace."""
    inside = (F.col(frame) >= first) & ((F.col(frame) <= stop) if inclusive_stop else (F.col(frame) < stop))
    return df.filter(inside).groupBy(*keys).agg(agg(F.col(value)).alias(value))


def weighted_in_window(df: DataFrame, keys: list[str], value: str, weights: dict[int, float], *, frame: str = "frame") -> DataFrame:
    """Weighted average over the frames that have a weight."""
    weight = F.create_map(*[x for k, w in weights.items() for x in (F.lit(k), F.lit(float(w)))])[F.col(frame)]
    return df.filter(F.col(frame).isin(*weights)).groupBy(*keys).agg((F.sum(F.col(value) * weight) / F.sum(weight)).alias(value))


def evoked_change(df: DataFrame, keys: list[str], value: str, pre: tuple[int, int], post: tuple[int, int], *, frame: str = "frame") -> DataFrame:
    """(keys, pre, post, change): means over two half-open frame windows in one pass."""
    def mean(window: tuple[int, int]) -> Column:
        return F.avg(F.when((F.col(frame) >= window[0]) & (F.col(frame) < window[1]), F.col(value)))
    return df.groupBy(*keys).agg(mean(pre).alias("pre"), mean(post).alias("post")).withColumn("change", F.col("post") - F.col("pre"))


def along(df: DataFrame, keys: list[str], value: str, agg: Aggregate = F.avg) -> DataFrame:
    """Aggregate ``value`` over every key not in ``keys``."""
    return df.groupBy(*keys).agg(agg(F.col(value)).alias(value))


def trial_aggregated(df: DataFrame, keys: list[str], values: list[str], *, z_scores: list[str] = (), texts: list[str] = (), agg: Aggregate = F.avg) -> DataFrame:
    """Aggregate over trials; z-scores times the square root of the trial count; texts that vary become null."""
    return df.groupBy(*keys).agg(
        *[agg(F.col(v)).alias(v) for v in values],
        *[(F.avg(z) * F.sqrt(F.count(z))).alias(z) for z in z_scores],
        *[F.when(F.count_distinct(t) == 1, F.max(t)).alias(t) for t in texts],
        F.count("*").alias("n_trials"),
    )


def repeated_values(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """(column, repeated): does a value stay the same over the trials of every group? Groups of one trial say nothing against it."""
    at = {v: f"__{k}" for k, v in enumerate(values)}
    # not by a deviation: merged from partial ones, it may be above zero for a value that stays the same
    spread = df.groupBy(*keys).agg(*[(F.min(v) < F.max(v)).alias(a) for v, a in at.items()]).agg(*[F.coalesce(F.bool_or(a), F.lit(False)).alias(a) for a in at.values()])
    return spread.select(F.explode(F.array(*[F.struct(F.lit(v).alias("column"), (~F.col(a)).alias("repeated")) for v, a in at.items()])).alias("r")).select("r.*")


def trial_means_resolved(df: DataFrame, keys: list[str], values: list[str], close: dict[str, float], *, digits: int = 8, **how) -> DataFrame:
    """``trial_aggregated`` with the columns of ``close`` resolved: aggregates nearer than the given gap to the next become their mean, rounded.

    ``close`` names settings with a few levels, such as doses, so their distinct aggregates are few.
    """
    out = trial_aggregated(df, keys, [*values, *close], **how)
    for c, gap in close.items():
        levels = out.select(c).distinct().filter(F.col(c).isNotNull())
        run = W.orderBy(c)
        turns = levels.withColumn("__g", F.sum(F.coalesce((F.col(c) - F.lag(c).over(run) > gap).cast("int"), F.lit(0))).over(run))
        means = turns.groupBy("__g").agg(F.avg(c).alias("__m"))
        out = out.join(turns.join(means, "__g").select(c, "__m"), c, "left").withColumn(c, F.round("__m", digits)).drop("__m")
    return out


def weighted_average(df: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    return df.groupBy(*keys).agg((F.sum(F.col(value) * F.col(weight)) / F.sum(weight)).alias(value))


def across_datasets(df: DataFrame, x: list[str], value: str, *, dataset: str = "dataset", unit: str = "roi", error: str = "intra", weighted: bool = True) -> DataFrame:
    """(x, mean, sem, n_datasets): dataset means averaged with unit-count weights.

    ``error``: ``intra`` is the root of the weighted mean of the datasets' squared standard
    errors, ``inter`` the standard error of their means. ``x`` may hold a hue beside the input.
    """
    each = df.groupBy(*x, dataset).agg(
        F.avg(value).alias("m"), (F.stddev_samp(value) / F.sqrt(F.count(value))).alias("s"), F.count_distinct(unit).alias("units")
    ).withColumn("w", F.col("units") if weighted else F.lit(1))
    mean = F.sum(F.col("m") * F.col("w")) / F.sum("w")
    intra = F.sqrt(F.sum(F.col("w") * F.col("s") * F.col("s")) / F.sum("w"))
    inter = F.stddev_samp("m") / F.sqrt(F.count("m"))
    return each.groupBy(*x).agg(mean.alias("mean"), (intra if error == "intra" else inter).alias("sem"), F.count("*").alias("n_datasets"))


def across_datasets_with_all(df: DataFrame, x: list[str], hue: str, value: str, *, name: str = "all", **options) -> DataFrame:
    """(x, hue, mean, sem, n_datasets) for each hue, and over all rows under the hue ``name``."""
    each = across_datasets(df, [*x, hue], value, **options)
    whole = across_datasets(df, x, value, **options).withColumn(hue, F.lit(name))
    return each.withColumn(hue, F.col(hue).cast("string")).unionByName(whole)


def responder_counts(df: DataFrame, x: list[str], kind: str, kinds: list[str], *, normalize: bool = False) -> DataFrame:
    """One column a response kind: counts, or shares of the group."""
    out = df.groupBy(*x).agg(*[F.count_if(F.col(kind) == k).alias(k) for k in kinds], F.count(kind).alias("total"))
    return out.select(*x, *[(F.col(k) / F.col("total")).alias(k) for k in kinds], "total") if normalize else out


def responder_shares(df: DataFrame, x: str, units: list[str], kind: str, kinds: list[str]) -> DataFrame:
    """(x, units, a share a kind, count, weight): shares of each unit at each x, and the unit's share of the rows there."""
    counts = responder_counts(df.filter(F.col(kind).isNotNull()), [x, *units], kind, kinds, normalize=True)
    whole = counts.groupBy(x).agg(F.sum("total").alias("__all"))
    return counts.join(whole, x).select(x, *units, *kinds, F.col("total").alias("count"), (F.col("total") / F.col("__all")).alias("weight"))


def responder_fractions(df: DataFrame, x: str, dataset: str, group: str, kind: str, hit: str = "positive") -> DataFrame:
    """(group, x, mean, sem, datasets): share of ``hit`` rows by group and over all of them (group ``all``).

    Datasets' shares are averaged by their rows at each x; the error is over datasets, unweighted.
    """
    each = df.withColumn("__g", F.explode(F.array(F.col(group).cast("string"), F.lit("all")))).filter("__g is not null")
    shares = responder_shares(each.withColumn("__x", F.struct("__g", F.col(x))), "__x", [dataset], kind, [hit])
    out = shares.groupBy("__x").agg(F.sum(F.col(hit) * F.col("weight")).alias("mean"), (F.stddev_samp(hit) / F.sqrt(F.count(hit))).alias("sem"), F.count(hit).alias("datasets"))
    return out.select(F.col("__x.__g").alias(group), F.col(f"__x.`{x}`").alias(x), "mean", "sem", "datasets")


def responder_totals(df: DataFrame, dataset: str, kind: str, kinds: list[str], unit: str = "roi") -> DataFrame:
    """Units of each kind by dataset, and a TOTAL row."""
    units = df.select(dataset, unit, kind).distinct()
    return units.rollup(dataset).agg(*[F.count_if(F.col(kind) == k).alias(k) for k in kinds]).withColumn(dataset, F.coalesce(dataset, F.lit("TOTAL")))


def kind_fractions(df: DataFrame, unit: list[str], kind: str, kinds: list[str], relevant: Column) -> DataFrame:
    """Share of each kind over a unit's relevant conditions; units without one get zeros."""
    n = F.count_if(relevant)
    return df.groupBy(*unit).agg(*[F.coalesce(F.count_if(relevant & (F.col(kind) == k)) / F.when(n > 0, n), F.lit(0.0)).alias(k) for k in kinds])


def classify_units(fractions: DataFrame, kinds: list[str], rest: str, least: float = 0.5) -> DataFrame:
    """The kind (other than ``rest``) of the largest share if it is at least ``least``."""
    best = F.greatest(*[F.struct(F.col(k).alias("share"), F.lit(k).alias("kind")) for k in kinds])
    return fractions.withColumn("class", F.when(best["share"] >= least, best["kind"]).otherwise(rest))


def first_by(df: DataFrame, keys: list[str], values: list[str], order: list[str]) -> DataFrame:
    """The values of each group's first row in a stated order."""
    row = F.min(F.struct(*order, *values)).alias("__row")
    return df.groupBy(*keys).agg(row).select(*keys, *[F.col("__row")[v].alias(v) for v in values])


def unit_counts(df: DataFrame, row: str, column: str, values: list, unit: str) -> DataFrame:
    """Distinct units, a row per ``row`` and a column per value of ``column``."""
    return df.groupBy(row).agg(*[F.count_distinct(F.when(F.col(column) == v, F.col(unit))).alias(f"{column}_{v}") for v in values])


def slide(df: DataFrame, keys: list[str], value: str, starts: list[int], width: int, agg: Aggregate = F.avg, *, frame: str = "frame") -> DataFrame:
    """The same windowed aggregate for each start: a row is dealt to the windows that hold it."""
    windows = F.filter(F.array(*[F.lit(s) for s in starts]), lambda s: (F.col(frame) >= s) & (F.col(frame) < s + width))
    return df.withColumn("start", F.explode(windows)).groupBy(*keys, "start").agg(agg(F.col(value)).alias(value))


def smoothed_max(df: DataFrame, keys: list[str], value: str, neighbours: int, *, frame: str = "frame") -> DataFrame:
    """The largest mean over a row and ``neighbours`` on either side, complete windows only."""
    run = W.partitionBy(*keys).orderBy(frame).rowsBetween(-neighbours, neighbours)
    means = df.withColumns({"__mean": F.avg(value).over(run), "__n": F.count("*").over(run)})
    return means.filter(F.col("__n") == 2 * neighbours + 1).groupBy(*keys).agg(F.max("__mean").alias(value))


def duplicated_conditions(df: DataFrame, dataset: str, code: str, run: str) -> DataFrame:
    """(dataset, code, runs) where several runs have one condition."""
    return df.groupBy(dataset, code).agg(F.count_distinct(run).alias("runs")).filter("runs > 1")


def harmonize_runs(df: DataFrame, code: str, run: str = "run") -> DataFrame:
    """Renumber runs so that one condition has one number everywhere, by the rank of its code."""
    # one row a condition, so the ranking is small
    ranks = df.select(code).distinct().withColumn("__run", F.row_number().over(W.orderBy(code)) - 1)
    return df.join(ranks, code).withColumn(run, F.col("__run")).drop("__run")


def percent_excluded(df: DataFrame, flags: list[str], by: list[str]) -> DataFrame:
    """(by, criterion, percent)."""
    shares = df.groupBy(*by).agg(*[(F.avg(F.coalesce(F.col(f), F.lit(False)).cast("int")) * 100).alias(f) for f in flags])
    return shares.unpivot(by, flags, "criterion", "percent")


def merge_close(df: DataFrame, value: str, gap: float, by: list[str]) -> DataFrame:
    """(by, low, merged, n): values nearer than ``gap`` to the next are merged to their mean."""
    distinct = df.select(*by, value).distinct()
    run = W.partitionBy(*by).orderBy(value)
    turns = distinct.withColumn("__new", F.coalesce((F.col(value) - F.lag(value).over(run) > gap).cast("int"), F.lit(0)))
    return turns.withColumn("__g", F.sum("__new").over(run)).groupBy(*by, "__g").agg(F.min(value).alias("low"), F.avg(value).alias("merged"), F.count("*").alias("n")).drop("__g")


def recentre(df: DataFrame, dataset: str, x: str, y: str, value: str) -> DataFrame:
    """Coordinates relative to each dataset's place of largest mean."""
    means = df.groupBy(dataset, x, y).agg(F.avg(value).alias("__m"))
    top = means.groupBy(dataset).agg(F.max(F.struct(F.col("__m"), (-F.col(x)).alias("nx"), (-F.col(y)).alias("ny"))).alias("__t"))
    return means.join(top, dataset).select(dataset, (F.col(x) + F.col("__t.nx")).alias(x), (F.col(y) + F.col("__t.ny")).alias(y), F.col("__m").alias(value))


def relative_to_best(df: DataFrame, dataset: str, condition: str, value: str) -> DataFrame:
    """Condition means over the dataset's largest."""
    means = df.groupBy(dataset, condition).agg(F.avg(value).alias("m"))
    return means.join(means.groupBy(dataset).agg(F.max("m").alias("top")), dataset).select(dataset, condition, (F.col("m") / F.col("top")).alias(value))
