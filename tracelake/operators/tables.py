"""Tables of runs, datasets and units: selection rules, condition tables, counts, weights, keyed joins.

Null values are left out of aggregates and never match a condition; ties are settled by the
stated keys; empty tables give empty tables.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def nonzero(df: DataFrame, value: str) -> DataFrame:
    return df.filter(F.col(value) > 0)


def extent(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, low, high)."""
    return df.groupBy(*by).agg(F.min(value).alias("low"), F.max(value).alias("high"))


def bounded(df: DataFrame, by: list[str], value: str, low: float, high: float) -> DataFrame:
    """(by, bounded): are all values of the group inside [low, high]?"""
    return df.groupBy(*by).agg(((F.min(value) >= low) & (F.max(value) <= high)).alias("bounded"))


def singleton(df: DataFrame, by: list[str], key: str) -> DataFrame:
    """(by, key) of a key with one value in the group; several values raise when the rows are read."""
    s = df.groupBy(*by).agg(F.count_distinct(key).alias("__n"), F.max(key).alias(key))
    return s.filter(F.assert_true(F.col("__n") == 1, F.concat(F.lit(f"several values of {key}: "), F.col("__n"))).isNull()).drop("__n")


def combinations(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.select(*keys).distinct()


def parameter_grid(tables: list[DataFrame]) -> DataFrame:
    """Every combination of the rows of small tables of parameter values."""
    return reduce(lambda a, b: a.crossJoin(F.broadcast(b)), tables)


def sparse_datasets(units: DataFrame, areas: DataFrame, least: Column, *, dataset: str = "dataset", unit: str = "roi", area: str = "area") -> DataFrame:
    """(dataset, density) of the datasets with fewer units an area than ``least``, a column of ``areas``."""
    n = units.groupBy(dataset).agg(F.count_distinct(unit).alias("__n"))
    d = n.join(areas, dataset).withColumn("density", F.col("__n") / F.col(area))
    return d.filter(F.col("density") < least).select(dataset, "density")


def complete_datasets(df: DataFrame, dataset: str, condition: str, n: int) -> DataFrame:
    """Rows of the datasets that have ``n`` conditions."""
    whole = df.groupBy(dataset).agg(F.count_distinct(condition).alias("__n")).filter(F.col("__n") == n).select(dataset)
    return df.join(whole, dataset, "left_semi")


def best_fraction(df: DataFrame, dataset: str, condition: str, hit: Column) -> DataFrame:
    """(dataset, fraction): the largest share of ``hit`` rows over the dataset's conditions."""
    each = df.groupBy(dataset, condition).agg(F.avg(F.coalesce(hit, F.lit(False)).cast("double")).alias("f"))
    return each.groupBy(dataset).agg(F.max("f").alias("fraction"))


def responsive_datasets(df: DataFrame, dataset: str, condition: str, hit: Column, least: float) -> DataFrame:
    return df.join(best_fraction(df, dataset, condition, hit).filter(F.col("fraction") >= least), dataset, "left_semi")


def weighted_fractions(df: DataFrame, x: list[str], dataset: str, hit: Column, unit: str) -> DataFrame:
    """(x, mean, sem): shares of ``hit`` rows by dataset, averaged with the datasets' shares of all units as weights."""
    each = df.groupBy(*x, dataset).agg(F.avg(F.coalesce(hit, F.lit(False)).cast("double")).alias("f"), F.count_distinct(unit).alias("w"))
    return each.groupBy(*x).agg((F.sum(F.col("f") * F.col("w")) / F.sum("w")).alias("mean"), (F.stddev_samp("f") / F.sqrt(F.count("f"))).alias("sem"))


def unit_totals(df: DataFrame, by: list[str], counted: list[str]) -> DataFrame:
    """(by, counted): distinct values of each counted key."""
    return df.groupBy(*by).agg(*[F.count_distinct(c).alias(c) for c in counted])


def exclusion_combinations(df: DataFrame, flags: list[str], by: list[str]) -> DataFrame:
    """(by, combination, n, percent): rows by the set of flags they carry, and their share of the group."""
    names = F.array_compact(F.array(*[F.when(F.coalesce(F.col(f), F.lit(False)), F.lit(f)) for f in flags]))
    counts = df.withColumn("combination", F.array_join(names, "+")).groupBy(*by, "combination").agg(F.count("*").alias("n"))
    return counts.withColumn("percent", 100 * F.col("n") / F.sum("n").over(W.partitionBy(*by)))


def traces_by_exclusion(df: DataFrame, flags: list[str], by: list[str], time: str, value: str, *, combined: bool = True) -> DataFrame:
    """(by, criteria, time, mean, n, percent): mean trace of the rows that carry none of a set of flags, for no flag, each flag and, if ``combined``, every set of them.

    ``percent``: share of the group's rows that the criteria exclude. Rows are summed once by
    the flags they carry; the sums of a set of criteria are those of all flag sets apart from it.
    """
    carried = sum((F.when(F.coalesce(F.col(f), F.lit(False)), 1 << k).otherwise(0) for k, f in enumerate(flags)), F.lit(0))
    sums = df.withColumn("__set", carried).groupBy(*by, time, "__set").agg(F.sum(value).alias("__s"), F.count(value).alias("__n"), F.count("*").alias("__all"))
    masks = [m for m in range(1 << len(flags)) if combined or m.bit_count() <= 1]
    names = F.create_map(*[v for m in masks for v in (F.lit(m), F.lit(" & ".join(f for k, f in enumerate(flags) if m >> k & 1) or "none"))])
    met = sums.withColumn("__mask", F.explode(F.array(*[F.lit(m) for m in masks])))
    kept = F.col("__mask").bitwiseAND(F.col("__set")) == 0
    out = met.groupBy(*by, "__mask", time).agg(
        F.sum(F.when(kept, F.col("__s"))).alias("__s"), F.coalesce(F.sum(F.when(kept, F.col("__n"))), F.lit(0)).alias("n"),
        F.coalesce(F.sum(F.when(kept, F.col("__all"))), F.lit(0)).alias("__kept"), F.sum("__all").alias("__all"),
    )
    whole = W.partitionBy(*by, "__mask")  # one row a time and criteria
    percent = 100 * (1 - F.sum("__kept").over(whole) / F.sum("__all").over(whole))
    return out.select(*by, F.element_at(names, F.col("__mask")).alias("criteria"), time, F.try_divide("__s", "n").alias("mean"), "n", percent.alias("percent"))


def centroids(masks: DataFrame, unit: list[str], x: str, y: str, statistics: DataFrame) -> DataFrame:
    """Unit statistics with the centres of the units' masks."""
    return masks.groupBy(*unit).agg(F.avg(x).alias("x"), F.avg(y).alias("y")).join(statistics, unit)


def view_area(micrometres: Column, width: Column) -> Column:
    """mm2 of a square field of view ``width`` pixels wide."""
    return F.pow(micrometres * width, F.lit(2)) * 1e-6


def scaling_factors(df: DataFrame, line: str, value: str) -> DataFrame:
    """(line, mean, factor): mean by line, over the largest of them."""
    m = df.groupBy(line).agg(F.avg(value).alias("mean"))
    return m.withColumn("factor", F.col("mean") / F.max("mean").over(W.partitionBy()))  # one row a line


def parameters_by_run(df: DataFrame, run: str, parameters: list[str]) -> DataFrame:
    """(run, parameters) of each run's first row by the parameters' own order."""
    return df.groupBy(run).agg(F.min(F.struct(*parameters)).alias("p")).select(run, "p.*")


def run_of(df: DataFrame, run: str, conditions: dict[str, float], by: list[str]) -> DataFrame:
    """(by, run): the first run with the given parameters."""
    return reduce(lambda d, kv: d.filter(F.col(kv[0]) == kv[1]), conditions.items(), df).groupBy(*by).agg(F.min(run).alias(run))


def one_row_per_run(tables: list[DataFrame], dataset: str, run: str, values: list[str]) -> DataFrame:
    """(dataset, run, values) over several tables: the least row of each run."""
    both = reduce(DataFrame.unionByName, [t.select(dataset, run, *values) for t in tables])
    return both.groupBy(dataset, run).agg(F.min(F.struct(*values)).alias("p")).select(dataset, run, "p.*")


def relative_run_ids(df: DataFrame, dataset: str, run_id: str) -> DataFrame:
    """(dataset, run_id, position, gaps): ids from the dataset's least on; ``gaps`` tells if one is missing."""
    ids = df.select(dataset, run_id).distinct()
    run = W.partitionBy(dataset)
    out = ids.withColumn("position", F.col(run_id) - F.min(run_id).over(run))
    return out.withColumn("gaps", F.max("position").over(run) + 1 != F.count("*").over(run))


def drop_repeated_runs(df: DataFrame, dataset: str, code: str, run: str, keep: str = "first") -> DataFrame:
    """Rows without the runs that repeat a condition of their dataset; the ``first`` or ``last`` run stays, ``raise`` allows none."""
    runs = df.select(dataset, code, run).distinct()
    if keep == "raise":
        n = F.count("*").over(W.partitionBy(dataset, code))
        runs = runs.withColumn("__n", n).filter(F.assert_true(F.col("__n") == 1, F.lit("a condition has several runs")).isNull())
    else:
        runs = runs.groupBy(dataset, code).agg((F.min if keep == "first" else F.max)(run).alias(run))
    return df.join(runs.select(dataset, code, run), [dataset, code, run], "left_semi")


def trim_to_shortest(df: DataFrame, dataset: str, frame: str) -> DataFrame:
    """Frames that every dataset has."""
    shortest = df.groupBy(dataset).agg(F.max(frame).alias("m")).agg(F.min("m").alias("__m"))  # one row
    return df.crossJoin(F.broadcast(shortest)).filter(F.col(frame) <= F.col("__m")).drop("__m")


def resolve_close(df: DataFrame, merged: DataFrame, by: list[str], value: str, digits: int = 8) -> DataFrame:
    """Values replaced by the mean of their chain in ``merged`` (by, low, merged), rounded."""
    run = W.partitionBy(*by).orderBy("low")
    ranges = merged.withColumn("__next", F.lead("low").over(run))
    on = [F.col(f"d.{b}") == F.col(f"m.{b}") for b in by]
    inside = (F.col(f"d.{value}") >= F.col("m.low")) & (F.col("m.__next").isNull() | (F.col(f"d.{value}") < F.col("m.__next")))
    joined = df.alias("d").join(ranges.alias("m"), reduce(lambda a, b: a & b, [*on, inside]), "left")
    return joined.select(*[F.round("m.merged", digits).alias(c) if c == value else F.col(f"d.{c}") for c in df.columns])


def condition_table(df: DataFrame, row: str, column: str, values: list, code: str) -> DataFrame:
    """A row per ``row``, the least code of each column value."""
    return df.groupBy(row).agg(*[F.min(F.when(F.col(column) == v, F.col(code))).alias(f"{column}_{v}") for v in values])


def occurrences(df: DataFrame, by: list[str], dataset: str) -> DataFrame:
    """(by, n): datasets that have a condition, as at one place of the sequence."""
    return df.groupBy(*by).agg(F.count_distinct(dataset).alias("n"))


def incomplete(df: DataFrame, columns: list[str]) -> DataFrame:
    """Each count column as ``missing``, ``incomplete`` (below its row's largest) or null."""
    top = F.greatest(*[F.col(c) for c in columns]) if len(columns) > 1 else F.col(columns[0])
    return df.withColumns({c: F.when(F.col(c).isNull(), "missing").when(F.col(c) < top, "incomplete") for c in columns})


def renumber(df: DataFrame, level: str, by: list[str]) -> DataFrame:
    """A key's values as 0, 1, .. inside each group."""
    return df.withColumn(level, F.dense_rank().over(W.partitionBy(*by).orderBy(level)) - 1)


def drop_constant_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Without the keys that have one value, which one row of extremes tells."""
    constant = df.agg(*[(F.min(k) == F.max(k)).alias(k) for k in keys]).first()
    return df.drop(*[k for k in keys if constant[k]])


def arrays_to_long(df: DataFrame, keys: list[str], arrays: list[str], position: str = "frame") -> DataFrame:
    """(keys, position, arrays) of arrays of one length."""
    return df.select(*keys, F.posexplode(F.arrays_zip(*arrays)).alias(position, "__z")).select(*keys, position, *[F.col(f"__z.{a}").alias(a) for a in arrays])


def pixel_stimulated(row: Column, col: Column, columns: int, pixels: int, rate: float, on: float, off: float) -> Column:
    """Is a pixel scanned between two times after its frame's start?"""
    t = (row * columns + col) / F.lit(float(rate * pixels))
    return (t >= on) & (t <= off)


def relative_frames(reference: int, start: int, end: int, every: int = 1) -> Column:
    """Array of frames from ``start`` to ``end`` about a reference."""
    return F.sequence(F.lit(reference + start), F.lit(reference + end), F.lit(every))


def heat_map(df: DataFrame, unit: list[str], frame: str, value: str, pre: tuple[int, int], post: tuple[int, int]) -> DataFrame:
    """(unit, values, change, place): a unit's mean trace as an array, and its place by falling evoked change."""
    means = df.groupBy(*unit, frame).agg(F.avg(value).alias("__v"))
    inside = lambda w: F.avg(F.when((F.col(frame) >= w[0]) & (F.col(frame) < w[1]), F.col("__v")))
    rows = means.groupBy(*unit).agg(
        F.transform(F.array_sort(F.collect_list(F.struct(frame, "__v"))), lambda s: s["__v"]).alias("values"), (inside(post) - inside(pre)).alias("change")
    )
    return rows.withColumn("place", F.row_number().over(W.partitionBy(*unit[:-1]).orderBy(F.desc("change"), unit[-1])))


def plot_table(traces: DataFrame, statistics: DataFrame, on: list[str], columns: list[str], frame: str, reference: int, rate: float) -> DataFrame:
    """Traces with the statistics' columns and the time of each frame."""
    return traces.join(statistics.select(*on, *columns), on, "left").withColumn("t", (F.col(frame) - reference) / F.lit(float(rate)))


def dataset_offsets(df: DataFrame, dataset: str, value: str, relative: float = 0.5) -> DataFrame:
    """(dataset, offset): minus the rank of the dataset times a share of the deviation of all values."""
    spread = df.agg(F.stddev_samp(value).alias("__s"))  # one row
    names = df.select(dataset).distinct().withColumn("__k", F.dense_rank().over(W.orderBy(dataset)) - 1)  # one row a dataset
    return names.crossJoin(F.broadcast(spread)).select(dataset, (-F.col("__k") * relative * F.col("__s")).alias("offset"))


def apply_offsets(df: DataFrame, offsets: DataFrame, by: str, value: str) -> DataFrame:
    return df.join(offsets.select(by, "offset"), by, "left").withColumn(value, F.col(value) + F.coalesce("offset", F.lit(0.0))).drop("offset")


def consistent_merge(a: DataFrame, b: DataFrame, on: list[str], same: list[str]) -> DataFrame:
    """Inner join of two tables whose ``same`` columns must agree; a mismatch raises when the rows are read."""
    right = b.withColumnsRenamed({c: f"__{c}" for c in same})
    joined = a.join(right, on)
    agree = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in same])
    return joined.filter(F.assert_true(agree, F.lit("the tables disagree")).isNull()).drop(*[f"__{c}" for c in same])


def concat_keyed(tables: dict[str, DataFrame], key: str) -> DataFrame:
    """Rows of several tables under a new key."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.withColumn(key, F.lit(name)) for name, df in tables.items()])


def square_deviations(df: DataFrame, by: list[str], value: str) -> DataFrame:
    return df.groupBy(*by).agg((F.var_pop(value) * F.count(value)).alias("ssd"))


def time_course(df: DataFrame, by: list[str], frame: str, value: str, rate: float) -> DataFrame:
    """(by, t, value): mean course of each group over its largest value."""
    m = df.groupBy(*by, frame).agg(F.avg(value).alias(value))
    return m.select(*by, (F.col(frame) / F.lit(float(rate))).alias("t"), (F.col(value) / F.max(value).over(W.partitionBy(*by))).alias(value))


def first_rows(df: DataFrame, by: list[str], order: list[str], n: int = 1) -> DataFrame:
    """The first ``n`` rows of each group."""
    return df.withColumn("__k", F.row_number().over(W.partitionBy(*by).orderBy(*order))).filter(F.col("__k") <= n).drop("__k")


def skip_first(df: DataFrame, by: list[str], order: str) -> DataFrame:
    """Without the rows of each group's least ``order``, such as a run's first trial."""
    return df.withColumn("__m", F.min(order).over(W.partitionBy(*by))).filter(F.col(order) > F.col("__m")).drop("__m")


def natural_key(name: Column) -> Column:
    """Sorts names by their text, then by the number at their end: ``f2`` before ``f10``."""
    return F.struct(F.regexp_replace(name, r"\d+\D*$", "").alias("text"), F.regexp_extract(name, r"(\d+)\D*$", 1).try_cast("long").alias("number"), name.alias("name"))


def common_datasets(tables: list[DataFrame], dataset: str) -> DataFrame:
    return reduce(lambda a, b: a.intersect(b), [t.select(dataset) for t in tables])


def missing_datasets(a: DataFrame, b: DataFrame, dataset: str) -> DataFrame:
    """Datasets of ``a`` that ``b`` doesn't have."""
    return a.select(dataset).subtract(b.select(dataset))


def centred(value: str, by: list[str], reference: str = "mean") -> Column:
    """A value less its group's min, mean, median or max."""
    agg = {"min": F.min, "mean": F.avg, "median": F.median, "max": F.max}[reference]
    return F.col(value) - agg(F.col(value)).over(W.partitionBy(*by))


def pre_post_status(df: DataFrame, subject: str, date: str) -> DataFrame:
    """(subject, date, status): the first of two dates is ``pre``, the second ``post``; subjects with another number of dates are left out."""
    days = df.select(subject, F.to_date(date).alias("day")).distinct()
    run = W.partitionBy(subject)
    both = days.withColumns({"__n": F.count("*").over(run), "__first": F.min("day").over(run)}).filter("__n = 2")
    return both.select(subject, "day", F.when(F.col("day") == F.col("__first"), "pre").otherwise("post").alias("status"))
