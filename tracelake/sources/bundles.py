"""Bundles of keyed tables, settings and file lists in stores that Spark reaches.

Missing tables raise; empty tables are written and read as such; null settings never stray;
null dataset names fit no pattern.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def save_bundle(tables: dict[str, DataFrame], root: str, *, partition_by: str | None = "dataset", mode: str = "errorifexists") -> None:
    """One Parquet table per name under ``root``."""
    for name, df in tables.items():
        writer = df.write.mode(mode)
        (writer.partitionBy(partition_by) if partition_by and partition_by in df.columns else writer).parquet(f"{root}/{name}")


def load_bundle(spark: SparkSession, root: str, names: list[str]) -> dict[str, DataFrame]:
    """Tables by name; a missing one raises as Spark resolves its path."""
    return {n: spark.read.parquet(f"{root}/{n}") for n in names}


def select_datasets(df: DataFrame, *, include_all: list[str] = (), include_any: list[str] = (), exclude: list[str] = (), key: str = "dataset") -> DataFrame:
    """Rows by substrings of their dataset id."""
    has = lambda x: F.contains(F.col(key), F.lit(x))
    for x in include_all:
        df = df.filter(has(x))
    if include_any:
        df = df.filter(reduce(lambda a, b: a | b, map(has, include_any)))
    for x in exclude:
        df = df.filter(~has(x))
    return df


def file_list(spark: SparkSession, folder: str, *, pattern: str = ".*", glob: str = "*") -> DataFrame:
    """(path, name, length) of the files below ``folder`` whose name matches; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(folder)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length").filter(F.col("name").rlike(pattern))


def count_datasets(df: DataFrame, by: list[str], dataset: str = "dataset") -> DataFrame:
    """Datasets by group with totals, by rollup; null keys are totals."""
    return df.rollup(*by).agg(F.count_distinct(dataset).alias("datasets"))


def excluded_datasets(table: DataFrame, criteria: list[str], dataset: str = "dataset") -> DataFrame:
    """Datasets with a ``y`` in any of the criteria."""
    return table.filter(reduce(lambda a, b: a | b, [F.coalesce(F.col(c) == "y", F.lit(False)) for c in criteria])).select(dataset).distinct()


def write_settings(df: DataFrame, path: str) -> None:
    """(run, settings map) as JSON lines."""
    df.write.json(path)


def read_settings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("run string, settings map<string,string>").json(path)


def settings_mismatches(settings: DataFrame, *, limit: float = 0.01, limits: dict[str, float] | None = None) -> DataFrame:
    """(key, reference, run, value): settings that stray from the most frequent one of their key (numbers by relative deviation)."""
    long = settings.select("run", F.explode("settings").alias("key", "value"))
    reference = long.groupBy("key").agg(F.mode("value", True).alias("reference"))
    ceiling = F.lit(limit)
    for key, x in (limits or {}).items():
        ceiling = F.when(F.col("key") == key, x).otherwise(ceiling)
    v, ref = F.col("value").try_cast("double"), F.col("reference").try_cast("double")
    strays = F.when(v.isNotNull() & ref.isNotNull() & (ref != 0), F.abs((v - ref) / ref) > ceiling).otherwise(F.col("value") != F.col("reference"))
    return long.join(reference, "key").filter(strays).select("key", "reference", "run", "value")


def runs_to_drop(mismatches: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(run, n) of runs that stray in any of ``keys``, or in any key."""
    own = mismatches if keys is None else mismatches.filter(F.col("key").isin(*keys))
    return own.groupBy("run").agg(F.count("*").alias("n"))


def deinterleave(df: DataFrame, channels: int, page: str = "page") -> DataFrame:
    """Pages of a stack to (frame, channel)."""
    return df.withColumns({"frame": F.floor(F.col(page) / channels).cast("int"), "channel": (F.col(page) % channels).cast("int")}).drop(page)


def save_value(spark: SparkSession, path: str, name: str, value: int) -> None:
    """One named whole number, such as a post-stimulus window."""
    spark.createDataFrame([(name, value)], "name string, value long").write.mode("overwrite").json(path)


def load_value(spark: SparkSession, path: str, name: str) -> int:
    """The number saved under ``name``; a missing one raises."""
    row = spark.read.schema("name string, value long").json(path).filter(F.col("name") == name).first()
    if row is None:
        raise ValueError(f"{path} holds no {name}")
    return row.value


def save_lines(stats: DataFrame, counts: DataFrame, root: str) -> None:
    """Line aggregates as CSV with headers, one folder a line below ``stats`` and ``counts``."""
    for name, df in (("stats", stats), ("counts", counts)):
        df.write.mode("overwrite").partitionBy("line").option("header", True).csv(f"{root}/{name}")


def load_lines(spark: SparkSession, root: str, stats_schema: str, counts_schema: str) -> tuple[DataFrame, DataFrame]:
    """(stats, counts) of line aggregates; both must hold the same lines."""
    out = [spark.read.schema(f"{s}, line string").option("header", True).csv(f"{root}/{n}") for n, s in (("stats", stats_schema), ("counts", counts_schema))]
    lines = [{r.line for r in df.select("line").distinct().collect()} for df in out]  # a handful of lines
    if lines[0] != lines[1]:
        raise ValueError(f"only in one of both tables: {sorted(lines[0] ^ lines[1])}")
    return out[0], out[1]


def load_datasets(spark: SparkSession, paths: dict[str, str], names: list[str], *, include_all: list[str] = (), include_any: list[str] = (), exclude: list[str] = ()) -> dict[str, DataFrame]:
    """Tables by name over several bundles (dataset: root), keyed by dataset, of the datasets whose names fit."""
    wanted = {d: p for d, p in paths.items() if all(x in d for x in include_all) and (not include_any or any(x in d for x in include_any)) and not any(x in d for x in exclude)}
    if not wanted:
        raise ValueError("no dataset fits")
    def one(name: str) -> DataFrame:
        parts = [spark.read.parquet(f"{p}/{name}").withColumn("dataset", F.lit(d)) for d, p in sorted(wanted.items())]
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return {n: one(n) for n in names}


def discover(df: DataFrame, path: str, *, includes: list[str] = (), excludes: list[str] = ()) -> DataFrame:
    """(path, analysis, line, dataset) of folders ``../<analysis>/<line>/<dataset>`` whose path has all of ``includes`` and none of ``excludes``."""
    part = lambda k: F.element_at(F.split(F.regexp_replace(F.col(path), "/+$", ""), "/"), k)
    out = df.filter(F.size(F.split(F.regexp_replace(F.col(path), "/+$", ""), "/")) > 2)
    for x in includes:
        out = out.filter(F.contains(F.col(path), F.lit(x)))
    for x in excludes:
        out = out.filter(~F.contains(F.col(path), F.lit(x)))
    return out.select(F.col(path).alias("path"), part(-3).alias("analysis"), part(-2).alias("line"), part(-1).alias("dataset"))


def restrict(df: DataFrame, *, date: str | None = None, date_col: str = "date", **equal) -> DataFrame:
    """Datasets with the given values, and with a date that begins with ``date``; a None restricts nothing."""
    for name, value in equal.items():
        df = df if value is None else df.filter(F.col(name) == value)
    return df if date is None else df.filter(F.startswith(F.col(date_col), F.lit(date)))


def sorted_files(df: DataFrame, name: str, parameter) -> DataFrame:
    """Files by a parsed parameter and then by name, in ``place``; names that don't parse are left out."""
    known = df.withColumn("__p", parameter(F.col(name))).filter("__p is not null")
    return known.withColumn("place", F.row_number().over(W.orderBy("__p", name)) - 1).drop("__p")  # the files of one folder


def sampled_files(df: DataFrame, name: str, n: int, seed: int | None = None) -> DataFrame:
    """The first ``n`` files by name, or ``n`` of them by a seeded hash."""
    return df.orderBy(name if seed is None else F.md5(F.concat_ws("|", F.lit(seed), name)), name).limit(n)


def exclusion_table(df: DataFrame, analysis: str, line: str | None = None) -> DataFrame:
    """Rows of an exclusion table for an analysis, and a line if given, without these columns."""
    out = df.filter(F.col("analysis") == analysis)
    return (out if line is None else out.filter(F.col("line") == line)).drop("analysis", "line")
