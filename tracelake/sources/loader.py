"""Collections of datasets: one folder a table, partitioned by dataset and sorted by run, loaded as one set of consistent tables.

A load is a plan of one scan a table: the choice of datasets prunes folders, and the run map
is made once, from the conditions of one table, and joined to every table that has runs.
Null dataset names are in no collection; null runs of a table have no condition and are
left out by harmonising. Empty tables are loaded as such.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tracelake.operators import tables as table_ops

#: Layer of datasets whose name gives none.
DEFAULT_LAYER = "layer2-3"


def save_collection(tables: dict[str, DataFrame], root: str, *, keys: tuple[str, ...] = ("run",), mode: str = "errorifexists") -> None:
    """Each table below ``root``, a folder a dataset, dealt and sorted by dataset and ``keys``, so that filters on them skip files and row groups."""
    for name, df in tables.items():
        order = ["dataset", *[k for k in keys if k in df.columns]]
        df.repartitionByRange(*order).sortWithinPartitions(*order).write.mode(mode).partitionBy("dataset").parquet(f"{root}/{name}")
        # a table without rows has no file that tells its columns
        df.sparkSession.createDataFrame([(df.schema.json(),)], "value string").coalesce(1).write.mode(mode).text(f"{root}/{name}.schema")


def _read(spark: SparkSession, path: str) -> DataFrame:
    """A table with dataset names as they are spelled, not as numbers or dates."""
    try:
        schema = StructType.fromJson(json.loads(spark.read.text(f"{path}.schema").first().value))
    except AnalysisException as e:  # saved by other means
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        schema = spark.read.parquet(path).schema
    return spark.read.schema(StructType([StructField(f.name, StringType()) if f.name == "dataset" else f for f in schema.fields])).parquet(path)


def _wanted(include: tuple[str, ...], include_mode: str, exclude: tuple[str, ...], layer: str | None, datasets: list[str] | None) -> Column:
    has = lambda x: F.contains(F.col("dataset"), F.lit(x))
    if layer == DEFAULT_LAYER:
        exclude = (*exclude, "layer")
    elif layer is not None:
        include = (*include, layer)
    out = F.lit(True)
    if include:
        out &= reduce((lambda a, b: a & b) if include_mode == "all" else (lambda a, b: a | b), map(has, include))
    for x in exclude:
        out &= ~has(x)
    return out if datasets is None else out & F.col("dataset").isin(*datasets)


def run_map(reference: DataFrame, condition: Column, *, on_duplicate: str = "raise", run: str = "run") -> DataFrame:
    """(dataset, run, condition, place): one number a condition over all datasets, by the order of the conditions.

    A condition with several runs in a dataset raises as the plan runs, or loses its first
    or last run (``drop_first``, ``drop_last``: all but the last or first), or keeps them (``keep``).
    """
    runs = reference.filter(F.col(run).isNotNull()).groupBy("dataset", run).agg(F.min(condition).alias("condition")).filter("condition is not null")
    if on_duplicate != "keep":
        runs = table_ops.drop_repeated_runs(runs, "dataset", "condition", run, {"raise": "raise", "drop_first": "last", "drop_last": "first"}[on_duplicate])
    # as many rows as there are conditions
    places = runs.select("condition").distinct().withColumn("place", F.row_number().over(W.orderBy("condition")) - 1)
    return runs.join(places, "condition").select("dataset", run, "condition", "place")


def load_collection(
    spark: SparkSession, root: str, names: list[str], *, optional: tuple[str, ...] = (), include: tuple[str, ...] = (), include_mode: str = "all", exclude: tuple[str, ...] = (),
    layer: str | None = None, datasets: list[str] | None = None, condition: Column | None = None, reference: str | None = None, on_duplicate: str = "raise", run: str = "run",
    frame: str = "frame", run_id: str | None = None,
) -> dict[str, DataFrame]:
    """Tables by name, of the chosen datasets.

    With a ``condition`` of the ``reference`` table, runs are renumbered by condition in every
    table (see ``run_map``, which is returned as ``runs``). Tables with frames are cut to
    the frames that every chosen dataset has in them; run ids count from their dataset's
    least. An ``optional`` table that isn't there is left out; another one raises.
    """
    found: dict[str, DataFrame] = {}
    for name in [*names, *optional]:
        try:
            found[name] = _read(spark, f"{root}/{name}").filter(_wanted(include, include_mode, exclude, layer, datasets))
        except AnalysisException as e:
            if name not in optional or e.getCondition() != "PATH_NOT_FOUND":
                raise
    for name, df in found.items():
        if frame in df.columns:
            found[name] = table_ops.trim_to_shortest(df, "dataset", frame)
    if condition is not None:
        runs = run_map(found[reference or names[0]], condition, on_duplicate=on_duplicate, run=run)
        places = runs.select("dataset", run, "place")
        for name, df in found.items():
            if run in df.columns:
                found[name] = df.join(places, ["dataset", run]).withColumn(run, F.col("place")).drop("place")
        found["runs"] = runs
    for name, df in found.items():
        if run_id is not None and run_id in df.columns:
            least = df.groupBy("dataset").agg(F.min(run_id).alias("__least"))
            found[name] = df.join(least, "dataset").withColumn(run_id, F.col(run_id) - F.col("__least")).drop("__least")
    return found
