"""Shared helpers: work tables in the cluster's shared folder and Arrow batch plumbing."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a Python task holds as objects at once; batches are sliced to this.
SLICE_ROWS = 512


@functools.cache
def _own_root() -> str:
    return tempfile.mkdtemp(prefix="spark-")


def work_root(spark: SparkSession) -> str:
    """The shared folder for work tables: ``spark.checkpoint.dir``.

    A local session without the setting gets a folder of its own; a cluster session
    without it is refused, as executors could not see each other's files.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith(("local[", "local")) or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return _own_root()


def work_path(spark: SparkSession, label: str) -> str:
    return f"{work_root(spark)}/work-{uuid.uuid4().hex}/{label}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a Parquet work table and read it back: cuts lineage, survives lost executors."""
    path = work_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Work tables of one call, each under a name, so that those no longer needed can be deleted."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, work_path(spark, "")

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` as a Parquet work table and read it back."""
        df.write.parquet(self.root + name)
        return self.spark.read.schema(df.schema).parquet(self.root + name)

    def drop(self, *names: str) -> None:
        """Delete tables that nothing reads any more, neither a later job nor the lineage of a result."""
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.root + name)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def row_numbers() -> Callable[[int], pa.Array]:
    """For a task that writes a table: numbers of the next so many rows, unique over all tasks.

    They are stored with the rows. Numbers given after a table is read back would follow
    how its files are dealt to the cores at hand and differ between two jobs.
    """
    at = TaskContext.get().partitionId() << 33

    def numbers(n: int) -> pa.Array:
        nonlocal at
        at += n
        return pa.array(np.arange(at - n, at, dtype=np.int64))

    return numbers


def map_slices(
    df: DataFrame, fn: Callable[[Iterator[pa.Table]], Iterator[pa.RecordBatch]], schema: str
) -> DataFrame:
    """``mapInArrow`` with ``fn`` fed slices of at most SLICE_ROWS rows, one task's slices in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def slices() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, SLICE_ROWS):
                    yield batch.slice(at, SLICE_ROWS)

        yield from fn(slices())

    return df.mapInArrow(run, schema)


def quoted(name: str) -> str:
    """A column's name as ``col`` takes it, whatever it holds (``a.b``)."""
    return "`" + name.replace("`", "``") + "`"


def utf8(column: pa.Array) -> list[bytes | None]:
    """A string column as UTF-8 bytes, without decoding."""
    return column.cast(pa.binary()).to_pylist()


def crc_mod(id_column: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus`` (null ids count as the empty text)."""
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")) % modulus


def stable_unit(*columns: Column) -> Column:
    """A number in [0, 1) that depends only on the values of ``columns``."""
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 40)) / F.lit(float(1 << 40))
