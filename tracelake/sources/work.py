"""A folder for tables that a plan writes and reads back: in the cluster's shared ``spark.checkpoint.dir``."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import SparkSession


@functools.cache
def _own() -> str:
    return tempfile.mkdtemp(prefix="spark-")


def work_folder(spark: SparkSession, label: str) -> str:
    """A new path below the setting; a local session without it gets a temporary folder, a cluster session is refused."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    master = spark.sparkContext.master
    if not root and (not master.startswith("local") or master.startswith("local-cluster")):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{(root or _own()).rstrip('/')}/{label}-{uuid.uuid4().hex}"
