"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import Scratch


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node links its larger neighbours to the smallest node next to it (itself included)."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.filter(F.col("b") > F.col("a")).join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node links itself and its smaller neighbours to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(low.select("a", F.col("m").alias("b")))


def connected_components(edges: DataFrame, work: Scratch | None = None) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: longs) that has a link to another; root is the smallest node.

    Each step is written out, so its lineage is one step long, and the step before is
    deleted. The links are a star around each root when a pair of steps changes nothing.
    """
    work = work or Scratch(edges.sparkSession)
    label, step = f"components-{uuid.uuid4().hex}", 0
    now = work.write(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{label}-0")
    mark = None
    while True:
        new = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(new) == mark or new[0] == 0:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
        mark = tuple(new)
        # the large step is read once, so it isn't written
        now = work.write(_small_star(_large_star(now)).filter("a <> b").distinct(), f"{label}-{step + 1}")
        work.drop(f"{label}-{step}")
        step += 1
