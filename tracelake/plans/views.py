"""The driver's tables in the shapes that the operators work on, each as a DataFrame and as a SQL common table expression."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FRAMES, TRIALS = 8, 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def flat_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(dataset, roi, frame, v): one trace of 64 frames per unit."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("label").alias("dataset"), F.col("vec_id").alias("roi"), F.posexplode(F.col("embedding").cast("array<double>")).alias("frame", "v"))


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(dataset, roi, trial, frame, v): eight trials of eight frames per unit."""
    at = F.col("frame")
    return flat_traces(spark, sf_dir).select("dataset", "roi", F.floor(at / FRAMES).cast("int").alias("trial"), (at % FRAMES).alias("frame"), "v")


def stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(dataset, roi, run, p, dc, q, price): a parameter table with repeated keys."""
    t = table(spark, sf_dir, "lineitem")
    return t.select(
        F.concat("l_returnflag", "l_linestatus").alias("dataset"), F.col("l_suppkey").alias("roi"), F.col("l_linenumber").alias("run"),
        F.col("l_discount").alias("p"), F.col("l_tax").alias("dc"), F.col("l_quantity").alias("q"), F.col("l_extendedprice").alias("price"),
    )


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, roi, run, v, phase, at)."""
    t = table(spark, sf_dir, "events")
    seconds = F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")
    return t.select("event_id", F.col("user_id").alias("roi"), F.col("event_type").alias("run"), F.col("value").alias("v"), (seconds * (2 * 3.141592653589793 / 86400)).alias("phase"), F.col("ts").alias("at"))


SQL = {
    "flat": "flat AS (SELECT label AS dataset, vec_id AS roi, CAST(i - 1 AS INT) AS frame, CAST(embedding[i] AS DOUBLE) AS v FROM (SELECT *, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings))",
    "traces": "traces AS (SELECT label AS dataset, vec_id AS roi, CAST((i - 1) // 8 AS INT) AS trial, CAST((i - 1) % 8 AS INT) AS frame, CAST(embedding[i] AS DOUBLE) AS v FROM (SELECT *, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings))",
    "stats": "stats AS (SELECT l_returnflag || l_linestatus AS dataset, l_suppkey AS roi, l_linenumber AS run, l_discount AS p, l_tax AS dc, l_quantity AS q, l_extendedprice AS price FROM lineitem)",
    "trials": "trials AS (SELECT event_id, user_id AS roi, event_type AS run, value AS v, (hour(ts) * 3600 + minute(ts) * 60 + CAST(floor(second(ts)) AS BIGINT)) * (2 * 3.141592653589793 / 86400) AS phase, ts AS at FROM events)",
}
