"""Temporal URL lists: every capture is judged by the list entries in force when it was fetched.

Dated entries (list, effect, pattern, action, day) become validity intervals per list and
pattern; a capture's URL gives the patterns that could cover it (its host, the host's
parent domains, and host plus path prefixes); an equality join on the pattern with the
interval test is the as-of join. The most specific pattern wins, ``allow`` over ``block``
at equal length. DataFrame functions only.

Captures are reduced to distinct (URL, day) pairs before they are expanded and joined, so
repeated URLs cost one row. Intervals are broadcast only if they are counted to be at most
BROADCAST_INTERVALS rows; beyond, both sides are shuffled by pattern and Spark splits the
partitions of frequent hosts.

Defined results: a null or hostless URL, or a null day, is ``unlisted``; entries with a
null list, pattern or day are void; of entries with the same list, pattern and day a
removal wins; an addition in force is not ended by a second one; repeated rows are judged
alike and returned one by one; empty tables give empty results or ``unlisted``; columns
other than those named are ignored or pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracelake.llm.common import materialize, quoted

BROADCAST_INTERVALS = 100_000


def host_of(url: Column) -> Column:
    """Lower-case host without user, port and final dot; null if there is none."""
    authority = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    host = F.lower(F.regexp_replace(authority, r"\.$", ""))
    return F.when(host != "", host)


def path_of(url: Column) -> Column:
    """Path without query and fragment, without its first slash."""
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^?#]*)", 1)


def patterns_of(url: Column, depth: int) -> Column:
    """All patterns that could cover ``url``: parent domains of two labels or more, and ``host/segment/...`` prefixes
    of up to ``depth`` segments, so that long paths don't make more text than the lists call for."""
    labels = F.split(host_of(url), r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    segments = F.slice(F.filter(F.split(path_of(url), "/"), lambda s: s != ""), 1, depth)
    depths = F.when(F.size(segments) > 0, F.sequence(F.lit(1), F.size(segments))).otherwise(F.array().cast("array<int>"))
    prefixes = F.transform(depths, lambda i: F.concat_ws("/", host_of(url), F.array_join(F.slice(segments, F.lit(1), i), "/")))
    return F.array_distinct(F.concat(domains, prefixes))


def validity(entries: DataFrame) -> DataFrame:
    """(list, effect, pattern, since, until): half-open intervals in force; ``until`` is null while the entry stands."""
    known = entries.filter("list is not null and pattern is not null and day is not null").groupBy("list", "pattern", "day").agg(
        F.max(F.col("action") == "remove").alias("removed"), F.min("effect").alias("effect")
    )
    run = W.partitionBy("list", "pattern").orderBy("day")
    # only changes of state start or end an interval
    turns = known.withColumn("before", F.lag("removed", 1, True).over(run)).filter(F.col("removed") != F.col("before"))
    return turns.withColumn("until", F.lead("day").over(run)).filter(~F.col("removed")).select("list", "effect", "pattern", F.col("day").alias("since"), "until")


def judge_captures(captures: DataFrame, entries: DataFrame, *, url_col: str = "url", day_col: str = "day") -> DataFrame:
    """``captures`` with ``verdict`` (blocked, allowed, unlisted), ``by_list``, ``by_pattern`` and ``n_active`` entries.

    Columns of these names are replaced; other columns pass through.
    """
    intervals = materialize(validity(entries), "intervals")
    n, depth = intervals.agg(F.count("*"), F.coalesce(F.max(F.size(F.split("pattern", "/")) - 1), F.lit(0))).first()
    if n <= BROADCAST_INTERVALS:
        intervals = F.broadcast(intervals)
    pairs = captures.select(F.col(quoted(url_col)).alias("__url"), F.col(quoted(day_col)).alias("__day")).filter("__url is not null and __day is not null").distinct()
    wide = pairs.filter(host_of(F.col("__url")).isNotNull()).withColumn("pattern", F.explode(patterns_of(F.col("__url"), max(1, depth))))
    active = wide.join(intervals, "pattern").filter((F.col("__day") >= F.col("since")) & (F.col("until").isNull() | (F.col("__day") < F.col("until"))))
    # the longest pattern, then allow before block, then the first list by name
    rank = F.struct(-F.length("pattern"), F.when(F.col("effect") == "allow", 0).otherwise(1), "list", "pattern", "effect")
    best = active.groupBy("__url", "__day").agg(F.min(rank).alias("best"), F.count("*").alias("n"))
    names = [c for c in captures.columns if c not in ("verdict", "by_list", "by_pattern", "n_active")]
    # a row is carried as one column, so that its columns may have any names
    own = lambda c: F.col(f"row.{quoted(c)}")
    joined = captures.select(F.struct("*").alias("row")).join(best, (own(url_col) == F.col("__url")) & (own(day_col) == F.col("__day")), "left")
    verdict = F.when(F.col("best").isNull(), "unlisted").when(F.col("best.effect") == "allow", "allowed").otherwise("blocked")
    return joined.select(
        *[own(c).alias(c) for c in names], verdict.alias("verdict"), F.col("best.list").alias("by_list"), F.col("best.pattern").alias("by_pattern"),
        F.coalesce("n", F.lit(0)).cast("long").alias("n_active"),
    )
