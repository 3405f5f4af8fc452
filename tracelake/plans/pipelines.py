"""The library's life cycles as composed plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.operators import acquisition, aggregate, filters, signals, stats
from tracelake.plans import views
from tracelake.sources import bundles


def responder_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traces to baseline, relative change, z-score, evoked change, valid trials, unit response and responder fractions by dataset.

    The trace keys stay together from the baseline on: all steps up to the unit response
    share one partitioning by unit.
    """
    unit = ["dataset", "roi"]
    t = views.traces(spark, sf_dir).withColumn("f", F.col("v") + 10)
    base = t.groupBy(*unit).agg(F.percentile("f", F.lit(0.05)).alias("f0"))
    t = signals.relative_change(t.join(base, unit), "f", "f0")
    t = t.withColumn("z", signals.z_score("dff", unit))
    change = aggregate.evoked_change(t, [*unit, "trial"], "z", (0, 4), (4, 8))
    flagged = change.withColumn("active", F.col("pre") > 0.7)
    valid = filters.valid_rows(flagged, ["active"], unit)
    units = aggregate.trial_aggregated(valid, unit, [], z_scores=["change"])
    kinds = units.withColumn("kind", stats.response_kind(F.col("change"), 1.0, directional=True))
    out = aggregate.responder_counts(kinds, ["dataset"], "kind", ["negative", "positive", "weak"], normalize=True)
    return out.select("dataset", *[F.round(k, 6).alias(k) for k in ("negative", "positive", "weak")], "total")


def preprocessed_stacks(files: DataFrame, stack: list[str], value: str, *, channels: int, moves: DataFrame, length: int, rate_in: float, rate_out: float) -> DataFrame:
    """From single-frame files (stack, cycle, number, value) to stacks (stack, channel, frame, value).

    Files are put in order, channels are parted, frames moved, and each stack is resampled;
    all stacks of all sessions go through the same plan, keyed by ``stack``.
    """
    ordered = acquisition.concatenate_trials(acquisition.assemble(files, stack, "cycle", "number"), stack, "trial", "frame", "page")
    parted = bundles.deinterleave(ordered.drop("frame"), channels).select(*stack, "channel", "frame", value)
    keys = [*stack, "channel"]
    moved = acquisition.move_frames(parted, keys, value, moves)
    return acquisition.resample_stack(moved, keys, value, length, rate_in, rate_out)


def corrected_stacks(
    files: DataFrame, stack: list[str], pixel: str, value: str, *, channels: int, moves: DataFrame, length: int, rate_in: float, rate_out: float, reference: int | None = None, gain: float | None = None
) -> DataFrame:
    """From single-frame files of pixels (stack, pixel, cycle, number, value) to (stack, pixel, channel, frame, value), through the whole chain.

    ``preprocessed_stacks`` pixel by pixel; with a ``reference`` channel, frames of all
    channels are corrected by that channel's regression on its own median frame, and null where
    it has no slope; with a ``gain``, each pixel's trace is denoised recursively.
    """
    out = preprocessed_stacks(files, [*stack, pixel], value, channels=channels, moves=moves, length=length, rate_in=rate_in, rate_out=rate_out)
    if reference is not None:
        keyed = out.withColumn("__stack", F.struct(*stack))
        out = acquisition.correct_by_channel(keyed, "channel", reference, stack="__stack", pixel=pixel, value=value).drop("__stack")
    return out if gain is None else signals.denoise(out, [*stack, pixel, "channel"], value, gain, keep_gaps=True)


def session_runs(files: DataFrame, settings: DataFrame, dataset: str, run: str, *, limit: float = 0.01) -> DataFrame:
    """(dataset, run, trials, frames, usual_trials, usual_frames, strays, outlier) of the runs of single-frame files (dataset, run, trial, frame).

    ``frames``: the most frequent number of frames a trial; usual ones are the dataset's most
    frequent, the smaller of two. ``strays``: settings (dataset, run, settings map) that
    stray from the dataset's most frequent value. A run with any of these is an outlier.
    """
    trials = files.groupBy(dataset, run, "trial").agg(F.count_distinct("frame").alias("n"))
    runs = trials.groupBy(dataset, run).agg(F.count("*").alias("trials"), F.mode("n", True).alias("frames"))
    usual = runs.groupBy(dataset).agg(F.mode("trials", True).alias("usual_trials"), F.mode("frames", True).alias("usual_frames"))
    long = settings.select(dataset, run, F.explode("settings").alias("key", "text"))
    common = long.groupBy(dataset, "key").agg(F.mode("text", True).alias("common"))
    v, ref = F.col("text").try_cast("double"), F.col("common").try_cast("double")
    stray = F.when(v.isNotNull() & ref.isNotNull() & (ref != 0), F.abs((v - ref) / ref) > limit).otherwise(F.col("text") != F.col("common"))
    strays = long.join(common, [dataset, "key"]).groupBy(dataset, run).agg(F.count_if(stray).alias("strays"))
    out = runs.join(usual, dataset).join(strays, [dataset, run], "left").withColumn("strays", F.coalesce("strays", F.lit(0)))
    return out.withColumn("outlier", (F.col("trials") != F.col("usual_trials")) | (F.col("frames") != F.col("usual_frames")) | (F.col("strays") > 0))
