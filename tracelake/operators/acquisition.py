"""Decoded acquisition files as tables: stack assembly, channels, frame moves, masks, recordings, session texts.

Null values stay null through projections and are left out of aggregates; empty tables give
empty tables; ties in an order are settled by the stated columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracelake.operators import frames as stacks
from tracelake.operators import signals


def frame_file(name: Column) -> Column:
    """``<prefix>_Cycle<c>_Ch<n>_<frame>.ome.tif`` as (prefix, cycle, channel, number); null if the name is another."""
    pattern = r"(?i)^(.+)_Cycle(\d+)_Ch(\d)_(\d+)\.ome\.tif$"
    g = [F.regexp_extract(name, pattern, k) for k in range(1, 5)]
    return F.when(name.rlike(pattern), F.struct(g[0].alias("prefix"), *[x.cast("int").alias(n) for x, n in zip(g[1:], ("cycle", "channel", "number"), strict=True)]))


def condition_file(name: Column) -> Column:
    """``<condition>_<trial>_<frame>.tif`` as (condition, trial, number)."""
    pattern = r"(?i)^(.+)_(\d+)_(\d+)\.tif$"
    g = [F.regexp_extract(name, pattern, k) for k in range(1, 4)]
    return F.when(name.rlike(pattern), F.struct(g[0].alias("condition"), g[1].cast("int").alias("trial"), g[2].cast("int").alias("number")))


def assemble(df: DataFrame, stack: list[str], cycle: str, number: str) -> DataFrame:
    """Adds ``trial``, two cycles each, and ``frame``, the place of a file in its trial by cycle and number."""
    out = df.withColumn("trial", F.floor((F.col(cycle) - 1) / 2).cast("int"))
    return out.withColumn("frame", F.row_number().over(W.partitionBy(*stack, "trial").orderBy(cycle, number)) - 1)


def uneven(df: DataFrame, keys: list[str], within: list[str]) -> DataFrame:
    """(within, keys, n, usual) of the keys whose row count isn't the most frequent one of their group, the smallest of several."""
    counts = df.groupBy(*within, *keys).agg(F.count("*").alias("n"))
    sizes = counts.groupBy(*within, F.col("n").alias("usual")).agg(F.count("*").alias("__k"))
    usual = sizes.groupBy(*within).agg(F.max(F.struct("__k", (-F.col("usual")).alias("u"))).alias("m")).select(*within, (-F.col("m.u")).alias("usual"))
    return counts.join(usual, within).filter(F.col("n") != F.col("usual"))


def last_page(df: DataFrame, file: list[str], page: str, value: str) -> DataFrame:
    """(file, value) of each file's last page."""
    return df.groupBy(*file).agg(F.max_by(value, page).alias(value))


def concatenate_trials(df: DataFrame, keys: list[str], trial: str, frame: str, out: str = "index") -> DataFrame:
    """Adds the place of a frame along all trials of its run."""
    return df.withColumn(out, F.row_number().over(W.partitionBy(*keys).orderBy(trial, frame)) - 1)


def frame_counts(df: DataFrame, file: list[str], page: str, channels: int = 1) -> DataFrame:
    return df.groupBy(*file).agg(F.floor(F.count_distinct(page) / channels).cast("long").alias("frames"))


def expand_moves(moves: DataFrame, n: int) -> DataFrame:
    """(src, dst) of moves (src, dst, repeat), repeated every ``repeat`` frames up to ``n``; a null repeat stands for once."""
    times = F.when(F.col("repeat").isNull(), 0).otherwise(F.floor(F.lit(n) / F.col("repeat")).cast("int") - 1)
    k = moves.withColumn("__k", F.explode(F.sequence(F.lit(0), F.greatest(times, F.lit(0)))))
    step = F.col("__k") * F.coalesce("repeat", F.lit(0))
    return k.select((F.col("src") + step).cast("int").alias("src"), (F.col("dst") + step).cast("int").alias("dst")).filter((F.col("src") < n) & (F.col("dst") < n)).distinct()


def move_frames(df: DataFrame, keys: list[str], value: str, moves: DataFrame, *, frame: str = "frame") -> DataFrame:
    """Frames that are the ``dst`` of a move take the value of its ``src``; reads come before writes."""
    wanted = df.join(moves.select(F.col("dst").alias(frame), F.col("src").alias("__src")), frame, "left").withColumn("__src", F.coalesce("__src", frame))
    given = df.select(*keys, F.col(frame).alias("__src"), F.col(value).alias("__v"))
    return wanted.drop(value).join(given, [*keys, "__src"], "left").withColumnRenamed("__v", value).drop("__src")


def smoothing_width(rate_in: float, rate_out: float) -> int:
    return round(rate_in / rate_out)


def resample_stack(df: DataFrame, keys: list[str], value: str, length: int, rate_in: float, rate_out: float, *, smooth: bool = False, frame: str = "frame") -> DataFrame:
    """(keys, frame, value) on ceil(n * ratio) even points, linear between frames, rounded; a moving average first if ``smooth``."""
    if smooth:
        df = signals.rolling(df, keys, value, smoothing_width(rate_in, rate_out), F.avg, length, frame=frame)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(frame, F.col(value).cast("double").alias("v")))), lambda s: s["v"])
    rows = df.groupBy(*keys).agg(ordered.alias("__v"))
    return rows.select(*keys, F.posexplode(stacks.resampled_values(F.col("__v"), length, rate_out / rate_in)).alias(frame, value)).withColumn(value, F.rint(value))


def resampled_settings(settings: Column, rate_out: float, frames: int) -> Column:
    """A settings map with the new frame period and frames per trial."""
    new = F.create_map(F.lit("framePeriod"), F.lit(str(1 / rate_out)), F.lit("framesPerTrial"), F.lit(str(frames)))
    return F.map_concat(F.map_filter(settings, lambda k, _: ~k.isin("framePeriod", "framesPerTrial")), new)


def subtract_vector(df: DataFrame, vector: DataFrame, on: list[str], stack: list[str], value: str, level: str) -> DataFrame:
    """``value`` less a vector over frames, which is taken about its own mean by stack."""
    about = vector.withColumn("__d", F.col(level) - F.avg(level).over(W.partitionBy(*stack)))
    return df.join(about.select(*on, "__d"), on).withColumn(value, F.col(value) - F.col("__d")).drop("__d")


def correct_by_channel(df: DataFrame, channel: str, reference: int, *, stack: str = "stack", frame: str = "frame", pixel: str = "pixel", value: str = "v") -> DataFrame:
    """Frames of all channels corrected by the regression of one channel's frames on its own projection; null where that has no slope."""
    own = df.filter(F.col(channel) == reference)
    fit = stacks.frame_regression(own, stacks.projection(own, stack=stack, frame=frame, pixel=pixel, value=value), stack=stack, frame=frame, pixel=pixel, value=value)
    return df.join(fit, [stack, frame]).withColumn(value, F.try_divide(F.col(value) - F.col("intercept"), F.col("slope"))).drop("slope", "intercept")


def noise_baseline(df: DataFrame, keys: list[str], value: str, n: int, factor: float = 1.0, seed: int = 0) -> DataFrame:
    """(keys, place, value): ``n`` samples of the median plus uniform noise of ``factor`` deviations, inside the trace's range; the noise depends on keys, place and seed."""
    s = df.groupBy(*keys).agg(F.median(value).alias("m"), F.stddev_pop(value).alias("s"), F.min(value).alias("a"), F.max(value).alias("b"))
    wide = s.withColumn("place", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    u = (F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), *keys, "place")), 1, 7), 16, 10).cast("long") + 0.5) / float(1 << 28)
    return wide.select(*keys, "place", F.greatest(F.least(F.col("m") + (2 * u - 1) * factor * F.col("s"), F.col("b")), F.col("a")).alias(value))


def to_byte(x: Column) -> Column:
    """0 to 1 as 0 to 255, cut down."""
    return F.floor(x * 255).cast("int")


def rescale_to(df: DataFrame, stack: list[str], value: str, low: float, high: float) -> DataFrame:
    """Each stack's range stretched to [low, high]."""
    ends = df.groupBy(*stack).agg(F.min(value).alias("__a"), F.max(value).alias("__b"))
    return df.join(ends, stack).withColumn(value, low + (F.col(value) - F.col("__a")) / (F.col("__b") - F.col("__a")) * (high - low)).drop("__a", "__b")


def pixel_rows(df: DataFrame, keys: list[str], matrix: str) -> DataFrame:
    """(keys, row, col, value) of an array of rows."""
    rows = df.select(*keys, F.posexplode(matrix).alias("row", "__r"))
    return rows.select(*keys, "row", F.posexplode("__r").alias("col", "value"))


def change_by_level(df: DataFrame, by: list[str], level: str, change: str) -> DataFrame:
    """(by, r, slope, intercept, n) of the change of pixels against their level, as inside and outside a stimulus mask."""
    return df.groupBy(*by).agg(F.corr(level, change).alias("r"), F.regr_slope(change, level).alias("slope"), F.regr_intercept(change, level).alias("intercept"), F.count(change).alias("n"))


def intensity_ratio(masks: DataFrame, image: DataFrame, unit: list[str], pixel: list[str], weight: str, inside: str, value: str, k: float = 1.0) -> DataFrame:
    """(unit, ratio, marked): weighted intensity inside a unit's mask over that of its surround; marked above median + ``k`` deviations."""
    both = masks.join(image, pixel)
    def mean(rows: Column) -> Column:
        return F.sum(F.when(rows, F.col(weight) * F.col(value))) / F.sum(F.when(rows, F.col(weight)))
    ratios = both.groupBy(*unit).agg((mean(F.col(inside)) / mean(~F.col(inside))).alias("ratio"))
    edge = ratios.agg((F.median("ratio") + k * F.stddev_samp("ratio")).alias("__edge"))  # one row
    return ratios.crossJoin(F.broadcast(edge)).select(*unit, "ratio", (F.col("ratio") > F.col("__edge")).alias("marked"))


def mask_pixels(df: DataFrame, unit: list[str], y: str, x: str, weight: str) -> DataFrame:
    """(unit, ypix, xpix, lam), one row a pixel of a unit's mask."""
    zipped = F.arrays_zip(F.col(y).alias("ypix"), F.col(x).alias("xpix"), F.col(weight).alias("lam"))
    return df.select(*unit, F.inline(zipped)).toDF(*unit, "ypix", "xpix", "lam")


def cells_only(df: DataFrame, flags: str) -> DataFrame:
    """Units whose first flag is set."""
    return df.filter(F.get(flags, 0) > 0)


def stack_slice(df: DataFrame, value: str, first: int, last: int, factor: float = 1, *, frame: str = "frame") -> DataFrame:
    return df.filter(F.col(frame).between(first, last)).withColumn(value, F.col(value) * factor)


def extract_frames(df: DataFrame, keys: list[str], value: str, trials: list[int], wanted: list[int], *, over_trials: bool = False, trial: str = "trial", frame: str = "frame") -> DataFrame:
    """Some frames of some trials; their median over trials if ``over_trials``."""
    out = df.filter(F.col(trial).isin(*trials) & F.col(frame).isin(*wanted))
    return out.groupBy(*keys, frame).agg(F.median(value).alias(value)) if over_trials else out


def recording(df: DataFrame, rate: float, channels: dict[str, tuple[str, float]], *, sample: str = "sample") -> DataFrame:
    """Adds ``t`` and renames channels (name: (new name, factor)), as from volts to millivolts."""
    kept = [c for c in df.columns if c not in channels]
    return df.select(*kept, (F.col(sample) / F.lit(float(rate))).alias("t"), *[(F.col(c) * k).alias(n) for c, (n, k) in channels.items()])


def align_to_onset(df: DataFrame, onsets: DataFrame, on: list[str], t: str = "t", onset: str = "onset") -> DataFrame:
    return df.join(onsets.select(*on, onset), on).withColumn(t, F.col(t) - F.col(onset)).drop(onset)


def window_above(df: DataFrame, keys: list[str], value: str, x: str, share: float = 0.05) -> DataFrame:
    """(keys, start, end): the first and last x at which the value is above a share of its largest."""
    top = df.groupBy(*keys).agg(F.max(value).alias("__top"))
    return df.join(top, keys).filter(F.col(value) > share * F.col("__top")).groupBy(*keys).agg(F.min(x).alias("start"), F.max(x).alias("end"))


_FRAME = "struct<_index:int,_relativeTime:double,_absoluteTime:double>"


def session_frames(df: DataFrame, keys: list[str], xml: str) -> DataFrame:
    """(keys, sequence, index, relativeTime, absoluteTime) of ``<Sequence cycle=.. ><Frame index=.. relativeTime=.. absoluteTime=../>..</Sequence>``."""
    parsed = df.select(*keys, F.from_xml(xml, f"_cycle int, Frame array<{_FRAME}>", {"mode": "PERMISSIVE"}).alias("__s"))
    rows = parsed.select(*keys, F.col("__s._cycle").alias("sequence"), F.explode("__s.Frame").alias("f"))
    return rows.select(*keys, "sequence", F.col("f._index").alias("index"), F.col("f._relativeTime").alias("relativeTime"), F.col("f._absoluteTime").alias("absoluteTime"))


def session_settings(df: DataFrame, keys: list[str], xml: str) -> DataFrame:
    """(keys, key, value): ``<PVStateValue key=.. value=..>`` entries, indexed ones as ``key index``."""
    item = "struct<_index:string,_value:string,_description:string>"
    parsed = df.select(*keys, F.from_xml(xml, f"PVStateValue array<struct<_key:string,_value:string,IndexedValue:array<{item}>>>").alias("__s"))
    rows = parsed.select(*keys, F.explode("__s.PVStateValue").alias("p"))
    one = rows.filter("p._value is not null").select(*keys, F.col("p._key").alias("key"), F.col("p._value").alias("value"))
    many = rows.select(*keys, F.col("p._key").alias("__k"), F.explode("p.IndexedValue").alias("i")).select(*keys, F.concat_ws(" ", "__k", "i._index").alias("key"), F.col("i._value").alias("value"))
    return one.unionByName(many)


def session_xml(folder: Column) -> Column:
    """The metadata file of a session folder: named as the folder, inside it."""
    clean = F.regexp_replace(folder, "/+$", "")
    return F.concat(clean, F.lit("/"), F.element_at(F.split(clean, "/"), -1), F.lit(".xml"))


def flatten_settings(df: DataFrame, keys: list[str], settings: str) -> DataFrame:
    """(keys, key, value) of a map of maps: ``outer inner`` keys; an inner key that is empty leaves the outer alone."""
    outer = df.select(*keys, F.explode(settings).alias("__k", "__m"))
    return outer.select(*keys, "__k", F.explode("__m").alias("__kk", "value")).select(*keys, F.trim(F.concat_ws(" ", "__k", "__kk")).alias("key"), "value")


def session_sequences(df: DataFrame, keys: list[str], xml: str) -> DataFrame:
    """(keys, sequence, type, bidirectional, frames, output): attributes of a ``<Sequence>``, its number of frames and the name of its voltage output; texts of truth are read as such."""
    schema = "_type string, _cycle int, _bidirectionalZ string, Frame array<struct<_index:int>>, VoltageOutput struct<_name:string>"
    s = df.select(*keys, F.from_xml(xml, schema).alias("__s"))
    return s.select(
        *keys, F.col("__s._cycle").alias("sequence"), F.col("__s._type").alias("type"), (F.lower("__s._bidirectionalZ") == "true").alias("bidirectional"),
        F.coalesce(F.size("__s.Frame"), F.lit(0)).alias("frames"), F.col("__s.VoltageOutput._name").alias("output"),
    )
