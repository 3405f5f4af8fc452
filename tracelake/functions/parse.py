"""Parsers of names and settings texts as column expressions; what doesn't match is null."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Decimal exponents of SI prefixes.
SI = {"p": -12, "n": -9, "u": -6, "m": -3, "": 0, "k": 3, "M": 6, "G": 9, "T": 12}


def _group(text: Column, pattern: str, k: int) -> Column:
    value = F.regexp_extract(text, pattern, k)
    return F.when(value != "", value)


def experiment(name: Column) -> Column:
    """``line_<n>frames_<f>Hz_<d>ms_<fps>Hz_<p>MPA_<dc>DC[-id]`` as a struct; a pressure without a dot has its decimals after the first digit, for which the dot stands."""
    pattern = r"^([A-Za-z0-9]+)_(\d+)frames_(\d+(?:\.\d+)?)Hz_(\d+)ms_(\d+(?:\.\d+)?)Hz_(\d+(?:\.\d+)?)M[Pp][Aa]_(\d+)DC(?:[-_](.*))?$"
    g = [_group(name, pattern, k) for k in range(1, 9)]
    p = F.when(F.contains(g[5], F.lit(".")), g[5].cast("double")).otherwise(F.concat(F.lit("0."), F.substring(g[5], 2, 20)).cast("double"))
    return F.when(g[0].isNotNull(), F.struct(
        g[0].alias("line"), g[1].cast("int").alias("trial_length"), g[2].cast("double").alias("prf"), (g[3].cast("double") / 1000).alias("dur"),
        g[4].cast("double").alias("fps"), p.alias("p"), g[6].cast("double").alias("dc"), F.regexp_extract(g[7], r"(\d+)", 1).try_cast("int").alias("run_id"),
    ))


_NAME = r"([A-Za-z][A-Za-z0-9_]*)_(\d+)frames_(\d+\.?\d*)Hz_(\d+\.?\d*)ms_(\d+\.?\d*)Hz_(\d+\.?\d*)MPa_(\d+)DC_?(.*)"
#: The five forms of acquisition names, tried in this order; the run follows the suffix.
NAME_FORMS = {
    "raw folder": rf"(?i)^{_NAME}-(\d+)$",
    "raw file": rf"(?i)^{_NAME}-(\d+)_Cycle(\d+)_Ch(\d)_(\d+)\.ome\.tif$",
    "stack file": rf"(?i)^{_NAME}-(\d+)\.tif$",
    "run file": rf"(?i)^{_NAME}run(\d+)\.tif$",
    "trial file": rf"(?i)^{_NAME}run(\d+)_(?:\d*_)?(\d+)\.tif$",
}


def acquisition(name: Column) -> Column:
    """Parameters of a name in any of NAME_FORMS as a struct with its form; null if none fits.

    A pressure without a dot has its decimals after the first digit. ``trial``, ``cycle``,
    ``channel`` and ``frame`` are null where the form doesn't hold them, and so is an empty suffix.
    """
    def fields(form: str, pattern: str) -> Column:
        g = lambda k: F.regexp_extract(name, pattern, k)
        own = {"raw file": {"cycle": 10, "channel": 11, "frame": 12}, "trial file": {"trial": 10}}.get(form, {})
        p = F.when(F.contains(g(6), F.lit(".")), g(6)).otherwise(F.concat(F.lit("0."), F.substring(g(6), 2, 20)))
        return F.struct(
            F.lit(form).alias("form"), g(1).alias("line"), g(2).try_cast("int").alias("trial_length"), g(3).try_cast("double").alias("prf"), (g(4).try_cast("double") / 1000).alias("dur"),
            g(5).try_cast("double").alias("fps"), p.try_cast("double").alias("p"), g(7).try_cast("double").alias("dc"), _group(name, pattern, 8).alias("suffix"), g(9).try_cast("int").alias("run_id"),
            *[(g(own[c]).try_cast("int") if c in own else F.lit(None).cast("int")).alias(c) for c in ("trial", "cycle", "channel", "frame")],
        )

    out = None
    for form, pattern in NAME_FORMS.items():
        out = F.when(name.rlike(pattern), fields(form, pattern)) if out is None else out.when(name.rlike(pattern), fields(form, pattern))
    return out


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def _named(df: DataFrame, name: Column) -> DataFrame:
    """(name), made once a row: what is read from it is neither repeated in each expression nor pushed below a distinct."""
    return df.select(F.explode(F.array(name)).alias("__name"))


def info_table(df: DataFrame, path: str, trials_per_run: int | None = None) -> DataFrame:
    """(run, parameters, code) of paths, numbered by name; names in no known form are left out."""
    name = F.col("__name")
    known = _named(df, base_name(F.col(path))).select(acquisition(name).alias("a"), F.regexp_replace(name, r"(?i)(\.ome)?\.tif$", "").alias("code")).filter("a is not null")
    out = known.select((F.row_number().over(W.orderBy("code")) - 1).alias("run"), "a.*", "code")  # one row a file of a session
    return out if trials_per_run is None else out.withColumn("trials", F.lit(trials_per_run))


def run_name(name: Column) -> Column:
    """A trial file's name without its trial."""
    return F.regexp_replace(name, r"(?i)(run\d+)_(?:\d*_)?\d+\.tif$", "$1.tif")


def _trial_files(df: DataFrame, name: str) -> DataFrame:
    """(run, s): the trial files, s is (trial, name); names of the other forms end otherwise, so that one pattern tells them."""
    trial = F.regexp_extract("__name", NAME_FORMS["trial file"], 10).try_cast("int")
    rows = _named(df, F.col(name)).select(F.struct(trial.alias("t"), F.col("__name").alias("f")).alias("s")).filter("s.t is not null")
    return rows.select(run_name(F.col("s.f")).alias("run"), "s")


def runs_of_files(df: DataFrame, name: str) -> DataFrame:
    """(run, trials, first): the number of trial files of each run and the first one in trial order, for runs of any size."""
    return _trial_files(df, name).groupBy("run").agg(F.count("*").alias("trials"), F.min("s")["f"].alias("first"))


def group_by_run(df: DataFrame, name: str) -> DataFrame:
    """(run, files, trials): the trial files of each run in trial order; files of one run are few."""
    return _trial_files(df, name).groupBy("run").agg(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["f"]).alias("files"), F.count("*").alias("trials"))


def resampled_name(name: Column, frames: int, fps: float) -> Column:
    """A run or trial file's name with another frame count and rate."""
    return F.regexp_replace(name, r"(?i)^(.*)_\d+frames_([^_]*Hz_[^_]*ms)_[^_]*Hz_", f"$1_{frames}frames_$2_{fps:g}Hz_")


def mapped_path(path: Column, source: str, target: str) -> Column:
    """A path below the ``source`` folder as the same path below ``target``; null if it isn't below it."""
    return F.when(F.contains(path, F.lit(f"/{source}/")), F.replace(path, F.lit(f"/{source}/"), F.lit(f"/{target}/")))


def split_path(path: Column, folder: str) -> Column:
    """(before, after) of the last folder of a name in a path; null without it."""
    mark = f"/{folder}/"
    after = F.substring_index(path, mark, -1)
    return F.when(F.contains(path, F.lit(mark)), F.struct(F.left(path, F.length(path) - F.length(after) - len(mark)).alias("before"), after.alias("after")))


def channel_count(metadata: Column) -> Column:
    """Channels saved, from the metadata's ``channelSave`` list."""
    return F.size(F.from_json(metadata["channelSave"], "array<int>"))


def json_tag(text: Column) -> Column:
    """A tag's JSON object as a map of texts; NaN and infinities are null."""
    clean = F.regexp_replace(text, r":\s*(?:NaN|-?Infinity|-?Inf)\b", ":null")
    return F.from_json(clean, "map<string,string>")


def tags(first: Column, second: Column) -> Column:
    """The entries of two tag maps; the first has precedence."""
    return F.map_concat(F.map_filter(second, lambda k, _: ~F.array_contains(F.map_keys(first), k)), first)


def acquisition_settings(metadata: Column, prefix: str) -> Column:
    """The entries of a metadata map below ``prefix``, with the frame period where the map holds a frame rate."""
    own = F.map_filter(metadata, lambda k, _: F.startswith(k, F.lit(prefix)))
    rate = metadata[f"{prefix}scanFrameRate"].try_cast("double")
    return F.when(rate > 0, F.map_concat(own, F.create_map(F.lit("framePeriod"), (1 / rate).cast("string")))).otherwise(own)


def natural_number(name: Column) -> Column:
    """The number at the end of a name; null without one."""
    return F.regexp_extract(name, r"(\d+)$", 1).try_cast("long")


def line_of(text: Column) -> Column:
    """The first of the known lines that a text names; null without one."""
    return F.when(F.contains(text, F.lit("line3")), "line3").when(F.contains(text, F.lit("pv")), "pv").when(F.contains(text, F.lit("sst")), "sst")


def suffixes(names: Column) -> Column:
    """What follows the last underscore of the common beginning of an array of names, extensions left off."""
    bare = F.transform(names, lambda x: F.regexp_replace(base_name(x), r"\.[^.]*$", ""))
    low, high = F.array_min(bare), F.array_max(bare)
    same = F.aggregate(F.sequence(F.lit(1), F.length(low)), F.lit(0), lambda n, i: F.when((n == i - 1) & (F.substr(low, F.lit(1), i) == F.substr(high, F.lit(1), i)), i).otherwise(n))
    head = F.left(low, same)
    cut = F.length(head) - F.length(F.substring_index(head, "_", -1))
    return F.transform(bare, lambda x: F.substr(x, cut + 1, F.length(x)))


def offset_code(x: Column, y: Column) -> Column:
    return F.concat(x.cast("string"), F.lit("x_"), y.cast("string"), F.lit("y"))


def offset_complex(x: Column, y: Column) -> Column:
    """A place as a number of the plane: (re, im) and its size."""
    return F.struct(x.alias("re"), y.alias("im"), F.hypot(x, y).alias("size"))


def suffix_code(suffix: Column) -> Column:
    """A condition's code is its suffix."""
    return suffix


def experiment_code(code: Column) -> Column:
    """``<yyyymmdd>_<pre|post>deafening_<left|right|x>ear_<f>kHz_<l|x>dB_<n>`` as a struct; a level ``x`` is null."""
    pattern = r"^(\d{8})_(pre|post)deafening_(left|right|x)ear_(\d+)kHz_(\d+|x)dB_(\d+)$"
    g = lambda k: _group(code, pattern, k)
    return F.when(code.rlike(pattern), F.struct(
        F.to_date(g(1), "yyyyMMdd").alias("date"), F.concat(g(2), F.lit("-deafening")).alias("condition"), g(3).alias("ear"),
        g(4).try_cast("int").alias("khz"), g(5).try_cast("int").alias("db"), g(6).try_cast("int").alias("acquisition"),
    ))


def index_range(indexes: Column) -> Column:
    """An array of whole numbers as ``a``, or ``a - b`` where they are all from a to b, else listed with commas."""
    s = F.array_sort(F.array_distinct(indexes))
    first, last = F.get(s, 0), F.element_at(s, -1)
    return F.when(F.size(s) == 0, "").when(F.size(s) == 1, first.cast("string")).when(last - first == F.size(s) - 1, F.concat_ws(" - ", first, last)).otherwise(F.array_join(F.transform(s, lambda x: x.cast("string")), ","))


def pi_fraction(radians: Column, largest: int = 100) -> Column:
    """Radians as ``nπ/d`` with the least denominator up to ``largest`` that fits to 1e-9; null without one."""
    turns = radians / math.pi
    fits = F.filter(F.sequence(F.lit(1), F.lit(largest)), lambda d: F.abs(turns * d - F.round(turns * d)) < 1e-9)
    d = F.get(fits, 0)
    n = F.round(turns * d).cast("long")
    over = F.when(n == 1, "").when(n == -1, "-").otherwise(n.cast("string"))
    return F.when(d.isNull(), None).when(n == 0, "0").otherwise(F.concat(over, F.lit("π"), F.when(d == 1, "").otherwise(F.concat(F.lit("/"), d.cast("string")))))


def session(name: Column, default_layer: str = "layer2-3") -> Column:
    """``<yyyymmdd>_<mouse>_<region>[_<layer>]``."""
    pattern = r"^(\d{8})_(mouse[^_]*)_(region[^_]*)(?:_(layer.*))?$"
    g = [_group(name, pattern, k) for k in range(1, 5)]
    return F.when(g[0].isNotNull(), F.struct(
        F.to_date(g[0], "yyyyMMdd").alias("date"), g[1].alias("mouse"), g[2].alias("region"), F.coalesce(g[3], F.lit(default_layer)).alias("layer")
    ))


def offset(description: Column) -> Column:
    """``backward_1mm_right_0.5mm`` as (x, y): right and forward count up."""
    def total(plus: str, minus: str) -> Column:
        def part(word: str) -> Column:
            return F.coalesce(_group(description, rf"(?:^|_){word}_(\d+(?:\.\d+)?)mm", 1).cast("double"), F.lit(0.0))
        return part(plus) - part(minus)
    known = description.rlike(r"^(center|((left|right|forward|backward)_\d+(\.\d+)?mm_?)+)$")
    return F.when(known, F.struct(total("right", "left").alias("x"), total("forward", "backward").alias("y")))


def quantile_code(text: Column) -> Column:
    return _group(text, r"^q(\d+(?:\.\d+)?)$", 1).cast("double")


def label(text: Column) -> Column:
    """``name (unit)``."""
    return F.struct(F.trim(F.regexp_replace(text, r"\(.*\)$", "")).alias("name"), _group(text, r"\(([^)]*)\)$", 1).alias("unit"))


def pairs(text: Column) -> Column:
    """``key:x,y;key:x,y`` as a map of points."""
    return F.transform_values(F.str_to_map(text, F.lit(";"), F.lit(":")), lambda _, v: F.transform(F.split(v, ","), lambda x: x.try_cast("double")))


def typed_value(text: Column) -> Column:
    """A settings value as a struct of what it is: boolean, number, quoted text, matrix (rows by ``;``, cells by blanks) or cells (``{..}``, texts without their quotes)."""
    t = F.trim(text)
    number = F.when(~F.lower(t).isin("nan", "inf", "-inf"), t.try_cast("double"))
    rows = F.split(F.regexp_replace(F.btrim(t, F.lit("[]")), r"\s*;\s*", ";"), ";")
    matrix = F.transform(rows, lambda r: F.transform(F.split(F.trim(r), r"[\s,]+"), lambda x: x.try_cast("double")))
    # a cell is a quoted text, a matrix or a word
    cells = F.transform(F.regexp_extract_all(t, F.lit(r"('[^']*'|\[[^\]]*\]|[^\s;,{}'\[\]]+)"), F.lit(1)), lambda c: F.btrim(c, F.lit("'")))
    return F.struct(
        F.when(F.lower(t).isin("true", "false"), F.lower(t) == "true").alias("flag"), number.alias("number"),
        _group(t, r"^'(.*)'$", 1).alias("text"), F.when(t.rlike(r"^\[.*\]$"), matrix).alias("matrix"),
        F.when(t.rlike(r"^\{.*\}$"), cells).alias("cells"),
    )


def settings(text: Column) -> Column:
    """Lines of ``key = value;`` as a map."""
    lines = F.filter(F.split(text, r"[\r\n]+"), lambda s: F.contains(s, F.lit("=")))
    entry = lambda s: F.struct(F.trim(F.substring_index(s, "=", 1)), F.rtrim(F.regexp_replace(F.regexp_replace(s, r"^[^=]*=\s*", ""), r";\s*$", "")))
    return F.map_from_entries(F.transform(lines, entry))


def parameter_code(p: Column, dc: Column) -> Column:
    return F.format_string("%1.2fMPa_%02.0f%%DC", p, dc)


def ordinal_suffix(i: Column) -> Column:
    return F.when(i % 10 == 1, "st").when(i % 10 == 2, "nd").when(i % 10 == 3, "rd").otherwise("th")


def si_pair(x: Column, dimension: int = 1) -> Column:
    """(factor, prefix) of a number: the largest SI prefix whose factor, to the power of the unit's dimension, is not above its size; none for 0."""
    size = F.abs(x)
    prefixes = sorted(SI.items(), key=lambda e: e[1])
    pair = lambda k, e: F.struct(F.lit(10.0 ** (e * dimension)).alias("factor"), F.lit(k).alias("prefix"))
    out = F.when(x == 0, pair("", 0))
    for k, e in reversed(prefixes):
        out = out.when(size >= 10.0 ** (e * dimension), pair(k, e))
    return out.when(x.isNotNull(), pair(*prefixes[0]))


def si_text(x: Column, precision: int = 0) -> Column:
    """A number with the SI prefix of its size."""
    power = F.greatest(F.least(F.floor(F.log10(F.abs(x)) / 3) * 3, F.lit(12)), F.lit(-12)).cast("int")
    prefix = F.create_map(*[F.lit(v) for k, e in SI.items() for v in (e, k)])
    power = F.when(x == 0, 0).otherwise(power)
    return F.concat(F.format_string(f"%.{precision}f ", x / F.pow(F.lit(10.0), power)), F.element_at(prefix, power))


def unique_id(*columns: Column, length: int = 32) -> Column:
    return F.substring(F.md5(F.concat_ws("|", *columns)), 1, length)
