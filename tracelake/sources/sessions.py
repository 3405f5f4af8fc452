"""Whole session documents: XML and JSON files in, typed tables of settings, sequences, frames and outputs out.

A document is a row; parsing, typing and flattening are column expressions. Texts that don't
parse, and null ones, give no rows. Values are typed by what they say: ``number``, ``flag``
(True or False), and ``quantity`` with ``unit`` where a number has a unit, which is in base
units whatever its SI prefix. Empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.functions import parse

# Elements and attributes of a session document.
_VALUE = "_value:string,_description:string"
_SETTING = (
    f"struct<_key:string,{_VALUE},IndexedValue:array<struct<_index:string,{_VALUE}>>,"
    f"SubindexedValues:array<struct<_index:string,SubindexedValue:array<struct<_subindex:string,{_VALUE}>>>>>"
)
_SEQUENCE = (
    "struct<_type:string,_cycle:int,_time:string,_bidirectionalZ:string,_xYStageGridNumXPositions:int,_xYStageGridNumYPositions:int,"
    "Frame:array<struct<_index:int,_relativeTime:double,_absoluteTime:double,_parameterSet:string>>,"
    "VoltageOutput:struct<_name:string,_triggerMode:string,_filename:string,_relativeTime:double,_absoluteTime:double>>"
)
_DOCUMENT = f"PVStateShard struct<PVStateValue:array<{_SETTING}>>, Sequence array<{_SEQUENCE}>"
# Units that settings are given in.
UNITS = ("Hz", "V", "A", "W", "s", "m", "Pa")


def read_documents(spark: SparkSession, path: str, *, glob: str = "*") -> DataFrame:
    """(path, text): whole files below ``path``, one row each; an empty file has none."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=glob)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def _once(column: Column) -> Column:
    """The same value, made once a row: filters on it and on its parts don't make it anew."""
    return F.explode(F.array(column))


def _parsed(df: DataFrame, keys: list[str], xml: str) -> DataFrame:
    return df.select(*keys, _once(F.from_xml(xml, _DOCUMENT)).alias("__d"))


def quantity(text: Column) -> Column:
    """``12.5 kHz`` as struct (number, unit) in base units; null for other texts."""
    pattern = rf"^\s*(-?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?)\s*([pnumkMGT]?)({'|'.join(UNITS)})\s*$"
    power = F.create_map(*[F.lit(v) for k, e in parse.SI.items() for v in (k, float(e))])
    number = F.regexp_extract(text, pattern, 1).try_cast("double") * F.pow(F.lit(10.0), F.element_at(power, F.regexp_extract(text, pattern, 2)))
    return F.when(text.rlike(pattern), F.struct(number.alias("number"), F.regexp_extract(text, pattern, 3).alias("unit")))


def _labels(entries: Column, index: str) -> Column:
    """What each of several values is called: by description where numbered ones all have one, else by index; a single numbered one by nothing."""
    n = F.size(entries)
    numbered = F.transform(entries, lambda e: e[index]) == F.transform(F.sequence(F.lit(0), n - 1), lambda k: k.cast("string"))
    described = F.forall(entries, lambda e: e["_description"].isNotNull())
    return F.transform(entries, lambda e: F.when(numbered & (n == 1), F.lit("")).when(numbered & described, e["_description"]).otherwise(e[index]))


def typed(df: DataFrame, text: str, description: str) -> DataFrame:
    """Adds columns value, number, flag, quantity and unit of a setting; a unit may be in its description instead."""
    v = F.col(text)
    read = df.withColumn("__q", F.coalesce(quantity(v), quantity(F.col(description))))
    return read.withColumns({
        "value": v, "number": F.when(~F.lower(v).isin("nan", "inf", "-inf", "infinity", "-infinity"), v.try_cast("double")), "flag": F.when(v.isin("True", "False"), v == "True"),
        "quantity": F.col("__q.number"), "unit": F.col("__q.unit"),
    })


def document_settings(df: DataFrame, keys: list[str], xml: str, *, simplify: bool = True) -> DataFrame:
    """(keys, key, value, number, flag, quantity, unit) of a document's settings, nested ones as ``outer inner`` keys.

    ``simplify``: pixel sizes that are the same in x and y are one entry, without the depth;
    the laser's power and the gain get their names, and a gain such as ``10x`` its number.
    """
    item = "struct<label:string,_value:string,_description:string>"
    none = F.array().cast(f"array<{item}>")
    pack = lambda label, e: F.struct(label.alias("label"), e["_value"].alias("_value"), e["_description"].alias("_description"))

    def entries(p: Column) -> Column:
        """The values of a setting with their whole keys."""
        own = F.when(p["_value"].isNotNull(), F.array(pack(F.lit(""), p))).otherwise(none)
        indexed = F.when(p["IndexedValue"].isNotNull(), F.zip_with(_labels(p["IndexedValue"], "_index"), p["IndexedValue"], pack)).otherwise(none)
        groups = p["SubindexedValues"]
        single = (F.size(groups) == 1) & (F.get(groups, 0)["_index"] == "0")

        def inner(g: Column) -> Column:
            named = F.zip_with(_labels(g["SubindexedValue"], "_subindex"), g["SubindexedValue"], pack)
            return F.transform(named, lambda e: pack(F.trim(F.concat_ws(" ", F.when(single, "").otherwise(g["_index"]), e["label"])), e))

        nested = F.when(groups.isNotNull(), F.coalesce(F.flatten(F.transform(groups, inner)), none)).otherwise(none)
        return F.transform(F.concat(own, indexed, nested), lambda e: pack(F.trim(F.concat_ws(" ", p["_key"], e["label"])), e))

    # a document is parsed once, and its pair of axes is compared in its own row
    found = _parsed(df, keys, xml).select(*keys, _once(F.flatten(F.transform("__d.PVStateShard.PVStateValue", entries))).alias("__e"))
    axes = F.transform(F.filter("__e", lambda e: e["label"].isin("micronsPerPixel XAxis", "micronsPerPixel YAxis")), lambda e: e["_value"])
    even = F.coalesce(F.array_min(axes) == F.array_max(axes), F.lit(False)) if simplify else F.lit(False)
    rows = found.select(*keys, even.alias("__even"), F.explode("__e").alias("e")).select(*keys, "__even", F.col("e.label").alias("key"), "e._value", "e._description")
    even = F.col("__even")
    if simplify:
        rows = rows.filter((F.col("key") != "micronsPerPixel ZAxis") & ~(even & (F.col("key") == "micronsPerPixel YAxis")))
    out = typed(rows, "_value", "_description").select(*keys, "__even", "key", "value", "number", "flag", "quantity", "unit")
    if not simplify:
        return out.drop("__even")
    gain = F.col("key").rlike("^daq( |$)")
    key = F.when(even & (F.col("key") == "micronsPerPixel XAxis"), "micronsPerPixel").when(F.col("key").rlike("^laserPower( |$)"), "Pockels power").when(gain, "DAQ gain").otherwise(F.col("key"))
    number = F.when(gain & F.col("number").isNull(), F.regexp_replace("value", ".$", "").try_cast("double")).otherwise(F.col("number"))
    return out.select(*keys, key.alias("key"), "value", number.alias("number"), "flag", "quantity", "unit")


def _sequences(df: DataFrame, keys: list[str], xml: str) -> DataFrame:
    return _parsed(df, keys, xml).select(*keys, F.posexplode("__d.Sequence").alias("sequence", "s"))


def document_sequences(df: DataFrame, keys: list[str], xml: str) -> DataFrame:
    """(keys, sequence, type, cycle, time, bidirectional, frames): sequences in the order of the document."""
    return _sequences(df, keys, xml).select(
        *keys, "sequence", F.col("s._type").alias("type"), F.col("s._cycle").alias("cycle"), F.substring("s._time", 1, 15).alias("time"),
        F.when(F.col("s._bidirectionalZ").isin("True", "False"), F.col("s._bidirectionalZ") == "True").alias("bidirectional"), F.coalesce(F.size("s.Frame"), F.lit(0)).alias("frames"),
    )


def document_frames(df: DataFrame, keys: list[str], xml: str) -> DataFrame:
    """(keys, sequence, index, relative_time, absolute_time, parameter_set)."""
    rows = _sequences(df, keys, xml).select(*keys, "sequence", F.explode("s.Frame").alias("f"))
    return rows.select(*keys, "sequence", F.col("f._index").alias("index"), F.col("f._relativeTime").alias("relative_time"), F.col("f._absoluteTime").alias("absolute_time"), F.col("f._parameterSet").alias("parameter_set"))


def document_outputs(df: DataFrame, keys: list[str], xml: str) -> DataFrame:
    """(keys, sequence, name, trigger_mode, filename, relative_time, absolute_time) of the sequences that have a voltage output."""
    rows = _sequences(df, keys, xml).filter("s.VoltageOutput is not null").select(*keys, "sequence", "s.VoltageOutput.*")
    names = {"_name": "name", "_triggerMode": "trigger_mode", "_filename": "filename", "_relativeTime": "relative_time", "_absoluteTime": "absolute_time"}
    return rows.select(*keys, "sequence", *[F.col(a).alias(b) for a, b in names.items()])


def flatten_json(df: DataFrame, keys: list[str], text: str, *, depth: int = 8) -> DataFrame:
    """(keys, path, value, number, flag) of a JSON document's leaves, by dotted paths; places in arrays are numbers.

    NaN and Inf after a colon, comma or bracket are null, and texts of numbers are numbers too. Below ``depth`` levels
    a value stays as its JSON text.
    """
    spark = df.sparkSession
    clean = F.regexp_replace(text, r"(?<=[:\[,]\s{0,8})[-+]?(NaN|Inf(inity)?)\b", "null")
    # one walk down the levels: leaves found above are carried along, so that a text is parsed once
    out = df.select(*keys, F.lit("").alias("path"), _once(F.try_parse_json(clean)).alias("__v"), F.lit(False).alias("__leaf")).filter("__v is not null")
    kind, leaf, inside = F.schema_of_variant("__v"), F.col("__leaf"), F.col("pos").isNotNull()
    nested = kind.startswith("OBJECT") | kind.startswith("ARRAY")
    for _ in range(depth):
        below = out.lateralJoin(spark.tvf.variant_explode_outer(F.when(~leaf, F.col("__v")).outer()))
        below = below.filter(leaf | inside | ~nested)  # empty objects and arrays have no leaf
        step = F.concat("path", F.when(F.col("path") == "", "").otherwise("."), F.coalesce(F.col("key"), F.col("pos").cast("string")))
        out = below.select(*keys, F.when(inside, step).otherwise(F.col("path")).alias("path"), F.when(inside, F.col("value")).otherwise(F.col("__v")).alias("__v"), (~inside).alias("__leaf"))
    value = F.when(F.schema_of_variant("__v") != "VOID", F.try_variant_get("__v", "$", "string"))
    flag = F.when(F.schema_of_variant("__v") == "BOOLEAN", F.try_variant_get("__v", "$", "boolean"))
    number = F.when(F.schema_of_variant("__v") != "BOOLEAN", value.try_cast("double"))
    return out.select(*keys, "path", value.alias("value"), number.alias("number"), flag.alias("flag"))
