"""Whole session documents from files, collections of datasets, and operators that came with them."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_operators import one
from tracelake.functions import parse
from tracelake.operators import aggregate, kernels, models, stats, tables
from tracelake.sources import loader, sessions

XML = """<?xml version="1.0"?><PVScan version="5"><PVStateShard>
<PVStateValue key="dwell" value="4.5"/><PVStateValue key="resonant" value="True"/><PVStateValue key="gap" value="nan"/>
<PVStateValue key="micronsPerPixel"><IndexedValue index="XAxis" value="1.1"/><IndexedValue index="YAxis" value="1.2"/><IndexedValue index="ZAxis" value="5"/></PVStateValue>
<PVStateValue key="laserPower"><IndexedValue index="0" value="230" description="Pockels"/></PVStateValue>
<PVStateValue key="odd"><IndexedValue index="0" value="1" description="one"/><IndexedValue index="1" value="2"/></PVStateValue>
<PVStateValue key="preampFilter"><IndexedValue index="0" value="1" description="7.5 MHz"/></PVStateValue>
<PVStateValue key="position"><SubindexedValues index="0"><SubindexedValue subindex="0" value="3 um"/></SubindexedValues></PVStateValue>
</PVStateShard><Sequence type="TSeries" cycle="1" time="10:11:12.1234567" bidirectionalZ="False"><VoltageOutput name="v" relativeTime="0" absoluteTime="0.5"/>
<Frame relativeTime="0" absoluteTime="1.5" index="1"/><Frame relativeTime="0.2" absoluteTime="1.7" index="2"/></Sequence><Sequence cycle="2"/></PVScan>"""


def test_session_files(spark, tmp_path):
    """One file in, settings, sequences, frames and outputs out; broken and empty files give nothing."""
    for name, text in (("a.xml", XML), ("broken.xml", "<x"), ("empty.xml", ""), ("other.txt", XML)):
        (tmp_path / name).write_text(text)
    docs = sessions.read_documents(spark, str(tmp_path), glob="*.xml")
    assert docs.count() == 2  # the empty file has no text
    own = docs.unionByName(spark.createDataFrame([(None, None)], "path string, text string"))
    got = {r.key: r for r in sessions.document_settings(own, ["path"], "text").collect()}
    assert {k: (r.value, r.number, r.flag, r.quantity, r.unit) for k, r in got.items()} == {
        "dwell": ("4.5", 4.5, None, None, None), "resonant": ("True", None, True, None, None), "gap": ("nan", None, None, None, None), "micronsPerPixel XAxis": ("1.1", 1.1, None, None, None),
        "micronsPerPixel YAxis": ("1.2", 1.2, None, None, None), "Pockels power": ("230", 230.0, None, None, None), "odd 0": ("1", 1.0, None, None, None), "odd 1": ("2", 2.0, None, None, None),
        "preampFilter": ("1", 1.0, None, 7.5e6, "Hz"), "position": ("3 um", None, None, pytest.approx(3e-6), "m"),
    }
    assert "laserPower" in {r.key for r in sessions.document_settings(own, ["path"], "text", simplify=False).collect()}
    assert [(r.sequence, r.type, r.cycle, r.time, r.bidirectional, r.frames) for r in sessions.document_sequences(own, ["path"], "text").orderBy("sequence").collect()] == [(0, "TSeries", 1, "10:11:12.123456", False, 2), (1, None, 2, None, None, 0)]
    assert [(r.sequence, r["index"], r.relative_time, r.absolute_time) for r in sessions.document_frames(own, ["path"], "text").orderBy("index").collect()] == [(0, 1, 0.0, 1.5), (0, 2, 0.2, 1.7)]
    assert [(r.sequence, r.name, r.absolute_time) for r in sessions.document_outputs(own, ["path"], "text").collect()] == [(0, "v", 0.5)]


def test_flatten_json(spark):
    text = '{"a": {"b": [1, "2.5", {"c": NaN}], "d": true}, "e": "1e3", "f": null, "g": "x", "h": [], "i": -Inf, "j": {}}'
    df = spark.createDataFrame([("k", text), ("bad", "{"), ("none", None), ("scalar", "3")], "k string, t string")
    got = {(r.k, r.path): (r.value, r.number, r.flag) for r in sessions.flatten_json(df, ["k"], "t").collect()}
    assert got == {
        ("k", "a.b.0"): ("1", 1.0, None), ("k", "a.b.1"): ("2.5", 2.5, None), ("k", "a.b.2.c"): (None, None, None), ("k", "a.d"): ("true", None, True), ("k", "e"): ("1e3", 1000.0, None),
        ("k", "f"): (None, None, None), ("k", "g"): ("x", None, None), ("k", "i"): (None, None, None), ("scalar", ""): ("3", 3.0, None),
    }
    shallow = {r.path: r.value for r in sessions.flatten_json(df.filter("k = 'k'"), ["k"], "t", depth=1).collect()}
    assert shallow["a"] == '{"b":[1,"2.5",{"c":null}],"d":true}' and shallow["g"] == "x"


def collection(spark, root):
    stats = [("007_m1", 3, 0.1), ("007_m1", 5, 0.2), ("20_m2", 1, 0.2), ("20_m2", 2, 0.1), ("20_m2", 9, 0.1), ("m3_layer5", 4, 0.3)]
    series = [(d, r, f, float(r + f)) for d, r, _ in stats for f in range({"007_m1": 4, "20_m2": 6}.get(d, 2))]
    loader.save_collection({
        "stats": spark.createDataFrame([(d, r, p, r + 100) for d, r, p in stats], "dataset string, run int, p double, run_id int"),
        "series": spark.createDataFrame(series, "dataset string, run int, frame int, v double"), "masks": spark.createDataFrame([("007_m1", 1)], "dataset string, roi int"),
    }, root)


def test_load_collection(spark, tmp_path):
    root = f"{tmp_path}/c"
    collection(spark, root)
    load = lambda **k: loader.load_collection(spark, root, ["stats", "series"], optional=("masks", "nothing"), condition=F.col("p"), run_id="run_id", **k)
    own = load(layer=loader.DEFAULT_LAYER, on_duplicate="drop_first")
    assert sorted(map(tuple, own["stats"].select("dataset", "run", "p", "run_id").collect())) == [("007_m1", 0, 0.1, 0), ("007_m1", 1, 0.2, 2), ("20_m2", 0, 0.1, 8), ("20_m2", 1, 0.2, 0)]
    assert {(r.dataset, r.run): 4 for r in own["series"].select("dataset", "run").collect()} == {(d, k): 4 for d, k in itertools.product(("007_m1", "20_m2"), (0, 1))}
    assert own["series"].count() == 16 and own["series"].filter("dataset = '20_m2' and run = 0").agg(F.min("v")).first()[0] == 9.0
    assert set(own) == {"stats", "series", "masks", "runs"} and own["masks"].count() == 1
    assert load(datasets=["20_m2"], on_duplicate="drop_last")["series"].filter("run = 0").agg(F.min("v")).first()[0] == 2.0
    assert load(datasets=["20_m2"], on_duplicate="keep")["series"].count() == 18
    with pytest.raises(Exception, match="several runs"):
        load(include=("m2",))["stats"].collect()
    any_of = load(include=("007", "layer5"), include_mode="any")
    assert {r.dataset for r in any_of["stats"].collect()} == {"007_m1", "m3_layer5"} and any_of["series"].agg(F.max("frame")).first()[0] == 1
    assert load(layer="layer5")["stats"].count() == 1 and load(include=("zzz",))["stats"].count() == 0
    with pytest.raises(Exception):
        loader.load_collection(spark, root, ["nothing"])
    plan = own["series"]._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "Contains" in plan.split("PartitionFilters: [")[1]


def test_traces_by_exclusion(spark):
    rows = [(1, t, a, b, v) for t, a, b, v in [(0, True, False, 1.0), (0, False, True, 3.0), (0, None, None, 5.0), (1, True, True, 7.0), (1, False, False, None)]]
    df = spark.createDataFrame(rows, "g int, t int, a boolean, b boolean, v double")
    got = {(r.criteria, r.t): (r.mean, r.n, r.percent) for r in tables.traces_by_exclusion(df, ["a", "b"], ["g"], "t", "v").collect()}
    assert got == {
        ("none", 0): (3.0, 3, 0), ("none", 1): (7.0, 1, 0), ("a", 0): (4.0, 2, pytest.approx(40)), ("a", 1): (None, 0, pytest.approx(40)), ("b", 0): (3.0, 2, pytest.approx(40)), ("b", 1): (None, 0, pytest.approx(40)),
        ("a & b", 0): (5.0, 1, pytest.approx(60)), ("a & b", 1): (None, 0, pytest.approx(60)),
    }
    assert {r.criteria for r in tables.traces_by_exclusion(df, ["a", "b"], ["g"], "t", "v", combined=False).collect()} == {"none", "a", "b"}
    assert tables.traces_by_exclusion(df.limit(0), ["a"], ["g"], "t", "v").count() == 0


def not_a_knot(y):
    """The next sample by cubics on unit intervals: continuous to the third derivative at the second and last but one knot, to the second elsewhere."""
    n = len(y)
    rows, right = [], []

    def at(i, u, d=0):
        row = np.zeros(4 * (n - 1))
        for p in range(d, 4):
            row[4 * i + p] = math.perm(p, d) * u ** (p - d)
        return row

    for i in range(n - 1):
        rows += [at(i, 0), at(i, 1)]
        right += [y[i], y[i + 1]]
    for i in range(n - 2):
        for d in (1, 2) + ((3,) if i in (0, n - 3) else ()):
            rows.append(at(i, 1, d) - at(i + 1, 0, d))
            right.append(0.0)
    c = np.linalg.lstsq(np.array(rows), np.array(right), rcond=None)[0]
    return at(n - 2, 2) @ c


@pytest.mark.parametrize("past", [5, 6, 8])
def test_spline_end_weights(past):
    y = np.random.default_rng(past).standard_normal(past)
    assert models.end_weights(past, 3) @ y == pytest.approx(not_a_knot(y))
    for order in (1, 2, 3):  # polynomials of the order are carried on exactly
        p = np.polynomial.Polynomial(np.arange(1, order + 2))
        assert models.end_weights(past, order) @ p(np.arange(past)) == pytest.approx(p(past))
    assert models.end_weights(past, 0).tolist() == [0.0] * (past - 1) + [1.0]
    with pytest.raises(ValueError):
        models.end_weights(3, 3)


def test_extrapolate(spark):
    y = [1.0, 2.0, 4.0, 7.0, 11.0, 0.0, 0.0, -9.0, 5.0]
    df = spark.createDataFrame([(1, f, v) for f, v in enumerate(y) if f != 7] + [(1, 20, 3.0)], "roi int, frame int, v double")
    got = {r.frame: r.v for r in models.extrapolate(df, ["roi"], "v", [2, 5, 6, 8, 20]).collect()}
    five = models.end_weights(5, 3) @ np.array(y[:5])
    assert got[5] == pytest.approx(five) == pytest.approx(16) and got[6] == pytest.approx(models.end_weights(5, 3) @ np.array([*y[1:5], five]))
    assert got[2] == 4.0 and got[8] == 5.0 and got[20] == 3.0  # too few frames right before
    low = spark.createDataFrame([(1, f, float(9 - 2 * f)) for f in range(7)], "roi int, frame int, v double")
    assert {r.frame: r.v for r in models.extrapolate(low, ["roi"], "v", [6], order=1).collect()}[6] == 0.0


def test_spectrogram_and_mean_spectrum(spark):
    t = np.arange(64) / 32
    y = np.sin(2 * np.pi * 4 * t)
    df = spark.createDataFrame([(g, p, k, float(v * (p + 1))) for g in (1,) for p in range(2) for k, v in enumerate(y)] + [(2, 0, 0, 1.0)], "g int, p int, frame int, v double")
    for window in ("tukey", "hann", "hamming"):
        s = kernels.spectrogram(df.filter("p = 0"), ["g"], "v", 32, span=0.5, window=window, taper=0.5, start=1.0).collect()
        assert {r.t for r in s} == {1.25 + 0.25 * k for k in range(7)} and {r.freq for r in s} == {2.0 * k for k in range(9)} and {r.g for r in s} == {1}
        assert max(s, key=lambda r: r.magnitude).freq == 4.0 and max(r.magnitude for r in s) == pytest.approx(0.5, abs=0.02)
    mean = {r.freq: r.power for r in kernels.mean_spectrum(df.filter("g = 1"), ["g"], ["p"], "v", 32).collect()}
    assert max(mean, key=mean.get) == 4.0 and mean[4.0] == pytest.approx((32**2 + 64**2) / 2)
    assert kernels.tukey(16, 0.25).tolist() == pytest.approx([0, 0.5] + [1] * 13 + [0.5])
    with pytest.raises(ValueError):
        kernels.spectrogram(df, ["g"], "v", 32, span=0.5, resolution=4)
    assert one(kernels.mean_spectrum(df.filter("g = 2"), ["g"], ["p"], "v", 32)).power == 1.0


def test_condition_pairs(spark):
    """Datasets without one of the conditions, conditions of one dataset, groups of one pair."""
    rows = [("g", d, c, v) for d, c, v in [(1, "a", 1.0), (1, "a", 3.0), (1, "b", 4.0), (2, "a", 1.0), (2, "b", 5.0), (3, "b", 9.0), (3, "c", 1.0), (3, None, 1.0), (4, "a", None), (4, "b", 2.0)]]
    df = spark.createDataFrame(rows, "g string, d int, c string, v double")
    got = {(r.a, r.b): r for r in stats.condition_pairs(df, ["g"], "d", "c", "v").collect()}
    assert set(got) == {("a", "b"), ("b", "c")} and got["b", "c"].stat is None and got["b", "c"].p is None
    t = 3 / (math.sqrt(2) / math.sqrt(2))  # differences 2 and 4
    assert got["a", "b"].n == 2 and got["a", "b"].stat == pytest.approx(t) and got["a", "b"].p == pytest.approx(2 / math.pi * math.atan(1 / t)) == got["a", "b"].corrected
    free = {(r.a, r.b): r for r in stats.condition_pairs(df, ["g"], "d", "c", "v", paired=False).collect()}
    assert set(free) == {("a", "b"), ("a", "c"), ("b", "c")} and free["a", "b"].n == 6
    assert free["a", "b"].corrected == pytest.approx(min(1, 3 * free["a", "b"].p)) or free["a", "b"].corrected == pytest.approx(min(1, 2 * free["a", "b"].p))
    assert stats.condition_pairs(df.limit(0), ["g"], "d", "c", "v").count() == 0


def test_trials_and_responders(spark):
    df = spark.createDataFrame([("a", 1, 2.0, 0.1), ("a", 1, 3.0, 0.1), ("a", 2, 2.0, 0.1004), ("b", 1, None, 0.3), ("b", 2, 5.0, None)], "k string, t int, v double, p double")
    assert {r.column: r.repeated for r in aggregate.repeated_values(df, ["k", "t"], ["v", "p"]).collect()} == {"v": False, "p": True}
    got = {(r.k, r.t): r.p for r in aggregate.trial_means_resolved(df, ["k", "t"], ["v"], {"p": 0.001}).collect()}
    assert got == {("a", 1): pytest.approx(0.1002), ("a", 2): pytest.approx(0.1002), ("b", 1): pytest.approx(0.3), ("b", 2): None}
    kinds = spark.createDataFrame([(1, "d1", "x", "positive"), (1, "d1", "x", "weak"), (1, "d2", "y", "positive"), (1, "d2", None, None), (2, "d1", "x", None)], "run int, d string, g string, kind string")
    shares = {(r.run, r.d): (r.positive, r.weak, r["count"], r.weight) for r in aggregate.responder_shares(kinds, "run", ["d"], "kind", ["positive", "weak"]).collect()}
    assert shares == {(1, "d1"): (0.5, 0.5, 2, pytest.approx(2 / 3)), (1, "d2"): (1.0, 0.0, 1, pytest.approx(1 / 3))}
    fractions = {(r.g, r.run): (r.mean, r.sem, r.datasets) for r in aggregate.responder_fractions(kinds, "run", "d", "g", "kind").collect()}
    assert fractions == {("x", 1): (0.5, None, 1), ("y", 1): (1.0, None, 1), ("all", 1): (pytest.approx(2 / 3), pytest.approx(0.25), 2)}


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_names_are_read_once_they_are_distinct(spark):
    name = F.format_string("line1_100frames_100Hz_200ms_3.56Hz_080MPa_50DC-%d", F.col("id") % 3)
    for out in (parse.info_table(spark.range(9).select(name.alias("name")).distinct(), "name"), parse.runs_of_files(spark.range(9).select(name.alias("name")).distinct(), "name")):
        below = optimized(out)
        assert "REGEXP" not in below[below.rindex("Aggregate") :].upper() and "RLIKE" not in below[below.rindex("Aggregate") :].upper()


def test_first_of_many_trial_files(spark):
    rows = [(f"m_10frames_100Hz_200ms_3.56Hz_0.80MPa_50DC_run{k}_{t:05d}.tif",) for k in (1, 2) for t in (120000, 7, 30)] + [("m_10frames_100Hz_200ms_3.56Hz_0.80MPa_50DC-3.tif",), (None,)]
    got = {(r.run[-8:], r.trials, r.first) for r in parse.runs_of_files(spark.createDataFrame(rows, "name string"), "name").collect()}
    assert got == {(f"run{k}.tif", 3, rows[1 if k == 1 else 4][0]) for k in (1, 2)}


def test_documents_are_parsed_once(spark):
    df = spark.range(2).select("id", F.col("id").cast("string").alias("text"))
    xml = optimized(sessions.document_settings(df, ["id"], "text")).lower()
    assert "join" not in xml and xml.count("xml_to_struct") + xml.count("xmltostructs") + xml.count("from_xml") == 1
    assert optimized(sessions.flatten_json(df, ["id"], "text")).lower().count("parsejson") + optimized(sessions.flatten_json(df, ["id"], "text")).lower().count("parse_json") == 1
