"""Known answers on hand-built rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelake.functions import dose, parse
from tracelake.operators import aggregate, align, curves, filters, kernels, reshape, signals, stats
from tracelake.sources import bundles


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def trace(spark, values, **keys):
    return spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(values)], "roi int, frame int, v double")


def values(df, name="v"):
    return [r[name] for r in df.orderBy("frame").collect()]


def test_denoiser(spark):
    assert values(signals.denoise(trace(spark, [5] * 10), ["roi"], "v", 0.5)) == [5.0] * 10
    assert values(signals.denoise(trace(spark, [0, 1]), ["roi"], "v", 0.5)) == [0.0, 1.0]


def test_substitution_reads_before_it_writes(spark):
    assert values(signals.substitute(trace(spark, "1234"), ["roi"], "v", {1: 0, 2: 1})) == [1, 1, 2, 4]


def test_windows(spark):
    df = trace(spark, range(20))
    assert one(aggregate.in_window(df, ["roi"], "v", 8, 11)).v == 9
    assert one(aggregate.in_window(df, ["roi"], "v", 8, 11, inclusive_stop=True)).v == 9.5
    row = one(aggregate.evoked_change(df, ["roi"], "v", (8, 11), (11, 15)))
    assert (row.pre, row.post, row.change) == (9, 12.5, 3.5)


def test_pulses(spark):
    row = one(spark.range(1).select(reshape.pulse_times(0.2, 100, 50).alias("p")))
    assert len(row.p) == 20 and sum(x.off - x.on for x in row.p) == pytest.approx(0.1)
    on = spark.createDataFrame([(x,) for x in (-0.001, 0.0, 0.004, 0.006, 0.0145, 0.201)], "t double").select(reshape.in_pulse(F.col("t"), 0.2, 100, 50).alias("on"))
    assert [r.on for r in on.collect()] == [False, True, True, False, True, False]


def test_circular(spark):
    def r(phases):
        return one(stats.circular(spark.createDataFrame([(1, float(p)) for p in phases], "g int, p double"), ["g"], "p")).r
    assert r([1, 1, 1]) == pytest.approx(1) and r([0, math.pi]) == pytest.approx(0, abs=1e-12) and r([0, 0, math.pi / 2, -math.pi / 2]) == pytest.approx(0.5)


def test_cross_dataset_mean(spark):
    df = spark.createDataFrame([("a", 1, 0, 10.0), ("b", 1, 0, 2.0), ("b", 2, 0, 2.0), ("b", 3, 0, 2.0)], "dataset string, roi int, x int, v double")
    assert one(aggregate.across_datasets(df, ["x"], "v")).mean == 4
    assert one(aggregate.across_datasets(df, ["x"], "v", weighted=False)).mean == 6


def test_dose(spark):
    row = one(spark.range(1).select(dose.intensity(F.lit(0.8e6)).alias("i"), dose.pressure(dose.intensity(F.lit(0.8e6))).alias("p"), dose.sigmoid_root(dose.sigmoid(F.lit(0.3), 0.5, 0.1), 0.5, 0.1).alias("s"),
                                    dose.saturation_inverse(dose.saturation(F.lit(2.0), 1, 2, 3), 1, 2, 3).alias("e"), dose.round_to_base(F.lit(1.26)).alias("r")))
    assert row.i == pytest.approx(1.9784e5, rel=1e-4) and row.p == pytest.approx(0.8e6) and row.s == pytest.approx(0.3) and row.e == pytest.approx(2) and row.r == 1.5


def test_parsers(spark):
    names = ["line3_100frames_100Hz_200ms_3.56Hz_0.8MPA_50DC-1234", "line3_100frames_100Hz_200ms_3.56Hz_08MPA_50DC", "nonsense"]
    got = [r.e for r in spark.createDataFrame([(n,) for n in names], "n string").select(parse.experiment(F.col("n")).alias("e")).collect()]
    assert tuple(got[0]) == ("line3", 100, 100, 0.2, 3.56, 0.8, 50, 1234) and got[1].p == 0.8 and got[1].run_id is None and got[2] is None
    s = [r.s for r in spark.createDataFrame([("20191112_mouse12_region1",), ("20191112_mouse12_region2_layer5",), ("x",)], "n string").select(parse.session(F.col("n")).alias("s")).collect()]
    assert (str(s[0].date), s[0].mouse, s[0].region, s[0].layer) == ("2019-11-12", "mouse12", "region1", "layer2-3") and s[1].layer == "layer5" and s[2] is None
    o = [r.o for r in spark.createDataFrame([("backward_1mm_right_0.5mm",), ("center",), ("odd",)], "n string").select(parse.offset(F.col("n")).alias("o")).collect()]
    assert tuple(o[0]) == (0.5, -1.0) and tuple(o[1]) == (0, 0) and o[2] is None
    v = [r.v for r in spark.createDataFrame([("true",), ("NaN",), ("1e3",), ("'a b'",), ("[1 2; 3 4]",)], "n string").select(parse.typed_value(F.col("n")).alias("v")).collect()]
    assert v[0].flag and v[1].number is None and v[2].number == 1000 and v[3].text == "a b" and v[4].matrix == [[1, 2], [3, 4]]
    row = one(spark.createDataFrame([("a.b = 1;\nc = 'x = y';\n",)], "n string").select(parse.settings(F.col("n")).alias("m"), parse.pairs(F.lit("k:1,2;l:3,4")).alias("p"), parse.quantile_code(F.lit("q0.1")).alias("q"), parse.label(F.lit("time (s)")).alias("l")))
    assert row.m == {"a.b": "1", "c": "'x = y'"} and row.p == {"k": [1, 2], "l": [3, 4]} and row.q == 0.1 and tuple(row.l) == ("time", "s")
    assert [r.t for r in spark.createDataFrame([(1234.0,), (0.002,), (0.0,)], "x double").select(parse.si_text(F.col("x"), 1).alias("t")).collect()] == ["1.2 k", "2.0 m", "0.0 "]


def test_validity_needs_enough_trials(spark):
    df = spark.createDataFrame([(1, t, t == 0) for t in range(6)] + [(2, t, None if t else True) for t in range(5)], "roi int, trial int, bad boolean")
    assert {(r.roi, r.trial) for r in filters.valid_rows(df, ["bad"], ["roi"]).collect()} == {(1, t) for t in range(1, 6)}


def test_rolling_mirrors_the_borders(spark):
    assert values(signals.rolling(trace(spark, [1, 2, 3, 10]), ["roi"], "v", 3, F.avg, 4)) == pytest.approx([4 / 3, 2, 5, 23 / 3])
    even = signals.rolling(trace(spark, [1, 2, 3, 10]), ["roi"], "v", 4, F.avg, 4)
    assert values(even) == pytest.approx([4 / 3, 2, 5, 23 / 3])  # an even width counts as one less


def test_interpolation_outside_is_null(spark):
    pts = spark.createDataFrame([(1, x) for x in (-1.0, 0.0, 1.5, 3.0, 4.0)], "roi int, x double")
    got = align.interpolate_at(trace(spark, [0, 10, 20, 30]).withColumn("x", F.col("frame").cast("double")), pts, ["roi"], "x", "v").orderBy("x").collect()
    assert [r.v for r in got] == [None, 0, 15, 30, None]


def test_p_values(spark):
    assert stats.betainc(2, 3, 0.4) == pytest.approx(0.5248, abs=1e-10)
    row = one(spark.createDataFrame([(2.0, 10.0, 4.0, 2.0, 12.0)], "t double, d double, f double, a double, b double").select(stats.t_p_value("t", "d").alias("t"), stats.f_p_value("f", "a", "b").alias("f")))
    assert row.t == pytest.approx(0.0733880, abs=1e-6) and row.f == pytest.approx((1 + 2 * 4 / 12) ** -6, abs=1e-9)


def test_spectra_and_filters(spark):
    n, rate = 128, 64.0
    t = np.arange(n) / rate
    df = trace(spark, np.sin(2 * np.pi * 8 * t) + 3)
    for got in (kernels.power_spectrum(df, ["roi"], "v", rate), kernels.welch_spectrum(df, ["roi"], "v", rate, 64)):
        assert max(got.collect(), key=lambda r: r.power).freq == 8
    total = sum(r.power for r in kernels.power_spectrum(df, ["roi"], "v", rate).collect()) * rate / n
    assert total == pytest.approx(0.5)
    assert one(kernels.hilbert(df.withColumn("v", F.col("v") - 3), ["roi"], "v").agg(F.avg("envelope").alias("e"))).e == pytest.approx(1)
    low = values(kernels.zero_phase_filter(trace(spark, np.sin(2 * np.pi * 2 * t) + np.sin(2 * np.pi * 25 * t)), ["roi"], "v", rate, 8.0, order=4))
    assert np.abs(np.array(low) - np.sin(2 * np.pi * 2 * t))[16:-16].max() < 0.03
    assert values(kernels.zero_phase_filter(trace(spark, [4] * 40), ["roi"], "v", rate, 8.0)) == pytest.approx([4] * 40)


def test_surrogates_keep_what_they_should(spark):
    y = np.random.default_rng(1).standard_normal(64)
    phase = np.array(values(kernels.surrogates(trace(spark, y), ["roi"], "v")))
    assert np.abs(np.fft.rfft(phase)) == pytest.approx(np.abs(np.fft.rfft(y))) and not np.allclose(phase, y)
    assert sorted(values(kernels.surrogates(trace(spark, y), ["roi"], "v", method="amplitude"))) == pytest.approx(sorted(y))
    assert sorted(values(signals.seeded_shuffle(trace(spark, y), ["roi"], "v", 3))) == sorted(y.tolist())


def test_robust_trend_ignores_an_outlier(spark):
    y = np.arange(30) * 2.0 + 1
    y[20] += 500
    assert one(kernels.robust_trend(trace(spark, y), ["roi"], "v")).slope == pytest.approx(2, abs=0.01)


def test_components_and_curves(spark):
    rng = np.random.default_rng(2)
    a = rng.standard_normal(200)
    rows = [(1, i, f, float(x)) for i in range(200) for f, x in ((0, a[i]), (1, 2 * a[i]), (2, 0.01 * rng.standard_normal()))]
    df = spark.createDataFrame(rows, "g int, roi int, frame int, v double")
    pairs = stats.correlation_pairs(df, ["g"], ["roi"], "frame", "v", covariance=True)
    own = df.groupBy("g", F.col("frame").alias("a")).agg(F.var_samp("v").alias("r")).select("g", "a", F.col("a").alias("b"), "r")
    got = {r.feature: r for r in kernels.covariance_components(pairs.unionByName(own), ["g"], 1).collect()}
    assert got[0].share > 0.999 and got[1].loading == pytest.approx(2 / 5**0.5, abs=1e-3) and got[0].loading == pytest.approx(1 / 5**0.5, abs=1e-3)
    x = np.linspace(0, 10, 40)
    for kind, p in (("sigmoid", [4.0, 0.7, 3.0, 1.0]), ("gauss", [1.0, 2.0, 5.0, 1.2]), ("power", [2.0, 0.6]), ("linear", [3.0, -1.0])):
        found, _, r2 = curves.fit_many(kind, [x], [curves.evaluate(kind, x[None], np.array([p]))[0][0]])
        assert r2[0] > 0.999999 and np.abs(found[0]) == pytest.approx(np.abs(p), rel=1e-3)
    pts = spark.createDataFrame([(1, float(v), float(2 * v + 1)) for v in x], "g int, x double, y double")
    row = one(curves.fit_curves(pts, ["g"], "x", "y", ["origin", "linear"]))
    assert row.kind == "linear" and row.parameters == pytest.approx([2, 1])


def test_bundles(spark, tmp_path):
    df = spark.createDataFrame([("d1", 1), ("d2", 2)], "dataset string, x int")
    bundles.save_bundle({"stats": df, "info": df.drop("dataset")}, f"{tmp_path}/b")
    loaded = bundles.load_bundle(spark, f"{tmp_path}/b", ["stats", "info"])
    assert sorted(map(tuple, loaded["stats"].select("dataset", "x").collect())) == [("d1", 1), ("d2", 2)]
    assert bundles.select_datasets(df, include_any=["1", "2"], exclude=["d2"]).count() == 1
    assert bundles.file_list(spark, f"{tmp_path}/b", pattern=r"\.parquet$").count() >= 2
    with pytest.raises(Exception):
        bundles.load_bundle(spark, f"{tmp_path}/b", ["nothing"])["nothing"].count()
    s = spark.createDataFrame([(r, {"power": p, "mode": m}) for r, p, m in (("a", "1.0", "x"), ("b", "1.0", "x"), ("c", "1.2", "y"))], "run string, settings map<string,string>")
    bundles.write_settings(s, f"{tmp_path}/s")
    assert {(r.key, r.reference, r.run) for r in bundles.settings_mismatches(bundles.read_settings(spark, f"{tmp_path}/s")).collect()} == {("power", "1.0", "c"), ("mode", "x", "c")}
