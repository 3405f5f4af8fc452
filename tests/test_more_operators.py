"""Known answers for operators that have no SQL, and for nulls, gaps, short and empty inputs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_operators import one, trace, values
from tracelake.functions import dose, parse
from tracelake.operators import acquisition, aggregate, align, designs, filters, fits, frames, kernels, models, reshape, signals, stats, tables
from tracelake.plans import more_queries
from tracelake.sources import bundles


def gaps(spark, rows):
    return spark.createDataFrame([(1, f, None if v is None else float(v)) for f, v in rows], "roi int, frame int, v double")


def test_kernels_keep_frames_and_leave_out_nulls(spark):
    df = gaps(spark, [(10, 20), (12, 24), (13, None), (20, 40), (30, 60)])
    fit = one(kernels.robust_trend(df, ["roi"], "v"))
    assert (fit.slope, fit.intercept) == pytest.approx((2, 0), abs=1e-9)
    assert [r.frame for r in kernels.hilbert(df, ["roi"], "v").orderBy("frame").collect()] == [10, 12, 20, 30]
    low = kernels.zero_phase_filter(df, ["roi"], "v", 4, 1).orderBy("frame").collect()
    assert [r.frame for r in low] == [10, 12, 20, 30] and all(math.isfinite(r.v) for r in low)
    assert sorted(r.v for r in kernels.surrogates(df, ["roi"], "v", method="gauss").collect()) == [20, 24, 40, 60]
    nothing = gaps(spark, [(0, None)])
    for out in (kernels.hilbert(nothing, ["roi"], "v"), kernels.welch_spectrum(nothing, ["roi"], "v", 4, 16), kernels.power_spectrum(df.limit(0), ["roi"], "v", 4)):
        assert out.count() == 0


def test_short_traces_are_one_segment(spark):
    short = kernels.welch_spectrum(trace(spark, [1, 2, 1, 2, 1, 2]), ["roi"], "v", 6, 16).orderBy("freq").collect()
    assert [r.freq for r in short] == [0, 1, 2, 3] and short[-1].power == max(r.power for r in short)
    assert kernels.welch_spectrum(trace(spark, [3]), ["roi"], "v", 6, 16).count() == 1


def test_band_filters():
    t = np.arange(400) / 50
    slow, mid, fast = (np.sin(2 * np.pi * f * t) for f in (0.4, 4, 15))
    for order in (1, 2, 3):
        band, stop = (kernels.butterworth(order, (2, 8), 50, k) for k in ("band", "stop"))
        core = slice(100, 300)
        passed, stopped = kernels.filtered(band, slow + mid + fast)[core], kernels.filtered(stop, slow + mid + fast)[core]
        assert np.abs(passed - mid[core]).max() < (0.45 if order == 1 else 0.12)
        assert np.abs(stopped - (slow + fast)[core]).max() < (0.45 if order == 1 else 0.12)
    gain = lambda s, f: np.prod([abs((b0 + b1 * z + b2 * z * z) / (1 + a1 * z + a2 * z * z)) for b0, b1, b2, a1, a2 in s for z in [np.exp(-2j * np.pi * f / 50)]])
    assert gain(kernels.butterworth(2, (2, 8), 50, "band"), 2) == pytest.approx(math.sqrt(0.5), rel=1e-6)
    assert gain(kernels.butterworth(3, (2, 8), 50, "stop"), 8) == pytest.approx(math.sqrt(0.5), rel=1e-6)


def test_lag_sign_and_scale(spark):
    a, b = (trace(spark, [1.0 if k == at else 0.0 for k in range(10)]) for at in (5, 7))
    best = one(signals.best_lag(signals.cross_correlation(a, b, ["roi"], "v", 4), ["roi"]))
    assert (best.lag, best.corr) == (-2, 0.1)
    assert one(signals.best_lag(signals.cross_correlation(b, a, ["roi"], "v", 4), ["roi"])).lag == 2


def test_intra_error_of_equal_errors(spark):
    """Datasets with one standard error have it, whatever their weights."""
    rows = [("a", 1, u, v) for u, v in ((1, 0.0), (2, 2.0))] + [("b", 1, u, v) for u, v in ((1, 10.0), (1, 12.0))]
    out = one(aggregate.across_datasets(spark.createDataFrame(rows, "dataset string, x int, roi int, v double"), ["x"], "v"))
    assert out.sem == pytest.approx(1.0) and out["mean"] == pytest.approx((2 * 1 + 11) / 3)


def test_scalar_functions_in_their_units(spark):
    row = one(spark.range(1).select(
        dose.radiation_force(F.lit(1.0), F.lit(1.0)).alias("force"), dose.heat_rate(F.lit(1.0), F.lit(1.0)).alias("heat"), dose.sigmoid_decay(F.lit(0.0), 1, 2, 0.5, 3, 1).alias("bump"),
        frames.skew_to_quantile(F.lit(50.0)).alias("high"), frames.skew_to_quantile(F.lit(-50.0)).alias("low"), designs.skew_to_level(F.lit(0.0)).alias("level"), stats.t_to_r(F.lit(-3.0), F.lit(11)).alias("r"),
    ))
    assert row.force == pytest.approx(2 * 6.8032 * 1e4 / 1546.3) and row.heat == pytest.approx(2 * 6.8032 * 1e-2 / (3630 * 1046 / 1e6))
    assert row.bump == pytest.approx(3 / (1 + math.exp(2)) * math.exp(0.5) + 1)
    assert (row.high, row.low, row.level) == pytest.approx((0.99, 0.01, 0.5)) and row.r == pytest.approx(math.sqrt(0.5))


def test_nulls_in_selection_and_ranks(spark):
    df = spark.createDataFrame([(1, 1, None), (1, 2, 5.0), (1, 3, 6.0), (1, 4, 9.0)], "g int, k int, v double")
    assert one(filters.closest_to_median(df, "v", "k", ["g"])).k == 3
    assert one(align.nearest(df, [5.4], ["g"], "v")).v == 5.0
    assert [(r.k, r.bin) for r in stats.quantile_bins(df, "v", 2, ["g"]).orderBy("k").collect()] == [(1, None), (2, 0), (3, 0), (4, 1)]
    assert tuple(one(stats.rank_sum(df, ["g"], "v", F.col("k") >= 3)))[1:] == (2, 1, 2)
    for out in (filters.closest_to_median(df.limit(0), "v", "k", ["g"]), stats.rank_sum(df.limit(0), ["g"], "v", F.lit(True)), stats.histogram(df.limit(0), "v", 4, ["g"])):
        assert out.count() == 0
    assert [tuple(r) for r in stats.histogram(df.filter("k = 2"), "v", 4, ["g"]).collect()] == [(1, 0, 1)]


def test_peaks_with_prominence(spark):
    y = [0, 1, 0, 3, 3, 0, 2, 1.5, 2.5, 0]
    peak = one(designs.response_peaks(trace(spark, y), ["roi"], "v", prominence=0.5, rate=2))
    assert (peak.frame, peak.t, peak.v, peak.prominence) == (3, 1.5, 3.0, 3.0) and peak.width == pytest.approx(2.0 / 2)
    assert one(designs.response_peaks(trace(spark, y[5:]), ["roi"], "v", prominence=0.6)).frame == 3
    assert designs.response_peaks(trace(spark, [1, 2, 3, 4]), ["roi"], "v").count() == 0
    assert one(designs.response_peaks(trace(spark, y), ["roi"], "v", neighbours=1)).v == pytest.approx(2.0)


def test_autoregression_recovers_its_coefficients(spark):
    y = [1.0, 0.5]
    for _ in range(60):
        y.append(0.2 + 0.6 * y[-1] - 0.3 * y[-2])
    fit = one(designs.autoregression(trace(spark, y), ["roi"], "v", 2, 40))
    assert [fit.intercept, *fit.coefficients] == pytest.approx([0.2, 0.6, -0.3], abs=1e-6)
    ahead = designs.autoregressive_forecast(trace(spark, y), ["roi"], "v", 2, 40, 50).orderBy("frame").collect()
    assert [r.frame for r in ahead] == list(range(40, 50)) and [r.predicted for r in ahead] == pytest.approx(y[40:50], abs=1e-6)


def test_stretched_template(spark):
    base = [0.0] * 10 + [-1.0, -2.0, -3.0, -2.0, -1.0] * 2 + [0.0] * 20
    moved = np.interp((np.arange(40) - 3) / 1.2, np.arange(40), base)
    best = one(designs.match_stretched(trace(spark, moved), base, ["roi"], "v", 5, [0.8, 1.0, 1.2]))
    assert (best.stretch, best["shift"]) == (1.2, 3) and best.corr > 0.98
    assert designs.match_stretched(trace(spark, [1.0] * 40), base, ["roi"], "v", 2, [1.0]).count() == 0


def test_two_way_variance_of_a_balanced_table(spark):
    rows = [(1, a, b, 10.0 * a + 3 * b + (5 if a == b == 1 else 0) + e) for a in range(2) for b in range(2) for e in (-1.0, 1.0)]
    out = {r.factor: r for r in designs.two_way_anova(spark.createDataFrame(rows, "g int, a int, b int, v double"), ["g"], "a", "b", "v").collect()}
    assert (out["a"].ss, out["b"].ss, out["a:b"].ss, out["residual"].ss) == pytest.approx((2 * 12.5**2, 2 * 5.5**2, 2 * 2.5**2, 8))
    assert out["a"].f == pytest.approx(312.5 / 2) and out["residual"].dof == 4 and out["residual"].p is None
    assert out["a:b"].p == pytest.approx(0.0668, abs=1e-3)
    assert out["a"].omega2 == pytest.approx((312.5 - 2) / (312.5 + 2 + 2))


def test_p_values_both_ways(spark):
    df = spark.createDataFrame([(0.025, 10.0), (0.05, 5.0), (0.9, 7.0), (None, 3.0), (0.1, 0.0)], "p double, n double")
    t = [r.t for r in df.select(stats.p_t_value("p", "n").alias("t")).collect()]
    assert t[:3] == pytest.approx([2.228139, 2.015048, -1.414924], abs=1e-5) and t[3:] == [None, None]
    assert designs.normal_quantile(0.975) == pytest.approx(1.959964, abs=1e-6)
    assert designs.z_maximum_threshold(0.05, 1) == pytest.approx(1.644854, abs=1e-6)


def test_gaussian_histogram_and_classes(spark):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(1, float(x)) for x in rng.normal(3, 2, 4000)], "g int, v double")
    fit = one(designs.gaussian_histogram(df, ["g"], "v", 40))
    assert fit.x0 == pytest.approx(3, abs=0.15) and fit.sigma == pytest.approx(2, abs=0.2)
    n = {r["class"]: r["count"] for r in designs.ternary_classes(df, designs.gaussian_histogram(df, ["g"], "v", 40), ["g"], "v").groupBy("class").count().collect()}
    assert 30 < n[1] < 180 and 30 < n[-1] < 180


def test_denoise_and_moves_of_repeated_frames(spark):
    moves = acquisition.expand_moves(spark.createDataFrame([(1, 0, 4), (2, 3, None)], "src int, dst int, repeat int"), 10)
    assert sorted(tuple(r) for r in moves.collect()) == [(1, 0), (2, 3), (5, 4)]
    assert values(acquisition.move_frames(trace(spark, range(10)), ["roi"], "v", moves)) == [1, 1, 2, 2, 5, 5, 6, 7, 8, 9]


def test_checks_raise_when_read(spark):
    df = spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "g int, k string, run int")
    with pytest.raises(Exception, match="several values of k"):
        tables.singleton(df, ["g"], "k").collect()
    with pytest.raises(Exception, match="disagree"):
        tables.consistent_merge(df, df.withColumn("k", F.lit("a")), ["g", "run"], ["k"]).collect()
    with pytest.raises(Exception, match="several runs"):
        tables.drop_repeated_runs(df.withColumn("k", F.lit("a")), "g", "k", "run", "raise").collect()
    with pytest.raises(ValueError):
        dose.dose_metric(F.lit(1.0), F.lit(1.0), "nothing")


def test_sources_round_trip(spark, tmp_path):
    bundles.save_value(spark, f"{tmp_path}/w", "post", 12)
    assert bundles.load_value(spark, f"{tmp_path}/w", "post") == 12
    with pytest.raises(ValueError):
        bundles.load_value(spark, f"{tmp_path}/w", "pre")
    stats_, counts = spark.createDataFrame([("pv", 1, 0.5)], "line string, run int, mean double"), spark.createDataFrame([("pv", 7)], "line string, n int")
    bundles.save_lines(stats_, counts, f"{tmp_path}/l")
    a, b = bundles.load_lines(spark, f"{tmp_path}/l", "run int, mean double", "n int")
    assert [tuple(r) for r in a.collect()] == [(1, 0.5, "pv")] and [tuple(r) for r in b.collect()] == [(7, "pv")]
    bundles.save_lines(stats_, counts.withColumn("line", F.lit("sst")), f"{tmp_path}/m")
    with pytest.raises(ValueError):
        bundles.load_lines(spark, f"{tmp_path}/m", "run int, mean double", "n int")
    for d in ("a_region1", "b_region1", "c"):
        bundles.save_bundle({"stats": stats_}, f"{tmp_path}/{d}")
    found = bundles.load_datasets(spark, {d: f"{tmp_path}/{d}" for d in ("a_region1", "b_region1", "c")}, ["stats"], include_all=["region"], exclude=["b_"])
    assert [r.dataset for r in found["stats"].collect()] == ["a_region1"]
    files = spark.createDataFrame([("x3.tif",), ("x10.tif",), ("x2.tif",)], "name string")
    assert [r.name for r in bundles.sampled_files(files, "name", 2).collect()] == ["x10.tif", "x2.tif"]
    assert bundles.sampled_files(files, "name", 2, seed=1).count() == 2


def test_names_in_no_known_form_are_null(spark):
    df = spark.createDataFrame([("nothing",), (None,), ("",)], "n string").select(parse.acquisition(F.col("n")).alias("a"), acquisition.frame_file(F.col("n")).alias("f"), parse.experiment_code(F.col("n")).alias("e"))
    assert all(r.a is None and r.f is None and r.e is None for r in df.collect())


def test_correlations_over_common_samples(spark, monkeypatch):
    monkeypatch.setattr(stats, "BLOCK_UNITS", 4)
    monkeypatch.setattr(stats, "BLOCK_SAMPLES", 7)
    rng = np.random.default_rng(3)
    values_ = rng.standard_normal((11, 30)) + 50
    values_[rng.random((11, 30)) < 0.3] = np.nan
    rows = [(g, u, k, None if np.isnan(v) else float(v)) for g in range(2) for u, line in enumerate(values_ * (g + 1)) for k, v in enumerate(line)]
    df = spark.createDataFrame(rows, "g int, u int, k int, v double")
    for covariance in (False, True):
        got = {(r.g, r.a, r.b): r.r for r in stats.correlation_pairs(df, ["g"], ["k"], "u", "v", covariance=covariance).collect()}
        assert sorted(got) == [(g, a, b) for g in range(2) for a in range(11) for b in range(a + 1, 11)]
        for (g, a, b), r in got.items():
            both = ~np.isnan(values_[a]) & ~np.isnan(values_[b])
            x, y = values_[a][both] * (g + 1), values_[b][both] * (g + 1)
            assert r == pytest.approx(np.cov(x, y)[0, 1] if covariance else np.corrcoef(x, y)[0, 1], abs=1e-9)


def test_lags_of_traces_with_gaps(spark):
    """Missing frames count as zeros, and frames may begin anywhere."""
    a = gaps(spark, [(5, 1.0), (7, 2.0), (8, None)])
    b = gaps(spark, [(-2, 3.0), (4, 1.0), (6, 5.0)])
    got = {r.lag: r.corr for r in signals.cross_correlation(a, b, ["roi"], "v", 3).collect()}
    x, y = {5: 1.0, 7: 2.0}, {-2: 3.0, 4: 1.0, 6: 5.0}
    assert got == {lag: pytest.approx(sum(v * y.get(f - lag, 0) for f, v in x.items()) / 3) for lag in range(-3, 4)}
    assert signals.cross_correlation(a.limit(0), b, ["roi"], "v", 3).count() == 0


def test_best_coefficient_of_odd_units(spark):
    rows = [(1, s, n) for s, n in ((5.0, 1.0), (6.0, 2.0), (9.0, 1.0), (5.0, None))] + [(2, 1.0, 1.0), (2, 1.0, 1.0), (3, None, 1.0)]
    df = spark.createDataFrame(rows, "roi int, s double, n double")
    got = {r.roi: (r.alpha, r.skew) for r in stats.best_coefficient(df, ["roi"], "s", "n", [0.0, 1.0, 4.0]).collect()}
    def skew(f):
        c = np.array(f) - np.mean(f)
        return (c**3).mean() / (c**2).mean() ** 1.5
    best = max((0.0, 1.0), key=lambda a: skew([5 - a, 6 - 2 * a, 9 - a]))  # 4 makes it negative
    assert got == {1: (best, pytest.approx(skew([5 - best, 6 - 2 * best, 9 - best]))), 2: (None, None)}


def test_onsets_pairs_and_tables(spark):
    df = spark.createDataFrame([(1, 0.0, 1.0, 0.1), (1, 0.15, 3.0, 0.1), (1, 0.2, 4.0, 0.1), (2, 0.0, 2.0, 0.0), (3, 0.0, 2.0, None)], "roi int, t double, v double, onset double")
    got = sorted((r.roi, r.pulse, round(r.since, 9), r.v) for r in reshape.split_pulses(df, ["roi"], "v", "t", 0.2, 10, onset="onset").collect())
    assert got == [(1, 0, 0.05, 0.0), (1, 1, 0.0, 0.0), (2, 0, 0.0, 0.0)]
    pair = spark.createDataFrame([(x,) for x in (0.0, 1e-15, 5e-4, 999.0, -1000.0, 3e15, None)], "x double").select("x", parse.si_pair(F.col("x")).alias("s"), parse.si_pair(F.col("x"), 2).alias("area")).collect()
    assert [None if r.s is None else r.s.prefix for r in pair] == ["", "p", "u", "", "k", "T", None] and pair[4].area.prefix == ""
    table = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 5.0), ("b", 1, 9.0), ("b", 2, None)], "r string, c int, v double")
    rows = {(r.r, r.c): (r.level, r.row_place, r.column_place) for r in reshape.sorted_stat_table(table, "r", "c", "v").collect()}
    assert rows == {("a", 1): (1.0, 1, 0), ("a", 2): (5.0, 1, 1), ("b", 1): (9.0, 0, 0), ("b", 2): (None, 0, 1)}


def test_strict_expansion_and_cells(spark):
    fine = spark.createDataFrame([(1, 0), (1, 1), (2, 0)], "k int, f int")
    coarse = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "k int, v string")
    assert sorted(map(tuple, align.expand(fine, coarse, ["k"], "c_", strict=True).collect()), key=repr) == [(1, 0, "a"), (1, 1, "a"), (2, 0, None)]
    for wrong in (coarse.filter("k <> 2"), coarse.union(coarse.filter("k = 1"))):
        with pytest.raises(Exception, match="not in the coarse one"):
            align.expand(fine, wrong, ["k"], strict=True).collect()
    texts = spark.createDataFrame([("{'a';'b c'}",), ("{1 2}",), ("{}",), ("{[1 2] [3]}",), ("[1 2]",)], "t string").select(parse.typed_value(F.col("t")).alias("v")).collect()
    assert [r.v.cells for r in texts] == [["a", "b c"], ["1", "2"], [], ["[1 2]", "[3]"], None]


def test_repeated_values_of_many_partitions(spark):
    df = spark.range(20000).select((F.col("id") % 50).alias("k"), (F.col("id") % 50 / 10).alias("same"), "id").repartition(13).withColumnRenamed("id", "other")
    assert {r.column: r.repeated for r in aggregate.repeated_values(df, ["k"], ["same", "other"]).collect()} == {"same": True, "other": False}


def test_robust_scale_is_the_exact_median(spark):
    df = spark.range(0, 60000, 1, 9).select(F.lit(1).alias("k"), (F.col("id") % 7).cast("double").alias("x"), ((F.col("id") * 7919) % 60013).cast("double").alias("y"))
    got = one(fits.robust_fit(df, ["k"], "x", "y", rounds=1))
    i = np.arange(60000)
    x, y = (i % 7).astype(float), ((i * 7919) % 60013).astype(float)
    slope, level = np.polyfit(x, y, 1)
    assert got.scale == pytest.approx(np.sort(np.abs(y - level - slope * x))[29999] / fits.NORMAL_MEDIAN, rel=1e-10)


def test_flat_frames_have_no_correction(spark):
    ref, flat = [4990.0, 4995.0, 5000.0, 5003.0, 5004.0, 5008.0], [5001.0, 5003.0, 5000.0, 4999.0, 5002.0, 5001.0]
    x = np.array(ref) - np.mean(ref)
    flat = np.round(np.array(flat) - x * (x @ (flat - np.mean(flat))) / (x @ x), 12)  # zero slope but for rounding
    rows = [(1, c, f, p, v + c) for c in (0, 1) for f, image in enumerate([ref, ref, ref, flat]) for p, v in enumerate(map(float, image))]
    df = spark.createDataFrame(rows, "stack int, channel int, frame int, pixel int, v double").repartition(7)
    got = acquisition.correct_by_channel(df, "channel", 0)
    assert got.filter("frame = 3 and v is null").count() == 12 == got.filter("frame = 3").count() and got.filter("frame < 3 and v is null").count() == 0
    gone = signals.denoise(gaps(spark, [(0, None), (1, 2), (2, None), (3, 6)]), ["roi"], "v", 0.5, keep_gaps=True)
    assert values(gone) == [None, 2.0, None, 5.0]


def test_unstable_groups_at_the_limit(spark):
    rows = [(u, k, float(q * f)) for u, f in enumerate(range(1, 40, 2)) for k, q in enumerate([27, 33, 27, 33, 30, 30, 30])]
    df = spark.createDataFrame([*rows, (99, 1, 1.0), (99, 2, 2.0), (100, 1, 0.0), (100, 2, 5.0)], "u int, run int, q double")
    got = filters.unstable_groups(df, "q", "u", "run", F.col("run"), 0.1).collect()
    assert [(r.u, r.deviation) for r in got] == [(99, pytest.approx(1 / 3))]  # deviations of just the limit don't pass it


def test_extrapolate_from_fewer_frames(spark):
    df = gaps(spark, [(0, 3), (1, 9), (2, 9), (3, 1), (4, 2), (5, 9), (9, 4)])
    got = models.extrapolate(df, ["roi"], "v", [0, 1, 2, 5, 9], order=1, fewer=True)
    assert values(got) == [3.0, 3.0, 3.0, 1.0, 2.0, 3.0, 4.0]
    assert values(models.extrapolate(df, ["roi"], "v", [0, 1, 2, 5, 9], order=1))[1] == 9.0


def test_units_are_sent_to_few_blocks(spark, monkeypatch):
    monkeypatch.setattr(stats, "BLOCK_UNITS", 2)
    monkeypatch.setattr(stats, "BLOCKS", 3)
    df = spark.range(0, 60 * 5).select((F.col("id") % 60).alias("u"), F.floor(F.col("id") / 60).alias("k"), F.rand(1).alias("v"), F.lit(1).alias("g"))
    pairs = stats.correlation_pairs(df, ["g"], ["k"], "u", "v")
    assert pairs.count() == pairs.select("a", "b").distinct().count() == 60 * 59 // 2


def test_pairs_of_a_large_group_are_dealt_to_tasks(spark, monkeypatch):
    """Block pairs of one group are tasks of their own, also where nothing is small enough to be broadcast: one task would sort and spill all copies."""
    monkeypatch.setattr(stats, "BLOCK_UNITS", 4)
    monkeypatch.setattr(stats, "SMALL_GROUP", 50, raising=False)
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in settings}
    rng = np.random.default_rng(8)
    v = rng.standard_normal((40, 12)) * 10.0 ** np.array([0, 39, -60, 5])[np.arange(40) % 4, None]
    df = spark.createDataFrame([(1, u, k, float(x)) for u, line in enumerate(v) for k, x in enumerate(line)], "g int, u int, k int, v double")
    try:
        for k, x in settings.items():
            spark.conf.set(k, x)
        rows = stats.correlation_pairs(df, ["g"], ["k"], "u", "v").withColumn("task", F.spark_partition_id()).collect()
    finally:
        for k, x in before.items():
            spark.conf.set(k, x)
    want = np.corrcoef(v)
    assert sorted((r.a, r.b) for r in rows) == [(a, b) for a in range(40) for b in range(a + 1, 40)]
    assert all(r.r == pytest.approx(want[r.a, r.b], abs=1e-9) for r in rows)
    assert len({r.task for r in rows}) > 1


@pytest.mark.parametrize(("gaps_", "shared"), [("none", 8), ("sets", 8), ("sets", 2), ("any", 3)])
def test_mean_correlations_of_units_equal_those_of_pairs(spark, monkeypatch, gaps_, shared):
    monkeypatch.setattr(stats, "SHARED_SETS", shared)
    monkeypatch.setattr(stats, "BLOCK_UNITS", 4)
    monkeypatch.setattr(stats, "BLOCKS", 2)
    rng = np.random.default_rng(5)
    v = rng.standard_normal((23, 12)) + 50
    if gaps_ == "sets":  # whole, halves that overlap or not, and one sample only
        v[5:9, 6:], v[9:13, :6], v[13:17, 8:], v[17, 1:] = np.nan, np.nan, np.nan, np.nan
    if gaps_ == "any":
        v[8:][rng.random((15, 12)) < 0.3] = np.nan
    v[0] = v[1]
    rows = [(g, u, k, None if np.isnan(x) else float(x)) for g in range(2) for u, line in enumerate(v[: 23 - 20 * g]) for k, x in enumerate(line)]
    rows += [(0, 30, k, 7.25) for k in range(12)] + [(0, 31, k, math.inf if k == 3 else float(k)) for k in range(12)] + [(2, 1, k, float(k)) for k in range(12)]
    df = spark.createDataFrame(rows, "g int, u int, k int, v double")
    got = {(r.g, r.unit): r.r for r in stats.unit_mean_correlations(df, ["g"], ["k"], "u", "v").collect()}
    want = {(r.g, r.unit): r.r for r in stats.mean_correlations(stats.correlation_pairs(df, ["g"], ["k"], "u", "v"), ["g"]).collect()}
    assert len(got) == (25 if gaps_ == "sets" else 26) and got == pytest.approx(want, abs=1e-12)


def test_mean_correlations_of_one_set_make_no_pairs(spark, monkeypatch):
    def fail(*args, **kwargs):
        raise AssertionError("pairs")

    monkeypatch.setattr(stats, "correlation_pairs", fail)
    df = spark.range(0, 3000 * 5).select((F.col("id") % 3000).alias("roi"), F.lit(0).alias("trial"), F.floor(F.col("id") / 3000).alias("frame"), F.rand(1).alias("v"), F.lit(1).alias("dataset"))
    rows = df.orderBy("roi", "frame").collect()
    r = np.corrcoef(np.array([x.v for x in rows]).reshape(3000, 5))
    means = (r.sum(1) - 1) / 2999
    out = more_queries.mean_correlations(df)
    assert [x.r for x in out.orderBy("unit").collect()] == pytest.approx(list(means), abs=1e-6)
    assert [x.unit for x in out.orderBy("place").collect()] == list(np.argsort(-means))
