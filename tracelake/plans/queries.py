"""Registered queries of the library's operators, each with equivalent SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracelake.functions import dose, parse
from tracelake.operators import aggregate, align, curves, filters, frames, kernels, models, reshape, signals, stats
from tracelake.plans import views
from tracelake.plans.pipelines import responder_fraction
from tracelake.sources import bundles

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {"responder_fraction": responder_fraction}
ORACLE_SQL: dict[str, str] = {
    "responder_fraction": f"""
WITH {views.SQL['traces']},
b AS (SELECT dataset, roi, quantile_cont(v + 10, 0.05) AS f0 FROM traces GROUP BY ALL),
d AS (SELECT t.dataset, t.roi, trial, frame, (v + 10 - f0) / f0 AS dff FROM traces t JOIN b ON t.dataset = b.dataset AND t.roi = b.roi),
z AS (SELECT *, (dff - avg(dff) OVER w) / stddev_samp(dff) OVER w AS z FROM d WINDOW w AS (PARTITION BY dataset, roi)),
e AS (SELECT dataset, roi, trial, avg(z) FILTER (WHERE frame < 4) AS pre, avg(z) FILTER (WHERE frame >= 4) AS post FROM z GROUP BY ALL),
n AS (SELECT *, count(*) FILTER (WHERE pre <= 0.7) OVER (PARTITION BY dataset, roi) AS n FROM e),
u AS (SELECT dataset, roi, avg(post - pre) * sqrt(count(*)) AS change FROM n WHERE pre <= 0.7 AND n >= 5 GROUP BY ALL)
SELECT dataset, round(count(*) FILTER (WHERE change < -1) / count(*), 6) AS negative, round(count(*) FILTER (WHERE change > 1) / count(*), 6) AS positive,
  round(count(*) FILTER (WHERE change BETWEEN -1 AND 1) / count(*), 6) AS weak, count(*) AS total FROM u GROUP BY dataset
""",
}

UNIT, TRACE = ["dataset", "roi"], ["dataset", "roi", "trial"]
KINDS = ["negative", "positive", "weak"]


def query(view: str | None, sql: str | None = None):
    """Register a function of one view under its name; ``sql`` may use the view by name."""

    def register(fn: Callable[[DataFrame], DataFrame]):
        load = {"flat": views.flat_traces, "traces": views.traces, "stats": views.stats, "trials": views.trials}.get(view)
        QUERIES[fn.__name__] = (lambda spark, sf: fn(load(spark, sf))) if load else (lambda spark, sf: fn(views.table(spark, sf, view)))
        if sql:
            ORACLE_SQL[fn.__name__] = f"WITH {views.SQL[view]}\n{sql}" if view in views.SQL and not sql.startswith("WITH") else sql.replace("$VIEW", views.SQL.get(view, ""))
        return fn

    return register


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, and without negative zeros, so that engines that add in other orders agree."""
    return df.select([(F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def r(expression: str, digits: int = 6) -> str:
    return f"round({expression}, {digits}) + 0.0"


# selection


@query("traces", f"SELECT dataset, roi, trial, frame, {r('v')} AS v FROM traces WHERE dataset IN (1, 2) AND trial = 3 AND frame BETWEEN 2 AND 5")
def filter_bounds(t):
    return rounded(filters.filter_data(t, dataset=[1, 2], trial=3, bounds={"frame": (2, 5)}))


@query("stats", f"SELECT dataset, roi, count(*) AS n FROM stats WHERE (run NOT IN (1, 7)) AND dataset NOT LIKE '%A%' GROUP BY ALL")
def discard_and_exclude(t):
    return filters.exclude_matching(filters.discard(t, "run", [1, 7]), ["A"]).groupBy("dataset", "roi").agg(F.count("*").alias("n"))


@query("stats", """
, s AS (SELECT * FROM stats WHERE p = 0.05 UNION ALL SELECT dataset, roi, run, 0.05, 0.0, q, price FROM stats WHERE p = 0)
SELECT dataset, dc, count(*) AS n, round(avg(q), 6) + 0.0 AS q FROM s GROUP BY ALL""")
def parameter_sweep(t):
    return rounded(filters.sweep(t, "dc", p="p", dc="dc", p_ref=0.05, dc_ref=0.04, add_zero_dc=True).groupBy("dataset", "dc").agg(F.count("*").alias("n"), F.avg("q").alias("q")))


@query("trials", """
, f AS (SELECT *, v > 90 AS high, v < 2 AS low FROM trials),
g AS (SELECT *, NOT (coalesce(high, false) OR coalesce(low, false)) AS clean FROM f),
h AS (SELECT *, sum(CAST(clean AS INT)) OVER (PARTITION BY roi, run) AS n FROM g)
SELECT event_id, roi, run, round(v, 6) + 0.0 AS v FROM h WHERE clean AND n >= 5""")
def valid_trials(t):
    flagged = t.select("event_id", "roi", "run", "v", (F.col("v") > 90).alias("high"), (F.col("v") < 2).alias("low"))
    return rounded(filters.valid_rows(flagged, ["high", "low"], ["roi", "run"]))


@query("trials", """
, e AS (SELECT run, quantile_cont(v, 0.25) AS a, quantile_cont(v, 0.75) AS b FROM trials GROUP BY run)
SELECT event_id, t.run FROM trials t JOIN e USING (run) WHERE v BETWEEN a AND b""")
def quantile_rows(t):
    return filters.quantile_slice(t, "v", 0.25, 0.75, ["run"]).select("event_id", "run")


@query("trials", """
, m AS (SELECT run, median(v) AS m FROM trials GROUP BY run)
SELECT run, event_id FROM (SELECT t.run, event_id, row_number() OVER (PARTITION BY t.run ORDER BY abs(v - m), event_id) AS k FROM trials t JOIN m USING (run) WHERE v IS NOT NULL) WHERE k = 1""")
def closest_to_median(t):
    return filters.closest_to_median(t, "v", "event_id", ["run"])


@query("flat", """
, e AS (SELECT dataset, median(v) AS m, stddev_samp(v) AS s FROM flat GROUP BY dataset)
SELECT dataset, count(*) AS n FROM flat JOIN e USING (dataset) WHERE abs(v - m) < 2 * s GROUP BY dataset""")
def outliers_excluded(t):
    return filters.exclude_outliers(t, "v", 2, ["dataset"]).groupBy("dataset").agg(F.count("*").alias("n"))


@query("trials", """
, e AS (SELECT run, quantile_cont(v, 0.95) AS q FROM trials GROUP BY run)
SELECT event_id, t.run FROM trials t JOIN e USING (run) WHERE v > q""")
def highest_responders(t):
    return filters.above_group_quantile(t, "v", 0.95, ["run"]).select("event_id", "run")


@query("flat", """
, s AS (SELECT *, CAST(sign(v) AS INT) AS sign FROM flat),
c AS (SELECT *, CASE WHEN sign <> lag(sign) OVER (PARTITION BY dataset, roi ORDER BY frame) THEN 1 ELSE 0 END AS turn FROM s),
i AS (SELECT *, sum(turn) OVER (PARTITION BY dataset, roi ORDER BY frame) AS island FROM c)
SELECT dataset, roi, min(frame) AS start, max(frame) AS "end", sign FROM i GROUP BY dataset, roi, island, sign HAVING count(*) > 1""")
def sign_intervals(t):
    return filters.sign_intervals(t, "v", "frame", UNIT)


@query("stats", """
, m AS (SELECT roi, run, median(q) AS m FROM stats GROUP BY ALL),
f AS (SELECT roi, arg_min(m, run) AS m0, sum(m) AS s, count(m) AS n FROM m GROUP BY roi),
x AS (SELECT roi, max(abs(n * m - s) / abs(s)) AS deviation FROM m JOIN f USING (roi) WHERE m0 <> 0 AND s <> 0 GROUP BY roi)
SELECT roi, round(deviation, 6) + 0.0 AS deviation FROM x WHERE deviation > 0.1::DOUBLE""")
def unstable_units(t):
    return rounded(filters.unstable_groups(t, "q", "roi", "run", F.col("run"), 0.1))


# aggregates


@query("traces", f"SELECT dataset, roi, trial, {r('avg(v)')} AS v FROM traces WHERE frame >= 2 AND frame < 6 GROUP BY ALL")
def window_mean(t):
    return rounded(aggregate.in_window(t, TRACE, "v", 2, 6))


@query("traces", f"SELECT dataset, roi, trial, {r('(v2 * 1.0 + v3 * 2.0 + v4 * 1.0) / 4.0')} AS v FROM (SELECT dataset, roi, trial, sum(v) FILTER (WHERE frame = 2) AS v2, sum(v) FILTER (WHERE frame = 3) AS v3, sum(v) FILTER (WHERE frame = 4) AS v4 FROM traces GROUP BY ALL)")
def weighted_window(t):
    return rounded(aggregate.weighted_in_window(t, TRACE, "v", {2: 1, 3: 2, 4: 1}))


@query("traces", f"""
, w AS (SELECT dataset, roi, trial, avg(v) FILTER (WHERE frame < 3) AS a, avg(v) FILTER (WHERE frame >= 4 AND frame < 8) AS b FROM traces GROUP BY ALL)
SELECT dataset, roi, trial, {r('a')} AS pre, {r('b')} AS post, {r('b - a')} AS change FROM w""")
def evoked_change(t):
    return rounded(aggregate.evoked_change(t, TRACE, "v", (0, 3), (4, 8)))


@query("traces", f"SELECT dataset, roi, frame, {r('median(v)')} AS v, {r('avg(v) * sqrt(count(v))')} AS z, CASE WHEN count(DISTINCT dataset) = 1 THEN max(dataset) END AS kind, count(*) AS n_trials FROM traces GROUP BY dataset, roi, frame")
def trial_aggregated(t):
    both = t.withColumns({"z": F.col("v"), "kind": F.col("dataset")})
    return rounded(aggregate.trial_aggregated(both, [*UNIT, "frame"], ["v"], z_scores=["z"], texts=["kind"], agg=F.median))


@query("traces", f"SELECT dataset, trial, frame, {r('avg(v)')} AS v FROM traces GROUP BY ALL")
def population_average(t):
    return rounded(aggregate.along(t, ["dataset", "trial", "frame"], "v"))


@query("stats", f"SELECT dataset, {r('sum(price * q) / sum(q)', 4)} AS price FROM stats GROUP BY dataset")
def weighted_average(t):
    return rounded(aggregate.weighted_average(t, ["dataset"], "price", "q"), 4)


_CROSS = """
, e AS (SELECT p, dataset, avg(q) AS m, stddev_samp(q) / sqrt(count(q)) AS s, count(DISTINCT roi) AS w FROM stats GROUP BY ALL)
SELECT p, round(sum(m * w) / sum(w), 6) + 0.0 AS mean, round(%s, 6) + 0.0 AS sem, count(*) AS n_datasets FROM e GROUP BY p"""


@query("stats", _CROSS % "sqrt(sum(w * s * s) / sum(w))")
def across_datasets_intra(t):
    return rounded(aggregate.across_datasets(t, ["p"], "q"))


@query("stats", _CROSS % "stddev_samp(m) / sqrt(count(m))")
def across_datasets_inter(t):
    return rounded(aggregate.across_datasets(t, ["p"], "q", error="inter"))


def with_kind(t: DataFrame) -> DataFrame:
    return t.withColumn("kind", stats.response_kind((F.col("v") - 50) / 20, 1, directional=True))


_KIND = "k AS (SELECT *, CASE WHEN (v - 50) / 20 > 1 THEN 'positive' WHEN (v - 50) / 20 < -1 THEN 'negative' ELSE 'weak' END AS kind FROM trials)"


@query("trials", f"""
, {_KIND}
SELECT run, {r("count(*) FILTER (WHERE kind = 'negative') / count(kind)")} AS negative, {r("count(*) FILTER (WHERE kind = 'positive') / count(kind)")} AS positive, {r("count(*) FILTER (WHERE kind = 'weak') / count(kind)")} AS weak, count(kind) AS total FROM k GROUP BY run""")
def responder_shares(t):
    return rounded(aggregate.responder_counts(with_kind(t), ["run"], "kind", KINDS, normalize=True))


@query("trials", f"""
, {_KIND}, u AS (SELECT DISTINCT run, roi, kind FROM k)
SELECT coalesce(run, 'TOTAL') AS run, count(*) FILTER (WHERE kind = 'negative') AS negative, count(*) FILTER (WHERE kind = 'positive') AS positive, count(*) FILTER (WHERE kind = 'weak') AS weak FROM u GROUP BY ROLLUP (run)""")
def responder_totals(t):
    return aggregate.responder_totals(with_kind(t), "run", "kind", KINDS)


@query("trials", f"""
, {_KIND},
f AS (SELECT roi, coalesce(count(*) FILTER (WHERE run <> 'view' AND kind = 'negative') / nullif(count(*) FILTER (WHERE run <> 'view'), 0), 0) AS negative, coalesce(count(*) FILTER (WHERE run <> 'view' AND kind = 'positive') / nullif(count(*) FILTER (WHERE run <> 'view'), 0), 0) AS positive FROM k GROUP BY roi)
SELECT roi, {r('negative')} AS negative, {r('positive')} AS positive, CASE WHEN greatest(negative, positive) < 0.3 THEN 'weak' WHEN negative > positive THEN 'negative' ELSE 'positive' END AS class FROM f""")
def unit_classes(t):
    kinds = ["negative", "positive"]
    return rounded(aggregate.classify_units(aggregate.kind_fractions(with_kind(t), ["roi"], "kind", kinds, F.col("run") != "view"), kinds, "weak", 0.3))


@query("stats", "SELECT dataset, count(DISTINCT roi) FILTER (WHERE run = 1) AS run_1, count(DISTINCT roi) FILTER (WHERE run = 2) AS run_2, count(DISTINCT roi) FILTER (WHERE run = 7) AS run_7 FROM stats GROUP BY dataset")
def unit_counts(t):
    return aggregate.unit_counts(t, "dataset", "run", [1, 2, 7], "roi")


@query("traces", f"SELECT dataset, roi, s AS start, {r('avg(v)')} AS v FROM traces, (SELECT unnest([0, 2, 3]) AS s) WHERE frame >= s AND frame < s + 4 GROUP BY ALL")
def sliding_windows(t):
    return rounded(aggregate.slide(t, UNIT, "v", [0, 2, 3], 4))


@query("flat", f"""
, w AS (SELECT dataset, roi, avg(v) OVER x AS m, count(*) OVER x AS n FROM flat WINDOW x AS (PARTITION BY dataset, roi ORDER BY frame ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING))
SELECT dataset, roi, {r('max(m)')} AS v FROM w WHERE n = 5 GROUP BY ALL""")
def smoothed_max(t):
    return rounded(aggregate.smoothed_max(t, UNIT, "v", 2))


@query("stats", "SELECT dataset, p, count(DISTINCT run) AS runs FROM stats GROUP BY ALL HAVING count(DISTINCT run) > 1")
def duplicated_conditions(t):
    return aggregate.duplicated_conditions(t, "dataset", "p", "run")


@query("stats", """
, c AS (SELECT p, row_number() OVER (ORDER BY p) - 1 AS k FROM (SELECT DISTINCT p FROM stats))
SELECT dataset, CAST(k AS INT) AS run, count(*) AS n FROM stats JOIN c USING (p) GROUP BY ALL""")
def harmonized_runs(t):
    return aggregate.harmonize_runs(t, "p").groupBy("dataset", "run").agg(F.count("*").alias("n"))


@query("trials", f"""
, f AS (SELECT run, avg(CASE WHEN v > 90 THEN 1 ELSE 0 END) * 100 AS high, avg(CASE WHEN v < 2 THEN 1 ELSE 0 END) * 100 AS low FROM trials GROUP BY run)
SELECT run, 'high' AS criterion, {r('high')} AS percent FROM f UNION ALL SELECT run, 'low', {r('low')} FROM f""")
def percent_excluded(t):
    return rounded(aggregate.percent_excluded(t.select("run", (F.col("v") > 90).alias("high"), (F.col("v") < 2).alias("low")), ["high", "low"], ["run"]))


@query("trials", f"""
, d AS (SELECT DISTINCT run, v FROM trials WHERE v IS NOT NULL),
g AS (SELECT *, CASE WHEN v - lag(v) OVER (PARTITION BY run ORDER BY v) > 0.2 THEN 1 ELSE 0 END AS new FROM d),
s AS (SELECT *, sum(new) OVER (PARTITION BY run ORDER BY v) AS g FROM g)
SELECT run, {r('min(v)')} AS low, {r('avg(v)')} AS merged, count(*) AS n FROM s GROUP BY run, s.g""")
def merged_values(t):
    return rounded(aggregate.merge_close(t, "v", 0.2, ["run"]))


@query("stats", f"""
, m AS (SELECT dataset, p, dc, avg(q) AS m FROM stats GROUP BY ALL),
t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY m DESC, p, dc) AS k FROM m) WHERE k = 1)
SELECT m.dataset, {r('m.p - t.p')} AS p, {r('m.dc - t.dc')} AS dc, {r('m.m')} AS q FROM m JOIN t USING (dataset)""")
def recentred(t):
    return rounded(aggregate.recentre(t, "dataset", "p", "dc", "q"))


@query("stats", f"""
, m AS (SELECT dataset, run, avg(q) AS m FROM stats GROUP BY ALL)
SELECT dataset, run, {r('m / max(m) OVER (PARTITION BY dataset)')} AS q FROM m""")
def relative_to_best(t):
    return rounded(aggregate.relative_to_best(t, "dataset", "run", "q"))


# alignment


@query("traces", f"SELECT dataset, roi, trial, frame, {r('v - avg(v) FILTER (WHERE frame >= 1 AND frame < 3) OVER (PARTITION BY dataset, roi, trial)')} AS v FROM traces")
def aligned(t):
    return rounded(align.align_at(t, TRACE, "v", 1, 3))


@query("flat", f"""
, g AS (SELECT dataset, max(v) - min(v) AS g FROM flat GROUP BY dataset), s AS (SELECT dataset, g + 0.2 * avg(g) OVER () AS step FROM g)
SELECT dataset, {r('coalesce(sum(step) OVER (ORDER BY dataset ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)')} AS "offset" FROM s""")
def category_offsets(t):
    return rounded(align.category_offsets(t, "dataset", "v"))


@query("flat", f"""
, g AS (SELECT dataset, roi, CAST(k * 0.75 AS DOUBLE) AS x FROM (SELECT DISTINCT dataset, roi FROM flat), (SELECT unnest(range(0, 85)) AS k)),
b AS (SELECT g.dataset, g.roi, g.x, a.frame AS i, a.v AS y0, c.v AS y1 FROM g JOIN flat a ON a.dataset = g.dataset AND a.roi = g.roi AND a.frame = floor(g.x) LEFT JOIN flat c ON c.dataset = g.dataset AND c.roi = g.roi AND c.frame = floor(g.x) + 1)
SELECT dataset, roi, {r('x')} AS x, {r('CASE WHEN x = i THEN y0 ELSE y0 + (y1 - y0) * (x - i) END')} AS v FROM b""")
def resampled(t):
    return rounded(align.resample(t.withColumn("x", F.col("frame").cast("double")), UNIT, "x", "v", 0.75))


@query("flat", f"SELECT dataset, roi, frame, {r('v')} AS v, {r('lag(v, 3) OVER (PARTITION BY dataset, roi ORDER BY frame)')} AS shifted FROM flat")
def shifted(t):
    return rounded(t.withColumn("shifted", align.shift("v", 3, UNIT, "frame")))


@query("embeddings", f"""
WITH e AS (SELECT vec_id AS roi, CAST(embedding AS DOUBLE[]) AS a FROM embeddings), p AS (SELECT roi, a, unnest(range(0, 64)) AS i FROM e),
q AS (SELECT *, i / 1.5 AS x, CAST(floor(i / 1.5) AS INT) AS k FROM p)
SELECT roi, CAST(i AS INT) AS frame, {r('CASE WHEN x = k THEN a[k + 1] ELSE a[k + 1] + (a[k + 2] - a[k + 1]) * (x - k) END')} AS value FROM q""")
def stretched(t):
    e = t.select(F.col("vec_id").alias("roi"), align.stretch(F.col("embedding").cast("array<double>"), 1.5).alias("v"))
    return rounded(reshape.long_rows(e, ["roi"], "v"))


@query("trials", f"""
, m AS (SELECT roi, run, avg(v) AS v FROM trials GROUP BY ALL)
SELECT a.run AS a, b.run AS b, {r('avg(a.v - b.v)')} AS metric FROM m a JOIN m b ON a.roi = b.roi AND a.run <> b.run GROUP BY ALL""")
def pairwise_differences(t):
    return rounded(align.pairwise(aggregate.along(t, ["roi", "run"], "v"), ["roi"], "run", "v", lambda x, y: F.avg(x - y)))


@query("trials", f"""
SELECT run, w AS wanted, {r('v')} AS v FROM (SELECT run, w, v, row_number() OVER (PARTITION BY run, w ORDER BY abs(v - w), v) AS k FROM trials, (SELECT unnest([10.0::DOUBLE, 55.5::DOUBLE]) AS w) WHERE v IS NOT NULL) WHERE k = 1""")
def nearest_values(t):
    return rounded(align.nearest(t, [10.0, 55.5], ["run"], "v"))


# shape


@query("traces", f"SELECT dataset, roi, trial, frame, {r('(frame - 3) / 3.56')} AS t, trial * 8 + frame AS at FROM traces")
def time_and_index(t):
    return rounded(t.select(*TRACE, "frame", reshape.time_of(F.col("frame"), 3, 3.56).alias("t"), reshape.experiment_index(F.col("frame"), F.col("trial"), 8).alias("at")))


@query("stats", f"""
, m AS (SELECT dataset, roi, run, avg(q) AS q FROM stats GROUP BY ALL)
SELECT dataset, roi, run, {r('q')} AS q FROM (SELECT DISTINCT dataset, roi FROM m) JOIN (SELECT DISTINCT dataset, run FROM m) USING (dataset) LEFT JOIN m USING (dataset, roi, run)""")
def densified(t):
    return rounded(reshape.densify(aggregate.along(t, ["dataset", "roi", "run"], "q"), ["dataset", "roi", "run"], ["dataset"], ["q"]))


@query("traces", "SELECT count(DISTINCT dataset) AS dataset, count(DISTINCT roi) AS roi, count(DISTINCT trial) AS trial, count(DISTINCT frame) AS frame FROM traces")
def key_cardinalities(t):
    return reshape.describe_keys(t, [*TRACE, "frame"])


@query("traces", "SELECT count(DISTINCT roi) * count(DISTINCT trial) * count(DISTINCT frame) = count(*) AS rectilinear FROM traces")
def rectilinear(t):
    return reshape.is_rectilinear(t, ["roi", "trial", "frame"])


@query("stats", "SELECT dataset, roi, run, count(*) AS n FROM stats GROUP BY ALL HAVING count(*) > 1")
def repeated_keys(t):
    return reshape.repeated_keys(t, ["dataset", "roi", "run"])


@query("flat", f"""
, s AS (SELECT dataset, roi, CAST(floor(frame * 0.01 * 12.5) AS INT) AS pulse, frame * 0.01 AS t, v FROM flat WHERE frame * 0.01 < 0.4)
SELECT dataset, roi, pulse, {r('t - pulse / 12.5')} AS since, {r('v - max(v) OVER (PARTITION BY dataset, roi, pulse)')} AS v FROM s""")
def pulses(t):
    timed = t.select(*UNIT, (F.col("frame") * 0.01).alias("t"), "v")
    return rounded(reshape.split_pulses(timed, UNIT, "v", "t", 0.4, 12.5).drop("t"))


@query("stats", f"SELECT dataset, run, {r('avg(q)')} AS mean FROM stats GROUP BY CUBE (dataset, run)")
def stat_table(t):
    return rounded(reshape.stat_table(t, "dataset", "run", "q"))


# signals


_MIRROR = "m AS (SELECT dataset, roi, frame, v FROM flat UNION ALL SELECT dataset, roi, -1 - frame, v FROM flat WHERE frame < {h} UNION ALL SELECT dataset, roi, 127 - frame, v FROM flat WHERE frame >= 64 - {h})"


def _rolling_sql(h: int, expression: str) -> str:
    return f", {_MIRROR.format(h=h)}, w AS (SELECT dataset, roi, frame, {expression} OVER (PARTITION BY dataset, roi ORDER BY frame ROWS BETWEEN {h} PRECEDING AND {h} FOLLOWING) AS v FROM m)\nSELECT dataset, roi, frame, {r('v')} AS v FROM w WHERE frame BETWEEN 0 AND 63"


@query("flat", _rolling_sql(2, "avg(v)"))
def moving_average(t):
    return rounded(signals.rolling(t, UNIT, "v", 5, F.avg, 64))


@query("flat", _rolling_sql(4, "quantile_cont(v, 0.1)"))
def rolling_quantile(t):
    return rounded(signals.rolling_quantile(t, UNIT, "v", 9, 0.1, 64))


@query("flat", f"""
, {_MIRROR.format(h=3)}, w AS (SELECT dataset, roi, frame, min(v) OVER (PARTITION BY dataset, roi ORDER BY frame ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS v FROM m), f AS (SELECT * FROM w WHERE frame BETWEEN 0 AND 63),
m2 AS (SELECT * FROM f UNION ALL SELECT dataset, roi, -1 - frame, v FROM f WHERE frame < 3 UNION ALL SELECT dataset, roi, 127 - frame, v FROM f WHERE frame >= 61),
x AS (SELECT dataset, roi, frame, max(v) OVER (PARTITION BY dataset, roi ORDER BY frame ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS v FROM m2)
SELECT dataset, roi, frame, {r('v')} AS v FROM x WHERE frame BETWEEN 0 AND 63""")
def maximin_baseline(t):
    return rounded(signals.maximin(t, UNIT, "v", 7, 64))


@query("flat", f"SELECT dataset, roi, frame, {r('(v - avg(v) OVER w) / stddev_samp(v) OVER w')} AS z FROM flat WINDOW w AS (PARTITION BY dataset, roi)")
def z_scores(t):
    return rounded(t.select(*UNIT, "frame", signals.z_score("v", UNIT).alias("z")))


@query("flat", f"""
, d AS (SELECT *, sqrt(v * v + v * v) * 0.5 AS d FROM flat), s AS (SELECT *, CASE WHEN frame NOT IN (5, 6) THEN abs(d - lag(d) OVER (PARTITION BY dataset, roi ORDER BY frame)) END AS s FROM d)
SELECT dataset, roi, frame, {r('3.56 * last_value(s IGNORE NULLS) OVER (PARTITION BY dataset, roi ORDER BY frame)')} AS velocity FROM s""")
def displacement_velocity(t):
    two = t.withColumn("w", F.col("v"))
    return rounded(signals.velocity(two, UNIT, "v", "w", 3.56, 0.5, substituted=F.col("frame").isin(5, 6)).select(*UNIT, "frame", "velocity"))


@query("traces", f"""
, c AS (SELECT x.dataset, x.roi, x.trial, CAST(x.frame - y.frame AS INT) AS lag, sum(x.v * y.v) / 8 AS corr FROM traces x JOIN traces y ON x.dataset = y.dataset AND x.roi = y.roi AND x.trial = y.trial - 1 AND abs(y.frame - x.frame) <= 3 GROUP BY ALL)
SELECT dataset, roi, trial, lag, {r('corr')} AS corr FROM (SELECT *, row_number() OVER (PARTITION BY dataset, roi, trial ORDER BY corr DESC, lag) AS k FROM c) WHERE k = 1""")
def best_lag(t):
    """The lag between each trial and the next."""
    return rounded(signals.best_lag(signals.cross_correlation(t, t.withColumn("trial", F.col("trial") - 1), TRACE, "v", 3), TRACE))


@query("traces", f"SELECT dataset, roi, trial, CAST((frame + 3) % 8 AS INT) AS frame, {r('v')} AS v FROM traces")
def cyclic_shift(t):
    return rounded(signals.cyclic_shift(t, TRACE, 3, 8))


@query("traces", f"""
, a AS (SELECT *, row_number() OVER (PARTITION BY dataset, roi, trial ORDER BY v, frame) AS k FROM traces)
SELECT x.dataset, x.roi, x.trial, x.frame, {r('y.v')} AS v FROM a x JOIN a y ON x.dataset = y.dataset AND x.roi = y.roi AND x.k = y.k AND y.trial = 7 - x.trial""")
def ranks_aligned(t):
    return rounded(signals.align_ranks(t, t.withColumn("trial", 7 - F.col("trial")), TRACE, "v"))


@query("traces", f"SELECT a.dataset, a.roi, a.trial, a.frame, {r('b.v')} AS v FROM traces a JOIN traces b ON a.dataset = b.dataset AND a.roi = b.roi AND a.trial = b.trial AND b.frame = CASE a.frame WHEN 1 THEN 0 WHEN 2 THEN 1 ELSE a.frame END")
def substituted(t):
    return rounded(signals.substitute(t, TRACE, "v", {1: 0, 2: 1}))


@query("flat", f"""
, n AS (SELECT *, lag(v) OVER w AS a, lead(v) OVER w AS b FROM flat WINDOW w AS (PARTITION BY dataset, roi ORDER BY frame))
SELECT dataset, roi, frame, {r('v')} AS v FROM (SELECT *, row_number() OVER (PARTITION BY dataset, roi ORDER BY v DESC, frame) AS k FROM n WHERE v > a AND v > b) WHERE k = 1""")
def highest_peaks(t):
    return rounded(signals.peaks(t, UNIT, "v"))


@query("traces", f"""
, l AS (SELECT roi, frame, median(v) AS level FROM traces GROUP BY ALL), m AS (SELECT roi, avg(level) AS mean FROM l GROUP BY roi)
SELECT t.dataset, t.roi, trial, t.frame, {r('v - (level - mean)')} AS v FROM traces t JOIN l USING (roi, frame) JOIN m USING (roi)""")
def median_corrected(t):
    return rounded(signals.centre_frames(t, "roi", "frame", "v", F.median))


@query("embeddings", f"""
WITH RECURSIVE flat AS (SELECT label AS dataset, vec_id AS roi, CAST(i - 1 AS INT) AS frame, CAST(embedding[i] AS DOUBLE) AS v FROM (SELECT *, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)),
x AS (SELECT dataset, roi, frame, v FROM flat WHERE frame = 0
  UNION ALL SELECT f.dataset, f.roi, f.frame, 0.5 * x.v + 0.5 * f.v + (f.v - x.v) / (f.frame + 1) FROM x JOIN flat f ON f.dataset = x.dataset AND f.roi = x.roi AND f.frame = x.frame + 1)
SELECT dataset, roi, frame, {r('v')} AS v FROM x""")
def denoised(t):
    e = t.select(F.col("label").alias("dataset"), F.col("vec_id").alias("roi"), F.posexplode(F.col("embedding").cast("array<double>")).alias("frame", "v"))
    return rounded(signals.denoise(e, UNIT, "v", 0.5))


@query("flat", f"""
, d AS (SELECT dataset, roi, v, row_number() OVER (PARTITION BY dataset, roi ORDER BY md5(concat_ws('|', 7, dataset, roi, frame)), frame) AS k FROM flat), p AS (SELECT dataset, roi, frame, row_number() OVER (PARTITION BY dataset, roi ORDER BY frame) AS k FROM flat)
SELECT dataset, roi, frame, {r('v')} AS v FROM p JOIN d USING (dataset, roi, k)""")
def shuffled(t):
    return rounded(signals.seeded_shuffle(t, UNIT, "v", 7))


@query("traces", f"""
, a AS (SELECT dataset, roi, trial, list(v ORDER BY frame) AS p FROM traces GROUP BY ALL), b AS (SELECT *, lag(p) OVER w AS q, lag(p, 2) OVER w AS s FROM a WINDOW w AS (PARTITION BY dataset, roi ORDER BY trial)),
d AS (SELECT dataset, roi, trial, list_transform(list_zip(p, q), lambda z: z[1] - z[2]) AS x, list_transform(list_zip(q, s), lambda z: z[1] - z[2]) AS y FROM b WHERE s IS NOT NULL)
SELECT dataset, roi, trial, {r('acos(least(greatest(list_dot_product(x, y) / sqrt(list_dot_product(x, x) * list_dot_product(y, y)), -1), 1))')} AS angle FROM d""")
def trajectory_angles(t):
    points = reshape.matrix_rows(t.withColumn("k", F.struct("dataset", "roi", "trial")), "k", "frame", "v").select("k.*", "v")
    return rounded(signals.trajectory_angles(points, UNIT, "v", frame="trial"))


# statistics


@query("stats", f"""
, s AS (SELECT dataset, regr_slope(price, q) AS slope, regr_intercept(price, q) AS intercept, corr(q, price) AS c, count(*) AS n FROM stats GROUP BY dataset)
SELECT dataset, {r('slope', 3)} AS slope, {r('intercept', 3)} AS intercept, {r('c * c')} AS r2, {r('c * sqrt((n - 2) / (1 - c * c))', 3)} AS t, n FROM s""")
def regression(t):
    out = stats.linear_regression(t, ["dataset"], "q", "price")
    return out.select("dataset", *[(F.round(c, 3) + F.lit(0.0)).alias(c) for c in ("slope", "intercept")], (F.round("r2", 6) + F.lit(0.0)).alias("r2"), (F.round("t", 3) + F.lit(0.0)).alias("t"), "n")


@query("stats", f"""
, s AS (SELECT dataset, sum(q * price) AS xy, sum(q * q) AS xx, sum(price * price) AS yy, count(*) AS n FROM stats GROUP BY dataset)
SELECT dataset, {r('xy / xx', 3)} AS slope, {r('1 - (yy - xy / xx * xy) / yy')} AS r2, n FROM s""")
def regression_through_origin(t):
    out = stats.linear_regression(t, ["dataset"], "q", "price", intercept=False)
    return out.select("dataset", (F.round("slope", 3) + F.lit(0.0)).alias("slope"), (F.round("r2", 6) + F.lit(0.0)).alias("r2"), "n")


@query("stats", f"""
, a AS (SELECT roi, p, avg(q) AS q FROM stats GROUP BY ALL), c AS (SELECT roi, corr(p, q) AS r, count(*) AS n FROM a GROUP BY roi)
SELECT roi, {r('r')} AS r, {r('r * sqrt((n - 2) / (1 - r * r))')} AS t, n FROM c""")
def correlation_with_parameter(t):
    c = aggregate.along(t, ["roi", "p"], "q").groupBy("roi").agg(F.corr("p", "q").alias("r"), F.count("*").alias("n"))
    return rounded(c.select("roi", "r", stats.r_to_t(F.col("r"), F.col("n")).alias("t"), "n"))


@query("traces", f"""
, s AS (SELECT dataset, roi, avg(v) FILTER (WHERE frame < 4) AS m1, var_samp(v) FILTER (WHERE frame < 4) / count(v) FILTER (WHERE frame < 4) AS a, avg(v) FILTER (WHERE frame >= 4) AS m2, var_samp(v) FILTER (WHERE frame >= 4) / count(v) FILTER (WHERE frame >= 4) AS b FROM traces GROUP BY ALL)
SELECT dataset, roi, {r('(m2 - m1) / sqrt(a + b)')} AS t, {r('(a + b) * (a + b) / (a * a / 31 + b * b / 31)')} AS dof FROM s""")
def pre_post_welch(t):
    return rounded(stats.welch(t, UNIT, "v", F.col("frame") >= 4))


@query("traces")
def pre_post_p_values(t):
    w = stats.welch(t, UNIT, "v", F.col("frame") >= 4)
    return rounded(w.withColumn("p", stats.t_p_value("t", "dof")))


@query("stats", f"""
, g AS (SELECT dataset, run, count(q) AS n, avg(q) AS m, var_pop(q) AS v FROM stats GROUP BY ALL), h AS (SELECT *, sum(n * m) OVER w / sum(n) OVER w AS g FROM g WINDOW w AS (PARTITION BY dataset)),
s AS (SELECT dataset, sum(n * (m - g) * (m - g)) AS sb, sum(n * v) AS sw, count(*) - 1 AS db, CAST(sum(n) - count(*) AS BIGINT) AS dw FROM h GROUP BY dataset)
SELECT dataset, {r('sb', 3)} AS ss_between, {r('sw', 3)} AS ss_within, db AS df_between, dw AS df_within, {r('sb / db / (sw / dw)')} AS f, {r('sb / (sb + sw)')} AS eta2, {r('(sb - db * sw / dw) / (sb + db * sw / dw + sw / dw)')} AS omega2 FROM s""")
def anova(t):
    out = rounded(stats.anova(t, ["dataset"], "run", "q"))
    return out.withColumns({c: F.round(c, 3) + F.lit(0.0) for c in ("ss_between", "ss_within")})


@query("traces", f"SELECT a.dataset, a.roi AS a, b.roi AS b, {r('corr(a.v, b.v)')} AS r FROM traces a JOIN traces b ON a.dataset = b.dataset AND a.trial = b.trial AND a.frame = b.frame AND a.roi < b.roi GROUP BY ALL")
def unit_correlations(t):
    return rounded(stats.correlation_pairs(t, ["dataset"], ["trial", "frame"], "roi", "v"))


@query("traces", f"SELECT a.trial AS a, b.trial AS b, {r('covar_samp(a.v, b.v)')} AS r, a.dataset FROM traces a JOIN traces b ON a.dataset = b.dataset AND a.roi = b.roi AND a.frame = b.frame AND a.trial < b.trial GROUP BY ALL")
def trial_covariances(t):
    return rounded(stats.correlation_pairs(t, ["dataset"], ["roi", "frame"], "trial", "v", covariance=True))


@query("trials", """
, e AS (SELECT run, quantile_cont(v, 0.25) AS a, quantile_cont(v, 0.5) AS b, quantile_cont(v, 0.75) AS c FROM trials GROUP BY run)
SELECT run, CAST(v > a AS INT) + CAST(v > b AS INT) + CAST(v > c AS INT) AS bin, count(*) AS n FROM trials JOIN e USING (run) GROUP BY ALL""")
def quantile_bins(t):
    return stats.quantile_bins(t, "v", 4, ["run"]).groupBy("run", "bin").agg(F.count("*").alias("n"))


@query("stats", """
, b AS (SELECT dataset, q, min(q) OVER w AS a, max(q) OVER w AS z FROM stats WINDOW w AS (PARTITION BY dataset))
SELECT dataset, CAST(least(floor((q - a) / ((z - a) / 10)), 9) AS INT) AS bin, count(*) AS n FROM b GROUP BY ALL""")
def histogram(t):
    return stats.histogram(t, "q", 10, ["dataset"])


@query("trials", f"""
, s AS (SELECT run, avg(cos(phase)) AS c, avg(sin(phase)) AS s, count(phase) AS n FROM trials GROUP BY run)
SELECT run, {r('atan2(s, c)')} AS mean, {r('sqrt(c * c + s * s)')} AS r, {r('exp(sqrt(1 + 4 * n + 4 * (n * n - n * n * (c * c + s * s))) - (1 + 2 * n))')} AS p FROM s""")
def circular(t):
    return rounded(stats.circular(t, ["run"], "phase"))


@query("trials", f"""
, s AS (SELECT run, corr(sin(phase), v) AS a, corr(cos(phase), v) AS b, corr(sin(phase), cos(phase)) AS c, count(*) AS n FROM trials WHERE v IS NOT NULL GROUP BY run),
q AS (SELECT *, sqrt((a * a + b * b - 2 * a * b * c) / (1 - c * c)) AS rho FROM s)
SELECT run, {r('rho')} AS rho, {r('exp(-n * rho * rho / 2)')} AS p FROM q""")
def circular_linear(t):
    return rounded(stats.circular_linear(t, ["run"], "phase", "v"))


@query("trials", f"""
, m AS (SELECT run, atan2(avg(sin(phase)), avg(cos(phase))) AS a, atan2(avg(sin(v)), avg(cos(v))) AS b FROM trials WHERE v IS NOT NULL GROUP BY run)
SELECT t.run, {r('sum(sin(phase - a) * sin(v - b)) / sqrt(sum(sin(phase - a) * sin(phase - a)) * sum(sin(v - b) * sin(v - b)))')} AS rho FROM trials t JOIN m USING (run) WHERE v IS NOT NULL GROUP BY t.run""")
def circular_circular(t):
    return rounded(stats.circular_circular(t, ["run"], "phase", "v"))


@query("flat", f"SELECT dataset, roi, frame, {r('(v - min(v) OVER w) / (max(v) OVER w - min(v) OVER w)')} AS a, {r('v / max(abs(v)) OVER w')} AS b, {r('(v - avg(v) OVER w) / stddev_pop(v) OVER w')} AS c FROM flat WINDOW w AS (PARTITION BY dataset, roi)")
def rescaled(t):
    return rounded(t.select(*UNIT, "frame", *[stats.rescale("v", UNIT, m).alias(n) for m, n in (("minmax", "a"), ("maxabs", "b"), ("zscore", "c"))]))


@query("stats", f"SELECT dataset, {r('1 - sum((price - 1500 * q) * (price - 1500 * q)) / (var_pop(price) * count(price))')} AS r2, {r('avg(abs((1500 * q - price) / price))')} AS relative_error, {r('exp(avg(abs(ln(1500 * q / price)))) - 1')} AS symmetric_accuracy FROM stats GROUP BY dataset")
def fit_quality(t):
    return rounded(stats.fit_quality(t.withColumn("fit", 1500 * F.col("q")), ["dataset"], "price", "fit"))


@query("trials", f"""
, k AS (SELECT run, event_id % 2 = 1 AS second, rank() OVER (PARTITION BY run ORDER BY v) + (count(*) OVER (PARTITION BY run, v) - 1) / 2 AS k FROM trials WHERE v IS NOT NULL),
s AS (SELECT run, sum(k) FILTER (WHERE second) AS w, count(*) FILTER (WHERE NOT second) AS n1, count(*) FILTER (WHERE second) AS n2 FROM k GROUP BY run)
SELECT run, {r('w - n2 * (n2 + 1) / 2')} AS u, n1, n2 FROM s""")
def rank_sums(t):
    return rounded(stats.rank_sum(t, ["run"], "v", F.col("event_id") % 2 == 1))


@query("trials", f"""
, d AS (SELECT roi, avg(v) FILTER (WHERE run = 'view') - avg(v) FILTER (WHERE run = 'click') AS d FROM trials GROUP BY roi)
SELECT {r('avg(d) / (stddev_samp(d) / sqrt(count(d)))')} AS t, count(d) AS n FROM d WHERE d IS NOT NULL""")
def paired_comparison(t):
    return rounded(stats.paired_t(t, [], "roi", "run", ("click", "view"), "v"))


@query("traces", f"""
, x AS (SELECT dataset, roi, v + 5 AS s, abs(v) + 1 AS b FROM traces), a AS (SELECT unnest(range(0, 100)) / 99.0::DOUBLE AS alpha),
c AS (SELECT dataset, roi, alpha, s - alpha * b AS c FROM x, a), m AS (SELECT dataset, roi, alpha, avg(c) AS m, min(c) AS low FROM c GROUP BY ALL),
k AS (SELECT c.dataset, c.roi, c.alpha, avg(pow(c - m, 3)) / pow(avg(pow(c - m, 2)), 1.5) AS skew, min(low) AS low FROM c JOIN m ON c.dataset = m.dataset AND c.roi = m.roi AND c.alpha = m.alpha GROUP BY ALL)
SELECT dataset, roi, {r('arg_max(alpha, CASE WHEN low < 0 THEN -1e10 ELSE skew END)')} AS alpha, {r('max(CASE WHEN low < 0 THEN -1e10 ELSE skew END)', 5)} AS skew FROM k GROUP BY ALL""")
def neuropil_coefficients(t):
    best = stats.best_coefficient(t.withColumns({"f": F.col("v") + 5, "n": F.abs("v") + 1}), UNIT, "f", "n", [k / 99 for k in range(100)])
    return rounded(best.select(*UNIT, "alpha", F.round("skew", 5).alias("skew")))


# scalars


@query("stats", f"""
, d AS (SELECT DISTINCT p * 10 AS p, dc * 100 AS dc FROM stats)
SELECT {r('p')} AS p, {r('dc')} AS dc, {r('p * 1e6 * p * 1e6 / (2 * 1046.0 * 1546.3) * 1e-4')} AS isppa, {r('p * 1e6 * p * 1e6 / (2 * 1046.0 * 1546.3) * 1e-4 * dc / 100')} AS ispta,
  {r('p / sqrt(2.1)')} AS mi, {r('pow(10, dc / 20)')} AS amplitude, {r('1 / (1 + exp(-(p - 0.5) / 0.1))')} AS sigmoid, {r('0.1 + 2 * exp(-(p - 0.4) * (p - 0.4) / (2 * 0.3 * 0.3))')} AS gauss,
  {r('CASE WHEN p < 0.2 THEN 0 ELSE 1 - exp(-(p - 0.2) / 0.3) END')} AS saturation, {r('greatest(p - 0.3, 0)')} AS line FROM d""")
def dose_metrics(t):
    p, dc = F.col("p"), F.col("dc")
    d = t.select((p * 10).alias("p"), (dc * 100).alias("dc")).distinct()
    return rounded(d.select(
        "p", "dc", dose.pulse_average_intensity(p).alias("isppa"), dose.time_average_intensity(p, dc).alias("ispta"), dose.mechanical_index(F.lit(2.1), p).alias("mi"),
        dose.decibel_amplitude(dc).alias("amplitude"), dose.sigmoid(p, 0.5, 0.1).alias("sigmoid"), dose.gaussian(p, 0.1, 2, 0.4, 0.3).alias("gauss"),
        dose.saturation(p, 0.2, 0.3).alias("saturation"), dose.threshold_linear(p, 0.3).alias("line"),
    ))


@query("stats", "SELECT DISTINCT p, dc, printf('%1.2fMPa_%02.0f%%DC', p, dc * 100) AS code, md5(printf('%1.2f', p)) AS id FROM stats")
def parameter_codes(t):
    return t.select("p", "dc", parse.parameter_code(F.col("p"), F.col("dc") * 100).alias("code"), parse.unique_id(F.format_string("%1.2f", "p")).alias("id")).distinct()


@query("documents", r"SELECT doc_id, TRY_CAST(regexp_extract(source, '^src(\d+)$', 1) AS INT) AS number, CASE CAST(regexp_extract(source, '^src(\d+)$', 1) AS INT) % 10 WHEN 1 THEN 'st' WHEN 2 THEN 'nd' WHEN 3 THEN 'rd' ELSE 'th' END AS suffix FROM documents WHERE source IS NOT NULL")
def source_numbers(t):
    n = F.regexp_extract("source", r"^src(\d+)$", 1).try_cast("int")
    return t.select("doc_id", n.alias("number"), parse.ordinal_suffix(n).alias("suffix"))


# image stacks: a stack per label, a frame per vector, a pixel per element


def pixels(t: DataFrame) -> DataFrame:
    return t.select(F.col("dataset").alias("stack"), F.col("roi").alias("frame"), F.col("frame").alias("pixel"), (F.col("v") * 100 + 500).alias("v"))


_PIXELS = "px AS (SELECT dataset AS stack, roi AS frame, frame AS pixel, v * 100 + 500 AS v FROM flat), ref AS (SELECT stack, pixel, median(v) AS ref FROM px GROUP BY ALL)"


@query("flat", f", {_PIXELS}\nSELECT stack, pixel, {r('ref')} AS ref FROM ref")
def reference_frame(t):
    return rounded(frames.projection(pixels(t)))


@query("flat", f", {_PIXELS}, e AS (SELECT stack, quantile_cont(ref, 0.1) AS a, quantile_cont(ref, 0.9) AS b FROM ref GROUP BY stack)\nSELECT stack, pixel, {r('ref')} AS ref FROM ref JOIN e USING (stack) WHERE ref BETWEEN a AND b")
def pixel_mask(t):
    return rounded(frames.quantile_mask(frames.projection(pixels(t)), 0.1, 0.9))


@query("flat", f", {_PIXELS}\nSELECT stack, frame, {r('regr_slope(v, ref)')} AS slope, {r('regr_intercept(v, ref)', 3)} AS intercept FROM px JOIN ref USING (stack, pixel) GROUP BY ALL")
def frame_regression(t):
    out = frames.frame_regression(pixels(t), frames.projection(pixels(t)))
    return out.select("stack", "frame", (F.round("slope", 6) + F.lit(0.0)).alias("slope"), (F.round("intercept", 3) + F.lit(0.0)).alias("intercept"))


@query("flat", f""", {_PIXELS}, p AS (SELECT stack, frame, stddev_pop(v) / stddev_pop(ref) AS slope, avg(v) - avg(ref) AS intercept FROM px JOIN ref USING (stack, pixel) GROUP BY ALL),
c AS (SELECT stack, frame, pixel, (v - intercept) / slope AS v FROM px JOIN p USING (stack, frame)), l AS (SELECT stack, least(min(v), 0) AS low FROM c GROUP BY stack)
SELECT stack, frame, pixel, {r('v - low', 4)} AS v FROM c JOIN l USING (stack)""")
def frames_corrected(t):
    px = pixels(t)
    return rounded(frames.correct_frames(px, frames.frame_regression(px, frames.projection(px), kind="moments")), 4)


@query("flat", f""", {_PIXELS}, e AS (SELECT stack, CASE WHEN min(v) < 500 THEN 500 - min(v) ELSE 0 END AS up, max(v) AS top FROM px GROUP BY stack)
SELECT stack, frame, pixel, {r('(v + up) * CASE WHEN top + up > 520 THEN 0.5 * 520 / (top + up) ELSE 1 END')} AS v FROM px JOIN e USING (stack)""")
def range_fitted(t):
    return rounded(frames.fit_range(pixels(t), 500.0, 520.0))


@query("embeddings", f"""
WITH e AS (SELECT vec_id AS roi, CAST(embedding AS DOUBLE[]) AS a FROM embeddings), p AS (SELECT roi, a, i, least(i * (63.0::DOUBLE / 10), 63) AS x FROM (SELECT *, unnest(range(0, 11)) AS i FROM e)),
q AS (SELECT *, CAST(floor(x) AS INT) AS k FROM p)
SELECT roi, CAST(i AS INT) AS frame, {r('a[k + 1] + (coalesce(a[k + 2], a[k + 1]) - a[k + 1]) * (x - k)')} AS value FROM q""")
def frames_resampled(t):
    e = t.select(F.col("vec_id").alias("roi"), frames.resampled_values(F.col("embedding").cast("array<double>"), 64, 5 / 30).alias("v"))
    return rounded(reshape.long_rows(e, ["roi"], "v"))


# per-trace kernels: no SQL form, known answers in the tests


@query("flat", f"""
, c AS (SELECT dataset, roi, frame, v - avg(v) OVER (PARTITION BY dataset, roi) AS v FROM flat), k AS (SELECT unnest(range(0, 33)) AS k),
s AS (SELECT dataset, roi, k, sum(v * cos(2 * pi() * k * frame / 64)) AS a, sum(v * sin(2 * pi() * k * frame / 64)) AS b FROM c, k GROUP BY ALL)
SELECT dataset, roi, {r('k * 3.56 / 64')} AS freq, {r('(a * a + b * b) / (3.56 * 64) * CASE WHEN k BETWEEN 1 AND 31 THEN 2 ELSE 1 END')} AS power FROM s""")
def power_spectra(t):
    return rounded(kernels.power_spectrum(t, UNIT, "v", 3.56))


_SEGMENTS = "g AS (SELECT dataset, roi, s, frame - s * 8 AS i, v FROM flat, (SELECT unnest(range(0, 7)) AS s) WHERE frame >= s * 8 AND frame < s * 8 + 16), h AS (SELECT *, v - avg(v) OVER (PARTITION BY dataset, roi, s) AS y FROM g), k AS (SELECT unnest(range(0, 9)) AS k)"


@query("flat", f"""
, {_SEGMENTS}, w AS (SELECT *, y * 0.5 * (1 - cos(2 * pi() * i / 16)) AS z FROM h),
d AS (SELECT dataset, roi, s, k, sum(z * cos(2 * pi() * k * i / 16)) AS a, sum(z * sin(2 * pi() * k * i / 16)) AS b FROM w, k GROUP BY ALL)
SELECT dataset, roi, {r('k * 3.56 / 16')} AS freq, {r('avg((a * a + b * b) / (3.56 * 6) * CASE WHEN k BETWEEN 1 AND 7 THEN 2 ELSE 1 END)')} AS power FROM d GROUP BY dataset, roi, k""")
def welch_spectra(t):
    return rounded(kernels.welch_spectrum(t, UNIT, "v", 3.56, 16))


@query("flat", f"""
, k AS (SELECT CAST(unnest(range(1, 32)) AS INT) AS k), s AS (SELECT dataset, roi, k, sum(v * cos(2 * pi() * k * frame / 64)) AS a, sum(v * sin(2 * pi() * k * frame / 64)) AS b FROM flat, k GROUP BY ALL),
h AS (SELECT f.dataset, f.roi, frame, v, sum(a * sin(2 * pi() * k * frame / 64) - b * cos(2 * pi() * k * frame / 64)) / 32 AS h FROM flat f JOIN s USING (dataset, roi) GROUP BY ALL)
SELECT dataset, roi, frame, {r('sqrt(v * v + h * h)')} AS envelope, {r('atan2(h, v)')} AS phase FROM h""")
def hilbert_envelopes(t):
    return rounded(kernels.hilbert(t, UNIT, "v"))


@query("flat")
def amplitude_surrogates(t):
    return rounded(kernels.surrogates(t, UNIT, "v", method="amplitude"))


@query("flat")
def principal_components(t):
    """Components of the frames over units, by dataset; the covariances are grouped sums."""
    pairs = stats.correlation_pairs(t, ["dataset"], ["roi"], "frame", "v", covariance=True)
    own = t.groupBy("dataset", F.col("frame").alias("a")).agg(F.var_samp("v").alias("r")).select("dataset", "a", F.col("a").alias("b"), "r")
    return rounded(kernels.covariance_components(pairs.unionByName(own), ["dataset"], 3))


@query("stats")
def dose_curves(t):
    points = t.groupBy("dataset", "p").agg(F.avg("price").alias("price"))
    return rounded(curves.fit_curves(points, ["dataset"], "p", "price", ["linear", "power", "sigmoid"], 0.0).withColumn("parameters", F.transform("parameters", lambda v: F.round(v, 3))).drop("covariance"), 3)


# templates, forecasts and dose responses


@query("flat", f"""
, d AS (SELECT * FROM flat WHERE frame < 48), m AS (SELECT dataset, roi, avg(v) AS mean FROM d GROUP BY ALL),
e AS (SELECT d.dataset, d.roi, v - mean AS e, lag(v - mean) OVER (PARTITION BY d.dataset, d.roi ORDER BY frame) AS p FROM d JOIN m USING (dataset, roi)),
a AS (SELECT dataset, roi, sum(e * p) / sum(p * p) AS phi FROM e WHERE p IS NOT NULL GROUP BY ALL), l AS (SELECT dataset, roi, v AS last FROM flat WHERE frame = 47)
SELECT dataset, roi, frame, {r('v')} AS v, {r('mean + pow(phi, frame - 47) * (last - mean)')} AS predicted FROM flat JOIN m USING (dataset, roi) JOIN a USING (dataset, roi) JOIN l USING (dataset, roi) WHERE frame >= 48""")
def forecasts(t):
    return rounded(models.forecast(t, UNIT, "v", 48))


@query("traces", f"""
, g AS (SELECT s, w FROM (SELECT unnest(range(1, 6)) AS s), (SELECT unnest(range(1, 4)) AS w)),
x AS (SELECT dataset, roi, trial, s, w, avg(v) FILTER (WHERE frame >= s AND frame < s + w) AS m1, avg(v) FILTER (WHERE NOT (frame >= s AND frame < s + w)) AS m0,
  count(*) FILTER (WHERE frame >= s AND frame < s + w) AS n1, count(*) FILTER (WHERE NOT (frame >= s AND frame < s + w)) AS n0, sum(v * v) AS ss FROM traces, g GROUP BY ALL),
k AS (SELECT *, ss - n1 * m1 * m1 - n0 * m0 * m0 AS sse FROM x), b AS (SELECT *, row_number() OVER (PARTITION BY dataset, roi, trial ORDER BY sse, s, w) AS k FROM k)
SELECT dataset, roi, trial, CAST(s AS INT) AS start, CAST(w AS INT) AS width, {r('m1 - m0')} AS amplitude, {r('m0')} AS level, {r('sse')} AS sse FROM b WHERE k = 1""")
def pulse_fits(t):
    return rounded(models.fit_pulse(t, TRACE, "v", range(1, 6), range(1, 4)))


@query("traces", f"""
, t AS (SELECT unnest([0.0, 1.0, 3.0, 2.0, 1.0, 0.5, 0.0, 0.0]) AS y, unnest(range(0, 8)) AS k), s AS (SELECT unnest(range(-2, 3)) AS s),
c AS (SELECT dataset, roi, trial, s, corr(v, CAST(y AS DOUBLE)) AS c FROM traces, s, t WHERE k = frame - s GROUP BY ALL)
SELECT dataset, roi, trial, CAST(s AS INT) AS shift, {r('c')} AS corr FROM (SELECT *, row_number() OVER (PARTITION BY dataset, roi, trial ORDER BY c DESC, s) AS n FROM c WHERE c IS NOT NULL AND NOT isnan(c)) WHERE n = 1""")
def template_matches(t):
    return rounded(models.match_template(t, [0, 1, 3, 2, 1, 0.5, 0, 0], TRACE, "v", 2))


@query("stats", f"""

, m AS (SELECT dataset, p, avg(q) AS q FROM stats WHERE dataset IN ('AF', 'NF', 'NO', 'RF') GROUP BY ALL), g AS (SELECT dataset, x FROM (SELECT DISTINCT dataset FROM m), (SELECT unnest([0.0::DOUBLE, 0.015::DOUBLE, 0.055::DOUBLE, 0.1::DOUBLE]) AS x)),
a AS (SELECT g.dataset, x, max(p) FILTER (WHERE p <= x) AS lo, min(p) FILTER (WHERE p >= x) AS hi FROM g JOIN m USING (dataset) GROUP BY ALL),
y AS (SELECT a.x, CASE WHEN lo = hi THEN l.q ELSE l.q + (h.q - l.q) * (x - lo) / (hi - lo) END * CASE a.dataset WHEN 'AF' THEN -1 ELSE 1 END AS y FROM a JOIN m l ON l.dataset = a.dataset AND l.p = lo JOIN m h ON h.dataset = a.dataset AND h.p = hi)
SELECT x AS p, {r('sum(y)')} AS net FROM y GROUP BY x""")
def net_effect(t):
    names = ["AF", "NF", "NO", "RF"]
    grid = t.sparkSession.createDataFrame([(0.0,), (0.015,), (0.055,), (0.1,)], "p double")
    curves = models.curve_by_line(t.filter(F.col("dataset").isin(names)), "dataset", "p", "q", grid)
    return rounded(models.net_effect(curves, "p", "q", "dataset", {n: -1 if n == "AF" else 1 for n in names}))


@query("stats", f"SELECT dataset, p, {r('avg(q)')} AS mean, {r('stddev_samp(q) / sqrt(count(q))')} AS sem, count(q) AS n FROM stats GROUP BY ALL")
def dose_dependency(t):
    return rounded(models.dependency(t, ["dataset"], "p", "q"))


@query("stats", f"""
, m AS (SELECT dataset, roi, avg(q) AS x, avg(price) AS y FROM stats GROUP BY ALL)
SELECT dataset, {r('corr(x, y)')} AS r, {r('regr_slope(y, x)', 3)} AS slope, {r('regr_intercept(y, x)', 3)} AS intercept, count(*) AS n FROM m GROUP BY dataset""")
def codistribution(t):
    out = models.codistribution(t, ["roi"], ["dataset"], "q", "price")
    return out.select("dataset", (F.round("r", 6) + F.lit(0.0)).alias("r"), *[(F.round(c, 3) + F.lit(0.0)).alias(c) for c in ("slope", "intercept")], "n")


@query("stats", f"SELECT {r('(floor(p / 0.03) + 0.5) * 0.03')} AS p, {r('(floor(dc / 0.03) + 0.5) * 0.03')} AS dc, {r('avg(q)')} AS q FROM stats GROUP BY floor(p / 0.03), floor(dc / 0.03)")
def cell_average(t):
    return rounded(models.cell_average(t, "p", "dc", "q", 0.03))


@query("orders", """
SELECT o_custkey, day, CASE WHEN day = min(day) OVER (PARTITION BY o_custkey) THEN 'pre' ELSE 'post' END AS status FROM (SELECT DISTINCT o_custkey, CAST(o_orderdate AS DATE) AS day FROM orders)""")
def status_by_first_date(t):
    return models.status_by_first_date(t, "o_custkey", "o_orderdate")


@query("traces", f"""
, l AS (SELECT *, lag(v, 1) OVER w AS a, lag(v, 2) OVER w AS b FROM traces WINDOW w AS (PARTITION BY dataset, roi, trial ORDER BY frame))
SELECT dataset, roi, trial, frame, {r('CASE WHEN frame IN (0, 1, 5) AND a IS NOT NULL THEN greatest(2 * a - coalesce(b, a), 0) ELSE v END')} AS v FROM l""")
def extrapolated(t):
    return rounded(models.extrapolate(t, TRACE, "v", [0, 1, 5], order=1, fewer=True))


@query("flat", "SELECT dataset, roi, CAST(frame // 16 AS INT) AS run, count(*) AS n, CAST(max(frame % 16) AS INT) AS last FROM flat GROUP BY ALL")
def runs_split(t):
    return models.split_index(t, "frame", 16, "run", "place").groupBy(*UNIT, "run").agg(F.count("*").alias("n"), F.max("place").alias("last"))


@query("trials", f"""
, f AS (SELECT roi, arg_min(epoch_us("at"), event_id) AS t FROM trials WHERE run <> 'view' GROUP BY roi), g AS (SELECT roi, min(epoch_us("at")) AS g FROM trials WHERE run = 'view' GROUP BY roi)
SELECT roi AS sequence, {r('(t - g) / 1e6', 3)} AS delay FROM f JOIN g USING (roi)""")
def trigger_delays(t):
    timed = t.select(F.col("roi").alias("sequence"), F.col("event_id").alias("index"), "run", (F.unix_micros(F.col("at").cast("timestamp")) / 1e6).alias("time"))
    triggers = timed.filter("run = 'view'").groupBy("sequence").agg(F.min("time").alias("time"))
    return rounded(models.trigger_delay(timed.filter("run <> 'view'"), triggers), 3)


@query("stats", f"""
, d AS (SELECT unnest(range(1, 1001)) AS draw), u AS (SELECT draw, i, (('0x' || md5(concat_ws('|', 11, i, draw))[1:7])::BIGINT + 0.5) / 268435456.0::DOUBLE AS u FROM d, (SELECT unnest(range(0, 4)) AS i)),
n AS (SELECT draw, sqrt(-2 * ln(max(u) FILTER (WHERE i = 0))) * cos(2 * pi() * max(u) FILTER (WHERE i = 1)) AS a, sqrt(-2 * ln(max(u) FILTER (WHERE i = 2))) * cos(2 * pi() * max(u) FILTER (WHERE i = 3)) AS b FROM u GROUP BY draw),
y AS (SELECT p, (2.0 + 0.2 * a) * p + 1.0 + 0.1 * b AS y FROM (SELECT DISTINCT p FROM stats), n)
SELECT p, {r('quantile_cont(y, 0.025)')} AS low, {r('quantile_cont(y, 0.975)')} AS high FROM y GROUP BY p""")
def fit_bands(t):
    return rounded(models.fit_band(t, "p", 2.0, 1.0, 0.2, 0.1, 1000, 11))


# names and settings texts, written from table values and parsed back


@query("stats", """
, n AS (SELECT DISTINCT run, p, dc FROM stats)
SELECT 'line' || run AS line, 100 AS trial_length, 10.0::DOUBLE * run AS prf, 0.2::DOUBLE AS dur, 3.56::DOUBLE AS fps, round(p, 6) AS p, round(dc * 100, 6) AS dc, CAST(run AS INT) AS run_id FROM n""")
def experiment_names(t):
    n = t.select("run", "p", "dc").distinct()
    name = F.concat(F.lit("line"), "run", F.lit("_100frames_"), F.format_string("%d", F.col("run") * 10), F.lit("Hz_200ms_3.56Hz_"), F.format_string("%.2f", "p"), F.lit("MPA_"), F.format_string("%.0f", F.col("dc") * 100), F.lit("DC-"), "run")
    return rounded(n.select(parse.experiment(name).alias("e")).select("e.*"))


@query("orders", """
SELECT o_orderkey, CAST(o_orderdate AS DATE) AS date, 'mouse' || o_custkey AS mouse, 'region' || (o_custkey % 5) AS region, CASE WHEN o_custkey % 2 = 0 THEN 'layer5' ELSE 'layer2-3' END AS layer FROM orders""")
def session_names(t):
    k = F.col("o_custkey")
    name = F.concat(F.date_format("o_orderdate", "yyyyMMdd"), F.lit("_mouse"), k, F.lit("_region"), k % 5, F.when(k % 2 == 0, "_layer5").otherwise(""))
    return t.select("o_orderkey", parse.session(name).alias("s")).select("o_orderkey", "s.*")


@query("part", """
SELECT p_partkey, CAST(p_size AS DOUBLE) AS size, p_brand AS brand, p_size % 2 = 0 AS flag, CAST(p_size AS DOUBLE) AS a, CAST(-p_size AS DOUBLE) AS b, round(p_size / 2.0, 6) AS x, round(-p_size / 4.0, 6) AS y FROM part""")
def settings_texts(t):
    size = F.col("p_size")
    text = F.concat(F.lit("scan.size = "), size, F.lit(";\nscan.brand = '"), "p_brand", F.lit("';\nscan.even = "), (size % 2 == 0).cast("string"), F.lit(";\nscan.box = [1 "), size, F.lit("; 2 -"), size, F.lit("];"))
    place = F.concat(F.lit("right_"), F.format_string("%.2f", size / 2), F.lit("mm_backward_"), F.format_string("%.2f", size / 4), F.lit("mm"))
    m = t.select("p_partkey", parse.settings(text).alias("m"), parse.offset(place).alias("o"))
    v = {k: parse.typed_value(F.col("m")[f"scan.{k}"]) for k in ("size", "brand", "even", "box")}
    return rounded(m.select(
        "p_partkey", v["size"]["number"].alias("size"), v["brand"]["text"].alias("brand"), v["even"]["flag"].alias("flag"),
        v["box"]["matrix"][0][1].alias("a"), v["box"]["matrix"][1][1].alias("b"), "o.x", "o.y",
    ))


@query("part", """
WITH s AS (SELECT p_partkey, 'size' AS key, CAST(p_size AS VARCHAR) AS value FROM part UNION ALL SELECT p_partkey, 'type', p_type FROM part),
c AS (SELECT key, value, count(*) AS n FROM s GROUP BY ALL), m AS (SELECT key, value AS reference FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY n DESC, value) AS k FROM c) WHERE k = 1)
SELECT key, reference, count(*) AS outliers FROM s JOIN m USING (key) WHERE CASE WHEN key = 'size' THEN abs((TRY_CAST(value AS DOUBLE) - TRY_CAST(reference AS DOUBLE)) / TRY_CAST(reference AS DOUBLE)) > 0.5 ELSE value <> reference END GROUP BY ALL""")
def setting_outliers(t):
    s = t.select(F.col("p_partkey").cast("string").alias("run"), F.create_map(F.lit("size"), F.col("p_size").cast("string"), F.lit("type"), "p_type").alias("settings"))
    out = bundles.settings_mismatches(s, limits={"size": 0.5})
    return out.groupBy("key", "reference").agg(F.count("*").alias("outliers"))


# further summaries


@query("flat", f"SELECT dataset, roi, {r('sum(v * v)')} AS energy FROM flat GROUP BY ALL")
def evoked_energy(t):
    return rounded(signals.energy(t, UNIT, "v"))


@query("traces", f"""
, x AS (SELECT dataset, roi, trial, frame, v + 10 AS f FROM traces), b AS (SELECT *, avg(f) FILTER (WHERE frame < 3) OVER w AS f0 FROM x WINDOW w AS (PARTITION BY dataset, roi, trial)), c AS (SELECT *, (f - f0) / f0 AS d FROM b)
SELECT dataset, roi, trial, frame, {r('d')} AS f, {r('(d - avg(d) OVER w) / stddev_pop(d) OVER w')} AS z FROM c WINDOW w AS (PARTITION BY dataset, roi, trial)""")
def fluorescence_profiles(t):
    return rounded(signals.profile(t.select(*TRACE, "frame", (F.col("v") + 10).alias("f")), TRACE, "f", (0, 3)))


@query("flat", f"SELECT dataset, roi, CAST(s AS INT) AS segment, {r('avg(v)')} AS v, count(*) AS n FROM flat, (SELECT unnest(range(0, 7)) AS s) WHERE frame >= s * 8 AND frame < s * 8 + 16 GROUP BY ALL")
def overlapping_segments(t):
    return rounded(signals.segments(t, UNIT, "v", 16, 8, 64).groupBy(*UNIT, "segment").agg(F.avg("v").alias("v"), F.count("*").alias("n")))


@query("flat", f"""
, {_SEGMENTS}, d AS (SELECT dataset, roi, s, k, sum(y * cos(2 * pi() * k * i / 16)) AS a, sum(y * sin(2 * pi() * k * i / 16)) AS b FROM h, k GROUP BY ALL)
SELECT dataset, CAST(s AS INT) AS segment, {r('k * 3.56 / 16')} AS freq, {r('avg((a * a + b * b) / (3.56 * 16) * CASE WHEN k BETWEEN 1 AND 7 THEN 2 ELSE 1 END)')} AS power FROM d GROUP BY dataset, s, k""")
def spectrograms(t):
    return rounded(kernels.power_spectrum(signals.segments(t, UNIT, "v", 16, 8, 64), [*UNIT, "segment"], "v", 3.56, frame="place").groupBy("dataset", "segment", "freq").agg(F.avg("power").alias("power")))


@query("trials", f"""
, m AS (SELECT run, avg(v) AS m, stddev_pop(v) AS s FROM trials WHERE v IS NOT NULL GROUP BY run),
d AS (SELECT t.run, exp(-((v - m) / s) * ((v - m) / s) / 2) / (s * sqrt(2 * pi())) AS d FROM trials t JOIN m USING (run) WHERE v IS NOT NULL)
SELECT run, {r('var_pop(d) / (avg(d) * avg(d))')} AS coefficient FROM d GROUP BY run""")
def bimodality(t):
    return rounded(stats.bimodality(t, ["run"], "v"))


@query("stats", "SELECT DISTINCT a.run, a.dataset AS a, b.dataset AS b FROM stats a JOIN (SELECT DISTINCT run, dataset FROM stats) b ON a.run = b.run AND a.dataset < b.dataset")
def hue_pairs(t):
    return stats.hue_pairs(t, "run", "dataset")


@query("stats", "SELECT dataset, run, count(DISTINCT roi) AS datasets FROM stats GROUP BY ROLLUP (dataset, run)")
def counts_with_totals(t):
    return bundles.count_datasets(t, ["dataset", "run"], "roi")


@query("stats", f"SELECT dataset, {r('median(q / price)')} AS ratio FROM stats GROUP BY dataset")
def signal_ratios(t):
    return rounded(t.groupBy("dataset").agg(F.median(F.col("q") / F.col("price")).alias("ratio")))


@query("stats", f"""
, m AS (SELECT dataset, p, avg(q) AS m FROM stats GROUP BY ALL)
SELECT dataset, p, {r('m / max(abs(m)) OVER (PARTITION BY dataset)')} AS q FROM m""")
def relative_to_largest(t):
    means = aggregate.along(t, ["dataset", "p"], "q")
    return rounded(means.select("dataset", "p", stats.rescale("q", ["dataset"], "maxabs").alias("q")))


@query("stats", f"""
, c AS (SELECT dataset, p, avg(price) AS y FROM stats WHERE dc = 0.04 GROUP BY ALL)
SELECT s.dataset, {r('avg(abs(price - y))', 3)} AS error, count(*) AS n FROM stats s JOIN c ON s.dataset = c.dataset AND s.p = c.p WHERE dc <> 0.04 GROUP BY s.dataset""")
def sweep_prediction_errors(t):
    return rounded(models.sweep_prediction_error(t, ["dataset"], "p", "price", F.col("dc") == 0.04), 3)


@query("traces", f"""
, w AS (SELECT dataset, roi, avg(v) AS m, stddev_samp(v) / sqrt(count(v)) AS s, count(v) AS n FROM traces GROUP BY ALL)
SELECT dataset, roi, CASE WHEN abs(m / s) > 1.9983405425207 THEN CAST(sign(m) AS INT) ELSE 0 END AS effect FROM w""")
def significant_effects(t):
    """The sign of a unit's mean where its two-sided p is below 0.05; 63 degrees of freedom, so |t| is above 1.99834."""
    w = t.groupBy(*UNIT).agg(F.avg("v").alias("m"), (F.stddev_samp("v") / F.sqrt(F.count("v"))).alias("s"), (F.count("v") - 1).alias("dof"))
    p = w.withColumn("p", stats.t_p_value(F.col("m") / F.col("s"), F.col("dof")))
    return p.select(*UNIT, stats.significance(F.col("p"), 0.05, F.col("m")).alias("effect"))
