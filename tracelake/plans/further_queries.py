"""Further registered queries: fits, artefacts, templates, sessions and the loader."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelake.functions import parse
from tracelake.operators import acquisition, aggregate, align, curves, designs, fits, frames, kernels, models, reshape, scans, stats, tables
from tracelake.plans import pipelines
from tracelake.plans.queries import _KIND, _PIXELS, TRACE, UNIT, pixels, query, r, rounded, with_kind
from tracelake.sources import loader, sessions, work

# robust regression: the rounds of the fit, written out


def _robust_rounds(source: str, keys: list[str], rounds: int, median: str = "quantile_disc({}, 0.5)") -> str:
    """CTEs f0 to f<rounds>, and g with the statistics of the last fit, of rows (keys, x, y) of ``source``."""
    k, on = ", ".join(keys), f"USING ({', '.join(keys)})"
    line = "(sw * swxy - swx * swy) / (sw * swxx - swx * swx)"

    def sums(w: str) -> str:
        return f"sum({w}) AS sw, sum({w} * x) AS swx, sum({w} * y) AS swy, sum({w} * x * x) AS swxx, sum({w} * x * y) AS swxy"

    out = [f"f0 AS (SELECT {k}, {line} AS a, (swy - {line} * swx) / sw AS b, CAST(NULL AS DOUBLE) AS scale, CAST(NULL AS DOUBLE) AS moved FROM (SELECT {k}, {sums('1.0::DOUBLE')} FROM {source} GROUP BY ALL))"]
    for i in range(rounds):
        residual = "y - b - a * x"
        weight = f"(CASE WHEN scale > 0 AND abs({residual}) > 1.345::DOUBLE * scale THEN 1.345::DOUBLE * scale / abs({residual}) ELSE 1.0::DOUBLE END)"
        out.append(
            f"f{i + 1} AS (SELECT {k}, {line} AS a, (swy - {line} * swx) / sw AS b, scale, greatest(abs({line} - a0), abs((swy - {line} * swx) / sw - b0)) AS moved "
            f"FROM (SELECT {k}, {sums(weight)}, {median.format(f'abs({residual})')} / 0.6744897501960817::DOUBLE AS scale, min(a) AS a0, min(b) AS b0 FROM {source} JOIN f{i} {on} GROUP BY {k}))"
        )
    out.append(
        f"g AS (SELECT {k}, min(a) AS a, min(b) AS b, min(scale) AS scale, min(moved) AS moved, count(*) AS n, sum(u * u) * min(scale) ** 2 AS rest, var_pop(y) * count(*) AS total, avg(inside) AS m, var_pop(inside) AS mv, "
        f"sum(greatest(least(u, 1.345), -1.345) ** 2) AS psi, var_pop(x) * count(*) AS sxx FROM (SELECT *, CASE WHEN abs(u) <= 1.345 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS inside FROM (SELECT *, (y - b - a * x) / scale AS u FROM {source} JOIN f{rounds} {on})) GROUP BY {k})"
    )
    return ",\n".join(out)


#: Two-sided p of a normal statistic: one less the error function, by its series of positive terms.
_NORMAL_P = "greatest(1 - 2 / sqrt(pi()) * exp(-z * z / 2) * list_sum(list_transform(range(0, 301), lambda k: exp((2 * k + 1) * ln(z / sqrt(2)) + k * ln(2) - (k + 1) * ln(2) - lgamma(k + 1.5) + ln(sqrt(pi()))))), 0)"


@query("stats", f"""
, d AS (SELECT dataset, CAST(q AS DOUBLE) AS x, CAST(price AS DOUBLE) AS y FROM stats),
{_robust_rounds('d', ['dataset'], 15)},
e AS (SELECT *, least(abs(a) / sqrt((1 + 2 / n * mv / (m * m)) ** 2 * psi * scale * scale / ((n - 2) * m * m) / sxx), 10) AS z FROM g)
SELECT dataset, {r('a', 3)} AS slope, {r('b', 2)} AS intercept, {r('1 - rest / total')} AS r2, {r('scale', 3)} AS scale, n, moved <= 1e-3 AS converged, {r(f'CASE WHEN z >= 10 THEN 0 ELSE {_NORMAL_P} END')} AS p FROM e""")
def robust_group_fits(t):
    fit = fits.robust_fit(t, ["dataset"], "q", "price", tolerance=1e-3)
    return rounded(fit.withColumns({"slope": F.round("slope", 3), "intercept": F.round("intercept", 2), "scale": F.round("scale", 3)}))


@query("trials", f"""
, d AS (SELECT roi % 40 AS half, phase AS x, v AS y FROM trials),
{_robust_rounds('d', ['half'], 15)},
e AS (SELECT *, least(abs(a) / sqrt((1 + 2 / n * mv / (m * m)) ** 2 * psi * scale * scale / ((n - 2) * m * m) / sxx), 10) AS z FROM g)
SELECT half, {r('a')} AS slope, {r('b')} AS intercept, {r('1 - rest / total')} AS r2, {r('scale')} AS scale, n, moved <= 1e-6 AS converged, {r(f'CASE WHEN z >= 10 THEN 0 ELSE {_NORMAL_P} END')} AS p FROM e""")
def robust_weak_fits(t):
    return rounded(fits.robust_fit(t.withColumn("half", F.col("roi") % 40), ["half"], "phase", "v"))


@query("flat", f"""
, {_PIXELS}, d AS (SELECT stack, frame, ref AS x, v AS y FROM px JOIN ref USING (stack, pixel)),
{_robust_rounds('d', ['stack', 'frame'], 15)}
SELECT stack, frame, {r('a', 4)} AS slope, {r('b', 2)} AS intercept FROM f15""")
def robust_frame_regression(t):
    px = pixels(t)
    fit = frames.frame_regression(px, frames.projection(px), kind="robust")
    return rounded(fit.withColumns({"slope": F.round("slope", 4), "intercept": F.round("intercept", 2)}))


@query("flat", f"""
, d AS (SELECT dataset, roi, CAST(frame AS DOUBLE) AS x, v AS y FROM flat),
{_robust_rounds('d', ['dataset', 'roi'], 60, 'median({})')}
SELECT dataset, roi, {r('a')} AS slope, {r('b', 5)} AS intercept FROM f60""")
def robust_trends(t):
    return rounded(kernels.robust_trend(t, UNIT, "v").withColumn("intercept", F.round("intercept", 5)))


# tests of factors: two levels and a covariate have closed forms


def _covariate_tests(kind: int) -> str:
    ss = {
        1: [("kind", "total_y - within_y"), ("x", "pooled_xy * pooled_xy / pooled_xx"), ("kind:x", "own_xy - pooled_xy * pooled_xy / pooled_xx")],
        2: [("kind", "total_y - total_xy * total_xy / total_xx - (within_y - pooled_xy * pooled_xy / pooled_xx)"), ("x", "pooled_xy * pooled_xy / pooled_xx"), ("kind:x", "own_xy - pooled_xy * pooled_xy / pooled_xx")],
        3: [("intercept", "b0 * b0 / (1.0 / n0 + mx0 * mx0 / sxx0)"), ("kind", "(b1 - b0) ** 2 / (1.0 / n0 + mx0 * mx0 / sxx0 + 1.0 / n1 + mx1 * mx1 / sxx1)"), ("x", "sxy0 * sxy0 / sxx0"), ("kind:x", "own_xy - pooled_xy * pooled_xy / pooled_xx")],
    }[kind]
    rows = " UNION ALL ".join([f"SELECT dataset, '{name}' AS factor, {form} AS ss, 1 AS dof, n - 4 AS rest_dof, within_y - own_xy AS rest FROM s" for name, form in ss] + ["SELECT dataset, 'residual', within_y - own_xy, n - 4, n - 4, within_y - own_xy FROM s"])
    omega = "CASE WHEN factor <> 'residual' THEN (ss - dof * rest / rest_dof) / (ss + dof * rest / rest_dof + rest / rest_dof) END" if kind == 1 else "CAST(NULL AS DOUBLE)"
    return f"""
, d AS (SELECT dataset, run >= 3 AS kind, CAST(q AS DOUBLE) AS x, CAST(price AS DOUBLE) / 1000 AS y FROM stats),
c AS (SELECT dataset, kind, count(*) AS n, avg(x) AS mx, avg(y) AS my, regr_sxx(y, x) AS sxx, regr_sxy(y, x) AS sxy, regr_syy(y, x) AS syy FROM d GROUP BY ALL),
w AS (SELECT dataset, sum(n) AS n, sum(syy) AS within_y, sum(sxy) AS pooled_xy, sum(sxx) AS pooled_xx, sum(sxy * sxy / sxx) AS own_xy,
  max(n) FILTER (WHERE NOT kind) AS n0, max(mx) FILTER (WHERE NOT kind) AS mx0, max(sxx) FILTER (WHERE NOT kind) AS sxx0, max(sxy) FILTER (WHERE NOT kind) AS sxy0, max(my - sxy / sxx * mx) FILTER (WHERE NOT kind) AS b0,
  max(n) FILTER (WHERE kind) AS n1, max(mx) FILTER (WHERE kind) AS mx1, max(sxx) FILTER (WHERE kind) AS sxx1, max(my - sxy / sxx * mx) FILTER (WHERE kind) AS b1 FROM c GROUP BY dataset),
t AS (SELECT dataset, regr_sxx(y, x) AS total_xx, regr_sxy(y, x) AS total_xy, regr_syy(y, x) AS total_y FROM d GROUP BY dataset),
s AS (SELECT * FROM w JOIN t USING (dataset)),
rows_of AS ({rows})
SELECT dataset, factor, {r('ss', 4)} AS ss, CAST(dof AS BIGINT) AS dof, {r("CASE WHEN factor <> 'residual' THEN ss / dof / (rest / rest_dof) END", 4)} AS f,
  {r("CASE WHEN factor <> 'residual' THEN ss / sum(ss) OVER (PARTITION BY dataset) END")} AS eta2, {r(omega)} AS omega2 FROM rows_of"""


def _factors(t, kind: int):
    d = t.withColumns({"kind": F.col("run") >= 3, "y": F.col("price") / 1000})
    out = fits.factor_tests(d.withColumnRenamed("q", "x"), ["dataset"], {"kind": True, "x": False}, "y", kind=kind, interaction=True)
    return rounded(out.drop("p").withColumns({c: F.round(c, 4) for c in ("ss", "f")}))


@query("stats", _covariate_tests(1))
def factors_in_turn(t):
    return _factors(t, 1)


@query("stats", _covariate_tests(2))
def factors_after_others(t):
    return _factors(t, 2)


@query("stats", _covariate_tests(3))
def factors_after_all(t):
    return _factors(t, 3)


# curves with errors: a line has closed forms

_LINES = """
, pts AS (SELECT dataset, CAST(p AS DOUBLE) AS x, avg(price) / 1000 AS y FROM stats GROUP BY ALL),
m AS (SELECT dataset, count(*) AS n, avg(x) AS mx, regr_slope(y, x) AS a, regr_intercept(y, x) AS b, regr_sxx(y, x) AS sxx, regr_syy(y, x) AS syy, regr_sxy(y, x) AS sxy FROM pts GROUP BY dataset),
f AS (SELECT *, (syy - sxy * sxy / sxx) / (n - 2) AS s2, sxy * sxy / sxx / syy AS r2 FROM m)"""


def _points(t):
    return t.groupBy("dataset", "p").agg((F.avg("price") / 1000).alias("price"))


@query("stats", f"{_LINES}\nSELECT dataset, 'poly1' AS kind, {r('a', 3)} AS slope, {r('b', 4)} AS level, {r('sqrt(s2 / sxx)', 3)} AS slope_error, {r('sqrt(s2 * (1.0 / n + mx * mx / sxx))', 4)} AS level_error, {r('-mx * s2 / sxx', 3)} AS covariance, {r('r2')} AS r2, n FROM f")
def curves_with_errors(t):
    f = curves.fit_curves(_points(t), ["dataset"], "p", "price", ["poly1"], 0.0)
    errors = curves.parameter_errors(F.size("parameters"), F.col("covariance"))
    return rounded(f.select(
        "dataset", "kind", *[F.round(c, k).alias(n) for c, k, n in ((F.get("parameters", 0), 3, "slope"), (F.get("parameters", 1), 4, "level"), (F.get(errors, 0), 3, "slope_error"), (F.get(errors, 1), 4, "level_error"), (F.get("covariance", 1), 3, "covariance"))], "r2", "n",
    ))


@query("stats", f"""{_LINES},
d AS (SELECT unnest(range(1, 401)) AS draw), u AS (SELECT draw, i, (('0x' || md5(concat_ws('|', 7, i, draw))[1:7])::BIGINT + 0.5) / 268435456.0::DOUBLE AS u FROM d, (SELECT unnest(range(0, 4)) AS i)),
z AS (SELECT draw, sqrt(-2 * ln(max(u) FILTER (WHERE i = 0))) * cos(2 * pi() * max(u) FILTER (WHERE i = 1)) AS za, sqrt(-2 * ln(max(u) FILTER (WHERE i = 2))) * cos(2 * pi() * max(u) FILTER (WHERE i = 3)) AS zb FROM u GROUP BY draw),
e AS (SELECT *, sqrt(s2 / sxx) AS ea, sqrt(s2 * (1.0 / n + mx * mx / sxx)) AS eb FROM f),
y AS (SELECT dataset, x, CASE WHEN ea <= 5 * abs(a) AND eb <= 5 * abs(b) THEN (a + ea * za) * x + b + eb * zb END AS y FROM pts JOIN e USING (dataset), z)
SELECT dataset, {r('x')} AS p, {r('quantile_cont(y, 0.05)', 4)} AS low, {r('quantile_cont(y, 0.95)', 4)} AS high FROM y GROUP BY dataset, x""")
def fitted_bands(t):
    pts = _points(t)
    f = curves.fit_curves(pts, ["dataset"], "p", "price", ["poly1"], 0.0)
    return rounded(curves.curve_bands(pts, f, ["dataset"], "p", draws=400, seed=7, level=0.9).withColumns({c: F.round(c, 4) for c in ("low", "high")}))


@query("stats")
def best_curves(t):
    """The best of all families for each dataset, by the mean over units at every dose."""
    f = curves.fit_curves(_points(t), ["dataset"], "p", "price", sorted(curves.FAMILIES), 0.0)
    errors = curves.parameter_errors(F.size("parameters"), F.col("covariance"))
    return rounded(f.select("dataset", "kind", *[F.transform(c, lambda v: F.round(v, 2)).alias(n) for c, n in ((F.col("parameters"), "parameters"), (errors, "errors"))], "r2", "n"), 4)


# scan lines: trials as frames, and the frames of a trial as its lines

_LINES_OF = "y AS (SELECT dataset, roi, trial AS frame, frame AS line, v FROM traces)"


def _lines(t):
    return t.select("dataset", "roi", F.col("trial").alias("frame"), F.col("frame").alias("line"), "v")


@query("traces", f"""
, {_LINES_OF}, l AS (SELECT dataset, roi, median(v) AS l FROM y WHERE frame <= 4 GROUP BY ALL), z AS (SELECT y.dataset, y.roi, frame, line, v - l AS v FROM y JOIN l USING (dataset, roi)),
p AS (SELECT dataset, roi, line, avg(v) AS p FROM z WHERE frame BETWEEN 1 AND 3 GROUP BY ALL)
SELECT z.dataset, z.roi, z.frame, z.line, {r('v - p')} AS v FROM z JOIN p USING (dataset, roi, line)""")
def intraframe_corrected(t):
    return rounded(scans.intraframe_corrected(_lines(t), UNIT, "v", 4, row="line"))


#: Place i of 8 lines, mirrored at both ends.
_MIRROR = "(CASE WHEN {i} < 0 THEN -1 - {i} WHEN {i} > 7 THEN 15 - {i} ELSE {i} END + 1)"


@query("traces", f"""
, {_LINES_OF}, l AS (SELECT dataset, roi, median(v) AS l FROM y WHERE frame <= 4 GROUP BY ALL), z AS (SELECT y.dataset, y.roi, frame, line, v - l AS v FROM y JOIN l USING (dataset, roi)),
e AS (SELECT dataset, roi, frame, max(v) FILTER (WHERE line = 7) AS last, max(v) FILTER (WHERE line = 0) AS first FROM z GROUP BY ALL), k AS (SELECT *, lag(last) OVER (PARTITION BY dataset, roi ORDER BY frame) AS before FROM e),
d AS (SELECT z.dataset, z.roi, z.frame, line, v - CASE WHEN z.frame = 0 THEN first + (last - first) * line / 7.0::DOUBLE ELSE before + (last - before) * (line + 1) / 8.0::DOUBLE END AS v FROM z JOIN k USING (dataset, roi, frame)),
p AS (SELECT dataset, roi, line, avg(v) AS p FROM d WHERE frame BETWEEN 2 AND 3 GROUP BY ALL), c AS (SELECT d.dataset, d.roi, d.frame, d.line, v - p AS v FROM d JOIN p USING (dataset, roi, line)),
a AS (SELECT dataset, roi, frame, list(v ORDER BY line) AS x FROM c GROUP BY ALL),
m AS (SELECT *, list_transform(range(0, 8), lambda i: list_max(list_transform(range(i - 1, i + 2), lambda j: x[{_MIRROR.format(i='j')}]))) AS top FROM a),
g AS (SELECT *, list_transform(range(0, 8), lambda i: list_sum(list_transform(range(-4, 5), lambda h: exp(-0.5::DOUBLE * h * h) * top[{_MIRROR.format(i='(i + h)')}])) / list_sum(list_transform(range(-4, 5), lambda h: exp(-0.5::DOUBLE * h * h)))) AS base FROM m)
SELECT dataset, roi, frame, CAST(i AS INT) AS line, {r('x[i + 1] - base[i + 1]')} AS v FROM (SELECT *, unnest(range(0, 8)) AS i FROM g)""")
def intraframe_detrended(t):
    return rounded(scans.intraframe_corrected(_lines(t), UNIT, "v", 4, before=2, detrend=True, window=3, row="line"))


@query("traces", f"""
, b AS (SELECT dataset, trial, frame AS line, avg(v) AS v FROM traces GROUP BY ALL), y AS (SELECT dataset, trial AS frame, line, v, avg(v) OVER (PARTITION BY dataset, trial) AS slow FROM b),
w AS (SELECT *, sin(2 * pi() * line / 8.0) AS s1, cos(2 * pi() * line / 8.0) AS c1, sin(4 * pi() * line / 8.0) AS s2, cos(4 * pi() * line / 8.0) AS c2, frame BETWEEN 1 AND 4 AS pre FROM y),
k AS (SELECT dataset, avg((v - slow) * s1) * 2 AS a1, avg((v - slow) * c1) * 2 AS b1, avg((v - slow) * s2) * 2 AS a2, avg((v - slow) * c2) * 2 AS b2, median(slow) AS mid FROM w WHERE pre GROUP BY dataset),
t AS (SELECT w.*, a1 * s1 + b1 * c1 + a2 * s2 + b2 * c2 AS raw, slow - mid AS h FROM w JOIN k USING (dataset)), q AS (SELECT dataset, quantile_cont(abs(h), 0.75) FILTER (WHERE pre) AS scale, sqrt(avg(raw * raw)) AS rms FROM t GROUP BY dataset),
x AS (SELECT t.dataset, frame, line, v, raw / rms AS p, raw / rms * h / scale AS q FROM t JOIN q USING (dataset)),
g AS (SELECT dataset, avg(p * p) - avg(p) ** 2 + 1e-5 / count(*) AS pp, avg(p * q) - avg(p) * avg(q) AS pq, avg(q * q) - avg(q) ** 2 + 1e-5 / count(*) AS qq, avg(p * v) - avg(p) * avg(v) AS pv, avg(q * v) - avg(q) * avg(v) AS qv FROM x GROUP BY dataset)
SELECT x.dataset, frame, line, {r('v')} AS v, {r('(p * (pv * qq - qv * pq) + q * (qv * pp - pv * pq)) / (pp * qq - pq * pq)')} AS artifact FROM x JOIN g USING (dataset)""")
def raster_artifacts(t):
    means = t.groupBy("dataset", F.col("trial").alias("frame"), F.col("frame").alias("line")).agg(F.avg("v").alias("v"))
    slow = means.join(means.groupBy("dataset", "frame").agg(F.avg("v").alias("slow")), ["dataset", "frame"])
    return rounded(scans.raster_artifact(slow, ["dataset"], "v", "slow", 5, before=4, harmonics=2, row="line"))


@query("traces")
def raster_artifacts_smooth(t):
    means = t.groupBy("dataset", F.col("trial").alias("frame"), F.col("frame").alias("line")).agg(F.avg("v").alias("v"))
    slow = means.join(means.groupBy("dataset", "frame").agg(F.avg("v").alias("slow")), ["dataset", "frame"])
    return rounded(scans.raster_artifact(slow, ["dataset"], "v", "slow", 5, before=4, harmonics=2, splines=7, mode="smooth", row="line"), 5)


@query("flat", """
, t AS (SELECT dataset, roi, frame, (frame - 1) / 256.0::DOUBLE - 0.03::DOUBLE AS t FROM flat), k AS (SELECT *, floor(t * 40 + 1e-9) AS k FROM t)
SELECT dataset, roi, frame, CASE WHEN frame >= 1 AND k >= 0 AND k < 5 AND t * 40 - k <= 0.5 + 1e-9 THEN -1.0::DOUBLE ELSE 0.0::DOUBLE END AS template, CASE WHEN frame >= 12 AND frame < 20 THEN 3.0::DOUBLE ELSE 1.0::DOUBLE END AS pulse FROM k""")
def templates_drawn(t):
    at = F.col("frame")
    return t.select(*UNIT, "frame", scans.stimulus_template(at, 0.03, 0.125, 40, 50, 4, 64).alias("template"), models.pulse_template(at, 12, 8, 2.0, 1.0).alias("pulse"))


@query("flat", f"""
, lines AS (SELECT CAST(unnest(range(0, 64)) AS INT) AS i), e AS (SELECT i, (i - 1) / 256.0::DOUBLE - 0.03::DOUBLE AS t FROM lines),
w AS (SELECT i, CASE WHEN i >= 1 AND floor(t * 40 + 1e-9) >= 0 AND floor(t * 40 + 1e-9) < 5 AND t * 40 - floor(t * 40 + 1e-9) <= 0.5 + 1e-9 THEN -1.0::DOUBLE ELSE 0.0::DOUBLE END AS w FROM e),
z AS (SELECT i, (w - avg(w) OVER ()) / stddev_pop(w) OVER () AS w FROM w), y AS (SELECT dataset, roi, list((v - m) / s ORDER BY frame) AS y FROM (SELECT *, avg(v) OVER u AS m, stddev_pop(v) OVER u AS s FROM flat WINDOW u AS (PARTITION BY dataset, roi)) GROUP BY ALL),
c AS (SELECT j, CASE WHEN j = 3 THEN 0.0::DOUBLE ELSE -0.06::DOUBLE + 0.02::DOUBLE * j END AS c FROM (SELECT unnest(range(0, 7)) AS j)), p AS (SELECT j, c, i, i / (1 + c) AS place FROM c, lines WHERE i / (1 + c) <= 63 + 1e-9),
s AS (SELECT dataset, roi, j, c, i, y[CAST(floor(place + 1e-12) AS INT) + 1] * (1 - (place - floor(place + 1e-12))) + coalesce(y[CAST(floor(place + 1e-12) AS INT) + 2], 0) * (place - floor(place + 1e-12)) AS x FROM y, p),
k AS (SELECT CAST(unnest(range(-4, 5)) AS INT) AS k),
o AS (SELECT dataset, roi, j, c, k, round(sum(x * w) / 64, 10) AS o FROM s, k JOIN z ON z.i = s.i + k GROUP BY ALL),
b AS (SELECT *, row_number() OVER (PARTITION BY dataset, roi ORDER BY o DESC, j, k) AS n, max(o) FILTER (WHERE j = 3 AND k = 0) OVER (PARTITION BY dataset, roi) AS f FROM o)
SELECT dataset, roi, {r('f')} AS first_corr, {r('o')} AS corr, k AS shift, {r('100 * c')} AS stretch, {r('256 / (1 + c)')} AS effective_rate, {r('1000 * k * (1 + c) / 256')} AS offset_ms FROM b WHERE n = 1""")
def stimulus_matches(t):
    return rounded(scans.match_stimulus(t, UNIT, "v", onset=0.03, duration=0.125, rate=40, duty_cycle=50, fps=4, lines=64, most_shift=0.016, stretch_range=0.06, stretches=7, row="frame"))


@query("traces", f"""
, l AS (SELECT *, lag(v) OVER (PARTITION BY dataset, roi ORDER BY trial, frame) AS p FROM traces), a AS (SELECT dataset, roi, regr_slope(v, p) AS phi, regr_intercept(v, p) AS c FROM l GROUP BY ALL),
s AS (SELECT dataset, roi, trial, v AS s FROM traces WHERE frame = 3)
SELECT t.dataset, t.roi, t.trial, t.frame, {r('v')} AS v, {r('CASE WHEN frame BETWEEN 4 AND 6 THEN pow(phi, frame - 3) * s + c * (1 - pow(phi, frame - 3)) / (1 - phi) ELSE v END')} AS predicted FROM traces t JOIN a USING (dataset, roi) JOIN s USING (dataset, roi, trial)""")
def pooled_forecasts(t):
    return rounded(scans.pooled_forecast(t, UNIT, "v", 4, 6, order=1))


@query("traces")
def pooled_surrogate_forecasts(t):
    return rounded(scans.pooled_forecast(t, UNIT, "v", 4, 6, surrogate="phase", seed=3))


# splines, sets of criteria, time and frequency


@query("traces", f"""
, l AS (SELECT *, lag(v, 1) OVER w AS a, lag(v, 2) OVER w AS b, lag(v, 3) OVER w AS c, lag(v, 4) OVER w AS d, lag(v, 5) OVER w AS e FROM traces WINDOW w AS (PARTITION BY dataset, roi, trial ORDER BY frame))
SELECT dataset, roi, trial, frame, {r('CASE WHEN frame IN (5, 7) THEN greatest(4.25 * CASE WHEN frame = 7 THEN a ELSE a END - 7 * b + 5.5 * c - 2 * d + 0.25 * e, 0) ELSE v END')} AS v FROM (SELECT * REPLACE (CASE WHEN frame = 7 THEN greatest(4.25 * c - 7 * d + 5.5 * e - 2 * lag6 + 0.25 * lag7, 0) ELSE b END AS b) FROM (SELECT *, lag(v, 6) OVER w AS lag6, lag(v, 7) OVER w AS lag7 FROM l WINDOW w AS (PARTITION BY dataset, roi, trial ORDER BY frame)))""")
def extrapolated_cubic(t):
    """Frame 5 from frames 0 to 4, then frame 7 with the new frame 5; frame 2 has too few before it."""
    return rounded(models.extrapolate(t, TRACE, "v", [2, 5, 7]))


@query("traces", f"""
, f AS (SELECT dataset, frame, v, roi % 3 = 0 AS third, trial % 2 = 1 AS odd, v > 0.2 AS high FROM traces),
m AS (SELECT * FROM (VALUES ('none', false, false, false), ('third', true, false, false), ('odd', false, true, false), ('third & odd', true, true, false), ('high', false, false, true), ('third & high', true, false, true), ('odd & high', false, true, true), ('third & odd & high', true, true, true)) x(criteria, a, b, c)),
k AS (SELECT dataset, criteria, frame, v, NOT (a AND third OR b AND odd OR c AND high) AS kept FROM f, m)
SELECT dataset, criteria, frame, {r('avg(v) FILTER (WHERE kept)')} AS mean, count(v) FILTER (WHERE kept) AS n, {r('100.0 * (1 - sum(count(*) FILTER (WHERE kept)) OVER w / sum(count(*)) OVER w)')} AS percent FROM k GROUP BY dataset, criteria, frame WINDOW w AS (PARTITION BY dataset, criteria)""")
def traces_by_exclusion(t):
    flagged = t.select("dataset", "frame", "v", (F.col("roi") % 3 == 0).alias("third"), (F.col("trial") % 2 == 1).alias("odd"), (F.col("v") > 0.2).alias("high"))
    return rounded(tables.traces_by_exclusion(flagged, ["third", "odd", "high"], ["dataset"], "frame", "v"))


@query("flat", f"""
, w AS (SELECT CAST(k AS INT) AS k, CASE WHEN k = 0 THEN 0.0::DOUBLE WHEN k IN (1, 15) THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS w FROM (SELECT unnest(range(0, 16)) AS k)),
g AS (SELECT CAST(unnest(range(0, 7)) AS INT) AS s), f AS (SELECT CAST(unnest(range(0, 17)) AS INT) AS f),
s AS (SELECT dataset, roi, s, frame - 8 * s AS k, v - avg(v) OVER (PARTITION BY dataset, roi, s) AS v FROM flat, g WHERE frame >= 8 * s AND frame <= 8 * s + 15),
m AS (SELECT dataset, roi, s, f, sqrt(sum(v * w * cos(2 * pi() * f * k / 32)) ** 2 + sum(v * w * sin(2 * pi() * f * k / 32)) ** 2) / (SELECT sum(w) FROM w) AS m FROM s JOIN w USING (k), f GROUP BY ALL)
SELECT dataset, roi, {r('(8 + 8 * s) / 64.0')} AS t, {r('f * 2.0::DOUBLE')} AS freq, {r('m')} AS magnitude FROM m""")
def spectrograms(t):
    return rounded(kernels.spectrogram(t, UNIT, "v", 64, span=0.25, resolution=2))


@query("flat", f"""
, k AS (SELECT CAST(unnest(range(0, 33)) AS INT) AS k), p AS (SELECT dataset, roi, k, sum(v * cos(2 * pi() * k * frame / 64)) ** 2 + sum(v * sin(2 * pi() * k * frame / 64)) ** 2 AS p FROM flat, k GROUP BY ALL)
SELECT dataset, {r('k / 2.0')} AS freq, {r('avg(p)')} AS power FROM p GROUP BY dataset, k""")
def mean_spectra(t):
    return rounded(kernels.mean_spectrum(t, ["dataset"], ["roi"], "v", 32))


# whole session documents, written from tables and read back


def _part_document():
    tenth = (F.col("p_size") / 10).cast("string")
    other = F.when(F.col("p_size") % 5 == 0, ((F.col("p_size") + 10) / 10).cast("string")).otherwise(tenth)
    axis = lambda name, value: F.concat(F.lit(f'<IndexedValue index="{name}" value="'), value, F.lit('"/>'))
    size = F.col("p_size").cast("string")
    return F.concat(
        F.lit('<?xml version="1.0"?><PVScan version="5"><PVStateShard><PVStateValue key="dwell" value="'), size, F.lit('"/><PVStateValue key="resonant" value="'), F.when(F.col("p_size") % 2 == 0, "True").otherwise("False"),
        F.lit('"/><PVStateValue key="micronsPerPixel">'), axis("XAxis", tenth), axis("YAxis", other), axis("ZAxis", F.lit("5")),
        F.lit('</PVStateValue><PVStateValue key="laserPower"><IndexedValue index="0" value="'), size, F.lit('" description="Pockels"/></PVStateValue><PVStateValue key="daq"><IndexedValue index="0" value="'), size,
        F.lit('x"/></PVStateValue><PVStateValue key="pmtGain"><IndexedValue index="0" value="600" description="Red"/><IndexedValue index="1" value="'), size,
        F.lit('" description="Green"/></PVStateValue><PVStateValue key="preampFilter"><IndexedValue index="0" value="1" description="'), size,
        F.lit(' kHz"/></PVStateValue><PVStateValue key="positionCurrent"><SubindexedValues index="XAxis"><SubindexedValue subindex="0" value="'), size,
        F.lit('"/></SubindexedValues><SubindexedValues index="ZAxis"><SubindexedValue subindex="0" value="1 mV" description="Focus"/><SubindexedValue subindex="1" value="2" description="Piezo"/></SubindexedValues></PVStateValue></PVStateShard></PVScan>'),
    )


_D, _S = "CAST({} AS DOUBLE)", "CAST(p_size AS VARCHAR)"


@query("part", " UNION ALL ".join(f"SELECT p_partkey, {key} AS key, {value} AS value, {number} AS number, {flag} AS flag, {quantity} AS quantity, {unit} AS unit FROM part WHERE {where}" for key, value, number, flag, quantity, unit, where in [
    ("'dwell'", _S, "p_size::DOUBLE", "NULL::BOOLEAN", "NULL::DOUBLE", "NULL", "true"), ("'resonant'", "CASE WHEN p_size % 2 = 0 THEN 'True' ELSE 'False' END", "NULL::DOUBLE", "p_size % 2 = 0", "NULL::DOUBLE", "NULL", "true"),
    ("'micronsPerPixel'", "CAST(p_size / 10.0::DOUBLE AS VARCHAR)", "p_size / 10.0::DOUBLE", "NULL::BOOLEAN", "NULL::DOUBLE", "NULL", "p_size % 5 <> 0"),
    ("'micronsPerPixel XAxis'", "CAST(p_size / 10.0::DOUBLE AS VARCHAR)", "p_size / 10.0::DOUBLE", "NULL::BOOLEAN", "NULL::DOUBLE", "NULL", "p_size % 5 = 0"),
    ("'micronsPerPixel YAxis'", "CAST((p_size + 10) / 10.0::DOUBLE AS VARCHAR)", "(p_size + 10) / 10.0::DOUBLE", "NULL::BOOLEAN", "NULL::DOUBLE", "NULL", "p_size % 5 = 0"),
    ("'Pockels power'", _S, "p_size::DOUBLE", "NULL::BOOLEAN", "NULL::DOUBLE", "NULL", "true"), ("'DAQ gain'", f"{_S} || 'x'", "p_size::DOUBLE", "NULL::BOOLEAN", "NULL::DOUBLE", "NULL", "true"),
    ("'pmtGain Red'", "'600'", "600::DOUBLE", "NULL::BOOLEAN", "NULL::DOUBLE", "NULL", "true"), ("'pmtGain Green'", _S, "p_size::DOUBLE", "NULL::BOOLEAN", "NULL::DOUBLE", "NULL", "true"),
    ("'preampFilter'", "'1'", "1::DOUBLE", "NULL::BOOLEAN", "p_size * 1000.0::DOUBLE", "'Hz'", "true"), ("'positionCurrent XAxis'", _S, "p_size::DOUBLE", "NULL::BOOLEAN", "NULL::DOUBLE", "NULL", "true"),
    ("'positionCurrent ZAxis Focus'", "'1 mV'", "NULL::DOUBLE", "NULL::BOOLEAN", "0.001::DOUBLE", "'V'", "true"), ("'positionCurrent ZAxis Piezo'", "'2'", "2::DOUBLE", "NULL::BOOLEAN", "NULL::DOUBLE", "NULL", "true"),
]))
def document_settings(t):
    return rounded(sessions.document_settings(t.select("p_partkey", _part_document().alias("x")), ["p_partkey"], "x"))


def _order_document(t):
    """A document a customer: a sequence a status, a frame an order, and an output on open ones."""
    frame = F.format_string('<Frame relativeTime="%s" absoluteTime="%s" index="%d" parameterSet="CurrentSettings"/>', (F.col("o_orderkey") / 8).cast("string"), (F.col("o_orderkey") / 8 + 2).cast("string"), F.col("o_orderkey"))
    own = t.groupBy("o_custkey", "o_orderstatus").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", frame.alias("x")))), lambda s: s["x"]), "").alias("x"), F.min("o_orderkey").alias("k"))
    output = F.when(F.col("o_orderstatus") == "O", F.format_string('<VoltageOutput name="pulse %d" triggerMode="None" filename="v.xml" relativeTime="0.5" absoluteTime="%d"/>', "k", "k")).otherwise("")
    text = F.concat(F.format_string('<Sequence type="%s" cycle="%d" time="10:11:12.1234567" bidirectionalZ="%s">', "o_orderstatus", F.col("k") % 100, F.when(F.col("o_orderstatus") == "F", "True").otherwise("False")), output, "x", F.lit("</Sequence>"))
    docs = own.groupBy("o_custkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderstatus", text.alias("x")))), lambda s: s["x"]), "").alias("x"))
    return docs.select("o_custkey", F.concat(F.lit("<PVScan>"), "x", F.lit("</PVScan>")).alias("x"))


_ORDER_SEQUENCES = "s AS (SELECT o_custkey, o_orderstatus, count(*) AS frames, min(o_orderkey) AS k, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus) - 1 AS INT) AS sequence FROM orders GROUP BY o_custkey, o_orderstatus)"


@query("orders", f"WITH {_ORDER_SEQUENCES} SELECT o_custkey, sequence, o_orderstatus AS type, CAST(k % 100 AS INT) AS cycle, '10:11:12.123456' AS time, o_orderstatus = 'F' AS bidirectional, CAST(frames AS INT) AS frames FROM s")
def document_sequences(t):
    return sessions.document_sequences(_order_document(t), ["o_custkey"], "x")


@query("orders", f"WITH {_ORDER_SEQUENCES} SELECT o_custkey, sequence, CAST(o_orderkey AS INT) AS index, {r('o_orderkey / 8.0')} AS relative_time, {r('o_orderkey / 8.0 + 2')} AS absolute_time, 'CurrentSettings' AS parameter_set FROM orders JOIN s USING (o_custkey, o_orderstatus)")
def document_frames(t):
    return rounded(sessions.document_frames(_order_document(t), ["o_custkey"], "x"))


@query("orders", f"WITH {_ORDER_SEQUENCES} SELECT o_custkey, sequence, 'pulse ' || k AS name, 'None' AS trigger_mode, 'v.xml' AS filename, 0.5::DOUBLE AS relative_time, k::DOUBLE AS absolute_time FROM s WHERE o_orderstatus = 'O'")
def document_outputs(t):
    return rounded(sessions.document_outputs(_order_document(t), ["o_custkey"], "x"))


@query("part", """
SELECT p_partkey, 'size' AS path, CAST(p_size AS VARCHAR) AS value, p_size::DOUBLE AS number, NULL::BOOLEAN AS flag FROM part
UNION ALL SELECT p_partkey, 'scan.rate', p_size || '.5', p_size + 0.5::DOUBLE, NULL FROM part UNION ALL SELECT p_partkey, 'scan.rois.0.n', '1', 1, NULL FROM part UNION ALL SELECT p_partkey, 'scan.rois.1.n', CAST(p_size AS VARCHAR), p_size, NULL FROM part
UNION ALL SELECT p_partkey, 'scan.on', CASE WHEN p_size % 2 = 0 THEN 'true' ELSE 'false' END, NULL, p_size % 2 = 0 FROM part UNION ALL SELECT p_partkey, 'scan.gap', NULL, NULL, NULL FROM part UNION ALL SELECT p_partkey, 'brand', p_brand, NULL, NULL FROM part""")
def documents_flattened(t):
    text = F.format_string('{"size": %d, "scan": {"rate": "%d.5", "rois": [{"n": 1}, {"n": %d}], "on": %s, "gap": NaN}, "brand": "%s"}', "p_size", "p_size", "p_size", F.when(F.col("p_size") % 2 == 0, "true").otherwise("false"), "p_brand")
    return sessions.flatten_json(t.select("p_partkey", text.alias("j")), ["p_partkey"], "j")


# a collection of datasets, saved and loaded


@query("stats", f"""
, s AS (SELECT dataset, run, avg(q) AS q FROM stats WHERE dataset NOT LIKE '%R%' GROUP BY ALL), k AS (SELECT dataset, run % 5 AS condition, max(run) AS run FROM s GROUP BY ALL), m AS (SELECT *, dense_rank() OVER (ORDER BY condition) - 1 AS place FROM k),
t AS (SELECT dataset, run, CAST(roi % CASE WHEN dataset LIKE 'A%' THEN 6 ELSE 8 END AS INT) AS frame, avg(price) AS v, min(run) + min(ascii(dataset)) AS run_id FROM stats WHERE dataset NOT LIKE '%R%' GROUP BY ALL),
n AS (SELECT min(f) AS f FROM (SELECT dataset, max(frame) AS f FROM t GROUP BY ALL)), u AS (SELECT t.*, run_id - min(run_id) OVER (PARTITION BY dataset) AS id FROM t JOIN m USING (dataset, run))
SELECT u.dataset, CAST(place AS INT) AS run, u.frame, {r('u.v', 4)} AS v, {r('s.q')} AS q, CAST(id AS INT) AS run_id FROM u JOIN m USING (dataset, run) JOIN s USING (dataset, run), n WHERE u.frame <= n.f""")
def collection_loaded(t):
    """Saved by dataset and run, then loaded without a group of datasets: one number a condition in both tables, and the frames that all have."""
    spark = t.sparkSession
    frame = (F.col("roi") % F.when(F.col("dataset").startswith("A"), 6).otherwise(8)).cast("int")
    series = t.groupBy("dataset", "run", frame.alias("frame")).agg(F.avg("price").alias("v"), (F.min("run") + F.ascii("dataset")).cast("int").alias("run_id"))
    root = work.work_folder(spark, "collection")
    loader.save_collection({"stats": t.groupBy("dataset", "run").agg(F.avg("q").alias("q")), "series": series}, root)
    own = loader.load_collection(spark, root, ["stats", "series"], optional=("masks",), exclude=("R",), condition=F.col("run") % 5, reference="stats", on_duplicate="drop_first", run_id="run_id")
    out = own["series"].join(own["stats"], ["dataset", "run"])
    return rounded(out.select("dataset", F.col("run").cast("int").alias("run"), "frame", F.round("v", 4).alias("v"), "q", "run_id"))


# the whole chain of stacks, and the runs of sessions


@query("flat", f"""
, p AS (SELECT dataset, roi % 6 AS px, frame, avg(v) * 1000 + 5000 AS v FROM flat GROUP BY ALL), m AS (SELECT dataset, px, frame % 2 AS channel, frame // 2 AS frame, v FROM p),
w AS (SELECT a.dataset, a.px, a.channel, a.frame, round_even(b.v, 0) AS v FROM m a JOIN m b ON b.dataset = a.dataset AND b.px = a.px AND b.channel = a.channel AND b.frame = CASE WHEN a.frame % 8 = 0 THEN a.frame + 1 ELSE a.frame END),
ref AS (SELECT dataset, px, median(v) AS ref FROM w WHERE channel = 0 GROUP BY ALL), k AS (SELECT dataset, frame, CASE WHEN abs(regr_slope(v, ref)) * stddev_pop(ref) > 1e-9::DOUBLE * max(abs(v)) THEN regr_slope(v, ref) END AS s, regr_intercept(v, ref) AS i FROM w JOIN ref USING (dataset, px) WHERE channel = 0 GROUP BY ALL),
c AS (SELECT w.dataset, w.px, w.channel, w.frame, (v - i) / s AS v FROM w JOIN k USING (dataset, frame)), l AS (SELECT dataset, px, channel, list(v ORDER BY frame) AS y FROM c GROUP BY ALL),
x AS (SELECT dataset, px, channel, unnest(range(0, 32)) AS f, y FROM l)
SELECT dataset, px, CAST(channel AS INT) AS channel, CAST(f AS INT) AS frame, {r("CASE WHEN y[f + 1] IS NOT NULL THEN list_reduce(list_filter(list_transform(range(0, f + 1), lambda t: [t::DOUBLE, y[t + 1]]), lambda z: z[2] IS NOT NULL), lambda a, b: [b[1], 0.4::DOUBLE * a[2] + 0.6::DOUBLE * b[2] + (b[2] - a[2]) / (b[1] + 1)])[2] / 1000 END", 2)} AS v FROM x""")
def stacks_corrected(t):
    """Files of pixels to channels, with moved frames, corrected by the first channel and denoised."""
    px = t.groupBy("dataset", (F.col("roi") % 6).alias("px"), "frame").agg((F.avg("v") * 1000 + 5000).alias("v"))
    files = px.select("dataset", "px", (2 * F.floor(F.col("frame") / 16) + 1).cast("int").alias("cycle"), (F.col("frame") % 16).alias("number"), "v")
    moves = acquisition.expand_moves(t.sparkSession.createDataFrame([(1, 0, 8)], "src int, dst int, repeat int"), 32)
    out = pipelines.corrected_stacks(files, ["dataset"], "px", "v", channels=2, moves=moves, length=32, rate_in=30, rate_out=30, reference=0, gain=0.4)
    return rounded(out.select("dataset", "px", "channel", "frame", (F.col("v") / 1000).alias("v")), 2)


@query("stats", """
, f AS (SELECT dataset, run, roi % CASE WHEN run = 7 THEN 2 ELSE 3 END AS trial, CAST(price AS BIGINT) % CASE WHEN dataset = 'AF' AND run = 2 THEN 3 ELSE 4 END AS frame FROM stats), n AS (SELECT dataset, run, trial, count(DISTINCT frame) AS n FROM f GROUP BY ALL),
u AS (SELECT dataset, run, count(*) AS trials FROM n GROUP BY ALL), g AS (SELECT dataset, run, n AS frames FROM (SELECT dataset, run, n, row_number() OVER (PARTITION BY dataset, run ORDER BY count(*) DESC, n) AS i FROM n GROUP BY dataset, run, n) WHERE i = 1),
a AS (SELECT dataset, trials AS usual_trials FROM (SELECT dataset, trials, row_number() OVER (PARTITION BY dataset ORDER BY count(*) DESC, trials) AS i FROM u GROUP BY dataset, trials) WHERE i = 1),
b AS (SELECT dataset, frames AS usual_frames FROM (SELECT dataset, frames, row_number() OVER (PARTITION BY dataset ORDER BY count(*) DESC, frames) AS i FROM g GROUP BY dataset, frames) WHERE i = 1),
x AS (SELECT dataset, run, trials, frames, usual_trials, usual_frames, CASE WHEN run = 3 THEN 1 ELSE 0 END + CASE WHEN run = 5 THEN 1 ELSE 0 END AS strays FROM u JOIN g USING (dataset, run) JOIN a USING (dataset) JOIN b USING (dataset))
SELECT dataset, run, trials, frames, usual_trials, usual_frames, CAST(strays AS BIGINT) AS strays, trials <> usual_trials OR frames <> usual_frames OR strays > 0 AS outlier FROM x""")
def session_runs(t):
    """Runs of sessions by their trials, frames and settings."""
    files = t.select("dataset", "run", (F.col("roi") % F.when(F.col("run") == 7, 2).otherwise(3)).alias("trial"), (F.col("price").cast("decimal(20,0)").cast("long") % F.when((F.col("dataset") == "AF") & (F.col("run") == 2), 3).otherwise(4)).alias("frame"))
    settings = t.select("dataset", "run").distinct().withColumn("settings", F.create_map(F.lit("power"), F.when(F.col("run") == 3, "1.2").when(F.col("run") == 4, "1.005").otherwise("1.0"), F.lit("mode"), F.when(F.col("run") == 5, "fast").otherwise("slow")))
    return pipelines.session_runs(files, settings, "dataset", "run")


# trials, responders and comparisons


@query("stats", f"""
, a AS (SELECT dataset, roi, avg(price) AS price, avg(q) AS q, round(avg(p), 3) AS p, count(*) AS n_trials FROM (SELECT dataset, roi, price, q, CAST(p AS DOUBLE) AS p FROM stats) GROUP BY ALL), l AS (SELECT DISTINCT p FROM a),
g AS (SELECT p, sum(CASE WHEN p - before > 0.0015 THEN 1 ELSE 0 END) OVER (ORDER BY p) AS g FROM (SELECT p, lag(p) OVER (ORDER BY p) AS before FROM l)), m AS (SELECT g, avg(p) AS m FROM g GROUP BY g)
SELECT dataset, roi, {r('price', 4)} AS price, {r('q')} AS q, {r('m')} AS p, n_trials FROM a JOIN g USING (p) JOIN m USING (g)""")
def trial_means_resolved(t):
    rounded_p = lambda c: F.round(F.avg(c), 3)
    means = t.groupBy("dataset", "roi").agg(F.avg("price").alias("price"), F.avg("q").alias("q"), rounded_p(F.col("p")).alias("p"), F.count("*").alias("k"))
    out = aggregate.trial_means_resolved(means, ["dataset", "roi"], ["price", "q", "k"], {"p": 0.0015})
    return rounded(out.select("dataset", "roi", F.round("price", 4).alias("price"), "q", "p", F.col("k").cast("long").alias("n_trials")))


@query("stats", "SELECT 'run' AS \"column\", true AS repeated UNION ALL SELECT 'price', false UNION ALL SELECT 'one', true")
def repeated_values(t):
    return aggregate.repeated_values(t.withColumn("one", F.lit(1)), ["dataset", "run"], ["run", "price", "one"])


@query("trials", f"""
, {_KIND}, c AS (SELECT run, roi % 4 AS unit, count(*) FILTER (WHERE kind = 'negative') / count(kind) AS negative, count(*) FILTER (WHERE kind = 'positive') / count(kind) AS positive, count(*) FILTER (WHERE kind = 'weak') / count(kind) AS weak, count(kind) AS n FROM k GROUP BY ALL)
SELECT run, unit, {r('negative')} AS negative, {r('positive')} AS positive, {r('weak')} AS weak, n AS count, {r('n / sum(n) OVER (PARTITION BY run)')} AS weight FROM c""")
def responder_shares_by_unit(t):
    k = with_kind(t).withColumn("unit", F.col("roi") % 4)
    return rounded(aggregate.responder_shares(k, "run", ["unit"], "kind", ["negative", "positive", "weak"]))


@query("trials", f"""
, {_KIND}, e AS (SELECT CASE WHEN a = 0 THEN CAST(roi % 3 AS VARCHAR) ELSE 'all' END AS class, run, roi % 5 AS dataset, kind FROM k, (SELECT unnest([0, 1]) AS a)),
s AS (SELECT class, run, dataset, count(*) FILTER (WHERE kind = 'positive') / count(*) AS f, count(*) AS n FROM e GROUP BY ALL), w AS (SELECT *, n / sum(n) OVER (PARTITION BY class, run) AS w FROM s)
SELECT class, run, {r('sum(f * w)')} AS mean, {r('stddev_samp(f) / sqrt(count(f))')} AS sem, count(*) AS datasets FROM w GROUP BY class, run""")
def responder_fractions_with_all(t):
    k = with_kind(t).withColumns({"class": F.col("roi") % 3, "dataset": F.col("roi") % 5})
    return rounded(aggregate.responder_fractions(k, "run", "dataset", "class", "kind"))


#: Two-sided p of a t statistic with whole degrees of freedom: sums over powers of the cosine of atan(t / sqrt(dof)).
_T_P = """greatest(1 - CASE WHEN dof % 2 = 0 THEN sin(atan(abs(t) / sqrt(dof))) * list_sum(list_transform(range(0, dof // 2), lambda k: exp(lgamma(k + 0.5) - lgamma(k + 1) + k * ln(dof / (dof + t * t))) / sqrt(pi())))
  ELSE 2 / pi() * (atan(abs(t) / sqrt(dof)) + CASE WHEN dof > 1 THEN sin(atan(abs(t) / sqrt(dof))) * list_sum(list_transform(range(0, (dof - 1) // 2), lambda k: sqrt(pi()) / 2 * exp(lgamma(k + 1) - lgamma(k + 1.5) + (k + 0.5) * ln(dof / (dof + t * t))))) ELSE 0 END) END, 0)"""


@query("trials", f"""
, m AS (SELECT run, roi % 12 AS dataset, avg(v) AS m FROM trials GROUP BY ALL),
d AS (SELECT x.run AS a, y.run AS b, count(*) AS n, avg(y.m - x.m) / (stddev_samp(y.m - x.m) / sqrt(count(*))) AS t, CAST(count(*) - 1 AS BIGINT) AS dof FROM m x JOIN m y ON y.dataset = x.dataset AND x.run < y.run GROUP BY ALL), p AS (SELECT *, {_T_P} AS p FROM d)
SELECT a, b, n, {r('t')} AS stat, {r('p')} AS p, {r('least(p * count(p) OVER (), 1)')} AS corrected FROM p""")
def paired_conditions(t):
    return rounded(stats.condition_pairs(t.withColumn("dataset", F.col("roi") % 12), [], "dataset", "run", "v"))


@query("trials", f"""
, m AS (SELECT run, roi % 12 AS dataset, avg(v) AS m FROM trials GROUP BY ALL), s AS (SELECT run, avg(m) AS m, var_pop(m) * count(*) AS ss, count(*) AS n FROM m GROUP BY run),
d AS (SELECT x.run AS a, y.run AS b, x.n + y.n AS n, (y.m - x.m) / sqrt((x.ss + y.ss) / (x.n + y.n - 2) * (1.0 / x.n + 1.0 / y.n)) AS t, x.n + y.n - 2 AS dof FROM s x JOIN s y ON x.run < y.run), p AS (SELECT *, {_T_P} AS p FROM d)
SELECT a, b, n, {r('t')} AS stat, {r('p')} AS p, {r('least(p * count(p) OVER (), 1)')} AS corrected FROM p""")
def unpaired_conditions(t):
    return rounded(stats.condition_pairs(t.withColumn("dataset", F.col("roi") % 12), [], "dataset", "run", "v", paired=False))


@query("traces", f"""
, d AS (SELECT dataset, roi, avg(v) / (stddev_samp(v) / sqrt(count(v))) AS t, count(v) - 1 AS dof FROM traces GROUP BY ALL), p AS (SELECT *, {_T_P} AS p FROM d)
SELECT dataset, roi, {r('t')} AS stat, {r('p')} AS p, p >= 0.05 AS h0 FROM p""")
def grouped_tests(t):
    return rounded(stats.grouped_test(stats.one_sample_t(t, UNIT, "v"), UNIT))


@query("stats", f"""
, f AS (SELECT dataset, regr_slope(price, q) AS slope, corr(q, price) AS c, count(*) AS n FROM stats GROUP BY dataset), g AS (SELECT dataset, slope, c * c AS r2, c * sqrt((n - 2) / (1 - c * c)) AS t, n - 2 AS dof FROM f),
o AS (SELECT dataset, sum(CAST(p AS DOUBLE) * dc) AS xy, sum(CAST(p AS DOUBLE) * p) AS xx, sum(CAST(dc AS DOUBLE) * dc) AS yy, count(*) AS n FROM stats GROUP BY dataset), h AS (SELECT dataset, xy / xx AS origin_slope, xy / xx / sqrt((yy - xy / xx * xy) / (n - 1) / xx) AS t, n - 1 AS dof FROM o),
p AS (SELECT dataset, slope, r2, {_T_P} AS p FROM g), q AS (SELECT dataset, origin_slope, {_T_P} AS origin_p FROM h)
SELECT dataset, {r('slope / 1000', 5)} AS slope, {r('r2', 5)} AS r2, {r('p', 5)} AS p, {r('origin_slope', 5)} AS origin_slope, {r('origin_p', 5)} AS origin_p FROM p JOIN q USING (dataset)""")
def regression_p_values(t):
    fit = designs.regression_with_p(t, ["dataset"], "q", "price")
    origin = designs.regression_with_p(t, ["dataset"], "p", "dc", intercept=False)
    return rounded(fit.select("dataset", (F.col("slope") / 1000).alias("slope"), "r2", "p").join(origin.select("dataset", F.col("slope").alias("origin_slope"), F.col("p").alias("origin_p")), "dataset"), 5)


# further forms


@query("flat", f"""
, o AS (SELECT dataset, (dataset % 3) * 0.04::DOUBLE AS onset FROM flat GROUP BY dataset), s AS (SELECT dataset, roi, frame, floor((frame * 0.01::DOUBLE - onset) * 12.5) AS pulse, frame * 0.01::DOUBLE - onset AS t, v FROM flat JOIN o USING (dataset) WHERE frame * 0.01::DOUBLE - onset >= 0 AND frame * 0.01::DOUBLE - onset < 0.4)
SELECT dataset, roi, frame, CAST(pulse AS INT) AS pulse, {r('t - pulse / 12.5')} AS since, {r('v - max(v) OVER (PARTITION BY dataset, roi, pulse)')} AS v FROM s""")
def pulses_by_dataset(t):
    timed = t.select(*UNIT, "frame", (F.col("frame") * 0.01).alias("t"), (F.col("dataset") % 3 * 0.04).alias("onset"), "v")
    return rounded(reshape.split_pulses(timed, UNIT, "v", "t", 0.4, 12.5, onset="onset").drop("t", "onset"))


def _sorted_table(level: str) -> str:
    return f"""
, t AS (SELECT dataset, run, {level} AS level FROM stats GROUP BY ALL), a AS (SELECT dataset, row_number() OVER (ORDER BY {level} DESC, dataset) - 1 AS row_place FROM stats GROUP BY dataset), b AS (SELECT run, row_number() OVER (ORDER BY {level} DESC, run) - 1 AS column_place FROM stats GROUP BY run)
SELECT dataset, run, {r('level')} AS level, CAST(row_place AS INT) AS row_place, CAST(column_place AS INT) AS column_place FROM t JOIN a USING (dataset) JOIN b USING (run)"""


@query("stats", _sorted_table("median(price)"))
def stat_table_sorted(t):
    return rounded(reshape.sorted_stat_table(t, "dataset", "run", "price"))


@query("stats", _sorted_table("stddev_samp(price) / avg(price)"))
def stat_table_of_spread(t):
    return rounded(reshape.sorted_stat_table(t, "dataset", "run", "price", spread=True))


@query("flat", f"""
, g AS (SELECT dataset, max(v) - min(v) AS g FROM flat GROUP BY dataset), s AS (SELECT dataset, g + 0.2 * avg(g) OVER () AS step FROM g)
SELECT dataset, {r('coalesce(sum(step) OVER (ORDER BY dataset DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)')} AS "offset" FROM s""")
def category_offsets_falling(t):
    return rounded(align.category_offsets(t, "dataset", "v", ascending=False))


@query("stats", f"""
, c AS (SELECT dataset, p, avg(price) AS y FROM stats WHERE dc = 0.04 GROUP BY ALL), o AS (SELECT dataset, p, avg(price) AS m, stddev_samp(price) / sqrt(count(*)) AS s FROM stats WHERE dc <> 0.04 GROUP BY ALL)
SELECT dataset, {r('avg(abs(m - y) / s)', 4)} AS error, count(*) AS n FROM o JOIN c USING (dataset, p) WHERE s > 0 GROUP BY dataset""")
def sweep_alignment_errors(t):
    return rounded(models.sweep_alignment_error(t, ["dataset"], "p", "price", F.col("dc") == 0.04), 4)


@query("stats", f"""
, x AS (SELECT DISTINCT run, (q - 25) * pow(10.0, 2 * run - 8) AS x FROM (SELECT run, CAST(q AS DOUBLE) AS q FROM stats)), k AS (SELECT * FROM (VALUES ('p', -12), ('n', -9), ('u', -6), ('m', -3), ('', 0), ('k', 3), ('M', 6), ('G', 9), ('T', 12)) v(prefix, e)),
m AS (SELECT run, x, prefix, e, row_number() OVER (PARTITION BY run, x ORDER BY e DESC) AS i FROM x, k WHERE CASE WHEN x = 0 THEN e = 0 ELSE abs(x) >= pow(10.0, e) END)
SELECT run, {r('x', 9)} AS x, pow(10.0, e) AS factor, prefix FROM m WHERE i = 1""")
def si_pairs(t):
    x = t.select("run", ((F.col("q") - 25) * F.pow(F.lit(10.0), 2 * F.col("run") - 8)).alias("x")).distinct()
    return x.select("run", (F.round("x", 9) + F.lit(0.0)).alias("x"), parse.si_pair(F.col("x")).alias("s")).select("run", "x", "s.factor", "s.prefix")


@query("trials", f"""
, m AS (SELECT run, atan2(avg(sin(phase)), avg(cos(phase))) AS a, atan2(avg(sin(v)), avg(cos(v))) AS b FROM trials WHERE run IS NOT NULL GROUP BY run), d AS (SELECT run, sin(phase - a) AS x, sin(v - b) AS y FROM trials JOIN m USING (run)),
q AS (SELECT run, sum(x * y) / sqrt(sum(x * x) * sum(y * y)) AS rho, sqrt(count(*) * avg(x * x) * avg(y * y) / avg(x * x * y * y)) AS w FROM d GROUP BY run), e AS (SELECT run, rho, least(abs(w * rho), 10) AS z FROM q)
SELECT run, {r('rho')} AS rho, {r(f'CASE WHEN z >= 10 THEN 0 ELSE {_NORMAL_P} END')} AS p FROM e""")
def circular_correlations(t):
    return rounded(designs.circular_correlation_p(t, ["run"], "phase", "v"))


# two factors in turn, the second of two levels: its sum of squares after the first one's is that of the weighted differences


def _two_way(interaction: bool) -> str:
    rest, rest_dof = ("ssw", "n - 6") if interaction else ("ssw + ssi", "n - 4")
    total = "ssa + ssb + ssi + ssw"
    rows = " UNION ALL ".join(f"SELECT dataset, '{name}' AS factor, {ss} AS ss, {dof} AS dof, {rest} AS rest, {rest_dof} AS rest_dof, {total} AS total FROM s" for name, ss, dof in [("a", "ssa", 2), ("b", "ssb", 1)] + ([("a:b", "ssi", 2)] if interaction else []) + [("residual", rest, rest_dof)])
    return f"""
, d AS (SELECT dataset, run % 3 AS a, roi % 2 AS b, CAST(q AS DOUBLE) AS q FROM stats), c AS (SELECT dataset, a, b, count(*) AS n, avg(q) AS m, var_pop(q) AS v FROM d GROUP BY ALL), g AS (SELECT dataset, avg(q) AS g, count(*) AS n, var_pop(q) * count(*) AS sst FROM d GROUP BY dataset),
ma AS (SELECT dataset, a, avg(q) AS ma, count(*) AS na FROM d GROUP BY ALL), sa AS (SELECT dataset, sum(na * (ma - g) * (ma - g)) AS ssa FROM ma JOIN g USING (dataset) GROUP BY dataset), w AS (SELECT dataset, sum(n * v) AS ssw FROM c GROUP BY dataset),
p AS (SELECT x.dataset, x.n * y.n / (x.n + y.n)::DOUBLE AS w, x.m - y.m AS d FROM c x JOIN c y ON y.dataset = x.dataset AND y.a = x.a AND x.b = 0 AND y.b = 1), sb AS (SELECT dataset, sum(w * d) ** 2 / sum(w) AS ssb FROM p GROUP BY dataset),
s AS (SELECT dataset, ssa, ssb, sst - ssa - ssb - ssw AS ssi, ssw, g.n AS n FROM g JOIN sa USING (dataset) JOIN sb USING (dataset) JOIN w USING (dataset)),
r AS (SELECT dataset, factor, ss, CAST(dof AS BIGINT) AS k, rest, CAST(rest_dof AS BIGINT) AS dof, total, CASE WHEN factor <> 'residual' THEN ss / dof / (rest / rest_dof) END AS f FROM ({rows})), u AS (SELECT *, sqrt(f) AS t FROM r)
SELECT dataset, factor, {r('ss', 3)} AS ss, k AS dof, {r('f', 4)} AS f, {r(f'CASE WHEN f IS NULL THEN NULL WHEN k = 2 THEN pow(1 + 2 * f / dof, -dof / 2.0) ELSE {_T_P} END', 5)} AS p,
  {r("CASE WHEN f IS NOT NULL THEN ss / total END")} AS eta2, {r("CASE WHEN f IS NOT NULL THEN (ss - k * rest / dof) / (ss + k * rest / dof + rest / dof) END")} AS omega2 FROM u"""


def _two_way_table(t, interaction: bool):
    d = t.select("dataset", (F.col("run") % 3).alias("a"), (F.col("roi") % 2).alias("b"), "q")
    out = designs.two_way_anova(d, ["dataset"], "a", "b", "q", interaction=interaction)
    return rounded(out.withColumns({"ss": F.round("ss", 3), "f": F.round("f", 4), "p": F.round("p", 5)}))


@query("stats", _two_way(True))
def two_way_variance(t):
    return _two_way_table(t, True)


@query("stats", _two_way(False))
def two_way_effects(t):
    return _two_way_table(t, False)


# a second-order low pass, forwards and backwards over the trace with its ends turned about


def _pass(x: str) -> str:
    """One section over the list ``x`` from the steady state of its first value; the state is two numbers before the output."""
    start = f"[(b1 - a1) * {x}[1] + (b2 - a2) * {x}[1], (b2 - a2) * {x}[1]]"
    return f"list_reduce(list_concat([{start}], list_transform({x}, lambda v: [v])), lambda s, e: list_concat([b1 * e[1] - a1 * (b0 * e[1] + s[1]) + s[2], b2 * e[1] - a2 * (b0 * e[1] + s[1])], list_concat(s[3:], [b0 * e[1] + s[1]])))[3:]"


@query("flat", f"""
, k AS (SELECT tan(pi() * 0.5 / 3.56) AS k), n AS (SELECT k, 1 / (1 + k * sqrt(2.0) + k * k) AS n FROM k), c AS (SELECT k * k * n AS b0, 2 * k * k * n AS b1, k * k * n AS b2, 2 * (k * k - 1) * n AS a1, (1 - k * sqrt(2.0) + k * k) * n AS a2 FROM n),
y AS (SELECT dataset, roi, list(v ORDER BY frame) AS y FROM flat GROUP BY ALL),
x AS (SELECT dataset, roi, list_concat(list_transform(range(0, 9), lambda i: 2 * y[1] - y[10 - i]), list_concat(y, list_transform(range(0, 9), lambda i: 2 * y[64] - y[63 - i]))) AS x, c.* FROM y, c),
f AS (SELECT * REPLACE (list_reverse({_pass('x')}) AS x) FROM x), g AS (SELECT dataset, roi, list_reverse({_pass('x')}) AS x FROM f)
SELECT dataset, roi, CAST(i AS INT) AS frame, {r('x[i + 10]')} AS v FROM (SELECT *, unnest(range(0, 64)) AS i FROM g)""")
def low_passed(t):
    return rounded(kernels.zero_phase_filter(t, UNIT, "v", 3.56, 0.5))
