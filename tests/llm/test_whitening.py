"""Whitening against numpy's eigenvalues and exact integer sums."""

import math
from fractions import Fraction

import numpy as np
import pyarrow.parquet as pq
import pytest

from tracelake.llm import queries, whitening


@pytest.mark.parametrize("n", [1, 2, 3, 5, 20, 64, 130])
@pytest.mark.parametrize("kind", ["full", "half", "equal", "rank_one", "close", "tiny"])
def test_components(n, kind):
    rng = np.random.default_rng(n)
    x = rng.standard_normal((n + 5, n))
    if kind == "half":
        x[:, : n // 2] = 0
    if kind == "equal":
        x = np.eye(n) * 3
    if kind == "rank_one":
        x = np.repeat(x[:, :1], n, 1)
    if kind == "close":
        x = np.vstack([np.eye(n)] * 3) + 1e-9 * rng.standard_normal((3 * n, n))
    a = x.T @ x * (1e-200 if kind == "tiny" else 1)
    k, size = min(16, n), np.abs(a).max()
    values, axes = whitening.leading_components(a, k)
    assert np.allclose(values, np.linalg.eigvalsh(a)[::-1][:k], rtol=0, atol=1e-13 * n * size)
    assert np.abs(axes @ axes.T - np.eye(k)).max() < 1e-13
    assert np.abs(a @ axes.T - axes.T * values).max() < 1e-13 * n * size


def brute(rows, k):
    """By place: (n, deviation, |whitened|, explained, identity error) as plain rules say."""
    x = [None if v is None or any(c is None or not math.isfinite(c) for c in v) else tuple(math.floor(64 * c) + 1_000_000 for c in v) for v in rows]
    fit = sorted({v for v in x if v is not None})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    centred = np.array([[float(Fraction(n * c - s, n)) for c, s in zip(v, sums, strict=True)] for v in fit])
    cov = centred.T @ centred / n
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1][:k], axes.T[::-1][:k]
    out = []
    for v in x:
        if v is not None:
            c = np.array([float(Fraction(n * a - s, n)) for a, s in zip(v, sums, strict=True)])
            out.append((n, sum((n * a - s) ** 2 for a, s in zip(v, sums, strict=True)), np.abs(axes @ c) / np.sqrt(values), values / np.trace(cov)))
        else:
            out.append(None)
    return out


def test_query_equals_plain_rules(spark):
    table = pq.read_table("/root/testdata/sf0.001/embeddings.parquet").to_pydict()
    want = dict(zip(table["vec_id"], brute(table["embedding"], 16), strict=True))
    got = queries.op11_whitening(spark, "/root/testdata/sf0.001").collect()
    assert len(got) == 16 * sum(w is not None for w in want.values())
    signs = {}
    for r in got:
        n, deviation, white, share = want[r.vec_id]
        assert (r.n, r.deviation) == (n, deviation)
        assert abs(r.whitened) == pytest.approx(white[r.component - 1], abs=1e-9)
        assert r.explained == pytest.approx(share[r.component - 1], rel=1e-9)
        assert r.identity_error < 1e-9
        signs.setdefault(r.component, []).append(r.whitened)
    assert sorted(signs) == list(range(1, 17))
    assert all(min(s) < 0 < max(s) for s in signs.values())


def test_odd_rows(spark):
    rng = np.random.default_rng(3)
    base = [rng.standard_normal(5).tolist() for _ in range(40)]
    rows = list(enumerate(base)) + [(100, base[0]), (100, base[0]), (None, base[1]), (101, None), (102, []), (103, [None] * 5), (104, [math.nan] * 5), (105, [1.0, math.inf, 0.0, 0.0, 0.0])]
    rows += [(200, [7.0, 7.0]), (201, [7.0, 7.0]), (202, [1e17]), (203, [-3e13]), (204, [2e13]), (205, [1e12])]
    frame = spark.createDataFrame([(i, v, "x", 1.5) for i, v in rows], "`a.b` long, embedding array<double>, whitened string, n double")
    got = whitening.whiten(frame, id_col="a.b", components=3).collect()
    of_base = [r for r in got if len(r.whitened) == 3]
    want = [w for (i, v), w in zip(rows, brute([v if v and len(v) == 5 else None for _, v in rows], 3), strict=True) if w]
    key = lambda x: (x[0], [round(c, 6) for c in x[1]])
    mine = sorted(((int(r.deviation), np.abs(r.whitened).tolist()) for r in of_base), key=key)
    plain = sorted(((w[1], w[2].tolist()) for w in want), key=key)
    assert [m[0] for m in mine] == [p[0] for p in plain]
    assert np.allclose([m[1] for m in mine], [p[1] for p in plain], atol=1e-9)
    assert {r.n for r in of_base} == {40} and sum(r["a.b"] == 100 for r in of_base) == 2 and sum(r["a.b"] is None for r in of_base) == 1
    flat = {r["a.b"]: r for r in got if r["a.b"] in (200, 201, 203, 204, 205)}
    assert flat[200].n == 1 and flat[200].whitened == [None, None] and flat[200].identity_error is None and int(flat[201].deviation) == 0
    grid = {i: math.floor(64 * v[0]) for i, v in rows if i in (203, 204, 205)}
    assert {i: int(flat[i].deviation) for i in grid} == {i: (3 * g - sum(grid.values())) ** 2 for i, g in grid.items()}
    assert 202 not in {r["a.b"] for r in got}
    assert whitening.whiten(frame.limit(0), id_col="a.b").count() == 0
