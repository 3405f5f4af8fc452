"""Embedding links against all pairs; components against a plain search."""

import random

import numpy as np
import pytest

from tracelake.llm import embedding_dedup
from tracelake.llm.components import connected_components


def plain_components(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(4)
    links = [(i, i + 1) for i in range(100, 160)] + [(7, x) for x in range(200, 400)] + [(rng.randrange(500, 900), rng.randrange(500, 900)) for _ in range(250)] + [(3, 3)]
    nodes = {x for a, b in links if a != b for x in (a, b)}
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == plain_components(nodes, [x for x in links if x[0] != x[1]])
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute(rows, threshold=0.98):
    ok = [i for i, (_, v, label) in enumerate(rows) if label is not None and v and None not in v and np.isfinite(v).all() and np.linalg.norm(v) > 0]
    links = []
    for x, i in enumerate(ok):
        for j in ok[x + 1 :]:
            a, b = np.array(rows[i][1], np.float32).astype(float), np.array(rows[j][1], np.float32).astype(float)
            if rows[i][2] == rows[j][2] and len(a) == len(b) and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= threshold:
                links.append((i, j))
    roots = plain_components(range(len(rows)), links)
    n = [0] * len(rows)
    for a, b in links:
        n[a] += 1
        n[b] += 1
    out = []
    for i, (vec_id, _, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if roots[j] == roots[i] and rows[j][0] is not None]
        component = min(ids) if ids else None
        out.append((vec_id, n[i], component, vec_id == component))
    return sorted(out, key=repr)


@pytest.mark.parametrize("small", [32, 4])
def test_links_equal_all_pairs(spark, monkeypatch, small):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 16)
    monkeypatch.setattr(embedding_dedup, "SMALL", small)
    rng = np.random.default_rng(1)
    rows = []
    for k in range(300):
        base = rng.standard_normal(64)
        for _ in range(rng.integers(1, 4)):
            rows.append((len(rows), (base + rng.standard_normal(64) * rng.choice([0.0, 0.05, 0.14, 0.2])).tolist(), k % 3))
    hub = rng.standard_normal(64)
    rows += [(len(rows) + i, (hub + rng.standard_normal(64) * 0.13).tolist(), 1) for i in range(90)]
    rows += [(5000 + i, hub.tolist(), 1) for i in range(40)]
    rows += [(6000, None, 1), (6001, [], 1), (6002, [0.0] * 64, 1), (6003, hub.tolist(), None), (6004, [float("nan")] * 64, 1), (6005, [None] * 64, 1), (None, hub.tolist(), 1),
             (None, [1.0, 2.0], 2), (5000, hub.tolist(), 1), (6006, (hub * 7).tolist(), 1), (6007, (-hub).tolist(), 1), (6008, [2.0, 4.0], 2), (6009, [float("inf")] * 64, 1)]
    frame = spark.createDataFrame([(a, b, c, "x") for a, b, c in rows], "vec_id long, embedding array<float>, label int, n_links string")
    got = sorted((tuple(r) for r in embedding_dedup.link_embeddings(frame).collect()), key=repr)
    want = brute(rows)
    assert got == want
    assert embedding_dedup.link_embeddings(frame.limit(0)).count() == 0


def test_extreme_lengths(spark):
    """Only the direction counts, however long or short a vector is."""
    rows = [(1, [1e200, 1e200], 1), (2, [1e200, 1e200], 1), (3, [1e-200, 1.1e-200], 1), (4, [3e-320, 3e-320], 1), (5, [1.0, -1.0], 1), (6, [1e308, 1e308], 1), (7, [0.0, -0.0], 1)]
    got = embedding_dedup.link_embeddings(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got.collect()) == [(1, 4, 1), (2, 4, 1), (3, 4, 1), (4, 4, 1), (5, 0, 5), (6, 4, 1), (7, 0, 7)]
