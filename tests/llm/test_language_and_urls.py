"""Language identification by held-out accuracy, URL lists against a plain replay."""

import random

import pytest
from pyspark.sql import functions as F

from tracelake.llm import language_id, url_filter
from tracelake.llm.queries import op2_language_id

WORDS = {"en": "the of and house river where under with".split(), "de": "der die und häuser fluß wo unter mit".split(), "fr": "le la et maison rivière où sous avec".split()}


def docs_frame(spark, n=240):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(WORDS[lang]) for _ in range(rng.randrange(3, 60))), lang, i) for i in range(n) for lang in [rng.choice(sorted(WORDS))]]
    rows += [(1000, None, "en", 0), (1001, "", "de", 0), (1002, "123 !!! \n", "fr", 0), (1003, "the house " * 20_000, None, 0), (None, "der und", "de", 0), (1004, "la maison", "fr", 0), (1004, "la maison", "fr", 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score long")


def test_language_id(spark):
    docs = docs_frame(spark)
    held_out = F.col("doc_id") % 4 == 2
    model = language_id.train(docs, ~F.coalesce(held_out, F.lit(False)))
    assert model.languages == ["de", "en", "fr"] and model.temperature > 0
    assert (model.weights == 0).mean() > 0.5  # sparse
    rows = language_id.predict(docs, model).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    test = [r for r in rows if r.doc_id is not None and r.doc_id < 1000 and r.doc_id % 4 == 2]
    assert sum(r.lang == r.lang_pred for r in test) > 0.95 * len(test)
    by_id = {r.doc_id: r for r in rows}
    assert all(by_id[i].lang_pred == "und" and by_id[i].score == 0 for i in (1000, 1001, 1002))
    assert by_id[1003].lang_pred == "en" and by_id[None].lang_pred == "de"
    again = language_id.predict(docs.repartition(3), language_id.train(docs.repartition(5), ~F.coalesce(held_out, F.lit(False)))).collect()
    assert {(r.doc_id, r.text, r.lang_pred, round(r.score, 9)) for r in again} == {(r.doc_id, r.text, r.lang_pred, round(r.score, 9)) for r in rows}


def test_language_id_learns_nothing(spark):
    docs = docs_frame(spark)
    assert language_id.train(docs, F.lit(False)) is None
    assert {r.lang_pred for r in language_id.predict(docs, None).collect()} == {"und"}
    assert language_id.predict(docs.limit(0), None).count() == 0


def test_held_out_accuracy_of_the_query(spark):
    rows = op2_language_id(spark, "/root/testdata/sf0.001").join(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out and lang is not null").collect()
    assert sum(r.lang == r.lang_pred for r in rows) > 0.9 * len(rows)


ENTRIES = [
    ("spam", "block", "bad.org", "add", 10), ("spam", "block", "bad.org", "add", 12), ("spam", "block", "bad.org", "remove", 20), ("spam", "block", "bad.org", "add", 30),
    ("spam", "block", "bad.org", "add", 40), ("spam", "block", "bad.org", "remove", 40), ("ok", "allow", "bad.org/good", "add", 15), ("ok", "allow", "a.com", "add", 5),
    ("evil", "block", "a.com", "add", 6), ("evil", "block", "x.a.com", "remove", 1), (None, "block", "a.com", "add", 1), ("evil", "block", None, "add", 1), ("evil", "block", "a.com/p/q", "add", None),
    ("deep", "block", "a.com/p/q", "add", 8), ("spam", "block", "bad.org", "add", 10),
]
URLS = [
    "http://bad.org", "https://WWW.bad.org./x", "http://u:p@bad.org:80/good/1?q#f", "http://bad.org/goodness", "http://a.com/p/q/r", "http://b.a.com/p/q", "http://a.com//p//q", "http://notbad.org/",
    "nothing", "", None, "http://", "http://com", "http://a.com/" + "p/" * 20_000, "ftp://x.a.com?bad.org",
]


def replay(url, day, entries):
    """(verdict, list, pattern, active)"""
    import re

    m = re.match(r"[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", url or "")
    if not m or day is None:
        return ("unlisted", None, None, 0)
    host = re.sub(r"\.$", "", m[1]).lower()
    path = re.match(r"[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^?#]*)", url)
    segments = [s for s in (path[1] if path else "").split("/") if s]
    active = {}
    for lst, effect, pattern, action, at in sorted((e for e in entries if None not in (e[0], e[2], e[4])), key=lambda e: (e[4], e[3] == "remove")):
        if at <= day:
            active[lst, pattern] = (action == "add", effect)
    hits = []
    for (lst, pattern), (on, effect) in active.items():
        if on and (host == pattern or host.endswith("." + pattern) or ("/" in pattern and ("/".join([host, *segments]) + "/").startswith(pattern + "/"))):
            hits.append((-len(pattern), effect != "allow", lst, pattern, effect))
    if not hits:
        return ("unlisted", None, None, 0)
    best = min(hits)
    return ("allowed" if best[4] == "allow" else "blocked", best[2], best[3], len(hits))


@pytest.mark.parametrize("limit", [100_000, 0])
def test_url_lists(spark, monkeypatch, limit):
    monkeypatch.setattr(url_filter, "BROADCAST_INTERVALS", limit)
    captures = [(k, u, d) for k, (u, d) in enumerate((u, d) for u in URLS for d in (None, 0, 5, 8, 10, 15, 19, 20, 35, 45))]
    captures += captures[:30]
    entries = spark.createDataFrame(ENTRIES, "list string, effect string, pattern string, action string, day int")
    frame = spark.createDataFrame([(*c, "x") for c in captures], "page_id int, url string, day int, list string")
    got = url_filter.judge_captures(frame, entries).collect()
    want = [(k, *replay(u, d, ENTRIES)) for k, u, d in captures]
    assert sorted(((r.page_id, r.verdict, r.by_list, r.by_pattern, r.n_active) for r in got), key=repr) == sorted(want, key=repr)
    assert {r.verdict for r in url_filter.judge_captures(frame, entries.limit(0)).collect()} == {"unlisted"}
    assert url_filter.judge_captures(frame.limit(0), entries).count() == 0


def test_columns_of_any_name(spark):
    """Names that clash with work columns, and names with dots, pass through."""
    days = spark.createDataFrame([("http://bad.org", 11, "x", "y", "z", "w")], "url string, day int, n string, best string, `__url` string, `a.b` string")
    lists = spark.createDataFrame([("spam", "block", "bad.org", "add", 10)], "list string, effect string, pattern string, action string, day int")
    row = url_filter.judge_captures(days, lists).first().asDict()
    assert {k: row[k] for k in ("url", "day", "n", "best", "__url", "a.b", "verdict", "n_active")} == {"url": "http://bad.org", "day": 11, "n": "x", "best": "y", "__url": "z", "a.b": "w", "verdict": "blocked", "n_active": 1}
    docs = spark.createDataFrame([(1, "the house", "x", "y")], "doc_id long, text string, `a.b` string, lang_pred string")
    out = language_id.predict(docs, None)
    assert out.columns == ["doc_id", "text", "a.b", "lang_pred", "score"] and out.first()["a.b"] == "x"
