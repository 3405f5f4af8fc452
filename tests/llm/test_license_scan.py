"""Licence scans against plain searches of every phrase and template at every place."""

import re

import numpy as np
import pytest

from tests.llm.test_queries import SF, documents
from tracelake.llm import license_scan, queries

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def plain_words(text):
    return WORD.findall((text or "").translate(LOWER))


def places(words, phrase):
    phrase = phrase.split()
    return [i for i in range(len(words) - len(phrase) + 1) if words[i : i + len(phrase)] == phrase]


def plain_base(text):
    words = plain_words(text)
    hits = [(i, label) for label, phrase in license_scan.BASE for i in places(words, phrase)]
    starts = [i for i, _ in hits]
    return len(words), len(hits), min(starts, default=None), max(starts, default=None), sorted({a for _, a in hits})


def plain_notices(text, idf):
    """Labels and best share of the notices, trying every start."""
    words, out = plain_words(text), {}
    for label, notice, keys in license_scan.NOTICES:
        own = plain_words(notice)
        drift = max(2, len(own) // 10)
        rarest = sorted(set(own), key=lambda w: (-idf[w], w))[: license_scan.NOTICE_ANCHORS]

        def share(pairs, d):
            near = sum(idf[w] for w, p in pairs if w in words[max(0, d + p - drift) : max(0, d + p + drift + 1)])
            return near / sum(idf[w] for w, _ in pairs)

        for d in range(-len(own), len(words)):
            if not any(0 <= d + own.index(w) < len(words) and words[d + own.index(w)] == w for w in rarest):
                continue
            s = share([(w, p) for p, w in enumerate(own)], d)
            named = all(any(d - drift <= i <= d + len(own) + drift for i in places(words, k)) for k in keys)
            if share([(w, own.index(w)) for w in rarest], d) >= 0.5 and s >= license_scan.MIN_SHARE and named:
                out[label] = max(out.get(label, 0), s)
    return out


def weights(texts):
    sets = [set(plain_words(t)) for t in texts]
    return {w: np.log((len(texts) + 1) / (sum(w in s for s in sets) + 0.5)) for w in license_scan.VOCABULARY}


def check(texts, rows, to_list):
    idf = weights(texts)
    for text, r in zip(texts, rows, strict=True):
        assert (r.n_words, r.n_base, r.first_word, r.last_word, to_list(r.base_labels)) == plain_base(text)
        words, shares = plain_words(text), plain_notices(text, idf)
        names = {a for a, phrase in [*license_scan.BASE, *license_scan.NAMES] if places(words, phrase)}
        assert to_list(r.labels) == sorted(names | set(shares))
        assert r.score == pytest.approx(1.0 if names else max(shares.values(), default=0.0))


def test_query_equals_plain_rules(spark):
    docs = {i: t for i, t, _ in documents()}
    got = sorted(queries.op12_license_scan(spark, SF).collect(), key=lambda r: r.doc_id)
    check([docs[r.doc_id] for r in got], got, lambda s: s.split(",") if s else [])
    assert any(r.n_base for r in got)


MIT = dict((a, b) for a, b, _ in license_scan.NOTICES)["mit"]
TEXTS = [
    None, "", "no licence", "mit mit mit license license mit License", "CC BY", "cc-by-nc 4.0 and CC BY-SA", "ccby cc  by", "é mit license mité license x mit license",
    MIT, MIT.upper(), MIT.replace("without restriction", "with restriction"), "Copyright X. " + MIT.replace("and associated", "and all the associated").replace("to whom", "to anyone whom") + " gnu general public license",
    " ".join(MIT.split()[20:40]), "word " * 300_000 + MIT + " word" * 10 + " apache license", MIT + " " + MIT, " ".join(reversed(MIT.split())), "der mit dem hut " * 50, "gnu general public", "license mit",
    *(b for _, b, _ in license_scan.NOTICES), "apache license, version 2.0", "Redistribution and use in source and binary forms",
]


def test_odd_texts(spark, monkeypatch):
    monkeypatch.setattr(license_scan, "BLOCK", 64)
    frame = spark.createDataFrame([(i if i else None, t, "x", 1) for i, t in enumerate(TEXTS)], "`a.b` int, text string, labels string, n_words int").coalesce(1)
    got = license_scan.scan_licenses(frame, id_col="a.b").collect()
    texts = [t if t is None or len(t) < 100_000 else None for t in TEXTS]
    long = next(i for i, t in enumerate(TEXTS) if t and len(t) >= 100_000)
    idf = weights(TEXTS)
    for i, r in enumerate(got):
        if i != long:
            n, n_base, first, last, base = plain_base(texts[i])
            assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (n, n_base, first, last, base)
            names = {a for a, p in [*license_scan.BASE, *license_scan.NAMES] if places(plain_words(texts[i]), p)}
            assert r.labels == sorted(names | set(plain_notices(texts[i], idf)))
    n = len(plain_words(MIT))
    assert (got[long].n_words, got[long].first_word, got[long].labels) == (300_000 + n + 12, 300_000 + n + 10, ["apache", "mit"])
    twice = got[TEXTS.index(MIT + " " + MIT)]
    assert [(c.label, c.start, c.share) for c in twice.found] == [("mit", 0, pytest.approx(1)), ("mit", n, pytest.approx(1))]
    assert got[TEXTS.index(MIT)].n_base == 0 and got[TEXTS.index(MIT)].labels == ["mit"] and got[TEXTS.index(MIT.replace("without restriction", "with restriction"))].labels == []
    assert got[0]["a.b"] is None and license_scan.scan_licenses(frame.limit(0), id_col="a.b").count() == 0


@pytest.mark.parametrize("raw", [b"", b"a", b"mit license " * 1000, "é".encode() * 500 + b" mit"])
def test_blocks_cut_between_words(raw, monkeypatch):
    whole = license_scan.word_numbers(raw)
    for block in (1, 7, 100):
        monkeypatch.setattr(license_scan, "BLOCK", block)
        assert license_scan.word_numbers(raw).tolist() == whole.tolist()
