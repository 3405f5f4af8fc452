"""Near-duplicates against all pairs under an independent similarity."""

import random
import re
from collections import Counter

import pandas as pd
import pytest

from tests.llm.test_embeddings import plain_components
from tracelake.llm import near_dedup
from tracelake.llm.common import Scratch
from tracelake.llm.near_dedup import alike, labels, loaded, similarity, sketch, stored, word_codes


def plain_similarity(one, two):
    """Aligned share of two word lists by the full table."""
    row = [0] * (len(two) + 1)
    for x in one:
        last = row
        row = [0]
        for j, y in enumerate(two):
            row.append(last[j] + 1 if x == y else max(last[j + 1], row[j]))
    return row[-1] / (len(one) + len(two) - row[-1])


def test_similarity_of_edits():
    rng = random.Random(1)
    words = [f"w{rng.randrange(400)}" for _ in range(300)]
    code = lambda w: word_codes(" ".join(w).encode())
    a = code(words)
    assert similarity(a, a) == 1 and len(set(labels(a).tolist())) == len(labels(a)) == 296
    changed = words[:100] + ["new"] + words[101:]
    assert similarity(a, code(changed)) == pytest.approx(299 / 301)
    assert similarity(a, code(words[150:] + words[:150])) == 0  # order counts
    assert similarity(a, code(["a", "b"])) == 0 and similarity(a, a[:0]) == 0
    assert (sketch(labels(a)) == sketch(labels(code(changed)))).sum() > 20


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(rows):
    """(id, class id) by all pairs, under the plain similarity; pairs with too few words in common are skipped."""
    texts = sorted({t or "" for _, t in rows})
    own = [words_of(t) for t in texts]
    bags = [Counter(w) for w in own]

    def alike(i, j):
        n = len(own[i]) + len(own[j])
        if own[i] == own[j]:
            return bool(own[i])
        if min(len(own[i]), len(own[j])) * 1.8 < 0.8 * n or (bags[i] & bags[j]).total() * 1.8 < 0.8 * n:
            return False
        return plain_similarity(own[i], own[j]) >= 0.8

    roots = plain_components(range(len(texts)), [(i, j) for i in range(len(texts)) for j in range(i) if alike(i, j)])
    at = {t: roots[k] for k, t in enumerate(texts)}
    best = {}
    for i, t in rows:
        r = at[t or ""]
        best[r] = min(best.get(r, (True, 0)), (i is None, i or 0))
    return sorted(((i, None if best[at[t or ""]][0] else best[at[t or ""]][1]) for i, t in rows), key=repr)


def planted(seed):
    rng = random.Random(seed)
    rows, passage = [], " ".join(f"p{k}" for k in range(60))
    for k in range(80):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([3, 8, 40, 120]))]
        if k % 4 == 0:
            base[len(base) // 2 : len(base) // 2] = passage.split()
        rows.append((len(rows), " ".join(base)))
        for _ in range(rng.choice([0, 0, 1, 3])):
            edited = [w if rng.random() > rng.choice([0.005, 0.02]) else "edit" for w in base]
            rows.append((len(rows), " ".join(edited)))
    base = [f"h{rng.randrange(5000)}" for _ in range(70)]
    for _ in range(60):
        edited = list(base)
        for _ in range(2):
            edited[rng.randrange(70)] = f"e{rng.randrange(10**6)}"
        rows.append((len(rows), " ".join(edited)))
    rng.shuffle(rows)
    rows += [(9000, None), (9001, ""), (9002, "!!!"), (9003, "???"), (9004, "!!!"), (9005, "A b, C"), (9006, "a B c"), (None, "a b c"), (None, "lonely null text here now ok"), (9007, "x " * 20_000)]
    return rows + rows[:12]


@pytest.mark.parametrize("strangers,members", [(256, 1024), (3, 7)])
def test_near_duplicates(spark, monkeypatch, strangers, members):
    monkeypatch.setattr(near_dedup, "STRANGERS", strangers)
    monkeypatch.setattr(near_dedup, "MEMBERS", members)
    rows = planted(strangers)
    docs = spark.createDataFrame([(i, t, "x", "y", "z", 1) for i, t in rows], "doc_id long, text string, class_id string, kept string, row string, __part int")
    found = near_dedup.near_duplicates(docs).collect()
    got, want = Counter((r.doc_id, r.class_id) for r in found), Counter(brute(rows))
    # short texts with several edits may share no table; nothing else may differ, and no class may be too large
    assert Counter(i for i, _ in got.elements()) == Counter(i for i, _ in rows) and (got & want).total() >= 0.98 * len(rows)
    own = dict(want.keys())
    assert all(own[c] == own[i] for i, c in got if c is not None and i is not None)
    classes = {}
    for r in found:
        classes[r.class_id] = classes.get(r.class_id, 0) + r.kept
    assert all(n == 1 for c, n in classes.items() if c is not None)
    kept = near_dedup.keep_one(docs)
    assert kept.count() == sum(r.kept for r in found) and kept.columns == docs.columns
    assert near_dedup.near_duplicates(docs.limit(0)).count() == 0


def test_grid_links_components_of_strangers():
    rng = random.Random(4)
    base = [[f"{k}v{rng.randrange(99)}" for _ in range(60)] for k in range(4)]
    texts = [[w if rng.random() > 0.03 else "e" for w in base[k % 4]] for k in range(40)] + [["x"], ["x"] * 7]
    rows = [(k, k, int(k % 4 != 0), as_stranger) for k in range(42) for as_stranger in (False, True) if not as_stranger or k % 4]
    pdf = pd.DataFrame(rows, columns=["cid", "root", "stranger", "as_stranger"]).assign(codes=lambda d: [stored(word_codes(" ".join(texts[c]).encode())) for c in d.cid])
    links = [tuple(x) for x in near_dedup.check_grid(pdf, 0.8).itertuples(index=False)]
    roots = plain_components(range(42), links + [(a, b) for a in range(0, 40, 4) for b in range(0, a, 4)])
    want = [(a, b) for a in range(42) for b in range(a) if plain_similarity(texts[a], texts[b]) >= 0.8]
    assert want and roots == plain_components(range(42), want + [(a, b) for a in range(0, 40, 4) for b in range(0, a, 4)])
    assert all(plain_similarity(texts[a], texts[b]) >= 0.8 for a, b in links)


def test_row_numbers_stay_when_files_are_dealt_anew(spark):
    rows = planted(3)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    table = Scratch(spark).write(near_dedup._sketch_rows(docs, "doc_id", "text").select("rid", "wkey"), "t")
    seen = {(r.rid, bytes(r.wkey)) for r in table.collect()}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    try:
        assert {(r.rid, bytes(r.wkey)) for r in table.collect()} == seen and len({r for r, _ in seen}) == len(rows)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def repetitive():
    """Pairs of a text that repeats a passage and an edited copy of it."""
    rng = random.Random(5)
    passage = [f"w{k}" for k in range(100)]
    base = passage * 10
    yield base, [f"e{k}" if k in (10, 30, 50, 70, 90) else w for k, w in enumerate(base)]
    line = [f"l{k}" for k in range(10)] * 100
    yield line, line[:4] + ["new"] + line[5:]
    yield line, line[10:]
    for _ in range(40):
        few = [[f"v{rng.randrange(40)}" for _ in range(rng.randrange(3, 25))] for _ in range(3)]
        words = [w for _ in range(rng.randrange(3, 25)) for w in rng.choice(few)]
        share = rng.choice([0.01, 0.03, 0.06, 0.15])
        yield words + ["x"] * 5, [w if rng.random() > share else f"e{rng.randrange(9)}" for w in words if rng.random() > share / 3] + ["x"] * rng.randrange(5, 9)


@pytest.mark.parametrize("window", [1024, 7])
def test_alignment_equals_a_plain_longest_common_subsequence(monkeypatch, window):
    monkeypatch.setattr(near_dedup, "ROWS", window)
    found = []
    for one, two in repetitive():
        want = plain_similarity(one, two)
        a, b = (word_codes(" ".join(x).encode()) for x in (one, two))
        found.append(similarity(a, b))
        assert found[-1] == similarity(b, a) == pytest.approx(want if want >= 0.8 else 0)
    assert found[0] == pytest.approx(995 / 1005) and 0 in found and any(0.8 <= x < 0.9 for x in found)


def test_edit_rates_that_are_caught(spark):
    """Copies with a twentieth of their words replaced are found, most with a tenth; unlike texts that share a passage are left alone."""
    rng = random.Random(6)
    rows, copies = [], []
    for k in range(120):
        base = [f"w{rng.randrange(20000)}" for _ in range(rng.choice([60, 150, 400]))]
        spots = set(rng.sample(range(len(base)), int(len(base) * (0.1 if k % 3 == 0 else rng.choice([0.02, 0.05])))))
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(f"e{rng.randrange(20000)}" if i in spots else w for i, w in enumerate(base)))]
        copies.append((2 * k, 2 * k + 1, k % 3 == 0))
    passage = [f"p{k}" for k in range(60)]
    clean = [(1000 + k, " ".join([*passage, *(f"c{rng.randrange(20000)}" for _ in range(40))])) for k in range(60)]
    found = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows + clean, "doc_id long, text string")).collect()}
    caught = {far: [found[a] == found[b] for a, b, f in copies if f == far] for far in (False, True)}
    assert sum(caught[False]) >= 0.95 * len(caught[False]) and sum(caught[True]) >= 0.4 * len(caught[True])
    assert all(found[i] == i for i, _ in clean)


def test_edited_copies_of_repetitive_texts_are_found(spark):
    pairs = list(repetitive())[:2]
    docs = spark.createDataFrame([(2 * k + side, " ".join(w)) for k, p in enumerate(pairs) for side, w in enumerate(p)], "doc_id long, text string")
    found = near_dedup.near_duplicates(docs).collect()
    assert sorted((r.doc_id, r.class_id) for r in found) == [(0, 0), (1, 0), (2, 2), (3, 2)]


def test_words_of_one_crc_are_different(spark):
    """"plumless" and "buckeroo" have one CRC-32: texts of them are no copies, and a short text still meets its longer near copy."""
    long = [f"word{k}" for k in range(16)]
    rows = [(1, "plumless"), (2, "buckeroo"), (3, "plumless plumless"), (4, "buckeroo buckeroo"), (5, "Plumless"), (6, " ".join(long)), (7, " ".join([*long, "new"])), (8, " ".join(long[:-1] + ["plumless"])), (9, " ".join(long[:-1] + ["buckeroo"]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(docs).collect()}
    assert got[1] == got[5] == 1 and got[2] == 2 and got[3] == 3 and got[4] == 4 and got[6] == got[7] == 6
    a, b = (loaded(stored(word_codes(w))) for w in (b"plumless", b"buckeroo"))
    assert (a.astype("uint32") == b.astype("uint32")).all() and (a != b).all() and alike(a, b, 0.8) == 0.0
