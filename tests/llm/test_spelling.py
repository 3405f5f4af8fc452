"""Spelling variants against counts and neighbours by plain rules."""

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from tests.llm.test_queries import SF, documents
from tracelake.llm import queries, spelling

LOWER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    a, b = sorted((a, b), key=len)
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def plain(rows):
    """(word, form, root, n, n_near, form_n) by plain rules: words that share a word with one code point less, or blanked, are compared."""
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}
    groups = defaultdict(list)
    for w in n:
        for key in {w, *(w[:i] + w[i + 1 :] for i in range(len(w))), *((w[:i], w[i + 1 :]) for i in range(len(w)))}:
            groups[key].append(w)
    near = defaultdict(set)
    for group in groups.values():
        for a in group:
            near[a].update(b for b in group if one_edit(a, b))
    form = {}
    for w in n:
        best = min(near[w], key=lambda u: (-n[u], u), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n.get(form[w])))
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def test_query_equals_plain_rules(spark):
    want = plain([(i, t) for i, t, _ in documents()])
    assert rows_of(queries.op13_spelling_variants(spark, SF)) == want
    assert any(r[1] for r in want) and any(r[2] not in (r[0], r[1]) for r in want)


@pytest.mark.parametrize("shard, searches, table", [(10_000, 50_000, 64 << 20), (40, 30, 200)])
def test_odd_words(spark, monkeypatch, shard, searches, table):
    """Small alphabets, so that words have many neighbours; chains; runs of one letter; long words; shards and searches cut small."""
    for name, value in (("SHARD_WORDS", shard), ("SEARCHES", searches), ("TABLE_BYTES", table), ("BLOCK", 50), ("HELD", 64), ("BOUND_CHARS", 3)):
        monkeypatch.setattr(spelling, name, value)
    rng = random.Random(5)
    words = ["".join(rng.choice("ab") for _ in range(rng.randint(4, 8))) for _ in range(300)] + ["".join(rng.choice("abÀ×ÿz") for _ in range(rng.randint(5, 7))) for _ in range(150)]
    texts = [" ".join(rng.choices(words, k=60)) for _ in range(60)]
    texts += ["aaaaa " * 4, "aaaaaa\n" * 9, "AAAAAAA1" * 20, "x" * 3000 + " " + "x" * 2999 + "y " + "x" * 3001 + "-", "color colour " * 3 + "colours " * 12 + "Colours" * 1 + " ÀÉÎÕü àéîõü" * 5, "", None, "1 2", "x" * 3000] * 3
    rows = [(i % 400 if i % 7 else None, t) for i, t in enumerate(texts)]
    frame = spark.createDataFrame([(i, t, "w", 1) for i, t in rows], "`a.b` long, text string, word string, n int")
    assert rows_of(spelling.group_variants(frame, id_col="a.b")) == plain(rows)
    assert spelling.group_variants(frame.limit(0), id_col="a.b").count() == 0


def test_chains(spark):
    """Roots are reached over many forms: each word is one edit and twice the count from the next."""
    words = ["qwertyuiop"[:k] for k in range(5, 11)]
    counted = [(w, 3 * 2**k) for k, w in enumerate(words)]
    frame = spark.createDataFrame([(None, " ".join([w] * n)) for w, n in counted], "doc_id long, text string")
    got = rows_of(spelling.group_variants(frame))
    assert got == plain([(None, " ".join([w] * n)) for w, n in counted])


def test_index_finds_each_neighbour_once():
    rng = random.Random(2)
    for letters in ("ab", "abc", "abcdefgé"):
        words = sorted({"".join(rng.choice(letters) for _ in range(rng.randint(5, 9))) for _ in range(250)})
        index, found = spelling.WordIndex(words), Counter()
        for by_end in (False, True):
            for i, j in zip(*(x.tolist() for x in index.near(words, by_end)), strict=True):
                found[i, j] += not (by_end and words[j].startswith(words[i][: len(words[i]) // 2]))
        assert +found == Counter({(i, j): 1 for i, a in enumerate(words) for j, b in enumerate(words) if one_edit(a, b)})
