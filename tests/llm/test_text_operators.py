"""Line dedup, decontamination and packing against brute force on awkward rows."""

import bisect
import os
import random
import re
import zlib
from collections import defaultdict

import pytest

from tracelake.llm import decontaminate, line_dedup, packing
from tracelake.llm.queries import vocabulary

DOCS = "doc_id long, text string, n_lines string, source string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", None) for i, t in rows], DOCS)


LINES = [
    (1, "alpha beta gamma\nshort\n  ALPHA beta GAMMA \t\nunique line one"),
    (2, "Alpha Beta Gamma\nshort\nother line here\n"),
    (3, None), (4, ""), (5, "\n\n"), (6, "alpha beta gamma"), (6, "alpha beta gamma"), (6, "other line here\nx"),
    (None, "alpha beta gamma"), (7, "other line here\r\nOTHER LINE HERE"), (8, "éééééééééé\nz"), (9, "éééééééééé"), (10, "a" * 50_000 + "\n" + "b" * 20),
    (11, "b" * 20),
]


def brute_lines(rows, least=10):
    split = [(i, (t or "").split("\n")) for i, t in rows]
    key = lambda s: re.sub("[A-Z]", lambda m: m[0].lower(), s.strip(" \t\n\x0b\x0c\r"))
    first = {}
    for i, lines in split:
        for x in lines:
            if i is not None and len(key(x)) >= least:
                first[key(x)] = min(first.get(key(x), i), i)
    out = []
    for i, lines in split:
        kept = [x for x in lines if i is None or first.get(key(x), i) == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("hot_factor", [4, 0])
def test_line_dedup(spark, monkeypatch, hot_factor):
    monkeypatch.setattr(line_dedup, "HOT_FACTOR", hot_factor)
    got = line_dedup.dedup_lines(frame(spark, LINES)).select("doc_id", "n_lines", "n_dropped", "kept_text").collect()
    assert sorted(map(tuple, got), key=repr) == brute_lines(LINES)
    assert line_dedup.dedup_lines(frame(spark, [])).count() == 0


def test_line_dedup_many_hot_lines(spark):
    rng = random.Random(3)
    rows = [(i, "\n".join(rng.choice(["the very common line", f"line number {rng.randrange(300)} of many", f"row {i} x {rng.random()}"]) for _ in range(rng.randrange(1, 200)))) for i in range(400)]
    got = line_dedup.dedup_lines(frame(spark, rows)).select("doc_id", "n_lines", "n_dropped", "kept_text").collect()
    assert sorted(map(tuple, got), key=repr) == brute_lines(rows)


def brute_windows(docs, items, window=13):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for item, text in items:
            p = words(text)
            size = min(window, len(p))
            grams = {tuple(p[k : k + size]) for k in range(len(p) - size + 1)} if p else set()
            for k in range(len(w) - size + 1):
                if size and tuple(w[k : k + size]) in grams:
                    hit |= set(range(k, k + size))
                    if item is not None:
                        found.add(str(item))
        out.append((i, len(w), len(hit), len(found), sorted(found), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block_words", [1_000_000, 20])
def test_decontamination(spark, block_words):
    rng = random.Random(5)
    vocab = ["a", "b", "Cc", "d9", "é"]
    items = [(k, " ".join(rng.choice(vocab) for _ in range(rng.choice([0, 1, 2, 5, 13, 14, 30])))) for k in range(12)] + [(None, "null item words"), (3, "twice the item"), (98, None)]
    items = [x for x in items if len((x[1] or "").split()) != 1] + [(99, "single")]
    docs = [(k, " ".join(rng.choice(vocab) for _ in range(rng.randrange(60)))) for k in range(40)]
    docs += [(50, None), (51, ""), (52, "x " * 500 + items[4][1]), (53, "Null-item... WORDS!"), (53, "Null-item... WORDS!"), (54, "a single one"), (None, "twice the item")]
    docs += [(60 + k, "zz " * k + (items[k][1] or "").upper().replace("É", "é") + " yy" * 7) for k in range(10)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.judge(decontaminate.find_passages(frame(spark, docs), bench, max_block_words=block_words))
    got = [(r.doc_id, r.n_words, r.n_hit, r.n_items, r["items"], r.contaminated) for r in found.collect()]
    assert sorted(got, key=repr) == brute_windows(docs, items)
    none = decontaminate.judge(decontaminate.find_passages(frame(spark, docs), bench.limit(0)))
    assert none.filter("n_hit > 0").count() == 0 and none.count() == len(docs)


TEXTS = [
    None, "", " ", "  ", "a", " a", "a ", "a  b", "a   b", "a \n b", "a\n\n b", "a \nb", "\n\n", "x\t y", "é à\xa0b  c", "don't we'll  <|endoftext|> go", "a <|endoftext|> b", "<|startoftext|>a<|endoftext|>", "x <|ENDOFTEXT|>y <|endoftext", "one<|endoftext|><|endoftext|> two\n",
    "tabs\t\tand   runs \n\n\n of  space ", "　wide　 space", "\x1codd\x1d sep", "İstanbul ΣΑΣ é ﬁ ", "123,456.7 $%^ 日本語 text", "q" * 9000, "word " * 5000, "end\n ", "end \n",
]


@pytest.mark.parametrize("name,space", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_chunked_ids_equal_whole_text_ids(name, space):
    import numpy as np
    from tokenizers import Tokenizer

    from tracelake.llm.tokenize import ChunkEncoder

    plain = Tokenizer.from_file(vocabulary(name))
    rng = random.Random(1)
    texts = TEXTS + ["".join(rng.choice([" ", " ", " ", "foo", "Bar", "straße", "'s", ".", ",", "!!", "|", "\n", "7", "é", "e\u0301", "İ", "ﬁ", "n't", ")", "ǅ"]) for _ in range(30)) for _ in range(800)]
    texts += ["".join(rng.choice([" ", " ", "\n", "\t", "a", "B", "'s", "é", "1", ",", "\xa0"]) for _ in range(40)) for _ in range(500)]
    got = ChunkEncoder(vocabulary(name), space).encode(texts)
    for text, ids in zip(texts, got, strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == (plain.encode(text, add_special_tokens=False).ids if text else []), repr(text)


def check_packing(rows, capacity):
    inside = defaultdict(list)
    for r in rows:
        inside[r.sequence_id].append((r.offset, r.length))
    for spans in inside.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    return len(inside)


def test_packing_documents(spark):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    texts = list(enumerate(TEXTS)) + [(3, "a"), (3, "a"), (None, "b")]
    out = packing.pack_documents(frame(spark, texts), vocabulary("byte_bpe_50k.json"), capacity=64).collect()
    check_packing(out, 64)
    want = []
    for i, t in texts:
        ids = (plain.encode(t, add_special_tokens=False).ids if t else []) + [0]
        for k, (start, length) in enumerate(packing.cut(len(ids), 64)):
            want.append((i, k, start, length, zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[start : start + length]))))
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out), key=repr) == sorted(want, key=repr)
    assert packing.pack_documents(frame(spark, []), vocabulary("byte_bpe_50k.json")).count() == 0


def plain_best_fit(lengths, capacity=2048):
    """Sequences of plain best fit over pieces by decreasing length."""
    gaps = []
    for n in sorted(lengths, reverse=True):
        k = bisect.bisect_left(gaps, n)
        gap = gaps.pop(k) if k < len(gaps) else capacity
        bisect.insort(gaps, gap - n)
    return len(gaps)


@pytest.mark.parametrize("sweep_pieces,slack", [(50_000, 1.0), (1000, 1.01)])
def test_packing_is_tight(spark, sweep_pieces, slack):
    rng = random.Random(2)
    lengths = [rng.choice([rng.randrange(1, 2049), rng.randrange(1, 300), 700, 2048]) for _ in range(6000)]
    pieces = spark.createDataFrame([(k, n, 1, 2, 3) for k, n in enumerate(lengths)], "doc_id long, length int, size int, id int, `row` int")
    out = packing.pack(pieces, sweep_pieces=sweep_pieces).collect()
    assert sorted(r.doc_id for r in out) == list(range(6000)) and out[0].__fields__ == ["doc_id", "length", "size", "id", "row", "sequence_id", "offset"]
    assert check_packing(out, 2048) <= plain_best_fit(lengths) * slack


def test_one_frequent_length(spark):
    out = packing.pack(spark.createDataFrame([(k, 7) for k in range(5000)], "doc_id long, length long"), sweep_pieces=600).collect()
    assert check_packing(out, 2048) <= -(-5000 // (2048 // 7)) + 9


def test_ranks_settle_who_gets_a_gap():
    placed, left = packing.best_fit([9, 5, 5, 3, 2], [(1, 5), (2, 6), (3, 4)], 10, 100)
    assert placed == [(100, 1 - 1), (1, 5), (2, 4), (3, 6), (101, 0)] and sorted(left) == [(2, 1), (3, 1), (100, 1), (101, 8)]


def test_benchmark_blocks_are_alive_one_at_a_time(spark, monkeypatch):
    events, blocks = [], []
    plain_blocks, plain_materialize, plain_compile = decontaminate._blocks, decontaminate.materialize, decontaminate.compile_patterns

    def compile_patterns(items, window):
        assert all(not os.path.exists(b._path) for b in blocks)
        events.append("compile")
        return plain_compile(items, window)

    def listed(*args):
        for found in plain_blocks(*args):
            blocks.append(found[-1] if isinstance(found, tuple) else found)
            yield found

    monkeypatch.setattr(decontaminate, "compile_patterns", compile_patterns)
    monkeypatch.setattr(decontaminate, "_blocks", listed)
    monkeypatch.setattr(decontaminate, "materialize", lambda df, label: events.append("write") or plain_materialize(df, label))
    bench = spark.createDataFrame([(k, " ".join(f"i{k}w{j}" for j in range(20))) for k in range(12)], "item_id long, text string")
    docs = spark.createDataFrame([(k, " ".join(f"i{k}w{j}" for j in range(20))) for k in range(14)], "doc_id long, text string")
    found = decontaminate.find_passages(docs, bench, max_block_words=60)
    assert events == ["compile", "write"] * 4
    assert sorted((r.doc_id, r["items"]) for r in found.collect()) == [(k, [str(k)] if k < 12 else []) for k in range(14)]


def test_an_item_longer_than_a_block_is_cut_without_loss(spark):
    rng = random.Random(11)
    words = [f"w{rng.randrange(50)}" for _ in range(300)]
    docs = [(k, " ".join(words[a : a + 13 + k % 3])) for k, a in enumerate(range(0, 287))]
    bench = spark.createDataFrame([("long", " ".join(words)), ("short", "w1 w2")], "item_id string, text string")
    found = decontaminate.judge(decontaminate.find_passages(frame(spark, docs), bench, max_block_words=40))
    got = [(r.doc_id, r.n_words, r.n_hit, r.n_items, r["items"], r.contaminated) for r in found.collect()]
    assert sorted(got, key=repr) == brute_windows(docs, [("long", " ".join(words)), ("short", "w1 w2")])


def test_share_at_the_limit(spark):
    spans = spark.createDataFrame([(n, [(0, h)], []) for n, h in ((10, 3), (20, 1), (21, 1), (0, 0))], "n_words long, spans array<struct<start:long,end:long>>, items array<string>")
    assert [r.contaminated for r in decontaminate.judge(spans, min_share=0.3).orderBy("n_words").collect()] == [False, True, False, False]
    assert [r.contaminated for r in decontaminate.judge(spans).orderBy("n_words").collect()] == [False, True, True, False]


def test_columns_of_any_name(spark):
    names = "doc_id long, text string, __key int, __n int, __part int, __p int, __id int, row int, part int, __words int, doc int, __doc int, `a.b` int"
    rows = [(1, "a line of the text\nand another", *range(11)), (2, "a line of the text", *range(11, 22)), (3, "one two three four five six seven eight nine ten eleven twelve thirteen", *range(11))]
    docs = spark.createDataFrame(rows, names)
    out = line_dedup.dedup_lines(docs)
    assert out.columns == [*docs.columns, "n_lines", "n_dropped", "kept_text"]
    assert sorted(tuple(r)[:13] for r in out.collect()) == rows
    bench = spark.createDataFrame([(1, rows[2][1])], "item_id long, text string")
    assert [tuple(r) for r in decontaminate.drop_contaminated(docs, bench).orderBy("doc_id").collect()] == rows[:2]


def test_gaps_of_many_long_pieces_are_dealt_out(spark):
    """Few short pieces among many that are over half a row: sweeps are bounded by the gaps too, and every short piece still finds one."""
    rng = random.Random(6)
    sizes = [rng.randrange(1025, 2040) for _ in range(900)] + [rng.randrange(1, 900) for _ in range(10)]
    pieces = spark.createDataFrame([(k, s) for k, s in enumerate(sizes)], "doc_id long, length long")
    rows = packing.pack(pieces, sweep_pieces=50).collect()
    assert len({r.sequence_id for r in rows}) == 900 and len(rows) == 910
    ends = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 2048
