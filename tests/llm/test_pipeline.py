"""Every stage against what its operator's brute force keeps, on rows with all kinds of oddities."""

import random

import corpus_pipeline
from tests.llm.test_near_dedup import brute as brute_classes
from tests.llm.test_text_operators import brute_lines, brute_windows, check_packing

from tracelake.llm.common import work_path


def write(spark, tmp_rows, items):
    folder = work_path(spark, "in")
    spark.createDataFrame(tmp_rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def corpus():
    rng = random.Random(8)
    vocab = {"en": ["the", "of", "house", "river", "with", "under", "stone"], "fr": ["le", "la", "maison", "rivière", "avec", "sous", "été"]}
    rows = []
    for k in range(160):
        lang = rng.choice(["en", "fr"])
        lines = [" ".join(rng.choice(vocab[lang]) + rng.choice(["", "", str(rng.randrange(99))]) for _ in range(rng.randrange(4, 12))) for _ in range(rng.randrange(1, 9))]
        if k % 5 == 0:
            lines.insert(0, "this very line is everywhere")
        rows.append((k, "\n".join(lines), lang))
    items = [(k, " ".join(rng.choice(vocab["en"]) + str(k) for _ in range(20))) for k in range(6)]
    rows += [(300 + k, items[k][1] + " the end of the river", "en") for k in range(6)]
    rows += [(400, None, None), (401, "", "en"), (402, "1234 5678", "en"), (403, rows[3][1], "en"), (404, rows[3][1].replace("the", "THE"), "en"), (None, "the house of the river with stone", "en")]
    return [(i, t, lang, "s", None if t is None else len(t)) for i, t, lang in rows] + [(403, rows[3][1], "en", "s", 1)], items


def test_stages(spark):
    rows, items = corpus()
    folder = write(spark, rows, items)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        if k < 4:
            assert out.schema == docs.schema
        path = work_path(spark, "out")
        out.write.parquet(path)
        seen[name] = (docs.collect(), spark.read.parquet(path).collect())
        docs = spark.read.parquet(path)
    before, after = seen["language_id"]
    assert {r.doc_id for r in before} - {r.doc_id for r in after} == {400, 401, 402}
    before, after = seen["line_dedup"]
    assert sorted(((r.doc_id, r.text) for r in after), key=repr) == sorted(((i, t) for i, _, _, t in brute_lines([(r.doc_id, r.text) for r in before])), key=repr)
    before, after = seen["near_dedup"]
    classes = dict(brute_classes([(r.doc_id, r.text) for r in before]))
    assert sorted(map(repr, (r.doc_id for r in after))) == sorted(map(repr, set(classes.values())))
    before, after = seen["decontamination"]
    bad = {r[0] for r in brute_windows([(r.doc_id, r.text) for r in before], items) if r[5]}
    assert bad >= {300, 303} and {r.doc_id for r in after} == {r.doc_id for r in before} - bad
    before, after = seen["packing"]
    assert {r.doc_id for r in after} == {r.doc_id for r in before}
    check_packing(after, 2048)


def test_run(spark):
    rows, items = corpus()
    assert corpus_pipeline.run(spark, write(spark, rows, items)).count() > 100
    assert corpus_pipeline.run(spark, write(spark, [], [])).count() == 0
