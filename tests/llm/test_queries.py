"""The registered queries on the smallest tables: against their SQL, or against plain rules where there is none."""

import zlib
from collections import Counter

import duckdb
import pyarrow.parquet as pq
import pytest

from tests.llm.test_files_and_secrets import plain_scan
from tests.llm.test_near_dedup import brute as brute_classes
from tests.llm.test_text_operators import check_packing
from tracelake.llm import queries, secrets

SF = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels".split()


def documents():
    t = pq.read_table(f"{SF}/documents.parquet").to_pydict()
    return list(zip(t["doc_id"], t["text"], t["lang"], strict=True))


def plain(v):
    return repr(round(v, 9) + 0.0) if isinstance(v, float) else str(v) if isinstance(v, (bytes, bytearray)) else v


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    result = con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    cols = sorted(names)
    assert sorted(df.columns) == cols
    assert sorted(repr([plain(x) for x in r]) for r in df.select(*cols).collect()) == sorted(repr([plain(r[names.index(c)]) for c in cols]) for r in result.fetchall())


def encoded(name, end):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.vocabulary(name))
    return [(i, [*t.encode(x or "", add_special_tokens=False).ids, end]) for i, x, _ in documents()]


def crc(ids):
    return zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids))


def test_op1(spark):
    rows = queries.op1_best_fit_packing(spark, SF).collect()
    n = check_packing(rows, 2048)
    whole = encoded("byte_bpe_50k.json", 0)
    own = dict(whole)
    assert Counter(r.doc_id for r in rows) == Counter({i: -(-len(x) // 2048) for i, x in whole})
    assert all(r.ids_crc32 == crc(own[r.doc_id][r.start : r.start + r.length]) for r in rows)
    assert n <= -(-sum(len(x) for _, x in whole) // 2048) + 2


def test_op8(spark):
    at, want = 0, []
    for i, ids in sorted(encoded("word_bpe_49k.json", 1)):
        want.append((i, at, len(ids), crc(ids)))
        at += len(ids)
    assert sorted(tuple(r) for r in queries.op8_token_files(spark, SF).select("doc_id", "start", "n_tokens", "ids_crc32").collect()) == want


def test_op9(spark):
    """Base spans by a plain scan; added spans are the candidates that the plain rule on owners and copies calls live."""
    source = dict(zip(*pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "source"]).to_pydict().values(), strict=True))
    base, more, owners, repos = {}, {}, {}, {}
    copy_of = {}
    for i, text, _ in documents():
        base[i] = plain_scan(text)
        more[i] = secrets.candidates(text or "", [(a, k, b, "") for a, k, b in base[i]])
        for v in {v for *_, v in more[i]} | {(text[a:b] if k != 0 else secrets._ASSIGN.match(text, a)[2]) for a, k, b in base[i]}:
            owners.setdefault(v, set()).add(source[i])
            repos.setdefault(v, set()).add(copy_of.setdefault(text, i))
    live = lambda v: not (len(owners[v]) >= 3 or (len(owners[v]) > 1 and len(repos[v]) >= 20))
    for r in queries.op9_secrets(spark, SF).collect():
        spans = sorted(base[r.doc_id] + [(a, k, b) for a, k, b, v in more[r.doc_id] if live(v)])
        assert r.spans == ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in spans)
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s[1] == k for s in base[r.doc_id]) for k in range(3))


def test_op5(spark):
    got = {r.doc_id: r.class_id for r in queries.op5_order_minhash(spark, SF).collect()}
    want = dict(brute_classes([(i, t) for i, t, _ in documents()]))
    # the sketches may miss a pair near the threshold, and join none that isn't one
    assert sum(got[i] == want[i] for i in want) >= 0.98 * len(want)
    assert all(want[i] == want[c] for i, c in got.items())


def test_op3(spark):
    rows = queries.op3_lm_scoring(spark, SF).collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(documents()) and all((zlib.crc32(str(r.doc_id).encode()) % 5 == 1) == r.held_out for r in rows)
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
