"""Secret scanning with corpus-wide ownership frequencies.

Each text is searched for assignments, access keys and long hexadecimal runs (base kinds)
and for other long mixed strings (candidates). Values are hashed, and the hashes counted
over the corpus by distinct owner and repository, where copies of one text are in one
repository. Every value is live or an example: with one owner it is live, however many
documents and repositories hold it; with EXAMPLE_OWNERS or more it is an example; with a
few owners in between it is live unless EXAMPLE_REPOS or more repositories hold it. Live
candidates are added as spans of kind ``token``; base spans always stay.

Defined results: a null text is empty; a null owner or repository counts as one value of
its own; rows that repeat are scanned one by one (copies of a repository's row do not
raise its counts); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import map_slices, materialize, row_numbers, utf8

#: In the order in which spans with one start are listed.
KINDS = ("assign", "access", "hex", "token")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
# maximal runs, so a shorter run can't hide a longer one
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
_RUN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
#: A candidate mixes cases and digits and has this entropy in bits a character.
MIN_ENTROPY = 3.5
#: A value is an example from so many owners on, and with two or more owners from so many repositories on.
EXAMPLE_OWNERS, EXAMPLE_REPOS = 3, 20

_SPAN = "struct<start:long,kind:int,end:long>"
_SPAN_ARROW = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())])
_CANDIDATE_ARROW = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64()), ("hash", pa.binary())])


def entropy(value: str) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def base_spans(text: str, raw: bytes) -> list[tuple[int, int, int, str]]:
    """(start, kind number, end, value) of the base kinds, sorted."""
    out = []
    lower = raw.lower()
    if any(k in lower for k in _KEYWORDS):
        out += [(m.start(), 0, m.end(), m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if b"AKIA" in raw:
        out += [(m.start(), 1, m.end(), m[0]) for m in _ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end(), m[0]) for m in _HEX.finditer(text)]
    return sorted(out)


def candidates(text: str, base: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    """Long mixed strings that touch no base span."""
    out = []
    for m in _RUN.finditer(text):
        v = m[0]
        mixed = any("0" <= c <= "9" for c in v) and any("a" <= c <= "z" for c in v) and any("A" <= c <= "Z" for c in v)
        if mixed and entropy(v) >= MIN_ENTROPY and all(m.end() <= a or b <= m.start() for a, _, b, _ in base):
            out.append((m.start(), 3, m.end(), v))
    return out


def _digest(spans: list[tuple]) -> str:
    return hashlib.sha256(",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b, *_ in spans).encode()).hexdigest()


def scan(docs: DataFrame, id_col: str, text_col: str, owner_col: str, repo_col: str) -> DataFrame:
    """One row per document: base counts, base spans and hashed candidates; written out as it is small beside the texts."""
    base = docs.select(F.col(id_col), F.xxhash64(owner_col).alias("owner"), F.xxhash64(repo_col).alias("repo"), F.xxhash64(text_col).alias("copy"), F.col(text_col).alias("__text"))
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = row_numbers()
        for batch in batches:
            counts, digests, spans, found = ([], [], []), [], [], []
            for text, raw in zip(batch.column(4).to_pylist(), utf8(batch.column(4)), strict=True):
                own = base_spans(text, raw) if text else []
                more = candidates(text, own) if text else []
                for k in range(3):
                    counts[k].append(sum(s[1] == k for s in own))
                digests.append(_digest(own))
                spans.append([{"start": a, "kind": k, "end": b} for a, k, b, _ in own])
                found.append([
                    {"start": a, "kind": k, "end": b, "hash": hashlib.blake2b(v.encode(), digest_size=16).digest()}
                    for a, k, b, v in own + more
                ])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(4)), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()),
                 pa.array(spans, pa.list_(_SPAN_ARROW)), pa.array(found, pa.list_(_CANDIDATE_ARROW)), numbers(batch.num_rows)],
                names=[id_col, "owner", "repo", "copy", "n_assign", "n_access", "n_hex", "base_sha256", "base", "found", "rid"],
            )

    schema = (
        f"`{id_col}` {id_type}, owner long, repo long, copy long, n_assign long, n_access long, n_hex long, base_sha256 string, "
        f"base array<{_SPAN}>, found array<struct<start:long,kind:int,end:long,hash:binary>>, rid long"
    )
    return materialize(map_slices(base, run, schema), "secrets")


def ownership(found: DataFrame) -> DataFrame:
    """(hash, n_owners, n_repos) of ``found`` (hash, owner, repo, copy).

    Rows with one ``copy``, the hash of their text, are in the least of their repositories.
    A hot hash is spread by owner and text first.
    """
    held = found.groupBy("hash", "copy", "owner").agg(F.min("repo").alias("repo"))
    owners = held.select("hash", F.lit(True).alias("by_owner"), F.col("owner").alias("holder"))
    repos = held.groupBy("hash", "copy").agg(F.min("repo").alias("holder")).select("hash", F.lit(False).alias("by_owner"), "holder")
    return (
        owners.unionByName(repos).groupBy("hash", "by_owner", "holder").agg(F.count("*"))
        .groupBy("hash").agg(F.count_if("by_owner").alias("n_owners"), F.count_if(~F.col("by_owner")).alias("n_repos"))
    )


def find_secrets(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str = "doc_id"
) -> DataFrame:
    """(id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example), one row per row of ``docs``.

    ``spans``: structs (start, kind number, end), base spans and live candidates, sorted by start, then kind.
    ``n_live`` and ``n_example`` count the row's values, of base kinds too, by their ownership.
    """
    scanned = scan(docs, id_col, text_col, owner_col, repo_col)
    found = scanned.select("rid", "owner", "repo", "copy", F.explode("found").alias("f")).select("rid", "owner", "repo", "copy", "f.*")
    owned = ownership(found)
    example = (F.col("n_owners") >= EXAMPLE_OWNERS) | ((F.col("n_owners") > 1) & (F.col("n_repos") >= EXAMPLE_REPOS))
    judged = found.join(owned, "hash").withColumns({"live": ~example, "example": example})
    added = judged.groupBy(F.col("rid").alias("__rid")).agg(
        F.collect_list(F.when(F.col("live") & (F.col("kind") == 3), F.struct("start", "kind", "end"))).alias("added"),
        F.count_if("live").alias("n_live"),
        F.count_if("example").alias("n_example"),
    )
    joined = scanned.drop("found").join(added, scanned.rid == added["__rid"], "left")
    return joined.select(
        id_col, "n_assign", "n_access", "n_hex", "base_sha256",
        F.when(F.col("added").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", "added"))).alias("spans"),
        F.coalesce("n_live", F.lit(0)).alias("n_live"),
        F.coalesce("n_example", F.lit(0)).alias("n_example"),
    )
