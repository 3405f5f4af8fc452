"""Near-duplicate texts by Order MinHash with banded alignment.

For the sketch a text is the sequence of its five-word shingles (lower-case words; a
shorter text is one shingle), each labelled with its occurrence number, so that labels are
unique in a text. An Order MinHash sketch takes, for each of TABLES hash functions, the
PICKS labels of least hash in text order: two texts agree in a table only if they share
these shingles in the same order, which makes the sketch sensitive to edit similarity.

Candidates are verified by banded alignment of the word sequences: the longest common
subsequence within the band that the threshold allows (a match further off the diagonal
would leave too many words unmatched), and similarity = aligned / (words of both -
aligned), 0.8 or more. Texts whose five-word shingles are 0.8 alike in the same order are
also at least 0.8 alike by words, so no such pair is refused.

Texts with equal words are collapsed first. Every bucket is then compared as a star around
one member. Components are labelled anew, and buckets that still hold several components
are compared in further stars: the texts outside the largest component with a new member
of it, and one of them with all others. Stars repeat as long as each round leaves at most
half of the strangers of the one before. What is left is compared in grids: blocks of
strangers against blocks of members, inside tasks, only across components. Members of one
component are never paired, so the work of a group of copies is linear in its size; only
texts of one bucket that are unlike each other are compared each with each, and no pair
that fails ever becomes a row.

Defined results: a null text is empty; texts without words are near-duplicates only of
equal texts; repeated rows are copies of each other; a null id only becomes a class id if
its class has no other; an empty table gives an empty result; other columns are ignored
(``keep_one`` passes them through, whatever their names).
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import Scratch, map_slices, materialize, row_numbers, utf8
from tracelake.llm.components import connected_components
from tracelake.llm.decontaminate import words_of

SHINGLE, THRESHOLD = 5, 0.8
TABLES, PICKS = 32, 4
#: Strangers and members of one bucket that a task compares.
STRANGERS, MEMBERS = 256, 1024
#: Texts of at most so many words are verified by whole 64-bit codes; buckets take the lower halves of all.
SHORT, LOWER = 16, np.uint64(0xFFFFFFFF)
#: Rows that an alignment takes with one window of the band.
ROWS = 1024
_SEEDS = np.random.default_rng(77).integers(1, 1 << 63, TABLES, dtype=np.uint64) | np.uint64(1)
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def word_codes(text: bytes | None) -> np.ndarray:
    """64-bit codes of the words. The upper half is used in short texts alone, where one pair of words with equal lower halves could make texts alike."""
    words = words_of(text)
    codes = np.fromiter(map(zlib.crc32, words), np.uint64, len(words))
    if len(words) <= SHORT:
        upper = [int.from_bytes(hashlib.blake2b(w, digest_size=4).digest(), "little") for w in words]
        codes |= np.array(upper, np.uint64) << np.uint64(32)
    return codes


def stored(codes: np.ndarray) -> bytes:
    """Codes as bytes: 8 a word in short texts, else 4, after a byte that tells which."""
    return b"\x08" + codes.tobytes() if len(codes) <= SHORT else b"\x04" + codes.astype(np.uint32).tobytes()


def loaded(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint64 if data[0] == 8 else np.uint32, offset=1)


def alike(a: np.ndarray, b: np.ndarray, threshold: float) -> float:
    """``similarity`` of loaded codes; those of a short and a longer text by their lower halves."""
    if a.dtype != b.dtype:
        a, b = a.astype(np.uint32), b.astype(np.uint32)
    return similarity(a, b, threshold)


def shingles(codes: np.ndarray, shingle: int = SHINGLE) -> np.ndarray:
    """Shingle hashes in text order."""
    if not len(codes):
        return np.zeros(0, np.uint64)
    size = min(shingle, len(codes))
    n = len(codes) - size + 1
    h = np.full(n, size, np.uint64)
    for k in range(size):
        h = (h ^ codes[k : k + n]) * _M1
        h ^= h >> np.uint64(29)
    return h


def labelled(h: np.ndarray) -> np.ndarray:
    """``h`` with occurrence numbers mixed in; ``h`` itself if nothing repeats."""
    order = np.argsort(h, kind="stable")
    ranked = h[order]
    same = np.concatenate([[False], ranked[1:] == ranked[:-1]])
    if len(h) and same.any():
        at = np.arange(len(h))
        occurrence = np.empty(len(h), np.uint64)
        occurrence[order] = at - np.maximum.accumulate(np.where(same, 0, at))
        h = (h + occurrence * _M2) * _M1
        h ^= h >> np.uint64(32)
    return h


def labels(codes: np.ndarray, shingle: int = SHINGLE) -> np.ndarray:
    """Occurrence-labelled shingle hashes in text order."""
    return labelled(shingles(codes, shingle))


def sketch(own: np.ndarray) -> np.ndarray:
    """One key a table: the PICKS least labels under the table's hash, in text order."""
    picks = min(PICKS, len(own))
    chosen = np.empty((TABLES, picks), np.uint64)
    for t in range(TABLES):
        h = (own ^ _SEEDS[t]) * _M2
        h ^= h >> np.uint64(31)
        h *= _M1
        least = np.sort(np.argpartition(h, picks - 1)[:picks]) if picks < len(own) else np.arange(picks)
        chosen[t] = own[least]
    keys = np.arange(1, TABLES + 1, dtype=np.uint64)
    for k in range(picks):
        keys = (keys ^ chosen[:, k]) * _M1
        keys ^= keys >> np.uint64(32)
    return keys


def _aligned(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """Longest common subsequence of ``a`` and ``b`` over at least the matches up to ``band`` off the diagonal.

    Bit-parallel: a zero bit of ``v`` is a column of the window at which the length rises.
    """
    order = np.argsort(b, kind="stable")
    ranked = b[order]
    first, last = (np.searchsorted(ranked, a, side) for side in ("left", "right"))
    low = high = v = risen = 0
    for r in range(0, len(a), ROWS):
        left, right = min(max(low, r - band), len(b)), min(len(b), r + ROWS + band)
        v |= ((1 << (right - high)) - 1) << (high - low)
        gone = left - low
        risen += gone - (v & ((1 << gone) - 1)).bit_count()
        v >>= gone
        low, high = left, right
        full = (1 << (high - low)) - 1
        masks: dict[int, int] = {}
        for f, t in zip(first[r : r + ROWS].tolist(), last[r : r + ROWS].tolist(), strict=True):
            if f == t:
                continue
            mask = masks.get(f)
            if mask is None:
                at = order[f:t]
                at = at[(at >= low) & (at < high)] - low
                if len(at) == 1:
                    mask = 1 << int(at[0])
                else:
                    bits = np.zeros(high - low, np.uint8)
                    bits[at] = 1
                    mask = int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")
                masks[f] = mask
            u = v & mask
            if u:
                v = ((v + u) | (v - u)) & full
    return risen + (high - low) - v.bit_count()


def similarity(a: np.ndarray, b: np.ndarray, threshold: float = THRESHOLD) -> float:
    """Aligned similarity of two word sequences; 0 where it is known to be below ``threshold``."""
    na, nb = len(a), len(b)
    if not na or not nb:
        return 0.0
    least = threshold * (na + nb) / (1 + threshold)  # aligned words needed
    if min(na, nb) < least - 1e-9:
        return 0.0
    short = min(na, nb)
    apart = np.flatnonzero(a[:short] != b[:short])
    head = int(apart[0]) if len(apart) else short
    apart = np.flatnonzero(a[na - short + head :][::-1] != b[nb - short + head :][::-1])
    tail = int(apart[0]) if len(apart) else short - head
    a, b = a[head : na - tail], b[head : nb - tail]
    aligned = head + tail
    if aligned + min(len(a), len(b)) >= least - 1e-9:
        aligned += _aligned(a, b, int(max(na, nb) - least + 1e-9))
    value = aligned / (na + nb - aligned)
    return value if value >= threshold - 1e-12 else 0.0


def _sketch_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, part, rid, wkey, codes, keys): word codes and sketch of each document; ``rid`` numbers the rows."""
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("part"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = row_numbers()
        for batch in batches:
            wkeys, codes, keys = [], [], []
            for raw in utf8(batch.column(2)):
                own = word_codes(raw)
                codes.append(stored(own))
                wkeys.append(hashlib.blake2b(b" ".join(words_of(raw)) if len(own) else b"\nraw" + (raw or b""), digest_size=16).digest())
                keys.append(sketch(labels(own & LOWER)).astype(np.int64) if len(own) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), numbers(batch.num_rows), pa.array(wkeys, pa.binary()), pa.array(codes, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                names=["id", "part", "rid", "wkey", "codes", "keys"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return map_slices(rows, run, f"id {kind}, part long, rid long, wkey binary, codes binary, keys array<long>")


def _verify(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) of ``pairs`` whose texts are at least ``threshold`` alike."""
    one = texts.select(F.col("cid").alias("a"), F.col("codes").alias("codes_a"))
    two = texts.select(F.col("cid").alias("b"), F.col("codes").alias("codes_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = [
                i for i, (x, y) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True))
                if alike(loaded(x), loaded(y), threshold)
            ]
            yield pa.RecordBatch.from_arrays([batch.column(k).take(pa.array(hits, pa.int64())) for k in (0, 1)], names=["a", "b"])

    full = pairs.join(two, "b").join(one, "a").select("a", "b", "codes_a", "codes_b")
    return map_slices(full, run, "a long, b long")


def check_grid(pdf: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Links across components between one block of a bucket's strangers and one block of its members."""
    own = [loaded(c) for c in pdf["codes"]]
    sizes = np.array([len(c) for c in own])
    # words with occurrence numbers: what two texts share of them bounds what can be aligned
    _, marks = np.unique(np.concatenate([labelled(c.astype(np.uint32).astype(np.uint64)) for c in own]), return_inverse=True)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    cid, stranger, in_rows = pdf["cid"].to_numpy(), pdf["stranger"].to_numpy(bool), pdf["as_stranger"].to_numpy(bool)
    part = np.unique(pdf["root"].to_numpy(), return_inverse=True)[1]
    columns = np.flatnonzero(~in_rows)
    if not len(columns):
        return pd.DataFrame([], columns=["a", "b"]).astype("int64")
    column_marks = np.concatenate([marks[starts[j] : starts[j + 1]] for j in columns])
    column_starts = np.concatenate([[0], np.cumsum(sizes[columns])[:-1]])
    links = []
    for i in np.flatnonzero(in_rows):
        has = np.zeros(int(marks.max()) + 1, np.int32)
        has[marks[starts[i] : starts[i + 1]]] = 1
        shared = np.add.reduceat(has[column_marks], column_starts)
        # a pair of two strangers is met in both orders
        near = (shared >= threshold * (sizes[i] + sizes[columns]) / (1 + threshold) - 1e-9) & (~stranger[columns] | (cid[columns] > cid[i]))
        for j in columns[near]:
            if part[i] != part[j] and alike(own[i], own[j], threshold):
                links.append((cid[i], cid[j]))
                part[part == part[j]] = part[i]
    return pd.DataFrame(links, columns=["a", "b"]).astype("int64")


def _open_buckets(left: DataFrame, roots: DataFrame) -> DataFrame:
    """``left`` (key, cid) with root, stranger, strangers, members of the buckets that hold several components.

    Strangers are outside the largest component of the bucket.
    """
    rooted = left.join(roots, F.col("cid") == F.col("node"), "left").select("key", "cid", F.coalesce("root", "cid").alias("root"))
    parts = rooted.groupBy("key", "root").agg(F.count("*").alias("n"))
    mixed = parts.groupBy("key").agg(F.max(F.struct("n", "root")).alias("top"), F.sum("n").alias("members"), F.count("*").alias("roots")).filter("roots > 1")
    mixed = mixed.select("key", F.col("top.root").alias("top"), "members", (F.col("members") - F.col("top.n")).alias("strangers"))
    return rooted.join(mixed, "key").withColumn("stranger", F.col("root") != F.col("top")).drop("top")


def _leader(members: DataFrame, salt: int) -> DataFrame:
    """(key, lead, lead_root): a member of each bucket, the same one in all buckets that have it as far as possible."""
    least = F.min(F.struct(F.xxhash64(F.lit(salt), "cid").alias("h"), "cid", "root")).alias("l")
    return members.groupBy("key").agg(least).select("key", F.col("l.cid").alias("lead"), F.col("l.root").alias("lead_root"))


def _pairs(star: DataFrame) -> DataFrame:
    return star.select(F.least("cid", "lead").alias("a"), F.greatest("cid", "lead").alias("b")).distinct()


def _grid(opened: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Links across components in ``opened`` buckets: strangers against members, block by block."""
    rows, columns = (F.ceil(F.col(c) / size).cast("int") for c, size in (("strangers", STRANGERS), ("members", MEMBERS)))
    spot = F.pmod(F.xxhash64("cid"), F.lit(1 << 30))
    as_row = opened.filter("stranger").withColumns({"row": (spot % rows).cast("int"), "column": F.explode(F.sequence(F.lit(0), columns - 1)), "as_stranger": F.lit(True)})
    as_column = opened.withColumns({"row": F.explode(F.sequence(F.lit(0), rows - 1)), "column": (spot % columns).cast("int"), "as_stranger": F.lit(False)})
    dealt = as_row.unionByName(as_column).select("key", "row", "column", "cid", "root", "stranger", "as_stranger")
    return dealt.join(texts, "cid").groupBy("key", "row", "column").applyInPandas(lambda pdf: check_grid(pdf, threshold), "a long, b long")


def near_duplicates(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD
) -> DataFrame:
    """(id, __part, __copies, class_id, kept), one row per row of ``docs``.

    ``class_id`` is the smallest id of the class, ``kept`` is true of one row in it.
    ``__part`` hashes the text and tells rows that share an id apart, ``__copies`` counts
    the rows with this id and text.
    """
    work = Scratch(docs.sparkSession)
    rows = work.write(_sketch_rows(docs, id_col, text_col), "sketches")
    # equal words first: a class of copies is one text from here on
    classes = rows.groupBy("wkey").agg(F.min("rid").alias("cid"), F.min(F.struct(F.col("id").isNull().alias("n"), "id", "rid")).alias("first"))
    classes = work.write(classes, "classes")
    own = rows.filter("keys is not null").select(F.col("rid").alias("cid"), "keys").join(classes.select("cid"), "cid", "left_semi")
    # a key has its table mixed in, so it alone names a bucket
    tables = own.select("cid", F.explode("keys").alias("key"))
    shared = tables.groupBy("key").agg(F.count("*").alias("members"), F.min(F.struct(F.xxhash64(F.lit(0), "cid").alias("h"), "cid")).alias("l"))
    shared = shared.filter("members > 1").select("key", F.col("l.cid").alias("lead"))
    left = work.write(tables.join(shared, "key").filter("cid <> lead"), "met")
    met = left.select("cid").unionByName(left.select(F.col("lead").alias("cid"))).distinct()
    # only texts that meet another are carried on
    texts = work.write(rows.select(F.col("rid").alias("cid"), "codes").join(met, "cid", "left_semi"), "texts")
    links = work.write(_verify(_pairs(left), texts, threshold), "links")
    left, before, turn = left.drop("lead"), None, 0
    while True:
        roots = connected_components(links, work)
        opened = work.write(_open_buckets(left, roots), f"open-{turn}")
        strangers = opened.filter("stranger").count()
        if not strangers:
            break
        if before is not None and strangers > before / 2:
            more = work.write(_grid(opened, texts, threshold), "grid")
            if not more.isEmpty():
                roots = connected_components(links.unionByName(more), work)
            break
        before, turn = strangers, turn + 1
        outside = _leader(opened.filter("stranger"), turn)
        inside = _leader(opened.filter("not stranger"), turn)
        star = opened.filter("stranger").join(inside, "key").unionByName(opened.join(outside, "key").filter("root <> lead_root"))
        links = links.unionByName(work.write(_verify(_pairs(star), texts, threshold), f"links-{turn}"))
        # the stranger that led has met all others of its buckets
        left = work.write(opened.select("key", "cid").join(outside, "key").filter("cid <> lead").select("key", "cid"), f"left-{turn}")
    work.drop("met", "texts")
    grouped = classes.join(roots, F.col("cid") == F.col("node"), "left").withColumn("root", F.coalesce("root", "cid"))
    best = grouped.groupBy("root").agg(F.min("first").alias("best"))
    known = grouped.join(best, "root").select(F.col("wkey").alias("__wkey"), F.col("best.id").alias("class_id"), F.col("best.rid").alias("__rid"))
    copies = rows.groupBy(F.col("id").alias("__id"), F.col("part").alias("__p")).agg(F.count("*").alias("__copies")).filter("__copies > 1")
    out = rows.select("id", "part", "wkey", "rid").join(known, F.col("wkey") == F.col("__wkey"))
    out = out.join(copies, F.col("id").eqNullSafe(F.col("__id")) & (F.col("part") == F.col("__p")), "left")
    return out.select(
        F.col("id").alias(id_col), F.col("part").alias("__part"), F.coalesce("__copies", F.lit(1)).alias("__copies"), "class_id",
        (F.col("rid") == F.col("__rid")).alias("kept"),
    )


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with one row of each near-duplicate class; the columns of ``docs`` may have any names."""
    found = materialize(near_duplicates(docs, id_col=id_col, text_col=text_col, threshold=threshold), "kept")
    kept = found.filter("kept").select(F.col(id_col).alias("id"), F.col("__part").alias("part"))
    whole = docs.select(F.struct("*").alias("row"))
    match = F.col(f"row.`{id_col}`").eqNullSafe(F.col("id")) & (F.xxhash64(F.col(f"row.`{text_col}`")) == F.col("part"))
    out = whole.join(kept, match, "left_semi")
    if not found.filter("kept and __copies > 1").isEmpty():
        # a kept id and text that stand in several rows: one of them stays
        out = out.withColumns({"id": F.col(f"row.`{id_col}`"), "part": F.xxhash64(F.col(f"row.`{text_col}`"))}).dropDuplicates(["id", "part"])
    return out.select("row.*")
