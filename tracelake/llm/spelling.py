"""Spelling variants: words one edit apart, grouped under their most frequent form.

Words and their counts come from whole texts; counts are pre-added in each task. To find
the words at distance one, either half of a word must occur unchanged in the other. So the
vocabulary is kept in two orders, by length and spelling and by length and spelling
backwards, and cut into shards of about SHARD_WORDS words. A word is sent to the shards
whose range has words of its own or a neighbouring length that begin, or end, with its
half. Each shard is a bidirectional FM-index over its delimited words: two suffix-rank
intervals, of the text and of the text backwards, are carried together, so a match can
grow at either end. The exact half is matched first, out to the word's delimiter, then the
other half with one substituted, inserted or left-out code point, up to the other delimiter.
A task sends one row a word and shard back, never pairs. Shards with many searches are
searched in several tasks.

The driver holds the shards' bounds: at most MAX_SHARDS rows of two keys of at most
BOUND_CHARS code points; beyond, shards grow and their rank tables get sparser, so that a
table keeps within TABLE_BYTES.

A form is always twice as frequent, so chains of forms are short; their ends are found by
doubling, one join a round.

Defined results: null texts have no words; a null id counts as the empty text in the rule
of deletion; rows that repeat count one by one; ties of count go to the word first in code
point order; a word without a more frequent neighbour is its own root; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import bisect
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import Scratch, map_slices, quoted, utf8

#: Words have so many code points and occurrences at least; a form has RATIO times a word's occurrences.
MIN_LENGTH, MIN_COUNT, RATIO = 5, 3, 2
#: One run of letters in so many, by its document and spelling, loses a code point.
DELETION = 97
SHARD_WORDS, MAX_SHARDS, BOUND_CHARS = 10_000, 1 << 16, 64
#: Searches that a task does in one shard, and at once.
SEARCHES, BATCH = 50_000, 4096
TABLE_BYTES = 64 << 20
#: Distinct words that a counting task holds, and code points that are split into runs at once.
HELD, BLOCK = 200_000, 1 << 20
_RUN = re.compile("[A-Za-zÀ-ÿ]+")
_BREAK = re.compile("[^A-Za-zÀ-ÿ]")
_LAST = "\U0010ffff"


def runs_of(text: str) -> Iterator[list[str]]:
    """The maximal runs of letters of a text, by blocks."""
    at = 0
    while at < len(text):
        cut = _BREAK.search(text, min(at + BLOCK, len(text)))
        end = cut.start() if cut else len(text)
        yield _RUN.findall(text, at, end)
        at = end


def count_words(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(word, n) of the words of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["word", "n"])
            counts.clear()
            return batch

        for batch in batches:
            for doc, raw in zip(utf8(batch.column(0)), utf8(batch.column(1)), strict=True):
                own: Counter[str] = Counter()
                for runs in runs_of(raw.lower().decode()) if raw else ():  # bytes lower A-Z alone
                    own.update(runs)
                start = zlib.crc32((doc or b"") + b":")
                for word, k in own.items():
                    if len(word) < MIN_LENGTH:
                        continue
                    h = zlib.crc32(word.encode(), start)
                    if h % DELETION == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < MIN_LENGTH:
                            continue
                    counts[word] += k
                if len(counts) >= HELD:
                    yield out()
        yield out()

    rows = docs.select(F.col(quoted(id_col)).cast("string").alias("id"), F.col(quoted(text_col)).alias("text"))
    return map_slices(rows, run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Ranks:
    """Counts of smaller codes in the prefixes of a transform: the rank table of one direction."""

    def __init__(self, text: np.ndarray, size: int):
        """``text``: codes below ``size``, read as a circle whose rotations all differ."""
        self.order = _rotations(text)
        self.last = text[self.order - 1]
        self.step = max(1, math.ceil(len(text) * (size + 1) * 4 / TABLE_BYTES))
        self.table = np.zeros((len(text) // self.step + 1, size + 1), np.int32)
        for c in range(1, size + 1):
            smaller = np.concatenate([[0], np.cumsum(self.last < c, dtype=np.int32)])
            self.table[:, c] = smaller[:: self.step]
        self.first = np.searchsorted(text[self.order], np.arange(size + 1)).astype(np.int64)
        self.codes = np.arange(size + 1)

    def smaller(self, at: np.ndarray, code: np.ndarray) -> np.ndarray:
        """How many of the first ``at`` codes of the transform are below ``code``."""
        row = at // self.step
        out = self.table[row, code].astype(np.int64)
        for k in range(self.step - 1):
            i = row * self.step + k
            out += (i < at) & (self.last[np.minimum(i, len(self.last) - 1)] < code)
        return out

    def all_smaller(self, at: np.ndarray) -> np.ndarray:
        """As ``smaller``, for every code."""
        row = at // self.step
        out = self.table[row].astype(np.int64)
        for k in range(self.step - 1):
            i = row * self.step + k
            out += (i < at)[:, None] & (self.last[np.minimum(i, len(self.last) - 1)][:, None] < self.codes)
        return out


def _rotations(text: np.ndarray) -> np.ndarray:
    """The rotations of ``text`` in order, by doubling the compared length until all differ."""
    rank, k = np.unique(text, return_inverse=True)[1].astype(np.int64), 1
    while True:
        key = rank * len(text) + np.roll(rank, -k)
        order = np.argsort(key, kind="stable")
        rank = np.empty(len(text), np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(np.diff(key[order]) > 0)])
        k *= 2
        if rank[order[-1]] == len(text) - 1 or k >= 2 * len(text):
            return order


class WordIndex:
    """A bidirectional FM-index over distinct words, each with a delimiter (code 0) before it."""

    def __init__(self, words: list[str]):
        text = np.frombuffer(("\0" + "\0".join(words)).encode("utf-32-le"), np.uint32)
        self.letters, codes = np.unique(text, return_inverse=True)
        self.starts = np.flatnonzero(codes == 0)
        self.left, self.right = Ranks(codes, len(self.letters)), Ranks(codes[::-1], len(self.letters))

    def _grow(self, leftward: bool, low: tuple[np.ndarray, np.ndarray], size: np.ndarray, code: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray]:
        """Intervals (lows of both orders, common size) after one more code at an end; codes below 0 fit nowhere."""
        ranks, (main, other) = (self.left, low) if leftward else (self.right, low[::-1])
        known = code >= 0
        code = np.where(known, code, 0)
        below, upto = (ranks.smaller(main, code + d) for d in (0, 1))
        below_end, upto_end = (ranks.smaller(main + size, code + d) for d in (0, 1))
        grown = np.where(known, (upto_end - below_end) - (upto - below), 0)
        main, other = ranks.first[code] + upto - below, other + below_end - below
        return ((main, other) if leftward else (other, main)), grown

    def near(self, words: list[str], by_end: bool) -> tuple[np.ndarray, np.ndarray]:
        """(place in ``words``, place in the index) of words at distance one whose left half, or ``by_end`` right half, is exact."""
        text = np.frombuffer(("\0" + "\0".join(words) + "\0").encode("utf-32-le"), np.uint32)
        codes = np.searchsorted(self.letters, text)
        codes = np.where(self.letters[np.minimum(codes, len(self.letters) - 1)] == text, codes, -1)
        bounds = np.flatnonzero(text == 0)
        start, half = bounds[:-1], np.diff(bounds) - 1 >> 1
        # the exact half, outwards from the middle, with its delimiter
        q = np.arange(len(words))
        at, end = (start + half + 1, bounds[1:]) if by_end else (start + half, start)
        ahead = 1 if by_end else -1
        low, size = (np.zeros(len(q), np.int64), np.zeros(len(q), np.int64)), np.full(len(q), len(self.left.last))
        done: list[tuple[np.ndarray, ...]] = []
        while len(q):
            low, size = self._grow(not by_end, low, size, codes[at])
            over = (at == end) & (size > 0)
            done.append((q[over], low[0][over], low[1][over], size[over]))
            on = (size > 0) & ~over
            q, at, end, size, low = q[on], at[on] + ahead, end[on], size[on], (low[0][on], low[1][on])
        q, low0, low1, size = (np.concatenate(x) for x in zip(*done, strict=True))
        # the other half, on the other side of the middle, with one error
        ahead = -ahead
        at = start[q] + half[q] + (0 if by_end else 1)
        return self._with_error(by_end, ahead, codes, q, at, (low0, low1), size)

    def _with_error(self, leftward: bool, ahead: int, codes: np.ndarray, q: np.ndarray, at: np.ndarray, low: tuple[np.ndarray, np.ndarray], size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        erred = np.zeros(len(q), bool)
        found_q, found_low = [], []
        ranks = self.left if leftward else self.right
        while len(q):
            code = codes[at]
            grown_low, grown = self._grow(leftward, low, size, code)
            # on without an error, or with the one made before
            live = (grown > 0) & ((code != 0) | erred)
            ended = live & (code == 0)
            found_q.append(q[ended])
            found_low.append(grown_low[0][ended])
            on = live & ~ended
            states = [(q[on], at[on] + ahead, erred[on], grown_low[0][on], grown_low[1][on], grown[on])]
            # a code of the word left out: the last one of a run of equal codes
            out = ~erred & (code != 0) & (code != codes[np.clip(at + ahead, 0, len(codes) - 1)])
            states.append((q[out], at[out] + ahead, np.ones(out.sum(), bool), low[0][out], low[1][out], size[out]))
            # another code in its place, or put in before it
            free = np.flatnonzero(~erred)
            main, other = (low[0][free], low[1][free]) if leftward else (low[1][free], low[0][free])
            below, below_end = ranks.all_smaller(main), ranks.all_smaller(main + size[free])
            count = np.diff(below_end, axis=1) - np.diff(below, axis=1)
            count[:, 0] = 0
            mine = np.flatnonzero(code[free] >= 0)
            count[mine, code[free][mine]] = 0
            i, c = np.nonzero(count)
            grown_main = ranks.first[c] + below[i, c + 1] - below[i, c]
            grown_other = other[i] + below_end[i, c] - below[i, c]
            pair = (grown_main, grown_other) if leftward else (grown_other, grown_main)
            src, ones = free[i], np.ones(len(i), bool)
            states.append((q[src], at[src], ones, *pair, count[i, c]))
            swap = code[src] != 0
            states.append((q[src][swap], at[src][swap] + ahead, ones[swap], pair[0][swap], pair[1][swap], count[i, c][swap]))
            q, at, erred, low0, low1, size = (np.concatenate(x) for x in zip(*states, strict=True))
            low = (low0, low1)
        if not found_q:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(found_q), np.searchsorted(self.starts, self.left.order[np.concatenate(found_low)])


def search_shard(words: pd.DataFrame, searches: pd.DataFrame) -> pd.DataFrame:
    """One row a search that finds words in a shard: how many, and the one of largest count (ties: first word)."""
    none = pd.DataFrame({"wid": [], "n_near": [], "best_n": [], "best": [], "best_wid": []}).astype({"wid": "int64", "n_near": "int64", "best_n": "int64", "best_wid": "int64", "best": "str"})
    if not len(words) or not len(searches):
        return none
    by_end = bool(words["side"].iloc[0])
    # places in the index are ranks by count
    words = words.assign(down=-words["n"]).sort_values(["down", "word"])
    own = words["word"].tolist()
    index, out = WordIndex(own), [none]
    for k in range(0, len(searches), BATCH):
        part = searches.iloc[k : k + BATCH]
        asked = part["word"].tolist()
        q, w = index.near(asked, by_end)
        if by_end:  # those whose left half is exact too are found there
            keep = np.fromiter((not own[j].startswith(asked[i][: len(asked[i]) // 2]) for i, j in zip(q, w, strict=True)), bool, len(q))
            q, w = q[keep], w[keep]
        n_near = np.bincount(q, minlength=len(part))
        best = np.full(len(part), len(own))
        np.minimum.at(best, q, w)
        at = np.flatnonzero(n_near)
        chosen = words.iloc[best[at]]
        out.append(pd.DataFrame({
            "wid": part["wid"].to_numpy()[at], "n_near": n_near[at], "best_n": chosen["n"].to_numpy(), "best": chosen["word"].to_numpy(), "best_wid": chosen["wid"].to_numpy(),
        }))
    return pd.concat(out, ignore_index=True)


class Bounds:
    """Where the shards begin and end, to send words to those that may hold their neighbours."""

    def __init__(self, rows: list[tuple[int, tuple, tuple]]):
        rows = sorted(rows, key=lambda r: r[1:])
        self.shards = [r[0] for r in rows]
        self.lows, self.highs = [r[1] for r in rows], [(*r[2][:2], r[2][2] + _LAST) for r in rows]

    def of(self, word: str) -> Iterator[tuple[int, int]]:
        """(shard, side) pairs, each once."""
        half = len(word) // 2
        for side, key in ((0, word[:half]), (1, word[: half - 1 if half else None : -1])):
            seen = set()
            for length in (len(word) - 1, len(word), len(word) + 1):
                low = (side, length, key[:BOUND_CHARS])
                first, last = bisect.bisect_left(self.highs, low), bisect.bisect_right(self.lows, (side, length, key[:BOUND_CHARS] + _LAST))
                seen.update(self.shards[first:last])
            yield from ((s, side) for s in sorted(seen))


def near_words(words: DataFrame, work: Scratch) -> DataFrame:
    """(wid, n_near, best_n, best, best_wid) of the rows of ``words`` (wid, word, n; words distinct) that have near words."""
    sides = words.select("*", F.explode(F.array(*[F.struct(F.lit(s).alias("side"), k.alias("key")) for s, k in ((0, F.col("word")), (1, F.reverse("word")))])).alias("s"))
    shards = max(1, min(MAX_SHARDS, math.ceil(2 * words.count() / SHARD_WORDS)))
    order = ["side", "length", "key"]
    dealt = sides.select("wid", "word", "n", "s.side", F.char_length("word").alias("length"), "s.key").repartitionByRange(shards, *order)
    dealt = work.write(dealt.withColumn("shard", F.spark_partition_id()), "shards")
    place = F.struct("side", "length", F.substring("key", 1, BOUND_CHARS).alias("key"))
    bounds = Bounds([(r.shard, tuple(r.low), tuple(r.high)) for r in dealt.groupBy("shard").agg(F.min(place).alias("low"), F.max(place).alias("high")).collect()])
    kept = words.sparkSession.sparkContext.broadcast(bounds)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = kept.value.of
        for batch in batches:
            sent = [(i, *s) for i, word in enumerate(batch.column(1).to_pylist()) for s in of(word)]
            at, shard, side = (np.array([x[k] for x in sent], np.int32) for k in range(3))
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(pa.array(at)) for k in (0, 1)), pa.array(shard), pa.array(side)], names=["wid", "word", "shard", "side"])

    searches = work.write(map_slices(words.select("wid", "word"), route, "wid long, word string, shard int, side int"), "searches")
    # a row a shard and side, bounded as the shards are
    load = F.broadcast(searches.groupBy("shard", "side").agg(F.ceil(F.count("*") / SEARCHES).cast("int").alias("slices")))
    key = ["shard", "side", "slice"]
    asked = searches.join(load, ["shard", "side"]).withColumn("slice", F.pmod(F.xxhash64("wid"), F.col("slices")).cast("int")).select(*key, "wid", "word")
    held = dealt.join(load, ["shard", "side"]).withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).select(*key, "wid", "word", "n")
    found = held.groupBy(*key).cogroup(asked.groupBy(*key)).applyInPandas(search_shard, "wid long, n_near long, best_n long, best string, best_wid long")
    best = found.groupBy("wid").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("down"), "best", "best_wid")).alias("b"))
    out = work.write(best.select("wid", "n_near", (-F.col("b.down")).alias("best_n"), "b.best", "b.best_wid"), "near")
    work.drop("shards", "searches")
    return out


def chain_ends(links: DataFrame, work: Scratch) -> DataFrame:
    """(wid, root_wid, root): the last word reached from each row of ``links`` (wid, root_wid, root: the next word)."""
    step = 0
    now = work.write(links, "ends-0")
    while True:
        after = now.select(F.col("wid").alias("root_wid"), F.col("root_wid").alias("then_wid"), F.col("root").alias("then"))
        moved = now.join(after, "root_wid", "left").select(
            "wid", F.coalesce("then_wid", "root_wid").alias("root_wid"), F.coalesce("then", "root").alias("root"), F.col("then_wid").isNotNull().alias("moved")
        )
        moved = work.write(moved, f"ends-{step + 1}")
        work.drop(f"ends-{step}")
        now, step = moved.drop("moved"), step + 1
        if not moved.filter("moved").head(1):
            return now


def group_variants(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n), one row a word of the corpus."""
    work = Scratch(docs.sparkSession)
    counted = count_words(docs, id_col, text_col).filter(F.col("n") >= MIN_COUNT)
    words = work.write(counted.select(F.monotonically_increasing_id().alias("wid"), "word", "n"), "words")
    near = near_words(words, work)
    has_form = F.col("best_n") >= RATIO * F.col("n")
    formed = words.join(near, "wid", "left").select(
        "wid", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        *[F.when(has_form, F.col(c)).alias(a) for c, a in (("best", "form"), ("best_n", "form_n"), ("best_wid", "form_wid"))],
    )
    formed = work.write(formed, "formed")
    ends = chain_ends(formed.filter("form_wid is not null").select("wid", F.col("form_wid").alias("root_wid"), F.col("form").alias("root")), work)
    return formed.join(ends.select("wid", "root"), "wid", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
