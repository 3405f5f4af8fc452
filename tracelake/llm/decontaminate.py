"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are windows of WINDOW consecutive words of the test items (an item with fewer
words is one shorter pattern). A table of two-word blocks says how far a position can be
skipped; blocks that end a pattern lead to a bucket, whose members are compared first by
the pattern's first word and then word by word.

The pattern tables are broadcast in blocks of bounded size (``max_block_words``, about
350 bytes a word in a worker); more blocks mean more passes over the documents, never a
larger broadcast. Items longer than a block are cut into parts that overlap by a window
less one word, so that no window is lost.

Defined results: a null text has no words; items with a null id mark words as hit but
are listed nowhere; repeated item ids count once; with no items nothing is hit; repeated
document rows are judged one by one; other columns are ignored or passed through.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import map_slices, materialize, utf8

WINDOW = 13
#: Words of test items that one broadcast block holds, in expectation, and at most twice that: below 200 MB in a worker.
MAX_BLOCK_WORDS = 250_000

#: ASCII letters are lower-cased, other ASCII but digits becomes a blank, bytes of other characters stay.
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_FOLD).split() if text else []


class WuManber:
    """Search for word patterns of one length; a pattern is a place in an item's words, which are kept once."""

    def __init__(self, length: int, patterns: dict[tuple[bytes, ...], tuple[list[bytes], int, set[str]]]):
        self.length = m = length
        self.block = b = min(2, m)
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.buckets: dict[tuple[bytes, ...], list[tuple[list[bytes], int, tuple[str, ...]]]] = {}
        shared: dict[tuple[str, ...], tuple[str, ...]] = {}
        for pattern, (words, at, items) in patterns.items():
            for end in range(b, m + 1):
                block = pattern[end - b : end]
                self.shift[block] = min(self.shift.get(block, m - b + 1), m - end)
            owners = tuple(sorted(items))
            self.buckets.setdefault(pattern[m - b :], []).append((words, at, shared.setdefault(owners, owners)))

    def find(self, words: list[bytes]) -> Iterator[tuple[int, tuple[str, ...]]]:
        m, b = self.length, self.block
        skip, far, buckets, n = self.shift.get, m - b + 1, self.buckets, len(words)
        at = m
        while at <= n:
            block = (words[at - 2], words[at - 1]) if b == 2 else (words[at - 1],)
            step = skip(block, far)
            if step:
                at += step
                continue
            start = at - m
            for own, first, items in buckets[block]:
                if own[first] == words[start] and own[first : first + m] == words[start:at]:
                    yield start, items
            at += 1


def compile_patterns(items: list[tuple[str | None, bytes | None]], window: int) -> list[WuManber]:
    """One search per pattern length; ``items`` holds (id as string, text)."""
    by_length: dict[int, dict[tuple[bytes, ...], tuple[list[bytes], int, set[str]]]] = defaultdict(dict)
    known: dict[bytes, bytes] = {}
    for item, text in items:
        words = [known.setdefault(w, w) for w in words_of(text)]
        if not words:
            continue
        size = min(window, len(words))
        for at in range(len(words) - size + 1):
            found = by_length[size].setdefault(tuple(words[at : at + size]), (words, at, set()))
            if item is not None:
                found[2].add(item)
    return [WuManber(size, p) for size, p in by_length.items()]


def covered(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping or touching half-open spans merged."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def search(searches: list[WuManber], text: bytes | None) -> tuple[int, list[tuple[int, int]], set[str]]:
    """(words, merged hit spans in words, item ids)."""
    words = words_of(text)
    spans, items = [], set()
    for s in searches:
        for start, found in s.find(words):
            spans.append((start, start + s.length))
            items.update(found)
    return len(words), covered(spans), items


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, window: int, max_block_words: int):
    """(blocks, broadcast of one block's pattern tables), block by block; a block's items fit the driver by the bound on its words."""
    words = F.filter(F.split(F.coalesce(F.col(text_col), F.lit("")), "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"), lambda w: w != "")
    parts = benchmark.select(F.col(item_col).cast("string").alias("item"), words.alias("w"))
    # parts share a window less one word; an item within the bound is one part
    step = max(1, max_block_words - window + 1)
    starts = F.sequence(F.lit(0), F.greatest(F.ceil((F.size("w") - window + 1) / step).cast("int") - 1, F.lit(0)))
    parts = parts.select("item", F.explode(F.transform(starts, lambda k: F.slice("w", k * step + 1, step + window - 1))).alias("w"))
    total = parts.agg(F.sum(F.size("w").cast("long"))).first()[0] or 0
    n = max(1, -(-total // max_block_words))
    for k in range(n):
        rows = parts.filter(F.pmod(F.xxhash64("item", "w"), F.lit(n)) == k).select("item", F.array_join("w", " "))
        items = [(r[0], r[1].encode()) for r in rows.toLocalIterator()]
        yield n, benchmark.sparkSession.sparkContext.broadcast(compile_patterns(items, window))


_SPANS = "array<struct<start:long,end:long>>"
_SPANS_ARROW = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def find_passages(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    max_block_words: int = MAX_BLOCK_WORDS,
) -> DataFrame:
    """(id, __part, n_words, spans, items): merged hit spans in words and sorted item ids, one row per row of ``docs``.

    ``__part`` hashes the text and tells rows that share an id apart.
    """
    base = docs.select(F.col(id_col), F.xxhash64(text_col).alias("__part"), F.col(text_col).alias("__text"))
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {id_type}, __part long, n_words long, spans {_SPANS}, items array<string>"

    def one(block) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            searches = block.value
            for batch in batches:
                n, spans, items = [], [], []
                for text in utf8(batch.column(2)):
                    a, b, c = search(searches, text)
                    n.append(a)
                    spans.append([{"start": x, "end": y} for x, y in b])
                    items.append(sorted(c))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(spans, _SPANS_ARROW), pa.array(items, pa.list_(pa.string()))],
                    names=[id_col, "__part", "n_words", "spans", "items"],
                )

        return map_slices(base, run, schema)

    # more blocks: each pass keeps only rows with hits, merged by row; identical rows have identical hits.
    # a pass is written and its tables are dropped before the next block is compiled
    found = None
    for n_blocks, block in _blocks(benchmark, item_col, item_text_col, window, max_block_words):
        if n_blocks == 1:
            return one(block)
        hits = materialize(one(block).filter(F.size("spans") > 0), "hits")
        block.destroy()
        found = hits if found is None else found.unionByName(hits)
    merged = found.groupBy(F.col(id_col).alias("__id"), F.col("__part").alias("__p")).agg(
        F.flatten(F.collect_set("spans")).alias("__spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("__items")
    )
    plain = one(benchmark.sparkSession.sparkContext.broadcast([])).drop("spans", "items")
    joined = plain.join(merged, plain[id_col].eqNullSafe(F.col("__id")) & (F.col("__part") == F.col("__p")), "left")
    empty = F.expr(f"cast(array() as {_SPANS})")
    union = F.expr(
        "aggregate(array_sort(__spans), cast(array() as " + _SPANS + "), (acc, s) -> case when size(acc) > 0 and s.start <= element_at(acc, -1).end "
        "then concat(slice(acc, 1, size(acc) - 1), array(named_struct('start', element_at(acc, -1).start, 'end', greatest(element_at(acc, -1).end, s.end)))) "
        "else concat(acc, array(s)) end)"
    )
    return joined.select(
        id_col, "__part", "n_words",
        F.when(F.col("__spans").isNull(), empty).otherwise(union).alias("spans"),
        F.coalesce("__items", F.expr("cast(array() as array<string>)")).alias("items"),
    )


def judge(found: DataFrame, *, min_share: float = 0.05) -> DataFrame:
    """Adds ``n_hit``, ``n_items`` and ``contaminated`` (hit words make up ``min_share`` of all, and there is one)."""
    n_hit = F.expr("aggregate(spans, 0L, (n, s) -> n + s.end - s.start)")
    out = found.withColumns({"n_hit": n_hit, "n_items": F.size("items").cast("long")})
    # in decimals, so that a share at the very limit counts
    share = F.lit(Decimal(str(min_share))) * F.col("n_words").cast("decimal(20,0)")
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") >= share))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_share: float = 0.05, **options) -> DataFrame:
    """The rows of ``docs`` that aren't contaminated; their columns may have any names."""
    found = judge(find_passages(docs, benchmark, id_col=id_col, text_col=text_col, **options), min_share=min_share)
    # few documents are contaminated beside all; rows with equal id and text are judged alike
    bad = materialize(found.filter("contaminated").select(F.col(id_col).alias("id"), F.col("__part").alias("part")).distinct(), "contaminated")
    match = F.col(f"row.`{id_col}`").eqNullSafe(F.col("id")) & (F.xxhash64(F.col(f"row.`{text_col}`")) == F.col("part"))
    return docs.select(F.struct("*").alias("row")).join(bad, match, "left_anti").select("row.*")
