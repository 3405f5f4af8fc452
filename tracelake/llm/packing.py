"""Best-fit packing of token sequences into rows of fixed capacity, bulk-synchronously.

Pieces are range-sorted by length. Those of more than half a row open a row each. The others
are placed in supersteps, a band of lengths at a time, longest first. In a superstep the open
gaps are range-sorted by size too, and both sorted tables are dealt out by rank, every
``deals``-th row to the same sweep, so that each sweep meets pieces and gaps of all sizes in
the proportions of the whole. A sweep goes down its pieces in rank order and gives each its
successor gap, the smallest that fits; where several pieces want one gap, the first in rank
gets it and the next goes on to the gap after. Used gaps shrink at once, pieces without a
gap open a row, and what is left of all gaps is sorted and dealt anew for the next band.
Pieces and gaps are rows of tables throughout; a sweep holds about SWEEP_PIECES of them.

Defined results: null texts are empty; rows that repeat an id are packed one by one; null
ids pass through; an empty table gives an empty result; other columns are ignored by
``pack_documents`` and passed through by ``pack``, whatever their names.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import Scratch, map_slices
from tracelake.llm.tokenize import encoder

CAPACITY = 2048
#: Pieces of a sweep, over all bands, in expectation.
SWEEP_PIECES = 50_000
#: Appended to each document.
END_ID = 0


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids: only longer documents are cut, a short piece comes first."""
    if n <= capacity:
        return [(0, n)]
    head = n % capacity
    return ([(0, head)] if head else []) + [(at, capacity) for at in range(head, n, capacity)]


def token_pieces(
    docs: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text",
    capacity: int = CAPACITY, end_id: int = END_ID,
) -> DataFrame:
    """(id, piece, start, length, ids_crc32) of every document; ids themselves stay in the task."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = end_id.to_bytes(4, "little")
        for batch in batches:
            rows, cols = [], ([], [], [], [])
            for i, ids in enumerate(encoder(vocabulary, True).encode(batch.column(1).to_pylist())):
                ids += end
                for k, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                    rows.append(i)
                    for c, v in zip(cols, (k, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)])), strict=True):
                        c.append(v)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(cols[0], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[1:])],
                names=[id_col, "piece", "start", "length", "ids_crc32"],
            )

    return map_slices(docs.select(id_col, text_col), run, f"`{id_col}` {id_type}, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: list[int], gaps: list[tuple[int, int]], capacity: int, first_id: int) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """((sequence, offset) of each piece, (sequence, gap) of what is left): pieces in falling order of length, each to the smallest gap that fits.

    ``gaps`` holds (sequence, size); new sequences are numbered from ``first_id`` on.
    """
    by_size: dict[int, list[int]] = defaultdict(list)
    for sequence, size in gaps:
        by_size[size].append(sequence)
    sizes = sorted(by_size)
    placed = []
    for length in lengths:
        k = bisect.bisect_left(sizes, length)
        if k < len(sizes):
            size = sizes[k]
            sequence = by_size[size].pop()
            if not by_size[size]:
                sizes.pop(k)
        else:
            size, sequence, first_id = capacity, first_id, first_id + 1
        placed.append((sequence, capacity - size))
        left = size - length
        if left:
            if not by_size[left]:
                bisect.insort(sizes, left)
            by_size[left].append(sequence)
    return placed, [(sequence, size) for size in sizes for sequence in by_size[size]]


def _dealt(table: DataFrame, size: str, tie: str, deals: int) -> DataFrame:
    """``table`` with ``deal``: range-sorted, neighbours in rank go to different sweeps."""
    parts = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = table.repartitionByRange(parts, size, tie).sortWithinPartitions(size, tie).withColumn("at", F.monotonically_increasing_id())
    return ranged.withColumn("deal", ((F.shiftright("at", 33) + F.col("at").bitwiseAND((1 << 33) - 1)) % deals).cast("int"))


def superstep(pieces: DataFrame, gaps: DataFrame, capacity: int, step: int) -> DataFrame:
    """(kind, id, sequence, size) by sweeps over pieces (deal, id, size) and gaps (deal, id, size): ``place`` rows have the piece's
    offset as size, ``gap`` rows what is left of a sequence."""
    def sweep(table: pa.Table) -> pa.Table:
        is_gap, ids, sizes = (table.column(c).to_numpy() for c in ("is_gap", "id", "size"))
        own = np.flatnonzero(~is_gap)
        own = own[np.lexsort((ids[own], -sizes[own]))]
        open_ = np.flatnonzero(is_gap)
        open_ = open_[np.lexsort((-ids[open_], sizes[open_]))]
        first = (step << 56) + (int(table.column("deal")[0].as_py()) << 32)
        placed, left = best_fit(sizes[own].tolist(), list(zip(ids[open_].tolist(), sizes[open_].tolist(), strict=True)), capacity, first)
        n, m = len(placed), len(left)
        return pa.table({
            "kind": pa.array(["place"] * n + ["gap"] * m), "id": pa.array(np.concatenate([ids[own], np.zeros(m, np.int64)]), pa.int64()),
            "sequence": pa.array([x for x, _ in placed] + [x for x, _ in left], pa.int64()), "size": pa.array([x for _, x in placed] + [x for _, x in left], pa.int64()),
        })

    columns = ["deal", "id", "size"]
    both = pieces.select(*columns, F.lit(False).alias("is_gap")).unionByName(gaps.select(*columns, F.lit(True).alias("is_gap")))
    return both.groupBy("deal").applyInArrow(sweep, "kind string, id long, sequence long, size long")


def pack(pieces: DataFrame, *, capacity: int = CAPACITY, sweep_pieces: int = SWEEP_PIECES) -> DataFrame:
    """``pieces`` (with a ``length`` from 1 to ``capacity``) with ``sequence_id`` and a gapless ``offset``."""
    work = Scratch(pieces.sparkSession)
    names = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    rows = work.write(pieces.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col("length").cast("long").alias("size")), "pieces")
    # both sides of a sweep are bounded: the pieces that look for a gap, and the gaps
    short, gaps = rows.agg(F.count_if(F.col("size") <= capacity // 2), F.count_if((F.col("size") > capacity // 2) & (F.col("size") < capacity))).first()
    deals = max(1, -(-max(short, gaps if short else 0) // sweep_pieces))
    # the position in the written table splits ties, so that a frequent length spans many partitions
    ranked = work.write(_dealt(rows.withColumn("pos", F.monotonically_increasing_id()), "size", "pos", deals).withColumnRenamed("at", "id").drop("pos"), "ranked")
    opened = ranked.filter(F.col("size") > capacity // 2).select("id", F.col("id").alias("sequence"), F.lit(0).cast("long").alias("offset"))
    gaps = ranked.filter((F.col("size") > capacity // 2) & (F.col("size") < capacity)).select(F.col("id").alias("sequence"), (capacity - F.col("size")).alias("size"))
    places = [opened]
    bands = [capacity // 2, capacity // 4, capacity // 8, capacity // 32, 0]
    for step, (high, low) in enumerate(zip(bands[:-1], bands[1:], strict=True), 64):
        band = ranked.filter((F.col("size") > low) & (F.col("size") <= high))
        # gaps that are too small for this band wait for a later one
        wide = work.write(_dealt(gaps.filter(F.col("size") > low).withColumnRenamed("sequence", "id"), "size", "id", deals), f"gaps-{step}")
        done = work.write(superstep(band, wide, capacity, step), f"step-{step}")
        places.append(done.filter("kind = 'place'").select("id", "sequence", F.col("size").alias("offset")))
        gaps = done.filter("kind = 'gap'").select("sequence", "size").unionByName(gaps.filter(F.col("size") <= low))
    placed = reduce(DataFrame.unionByName, places)
    out = ranked.join(placed, "id")
    return out.select("row.*", F.col("sequence").alias("sequence_id"), "offset")


def pack_documents(
    docs: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text",
    capacity: int = CAPACITY, end_id: int = END_ID,
) -> DataFrame:
    """Tokenize, cut and pack whole documents."""
    return pack(token_pieces(docs, vocabulary, id_col=id_col, text_col=text_col, capacity=capacity, end_id=end_id), capacity=capacity)
