"""Token-id files: one concatenated id array per segment, document boundaries in Elias-Fano code.

A segment is a byte string with a header, the ids (two bytes each where the vocabulary
allows), the cumulative document lengths and the ascending document ids, both Elias-Fano
encoded with select samples: offset number i is found from the nearest sample, and a run
of offsets by a walk from sample to sample, without a table of 64-bit offsets. Segments are written by Spark's committed Parquet writer as rows
(shard, segment, first, n_docs, n_ids, payload), so any store that Spark reaches will do
and a lost task leaves nothing behind. Shards ascend in document id.

Defined results: a null text is empty (only the end id is written); rows that repeat an
id are written one by one, ordered by a hash of the text; null ids come last; an empty
table writes an empty file set; other columns are ignored. Ids must be integers.
"""

from __future__ import annotations

import itertools
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm.common import SLICE_ROWS, map_slices
from tracelake.llm.tokenize import encoder

#: A segment is closed at this many ids; a longer document makes a longer segment.
SEGMENT_IDS = 1 << 20
MAGIC = b"TLTF"
_HEADER = struct.Struct("<4sBQQQqQ")  # magic, bytes an id, documents, ids, null document ids, smallest document id, bytes of ids
_EF = struct.Struct("<QBQQQ")  # values, low bits, bytes of low, high, samples
#: Every so many values the bit position of the value is kept.
SAMPLE = 256
_ONES = np.array([bin(b).count("1") for b in range(256)], np.uint8)


class EliasFano:
    """A non-decreasing sequence of unsigned integers."""

    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes, samples: bytes):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        if not n:
            return cls(0, 0, b"", b"", b"")
        per = int(values[-1]) // n
        bits = max(0, per.bit_length() - 1)
        places = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        high = np.zeros(int(places[-1]) + 1, np.uint8)
        high[places] = 1
        low = b""
        if bits:
            parts = (values[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)
            low = np.packbits(parts.astype(np.uint8).ravel(), bitorder="little").tobytes()
        return cls(n, bits, low, np.packbits(high, bitorder="little").tobytes(), places[::SAMPLE].astype("<u4").tobytes())

    def select(self, i: int) -> int:
        """Value number ``i``: jump to the sample before it, then count ones by byte."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at = int(np.frombuffer(self.samples, "<u4", 1, 4 * (i // SAMPLE))[0])
        left = i % SAMPLE
        byte = at >> 3
        current = self.high[byte] >> (at & 7) << (at & 7)
        while (ones := _ONES[current]) <= left:
            left -= int(ones)
            byte += 1
            current = self.high[byte]
        for _ in range(left):
            current &= current - 1
        place = byte * 8 + (int(current) & -int(current)).bit_length() - 1
        low = 0
        for k in range(self.low_bits):
            bit = i * self.low_bits + k
            low |= (self.low[bit >> 3] >> (bit & 7) & 1) << k
        return (place - i) << self.low_bits | low

    def walk(self) -> Iterator[np.ndarray]:
        """All values in order, SAMPLE at a time: from each sample's bit on, the next ones are selected by their places."""
        starts = np.frombuffer(self.samples, "<u4")
        for k, at in enumerate(starts.tolist()):
            first, n = k * SAMPLE, min(SAMPLE, self.n - k * SAMPLE)
            end = int(starts[k + 1]) if k + 1 < len(starts) else 8 * len(self.high)
            ones = np.flatnonzero(np.unpackbits(np.frombuffer(self.high, np.uint8, (end + 7) // 8 - at // 8, at // 8), bitorder="little"))
            places = ones + (at // 8 * 8)
            places = places[np.searchsorted(places, at) :][:n]
            out = (places - np.arange(first, first + n)).astype(np.uint64) << np.uint64(self.low_bits)
            if self.low_bits:
                bit = first * self.low_bits
                part = np.frombuffer(self.low, np.uint8, -(-(bit + n * self.low_bits) // 8) - bit // 8, bit // 8)
                bits = np.unpackbits(part, bitorder="little")[bit % 8 :][: n * self.low_bits].reshape(n, -1)
                out |= (bits.astype(np.uint64) << np.arange(self.low_bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
            yield out

    def decode(self) -> np.ndarray:
        """All values as one array."""
        return np.concatenate([np.zeros(0, np.uint64), *self.walk()])

    def to_bytes(self) -> bytes:
        return _EF.pack(self.n, self.low_bits, len(self.low), len(self.high), len(self.samples)) + self.low + self.high + self.samples

    @classmethod
    def from_bytes(cls, data: bytes, at: int) -> tuple[EliasFano, int]:
        n, bits, *sizes = _EF.unpack_from(data, at)
        at += _EF.size
        parts = []
        for size in sizes:
            parts.append(data[at : at + size])
            at += size
        return cls(n, bits, *parts), at


def write_segment(doc_ids: list[int | None], ids: list[bytes], width: int) -> bytes:
    """``ids``: each document's ids as little-endian unsigned 32-bit integers; known document ids ascend, nulls last."""
    known = [i for i in doc_ids if i is not None]
    base = known[0] if known else 0
    ends = np.cumsum([len(x) // 4 for x in ids], dtype=np.uint64)
    body = np.frombuffer(b"".join(ids), "<u4").astype(f"<u{width}").tobytes()
    head = _HEADER.pack(MAGIC, width, len(ids), int(ends[-1]) if len(ends) else 0, len(doc_ids) - len(known), base, len(body))
    own = np.array([i - base for i in known], np.uint64)
    return head + body + EliasFano.encode(ends).to_bytes() + EliasFano.encode(own).to_bytes()


class Segment:
    def __init__(self, data: bytes):
        magic, self.width, self.n_docs, self.n_ids, nulls, base, size = _HEADER.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a token-id segment")
        at = _HEADER.size
        self.ids = np.frombuffer(data, f"<u{self.width}", self.n_ids, at)
        self.ends, at = EliasFano.from_bytes(data, at + size)
        self.own, _ = EliasFano.from_bytes(data, at)
        self.base, self.nulls = base, nulls

    def document(self, i: int) -> np.ndarray:
        """Ids of document number ``i``, by two selects."""
        return self.ids[self.ends.select(i - 1) if i else 0 : self.ends.select(i)]

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(document id, start in the segment, ids) of each document, by walks along both select structures."""
        names = itertools.chain((self.base + x for block in self.own.walk() for x in block.tolist()), itertools.repeat(None, self.nulls))
        start = 0
        for block in self.ends.walk():
            for end in block.tolist():
                yield next(names), start, self.ids[start:end]
                start = end


def write_token_files(
    docs: DataFrame, path: str, vocabulary: str, *, end_id: int, vocabulary_size: int,
    id_col: str = "doc_id", text_col: str = "text", segment_ids: int = SEGMENT_IDS,
) -> None:
    """Encode ``docs`` in ascending id order into segments under ``path``."""
    width = 2 if vocabulary_size <= 1 << 16 else 4
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col(id_col).asc_nulls_last(), F.col("__tie")]
    rows = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col), F.xxhash64(text_col).alias("__tie"))
    ranged = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, end = TaskContext.get().partitionId(), end_id.to_bytes(4, "little")
        doc_ids, ids, n, first, segment = [], [], 0, 0, 0

        def close() -> pa.RecordBatch:
            values = (shard, segment, first, len(ids), n, write_segment(doc_ids, ids, width))
            types = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays(
                [pa.array([v], t) for v, t in zip(values, types, strict=True)], names=["shard", "segment", "first", "n_docs", "n_ids", "payload"]
            )

        for batch in batches:
            for doc_id, own in zip(batch.column(0).to_pylist(), encoder(vocabulary, False).encode(batch.column(1).to_pylist()), strict=True):
                doc_ids.append(doc_id)
                ids.append(own + end)
                n += len(own) // 4 + 1
                if n >= segment_ids:
                    yield close()
                    first, segment, doc_ids, ids, n = first + n, segment + 1, [], [], 0
        if ids:
            yield close()

    map_slices(ranged.drop("__tie"), run, "shard int, segment int, first long, n_docs long, n_ids long, payload binary").write.option(
        "compression", "zstd"
    ).parquet(path)


def read_token_files(spark: SparkSession, path: str, *, id_col: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every document in the files; ``start`` counts all ids before it."""
    files = spark.read.parquet(path)
    sizes = files.groupBy("shard").agg(F.sum("n_ids").alias("n")).orderBy("shard").collect()  # one row a shard
    bases, total = {}, 0
    for r in sizes:
        bases[r.shard] = total
        total += r.n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, first, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                known = Segment(payload).documents()
                while part := list(itertools.islice(known, SLICE_ROWS)):
                    starts = np.array([start for _, start, _ in part], np.int64)
                    sizes = [len(ids) for _, _, ids in part]
                    crc = [zlib.crc32(ids.astype("<u4").tobytes()) for _, _, ids in part]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([i for i, _, _ in part], pa.int64()), pa.array(starts + first + bases[shard]), pa.array(sizes, pa.int64()), pa.array(crc, pa.int64())],
                        names=[id_col, "start", "n_tokens", "ids_crc32"],
                    )

    return files.select("shard", "first", "payload").mapInArrow(run, f"`{id_col}` long, start long, n_tokens long, ids_crc32 long")
