"""Token ids in binary segments whose document boundaries are Elias-Fano encoded.

A segment holds the concatenated ids of consecutive documents, at two bytes an id where the vocabulary allows, and the
running ends of the documents as an Elias-Fano sequence: low bits packed, high bits in unary, with a directory of
every SAMPLE-th one for select. So an offset costs about 2 + log2(ids / documents) bits instead of 64. The ids of
the documents, which ascend, are such a sequence too.

Segments are the binary values of a Parquet table in the shared folder, ordered by partition and segment; the table is
the container because its writer commits whole tasks, and because any store that Spark reads will do.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import scratch_path, table, tune
from .tokens import byte_bpe, vocabulary_path

MAGIC = b"EFSEG1\0\0"
#: magic, documents, ids, bytes an id, low bits, bytes of: low bits, high bits, directory
HEADER = struct.Struct("<8sQQHHQQQ")
SAMPLE = 64
#: A sequence: values, low bits, bytes of: low bits, high bits, directory. Document ids: nulls, the first id.
SEQUENCE, NAMES = struct.Struct("<QHQQQ"), struct.Struct("<Qq")
#: Values whose low bits are packed at a time.
PART = 1 << 15
#: Ids from which a segment is closed.
SEGMENT_IDS = 1 << 19

_COUNT = np.array([bin(b).count("1") for b in range(256)], dtype=np.uint8)


class EliasFano:
    """A sequence of non-decreasing integers, by its low bits, high bits and select directory."""

    def __init__(self, count: int, low_bits: int, low: bytes, high: bytes, directory: bytes):
        self.count, self.low_bits = count, low_bits
        self.low, self.high = np.frombuffer(low, dtype=np.uint8), np.frombuffer(high, dtype=np.uint8)
        self.directory = np.frombuffer(directory, dtype="<u4")

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, dtype=np.uint64)
        n = len(values)
        low_bits = max(0, (int(values[-1]) // n).bit_length() - 1) if n else 0
        shifts = np.arange(low_bits, dtype=np.uint64)
        # in parts of whole bytes, so that wide low bits of many values aren't spread out at once
        low = b"".join(np.packbits((values[a : a + PART, None] >> shifts & np.uint64(1)).astype(np.uint8).reshape(-1), bitorder="little").tobytes() for a in range(0, n, PART))
        ones = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        unary = np.zeros(int(ones[-1]) + 1 if n else 0, dtype=np.uint8)
        unary[ones] = 1
        return cls(n, low_bits, low, np.packbits(unary, bitorder="little").tobytes(), ones[::SAMPLE].astype("<u4").tobytes())

    def _low(self, i: int) -> int:
        a = i * self.low_bits
        b = a + self.low_bits
        return (int.from_bytes(self.low[a // 8 : -(-b // 8)].tobytes(), "little") >> (a % 8)) & ((1 << self.low_bits) - 1)

    def select(self, i: int) -> int:
        """The i-th value: from the nearest entry of the directory, by counting ones byte by byte."""
        if not 0 <= i < self.count:
            raise IndexError(i)
        at, left = int(self.directory[i // SAMPLE]), i % SAMPLE
        byte = at // 8
        word = int(self.high[byte]) >> (at % 8) << (at % 8)
        while (ones := int(_COUNT[word])) <= left:
            left -= ones
            byte += 1
            word = int(self.high[byte])
        for _ in range(left):
            word &= word - 1
        high = byte * 8 + (word & -word).bit_length() - 1 - i
        return high << self.low_bits | self._low(i)

    def values(self) -> np.ndarray:
        """All values, in order."""
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.count]
        out = (ones - np.arange(self.count)) << self.low_bits
        for a in range(0, self.count, PART):
            n = min(PART, self.count - a)
            bits = np.unpackbits(self.low[a * self.low_bits // 8 :], bitorder="little", count=n * self.low_bits).reshape(n, self.low_bits)
            out[a : a + n] += (bits.astype(np.int64) << np.arange(self.low_bits)).sum(1)
        return out

    def packed(self) -> bytes:
        parts = [self.low.tobytes(), self.high.tobytes(), self.directory.tobytes()]
        return SEQUENCE.pack(self.count, self.low_bits, *map(len, parts)) + b"".join(parts)

    @classmethod
    def unpacked(cls, data: bytes) -> EliasFano:
        count, low_bits, *sizes = SEQUENCE.unpack_from(data)
        at, parts = SEQUENCE.size, []
        for size in sizes:
            parts.append(data[at : at + size])
            at += size
        return cls(count, low_bits, *parts)


def write_segment(documents: list[np.ndarray], wide: bool) -> bytes:
    """One segment of the ids of each document."""
    ends = EliasFano.of(np.cumsum([len(d) for d in documents], dtype=np.uint64))
    ids = np.concatenate(documents).astype("<u4" if wide else "<u2") if documents else np.zeros(0, "<u2")
    parts = [ends.low.tobytes(), ends.high.tobytes(), ends.directory.tobytes()]
    return HEADER.pack(MAGIC, len(documents), len(ids), 4 if wide else 2, ends.low_bits, *map(len, parts)) + b"".join(parts) + ids.tobytes()


class DocumentIds:
    """The ids of a segment's documents, nulls first and then ascending: an Elias-Fano sequence of their distances from the first."""

    def __init__(self, data: bytes):
        self.nulls, self.first = NAMES.unpack_from(data)
        self.distances = EliasFano.unpacked(data[NAMES.size :])

    @staticmethod
    def pack(names: list[int | None]) -> bytes:
        known = [n for n in names if n is not None]
        first = known[0] if known else 0
        return NAMES.pack(len(names) - len(known), first) + EliasFano.of(np.array([n - first for n in known], dtype=np.uint64)).packed()

    def select(self, i: int) -> int | None:
        """The id of the i-th document."""
        return None if i < self.nulls else self.first + self.distances.select(i - self.nulls)

    def all(self) -> pa.Array:
        with np.errstate(over="ignore"):  # distances of 2^63 and more wrap, and so does the sum
            ids = self.distances.values() + np.int64(self.first)
        return pa.concat_arrays([pa.nulls(self.nulls, pa.int64()), pa.array(ids, pa.int64())])


class Segment:
    """Random access to a segment's documents."""

    def __init__(self, data: bytes):
        magic, self.documents, self.ids, width, low_bits, *sizes = HEADER.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a segment")
        at, parts = HEADER.size, []
        for size in sizes:
            parts.append(data[at : at + size])
            at += size
        self.ends = EliasFano(self.documents, low_bits, *parts)
        self.array = np.frombuffer(data, dtype=f"<u{width}", offset=at, count=self.ids)

    def bounds(self, i: int) -> tuple[int, int]:
        return self.ends.select(i - 1) if i else 0, self.ends.select(i)

    def document(self, i: int) -> np.ndarray:
        a, b = self.bounds(i)
        return self.array[a:b].astype("<u4")


_SEGMENTS = "partition int, segment int, first long, n_ids long, doc_ids binary, data binary"


def write_store(docs: DataFrame, path: str, vocabulary: str, ranks: str | None, end_id: int) -> None:
    """Tokenizes docs in ascending doc_id order, end_id behind each, and writes the segments to path.

    Null texts are empty. Null doc_ids come first; rows of one doc_id follow a hash of their text, so equal rows are
    interchangeable and a doc_id with very many rows still splits. A text of any length is one document of one segment.
    An empty table makes an empty store. Other columns aren't read.
    """
    spark = docs.sparkSession
    tune(spark)
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("tie"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("tie")]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, partition = byte_bpe(vocabulary, ranks), TaskContext.get().partitionId()
        wide = encoder.library.tokenizer.get_vocab_size() > 1 << 16 or end_id >= 1 << 16
        end = np.array([end_id], dtype="<u4")
        names: list[int | None] = []
        ids: list[np.ndarray] = []
        segment = first = size = 0

        def close() -> pa.RecordBatch:
            columns = [[partition], [segment], [first], [size], [DocumentIds.pack(names)], [write_segment(ids, wide)]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["partition", "segment", "first", "n_ids", "doc_ids", "data"])

        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                names.append(name)
                ids.append(np.concatenate([encoder.ids(text.as_py()), end]))
                size += len(ids[-1])
                if size >= SEGMENT_IDS:
                    yield close()
                    segment, first, size, names, ids = segment + 1, first + size, 0, [], []
        if names:
            yield close()

    rows.repartitionByRange(partitions, *order).sortWithinPartitions(*order).select("doc_id", "text").mapInArrow(encode, _SEGMENTS).write.option("compression", "zstd").parquet(path)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, read from the segments; no rows from an empty store."""
    segments = spark.read.schema(_SEGMENTS).parquet(path)
    # a row for each partition of the writer: their number is spark.sql.shuffle.partitions
    totals = sorted(map(tuple, segments.groupBy("partition").agg(F.sum("n_ids").alias("n")).collect()))
    base, before = {}, 0
    for partition, n in totals:
        base[partition] = before
        before += n

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for partition, first, names, data in zip(*(batch.column(k) for k in range(4)), strict=True):
                segment = Segment(data.as_py())
                start = base[partition.as_py()] + first.as_py()
                bounds = [segment.bounds(i) for i in range(segment.documents)]
                crc = [zlib.crc32(segment.array[a:b].astype("<u4").tobytes()) for a, b in bounds]
                yield pa.RecordBatch.from_arrays(
                    [DocumentIds(names.as_py()).all(), pa.array([start + a for a, _ in bounds], pa.int64()), pa.array([b - a for a, b in bounds], pa.int64()), pa.array(crc, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return segments.select("partition", "first", "doc_ids", "data").mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op7_token_store(spark: SparkSession, sf_dir: str, end_id: int = 2) -> DataFrame:
    path = scratch_path(spark, "token-store")
    write_store(table(spark, sf_dir, "documents"), path, vocabulary_path("byte_bpe_50k.json"), vocabulary_path("byte_bpe_50k.tiktoken"), end_id)
    return read_store(spark, path)
