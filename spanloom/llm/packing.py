"""Packing along a space-filling curve.

A document's ids are hashed into a vector, which a fixed random matrix projects to AXES dimensions; the Hilbert key of
that point orders documents so that neighbours are alike. Documents are range-partitioned and sorted by (key, doc_id),
so equal documents with one key still spread, and each partition is cut along the curve into sequences. The rest of a
partition is cut into powers of two, which need no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import materialize, table, tune
from .tokens import vocabulary_path, word_bpe

AXES, AXIS_BITS, VECTOR = 4, 12, 1024
LENGTH, END_ID = 2048, 1


def _projection() -> np.ndarray:
    return np.random.default_rng(41).normal(0, 1, (VECTOR, AXES)).astype(np.float32)


def point(ids: np.ndarray, projection: np.ndarray) -> np.ndarray:
    """The cell of a document: its hashed, damped, normalised id counts, projected and squashed to AXIS_BITS each."""
    hashed = ids * np.uint32(0x9E3779B1)
    counts = np.log1p(np.bincount(hashed >> np.uint32(22), minlength=VECTOR))
    counts *= np.where(np.arange(VECTOR) & 1, -1.0, 1.0)
    flat = (counts / max(1e-9, float(np.linalg.norm(counts)))) @ projection
    return np.minimum((1 << AXIS_BITS) - 1, ((1 << AXIS_BITS) / (1 + np.exp(-2.0 * flat))).astype(np.int64))


def hilbert(cells: np.ndarray, bits: int = AXIS_BITS) -> np.ndarray:
    """Hilbert indices of cells (rows, axes): the transposed index by exchanging and inverting axes, then Gray decoding."""
    x = np.array(cells, dtype=np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            t = (x[0] ^ x[i]) & p
            x[0] = np.where(high, x[0] ^ p, x[0] ^ t)
            if i:
                x[i] = np.where(high, x[i], x[i] ^ t)
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where(x[n - 1] & q, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    out = np.zeros_like(t)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


def tokenized(docs: DataFrame, vocabulary: str, end_id: int = END_ID) -> DataFrame:
    """doc_id, key, n, ids (binary, two bytes an id; four where the vocabulary is larger) of each row."""
    kinds = [("doc_id", pa.int64()), ("key", pa.int64()), ("n", pa.int64()), ("ids", pa.binary())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, projection, end = word_bpe(vocabulary), _projection(), np.array([end_id], dtype="<u4")
        for batch in batches:
            ids = [np.append(encoder.ids(t.as_py() or ""), end) for t in batch.column(1)]
            if ids:
                key = hilbert(np.stack([point(x, projection) for x in ids]))
                columns = [batch.column(0), pa.array(key, pa.int64()), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.astype(_width(vocabulary)).tobytes() for x in ids], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, [k for k, _ in kinds])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, key long, n long, ids binary")


def _width(vocabulary: str) -> str:
    return "<u2" if word_bpe(vocabulary).library.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"


def _packed(vocabulary: str, length: int):
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width, sequence, offset = _width(vocabulary), TaskContext.get().partitionId() << 40, 0
        waiting: list[tuple] = []  # the pieces of the open sequence: doc_id, start, ids, doc_tokens
        out: list[tuple] = []

        def close(pieces: list[tuple], number: int) -> None:
            at = 0
            for name, start, ids, total in pieces:
                out.append((name, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, number, at))
                at += len(ids)

        def batch_of_rows() -> pa.RecordBatch:
            rows = [pa.array(c, pa.int64()) for c in zip(*out, strict=True)]
            out.clear()
            return pa.RecordBatch.from_arrays(rows, names)

        for batch in batches:
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids, at = np.frombuffer(raw.as_py(), dtype=width), 0
                while at < len(ids):
                    take = min(len(ids) - at, length - offset)
                    waiting.append((name, at, ids[at : at + take], len(ids)))
                    at, offset = at + take, offset + take
                    if offset == length:
                        close(waiting, sequence)
                        waiting, sequence, offset = [], sequence + 1, 0
            if len(out) >= 2000:
                yield batch_of_rows()
        while offset:  # the rest, largest power of two first
            size, pieces = 1 << (offset.bit_length() - 1), []
            while size:
                name, start, ids, total = waiting.pop(0)
                pieces.append((name, start, ids[:size], total))
                if len(ids) > size:
                    waiting.insert(0, (name, start + size, ids[size:], total))
                size, offset = size - len(pieces[-1][2]), offset - len(pieces[-1][2])
            close(pieces, sequence)
            sequence += 1
        if out:
            yield batch_of_rows()

    return run


def pack(docs: DataFrame, vocabulary: str, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """The pieces of all rows of docs: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A sequence has length ids, or fewer at a power of two: no padding at all. Null and empty texts are their end id
    alone; repeated rows and rows of one doc_id are packed one by one; a null doc_id stays null; an empty table gives
    no rows. Only doc_id and text are read, so other columns may have any name.
    """
    spark = docs.sparkSession
    tune(spark)
    # written once: the range partitioner looks at its input twice
    rows = materialize(tokenized(docs, vocabulary, end_id), "packing")
    order = [F.col("key"), F.col("doc_id").asc_nulls_first(), F.xxhash64("ids")]
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    along = rows.repartitionByRange(partitions, *order).sortWithinPartitions(*order).select("doc_id", "ids")
    return along.mapInArrow(_packed(vocabulary, length), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), vocabulary_path("word_bpe_49k.json"))
