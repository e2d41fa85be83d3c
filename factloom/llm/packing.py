"""Packing along a space-filling curve.

A document's ids are hashed into a count vector, which a fixed sign matrix projects to three dimensions;
their Hilbert index is the document's place on the curve. Rows are range-sorted by (index, doc_id), so
that ties, exact copies too, spread over tasks, and each range is packed by one task in curve order.
Whole runs of `length` ids fill sequences of their own; what is left of each document joins its
neighbours' in shared sequences. A range's last sequence is cut into powers of two, which need no padding.

Null text: empty, one piece that holds the closing id alone. Null doc_id: packed like any other, last
among its curve ties. Ties on the curve: by doc_id; rows that share that too in any order. Repeated rows: packed once
each. Very long texts: whole, as many full sequences as they fill. Other columns, whatever their names, are not read.
Empty table: no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import encoder, vocabulary_path
from .common import lean, table, texts, written

LENGTH = 1024
DIMENSIONS, BITS, BUCKETS = 3, 10, 256
END_ID = 0
#: A range, one task's work, holds about so many documents and leftover ids; there is no limit to the number of ranges.
RANGE_DOCUMENTS, RANGE_IDS = 20_000, 8_000_000


def hilbert_index(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Indices on the Hilbert curve of integer points (rows), each coordinate of `bits` bits."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:  # undo the rotations, from the highest bit on
        p = q - 1
        for i in range(n):
            on = (x[i] & q) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(on, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):  # Gray code
        x[i] ^= x[i - 1]
    t, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        t = np.where(x[n - 1] & q, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = out << 1 | (x[i] >> b & 1)
    return out


def _projection() -> np.ndarray:
    return np.random.default_rng(7).choice([-1.0, 1.0], (BUCKETS, DIMENSIONS))


def _curve(vectors: np.ndarray) -> np.ndarray:
    norm = np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
    at = np.clip((vectors / norm @ _projection() + 2) / 4, 0, 1)
    return hilbert_index((at * ((1 << BITS) - 1)).astype(np.int64))


def _encoded(documents: DataFrame, tokenizer_path: str, length: int) -> DataFrame:
    """Per document: its curve index, the checksums of its whole runs, and the ids that are left."""

    def encode(batches):
        of = encoder(tokenizer_path)
        for batch in batches:
            vectors, rows = np.zeros((batch.num_rows, BUCKETS)), []
            for k, text in enumerate(batch.column("text").to_pylist()):
                ids = np.append(of.ids(text), np.uint32(END_ID)).astype("<u4")
                vectors[k] = np.bincount((ids * np.uint32(2654435761)) >> np.uint32(24), minlength=BUCKETS)
                whole = len(ids) // length
                rows.append(([zlib.crc32(ids[i * length : (i + 1) * length]) for i in range(whole)], ids[whole * length :].tobytes(), len(ids)))
            columns = [pa.array(_curve(vectors), pa.int64()), batch.column("doc_id"), pa.array([r[2] for r in rows], pa.int64()), pa.array([r[0] for r in rows], pa.list_(pa.int64())), pa.array([r[1] for r in rows], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["curve", "doc_id", "doc_tokens", "runs", "rest"])

    return texts(documents).mapInArrow(lean(encode), "curve long, doc_id long, doc_tokens long, runs array<long>, rest binary")


def _powers(n: int) -> list[int]:
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


def pack(documents: DataFrame, tokenizer_path: str, length: int = LENGTH, ranges: int | None = None) -> DataFrame:
    """Pieces: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    encoded = written(_encoded(documents, tokenizer_path, length), "packing")
    if ranges is None:
        size = encoded.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.col("doc_tokens") % length), F.lit(0)).alias("ids")).first()
        ranges = 1 + max(size["n"] // RANGE_DOCUMENTS, size["ids"] // RANGE_IDS)

    def fill(batches):
        sequence = TaskContext.get().partitionId() << 40
        open_pieces, used = [], 0  # of the sequence that is being filled

        def closed(pieces):
            nonlocal sequence
            at, out = 0, []
            for doc, start, ids, tokens in pieces:
                out.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), tokens, sequence, at))
                at += len(ids)
            sequence += 1
            return out

        columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        batch_of = lambda out: pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*out) if out else [()] * 7)], columns)
        for batch in batches:
            out = []
            for doc, tokens, runs, rest in zip(*(batch.column(x).to_pylist() for x in ("doc_id", "doc_tokens", "runs", "rest"))):
                for i, crc in enumerate(runs):
                    out.append((doc, i * length, length, crc, tokens, sequence, 0))
                    sequence += 1
                ids, start = np.frombuffer(rest, "<u4"), len(runs) * length
                while len(ids):
                    piece = ids[: length - used]
                    open_pieces.append((doc, start, piece, tokens))
                    used, start, ids = used + len(piece), start + len(piece), ids[len(piece) :]
                    if used == length:
                        out += closed(open_pieces)
                        open_pieces, used = [], 0
            yield batch_of(out)
        out = []
        for size in _powers(used):  # the last sequence, cut so that nothing is padded
            part, room = [], size
            while room:
                doc, start, ids, tokens = open_pieces.pop(0)
                part.append((doc, start, ids[:room], tokens))
                if len(ids) > room:
                    open_pieces.insert(0, (doc, start + room, ids[room:], tokens))
                room -= min(room, len(ids))
            out += closed(part)
        yield batch_of(out)

    dealt = encoded.repartitionByRange(ranges, F.col("curve"), F.col("doc_id").asc_nulls_last()).sortWithinPartitions("curve", F.col("doc_id").asc_nulls_last())
    return dealt.mapInArrow(lean(fill), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), vocabulary_path())
