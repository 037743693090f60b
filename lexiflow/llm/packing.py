"""Packing along a space-filling curve.

Each document's token counts are hashed into a vector and projected to three
dimensions; the Hilbert key of that point orders the documents.  A document is
cut into full sequences and a rest.  Along the curve each rest goes to the open
sequence that it fills best; only the sequences begun last stay open, so what
is packed together lies near on the curve.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .encode import encoder
from .shared import shared_dir
from .textops import mix, ragged, released, slices, U64

BUCKETS, AXES, AXIS_BITS = 64, 3, 16


def _projection() -> np.ndarray:
    """Fixed random directions, from hashes (sums of twelve uniforms)."""
    u = mix(np.arange(1, BUCKETS * AXES * 12 + 1, dtype=U64)).astype(np.float64) / 2.0**64
    return u.reshape(BUCKETS, AXES, 12).sum(axis=2) - 6.0


def hilbert_keys(points: np.ndarray, bits: int = AXIS_BITS) -> np.ndarray:
    """Positions along the Hilbert curve of points (n, axes) of `bits` bits each.

    Skilling's method: undo the excess rotations from the top bit down, then
    Gray-decode across the axes and interleave.
    """
    x = [points[:, k].astype(np.int64) for k in range(points.shape[1])]
    axes = len(x)
    for b in range(bits - 1, 0, -1):
        q, low = 1 << b, (1 << b) - 1
        for k in range(axes):
            turned = (x[k] & q) != 0
            swap = np.where(turned, 0, (x[0] ^ x[k]) & low)
            x[0] = np.where(turned, x[0] ^ low, x[0] ^ swap)
            x[k] = x[k] ^ swap if k else x[0]
    for k in range(1, axes):
        x[k] ^= x[k - 1]
    flip = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        flip = np.where(x[-1] & (1 << b), flip ^ ((1 << b) - 1), flip)
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for k in range(axes):
            key = key << 1 | ((x[k] ^ flip) >> b & 1)
    return key


def curve_keys(ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hilbert keys of documents ids[ends[i-1]:ends[i]]."""
    n = len(ends)
    doc = np.repeat(np.arange(n), np.diff(np.concatenate(([0], ends))))
    bucket = (mix(ids.astype(U64) + U64(1)) & U64(BUCKETS - 1)).astype(np.int64)
    counts = np.bincount(doc * BUCKETS + bucket, minlength=n * BUCKETS).reshape(n, BUCKETS).astype(np.float64)
    counts /= np.maximum(np.sqrt((counts**2).sum(axis=1, keepdims=True)), 1.0)
    points = counts @ _projection()
    scaled = np.clip((points / 8.0 + 0.5) * (1 << AXIS_BITS), 0, (1 << AXIS_BITS) - 1)
    return hilbert_keys(scaled.astype(np.int64))


PIECES = "curve long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


@released
def _cut(vocabulary: str, end_id: int, size: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    coder = None
    for batch in batches:
        coder = coder or encoder(vocabulary)
        data, bounds = ragged(batch.column(1))
        doc_ids = batch.column(0).to_pylist()
        for i, j in slices(bounds):
            full, ends = coder.documents(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i], end_id)
            keys, raw, rows = curve_keys(full, ends).tolist(), memoryview(full.astype("<u4").tobytes()), []
            begin = 0
            for k, end in enumerate(ends.tolist()):
                for a in range(begin, end, size):
                    b = min(a + size, end)
                    rows.append((keys[k], doc_ids[i + k], a - begin, b - a, zlib.crc32(raw[4 * a : 4 * b]), end - begin))
                begin = end
            yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows)], names=["curve", "doc_id", "start", "length", "ids_crc32", "doc_tokens"])


class Bins:
    """Open sequences by room left, the `most` begun last; the fullest that fits is found by bit tricks."""

    def __init__(self, size: int, most: int):
        self.size, self.most = size, most
        self.rooms, self.by_room, self.left, self.next = 0, [[] for _ in range(size + 1)], {}, 0

    def put(self, length: int) -> tuple[int, int]:
        """(number of the sequence, place in it)."""
        room, number = self.size, -1
        while number < 0 and (fits := self.rooms >> length):
            room = length + (fits & -fits).bit_length() - 1
            stack = self.by_room[room]
            while stack and number < 0:
                if self.left.get(stack[-1]) == room:
                    number = stack[-1]
                stack.pop()  # taken, or closed meanwhile
            if not stack:
                self.rooms ^= 1 << room
        if number < 0:
            room, number = self.size, self.next
            self.next += 1
        left = room - length
        if left:
            self.left[number] = left
            self.by_room[left].append(number)
            self.rooms |= 1 << left
            if len(self.left) > self.most:
                del self.left[next(iter(self.left))]  # the one begun first
        else:
            self.left.pop(number, None)
        return number, self.size - room


@released
def _pack(size: int, most: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    bins, base = Bins(size, most), TaskContext.get().partitionId() << 40
    for batch in batches:
        put = [bins.put(n) for n in batch.column(3).to_pylist()]
        sequence, offset = np.array(put, np.int64).reshape(-1, 2).T
        yield pa.record_batch([*batch.columns, pa.array(sequence + base), pa.array(np.ascontiguousarray(offset))], names=[*batch.schema.names, "sequence_id", "offset"])


def pack(docs: DataFrame, vocabulary: str, size: int = 2048, end_id: int = 1, open_sequences: int = 256, part_pieces: int = 40_000) -> DataFrame:
    """Pieces of documents in sequences of at most `size` tokens, near ones together.

    Columns: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset,
    curve.  Every id lies in one piece; a document's pieces are full sequences
    and one rest.  A sequence is padded to `size`, unless its length is a power
    of two.  Null text: the end id alone.  Equal documents are told apart by
    doc_id in the order.  Null doc_ids and repeated rows are packed like any
    other; other columns, whatever their names, are ignored.  An empty table has
    no pieces.
    """
    shared_dir(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = docs.mapInArrow(partial(_cut, vocabulary, end_id, size), PIECES).checkpoint()
    parts = max(1, math.ceil(pieces.count() / part_pieces))
    order = ["curve", "doc_id", "start", "ids_crc32"]
    ordered = pieces.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    packed = ordered.mapInArrow(partial(_pack, size, open_sequences), PIECES + ", sequence_id long, offset long")
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "curve")
