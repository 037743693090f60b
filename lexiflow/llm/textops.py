"""Vectorised helpers over ragged UTF-8 text (numpy views of Arrow buffers).

Texts are handled as concatenated byte arrays with document bounds.  A null
text counts as empty everywhere.  Work is done in slices of a few megabytes so
that memory does not follow the size of an Arrow batch; only where an operator
says so is a long document one slice.

Hashes here are filters: they pick positions and deal rows, and equal ones may
come from unequal text.  Whatever is removed, reused or counted as equal is
compared by its bytes or words.
"""

from __future__ import annotations

import ctypes
import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_MULT = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2**64
_INVERSE = pow(_MULT, -1, 1 << 64)
_POWERS = [np.ones(1, U64), np.ones(1, U64)]

SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; a bijection."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


BYTE_VALUE = mix(np.arange(1, 257, dtype=U64) * U64(0xD6E8FEB86659FD93))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_MULT, _INVERSE)):
            full = np.full(n, base, U64)
            full[0] = 1
            _POWERS[k] = np.cumprod(full, dtype=U64)
    return _POWERS[0], _POWERS[1]


class Rolling:
    """Filter hashes of any span of a token sequence in constant time per span."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        power, self.inverse = _powers(n + 1)
        self.sums = np.zeros(n + 1, U64)
        np.cumsum(values * power[:n], dtype=U64, out=self.sums[1:])

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        lengths = (end - start).astype(U64)
        return mix((self.sums[end] - self.sums[start]) * self.inverse[start] + lengths * U64(0xA24BAED4963EE407))


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Filter hashes of two neighbouring parts from theirs."""
    x = a * U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(32)
    x += b
    x *= U64(0x9E3779B97F4A7C15)
    x ^= x >> U64(29)
    return x


def window_hashes(values: np.ndarray, width: int, k: int) -> np.ndarray:
    """Filter hashes of k tokens from each position, from those of `width` tokens (k >= width) by doubling."""
    n = len(values) + width - k
    if n <= 0:
        return values[:0]
    while 2 * width <= k:
        values = joined(values[:-width], values[width:])
        width *= 2
    return joined(values[:n], values[k - width : k - width + n]) if width < k else values[:n]


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position (zeros behind the end) as numbers that order like the bytes."""
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    return np.ndarray((len(data),), ">u8", padded.data, 0, (1,)).astype(U64)


def sliding_min(values: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values."""
    n, width = len(values) - w + 1, 1
    if n <= 0:
        return values[:0]
    while width * 2 <= w:
        values = np.minimum(values[:-width], values[width:])
        width *= 2
    return np.minimum(values[:n], values[w - width : w - width + n])


def ragged(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, bounds) of a string or binary column; document i is bytes[bounds[i]:bounds[i + 1]]."""
    if isinstance(texts, pa.ChunkedArray):
        if texts.num_chunks > 1 and texts.nbytes >= 1 << 30:
            texts = texts.cast(pa.large_binary())  # 32-bit offsets would not reach
        texts = texts.combine_chunks()
        if isinstance(texts, pa.ChunkedArray):
            texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], pa.string())
    if texts.null_count:
        texts = pc.fill_null(texts, b"" if pa.types.is_binary(texts.type) or pa.types.is_large_binary(texts.type) else "")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, bounds, data = texts.buffers()
    at = np.frombuffer(bounds, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def binaries(flat: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A binary column: values are flat's bytes from one end to the next."""
    bounds = np.concatenate(([0], ends)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(bounds.tobytes()), pa.py_buffer(flat.tobytes())])


def slices(bounds: np.ndarray, limit: int = 1 << 20):
    """Ranges (i, j) of whole documents of about `limit` bytes each."""
    i, n = 0, len(bounds) - 1
    while i < n:
        j = int(np.searchsorted(bounds, bounds[i] + limit, "right")) - 1
        j = min(n, max(i + 1, j))
        yield i, j
        i = j


def _pieces(data: np.ndarray, bounds: np.ndarray, limit: int):
    """(begin, end, documents' ends in it) of ranges that end with a document or behind a separator."""
    for i, j in slices(bounds, limit):
        begin, end = int(bounds[i]), int(bounds[j])
        while end - begin > 2 * limit:  # a long document
            at = begin + limit
            while at < end:
                apart = np.flatnonzero(SEPARATOR[data[at : min(end, at + 4096)]])
                if len(apart):
                    at += int(apart[0]) + 1
                    break
                at += 4096
            if at >= end:
                break
            yield begin, at, bounds[:0]
            begin = at
        yield begin, end, bounds[i + 1 : j + 1]


class Words:
    """Words `[^\\x20\\x09-\\x0D]+` of documents, joined by single spaces.

    text: word bytes, one space after each word; start, end: word spans in it;
    first: document i has the words first[i]:first[i + 1]; bounds: the documents in text.
    Long documents are read in pieces.
    """

    def __init__(self, data: np.ndarray, bounds: np.ndarray, lower: bool = False, limit: int = 1 << 20):
        texts, ends, docs, size = [], [], [np.zeros(1, np.int64)], 0
        for begin, stop, cuts in _pieces(data, bounds, limit):
            part, cuts = data[begin:stop], cuts - begin
            spaced = np.full(len(part) + len(cuts), 0x20, np.uint8)  # a space behind each document
            shift = np.zeros(len(part) + 1, np.int64)
            np.add.at(shift, cuts, 1)
            spaced[np.arange(len(part)) + np.cumsum(shift)[:-1]] = part
            cuts = cuts + np.arange(1, len(cuts) + 1)
            apart = SEPARATOR[spaced]
            before = np.empty_like(apart)
            before[:1], before[1:] = True, apart[:-1]
            keep = ~(apart & before)
            place = np.zeros(len(spaced) + 1, np.int64)
            np.cumsum(keep, out=place[1:])
            text = (LOWER[spaced] if lower else spaced)[keep]
            blank = apart[keep]
            text[blank] = 0x20
            texts.append(text)
            ends.append(np.flatnonzero(blank) + size)
            docs.append(place[cuts] + size)
            size += len(text)
        self.text, self.end = concat(texts, np.uint8), concat(ends, np.int64)
        self.start = np.empty_like(self.end)
        if len(self.end):
            self.start[0] = 0
            self.start[1:] = self.end[:-1] + 1
        self.bounds = np.concatenate(docs)
        self.first = np.searchsorted(self.end, self.bounds, "left")


class Numbering(dict):
    """Numbers values in the order they are first asked for, exactly."""

    def __missing__(self, value):
        number = self[value] = len(self)
        return number

    def of(self, values, n: int) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, values), np.int64, n)


def groups(keys: np.ndarray) -> np.ndarray:
    """Starts of runs of equal values in a sorted array."""
    if not len(keys):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))


def expand(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """start[0]..end[0]-1, start[1]..end[1]-1, ..."""
    lengths = end - start
    if not len(lengths):
        return np.zeros(0, np.int64)
    shift = np.repeat(start - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths)
    return np.arange(int(lengths.sum())) + shift


def per_document(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values[first[i]:first[i + 1]], empty ranges included."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def concat(parts: list[np.ndarray], dtype) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, dtype)


def tidy() -> None:
    """Give freed memory back to the system: workers wait between tasks with what they hold."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # not glibc


def released(generate):
    """A generator function that tidies up when it ends."""

    @functools.wraps(generate)
    def run(*args):
        try:
            yield from generate(*args)
        finally:
            tidy()

    return run

