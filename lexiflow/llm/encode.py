"""Token ids of whole texts, fast: words that recur are encoded once a worker.

The byte-level vocabulary splits a text by a pattern before it merges, and a
single white-space character between two visible ones always ends a piece, so
the ids of a text are those of its parts cut there.  Parts are looked up by a
hash and then compared byte by byte with what is remembered; each new one goes
through the tokenizer itself, as it is loaded (its special tokens are found in
texts).  Cuts are made only beside characters known to be visible (ASCII, and
U+00C0 to U+00FF); all else stays within a longer part.
"""

from __future__ import annotations

import os
from itertools import chain

import numpy as np

from .textops import BYTE_VALUE, U64, Rolling, expand, per_document

_SEEN = np.zeros(256, bool)
_SEEN[0x21:0x7F] = True


def same_bytes(a: np.ndarray, at_a: np.ndarray, b: np.ndarray, at_b: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Whether spans (none empty) of a and b have the same bytes."""
    if not len(lengths):
        return np.zeros(0, bool)
    equal = a[expand(at_a, at_a + lengths)] == b[expand(at_b, at_b + lengths)]
    return np.logical_and.reduceat(equal, np.cumsum(lengths) - lengths)


def _grown(array: np.ndarray, size: int) -> np.ndarray:
    while len(array) < size:
        array = np.concatenate((array, np.zeros_like(array)))
    return array


class Memory:
    """Parts with their bytes and ids, found by hash and compared."""

    def __init__(self, wide: bool):
        #: hashes in order and numbers of parts: all but the latest, and the latest
        self.known = [(np.zeros(0, U64), np.zeros(0, np.int32)) for _ in range(2)]
        self.size = self.n_ids = self.n_bytes = 0
        self.ids, self.bytes = np.zeros(1 << 16, np.uint32 if wide else np.uint16), np.zeros(1 << 18, np.uint8)
        self.begin, self.count, self.at, self.length = (np.zeros(1 << 14, np.int32) for _ in range(4))

    def find(self, keys: np.ndarray, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Numbers of parts that are remembered, -1 for others."""
        place = np.full(len(keys), -1, np.int64)
        for have, numbers in self.known:
            if len(have):
                at = np.minimum(np.searchsorted(have, keys), len(have) - 1)
                k = np.flatnonzero((have[at] == keys) & (place < 0))
                found = numbers[at[k]].astype(np.int64)
                fits = self.length[found] == length[k]
                k, found = k[fits], found[fits]
                same = same_bytes(data, start[k], self.bytes, self.at[found].astype(np.int64), length[k])
                place[k[same]] = found[same]
        return place

    def add(self, keys: np.ndarray, data: np.ndarray, start: np.ndarray, length: np.ndarray, flat: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Numbers of the new parts."""
        n = self.size + len(keys)
        number = np.arange(self.size, n)
        self.ids, self.bytes = _grown(self.ids, self.n_ids + len(flat)), _grown(self.bytes, self.n_bytes + int(length.sum()))
        self.begin, self.count, self.at, self.length = (_grown(x, n) for x in (self.begin, self.count, self.at, self.length))
        self.ids[self.n_ids : self.n_ids + len(flat)] = flat
        self.bytes[self.n_bytes : self.n_bytes + int(length.sum())] = data[expand(start, start + length)]
        self.begin[number], self.count[number] = self.n_ids + np.cumsum(count) - count, count
        self.at[number], self.length[number] = self.n_bytes + np.cumsum(length) - length, length
        self.size, self.n_ids, self.n_bytes = n, self.n_ids + len(flat), self.n_bytes + int(length.sum())
        self.known[1] = self._merged(self.known[1], (keys, number.astype(np.int32)))
        if len(self.known[1][0]) > 100_000:
            self.known = [self._merged(*self.known), (keys[:0], np.zeros(0, np.int32))]
        return number

    def ids_of(self, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each)."""
        begin, count = self.begin[number].astype(np.int64), self.count[number].astype(np.int64)
        return self.ids[expand(begin, begin + count)].astype(np.uint32), count

    @staticmethod
    def _merged(a, b):
        keys, numbers = np.concatenate((a[0], b[0])), np.concatenate((a[1], b[1]))
        order = np.argsort(keys, kind="stable")
        return keys[order], numbers[order]


class Encoder:
    """ids(data, bounds) of documents; remembers two generations of up to `keep` parts (and those of one call) each."""

    def __init__(self, path: str, keep: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.keep = keep
        # a byte-level token's text has a character for each byte
        vocab = self.tokenizer.get_vocab()
        self.widths = np.zeros(max(vocab.values()) + 1, np.int64)
        for token, number in vocab.items():
            self.widths[number] = len(token)
        #: whether ids need more than two bytes
        self.wide = len(self.widths) > 1 << 16
        self.new, self.old = Memory(self.wide), Memory(self.wide)

    def parts(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Starts of the parts."""
        n = len(data)
        cut = np.zeros(n + 1, bool)
        if n > 2:
            seen = _SEEN[data]
            after = seen[2:] | (data[2:] == 0xC3)
            before = seen[:-2].copy()
            before[1:] |= (data[:-3] == 0xC3) & (data[1:-2] >= 0x80) & (data[1:-2] < 0xC0)
            here = before & after
            cut[1 : n - 1] |= here & (data[1:-1] == 0x20)
            lines = here & (data[1:-1] == 0x0A)
            cut[1 : n - 1] |= lines
            cut[2:n] |= lines
        cut[bounds[:-1]] = True
        return np.flatnonzero(cut[:n])

    def ids(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds of each document's ids)."""
        start = self.parts(data, bounds)
        length = np.diff(np.append(start, len(data)))
        keys, first, which = np.unique(Rolling(BYTE_VALUE[data]).spans(start, start + length), return_index=True, return_inverse=True)
        # parts of one hash and other bytes stand alone
        twin = first[which]
        odd = length != length[twin]
        even = np.flatnonzero(~odd & (twin != np.arange(len(start))))
        odd[even] = ~same_bytes(data, start[even], data, start[twin[even]], length[even])
        odd = np.flatnonzero(odd)
        which[odd] = len(first) + np.arange(len(odd))
        keys, first = np.append(keys, keys[which[twin[odd]]]), np.append(first, odd)
        low, size = start[first], length[first]

        if self.new.size + len(first) > self.keep:
            self.old, self.new = self.new, Memory(self.wide)
        place = self.new.find(keys, data, low, size)
        missing = np.flatnonzero(place < 0)
        if len(missing):
            old = self.old.find(keys[missing], data, low[missing], size[missing])
            known = old >= 0
            moved, fresh = missing[known], missing[~known]
            for at, found in ((moved, lambda: self.old.ids_of(old[known])), (fresh, lambda: self._encode(data, low[fresh], low[fresh] + size[fresh]))):
                if len(at):
                    place[at] = self.new.add(keys[at], data, low[at], size[at], *found())
        ids, count = self.new.ids_of(place[which])
        total = per_document(count, np.searchsorted(start, bounds, "left"))
        return ids, np.concatenate(([0], np.cumsum(total)))

    def documents(self, data: np.ndarray, bounds: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ends of each document's ids) with end_id behind each document."""
        ids, bounds = self.ids(data, bounds)
        ends = bounds[1:] + np.arange(1, len(bounds))
        full = np.full(len(ids) + len(ends), end_id, np.uint32)
        body = np.ones(len(full), bool)
        body[ends - 1] = False
        full[body] = ids
        return full, ends

    def _encode(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each part) of new parts.

        Parts that begin with a cut space are encoded joined, as they would stand
        in a text, and told apart by the bytes of their ids; others alone.
        """
        lengths = end - start
        ends_seen = _SEEN[data[end - 1]]
        joined = (data[start] == 0x20) & ends_seen & (lengths > 1) & _SEEN[data[np.minimum(start + 1, len(data) - 1)]]
        order = np.concatenate((np.flatnonzero(joined), np.flatnonzero(~joined)))
        n = int(joined.sum())
        raw = data[expand(start[order], end[order])].tobytes()
        stop = np.concatenate(([0], np.cumsum(lengths[order])))
        cuts = [*stop[: n + 1 : 64].tolist()] if n else [0]
        if n and cuts[-1] != stop[n]:
            cuts.append(int(stop[n]))
        cuts += stop[n + 1 :].tolist()
        texts = [raw[a:b].decode("utf-8") for a, b in zip(cuts[:-1], cuts[1:])]
        found = [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        flat = np.fromiter(chain.from_iterable(found), np.uint32, sum(map(len, found)))
        at = np.cumsum(self.widths[flat], dtype=np.int64)
        upto = np.searchsorted(at, stop[1:], "right")
        count = np.diff(np.concatenate(([0], upto)))
        # back in the order asked for
        counts = np.empty(len(order), np.int64)
        counts[order] = count
        begin = np.empty(len(order), np.int64)
        begin[order] = upto - count
        return flat[expand(begin, begin + counts)], counts


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each worker process and vocabulary."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
