"""Repeated token windows across documents: radix order of byte suffixes, doubling of word windows.

Texts are dealt into chunks once; three passes read them.

1. Candidates.  Of the digits (the first tokens of a suffix, less than half a
   window) that a window holds, it picks the one with the least hash; equal
   windows pick alike.  A chunk asks for the hashes of its picks, each once;
   buckets say which stand in several documents.  This only filters: a window
   whose pick stands nowhere else repeats nowhere, all others go on.
2. Order.  Of each run of windows with an open pick the chunk sends the tokens
   themselves, equal runs once.  A bucket has all runs of its picks, so all
   equal windows meet there.  Runs of the same bytes are one; where a pick has
   different runs, their windows are put in groups of equal ones:
   * bytes (`radix`): most-significant-digit passes of eight bytes over the
     suffixes; a group that is not of several documents leaves, the others go
     on to the next digit, through the threshold and no deeper;
   * words (`doubling`): windows that repeat at one length alone are extended
     to twice that length, until it reaches the threshold or none is left.
   The groups left hold the repeated windows exactly.  The bucket answers with
   one bit a window: whether it also starts in a document with a smaller id.
3. Removal, by the chunk, which computes its runs again.

Hot picks: a pick that stands in more than `most` runs is split; each of its
windows goes to a bucket by a hash of its own, so a bucket gets a window once a
chunk at most, however many documents have it.
"""

from __future__ import annotations

import hashlib
import math
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textops import BYTE_VALUE, Numbering, Rolling, U64, Words, binaries, concat, eights, expand, groups, joined, mix, ragged, sliding_min, tidy, window_hashes

ASKED = "bucket long, chunk long, keys binary"
OPEN = "chunk long, keys binary"
SENT = "bucket long, chunk long, keys binary, docs binary, wins binary, sizes binary, tokens binary"
TOLD = "chunk long, bucket long, bits binary"
RESULT = "doc_id long, n_tokens long, n_removed long, n_spans long, kept_sha256 string, kept binary"
#: Tokens of a text that are hashed at once.
BLOCK = 1 << 18
#: Windows that are ordered at once, and those of one pick.
WINDOWS = 1 << 18
#: Windows of a run; longer ones, of texts that repeat themselves, are cut, and equal cuts are sent once.
MOST_RUN = 1 << 15
#: Low bits of a key: whether several documents have it, and the power of two of its number of runs.
FLAGS = 6


class Plan:
    """Tokens `bytes` or `words`, tokens a window and a digit, buckets, and the runs that make a pick hot."""

    def __init__(self, tokens: str, length: int, buckets: int, most: int):
        self.tokens, self.length, self.buckets, self.most = tokens, length, buckets, most
        self.digit = max(1, length * 2 // 5) if tokens == "bytes" else (length + 1) // 2

    def bucket(self, keys: np.ndarray) -> np.ndarray:
        """Buckets by the leading bits."""
        return ((keys >> U64(32)) * U64(self.buckets) >> U64(32)).astype(np.int64)


class Chunk:
    """Documents by doc_id, as tokens; rows without doc_id come last."""

    def __init__(self, plan: Plan, table: pa.Table):
        self.plan = plan
        rows = table.select(["doc_id", "text"]).sort_by("doc_id")
        self.ids = rows["doc_id"].combine_chunks()
        self.known = len(self.ids) - self.ids.null_count
        self.doc_id = self.ids.fill_null(0).to_numpy(zero_copy_only=False)
        data, bounds = ragged(rows["text"])
        if plan.tokens == "bytes":
            self.data, self.first = data, bounds
        else:
            self.words = w = Words(data, bounds)
            self.data, self.first = w.text, w.first
        self.raw = self.data.tobytes()
        # rows without a doc_id neither lose nor lend anything
        self.last = int(self.first[self.known])
        self._runs()

    def bytes_of(self, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place in data of tokens start:end."""
        if self.plan.tokens == "bytes":
            return start, end
        return self.words.start[start], self.words.end[end - 1]

    def hashes(self, a: int, b: int, k: int) -> np.ndarray:
        """Filter hashes of the k tokens from each position, of tokens a:b."""
        if self.plan.tokens == "bytes":
            values, width = eights(self.data[a:b]), 8
            if k <= width:
                return joined(values >> U64(64 - 8 * k), U64(k))[: max(0, b - a - k + 1)]
            return window_hashes(values[: max(0, b - a - width + 1)], width, k)
        if a >= b:
            return np.zeros(0, U64)
        w, at = self.words, int(self.words.start[a])
        values = Rolling(BYTE_VALUE[w.text[at : w.end[b - 1]]]).spans(w.start[a:b] - at, w.end[a:b] - at)
        return window_hashes(values, 1, k)

    def _runs(self) -> None:
        """Runs [start, end) of windows with one pick, key (without flags), and doc (its place)."""
        plan, starts, ends, keys = self.plan, [], [], []
        for a in range(0, self.last, BLOCK):
            b = min(self.last, a + BLOCK)
            stop = min(self.last, b + plan.length - 1)
            least = sliding_min(self.hashes(a, stop, plan.digit), plan.length - plan.digit + 1)[: b - a]
            n = len(least)
            if not n:
                continue
            # windows that reach over a document's end don't count
            bounds = self.first[np.searchsorted(self.first, a, "right") : np.searchsorted(self.first, stop, "right")]
            closed = np.zeros(n + 1, np.int32)
            np.add.at(closed, np.clip(bounds - plan.length + 1 - a, 0, n), 1)
            np.add.at(closed, np.clip(bounds - a, 0, n), -1)
            usable = np.cumsum(closed[:-1]) == 0
            change = np.ones(n, bool)
            change[1:] = (least[1:] != least[:-1]) | (usable[1:] != usable[:-1])
            start = np.flatnonzero(change)
            ok = usable[start]
            end = np.append(start[1:], n)[ok]
            start = start[ok]
            cuts = -(-(end - start) // MOST_RUN)
            of = np.repeat(np.arange(len(start)), cuts)
            start = start[of] + MOST_RUN * (np.arange(len(of)) - np.repeat(np.cumsum(cuts) - cuts, cuts))
            end = np.minimum(start + MOST_RUN, end[of])
            starts.append(start + a)
            ends.append(end + a)
            # least hashes are small ones: mixed, they spread over all buckets
            keys.append(mix(least[start]) >> U64(FLAGS) << U64(FLAGS))
        self.start, self.end, self.key = concat(starts, np.int64), concat(ends, np.int64), concat(keys, U64)
        # runs of neighbouring documents are never one: a document's last windows are not usable
        self.doc = np.searchsorted(self.first, self.start, "right") - 1

    def picks(self) -> np.ndarray:
        """The keys, each once and in order, with flags."""
        order = np.argsort(self.key, kind="stable")
        start = groups(self.key[order])
        if not len(start):
            return self.key
        end = np.append(start[1:], len(order))
        ids = self.doc_id[self.doc[order]]
        several = ids[start] != ids[end - 1]
        power = np.minimum(31, np.ceil(np.log2(end - start)).astype(np.int64))
        return self.key[order[start]] | several.astype(U64) | power.astype(U64) << U64(1)

    def entries(self, keys: np.ndarray) -> Entries:
        """What is sent of the runs whose keys (with a flag for hot ones) are open."""
        plan, known = self.plan, keys >> U64(FLAGS)
        at = np.minimum(np.searchsorted(known, self.key >> U64(FLAGS)), max(0, len(known) - 1))
        is_open = known[at] == self.key >> U64(FLAGS) if len(known) else np.zeros(len(self.key), bool)
        run = np.flatnonzero(is_open)
        hot = (keys[at[run]] & U64(1)).astype(bool)
        size = (self.end - self.start)[run]
        pieces = np.where(hot, size, 1)
        of = np.repeat(np.arange(len(run)), pieces)
        start = self.start[run][of] + np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        wins = np.where(hot, 1, size)[of]
        key = self.key[run][of]
        if hot.any():
            single = hot[of]
            key[single] = np.concatenate([self.hashes(s, e + plan.length - 1, plan.length) for s, e in zip(self.start[run[hot]].tolist(), self.end[run[hot]].tolist())])
        return Entries(self, start, wins, key, self.doc[run][of], hot[of])


class Entries:
    """Stretches of windows, and the distinct ones in the order they are sent."""

    def __init__(self, chunk: Chunk, start: np.ndarray, wins: np.ndarray, key: np.ndarray, doc: np.ndarray, hot: np.ndarray):
        plan = chunk.plan
        self.start, self.wins, self.doc_id = start, wins, chunk.doc_id[doc]
        low, high = chunk.bytes_of(start, start + wins + plan.length - 1) if len(start) else (start, start)
        raw = chunk.raw
        numbers = Numbering()
        which = numbers.of((raw[a:b] for a, b in zip(low.tolist(), high.tolist())), len(start))
        # documents ascend, so the first of equal ones has the least doc_id
        _, first = np.unique(which, return_index=True)
        bucket = plan.bucket(key[first]) + np.where(hot[first], plan.buckets, 0)
        order = np.lexsort((key[first], bucket))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.which, first = place[which], first[order]
        self.first, self.bucket, self.key = first, bucket[order], key[first]
        self.low, self.high = low[first], high[first]

    def lost(self, bits: np.ndarray) -> np.ndarray:
        """Positions of windows that go, ascending, from the answered bits of the distinct ones."""
        wins = self.wins[self.first]
        begin = np.cumsum(wins) - wins
        at = expand(self.start, self.start + self.wins)
        own = bits[expand(begin[self.which], begin[self.which] + self.wins)]
        later = self.doc_id > self.doc_id[self.first][self.which]
        return at[own | np.repeat(later, self.wins)]


def by_bucket(bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, end) of equal buckets."""
    start = groups(bucket)
    return start, np.append(start[1:], len(bucket)) if len(start) else start


def ask(plan: Plan, docs: pa.Table) -> pa.Table:
    """Pass 1 of a chunk: its picks by bucket."""
    keys = Chunk(plan, docs).picks()
    start, end = by_bucket(bucket := plan.bucket(keys))
    chunk = np.full(len(start), docs["chunk"][0].as_py())
    return pa.table([pa.array(bucket[start]), pa.array(chunk), binaries(keys, 8 * end)], names=["bucket", "chunk", "keys"])


def open_picks(plan: Plan, asked: pa.Table) -> pa.Table:
    """Pass 1 of a bucket: for each chunk its keys that stand in several documents; bit 0: hot."""
    raw, bounds = ragged(asked["keys"])
    keys = raw.view(U64) if raw.flags.aligned and len(raw) % 8 == 0 else np.frombuffer(raw.tobytes(), U64)
    order = np.argsort(keys >> U64(FLAGS), kind="stable")
    start = groups((keys >> U64(FLAGS))[order])
    count = np.diff(np.append(start, len(order)))
    several = (count > 1) | (np.maximum.reduceat((keys & U64(1))[order], start) > 0) if len(start) else np.zeros(0, bool)
    runs = np.add.reduceat(U64(1) << ((keys[order] >> U64(1)) & U64(31)), start) if len(start) else start
    is_open, hot = np.empty(len(order), bool), np.empty(len(order), bool)
    is_open[order], hot[order] = np.repeat(several, count), np.repeat(runs > plan.most, count)
    ends = np.cumsum(is_open)[bounds[1:] // 8 - 1] if len(keys) else bounds[1:]
    found = keys[is_open] >> U64(FLAGS) << U64(FLAGS) | hot[is_open].astype(U64)
    some = np.diff(np.concatenate(([0], ends))) > 0
    return pa.table([asked["chunk"].filter(pa.array(some)).combine_chunks(), binaries(found, 8 * ends[some])], names=["chunk", "keys"])


def _open_keys(table: pa.Table) -> np.ndarray:
    return np.sort(np.frombuffer(ragged(table["keys"])[0].tobytes(), U64))


def _blank(names: str) -> pa.Table:
    kinds = {"long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    fields = [f.split() for f in names.split(", ")]
    return pa.table([pa.array([], kinds[k]) for _, k in fields], names=[n for n, _ in fields])


def send(plan: Plan, docs: pa.Table, told: pa.Table) -> pa.Table:
    """Pass 2 of a chunk: the tokens of its open runs by bucket."""
    if not docs.num_rows or not told.num_rows:
        return _blank(SENT)
    c = Chunk(plan, docs)
    e = c.entries(_open_keys(told))
    start, end = by_bucket(e.bucket)
    sizes = e.high - e.low
    tokens = c.data[expand(e.low, e.high)]
    upto = np.cumsum(sizes)
    return pa.table(
        [
            pa.array(e.bucket[start]),
            pa.array(np.full(len(start), docs["chunk"][0].as_py())),
            binaries(e.key, 8 * end),
            binaries(e.doc_id[e.first].astype("<i8"), 8 * end),
            binaries(e.wins[e.first].astype("<u4"), 4 * end),
            binaries(sizes.astype("<u4"), 4 * end),
            binaries(tokens, upto[end - 1] if len(end) else end),
        ],
        names=[f.split()[0] for f in SENT.split(", ")],
    )


def spread(values: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of sorted values: starts of equal ones, their number, and the least doc where docs differ, else -1."""
    start = groups(values)
    count = np.diff(np.append(start, len(values)))
    least, most = np.minimum.reduceat(doc, start), np.maximum.reduceat(doc, start)
    return start, count, np.where(least < most, least, -1)


def radix(data: np.ndarray, at: np.ndarray, doc: np.ndarray, length: int) -> np.ndarray:
    """Least doc (places, from 0) of the windows of `length` bytes equal to each window at `at`, by MSD passes."""
    out, digits = doc.copy(), eights(data)
    left, group = np.arange(len(at)), np.zeros(len(at), np.int64)
    for depth in range(0, length, 8):
        if not len(left):
            break
        digit = digits[at[left] + depth]
        if length - depth < 8:
            digit >>= U64(8 * (8 - length + depth))
        order = np.argsort(digit, kind="stable") if not depth else np.lexsort((digit, group))
        left, group, digit = left[order], group[order], digit[order]
        number = np.cumsum(np.concatenate(([False], (group[1:] != group[:-1]) | (digit[1:] != digit[:-1]))))
        _, count, least = spread(number, doc[left])
        goes_on = np.repeat(least >= 0, count)
        if depth + 8 >= length:  # equal through the whole depth
            out[left[goes_on]] = np.repeat(least, count)[goes_on]
        left, group = left[goes_on], number[goes_on]
    return out


def doubling(word: np.ndarray, end: np.ndarray, doc: np.ndarray, length: int) -> np.ndarray:
    """The same for windows of `length` words at each position (exact word numbers; end: where its stretch ends)."""
    out, name, at, size = doc.copy(), word, np.arange(len(word)), 1
    alive = np.ones(len(word) + length, bool)
    alive[len(word) :] = False
    names = np.zeros(len(word) + length, np.int64)
    while len(at):
        order = np.argsort(name, kind="stable")
        at, name = at[order], name[order]
        _, count, least = spread(name, doc[at])
        repeated = np.repeat(least >= 0, count)
        if size == length:
            out[at[repeated]] = np.repeat(least, count)[repeated]
            break
        alive[:] = False
        alive[at[repeated]] = True
        names[at] = np.repeat(np.arange(len(count)), count)
        step = min(size, length - size)
        at = at[repeated]
        at = at[alive[at + step] & (at + size + step <= end[at])]
        size += step
        name = names[at] * (len(count) + 1) + names[at + step]
    return out


def settle(plan: Plan, sent: pa.Table) -> pa.Table:
    """Pass 2 of a bucket: for each window sent whether it starts in a document with a smaller doc_id."""

    def column(name: str, dtype) -> np.ndarray:
        return np.frombuffer(ragged(sent[name])[0].tobytes(), dtype)

    keys, docs, wins, sizes = column("keys", U64), column("docs", "<i8"), column("wins", "<u4").astype(np.int64), column("sizes", "<u4").astype(np.int64)
    tokens, _ = ragged(sent["tokens"])
    raw, upto = tokens.tobytes(), np.cumsum(sizes)
    # stretches of the same bytes are one
    which = Numbering().of((raw[a:b] for a, b in zip((upto - sizes).tolist(), upto.tolist())), len(keys))
    _, first = np.unique(which, return_index=True)
    ids, rank = np.unique(docs, return_inverse=True)
    least = np.full(len(first), len(ids))
    np.minimum.at(least, which, rank)
    # windows of picks with different stretches are ordered, others are as old as their stretch
    order = np.argsort(keys[first], kind="stable")
    start = groups(keys[first][order])
    count = np.diff(np.append(start, len(order)))
    begin = np.cumsum(wins[first]) - wins[first]
    oldest = np.repeat(least, wins[first])
    mixed = order[np.repeat(count > 1, count)]
    # equal windows have one pick, so picks are ordered a few at a time
    upto_window = np.cumsum(wins[first[mixed]])
    pick = groups(keys[first[mixed]])
    batch = upto_window[pick] // WINDOWS
    for k in np.unique(batch):
        some = pick[batch == k]
        later = pick[batch > k]
        m = mixed[some[0] : later[0] if len(later) else len(mixed)]
        low, high = (upto - sizes)[first[m]], upto[first[m]]
        n = wins[first[m]]
        if plan.tokens == "bytes":
            data = tokens[expand(low, high)]
            at = np.cumsum(high - low) - (high - low)
            found = radix(data, expand(at, at + n), np.repeat(least[m], n), plan.length)
        else:
            words = b" ".join(raw[a:b] for a, b in zip(low.tolist(), high.tolist())).split(b" ")
            number = Numbering().of(words, len(words))
            size = n + plan.length - 1
            at = np.cumsum(size) - size
            found = doubling(number, np.repeat(at + size, size), np.repeat(least[m], size), plan.length)[expand(at, at + n)]
        oldest[expand(begin[m], begin[m] + n)] = found
    bits = oldest[expand(begin[which], begin[which] + wins)] < np.repeat(rank, wins)
    # a message's bits end in a byte of their own
    message = ragged(sent["keys"])[1] // 8
    upto = np.concatenate(([0], np.cumsum(wins)))[message]
    packed = [np.packbits(bits[a:b]) for a, b in zip(upto[:-1].tolist(), upto[1:].tolist())]
    return pa.table([sent["chunk"].combine_chunks(), sent["bucket"].combine_chunks(), binaries(concat(packed, np.uint8), np.cumsum([len(p) for p in packed]))], names=["chunk", "bucket", "bits"])


def remove(plan: Plan, with_text: bool, docs: pa.Table, told: pa.Table) -> pa.Table:
    """Pass 3 of a chunk: what stays of its documents."""
    if not docs.num_rows:
        return _blank(RESULT)
    c = Chunk(plan, docs)
    lost = np.zeros(0, np.int64)
    if told.num_rows:
        keys = told.filter(told["bits"].is_null())
        e = c.entries(_open_keys(keys))
        answers = told.filter(told["bits"].is_valid()).sort_by("bucket")
        raw, bounds = ragged(answers["bits"])
        start, end = by_bucket(e.bucket)
        if answers["bucket"].to_pylist() != e.bucket[start].tolist():
            raise RuntimeError("a chunk was told about other runs than it sent")
        upto = np.concatenate(([0], np.cumsum(e.wins[e.first])))
        bits = [np.unpackbits(raw[a:b], count=int(upto[j] - upto[i])) for a, b, i, j in zip(bounds[:-1], bounds[1:], start, end)]
        lost = e.lost(concat(bits, np.uint8).astype(bool))
    # maximal removed runs of tokens, within documents
    doc = np.searchsorted(c.first, lost, "right") - 1
    new = np.ones(len(lost), bool)
    new[1:] = (lost[1:] > lost[:-1] + plan.length) | (doc[1:] != doc[:-1])
    low, doc = lost[new], doc[new]
    high = (lost[np.append(np.flatnonzero(new)[1:], len(lost)) - 1] if len(lost) else lost) + plan.length
    n = len(c.first) - 1
    n_spans = np.bincount(doc, minlength=n)
    n_removed = np.bincount(doc, weights=high - low, minlength=n).astype(np.int64)
    hashes, kept, at = [], [], 0
    view = memoryview(c.raw)
    place = c.first if plan.tokens == "bytes" else np.append(c.words.start, len(c.data))
    cut = (lambda t: t) if plan.tokens == "bytes" else (lambda t: int(place[t]))
    low, high = low.tolist(), high.tolist()
    for i, (begin, stop) in enumerate(zip(c.first[:-1].tolist(), c.first[1:].tolist())):
        parts = []
        for k in range(at, at + int(n_spans[i])):
            parts.append(view[cut(begin) : cut(low[k])])
            begin = high[k]
        parts.append(view[cut(begin) : cut(stop)])
        at += int(n_spans[i])
        piece = parts[0] if len(parts) == 1 else b"".join(parts)
        if plan.tokens == "words" and len(piece):
            piece = piece[:-1]  # the space behind the last word
        hashes.append(hashlib.sha256(piece).hexdigest())
        kept.append(bytes(piece) if with_text else None)
    counts = [pa.array(x, pa.int64()) for x in (np.diff(c.first), n_removed, n_spans)]
    return pa.table([c.ids.cast(pa.int64()), *counts, pa.array(hashes, pa.string()), pa.array(kept, pa.binary())], names=[f.split()[0] for f in RESULT.split(", ")])


def remove_repeats(docs: DataFrame, tokens: str, length: int, with_text: bool = False, chunk_bytes: int | None = None, most: int = 20_000) -> DataFrame:
    """Per row of docs(doc_id, text): what stays when later copies of windows go (see module).

    chunk_bytes: text of a chunk, 8 MB and on very large tables up to 64.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    chunks = max(1, math.ceil(total / (chunk_bytes or min(64 << 20, max(8 << 20, total // 100_000)))))
    plan = Plan(tokens, length, max(64, chunks), most)
    tasks = max(min(chunks, 24), math.ceil(chunks / 4))
    # equal rows meet in a chunk, but those of one doc_id needn't
    dealt = docs.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks))).repartition(tasks, "chunk")
    chunk = dealt.groupBy("chunk")
    asked = chunk.applyInArrow(partial(_ask, plan), ASKED).repartition(tasks, "bucket")
    picks = asked.groupBy("bucket").applyInArrow(partial(_open_picks, plan), OPEN).repartition(tasks, "chunk")
    sent = chunk.cogroup(picks.groupBy("chunk")).applyInArrow(partial(_send, plan), SENT).repartition(tasks, "bucket")
    told = sent.groupBy("bucket").applyInArrow(partial(_settle, plan), TOLD).repartition(tasks, "chunk")
    both = told.select("chunk", "bucket", "bits", F.lit(None).cast("binary").alias("keys")).unionByName(picks.select("chunk", F.lit(-1).cast("long").alias("bucket"), F.lit(None).cast("binary").alias("bits"), "keys"))
    return chunk.cogroup(both.groupBy("chunk")).applyInArrow(partial(_remove, plan, with_text), RESULT)


def _ask(plan, docs):
    try:
        return ask(plan, docs)
    finally:
        tidy()


def _open_picks(plan, asked):
    try:
        return open_picks(plan, asked)
    finally:
        tidy()


def _send(plan, docs, told):
    try:
        return send(plan, docs, told)
    finally:
        tidy()


def _settle(plan, sent):
    try:
        return settle(plan, sent)
    finally:
        tidy()


def _remove(plan, with_text, docs, told):
    try:
        return remove(plan, with_text, docs, told)
    finally:
        tidy()


def depth_passes(docs: DataFrame, length: int = 50, with_text: bool = False, **more) -> DataFrame:
    """Suffix-array dedup on UTF-8 bytes.

    Removes each byte that a `length`-byte string covers which also starts in a
    document with a smaller doc_id.  Null text: empty.  Rows without doc_id stay
    whole and take nothing from others.  Rows with one doc_id don't remove each
    other.  Texts of any length are read in blocks, but one is never split over
    tasks.  Returns RESULT, one row per input row (repeated ones too); other
    columns of docs, whatever their names, are ignored.  Empty table: no rows.
    """
    return remove_repeats(docs, "bytes", length, with_text, **more)


def doubling_levels(docs: DataFrame, length: int = 13, with_text: bool = False, **more) -> DataFrame:
    """Substring dedup on words `[^\\x20\\x09-\\x0D]+`, as depth_passes but by words.

    `kept` joins the words that stay by one space.
    """
    return remove_repeats(docs, "words", length, with_text, **more)
