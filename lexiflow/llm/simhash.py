"""SimHash near-dedup with multi-index hashing.

Every shingle hash votes on each bit of a fingerprint.  Fingerprints are cut
into segments, and each segment has a table: a fingerprint stands in it at its
own segment and asks at the members of the Hamming ball of radius one around
it; what the table has there is verified on complete distances.

* `exact_links` (64 bits, distance 2): two segments of 32 bits.  Of two
  fingerprints in reach one segment differs in at most one bit, so they meet; the
  one without that bit asks.  Where many have one segment, the same is done
  within it on the other segment, whose ball of radius one links them two by two
  without a square of pairs; segments above `most` are dealt to all tasks by
  both parts of that key.
* `wide_links` (wider fingerprints, larger distances): S segments, whatever the
  number of fingerprints, both sides in the ball: a pair within 3 * S - 1 bits
  has a segment that differs in at most two, and surely meets.  Buckets are the
  leading bits of a segment: a fingerprint is sent once to its own bucket, where
  the rest of its ball is made, and once for each leading bit.  Chance meetings
  grow with the square of the number of fingerprints (8 segments of 16 bits: a
  key gets 17 of 65,536 fingerprints).  Groups of near copies are contracted
  first, on links between neighbours at bare keys; then all entries of a key that
  are in different groups so far are compared, so no link between groups is lost.
  A pair is given once, at the first key that it shares.  Where sets of shingles
  decide, entries carry the size of their set and a parity sketch, which bound the
  similarity from above; a pair that can't reach the one asked for isn't given.

Links are closed by star contraction on DataFrames with reliable checkpoints.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import shared_dir
from .textops import U64, Words, binaries, expand, groups, mix, ragged, released, slices, tidy

LANE_SEED = 0x9FB21C651E98DF25


def shingle_hashes(data: np.ndarray, bounds: np.ndarray, shingle: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds of each document's hashes), one for each shingle; a shorter text is one shingle."""
    from xxhash import xxh64_intdigest

    w = Words(data, bounds, lower=True)
    n_words = np.diff(w.first)
    n = np.where(n_words >= shingle, n_words - shingle + 1, np.minimum(n_words, 1))
    first = np.concatenate(([0], np.cumsum(n)))
    doc = np.repeat(np.arange(len(n)), n)
    at = np.arange(first[-1]) - first[doc] + w.first[doc]
    last = np.minimum(at + shingle, w.first[doc + 1]) - 1 if len(doc) else at
    raw = w.text.tobytes()
    return np.array([xxh64_intdigest(raw[a:b], seed) for a, b in zip(w.start[at].tolist(), w.end[last].tolist())], U64), first


def shingle_sets(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same without repeats within a document, in order."""
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], np.concatenate(([0], np.cumsum(np.bincount(doc[new], minlength=len(first) - 1))))


def fingerprints(h: np.ndarray, first: np.ndarray, lanes: int) -> np.ndarray:
    """(documents, lanes) of 64-bit fingerprints; zero where there is no word."""
    n = np.diff(first)
    out = np.zeros((len(n), lanes), U64)
    full = np.flatnonzero(n)
    for lane in range(lanes):
        votes = h if not lane else mix(h ^ U64(LANE_SEED * lane & (1 << 64) - 1))
        bits = np.unpackbits(votes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        if len(full):
            sums = np.add.reduceat(bits, first[:-1][full], axis=0, dtype=np.int32)
            out[full, lane] = np.packbits(2 * sums > n[full, None], axis=1, bitorder="little").view(U64)[:, 0]
    return out


def set_digests(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """64 bits of each document's set of shingles; zero where there is none."""
    out = np.zeros(len(first) - 1, U64)
    full = np.flatnonzero(np.diff(first))
    if len(full):
        out[full] = mix(np.add.reduceat(mix(h), first[:-1][full], dtype=U64) ^ np.diff(first)[full].astype(U64))
    return out


#: Bits of a parity sketch.
PARITIES = 128


def parity_sketches(h: np.ndarray, first: np.ndarray, parities: int = PARITIES) -> np.ndarray:
    """(documents, parities / 64) of 64 bits: bit k is the parity of the number of shingles dealt to k (a power of two of them).

    The bits that differ between two sets are no more than the shingles that do.
    """
    n = len(first) - 1
    at = np.repeat(np.arange(n), np.diff(first)) * parities + (mix(h) & U64(parities - 1)).astype(np.int64)
    odd = np.bincount(at, minlength=n * parities).astype(np.uint8) & 1
    return np.packbits(odd.reshape(n, parities), axis=1, bitorder="little").view(U64)


#: What is known of a set of shingles besides its fingerprint.
OF_SET = ["digest", "size", "p0", "p1"]


@released
def _fingerprint(shingle: int, lanes: int, seed: int, sets: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f"f{k}" for k in range(lanes)] + OF_SET * sets
    for batch in batches:
        data, bounds = ragged(batch.column(2))
        found = [np.zeros((0, len(names)), U64)]
        for i, j in slices(bounds, 1 << 19):
            h, first = shingle_hashes(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i], shingle, seed)
            if sets:
                h, first = shingle_sets(h, first)
            prints = fingerprints(h, first, lanes)
            found.append(np.column_stack((prints, set_digests(h, first), np.diff(first).astype(U64), parity_sketches(h, first))) if sets else prints)
        all_ = np.concatenate(found)
        yield pa.record_batch([batch.column(0), batch.column(1), *(pa.array(np.ascontiguousarray(x).view(np.int64)) for x in all_.T)], names=["doc_id", "text_key", *names])


def fingerprint_table(docs: DataFrame, shingle: int = 3, lanes: int = 1, seed: int = 42, sets: bool = False) -> DataFrame:
    """doc_id, text_key (a hash of the text) and f0.. (64 bits each) of every row.  Null text: no words, zero.

    sets: each different shingle votes once; a column `digest` tells sets apart, `size`
    is the number of shingles and p0, p1 are the parity sketch.
    """
    schema = "doc_id long, text_key long, " + ", ".join(f"{name} long" for name in [*(f"f{k}" for k in range(lanes)), *OF_SET * sets])
    return _texts(docs).mapInArrow(partial(_fingerprint, shingle, lanes, seed, sets), schema)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("text_key"), F.col("text").cast("string").alias("text"))


@released
def _sets(shingle: int, seed: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, bounds = ragged(batch.column(1))
        for i, j in slices(bounds, 1 << 19):
            h, first = shingle_sets(*shingle_hashes(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i], shingle, seed))
            yield pa.record_batch([batch.column(0).slice(i, j - i), pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(h.view(np.int64)))], names=["node", "shingles"])


#: Most rows of three numbers that are broadcast (about 30 MB), so that texts needn't be shuffled.
MOST_BROADCAST = 400_000


def small(rows: DataFrame) -> DataFrame:
    """Rows of a few numbers, checkpointed; with a hint to broadcast them where they have been counted to be few."""
    rows = rows.checkpoint()
    return F.broadcast(rows) if rows.count() <= MOST_BROADCAST else rows


def sets_of(docs: DataFrame, ends: DataFrame, shingle: int, seed: int) -> DataFrame:
    """(node, shingles) of the texts that ends(node, doc_id, text_key) name."""
    texts = _texts(docs).join(small(ends.select("node", "doc_id", "text_key")), ["doc_id", "text_key"]).select("node", "text")
    # rows of one doc_id and text give the same set
    return texts.mapInArrow(partial(_sets, shingle, seed), "node long, shingles array<long>").checkpoint()


def nearest(links: DataFrame) -> DataFrame:
    """Of links(node, other, apart) for each node the one with the nearest other."""
    return links.groupBy("node").agg(F.min(F.struct("apart", "other")).alias("least")).select("node", "least.other")


def gathered(links: DataFrame, distance: int) -> DataFrame:
    """Of links(node, other, apart) for each node, either way, the nearest other, and the smallest within half the distance, where groups gather."""
    both = links.union(links.select("other", "node", "apart"))
    chosen = both.groupBy("node").agg(F.min(F.struct("apart", "other")).alias("least"), F.min(F.when(F.col("apart") * 2 <= distance, F.col("other"))).alias("hub"))
    chosen = chosen.select("node", F.explode(F.array_compact(F.array("least.other", "hub"))).alias("other"))
    return chosen.select(F.greatest("node", "other").alias("node"), F.least("node", "other").alias("other")).distinct()


def confirmed(links: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of links(node, other) whose sets(node, shingles) have that Jaccard similarity or more."""
    links = links.distinct()
    one = sets.select("node", F.col("shingles").alias("a"))
    two = sets.join(links.select("other").distinct(), sets.node == F.col("other"), "left_semi").select(F.col("node").alias("other"), F.col("shingles").alias("b"))
    both = F.size(F.array_intersect("a", "b"))
    enough = both + F.lit(1e-9) >= F.lit(similarity) * (F.size("a") + F.size("b") - both)
    return links.join(one, "node").join(two, "other").where(enough).select("node", "other").distinct().checkpoint()


def similar(docs: DataFrame, known: DataFrame, links: DataFrame, shingle: int, seed: int, similarity: float) -> DataFrame:
    """Those of links(node, other) whose texts have sets of shingles of that Jaccard similarity or more."""
    links = links.distinct().checkpoint()
    ends = known.select("node", "doc_id", "text_key").join(links.select(F.explode(F.array("node", "other")).alias("node")).distinct(), "node", "left_semi")
    return confirmed(links, sets_of(docs, ends, shingle, seed), similarity)


def _flips(value: np.ndarray, bits: int, ball: bool = True) -> np.ndarray:
    """(1 + bits, n): the values, and those with each bit flipped."""
    return np.stack([value, *(value ^ (U64(1) << U64(b)) for b in range(bits if ball else 0))])


# links at distance 2 of 64 bits

HALF = U64(32)
LOW = U64((1 << 32) - 1)


def _half_keys(prints: np.ndarray, segment: int) -> tuple[np.ndarray, np.ndarray]:
    """(the segment, the other one)."""
    return (prints >> HALF, prints & LOW) if segment else (prints & LOW, prints >> HALF)


@released
def _post_halves(bits: int, hot: list[np.ndarray], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries of the two segment tables by bucket; role: 0 stands there, 1 asks, 2 is in a split segment (pairs of all roles are near)."""
    for batch in batches:
        for begin in range(0, batch.num_rows, 20_000):
            part = batch.slice(begin, 20_000)
            node, prints = (part.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            prints = prints.view(U64)
            keys, who, roles = [], [], []

            def post(key: np.ndarray, at: np.ndarray, role: int) -> None:
                keys.append(key)
                who.append(at)
                roles.append(np.full(len(at), role, np.uint8))

            for s in range(2):
                value, other = _half_keys(prints, s)
                tag = U64(0x9E3779B97F4A7C15 * (s + 1) & (1 << 64) - 1)

                def of_split(v: np.ndarray, x: np.ndarray) -> np.ndarray:
                    return mix(mix(v ^ tag) + x)

                split = np.isin(value, hot[s])
                at = np.flatnonzero(~split)
                post(mix(value[at] ^ tag), at, 0)
                at = np.flatnonzero(split)
                for x in _flips(other[at], 32):
                    post(of_split(value[at], x), at, 2)
                for b in range(32):
                    at = np.flatnonzero(value & (U64(1) << U64(b)) == 0)
                    asked = value[at] | (U64(1) << U64(b))
                    split = np.isin(asked, hot[s]) if len(hot[s]) else np.zeros(len(at), bool)
                    post(mix(asked[~split] ^ tag), at[~split], 1)
                    post(of_split(asked[split], other[at[split]]), at[split], 2)
            key, at, role = np.concatenate(keys), np.concatenate(who), np.concatenate(roles)
            order = np.argsort(key)
            key, at, role = key[order], at[order], role[order]
            bucket = (key >> U64(64 - bits)).astype(np.int64)
            start = groups(bucket)
            end = np.append(start[1:], len(key))
            yield pa.record_batch(
                [pa.array(bucket[start]), binaries(key, 8 * end), binaries(node[at], 8 * end), binaries(prints[at], 8 * end), binaries(role, end)],
                names=["bucket", "keys", "nodes", "prints", "roles"],
            )


#: Pairs that are compared at once, and the most compared directly at one key.
AT_ONCE, DIRECT = 1 << 20, 1 << 16


def _meet_halves(table: pa.Table) -> pa.Table:
    """Links (node, other) of what meets at the keys of a bucket; other is the smaller."""

    def column(name: str, dtype) -> np.ndarray:
        return np.frombuffer(ragged(table[name])[0].tobytes(), dtype)

    key, node, prints, role = column("keys", U64), column("nodes", np.int64), column("prints", U64), column("roles", np.uint8)
    order = np.lexsort((role, key))
    key, role, node, prints = key[order], role[order], node[order], prints[order]
    # keys of split segments are apart from those of others
    start = groups(key)
    start = np.union1d(start, np.flatnonzero((role[1:] == 2) & (role[:-1] != 2)) + 1)
    size = np.diff(np.append(start, len(key)))
    # what is alone at its key, or only asks there, meets nothing
    some = (size > 1) & (role[start] != 1)
    start, size = start[some], size[some]
    held = np.concatenate(([0], np.cumsum(role == 0)))
    held = held[start + size] - held[start]
    links = []

    def star(members: np.ndarray, names: np.ndarray) -> None:
        """Members of one name are near each other: each is linked with the least of them."""
        while len(members):
            order = np.lexsort((node[members], names))
            members, names = members[order], names[order]
            begin = groups(names)
            least = np.repeat(members[begin], np.diff(np.append(begin, len(members))))
            near = np.bitwise_count(prints[members] ^ prints[least]) <= 2
            links.append((members[near], least[near]))
            members, names = members[~near], names[~near]  # another key with the same hash

    split = role[start] == 2
    at = expand(start[split], start[split] + size[split])
    star(at, key[at])
    # each that stands at a key with all behind it: those that stand there too, and those that ask
    direct = ~split & (held * size <= DIRECT)
    first = expand(start[direct], start[direct] + held[direct])
    stop = np.repeat((start + size)[direct], held[direct])
    upto = np.cumsum(stop - first - 1)
    edges = np.searchsorted(upto, np.arange(AT_ONCE, upto[-1], AT_ONCE)) + 1 if len(upto) else []
    for f, z in zip(np.split(first, edges), np.split(stop, edges)):
        one, two = np.repeat(f, z - f - 1), expand(f + 1, z)
        near = np.bitwise_count(prints[one] ^ prints[two]) <= 2
        links.append((one[near], two[near]))
    # long lists, all of one segment: by the ball of the other segment
    for a, n, h in zip(start[~split & ~direct].tolist(), size[~split & ~direct].tolist(), held[~split & ~direct].tolist()):
        own = np.arange(a, a + n)
        differs = np.bitwise_or.reduce(prints[own[:h]] ^ prints[a])
        other = _half_keys(prints[own], 0 if differs & LOW == 0 else 1)[1]
        balls = _flips(other[:h], 32)
        star(np.concatenate((np.tile(own[:h], len(balls)), own[h:])), np.concatenate((balls.ravel(), other[h:])))
    one, two = (np.concatenate(x) for x in zip(*links))
    found = np.stack((np.maximum(node[one], node[two]), np.minimum(node[one], node[two])), axis=1)
    found = np.unique(found[found[:, 0] != found[:, 1]], axis=0)
    return pa.table({"node": found[:, 0], "other": found[:, 1]})


def _meet_exact(table):
    try:
        return _meet_halves(table)
    finally:
        tidy()


def exact_links(known: DataFrame, n: int, most: int = 100_000) -> DataFrame:
    """links(node, other) of all of known(node, f0) that differ in two bits or fewer, as far as their groups need."""
    most = max(most, n // 20_000)  # the segments above it, under 20,000 of each table, reach the driver
    segments = [F.shiftrightunsigned("f0", 32 * s).bitwiseAND(F.lit((1 << 32) - 1)) for s in range(2)]
    each = known.select(F.explode(F.array(*[F.struct(F.lit(s).alias("s"), v.alias("v")) for s, v in enumerate(segments)])).alias("x"))
    full = each.groupBy("x.s", "x.v").count().where(F.col("count") > most).collect()
    hot = [np.array(sorted(r["v"] for r in full if r["s"] == s), U64) for s in range(2)]
    bits = max(6, math.ceil(math.log2(max(1, 34 * n) / 300_000)))
    posted = known.select("node", "f0").mapInArrow(partial(_post_halves, bits, hot), "bucket long, keys binary, nodes binary, prints binary, roles binary")
    return posted.groupBy("bucket").applyInArrow(_meet_exact, "node long, other long")


# links at larger distances


def segment_values(prints: np.ndarray, width: int, count: int) -> np.ndarray:
    """(count, n): consecutive segments of `width` bits of the lanes as one bit string."""
    n, lanes = prints.shape
    bits = np.unpackbits(np.ascontiguousarray(prints).view(np.uint8).reshape(n, lanes * 8), axis=1, bitorder="little")
    weight = U64(1) << np.arange(width, dtype=U64)
    return np.stack([(bits[:, s * width : (s + 1) * width].astype(U64) * weight).sum(axis=1, dtype=U64) for s in range(count)])


def _key_type(width: int):
    """Keys are a segment's value and its number."""
    return np.uint32 if width + 4 <= 32 else U64


@released
def _post(width: int, count: int, lanes: int, ball: bool, top: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fingerprints by bucket, a segment's number and its `top` leading bits: their own, and with a ball those one bit away."""
    for batch in batches:
        for at in range(0, batch.num_rows, 20_000):
            part = batch.slice(at, 20_000)
            columns = [c.to_numpy(zero_copy_only=False).view(U64) for c in part.columns]
            node, label = columns[:2]
            prints = np.stack(columns[2 : 2 + lanes], axis=1)
            of_set = columns[2 + lanes :]
            leading = [_flips(v >> U64(width - top), top, ball) | U64(s << top) for s, v in enumerate(segment_values(prints, width, count))]
            bucket = np.concatenate(leading).ravel().astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            bucket, who = bucket[order], order % max(1, len(node))
            start = groups(bucket)
            end = np.append(start[1:], len(bucket))
            # most labels are the node's own: zeros are packed well
            out = {"nodes": node[who], "labels": (label ^ node)[who], "prints": prints[who]}
            if of_set:
                out |= {"sizes": of_set[0][who].astype(np.uint32), "sketches": np.stack(of_set[1:], axis=1)[who]}
            yield pa.record_batch([pa.array(bucket[start]), *(binaries(x, x.nbytes // max(1, len(x)) * end) for x in out.values())], names=["bucket", *out])


def _entries(prints: np.ndarray, width: int, count: int, ball: bool, top: int, bucket: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys, places in prints) of a bucket: of fingerprints with its leading bits the ball within it, of others the member that is there."""
    s, low = bucket >> top, width - top
    v = segment_values(prints, width, count)[s]
    lead = U64(bucket & (1 << top) - 1)
    own = np.flatnonzero(v >> U64(low) == lead)
    other = np.flatnonzero(v >> U64(low) != lead)
    within = _flips(v[own], low, ball)
    moved = v[other] & U64((1 << low) - 1) | lead << U64(low)
    key = np.concatenate((within.ravel(), moved)) << U64(4) | U64(s)
    return key.astype(_key_type(width)), np.concatenate((np.tile(own, len(within)), other))


def first_keys(prints: np.ndarray, others: np.ndarray, width: int, count: int) -> np.ndarray:
    """For pairs that meet in balls: the key at which they are given, one of those that both have."""
    v, w = segment_values(prints, width, count), segment_values(others, width, count)
    segment = np.argmax(np.bitwise_count(v ^ w) <= 2, axis=0)
    v, w = (x[segment, np.arange(len(segment))] for x in (v, w))
    apart = v ^ w
    bit = apart & (~apart + U64(1))  # the lowest that differs
    two = np.bitwise_count(apart) == 2
    return np.where(two, np.minimum(v ^ bit, w ^ bit), np.minimum(v, w)) << U64(4) | segment.astype(U64)


def may_reach(sizes: np.ndarray, sketches: np.ndarray, similarity: float, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """False where sets i and j surely have a lower Jaccard similarity.

    At a similarity of s two sets differ in at most (1 - s) / (1 + s) of the sum of
    their sizes; they differ in at least the difference of sizes and of parities.
    """
    a, b = sizes[i].astype(np.int64), sizes[j].astype(np.int64)
    differ = np.maximum(np.abs(a - b), np.bitwise_count(sketches[i] ^ sketches[j]).sum(axis=1, dtype=np.int64))
    return differ <= (a + b) * (1 - similarity) / (1 + similarity) + 1e-6


def _any(i: np.ndarray, j: np.ndarray) -> np.ndarray:
    return np.ones(len(i), bool)


def _across(key: np.ndarray, label: np.ndarray, prints: np.ndarray, distance: int, wanted=_any) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) of all entries of the same key and different labels within the distance that are wanted(i, j); entries are in order of key and label."""
    start = groups(key)
    end = np.append(start[1:], len(key))
    last = np.repeat(end, end - start)
    run = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (label[1:] != label[:-1]))))
    after = np.append(run[1:], len(key))
    after = np.repeat(after, after - run)  # entry i is compared with after[i]:last[i]
    many = last - after > 64
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    i, step = np.flatnonzero((after < last) & ~many), 0
    while len(i):
        j = after[i] + step
        near = np.flatnonzero(np.bitwise_count(prints[i] ^ prints[j]).sum(axis=1) <= distance)
        near = near[wanted(i[near], j[near])]
        found.append((i[near], j[near]))
        step += 1
        i = i[after[i] + step < last[i]]
    # entries that have many to meet are the first ones of their key
    lanes = [np.ascontiguousarray(lane) for lane in prints.T]
    kind = np.uint8 if len(lanes) < 4 else np.uint16
    first = np.flatnonzero(many & np.concatenate(([True], ~many[:-1] | (key[1:] != key[:-1])))) if len(key) else start
    for a in first.tolist():
        n = int(many[a : last[a]].sum())
        for r in range(a, a + n, 128):
            rows = slice(r, min(r + 128, a + n))
            for c in range(int(after[r]), int(last[a]), 1024):
                columns = slice(c, min(c + 1024, int(last[a])))
                apart = np.zeros((rows.stop - rows.start, columns.stop - columns.start), kind)
                for lane in lanes:
                    apart += np.bitwise_count(lane[rows, None] ^ lane[columns])
                i, j = np.nonzero(apart <= distance)
                i, j = i + r, j + c
                own = np.flatnonzero(j >= after[i])
                own = own[wanted(i[own], j[own])]
                found.append((i[own], j[own]))
    return tuple(np.concatenate(x) for x in zip(*found))


#: Entries behind each one that it is compared with when groups are contracted, and the nearest of them that are linked.
AHEAD, NEAREST = 16, 2


def _neighbours(key: np.ndarray, label: np.ndarray, prints: np.ndarray, distance: int, wanted=_any, hubs: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(i, j): for each entry the nearest ones of other labels within the distance that are wanted(i, j), among the next ones of its key; with hubs the one with the least label too."""
    n = len(key)
    best = np.full((NEAREST, n), np.iinfo(np.int32).max, np.int64)
    for step in range(1, min(AHEAD, n - 1) + 1):
        i = np.flatnonzero((key[:-step] == key[step:]) & (label[:-step] != label[step:]))
        apart = np.bitwise_count(prints[i] ^ prints[i + step]).sum(axis=1, dtype=np.int64)
        found = np.where((apart <= distance) & wanted(i, i + step), apart * 64 + step, best[-1, i])
        for row in best:
            lower = np.minimum(row[i], found)
            found = np.maximum(row[i], found)
            row[i] = lower
    rows, i = np.nonzero(best < np.iinfo(np.int32).max)
    j = i + best[rows, i] % 64
    if not n or not hubs:
        return i, j
    order = np.lexsort((label, key))
    start = groups(key)
    hub = np.repeat(order[start], np.diff(np.append(start, n)))
    own = np.flatnonzero(label != label[hub])
    own = own[np.bitwise_count(prints[own] ^ prints[hub[own]]).sum(axis=1) <= distance]
    own = own[wanted(own, hub[own])]
    return np.concatenate((i, own)), np.concatenate((j, hub[own]))


def _chosen(found: np.ndarray, distance: int) -> np.ndarray:
    """Of rows (node, other, apart) what gathered() can choose from: each node's nearest other, and the smallest within half the distance."""
    both = np.concatenate((found, found[:, [1, 0, 2]]))
    kept = []
    for rows, order in ((both, (1, 2, 0)), (both[2 * both[:, 2] <= distance], (1, 0))):
        rows = rows[np.lexsort([rows[:, k] for k in order])]
        kept.append(rows[groups(rows[:, 0])])
    kept = np.concatenate(kept)
    return np.unique(np.column_stack((kept[:, :2].max(axis=1), kept[:, :2].min(axis=1), kept[:, 2])), axis=0)


def _meet(distance: int, lanes: int, width: int, count: int, top: int, all_pairs: bool, by_label: bool, similarity: float | None, table: pa.Table) -> pa.Table:
    """Links (node, other, apart) of what meets at the keys of a bucket; other is the smaller.

    all_pairs: each entry is compared with all of other labels at its key, and a
    pair is given at the first of its keys; else with some.  by_label: links are
    those of the labels.
    """

    def column(name: str, dtype) -> np.ndarray:
        return np.frombuffer(ragged(table[name])[0].tobytes(), dtype)

    node = column("nodes", np.int64)
    label, prints = node ^ column("labels", np.int64), column("prints", U64).reshape(-1, lanes)
    key, who = _entries(prints, width, count, all_pairs, top, table["bucket"][0].as_py())
    # places of nodes in order, so that entries of a key are in order too
    place = np.empty(len(node), np.int64)
    place[np.lexsort((node, label) if all_pairs else (node, *prints.T))] = np.arange(len(node))
    order = np.lexsort((place[who], key))
    key, who = key[order], who[order]
    node, label, prints = node[who], label[who], prints[who]
    of_set = similarity is not None and (column("sizes", np.uint32)[who], column("sketches", U64).reshape(-1, 2)[who])

    def wanted(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        ok = may_reach(*of_set, similarity, i, j) if of_set else _any(i, j)
        if all_pairs:
            at = np.flatnonzero(ok)
            ok[at] = first_keys(prints[i[at]], prints[j[at]], width, count) == key[i[at]]
        return ok

    name = label if by_label else node
    i, j = (_across if all_pairs else _neighbours)(key, label, prints, distance, wanted)
    apart = np.bitwise_count(prints[i] ^ prints[j]).sum(axis=1, dtype=np.int64)
    found = np.unique(np.column_stack((np.maximum(name[i], name[j]), np.minimum(name[i], name[j]), apart)), axis=0)
    return pa.table({"node": found[:, 0], "other": found[:, 1], "apart": found[:, 2]})


def _meet_wide(distance, lanes, width, count, top, all_pairs, by_label, similarity, table):
    try:
        return _meet(distance, lanes, width, count, top, all_pairs, by_label, similarity, table)
    finally:
        tidy()


#: The least leading bits of a segment that name a bucket.
LEADING = 5


def wide_links(
    known: DataFrame, n: int, prints: list[str], distance: int, segments: int, all_pairs: bool = True, by_label: bool = True, similarity: float | None = None
) -> DataFrame:
    """links(node, other, apart) of known(node, label, f0.., and with a similarity size, p0, p1); with one only pairs of sets that may reach it."""
    width = min(64 * len(prints) // segments, 56)
    posted = n * segments * (width + 1 if all_pairs else 1)
    top = min(width, max(LEADING, math.ceil(math.log2(max(1, posted) / 300_000 / segments))))
    of_set = [] if similarity is None else OF_SET[1:]
    binary = ["nodes", "labels", "prints", *["sizes", "sketches"] * bool(of_set)]
    met = known.select("node", "label", *prints, *of_set).mapInArrow(
        partial(_post, width, segments, len(prints), all_pairs, top), "bucket long, " + ", ".join(f"{x} binary" for x in binary)
    )
    return met.groupBy("bucket").applyInArrow(partial(_meet_wide, distance, len(prints), width, segments, top, all_pairs, by_label, similarity), "node long, other long, apart long")


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) of all nodes in links(node, other): the smallest node reachable.

    Large-star and small-star by turns until the links don't change.  Nothing
    but a count and a checksum comes to the driver.
    """
    shared_dir(links.sparkSession)

    def stamp(e: DataFrame):
        return e.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("node", "other").cast("decimal(38,0)")), F.lit(0))).first()

    edges = links.where("node <> other").select(F.greatest("node", "other").alias("node"), F.least("node", "other").alias("other")).distinct().checkpoint()
    before = stamp(edges)
    if not before[0]:
        return edges.select("node", F.col("other").alias("component"))
    for _ in range(most_rounds):
        both = edges.union(edges.select("other", "node"))
        least = both.groupBy("node").agg(F.min("other").alias("m")).select("node", F.least("node", "m").alias("m"))
        large = both.where("other > node").join(least, "node").select(F.col("other").alias("node"), F.col("m").alias("other"))
        large = large.where("node <> other").distinct()
        smallest = large.groupBy("node").agg(F.min("other").alias("m"))
        small = large.join(smallest, "node").select(F.col("other").alias("node"), F.col("m").alias("other")).union(smallest)
        edges = small.where("node <> other").distinct().checkpoint()
        after = stamp(edges)
        if after == before:
            return edges.select("node", F.col("other").alias("component"))
        before = after
    raise RuntimeError(f"links were not closed in {most_rounds} rounds")


def _united(closed: DataFrame, links: DataFrame) -> DataFrame:
    """components of links together with the groups found so far."""
    return components(closed.select("node", F.col("component").alias("other")).union(links))


def near_duplicates(
    docs: DataFrame, shingle: int = 3, distance: int = 2, lanes: int = 1, segments: int | None = None, seed: int = 42, similarity: float | None = None, contractions: int = 2
) -> DataFrame:
    """Per row of docs: doc_id, text_key, f0.., component_id (smallest doc_id reachable over links).

    Fingerprints link at `distance` or fewer differing bits.  segments None: 64
    bits and distance 2, exact.  Else that many segments, which find a pair if
    one of them differs in at most two bits: always up to 3 * segments - 1.
    similarity (with segments): only texts link whose sets of shingles have that
    Jaccard similarity or more, also where fingerprints are equal; these are then
    of the sets.  contractions: rounds that join neighbours before all pairs meet
    (they change the time taken, not the result).

    Null text and texts without words have fingerprint zero and link like any
    other.  Rows are told apart by their texts: rows of one doc_id with other
    texts may be in other components; a repeated row has its component twice.
    Rows without doc_id get the component of their fingerprint, null if no other
    row has it.  Other columns are ignored.  Long texts are read whole, one at a
    time.
    """
    if segments is None and (lanes, distance, similarity) != (1, 2, None):
        raise ValueError("without segments: one lane, distance 2 and no similarity")
    spark = docs.sparkSession
    shared_dir(spark)
    prints = [f"f{k}" for k in range(lanes)]
    sets = similarity is not None
    table = fingerprint_table(docs, shingle, lanes, seed, **{"sets": True} if sets else {}).checkpoint()
    own_set = prints + OF_SET * sets
    distinct = table.groupBy(*own_set).agg(F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "text_key"))).alias("least"))
    # numbers of their own: a doc_id may have several texts
    known = distinct.where("least IS NOT NULL").select(F.monotonically_increasing_id().alias("node"), "least.doc_id", "least.text_key", *own_set).checkpoint()
    n = known.count()
    if segments is None:
        closed = components(exact_links(known, n))
    else:
        keep = (lambda links: similar(docs, known, links, shingle, seed, similarity)) if sets else (lambda links: links)
        closed = spark.createDataFrame([], "node long, component long")
        for k in range(contractions + 1):
            labelled = known.join(closed, "node", "left").select("node", *own_set, F.coalesce("component", "node").alias("label"))
            last = k == contractions
            links = wide_links(labelled, n, prints, distance, segments, last, last and not sets, similarity)
            closed = _united(closed, keep(links.select("node", "other") if last else nearest(links)))
    return named_rows(table, known, closed, own_set).select("doc_id", "text_key", *prints, "component_id")


def named_rows(table: DataFrame, known: DataFrame, closed: DataFrame, own: list[str]) -> DataFrame:
    """table with component_id: the least doc_id of the group, in closed(node, component), of the node that has a row's own columns."""
    grouped = closed.union(closed.select("component", "component").distinct()).join(known.select("node", "doc_id"), "node")
    least = grouped.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    grouped = grouped.join(least, "component").select("node", "component_id")
    named = known.join(grouped, "node", "left").select(*own, F.coalesce("component_id", "doc_id").alias("component_id"))
    return table.join(named, own, "left")
