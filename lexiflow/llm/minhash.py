"""MinHash near-dedup: universal hash minima, bands, verified signatures, star components.

1. Each text gets a set of shingles and a signature: the minima of bands * rows
   universal hash functions over the set.  Rows of one set are one node.
2. Bands: `rows` minima in a row are a key.  Two sets of similarity s share a key
   but with probability (1 - s ** rows) ** bands: at 0.8 and 32 bands of 4 rows one
   pair in twenty million is missed, above it less.  A first pass over bare keys
   finds the nodes that share any; only these go on.
3. What meets at a key is verified on its signature (one bit of each minimum: two
   sets at 0.8 differ in 12.8 of 128, and 33 are six deviations more), on sizes
   and on parity sketches, which bound the similarity.  What is left is confirmed
   on the full sets.
4. Groups of near copies are contracted first: each node is linked with its
   nearest neighbour at a key and with the smallest likely one, twice; then all pairs of a key in different groups
   are verified, so no link between groups is lost and no group gives all its pairs.
5. Components by alternating large-star and small-star.
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
from .simhash import _across, _chosen, _neighbours, _texts, _united, confirmed, gathered, may_reach, named_rows, parity_sketches, set_digests, sets_of, shingle_hashes, shingle_sets
from .textops import U64, binaries, groups, mix, ragged, released, slices, tidy

#: Shingles that are hashed at once, so that they stay in a processor's cache.
AT_ONCE = 1 << 15
#: What is known of a node but its keys.
OF_NODE = ["f0", "f1", "size", "sketch"]
#: Bits of a parity sketch: enough to tell the differing shingles of short texts nearly one by one.
PARITIES = 512
#: Two digests tell sets apart.
SET = ["d0", "d1", "size"]


def minima(h: np.ndarray, first: np.ndarray, count: int, seed: int) -> np.ndarray:
    """(documents, count) of 32 bits: least value of each function a * x + b, high half, over a document's shingles; zeros where it has none.

    x is 32 bits of the shingle's hash, a and b are 64 random bits: multiply-add-shift is strongly universal.
    """
    rng = np.random.default_rng(seed)
    a, b = rng.integers(0, 1 << 64, (2, count), dtype=U64)
    x = mix(h) >> U64(32)
    sizes = np.diff(first)
    full = np.flatnonzero(sizes)
    out = np.zeros((len(sizes), count), np.uint32)
    # a long document is read in parts
    parts = -(-sizes[full] // AT_ONCE)
    of = np.repeat(full, parts)
    start = first[of] + AT_ONCE * (np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts))
    stop = np.minimum(start + AT_ONCE, first[of + 1])
    out[full] = np.iinfo(np.uint32).max
    i = 0
    while i < len(of):
        j = max(i + 1, int(np.searchsorted(stop, start[i] + AT_ONCE, "right")))
        own, at = x[start[i] : stop[j - 1]], start[i:j] - start[i]
        value, docs = np.empty_like(own), of[i:j]
        for k in range(count):
            np.multiply(own, a[k], out=value)
            value += b[k]
            out[docs, k] = np.minimum(out[docs, k], (np.minimum.reduceat(value, at) >> U64(32)).astype(np.uint32))
        i = j
    return out


def band_keys(signature: np.ndarray, bands: int) -> np.ndarray:
    """(documents, bands) of 64 bits; equal where the minima of the band are."""
    parts = signature.astype(U64).reshape(len(signature), bands, signature.shape[1] // bands)
    key = mix(np.arange(1, bands + 1, dtype=U64) * U64(0x9E3779B97F4A7C15))[None].repeat(len(parts), 0)
    for k in range(parts.shape[2]):
        key = mix(key + parts[:, :, k])
    return key


def signature_bits(signature: np.ndarray) -> np.ndarray:
    """(documents, 2): the lowest bit of each minimum, up to 128 of them."""
    bits = np.zeros((len(signature), 128), np.uint8)
    bits[:, : signature.shape[1]] = signature[:, :128] & 1
    return np.packbits(bits, axis=1, bitorder="little").view(U64)


@released
def _sign(shingle: int, bands: int, rows: int, seed: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "text_key", "keys", *OF_NODE, "d0", "d1"]
    for batch in batches:
        data, bounds = ragged(batch.column(2))
        for i, j in slices(bounds, 1 << 19):
            h, first = shingle_sets(*shingle_hashes(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i], shingle, seed))
            signature = minima(h, first, bands * rows, seed)
            n = np.diff(first)
            numbers = np.column_stack((signature_bits(signature), n.astype(U64), set_digests(h, first), set_digests(mix(h ^ U64(0xA24BAED4963EE407)), first)))
            f0, f1, size, d0, d1 = (pa.array(np.ascontiguousarray(c).view(np.int64)) for c in numbers.T)
            each = np.arange(1, j - i + 1)
            keys, sketch = binaries(band_keys(signature, bands), 8 * bands * each), binaries(parity_sketches(h, first, PARITIES), PARITIES // 8 * each)
            yield pa.record_batch([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), keys, f0, f1, size, sketch, d0, d1], names=names)


def signature_table(docs: DataFrame, shingle: int = 4, bands: int = 32, rows: int = 4, seed: int = 42) -> DataFrame:
    """doc_id, text_key (a hash of the text), keys (of the bands), OF_NODE and two digests of the set, of every row; size 0: no words."""
    schema = "doc_id long, text_key long, keys binary, " + ", ".join(f"{c} {'binary' if c == 'sketch' else 'long'}" for c in [*OF_NODE, "d0", "d1"])
    return _texts(docs).mapInArrow(partial(_sign, shingle, bands, rows, seed), schema)


@released
def _post_bands(bands: int, bits: int, of_node: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries by bucket: of each node and band the key and the node, and with of_node all else."""
    for batch in batches:
        for begin in range(0, batch.num_rows, 20_000):
            part = batch.slice(begin, 20_000)
            key = np.frombuffer(ragged(part.column(1))[0].tobytes(), U64)
            node = part.column(0).to_numpy(zero_copy_only=False)
            who = np.repeat(np.arange(len(node)), bands)
            order = np.argsort(key)
            key, who = key[order], who[order]
            bucket = (key >> U64(64 - bits)).astype(np.int64)
            start = groups(bucket)
            end = np.append(start[1:], len(key))
            out = {"keys": key, "nodes": node[who]}
            if of_node:
                label, f0, f1, size = (part.column(k).to_numpy(zero_copy_only=False) for k in range(2, 6))
                sketch = np.frombuffer(ragged(part.column(6))[0].tobytes(), U64).reshape(-1, PARITIES // 64)
                # most labels are the node's own: zeros are packed well
                out |= {"labels": (label ^ node)[who], "prints": np.column_stack((f0, f1))[who], "sizes": size.astype(np.uint32)[who], "sketches": sketch[who]}
            yield pa.record_batch([pa.array(bucket[start]), *(binaries(x, x.nbytes // max(1, len(x)) * end) for x in out.values())], names=["bucket", *out])


def _column(table: pa.Table, name: str, dtype) -> np.ndarray:
    return np.frombuffer(ragged(table[name])[0].tobytes(), dtype)


def _sharing(table):
    """Nodes of a bucket that share a key with another."""
    try:
        key, node = _column(table, "keys", U64), _column(table, "nodes", np.int64)
        order = np.argsort(key)
        start = groups(key[order])
        count = np.diff(np.append(start, len(key)))
        return pa.table({"node": np.unique(node[order][np.repeat(count > 1, count)])})
    finally:
        tidy()


def _meet_bands(all_pairs, distance, similarity, table):
    """Links (node, other, apart) of what meets at the keys of a bucket and is verified; other is the smaller."""
    try:
        key, node = _column(table, "keys", U64), _column(table, "nodes", np.int64)
        label, prints = node ^ _column(table, "labels", np.int64), _column(table, "prints", U64).reshape(-1, 2)
        order = np.lexsort((node, label, key) if all_pairs else (node, *prints.T, key))
        key, node, label, prints = key[order], node[order], label[order], prints[order]
        sizes, sketches = _column(table, "sizes", np.uint32)[order], _column(table, "sketches", U64).reshape(-1, PARITIES // 64)[order]
        wanted = lambda i, j: may_reach(sizes, sketches, similarity, i, j)
        i, j = _across(key, label, prints, distance, wanted) if all_pairs else _neighbours(key, label, prints, distance, wanted, hubs=True)
        apart = np.bitwise_count(prints[i] ^ prints[j]).sum(axis=1, dtype=np.int64)
        found = np.unique(np.column_stack((np.maximum(node[i], node[j]), np.minimum(node[i], node[j]), apart)), axis=0)
        if not all_pairs:
            found = _chosen(found, distance)
        return pa.table({"node": found[:, 0], "other": found[:, 1], "apart": found[:, 2]})
    finally:
        tidy()


def _bits(entries: int) -> int:
    return max(2, math.ceil(math.log2(max(1, entries) / 300_000)))


def minhash_groups(docs: DataFrame, shingle: int = 4, similarity: float = 0.8, bands: int = 32, rows: int = 4, distance: int = 33, seed: int = 42, contractions: int = 2) -> DataFrame:
    """Per row of docs: doc_id, text_key, n_shingles (size of its set), component_id (smallest doc_id reachable over links), kept.

    Texts whose sets of shingles (lower-cased A-Z, `shingle` words, shorter texts
    whole) have a Jaccard similarity of `similarity` or more are linked.  distance:
    the most of 128 signature bits in which candidates differ.  Of a component the
    row with its smallest doc_id is kept; of several rows with that doc_id, all are.

    Null texts and texts without words have an empty set, link with nothing and
    stay.  Rows are told apart by their sets: rows of one doc_id with other texts
    may be in other components; a repeated row is given twice.  Rows without doc_id
    link nothing: they have the component of their set, and go, or null if no other
    row has that set, and stay.  Other columns are ignored; an empty table has no
    rows.  Long texts are read whole, one at a time.
    """
    if bands * rows > 128:
        raise ValueError("at most 128 minima")
    spark = docs.sparkSession
    shared_dir(spark)
    table = signature_table(docs, shingle, bands, rows, seed).checkpoint()
    least = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "text_key"))).alias("least")
    distinct = table.where("size > 0").groupBy(*SET).agg(least, F.first("keys").alias("keys"), *[F.first(c).alias(c) for c in OF_NODE if c not in SET])
    known = distinct.where("least IS NOT NULL").select(F.monotonically_increasing_id().alias("node"), "least.doc_id", "least.text_key", "keys", *OF_NODE, "d0", "d1").checkpoint()
    entries = known.count() * bands
    asked = known.select("node", "keys").mapInArrow(partial(_post_bands, bands, _bits(entries), False), "bucket long, keys binary, nodes binary")
    sharing = asked.groupBy("bucket").applyInArrow(_sharing, "node long").distinct()
    active = known.join(sharing, "node").checkpoint()
    entries = active.count() * bands
    sets = sets_of(docs, active, shingle, seed)
    closed = spark.createDataFrame([], "node long, component long")
    for k in range(contractions + 1):
        last = k == contractions
        labelled = active.join(closed, "node", "left").select("node", "keys", F.coalesce("component", "node").alias("label"), *OF_NODE)
        posted = labelled.mapInArrow(partial(_post_bands, bands, _bits(entries), True), "bucket long, keys binary, nodes binary, labels binary, prints binary, sizes binary, sketches binary")
        links = posted.groupBy("bucket").applyInArrow(partial(_meet_bands, last, distance, similarity), "node long, other long, apart long")
        closed = _united(closed, confirmed(links.select("node", "other") if last else gathered(links, distance), sets, similarity))
    found = named_rows(table, known, closed, SET)
    component = F.when(F.col("size") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    kept = F.coalesce(F.col("doc_id") == component, component.isNull())
    return found.select("doc_id", "text_key", F.col("size").alias("n_shingles"), component.alias("component_id"), kept.alias("kept"))
