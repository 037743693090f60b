"""Token-id files: one concatenated id array a shard, boundaries in Elias-Fano code.

File: ids (little-endian, two bytes each where the vocabulary and the end id
allow, else four), the boundaries' code, the doc_ids' code, a JSON footer, its
length (four bytes) and the magic.  A sequence of n ascending numbers up to u
takes about 2 + log2(u / n) bits each: low bits packed, high bits unary.  The
place of every SAMPLE-th number in the high bits is kept (four bytes a sample);
select goes on from there by counting bits, in the file as in memory, so no
table of offsets is ever made.
"""

from __future__ import annotations

import json
import math
import zlib
import uuid
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .encode import encoder
from .shared import file_system, new_folder
from .textops import ragged, released, slices

MAGIC = b"LXT2"
SAMPLE = 256


class EliasFano:
    """Ascending non-negative numbers, equal ones allowed."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, sampled: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.sampled = n, low_bits, low, high, sampled

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.int64)
        n = len(values)
        if not n:
            return cls(0, 0, *[np.zeros(0, np.uint8)] * 2, np.zeros(0, "<u4"))
        top = int(values[-1])
        bits = max(0, int(math.floor(math.log2(max(1, top) / n)))) if top > n else 0
        if (top >> bits) + n >= 1 << 32:
            raise ValueError("too many numbers for one code")
        low = (values[:, None] >> np.arange(bits)) & 1
        high = np.zeros((top >> bits) + n, np.uint8)
        at = (values >> bits) + np.arange(n)
        high[at] = 1
        return cls(n, bits, np.packbits(low.astype(np.uint8).ravel(), bitorder="little"), np.packbits(high, bitorder="little"), at[::SAMPLE].astype("<u4"))

    def to_bytes(self) -> bytes:
        head = np.array([self.n, self.low_bits, len(self.low), len(self.high)], "<u4").tobytes()
        return head + self.sampled.tobytes() + self.low.tobytes() + self.high.tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> EliasFano:
        n, bits, low, high = np.frombuffer(raw, "<u4", 4).tolist()
        samples = (n + SAMPLE - 1) // SAMPLE
        body = np.frombuffer(raw, np.uint8, offset=16 + 4 * samples)
        return cls(n, bits, body[:low], body[low : low + high], np.frombuffer(raw, "<u4", samples, 16))

    def _low(self, i: int, j: int) -> np.ndarray:
        """The low bits of numbers i to j."""
        a, z = i * self.low_bits, j * self.low_bits
        bits = np.unpackbits(self.low[a >> 3 : (z + 7) >> 3], bitorder="little")[a & 7 : (a & 7) + z - a]
        return (bits.reshape(j - i, self.low_bits).astype(np.int64) << np.arange(self.low_bits)).sum(axis=1)

    def select(self, i: int) -> int:
        """Number i: from its sample on, bytes of high bits are counted, then bits of one byte."""
        at = int(self.sampled[i // SAMPLE])
        left, byte = i % SAMPLE, at >> 3
        word = int(self.high[byte]) >> (at & 7) << (at & 7)
        while (ones := word.bit_count()) <= left:
            left, byte = left - ones, byte + 1
            word = int(self.high[byte])
        for _ in range(left):
            word &= word - 1
        place = byte * 8 + (word & -word).bit_length() - 1
        return (place - i) << self.low_bits | (int(self._low(i, i + 1)[0]) if self.low_bits else 0)

    def block(self, k: int) -> np.ndarray:
        """Select of all numbers from sample k to the next."""
        i, j = k * SAMPLE, min(self.n, (k + 1) * SAMPLE)
        a = int(self.sampled[k])
        z = int(self.sampled[k + 1]) if k + 1 < len(self.sampled) else 8 * len(self.high)
        bits = np.unpackbits(self.high[a >> 3 : (z + 7) >> 3], bitorder="little")[a & 7 :][: z - a]
        high = np.flatnonzero(bits)[: j - i] + a - np.arange(i, j)
        return high << self.low_bits | self._low(i, j) if self.low_bits else high


class ShardWriter:
    def __init__(self, folder: str, part: int, wide: bool):
        self.system, base = file_system(folder)
        self.system.create_dir(base, recursive=True)
        # a name of its own for each attempt; only what the manifest lists counts
        self.name = f"shard-{part:06d}-{uuid.uuid4().hex[:12]}.lxt"
        self.out = self.system.open_output_stream(f"{base}/{self.name}")
        self.kind = "<u4" if wide else "<u2"
        self.ends: list[np.ndarray] = []
        self.docs: list[np.ndarray] = []
        self.nulls = self.n_ids = self.n_docs = 0

    def add(self, doc_ids: pa.Array, ids: np.ndarray, ends: np.ndarray) -> None:
        self.out.write(ids.astype(self.kind).tobytes())
        self.ends.append(ends + self.n_ids)
        self.nulls += doc_ids.null_count
        self.docs.append(doc_ids.drop_null().to_numpy(zero_copy_only=False))
        self.n_ids += len(ids)
        self.n_docs += len(ends)

    def close(self) -> tuple[str, int, int]:
        docs = np.concatenate(self.docs) if self.docs else np.zeros(0, np.int64)
        base = int(docs[0]) if len(docs) else 0
        wide_span = len(docs) and int(docs[-1]) - base >= 1 << 62
        bounds = EliasFano.of(np.concatenate(self.ends) if self.ends else np.zeros(0, np.int64)).to_bytes()
        named = docs.tobytes() if wide_span else EliasFano.of(docs - base).to_bytes()
        foot = json.dumps({"ids": self.n_ids, "docs": self.n_docs, "kind": self.kind, "bounds": len(bounds), "named": len(named), "raw": bool(wide_span), "base": base, "nulls": self.nulls}).encode()
        self.out.write(bounds + named + foot + len(foot).to_bytes(4, "little") + MAGIC)
        self.out.close()
        return self.name, self.n_docs, self.n_ids


class Shard:
    """A file read back; documents are found by select."""

    def __init__(self, folder: str, name: str):
        system, base = file_system(folder)
        with system.open_input_stream(f"{base}/{name}") as source:
            raw = source.read()
        if raw[-4:] != MAGIC:
            raise ValueError(f"{name} is no token file, or is cut short")
        size = int.from_bytes(raw[-8:-4], "little")
        self.foot = foot = json.loads(raw[-8 - size : -8])
        self.ids = np.frombuffer(raw, foot["kind"], foot["ids"])
        at = foot["ids"] * int(foot["kind"][-1])
        self.ends = EliasFano.from_bytes(raw[at : at + foot["bounds"]])
        self.named = raw[at + foot["bounds"] : at + foot["bounds"] + foot["named"]]

    def document(self, i: int) -> np.ndarray:
        return self.ids[self.ends.select(i - 1) if i else 0 : self.ends.select(i)]

    def doc_ids(self) -> pa.Array:
        if self.foot["raw"]:
            known = np.frombuffer(self.named, np.int64)
        else:
            code = EliasFano.from_bytes(self.named)
            known = np.concatenate([np.zeros(0, np.int64), *(code.block(k) for k in range(len(code.sampled)))]) + self.foot["base"]
        return pa.concat_arrays([pa.nulls(self.foot["nulls"], pa.int64()), pa.array(known, pa.int64())])


@released
def _write(folder: str, vocabulary: str, end_id: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part, writer, coder = TaskContext.get().partitionId(), None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        if writer is None:
            coder = encoder(vocabulary)
            writer = ShardWriter(folder, part, coder.wide or end_id >= 1 << 16)
        data, bounds = ragged(batch.column(1))
        for i, j in slices(bounds):
            writer.add(batch.column(0).slice(i, j - i), *coder.documents(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i], end_id))
    if writer is not None:
        name, docs, ids = writer.close()
        yield pa.record_batch([pa.array([part], pa.int32()), pa.array([name]), pa.array([docs], pa.int64()), pa.array([ids], pa.int64())], names=["part", "name", "docs", "ids"])


#: Shards whose base is counted together.
TOGETHER = 4096


def write_token_files(docs: DataFrame, vocabulary: str, end_id: int = 0, folder: str | None = None, shard_bytes: int = 16 << 20) -> DataFrame:
    """Encode every text, each document ended by `end_id`, in ascending doc_id order.

    Returns the manifest, a table in the same folder: a row a shard (folder,
    name, docs, ids, base), where base counts the ids of all shards before.
    Null text: no ids but the end id.  Null doc_id: first.  Rows with one doc_id
    all stay, in the order of a hash of their texts.  Other columns are ignored.
    Ids take two bytes where the vocabulary and end_id allow, else four.  An
    empty table makes no shard.  The files stay until their folder is deleted.
    """
    spark = docs.sparkSession
    folder = folder or new_folder(spark, "tokens")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    parts = max(1, math.ceil(total / shard_bytes))
    ordered = docs.repartitionByRange(parts, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    ordered.mapInArrow(partial(_write, folder, vocabulary, end_id), "part int, name string, docs long, ids long").write.parquet(f"{folder}/manifest")
    shards = spark.read.parquet(f"{folder}/manifest").withColumn("of", F.floor(F.col("part") / TOGETHER))
    before = (Window.unboundedPreceding, -1)
    sums = shards.groupBy("of").agg(F.sum("ids").alias("all"))
    sums = sums.select("of", F.coalesce(F.sum("all").over(Window.orderBy("of").rowsBetween(*before)), F.lit(0)).alias("ahead"))
    own = F.coalesce(F.sum("ids").over(Window.partitionBy("of").orderBy("part").rowsBetween(*before)), F.lit(0))
    return shards.withColumn("own", own).join(sums, "of").select(F.lit(folder).alias("folder"), "name", "docs", "ids", (F.col("own") + F.col("ahead")).alias("base"))


@released
def _read(with_ids: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            shard = Shard(r["folder"], r["name"])
            raw = memoryview(shard.ids.astype("<u4").tobytes())
            doc_ids, last = shard.doc_ids(), 0
            for k in range(len(shard.ends.sampled)):
                ends = shard.ends.block(k)
                begin = np.concatenate(([last], ends[:-1]))
                last = int(ends[-1])
                spans = list(zip(begin.tolist(), ends.tolist()))
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in spans]
                columns = [doc_ids.slice(k * SAMPLE, len(ends)), pa.array(begin + r["base"], pa.int64()), pa.array(ends - begin, pa.int64()), pa.array(crc, pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array([shard.ids[a:b].astype(np.int64).tolist() for a, b in spans], pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.record_batch(columns, names=names)


def read_token_files(manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """Documents of token files: doc_id, start, n_tokens, ids_crc32 (and ids)."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    spread = manifest.repartition(max(1, manifest.count()), "base")
    return spread.mapInArrow(partial(_read, with_ids), schema)
