"""Exact dedup through an extendible-hash index on shared files.

Index: a directory over the leading bits of a 64-bit text hash, which points to
buckets, and files of buckets' entries.  The directory doubles until no bucket
holds more than `capacity` keys; only overfull buckets are split, so each bucket
has a depth of its own and several pointers may name it.  Texts are sent to the
owners of their buckets, which are ranges of keys.  An owner compares the bytes of
the texts of a key: equal ones become one entry with the largest doc_id and their
number, different ones are chained.  Keys of more than a thousandth of all rows,
under a thousand of them, are combined in SALTS parts before they are sent, so a
group of any size is SALTS texts at most to its owner.

Lookup: a row finds its bucket through the directory, and in the bucket the
chain of its hash; along the chain it is told apart by its address, the SHA-256
of its text.  The owner fails if two texts of a chain had one address, so equal
addresses in the index are equal bytes.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import new_folder, shared_dir

#: Parts that copies of a frequent text are combined in.
SALTS = 64
#: Directories of more pointers than this are joined by a shuffle, not a broadcast (16 bytes each).
MOST_BROADCAST = 1 << 18


def normal(text: Column) -> Column:
    """Lower-cases A-Z alone; null: empty."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def cell_of(key: Column, depth: int) -> Column:
    """The `depth` leading bits."""
    return F.shiftrightunsigned(key, 64 - depth).cast("long") if depth else F.lit(0).cast("long")


def directory(keys: DataFrame, capacity: int, n: int) -> tuple[DataFrame, int]:
    """((cell, bucket, depth) of every pointer, depth of the directory) for keys(key), each once, about n.

    A prefix of leading bits is a bucket if it holds at most `capacity` keys and
    the prefix above it, one bit shorter, holds more; a bucket is named by its
    first cell.
    """
    depth = max(0, math.ceil(math.log2(max(1, n) / capacity)) + 1)
    while True:
        cells = keys.groupBy(cell_of(F.col("key"), depth).alias("cell")).count()
        if depth >= 64 or not depth or not cells.where(F.col("count") > capacity).limit(1).count():
            break
        depth += 1  # doubles the directory
    levels = cells.withColumn("depth", F.explode(F.sequence(F.lit(0), F.lit(depth))))
    held = levels.groupBy("depth", F.expr(f"shiftright(cell, {depth} - depth)").alias("prefix")).agg(F.sum("count").alias("held")).checkpoint()
    full = held.where(F.col("held") > capacity).select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("above"))
    # both halves of an overfull prefix, also one without keys
    halves = full.withColumn("prefix", F.explode(F.array(F.col("above") * 2, F.col("above") * 2 + 1))).select("depth", "prefix")
    root = full.sparkSession.range(1).select(F.lit(0).alias("depth"), F.lit(0).cast("long").alias("prefix"))
    split = held.where((F.col("held") > capacity) & (F.col("depth") < depth)).select("depth", "prefix")
    buckets = root.union(halves).where(F.col("depth") <= depth).join(split, ["depth", "prefix"], "left_anti")
    first = F.expr(f"shiftleft(prefix, {depth} - depth)")
    width = F.expr(f"shiftleft(1L, {depth} - depth)")
    return buckets.select(F.explode(F.sequence(first, first + width - 1)).alias("cell"), first.alias("bucket"), F.col("depth").cast("int").alias("depth")), depth


def _pointed(rows: DataFrame, pointers: DataFrame, depth: int) -> DataFrame:
    """rows(key, ...) with bucket and depth, through the directory."""
    small = 1 << depth <= MOST_BROADCAST
    return rows.withColumn("cell", cell_of(F.col("key"), depth)).join(F.broadcast(pointers) if small else pointers, "cell").drop("cell")


def exact_groups(docs: DataFrame, capacity: int = 500, folder: str | None = None) -> DataFrame:
    """Per row of docs: doc_id, keep_id, group_size, kept, text_sha256, bucket, depth, chain.

    Texts are equal when their bytes are after normal().  The row with the
    largest doc_id stays; of several rows with that doc_id, all do.  A group
    without any doc_id has no keep_id, and as nothing tells its rows apart, all
    of them are kept: no text is lost.  Other columns are ignored; an empty table
    has no rows; texts of any length are compared whole.
    """
    spark = docs.sparkSession
    shared_dir(spark)
    folder = folder or new_folder(spark, "index")
    text = normal(F.col("text"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("norm")).withColumn("key", F.xxhash64("norm"))
    address = F.sha2(F.col("norm").cast("binary"), 256)
    rows.select("doc_id", "key", address.alias("text_sha256")).write.parquet(f"{folder}/log")
    log = spark.read.parquet(f"{folder}/log")
    total = log.count()

    keys = log.select("key").distinct()
    found, depth = directory(keys, capacity, total)
    found.write.parquet(f"{folder}/directory")
    pointers = spark.read.parquet(f"{folder}/directory")

    # frequent keys are combined first
    frequent = log.groupBy("key").count().where(F.col("count") * 1000 > total).select("key").checkpoint()
    texts = rows.join(F.broadcast(frequent), "key", "left_anti").select("key", "norm", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    if frequent.count():
        salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))
        copies = rows.join(F.broadcast(frequent), "key", "left_semi").groupBy("key", "norm", salt.alias("salt")).agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        texts = texts.unionByName(copies.drop("salt"))
    # owners: equal bytes are one entry, entries of one hash are a chain
    sent = _pointed(texts, pointers, depth).repartition("bucket")
    entries = sent.groupBy("bucket", "depth", "key", "norm").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size")).withColumn("text_sha256", address).drop("norm")
    chain = Window.partitionBy("bucket", "key").orderBy("text_sha256")
    entries = entries.withColumn("chain", F.row_number().over(chain)).withColumn("twin", F.lag("text_sha256").over(chain))
    collision = F.raise_error(F.lit("two texts have one address"))
    entries = entries.withColumn("text_sha256", F.when(F.col("twin") == F.col("text_sha256"), collision).otherwise(F.col("text_sha256"))).drop("twin")
    entries.write.parquet(f"{folder}/entries")
    index = spark.read.parquet(f"{folder}/entries")

    # groups of over a thousandth of all rows are under a thousand: those entries are broadcast
    large = F.col("group_size") * 1000 > total
    at, names = ["bucket", "key", "text_sha256"], ["keep_id", "group_size", "depth", "chain"]
    hot = index.where(large).select(*at, F.struct(*names).alias("hot"))
    rest = index.where(~large).select(*at, F.struct(*names).alias("of"))
    met = _pointed(log, pointers, depth).drop("depth").join(F.broadcast(hot), at, "left")
    alone = met.where("hot IS NULL").drop("hot").join(rest, at)
    both = met.where("hot IS NOT NULL").withColumnRenamed("hot", "of").unionByName(alone)
    kept = F.coalesce(F.col("doc_id") == F.col("of.keep_id"), F.col("of.keep_id").isNull())
    return both.select("doc_id", "of.keep_id", "of.group_size", kept.alias("kept"), "text_sha256", "bucket", "of.depth", "of.chain")
