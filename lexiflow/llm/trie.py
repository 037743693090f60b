"""Prefix trie of conversations by smallest-member ownership.

A node is a distinct sequence of first turns, and belongs to the member with the
smallest conv_id.  Whoever owns a node also owns all nodes behind it on its own
path, so a conversation owns a suffix of its path and one number a conversation,
the depth where that begins, marks all owned nodes.  What a subtree sums over its
nodes is then summed over its members instead: the tokens of all occurrences minus
those of owned ones, and a flag at each conversation that owns a leaf.  One
group-by over prefixes gives it; no node is joined with its descendants.

Turns are ranked, and paths summed up, in blocks of BLOCK turns with the totals of
the blocks before added, so a conversation of any length is split over tasks.
Nodes are told apart by their depth and 128 bits of hash.  Group-bys are combined
before they are sent, so a prefix that all conversations have is one row a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import shared_dir

#: Turns of a conversation that are ranked or summed up together.
BLOCK = 1024
#: Width of the ranges of conv_ids that are joined to one text before they are digested.
RANGE = 4096
WORDS = ["w1", "w2", "w3", "w4"]
NODE = ["depth", *WORDS]


def _before(rows: DataFrame, key: list[str], sums: dict[str, Column]) -> DataFrame:
    """(key..., and each sum over the blocks before) for every block of rows; key ends with the block."""
    ahead = Window.partitionBy(*key[:-1]).orderBy(key[-1]).rowsBetween(Window.unboundedPreceding, -1)
    each = rows.groupBy(*key).agg(*[c.alias(name) for name, c in sums.items()])
    return each.select(*key, *[F.coalesce(F.sum(name).over(ahead), F.lit(0)).cast("long").alias(name) for name in sums])


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, name, size): turns in order, a digest of role and text, and the code points of the text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256).alias("name"),
        F.char_length(text).cast("long").alias("size"),
    )
    turns = turns.withColumn("block", F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(1 << 62))))
    ranked = turns.withColumn("pos", F.row_number().over(Window.partitionBy("conv_id", "block").orderBy(F.asc_nulls_first("turn"), "name")))
    ahead = _before(turns, ["conv_id", "block"], {"ahead": F.count("*")})
    return ranked.join(ahead, ["conv_id", "block"]).select("conv_id", (F.col("pos") + F.col("ahead")).alias("pos"), "name", "size")


def rebuild(conversations: DataFrame, group: int = 100, shared: int = 6) -> DataFrame:
    """(conv_id, depth, name, size, turns): each conversation c with the first h turns of conversation
    c - c % group in place of its own first h; h = crc32(c) % shared.

    Depth 0 stands for the beginning, turns for the turns of the rebuilt conversation.
    """
    shared_dir(conversations.sparkSession)
    own = numbered_turns(conversations).checkpoint()
    lengths = own.groupBy("conv_id").agg(F.count("*").alias("n"))
    known = lengths.select("conv_id", "n", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % shared).alias("h"), (F.col("conv_id") - F.col("conv_id") % group).alias("base"))
    known = known.join(lengths.select(F.col("conv_id").alias("base"), F.col("n").alias("has")), "base", "left")
    known = known.withColumn("taken", F.least("h", F.coalesce("has", F.lit(0)))).withColumn("turns", F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    known = known.select("conv_id", "base", "h", "taken", "turns").checkpoint()
    lent = own.where((F.col("conv_id") % group == 0) & (F.col("pos") < shared)).withColumnRenamed("conv_id", "base")
    heads = known.where("taken > 0").join(lent, "base").where("pos <= h").select("conv_id", F.col("pos").alias("depth"), "name", "size", "turns")
    tails = own.join(known, "conv_id").where("pos > h").select("conv_id", (F.col("taken") + F.col("pos") - F.col("h")).alias("depth"), "name", "size", "turns")
    start = known.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit("").alias("name"), F.lit(0).cast("long").alias("size"), "turns")
    return start.unionByName(heads).unionByName(tails)


def _paths(steps: DataFrame) -> DataFrame:
    """steps(conv_id, depth, name, size, turns) as conv_id, the NODE of each prefix, up1.. of its parent, size, upto (tokens so far), turns."""
    digest = F.sha2(F.concat(F.col("depth").cast("string"), F.lit("/"), F.col("name")).cast("binary"), 256)
    word = lambda k: F.when(F.col("depth") > 0, F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long")).otherwise(F.lit(0).cast("long"))
    steps = steps.select("*", *[word(k).alias(f"own{k + 1}") for k in range(4)], F.floor(F.col("depth") / BLOCK).alias("block"))
    sums = {f"w{k + 1}": F.sum(f"own{k + 1}") for k in range(4)} | {"upto": F.sum("size")}
    ahead = _before(steps, ["conv_id", "block"], sums).select("conv_id", "block", *[F.col(c).alias(f"a_{c}") for c in sums])
    so_far = Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    run = {f"w{k + 1}": f"own{k + 1}" for k in range(4)} | {"upto": "size"}
    summed = steps.select("conv_id", "block", "depth", "size", "turns", *[f"own{k + 1}" for k in range(4)], *[F.sum(c).over(so_far).alias(name) for name, c in run.items()])
    met = summed.join(ahead, ["conv_id", "block"])
    full = {name: F.col(name) + F.col(f"a_{name}") for name in run}
    return met.select("conv_id", "depth", *[full[w].alias(w) for w in WORDS], *[(full[f"w{k + 1}"] - F.col(f"own{k + 1}")).alias(f"up{k + 1}") for k in range(4)], "size", full["upto"].alias("upto"), "turns")


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A node's pieces, in order and each in one row, as one digest; a node's digest goes on from batch to batch."""
    node, digest, done = None, None, []

    def result() -> pa.RecordBatch:
        columns = list(zip(*done))
        return pa.record_batch([*(pa.array(c, pa.int64()) for c in columns[:-1]), pa.array(columns[-1], pa.string())], names=[*NODE, "ends_sha256"])

    for batch in batches:
        *keys, pieces = (c.to_pylist() for c in batch.columns)
        for key, piece in zip(zip(*keys), pieces):
            if key != node:
                if node is not None:
                    done.append((*node, digest.hexdigest()))
                node, digest = key, hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(piece.encode())
        if len(done) >= 4096:
            yield result()
            done = []
    if node is not None:
        done.append((*node, digest.hexdigest()))
        yield result()


def _ends(paths: DataFrame) -> DataFrame:
    """(NODE, ends_sha256) of the nodes where conversations end."""
    ended = paths.where("depth = turns").select(*NODE, "conv_id", F.floor(F.col("conv_id") / RANGE).alias("part"))
    pieces = ended.groupBy(*NODE, "part").agg(F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("piece"))
    dealt = pieces.repartition(*NODE).sortWithinPartitions(*NODE, "part").select(*NODE, "piece")
    return dealt.mapInArrow(_digested, ", ".join(f"{c} long" for c in NODE) + ", ends_sha256 string")


def prefix_trie(steps: DataFrame) -> DataFrame:
    """Per node of the trie of steps(conv_id, depth, name, size, turns), as rebuild() gives them: conv_id, depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 (all long but the last)."""
    shared_dir(steps.sparkSession)
    paths = _paths(steps).checkpoint()
    owners = paths.groupBy(*NODE).agg(F.min("conv_id").alias("conv_id"), F.max("turns").alias("longest"))
    # from which depth on a conversation owns its path, and whether it owns a leaf
    owned = owners.groupBy("conv_id").agg(F.min("depth").alias("begins"), F.max(F.col("longest") == F.col("depth")).cast("long").alias("leaf"))
    marked = paths.join(owned, "conv_id", "left")
    begins = F.coalesce("begins", F.col("turns") + 1)
    shared = marked.groupBy("conv_id").agg(F.max(begins).alias("begins"), F.max(F.coalesce("leaf", F.lit(0))).alias("leaf"), F.coalesce(F.max(F.when(F.col("depth") < begins, F.col("upto"))), F.lit(0)).alias("shared"))
    met = paths.join(shared, "conv_id")
    # tokens of the path from here on, minus those of owned nodes
    unowned = F.when(F.col("depth") < F.col("begins"), F.col("shared") - F.col("upto") + F.col("size")).otherwise(F.lit(0))
    child = ((F.col("depth") < F.col("turns")) & (F.col("depth") + 1 >= F.col("begins"))).cast("long")
    ups = [f"up{k + 1}" for k in range(4)]
    nodes = met.groupBy(*NODE).agg(
        F.min(F.struct("conv_id", "begins")).alias("owner"),
        *[F.min(c).alias(c) for c in ups],
        F.count("*").alias("n_convs"),
        F.sum(child).alias("n_children"),
        F.sum("leaf").alias("n_leaves"),
        F.sum(unowned).alias("saved_tokens"),
    )
    nodes = nodes.join(_ends(paths), NODE, "left").checkpoint()
    total = nodes.count()
    # the owner owns the parent too, but where its own part of the path begins
    columns = [F.col("owner.conv_id").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256")]
    inside = nodes.where("depth = 0 OR owner.begins < depth").withColumn("parent_conv_id", F.when(F.col("depth") > 0, F.col("owner.conv_id")))
    first = nodes.where("depth > 0 AND owner.begins = depth")
    parents = nodes.where("n_children > 0").select((F.col("depth") + 1).alias("depth"), *[F.col(w).alias(u) for w, u in zip(WORDS, ups)], F.col("owner.conv_id").alias("parent_conv_id"), "n_children")
    # under a thousand nodes are the parents of more than a thousandth of all
    large = F.col("n_children") * 1000 > total
    hot, rest = (parents.where(x).drop("n_children") for x in (large, ~large))
    near = first.join(F.broadcast(hot), ["depth", *ups], "left")
    far = near.where("parent_conv_id IS NULL").drop("parent_conv_id").join(rest, ["depth", *ups])
    return inside.select(*columns).unionByName(near.where("parent_conv_id IS NOT NULL").select(*columns)).unionByName(far.select(*columns))


def conversation_trie(conversations: DataFrame, group: int = 100, shared: int = 6) -> DataFrame:
    """The trie of all rebuilt conversations (see rebuild and prefix_trie).

    Turns are ordered by turn, null first; of equal ones by a digest of role and
    text.  Null roles and texts are empty.  A repeated row is a turn of its own.
    Rows without conv_id belong to no conversation and are left out.  Texts of any
    length are digested before anything is moved.  Other columns are ignored; an
    empty table has no nodes, not even a root.
    """
    return prefix_trie(rebuild(conversations, group, shared))
