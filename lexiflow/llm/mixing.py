"""Mixing sources to target weights by systematic sampling.

Sources get targets by weight, none above a multiple of its size.  Within a
source every document expects target / size copies; along the source's order
these are summed, one random offset is added, and a document is emitted once
for each integer boundary that the sum crosses.

The order is by size: classes of sizes within a sixteenth of an octave, the
largest first.  What a class leaves of a copy is carried to the next class in
words, so that a source's taken words stay near its target whatever the sizes.
So a class's copies are a whole number (a fold over a source's few hundred
classes, with the source's offset), and each of its documents expects an equal part
of them; the prefix sum runs over all documents of the source, class by class, and
the same offset decides which of them cross a boundary.  Documents of a class are
ranked in SALTS parts by a hash of the doc_id: no source and no class is ever one
task's, and the parts don't depend on the table's size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import columns, row_hash, shared_dir, unused

#: Parts that a class's rows are ranked in.
SALTS = 256
WORD = r"[^\x20\x09-\x0D]+"


def _hex(text: Column, digits: int) -> Column:
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, digits), 16, 10).cast("long")


def _targets(sources: DataFrame, weights: tuple[int, ...], share: float, most: int) -> DataFrame:
    """target of each row of sources(site, source, source_size)."""
    every, turn = Window.orderBy(F.col("source").isNull(), "source"), F.array(*map(F.lit, weights))
    sources = sources.withColumn("weight", F.element_at(turn, ((F.row_number().over(every) - 1) % len(weights) + 1).cast("int")).cast("double"))
    sources = sources.withColumn("cap", F.col("source_size") * F.lit(float(most))).withColumn("ratio", F.col("cap") / F.col("weight"))
    before = Window.orderBy("ratio", "site").rowsBetween(Window.unboundedPreceding, -1)
    rest = Window.orderBy("ratio", "site").rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy()
    sources = sources.withColumn("all_size", F.sum("source_size").over(whole))
    sources = sources.withColumn("level", (F.col("all_size") * F.lit(share) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest))
    sources = sources.withColumn("level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "site", "level"))).over(whole)["level"])
    return sources.withColumn("target", F.least("cap", F.coalesce(F.col("level") * F.col("weight"), "cap")))


def _copies_of_classes(classes: DataFrame, most: int, seed: str) -> DataFrame:
    """(site, class, docs, take, offset): the copies that each class takes, from classes(site, class, docs, words, target, source_size)."""
    listed = classes.groupBy("site", "target", "source_size").agg(F.sort_array(F.collect_list(F.struct((-F.col("class")).alias("place"), "docs", "words"))).alias("list"))
    expects = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    offset = _hex(F.concat(F.lit(seed), "site"), 8).cast("double") / F.lit(4294967296.0)
    none = F.expr("cast(array() as array<struct<place:int,docs:bigint,take:bigint>>)")

    def step(state: Column, c: Column) -> Column:
        mean = c["words"] / c["docs"]
        # what earlier classes left over, or took too much, is worth so many copies of this size
        due = F.col("expects") * c["docs"] + F.when(mean > 0, state["left"] / mean).otherwise(F.lit(0.0))
        take = F.least(F.greatest(F.floor(due + F.col("offset")), F.lit(0)), F.lit(most) * c["docs"])
        done = F.struct(c["place"].alias("place"), c["docs"].alias("docs"), take.alias("take"))
        return F.struct(((due - take) * mean).alias("left"), F.concat(state["done"], F.array(done)).alias("done"))

    start = F.struct(F.lit(0.0).alias("left"), none.alias("done"))
    folded = listed.withColumn("expects", expects).withColumn("offset", offset).withColumn("done", F.aggregate("list", start, step)["done"])
    return folded.select("site", "offset", F.inline("done")).select("site", (-F.col("place")).alias("class"), "docs", "take", "offset")


def _mixed(sized: DataFrame, weights: tuple[int, ...], share: float, most: int, seed: str) -> DataFrame:
    """sized(doc_id, source, size, row_key) with source_size, target, copies and taken."""
    named = sized.withColumn("site", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")))
    octave = "length(bin(size))"
    named = named.withColumn("class", F.expr(f"if(size = 0, 0, {octave} * 16 + cast(shiftright(size * 16, {octave} - 1) & 15 AS int))"))
    counted = named.groupBy("site", "source", "class").agg(F.count("*").alias("docs"), F.sum("size").alias("words"))
    sources = _targets(counted.groupBy("site", "source").agg(F.sum("words").alias("source_size")), weights, share, most).select("site", "source_size", "target")
    taking = _copies_of_classes(counted.join(sources, "site"), most, seed)

    # ranks within a class: by salt, then in order within the salt
    salted = named.withColumn("salt", F.coalesce(_hex(F.col("doc_id").cast("string"), 7), F.col("row_key")).bitwiseAND(F.lit(SALTS - 1)))
    key = ["site", "class", "salt"]
    ahead = salted.groupBy(*key).agg(F.count("*").alias("n"))
    ahead = ahead.withColumn("ahead", F.sum("n").over(Window.partitionBy("site", "class").orderBy("salt").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).drop("n")
    ahead = ahead.join(taking, ["site", "class"]).join(sources, "site")
    ranked = salted.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("size"), "doc_id", "row_key"))).join(ahead, key)
    # copies of earlier classes are whole numbers and change no boundary
    place = F.col("ahead") + F.col("rank")
    upto = lambda number: F.floor(F.col("take") * number / F.col("docs") + F.col("offset"))
    copies = F.when(place < F.col("docs"), upto(place)).otherwise(F.col("take")) - upto(place - 1)
    return ranked.withColumn("copies", copies).select("doc_id", "source", "row_key", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: int = 2, seed: str = "mix") -> DataFrame:
    """Per row of docs: doc_id, size, source_size, target, copies, taken, source, and row_key (a hash of all its columns).

    Sources in order (null last) weigh `weights` by turns and share `share`
    times all words; a target stops at `most` times its source, the excess is
    shared again by weight.  Null text: size 0, and copies like any other (in a
    source without words none).  seed: of the offsets, one a source; over many seeds
    a row's copies are target / source_size on average.  Rows of one doc_id and size are in the order of
    row_key, so runs agree; only equal rows are interchangeable.  Null doc_ids
    are dealt by row_key.  Other columns count in row_key alone.  An empty table has
    no rows.
    """
    shared_dir(docs.sparkSession)
    sized = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        row_hash(docs).alias("row_key"),
    ).checkpoint()
    return _mixed(sized, weights, share, most, seed)


def emit(docs: DataFrame, **more) -> DataFrame:
    """docs with each row as often as mix() takes it, all columns as they are; of equal rows any is as good."""
    a, b, n, taken, copy = unused(docs, "id_key", "row_key", "number", "copies", "copy")
    # equal rows are numbered, and the first of them is emitted for all
    total = mix(docs, **more).groupBy(F.coalesce(F.col("doc_id"), F.lit(0)).alias(a), F.col("row_key").alias(b)).agg(F.sum("copies").alias(taken)).where(F.col(taken) > 0)
    keyed = docs.withColumn(a, F.coalesce(F.col("doc_id").cast("long"), F.lit(0))).withColumn(b, row_hash(docs))
    met = keyed.join(total, [a, b]).withColumn(n, F.row_number().over(Window.partitionBy(a, b).orderBy(F.lit(0)))).where(F.col(n) == 1)
    return met.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(taken).cast("int")))).select(*columns(docs))
