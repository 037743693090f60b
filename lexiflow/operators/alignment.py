"""Alignment of a source edition with a reference edition."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def align(source: DataFrame, reference: DataFrame, book: str = "book", key: str = "chapter_key") -> DataFrame:
    """Sections of one chapter key; of several with a key the last (highest ordinal) counts."""

    def last(sections: DataFrame, name: str) -> DataFrame:
        return sections.where(F.col(key).isNotNull()).groupBy(book, key).agg(F.max_by("section_id", "ordinal").alias(f"{name}_section_id"), F.max("ordinal").alias(f"{name}_ordinal"))

    met = last(source, "source").join(last(reference, "reference"), [book, key])
    return met.withColumn("method", F.lit("chapter-key")).withColumn("confidence", F.lit(0.98))


def in_chapter_order(sections: DataFrame, book: str = "book", key: str = "chapter_key") -> DataFrame:
    """Sections that have a chapter key with chapter_number, its numeric end, and place (from 1) in that order; of equals by ordinal."""
    numbered = sections.where(F.col(key).isNotNull()).withColumn("chapter_number", F.nullif(F.regexp_extract(key, "([0-9]+)$", 1), F.lit("")).cast("int"))
    return numbered.withColumn("place", F.row_number().over(Window.partitionBy(book).orderBy("chapter_number", "ordinal")))


def ranges(aligned: DataFrame, sections: DataFrame, book: str = "book") -> DataFrame:
    """source_section_id and each reference section from its start to before the next aligned start.

    Each reference section takes the last start at or before it: one sorted pass
    over the union of starts and sections, no range join.
    """
    starts = aligned.select(book, F.col("reference_ordinal").alias("ordinal"), F.col("source_section_id").alias("_start"), F.lit(None).cast(sections.schema["section_id"].dataType).alias("section_id"))
    rows = sections.select(book, "ordinal", F.lit(None).cast(aligned.schema["source_section_id"].dataType).alias("_start"), "section_id")
    w = Window.partitionBy(book).orderBy("ordinal", F.col("_start").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    met = starts.unionByName(rows).withColumn("source_section_id", F.last("_start", ignorenulls=True).over(w))
    return met.where("section_id IS NOT NULL AND source_section_id IS NOT NULL").select(book, "source_section_id", F.col("section_id").alias("reference_section_id"), F.col("ordinal").alias("reference_ordinal"))


def proportional_window(source: DataFrame, reference: DataFrame, key: str) -> DataFrame:
    """source_pos and the reference rows around its share of the way (one before to one after; half to even).

    source: key, pos, n; reference: key, pos, n (counts a key).
    """
    left = source.select(key, F.col("pos").alias("source_pos"), F.col("n").alias("source_n"))
    sizes = reference.groupBy(key).agg(F.max("n").alias("reference_n"))
    centred = left.join(sizes, key).withColumn("center", F.bround(F.col("source_pos") / F.greatest(F.lit(1), F.col("source_n") - 1) * F.greatest(F.lit(0), F.col("reference_n") - 1)).cast("long"))
    around = centred.withColumn("pos", F.explode(F.sequence(F.greatest(F.lit(0).cast("long"), F.col("center") - 1), F.col("center") + 1)))
    return around.join(reference.drop("n"), [key, "pos"]).drop("source_n", "reference_n")


def reference_text(rows: DataFrame, adaptations: DataFrame) -> DataFrame:
    """text of a reference segment: adapted, else raw, else plain."""
    met = rows.join(adaptations.select(F.col("reference_segment_id").alias("segment_id"), "adapted_text"), "segment_id", "left")
    return met.withColumn("reference_text", F.coalesce("adapted_text", F.nullif("raw", F.lit("")), "text")).drop("adapted_text")


def best_sections(documents: DataFrame, sections: DataFrame, segments: DataFrame, book: str = "book") -> DataFrame:
    """The section of a book that each of its source documents (name, content) is.

    A title in the content counts 1,000, each of its segments of 12 characters or
    more that stands in it 1; of equals the first section.  Pairs are made within
    a book only.
    """
    titled = documents.join(sections, book).where(F.contains("content", "title")).select(book, "name", "section_id", F.lit(1000).alias("score"))
    held = documents.join(segments.where("length(text) >= 12"), book).where(F.contains("content", "text")).select(book, "name", "section_id", F.lit(1).alias("score"))
    scores = titled.unionByName(held).groupBy(book, "name", "section_id").agg(F.sum("score").alias("score")).join(sections.select("section_id", "ordinal"), "section_id")
    return scores.groupBy(book, "name").agg(F.max_by(F.struct("section_id", "ordinal", "score"), F.struct("score", -F.col("ordinal"))).alias("b")).select(book, "name", "b.section_id", "b.ordinal", "b.score")


def convert(rows: DataFrame, dictionary: DataFrame, text: str = "text", longest: int = 8) -> DataFrame:
    """text with the longest dictionary phrases (phrase, adapted) put in place of what they match, left to right.

    The dictionary is a table of the caller's; it is made one map value, so it
    is refused above 200,000 entries.
    """
    if dictionary.count() > 200_000:
        raise ValueError("the dictionary has over 200,000 entries")
    whole = dictionary.agg(F.map_from_entries(F.collect_list(F.struct("phrase", "adapted"))).alias("_m"))
    zero = F.struct(F.lit("").alias("out"), F.lit(0).alias("skip"))

    def step(state, at):
        tries = F.filter(F.transform(F.sequence(F.lit(longest), F.lit(1), F.lit(-1)), lambda n: F.substring(F.col(text), at, n)), lambda p: F.map_contains_key("_m", p))
        hit = F.get(tries, F.lit(0))
        return F.when(state["skip"] > 0, F.struct(state["out"].alias("out"), (state["skip"] - 1).alias("skip"))).otherwise(
            F.struct(F.concat(state["out"], F.coalesce(F.element_at("_m", hit), F.substring(F.col(text), at, F.lit(1)))).alias("out"), (F.coalesce(F.length(hit), F.lit(1)) - 1).alias("skip"))
        )

    places = F.when(F.length(text) > 0, F.sequence(F.lit(1), F.length(text))).otherwise(F.array().cast("array<int>"))
    return rows.crossJoin(F.broadcast(whole)).withColumn("adapted_text", F.aggregate(places, zero, step)["out"]).drop("_m")
