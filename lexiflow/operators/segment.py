"""Markdown documents to sections, segments and units, many documents at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import markdown
from ..functions.ids import stable_id, stable_id_of_array


def segment_documents(docs: DataFrame, unit_size: int = 3) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sections, segments, units) of docs(document_id, title, markdown).

    A heading opens a section; text before any gets one with the document's
    title.  Blocks without visible text make no segment.  Units are up to
    `unit_size` segments of one section.  A document is windowed in one task
    each, so what bounds a task is a document's length.
    """
    rows = docs.select("document_id", F.col("title").alias("document_title"), F.posexplode(markdown.blocks(F.col("markdown"))).alias("block_no", "b"))
    blocks = rows.select("document_id", "document_title", "block_no", *markdown.described(F.col("b")))
    order, whole = Window.partitionBy("document_id").orderBy("block_no"), Window.partitionBy("document_id")
    heading = (F.col("kind") == "heading").cast("int")
    blocks = blocks.withColumn("_h", F.sum(heading).over(order))
    blocks = blocks.withColumn("_implicit", (F.min("_h").over(whole) == 0).cast("int")).withColumn("_section", F.col("_h") - 1 + F.col("_implicit"))
    blocks = blocks.withColumn("_section", F.greatest("_section", F.lit(0)))

    opened = blocks.where("kind = 'heading'").select("document_id", "title", "level", F.col("_section").alias("ordinal"))
    implied = blocks.where("_h = 0").select("document_id", F.col("document_title").alias("title"), F.lit(1).alias("level"), F.lit(0).cast("long").alias("ordinal")).distinct()
    sections = opened.unionByName(implied).select(stable_id("sec", F.col("document_id"), F.col("ordinal"), F.col("title")).alias("id"), "document_id", "title", "level", F.col("ordinal").cast("int").alias("ordinal"))

    body = blocks.where("kind <> 'heading' AND text <> ''").join(sections.select(F.col("id").alias("section_id"), "document_id", F.col("ordinal").alias("_section")), ["document_id", "_section"])
    body = body.withColumn("ordinal", F.row_number().over(order) - 1)
    segments = body.select(
        stable_id("seg", F.col("document_id"), F.col("section_id"), F.col("ordinal"), F.col("text")).alias("id"),
        "document_id", "section_id", "ordinal", "text", "kind", "raw", "source_locator", "format_signature",
    )

    place = F.row_number().over(Window.partitionBy("section_id").orderBy("ordinal")) - 1
    chunked = segments.withColumn("_chunk", F.floor(place / unit_size)).groupBy("document_id", "section_id", "_chunk").agg(F.array_sort(F.collect_list(F.struct("ordinal", "id"))).alias("_s"))
    units = chunked.withColumn("segment_ids", F.transform("_s", lambda x: x["id"])).withColumn("ordinal", F.row_number().over(Window.partitionBy("document_id").orderBy(F.col("_s")[0]["ordinal"])) - 1)
    units = units.select(stable_id_of_array("unit", F.col("section_id"), F.col("segment_ids")).alias("id"), "section_id", "segment_ids", "ordinal")
    return sections, segments, units


def context_packets(units: DataFrame, segments: DataFrame, summaries: DataFrame | None = None, references: DataFrame | None = None) -> DataFrame:
    """unit_id, source_segments, previous_text and next_text (document order, across sections), summary, reference_texts."""
    members = units.select(F.col("id").alias("unit_id"), F.col("section_id").alias("_sec"), F.explode("segment_ids").alias("id")).join(segments, "id")
    near = segments.select("document_id", "ordinal", F.col("text").alias("_t"))
    packed = members.groupBy("unit_id", F.col("_sec").alias("section_id"), "document_id").agg(
        F.array_sort(F.collect_list(F.struct("ordinal", "id", "text", "raw", "kind"))).alias("source_segments"), F.min("ordinal").alias("_a"), F.max("ordinal").alias("_b")
    )
    before = near.select("document_id", (F.col("ordinal") + 1).alias("_a"), F.col("_t").alias("previous_text"))
    after = near.select("document_id", (F.col("ordinal") - 1).alias("_b"), F.col("_t").alias("next_text"))
    out = packed.join(before, ["document_id", "_a"], "left").join(after, ["document_id", "_b"], "left").drop("_a", "_b")
    if summaries is not None:
        out = out.join(summaries.select("section_id", F.col("summary").alias("section_summary")), "section_id", "left")
    if references is not None:
        out = out.join(references.select("unit_id", "reference_texts"), "unit_id", "left")
    return out
