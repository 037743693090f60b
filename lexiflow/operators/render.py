"""Markdown editions of translated documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.typography import typography


#: Words that may be small in such a title; fixed values.
SMALL_IN_TITLES = ("of", "the", "and", "in", "to")


def is_probable_subheading(raw: Column, kind: Column) -> Column:
    """A paragraph without markup of two to eight words, up to 80 characters, in title case, that doesn't end like a sentence."""
    bare = T.strip(raw)
    words = F.split(T.normalize(raw), " ")
    plain = (kind == "paragraph") & F.size(words).between(2, 8) & (F.length(bare) <= 80) & ~F.regexp_like(bare, F.lit(r"[.!?;:]$|[\[\]*_`>#|]"))
    return plain & F.forall(words, lambda w: F.regexp_like(w, F.lit(r"^\p{Lu}")) | F.lower(w).isin(*SMALL_IN_TITLES))


def rendered_blocks(segments: DataFrame, titles: DataFrame, content: str = "translated", typeset: bool = True) -> DataFrame:
    """document, ordinal and block of each segment, its section's heading before the first.

    segments: document, section_id, ordinal, raw, kind, output; titles:
    section_id, title, level, translated_title.
    """
    rows = segments.join(titles, "section_id", "left")
    first = F.lag("section_id").over(Window.partitionBy("document", "section_id").orderBy("ordinal")).isNull()
    target = F.coalesce("translated_title", "title")
    both = F.when(target != F.col("title"), F.concat_ws(" / ", "title", target)).otherwise(F.col("title"))
    heading = F.concat(F.repeat(F.lit("#"), F.col("level")), F.lit(" "), target if content == "translated" else both)
    output = F.when(F.col("kind") == "code", F.col("output")).otherwise(typography("output")) if typeset else F.col("output")
    under = (F.col("kind") == "subheading") | is_probable_subheading(F.col("raw"), F.col("kind"))
    marked = F.when(under, F.concat(F.repeat(F.lit("#"), F.least(F.col("level") + 1, F.lit(6))), F.lit(" "), output)).otherwise(output)
    if content == "bilingual":
        quoted = F.regexp_replace("raw", "(?m)^", "> ")
        marked = F.concat(quoted, F.lit("\n\n"), marked, F.lit("\n\n---"))
    return rows.select("document", "section_id", "ordinal", F.when(first & F.col("title").isNotNull(), F.concat(heading, F.lit("\n\n"), marked)).otherwise(marked).alias("block"))


def render(blocks: DataFrame, key: str = "document") -> DataFrame:
    """key and its text: blocks in order, an empty line between them."""
    rows = blocks.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("ordinal", "block"))).alias("_b"))
    return rows.select(key, F.concat(F.array_join(F.transform("_b", lambda b: b["block"]), "\n\n"), F.lit("\n")).alias("markdown"))


def front_matter(title: Column, source_language: Column, target_language: Column, translator: Column, credit: Column | None = None) -> Column:
    """Provenance above an edition, keys in a fixed order."""
    pairs = [("title", title), ("source_language", source_language), ("target_language", target_language), ("translator", translator)]
    if credit is not None:
        pairs.append(("reference_credit", credit))
    lines = [F.concat(F.lit(f"{k}: "), F.to_json(F.array(v)).substr(F.lit(2), F.length(F.to_json(F.array(v))) - 2)) for k, v in pairs]
    return F.concat_ws("\n", F.lit("---"), *lines, F.lit("---\n"))
