"""Line dedup by distinct-site spread.

HyperLogLog sketches of the sites of each line hash merge by aggregation.  A
line whose estimate is clearly above the threshold is boilerplate; one near it
gets an exact distinct count.  Boilerplate lines go from every document but the
first (smallest doc_id) that has them, so nothing is lost from the corpus.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import column, row_hash, shared_dir, unused

BLANK = " \t\r\x0b\x0c"
KEY = ["h1", "h2"]
#: Parts that each line is dealt to when it meets the lines found.
SALTS = 32


def _lines(docs: DataFrame) -> DataFrame:
    """doc_id, row_key, site, pos and two independent 64-bit hashes of each line with content."""
    parts = docs.select("doc_id", "row_key", "site", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    parts = parts.withColumn("line", F.btrim("line", F.lit(BLANK))).where("line <> ''")
    return parts.select("doc_id", "row_key", "site", "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"))


def salted(lines: DataFrame, found: DataFrame) -> DataFrame:
    """lines joined with found by KEY; a line that all documents have is dealt to SALTS tasks."""
    copied = found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = lines.withColumn("salt", F.pmod(F.xxhash64("doc_id", "row_key", "pos"), F.lit(SALTS)).cast("int"))
    return dealt.join(copied, [*KEY, "salt"]).drop("salt")


def boilerplate(docs: DataFrame, min_sites: int = 5, band: float = 0.25, lg_k: int = 12) -> DataFrame:
    """(h1, h2, first_doc) of lines that stand in min_sites sites or more.

    Estimates within `band` of the threshold are settled by exact counts; the
    sketch's error (1.6 % at lg_k 12) is far within it.
    """
    lines = _lines(docs)
    spread = lines.groupBy(*KEY).agg(F.hll_sketch_agg("site", lg_k).alias("sketch"), F.min("doc_id").alias("first_doc"))
    spread = spread.withColumn("sites", F.hll_sketch_estimate("sketch")).drop("sketch").where(F.col("sites") >= F.lit(min_sites * (1 - band))).checkpoint()
    near = spread.where(F.col("sites") <= F.lit(min_sites * (1 + band)))
    exact = salted(lines, near.select(*KEY)).select(*KEY, "site").distinct().groupBy(*KEY).count().where(F.col("count") >= min_sites)
    settled = near.join(exact, KEY, "left_semi")
    return spread.where(F.col("sites") > F.lit(min_sites * (1 + band))).unionByName(settled).select(*KEY, "first_doc")


def dedup_lines(docs: DataFrame, min_sites: int = 5, site: str = "source") -> DataFrame:
    """docs with text without boilerplate lines, and _lines (with content) and _removed.

    Lines are split at line feeds and compared without blanks at their ends;
    blank ones stay.  Null text stays null; a null site is one site.  A document
    without doc_id is never the first that has a line.  Equal rows (repeated
    ones) are treated alike, rows of one doc_id and other columns each by its own
    text.  All other columns stay, whatever their names, but _lines and _removed
    are replaced.  An empty table has no rows.
    """
    shared_dir(docs.sparkSession)
    doc, row, key, gone_at, parts = unused(docs, "doc", "row", "key", "gone", "parts")
    table = docs.withColumn(row, row_hash(docs))
    slim = table.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(row).alias("row_key"), F.coalesce(F.concat(F.lit("s"), F.col(site).cast("string")), F.lit("n")).alias("site"), F.col("text").cast("string").alias("text"))
    found = boilerplate(slim, min_sites)
    gone = salted(_lines(slim), found).where("first_doc IS NULL OR doc_id IS NULL OR doc_id <> first_doc")
    gone = gone.groupBy(F.coalesce("doc_id", F.lit(0)).alias(doc), F.col("row_key").alias(key)).agg(F.collect_set("pos").alias(gone_at))
    split = table.withColumn(parts, F.split(F.col("text").cast("string"), "\n", -1)).drop("text")
    same = (F.coalesce(split.doc_id.cast("long"), F.lit(0)) == gone[doc]) & (split[row] == gone[key])
    met = split.join(gone, same, "left")
    left = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), gone_at)
    kept = F.when(F.col(gone_at).isNull(), F.col(parts)).otherwise(F.transform(left, lambda i: F.get(parts, i)))
    met = met.withColumn("text", F.array_join(kept, "\n"))
    content = F.size(F.filter(parts, lambda x: F.btrim(x, F.lit(BLANK)) != ""))
    counts = [F.greatest(content, F.lit(0)).cast("long").alias("_lines"), F.greatest(F.size(gone_at), F.lit(0)).cast("long").alias("_removed")]
    return met.select(*[column(c) for c in docs.columns if c not in ("_lines", "_removed")], *counts)
