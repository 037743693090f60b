"""The corpus pipeline: quality rules, line dedup, near-dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of documents.  run() writes each result as Parquet to the
shared folder and reads it again for the next stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiflow.llm import lines, mixing, packing, quality, simhash
from lexiflow.llm.queries import vocabulary
from lexiflow.llm.shared import columns, new_folder


#: Eight segments of 16 bits: a pair within 23 bits meets at a key for sure.  A set
#: similarity of 0.8 differs in 19 of 128 bits with a deviation of 4; 32 is three deviations.
NEAR = {"shingle": 5, "distance": 32, "lanes": 2, "segments": 8}


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep: whole rows, repeated ones alike; null and short texts go; of no documents none."""
    return quality.keep(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without cross-site boilerplate; those that were nothing else go.

    Null and empty texts stay as they are, repeated rows are treated alike, and no
    documents give none.
    """
    found = lines.dedup_lines(docs, min_sites=5).where("_removed = 0 OR _removed < _lines")
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType))
    return found.select(*columns(docs))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near copies.

    Sets of five-word shingles; fingerprints of 128 bits within 32 bits are
    candidates, and link if the sets have a Jaccard similarity of 0.8 or more.
    Documents without doc_id stay.  Rows are told apart by doc_id and text: of two
    rows with one doc_id, the one that is a copy goes and the other stays.
    """
    groups = simhash.near_duplicates(docs, **NEAR, similarity=0.8)
    copies = simhash.small(groups.where("doc_id <> component_id").select(F.col("doc_id").alias("copy_id"), F.col("text_key").alias("copy_key")).distinct())
    same = (docs.doc_id.cast("long") == copies.copy_id) & (F.xxhash64(docs.text.cast("string")) == copies.copy_key)
    return docs.join(copies, same, "left_anti").select(*columns(docs))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; a null source is a source, null texts have no words, no documents give none."""
    return mixing.emit(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the mix in sequences of up to 2,048 tokens; null texts are empty, repeated rows are packed each, no documents give none."""
    return packing.pack(docs, vocabulary(), size=2048, end_id=1)


STAGES = [
    ("quality rules", quality_stage),
    ("line dedup", line_stage),
    ("SimHash near-dedup", near_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Sketches, fingerprints and tokens have no SQL form; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = new_folder(spark, "pipeline")
    for number, (_, stage) in enumerate(STAGES, 1):
        found = stage(spark, docs, sf_dir)
        found.write.parquet(f"{folder}/{number}")
        docs = spark.read.parquet(f"{folder}/{number}")
    return docs
