"""Revisions, reviews, summaries and scope digests, with the offline adapters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.ids import ordered_digest, sha256, stable_id, stable_id_of_array
from . import sequences

#: Names and versions that records carry; fixed values.
PROMPT = "translate-v3-source-faithful-natural-zh"
STRUCTURAL_PROMPT = "translate-v1-structural-passthrough"
REVIEW_PROMPT = "review-v1-agent-critic-reviser"


# -- adapters: functions from columns to a column ----------------------------------------
def mock(raw: Column, text: Column) -> Column:
    return F.concat(F.lit("[MOCK] "), F.coalesce(F.nullif(raw, F.lit("")), text))


def passthrough(raw: Column, text: Column) -> Column:
    return F.coalesce(F.nullif(raw, F.lit("")), text)


def heuristic_review(source: Column, output: Column) -> Column:
    """verdict, output, confidence: one known weakening is put right, all else passes."""
    wrong = F.contains(F.lower(source), F.lit("disempowered")) & F.contains(output, F.lit("失去了力量"))
    fixed = F.replace(output, F.lit("失去了力量"), F.lit("权力受到削弱"))
    return F.struct(F.when(wrong, F.lit("revised")).otherwise(F.lit("pass")).alias("verdict"), F.when(wrong, fixed).otherwise(output).alias("output"), F.when(wrong, F.lit(0.98)).otherwise(F.lit(0.6)).alias("confidence"))


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


# -- records -----------------------------------------------------------------------------
def next_revisions(drafts: DataFrame, log: DataFrame, adapter: str, model: str, reason: str, now: Column | None = None, prompt: str = PROMPT) -> DataFrame:
    """Translation records from drafts (segment_id, unit_id, source_text, translated_text): revision + 1, superseding the current."""
    last = sequences.current_translations(log).select("segment_id", F.col("id").alias("_id"), F.col("revision").alias("_rev"))
    met = drafts.join(last, "segment_id", "left").withColumn("revision", F.coalesce(F.col("_rev"), F.lit(0)) + 1)
    stamp = F.date_format(F.current_timestamp() if now is None else now, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx")
    return met.select(
        stable_id("tr", F.col("unit_id"), F.col("segment_id"), F.lit(adapter), F.lit(model), F.col("revision")).alias("id"),
        "unit_id", "segment_id", "translated_text", F.lit(adapter).alias("adapter"), F.lit(model).alias("model"), F.lit(prompt).alias("prompt_version"),
        stamp.alias("created_at"), sha256(F.col("source_text")).alias("source_sha256"), F.lit("completed").alias("status"), "revision", F.col("_id").alias("supersedes"), F.lit(reason).alias("reason"),
    )


def translate(units: DataFrame, segments: DataFrame, log: DataFrame, adapter: Callable[[Column, Column], Column] = mock, name: str = "mock", model: str = "mock-v1", again: bool = False, reason: str = "initial", most_units: int | None = None, now: Column | None = None) -> DataFrame:
    """Records for segments without a current translation (all, if again); images alone pass through."""
    members = units.select(F.col("id").alias("unit_id"), F.col("ordinal").alias("_unit"), F.explode("segment_ids").alias("segment_id"))
    rows = segments.select(F.col("id").alias("segment_id"), F.col("text").alias("source_text"), "raw").join(members, "segment_id")
    open_ = rows if again else rows.join(sequences.current_translations(log).select("segment_id"), "segment_id", "left_anti")
    if most_units is not None:
        first = open_.select("_unit").distinct().orderBy("_unit").limit(most_units)
        open_ = open_.join(first, "_unit", "left_semi")
    structural = T.is_structural(F.col("raw"))
    done = open_.withColumn("translated_text", F.when(structural, F.col("raw")).otherwise(adapter(F.col("raw"), F.col("source_text"))))
    if (empty := done.where("trim(translated_text) = ''").take(1)) != []:
        raise ValueError(f"empty translation of {empty[0]['segment_id']}")
    kept = next_revisions(done.where(structural), log, "structural-passthrough", "none", reason, now, STRUCTURAL_PROMPT)
    return kept.unionByName(next_revisions(done.where(~structural), log, name, model, reason, now))


def reviewed_ids(reviews: DataFrame, scope_reviews: DataFrame | None = None) -> DataFrame:
    """record_id of what reviews took in or gave out (and scope reviews revised)."""
    ids = reviews.select(F.explode(F.array("input_translation_id", "output_translation_id")).alias("record_id"))
    if scope_reviews is not None:
        ids = ids.union(scope_reviews.select(F.explode("revised_translation_ids")))
    return ids.distinct()


def review(segments: DataFrame, log: DataFrame, reviews: DataFrame, name: str = "heuristic", model: str = "rules-v1", now: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(new reviews, new translation records) for current records that no review has seen."""
    active = sequences.current_translations(log)
    todo = active.join(reviewed_ids(reviews).withColumnRenamed("record_id", "id"), "id", "left_anti").join(segments.select(F.col("id").alias("segment_id"), F.col("text").alias("source_text"), "raw"), "segment_id")
    judged = todo.withColumn("_r", F.when(T.is_structural(F.col("raw")), F.struct(F.lit("pass").alias("verdict"), F.col("translated_text").alias("output"), F.lit(1.0).alias("confidence"))).otherwise(heuristic_review(F.col("source_text"), F.col("translated_text"))))
    revised = judged.where("_r.verdict = 'revised' AND trim(_r.output) <> '' AND _r.output <> translated_text")
    new = next_revisions(revised.select("segment_id", "unit_id", "source_text", F.col("_r.output").alias("translated_text")), log, name, model, "review", now, REVIEW_PROMPT)
    met = judged.join(new.select("segment_id", F.col("id").alias("_new")), "segment_id", "left")
    stamp = F.date_format(F.current_timestamp() if now is None else now, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx")
    records = met.select(
        stable_id("review", F.col("segment_id"), F.col("id"), F.lit(name), F.lit(model)).alias("id"), "segment_id", F.col("id").alias("input_translation_id"),
        F.coalesce("_new", "id").alias("output_translation_id"), F.lit(name).alias("adapter"), F.lit(model).alias("model"), stamp.alias("created_at"),
        F.when(F.col("_new").isNotNull(), F.lit("revised")).otherwise(F.lit("pass")).alias("verdict"), F.lit("").alias("rationale"), F.array().cast("array<string>").alias("categories"), clamp(F.col("_r.confidence")).alias("confidence"),
    )
    return records, new


# -- scopes ------------------------------------------------------------------------------
def scope_digests(segments: DataFrame, active: DataFrame, scope: str, context: DataFrame | None = None) -> DataFrame:
    """scope and digest of its current records in order; scopes that lack a translation have none.

    context: scope and context (JSON with sorted keys), which enters the digest.
    """
    met = segments.join(active.select("segment_id", F.col("id").alias("record_id")), "segment_id", "left")
    rows = met.groupBy(scope).agg(F.array_sort(F.collect_list(F.struct("ordinal", "record_id"))).alias("_r"), F.bool_and(F.col("record_id").isNotNull()).alias("_full"))
    rows = rows.where("_full").withColumn("_ids", F.transform("_r", lambda r: r["record_id"].cast("string")))
    if context is None:
        return rows.select(scope, ordered_digest(F.col("_ids")).alias("digest"))
    return rows.join(context, scope, "left").select(scope, ordered_digest(F.col("_ids"), F.coalesce("context", F.lit("{}"))).alias("digest"))


def stale_scopes(digests: DataFrame, scope_reviews: DataFrame, scope: str) -> DataFrame:
    """Scopes whose digest no review of them has as input or output."""
    seen = scope_reviews.select(F.col("scope_id").alias(scope), F.explode(F.array("input_digest", "output_digest")).alias("digest")).distinct()
    return digests.join(seen, [scope, "digest"], "left_anti")


def inconsistent_outputs(rows: DataFrame, scope: str) -> DataFrame:
    """scope and the sources (any case) in it with several outputs: what the offline coherence review reports."""
    return rows.groupBy(scope, F.lower("text").alias("source")).agg(F.count_distinct(F.lower("output")).alias("outputs")).where("outputs > 1")


def one_rendering(rows: DataFrame) -> DataFrame:
    """A scope review that gives repeated sources (any case) of a scope the output of the first of them: (scope_id, segment_id, output)."""
    first = rows.groupBy("scope_id", F.lower("text").alias("_source")).agg(F.min_by("output", "ordinal").alias("_first"), F.count_distinct(F.lower("output")).alias("_n")).where("_n > 1")
    met = rows.withColumn("_source", F.lower("text")).join(first, ["scope_id", "_source"])
    return met.where("output <> _first").select("scope_id", "segment_id", F.col("_first").alias("output"))


def summarize(segments: DataFrame, section: str = "section_id", position: str = "in_section") -> DataFrame:
    """section, summary (1,200 characters), key_points (240) and evidence of the first, middle and last segment."""
    chosen = sequences.first_middle_last(segments, section, position)
    rows = chosen.groupBy(section).agg(F.array_sort(F.collect_list(F.struct(position, "segment_id", "text"))).alias("_r"))
    joined = F.array_join(F.transform("_r", lambda r: r["text"]), " ")
    points = F.transform("_r", lambda r: T.truncate(r["text"], 240))
    return rows.select(section, T.truncate(joined, 1200).alias("summary"), points.alias("key_points"), F.transform("_r", lambda r: r["segment_id"]).alias("evidence_segment_ids"))


def ambiguities(segments: DataFrame, section: str = "section_id") -> DataFrame:
    """A record for each segment that marks its text as unclear."""
    unclear = segments.where(F.contains(F.lower("text"), F.lit("[?]")) | F.contains(F.lower("text"), F.lit("[unclear]")))
    ids = F.array(F.col("segment_id").cast("string"))
    category, description = F.lit("source_uncertainty"), F.lit("Source marks this passage as unclear")
    return unclear.select(stable_id_of_array("ambiguity", F.col(section), F.concat(F.array(category, description), ids)).alias("id"), F.col(section), category.alias("category"), description.alias("description"), ids.alias("evidence_segment_ids"), F.lit("open").alias("status"), F.lit("").alias("resolution"), F.lit(0.95).alias("confidence"))


def attribution(active: DataFrame) -> DataFrame:
    """One row: the distinct adapters and models of current records, structural ones aside."""
    real = active.where("adapter <> 'structural-passthrough'").select("adapter", "model").distinct()
    names = F.array_join(F.array_sort(F.collect_set(F.concat_ws(" / ", "adapter", "model"))), "; ")
    mocked = F.coalesce(F.bool_or(F.col("adapter") == "mock"), F.lit(False))
    return real.agg(F.when(mocked, F.concat(F.lit("Mock output, not a final translation: "), names)).otherwise(names).alias("translator"))
