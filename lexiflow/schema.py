"""Schemas of the state tables, and strict readers for them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

TEXTS = "array<string>"

#: Columns of each table; project_id leads wherever many projects share a table.
TABLES = {
    "projects": "id string, name string, source_language string, target_language string, schema_version int",
    "source_documents": "id string, project_id string, title string, source_path string, media_type string, sha256 string, original_path string, source_format string",
    "sections": "id string, document_id string, title string, level int, ordinal int",
    "segments": f"id string, document_id string, section_id string, ordinal int, text string, kind string, raw string, source_locator string, format_signature {TEXTS}",
    "units": f"id string, section_id string, segment_ids {TEXTS}, ordinal int",
    "glossary": f"term string, preferred_translation string, allowed_variants {TEXTS}, note string, source_segment_id string, confidence double, evidence_segment_ids {TEXTS}, status string",
    "terminology_candidates": f"id string, term string, candidate_translation string, authority string, source_title string, source_url string, source_excerpt string, evidence_segment_ids {TEXTS}, confidence double, created_at string",
    "terminology_decisions": f"id string, term string, selected_candidate_id string, selected_translation string, status string, rationale string, evidence_segment_ids {TEXTS}, created_at string",
    "entities": f"id string, name string, kind string, description string, aliases {TEXTS}, evidence_segment_ids {TEXTS}, confidence double, status string",
    "translations": "id string, unit_id string, segment_id string, translated_text string, adapter string, model string, prompt_version string, created_at string, source_sha256 string, status string, revision int, supersedes string, reason string",
    "section_titles": "id string, section_id string, translated_title string, adapter string, model string, created_at string, source_sha256 string, revision int, supersedes string, reason string",
    "issues": "id string, kind string, message string, segment_id string, severity string, status string",
    "audit_resolutions": "id string, segment_id string, translation_record_id string, issue_id string, disposition string, rationale string, evidence string, reviewer string, model string, created_at string",
    "reviews": f"id string, segment_id string, input_translation_id string, output_translation_id string, adapter string, model string, created_at string, verdict string, rationale string, categories {TEXTS}, confidence double",
    "scope_reviews": f"id string, scope_type string, scope_id string, input_digest string, output_digest string, adapter string, model string, created_at string, verdict string, rationale string, categories {TEXTS}, evidence_segment_ids {TEXTS}, revised_translation_ids {TEXTS}, confidence double",
    "section_summaries": f"id string, section_id string, source_digest string, summary string, key_points {TEXTS}, evidence_segment_ids {TEXTS}, adapter string, model string, created_at string, revision int, supersedes string, confidence double",
    "ambiguities": f"id string, section_id string, category string, description string, evidence_segment_ids {TEXTS}, status string, resolution string, confidence double",
    "alignments": "source_section_id string, reference_section_id string, chapter_key string, method string, confidence double",
    "locale_adaptations": "reference_segment_id string, source_text string, adapted_text string, converter string, status string",
    "manifests": "schema_version int, project_id string, source_sha256 string, section_count int, segment_count int, unit_count int, translation_count int, steps map<string,string>",
}

#: What an absent field reads as (else null); also what migration fills in.
DEFAULTS = {
    "projects": {"schema_version": 1},
    "segments": {"kind": "paragraph", "raw": "", "source_locator": "", "format_signature": []},
    "glossary": {"allowed_variants": [], "note": "", "confidence": 1.0, "evidence_segment_ids": [], "status": "approved"},
    "translations": {"status": "completed", "revision": 1, "reason": "initial"},
    "section_titles": {"revision": 1, "reason": "initial"},
    "issues": {"severity": "warning", "status": "open"},
    "ambiguities": {"status": "open", "resolution": ""},
    "source_documents": {"source_format": "markdown"},
}

ENUMS = {
    ("translations", "status"): ["completed", "failed"],
    ("issues", "severity"): ["info", "warning", "error"],
    ("issues", "status"): ["open", "resolved"],
    ("reviews", "verdict"): ["pass", "revised"],
    ("scope_reviews", "verdict"): ["pass", "revised"],
    ("scope_reviews", "scope_type"): ["section", "book"],
    ("terminology_candidates", "authority"): ["standard", "official", "academic", "publisher", "community"],
}

CURRENT_VERSION = 2


def schema_of(table: str) -> StructType:
    return StructType.fromDDL(TABLES[table])


def empty(spark: SparkSession, table: str) -> DataFrame:
    return spark.createDataFrame([], schema_of(table))


def with_defaults(df: DataFrame, table: str) -> DataFrame:
    """All columns of the table, absent or null ones at their defaults."""
    schema, defaults = schema_of(table), DEFAULTS.get(table, {})
    out = []
    for field in schema:
        default = defaults.get(field.name)
        usual = (F.array() if default == [] else F.lit(default)).cast(field.dataType)
        out.append((F.coalesce(F.col(field.name).cast(field.dataType), usual) if field.name in df.columns else usual).alias(field.name))
    return df.select(*out)


def migrate(df: DataFrame, table: str) -> DataFrame:
    """A table of version 1 in the current form; identifiers stay."""
    df = with_defaults(df, table)
    return df.withColumn("schema_version", F.lit(CURRENT_VERSION)) if "schema_version" in df.columns else df


def enum_violations(df: DataFrame, table: str) -> DataFrame:
    bad = F.lit(False)
    for (name, column), allowed in ENUMS.items():
        if name == table:
            bad = bad | ~F.coalesce(F.col(column).isin(allowed), F.lit(False))
    return df.where(bad)
