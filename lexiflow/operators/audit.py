"""The release audit: a row a check, in a fixed order, and whether all pass."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ids import sha256
from . import review, rules, selection, sequences

#: Checks in order; fixed values.
CHECKS = """project source_retention import_loss_report stable_structure section_title_coverage section_title_revision_integrity
translation_strategy section_summaries ambiguity_evidence knowledge_evidence translation_coverage non_mock_translation revision_integrity
segment_review_coverage section_review_coverage book_review deterministic_validation complete_exports epub_readback
epub_resource_integrity provenance""".split()
NEED_REPORT = ("epub", "docx", "jats")


def audit(t: dict[str, DataFrame], project: dict, source: dict, brief: dict, artifacts: dict[str, dict], provenance: dict, expected_images: int = 0, allow_mock: bool = False) -> list[dict]:
    """Checks of one project's tables t.

    project and source: their records ({} if absent); source also retained and
    reported; artifacts: name to size and, of archives, integrity counts.
    """
    out: list[dict] = []

    def check(name: str, passed: bool, **evidence) -> None:
        out.append({"id": name, "status": "pass" if passed else "fail", "required": True, "evidence": json.dumps(evidence, ensure_ascii=False, sort_keys=True)})

    check("project", bool(project and source))
    if not (project and source):
        return out
    check("source_retention", bool(source.get("retained")))
    check("import_loss_report", bool(source.get("reported")) or source.get("source_format") not in NEED_REPORT)

    sections, segments, units, log, titles = (t[k] for k in ("sections", "segments", "units", "translations", "section_titles"))
    members = units.select(F.explode("segment_ids").alias("id"))
    counts = {k: t[k].count() for k in ("sections", "segments", "units")}
    whole = all(counts.values()) and sections.select("id").distinct().count() == counts["sections"] and segments.select("id").distinct().count() == counts["segments"]
    whole = whole and members.count() == counts["segments"] and selection.same_sets(members, segments, "id")
    check("stable_structure", whole and segments.join(sections.select(F.col("id").alias("section_id")), "section_id", "left_anti").isEmpty(), **counts)

    current_titles = sequences.current(titles, "section_id")
    check("section_title_coverage", selection.same_sets(current_titles, sections.select(F.col("id").alias("section_id")), "section_id"), records=titles.count())
    named = titles.join(sections.select(F.col("id").alias("section_id"), "title"), "section_id").where(F.col("source_sha256") != sha256(F.col("title")))
    chain = rules.chain_violations(titles, "section_id", sections.select(F.col("id").alias("section_id")))
    check("section_title_revision_integrity", named.isEmpty() and chain.isEmpty())

    known = {r["id"] for r in segments.select("id").collect()} if brief.get("concept_rules") else set()
    evidence_ok = all(r.get("evidence_segment_ids") and set(r["evidence_segment_ids"]) <= known for r in brief.get("concept_rules", []))
    check("translation_strategy", bool(brief.get("principles") and brief.get("target_style") and brief.get("generated_by") and evidence_ok))
    filled = segments.select("section_id").distinct()
    check("section_summaries", filled.join(sequences.current(t["section_summaries"], "section_id").select("section_id"), "section_id", "left_anti").isEmpty())

    def evidenced(rows: DataFrame, key: str) -> bool:
        without = rows.where("evidence_segment_ids IS NULL OR size(evidence_segment_ids) = 0")
        return without.isEmpty() and selection.evidence_violations(rows, key, "evidence_segment_ids", segments, "id").isEmpty()

    ambiguities = t["ambiguities"]
    check("ambiguity_evidence", evidenced(ambiguities, "id") and ambiguities.join(sections.select(F.col("id").alias("section_id")), "section_id", "left_anti").isEmpty())
    unnamed = t["glossary"].where("status = 'approved' AND coalesce(preferred_translation, '') = ''")
    check("knowledge_evidence", evidenced(t["entities"], "id") and evidenced(t["glossary"], "term") and unnamed.isEmpty())

    active = sequences.current_translations(log).cache()
    wanted = segments.select(F.col("id").alias("segment_id"))
    covered = wanted.join(active, "segment_id", "left_semi").count()
    complete = covered == counts["segments"] and counts["segments"] > 0
    check("translation_coverage", covered == counts["segments"], translated=covered, required=counts["segments"], coverage=round(covered / counts["segments"], 6) if counts["segments"] else 0.0)
    mocks = active.where("adapter = 'mock' OR startswith(translated_text, '[MOCK] ')").count()
    real = not active.isEmpty() and mocks == 0 and current_titles.where("adapter = 'mock'").isEmpty()
    check("non_mock_translation", real or allow_mock, allow_mock=allow_mock, mock_active=mocks)
    check("revision_integrity", rules.chain_violations(log, "segment_id", wanted).isEmpty())

    seen = review.reviewed_ids(t["reviews"], t["scope_reviews"]).withColumnRenamed("record_id", "id")
    check("segment_review_coverage", selection.same_sets(active.join(seen, "id", "left_semi"), wanted, "segment_id"))
    rows = segments.select(F.col("id").alias("segment_id"), "section_id", "ordinal")
    digests = review.scope_digests(rows, active.select("segment_id", "id"), "section_id")
    stale = review.stale_scopes(digests, t["scope_reviews"].where("scope_type = 'section'"), "section_id").count()
    check("section_review_coverage", stale == 0 and digests.count() == filled.count(), stale=stale)
    book = review.scope_digests(rows.withColumn("book", F.lit(project["id"])), active.select("segment_id", "id"), "book")
    check("book_review", not book.isEmpty() and review.stale_scopes(book, t["scope_reviews"].where("scope_type = 'book'"), "book").isEmpty())

    errors = None
    if complete:
        pairs = segments.select(F.col("id").alias("segment_id"), "text", "raw", "kind")
        errors = rules.validate(pairs, active, t["glossary"], "strict", t["audit_resolutions"]).where("severity = 'error'").count()
    check("deterministic_validation", errors == 0, blocking_errors=errors)
    active.unpersist()

    names = ("translated.md", "bilingual.md", "translated.epub", "bilingual.epub")
    there = all(artifacts.get(n, {}).get("size", 0) > 0 for n in names)
    archives = [artifacts.get(n, {}) for n in names[2:]]
    check("complete_exports", there)
    check("epub_readback", there and all(a.get("readable") for a in archives))
    check("epub_resource_integrity", there and all(a.get("broken_local_references") == 0 and a.get("image_references", 0) >= expected_images for a in archives))
    check("provenance", bool(provenance.get("source_title") and provenance.get("translator") and provenance.get("fidelity_note")))
    return out


def ready(checks: list[dict]) -> bool:
    return len(checks) == len(CHECKS) and all(c["status"] == "pass" for c in checks)
