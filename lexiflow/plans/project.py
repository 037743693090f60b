"""A project: state tables of one book, and the steps that work on them.

State is in a Store under a root that projects share: logs are appended to,
derived tables are overwritten, and a step that changes several tables and
documents does so in one transaction.
"""

from __future__ import annotations

import json
import re
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.ids import sha256, stable_id, stable_id_of_array
from ..operators import alignment, audit, knowledge, render, review, rules, segment, selection, sequences
from ..schema import CURRENT_VERSION, TABLES, with_defaults
from ..sources import documents, drafts, epub, jsonl, office
from .store import Store

APPENDED = ("translations", "section_titles", "reviews", "scope_reviews", "section_summaries", "ambiguities", "audit_resolutions", "terminology_candidates", "terminology_decisions")
DERIVED_FROM_SOURCE = [t for t in TABLES if t not in ("projects", "manifests", "source_documents")]


def now() -> str:
    return datetime.now(timezone.utc).isoformat()


class Project:
    """Steps named as the commands of the command line."""

    def __init__(self, spark: SparkSession, root: str, project_id: str):
        self.spark, self.s, self.id = spark, Store(spark, root, project_id), project_id

    # -- set-up ---------------------------------------------------------------------------
    @classmethod
    def init(cls, spark: SparkSession, root: str, name: str, source_language: str, target_language: str) -> Project:
        parts = [name, source_language, target_language]
        project_id = spark.range(1).select(stable_id("prj", *parts)).first()[0]
        p = cls(spark, root, project_id)
        if p.s.get_json("project.json"):
            raise FileExistsError(f"project {name} exists")
        with p.s.transaction():
            p.s.put_json("project.json", {"id": project_id, "name": name, "source_language": source_language, "target_language": target_language, "schema_version": CURRENT_VERSION})
            p.step("init", "completed")
        return p

    @property
    def record(self) -> dict:
        return self.s.get_json("project.json")

    @property
    def source(self) -> dict:
        return self.s.get_json("source_document.json")

    def step(self, name: str, status: str) -> None:
        manifest = self.s.get_json("manifest.json")
        manifest.setdefault("steps", {})[name] = status
        self.s.put_json("manifest.json", {"schema_version": CURRENT_VERSION, "project_id": self.id} | manifest)

    def tables(self) -> dict[str, DataFrame]:
        return {t: self.s.read(t) for t in TABLES}

    # -- sources ---------------------------------------------------------------------------
    def import_source(self, path: str, _edition: str = "source") -> dict:
        row = documents.read_sources(self.spark, path).first()
        if row["error"]:
            raise ValueError(row["error"])
        old = self.source
        if old and old["sha256"] != row["sha256"]:
            raise ValueError("another source is there; use replace")
        with self.s.transaction():
            return self._retain(row, path)

    def _retain(self, row, path: str) -> dict:
        """The original, its text and the records of them; files go to a folder of their own first."""
        doc_id = self.spark.range(1).select(stable_id("doc", self.id, row["sha256"])).first()[0]
        folder = self.s.path("source", self.id, f"{row['sha256'][:16]}-{uuid.uuid4().hex[:8]}")
        original, text = f"{folder}/original.{path.rsplit('.', 1)[-1].lower()}", f"{folder}/document.md"
        self.s.put(original, self.s.get(path))
        self.s.put(text, row["markdown"].encode())
        record = {"id": doc_id, "project_id": self.id, "title": row["title"], "source_path": text, "original_path": original, "sha256": row["sha256"], "source_format": row["source_format"]}
        self.s.put_json("source_document.json", record)
        self.s.put_json("import_report.json", json.loads(row["report"]))
        self.step("import", "completed")
        return record

    def replace_source(self, path: str) -> dict:
        """The new source in place of the old and of all that was made from it, at once or not at all."""
        row = documents.read_sources(self.spark, path).first()
        if row["error"]:
            raise ValueError(row["error"])
        with self.s.transaction():
            for table in DERIVED_FROM_SOURCE:
                self.s.drop(table)
            for name in ("source_document.json", "translation_brief.json", "agent_campaign.json", "import_report.json"):
                self.s.drop_json(name)
            return self._retain(row, path)

    def segment(self, unit_size: int = 3) -> tuple[int, int, int]:
        if not self.source:
            raise ValueError("no source has been imported")
        text = self.s.get(self.source["source_path"]).decode()
        docs = self.spark.createDataFrame([(self.source["id"], self.source["title"], text)], "document_id string, title string, markdown string")
        with self.s.transaction():
            counts = tuple(self.s.overwrite(t, df).count() for t, df in zip(("sections", "segments", "units"), segment.segment_documents(docs, unit_size)))
            self.step("segment", "completed")
        return counts

    def import_reference(self, path: str, language: str, credit: str) -> tuple[int, int, int]:
        row = documents.read_sources(self.spark, path).first()
        if row["error"]:
            raise ValueError(row["error"])
        docs = self.spark.createDataFrame([("ref_" + row["sha256"][:16], row["title"], row["markdown"])], "document_id string, title string, markdown string")
        sections, segments, _ = segment.segment_documents(docs)
        for name, df in (("sections", sections), ("segments", segments)):
            df.write.mode("overwrite").parquet(self.s.path("reference", self.id, name))
        self.s.put_json("reference.json", {"language": language, "credit": credit, "title": row["title"]})
        aligned = self.align_reference()
        return self.reference("sections").count(), self.reference("segments").count(), aligned

    def reference(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.s.path("reference", self.id, name))

    def _chapters(self, sections: DataFrame) -> DataFrame:
        return sections.select(F.lit(self.id).alias("book"), F.col("id").alias("section_id"), "ordinal", T.chapter_key(F.col("title")).alias("chapter_key"))

    def align_reference(self) -> int:
        found = alignment.align(self._chapters(self.s.read("sections")), self._chapters(self.reference("sections")))
        return self.s.overwrite("alignments", found).count()

    def reference_context(self) -> DataFrame:
        """unit_id and reference_texts by the proportional window of its first segment."""
        adapted = self.s.read("locale_adaptations")
        sections = self._chapters(self.reference("sections"))
        aligned = self.s.read("alignments").join(sections.select(F.col("section_id").alias("reference_section_id"), "book", F.col("ordinal").alias("reference_ordinal")), "reference_section_id")
        covered = alignment.ranges(aligned, sections).select(F.col("source_section_id").alias("section_id"), "reference_section_id")
        rows = self.reference("segments").select(F.col("id").alias("segment_id"), F.col("section_id").alias("reference_section_id"), F.col("ordinal").alias("_o"), "raw", "text").join(covered, "reference_section_id")
        rows = rows.withColumn("pos", (F.row_number().over(Window.partitionBy("section_id").orderBy("_o")) - 1).cast("long")).withColumn("n", F.count("*").over(Window.partitionBy("section_id")))
        rows = alignment.reference_text(rows, adapted).select("section_id", "pos", "n", "reference_text")
        source = self.s.read("segments").withColumn("pos", (F.row_number().over(Window.partitionBy("section_id").orderBy("ordinal")) - 1).cast("long")).withColumn("n", F.count("*").over(Window.partitionBy("section_id")))
        first = self.s.read("units").select(F.col("id").alias("unit_id"), F.col("segment_ids")[0].alias("id")).join(source, "id").select("unit_id", "section_id", "pos", "n")
        met = alignment.proportional_window(first, rows, "section_id").join(first.select("unit_id", "section_id", F.col("pos").alias("source_pos")), ["section_id", "source_pos"])
        return met.groupBy("unit_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "reference_text"))), lambda x: x["reference_text"]).alias("reference_texts"))

    def simplify_reference(self, dictionary: DataFrame) -> int:
        """Adapt the reference by a phrase table (phrase, adapted)."""
        rows = self.reference("segments").withColumn("_raw", F.coalesce(F.nullif("raw", F.lit("")), "text"))
        found = alignment.convert(rows, dictionary, "_raw").select(F.col("id").alias("reference_segment_id"), F.col("_raw").alias("source_text"), "adapted_text", F.lit("phrase-table").alias("converter"), F.lit("completed").alias("status"))
        return self.s.overwrite("locale_adaptations", found).count()

    # -- analysis ----------------------------------------------------------------------------
    def _segments(self) -> DataFrame:
        rows = self.s.read("segments").drop("_pos").withColumn("segment_id", F.col("id"))
        return rows.withColumn("in_section", F.row_number().over(Window.partitionBy("section_id").orderBy("ordinal")) - 1)

    def analyze(self, refresh: bool = False) -> dict:
        """The offline profile; one that is there stays unless refreshed."""
        old = self.s.get_json("translation_brief.json")
        if old and not refresh:
            return old
        rows = self._segments().withColumn("book", F.lit(self.id))
        sample = sequences.first_middle_last(rows, "section_id", "in_section").orderBy("ordinal").limit(48).withColumn("text", F.substring("text", 1, 1600))
        domains = [r["domain"] for r in knowledge.top_domains(sample, "book").orderBy("rank").collect()]
        concepts = [r.asDict() for r in knowledge.concept_rules(rows, "book").drop("book").orderBy("source_term").collect()]
        academic, n = self.source.get("source_format") == "jats", rows.count()
        genre = "scholarly research article" if academic else "long-form nonfiction" if n >= 20 else "short-form nonfiction"
        brief = {
            "genre": genre, "domains": domains or (["academic research"] if academic else ["general nonfiction"]),
            "target_style": "idiomatic target-language prose with semantic fidelity", "audience": "research readers" if academic else "educated general readers",
            "principles": ["The source text is the sole semantic authority.", "Keep facts, qualifications, argument relations and tone.", "Record uncertainty instead of adding explanations."],
            "concept_rules": concepts, "confidence": 0.65 if concepts else 0.5, "generated_by": {"adapter": "heuristic", "model": "domain-signals-v1"}, "generated_at": now(),
        }
        self.s.put_json("translation_brief.json", brief)
        self.note("brief", "Translation brief", [f"{k}: {', '.join(v) if isinstance(v, list) else v}" for k, v in brief.items() if k not in ("concept_rules", "generated_by")] + [f"{r['source_term']}: {r['preferred_rendering']}" for r in concepts])
        self.step("analyze", "completed")
        return brief

    def summarize(self, refresh: bool = False) -> int:
        """Summaries of sections whose segments or brief changed since their current one."""
        rows = self._segments()
        brief = json.dumps(self.s.get_json("translation_brief.json"), ensure_ascii=False, sort_keys=True)
        ids = rows.groupBy("section_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "id"))), lambda x: x["id"]).alias("_ids"))
        digest = sha256(F.concat(F.array_join("_ids", "\x1f"), F.lit("\x1e"), F.lit(brief)))
        last = sequences.current(self.s.read("section_summaries"), "section_id").select("section_id", F.col("id").alias("supersedes"), F.col("revision").alias("_rev"), F.col("source_digest").alias("_old"))
        met = review.summarize(rows).join(ids, "section_id").withColumn("source_digest", digest).join(last, "section_id", "left")
        todo = met if refresh else met.where("_old IS NULL OR _old <> source_digest")
        revision = F.coalesce("_rev", F.lit(0)) + 1
        new = todo.withColumn("adapter", F.lit("heuristic")).withColumn("model", F.lit("extract-v1")).withColumn("revision", revision).withColumn("created_at", F.lit(now())).withColumn("confidence", F.lit(0.6))
        new = new.withColumn("id", stable_id("summary", F.col("section_id"), F.col("source_digest"), F.col("adapter"), F.col("model"), F.col("revision")))
        n = self.s.append("section_summaries", new)
        told = sequences.current(self.s.read("section_summaries"), "section_id").orderBy("section_id")
        self.note("summaries", "Section summaries", [f"{r['section_id']}: {r['summary']}" for r in told.select("section_id", "summary").toLocalIterator()])
        self.s.append("ambiguities", selection.append_new(self.s.read("ambiguities"), review.ambiguities(rows)))
        self.step("summarize", "completed")
        return n

    def note(self, name: str, title: str, lines: list[str]) -> None:
        """A mirror of a result for readers."""
        self.s.put(self.s.path("notes", self.id, f"{name}.md"), "\n".join([f"# {title}", "", *(f"- {x}" for x in lines), ""]).encode())

    def propose_knowledge(self, least: int = 2) -> tuple[int, int]:
        glossary, entities = knowledge.propose(self._segments(), self.s.read("glossary").drop("_pos"), self.s.read("entities").drop("_pos"), least)
        with self.s.transaction():
            return self.s.overwrite("glossary", glossary).count(), self.s.overwrite("entities", entities).count()

    def import_glossary(self, path: str) -> int:
        return self.s.overwrite("glossary", drafts.read_glossary(self.spark, path)).count()

    def import_terminology(self, path: str) -> tuple[int, int]:
        fields = {f: "array<string>" if f == "evidence_segment_ids" else "double" if f == "confidence" else "string" for f in drafts.CANDIDATE_FIELDS}
        rows = drafts.parse(self.spark.read.text(path), fields)
        self._refuse(drafts.candidate_violations(rows, self.s.read("segments")))
        found = drafts.candidate_ids(rows).withColumn("created_at", F.lit(now()))
        written = self.s.append("terminology_candidates", selection.append_new(self.s.read("terminology_candidates"), found))
        return written, rows.count() - written

    def adjudicate_terminology(self, approve_authoritative: bool = False) -> int:
        found = self.s.read("terminology_candidates")
        decided = knowledge.adjudicate(found, approve_authoritative)
        evidence = found.select(F.col("id").alias("selected_candidate_id"), "evidence_segment_ids", "confidence")
        rows = decided.join(evidence, "selected_candidate_id").withColumn("created_at", F.lit(now())).withColumn("rationale", F.lit("highest authority, then confidence")).cache()
        terms = rows.select("term", F.col("selected_translation").alias("preferred_translation"), "confidence", "evidence_segment_ids", "status")
        with self.s.transaction():
            n = self.s.append("terminology_decisions", selection.append_new(self.s.read("terminology_decisions"), rows))
            self.s.overwrite("glossary", selection.merge_without_overwrite(self.s.read("glossary").drop("_pos"), with_defaults(terms, "glossary"), "term"))
        rows.unpersist()
        return n

    def terminology_plan(self, output: str) -> int:
        brief = self.s.get_json("translation_brief.json")
        concepts = [(r["source_term"], r["evidence_segment_ids"]) for r in brief.get("concept_rules", [])]
        asked = self.spark.createDataFrame(concepts, "term string, evidence_segment_ids array<string>")
        plan = knowledge.research_plan(self._segments(), self.s.read("glossary"), asked).orderBy(F.lower("term"))
        plan = plan.withColumn("source_language", F.lit(self.record["source_language"])).withColumn("target_language", F.lit(self.record["target_language"])).withColumn("required_fields", F.array(*map(F.lit, drafts.CANDIDATE_FIELDS)))
        jsonl.write_jsonl(plan, output)
        return plan.count()

    def terminology_impact(self, term: str) -> DataFrame:
        return knowledge.impact(self._segments(), term)

    # -- translation ---------------------------------------------------------------------------
    def translate(self, segment_ids=(), section_ids=(), term: str = "", reason: str = "initial", most_units: int | None = None, adapter=review.mock, name: str = "mock", model: str = "mock-v1") -> int:
        asked = selection.select_segments(self.s.read("segments").drop("_pos"), segment_ids, section_ids, term)
        again = bool(segment_ids or section_ids or term)
        with self.s.lease("translate"):
            new = review.translate(self.s.read("units"), asked, self.s.read("translations"), adapter, name, model, again, reason, most_units)
            n = self.s.append("translations", new)
        self.step("translate", "completed" if self.complete() else "in_progress")
        return n

    def translate_titles(self, refresh: bool = False, adapter=review.mock, name: str = "mock", model: str = "mock-v1", reason: str = "initial") -> int:
        sections = self.s.read("sections").select(F.col("id").alias("section_id"), "title", adapter(F.lit(""), F.col("title")).alias("translated_title"))
        return self._append_titles(sections, name, model, reason, refresh)

    def _append_titles(self, rows: DataFrame, name: str, model: str, reason: str, again: bool = True) -> int:
        last = sequences.current(self.s.read("section_titles"), "section_id").select("section_id", F.col("id").alias("supersedes"), F.col("revision").alias("_rev"), F.col("translated_title").alias("_old"))
        met = rows.join(last, "section_id", "left").where("_old IS NULL OR (%s AND _old <> translated_title)" % str(bool(again)).lower())
        met = met.withColumn("revision", F.coalesce("_rev", F.lit(0)) + 1).withColumn("adapter", F.lit(name)).withColumn("model", F.lit(model)).withColumn("reason", F.lit(reason)).withColumn("created_at", F.lit(now())).withColumn("source_sha256", sha256(F.col("title")))
        return self.s.append("section_titles", met.withColumn("id", stable_id("section_title_tr", F.col("section_id"), F.col("adapter"), F.col("model"), F.col("revision"))))

    def _refuse(self, bad: DataFrame) -> None:
        if rows := bad.limit(20).collect():
            raise ValueError("; ".join(f"{r['key']}: {r['reason']}" for r in rows))

    def import_draft(self, path: str, adapter: str, model: str, reason: str = "draft") -> int:
        rows = drafts.parse(self.spark.read.text(path), {"segment_id": "string", "translated_text": "string"})
        segments = self.s.read("segments")
        self._refuse(drafts.draft_violations(rows, "segment_id", "translated_text", segments))
        members = self.s.read("units").select(F.col("id").alias("unit_id"), F.explode("segment_ids").alias("segment_id"))
        full = rows.drop("_bad").join(members, "segment_id").join(segments.select(F.col("id").alias("segment_id"), F.col("text").alias("source_text")), "segment_id")
        n = self.s.append("translations", review.next_revisions(full, self.s.read("translations"), adapter, model, reason))
        self.step("translate", "completed" if self.complete() else "in_progress")
        return n

    def import_title_draft(self, path: str, adapter: str, model: str, reason: str = "draft") -> int:
        rows = drafts.parse(self.spark.read.text(path), {"section_id": "string", "translated_title": "string"})
        sections = self.s.read("sections")
        self._refuse(drafts.draft_violations(rows, "section_id", "translated_title", sections, one_line=True))
        return self._append_titles(rows.drop("_bad").join(sections.select(F.col("id").alias("section_id"), "title"), "section_id"), adapter, model, reason)

    def complete(self) -> bool:
        active = sequences.current_translations(self.s.read("translations")).select(F.col("segment_id").alias("id"))
        segments = self.s.read("segments")
        return not segments.isEmpty() and segments.join(active, "id", "left_anti").isEmpty()

    # -- work packages ----------------------------------------------------------------------------
    def _pending(self) -> DataFrame:
        active = sequences.current_translations(self.s.read("translations")).select("segment_id")
        members = self.s.read("units").select(F.col("id").alias("unit_id"), F.col("ordinal").alias("unit_ordinal"), F.explode("segment_ids").alias("segment_id"))
        open_ = self._segments().join(members, "segment_id").join(active, "segment_id", "left_anti")
        return open_.groupBy(F.lit(self.id).alias("book"), "unit_id", "section_id", "unit_ordinal").agg(F.sum(F.length("text")).alias("source_chars"), F.sum(F.length("raw") + F.length("text") + 200).alias("input_chars"), F.count("*").alias("segments"), F.sort_array(F.collect_list("segment_id")).alias("segment_ids"))

    def batch(self, output: str, most_units: int | None = None, section_ids=(), source_chars: int | None = None, window: int = sequences.WINDOW_TOKENS) -> int:
        """The next work package: pending units (of the sections, if any are named) within the envelope, each with its context.

        source_chars: the budget of source text, else a part of the window (tokens).
        A cap on units alone crosses sections and has no other limit.
        """
        if min(x for x in (most_units, source_chars, window, 1) if x is not None) < 1:
            raise ValueError("limits must be at least 1")
        selection.require_known(self.s.read("sections"), "id", list(section_ids), "section")
        pending = self._pending()
        if section_ids:
            pending = pending.where(F.col("section_id").isin(list(section_ids)))
        limits = {"chars": source_chars or sequences.source_budget(window), "tokens": sequences.usable_tokens(window)}
        if most_units:
            limits = {"most_units": most_units, "chars": source_chars or 1 << 60, "tokens": 1 << 60}
        chosen = sequences.batch_prefix(pending, "book", "unit_ordinal", "section_id", "source_chars", "input_chars", one_section=not most_units, **limits)
        packets = segment.context_packets(self.s.read("units").drop("_pos"), self.s.read("segments").drop("_pos"), sequences.current(self.s.read("section_summaries"), "section_id"))
        rows = chosen.select("unit_id", "unit_ordinal", F.col("segment_ids").alias("pending_segment_ids")).join(packets, "unit_id").orderBy("unit_ordinal")
        jsonl.write_jsonl(rows, output)
        return rows.count()

    def campaign(self, most_segments: int | None = None, most_units: int = 60, chars: int | None = None, refresh: bool = False) -> list[dict]:
        """Checkpoints of the work ahead, kept; their progress is computed anew each time."""
        plan = self.s.get_json("agent_campaign.json")
        if not plan or refresh:
            pending = self._pending()
            if most_segments:
                pending = sequences.campaign_candidates(pending, "book", "unit_ordinal", "segments", most_segments)
            packed = sequences.checkpoints(pending, "section_id", "unit_ordinal", "unit_id", "source_chars", "input_chars", most_units, chars)
            plan = {"checkpoints": [r.asDict() for r in packed.orderBy("section_id", "checkpoint").collect()], "generated_at": now()}
            self.s.put_json("agent_campaign.json", plan)
        open_ = {r["unit_id"] for r in self._pending().select("unit_id").collect()}
        for c in plan["checkpoints"]:
            left = sum(u in open_ for u in c["unit_ids"])
            c["status"] = "completed" if not left else "pending" if left == len(c["unit_ids"]) else "in_progress"
        return plan["checkpoints"]

    def repair_batch(self, output: str, most_segments: int | None = None) -> int:
        """Segments with strict errors, with what is wrong; issues without a segment come last."""
        bad = self._issues("strict").where("severity = 'error' AND status = 'open'").groupBy("segment_id").agg(F.collect_list(F.struct("id", "kind", "message")).alias("issues"))
        active = sequences.current_translations(self.s.read("translations")).select("segment_id", F.col("id").alias("translation_record_id"), "translated_text")
        rows = bad.join(self._segments().select("segment_id", "ordinal", "text"), "segment_id", "left").join(active, "segment_id", "left").orderBy(F.col("ordinal").asc_nulls_last())
        rows = rows.limit(most_segments) if most_segments else rows
        jsonl.write_jsonl(rows, output)
        return rows.count()

    # -- review ----------------------------------------------------------------------------------
    def review(self, segment_ids=(), section_ids=()) -> tuple[int, int]:
        """(reviewed, revised) of the current records that no review has seen, of the segments and sections named or all."""
        asked = selection.select_segments(self.s.read("segments").drop("_pos"), segment_ids, section_ids)
        records, new = review.review(asked, self.s.read("translations"), self.s.read("reviews"))
        records, new = records.persist(), new.persist()
        try:
            with self.s.transaction():
                counts = self.s.append("reviews", records), self.s.append("translations", new)
        finally:
            records.unpersist()
            new.unpersist()
        return counts

    def review_scopes(self, scope_type: str, adapter=None, name: str = "heuristic", model: str = "consistency-v1") -> int:
        """Reviews of the sections (or the book) that changed since their last one; the number of reviews."""
        return self._review_scopes(scope_type, adapter, name, model)[0]

    def _review_scopes(self, scope_type: str, adapter=None, name: str = "heuristic", model: str = "consistency-v1", touched: DataFrame | None = None) -> tuple[int, DataFrame]:
        """(number of reviews, segment_id of what they revised).

        adapter: from rows (scope_id, segment_id, ordinal, text, output) of the scopes
        to (scope_id, segment_id, output) that it would have otherwise; without one
        nothing is revised.  A proposal must be for a segment of its scope.  touched:
        only scopes of these segments are looked at.
        """
        if not self.complete():
            raise ValueError("translation is incomplete")
        log = self.s.read("translations")
        active = sequences.current_translations(log)
        key = F.col("section_id") if scope_type == "section" else F.lit(self.id)
        rows = self._segments().select("segment_id", "ordinal", "text", key.alias("scope_id"))
        if touched is not None:
            rows = rows.join(rows.join(touched, "segment_id", "left_semi").select("scope_id").distinct(), "scope_id", "left_semi")
        digests = review.scope_digests(rows, active.select("segment_id", "id"), "scope_id")
        past = self.s.read("scope_reviews").where(F.col("scope_type") == scope_type)
        stale = review.stale_scopes(digests, past, "scope_id").persist()
        try:
            with self.s.transaction():
                return self._record_scopes(scope_type, adapter, name, model, rows.join(stale.select("scope_id"), "scope_id", "left_semi"), stale, log, active)
        finally:
            stale.unpersist()

    def _record_scopes(self, scope_type: str, adapter, name: str, model: str, rows: DataFrame, stale: DataFrame, log: DataFrame, active: DataFrame) -> tuple[int, DataFrame]:
        held = rows.join(active.select("segment_id", "unit_id", F.col("translated_text").alias("output")), "segment_id")
        odd = review.inconsistent_outputs(held, "scope_id").groupBy("scope_id").agg(F.count("*").alias("_odd"))
        revised = self.spark.createDataFrame([], "scope_id string, segment_id string, id string")
        after = active.select("segment_id", "id")
        if adapter is not None:
            asked = adapter(held.drop("unit_id")).select("scope_id", "segment_id", F.col("output").alias("proposed"))
            if odd_ids := [r["segment_id"] for r in asked.join(held, ["scope_id", "segment_id"], "left_anti").limit(5).collect()]:
                raise ValueError(f"revisions outside their scope: {', '.join(map(str, odd_ids))}")
            wanted = held.join(asked, ["scope_id", "segment_id"]).where("trim(proposed) <> '' AND proposed <> output")
            drafts_ = wanted.select("segment_id", "unit_id", F.col("text").alias("source_text"), F.col("proposed").alias("translated_text"))
            before = self.s.read("translations").select("id")
            self.s.append("translations", review.next_revisions(drafts_, log, name, model, f"{scope_type}-review", prompt=review.REVIEW_PROMPT))
            new = self.s.read("translations").join(before, "id", "left_anti").select("segment_id", "id")
            revised = rows.join(new, "segment_id").select("scope_id", "segment_id", "id")
            after = sequences.current_translations(self.s.read("translations")).select("segment_id", "id")
        outputs = review.scope_digests(rows, after, "scope_id").withColumnRenamed("digest", "_out")
        told = revised.groupBy("scope_id").agg(F.sort_array(F.collect_list("segment_id")).alias("_segments"), F.sort_array(F.collect_list("id")).alias("_ids"))
        met = stale.join(odd, "scope_id", "left").join(outputs, "scope_id").join(told, "scope_id", "left").withColumn("_odd", F.coalesce("_odd", F.lit(0)))
        none = F.array().cast("array<string>")
        reviews = met.select(
            stable_id("scope_review", F.lit(scope_type), F.col("scope_id"), F.col("digest"), F.lit(name), F.lit(model)).alias("id"), F.lit(scope_type).alias("scope_type"), "scope_id",
            F.col("digest").alias("input_digest"), F.col("_out").alias("output_digest"), F.lit(name).alias("adapter"), F.lit(model).alias("model"), F.lit(now()).alias("created_at"), F.when(F.col("_ids").isNull(), F.lit("pass")).otherwise(F.lit("revised")).alias("verdict"),
            F.concat(F.col("_odd").cast("string"), F.lit(" repeated sources with several translations")).alias("rationale"), F.when(F.col("_odd") > 0, F.array(F.lit("consistency"))).otherwise(none).alias("categories"), F.coalesce("_segments", none).alias("evidence_segment_ids"), F.coalesce("_ids", none).alias("revised_translation_ids"), F.lit(0.6).alias("confidence"),
        )
        return self.s.append("scope_reviews", reviews), revised.select("segment_id")

    def converge(self, most_rounds: int = 3, adapter=None, name: str = "heuristic", model: str = "consistency-v1") -> int:
        """Segment, section and book reviews until a round revises nothing.

        From the second round on only scopes are looked at that hold what the round
        before revised.
        """
        touched = None
        for k in range(1, most_rounds + 1):
            seen = self.s.read("translations").select("id")
            self.review()
            self._review_scopes("section", adapter, name, model, touched)
            self._review_scopes("book", adapter, name, model, touched)
            delta = self.s.read("translations").join(seen, "id", "left_anti").select("segment_id").distinct()
            if delta.isEmpty():
                return k
            touched = delta
        raise RuntimeError(f"reviews still revise after {most_rounds} rounds")

    # -- validation, export, audit -------------------------------------------------------------------
    def _issues(self, mode: str = "relaxed", segment_ids=(), section_ids=()) -> DataFrame:
        segments = selection.select_segments(self.s.read("segments").drop("_pos"), segment_ids, section_ids).withColumn("segment_id", F.col("id"))
        active = sequences.current_translations(self.s.read("translations"))
        if segment_ids or section_ids:  # only a whole run can tell orphans
            active = active.join(segments.select("segment_id"), "segment_id", "left_semi")
        found = rules.validate(segments, active, self.s.read("glossary"), mode, self.s.read("audit_resolutions"))
        return found.unionByName(self._academic_issues().select(*found.columns)) if self.source.get("source_format") == "jats" else found

    def _academic_issues(self) -> DataFrame:
        """An article's figures, tables and assets against its import report and the manifest of fetched assets."""
        one = self.spark.createDataFrame([(self.id,)], "project string")
        segments = self.s.read("segments").select(F.lit(self.id).alias("project"), F.col("id").alias("segment_id"), "raw", "kind")
        report = self.s.get_json("import_report.json")
        report = self.spark.createDataFrame([(self.id, report.get("figures", 0), report.get("tables", 0))] if report else [], "project string, figures long, tables long")
        manifest = [(self.id, a["path"].removeprefix("source/"), a["sha256"]) for a in self.s.get_json("academic_assets.json").get("assets", [])]
        folder = self.source["source_path"].rsplit("/", 1)[0] + "/assets"
        there = self.spark.createDataFrame([], "path string, found_sha256 string")
        if self.s.exists(folder):
            files = self.spark.read.format("binaryFile").load(folder)
            there = files.select(F.concat(F.lit("assets/"), F.regexp_extract("path", "([^/]+)$", 1)).alias("path"), F.sha2("content", 256).alias("found_sha256"))
        assets = self.spark.createDataFrame(manifest, "project string, path string, sha256 string").join(there, "path", "left")
        return rules.academic_issues(one, segments, report, assets)

    def import_assets(self, folder: str) -> int:
        """Take fetched figures (PNG, JPEG, GIF or TIFF by their first bytes) and record their digests."""
        files = self.spark.read.format("binaryFile").load(folder).select(F.regexp_extract("path", "([^/]+)$", 1).alias("name"), "content")
        known = F.lower(F.hex(F.substring("content", 1, 4)))
        bad = files.where(~F.startswith(known, F.lit("89504e47")) & ~F.startswith(known, F.lit("ffd8ff")) & ~F.startswith(known, F.lit("47494638")) & ~known.isin("49492a00", "4d4d002a"))
        if odd := [r["name"] for r in bad.select("name").limit(5).collect()]:
            raise ValueError(f"not an image: {', '.join(odd)}")
        target, rows = self.source["source_path"].rsplit("/", 1)[0] + "/assets", []
        for r in files.select("name", F.sha2("content", 256).alias("sha256")).toLocalIterator():
            self.s.put(f"{target}/{r['name']}", self.s.get(f"{folder.rstrip('/')}/{r['name']}"))
            rows.append({"path": f"source/assets/{r['name']}", "sha256": r["sha256"]})
        self.s.put_json("academic_assets.json", {"assets": sorted(rows, key=lambda a: a["path"])})
        return len(rows)

    def validate(self, mode: str = "relaxed", segment_ids=(), section_ids=()) -> DataFrame:
        found = self.s.overwrite("issues", self._issues(mode, segment_ids, section_ids))
        self.step("validate", "completed" if found.isEmpty() else "failed")
        return found

    def import_resolutions(self, path: str, reviewer: str, model: str) -> int:
        fields = dict.fromkeys(("segment_id", "translation_record_id", "issue_id", "rationale", "evidence"), "string")
        rows = drafts.parse(self.spark.read.text(path), fields)
        active = sequences.current_translations(self.s.read("translations"))
        self._refuse(drafts.resolution_violations(rows, self._issues("strict"), active))
        new = rows.drop("_bad").withColumn("id", stable_id("audit_resolution", F.col("segment_id"), F.col("translation_record_id"), F.col("issue_id")))
        new = new.withColumn("disposition", F.lit("accepted")).withColumn("reviewer", F.lit(reviewer)).withColumn("model", F.lit(model)).withColumn("created_at", F.lit(now()))
        return self.s.append("audit_resolutions", selection.append_new(self.s.read("audit_resolutions"), new))

    def _edition(self, segment_ids=(), section_ids=()) -> tuple[DataFrame, DataFrame]:
        active = sequences.current_translations(self.s.read("translations")).select("segment_id", F.col("translated_text").alias("output"))
        rows = selection.select_segments(self.s.read("segments").drop("_pos"), segment_ids, section_ids).withColumn("segment_id", F.col("id")).join(active, "segment_id", "left")
        rows = rows.select(F.lit(self.id).alias("document"), "section_id", "ordinal", "raw", "kind", F.coalesce("output", "raw").alias("output"))
        last = sequences.current(self.s.read("section_titles"), "section_id").select("section_id", "translated_title")
        titles = self.s.read("sections").select(F.col("id").alias("section_id"), "title", "level", F.col("ordinal").alias("section_ordinal")).join(last, "section_id", "left")
        return rows, titles

    def export(self, formats=("md", "epub"), contents=("translated", "bilingual"), segment_ids=(), section_ids=()) -> list[str]:
        """Editions; refused while an issue is an error."""
        bad = self._issues("relaxed", segment_ids, section_ids).where("severity = 'error' AND status = 'open'").count()
        if bad:
            raise ValueError(f"{bad} errors block the export")
        scope = ""
        if ids := sorted([*segment_ids, *section_ids]):
            scope = ids[0] if len(ids) == 1 else self.spark.range(1).select(stable_id_of_array("scope", ids[0], F.array(*map(F.lit, ids[1:])))).first()[0]
        rows, titles = self._edition(segment_ids, section_ids)
        active = sequences.current_translations(self.s.read("translations"))
        translator = review.attribution(active).first()[0]
        facts = {"source_title": self.source["title"], "source_language": self.record["source_language"], "target_language": self.record["target_language"], "translator": translator, "fidelity_note": "Every segment is translated from the retained source.", "generated_at": now()}
        out = []
        for content in contents:
            blocks = render.rendered_blocks(rows, titles, content)
            folder = self.s.path("output", self.id, *filter(None, [scope]))
            if "md" in formats:
                head = self.spark.range(1).select(render.front_matter(*(F.lit(facts[k]) for k in ("source_title", "source_language", "target_language", "translator")))).first()[0]
                body = render.render(blocks).first()
                self.s.put(f"{folder}/{content}.md", (head + "\n" + (body["markdown"] if body else "")).encode())
                out.append(f"{folder}/{content}.md")
            if "epub" in formats or "docx" in formats:
                target = F.coalesce("translated_title", "title")
                named = titles.orderBy("section_ordinal").select("section_id", "level", target.alias("name")).collect()
                parts: dict[str, list[str]] = {}
                for r in render.rendered_blocks(rows, titles.limit(0), content).orderBy("ordinal").collect():
                    parts.setdefault(r["section_id"], []).extend(r["block"].split("\n\n---")[0].split("\n\n") if content == "bilingual" else [r["block"]])
                pages = [(r["name"], r["level"], parts.get(r["section_id"], [])) for r in named]
                if "epub" in formats:
                    resources = None
                    if self.source.get("source_format") == "epub":
                        original = self.s.get(self.source["original_path"])
                        texts = self.spark.createDataFrame([(self.id, *t) for t in epub.document_texts(original)], "book string, name string, content string")
                        sections = titles.select(F.lit(self.id).alias("book"), "section_id", "title", F.col("section_ordinal").alias("ordinal"))
                        best = alignment.best_sections(texts, sections, self._segments().withColumn("book", F.lit(self.id))).collect()
                        resources = epub.Resources(original, {r["name"]: f"section-{r['ordinal']:04d}.xhtml" for r in best})
                    self.s.put(f"{folder}/{content}.epub", epub.write_epub(self.source["title"], self.record["target_language"], pages, list(facts.items()), resources))
                    out.append(f"{folder}/{content}.epub")
                if "docx" in formats:
                    if not self.complete():
                        raise ValueError("an academic edition needs a complete translation")
                    flow = [x for name, level, blocks_ in pages for x in [("heading", level, name), *(("table" if b.lstrip().startswith("|") else "list" if re.match(r"[-*+] ", b) else "paragraph", 0, b) for b in blocks_)]]
                    self.s.put(f"{folder}/{content}.docx", office.write_docx(flow, self.source["title"]))
                    out.append(f"{folder}/{content}.docx")
        if not scope:
            self.s.put_json("export_metadata.json", facts)
        self.step("export", "completed")
        return out

    def audit(self, allow_mock: bool = False) -> tuple[bool, list[dict]]:
        artifacts = {}
        for name in ("translated.md", "bilingual.md", "translated.epub", "bilingual.epub"):
            path = self.s.path("output", self.id, name)
            if self.s.exists(path):
                content = self.s.get(path)
                artifacts[name] = {"size": len(content)} | (epub.integrity(content) if name.endswith("epub") else {})
        source = dict(self.source)
        images = 0
        if source:
            source["retained"] = self.s.exists(source["source_path"]) and self.s.exists(source["original_path"])
            source["reported"] = bool(self.s.get_json("import_report.json"))
            if source["source_format"] == "epub":
                images = len(re.findall(r"!\[[^\]]*\]\([^)]+\)", self.s.get(source["source_path"]).decode()))
        checks = audit.audit(self.tables(), self.record, source, self.s.get_json("translation_brief.json"), artifacts, self.s.get_json("export_metadata.json"), images, allow_mock)
        self.s.put_json("v1_audit.json", {"ready": audit.ready(checks), "checks": checks, "generated_at": now()})
        self.note("audit", "Audit", [f"{c['id']}: {c['status']}" for c in checks])
        return audit.ready(checks), checks

    # -- administration ---------------------------------------------------------------------------------
    def status(self) -> dict:
        live = self.s.read("segments").select(F.col("id").alias("segment_id"))
        active = sequences.current_translations(self.s.read("translations")).join(live, "segment_id", "left_semi").count()
        counts = {f"{t[:-1]}_count": self.s.read(t).count() for t in ("sections", "segments", "units")} | {"translation_count": active}
        manifest = self.s.get_json("manifest.json") | counts
        manifest.setdefault("steps", {})["translate"] = "completed" if active and active == counts["segment_count"] else "in_progress" if active else "pending"
        return manifest

    def inspect(self) -> dict:
        """Counts of what is open, without a change to the project."""
        active = sequences.current_translations(self.s.read("translations"))
        segments = self.s.read("segments")
        return {
            "pending_segments": segments.select(F.col("id").alias("segment_id")).join(active, "segment_id", "left_anti").count(),
            "unreviewed_records": active.join(review.reviewed_ids(self.s.read("reviews"), self.s.read("scope_reviews")).withColumnRenamed("record_id", "id"), "id", "left_anti").count(),
            "open_issues": self.s.read("issues").where("status = 'open'").count(),
            "open_ambiguities": self.s.read("ambiguities").where("status = 'open'").count(),
            "proposed_terms": self.s.read("glossary").where("status = 'proposed'").count(),
            "proposed_entities": self.s.read("entities").where("status = 'proposed'").count(),
            "mock_translations": active.where("adapter = 'mock'").count(),
            "version": self.s.version(),
        }

    def migrate(self) -> int:
        """Fill defaults of older tables; identifiers stay."""
        record = self.record
        if record.get("schema_version", 1) >= CURRENT_VERSION:
            return record["schema_version"]
        with self.s.transaction():
            for t in self.s.state()["tables"]:
                self.s.overwrite(t, self.s.read(t).drop("_pos"))
            self.s.put_json("project.json", record | {"schema_version": CURRENT_VERSION})
        return CURRENT_VERSION

    def auto(self, most_rounds: int = 3, **translation) -> tuple[bool, list[dict]]:
        """From segmentation to audit; what is done already is passed over."""
        if self.s.read("units").isEmpty():
            self.segment()
        self.analyze()
        self.summarize()
        self.propose_knowledge()
        names = {k: translation[k] for k in ("adapter", "name", "model") if k in translation}
        self.translate_titles(**names)
        self.translate(**names)
        self.converge(most_rounds)
        if not self.validate().where("severity = 'error' AND status = 'open'").isEmpty():
            return False, []
        self.export()
        return self.audit(allow_mock=True)
