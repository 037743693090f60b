"""Command line: lexiflow COMMAND ROOT PROJECT ...; exit 0 done, 1 a gate failed, 2 an error."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from .operators.sequences import WINDOW_TOKENS

SELECT = [("--segment", {"action": "append", "default": []}), ("--section", {"action": "append", "default": []})]
ADAPTER = [("--adapter", {"default": "agent"}), ("--model", {"default": "unknown"}), ("--reason", {"default": "draft"})]
#: command: (help, arguments)
COMMANDS: dict[str, tuple[str, list]] = {
    "init": ("make a project", [("--source-language", {"required": True}), ("--target-language", {"required": True})]),
    "import": ("import a source file", [("path", {})]),
    "replace": ("replace the source and all that was made from it", [("path", {})]),
    "segment": ("split into sections, segments and units", [("--unit-size", {"type": int, "default": 3})]),
    "analyze": ("profile the book", [("--refresh", {"action": "store_true"})]),
    "summarize": ("summarize sections", [("--refresh", {"action": "store_true"})]),
    "extract-knowledge": ("propose terms and entities", [("--minimum", {"type": int, "default": 2})]),
    "glossary-import": ("load a glossary", [("path", {})]),
    "terminology-plan": ("write research tasks", [("output", {})]),
    "terminology-import": ("load candidates", [("path", {})]),
    "terminology-adjudicate": ("decide on candidates", [("--approve-authoritative", {"action": "store_true"})]),
    "terminology-impact": ("segments with a term", [("term", {})]),
    "translate": ("translate what is pending", [*SELECT, ("--term", {"default": ""}), ("--max-units", {"type": int}), ("--reason", {"default": "initial"})]),
    "translate-titles": ("translate section titles", [("--refresh", {"action": "store_true"})]),
    "translation-import": ("load a draft", [("path", {}), *ADAPTER]),
    "title-import": ("load a title draft", [("path", {}), *ADAPTER]),
    "agent-batch": ("write the next work package", [("output", {}), ("--max-units", {"type": int}), SELECT[1], ("--source-chars", {"type": int}), ("--context-window", {"type": int, "default": WINDOW_TOKENS})]),
    "agent-campaign": ("plan work packages, or show their progress", [("--max-segments", {"type": int}), ("--refresh", {"action": "store_true"})]),
    "audit-repair": ("write what strict validation finds", [("output", {}), ("--max-segments", {"type": int})]),
    "resolution-import": ("accept findings", [("path", {}), ("--reviewer", {"required": True}), ("--model", {"default": "unknown"})]),
    "review": ("review translations", [*SELECT]),
    "review-sections": ("review sections that changed", []),
    "review-book": ("review the book if it changed", []),
    "validate": ("run the rules", [*SELECT, ("--numeric-mode", {"choices": ["relaxed", "balanced", "strict"], "default": "relaxed"})]),
    "export": ("write editions", [*SELECT, ("--format", {"action": "append", "choices": ["md", "epub", "docx"]}), ("--content", {"action": "append", "choices": ["translated", "bilingual"]})]),
    "reference-import": ("load a reference edition", [("path", {}), ("--language", {"required": True}), ("--credit", {"required": True})]),
    "reference-align": ("align the reference again", []),
    "reference-simplify": ("adapt the reference by a phrase table", [("dictionary", {})]),
    "audit": ("check for release", [("--allow-mock", {"action": "store_true"})]),
    "status": ("counts and steps", []),
    "inspect": ("counts of what is open; changes nothing", []),
    "assets-import": ("take fetched figures of an article", [("path", {})]),
    "migrate": ("bring old tables up to date", []),
    "auto": ("all steps", [("--max-rounds", {"type": int, "default": 3})]),
}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lexiflow", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)
    for name, (text, arguments) in COMMANDS.items():
        p = commands.add_parser(name, help=text)
        p.add_argument("root")
        p.add_argument("project", help="a name for init, else an id")
        for flag, options in arguments:
            p.add_argument(flag, **options)
    return top


def run(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    from .plans.project import Project

    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("lexiflow").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    show = lambda x: print(json.dumps(x, ensure_ascii=False, default=str))
    try:
        if a.command == "init":
            show(Project.init(spark, a.root, a.project, a.source_language, a.target_language).record)
            return 0
        p = Project(spark, a.root, a.project)
        match a.command:
            case "import": show(p.import_source(a.path))
            case "replace": show(p.replace_source(a.path))
            case "segment": show(p.segment(a.unit_size))
            case "analyze": show(p.analyze(a.refresh))
            case "summarize": show(p.summarize(a.refresh))
            case "extract-knowledge": show(p.propose_knowledge(a.minimum))
            case "glossary-import": show(p.import_glossary(a.path))
            case "terminology-plan": show(p.terminology_plan(a.output))
            case "terminology-import": show(p.import_terminology(a.path))
            case "terminology-adjudicate": show(p.adjudicate_terminology(a.approve_authoritative))
            case "terminology-impact": show([r["segment_id"] for r in p.terminology_impact(a.term).select("segment_id").toLocalIterator()])
            case "translate": show(p.translate(a.segment, a.section, a.term, a.reason, a.max_units))
            case "translate-titles": show(p.translate_titles(a.refresh))
            case "translation-import": show(p.import_draft(a.path, a.adapter, a.model, a.reason))
            case "title-import": show(p.import_title_draft(a.path, a.adapter, a.model, a.reason))
            case "agent-batch": show(p.batch(a.output, a.max_units, a.section, a.source_chars, a.context_window))
            case "agent-campaign": show(p.campaign(a.max_segments, refresh=a.refresh))
            case "audit-repair": show(p.repair_batch(a.output, a.max_segments))
            case "resolution-import": show(p.import_resolutions(a.path, a.reviewer, a.model))
            case "review": show(p.review(a.segment, a.section))
            case "review-sections": show(p.review_scopes("section"))
            case "review-book": show(p.review_scopes("book"))
            case "validate":
                found = {r["severity"]: r["count"] for r in p.validate(a.numeric_mode, a.segment, a.section).where("status = 'open'").groupBy("severity").count().collect()}
                show(found)
                return int("error" in found)
            case "export": show(p.export(a.format or ("md", "epub"), a.content or ("translated", "bilingual"), a.segment, a.section))
            case "reference-import": show(p.import_reference(a.path, a.language, a.credit))
            case "reference-align": show(p.align_reference())
            case "reference-simplify": show(p.simplify_reference(spark.read.option("header", True).csv(a.dictionary)))
            case "audit" | "auto":
                ready, checks = p.audit(a.allow_mock) if a.command == "audit" else p.auto(a.max_rounds)
                show({"ready": ready, "failed": [c["id"] for c in checks if c["status"] != "pass"]})
                return int(not ready)
            case "status": show(p.status())
            case "inspect": show(p.inspect())
            case "assets-import": show(p.import_assets(a.path))
            case "migrate": show(p.migrate())
        return 0
    except (ValueError, FileExistsError, FileNotFoundError, RuntimeError) as e:
        print(f"lexiflow: {e}", file=sys.stderr)
        return 2


def main() -> None:
    sys.exit(run())


if __name__ == "__main__":
    main()
