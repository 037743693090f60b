"""Projects end to end, their gates, resuming, and audits of damaged state."""

import json
import shutil

import pytest
from lexiflow.cli import COMMANDS, run
from lexiflow.operators import review
from lexiflow.plans.project import Project
from pyspark.sql import functions as F

BOOK = """# One

First paragraph of the book, in 1999.

Last **paragraph** of the chapter.

# Two

Chapter two says [?] something of power.
"""


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


@pytest.fixture(scope="module", autouse=True)
def interpreted(spark):
    """A few rows a table: compiling their plans takes longer than running them."""
    quick = {"spark.sql.codegen.wholeStage": "false", "spark.sql.codegen.factoryMode": "NO_CODEGEN", "spark.sql.shuffle.partitions": "1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in quick}
    for k, v in quick.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.fixture(scope="module")
def done(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("done")
    p = Project.init(spark, str(folder / "store"), "Book", "en", "zh-CN")
    p.import_source(write(folder / "book.md", BOOK))
    ready, checks = p.auto()
    shutil.copytree(folder / "store", folder / "whole")
    return p, ready, checks, folder


def test_auto_is_ready(done):
    p, ready, checks, _ = done
    assert [c["id"] for c in checks if c["status"] != "pass"] == [] and ready and len(checks) == 21
    open_ = p.inspect()
    assert (open_["pending_segments"], open_["unreviewed_records"], open_["open_issues"], open_["open_ambiguities"], open_["mock_translations"]) == (0, 0, 0, 1, 3) and p.inspect() == open_
    status = p.status()
    assert (status["section_count"], status["segment_count"], status["unit_count"], status["translation_count"]) == (2, 3, 2, 3)
    assert status["steps"]["translate"] == "completed"


def test_steps_resume_without_new_rows(done):
    p, *_ = done
    assert p.translate() == 0 and p.translate_titles() == 0 and p.summarize() == 0
    assert p.review() == (0, 0) and p.review_scopes("section") == 0 and p.review_scopes("book") == 0
    assert p.s.read("ambiguities").count() == 1


def test_editions(done):
    p, *_ = done
    text = p.s.get(p.s.path("output", p.id, "translated.md")).decode()
    assert text.startswith("---\n") and "[MOCK] Last **paragraph** of the chapter." in text and "# [MOCK] One" in text
    both = p.s.get(p.s.path("output", p.id, "bilingual.md")).decode()
    assert "> First paragraph" in both and "\n---" in both


def test_ids_are_stable_and_recut(spark, done, tmp_path):
    p, *_ = done
    before = {r.id for r in p.s.read("segments").collect()}
    p.segment()
    assert {r.id for r in p.s.read("segments").collect()} == before
    assert all(i.startswith("seg_") and len(i) == 20 for i in before)


def test_a_new_revision_makes_scopes_stale(spark, done, tmp_path):
    p, *_ = done
    segment = p.s.read("segments").orderBy("ordinal").first()
    draft = write(tmp_path / "draft.jsonl", json.dumps({"segment_id": segment.id, "translated_text": "第一段，1999年。"}, ensure_ascii=False) + "\n")
    assert p.import_draft(draft, "agent", "m1") == 1
    log = p.s.read("translations").where(F.col("segment_id") == segment.id).orderBy("revision").collect()
    assert [r.revision for r in log] == [1, 2] and log[1].supersedes == log[0].id and log[0].supersedes is None
    failed = {c["id"] for c in p.audit(allow_mock=True)[1] if c["status"] != "pass"}
    assert {"segment_review_coverage", "section_review_coverage", "book_review"} <= failed
    assert p.converge() == 1
    assert p.review_scopes("section") == 0


def test_drafts_are_refused(done, tmp_path):
    p, *_ = done
    known = p.s.read("segments").first().id
    for rows, reason in (
        ([{"segment_id": "none", "translated_text": "x"}], "unknown id"),
        ([{"segment_id": known, "translated_text": " "}], "blank text"),
        ([{"segment_id": known, "translated_text": "x"}] * 2, "repeated id"),
        ([{"segment_id": known, "translated_text": "x", "more": 1}], "wrong fields"),
    ):
        with pytest.raises(ValueError, match=reason):
            p.import_draft(write(tmp_path / "bad.jsonl", "\n".join(map(json.dumps, rows))), "agent", "m")


def test_errors_block_exports_until_resolved(spark, tmp_path):
    p = Project.init(spark, str(tmp_path / "store"), "Numbers", "en", "zh-CN")
    p.import_source(write(tmp_path / "n.md", "# One\n\nIt cost 12 coins.\n"))
    p.segment()
    with pytest.raises(ValueError, match="block"):
        p.export()
    segment = p.s.read("segments").first()
    p.import_draft(write(tmp_path / "d.jsonl", json.dumps({"segment_id": segment.id, "translated_text": "它花了十三枚硬币。"}, ensure_ascii=False)), "agent", "m")
    found = p.validate("strict").collect()
    assert [(i.kind, i.severity) for i in found] == [("numeric_anchor_mismatch", "error")]
    assert p.repair_batch(str(tmp_path / "repair")) == 1
    record = p.s.read("translations").first()
    line = {"segment_id": segment.id, "translation_record_id": record.id, "issue_id": found[0].id, "rationale": "rounded", "evidence": "editor"}
    with pytest.raises(ValueError, match="not current"):
        p.import_resolutions(write(tmp_path / "r0.jsonl", json.dumps(line | {"translation_record_id": "tr_x"})), "me", "m")
    assert p.import_resolutions(write(tmp_path / "r.jsonl", json.dumps(line)), "me", "m") == 1
    after = p.validate("strict").collect()
    assert [(i.severity, i.status) for i in after] == [("warning", "resolved")]
    assert len(p.export(formats=("md", "epub", "docx"))) == 6


def test_passed_source_conflict_and_replace(spark, tmp_path):
    p = Project.init(spark, str(tmp_path / "store"), "Swap", "en", "de")
    with pytest.raises(FileExistsError):
        Project.init(spark, str(tmp_path / "store"), "Swap", "en", "de")
    one, two = write(tmp_path / "a.md", "# A\n\nText a.\n"), write(tmp_path / "b.txt", "Chapter 1\n\nText b.\n")
    p.import_source(one)
    p.import_source(one)
    with pytest.raises(ValueError, match="replace"):
        p.import_source(two)
    p.segment()
    p.translate()
    p.replace_source(two)
    assert p.s.read("translations").isEmpty() and p.segment() == (1, 1, 1)
    assert p.s.read("sections").first().title == "Chapter 1"


def test_batches_and_campaigns(spark, tmp_path):
    p = Project.init(spark, str(tmp_path / "store"), "Work", "en", "de")
    p.import_source(write(tmp_path / "w.md", "# A\n\n" + "\n\n".join(f"Sentence {k} of it." for k in range(10)) + "\n\n# B\n\nOther text.\n"))
    assert p.segment(2) == (2, 11, 6)
    assert p.batch(str(tmp_path / "b1")) == 5  # stops at the section's end
    assert p.batch(str(tmp_path / "b2"), most_units=6) == 6  # an explicit cap crosses sections
    packet = json.loads(next((tmp_path / "b2").glob("part-*")).read_text().splitlines()[1])
    assert packet["previous_text"] == "Sentence 1 of it." and packet["next_text"] == "Sentence 4 of it."
    plan = p.campaign(most_units=2)
    assert sorted(c["units"] for c in plan) == [1, 1, 2, 2] and {c["status"] for c in plan} == {"pending"}
    p.translate(most_units=2)
    assert sorted(c["status"] for c in p.campaign()) == ["completed", "pending", "pending", "pending"]


def test_batches_of_sections_and_budgets(spark, tmp_path):
    p = Project.init(spark, str(tmp_path / "store"), "Scope", "en", "de")
    p.import_source(write(tmp_path / "w.md", "# A\n\n" + "\n\n".join(f"Sentence {k} of it." for k in range(6)) + "\n\n# B\n\nOther text.\n\nSecond text.\n"))
    p.segment(1)
    b = next(r.id for r in p.s.read("sections").collect() if r.title == "B")
    assert p.batch(str(tmp_path / "1"), section_ids=[b]) == 2
    assert p.batch(str(tmp_path / "2"), source_chars=36) == 2 and p.batch(str(tmp_path / "3"), most_units=9, source_chars=50) == 2
    assert p.batch(str(tmp_path / "4"), window=300) < 6
    with pytest.raises(ValueError, match="unknown section"):
        p.batch(str(tmp_path / "5"), section_ids=["none"])
    with pytest.raises(ValueError, match="at least 1"):
        p.batch(str(tmp_path / "5"), source_chars=0)
    p.translate()
    assert p.review(section_ids=[b]) == (2, 0) and p.review() == (6, 0)
    with pytest.raises(ValueError, match="unknown segment"):
        p.review(segment_ids=["none"])


def test_scope_reviews_revise_until_nothing_changes(spark, tmp_path, monkeypatch):
    p = Project.init(spark, str(tmp_path / "store"), "Cohere", "en", "de")
    p.import_source(write(tmp_path / "w.md", "# A\n\nA refrain.\n\nOther.\n\nA REFRAIN.\n\n# B\n\nUntouched text.\n"))
    p.segment(1)
    p.translate(adapter=lambda raw, text: F.concat(F.lit("T "), F.ascii(F.substring(text, 3, 1)).cast("string")), name="agent", model="m")
    looked, scopes = [], review.scope_digests
    monkeypatch.setattr(review, "scope_digests", lambda rows, *a: looked.append(sorted(r.scope_id for r in rows.select("scope_id").distinct().collect())) or scopes(rows, *a))
    assert p.converge(adapter=review.one_rendering, name="editor", model="e1") == 2
    last = {r.segment_id: r for r in p.s.read("translations").collect() if r.revision == 2}
    assert [r.translated_text for r in last.values()] == ["T 114"]
    past = {(r.scope_type, r.verdict): r for r in p.s.read("scope_reviews").collect()}
    found = past["section", "revised"]
    assert found.evidence_segment_ids == list(last) and found.revised_translation_ids == [r.id for r in last.values()] and found.input_digest != found.output_digest
    sections = {r.title: r.id for r in p.s.read("sections").collect()}
    # the first round looks at both sections, the second at the one that was revised
    assert looked[0] == sorted(sections.values()) and [sections["A"]] in looked and looked[-1] != looked[0]
    assert p.review_scopes("section") == 0 and p.converge(adapter=review.one_rendering) == 1
    with pytest.raises(ValueError, match="outside their scope"):
        p.import_draft(write(tmp_path / "d.jsonl", json.dumps({"segment_id": next(iter(last)), "translated_text": "new"})), "agent", "m")
        p.review_scopes("section", lambda rows: rows.select("scope_id", F.lit("elsewhere").alias("segment_id"), "output"))


def test_articles_need_their_figures(spark, tmp_path):
    p = Project.init(spark, str(tmp_path / "store"), "Article", "en", "de")
    p.import_source(write(tmp_path / "w.md", "# A\n\n![one](assets/g001.png)\n\n![two](assets/g002.png)\n\nText.\n"))
    with p.s.transaction():
        p.s.put_json("source_document.json", p.source | {"source_format": "jats"})
        p.s.put_json("import_report.json", {"figures": 2, "tables": 1})
    p.segment()
    p.translate()
    kinds = lambda: sorted(i.kind for i in p.validate().collect())
    assert kinds() == ["academic_missing_figure_asset"] * 2 + ["academic_table_count_mismatch"]
    (tmp_path / "got").mkdir()
    (tmp_path / "got/g001.png").write_bytes(b"\x89PNG\r\n1")
    (tmp_path / "got/g002.png").write_bytes(b"\x89PNG\r\n2")
    assert p.import_assets(str(tmp_path / "got")) == 2 and kinds() == ["academic_table_count_mismatch"]
    p.s.put(p.source["source_path"].rsplit("/", 1)[0] + "/assets/g002.png", b"\x89PNGother")
    assert kinds() == ["academic_figure_asset_changed", "academic_table_count_mismatch"]
    (tmp_path / "got/page.png").write_text("<html>")
    with pytest.raises(ValueError, match="not an image: page.png"):
        p.import_assets(str(tmp_path / "got"))


def test_terminology(spark, done, tmp_path):
    p, *_ = done
    segment = p.s.read("segments").first().id
    base = {"term": "Power", "candidate_translation": "权力", "authority": "official", "source_title": "T", "source_url": "https://example.org/x", "source_excerpt": "e", "evidence_segment_ids": [segment], "confidence": 0.95}
    better = base | {"candidate_translation": "权势", "authority": "standard", "confidence": 0.91}
    path = write(tmp_path / "c.jsonl", json.dumps(base) + "\n" + json.dumps(better) + "\n")
    assert p.import_terminology(path) == (2, 0) and p.import_terminology(path) == (0, 2)
    for change, reason in (({"source_url": "http://x"}, "HTTPS"), ({"authority": "blog"}, "authority"), ({"confidence": 2}, "confidence"), ({"evidence_segment_ids": ["no"]}, "evidence")):
        with pytest.raises(ValueError, match=reason):
            p.import_terminology(write(tmp_path / "bad.jsonl", json.dumps(base | change)))
    assert p.adjudicate_terminology(True) == 1 and p.adjudicate_terminology(True) == 0
    entry = p.s.read("glossary").where("term = 'Power'").first()
    assert (entry.preferred_translation, entry.status) == ("权势", "approved")
    assert p.terminology_impact("POWER").count() == 1
    assert p.terminology_plan(str(tmp_path / "plan")) >= 1


def test_reference(spark, tmp_path):
    p = Project.init(spark, str(tmp_path / "store"), "Ref", "en", "zh-CN")
    p.import_source(write(tmp_path / "s.md", "# 1 Control\n\nDigital technology.\n\nA second paragraph.\n"))
    p.segment(1)
    reference = write(tmp_path / "r.md", "# １ 掌控\n\n數位科技。\n\n第二段軟體。\n")
    assert p.import_reference(reference, "zh-TW", "Somebody") == (1, 2, 1)
    assert all("數位科技。" in r.reference_texts for r in p.reference_context().collect())
    table = spark.createDataFrame([("數位", "数字"), ("軟體", "软件")], "phrase string, adapted string")
    assert p.simplify_reference(table) == 2
    texts = {x for r in p.reference_context().collect() for x in r.reference_texts}
    assert texts == {"数字科技。", "第二段软件。"}


def test_heuristic_review_revises(spark, tmp_path):
    p = Project.init(spark, str(tmp_path / "store"), "Rev", "en", "zh-CN")
    p.import_source(write(tmp_path / "s.md", "# A\n\nThey were disempowered.\n"))
    p.segment()
    p.translate(adapter=lambda raw, text: F.lit("他们失去了力量。"), name="agent", model="m")
    assert p.review() == (1, 1) and p.review() == (0, 0)
    last = p.s.read("translations").orderBy(F.desc("revision")).first()
    assert last.translated_text == "他们权力受到削弱。" and last.revision == 2
    with pytest.raises(ValueError, match="empty"):
        p.translate(segment_ids=[last.segment_id], adapter=lambda raw, text: F.lit(""), name="x")
    with pytest.raises(ValueError, match="unknown segment"):
        p.translate(segment_ids=["none"])


@pytest.mark.parametrize(
    ("table", "damage", "check"),
    [
        ("translations", lambda df: df.withColumn("supersedes", F.lit("tr_x")), "revision_integrity"),
        ("translations", lambda df: df.limit(1), "translation_coverage"),
        ("section_titles", lambda df: df.withColumn("source_sha256", F.lit("0")), "section_title_revision_integrity"),
        ("section_titles", lambda df: df.limit(1), "section_title_coverage"),
        ("ambiguities", lambda df: df.withColumn("evidence_segment_ids", F.array(F.lit("no"))), "ambiguity_evidence"),
        ("section_summaries", lambda df: df.limit(0), "section_summaries"),
        ("reviews", lambda df: df.limit(0), "segment_review_coverage"),
        ("units", lambda df: df.limit(1), "stable_structure"),
    ],
)
def test_audit_finds_damage(spark, done, tmp_path, table, damage, check):
    shutil.copytree(done[3] / "whole", tmp_path / "store")
    p = Project(spark, str(tmp_path / "store"), done[0].id)
    p.s.overwrite(table, damage(p.s.read(table).drop("_pos")))
    assert check in {c["id"] for c in p.audit(allow_mock=True)[1] if c["status"] != "pass"}


def test_command_line(spark, tmp_path, capsys):
    root, book = str(tmp_path / "store"), write(tmp_path / "book.md", BOOK)
    say = lambda *a: (run(list(a), spark), capsys.readouterr().out)
    code, out = say("init", root, "Cli", "--source-language", "en", "--target-language", "de")
    key = json.loads(out)["id"]
    assert code == 0 and say("import", root, key, book)[0] == 0 and say("segment", root, key)[1].strip() == "[2, 3, 2]"
    assert say("validate", root, key)[0] == 1  # nothing is translated yet
    assert say("translate", root, key)[1].strip() == "3" and say("validate", root, key)[0] == 0
    assert say("segment", root, "prj_none")[0] == 2
    assert json.loads(say("status", root, key)[1])["segment_count"] == 3
    assert len(COMMANDS) >= 31
