"""Importers and strict readers on tiny files."""

import json

import pytest
from lexiflow import schema
from lexiflow.sources import documents, drafts, epub, html, jats, jsonl, office

ARTICLE = b"""<article xmlns:xlink="http://www.w3.org/1999/xlink"><front><article-meta><article-id pub-id-type="doi">10.1/x</article-id>
<title-group><article-title>A <i>study</i></article-title></title-group><abstract><p>Short.</p></abstract></article-meta></front>
<body><sec><title>Methods</title><p>We did <xref>1</xref> this.</p><fig><label>Fig 1</label><caption><p>A plot.</p></caption>
<graphic xlink:href="info:doi/10.1/journal.pone.g001"/></fig><table-wrap><label>Table 1</label><caption><p>Data.</p></caption>
<table><tr><th>a</th><th>b</th></tr><tr><td>1</td></tr></table></table-wrap><disp-formula>E=mc</disp-formula></sec></body>
<back><fn-group><fn>Note.</fn></fn-group><ref-list><ref>Ref one.</ref></ref-list></back></article>"""


def test_article():
    found = jats.read_article(ARTICLE, "x")
    text = "\n\n".join(found.blocks)
    assert found.title == "A study" and found.counts == {"paragraphs": 2, "headings": 1, "figures": 1, "tables": 1, "equations": 1, "citations": 1, "footnotes": 1, "references": 1}
    for part in ("## Abstract", "![Fig 1](assets/pone.g001.png)", "> **Fig 1.** A plot.", "| a | b |\n| --- | --- |\n| 1 |  |", "```math\nE=mc\n```", "[^fn-1]: Note.", "1. Ref one."):
        assert part in text
    assert jats.doi(ARTICLE) == "10.1/x" and jats.graphics(ARTICLE) == [("info:doi/10.1/journal.pone.g001", "assets/pone.g001.png")]
    for bad in (b"<article>", b"<html/>"):
        with pytest.raises(ValueError):
            jats.read_article(bad, "x")


def test_html():
    page = '<html><head><title>T</title><script>var t="</p>";</script></head><body><h1 class="cn">1</h1><h1 class="ct">Start</h1><p>A <em>b</em> <a href="x" epub:type="noteref">1</a><p>C<img src="i.png" alt="z"><ul><li>one</li></ul></body>'
    markdown, title, counts = html.html_to_markdown(page)
    assert title == "T" and counts == {"paragraphs": 2, "headings": 2, "images": 1, "links": 1, "footnote_links": 1}
    assert markdown.split("\n\n") == ["# 1 Start", "A *b* [1](x)", "C", "![z](i.png)", "- one"]


def test_epub_round_trip():
    archive = epub.write_epub("Book", "en", [("One", 1, ["Hello **EPUB**.", "| a | b |\n|---|---|\n| 1 | 2 |"]), ("Empty", 2, [])], [("translator", "x")])
    markdown, title, counts = epub.read_epub(archive, "f")
    assert title == "Book" and "Hello **EPUB**." in markdown and "## Empty" in markdown and counts["spine_documents"] == 3
    assert epub.integrity(archive) == {"readable": 1, "image_references": 0, "broken_local_references": 0}
    assert epub.integrity(b"no archive")["readable"] == 0
    broken = epub.write_epub("B", "en", [("One", 1, ["[x](gone.xhtml) ![i](no.png)"])], [])
    assert epub.integrity(broken)["broken_local_references"] == 2


def test_epub_resources():
    import io
    import zipfile

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("OEBPS/img/diagram.png", b"p")
        z.writestr("OEBPS/a/same.png", b"1")
        z.writestr("OEBPS/b/same.png", b"2")
    r = epub.Resources(out.getvalue(), {"text/ch1.xhtml": "section-0001.xhtml"})
    text = r.rewrite("![d](../img/diagram.png) ![s](same.png) [go](ch1.xhtml#p) [out](https://x) [lost](none.xhtml)")
    assert text == "![d](images/0000-diagram.png) *[Image: s]* [go](section-0001.xhtml) [out](https://x) lost"


def test_docx_round_trip():
    file = office.write_docx([("heading", 1, "Head"), ("paragraph", 0, "**Important** text"), ("list", 0, "- a"), ("table", 0, "| a |\n|---|\n| 1 |")], "T")
    assert office.read_docx(file, "f")[:2] == ("# Head\n\n**Important** text\n\n- a\n\n| a |\n| --- |\n| 1 |\n", "T")


def test_many_files(spark, tmp_path):
    (tmp_path / "a.md").write_text("# A\n\nText")
    (tmp_path / "b.txt").write_text("Chapter 1\nText")
    (tmp_path / "c.xml").write_bytes(ARTICLE)
    (tmp_path / "d.pdf").write_bytes(b"%PDF")
    rows = {r.path[-4:]: r for r in documents.read_sources(spark, str(tmp_path)).collect()}
    assert rows["a.md"].title == "A" and rows[".txt" if ".txt" in rows else "b.txt"].markdown.startswith("# Chapter 1")
    assert json.loads(rows[".xml" if ".xml" in rows else "c.xml"].report)["figures"] == 1
    assert "unsupported" in rows[".pdf" if ".pdf" in rows else "d.pdf"].error


def test_strict_lines(spark, tmp_path):
    good = tmp_path / "issues.jsonl"
    good.write_text('{"id":"i1","kind":"k","message":"m","segment_id":null}\n\n{"id":"i2","kind":"k","message":"m","severity":"error"}\n')
    rows = jsonl.read_jsonl(spark, str(good), "issues").orderBy("_pos").collect()
    assert [(r.id, r.severity, r.status) for r in rows] == [("i1", "warning", "open"), ("i2", "error", "open")]
    assert jsonl.read_jsonl(spark, str(tmp_path / "none.jsonl"), "issues").isEmpty()
    bad = tmp_path / "bad.jsonl"
    bad.write_text('{"id":"i1","unknown":1}\n')
    with pytest.raises(ValueError):
        jsonl.read_jsonl(spark, str(bad), "issues")
    jsonl.write_jsonl(jsonl.read_jsonl(spark, str(good), "issues").drop("_pos"), str(tmp_path / "out"))
    assert jsonl.read_jsonl(spark, str(tmp_path / "out"), "issues").count() == 2


def test_glossary_files(spark, tmp_path):
    path = tmp_path / "g.csv"
    path.write_text('term,preferred_translation,allowed_variants,note,confidence\nUS,美国, 美 ||合众国 ,"a, b",\n,x,,,\n', encoding="utf-8")
    rows = drafts.read_glossary(spark, str(path)).collect()
    assert [(r.term, r.allowed_variants, r.note, r.confidence, r.status) for r in rows] == [("US", ["美", "合众国"], "a, b", 1.0, "approved")]
    drafts.write_glossary(drafts.read_glossary(spark, str(path)), str(tmp_path / "out"))
    assert drafts.read_glossary(spark, str(tmp_path / "out")).collect() == rows


def test_migration(spark):
    old = spark.createDataFrame([("seg", "t")], "id string, text string")
    row = schema.migrate(old, "segments").first()
    assert (row.id, row.kind, row.raw, row.format_signature) == ("seg", "paragraph", "", [])
