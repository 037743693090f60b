"""Whole editions against plain Python: every line with content, subheadings included."""

import hashlib
import os
import re

import __spark_entry__ as entry
import pytest

SF = "/root/testdata/sf0.001"


def is_subheading(raw):
    words = raw.split()
    if not 2 <= len(words) <= 8 or len(raw.strip()) > 80 or re.search(r"[.!?;:]$|[\[\]*_`>#|]", raw.strip()):
        return False
    return all(w[:1].isupper() or w.lower() in {"of", "the", "and", "in", "to"} for w in words)


def editions(rows, content):
    out = {}
    for i, text in rows:
        lines = [x for x in (text or "").split("\n") if x.strip()]
        blocks = []
        for raw in lines:
            block = ("### " if is_subheading(raw) else "") + raw.replace("e", "E")
            blocks.append(block if content == "translated" else f"> {raw}\n\n{block}\n\n---")
        if blocks:
            title = f"## Teil {i}" if content == "translated" else f"## Section {i} / Teil {i}"
            whole = "\n\n".join([title, *blocks]) + "\n"
            out[i] = hashlib.sha256(whole.encode()).hexdigest(), len(whole)
    return out


@pytest.mark.parametrize("name, content", [("render_markdown_whole", "translated"), ("bilingual_render_whole", "bilingual")])
@pytest.mark.parametrize("extra", [False, True])
def test_every_line_is_rendered(spark, tmp_path, name, content, extra):
    if extra:
        folder = str(tmp_path)
        texts = ["The House of Cards\n" + "a long line that is no heading " * 4 + "\nshort one.", "Only Short Lines\n\nand another", "", "The End."]
        spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    elif os.path.isdir(SF):
        folder = SF
    else:
        pytest.skip("no test tables")
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    want = editions(rows, content)
    if extra:
        assert len(want) == 3 and is_subheading("The House of Cards")
    got = {r.section_id: (r.markdown_sha256, r.chars) for r in entry.queries()[name](spark, folder).collect()}
    assert got == want
