"""DOCX to Markdown, and back, on the plain file format."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree
from xml.sax.saxutils import escape

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def _on(properties, tag: str) -> bool:
    node = properties.find(f"{W}{tag}") if properties is not None else None
    return node is not None and node.get(f"{W}val", "true") not in ("0", "false", "none")


def _runs(paragraph) -> str:
    out = []
    for run in paragraph.iter(f"{W}r"):
        words = "".join({f"{W}t": x.text or "", f"{W}tab": "\t", f"{W}br": "\n"}.get(x.tag, "") for x in run)
        if not words.strip():
            out.append(words)
            continue
        marks = run.find(f"{W}rPr")
        mark = "**" * _on(marks, "b") + "*" * _on(marks, "i")
        out.append(f"{mark}{words}{mark[::-1]}")
    return "".join(out)


def read_docx(content: bytes, fallback_title: str) -> tuple[str, str, dict[str, int]]:
    """(markdown, title, counts): headings by style, lists, bold and italic runs, tables."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{W}body")
        core = z.read("docProps/core.xml").decode() if "docProps/core.xml" in z.namelist() else ""
        styles = ElementTree.fromstring(z.read("word/styles.xml")) if "word/styles.xml" in z.namelist() else None
    names = {s.get(f"{W}styleId"): s.find(f"{W}name").get(f"{W}val", "") for s in (styles.iter(f"{W}style") if styles is not None else []) if s.find(f"{W}name") is not None}
    title = re.search(r"<dc:title>([^<]+)</dc:title>", core)
    blocks, counts = [], {"paragraphs": 0, "headings": 0, "tables": 0}
    for node in body if body is not None else []:
        if node.tag == f"{W}p":
            words = _runs(node).strip()
            if not words:
                continue
            style = node.find(f"{W}pPr/{W}pStyle")
            key = style.get(f"{W}val", "") if style is not None else ""
            kind = (names.get(key) or key).lower()
            if m := re.match(r"heading ?(\d+)", kind):
                blocks.append("#" * min(6, int(m[1])) + " " + words)
                counts["headings"] += 1
            elif kind == "title":
                blocks.append("# " + words)
                counts["headings"] += 1
            elif kind.startswith(("list bullet", "listbullet")):
                blocks.append("- " + words)
            elif kind.startswith(("list number", "listnumber")):
                blocks.append("1. " + words)
            else:
                blocks.append(words)
                counts["paragraphs"] += 1
        elif node.tag == f"{W}tbl":
            rows = [[" ".join(" ".join(_runs(p) for p in cell.iter(f"{W}p")).split()) for cell in row.findall(f"{W}tc")] for row in node.findall(f"{W}tr")]
            if rows:
                lines = ["| " + " | ".join(r) + " |" for r in rows]
                lines.insert(1, "| " + " | ".join("---" for _ in rows[0]) + " |")
                blocks.append("\n".join(lines))
                counts["tables"] += 1
    return "\n\n".join(blocks) + "\n", (title[1] if title else fallback_title), counts


def write_docx(blocks: list[tuple[str, int, str]], title: str) -> bytes:
    """A document from (kind, level, text): headings, paragraphs, lists and pipe tables; academic reflow."""

    def runs(text: str) -> str:
        out = []
        for part in re.split(r"(\*\*[^*]+\*\*|\*[^*]+\*)", text):
            bold, italic = part.startswith("**") and len(part) > 4, part.startswith("*") and not part.startswith("**") and len(part) > 2
            words = part[2:-2] if bold else part[1:-1] if italic else part
            if words:
                marks = "<w:rPr>" + "<w:b/>" * bold + "<w:i/>" * italic + "</w:rPr>" if bold or italic else ""
                out.append(f'<w:r>{marks}<w:t xml:space="preserve">{escape(words)}</w:t></w:r>')
        return "".join(out)

    def paragraph(text: str, style: str = "") -> str:
        p = f'<w:pPr><w:pStyle w:val="{style}"/></w:pPr>' if style else ""
        return f"<w:p>{p}{runs(text)}</w:p>"

    body = []
    for kind, level, text in blocks:
        if kind == "heading":
            body.append(paragraph(text, f"Heading{min(6, max(1, level))}"))
        elif kind == "table":
            rows = [[c.strip() for c in r.strip().strip("|").split("|")] for r in text.strip().split("\n")]
            rows = [r for r in rows if not all(re.fullmatch(r":?-+:?", c) for c in r)]
            body.append("<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc>{paragraph(c)}</w:tc>" for c in r) + "</w:tr>" for r in rows) + "</w:tbl>")
        elif kind == "list":
            body += [paragraph(re.sub(r"^\s*(?:[-+*]|\d+[.)])\s+", "", x), "ListBullet") for x in text.split("\n") if x.strip()]
        else:
            body.append(paragraph(text))
    space = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    styles = "".join(f'<w:style w:type="paragraph" w:styleId="Heading{k}"><w:name w:val="heading {k}"/></w:style>' for k in range(1, 7)) + '<w:style w:type="paragraph" w:styleId="ListBullet"><w:name w:val="List Bullet"/></w:style>'
    files = {
        "[Content_Types].xml": '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/><Override PartName="/word/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.styles+xml"/><Override PartName="/docProps/core.xml" ContentType="application/vnd.openxmlformats-package.core-properties+xml"/></Types>',
        "_rels/.rels": '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/><Relationship Id="r2" Type="http://schemas.openxmlformats.org/package/2006/relationships/metadata/core-properties" Target="docProps/core.xml"/></Relationships>',
        "word/_rels/document.xml.rels": '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/styles" Target="styles.xml"/></Relationships>',
        "word/styles.xml": f'<?xml version="1.0" encoding="UTF-8"?><w:styles {space}>{styles}</w:styles>',
        "docProps/core.xml": f'<?xml version="1.0" encoding="UTF-8"?><cp:coreProperties xmlns:cp="http://schemas.openxmlformats.org/package/2006/metadata/core-properties" xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>{escape(title)}</dc:title></cp:coreProperties>',
        "word/document.xml": f'<?xml version="1.0" encoding="UTF-8"?><w:document {space}><w:body>{"".join(body)}<w:sectPr/></w:body></w:document>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, content in files.items():
            z.writestr(name, content)
    return out.getvalue()
