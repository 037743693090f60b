"""HTML (pages, EPUB chapters) to Markdown blocks, with counts of what was there."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
BLOCKS = (*HEADINGS, "p", "blockquote", "li")
#: Tags whose start ends an open paragraph.
ENDS_PARAGRAPH = (*BLOCKS, "article", "aside", "div", "dl", "fieldset", "footer", "form", "header", "hr", "main", "nav", "ol", "pre", "section", "table", "ul")
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
MARKS = {"em": "*", "i": "*", "strong": "**", "b": "**"}
COUNTS = ["paragraphs", "headings", "images", "links", "footnote_links"]
RESULT = StructType([StructField("markdown", StringType()), StructField("title", StringType()), *[StructField(c, LongType()) for c in COUNTS]])


class Reader(HTMLParser):
    """Collects blocks as their tags close; nested blocks give a block each, as they open."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[dict] = []
        self.blocks: list[dict] = []
        self.counts = dict.fromkeys(COUNTS, 0)
        self.title, self.hidden, self.in_title = "", 0, False

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        classes = set(a.get("class", "").split())
        if tag in ("script", "style", "head"):
            self.hidden += tag != "head"
        if tag == "title":
            self.in_title = True
        self.counts["paragraphs"] += tag == "p"
        self.counts["headings"] += tag in HEADINGS
        self.counts["images"] += tag == "img"
        self.counts["links"] += tag == "a"
        self.counts["footnote_links"] += tag == "a" and ("noteref" in a.get("epub:type", "").split() or a.get("role") == "doc-noteref" or "footnoteup" in classes)
        if tag in ENDS_PARAGRAPH:
            self._close("p")
        if tag == "img":
            self.blocks.append({"tag": "img", "text": f"![{a.get('alt', '').strip()}]({a.get('src', '')})", "plain": "", "classes": set()})
            return
        if tag == "br":
            self._text("\n", " ")
        if tag in VOID:
            return
        node = {"tag": tag, "href": a.get("href", ""), "mark": MARKS.get(tag, ""), "text": "", "plain": "", "classes": classes}
        if tag in BLOCKS:
            self.blocks.append(node)
        self.stack.append(node)

    def handle_endtag(self, tag):
        if tag == "title":
            self.in_title = False
        if tag in ("script", "style"):
            self.hidden = max(0, self.hidden - 1)
        self._close(tag)

    def _close(self, tag):
        if not any(n["tag"] == tag for n in self.stack):
            return
        while self.stack:
            node = self.stack.pop()
            inner = node["text"].strip() if node["mark"] or node["tag"] == "a" else node["text"]
            if node["tag"] not in BLOCKS:
                if node["mark"] and inner:
                    inner = f"{node['mark']}{inner}{node['mark']}"
                if node["tag"] == "a" and node["href"] and inner:
                    inner = f"[{inner}]({node['href']})"
            if self.stack:
                self.stack[-1]["text"] += inner
                self.stack[-1]["plain"] += " " + node["plain"]
            if node["tag"] == tag:
                return

    def _text(self, text, plain):
        if self.stack:
            self.stack[-1]["text"] += text
            self.stack[-1]["plain"] += plain

    def handle_data(self, data):
        if self.in_title:
            self.title += data
        elif not self.hidden:
            self._text(data, data)

    def markdown(self) -> str:
        while self.stack:
            self._close(self.stack[-1]["tag"])
        out, number = [], ""
        for b in self.blocks:
            plain = " ".join(b["plain"].split())
            if b["tag"] == "img":
                out.append(b["text"])
            elif not plain:
                continue
            elif "cn" in b["classes"]:
                number = plain
            elif "ct" in b["classes"]:
                out.append("# " + " ".join(filter(None, (number, plain))))
                number = ""
            elif b["tag"] in HEADINGS:
                out.append("#" * int(b["tag"][1]) + " " + plain)
            elif b["tag"] == "blockquote":
                out.append("> " + plain)
            elif b["tag"] == "li":
                out.append("- " + plain)
            else:
                out.append("\n".join(" ".join(x.split()) for x in b["text"].strip().split("\n")))
        return "\n\n".join(out)


def html_to_markdown(source: str) -> tuple[str, str, dict[str, int]]:
    reader = Reader()
    reader.feed(source)
    reader.close()
    return reader.markdown(), " ".join(reader.title.split()), reader.counts


@F.pandas_udf(RESULT)
def _converted(sources: pd.Series) -> pd.DataFrame:
    rows = []
    for s in sources:
        markdown, title, counts = html_to_markdown(s or "")
        rows.append((markdown, title, *counts.values()))
    return pd.DataFrame(rows, columns=RESULT.fieldNames())


def converted(html: Column) -> Column:
    return _converted(html)
