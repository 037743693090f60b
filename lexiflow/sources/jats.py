"""Article XML (JATS) to Markdown, with counts of what it held."""

from __future__ import annotations

import re
from xml.etree import ElementTree

COUNTS = ["paragraphs", "headings", "figures", "tables", "equations", "citations", "footnotes", "references"]


def name(node) -> str:
    return node.tag.rpartition("}")[2] if isinstance(node.tag, str) else ""


def text(node) -> str:
    return "" if node is None else " ".join("".join(node.itertext()).split())


def below(node, *names) -> list:
    return [x for x in node.iter() if x is not node and name(x) in names]


def children(node, *names) -> list:
    return [x for x in node if name(x) in names]


def first(nodes: list):
    return nodes[0] if nodes else None


class Article:
    """Walks an article once; blocks and counts grow as it goes."""

    def __init__(self, root, fallback_title: str):
        self.blocks: list[str] = []
        self.counts = dict.fromkeys(COUNTS, 0)
        self.warnings: list[str] = []
        self.title = text(first(below(root, "article-title"))) or fallback_title
        self.blocks.append(f"# {self.title}")
        abstract, body = first(below(root, "abstract")), first(below(root, "body"))
        if abstract is not None:
            self.blocks.append("## Abstract")
            for p in children(abstract, "p"):
                self.paragraph(p)
        if body is None:
            self.warnings.append("no body")
        else:
            self.walk(body, 1)
        self.notes(first(below(root, "fn-group")))
        self.references(first(below(root, "ref-list")))
        self.warnings += ["figures need their graphics"] * bool(self.counts["figures"]) + ["equations need a renderer"] * bool(self.counts["equations"])

    def walk(self, node, level: int) -> None:
        for child in node:
            kind = name(child)
            if kind == "sec":
                if title := text(first(children(child, "title"))):
                    self.blocks.append("#" * min(level + 1, 6) + " " + title)
                    self.counts["headings"] += 1
                self.walk(child, level + 1)
            elif kind == "p":
                self.paragraph(child)
            elif kind == "fig":
                self.figure(child)
            elif kind == "table-wrap":
                self.table(child)
            elif kind in ("disp-formula", "formula") and (formula := text(child)):
                self.blocks.append(f"```math\n{formula}\n```")
                self.counts["equations"] += 1
            elif kind in ("list", "def-list"):
                self.blocks += [f"- {t}" for t in map(text, below(child, "list-item")) if t]

    def paragraph(self, p) -> None:
        if words := text(p):
            self.blocks.append(words)
            self.counts["paragraphs"] += 1
            self.counts["citations"] += len(below(p, "xref"))

    def caption(self, node, label: str) -> str:
        return f"> **{label}.** {text(first(children(node, 'caption')))}".rstrip()

    def figure(self, node) -> None:
        label = text(first(children(node, "label"))) or "Figure"
        graphic = first(below(node, "graphic"))
        target = next((v for k, v in (graphic.attrib if graphic is not None else {}).items() if k.rpartition("}")[2] == "href"), "")
        asset = target.rpartition("/")[2].rpartition("journal.")[2] if target else "missing"
        self.blocks += [f"![{label}](assets/{asset}.png)", self.caption(node, label)]
        self.counts["figures"] += 1

    def table(self, node) -> None:
        self.blocks.append(self.caption(node, text(first(children(node, "label"))) or "Table"))
        self.counts["tables"] += 1
        grid = [[text(c) for c in children(row, "td", "th")] for row in below(node, "tr")]
        if grid := [row for row in grid if row]:
            width = max(map(len, grid))
            rows = [row + [""] * (width - len(row)) for row in grid]
            rows.insert(1, ["---"] * width)
            self.blocks.append("\n".join("| " + " | ".join(row) + " |" for row in rows))

    def notes(self, group) -> None:
        if found := [t for t in map(text, children(group, "fn") if group is not None else []) if t]:
            self.blocks.append("## Footnotes")
            self.blocks += [f"[^fn-{k}]: {t}" for k, t in enumerate(found, 1)]
            self.counts["footnotes"] = len(found)

    def references(self, group) -> None:
        if found := [t for t in map(text, children(group, "ref") if group is not None else []) if t]:
            self.blocks.append("## References")
            self.blocks += [f"{k}. {t}" for k, t in enumerate(found, 1)]
            self.counts["references"] = len(found)


def read_article(content: bytes, fallback_title: str) -> Article:
    try:
        root = ElementTree.fromstring(content)
    except ElementTree.ParseError as e:
        raise ValueError(f"invalid XML: {e}") from e
    if name(root) != "article":
        raise ValueError("not a JATS article")
    return Article(root, fallback_title)


def doi(content: bytes) -> str:
    """The article's DOI, empty if it has none."""
    root = ElementTree.fromstring(content)
    return next((text(x) for x in below(root, "article-id") if x.get("pub-id-type") == "doi"), "")


def graphics(content: bytes) -> list[tuple[str, str]]:
    """(href, asset path) of the figures' graphics: what a fetcher would get."""
    root = ElementTree.fromstring(content)
    out = []
    for fig in below(root, "fig"):
        for g in below(fig, "graphic"):
            target = next((v for k, v in g.attrib.items() if k.rpartition("}")[2] == "href"), "")
            if target:
                out.append((target, f"assets/{re.sub(r'^.*journal[.]', '', target.rpartition('/')[2])}.png"))
    return out
