"""Top-level Markdown blocks with their exact source lines."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from . import text as T

BLOCK = StructType([StructField("kind", StringType()), StructField("raw", StringType()), StructField("level", IntegerType()), StructField("source_locator", StringType())])

FENCE = re.compile(r" {0,3}(`{3,}(?=[^`]*$)|~{3,})")
HEADING = re.compile(r" {0,3}(#{1,6})(?:[ \t]|$)")
RULE = re.compile(r" {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
ITEM = re.compile(r"( {0,3})([-+*]|\d{1,9}[.)])( +|\t|$)")
QUOTE = re.compile(r" {0,3}>")
NOTE = re.compile(r"\[\^[^\]]+\]:")
HTML = re.compile(r" {0,3}<(?:!--|[!?]|/?[A-Za-z][A-Za-z0-9-]*(?:[\s/>]|$))")
UNDERLINE = re.compile(r" {0,3}(=+|-+)[ \t]*$")
DELIMITERS = re.compile(r" {0,3}\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")


def _cells(line: str) -> int:
    return len(re.split(r"(?<!\\)\|", line.strip().removeprefix("|").removesuffix("|")))


class Scanner:
    """One block at a time; each take_* returns the line after its block."""

    def __init__(self, lines: list[str]):
        self.lines = lines

    def blank(self, i: int) -> bool:
        return i >= len(self.lines) or not self.lines[i].strip()

    def interrupts(self, i: int) -> bool:
        """Whether line i ends a paragraph above it."""
        line = self.lines[i]
        item = ITEM.match(line)
        listed = item and line[item.end() :].strip() and (not item[2][0].isdigit() or item[2][:-1] == "1")
        return bool(self.blank(i) or HEADING.match(line) or FENCE.match(line) or RULE.match(line) or QUOTE.match(line) or listed or HTML.match(line) or NOTE.match(line))

    def blocks(self):
        i = 0
        while i < len(self.lines):
            if self.blank(i):
                i += 1
                continue
            kind, level, end = self.take(i)
            yield kind, level, i, end
            i = end

    def take(self, i: int) -> tuple[str, int, int]:
        line = self.lines[i]
        if line.startswith(("    ", "\t")):
            return "code", 0, self.indented(i)
        if m := HEADING.match(line):
            return "heading", len(m[1]), i + 1
        if m := FENCE.match(line):
            return "code", 0, self.fenced(i, m[1])
        if RULE.match(line):
            return "thematic_break", 0, i + 1
        if QUOTE.match(line):
            return "blockquote", 0, self.quoted(i)
        if m := ITEM.match(line):
            return "list", 0, self.listed(i, m)
        if NOTE.match(line):
            return "footnote", 0, self.noted(i)
        if HTML.match(line):
            return "html", 0, self.until(i, self.blank)
        if "|" in line and i + 1 < len(self.lines) and DELIMITERS.match(self.lines[i + 1]) and _cells(line) == _cells(self.lines[i + 1]):
            return "table", 0, self.until(i + 2, lambda k: self.blank(k) or self.interrupts(k))
        return self.paragraph(i)

    def until(self, i: int, stop) -> int:
        while i < len(self.lines) and not stop(i):
            i += 1
        return i

    def fenced(self, i: int, fence: str) -> int:
        close = re.compile(rf" {{0,3}}{re.escape(fence[0])}{{{len(fence)},}}[ \t]*$")
        for k in range(i + 1, len(self.lines)):
            if close.match(self.lines[k]):
                return k + 1
        return len(self.lines)

    def indented(self, i: int) -> int:
        end = i + 1
        for k in range(i + 1, len(self.lines)):
            if self.lines[k].startswith(("    ", "\t")):
                end = k + 1
            elif not self.blank(k):
                break
        return end

    def quoted(self, i: int) -> int:
        i += 1
        while i < len(self.lines) and (QUOTE.match(self.lines[i]) or not self.interrupts(i)):
            i += 1
        return i

    def noted(self, i: int) -> int:
        end = self.until(i + 1, self.interrupts)
        while end < len(self.lines):
            k = self.until(end, lambda x: not self.blank(x))
            if k >= len(self.lines) or not self.lines[k].startswith(("    ", "\t")):
                break
            end = self.until(k, self.blank)
        return end

    def listed(self, i: int, first: re.Match) -> int:
        kind = first[2][-1]
        inside, end, k = first.end(), i + 1, i + 1
        while k < len(self.lines):
            line = self.lines[k]
            if self.blank(k):
                k += 1
                continue
            item, indent = ITEM.match(line), len(line) - len(line.lstrip(" "))
            after_blank = k > end
            if item and item[2][-1] == kind and not RULE.match(line):
                inside = item.end()
            elif indent < min(inside, 4) and (after_blank or self.interrupts(k)):
                break
            k += 1
            end = k
        return end

    def paragraph(self, i: int) -> tuple[str, int, int]:
        k = i + 1
        while k < len(self.lines):
            if (m := UNDERLINE.match(self.lines[k])) and not self.blank(k):
                return "heading", 1 if m[1][0] == "=" else 2, k + 1
            if self.interrupts(k):
                break
            k += 1
        return "paragraph", 0, k


def parse_blocks(source: str) -> list[tuple[str, str, int, str]]:
    """(kind, raw, level, lines:a-b) of each top-level block, in order."""
    lines = source.splitlines()
    out = []
    for kind, level, start, end in Scanner(lines).blocks():
        while end > start and not lines[end - 1].strip():
            end -= 1
        raw = "\n".join(lines[start:end]).strip("\n")
        if raw.strip():
            out.append((kind, raw, level, f"lines:{start + 1}-{end}"))
    return out


@F.pandas_udf(ArrayType(BLOCK))
def _parse(sources: pd.Series) -> pd.Series:
    return sources.map(lambda s: None if s is None else [dict(zip(BLOCK.fieldNames(), b)) for b in parse_blocks(s)])


def blocks(markdown: Column) -> Column:
    """Array of BLOCK structs; one pass in Python, the rest of a block is native (see described)."""
    return _parse(markdown)


def described(block: Column) -> list[Column]:
    """kind (with subheadings), raw, text, level, title, source_locator and format_signature of a BLOCK."""
    raw, heading = block["raw"], block["kind"] == "heading"
    text = T.visible_text(raw, heading)
    text = F.when(heading, T.normalize(F.regexp_replace(text, r"\s*(?:\s#+|\n[=-]+|\s[=]{3,}|\s-{3,})\s*$", ""))).otherwise(text)
    kind = F.when((block["kind"] == "paragraph") & T.is_setoff_subheading(raw, text), F.lit("subheading")).otherwise(block["kind"])
    title = F.when(heading, text).otherwise(F.lit(""))
    return [kind.alias("kind"), raw.alias("raw"), text.alias("text"), block["level"].alias("level"), title.alias("title"), block["source_locator"].alias("source_locator"), T.format_signature(raw).alias("format_signature")]
