"""Reader typography: quotation marks of the target language, outside code."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Letters of Latin words; marks and what readers get for them; fixed values.
LATIN = "A-Za-zÀ-ÖØ-öø-ÿ"
CORNERS = str.maketrans("「」『』", "“”‘’")
SINGLE = {"‘": "“", "’": "”"}
_CODE = re.compile(r"(`[^`\n]*`)")
#: A closing mark within a Latin word, or between two, stands for an apostrophe.
_APOSTROPHE = re.compile(rf"(?<=[{LATIN}])[”’](?=\s*[{LATIN}])")
#: A quotation in double marks up to its end, or a single mark outside of one.
_QUOTED = re.compile("[“「][^”」]*|[‘’]")


def normalize_quotes(text: str) -> str:
    """Outermost quotations in double marks, those within in single ones."""
    text = _APOSTROPHE.sub("'", text)
    return _QUOTED.sub(lambda m: SINGLE.get(m[0], m[0]), text).translate(CORNERS)


def reader_typography(text: str) -> str:
    """normalize_quotes outside of code spans."""
    return "".join(part if k % 2 else normalize_quotes(part) for k, part in enumerate(_CODE.split(text)))


@F.pandas_udf(StringType())
def typography(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else reader_typography(t))


_NOTE_LINK = re.compile(r"(?<!!)\[(\d+)\]\(([^)]+)\)")
_NOTE = re.compile(r"(?<!!)\[(\d+)\](?!\()")


def restore_numeric_links(source: str, output: str) -> str:
    """Targets of the source's numeric references, put back where the output has kept their numbers in the same order; else the output as it is."""
    links = _NOTE_LINK.findall(source)
    if not links or [label for label, _ in links] != _NOTE.findall(output)[: len(links)]:
        return output
    targets = iter(links)
    return _NOTE.sub(lambda m: m[0] + "({})".format(next(targets)[1]), output, count=len(links))


@F.pandas_udf(StringType())
def restored_links(sources: pd.Series, outputs: pd.Series) -> pd.Series:
    return pd.Series([None if o is None else restore_numeric_links(s or "", o) for s, o in zip(sources, outputs)])
