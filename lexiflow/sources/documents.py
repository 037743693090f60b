"""Source files of any supported kind to Markdown, many at once."""

from __future__ import annotations

import json
import os
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from . import epub, jats, office

KINDS = {"md": "markdown", "markdown": "markdown", "txt": "text", "docx": "docx", "epub": "epub", "xml": "jats", "jats": "jats"}
IMPORTED = StructType([StructField(n, StringType()) for n in ("markdown", "title", "source_format", "report", "error")])
_PART = re.compile(r"(?im)^((?:chapter|part)\s+.+)$")


def read_source(path: str, content: bytes) -> tuple[str, str, str, dict]:
    """(markdown, title, source_format, report) of one file; ValueError for other kinds or broken files."""
    stem, suffix = os.path.splitext(os.path.basename(path))
    kind = KINDS.get(suffix.lower().lstrip("."))
    if kind is None:
        raise ValueError(f"unsupported source format: {suffix}")
    if kind in ("markdown", "text"):
        text = content.decode("utf-8-sig")
        text = _PART.sub(r"# \1", text) if kind == "text" else text
        heading = re.search(r"(?m)^#\s+(.+)$", text)
        return text, heading[1].strip() if heading else stem, kind, {}
    if kind == "jats":
        article = jats.read_article(content, stem)
        return "\n\n".join(article.blocks).strip() + "\n", article.title, kind, article.counts | {"warnings": article.warnings}
    return *(x := (office.read_docx if kind == "docx" else epub.read_epub)(content, stem))[:2], kind, x[2]


@F.pandas_udf(IMPORTED)
def _imported(paths: pd.Series, contents: pd.Series) -> pd.DataFrame:
    rows = []
    for path, content in zip(paths, contents):
        try:
            markdown, title, kind, report = read_source(path, bytes(content or b""))
            rows.append((markdown, title, kind, json.dumps({"source_format": kind} | report, sort_keys=True), None))
        except Exception as e:  # noqa: BLE001  a broken file is a row with its error, not a lost job
            rows.append((None, None, None, None, f"{type(e).__name__}: {e}"))
    return pd.DataFrame(rows, columns=IMPORTED.fieldNames())


def imported(path: Column, content: Column) -> Column:
    return _imported(path, content)


def read_sources(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """path, sha256, markdown, title, source_format, report (JSON) and error (null if read) of files."""
    files = spark.read.format("binaryFile").load(paths)
    rows = files.select("path", F.sha2("content", 256).alias("sha256"), imported(F.col("path"), F.col("content")).alias("r"))
    return rows.select("path", "sha256", "r.*")
