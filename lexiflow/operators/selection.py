"""Selections, set guards and merges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def select_segments(segments: DataFrame, segment_ids=(), section_ids=(), term: str = "") -> DataFrame:
    """Segments named, of sections named or with the term in any case; all if nothing is asked.

    Raises ValueError for ids that don't exist.
    """
    segment_ids, section_ids = list(segment_ids), list(section_ids)
    if not segment_ids and not section_ids and not term:
        return segments
    require_known(segments, "id", segment_ids, "segment")
    require_known(segments, "section_id", section_ids, "section")
    asked = F.col("id").isin(segment_ids) | F.col("section_id").isin(section_ids)
    if term:
        asked = asked | F.contains(F.lower("text"), F.lit(term.lower()))
    return segments.where(asked)


def require_known(table: DataFrame, column: str, ids: list, what: str) -> None:
    if ids:
        found = {r[0] for r in table.where(F.col(column).isin(ids)).select(column).distinct().collect()}
        if missing := sorted(set(ids) - found):
            raise ValueError(f"unknown {what}: {', '.join(map(str, missing))}")


def pending(items: DataFrame, done: DataFrame, key: str, again: bool = False) -> DataFrame:
    """Items not done yet; all if asked for again."""
    return items if again else items.join(done.select(key), key, "left_anti")


def evidence_violations(rows: DataFrame, row_id: str, evidence: str, known: DataFrame, known_id: str) -> DataFrame:
    """(row_id, evidence_id): cited ids that don't exist."""
    cited = rows.select(F.col(row_id), F.explode(evidence).alias("evidence_id"))
    return cited.join(known.select(F.col(known_id).alias("evidence_id")), "evidence_id", "left_anti").select(row_id, "evidence_id")


def append_new(existing: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """The rows of new that aren't there, each once."""
    return new.dropDuplicates([key]).join(existing.select(key), key, "left_anti").select(*new.columns)


def merge_without_overwrite(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Existing rows, and new ones whose key (in any case) isn't among them."""
    known = existing.select(T.lower(key).alias("_key")).distinct()
    fresh = new.withColumn("_key", T.lower(key)).join(known, "_key", "left_anti").drop("_key")
    return existing.unionByName(fresh.select(*existing.columns))


def same_sets(left: DataFrame, right: DataFrame, column: str) -> bool:
    a, b = left.select(column).distinct(), right.select(column).distinct()
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def union_last(parts: list[DataFrame], key: str) -> DataFrame:
    """The rows of all parts, each key once, as the last part that has it gives it; part counts from 0.

    Of rows of one key in one part any counts.
    """
    numbered = [p.withColumn("part", F.lit(k)) for k, p in enumerate(parts)]
    together = reduce(DataFrame.unionByName, numbered)
    rest = [c for c in together.columns if c not in (key, "part")]
    return together.groupBy(key).agg(F.max_by(F.struct(*rest), "part").alias("_r"), F.max("part").alias("part")).select(key, "_r.*", "part")
