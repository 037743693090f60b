"""Strict ingestion of drafts, resolutions, terminology candidates and glossaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import stable_id
from ..operators.knowledge import AUTHORITY
from ..schema import schema_of

CANDIDATE_FIELDS = ["authority", "candidate_translation", "confidence", "evidence_segment_ids", "source_excerpt", "source_title", "source_url", "term"]


def parse(lines: DataFrame, fields: dict[str, str]) -> DataFrame:
    """Lines (value) as records with exactly these fields; a line with others has `_bad` true."""
    keys = F.array_sort(F.coalesce(F.json_object_keys("value"), F.array().cast("array<string>")))
    exact = keys == F.array(*map(F.lit, sorted(fields)))
    schema = ", ".join(f"{k} {v}" for k, v in fields.items())
    return lines.where(F.trim("value") != "").select(F.from_json("value", schema).alias("r"), (~exact).alias("_bad")).select("r.*", "_bad")


def violations(rows: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(key, reason) of rows that break a rule, a row a broken rule."""
    reasons = F.array_compact(F.array(*[F.when(broken, F.lit(reason)) for reason, broken in rules.items()]))
    return rows.select(F.col(key).alias("key"), F.explode(reasons).alias("reason"))


def draft_violations(rows: DataFrame, key: str, text: str, known: DataFrame, known_id: str = "id", one_line: bool = False) -> DataFrame:
    """Unknown and repeated ids, blank texts and wrong fields of a draft."""
    blank = F.trim(F.coalesce(text, F.lit(""))) == ""
    rules = {"wrong fields": F.col("_bad"), "blank text": blank}
    if one_line:
        rules["more than one line"] = F.contains(F.coalesce(text, F.lit("")), F.lit("\n"))
    parts = [
        violations(rows, key, rules),
        rows.join(known.select(F.col(known_id).alias(key)), key, "left_anti").select(F.col(key).alias("key"), F.lit("unknown id").alias("reason")),
        rows.groupBy(key).count().where("count > 1").select(F.col(key).alias("key"), F.lit("repeated id").alias("reason")),
    ]
    return reduce(DataFrame.unionByName, parts)


def resolution_violations(rows: DataFrame, issues: DataFrame, active: DataFrame) -> DataFrame:
    """Resolutions must be of a current strict error, of the current record, once."""
    key = F.concat_ws("/", "segment_id", "issue_id").alias("key")
    errors = issues.where("severity = 'error'").select("segment_id", F.col("id").alias("issue_id"))
    current = active.select("segment_id", F.col("id").alias("translation_record_id"))
    blank = (F.trim(F.coalesce("rationale", F.lit(""))) == "") | (F.trim(F.coalesce("evidence", F.lit(""))) == "")
    parts = [
        rows.where("_bad").select(key, F.lit("wrong fields").alias("reason")),
        rows.where(blank).select(key, F.lit("blank text").alias("reason")),
        rows.join(errors, ["segment_id", "issue_id"], "left_anti").select(key, F.lit("no current error").alias("reason")),
        rows.join(current, ["segment_id", "translation_record_id"], "left_anti").select(key, F.lit("record is not current").alias("reason")),
        rows.groupBy("segment_id", "issue_id").count().where("count > 1").select(key, F.lit("repeated").alias("reason")),
    ]
    return reduce(DataFrame.unionByName, parts)


def candidate_violations(rows: DataFrame, segments: DataFrame) -> DataFrame:
    rules = {
        "wrong fields": F.col("_bad"),
        "blank text": (F.trim(F.coalesce("term", F.lit(""))) == "") | (F.trim(F.coalesce("candidate_translation", F.lit(""))) == ""),
        "unknown authority": ~F.coalesce(F.col("authority").isin(*AUTHORITY), F.lit(False)),
        "not an HTTPS address": ~F.coalesce(F.regexp_like("source_url", F.lit(r"^https://[^/\s]+")), F.lit(False)),
        "confidence out of range": ~F.coalesce(F.col("confidence").between(0, 1), F.lit(False)),
        "no evidence": F.size(F.coalesce("evidence_segment_ids", F.array().cast("array<string>"))) == 0,
    }
    cited = rows.select(F.col("term").alias("key"), F.explode("evidence_segment_ids").alias("id")).join(segments.select("id"), "id", "left_anti")
    return violations(rows, "term", rules).unionByName(cited.select("key", F.lit("unknown evidence").alias("reason")))


def candidate_ids(rows: DataFrame) -> DataFrame:
    """rows with id: the values in the order of their names, as Python prints them."""
    quoted = F.concat(F.lit("["), F.array_join(F.transform("evidence_segment_ids", lambda x: F.concat(F.lit("'"), x, F.lit("'"))), ", "), F.lit("]"))
    parts = [quoted if f == "evidence_segment_ids" else F.col(f) for f in CANDIDATE_FIELDS]
    return rows.withColumn("id", stable_id("termcand", *parts))


def read_glossary(spark: SparkSession, path: str) -> DataFrame:
    """A CSV glossary; arrays are joined by bars, blank parts dropped, a blank confidence is 1."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    items = lambda c: F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"\|"), lambda x: F.trim(x)), lambda x: x != "")
    columns = []
    for field in schema_of("glossary"):
        column = F.col(field.name) if field.name in raw.columns else F.lit(None).cast("string")
        if field.name in ("allowed_variants", "evidence_segment_ids"):
            column = items(column)
        elif field.name == "confidence":
            column = F.coalesce(F.nullif(F.trim(column), F.lit("")).cast("double"), F.lit(1.0))
        elif field.name == "status":
            column = F.coalesce(F.nullif(column, F.lit("")), F.lit("approved"))
        else:
            column = F.coalesce(column, F.lit(""))
        columns.append(column.alias(field.name))
    return raw.select(*columns).where(F.trim("term") != "")


def write_glossary(entries: DataFrame, path: str) -> None:
    flat = entries.select(*[F.array_join(f.name, "|").alias(f.name) if f.name in ("allowed_variants", "evidence_segment_ids") else F.col(f.name) for f in schema_of("glossary")])
    flat.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
