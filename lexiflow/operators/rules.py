"""Validation rules: each gives issues (kind, message, segment_id, severity).

`pairs` has a row a segment with a current translation: segment_id, text, raw,
adapter, translated_text.  prepared() computes what several rules need once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numerics
from ..functions import text as T
from ..functions.ids import python_list, stable_id
from . import phrases

PASSED_THROUGH = ("structural-passthrough", "bibliography-passthrough")


def issue(kind: str, severity: str | Column, message: str | Column) -> list[Column]:
    text = message if isinstance(message, Column) else F.lit(message)
    level = severity if isinstance(severity, Column) else F.lit(severity)
    return [stable_id("issue", kind, F.col("segment_id"), text).alias("id"), F.lit(kind).alias("kind"), text.alias("message"), F.col("segment_id"), level.alias("severity"), F.lit("open").alias("status")]


def prepared(pairs: DataFrame) -> DataFrame:
    """pairs with output (no mock prefix) and passed (kept as it is on purpose)."""
    return pairs.withColumn("output", T.without_mock(F.col("translated_text"))).withColumn("passed", F.coalesce(F.col("adapter").isin(*PASSED_THROUGH), F.lit(False)))


def missing_translation(segments: DataFrame, active: DataFrame) -> DataFrame:
    return segments.join(active, "segment_id", "left_anti").select(*issue("missing_translation", "error", "Segment has no completed translation"))


def orphan_translation(segments: DataFrame, active: DataFrame) -> DataFrame:
    return active.join(segments, "segment_id", "left_anti").select(*issue("orphan_translation", "error", "Translation refers to a missing segment"))


def format_mismatch(ready: DataFrame) -> DataFrame:
    marks = ready.withColumn("_a", T.format_signature(F.coalesce(F.nullif("raw", F.lit("")), "text"))).withColumn("_b", T.format_signature(F.col("output")))
    message = F.concat(F.lit("Expected format markers "), python_list(F.col("_a")), F.lit(", found "), python_list(F.col("_b")))
    return marks.where("_a <> _b").select(*issue("format_mismatch", "error", message))


def suspiciously_short(ready: DataFrame) -> DataFrame:
    least = F.greatest(F.lit(1), F.floor(F.length(T.strip(F.col("text"))) / 20))
    short = ready.where(~F.col("passed") & (F.length(T.strip(F.col("output"))) < least))
    return short.select(*issue("suspiciously_short", "warning", "Translation is unusually short relative to source"))


def numeric_differences(ready: DataFrame, mode: str = "relaxed") -> DataFrame:
    """ready with source_numbers, target_numbers, missing, extra and differs (an issue in this mode).

    A two-digit target decade takes the century of the one source decade that it
    can mean; a target decade covers the source's century.
    """
    if mode not in ("relaxed", "balanced", "strict"):
        raise ValueError("mode must be relaxed, balanced or strict")
    rows = ready.where(~F.col("passed")).withColumn("source_numbers", numerics.anchors(F.col("text"))).withColumn("target_numbers", numerics.anchors(T.plain_text(F.col("output"))))
    rows = rows.withColumn("_s", F.array_distinct(numerics.balanced(F.col("source_numbers")))).withColumn("_t", F.array_distinct(numerics.balanced(F.col("target_numbers"))))

    def decade(x: Column) -> Column:
        return F.regexp_extract(x, r"^decade:(\d+)$", 1)

    def meant(x: Column) -> Column:
        fits = F.filter("_s", lambda d: (decade(d) != "") & ((F.when(decade(d) != "", decade(d).cast("long")) % 100).cast("string") == x))
        bare = F.regexp_like(x, F.lit(r"^\d{2}$")) & ~F.array_contains(F.col("_s"), x) & (F.size(fits) == 1)
        return F.when(bare, F.get(fits, F.lit(0))).otherwise(x)

    rows = rows.withColumn("_t", F.transform("_t", meant))
    century = F.transform(F.filter("_t", lambda x: decade(x) != ""), lambda x: F.concat(F.lit("century:"), (F.floor(decade(x).cast("long") / 100) + 1).cast("string")))
    rows = rows.withColumn("_t", F.array_union("_t", F.array_intersect("_s", century)))
    missing = F.array_except("_s", "_t")
    if mode == "relaxed":
        missing = F.filter(missing, lambda x: ~F.regexp_like(x, F.lit(r"^0\d+$")))
    rows = rows.withColumn("missing", F.array_sort(missing)).withColumn("extra", F.array_sort(F.array_except("_t", "_s"))).drop("_s", "_t")
    wrong = F.size("missing") > 0
    return rows.withColumn("differs", wrong if mode == "relaxed" else wrong | (F.size("extra") > 0))


def numeric_anchor_mismatch(ready: DataFrame, mode: str = "relaxed") -> DataFrame:
    rows = numeric_differences(ready, mode).where("differs")
    severity = F.lit("error") if mode == "strict" else F.when(F.size("missing") > 0, F.lit("error")).otherwise(F.lit("warning"))
    parts = ["Source numeric anchors ", "source_numbers", " differ from translation ", "target_numbers", "; missing ", "missing", ", extra ", "extra"]
    message = F.concat(*[python_list(F.col(p)) if k % 2 else F.lit(p) for k, p in enumerate(parts)])
    return rows.select(*issue("numeric_anchor_mismatch", severity, message))


def _renderings(glossary: DataFrame) -> DataFrame:
    """Approved terms in lower case with all their renderings in lower case."""
    own = F.array_compact(F.transform(F.concat(F.array("preferred_translation"), "allowed_variants"), lambda x: F.when(x != "", F.lower(x))))
    return glossary.where("status = 'approved'").select(F.lower("term").alias("_term"), own.alias("_own")).groupBy("_term").agg(F.flatten(F.collect_list("_own")).alias("_own"))


def acronym_missing(ready: DataFrame, glossary: DataFrame) -> DataFrame:
    found = ready.where(~F.col("passed")).select("segment_id", "output", F.explode(T.acronyms(F.col("text"))).alias("acronym"))
    met = found.where(~F.contains("output", "acronym")).withColumn("_term", F.lower("acronym")).join(_renderings(glossary), "_term", "left")
    rendered = F.coalesce(F.exists("_own", lambda x: F.contains(F.lower("output"), x)), F.lit(False))
    message = F.concat(F.lit("Source acronym '"), "acronym", F.lit("' is absent from translation"))
    return met.where(~rendered).select(*issue("acronym_missing", "warning", message))


def term_occurrences(segments: DataFrame, terms: DataFrame, text: str = "text", term: str = "term", among: DataFrame | None = None) -> DataFrame:
    """segments x terms where the term occurs.

    Word-like terms meet segments on a token, phrases and terms of other
    characters on their rarest gram: equi-joins that any number of terms survives.
    """
    wordlike = F.regexp_like(term, F.lit("^[A-Za-z0-9_]+$"))
    tokens = segments.withColumn("_token", F.explode(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9_]+"), F.lit(0)))))
    words = tokens.join(terms.where(wordlike).withColumn("_token", F.lower(term)), "_token").drop("_token").where(T.contains_term(F.col(text), F.col(term)))
    return words.unionByName(phrases.containing(segments, terms.where(~wordlike), text, term, among=among))


def terminology_mismatch(ready: DataFrame, glossary: DataFrame, among: DataFrame | None = None) -> DataFrame:
    """among: any rows with the texts of all segments, if they are cheaper to read (see `phrases.containing`)."""
    terms = glossary.where("status = 'approved' AND preferred_translation <> ''").select("term", "preferred_translation", "allowed_variants")
    met = term_occurrences(ready.where(~F.col("passed")).select("segment_id", "text", T.lower("output").alias("output")), terms, among=among)
    wanted = F.concat(F.array("preferred_translation"), F.coalesce("allowed_variants", F.array().cast("array<string>")))
    absent = ~F.exists(wanted, lambda x: F.contains("output", T.lower(x)))
    message = F.concat(F.lit("Expected approved translation for term '"), "term", F.lit("'"))
    return met.where(absent).select(*issue("terminology_mismatch", "warning", message))


def repeated_source_inconsistent(ready: DataFrame) -> DataFrame:
    """Segments of one source text (in any case) with several translations; counted before they are joined back."""
    prose = ready.where(~F.col("passed") & ~T.is_image_only(F.col("raw"), F.col("text"))).withColumn("_key", F.sha2(F.lower("text").cast("binary"), 256))
    output = F.sha2(F.lower("output").cast("binary"), 256)
    several = prose.groupBy("_key").agg(F.min(output).alias("a"), F.max(output).alias("b")).where("a <> b")
    return prose.join(several, "_key", "left_semi").select(*issue("repeated_source_inconsistent", "warning", "Identical source text has inconsistent translations"))


def quality_issues(pairs: DataFrame, glossary: DataFrame, mode: str = "relaxed") -> DataFrame:
    """All rules on translated segments."""
    ready = prepared(pairs)
    parts = [format_mismatch(ready), suspiciously_short(ready), numeric_anchor_mismatch(ready, mode), acronym_missing(ready, glossary), terminology_mismatch(ready, glossary), repeated_source_inconsistent(ready)]
    return reduce(DataFrame.unionByName, parts)


def validate(segments: DataFrame, active: DataFrame, glossary: DataFrame, mode: str = "relaxed", resolutions: DataFrame | None = None) -> DataFrame:
    """Issues of all rules; those that an accepted resolution covers are resolved warnings."""
    pairs = segments.join(active.select("segment_id", "translated_text", "adapter"), "segment_id")
    found = missing_translation(segments, active).unionByName(orphan_translation(segments, active)).unionByName(quality_issues(pairs, glossary, mode))
    return found if resolutions is None else resolve(found, active, resolutions)


def resolve(issues: DataFrame, active: DataFrame, resolutions: DataFrame) -> DataFrame:
    """A resolution holds for one issue of the record that is current."""
    held = resolutions.join(active.select("segment_id", F.col("id").alias("translation_record_id")), ["segment_id", "translation_record_id"], "left_semi")
    held = held.select("segment_id", F.col("issue_id").alias("id"), F.lit(True).alias("_held")).distinct()
    met = issues.join(held, ["segment_id", "id"], "left")
    return met.withColumn("severity", F.when(F.col("_held"), F.lit("warning")).otherwise(F.col("severity"))).withColumn("status", F.when(F.col("_held"), F.lit("resolved")).otherwise(F.col("status"))).select(*issues.columns)


#: An image block of an article, and the messages, which are part of issue identities.
ASSET = r"^!\[[^\]]*\]\((assets/[^)]+)\)$"
ACADEMIC = {
    "academic_missing_import_report": "JATS import report is missing",
    "academic_figure_count_mismatch": "JATS report lists %d figures but normalized source has %d image blocks",
    "academic_table_count_mismatch": "JATS report lists %d tables but normalized source has %d table blocks",
    "academic_missing_figure_asset": "Missing fetched figure asset %s",
    "academic_figure_asset_changed": "Figure asset hash differs from manifest for %s",
}


def academic_issues(projects: DataFrame, segments: DataFrame, report: DataFrame, assets: DataFrame) -> DataFrame:
    """project and an issue for each figure or table that an article lacks, and for each image without the asset recorded for it.

    projects: project (those of articles); segments: project, segment_id, raw,
    kind; report: project, figures, tables; assets: project, path, sha256,
    found_sha256 (null: not there).  Of a project without a report that alone is said.
    """
    images = segments.withColumn("path", F.nullif(F.regexp_extract("raw", ASSET, 1), F.lit("")))
    seen = images.groupBy("project").agg(F.count("path").alias("_images"), F.count_if(F.col("kind") == "table").alias("_tables"))
    met = projects.join(report.withColumn("_told", F.lit(True)), "project", "left").join(seen, "project", "left").fillna(0, ["_images", "_tables"])
    whole = F.lit(None).cast(segments.schema["segment_id"].dataType).alias("segment_id")

    def said(rows: DataFrame, kind: str, segment, *values) -> DataFrame:
        return rows.select("project", F.lit(kind).alias("kind"), F.format_string(ACADEMIC[kind], *values).alias("message") if values else F.lit(ACADEMIC[kind]).alias("message"), segment)

    told = met.where("_told")
    cited = images.where("path IS NOT NULL").join(told.select("project"), "project", "left_semi").join(assets, ["project", "path"], "left")
    absent = F.col("sha256").isNull() | F.col("found_sha256").isNull()
    parts = [
        said(met.where("_told IS NULL"), "academic_missing_import_report", whole),
        said(told.where("_images <> figures"), "academic_figure_count_mismatch", whole, F.col("figures").cast("long"), "_images"),
        said(told.where("_tables <> tables"), "academic_table_count_mismatch", whole, F.col("tables").cast("long"), "_tables"),
        said(cited.where(absent), "academic_missing_figure_asset", F.col("segment_id"), "path"),
        said(cited.where(~absent & (F.col("sha256") != F.col("found_sha256"))), "academic_figure_asset_changed", F.col("segment_id"), "path"),
    ]
    found = reduce(DataFrame.unionByName, parts)
    return found.select("project", stable_id("issue", F.col("kind"), F.coalesce(F.col("segment_id").cast("string"), F.lit("project")), F.col("message")).alias("id"), "kind", "message", "segment_id", F.lit("error").alias("severity"), F.lit("open").alias("status"))


def chain_violations(log: DataFrame, owner: str, known: DataFrame | None = None) -> DataFrame:
    """(id, reason): repeated ids, unknown owners, and revisions that don't follow their parents."""
    parent = log.select(F.col("id").alias("supersedes"), F.col(owner).alias("_owner"), F.col("revision").alias("_rev")).dropDuplicates(["supersedes"])
    met = log.join(parent, "supersedes", "left")
    first = (F.col("revision") == 1) & F.col("supersedes").isNotNull()
    later = (F.col("revision") > 1) & (F.col("_rev").isNull() | (F.col("_owner") != F.col(owner)) | (F.col("_rev") != F.col("revision") - 1))
    reasons = met.select("id", F.when(first, F.lit("first has a parent")).when(later, F.lit("broken parent")).when(F.col("revision") < 1, F.lit("bad revision")).alias("reason")).where("reason IS NOT NULL")
    repeated = log.groupBy("id").count().where("count > 1").select("id", F.lit("repeated id").alias("reason"))
    out = reasons.unionByName(repeated)
    if known is not None:
        out = out.unionByName(log.join(known.select(owner), owner, "left_anti").select("id", F.lit("unknown owner").alias("reason")))
    return out
