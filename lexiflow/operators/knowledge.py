"""Terms and entities: candidates, adjudication, research plans, impact, profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import set_digest, stable_id
from ..functions.text import contains_term
from . import phrases, selection

#: What a name looks like, words that are none, and how authorities rank.
CANDIDATE = r"\b(?:[A-Z][a-z]{2,})(?:\s+[A-Z][a-z]{2,}){0,3}\b"
IGNORED = ["The", "This", "That", "Chapter", "Part", "Inside"]
AUTHORITY = {"standard": 5, "official": 4, "academic": 3, "publisher": 2, "community": 1}
#: Words that hint at a domain, in order of precedence; fixed values.
SIGNALS = {
    "political economy": ["power", "wage", "worker", "capital", "prosperity"],
    "technology and society": ["technology", "machine", "innovation", "digital"],
    "history": ["century", "history", "medieval", "revolution"],
    "social science": ["society", "institution", "inequality", "political"],
}
#: Concepts that need care, with rendering; fixed values.
CONCEPTS = {
    "power": "权力（支配或决策语境）；力量/能力（物理或技术语境）",
    "capital": "资本",
    "labor": "劳动/劳动力",
    "progress": "进步",
    "productivity": "生产率",
    "agency": "能动性/行动能力",
    "empowered": "获得权力/自主权得到增强",
    "disempowered": "权力受到削弱",
}


def candidates(segments: DataFrame, pattern: str = CANDIDATE, least: int = 2) -> DataFrame:
    """term, n, evidence (segment ids by ordinal) and confidence of names in `least` segments or more.

    The number is counted before evidence is gathered, and evidence is gathered
    for terms that pass only.
    """
    seen = segments.select("segment_id", "ordinal", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(pattern), F.lit(0)))).alias("term")).where(~F.col("term").isin(IGNORED))
    enough = seen.groupBy("term").count().where(F.col("count") >= least).drop("count")
    found = seen.join(enough, "term", "left_semi").groupBy("term").agg(F.array_sort(F.collect_list(F.struct("ordinal", "segment_id"))).alias("_e"))
    n = F.size("_e")
    return found.select("term", n.alias("n"), F.transform("_e", lambda e: e["segment_id"]).alias("evidence"), F.least(F.lit(0.9), F.lit(0.5) + n * F.lit(0.1)).alias("confidence"))


def propose(segments: DataFrame, glossary: DataFrame, entities: DataFrame, least: int = 2) -> tuple[DataFrame, DataFrame]:
    """Glossary and entities with proposals for terms they don't have."""
    found = candidates(segments, least=least).withColumn("evidence", F.transform("evidence", lambda x: x.cast("string")))
    terms = found.select("term", F.lit("").alias("preferred_translation"), F.array().cast("array<string>").alias("allowed_variants"), F.lit("Candidate extracted from repeated source usage").alias("note"), F.get("evidence", F.lit(0)).alias("source_segment_id"), "confidence", F.col("evidence").alias("evidence_segment_ids"), F.lit("proposed").alias("status"))
    named = found.select(stable_id("ent", F.col("term")).alias("id"), F.col("term").alias("name"), F.lit("unknown").alias("kind"), F.lit("Candidate entity; classify during review").alias("description"), F.array().cast("array<string>").alias("aliases"), F.col("evidence").alias("evidence_segment_ids"), "confidence", F.lit("proposed").alias("status"))
    return selection.merge_without_overwrite(glossary, terms, "term"), selection.merge_without_overwrite(entities, named, "name")


def authority_rank(authority: Column) -> Column:
    rank = F.lit(0)
    for name, k in AUTHORITY.items():
        rank = F.when(authority == name, k).otherwise(rank)
    return rank


def adjudicate(found: DataFrame, approve_authoritative: bool = False) -> DataFrame:
    """One decision a term (in any case): the best of authority rank, confidence and id."""
    ranked = found.withColumn("_rank", F.struct(authority_rank(F.col("authority")).alias("a"), F.col("confidence").alias("c"), F.col("id").cast("string").alias("i")))
    best = ranked.groupBy(F.lower("term").alias("term_key")).agg(F.max_by(F.struct("id", "term", "candidate_translation", "authority", "confidence"), "_rank").alias("b"), F.collect_set(F.col("id").cast("string")).alias("ids"))
    approved = F.col("b.authority").isin("standard", "official") & (F.col("b.confidence") >= 0.9) & F.lit(approve_authoritative)
    out = best.withColumn("status", F.when(approved, F.lit("approved")).otherwise(F.lit("proposed"))).withColumn("candidates_digest", set_digest(F.col("ids")))
    return out.select(stable_id("termdec", F.col("term_key"), F.col("candidates_digest"), F.col("status")).alias("id"), "term_key", F.col("b.term").alias("term"), F.col("b.id").alias("selected_candidate_id"), F.col("b.candidate_translation").alias("selected_translation"), "status", "candidates_digest")


def impact(segments: DataFrame, term: str) -> DataFrame:
    """Segments that have the term in any case."""
    return segments.where(F.contains(F.lower("text"), F.lit(term.strip().lower())))


def term_hits(segments: DataFrame, terms: DataFrame, n: int = 8, partition: list[str] | None = None) -> DataFrame:
    """The first n segments (by ordinal) that contain each term in any case."""
    met = phrases.containing(segments, terms)
    w = Window.partitionBy(*(partition or []), "term").orderBy("ordinal")
    return met.withColumn("hit", F.row_number().over(w)).where(F.col("hit") <= n)


def research_plan(segments: DataFrame, glossary: DataFrame, rules: DataFrame) -> DataFrame:
    """term and up to 8 pieces of evidence (800 characters) for open terms; glossary before concept rules."""
    open_ = glossary.where("status <> 'approved' AND trim(term) <> ''").select("term", F.col("evidence_segment_ids").alias("e"), F.lit(0).alias("_from"))
    asked = open_.unionByName(rules.where("trim(term) <> ''").select("term", F.col("evidence_segment_ids").alias("e"), F.lit(1).alias("_from")))
    tasks = asked.groupBy(F.lower("term").alias("_key")).agg(F.min_by(F.struct("term", "e"), "_from").alias("t")).select("t.term", F.posexplode("t.e").alias("at", "segment_id"))
    prose = segments.where(F.col("kind").isin("paragraph", "blockquote")).select("segment_id", F.substring("text", 1, 800).alias("source_text"))
    cited = tasks.join(prose, "segment_id").groupBy("term").agg(F.array_sort(F.collect_list(F.struct("at", "segment_id", "source_text"))).alias("e"))
    return cited.select("term", F.transform(F.slice("e", 1, 8), lambda x: F.struct(x["segment_id"].alias("segment_id"), x["source_text"].alias("source_text"))).alias("evidence"))


def substring_count(text: Column, word: str) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(word), F.lit("")))) / len(word)).cast("long")


def domain_scores(texts: DataFrame, key: str, text: str = "text", signals: dict[str, list[str]] = SIGNALS) -> DataFrame:
    """key, domain, score and place (order of declaration); words count as substrings."""
    low = F.lower(text)
    sums = [F.sum(sum((substring_count(low, w) for w in words), F.lit(0))).alias(f"s{k}") for k, words in enumerate(signals.values())]
    scores = texts.groupBy(key).agg(*sums)
    pairs = F.array(*[F.struct(F.lit(name).alias("domain"), F.col(f"s{k}").alias("score"), F.lit(k).alias("place")) for k, name in enumerate(signals)])
    return scores.select(key, F.inline(pairs))


def top_domains(texts: DataFrame, key: str, text: str = "text", n: int = 3, signals: dict[str, list[str]] = SIGNALS) -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.desc("score"), "place")
    return domain_scores(texts, key, text, signals).where("score > 0").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).drop("place")


def concept_rules(segments: DataFrame, key: str, most: int = 8) -> DataFrame:
    """key, source_term, rendering, evidence and confidence of the concepts in its segments (each segment once)."""
    words = F.array_intersect(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))), F.array(*map(F.lit, CONCEPTS)))
    seen = segments.select(key, "segment_id", "ordinal", F.explode(words).alias("source_term"))
    first = seen.withColumn("_k", F.row_number().over(Window.partitionBy(key, "source_term").orderBy("ordinal"))).where(F.col("_k") <= most)
    found = first.groupBy(key, "source_term").agg(F.array_sort(F.collect_list(F.struct("ordinal", "segment_id"))).alias("_e"))
    rendering = F.element_at(F.create_map(*[F.lit(x) for pair in CONCEPTS.items() for x in pair]), F.col("source_term"))
    n = F.size("_e")
    return found.select(key, "source_term", rendering.alias("preferred_rendering"), F.transform("_e", lambda e: e["segment_id"]).alias("evidence_segment_ids"), F.round(F.least(F.lit(0.9), F.lit(0.55) + n * F.lit(0.05)), 2).alias("confidence"))
