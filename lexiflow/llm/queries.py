"""The queries of the training-data operators, over whole tables, and their SQL."""

from __future__ import annotations

import hashlib
import itertools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact, infill, lines, minhash, mixing, packing, quality, repeats, sharding, simhash, token_files, trie


def vocabulary() -> str:
    """Path of the public byte-level vocabulary; a parameter of the operators."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.depth_passes(_documents(spark, sf_dir), length=50)
    return found.select("doc_id", F.col("n_tokens").alias("n_bytes"), "n_removed", "n_spans", "kept_sha256")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(_documents(spark, sf_dir)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.doubling_levels(_documents(spark, sf_dir), length=13)
    return found.select("doc_id", F.col("n_tokens").alias("n_words"), "n_removed", "kept_sha256")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_documents(spark, sf_dir), vocabulary(), size=2048, end_id=1)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    found = quality.quality(_documents(spark, sf_dir), labels)
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "stratum")


#: Shards of the sharding query.
SHARDS = [f"shard-{k:03d}" for k in range(64)]


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_documents(spark, sf_dir).select("doc_id"), SHARDS).select("doc_id", "slot", "shard")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.read_token_files(token_files.write_token_files(_documents(spark, sf_dir), vocabulary(), end_id=0))


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_documents(spark, sf_dir), shingle=3, distance=2)
    return found.select("doc_id", F.lpad(F.lower(F.hex("f0")), 16, "0").alias("fingerprint"), "component_id")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.dedup_lines(_documents(spark, sf_dir), min_sites=5)
    return found.select("doc_id", F.col("_lines").alias("n_lines"), F.col("_removed").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill.fill_in_middle(_documents(spark, sf_dir), seed="7", rate=100, spm=50, with_text=False)


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.conversation_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"), group=100, shared=6)


def op13_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.minhash_groups(_documents(spark, sf_dir), shingle=4, similarity=0.8).select("doc_id", "n_shingles", "component_id", "kept")


def _quality_sql(limit: float = 0.01, delta: float = 0.05) -> str:
    """Counts, policies, exact binomial tails and the fixed sequence of op5 in SQL."""
    scores = {
        "symbols": "n_symbols / nullif(word_chars, 0)", "dup_lines": "n_dup_lines / greatest(n_lines, 1)", "repeats": "n_repeat_words / nullif(n_words, 0)",
        "short_words": "-word_chars / nullif(n_words, 0)", "long_words": "word_chars / nullif(n_words, 0)",
    }
    steps = len(quality.PATH)
    rejects = [" OR ".join(f"coalesce({scores[r]} > {c}, false)" for r, c in quality.policy(k).items()) for k in range(1, steps + 1)]
    return f"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS stratum, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) AS w FROM documents),
        l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d),
        ln AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM l WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
        p AS (SELECT doc_id, unnest(range(len(w)::BIGINT)) AS i, unnest(w) AS word FROM d),
        p2 AS (SELECT *, word || ' ' || lead(word, 1) OVER o AS s FROM p WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
        p4 AS (SELECT doc_id, i, word, s || ' ' || lead(s, 2) OVER o AS s FROM p2 WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
        v AS (SELECT doc_id, i, s || ' ' || lead(word, 4) OVER o AS win FROM p4 WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
        x AS (SELECT doc_id, i, win IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, win) > 1 AS twice FROM v),
        y AS (SELECT doc_id, max(twice::INTEGER) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS hit FROM x),
        r AS (SELECT doc_id, sum(hit)::BIGINT AS n_repeat_words FROM y GROUP BY doc_id),
        c AS (
            SELECT d.doc_id, stratum, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g'))::BIGINT AS word_chars,
                   length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_lines, 0)::BIGINT AS n_lines,
                   coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
            FROM d LEFT JOIN ln USING (doc_id) LEFT JOIN r USING (doc_id)),
        b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, [{", ".join(rejects)}] AS over FROM c),
        h AS (
            SELECT stratum, count(*) AS n, [{", ".join(f"count(*) FILTER (over[{k}])" for k in range(1, steps + 1))}] AS hits
            FROM b WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) GROUP BY stratum),
        m AS (SELECT *, count(*) OVER () AS strata FROM h WHERE n * ln({1 - limit}) <= ln({delta})),
        q AS (SELECT stratum, n, strata, unnest(range(1, {steps + 1})) AS step, unnest(hits) AS k FROM m),
        z AS (
            SELECT stratum, step, {delta} / strata AS level,
                   list_sum([exp(lgamma(n + 1) - CASE WHEN i > 0 THEN lgamma(i + 1) ELSE 0 END - lgamma(n - i + 1) + i * ln({limit}) + (n - i) * ln({1 - limit})) FOR i IN range(k + 1)]) AS tail
            FROM q),
        s AS (SELECT stratum, coalesce(min(step) FILTER (tail > level) - 1, {steps}) AS steps FROM z GROUP BY stratum)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
               NOT base_failed AND NOT (coalesce(s.steps, 0) > 0 AND over[greatest(coalesce(s.steps, 1), 1)]) AS kept, n_lines, b.stratum
        FROM b LEFT JOIN s ON s.stratum = b.stratum"""


def _filled(names: list[str], slots: int) -> list[int]:
    """The lookup table of sharding, filled once more in other words for the SQL."""
    number = lambda text: int(hashlib.md5(text.encode()).hexdigest()[:15], 16)
    wish = lambda x: ((number(f"offset/{x}") + j * (number(f"step/{x}") % (slots - 1) + 1)) % slots for j in itertools.count())
    wishes = [wish(x) for x in names]
    owner: dict[int, int] = {}
    for k in itertools.cycle(range(len(names))):
        if len(owner) == slots:
            return [owner[slot] for slot in range(slots)]
        owner[next(slot for slot in wishes[k] if slot not in owner)] = k
    return []


QUERIES = {
    f.__name__: f
    for f in (
        op1_suffix_array_dedup, op2_exact_dedup, op3_substring_dedup, op4_packing, op5_quality_rules,
        op6_sharding, op7_token_files, op8_simhash_near_dedup, op9_mixing, op10_line_dedup,
        op11_fill_in_middle, op12_conversation_trie, op13_minhash_near_dedup,
    )
}

ORACLES: dict[str, str] = {
    "op1_suffix_array_dedup": """
        WITH d AS (SELECT doc_id, regexp_extract_all(hex(encode(coalesce(text, ''))), '..') AS h, strlen(coalesce(text, ''))::BIGINT AS n FROM documents),
        a AS (SELECT doc_id, n, unnest(range(n)) AS i, unnest(h) AS byte FROM d),
        a2 AS (SELECT *, byte || lead(byte, 1) OVER o AS s FROM a WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
        a4 AS (SELECT doc_id, n, i, byte, s || lead(s, 2) OVER o AS s FROM a2 WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
        a8 AS (SELECT doc_id, n, i, byte, s || lead(s, 4) OVER o AS s FROM a4 WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
        a16 AS (SELECT doc_id, n, i, byte, s || lead(s, 8) OVER o AS s FROM a8 WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
        a32 AS (SELECT doc_id, n, i, byte, s || lead(s, 16) OVER o AS s FROM a16 WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
        -- bytes 1 to 32 and 19 to 50
        w AS (SELECT doc_id, i, byte, s || lead(s, 18) OVER o AS win FROM a32 WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
        f AS (SELECT win, min(doc_id) AS first FROM w WHERE win IS NOT NULL GROUP BY win HAVING min(doc_id) < max(doc_id)),
        g AS (
            SELECT w.doc_id, i, byte,
                   max((f.first IS NOT NULL AND f.first < w.doc_id)::INTEGER) OVER (PARTITION BY w.doc_id ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone
            FROM w LEFT JOIN f USING (win)),
        s AS (SELECT *, gone = 1 AND coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), 0) = 0 AS begins FROM g),
        k AS (
            SELECT doc_id, sum(gone)::BIGINT AS n_removed, count(*) FILTER (begins) AS n_spans,
                   coalesce(string_agg(byte, '' ORDER BY i) FILTER (gone = 0), '') AS kept
            FROM s GROUP BY doc_id)
        SELECT d.doc_id, d.n AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
               sha256(unhex(coalesce(kept, ''))) AS kept_sha256
        FROM d LEFT JOIN k USING (doc_id)""",
    "op3_substring_dedup": r"""
        WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
        a AS (SELECT doc_id, unnest(range(len(w)::BIGINT)) AS i, unnest(w) AS word FROM d),
        a2 AS (SELECT *, word || ' ' || lead(word, 1) OVER o AS s FROM a WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
        a4 AS (SELECT doc_id, i, word, s || ' ' || lead(s, 2) OVER o AS s FROM a2 WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
        a8 AS (SELECT doc_id, i, word, s || ' ' || lead(s, 4) OVER o AS s FROM a4 WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
        -- words 1 to 8 and 6 to 13
        w AS (SELECT doc_id, i, word, s || ' ' || lead(s, 5) OVER o AS win FROM a8 WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
        f AS (SELECT win, min(doc_id) AS first FROM w WHERE win IS NOT NULL GROUP BY win HAVING min(doc_id) < max(doc_id)),
        g AS (
            SELECT w.doc_id, i, word,
                   max((f.first IS NOT NULL AND f.first < w.doc_id)::INTEGER) OVER (PARTITION BY w.doc_id ORDER BY i ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS gone
            FROM w LEFT JOIN f USING (win)),
        k AS (SELECT doc_id, sum(gone)::BIGINT AS n_removed, coalesce(string_agg(word, ' ' ORDER BY i) FILTER (gone = 0), '') AS kept FROM g GROUP BY doc_id)
        SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
        FROM d LEFT JOIN k USING (doc_id)""",
    "op5_quality_rules": _quality_sql(),
    "op2_exact_dedup": """
        WITH t AS (
            SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
            FROM documents)
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept, sha256(norm) AS text_sha256
        FROM t WINDOW g AS (PARTITION BY norm)""",
    "op6_sharding": f"""
        WITH t AS (SELECT {_filled(SHARDS, sharding.SLOTS)} AS slots),
        d AS (SELECT doc_id, ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15))::BIGINT % {sharding.SLOTS} AS slot FROM documents)
        SELECT doc_id, slot, slots[slot + 1]::INTEGER AS shard FROM d, t""",
    "op9_mixing": r"""
        WITH RECURSIVE d AS (
            SELECT doc_id, source, coalesce('s' || source, 'n') AS site,
                   coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
            FROM documents),
        s AS (
            SELECT site, source, sum(size)::BIGINT AS source_size,
                   [3, 1, 2][(row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1]::DOUBLE AS weight
            FROM d GROUP BY site, source),
        r AS (SELECT *, source_size * 2.0::DOUBLE AS cap, source_size * 2.0::DOUBLE / weight AS ratio FROM s),
        l AS (
            SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE
                       - coalesce(sum(cap) OVER (ORDER BY ratio, site ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                      / sum(weight) OVER (ORDER BY ratio, site ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
            FROM r),
        m AS (SELECT arg_min(level, (ratio, site)) FILTER (level <= ratio) AS level FROM l),
        t AS (SELECT l.site, l.source_size, least(l.cap, coalesce(m.level * l.weight, l.cap)) AS target FROM l, m),
        c AS (
            SELECT d.*, t.source_size, t.target,
                   CASE WHEN size = 0 THEN 0 ELSE length(bin(size)) * 16 + (((size * 16) >> (length(bin(size)) - 1)::INTEGER) & 15) END AS class,
                   ('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 7))::BIGINT & 255 AS salt,
                   ('0x' || substr(md5('mix' || d.site), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u
            FROM d JOIN t USING (site)),
        k AS (
            SELECT site, class, count(*) AS docs, sum(size)::DOUBLE / count(*) AS mean, any_value(u) AS u,
                   any_value(CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END) AS e,
                   row_number() OVER (PARTITION BY site ORDER BY class DESC) AS i
            FROM c GROUP BY site, class),
        f AS (
            SELECT site, class, i, docs, mean, e * docs AS due, least(greatest(floor(e * docs + u), 0), 2 * docs)::BIGINT AS take FROM k WHERE i = 1
            UNION ALL
            SELECT k.site, k.class, k.i, k.docs, k.mean, v.due, least(greatest(floor(v.due + k.u), 0), 2 * k.docs)::BIGINT
            FROM f JOIN k ON k.site = f.site AND k.i = f.i + 1,
                 LATERAL (SELECT k.e * k.docs + CASE WHEN k.mean > 0 THEN (f.due - f.take) * f.mean / k.mean ELSE 0 END AS due) v),
        n AS (SELECT *, row_number() OVER (PARTITION BY site, class ORDER BY salt, size DESC, doc_id) AS rank FROM c)
        SELECT doc_id, size, source_size, target,
               (CASE WHEN rank < docs THEN floor(take * rank / docs + u) ELSE take END - floor(take * (rank - 1) / docs + u))::BIGINT * size AS taken
        FROM n JOIN f USING (site, class)""",
    "op11_fill_in_middle": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
        -- a line begins at the first character and behind each line feed that is not the last one
        s AS (SELECT *, string_split(text, chr(10)) AS line, sha256('7:' || doc_id) AS digest FROM d),
        c AS (
            SELECT *, (CASE WHEN text = '' THEN 0 ELSE len(line) - (line[-1] = '')::INTEGER END)::BIGINT AS n,
                   [('0x' || substr(digest, k * 8 + 1, 8))::BIGINT FOR k IN range(4)] AS h
            FROM s),
        e AS (SELECT *, list_sort([h[1] % (n + 1), h[2] % (n + 1)]) AS cut,
                     CASE WHEN regexp_matches(text, '<[PSM]>') OR text = '' THEN 'plain' WHEN h[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM c),
        p AS (
            SELECT doc_id, text, n, form,
                   (list_sum([length(x) + 1 FOR x IN line[1:cut[1]]]))::BIGINT AS to_first, (list_sum([length(x) + 1 FOR x IN line[1:cut[2]]]))::BIGINT AS to_second
            FROM e),
        q AS (
            SELECT *, least(coalesce(to_first, 0), length(text)) AS a, least(coalesce(to_second, 0), length(text)) AS b FROM p),
        r AS (SELECT *, text[1:a] AS head, text[a + 1:b] AS body, text[b + 1:] AS tail FROM q)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END::BIGINT AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN text WHEN 'spm' THEN '<S>' || tail || '<P>' || head || '<M>' || body ELSE '<P>' || head || '<S>' || tail || '<M>' || body END) AS output_sha256,
               sha256(text) AS restored_sha256
        FROM r""",
    "op12_conversation_trie": """
        WITH t AS (
            SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
                   row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos
            FROM conversations WHERE conv_id IS NOT NULL),
        -- CRC-32 of the decimal number, bit by bit
        k AS (
            SELECT c, c - c % 100 AS base,
                   xor(list_reduce(list_concat([4294967295::BIGINT], [ascii(x)::BIGINT FOR x IN string_split(c::VARCHAR, '')]),
                       lambda crc, byte: list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: xor(v >> 1, 3988292384 * (v & 1)))), 4294967295) % 6 AS h
            FROM (SELECT DISTINCT c FROM t)),
        r AS (
            SELECT k.c, t.pos, role, text FROM k JOIN t ON t.c = k.base WHERE t.pos <= h
            UNION ALL SELECT k.c, t.pos, role, text FROM k JOIN t USING (c) WHERE t.pos > h),
        s AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY pos) AS d, length(text) AS size, length(role) || ':' || role || length(text) || ':' || text AS step FROM r),
        o AS (
            SELECT c, 0 AS d, '' AS path, 0 AS size FROM k
            UNION ALL SELECT c, d, string_agg(step, '' ORDER BY d) OVER (PARTITION BY c ORDER BY d), size FROM s),
        z AS (SELECT *, d = max(d) OVER (PARTITION BY c) AS ends FROM o),
        n AS (
            SELECT d, path, min(c) AS c, count(*) AS n_convs, any_value(size) AS size, bool_and(ends) AS leaf,
                   sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ends), '')) AS ends_sha256
            FROM z GROUP BY d, path),
        u AS (
            SELECT o.d, o.path, sum((n.n_convs - 1) * n.size) AS saved, count(*) FILTER (n.leaf) AS leaves, count(*) FILTER (n.d = o.d + 1) AS children
            FROM n JOIN o ON o.c = n.c AND o.d <= n.d GROUP BY o.d, o.path)
        SELECT n.c AS conv_id, n.d::BIGINT AS depth, p.c AS parent_conv_id, n.n_convs, children AS n_children, leaves AS n_leaves, saved::BIGINT AS saved_tokens, n.ends_sha256
        FROM n JOIN u ON u.d = n.d AND u.path = n.path
        LEFT JOIN o ON o.c = n.c AND o.d = n.d - 1 LEFT JOIN n p ON p.d = o.d AND p.path = o.path""",
    "op13_minhash_near_dedup": r"""
        WITH RECURSIVE d AS (
            SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
        s AS (SELECT doc_id, list_distinct([array_to_string(w[i + 1:i + 4], ' ') FOR i IN range(greatest(len(w) - 3, least(len(w), 1)))]) AS grams FROM d),
        g AS (SELECT doc_id, len(grams) AS n, unnest(grams) AS gram FROM s),
        l AS (
            SELECT a.doc_id AS a, b.doc_id AS b FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id <> b.doc_id
            GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))),
        r AS (SELECT doc_id AS a, doc_id AS b FROM s UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
        SELECT doc_id, len(grams)::BIGINT AS n_shingles, c AS component_id, c = doc_id AS kept
        FROM s JOIN (SELECT a, min(b) AS c FROM r GROUP BY a) ON a = doc_id""",
    "op10_line_dedup": r"""
        WITH p AS (
            SELECT doc_id, coalesce('s' || source, 'n') AS site, unnest(string_split(text, chr(10))) AS line,
                   generate_subscripts(string_split(text, chr(10)), 1) AS pos
            FROM documents),
        q AS (SELECT *, trim(line, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS core FROM p),
        b AS (SELECT core, min(doc_id) AS first_doc FROM q WHERE core <> '' GROUP BY core HAVING count(DISTINCT site) >= 5),
        r AS (SELECT q.*, b.core IS NOT NULL AND (q.doc_id <> b.first_doc) AS gone FROM q LEFT JOIN b ON q.core = b.core)
        SELECT d.doc_id, coalesce(count(r.pos) FILTER (r.core <> ''), 0)::BIGINT AS n_lines,
               coalesce(count(*) FILTER (r.gone), 0)::BIGINT AS n_removed,
               sha256(coalesce(string_agg(r.line, chr(10) ORDER BY r.pos) FILTER (NOT r.gone), '')) AS kept_sha256
        FROM documents d LEFT JOIN r ON d.doc_id = r.doc_id GROUP BY d.doc_id""",
}
