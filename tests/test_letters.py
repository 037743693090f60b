"""Letters whose cases Spark and SQL engines give in different ways."""

import os

import duckdb
import pytest
from compare import TABLES, compare
from lexiflow.functions import text as T

SF = "/root/testdata/sf0.001"
no_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def tables_with(path, **own):
    """A folder of the smallest test tables, some of them replaced by the rows of an SQL query."""
    for name in TABLES:
        if name in own:
            duckdb.execute(f"COPY ({own[name]}) TO '{path}/{name}.parquet'")
        else:
            (path / f"{name}.parquet").symlink_to(f"{SF}/{name}.parquet")
    return str(path)


def test_cases_of_all_characters(spark, tmp_path):
    duckdb.execute(f"COPY (SELECT c, chr(c::INT) AS s FROM range(1, 1114112) t(c) WHERE c NOT BETWEEN 55296 AND 57343) TO '{tmp_path}/all.parquet'")
    want = duckdb.sql(f"SELECT c, upper(s) AS u, lower(s) AS l FROM '{tmp_path}/all.parquet' WHERE u <> s OR l <> s").fetchall()
    got = spark.read.parquet(f"{tmp_path}/all.parquet").select("c", T.upper("s").alias("u"), T.lower("s").alias("l"), "s").where("u <> s OR l <> s").drop("s").collect()
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > 2000


def test_lower_case_is_the_same_anywhere(spark):
    found = spark.createDataFrame([("ΟΔΟΣ ΣΑΣ İZ ß", None)], "a string, b string").select(T.lower("a"), T.lower("b"), T.upper("a"), T.upper("b")).first()
    assert tuple(found) == ("οδοσ σασ iz ß", None, "ΟΔΟΣ ΣΑΣ İZ ẞ", None)


@no_tables
def test_glossary_merge_of_odd_letters(spark, tmp_path):
    odd = "SELECT item_id, unnest(['schß.', 'ŉa', 'ﬁx', 'ᾳ', 'ΑΣ', 'ας', 'İran', 'iran', 'ǰ', '', NULL]) || ' x' AS text FROM range(1) t(item_id) UNION ALL SELECT 1, NULL"
    names = f"SELECT * REPLACE (CASE n_nationkey WHEN 0 THEN 'STRAẞE' WHEN 1 THEN 'IRAN' WHEN 2 THEN 'ασ' ELSE n_name END AS n_name) FROM '{SF}/nation.parquet'"
    assert compare(spark, "glossary_merge_no_overwrite", tables_with(tmp_path, benchmark=odd, nation=names)) is None


@no_tables
def test_phrases_of_odd_letters(spark, tmp_path):
    """Approved forms in capitals keep ß and others one letter; white space in passages is the SQL's."""
    words = ["Enlich schß. Und", "dieŉ ﬁx ǰa", "ᾳ schß. da", "a\u00a0b c d", "zwei\x0bdrei vier fünf", "nur zwei"]
    passages = " UNION ALL ".join(f"SELECT {k} AS item_id, '{w}' AS text" for k, w in enumerate(words))
    texts = " UNION ALL ".join(f"SELECT {k}::BIGINT AS doc_id, '{w} weiter' || chr(10) || 'Und {w}' AS text, 'de' AS lang, 'web' AS source, 9 AS n_chars" for k, w in enumerate(words * 7))
    assert compare(spark, "phrase_mismatch", tables_with(tmp_path, benchmark=passages, documents=texts)) is None
