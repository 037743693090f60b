"""Fill-in-the-middle transformation: DuckDB SQL over Arrow batches.

Each task opens a DuckDB of its own, registers a few megabytes of an Arrow batch
as a table, and one statement cuts, reorders, rebuilds and digests the texts; its
Arrow result goes back to Spark.  There is no shuffle and no Python per row, and
what a document becomes depends on its doc_id and text alone, so a lost task is
done again alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textops import ragged, released, slices

SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"
#: Bytes of texts that DuckDB gets at once; a longer text is one batch.
AT_ONCE = 4 << 20


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _escaped(text: str) -> str:
    """For RE2, which takes any character between these as it is."""
    return f"\\Q{text}\\E"


def statement(seed: str, rate: int, spm: int, markers: tuple[str, str, str], with_text: bool) -> str:
    """The SQL over a table texts(doc_id, text)."""
    p, s, m = map(_quoted, markers)
    psm, spm_form = (_quoted(f"(?s)^{_escaped(a)}(.*?){_escaped(b)}(.*?){_escaped(markers[2])}(.*)$") for a, b in (markers[:2], markers[1::-1]))
    group = lambda k: f"('0x' || substr(digest, {8 * k + 1}, 8))::BIGINT"
    return rf"""
        WITH units AS (
            SELECT doc_id, text, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS unit,
                   sha256({_quoted(f"{seed}:")} || coalesce(doc_id::VARCHAR, '')) AS digest
            FROM (SELECT doc_id, coalesce(text, '') AS text FROM texts)),
        cuts AS (
            SELECT *, len(unit)::BIGINT AS n, {group(0)} % (len(unit) + 1) AS one, {group(1)} % (len(unit) + 1) AS two,
                   CASE WHEN text = '' OR contains(text, {p}) OR contains(text, {s}) OR contains(text, {m}) OR {group(2)} % 100 >= {rate:d} THEN 'plain'
                        WHEN {group(3)} % 100 < {spm:d} THEN 'spm' ELSE 'psm' END AS form
            FROM units),
        parts AS (
            SELECT doc_id, text, n, form, array_to_string(list_slice(unit, 1, least(one, two)), '') AS prefix,
                   array_to_string(list_slice(unit, least(one, two) + 1, greatest(one, two)), '') AS middle,
                   array_to_string(list_slice(unit, greatest(one, two) + 1, n), '') AS suffix
            FROM cuts),
        moved AS (
            SELECT *, CASE form WHEN 'plain' THEN text WHEN 'psm' THEN {p} || prefix || {s} || suffix || {m} || middle
                                ELSE {s} || suffix || {p} || prefix || {m} || middle END AS output
            FROM parts),
        found AS (
            SELECT *, CASE form WHEN 'psm' THEN regexp_extract(output, {psm}, ['a', 'b', 'c'])
                                WHEN 'spm' THEN regexp_extract(output, {spm_form}, ['a', 'b', 'c']) END AS got
            FROM moved)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix)::BIGINT END AS prefix_chars,
               CASE WHEN form <> 'plain' THEN length(middle)::BIGINT END AS middle_chars, sha256(output) AS output_sha256,
               sha256(CASE form WHEN 'plain' THEN output WHEN 'psm' THEN got.a || got.c || got.b ELSE got.b || got.c || got.a END) AS restored_sha256
               {", output" if with_text else ""}
        FROM found"""


@released
def _transform(sql: str, names: list[str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import duckdb

    kinds = {"doc_id": pa.int64(), "n": pa.int64(), "prefix_chars": pa.int64(), "middle_chars": pa.int64()}
    schema = pa.schema([(name, kinds.get(name, pa.string())) for name in names])
    with duckdb.connect(config={"threads": 1, "temp_directory": ""}) as con:
        for batch in batches:
            _, bounds = ragged(batch.column(1))
            for i, j in slices(bounds, AT_ONCE):
                con.register("texts", pa.Table.from_batches([batch.slice(i, j - i)]))
                for part in con.sql(sql).to_arrow_reader(4096):
                    yield from pa.Table.from_batches([part]).cast(schema).to_batches()
                con.unregister("texts")


def fill_in_middle(docs: DataFrame, seed: str = "7", rate: int = 100, spm: int = 50, markers: tuple[str, str, str] = ("<P>", "<S>", "<M>"), with_text: bool = True) -> DataFrame:
    """Per row of docs: SCHEMA, and with_text the column output.

    A text is cut before two of its lines, chosen by the digits of a digest of
    seed and doc_id; the middle goes to the end behind the markers' prefix and
    suffix.  Of 100 texts about `rate` change, about `spm` of these with the
    suffix first.  plain (unchanged): the empty text, null included, and texts
    that hold a marker, so that every output can be undone; restored_sha256 is
    the digest of what the output gives when it is undone.  Rows without doc_id
    are cut by the digest of the seed alone; equal rows alike.  Other columns are
    ignored; an empty table has no rows.  A text is handled whole in one task.
    """
    if len(set(markers)) < 3 or not all(markers) or any("\\E" in x for x in markers):
        raise ValueError("three different markers, none empty and none with \\E")
    schema = SCHEMA + ", output string" * with_text
    names = [f.split()[0] for f in schema.split(", ")]
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(partial(_transform, statement(seed, rate, spm, markers, with_text), names), schema)
