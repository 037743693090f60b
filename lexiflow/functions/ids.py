"""Content-derived identifiers and digests."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

UNIT_SEP, RECORD_SEP = "\x1f", "\x1e"


def text_of(part) -> Column:
    """A part as the text that identifiers are made of; null reads None."""
    column = part if isinstance(part, Column) else F.lit(part)
    return F.coalesce(column.cast("string"), F.lit("None"))


def stable_id(prefix: str, *parts) -> Column:
    """prefix_ and 16 hex digits of SHA-256 over the parts joined by U+001F."""
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha2(F.concat_ws(UNIT_SEP, *map(text_of, parts)).cast("binary"), 256), 1, 16))


def stable_id_of_array(prefix: str, first, parts: Column) -> Column:
    """As stable_id, with the elements of an array after the first part."""
    joined = F.concat_ws(UNIT_SEP, text_of(first), parts)
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha2(joined.cast("binary"), 256), 1, 16))


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def set_digest(ids: Column) -> Column:
    """Of an array as a set: sorted, joined by a bar."""
    return sha256(F.array_join(F.array_sort(ids), "|"))


def ordered_digest(ids: Column, context: Column | None = None) -> Column:
    """Of an array in its order, and a context in JSON if there is one."""
    joined = F.array_join(ids, UNIT_SEP)
    return sha256(joined if context is None else F.concat(joined, F.lit(RECORD_SEP), context))


def python_list(items: Column) -> Column:
    """An array of strings as Python prints a list; part of issue identities."""

    def quoted(x: Column) -> Column:
        body = F.replace(x, F.lit("\\"), F.lit("\\\\"))
        single, double = F.contains(x, F.lit("'")), F.contains(x, F.lit('"'))
        both = F.concat(F.lit("'"), F.replace(body, F.lit("'"), F.lit("\\'")), F.lit("'"))
        return F.when(single & ~double, F.concat(F.lit('"'), body, F.lit('"'))).when(single, both).otherwise(F.concat(F.lit("'"), body, F.lit("'")))

    return F.concat(F.lit("["), F.array_join(F.transform(items, quoted), ", "), F.lit("]"))


@F.pandas_udf(StringType())
def sorted_json(values: pd.Series) -> pd.Series:
    """JSON with sorted keys and spaces after separators, as digests embed it."""
    return values.map(lambda v: None if v is None else json.dumps(json.loads(v), ensure_ascii=False, sort_keys=True))
