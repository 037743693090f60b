"""Ordered operators: current revisions, ordinals, samples, budgets and batches.

Nothing here orders a whole table in one task: document-wide ordinals are a rank
within a section and the counts of the sections before it, prefixes are scanned
by sections, and folds run on one section's (or scope's) rows in an array.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def current(log: DataFrame, key: str | list[str], revision: str = "revision", position: str = "_pos", where: str | None = None) -> DataFrame:
    """The row with the highest revision for each key, the first of equals.

    row_number() = 1 lets Spark keep one row a key and task before the shuffle.
    """
    keys = [key] if isinstance(key, str) else list(key)
    rows = log.where(where) if where else log
    order = Window.partitionBy(*keys).orderBy(F.desc(revision), F.asc(position))
    return rows.withColumn("_rank", F.row_number().over(order)).where("_rank = 1").drop("_rank")


def current_translations(log: DataFrame, key: str | list[str] = "segment_id") -> DataFrame:
    return current(log, key, where="status = 'completed'")


def document_ordinals(rows: DataFrame, document: str, section: str, position: str) -> DataFrame:
    """in_section and ordinal (over the document), both from 0."""
    inside = rows.withColumn("in_section", F.row_number().over(Window.partitionBy(document, section).orderBy(position)) - 1)
    counts = rows.groupBy(document, section).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(document).orderBy(section).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    return inside.join(counts, [document, section]).withColumn("ordinal", F.col("_before") + F.col("in_section")).drop("_before")


def root_sections(sections: DataFrame, document: str) -> DataFrame:
    """document and root_section_id, its section with the least ordinal."""
    return sections.groupBy(document).agg(F.min_by("section_id", "ordinal").alias("root_section_id"))


def units(segments: DataFrame, size: int = 3, section: str = "section_id", position: str = "in_section") -> DataFrame:
    """section, unit_no and the segment rows' ids in order, `size` a unit; a unit never crosses sections."""
    chunk = F.floor(F.col(position) / F.lit(size)).cast("long")
    found = segments.groupBy(section, chunk.alias("unit_no")).agg(F.array_sort(F.collect_list(F.struct(position, "segment_id"))).alias("_rows"))
    return found.select(section, "unit_no", F.transform("_rows", lambda r: r["segment_id"]).alias("segment_ids"))


def neighbours(rows: DataFrame, partition: str | list[str], order: str | list[str], value: str = "text") -> DataFrame:
    """previous_ and next_ value in order."""
    keys, by = ([x] if isinstance(x, str) else x for x in (partition, order))
    w = Window.partitionBy(*keys).orderBy(*by)
    return rows.withColumn(f"previous_{value}", F.lag(value).over(w)).withColumn(f"next_{value}", F.lead(value).over(w))


def document_neighbours(segments: DataFrame, document: str = "document", text: str = "text") -> DataFrame:
    """As neighbours over the document order, across sections, by two shuffled self joins on the ordinal.

    A window over a document would put it into one task.
    """
    near = segments.select(document, F.col("ordinal"), F.col(text).alias("_text"))
    before = near.withColumn("ordinal", F.col("ordinal") + 1).withColumnRenamed("_text", "previous_text")
    after = near.withColumn("ordinal", F.col("ordinal") - 1).withColumnRenamed("_text", "next_text")
    return segments.join(before, [document, "ordinal"], "left").join(after, [document, "ordinal"], "left")


def first_middle_last(rows: DataFrame, key: str, position: str) -> DataFrame:
    """The first, the middle (n // 2) and the last row of each key; position counts from 0."""
    counted = rows.withColumn("_n", F.count("*").over(Window.partitionBy(key)))
    return counted.where((F.col(position) == 0) | (F.col(position) == F.floor(F.col("_n") / 2)) | (F.col(position) == F.col("_n") - 1)).drop("_n")


def stratified(rows: DataFrame, key: str, position: str, points: int = 30, above: int = 40) -> DataFrame:
    """Rows at `points` even places (half to even), where a key has more than `above`; else all."""
    counted = rows.withColumn("_n", F.count("*").over(Window.partitionBy(key)))
    places = F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda k: F.bround(k * (F.col("_n") - 1) / F.lit(float(points - 1))).cast("long"))
    return counted.where((F.col("_n") <= above) | F.array_contains(places, F.col(position).cast("long"))).drop("_n")


def budget_fold(rows: DataFrame, key: str, position: str, cost: Column, item: str, cap: int = 60_000) -> DataFrame:
    """key and the items kept in order: one too dear is passed over, later ones may fit; the first always stays."""
    lists = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(position).alias("p"), cost.cast("long").alias("c"), F.col(item).alias("i")))).alias("_rows"))
    kind = rows.schema[item].dataType.simpleString()
    zero = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast(f"array<{kind}>").alias("kept"))

    def step(state, row):
        fits = (F.size(state["kept"]) == 0) | (state["used"] + row["c"] <= F.lit(cap))
        return F.when(fits, F.struct((state["used"] + row["c"]).alias("used"), F.array_append(state["kept"], row["i"]).alias("kept"))).otherwise(state)

    return lists.select(key, F.aggregate("_rows", zero, step).alias("_s")).select(key, "_s.used", "_s.kept")


# -- work envelopes ---------------------------------------------------------------------
WINDOW_TOKENS, MOST_UNITS = 400_000, 500


def source_budget(window: int = WINDOW_TOKENS) -> int:
    return int(window * 0.25) * 4


def input_budget(window: int = WINDOW_TOKENS) -> int:
    return int(window * 0.5) * 4


def usable_tokens(window: int = WINDOW_TOKENS) -> int:
    return int(window * 0.85)


def workload_tokens(input_chars: Column, source_chars: Column) -> Column:
    return F.floor((input_chars + 3) / 4) + F.floor(F.lit(0.6) * source_chars + F.lit(0.999))


def prefix_scan(rows: DataFrame, key: str, section: str, position: str, measures: dict[str, Column], over: Callable[[Column, dict[str, Column]], Column], most_rows: int | None = None) -> DataFrame:
    """The rows of each key in order, up to before the first where over(number from 1, running sums) holds; the first row always.

    A scan in segments: totals of sections, running sums over sections, and then
    only the section in which the limit breaks is opened, so no window orders the
    rows of a key.  Positions of a section follow each other; sums never fall, and
    over() stays true once it is.  most_rows: a number of rows that over() refuses,
    so that later sections needn't be looked at.
    """
    totals = rows.groupBy(key, section).agg(F.min(position).alias("_start"), F.count("*").alias("_n"), *[F.sum(c).alias(f"_t_{name}") for name, c in measures.items()])
    order = Window.partitionBy(key).orderBy("_start")
    if most_rows is not None:  # a section has a row at least
        totals = totals.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= most_rows)
    ahead = order.rowsBetween(Window.unboundedPreceding, -1)
    scanned = totals.withColumn("_before", F.coalesce(F.sum("_n").over(ahead), F.lit(0)))
    for name in measures:
        scanned = scanned.withColumn(f"_b_{name}", F.coalesce(F.sum(f"_t_{name}").over(ahead), F.lit(0)))
    last = F.col("_before") + F.col("_n")
    scanned = scanned.withColumn("_breaks", (last > 1) & over(last, {name: F.col(f"_b_{name}") + F.col(f"_t_{name}") for name in measures}))
    scanned = scanned.withColumn("_broken", F.sum(F.col("_breaks").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    wanted = scanned.where((F.col("_broken") == 0) | (F.col("_breaks") & (F.col("_broken") == 1))).select(key, section, "_breaks", "_before", *[f"_b_{name}" for name in measures])
    met = rows.join(wanted, [key, section])
    inside = Window.partitionBy(key, section).orderBy(position)
    number = F.col("_before") + F.row_number().over(inside)
    sums = {name: F.col(f"_b_{name}") + F.sum(c).over(inside.rowsBetween(Window.unboundedPreceding, 0)) for name, c in measures.items()}
    opened = met.where("_breaks").withColumn("_number", number).withColumn("_over", over(number, sums)).where((F.col("_number") == 1) | ~F.col("_over"))
    return met.where("NOT _breaks").select(*rows.columns).unionByName(opened.select(*rows.columns))


def batch_prefix(pending: DataFrame, key: str, position: str, section: str, source_chars: str, input_chars: str, most_units: int = MOST_UNITS, chars: int | None = None, tokens: int | None = None, one_section: bool = True) -> DataFrame:
    """The units of the next batch: from a key's first, up to before the first that breaks a limit.

    Limits: another section than the first unit's (unless one_section is false),
    the unit cap, source characters, workload tokens; the first unit is always in.
    """
    chars = source_budget() if chars is None else chars
    tokens = usable_tokens() if tokens is None else tokens

    def over(number: Column, sums: dict[str, Column]) -> Column:
        heavy = (sums["chars"] > F.lit(chars)) | (workload_tokens(sums["input"], sums["chars"]) > F.lit(tokens))
        return (number > most_units) | ((number > 1) & heavy)

    rows = pending
    if one_section:
        first = pending.groupBy(key).agg(F.min(F.struct(position, section)).alias("_f")).select(key, F.col(f"_f.{section}").alias(section))
        rows = pending.join(first, [key, section], "left_semi")
    return prefix_scan(rows, key, section, position, {"chars": F.col(source_chars), "input": F.col(input_chars)}, over, most_units + 1)


def checkpoints(pending: DataFrame, section: str, position: str, unit: str, source_chars: str, input_chars: str, most_units: int = 60, chars: int | None = None, tokens: int | None = None, overhead: int = 512) -> DataFrame:
    """section, checkpoint (from 0 in its section), units and chars: packed in order, limits reset at each checkpoint."""
    chars = source_budget() if chars is None else chars
    tokens = usable_tokens() if tokens is None else tokens
    row = F.struct(F.col(position).alias("p"), F.col(unit).alias("u"), F.col(source_chars).cast("long").alias("s"), (F.col(input_chars) + overhead).cast("long").alias("i"))
    lists = pending.groupBy(section).agg(F.array_sort(F.collect_list(row)).alias("_rows"))
    kind = pending.schema[unit].dataType.simpleString()
    zero = F.expr(f"named_struct('n', 0L, 's', 0L, 'i', 0L, 'c', -1L, 'out', cast(array() as array<struct<c:bigint,u:{kind},s:bigint>>))")

    def step(a, r):
        s, i = a["s"] + r["s"], a["i"] + r["i"]
        full = (a["n"] == 0) | (a["n"] >= F.lit(most_units)) | (s > F.lit(chars)) | (workload_tokens(i, s) > F.lit(tokens))
        c = a["c"] + full.cast("long")
        out = F.array_append(a["out"], F.struct(c.alias("c"), r["u"].alias("u"), r["s"].alias("s")))
        return F.struct(F.when(full, F.lit(1).cast("long")).otherwise(a["n"] + 1).alias("n"), F.when(full, r["s"]).otherwise(s).alias("s"), F.when(full, r["i"]).otherwise(i).alias("i"), c.alias("c"), out.alias("out"))

    packed = lists.select(section, F.explode(F.aggregate("_rows", zero, step)["out"]).alias("x"))
    return packed.groupBy(section, F.col("x.c").alias("checkpoint")).agg(F.count("*").alias("units"), F.sum("x.s").alias("chars"), F.collect_list("x.u").alias("unit_ids"))


def campaign_candidates(pending: DataFrame, key: str, position: str, segments: str, most_segments: int, section: str = "section_id") -> DataFrame:
    """Pending units in order while their segments stay within the cap; the first always."""
    return prefix_scan(pending, key, section, position, {"segments": F.col(segments)}, lambda _, sums: sums["segments"] > F.lit(most_segments))


def top_per_key(rows: DataFrame, key: str | list[str], order: list, n: int) -> DataFrame:
    keys = [key] if isinstance(key, str) else key
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_k") <= n).drop("_k")
