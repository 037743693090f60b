"""Quality rules with risk-controlled thresholds.

Each text gets counts; fixed base rules reject the plainly broken.  Further
rules reject a text when a score passes a cutoff.  PATH names the policies that
may be used, from the laxest on; each rejects what those before it reject, and
more.  How far along it a stratum (language) goes is settled by labelled
holdouts: a policy passes if the exact binomial probability of as few rejected
good texts as were seen, were the true rate of false rejections above `limit`,
is at most delta / strata.  The path is tested in its order and left at the
first policy that fails (fixed-sequence testing, so its length costs nothing);
the strata share delta (Bonferroni).  Strata with too few labels to pass even
without a rejected text aren't tested, and keep to the base rules.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .shared import columns, shared_dir
from .textops import Numbering, SEPARATOR, U64, Words, expand, mix, per_document, ragged, released, slices, window_hashes

COUNTS = "doc_id long, stratum string, n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long"
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
#: A higher score is worse.
SCORES = {
    "symbols": "try_divide(n_symbols, word_chars)",
    "dup_lines": "n_dup_lines / greatest(n_lines, 1)",
    "repeats": "try_divide(n_repeat_words, n_words)",
    "short_words": "-try_divide(word_chars, n_words)",
    "long_words": "try_divide(word_chars, n_words)",
}
#: The steps of the path: rules and their new cutoffs; those of earlier steps go on.
PATH = (
    {"symbols": 0.3}, {"symbols": 0.2}, {"symbols": 0.1}, {"symbols": 0.05}, {"symbols": 0.02},
    {"long_words": 16.0, "short_words": -2.0}, {"dup_lines": 0.5}, {"repeats": 0.15}, {"long_words": 12.0, "short_words": -2.5},
    {"dup_lines": 0.4}, {"repeats": 0.1}, {"long_words": 10.0, "short_words": -3.0}, {"dup_lines": 0.3}, {"repeats": 0.05}, {"long_words": 8.0},
)


def policy(step: int) -> dict[str, float]:
    """Cutoffs after so many steps of the path."""
    return {rule: cutoff for part in PATH[:step] for rule, cutoff in part.items()}


def rejects(cutoffs: dict[str, float]) -> Column:
    """Whether a score passes its cutoff; false where a score is null."""
    over = F.lit(False)
    for rule, cutoff in cutoffs.items():
        over = over | F.coalesce(F.expr(SCORES[rule]) > F.lit(cutoff), F.lit(False))
    return over


def _twins(number: np.ndarray, at: np.ndarray, owner: np.ndarray, window: int) -> np.ndarray:
    """Whether the window at each of `at` stands twice or more with its owner.

    Windows are ordered by a hash and neighbours compared word by word; if unequal
    ones share a hash, all are ordered by their words.
    """
    same = np.zeros(len(at), bool)
    if len(at) < 2:
        return same
    keys = mix(window_hashes(mix(number.astype(U64)), 1, window)[at] ^ mix(owner.astype(U64) + U64(1)))
    columns = [number[at + k] for k in range(window)] + [owner]
    order = np.argsort(keys)
    for again in (False, True):
        equal = np.logical_and.reduce([c[order[1:]] == c[order[:-1]] for c in columns])
        if again or (equal == (keys[order[1:]] == keys[order[:-1]])).all():
            break
        order = np.lexsort(columns)
    same[order[1:][equal]] = True
    same[order[:-1][equal]] = True
    return same


def count_slice(data: np.ndarray, bounds: np.ndarray, window: int = 5) -> list[np.ndarray]:
    """The counts of COUNTS from n_words on, for each document."""
    w = Words(data, bounds)
    n_words = np.diff(w.first)
    visible = ~SEPARATOR[data] & ((data & 0xC0) != 0x80)
    word_chars, n_symbols = per_document(visible, bounds), per_document(_SYMBOL[data], bounds)

    raw = data.tobytes()
    n_lines, n_dup_lines = np.zeros(len(n_words), np.int64), np.zeros(len(n_words), np.int64)
    for i, (low, high) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
        lines = [x for x in raw[low:high].split(b"\n") if not x.isspace() and x]
        n_lines[i], n_dup_lines[i] = len(lines), len(lines) - len(set(lines))

    # windows of words, equal ones within a document
    words = w.text.tobytes().split(b" ")[:-1]
    count = np.maximum(n_words - window + 1, 0)
    at = expand(w.first[:-1], w.first[:-1] + count)
    same = _twins(Numbering().of(words, len(words)), at, np.repeat(np.arange(len(count)), count), window)
    step = np.zeros(int(w.first[-1]) + 1, np.int32)
    np.add.at(step, at[same], 1)
    np.add.at(step, at[same] + window, -1)
    return [n_words, word_chars, n_symbols, n_lines, n_dup_lines, per_document(np.cumsum(step[:-1]) > 0, w.first)]


@released
def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in COUNTS.split(", ")]
    for batch in batches:
        data, bounds = ragged(batch.column(2))
        for i, j in slices(bounds):
            found = count_slice(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i])
            yield pa.record_batch([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), *(pa.array(c.astype(np.int64)) for c in found)], names=names)


def counts(docs: DataFrame, stratum: str = "lang", rows: bool = False) -> DataFrame:
    """COUNTS of every row of docs, and base_failed; with the whole row too if asked.  Null text: no words."""
    asked = [F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("stratum"), F.col("text").cast("string").alias("text")]
    if rows:
        found = docs.select(*asked, F.struct(*columns(docs)).alias("row")).mapInArrow(_count_rows, StructType([StructField("row", docs.schema), *StructType.fromDDL(COUNTS).fields]))
    else:
        found = docs.select(*asked).mapInArrow(_count, COUNTS)
    return found.withColumn("base_failed", F.expr("n_words < 10 OR 100 * n_repeat_words > 20 * n_words"))


@released
def _count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """As _count, after the row itself (column 3)."""
    for batch in batches:
        at = 0
        for found in _count([batch]):
            yield pa.record_batch([batch.column(3).slice(at, found.num_rows), *found.columns], names=["row", *found.schema.names])
            at += found.num_rows


def binomial_tail(k: int, n: int, rate: float) -> float:
    """P(X <= k) for X ~ Binomial(n, rate), summed exactly from the largest term down."""
    if k >= n or rate <= 0:
        return 1.0
    if k >= n * rate:
        return 1.0  # at least about a half: no candidate passes there
    log = math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(rate) + (n - k) * math.log1p(-rate)
    term = total = math.exp(log)
    for i in range(k, 0, -1):
        term *= i / (n - i + 1) * (1 - rate) / rate
        total += term
        if term < total * 1e-17:
            break
    return min(1.0, total)


def choose_steps(table: list[tuple[str, int, list[int]]], limit: float, delta: float) -> dict[str, int]:
    """{stratum: steps of the path} from (stratum, good texts, rejected ones after each step)."""
    tested = [x for x in table if binomial_tail(0, x[1], limit) <= delta]
    chosen = {}
    for stratum, n, rejected in tested:
        step = 0
        while step < len(rejected) and binomial_tail(rejected[step], n, limit) <= delta / len(tested):
            step += 1
        if step:
            chosen[stratum] = step
    return chosen


def holdout(counted: DataFrame, labels: DataFrame) -> list[tuple[str, int, list[int]]]:
    """(stratum, labelled good rows that pass the base rules, how many of them each policy rejects); a row a stratum."""
    good = labels.where("quality = 1").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    held = counted.where("NOT base_failed").join(good, "doc_id", "left_semi")
    tests = [F.count_if(rejects(policy(k))).alias(f"step_{k}") for k in range(1, len(PATH) + 1)]
    rows = held.groupBy("stratum").agg(F.count("*").alias("n"), *tests).collect()
    return [(r["stratum"], r["n"], [r[f"step_{k}"] for k in range(1, len(PATH) + 1)]) for r in sorted(rows, key=lambda r: r["stratum"])]


def fit(counted: DataFrame, labels: DataFrame, limit: float = 0.01, delta: float = 0.05) -> dict[str, dict[str, float]]:
    """{stratum: {rule: cutoff}} from all labelled good rows (quality 1) that pass the base rules.

    limit: the rate of false rejections in a stratum, by all rules together, that
    is exceeded in any stratum with probability delta at most.
    """
    return {stratum: policy(step) for stratum, step in choose_steps(holdout(counted, labels), limit, delta).items()}


def verdict(cutoffs: dict[str, dict[str, float]]) -> Column:
    """True where no chosen cutoff is passed."""
    bad = F.lit(False)
    for stratum, rules in cutoffs.items():
        bad = bad | ((F.col("stratum") == F.lit(stratum)) & rejects(rules))
    return ~bad


def quality(docs: DataFrame, labels: DataFrame, limit: float = 0.01, delta: float = 0.05, stratum: str = "lang") -> DataFrame:
    """COUNTS, base_failed and kept for every row of docs.

    Labels without doc_id, of other texts or repeated don't matter; repeated rows
    of docs are counted as often as they stand there.  A null stratum is a
    stratum of its own.  Null text: no words (base_failed).  Other columns are
    ignored.  An empty table has no rows.  One document is never split.
    """
    shared_dir(docs.sparkSession)
    counted = counts(docs, stratum).checkpoint()
    return counted.withColumn("kept", ~F.col("base_failed") & verdict(fit(counted, labels, limit, delta)))


def keep(docs: DataFrame, labels: DataFrame, limit: float = 0.01, delta: float = 0.05, stratum: str = "lang") -> DataFrame:
    """The rows of docs that quality() keeps, whole; texts aren't shuffled but counted twice.

    Null texts and texts of few words go; repeated rows are judged alike; all
    columns stay, whatever their names.  An empty table has no rows.
    """
    shared_dir(docs.sparkSession)
    cutoffs = fit(counts(docs, stratum), labels, limit, delta)
    return counts(docs, stratum, rows=True).where(~F.col("base_failed") & verdict(cutoffs)).select("row.*")
