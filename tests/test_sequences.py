"""Prefixes of ordered rows by segments, against a plain loop."""

import random

import pytest
from lexiflow.operators import sequences
from pyspark.sql import functions as F


def rows_of(seed):
    rng = random.Random(seed)
    rows = []
    for book in "abcd":
        position = 0
        for section in range(rng.randint(1, 9)):
            for _ in range(rng.randint(1, 7)):
                position += rng.randint(1, 3)
                rows.append((book, f"{book}{section}", position, rng.choice([0, 1, 5, 40, 200]), rng.randint(0, 300), rng.randint(1, 4)))
    rng.shuffle(rows)
    return rows


def batch(rows, most, chars, tokens, one_section):
    out = []
    for book in "abcd":
        own = sorted(r for r in rows if r[0] == book)
        own.sort(key=lambda r: r[2])
        c = i = 0
        for k, r in enumerate(own, 1):
            c, i = c + r[3], i + r[4]
            heavy = c > chars or (i + 3) // 4 + int(0.6 * c + 0.999) > tokens
            if (one_section and r[1] != own[0][1]) or k > most or (k > 1 and heavy):
                break
            out.append(r)
    return sorted(out)


NAMES = "book string, section string, position int, chars int, input int, segments int"


@pytest.mark.parametrize(("most", "chars", "tokens"), [(4, 300, 400), (100, 10**6, 10**6), (1, 0, 0), (9, 60, 10**6), (100, 10**6, 150)])
def test_batches(spark, most, chars, tokens):
    rows = rows_of(most)
    table = spark.createDataFrame(rows, NAMES).repartition(3)
    for one_section in (True, False):
        found = sequences.batch_prefix(table, "book", "position", "section", "chars", "input", most, chars, tokens, one_section)
        assert sorted(map(tuple, found.collect())) == batch(rows, most, chars, tokens, one_section) and found.columns == table.columns


@pytest.mark.parametrize("most", [0, 3, 20, 1000])
def test_campaign_candidates(spark, most):
    rows = rows_of(most + 50)
    found = sequences.campaign_candidates(spark.createDataFrame(rows, NAMES), "book", "position", "segments", most, "section")
    want = []
    for book in "abcd":
        total = 0
        for k, r in enumerate(sorted((r for r in rows if r[0] == book), key=lambda r: r[2])):
            total += r[5]
            want += [r] if not k or total <= most else []
    assert sorted(map(tuple, found.collect())) == sorted(want)


def test_only_sections_are_ordered_within_a_book(spark):
    """Windows over a book have a row a section; those over rows are within a section."""
    table = spark.createDataFrame(rows_of(1), NAMES)
    scan = sequences.campaign_candidates(table, "book", "position", "segments", 20, "section")
    plan = scan._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.split("\n") if "Window [" in line]
    over_rows = [w for w in windows if "position" in w]
    assert windows and over_rows and all("[book#" in w and ", section#" in w for w in over_rows)
    assert sequences.prefix_scan(table.limit(0), "book", "section", "position", {"n": F.col("segments")}, lambda n, _: n > 3).count() == 0
