"""Texts that contain terms, against a look at every pair."""

import random

import pytest
from lexiflow.operators import knowledge, phrases, rules
from pyspark.sql import functions as F


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def corpus():
    rng = random.Random(2)
    texts = ["".join(rng.choices("abcd é漢ÄB", k=rng.randint(0, 40))) for _ in range(300)] + [None, "", " ", "a", "No such thing", "no  SUCH thing", "漢字の文"]
    terms = ["".join(rng.choices("abcd é漢Ä", k=rng.randint(1, 7))) for _ in range(60)] + [None, "", "such thing", "SUCH  THING", "漢字", "の", "zzzz zzzz", "ab", "ab", "Abc d", "ÄB"]
    return list(enumerate(texts)), list(enumerate(terms))


@pytest.mark.parametrize("size", [1, 3, 4])
@pytest.mark.parametrize("most", [200_000, 0])
def test_all_texts_that_contain_a_term(spark, size, most):
    texts, terms = corpus()
    found = phrases.containing(spark.createDataFrame(texts, "i int, text string"), spark.createDataFrame(terms, "j int, term string"), size=size, most=most)
    want = sorted((i, j) for i, t in texts for j, x in terms if t and x and x.lower() in t.lower())
    assert sorted((r.i, r.j) for r in found.select("i", "j").collect()) == want and len(want) > 1000
    assert "NestedLoop" not in plan(found) and "Cartesian" not in plan(found)
    assert found.columns == ["i", "text", "j", "term"]


def test_no_texts_or_terms(spark):
    some, none = spark.createDataFrame([("x y",)], "text string"), spark.createDataFrame([], "text string")
    terms = spark.createDataFrame([("x",), (None,), ("",)], "term string")
    assert phrases.containing(none, terms).count() == 0 and phrases.containing(some, terms.where("term = ''")).count() == 0
    assert phrases.containing(some, terms).collect() == [("x y", "x")]


def test_keys_are_the_rarest_grams(spark):
    texts = spark.createDataFrame([("common words here",)] * 5 + [("common wordy",)], "text string")
    found = {r.term: r._gram for r in phrases.rarest_grams(texts, spark.createDataFrame([("common wordy",), ("Ab",), ("ommon wo",), ("quite other",)], "term string"), "text", "term").collect()}
    assert found["common wordy"] == "ordy" and found["Ab"] == "ab" and found["ommon wo"] == min("ommo", "mmon", "mon ", "on w", "n wo")
    assert found["quite other"] in "quite other"


@pytest.mark.parametrize("piece", [1, 5, 64])
def test_pieces_of_a_text_miss_no_gram(spark, monkeypatch, piece):
    monkeypatch.setattr(phrases, "PIECE", piece)
    texts = [(k, t) for k, t in enumerate(["", "a", "ab", "abc\nabc" * 30, "é漢" * 70, "🙂x🙂y" * 40, None])]
    got = phrases.with_grams(spark.createDataFrame(texts, "i int, text string"), "text", [1, 3]).select("i", "_at", "_gram").collect()
    assert sorted(map(tuple, got)) == sorted((i, p + 1, t[p : p + n]) for i, t in texts for n in (1, 3) for p in range(len(t or "") - n + 1))


def test_a_hundred_thousand_phrases(spark):
    """A glossary of 10^5 terms of several words meets its texts without a nested loop."""
    terms = spark.range(100_000).select(F.concat(F.lit("part "), F.col("id").cast("string"), F.lit(" of it")).alias("term"), F.lit("译").alias("preferred_translation"), F.array().cast("array<string>").alias("allowed_variants"), F.lit("approved").alias("status"))
    texts = [(f"s{k}", f"Here is Part {k * 37} of it, and part {k} of another.", False, "out" if k % 2 else "译") for k in range(300)]
    ready = spark.createDataFrame(texts, "segment_id string, text string, passed boolean, output string")
    found = rules.terminology_mismatch(ready, terms)
    assert {r.segment_id for r in found.collect()} == {f"s{k}" for k in range(300) if k % 2} and found.count() == 150
    assert "NestedLoop" not in plan(found) and "Cartesian" not in plan(found)


def test_first_hits_of_a_term(spark):
    rows = spark.createDataFrame([("b", k, f"s{k}", "an Odd one" if k % 3 else "even") for k in range(40)], "document string, ordinal int, segment_id string, text string")
    found = knowledge.term_hits(rows, spark.createDataFrame([("odd ONE",)], "term string"), 3, ["document"])
    assert sorted((r.ordinal, r.hit) for r in found.collect()) == [(1, 1), (2, 2), (4, 3)] and "NestedLoop" not in plan(found)


def test_letters_whose_lower_case_depends_on_neighbours(spark):
    """Part of a text stays part of it in lower case: sigma at an end, İ."""
    texts = [(0, "ΟΔΟΣΙΑ İzmir"), (1, "οδοσ"), (2, "ΟΔΟΣ ΑΣ"), (3, "izmir")]
    for most in (200_000, 0):
        found = phrases.containing(spark.createDataFrame(texts, "i int, text string"), spark.createDataFrame([("ΟΔΟΣ",), ("İz",), ("Σ",)], "term string"), most=most)
        assert sorted((r.i, r.term) for r in found.select("i", "term").collect()) == [(0, "İz"), (0, "ΟΔΟΣ"), (0, "Σ"), (1, "ΟΔΟΣ"), (1, "Σ"), (2, "ΟΔΟΣ"), (2, "Σ"), (3, "İz")]


@pytest.mark.parametrize("most", [200_000, 0])
@pytest.mark.parametrize("stretch,block", [(1, 1), (7, 16), (4096, 1 << 20)])
def test_stretches_and_blocks_miss_no_term(spark, monkeypatch, most, stretch, block):
    monkeypatch.setattr(phrases, "STRETCH", stretch)
    texts, terms = corpus()
    held = phrases.stretches(spark.createDataFrame(texts, "i int, text string"), "text")
    grams = sorted({x[p : p + n].lower() for _, x in terms if x for n in (2, 4) for p in range(len(x) - n + 1)})
    want = {(t.lower(), g) for _, t in texts if t for g in grams if g in t.lower()}
    # a block's size is the driver's here: the batches are looked through in this process
    monkeypatch.setattr(phrases, "BLOCK", block)
    batches = held.join(spark.createDataFrame(texts, "i int, text string").select(phrases._hash("text"), "text").distinct(), "_text").toArrow().to_batches(max_chunksize=17)
    seeker = phrases.Seeker(grams)
    got = {(batch.column("text")[int(r)].as_py().lower(), seeker.grams[k]) for batch in batches for rows, ks in seeker.found(batch) for r, k in zip(rows, ks)}
    assert got == want
    found = phrases.containing(spark.createDataFrame(texts, "i int, text string"), spark.createDataFrame(terms, "j int, term string"), most=most)
    assert found.count() == sum(x.lower() in t.lower() for _, t in texts for _, x in terms if t and x)


def test_long_texts_are_not_copied_for_their_grams(spark):
    """A text of a million characters has a million grams; rows of grams have no text."""
    texts = spark.range(3).select("id", F.concat(F.repeat(F.lit("wie es im so ist "), 60_000), F.col("id").cast("string")).alias("text"))
    terms = spark.createDataFrame([("es im",), ("ist 2",), ("m s",), ("gibt es nicht",)], "term string")
    found = phrases.containing(texts, terms)
    assert sorted((r.id, r.term) for r in found.select("id", "term").collect()) == sorted([(k, t) for k in range(3) for t in ("es im", "m s")] + [(2, "ist 2")])
