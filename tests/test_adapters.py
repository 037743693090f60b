"""Pacing, retries and contracts of service calls; mapping of archive documents to sections."""

import json

import pytest
from lexiflow.operators import adapters, alignment


class Failed(Exception):
    def __init__(self, status):
        self.status_code = status


def test_retries():
    waits, calls = [], []

    def call():
        calls.append(1)
        if len(calls) < 4:
            raise Failed((429, 500, 408)[len(calls) - 1])
        return "done"

    assert adapters.with_retries(call, sleep=waits.append) == "done" and waits == [2.0, 4.0, 8.0]
    with pytest.raises(Failed):
        adapters.with_retries(lambda: (_ for _ in ()).throw(Failed(400)), sleep=waits.append)
    assert adapters.wait_before(9) == 30.0 and adapters.wait_before(1, "7") == 7.0
    assert adapters.retryable(TimeoutError()) and not adapters.retryable(KeyError())


def test_pace():
    at, slept = [0.0], []
    pace = adapters.Pace(60, clock=lambda: at[0], sleep=slept.append)
    pace.wait()
    pace.wait()
    assert slept == [1.0]


def test_service_calls(spark):
    packets = spark.createDataFrame([("u1", ["a", "b"], json.dumps(["x", "y"])), ("u2", ["c"], json.dumps(["z"]))], "unit_id string, segment_ids array<string>, payload string")
    rows = adapters.call_service(packets, lambda: lambda payload: [t.upper() for t in json.loads(payload)], per_minute=1e6)
    assert sorted(map(tuple, rows.collect())) == [("u1", "a", "X"), ("u1", "b", "Y"), ("u2", "c", "Z")]
    short = adapters.call_service(packets, lambda: lambda payload: ["one"], per_minute=1e6, attempts=1)
    with pytest.raises(Exception, match="not one text"):
        short.collect()


def test_payload_has_approved_knowledge_only(spark):
    packets = spark.createDataFrame([("u1", "p")], "unit_id string, previous_text string")
    glossary = spark.createDataFrame([("A", "甲", ["x"], "", "approved"), ("B", "乙", [], "", "proposed"), ("C", "", [], "", "approved")], "term string, preferred_translation string, allowed_variants array<string>, note string, status string")
    entities = spark.createDataFrame([("N", "k", "d", "proposed")], "name string, kind string, description string, status string")
    found = json.loads(adapters.packet_payload(packets, glossary, entities).first().payload)
    assert [g["term"] for g in found["glossary"]] == ["A"] and found["entities"] == [] and found["unit_id"] == "u1"


def test_best_sections(spark):
    docs = spark.createDataFrame([("b", "ch1.xhtml", "One starts here with a long sentence."), ("b", "ch2.xhtml", "Only a second long sentence."), ("b", "x.xhtml", "nothing")], "book string, name string, content string")
    sections = spark.createDataFrame([("b", "s1", "One", 0), ("b", "s2", "Two", 1)], "book string, section_id string, title string, ordinal int")
    segments = spark.createDataFrame([("b", "s1", "a long sentence"), ("b", "s2", "a second long sentence"), ("b", "s2", "short")], "book string, section_id string, text string")
    rows = alignment.best_sections(docs, sections, segments).collect()
    assert {r["name"]: (r.section_id, r.score) for r in rows} == {"ch1.xhtml": ("s1", 1001), "ch2.xhtml": ("s2", 1)}
