"""Calling services from partitions: pacing, retries, and the contract on results."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: HTTP statuses worth another try (and all from 500 on); fixed values.
RETRIED = (408, 409, 429)


class ResponseFormatError(ValueError):
    """A service's answer doesn't have the form asked for."""


def retryable(error: Exception) -> bool:
    status = getattr(error, "status_code", None)
    if status is not None:
        return status in RETRIED or status >= 500
    return isinstance(error, (TimeoutError, ConnectionError, ResponseFormatError))


def wait_before(attempt: int, retry_after: str | None = None, most: float = 30.0) -> float:
    """Seconds before try attempt + 1 (attempts from 1): what the service says, else doubling."""
    try:
        return max(0.0, float(retry_after))
    except (TypeError, ValueError):
        return min(2.0**attempt, most)


def with_retries(call: Callable[[], object], attempts: int = 5, sleep: Callable[[float], None] = time.sleep):
    for attempt in range(1, attempts + 1):
        try:
            return call()
        except Exception as e:  # noqa: BLE001
            if attempt == attempts or not retryable(e):
                raise
            headers = getattr(getattr(e, "response", None), "headers", None) or {}
            sleep(wait_before(attempt, headers.get("retry-after")))


class Pace:
    """At most `per_minute` calls a minute, evenly."""

    def __init__(self, per_minute: float, clock=time.monotonic, sleep=time.sleep):
        self.gap, self.next, self.clock, self.sleep = 60.0 / per_minute, 0.0, clock, sleep

    def wait(self) -> None:
        now = self.clock()
        if now < self.next:
            self.sleep(self.next - now)
        self.next = max(now, self.next) + self.gap


def packet_payload(packets: DataFrame, glossary: DataFrame, entities: DataFrame) -> DataFrame:
    """packets with payload (JSON): the packet and approved knowledge only.

    Both knowledge lists are made one value; they are refused above 50,000 rows.
    """
    terms = glossary.where("status = 'approved' AND preferred_translation <> ''")
    names = entities.where("status = 'approved'")
    if terms.count() + names.count() > 50_000:
        raise ValueError("over 50,000 approved terms and entities")
    known = terms.agg(F.collect_list(F.struct("term", "preferred_translation", "allowed_variants", "note")).alias("_g")).crossJoin(names.agg(F.collect_list(F.struct("name", "kind", "description")).alias("_e")))
    full = packets.crossJoin(F.broadcast(known))
    columns = [F.col(c) for c in packets.columns]
    return full.select(*columns, F.to_json(F.struct(*columns, F.col("_g").alias("glossary"), F.col("_e").alias("entities"))).alias("payload"))


def call_service(packets: DataFrame, client: Callable[[], Callable[[str], list[str]]], per_minute: float = 60, attempts: int = 5) -> DataFrame:
    """unit_id, segment_id, translated_text from packets (unit_id, segment_ids, payload).

    client makes a function from payload to one text a segment, once a partition;
    the pace is a partition's, so the rate is per_minute times the tasks at once.
    """

    def translate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask, pace = client(), Pace(per_minute)
        for batch in batches:
            rows = []
            for unit, segments, payload in zip(batch["unit_id"], batch["segment_ids"], batch["payload"]):

                def once():
                    pace.wait()
                    texts = ask(payload)
                    if len(texts) != len(segments) or any(not isinstance(t, str) or not t.strip() for t in texts):
                        raise ResponseFormatError(f"unit {unit}: not one text for each of {len(segments)} segments")
                    return texts

                rows += [(unit, s, t) for s, t in zip(segments, with_retries(once, attempts))]
            yield pd.DataFrame(rows, columns=["unit_id", "segment_id", "translated_text"])

    return packets.select("unit_id", "segment_ids", "payload").mapInPandas(translate, "unit_id string, segment_id string, translated_text string")
