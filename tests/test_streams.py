"""Keyed state of the streams: appends over restarts and repeated batches, scope digests after every batch."""

import json
import shutil

import pytest
from lexiflow.operators import review, sequences
from lexiflow.streaming import logs
from pyspark.sql import functions as F

SCHEMA = "id string, scope string, ordinal long, revision long, status string"


@pytest.fixture(autouse=True)
def interpreted(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def written(spark, folder, name, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(folder / name))
    part = next((folder / name).glob("part-*"))
    shutil.move(part, folder / f"{name}.parquet")
    shutil.rmtree(folder / name)


def stream(spark, folder, **more):
    return logs.read_log(spark, str(folder), spark.createDataFrame([], SCHEMA).schema, **more)


def row(i, scope="a", ordinal=0, revision=1):
    return (f"tr_{i}", scope, ordinal, revision, "completed")


def ids(spark, target):
    return sorted(r.id for r in logs.read_appended(spark, target).collect())


def test_each_key_is_appended_once(spark, tmp_path, monkeypatch):
    log, target, checkpoint = tmp_path / "log", str(tmp_path / "target"), str(tmp_path / "checkpoint")
    log.mkdir()
    written(spark, log, "one", [row(1), row(2), row(2)])
    reads = []
    monkeypatch.setattr(logs, "read_appended", lambda *a, f=logs.read_appended: reads.append(a) or f(*a))
    logs.append_once(stream(spark, log), target, checkpoint)
    logs.append_once(stream(spark, log), target, checkpoint)  # a restart, nothing new
    written(spark, log, "two", [row(2), row(3)])  # a key again, in another file
    logs.append_once(stream(spark, log), target, checkpoint)
    assert not reads  # the target was not read back
    assert ids(spark, target) == ["tr_1", "tr_2", "tr_3"]
    # the batch is repeated: its end is not noted in the checkpoint
    commits = sorted((tmp_path / "checkpoint" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    commits[-1].unlink()
    (commits[-1].parent / f".{commits[-1].name}.crc").unlink(missing_ok=True)
    logs.append_once(stream(spark, log), target, checkpoint)
    assert ids(spark, target) == ["tr_1", "tr_2", "tr_3"]
    assert logs.read_appended(spark, target).columns == [f.split()[0] for f in SCHEMA.split(", ")]


def test_state_ends_with_the_expiry(spark, tmp_path):
    log, target, checkpoint = tmp_path / "log", str(tmp_path / "target"), str(tmp_path / "checkpoint")
    log.mkdir()

    def run(name, rows):
        written(spark, log, name, rows)
        logs.append_once(stream(spark, log), target, checkpoint, expiry="1 second")

    import time

    run("a", [row(k) for k in range(50)])
    time.sleep(1.5)
    run("b", [row(100)])
    time.sleep(1.5)
    run("c", [row(101)])
    assert ids(spark, target) == sorted([f"tr_{k}" for k in range(50)] + ["tr_100", "tr_101"])
    run("d", [row(0)])  # its entry is gone: taken for new
    assert ids(spark, target).count("tr_0") == 2


def test_digests_are_those_of_the_batch_after_every_batch(spark, tmp_path):
    """Records come in over batches, out of order, again and in new revisions; three scopes, one with a context."""
    log, target = tmp_path / "log", str(tmp_path / "digests")
    log.mkdir()
    segments = spark.createDataFrame([(f"{s}{k}", s, k) for s, n in (("a", 3), ("b", 2), ("c", 2)) for k in range(n)], "segment_id string, scope string, ordinal long")
    contexts = spark.createDataFrame([("b", json.dumps({"k": 1}))], "scope string, context string")
    batches = [
        [row(1, "a", 0), row(2, "b", 1), row(3, "b", 0)],
        [row(4, "a", 2), row(5, "a", 1), row(6, "b", 1, 2)],
        [row(4, "a", 2), row(7, "b", 1, 1), row(8, "c", 0)],  # nothing changes but c, which is not whole yet
        [row(9, "a", 0, 3), row(10, "a", 0, 2), row(11, "c", 1)],
    ]
    required = segments.groupBy("scope").agg(F.count("*").alias("required")).join(contexts, "scope", "left")
    seen, told = [], []
    for n, batch in enumerate(batches):
        written(spark, log, str(n), batch)
        seen += [(*r, len(seen) + k) for k, r in enumerate(batch)]
        records = stream(spark, log).select("scope", "ordinal", "revision", F.col("id").alias("record_id")).join(required, "scope")
        logs.watch_scopes(records, target, str(tmp_path / "checkpoint"), lambda b, e: told.append(sorted(r.scope for r in b.collect())))
        active = sequences.current(spark.createDataFrame(seen, SCHEMA + ", _pos long"), ["scope", "ordinal"])
        active = active.join(segments, ["scope", "ordinal"]).select("segment_id", "id")
        whole = review.scope_digests(segments, active, "scope", spark.createDataFrame([("b", json.dumps({"k": 1}))], "scope string, context string"))
        # scopes without a context have none in their digest
        bare = review.scope_digests(segments, active, "scope")
        want = {r.scope: r.digest for r in bare.collect() if r.scope != "b"} | {r.scope: r.digest for r in whole.collect() if r.scope == "b"}
        assert {r.scope: r.digest for r in logs.last_digests(spark, target).collect()} == want
        reviews = spark.createDataFrame([(s, d, d) for s, d in want.items() if s != "a"], "scope_id string, input_digest string, output_digest string")
        stale = review.stale_scopes(logs.last_digests(spark, target), reviews, "scope")
        assert {r.scope for r in stale.collect()} == {"a"} & set(want)
    assert told == [["b"], ["a", "b"], [], ["a", "c"]]
