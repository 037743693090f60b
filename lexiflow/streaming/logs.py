"""Append-only logs as streams: current views, idempotent appends, scope digests."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def current_of(stream: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """The last row of each key by `order`, as a streaming aggregate of one struct a key."""
    return stream.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("_c")).select(key, "_c.*")


def read_log(spark: SparkSession, folder: str, schema, pattern: str = "*.parquet", files_a_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_a_trigger:
        reader = reader.option("maxFilesPerTrigger", files_a_trigger)
    return reader.parquet(folder)


def work_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own in spark.checkpoint.dir, which all executors share; a local one where that is unset on a local master."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named and (not context.master.startswith("local") or context.master.startswith("local-cluster")):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{(named or tempfile.mkdtemp(prefix='lexiflow-')).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def run_once(df: DataFrame, checkpoint: str | None = None, mode: str = "complete") -> DataFrame:
    """Run over what is there now, and give the result table of the last batch, as executors wrote it."""
    spark = df.sparkSession
    folder, last = work_folder(spark, "stream"), [spark.createDataFrame([], df.schema)]

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/{epoch}")
        last[0] = spark.read.schema(df.schema).parquet(f"{folder}/{epoch}")

    writer = df.writeStream.outputMode(mode).foreachBatch(write).trigger(availableNow=True)
    writer.option("checkpointLocation", checkpoint or f"{folder}/checkpoint").start().awaitTermination()
    return last[0]


def _idempotent(target: str) -> Callable[[DataFrame, int], None]:
    """Write a batch to a folder that its query and number name, so that a repeated batch takes its own place again."""

    def write(batch: DataFrame, epoch: int) -> None:
        query = batch.sparkSession.sparkContext._jsc.sc().getLocalProperty("sql.streaming.queryId")
        batch.write.mode("overwrite").parquet(f"{target}/_query={query}/_batch={epoch}")

    return write


def _exists(spark: SparkSession, folder: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(path)


def read_appended(spark: SparkSession, target: str) -> DataFrame:
    """What append_once has written, without the names of its folders."""
    return spark.read.option("basePath", target).parquet(f"{target}/_query=*").drop("_query", "_batch")


def append_once(stream: DataFrame, target: str, checkpoint: str, key: str = "id", expiry: str = "7 days") -> None:
    """Append rows to a Parquet log, each key once, also over restarts and repeated batches.

    A key seen is an entry of keyed state; no batch reads the target.  An entry goes
    when its row came in more than `expiry` ago, so the state holds the keys of that
    time alone; a key that comes again later is taken for new.  Time is that of
    arrival, so no row is too late.  Only where the checkpoint was lost does the
    first run leave out what the target has.
    """
    spark = stream.sparkSession
    if not _exists(spark, checkpoint) and _exists(spark, target):
        stream = stream.join(read_appended(spark, target).select(key), key, "left_anti").select(*stream.columns)
    seen = stream.withColumn("_arrived", F.current_timestamp()).withWatermark("_arrived", expiry).dropDuplicatesWithinWatermark([key]).drop("_arrived")
    seen.writeStream.outputMode("append").foreachBatch(_idempotent(target)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


class ScopeDigests(StatefulProcessor):
    """Keeps the current record of each ordinal of a scope, and gives the scope's digest whenever it changes.

    Rows: scope, ordinal, revision, record_id, required (the scope's number of
    segments), context (JSON, or null for none).
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.records = handle.getMapState("records", "ordinal long", "revision long, record_id string")
        self.told = handle.getValueState("told", "digest string, size long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        digest, size = self.told.get() if self.told.exists() else (None, 0)
        required, context, changed = None, None, False
        for batch in rows:
            for ordinal, revision, record, required, context in zip(batch["ordinal"], batch["revision"], batch["record_id"], batch["required"], batch["context"]):  # noqa: B007
                known = self.records.getValue((int(ordinal),)) if self.records.containsKey((int(ordinal),)) else None
                if known is None or revision > known[0]:  # of equal revisions the first counts
                    self.records.updateValue((int(ordinal),), (int(revision), str(record)))
                    size, changed = size + (known is None), True
        found = []
        if changed:
            if size == required:
                ids = [r[1] for _, r in sorted((k[0], v) for k, v in self.records.iterator())]
                text = "\x1f".join(ids) + ("" if context is None else "\x1e" + context)
                new = hashlib.sha256(text.encode()).hexdigest()
                found = [(key[0], new)] if new != digest else []
                digest = new
            self.told.update((digest, size))
        yield pd.DataFrame(found, columns=["scope", "digest"])

    def close(self) -> None:
        pass


@contextmanager
def rocks_state(spark: SparkSession):
    """Sessions with the state store that map state needs."""
    name, old = "spark.sql.streaming.stateStore.providerClass", spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, old)


def changed_digests(records: DataFrame) -> DataFrame:
    """(scope, digest) of the scopes whose digest each batch of records changes; records as ScopeDigests takes them.

    A scope without a record for each of its segments has no digest yet.  State:
    one entry a segment, spread by scope.
    """
    kind = records.schema["scope"].dataType.simpleString()
    return records.groupBy("scope").transformWithStateInPandas(ScopeDigests(), f"scope {kind}, digest string", "Update", "None")


def watch_scopes(records: DataFrame, target: str, checkpoint: str, handle: Callable[[DataFrame, int], None] | None = None) -> None:
    """Run over what is there now: each batch's changed digests go to target (also when a batch is repeated), and to handle."""
    write = _idempotent(target)

    def both(batch: DataFrame, epoch: int) -> None:
        numbered = batch.withColumn("number", F.lit(epoch)).persist()
        try:
            write(numbered, epoch)
            if handle:
                handle(numbered, epoch)
        finally:
            numbered.unpersist()

    with rocks_state(records.sparkSession):
        changed_digests(records).writeStream.outputMode("update").foreachBatch(both).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def last_digests(spark: SparkSession, target: str) -> DataFrame:
    """(scope, digest) as of the last batch that changed each scope."""
    return read_appended(spark, target).groupBy("scope").agg(F.max_by("digest", "number").alias("digest"))


def windowed_counts(stream: DataFrame, time: str, kinds: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Rows a kind and window; rows later than the watermark are dropped."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), kinds).agg(F.count("*").alias("n"))


def current_by_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The current record of each segment in the events log, through a stream."""
    schema = spark.read.parquet(f"{folder}/events.parquet").schema
    log = read_log(spark, folder, schema, "events.parquet").where("event_type <> 'error'")
    rows = log.select(F.col("user_id").alias("segment_id"), F.concat(F.lit("tr_"), F.col("event_id").cast("string")).alias("id"), F.col("event_type").alias("adapter"), "ts", "event_id")
    return run_once(current_of(rows, "segment_id", ["ts", "event_id"], ["id", "adapter"]))


def scope_digests_by_stream(spark: SparkSession, folder: str, scopes: int = 10) -> DataFrame:
    """The digest of each scope (users by their last digit) of the events log, through a stream with keyed state."""
    events = spark.read.parquet(f"{folder}/events.parquet")
    required = events.where("event_type <> 'error'").select("user_id").distinct().groupBy((F.col("user_id") % scopes).alias("scope")).agg(F.count("*").alias("required"))
    log = read_log(spark, folder, events.schema, "events.parquet").where("event_type <> 'error'")
    # the later of two events is the higher revision
    revision = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = log.select((F.col("user_id") % scopes).alias("scope"), F.col("user_id").alias("ordinal"), revision.alias("revision"), F.concat(F.lit("tr_"), F.col("event_id").cast("string")).alias("record_id"), F.lit(None).cast("string").alias("context"))
    target = work_folder(spark, "digests")
    watch_scopes(rows.join(required, "scope"), target, f"{target}-checkpoint")
    return last_digests(spark, target)
