"""Streams: following a source of files, and metering requests as they come.

A file stream sees new files only, so each trigger takes a full listing against the last published version: edits and removals are found as well.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from skeinflow.functions.session import ensure_checkpoint_dir
from skeinflow.operators import service, store

#: How late an event may come and still count.
LATENESS = "10 minutes"


def follow(spark: SparkSession, folder: str, discovered: Callable[[], DataFrame], root: str, apply: Callable[[DataFrame, DataFrame], dict[str, DataFrame]], checkpoint: str, interval: str = "1 second", once: bool = False):
    """Re-index whenever something happens in ``folder``: each batch diffs the listing against the published files and publishes what ``apply`` makes of it.

    Batches run one at a time; events between two triggers are one batch, which is what a pause between changes is for. Without changes nothing is published.
    """
    events = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").load(folder).select("path", "modificationTime")

    def batch(_: DataFrame, __: int) -> None:
        now = discovered()
        version = store.current_version(spark, root)
        then = store.read_version(spark, root, "files") if version else now.limit(0)
        changes = store.categorize(now, then)
        if not changes.filter("status <> 'unchanged'").isEmpty():
            store.publish(apply(changes, now), root)

    writer = events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)).start()


COUNTED = "org_id string, month string, queries long, tokens long"


def monthly_counters(events: DataFrame, lateness: str = LATENESS, keep: int = service.COUNTER_TTL) -> DataFrame:
    """(org_id, month, queries, tokens) of a stream of usage events, each time a counter changes; repeats within the lateness count once.

    A counter's state goes when the watermark is ``keep`` seconds past its last event, so the state holds the months of late only.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        queries, tokens, last = state.get if state.exists else (0, 0, 0)
        for p in parts:
            queries += int((p.event_type == "query").sum())
            tokens += int(p.tokens.sum())
            last = max(last, int(p.ms.max()))
        state.update((queries, tokens, last))
        state.setTimeoutTimestamp(max(last + keep * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame([(*key, queries, tokens)], columns=["org_id", "month", "queries", "tokens"])

    once = events.withWatermark("created_at", lateness).dropDuplicatesWithinWatermark(["id"])
    rows = once.select("org_id", F.date_format("created_at", "yyyy-MM").alias("month"), F.lower("event_type").alias("event_type"), F.coalesce(F.col("tokens_used").cast("long"), F.lit(0)).alias("tokens"), "created_at", F.unix_millis("created_at").alias("ms"))
    return rows.groupBy("org_id", "month").applyInPandasWithState(step, COUNTED, "queries long, tokens long, last long", "append", GroupStateTimeout.EventTimeTimeout)


def windowed_usage(events: DataFrame, window: str = "1 hour", lateness: str = LATENESS) -> DataFrame:
    """(org_id, start, requests, tokens) by tumbling windows; a window is final once the watermark has passed it."""
    w = F.window("created_at", window)
    rows = events.withWatermark("created_at", lateness).groupBy("org_id", w).agg(F.count(F.lit(1)).alias("requests"), F.coalesce(F.sum("tokens_used"), F.lit(0)).alias("tokens"))
    return rows.select("org_id", F.col("window.start").alias("start"), "requests", "tokens")


def bursts(events: DataFrame, quiet: str = "1 second", lateness: str = LATENESS) -> DataFrame:
    """(org_id, start, end, events): runs of events with no pause of ``quiet`` between them."""
    rows = events.withWatermark("created_at", lateness).groupBy("org_id", F.session_window("created_at", quiet).alias("w")).agg(F.count(F.lit(1)).alias("events"))
    return rows.select("org_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")


LIMITED = "org_id string, id string, requests int, allowed boolean"


def rate_limited(events: DataFrame, limit: int, seconds: int = 60, lateness: str = LATENESS) -> DataFrame:
    """Each request of a stream with the requests of its organisation in the last ``seconds`` and whether it is let through; repeats within the lateness count once.

    The state of an organisation is the times of that window only, and goes when the watermark says that nothing came for twice as long. Requests that are refused count too.
    """
    span = seconds * 1000

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        times = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(parts)).sort_values("ms", kind="stable")
        out = []
        # requests of one millisecond are counted together, as a window by time has it
        for ms, same in rows.groupby("ms", sort=True):
            times = [t for t in times if t > ms - span] + [int(ms)] * len(same)
            n = sum(t <= ms for t in times)
            out += [(key[0], i, n, n <= limit) for i in same.id]
        state.update((times,))
        state.setTimeoutTimestamp(max(times[-1] + 2 * span, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["org_id", "id", "requests", "allowed"])

    ms = F.floor(F.unix_micros("created_at") / 1000).alias("ms")
    rows = events.withWatermark("created_at", lateness).dropDuplicatesWithinWatermark(["id"]).select("org_id", "id", "created_at", ms)
    return rows.groupBy("org_id").applyInPandasWithState(step, LIMITED, "times array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """All that a stream gives for what is there now, with the number of its ``batch``; written to the shared folder by the stream's own tasks."""
    spark = stream.sparkSession
    ensure_checkpoint_dir(spark)
    base = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/stream-{uuid.uuid4().hex}"
    there = spark._jvm.org.apache.hadoop.fs.Path(base)
    files = there.getFileSystem(spark._jsc.hadoopConfiguration())
    files.deleteOnExit(there)
    write = lambda rows, n: rows.withColumn("batch", F.lit(n).cast("long")).write.mode("append").parquet(f"{base}/rows")
    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").foreachBatch(write).trigger(availableNow=True).start().awaitTermination()
    empty = spark.createDataFrame([], stream.schema).withColumn("batch", F.lit(0).cast("long"))
    if not files.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{base}/rows")):
        return empty
    return spark.read.schema(empty.schema).parquet(f"{base}/rows")
