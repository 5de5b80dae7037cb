"""Runs that stop sending heartbeats, as a stream with a timer for each run."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from cadenza.session import new_path

EXPIRED = "run long, heartbeat long"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Expiry(StatefulProcessor):
    """Keeps each running run's last heartbeat (seconds) and sets a timer for when it will have been silent too long.

    A later heartbeat moves the timer, an end removes it; heartbeats that arrive out of order change nothing.
    """

    def __init__(self, seconds: int, since: int = 0):
        self.seconds, self.since = seconds, since

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "heartbeat long, ended boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        known = self.last.get() if self.last.exists() else None
        heartbeat, ended = (known[0], known[1]) if known else (None, False)
        for row in rows:
            heartbeat = row.heartbeat if heartbeat is None else max(heartbeat, row.heartbeat)
            ended = ended or row.status != "running"
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.last.update((heartbeat, ended))
        if not ended:
            # Silent for more than so many seconds: the first millisecond after them.
            self.handle.registerTimer((heartbeat - self.since + self.seconds) * 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        heartbeat = self.last.get()[0]
        self.last.update((heartbeat, True))
        yield Row(run=key[0], heartbeat=heartbeat)

    def close(self) -> None:
        pass


def expired(events: DataFrame, seconds: int = 1800, late: str = "0 seconds", since: int = 0) -> DataFrame:
    """(run, heartbeat): each running run once, when the watermark has passed its last heartbeat by more than `seconds`.

    events are (run, status, heartbeat in seconds). State and timers lie with the run's key, so they are dealt out like any shuffle.
    A watermark begins at 0, and what is not after it is dropped as late: heartbeats count from `since`, which lies before them all.
    """
    timed = events.withColumn("at", F.timestamp_seconds(F.col("heartbeat") - since)).withWatermark("at", late)
    return timed.groupBy("run").transformWithState(Expiry(seconds, since), EXPIRED, "Append", "EventTime")


def run_available(spark: SparkSession, source: str, out: str, checkpoint: str, seconds: int = 1800, late: str = "0 seconds", since: int = 0) -> None:
    """Process the events (run, status, heartbeat) that have come to a folder, and append the expired runs to out."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, PROVIDER)  # timers need it; a stream keeps the provider that it began with
    try:
        stream = spark.readStream.schema("run long, status string, heartbeat long").option("maxFilesPerTrigger", 8).parquet(source)
        expired(stream, seconds, late, since).writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out).awaitTermination()
    finally:
        spark.conf.set(key, before)


def demo(spark: SparkSession, events: DataFrame, now: int, seconds: int) -> DataFrame:
    """(run, status) of the events' runs as of a time, by the stream: running ones that expired by then have failed.

    The watermark stays behind all events, in whatever batches their files come, until the clock's own file.
    """
    source, out, check = (new_path(spark, f"beats-{x}") for x in ("in", "out", "check"))
    seen = events.filter(F.col("heartbeat") <= now)
    first, unused = seen.agg(F.coalesce(F.min("heartbeat"), F.lit(now)) - 1, F.coalesce(F.min("run"), F.lit(0)) - 1).first()
    seen.repartition(4, "run").write.parquet(source)
    run_available(spark, source, out, check, seconds, f"{now - first} seconds", first)
    tick = spark.createDataFrame([(unused, "ended", 2 * now - first)], "run long, status string, heartbeat long")  # the clock, not a run
    tick.write.mode("append").parquet(source)
    run_available(spark, source, out, check, seconds, f"{now - first} seconds", first)
    gone = spark.read.schema(EXPIRED).parquet(out).select("run", F.lit("failed").alias("late"))
    return events.join(gone, "run", "left").select("run", F.coalesce("late", "status").alias("status"))
