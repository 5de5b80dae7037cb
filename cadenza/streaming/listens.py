"""Streaming forms of listen ingestion: windows, exactly-once by signature, running upserts and ordered replay."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.operators import ingest
from cadenza.session import new_path
from cadenza.streaming import versions

LISTEN = "event_id long, user_name string, item string, at timestamp"


def replay(spark: SparkSession, path: str, schema: str, files: int = 1) -> DataFrame:
    """The Parquet files of a folder as a stream, oldest first, so many in a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def windows(events: DataFrame, minutes: int = 30, late: str = "1 hour") -> DataFrame:
    """(user_name, start, plays) in fixed windows; rows later than the watermark allows are left out."""
    counted = events.withWatermark("at", late).groupBy(F.window("at", f"{minutes} minutes"), "user_name").agg(F.count("*").alias("plays"))
    return counted.select("user_name", F.col("window.start").alias("start"), "plays")


def once(events: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """The first row of each key; the state of a key is kept for as long as the watermark allows rows to be late."""
    return events.withWatermark("at", late).dropDuplicatesWithinWatermark(keys)


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process what is there and stop; a second run with the same checkpoint goes on where the first one ended."""
    stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path).awaitTermination()


def run_to_table(stream: DataFrame, root: str, checkpoint: str, keys: list[str]) -> None:
    """Keep the result of an aggregation as a table below root: each batch's changed rows replace those of their keys.

    The stream runs in update mode, so it keeps state only as long as its watermark allows; rows that it no longer changes stay
    in the table. Each batch writes a new version; readers of the one before can finish and always find a table.
    """

    def merge(batch: DataFrame, number: int) -> None:
        if number in versions.numbers(batch.sparkSession, root):
            return
        old = versions.read(batch.sparkSession, root)
        changed = batch.persist()
        out = changed if old is None else old.join(changed.select(*keys), keys, "left_anti").unionByName(changed)
        versions.write(out, root, number)
        changed.unpersist()

    stream.writeStream.foreachBatch(merge).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def upsert_session_items(stream: DataFrame, root: str, checkpoint: str, buckets: int = 64) -> None:
    """Keep session aggregates with no bound on lateness: each batch is merged into the buckets of sessions that it touches.

    A batch writes its buckets as version v=<batch> below root, and other buckets stay as they are; an index tells each
    bucket's version, so no folders are listed. What a batch replaces is removed by the next one, so readers of the last index
    can finish. A batch that is run again after a failure finds its own index there and does nothing. A root is to keep its
    number of buckets.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if number in versions.numbers(spark, f"{root}/index"):
            return
        bucket = F.pmod(F.xxhash64("session_key"), F.lit(buckets)).cast("int").alias("bucket")
        batch.persist()
        new = ingest.session_items(batch)
        touched = {r.bucket for r in new.select(bucket).distinct().collect()}  # at most `buckets` rows
        have = _index(spark, root)
        old = [f"{root}/v={have[b]}/bucket={b}" for b in touched & set(have)]
        if old:
            new = ingest.merge_session_items(spark.read.option("basePath", root).parquet(*old).select(*new.columns), new)
        new.select("*", bucket).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{root}/v={number}")
        batch.unpersist()
        now = have | dict.fromkeys(touched, number)
        versions.write(spark.createDataFrame(sorted(now.items()), "bucket int, version long").coalesce(1), f"{root}/index", number)
        _retire(spark, root, [(have[b], b) for b in touched & set(have)])

    stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def _retire(spark: SparkSession, root: str, gone: list[tuple[int, int]]) -> None:
    """Remove the buckets' versions that nobody needed after the batch before, and note those (version, bucket) that nobody
    needs after this one. A version's folder goes with its last bucket."""
    files, left = versions.file_system(spark, f"{root}/left")
    files.mkdirs(left)
    for old in files.listStatus(left):
        version, bucket = old.getPath().getName().split("-")
        folder = versions.file_system(spark, f"{root}/v={version}")[1]
        files.delete(versions.file_system(spark, f"{root}/v={version}/bucket={bucket}")[1], True)
        if files.exists(folder) and not any(f.isDirectory() for f in files.listStatus(folder)):
            files.delete(folder, True)
        files.delete(old.getPath(), True)
    for version, bucket in gone:
        files.create(versions.file_system(spark, f"{root}/left/{version}-{bucket}")[1], True).close()


def _buckets(spark: SparkSession, root: str) -> dict[int, list[int]]:
    """The versions of each bucket that are there, ascending; for inspection, as reading and merging go by the index."""
    found: dict[int, list[int]] = {}
    for version in versions.numbers(spark, root):
        files, folder = versions.file_system(spark, f"{root}/v={version}")
        for f in files.listStatus(folder):
            if f.isDirectory():
                found.setdefault(int(f.getPath().getName().split("=")[1]), []).append(version)
    return found


def _index(spark: SparkSession, root: str) -> dict[int, int]:
    """The version of each bucket: a row a bucket, of which there is a fixed number."""
    found = versions.read(spark, f"{root}/index")
    return {} if found is None else {r.bucket: r.version for r in found.collect()}


def newest(spark: SparkSession, root: str) -> DataFrame:
    """The session aggregates below root: the newest version of each bucket."""
    paths = [f"{root}/v={version}/bucket={b}" for b, version in sorted(_index(spark, root).items())]
    return spark.read.option("basePath", root).parquet(*paths).drop("v", "bucket")


def demo(spark: SparkSession, events: DataFrame, kind: str) -> DataFrame:
    """Write events as files and run one of the streams over them; the result as a table."""
    source, out, check = (new_path(spark, f"stream-{x}") for x in ("in", "out", "check"))
    events.repartition(4, "user_name").write.parquet(source)
    stream = replay(spark, source, events.schema.simpleString()[7:-1].replace(":", " "), 2)
    if kind == "windows":
        run_to_table(windows(stream, 30, "100000 hours"), out, check, ["user_name", "start"])
        return versions.read(spark, out)
    if kind == "once":
        run_available(once(stream, ["user_name", "item"], "100000 hours").select("user_name", "item"), out, check)
        return spark.read.parquet(out)
    upsert_session_items(stream.select(F.col("user_name").alias("session_key"), "item", "at"), out, check)
    return newest(spark, out)
