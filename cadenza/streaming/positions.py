"""Files of JSON lines as a stream whose progress is a position, with counters that later runs carry on.

The stream's offset is (file, byte): the lines before it have been taken. A batch takes whatever has come since, as many byte ranges
in parallel as it needs; line numbers follow from the ranges' line counts and those that earlier batches carried.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader

from cadenza.operators import ingest
from cadenza.sources import packed
from cadenza.streaming import versions

#: Bytes at the end of a file in which the last line feed is sought at once.
TAIL_BYTES = 1 << 16
COUNTERS = ("rows", "accepted", "no_malformed", "no_user", "no_time", "no_metadata", "no_identity", "by_mbid", "by_msid", "unresolved")


def whole_lines(path: str, size: int) -> int:
    """The byte after the last line feed of a file; what follows is still being written."""
    fs, at = packed.file_system(path)
    with fs.open_input_file(at) as file:
        end = size
        while end > 0:
            begin = max(0, end - TAIL_BYTES)
            file.seek(begin)
            found = file.read(end - begin).rfind(b"\n")
            if found >= 0:
                return begin + found + 1
            end = begin
    return 0


class LineStreamReader(DataSourceStreamReader):
    """Files in the order of their names. All but the last are complete; the last may grow, and files may be added after it."""

    def __init__(self, options: dict):
        self.path, self.suffixes = options["path"], tuple(options.get("suffixes", ",".join(packed.LISTEN_SUFFIXES)).split(","))
        self.range_bytes = int(options.get("range_bytes", packed.RANGE_BYTES))

    def _files(self) -> list[tuple[str, int]]:
        try:
            return packed.listed(self.path, self.suffixes, below=True)
        except FileNotFoundError:
            return []

    def initialOffset(self):
        return {"origin": "", "byte": 0}

    def latestOffset(self):
        files = self._files()
        if not files:
            return self.initialOffset()
        origin, size = files[-1]
        return {"origin": origin, "byte": whole_lines(origin, size)}

    def partitions(self, start, end):
        out = []
        for origin, size in self._files():
            if start["origin"] <= origin <= end["origin"]:
                begin = start["byte"] if origin == start["origin"] else 0
                stop = end["byte"] if origin == end["origin"] else size
                for at in range(begin, stop, self.range_bytes):
                    out.append(packed.Range(origin, origin, 0, (begin, stop), at, min(at + self.range_bytes, stop)))
        return out

    def read(self, r):
        at = 0
        for origin, lines in packed._lines(r, ()):
            if lines:
                values = pa.array([x.removesuffix(b"\r").decode("utf-8", "replace") for x in lines], pa.string())
                n = len(lines)
                columns = [pa.array([origin] * n), pa.array([r.start] * n, pa.int64()), pa.array(range(at + 1, at + 1 + n), pa.int64()), values]
                yield pa.RecordBatch.from_arrays(columns, names=["origin", "block", "at", "value"])
                at += n

    def commit(self, end):
        pass

    def stop(self):
        pass


class LineStream(DataSource):
    """Options: path, suffixes of the files, joined by commas, and range_bytes."""

    @classmethod
    def name(cls):
        return "line_stream"

    def schema(self):
        return packed.SCHEMAS["lines"]

    def streamReader(self, schema):
        return LineStreamReader(self.options)


def lines(spark: SparkSession, path: str, range_bytes: int = packed.RANGE_BYTES, suffixes: tuple[str, ...] = packed.LISTEN_SUFFIXES) -> DataFrame:
    """The stream of (origin, block, at, value) of the files at and below a path; at counts from 1 within a range."""
    spark.dataSource.register(LineStream)
    return spark.readStream.format("line_stream").options(range_bytes=str(range_bytes), suffixes=",".join(suffixes)).load(path)


def ingest_listens(
    spark: SparkSession,
    path: str,
    root: str,
    checkpoint: str,
    start: tuple[str, int, int] | None = None,
    range_bytes: int = packed.RANGE_BYTES,
    suffixes: tuple[str, ...] = packed.LISTEN_SUFFIXES,
) -> None:
    """Parse the listens of all whole lines that have come since the last run, and stop.

    Each batch is one version below root: its parsed rows (origin, line, entry, …), and a state that carries the number of
    lines taken from each file, the counters of ingest.counters() over everything so far, and the last position (origin,
    line, entry). A batch that is run again after a failure replaces what it had written. start is a position of an earlier
    load, of which rows up to it are neither kept nor counted; a first batch without its file is an error.
    """
    stream = lines(spark, path, range_bytes, suffixes)
    states, rows_at = f"{root}/state", f"{root}/rows"

    def take(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        if number in versions.numbers(session, states):
            return
        carried = versions.read(session, states)
        sizes = batch.groupBy("origin", "block").agg(F.max("at").alias("n")).persist()
        done = sizes.select("origin").limit(0).withColumn("lines", F.lit(0).cast("long")) if carried is None else carried.filter("origin is not null").select("origin", "lines")
        # A row for each range and each file, not for each line.
        before = F.sum("n").over(Window.partitionBy("origin").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
        blocks = sizes.withColumn("inside", F.coalesce(before, F.lit(0))).join(done, "origin", "left")
        blocks = blocks.select("origin", "block", (F.col("inside") + F.coalesce("lines", F.lit(0))).alias("before"))
        numbered = batch.join(blocks, ["origin", "block"]).select("origin", (F.col("before") + F.col("at")).alias("line"), "value")
        parsed = ingest.parse(ingest.flatten(numbered))
        if start is not None:
            if carried is None and sizes.filter(F.col("origin").endswith(start[0])).isEmpty():
                raise ValueError(f"no rows come from {start[0]}")
            first = F.struct("origin", "line", "entry") > F.struct(F.lit(_origin(sizes, start[0])), F.lit(start[1]).cast("long"), F.lit(start[2]))
            parsed = parsed.filter(first) if carried is None else parsed
        parsed.write.mode("overwrite").parquet(f"{rows_at}/v={number}")
        written = session.read.schema(parsed.schema).parquet(f"{rows_at}/v={number}")
        now = ingest.counters(written).crossJoin(written.agg(F.max(F.struct("origin", "line", "entry")).alias("position")))
        if carried is not None:
            now = now.unionByName(carried.filter("origin is null").select(*now.columns))
        total = now.agg(F.max("position").alias("position"), *[F.sum(c).alias(c) for c in COUNTERS])
        per_file = done.unionAll(sizes.groupBy("origin").agg(F.sum("n").alias("lines"))).groupBy("origin").agg(F.sum("lines").alias("lines"))
        versions.write(per_file.unionByName(total, allowMissingColumns=True), states, number)
        sizes.unpersist()

    stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def _origin(sizes: DataFrame, name: str) -> str:
    found = sizes.filter(F.col("origin").endswith(name)).agg(F.min("origin")).first()[0]
    return found or name


def totals(spark: SparkSession, root: str) -> DataFrame:
    """One row: the counters over all batches and the last position."""
    return versions.read(spark, f"{root}/state").filter("origin is null").select("position", *COUNTERS)


def rows(spark: SparkSession, root: str) -> DataFrame:
    """The parsed rows of all finished batches; what an unfinished one has written does not count."""
    last = max(versions.numbers(spark, f"{root}/state"), default=-1)
    done = [n for n in versions.numbers(spark, f"{root}/rows") if n <= last]
    return spark.read.parquet(*[f"{root}/rows/v={n}" for n in done])
