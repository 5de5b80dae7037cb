"""Readers: JSON lines in plain or gzip files, COPY text dumps, release lists and checksum files."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadenza.session import broadcast_up_to, materialize

#: Splits of files whose line counts are broadcast; more are joined by a shuffle.
BROADCAST_SPLITS = 1_000_000


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """(origin, line, value) of plain or .gz files; lines, which end at line feeds, are numbered from 1 within a file.

    Spark may read a plain file in several splits: rows are numbered within their split, and a first pass over the files
    counts what lies in the splits before.
    """
    read = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("origin"), F.col("_metadata.file_block_start").alias("block"), "value"
    )
    names = ["origin", "block", "at", "value"]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, at = None, 0
        for batch in batches:
            numbers = []
            for split in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                last, at = split, at + 1 if split == last else 1
                numbers.append(at)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(numbers, pa.int64()), batch.column(2)], names=names)

    numbered = read.mapInArrow(number, "origin string, block long, at long, value string")
    # A row for each split; a window holds those of one file.
    before = F.sum("n").over(Window.partitionBy("origin").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    splits = materialize(read.groupBy("origin", "block").agg(F.count("*").alias("n")), "splits")
    splits = splits.select("origin", "block", F.coalesce(before, F.lit(0)).alias("before"))
    out = numbered.join(broadcast_up_to(splits, BROADCAST_SPLITS), ["origin", "block"])
    return out.select("origin", (F.col("before") + F.col("at")).alias("line"), F.regexp_replace("value", "\r$", "").alias("value"))


def shard_manifest(lines: DataFrame) -> DataFrame:
    """(origin, year, month, rows, bytes, digest) of members named …/listens/<year>/<month>.listens.

    The digest adds up the lines' hashes, so that no task holds a member.
    """
    at = r"/listens/(\d{4})/(\d{1,2})\.listens$"
    rows = lines.select(
        "origin",
        F.regexp_extract("origin", at, 1).try_cast("int").alias("year"),
        F.regexp_extract("origin", at, 2).try_cast("int").alias("month"),
        F.octet_length("value").alias("size"),
        F.xxhash64("line", "value").alias("h"),
    )
    return rows.filter("year is not null").groupBy("origin", "year", "month").agg(
        F.count("*").alias("rows"), F.sum("size").alias("bytes"), F.lower(F.hex(F.bit_xor("h"))).alias("digest")
    )


#: A piece of a COPY field: an escape, or a run without one.
COPY_PIECE = r"(?s)\\.|[^\\]+|\\$"
# Escapes of the COPY text format; any other escaped character stands for itself.
ESCAPES = {"\\b": "\b", "\\f": "\f", "\\n": "\n", "\\r": "\r", "\\t": "\t", "\\v": "\u000b"}


def copy_fields(value: Column) -> Column:
    """The fields of a COPY text line: tab-separated, \\N for null, backslash escapes undone piece by piece."""

    def plain(piece: Column) -> Column:
        known = F.lit(None).cast("string")
        for code, char in ESCAPES.items():
            known = F.when(piece == code, F.lit(char)).otherwise(known)
        return F.coalesce(known, F.when(piece.rlike(r"(?s)^\\."), F.substring(piece, 2, 1)).otherwise(piece))

    def field(x: Column) -> Column:
        undone = F.concat_ws("", F.transform(F.regexp_extract_all(x, F.lit(COPY_PIECE), F.lit(0)), plain))
        return F.when(x != "\\N", F.when(F.contains(x, F.lit("\\")), undone).otherwise(x))

    return F.transform(F.split(value, "\t", -1), field)


def copy_table(lines: DataFrame, columns: list[str], required: tuple[str, ...] = ()) -> DataFrame:
    """Rows of a COPY dump (value) with the first columns named; short rows and null required columns are dropped."""
    read = lines.select(copy_fields(F.col("value")).alias("f")).filter(F.size("f") >= len(columns))
    out = read.select(*[F.col("f")[i].alias(c) for i, c in enumerate(columns)])
    for c in required:
        out = out.filter(F.col(c).isNotNull())
    return out


def require_members(members: dict[str, DataFrame], names: tuple[str, ...]) -> dict[str, DataFrame]:
    """The named members, or an error that lists the missing ones."""
    missing = sorted(set(names) - set(members))
    if missing:
        raise ValueError(f"members are missing: {', '.join(missing)}")
    return {n: members[n] for n in names}


RELEASE = r"listens-dump-(\d+)-(\d{8})-(\d{6})-(full|incremental)"


def releases(names: DataFrame, after: str | None = None) -> DataFrame:
    """(name, number, mode, released) of release names, oldest first, those newer than a time only; others are dropped."""
    part = lambda i: F.regexp_extract("name", RELEASE, i)
    rows = names.filter(F.col("name").rlike(RELEASE)).select(
        "name", part(1).cast("int").alias("number"), part(4).alias("mode"), F.try_to_timestamp(F.concat(part(2), part(3)), F.lit("yyyyMMddHHmmss")).alias("released")
    )
    rows = rows.filter("released is not null")
    return (rows if after is None else rows.filter(F.col("released") > F.lit(after).cast("timestamp"))).orderBy("released", "number")


def index_links(pages: DataFrame, html: str = "html") -> DataFrame:
    """(name) of every href in HTML index pages, without the last slash."""
    found = F.regexp_extract_all(F.col(html), F.lit(r'href="([^"]+)"'), F.lit(1))
    return pages.select(F.explode(found).alias("href")).select(F.regexp_replace("href", "/$", "").alias("name"))


def latest_release(rows: DataFrame) -> DataFrame:
    return rows.groupBy("mode").agg(F.max_by("name", F.struct("released", "number")).alias("name"))


def checksums(lines: DataFrame) -> DataFrame:
    """(file, sha256) of sha256sum lines."""
    at = r"^([0-9a-f]{64}) [ *](.+)$"
    return lines.filter(F.col("value").rlike(at)).select(F.regexp_extract("value", at, 2).alias("file"), F.regexp_extract("value", at, 1).alias("sha256"))


def required_bytes(compressed: Column, least: int, reserve: int = 80 << 30) -> Column:
    return F.greatest(F.lit(least).cast("bigint"), compressed + F.lit(reserve).cast("bigint"))
