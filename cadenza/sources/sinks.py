"""Writers: chunked CSV, idempotent partitions, upserts, versioned tables and metric files."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.functions import exprs as X
from cadenza.session import materialize


FINGERPRINT_BYTES = 1 << 20


def csv_chunks(df: DataFrame, path: str, key: str, parts: int = 128, rows: int = 250_000) -> None:
    """CSV files of at most `rows` rows below a folder for each hash partition of the key; \\N is null."""
    out = df.withColumn("part", X.partition_label(F.col(key), parts)).repartition(parts, "part")
    out.write.mode("overwrite").option("nullValue", "\\N").option("maxRecordsPerFile", rows).partitionBy("part").csv(path)


def read_csv_chunks(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema + ", part string").option("nullValue", "\\N").csv(path)


def overwrite_partitions(df: DataFrame, path: str, by: list[str]) -> None:
    """Replace only the partitions that df has rows for, so that a rerun of a load leaves the same table."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], rule: str = "update") -> DataFrame:
    """old with new's rows: `nothing` keeps old rows, `update` takes new values, `fill` takes them where old is null."""
    values = [c for c in old.columns if c not in keys]
    a = old.select(*keys, *[F.col(c).alias(f"old_{c}") for c in values], F.lit(True).alias("was"))
    b = new.select(*keys, *[F.col(c).alias(f"new_{c}") for c in values], F.lit(True).alias("is"))

    def value(c):
        if rule == "nothing":
            return F.when(F.col("was"), F.col(f"old_{c}")).otherwise(F.col(f"new_{c}"))
        if rule == "fill":
            return F.coalesce(f"old_{c}", f"new_{c}")
        return F.when(F.col("is"), F.col(f"new_{c}")).otherwise(F.col(f"old_{c}"))

    return a.join(b, keys, "full").select(*keys, *[value(c).alias(c) for c in values])


def merge(spark: SparkSession, path: str, new: DataFrame, keys: list[str], by: str, condition: Column | None = None) -> DataFrame:
    """Merge new rows into the table at path, which is partitioned by `by`, and return the changed rows with their action.

    A new row is inserted where its key is not there, and replaces the old one where condition holds, of columns named
    old_<name> and new_<name>; without a condition it always does. Of new rows with one key one, the greatest by its columns, counts.
    The partition column is part of the key, so a row cannot move. Only partitions with changed rows are written; the files of others stay as they are.
    """
    old = spark.read.parquet(path)
    keys = list(dict.fromkeys([*keys, by]))
    values = [c for c in old.columns if c not in keys]
    new = new.groupBy(*keys).agg(F.max(F.struct(*values)).alias("v")).select(*keys, "v.*")
    touched = [r[0] for r in new.select(by).distinct().collect()]  # a value for each partition
    mine = old.filter(F.col(by).isin(touched))
    a = mine.select(*keys, *[F.col(c).alias(f"old_{c}") for c in values], F.lit(True).alias("was"))
    b = new.select(*keys, *[F.col(c).cast(old.schema[c].dataType).alias(f"new_{c}") for c in values], F.lit(True).alias("now"))
    takes = F.coalesce(F.lit(True) if condition is None else condition, F.lit(False))
    action = F.when(F.col("was").isNull(), "insert").when(F.col("now") & takes, "update")
    both = materialize(a.join(b, keys, "full").withColumn("action", action), "merged")
    changed = both.filter("action is not null").select("action", *keys, *[F.col(f"new_{c}").alias(c) for c in values])
    written = [r[0] for r in changed.select(by).distinct().collect()]
    if written:
        pick = lambda c: F.when(F.col("action").isNotNull(), F.col(f"new_{c}")).otherwise(F.col(f"old_{c}")).alias(c)
        rows = both.filter(F.col(by).isin(written)).select(*[pick(c) if c in values else F.col(c) for c in old.columns])
        overwrite_partitions(rows, path, [by])
    return changed


def swap(df: DataFrame, root: str, version: str, by: list[str] | None = None, options: dict[str, str] | None = None) -> str:
    """Write df as a new version below root, then add a pointer to it; readers take the newest pointer, and none is ever
    deleted, so they never see a half-written table or no table. A pointer is a file named by its number; creating it fails
    where another writer was first, who then has the earlier number, so no version is lost."""
    path, spark = f"{root}/{version}", df.sparkSession
    df.write.mode("overwrite").options(**(options or {})).partitionBy(*(by or [])).parquet(path)
    files, folder = _pointers(spark, root)
    files.mkdirs(folder)
    number = max(_numbers(files, folder), default=0) + 1
    while True:
        place = spark._jvm.org.apache.hadoop.fs.Path(folder, f"{number:012d}")
        try:
            out = files.create(place, False)
        except Exception as e:
            if not files.exists(place):
                raise e
            number += 1
            continue
        out.write(bytearray(version.encode()))
        out.close()
        return path


def _pointers(spark: SparkSession, root: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/pointers")
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


def _numbers(files, folder) -> list[int]:
    if not files.exists(folder):
        return []
    names = [f.getPath().getName() for f in files.listStatus(folder) if f.getLen()]  # an empty one is being written
    return [int(n) for n in names if n.isdigit()]


def current(spark: SparkSession, root: str) -> DataFrame:
    files, folder = _pointers(spark, root)
    number = max(_numbers(files, folder), default=None)
    if number is None:
        raise ValueError(f"no version has been swapped in below {root}")
    version = spark.read.text(f"{root}/pointers/{number:012d}").first()[0]
    return spark.read.parquet(f"{root}/{version}")


def metric_file(lines: DataFrame, path: str) -> None:
    """A text file of metric lines in order."""
    lines.orderBy("line").coalesce(1).write.mode("overwrite").text(path)


def file_fingerprint(path: str, version: str) -> str:
    """fingerprint() of a file in any file system that pyarrow opens; only its ends are read."""
    from cadenza.sources.packed import file_system

    fs, at = file_system(path)
    with fs.open_input_file(at) as file:
        size = file.size()
        head = file.read(FINGERPRINT_BYTES)
        file.seek(max(0, size - FINGERPRINT_BYTES))
        return fingerprint(head, file.read(FINGERPRINT_BYTES), size, version)


def fingerprint(head: bytes, tail: bytes, size: int, version: str) -> str:
    """sha256 of a file's first and last MiB, its size and a version."""
    return hashlib.sha256(head + tail + str(size).encode() + version.encode()).hexdigest()


def manifest_fingerprint(manifest: dict) -> str:
    return hashlib.sha256(json.dumps(manifest, sort_keys=True).encode()).hexdigest()
