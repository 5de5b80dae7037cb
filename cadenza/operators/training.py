"""Co-occurrence training in buckets of items that a ledger records, so that an ended run goes on with what is pending."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.operators import cooccurrence
from cadenza.streaming import versions


def bucket_of(item, buckets: int):
    return F.pmod(F.xxhash64(item), F.lit(buckets)).cast("int")


def recorded(spark: SparkSession, root: str) -> DataFrame:
    """(bucket) of the buckets whose pairs are written."""
    files, folder = versions.file_system(spark, f"{root}/ledger")
    names = [f.getPath().getName() for f in files.listStatus(folder)] if files.exists(folder) else []
    return spark.createDataFrame([(int(n),) for n in names if n.isdigit()], "bucket int")


def ledger(spark: SparkSession, root: str, buckets: int, start: int = 0) -> DataFrame:
    """(bucket, status): succeeded as recorded, assumed below the bucket that the run started at, else pending."""
    done = {r.bucket for r in recorded(spark, root).collect()}  # at most one row a bucket
    status = lambda b: "succeeded" if b in done else "assumed" if b < start else "pending"
    return spark.createDataFrame([(b, status(b)) for b in range(buckets)], "bucket int, status string")


def train(basket_items: DataFrame, root: str, buckets: int = 64, at_once: int = 8, start: int = 0, most: int | None = None) -> list[int]:
    """Write the PMI of the pairs of all pending buckets below root and return the buckets done, the first `most` of them.

    A pair belongs to the bucket of its smaller item. The first run writes the baskets, their item counts and their number
    below root; later runs read these, so all buckets see one dataset. Each job does `at_once` buckets; its rows are written before
    its ledger entries, one file a bucket. A run that ends in between leaves rows without an entry, which the next one replaces.
    """
    spark = basket_items.sparkSession
    files, _ = versions.file_system(spark, root)
    if not files.exists(versions.file_system(spark, f"{root}/counts/_SUCCESS")[1]):
        # A basket's items stay together, so a pair is made without another shuffle of the baskets.
        basket_items.select("session_key", "item").write.mode("overwrite").parquet(f"{root}/baskets")
        rows = spark.read.parquet(f"{root}/baskets")
        rows.agg(F.countDistinct("session_key").cast("double").alias("total")).write.mode("overwrite").parquet(f"{root}/total")
        rows.groupBy("item").agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{root}/counts")
    rows, counts, total = (spark.read.parquet(f"{root}/{name}") for name in ("baskets", "counts", "total"))
    todo = [r.bucket for r in ledger(spark, root, buckets, start).filter("status = 'pending'").orderBy("bucket").collect()][:most]
    for at in range(0, len(todo), at_once):
        part = todo[at : at + at_once]
        first = rows.filter(bucket_of(F.col("item"), buckets).isin(part))
        pairs = cooccurrence.scored(cooccurrence.pairs_of(first, rows), counts, total)
        placed = pairs.withColumn("bucket", bucket_of(F.col("item_a"), buckets))
        placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{root}/pairs")
        files.mkdirs(versions.file_system(spark, f"{root}/ledger")[1])
        for bucket in part:
            files.create(versions.file_system(spark, f"{root}/ledger/{bucket}")[1], True).close()
    return todo


def pairs(spark: SparkSession, root: str) -> DataFrame:
    """The scored pairs of the recorded buckets."""
    schema = "item_a long, item_b long, co_count long, pmi double, bucket int"
    found = spark.read.schema(schema).parquet(f"{root}/pairs").join(F.broadcast(recorded(spark, root)), "bucket", "left_semi")
    return found.drop("bucket")
