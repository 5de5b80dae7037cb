"""A table of neighbour lists made for point reads: bucketed by item, sorted, with Bloom filters and small row groups."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.session import broadcast_up_to
from cadenza.sources import sinks

BUCKETS = 256
#: Bytes of a row group: what a point read unpacks of a file at least.
ROW_GROUP = 1 << 20
#: Items asked for whose join is broadcast, so that their buckets prune the scan.
BROADCAST_ITEMS = 1_000_000


def bucket_of(item: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(item.cast("string")), F.lit(buckets)).cast("int")


def write(rows: DataFrame, root: str, version: str, item: str = "item", buckets: int = BUCKETS) -> str:
    """Publish rows as a version below root: a folder a bucket of items, rows in the order of the item within each file.

    One shuffle by bucket; a hot bucket is dealt to several tasks by item, whose files are then sorted each.
    """
    placed = rows.withColumn("bucket", bucket_of(F.col(item), buckets)).hint("rebalance", "bucket", item).sortWithinPartitions("bucket", item)
    options = {f"parquet.bloom.filter.enabled#{item}": "true", "parquet.block.size": str(ROW_GROUP)}
    return sinks.swap(placed, root, version, by=["bucket"], options=options)


def points(spark: SparkSession, root: str, items: Iterable, item: str = "item", buckets: int = BUCKETS) -> DataFrame:
    """The rows of these few items: their buckets are known when the query is planned, so other folders are not listed into it,
    and in a file only row groups that may hold an item are read."""
    table = sinks.current(spark, root)
    kind = table.schema[item].dataType
    values = [F.lit(i).cast(kind) for i in items]
    if not values:
        return table.limit(0).drop("bucket")
    wanted = [r[0] for r in spark.range(1).select(F.explode(F.array(*[bucket_of(v, buckets) for v in values]))).distinct().collect()]
    return table.filter(F.col("bucket").isin(wanted) & F.col(item).isin(*values)).drop("bucket")


def matching(spark: SparkSession, root: str, asked: DataFrame, item: str = "item", buckets: int = BUCKETS) -> DataFrame:
    """The rows of all items that a batch of requests asks for; where these can be broadcast, buckets without any are not read."""
    table = sinks.current(spark, root)
    keys = asked.select(F.col(item)).distinct().withColumn("bucket", bucket_of(F.col(item), buckets))
    return table.join(broadcast_up_to(keys, BROADCAST_ITEMS), ["bucket", item], "left_semi").drop("bucket")
