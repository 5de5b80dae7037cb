"""Item co-occurrence in session baskets and pointwise mutual information."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions import exprs as X


def split(plays: DataFrame, part: str, buckets: int = 10) -> DataFrame:
    """The train (bucket not 0), test (bucket 0) or all rows of a session split by hash."""
    if part == "all":
        return plays
    bucket = X.split_bucket(F.col("session_key"), buckets)
    return plays.filter(bucket == 0 if part == "test" else bucket != 0)


#: Plays of a task. Adaptive execution joins partitions by their compressed bytes, of which a play has few.
PLAYS = 1_000_000


def tasks(plays: DataFrame) -> int | None:
    """How many tasks baskets() needs for as many plays; None where Spark's own number is enough."""
    needed = -(-plays.count() // PLAYS)
    return needed if needed > int(plays.sparkSession.conf.get("spark.sql.shuffle.partitions")) else None


def baskets(plays: DataFrame, least: int = 2, most: int | None = 20, tasks: int | None = None) -> DataFrame:
    """(session_key, item) of the sessions whose number of distinct items lies within bounds; `tasks` bounds what one of them holds."""
    items = plays.select("session_key", "item").filter("session_key is not null and item is not null")
    items = items.repartition(tasks, "session_key", "item").distinct().repartition(tasks, "session_key") if tasks else items.distinct()
    sized = items.withColumn("n", F.count("*").over(Window.partitionBy("session_key"))).filter(F.col("n") >= least)
    return (sized.filter(F.col("n") <= most) if most else sized).select("session_key", "item")


def item_counts(basket_items: DataFrame) -> DataFrame:
    """(item, n): how many baskets have the item."""
    return basket_items.groupBy("item").agg(F.count("*").alias("n"))


def basket_report(plays: DataFrame, least: int = 2, most: int | None = 20) -> DataFrame:
    """One row: sessions, those used, too small and too large, and distinct items of the used ones."""
    size = plays.groupBy("session_key").agg(F.countDistinct("item").alias("n"))
    used = (F.col("n") >= least) & (F.col("n") <= (most or 2**31))
    report = size.agg(
        F.count("*").alias("sessions"),
        F.count_if(used).alias("used"),
        F.count_if(F.col("n") < least).alias("too_small"),
        F.count_if(F.col("n") > (most or 2**31)).alias("too_large"),
    )
    return report.crossJoin(baskets(plays, least, most).agg(F.countDistinct("item").alias("items")))


def pairs_of(first: DataFrame, basket_items: DataFrame) -> DataFrame:
    """(item_a, item_b, co_count) for items that share a basket, the smaller one among `first`, which has rows of the baskets."""
    a = first.select("session_key", F.col("item").alias("item_a"))
    b = basket_items.select("session_key", F.col("item").alias("item_b"))
    pairs = a.join(b, "session_key").filter("item_a < item_b")
    return pairs.groupBy("item_a", "item_b").agg(F.count("*").alias("co_count"))


def pair_counts(basket_items: DataFrame) -> DataFrame:
    """(item_a, item_b, co_count) for items that share a basket, the smaller first."""
    return pairs_of(basket_items, basket_items)


def scored(pairs: DataFrame, counts: DataFrame, total: DataFrame) -> DataFrame:
    """(item_a, item_b, co_count, pmi): log2 of a pair's share over the product of its items' shares, from the items'
    counts (item, n) and the one row (total) of the number of baskets."""
    pairs = pairs.join(counts.select(F.col("item").alias("item_a"), F.col("n").alias("na")), "item_a")
    pairs = pairs.join(counts.select(F.col("item").alias("item_b"), F.col("n").alias("nb")), "item_b")
    value = F.log2(F.col("co_count") * F.col("total") / (F.col("na").cast("double") * F.col("nb")))
    return pairs.crossJoin(F.broadcast(total)).select("item_a", "item_b", "co_count", F.round(value, 9).alias("pmi"))


def pmi(basket_items: DataFrame) -> DataFrame:
    """(item_a, item_b, co_count, pmi) of all pairs.

    Only the pair counts and the item counts are shuffled beyond the baskets; the number of baskets is one row.
    """
    counts = item_counts(basket_items)
    total = basket_items.agg(F.countDistinct("session_key").cast("double").alias("total"))
    return scored(pair_counts(basket_items), counts, total)


def neighbours(pairs: DataFrame) -> DataFrame:
    """Both directions of scored pairs: (item, neighbour, co_count, pmi)."""
    there = pairs.select(F.col("item_a").alias("item"), F.col("item_b").alias("neighbour"), "co_count", "pmi")
    return there.unionAll(pairs.select("item_b", "item_a", "co_count", "pmi"))


def dataset_hash(basket_items: DataFrame) -> DataFrame:
    """One row: baskets, and sha256 over all baskets' hashes in order.

    Each basket becomes one line, hashed where it is; a final hash covers the sorted hashes of 4096 groups of lines,
    so that no task holds all baskets.
    """
    items = F.array_join(F.array_sort(F.collect_set(F.col("item").cast("string"))), ",")
    lines = basket_items.groupBy("session_key").agg(F.sha2(F.concat(F.col("session_key").cast("string"), F.lit(":"), items), 256).alias("h"))
    groups = lines.groupBy(F.substring("h", 1, 3).alias("g")).agg(
        F.sha2(F.array_join(F.array_sort(F.collect_list("h")), "\n"), 256).alias("h"), F.count("*").alias("n")
    )
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("g", "h"))), lambda x: x["h"]), "\n")
    return groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("baskets"), F.sha2(joined, 256).alias("dataset_hash"))


def bucket_ledger(done: DataFrame, buckets: int) -> DataFrame:
    """(bucket, status) for every bucket: succeeded as recorded, assumed below the last one recorded, else pending."""
    last = done.agg(F.max("bucket").alias("last"))
    every = done.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    status = F.when(F.col("seen"), "succeeded").when(F.col("bucket") < F.col("last"), "assumed").otherwise("pending")
    seen = done.select("bucket").distinct().withColumn("seen", F.lit(True))
    return every.join(seen, "bucket", "left").crossJoin(F.broadcast(last)).select("bucket", status.alias("status"))
