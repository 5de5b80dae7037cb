"""Evidence between identifier systems: observations, conflicts, ISRCs and provider urls."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions import exprs as X
from cadenza.session import broadcast_up_to


def mappings(observations: DataFrame) -> DataFrame:
    """(msid, mbid, shards, first_shard, last_shard): each pair counts once in a shard."""
    once = observations.filter("msid is not null and mbid is not null").select("shard", "msid", "mbid").distinct()
    return once.groupBy("msid", "mbid").agg(
        F.count("*").alias("shards"), F.min("shard").alias("first_shard"), F.max("shard").alias("last_shard")
    )


def classify(pairs: DataFrame) -> DataFrame:
    """The mappings with status: conflict where an msid has several mbids, else active."""
    many = pairs.groupBy("msid").agg(F.count("*").alias("candidates"))
    return pairs.join(many, "msid").withColumn("status", F.when(F.col("candidates") > 1, "conflict").otherwise("active"))


def winners(pairs: DataFrame, items: DataFrame, least_shards: int = 2, least_share: float = 0.95) -> DataFrame:
    """(msid, mbid, winner_count, total, candidates, winner_share) of the leading mbids that may be promoted and whose item
    (key recording_mbid:<mbid>) exists. Where the leader has none, no other takes its place."""
    found = dominant(pairs, least_shards, least_share).filter("promoted").drop("promoted")
    targets = items.select("key").filter("key is not null")
    return found.join(targets, F.concat(F.lit("recording_mbid:"), found["mbid"]) == targets["key"], "left_semi")


def dominant(pairs: DataFrame, least_shards: int = 2, least_share: float = 0.95) -> DataFrame:
    """(msid, mbid, winner_count, total, candidates, winner_share, promoted): the leading mbid of each conflicting msid."""
    mine = Window.partitionBy("msid")
    ranked = pairs.select(
        "msid",
        "mbid",
        F.col("shards").alias("winner_count"),
        F.sum("shards").over(mine).alias("total"),
        F.count("*").over(mine).alias("candidates"),
        F.row_number().over(mine.orderBy(F.col("shards").desc(), "mbid")).alias("n"),
    )
    share = F.try_divide(F.col("winner_count").cast("double"), F.col("total"))
    return ranked.filter("n = 1 and candidates > 1").select(
        "msid", "mbid", "winner_count", "total", "candidates", F.round(share, 9).alias("winner_share"),
        ((F.col("winner_count") >= least_shards) & (share >= least_share)).alias("promoted"),
    )


def observation_report(observations: DataFrame) -> DataFrame:
    """One row: rows, mapped rows, distinct (shard, pair), distinct pairs, msids and conflicting msids."""
    mapped = F.col("mbid").isNotNull() & F.col("msid").isNotNull()
    pairs = classify(mappings(observations))
    head = observations.agg(
        F.count("*").alias("rows"),
        F.count_if(mapped).alias("mapped"),
        F.countDistinct(F.when(mapped, F.struct("shard", "msid", "mbid"))).alias("shard_pairs"),
    )
    tail = pairs.agg(
        F.count("*").alias("pairs"), F.countDistinct("msid").alias("msids"),
        F.countDistinct(F.when(F.col("status") == "conflict", F.col("msid"))).alias("conflicting"),
    )
    return head.crossJoin(tail)


def clean_isrcs(rows: DataFrame) -> DataFrame:
    """(item, isrc, valid) after dashes and blanks are stripped."""
    code = X.isrc_strip(F.col("isrc"))
    return rows.select("item", code.alias("isrc"), X.isrc_valid(code).alias("valid"))


def isrc_report(rows: DataFrame) -> DataFrame:
    """One row: rows, null or malformed ones, repeats of a valid pair, and distinct valid pairs."""
    clean = clean_isrcs(rows).agg(
        F.count("*").alias("rows"),
        F.count_if(~F.coalesce("valid", F.lit(False))).alias("invalid"),
        F.count_if("valid").alias("valid"),
        F.countDistinct(F.when(F.col("valid"), F.struct("item", "isrc"))).alias("pairs"),
    )
    return clean.withColumn("repeats", F.col("valid") - F.col("pairs"))


def unambiguous_isrcs(rows: DataFrame) -> DataFrame:
    """(isrc, item, alias_id) of the valid codes that a single item has."""
    by = clean_isrcs(rows).filter("valid").groupBy("isrc").agg(F.countDistinct("item").alias("n"), F.min("item").alias("item"))
    return by.filter("n = 1").select("isrc", "item", X.md5_uuid(F.concat(F.lit("isrc:recording:"), "isrc")).alias("alias_id"))


def isrc_aliases(codes: DataFrame, items: DataFrame, aliases: DataFrame) -> DataFrame:
    """(isrc, outcome): created, existing (an alias is never moved), ambiguous, or unresolved without such an item."""
    by = clean_isrcs(codes).filter("valid").groupBy("isrc").agg(F.countDistinct("item").alias("n"), F.min("item").alias("item"))
    known = items.select("item").distinct().withColumn("there", F.lit(True))
    have = aliases.select(F.col("skey").alias("isrc"), F.lit(True).alias("taken")).distinct()
    outcome = F.when(F.col("taken"), "existing").when(F.col("n") > 1, "ambiguous").when(F.col("there"), "created").otherwise("unresolved")
    return by.join(known, "item", "left").join(have, "isrc", "left").select("isrc", outcome.alias("outcome"))


#: Kinds of relations whose join is broadcast; more are joined by a shuffle.
BROADCAST_KINDS = 100_000


def url_evidence(urls: DataFrame, relations: DataFrame, links: DataFrame, kinds: DataFrame, recordings: DataFrame) -> DataFrame:
    """(mbid, url, url_md5, provider, link_type): recordings' urls through their relations, the smallest link type first.

    Types are few and come to the relations; of these each pair of recording and url keeps its smallest before it is dealt out.
    """
    typed = broadcast_up_to(links.join(broadcast_up_to(kinds, BROADCAST_KINDS), "type_id"), BROADCAST_KINDS)
    mine = relations.join(typed, "link_id").groupBy("recording_id", "url_id").agg(F.min(F.struct("type_id", "link_type")).alias("least"))
    least = mine.join(urls, "url_id").join(recordings, "recording_id").groupBy("mbid", "url").agg(F.min("least").alias("least"))
    return least.select("mbid", "url", F.md5("url").alias("url_md5"), X.ordered_match(F.col("url")).alias("provider"), "least.link_type")


def expand_graph(pairs: DataFrame, items: DataFrame) -> DataFrame:
    """Items to create for active mappings whose msid is no item yet and whose mbid is: (key)."""
    active = classify(pairs).filter("status = 'active'")
    mine = active.select(F.concat(F.lit("recording_msid:"), "msid").alias("key"), F.concat(F.lit("recording_mbid:"), "mbid").alias("target"))
    targets = items.select(F.col("key").alias("target"))
    return mine.join(targets, "target", "left_semi").join(items.select("key"), "key", "left_anti").select("key").distinct()
