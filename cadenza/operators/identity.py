"""The canonical item graph: identities, aliases, redirects and their conflicts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions import exprs as X
from cadenza.session import broadcast_up_to, materialize

MOST_HOPS = 8


def listen_identity(mbid: Column, msid: Column, provider: Column) -> Column:
    return X.first_identity(("recording_mbid", mbid), ("recording_msid", msid), ("spotify_track", provider))


def track_identity(mbid: Column, provider: Column, catalog: Column) -> Column:
    return X.first_identity(("recording_mbid", mbid), ("spotify_track", provider), ("catalog_track", catalog))


def canonical_key(identity: Column) -> Column:
    return F.concat(identity["type"], F.lit(":"), identity["key"])


def upsert_items(old: DataFrame, new: DataFrame) -> DataFrame:
    """(key, track, status) of both; an old track stays, a missing one is filled in."""
    both = old.select("key", F.col("track").alias("t0")).join(new.groupBy("key").agg(F.min("track").alias("t1")), "key", "full")
    seen = old.select("key").distinct().withColumn("known", F.lit(True))
    status = F.when(F.col("known").isNull(), "created").when(F.col("t0").isNull() & F.col("t1").isNotNull(), "filled").otherwise("unchanged")
    return both.join(seen, "key", "left").select("key", F.coalesce("t0", "t1").alias("track"), status.alias("status"))


def alias_conflicts(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """Each incoming alias (source, kind, skey, item, ordinal) with its outcome: the first of equal keys counts.

    incoming_duplicate: an earlier row has the key; existing_mapping: the key belongs to another item; else created, or
    existing where it is the same item.
    """
    key = ["source", "kind", "skey"]
    first = F.row_number().over(Window.partitionBy(*key).orderBy("ordinal")) == 1
    have = existing.groupBy(*key).agg(F.min("item").alias("owner"))
    outcome = (
        F.when(~F.col("first"), "incoming_duplicate")
        .when(F.col("owner").isNull(), "created")
        .when(F.col("owner") == F.col("item"), "existing")
        .otherwise("existing_mapping")
    )
    return incoming.withColumn("first", first).join(have, key, "left").select(*incoming.columns, outcome.alias("outcome"))


def self_aliases(items: DataFrame, existing: DataFrame, after: int | None = None) -> DataFrame:
    """Aliases that items have by their own key, those past `after` only: (item, kind, skey, alias_id, outcome)."""
    todo = items if after is None else items.filter(F.col("item") > after)
    have = existing.groupBy("kind", "skey").agg(F.min("item").alias("owner"))
    outcome = F.when(F.col("owner").isNull(), "created").when(F.col("owner") == F.col("item"), "existing").otherwise("conflict")
    name = F.concat(F.lit("canonical-alias:"), "kind", F.lit(":"), "skey")
    return todo.join(have, ["kind", "skey"], "left").select("item", "kind", "skey", X.md5_uuid(name).alias("alias_id"), outcome.alias("outcome"))


def upsert_redirects(old: DataFrame, new: DataFrame) -> DataFrame:
    """(from_id, to_id, status): a new target for a source that has another one is a conflict and keeps the old target;
    the same target becomes active again; loops onto oneself are not taken."""
    fresh = new.filter("from_id <> to_id").groupBy("from_id").agg(F.min("to_id").alias("new_to"))
    both = old.select("from_id", F.col("to_id").alias("old_to"), F.col("status").alias("old_status")).join(fresh, "from_id", "full")
    status = (
        F.when(F.col("old_to").isNull(), "active")
        .when(F.col("new_to").isNull(), F.col("old_status"))
        .when(F.col("new_to") == F.col("old_to"), "active")
        .otherwise("conflict")
    )
    return both.select("from_id", F.coalesce("old_to", "new_to").alias("to_id"), status.alias("status"))


def retire_missing(old: DataFrame, now: DataFrame) -> DataFrame:
    """(from_id, to_id, status) of the old redirects, retired where the pair is no longer among the candidates."""
    still = now.select("from_id", "to_id").distinct().withColumn("still", F.lit(True))
    status = F.when(F.col("still"), F.col("status")).otherwise("retired")
    return old.join(still, ["from_id", "to_id"], "left").select("from_id", "to_id", status.alias("status"))


def follow(starts: DataFrame, redirects: DataFrame, hops: int = MOST_HOPS) -> DataFrame:
    """(item, target, depth, cycle): where active redirects lead in at most `hops` steps; a cycle ends where it closes.

    One left join for each hop, so the plan is bounded and needs no driver loop over data.
    """
    edge = redirects.filter("status = 'active' and from_id <> to_id").groupBy("from_id").agg(F.min("to_id").alias("to_id"))
    now = starts.select("item").distinct().select(
        "item", F.col("item").alias("target"), F.lit(0).alias("depth"), F.array("item").alias("path"), F.lit(False).alias("cycle")
    )
    for _ in range(hops):
        step = now.join(edge, now["target"] == edge["from_id"], "left")
        closes = F.array_contains("path", F.col("to_id"))
        go = F.col("to_id").isNotNull() & ~F.col("cycle") & ~F.coalesce(closes, F.lit(False))
        now = step.select(
            "item",
            F.when(go, F.col("to_id")).otherwise(F.col("target")).alias("target"),
            F.when(go, F.col("depth") + 1).otherwise(F.col("depth")).alias("depth"),
            F.when(go, F.concat("path", F.array("to_id"))).otherwise(F.col("path")).alias("path"),
            (F.col("cycle") | F.coalesce(F.col("to_id").isNotNull() & closes, F.lit(False))).alias("cycle"),
        )
    return now.select("item", "target", "depth", "cycle")


def expand_seeds(seeds: DataFrame, redirects: DataFrame) -> DataFrame:
    """The seeds and the items that active redirects lead from to them, one hop: (request, item)."""
    back = redirects.filter("status = 'active'").select("from_id", F.col("to_id").alias("item"))
    return seeds.select("request", "item").unionAll(seeds.join(back, "item").select("request", "from_id")).distinct()


def redirected(rows: DataFrame, redirects: DataFrame) -> DataFrame:
    """The rows with item replaced by its active redirect's target, one hop."""
    hop = redirects.filter("status = 'active'").groupBy("from_id").agg(F.min("to_id").alias("to_id"))
    return rows.join(hop, rows["item"] == hop["from_id"], "left").withColumn("item", F.coalesce("to_id", "item")).drop("from_id", "to_id")


# Identifier kinds that a request may name.
ACCEPTED = (("spotify", "track"), ("isrc", "track"))


def resolve(requests: DataFrame, aliases: DataFrame, redirects: DataFrame) -> DataFrame:
    """(source, kind, skey, item, status): resolved with the redirected item, conflict, unresolved or invalid."""
    key = ["source", "kind", "skey"]
    asked = requests.select(*key).distinct()
    valid = F.lit(False)
    for source, kind in ACCEPTED:
        valid = valid | ((F.col("source") == source) & (F.col("kind") == kind))
    have = aliases.filter("status <> 'retired'").groupBy(*key).agg(
        F.min(F.when(F.col("status") == "active", F.col("item"))).alias("owner"), F.bool_or(F.col("status") == "conflict").alias("bad")
    )
    found = asked.join(have, key, "left")
    ends = follow(found.filter("owner is not null").select(F.col("owner").alias("item")), redirects)
    found = found.join(ends.select(F.col("item").alias("owner"), "target"), "owner", "left")
    status = (
        F.when(~valid | (F.coalesce(F.trim("skey"), F.lit("")) == ""), "invalid")
        .when(F.col("bad"), "conflict")
        .when(F.col("owner").isNotNull(), "resolved")
        .otherwise("unresolved")
    )
    return found.select(*key, status.alias("status"), "target").select(
        *key, "status", F.when(F.col("status") == "resolved", F.col("target")).alias("item")
    )


def first_occurrences(rows: DataFrame, key: list[str], ordinal: str) -> DataFrame:
    """The first row of each key in input order."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(ordinal))).filter("__n = 1").drop("__n")


def page_after(rows: DataFrame, key: str, last, size: int) -> DataFrame:
    """The next page by key (a page is the feature here)."""
    return rows.filter(F.col(key) > last).orderBy(key).limit(size)


def dictionary(pairs: DataFrame, key: str, value: str, ordinal: str) -> DataFrame:
    """(key, value) with each key once: the last writer wins."""
    return pairs.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(value, ordinal).alias(value))


def matched_tracks(events: DataFrame, by_mbid: DataFrame, by_provider: DataFrame, rows: int = 1_000_000) -> DataFrame:
    """The events (mbid, msid, provider_id, …) with candidate_type and track: a listen's own identifier decides which
    dictionary, (mbid, track) or (provider_id, track), is looked up; an msid has none. Small dictionaries are broadcast."""
    kind = listen_identity(F.col("mbid"), F.col("msid"), F.col("provider_id"))["type"]
    out = events.withColumn("candidate_type", F.coalesce(kind, F.lit("none")))
    out = out.join(broadcast_up_to(by_mbid.select("mbid", F.col("track").alias("__m")), rows), "mbid", "left")
    out = out.join(broadcast_up_to(by_provider.select("provider_id", F.col("track").alias("__p")), rows), "provider_id", "left")
    track = F.when(F.col("candidate_type") == "recording_mbid", F.col("__m")).when(F.col("candidate_type") == "spotify_track", F.col("__p"))
    return out.withColumn("track", track).drop("__m", "__p")


def track_assignments(tracks: DataFrame, external: DataFrame) -> DataFrame:
    """(item, source, kind, skey) of tracks (track, item, mbid, spotify, catalog) and their external ids (track, source,
    external_id): a row for each identifier that is not blank, equal ones once."""
    own = F.array(*[
        F.struct(F.lit(s).alias("source"), F.col(c).cast("string").alias("skey"))
        for s, c in (("musicbrainz", "mbid"), ("spotify", "spotify"), ("catalog", "catalog"))
    ])
    mine = tracks.select("item", F.inline(own))
    theirs = tracks.select("track", "item").join(external, "track").select("item", "source", F.col("external_id").alias("skey"))
    key = X.alias_key(F.col("source"), F.lit("track"), F.col("skey"))
    return mine.unionByName(theirs).select("item", key.alias("k")).filter("k is not null").select("item", "k.source", "k.kind", F.col("k.key").alias("skey")).distinct()


def serve(requests: DataFrame, aliases: DataFrame, redirects: DataFrame, rank: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """One row for each request of (request, role seed or exclude, source, kind, skey): the recommended items with score
    and rank, the numbers of seeds asked for and resolved, and the identifiers that did not resolve.

    rank takes seeds and excludes (request, item) and returns (request, item, score, rank). Requests without a resolved
    seed have no items. Lists hold what one request asked for and the ranker's k items, never a group of the catalog.
    """
    key = ["source", "kind", "skey"]
    asked = materialize(requests.join(resolve(requests, aliases, redirects), key, "left").withColumn("status", F.coalesce("status", F.lit("invalid"))), "asked")
    part = lambda role: asked.filter((F.col("role") == role) & F.col("item").isNotNull()).select("request", "item").distinct()
    lost = lambda role: F.array_sort(F.collect_set(F.when((F.col("role") == role) & F.col("item").isNull(), F.struct(*key, "status"))))
    seed = F.col("role") == "seed"
    heads = asked.groupBy("request").agg(
        F.count_if(seed).alias("requested_seed_count"),
        F.count_if(seed & F.col("item").isNotNull()).alias("resolved_seed_count"),
        lost("seed").alias("unresolved_seeds"),
        lost("exclude").alias("unresolved_excludes"),
    )
    lists = rank(part("seed"), part("exclude")).groupBy("request").agg(F.array_sort(F.collect_list(F.struct("rank", "item", "score"))).alias("items"))
    empty = F.array().cast("array<struct<rank:int,item:bigint,score:double>>")
    return heads.join(lists, "request", "left").withColumn("items", F.coalesce(F.col("items").cast("array<struct<rank:int,item:bigint,score:double>>"), empty))
