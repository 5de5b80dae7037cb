"""Catalog queries: top lists, related items, completeness, search, maps, genres and shared lists."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions import exprs as X
from cadenza.session import materialize


def top_by_attribute(rows: DataFrame, group: str, attribute: str, tie: str, k: int = 5) -> DataFrame:
    """The k rows of each group with the largest number in a JSON attribute, those without one first: adds rank."""
    number = F.get_json_object("attributes", f"$.{attribute}").try_cast("bigint")
    order = Window.partitionBy(group).orderBy(number.desc_nulls_first(), F.col(tie))
    return rows.withColumn("number", number).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def related(members: DataFrame, node: str, group: str, k: int = 5) -> DataFrame:
    """(node, other, shared, rank): the k others that share most groups with each node, then by name.

    Nodes of the same groups are one class, and classes meet instead of nodes: whatever node asks, of a class only its first
    k + 1 members can be among the k best, so the work grows with the nodes and with the pairs of classes that share a group.
    """
    pairs = members.select(F.col(node).alias("node"), F.col(group).alias("group")).filter("node is not null and group is not null")
    classed = materialize(pairs.groupBy("node").agg(F.array_sort(F.collect_set("group")).alias("class")), "classes")
    by_name = Window.partitionBy("class").orderBy("other")
    firsts = classed.select("class", F.col("node").alias("other")).withColumn("at", F.row_number().over(by_name)).filter(F.col("at") <= k + 1)
    firsts = firsts.groupBy("class").agg(F.collect_list("other").alias("firsts"))
    member = firsts.select("class", F.explode("class").alias("group"))
    meet = member.join(member.withColumnRenamed("class", "near"), "group").groupBy("class", "near").agg(F.count("*").alias("shared"))
    near = meet.join(firsts.withColumnRenamed("class", "near"), "near").select("class", "shared", F.explode("firsts").alias("other"))
    best = Window.partitionBy("class").orderBy(F.col("shared").desc(), "other")
    near = near.withColumn("at", F.row_number().over(best)).filter(F.col("at") <= k + 1)
    near = near.groupBy("class").agg(F.array_sort(F.collect_list(F.struct("at", "other", "shared"))).alias("near"))
    others = F.slice(F.filter("near", lambda x: x["other"] != F.col("node")), 1, k)
    found = classed.join(near, "class").select("node", F.posexplode(others).alias("at", "found"))
    return found.select("node", "found.other", "found.shared", (F.col("at") + 1).alias("rank"))


def newest(rows: DataFrame, group: str, date: str, number: str, k: int = 5) -> DataFrame:
    order = Window.partitionBy(group).orderBy(F.col(date).desc(), F.col(number))
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def completeness(albums: DataFrame, tracks: DataFrame) -> DataFrame:
    """(artist, albums, complete, hydrated): an album is complete with as many distinct tracks as it expects; an artist is
    hydrated when all its albums are, so also with none. albums: (artist, album null where none, expected)."""
    have = tracks.groupBy("album").agg(F.countDistinct("track").alias("have"))
    done = F.coalesce("have", F.lit(0)) >= F.col("expected")
    out = albums.join(have, "album", "left").groupBy("artist").agg(
        F.countDistinct("album").alias("albums"), F.countDistinct(F.when(done, F.col("album"))).alias("complete")
    )
    return out.withColumn("hydrated", F.col("albums") == F.col("complete"))


def search(rows: DataFrame, columns: list[str], text: str, order: str, limit: int = 10) -> DataFrame:
    """Rows with the text in any of the columns, in any case (the limit is the feature)."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.lower(F.coalesce(c, F.lit(""))).contains(text.lower())
    return rows.filter(hit).orderBy(order).limit(limit)


def on_map(points: DataFrame, south: float, west: float, north: float, east: float, zoom: int, limit: int = 10_000) -> DataFrame:
    """Points (id, lat, lng, weight) inside a box whose weight a zoom level shows, heaviest first."""
    inside = F.col("lat").between(south, north) & F.col("lng").between(west, east)
    return points.filter(inside & (F.col("weight") >= X.detail_limit(F.lit(zoom)))).orderBy(F.col("weight").desc(), "id").limit(limit)


def cells(points: DataFrame, degrees: float) -> DataFrame:
    """(row, col, n, weight, lat, lng): points summed in square cells, with mean places."""
    at = lambda c: F.floor(F.col(c) / degrees).cast("bigint")
    return points.groupBy(at("lat").alias("row"), at("lng").alias("col")).agg(
        F.count("*").alias("n"), F.round(F.sum("weight"), 6).alias("weight"), F.round(F.avg("lat"), 6).alias("lat"), F.round(F.avg("lng"), 6).alias("lng")
    )


def hexes(points: DataFrame, around: int) -> DataFrame:
    """(row, col, n, weight, lat, lng): points summed in hexagons, `around` of them along a line of latitude, with mean places.

    Latitude and longitude are the plane; hexagons stand on a corner. Axial coordinates are rounded as cube coordinates, and told as row and
    column. Columns wrap around, so both sides of the 180th meridian meet, and all longitudes of a pole are one place.
    """
    size = 360 / (around * math.sqrt(3))
    y = F.col("lat").cast("double")
    x = F.when(F.abs(y) >= 90, F.lit(0.0)).otherwise(F.col("lng").cast("double"))
    whole = lambda c: F.floor(c + 0.5)
    at = points.withColumn("__q", (x * math.sqrt(3) / 3 - y / 3) / size).withColumn("__r", y * 2 / 3 / size)
    at = at.withColumn("__a", whole(F.col("__q"))).withColumn("__b", whole(F.col("__r"))).withColumn("__c", whole(-F.col("__q") - F.col("__r")))
    da, db, dc = F.abs(F.col("__a") - F.col("__q")), F.abs(F.col("__b") - F.col("__r")), F.abs(F.col("__c") + F.col("__q") + F.col("__r"))
    a = F.when((da > db) & (da > dc), -F.col("__b") - F.col("__c")).otherwise(F.col("__a"))
    b = F.when((da > db) & (da > dc), F.col("__b")).when(db > dc, -F.col("__a") - F.col("__c")).otherwise(F.col("__b"))
    column = F.pmod(a + F.floor(b / 2), F.lit(around)).cast("bigint")
    return at.groupBy(b.cast("bigint").alias("row"), column.alias("col")).agg(
        F.count("*").alias("n"), F.round(F.sum("weight"), 6).alias("weight"), F.round(F.avg("lat"), 6).alias("lat"), F.round(F.avg("lng"), 6).alias("lng")
    )


def fan_out(items: DataFrame, tracks: DataFrame, artists: DataFrame, genres: DataFrame) -> DataFrame:
    """(item, album, artist, genre): a row for each artist of an item's album and each of their genres, null where there is none.

    items (item, track), tracks (track, album), artists (album, artist), genres (artist, genre). An item whose track is not known has no row.
    """
    out = items.join(tracks, "track").join(artists, "album", "left").join(genres, "artist", "left")
    return out.select("item", "album", "artist", "genre")


def page(rows: DataFrame, order: str, number: int, size: int = 20) -> DataFrame:
    return rows.orderBy(order).offset(number * size).limit(size)


def joined_names(rows: DataFrame, key: str, name: str) -> DataFrame:
    """(key, names): distinct names in order, joined by a comma."""
    return rows.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set(name)), ", ").alias("names"))


def visible(lists: DataFrame, members: DataFrame) -> DataFrame:
    """(user, list): lists that a user owns or is a member of, each once."""
    return lists.select(F.col("owner").alias("user"), "list").unionAll(members.select("user", "list")).distinct()


def append_with_capacity(have: DataFrame, new: DataFrame, capacity: int) -> DataFrame:
    """(list, item, position) of the new items that are added: those not there yet, in order, up to the capacity."""
    size = have.groupBy("list").agg(F.max("position").alias("last"), F.count("*").alias("size"))
    first = new.groupBy("list", "item").agg(F.min("ordinal").alias("ordinal"))
    fresh = first.join(have, ["list", "item"], "left_anti").join(size, "list", "left")
    n = F.row_number().over(Window.partitionBy("list").orderBy("ordinal", "item"))
    placed = fresh.withColumn("n", n).filter(F.coalesce("size", F.lit(0)) + F.col("n") <= capacity)
    return placed.select("list", "item", (F.coalesce("last", F.lit(0)) + F.col("n")).cast("bigint").alias("position"))


def online(sessions: DataFrame, users: DataFrame, now: int) -> DataFrame:
    """Users with a session that has not expired, by name."""
    return users.join(sessions.filter(F.col("expires") > now).select("user"), "user", "left_semi").orderBy("name")


def sync_genres(names: DataFrame, have: DataFrame) -> DataFrame:
    """(name, genre_id, outcome) of the distinct stripped names: matched by id, then by name in any case, else created."""
    fresh = names.select(X.strip(F.col("name")).alias("name")).filter("name <> ''").distinct()
    fresh = fresh.withColumn("genre_id", F.concat(F.lit("genre:"), X.slug(F.col("name"))))
    by_id = have.select("genre_id", F.lit(True).alias("same_id")).distinct()
    by_name = have.select(F.lower("name").alias("low"), F.lit(True).alias("same_name")).distinct()
    out = fresh.join(by_id, "genre_id", "left").withColumn("low", F.lower("name")).join(by_name, "low", "left")
    return out.select("name", "genre_id", F.when(F.col("same_id"), "updated").when(F.col("same_name"), "renamed").otherwise("created").alias("outcome"))


def pending_features(tracks: DataFrame, done: DataFrame, size: int = 50) -> DataFrame:
    """(track, batch): tracks without features in order of artist, album and number, in batches.

    Batches number the tracks of each artist; a global number would pull all tracks through one task.
    """
    todo = tracks.join(done.select("track").distinct(), "track", "left_anti")
    n = F.row_number().over(Window.partitionBy("artist").orderBy("album", "number", "track"))
    return todo.select("artist", "track", F.floor((n - 1) / size).cast("bigint").alias("batch"))


def pending_batches(tracks: DataFrame, done: DataFrame, size: int = 50) -> DataFrame:
    """(track, batch): tracks without features, numbered over all artists in order of artist, album, number and track, in batches.

    Rows are dealt into ranges of that order; each task numbers its own, and a row a range tells what lies before it.
    """
    order = ("artist", "album", "number", "track")
    todo = tracks.join(done.select("track").distinct(), "track", "left_anti").select(*order)
    placed = materialize(todo.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "pending")
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    sums = placed.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(before, F.lit(0)).alias("before"))
    n = F.row_number().over(Window.partitionBy("part").orderBy(*order)) + F.col("before")
    return placed.join(F.broadcast(sums), "part").select("track", F.floor((n - 1) / size).cast("bigint").alias("batch"))


def seeded_profiles(spark, n: int, cities: list[tuple[str, float]], seed: int = 7) -> DataFrame:
    """n synthetic profiles (id, city, weight): cities drawn by weight; the same seed gives the same rows."""
    total, upper, pick = sum(w for _, w in cities), 0.0, F.lit(cities[-1][0])
    u = F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1_000_003)) / 1_000_003.0
    for name, weight in reversed(cities[:-1]):
        upper = sum(w for c, w in cities[: [c for c, _ in cities].index(name) + 1]) / total
        pick = F.when(u < upper, F.lit(name)).otherwise(pick)
    weight = F.pmod(F.xxhash64(F.lit(seed + 1), "id"), F.lit(1000)) / 1000.0
    return spark.range(n).select("id", pick.alias("city"), weight.alias("weight"))
