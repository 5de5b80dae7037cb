"""Rankers over item features, co-occurrence and vectors, and the registry that evaluation uses."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.operators.vectors import nearest
from cadenza.session import materialize


def top_k(scored: DataFrame, k: int, request: str = "request", item: str = "item", score: str = "score") -> DataFrame:
    """The k best items of each request by descending score, then item: adds rank."""
    order = Window.partitionBy(request).orderBy(F.col(score).desc(), F.col(item))
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


#: Hits of seeds and neighbours that a task sums, one request after another; it holds a block of neighbours and its sums alone.
HITS = 500_000_000
#: Neighbours of a block, seeds and blocks of them that a task collects, and items whose join is broadcast.
NEAR, ASKED, BROADCAST_ITEMS = 8_000_000, 2_000_000, 1_000_000
#: The setting by which Spark deals both sides of a join by all keys. It stays as the session has it.
ALL_KEYS = "spark.sql.requireAllClusterKeysForCoPartition"


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a block in the order of the item, as a row for each run of one item."""
    for batch in batches:
        if len(batch):
            items = batch.column("item").to_numpy(zero_copy_only=False)
            first = np.flatnonzero(np.concatenate([[True], items[1:] != items[:-1]]))
            ends = pa.array(np.append(first, len(batch)), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, batch.column(c)) for c in ("neighbour", "units", "co_count")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(first)) for c in ("block", "item")), *lists], names=["block", "item", "items", "units", "counts"])


def _ranges(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """All numbers from each first up to its last, that one excluded."""
    size = last - first
    return np.arange(size.sum()) + np.repeat(first - (np.cumsum(size) - size), size)


class _Block:
    """The neighbours of a block, told by their place in the order of all of them, and the sums of one request."""

    def __init__(self, batches: list[pa.RecordBatch]):
        column = lambda c: pa.chunked_array([b.column(c) for b in batches]).combine_chunks()
        items, self.near = column("item").to_numpy(zero_copy_only=False), column("items")
        lists = np.concatenate([[0], np.cumsum(self.near.value_lengths().to_numpy())])
        self.near, self.units, self.counts = self.near.flatten(), column("units").flatten().to_numpy(), column("counts").flatten().to_numpy()
        self.names, self.where, self.place = np.unique(self.near.to_numpy(zero_copy_only=False), return_index=True, return_inverse=True)
        order = np.argsort(items, kind="stable")
        self.items, self.first, self.last = items[order], lists[:-1][order], lists[1:][order]
        self.exact, self.fewer, self.seen = (np.zeros(len(self.names), t) for t in (np.int64, np.int64, bool))

    def best(self, seeds: np.ndarray, gone: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places, sums and counts of the k best neighbours of the seeds, without those that are gone."""
        rows = _ranges(np.searchsorted(self.items, seeds, "left"), np.searchsorted(self.items, seeds, "right"))
        ends = np.cumsum(self.last[rows] - self.first[rows])
        if not len(ends) or not ends[-1]:
            return (np.zeros(0, np.int64),) * 3
        for part in np.split(rows, np.flatnonzero(np.diff(ends // COMPARED)) + 1):
            hits = _ranges(self.first[part], self.last[part])
            place = self.place[hits]
            np.add.at(self.exact, place, self.units[hits])
            np.add.at(self.fewer, place, self.counts[hits])
            self.seen[place] = True
        met = np.flatnonzero(self.seen)
        column = np.minimum(np.searchsorted(self.names, gone), len(self.names) - 1)
        self.seen[column[self.names[column] == gone]] = False
        left = met[self.seen[met]]
        if len(left) > k:
            left = left[self.exact[left] >= np.partition(self.exact[left], len(left) - k)[len(left) - k]]
        # Places are in order, so a stable sort breaks ties by item.
        left = left[np.argsort(-self.exact[left], kind="stable")[:k]]
        found = left, self.exact[left], self.fewer[left]
        self.exact[met], self.fewer[met], self.seen[met] = 0, 0, False
        return found


def _best_of(cells: DataFrame, k: int) -> DataFrame:
    """(request, item, exact, co_count): the k best items of each request in each partition of cells, which has lists of neighbours
    (late 0, item, items, units, counts) before requests (late 1, request, seeds, items that never return)."""
    request, item = cells.schema["request"].dataType.simpleString(), cells.schema["items"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]):
        lists, block = [], None
        for batch in batches:
            early = int(np.count_nonzero(batch.column("late").to_numpy() == 0))
            if early:
                lists.append(batch.slice(0, early))
            batch = batch.slice(early)
            if not len(batch) or not (lists or block):
                continue
            if lists:
                block, lists = _Block(lists), []
            given = []
            for c in ("seeds", "items"):
                column = batch.column(c)
                given.append((column.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy())])))
            (seeds, s), (gone, g) = given
            found = [block.best(seeds[s[r] : s[r + 1]], gone[g[r] : g[r + 1]], k) for r in range(len(batch))]
            place, exact, count = (np.concatenate(x) for x in zip(*found, strict=True))
            who = np.repeat(np.arange(len(batch)), [len(x[0]) for x in found])
            columns = [batch.column("request").take(pa.array(who)), block.near.take(pa.array(block.where[place])), pa.array(exact), pa.array(count)]
            yield pa.RecordBatch.from_arrays(columns, names=["request", "item", "exact", "co_count"])

    return cells.mapInArrow(run, f"request {request}, item {item}, exact long, co_count long")


def _block_of(item: Column, bounds: list) -> Column:
    """The last block whose first neighbour, of bounds (block, neighbour) in order, does not come after the item."""
    if len(bounds) == 1:
        return F.lit(bounds[0][0])
    half = len(bounds) // 2
    return F.when(item < F.lit(bounds[half][1]), _block_of(item, bounds[:half])).otherwise(_block_of(item, bounds[half:]))


def cooccurrence(seeds: DataFrame, neighbours: DataFrame, exclude: DataFrame | None = None, k: int = 10) -> DataFrame:
    """(request, item, score, co_count, rank): the sum of PMI over a request's seeds; seeds and excludes never return.

    PMI counts in whole units of the ninth place, so sums are exact whatever the order of addition; ranks follow them, and score shows six places.
    Neighbours are divided by ranges into blocks that a task can hold, an item's as one row of arrays. A request goes once, as a row of its
    seeds, to each block that has neighbours of theirs, with those seeds and excludes that lie in the block. So hits are made and summed
    where the neighbours lie, and only the k best of a request and block are dealt out. How often a request is dealt out goes by the number
    of neighbours, not of hits; where a block has too many hits, its requests are divided among several tasks.
    """
    spark, kinds = seeds.sparkSession, {c: neighbours.schema[c].dataType for c in ("item", "neighbour")}
    empty = spark.createDataFrame([], f"request {seeds.schema['request'].dataType.simpleString()}, item {kinds['neighbour'].simpleString()}, score double, co_count long, rank int")
    seeds = seeds.select("request", F.col("item").cast(kinds["item"]).alias("item"))
    keys = seeds.select("item").distinct()
    near = neighbours.filter("item is not null and neighbour is not null")
    if keys.limit(BROADCAST_ITEMS + 1).count() <= BROADCAST_ITEMS:
        near = near.join(F.broadcast(keys), "item", "left_semi")
    units = F.coalesce(F.round(F.col("pmi") * 1e9).cast("bigint"), F.lit(0)).alias("units")
    near = near.select("item", "neighbour", units, F.coalesce(F.col("co_count").cast("bigint"), F.lit(0)).alias("co_count"))
    blocks = max(1, -(-near.count() // NEAR))
    ranged = near.repartitionByRange(blocks, "neighbour").sortWithinPartitions("item").withColumn("block", F.spark_partition_id())
    names = {c: t.simpleString() for c, t in kinds.items()}
    lists = materialize(ranged.mapInArrow(_lists, f"block int, item {names['item']}, items array<{names['neighbour']}>, units array<bigint>, counts array<bigint>"), "blocks")
    bounds = lists.groupBy("block").agg(F.min(F.array_min("items")).alias("first")).orderBy("block").collect()
    if not bounds:
        return empty
    homes = lists.groupBy("item").agg(F.sort_array(F.collect_set("block")).alias("blocks"), F.sum(F.size("items")).alias("degree"))
    homes = materialize(homes, "homes")
    asked = seeds.groupBy("item").agg(F.count("*").alias("n")).join(homes, "item")
    hits, places = (x or 0 for x in asked.agg(F.sum(F.col("n") * F.col("degree")), F.sum(F.col("n") * (1 + F.size("blocks")))).first())
    shares, tasks = max(1, -(-hits // (len(bounds) * HITS))), max(1, -(-places // ASKED))
    none = F.array().cast("array<int>")
    rows = seeds.join(homes.select("item", "blocks"), "item", "left").select("request", "item", F.coalesce("blocks", none).alias("blocks"))
    if exclude is not None:
        barred = exclude.join(seeds.select("request").distinct(), "request", "left_semi")
        rows = rows.unionAll(barred.select("request", F.col("item").cast(kinds["item"]), none))
    item = F.col("item").cast(kinds["neighbour"])
    seed = F.transform("blocks", lambda b: F.struct(b.alias("block"), F.col("item").alias("seed"), F.lit(None).cast(kinds["neighbour"]).alias("gone")))
    here = F.array(F.struct(_block_of(item, bounds).alias("block"), F.lit(None).cast(kinds["item"]).alias("seed"), item.alias("gone")))
    dealt = rows.filter("request is not null and item is not null").repartition(tasks, "request").select("request", F.inline(F.concat(seed, here)))
    requests = dealt.groupBy("request", "block").agg(F.collect_list("seed").alias("seeds"), F.collect_list("gone").alias("items")).filter(F.size("seeds") > 0)
    nothing = [F.lit(None).cast("array<bigint>").alias(c) for c in ("units", "counts")]
    share = F.explode(F.sequence(F.lit(0), F.lit(shares - 1))) if shares > 1 else F.lit(0)
    cell = (F.col("block") * shares + F.col("share")).alias("cell")
    given = lists.withColumn("share", share).select(cell, F.lit(0).alias("late"), F.lit(None).cast(seeds.schema["request"].dataType).alias("request"), "item", F.lit(None).cast(requests.schema["seeds"].dataType).alias("seeds"), "items", "units", "counts")
    turn = requests.withColumn("share", F.pmod(F.xxhash64("request"), F.lit(shares)).cast("int"))
    cells = given.unionAll(turn.select(cell, F.lit(1), "request", F.lit(None).cast(kinds["item"]), "seeds", "items", *nothing))
    cells = cells.repartitionById(blocks * shares, "cell").drop("cell").sortWithinPartitions("late")
    ranked = top_k(_best_of(cells, k), k, score="exact")
    score = F.round(F.col("exact").cast("decimal(20,0)") * F.lit(Decimal("1e-9")), 6).cast("double")
    return materialize(ranked.select("request", "item", score.alias("score"), "co_count", "rank"), "ranked")


#: Trials times hits of a basket's piece that are compared at once, and hits of a task.
COMPARED, DEALT = 8_000_000, 1_000_000


def _trials_of(pieces: DataFrame, k: int) -> DataFrame:
    """(session_key, held, item, exact, co_count, rank): the k best items of each trial of baskets (session_key, seeds), where a seed has its neighbours in arrays."""
    session, seeds = pieces.schema["session_key"].dataType, pieces.schema["seeds"].dataType.elementType
    kinds = [x.simpleString() for x in (session, seeds["seed"].dataType, seeds["items"].dataType.elementType)]

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            rows = batch.column("seeds")
            flat, ends = rows.flatten(), np.concatenate([[0], np.cumsum(rows.value_lengths().to_numpy())])
            own, lists = flat.field("seed"), flat.field("items")
            at = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
            near = lists.flatten()
            names, given = near.to_numpy(zero_copy_only=False), own.to_numpy(zero_copy_only=False)
            units, counts = (flat.field(c).flatten().to_numpy() for c in ("units", "counts"))
            out = []
            for b in range(len(rows)):
                r, m = ends[b], ends[b + 1] - ends[b]
                first, last = at[r], at[r + m]
                if first == last:
                    continue
                who = np.repeat(np.arange(m), np.diff(at[r : r + m + 1]))
                items, where, place = np.unique(names[first:last], return_index=True, return_inverse=True)
                part, fewer, has = (np.zeros((m, len(items)), np.int64) for _ in range(3))
                for into, value in ((part, units[first:last]), (fewer, counts[first:last]), (has, 1)):
                    np.add.at(into, (who, place), value)
                left = part.sum(0) - part
                valid = has.sum(0) - has > 0
                column = np.minimum(np.searchsorted(items, given[r : r + m]), len(items) - 1)
                mine = np.flatnonzero(items[column] == given[r : r + m])
                again = valid[mine, column[mine]]
                valid[:, column[mine]] = False  # seeds never return, but in a trial of its own an item is none
                valid[mine, column[mine]] = again
                # Items are in order, so a stable sort breaks ties by item.
                best = np.argsort(np.where(valid, -left, np.iinfo(np.int64).max), axis=1, kind="stable")[:, :k]
                held, rank = np.nonzero(np.take_along_axis(valid, best, 1))
                best = best[held, rank]
                out.append((np.full(len(held), b), r + held, first + where[best], left[held, best], (fewer.sum(0) - fewer)[held, best], rank + 1))
            if out:
                b, held, item, exact, count, rank = (np.concatenate(x) for x in zip(*out, strict=True))
                columns = [batch.column("session_key").take(pa.array(b)), own.take(pa.array(held)), near.take(pa.array(item)), pa.array(exact), pa.array(count), pa.array(rank.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, names=["session_key", "held", "item", "exact", "co_count", "rank"])

    return pieces.mapInArrow(run, "session_key {}, held {}, item {}, exact long, co_count long, rank int".format(*kinds))


def leave_one_out(basket_items: DataFrame, neighbours: DataFrame, k: int = 10) -> DataFrame:
    """What cooccurrence() finds for the trials of evaluation.trials(): (request, item, score, co_count, rank).

    The trials of a basket share all seeds but one, so neighbours are summed once a basket and the held-out one's part is taken off. An item's neighbours
    are one row of arrays, the best first, where equal units lie together and compress; these rows are dealt out once, by basket, to as many tasks
    as the hits need. Where a basket has too many hits, lists are cut into pieces by neighbour, and the best of the pieces meet.
    """
    units = F.round(F.col("pmi") * 1e9).cast("bigint").alias("units")
    whole = materialize(basket_items.select("session_key", F.col("item").alias("seed")).distinct(), "baskets")
    degree = neighbours.groupBy(F.col("item").alias("seed")).agg(F.count("*").alias("degree"))
    sizes = whole.join(degree, "seed", "left").groupBy("session_key").agg(F.count("*").alias("m"), F.coalesce(F.sum("degree"), F.lit(0)).alias("hits"))
    row = sizes.filter("m >= 2").agg(F.sum("hits"), F.max(F.col("m") * F.col("hits"))).first()
    hits, most = row[0] or 0, row[1] or 0
    tasks, pieces = max(1, -(-hits // DEALT)), max(1, -(-most // COMPARED))
    piece = lambda c: F.pmod(F.xxhash64(c), F.lit(pieces)).cast("int") if pieces > 1 else F.lit(0)
    near = neighbours.select(F.col("item").alias("seed"), piece("neighbour").alias("piece"), "neighbour", units, F.col("co_count").cast("bigint").alias("co_count"))
    first = F.sort_array(F.collect_list(F.struct((-F.col("units")).alias("less"), "neighbour", "co_count"))).alias("x")
    near = near.repartition(tasks, "seed", "piece").groupBy("seed", "piece").agg(first)
    arrays = [F.col("x.neighbour").alias("items"), F.transform("x.less", lambda u: -u).alias("units"), F.col("x.co_count").alias("counts")]
    asked = whole.withColumn("piece", F.explode(F.sequence(F.lit(0), F.lit(pieces - 1)))).repartition(tasks, "seed", "piece")
    dealt = asked.join(near.select("seed", "piece", *arrays), ["seed", "piece"], "left")
    fields = ["seed", *(F.coalesce(c, F.array().cast(dealt.schema[c].dataType)).alias(c) for c in ("items", "units", "counts"))]
    groups = dealt.repartition(tasks, "session_key", "piece").groupBy("session_key", "piece").agg(F.collect_list(F.struct(*fields)).alias("seeds"))
    ranked = _trials_of(groups.filter(F.size("seeds") >= 2).select("session_key", "seeds"), k)
    if pieces > 1:
        order = Window.partitionBy("session_key", "held").orderBy(F.desc("exact"), "item")
        ranked = ranked.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    request = F.concat_ws("-", F.col("session_key").cast("string"), F.col("held").cast("string"))
    score = F.round(F.col("exact").cast("decimal(20,0)") * F.lit(Decimal("1e-9")), 6).cast("double")
    return ranked.select(request.alias("request"), "item", score.alias("score"), "co_count", "rank")


#: Parts of a list of items that are cut to their first ones before they meet.
PARTS = 64
#: How many items more than k the first round looks at, and how many times as many each next one.
SPARE, DEEPER = 6, 8
#: What a seed and an item may share, best first, and the score of it.
TIERS = (("artist", 1.0), ("album", 0.8), ("genre", 0.5))


def _merged(lists: DataFrame, key: str, by: str, most: int) -> DataFrame:
    """(key, list): the first `most` different items of all lists of a key, in order; parts of a key's rows, told by the column
    `by`, meet first, so no task holds them all."""
    first = lambda: F.slice(F.sort_array(F.array_distinct(F.flatten(F.collect_list("list")))), 1, most).alias("list")
    parts = lists.groupBy(key, F.pmod(F.xxhash64(by), F.lit(PARTS)).alias("part")).agg(first())
    return parts.groupBy(key).agg(first())


def _first_items(seeds: DataFrame, have: DataFrame, column: str, most: int) -> DataFrame:
    """(request, list): the first `most` items, in order, of all groups in `column` that a request's seeds belong to.

    The first ones of a union are among the first ones of its parts, so lists are cut at each step: a group's, those of
    an item's groups, those of a request's seeds. Pairs of requests and groups are never made.
    """
    order = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy("item"))
    # Two levels, so that no task sorts a whole list.
    parts = have.withColumn("part", F.pmod(F.xxhash64("item"), F.lit(PARTS))).withColumn("at", order(column, "part")).filter(F.col("at") <= most)
    groups = parts.withColumn("at", order(column)).filter(F.col("at") <= most).groupBy(column).agg(F.sort_array(F.collect_list("item")).alias("list"))
    items = _merged(have.join(seeds.select("item").distinct(), "item", "left_semi").join(groups, column), "item", column, most)
    return _merged(seeds.select("request", "item").join(items, "item"), "request", "item", most)


def metadata(seeds: DataFrame, features: DataFrame, k: int = 10, exclude: DataFrame | None = None) -> DataFrame:
    """(request, item, score, rank): 1.0 for a shared artist, 0.8 for an album, 0.5 for a genre, the largest counting.

    features has (item, album, artist, genre), several rows for an item. Three equi-joins stand for the disjunction, best
    first, and only requests with fewer than k items so far go on to the next. Ties go by item, so a request needs the first items of its
    lists alone: a few more than k, and where too many of these are its own seeds or excludes, more in a next round.
    """
    seeds = materialize(seeds.select("request", "item").distinct(), "seeds")
    gone = seeds if exclude is None else seeds.unionAll(exclude.join(seeds, "request", "left_semi").select("request", "item")).distinct()
    found = None
    for column, score in TIERS:
        asked, barred = seeds, gone
        if found is not None:
            full = found.groupBy("request").count().filter(F.col("count") >= k)
            asked, barred = seeds.join(full, "request", "left_anti"), gone.join(full, "request", "left_anti")
            if not asked.limit(1).count():
                break
        have = materialize(features.select("item", column).filter(F.col(column).isNotNull() & F.col("item").isNotNull()).distinct(), column)
        most, new = k + SPARE, None
        while True:
            lists = materialize(_first_items(asked, have, column, most), "lists")
            left = lists.select("request", F.size("list").alias("n"), F.explode("list").alias("item")).join(barred, ["request", "item"], "left_anti")
            left = materialize(left, "left")
            enough = left.groupBy("request").count().filter(F.col("count") >= k).select("request")
            open_ = lists.filter(F.size("list") == most).join(enough, "request", "left_anti").select("request")
            done = left.join(open_, "request", "left_anti").select("request", "item", F.lit(score).alias("score"))
            new = done if new is None else new.unionAll(done)
            if not open_.limit(1).count():
                break
            open_, most = materialize(open_, "open"), most * DEEPER
            asked, barred = asked.join(open_, "request", "left_semi"), barred.join(open_, "request", "left_semi")
        new = new if found is None else found.select("request", "item", "score").unionAll(new).groupBy("request", "item").agg(F.max("score").alias("score"))
        found = materialize(top_k(new, k), "found")
    return found


def similar_vectors(queries: DataFrame, vectors: DataFrame, k: int = 10) -> DataFrame:
    """(request, item, likeness, rank) by clipped, rounded cosine; a zero vector is like nothing. See vectors.nearest()."""
    return nearest(queries, vectors, k)[0]


def without_names(found: DataFrame, names: DataFrame) -> DataFrame:
    """The rows whose name, in any case, is not listed."""
    return found.join(names.select(F.lower("name").alias("__n")), F.lower(found["name"]) == F.col("__n"), "left_anti")


RANKERS: dict[str, Callable[..., DataFrame]] = {"cooccurrence": cooccurrence, "metadata": metadata}
