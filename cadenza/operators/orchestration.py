"""Bookkeeping of runs: hydration queues, shards, partitions, progress and metric lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions import exprs as X


def hydration_seeds(isrcs: DataFrame, aliases: DataFrame, queued: DataFrame) -> DataFrame:
    """(item, isrc) of items that have a code, no provider alias and no place in the queue."""
    return isrcs.join(aliases.select("item"), "item", "left_anti").join(queued.select("item"), "item", "left_anti")


def claim(queue: DataFrame, now: int, limit: int) -> DataFrame:
    """The next items to work on: pending or due for retry, or running with an expired lease; by priority and id."""
    due = F.coalesce(F.col("next_at") <= now, F.lit(True))
    free = F.col("status").isin("pending", "retry") & due
    return queue.filter(free | ((F.col("status") == "running") & (F.col("lease_until") < now))).orderBy("priority", "id").limit(limit)


def hydration_outcomes(items: DataFrame, candidates: DataFrame, aliases: DataFrame) -> DataFrame:
    """(item, outcome, track): no_match, ambiguous (several tracks, or one that another item owns) or matched."""
    found = candidates.groupBy("item").agg(F.countDistinct("track").alias("n"), F.min("track").alias("track"))
    owner = aliases.groupBy("track").agg(F.min("item").alias("owner"))
    out = items.join(found, "item", "left").join(owner, "track", "left")
    outcome = (
        F.when(F.coalesce("n", F.lit(0)) == 0, "no_match").when(F.col("n") > 1, "ambiguous")
        .when(F.col("owner").isNotNull() & (F.col("owner") != F.col("item")), "ambiguous").otherwise("matched")
    )
    return out.select("item", outcome.alias("outcome"), F.when(outcome == "matched", F.col("track")).alias("track"))


def retries(failed: DataFrame, now: int) -> DataFrame:
    """(id, attempts, next_at): one more attempt after an exponential pause of an hour at most."""
    attempts = F.col("attempts") + 1
    return failed.select("id", attempts.alias("attempts"), (F.lit(now).cast("bigint") + X.backoff_seconds(attempts)).alias("next_at"))


def progress(shards: DataFrame) -> DataFrame:
    """One row for each run: shards by status, summed counters and finished bytes."""
    states = ("pending", "running", "succeeded", "failed")
    return shards.groupBy("run").agg(
        F.count("*").alias("shards"),
        *[F.count_if(F.col("status") == s).alias(s) for s in states],
        F.sum("rows").alias("rows"),
        F.coalesce(F.sum(F.when(F.col("status") == "succeeded", F.col("bytes"))), F.lit(0)).alias("done_bytes"),
    )


# The counters of a shard.
COUNTERS = ("source_row_count", "imported_row_count", "duplicate_row_count", "canonicalized_row_count", "unresolved_row_count", "malformed_row_count")


def dataset_progress(shards: DataFrame, counters: tuple[str, ...] = COUNTERS) -> DataFrame:
    """One row for each run: shards by status (any other status is pending), finished bytes and the sum of each counter."""
    named = {"succeeded": "completed", "running": "running", "failed": "failed"}
    status = F.coalesce("status", F.lit("pending"))
    return shards.groupBy("run").agg(
        F.count("*").alias("shard_count"),
        *[F.count_if(status == s).alias(f"{n}_shards") for s, n in named.items()],
        F.count_if(~status.isin(*named)).alias("pending_shards"),
        F.sum(F.when(status == "succeeded", F.coalesce("bytes", F.lit(0))).otherwise(0)).alias("completed_uncompressed_bytes"),
        *[F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in counters],
    )


def accumulated(base: DataFrame, phase: DataFrame, key: str, counters: list[str]) -> DataFrame:
    """The base snapshot of each key with a phase's counters added; a key in one of them alone counts as it is."""
    return base.select(key, *counters).unionByName(phase.select(key, *counters)).groupBy(key).agg(*[F.sum(c).alias(c) for c in counters])


def resume_by_type(rows: DataFrame, done: DataFrame) -> DataFrame:
    """The rows (type, id, …) past the last id that each type has finished (type, last); types not begun are whole."""
    last = done.groupBy("type").agg(F.max("last").alias("__last"))
    return rows.join(last, "type", "left").filter(F.coalesce(F.col("id") > F.col("__last"), F.lit(True))).drop("__last")


def labelled(metrics: DataFrame, labels: DataFrame) -> DataFrame:
    """Metrics with the labels of the same candidate, dataset and training run."""
    return metrics.join(labels, ["candidate_label", "dataset_hash", "training_run_id"])


def eta(progressed: DataFrame, elapsed: str) -> DataFrame:
    """Adds rate (rows a second) and eta_s from done, total and elapsed seconds; null without progress."""
    rate = F.try_divide(F.col("done").cast("double"), F.col(elapsed))
    left = F.greatest(F.col("total") - F.col("done"), F.lit(0))
    return progressed.withColumn("rate", F.round(rate, 6)).withColumn("eta_s", F.round(F.try_divide(left.cast("double"), rate), 6))


def reconcile(have: DataFrame, wanted: DataFrame) -> DataFrame:
    """(key, action): insert what is missing, delete what is obsolete, refuse to delete what is running."""
    gone = have.join(wanted.select("key"), "key", "left_anti")
    action = F.when(F.col("status") == "running", "refuse").otherwise("delete")
    return gone.select("key", action.alias("action")).unionAll(
        wanted.select("key").distinct().join(have.select("key"), "key", "left_anti").select("key", F.lit("insert").alias("action"))
    )


def dispatch(shards: DataFrame, parallelism: int, max_shards: int | None = None) -> DataFrame:
    """(run, key) to start next: pending, or failed in an earlier session, in key order, while slots are free.

    With max_shards a run only has its first so many shards by key, whatever their status; later ones wait for another run."""
    if max_shards is not None:
        place = F.row_number().over(Window.partitionBy("run").orderBy("key"))
        shards = shards.withColumn("place", place).filter(F.col("place") <= max_shards)
    running = shards.filter("status = 'running'").groupBy("run").agg(F.count("*").alias("running"))
    ready = shards.filter("status = 'pending' or (status = 'failed' and session < current)").join(running, "run", "left")
    n = F.row_number().over(Window.partitionBy("run").orderBy("key"))
    return ready.withColumn("n", n).filter(F.col("n") <= parallelism - F.coalesce("running", F.lit(0))).select("run", "key")


def skippable(shards: DataFrame, checkpoints: DataFrame, schema: int = 2) -> DataFrame:
    """Shards to work on: without a succeeded checkpoint of the same content and schema."""
    good = checkpoints.filter((F.col("status") == "succeeded") & (F.col("schema") >= schema))
    return shards.join(good.select("shard", "sha"), ["shard", "sha"], "left_anti")


def backlog(versions: DataFrame, processed: DataFrame, limit: int) -> DataFrame:
    """The oldest succeeded incremental versions that are not processed yet."""
    todo = versions.filter("status = 'succeeded' and mode <> 'full'").join(processed.select("version"), "version", "left_anti")
    return todo.orderBy("version").limit(limit)


def latest_run(runs: DataFrame) -> DataFrame:
    """(source, run): the newest completed run of each source, one with a manifest before one without."""
    done = runs.filter("status = 'completed'")
    return done.groupBy("source").agg(F.max_by("run", F.struct("has_manifest", "finished", "run")).alias("run"))


def stale(runs: DataFrame, now: int, seconds: int = 1800) -> DataFrame:
    """(run, status): running ones without a heartbeat for so long have failed."""
    old = (F.col("status") == "running") & (F.col("heartbeat") < now - seconds)
    return runs.select("run", F.when(old, "failed").otherwise(F.col("status")).alias("status"))


def inventory(aliases: DataFrame) -> DataFrame:
    """(source, status, n): aliases by source and by source and status (status null: all), as grouping sets."""
    both = aliases.groupBy("source", "status").agg(F.count("*").alias("n"))
    return both.unionAll(both.groupBy("source").agg(F.sum("n").alias("n")).select("source", F.lit(None).cast("string").alias("status"), "n"))


def inventory_lines(aliases: DataFrame) -> DataFrame:
    """Metric lines of the inventory, sorted."""
    rows = aliases.groupBy("source", "status").agg(F.count("*").alias("n"))
    return rows.select(X.metric_line("aliases_total", F.col("n"), source=F.col("source"), status=F.col("status")).alias("line")).orderBy("line")


def history(metrics: DataFrame) -> DataFrame:
    """(label, dataset, created, metrics…): the largest value of each metric in a run, a column for each."""
    names = ("recall", "ndcg", "coverage", "cold")
    return metrics.groupBy("label", "dataset").agg(*[F.max(F.when(F.col("metric") == m, F.col("value"))).alias(m) for m in names], F.max("created").alias("created"))


def sizes(tables: DataFrame) -> DataFrame:
    """(tier, tables, bytes) of tables by storage tier."""
    return tables.groupBy("tier").agg(F.count("*").alias("tables"), F.sum("bytes").alias("bytes"))


def missing_members(wanted: DataFrame, have: DataFrame, key: str) -> DataFrame:
    """One row: how many wanted keys are not there, and whether none is missing."""
    out = wanted.select(key).distinct().join(have.select(key).distinct(), key, "left_anti").agg(F.count("*").alias("missing"))
    return out.withColumn("complete", F.col("missing") == 0)
