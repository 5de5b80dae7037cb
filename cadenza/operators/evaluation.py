"""Leave-one-out evaluation of rankers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.operators import rankers


def sample_baskets(basket_items: DataFrame, most: int) -> DataFrame:
    """The first `most` sessions in key order (sampling is the feature here)."""
    keys = basket_items.select("session_key").distinct().orderBy("session_key").limit(most)
    return basket_items.join(keys, "session_key", "left_semi")


def trials(basket_items: DataFrame) -> DataFrame:
    """(request, held_out, seeds): each item of a basket of two or more held out once, the others sorted."""
    whole = basket_items.groupBy("session_key").agg(F.array_sort(F.collect_set("item")).alias("items")).filter(F.size("items") >= 2)
    out = whole.select("session_key", "items", F.explode("items").alias("held_out"))
    request = F.concat_ws("-", F.col("session_key").cast("string"), F.col("held_out").cast("string"))
    return out.select(request.alias("request"), "session_key", "held_out", F.array_remove("items", F.col("held_out")).alias("seeds"))


def ranked_trials(found: DataFrame, ranked: DataFrame) -> DataFrame:
    """(request, held_out, rank), rank null where the held-out item was not recommended."""
    return found.join(ranked.select("request", F.col("item").alias("held_out"), "rank"), ["request", "held_out"], "left")


def frequencies(basket_items: DataFrame) -> DataFrame:
    return basket_items.groupBy("item").agg(F.countDistinct("session_key").alias("n"))


def report(found: DataFrame, ranked: DataFrame, basket_items: DataFrame, catalog: DataFrame, k: int = 10, cold: int = 1) -> DataFrame:
    """One row: trials, cold trials, recall, ndcg, recall over items with at most `cold` baskets, and coverage."""
    hit = F.when(F.col("rank") <= k, F.lit(1.0)).otherwise(F.lit(0.0))
    gain = F.when(F.col("rank") <= k, 1.0 / F.log2(F.col("rank") + 1.0)).otherwise(F.lit(0.0))
    is_cold = F.col("n") <= cold
    judged = ranked_trials(found, ranked).join(frequencies(basket_items).withColumnRenamed("item", "held_out"), "held_out")
    scores = judged.agg(
        F.count("*").alias("trials"),
        F.count_if(is_cold).alias("cold_trials"),
        F.round(F.coalesce(F.avg(hit), F.lit(0.0)), 9).alias("recall"),
        F.round(F.coalesce(F.avg(gain), F.lit(0.0)), 9).alias("ndcg"),
        F.round(F.coalesce(F.avg(F.when(is_cold, hit)), F.lit(0.0)), 9).alias("cold_recall"),
    )
    shown = ranked.filter(F.col("rank") <= k).agg(F.countDistinct("item").alias("shown"))
    size = catalog.agg(F.countDistinct("item").alias("size"))
    coverage = F.round(F.coalesce(F.try_divide(F.col("shown").cast("double"), F.col("size")), F.lit(0.0)), 9)
    return scores.crossJoin(shown).crossJoin(size).select(*scores.columns, coverage.alias("coverage"))


def evaluate(basket_items: DataFrame, catalog: DataFrame, ranker: str = "cooccurrence", k: int = 10, **inputs) -> DataFrame:
    """Leave-one-out report of a registered ranker."""
    found = trials(basket_items)
    if ranker == "cooccurrence" and "exclude" not in inputs:
        ranked = rankers.leave_one_out(basket_items, k=k, **inputs)
    else:
        ranked = rankers.RANKERS[ranker](found.select("request", F.explode("seeds").alias("item")), k=k, **inputs)
    return report(found, ranked, basket_items, catalog, k)


def list_metrics(lists: DataFrame, k: int) -> DataFrame:
    """Recall and nDCG at k of (id, ranked, relevant) arrays, each ranked item counting once; empty lists give 0."""
    top = F.slice(F.array_distinct("ranked"), 1, k)
    hits = F.size(F.array_intersect(top, "relevant"))
    gains = F.aggregate(
        F.transform(top, lambda x, i: F.when(F.array_contains("relevant", x), 1.0 / F.log2(i + 2.0)).otherwise(F.lit(0.0))),
        F.lit(0.0),
        lambda s, x: s + x,
    )
    best = F.least(F.size(F.array_distinct("relevant")), F.lit(k))
    ideal = F.aggregate(F.transform(F.sequence(F.lit(1), F.greatest(best, F.lit(1))), lambda i: 1.0 / F.log2(i + 1.0)), F.lit(0.0), lambda s, x: s + x)
    some = (F.size("relevant") > 0) & (F.size("ranked") > 0)
    return lists.select(
        "id",
        F.when(some, F.round(hits / F.size(F.array_distinct("relevant")), 9)).otherwise(F.lit(0.0)).alias("recall"),
        F.when(some, F.round(gains / ideal, 9)).otherwise(F.lit(0.0)).alias("ndcg"),
    )
