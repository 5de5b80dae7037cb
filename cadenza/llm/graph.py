"""Distributed connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.session import materialize


def connected_components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """Every node with an edge to another node, and the smallest node it reaches: (node, component).

    Alternates the large-star and small-star steps: each node hooks its neighbours to the smallest node it sees,
    until all edges point at roots. Rounds grow with the logarithm of the longest path. A hub's edges meet their
    minimum through a partial aggregate and a join that adaptive execution may split, and each round is written to
    the shared folder. Self-loops, nulls and repeated edges add nothing; no edges give an empty table.
    """
    pair = edges.select(F.col(left).alias("a"), F.col(right).alias("b")).filter("a <> b")
    now = materialize(pair.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), "edges")
    state = _state(now)
    while state[0]:
        both = now.select(F.col("hi").alias("a"), F.col("lo").alias("b")).unionAll(now.select("lo", "hi"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("hi"), F.col("m").alias("lo"))
        large = materialize(large.filter("hi <> lo").distinct(), "large-star")
        root = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(root, "hi").filter("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        now = materialize(small.unionAll(root.select("hi", F.col("m").alias("lo"))).distinct(), "small-star")
        before, state = state, _state(now)
        if before == state:
            break
    roots = now.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionAll(roots)


def _state(edges: DataFrame) -> tuple:
    """Row count and an order-free checksum: equal when a round changed nothing."""
    return tuple(edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(hi, lo))"), F.sum(F.expr("hash(lo, hi)"))).first())
