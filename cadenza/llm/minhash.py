"""Near-duplicate documents by min-max hashing over word shingles."""

from __future__ import annotations

import functools
import math
import operator
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm import kernels
from cadenza.llm.graph import connected_components
from cadenza.session import materialize

#: Values in a band: the minimum and the maximum under each of three permutations.
BAND = 6
SKETCH_BITS = 2048


def bands_for(percent: int, miss: float = 1e-6) -> int:
    """Bands needed for two sets at the threshold to share none with at most this probability."""
    return math.ceil(math.log(miss) / math.log(1 - (percent / 100) ** BAND))


def _seeds(n: int) -> np.ndarray:
    return kernels.mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)


def _sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Slices of the rows with each row's distinct shingle hashes, sorted."""
    for part in kernels.slices(batches, "__text"):
        buf, offsets = kernels.flatten(kernels.column(part, "__text"))
        hashes, at = kernels.shingles(kernels.lower_ascii(buf), offsets, k)
        yield part, [np.unique(hashes[s:e]) for s, e in zip(at[:-1], at[1:], strict=True)]


def min_max(values: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """Per permutation the smallest and the largest permuted value, side by side."""
    low = np.full(len(seeds), np.iinfo(np.uint64).max, np.uint64)
    high = np.zeros(len(seeds), np.uint64)
    for at in range(0, len(values), 512):
        permuted = seeds[:, None] * values[None, at : at + 512]
        np.minimum(low, permuted.min(1), out=low)
        np.maximum(high, permuted.max(1), out=high)
    return np.stack([low, high], 1).ravel()


def signatures(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """(__id, n, k1, k2, bands): shingle count, a 128-bit key of the set, and its band keys (none for an empty set)."""
    n_bands = bands_for(percent)

    def run(batches):
        seeds = _seeds(n_bands * BAND // 2)
        salt = kernels.mix(np.arange(1, n_bands + 1, dtype=np.uint64))
        for part, sets in _sets(batches, k):
            keys, bands = np.zeros((2, len(sets)), np.uint64), []
            for row, values in enumerate(sets):
                if len(values):
                    keys[:, row] = kernels.mix(values).sum(), kernels.mix(values ^ np.uint64(0xA5A5A5A5)).sum()
                    key, signature = salt.copy(), min_max(values, seeds).reshape(n_bands, BAND)
                    for column in range(BAND):
                        key = kernels.mix(key * np.uint64(0x9E3779B97F4A7C15) + signature[:, column])
                    bands.append(key.view(np.int64))
                else:
                    bands.append(np.zeros(0, np.int64))
            lengths = np.array([len(b) for b in bands])
            listed = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32), np.concatenate(bands))
            sizes = pa.array([len(s) for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [kernels.column(part, "__id"), sizes, pa.array(keys[0].view(np.int64)), pa.array(keys[1].view(np.int64)), listed],
                names=["__id", "n", "k1", "k2", "bands"],
            )

    return docs.mapInArrow(run, "__id long, n long, k1 long, k2 long, bands array<long>")


def _full_sets(docs: DataFrame, k: int) -> DataFrame:
    def run(batches):
        for part, sets in _sets(batches, k):
            at = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            listed = pa.ListArray.from_arrays(at, np.concatenate(sets).view(np.int64))
            yield pa.RecordBatch.from_arrays([kernels.column(part, "__id"), listed], names=["__id", "shingles"])

    return docs.mapInArrow(run, "__id long, shingles array<long>")


def _sketches(sets: DataFrame) -> DataFrame:
    """(__id, bits): SKETCH_BITS in longs, the parity of the smallest and largest values under as many permutations.

    Two sets agree in a share of (1 + Jaccard) / 2 of the bits.
    """

    def run(batches: Iterator[pa.RecordBatch]):
        seeds = _seeds(SKETCH_BITS // 2)
        for batch in batches:
            rows = []
            for at in range(batch.num_rows):
                values = kernels.column(batch, "shingles").slice(at, 1).flatten().to_numpy().view(np.uint64)
                bits = kernels.mix(min_max(values, seeds)) & np.uint64(1)
                rows.append(np.packbits(bits.astype(np.uint8)).view(np.int64).tolist())
            listed = pa.array(rows, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([kernels.column(batch, "__id"), listed], names=["__id", "bits"])

    return sets.mapInArrow(run, "__id long, bits array<long>")


def _sum(terms):
    return functools.reduce(operator.add, terms)


def _near(a: str, b: str, percent: int):
    """Whether two sketches agree as much as all but 2e-8 of pairs at the threshold do."""
    p = (1 + percent / 100) / 2
    least = SKETCH_BITS * p - 5.5 * math.sqrt(SKETCH_BITS * p * (1 - p))
    differ = _sum([F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i])) for i in range(SKETCH_BITS // 64)])
    return differ <= int(SKETCH_BITS - least)


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets reach the threshold."""
    a = sets.select(F.col("__id").alias("a"), F.col("shingles").alias("sa"))
    b = sets.select(F.col("__id").alias("b"), F.col("shingles").alias("sb"))
    both = pairs.join(a, "a").join(b, "b").withColumn("shared", F.size(F.array_intersect("sa", "sb")).cast("long"))
    return both.filter(F.col("shared") * 100 >= (F.size("sa") + F.size("sb") - F.col("shared")) * percent).select("a", "b")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """Group documents whose sets of distinct k-word shingles have a Jaccard similarity of percent or more.

    Returns one row per input row: (id_col, n_shingles, component_id, kept). component_id is the smallest id reachable
    over links; kept marks the row that bears it. Text is lower-cased for A-Z; fewer than k words make one shingle; null
    or wordless text has none and is linked with nothing. Equal sets are one class and are never expanded into pairs.
    Repeated rows stay, in the component of their id. A null id is never kept, and may belong to its class's component.
    Other columns are ignored. A text of any length is read whole, by one task with some ten 8-byte values a byte. Ids must be numbers.

    Candidates come from min-max bands that miss a pair at the threshold with probability 1e-6; every link is confirmed on
    the full sets. In a bucket all members are first compared with the one that meets the most others, then with the
    smallest. Only where a bucket still holds several components, the members outside its largest one are compared
    with all others of other components, each pair in the first bucket that it shares, if sketches of SKETCH_BITS bits
    do not rule it out (of pairs at the threshold, 2e-8). Recall of a link at the threshold is so at least 1 - 1.1e-6, and
    more above it; a group of copies costs pairs in proportion to its size.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).alias("__text"))
    found = materialize(signatures(docs, k, percent), "signatures")
    classes = found.filter("n > 0").groupBy("k1", "k2", "n").agg(F.min("__id").alias("rep"))
    classes = materialize(classes, "classes")
    reps = found.select("__id", "bands", "n").join(classes.select(F.col("rep").alias("__id")), "__id", "left_semi")
    rows = reps.dropDuplicates(["__id"]).select(F.col("__id").alias("rep"), "n", F.posexplode("bands").alias("at", "band"))
    shared = rows.groupBy("band").agg(F.min("rep").alias("low"), F.count("*").alias("size")).filter("size > 1")
    members = materialize(rows.join(shared, "band"), "buckets")
    weights = members.groupBy("rep").agg(F.sum("size").alias("weight"))
    hubs = members.join(weights, "rep").groupBy("band").agg(F.max_by("rep", F.struct("weight", -F.col("rep"))).alias("hub"))
    members = materialize(members.join(hubs, "band"), "members")
    needed = members.select(F.col("rep").alias("__id")).distinct()
    sets = materialize(_full_sets(docs.join(needed, "__id", "left_semi").dropDuplicates(["__id"]), k), "sets")

    def within(pairs):  # sizes bound the similarity; a pair is listed once, the smaller id first
        fits = F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent
        return pairs.filter(fits).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    def star(active, centre):
        sizes = classes.select(F.col("rep").alias("b"), F.col("n").alias("nb"))
        pairs = active.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col(centre).alias("b"))
        return within(pairs.filter("a <> b").distinct().join(sizes, "b"))

    def labelled(links):
        """Components of the links, and the members of buckets that hold several of them."""
        roots = materialize(connected_components(links, "a", "b").withColumnRenamed("node", "rep"), "roots")
        there = members.join(roots, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
        split = there.groupBy("band").agg(F.min("component").alias("c0"), F.max("component").alias("c1"))
        return roots, materialize(there.join(split.filter("c0 < c1").select("band"), "band"), "active")

    tested = materialize(star(members, "hub"), "pairs")
    links = materialize(_confirmed(tested, sets, percent), "links")
    roots, active = labelled(links)
    if active.limit(1).count():
        ends = active.select("band", F.col("rep").alias("low"), F.col("component").alias("other"))
        again = star(active.join(ends, ["band", "low"]).filter("component <> other"), "low")
        again = materialize(again.join(tested, ["a", "b"], "left_anti"), "pairs")
        tested = tested.unionAll(again)
        links = materialize(links.unionAll(_confirmed(again, sets, percent)), "links")
        roots, active = labelled(links)
    if active.limit(1).count():
        sizes = active.groupBy("band", "component").count()
        most = sizes.groupBy("band").agg(F.max_by("component", F.struct("count", "component")).alias("main"))
        wanted = active.select(F.col("rep").alias("__id")).distinct()
        about = _sketches(sets.join(wanted, "__id", "left_semi"))
        about = about.join(found.select("__id", "bands").dropDuplicates(["__id"]), "__id")
        about = materialize(about.withColumnRenamed("__id", "rep"), "sketches")
        rows = active.join(most, "band").join(about, "rep")
        side = lambda x: rows.select(
            "band",
            *(F.col(c).alias(f"{c}_{x}") for c in ("rep", "n", "at", "component", "bits", "bands")),
            (F.col("component") == F.col("main")).alias(f"main_{x}"),
        )
        earlier = [
            (F.col("at_a") > i) & (F.col("bands_a")[i] == F.col("bands_b")[i]) for i in range(bands_for(percent) - 1)
        ]
        cross = side("a").filter("not main_a").join(side("b"), "band").filter(
            (F.col("component_a") != F.col("component_b"))
            & (F.col("main_b") | (F.col("rep_a") < F.col("rep_b")))
            & _near("bits_a", "bits_b", percent)
            & ~functools.reduce(operator.or_, earlier)
        )
        cross = within(cross.select(*(F.col(f"{c}_{x}").alias(y + x) for c, y in (("rep", ""), ("n", "n")) for x in "ab")))
        cross = cross.join(tested, ["a", "b"], "left_anti")
        links = materialize(links.unionAll(_confirmed(cross, sets, percent)), "links")
        roots = connected_components(links, "a", "b").withColumnRenamed("node", "rep")
    by_class = classes.join(roots, "rep", "left")
    by_class = by_class.select("k1", "k2", "n", F.coalesce("component", "rep").alias("component"))
    out = found.select("__id", "k1", "k2", "n").join(by_class, ["k1", "k2", "n"], "left")
    component = F.coalesce("component", "__id")
    return out.select(
        F.col("__id").alias(id_col),
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.coalesce(F.col("__id") == component, F.lit(False)).alias("kept"),
    )
