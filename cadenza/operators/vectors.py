"""The exact most similar vectors without comparing all pairs: cells, the triangle inequality of angles, and partial results.

Every vector belongs to the cell of its nearest centre. A cell of radius r whose centre is at an angle a from a request holds
nothing nearer than a - r; where that is less like the request than the k-th found so far, the whole cell is left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_EVEN, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions import exprs as X
from cadenza.session import materialize

#: Centres, and vectors and requests of a block that is compared at once.
CELLS, BLOCK, ASKED = 64, 256, 64
#: Blocks of a cell that meet its requests in one task; each such split is dealt all requests of the cell once.
SPLIT = 64
#: Slack of bounds against rounding: a cell is left out only if it is worse by more.
SLACK = 1e-9


def rounded(values: np.ndarray) -> np.ndarray:
    """Cosines clipped to 0..1, in hundredths, rounded half-even by their decimal digits as Spark's bround does."""
    clipped = np.clip(values, 0.0, 1.0) * 100
    out = np.rint(clipped)
    for at in np.argwhere(np.abs(clipped - np.floor(clipped) - 0.5) < 1e-9):
        exact = Decimal(repr(float(np.clip(values[tuple(at)], 0.0, 1.0))))
        out[tuple(at)] = float((exact * 100).quantize(Decimal(1), ROUND_HALF_EVEN))
    return out


def _matrix(column: pa.Array, dimension: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dimension)


def _best(pairs: DataFrame, k: int, dimension: int, kind: str) -> DataFrame:
    """The k best (request, item, likeness) of each request in each pair of blocks (rows, asked).

    Products are added in the order of the entries, as a fold over the arrays would, so cosines have the same last digit.
    """

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for at in range(batch.num_rows):
                rows, asked = (batch.column(c).slice(at, 1).flatten() for c in ("rows", "asked"))
                items, requests = rows.field("item"), asked.field("request")
                x, q = _matrix(rows.field("vector"), dimension), _matrix(asked.field("vector"), dimension)
                dots = np.zeros((len(q), len(x)))
                for j in range(dimension):
                    dots += q[:, j, None] * x[None, :, j]
                norms = asked.field("norm").to_numpy()[:, None] * rows.field("norm").to_numpy()[None, :]
                likeness = rounded(dots / norms)
                names, own = items.to_pylist(), requests.to_pylist()
                place = np.empty(len(names), np.int64)
                place[sorted(range(len(names)), key=names.__getitem__)] = np.arange(len(names))
                where = {n: i for i, n in enumerate(names)}
                who, what = [], []
                for r, request in enumerate(own):
                    order = np.lexsort((place, -likeness[r]))
                    order = order[order != where.get(request, -1)][:k] if request in where else order[:k]
                    who.append(np.full(len(order), r))
                    what.append(order)
                who, what = np.concatenate(who), np.concatenate(what)
                out = [requests.take(pa.array(who)), items.take(pa.array(what)), pa.array(likeness[who, what] / 100)]
                yield pa.RecordBatch.from_arrays(out, names=["request", "item", "likeness"])

    return pairs.select("rows", "asked").mapInArrow(run, f"request {kind}, item {kind}, likeness double")


def _top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("request").orderBy(F.col("likeness").desc(), F.col("item"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def nearest(queries: DataFrame, vectors: DataFrame, k: int = 10, cells: int = CELLS) -> tuple[DataFrame, DataFrame]:
    """(request, item, likeness, rank), and one row (compared, pairs) that tells how many of all pairs were compared.

    queries and vectors are (item, vector), each item once; a request never finds itself, ties go by item. likeness is the cosine clipped to 0..1 and
    rounded half-even to two places; a zero vector, one with a null or a nan, and one of another length than the requests' longest
    is like nothing. Centres are `cells` vectors by hash, which the driver holds; cells are cut into blocks of bounded
    size, so a hot cell is many tasks, and each block returns at most k rows for a request. Every request is first compared with the cells nearest to it
    that hold over k vectors, then with those that the bound does not rule out.
    """
    spark, kind = vectors.sparkSession, vectors.schema["item"].dataType.simpleString()

    def usable(rows: DataFrame) -> DataFrame:
        wide = rows.select("item", F.col("vector").cast("array<double>").alias("vector"))
        return wide.withColumn("norm", F.sqrt(X.dot(F.col("vector"), F.col("vector")))).filter("norm > 0 and not isnan(norm) and norm < double('infinity')")

    asked, have = usable(queries), usable(vectors)
    dimension = asked.agg(F.max(F.size("vector"))).first()[0]
    nothing = spark.createDataFrame([], f"request {kind}, item {kind}, likeness double, rank int"), spark.createDataFrame([(0, 0)], "compared long, pairs long")
    if dimension is None:
        return nothing
    asked, have = asked.filter(F.size("vector") == dimension), have.filter(F.size("vector") == dimension)
    chosen = have.orderBy(F.xxhash64("item"), "item").limit(cells).select("vector", "norm").collect()
    if not chosen:
        return nothing
    centres = np.array([r["vector"] for r in chosen]) / np.array([[r["norm"]] for r in chosen])

    def angles(batch: pa.RecordBatch) -> np.ndarray:
        unit = _matrix(batch.column("vector"), dimension) / batch.column("norm").to_numpy()[:, None]
        return np.arccos(np.clip(unit @ centres.T, -1, 1))

    def assign(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            found = angles(batch)
            cell = found.argmin(1).astype(np.int32)
            extra = [pa.array(cell), pa.array(found[np.arange(len(cell)), cell])]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[*batch.schema.names, "cell", "angle"])

    placed = materialize(have.mapInArrow(assign, f"item {kind}, vector array<double>, norm double, cell int, angle double"), "cells")
    about = {r["cell"]: (r["n"], r["radius"]) for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("radius")).collect()}
    sizes = np.array([about.get(c, (0, 0.0))[0] for c in range(len(centres))])
    radii = np.array([about.get(c, (0, 0.0))[1] for c in range(len(centres))])
    parts = F.element_at(F.array(*[F.lit(int(-(-n // BLOCK)) or 1) for n in sizes]), F.col("cell") + 1)
    splits = F.element_at(F.array(*[F.lit(-(-int(-(-n // BLOCK)) // SPLIT) or 1) for n in sizes]), F.col("cell") + 1)
    blocks = placed.withColumn("salt", F.pmod(F.xxhash64("item"), parts)).groupBy("cell", "salt").agg(F.collect_list(F.struct("item", "vector", "norm")).alias("rows"))
    blocks = materialize(blocks.withColumn("split", F.pmod("salt", splits).cast("bigint")), "blocks")

    def bound(batches: Iterator[pa.RecordBatch]):
        """For each request how like it a cell's vectors can be, in hundredths, -1 for an empty cell; and the cells to begin with."""
        for batch in batches:
            found = angles(batch)
            best = np.cos(np.maximum(0, found - radii - SLACK)) + SLACK
            best = np.where(sizes > 0, np.ceil(np.clip(best, 0, 1) * 100 - 0.5 - 1e-6), -1.0)
            order = np.argsort(-best, axis=1, kind="stable")
            before = np.cumsum(sizes[order], axis=1) - sizes[order]
            first = [o[(b <= k) & (sizes[o] > 0)].tolist() for o, b in zip(order, before, strict=True)]
            columns = [batch.column("item"), batch.column("vector"), batch.column("norm"), pa.array(best.tolist()), pa.array(first, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, names=["request", "vector", "norm", "best", "first"])

    asked = materialize(asked.mapInArrow(bound, f"request {kind}, vector array<double>, norm double, best array<double>, first array<int>"), "asked")
    n_asked = asked.count()
    groups = F.pmod(F.xxhash64("request"), F.lit(max(1, -(-n_asked // ASKED))))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(sizes.sum()) // (BLOCK * SPLIT))

    def compared(rows: DataFrame) -> DataFrame:
        # Blocks and requests are dealt out by split and meet where they are; their pairs, of which there are as many as the product, are never moved.
        wanted = rows.withColumn("group", groups).groupBy("cell", "group").agg(F.collect_list(F.struct("request", "vector", "norm")).alias("asked"))
        wanted = wanted.withColumn("split", F.explode(F.sequence(F.lit(0).cast("bigint"), (splits - 1).cast("bigint")))).repartition(tasks, "cell", "split")
        return _best(blocks.repartition(tasks, "cell", "split").join(wanted, ["cell", "split"]), k, dimension, kind)

    columns = ["request", "vector", "norm"]
    found = materialize(_top(compared(asked.select(*columns, F.explode("first").alias("cell"))), k), "first")
    limits = found.groupBy("request").agg(F.when(F.count("*") == k, F.min("likeness")).alias("least"))
    rest = asked.join(limits, "request", "left").select(*columns, "first", F.coalesce(F.col("least") * 100, F.lit(0.0)).alias("least"), F.posexplode("best").alias("cell", "bound"))
    rest = rest.filter("bound >= round(least) and bound >= 0 and not array_contains(first, cell)").select(*columns, "cell")
    out = _top(found.drop("rank").unionAll(compared(rest)), k)
    held = F.element_at(F.array(*[F.lit(int(n)) for n in sizes]), F.col("cell") + 1).cast("long")
    work = asked.select(F.explode("first").alias("cell")).unionAll(rest.select("cell")).agg(F.coalesce(F.sum(held), F.lit(0)).alias("compared"))
    return out, work.withColumn("pairs", F.lit(int(sizes.sum()) * n_asked).cast("long"))
