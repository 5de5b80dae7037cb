"""Whitening of embeddings: leading eigenvectors of their covariance by a block Jacobi-Davidson method.

The covariance is never formed. A product with it is one Spark job over the distinct vectors, centred before they are
multiplied, for all columns of a block at once; what returns to the driver are a few vectors of the embeddings' dimension.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from cadenza.llm import kernels
from cadenza.session import materialize

#: An entry c becomes floor(SCALE * c) + OFFSET; entries of LARGEST or more count as not finite.
SCALE, OFFSET, LARGEST = 64, 1_000_000, 2.0**52
COMPONENTS = 16
#: Residuals, as parts of the largest eigenvalue, at which a pair is locked; and below which an eigenvalue counts as zero.
TOLERANCE = 64 * np.finfo(float).eps
#: Ritz values no further apart than this, as a part of the largest, count as one.
SAME = 1e-12
#: Steps of the inner MINRES, and columns of the search space, as multiples of the block, before it restarts.
INNER, SPACE = 4, 2.5
#: Rounds after which a residual that rounding holds above TOLERANCE is taken up to ROUGHEST; above that is an error.
OUTER, ROUGHEST = 60, 1e-11
#: Vectors that a task multiplies at once, in entries.
SLICE_ENTRIES = 1 << 19

Product = Callable[[np.ndarray], np.ndarray]


def _orthonormal(block: np.ndarray, against: np.ndarray) -> np.ndarray:
    """An orthonormal basis of the block's part outside the columns of `against`; directions that vanish are left out."""
    for _ in range(2):
        block = block - against @ (against.T @ block)
        block = block / np.maximum(np.linalg.norm(block, axis=0), np.finfo(float).tiny)
    u, s, _ = np.linalg.svd(block, full_matrices=False)
    u = u[:, s > 1e-8]
    u = u - against @ (against.T @ u)
    return np.linalg.qr(u)[0] if u.shape[1] else u


def minres(product: Product, shifts: np.ndarray, right: np.ndarray, project: Product, steps: int) -> np.ndarray:
    """For each column k an approximate solution t of P (A - shifts[k]) P t = right[k], by so many steps of MINRES.

    All columns share the products; each has its own Lanczos recurrence and plane rotations.
    """
    r = project(right)
    beta = np.linalg.norm(r, axis=0)
    live = beta > 0
    safe = lambda x: np.where(np.abs(x) > np.finfo(float).tiny, x, 1.0)
    v, v_old = r / safe(beta), np.zeros_like(r)
    t, w, w_old = np.zeros_like(r), np.zeros_like(r), np.zeros_like(r)
    eta, c, c_old, s, s_old = beta.copy(), np.ones_like(beta), np.ones_like(beta), np.zeros_like(beta), np.zeros_like(beta)
    previous = np.zeros_like(beta)
    for _ in range(steps):
        if not live.any():
            break
        p = project(product(v) - v * shifts)
        alpha = (v * p).sum(0)
        p = p - alpha * v - previous * v_old
        following = np.linalg.norm(p, axis=0)
        delta = c * alpha - c_old * s * previous
        rho1 = np.hypot(delta, following)
        rho2, rho3 = s * alpha + c_old * c * previous, s_old * previous
        live = live & (rho1 > np.finfo(float).tiny)
        c_old, s_old = c, s
        c, s = delta / safe(rho1), following / safe(rho1)
        w, w_old = (v - rho3 * w_old - rho2 * w) / safe(rho1), w
        t = np.where(live, t + c * eta * w, t)
        eta = -s * eta
        live = live & (following > 1e-14 * beta)
        v, v_old, previous = p / safe(following), v, following
    return t


def jacobi_davidson(product: Product, dimension: int, wanted: int, tolerance: float = TOLERANCE) -> tuple[np.ndarray, np.ndarray, float]:
    """The largest eigenvalues of a symmetric positive semidefinite operator, falling, their unit eigenvectors as columns,
    and the largest residual norm.

    Rayleigh-Ritz on a search space gives Ritz pairs; those whose residual is at most tolerance times the largest
    eigenvalue are locked, in falling order, and projected out. For the others the correction equations
    (I - QQ')(A - theta)(I - QQ') t = -r, Q the locked and the current Ritz vectors, are solved roughly by MINRES; the
    corrections widen the space. A full space is cut down to the best Ritz vectors. At most OUTER rounds; where the locked and
    the space reach the whole dimension, Ritz pairs are exact to rounding and locked as they are.
    """
    wanted = min(wanted, dimension)
    block = min(dimension, wanted + 4)
    random = np.random.default_rng(20)
    locked, values = np.zeros((dimension, 0)), np.zeros(0)
    space = _orthonormal(random.standard_normal((dimension, block)), locked)
    image = product(space)
    worst = 0.0
    for turn in range(OUTER):
        h = space.T @ image
        theta, vectors = np.linalg.eigh((h + h.T) / 2)
        theta, vectors = theta[::-1], vectors[:, ::-1]
        ritz, ritz_image = space @ vectors, image @ vectors
        residual = ritz_image - ritz * theta
        residual -= locked @ (locked.T @ residual)
        largest = max([*values[:1], theta[0], np.finfo(float).tiny])
        for group in np.split(np.arange(len(theta)), np.flatnonzero(-np.diff(theta) > SAME * largest) + 1):
            # Ritz vectors of one value are mixed at will; of their combinations those with the least residuals come first.
            turned = np.linalg.svd(residual[:, group], full_matrices=False)[2][::-1].T if len(group) > 1 else np.eye(1)
            ritz[:, group], ritz_image[:, group], residual[:, group] = ritz[:, group] @ turned, ritz_image[:, group] @ turned, residual[:, group] @ turned
        sizes = np.linalg.norm(residual, axis=0)
        complete = space.shape[1] + locked.shape[1] >= dimension
        limit = np.inf if complete else (tolerance if turn < OUTER - 1 else ROUGHEST) * largest
        done = 0
        while done < len(theta) and len(values) + done < wanted and sizes[done] <= limit:
            done += 1
        if done:
            worst = max(worst, sizes[:done].max())
            locked, values = np.hstack([locked, ritz[:, :done]]), np.append(values, theta[:done])
        left = wanted - len(values)
        if not left:
            break
        space, image = ritz[:, done:], ritz_image[:, done:]
        theta, residual = theta[done:], residual[:, done:]
        mine = min(block, left + 4, space.shape[1])
        outside = np.hstack([locked, space[:, :mine]])
        project = lambda x, q=outside: x - q @ (q.T @ x)
        active = np.linalg.norm(residual[:, :mine], axis=0) > tolerance * largest
        correction = minres(product, theta[:mine][active], -residual[:, :mine][:, active], project, INNER)
        keep = int(SPACE * block) - correction.shape[1]
        space, image = space[:, : max(mine, keep)], image[:, : max(mine, keep)]
        new = _orthonormal(correction, np.hstack([locked, space]))
        if not new.shape[1]:  # nothing new from the corrections: go on in directions drawn at random
            drawn = random.standard_normal((dimension, min(block, dimension - locked.shape[1] - space.shape[1])))
            new = _orthonormal(drawn, np.hstack([locked, space]))
        space, image = np.hstack([space, new]), np.hstack([image, product(new)])
    else:
        raise ArithmeticError(f"{len(values)} of {wanted} eigenpairs after {OUTER} rounds")
    order = np.argsort(-values, kind="stable")
    return values[order], locked[:, order], worst


def _vectors(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(__id, x): the rows whose vectors hold finite entries alone, as whole numbers."""
    rows = rows.select(F.col(id_col).alias("__id"), F.col(vector_col).cast("array<double>").alias("v"))
    # A NaN is larger than any number, so it fails too.
    finite = F.forall("v", lambda c: c.isNotNull() & (F.abs(c) < LARGEST))
    whole = F.transform("v", lambda c: F.when(F.abs(c) < LARGEST, F.floor(c * SCALE) + OFFSET))  # filters may run in any order
    return rows.filter(F.col("v").isNotNull() & finite).select("__id", whole.alias("x"))


def _slices(batches: Iterator[pa.RecordBatch], dimension: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """The batches in slices of bounded size, with their vectors as a matrix of whole numbers."""
    step = max(1, SLICE_ENTRIES // dimension)
    for whole in batches:
        for at in range(0, whole.num_rows, step):
            part = whole.slice(at, step)
            yield part, kernels.column(part, "x").flatten().to_numpy().reshape(part.num_rows, dimension)


class Population:
    """The distinct vectors: how many there are, their sums, and products with their centred rows as Spark jobs."""

    def __init__(self, fit: DataFrame, dimension: int):
        self.fit, self.dimension = fit, dimension
        found = self._summed(lambda _, x: [int(c) for c in x.astype(object).sum(0)] if abs(x).max(initial=0) > 1 << 40 else x.sum(0).tolist(), "decimal(38,0)", pa.decimal128(38))
        self.n = fit.count()
        self.sums = [int(found.get(i, 0)) for i in range(dimension)]
        # x - S / n as a difference of whole numbers and a fraction below 1, so that no digit is lost.
        whole = [s // self.n if self.n else 0 for s in self.sums]
        self.whole = np.array(whole, np.int64)
        self.fraction = np.array([(s - self.n * w) / self.n if self.n else 0.0 for s, w in zip(self.sums, whole, strict=True)])

    def _summed(self, values: Callable, kind: str = "double", arrow: pa.DataType | None = None) -> dict:
        """values(self, x) gives a list of numbers for each slice; their sums over all slices by position.

        Each task adds up its own slices; positions are then added by a shuffle, so what the driver gets does not grow with rows or tasks."""
        dimension = self.dimension
        centre = (getattr(self, "whole", None), getattr(self, "fraction", None))

        def run(batches: Iterator[pa.RecordBatch]):
            total = None
            for _, x in _slices(batches, dimension):
                got = values(centre, x)
                total = got if total is None else [a + b for a, b in zip(total, got, strict=True)] if isinstance(got, list) else total + got
            if total is not None:
                listed = pa.array(total if arrow is None else [Decimal(v) for v in total], arrow or pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(range(len(listed)), pa.int32()), listed], names=["at", "v"])

        sums = self.fit.mapInArrow(run, f"at int, v {kind}").groupBy("at").agg(F.sum("v").alias("v"))
        return {r["at"]: r["v"] for r in sums.collect()}

    def _array(self, values: Callable, size: int) -> np.ndarray:
        found = self._summed(values)
        return np.array([found.get(i, 0.0) for i in range(size)])

    def product(self, block: np.ndarray) -> np.ndarray:
        """The covariance (divisor n) times the columns of the block."""

        def values(centre, x):
            c = centred(x, *centre)
            return (c.T @ (c @ block)).ravel()

        return self._array(values, block.size).reshape(block.shape) / max(1, self.n)

    def check(self, axes: np.ndarray) -> tuple[float, float]:
        """The covariance's trace, and the largest absolute entry of (covariance of the rows on these axes) - identity."""
        k = axes.shape[1]

        def values(centre, x):
            c = centred(x, *centre)
            w = c @ axes
            return np.concatenate([(w.T @ w).ravel(), w.sum(0), [(c * c).sum()]])

        found = self._array(values, k * k + k + 1) / max(1, self.n)
        mean = found[k * k : -1]
        spread = found[: k * k].reshape(k, k) - np.outer(mean, mean) - np.eye(k)
        return float(found[-1]), float(np.abs(spread).max(initial=0.0))


def centred(x: np.ndarray, whole: np.ndarray, fraction: np.ndarray) -> np.ndarray:
    return (x - whole).astype(float) - fraction


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Per row the exact sum of (n * x - S)^2; null where it does not fit a long."""
    whole = np.array([s // n for s in sums], np.int64)
    rest = np.array([s - n * int(w) for s, w in zip(sums, whole, strict=True)], np.int64)
    near = x - whole
    if (float(abs(near).max(initial=0)) + 1) * n < math.sqrt(2.0**62 / max(1, x.shape[1])):
        return ((near * n - rest) ** 2).sum(1).tolist()
    exact = ((near.astype(object) * n - rest.astype(object)) ** 2).sum(1)
    return [int(v) if v < 1 << 63 else None for v in exact]


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Each row's coordinates on the leading eigenvectors of the covariance, scaled to variance 1.

    Returns (id_col, component, n, deviation, whitened, explained, identity_error), a row for each input row and component.
    An entry c counts as x = floor(SCALE * c) + OFFSET. The population is every distinct x vector once, n of them with sums S.
    Components are numbered from 1 by falling eigenvalue e; whitened is (x - S / n) on the unit eigenvector over sqrt(e),
    explained e over the covariance's trace, deviation the sum of (n * x - S)^2 (null where it does not fit a long), and
    identity_error one value that tells how far the whitened population is from the identity.

    Rows are left out whose vector is null or empty or holds an entry that is null, not finite, or not below LARGEST in size, and
    rows whose vector has another length than most vectors (of two lengths as frequent, the longer counts). Repeated rows stay, each with
    its own result; a null id stays null. Eigenvalues below 1e-10 of the largest count as zero and are no components, so
    equal vectors alone, or no rows, give no rows. Other columns are ignored.
    """
    spark = vectors.sparkSession
    kind = vectors.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = _vectors(vectors, id_col, vector_col).filter("size(x) > 0")
    sizes = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], schema)
    dimension = sizes[0]["d"]
    rows = rows.filter(F.size("x") == dimension)
    fit = materialize(rows.select("x").distinct(), "population").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        population = Population(fit, dimension)
        values, axes, _ = jacobi_davidson(population.product, dimension, components)
        real = values > max(values[:1].max(initial=0.0) * 1e-10, np.finfo(float).tiny)
        values, axes = values[real], axes[:, real]
        axes = axes / np.sqrt(values)
        trace, error = population.check(axes)
    finally:
        fit.unpersist()
    n, sums, whole, fraction, k = population.n, population.sums, population.whole, population.fraction, len(values)
    names = [id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"]

    def run(batches: Iterator[pa.RecordBatch]):
        for part, x in _slices(batches, dimension):
            m = part.num_rows
            of = pa.array(np.repeat(np.arange(m), k))
            ids = kernels.column(part, "__id").take(of)
            far = pa.array(deviations(x, n, sums), pa.int64()).take(of)
            white = pa.array((centred(x, whole, fraction) @ axes).ravel())
            number, share = np.tile(np.arange(1, k + 1, dtype=np.int32), m), np.tile(values / trace if k else values, m)
            columns = [ids, pa.array(number), pa.array(np.full(m * k, n)), far, white, pa.array(share), pa.array(np.full(m * k, error))]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows.mapInArrow(run, schema)
