"""Whitening against dense eigenvectors, and the Jacobi-Davidson solver on hard spectra."""

import math

import numpy as np
import pytest

from cadenza.llm import queries, whiten
from cadenza.session import table

SF = "/root/testdata/sf0.01"


def dense(vectors):
    x = np.floor(64 * np.array(vectors, float)).astype(int) + 1_000_000
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(0)
    centred = fit - sums / n
    v = centred.T @ centred / n
    e, u = np.linalg.eigh(v)
    return x, n, sums, e[::-1], u[:, ::-1], np.trace(v)


def check(rows, vectors, k):
    x, n, sums, e, u, trace = dense(list(vectors.values()))
    got = {(r.vec_id, r.component): r for r in rows}
    assert len(got) == len(rows) == k * len(vectors)
    want = (x - sums / n) @ u[:, :k] / np.sqrt(e[:k])
    have = np.array([[got[i, c + 1].whitened for c in range(k)] for i in vectors])
    sign = np.sign((have * want).sum(0))
    assert np.abs(have * sign - want).max() < 1e-8
    for i, row in zip(vectors, x, strict=True):
        r = got[i, 1]
        assert r.n == n and r.deviation == int(((n * row - sums).astype(object) ** 2).sum())
    for c in range(k):
        r = got[next(iter(vectors)), c + 1]
        assert r.explained == pytest.approx(e[c] / trace, rel=1e-10) and r.identity_error < 1e-9


def test_whole_table(spark):
    vectors = {r.vec_id: r.embedding for r in table(spark, SF, "embeddings").collect()}
    check(queries.QUERIES["op12_embedding_whitening"](spark, SF).collect(), vectors, 16)


def test_odd_rows(spark):
    r = np.random.default_rng(3)
    good = {i: [float(np.float32(c)) for c in r.standard_normal(5) * 9] for i in range(30)}
    good |= {100: good[0], 101: good[0]}
    odd = [(200, None), (201, []), (202, [1.0] * 4), (203, [None] * 5), (204, [math.nan] * 5), (205, [math.inf] * 5), (206, [1e30] * 5)]
    rows = [(i, v, 3, "x") for i, v in [*good.items(), *odd]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, n int, x string")
    check(whiten.whiten(df).collect(), good, 5)
    again = whiten.whiten(df.unionAll(df.limit(3)).unionAll(spark.createDataFrame([(None, good[5], 1, "y")], df.schema)))
    assert again.count() == 5 * (len(good) + 4) and again.filter("vec_id is null").count() == 5
    assert whiten.whiten(df.limit(0)).count() == 0 and whiten.whiten(df.limit(1)).count() == 0


def test_huge_entries_are_exact_or_null(spark):
    rows = [(0, [2.0**40, 1.0]), (1, [-(2.0**40), 2.0]), (2, [5.0, 3.0])]
    got = whiten.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {r.vec_id: r.deviation for r in got} == {0: None, 1: None, 2: 640**2 + 192**2}
    small = [(0, [2.0**20, 1.0]), (1, [-(2.0**20), 2.0]), (2, [5.0, 3.0])]
    check(whiten.whiten(spark.createDataFrame(small, "vec_id long, embedding array<double>")).filter("component = 1").collect(), dict(small), 1)


@pytest.mark.parametrize("spectrum", ["close", "repeated", "steep", "low"])
def test_solver(spectrum):
    r = np.random.default_rng(1)
    d = 300
    e = {
        "close": np.linspace(1, 2, d), "repeated": np.repeat([5.0, 4.0, 1.0], 100),
        "steep": 2.0 ** -np.arange(d), "low": np.array([3.0, 2.0, 1.0] + [0.0] * (d - 3)),
    }[spectrum]
    q = np.linalg.qr(r.standard_normal((d, d)))[0]
    a = (q * e) @ q.T
    values, axes, worst = whiten.jacobi_davidson(lambda x: a @ x, d, 16)
    assert np.abs(values - np.sort(e)[::-1][:16]).max() < 1e-12 and worst < 1e-11 * values[0]
    assert np.abs(axes.T @ axes - np.eye(16)).max() < 1e-12
    assert np.linalg.norm(a @ axes - axes * values, axis=0).max() < 1e-11 * values[0]


def test_minres_solves():
    r = np.random.default_rng(2)
    a = r.standard_normal((40, 40))
    a, b, shifts = a + a.T, r.standard_normal((40, 3)), np.array([0.0, 0.5, -1.0])
    t = whiten.minres(lambda x: a @ x, shifts, b, lambda x: x, 60)
    assert np.abs(a @ t - t * shifts - b).max() < 1e-6
