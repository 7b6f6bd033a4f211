"""Whitening against exact integers and a library's eigenvectors."""

import math

import numpy as np
import pytest

from tallyframe.llm import whitening


@pytest.mark.parametrize("values", [np.arange(8, 0, -1.0), np.linspace(1, 9, 64), np.r_[np.full(32, 5.0), np.ones(30), 0, 0], 10.0 ** -np.arange(20), np.zeros(20), np.array([3.0])])
def test_components_are_those_of_the_library(values):
    n = len(values)
    q, _ = np.linalg.qr(np.random.default_rng(1).standard_normal((n, n)))
    a = (q * values) @ q.T
    got, x = whitening.spectral_components(a)
    scale = max(np.abs(values).max(), 1e-300)
    assert np.abs(got - np.linalg.eigvalsh((a + a.T) / 2)[::-1]).max() < 1e-14 * scale * n
    assert np.abs(x.T @ x - np.eye(n)).max() < 1e-13
    assert np.abs(a @ x - x * got).max() < 1e-14 * scale * n


def test_polar_factor():
    a = np.random.default_rng(2).standard_normal((40, 40))
    u, s, vt = np.linalg.svd(a)
    assert np.abs(whitening.qdwh_polar(a) - u @ vt).max() < 1e-12


def brute(rows):
    kept = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for _, v in kept]
    n, d = len(x), len(x[0])
    sums = [sum(r[j] for r in x) for j in range(d)]
    moved = [[n * r[j] - sums[j] for j in range(d)] for r in x]
    z = np.array(moved, float) / n
    e, y = np.linalg.eigh(z.T @ z / n)
    return [i for i, _ in kept], n, [sum(m * m for m in r) for r in moved], z, e[::-1], y[:, ::-1]


def test_whitening_of_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.standard_normal(40) * np.linspace(0.2, 3, 40) + 7).astype(np.float32).tolist()) for i in range(300)]
    rows += [(900, None), (901, [float("nan")] * 40), (902, [None] * 40), (903, [float("inf")] * 40), (904, rows[0][1]), (905, [1.0, 2.0]), (906, [])]
    df = spark.createDataFrame([(i, v, 0, 0.0, "x") for i, v in rows], "vec_id long, embedding array<float>, n int, whitened double, v string")
    ids, n, deviation, z, e, y = brute([(i, v) for i, v in rows if v is None or len(v) == 40])
    for parts in (1, 6):
        got = whitening.whiten(df.repartition(parts)).toPandas()
        assert len(got) == len(ids) * 32 and set(got.n) == {n}
        assert got.groupby("vec_id").deviation.first().to_dict() == dict(zip(ids, deviation, strict=True))
        w = got.pivot(index="vec_id", columns="component", values="whitened").loc[ids].to_numpy()
        want = z @ y[:, :32] / np.sqrt(e[:32])
        assert np.abs(w * np.sign((w * want).sum(axis=0)) - want).max() < 1e-9
        assert np.allclose(got.groupby("component").explained.first(), e[:32] / e.sum(), rtol=1e-12)
        assert got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-10


def test_nothing_to_whiten(spark):
    schema = "vec_id long, embedding array<double>"
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, [])]):
        assert whitening.whiten(spark.createDataFrame(rows, schema)).count() == 0


def test_entries_beyond_longs(spark):
    schema = "vec_id long, embedding array<double>"
    huge = whitening.whiten(spark.createDataFrame([(k, [2.0**50 * k, 1.0]) for k in range(5)] + [(9, [1e300, 1.0])], schema)).toPandas()
    assert sorted(huge.vec_id) == [0, 1, 2, 3, 4] and huge.deviation.isna().sum() == 4
    assert np.allclose(huge.sort_values("vec_id").whitened.abs(), [2**0.5, 0.5**0.5, 0, 0.5**0.5, 2**0.5], atol=1e-12)
