"""Inverse quantile regression beyond the rows that the driver solves for."""

import numpy as np

from plumbline.operators import quantile


def test_ivqr_over_all_rows_equals_driver(spark, monkeypatch):
    r = np.random.default_rng(3)
    z, w, v, e = r.normal(size=(4, 3000))
    x = z + 0.5 * w + v
    y = 2 * x + w + v + e
    df = spark.createDataFrame([tuple(map(float, t)) for t in zip(y, x, w, z)], "y double, x double, w double, z double").cache()
    want = quantile.ivqr(df, "y", "x", ["w"], ["z"], points=5, rounds=2)
    monkeypatch.setattr(quantile, "NEAR", 1000)
    monkeypatch.setattr(quantile.QR.__init__, "__defaults__", (0.5, None, None, "id", 1000))
    got = quantile.ivqr(df, "y", "x", ["w"], ["z"], points=5, rounds=2)
    assert got.n_obs == want.n_obs == 3000
    assert all(abs(got.params[k] - want.params[k]) < 0.02 for k in want.params), (got.params, want.params)


def test_ivqr_where_few_rows_fit_on_the_driver(spark, monkeypatch):
    r = np.random.default_rng(5)
    n = 60_000
    z, v, e = r.normal(size=(3, n))
    w = r.integers(0, 11, n) / 10
    x = z + 0.5 * w + v
    y = 2 * x + w + v + (1 + w) * np.exp(e)
    rows = np.column_stack([y, x, w, z])
    df = spark.createDataFrame(spark.sparkContext.parallelize(rows.tolist(), 3), "y double, x double, w double, z double").cache()
    monkeypatch.setattr(quantile, "NEAR", 100)
    monkeypatch.setattr(quantile.QR.__init__, "__defaults__", (0.5, None, None, "id", 100))
    got = quantile.ivqr(df, "y", "x", ["w"], ["z"], points=3, rounds=1)
    at = np.column_stack([w, z, np.ones(n)])
    want = quantile.solve_lp(at, y - got.params["x"] * x, 0.5)
    assert abs(got.params["w"] - want[0]) < 1e-6 and abs(got.params["_cons"] - want[2]) < 1e-6, (got.params, want)
    assert abs(got.diagnostics["weight_of_instruments"] - (z @ z) / n * want[1] ** 2) < 1e-6
