"""Dependent multipliers and covariance helpers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import dependent as D


def test_time_multipliers_follow_the_kernel(spark):
    d = spark.range(12).select(F.col("id").alias("t"))
    w = D.time_multipliers(d, "t", 4000, bandwidth=4.0, seed=2).toPandas().pivot(index="b", columns="key", values="w")
    c = np.cov(w.to_numpy().T)
    want = np.maximum(0, 1 - np.abs(np.subtract.outer(np.arange(12), np.arange(12))) / 4)
    assert np.abs(c - want).max() < 0.12


def test_space_kernels(spark):
    p = spark.createDataFrame([(i, float(i % 5), float(i // 5)) for i in range(25)], "id long, x double, y double")
    near = {(r.a, r.b): r.k for r in D.space_kernel(p, 2.0).collect()}
    assert near[0, 0] == 1 and abs(near[0, 1] - 0.5) < 1e-12 and (0, 2) not in near and len(near) == sum(1 for a in range(25) for b in range(25) if np.hypot(a % 5 - b % 5, a // 5 - b // 5) < 2)
    assert D.space_kernel(p, 2.0, "qs").count() > 500
    with pytest.raises(ValueError):
        D.space_kernel(p, 0)
    w = D.space_multipliers(p, 10, 2.0)
    assert w.count() == 250
    one = D.space_cluster_multipliers(p, 5, 1.0).groupBy("b").agg(F.countDistinct("w").alias("n"))
    assert one.where("n > 1").isEmpty()


def test_covariances_and_factors():
    assert np.allclose(D.ar1_blocks([[1, 2, 4]], 0.5)[0], [[1, 0.5, 0.125], [0.5, 1, 0.25], [0.125, 0.25, 1]])
    w = np.array([[0, 1.0], [1.0, 0]])
    a = np.linalg.inv(np.eye(2) - 0.4 * w)
    assert np.allclose(D.sar_covariance(w, 0.4), a @ a.T)
    with pytest.raises(ValueError):
        D.sar_covariance(w, 1.2)
    r = np.random.default_rng(0)
    m = r.normal(size=(60, 2)) @ r.normal(size=(2, 40)) * 3 + r.normal(size=(60, 40))
    assert D.factors(m)[0] == 2


def test_recentred_scores_add_up_to_zero(spark):
    r = np.random.default_rng(0)
    d = spark.createDataFrame([(int(i % 7), float(a), float(b), float(a * e), float(b * e)) for i, (a, b, e) in enumerate(r.normal(size=(100, 3)))], "c int, x1 double, x2 double, s1 double, s2 double")
    out = D.recentred(d, ["s1", "s2"], ["x1", "x2"], "c").agg(F.sum("s1"), F.sum("s2")).first()
    assert np.abs(out).max() < 1e-9


def test_space_cluster_multipliers_of_copies(spark, monkeypatch):
    """Copies of places are no links: 5,000 points at 5 places, of which two are near each other."""
    from plumbline.operators import graph

    p = spark.range(5000).selectExpr("id", "array(0D, 1D, 5D, 10D, 15D)[id % 5] AS x", "0D AS y")
    seen, whole = [], graph.components
    monkeypatch.setattr(graph, "components", lambda e: (seen.append(e.count()), whole(e))[1])
    got = {(r.component, r.n) for r in D.space_cluster_multipliers(p, 3, 1.0).groupBy("component", "b").agg(F.count("w").alias("n")).collect()}
    assert got == {(0, 2000), (2, 1000), (3, 1000), (4, 1000)}
    assert seen == [1]
