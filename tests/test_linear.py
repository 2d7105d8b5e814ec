"""Linear algebra, bootstrap and least squares against NumPy."""

import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import draws, kernels
from plumbline.operators import boot as B
from plumbline.operators import gls, iv, quantile
from plumbline.operators import linear as L
from plumbline.operators.ols import OLS, add_constant


@pytest.fixture(scope="module")
def data(spark):
    r = np.random.default_rng(42)
    x = r.normal(size=(240, 3))
    d = {"id": np.arange(240), "x1": x[:, 0], "x2": x[:, 1], "x3": x[:, 2], "y": x @ [1, -0.5, 0.2] + r.normal(size=240), "g": np.arange(240) % 5, "c": np.arange(240) % 9, "k": np.arange(240) % 13, "w": r.random(240) + 0.5}
    import pandas as pd

    pdf = pd.DataFrame(d)
    return pdf, spark.createDataFrame(pdf).repartition(3)


def design(pdf, cols=("x1", "x2", "x3")):
    return np.column_stack([pdf[list(cols)], np.ones(len(pdf))])


def test_gram_and_tsqr(data):
    pdf, df = data
    x = pdf[["x1", "x2", "x3", "y"]].to_numpy()
    g, n = L.gram(df, ["x1", "x2", "x3", "y"])
    assert n == 240 and np.allclose(g, x.T @ x)
    assert np.allclose(L.gram(df, ["x1", "y"], "w")[0], (x[:, [0, 3]] * pdf.w.to_numpy()[:, None]).T @ x[:, [0, 3]])
    wide = df.withColumns({f"v{i}": F.col("x1") * i + F.col("x2") for i in range(30)})
    v = np.column_stack([pdf.x1 * i + pdf.x2 for i in range(30)])
    assert np.allclose(L.gram(wide, [f"v{i}" for i in range(30)])[0], v.T @ v)
    r = L.tsqr(df, ["x1", "x2", "x3"])
    assert np.allclose(r.T @ r, x[:, :3].T @ x[:, :3])


def test_rank_rules():
    d = [1e2, 1e1, 1e-8, 1e-15]
    assert L.numerical_rank(np.array(d), "stata") == 3 and L.numerical_rank(np.array(d), "r") == 2
    a = np.random.default_rng(1).normal(size=(50, 4))
    r, piv = L.pivoted_qr(a)
    assert np.allclose(r.T @ r, a[:, piv].T @ a[:, piv])


def test_screen_and_duplicates(data):
    _, df = data
    d = df.withColumn("s", F.col("x1") + F.col("x2")).withColumn("same", F.col("x1")).withColumn("two", F.lit(2.0))
    kept, dropped = L.screen(d, ["x1", "x2", "x3", "s"])
    assert len(kept) == 3 and len(dropped) == 1
    assert L.duplicate_columns(d, ["x1", "x2", "same"]) == ["same"] and L.constant_columns(d, ["x1", "two"]) == ["two"]
    fit = OLS("y", ["x1", "x2", "s"], d).fit()
    assert list(fit.params.values()).count(0.0) == 1
    assert sum(np.isnan(v) for v in OLS("y", ["x1", "x2", "s"], d, dialect="r").fit().params.values()) == 1


def test_constants(data):
    _, df = data
    assert add_constant(df, ["x1"])[1] == ["x1", "_cons"] and add_constant(df, ["x1"], "r")[1] == ["(Intercept)", "x1"]
    with pytest.raises(ValueError):
        add_constant(df.withColumn("_cons", F.col("x2")), ["x1", "_cons"])


def test_constraints():
    r, q, labels = L.parse_constraints("_b[x] = 0; x = 0", ["const", "x"])
    assert r.tolist() == [[0, 1]] and q.tolist() == [0] and len(labels) == 1
    r, q, _ = L.parse_constraints("2*_b[x] + z = 1; x == z", ["x", "z"])
    assert r.tolist() == [[2, 1], [1, -1]] and q.tolist() == [1, 0]
    with pytest.raises(ValueError):
        L.parse_constraints("x = 1; x = 2", ["x"])
    with pytest.raises(ValueError):
        L.parse_constraints("nothing = 1", ["x"])


def test_effective_f_and_psd():
    assert abs(L.effective_f(np.array([2.0]), np.array([[1.0]]), np.array([[0.5]])) - 8.0) < 1e-12
    a = np.array([[1, 0.9, 0.1], [0.9, 1, 0.9], [0.1, 0.9, 1.0]])
    p = L.nearest_psd(a - 0.5 * np.eye(3))
    assert np.linalg.eigvalsh(p).min() > -1e-9


def signs(seed, keys, n):
    import hashlib

    return np.array([[1.0 if hashlib.md5(f"{seed}:{k}:{b}".encode()).hexdigest()[0] < "8" else -1.0 for k in keys] for b in range(n)])


def test_ols_and_cluster_bootstrap_equal_full_refits(data):
    pdf, df = data
    x, y = design(pdf), pdf.y.to_numpy()
    fit = OLS("y", ["x1", "x2", "x3"], df, boot=B.Boot(50, seed=3, cluster=("k",))).fit()
    beta = np.linalg.lstsq(x, y, rcond=None)[0]
    assert np.allclose(list(fit.params.values()), beta)
    u, c = y - x @ beta, B.ssc_factor(240, 4, [13])
    w = signs(3, range(13), 50)
    stars = np.array([np.linalg.lstsq(x, x @ beta + c * u * wb[pdf.k], rcond=None)[0] for wb in w])
    assert np.allclose(list(fit.se.values()), stars.std(0, ddof=1))


def test_enumeration_two_ways_and_rows(data):
    pdf, df = data
    fit = OLS("y", ["x1"], df, boot=B.Boot(2000, cluster=("g",))).fit()
    assert len(fit.extra["draws"]) == 32
    fit = OLS("y", ["x1"], df, boot=B.Boot(64, seed=2, cluster=("g", "k"))).fit()
    x, y = design(pdf, ["x1"]), pdf.y.to_numpy()
    beta = np.linalg.lstsq(x, y, rcond=None)[0]
    w = signs(2, range(5), 64)[:, pdf.g] * signs(3, range(13), 64)[:, pdf.k]
    stars = (w * (y - x @ beta)) @ x @ np.linalg.inv(x.T @ x) * B.ssc_factor(240, 2, [5, 13])
    assert np.allclose(list(fit.se.values()), stars.std(0, ddof=1))
    a = OLS("y", ["x1"], df, boot=B.Boot(200, seed=1), key=["id"]).fit()
    b = OLS("y", ["x1"], df.repartition(7), boot=B.Boot(200, seed=1), key=["id"]).fit()
    assert np.allclose(list(a.se.values()), list(b.se.values()))
    hc = np.sqrt(np.diag(np.linalg.inv(x.T @ x) @ (x * (y - x @ beta)[:, None] ** 2).T @ x @ np.linalg.inv(x.T @ x)))
    assert np.allclose(list(a.se.values()), hc, rtol=0.25)


def test_missing_rows_weights_and_effects(data, spark):
    pdf, df = data
    broken = df.withColumn("x1", F.when(F.col("id") == 3, F.lit(float("inf"))).when(F.col("id") == 4, F.lit(None)).otherwise(F.col("x1")))
    fit = OLS("y", ["x1"], broken).fit()
    assert fit.n_obs == 238 and fit.diagnostics["dropped_na"] == 2
    with pytest.raises(ValueError):
        OLS("y", ["x1"], df, weights="w")
    dummies = np.column_stack([pdf[["x1"]], np.eye(5)[pdf.g], np.eye(9)[pdf.c][:, 1:]])
    want = np.linalg.lstsq(dummies, pdf.y, rcond=None)[0][0]
    fit = OLS("y", ["x1"], df, fes=["g", "c"]).fit()
    assert abs(fit.params["x1"] - want) < 1e-6 and fit.diagnostics["df_absorbed"] == 5 - 1 + 9 - 1
    assert OLS("y", ["x1"], df, fes=["g"]).fit().params.keys() == {"x1"}


def test_distributions(spark):
    d = spark.range(20_000).select(F.col("id"))
    for name in ("rademacher", "webb", "mammen", "normal"):
        m = d.select(draws.multiplier(name, 1, F.col("id"), F.lit(0)).alias("w")).agg(F.avg("w"), F.var_pop("w")).first()
        assert abs(m[0]) < 0.03 and abs(m[1] - 1) < 0.05, name
    with pytest.raises(ValueError):
        B.Boot(dist="gamma")
    with pytest.raises(ValueError):
        B.Boot(n=1)
    grid = spark.range(8).select(*[draws.enumerated(F.col("id"), F.lit(j)).alias(f"j{j}") for j in range(3)]).collect()
    assert {tuple(r) for r in grid} == {(a, b, c) for a in (-1, 1) for b in (-1, 1) for c in (-1, 1)}


def test_quantiles_and_levels():
    assert B.bplus1_quantile(range(1, 100), 0.05) == 95 and B.type1_quantile([1, 2, 3, 4], 0.5) == 2
    assert kernels.level(95) == kernels.level(0.95) == 0.95
    assert kernels.bandwidth_nw94(100) == 4.0


def test_iv_equals_two_stages_and_draws(data):
    pdf, df = data
    r = np.random.default_rng(5)
    pdf = pdf.assign(z1=r.normal(size=240), z2=r.normal(size=240))
    v = r.normal(size=240)
    pdf["en"] = pdf.z1 + 0.5 * pdf.z2 + v
    pdf["out"] = 2 * pdf.en - pdf.x1 + 0.8 * v + r.normal(size=240)
    d = df.sparkSession.createDataFrame(pdf)
    fit = iv.IV("out", ["en"], ["x1"], ["z1", "z2"], d, boot=B.Boot(40, seed=4, cluster=("k",))).fit()
    x, z, y = design(pdf, ["en", "x1"]), design(pdf, ["z1", "z2", "x1"]), pdf.out.to_numpy()
    h = z @ np.linalg.lstsq(z, x, rcond=None)[0]
    beta = np.linalg.solve(h.T @ x, h.T @ y)
    assert np.allclose(list(fit.params.values()), beta)
    c, w = B.ssc_factor(240, 3, [13]), signs(4, range(13), 40)[:, pdf.k]
    px, py = np.linalg.lstsq(z, x[:, 0], rcond=None)[0], np.linalg.lstsq(z, y, rcond=None)[0]
    stars = []
    for wb in w:
        xs = x.copy()
        xs[:, 0] = z @ px + c * wb * (x[:, 0] - z @ px)
        ys = z @ py + c * wb * (y - z @ py)
        # Z'x* = Z'x + scores: fitted values are unchanged in Z'.
        hs = z @ np.linalg.lstsq(z, xs, rcond=None)[0]
        stars.append(np.linalg.solve(hs.T @ xs, hs.T @ ys))
    assert np.allclose(list(fit.se.values()), np.std(stars, axis=0, ddof=1))
    assert fit.diagnostics["partial_f_en"] > 10 and fit.diagnostics["sargan"] >= 0 and "hansen" in fit.diagnostics
    gmm = iv.GMM("out", ["en"], ["x1"], ["z1", "z2"], d, weight="2sls").fit()
    assert np.allclose(list(gmm.params.values()), beta)
    with pytest.raises(ValueError):
        iv.IV("out", ["en", "x2"], [], ["z1"], d).fit()
    assert iv.anderson_rubin(d, "out", "en", ["x1"], ["z1", "z2"], 5.0, B.Boot(99, cluster=("k",)))[2]


def test_gls(data, spark):
    pdf, df = data
    w = pdf.w.to_numpy()
    x, y = design(pdf), pdf.y.to_numpy()
    assert np.allclose(list(gls.wls(df, "y", ["x1", "x2", "x3"], "w").params.values()), np.linalg.solve((x * w[:, None]).T @ x, (x * w[:, None]).T @ y))
    t = pdf.assign(s=pdf.id // 60, t=pdf.id % 60)
    d = spark.createDataFrame(t)
    out = gls.ar1(d, "y", ["x1"], "s", "t", iterate=False)
    x1 = design(pdf, ["x1"])
    u = y - x1 @ np.linalg.lstsq(x1, y, rcond=None)[0]
    same = np.r_[False, np.diff(t.s) == 0]
    rho = 1 - (np.diff(u)[same[1:]] ** 2).sum() / (u**2).sum() / 2
    m = np.column_stack([x1, y])
    z = m * np.sqrt(1 - rho**2)
    z[same] = (m - rho * np.roll(m, 1, 0))[same]
    assert abs(out.diagnostics["rho"] - rho) < 1e-9 and np.allclose(list(out.params.values()), np.linalg.lstsq(z[:, :2], z[:, 2], rcond=None)[0])
    assert gls.psar1(d, "y", ["x1"], "s", "t").n_obs == 240
    g, rr = np.asarray(pdf.k), gls.exchangeable(df, "y", ["x1"], "k")
    om = np.where(g[:, None] == g[None], rr.diagnostics["rho"], 0.0)
    np.fill_diagonal(om, 1.0)
    oi = np.linalg.inv(om)
    assert np.allclose(list(rr.params.values()), np.linalg.solve(x1.T @ oi @ x1, x1.T @ oi @ y))


def test_quantile_regression(data):
    pdf, df = data
    x, y = design(pdf, ["x1"]), pdf.y.to_numpy()
    for tau in (0.5, 0.2):
        loss = lambda b: ((u := y - x @ b) * (tau - (u < 0))).sum()  # noqa: E731, B023
        best = min(loss(np.linalg.solve(x[[i, j]], y[[i, j]])) for i in range(240) for j in range(i))
        for near in (quantile.NEAR, 60):
            fit = quantile.QR("y", ["x1"], df, tau, near=near).fit()
            assert abs(loss(np.array(list(fit.params.values()))) - best) < 1e-6 * best
    assert set(quantile.QR("y", ["x1"], df, boot=B.Boot(20, cluster=("k",))).fit().se) == {"x1", "_cons"}
    assert len(quantile.fit_many("y", ["x1"], df, [0.25, 0.75])) == 2


def test_webb_falls_back(data):
    _, df = data
    with warnings.catch_warnings(record=True) as got:
        warnings.simplefilter("always")
        OLS("y", ["x1"], df, boot=B.Boot(20, "webb", cluster=("g",))).fit()
    assert any("six clusters" in str(w.message) for w in got)


def test_rank_of_a_task_of_many_batches(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "30")
    try:
        d = spark.range(0, 120_000, 1, 1).selectExpr("(id * 7919 % 50 + 1) / 10D AS q", "(id * 104729 % 11) / 10D AS d", "(id * 1299709 % 9) / 10D AS x")
        d = d.selectExpr("q", "2 * q AS twice", "d", "x", "d + x AS sum")
        r, _ = L.pivoted_qr(L.tsqr(d, d.columns))
        assert len(L.screen(d, d.columns)[0]) == 3
        size = np.abs(np.diag(r))
        assert (size[3:] < 4e-15 * size.mean()).all(), size  # does not grow with the batches
    finally:
        spark.conf.set(key, before)
