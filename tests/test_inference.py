"""Draws, restrictions, weak instruments, formula terms: against brute force and known facts."""

import hashlib
import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import kernels
from plumbline.operators import boot as B
from plumbline.operators import dependent, did, fe, linear, synth
from plumbline.operators.iv import GMM, IV
from plumbline.operators.ols import OLS, row_draw_sums
from plumbline.plans import formula


def sign(seed, key, b):
    return 1.0 if hashlib.md5(f"{seed}:{key}:{b}".encode()).hexdigest()[0] < "8" else -1.0


def test_rows_that_repeat_are_drawn_each_for_itself(spark):
    d = spark.range(2000, numPartitions=5).selectExpr("id", "cast(id % 2 as double) x", "cast((id * 7919) % 3 = 0 as double) y")
    free = OLS("y", ["x"], d.drop("id"), boot=B.Boot(400, seed=1)).fit().se["x"]
    keyed = OLS("y", ["x"], d, boot=B.Boot(400, seed=1), key=["id"]).fit().se["x"]
    x, y = (np.array([r[c] for r in d.collect()]) for c in "xy")
    e = y - np.array([y[x == v].mean() for v in (0, 1)])[x.astype(int)]
    exact = np.sqrt((e[x == 1] ** 2).sum() / (x == 1).sum() ** 2 + (e[x == 0] ** 2).sum() / (x == 0).sum() ** 2)
    assert abs(free / exact - 1) < 0.1 and abs(keyed / exact - 1) < 0.1


def test_row_draws_go_by_place_not_by_partition(spark):
    frames = [spark.range(500, numPartitions=n).selectExpr("cast(id % 4 as double) a") for n in (1, 3, 8)]
    for dist in ("rademacher", "webb", "mammen", "normal", "exp"):
        sums = [row_draw_sums(f, ["a"], B.Boot(40, dist, seed=3)) for f in frames]
        assert np.allclose(sums[0], sums[1]) and np.allclose(sums[0], sums[2]), dist
    ones = spark.range(4000, numPartitions=4).select(F.lit(1.0).alias("a"))
    for dist, mean in (("rademacher", 0), ("webb", 0), ("mammen", 0), ("normal", 0), ("exp", 1)):
        s = row_draw_sums(ones, ["a"], B.Boot(300, dist, seed=9))[:, 0]
        assert abs(s.mean() / 4000 - mean) < 0.01 and 0.8 < s.var() / 4000 < 1.25, dist


def test_two_step_weights_are_estimated_anew_in_every_draw(spark):
    rng = np.random.default_rng(0)
    n, groups = 240, 16
    z, g = rng.normal(size=(n, 3)), np.arange(n) % groups
    u = rng.normal(size=n) + rng.normal(size=groups)[g]
    x = z @ [1.0, 0.5, -0.5] + 0.5 * u + rng.normal(size=n)
    y = 2 * x + u * (1 + (z[:, 0] > 0))
    d = spark.createDataFrame([(float(a), float(b), *map(float, c), int(k)) for a, b, c, k in zip(y, x, z, g)], "y double, x double, z1 double, z2 double, z3 double, g long")
    fit = GMM("y", ["x"], [], ["z1", "z2", "z3"], d, boot=B.Boot(25, seed=6, cluster=("g",)), weight="two-step").fit()
    zz, xx = np.column_stack([z, np.ones(n)]), np.column_stack([x, np.ones(n)])
    by = lambda m: np.array([m[g == k].sum(0) for k in range(groups)])

    def two_step(out):
        a = zz.T @ xx
        step = lambda w: np.linalg.solve(a.T @ w @ a, a.T @ w @ zz.T @ out)
        b = step(np.linalg.inv(zz.T @ zz))
        m = by(zz * (out - xx @ b)[:, None])
        return step(np.linalg.inv(m.T @ m))

    beta = two_step(y)
    assert np.allclose([fit.params["x"], fit.params["_cons"]], beta)
    res, c = y - xx @ beta, B.ssc_factor(n, 2, [groups])
    for b in range(25):
        turned = xx @ beta + res * np.array([sign(6, k, b) for k in g])
        assert np.allclose(fit.extra["draws"][b], c * (two_step(turned) - beta), atol=1e-8)


def test_gmm_weights(spark):
    rng = np.random.default_rng(1)
    z, w = rng.normal(size=(150, 2)), rng.uniform(0.5, 2, 150)
    x = z @ [1.0, 1.0] + rng.normal(size=150)
    y = x + rng.normal(size=150)
    d = spark.createDataFrame([(float(a), float(b), *map(float, c), float(k)) for a, b, c, k in zip(y, x, z, w)], "y double, x double, z1 double, z2 double, w double")
    zz, xx = np.column_stack([z, np.ones(150)]), np.column_stack([x, np.ones(150)])
    user = np.diag([3.0, 1.0, 2.0])
    for weight, m, scale in ((user, user, np.ones(150)), ("2sls", np.linalg.inv((zz * w[:, None]).T @ zz), w)):
        fit = GMM("y", ["x"], [], ["z1", "z2"], d, weight=weight, obs_weight="w" if scale is w else None).fit()
        a, c = (zz * scale[:, None]).T @ xx, (zz * scale[:, None]).T @ y
        assert np.allclose(list(fit.params.values()), np.linalg.solve(a.T @ m @ a, a.T @ m @ c))
    with pytest.raises(ValueError):
        GMM("y", ["x"], [], ["z1", "z2"], d, weight=np.eye(2)).fit()


def test_instruments_without_variance(spark):
    d = spark.range(60).selectExpr("cast(id % 7 as double) z", "cast(id % 5 as double) w", "2.0 flat", "cast((id * 13) % 11 as double) + id % 7 x").withColumn("y", F.col("x") * 2 + F.col("w"))
    fit = IV("y", ["x"], ["w", "flat"], ["z", "flat"], d).fit()
    assert set(fit.params) == {"x", "w", "_cons"} and abs(fit.params["x"] - 2) < 1e-8
    assert fit.diagnostics["mop_effective_f"] > 0 and fit.diagnostics["robust_f"] > 0
    with pytest.raises(ValueError, match="without variance"):
        IV("y", ["flat"], ["w"], ["z"], d).fit()


def test_null_is_imposed(spark):
    d = spark.range(300).selectExpr("cast(id % 11 as double) a", "cast((id * 31) % 17 as double) b", "id % 30 g").withColumn("y", F.col("a") + 0.3 * F.col("b") + (F.col("g") * 7 % 5))
    fit = OLS("y", ["a", "b"], d, boot=B.Boot(60, seed=2, cluster=("g",)), null="b = 0").fit()
    x = np.array([[r.a, r.b, 1.0, r.y, r.g] for r in d.collect()])
    under = np.linalg.lstsq(x[:, [0, 2]], x[:, 3], rcond=None)[0]
    u = x[:, 3] - x[:, [0, 2]] @ under
    inv, c = np.linalg.inv(x[:, :3].T @ x[:, :3]), B.ssc_factor(300, 3, [30])
    want = np.array([c * inv @ (x[:, :3] * (u * [sign(2, int(g), b) for g in x[:, 4]])[:, None]).sum(0) for b in range(60)])
    assert np.allclose(fit.extra["null_draws"], want)
    assert np.isclose(fit.diagnostics["wald"], fit.params["b"] ** 2 / want[:, 1].var(ddof=1))


def test_formula_terms(spark):
    d = spark.createDataFrame([(float(i), float(i % 3), "abc"[i % 3], float(i * i % 7 + 1)) for i in range(40)], "x double, k double, c string, y double")
    got = formula.build(d, ["I(x - 1)", "np.log(x + 1)", "I(-x / 2 + k ** 2)", "np.maximum(x, 5)", "C(c, Treatment('b'))"])
    row = got[0].where("x = 4").first()
    assert got[1] == ["I(x - 1)", "np.log(x + 1)", "I(-x / 2 + k ** 2)", "np.maximum(x, 5)", "c[a]", "c[c]"]
    assert np.allclose([row[n] for n in got[1]], [3, np.log(5), -1, 5, 0, 0])
    assert formula.read_terms("I(x - 1) + z - 1") == (["I(x - 1)", "z"], False, [])
    for bad in ("I(nothing)", "np.unknown(x)", "C(c, Treatment('z'))", "I(x if k else 1)", "I(__import__('os'))"):
        with pytest.raises(ValueError):
            formula.build(d, [bad])
    many = spark.range(formula.MOST_LEVELS + 5).selectExpr("id", "id g")
    with pytest.raises(ValueError, match="absorb"):
        formula.build(many, ["i.g"])
    fit = formula.estimate("np.sqrt(y) ~ x", d)
    x, y = (np.array([r[c] for r in d.collect()]) for c in "xy")
    assert np.isclose(fit.params["x"], np.polyfit(x, np.sqrt(y), 1)[0])


def test_bandwidths_by_kernel():
    assert kernels.bandwidth_nw94(100) == 4.0 and kernels.bandwidth_nw94(150, as_integer=False) == 4.0 * 1.5 ** (2 / 9)
    assert kernels.bandwidth_nw94(100, "qs") == kernels.bandwidth_andrews91(100, "qs") == kernels.bandwidth_andrews91(100)
    assert kernels.bandwidth_nw94(100, "parzen") == kernels.bandwidth_andrews91(100, "parzen")


def test_weightless_groups(spark):
    d = spark.createDataFrame([("a", 1, 0.0), ("a", 2, 0.0), ("b", 1, 1.0), ("b", 2, 0.0), ("c", 3, 2.0), ("c", 2, 0.0)], "f string, g long, w double")
    left, gone = fe.drop_weightless(d, "w", ["f", "g"])
    assert sorted((r.f, r.g) for r in left.collect()) == [("b", 1), ("c", 3)] and gone == 4


def test_a_cell_without_a_logit_is_left_out(spark):
    rows = [(c, 1, 1.0, float(x), float((x + c) % 3 > 0) if c == 2 else float(x > 4), float(x * x % 5)) for c in (2, 3) for x in range(10)]
    d = spark.createDataFrame(rows, "cg long, ct long, one double, x double, d double, dy double")
    with warnings.catch_warnings(record=True) as said:
        warnings.simplefilter("always")
        cells, psi = did.influence(d, ["cg", "ct"], ["x", "one"], "ipw")
    assert set(cells) == {(2, 1)} and any("left out" in str(w.message) for w in said)
    assert {r.cg for r in psi.collect()} == {2}


def test_full_weight_matrix(spark):
    rng = np.random.default_rng(2)
    x, w = rng.normal(size=(9, 2)), rng.normal(size=(9, 9))
    d = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id long, a double, b double")
    pairs = spark.createDataFrame([(i, j, float(w[i, j])) for i in range(9) for j in range(9)], "a long, b long, w double")
    assert np.allclose(linear.gram_pairs(d, ["a", "b"], pairs, "id"), x.T @ w @ x)


def test_softmax_and_predictor_weights():
    v, jac = synth.softmax(np.array([0.3, -1.0, 2.0]))
    step = np.array([(synth.softmax(np.array([0.3, -1.0, 2.0]) + 1e-6 * np.eye(3)[i])[0] - v) / 1e-6 for i in range(3)]).T
    assert np.isclose(v.sum(), 1) and np.allclose(jac, step, atol=1e-5)
    rng = np.random.default_rng(5)
    x0, true = rng.normal(size=(4, 6)), np.array([0.5, 0.5, 0, 0, 0, 0])
    z0 = rng.normal(size=(12, 6))
    noisy = x0 @ true + np.array([0, 0, 3.0, -3.0])  # the last two predictors mislead
    v, w = synth.predictor_weights(noisy, x0, z0 @ true, z0)
    even = synth.simplex_weights(np.sqrt(0.25) * x0 / x0.std(), np.sqrt(0.25) * noisy / x0.std())
    fit = lambda w: ((z0 @ true - z0 @ w) ** 2).mean()
    assert fit(w) < fit(even) and v[2:].sum() < 0.5


def test_time_multipliers_take_the_kernels_bandwidth(spark):
    d = spark.range(40).selectExpr("id t")
    for kernel in ("bartlett", "parzen", "qs"):
        w = dependent.time_multipliers(d, "t", 300, kernel=kernel).toPandas().pivot(index="b", columns="key", values="w").to_numpy()
        assert 0.6 < w.var() < 1.5 and np.corrcoef(w[:, 10], w[:, 11])[0, 1] > 0.3


def test_tables_have_groups_statistics_bands_and_notes(spark):
    from plumbline.operators.result import Result
    from plumbline.plans import report

    a = Result(spark, {"x_1": 1.5, "tau_0": 2.0}, {"x_1": 0.25, "tau_0": 0.5}, bands=[("post", 0, 2.0, 0.5, 1.0, 3.0)], n_obs=10, diagnostics={"rank": 2.0})
    b = Result(spark, {"x_1": 2.0}, n_obs=20)
    text = report.render({"one": a, "two": b}, digits=2, groups={"left": 1, "right": 1}, stats=("rank", "nothing"), notes=("5% & more",), bands=True)
    lines = text.splitlines()
    assert lines[0].split() == ["left", "right"] and "[1.00, 3.00]" in text and lines[-1] == "5% & more" and any(x.split() == ["rank", "2.00"] for x in lines) and "nothing" not in text
    tex = report.render({"one": a, "two": b}, digits=2, latex=True, groups={"left": 2}, notes=("5% & more",))
    assert "\\multicolumn{2}{c}{left}" in tex and "x\\_1 & 1.50 & 2.00" in tex and "5\\% \\& more" in tex and tex.count("\\hline") == 2
    with pytest.raises(ValueError):
        report.render({"one": a, "two": b}, groups={"left": 1})
