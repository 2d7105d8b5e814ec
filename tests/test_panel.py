"""Panels, event studies, trials, graphs, synthetic controls and the formula language."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline.operators import boot as B
from plumbline.operators import did, fe, graph, panel, rct, spatial, synth
from plumbline.plans import formula, report
from plumbline.sources import simulate


def test_cells_with_anticipation(spark):
    d = spark.createDataFrame([(i, t, g, 0.0) for i, g in ((1, 5), (2, 0)) for t in range(6)], "id int, t int, g int, y double")
    cells = panel.cells(d, anticipation=2)
    assert (5, 2, 1) in cells and (5, 5, 2) in cells and (5, 3, 2) not in cells and (5, 4, 3) not in cells
    with pytest.raises(ValueError):
        panel.cells(d.union(d.limit(1)))
    with pytest.raises(ValueError):
        panel.cells(d.withColumn("g", F.lit(None).cast("int")))


def test_lags_by_time(spark):
    d = spark.createDataFrame([(1, 1, 10.0), (1, 2, 11.0), (1, 4, 13.0), (2, 1, 5.0)], "id int, t int, v double")
    got = {(r.id, r.t): (r.a, r.b) for r in panel.lag(panel.lag(d, "v", 1, name="a"), "v", -1, name="b").collect()}
    assert got == {(1, 1): (None, 11.0), (1, 2): (10.0, None), (1, 4): (None, None), (2, 1): (None, None)}
    with pytest.raises(ValueError):
        panel.lag(d.withColumn("t", F.current_date()), "v")
    with pytest.raises(ValueError):
        panel.check_monotone(spark.createDataFrame([(1, 1, 1), (1, 2, 0)], "id int, t int, d int"), "d")


def test_effects(spark):
    d = spark.createDataFrame([(0, 0), (0, 1), (0, 1), (1, 1)], "g1 int, g2 int")
    assert fe.drop_singletons(d, ["g1", "g2"])[1] == 2
    n = spark.createDataFrame([(0, 0, 0), (0, 1, 1), (1, 0, 2), (1, 1, 3)], "a int, b int, c int")
    assert not fe.nested(n, "a", "b") and fe.nested(n, "c", "a") and fe.prune_nested(n.withColumn("a2", F.col("a")), ["a", "a2"]) == ["a"]
    r = np.random.default_rng(0)
    p = pd.DataFrame({"a": r.integers(0, 6, 200), "b": r.integers(0, 7, 200)})
    p["y"] = 1.0 * p.a + 2.0 * p.b
    eff = fe.recover(spark.createDataFrame(p), "y", ["a", "b"])
    got = spark.createDataFrame(p).join(eff["a"].withColumnRenamed("effect", "ea"), "a").join(eff["b"].withColumnRenamed("effect", "eb"), "b")
    assert got.agg(F.max(F.abs(F.col("y") - F.col("ea") - F.col("eb")))).first()[0] < 1e-6


@pytest.fixture(scope="module")
def cs(spark):
    return simulate.cs(spark).withColumnRenamed("time", "t").withColumn("x", simulate.normal(9, F.col("id"), name="x")).cache()


def test_event_study_recovers_the_effect(cs):
    fit = did.EventStudy(cs, boot=B.Boot(99, cluster=("id",))).fit()
    assert abs(fit.params["post_att"] - 2) < 1 and fit.se["post_att"] > 0
    band = fit.band().toPandas()
    assert (band.lower <= band.estimate).all() and set(band.side) == {"pre", "post"}


def brute_dr(rows):
    """Doubly robust ATT of one cell, its influence terms by numerical differentiation-free closed form."""
    d, y, c = rows.d.to_numpy(), rows.dy.to_numpy(), np.column_stack([rows.x, np.ones(len(rows))])
    g = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-c @ g))
        g = g + np.linalg.solve((c * (p * (1 - p))[:, None]).T @ c, c.T @ (d - p))
    p = 1 / (1 + np.exp(-c @ g))
    b = np.linalg.lstsq(c[d == 0], y[d == 0], rcond=None)[0]
    r, w0 = y - c @ b, (1 - d) * p / (1 - p)
    return r[d == 1].mean() - (w0 * r).sum() / w0.sum()


def test_covariate_methods(cs):
    rows = panel.cell_rows(cs, panel.cells(cs), "y").join(cs.select(F.col("id").alias("unit"), "x").distinct(), "unit").toPandas()
    att = {(r.g, r.t): r.att for r in did.EventStudy(cs, method="dr", covariates=["x"]).fit().extra["att_gt"].collect()}
    for (g, t), part in rows.groupby(["cg", "ct"]):
        assert abs(att[g, t] - brute_dr(part)) < 1e-6
    for method, folds in (("reg", None), ("ipw", None), ("none", 3)):
        fit = did.EventStudy(cs, method=method, covariates=["x"], folds=folds, boot=B.Boot(30, cluster=("id",))).fit()
        assert abs(fit.params["post_att"] - 2) < 1


def test_triple_difference(spark):
    fit = did.triple_difference(simulate.ddd(spark).withColumnRenamed("time", "t"), "group", "A", "B", boot=B.Boot(30, cluster=("id",)))
    assert abs(fit.params["post_att"] - 3) < 1.5 and fit.bands


def test_trials(spark):
    r = np.random.default_rng(1)
    n = 1500
    p = pd.DataFrame({"id": range(n), "arm": r.integers(0, 2, n), "x": r.normal(size=n), "s": r.choice(["a", "b"], n)})
    p["y"] = 1 + 2 * p.arm + p.x + r.normal(size=n)
    fit = rct.RCT(spark.createDataFrame(p), "y", "arm", ["x"], boot=B.Boot(199)).fit()
    assert all(abs(v - 2) < 0.25 for v in fit.params.values()) and len(fit.params) == 6
    assert abs(fit.se["RA_ATE__1_vs_0"] - 2 / np.sqrt(n)) < 0.02
    by = rct.RCT(spark.createDataFrame(p), "y", "arm", stratum="s").fit()
    assert {k for k in by.params if k.endswith("_S2")} and len(by.params) == 18
    one = pd.concat([p, pd.DataFrame({"id": [n], "arm": [1], "x": [0.0], "s": ["c"], "y": [0.0]})])
    assert rct.overlapping(spark.createDataFrame(one), "arm", "s", 1, 0).count() == n


def test_graphs(spark):
    d, e = simulate.sar(spark)
    fit = spatial.sar(d, e, "y", ["x0", "x1"], boot=B.Boot(50))
    assert abs(fit.params["rho"] - 0.3) < 0.3 and abs(fit.params["x1"] - 2) < 0.4
    n, w = 150, np.zeros((150, 150))
    for r in e.collect():
        w[r.src, r.dst] = r.w
    y = d.orderBy("id").toPandas().y.to_numpy()
    want = n / w.sum() * (y @ w @ y) / (y @ y)
    assert abs(graph.moran(d, e, "y").first().moran - want) < 1e-10
    i, lo, hi = graph.moran_permutation(d.withColumn("z", F.col("y") - F.lit(float(y.mean()))), e, "z", n=99)
    assert lo < hi and i > hi
    for bad in ([(1, 1, 1.0)], [(1, 2, -1.0)], [(1, 2, 1.0), (1, 2, 1.0)]):
        with pytest.raises(ValueError):
            graph.check_weights(spark.createDataFrame(bad, "src int, dst int, w double"))
    p = spark.createDataFrame([(i, float(x), 0.0, t) for i, (x, t) in enumerate([(0, 0), (1, 0), (2, 9), (10, 0), (11, 0)])], "id int, x double, y double, t int")
    comp = {r.node: r.component for r in graph.radius_components(p, 1.0).collect()}
    assert comp == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3}
    assert {r.node: r.component for r in graph.radius_components(p, 1.0, time="t", window=1).collect()}[2] == 2


def test_spatial_did(spark):
    d, e = simulate.spatial_did(spark)
    fit = spatial.spatial_did(d.withColumnRenamed("time", "t"), e, boot=B.Boot(49))
    assert abs(fit.params["post_direct"] - 2.5) < 2 and any(b[0] == "spill" for b in fit.bands)


def test_synthetic(spark):
    d = simulate.sc(spark).withColumnRenamed("time", "t")
    out = synth.synthetic_control(d).toPandas()
    assert out[out.tau >= 0].effect.mean() > 2 and abs(out[out.tau == -1].effect.iloc[0]) < 1e-12
    assert synth.synthetic_control(d, placebo=True).select("task").distinct().count() == 29
    fit = synth.sdid(simulate.sdid(spark).withColumnRenamed("time", "t"))
    assert abs(fit.params["att"] - 3) < 1.5 and fit.se["att"] > 0
    a, b = np.random.default_rng(0).normal(size=(20, 4)), np.random.default_rng(1).normal(size=20)
    w = synth.simplex_weights(a, b)
    assert abs(w.sum() - 1) < 1e-9 and (w >= 0).all()
    best = min(((a @ v - b) ** 2).sum() for v in np.random.default_rng(2).dirichlet(np.ones(4), 20_000))
    assert ((a @ w - b) ** 2).sum() <= best + 1e-6


def test_formula_reading():
    assert not formula.read_terms("0 + x")[1] and not formula.read_terms("x + 0")[1] and not formula.read_terms("x - 1")[1] and formula.read_terms("x")[1]
    assert formula.read_instruments("(x ~ z1 + z2)", "x + w") == (["x"], ["z1", "z2"], ["z1", "z2", "w"])
    assert formula.read_instruments("(x ~ 0 + z)", "x + w")[2] == ["0", "z", "w"]
    with pytest.raises(ValueError, match="depends on an endogenous variable"):
        formula.read_instruments("(x ~ z + x:z2)", "x + w")
    assert formula.read_instruments("y ~ x + w | w + z", "x + w") == (["x"], ["w", "z"], ["w", "z"])
    p = formula.parse("y ~ x + fe(a + b + a:b) + lag(z, 1:2)", options="cluster(a + b) constraints(x = 1)")
    assert p.fes == ["a", "b", "a:b"] and p.terms == ["x", "lag(z, 1:2)"] and p.options == {"cluster": ("a", "b"), "constraints": "x = 1"}


def test_formula_fits(cs, spark):
    d = cs.withColumn("k", F.col("id") % 3)
    fit = formula.estimate("y ~ treat + i.k + L.y + c.x#c.treat", d, options="cluster(id)", boot=B.Boot(20), unit="id", time="t")
    assert set(fit.params) == {"treat", "k[1]", "k[2]", "__L__:y", "x:treat", "_cons"} and fit.se["treat"] > 0
    absorbed = formula.estimate("y ~ treat + fe(id + t)", d)
    assert abs(absorbed.params["treat"] - 2) < 0.5
    x = simulate.iv(spark)
    fit = formula.estimate("y ~ x_exog + x_endog", x, iv="(x_endog ~ z1 + z2)")
    assert abs(fit.params["x_endog"] - 2) < 0.5 and abs(fit.params["x_exog"] - 3) < 0.5
    with pytest.raises(ValueError):
        formula.estimate("y ~ nothing", x)
    text = report.render({"a": fit, "b": absorbed})
    assert "x_endog" in text and "N" in text and "tabular" in report.render({"a": fit}, latex=True)
    assert report.summary({"a": fit, "b": absorbed}).count() == 4 and report.weak_instruments({"a": fit}).count() >= 3
    assert report.order_names(["post", "tau_2", "tau_-1"], "tau") == ["tau_-1", "tau_2", "post"]


def test_stream_keeps_least_squares(spark, tmp_path):
    from plumbline.streaming import incremental

    d = simulate.ols(spark).withColumn("one", F.lit(1.0)).select("x0", "x1", "one", "y")
    d.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(d.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    cols = ["x0", "x1", "one", "y"]
    q = incremental.maintain(stream, cols, str(tmp_path / "out"), str(tmp_path / "check")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    beta, n = incremental.current(spark, str(tmp_path / "out"), "y", ["x0", "x1", "one"], cols)
    p = d.toPandas()
    assert n == 200 and np.allclose(beta, np.linalg.lstsq(p[["x0", "x1", "one"]].to_numpy(), p.y, rcond=None)[0])


def test_radius_components_against_brute_force(spark):
    r = np.random.default_rng(8)
    n = 400
    x, y, t = r.uniform(-12, 12, n).round(2), r.integers(-6, 7, n).astype(float), r.integers(0, 9, n).astype(float)
    x[:40], y[:40] = x[40:80], y[40:80]  # copies
    ids = r.permutation(n)
    ids[5], x[7], y[8] = ids[6], np.nan, np.inf  # one node at two places, and two nowhere
    df = spark.createDataFrame([tuple(v) for v in zip(ids.tolist(), x.tolist(), y.tolist(), t.tolist())], "id long, x double, y double, t double")
    for radius, window in ((1.0, None), (0.7, None), (0.0, None), (2.0, 1.0), (2.0, 0.0), (3.0, 0.5)):
        with np.errstate(invalid="ignore"):
            link = (x[:, None] - x) ** 2 + (y[:, None] - y) ** 2 <= radius * radius
        link &= True if window is None else np.abs(t[:, None] - t) <= window
        link |= ids[:, None] == ids
        label = ids.copy()
        while (new := np.where(link, label, n).min(1)).tolist() != label.tolist():
            label = new
        got = graph.radius_components(df, radius, time=None if window is None else "t", window=window).collect()
        assert sorted((g.node, g.component) for g in got) == sorted(zip(ids.tolist(), label.tolist())), (radius, window)


def test_radius_components_of_many_copies(spark):
    """20,000 points at 10 places: pairs of points would be 200 million."""
    df = spark.range(20_000).selectExpr("id", "(id % 10) * 3D AS x", "0D AS y")
    whole, seen = graph.components, []

    def counted(edges, *a):
        seen.append(edges.count())
        return whole(edges, *a)

    graph.components = counted
    try:
        got = graph.radius_components(df, 2.0).groupBy("component").count().collect()
    finally:
        graph.components = whole
    assert sorted((r.component, r["count"]) for r in got) == [(i, 2000) for i in range(10)]
    assert seen == [0]
