"""Named queries over the tables, each an operator or estimator at work, with equivalent SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.functions import kernels as K
from plumbline.operators import boot as B
from plumbline.operators import dependent, did, fe, gls, graph, iv, linear, panel, quantile, rct, spatial, synth
from plumbline.operators.ols import OLS, linear_form
from plumbline.plans import oracles, report
from plumbline.plans.formula import estimate
from plumbline.sources.datasets import dataset, table

QUERIES: dict = {}
ORACLES: dict[str, str] = oracles.SQL
DIGITS = 6
DRAWS = 99


def query(f):
    QUERIES[f.__name__] = f
    return f


def r(c, digits: int = DIGITS):
    """Rounded for comparison, without a negative zero."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, digits) + F.lit(0.0)


def estimates(result, *names: str) -> DataFrame:
    out = result.coef().select("param", r("estimate").alias("estimate"))
    return out.where(F.col("param").isin(list(names))) if names else out


def facts(result, *metrics: str) -> DataFrame:
    return result.facts().where(F.col("metric").isin(list(metrics))).select("metric", r("value", 4).alias("value"))


# least squares


@query
def ols_simple(spark: SparkSession, sf_dir: str) -> DataFrame:
    return estimates(OLS("y", ["q"], dataset(spark, sf_dir, "lines")).fit())


@query
def ols_multi(spark, sf_dir):
    return estimates(OLS("y", ["q", "d", "x"], dataset(spark, sf_dir, "lines")).fit())


@query
def ols_categorical(spark, sf_dir):
    out = estimate("y ~ q + i.flag", dataset(spark, sf_dir, "lines")).coef()
    return out.select(F.regexp_replace("param", r"\[(\w)\]", "_$1").alias("param"), r("estimate").alias("estimate"))


@query
def ols_constrained(spark, sf_dir):
    return estimates(OLS("y", ["q", "d", "x"], dataset(spark, sf_dir, "lines"), constraints="_b[d] = x").fit())


def _line_fit(spark, sf_dir):
    d = dataset(spark, sf_dir, "lines")
    fit = OLS("y", ["q", "d", "x"], d).fit()
    return fit, fit.extra["frame"].withColumn("u", F.col("y") - linear_form(fit.extra["columns"], fit.extra["beta"]))


@query
def ols_cluster_scores(spark, sf_dir):
    fit, d = _line_fit(spark, sf_dir)
    d = d.withColumns({f"s_{c.strip('_')}": F.col(c) * F.col("u") for c in fit.extra["columns"]})
    cols = [f"s_{c.strip('_')}" for c in fit.extra["columns"]]
    return B.scores(d, cols, ("supp",)).select("supp", *[r(c, 4).alias(c) for c in cols])


@query
def ols_cluster_boot_se(spark, sf_dir):
    fit = OLS("y", ["q", "d", "x"], dataset(spark, sf_dir, "lines"), boot=B.Boot(DRAWS, seed=7, cluster=("supp",))).fit()
    return fit.coef().select("param", r("estimate").alias("estimate"), r("se").alias("se"))


@query
def ols_enum_boot_region(spark, sf_dir):
    fit = OLS("y", ["x"], dataset(spark, sf_dir, "spend"), boot=B.Boot(2000, cluster=("region",))).fit()
    return fit.coef().select("param", r("estimate").alias("estimate"), r("se").alias("se"))


# fixed effects


@query
def fe_oneway(spark, sf_dir):
    return estimates(OLS("y", ["q", "d"], dataset(spark, sf_dir, "lines"), fes=["supp"]).fit())


@query
def fe_twoway_balanced(spark, sf_dir):
    d = dataset(spark, sf_dir, "panel")
    for c in ("y", "treat"):
        d = fe.two_way_demean(d, c, "id", "t", c + "_w")
    return d.agg(r(F.sum(F.col("y_w") * F.col("treat_w")) / F.sum(F.col("treat_w") * F.col("treat_w"))).alias("estimate"))


@query
def fe_twoway_iterated(spark, sf_dir):
    """The same slope by alternating projections."""
    d = dataset(spark, sf_dir, "panel").select("id", "t", "y", F.col("treat").cast("double").alias("treat"))
    d = fe.demean(d, ["y", "treat"], ["id", "t"])
    return d.agg(r(F.sum(F.col("y") * F.col("treat")) / F.sum(F.col("treat") * F.col("treat"))).alias("estimate"))


@query
def fe_singletons(spark, sf_dir):
    kept, dropped = fe.drop_singletons(dataset(spark, sf_dir, "gappy"), ["id"])
    return kept.agg(F.count(F.lit(1)).alias("kept"), r(F.sum("v"), 2).alias("v")).withColumn("dropped", F.lit(dropped).cast("long"))


@query
def fe_dof(spark, sf_dir):
    dof = fe.degrees_of_freedom(dataset(spark, sf_dir, "spend"), ["nation", "segment"])
    return spark.createDataFrame([(k, *v) for k, v in dof.items()], "fe string, levels long, redundant long")


@query
def fe_nested(spark, sf_dir):
    d = dataset(spark, sf_dir, "spend")
    return spark.createDataFrame([("nation", "region", fe.nested(d, "nation", "region")), ("segment", "region", fe.nested(d, "segment", "region"))], "low string, high string, nested boolean")


# panel operators


@query
def panel_lag_gap(spark, sf_dir):
    return panel.lag(dataset(spark, sf_dir, "gappy"), "v", 1, name="lag1").select("id", "t", "v", "lag1")


@query
def panel_lead(spark, sf_dir):
    return panel.lag(dataset(spark, sf_dir, "gappy"), "v", -1, name="lead1").select("id", "t", "v", "lead1")


@query
def panel_diff2(spark, sf_dir):
    return panel.difference(dataset(spark, sf_dir, "gappy"), "v", 2, name="diff2").select("id", "t", "diff2")


@query
def panel_lag_range(spark, sf_dir):
    d = dataset(spark, sf_dir, "gappy")
    for k in (1, 2, 3):
        d = panel.lag(d, "v", k, name=f"lag{k}")
    return d.select("id", "t", "lag1", "lag2", "lag3")


@query
def panel_segments(spark, sf_dir):
    return panel.segments(dataset(spark, sf_dir, "gappy"), "id", "t").select("id", "t", F.col("segment").cast("long").alias("segment"))


@query
def first_treated(spark, sf_dir):
    return panel.first_treated(dataset(spark, sf_dir, "panel"), "treat").select("id", F.col("g").cast("long").alias("g"))


# cross-products and moments


@query
def gram_weighted(spark, sf_dir):
    cols = ["q", "d", "x", "y"]
    g, _ = linear.gram(dataset(spark, sf_dir, "lines"), cols, "q")
    n = table(spark, sf_dir, "lineitem").count()
    return spark.createDataFrame([(a, b, round(float(g[i, j]) / n, 6)) for i, a in enumerate(cols) for j, b in enumerate(cols) if i <= j], "a string, b string, mean double")


@query
def col_var_weighted(spark, sf_dir):
    return linear.weighted_moments(dataset(spark, sf_dir, "lines"), "y", "q").select(*[r(c).alias(c) for c in ("mean", "var_unbiased", "var_pweight")])


@query
def leverage(spark, sf_dir):
    d = dataset(spark, sf_dir, "spend").withColumn("_cons", F.lit(1.0))
    return linear.leverage(d, ["x", "_cons"]).select("id", r("leverage", 8).alias("leverage"))


@query
def quantile_type1(spark, sf_dir):
    d = table(spark, sf_dir, "orders")
    return d.groupBy("o_orderpriority").agg(*[F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY o_totalprice)").alias(n) for p, n in ((0.25, "q25"), (0.5, "q50"), (0.75, "q75"))])


def _supplier_draws(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), (F.col("s_acctbal") / 1000).alias("v"))
    return B.draw_sums(d, ["v"], B.Boot(DRAWS, seed=5, cluster=("key",), enumerate=False))


@query
def bplus1_quantile(spark, sf_dir):
    draws = [x.v for x in _supplier_draws(spark, sf_dir).collect()]
    return spark.createDataFrame([(round(B.bplus1_quantile(draws, 0.05), DIGITS) + 0.0,)], "value double")


@query
def draw_iqr_band(spark, sf_dir):
    """The band whose scale is the draws' type-1 interquartile range."""
    _, bands = B.sup_t(_supplier_draws(spark, sf_dir), ["v"], {"v": 5.0}, scale="iqr")
    return spark.createDataFrame([bands["v"]], "se double, lower double, upper double").select(*[r(c).alias(c) for c in ("se", "lower", "upper")])


@query
def ssc_factor(spark, sf_dir):
    d = dataset(spark, sf_dir, "lines")
    n, g = d.agg(F.count(F.lit(1)), F.countDistinct("supp")).first()
    return spark.createDataFrame([(n, g, round(B.ssc_factor(n, 4, [g]), 10))], "n long, g long, factor double")


def _moments(spark, sf_dir, cluster):
    _, d = _line_fit(spark, sf_dir)
    cols = ["q", "d", "x"]
    m = iv.moment_covariance(d, cols, "u", cluster)
    n = d.count()
    return spark.createDataFrame([(a, b, round(float(m[i, j]) / n, 5)) for i, a in enumerate(cols) for j, b in enumerate(cols) if i <= j], "a string, b string, value double")


@query
def moment_cov_oneway(spark, sf_dir):
    return _moments(spark, sf_dir, ("supp",))


@query
def moment_cov_multiway(spark, sf_dir):
    return _moments(spark, sf_dir, ("supp", "part"))


@query
def collinear_columns(spark, sf_dir):
    d = dataset(spark, sf_dir, "lines").withColumn("twice", 2 * F.col("q")).withColumn("sum", F.col("d") + F.col("x"))
    kept, _ = linear.screen(d, ["q", "twice", "d", "x", "sum"])
    return spark.createDataFrame([(len(kept),)], "rank long")


# instruments


def _iv(spark, sf_dir, cls=iv.IV, **kw):
    return cls("y", ["x"], ["w"], ["z1", "z2"], dataset(spark, sf_dir, "ivset"), **kw)


@query
def iv_2sls(spark, sf_dir):
    return estimates(_iv(spark, sf_dir).fit())


@query
def iv_partial_f(spark, sf_dir):
    return facts(_iv(spark, sf_dir).fit(), "partial_f_x")


@query
def iv_sargan(spark, sf_dir):
    return facts(_iv(spark, sf_dir).fit(), "sargan")


def _rounded(coef: DataFrame) -> DataFrame:
    return coef.select("param", r("estimate").alias("estimate"), r("se").alias("se"))


@query
def iv_cluster_boot_se(spark, sf_dir):
    out = _iv(spark, sf_dir, boot=B.Boot(DRAWS, seed=3, cluster=("cluster",))).fit().coef()
    return out.select("param", r("estimate", 5).alias("estimate"), r("se", 4).alias("se"))


@query
def iv_rank(spark, sf_dir):
    return facts(_iv(spark, sf_dir, boot=B.Boot(2, cluster=("cluster",))).fit(), "kp_rk_lm", "kp_rk_wald_f")


@query
def iv_effective_f(spark, sf_dir):
    return facts(_iv(spark, sf_dir, boot=B.Boot(2, cluster=("cluster",))).fit(), "mop_effective_f")


@query
def gmm_user_weight(spark, sf_dir):
    return estimates(_iv(spark, sf_dir, iv.GMM, weight=[[float((i + 1) * (i == j)) for j in range(4)] for i in range(4)]).fit())


@query
def gmm_2step_boot_se(spark, sf_dir):
    """The weight matrix estimated anew in every draw."""
    return _iv(spark, sf_dir, iv.GMM, weight="two-step", boot=B.Boot(DRAWS, seed=3, cluster=("cluster",))).fit().coef()


@query
def gmm_identity(spark, sf_dir):
    return estimates(_iv(spark, sf_dir, iv.GMM).fit())


@query
def gmm_2sls(spark, sf_dir):
    return estimates(_iv(spark, sf_dir, iv.GMM, weight="2sls").fit())


@query
def gmm_2step(spark, sf_dir):
    return estimates(_iv(spark, sf_dir, iv.GMM, weight="two-step").fit())


@query
def anderson_rubin(spark, sf_dir):
    stat, crit, reject = iv.anderson_rubin(dataset(spark, sf_dir, "ivset"), "y", "x", ["w"], ["z1", "z2"], 0.0, B.Boot(DRAWS, cluster=("cluster",)))
    return spark.createDataFrame([(round(stat, 4), round(crit, 4), reject)], "statistic double, critical double, reject boolean")


@query
def wald_ols(spark, sf_dir):
    fit = OLS("y", ["q", "d", "x"], dataset(spark, sf_dir, "lines"), boot=B.Boot(DRAWS, seed=7, cluster=("supp",))).fit()
    rm, q, _ = linear.parse_constraints("d = 0; x = 0", ["q", "d", "x", "_cons"])
    stat, draws = B.wald(fit.extra["draws"], fit.extra["beta"], rm, q)
    return spark.createDataFrame([(round(stat, 4), round(B.bplus1_quantile(draws, 0.05), 4))], "statistic double, critical double")


def _under_null(spark, sf_dir):
    return OLS("y", ["q", "d", "x"], dataset(spark, sf_dir, "lines"), boot=B.Boot(DRAWS, seed=7, cluster=("supp",)), null="x = 0").fit()


@query
def ols_null_boot_se(spark, sf_dir):
    rows = [(k, float(v)) for k, v in _under_null(spark, sf_dir).extra["null_se"].items()]
    return spark.createDataFrame(rows, "param string, se double").select("param", r("se").alias("se"))


@query
def ols_null_wald(spark, sf_dir):
    return facts(_under_null(spark, sf_dir), "wald", "wald_crit")


@query
def ols_twoway_boot_se(spark, sf_dir):
    """Clustered two ways: the product of both ways' multipliers."""
    fit = OLS("y", ["q", "d", "x"], dataset(spark, sf_dir, "lines"), boot=B.Boot(DRAWS, seed=7, cluster=("supp", "status"))).fit()
    return _rounded(fit.coef())


@query
def ols_robust_webb_se(spark, sf_dir):
    """Six-point multipliers by supplier."""
    fit = OLS("y", ["q", "d", "x"], dataset(spark, sf_dir, "lines"), boot=B.Boot(DRAWS, "webb", seed=7, cluster=("supp",))).fit()
    return _rounded(fit.coef())


@query
def ols_row_boot_se(spark, sf_dir):
    """Rows that repeat, and no key: each row is drawn for itself."""
    d = table(spark, sf_dir, "lineitem").select((F.col("l_linestatus") == "F").cast("double").alias("y"), (F.col("l_returnflag") == "R").cast("double").alias("x"))
    return _rounded(OLS("y", ["x"], d, boot=B.Boot(DRAWS, seed=4)).fit().coef())


# event studies


def _study(spark, sf_dir, **kw):
    return did.EventStudy(dataset(spark, sf_dir, "panel"), **kw).fit()


def _taus(fit) -> DataFrame:
    spark = fit.spark
    return spark.createDataFrame([(t, float(v)) for t, v in fit.extra["att"].items()], "tau int, att double").select("tau", r("att").alias("att"))


@query
def es_cells(spark, sf_dir):
    return panel.cell_frame(spark, panel.cells(dataset(spark, sf_dir, "panel"))).select(F.col("cg").alias("g"), F.col("ct").alias("t"), F.col("cb").alias("base"))


@query
def es_att_gt(spark, sf_dir):
    return _study(spark, sf_dir).extra["att_gt"].select("g", "t", "tau", r("att").alias("att"), "n_treat")


@query
def es_att_gt_never(spark, sf_dir):
    return _study(spark, sf_dir, control="never").extra["att_gt"].select("g", "t", "tau", r("att").alias("att"), "n_treat")


@query
def es_att_tau_equal(spark, sf_dir):
    return _taus(_study(spark, sf_dir, weights="equal"))


@query
def es_att_tau_group(spark, sf_dir):
    return _taus(_study(spark, sf_dir, weights="group"))


@query
def es_att_tau_treated_t(spark, sf_dir):
    return _taus(_study(spark, sf_dir, weights="treated_t"))


@query
def es_post_att(spark, sf_dir):
    return estimates(_study(spark, sf_dir), "post_att")


@query
def es_balance_e(spark, sf_dir):
    return _taus(_study(spark, sf_dir, weights="equal", balance_e=3))


@query
def es_supt_band(spark, sf_dir):
    fit = _study(spark, sf_dir, weights="equal", boot=B.Boot(DRAWS, seed=11, cluster=("cluster",)))
    return fit.band().select("side", "tau", r("estimate").alias("estimate"), r("se").alias("se"), r("lower", 5).alias("lower"), r("upper", 5).alias("upper"))


@query
def es_percentiles(spark, sf_dir):
    fit = _study(spark, sf_dir, weights="equal", boot=B.Boot(DRAWS, seed=11, cluster=("cluster",)))
    return report.percentile_plot(fit, (0.05, 0.5, 0.95)).select("tau", "level", r("value", 5).alias("value"))


@query
def balance_plot(spark, sf_dir):
    d = _by_stratum_share(spark, sf_dir).withColumn("wt", F.when(F.col("arm") == 1, 1 / F.col("p")).otherwise(1 / (1 - F.col("p"))))
    return report.balance_plot(d, "arm", ["y", "x"], "wt").select("covariate", "sample", r("smd").alias("smd"))


@query
def es_reg(spark, sf_dir):
    return _study(spark, sf_dir, method="reg", covariates=["x"]).extra["att_gt"].select("g", "t", "tau", r("att").alias("att"), "n_treat")


@query
def es_ipw(spark, sf_dir):
    return _study(spark, sf_dir, method="ipw", covariates=["x"]).extra["att_gt"].select("g", "t", "tau", r("att").alias("att"), "n_treat")


@query
def es_dr(spark, sf_dir):
    band = _study(spark, sf_dir, method="dr", covariates=["x"], boot=B.Boot(DRAWS, cluster=("cluster",))).band()
    return band.select("side", "tau", r("estimate", 5).alias("estimate"), r("se", 5).alias("se"), r("lower", 4).alias("lower"), r("upper", 4).alias("upper"))


@query
def dr_const_only(spark, sf_dir):
    """Doubly robust with a constant only is the difference of means."""
    d = dataset(spark, sf_dir, "panel").withColumn("one", F.lit(1.0))
    rows = panel.cell_rows(d, panel.cells(d), "y").withColumn("one", F.lit(1.0))
    found, _ = did.influence(rows, ["cg", "ct"], ["one"], "dr")
    return spark.createDataFrame([(g, t, float(v[0])) for (g, t), v in found.items()], "g long, t long, att double").select("g", "t", r("att").alias("att"))


@query
def dr_cross_fitted(spark, sf_dir):
    return _study(spark, sf_dir, covariates=["x"], folds=3).extra["att_gt"].select("g", "t", "tau", r("att").alias("att"), "n_treat")


@query
def ddd_tau(spark, sf_dir):
    fit = did.triple_difference(dataset(spark, sf_dir, "panel"), "segment", "AUTOMOBILE", "BUILDING", weights="equal")
    return spark.createDataFrame([(int(k[4:]), float(v)) for k, v in fit.params.items() if k.startswith("tau_")], "tau int, att double").select("tau", r("att").alias("att"))


# randomised trials


@query
def rct_ra(spark, sf_dir):
    return estimates(rct.RCT(dataset(spark, sf_dir, "rct"), "y", "arm", ["x"], p=0.5).fit(), "RA_ATE__1_vs_0", "RA_ATT__1_vs_0", "RA_ATC__1_vs_0")


def _by_stratum_share(spark, sf_dir):
    return dataset(spark, sf_dir, "rct").withColumn("p", F.avg("arm").over(Window.partitionBy("stratum")))


def _ipw(spark, sf_dir, target):
    return estimates(rct.RCT(_by_stratum_share(spark, sf_dir), "y", "arm", p="p").fit(), f"IPW_{target}__1_vs_0")


@query
def rct_ipw_ate(spark, sf_dir):
    return _ipw(spark, sf_dir, "ATE")


@query
def rct_ipw_att(spark, sf_dir):
    return _ipw(spark, sf_dir, "ATT")


@query
def rct_ipw_atc(spark, sf_dir):
    return _ipw(spark, sf_dir, "ATC")


@query
def rct_by_stratum(spark, sf_dir):
    out = rct.RCT(dataset(spark, sf_dir, "rct"), "y", "arm", stratum="stratum").fit()
    return estimates(out).where("param LIKE 'IPW_ATE__1_vs_0_S%'")


@query
def rct_band(spark, sf_dir):
    return rct.RCT(dataset(spark, sf_dir, "rct"), "y", "arm", ["x"], boot=B.Boot(DRAWS)).fit().band()


@query
def rct_cluster_se(spark, sf_dir):
    out = rct.RCT(dataset(spark, sf_dir, "rct"), "y", "arm", p=0.5, stratum="stratum", boot=B.Boot(DRAWS, seed=2, cluster=("nation",))).fit().coef()
    return _rounded(out.where("param IN ('RA_ATE__1_vs_0', 'IPW_ATE__1_vs_0')"))


@query
def rct_overlap(spark, sf_dir):
    return rct.overlapping(dataset(spark, sf_dir, "rct"), "arm", "stratum", 1, 0).groupBy("stratum").agg(F.count(F.lit(1)).alias("n"))


@query
def balance_smd(spark, sf_dir):
    return rct.balance(dataset(spark, sf_dir, "rct"), "arm", ["y", "x"]).select("covariate", *[r(c).alias(c) for c in ("mean1", "mean0", "smd")])


# graphs


def _nations(spark, sf_dir):
    return dataset(spark, sf_dir, "nations"), dataset(spark, sf_dir, "edges")


@query
def slag_row(spark, sf_dir):
    d, e = _nations(spark, sf_dir)
    return graph.spatial_lag(d, graph.normalised(e, "W"), "x", name="lag").select("id", r("lag").alias("lag"))


@query
def slag_raw(spark, sf_dir):
    d, e = _nations(spark, sf_dir)
    return graph.spatial_lag(d, graph.normalised(e, "B"), "x", name="lag").select("id", r("lag").alias("lag"))


@query
def moran(spark, sf_dir):
    d, e = _nations(spark, sf_dir)
    return graph.moran(d, e, "x").select(r("moran").alias("moran"), "n")


@query
def moran_panel(spark, sf_dir):
    d = dataset(spark, sf_dir, "panel").groupBy(F.col("cluster").alias("id"), "t").agg(F.avg("y").alias("y"))
    return graph.moran(d, dataset(spark, sf_dir, "edges"), "y", by=["t"]).select(r("moran").alias("moran"), "n")


@query
def moran_permutation(spark, sf_dir):
    d, e = _nations(spark, sf_dir)
    i, lo, hi = graph.moran_permutation(d, e, "x", n=199)
    return spark.createDataFrame([tuple(round(float(v), DIGITS) + 0.0 for v in (i, lo, hi))], "moran double, lower double, upper double")


@query
def sar_instruments(spark, sf_dir):
    d, e = _nations(spark, sf_dir)
    out, _ = spatial.sar_instruments(d, e, ["x"])
    return out.select("id", r("W_x").alias("wx"), r("WW_x").alias("wwx"))


@query
def sar(spark, sf_dir):
    d, e = _nations(spark, sf_dir)
    return spatial.sar(d, e, "y", ["x"]).coef().select("param", r("estimate", 4).alias("estimate"))


@query
def radius_components(spark, sf_dir):
    d = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_acctbal") / 100).alias("x"), F.col("s_nationkey").cast("double").alias("y"))
    return graph.radius_components(d, 2.0).select(F.col("node").alias("id"), "component")


@query
def exposure(spark, sf_dir):
    """Weight of each nation's neighbours by their cohort."""
    d, e = _nations(spark, sf_dir)
    d = d.withColumn("g", F.when(F.col("id") % 5 > 0, 1996 + F.col("id") % 5).otherwise(0))
    return spatial.exposure(d, e).select("cg", "unit", r("e").alias("exposure"))


@query
def spatial_did(spark, sf_dir):
    d = dataset(spark, sf_dir, "panel").groupBy(F.col("cluster").alias("id"), "t").agg(F.avg("y").alias("y"))
    d = d.withColumn("g", F.when(F.col("id").isin(0, 5, 7), F.lit(1998)).when(F.col("id").isin(1, 3), F.lit(1999)).otherwise(F.lit(0)))
    band = spatial.spatial_did(d, dataset(spark, sf_dir, "edges"), boot=B.Boot(DRAWS, cluster=("unit",))).band()
    return band.select("side", "tau", r("estimate").alias("estimate"), r("se").alias("se"), r("lower", 4).alias("lower"), r("upper", 4).alias("upper"))


# generalised least squares


@query
def gls_wls(spark, sf_dir):
    d = dataset(spark, sf_dir, "lines").withColumn("wt", F.col("q"))
    return estimates(gls.wls(d, "y", ["d", "x"], "wt"))


@query
def gls_pw_twostep(spark, sf_dir):
    out = gls.ar1(dataset(spark, sf_dir, "monthly"), "y", ["x"], "s", "t", iterate=False)
    return estimates(out).unionByName(spark.createDataFrame([("rho", out.diagnostics["rho"])], "param string, estimate double").select("param", r("estimate").alias("estimate")))


@query
def gls_pw_iterated(spark, sf_dir):
    out = gls.ar1(dataset(spark, sf_dir, "monthly"), "y", ["x"], "s", "t")
    return estimates(out).unionByName(spark.createDataFrame([("rho", out.diagnostics["rho"])], "param string, estimate double").select("param", r("estimate").alias("estimate")))


@query
def gls_ar1_boot_se(spark, sf_dir):
    """Every draw has a rho of its own; five units, so the full grid of signs."""
    out = gls.ar1(dataset(spark, sf_dir, "monthly"), "y", ["x"], "s", "t", iterate=False, boot=B.Boot(DRAWS))
    return out.coef().select("param", r("se").alias("se"))


@query
def gls_psar1(spark, sf_dir):
    return estimates(gls.psar1(dataset(spark, sf_dir, "monthly"), "y", ["x"], "s", "t"))


@query
def gls_psar1_boot_se(spark, sf_dir):
    """Every draw has a rho for each unit."""
    return gls.psar1(dataset(spark, sf_dir, "monthly"), "y", ["x"], "s", "t", boot=B.Boot(DRAWS)).coef().select("param", r("se").alias("se"))


@query
def gls_exch_boot_se(spark, sf_dir):
    """Every draw has a correlation of its own."""
    return gls.exchangeable(dataset(spark, sf_dir, "ordered"), "y", ["x"], "id", boot=B.Boot(DRAWS, seed=8)).coef().select("param", r("se").alias("se"))


@query
def gls_exch_rho(spark, sf_dir):
    out = gls.exchangeable(dataset(spark, sf_dir, "panel"), "y", ["x"], "id")
    return spark.createDataFrame([(float(out.diagnostics["rho"]),)], "rho double").select(r("rho").alias("rho"))


# synthetic controls, quantiles


def _states(spark, sf_dir, cohorts) -> DataFrame:
    d = dataset(spark, sf_dir, "panel").groupBy(F.col("cluster").alias("id"), "t").agg(F.avg("y").alias("y"))
    g = F.lit(0)
    for unit, start in cohorts.items():
        g = F.when(F.col("id") == unit, F.lit(start)).otherwise(g)
    return d.withColumn("g", g)


@query
def sc_weights(spark, sf_dir):
    return synth.synthetic_control(_states(spark, sf_dir, {3: 1999})).select("task", "t", "tau", r("gap", 4).alias("gap"), r("effect", 4).alias("effect"))


@query
def sdid_att(spark, sf_dir):
    return synth.sdid(_states(spark, sf_dir, {3: 1999, 4: 1999, 7: 2000})).coef()


@query
def qr_median(spark, sf_dir):
    return estimates(quantile.QR("y", ["q"], dataset(spark, sf_dir, "lines")).fit())


@query
def ivqr_small(spark, sf_dir):
    return quantile.ivqr(dataset(spark, sf_dir, "ivset"), "y", "x", ["w"], ["z1"], points=21, rounds=3).coef()


@query
def gls_full(spark, sf_dir):
    """Errors of nations in one region are alike: the precision matrix by its entries."""
    d, e = _nations(spark, sf_dir)
    pairs = e.select(F.col("src").alias("a"), F.col("dst").alias("b"), (F.col("w") * -0.5).alias("w")).unionByName(d.select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("w")))
    return estimates(gls.full(d, "y", ["x"], pairs, "id"))


@query
def rct_strata_dummies(spark, sf_dir):
    d, names = rct.strata_dummies(dataset(spark, sf_dir, "rct"), "stratum", "id")
    return estimates(OLS("y", ["arm", *names], d).fit())


@query
def rct_trim_drop(spark, sf_dir):
    """Rows whose probability, here by stratum, lies outside the middle are left out."""
    d = _by_stratum_share(spark, sf_dir)
    return estimates(rct.RCT(d, "y", "arm", p="p", trim=0.45, trimming="drop").fit(), "IPW_ATE__1_vs_0")


@query
def es_common_taus(spark, sf_dir):
    return _taus(_study(spark, sf_dir, weights="equal", common_taus=True))


@query
def es_given_propensity(spark, sf_dir):
    d = dataset(spark, sf_dir, "panel").withColumn("pi", F.lit(0.3) + F.col("cluster") / 100)
    return did.EventStudy(d, method="ipw", pihat="pi").fit().extra["att_gt"].select("g", "t", "tau", r("att").alias("att"), "n_treat")


@query
def fe_weightless(spark, sf_dir):
    """Suppliers whose weights are all zero drop out before demeaning."""
    d = dataset(spark, sf_dir, "lines").withColumn("wt", F.when(F.col("flag") == "R", F.col("d")).otherwise(0.0))
    left, gone = fe.drop_weightless(d, "wt", ["part"])
    return left.agg(F.count(F.lit(1)).alias("kept"), r(F.sum("wt"), 4).alias("weight")).withColumn("dropped", F.lit(gone).cast("long"))


@query
def duplicate_columns(spark, sf_dir):
    d = dataset(spark, sf_dir, "lines").withColumn("again", F.col("q")).withColumn("flat", F.lit(2.0)).withColumn("most", F.greatest("d", F.lit(0.0)))
    cols = ["q", "d", "again", "most", "flat"]
    same, fixed = linear.duplicate_columns(d, cols), linear.constant_columns(d, cols)
    return spark.createDataFrame([(c, c in same, c in fixed) for c in cols], "name string, duplicate boolean, constant boolean")


@query
def finite_mask(spark, sf_dir):
    """Logs of nothing, negative roots and missing lags are left out."""
    d = panel.lag(dataset(spark, sf_dir, "gappy"), "v", 1, name="past").withColumn("l", F.log(F.col("v") - 20)).withColumn("z", F.lit(1.0) / F.nullif(F.col("t") - 3, F.lit(0)))
    return d.where(linear.finite(["past", "l", "z"])).agg(F.count(F.lit(1)).alias("n"), r(F.sum("l"), 4).alias("total"))


@query
def first_difference(spark, sf_dir):
    return panel.first_difference(dataset(spark, sf_dir, "gappy"), "v").select("id", "t", F.col("d_v"))


@query
def fe_missing_ids(spark, sf_dir):
    d = dataset(spark, sf_dir, "ordered").withColumn("a", F.when(F.col("x") < 4, F.col("x"))).withColumn("b", F.when(F.col("y") < 5, F.col("t")))
    left, gone = fe.drop_missing(d, ["a", "b"])
    return left.agg(F.count(F.lit(1)).alias("kept")).withColumn("dropped", F.lit(gone).cast("long"))


@query
def kernel_density(spark, sf_dir):
    """The normal density of a share of balances at Silverman's bandwidth."""
    d = table(spark, sf_dir, "supplier").select((F.col("s_acctbal") / 1000).alias("v"))
    n, s, q = d.agg(F.count(F.lit(1)), F.stddev_samp("v"), F.expr("percentile(v, 0.75) - percentile(v, 0.25)")).first()
    h = 0.9 * min(s, q / 1.34) * n ** -0.2
    return d.agg(r(F.avg(F.exp(-F.pow((F.col("v") - 4) / h, F.lit(2.0)) / 2) / (2 * 3.141592653589793) ** 0.5) / h, 8).alias("density"))


@query
def gls_exchangeable(spark, sf_dir):
    return estimates(gls.exchangeable(dataset(spark, sf_dir, "ordered"), "y", ["x"], "id"))


@query
def gls_corc(spark, sf_dir):
    out = gls.ar1(dataset(spark, sf_dir, "monthly"), "y", ["x"], "s", "t", head="corc", iterate=False)
    return estimates(out)


@query
def mammen_draws(spark, sf_dir):
    d = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key")).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(9))))
    sums = [r(F.sum(B.draws.multiplier(k, 5, F.col("key"), F.col("b"))), 8).alias(k) for k in ("mammen", "webb", "exp", "normal")]
    return d.groupBy("b").agg(*sums).withColumn("b", F.col("b").cast("long"))


@query
def fe_recovered(spark, sf_dir):
    """Suppliers' effects of a fit with absorbed suppliers."""
    d = dataset(spark, sf_dir, "lines")
    fit = OLS("y", ["q"], d, fes=["supp"]).fit()
    out = fe.recover(d.withColumn("_r", F.col("y") - linear_form(["q"], list(fit.params.values()))), "_r", ["supp"])["supp"]
    return out.select("supp", r("effect", 5).alias("effect"))


# formulas


@query
def formula_factor(spark, sf_dir):
    return _named(estimate("y ~ q + C(flag, Treatment(reference='R'))", dataset(spark, sf_dir, "lines")))


def _named(fit) -> DataFrame:
    return fit.coef().select("param", r("estimate").alias("estimate"))


@query
def formula_product(spark, sf_dir):
    return _named(estimate("y ~ q*d + i.status", dataset(spark, sf_dir, "lines")))


@query
def formula_transform(spark, sf_dir):
    return _named(estimate("np.log(y) ~ np.log(q) + I(d ** 2) + I((x > 0.3) * d)", dataset(spark, sf_dir, "lines")))


@query
def formula_constraint(spark, sf_dir):
    return _named(estimate("y ~ q + d + x", dataset(spark, sf_dir, "lines"), options="constraints(d = x)"))


@query
def formula_iv(spark, sf_dir):
    return _named(estimate("y ~ x + w", dataset(spark, sf_dir, "ivset"), iv="(x ~ z1 + z2)"))


@query
def formula_fe(spark, sf_dir):
    return _named(estimate("y ~ q + d + fe(supp)", dataset(spark, sf_dir, "lines")))


@query
def formula_lag(spark, sf_dir):
    return _named(estimate("v ~ lag(v, 1)", dataset(spark, sf_dir, "gappy"), unit="id", time="t"))


@query
def fe_twoway_unbalanced(spark, sf_dir):
    fit = OLS("y", ["x"], dataset(spark, sf_dir, "ordered"), fes=["id", "t"]).fit()
    return estimates(fit, "x").select("estimate")


# scalar functions


@query
def hac_kernels(spark, sf_dir):
    d = spark.range(0, 31).select((F.col("id") / 20).alias("x"))
    return d.select("x", *[r(K.hac(F.col("x"), k), 8).alias(k) for k in ("bartlett", "parzen", "qs")])


@query
def haversine(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), (F.col("n_nationkey") * 14.0 - 170).alias("lon"), (F.col("n_nationkey") * 7.0 - 85).alias("lat"))
    m = n.select((F.col("k") + 1).alias("k"), F.col("lon").alias("lon2"), F.col("lat").alias("lat2"))
    return n.join(m, "k").select("k", r(K.haversine(F.col("lon"), F.col("lat"), F.col("lon2"), F.col("lat2")), 4).alias("km"))


@query
def bandwidths(spark, sf_dir):
    n = table(spark, sf_dir, "orders").count()
    rows = [("nw94", K.bandwidth_nw94(n)), *((k, K.bandwidth_andrews91(n, k)) for k in ("qs", "bartlett", "parzen"))]
    return spark.createDataFrame([(k, round(v, 6)) for k, v in rows], "method string, bandwidth double")


@query
def multiplier_draws(spark, sf_dir):
    d = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"))
    d = d.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(9))))
    return d.groupBy("b").agg(F.sum(B.draws.multiplier("rademacher", 5, F.col("key"), F.col("b"))).alias("total")).select(F.col("b").cast("long").alias("b"), "total")



# dependence in time and space


@query
def time_kernel(spark, sf_dir):
    return dependent.time_kernel(dataset(spark, sf_dir, "panel"), "t", 3.0).select("s", "t", r("k").alias("k"))


@query
def space_kernel(spark, sf_dir):
    d = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_acctbal") / 100).alias("x"), F.col("s_nationkey").cast("double").alias("y"))
    return dependent.space_kernel(d, 5.0).select("a", "b", r("k").alias("k"))


@query
def time_multipliers(spark, sf_dir):
    return dependent.time_multipliers(dataset(spark, sf_dir, "monthly"), "t", 19)


@query
def space_cluster_multipliers(spark, sf_dir):
    d = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_acctbal") / 100).alias("x"), F.col("s_nationkey").cast("double").alias("y"))
    out = dependent.space_cluster_multipliers(d, 10, 2.0, seed=6)
    return out.groupBy("b").agg(F.sum("w").alias("total")).select(F.col("b").cast("long").alias("b"), "total")
