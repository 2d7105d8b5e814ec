"""Differences in differences: cohort event studies (plain, regression, weighting, doubly robust), their cross-fitted form,
and triple differences.

All cells are handled together: grouped sums give each cell's small systems, the driver solves them, and influence terms
are column expressions.  Draws need only the sums of influence terms per (event time, multiplier key).
"""

from __future__ import annotations

import warnings
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import draws as DR
from plumbline.operators import boot as B
from plumbline.operators import panel as P
from plumbline.operators.graph import checkpointed
from plumbline.operators.ols import row_draw_sums
from plumbline.operators.result import Result

TRIM = 1e-8


def _grams(rows: DataFrame, by: Sequence[str], *asked: tuple) -> list[dict[tuple, np.ndarray]]:
    """Weighted cross-products per group, for each asked (left, right, weight) in one aggregate; a row a group comes back."""
    sums = [F.sum(w * F.col(a) * F.col(b)).alias(f"s{m}_{i}_{j}") for m, (left, right, w) in enumerate(asked) for i, a in enumerate(left) for j, b in enumerate(right)]
    out: list[dict[tuple, np.ndarray]] = [{} for _ in asked]
    for r in rows.groupBy(*by).agg(*sums).collect():
        for m, (left, right, _) in enumerate(asked):
            out[m][tuple(r[c] for c in by)] = np.array([[r[f"s{m}_{i}_{j}"] or 0.0 for j in range(len(right))] for i in range(len(left))])
    return out


def _with(rows: DataFrame, by: Sequence[str], table: dict[tuple, Sequence[float]], names: Sequence[str]) -> DataFrame:
    """Joins a small table (a row a group) to the rows."""
    kinds = {c: rows.schema[c].dataType.simpleString() for c in by}
    small = rows.sparkSession.createDataFrame([(*k, *map(float, v)) for k, v in table.items()], ", ".join([*(f"{c} {kinds[c]}" for c in by), *(f"`{n}` double" for n in names)]))
    return rows.join(F.broadcast(small), list(by))


def _dot(cov: Sequence[str], prefix: str) -> Column:
    out = F.lit(0.0)
    for i, c in enumerate(cov):
        out = out + F.col(c) * F.col(f"{prefix}{i}")
    return out


def logit(rows: DataFrame, by: Sequence[str], d: str, cov: Sequence[str], rounds: int = 50, tol: float = 1e-10, left_out: bool = False) -> tuple[dict[tuple, np.ndarray], dict[tuple, np.ndarray]]:
    """Newton steps for the logits of all groups at once: (coefficients, Hessians), one aggregate a round.

    ``left_out``: the last of ``by`` is a fold, and each fold's fit uses the other folds.
    """
    k = len(cov)

    keys = [tuple(r) for r in rows.select(*by).distinct().collect()]
    g = {key: np.zeros(k) for key in keys}
    settled: set = set()
    for _ in range(rounds):
        # With folds, sums are wanted at the other folds' coefficients, so rows meet every fold's but their own.
        if left_out:
            far = _with(rows.withColumn("_own", F.col(by[-1])).drop(by[-1]), by[:-1], {k2: [0.0] for k2 in {k[:-1] for k in keys}}, ["_one"])
            small = rows.sparkSession.createDataFrame([(*key, *map(float, g[key])) for key in keys], ", ".join([*(f"{c} {rows.schema[c].dataType.simpleString()}" for c in by), *(f"`_g{i}` double" for i in range(k))]))
            at = far.join(F.broadcast(small), list(by[:-1])).where(F.col(by[-1]) != F.col("_own"))
        else:
            at = _with(rows, by, g, [f"_g{i}" for i in range(k)])
        at = at.withColumn("_p", 1 / (1 + F.exp(-_dot(cov, "_g")))).withColumn("_s", F.col(d) - F.col("_p")).withColumn("_1", F.lit(1.0))
        h, s = _grams(at, by, (cov, cov, F.col("_p") * (1 - F.col("_p"))), (cov, ["_s"], F.lit(1.0)))
        for key in g:
            if key in settled:
                continue
            step = np.linalg.lstsq(h[key], s[key][:, 0], rcond=None)[0]
            g[key] = g[key] + step
            if float(np.abs(step).max()) <= tol:
                settled.add(key)
        if len(settled) == len(g):
            return g, h
    lost = [key for key in g if key not in settled]
    if len(lost) == len(g):
        raise RuntimeError("no cell's logit converged")
    warnings.warn(f"cells whose logit did not converge are left out: {sorted(lost)}", stacklevel=2)
    return {key: g[key] for key in settled}, {key: h[key] for key in settled}


def influence(rows: DataFrame, by: Sequence[str], cov: Sequence[str] = (), method: str = "none", trim: float = TRIM, trimming: str = "clip",
              pihat: str | None = None) -> tuple[dict[tuple, tuple], DataFrame]:
    """({cell: (att, treated, controls)}, rows with ``psi``); rows hold d, dy and covariates (with a constant) per cell.

    ``trimming``: propensities beyond [trim, 1 - trim] are clipped, or their rows dropped.  ``pihat`` names a column of given
    propensities: none are fitted then, and their estimation adds nothing to the influence terms.
    """
    cov = list(cov)
    rows = rows.withColumn("_r", F.col("dy")).withColumn("_w0", 1 - F.col("d"))
    g = h = None
    if method in ("reg", "dr"):
        xx, xy = _grams(rows, by, (cov, cov, 1 - F.col("d")), (cov, ["dy"], 1 - F.col("d")))
        beta = {c: np.linalg.lstsq(xx[c], xy[c][:, 0], rcond=None)[0] for c in xx}
        rows = _with(rows, by, beta, [f"_b{i}" for i in range(len(cov))]).withColumn("_r", F.col("dy") - _dot(cov, "_b"))
    if method in ("ipw", "dr"):
        if pihat:
            rows = rows.withColumn("_p", F.col(pihat))
        else:
            g, h = logit(rows, by, "d", cov)
            rows = _with(rows, by, g, [f"_g{i}" for i in range(len(cov))]).withColumn("_p", 1 / (1 + F.exp(-_dot(cov, "_g"))))
        if trimming == "drop":
            rows = rows.where(F.col("_p").between(trim, 1 - trim))
        rows = rows.withColumn("_p", F.least(F.lit(1 - trim), F.greatest(F.lit(trim), F.col("_p"))))
        rows = rows.withColumn("_w0", (1 - F.col("d")) * F.col("_p") / (1 - F.col("_p")))
    sums = rows.groupBy(*by).agg(F.sum("d").alias("n1"), F.sum(1 - F.col("d")).alias("n0"), F.sum("_w0").alias("w0"),
                                 F.sum(F.col("d") * F.col("_r")).alias("r1"), F.sum(F.col("_w0") * F.col("_r")).alias("r0")).collect()
    facts = {tuple(r[c] for c in by): (r.n1, r.n0, r.w0, r.r1 / r.n1, r.r0 / r.w0) for r in sums if r.n1 and r.n0}
    rows = _with(rows, by, facts, ["_count1", "_n0", "_sum_w0", "_m1", "_m0"])
    psi = F.col("d") * (F.col("_r") - F.col("_m1")) / F.col("_count1") - F.col("_w0") * (F.col("_r") - F.col("_m0")) / F.col("_sum_w0")
    if method in ("ipw", "dr"):
        rows = rows.withColumn("_c", F.col("_r") - F.col("_m0")).withColumn("_one", F.lit(1.0))
        share = F.col("_w0") / F.col("_sum_w0")
        m, a1, a0 = _grams(rows, by, (cov, ["_c"], share), (cov, ["_one"], F.col("d") / F.col("_count1")), (cov, ["_one"], share))
        none = np.zeros(len(cov))
        lift = {c: [*(none if g is None else np.linalg.lstsq(h[c], m[c][:, 0], rcond=None)[0]), *(np.linalg.lstsq(xx[c], (a1[c] - a0[c])[:, 0], rcond=None)[0] if method == "dr" else ())] for c in facts}
        rows = _with(rows, by, lift, [f"_{x}{i}" for x in ("lo" if method == "dr" else "l") for i in range(len(cov))])
        psi = psi - (F.col("d") - F.col("_p")) * _dot(cov, "_l")
        if method == "dr":
            psi = psi - (1 - F.col("d")) * F.col("_r") * _dot(cov, "_o")
    out = {c: (v[3] - v[4], int(v[0]), int(v[1])) for c, v in facts.items()}
    return out, rows.withColumn("psi", psi)


class EventStudy:
    """ATT(cohort, period) and by event time, with multiplier draws and sup-t bands."""

    def __init__(self, df: DataFrame, y: str = "y", unit: str = "id", time: str = "t", cohort: str = "g", covariates: Sequence[str] = (), method: str = "none", control: str = "notyet",
                 base: str = "varying", anticipation: int = 0, weights: str = "group", balance_e: int | None = None, boot: B.Boot | None = None, level: float = 0.95,
                 folds: int | None = None, trim: float = TRIM, trimming: str = "clip", pihat: str | None = None, common_taus: bool = False):
        if trimming not in ("clip", "drop"):
            raise ValueError("trimming is clip or drop")
        if method != "none" and not covariates and not pihat:
            method = "none"
        self.__dict__.update({k: v for k, v in locals().items() if k != "self"})

    def rows(self) -> DataFrame:
        found = P.cells(self.df, self.unit, self.time, self.cohort, self.base, self.anticipation)
        key = list(self.boot.cluster) if self.boot and self.boot.cluster else []
        keep = [*[k for k in key if k != self.unit], *([self.pihat] if self.pihat else [])]
        out = P.cell_rows(self.df, found, self.y, self.unit, self.time, self.cohort, self.control, self.anticipation, keep=keep)
        if self.pihat and not self.covariates:
            out = out.withColumn("_x_", F.lit(1.0))
        if self.covariates:
            at = self.df.select(F.col(self.unit).alias("unit"), F.col(self.time).cast("long").alias("cb"), *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(self.covariates)])
            out = out.join(at, ["unit", "cb"], "left").withColumn("_x_", F.lit(1.0))
            cov = [f"_x{i}" for i in range(len(self.covariates))]
            lost = out.groupBy("cg", "ct").agg(F.max(F.greatest(*[F.col(c).isNull().cast("int") for c in cov], F.lit(0))).alias("lost"))  # a cell with a gap uses none
            out = out.join(F.broadcast(lost), ["cg", "ct"])
            out = out.withColumns({c: F.when(F.col("lost") == 1, F.lit(0.0)).otherwise(F.col(c)) for c in cov}).drop("lost")
        return out

    def fit(self) -> Result:
        rows = checkpointed(self.rows())
        cov = [*[f"_x{i}" for i in range(len(self.covariates))], "_x_"] if self.covariates or self.pihat else []
        if self.folds:
            cells, psi = cross_fitted(rows, cov, self.folds, self.trim, self.boot.seed if self.boot else 0)
        else:
            cells, psi = influence(rows, ["cg", "ct"], cov, self.method, self.trim, self.trimming, self.pihat)
        sizes = {r["g"]: r["n"] for r in self.df.where(F.col(self.cohort) > 0).groupBy(F.col(self.cohort).alias("g")).agg(F.countDistinct(self.unit).alias("n")).collect()}
        times = sorted(r[0] for r in self.df.select(self.time).distinct().collect())
        return event_result(self, cells, psi, sizes, times)


def event_result(s, cells: dict, psi: DataFrame, sizes: dict, times: list) -> Result:
    table = [(g, t, t - g, *v) for (g, t), v in sorted(cells.items())]
    if s.balance_e is not None:  # cohorts observed up to event time balance_e only
        full = {g for g in {r[0] for r in table} if any(r[0] == g and r[2] == s.balance_e for r in table)}
        table = [r for r in table if r[0] in full and r[2] <= s.balance_e]
    if s.common_taus:  # event times that every cohort is observed at
        cohorts = {r[0] for r in table}
        table = [r for r in table if len({o[0] for o in table if o[2] == r[2]}) == len(cohorts)]
    weight = {(r[0], r[1]): {"group": sizes.get(r[0], 0), "equal": 1, "treated_t": r[4]}[s.weights] for r in table}
    taus = sorted({r[2] for r in table})
    share = {}
    for tau in taus:
        own = [(r[0], r[1]) for r in table if r[2] == tau]
        total = sum(weight[c] for c in own)
        share |= {c: weight[c] / total for c in own}
    att = {tau: sum(share[r[0], r[1]] * r[3] for r in table if r[2] == tau) for tau in taus}
    post = [t for t in taus if t >= 0]
    out = Result(s.df.sparkSession, {f"tau_{t}": att[t] for t in taus}, n_obs=sum(sizes.values()))
    if post:
        total = {t: 1.0 if s.weights == "equal" else float(sum(weight[r[0], r[1]] for r in table if r[2] == t)) for t in post}
        out.params["post_att"] = sum(total[t] * att[t] for t in post) / sum(total.values())
    out.extra["att_gt"] = s.df.sparkSession.createDataFrame([(int(g), int(t), int(e), float(a), int(n1)) for g, t, e, a, n1, _ in table], "g long, t long, tau int, att double, n_treat long")
    out.extra["att"] = att
    if s.boot:
        keys = list(s.boot.cluster)
        psi = psi.withColumnRenamed("unit", s.unit) if s.unit in keys else psi
        # Each cell is corrected for its own rows, parameters and clusters, and its influence terms are centred.
        facts = psi.groupBy("cg", "ct").agg(F.count(F.lit(1)).alias("n"), F.avg("psi").alias("mean"), *[F.countDistinct(c).alias(f"g{i}") for i, c in enumerate(keys)]).collect()
        k = len(s.covariates) + 1
        adjust = {(r.cg, r.ct): B.ssc_factor(r.n, k, [r[f"g{i}"] for i in range(len(keys))] or None, s.boot.ssc.get("adj", True), s.boot.ssc.get("cluster.adj", True)) for r in facts}
        mean = {(r.cg, r.ct): r["mean"] for r in facts}
        small = s.df.sparkSession.createDataFrame([(int(g), int(t), int(t - g), float(w) * adjust[g, t], float(mean[g, t])) for (g, t), w in share.items()], "cg long, ct long, tau int, w double, mean double")
        cols = [f"t{i}" for i in range(len(taus))]
        terms = psi.join(F.broadcast(small), ["cg", "ct"]).withColumn("_term", (F.col("psi") - F.col("mean")) * F.col("w"))
        terms = terms.withColumns({f"t{i}": F.when(F.col("tau") == t, F.col("_term")).otherwise(0.0) for i, t in enumerate(taus)})
        if keys:
            boot = B.Boot(s.boot.n, s.boot.dist, s.boot.seed, tuple(keys), s.boot.policy, s.boot.ssc, s.boot.enumerate)
            sums = checkpointed(B.draw_sums(terms.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in cols]), cols, boot))
        else:  # one multiplier a unit and period, whatever cells they are in: tasks multiply, draws leave them
            sums = row_draw_sums(terms, cols, s.boot, ["unit", "ct"])
            sums = s.df.sparkSession.createDataFrame([(b, *map(float, row)) for b, row in enumerate(sums)], ", ".join(["b int", *(f"{c} double" for c in cols)]))
        out.extra["draws"] = np.array([[r[x] for x in cols] for r in sorted(sums.collect(), key=lambda r: r.b)], float)
        out.extra["taus"] = taus
        crit, bands = B.sup_t(sums, cols, {f"t{i}": att[t] for i, t in enumerate(taus)}, s.level)
        for i, t in enumerate(taus):
            se, lo, hi = bands[f"t{i}"]
            out.se[f"tau_{t}"] = se
            out.bands.append(("post" if t >= 0 else "pre", t, att[t], se, lo, hi))
        if post:
            w = np.array([total[t] for t in post]) / sum(total.values())
            d = out.extra["draws"][:, [taus.index(t) for t in post]] @ w
            out.se["post_att"] = float(d.std(ddof=1))
        out.diagnostics["crit"] = crit
    return out


def cross_fitted(rows: DataFrame, cov: Sequence[str], folds: int, trim: float, seed: int) -> tuple[dict, DataFrame]:
    """Doubly robust cells with nuisances fitted on the other folds: att = mean_D(m1 - m0) + R1 - R0."""
    by, cov = ["cg", "ct"], list(cov) or ["_x_"]
    rows = rows.withColumn("_x_", F.lit(1.0)).withColumn("fold", F.floor(DR.uniform(seed, F.col("unit"), F.lit("fold")) * folds).cast("long"))
    key = [*by, "fold"]

    def leave_out(sums):
        total: dict[tuple, np.ndarray] = {}
        for k, v in sums.items():
            total[k[:-1]] = total.get(k[:-1], 0.0) + v
        return {k: total[k[:-1]] - v for k, v in sums.items()}

    for name, w in (("1", F.col("d")), ("0", 1 - F.col("d"))):
        xx, xy = map(leave_out, _grams(rows, key, (cov, cov, w), (cov, ["dy"], w)))
        beta = {c: np.linalg.lstsq(xx[c], xy[c][:, 0], rcond=None)[0] for c in xx}
        rows = _with(rows, key, beta, [f"_b{name}_{i}" for i in range(len(cov))]).withColumn(f"_m{name}", _dot(cov, f"_b{name}_"))
    g, _ = logit(checkpointed(rows), key, "d", cov, left_out=True)
    rows = _with(rows, key, g, [f"_g{i}" for i in range(len(cov))])
    p = F.least(F.lit(1 - trim), F.greatest(F.lit(trim), 1 / (1 + F.exp(-_dot(cov, "_g")))))
    rows = rows.withColumn("_w0", (1 - F.col("d")) * p / (1 - p))
    sums = rows.groupBy(*by).agg(F.sum("d").alias("n1"), F.sum(1 - F.col("d")).alias("n0"), F.sum("_w0").alias("w0"), F.sum(F.col("d") * (F.col("_m1") - F.col("_m0"))).alias("gap"),
                                 F.sum(F.col("d") * (F.col("dy") - F.col("_m1"))).alias("r1"), F.sum(F.col("_w0") * (F.col("dy") - F.col("_m0"))).alias("r0")).collect()
    facts = {(r.cg, r.ct): (r.n1, r.w0, r.gap / r.n1 + r.r1 / r.n1, r.r0 / r.w0, r.n0) for r in sums if r.n1 and r.w0}
    rows = _with(rows, by, facts, ["_count1", "_sum_w0", "_t1", "_t0", "_count0"])
    psi = F.col("d") * (F.col("dy") - F.col("_m0") - F.col("_t1")) / F.col("_count1") - F.col("_w0") * (F.col("dy") - F.col("_m0") - F.col("_t0")) / F.col("_sum_w0")
    return {c: (v[2] - v[3], int(v[0]), int(v[4])) for c, v in facts.items()}, rows.withColumn("psi", psi)


def triple_difference(df: DataFrame, group: str, a, b, **kw) -> Result:
    """Event study of rows with ``group`` = a less that of ``group`` = b, draws shared by key; common event times only."""
    kw.setdefault("weights", "treated_t")
    one, two = EventStudy(df.where(F.col(group) == F.lit(a)), **kw).fit(), EventStudy(df.where(F.col(group) == F.lit(b)), **kw).fit()
    taus = sorted(set(one.extra["att"]) & set(two.extra["att"])) or sorted(one.extra["att"])
    gap = {t: one.extra["att"][t] - two.extra["att"].get(t, 0.0) for t in taus}
    out = Result(df.sparkSession, {f"tau_{t}": v for t, v in gap.items()}, n_obs=one.n_obs + two.n_obs)
    post = [t for t in taus if t >= 0]
    if post:
        out.params["post_att"] = float(np.mean([gap[t] for t in post]))
    if "draws" in one.extra:
        m = min(len(one.extra["draws"]), len(two.extra["draws"]))
        d = np.column_stack([one.extra["draws"][:m, one.extra["taus"].index(t)] - (two.extra["draws"][:m, two.extra["taus"].index(t)] if t in two.extra["taus"] else 0.0) for t in taus])
        se = d.std(0, ddof=1)
        live = se > 0
        crit = B.bplus1_quantile((np.abs(d[:, live]) / se[live]).max(1), 0.05) if live.any() else 0.0
        for t, s in zip(taus, se):
            out.se[f"tau_{t}"] = float(s)
            out.bands.append(("post" if t >= 0 else "pre", t, gap[t], float(s), gap[t] - crit * s, gap[t] + crit * s))
        out.diagnostics["crit"] = crit
    return out
