"""Spatial estimators over edge lists: spatial autoregression and spatial differences in differences."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators import boot as B
from plumbline.operators import graph as G
from plumbline.operators import panel as P
from plumbline.operators.did import _dot, _grams, _with
from plumbline.operators.graph import checkpointed
from plumbline.operators.iv import IV
from plumbline.operators.result import Result


def sar_instruments(df: DataFrame, edges: DataFrame, x: Sequence[str], key: str = "id") -> tuple[DataFrame, list[str]]:
    """Adds WX and W(WX); returns their names."""
    names = []
    for c in x:
        df = G.spatial_lag(df, edges, c, key, name=f"W_{c}")
        df = G.spatial_lag(df, edges, f"W_{c}", key, name=f"WW_{c}")
        names += [f"W_{c}", f"WW_{c}"]
    return df, names


def sar(df: DataFrame, edges: DataFrame, y: str, x: Sequence[str], key: str = "id", boot: B.Boot | None = None) -> Result:
    """y = rho W y + X beta + u by two-stage least squares with WX and WWX; Moran's I of the residuals."""
    G.check_weights(edges)
    d, z = sar_instruments(df, edges, x, key)
    d = checkpointed(G.spatial_lag(d, edges, y, key, name="rho"))
    out = IV(y, ["rho"], list(x), z, d, boot, key=[key]).fit()
    out.diagnostics["moran"] = G.moran(out.extra["frame"], edges, "_u", key).first().moran
    return out


def exposure(df: DataFrame, edges: DataFrame, unit: str = "id", cohort: str = "g") -> DataFrame:
    """(cg, unit, e): the weight of each unit's neighbours of cohort cg; units without such neighbours are left out."""
    treated = df.where(F.col(cohort) > 0).select(F.col(unit).alias("dst"), F.col(cohort).cast("long").alias("cg")).distinct()
    return edges.join(treated, "dst").groupBy("cg", F.col("src").alias("unit")).agg(F.sum("w").alias("e"))


def spatial_did(df: DataFrame, edges: DataFrame, y: str = "y", unit: str = "id", time: str = "t", cohort: str = "g", control: str = "notyet", boot: B.Boot | None = None, level: float = 0.95) -> Result:
    """Per cell, least squares of the long difference (from the period before the cohort's first) on [1, treated, S].

    S is the controls' exposure, the weight of their treated neighbours of the cohort, over its mean among controls.
    Direct and spill paths by event time, cohorts weighted by size, each less its value at tau = -1.
    """
    times = sorted(r[0] for r in df.select(time).distinct().collect())
    cohorts = sorted(r[0] for r in df.where(F.col(cohort) > 0).select(cohort).distinct().collect())
    at = {t: i for i, t in enumerate(times)}
    found = [(g, t, times[at[g] - 1]) for g in cohorts if g in at and at[g] > 0 for t in times]
    rows = P.cell_rows(df, found, y, unit, time, cohort, control, cutoff="later")
    rows = rows.join(exposure(df, edges, unit, cohort), ["cg", "unit"], "left").withColumn("e", F.when(F.col("d") == 1, 0.0).otherwise(F.coalesce("e", F.lit(0.0))))
    mean = rows.where("d = 0").groupBy("cg", "ct").agg(F.avg("e").alias("mean_e"))
    rows = rows.join(F.broadcast(mean), ["cg", "ct"]).withColumn("s", F.when(F.col("mean_e") > 0, F.col("e") / F.col("mean_e")).otherwise(0.0)).withColumn("one", F.lit(1.0))
    rows, by, x = checkpointed(rows), ["cg", "ct"], ["one", "d", "s"]
    xx, xy = _grams(rows, by, (x, x, F.lit(1.0)), (x, ["dy"], F.lit(1.0)))
    inv = {c: np.linalg.pinv(v) for c, v in xx.items()}
    beta = {c: inv[c] @ xy[c][:, 0] for c in xx}
    sizes = {r["g"]: r["n"] for r in df.where(F.col(cohort) > 0).groupBy(F.col(cohort).alias("g")).agg(F.countDistinct(unit).alias("n")).collect()}
    taus = sorted({t - g for g, t in beta})
    share = {}
    for tau in taus:
        own = [c for c in beta if c[1] - c[0] == tau]
        share |= {c: sizes[c[0]] / sum(sizes[o[0]] for o in own) for c in own}
    path = {k: {tau: sum(share[c] * beta[c][i] for c in beta if c[1] - c[0] == tau) for tau in taus} for k, i in (("direct", 1), ("spill", 2))}
    out = Result(df.sparkSession, {}, n_obs=df.count())
    for k, p in path.items():
        base = p.get(-1, 0.0)
        out.params |= {f"{k}_tau_{t}": v - base for t, v in p.items()}
        post = [t for t in taus if t >= 0]
        if post:
            out.params[f"post_{k}"] = float(np.mean([p[t] - base for t in post]))
    if boot:
        lift = {c: [share[c] * v for v in (*inv[c][1], *inv[c][2])] for c in beta}
        rows = _with(rows, by, beta, ["b0", "b1", "b2"]).withColumn("u", F.col("dy") - _dot(x, "b"))
        rows = _with(rows, by, lift, ["l0", "l1", "l2", "m0", "m1", "m2"])
        rows = rows.withColumn("pd", F.col("u") * _dot(x, "l")).withColumn("ps", F.col("u") * _dot(x, "m")).withColumn("tau", F.col("ct") - F.col("cg"))
        names = [(k, t) for k in ("direct", "spill") for t in taus]
        cols = [f"c{i}" for i in range(len(names))]
        key = boot.cluster or ("unit",)
        parts = rows.groupBy(*key).agg(*[F.sum(F.when(F.col("tau") == t, F.col("pd" if k == "direct" else "ps")).otherwise(0.0)).alias(c) for (k, t), c in zip(names, cols)])
        b = B.Boot(boot.n, boot.dist, boot.seed, tuple(key), boot.policy)
        sums = checkpointed(B.draw_sums(parts, cols, b))
        for kind in ("direct", "spill"):
            own = [(c, t) for (k, t), c in zip(names, cols) if k == kind]
            base = next((c for c, t in own if t == -1), None)
            moved = sums.select("b", *[(F.col(c) - F.col(base)).alias(c) if base and c != base else (F.col(c) * (0.0 if c == base else 1.0)).alias(c) for c, _ in own])
            crit, bands = B.sup_t(moved, [c for c, _ in own], {c: out.params[f"{kind}_tau_{t}"] for c, t in own}, level)
            out.diagnostics[f"crit_{kind}"] = crit
            for c, t in own:
                out.se[f"{kind}_tau_{t}"] = bands[c][0]
                out.bands.append((kind, t, out.params[f"{kind}_tau_{t}"], *bands[c]))
    return out
