"""Randomised trials: regression adjustment and Hajek weighting for ATE, ATT and ATC, by contrast and stratum."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators import boot as B
from plumbline.operators.did import _dot, _grams, _with, logit
from plumbline.operators.graph import checkpointed
from plumbline.operators.ols import row_draw_sums
from plumbline.operators.result import Result

TARGETS = ("ATE", "ATT", "ATC")


def overlapping(df: DataFrame, arm: str, stratum: str, one, zero) -> DataFrame:
    """Rows of strata that hold both arms."""
    has = df.groupBy(stratum).agg(F.max((F.col(arm) == F.lit(one)).cast("int")).alias("a"), F.max((F.col(arm) == F.lit(zero)).cast("int")).alias("b"))
    return df.join(has.where("a = 1 AND b = 1").select(stratum), stratum, "left_semi")


def strata_dummies(df: DataFrame, stratum: str, order: str) -> tuple[DataFrame, list[str]]:
    """A 0/1 column for each stratum but the first; strata are numbered by the least ``order`` among their rows."""
    first = df.groupBy(stratum).agg(F.min(order).alias("_first")).orderBy("_first", stratum).collect()  # strata: few by nature
    names = {f"{stratum}_{i}": r[0] for i, r in enumerate(first) if i}
    return df.withColumns({n: F.col(stratum).eqNullSafe(F.lit(v)).cast("double") for n, v in names.items()}), list(names)


class RCT:
    """``trimming``: probabilities beyond [trim, 1 - trim] are clipped, or their rows dropped.

    Draws are clustered by ``boot.cluster``, else by strata, else every key is drawn for itself.
    """

    def __init__(self, df: DataFrame, y: str, arm: str, covariates: Sequence[str] = (), stratum: str | None = None, contrasts: Sequence[tuple] = ((1, 0),), p: float | str | None = None,
                 trim: float = 0.01, boot: B.Boot | None = None, level: float = 0.95, key: str = "id", trimming: str = "clip"):
        if trimming not in ("clip", "drop"):
            raise ValueError("trimming is clip or drop")
        self.__dict__.update({k: v for k, v in locals().items() if k != "self"})

    def fit(self) -> Result:
        """Parameters are named RA_ATE__1_vs_0 and so on, with _S<k> for the k-th stratum; the band covers all of them."""
        out = Result(self.df.sparkSession, {}, n_obs=self.df.count())
        strata = [None] + ([r[0] for r in self.df.select(self.stratum).distinct().orderBy(self.stratum).collect()] if self.stratum else [])
        sums = []
        for one, zero in self.contrasts:
            for k, s in enumerate(strata):
                d = self.df.where(F.col(self.arm).isin([one, zero]))
                if s is not None:
                    d = d.where(F.col(self.stratum) == F.lit(s))
                elif self.stratum:
                    d = overlapping(d, self.arm, self.stratum, one, zero)
                est, rows = self._contrast(d.withColumn("d", (F.col(self.arm) == F.lit(one)).cast("double")))
                label = f"__{one}_vs_{zero}" + (f"_S{k}" if k else "")
                out.params |= {f + label: v for f, v in est.items()}
                sums.append(rows.select("_key", *[F.col(f"psi_{f}").alias(f + label) for f in est]))
        if self.boot:
            names = list(out.params)
            stacked = None
            for part in sums:
                have = [F.col(f"`{n}`") if n in part.columns else F.lit(0.0).alias(n) for n in names]
                part = part.select("_key", *have)
                stacked = part if stacked is None else stacked.unionByName(part)
            safe = [f"c{i}" for i in range(len(names))]
            terms = stacked.select("_key", *[F.col(f"`{n}`").alias(c) for n, c in zip(names, safe)])
            if self.boot.cluster or self.stratum:
                boot = B.Boot(self.boot.n, self.boot.dist, self.boot.seed, ("_key",), self.boot.policy)
                draws = checkpointed(B.draw_sums(terms.groupBy("_key").agg(*[F.sum(c).alias(c) for c in safe]), safe, boot))
            else:  # a multiplier a row: tasks multiply, draws leave them
                sums = row_draw_sums(terms, safe, self.boot, ["_key"])
                draws = self.df.sparkSession.createDataFrame([(b, *map(float, row)) for b, row in enumerate(sums)], ", ".join(["b int", *(f"{c} double" for c in safe)]))
            crit, bands = B.sup_t(draws, safe, dict(zip(safe, out.params.values())), self.level)
            out.diagnostics["crit"] = crit
            for n, c in zip(names, safe):
                out.se[n] = bands[c][0]
                out.bands.append(("uniform", 0, out.params[n], *bands[c]))
            out.extra["band_names"] = names
        return out

    def _contrast(self, rows: DataFrame) -> tuple[dict[str, float], DataFrame]:
        """Estimates and influence terms (per row, scaled so that draws add up to deviations)."""
        by = ["_all"]
        key = F.col(self.boot.cluster[0]) if self.boot and self.boot.cluster else F.col(self.stratum or self.key)  # the user's clusters go before strata
        rows = rows.withColumn("_all", F.lit(0)).withColumn("_1", F.lit(1.0)).withColumn("_key", key.cast("string"))
        cov = [*[f"_c{i}" for i in range(len(self.covariates))], "_1"]
        rows = rows.withColumns({f"_c{i}": F.col(c).cast("double") for i, c in enumerate(self.covariates)}).withColumn("_y", F.col(self.y).cast("double"))
        inv = {}
        for name, w in (("1", F.col("d")), ("0", 1 - F.col("d"))):
            xx, xy = (m[0,] for m in _grams(rows, by, (cov, cov, w), (cov, ["_y"], w)))
            inv[name] = np.linalg.pinv(xx)
            rows = _with(rows, by, {(0,): inv[name] @ xy[:, 0]}, [f"_b{name}_{i}" for i in range(len(cov))]).withColumn(f"_m{name}", _dot(cov, f"_b{name}_"))
        if self.p is None and self.covariates:
            g, _ = logit(rows, by, "d", cov)
            rows = _with(rows, by, g, [f"_g{i}" for i in range(len(cov))]).withColumn("_p", 1 / (1 + F.exp(-_dot(cov, "_g"))))
        elif self.p is None:
            share = rows.agg(F.avg("d")).first()[0]
            rows = rows.withColumn("_p", F.lit(share))
        else:
            rows = rows.withColumn("_p", F.lit(self.p) if not isinstance(self.p, str) else F.col(self.p))
        if self.trimming == "drop":
            rows = rows.where(F.col("_p").between(self.trim, 1 - self.trim))
        rows = rows.withColumn("_p", F.least(F.lit(1 - self.trim), F.greatest(F.lit(self.trim), F.col("_p"))))
        target = {"ATE": F.lit(1.0), "ATT": F.col("d"), "ATC": 1 - F.col("d")}
        w1 = {"ATE": F.col("d") / F.col("_p"), "ATT": F.col("d"), "ATC": F.col("d") * (1 - F.col("_p")) / F.col("_p")}
        w0 = {"ATE": (1 - F.col("d")) / (1 - F.col("_p")), "ATT": (1 - F.col("d")) * F.col("_p") / (1 - F.col("_p")), "ATC": 1 - F.col("d")}
        gap = F.col("_m1") - F.col("_m0")
        aggs = []
        for t in TARGETS:
            aggs += [F.sum(target[t]).alias(f"n_{t}"), F.sum(target[t] * gap).alias(f"g_{t}")]
            aggs += [F.sum(w1[t]).alias(f"w1_{t}"), F.sum(w1[t] * F.col("_y")).alias(f"y1_{t}"), F.sum(w0[t]).alias(f"w0_{t}"), F.sum(w0[t] * F.col("_y")).alias(f"y0_{t}")]
            aggs += [F.sum(target[t] * F.col(c)).alias(f"x_{t}_{i}") for i, c in enumerate(cov)]
        r = rows.agg(*aggs).first()
        if not all(r[f"w{a}_{t}"] for a in (0, 1) for t in TARGETS):
            raise ValueError("an arm has no rows left")
        est, psi = {}, {}
        for t in TARGETS:
            n = r[f"n_{t}"]
            est[f"RA_{t}"] = r[f"g_{t}"] / n
            mean = np.array([r[f"x_{t}_{i}"] for i in range(len(cov))]) / n
            l1, l0 = inv["1"] @ mean, inv["0"] @ mean
            fit = F.col("d") * (F.col("_y") - F.col("_m1")) * _lin(cov, l1) - (1 - F.col("d")) * (F.col("_y") - F.col("_m0")) * _lin(cov, l0)
            psi[f"RA_{t}"] = target[t] * (gap - F.lit(est[f"RA_{t}"])) / F.lit(n) + fit
            m1, m0 = r[f"y1_{t}"] / r[f"w1_{t}"], r[f"y0_{t}"] / r[f"w0_{t}"]
            est[f"IPW_{t}"] = m1 - m0
            psi[f"IPW_{t}"] = w1[t] * (F.col("_y") - F.lit(m1)) / F.lit(r[f"w1_{t}"]) - w0[t] * (F.col("_y") - F.lit(m0)) / F.lit(r[f"w0_{t}"])
        return est, rows.withColumns({f"psi_{k}": v for k, v in psi.items()})


def _lin(cov, beta):
    out = F.lit(0.0)
    for c, b in zip(cov, beta):
        out = out + F.col(c) * F.lit(float(b))
    return out


def balance(df: DataFrame, arm: str, covariates: Sequence[str], weight: str | None = None) -> DataFrame:
    """(covariate, mean1, mean0, smd): difference over the root of the mean of the arms' variances."""
    w = F.col(weight) if weight else F.lit(1.0)
    out = None
    for c in covariates:
        x, d = F.col(c).cast("double"), F.col(arm).cast("double")
        m = lambda s: F.sum(w * s * x) / F.sum(w * s)
        v = lambda s: F.sum(w * s * x * x) / F.sum(w * s) - m(s) * m(s)
        row = df.agg(m(d).alias("mean1"), m(1 - d).alias("mean0"), v(d).alias("v1"), v(1 - d).alias("v0"))
        row = row.select(F.lit(c).alias("covariate"), "mean1", "mean0", ((F.col("mean1") - F.col("mean0")) / F.sqrt((F.col("v1") + F.col("v0")) / 2)).alias("smd"))
        out = row if out is None else out.unionByName(row)
    return out
