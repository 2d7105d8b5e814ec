"""Instrumental variables and GMM from the cross-products of instruments, regressors and outcome."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators import boot as B
from plumbline.operators import linear as L
from plumbline.operators.graph import checkpointed
from plumbline.operators.ols import cluster_draws, groups, linear_form, row_draw_sums
from plumbline.operators.result import Result


def moment_covariance(df: DataFrame, z: Sequence[str], u: str, cluster: Sequence[str] = ()) -> np.ndarray:
    """Z'uu'Z: by rows, by clusters, or by several ways (inclusion and exclusion over all subsets of ways)."""
    scored = df.withColumns({f"_m{i}": F.col(c) * F.col(u) for i, c in enumerate(z)})
    cols = [f"_m{i}" for i in range(len(z))]
    if not cluster:
        return L.gram(scored, cols)[0]
    total = np.zeros((len(z), len(z)))
    for size in range(1, len(cluster) + 1):
        for way in combinations(cluster, size):
            total += (-1) ** (size + 1) * L.gram(B.scores(scored, cols, way), cols)[0]
    return total


class IV:
    """Two-stage least squares; parameters in the order endogenous, exogenous, constant."""

    def __init__(self, y: str, endog: Sequence[str], exog: Sequence[str], instruments: Sequence[str], df: DataFrame, boot: B.Boot | None = None, constant: bool = True,
                 weights: str | None = None, key: Sequence[str] | None = None, absorbed: int = 0):
        if weights is not None:
            raise ValueError("weights are not supported here")
        self.y, self.endog, self.exog, self.z, self.df, self.boot, self.constant, self.key = y, list(endog), list(exog), list(instruments), df, boot, constant, key
        self.absorbed = absorbed  # degrees of freedom of effects taken out before

    def prepare(self):
        df = self.df.where(L.finite([self.y, *self.endog, *self.exog, *self.z])).withColumn("_cons", F.lit(1.0))
        exog = [*self.exog, "_cons"] if self.constant else list(self.exog)
        fixed = L.constant_columns(df, [*self.exog, *self.z, *self.endog])  # the constant stands for all columns without variance
        if lost := [c for c in self.endog if c in fixed]:
            raise ValueError(f"endogenous regressors without variance: {', '.join(lost)}")
        if self.constant:
            exog = [c for c in exog if c not in fixed]
        z = [c for c in self.z if c not in fixed and c not in L.duplicate_columns(df, [*exog, *self.z])]
        z = L.screen(df, [*exog, *z])[0]
        z = [c for c in z if c not in exog]
        if len(z) < len(self.endog):
            raise ValueError("fewer instruments than endogenous regressors")
        x, zz = [*self.endog, *exog], [*z, *exog]
        cols = [*dict.fromkeys([*zz, *x, self.y])]
        g, n = L.gram(df, cols)
        at = lambda a, b: g[np.ix_([cols.index(c) for c in a], [cols.index(c) for c in b])]
        return df, x, zz, z, exog, at, n

    def fit(self) -> Result:
        df, x, zz, z, exog, at, n = self.prepare()
        y = [self.y]
        qzz, qzx, qzy = at(zz, zz), at(zz, x), at(zz, y)[:, 0]
        inv = np.linalg.inv(qzz)
        a = qzx.T @ inv @ qzx
        if np.linalg.matrix_rank(a) < len(x):
            raise ValueError("not identified")
        beta = np.linalg.solve(a, qzx.T @ inv @ qzy)
        k = len(x)
        rss = float(at(y, y)[0, 0] - 2 * beta @ at(x, y)[:, 0] + beta @ at(x, x) @ beta)
        zu = qzy - qzx @ beta
        out = Result(df.sparkSession, dict(zip(x, beta)), n_obs=n, diagnostics={"rss": rss})
        if len(zz) > k:
            out.diagnostics["sargan"] = float(zu @ inv @ zu / (rss / (n - k)))
            out.diagnostics["sargan_df"] = len(zz) - k
        for e in self.endog:  # partial F given the other endogenous regressors
            others = [o for o in self.endog if o != e]
            out.diagnostics[f"partial_f_{e}"] = self._partial_f(at, e, others, z, exog, n)
        out.diagnostics["cragg_donald"] = self._min_eigen(at, z, exog, n)
        u = df.withColumn("_u", F.col(self.y) - linear_form(x, beta))
        cluster = self.boot.cluster if self.boot else ()
        adjust = B.ssc_factor(n, k + self.absorbed, groups(df, cluster) if cluster else None)
        out.diagnostics |= self._weak(at, u, z, exog, n, cluster, adjust)
        if self.boot and self.boot.cluster and len(zz) > k:
            s = moment_covariance(u, zz, "_u", self.boot.cluster)
            out.diagnostics["hansen"] = float(zu @ np.linalg.pinv(s) @ zu)
        if self.boot:  # the reduced form is drawn: Z'x* and Z'y* move by weighted scores, Z'Z stays
            pi = inv @ np.column_stack([at(zz, self.endog), qzy])
            res = df.withColumns({f"_e{j}": F.col(c) - linear_form(zz, pi[:, j]) for j, c in enumerate([*self.endog, self.y])})
            m = len(self.endog) + 1
            names = {f"_q{i}_{j}": F.col(c) * F.col(f"_e{j}") for i, c in enumerate(zz) for j in range(m)}
            res, c = res.withColumns(names), 1.0
            if self.boot.cluster:
                c = adjust
                sums = cluster_draws(res, list(names), self.boot)
            else:
                sums = row_draw_sums(res, list(names), self.boot, self.key)
            sums = c * sums.reshape(len(sums), len(zz), m)
            draws = np.empty((len(sums), k))
            for b, d in enumerate(sums):
                zx = qzx.copy()
                zx[:, : m - 1] += d[:, : m - 1]
                h = zx.T @ inv
                draws[b] = np.linalg.solve(h @ zx, h @ (qzy + d[:, -1]))
            out.extra["draws"] = draws
            out.se = dict(zip(x, draws.std(0, ddof=1)))
        out.extra |= {"beta": beta, "columns": x, "instruments": zz, "frame": u}
        return out

    def _partial_f(self, at, e, others, z, exog, n) -> float:
        """F of the excluded instruments in the first stage of ``e``, the other endogenous regressors projected out first."""
        zz = [*z, *exog]
        inv = np.linalg.inv(at(zz, zz))
        base = [*exog]
        if others:  # Sanderson-Windmeijer: e less its projection on the fitted other regressors
            w = [*others, *exog]
            h = at(zz, w)
            d = np.linalg.solve(h.T @ inv @ h, h.T @ inv @ at(zz, [e])[:, 0])
            proj = lambda a: at(a, [e])[:, 0] - at(a, w) @ d
            ee = float(at([e], [e])[0, 0] - 2 * d @ at(w, [e])[:, 0] + d @ at(w, w) @ d)
        else:
            proj = lambda a: at(a, [e])[:, 0]
            ee = float(at([e], [e])[0, 0])
        full = ee - proj(zz) @ inv @ proj(zz)
        small = ee - (proj(base) @ np.linalg.solve(at(base, base), proj(base)) if base else 0.0)
        q = len(z) - len(others)
        return float((small - full) / q / (full / (n - len(zz))))

    def _weak(self, at, u: DataFrame, z, exog, n: int, cluster, adjust: float) -> dict[str, float]:
        """Rank and strength of the excluded instruments under robust or clustered moments: the least eigenvalue of
        Qxx^-1 Qxz' S^+ Qxz and its scalings; with one endogenous regressor also the effective F and the robust first-stage F."""
        s = moment_covariance(u, z, "_u", cluster) * adjust
        v, q = np.linalg.eigh((s + s.T) / 2)
        keep = v > v.max() * 1e-12
        plus = (q[:, keep] / v[keep]) @ q[:, keep].T
        zx, xx = at(z, self.endog), at(self.endog, self.endog)
        m = np.linalg.solve(xx, zx.T @ plus @ zx)
        least = float(np.linalg.eigvalsh((m + m.T) / 2).min())
        out = {"kp_min_eig": least, "kp_rk_lm": n * least, "kp_rk_wald_f": least * (n - len(z)) / len(z)}
        if len(self.endog) == 1:
            rest = (lambda a, b: at(a, b) - at(a, exog) @ np.linalg.solve(at(exog, exog), at(exog, b))) if exog else at
            qzz, qzx = rest(z, z), rest(z, self.endog)[:, 0]
            pi = np.linalg.solve(qzz, qzx)
            d = u
            for i, c in enumerate(z):  # instruments and regressor less what the exogenous ones explain
                d = d.withColumn(f"_z{i}", F.col(c) - (linear_form(exog, np.linalg.solve(at(exog, exog), at(exog, [c]))[:, 0]) if exog else F.lit(0.0)))
            own = linear_form(exog, np.linalg.solve(at(exog, exog), at(exog, self.endog))[:, 0]) if exog else F.lit(0.0)
            names = [f"_z{i}" for i in range(len(z))]
            d = d.withColumn("_e", F.col(self.endog[0]) - own - linear_form(names, pi))
            meat = moment_covariance(d, names, "_e", cluster) * adjust
            inv = np.linalg.inv(qzz)
            sigma = inv @ meat @ inv
            out["mop_effective_f"] = L.effective_f(pi, qzz / n, sigma * n) * n
            out["robust_f"] = float(pi @ np.linalg.solve(sigma, pi)) / len(z)
        return out

    def _min_eigen(self, at, z, exog, n) -> float:
        """The least eigenvalue of the concentration matrix, exogenous regressors partialled out."""
        out = lambda a, b: at(a, b) - (at(a, exog) @ np.linalg.solve(at(exog, exog), at(exog, b)) if exog else 0.0)
        xx, zx, zz = out(self.endog, self.endog), out(z, self.endog), out(z, z)
        fitted = zx.T @ np.linalg.solve(zz, zx)
        v, q = np.linalg.eigh((xx - fitted) / (n - len(z) - len(exog)))
        root = (q / np.sqrt(v)) @ q.T
        return float(np.linalg.eigvalsh(root @ fitted @ root / len(z)).min())


class GMM(IV):
    """Linear GMM: ``weight`` is identity, 2sls, two-step or a matrix over the instruments (those excluded, then the exogenous ones).

    ``obs_weight`` names a column of weights of the observations' moments.  Moments may be clustered several ways.  With
    two steps the weight matrix is estimated anew in every draw (``reestimate``), from the clusters' or rows' moments.
    """

    def __init__(self, *a, weight="identity", obs_weight: str | None = None, reestimate: bool = True, **kw):
        super().__init__(*a, **kw)
        self.weight, self.obs_weight, self.reestimate = weight, obs_weight, reestimate

    def fit(self) -> Result:
        if self.obs_weight:  # every product carries the weight once: rows are scaled by its root
            self.df = self.df.where(L.finite([self.obs_weight]) & (F.col(self.obs_weight) > 0))
        df, x, zz, z, exog, at, n = self.prepare()
        moment = "_u"
        if self.obs_weight:
            cols = [*dict.fromkeys([*zz, *x, self.y])]
            g, _ = L.gram(df, cols, self.obs_weight)
            at = lambda a, b: g[np.ix_([cols.index(c) for c in a], [cols.index(c) for c in b])]
        qzz, qzx, qzy = at(zz, zz), at(zz, x), at(zz, [self.y])[:, 0]
        cluster = self.boot.cluster if self.boot else ()
        two_step = isinstance(self.weight, str) and self.weight in ("two-step", "twostep", "2step")

        def residual(b):
            u = F.col(self.y) - linear_form(x, b)
            return df.withColumn(moment, u * F.col(self.obs_weight) if self.obs_weight else u)

        def step(w, rhs=qzy):
            return np.linalg.solve(qzx.T @ w @ qzx, qzx.T @ w @ rhs)

        def inverse(s):  # truncated: directions without variance get no weight
            v, q = np.linalg.eigh((s + s.T) / 2)
            keep = v > v.max() * 1e-12
            return (q[:, keep] / v[keep]) @ q[:, keep].T

        if not isinstance(self.weight, str):
            w = np.asarray(self.weight, float)
            if w.shape != (len(zz), len(zz)):
                raise ValueError(f"the weight matrix must be {len(zz)} x {len(zz)}, over {', '.join(zz)}")
        else:
            w = np.eye(len(zz)) if self.weight == "identity" else np.linalg.inv(qzz)
        first, beta = w, step(w)
        out = Result(df.sparkSession, {}, n_obs=n)
        if two_step:
            w = inverse(moment_covariance(residual(beta), zz, moment, cluster) / n)
            beta = step(w)
            gbar = (qzy - qzx @ beta) / n
            if len(zz) > len(x):
                out.diagnostics["j"] = float(n * gbar @ w @ gbar)
                out.diagnostics["j_df"] = len(zz) - len(x)
        out.params = dict(zip(x, beta))
        u = residual(beta)
        if self.boot:
            scored = u.withColumns({f"_m{i}": F.col(c) * F.col(moment) for i, c in enumerate(zz)})
            cols = [f"_m{i}" for i in range(len(zz))]
            c = B.ssc_factor(n, len(x) + self.absorbed, groups(df, cluster) if cluster else None)
            sums = cluster_draws(scored, cols, self.boot) if cluster else row_draw_sums(scored, cols, self.boot, self.key)
            if two_step and self.reestimate and len(cluster) == 1:
                draws = self._two_steps(scored, cols, x, zz, c * sums, c, first, step, inverse, n, qzx, cluster[0])
            else:
                draws = c * sums @ np.linalg.solve(qzx.T @ w @ qzx, qzx.T @ w).T
            out.extra["draws"] = draws
            out.se = dict(zip(x, draws.std(0, ddof=1)))
        out.extra |= {"beta": beta, "columns": x, "instruments": zz, "frame": u}
        return out

    def _two_steps(self, scored: DataFrame, cols, x, zz, moved, c, first, step, inverse, n, qzx, cluster) -> np.ndarray:
        """Deviations of both steps per draw.  A draw's outcome is fit + w_g u, so its first-step deviation is d = step(first, moved);
        a cluster's moments are then w_g s_g - G_g d (s_g: the cluster's moments, G_g: its Z'X), quadratic in (w_g s_g, d), and w_g^2 = 1
        for signs: the weight matrix needs sums over clusters of s s', of w s (x) G and of G (x) G, the middle ones drawn like the scores."""
        if self.boot.dist != "rademacher":
            raise ValueError("weights are estimated anew with signs (rademacher) only")
        k, m = len(x), len(zz)
        weight = F.col(self.obs_weight) if self.obs_weight else F.lit(1.0)
        scored = scored.withColumns({f"_g{i}_{j}": F.col(a) * F.col(b) * weight for i, a in enumerate(zz) for j, b in enumerate(x)})
        gs = [f"_g{i}_{j}" for i in range(m) for j in range(k)]
        parts = checkpointed(B.scores(scored, [*cols, *gs], (cluster,)))
        every = L.gram(parts, [*cols, *gs])[0]
        ss, gg = every[:m, :m], every[m:, m:].reshape(m, k, m, k)
        cross = [f"_sg{i}_{j}" for i in range(m) for j in range(m * k)]
        crossed = parts.withColumns({f"_sg{i}_{j}": F.col(cols[i]) * F.col(gs[j]) for i in range(m) for j in range(m * k)})
        rows = sorted(B.draw_sums(crossed, cross, self.boot).collect(), key=lambda r: r.b)
        sg = np.array([[r[a] for a in cross] for r in rows]).reshape(len(rows), m, m, k)
        out = np.empty((len(rows), k))
        for b, shift in enumerate(moved):
            d = step(first, shift) / c  # the correction scales deviations, not the draw's own residuals
            mid = sg[b] @ d
            s = ss - mid - mid.T + np.einsum("ikjl,k,l->ij", gg, d, d)
            w = inverse(s / n)
            out[b] = np.linalg.solve(qzx.T @ w @ qzx, qzx.T @ w @ shift)
        return out


def anderson_rubin(df: DataFrame, y: str, x: str, exog: Sequence[str], z: Sequence[str], value: float, boot: B.Boot, alpha: float = 0.05) -> tuple[float, float, bool]:
    """(statistic, critical value, reject) for beta_x = value: do the instruments explain y - value * x?"""
    d = df.where(L.finite([y, x, *exog, *z])).withColumn("_cons", F.lit(1.0)).withColumn("_r", F.col(y) - F.lit(value) * F.col(x))
    base, full = [*exog, "_cons"], [*z, *exog, "_cons"]
    g, n = L.gram(d, [*full, "_r"])
    m = len(z)
    b = L.solve(g[m:-1, m:-1], g[m:-1, -1])
    scored = d.withColumn("_u", F.col("_r") - linear_form(base, b))
    scored = scored.withColumns({f"_m{i}": F.col(c) * F.col("_u") for i, c in enumerate(full)})
    sums = cluster_draws(scored, [f"_m{i}" for i in range(len(full))], boot)
    inv = np.linalg.inv(g[:-1, :-1])
    pi = (inv @ g[:-1, -1])[:m]
    draws = (sums @ inv.T)[:, :m]
    cov = np.cov(draws.T).reshape(m, m)
    w = np.linalg.pinv(cov)
    crit = B.bplus1_quantile(np.einsum("bi,ij,bj->b", draws, w, draws), alpha)
    stat = float(pi @ w @ pi)
    return stat, crit, stat > crit
