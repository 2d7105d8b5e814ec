"""Synthetic control and synthetic differences in differences.  Each treated unit or cohort is one task's matrix."""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators import panel as P
from plumbline.operators.graph import checkpointed
from plumbline.operators.result import Result


#: Treated units or cohorts, counted, that each get a copy of the never-treated units.
MOST_TASKS = 1_000


def simplex_weights(a: np.ndarray, b: np.ndarray, ridge: float = 0.0, intercept: bool = False, start: np.ndarray | None = None, rounds: int = 10_000, tol: float = 1e-10) -> np.ndarray:
    """argmin over the simplex of |a w - b|^2 / rows + ridge |w|^2, by Frank-Wolfe with exact steps."""
    if intercept:
        a, b = a - a.mean(0), b - b.mean()
    n, k = a.shape
    w = np.full(k, 1.0 / k) if start is None else start.copy()
    fit = a @ w
    before = np.inf
    for i in range(rounds):
        r = fit - b
        g = a.T @ r / n + ridge * w
        j = int(g.argmin())
        d = -w.copy()
        d[j] += 1
        if (gap := -float(g @ d)) <= tol and not intercept:
            break
        ad = a @ d
        curve = float(ad @ ad / n + ridge * d @ d)
        step = 1.0 if curve <= 0 else min(1.0, gap / curve)
        w, fit = w + step * d, fit + step * ad
        value = float(((fit - b) ** 2).sum() / n + ridge * w @ w)
        if intercept and before - value < tol:
            break
        before = value
    return w


def softmax(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(weights that add up to one, their Jacobian): diag(v) - v v'."""
    e = np.exp(z - z.max())
    v = e / e.sum()
    return v, np.diag(v) - np.outer(v, v)


def predictor_weights(x1: np.ndarray, x0: np.ndarray, z1: np.ndarray, z0: np.ndarray, rounds: int = 60, step: float = 0.5) -> tuple[np.ndarray, np.ndarray]:
    """(v, w): predictor weights v on the simplex whose donor weights w = argmin |x1 - x0 w|_v fit the outcomes z1 ~ z0 w best.

    Descends on the logits of v; the inner problem's slope is by differences, through the softmax Jacobian.
    """
    k = len(x1)
    scale = np.where((s := np.column_stack([x0, x1]).std(1)) > 0, s, 1.0)
    x1, x0 = x1 / scale, x0 / scale[:, None]
    inner = lambda v: simplex_weights(np.sqrt(v)[:, None] * x0, np.sqrt(v) * x1, rounds=2000)
    loss = lambda w: float(((z1 - z0 @ w) ** 2).mean())
    logits = np.zeros(k)
    v, jacobian = softmax(logits)
    w = inner(v)
    best = loss(w)
    for _ in range(rounds):
        slope = np.array([(loss(inner(np.maximum(v + 1e-4 * np.eye(k)[i], 0) / (1 + 1e-4))) - best) / 1e-4 for i in range(k)])
        move = jacobian @ slope
        if np.abs(move).max() < 1e-12:
            break
        trial = logits - step * move / np.abs(move).max()
        tv, tj = softmax(trial)
        tw = inner(tv)
        if (value := loss(tw)) < best - 1e-12:
            logits, v, jacobian, w, best = trial, tv, tj, tw, value
        else:
            step /= 2
            if step < 1e-3:
                break
    return v, w


def _wide(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, list]:
    m = pdf.pivot(index="unit", columns="t", values="y").sort_index()
    if m.isna().any().any():
        raise ValueError("the panel is not balanced")
    treated = pdf.groupby("unit")["treated"].max().reindex(m.index).to_numpy(bool)
    return m.to_numpy(float), treated, list(m.columns)


def _tasks(df: DataFrame, y: str, unit: str, time: str, cohort: str, per_unit: bool) -> DataFrame:
    """Rows (task, start, unit, t, y, treated): each treated unit or cohort with the never-treated."""
    rows = df.select(F.col(unit).alias("unit"), F.col(time).cast("long").alias("t"), F.col(y).cast("double").alias("y"), F.col(cohort).cast("long").alias("g"))
    own = rows.where("g > 0").select((F.col("unit") if per_unit else F.col("g")).cast("string").alias("task"), F.col("g").alias("start"), "unit", "t", "y", F.lit(True).alias("treated"))
    tasks = checkpointed(own.select("task", "start").distinct())
    if (n := tasks.count()) > MOST_TASKS:
        raise ValueError(f"{n} treated units or cohorts: {MOST_TASKS} at most share the donors")
    return own.unionByName(rows.where("g = 0").crossJoin(F.broadcast(tasks)).select("task", "start", "unit", "t", "y", F.lit(False).alias("treated")))


def synthetic_control(df: DataFrame, y: str = "y", unit: str = "id", time: str = "t", cohort: str = "g", placebo: bool = False) -> DataFrame:
    """(task, t, tau, gap, effect): each treated unit against its best mix of never-treated units.

    ``gap`` is outcome less synthetic outcome, ``effect`` the gap less its mean before treatment, less its value at tau = -1
    (so the path starts from zero there).  ``placebo`` treats each donor in turn as if it were treated.
    """
    P.check_unique(df, unit, time)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        m, treated, times = _wide(pdf)
        start = int(pdf["start"].iloc[0])
        pre = np.array([t < start for t in times])
        target, donors = m[treated].mean(0), m[~treated]
        out = [(pdf["task"].iloc[0], target, donors)]
        if placebo:
            out = [(f"{pdf['task'].iloc[0]}/{i}", donors[i], np.delete(donors, i, 0)) for i in range(len(donors))]
        rows = []
        for task, b, a in out:
            alone = ((a[:, pre] - b[pre]) ** 2).sum(1)
            first = np.zeros(len(a))
            first[int(alone.argmin())] = 1.0
            w = simplex_weights(a[:, pre].T, b[pre], start=first)
            gap = b - w @ a
            effect = gap - gap[pre].mean()
            effect = effect - effect[np.flatnonzero(pre)[-1]]
            rows += [(task, int(t), int(t - start), float(x), float(e)) for t, x, e in zip(times, gap, effect)]
        return pd.DataFrame(rows, columns=["task", "t", "tau", "gap", "effect"])

    return _tasks(df, y, unit, time, cohort, True).groupBy("task").applyInPandas(one, "task string, t long, tau long, gap double, effect double")


def sdid_weights(m: np.ndarray, treated: np.ndarray, pre: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(unit weights, time weights), sparsified once and solved again."""
    c, n1, t1 = m[~treated], int(treated.sum()), int((~pre).sum())
    noise = float(np.diff(c[:, pre], axis=1).std(ddof=1)) if pre.sum() > 1 else 1.0
    zeta, small = (n1 * t1) ** 0.25 * noise, 1e-6 * noise
    tol = (1e-5 * noise) ** 2

    def twice(a, b, ridge):
        w = simplex_weights(a, b, ridge, True, rounds=100, tol=tol)
        w = np.where(w <= w.max() / 4, 0.0, w)
        return simplex_weights(a, b, ridge, True, w / w.sum(), rounds=2000, tol=tol)

    omega = twice(c[:, pre].T, m[treated][:, pre].mean(0), zeta**2)
    lam = twice(c[:, pre], c[:, ~pre].mean(1), small**2)
    return omega, lam


def sdid(df: DataFrame, y: str = "y", unit: str = "id", time: str = "t", cohort: str = "g") -> Result:
    """Per cohort att and event path, cohorts weighted by treated unit-periods; placebo draws if one unit is treated."""
    P.check_unique(df, unit, time)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        m, treated, times = _wide(pdf)
        start = int(pdf["start"].iloc[0])
        pre = np.array([t < start for t in times])

        def path(mm, tr):
            omega, lam = sdid_weights(mm, tr, pre)
            gap = mm[tr].mean(0) - omega @ mm[~tr]
            return gap - lam @ gap[pre]

        main = path(m, treated)
        rows = [("main", int(t), int(t - start), float(v), int(treated.sum())) for t, v in zip(times, main)]
        if treated.sum() == 1:
            donors = m[~treated]
            for i in range(len(donors)):
                tr = np.zeros(len(donors), bool)
                tr[i] = True
                rows += [(f"placebo{i}", int(t), int(t - start), float(v), 1) for t, v in zip(times, path(donors, tr))]
        return pd.DataFrame([(start, *r) for r in rows], columns=["g", "kind", "t", "tau", "value", "n"])

    found = _tasks(df, y, unit, time, cohort, False).groupBy("task").applyInPandas(one, "g long, kind string, t long, tau long, value double, n long")
    rows = found.collect()  # cohorts x periods rows (and placebos where one unit is treated)
    main = [r for r in rows if r.kind == "main"]
    post = [r for r in main if r.tau >= 0]
    total = sum(r.n for r in post)
    att = sum(r.value * r.n for r in post) / total
    out = Result(df.sparkSession, {"att": att}, n_obs=df.count())
    for tau in sorted({r.tau for r in main}):
        own = [r for r in main if r.tau == tau]
        base = [next((s.value for s in main if s.g == r.g and s.tau == -1), 0.0) for r in own]
        out.params[f"tau_{tau}"] = sum((r.value - b) * r.n for r, b in zip(own, base)) / sum(r.n for r in own)
    kinds = sorted({r.kind for r in rows} - {"main"})
    if kinds:
        draws = [np.mean([r.value for r in rows if r.kind == k and r.tau >= 0]) for k in kinds]
        out.se["att"] = float(np.std(draws, ddof=1))
    out.extra["paths"] = found.where("kind = 'main'")
    return out


