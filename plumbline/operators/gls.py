"""Generalised least squares: weights, AR(1) and panel-specific AR(1) errors, exchangeable errors.

The AR(1) transform enters the cross-products as a polynomial in rho, so one pass gives the products and rho is
iterated, and estimated anew in every draw, without touching the rows again.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.operators import boot as B
from plumbline.operators import linear as L
from plumbline.operators import panel as P
from plumbline.operators.graph import checkpointed
from plumbline.operators.ols import cluster_draws, groups, linear_form
from plumbline.operators.result import Result


def wls(df: DataFrame, y: str, x: Sequence[str], weight: str, boot: B.Boot | None = None) -> Result:
    df = df.where(L.finite([y, *x, weight]) & (F.col(weight) > 0)).withColumn("_cons", F.lit(1.0))
    cols = [*x, "_cons"]
    g, n = L.gram(df, [*cols, y], weight)
    beta, inv = L.solve(g[:-1, :-1], g[:-1, -1]), np.linalg.inv(g[:-1, :-1])
    out = Result(df.sparkSession, dict(zip(cols, beta)), n_obs=n)
    if boot:
        u = (F.col(y) - linear_form(cols, beta)) * F.col(weight)
        scored = df.withColumns({f"_s{i}": F.col(c) * u for i, c in enumerate(cols)})
        draws = B.ssc_factor(n, len(cols), groups(df, boot.cluster)) * cluster_draws(scored, [f"_s{i}" for i in range(len(cols))], boot) @ inv
        out.se = dict(zip(cols, draws.std(0, ddof=1)))
    return out


def full(df: DataFrame, y: str, x: Sequence[str], pairs: DataFrame, key: str) -> Result:
    """Least squares under a full precision matrix, given by its non-zero entries (a, b, w) over the rows' ``key``."""
    df = df.where(L.finite([y, *x])).withColumn("_cons", F.lit(1.0))
    cols = [*x, "_cons"]
    g = L.gram_pairs(df, [*cols, y], pairs, key)
    beta = np.linalg.solve((g + g.T)[:-1, :-1] / 2, (g[:-1, -1] + g[-1, :-1]) / 2)
    return Result(df.sparkSession, dict(zip(cols, beta)), n_obs=df.count())


def _lag_sums(df: DataFrame, cols: Sequence[str], unit: str, time: str, head: str, by: Sequence[str] = ()) -> DataFrame:
    """One aggregate of all products that AR(1) needs, for each pair of columns: a, b, c (the transformed cross-products are
    a - rho b + rho^2 c), d (of steps within runs), e (of rows) and f (of rows that another follows).

    Lags count within runs of consecutive periods; a run's first row is scaled (``prais``) or left out (``corc``).
    """
    w = Window.partitionBy(unit, "segment").orderBy(time)
    d = P.segments(df, unit, time).withColumns({f"_p_{i}": F.lag(c).over(w) for i, c in enumerate(cols)}).withColumn("_in", F.lag(F.lit(1)).over(w))
    inside, first = F.col("_in").isNotNull(), F.col("_in").isNull()
    k, sums = len(cols), [F.count(F.lit(1)).alias("n"), F.sum(inside.cast("int")).alias("inside")]
    c = [F.col(x).cast("double") for x in cols]
    p = [F.col(f"_p_{i}").cast("double") for i in range(k)]
    keep = F.lit(1.0 if head == "prais" else 0.0)
    within = lambda x: F.when(inside, x).otherwise(0.0)
    for i in range(k):
        for j in range(i, k):
            own = c[i] * c[j]
            each = {"a": F.when(inside, own).otherwise(keep * own), "b": within(c[i] * p[j] + p[i] * c[j]), "c": F.when(inside, p[i] * p[j]).when(first, -keep * own),
                    "d": within((c[i] - p[i]) * (c[j] - p[j])), "e": own, "f": within(p[i] * p[j])}
            sums += [F.sum(v).alias(f"{m}{i}_{j}") for m, v in each.items()]
    return d.groupBy(*by).agg(*sums) if by else d.agg(*sums)


def _squares(row, k: int) -> dict[str, np.ndarray]:
    return {m: np.array([[row[f"{m}{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)]) for m in "abcdef"}


def _rho(form, method: str) -> float:
    """1 - DW / 2, or the regression of a residual on its lag, from ``form(name)``: the residual's quadratic form."""
    rho = 1 - form("d") / form("e") / 2 if method == "dw" else form("b") / 2 / form("f")
    return float(np.clip(rho, -0.999999, 0.999999))


def _path(s: dict[str, np.ndarray], rho_method: str, iterate: bool, tol: float, rounds: int) -> tuple[np.ndarray, float, int]:
    """(beta, rho, steps) from the products of regressors and, last, the outcome."""
    beta, rho = L.solve(s["e"][:-1, :-1], s["e"][:-1, -1]), 0.0
    for step in range(rounds):
        v = np.append(-beta, 1.0)
        before, rho = rho, _rho(lambda m: float(v @ s[m] @ v), rho_method)  # noqa: B023
        g = s["a"] - rho * s["b"] + rho * rho * s["c"]
        beta = L.solve(g[:-1, :-1], g[:-1, -1])
        if not iterate or abs(rho - before) < tol:
            break
    return beta, rho, step + 1


def ar1(df: DataFrame, y: str, x: Sequence[str], unit: str, time: str, rho_method: str = "dw", head: str = "prais", iterate: bool = True, tol: float = 1e-3, rounds: int = 100,
        boot: B.Boot | None = None) -> Result:
    """Prais-Winsten or Cochrane-Orcutt with a common rho, from one pass over the rows.

    Draws turn each cluster's residuals over by a sign (clusters default to the units, whose lags they must hold whole) and
    estimate rho anew: only products of regressors and residual change their sign, so clusters' sums give every draw's.
    """
    df = df.where(L.finite([y, *x])).withColumn("_cons", F.lit(1.0))
    cols = [*x, "_cons"]
    k = len(cols)
    row = _lag_sums(df, [*cols, y], unit, time, head).first()
    beta, rho, steps = _path(_squares(row, k + 1), rho_method, iterate, tol, rounds)
    n = row.n if head == "prais" else row.inside
    out = Result(df.sparkSession, dict(zip(cols, beta)), n_obs=n, diagnostics={"rho": rho, "iterations": steps})
    if boot:
        if boot.dist != "rademacher":
            raise ValueError("draws of autoregressive errors need signs (rademacher)")
        boot = boot if boot.cluster else B.Boot(boot.n, boot.dist, boot.seed, (unit,), boot.policy, boot.ssc, boot.enumerate)
        parts = checkpointed(_lag_sums(df.withColumn("_u", F.col(y) - linear_form(cols, beta)), [*cols, "_u"], unit, time, head, boot.cluster))
        whole = parts.agg(*[F.sum(c).alias(c) for c in parts.columns if c not in boot.cluster]).first()
        signed = [f"{m}{i}_{k}" for m in "abcdef" for i in range(k)]
        draws = []
        for r in sorted(B.draw_sums(parts, signed, boot).collect(), key=lambda r: r.b):  # one row a draw
            s = _squares(whole, k + 1)
            for m in "abcdef":
                for i in range(k):
                    s[m][i, k] = s[m][k, i] = r[f"{m}{i}_{k}"]
            draws.append(_path(s, rho_method, iterate, tol, rounds)[0])  # deviations: the outcome is the turned residual
        c = B.ssc_factor(n, k, groups(df, boot.cluster), boot.ssc.get("adj", True), boot.ssc.get("cluster.adj", True))
        out.extra["draws"] = c * np.array(draws)
        out.se = dict(zip(cols, out.extra["draws"].std(0, ddof=1)))
    return out


def _over_clusters(parts: DataFrame, cols: Sequence[str], draws: int, width: int, term) -> np.ndarray:
    """draws x width sums over the rows of ``parts`` of term(row's numbers, its multipliers): tasks add up, draws x width leave them."""

    def run(batches):
        out = np.zeros((draws, width))
        for b in batches:
            numbers = np.column_stack([np.asarray(c, np.float64) for c in b.columns[:-1]])
            for i in range(b.num_rows):
                out += term(numbers[i], np.asarray(b.column(len(cols))[i].values, np.float64))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(out.size)), pa.array(out.ravel())], ["pos", "v"])

    flat = np.zeros(draws * width)
    rows = parts.select(*[F.col(c).cast("double") for c in cols], "_w").mapInArrow(run, "pos long, v double")
    for r in rows.groupBy("pos").agg(F.sum("v").alias("v")).collect():
        flat[r.pos] = r.v
    return flat.reshape(draws, width)


def _systems(sums: np.ndarray, k: int) -> np.ndarray:
    """Solutions of the k x k systems in each row: the matrix, then the right-hand side."""
    return np.array([np.linalg.solve(r[: k * k].reshape(k, k), r[k * k :]) for r in sums])


def _signs(boot: B.Boot, unit: str) -> B.Boot:
    if boot.dist != "rademacher" or len(boot.cluster) > 1 or boot.cluster and boot.cluster[0] != unit:
        raise ValueError(f"draws of these errors turn each {unit} by a sign (rademacher)")
    return B.Boot(boot.n, boot.dist, boot.seed, (unit,), boot.policy, boot.ssc, boot.enumerate)


def psar1(df: DataFrame, y: str, x: Sequence[str], unit: str, time: str, rho_method: str = "dw", boot: B.Boot | None = None) -> Result:
    """Prais-Winsten with a rho per unit (two steps); every lag is of the untransformed row.

    Draws turn each unit's residuals by a sign and estimate its rho anew, from the unit's products.
    """
    df = df.where(L.finite([y, *x])).withColumn("_cons", F.lit(1.0))
    cols = [*x, "_cons"]
    g, _ = L.gram(df, [*cols, y])
    beta = L.solve(g[:-1, :-1], g[:-1, -1])
    w = Window.partitionBy(unit, "segment").orderBy(time)
    d = P.segments(df.withColumn("_u", F.col(y) - linear_form(cols, beta)), unit, time).withColumn("_p", F.lag("_u").over(w))
    u, p = F.col("_u"), F.col("_p")
    rho = 1 - F.sum((u - p) * (u - p)) / F.sum(u * u) / 2 if rho_method == "dw" else F.sum(u * p) / F.sum(F.when(p.isNotNull(), p * p))
    rhos = d.groupBy(unit).agg(F.least(F.lit(0.999999), F.greatest(F.lit(-0.999999), F.coalesce(rho, F.lit(0.0)))).alias("_rho"))
    d = d.join(rhos, unit)
    moved = d.withColumns({f"_t{i}": F.when(F.col("_p").isNull(), F.col(c) * F.sqrt(1 - F.col("_rho") * F.col("_rho"))).otherwise(F.col(c) - F.col("_rho") * F.lag(c).over(w)) for i, c in enumerate([*cols, y])})
    g, n = L.gram(moved, [f"_t{i}" for i in range(len(cols) + 1)])
    final = L.solve(g[:-1, :-1], g[:-1, -1])
    out = Result(df.sparkSession, dict(zip(cols, final)), n_obs=n)
    if boot:
        boot, k = _signs(boot, unit), len(cols)
        parts = _lag_sums(df.withColumn("_u", F.col(y) - linear_form(cols, final)), [*cols, "_u"], unit, time, "prais", (unit,))
        parts, b = B.each_draw(checkpointed(parts), "_w", boot)
        names = [c for c in parts.columns if c[0] in "abcdef" and c[1:2].isdigit()]
        at = {c: i for i, c in enumerate(names)}

        def products(row):
            return {m: np.array([[row[at[f"{m}{min(i, j)}_{max(i, j)}"]] for j in range(k + 1)] for i in range(k + 1)]) for m in "abcdef"}

        def plain(row, w):
            e = products(row)["e"]
            return np.hstack([np.tile(e[:k, :k].ravel(), (b, 1)), w[:, None] * e[:k, k]])

        d = _systems(_over_clusters(parts, names, b, k * k + k, plain), k)  # first-step deviations, a row a draw

        def whitened(row, w):
            s, v = products(row), np.column_stack([-d, w])
            form = {m: np.einsum("bi,ij,bj->b", v, s[m], v) for m in "debf"}
            with np.errstate(divide="ignore", invalid="ignore"):
                rho = 1 - form["d"] / form["e"] / 2 if rho_method == "dw" else form["b"] / 2 / form["f"]
            rho = np.clip(np.nan_to_num(rho), -0.999999, 0.999999)[:, None, None]
            g = s["a"] - rho * s["b"] + rho * rho * s["c"]
            return np.hstack([g[:, :k, :k].reshape(b, -1), w[:, None] * g[:, :k, k]])

        c = B.ssc_factor(n, k, groups(df, boot.cluster), boot.ssc.get("adj", True), boot.ssc.get("cluster.adj", True))
        out.extra["draws"] = c * _systems(_over_clusters(parts, names, b, k * k + k, whitened), k)
        out.se = dict(zip(cols, out.extra["draws"].std(0, ddof=1)))
    return out


def exchangeable_rho(df: DataFrame, u: str, cluster: str) -> float:
    """Sum[(sum e)^2 - sum e^2] / Sum[(m - 1) sum e^2] over clusters."""
    s = df.groupBy(cluster).agg(F.sum(u).alias("s"), F.sum(F.col(u) * F.col(u)).alias("q"), F.count(F.lit(1)).alias("m"))
    r = s.agg((F.sum(F.col("s") * F.col("s") - F.col("q")) / F.sum((F.col("m") - 1) * F.col("q"))).alias("rho")).first()
    return float(r.rho)


def exchangeable(df: DataFrame, y: str, x: Sequence[str], cluster: str, boot: B.Boot | None = None) -> Result:
    """Equal correlation within clusters; whitened by the symmetric root, a * x + b_m * cluster mean.

    Draws turn each cluster's residuals by a sign and estimate the correlation anew, from the clusters' sums and products.
    """
    df = df.where(L.finite([y, *x])).withColumn("_cons", F.lit(1.0))
    cols = [*x, "_cons"]
    g, n = L.gram(df, [*cols, y])
    beta = L.solve(g[:-1, :-1], g[:-1, -1])
    rho = exchangeable_rho(df.withColumn("_u", F.col(y) - linear_form(cols, beta)), "_u", cluster)
    w = Window.partitionBy(cluster)
    a = (1 - rho) ** -0.5
    b = F.pow(1 - F.lit(rho) + F.lit(rho) * F.count(F.lit(1)).over(w), F.lit(-0.5)) - F.lit(a)
    d = df.withColumn("_b", b).withColumns({f"_t{i}": F.lit(a) * F.col(c) + F.col("_b") * F.avg(c).over(w) for i, c in enumerate([*cols, y])})
    g, _ = L.gram(d, [f"_t{i}" for i in range(len(cols) + 1)])
    final = L.solve(g[:-1, :-1], g[:-1, -1])
    out = Result(df.sparkSession, dict(zip(cols, final)), n_obs=n, diagnostics={"rho": rho})
    if boot:
        boot, k = _signs(boot, cluster), len(cols)
        every = [*cols, "_u"]
        u = df.withColumn("_u", F.col(y) - linear_form(cols, final))
        sums = [F.sum(F.col(p).cast("double")).alias(f"s{i}") for i, p in enumerate(every)]
        sums += [F.sum(F.col(p).cast("double") * F.col(q).cast("double")).alias(f"q{i}_{j}") for i, p in enumerate(every) for j, q in enumerate(every)]
        parts, b = B.each_draw(checkpointed(u.groupBy(cluster).agg(F.count(F.lit(1)).alias("m"), *sums)), "_w", boot)
        names = ["m", *(f"s{i}" for i in range(k + 1)), *(f"q{i}_{j}" for i in range(k + 1) for j in range(k + 1))]
        split = lambda row: (row[0], row[1 : k + 2], row[k + 2 :].reshape(k + 1, k + 1))

        def plain(row, w):
            _, _, q = split(row)
            return np.hstack([np.tile(q[:k, :k].ravel(), (b, 1)), w[:, None] * q[:k, k]])

        d = _systems(_over_clusters(parts, names, b, k * k + k, plain), k)

        def likeness(row, w):
            m, s, q = split(row)
            v = np.column_stack([-d, w])
            own = np.einsum("bi,ij,bj->b", v, q, v)
            return np.column_stack([(v @ s) ** 2 - own, (m - 1) * own])

        top = _over_clusters(parts, names, b, 2, likeness)
        rhos = top[:, 0] / top[:, 1]

        def whitened(row, w):
            m, s, q = split(row)
            a = (1 - rhos) ** -0.5
            lift = (1 - rhos + rhos * m) ** -0.5 - a
            g = (a * a)[:, None, None] * q + ((2 * a * lift + lift * lift) / m)[:, None, None] * np.outer(s, s)
            return np.hstack([g[:, :k, :k].reshape(b, -1), w[:, None] * g[:, :k, k]])

        c = B.ssc_factor(n, k, groups(df, boot.cluster), boot.ssc.get("adj", True), boot.ssc.get("cluster.adj", True))
        out.extra["draws"] = c * _systems(_over_clusters(parts, names, b, k * k + k, whitened), k)
        out.se = dict(zip(cols, out.extra["draws"].std(0, ddof=1)))
    return out
