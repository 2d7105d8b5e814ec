"""Quantile regression: exact, by solving a small problem whose far rows are summed up.

Rows surely above or below the fitted plane enter only through the sum of their regressors, so each round one aggregate
glues them together and only rows near the plane come to the driver; a violated guess widens the band.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import draws as DR
from plumbline.operators import boot as B
from plumbline.operators import linear as L
from plumbline.operators.ols import linear_form
from plumbline.operators.result import Result

#: Rows that the driver solves for at a time.
NEAR = 20_000
#: Rows, about, that a pass over all rows takes its first planes from.
START = 5_000


def solve_lp(x: np.ndarray, y: np.ndarray, tau: float, weight: np.ndarray | None = None, rounds: int = 100, tol: float = 1e-12) -> np.ndarray:
    """Frisch-Newton interior point on the bounded dual: max y'a with X'a = (1 - tau) X'1 and 0 <= a <= 1."""
    if weight is not None:
        x, y = x * weight[:, None], y * weight
    n, k = x.shape
    b = (1 - tau) * x.sum(0)
    a = np.full(n, 1 - tau)
    c = -y
    beta = np.linalg.lstsq(x, c, rcond=None)[0]
    r = c - x @ beta
    r[r == 0] = 1e-3
    z, w = np.maximum(r, 0) + 1e-3, np.maximum(-r, 0) + 1e-3
    s = 1 - a
    for _ in range(rounds):
        gap = a @ z + s @ w
        if gap < tol * (1 + abs(c @ a)):
            break
        q = 1 / (z / a + w / s)
        rd = c - x @ beta - z + w
        rp = b - x.T @ a

        def direction(mu, da0, dz0, ds0, dw0):
            rz = mu - a * z - da0 * dz0
            rw = mu - s * w - ds0 * dw0
            rhs = rd - rz / a + rw / s
            db = np.linalg.lstsq((x * q[:, None]).T @ x, rp + (x * q[:, None]).T @ rhs, rcond=None)[0]
            da = q * (x @ db - rhs)
            ds = -da
            return db, da, ds, (rz - z * da) / a, (rw - w * ds) / s

        def step(v, dv):
            neg = dv < 0
            return min(1.0, 0.99995 * float((-v[neg] / dv[neg]).min())) if neg.any() else 1.0

        zero = np.zeros(n)
        db, da, ds, dz, dw = direction(0.0, zero, zero, zero, zero)
        pa, pd = min(step(a, da), step(s, ds)), min(step(z, dz), step(w, dw))
        mu = gap / (2 * n) * (((a + pa * da) @ (z + pd * dz) + (s + pa * ds) @ (w + pd * dw)) / gap) ** 3
        db, da, ds, dz, dw = direction(mu, da, dz, ds, dw)
        pa, pd = min(step(a, da), step(s, ds)), min(step(z, dz), step(w, dw))
        a, s = a + pa * da, s + pa * ds
        beta, z, w = beta + pd * db, z + pd * dz, w + pd * dw
    return -beta


def vertex(x: np.ndarray, y: np.ndarray, beta: np.ndarray, tau: float, weight: np.ndarray | None = None) -> np.ndarray:
    """The basic solution next to an interior one: exact through k rows."""
    k = x.shape[1]
    order = np.argsort(np.abs(y - x @ beta), kind="stable")
    rows: list[int] = []
    for i in order[: 50 * k]:
        if np.linalg.matrix_rank(x[[*rows, i]]) > len(rows):
            rows.append(i)
            if len(rows) == k:
                break
    if len(rows) < k:
        return beta
    exact = np.linalg.solve(x[rows], y[rows])
    w = np.ones(len(y)) if weight is None else weight
    loss = lambda b: float((w * (u := y - x @ b) * (tau - (u < 0))).sum())
    return exact if loss(exact) <= loss(beta) * (1 + 1e-9) + 1e-12 else beta


def descend(x: np.ndarray, y: np.ndarray, tau: float, weight: np.ndarray, pull: np.ndarray, start: np.ndarray) -> np.ndarray | None:
    """Minimises sum of weight * rho(y - x b) less pull'b along edges from the vertex next to ``start``; None: no minimum, or no vertex.

    ``pull`` is what glued rows add to the gradient.  Each step runs through the break points of the steepest edge.
    """
    k = x.shape[1]
    u = y - x @ start
    basis: list[int] = []
    for i in np.argsort(np.abs(u), kind="stable")[: 200 * k]:
        if np.linalg.matrix_rank(x[[*basis, i]]) > len(basis):
            basis.append(int(i))
            if len(basis) == k:
                break
    if len(basis) < k:
        return None
    size = 1e-13 * (1 + np.abs(y).max())
    for _ in range(100 * k + len(y)):
        inv = np.linalg.inv(x[basis])
        beta = inv @ y[basis]
        u = y - x @ beta
        on = np.abs(u) <= size
        on[basis] = True
        s = np.where(on, 0.0, weight * (tau - (u < 0)))
        g = x.T @ s + pull
        best = None
        for j in range(k):
            for d in (inv[:, j], -inv[:, j]):
                v = -(x[on] @ d)
                slope = float(-(g @ d) + (weight[on] * v * (tau - (v < 0))).sum())
                if slope < -1e-7 * weight[basis[j]] and (best is None or slope < best[0]):
                    best = slope, j, d
        if best is None:
            return beta
        slope, j, d = best
        move = x @ d
        at = np.flatnonzero(~on & (u * move > 0))
        order = at[np.argsort(u[at] / move[at], kind="stable")]
        rise = slope + np.cumsum(weight[order] * np.abs(move[order]))
        stop = int(np.searchsorted(rise, 0.0))
        if stop == len(order):
            return None
        basis[j] = int(order[stop])
    return None


#: Halvings, by half powers of two, of a band's width that rows are counted in.
_BINS = 80


def _look(points: list[dict], k: int, tau: float):
    """A task's part of a pass: batches of (y, d, regressors without the constant) -> (point, pos, v, near).

    Of each point (a, beta, h): sums of x * (tau - 1(u < 0)), of rho(u), of x x' in |u| <= h, and counts by |u| / h.  With
    ``width``, the rows in |u| <= width and the sums of x above and below.  With ``old``, an earlier plane and width: how many
    rows beyond that band are now on the other side.
    """
    a = np.array([p["a"] for p in points])
    planes = np.array([p["beta"] for p in points])

    def run(batches):
        stats = np.zeros((len(points), 1 + k + k * k + _BINS + 2 * k + 1))
        near = [[] for _ in points]
        for b in batches:
            m = np.column_stack([np.asarray(c, np.float64) for c in b.columns])
            for lo in range(0, len(m), 10_000):
                part = m[lo : lo + 10_000]
                y, d, x = part[:, 0], part[:, 1], np.column_stack([part[:, 2:], np.ones(len(part))])
                u = y[:, None] - np.outer(d, a) - x @ planes.T
                down = u < 0
                total = x.sum(0)
                below = down.T.astype(float) @ x
                stats[:, 0] += tau * u.sum(0) - np.where(down, u, 0.0).sum(0)
                stats[:, 1 : 1 + k] += tau * total - below
                size = np.abs(u)
                for i, p in enumerate(points):
                    at = np.flatnonzero(size[:, i] <= p["h"])
                    if len(at):
                        stats[i, 1 + k : 1 + k + k * k] += (x[at].T @ x[at]).ravel()
                        bins = np.floor(-2 * np.log2(np.maximum(size[at, i] / p["h"], 1e-300)))
                        stats[i, 1 + k + k * k :][:_BINS] += np.bincount(np.clip(bins, 0, _BINS - 1).astype(int), minlength=_BINS)
                    if "width" in p:
                        inside = size[:, i] <= p["width"]
                        stats[i, -2 * k - 1 : -k - 1] += x[~inside & ~down[:, i]].sum(0)
                        stats[i, -k - 1 : -1] += x[~inside & down[:, i]].sum(0)
                        near[i].append(np.column_stack([x[inside], (y - a[i] * d)[inside]]))
                    if "old" in p:
                        v = y - a[i] * d - x @ p["old"]
                        stats[i, -1] += int(((np.abs(v) > p["old_width"]) & (v * u[:, i] < 0)).sum())
        n, g = stats.shape[1], len(points)
        blobs = [b""] * (g * n)
        blobs[::n] = [np.vstack(parts).tobytes() if parts else b"" for parts in near]
        columns = [np.repeat(np.arange(g, dtype=np.int32), n), np.tile(np.arange(n, dtype=np.int32), g), stats.ravel()]
        yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(blobs, pa.binary())], ["point", "pos", "v", "near"])

    return run


def solve_many(data: DataFrame, y: str, d: str, cols: Sequence[str], values: Sequence[float], tau: float, starts: np.ndarray, widths: Sequence[float], n: int, reach: np.ndarray, near: int = NEAR, rounds: int = 60) -> np.ndarray:
    """Quantile regressions of y - a * d on ``cols`` and a constant for every a of ``values``, all in the same passes over all rows.

    Newton steps on the whole gradient, with the density of the rows near the plane, go on until the rows that a step can
    pass fit on the driver (``near``).  Those are fetched, the others glued into the gradient, the small problem is solved
    exactly, and a pass sees whether a glued row changed sides; if so, that plane is where the search goes on.  ``reach``: the columns' largest magnitudes.
    """
    k = len(cols) + 1
    todo = [{"i": i, "a": float(a), "beta": np.asarray(b, float), "h": float(w), "room": near, "shrink": 1.0} for i, (a, b, w) in enumerate(zip(values, starts, widths))]
    found = np.zeros((len(todo), k))
    rows = data.select(y, d, *cols)
    for turn in range(rounds):
        sent = [{key: p[key] for key in ("a", "beta", "h", "width", "old", "old_width") if key in p} for p in todo]
        got = rows.mapInArrow(_look(sent, k, tau), "point int, pos int, v double, near binary").groupBy("point", "pos")
        got = got.agg(F.sum("v").alias("v"), F.collect_list(F.when(F.length("near") > 0, F.col("near"))).alias("near"))
        stats, fetched = np.zeros((len(todo), 1 + 3 * k + k * k + _BINS + 1)), {}
        for r in got.collect():  # a point's sums, and ``room`` rows of those whose turn it is
            stats[r.point, r.pos] = r.v
            if r.near:
                fetched[r.point] = np.frombuffer(b"".join(r.near)).reshape(-1, k + 1)
        rest = []
        for at, p in enumerate(todo):
            st = stats[at]
            if "old" in p:  # the pass that tries a solved problem
                if not st[-1]:
                    found[p["i"]] = p["beta"]
                    continue
                del p["old"], p["old_width"]
                p["loss"] = np.inf
            if "width" in p:
                w = p.pop("width")
                pull = tau * st[-2 * k - 1 : -k - 1] + (tau - 1) * st[-k - 1 : -1]
                b = _small(fetched.get(at, np.zeros((0, k + 1))), pull, tau, p["beta"])
                if b is not None:
                    p |= {"old": p["beta"], "old_width": w, "beta": b}
                    rest.append(p)
                    continue
                p["room"] *= 2  # the band does not hold the minimum
            if st[0] > p.get("loss", np.inf) * (1 + 1e-12) and p["shrink"] > 1e-6:
                p["shrink"] /= 2
                p["beta"] = p["best"] + p["shrink"] * p["step"]
                rest.append(p)
                continue
            counts = np.cumsum(st[1 + k + k * k :][:_BINS][::-1])[::-1]  # rows with |u| <= h * 2 ** (-j / 2)
            h = p["h"]
            hess = st[1 + k : 1 + k + k * k].reshape(k, k) / (2 * h)
            if counts[0] < 20 * k or np.linalg.matrix_rank(hess) < k:
                p["h"] = 4 * h
                rest.append(p)
                continue
            step = np.linalg.solve(hess, st[1 : 1 + k])
            fits = np.flatnonzero(counts <= p["room"])
            width = h * 2.0 ** (-fits[0] / 2) if len(fits) else 0.0
            wide = np.flatnonzero(counts <= max(np.sqrt(float(n) * near), 100 * k))
            p["h"] = h * 2.0 ** (-wide[0] / 2) if len(wide) and wide[0] else 2 * h if counts[0] < np.sqrt(float(n) * near) / 4 else h
            if np.abs(step) @ reach <= width or (turn > 15 and width):
                p["width"], p["h"] = width, max(p["h"], width)
                if turn > 15:
                    p["room"] *= 2
            else:
                p |= {"best": p["beta"], "loss": st[0], "step": step, "shrink": 1.0, "beta": p["beta"] + step}
            rest.append(p)
        todo = rest
        if not todo:
            return found
    raise RuntimeError("the rows near the plane do not fit on the driver")


def _small(rows: np.ndarray, pull: np.ndarray, tau: float, start: np.ndarray) -> np.ndarray | None:
    """The problem of fetched rows (regressors, y), equal ones weighted by their number, around the plane ``start``."""
    if not len(rows):
        return None
    rows, count = np.unique(rows, axis=0, return_counts=True)
    x = rows[:, :-1]
    b = descend(x, rows[:, -1] - x @ start, tau, count.astype(float), pull, np.zeros(len(start)))
    return None if b is None else start + b


class QR:
    def __init__(self, y: str, x: Sequence[str], df: DataFrame, tau: float = 0.5, boot: B.Boot | None = None, weight: str | None = None, key: str = "id", near: int = NEAR):
        if weight is not None:
            raise ValueError("weights are not supported here")
        self.y, self.x, self.df, self.tau, self.boot, self.key, self.near = y, list(x), df, tau, boot, key, near

    def _solve(self, df: DataFrame, cols, n: int, start: np.ndarray, spread: float, weight=None) -> np.ndarray:
        """Portnoy and Koenker's rounds: rows outside a band around the current plane are glued."""
        w = F.col(weight) if weight else F.lit(1.0)
        width = spread
        beta = start
        for _ in range(40):
            u = F.col(self.y) - linear_form(cols, beta)
            center = df.select(F.percentile_approx(u, self.tau, 10000)).first()[0]
            at = df.withColumn("_u", u - F.lit(float(center)))
            inside = F.abs(F.col("_u")) <= F.lit(float(width))
            held = at.where(inside).count()
            if held > self.near and n > self.near:
                width *= 0.5 * self.near / held
                continue
            above = at.where(F.col("_u") > F.lit(float(width))).agg(*[F.sum(w * F.col(c)).alias(f"s{i}") for i, c in enumerate(cols)], F.sum(w * F.col(self.y)).alias("y"), F.count(F.lit(1)).alias("n")).first()
            below = at.where(F.col("_u") < F.lit(float(-width))).agg(*[F.sum(w * F.col(c)).alias(f"s{i}") for i, c in enumerate(cols)], F.sum(w * F.col(self.y)).alias("y"), F.count(F.lit(1)).alias("n")).first()
            near = at.where(inside).select(*cols, self.y, w.alias("_w")).collect()  # ``near`` rows at most
            x = np.array([[r[i] for i in range(len(cols))] for r in near], float).reshape(-1, len(cols))
            y, ww = np.array([r[len(cols)] for r in near], float), np.array([r[len(cols) + 1] for r in near], float)
            gx, gy, gw = [x], [y], [ww]
            big = 1e3 * (1 + abs(spread))
            for part, sign in ((above, 1.0), (below, -1.0)):
                if part.n:
                    gx.append(np.array([[part[f"s{i}"] for i in range(len(cols))]]))
                    gy.append(np.array([part.y + sign * big * part.n]))
                    gw.append(np.array([1.0]))
            X, Y, W = np.vstack(gx), np.concatenate(gy), np.concatenate(gw)
            beta = vertex(X, Y, solve_lp(X, Y, self.tau, W), self.tau, W)
            # A guess holds if every glued row is still on its side.
            v = F.col(self.y) - linear_form(cols, beta)
            bad = at.where(((F.col("_u") > F.lit(float(width))) & (v < 0)) | ((F.col("_u") < F.lit(float(-width))) & (v > 0)))
            if bad.isEmpty():
                return beta
            width *= 2
        raise RuntimeError("the rows near the plane do not fit on the driver")

    def fit(self) -> Result:
        df = self.df.where(L.finite([self.y, *self.x])).withColumn("_cons", F.lit(1.0))
        cols = [*self.x, "_cons"]
        df = df.withColumns({c: F.col(c).cast("double") for c in [*cols, self.y]})
        g, n = L.gram(df, [*cols, self.y])
        ls = L.solve(g[:-1, :-1], g[:-1, -1])
        sd = float(np.sqrt(max(g[-1, -1] - ls @ g[:-1, -1], 1e-12) / n))
        beta = self._solve(df, cols, n, ls, 10 * sd)
        out = Result(df.sparkSession, dict(zip(cols, beta)), n_obs=n, extra={"columns": cols, "beta": beta})
        if self.boot:
            if self.boot.cluster:  # wild gradient draws: density-weighted Gram and check scores by cluster
                h = 1.06 * sd * n**-0.2
                u = df.withColumn("_u", F.col(self.y) - linear_form(cols, beta))
                gram, _ = L.gram(u.withColumn("_f", F.exp(-F.pow(F.col("_u") / h, F.lit(2.0)) / 2) / (h * np.sqrt(2 * np.pi))), cols, "_f")
                psi = u.withColumns({f"_s{i}": F.col(c) * (F.lit(self.tau) - (F.col("_u") < -1e-12).cast("double")) for i, c in enumerate(cols)})
                from plumbline.operators.ols import cluster_draws

                boot = B.Boot(self.boot.n, "mammen", self.boot.seed, self.boot.cluster, enumerate=False)
                draws = cluster_draws(psi, [f"_s{i}" for i in range(len(cols))], boot) @ np.linalg.inv(gram)
            else:  # exponential weights, solved again
                draws = np.array([self._solve(df.withColumn("_e", DR.multiplier("exp", self.boot.seed, F.col(self.key), F.lit(b))), cols, n, beta, 10 * sd, "_e") for b in range(self.boot.n)])
            out.extra["draws"] = draws
            out.se = dict(zip(cols, draws.std(0, ddof=1)))
        return out


def fit_many(y: str, x: Sequence[str], df: DataFrame, taus: Sequence[float], **kw) -> dict[float, Result]:
    return {t: QR(y, x, df, t, **kw).fit() for t in taus}


def ivqr(df: DataFrame, y: str, d: str, x: Sequence[str], z: Sequence[str], tau: float = 0.5, span: float = 4.0, points: int = 61, rounds: int = 4) -> Result:
    """One endogenous regressor: the value whose quantile regression of y - value * d gives the instruments least weight.

    The search narrows a grid around the two-stage least squares value.  Up to NEAR rows each grid point is solved on the
    driver, beyond all points of a grid are solved together by passes over all rows (``solve_many``).
    """
    from plumbline.operators.iv import IV

    first = IV(y, [d], list(x), list(z), df).fit()
    cols = [*x, *z, "_cons"]
    used = list(dict.fromkeys([y, d, *x, *z]))
    data = df.where(L.finite([y, d, *x, *z])).select(*[F.col(c).cast("double").alias(c) for c in used], F.lit(1.0).alias("_cons")).persist()
    try:
        g, n = L.gram(data, list(z))
        norm = g / n
        centre = first.params[d]
        sd, sd_d = data.agg(F.stddev_pop(F.col(y) - F.lit(float(centre)) * F.col(d)), F.stddev_pop(d)).first()
        width = span * max(sd / sd_d, 1e-6)
        at = slice(len(x), len(x) + len(z))
        if n <= NEAR:
            rows = np.array(data.select(y, d, *cols).collect(), float)
            planes = lambda grid: np.array([solve_lp(rows[:, 2:], rows[:, 0] - a * rows[:, 1], tau) for a in grid])
        else:
            reach = np.array([*data.agg(*[F.max(F.abs(F.col(c))) for c in cols]).first()], float)
            some = np.array(data.select(y, d, *cols).sample(min(1.0, START / n), 1).limit(2 * START).collect(), float)  # the first planes only
            known: dict[float, np.ndarray] = {}

            def planes(grid):
                if len(known) > 1:  # from the planes of the grid before, between its points
                    old = sorted(known)
                    starts = np.column_stack([np.interp(grid, old, [known[a][i] for a in old]) for i in range(len(cols))])
                else:
                    starts = np.array([solve_lp(some[:, 2:], some[:, 0] - a * some[:, 1], tau) for a in grid])
                h = [float(np.quantile(np.abs(some[:, 0] - a * some[:, 1] - some[:, 2:] @ b), 0.1)) or 1e-6 * float(sd) for a, b in zip(grid, starts)]
                out = solve_many(data, y, d, cols[:-1], grid, tau, starts, h, n, reach, NEAR)
                known.clear()
                known.update({float(a): b for a, b in zip(grid, out)})
                return out

        for _ in range(rounds):
            grid = np.linspace(centre - width, centre + width, points)
            solved = planes(grid)
            best = int(np.argmin([float(b[at] @ norm @ b[at]) for b in solved]))
            centre, b = float(grid[best]), solved[best]
            width *= 3.0 / points
        if not rounds:
            b = planes(np.array([centre]))[0]
        names = [d, *x, "_cons"]
        return Result(df.sparkSession, dict(zip(names, [centre, *b[: len(x)], b[-1]])), n_obs=n, diagnostics={"weight_of_instruments": float(b[at] @ norm @ b[at])})
    finally:
        data.unpersist()
