"""Least squares with absorbed effects, constraints and a wild bootstrap from cluster scores."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import draws as D
from plumbline.operators import boot as B
from plumbline.operators import fe as FE
from plumbline.operators import linear as L
from plumbline.operators.result import Result

# The constant's name and place by dialect.
CONSTANT = {"stata": "_cons", "r": "(Intercept)", "statsmodels": "const"}


def add_constant(df: DataFrame, cols: Sequence[str], dialect: str = "stata") -> tuple[DataFrame, list[str], str]:
    """(frame, columns, the constant's name): a column of ones is adopted, other constant columns are dropped."""
    name = CONSTANT[dialect]
    span = df.agg(*[F.min(c).alias(f"a{i}") for i, c in enumerate(cols)], *[F.max(c).alias(f"b{i}") for i, c in enumerate(cols)]).first() if cols else None
    fixed = {c: span[f"a{i}"] for i, c in enumerate(cols) if span[f"a{i}"] is not None and span[f"a{i}"] == span[f"b{i}"]}
    if name in cols and name not in fixed:
        raise ValueError(f"{name!r} is reserved for the constant")
    ones = [c for c, v in fixed.items() if v == 1]
    rest = [c for c in cols if c not in fixed]
    if ones:
        return df, [*rest, ones[0]] if dialect == "stata" else [ones[0], *rest], ones[0]
    df = df.withColumn(name, F.lit(1.0))
    return df, [*rest, name] if dialect == "stata" else [name, *rest], name


def linear_form(cols: Sequence[str], beta: Sequence[float]) -> Column:
    out = F.lit(0.0)
    for c, b in zip(cols, beta):
        out = out + F.col(c).cast("double") * F.lit(float(b))
    return out


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of a 64-bit generator: neighbouring numbers come out unlike."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _weights(dist: str, x: np.ndarray) -> np.ndarray:
    """Multipliers from mixed 64-bit numbers."""
    if dist == "rademacher":
        return np.where(x >> np.uint64(63), 1.0, -1.0)
    u = (x >> np.uint64(11)) / float(1 << 53)
    if dist == "webb":
        return np.array(D.WEBB)[(u * 6).astype(int)]
    if dist in ("mammen", "wgb"):
        return np.where(u < D.MAMMEN[2], D.MAMMEN[0], D.MAMMEN[1])
    if dist == "exp":
        return -np.log1p(-u)
    v = (_mix(x) >> np.uint64(11)) / float(1 << 53)
    return np.sqrt(-2 * np.log1p(-u)) * np.cos(2 * np.pi * v)


def row_draw_sums(df: DataFrame, cols: Sequence[str], boot: B.Boot, key: Sequence[str] | None = None) -> np.ndarray:
    """B x k sums of weight(row, b) * column for unclustered designs: each task multiplies its rows' weights, k x B leave it.

    Weights come from a mix of the draw's number and the row's: the hash of ``key``, whose values should tell rows apart, or,
    without one, the row's place.  Places run through the partitions in order (one count a partition comes back first), so
    rows that repeat are drawn each for itself, and a file's rows get the same weights however it is split.
    """
    k, n = len(cols), boot.n
    seed = np.uint64((boot.seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64)
    own = F.xxhash64(*key) if key else F.lit(0).cast("long")
    rows = df.select(own.alias("h"), *[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)])
    starts: dict[int, tuple[int, int]] = {}
    if not key:
        def held(batches):
            total = sum(b.num_rows for b in batches)
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]), pa.array([total])], ["part", "n"])

        at = 0
        for r in sorted(rows.mapInArrow(held, "part long, n long").collect()):
            starts[r.part], at = (at, r.n), at + r.n

    def part(batches):
        out = np.zeros((n, k))
        first, expected = starts.get(TaskContext.get().partitionId(), (0, 0))
        seen = 0
        with np.errstate(over="ignore"):
            step = _mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + seed)
        for b in batches:
            x = np.column_stack([np.asarray(c, np.float64) for c in b.columns[1:]])
            h = np.asarray(b.column(0), np.int64).view(np.uint64) if key else np.arange(first + seen, first + seen + len(x), dtype=np.uint64)
            seen += len(x)
            for i in range(0, len(x), 1024):
                with np.errstate(over="ignore"):
                    w = _weights(boot.dist, _mix(h[i : i + 1024, None] + step[None]))
                out += w.T @ x[i : i + 1024]
        if not key and seen != expected:
            raise RuntimeError("the rows' partitions changed between two reads: checkpoint the frame or name a key")
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n * k)), pa.array(out.ravel())], ["pos", "v"])

    out = np.zeros(n * k)
    for r in rows.mapInArrow(part, "pos long, v double").groupBy("pos").agg(F.sum("v").alias("v")).collect():
        out[r.pos] = r.v
    return out.reshape(n, k)


def cluster_draws(df: DataFrame, cols: Sequence[str], boot: B.Boot) -> np.ndarray:
    """B x k draws of Sum_g w_gb * (cluster sums of ``cols``); one row a draw comes back."""
    names = [f"s{i}" for i in range(len(cols))]
    sums = B.draw_sums(B.scores(df, list(cols), boot.cluster, names), names, boot)
    rows = sorted(sums.collect(), key=lambda r: r.b)
    return np.array([[r[c] for c in names] for r in rows], float)


def groups(df: DataFrame, cluster: Sequence[str]) -> list[int]:
    row = df.agg(*[F.countDistinct(c).alias(f"g{i}") for i, c in enumerate(cluster)]).first()
    return [row[i] for i in range(len(cluster))]


class OLS:
    """``OLS("y", ["x1", "x2"], df, fes=[...], boot=Boot(...), constraints="x1 = x2", null="x2 = 0").fit()``.

    ``null`` asks for draws with the restriction imposed and the Wald statistic against them.
    """

    def __init__(self, y: str, x: Sequence[str], df: DataFrame, fes: Sequence[str] = (), boot: B.Boot | None = None, constraints: str | None = None,
                 constant: bool = True, dialect: str = "stata", weights: str | None = None, key: Sequence[str] | None = None, null: str | None = None):
        if weights is not None:
            raise ValueError("weights are not supported here; use GLS")
        self.y, self.x, self.df, self.fes, self.boot = y, list(x), df, list(fes), boot
        self.null, self.constraints, self.constant, self.dialect, self.key = null, constraints, constant and not fes, dialect, key

    def fit(self) -> Result:
        df, mode = self.df, "r" if self.dialect == "r" else "stata"
        before = df.count()
        df = df.where(L.finite([self.y, *self.x]))
        dropped = {"na": before - df.count()}
        dof = {}
        y, x = self.y, list(self.x)
        if self.fes:
            used = [y, *x, *(f for t in self.fes for f in t.split(":")), *(self.boot.cluster if self.boot else ()), *(self.key or ())]
            df = df.select(*dict.fromkeys(used))  # checkpoints below hold what is needed only
            df, dropped["fe_id_na"] = FE.drop_missing(df, self.fes)
            df, keys = FE.interact(df, self.fes)
            keys = FE.prune_nested(df, keys)
            df, dropped["singletons"] = FE.drop_singletons(df, keys)
            dof = FE.degrees_of_freedom(df, keys, self.boot.cluster if self.boot else ())
            df = FE.demean(df, [y, *x], keys, suffix="__w")
            y, x = y + "__w", [c + "__w" for c in x]
        names = dict(zip(x, self.x))
        if self.constant:
            df, x, const = add_constant(df, x, self.dialect)
            names[const] = const
        kept, gone = L.screen(df, x, mode)
        g, n = L.gram(df, [*kept, y])
        xx, xy, k = g[:-1, :-1], g[:-1, -1], len(kept)
        if self.constraints:
            r, q, _ = L.parse_constraints(self.constraints, [names[c] for c in kept])
            beta = L.constrained(xx, xy, r, q)
            null = np.linalg.svd(r)[2][np.linalg.matrix_rank(r):].T
            inv = null @ np.linalg.inv(null.T @ xx @ null) @ null.T
        else:
            beta, inv = L.solve(xx, xy), np.linalg.inv(xx)
        params = dict(zip((names[c] for c in kept), beta))
        fill = 0.0 if mode == "stata" else float("nan")
        params = {names[c]: params.get(names[c], fill) for c in x}
        rss = float(g[-1, -1] - 2 * beta @ xy + beta @ xx @ beta)
        out = Result(df.sparkSession, params, n_obs=n, diagnostics={"rss": rss, "rank": k, "df_absorbed": FE.absorbed(dof), **{f"dropped_{a}": b for a, b in dropped.items()}})
        out.extra = {"dropped_columns": [names[c] for c in gone], "fe_dof": dof, "frame": df, "columns": kept, "beta": beta}
        if self.boot:
            c = 1.0
            if self.boot.cluster:
                sizes = groups(df, self.boot.cluster)
                full = self.boot.ssc.get("fixef.K", "none")
                c = B.ssc_factor(n, k + (FE.absorbed(dof) if full in ("full", "nested") else 0), sizes, self.boot.ssc.get("adj", True), self.boot.ssc.get("cluster.adj", True))
                out.diagnostics |= {f"clusters_{a}": b for a, b in zip(self.boot.cluster, sizes)}

            def drawn(b, bread):
                u = df.withColumn("_u", F.col(y) - linear_form(kept, b))
                score = u.withColumns({f"_s{i}": F.col(x_) * F.col("_u") for i, x_ in enumerate(kept)})
                cols = [f"_s{i}" for i in range(k)]
                sums = cluster_draws(score, cols, self.boot) if self.boot.cluster else row_draw_sums(score, cols, self.boot, self.key)
                return c * sums @ bread

            draws = drawn(beta, inv)
            out.extra["draws"] = draws
            out.se = {names[a]: s for a, s in zip(kept, draws.std(0, ddof=1))}
            if self.null:  # the restricted wild bootstrap: residuals under the null, deviations of the free fit
                r, q, _ = L.parse_constraints(self.null, [names[a] for a in kept])
                under = drawn(L.constrained(xx, xy, r, q), np.linalg.inv(xx))
                stat, stats = B.wald(under, beta, r, q)
                out.extra |= {"null_draws": under, "null_se": {names[a]: s for a, s in zip(kept, under.std(0, ddof=1))}}
                out.diagnostics |= {"wald": stat, "wald_crit": B.bplus1_quantile(stats, 0.05)}
        return out
