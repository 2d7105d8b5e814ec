"""Linear algebra from sufficient statistics: one aggregate over the rows, small matrices on the driver."""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Up to this many columns cross-products are JVM sums; beyond, each task multiplies Arrow batches.
EXPRESSION_COLUMNS = 24


def finite(cols: Sequence[str]) -> Column:
    """Not null, not NaN, not infinite, in all columns."""
    ok = F.lit(True)
    for c in cols:
        x = F.col(c).cast("double")
        ok = ok & x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    return ok


def gram(df: DataFrame, cols: Sequence[str], weight: str | None = None) -> tuple[np.ndarray, int]:
    """(cross-products of ``cols``, weighted if asked; number of rows)."""
    cols, k = list(cols), len(cols)
    if k <= EXPRESSION_COLUMNS:
        w = F.col(weight).cast("double") if weight else F.lit(1.0)
        sums = [F.sum(F.col(a).cast("double") * F.col(b).cast("double") * w).alias(f"s{i}_{j}") for i, a in enumerate(cols) for j, b in enumerate(cols) if i <= j]
        row = df.agg(F.count(F.lit(1)).alias("n"), *sums).first()
        g = np.zeros((k, k))
        for i in range(k):
            for j in range(i, k):
                g[i, j] = g[j, i] = row[f"s{i}_{j}"] or 0.0
        return g, row.n

    def part(batches):
        g, n = np.zeros((k, k)), 0
        for b in batches:
            x = np.column_stack([np.asarray(c, np.float64) for c in b.columns[:k]])
            g, n = g + (x * (np.asarray(b.columns[k], np.float64)[:, None] if weight else 1.0)).T @ x, n + len(x)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k * k + 1)), pa.array(np.append(g.ravel(), n))], ["pos", "v"])

    rows = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)], *([F.col(weight).cast("double").alias("w")] if weight else []))
    flat = np.zeros(k * k + 1)
    for r in rows.mapInArrow(part, "pos long, v double").groupBy("pos").agg(F.sum("v").alias("v")).collect():
        flat[r.pos] = r.v
    return flat[:-1].reshape(k, k), int(flat[-1])


def gram_pairs(df: DataFrame, cols: Sequence[str], pairs: DataFrame, key: str) -> np.ndarray:
    """X'WX for a full weight matrix: ``pairs`` is (a, b, w) over the rows' ``key``; rows meet by two joins, sums are partial."""
    left = df.select(F.col(key).alias("a"), *[F.col(c).cast("double").alias(f"l{i}") for i, c in enumerate(cols)])
    right = df.select(F.col(key).alias("b"), *[F.col(c).cast("double").alias(f"r{i}") for i, c in enumerate(cols)])
    both = pairs.select("a", "b", "w").join(left, "a").join(right, "b")
    k = len(cols)
    row = both.agg(*[F.sum(F.col(f"l{i}") * F.col("w") * F.col(f"r{j}")).alias(f"s{i}_{j}") for i in range(k) for j in range(k)]).first()
    return np.array([[row[f"s{i}_{j}"] or 0.0 for j in range(k)] for i in range(k)])


def tsqr(df: DataFrame, cols: Sequence[str], fan: int = 64) -> np.ndarray:
    """R of the QR factorisation of the rows, by a tree of local factorisations (k x k rows a node).

    The tree goes on inside a task: its batches' factors meet ``fan`` at a time, level by level.  One factor carried through
    all batches would gather a rounding error from each, and a task of some millions of rows would pass the rank rules.
    """
    k = len(cols)
    schema = "row array<double>"

    def local(batches):
        levels: list[list[np.ndarray]] = [[]]
        for b in batches:
            x = np.column_stack([np.asarray(c, np.float64) for c in b.columns]) if b.num_columns == k and b.schema.names[0] != "row" else np.array(b.column(0).to_pylist(), float).reshape(-1, k)
            r, i = np.linalg.qr(x, mode="r") if len(x) else x, 0
            levels[0].append(r)
            while len(levels[i]) >= fan:
                r, levels[i], i = np.linalg.qr(np.vstack(levels[i]), mode="r"), [], i + 1
                if i == len(levels):
                    levels.append([])
                levels[i].append(r)
        r = np.zeros((0, k))
        for level in levels:  # what is left, the smallest first
            rest = np.vstack([r, *level])
            r = np.linalg.qr(rest, mode="r") if len(rest) else rest
        yield pa.RecordBatch.from_arrays([pa.array(r.tolist(), pa.list_(pa.float64()))], ["row"])

    rows = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)])
    n = rows.rdd.getNumPartitions()
    out = rows.mapInArrow(local, schema)
    while n > fan:
        n = -(-n // fan)
        out = out.coalesce(n).mapInArrow(local, schema)
    r = np.array([x.row for x in out.collect()], float).reshape(-1, k)
    return np.linalg.qr(r, mode="r") if len(r) else np.zeros((0, k))


def pivoted_qr(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(R, pivots) of Householder QR with column pivoting."""
    r, n = a.astype(float).copy(), a.shape[1]
    piv = np.arange(n)
    for j in range(min(r.shape)):
        norms = (r[j:, j:] ** 2).sum(0)
        p = j + int(norms.argmax())
        r[:, [j, p]], piv[[j, p]] = r[:, [p, j]], piv[[p, j]]
        v = r[j:, j].copy()
        size = np.sqrt((v**2).sum())
        if size:
            v[0] += np.copysign(size, v[0])
            v /= np.sqrt((v**2).sum())
            r[j:, j:] -= 2 * np.outer(v, v @ r[j:, j:])
    return np.triu(r[: min(r.shape)]), piv


def numerical_rank(diagonal: np.ndarray, mode: str = "stata", n_columns: int | None = None) -> int:
    """``stata``: above 1e-13 of the mean magnitude; ``r``: above 1e-7 of the largest; else above eps * k * largest."""
    d = np.abs(np.asarray(diagonal, float))
    if not len(d) or not d.max():
        return 0
    if mode == "stata":
        return int((d > 1e-13 * d.sum() / len(d)).sum())
    if mode == "r":
        return int((d > 1e-7 * d.max()).sum())
    return int((d > np.finfo(float).eps * (n_columns or len(d)) * d.max()).sum())


def screen(df: DataFrame, cols: Sequence[str], mode: str = "stata") -> tuple[list[str], list[str]]:
    """(kept, dropped) columns: pivoted QR keeps the leading pivots."""
    r, piv = pivoted_qr(tsqr(df, cols))
    rank = numerical_rank(np.diag(r), mode)
    kept = sorted(piv[:rank].tolist())
    return [cols[i] for i in kept], [c for i, c in enumerate(cols) if i not in kept]


def solve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a x = b for a cross-product matrix, scaled to a unit diagonal."""
    s = np.sqrt(np.where(np.diag(a) > 0, np.diag(a), 1.0))
    x = np.linalg.solve(a / np.outer(s, s), b / (s if b.ndim == 1 else s[:, None]))
    return x / (s if b.ndim == 1 else s[:, None])


def constrained(xx: np.ndarray, xy: np.ndarray, r: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Least squares under r beta = q, through the normal equations with multipliers."""
    k, m = len(xx), len(r)
    kkt = np.block([[xx, r.T], [r, np.zeros((m, m))]])
    beta = np.linalg.lstsq(kkt, np.concatenate([xy, q]), rcond=None)[0][:k]
    if not np.allclose(r @ beta, q, rtol=1e-8, atol=1e-8):
        raise ValueError("the constraints contradict each other")
    return beta


_TERM = re.compile(r"\s*([+-]?)\s*(?:(\d+\.?\d*(?:[eE][+-]?\d+)?)\s*(?:\*\s*(?=[A-Za-z_(]))?)?\s*(?:_b\[([^\]]+)\]|([A-Za-z_(][\w.:()]*))?")


def parse_constraints(spec: str, names: Sequence[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(R, q, labels) of equations such as ``2*_b[x] + z = 1; a == b``; rows that add nothing are pruned."""
    rows, rhs, labels = [], [], []
    for part in filter(str.strip, spec.split(";")):
        sides = re.split(r"==?", part)
        if len(sides) != 2:
            raise ValueError(f"a constraint needs one equals sign: {part!r}")
        row, q = np.zeros(len(names)), 0.0
        for side, sign in zip(sides, (1.0, -1.0)):
            at, side = 0, side.strip()
            while at < len(side):
                m = _TERM.match(side, at)
                if not m or m.end() == at:
                    raise ValueError(f"can't read {side[at:]!r}")
                c = sign * (-1.0 if m[1] == "-" else 1.0) * (float(m[2]) if m[2] else 1.0)
                name = m[3] or m[4]
                if name is None:
                    q -= c
                elif name in names:
                    row[list(names).index(name)] += c
                else:
                    raise ValueError(f"unknown coefficient {name!r}")
                at = m.end()
                while at < len(side) and side[at] == " ":
                    at += 1
        trial = np.vstack([*rows, row])
        full = np.column_stack([trial, [*rhs, q]])
        if np.linalg.matrix_rank(trial) < len(trial):
            if np.linalg.matrix_rank(full) > np.linalg.matrix_rank(trial):
                raise ValueError("the constraints contradict each other")
            continue
        rows.append(row)
        rhs.append(q)
        labels.append(part.strip())
    return np.array(rows).reshape(-1, len(names)), np.array(rhs), labels


def nearest_psd(a: np.ndarray, rounds: int = 200, tol: float = 1e-12) -> np.ndarray:
    """The nearest positive semi-definite matrix, alternating projections with Dykstra's correction."""
    y, ds = (a + a.T) / 2, np.zeros_like(a)
    for _ in range(rounds):
        r = y - ds
        v, q = np.linalg.eigh((r + r.T) / 2)
        x = (q * np.maximum(v, 0)) @ q.T
        ds, before = x - r, y
        y = (x + x.T) / 2
        if np.abs(y - before).max() <= tol * max(1.0, np.abs(y).max()):
            break
    return y


def leverage(df: DataFrame, cols: Sequence[str], weight: str | None = None, name: str = "leverage") -> DataFrame:
    """x'(X'WX)^-1 x (times the weight) per row."""
    inv = np.linalg.inv(gram(df, cols, weight)[0])
    h = F.lit(0.0)
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            h = h + F.lit(float(inv[i, j])) * F.col(a).cast("double") * F.col(b).cast("double")
    return df.withColumn(name, h * F.col(weight) if weight else h)


def duplicate_columns(df: DataFrame, cols: Sequence[str]) -> list[str]:
    """Columns exactly equal to an earlier one."""
    pairs = [(i, j) for j in range(len(cols)) for i in range(j)]
    if not pairs:
        return []
    row = df.agg(*[F.bool_and(F.col(cols[i]).eqNullSafe(F.col(cols[j]))).alias(f"e{i}_{j}") for i, j in pairs]).first()
    return [c for j, c in enumerate(cols) if any(row[f"e{i}_{j}"] for i in range(j))]


def constant_columns(df: DataFrame, cols: Sequence[str], tol: float = 0.0) -> list[str]:
    row = df.agg(*[F.var_pop(c).alias(c) for c in cols]).first()
    return [c for c in cols if (row[c] or 0.0) <= tol]


def weighted_moments(df: DataFrame, col: str, weight: str) -> DataFrame:
    """(mean, var_unbiased as R's cov.wt, var_pweight as Stata's): one row."""
    x, w = F.col(col).cast("double"), F.col(weight).cast("double")
    s = df.agg(F.sum(w).alias("w"), F.sum(w * w).alias("w2"), F.sum(w * x).alias("wx"), F.count(F.lit(1)).alias("n"))
    both = df.crossJoin(F.broadcast(s))  # one row
    m = F.col("wx") / F.col("w")
    v = both.groupBy("w", "w2", "wx", "n").agg(F.sum(w * (x - m) * (x - m)).alias("ss"))
    return v.select((F.col("wx") / F.col("w")).alias("mean"), (F.col("ss") / (F.col("w") - F.col("w2") / F.col("w"))).alias("var_unbiased"),
                    (F.col("ss") / F.col("w") * F.col("n") / (F.col("n") - 1)).alias("var_pweight"))


def effective_f(z_pi: np.ndarray, qzz: np.ndarray, sigma: np.ndarray) -> float:
    """Montiel-Olea and Pflueger's F from first-stage coefficients, z'z / n and their covariance."""
    v, q = np.linalg.eigh(qzz)
    root = (q * np.sqrt(np.maximum(v, 0))) @ q.T
    p, s = root @ z_pi, root @ sigma @ root
    return float(p @ p / np.trace(s))
