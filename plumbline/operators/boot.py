"""Bootstrap through sufficient statistics.

Estimators that are linear in the multipliers need only each cluster's score; draws are Sum_g w_gb * score_g.  Scores
are exploded over the draws, and partial sums leave one row a draw and task, so what is shuffled does not grow with the rows.
"""

from __future__ import annotations

import math
import warnings
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.functions import draws

#: Full grids are used up to so many clusters: by policy for signs, and for six points.
GRID = {"boottest": 11, "strict": 12}
GRID_WEBB = 4
#: Fixed value: the interquartile range of the standard normal.
NORMAL_IQR = 1.3489795003921634


@dataclass(frozen=True)
class Boot:
    """How to draw: number, distribution, seed, cluster columns (one way or several), policy."""

    n: int = 2000
    dist: str = "rademacher"
    seed: int = 0
    cluster: tuple[str, ...] = ()
    policy: str = "boottest"
    ssc: dict = field(default_factory=dict)
    enumerate: bool = True

    def __post_init__(self):
        if self.n < 2:
            raise ValueError("at least two draws are needed")
        if self.dist not in draws.NAMES:
            raise ValueError(f"unknown distribution {self.dist!r}")
        if isinstance(self.cluster, str):
            object.__setattr__(self, "cluster", (self.cluster,))


def ssc_factor(n: int, k: int, groups: list[int] | None = None, adj: bool = True, cluster_adj: bool = True, g_df: str = "min") -> float:
    """sqrt(f_n * f_g): f_n = (n - 1) / (n - k); f_g = G / (G - 1), of the smallest G if there are several ways."""
    f_n = (n - 1) / (n - k) if adj else 1.0
    if not groups or not cluster_adj:
        return math.sqrt(f_n)
    if g_df == "min":
        g = min(groups)
        return math.sqrt(f_n * g / (g - 1))
    return math.sqrt(f_n * float(np.mean([g / (g - 1) for g in groups])))


def grid_size(groups: int, boot: Boot) -> int | None:
    """How many draws the full grid has, if it is to be used."""
    if not boot.enumerate:
        return None
    if boot.dist == "rademacher" and groups <= GRID.get(boot.policy, 11) and 2**groups <= boot.n:
        return 2**groups
    if boot.dist == "webb" and groups <= GRID_WEBB and 6**groups <= boot.n:
        return 6**groups
    return None


def scores(df: DataFrame, cols: list[str], cluster: tuple[str, ...], names: list[str] | None = None) -> DataFrame:
    """(key..., one sum a column): a row per cluster, or per combination of clusters if there are several ways."""
    return df.groupBy(*cluster).agg(*[F.sum(c).alias(n) for c, n in zip(cols, names or cols)])


def _grid(parts: DataFrame, boot: Boot) -> tuple[str, int | None]:
    """(distribution, draws of the full grid if it is to be used) for the clusters that ``parts`` holds."""
    keys, dist, n = list(boot.cluster), boot.dist, None
    if len(keys) == 1 and dist in ("rademacher", "webb") and boot.enumerate:
        limit = max(GRID.get(boot.policy, 11), GRID_WEBB) + 1
        few = parts.select(keys[0]).distinct().limit(limit).count()
        if dist == "webb" and few < 6:
            warnings.warn("webb needs six clusters or more; rademacher is used", stacklevel=2)
            dist = "rademacher"
        n = grid_size(few, Boot(boot.n, dist, boot.seed, boot.cluster, boot.policy)) if few < limit else None
    return dist, n


def each_draw(parts: DataFrame, name: str, boot: Boot) -> tuple[DataFrame, int]:
    """(``parts`` with an array of its cluster's multipliers, one a draw; number of draws); one cluster column."""
    dist, n = _grid(parts, boot)
    key = boot.cluster[0]
    if n is not None:
        order = parts.select(key).distinct().select(key, (F.row_number().over(Window.orderBy(key)) - 1).alias("_j"))  # few clusters
        grid = draws.enumerated if dist == "rademacher" else draws.enumerated_webb
        out = parts.join(F.broadcast(order), key)
        return out.withColumn(name, F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda b: grid(b, F.col("_j")))).drop("_j"), n
    return parts.withColumn(name, F.transform(F.sequence(F.lit(0), F.lit(boot.n - 1)), lambda b: draws.multiplier(dist, boot.seed, F.col(key), b))), boot.n


def draw_sums(parts: DataFrame, cols: list[str], boot: Boot) -> DataFrame:
    """(b, one column each): Sum over rows of weight(b, row's clusters) * column; a draw per b."""
    keys = list(boot.cluster)
    dist, n = _grid(parts, boot)
    if n is not None:
        order = parts.select(keys[0]).distinct().select(keys[0], (F.row_number().over(Window.orderBy(keys[0])) - 1).alias("_j"))  # few clusters
        parts = parts.join(F.broadcast(order), keys[0])
        each = parts.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
        w = draws.enumerated(F.col("b"), F.col("_j")) if dist == "rademacher" else draws.enumerated_webb(F.col("b"), F.col("_j"))
    else:
        each = parts.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(boot.n - 1))))
        w = F.lit(1.0)
        for i, key in enumerate(keys):
            w = w * draws.multiplier(dist, boot.seed + i, F.col(key), F.col("b"))
    return each.withColumn("_w", w).groupBy("b").agg(*[F.sum(F.col("_w") * F.col(c)).alias(c) for c in cols])


def standard_errors(sums: DataFrame, cols: list[str]) -> dict[str, float]:
    row = sums.agg(*[F.stddev_samp(c).alias(c) for c in cols]).first()
    return {c: row[c] for c in cols}


def bplus1_quantile(values, alpha: float) -> float:
    """The ceil((1 - alpha)(B + 1))-th order statistic."""
    x = np.sort(np.asarray(values, float))
    k = math.ceil((1 - alpha) * (len(x) + 1) - 1e-9)
    return float(x[min(max(k, 1), len(x)) - 1])


def type1_quantile(values, p: float) -> float:
    x = np.sort(np.asarray(values, float))
    return float(x[max(0, math.ceil(p * len(x) - 1e-12) - 1)])


def sup_t(sums: DataFrame, cols: list[str], estimates: dict[str, float], level: float = 0.95, scale: str = "sd") -> tuple[float, dict[str, tuple[float, float, float]]]:
    """(critical value, name -> (se, lower, upper)): draws are deviations from the estimates.

    A coordinate without spread gets half-width 0 and does not enter the maximum.
    """
    if scale == "iqr":
        at = lambda p, c: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY `{c}`)")  # noqa: E731  (type 1: an order statistic)
        row = sums.agg(*[((at(0.75, c) - at(0.25, c)) / NORMAL_IQR).alias(c) for c in cols]).first()
        se = {c: row[c] for c in cols}
    else:
        se = standard_errors(sums, cols)
    live = [c for c in cols if se[c] and se[c] > 0]
    if not live:
        return 0.0, {c: (0.0, estimates[c], estimates[c]) for c in cols}
    most = F.greatest(*[F.abs(F.col(c) / F.lit(se[c])) for c in live], F.lit(0.0))
    t = [r.t for r in sums.select(most.alias("t")).collect()]  # one number a draw
    crit = bplus1_quantile(t, 1 - level)
    out = {}
    for c in cols:
        half = crit * se[c] if c in live else 0.0
        out[c] = (se[c] or 0.0, estimates[c] - half, estimates[c] + half)
    return crit, out


def wald(sums: np.ndarray, beta: np.ndarray, r: np.ndarray, q: np.ndarray, centred: bool = True, strict: bool = False) -> tuple[float, np.ndarray]:
    """(statistic, its draws) for r beta = q from draws of beta's deviation (B x k); no p-value is made of it."""
    d = sums @ r.T
    gap = r @ beta - q
    dev = d - d.mean(0)
    cov = dev.T @ dev / (len(d) if strict else len(d) - 1)
    inv = np.linalg.pinv(cov)
    use = d if centred else d + gap
    return float(gap @ inv @ gap), np.einsum("bi,ij,bj->b", use, inv, use)
