"""Multipliers that depend on time or place, and the covariance helpers behind them.

Covariances live on distinct periods or places, which are few; rows look their multipliers up by a join.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.functions import draws as DR
from plumbline.functions import kernels as K
from plumbline.operators import graph

#: Distinct periods or places that the driver factorises at most.
LARGEST = 5_000


def time_kernel(df: DataFrame, time: str, bandwidth: float, kernel: str = "bartlett") -> DataFrame:
    """(s, t, k): kernel weight of each pair of distinct periods by the distance of their ranks; zero weights left out."""
    ranks = df.select(F.col(time).alias("t")).distinct().withColumn("r", F.row_number().over(Window.orderBy("t")))  # few periods
    reach = int(np.ceil(bandwidth)) if kernel != "qs" else LARGEST
    near = ranks.select(F.col("t").alias("s"), F.explode(F.sequence(F.col("r") - reach, F.col("r") + reach)).alias("r"), F.col("r").alias("q"))
    pairs = near.join(ranks, "r").withColumn("k", K.hac((F.col("q") - F.col("r")) / F.lit(float(bandwidth)), kernel))
    return pairs.where("k <> 0").select("s", "t", "k")


def space_kernel(points: DataFrame, bandwidth: float, kernel: str = "bartlett", key: str = "id", x: str = "x", y: str = "y", metric: str = "euclidean") -> DataFrame:
    """(a, b, k): kernel weight of each pair of places by distance over ``bandwidth``, which must be given.

    Kernels that end at 1 pair places of neighbouring cells only (planar distances); others need all pairs of the places.
    """
    if not bandwidth or bandwidth <= 0:
        raise ValueError("a spatial bandwidth must be given")
    p = points.select(F.col(key).alias("a"), F.col(x).cast("double").alias("ax"), F.col(y).cast("double").alias("ay"))
    q = p.select(F.col("a").alias("b"), F.col("ax").alias("bx"), F.col("ay").alias("by"))
    if metric == "haversine":
        d: Column = K.haversine(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"))
    else:
        d = F.sqrt((F.col("ax") - F.col("bx")) * (F.col("ax") - F.col("bx")) + (F.col("ay") - F.col("by")) * (F.col("ay") - F.col("by")))
    if metric == "euclidean" and kernel in ("bartlett", "parzen"):
        cell = lambda c: F.floor(F.col(c) / bandwidth)
        three = F.array(F.lit(-1), F.lit(0), F.lit(1))
        p = p.withColumn("cx", cell("ax")).withColumn("cy", cell("ay"))
        q = q.withColumn("dx", F.explode(three)).withColumn("dy", F.explode(three)).withColumn("cx", cell("bx") + F.col("dx")).withColumn("cy", cell("by") + F.col("dy")).drop("dx", "dy")
        pairs = p.join(q, ["cx", "cy"])
    else:
        if points.count() > LARGEST:
            raise ValueError(f"this kernel takes {LARGEST} places at most")
        pairs = p.crossJoin(F.broadcast(q))  # LARGEST places at most, and so counted
    return pairs.withColumn("k", K.hac(d / F.lit(float(bandwidth)), kernel)).where("k <> 0").select("a", "b", "k")


def _drawn(pairs: list, keys: list, n: int, seed: int, df: DataFrame, kind: str) -> DataFrame:
    """(key, b, w): columns of N(0, K) from hashed normals, K's negative directions cut off."""
    at = {k: i for i, k in enumerate(keys)}
    cov = np.zeros((len(keys), len(keys)))
    for a, b, v in pairs:
        cov[at[a], at[b]] = v
    v, q = np.linalg.eigh((cov + cov.T) / 2)
    root = (q * np.sqrt(np.maximum(v, 0))) @ q.T
    spark = df.sparkSession
    shocks = spark.createDataFrame([(i, [float(x) for x in root[:, i]]) for i in range(len(keys))], "i long, load array<double>")
    each = shocks.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("z", DR.multiplier("normal", seed, F.col("i"), F.col("b")))
    rows = each.select("b", "z", F.posexplode("load").alias("j", "l")).groupBy("b", "j").agg(F.sum(F.col("z") * F.col("l")).alias("w"))
    names = spark.createDataFrame(list(enumerate(keys)), f"j int, key {kind}")
    return rows.join(F.broadcast(names), "j").select("key", "b", "w")


def time_multipliers(df: DataFrame, time: str, n: int, bandwidth: float | None = None, kernel: str = "bartlett", method: str = "nw94", seed: int = 0) -> DataFrame:
    """(key: period, b, w): dependent wild multipliers; the bandwidth defaults to a rule in the number of periods."""
    keys = sorted(r[0] for r in df.select(time).distinct().limit(LARGEST + 1).collect())
    if len(keys) > LARGEST:
        raise ValueError(f"{LARGEST} periods at most")
    bandwidth = bandwidth or (K.bandwidth_nw94(len(keys), kernel) if method == "nw94" else K.bandwidth_andrews91(len(keys), kernel))
    pairs = [tuple(r) for r in time_kernel(df, time, max(bandwidth, 1.0), kernel).collect()]
    return _drawn(pairs, keys, n, seed, df, df.schema[time].dataType.simpleString())


def space_multipliers(points: DataFrame, n: int, bandwidth: float, kernel: str = "bartlett", key: str = "id", seed: int = 0, **kw) -> DataFrame:
    """(key: place, b, w): columns of N(0, K) over places."""
    keys = sorted(r[0] for r in points.select(key).distinct().limit(LARGEST + 1).collect())
    if len(keys) > LARGEST:
        raise ValueError(f"{LARGEST} places at most")
    pairs = [tuple(r) for r in space_kernel(points, bandwidth, kernel, key, **kw).collect()]
    return _drawn(pairs, keys, n, seed, points, points.schema[key].dataType.simpleString())


def space_cluster_multipliers(points: DataFrame, n: int, radius: float, dist: str = "rademacher", seed: int = 0, **kw) -> DataFrame:
    """(node, component, b, w): one multiplier for each component of the radius graph."""
    parts = graph.radius_components(points, radius, **kw)
    return parts.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("w", DR.multiplier(dist, seed, F.col("component"), F.col("b")))


def ar1_blocks(segments: list[list[int]], rho: float) -> list[np.ndarray]:
    """rho ** |t_i - t_j| of each segment's periods."""
    return [rho ** np.abs(np.subtract.outer(np.array(t, float), np.array(t, float))) for t in segments]


def sar_covariance(w: np.ndarray, rho: float) -> np.ndarray:
    """(I - rho W)^-1 (I - rho W')^-1; rho must lie inside the range where I - rho W stays regular."""
    v = np.linalg.eigvals(w)
    real = v[np.abs(v.imag) < 1e-10].real
    low, high = (1 / real.min() if real.min() < 0 else -np.inf), (1 / real.max() if real.max() > 0 else np.inf)
    if not low < rho < high:
        raise ValueError(f"rho must lie between {low:g} and {high:g}")
    a = np.linalg.inv(np.eye(len(w)) - rho * w)
    return a @ a.T


def factors(m: np.ndarray, rank: int | None = None, most: int = 8, ridge: float = 1e-8) -> tuple[int, np.ndarray, np.ndarray]:
    """(rank, period factors, unit loadings) of a balanced matrix, two-way demeaned; the rank by the IC1 criterion."""
    x = m - m.mean(0) - m.mean(1, keepdims=True) + m.mean()
    n, t = x.shape
    u, s, vt = np.linalg.svd(x, full_matrices=False)
    if rank is None:
        most = min(most, len(s) - 1)
        pen = (n + t) / (n * t) * np.log(n * t / (n + t))
        rest = [(s[r:] ** 2).sum() / (n * t) for r in range(most + 1)]
        rank = int(np.argmin([np.log(max(v, 1e-300)) + r * pen for r, v in enumerate(rest)]))
    f = vt[:rank].T * np.sqrt(t)
    loadings = np.linalg.solve(f.T @ f + ridge * np.eye(rank), f.T @ x.T).T if rank else np.zeros((n, 0))
    return rank, f, loadings


def recentred(df: DataFrame, score: list[str], bread: list[str], cluster: str) -> DataFrame:
    """Scores less their projection on each cluster's own regressors, by cluster sums: s_g - G_g (Sum G)^-1 Sum s.

    Returns one row a cluster; the sums of the recentred scores over clusters are zero.
    """
    k = len(bread)
    sums = [F.sum(F.col(a) * F.col(b)).alias(f"g{i}_{j}") for i, a in enumerate(bread) for j, b in enumerate(bread)]
    parts = graph.checkpointed(df.groupBy(cluster).agg(*[F.sum(c).alias(f"s{i}") for i, c in enumerate(score)], *sums))
    r = parts.agg(*[F.sum(c).alias(c) for c in parts.columns if c != cluster]).first()
    g = np.array([[r[f"g{i}_{j}"] for j in range(k)] for i in range(k)])
    lift = np.linalg.lstsq(g, np.array([r[f"s{i}"] for i in range(k)]), rcond=None)[0]
    return parts.select(cluster, *[(F.col(f"s{i}") - sum((F.col(f"g{i}_{j}") * F.lit(float(lift[j])) for j in range(k)), F.lit(0.0))).alias(score[i]) for i in range(k)])
