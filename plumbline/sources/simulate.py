"""Simulated panels and cross-sections, drawn by hash: the same whatever the partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.draws import multiplier, uniform


def normal(seed: int, *keys: Column, name: str) -> Column:
    return multiplier("normal", seed, F.concat_ws("/", *[k.cast("string") for k in keys]), F.lit(name))


def _cross(spark: SparkSession, n: int, seed: int, k: int) -> DataFrame:
    d = spark.range(n).select(F.col("id").cast("int").alias("id"))
    return d.withColumns({f"x{i}": normal(seed, F.col("id"), name=f"x{i}") for i in range(k)}).withColumn("e", normal(seed, F.col("id"), name="e"))


def ols(spark, n: int = 200, seed: int = 42) -> DataFrame:
    return _cross(spark, n, seed, 3).withColumn("y", F.col("x0") - 0.5 * F.col("x1") + 0.2 * F.col("x2") + F.col("e"))


def iv(spark, n: int = 100, seed: int = 123) -> DataFrame:
    d = spark.range(n).select(F.col("id"))
    d = d.withColumns({c: normal(seed, F.col("id"), name=c) for c in ("z1", "z2", "x_exog", "v", "e")}).withColumn("u", 0.5 * F.col("v") + F.col("e"))
    d = d.withColumn("x_endog", 0.8 * F.col("z1") + 0.6 * F.col("z2") + 0.5 * F.col("x_exog") + 0.5 * F.col("v"))
    return d.withColumn("y", 2 * F.col("x_endog") + 3 * F.col("x_exog") + F.col("u"))


def gls(spark, n: int = 100, seed: int = 321, rho: float = 0.5) -> DataFrame:
    """AR(1) errors, as a truncated moving sum of shocks."""
    d = spark.range(n).select(F.lit(0).alias("s"), F.col("id").cast("int").alias("t"))
    d = d.withColumns({f"x{i}": normal(seed, F.col("t"), name=f"x{i}") for i in range(3)})
    u = sum((rho**k * normal(seed, F.col("t") - k, name="e") for k in range(30)), F.lit(0.0))
    return d.withColumn("y", F.col("x0") + 2 * F.col("x1") + 3 * F.col("x2") + u)


def qr(spark, n: int = 200, seed: int = 42) -> DataFrame:
    d = _cross(spark, n, seed, 3).withColumn("cluster", F.col("id") % 20)
    return d.withColumn("y", 1 + F.col("x0") + 2 * F.col("x1") + 3 * F.col("x2") + 0.5 * F.col("e"))


def ring(spark, n: int) -> DataFrame:
    d = spark.range(n).select(F.col("id").cast("int").alias("src"))
    return d.select("src", F.explode(F.array((F.col("src") + 1) % n, (F.col("src") + n - 1) % n)).alias("dst"), F.lit(0.5).alias("w"))


def sar(spark, n: int = 150, seed: int = 4, rho: float = 0.3) -> tuple[DataFrame, DataFrame]:
    """(frame, ring edges): y = (I - rho W)^-1 (X beta + u), as a truncated power series over the ring."""
    d = _cross(spark, n, seed, 2).withColumn("m", F.col("x0") + 2 * F.col("x1") + F.col("e"))
    edges = ring(spark, n)
    # (rho W)^k spreads weight rho^k binom(k, j) / 2^k to the node k - 2j steps away.
    weights: dict[int, float] = {0: 1.0}
    total = dict(weights)
    for _ in range(25):
        step: dict[int, float] = {}
        for o, w in weights.items():
            for s in (-1, 1):
                step[o + s] = step.get(o + s, 0.0) + rho * w / 2
        weights = step
        for o, w in step.items():
            total[o] = total.get(o, 0.0) + w
    spread = d.select(((F.col("id")).alias("from")), "m").withColumn("p", F.explode(F.array(*[F.struct(F.lit(o).alias("o"), F.lit(w).alias("w")) for o, w in total.items()])))
    y = spread.groupBy(F.pmod(F.col("from") + F.col("p.o"), F.lit(n)).cast("int").alias("id")).agg(F.sum(F.col("m") * F.col("p.w")).alias("y"))
    return d.join(y, "id"), edges


def panel(spark, units: int, periods: int, seed: int, effect: float, cohorts: list[int], never: float = 0.2, noise: float = 1.0) -> DataFrame:
    """(id, time, g, treat, y): unit and period effects, a constant effect from the cohort's period on."""
    u = spark.range(units).select(F.col("id").cast("int").alias("id"))
    pick = F.element_at(F.array(*[F.lit(c) for c in cohorts]), (F.floor(uniform(seed, F.col("id"), F.lit("g")) * len(cohorts)) + 1).cast("int"))
    u = u.withColumn("g", F.when(uniform(seed, F.col("id"), F.lit("never")) < never, 0).otherwise(pick)).withColumn("a", normal(seed, F.col("id"), name="a"))
    d = u.withColumn("time", F.explode(F.sequence(F.lit(0), F.lit(periods - 1))))
    d = d.withColumn("treat", ((F.col("g") > 0) & (F.col("time") >= F.col("g"))).cast("int"))
    return d.withColumn("y", F.col("a") + 0.1 * F.col("time") + effect * F.col("treat") + noise * normal(seed, F.col("id"), F.col("time"), name="e")).drop("a")


def cs(spark) -> DataFrame:
    return panel(spark, 100, 10, 101, 2.0, list(range(2, 10)))


def ddd(spark) -> DataFrame:
    """The effect is in group A only."""
    d = panel(spark, 100, 10, 202, 0.0, list(range(2, 10))).withColumn("group", F.when(F.col("id") % 2 == 0, "A").otherwise("B"))
    return d.withColumn("y", F.col("y") + 3.0 * F.col("treat") * (F.col("group") == "A").cast("double"))


def dr(spark) -> DataFrame:
    return panel(spark, 100, 10, 303, 2.5, [5]).withColumn("x", normal(303, F.col("id"), name="x"))


def sdid(spark) -> DataFrame:
    return _one_treated(panel(spark, 50, 10, 202, 0.0, [5], never=1.1, noise=0.5), 5, 3.0)


def sc(spark) -> DataFrame:
    return _one_treated(panel(spark, 30, 15, 303, 0.0, [10], never=1.1, noise=0.5), 10, 4.0)


def _one_treated(d: DataFrame, start: int, effect: float) -> DataFrame:
    own = F.col("id") == 0
    d = d.withColumn("g", F.when(own, start).otherwise(0)).withColumn("treat", (own & (F.col("time") >= start)).cast("int"))
    return d.withColumn("y", F.col("y") + effect * F.col("treat"))


def spatial_did(spark) -> tuple[DataFrame, DataFrame]:
    d = panel(spark, 40, 10, 123, 0.0, [5], never=1.1, noise=0.5)
    own = F.col("id") % 8 == 0
    d = d.withColumn("g", F.when(own, 5).otherwise(0)).withColumn("treat", (own & (F.col("time") >= 5)).cast("int"))
    return d.withColumn("y", F.col("y") + 2.5 * F.col("treat")), ring(spark, 40)
