"""Fixed effects: singletons, demeaning, degrees of freedom, recovery."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.graph import checkpointed, components


def interact(df: DataFrame, terms: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Adds a struct column for each ``a:b`` term; returns the key columns."""
    keys = []
    for t in terms:
        if ":" in t:
            df = df.withColumn(f"_fe_{t.replace(':', '_x_')}", F.struct(*t.split(":")))
            keys.append(f"_fe_{t.replace(':', '_x_')}")
        else:
            keys.append(t)
    return df, keys


def drop_missing(df: DataFrame, fes: Sequence[str]) -> tuple[DataFrame, int]:
    """Rows with all ids, and how many were dropped."""
    ok = F.lit(True)
    for f in fes:
        ok = ok & F.col(f).isNotNull()
    return df.where(ok), df.where(~ok).count()


#: Level tables of up to so many rows are broadcast.
FEW_LEVELS = 100_000


def _side(levels: DataFrame) -> DataFrame:
    """A table of levels as a join side: counted, then broadcast if small; a hot level's rows are not moved then, else split by the merge join."""
    levels = checkpointed(levels)
    return F.broadcast(levels) if levels.count() <= FEW_LEVELS else levels.hint("merge")


def drop_singletons(df: DataFrame, fes: Sequence[str], rounds: int = 1000) -> tuple[DataFrame, int]:
    """Drops rows alone in a group of any dimension, again and again; (rows left, number dropped)."""
    before = first = df.count()
    for _ in range(rounds):
        for f in fes:
            df = df.join(_side(df.groupBy(f).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(f)), f, "left_semi")
        df = checkpointed(df)
        now = df.count()
        if now == before:
            return df, first - now
        before = now
    raise RuntimeError("singletons did not settle")


def drop_weightless(df: DataFrame, weight: str, fes: Sequence[str], rounds: int = 1000) -> tuple[DataFrame, int]:
    """Drops rows of groups whose weights add up to nothing, in any dimension, again and again; (rows left, number dropped)."""
    before = first = df.count()
    for _ in range(rounds):
        for f in fes:
            df = df.join(_side(df.groupBy(f).agg(F.sum(weight).alias("_w")).where("_w > 0").select(f)), f, "left_semi")
        df = checkpointed(df)
        now = df.count()
        if now == before:
            return df, first - now
        before = now
    raise RuntimeError("weightless groups did not settle")


def demean(df: DataFrame, cols: Sequence[str], fes: Sequence[str], weight: str | None = None, tol: float = 1e-8, rounds: int = 16000, suffix: str = "") -> DataFrame:
    """Subtracts group means of every dimension (alternating projections).

    Means are partial aggregates, joined back to the rows.  One dimension is exact at once.  With several, each sweep demeans by all dimensions in turn and ends when the
    largest group mean is within ``tol``; rows are checkpointed every few sweeps, so lineage stays short.
    """
    cols, fes = list(cols), list(fes)
    out = df.withColumns({c + suffix: F.col(c).cast("double") for c in cols})
    cols = [c + suffix for c in cols]

    def once(d: DataFrame, f: str) -> DataFrame:
        mean = (lambda c: F.sum(F.col(c) * F.col(weight)) / F.sum(weight)) if weight else F.avg
        means = _side(d.groupBy(f).agg(*[mean(c).alias(f"_mean_{i}") for i, c in enumerate(cols)]))  # partial sums, a row a level
        return d.join(means, f).withColumns({c: F.col(c) - F.col(f"_mean_{i}") for i, c in enumerate(cols)}).drop(*[f"_mean_{i}" for i in range(len(cols))])

    if len(fes) == 1:
        return checkpointed(once(out, fes[0]))
    order = sorted(fes, key=lambda f: -df.select(f).distinct().count())
    for sweep in range(rounds):
        for f in order:
            out = once(out, f)
        out = checkpointed(out)
        worst = 0.0
        for f in order[:-1]:
            sums = out.groupBy(f).agg(*[(F.sum(F.col(c) * F.col(weight)) / F.sum(weight) if weight else F.avg(c)).alias(c) for c in cols])
            worst = max(worst, *[x or 0.0 for x in sums.agg(*[F.max(F.abs(F.col(c))) for c in cols]).first()])
        if worst <= tol:
            return out
    raise RuntimeError(f"demeaning did not converge: the largest group mean is {worst:g}")


def two_way_demean(df: DataFrame, col: str, unit: str, time: str, name: str) -> DataFrame:
    """x - unit mean - time mean + mean: exact for balanced panels, in one pass."""
    every = df.agg(F.avg(col)).first()[0]
    out = df
    for i, f in enumerate((unit, time)):
        out = out.join(_side(df.groupBy(f).agg(F.avg(col).alias(f"_m{i}"))), f)
    return out.withColumn(name, F.col(col) - F.col("_m0") - F.col("_m1") + F.lit(every)).drop("_m0", "_m1")


def nested(df: DataFrame, inner: str, outer: str) -> bool:
    """Whether every level of ``inner`` lies in one level of ``outer``."""
    return df.where(F.col(inner).isNotNull() & F.col(outer).isNotNull()).groupBy(inner).agg(F.countDistinct(outer).alias("n")).where("n > 1").isEmpty()


def prune_nested(df: DataFrame, fes: Sequence[str]) -> list[str]:
    """Drops dimensions that a finer one contains; of equal ones the first stays."""
    kept = list(fes)
    for f in list(fes):
        for g in kept:
            if f != g and f in kept and nested(df, g, f) and not (nested(df, f, g) and kept.index(f) < kept.index(g)):
                kept.remove(f)
    return kept


def degrees_of_freedom(df: DataFrame, fes: Sequence[str], cluster: Sequence[str] = (), intercept: bool = True) -> dict[str, tuple[int, int]]:
    """dimension -> (levels, redundant): first: 1 with an intercept; second: components of the bipartite graph; later ones: the
    most over pairs with an earlier dimension; a dimension nested in a cluster is wholly redundant."""
    out: dict[str, tuple[int, int]] = {}
    for i, f in enumerate(fes):
        levels = df.agg(F.countDistinct(f)).first()[0]
        if any(f == c or nested(df, f, c) for c in cluster):
            out[f] = (levels, levels)
        elif i == 0:
            out[f] = (levels, 1 if intercept else 0)
        else:
            out[f] = (levels, max(_bipartite(df, g, f) for g in fes[:i]))
    return out


def _bipartite(df: DataFrame, a: str, b: str) -> int:
    name = lambda side, c: F.concat(F.lit(side), F.to_json(F.struct(F.col(c).alias("v"))))
    edges = df.select(name("a", a).alias("src"), name("b", b).alias("dst")).distinct()
    return components(edges).select("component").distinct().count()


def absorbed(dof: dict[str, tuple[int, int]]) -> int:
    return sum(levels - redundant for levels, redundant in dof.values())


def recover(df: DataFrame, residual: str, fes: Sequence[str], tol: float = 1e-10, rounds: int = 10000) -> dict[str, DataFrame]:
    """Effects per level of y - xb (column ``residual``): alternating group means, each later dimension summing to zero.

    Effects live in level tables (one row a level); rows only look them up.
    """
    tables = {f: checkpointed(df.groupBy(f).agg(F.lit(0.0).alias("effect"))) for f in fes}
    for _ in range(rounds):
        worst = 0.0
        for f in fes:
            rest = df.withColumn("_r", F.col(residual))
            for g in fes:
                if g != f:
                    rest = rest.join(tables[g].withColumnRenamed("effect", f"_e_{g}"), g).withColumn("_r", F.col("_r") - F.col(f"_e_{g}"))
            new = checkpointed(rest.groupBy(f).agg(F.avg("_r").alias("effect")))
            gap = new.join(tables[f].withColumnRenamed("effect", "old"), f).agg(F.max(F.abs(F.col("effect") - F.col("old")))).first()[0]
            tables[f], worst = new, max(worst, gap or 0.0)
        if worst <= tol or len(fes) == 1:
            break
    else:
        raise RuntimeError("effects did not converge")
    for f in fes[1:]:
        shift = tables[f].agg(F.avg("effect")).first()[0]
        tables[f] = tables[f].withColumn("effect", F.col("effect") - F.lit(shift))
        tables[fes[0]] = tables[fes[0]].withColumn("effect", F.col("effect") + F.lit(shift))
    return tables


