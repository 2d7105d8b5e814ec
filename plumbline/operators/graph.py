"""Graphs as edge lists (src, dst, w): spatial lags, Moran's I, components."""

from __future__ import annotations

import tempfile

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage in the shared checkpoint folder; where none is set, and on one machine only, in one of our own."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or "file://" + tempfile.mkdtemp(prefix="plumbline-"))
    return df.checkpoint()


def normalised(edges: DataFrame, style: str = "W") -> DataFrame:
    """W: rows sum to one; B: binary; C: all weights sum to the number of sources; U: all sum to one; raw: as they are."""
    if style in ("raw", "none"):
        return edges.select("src", "dst", "w")
    e = edges.withColumn("w", F.lit(1.0)) if style == "B" else edges
    if style == "B":
        return e.select("src", "dst", "w")
    if style in ("W", "row"):
        return e.select("src", "dst", (F.col("w") / F.sum("w").over(Window.partitionBy("src"))).alias("w"))
    total = e.agg(F.sum("w").alias("s"), F.countDistinct("src").alias("n")).first()
    factor = {"C": total.n, "U": 1.0}[style] / total.s
    return e.select("src", "dst", (F.col("w") * F.lit(factor)).alias("w"))


def check_weights(edges: DataFrame) -> None:
    """No self-links, no negative weights, no repeated pairs."""
    bad = edges.agg(F.coalesce(F.max((F.col("src") == F.col("dst")).cast("int")), F.lit(0)).alias("own"), F.coalesce(F.min("w"), F.lit(0.0)).alias("least")).first()
    if bad.own:
        raise ValueError("the weights' diagonal must be zero")
    if bad.least < 0:
        raise ValueError("weights must not be negative")
    if not edges.groupBy("src", "dst").count().where("count > 1").isEmpty():
        raise ValueError("a pair has several weights")


def spatial_lag(df: DataFrame, edges: DataFrame, col: str, key: str = "id", by: list[str] | None = None, name: str | None = None) -> DataFrame:
    """Adds Sum_dst w(src, dst) * col(dst); missing neighbours count 0.  ``by``: columns (a period) to match too."""
    by = by or []
    other = df.select(F.col(key).alias("dst"), *by, F.col(col).alias("_v"))
    lag = edges.join(other, "dst").groupBy("src", *by).agg(F.sum(F.col("w") * F.col("_v")).alias(name or f"slag({col})"))
    out = df.join(lag.withColumnRenamed("src", key), [key, *by], "left")
    return out.fillna({name or f"slag({col})": 0.0})


def moran(df: DataFrame, edges: DataFrame, col: str, key: str = "id", by: list[str] | None = None) -> DataFrame:
    """(moran, n, s0): (n / S0) e'We / e'e; the values are not centred."""
    by = by or []
    lag = spatial_lag(df, edges, col, key, by, name="_lag")
    periods = df.select(*by).distinct().count() if by else 1
    s0 = edges.agg(F.sum("w").alias("s0"))
    sums = lag.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(col) * F.col("_lag")).alias("ewe"), F.sum(F.col(col) * F.col(col)).alias("ee"))
    both = sums.crossJoin(F.broadcast(s0)).withColumn("s0", F.col("s0") * periods)  # one row each
    return both.select((F.col("n") / F.col("s0") * F.col("ewe") / F.col("ee")).alias("moran"), "n", "s0")


def moran_permutation(df: DataFrame, edges: DataFrame, col: str, key: str = "id", n: int = 1999, seed: int = 0, level: float = 0.95) -> tuple[float, float, float]:
    """(I, lower, upper): the interval of I over hash permutations, by the (B + 1) rule.

    A permutation ranks ids by a hash of (draw, id) and gives the r-th id the r-th value; draws are dealt over tasks.
    """
    base = moran(df, edges, col, key).first()
    ranked = checkpointed(df.select(F.col(key).alias("id"), F.col(col).alias("v")).withColumn("r", F.row_number().over(Window.orderBy(key))))
    draws_ = ranked.select("id").withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    order = Window.partitionBy("b").orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("b"), F.col("id"))))
    mixed = draws_.withColumn("r", F.row_number().over(order)).join(ranked.select("r", "v"), "r")
    mixed = mixed.select("b", "id", "v")
    other = mixed.select("b", F.col("id").alias("dst"), F.col("v").alias("u"))
    own = mixed.select("b", F.col("id").alias("src"), "v")
    stat = edges.join(other, "dst").join(own, ["b", "src"]).groupBy("b").agg(F.sum(F.col("w") * F.col("u") * F.col("v")).alias("s"))
    s2 = df.agg(F.sum(F.col(col) * F.col(col))).first()[0]
    draws_i = sorted(base.n / base.s0 * r.s / s2 for r in stat.collect())  # one number a draw
    a = (1 - level) / 2
    k = int(np.floor(a * (len(draws_i) + 1)))
    return base.moran, draws_i[max(k, 1) - 1], draws_i[len(draws_i) - max(k, 1)]


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, component): the least node reachable, for every node that has an edge; ``edges`` is (src, dst)."""
    both = checkpointed(edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    label = checkpointed(both.groupBy("src").agg(F.min("dst").alias("m")).select(F.col("src").alias("node"), F.least("src", "m").alias("component")))
    for _ in range(rounds):
        near = both.join(label, both.dst == label.node).groupBy("src").agg(F.min("component").alias("m"))
        step = label.join(near, label.node == near.src).select("node", F.least("component", "m").alias("component"))
        hop = step.select(F.col("node").alias("component"), F.col("component").alias("further"))  # and the label of the label
        new = checkpointed(step.join(hop, "component").select("node", F.least("component", "further").alias("component")))
        moved = new.join(label.withColumnRenamed("component", "old"), "node").where("component <> old").isEmpty()
        label = new
        if moved:
            return label
    raise RuntimeError("components did not settle")


def radius_components(points: DataFrame, radius: float, key: str = "id", x: str = "x", y: str = "y", time: str | None = None, window: float | None = None) -> DataFrame:
    """(node, component) of the graph that links points within ``radius`` (and ``window`` of time); lone points are their own.

    Points meet in cells of which any two members are linked, so cells are what is joined up, by their least nodes.  Two cells
    at most two apart are linked if any pair of their points is; as one lies wholly on one side of the other, of the points in a
    row across only the nearest counts.  Pairs are never rows, and copies meet once.  Cells hold for coordinates below 2 ** 50 radii.
    """
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))
    cell = lambda c, size: F.floor(c / F.lit(size / 1.5)).cast("double") if size else c
    timed = bool(time) and window is not None
    p = points.select(F.col(key).alias("node"), F.col(x).cast("double").alias("px"), F.col(y).cast("double").alias("py"), (F.col(time).cast("double") if time else F.lit(0.0)).alias("pt"))
    cells = {"cx": cell(F.col("px"), radius), "cy": cell(F.col("py"), radius), "ct": cell(F.col("pt"), window) if timed else F.lit(0.0)}
    at = list(cells)
    ok = F.col("node").isNotNull() & finite(F.col("px")) & finite(F.col("py")) & (finite(F.col("pt")) if timed else F.lit(True))
    placed = p.where(ok).withColumns(cells)
    reps = checkpointed(placed.groupBy(*at).agg(F.min("node").alias("rep")))

    reach, later = (2 if radius else 0), (2 if timed and window else 0)
    steps = [(i, j, k) for i in range(-reach, reach + 1) for j in range(-reach, reach + 1) for k in range(-later, later + 1) if (i, j, k) > (0, 0, 0)]
    edges = placed.join(reps, at).groupBy("node").agg(F.min("rep").alias("src"), F.collect_set("rep").alias("dst")).where(F.size("dst") > 1)  # a node at several places
    edges = edges.select("src", F.explode("dst").alias("dst")).where("src <> dst")
    d2 = (F.col("px") - F.col("qx")) * (F.col("px") - F.col("qx")) + (F.col("py") - F.col("qy")) * (F.col("py") - F.col("qy"))
    for axis, own in (("px", [s for s in steps if s[0]]), ("py", [s for s in steps if not s[0] and s[1]]), ("pt", [s for s in steps if not s[0] and not s[1]])):
        if not own:
            continue
        across = [c for c in ("px", "py", "pt") if c != axis and (axis != "pt" or c == axis)]
        ends = placed.groupBy(*at, *across).agg(F.max(axis).alias("high"), F.min(axis).alias("low")).join(reps, at)
        one = {"px": F.lit(0.0), "py": F.lit(0.0)} | {c: F.col(c) for c in across}
        left = ends.select(*at, F.col("rep").alias("src"), *[c.alias(n) for n, c in (one | {"pt": one.get("pt", F.lit(0.0)), axis: F.col("high")}).items()])
        right = ends.select(*at, F.col("rep").alias("dst"), *[c.alias("q" + n[1]) for n, c in (one | {"pt": one.get("pt", F.lit(0.0)), axis: F.col("low")}).items()])
        right = right.withColumn("s", F.explode(F.array(*[F.array(*map(F.lit, map(float, s))) for s in own])))
        right = right.select("dst", "qx", "qy", "qt", *[(F.col(c) - F.col("s")[i]).alias(c) for i, c in enumerate(at)])
        near = d2 <= radius * radius
        if timed:
            near = near & (F.abs(F.col("pt") - F.col("qt")) <= window)
        edges = edges.unionByName(left.join(right, at).where(near & (F.col("src") != F.col("dst"))).select("src", "dst").distinct())
    found = components(edges.distinct()).select(F.col("node").alias("rep"), "component")
    found = reps.join(found, "rep", "left").select(*at, F.coalesce("component", "rep").alias("component"))
    found = placed.join(found, at).groupBy("node").agg(F.min("component").alias("component"))
    return p.select("node").join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
