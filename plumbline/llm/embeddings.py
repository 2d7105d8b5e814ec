"""Embedding near-dedup by an epsilon grid order join.

Unit vectors at cosine c are sqrt(2 - 2c) apart.  Distinct vectors are projected on their leading principal directions,
put in cells of that width, and sorted by cells.  The sorted sequence of each label is cut into blocks, and blocks into
a tree of intervals; pairs of intervals are split again level by level, dropping those whose boxes are provably farther
apart than epsilon.  Only the block pairs that remain are compared, exactly and in double precision, a tile of neighbouring
pairs at a time, to which each of its blocks travels once.  A tile returns link counts per vector and a spanning forest of its links, so dense groups never become lists of all pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common as C

COSINE = 0.93
DIRECTIONS = 6
BLOCK = 256
FAN = 8
_SLACK = 1e-6


def _usable(vec):
    """Null, empty, zero vectors and those with null or non-finite components link with nothing."""
    d = F.transform(vec, lambda x: x.cast("double"))
    finite = F.forall(d, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(math.inf)))
    return vec.isNotNull() & F.coalesce(finite, F.lit(False)) & F.coalesce(F.exists(d, lambda x: x != 0), F.lit(False))


def _matrix(col) -> np.ndarray:
    """A list<double> Arrow column of equal lengths as unit rows."""
    return _unit(np.asarray(col.flatten(), np.float64).reshape(len(col), -1))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # no overflow or underflow of the squares
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _directions(reps: DataFrame, dim: int, k: int) -> np.ndarray:
    """The k leading principal directions: one dim x dim sum per partition, added on the driver."""

    def run(batches):
        total = np.zeros(1 + dim + dim * dim)
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column(0))
                total += np.concatenate([[len(x)], x.sum(0), (x.T @ x).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["pos", "v"])

    sums = reps.where(F.col("dim") == dim).select("vec").mapInArrow(run, "pos long, v double")
    total = np.zeros(1 + dim + dim * dim)
    for r in sums.groupBy("pos").agg(F.sum("v").alias("v")).collect():
        total[r.pos] = r.v
    n, mean, g = total[0], total[1 : 1 + dim] / total[0], total[1 + dim :].reshape(dim, dim)
    g = g / n - np.outer(mean, mean)
    return np.linalg.eigh(g)[1][:, ::-1][:, : min(k, dim)]


def _blocks(reps: DataFrame, axes: dict[int, np.ndarray], eps: float, block: int) -> DataFrame:
    """Sorted blocks: (label, dim, block, low, high, ids, vecs)."""
    k = max(a.shape[1] for a in axes.values())

    def project(batches):
        for b in batches:
            for dim in np.unique(b.column(1).to_numpy()).tolist():
                part = pa.Table.from_batches([b]).filter(pa.array(b.column(1).to_numpy() == dim)).combine_chunks()
                p = _matrix(part.column(3).combine_chunks()) @ axes[dim]
                p = np.pad(p, ((0, 0), (0, k - p.shape[1])))
                cells = np.floor(p / eps).astype(np.int32)
                cols = [part.column(i).combine_chunks() for i in range(5)] + [pa.array(list(cells), pa.list_(pa.int32())), pa.array(list(p), pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays(cols, ["label", "dim", "rep", "vec", "n", "cells", "at"])

    placed = reps.select("label", "dim", "rep", "vec", "n").mapInArrow(project, "label long, dim int, rep long, vec array<double>, n long, cells array<int>, at array<double>")
    order = ["label", "dim", "cells", "rep"]
    ordered = placed.repartitionByRange(C.parallelism(reps.sparkSession), *order).sortWithinPartitions(*order)
    ordered = ordered.withColumn("part", F.spark_partition_id())

    def pack(batches):
        held, key, n, part = [], None, 0, 0

        def out():
            nonlocal n
            at = np.array([h[1] for h in held])
            n += 1
            return {"label": key[0], "dim": key[1], "block": (part << 32) + n, "low": at.min(0).tolist(), "high": at.max(0).tolist(),
                    "ids": np.array([h[0] for h in held], np.int64).tobytes(), "ns": np.array([h[3] for h in held], np.int64).tobytes(), "vecs": np.array([h[2] for h in held], np.float64).tobytes()}

        for b in batches:
            rows = []
            at, vecs = b.column(6), b.column(3)
            for i, (lab, dim, rep, copies, part) in enumerate(zip(*(b.column(j).to_pylist() for j in (0, 1, 2, 4, 7)))):
                if held and (key != (lab, dim) or len(held) >= block):
                    rows.append(out())
                    held = []
                key = (lab, dim)
                held.append((rep, np.asarray(at[i].values), np.asarray(vecs[i].values), copies))
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)
        if held:
            yield pa.RecordBatch.from_pylist([out()], schema)

    f = pa.list_(pa.float64())
    schema = pa.schema([("label", pa.int64()), ("dim", pa.int32()), ("block", pa.int64()), ("low", f), ("high", f), ("ids", pa.binary()), ("ns", pa.binary()), ("vecs", pa.binary())])
    return C.stored(ordered.mapInArrow(pack, "label long, dim int, block long, low array<double>, high array<double>, ids binary, ns binary, vecs binary"), "blocks")


def _near(eps: float):
    gap = F.zip_with(F.zip_with("low", "high2", lambda a, b: a - b), F.zip_with("low2", "high", lambda a, b: a - b), lambda a, b: F.greatest(a, b, F.lit(0.0)))
    return F.aggregate(gap, F.lit(0.0), lambda s, g: s + g * g) <= (eps + _SLACK) ** 2


def _block_pairs(leaf: DataFrame, eps: float, fan: int) -> DataFrame:
    """Pairs of leaves (one, two), one <= two, that are not provably distant: interval pairs, split level by level."""
    tree = [leaf.drop("block")]
    top = leaf.groupBy("label", "dim").agg(F.min("node").alias("first"), F.count(F.lit(1)).alias("n"))
    most = top.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    k = len(leaf.select("low").first()[0])
    box = [F.array(*[F.min(F.element_at("low", i + 1)) for i in range(k)]).alias("low"), F.array(*[F.max(F.element_at("high", i + 1)) for i in range(k)]).alias("high")]
    while most > 1:
        up = tree[-1].withColumn("node", F.floor(F.col("node") / fan)).groupBy("label", "dim", "node").agg(*box)
        tree.append(C.cut(up))
        most = tree[-1].groupBy("label", "dim").count().agg(F.max("count")).first()[0]
    root = tree[-1]
    pairs = root.select("label", "dim", F.col("node").alias("one"), F.col("node").alias("two"))
    for level in reversed(tree[:-1]):
        up = F.floor(F.col("node") / fan)
        a = level.select("label", "dim", up.alias("one"), F.col("node").alias("a"), "low", "high")
        b = level.select("label", "dim", up.alias("two"), F.col("node").alias("b"), F.col("low").alias("low2"), F.col("high").alias("high2"))
        split = pairs.join(a, ["label", "dim", "one"]).join(b, ["label", "dim", "two"])
        pairs = C.cut(split.where((F.col("a") <= F.col("b")) & _near(eps)).select("label", "dim", F.col("a").alias("one"), F.col("b").alias("two")))
    return pairs.select("one", "two")


def _compare(cosine: float):
    """A tile's blocks and block pairs -> (a, null, links of a found here) and (a, b, 0) for a spanning forest of the links."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])

    def run(blocks: pa.Table, pairs: pa.Table) -> pa.Table:
        held = {}
        for node, dim, ids, ns, vecs in zip(*(blocks[c].to_pylist() for c in ("node", "dim", "ids", "ns", "vecs"))):
            held[node] = np.frombuffer(ids, np.int64), np.frombuffer(ns, np.int64), _unit(np.frombuffer(vecs).reshape(-1, dim))
        root: dict[int, int] = {}
        near: dict[int, int] = {}
        edges = []
        for one, two in zip(pairs["one"].to_pylist(), pairs["two"].to_pylist()):
            (ix, nx, ux), (iy, ny, uy) = held[one], held[two]
            hit = ux @ uy.T >= cosine
            if one == two:
                hit = np.triu(hit, 1)
            r, c = np.nonzero(hit)
            if not len(r):
                continue
            for who, n in ((ix, hit @ ny), (iy, nx @ hit)):
                for i in np.flatnonzero(n).tolist():
                    near[int(who[i])] = near.get(int(who[i]), 0) + int(n[i])
            edges.append(_forest(ix[r].tolist(), iy[c].tolist(), root))
        found = np.concatenate([np.zeros((0, 2), np.int64), *edges])
        n = np.concatenate([np.fromiter(near.values(), np.int64, len(near)), np.zeros(len(found), np.int64)])
        a = np.concatenate([np.fromiter(near, np.int64, len(near)), found[:, 0]])
        b = np.concatenate([np.zeros(len(near), np.int64), found[:, 1]])
        return pa.Table.from_arrays([pa.array(a), pa.array(b, mask=n > 0), pa.array(n)], schema=schema)

    return run


def _forest(a: list[int], b: list[int], root: dict[int, int] | None = None) -> np.ndarray:
    """The links that join up two parts; ``root`` keeps the parts."""
    root, out = {} if root is None else root, []

    def find(i):
        while (up := root.get(i, i)) != i:
            root[i] = root.get(up, up)
            i = up
        return i

    for p, q in zip(a, b):
        s, t = find(p), find(q)
        if s != t:
            root[max(s, t)] = min(s, t)
            out.append((p, q))
    return np.array(out, np.int64).reshape(-1, 2)


def group(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", cosine: float = COSINE,
          directions: int = DIRECTIONS, block: int = BLOCK, fan: int = FAN) -> DataFrame:
    """One row per vector: (vec_id, n_links, component_id, kept).

    Only vectors of equal non-null label and equal length are compared; labels may have any type that can be grouped.  Unusable
    vectors (null, empty, zero, null or non-finite components) have no links and are their own component; so have vectors
    without a label.  Equal vectors are compared once and counted by their number.  A cosine that rounds to the bound in double
    precision counts as reaching it.  Null ids are never a component_id unless a component has no other.  Empty table: no rows.
    Extra columns are not read.  Vectors are short next to texts: a tile holds ``2 * fan`` blocks of ``block`` of them.
    """
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vec_col).alias("raw"), F.col(label_col).alias("label"))
    rows = rows.withColumn("ok", _usable(F.col("raw")) & F.col("label").isNotNull())
    classes = rows.where("ok").groupBy("label", "raw").agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("first"))
    classes = C.stored(classes, "classes").withColumn("rep", F.monotonically_increasing_id())
    labels = C.stored(classes.select(F.col("label").alias("_of")).distinct(), "labels").withColumn("_label", F.monotonically_increasing_id())
    classes = classes.join(C.sized(labels), F.col("label") == F.col("_of"))
    reps = C.stored(classes.select("rep", "label", "_label", "n", "first", "raw", F.size("raw").alias("dim"), F.transform("raw", lambda x: x.cast("double")).alias("vec")), "reps")
    eps = math.sqrt(max(0.0, 2 - 2 * cosine))
    dims = [r.dim for r in reps.select("dim").distinct().collect()]
    if dims:
        numbered = reps.select(F.col("_label").alias("label"), "dim", "rep", "vec", "n")
        axes = {d: _directions(reps, d, directions) for d in dims}
        blocks = _blocks(numbered, axes, eps, block)
        leaf = C.bounded_rank(blocks.select("label", "dim", "block", "low", "high"), ["label", "dim", "block"], rank="node")
        leaf = C.cut(leaf.select("label", "dim", "node", "low", "high", "block"))
        tile = F.struct(*[F.floor(F.col(c) / fan).alias(c) for c in ("one", "two")]).alias("tile")
        pairs = C.cut(_block_pairs(leaf, eps, fan).select(tile, "one", "two"))
        needed = pairs.select(F.col("tile").alias("place"), F.explode(F.array("one", "two")).alias("node")).distinct()
        held = blocks.select("block", "dim", "ids", "ns", "vecs").join(C.sized(leaf.select("node", "block")), "block").drop("block")
        sent = needed.hint("merge").join(held.hint("merge"), "node").select("place", "node", "dim", "ids", "ns", "vecs")
        found = sent.groupBy("place").cogroup(pairs.groupBy("tile")).applyInArrow(_compare(cosine), "a long, b long, n long")
        found = C.stored(found, "found")
        edges = found.where("n = 0").select("a", "b")
    else:
        found = vectors.sparkSession.createDataFrame([], "a long, b long, n long")
        edges = found.select("a", "b")
    labels = C.least_reachable(edges, reps.select(F.col("rep").alias("key"), "first"))
    near = found.where("n > 0").groupBy("a").agg(F.sum("n").alias("near"))
    facts = reps.join(labels, reps.rep == labels.key).join(near, F.col("a") == F.col("rep"), "left")
    facts = C.stored(facts.select(F.col("label").alias("_l"), F.col("raw").alias("_v"), (F.coalesce("near", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id"), "facts")
    linked = rows.where("ok").join(facts.hint("merge"), (F.col("label") == F.col("_l")) & (F.col("raw") == F.col("_v"))).select("vec_id", "n_links", "component_id")
    alone = rows.where(~F.col("ok")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = linked.unionByName(alone)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
