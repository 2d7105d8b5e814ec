"""Sharding by histogram sort, native.

Rows are ordered by (hash of the text, id), so equal texts lie together.  Splitters between shards are found by
counting exact bytes below candidate key boundaries, in all partitions at once, and refining only the bins that hold
a target: 12 key bits a round, until a boundary is within tolerance.  A boundary between two texts is taken where one
is near enough; a group of copies too large for that is cut by id.  Rows are exchanged once, to number them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from . import _common as C

STEP_BITS = 12
KEY_BITS = 63
#: A splitter may miss its target by this share of a shard.
TOLERANCE = 0.01


def size_bytes(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def _refine(rows: DataFrame, key: str, goals: dict[tuple, list[tuple[int, int]]], within: tuple[str, ...], allowed: int) -> dict:
    """For each goal find the boundary nearest to it.

    goals: group value -> [(goal number, bytes wanted below)], where bytes count from the group's first key on.
    Returns goal number -> (boundary key, bytes missed, bin that holds the goal if it could not be split further).
    """
    found: dict = {}
    # open: (group, prefix at this level) -> [(goal, bytes wanted above the prefix's first key)]
    state = {(g, 0): list(xs) for g, xs in goals.items() if xs}
    shift = KEY_BITS
    best: dict[int, tuple[int, int]] = {}
    while state:
        width = min(STEP_BITS, shift)
        above, shift = shift, shift - width
        keys = [(*g, p) for g, p in state]
        held = F.shiftright(F.col(key), above) if above < KEY_BITS else F.lit(0).cast("long")
        match = None
        for k in keys:  # at most one a splitter
            this = held == F.lit(k[-1])
            for name, v in zip(within, k):
                this = this & F.col(name).eqNullSafe(F.lit(v))
            match = this if match is None else match | this
        counted = rows.where(match).groupBy(*within, F.shiftright(F.col(key), shift).alias("bin")).agg(F.sum("size").alias("size"))
        bins: dict = {}
        for r in counted.collect():  # at most 2**STEP_BITS bins a splitter
            bins.setdefault((tuple(r[w] for w in within), r["bin"] >> width if above < KEY_BITS else 0), []).append((r["bin"], r["size"]))
        later: dict = {}
        for (g, p), xs in state.items():
            run, ends = 0, []
            for b, s in sorted(bins.get((g, p), [])):
                ends.append((b, run, run + s))
                run += s
            for goal, want in xs:
                for b, lo, hi in ends:
                    for edge, at in ((b << shift, lo), ((b + 1) << shift, hi)):
                        miss = abs(at - want)
                        if goal not in best or miss < best[goal][1]:
                            best[goal] = (edge, miss)
                    if lo <= want < hi:
                        inside = (b, want - lo)
                        break
                else:
                    inside = None
                if inside is None or best[goal][1] <= allowed or shift == 0:
                    found[goal] = (*best.get(goal, (0, 0)), inside if shift == 0 else None)
                else:
                    later.setdefault((g, inside[0]), []).append((goal, inside[1]))
        state = later
    return found


def splitters(rows: DataFrame, shards: int, tolerance: float = TOLERANCE) -> list[tuple[int, int]]:
    """Boundaries (key, key2): rows with (key, key2) >= the k-th go to shard k+1 or later."""
    total = rows.agg(F.sum("size").alias("s"), F.max("size").alias("m")).first()
    if not total.s:
        return [(0, 0)] * (shards - 1)
    allowed = int(tolerance * total.s / shards)
    goals = [(k, total.s * (k + 1) // shards) for k in range(shards - 1)]
    first = _refine(rows, "key", {(): goals}, (), allowed)
    out, deeper = {}, {}
    for k, (edge, miss, inside) in first.items():
        if miss <= max(allowed, total.m // 2) or inside is None:
            out[k] = (edge, 0)
        else:
            deeper.setdefault((inside[0],), []).append((k, inside[1]))
    if deeper:
        cuts = _refine(rows, "key2", deeper, ("key",), total.m // 2)
        for (g,), xs in deeper.items():
            for k, _ in xs:
                out[k] = (g, cuts[k][0])
    return sorted((min(a, 2**63 - 1), min(b, 2**63 - 1)) for a, b in out.values())


def shard(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", tolerance: float = TOLERANCE) -> DataFrame:
    """Every row with its shard and its gapless number there, law ``bytes``: sizes near equal.

    A shard misses an equal share of the bytes by 1 % and half of the longest row at most on each side; equal texts
    share a shard unless their group alone holds more than that and a splitter falls in it.  Null text: size 1.  Null ids
    sort with id 0; ids that are no integers sort by their hash.  Rows that repeat id and text are never cut apart.  Very long texts
    count by their bytes, which may make their shard the largest.  Empty table: no rows.  Only the id and text columns
    are read.
    """
    text = F.col(text_col)
    whole = isinstance(docs.schema[id_col].dataType, T.IntegralType)
    place = F.coalesce(F.col(id_col).cast("long"), F.lit(0)).bitwiseXOR(F.lit(-(2**63))) if whole else F.xxhash64(id_col)
    key2 = F.shiftrightunsigned(place, 1)
    rows = C.cut(
        docs.select(
            F.col(id_col).alias("doc_id"),
            size_bytes(text).alias("size"),
            F.crc32(F.encode(F.coalesce(text, F.lit("")), "UTF-8")).cast("long").alias("text_crc32"),
            F.shiftrightunsigned(F.xxhash64(F.coalesce(text, F.lit(""))), 1).alias("key"),
            key2.alias("key2"),
        )
    )
    cuts = splitters(rows, shards, tolerance)
    at = F.lit(0)
    for a, b in cuts:
        at = at + F.when((F.col("key") > a) | ((F.col("key") == a) & (F.col("key2") >= b)), 1).otherwise(0)
    rows = rows.withColumn("shard", at.cast("int"))
    return number(rows)


def number(rows: DataFrame, bins: int = 512) -> DataFrame:
    """Slots: shard by shard, in bins by id, so no task numbers a whole shard.  The one exchange of rows."""
    rows = rows.withColumn("bin", F.pmod(F.xxhash64("doc_id", "key"), F.lit(bins)))
    held = rows.groupBy("shard", "bin").agg(F.count(F.lit(1)).alias("n"))  # shards x bins rows at most
    before = Window.partitionBy("shard").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    starts = held.select("shard", "bin", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("shard", "bin").orderBy("key", "key2", "doc_id")
    out = rows.withColumn("i", F.row_number().over(inside) - 1).join(F.broadcast(starts), ["shard", "bin"])
    return out.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("start") + F.col("i")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
