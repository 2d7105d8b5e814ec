"""Mixing sources to target weights by a low-discrepancy schedule, native.

The mix is a line of slots, each one block of ``block`` words.  Slot k's golden-ratio point frac(k * phi) is mapped
through the sources' cumulative targets, slots are ranked within their source, and the r-th slot of a source takes the
r-th block of that source's documents laid end to end in hash order (a second lap follows the first).  Each source ends
at its target: the last block is cut there, slots beyond are left out, and blocks for which no slot is left, as those of
sources smaller than a block, go to slots by hash.  The slots of a source are ranked in bins of slot numbers and
documents are laid out by range partitions, so no source, however large, meets in one task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import _common as C

PHI = (math.sqrt(5) - 1) / 2
#: The weights of sources by rank, repeating; the mix's size over all sizes; the most laps.
WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
LAPS = 2
#: A block has this many words at most; fewer if the mix would have under LEAST_SLOTS slots.
BLOCK = 4096
LEAST_SLOTS = 1 << 17


def point(k: Column) -> Column:
    """frac(k * phi) in two parts, so that it stays exact to about 1e-9 for any slot number."""
    part = 1 << 20
    high, low = F.floor(k / part), k % part
    x = high * F.lit(math.fmod(part * PHI, 1)) + low * F.lit(PHI)
    return x - F.floor(x)


def targets(sources: DataFrame, share: float = SHARE, laps: int = LAPS, weights=WEIGHTS) -> DataFrame:
    """(source, source_size, weight, target, lo, hi): ``sources`` is one row a source (source, source_size).

    Water-filling: a source stops at ``laps`` times its size and the excess goes to the others by weight.  Each round
    is one aggregate over the sources; rounds end when no further source stops.
    """
    rank = F.col("_rank") % len(weights)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (rank + 1).cast("int"))
    rows = C.bounded_rank(sources.withColumn("_null", F.col("source").isNull()), ["_null", "source"], rank="_rank")
    rows = C.cut(rows.select("source", "source_size", "_null", "_rank", w.alias("weight"), (F.col("source_size") * float(laps)).alias("cap")))
    total = rows.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("s")).first().s * share
    level = 0.0
    while True:  # level: target per unit of weight
        full = F.col("cap") <= F.lit(level) * F.col("weight")
        got = rows.agg(
            F.coalesce(F.sum(F.when(full, F.col("cap"))), F.lit(0.0)).alias("capped"),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0)).alias("open"),
        ).first()
        if not got.open:
            level = float("inf")
            break
        now = (total - got.capped) / got.open
        if now <= level:
            break
        level = now
    target = F.when(F.col("cap") <= F.lit(level) * F.col("weight"), F.col("cap")).otherwise(F.lit(min(level, 1e300)) * F.col("weight"))
    rows = rows.withColumn("target", target)
    rows = C.bounded_rank(rows, ["_null", "source"], sums={"lo": "target"})
    return C.cut(rows.withColumn("hi", F.col("lo") + F.col("target")).drop("_null", "cap"))


def lay_out(docs: DataFrame) -> DataFrame:
    """Adds ``start``: the words of the same source before this document, in hash order."""
    d = docs.withColumn("_null", F.col("source").isNull()).withColumn("_mix", F.xxhash64("doc_id", "source", "size"))
    return C.cut(C.bounded_rank(d, ["_null", "source", "_mix", "doc_id"], sums={"start": "size"}).drop("_null", "_mix"))


def words(target: Column) -> Column:
    """A source's target in whole words."""
    return F.round(target).cast("long")


def schedule(goals: DataFrame, total: float, block: int) -> DataFrame:
    """(slot, source, block): which source's which block each slot holds; every block up to the target has one slot.

    A slot may be shared by blocks that the points leave over (a few a source).
    """
    spark = goals.sparkSession
    slots = int(total // block)
    cells = 4096
    # Sources meet points in cells of the unit interval, so a source with a wide interval is spread over many cells.
    spans = goals.where("target > 0").select(
        "source", (F.col("lo") / total).alias("lo"), (F.col("hi") / total).alias("hi")
    )
    first, last = F.floor(F.col("lo") * cells), F.least(F.floor(F.col("hi") * cells), F.lit(cells - 1))
    spans = spans.withColumn("cell", F.explode(F.sequence(F.least(first, F.lit(cells - 1)), last)))
    bins = C.parallelism(spark)
    width = max(1, -(-slots // bins))
    points = spark.range(0, slots, 1, bins).select(F.col("id").alias("slot"), point(F.col("id")).alias("p"))
    points = points.withColumn("cell", F.least(F.floor(F.col("p") * cells), F.lit(cells - 1)))
    hit = points.join(spans, "cell").where("p >= lo AND p < hi")
    hit = C.stored(hit.select("slot", "source", F.floor(F.col("slot") / width).alias("bin")), "slots")
    # Rank within the source: in bins of slot numbers, plus what earlier bins hold (sources x bins rows).
    held = hit.groupBy("source", "bin").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    starts = held.select(F.struct("source").alias("of"), F.col("bin").alias("in"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("source", "bin").orderBy("slot")
    ranked = hit.withColumn("i", F.row_number().over(inside) - 1)
    ranked = ranked.join(starts, (F.struct(ranked.source) == starts.of) & (ranked.bin == starts["in"]))
    ranked = ranked.select("slot", "source", (F.col("before") + F.col("i")).alias("block"))
    # What the points leave over of each target.
    given = held.groupBy("source").agg(F.sum("n").alias("n")).select(F.struct("source").alias("of"), "n")
    need = goals.select("source", F.ceil(words(F.col("target")) / block).alias("need"))
    left = need.join(given, F.struct(need.source) == given.of, "left").withColumn("n", F.coalesce("n", F.lit(0))).where("need > n")
    left = left.select("source", F.explode(F.sequence(F.col("n"), F.col("need") - 1)).alias("block"))
    left = left.select(F.pmod(F.xxhash64("source", "block"), F.lit(max(1, slots))).alias("slot"), "source", "block")
    return ranked.unionByName(left)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        share: float = SHARE, laps: int = LAPS, weights=WEIGHTS, block: int | None = None, row_col: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The mix: (documents with source_size, target, start; pieces (slot, source, block, doc_id, lap, words)).

    Null text has size 0, null source is a source of its own, ranked last.  A document of no words takes no words.  Rows
    that repeat an id are laid out one after the other, each for itself.  ``row`` numbers the rows; ``row_col`` names a
    column of distinct longs to be used for it.  Texts are counted, never cut, so a very long one is taken in pieces of several
    slots; ties in hash order go by id.  Empty table: no rows.  Extra columns are not read.
    """
    key = [F.col(row_col).alias("row")] if row_col else []
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), C.word_count(F.col(text_col)).alias("size"), *key)
    d = lay_out(C.cut(d))  # texts are read and counted once; range partitions sample what is cut
    sources = d.groupBy("source").agg(F.sum("size").alias("source_size"))
    goals = targets(sources, share, laps, weights)
    total = goals.agg(F.coalesce(F.sum("target"), F.lit(0.0)).alias("t")).first().t
    block = block or max(1, min(BLOCK, int(total) // LEAST_SLOTS))
    # Laying out counts over all sources: take off what earlier sources hold.
    g = goals.select(F.col("source").alias("_s"), "source_size", "target")
    before = C.bounded_rank(goals.select("source", "source_size", F.col("source").isNull().alias("_null")), ["_null", "source"], sums={"_before": "source_size"})
    g = g.join(before.select(F.col("source").alias("_s2"), "_before"), F.col("_s").eqNullSafe(F.col("_s2"))).drop("_s2")
    d = d.join(C.cut(g).hint("merge"), F.col("source").eqNullSafe(F.col("_s"))).withColumn("start", F.col("start") - F.col("_before"))
    d = d.drop("_s", "_before")
    d = C.cut(d if row_col else d.withColumn("row", F.monotonically_increasing_id()))
    # Each lap of a document, cut at block borders.
    lap = d.where("size > 0").withColumn("lap", F.explode(F.array(*[F.lit(i) for i in range(laps)])))
    lap = lap.withColumn("from", F.col("start") + F.col("lap") * F.col("source_size"))
    lap = lap.withColumn("to", F.least(F.col("from") + F.col("size"), words(F.col("target")))).where("from < to")
    lap = lap.withColumn("block", F.explode(F.sequence(F.floor(F.col("from") / block), F.floor((F.col("to") - 1) / block))))
    held = F.least("to", (F.col("block") + 1) * block) - F.greatest("from", F.col("block") * block)
    parts = lap.select(F.struct("source").alias("of"), F.col("block").alias("at"), "row", "doc_id", "lap", held.cast("long").alias("words"))
    slots = schedule(goals, total, block) if total else docs.sparkSession.range(0).select(
        F.col("id").alias("slot"), F.lit("").alias("source"), F.col("id").alias("block"))
    pieces = slots.join(parts, (F.struct(slots.source) == parts.of) & (slots.block == parts["at"]))
    return d, pieces.select("slot", "source", "block", "row", "doc_id", "lap", "words")


def taken(docs: DataFrame, **kw) -> DataFrame:
    """Per document: (doc_id, size, source_size, target, taken); see ``mix``."""
    d, pieces = mix(docs, **kw)
    got = C.cut(pieces.groupBy("row").agg(F.sum("words").alias("taken")))
    out = d.join(got, "row", "left")
    return out.select("doc_id", "size", F.col("source_size").cast("long").alias("source_size"), F.col("target").cast("double").alias("target"),
                      F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def repeat_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """``docs`` as the mix holds them: a row for each lap that takes half of its words or more.

    Only the document at the source's target is ever taken in part, so rounding moves one document a source.
    Rows are told apart by a number of their own, so rows with null or repeated ids count each for itself.
    """
    key = "_row"
    while key in docs.columns:
        key += "_"
    keyed = C.stored(docs.withColumn(key, F.monotonically_increasing_id()), "keyed")
    d, pieces = mix(keyed, id_col, text_col, row_col=key, **kw)
    laps = pieces.groupBy("row", "lap").agg(F.sum("words").alias("_words"))
    laps = laps.join(d.select("row", "size").hint("merge"), "row").where(F.col("_words") * 2 >= F.col("size"))
    laps = C.cut(laps.select(F.col("row").alias("_of")))
    both = keyed.join(laps.hint("merge"), keyed[key] == laps._of)
    return both.select(*[keyed[f"`{c}`"] for c in docs.columns])
