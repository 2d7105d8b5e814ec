"""SimHash near-dedup by a byte-position inverted index with count filtering.

Two 64-bit fingerprints that differ in at most 3 bits share at least 5 of their 8 positional bytes.  Lists of single bytes
would pair a share of 1/256 of all fingerprints, so the index posts each distinct one under its combinations of 5 positional
bytes.  Lists give their pairs, unverified; the tally of a pair is the number of lists that it comes up in: 1, 6, 21 or 56 for
5, 6, 7 or 8 shared bytes.  Pairs whose tally reaches the guaranteed minimum are retained and verified bit by bit.  A list of
very many fingerprints is not paired but posted again under parts of its remaining bits, by the same guarantee (3 of 6
nibbles, then 9 of 12 bits, where a list has at most 8 members), so work stays in proportion to the fingerprints however
many fall together, and no link is lost; a pair's tally is then that of the lists below.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _common as C

BITS = 3
SHINGLE = 3
SEED = 42
#: Lists of up to this many fingerprints are paired within; longer ones are posted again.
LIST = 32
#: Keys of longer lists are broadcast up to this count, else joined by a shuffle.
BROADCAST_ROWS = 100_000
_BLOCK = 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Majority bits of the XXH64 hashes of the text's word shingles; 0 for no words."""
    words = (text or "").encode().lower().split()  # bytes: only A-Z change, only ASCII blanks part words
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(shingle, len(words))
    starts, ends, h = starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for i in range(0, len(starts), _BLOCK):
        x = np.array([h(line[a:b], SEED) for a, b in zip(starts[i : i + _BLOCK], ends[i : i + _BLOCK])], np.uint64)
        ones += np.unpackbits(x.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(starts), bitorder="little").tobytes(), "little", signed=True)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) of every row's whole text; fp is the fingerprint as a signed long."""
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("fp", T.LongType())])

    def run(batches):
        for b in batches:
            fp = [fingerprint(t.as_py(), shingle) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(lambda b: C.released(run(b)), schema)


# masks of the bits that must agree

def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _level0(bits: int) -> list[int]:
    return [sum(0xFF << 8 * i for i in c) for c in combinations(range(8), 8 - bits)]


def _parts(mask: int, width: int, bits: int) -> list[int]:
    """``mask`` and all but ``bits`` of the parts of ``width`` bits that it leaves free."""
    part = (1 << width) - 1
    free = [part << i for i in range(0, 64, width) if not mask >> i & part]
    return [mask | sum(c) for c in combinations(free, len(free) - bits)]


def _children(spark: SparkSession, masks: list[int], width: int, bits: int) -> DataFrame:
    rows = [(_signed(m), _signed(c)) for m in masks for c in _parts(m, width, bits)]
    ids = spark.sparkContext.defaultParallelism
    return spark.createDataFrame(rows, "mask long, child long").coalesce(ids)


def links(fps: DataFrame, bits: int = BITS, longest: int = LIST) -> DataFrame:
    """(a, b), a < b: all pairs of distinct fingerprints in ``fps`` (fp) at ``bits`` or fewer differing bits."""
    spark = fps.sparkSession
    # Few bytes, but 56 postings a row follow: spread them whatever their size.
    fps = fps.select("fp").repartition(C.parallelism(spark), "fp").distinct()
    masks = _level0(bits)
    table = F.array(*[F.lit(_signed(m)) for m in masks])
    posted = fps.select("fp", F.explode(table).alias("mask")).withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
    found, level = None, 0
    while True:
        lists = posted.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b"))
        lists = C.stored(lists.where("n > 1"), "lists")
        pairs = lists.where("n = 2").select("a", "b")
        more = lists.where("n > 2").select("mask", "key", "n")
        held = not more.isEmpty()
        if held:
            members = C.stored(posted.join(C.sized(more, BROADCAST_ROWS), ["mask", "key"]), "members")
            last = level == 2
            short = members if last else members.where(F.col("n") <= longest)
            sets = short.groupBy("mask", "key").agg(F.array_sort(F.collect_list("fp")).alias("m"))  # up to ``longest`` each
            inside = F.flatten(F.transform("m", lambda x, i: F.transform(F.slice("m", i + 2, F.size("m")), lambda y: F.struct(x.alias("a"), y.alias("b")))))
            pairs = pairs.unionByName(sets.select(F.explode(inside).alias("p")).select("p.a", "p.b"))
        found = pairs if found is None else found.unionByName(pairs)
        if not held or last or members.where(F.col("n") > longest).isEmpty():
            return _retained(found, bits)
        width = (4, 1)[level]
        below = _children(spark, masks, width, bits)
        masks = sorted({c for m in masks for c in _parts(m, width, bits)})
        again = members.where(F.col("n") > longest).join(F.broadcast(below), "mask")  # the table's size is fixed
        posted = again.select("fp", F.col("child").alias("mask")).distinct().withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
        level += 1


def _retained(pairs: DataFrame, bits: int) -> DataFrame:
    """Count filter and verification of pairs that came up once for each list they share."""
    tally = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("lists"))
    shared = F.lit(0)
    for n in range(8 - bits, 9):  # n shared bytes give so many lists
        shared = F.when(F.col("lists") >= comb(n, 8 - bits), n).otherwise(shared)
    return tally.where((shared >= 8 - bits) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits)).select("a", "b")


def group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """One row per input row: (doc_id, fingerprint, component_id).

    component_id is the least id reachable over links, itself included.  Null and blank texts have fingerprint zero and
    link like any other.  Null ids are never a component_id unless the component has no other (then it is null).  Repeated
    rows count as copies.  Whole texts are read, one at a time: memory grows with the longest one.  Empty table: no rows; other
    columns are not read.
    """
    rows = C.stored(fingerprints(docs, id_col, text_col, shingle), "fingerprints", 2000)
    classes = C.stored(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
    labels = C.least_reachable(links(classes, bits), classes.withColumnRenamed("fp", "key"))
    out = rows.join(labels.hint("merge"), rows.fp == labels.key)
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """``docs`` with one row of each group of near copies, that with the least id.  Rows with a null id stay.

    Expects distinct ids (an earlier exact dedup); rows that repeat a kept id all stay.
    """
    g = group(docs, id_col, text_col, shingle, bits)
    gone = C.stored(g.where("doc_id IS NOT NULL AND doc_id != component_id").select(F.col("doc_id").alias("_gone")).distinct(), "gone")
    return docs.join(gone.hint("merge"), docs[id_col] == gone._gone, "left_anti")
