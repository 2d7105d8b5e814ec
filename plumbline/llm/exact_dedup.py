"""Exact dedup by skew-safe combining.

Copies are combined three times, by full content each time: inside each input partition (map-side), per salt (so a
text held by a third of all rows meets in several tasks, each getting one row per input partition at most), and over
the salts' winners.  The digest only routes rows; rows merge when their texts are identical.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _common as C

#: At least so many salts; more, as the square root, where the cluster's shuffles have more partitions.
SALTS = 16


def salts_for(docs: DataFrame) -> int:
    """A text on every input partition meets per salt and then over the salts: neither may grow as the input does."""
    return max(SALTS, 4 * math.isqrt(C.parallelism(docs.sparkSession)))


def winners(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int | None = None, normalise=None) -> DataFrame:
    """One row per digest: (digest, keep_id, group_size, n_texts); n_texts > 1 only if SHA-256 collides."""
    text = _text(text_col, normalise)
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    rows = rows.withColumn("digest", F.sha2("text", 256)).withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts or salts_for(docs))))
    salted = rows.groupBy("digest", "text", "salt").agg(F.max("id").alias("id"), F.count(F.lit(1)).alias("n"))
    whole = salted.groupBy("digest", "text").agg(F.max("id").alias("id"), F.sum("n").alias("n"))
    return whole.groupBy("digest").agg(F.max("id").alias("keep_id"), F.sum("n").alias("group_size"), F.count(F.lit(1)).alias("n_texts"))


def _text(text_col: str, normalise) -> Column:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return normalise(text) if normalise else text


def mark_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int | None = None, normalise=None) -> DataFrame:
    """One row per input row: (doc_id, keep_id, group_size, kept, text_sha256).

    The row with the largest id of a group stays.  Null texts count as empty.  Null ids never win over others; a group
    that has only null ids keeps nothing by id (keep_id null) and marks all its rows kept.  Rows repeated with the same
    id as the winner are all marked kept by id; ``drop_copies`` then keeps one.  Empty tables give no rows; other columns
    are ignored, whatever their names.
    """
    best = C.cut(winners(docs, id_col, text_col, salts, normalise))
    rows = docs.select(F.col(id_col).alias("doc_id"), _text(text_col, normalise).alias("text"))
    rows = rows.withColumn("digest", F.sha2("text", 256))
    if best.where("n_texts > 1").isEmpty():
        found = rows.drop("text").join(best.hint("merge"), "digest")
    else:  # two different texts share a SHA-256: tell them apart by content
        exact = C.stored(
            rows.groupBy("digest", "text").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "exact"
        )
        found = rows.join(exact.hint("merge"), ["digest", "text"])
    return found.select(
        "doc_id",
        "keep_id",
        F.col("group_size").cast("long").alias("group_size"),
        F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull()).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int | None = None) -> DataFrame:
    """``docs`` with one row of each group of equal texts, that with the largest id; all columns stay.

    Of rows that repeat both the winning id and the text, one stays: the one whose other columns have the least XXH64, so
    that it does not depend on the partitioning.  Rows with a null id stay only where their text has no other.  The text moves
    in the winners' shuffles only; the other columns, of any types, ride along as one struct.
    """
    cols = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]
    text = _text(text_col, None)
    rest = [F.when(F.col(text_col).isNotNull(), F.lit("")).alias(f"c{i}") if c == text_col else cols[i] for i, c in enumerate(docs.columns)]
    rows = docs.select(text.alias("text"), F.struct(F.col(id_col).alias("id"), F.bitwise_not(F.xxhash64(*[_hashable(docs, c) for c in docs.columns])).alias("tie")).alias("at"),
                       F.struct(*rest).alias("row"))
    rows = rows.withColumn("digest", F.sha2("text", 256)).withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts or salts_for(docs))))
    best = [F.max_by("row", "at").alias("row"), F.max("at").alias("at")]
    whole = rows.groupBy("digest", "text", "salt").agg(*best).groupBy("digest", "text").agg(*best)
    back = [
        (F.when(F.col(f"row.c{i}").isNotNull(), F.col("text")) if c == text_col else F.col(f"row.c{i}")).alias(c)
        for i, c in enumerate(docs.columns)
    ]
    return whole.select(*back)


def _hashable(docs: DataFrame, c: str) -> Column:
    """Maps are hashed as sorted JSON."""
    return F.to_json(F.struct(F.col(f"`{c}`"))) if "map<" in docs.schema[c].dataType.simpleString() or "variant" in docs.schema[c].dataType.simpleString() else F.col(f"`{c}`")
