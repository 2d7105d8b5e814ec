"""Least squares kept up to date over a stream: cross-products add up, so each micro-batch writes one small row of sums."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import linear as L


def sums(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row of n and all cross-products; rows with missing or infinite values are left out."""
    pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    each = [F.sum(F.col(cols[i]).cast("double") * F.col(cols[j]).cast("double")).alias(f"s{i}_{j}") for i, j in pairs]
    return df.where(L.finite(cols)).agg(F.count(F.lit(1)).alias("n"), *each)


def maintain(stream: DataFrame, cols: Sequence[str], path: str, checkpoint: str):
    """Starts a query that appends each batch's sums; a batch that is run again overwrites its own folder."""

    def one(batch: DataFrame, number: int) -> None:
        sums(batch, cols).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)


def current(spark: SparkSession, path: str, y: str, x: Sequence[str], cols: Sequence[str]) -> tuple[np.ndarray, int]:
    """(coefficients of y on x, rows so far) from all batches' sums."""
    cols = list(cols)
    r = spark.read.parquet(path).agg(F.sum("n").alias("n"), *[F.sum(f"s{i}_{j}").alias(f"s{i}_{j}") for i in range(len(cols)) for j in range(i, len(cols))]).first()
    at = lambda a, b: r[f"s{min(cols.index(a), cols.index(b))}_{max(cols.index(a), cols.index(b))}"]
    xx, xy = np.array([[at(a, b) for b in x] for a in x]), np.array([at(a, y) for a in x])
    return L.solve(xx, xy), r.n
