"""Panel operators: exact-time lags, differences, checks, cohort cells, long differences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def check_unique(df: DataFrame, unit: str, time: str) -> None:
    if not df.groupBy(unit, time).count().where("count > 1").isEmpty():
        raise ValueError(f"({unit}, {time}) repeats")


def check_time(df: DataFrame, time: str) -> None:
    if df.schema[time].dataType.typeName() in ("date", "timestamp", "timestamp_ntz", "interval"):
        raise ValueError("give the time as an integer period, not as a date")


def lag(df: DataFrame, col: str, k: int = 1, unit: str = "id", time: str = "t", name: str | None = None) -> DataFrame:
    """The value exactly ``k`` periods earlier (k < 0: later); null over gaps.  A join on (unit, time - k), not a row offset."""
    check_time(df, time)
    name = name or (f"__L{'' if k == 1 else k}__:{col}" if k > 0 else f"__F{'' if k == -1 else -k}__:{col}")
    past = df.select(F.col(unit).alias("_u"), (F.col(time) + F.lit(k)).alias("_t"), F.col(col).alias(name))
    return df.join(past, (df[unit] == past._u) & (df[time] == past._t), "left").drop("_u", "_t")


def difference(df: DataFrame, col: str, k: int = 1, unit: str = "id", time: str = "t", name: str | None = None) -> DataFrame:
    """The k-th difference: differences of differences, null over gaps."""
    name = name or f"__D{k}__:{col}"
    out, source = df, col
    for i in range(1, k + 1):
        target = name if i == k else f"_d{i}"
        out = lag(out, source, 1, unit, time, name="_past")
        out = out.withColumn(target, F.col(source) - F.col("_past")).drop("_past")
        source = target
    return out.drop(*[f"_d{i}" for i in range(1, k)])


def first_difference(df: DataFrame, col: str, unit: str = "id", time: str = "t", name: str | None = None) -> DataFrame:
    """Against the row before, whatever the gap."""
    w = Window.partitionBy(unit).orderBy(time)
    return df.withColumn(name or f"d_{col}", F.col(col) - F.lag(col).over(w))


def segments(df: DataFrame, unit: str, time: str, name: str = "segment") -> DataFrame:
    """Numbers the runs of consecutive periods of each unit, from 0."""
    w = Window.partitionBy(unit).orderBy(time)
    gap = F.coalesce((F.col(time) - F.lag(time).over(w) != 1).cast("int"), F.lit(0))
    return df.withColumn("_gap", gap).withColumn(name, F.sum("_gap").over(w)).drop("_gap")


def balanced(df: DataFrame, unit: str, time: str) -> bool:
    periods = df.select(time).distinct().count()
    return df.groupBy(unit).agg(F.countDistinct(time).alias("n")).where(F.col("n") < periods).isEmpty()


def check_monotone(df: DataFrame, treat: str, unit: str = "id", time: str = "t") -> None:
    """Treatment, once on, stays on."""
    w = Window.partitionBy(unit).orderBy(time).rowsBetween(Window.unboundedPreceding, -1)
    if not df.withColumn("_before", F.max(treat).over(w)).where(F.col("_before") > F.col(treat)).isEmpty():
        raise ValueError("treatment switches off again")


def first_treated(df: DataFrame, treat: str, unit: str = "id", time: str = "t", name: str = "g") -> DataFrame:
    """(unit, first period of treatment; 0 for never)."""
    return df.groupBy(unit).agg(F.coalesce(F.min(F.when(F.col(treat) == 1, F.col(time))), F.lit(0)).alias(name))


def cells(df: DataFrame, unit: str = "id", time: str = "t", cohort: str = "g", base: str = "varying", anticipation: int = 0) -> list[tuple[int, int, int]]:
    """(cohort, period, base period) of every cell, by positions of periods.

    The long base lies ``anticipation`` + 1 positions before the cohort's first treated period.  With a varying base,
    periods up to it compare with the period before them; the base period itself is a cell of that kind too.  Periods between
    the base and the first treated one are left out.
    """
    bad = df.agg(F.coalesce(F.max((F.col(unit).isNull() | F.col(time).isNull() | F.col(cohort).isNull()).cast("int")), F.lit(0))).first()[0]
    if bad:
        raise ValueError("ids, times and cohorts must not be missing")
    check_unique(df, unit, time)
    times = sorted(r[0] for r in df.select(time).distinct().collect())  # periods, and cohorts below: few by nature
    cohorts = sorted(r[0] for r in df.where(F.col(cohort) > 0).select(cohort).distinct().collect())
    at = {t: i for i, t in enumerate(times)}
    out = []
    for g in cohorts:
        if g not in at:
            continue
        b = at[g] - 1 - anticipation
        if b < 0:
            continue
        for i, t in enumerate(times):
            if b < i < at[g]:
                continue
            if i >= at[g]:
                out.append((g, t, times[b]))
            elif base == "varying":
                if i > 0:
                    out.append((g, t, times[i - 1]))
            elif i != b:
                out.append((g, t, times[b]))
    return out


def cell_frame(spark: SparkSession, found: Sequence[tuple[int, int, int]]) -> DataFrame:
    return spark.createDataFrame([(int(g), int(t), int(b)) for g, t, b in found], "cg long, ct long, cb long")


def cell_rows(df: DataFrame, found: Sequence[tuple[int, int, int]], y: str, unit: str = "id", time: str = "t", cohort: str = "g", control: str = "notyet",
              anticipation: int = 0, keep: Sequence[str] = (), cutoff: str = "t") -> DataFrame:
    """(cg, ct, unit, d, dy, keep...): long differences of each cell's treated and control units.

    Controls: ``never``: cohort 0; ``notyet``: cohort 0, or first treated after the period that lies ``anticipation`` positions
    after the cell's.  The cells are a small table; base values come by an equi-join on (unit, base period).
    """
    spark = df.sparkSession
    times = sorted(r[0] for r in df.select(time).distinct().collect())
    at = {t: i for i, t in enumerate(times)}

    def limit(t, b):
        last = max(at[t], at[b]) if cutoff == "later" else at[t]
        i = min(last + anticipation, len(times) - 1)
        return times[i]

    table = spark.createDataFrame([(int(g), int(t), int(b), int(limit(t, b))) for g, t, b in found], "cg long, ct long, cb long, cut long")
    rows = df.select(F.col(unit).alias("unit"), F.col(time).cast("long").alias("ct"), F.col(cohort).cast("long").alias("_g"), F.col(y).cast("double").alias("_y"), *keep)
    held = rows.join(F.broadcast(table), "ct")  # periods x cohorts cells
    treated = F.col("_g") == F.col("cg")
    pool = (F.col("_g") == 0) if control == "never" else ((F.col("_g") == 0) | (F.col("_g") > F.col("cut")))
    held = held.where(treated | pool).withColumn("d", treated.cast("double"))
    before = df.select(F.col(unit).alias("unit"), F.col(time).cast("long").alias("cb"), F.col(y).cast("double").alias("_y0"))
    out = held.join(before, ["unit", "cb"]).withColumn("dy", F.col("_y") - F.col("_y0"))
    return out.where(F.col("dy").isNotNull() & ~F.isnan("dy")).select("cg", "ct", "cb", "unit", "d", "dy", *keep)
