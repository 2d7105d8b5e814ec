"""What the training-data operators share: shared tables, ranks, components.

Nothing here keeps state on one executor.  Lineage is cut with reliable checkpoints in
``spark.checkpoint.dir`` (never ``localCheckpoint``), so a lost executor costs a re-read only.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Words of a text: runs of bytes that are not ASCII blanks.
BLANKS = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; unset, and on one machine only, one of our own."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if named:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(named)
        return named.rstrip("/")
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="plumbline-"))
    return sc.getCheckpointDir().rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def at_end() -> None:
        try:
            remove(spark, path)
        except Exception:  # the JVM has ended already
            pass

    atexit.register(at_end)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Materialise and cut lineage, reliably."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, name: str, batch: int | None = None) -> DataFrame:
    """Write as Parquet in the shared folder and read back (columnar and compressed: for wide or long tables).

    ``batch``: rows that go to a Python worker at a time meanwhile; fewer for wide rows, which bounds both sides' memory.
    """
    spark, key = df.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch"
    path, before = fresh_path(spark, name), spark.conf.get(key)
    if batch:
        spark.conf.set(key, str(min(batch, int(before)) if int(before) > 0 else batch))
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(key, before)
    return spark.read.schema(df.schema).parquet(path)


def sized(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """A join side: broadcast if it has ``rows`` rows at most (it is counted, so cut or store it first), else merged."""
    return F.broadcast(df) if df.count() <= rows else df.hint("merge")


def filesystem(uri: str):
    """(filesystem, path) of a folder in the shared store, for Python on the executors: local mounts, HDFS, S3, GCS."""
    from pyarrow import fs

    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:") :]
    return fs.FileSystem.from_uri(uri)


def released(batches):
    """The batches; when they end, the worker gives the memory that Arrow keeps for later back, as workers live on."""
    import pyarrow as pa

    yield from batches
    pa.default_memory_pool().release_unused()


def parallelism(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def words(text: Column) -> Column:
    """The text's words, as an array; null is empty."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANKS), lambda w: w != "")


def word_count(text: Column) -> Column:
    """How many words the text has, without building them; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def bounded_rank(df: DataFrame, order: list[str], sums: dict[str, str] | None = None, rank: str | None = None) -> DataFrame:
    """Global running positions without a global window.

    Rows are range-partitioned by ``order`` (its last columns should tell rows apart, so that no value holds a whole
    task), the partition number is frozen by a checkpoint, per-partition totals (one row a partition) are summed up,
    and each partition adds its own offset.  ``sums``: output name -> column whose sum over all *earlier* rows is
    wanted; ``rank``: output name of the 0-based row number.
    """
    spark, n = df.sparkSession, parallelism(df.sparkSession)
    sums = sums or {}
    at = cut(df.repartitionByRange(n, *order).withColumn("_bin", F.spark_partition_id()))
    totals = [F.sum(c).alias(f"_t_{out}") for out, c in sums.items()] + [F.count(F.lit(1)).alias("_t_n")]
    before = Window.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    starts = at.groupBy("_bin").agg(*totals)  # at most n rows
    starts = starts.select("_bin", *[F.coalesce(F.sum(f"_t_{o}").over(before), F.lit(0)).alias(f"_o_{o}") for o in [*sums, "n"]])
    inside = Window.partitionBy("_bin").orderBy(*order)
    earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
    out = at
    for name, c in sums.items():
        out = out.withColumn(name, F.coalesce(F.sum(c).over(earlier), F.lit(0)))
    if rank:
        out = out.withColumn(rank, (F.row_number().over(inside) - 1).cast("long"))
    out = out.join(F.broadcast(starts), "_bin")
    for name in sums:
        out = out.withColumn(name, F.col(name) + F.col(f"_o_{name}"))
    if rank:
        out = out.withColumn(rank, F.col(rank) + F.col("_o_n"))
    return out.drop("_bin", *[f"_o_{o}" for o in [*sums, "n"]])


#: Up to so many distinct edges are joined up in one task; beyond, in rounds over all tasks.
FEW_EDGES = 50_000


def _joined_up(batches):
    import pyarrow as pa

    root: dict[int, int] = {}

    def find(i):
        while (up := root.get(i, i)) != i:
            root[i] = root.get(up, up)
            i = up
        return i

    for b in batches:
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            s, t = find(u), find(v)
            root[max(s, t)] = min(s, t)
    nodes = [i for i in root if find(i) != i]
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(i) for i in nodes], pa.int64())], ["node", "root"])


def components(edges: DataFrame, rounds: int = 60, few: int = FEW_EDGES) -> DataFrame:
    """Connected components of ``edges`` (a, b: longs) as (node, root): root is the least node reachable, itself left out.

    A counted, small number of edges is joined up in one task.  Beyond it: alternating large-star and small-star rounds: every round re-points neighbours at the least known one, so the
    number of edges never grows beyond the nodes' and rounds are logarithmic.  Minima are partial aggregates, and
    both sides of each join come straight from an exchange, so a node with very many neighbours is split by adaptive
    execution.  Only a count and a checksum reach the driver.
    """
    e = cut(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct()
    )
    seen = None
    for _ in range(rounds):
        mark = e.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if (mark.n, mark.x) == seen or not mark.n:
            break
        if seen is None and mark.n <= few:
            return cut(e.coalesce(1).mapInArrow(_joined_up, "node long, root long"))
        seen = (mark.n, mark.x)
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = cut(both.where("v > u").join(least.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct())
        least = cut(large.groupBy("u").agg(F.min("v").alias("m")))
        joined = large.join(least.hint("merge"), "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(joined.unionByName(least.select("u", F.col("m").alias("v"))).where("u != v").distinct())
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))


def least_reachable(edges: DataFrame, classes: DataFrame) -> DataFrame:
    """(key, component_id) of every class (key, first): the least ``first`` among the classes reachable over ``edges``."""
    joined = components(edges)  # only classes with links
    members = joined.select(F.col("node").alias("key"), "root").unionByName(joined.select(F.col("root").alias("key"), "root").distinct())
    members = cut(members.join(classes, "key"))
    best = cut(members.groupBy("root").agg(F.min("first").alias("best")))
    linked = cut(members.join(best.hint("merge"), "root").select(F.col("key").alias("of"), "best"))
    out = classes.join(linked, classes.key == linked.of, "left")
    return stored(out.select("key", F.coalesce("best", "first").alias("component_id")), "labels")
