"""Helpers that the text operators share: shared storage, row counts and connected components."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words are maximal runs of anything but these six characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a folder of this machine is set
    if the master is local, as in tests; on a cluster that fails, as no executor would see it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    context = spark.sparkContext._jsc.sc()
    if not context.getCheckpointDir().isDefined():
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(f"{tempfile.gettempdir()}/oddsmith-checkpoints")
    return context.getCheckpointDir().get()


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other call gets; it is deleted when the application ends."""
    path = f"{shared_dir(spark)}/oddsmith-{uuid.uuid4().hex}/{name}"
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path).getParent()
    jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema])
    out = spark.read.schema(schema).parquet(path)
    out._oddsmith_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the files of a materialized table that nothing reads any more."""
    path = getattr(df, "_oddsmith_path", None)
    if path:
        sc = df.sparkSession.sparkContext
        jpath = sc._jvm.org.apache.hadoop.fs.Path(path).getParent()
        jpath.getFileSystem(sc._jsc.hadoopConfiguration()).delete(jpath, True)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def range_prefix(df: DataFrame, order: list[Column], sums: dict[str, str]) -> DataFrame:
    """Add running sums over a total order without putting all rows in one task.

    sums: new column name -> column to add up, this row included. Rows are range-partitioned and written; each
    partition is summed on its own, and the partitions' totals (a row each) give what goes before it.
    """
    n = shuffle_partitions(df.sparkSession)
    parts = materialize(df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()), "ranged")
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = parts.groupBy("_part").agg(*[F.sum(c).alias(f"_t_{k}") for k, c in sums.items()])
    totals = totals.select("_part", *[F.coalesce(F.sum(f"_t_{k}").over(before), F.lit(0)).alias(f"_b_{k}") for k in sums])
    inner = parts.withColumns({k: F.sum(c).over(inside) for k, c in sums.items()})
    out = inner.join(totals, "_part").withColumns({k: F.col(k) + F.col(f"_b_{k}") for k in sums})
    return out.drop("_part", *[f"_b_{k}" for k in sums])


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Label every node of an undirected graph with the least node of its component.

    edges: two columns of one orderable type, named u and v, in any order, repeats allowed; loops and nulls are
    ignored. Returns (node, component) for nodes that have an edge; an empty input gives an empty result.

    Alternating star contraction: in a round each node's larger neighbours are linked to its least neighbour, then
    each node and its smaller neighbours to the least of them. The number of edges never grows, and rounds are
    logarithmic in practice. Each round is written to shared storage. The join against the minima takes two shuffled
    tables, so that adaptive execution can split the rows of a hub.
    """
    start = edges.select("u", "v").where("u <> v")
    cur = materialize(start.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")

    def fingerprint(e: DataFrame) -> tuple:
        r = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        return tuple(r)

    state = fingerprint(cur)
    for _ in range(max_rounds):
        if not state[0]:
            break
        both = cur.union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large, "large")
        low = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        nxt = materialize(small.union(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        after = fingerprint(nxt)
        for old in (cur, least, large, low):
            discard(old)
        cur, done, state = nxt, after == state, after
        if done:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    out = cur.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return out.union(cur.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def give_back() -> None:
    """Return freed memory of a Python worker to the system, which an idle worker would keep beside those at work."""
    import pyarrow

    pyarrow.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


@contextmanager
def arrow_batches(spark: SparkSession, rows: int | None) -> Iterator[None]:
    """Plans made inside send Python at most so many rows at a time, which bounds what both sides hold of long texts; None
    leaves the session's setting."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    if rows:
        spark.conf.set(key, rows)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function over batches that gives its freed memory back when a partition ends."""

    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of tables that are no longer referenced, now rather than at some later collection."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()
