"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset a folder of this machine, but only if the master is local, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{tempfile.gettempdir()}/oddsmith-shared"


def new_folder(spark: SparkSession, name: str) -> str:
    """A path that no other call gets."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


#: The tables written since each `passing` that is still open.
_open: list[list[str]] = []


def _located(spark: SparkSession, path: str) -> tuple:
    """The file system and path of Hadoop's that a path means."""
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jpath


def written(df: DataFrame, name: str, scope: int = -1) -> DataFrame:
    """df as a Parquet table in the shared folder: its lineage is cut, and a lost executor costs nothing. It goes when the
    application ends, or with the last `passing` that is open (scope: which one). A written table is given back as it is."""
    if getattr(df, "_oddsmith_written", False):
        return df
    spark = df.sparkSession
    path = new_folder(spark, name)
    files, jpath = _located(spark, path)
    files.deleteOnExit(jpath)
    if len(_open) >= -scope:
        _open[scope].append(path)
    df.write.parquet(path)
    out = spark.read.schema(nullable(df.schema)).parquet(path)
    out._oddsmith_written = True
    return out


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of plans that have run, now rather than at some later collection."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Tables written inside go when it ends, as do the shuffle files of what ran. Nothing may read them later."""
    _open.append([])
    try:
        yield
    finally:
        for path in _open.pop():
            files, jpath = _located(spark, path)
            files.delete(jpath, True)
        release(spark)


def settled(spark: SparkSession, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """What make() gives as a written table; the tables written on the way to it go."""
    with passing(spark):
        return written(make(), name, -2)


def nullable(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in schema])


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The Parquet table at path, or none of its rows where nothing has been written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
