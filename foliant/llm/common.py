"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table below ``sf_dir``, whatever store the path names."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as ``spark.checkpoint.dir`` names it.

    A session without that setting (tests) gets a folder below the warehouse; one
    whose master has executors of its own must name the folder.
    """
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not at:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(at)
    return at.rstrip("/")


#: Rows of an Arrow batch. Texts are long; Spark's own 10,000 would hold tens of MB
#: in each of several copies.
BATCH_ROWS = 2000
SMALL_BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(BATCH_ROWS)}


@contextmanager
def settings(spark: SparkSession, **options: str) -> Iterator[None]:
    """Options of the session while an operator runs; those before come back."""
    before = {k: spark.conf.get(k, None) for k in options}
    try:
        for k, v in options.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def delete(spark: SparkSession, at: str) -> None:
    """Deletes a folder of any Hadoop file system."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


_rooms: ContextVar[tuple[str, ...]] = ContextVar("rooms", default=())


def finished(what: str, **options: str):
    """For functions from a DataFrame (first argument) to one: runs with small Arrow
    batches and ``options``, writes the result once, and deletes all that was written
    on the way to it."""

    def around(f):
        @wraps(f)
        def run(df: DataFrame, *args, **kwargs) -> DataFrame:
            spark = df.sparkSession
            room = scratch(spark, f"room-{what}")
            with settings(spark, **SMALL_BATCHES, **options):
                token = _rooms.set((*_rooms.get(), room))
                try:
                    out = f(df, *args, **kwargs)
                    _rooms.reset(token)
                    token = None
                    return written(out, what)
                finally:
                    if token is not None:
                        _rooms.reset(token)
                    delete(spark, room)

        return run

    return around


def trim() -> None:
    """Gives memory that a finished step of this worker doesn't need back, as
    workers live on from stage to stage."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def give_back(spark: SparkSession) -> None:
    """Has the executors collect their garbage, so that the heap an earlier step grew
    goes back to the system: a JVM keeps it otherwise, beside the memory that Python
    workers take in the next step. A task for each core, which reach all idle executors."""
    n = spark.sparkContext.defaultParallelism
    spark.range(n, numPartitions=n).select(F.expr("reflect('java.lang.System', 'gc')")).collect()


def trimmed(f):
    """``f`` over a group's table, or two groups' tables, followed by ``trim``.
    Spark asks a function for one or two arguments."""

    def one(a):
        try:
            return f(a)
        finally:
            trim()

    def two(a, b):
        try:
            return f(a, b)
        finally:
            trim()

    return two if f.__code__.co_argcount == 2 else one


def trimmed_stream(f):
    """``f`` over an iterator of batches, followed by ``trim``."""

    def run(batches):
        yield from f(batches)
        trim()

    return run


def scratch(spark: SparkSession, what: str) -> str:
    """A new path below the shared folder; within ``finished`` one that goes at its end."""
    rooms = _rooms.get()
    return f"{rooms[-1] if rooms else shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """``df`` written once to the shared folder and read again: cuts lineage and
    survives the loss of any executor. Within ``finished`` the folder goes with it."""
    spark = df.sparkSession
    at = scratch(spark, what)
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def text_of(df: DataFrame, name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def local_path(uri: str) -> str | None:
    """The plain path of a ``file:`` URI or bare path; None for other stores."""
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    return uri if uri.startswith("/") else None


def filesystem(uri: str):
    """(pyarrow file system, path) of a URI that executors reach."""
    import pyarrow.fs as pafs

    if (path := local_path(uri)) is not None:
        return pafs.LocalFileSystem(), os.path.normpath(path)
    return pafs.FileSystem.from_uri(uri)
