"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator
from typing import ClassVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import rolling

#: A word is a longest run of anything but space and the control characters 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parallelism(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def short_batches(spark: SparkSession) -> None:
    """Bound the bytes of text that one Arrow batch brings to a Python worker; rows may be long."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2_000)


def release() -> None:
    """Give a Python worker's freed memory back to the system; workers outlive their tasks, and several share an executor."""
    rolling.forget()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def lean(f: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function over batches that releases memory at the end of its task."""

    def run(batches: Iterator) -> Iterator:
        try:
            yield from f(batches)
        finally:
            release()

    return run


def lean_group(f: Callable) -> Callable:
    """A function of one group that releases memory afterwards."""

    def run(group):
        try:
            return f(group)
        finally:
            release()

    return run


def fold(key: str = "doc_id") -> Column:
    """crc32 of the key as text, mod 5; 0 marks held-out rows. A null key is held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5, F.lit(0)).cast("int")


class Scratch:
    """Tables written below the folder that the session names in spark.checkpoint.dir.

    That folder is shared by the driver and the executors, so a written table outlives any executor and
    cuts the lineage of what is read from it. Only where the setting is absent (as in local tests) a
    folder below the warehouse is used.
    """

    opened: ClassVar[list[Scratch]] = []

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        Scratch.opened.append(self)
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
        if not base:
            base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
        self.root = f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.option("compression", "zstd").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, name: str = "") -> None:
        fs, path = filesystem(self.spark, self.path(name) if name else self.root)
        fs.delete(path, True)

    def keep(self, *names: str) -> None:
        """Drop all tables but those that a result still reads."""
        fs, root = filesystem(self.spark, self.root)
        for found in fs.listStatus(root) if fs.exists(root) else []:
            if found.getPath().getName() not in names:
                fs.delete(found.getPath(), True)


def sweep(spark: SparkSession) -> None:
    """Have the driver collect its garbage: Spark then removes the files of shuffles that no plan refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@contextlib.contextmanager
def tidied() -> Iterator[None]:
    """Drop the scratch tables of all operators called inside, whose results have been written or used up by then."""
    before = len(Scratch.opened)
    try:
        yield
    finally:
        for scratch in Scratch.opened[before:]:
            scratch.drop()
        del Scratch.opened[before:]


def filesystem(spark: SparkSession, path: str):
    """Hadoop file system and path object of a path, through the driver's JVM."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p
