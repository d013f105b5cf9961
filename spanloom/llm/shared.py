"""Helpers that the corpus operators share: the cluster's shared folder, staged tables, shipping of the package."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import time
import uuid
import zipfile
from collections.abc import Callable
from contextlib import suppress
from typing import Any

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Bytes of an Arrow batch on its way to a Python worker.
BATCH_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the corpus, read by Spark (the folder may be in any store that Spark reads)."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Unset, a local session gets a temporary one; a cluster must name it."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="spanloom-")
        spark.conf.set("spark.checkpoint.dir", path)
    return f"{path.rstrip('/')}/spanloom"


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str, *, wide: bool = False) -> DataFrame:
    """Writes df to the shared folder and reads it back: its lineage ends at files that outlive any executor. wide: rows of megabytes get a file each, as Parquet's writer looks at its buffer once in a hundred rows and its reader decodes up to 4,096 rows of a file at once."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.options(compression="zstd", **({"maxRecordsPerFile": 1} if wide else {})).parquet(path)
    tidy(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def tidy(spark: SparkSession, every: float = 15, share: float = 0.05) -> None:
    """Makes the driver's JVM give back what it has freed, once in `every` seconds at most and in no more than a share of the time: native memory of compilers and codecs, which the C library keeps, and a heap grown beyond half of its limit. Operators of many small jobs would hold both until they end."""
    sc, jvm, began = spark.sparkContext, spark._jvm, time.monotonic()
    ended, took = getattr(sc, "_spanloom_tidied", (began - every, 0))
    if began - ended < max(every, took / share):
        return
    heap = jvm.java.lang.Runtime.getRuntime()
    if 2 * heap.totalMemory() > heap.maxMemory():
        jvm.java.lang.System.gc()
    with suppress(Py4JError):  # a JVM without this command keeps it
        lang, new = jvm.java.lang, sc._gateway.new_array
        kinds, args = new(lang.Class, 4), new(lang.Object, 4)
        for k, name in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
            kinds[k] = lang.Class.forName(name)
        args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        lang.Class.forName("javax.management.MBeanServer").getMethod("invoke", kinds).invoke(lang.management.ManagementFactory.getPlatformMBeanServer(), args)
    ended = time.monotonic()
    sc._spanloom_tidied = ended, ended - began


def unstage(df: DataFrame | None) -> None:
    """Deletes the files of a staged table that nothing will read again."""
    if df is not None and hasattr(df, "_staged_at"):
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df._staged_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors once a session, for clusters on which it isn't installed."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))  # rows differ in size by orders of magnitude
    sc = spark.sparkContext
    if getattr(sc, "_spanloom_shipped", False):
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if os.path.isdir(top):
        path = os.path.join(tempfile.mkdtemp(prefix="spanloom-ship-"), "spanloom_ship.zip")
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            for folder, _, names in os.walk(top):
                for name in names:
                    if name.endswith(".py"):
                        full = os.path.join(folder, name)
                        z.write(full, os.path.relpath(full, os.path.dirname(top)))
        sc.addPyFile(path)
    sc._spanloom_shipped = True


_kept: dict[Any, Any] = {}


def keep(key: Any, make: Callable[[], Any]) -> Any:
    """What a worker keeps for its later tasks: one thing at a time. Another key drops what another operator has left and gives its memory back to the system."""
    if key not in _kept:
        release()
        _kept[key] = make()
    return _kept[key]


def release() -> None:
    """Drops what the worker keeps; tasks that need much memory but keep nothing begin with this."""
    if _kept:
        _kept.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        with suppress(OSError, AttributeError):
            ctypes.CDLL(None).malloc_trim(0)


def slices(batch: pa.RecordBatch, text: int, most: int = 2 << 20):
    """Parts of a batch of about `most` bytes of text at most (one row at least), so that memory follows neither row count nor text length."""
    col = batch.column(text)
    size, begin = 0, 0
    lengths = pa.compute.fill_null(pa.compute.binary_length(col), 0).to_pylist()
    for i, n in enumerate(lengths):
        if i > begin and size + n > most:
            yield batch.slice(begin, i - begin)
            begin, size = i, 0
        size += n
    if begin < len(lengths):
        yield batch.slice(begin)


def free_name(df: DataFrame, name: str) -> str:
    """name, or name with underscores before it, that no column of df has (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def text_or_empty(col: str = "text"):
    return F.coalesce(F.col(col), F.lit(""))
