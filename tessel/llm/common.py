"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Bytes of an Arrow batch, so that a worker holds little of long texts at a time.
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "16m"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only where it is unset (tests on one machine) a folder of our own is made, and kept for the session.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.conf.get("spark.tessel.own.dir", None)
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tessel-")
        spark.conf.set("spark.tessel.own.dir", found)
    return found.rstrip("/")


def table_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tessel/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: lineage is cut, a lost executor costs nothing.

    The shuffle files of the write are of no more use behind it, and Spark is asked to drop them then.
    """
    spark, path = df.sparkSession, table_path(df.sparkSession, name)
    wanted = {CLEANUP: "true", BATCH: BATCH_BYTES}
    before = {key: spark.conf.get(key) for key in wanted}
    try:
        for key, value in wanted.items():
            spark.conf.set(key, value)
        df.write.parquet(path)
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    return spark.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession, *frames: DataFrame) -> None:
    """Deletes the files below frames made by :func:`stored` that are no longer read."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for frame in frames:
        for file in frame.inputFiles():
            folder = jvm.org.apache.hadoop.fs.Path(file).getParent()
            if "/tessel/" in folder.toString():
                folder.getFileSystem(conf).delete(folder, True)
                break


def input_bytes(docs: DataFrame) -> int:
    """What the tables hold that a frame reads, as the planner knows it; 0 of those where it doesn't."""
    leaves = docs._jdf.queryExecution().optimizedPlan().collectLeaves()
    found = [int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size())]
    return sum(n for n in found if n < 1 << 55)


def _allocator(name: str, *args: int) -> None:
    import ctypes

    try:
        getattr(ctypes.CDLL(None), name)(*args)
    except (AttributeError, OSError):  # another C library
        pass


def steady() -> None:
    """Lets this worker's arrays reuse its memory, instead of asking the machine for each; :func:`trimmed` gives it back."""
    _allocator("mallopt", -3, 1 << 30)  # M_MMAP_THRESHOLD
    _allocator("mallopt", -1, 1 << 30)  # M_TRIM_THRESHOLD


def trimmed() -> None:
    _allocator("malloc_trim", 0)


def released() -> None:
    """Gives memory that a worker holds but doesn't use back to the machine; workers outlive their tasks."""
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trimmed()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def remainder(column: str, divisor: int) -> Column:
    """crc32 of the identifier as text, modulo ``divisor`` (null ids: of the empty text)."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % divisor


def remainder_of(value: object, divisor: int) -> int:
    return zlib.crc32(b"" if value is None else str(value).encode()) % divisor


def texts(df: DataFrame, text: str = "text") -> Column:
    """Null counts as empty."""
    return F.coalesce(F.col(text), F.lit(""))
