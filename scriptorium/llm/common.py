"""Shared helpers: shared-folder tables, size-checked broadcasts, input columns."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word rule ``[^\x20\x09-\x0D]+``.
SPACE_BYTES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)

#: A table is broadcast only when counted to hold no more rows than this.
BROADCAST_ROWS = 20_000

ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"

_open: list[list[str]] = []
#: Tables after which shuffle files of plans that ended are dropped.
TIDY_EVERY = 6
_written = 0


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``).

    In local mode, where all tasks share the driver's disk, a folder of our own stands in for an
    unset one; on a cluster that is an error, as executors would write to disks of their own.
    """
    name = spark.conf.get("spark.checkpoint.dir", None)
    if not name:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        name = "file://" + tempfile.mkdtemp(prefix="scriptorium-")
        spark.conf.set("spark.checkpoint.dir", name)
    return name.rstrip("/")


def materialize(df: DataFrame, name: str, *, rows: int = 1000, up: int = 0) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again.

    The lineage is cut, a lost executor costs nothing that was written, and a later join
    sees a plain scan, so that adaptive execution can split its skewed partitions.  Arrow batches
    have at most ``rows`` rows meanwhile, so that long texts fit beside each other.  The table
    belongs to the open :func:`scratch`, or to the one ``up`` levels further out.
    """
    global _written
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with arrow_rows(spark, rows):
        df.write.parquet(path)
    if len(_open) > up:
        _open[-1 - up].append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    _written += 1
    if _written % TIDY_EVERY == 0:
        tidy(spark)
    return out


def tidy(spark: SparkSession) -> None:
    """Have Spark drop the shuffle files of plans that ended: it does so when the objects that stand for them are collected."""
    gc.collect()
    spark._jvm.System.gc()


def discard(*tables: DataFrame) -> None:
    """Delete tables of :func:`materialize` that are needed no more, and shuffle files of plans that ended."""
    spark = tables[0].sparkSession
    release(spark, [t.stored_at for t in tables])
    tidy(spark)


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Within, Arrow batches of the session have at most ``rows`` rows."""
    before = spark.conf.get(ARROW_ROWS)
    spark.conf.set(ARROW_ROWS, min(int(before), rows))
    try:
        yield
    finally:
        spark.conf.set(ARROW_ROWS, before)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that :func:`materialize` writes within are deleted at the end, but for those it writes for further out."""
    made: list[str] = []
    _open.append(made)
    try:
        yield
    finally:
        _open.remove(made)
        release(spark, made)


def release(spark: SparkSession, paths: list[str]) -> None:
    """Delete folders of the shared store."""
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """From now on Arrow batches of the session have at most ``rows`` rows: for operators that are evaluated later."""
    spark.conf.set(ARROW_ROWS, min(int(spark.conf.get(ARROW_ROWS)), rows))


def give_back() -> None:
    """Free memory of this process goes back to the system: Python workers live on and serve later stages."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it is counted to hold at most ``rows`` rows; else as it is (shuffled join)."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
