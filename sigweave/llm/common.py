"""Helpers that the operators share: shared storage, table reading, size-checked broadcasts, bounded Arrow slices."""

from __future__ import annotations

import ctypes
import math
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side with at most this many rows may be broadcast; larger ones are shuffled.
BROADCAST_ROWS = 200_000
#: Bytes of text that a Python task works on at once; a longer text makes a slice alone.
SLICE_BYTES = 3 << 20
LIBC = ctypes.CDLL(None)


def slices(batches: Iterator[pa.RecordBatch], column: int, limit: int | None = None) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in order, in slices of at most ``limit`` bytes of text (or binary) in ``column``."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(sizes)
        a = 0
        while a < batch.num_rows:
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + (limit or SLICE_BYTES), side="right")))
            yield batch.slice(a, b - a)
            a = b
        give_back()


def give_back() -> None:
    """Return freed memory to the system: Python workers live on and share their executor's limit."""
    pa.default_memory_pool().release_unused()
    if hasattr(LIBC, "malloc_trim"):
        LIBC.malloc_trim(0)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, as in tests, a temporary folder is set if driver and executors are one
    process; on a cluster, whose machines don't share such folders, that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="sigweave-")
        spark.conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.option("compression", codec).parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    written.written_to = path  # for ``release``
    return written


def release(*written: DataFrame) -> None:
    """Delete the files of tables that ``materialize`` wrote, once nothing will read them again."""
    for df in written:
        path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(df.written_to)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast ``df`` if its counted ``rows`` are within ``limit``; else leave the join to a shuffle."""
    return F.broadcast(df) if rows <= limit else df


def free_name(df: DataFrame, name: str) -> str:
    """``name``, led by as many underscores as it takes to differ from all columns of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def utf8_size(text) -> F.Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def partitions_for(spark: SparkSession, total: int | None, most: int = 256 << 20, least: int = 8 << 20) -> int:
    """Shuffle partitions for ``total`` bytes: of ``most`` bytes, or smaller where that keeps all cores busy, but of ``least``."""
    busy = min(3 * spark.sparkContext.defaultParallelism, (total or 0) // least + 1)
    return max(busy, math.ceil((total or 0) / most))


def buckets_for(total: int | None, per_bucket: int, least: int = 1) -> int:
    return max(least, math.ceil((total or 0) / per_bucket))
