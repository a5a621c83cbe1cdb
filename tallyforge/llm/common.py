"""Shared plumbing: tables, shared folder, lineage cuts, checked broadcasts, Arrow batches."""

from __future__ import annotations

import contextlib
import ctypes
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a table of narrow rows that may be broadcast; beyond it the join shuffles both sides.
BROADCAST_ROWS = 50_000
#: Bytes of its long texts that such a table may hold.
BROADCAST_BYTES = 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it.

    Where it is unset, a local folder serves if all executors are threads of this machine (tests); a cluster raises.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir("file:///tmp/checkpoints/tallyforge")
    return "file:///tmp/checkpoints/tallyforge"


def settle(df: DataFrame, **options: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it again: lineage ends and lost executors cost nothing.

    The files go when the session ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/settled-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.options(**options).parquet(path)
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(schema).parquet(path)


def lookup_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "left", rows: int | None = None, wide: str | None = None) -> DataFrame:
    """Join a wide left side with a settled right side, broadcast only if its counted rows are few. wide: a column of right whose texts may be long; their bytes are bounded too."""
    if wide is None:
        small = (right.count() if rows is None else rows) <= BROADCAST_ROWS
    else:
        said = right.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length(wide)), F.lit(0)).alias("size")).first()
        small = said.n <= BROADCAST_ROWS and said.size <= BROADCAST_BYTES
    return left.join(F.broadcast(right) if small else right if wide is None else right.hint("merge"), on, how)


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def trimmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; when they end, what the worker's allocators hold free goes back to the system, as workers are used again by later tasks."""
    try:
        yield from batches
    finally:
        release()


def release() -> None:
    """Free memory of this process's allocators to the system, where the platform has a call for it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string or binary column and the n + 1 offsets into them, without copies; null is empty."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]] if len(at) else raw, at - at[0] if len(at) else np.zeros(1, np.int64)


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each has about `most` bytes of a string column, and one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, at = utf8(batch.column(column))
        start = 0
        while start < batch.num_rows:
            end = max(start + 1, int(np.searchsorted(at, at[start] + most, "right")) - 1)
            yield batch.slice(start, end - start)
            start = end
