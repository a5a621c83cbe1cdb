"""Tables and files that driver and executors share while a session lasts."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows of a narrow table that may be broadcast; beyond it a join shuffles both sides.
BROADCAST_ROWS = 50_000


def shared_folder(spark: SparkSession) -> str:
    """What spark.checkpoint.dir names; a local folder only where executors are threads of this machine."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return "file:///tmp/checkpoints/tallyforge"


def file_system(spark: SparkSession, path: str):
    """(Hadoop's file system, the path in it)."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def fresh(spark: SparkSession, name: str) -> str:
    """A path that nothing uses yet; it goes when the session ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    fs, where = file_system(spark, path)
    fs.deleteOnExit(where)
    return path


def settle(df: DataFrame) -> DataFrame:
    """df as written to the shared folder and read again: what is read twice is computed once, and lost executors cost no lineage."""
    path = fresh(df.sparkSession, "settled")
    schema = df.schema
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file whole, then move it into place."""
    fs, where = file_system(spark, path)
    _, part = file_system(spark, f"{path}.{uuid.uuid4().hex}.part")
    out = fs.create(part)
    out.write(bytearray(text.encode()))
    out.close()
    replace(spark, part, where)


def replace(spark: SparkSession, part, where) -> None:
    """Rename over what is there in one step, so a crash leaves the old file or the new one."""
    jvm = spark._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(where.toUri() if where.toUri().getScheme() else jvm.java.net.URI("file:///"), spark._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(part, where, options)
