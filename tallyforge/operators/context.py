"""The context that decisions are made against: its statistics, provenance and snapshot."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.scratch import settle

from .emit import sorted_json, write_jsonl


def content_hash(df: DataFrame) -> DataFrame:
    """One row (n_rows, digest): a hash of the rows' sorted JSON that neither their order nor their partitions change.

    Rows are hashed apart; the 64-bit halves of their digests are added up, so nothing is gathered, and copies count.
    """
    row = F.sha2(sorted_json(df), 256)
    half = lambda i: F.sum(F.conv(F.substring(row, i, 8), 16, 10).cast("decimal(38,0)"))
    return df.agg(F.count("*").alias("n_rows"), half(1).alias("a"), half(9).alias("b")).select("n_rows", F.sha2(F.concat_ws("|", "n_rows", F.coalesce(F.col("a").cast("string"), F.lit("0")), F.coalesce(F.col("b").cast("string"), F.lit("0"))), 256).alias("digest"))


def stats(tables: Mapping[str, DataFrame]) -> DataFrame:
    """AGG-15: (source, n_rows, digest) of each table of a context."""
    out = None
    for name, df in tables.items():
        one = content_hash(df).select(F.lit(name).alias("source"), "n_rows", "digest")
        out = one if out is None else out.unionByName(one)
    return out


def save_context(tables: Mapping[str, tuple[DataFrame, str]], folder: str) -> DataFrame:
    """SNK-05: write each table, computed once, as JSON lines ordered by its key; gives (source, n_rows, digest)."""
    settled = {name: (settle(df), key) for name, (df, key) in tables.items()}
    for name, (df, key) in settled.items():
        write_jsonl(df, key, f"{folder}/{name}")
    return stats({name: df for name, (df, _) in settled.items()})
