"""Configuration files."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession


def load_config(spark: SparkSession, path: str) -> dict:
    """SRC-15: a JSON file of any file system; a missing or broken one raises. Configurations are small and read on the driver."""
    rows = spark.read.text(path, wholetext=True).take(2)
    if len(rows) != 1:
        raise ValueError(f"{path}: one file is wanted, {len(rows)} found")
    return json.loads(rows[0].value)
