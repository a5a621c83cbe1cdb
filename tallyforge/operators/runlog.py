"""A masked run log: JSON lines, alerts, and output that is withheld rather than leaked."""

from __future__ import annotations

import json
import re
from collections import Counter

from pyspark.sql import DataFrame, SparkSession

from tallyforge.functions.core import DETECTORS
from tallyforge.scratch import put_text

# Levels in order.
LEVELS = {"debug": 10, "info": 20, "warn": 30, "error": 40}


def scrub(value: object) -> object:
    """STR-14 on the driver: every text of a nested value, masked."""
    if isinstance(value, str):
        for kind, pattern in DETECTORS:
            value = re.sub(pattern, f"[REDACTED:{kind}]", value)
        return value
    if isinstance(value, dict):
        return {k: scrub(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [scrub(v) for v in value]
    return value


class RunLog:
    """SNK-07: events from a level on, their details masked; alerts are warnings that are kept for the summary."""

    def __init__(self, level: str = "info") -> None:
        self.least, self.counts, self.alerts, self.lines = LEVELS[level], Counter(), [], []

    def log(self, level: str, event: str, **detail: object) -> None:
        self.counts[level] += 1
        if LEVELS[level] >= self.least:
            self.lines.append(json.dumps({"level": level, "event": event} | scrub(detail), ensure_ascii=False))

    def alert(self, code: str, **detail: object) -> None:
        self.alerts.append({"code": code} | scrub(detail))
        self.log("warn", f"ALERT {code}", **detail)

    def say(self, text: str) -> str:
        """Text for a person, or a notice where it would expose personal data."""
        found = sorted({kind for kind, pattern in DETECTORS if re.search(pattern, text)})
        return f"[BLOCKED] output withheld: would expose {','.join(found)}" if found else text

    def frame(self, spark: SparkSession, file: str) -> DataFrame:
        """The lines as rows (file, line_no, value)."""
        return spark.createDataFrame([(file, i, x) for i, x in enumerate(self.lines, 1)], "file string, line_no bigint, value string")

    def write(self, spark: SparkSession, path: str) -> None:
        put_text(spark, path, "".join(f"{x}\n" for x in self.lines))
