"""Reports over decisions and audit rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def verdict_breakdown(audit: DataFrame, rules: DataFrame, rule: str, verdict: str, ticket: str, verdicts: Sequence[str]) -> DataFrame:
    """AGG-14, JOIN-12: counts by verdict and distinct tickets for every rule, those never evaluated too."""
    counts = audit.groupBy(rule).agg(*(F.count_if(F.col(verdict) == v).alias(v.lower()) for v in verdicts), F.count_distinct(F.when(F.col(verdict) != "NOT_APPLICABLE", F.col(ticket))).alias("affected"))
    out = rules.join(counts, rule, "left")
    return out.fillna(0, [v.lower() for v in verdicts] + ["affected"])


def kpis(df: DataFrame, **conditions: Column) -> DataFrame:
    """AGG-12, AGG-13, AGG-16: one row of counts."""
    return df.agg(F.count("*").alias("total"), *(F.count_if(c).alias(k) for k, c in conditions.items()))


def search(df: DataFrame, column: str, text: str) -> DataFrame:
    """FLT-10: case-insensitive substring."""
    return df.filter(F.lower(column).contains(text.lower()))


def work_order_detail(orders: DataFrame, audit: DataFrame, key: str) -> DataFrame:
    """PRJ-20: work orders with their audit rows, by key and place in the trail."""
    return orders.join(audit, key, "left").orderBy(key, "seq")


def summary(accepted: DataFrame, quarantine: DataFrame) -> DataFrame:
    """AGG-16: one row of counts of a run: accepted, dispatched, under constraints, escalated, quarantined, occurrences held."""
    status = lambda s: F.count_if(F.col("status") == s)
    a = accepted.agg(F.count("*").alias("accepted"), status("DISPATCHED").alias("dispatched"), status("DISPATCHED_WITH_CONSTRAINTS").alias("constrained"), status("ESCALATED_NO_VEHICLE").alias("escalated"))
    q = quarantine.agg(F.count("*").alias("quarantined"), F.coalesce(F.sum("occurrences"), F.lit(0)).alias("held"))
    return a.join(F.broadcast(q))  # a row each


def hash_files(files: DataFrame, group: str, name: str, content: Column) -> DataFrame:
    """AGG-21: one hash of the files of each group, in order of their names; a null content counts as missing. A group is a set of files of one run, not a corpus."""
    digest = F.coalesce(F.sha2(content.cast("binary"), 256), F.lit("<missing>"))
    ordered = F.array_sort(F.collect_list(F.struct(F.col(name).alias("n"), digest.alias("h"))))
    return files.groupBy(group).agg(F.count("*").alias("n_files"), ordered.alias("all")).select(group, "n_files", F.sha2(F.array_join("all.h", ""), 256).alias("digest"))


def last_run(lines: DataFrame) -> DataFrame:
    """SRC-17: (file, kind, event, line) of the alerts and errors in the last run_*.log by name, from rows (file, value) of JSON lines."""
    logs = lines.filter(F.col("file").rlike(r"^run_.*\.log$"))
    latest = logs.agg(F.max("file").alias("file"))
    rows = logs.join(F.broadcast(latest), "file").select("file", "value", F.from_json("value", "level string, event string").alias("x"))
    kind = F.when(F.col("x.level") == "error", "error").when(F.col("x.event").startswith("ALERT"), "alert")
    return rows.select("file", kind.alias("kind"), F.col("x.event").alias("event"), F.col("value").alias("line")).filter("kind is not null")
