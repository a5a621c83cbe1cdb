"""A keyed, idempotent state store as versioned Parquet snapshots."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge.scratch import file_system, put_text, settle

SCHEMA_VERSION = 3
#: Buckets by the hash of the key that upserts rewrite one by one.
BUCKETS = 64
BUCKET = "__bucket"


class LedgerError(RuntimeError):
    """A snapshot that this version cannot read."""


def new_rows(batch: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """SET-04: rows whose key the store lacks."""
    return batch.join(known.select(key), key, "left_anti")


def merge(accepted: DataFrame, quarantine: DataFrame, batch_accepted: DataFrame, batch_quarantine: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """LED-01, JOIN-14: insert what is new; what was accepted stays as it was; an accepted key leaves quarantine."""
    merged = accepted.unionByName(new_rows(batch_accepted, accepted, key), allowMissingColumns=True)
    held = quarantine.unionByName(new_rows(batch_quarantine, quarantine, key), allowMissingColumns=True).join(merged.select(key), key, "left_anti")
    return merged, held


def mark_sent(accepted: DataFrame, approvals: DataFrame, key: str) -> DataFrame:
    """LED-02: approvals (key, approved_by, sent_at, recipient, body) fill rows that are not sent yet; sent rows keep what they have."""
    given = approvals.select(key, *(F.col(c).alias(f"new_{c}") for c in ("approved_by", "sent_at", "recipient", "body")))
    out = accepted.join(given, key, "left")
    for c in ("approved_by", "sent_at", "recipient", "body"):
        out = out.withColumn(c, F.coalesce(c, f"new_{c}") if c in accepted.columns else F.col(f"new_{c}")).drop(f"new_{c}")
    return out.withColumn("sent", F.col("sent_at").isNotNull())


def pending(accepted: DataFrame) -> DataFrame:
    """FLT-09: rows that are not sent."""
    return accepted.filter(~F.coalesce("sent", F.lit(False)))


def sent(accepted: DataFrame) -> DataFrame:
    """FLT-09: rows that are sent."""
    return accepted.filter(F.coalesce("sent", F.lit(False)))


def incident_seeds(accepted: DataFrame) -> DataFrame:
    """PRJ-19: accepted rows as earlier incidents, for the rules that look back."""
    return accepted.select("ticket_id", "client", F.col("created_iso").alias("at"), F.col("vehicle_key").alias("reg_key"), "citation")


@dataclass
class Ledger:
    """SNK-06: tables of a folder. A pointer, replaced in one step, names the folders of each table that count: parts as they were appended, and buckets by key. One writer at a time."""

    spark: SparkSession
    path: str

    def current(self) -> dict | None:
        fs, where = file_system(self.spark, f"{self.path}/CURRENT")
        if not fs.exists(where):
            return None
        said = json.loads(self.spark.read.text(f"{self.path}/CURRENT").first()[0])
        if said["schema_version"] != SCHEMA_VERSION:
            raise LedgerError(f"snapshot of schema {said['schema_version']}, not {SCHEMA_VERSION}")
        return said

    def parts(self) -> int:
        """The most parts that a table has."""
        return max((len(x["parts"]) for x in (self.current() or {"tables": {}})["tables"].values()), default=0)

    def load(self, name: str, buckets: set[int] | None = None) -> DataFrame | None:
        """A table, or its rows of some buckets and of all parts."""
        about = (self.current() or {"tables": {}})["tables"].get(name)
        if about is None:
            return None
        places = [*about["parts"], *(place for k, place in sorted(about["buckets"].items()) if buckets is None or int(k) in buckets)]
        if not places:
            return self.spark.createDataFrame([], T.StructType.fromJson(about["schema"]))
        return self.spark.read.option("mergeSchema", len(set(places)) > 1).parquet(*(f"{self.path}/{p}" for p in places))

    def _point(self, tables: dict[str, dict], gone: Sequence[str]) -> None:
        """Name what counts from now on; remove what the pointer before this one had replaced already, as readers of the last one may still be at work on its files."""
        before = self.current()
        put_text(self.spark, f"{self.path}/CURRENT", json.dumps({"schema_version": SCHEMA_VERSION, "tables": tables, "old": sorted(gone)}))
        for old in before["old"] if before else ():
            fs, where = file_system(self.spark, f"{self.path}/{old}")
            fs.delete(where, True)

    def _write(self, tables: dict[str, DataFrame]) -> dict[str, str]:
        place = f"snapshot-{uuid.uuid4().hex}"
        for name, df in tables.items():
            df.write.parquet(f"{self.path}/{place}/{name}")
        return {name: f"{place}/{name}" for name in tables}

    @staticmethod
    def _folders(tables: dict[str, dict]) -> list[str]:
        return [place for x in tables.values() for place in (*x["parts"], *x["buckets"].values())]

    def save(self, **tables: DataFrame) -> None:
        """Write all tables whole and point to them alone."""
        before = self.current()
        made = self._write(tables)
        self._point({n: {"parts": [made[n]], "buckets": {}, "schema": df.schema.jsonValue()} for n, df in tables.items()}, self._folders(before["tables"]) if before else [])

    def append(self, **tables: DataFrame) -> None:
        """Add rows to tables at a cost that follows the rows, not the ledger."""
        said = (self.current() or {"tables": {}})["tables"]
        made = self._write(tables)
        for n, df in tables.items():
            about = said.setdefault(n, {"parts": [], "buckets": {}, "schema": df.schema.jsonValue()})
            about["parts"].append(made[n])
        self._point(said, [])

    def upsert(self, key: str, accepted: DataFrame, quarantine: DataFrame) -> set[int]:
        """LED-01, JOIN-14: merge a batch into the tables accepted and quarantine; gives the buckets that were rewritten.

        Rows lie in buckets by the hash of their key, so a batch reads and rewrites only the buckets that its keys fall into; all other folders stay as they are and are named
        again. Appended parts have no buckets yet: the first upsert after an append deals them out. An accepted key leaves quarantine, which is in the same bucket.
        """
        said = (self.current() or {"tables": {}})["tables"]
        spot = F.pmod(F.xxhash64(F.col(key)), F.lit(BUCKETS)).cast("int")
        new = {"accepted": settle(accepted), "quarantine": settle(quarantine)}
        touched = {r[0] for df in new.values() for r in df.select(spot).distinct().collect()}  # BUCKETS at most
        if any(said[n]["parts"] for n in new if n in said):
            touched = set(range(BUCKETS))
        if not touched and set(new) <= set(said):
            return touched
        old = {n: held if (held := self.load(n, touched)) is not None else df.limit(0) for n, df in new.items()}
        merged = dict(zip(new, merge(old["accepted"], old["quarantine"], new["accepted"], new["quarantine"], key), strict=True))
        place, gone = f"snapshot-{uuid.uuid4().hex}", []
        for n, df in merged.items():
            df.repartition(F.pmod(F.xxhash64(F.col(key)), F.lit(BUCKETS))).withColumn(BUCKET, spot).write.partitionBy(BUCKET).parquet(f"{self.path}/{place}/{n}")
            about = said.get(n, {"parts": [], "buckets": {}})
            gone += [*about["parts"], *(p for k, p in about["buckets"].items() if int(k) in touched)]
            kept = {k: p for k, p in about["buckets"].items() if int(k) not in touched}
            for k in sorted(touched):
                fs, where = file_system(self.spark, f"{self.path}/{place}/{n}/{BUCKET}={k}")
                if fs.exists(where):
                    kept[str(k)] = f"{place}/{n}/{BUCKET}={k}"
            said[n] = {"parts": [], "buckets": kept, "schema": df.schema.jsonValue()}
        self._point(said, gone)
        return touched

    def reset(self) -> None:
        fs, where = file_system(self.spark, f"{self.path}/CURRENT")
        fs.delete(where, True)


def accepted_now(ledger: Ledger, key: str) -> DataFrame | None:
    """Accepted rows with the approvals that were appended since; of several approvals of a row the first stays."""
    accepted, given = ledger.load("accepted"), ledger.load("approvals")
    if accepted is None or given is None:
        return accepted
    order = F.struct("sent_at", "approved_by")
    return mark_sent(accepted, given.groupBy(key).agg(*(F.min_by(c, order).alias(c) for c in ("approved_by", "recipient", "body")), F.min("sent_at").alias("sent_at")), key)
