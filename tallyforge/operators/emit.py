"""Projections of decisions: work orders, messages, audit steps, the output gate and JSON lines."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge.functions.core import NUMBER, blank_to_null, violations
from tallyforge.scratch import file_system, fresh, put_text


#: Ids that the engine makes from hashes; their digits can look like a telephone number.
OWN_IDS = r"(?<![A-Za-z0-9_])(?:(?:WO|MSG|PERSON|MECHANIC)-[0-9A-F]{10}|NO-ID-[0-9a-f]{16})(?![A-Za-z0-9_])"


class GateError(RuntimeError):
    """Rows that hold personal data were about to leave."""


def numbered(steps: Sequence[Column]) -> Column:
    """PRJ-17: texts that are not null, with running step numbers."""
    return F.transform(F.array_compact(F.array(*steps)), lambda x, i: F.struct((i + 1).alias("step"), x.alias("action")))


def message(lines: Sequence[Column]) -> Column:
    """PRJ-16: lines that are not null, blank ones kept."""
    return F.concat_ws("\n", F.array_compact(F.array(*lines)))


def audit(rows: DataFrame, key: str, steps: Sequence[tuple[str, Column, Column]]) -> DataFrame:
    """EMT-04, WIN-06: (key, seq, step, detail) for the steps whose condition holds, in order."""
    array = F.array_compact(F.array(*(F.when(condition, F.struct(F.lit(name).alias("step"), detail.cast("string").alias("detail"))) for name, condition, detail in steps)))
    return rows.select(key, F.posexplode(array).alias("pos", "x")).select(key, (F.col("pos") + 1).cast("bigint").alias("seq"), "x.step", "x.detail")


def sorted_value(c: Column, kind: T.DataType) -> Column:
    """A value whose fields and keys are in alphabetical order at every level; arrays keep theirs."""
    if isinstance(kind, T.StructType):
        made = F.struct(*(sorted_value(c[f.name], f.dataType).alias(f.name) for f in sorted(kind.fields, key=lambda f: f.name)))
        return F.when(c.isNotNull(), made)
    if isinstance(kind, T.MapType):
        entries = F.array_sort(F.map_entries(c))
        return F.map_from_entries(F.transform(entries, lambda e: F.struct(e["key"].alias("key"), sorted_value(e["value"], kind.valueType).alias("value"))))
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: sorted_value(x, kind.elementType))
    return c


def sorted_json(df: DataFrame) -> Column:
    """SNK-01: a row as JSON with columns, fields and keys in alphabetical order throughout, nulls written."""
    fields = sorted(df.schema.fields, key=lambda f: f.name)
    return F.to_json(F.struct(*(sorted_value(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in fields)), {"ignoreNullFields": "false"})


def gate_report(df: DataFrame, key: str, allow: Iterable[str] = (), names: Iterable[str] = ()) -> DataFrame:
    """EMT-05: (key, kinds of personal data) of the rows that may not leave."""
    text = F.col("__text")
    # one select a step, so that each is worked out once a row however often the next one uses it
    rows = df.select(key, F.regexp_replace(sorted_json(df), r"\\[nrtbf]", " ").alias("__text"))  # an escaped line feed must not pass for a letter before a number
    plain = F.regexp_replace(text, OWN_IDS, " ")
    for a in allow:
        plain = F.replace(plain, F.lit(a), F.lit(" "))
    if not (names := list(names)):
        plain = F.when(text.contains("@") | text.rlike(NUMBER), plain).otherwise("")  # an id that is taken out leaves more than one character between the digits beside it
    told = rows.select(key, plain.alias("__text")).select(key, violations("__text", names=names).alias("kinds"))
    # exploded, not filtered: a filter on what was found would be pushed below and search each text twice
    return told.select(key, F.explode(F.when(F.size("kinds") > 0, F.array("kinds"))).alias("kinds"))


def gate(df: DataFrame, label: str, allow: Iterable[str] = (), names: Iterable[str] = ()) -> None:
    """EMT-05: raise if any row holds personal data."""
    n = gate_report(df, df.columns[0], allow, names).count()
    if n:
        raise GateError(f"{label}: {n} rows hold personal data")


def write_jsonl(df: DataFrame, key: str, path: str) -> None:
    """SNK-02: ordered JSON lines, written aside as a whole and then put in place of what was there; a crash leaves the old or the new."""
    fs, where = file_system(df.sparkSession, path)
    aside, old = (f"{path}.{uuid.uuid4().hex}.{x}" for x in ("part", "old"))
    df.orderBy(key).select(sorted_json(df).alias("value")).write.text(aside)
    if fs.exists(where):
        fs.rename(where, file_system(df.sparkSession, old)[1])
    if not fs.rename(file_system(df.sparkSession, aside)[1], where):
        raise OSError(f"{path} could not be put in place")
    fs.delete(file_system(df.sparkSession, old)[1], True)


def write_json(spark: SparkSession, path: str, value: object) -> None:
    """SNK-03: a value as pretty JSON with sorted keys and a final line feed, moved into place whole."""
    put_text(spark, path, json.dumps(value, sort_keys=True, indent=2, ensure_ascii=False) + "\n")


MANIFEST = "MANIFEST"


def manifest(spark: SparkSession, folder: str) -> dict | None:
    """What counts in an output folder: {"version", "outputs": {label: path in the folder}, "old": versions replaced before}."""
    fs, where = file_system(spark, f"{folder}/{MANIFEST}")
    return json.loads(spark.read.text(f"{folder}/{MANIFEST}").first()[0]) if fs.exists(where) else None


def read_outputs(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The lines of each output, all of one version."""
    said = manifest(spark, folder) or {"outputs": {}}
    return {label: spark.read.text(f"{folder}/{place}") for label, place in said["outputs"].items()}


def materialise(frames: dict[str, tuple[DataFrame, str]], folder: str, allow: Iterable[str] = (), names: Iterable[str] = ()) -> None:
    """SNK-04: every output is computed once and gated; then all are written as ordered JSON lines into a folder of a new version, and one small file that names it is renamed over.

    So outputs change together: a crash at any time leaves all the old or all the new, never some of each. Nothing is written if any gate fails, and what is
    written is what was checked. The version before stays for its readers; what it had replaced is removed. An output is computed when those before it have passed the gate,
    and what it was checked on goes when all are written or one is held.
    """
    if not frames:
        return
    spark = next(iter(frames.values()))[0].sparkSession
    checked, settled = fresh(spark, "checked"), {}
    try:
        for label, (df, key) in frames.items():
            df.write.parquet(f"{checked}/{label}")
            settled[label] = (spark.read.schema(df.schema).parquet(f"{checked}/{label}"), key)
            gate(settled[label][0], label, allow, names)
        version, before = f"v-{uuid.uuid4().hex}", manifest(spark, folder)
        for label, (df, key) in settled.items():
            df.orderBy(key).select(sorted_json(df).alias("value")).write.text(f"{folder}/{version}/{label}")
        said = {"version": version, "outputs": {label: f"{version}/{label}" for label in settled}, "old": before["version"] if before else None}
        put_text(spark, f"{folder}/{MANIFEST}", json.dumps(said, sort_keys=True))
        if before and before["old"]:
            fs, where = file_system(spark, f"{folder}/{before['old']}")
            fs.delete(where, True)
    finally:
        fs, where = file_system(spark, checked)
        fs.delete(where, True)


# ---- projections of the ledger


def work_order_status(found: Column, needs_human: Column) -> Column:
    """PRJ-15: without a vehicle escalated, with one dispatched, under constraints where a person has to look."""
    return F.when(~found, "ESCALATED_NO_VEHICLE").when(needs_human, "DISPATCHED_WITH_CONSTRAINTS").otherwise("DISPATCHED")


def needs_message(client: Column) -> Column:
    """FLT-08: internal incidents and those without client get no message."""
    return F.coalesce(blank_to_null(client) != "Internal", F.lit(False))


def comms_pending(accepted: DataFrame, body: Column, *context: Column | str) -> DataFrame:
    """EMT-01: drafted messages: not sent yet, a client that gets one, a mailbox on file."""
    open_ = accepted.filter(~F.coalesce("sent", F.lit(False))) if "sent" in accepted.columns else accepted
    return open_.filter(needs_message(F.col("client")) & F.col("mailbox").isNotNull()).select("message_id", "ticket_id", F.col("mailbox").alias("recipient"), body.alias("body"), *context)


def comms_sent(accepted: DataFrame) -> DataFrame:
    """EMT-02: sent messages as they were sent; a body is never made anew."""
    return accepted.filter(F.coalesce("sent", F.lit(False))).select("message_id", "ticket_id", "recipient", "body", "approved_by", "sent_at")


def quarantine(held: DataFrame) -> DataFrame:
    """EMT-03."""
    return held.select("quarantine_id", "ticket_id", "reason_codes", "finding_codes", "occurrences", "citation", "remediation", "raw_record")
