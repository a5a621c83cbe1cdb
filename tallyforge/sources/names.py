"""Names of people, found by their place in a document and not by a list."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Words of roles and companies that stand where names stand.
NOT_NAMES = ("interviewer", "dispatcher", "regards", "thanks", "team", "operations", "logistics", "support", "manager", "client", "customer", "desk", "warehouse", "transport")

# Where a name stands in a document. The header line of an interview, a speaker's label, a signature line and the line after one.
INTERVIEW_HEADER = r"(?m)^[A-Za-z ]*interview:\s*([^,\n]+),"
SPEAKER_LABEL = r"(?m)^([A-Z][A-Z .]{2,30}):"
SIGNATURE_LINE = r"^(?:Dr\.?\s+)?(?:[A-Z][a-z]*\.?\s+){0,2}[A-Z][a-z]{2,}$"
AFTER_SIGNATURE = "^-{5,}$|^[A-Z]"


def _long(c: Column) -> Column:
    return F.length(F.trim(c)) > 2


def of_column(rows: DataFrame, column: str) -> DataFrame:
    """Names that a register holds in a column."""
    return rows.select(F.trim(F.col(column)).alias("name")).filter(_long(F.col("name"))).distinct()


def of_transcripts(texts: DataFrame, column: str = "value") -> DataFrame:
    """STR-13: the person in the header line "...interview: Name, job", whole and in parts, and speakers' labels in capitals, re-cased."""
    full = F.trim(F.regexp_extract(column, INTERVIEW_HEADER, 1))
    parts = F.filter(F.split(full, r"\s+"), lambda w: F.length(w) > 2)
    labels = F.transform(F.regexp_extract_all(column, F.lit(SPEAKER_LABEL), F.lit(1)), F.trim)
    cased = F.transform(labels, lambda w: F.concat(F.substring(w, 1, 1), F.lower(F.substring(w, 2, 40))))
    return texts.select(F.explode(F.concat(F.when(full != "", F.array_append(parts, full)).otherwise(F.array().cast("array<string>")), cased)).alias("name")).filter(_long(F.col("name")) & ~F.lower("name").isin(*NOT_NAMES)).distinct()


def of_signatures(texts: DataFrame, key: Sequence[str], column: str = "value") -> DataFrame:
    """STR-13: lines of one to three capitalised words after a blank line and before a blank one, a rule, a capital or the end; whole and in parts."""
    lines = texts.select(*key, F.posexplode(F.transform(F.split(column, "\r?\n"), F.trim)).alias("at", "line"))
    w = Window.partitionBy(*key).orderBy("at")
    near = lines.withColumns({"before": F.coalesce(F.lag("line").over(w), F.lit("")), "after": F.coalesce(F.lead("line").over(w), F.lit(""))})
    shape = F.col("line").rlike(SIGNATURE_LINE) & (F.length("line") <= 40)
    found = near.filter(shape & (F.col("before") == "") & ((F.col("after") == "") | F.col("after").rlike(AFTER_SIGNATURE))).select(F.regexp_replace("line", r"^Dr\.?\s+", "").alias("full"))
    words = F.split("full", r"\s+")
    clean = found.filter(~F.exists(words, lambda x: F.lower(F.regexp_replace(x, r"\.", "")).isin(*NOT_NAMES)))
    return clean.select(F.explode(F.array_append(F.filter(words, lambda x: (F.length(x) > 2) & ~x.endswith(".")), F.col("full"))).alias("name")).distinct()


def collect_names(found: Sequence[DataFrame]) -> DataFrame:
    """PII-01, SET-03: the names of all extractors, once each, without words of roles and companies."""
    out = found[0].select("name")
    for more in found[1:]:
        out = out.unionByName(more.select("name"))
    return out.filter(_long(F.col("name")) & ~F.lower("name").isin(*NOT_NAMES)).distinct()
