"""Text documents: mail threads and transcripts as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions.core import fingerprint, redact


def read_mails(spark: SparkSession, path: str, names: tuple[str, ...] = ()) -> DataFrame:
    """SRC-12: one row a file: subject, all Date lines, masked body without header and rule lines, claim key."""
    return mails_of(spark.read.text(path, wholetext=True, pathGlobFilter="*.txt").select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), F.col("value")), names)


def mails_of(rows: DataFrame, names: tuple[str, ...] = ()) -> DataFrame:
    """SRC-12 on rows (file, value)."""
    body = F.array_join(F.filter(F.split("value", "\r?\n"), lambda x: ~x.rlike(r"^(From|To|Cc|Date|Subject):|^[-=_]{3,}\s*$")), "\n")
    masked = redact(body, names=names)
    return rows.select("file", F.trim(F.regexp_extract("value", r"(?mi)^Subject:[ \t]*(.*)$", 1)).alias("subject"), F.transform(F.regexp_extract_all("value", F.lit(r"(?mi)^Date:[ \t]*(.*)$"), F.lit(1)), F.trim).alias("dates"), masked["text"].alias("body"), F.substring(fingerprint(masked["text"]), 1, 16).alias("claim_key"))


def read_transcript(spark: SparkSession, path: str, names: tuple[str, ...] = ()) -> DataFrame:
    """SRC-13: numbered lines with the speaker's role and masked text."""
    return transcript_of(spark.read.text(path, wholetext=True), names)


def transcript_of(rows: DataFrame, names: tuple[str, ...] = (), key: tuple[str, ...] = ()) -> DataFrame:
    """SRC-13 on rows with value; key: columns that go along."""
    lines = rows.select(*key, F.posexplode(F.split("value", "\r?\n")).alias("pos", "line"))
    speaker = F.upper(F.regexp_extract("line", r"^\s*(?i)(INTERVIEWER|DISPATCHER)\s*:", 1))
    masked = redact(F.col("line"), names=names)
    return lines.filter(F.trim("line") != "").select(*key, (F.col("pos") + 1).alias("line_no"), F.when(speaker != "", speaker).alias("speaker"), masked["text"].alias("text"), masked["hits"].alias("redacted"))


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """SRC-14: an empty table where the path does not exist; a line that is not JSON raises."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
