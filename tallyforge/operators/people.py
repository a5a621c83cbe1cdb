"""Masking of people's names with a register of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.scratch import BROADCAST_ROWS, settle

MASK = "[REDACTED:PERSON]"


def words_of(text: Column) -> Column:
    """Distinct runs of ASCII letters, digits and underscores in lower case, and other characters but white space one by one: every name holds one of its own, and where a name stands in a text so does that."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9_]+|[^a-z0-9_\s]"), F.lit(0)))


def register(names: DataFrame, column: str = "name") -> DataFrame:
    """PII-01: (anchor, name, words): names of three characters or more, trimmed, in lower case and once each, by the rarest of their words in the register (of equally rare ones the smallest), so that few names share an anchor."""
    clean = settle(names.select(F.lower(F.btrim(F.col(column))).alias("name")).filter(F.length("name") >= 3).distinct().withColumn("words", words_of(F.col("name"))))
    long = clean.select("name", F.explode("words").alias("word"))
    rare = long.groupBy("word").agg(F.count("*").alias("n"))
    anchors = long.join(rare, "word").groupBy("name").agg(F.min(F.struct("n", "word")).alias("first"))
    return anchors.join(clean, "name").select(F.col("first.word").alias("anchor"), "name", "words")


def _pattern(names: Column) -> Column:
    """One alternation of a row's names, longest first, bounded as words."""
    ordered = F.transform(F.array_sort(F.transform(names, lambda n: F.struct((-F.length(n)).alias("k"), n.alias("n")))), lambda x: x["n"])
    quoted = F.transform(ordered, lambda n: F.concat(F.lit("\\Q"), F.replace(n, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E")))
    return F.concat(F.lit("(?i)(?<![A-Za-z0-9_])(?:"), F.array_join(quoted, "|"), F.lit(")(?![A-Za-z0-9_])"))


def mask_people(rows: DataFrame, column: str, names: DataFrame, name: str = "name") -> DataFrame:
    """STR-11: rows with the names of a register masked in a text column, longest first and only as whole words, and person_hit, whether there was one.

    A text meets a name only where it holds the name's rarest word: words and anchors are joined, a name stays if all its words are in the text, and each text is then searched for its own few names
    by one pattern. Names of one word are known to be there by that. A register that is counted as small goes along with every task, so that of a text only the words of longer names are shuffled;
    a larger one is held nowhere as a whole and both sides shuffle by word, but only numbers and words of texts.
    Results are those of one alternation of all names. Names of under three characters are left out; null texts stay null.
    """
    known = settle(register(names, name))
    few = known.count() <= BROADCAST_ROWS
    known = F.broadcast(known) if few else known
    numbered = settle(rows.withColumn("__row", F.monotonically_increasing_id()))
    has = F.explode(words_of(F.col(column)))  # of the expression itself: a named array would be made once more to see that it is not empty
    met = settle(numbered.select("__row", has.alias("anchor")).join(known, "anchor").select("__row", "name", "words"))
    single, long = met.filter("size(words) = 1").select("__row", "name"), met.filter("size(words) > 1")
    wanted = known.filter("size(words) > 1").select(F.explode("words").alias("word")).distinct()
    present = numbered.select("__row", has.alias("word")).join(F.broadcast(wanted) if few else wanted, "word", "left_semi")
    parts = long.select("__row", "name", F.size("words").alias("__n"), F.explode("words").alias("word"))
    whole = parts.join(present, ["__row", "word"]).groupBy("__row", "name").agg(F.count("*").alias("k"), F.first("__n").alias("n")).filter("k = n").select("__row", "name").unionByName(single)
    own = whole.groupBy("__row").agg(F.collect_list("name").alias("__names"))  # names whose words are all in one text
    out = numbered.join(own, "__row", "left").withColumn("__masked", F.when(F.col("__names").isNotNull(), F.regexp_replace(F.col(column), _pattern(F.col("__names")), F.lit(MASK))).otherwise(F.col(column)))
    hit = F.coalesce(F.col("__masked") != F.col(column), F.lit(False))
    return out.select(*(F.col("__masked").alias(c) if c == column else F.col(c) for c in rows.columns), hit.alias("person_hit"))
