"""A corpus pipeline of five stages: quality, toxicity, near-duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next one's docs. All
but the last return the columns of documents. Stages work on all rows that their predecessor kept.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm import ngram_join, packing, quality, suffix_dedup, toxicity
from tallyforge.llm.common import settle, table


def aside(docs: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """docs with neutral names for all columns but id and text, so that no operator's column clashes with one, and the way back."""
    names = {c: f"__own_{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")}
    return docs.withColumnsRenamed(names), lambda df: df.select(*(F.col(names.get(c, c)).alias(c) for c in docs.columns))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the quality classifier rejects.

    Null, empty and blank texts have nothing that any labeller objects to and stay; equal texts share their fate, so repeated rows all stay or
    all go; ids and other columns play no part. An empty table stays empty.
    """
    plain, back = aside(docs)
    return back(quality.score_quality(plain, quality.train(plain)).filter("quality_kept"))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the toxicity scorer rejects; it is fitted on the labels of documents that are still there.

    Null and empty texts stay; equal texts share their fate; rows without id are scored but never learnt from; without labels of both
    kinds nothing is rejected. An empty table stays empty.
    """
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    plain, back = aside(docs)
    return back(toxicity.score_toxicity(plain, model).filter("predicted = 0"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document, that of the smallest id, of each group of near-duplicates (five words, similarity 0.8).

    Of rows that repeat both doc_id and text one stays, that with the smallest other columns; rows of one doc_id with different texts
    are taken as one document: they all stay or all go. Rows without id and texts without words stay. An empty table stays empty.
    """
    found = ngram_join.similar_sets(docs, k=5, num=80, den=100)
    known = found.filter("doc_id is not null")
    keep = settle(known.filter("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("__times")))
    kept = docs.join(keep, "doc_id").select(*docs.columns, "__times")
    once = kept.filter("__times = 1").select(docs.columns)
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    several = kept.filter("__times > 1").groupBy("doc_id", "text").agg(F.min(F.struct(*rest, F.lit(0))).alias("__row")).select("doc_id", "text", *(F.col("__row")[c].alias(c) for c in rest)).select(docs.columns)
    return once.unionByName(several).unionByName(docs.filter("doc_id is null"))


def repeats_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages of 200 bytes or more that occur again; n_chars follows the text.

    Every row stays, if with an empty text; null texts stay null. Repeated rows of 200 bytes or more lose all their text. An
    empty table stays empty.
    """
    plain, back = aside(docs)
    cut = suffix_dedup.remove_repeats(plain, keep_text=True)
    if "n_chars" in docs.columns:
        own = plain.columns[docs.columns.index("n_chars")]
        cut = cut.withColumn(own, F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col(own)).cast(dict(docs.dtypes)["n_chars"]))
    return back(cut)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences of 2048 tokens: pieces of documents with their places.

    Null and empty texts are one end mark; repeated and null ids are packed like others. An empty table gives no pieces.
    """
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", quality_stage),
    ("toxicity", toxicity_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("suffix-array dedup", repeats_stage),
    ("packing", packing_stage),
]
#: Fitted classifiers and tokenizers are beyond SQL; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = settle(docs)
    return docs
