"""A training corpus from `documents`: clean, without near copies and test items, without personal data, mixed.

Each stage takes (spark, docs, sf_dir) and works on all rows of its docs; all but the last return the columns of
documents. Rows with null texts or ids pass the filtering stages; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dimwatch.llm import decontam, mixing, ngram_join, pii, toxicity
from dimwatch.llm.common import table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs whose score stays below 0.5."""
    lexicon = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return docs.where(toxicity.score(lexicon, F.col("text")) < 0.5)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of the n-gram join."""
    return ngram_join.one_of_each(docs)


def drop_test_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs that hold no item of `benchmark`."""
    return reduce(lambda kept, index: kept.where(~decontam.contaminated(index, F.col("text"))), decontam.indexes(table(spark, sf_dir, "benchmark")), docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with personal data replaced by its kind, and n_chars of the new text."""
    out = pii.redacted(docs)
    return out.withColumn("n_chars", F.coalesce(F.char_length("text").cast("long"), F.col("n_chars"))) if "n_chars" in docs.columns else out


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target and taken, the words that the mix takes of each document."""
    return mixing.mix_documents(docs)


STAGES = [
    ("toxicity", drop_toxic), ("ngram_jaccard_join", drop_near_copies), ("benchmark_decontamination", drop_test_items), ("pii", redact_personal_data), ("mixing", mix_sources),
]

#: The lexicon, the signatures and the boosted trees have no SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder for the next."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        docs = written(docs) if i < len(STAGES) - 1 else docs
    return docs
