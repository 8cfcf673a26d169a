"""Corpus pipeline: language ID, near-dedup, private data, mixing, tokens. Each stage is an operator of tidelog.llm.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next one's docs. All
but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import bpe, common, langid, mixing, pii, simhash


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Set lang to the language that the network predicts, and drop documents that it rejects.

    Rejected: null and empty texts, texts without a letter, and those in which no language stands out (langid.MIN_SCORE). If no document has a
    language to learn from, lang stays and only the first three go. Repeated rows stay repeated; an empty table stays empty.
    """
    return langid.assign(docs, langid.train(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies: the smallest doc_id, null last, and of rows of one doc_id that of the least hash.

    Rows of one doc_id with texts that are no near copies all stay; rows without a doc_id are compared like any other; null and empty texts
    have fingerprint zero, so one of them stays.
    """
    return simhash.deduplicate(docs)


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace private data by surrogates; n_chars follows a text that changed. No row is dropped; null texts and texts without private data stay as they are."""
    return pii.pseudonymise(docs).withColumn("n_chars", F.when(F.col("tl_entities") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).drop("tl_entities")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop and repeat documents as the mix of sources asks. Texts without a word are never taken; a null source is a source of its own."""
    return mixing.apply(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode every document: a row of doc_id, n_tokens and hashes for each row of the mix; a null text has no ids, a null doc_id stays null."""
    return bpe.encode(docs)


STAGES = [("language", language), ("near_dedup", near_dedup), ("private_data", private_data), ("mix", mix), ("tokens", tokens)]

#: Language ID, fingerprints and surrogates are not expressible in SQL; the tests hold the pipeline against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, common.keep(stage(spark, docs, sf_dir), f"stage-{name}")
        common.release(before)
    return STAGES[-1][1](spark, docs, sf_dir)
