"""A training-data pipeline: language ID, near-duplicates, mixing by source, packing.

Every stage takes (spark, docs, sf_dir); its result is written as Parquet and read again as the next
one's ``docs``.  All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskledger.llm import language, minhash, mixing, packing
from riskledger.llm.common import Workspace

LANGUAGE, SCORE, TEXT_HASH = "_pipeline_lang", "_pipeline_score", "_pipeline_text_hash"
#: Documents whose best language has a lower score are rejected, like those without a letter.
LEAST_SCORE = 0.35


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled ones teach; texts without a letter or language go.

    Without any labelled row there is nothing to tell languages by, and texts with a letter stay.
    """
    model = language.fit(docs)
    if not model.langs:
        return docs.where(F.coalesce(F.col("text").rlike("\\p{L}"), F.lit(False)))
    found = language.identify(docs, model, (LANGUAGE, SCORE))
    return found.where((F.col(LANGUAGE) != language.UNKNOWN) & (F.col(SCORE) >= LEAST_SCORE)).drop(LANGUAGE, SCORE)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, Jaccard 0.8 or more.

    Of rows that repeat a doc_id the one that was compared stays; rows with a null doc_id can't be told
    apart and stay.
    """
    key = ["doc_id", TEXT_HASH]
    kept = minhash.judged(docs, minhash.MinHash(words=5)).where("kept and doc_id is not null")
    kept = kept.select("doc_id", F.col("text_hash").alias(TEXT_HASH))
    single = docs.withColumn(TEXT_HASH, F.xxhash64("text")).join(kept, key, "left_semi").dropDuplicates(key)
    return single.select(*docs.columns).union(docs.where("doc_id is null"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the order of the mix, sources at smoothed shares; those of small sources repeat."""
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequence and offset."""
    return packing.pack(docs)


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("mix_sources", mix_sources), ("pack", pack)]
#: Learned language scores and tokenizers are not SQL; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    work, docs = Workspace(spark), spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number + 1 < len(STAGES):
            docs = work.keep(docs, name)
    return docs
