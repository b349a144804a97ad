"""Training text from raw documents, in five stages.

Each stage works on all rows that the one before kept; its result is written as Parquet and read again. Stages write
theirs themselves, while batches and tasks are small. All but the last
return the columns of documents, extra ones included whatever their names. n_chars follows the text where a
stage changes it. Null ids are the largest, and ties in order of ids are equal texts, of which any one stays. Stages
keep repeated rows until the line stage, where a row with the id and text of another is the same document; the
near-duplicate stage keeps one of them. Empty tables pass through as such.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import bpe, decontaminate, jaccard_join, line_dedup, quality
from millrace.llm.scratch import stage, text_batches


def _columns(docs: DataFrame, new: DataFrame) -> DataFrame:
    """The columns of docs out of new, with n_chars of the text as it is now."""
    return new.select(*[F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; null and empty texts are among them."""
    with text_batches(spark):
        return stage(quality.classify(docs).filter("keep").select(*docs.columns), "quality")


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeats of runs of lines go, those of the same text included; the first in order of doc_id stays.

    A document of which nothing but white space is left goes too, so nothing is left of an exact copy of 160
    characters or 8 lines. Null texts go.
    """
    with text_batches(spark):
        cleaned = _columns(docs, line_dedup.remove_repeated_lines(docs))
        return stage(cleaned.filter(F.col("text").rlike(r"\S")), "lines")


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays, that with the least doc_id."""
    with text_batches(spark):
        return stage(jaccard_join.one_per_class(docs), "near-duplicates")


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    with text_batches(spark):
        clean = decontaminate.contamination(docs, benchmark).documents.filter("not contaminated")
        return stage(clean.select(*docs.columns), "decontamination")


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with ids (array<int>), n_tokens and round_trip (the ids decode to the text's bytes)."""
    vocab = public_tokenizers.path("byte_bpe_50k.tiktoken")
    same = F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")
    with text_batches(spark):
        both = bpe.round_trip(docs, vocab, public_tokenizers.PATTERN)
        return stage(both.withColumn("n_tokens", F.size("ids").cast("long")).withColumn("round_trip", same).drop("decoded"), "tokens")


STAGES = [
    ("quality", quality_stage),
    ("lines", line_stage),
    ("near_duplicates", jaccard_stage),
    ("decontamination", decontamination_stage),
    ("tokens", token_stage),
]

#: EM, training, MinHash and BPE have no SQL form; tests/llm holds the stages against brute force, the quality stage
#: against an own reckoning of votes, posteriors and scores.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents through all stages; the result of each but the last is in files when the next one reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, f in STAGES:
        docs = f(spark, docs, sf_dir)
    return docs
