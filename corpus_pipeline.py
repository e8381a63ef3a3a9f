"""A corpus pipeline of the training-data operators.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes what a stage returns as Parquet and
rereads it as the next one's documents. Stages but the last return the columns of documents:

1. language: texts without a letter go; a close second language is no reason to go.
2. near duplicates: one document of each group stays, the one with the smallest id.
3. repeated passages: passages of 50 words or more that occur before (in order of ids) are cut out.
4. mixing: sources are brought to their target shares; a document appears as often as the mix takes it.
5. packing: documents are laid along a space-filling curve and cut into sequences.

Null ids, null texts, repeated rows, empty tables and extra columns have the results that the operators state; rows
of one id are one document in stage 2, and rows without an id are documents of their own there.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlens.llm import jaccard, language, mixing, packing, repeats
from driftlens.staging import stage

SHINGLE_WORDS, SIMILARITY_PERCENT = 5, 80
PASSAGE_WORDS = 50
TOKENIZER = "byte_bpe_50k.json"


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.keep_known(docs, language.learn(docs))


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.one_of_each(docs, SHINGLE_WORDS, SIMILARITY_PERCENT)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = repeats.remove(docs, PASSAGE_WORDS)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.repeat_rows(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("language", known_language),
    ("near_duplicates", one_of_near_duplicates),
    ("repeated_passages", cut_repeated_passages),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
