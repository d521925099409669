"""Cleaning a corpus: language, quality, exact copies, near copies, then packing into training sequences.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's docs.  All but the last return the columns of ``documents``, whatever others there
are.  An empty table passes through every stage.
"""

from __future__ import annotations

import os

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relief.llm import exact_dedup as exact
from relief.llm import language_id, line_quality, ngram_join, packing
from relief.llm.common import shared_table
from relief.llm.queries import END_OF_DOCUMENT

#: documents under this quality score go; lower than where op6 predicts good, as clean documents are to stay
LEAST_QUALITY = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language can't be told: null texts, texts without a letter, scores under the calibrated one."""
    return language_id.accepted(docs, language_id.train(docs, F.lit(True)))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents under LEAST_QUALITY, by a model learned from the documents that ``labels`` marks."""
    labels = spark.read.parquet(os.path.join(sf_dir, "labels.parquet"))
    return line_quality.accepted(docs, line_quality.train(docs, labels, F.lit(True)), LEAST_QUALITY)


def free_name(docs: DataFrame) -> str:
    """A column name that the table doesn't have."""
    name = "_digest"
    while name in docs.columns:
        name += "_"
    return name


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z lower-cased) the document with the largest id stays; of rows with equal id and text, one."""
    digest = free_name(docs)
    hashed = docs.withColumn(digest, F.sha2(exact.lower_ascii(F.col("text")), 256))
    dropped = exact.exact_dedup(docs).where("not kept").select("doc_id", F.col("content_hash").alias(digest)).distinct()
    return hashed.join(dropped, ["doc_id", digest], "left_anti").dropDuplicates(["doc_id", digest]).drop(digest).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles of similarity 0.8 or more, the one with the least id stays (of several texts
    of that id in one group, the one with the least hash); null ids stay.  A row goes only by its own id and text."""
    tag = free_name(docs)
    tagged = docs.withColumn(tag, F.xxhash64(F.coalesce("text", F.lit(""))))
    rows, _ = ngram_join.ngram_join(tagged, words=5, percent=80, all_links=False, tag_col=tag)
    dropped = rows.where("not kept").select("doc_id", tag).distinct()
    return tagged.join(dropped, ["doc_id", tag], "left_anti").select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences of at most 4,096 tokens, with their token ids."""
    return packing.pack(docs, packing.word_encoder(public_tokenizers.path("word_bpe_49k.json"), END_OF_DOCUMENT))


STAGES = [("language", language), ("quality", quality), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("pack", pack)]

#: trained models and a tokenizer decide, which SQL can't express; tests hold every stage against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written to the shared folder and read again by the next."""
    docs = spark.read.parquet(os.path.join(sf_dir, "documents.parquet"))
    for _, stage in STAGES[:-1]:
        docs = shared_table(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
