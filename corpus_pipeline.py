"""A training corpus from raw documents: quality, language, near-duplicates, mixing, tokens.

Each stage takes (spark, docs, sf_dir), works on all its predecessor kept, and is written as Parquet before the next one
reads it. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from presswarp.llm import byte_bpe, language, mixing, near_dup, quality
from presswarp.llm.common import bounded_batches, fresh_dir
from presswarp.llm.queries import BYTE_VOCABULARY


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    bounded_batches(spark)
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognisable language go."""
    bounded_batches(spark)
    return language.keep_identified(docs)


def keep_one_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    bounded_batches(spark)
    return near_dup.keep_one_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are brought to their target weights: rows repeat, are cut at the end of a budget, or go."""
    return mixing.mixed_documents(docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, and a digest of what they decode to."""
    bounded_batches(spark)
    ranks = byte_bpe.read_ranks(spark, BYTE_VOCABULARY)
    tokens = byte_bpe.decode(byte_bpe.encode(docs, ranks, public_tokenizers.PATTERN, ["doc_id", "lang", "source"]), ranks)
    return tokens.select("doc_id", "lang", "source", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), F.sha2("decoded", 256).alias("decoded_sha256"), "ids")


STAGES = [
    ("quality classifier", keep_good),
    ("language id", keep_identified),
    ("minhash near-dedup", keep_one_each),
    ("source mixing", mix_sources),
    ("byte-level bpe", encode_tokens),
]

#: SQL can't express the learned stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another, over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    root = fresh_dir(spark, "corpus-pipeline")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{k}")
        docs = spark.read.parquet(f"{root}/{k}")
    return docs
