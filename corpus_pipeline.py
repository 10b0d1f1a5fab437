"""A corpus pipeline of five stages over ``documents``: each stage is written as Parquet and read again.

1. language: documents that the language model rejects go.
2. near_duplicates: of each group linked by word-shingle similarity of at least 0.8 one document stays.
3. decontamination: documents that share enough with a benchmark item go.
4. personal_data: spans of personal data are masked in the text, and ``n_chars`` is counted anew.
5. byte_bpe: token ids of every text that is left, as counts and digests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from axisloom.llm import bpe, common, decontam, jaccard, langid, pii, queries


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.recognised(docs, langid.train(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.masked(docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(docs, queries.tokenizer_file("byte_bpe_50k.tiktoken"))


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("personal_data", personal_data), ("byte_bpe", byte_bpe)]

#: Trained models, similarity components and tokenization can't be stated in SQL; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = common.written(stage(spark, docs, sf_dir), name)
    return docs
