"""The queries of this subpackage: thin wrappers that give each operator its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from axisloom.llm import align, bpe, chat, decontam, jaccard, langid, pii, quality, rollup, tokenfile, topk, toxicity, whiten


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    """Where the installed package of public vocabularies keeps a file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.quality_scores(docs, quality.train(docs, _table(spark, sf_dir, "labels")))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return langid.language_report(docs, langid.train(docs))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.history(_table(spark, sf_dir, "documents"))


def op5_chat_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = chat.conversations(_table(spark, sf_dir, "conversations"))
    return chat.preference_pairs(told, chat.swapped_answers(told))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination_report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(_table(spark, sf_dir, "documents"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.token_file_report(_table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), end_id=2, added_tokens=True)


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(_table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.tiktoken"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_report(_table(spark, sf_dir, "documents"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten.whitening_report(_table(spark, sf_dir, "embeddings"))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.toxicity_scores(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.alignment_report(_table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model"))


TOP_K_SQL = """
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.r <> c.r AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""

QUERIES = {f.__name__: f for f in (op1_top_k, op2_quality, op3_language, op4_token_counts, op5_chat_pairs, op6_decontamination, op7_token_files, op8_byte_bpe, op9_jaccard_join, op10_pii, op11_whitening, op12_toxicity, op13_alignment)}
#: The others' rows can't be stated in SQL (trained models, tokenizers, components of similarity); tests hold them against brute force.
ORACLE_SQL: dict[str, str] = {"op1_top_k": TOP_K_SQL, "op5_chat_pairs": chat.PAIRS_SQL}
